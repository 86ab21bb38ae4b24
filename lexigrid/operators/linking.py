"""Pairing of the titles of two labellings, passage by passage: exact, greedy and optimal one-to-one.

Sides are ``(id, place, key)``: a passage's titles by their place. A passage's titles are few;
what is joined within one is bounded by its two lists.
"""

from __future__ import annotations

import difflib
import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.session import scratch

_WORDS = re.compile(r"\w+")


def _distinct(side: DataFrame, name: str) -> DataFrame:
    """A place for each key of a passage, the last one; empty keys are none."""
    return side.where("key <> ''").groupBy("id", "key").agg(F.max("place").alias(name))


def exact_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(id, left_place, right_place)`` of equal keys; of repeated keys the last place counts."""
    return _distinct(left, "left_place").join(_distinct(right, "right_place"), ["id", "key"]).drop("key")


def unmatched(side: DataFrame, pairs: DataFrame, place: str) -> DataFrame:
    """Rows of a side that stand in no pair; ``place`` names its column in ``pairs``."""
    return side.join(pairs.select("id", F.col(place).alias("place")), ["id", "place"], "left_anti")


def one_to_one(scored: DataFrame) -> DataFrame:
    """The pairs that remain of ``(id, left_place, right_place, score)`` when the best is taken first, then the best of the rest.

    Equal scores go by the lesser left and right place. Pairs that come first at both of their
    ends can be taken together, whatever else is taken; that is done until none is left.
    """
    columns = ["id", "left_place", "right_place", "score"]
    order = F.struct((-F.col("score")).alias("cost"), "left_place", "right_place").alias("rank")
    open_, taken = scratch(scored.select(*columns, order), "scored"), scored.select(*columns).limit(0)
    while not open_.isEmpty():
        ends = [open_.groupBy("id", end).agg(F.min("rank").alias("rank")).select("id", "rank") for end in ("left_place", "right_place")]
        best = ends[0].join(ends[1], ["id", "rank"]).select("id", "rank.left_place", "rank.right_place", (-F.col("rank.cost")).alias("score"))
        best = scratch(best, "best")
        taken = taken.union(best)
        for end in ("left_place", "right_place"):
            open_ = open_.join(best.select("id", end), ["id", end], "left_anti")
        open_ = scratch(open_.select(*columns, "rank"), "scored")
    return taken


def greedy_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(id, left_place, right_place, score)``, one to one: equal keys (2) first, then contained ones by the ratio of their lengths (1 and more)."""
    same = exact_pairs(left, right)
    rest = [
        unmatched(_distinct(side, "place"), same, name).select("id", F.col("place").alias(name), F.col("key").alias(f"{name}_key"))
        for side, name in ((left, "left_place"), (right, "right_place"))
    ]
    a, b = F.col("left_place_key"), F.col("right_place_key")
    ratio = F.least(F.length(a), F.length(b)).cast("double") / F.greatest(F.length(a), F.length(b)).cast("double")
    within = rest[0].join(rest[1], "id").where(F.contains(a, b) | F.contains(b, a))
    return same.withColumn("score", F.lit(2.0)).union(one_to_one(within.select("id", "left_place", "right_place", (1 + ratio).alias("score"))))


class Similarity:
    """Likeness of titles to one other: half the matcher's ratio, half the Jaccard similarity of the words."""

    def __init__(self, other: str):
        self.other, self.words = other, set(_WORDS.findall(other))
        self.matcher = difflib.SequenceMatcher()
        self.matcher.set_seq2(other)

    def of(self, title: str) -> float:
        """1 for equal titles, 0 where only one is empty."""
        if title == self.other or not (title and self.other):
            return float(title == self.other)
        self.matcher.set_seq1(title)
        words = set(_WORDS.findall(title))
        either = words | self.words
        return self.matcher.ratio() / 2 + (len(words & self.words) / len(either) if either else 0.0) / 2


def lexical_similarity(a: str, b: str) -> float:
    return Similarity(b).of(a)


def best_matching(score: list[list[float]]) -> list[tuple[int, int]]:
    """Pairs of rows and columns, as many as the shorter side has, with the greatest total.

    A cheapest flow, one unit after the other: each goes along the cheapest path from an
    unmatched row to an unmatched column through pairs made before, which it turns. Paths are
    searched by Dijkstra's algorithm on costs that potentials keep from being negative.
    """
    if not score or not score[0]:
        return []
    n, m, top = len(score), len(score[0]), max(map(max, score))
    far_row, far_column = [0.0] * n, [0.0] * m
    row_of: dict[int, int] = {}
    for _ in range(min(n, m)):
        matched = set(row_of.values())
        way, heap = {i: 0.0 for i in range(n) if i not in matched}, [(0.0, i) for i in range(n) if i not in matched]
        reach: dict[int, float] = {}
        came: dict[int, int] = {}
        end, least = -1, float("inf")
        while heap and heap[0][0] < least:
            d, i = heapq.heappop(heap)
            if d > way[i]:
                continue
            for j in range(m):
                step = d + max(top - score[i][j] + far_row[i] - far_column[j], 0.0)
                if step < reach.get(j, float("inf")) and row_of.get(j) != i:
                    reach[j], came[j] = step, i
                    if j not in row_of:
                        if step < least:
                            end, least = j, step
                    elif step < way.get(row_of[j], float("inf")):
                        way[row_of[j]] = step
                        heapq.heappush(heap, (step, row_of[j]))
        for i in range(n):
            far_row[i] += min(way.get(i, least), least)
        for j in range(m):
            far_column[j] += min(reach.get(j, least), least)
        partner = {i: j for j, i in row_of.items()}
        while end is not None:
            row = came[end]
            row_of[end], end = row, partner.get(row)
    return sorted((i, j) for j, i in row_of.items())


def optimal_pairs(sides: DataFrame, least: float = 0.5) -> DataFrame:
    """``(id, left_place, right_place, score)`` from ``(id, left, right)``, arrays of keys of one passage.

    One-to-one pairs with the greatest total similarity, of which those of ``least`` or more
    are given. A row holds one passage's two lists, so a task never gathers more than batches of rows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, left, right in zip(frame["id"], frame["left"], frame["right"]):
                by_right = [[s.of(a) for a in left] for s in map(Similarity, right)]
                score = [list(row) for row in zip(*by_right)]
                rows += [(key, i, j, score[i][j]) for i, j in best_matching(score) if score[i][j] >= least]
            yield pd.DataFrame(rows, columns=["id", "left_place", "right_place", "score"])

    return sides.select("id", "left", "right").mapInPandas(run, "id string, left_place int, right_place int, score double")
