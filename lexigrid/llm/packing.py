"""Problem 6: filling containers of fixed capacity with texts sized in tokens.

A configuration linear program over the histogram of sizes: how often to use which pattern of
sizes, so that all items are covered by the fewest containers. It is solved by multiplicative
weights, where each round prices patterns by an exact knapsack over the capacity; patterns are
rounded down, filled up, and what is left goes first-fit decreasing. The prices also prove how
many containers any packing needs. Where first-fit decreasing alone needs fewer than the rounded
program, it stands instead. The program's size follows from the capacity, not from the number of items: Spark counts the items, numbers them within their size
and looks their container up in the rounded patterns.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.shingles import slices
from lexigrid.session import scratch, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the public vocabulary splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SALTS = 64


def token_counts(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(id, n_tokens)``; null texts have none. The driver's file ``vocabulary`` is sent to all tasks."""
    df.sparkSession.sparkContext.addFile(vocabulary)
    name = Path(vocabulary).name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(SparkFiles.get(name), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coder = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for part in slices(batches):
            counts = [len(coder.encode_ordinary(t)) if t else 0 for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(counts, pa.int32())], ["id", "n_tokens"])

    rows = spread(df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text")))
    return rows.mapInArrow(run, "id long, n_tokens int")


def best_pattern(sizes: np.ndarray, price: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size fill a container of the greatest total price: unbounded knapsack."""
    value = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(int(sizes[0]), capacity + 1):
        k = upto[c]
        total = value[c - sizes[:k]] + price[:k]
        at = int(total.argmax())
        if total[at] > value[c - 1]:
            value[c], choice[c] = total[at], at
        else:
            value[c], choice[c] = value[c - 1], -1
    out = np.zeros(len(sizes), np.int64)
    c = capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            out[choice[c]] += 1
            c -= int(sizes[choice[c]])
    return out


def fractional_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int, rate: float = 1.0, step: float = 0.5) -> tuple[list[tuple[np.ndarray, float]], float]:
    """Patterns and how often to use them, by multiplicative weights over the sizes' coverage; and a bound.

    Prices under which no pattern is worth more than 1 show that as many containers are needed
    as all items together are worth. The bound is the best that a round's prices or the later
    rounds' mean prices show.
    """
    covered, bound, mean = np.zeros(len(sizes)), 0.0, np.zeros(len(sizes))
    used: dict[bytes, float] = {}
    for k in range(rounds):
        share = covered / demand
        # sizes that are covered less than others weigh more; per item, so that prices add up in a container
        price = np.exp(-rate * (share - share.min())) * sizes
        pattern = best_pattern(sizes, price, capacity)
        bound = max(bound, float(demand @ price / (pattern @ price)))
        mean += price / (pattern @ price) * (k >= rounds // 2)
        pattern = np.minimum(pattern, np.ceil(demand).astype(np.int64))
        some = pattern > 0
        times = step * (demand[some] / pattern[some]).min()
        covered += times * pattern
        used[pattern.tobytes()] = used.get(pattern.tobytes(), 0.0) + times
    bound = max(bound, float(demand @ mean / (best_pattern(sizes, mean, capacity) @ mean)))
    scale = max((covered * sizes).sum() / (demand * sizes).sum(), 1e-9)
    return [(np.frombuffer(p, np.int64), x / scale) for p, x in used.items()], bound


class _Containers:
    """Containers filled so far, and how many items of each size are left."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray, capacity: int):
        self.sizes, self.left, self.capacity = sizes, counts.copy(), capacity
        self.placed = np.zeros(len(sizes), np.int64)
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.n = 0

    def put(self, pattern: np.ndarray, times: int) -> None:
        for k in np.flatnonzero(pattern):
            n = int(pattern[k]) * times
            self.rows.append((int(self.sizes[k]), int(self.placed[k]), int(self.placed[k]) + n, int(pattern[k]), self.n))
            self.placed[k] += n
            self.left[k] -= n
        self.n += times

    def filled(self, pattern: np.ndarray, times: int) -> np.ndarray:
        """The pattern with the largest items that still fit, where there are enough for all its containers."""
        pattern, room = pattern.copy(), self.capacity - int(pattern @ self.sizes)
        most = self.left // times - pattern
        k = len(self.sizes)
        while room > 0:
            k = min(k, int(np.searchsorted(self.sizes, room, "right")))
            fits = np.flatnonzero(most[:k] > 0)
            if not len(fits):
                break
            k = int(fits[-1])
            take = int(min(most[k], room // self.sizes[k]))
            pattern[k] += take
            most[k] -= take
            room -= take * int(self.sizes[k])
        return pattern

    def first_fit(self) -> _Containers:
        """All that is left, largest first."""
        while self.left.any():
            pattern = self.filled(np.zeros(len(self.sizes), np.int64), 1)
            used = pattern > 0
            self.put(pattern, int((self.left[used] // pattern[used]).min()))
        return self


def solved(sizes: np.ndarray, counts: np.ndarray, capacity: int, effort: float = 2.0) -> tuple[_Containers, int, int]:
    """The containers, a number that any packing needs, and how many first-fit decreasing takes."""
    order = np.argsort(sizes)
    sizes, counts = sizes[order].astype(np.int64), counts[order].astype(np.int64)
    plain = _Containers(sizes, counts, capacity).first_fit()
    whole = sizes == capacity
    small = (counts > 0) & ~whole
    least = int(counts[whole].sum())
    if not small.any():
        return plain, least, plain.n
    out = _Containers(sizes, counts, capacity)
    if least:
        out.put(whole.astype(np.int64), least)
    s, n = sizes[small], counts[small].astype(float)
    each = max(1.0, capacity / ((s * n).sum() / n.sum()))
    rounds = max(50, min(400, 400_000 // capacity), effort * len(s) / each)
    patterns, bound = fractional_patterns(s, n, capacity, int(rounds))
    for pattern, x in sorted(patterns, key=lambda p: -p[1]):
        full = np.zeros(len(sizes), np.int64)
        full[small] = pattern
        used = full > 0
        times = int(min(np.floor(x), (out.left[used] // full[used]).min()))
        if times > 0:
            out.put(out.filled(full, times), times)
    out.first_fit()
    return out if out.n <= plain.n else plain, least + int(np.ceil(bound - 1e-6)), plain.n


def pack(sizes: np.ndarray, counts: np.ndarray, capacity: int, effort: float = 2.0) -> list[tuple[int, int, int, int, int]]:
    """Rows ``(size, low, high, per, first)``: items ``low <= number < high`` of a size lie ``per``
    to a container, beginning with container ``first``."""
    return solved(sizes, counts, capacity, effort)[0].rows


class Packing:
    """Items ``(id, n_tokens)`` in containers of each of ``containers``' capacities.

    An item larger than the capacity is cut into pieces of the capacity and a rest; no other
    item is divided. ``items``: ``(container_kind, container_id, id, piece_no, first_token,
    n_tokens)``. Items without tokens, and null or non-positive capacities, have no rows.
    Repeated rows are items of their own; kinds of the same name should have one capacity.
    More than ``most_kinds`` of them are an error, since each takes every item.
    """

    def __init__(self, sizes: DataFrame, containers: DataFrame, most_kinds: int = 100):
        kinds = containers.where("capacity_tokens > 0").select("container_kind", F.col("capacity_tokens").alias("capacity")).distinct()
        sizes = scratch(sizes.select("id", "n_tokens").where("n_tokens > 0"), "sizes")
        each = kinds.orderBy("container_kind", "capacity").limit(most_kinds + 1).collect()
        if len(each) > most_kinds:
            raise ValueError(f"more than {most_kinds} kinds of container")
        named = [F.struct(F.lit(r.container_kind).cast("string").alias("container_kind"), F.lit(r.capacity).cast("int").alias("capacity")) for r in each]
        named = F.array(*named) if named else F.lit(None).cast("array<struct<container_kind:string,capacity:int>>")
        pieces = (
            sizes.select("*", F.inline(named))  # a row for each kind of container
            .withColumn("piece_no", F.explode(F.expr("sequence(1, cast(ceil(n_tokens / capacity) as int))")))
            .withColumn("first_token", F.expr("(piece_no - 1) * capacity"))
            .withColumn("size", F.expr("least(capacity, n_tokens - first_token)"))
            .withColumn("salt", F.expr(f"cast(pmod(xxhash64(id, piece_no), {SALTS}) as int)"))
        )
        # a size may have a third of all items: they are numbered in parts, which follow each other
        counts = scratch(pieces.groupBy("container_kind", "capacity", "size", "salt").agg(F.count("*").alias("n")), "counts")
        offsets = counts.withColumn(
            "offset", F.expr("sum(n) over (partition by container_kind, size order by salt) - n")
        ).select("container_kind", "size", "salt", "offset", "n")
        histogram = counts.groupBy("container_kind", "capacity", "size").agg(F.sum("n").alias("n"))

        def solve(group: pd.DataFrame) -> pd.DataFrame:
            containers, bound, plain = solved(group["size"].to_numpy(), group["n"].to_numpy(), int(group["capacity"].iloc[0]))
            out = pd.DataFrame(containers.rows, columns=["size", "low", "high", "per", "first"])
            return out.assign(container_kind=group["container_kind"].iloc[0], bound=bound, first_fit=plain)

        self.plan = scratch(
            histogram.repartition(16, "container_kind").groupBy("container_kind").applyInPandas(solve, "size int, low long, high long, per long, first long, container_kind string, bound long, first_fit long"), "plan"
        )
        # an item meets only the rows of the plan that reach into its part. Both joins are merged: the planner takes
        # a written table for as large as its compressed files, without the rows that explode makes, and would send all pieces to the driver
        ranges = offsets.join(self.plan.hint("merge"), ["container_kind", "size"]).where("low < offset + n and high > offset").select(
            "container_kind", "size", "salt", "offset", "low", "high", "per", "first"
        )
        self.items = (
            pieces.withColumn("place", F.expr("row_number() over (partition by container_kind, size, salt order by id, piece_no) - 1"))
            .join(ranges.hint("merge"), ["container_kind", "size", "salt"]).withColumn("number", F.expr("offset + place")).where("number >= low and number < high")
            .select(
                "container_kind", F.expr("first + (number - low) div per").alias("container_id"), "id", "piece_no",
                F.col("first_token").cast("int").alias("first_token"), F.col("size").alias("n_tokens"),
            )
        )
        self.kinds = kinds

    def fill(self) -> DataFrame:
        """``(container_kind, capacity, n_containers, n_tokens, least_containers, first_fit, fill)`` by kind.

        ``least_containers`` is what any packing needs, by the program's prices or the sum of
        all tokens; ``first_fit`` what first-fit decreasing alone would take.
        """
        per = self.items.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("tokens"))
        shown = self.plan.groupBy("container_kind").agg(F.max("bound").alias("bound"), F.max("first_fit").alias("first_fit"))
        return (
            per.groupBy("container_kind").agg(F.count("*").alias("n_containers"), F.sum("tokens").alias("n_tokens"))
            .join(self.kinds, "container_kind").join(shown, "container_kind")
            .select("container_kind", "capacity", "n_containers", "n_tokens", F.greatest("bound", F.expr("ceil(n_tokens / capacity)")).alias("least_containers"), "first_fit",
                    F.expr("n_tokens / (n_containers * capacity)").alias("fill"))
        )
