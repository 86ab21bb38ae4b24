"""Measures of a student's graph against a teacher's, over a map between their entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.functions import rules
from lexigrid.session import scratch

#: Counts per passage; edge counts go through the map at both ends.
MEASURES = (
    "teacher_entities", "student_entities", "teacher_matched", "student_matched", "teacher_edges", "student_edges",
    "teacher_edges_matched", "student_edges_matched", "teacher_edges_eligible", "student_edges_eligible", "novel_grounded", "ungrounded",
)


def resolved(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """``(id, pos, a, b)``: edges ``(id, pos, s, t)`` with the first places of their ends' keys; others are left out."""
    first = entities.where("key <> ''").groupBy("id", "key").agg(F.min("place").alias("place"))
    ends = [first.select("id", F.col("key").alias(k), F.col("place").alias(name)) for k, name in (("s", "a"), ("t", "b"))]
    return edges.join(ends[0], ["id", "s"]).join(ends[1], ["id", "t"]).select("id", "pos", "a", "b")


def _mapped(edges: DataFrame, pairs: DataFrame, own: str, other: str) -> DataFrame:
    """``(id, pos, x, y)``: edges whose both ends have a pair, with the ends' partners."""
    one = pairs.select("id", F.col(own).alias("a"), F.col(other).alias("x"))
    two = pairs.select("id", F.col(own).alias("b"), F.col(other).alias("y"))
    return edges.join(one, ["id", "a"]).join(two, ["id", "b"]).select("id", "pos", "x", "y")


def passage_metrics(teacher: DataFrame, student: DataFrame, teacher_edges: DataFrame, student_edges: DataFrame, pairs: DataFrame, passages: DataFrame) -> DataFrame:
    """``(id, *MEASURES)`` of every passage that both have a row for.

    Entities are ``(id, place, key)``, edges ``(id, pos, s, t)`` by keys, ``pairs`` ``(id, left_place,
    right_place)`` from the teacher's to the student's, ``passages`` ``(id, key)`` their texts.
    An edge is matched when an edge of the other side runs between partners of its ends, in the
    same direction; it is eligible when both ends have partners. Student entities without a
    partner are novel when the passage grounds them.
    """
    both = teacher.select("id").distinct().join(student.select("id").distinct(), "id")
    te, se, pairs = (scratch(x.join(both, "id", "left_semi"), "side") for x in (teacher, student, pairs))
    tr, sr = (x.join(both, "id", "left_semi") for x in (teacher_edges, student_edges))
    near, far = scratch(resolved(tr, te), "edges"), scratch(resolved(sr, se), "edges")
    map_t, map_s = scratch(_mapped(near, pairs, "left_place", "right_place"), "edges"), scratch(_mapped(far, pairs, "right_place", "left_place"), "edges")
    hit = lambda mapped, other: mapped.join(other.select("id", F.col("a").alias("x"), F.col("b").alias("y")), ["id", "x", "y"], "left_semi").select("id", "pos").distinct()
    alone = se.where("key <> ''").join(pairs.select("id", F.col("right_place").alias("place")), ["id", "place"], "left_anti").join(passages.withColumnRenamed("key", "text"), "id", "left")
    found = F.coalesce(rules.grounded(F.col("key"), F.coalesce("text", F.lit(""))), F.lit(False))
    counted = dict(zip(MEASURES, (
        te, se, pairs.select("id", "left_place").distinct(), pairs.select("id", "right_place").distinct(), tr, sr, hit(map_t, far), hit(map_s, near),
        map_t.select("id", "pos").distinct(), map_s.select("id", "pos").distinct(), alone.where(found), alone.where(~found),
    )))
    long = None
    for name, rows in counted.items():
        part = rows.groupBy("id").agg(F.count("*").alias("n")).withColumn("m", F.lit(name))
        long = part if long is None else long.union(part)
    return long.groupBy("id").agg(*[F.coalesce(F.sum(F.when(F.col("m") == name, F.col("n"))), F.lit(0)).alias(name) for name in MEASURES])
