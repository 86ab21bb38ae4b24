"""Connected components of an undirected graph, as rounds of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.session import scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    low = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
    return (
        both.where("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        .where("src <> dst").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("src").agg(F.min("dst").alias("low"))
    moved = edges.join(low, "src")
    return (
        moved.select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        .union(low.select("src", F.col("low").alias("dst")))
        .where("src <> dst").distinct()
    )


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 50) -> DataFrame:
    """``(id, component)``: the least id that each end of an edge can reach.

    Alternating large-star and small-star rounds, so that the number of rounds grows with the
    logarithm of the graph's diameter and no component is ever gathered in one task. Rows with
    a null end and self-loops are ignored; repeated and reversed edges count once. Ids that
    occur only in such rows are not returned: they are their own component.
    """
    work = (
        edges.select(F.greatest(src, dst).alias("src"), F.least(src, dst).alias("dst"))
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("src") > F.col("dst")))
        if (src, dst) != ("src", "dst")
        else edges.where("src is not null and dst is not null and src <> dst").select(
            F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")
        )
    ).distinct()
    work = scratch(work, "edges")
    before = None
    for _ in range(max_rounds):
        work = scratch(_small_star(_large_star(work)), "edges")
        # a fingerprint of the whole edge set: when a round leaves it as it was, every edge is a star's
        now = work.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = work.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    return stars.union(stars.select(F.col("component").alias("id"), "component")).distinct()
