"""Joins by keys of which one may have a great share of all rows: such keys are cut into blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.session import scratch

#: Rows of a key, on either side, that meet in one task.
BLOCK = 512


def pairs_within(rows: DataFrame, block: int = BLOCK, carry: dict[str, Column] | None = None) -> DataFrame:
    """``(id_a, id_b)``, ``id_a < id_b``, for every two rows ``(key, id)`` of a key, once for each key that both have.

    Keys that occur once go before the join. A key with more than ``block`` rows is cut into
    blocks, and every two of its blocks meet in a join key of their own, so that no task gets
    a hot key whole. ``carry`` names aggregates over a key's rows that its pairs get as columns.
    Rows with a null key or id have no pairs.
    """
    carry = carry or {}
    rows = rows.where("key is not null and id is not null")
    shared = rows.groupBy("key").agg(F.count("*").alias("members"), *[c.alias(name) for name, c in carry.items()]).where("members > 1")
    sized = (
        rows.select("key", "id").join(shared, "key")
        .withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
        .withColumn("blk", F.expr("cast(pmod(xxhash64(id), blocks) as int)"))
        .select("key", "id", "blocks", "blk", *carry)
    )
    sized = scratch(sized, "blocks")  # both sides of the join below
    left = sized.select("key", "id", *carry, F.col("blk").alias("lo"), F.explode(F.expr("sequence(blk, blocks - 1)")).alias("hi"))
    right = sized.select("key", F.col("id").alias("other"), F.explode(F.expr("sequence(0, blk)")).alias("lo"), F.col("blk").alias("hi"))
    return (
        left.join(right, ["key", "lo", "hi"]).where("id <> other and (lo < hi or id < other)")
        .select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"), *carry)
    )


def meet(left: DataFrame, right: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(key, a, b)``: every row ``(key, a)`` with every row ``(key, b)`` of the same key.

    What a join gives, but a key of many rows on both sides is dealt to tasks by blocks. Null
    keys meet nothing; repeated rows stay. All is joined by sorting and merging: the size of
    compressed files would let the planner send tables of many rows through the driver.
    """
    sizes = left.groupBy("key").agg(F.count("*").alias("n_a")).join(right.groupBy("key").agg(F.count("*").alias("n_b")).hint("merge"), "key")
    sizes = sizes.select("key", F.ceil(F.col("n_a") / block).cast("int").alias("many_a"), F.ceil(F.col("n_b") / block).cast("int").alias("many_b"))
    one = left.join(sizes.hint("merge"), "key").select(
        "key", "a", F.expr("cast(pmod(xxhash64(a), many_a) as int)").alias("lo"), F.explode(F.expr("sequence(0, many_b - 1)")).alias("hi")
    )
    other = right.join(sizes.hint("merge"), "key").select(
        "key", "b", F.explode(F.expr("sequence(0, many_a - 1)")).alias("lo"), F.expr("cast(pmod(xxhash64(b), many_b) as int)").alias("hi")
    )
    return one.join(other.hint("merge"), ["key", "lo", "hi"]).select("key", "a", "b")


def expanded(links: DataFrame, left: DataFrame, right: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(link, a, b)``: every link between classes as the pairs of their members.

    ``links`` is ``(id_a, id_b, link)``, ``link`` telling links apart; ``left`` is ``(key, a)`` and
    ``right`` ``(key, b)``, the members ``a`` and ``b`` of the classes ``key``.

    Both ends are written first: ``meet`` reads each of its tables three times, and a plan with
    nine copies of everything takes most of the driver's memory. An end has no more rows than the
    result has where the classes at its other end have members.
    """
    ends = [
        scratch(
            meet(links.select(F.col(f"id_{side}").alias("key"), F.col("link").alias("a")), members.select("key", F.col(side).alias("b")), block)
            .select(F.col("a").alias("key"), F.col("b").alias(side)), "end",
        )
        for side, members in (("a", left), ("b", right))
    ]
    return meet(*ends, block).withColumnRenamed("key", "link")
