"""Rows to keep of each key, ranks and samples by hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, chosen before rows are shuffled where possible.

    The order is packed in a struct and its least is found by an aggregation, which combines
    on the map side; a hot key needs no sort. Null keys are a key. All columns are kept.
    """
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*[o.alias(f"__{k}") for k, o in enumerate(order)], *[F.col(c) for c in rest])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), packed).alias("__row")).select(*keys, "__row.*")


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*[o.alias(f"__{k}") for k, o in enumerate(order)])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), packed).alias("__row")).select(*keys, "__row.*")


def hash_order(key: Column, seed: str = "0") -> Column:
    """A fixed random order of rows that any engine can repeat."""
    return F.md5(F.concat(F.lit(seed + ":"), key.cast("string")))


def terciles(df: DataFrame, group: str, value: str) -> DataFrame:
    """``(group, t1, t2)``: values at the places n/3 and 2n/3 (rounded down) of each group's order.

    The places are looked up in running counts of distinct values, not in sorted rows.
    """
    counts = df.groupBy(group, value).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(group)
    running = counts.withColumn("__upto", F.sum("__n").over(w.orderBy(value))).withColumn("__total", F.sum("__n").over(w))
    at = lambda k: F.min(F.when(F.col("__upto") > F.floor(F.col("__total") * k / 3), F.col(value)))
    return running.groupBy(group).agg(at(1).alias("t1"), at(2).alias("t2"))


def stratified(df: DataFrame, id_col: str, group: str, value: str, per_stratum: int, seed: str = "0") -> DataFrame:
    """``per_stratum`` rows of each group and tercile of ``value``, first in hash order.

    Adds ``stratum`` 0 to 2. Small strata are taken whole and not filled up from others.
    """
    marked = df.join(terciles(df, group, value), group).withColumn(
        "stratum", F.when(F.col(value) <= F.col("t1"), 0).when(F.col(value) <= F.col("t2"), 1).otherwise(2)
    ).drop("t1", "t2")
    w = Window.partitionBy(group, "stratum").orderBy(hash_order(F.col(id_col), seed), F.col(id_col))
    return marked.withColumn("__place", F.row_number().over(w)).where(F.col("__place") <= per_stratum).drop("__place")
