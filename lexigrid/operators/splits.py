"""Samples and splits by ranks in a fixed random order: larger ones contain smaller ones, splits never share a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.operators.keep import hash_order, terciles

#: Strata of a source: terciles of the value.
STRATA = 3


def quotas(n: int, shares: dict[str, float]) -> dict[tuple[str, int], int]:
    """Rows of each source and stratum of a sample of ``n``; the last source takes what rounding leaves, low strata the remainder."""
    out, left = {}, n
    for k, (source, share) in enumerate(shares.items()):
        own = left if k == len(shares) - 1 else min(left, round(n * share))
        left -= own
        for stratum in range(STRATA):
            out[source, stratum] = own // STRATA + (stratum < own % STRATA)
    return out


def _ranked(df: DataFrame, id_col: str, source: str, value: str, seed: str) -> DataFrame:
    marked = df.join(terciles(df, source, value), source).withColumn(
        "stratum", F.when(F.col(value) <= F.col("t1"), 0).when(F.col(value) <= F.col("t2"), 1).otherwise(2)
    ).drop("t1", "t2")
    order = Window.partitionBy(source, "stratum").orderBy(hash_order(F.col(id_col), seed), F.col(id_col))
    return marked.withColumn("rank", F.row_number().over(order))


def _quota(parts: dict[tuple[str, int], int], source: str) -> Column:
    out = F.lit(0)
    for (name, stratum), n in parts.items():
        out = F.when((F.col(source) == name) & (F.col("stratum") == stratum), n).otherwise(out)
    return out


def sample(df: DataFrame, id_col: str, source: str, value: str, n: int, shares: dict[str, float], reserved: DataFrame | None = None, seed: str = "0") -> DataFrame:
    """``n`` rows of ``df`` by shares of the sources and terciles of ``value``, with ``stratum``.

    The sample for a greater ``n`` holds the one for a smaller. Strata with too few rows are
    not filled up from others. Ids of ``reserved`` are left out before anything is ranked.
    """
    if reserved is not None:
        df = df.join(reserved.select(id_col), id_col, "left_anti")
    ranked = _ranked(df.where(F.col(source).isin(*shares)), id_col, source, value, seed)
    return ranked.where(F.col("rank") <= _quota(quotas(n, shares), source)).drop("rank")


def disjoint_splits(df: DataFrame, id_col: str, source: str, value: str, sizes: dict[str, int], shares: dict[str, float], forced: DataFrame | None = None, seed: str = "0") -> DataFrame:
    """``(id, split)``: splits of these sizes drawn one after the other from what is left, in one ranked pass.

    ``forced`` ``(id, split)`` rows are in their splits and count towards no quota.
    """
    rest = df if forced is None else df.join(forced.select(id_col), id_col, "left_anti")
    ranked = _ranked(rest.where(F.col(source).isin(*shares)), id_col, source, value, seed)
    split, upto = F.lit(None).cast("string"), dict.fromkeys(quotas(0, shares), 0)
    bounds = []
    for name, n in sizes.items():
        upto = {k: upto[k] + q for k, q in quotas(n, shares).items()}
        bounds.append((name, upto))
    for name, parts in reversed(bounds):
        split = F.when(F.col("rank") <= _quota(parts, source), name).otherwise(split)
    # no more than the last bound is ranked of any stratum
    drawn = ranked.where(F.col("rank") <= _quota(bounds[-1][1], source)).select(id_col, split.alias("split"))
    return drawn if forced is None else drawn.union(forced.select(id_col, "split"))


def first_ids(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """``(id, split)``: the ``n`` least ids are ``val``, the others ``train``."""
    ids = df.select(id_col).distinct()
    low = ids.orderBy(id_col).limit(n).withColumn("split", F.lit("val"))
    return ids.join(low, id_col, "left").withColumn("split", F.coalesce("split", F.lit("train")))
