"""Nearest neighbours of a stated query set among all vectors, exact."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best scores of each row with their ids, ties by the lesser id; only what reaches the k-th best is sorted."""
    if score.shape[1] > 4 * k:
        least = -np.partition(-score, k - 1, axis=1)[:, k - 1]
        some = score >= least[:, None]
        width = int(some.sum(axis=1).max())
        place = np.argsort(~some, axis=1, kind="stable")[:, :width]
        score = np.where(np.take_along_axis(some, place, 1), np.take_along_axis(score, place, 1), -np.inf)
        ids = np.take_along_axis(ids, place, 1)
    order = np.lexsort((ids, -score), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int, block: int = 2000) -> DataFrame:
    """``(query_id, id, cosine, rank)``: the ``k`` vectors of greatest cosine to each query, itself left out.

    Queries go to every task in blocks of at most ``block``; each task keeps its ``k`` best per
    query, so that only those are shuffled. Ties go to the lesser id. Null vectors are left out.
    """
    spark = vectors.sparkSession
    asked = queries.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    schema = "query_id long, id long, cosine double"
    out = spark.createDataFrame([], schema)
    parts = max(1, -(-asked.count() // block))
    for part in range(parts):
        some = asked.where(F.expr(f"pmod(xxhash64(id), {parts}) = {part}")).collect()
        if not some:
            continue
        sent = spark.sparkContext.broadcast((np.array([r.id for r in some]), _unit([r.v for r in some])))

        def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, asked = sent.value
            kept_id, kept = np.empty((len(ids), 0), np.int64), np.empty((len(ids), 0))
            for batch in batches:
                own = batch.column("id").to_numpy()
                score = asked @ _unit(batch.column("v").to_pylist()).T
                score[ids[:, None] == own[None, :]] = -np.inf
                kept, kept_id = _best(np.concatenate([kept, score], axis=1), np.concatenate([kept_id, np.broadcast_to(own, score.shape)], axis=1), k)
            found = np.isfinite(kept)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, found.sum(axis=1))), pa.array(kept_id[found]), pa.array(kept[found])], ["query_id", "id", "cosine"]
            )

        out = out.union(rows.mapInArrow(best, schema))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)
