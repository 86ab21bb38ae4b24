"""Word shingles of texts and exact overlaps of pairs of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.functions.text import distinct_grams, word_hashes

#: Texts that a task looks at together.
ROWS = 1000


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def gram_sets(df: DataFrame, n: int) -> DataFrame:
    """``(id, grams)`` from ``(id, text)``: the sorted distinct hashes of runs of ``n`` folded words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            grams, bounds = distinct_grams(*word_hashes(part.column("text").to_pylist()), n)
            sets = [grams[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.binary())], ["id", "grams"])

    return df.select("id", "text").mapInArrow(run, "id long, grams binary")


def exact_overlap(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """``pairs`` ``(id_a, id_b)`` with ``n_a``, ``n_b`` and ``shared`` distinct ``n``-grams.

    ``texts`` is ``(id, text)``. Only texts that stand in a pair are tokenised.
    """
    wanted = pairs.select(F.col("id_a").alias("id")).union(pairs.select("id_b")).distinct()
    sets = gram_sets(texts.join(wanted, "id", "left_semi"), n)
    sets = sets.groupBy("id").agg(F.min("grams").alias("grams"))
    joined = pairs.join(sets.select(F.col("id").alias("id_a"), F.col("grams").alias("grams_a")), "id_a").join(
        sets.select(F.col("id").alias("id_b"), F.col("grams").alias("grams_b")), "id_b"
    )
    kept = [c for c in pairs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            counts = []
            for x, y in zip(part.column("grams_a").to_pylist(), part.column("grams_b").to_pylist()):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate((a, b))
                both.sort(kind="stable")
                counts.append((len(a), len(b), int((both[1:] == both[:-1]).sum())))
            added = [pa.array([c[k] for c in counts], pa.int32()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in kept] + added, kept + ["n_a", "n_b", "shared"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return joined.select(*kept, "grams_a", "grams_b").mapInArrow(
        run, f"{schema}, n_a int, n_b int, shared int"
    )


def jaccard_at_least(threshold: float):
    """``shared / (n_a + n_b - shared) >= threshold``, for a threshold in thousandths without rounding."""
    return F.expr(f"shared * 1000L >= {round(threshold * 1000)}L * (n_a + n_b - shared)")
