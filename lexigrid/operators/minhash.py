"""Near duplicates by MinHash of character shingles; the first of its kind is kept.

128 linear hashes of 32-bit murmur3 values of 5-character shingles, 16 bands of 8 rows,
estimated similarity of 0.85 or more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.functions.text import mix64
from lexigrid.operators.blocks import pairs_within
from lexigrid.operators.components import connected_components
from lexigrid.session import scratch, spread

HASHES, BANDS, SHINGLE = 128, 16, 5
_SPACE = re.compile(r"\s+")
_M32 = np.uint64(0xFFFFFFFF)


def coefficients() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of the hash family. Fixed value: the generator's seed."""
    rng = np.random.default_rng(0xC0FFEE)
    factor = rng.integers(1, 2**32, size=HASHES, dtype=np.uint64) | 1
    return factor, rng.integers(0, 2**32, size=HASHES, dtype=np.uint64)


def _rotated(x: np.ndarray, r: int) -> np.ndarray:
    return ((x << np.uint64(r)) | (x >> np.uint64(32 - r))) & _M32


def murmur3(rows: np.ndarray) -> np.ndarray:
    """32-bit murmur3 with seed 0 of each row of a byte matrix."""
    c1, c2 = np.uint64(0xCC9E2D51), np.uint64(0x1B873593)
    n, width = rows.shape
    data = rows.astype(np.uint64)
    h = np.zeros(n, np.uint64)

    def word(columns: np.ndarray) -> np.ndarray:
        k = sum(columns[:, j] << np.uint64(8 * j) for j in range(columns.shape[1]))
        return (_rotated((k * c1) & _M32, 15) * c2) & _M32

    for at in range(0, width - width % 4, 4):
        h = (_rotated(h ^ word(data[:, at : at + 4]), 13) * np.uint64(5) + np.uint64(0xE6546B64)) & _M32
    if width % 4:
        h ^= word(data[:, width - width % 4 :])
    h ^= np.uint64(width)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = ((h ^ (h >> np.uint64(shift))) * np.uint64(factor)) & _M32
    return h ^ (h >> np.uint64(16))


def shingle_hashes(text: str) -> np.ndarray:
    """murmur3 of every run of 5 characters of the collapsed lower-case text."""
    text = _SPACE.sub(" ", text).strip().lower()
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    starts = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    if len(starts) <= SHINGLE:
        return np.empty(0, np.uint64)
    begin, size = starts[:-SHINGLE], starts[SHINGLE:] - starts[:-SHINGLE]
    out = np.empty(len(begin), np.uint64)
    for width in np.unique(size):
        some = size == width
        out[some] = murmur3(data[begin[some][:, None] + np.arange(width)])
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """Least value of each hash; zeros for a text shorter than a shingle."""
    factor, offset = coefficients()
    out = np.zeros(HASHES, np.uint64)
    for at in range(0, len(hashes), 4096):
        least = ((hashes[at : at + 4096, None] * factor + offset) & _M32).min(axis=0)
        out = least if at == 0 else np.minimum(out, least)
    return out.astype(np.uint32)


def signatures(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [signature(np.unique(shingle_hashes(t))).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "sig"])

    source = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    return spread(source.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, "id long, sig binary")


def _replayed(edges: pd.DataFrame) -> pd.DataFrame:
    """Ids that a component's edges drop, one edge after the other."""
    gone: set[int] = set()
    for lo, hi in edges.sort_values(["least", "band", "lo", "hi"])[["lo", "hi"]].itertuples(index=False):
        if lo not in gone and hi not in gone:
            gone.add(hi)
    return pd.DataFrame({"id": sorted(gone)}, dtype="int64")


def dropped_in_order(edges: DataFrame, small: int = 20_000) -> DataFrame:
    """Ids that go when edges ``(lo, hi, least, band)`` are gone through in the order of ``(least, band, lo, hi)``.

    An edge drops ``hi`` if neither of its ends has gone. Edges of different components don't
    touch, so that a component of at most ``small`` edges is replayed in one task. Larger ones
    are settled in rounds: an edge that comes before all others at both of its ends acts, and
    the edges of the dropped ids go.
    """
    edges = scratch(edges.select("lo", "hi", F.struct("least", "band", "lo", "hi").alias("place")).groupBy("lo", "hi").agg(F.min("place").alias("place")), "edges")
    component = connected_components(edges.select(F.col("lo").alias("src"), F.col("hi").alias("dst"))).withColumnRenamed("id", "lo")
    edges = edges.join(component, "lo")
    sizes = edges.groupBy("component").agg(F.count("*").alias("n"))
    edges = scratch(edges.join(sizes, "component"), "edges")
    one = edges.where(F.col("n") <= small).select("component", "place.*").groupBy("component").applyInPandas(_replayed, "id long")
    open_ = edges.where(F.col("n") > small).select("lo", "hi", "place")
    while not open_.isEmpty():
        first = open_.select(F.explode(F.array("lo", "hi")).alias("end"), "place").groupBy("end").agg(F.min("place").alias("place"))
        # an edge that is the first of both of its ends is named by both
        goes = scratch(first.groupBy("place").agg(F.count("*").alias("n")).where("n = 2").select(F.col("place.hi").alias("id")), "goes")
        one = one.union(goes)
        open_ = scratch(open_.join(goes, open_["hi"] == goes["id"], "left_anti").join(goes, open_["lo"] == goes["id"], "left_anti"), "edges")
    return one


def keep_first_near_duplicates(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.85) -> DataFrame:
    """``(id, kept)`` for every row with an id and a text, ids in ascending order being the order.

    Buckets are gone through by their least member and band, and the pairs of a bucket in order;
    a pair that is similar enough drops its later row if neither row has gone before. Of rows
    with equal signatures (copies, and all texts shorter than a shingle) only the first can
    stay, and no other ever drops a row, so that a large group of copies makes no pairs. Ids
    must be unique.
    """
    sigs = scratch(signatures(df, id_col, text_col), "signatures")
    first = sigs.groupBy("sig").agg(F.min("id").alias("id"))

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, BANDS, HASHES // BANDS)
            keys = np.broadcast_to(salt, sig.shape[:2])
            for row in range(sig.shape[2]):
                keys = mix64(keys + sig[:, :, row].astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(batch.column("id").to_numpy(), BANDS)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(sig)))],
                ["key", "id", "band"],
            )

    keyed = first.mapInArrow(bands, "key long, id long, band int")
    met = pairs_within(keyed, carry={"least": F.min("id"), "band": F.min("band")})
    pairs = met.groupBy(F.col("id_a").alias("lo"), F.col("id_b").alias("hi")).agg(F.min(F.struct("least", "band")).alias("x")).select("lo", "hi", "x.*")
    joined = pairs.join(first.select(F.col("id").alias("lo"), F.col("sig").alias("a")), "lo").join(first.select(F.col("id").alias("hi"), F.col("sig").alias("b")), "hi")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in "ab")
            keep = pa.array((a == b).mean(axis=1) >= threshold)
            names = ["lo", "hi", "least", "band"]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in names], names)

    gone = dropped_in_order(joined.mapInArrow(similar, "lo long, hi long, least long, band int")).withColumn("gone", F.lit(True))
    kept = first.join(gone, "id", "left").select("sig", F.col("id").alias("first"), F.coalesce("gone", F.lit(False)).alias("gone"))
    return sigs.join(kept, "sig").select("id", (~F.col("gone") & (F.col("id") == F.col("first"))).alias("kept"))
