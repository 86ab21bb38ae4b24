"""Problem 1: near-duplicate texts by HyperMinHash.

Every text's word shingles fall into ``2**p`` buckets by their hash's first bits. Of each
bucket the least remaining hash is kept as its number of leading zeros and ``r`` mantissa
bits: a register of 16 bits. Bands of registers, after empty ones were densified, give
candidate pairs; a Jaccard estimate from the registers, less the agreement expected by
chance, thins them; what is left is compared shingle by shingle.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.functions.text import distinct_grams, mix64, word_hashes
from lexigrid.llm.shingles import exact_overlap, jaccard_at_least, slices
from lexigrid.operators.blocks import expanded, pairs_within
from lexigrid.operators.components import connected_components
from lexigrid.session import scratch, spread

P, MANTISSA = 8, 10
REGISTERS = 1 << P
_REST = 64 - P
_PROBES = 48


def registers(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """HyperMinHash registers, one row of 256 per text; 0 is an empty register.

    ``grams`` are sorted within each text, so that a bucket's first gram is its least.
    """
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    cell = owner * REGISTERS + (grams >> np.uint64(_REST)).astype(np.int64)
    first = np.ones(len(grams), bool)
    first[1:] = cell[1:] != cell[:-1]
    rest = grams[first] & np.uint64((1 << _REST) - 1)
    bits = np.frexp(rest.astype(np.float64))[1]  # bit length of the rest
    shift = np.maximum(bits - 1 - MANTISSA, 0).astype(np.uint64)
    mantissa = (rest >> shift) & np.uint64((1 << MANTISSA) - 1)
    out = np.zeros((len(bounds) - 1) * REGISTERS, np.uint16)
    out[cell[first]] = ((_REST - bits + 1).astype(np.uint64) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    return out.reshape(-1, REGISTERS)


def densified(regs: np.ndarray) -> np.ndarray:
    """Fill each empty register from the first full one in its own fixed random order of probes."""
    probes = np.random.default_rng(77).integers(0, REGISTERS, (_PROBES, REGISTERS))
    out = regs.copy()
    todo = np.flatnonzero((out == 0).any(axis=1) & (regs > 0).any(axis=1))
    for probe in probes:
        if not len(todo):
            break
        rows = out[todo]
        np.copyto(rows, regs[todo][:, probe], where=rows == 0)
        out[todo] = rows
        todo = todo[(rows == 0).any(axis=1)]
    for step in range(1, REGISTERS):
        if not len(todo):
            break
        rows = out[todo]
        np.copyto(rows, np.roll(regs[todo], -step, axis=1), where=rows == 0)
        out[todo] = rows
        todo = todo[(rows == 0).any(axis=1)]
    return out


def band_keys(regs: np.ndarray, rows: int) -> np.ndarray:
    """A 48-bit key per text and band of ``rows`` densified registers."""
    if rows not in (1, 2, 4):
        raise ValueError("a band has 1, 2 or 4 registers")
    dense = np.ascontiguousarray(densified(regs)).view({1: np.uint16, 2: np.uint32, 4: np.uint64}[rows])
    salt = mix64(np.arange(1, dense.shape[1] + 1, dtype=np.uint64))
    return (mix64(dense.astype(np.uint64) + salt) >> np.uint64(16)).astype(np.int64)


def chance_table(size: int = 28) -> np.ndarray:
    """Expected share of registers in which two disjoint sets agree by chance.

    Entry (i, j) holds for ``2**(i-10)`` and ``2**(j-10)`` shingles per register.
    """
    load = 2.0 ** (np.arange(size) - 10)
    level = 2.0 ** -np.arange(1, 41)
    low = (level[:, None] * (1 + np.arange(1 << MANTISSA) / (1 << MANTISSA))).ravel()
    width = np.repeat(level / (1 << MANTISSA), 1 << MANTISSA)
    share = np.exp(-load[:, None] * low) * -np.expm1(-load[:, None] * width)
    return share @ share.T


def signatures(texts: DataFrame, n: int, min_words: int) -> DataFrame:
    """``(id, digest, n, regs)`` of the texts with at least ``min_words`` folded words.

    ``digest`` is equal where the whole sets of shingles are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            hashes, starts = word_hashes(part.column("text").to_pylist())
            grams, bounds = distinct_grams(hashes, starts, n)
            enough = np.flatnonzero((np.diff(starts) >= min_words) & (np.diff(bounds) > 0))
            regs = registers(grams, bounds)
            digests = [hashlib.blake2b(grams[bounds[k] : bounds[k + 1]].tobytes(), digest_size=12).digest() for k in enough]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id").take(pa.array(enough)),
                    pa.array(digests, pa.binary()),
                    pa.array(np.diff(bounds)[enough], pa.int32()),
                    pa.array([regs[k].tobytes() for k in enough], pa.binary()),
                ],
                ["id", "digest", "n", "regs"],
            )

    return texts.mapInArrow(run, "id long, digest binary, n int, regs binary")


def estimated(pairs: DataFrame, sigs: DataFrame, threshold: float, sigmas: float = 4.0) -> DataFrame:
    """The pairs whose corrected estimate is not more than ``sigmas`` standard errors too low."""
    chance = chance_table()
    side = sigs.select("id", "n", "regs")
    joined = pairs.join(
        side.select(F.col("id").alias("id_a"), F.col("n").alias("n_a"), F.col("regs").alias("regs_a")), "id_a"
    ).join(side.select(F.col("id").alias("id_b"), F.col("n").alias("n_b"), F.col("regs").alias("regs_b")), "id_b")
    # sets of sizes n_a and n_b cannot be more alike than the smaller is to the larger
    joined = joined.where(F.expr(f"least(n_a, n_b) * 1000L >= {round(threshold * 1000)}L * greatest(n_a, n_b)"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            a, b = (
                np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                for c in ("regs_a", "regs_b")
            )
            used = ((a > 0) | (b > 0)).sum(axis=1)
            equal = ((a == b) & (a > 0)).sum(axis=1)
            at = [
                np.clip(np.rint(np.log2(part.column(c).to_numpy(zero_copy_only=False) / REGISTERS) + 10), 0, len(chance) - 1).astype(int)
                for c in ("n_a", "n_b")
            ]
            estimate = (equal - REGISTERS * chance[at[0], at[1]]) / used
            near = estimate >= threshold - sigmas * np.sqrt(threshold * (1 - threshold) / used)
            keep = pa.array(np.flatnonzero(near))
            yield pa.RecordBatch.from_arrays(
                [part.column("id_a").take(keep), part.column("id_b").take(keep), pa.array(estimate[near])],
                ["id_a", "id_b", "estimate"],
            )

    return joined.mapInArrow(run, "id_a long, id_b long, estimate double")


class NearDuplicates:
    """Near duplicates among ``df``'s texts.

    Two texts are near duplicates when both have at least ``min_words`` folded words and their
    sets of ``shingle`` consecutive folded words have a Jaccard similarity of ``threshold`` or
    more. Texts with equal sets are one class; the search runs over one text per class.

    ``members``: ``(id, rep)``, a row per text that is long enough, ``rep`` the least id of its class.
    ``links``: ``(id_a, id_b, n_a, n_b, shared, estimate)`` between representatives.

    Null, empty and short texts have no row in either. Rows that repeat an id count once.
    Columns besides the id and the text are ignored, whatever their names. An empty table gives
    empty results. With 64 bands of 4 registers a pair at a similarity of 0.5 is met with
    probability 0.984, at 0.55 with 0.998 and at 0.6 with 0.9999.
    """

    def __init__(self, df: DataFrame, id_col: str, text_col: str, shingle: int = 5, threshold: float = 0.8,
                 min_words: int = 10, band_rows: int = 4):
        texts = df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text")).where("id is not null and text is not null")
        texts = spread(texts)
        self.threshold = threshold
        sigs = scratch(signatures(texts, shingle, min_words), "signatures")
        first = sigs.groupBy("digest").agg(F.min("id").alias("rep"))  # joined, so that a class of any size is spread
        self.members = sigs.select("id", "digest").join(first, "digest").select("id", "rep").distinct()
        sigs = sigs.groupBy("digest").agg(F.min(F.struct("id", "n", "regs")).alias("least")).select("least.*")

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                regs = np.frombuffer(b"".join(part.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
                found = band_keys(regs, band_rows)
                ids = np.repeat(part.column("id").to_numpy(), found.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), pa.array(ids)], ["key", "id"])

        pairs = pairs_within(sigs.select("id", "regs").mapInArrow(keys, "key long, id long")).distinct()
        close = estimated(pairs, sigs, threshold).groupBy("id_a", "id_b").agg(F.max("estimate").alias("estimate"))
        close = scratch(close, "close")
        self.links = scratch(exact_overlap(close, texts, shingle).where(jaccard_at_least(threshold)), "links")

    def pairs(self) -> DataFrame:
        """Every pair ``(id_a, id_b)`` of near duplicates, exact copies among them, ``id_a < id_b``.

        Members of a class meet in blocks, so that a class of any size is spread.
        """
        of = self.members.select(F.col("rep").alias("key"), "id")
        within = pairs_within(of)
        across = expanded(self.links.select("id_a", "id_b", F.struct("id_a", "id_b").alias("link")), of.withColumnRenamed("id", "a"), of.withColumnRenamed("id", "b"))
        return within.union(across.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")))

    def groups(self) -> DataFrame:
        """``(id, group_id, n_links)``: a row per text; links are those of its class to other classes."""
        component = connected_components(self.links.select(F.col("id_a").alias("src"), F.col("id_b").alias("dst")))
        ends = self.links.select(F.explode(F.array("id_a", "id_b")).alias("rep"))
        degree = ends.groupBy("rep").agg(F.count("*").alias("n_links"))
        return (
            self.members.join(component.withColumnRenamed("id", "rep"), "rep", "left").join(degree, "rep", "left")
            .select("id", F.coalesce("component", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
        )


def expected_recall(similarity: float, bands: int = 64, rows: int = 4) -> float:
    return 1 - math.pow(1 - similarity**rows, bands)
