"""Problem 4: evaluation records that also stand in the training split.

Word n-gram hashes of the evaluation records are partitioned together with those of the
training records; a scan for hits gives the pairs that are compared in full, by containment
of the evaluation record in the training record and by Jaccard similarity.

Of a text with ``n`` distinct n-grams only the first ``n - ceil(threshold * n) + 1`` in an order
common to all texts are hashed (prefix filter): two sets that are alike enough always have one
of these in common, whatever the order. Rare ones come first, which a table of counters whose
size is fixed tells; it decides what the search costs and never what it finds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.functions.text import batch_grams, distinct_grams, folded_words, mix64, word_hashes
from lexigrid.llm.shingles import exact_overlap, jaccard_at_least, slices
from lexigrid.llm.sums import SCHEMA, pieces, tree_sum
from lexigrid.operators.blocks import expanded, meet
from lexigrid.session import scratch, spread

CELLS = 1 << 22
_CHUNKS = 64
#: Bits of an n-gram's hash that are kept.
_BITS = 48
#: Texts of a frequent n-gram that meet in one join key.
BLOCK = 512
#: Hits that a pair must have, where its n-grams allow for so many.
HITS = 4


def _cell(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(_BITS - CELLS.bit_length() + 1)).astype(np.int64)


def _kept_bits(grams: np.ndarray) -> np.ndarray:
    return mix64(grams) >> np.uint64(64 - _BITS)


def frequency_table(texts: DataFrame, n: int) -> np.ndarray:
    """How often ``n``-grams of each of ``CELLS`` cells occur in all texts: 16 megabytes, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(CELLS, np.int32)
        for part in slices(batches):
            grams, _ = batch_grams(*word_hashes(part.column("text").to_pylist()), n)
            np.add.at(table, _cell(_kept_bits(grams)), 1)
        yield pieces(table, _CHUNKS)

    total = tree_sum(texts.select("text").mapInArrow(count, SCHEMA), "i4")
    return np.minimum(total, 2**31 - 1).astype(np.int32) if len(total) else np.zeros(CELLS, np.int32)


def prefixes(texts: list[str | None], n: int, thousandths: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams that texts are looked up by, rare ones first; where each text's begin; how many distinct ones it has."""
    hashes, bounds = word_hashes(texts)
    grams, starts = distinct_grams(hashes, bounds, n)
    sizes = np.diff(starts)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    grams = _kept_bits(grams)
    order = np.lexsort((grams, counts[_cell(grams)], owner))
    kept = sizes - (thousandths * sizes + 999) // 1000 + (sizes > 0)
    place = np.arange(len(grams)) - starts[owner]
    edges = np.concatenate([[0], np.cumsum(kept)])
    return grams[order][place < kept[owner]], edges, sizes


def join_keys(grams: np.ndarray, ids: np.ndarray, counts: np.ndarray, typical: int, held: bool) -> tuple[np.ndarray, np.ndarray]:
    """A join key per n-gram, or as many as it has blocks, and the place of its n-gram.

    The texts of a frequent n-gram are dealt to blocks, and every block of evaluation records
    meets every block of training records under a key of their own. A cell holds ``typical``
    n-grams by chance; what is above that may be one n-gram's.
    """
    many = 1 + np.maximum(counts[_cell(grams)].astype(np.int64) - typical, 0) // BLOCK
    at = np.repeat(np.arange(len(grams)), many)
    other = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
    own = (mix64(ids.astype(np.uint64)) % many.astype(np.uint64)).astype(np.int64)[at]
    lo, hi = (own, other) if held else (other, own)
    salted = mix64(grams[at] + mix64((lo << 32 | hi).astype(np.uint64) + np.uint64(1))) >> np.uint64(64 - _BITS)
    return np.where(many[at] > 1, salted, grams[at]).astype(np.int64), at


class SplitOverlap:
    """Pairs of a training record and an evaluation record with the same or nearly the same content.

    ``df`` has ids, texts and titles; ``splits`` is ``(id, split)`` with one row per id, where
    ``split`` is ``train`` or the name of an evaluation split; ids in only one of them are left
    out. Two records are a pair when both texts have at least ``min_words`` folded words and
    their sets of ``shingle`` folded words have a Jaccard similarity of ``threshold`` or more,
    or when both texts are null or shorter and the titles have the same folded words (at least
    one). Null texts are empty ones. Null ids have no rows. Equal texts are searched for once.

    ``pairs``: ``(eval_id, train_id, split, reason, containment, similarity)``; the last two
    are 1 for equal sets and null for titles. Every pair is found, up to collisions of 48-bit
    hashes: hits only rule out pairs that can't be alike enough, whatever their other n-grams.
    """

    def __init__(self, df: DataFrame, splits: DataFrame, id_col: str, text_col: str, title_col: str, shingle: int = 5,
                 threshold: float = 0.8, min_words: int = 10):
        spark = df.sparkSession
        source = df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text"), df[title_col].alias("title")).where("id is not null")
        source = spread(source)
        thousandths = round(threshold * 1000)
        counts = frequency_table(source, shingle)
        sent = spark.sparkContext.broadcast((counts, int(np.median(counts))))

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                hashes, bounds = word_hashes(part.column("text").to_pylist())
                sizes = np.diff(bounds)
                short, sets, b = mix64(hashes), [], bounds
                for k, s in enumerate(sizes):
                    sets.append(hashlib.blake2b(short[b[k] : b[k + 1]].tobytes(), digest_size=12).digest() if s >= min_words else None)
                titles = []
                for s, title in zip(sizes, part.column("title").to_pylist()):
                    name = b" ".join(folded_words(title)) if s < min_words and title else b""
                    titles.append(hashlib.blake2b(name, digest_size=12).digest() if name else None)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.binary()), pa.array(titles, pa.binary())], ["id", "digest", "title_key"])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                grams, edges, sizes = prefixes(part.column("text").to_pylist(), shingle, thousandths, sent.value[0])
                packed = np.ascontiguousarray(grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _BITS // 8])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(sizes, pa.int32()), pa.array([packed[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())], ["id", "n", "grams"]
                )

        def keys(held: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for part in slices(batches):
                    texts = part.column("grams").to_pylist()
                    kept = np.fromiter((len(t) * 8 // _BITS for t in texts), np.int64, len(texts))
                    grams = np.zeros((kept.sum(), 8), np.uint8)
                    grams[:, : _BITS // 8] = np.frombuffer(b"".join(texts), np.uint8).reshape(-1, _BITS // 8)
                    ids = np.repeat(part.column("id").to_numpy(), kept)
                    sizes = np.repeat(part.column("n").to_numpy().astype(np.int64), kept)
                    place = np.arange(len(ids)) - np.repeat(np.cumsum(kept) - kept, kept)
                    key, at = join_keys(grams.view("<u8").ravel(), ids, *sent.value, held)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[at]), pa.array((sizes << 32 | place)[at])], ["gram", "id", "at"])

            return run

        looked = source.mapInArrow(look, "id long, digest binary, title_key binary")
        self.records = scratch(
            looked.where("digest is not null or title_key is not null")
            .join(splits.select(F.col("id").cast("long").alias("id"), "split").where("split is not null"), "id"), "records",
        )
        texts = self.records.where("digest is not null")
        first = texts.groupBy("digest").agg(F.min("id").alias("rep"))  # joined, so that a class of any size is spread
        self.members = scratch(texts.select("id", "split", "digest").join(first, "digest").select("id", "split", "rep"), "members")  # read twelve times
        reps = texts.groupBy("digest").agg(
            F.min("id").alias("id"), F.bool_or(F.expr("split = 'train'")).alias("train"), F.bool_or(F.expr("split <> 'train'")).alias("held")
        )
        grams = source.where("text is not null").select("id", "text").mapInArrow(cut, "id long, n int, grams binary")
        sides = [
            grams.join(reps.where("train" if end == "b" else "held").select("id"), "id").select("id", "n", "grams")
            .mapInArrow(keys(end == "a"), "gram long, id long, at long").select("gram", F.col("id").alias(f"id_{end}"), F.col("at").alias(f"at_{end}"))
            for end in "ab"
        ]
        # of the n-grams that a pair must share, the first ``least_hits`` stand in the first n - must + least_hits of both texts
        hits = (
            sides[0].join(sides[1], "gram").where("id_a <> id_b")
            .withColumns({"n_a": F.expr("at_a >> 32"), "n_b": F.expr("at_b >> 32"), "place_a": F.expr("at_a & 4294967295L"), "place_b": F.expr("at_b & 4294967295L")})
            .where(f"least(n_a, n_b) * 1000L >= {thousandths}L * greatest(n_a, n_b)")
            .withColumn("must", F.expr(f"({thousandths}L * (n_a + n_b) + {999 + thousandths}) div {1000 + thousandths}"))
            .withColumn("least_hits", F.expr(f"least({HITS}, must, must + 1 - ({thousandths}L * greatest(n_a, n_b) + 999) div 1000)"))
            .where("place_a < n_a - must + least_hits and place_b < n_b - must + least_hits")
            .groupBy("id_a", "id_b", F.expr("n_a << 32 | n_b").alias("sizes"), F.expr("must << 3 | least_hits").alias("needs"))
            .agg(F.count("*").alias("hits"), F.max(F.expr("place_a - n_a")).alias("rest_a"), F.max(F.expr("place_b - n_b")).alias("rest_b"))
            # what can still be shared after the last hits
            .where("hits >= needs & 7 and hits + least(-1 - rest_a, -1 - rest_b) >= needs >> 3").select("id_a", "id_b").distinct()
        )
        hits = scratch(hits, "hits")
        compared = exact_overlap(hits, source.where("text is not null").select("id", "text"), shingle)
        self.links = scratch(
            compared.where(jaccard_at_least(threshold)).select(
                "id_a", "id_b", F.expr("shared / n_a").alias("containment"), F.expr("shared / (n_a + n_b - shared)").alias("similarity")
            ), "links",
        )

    @property
    def pairs(self) -> DataFrame:
        # copies of one text, and records of one title, meet in blocks
        evaluation = lambda rows, key: rows.where("split <> 'train'").select(F.col(key).alias("key"), F.struct("id", "split").alias("a"))
        training = lambda rows, key: rows.where("split = 'train'").select(F.col(key).alias("key"), F.col("id").alias("b"))
        measures = ("containment", "similarity")
        columns = [F.col("a.id").alias("eval_id"), F.col("b").alias("train_id"), F.col("a.split").alias("split")]
        link = F.struct("id_a", "id_b", *measures).alias("link")
        near = expanded(self.links.select("id_a", "id_b", link), evaluation(self.members, "rep"), training(self.members, "rep"))
        same = meet(evaluation(self.members, "rep"), training(self.members, "rep"))
        named = self.records.where("title_key is not null")
        titles = meet(evaluation(named, "title_key"), training(named, "title_key"))
        text, title = F.lit("text").alias("reason"), F.lit("title").alias("reason")
        return (
            near.select(*columns, text, *[F.col(f"link.{m}").alias(m) for m in measures])
            .union(same.select(*columns, text, *[F.lit(1.0).alias(m) for m in measures]))
            .union(titles.select(*columns, title, *[F.lit(None).cast("double").alias(m) for m in measures]))
        )


def latest_splits(manifest: DataFrame) -> DataFrame:
    """``(id, split)`` of each article: its non-null row with the latest time, spellings unified."""
    split = F.lower(F.trim(F.regexp_replace("split", r"(?U)^\s+|\s+$", "")))
    return (
        manifest.select("article_id", "assigned_at", F.when(split == "validation", "val").otherwise(split).alias("split"))
        .where("split is not null and article_id is not null")
        .groupBy("article_id").agg(F.max(F.struct("assigned_at", "split")).alias("x")).select(F.col("article_id").alias("id"), "x.split")
    )
