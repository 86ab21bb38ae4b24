"""Problem 7: evaluation items inside a corpus, by latent semantic retrieval.

Documents are read as overlapping passages: blocks of ``BLOCK`` folded words, two neighbouring
blocks to a passage. Passages are TF-IDF vectors over hashed words. A randomised SVD of the
passage matrix A gives the latent space: every task adds up its part of (A'A)W for a fixed
random W; the sum, whose size follows from the parameters alone, holds the leading singular
vectors. Items are read as passages of the same length at every few words; their latent vectors
are kept in cells around centroids. A document's passage looks into the cells nearest to it, and
one with a high enough latent cosine makes document and item a candidate. Only candidates are
checked: by n-gram containment, and, short of that, by their longest common subsequence and by
whether the item's rare words (names, numbers, answers) stand in the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.functions.text import batch_grams, distinct_grams, word_hashes
from lexigrid.llm.shingles import slices
from lexigrid.llm.sums import SCHEMA, pieces, tree_sum
from lexigrid.session import spread

BLOCK, BITS = 8, 13
PASSAGE = 2 * BLOCK
FEATURES = 1 << BITS
RANK, OVERSAMPLED = 96, 112
#: Words between the passages of an item.
ITEM_STEP = 4
#: Power of the inverse frequencies that words are weighted with.
SHARPNESS = 3
#: Passages of items that the centroids are fitted on at most; all are indexed.
FITTED = 20_000
_CHUNKS = 64
_ROWS = 250
#: Blocks that are summed together.
_SLICE = 1024


def features(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.uint16)


def blocks(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each block of each text begins, and which text it is of."""
    sizes = np.diff(bounds)
    counts = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return bounds[:-1][owner] + number * BLOCK, owner


def passages(owner: np.ndarray) -> np.ndarray:
    """First block of each passage: all but a text's last, or its only one."""
    last = np.ones(len(owner), bool)
    last[:-1] = owner[1:] != owner[:-1]
    only = last.copy()
    only[1:] &= owner[1:] != owner[:-1]
    return np.flatnonzero(~last | only)


def block_sums(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, weighted: np.ndarray) -> np.ndarray:
    """Sum of the rows of ``weighted`` over each block's words; its last row, zeros, stands for the words that a block lacks."""
    out = np.empty((len(starts), weighted.shape[1]), np.float32)
    words = np.append(words, np.zeros(BLOCK, words.dtype))
    buffer = np.empty((_SLICE, weighted.shape[1]), np.float32)
    for low in range(0, len(starts), _SLICE):  # what fits near the processor at a time
        some, own = starts[low : low + _SLICE], sizes[low : low + _SLICE]
        total, part = out[low : low + _SLICE], buffer[: len(some)]
        for k in range(BLOCK):
            at = np.where(k < own, words[some + k], FEATURES)
            np.take(weighted, at, axis=0, out=total if k == 0 else part, mode="clip")
            if k:
                total += part
    return out


def passage_vectors(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, owner: np.ndarray, first: np.ndarray, weighted: np.ndarray) -> np.ndarray:
    """Latent vectors of the passages: sums over their words of a basis times the words' weights."""
    if not len(words):
        return np.empty((0, weighted.shape[1]), np.float32)
    sums = block_sums(words, starts, sizes, weighted)
    out = sums[first]
    paired = np.flatnonzero(first + 1 < len(owner))
    paired = paired[owner[first[paired]] == owner[first[paired] + 1]]
    out[paired] += sums[first[paired] + 1]
    return out


def with_zeros(weighted: np.ndarray) -> np.ndarray:
    return np.vstack([weighted, np.zeros((1, weighted.shape[1]))]).astype(np.float32)


def word_weights(texts: DataFrame) -> np.ndarray:
    """Inverse frequency of each hashed word over the blocks of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(FEATURES + _CHUNKS, np.int64)
        for part in slices(batches, _ROWS):
            hashes, bounds = word_hashes(part.column("text").to_pylist())
            starts, owner = blocks(bounds)
            block = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(hashes))))
            table[:FEATURES] += np.bincount(np.unique(block * FEATURES + features(hashes)) % FEATURES, minlength=FEATURES)
            table[FEATURES] += len(starts)
        yield pieces(table, _CHUNKS)

    table = tree_sum(texts.mapInArrow(count, SCHEMA), "i8")
    if not len(table):
        return np.ones(FEATURES, np.float32)
    return np.log((table[FEATURES] + 1) / (table[:FEATURES] + 1)).astype(np.float32) + np.float32(1e-3)


def latent_basis(texts: DataFrame, weight: np.ndarray, seed: int = 11) -> np.ndarray:
    """Leading right singular vectors of the passage matrix, each by its singular value: ``FEATURES`` by ``RANK``.

    Divided by their sizes, the directions of the commonest words don't drown the others.
    """
    test = np.random.default_rng(seed).standard_normal((FEATURES, OVERSAMPLED)).astype(np.float32)
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast((test, weight))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test, weight = sent.value
        weighted = with_zeros(test * weight[:, None])
        total = np.zeros((FEATURES, OVERSAMPLED))
        for part in slices(batches, _ROWS):
            hashes, bounds = word_hashes(part.column("text").to_pylist())
            if not len(hashes):
                continue
            starts, owner = blocks(bounds)
            words, first = features(hashes), passages(owner)
            vectors = passage_vectors(words, starts, np.diff(np.append(starts, len(hashes))), owner, first, weighted)
            of_block = np.zeros((len(starts), OVERSAMPLED), np.float32)
            of_block[first] = vectors
            pair = first[(first + 1 < len(owner))]
            pair = pair[owner[pair] == owner[pair + 1]]
            at = np.searchsorted(first, pair)
            of_block[pair + 1] += vectors[at]
            block = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(hashes))))
            order = np.argsort(words, kind="stable")
            found, at = np.unique(words[order], return_index=True)
            total[found] += np.add.reduceat(of_block[block[order]], at, axis=0) * weight[found, None]
        yield pieces(total.astype(np.float32), _CHUNKS)

    total = tree_sum(texts.mapInArrow(sketch, SCHEMA), "f4")
    sent.unpersist()
    if not len(total) or not total.any():
        return np.zeros((FEATURES, RANK), np.float32)
    y = total.reshape(FEATURES, OVERSAMPLED)
    # A'A is near y (w'y)^-1 y'; a small shift keeps the inverse stable
    shift = 1e-6 * np.linalg.norm(y) / np.sqrt(FEATURES)
    y = y + shift * test
    inner = test.T.astype(np.float64) @ y
    root = np.linalg.cholesky((inner + inner.T) / 2 + 1e-9 * np.trace(inner) / OVERSAMPLED * np.eye(OVERSAMPLED))
    left, size, _ = np.linalg.svd(np.linalg.solve(root, y.T).T, full_matrices=False)
    return (left[:, :RANK] / (size[:RANK] + 1e-9 * size[0])).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)


def centroids(vectors: np.ndarray, cells: int, rounds: int = 6, seed: int = 3) -> np.ndarray:
    """Directions that unit vectors gather around, by spherical k-means on ``FITTED`` of them at most."""
    rng = np.random.default_rng(seed)
    some = vectors[rng.permutation(len(vectors))[:FITTED]]
    middle = some[:cells].copy()
    for _ in range(rounds):
        near = (some @ middle.T).argmax(axis=1)
        sums = np.zeros_like(middle)
        np.add.at(sums, near, some)
        used = np.bincount(near, minlength=len(middle)) > 0
        middle[used] = unit(sums[used])
    return middle


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two arrays."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0)))
    return int(row[-1])


class ItemIndex:
    """What every task needs of some items: their n-grams and their passages' vectors by cells."""

    def __init__(self, ids: list, texts: list, shingle: int, weighted: np.ndarray):
        self.ids = np.array(ids)
        self.hashes, self.bounds = word_hashes(texts)
        sizes = np.diff(self.bounds)
        counts = np.where(sizes > 0, np.maximum(-(-(sizes - PASSAGE) // ITEM_STEP), 0) + 1, 0)
        of = np.repeat(np.arange(len(ids)), counts)
        number = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = self.bounds[:-1][of] + np.minimum(number * ITEM_STEP, np.maximum(sizes[of] - PASSAGE, 0))
        upto = np.concatenate([np.zeros((1, weighted.shape[1])), np.cumsum(weighted[features(self.hashes)], axis=0, dtype=np.float64)])
        vectors = unit((upto[np.minimum(begin + PASSAGE, self.bounds[1:][of])] - upto[begin]).astype(np.float32))
        self.centroids = centroids(vectors, max(1, round(len(vectors) ** 0.5)))
        cell = (vectors @ self.centroids.T).argmax(axis=1) if len(vectors) else np.empty(0, np.int64)
        order = np.argsort(cell, kind="stable")
        self.vectors, self.of = vectors[order], of[order]
        self.cells = np.searchsorted(cell[order], np.arange(len(self.centroids) + 1))
        grams, bounds = distinct_grams(self.hashes, self.bounds, shingle)
        order = np.argsort(grams, kind="stable")
        self.grams, self.gram_item = grams[order], np.repeat(np.arange(len(ids)), np.diff(bounds))[order]
        self.known, self.n_grams = np.unique(grams), np.diff(bounds)

    def near(self, vectors: np.ndarray, probed: float, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs ``(vector, item, cosine)`` of at least that cosine, in the ``probed`` share of the cells nearest to each vector."""
        if not len(vectors) or not len(self.vectors):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
        close = vectors @ self.centroids.T
        n = min(close.shape[1], max(4, int(np.ceil(probed * close.shape[1]))))
        least = -np.partition(-close, n - 1, axis=1)[:, n - 1]
        rows, items, scores = [], [], []
        for k in range(close.shape[1]):
            low, high = self.cells[k], self.cells[k + 1]
            some = np.flatnonzero(close[:, k] >= least)
            if low == high or not len(some):
                continue
            score = vectors[some] @ self.vectors[low:high].T
            hit, at = np.nonzero(score >= cosine)
            rows.append(some[hit])
            items.append(self.of[low:high][at])
            scores.append(score[hit, at])
        if not rows:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
        return np.concatenate(rows), np.concatenate(items), np.concatenate(scores)


def candidates(hashes: np.ndarray, bounds: np.ndarray, index: ItemIndex, weighted: np.ndarray, probed: float, cosine: float) -> tuple[np.ndarray, ...]:
    """Candidate pairs of a batch of texts: text, item, best cosine, and the word that the best passage begins with."""
    starts, owner = blocks(bounds)
    first = passages(owner)
    words, sizes = features(hashes), np.diff(np.append(starts, len(hashes)))
    found = []
    for low in range(0, len(first), 4000):  # a part of the passages at a time, however long a text is
        some = first[low : low + 4000]
        a, b = some[0], min(some[-1] + 2, len(starts))
        vectors = unit(passage_vectors(words[starts[a] : starts[b - 1] + sizes[b - 1]], starts[a:b] - starts[a], sizes[a:b], owner[a:b], some - a, weighted))
        row, item, score = index.near(vectors, probed, cosine)
        found.append((owner[some[row]], item, score, starts[some[row]]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32), np.empty(0, np.int64)
    doc, item, score, at = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((at, -score, item, doc))
    doc, item, score, at = doc[order], item[order], score[order], at[order]
    best = np.ones(len(doc), bool)
    best[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    return doc[best], item[best], score[best], at[best]


def checked(hashes: np.ndarray, bounds: np.ndarray, index: ItemIndex, pairs: tuple[np.ndarray, ...], weight: np.ndarray, shingle: int, enough: float, near: float, least: float, rare: float) -> tuple[np.ndarray, ...]:
    """Containment of the item in the document for each candidate; where that isn't ``enough`` and the cosine ``near``, common subsequence and answer words.

    The latter are left out where too few of the item's words occur for a subsequence of ``least`` of them.
    """
    doc, item, score, at = pairs
    wanted = np.unique(doc)
    sizes = np.diff(bounds)[wanted]
    word = np.repeat(bounds[:-1][wanted], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    grams, owner = batch_grams(hashes[word], np.concatenate([[0], np.cumsum(sizes)]), shingle)
    lcs, answer = np.full(len(doc), np.nan), np.full(len(doc), np.nan)
    # n-grams of candidate documents that any item has, each once, and the candidates among their items
    known = index.known
    place = np.minimum(np.searchsorted(known, grams), max(len(known) - 1, 0))
    inside = known[place] == grams if len(known) else np.zeros(len(grams), bool)
    own = np.unique(owner[inside] * max(len(known), 1) + place[inside])
    gram = known[own % len(known)] if len(own) else np.empty(0, np.uint64)
    low, high = np.searchsorted(index.grams, gram), np.searchsorted(index.grams, gram, "right")
    some = np.repeat(np.arange(len(own)), high - low)
    there = index.gram_item[low[some] + np.arange(len(some)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)]
    n = len(index.ids)
    key = wanted[own[some] // max(len(known), 1)] * n + there
    pair = doc * n + item  # in ascending order
    to = np.minimum(np.searchsorted(pair, key), max(len(pair) - 1, 0))
    shared = np.bincount(to[pair[to] == key] if len(pair) else to[:0], minlength=len(pair))
    contained = shared / np.maximum(index.n_grams[item], 1)
    for k in np.flatnonzero((contained < enough) & (score >= near)):
        asked = index.hashes[index.bounds[item[k]] : index.bounds[item[k] + 1]]
        low, high = bounds[doc[k]], bounds[doc[k] + 1]
        # the item may begin and end anywhere around the passage that met it
        around = hashes[max(low, at[k] - len(asked)) : min(high, at[k] + PASSAGE + len(asked))]
        there = set(around.tolist())
        if sum(x in there for x in asked.tolist()) < least * len(asked):
            continue
        lcs[k] = common_subsequence(asked, around) / len(asked)
        said = np.unique(asked[weight[features(asked)] >= rare])
        answer[k] = np.isin(said, hashes[low:high]).mean() if len(said) else np.nan
    return contained, lcs, answer


def leaks(documents: DataFrame, benchmark: DataFrame, doc_col: str, text_col: str, item_col: str, item_text_col: str, shingle: int = 5,
          containment: float = 0.4, cosine: float = 0.65, probed: float = 0.1, near: float = 0.8, lcs: float = 0.6, part_words: int = 1_000_000,
          rare_share_inverse: float = 100) -> DataFrame:
    """Documents that carry evaluation items, fully or in part.

    ``(doc_id, item_id, kind, cosine, containment, lcs, answer)``. A candidate is a pair with a
    passage of ``PASSAGE`` words each whose latent cosine is at least ``cosine``, met in the
    ``probed`` share of the cells nearest to the document's passage. ``kind`` is ``full`` or
    ``partial`` when all or at least ``containment`` of the item's distinct ``shingle``-grams
    of folded words stand in the document; else ``paraphrase`` when the cosine is ``near`` or more,
    the item has a common subsequence of ``lcs`` of its words with the text around the
    passage, and half of its rare words (in less than one block in ``rare_share_inverse``)
    stand in the document. Documents are scanned once for every ``part_words`` words of items.

    ``lcs`` and ``answer`` are null where they weren't looked at. Null and empty texts have no words and match nothing, and so do items of fewer words than
    a shingle (but for paraphrases). Repeated rows give repeated rows. Columns besides the
    named ones are ignored.
    """
    texts = documents.select(documents[doc_col].cast("long").alias("doc_id"), documents[text_col].alias("text")).where("doc_id is not null and text is not null")
    texts = spread(texts)
    asked = benchmark.select(benchmark[item_col].cast("long").alias("item_id"), benchmark[item_text_col].alias("text")).where("item_id is not null and text is not null")
    spark = documents.sparkSession
    weight = word_weights(texts.select("text"))
    sharp = weight**SHARPNESS
    weighted = with_zeros(latent_basis(texts.select("text"), sharp) * sharp[:, None])
    rare = float(np.log(rare_share_inverse))
    schema = "doc_id long, item_id long, cosine float, containment double, lcs double, answer double"
    parts = max(1, -(-(asked.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0) // part_words))
    out = spark.createDataFrame([], schema)
    for k in range(parts):
        rows = asked.where(F.expr(f"pmod(xxhash64(item_id), {parts}) = {k}")).orderBy("item_id").collect()
        if not rows:
            continue
        sent = spark.sparkContext.broadcast((ItemIndex([r.item_id for r in rows], [r.text for r in rows], shingle, weighted), weighted, weight))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index, weighted, weight = sent.value
            for part in slices(batches, _ROWS):
                hashes, bounds = word_hashes(part.column("text").to_pylist())
                pairs = candidates(hashes, bounds, index, weighted, probed, cosine)
                values = checked(hashes, bounds, index, pairs, weight, shingle, containment, near, lcs, rare)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(pairs[0])), pa.array(index.ids[pairs[1]], pa.int64()), pa.array(pairs[2], pa.float32()),
                     *[pa.array(v, pa.float64(), from_pandas=True) for v in values]],
                    ["doc_id", "item_id", "cosine", "containment", "lcs", "answer"],
                )

        out = out.union(texts.mapInArrow(search, schema))
    kind = F.expr(
        f"case when containment >= 1 then 'full' when containment >= {containment} then 'partial' "
        f"when cosine >= {near} and lcs >= {lcs} and coalesce(answer, 0) >= 0.5 then 'paraphrase' end"
    )
    return out.withColumn("kind", kind).where("kind is not null").select("doc_id", "item_id", "kind", "cosine", "containment", "lcs", "answer")
