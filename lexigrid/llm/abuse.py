"""Problem 8: abusive, hateful or sexually explicit text.

A linear classifier over character n-grams of sentences whose features are scaled by naive
Bayes log-count ratios: how much more frequent an n-gram is in offending sentences than in the
whole corpus, counted by Spark over all documents. The classifier is fitted on a bounded sample
of labelled documents, which lies in ``PARTS`` parts: every pass takes gradient steps on each
part in a task of its own, and the driver gets the weights that they moved, to average them.
Labels are of documents, so the sentences that carry them are found while fitting; a document's
score is that of its worst sentence.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.shingles import slices
from lexigrid.llm.sums import SCHEMA, pieces, tree_sum
from lexigrid.session import scratch, spread

ORDERS = (3, 4, 5)
BITS = 20
BUCKETS = 1 << BITS
#: A factor for the n-grams of each order, whose products' first bits are their buckets.
_ODD = np.random.default_rng(31).integers(2**62, 2**63, max(ORDERS) + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNKS = 64
_ROWS = 250
#: Parts of the sample at most, and documents of a part at least; a model doesn't depend on the cluster.
PARTS, PART_ROWS = 12, 400

# Characters used in place of letters inside words.
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "€": "e"}
_LOOKALIKES = str.maketrans("асеорхуіјѕԁԛһ", "aceopxyijsdqh")

_HIDDEN = re.compile("[\xad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_SPELLED = re.compile(r"(?<![^\W_])[^\W\d_](?:([.\-_*·])[^\W\d_])(?:\1[^\W\d_])+(?![^\W_])")
_SWAPPED = re.compile(r"(?<=[^\W\d_])[01345780@$!€]+(?=[^\W\d_])|(?<![^\W_])[@$](?=[^\W\d_])")
_RUN = re.compile(r"(.)\1+")
_NUMBER = re.compile(r"\d[\d.,]*")
# Names of markup tags that are no words of the text.
_NAMES = "a|b|i|u|p|br|hr|em|strong|small|span|div|sub|sup|ref|ul|ol|li|table|tr|td|th|code|pre|blockquote|h1|h2|h3|h4|h5|h6"
_TAG = re.compile(rf"</?(?:{_NAMES})/?>")
_END = re.compile(rf"[.!?。！？…]+[\"')\]}}»”’*_]*(?:</?(?:{_NAMES})/?>)*$")
_PART = re.compile(r"[^\W_]+(?:[*'#][^\W_]+)*|[\"“”„«»]")

#: Marks in normalised tokens, which have letters, digits and quotes only: after it a sentence ends, a single letter follows, nothing is left.
_ENDS, _LETTER, _NOTHING = "\0\1\2"
#: Tokens that hold nothing to undo but repeated letters.
_PLAIN = re.compile("([a-z]+)([,;:.!?]?)")
_SPACED = re.compile(f"{_LETTER}. {_LETTER}. {_LETTER}. (?:{_LETTER}. )+")


class Tokens(dict):
    """Normalised form of each raw token with its blank and its mark, remembered per task."""

    def __missing__(self, raw: str) -> str:
        if len(self) > 300_000:
            self.clear()
        if plain := _PLAIN.fullmatch(raw):
            word, mark = plain.groups()
            word = _RUN.sub(r"\1", word)
            ends = mark in ("!", "?") or mark == "." and len(raw) > 3
            found = self[raw] = f"{_LETTER * (len(word) == 1 and not ends)}{word} {_ENDS * ends}"
            return found
        token = raw
        if not raw.isascii():
            token = "".join(c for c in _HIDDEN.sub("", raw) if not unicodedata.combining(c))
            if any("a" <= c <= "z" for c in token):
                token = token.translate(_LOOKALIKES)
        ends = bool(_END.search(token)) and not (token.endswith(".") and len(token) <= 3)
        token = _TAG.sub(" ", token)
        token = _SPELLED.sub(lambda m: m.group().replace(m.group(1), ""), token)
        token = _SWAPPED.sub(lambda m: "".join(_DIGITS.get(c, c) for c in m.group()), token)
        parts = [_RUN.sub(r"\1", p) for p in _PART.findall(_NUMBER.sub("0", token))]
        letter = not ends and len(parts) == 1 and len(parts[0]) == 1 and parts[0].isalpha()
        word = f"{' '.join(parts)} " if parts else _NOTHING
        found = self[raw] = f"{_LETTER * letter}{word}{_ENDS * ends}"
        return found


def sentences(text: str, tokens: Tokens) -> list[str]:
    """Sentences of a text as normalised tokens with blanks around them.

    Hidden characters, accents, stretched and spaced letters, digits and look-alikes in place
    of letters are undone. A sentence ends with its mark or an empty line. Tokens are looked up
    and joined without a step of Python for each.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    out: list[str] = []
    for block in text.lower().split("\n\n"):
        words = "".join(map(tokens.__getitem__, block.split()))
        if _LETTER in words:
            if words.count(_LETTER) > 3:
                words = _SPACED.sub(lambda m: m.group()[1::3] + " ", words)
            words = words.replace(_LETTER, "")
        if _NOTHING in words:
            words = words.replace(_NOTHING, "")
        out += [f" {s}" for s in words.split(_ENDS) if s]
    return out


def sentence_features(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of a list of sentences, and the sentence of each."""
    if not parts:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends, each = np.cumsum(lengths[lengths > 0]), np.arange(len(parts))
    buckets, owners = [], []
    rolled = codes.copy()
    inside = np.ones(len(codes), bool)
    for n in range(2, max(ORDERS) + 1):
        if len(codes) < n:
            break
        rolled = rolled[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
        inside[np.maximum(ends - n + 1, 0)] = False  # these and later ones reach into the next sentence
        if n in ORDERS:
            buckets.append((rolled * _ODD[n] >> np.uint64(64 - BITS)).astype(np.int32)[inside[: len(rolled)]])
            owners.append(np.repeat(each, np.maximum(lengths - n + 1, 0)))
    if not buckets:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


def document_labels(labels: DataFrame) -> DataFrame:
    """``(doc_id, offends)`` by majority of the annotators; ties and null categories have no row."""
    votes = labels.where("doc_id is not null and category is not null").groupBy("doc_id").agg(
        F.sum(F.when(F.lower(F.trim("category")) == "none", -1).otherwise(1)).alias("votes")
    )
    return votes.where("votes <> 0").select("doc_id", F.expr("votes > 0").alias("offends"))


def _table_sum(rows: DataFrame, extract: Callable, columns: list[str], tables: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Sums of bucket counts over all rows, and of how many units were counted, for each table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, units, tokens = np.zeros((tables, BUCKETS), np.int64), np.zeros(tables, np.int64), Tokens()
        for part in slices(batches, _ROWS):
            units += extract(part, tokens, total)
        yield pieces(np.append(total.ravel(), np.repeat(units, _CHUNKS)), _CHUNKS)

    found = tree_sum(rows.select(*columns).mapInArrow(count, SCHEMA), "i8")
    if not len(found):
        return np.zeros((tables, BUCKETS), np.int64), np.zeros(tables, np.int64)
    return found[: tables * BUCKETS].reshape(tables, BUCKETS), found[tables * BUCKETS :: _CHUNKS]


def corpus_counts(documents: DataFrame) -> tuple[np.ndarray, int]:
    """How often each bucket occurs in all documents, and how many sentences they have."""

    def extract(part: pa.RecordBatch, tokens: Tokens, total: np.ndarray) -> int:
        flat = [s for t in part.column("text").to_pylist() if t for s in sentences(t, tokens)]
        for low in range(0, len(flat), 4000):
            total[0] += np.bincount(sentence_features(flat[low : low + 4000])[0], minlength=BUCKETS)
        return len(flat)

    counts, units = _table_sum(spread(documents), extract, ["text"])
    return counts[0], int(units[0])


def labelled_sentences(documents: DataFrame, labels: DataFrame, folds: int) -> DataFrame:
    """``(doc_id, offends, fold, sentences)`` of the labelled documents with a text, normalised once for all that follows."""
    fold = F.expr(f"cast(pmod(xxhash64(doc_id, 'fold'), {folds}) as int)").alias("fold")
    texts = spread(documents.select("doc_id", "text").where("text is not null"))
    rows = texts.join(document_labels(labels), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "offends", fold)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for part in slices(batches, _ROWS):
            found = pa.array([sentences(t, tokens) for t in part.column("text").to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("offends"), part.column("fold"), found], ["doc_id", "offends", "fold", "sentences"])

    return rows.mapInArrow(cut, "doc_id long, offends boolean, fold int, sentences array<string>")


def _features_of(part: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Sentences of a batch of labelled documents, the document of each, and their buckets and owners."""
    per = part.column("sentences").to_pylist()
    flat = [s for p in per for s in p]
    return flat, np.repeat(np.arange(len(per)), [len(p) for p in per]), *sentence_features(flat)


def offending_counts(labelled: DataFrame, folds: int) -> tuple[np.ndarray, np.ndarray]:
    """In how many documents of each fold labelled as offending each bucket occurs, and how many there are."""

    def extract(part: pa.RecordBatch, tokens: Tokens, total: np.ndarray) -> np.ndarray:
        own = part.column("fold").to_numpy()
        _, doc, buckets, owner = _features_of(part)
        found = np.unique(doc[owner] * BUCKETS + buckets)
        for k in range(folds):
            total[k] += np.bincount(found[own[found // BUCKETS] == k] % BUCKETS, minlength=BUCKETS)
        return np.bincount(own, minlength=folds)

    return _table_sum(labelled.where("offends"), extract, ["sentences", "fold"], folds)


def sentence_counts(labelled: DataFrame, models: list[Turn]) -> tuple[np.ndarray, np.ndarray]:
    """For each model, in how many distinct offending sentences of all labelled documents each bucket occurs, and how many there are.

    Offending are the sentences of offending documents that score above the model's limit, or
    each document's worst one where there is none. Model ``k`` leaves fold ``k`` out.
    """
    sent = labelled.sparkSession.sparkContext.broadcast(models)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = [m.dense() for m in sent.value]
        for part in slices(batches, _ROWS):
            flat, doc, buckets, owner = _features_of(part)
            fold = part.column("fold").to_numpy()[doc]
            size = np.bincount(owner, minlength=len(flat))
            mask = np.zeros(len(flat), np.int64)
            for k, m in enumerate(sent.value):
                mask |= (m.positive(m.logits(dense[k], buckets, owner, size), doc, part.num_rows) & (fold != k)).astype(np.int64) << k
            chosen = np.flatnonzero(mask)
            yield pa.RecordBatch.from_arrays([pa.array([flat[j] for j in chosen], pa.string()), pa.array(mask[chosen])], ["sentence", "mask"])

    def extract(part: pa.RecordBatch, tokens: Tokens, total: np.ndarray) -> np.ndarray:
        mask = part.column("mask").to_numpy()
        buckets, owner = sentence_features(part.column("sentence").to_pylist())
        own = np.unique(owner * BUCKETS + buckets)
        has = mask[:, None] >> np.arange(len(total)) & 1
        for k in range(len(total)):
            total[k] += np.bincount(own[has[own // BUCKETS, k] > 0] % BUCKETS, minlength=BUCKETS)
        return has.sum(axis=0)

    found = labelled.where("offends").select("sentences", "fold").mapInArrow(choose, "sentence string, mask long")
    return _table_sum(found.groupBy("sentence").agg(F.bit_or("mask").alias("mask")), extract, ["sentence", "mask"], len(models))


def log_ratios(bad: np.ndarray, n_bad: int, corpus: np.ndarray, n_corpus: int, prior: float = 10.0) -> np.ndarray:
    """Log-count ratios of ``bad`` to the corpus, drawn towards 0 by ``prior`` units like the corpus.

    Only n-grams whose excess is more standard errors than chance gives among so many units are
    evidence; those that are missing although frequent in the corpus are evidence against.
    """
    rate = (corpus + 1.0) / (n_corpus + 1.0)
    expected = n_bad * rate
    ratio = np.log((bad + prior * rate) / (expected + prior * rate))
    excess = (bad - expected) / np.sqrt(expected + 1)
    limit = 1 + 0.8 * np.log10(max(n_bad, 10))
    useful = ((bad >= 3) & (excess >= limit) & (ratio > 0.7)) | ((expected >= 3) & (ratio < -0.7))
    return np.where(useful, np.clip(ratio, -4, 6), 0).astype(np.float32)


class Classifier:
    """Weights per bucket, a bias and a threshold for the worst sentence's score."""

    def __init__(self) -> None:
        self.weight, self.bias, self.threshold = np.zeros(BUCKETS, np.float32), -10.0, 0.0

    def scores(self, parts: list[str]) -> np.ndarray:
        buckets, owner = sentence_features(parts)
        return np.bincount(owner, self.weight[buckets], len(parts)) + self.bias


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Turn:
    """What a turn of the fit starts from: a model's weights, and which sentences they make offending.

    Weights are kept by bucket, sparse. ``limit`` is NaN where only each document's worst
    sentence counts; ``by_length`` divides scores by the root of a sentence's number of n-grams.
    """

    def __init__(self, index: np.ndarray, value: np.ndarray, bias: float, by_length: bool):
        self.index, self.value, self.bias, self.by_length = index.astype(np.int32), value.astype(np.float32), bias, by_length
        self.limit, self.least = 0.0, 0.0

    def dense(self) -> np.ndarray:
        out = np.zeros(BUCKETS, np.float32)
        out[self.index] = self.value
        return out

    def logits(self, weight: np.ndarray, buckets: np.ndarray, owner: np.ndarray, size: np.ndarray) -> np.ndarray:
        z = np.bincount(owner, weight[buckets], len(size)) + self.bias
        return z / np.sqrt(np.maximum(size, 1)) if self.by_length else z

    def positive(self, z: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        return z >= worst(z, doc, n_docs)[doc] if np.isnan(self.limit) else z > self.limit

    def settle(self, score: np.ndarray, y: np.ndarray, used: np.ndarray) -> None:
        """Limits from the worst sentences' scores of the documents: above nearly all harmless ones' is offending."""
        harmless = score[used & ~y]
        self.limit = self.least = float(np.quantile(harmless, 0.96)) if len(harmless) else 0.0
        if not (score[used & y] > self.limit).any():
            self.limit = np.nan


def worst(z: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    out = np.full(n_docs, -99.0)
    np.maximum.at(out, doc, z)
    return out


class Bag:
    """The sample: sentences of labelled documents and their features, in ``PARTS`` rows of a written table."""

    def __init__(self, labelled: DataFrame, sample: int):
        key = F.xxhash64("doc_id")
        cut, n = labelled.select(key.alias("key")).orderBy("key").limit(sample).agg(F.max("key"), F.count("*")).first()
        parts = max(1, min(PARTS, n // PART_ROWS))

        def gather(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("doc_id", kind="stable")
            sizes, lengths, buckets = [], [], []
            for low in range(0, len(group), 100):
                per = [list(p) for p in group["sentences"].iloc[low : low + 100]]
                flat = [s for p in per for s in p]
                found, owner = sentence_features(flat)
                sizes += [len(p) for p in per]
                lengths.append(np.bincount(owner, minlength=len(flat)))
                buckets.append(found[np.argsort(owner, kind="stable")])
            columns = {
                "docs": np.array(sizes), "lengths": np.concatenate(lengths), "buckets": np.concatenate(buckets),
                "fold": group["fold"].to_numpy(), "bad": group["offends"].to_numpy(),
            }
            return pd.DataFrame({"part": group["part"].iloc[:1].to_numpy()} | {name: [c.astype(np.int32).tobytes()] for name, c in columns.items()})

        rows = labelled.where(key <= cut) if cut is not None else labelled.limit(0)
        rows = rows.withColumn("part", F.expr(f"cast(pmod(xxhash64(doc_id, 'part'), {parts}) as int)"))
        schema = "part int, docs binary, lengths binary, buckets binary, fold binary, bad binary"
        self.rows = scratch(rows.groupBy("part").applyInPandas(gather, schema), "bag")

    def run(self, step: Callable[[Part], list[tuple]], schema: str) -> list:
        """Rows ``(part, ...)`` of a function of each part, in order of parts."""
        names = [c.split()[0] for c in schema.split(", ")]

        def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for row in frame.itertuples(index=False):
                    yield pd.DataFrame([(row.part, *r) for r in step(Part(row))], columns=["part", *names])

        return sorted(self.rows.mapInPandas(each, f"part int, {schema}").collect())

    def labels(self) -> tuple[np.ndarray, np.ndarray]:
        """Fold and label of each document of the sample."""
        rows = self.rows.select("part", "fold", "bad").orderBy("part").collect()
        join = lambda name: np.frombuffer(b"".join(r[name] for r in rows), np.int32)
        return join("fold"), join("bad") > 0

    def scores(self, models: list[Turn]) -> np.ndarray:
        """Worst sentence's score of each document by each model: as many numbers as the sample has documents."""
        sent = self.rows.sparkSession.sparkContext.broadcast(models)

        def step(part: Part) -> list[tuple]:
            return [(k, worst(z, part.doc, part.n_docs).astype(np.float32).tobytes()) for k, z in enumerate(part.logits(sent.value))]

        rows = self.run(step, "model int, score binary")
        return np.array([np.frombuffer(b"".join(r.score for r in rows if r.model == k), np.float32) for k in range(len(models))])


class Part:
    """A part of the sample inside a task."""

    def __init__(self, row):
        docs, self.size, self.bucket, self.fold, bad = (np.frombuffer(getattr(row, c), np.int32) for c in ("docs", "lengths", "buckets", "fold", "bad"))
        self.n_docs, self.bad = len(docs), bad > 0
        self.doc = np.repeat(np.arange(len(docs)), docs)

    def logits(self, turns: list[Turn]) -> np.ndarray:
        """Scores of all sentences, a row for each model."""
        weight = np.zeros((BUCKETS, len(turns)), np.float32)
        for k, t in enumerate(turns):
            weight[t.index, k] = t.value
        out = np.zeros((len(self.size), len(turns)))
        some = np.flatnonzero(self.size)
        if len(some):
            edges = np.cumsum(self.size) - self.size
            out[some] = np.add.reduceat(weight[self.bucket], edges[some], axis=0)
        for k, t in enumerate(turns):
            out[:, k] += t.bias
            if t.by_length:
                out[:, k] /= np.sqrt(np.maximum(self.size, 1))
        return out.T

    def useful(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """N-grams that have a place, and the sentence of each."""
        at = place[self.bucket]
        some = at >= 0
        return at[some], np.repeat(np.arange(len(self.size)), self.size)[some]


class Weights:
    """A model's adaptive steps over the useful n-grams: position, what it moved so far, and the bias."""

    def __init__(self, n: int):
        self.v, self.speed, self.bias, self.speed_b = np.full(n, 0.1, np.float32), np.full(n, 1e-3, np.float32), -1.0, 1e-3


def local_steps(part: Part, turn: Turn, z: np.ndarray, useful: tuple[np.ndarray, np.ndarray], fold_out: int, first: bool, ratio: np.ndarray, w: Weights, full: bool, seed: int, epochs: int, l2: float = 3e-4, batch: int = 128) -> tuple:
    """Logistic regression on a part's features times their ratios, by adaptive gradient steps.

    Gives the n-grams that were moved, how often, where to, and the squares of their slopes;
    the bias, its squares and the steps taken.
    """
    used, bad = (part.fold != fold_out)[part.doc], part.bad[part.doc]
    target = bad & turn.positive(z, part.doc, part.n_docs)
    rows = np.flatnonzero(used & (target | (~bad & ((z < 2 * abs(turn.least) + turn.least) | first))))
    feature, owner = useful
    some = ratio[feature] != 0
    feature, owner = feature[some], owner[some]
    edge = np.searchsorted(owner, np.arange(len(part.size) + 1))
    v, speed, bias, speed_b, steps = w.v.copy(), w.speed.copy(), w.bias, w.speed_b, 0
    moved = np.zeros(len(v), np.float32)
    rng = np.random.default_rng(seed)
    share = max(float(target[rows].mean()), 1e-4) if len(rows) else 1.0
    gain = np.where(target, min(0.25 / share, 20.0), 1.0).astype(np.float32)
    for k in range(epochs):
        if full and k == 0:
            chosen = rows.copy()
        else:  # every positive, the harmless that aren't clearly so, and a tenth of the rest
            now = (np.bincount(owner, (v * ratio)[feature], len(part.size)) + bias)[rows]
            chosen = rows[target[rows] | (now > -3) | (rng.random(len(rows)) < 0.1)]
        rng.shuffle(chosen)
        for low in range(0, len(chosen), batch):
            some = chosen[low : low + batch]
            sizes = edge[some + 1] - edge[some]
            b = feature[np.repeat(edge[some], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
            o, x = np.repeat(np.arange(len(some)), sizes), ratio[b]
            error = (_sigmoid(np.bincount(o, v[b] * x, len(some)) + bias) - target[some]) * gain[some]
            touched, inverse = np.unique(b, return_inverse=True)
            slope = np.bincount(inverse, error[o] * x, len(touched)) / len(some) + l2 * v[touched]
            speed[touched] += slope * slope
            v[touched] -= 0.1 * slope / np.sqrt(speed[touched])
            moved[touched] += 1
            slope_b = error.mean()
            speed_b += slope_b * slope_b
            bias -= 0.1 * slope_b / speed_b**0.5
            steps += 1
    index = np.flatnonzero(moved)
    pack = lambda x: x[index].astype(np.float32).tobytes()
    return index.astype(np.int32).tobytes(), pack(moved), pack(v), pack(speed - w.speed), float(bias), float(speed_b - w.speed_b), steps


def averaged(w: Weights, rows: list) -> Weights:
    """Weights after a pass: each n-gram's mean over the parts that moved it, by how often they did."""
    n, total, speed = np.zeros(len(w.v)), np.zeros(len(w.v)), w.speed.astype(np.float64)
    for r in rows:
        index = np.frombuffer(r.at, np.int32)
        moved = np.frombuffer(r.moved, np.float32)
        n[index] += moved
        total[index] += moved * np.frombuffer(r.v, np.float32)
        speed[index] += np.frombuffer(r.speed, np.float32)
    out = Weights(0)
    out.v = np.where(n > 0, total / np.maximum(n, 1), w.v).astype(np.float32)
    out.speed = speed.astype(np.float32)
    steps = sum(r.steps for r in rows)
    out.bias = sum(r.bias * r.steps for r in rows) / steps if steps else w.bias
    out.speed_b = w.speed_b + sum(r.speed_b for r in rows)
    return out


def fitted(labelled: DataFrame, bag: Bag, starts: list[np.ndarray], corpus: np.ndarray, n_corpus: int, rounds: int = 4, passes: int = 1, epochs: int = 4) -> list[Turn]:
    """Find the offending sentences of offending documents and fit on them, in turns; model ``k`` leaves fold ``k`` out.

    Sentences of offending documents are positive when they score above nearly all harmless
    documents' worst; documents without such a one are held to be mislabelled and left out. In
    every turn the n-grams' ratios are counted anew, in the offending sentences of all labels.
    """
    fold, y = bag.labels()
    models = [Turn(np.flatnonzero(s), s[s != 0], 0.0, True) for s in starts]
    sc = labelled.sparkSession.sparkContext
    for k in range(rounds):
        scores = bag.scores(models)
        for j, m in enumerate(models):
            m.settle(scores[j], y, fold != j)
        counts, n_counted = sentence_counts(labelled, models)
        ratios = [log_ratios(c, int(n), corpus, n_corpus) for c, n in zip(counts, n_counted)]
        useful = np.flatnonzero(np.any([r != 0 for r in ratios], axis=0))
        ratios = [r[useful] for r in ratios]
        weights = [Weights(len(useful)) for _ in models]
        for turn in range(passes):
            sent = sc.broadcast((models, useful, ratios, weights))

            def step(part: Part, sent=sent, k=k, turn=turn) -> list[tuple]:
                models, useful, ratios, weights = sent.value
                place = np.full(BUCKETS, -1, np.int32)
                place[useful] = np.arange(len(useful))
                z, own = part.logits(models), part.useful(place)
                return [(j, *local_steps(part, m, z[j], own, j, k == 0, ratios[j], weights[j], turn == 0, 100 * k + turn, epochs)) for j, m in enumerate(models)]

            rows = bag.run(step, "model int, at binary, moved binary, v binary, speed binary, bias double, speed_b double, steps int")
            weights = [averaged(w, [r for r in rows if r.model == j]) for j, w in enumerate(weights)]
            sent.unpersist()
        models = [Turn(useful, w.v * r, w.bias, False) for w, r in zip(weights, ratios)]
    return models


def _best_threshold(score: np.ndarray, y: np.ndarray, weight_of_good: float) -> float:
    """Least score to flag, by the best F1."""
    order = np.argsort(-score)
    hit = np.cumsum(y[order])
    flagged = hit + weight_of_good * np.cumsum(~y[order])
    best = int((2 * hit / (flagged + max(y.sum(), 1))).argmax())
    following = score[order[best + 1]] if best + 1 < len(y) else score[order[best]] - 1
    return float((score[order[best]] + following) / 2)


def train(documents: DataFrame, labels: DataFrame, sample: int = 6_000, folds: int = 2, weight_of_good: float = 4.0) -> Classifier:
    """Fit on ``documents`` ``(doc_id, text)`` and ``labels`` ``(doc_id, category)``.

    Counts and the ratios made of them cover every document and every label; the regression takes
    at most ``sample`` labelled documents, the least by a hash of their ids. The threshold has the best F1 over
    documents scored by models fitted without them, where a document labelled as harmless
    stands for ``weight_of_good``, since offending ones are labelled more often. Without
    labels of both kinds nothing is flagged.
    """
    labelled = scratch(labelled_sentences(documents, labels, folds), "labelled")
    bag = Bag(labelled, sample)
    fold, y = bag.labels()
    model = Classifier()
    if not len(y) or y.all() or not y.any():
        model.threshold = np.inf
        return model
    corpus, n_corpus = corpus_counts(documents)
    bad, n_bad = offending_counts(labelled, folds)
    starts = []
    for k in range(folds + 1):  # the last one leaves no fold out
        others = [j for j in range(folds) if j != k]
        starts.append(np.maximum(log_ratios(bad[others].sum(axis=0), int(n_bad[others].sum()), corpus, n_corpus), 0))
    models = fitted(labelled, bag, starts, corpus, n_corpus)
    scores = bag.scores(models)
    held = np.choose(fold, scores[:folds]) if folds > 1 else scores[0]
    model.threshold = _best_threshold(held, y, weight_of_good)
    model.weight, model.bias = models[folds].dense(), models[folds].bias
    model.held = held, y
    return model


def score_documents(documents: DataFrame, model: Classifier, doc_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, score, n_flagged, offends)`` for every document.

    ``score`` is the worst sentence's chance of offending, 0 for null and blank texts;
    ``n_flagged`` counts the sentences above the model's threshold. Repeated rows stay.
    """
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast((model.weight.astype(np.float32), model.bias, model.threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias, threshold = sent.value
        tokens = Tokens()
        for part in slices(batches, _ROWS):
            per = [sentences(t, tokens) if t else [] for t in part.column("text").to_pylist()]
            worst = np.full(len(per), -np.inf)
            flagged = np.zeros(len(per), np.int64)
            doc = np.repeat(np.arange(len(per)), [len(p) for p in per])
            flat = [s for p in per for s in p]
            for low in range(0, len(flat), 4000):
                some = flat[low : low + 4000]
                buckets, owner = sentence_features(some)
                z = np.bincount(owner, weight[buckets], len(some)) + bias
                np.maximum.at(worst, doc[low : low + 4000], z)
                np.add.at(flagged, doc[low : low + 4000], z > threshold)
            score = np.where(np.isfinite(worst), _sigmoid(np.where(np.isfinite(worst), worst, 0)), 0.0)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("source"), pa.array(score), pa.array(flagged.astype(np.int32)), pa.array(flagged > 0)],
                ["doc_id", "source", "score", "n_flagged", "offends"],
            )

    rows = documents.select(documents[doc_col].alias("doc_id"), documents[source_col].alias("source"), documents[text_col].alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return spread(rows).mapInArrow(run, f"doc_id {kinds['doc_id']}, source {kinds['source']}, score double, n_flagged int, offends boolean")


def source_rates(scored: DataFrame) -> DataFrame:
    """``(source, n_docs, n_offending, rate, mean_score)`` by source, null among them."""
    return scored.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.count_if("offends").alias("n_offending"),
        F.expr("count_if(offends) / count(*)").alias("rate"), F.avg("score").alias("mean_score"),
    )
