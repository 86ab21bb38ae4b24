"""Sentences and sentence-bounded passages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.session import spread

# Abbreviations that end no sentence.
ABBREVIATIONS = frozenset(
    (
        "dr mr mrs ms prof st sr jr vs etc no fig cf al approx dept est gen govt max min mt pres pt sec sgt vol un co inc ltd corp "
        "ref ed rev trans n o ex eq pp ch a.m p.m u.s b.c a.d c.e"
    ).split()
)
_INITIALS = re.compile(r"(?:[A-Za-z]\.){2,}")
_CLOSERS = "\"')]}"


def ends_sentence(token: str) -> bool:
    core = token.rstrip(_CLOSERS)
    if core[-1:] not in (".", "!", "?"):
        return False
    return not (core[-1] == "." and (_INITIALS.fullmatch(core) or core[:-1].lstrip("\"'([{").lower() in ABBREVIATIONS))


def split_sentences(text: str | None) -> list[str]:
    """Whole sentences, tokens joined by blanks; a last part without an end mark is dropped."""
    out, start, tokens = [], 0, (text or "").split()
    for k, token in enumerate(tokens, 1):
        if ends_sentence(token):
            out.append(" ".join(tokens[start:k]))
            start = k
    return out


def pack_sentences(sentences: list[str], most: int = 300) -> list[str]:
    """Consecutive sentences put together up to ``most`` words; a longer sentence stands alone."""
    out: list[list[str]] = []
    size = 0
    for sentence in sentences:
        n = sentence.count(" ") + 1
        if not out or size + n > most:
            out.append([])
            size = 0
        out[-1].append(sentence)
        size += n
    return [" ".join(c) for c in out]


def chunk(df: DataFrame, keys: list[str], text_col: str, most: int = 300) -> DataFrame:
    """``(*keys, chunk_index, text, word_count)``: passages of each text, cut between sentences only.

    Null and blank texts, and texts without a whole sentence, have no rows.
    """
    source = spread(df.select(*keys, F.col(text_col).alias("text")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keys).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, index, texts, counts = [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                for k, piece in enumerate(pack_sentences(split_sentences(text), most)):
                    rows.append(row)
                    index.append(k)
                    texts.append(piece)
                    counts.append(piece.count(" ") + 1)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).take(at) for k in keys] + [pa.array(index, pa.int32()), pa.array(texts, pa.string()), pa.array(counts, pa.int32())],
                [*keys, "chunk_index", "text", "word_count"],
            )

    return source.mapInArrow(run, f"{schema}, chunk_index int, text string, word_count int")
