"""Problem 3: splitting oversized texts at natural boundaries.

A boundary strength stands after every word: paragraph break, line break, sentence end,
clause end, comma, none. A sparse table over the strengths answers which is the strongest cut
in any window in two look-ups; of equal ones the rightmost is taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexigrid.functions.text import WHITE
from lexigrid.llm.shingles import slices
from lexigrid.session import spread

PARAGRAPH, LINE, SENTENCE, CLAUSE, COMMA, NONE = 5, 4, 3, 2, 1, 0
_SPAN = re.compile(f"[^{WHITE}]+")
_CLOSERS = "\"')]}»”’"
_ENDS = {c: SENTENCE for c in ".!?…。！？"} | {c: CLAUSE for c in ";:；："} | {c: COMMA for c in ",，、—–"}
_ABBREVIATION = re.compile(r"(?:[^\W\d_]\.)+|(?:approx|cf|dr|ed|etc|fig|mr|mrs|ms|no|nr|prof|sr|st|vol|vs)\.", re.IGNORECASE)


def strengths(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Strength of a cut after each word but the last."""
    out = np.zeros(max(len(spans) - 1, 0), np.int64)
    for k, ((start, end), (following, _)) in enumerate(zip(spans, spans[1:])):
        if following - end > 1 or text[end] != " ":
            breaks = len(text[end:following].replace("\r\n", "\n").splitlines()) - (text[following - 1] not in "\n\r\x0b\x0c\x85\u2028\u2029")
            if breaks > 0:
                out[k] = PARAGRAPH if breaks > 1 or "\u2029" in text[end:following] else LINE
                continue
        last = text[end - 1]
        if last in _CLOSERS:
            last = text[start:end].rstrip(_CLOSERS)[-1:]
        level = _ENDS.get(last, NONE)
        if level == SENTENCE and last == "." and _ABBREVIATION.fullmatch(text[start:end].lstrip("\"'([{«“")):
            level = NONE
        out[k] = level
    return out


class RangeMaximum:
    """Sparse table: the rightmost place of the greatest value in any range."""

    def __init__(self, values: np.ndarray, longest: int):
        level = values * (len(values) + 1) + np.arange(len(values))
        self.size, self.levels = len(values) + 1, [level]
        width = 1
        while 2 * width <= min(longest, len(values)):
            level = np.maximum(level[:-width], level[width:])
            self.levels.append(level)
            width *= 2

    def rightmost(self, low: int, high: int) -> int:
        """Place of the maximum in ``low..high``, both inclusive."""
        k = (high - low + 1).bit_length() - 1
        level = self.levels[k]
        return int(max(level[low], level[high - (1 << k) + 1]) % self.size)


def cuts(strength: np.ndarray, limit: int, overlap: int, least: int) -> list[tuple[int, int]]:
    """Pieces as word ranges (end exclusive) of a text with ``len(strength) + 1`` words."""
    n, start, pieces = len(strength) + 1, 0, []
    table = RangeMaximum(strength, limit - least + 1) if n > limit else None
    while n - start > limit:
        end = table.rightmost(start + least - 1, start + limit - 1) + 1
        pieces.append((start, end))
        start = end - overlap
    return [*pieces, (start, n)]


def split_oversized(df: DataFrame, id_col: str, text_col: str, limit: int = 300, overlap: int = 30,
                    least: int | None = None) -> DataFrame:
    """Pieces of the texts of more than ``limit`` words.

    ``(id, piece_no, n_pieces, first_word, n_words, cut_strength, piece)``: ``piece`` is the
    text from its first word to its last, inner white space as it was; ``cut_strength`` is that
    of the boundary at its end (null for the last piece). Every piece has at most ``limit``
    words and, but for the last, at least ``least`` (half the limit); consecutive ones share
    ``overlap`` words. Words are runs without Unicode white space.

    Null, blank and short texts have no rows; a text without any boundary is cut after
    ``limit`` words. Repeated rows are split one by one. Other columns are ignored.
    """
    least = least or max(limit // 2, overlap + 1)
    if not 0 <= overlap < least <= limit:
        raise ValueError("overlap < least <= limit must hold")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out: list[tuple] = []
            for key, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                if text is None or len(text) <= 2 * limit:  # a word and its white space take two characters
                    continue
                spans = [m.span() for m in _SPAN.finditer(text)]
                if len(spans) <= limit:
                    continue
                strength = strengths(text, spans)
                pieces = cuts(strength, limit, overlap, least)
                for number, (a, b) in enumerate(pieces, 1):
                    level = int(strength[b - 1]) if b < len(spans) else None
                    out.append((key, number, len(pieces), a, b - a, level, text[spans[a][0] : spans[b - 1][1]]))
            types = [part.schema.field("id").type, *[pa.int32()] * 5, pa.string()]
            names = ["id", "piece_no", "n_pieces", "first_word", "n_words", "cut_strength", "piece"]
            columns = zip(*out) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    source = spread(df.select(df[id_col].alias("id"), df[text_col].alias("text")))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(
        run, f"id {kind}, piece_no int, n_pieces int, first_word int, n_words int, cut_strength int, piece string"
    )
