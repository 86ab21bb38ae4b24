"""Text helpers that run inside Arrow tasks, and their JVM-side column forms.

"Folded words": NFKC, lower case, then maximal runs of letters and numbers.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of the Unicode property White_Space, as a regex class (works in Python and Java).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WORD = re.compile(f"[^{WHITE}]+")

_SPACED = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def fold(text: str) -> str:
    """NFKC and lower case."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return text.lower()


def folded_bytes(text: str) -> bytes:
    """Folded text as UTF-8 in which everything but letters and numbers is a blank."""
    text = fold(text)
    if not text.isascii():
        for c in set(text):
            if c > "\x7f" and not c.isalnum():
                text = text.replace(c, " ")
    return text.encode("utf-8", "replace").translate(_SPACED)


def folded_words(text: str) -> list[bytes]:
    """Folded words of a text as UTF-8 byte strings, in order."""
    return folded_bytes(text).split()


def words(text: str) -> list[str]:
    """Maximal runs of characters that are not Unicode white space."""
    return _WORD.findall(text)


_BYTE_CODES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def _base_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.cumprod(np.full(size, b, np.uint64)) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the folded words of a batch of texts, and where each text's words start.

    The second array has one entry more than there are texts. A word's hash is a polynomial
    over its bytes, taken from running sums over the whole batch; null texts have no words.
    """
    parts = [folded_bytes(t) if t else b"" for t in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    blank = data == 32
    before = np.empty_like(blank)
    before[:1], before[1:] = True, blank[:-1]
    starts = np.flatnonzero(before & ~blank)
    ends = np.flatnonzero(blank & ~before)
    power, inverse = _base_powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * power[: len(data)], out=total[1:])
    hashes = mix64((total[ends] - total[starts]) * inverse[starts])
    edges = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(sizes, out=edges[1:])
    return hashes, np.searchsorted(starts, edges)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit avalanche hash, on uint64 arrays (wraps around)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive token hashes, in order."""
    k = len(tokens) - n + 1
    if k <= 0:
        return np.empty(0, np.uint64)
    out = tokens[:k].copy()
    for j in range(1, n):
        out = out * np.uint64(_BASE) + tokens[j : j + k]
    return mix64(out)


def batch_grams(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``n``-grams of a batch of texts: hashes, and for each the number of its text."""
    grams = gram_hashes(hashes, n)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = owner[: len(grams)] == owner[n - 1 :] if len(grams) else np.empty(0, bool)
    return grams[inside], owner[: len(grams)][inside]


def distinct_grams(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ``n``-grams of each text of a batch, and where each text's begin."""
    grams, owner = batch_grams(hashes, bounds, n)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    first = np.ones(len(grams), bool)
    first[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[first], owner[first]
    return grams, np.searchsorted(owner, np.arange(len(bounds)))


def word_count(col: Column) -> Column:
    """Number of words (runs without Unicode white space); null text gives null."""
    return F.size(F.filter(F.split(col, f"[{WHITE}]+"), lambda w: w != "")).cast("int")


def squeeze(col: Column) -> Column:
    """Collapse white space to single blanks and trim."""
    return F.trim(F.regexp_replace(col, f"[{WHITE}]+", " "))


def outer_trim(col: Column) -> Column:
    """Remove outer Unicode white space."""
    return F.regexp_replace(col, f"^[{WHITE}]+|[{WHITE}]+$", "")
