"""Problem 5: answers that were cut off.

Hazards decide, discrete ones in two measures. The *place* of a character is the structure that
it stands in: which brackets, quotes, fences and tags are open, and what kind of character it
is. The hazard of a place is the share of the characters there at which an answer ends. Answers
end far more often than on average at some places and pass the others; which, is tested over all
answers. The hazard of a *length* is the share of the answers that get so far and end there, off
an ending place; it is tested against the hazards of neighbouring lengths of the same source.
Both tests bound the share of false discoveries.

An answer was cut when it ends at a place that answers pass, or, at a significant length, at a
place that isn't an ending one. ``route`` tells a limit of length from a cut in transfer. A mark
of omission behind an answer is looked through; behind an ending place it counts by itself.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lexigrid.functions.text import WHITE, mix64
from lexigrid.llm.shingles import slices
from lexigrid.session import scratch, spread

_OUTER = re.compile(f"[{WHITE}\\u200b\\u200c\\u200d\\ufeff]+$")
#: What may be put behind a cut.
_MARK = re.compile(r"(?:…|\.\.\.+|�|[\[(<](?:cut|truncated|continued)[\])>])$", re.IGNORECASE)
_TAG = re.compile(r"</?[a-z]+>")
#: A list whose strings are in single quotes, or in either kind.
_SINGLE = re.compile(r"[^\[{\"]*[\[{][\s\[{]*'")
_EITHER = re.compile(r"\"(?:[^\"\\]|\\.)*(?:\"|$)|'(?:[^'\\]|\\.)*(?:'|$)", re.DOTALL)

#: Kinds of characters; blanks are no place of their own.
_WORD, _SENTENCE, _COMMA, _COLON, _QUOTE, _LIST, _OBJECT, _ROUND, _OPENER, _TICK, _FENCE, _TOKEN, _OTHER, _BLANK = range(14)
#: An answer before any list or record, with a list, with records; before its third word.
PROSE, LISTS, RECORDS, EARLY = range(4)
_DEPTHS = 9
#: Structural places are below this, and so bounded in number; those of an answer's first two words are above.
STRUCTURAL = 3 * 8 * _DEPTHS * 16


@functools.cache
def _kinds() -> np.ndarray:
    """Kind of each character of the basic plane; others are letters."""
    kind = np.full(1 << 16, _OTHER, np.int8)
    for k in range(1 << 16):
        category = unicodedata.category(chr(k))
        if category[0] in "LNM":
            kind[k] = _WORD
        elif category[0] in "ZC":
            kind[k] = _BLANK
    for kinds, characters in (
        (_SENTENCE, ".!?。！？"), (_COMMA, ",;"), (_COLON, ":"), (_QUOTE, "\"'“”„«»’"), (_LIST, "]"), (_OBJECT, "}"), (_ROUND, ")"), (_OPENER, "[{("), (_TICK, "`")
    ):
        kind[[ord(c) for c in characters]] = kinds
    return kind


def bare(text: str) -> str:
    """The text without outer blanks and marks behind it."""
    while (shorter := _MARK.sub("", _OUTER.sub("", text))) != text:
        text = shorter
    return text


def _plain(m: re.Match) -> str:
    text = m.group()
    whole = len(text) > 1 and text[-1] == text[0]
    return f'"{"x" * (len(text) - 1 - whole)}' + '"' * whole


def double_quoted(text: str) -> str:
    """A single-quoted list with its strings in double quotes, as long as before."""
    found = _SINGLE.match(text)
    return text if not found else text[: found.end() - 1] + _EITHER.sub(_plain, text[found.end() - 1 :])


def places(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of every character of a batch of texts, -1 for blanks; where each text begins; its kind of answer so far."""
    flat = "".join(t + "\n" for t in texts)
    c = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    begin = np.repeat(bounds[:-1], sizes)
    at = np.arange(len(c))

    def running(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(x, dtype=np.int32)])
        return total[1:] - total[begin]

    def run_length(x: np.ndarray) -> np.ndarray:
        """Length of the run of true values that ends at each character."""
        return at - np.maximum(np.maximum.accumulate(np.where(x, -1, at)), begin - 1)

    before = np.roll(run_length(c == 92), 1)
    quote = (c == 34) & ((before % 2 == 0) | (at == begin))
    quoted = running(quote) % 2
    outside = (quoted ^ quote) == 0
    opens, closes = np.isin(c, (91, 123, 40)) & outside, np.isin(c, (93, 125, 41)) & outside
    depth = np.clip(running(opens.astype(np.int8) - closes.astype(np.int8)), -1, _DEPTHS - 2)
    ticks = run_length(c == 96)
    third = (ticks > 0) & (ticks % 3 == 0)
    fence = running(third) % 2
    tags = np.zeros(len(c), np.int8)
    for m in _TAG.finditer(flat):
        tags[m.end() - 1] = -1 if m.group()[1] == "/" else 1
    tag = np.clip(running(tags), 0, 1)
    kind = np.where(c < 1 << 16, _kinds()[np.minimum(c, (1 << 16) - 1)], _WORD)
    kind[third] = _FENCE
    token = (c[2:] == 62) & (c[1:-1] == 124) & (c[:-2] != 60)
    kind[2:][token] = _TOKEN
    following = np.append(c[1:], 0)
    lead = np.where(running((c == 60) & (following == 124)) > 0, RECORDS, np.where(running(np.isin(c, (91, 123)) & outside) > 0, LISTS, PROSE))
    place = ((((lead * 2 + fence) * 2 + tag) * 2 + quoted) * _DEPTHS + depth + 1) * 16 + kind
    blank = kind == _BLANK
    starts = ~blank & (np.append(True, blank[:-1]) | (at == begin))
    early = np.flatnonzero((lead == PROSE) & (running(starts) <= 2) & ~blank & (tag + quoted + fence == 0))
    # the place of an answer's first two words is what has been said so far
    power = np.cumprod(np.full(int(sizes.max(initial=1)), 0x9E3779B97F4A7C15, np.uint64))
    if len(early):
        said = np.concatenate([[np.uint64(0)], np.cumsum(mix64(c.astype(np.uint64) + np.uint64(1)) * power[at - begin], dtype=np.uint64)])
        place[early] = STRUCTURAL + (mix64(said[early + 1] - said[begin[early]]) >> np.uint64(16)).astype(np.int64)
        lead[early] = EARLY
    return np.where(blank, -1, place), bounds, lead


def scanned(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Rows of two kinds from one pass over all texts that aren't blank.

    Answers: ``id, source, n_chars, n_bytes, n_bare, marked``, and the ``place`` and ``lead`` of their
    last character, ``passed`` being null. Places: ``place``, ``lead`` and in ``passed`` how many
    characters of some answers stand there.
    """
    rows = df.select(
        df[id_col].alias("id"), df[source_col].alias("source"), F.length(df[text_col]).alias("n_chars"),
        F.octet_length(df[text_col]).alias("n_bytes"), df[text_col].alias("text"),
    ).where(F.col("text").rlike(f"[^{WHITE}]"))
    rows = spread(rows)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            whole = part.column("text").to_pylist()
            texts = [bare(t) for t in whole]
            marked = [len(a) < len(_OUTER.sub("", b)) for a, b in zip(texts, whole)]
            place, bounds, lead = places([double_quoted(t) for t in texts])
            some = np.flatnonzero(place >= 0)
            found, passed = np.unique(place[some], return_counts=True)
            of = np.zeros(len(found), np.int64)
            of[np.searchsorted(found, place[some])] = lead[some]
            last = np.maximum(bounds[1:] - 2, bounds[:-1])  # the last character, behind which a line ends
            n, m = len(texts), len(found)
            nothing = lambda kind: pa.nulls(m, kind)
            columns = [
                pa.concat_arrays([part.column(k), nothing(part.column(k).type)]) for k in ("id", "source", "n_chars", "n_bytes")
            ] + [
                pa.concat_arrays([pa.array([len(t) for t in texts], pa.int32()), nothing(pa.int32())]),
                pa.concat_arrays([pa.array(marked, pa.bool_()), nothing(pa.bool_())]), pa.array(np.concatenate([place[last], found])), pa.array(np.concatenate([lead[last], of]).astype(np.int32)),
                pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(passed.astype(np.int64))]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "source", "n_chars", "n_bytes", "n_bare", "marked", "place", "lead", "passed"])

    return rows.mapInArrow(run, f"id {kinds['id']}, source {kinds['source']}, n_chars int, n_bytes int, n_bare int, marked boolean, place long, lead int, passed long")


def _upper(k: int, mu: float) -> float:
    if k <= mu:
        return 1.0
    term = total = math.exp(k * math.log(mu) - mu - math.lgamma(k + 1))
    while term > total * 1e-12:
        k += 1
        term *= mu / k
        total += term
    return total


def _lower(k: int, mu: float) -> float:
    if k >= mu:
        return 1.0
    term = total = math.exp(k * math.log(mu) - mu - math.lgamma(k + 1))
    while k > 0 and term > total * 1e-12:
        term *= k / mu
        k -= 1
        total += term
    return total


@F.pandas_udf(DoubleType())
def poisson_tail(n: pd.Series, mean: pd.Series) -> pd.Series:
    """Chance of ``n`` or more events where ``mean`` are expected."""
    return pd.Series([_upper(int(k), float(mu)) for k, mu in zip(n, mean)])


@F.pandas_udf(DoubleType())
def poisson_head(n: pd.Series, mean: pd.Series) -> pd.Series:
    """Chance of ``n`` or fewer events where ``mean`` are expected."""
    return pd.Series([_lower(int(k), float(mu)) for k, mu in zip(n, mean)])


def discoveries(tested: DataFrame, p: str, within: str, order: str, false_share: float, name: str) -> DataFrame:
    """``tested`` with a flag ``name`` by Benjamini and Hochberg's procedure on column ``p`` within groups."""
    ranked = tested.withColumn("__passes", F.expr(f"{p} <= {false_share} * row_number() over (partition by {within} order by {p}, {order}) / count(*) over (partition by {within})"))
    return ranked.withColumn(name, F.expr(f"{p} <= coalesce(max(case when __passes then {p} end) over (partition by {within}), -1)")).drop("__passes")


def place_hazards(scan: DataFrame, factor: float, false_share: float) -> DataFrame:
    """``(place, lead, passed, ended, hazard, usual, ending, passing)``: where answers end and where they pass.

    ``usual`` is the hazard over all places of the same kind of answer. A place is an ``ending``
    one when its hazard is significantly above ``factor`` times that, a ``passing`` one when it
    is significantly below. A place of too few characters to tell, that some answer has passed,
    takes the finding of its neighbours with the same open quotes, fences, tags and brackets.
    """
    ended = F.coalesce(F.count_if(F.col("passed").isNull()), F.lit(0))
    fine = scan.groupBy("lead", "place").agg(F.coalesce(F.sum("passed"), F.lit(0)).alias("passed"), ended.alias("ended"))
    usual = fine.groupBy("lead").agg((F.sum("ended") / F.greatest(F.sum("passed"), F.lit(1))).alias("usual"))
    # places of the first words aren't bounded in number; their groups are
    group = F.expr(f"case when place >= {STRUCTURAL} then pmod(place, 64) else -1 end")
    around = F.expr(f"case when place < {STRUCTURAL} then place div {16 * _DEPTHS} * 2 + least(place div 16 % {_DEPTHS} div 2, 1) end")
    fine = fine.join(F.broadcast(usual), "lead").withColumn("part", group).withColumn("around", around)  # a row for each of four kinds
    coarse = fine.where("around is not null").groupBy("lead", "around", "usual").agg(F.sum("passed").alias("passed"), F.sum("ended").alias("ended"))

    def tested(df: DataFrame, within: str, order: str) -> DataFrame:
        mean = F.expr(f"greatest(passed, 1) * usual * {factor}")
        df = df.withColumn("low", poisson_head("ended", mean)).withColumn("high", poisson_tail("ended", mean))
        df = discoveries(df, "low", within, order, false_share, "passing")
        return discoveries(df, "high", within, order, false_share, "ending").drop("low", "high")

    near = tested(coarse, "lead", "around").select("lead", "around", F.col("passing").alias("near_passing"))
    both = tested(fine, "lead, part", "place").join(F.broadcast(near), ["lead", "around"], "left")  # at most 48 rows
    taken = F.expr("passing or not ending and ended < passed and coalesce(near_passing, false)")
    return both.select("place", "lead", "passed", "ended", F.expr("ended / greatest(passed, 1)").alias("hazard"), "usual", "ending", taken.alias("passing"))


def length_hazards(rows: DataFrame, reach: int = 40, false_share: float = 0.01, factor: float = 2.0) -> DataFrame:
    """Hazards by source, unit and length, and which are significant.

    ``rows`` are ``(source, n_chars, n_bytes, n_bare, ending)``; the units are characters and
    bytes, and characters without marks and blanks at the end. Of the rows that get to a length,
    ``n`` end there at a place that isn't an ending one; lengths that are common by nature don't count.
    ``(source, unit, length, n, at_risk, hazard, expected, p_value, significant)``. Neighbours
    are the ``reach`` lengths on either side; the hazard must be more than ``factor`` times theirs.
    The windows run over a histogram, whose rows are bounded by the longest text; Benjamini and
    Hochberg's procedure holds within a source and unit.
    """
    units = "inline(array(struct('chars' as unit, n_chars as length), struct('bytes' as unit, n_bytes as length), struct('bare' as unit, n_bare as length)))"
    counted = rows.select("source", "ending", F.expr(units)).groupBy("source", "unit", "length").agg(
        F.count("*").alias("all_n"), F.count_if(~F.col("ending")).alias("n")
    )
    near = "over (partition by source, unit order by length range between"
    tested = (
        counted.withColumn("at_risk", F.expr("sum(all_n) over (partition by source, unit order by length desc)"))
        .withColumn("low", F.expr(f"sum(n) {near} {reach} preceding and 1 preceding)"))
        .withColumn("high", F.expr(f"sum(n) {near} 1 following and {reach} following)"))
        .withColumn("near_risk", F.expr(f"avg(at_risk) {near} {reach} preceding and {reach} following)"))
        .where("n > 0")
        .withColumn("hazard", F.expr("n / at_risk"))
        # one event more than seen keeps the expectation above zero where the neighbours are empty
        .withColumn("expected", F.expr(f"at_risk * (coalesce(low, 0) + coalesce(high, 0) + 1) / (least(length, {reach}) + {reach}) / near_risk"))
        .withColumn("p_value", poisson_tail("n", F.col("expected") * factor))
    )
    return discoveries(tested, "p_value", "source, unit", "length", false_share, "significant").select(
        "source", "unit", "length", "n", "at_risk", "hazard", "expected", "p_value", "significant"
    )


class Truncation:
    """Rows of ``df`` whose text was cut off.

    ``rows``: ``(id, source, n_chars, n_bytes, ending, passing, at_limit, truncated, route)`` for every
    row whose text isn't null or blank; repeated rows stay. ``ending`` and ``passing`` are the
    findings on the place of the last character; both are false where the data can't tell.
    ``at_limit`` says that a length of the row is a significant one of its source (null is a
    source). ``route`` is ``limit``, ``transfer`` or ``mark``, null for rows that weren't cut. A table of
    few rows shows few places; what it can't show isn't flagged.
    """

    def __init__(self, df: DataFrame, id_col: str, text_col: str, source_col: str, reach: int = 40, false_share: float = 0.01, factor: float = 2.0):
        scan = scratch(scanned(df, id_col, text_col, source_col), "endings")
        self.places = scratch(place_hazards(scan, factor, false_share), "places")
        answers = scan.where("passed is null").drop("passed", "lead")
        known = self.places.select("place", "ending", "passing")
        structural, early = (self.places_of(answers, known, some) for some in (f"place < {STRUCTURAL}", f"place >= {STRUCTURAL}"))
        self.ends = structural.union(early)
        self.hazards = length_hazards(self.ends, reach, false_share)
        limits = scratch(self.hazards.where("significant").select(F.col("source").alias("at"), "unit", "length"), "limits")
        rows = self.ends
        for unit in ("chars", "bytes", "bare"):
            own = limits.where(F.col("unit") == unit).select("at", "length", F.lit(True).alias(f"{unit}_limit"))
            rows = rows.join(own, rows["source"].eqNullSafe(own["at"]) & (rows[f"n_{unit}"] == own["length"]), "left").drop("at", "length")
        self.rows = rows.withColumn("at_limit", F.expr("coalesce(chars_limit, bytes_limit, bare_limit, false)")).withColumn(
            "truncated", F.expr("passing or not ending and at_limit or marked")
        ).withColumn("route", F.expr("case when at_limit and not ending then 'limit' when passing then 'transfer' when marked then 'mark' end")).drop("chars_limit", "bytes_limit", "bare_limit", "n_bare", "marked", "place")

    @staticmethod
    def places_of(answers: DataFrame, known: DataFrame, which: str) -> DataFrame:
        """Answers with the findings on their places; structural places are few, so that a hot one needs no shuffle."""
        known = known.where(which)
        return answers.where(which).join(F.broadcast(known) if "<" in which else known, "place")

    def rates(self) -> DataFrame:
        """``(source, n_rows, n_truncated, n_at_limit, share)`` by source, over rows that aren't blank."""
        return self.rows.groupBy("source").agg(
            F.count("*").alias("n_rows"),
            F.count_if("truncated").alias("n_truncated"),
            F.count_if(F.expr("truncated and at_limit")).alias("n_at_limit"),
            F.expr("count_if(truncated) / count(*)").alias("share"),
        )
