"""Character spans of field values in JSON answers, and tokens by the field they lie in."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FIELD = re.compile(r'"(?P<name>[^"\\]+)"\s*:\s*(?P<value>"(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?)')


def field_spans(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, field, start, end)``: where scalar values of named fields stand, quotes left out, end exclusive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, names, starts, ends = [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                for m in _FIELD.finditer(text or ""):
                    quoted = m["value"][0] == '"'
                    rows.append(k)
                    names.append(m["name"])
                    starts.append(m.start("value") + quoted)
                    ends.append(m.end("value") - quoted)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
                ["id", "field", "start", "end"],
            )

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, field string, start int, end int")


_THOUGHT = re.compile(r"<think>.*?(?:</think>|\Z)", re.DOTALL)
_LIST = re.compile(r"\[(?=\s*(?:[{\]]|\Z))")


def list_bounds(text: str | None) -> tuple[int, int]:
    """Where the list of an answer stands, thoughts passed over; a damaged one goes to its fence or the end. (0, 0) without one."""
    text = _THOUGHT.sub(lambda m: " " * len(m.group()), text or "")
    found = _LIST.search(text)
    if not found:
        return 0, 0
    try:
        return found.start(), json.JSONDecoder(strict=False).raw_decode(text, found.start())[1]
    except (ValueError, RecursionError):
        fence = text.find("```", found.start())
        return found.start(), fence if fence >= 0 else len(text)


def list_places(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, first, last)``: the bounds of each answer's list, end exclusive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list_bounds(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array([f[j] for f in found], pa.int32()) for j in range(2)]], ["id", "first", "last"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, first int, last int")


def word_places(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, number, start, end)`` of the runs without white space of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, n, m.start(), m.end()) for k, t in enumerate(batch.column("text").to_pylist()) for n, m in enumerate(re.finditer(r"\S+", t or ""))]
            columns = [pa.array([f[j] for f in found], pa.int32()) for j in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(columns[0]), *columns[1:]], ["id", "number", "start", "end"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, number int, start int, end int")


def field_tenths(df: DataFrame, text_col: str) -> DataFrame:
    """``(field, tenth, n_words)``: words of all texts by the field that they stand in and the tenth of their text, in one pass.

    A word belongs to the field whose value holds its middle, to ``structural`` elsewhere in the
    list, to ``outside`` beside it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column("text").to_pylist():
                words = [(m.start() + m.end() - 1) // 2 for m in re.finditer(r"\S+", text or "")]
                first, last = list_bounds(text)
                fields = [(m.start("value") + (q := m["value"][0] == '"'), m.end("value") - q, m["name"]) for m in _FIELD.finditer(text or "")]
                at = 0
                for k, middle in enumerate(words):
                    while at < len(fields) and fields[at][1] <= middle:
                        at += 1
                    inside = at < len(fields) and fields[at][0] <= middle
                    name = "outside" if not first <= middle < last else fields[at][2] if inside else "structural"
                    counts[name, min(10 * k // len(words), 9)] += 1
            rows = sorted(counts.items())
            columns = [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int64()), pa.array([n for _, n in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["field", "tenth", "n"])

    found = df.select(F.col(text_col).alias("text")).mapInArrow(run, "field string, tenth long, n long")
    return found.groupBy("field", "tenth").agg(F.sum("n").alias("n_words"))


def labelled_tokens(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """``tokens`` ``(id, number, start, end)`` with the field whose span holds their middle, else ``structural``.

    An interval join within an id: both sides of one id are a single answer.
    """
    middle = tokens.withColumn("middle", F.expr("(start + end - 1) div 2"))
    inside = middle.join(spans.select("id", "field", F.col("start").alias("low"), F.col("end").alias("high")), "id").where("middle >= low and middle < high")
    first = inside.groupBy("id", "number").agg(F.min("field").alias("field"))
    return tokens.join(first, ["id", "number"], "left").withColumn("field", F.coalesce("field", F.lit("structural")))


def differing_keys(cards: DataFrame, name_col: str, allowed: list[str] = ()) -> DataFrame:
    """``(key, n_values)`` of the columns in which rows differ, ``allowed`` ones left out; null is a value."""
    columns = [c for c in cards.columns if c != name_col and c not in allowed]
    long = cards.select(F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias("value")) for c in columns])).alias("x"))
    return long.groupBy("x.key").agg(F.countDistinct("x.value").alias("n_values")).where("n_values > 1")
