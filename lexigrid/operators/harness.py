"""Scores of found triplets against gold ones, passage by passage: schema, alignment, weights, grounding and their mean."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from lexigrid.functions import rules
from lexigrid.operators.linking import best_matching, lexical_similarity

# Shares of the axes in the composite, and of source, target and relation in an alignment.
AXES = {"schema": 0.30, "entity_f1": 0.25, "relation_acc": 0.20, "weight": 0.10, "grounding": 0.15}
SHARES = (0.45, 0.45, 0.10)
SIMILAR, ACCEPTED = 0.80, 0.50

#: A normalised triplet as the scores take it.
TRIPLET = "struct<s:string,st:string,r:string,w:double,t:string,tt:string>"
_PAIR = StructType().add("i", IntegerType()).add("j", IntegerType()).add("source", DoubleType()).add("target", DoubleType()).add("relation", DoubleType())

_WORDS = re.compile(r"\w+")
_similar = functools.lru_cache(1 << 16)(lexical_similarity)


@functools.lru_cache(1 << 16)
def _words(title: str) -> frozenset[str]:
    return frozenset(_WORDS.findall(title))


def _field(a: str, b: str) -> float:
    """1 for equal fields, else their similarity where it is ``SIMILAR``.

    Words make half of it, so where they share too little the characters needn't be matched.
    """
    if a == b:
        return 1.0
    one, two = _words(a), _words(b)
    if len(one & two) < (2 * SIMILAR - 1 - 1e-9) * len(one | two):
        return 0.0
    value = _similar(a, b)
    return value if value >= SIMILAR else 0.0


def alignment(gold: list[tuple[str, str, str]], found: list[tuple[str, str, str]]) -> list[dict]:
    """One-to-one pairs of (source, relation, target) with the greatest total likeness, those of ``ACCEPTED`` or more."""
    words = lambda r: r.replace("_", " ").strip()
    parts = [[(_field(g[0], f[0]), _field(g[2], f[2]), 1.0 if g[1] and g[1] == f[1] else _field(words(g[1]), words(f[1]))) for f in found] for g in gold]
    likeness = [[sum(share * part for share, part in zip(SHARES, cell)) for cell in row] for row in parts]
    return [dict(zip(("i", "j", "source", "target", "relation"), (i, j, *parts[i][j]))) for i, j in best_matching(likeness) if likeness[i][j] >= ACCEPTED]


@F.pandas_udf(ArrayType(_PAIR))
def _aligned(gs: pd.Series, gr: pd.Series, gt: pd.Series, fs: pd.Series, fr: pd.Series, ft: pd.Series) -> pd.Series:
    return pd.Series([alignment(list(zip(*row[:3])), list(zip(*row[3:]))) for row in zip(gs, gr, gt, fs, fr, ft)])


def _valid(t: Column) -> Column:
    named = t["s"].isNotNull() & t["st"].isNotNull() & t["r"].isNotNull() & t["t"].isNotNull() & t["tt"].isNotNull()
    return named & F.coalesce(t["w"].between(0, 1), F.lit(False))


def _count(array: str | Column, when) -> Column:
    return F.size(F.filter(array, when)).cast("long")


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def scores(passages: DataFrame, relations: tuple[str, ...]) -> DataFrame:
    """Per row of ``(id, text, gold, found)`` 22 counts and measures, and ``composite``.

    ``gold`` and ``found`` are arrays of ``TRIPLET`` with normalised titles and lower-case types,
    ``text`` is normalised as titles are; nulls are empty. Items with a null part or a weight out of
    range are invalid. Found loops are removed before the alignment and count as hallucinated, like
    unmatched triplets of an unknown relation or with an end that neither gold nor text has.
    Measures without a denominator are null and the composite's other shares are scaled up; where
    gold is empty it is 1 for an empty answer, else 0. A row holds the triplets of two answers.
    """
    none = F.array().cast(f"array<{TRIPLET}>")
    x = passages.select("id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("gold", none).alias("gold_items"), F.coalesce("found", none).alias("items"))
    x = x.withColumn("gold", F.filter("gold_items", _valid)).withColumn("valid", F.filter("items", _valid))
    x = x.withColumn("found", F.filter("valid", lambda t: (t["s"] == "") | (t["s"] != t["t"])))
    x = x.withColumn("words", rules.tokens(F.col("text"))).withColumn("names", F.array_distinct(F.concat("gold.s", "gold.t")))
    x = x.withColumn("pairs", _aligned("gold.s", "gold.r", "gold.t", "found.s", "found.r", "found.t"))
    ends = lambda p: (p["source"] > 0) & (p["target"] > 0)
    full = lambda p: ends(p) & (p["relation"] > 0)
    at = lambda name, place: F.get(F.col(name), place)
    agree = lambda p: ends(p) & (at("gold", p["i"])["st"] == at("found", p["j"])["st"]) & (at("gold", p["i"])["tt"] == at("found", p["j"])["tt"])
    close = F.transform(F.filter("pairs", full), lambda p: rules.weight_score(at("gold", p["i"])["w"], at("found", p["j"])["w"]))
    taken = F.transform("pairs", lambda p: p["j"])
    x = x.withColumn("alone", F.filter(F.transform("found", lambda t, j: F.when(~F.array_contains(taken, j), t)), lambda t: t.isNotNull()))
    known = lambda c: F.array_contains(F.col("names"), c) | ((c != "") & rules.grounded(c, F.col("text"), passage_words=F.col("words")))
    supported = lambda t: t["r"].isin(*relations) & known(t["s"]) & known(t["t"])
    n = lambda name: F.size(name).cast("long")
    x = x.select(
        "id", n("gold").alias("n_gold"), n("found").alias("n_pred"), n("items").alias("n_items"), n("valid").alias("n_valid"), _count("pairs", ends).alias("entity_tp"), _count("pairs", full).alias("full_tp"),
        _count("pairs", agree).alias("n_agree"), close.alias("close"), (F.size("valid") - F.size("found")).cast("long").alias("self_loops"), _count("alone", supported).alias("novel_grounded"), n("alone").alias("n_alone"),
    )
    c, some = F.col, F.col("n_items") > 0
    x = x.withColumns({
        "schema_score": F.when(some, c("n_valid") / c("n_items")).otherwise(1.0), "entity_precision": rules.ratio(c("entity_tp"), c("n_items")), "entity_recall": rules.ratio(c("entity_tp"), c("n_gold")),
        "triplet_precision": rules.ratio(c("full_tp"), c("n_items")), "triplet_recall": rules.ratio(c("full_tp"), c("n_gold")), "relation_accuracy": F.when(c("entity_tp") > 0, c("full_tp") / c("entity_tp")),
        "type_agreement": F.when(c("entity_tp") > 0, c("n_agree") / c("entity_tp")), "weight_score": F.when(F.size("close") > 0, F.aggregate("close", F.lit(0.0), lambda a, v: a + v) / F.size("close")),
        "hard_hallucinations": c("n_alone") - c("novel_grounded") + c("self_loops"),
    })
    x = x.withColumns({"entity_f1": _f1(c("entity_precision"), c("entity_recall")), "triplet_f1": _f1(c("triplet_precision"), c("triplet_recall")), "hallucination_rate": rules.ratio(c("hard_hallucinations"), c("n_items"))})
    x = x.withColumn("grounding", 1 - c("hallucination_rate"))
    axes = {"schema": F.when(some, c("schema_score")), "entity_f1": c("entity_f1"), "relation_acc": c("relation_accuracy"), "weight": c("weight_score"), "grounding": F.when(some, c("grounding"))}
    total = sum((F.coalesce(axes[a] * w, F.lit(0.0)) for a, w in AXES.items()), F.lit(0.0))
    present = sum((F.when(axes[a].isNotNull(), w).otherwise(0.0) for a, w in AXES.items()), F.lit(0.0))
    composite = F.when(c("n_gold") == 0, F.when(some, 0.0).otherwise(1.0)).otherwise(total / present)
    return x.withColumn("schema_valid", c("n_valid") == c("n_items")).withColumn("composite", composite).drop("close", "n_alone", "n_agree")


#: Measures of which the summary gives the mean over the rows that have them.
MEANS = ("schema_score", "entity_f1", "triplet_f1", "relation_accuracy", "weight_score", "type_agreement", "grounding", "composite")


def summary(scored: DataFrame) -> DataFrame:
    """One row: sums and their ratios (``micro_``), and means over rows, nulls left out (``macro_``)."""
    c = F.col
    sums = scored.agg(
        F.count("*").alias("n_entries"), *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in ("n_gold", "n_items", "entity_tp", "full_tp", "hard_hallucinations")],
        F.count_if(c("n_items") == 0).alias("empty_predictions"), F.count_if(~c("schema_valid")).alias("schema_invalid"), *[F.coalesce(F.avg(m), F.lit(0.0)).alias(f"macro_{m}") for m in MEANS],
    )
    for name, tp in (("entity", "entity_tp"), ("triplet", "full_tp")):
        sums = sums.withColumns({f"micro_{name}_precision": rules.ratio(c(tp), c("n_items")), f"micro_{name}_recall": rules.ratio(c(tp), c("n_gold"))})
        sums = sums.withColumn(f"micro_{name}_f1", _f1(c(f"micro_{name}_precision"), c(f"micro_{name}_recall")))
    return sums.withColumn("micro_hallucination_rate", rules.ratio(c("hard_hallucinations"), c("n_items")))
