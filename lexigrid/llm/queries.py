"""Registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions.text import outer_trim
from lexigrid.llm import abuse
from lexigrid.llm.leakage import leaks
from lexigrid.llm.near_duplicates import NearDuplicates
from lexigrid.llm.packing import Packing, token_counts
from lexigrid.llm.quota_sample import QuotaSample, passages
from lexigrid.llm.split_overlap import SplitOverlap, latest_splits
from lexigrid.llm.splitting import split_oversized
from lexigrid.llm.truncation import Truncation
from lexigrid.session import table


def _duplicates(spark: SparkSession, d: str) -> NearDuplicates:
    return NearDuplicates(table(spark, d, "wikipedia"), "article_id", "text", shingle=3, threshold=0.5)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _duplicates(spark, d).pairs()


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return _duplicates(spark, d).groups().withColumnRenamed("id", "article_id")


def _quotas(spark: SparkSession, d: str) -> QuotaSample:
    return QuotaSample(passages(table(spark, d, "report"), table(spark, d, "wikipedia")), table(spark, d, "sample_targets"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "sample_targets").select("request_id", F.col("source").alias("named"), "band")
    short = p2_report(spark, d).where("short").select("request_id", "source", "band")
    same = [short[c].eqNullSafe(targets[c]) for c in ("request_id", "band")] + [short["source"].eqNullSafe(F.lower(outer_trim(targets["named"])))]
    return targets.join(short, same, "left_semi").withColumnRenamed("named", "source")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return _quotas(spark, d).report()


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    return _quotas(spark, d).sample()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pieces(spark, d).where("piece_no = 1").select("article_id")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "wikipedia"), "article_id", "text", 300, 30).withColumnRenamed("id", "article_id")


def _overlap(spark: SparkSession, d: str) -> SplitOverlap:
    splits = latest_splits(table(spark, d, "split_manifest")).where("split in ('train', 'val', 'test')")
    return SplitOverlap(table(spark, d, "wikipedia"), splits, "article_id", "text", "title", shingle=3, threshold=0.5)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlap(spark, d).pairs.select(F.least("eval_id", "train_id").alias("id_a"), F.greatest("eval_id", "train_id").alias("id_b"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps per evaluation split and source of the evaluation article."""
    articles = table(spark, d, "wikipedia").select(F.col("article_id").alias("eval_id"), F.lower(outer_trim(F.col("source"))).alias("source"))
    return (
        _overlap(spark, d).pairs.join(articles, "eval_id").groupBy("split", "source", "reason")
        .agg(F.count("*").alias("n_pairs"), F.countDistinct("eval_id").alias("n_eval"), F.countDistinct("train_id").alias("n_train"))
    )


def _cut_answers(spark: SparkSession, d: str) -> Truncation:
    return Truncation(table(spark, d, "report"), "label_id", "teacher_raw", "source")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _cut_answers(spark, d).rows.where("truncated").select(F.col("id").alias("label_id"))


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return _cut_answers(spark, d).rates()


def p5_hazards(spark: SparkSession, d: str) -> DataFrame:
    return _cut_answers(spark, d).hazards.where("significant")


def _packing(spark: SparkSession, d: str) -> Packing:
    return Packing(token_counts(table(spark, d, "documents"), "doc_id", "text"), table(spark, d, "containers"))


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    return _packing(spark, d).items.withColumnRenamed("id", "doc_id")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return _packing(spark, d).fill()


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).where("kind in ('full', 'partial')").select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Every leak with its measures."""
    return _leaks(spark, d)


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    model = abuse.train(documents.select("doc_id", "text"), table(spark, d, "content_labels"))
    return abuse.score_documents(documents, model)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_scores(spark, d).where("offends").select("doc_id")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.source_rates(p8_scores(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}
