import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lexigrid.operators.labelling import Retryable, completing, label, within_budget
from lexigrid.operators.titles import company_key, folded_key
from lexigrid.sources import io


def test_lines_strict_and_tolerant(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"source": "s", "title": "t", "text": "x"}\nnot json\n\n')
    assert io.read_lines(spark, [str(path), str(tmp_path / "none")], io.ARTICLE, strict=False).count() == 1
    with pytest.raises(Exception):
        io.read_lines(spark, [str(path)], io.ARTICLE).collect()
    assert io.read_lines(spark, [str(tmp_path / "none")], io.ARTICLE).count() == 0


def test_splits_and_responses(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"train": ["a", "b"], "val": [], "test": ["c"]}, indent=1))
    assert {(r.id, r.split) for r in io.read_splits(spark, str(tmp_path / "s.json")).collect()} == {("a", "train"), ("b", "train"), ("c", "test")}
    line = lambda k, text: json.dumps({"custom_id": k, "response": {"body": {"choices": [{"message": {"content": text}}] if text else []}}})
    (tmp_path / "r.jsonl").write_text("\n".join([line("1", "old"), line("2", None), line("1", "new")]))
    assert {(r.custom_id, r.content) for r in io.read_batch_responses(spark, str(tmp_path / "r.jsonl")).collect()} == {("1", "new"), ("2", "")}


def test_append_upsert_versions(spark, tmp_path):
    out = str(tmp_path / "t")
    io.append_missing(spark.range(3), out, "id")
    io.append_missing(spark.range(5), out, "id")
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4]
    old = spark.createDataFrame([("a", "accept", 1), ("b", "reject", 1)], "k string, v string, t int")
    new = spark.createDataFrame([("a", "reject", 1), ("c", "accept", 0), ("b", "accept", 0)], "k string, v string, t int")
    assert {(r.k, r.v) for r in io.upserted(old, new, ["k"], F.col("t")).collect()} == {("a", "reject"), ("b", "reject"), ("c", "accept")}
    assert io.write_version(spark.range(1), str(tmp_path / "v")).endswith("v1") and io.write_version(spark.range(1), str(tmp_path / "v")).endswith("v2")
    splits = spark.createDataFrame([("a", "val"), ("z", "train")], "k string, split string")
    assert [r.k for r in io.write_splits(old, splits, "k", str(tmp_path / "x")).collect()] == ["z"]
    with pytest.raises(ValueError):
        io.only_ids(old, splits, "k")
    assert io.only_ids(old, splits, "k", strict=False).count() == 1


def test_title_keys(spark):
    rows = spark.createDataFrame([("Foo_Bar Co., Ltd.",), ("½ﬁ x² — Ⅷ",), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(folded_key("t")).collect()] == ["foo bar co ltd", "1 2fi x2 viii", None, ""]
    assert [r[0] for r in rows.select(company_key("t")).collect()] == ["foo bar", "1⁄2fi x2 — viii", "", ""]


def test_label_retries_and_resumes(spark):
    def call(prompt):
        if prompt == "never":
            raise Retryable()
        if prompt == "broken":
            raise RuntimeError()
        return prompt

    rows = spark.createDataFrame([(1, "[]"), (2, "never"), (3, "broken"), (4, "prose"), (5, "[]")], "k long, p string")
    done = spark.createDataFrame([(5, "ok"), (1, "failed")], "k long, status string")
    found = {r.k: (r.status, r.reason, r.attempts) for r in label(rows, "k", "p", call, lambda t: [] if t == "[]" else None, 2, done, 2, 2, 0.0).collect()}
    assert found == {1: ("ok", None, 1), 2: ("failed", "network", 2), 3: ("failed", "RuntimeError", 1), 4: ("failed", "schema", 2)}


def test_label_counts_progress(spark):
    progress = spark.sparkContext.accumulator(0)
    label(spark.range(7).selectExpr("id as k", "'[]' as p"), "k", "p", lambda p: p, lambda t: [], 3, progress=progress).collect()
    assert progress.value == 7


def test_completing_goes_on_until_the_answer_is_no():
    says = {"ask a": " yes", "more a": "b", "ask a\nb": "No", "ask x": "", "ask z": "y", "more z": "z", "ask z\nz": "Y", "more z\nz": "z", "a": "a", "x": "x", "z": "z"}
    run = completing(says.__getitem__, lambda p, t: f"ask {t}", lambda p, t: f"more {t}")
    assert [run(p) for p in "axz"] == ["a\nb", "x", "z\nz\nz"]


def test_budget_takes_the_first_in_hash_order(spark):
    rows = spark.createDataFrame([(k,) for k in [*range(300), None]], "k long")
    order = sorted(range(300), key=lambda k: hashlib.md5(f"0:{k}".encode()).hexdigest())
    for most in (0, 1, 77, 300, 301, 500):
        for bins in (1, 3):
            found = {r.k for r in within_budget(rows, "k", most, bins).collect()}
            assert found == set(order[:most]) | ({None} if most > 300 else set())
    assert within_budget(rows.limit(0), "k", 5).count() == 0
