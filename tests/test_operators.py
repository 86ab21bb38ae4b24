import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.functions import rules
from lexigrid.operators import blocks, chunking, keep, minhash
from lexigrid.operators.components import connected_components
from lexigrid.operators.minhash import dropped_in_order, keep_first_near_duplicates
from lexigrid.operators.vectors import nearest


def test_components_agree_with_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (None, 4)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    found = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def in_order(edges):
    gone = set()
    for _, _, lo, hi in sorted((least, band, lo, hi) for lo, hi, least, band in edges):
        if lo not in gone and hi not in gone:
            gone.add(hi)
    return gone


@pytest.mark.parametrize("small", [0, 5, 1000])
def test_dropped_in_order_agrees_with_a_sequential_pass(spark, small):
    rng = random.Random(5)
    edges = {}
    for _ in range(120):
        lo, hi = sorted(rng.sample(range(70), 2))
        edges[lo, hi] = (lo, hi, rng.randrange(lo + 1), rng.randrange(4))
    edges = [*edges.values(), *[(k, k + 1, 100 + k % 3, 0) for k in range(100, 112)]]
    found = dropped_in_order(spark.createDataFrame(edges, "lo long, hi long, least long, band int"), small)
    assert sorted(r.id for r in found.collect()) == sorted(in_order(edges))


def test_near_duplicates_agree_with_a_sequential_pass(spark):
    rng = random.Random(21)
    texts = []
    for _ in range(12):
        text = [rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(120)]
        for _ in range(6):
            other = list(text)
            for at in rng.sample(range(120), rng.randrange(0, 5)):
                other[at] = "zz"
            texts.append(" ".join(other))
    rng.shuffle(texts)
    sigs = [minhash.signature(np.unique(minhash.shingle_hashes(t))) for t in texts]
    buckets = {}
    for k, sig in enumerate(sigs):
        for band in range(minhash.BANDS):
            buckets.setdefault((band, sig[band * 8 : band * 8 + 8].tobytes()), []).append(k)
    keep = [True] * len(texts)
    for members in buckets.values():
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                if keep[a] and keep[b] and (sigs[a] == sigs[b]).mean() >= 0.85:
                    keep[b] = False
    found = keep_first_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc long, body string"), "doc", "body")
    assert {r.id: r.kept for r in found.collect()} == dict(enumerate(keep)) and not all(keep)


def test_hot_keys_meet_in_blocks(spark):
    rows = spark.range(50).selectExpr("cast(1 as bigint) as key", "id").union(spark.range(2).selectExpr("cast(2 as bigint) as key", "id + 100 as id"))
    found = [(r.id_a, r.id_b, r.n) for r in blocks.pairs_within(rows, 7, {"n": F.count("*")}).collect()]
    assert sorted(found) == sorted([(a, b, 50) for b in range(50) for a in range(b)] + [(100, 101, 2)])
    left = rows.select("key", F.col("id").alias("a")).union(spark.createDataFrame([(3, 7), (None, 8)], "key long, a long"))
    right = rows.select("key", F.col("id").alias("b")).where("id % 2 = 0").union(spark.createDataFrame([(None, 8)], "key long, b long"))
    met = [(r.key, r.a, r.b) for r in blocks.meet(left, right, 6).collect()]
    assert sorted(met) == sorted([(1, a, b) for a in range(50) for b in range(0, 50, 2)] + [(2, 100, 100), (2, 101, 100)])


def test_links_between_classes_are_expanded(spark):
    links = spark.createDataFrame([(1, 2, "x"), (1, 3, "y")], "id_a long, id_b long, link string")
    left = spark.createDataFrame([(1, k) for k in range(20)], "key long, a long")
    right = spark.createDataFrame([(2, 7), (3, 8), (3, 9), (4, 1)], "key long, b long")
    found = [(r.link, r.a, r.b) for r in blocks.expanded(links, left, right, 3).collect()]
    assert sorted(found) == sorted([(n, a, b) for a in range(20) for n, b in (("x", 7), ("y", 8), ("y", 9))])


def test_near_duplicates_keep_the_first(spark):
    base = " ".join(f"word{k} stands here" for k in range(60))
    rows = [(3, base), (1, base + " end"), (2, "something else altogether, with its own words"), (9, base), (4, "abc"), (5, "xy"), (6, None)]
    kept = {r.id: r.kept for r in keep_first_near_duplicates(spark.createDataFrame(rows, "doc long, body string"), "doc", "body").collect()}
    assert kept == {1: True, 2: True, 3: False, 9: False, 4: True, 5: False}


def test_chunking_of_nulls_blanks_and_long_sentences(spark):
    long = " ".join(["w"] * 400) + "."
    rows = [(1, None), (2, " \n"), (3, "One two. " * 200), (4, long), (5, "no end mark")]
    out = chunking.chunk(spark.createDataFrame(rows, "id long, text string"), ["id"], "text").collect()
    assert [(r.id, r.chunk_index, r.word_count) for r in sorted(out)] == [(3, 0, 300), (3, 1, 100), (4, 0, 400)]


def test_rules(spark):
    rows = [("The cat sat on the mat and that was all of it.",), ("Кошка сидела на ковре",), ("See also: External links",), ("",), ("1 and 22,000 of 1999 or 3.5",)]
    df = spark.createDataFrame(rows, "t string")
    assert [r[0] for r in df.select(rules.is_english(F.col("t"))).collect()] == [True, False, False, False, True]
    assert [r[0] for r in df.select(rules.is_boilerplate(F.col("t"))).collect()] == [False, False, True, False, False]
    assert df.select(rules.numbers_in(F.col("t"))).collect()[4][0] == ["1", "22000", "3.5"]
    assert spark.range(1).select(rules.clean_text(F.lit("a  @xmath12 b [x cols=2] c"))).first()[0] == "a b c"
    assert [r[0] for r in spark.createDataFrame([("x (y",), ('a "b',), ("fine (so)",)], "t string").select(rules.is_clean_description(F.col("t"))).collect()] == [False, False, True]
    assert [r[0] for r in spark.createDataFrame([("12",), ("nan",), (None,), ("-1",), ("3",)], "t string").select(rules.strength(F.col("t"))).collect()] == [10.0, 5.0, 5.0, 5.0, 3.0]


def test_keep_first_and_last(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 3, "z")], "k string, o int, v string")
    assert {(r.k, r.v) for r in keep.keep_first(df, ["k"], [F.col("o")]).collect()} == {("a", "y"), (None, "z")}
    assert {(r.k, r.v) for r in keep.keep_last(df, ["k"], [F.col("o")]).collect()} == {("a", "x"), (None, "z")}


def test_stratified_takes_no_more_than_asked(spark):
    df = spark.range(900).selectExpr("id", "cast(id % 3 as string) as g", "id % 100 as v")
    out = keep.stratified(df, "id", "g", "v", 10)
    assert out.groupBy("g", "stratum").count().where("count <> 10").count() == 0
    again = keep.stratified(df, "id", "g", "v", 15)
    assert out.select("id").subtract(again.select("id")).count() == 0


def test_nearest_is_exact(spark):
    rows = [(k, [float((k * 7919) % 13), float((k * 104729) % 11), 1.0]) for k in range(200)] + [(999, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    found = nearest(df, df.where("id % 50 = 0"), "id", "v", 3).collect()

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)

    for q in (0, 50, 100, 150):
        best = sorted(((-round(cos(rows[q][1], v), 9), k) for k, v in rows[:200] if k != q))[:3]
        assert [-s for s, _ in best] == [round(r.cosine, 9) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q]


def test_tokens_by_field(spark):
    from lexigrid.operators import spans

    text = '[{"title": "Old Mill", "weight": 0.5}]'
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")
    found = spans.field_spans(df, "id", "text").orderBy("start").collect()
    assert [(r.field, text[r.start : r.end]) for r in found] == [("title", "Old Mill"), ("weight", "0.5")]
    marked = spans.labelled_tokens(spans.word_places(df, "id", "text"), spans.field_spans(df, "id", "text")).orderBy("number").collect()
    assert [r.field for r in marked] == ["structural", "title", "title", "structural", "weight"]


def test_differing_keys(spark):
    from lexigrid.operators.spans import differing_keys

    df = spark.createDataFrame([("a", 1, None, "x"), ("b", 1, 2, "y")], "name string, p int, q int, r string")
    assert {r.key for r in differing_keys(df, "name", ["r"]).collect()} == {"q"}


def test_field_token_counts_of_fenced_lists(spark, tmp_path):
    from lexigrid.plans.labels import field_token_counts

    rows = [(1, '[{"a": "xxxxxx yyyyyyyy"}]'), (2, 'Here:\n```json\n[{"a": "xxxxxx yyyyyyyy"}]\n```'), (3, '<think>[{"a": "no"}]</think> [{"a": "xxxxxx yyyyyy zzzzzzzz"}]'), (4, "no list")]
    spark.createDataFrame(rows, "label_id long, teacher_raw string").write.parquet(f"{tmp_path}/report.parquet")
    found = {}
    for r in field_token_counts(spark, str(tmp_path)).collect():
        found[r.field] = found.get(r.field, 0) + r.n_words
    assert found == {"a": 7, "structural": 3, "outside": 7}
