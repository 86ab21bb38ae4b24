"""Parsers, keys and pairing against cases and brute force."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.operators import linking, pairmap, records, splits
from lexigrid.operators.titles import key
from lexigrid.sources import io


def test_tuple_records(spark):
    texts = [
        'Sure.\n("entity"<|>"OLD MILL"<|>geo<|>A mill (old) by the river)##\n("entity"<|>A<|>person)\n("entity"<|><|>geo<|>no title)**##**\n("relationship"<|>OLD MILL<|>A<|>owned by (once)<|>7)\n'
        '("relationship"<|>A<|>OLD MILL<|>no strength)##("relationship"<|>A<|>B<|>high<|>99)("relationship"<|>A<|>C<|>x<|>nan)("relationship"<|>A<|>D<|>first<|>not a number)\n<|COMPLETE|>',
        '("relationship"<|>A<|>B<|>alone<|>2)<|COMPLETE|>', "no records", "", None, '("entity"<|>A<|>geo<|>cut of',
    ]
    found = records.graph_records(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t").orderBy("id").collect()
    assert [tuple(e) for e in found[0].entities] == [("OLD MILL", "geo", "A mill (old) by the river"), ("A", "person)", "")]
    assert [tuple(r) for r in found[0].relationships] == [
        ("OLD MILL", "A", "owned by (once", 7.0), ("A", "OLD MILL", "no strength", 1.0), ("A", "B", "high", 10.0), ("A", "C", "x", 1.0), ("A", "D", "first<|>not a number", 1.0),
    ]
    assert [r.entities for r in found[1:5]] == [None] * 4 and found[5].entities[0].description == "cut of"


@pytest.mark.parametrize("text, outcome, items", [
    ('[{"a": 1}, 2, {"b": [3]}]', "ok", [{"a": 1}, {"b": [3]}]), ("[]", "ok", []), ('```json\n[{"a": 1}]\n```', "ok", [{"a": 1}]), ('<think>[{"x": 1}]</think> so: [{"a": 1}] done', "ok", [{"a": 1}]),
    ('[{"x": [1, 2]}, {"y": ', "repaired", [{"x": [1, 2]}]), ('as in [3], [{"a": 1}]', "ok", [{"a": 1}]), ('{"entities": [{"t": 1}], "relationships": [{"s": 2}]}', "ok", [{"t": 1}, {"s": 2}]),
    ('{"a": 1}', "ok", [{"a": 1}]), ("[{'a': 'it\\'s'}]", "repaired", [{"a": "it's"}]), ('[{"a": "}"}, {"b": 1', "repaired", [{"a": "}"}]), ("nothing", "failed", []), (None, "failed", []), ("[[[", "failed", []),
])
def test_answers(text, outcome, items):
    found = records.parse_answer(text)
    assert found[0] == outcome and [json.loads(x) for x in found[1]] == items


def test_graph_answers():
    whole = '{"entities": [{"title": "A"}, "B"], "relationships": [{"source": "A", "target": "B"}]}'
    assert records.parse_graph(whole) == ("ok", [{"title": "A"}], [{"source": "A", "target": "B"}])
    assert records.parse_graph(whole[:-2]) == ("repaired", [{"title": "A"}], [{"source": "A", "target": "B"}])
    assert records.parse_graph('{"entities": [{"title": "A"}, {"title": ""}, {"tit') == ("repaired", [{"title": "A"}], [])
    assert records.parse_graph('{"entities": [{"title": "A"}, "relations": [{"source": "A", "target": "B"}')[1:] == ([{"title": "A"}], [{"source": "A", "target": "B"}])
    assert records.parse_graph('[{"relationship": ["P", "Q"], "strength": 9}, {"relationship": ["Q", "R"]}')[2] == [{"source": "P", "target": "Q", "strength": 9.0}, {"source": "Q", "target": "R"}]
    assert records.parse_graph('{"entities": [{"title": "A")]')[1] == [{"title": "A"}] and records.parse_graph(None) == ("failed", [], [])
    assert records.first_value('x [1, [2]] [3]', "[") == [1, [2]] and records.first_value('[1, {"a": 2}', "{") == {"a": 2} and records.first_value(None, "[") is None
    assert records.up_to_close('{"a": "}"} more') == '{"a": "}"}' and records.up_to_close('{"a": 1') == '{"a": 1'
    assert records.pair_indices('so {"pairs": [[0, 1], [null, 1], [5, 0]]}', 2, 2) == [(0, 1)]
    assert records.pair_indices('{"pairs": [[0, 1, 2]]}', 3, 3) is None and records.pair_indices('{"pairs": [["0", 1]]}', 3, 3) is None and records.pair_indices("no", 1, 1) is None


def test_keys_fold_compatibility_forms(spark):
    titles = ["ＡＢＣ　１２", "eﬃcient ﬁeld", "x² + y₃", "Ⅳ—½", "Straße_9", "café", "plain Title!", "", None, "№ 5"]
    found = [r[0] for r in spark.createDataFrame([(t,) for t in titles], "t string").select(key(F.col("t"))).collect()]
    assert found == ["abc 12", "efficient field", "x2 y3", "iv 1 2", "straße 9", "café", "plain title", "", None, "no 5"]


def test_best_matching_against_all_permutations():
    rng = random.Random(2)
    for _ in range(60):
        n, m = rng.randrange(1, 6), rng.randrange(1, 6)
        score = [[rng.choice([0.0, 0.5, rng.random()]) for _ in range(m)] for _ in range(n)]
        pairs = linking.best_matching(score)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs) == min(n, m)
        short, long = (range(n), range(m)) if n <= m else (range(m), range(n))
        best = max(sum(score[i][j] if n <= m else score[j][i] for i, j in zip(short, p)) for p in itertools.permutations(long, len(short)))
        assert abs(sum(score[i][j] for i, j in pairs) - best) < 1e-9
    assert linking.best_matching([]) == []


def test_similarity():
    assert linking.lexical_similarity("", "") == 1.0 and linking.lexical_similarity("a", "") == 0.0 and linking.lexical_similarity("same", "same") == 1.0
    assert abs(linking.lexical_similarity("old mill", "old mill river") - (0.5 * 16 / 22 + 0.5 * 2 / 3)) < 1e-12


def greedy(left, right):
    a, b = {k: i for i, k in enumerate(left) if k}, {k: i for i, k in enumerate(right) if k}
    every = sorted((-(2.0 if x == y else 1 + min(len(x), len(y)) / max(len(x), len(y))), i, j) for x, i in a.items() for y, j in b.items() if x in y or y in x)
    out = []
    for s, i, j in every:
        if all(i != p and j != q for p, q, _ in out):
            out.append((i, j, -s))
    return sorted(out)


def test_greedy_pairs_against_a_sequential_pass(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(0, 5)))
    sides = {f"p{k}": ([word() for _ in range(rng.randrange(8))], [word() for _ in range(rng.randrange(8))]) for k in range(12)}
    left, right = ([(k, i, t) for k, s in sides.items() for i, t in enumerate(s[n])] for n in (0, 1))
    found = linking.greedy_pairs(*(spark.createDataFrame(x, "id string, place int, key string") for x in (left, right))).collect()
    for k, s in sides.items():
        assert sorted((r.left_place, r.right_place, r.score) for r in found if r.id == k) == greedy(*s)


def test_passage_metrics_of_a_small_graph(spark):
    teacher = spark.createDataFrame([("p", 0, "a"), ("p", 1, "b"), ("p", 2, "c"), ("q", 0, "z")], "id string, place int, key string")
    student = spark.createDataFrame([("p", 0, "a"), ("p", 1, "b"), ("p", 2, "stone bridge"), ("p", 3, "ghost")], "id string, place int, key string")
    edges = spark.createDataFrame([("p", 0, "a", "b"), ("p", 1, "b", "c"), ("p", 2, "c", "a")], "id string, pos int, s string, t string")
    own = spark.createDataFrame([("p", 0, "a", "b"), ("p", 1, "a", "stone bridge")], "id string, pos int, s string, t string")
    pairs = spark.createDataFrame([("p", 0, 0), ("p", 1, 1)], "id string, left_place int, right_place int")
    rows = pairmap.passage_metrics(teacher, student, edges, own, pairs, spark.createDataFrame([("p", "a and b at the stone bridge")], "id string, key string")).collect()
    assert len(rows) == 1 and [rows[0][m] for m in pairmap.MEASURES] == [3, 4, 2, 2, 3, 2, 1, 1, 1, 1, 1, 1]


def test_samples_and_splits(spark):
    df = spark.range(900).selectExpr("id", "case when id % 10 < 6 then 'w' else 'a' end as s", "cast(id % 101 as int) as v")
    shares = {"w": 0.6, "a": 0.4}
    small, large = (splits.sample(df, "id", "s", "v", n, shares, df.where("id % 9 = 0")).select("id", "s") for n in (50, 90))
    assert small.count() == 50 and small.where("s = 'w'").count() == 30 and small.select("id").subtract(large.select("id")).count() == 0 and large.where("id % 9 = 0").count() == 0
    forced = spark.createDataFrame([(1, "test"), (2, "train")], "id long, split string")
    found = splits.disjoint_splits(df, "id", "s", "v", {"test": 30, "val": 9, "train": 60}, shares, forced)
    assert {r.split: r["count"] for r in found.groupBy("split").count().collect()} == {"test": 31, "val": 9, "train": 61} and found.select("id").distinct().count() == 101
    assert splits.first_ids(df, "id", 3).where("split = 'val'").agg(F.max("id")).first()[0] == 2
    assert sum(splits.quotas(101, shares).values()) == 101


def test_files(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([("a", [[0, 1], [2, 0]]), ("b", None)], "id string, pairs array<array<int>>").coalesce(1).write.json(f"{path}/pairs")
    assert sorted(tuple(r) for r in io.read_pairs(spark, f"{path}/pairs").collect()) == [("a", 0, 1), ("a", 2, 0)]
    assert io.read_from(spark, f"{path}/pairs", "id string", 1).count() == 1
    assert io.first_existing(spark, [f"{path}/no", f"{path}/pairs"]) == f"{path}/pairs"
    with pytest.raises(FileNotFoundError):
        io.first_existing(spark, [f"{path}/no"])
    rows = spark.createDataFrame([("a", [1, 2]), ("b", None)], "id string, x array<int>")
    assert [r.x for r in io.listed(rows, "x").orderBy("id").collect()] == [[1, 2], []]
    io.write_counts(rows, "id", ["x"], f"{path}/counts")
    assert sorted(tuple(r) for r in spark.read.option("header", True).csv(f"{path}/counts").collect()) == [("a", "2"), ("b", "0")]
    io.write_report(rows.limit(1), rows, f"{path}/report")
    assert spark.read.json(f"{path}/report/rows").count() == 2
    with pytest.raises(ValueError):
        io.write_report(rows, rows, f"{path}/report")
    io.write_requests(spark.createDataFrame([('{"a": 1}',)], "line string"), "line", f"{path}/requests")
    assert [r.value for r in spark.read.text(f"{path}/requests").collect()] == ['{"a": 1}']


def test_best_scores_with_ties():
    from lexigrid.operators.vectors import _best

    rng = np.random.default_rng(1)
    score, ids = rng.integers(0, 4, (7, 60)).astype(float), np.tile(rng.permutation(60), (7, 1))
    best, found = _best(score, ids, 5)
    for r in range(7):
        want = sorted(zip(-score[r], ids[r]))[:5]
        assert list(zip(-best[r], found[r])) == want
