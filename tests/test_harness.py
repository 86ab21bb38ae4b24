import itertools
import random

import pytest
from pyspark.sql import functions as F

from lexigrid.functions import rules
from lexigrid.operators import harness
from lexigrid.operators.linking import lexical_similarity
from lexigrid.plans.graphs import anchors
from lexigrid.plans.reports import at_share

T = "struct<id:string,text:string,gold:array<" + harness.TRIPLET + ">,found:array<" + harness.TRIPLET + ">>"
RELATIONS = ("part_of", "based_on")


def t(s, r, o, w=0.5, st="entity", tt="entity"):
    return (s, st, r, w, o, tt)


def scored(spark, *rows):
    return {r.id: r.asDict() for r in harness.scores(spark.createDataFrame(list(rows), T), RELATIONS).collect()}


def test_measures_of_one_passage(spark):
    gold = [t("alpha", "part_of", "beta", 0.5), t("gamma", "based_on", "delta", 0.8)]
    found = [
        t("alpha", "part_of", "beta", 0.65, tt="concept"), t("loop", "part_of", "loop"), t("epsilon", "part_of", "zeta"),  # paired, a loop, supported by the text
        t("eta", "eats", "alpha"), t("nowhere", "part_of", "alpha"), t("x", "part_of", None), t("x", "part_of", "y", 1.5),  # unknown relation, unknown end, invalid twice
    ]
    r = scored(spark, ("p", "epsilon and zeta stand here", gold, found))["p"]
    assert (r["n_gold"], r["n_pred"], r["n_items"], r["n_valid"], r["entity_tp"], r["full_tp"]) == (2, 4, 7, 5, 1, 1)
    assert (r["self_loops"], r["novel_grounded"], r["hard_hallucinations"], r["schema_valid"]) == (1, 1, 3, False)
    assert r["weight_score"] == 0.5 and r["type_agreement"] == 0 and r["relation_accuracy"] == 1
    p, q = 1 / 7, 1 / 2
    f1 = 2 * p * q / (p + q)
    assert r["entity_f1"] == pytest.approx(f1) and r["triplet_f1"] == pytest.approx(f1)
    assert r["composite"] == pytest.approx(0.30 * 5 / 7 + 0.25 * f1 + 0.20 + 0.10 * 0.5 + 0.15 * (1 - 3 / 7))


def test_empty_and_missing_answers(spark):
    one = [t("a", "part_of", "b")]
    r = scored(spark, ("both", None, [], None), ("extra", "a b", None, one), ("missed", "", one, []), ("same", "a b", one * 2, one * 2))
    assert [r[k]["composite"] for k in ("both", "extra", "missed", "same")] == pytest.approx([1, 0, 0, 1])
    assert r["missed"]["relation_accuracy"] is None and r["missed"]["schema_score"] == 1 and r["same"]["full_tp"] == 2
    assert scored(spark) == {}


def test_summary_leaves_out_missing_measures(spark):
    one = [t("a", "part_of", "b")]
    x = harness.scores(spark.createDataFrame([("m", "", one, []), ("s", "a b", one, one)], T), RELATIONS)
    r = harness.summary(x).first()
    assert (r.n_entries, r.n_gold, r.n_items, r.empty_predictions, r.schema_invalid) == (2, 2, 1, 1, 0)
    assert r.macro_relation_accuracy == 1 and r.macro_composite == 0.5 and r.micro_entity_recall == 0.5 and r.micro_entity_precision == 1
    empty = harness.summary(x.limit(0)).first()
    assert empty.n_entries == 0 and empty.micro_entity_f1 == 0 and empty.macro_composite == 0


def test_alignment_is_the_best_of_all():
    rng = random.Random(4)
    word = lambda: rng.choice(["alpha one", "alpha two", "beta", "betas", "gamma ray", "gamma rays", "delta"])
    field = lambda a, b: 1.0 if a == b else (v if (v := lexical_similarity(a, b)) >= harness.SIMILAR else 0.0)
    for _ in range(40):
        gold, found = ([(word(), rng.choice(["part_of", "based_on"]), word()) for _ in range(rng.randrange(5))] for _ in range(2))
        like = lambda g, f: 0.45 * field(g[0], f[0]) + 0.45 * field(g[2], f[2]) + 0.1 * (1.0 if g[1] == f[1] else 0.0)
        short, long = sorted((gold, found), key=len)
        most = max((sum(like(a, b) for a, b in zip(short, order)) for order in itertools.permutations(long, len(short))), default=0)
        pairs = harness.alignment(gold, found)
        assert len({p["i"] for p in pairs}) == len({p["j"] for p in pairs}) == len(pairs)
        got = sum(like(gold[p["i"]], found[p["j"]]) for p in pairs)
        assert got <= most + 1e-9 and got >= most - harness.ACCEPTED * min(len(gold), len(found))
        assert all(like(gold[p["i"]], found[p["j"]]) >= harness.ACCEPTED - 1e-9 for p in pairs)


def test_value_at_a_share_agrees_with_sorting(spark):
    rng = random.Random(8)
    rows = [(g, rng.randrange(20)) for g in "abc" for _ in range(rng.randrange(1, 60))]
    for percent in (0, 50, 90):
        found = {r.g: r.v for r in at_share(spark.createDataFrame(rows, "g string, v long"), "g", "v", percent).collect()}
        for g in "abc":
            values = sorted(v for h, v in rows if h == g)
            assert found[g] == values[percent * len(values) // 100]


def test_anchors_agree_with_union_find(spark):
    rng = random.Random(2)
    titles = {(f"p{rng.randrange(40)}", f"t{rng.randrange(45)}") for _ in range(90)}
    owners = {}
    for p, title in titles:
        owners.setdefault(title, set()).add(p)
    concrete = {title: ps for title, ps in owners.items() if 2 <= len(ps) <= 4}
    clusters = []
    for ps in concrete.values():
        meet = [c for c in clusters if c & ps]
        clusters = [c for c in clusters if not c & ps] + [set().union(ps, *meet)]
    expected = sorted((len(next(c for c in clusters if ps <= c)), title, len(ps)) for title, ps in concrete.items())
    found = anchors(spark.createDataFrame(sorted(titles), "id string, title string")).collect()
    assert sorted((r["size"], r.anchor, r.n) for r in found) == expected
    assert len({r.cluster for r in found}) == len(clusters)
    assert anchors(spark.createDataFrame([], "id string, title string")).count() == 0


def test_request_lines_and_prompts(spark):
    rows = spark.createDataFrame([("passage text", " Ada \n L", "d" * 200), ("", "B", ""), (None, "C", " x  y ")], "p string, t string, d string")
    line = rules.entry_line(F.lit("A"), F.lit("person"), F.col("t"), F.col("d"))
    r = rows.select(line.alias("a"), rules.pair_prompt(F.col("p"), line, F.lit("b"), 7).alias("q")).collect()
    assert [x.a for x in r] == ["[A] person 'Ada L' — " + "d" * 160, "[A] person 'B' — ", "[A] person 'C' — x y"]
    assert r[0].q.startswith("PASSAGE:\npassage\n\nEntity A (teacher):\n[A] person") and r[0].q.endswith("\n\nEntity B (student):\nb\n\nReturn the JSON object.")
    assert r[1].q.startswith("Entity A") and r[2].q.startswith("Entity A")


def test_relation_text(spark):
    rows = spark.createDataFrame([("part_of",), ("_based_on_",), ("",), (None,)], "r string")
    assert [x[0] for x in rows.select(rules.relation_text(F.col("r"))).collect()] == ["part of", "based on", "", None]
