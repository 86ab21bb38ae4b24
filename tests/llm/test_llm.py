"""Operators for training data against brute force, and their behaviour on odd input."""

import random
import re
import sys
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.llm import abuse, packing
from lexigrid.llm.leakage import common_subsequence, leaks
from lexigrid.llm.near_duplicates import NearDuplicates, chance_table, densified, registers
from lexigrid.llm.packing import Packing, pack, token_counts
from lexigrid.llm.quota_sample import QuotaSample, rake, repair
from lexigrid.llm.split_overlap import SplitOverlap, latest_splits
from lexigrid.llm.splitting import RangeMaximum, cuts, split_oversized, strengths
from lexigrid.llm.truncation import STRUCTURAL, Truncation, bare, double_quoted, places, poisson_head, poisson_tail

VOCABULARY = [f"w{k}" for k in range(400)]
RUNS = re.compile(r"[^\W_]+")


def folded(text):
    return RUNS.findall(unicodedata.normalize("NFKC", text or "").lower())


def grams(text, n):
    w = folded(text)
    return set(zip(*[w[k:] for k in range(n)]))


def edited(rng, text, times):
    w = text.split()
    for _ in range(times):
        w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
    return " ".join(w)


def corpus(seed, n=60, copies=4):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        text = " ".join(rng.choice(VOCABULARY) for _ in range(rng.randrange(12, 120)))
        out += [text] + [edited(rng, text, rng.randrange(0, 9)) for _ in range(rng.randrange(copies))]
    rng.shuffle(out)
    return list(enumerate(out))


def similar(rows, n, threshold, least=10):
    sets = [(k, grams(t, n)) for k, t in rows if len(folded(t)) >= least]
    return {(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[i + 1 :] if a < b and len(x & y) >= threshold * len(x | y)}


# 1 near duplicates


def test_near_duplicates_against_brute_force(spark):
    rows = corpus(1)
    df = spark.createDataFrame([(k, t, k % 3, "x") for k, t in rows], "doc long, body string, id long, grams string")  # clashing names
    found = NearDuplicates(df, "doc", "body", 3, 0.5)
    pairs = [(r.id_a, r.id_b) for r in found.pairs().collect()]
    want = similar(rows, 3, 0.5)
    assert len(pairs) == len(set(pairs))
    assert not set(pairs) - want
    assert len(want & set(pairs)) >= 0.97 * len(want)
    groups = {r.id: r.group_id for r in found.groups().collect()}
    assert all(groups[a] == groups[b] for a, b in pairs)
    assert set(groups) == {k for k, _ in rows}


def test_near_duplicates_of_odd_input(spark):
    text = " ".join(VOCABULARY[:40])
    rows = [(1, text), (2, text), (2, text), (3, None), (4, ""), (5, "too short"), (6, text * 2000), (None, text), (7, text.upper() + " !")]
    found = NearDuplicates(spark.createDataFrame(rows, "doc long, body string"), "doc", "body")
    assert {(r.id_a, r.id_b) for r in found.pairs().collect()} == similar([r for r in rows if r[0] is not None], 5, 0.8)
    assert found.pairs().count() == 6 and found.groups().count() == 4
    empty = NearDuplicates(spark.createDataFrame([], "doc long, body string"), "doc", "body")
    assert empty.pairs().count() == empty.groups().count() == 0


def test_a_large_class_of_copies_is_paired_in_blocks(spark):
    text, other = " ".join(VOCABULARY[:40]), " ".join([*VOCABULARY[:38], "x", "y"])
    df = spark.createDataFrame([(k, text) for k in range(530)] + [(1000 + k, other) for k in range(3)], "doc long, body string")
    found = NearDuplicates(df, "doc", "body", 3, 0.5)
    pairs = found.pairs()
    assert pairs.count() == pairs.distinct().count() == 533 * 532 // 2 and pairs.where("id_a >= id_b").count() == 0


def test_registers_match_as_often_as_sets_are_alike():
    rng = np.random.default_rng(2)
    pool = np.unique(rng.integers(0, 2**64 - 1, 6000, dtype=np.uint64))
    a, b = np.sort(pool[:4000]), np.sort(pool[2000:])
    regs = registers(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    used = ((regs[0] > 0) | (regs[1] > 0)).sum()
    estimate = ((regs[0] == regs[1]) & (regs[0] > 0)).sum() / used
    assert abs(estimate - 2000 / len(pool)) < 0.12
    few = registers(np.sort(pool[:5]), np.array([0, 5]))
    assert (densified(few) > 0).all()
    assert chance_table().max() < 0.02


# 2 quota samples


def test_quota_sample_meets_what_can_be_met(spark):
    rows = spark.range(5000).selectExpr("id", "case when id % 10 < 7 then 'A' when id % 10 < 9 then 'b' end as source", "cast(id % 200 as int) as words")
    targets = [("r", " a", "lo", 0, 99, 30, 2, 20), ("r", "A", "hi", 100, 199, 30, 2, 20), ("r", "B", "lo", 0, 99, 38, 2, 20), ("r", "b", "hi", 100, 199, 2, 700, 20), ("r", "c", "lo", 0, 99, 0, 1, 20), ("r", None, "lo", 0, 9, None, None, 20)]
    df = spark.createDataFrame(targets, "request_id string, source string, band string, min_words int, max_words int, share_pct int, min_rows int, sample_pct int")
    rows = rows.withColumn("source", F.lower("source"))
    q = QuotaSample(rows, df)
    report = {(r.source, r.band): r for r in q.report().collect()}
    sample = q.sample().collect()
    assert all(r.surplus == max(r.sampled - r.need, 0) and abs(r.source_residual) < 1e-6 and abs(r.band_residual) < 1e-6 for r in report.values())
    assert report["b", "hi"].short and report["b", "hi"].gap == 700 - report["b", "hi"].available and report["c", "lo"].short
    assert not report["a", "lo"].short and not report["a", "hi"].short
    assert len(sample) == len({r.id for r in sample})
    for (source, band), r in report.items():
        assert r.sampled == sum(s.source == source and s.band == band for s in sample) and r.sampled >= min(r.need, r.available)
    assert sorted(r.id for r in QuotaSample(rows, df).sample().collect()) == sorted(r.id for r in sample)


def test_quota_sample_of_nothing(spark):
    rows = spark.createDataFrame([], "id string, source string, words int")
    targets = spark.createDataFrame([("r", "a", "lo", 1, 9, 50, 3, 10)], "request_id string, source string, band string, min_words int, max_words int, share_pct int, min_rows int, sample_pct int")
    q = QuotaSample(rows, targets)
    assert [(r.available, r.need, r.short) for r in q.report().collect()] == [(0, 3, True)] and q.sample().count() == 0
    assert QuotaSample(rows, targets.limit(0)).report().count() == 0


def test_raking_meets_margins():
    source, band = np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])
    wanted = np.array([30.0, 10, 20, 40])
    fitted = rake(np.array([500.0, 400, 300, 200]), source, band, wanted)
    assert np.allclose(np.bincount(source, fitted), [40, 60]) and np.allclose(np.bincount(band, fitted), [50, 50])
    take = repair(np.array([90, 5, 3, 2]), np.array([500, 400, 300, 2]), np.array([0, 10, 20, 40]), wanted, source, 100)
    assert take.sum() == 100 and (take >= [0, 10, 20, 2]).all()


# 3 splitting


def test_pieces_cover_overlap_and_cut_at_strong_places(spark):
    rng = random.Random(4)
    words = [rng.choice(["alpha", "beta.", "gamma,", "Dr.", "end!\n\n", "line\n"]) for _ in range(1500)]
    rows = [(1, " ".join(words)), (2, "x " * 300), (3, "x " * 301), (4, None), (5, ""), (6, "y" * 5000)]
    df = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc long, body string, piece_no int")
    pieces = split_oversized(df, "doc", "body", 300, 30).orderBy("id", "piece_no").collect()
    assert {p.id for p in pieces} == {1, 3}
    own = [p for p in pieces if p.id == 1]
    assert own[0].first_word == 0 and own[-1].first_word + own[-1].n_words == 1500
    for a, b in zip(own, own[1:]):
        assert b.first_word == a.first_word + a.n_words - 30 and 150 <= a.n_words <= 300
        assert a.piece.split()[-30:] == b.piece.split()[:30]
        assert a.cut_strength == 5
    assert [p.n_words for p in pieces if p.id == 3] == [300, 31]


def test_range_maximum_against_brute_force():
    values = np.random.default_rng(1).integers(0, 4, 200)
    table = RangeMaximum(values, 64)
    for low in range(0, 150, 7):
        for high in range(low, min(low + 64, 200), 5):
            best = max(range(low, high + 1), key=lambda k: (values[k], k))
            assert table.rightmost(low, high) == best
    assert cuts(np.zeros(9, int), 20, 2, 10) == [(0, 10)]


def test_strengths_of_boundaries():
    text = "One, two; three. Four Dr. five\nsix\n\nseven"
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    assert strengths(text, spans).tolist() == [1, 2, 3, 0, 0, 4, 5]


# 4 overlap across splits


def test_split_overlap_against_brute_force(spark):
    rows = corpus(7, n=50)
    rng = random.Random(8)
    split = {k: rng.choice(["train", "train", "val", "test"]) for k, _ in rows if rng.random() < 0.9}
    titled = [(1000, None, "The Title!"), (1001, "short", "the  title"), (1002, "", None), (1003, None, "the title"), (1004, None, " ")]
    split |= {1000: "train", 1001: "test", 1002: "train", 1003: "train", 1004: "test"}
    df = spark.createDataFrame([(k, t, None, "c") for k, t in rows] + [(k, t, n, "c") for k, t, n in titled], "doc long, body string, name string, split string")
    found = SplitOverlap(df, spark.createDataFrame(list(split.items()), "id long, split string"), "doc", "body", "name", 3, 0.5)
    pairs = [(min(r.eval_id, r.train_id), max(r.eval_id, r.train_id)) for r in found.pairs.collect()]
    want = {p for p in similar(rows, 3, 0.5) if p[0] in split and p[1] in split and (split[p[0]] == "train") != (split[p[1]] == "train")}
    want |= {(1000, 1001), (1001, 1003)}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def overlaps(spark, rows):
    """Found and true pairs of ``(id, text)`` rows whose even ids are for training."""
    df = spark.createDataFrame([(k, t, None) for k, t in rows], "doc long, body string, name string")
    split = spark.createDataFrame([(k, "test" if k % 2 else "train") for k, _ in rows], "id long, split string")
    pairs = [(min(r.eval_id, r.train_id), max(r.eval_id, r.train_id)) for r in SplitOverlap(df, split, "doc", "body", "name", 3, 0.5).pairs.collect()]
    assert len(pairs) == len(set(pairs))
    return set(pairs), {p for p in similar(rows, 3, 0.5) if (p[0] + p[1]) % 2}


def test_split_overlap_of_reordered_and_evenly_edited_texts(spark):
    rng = random.Random(31)
    rows = []
    for k in range(30):
        units = [[rng.choice(VOCABULARY) for _ in range(8)] for _ in range(15 + 4 * k)]
        other = [list(u) for u in units]
        if k % 3:
            rng.shuffle(other)
        else:
            for u in other:
                u[4] = "other"
        rows += [(2 * k, " ".join(w for u in units for w in u)), (2 * k + 1, " ".join(w for u in other for w in u))]
    some = " ".join(rng.choice(VOCABULARY) for _ in range(36))
    rows += [(100, some), (101, " ".join([some] * 3))]  # few words, repeated to many
    found, want = overlaps(spark, rows)
    assert found == want and len(want) > 20


def test_split_overlap_of_a_family_of_versions(spark):
    rng = random.Random(32)
    text = [rng.choice(VOCABULARY) for _ in range(60)]
    versions = []
    for k in range(150):
        w = list(text)
        for at in rng.sample(range(60), 3):
            w[at] = f"own{k}x{at}"
        versions.append((k, " ".join(w)))
    found, want = overlaps(spark, versions + [(200, " ".join(text)), (201, " ".join(text))])
    assert found == want and len(want) > 4000


def test_split_overlap_deals_frequent_grams_to_blocks(monkeypatch):
    from lexigrid.llm import split_overlap

    monkeypatch.setattr(split_overlap, "BLOCK", 3)
    counts, ids = np.full(split_overlap.CELLS, 20, np.int32), np.arange(50, dtype=np.int64)
    one = np.full(50, 12345, np.uint64)
    sides = [list(zip(*split_overlap.join_keys(one, ids, counts, 2, held))) for held in (True, False)]
    met = [(a, b) for x, a in sides[0] for y, b in sides[1] if x == y]
    assert len(met) == len(set(met)) == 2500 and len({x for x, _ in sides[0]}) == 49


def test_split_overlap_of_nothing(spark):
    df = spark.createDataFrame([], "doc long, body string, name string")
    assert SplitOverlap(df, spark.createDataFrame([], "id long, split string"), "doc", "body", "name").pairs.count() == 0


def test_split_overlap_plans_stay_small(spark):
    rows = corpus(7, n=20)
    df = spark.createDataFrame([(k, t, None) for k, t in rows], "doc long, body string, name string")
    split = spark.createDataFrame([(k, "test" if k % 2 else "train") for k, _ in rows], "id long, split string")
    plan = SplitOverlap(df, split, "doc", "body", "name", 3, 0.5).pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 15 and "Broadcast" not in plan  # three times what one meeting of two tables takes


def test_latest_splits(spark):
    rows = [(1, " VAL ", "2024-01-01"), (1, "train", "2023-01-01"), (1, None, "2025-01-01"), (2, "validation", "2024-01-01"), (None, "test", "2024-01-01")]
    df = spark.createDataFrame(rows, "article_id long, split string, t string").selectExpr("article_id", "split", "cast(t as timestamp) as assigned_at")
    assert {(r.id, r.split) for r in latest_splits(df).collect()} == {(1, "val"), (2, "val")}


# 5 truncation


CLOSED, DOUBTFUL, OPEN = "closed", "doubtful", "open"
ENDINGS = [
    ('[{"a": "b"}]', CLOSED), ('```json\n[{"a": 1}]\n```\n', CLOSED), ('```json\n[{"a": 1}]', OPEN), ('[{"a": "b', OPEN), ('[{"a": {"t": "x"}}', OPEN), ('[{"a": 1},]', CLOSED), ("[]", CLOSED),
    ('[{"a": "one ] two.', OPEN), ("[{'a': 'it\\'s'}]", CLOSED), ('[{"a": 1}}]', CLOSED), ('[{"a": 1}]\nI read it twice.', CLOSED), ('[{"a": 1}]\nI read it tw', OPEN), ('[{"a": 1}]\n…', OPEN),
    ('("entity"<|>A<|>geo<|>x)\n<|COMPLETE|>\n', CLOSED), ('("entity"<|>A<|>geo<|>x)\n##', OPEN), ('("enti', OPEN), ("A whole sentence.", CLOSED), ('All is said. ("done")', CLOSED), ("The passage does not na", OPEN),
    ("The passage does not name any...", OPEN), ("<think>hm.</think>\n[]", CLOSED), ("<think>hm, and", OPEN), ("None", DOUBTFUL),
]


def answers(rng, n):
    """Whole answers of many forms."""
    word = lambda: rng.choice(VOCABULARY)
    prose = lambda k: " ".join(f"The {word()} of {word()}, not {word()}, was {word()}." for _ in range(k))
    out = []
    for _ in range(n):
        items = [f'{{"a": {{"t": "{word()}{rng.choice(["", ".", " ]"])} {word()}{rng.choice(["", "", "."])}"}}, "w": 0.{rng.randrange(10)}}}' for _ in range(rng.randrange(1, 6))]
        items += [f'{{"b": "{word()}{rng.choice([".", " ]"])} {word()}{rng.choice(["", "."])}"}}']
        whole = "[" + ", ".join(items) + "]"
        records = "\n##\n".join(f'("entity"<|>{word()}<|>geo<|>{prose(1)})' for _ in range(rng.randrange(1, 5)))
        out.append(rng.choice([
            whole, whole, f"```json\n{whole}\n```", f"Here is the list:\n```json\n{whole}\n```", f"{whole}\n{prose(1)}", f"<think>{prose(2)}</think>\n{whole}", whole.replace('"', "'"),
            records + "\n<|COMPLETE|>", prose(3), prose(1) + ' ("done")', "None",
        ]))
    return out


def test_cut_answers_are_found_by_hazards(spark):
    rng = random.Random(17)
    rows = [(k, t, "s" if k % 2 else None, False) for k, t in enumerate(answers(rng, 3000))]
    rows += [(10_000 + k, t[: rng.randrange(len(t) // 3, len(t) - 4)], "s", True) for k, t in enumerate(answers(rng, 300)) if len(t) > 60]
    rows += [(20_000 + k, t, "s", state == OPEN) for k, (t, state) in enumerate(ENDINGS)]
    df = spark.createDataFrame([r[:3] for r in rows], "label long, raw string, src string")
    found = Truncation(df, "label", "raw", "src")
    got = {r.id: r for r in found.rows.collect()}
    assert [t for t, (k, s) in zip(ENDINGS, [(20_000 + k, e) for k, (_, e) in enumerate(ENDINGS)]) if got[k].truncated != (s == OPEN)] == []
    assert sum(got[r[0]].truncated for r in rows if r[0] < 10_000) == 0
    cut = [r for r in rows if 10_000 <= r[0] < 20_000]
    # a cut behind a sentence or a list can't be told from an end
    assert sum(got[r[0]].truncated for r in cut) >= 0.93 * len(cut)
    assert {got[r[0]].route for r in cut} <= {"transfer", "limit", None}


def test_nothing_is_cut_without_hazards(spark, monkeypatch):
    from lexigrid.llm import truncation

    rng = random.Random(18)
    texts = answers(rng, 600) + [t[: len(t) // 2] for t in answers(rng, 60)]
    df = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "label long, raw string, src string")
    assert Truncation(df, "label", "raw", "src").rows.where("truncated").count() > 30
    found = truncation.place_hazards
    monkeypatch.setattr(truncation, "place_hazards", lambda *a: found(*a).withColumns({"ending": F.lit(False), "passing": F.lit(False)}))
    lengths = truncation.length_hazards
    monkeypatch.setattr(truncation, "length_hazards", lambda *a: lengths(*a).withColumn("significant", F.lit(False)))
    assert Truncation(df, "label", "raw", "src").rows.where("truncated").count() == 0


def test_a_limit_decides_where_places_do_not(spark, monkeypatch):
    from lexigrid.llm import truncation

    found = truncation.place_hazards
    monkeypatch.setattr(truncation, "place_hazards", lambda *a: found(*a).withColumns({"ending": F.lit(False), "passing": F.lit(False)}))
    rng = random.Random(19)
    rows = [(k, "x" * rng.randrange(20, 500), "s") for k in range(400)] + [(1000 + k, "y" * 80 + " \n" * (k % 2), "s") for k in range(40)]
    got = {r.id: r for r in Truncation(spark.createDataFrame(rows, "label long, raw string, src string"), "label", "raw", "src").rows.collect()}
    assert {k for k, r in got.items() if r.truncated} == {1000 + k for k in range(40)} | {k for k, t, _ in rows[:400] if len(t) in (80, 82)}
    assert {r.route for r in got.values()} == {"limit", None}


def test_places_of_characters():
    place, bounds, _ = places(['[{"a": "b)"}] x', 'A "b" c', double_quoted("[{'a': 'b)'}] x"), ""])
    one, other, single = (place[a : b - 1] for a, b in zip(bounds, bounds[1:4]))
    assert (one[[6, 13]] == -1).all() and len(set(one[[0, 1, 4, 8, 11, 12, 14]])) == 7
    assert (one[[0, 1, 11, 12, 14]] == single[[0, 1, 11, 12, 14]]).all()
    assert (other[[0, 2]] >= STRUCTURAL).sum() == 1 and place[bounds[3]] == -1
    assert bare("cut ... \n…") == "cut" and bare("x [truncated]") == "x" and bare("…") == ""


def test_truncation_finds_limits(spark):
    rng = random.Random(6)
    rows = []
    for k in range(3000):
        text = "A short claim. " * rng.randrange(2, 60) + "x" * rng.randrange(0, 14) + "."
        rows.append((k, text[:400] if len(text) > 400 else text, "s" if k % 2 else None))
    rows += [(9001, None, "s"), (9002, " \n", "s"), (9003, "None", "s")]
    df = spark.createDataFrame(rows, "label long, raw string, src string")
    found = Truncation(df, "label", "raw", "src")
    limits = {(r.source, r.length) for r in found.hazards.where("significant and unit = 'chars'").collect()}
    assert {("s", 400), (None, 400)} <= limits
    got = {r.id: r for r in found.rows.collect()}
    assert 9001 not in got and 9002 not in got and not got[9003].truncated
    cut = {k for k, t, _ in rows[:3000] if not t.rstrip().endswith(".")}
    assert {k for k, r in got.items() if r.truncated} == cut and all(got[k].at_limit for k in cut)
    assert sum(r.n_rows for r in found.rates().collect()) == 3001


def test_truncation_of_nothing(spark):
    found = Truncation(spark.createDataFrame([], "label long, raw string, src string"), "label", "raw", "src")
    assert found.rows.count() == found.rates().count() == 0
    found = Truncation(spark.createDataFrame([(1, "…", None), (1, "…", None), (2, "\u200b", "s")], "label long, raw string, src string"), "label", "raw", "src")
    assert found.rows.count() == 3


def test_poisson_tail(spark):
    head = spark.createDataFrame([(5, 1.0), (1, 3.0), (0, 900.0)], "n long, m double").select(poisson_head("n", "m").alias("p")).collect()
    assert head[0].p == 1.0 and abs(head[1].p - 0.1991483) < 1e-6 and head[2].p < 1e-200
    row = spark.createDataFrame([(0, 1.0), (3, 1.0), (200, 1.0)], "n long, m double").select(poisson_tail("n", "m").alias("p")).collect()
    assert row[0].p == 1.0 and abs(row[1].p - 0.0803014) < 1e-6 and row[2].p < 1e-200


# 6 packing


def containers_of(rows, counts, capacity):
    load, seen = {}, {}
    for size, low, high, per, first in rows:
        for number in range(low, high):
            at = first + (number - low) // per
            load[at] = load.get(at, 0) + size
            seen[size] = seen.get(size, 0) + 1
    assert seen == counts and max(load.values()) <= capacity
    return load


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pack_places_every_item_once(seed):
    rng = np.random.default_rng(seed)
    sizes, counts = np.unique(np.minimum(rng.gamma(2, 40, 4000).astype(int) + 1, 256), return_counts=True)
    load = containers_of(pack(sizes, counts, 256), dict(zip(sizes.tolist(), counts.tolist())), 256)
    assert len(load) <= 1.01 * np.ceil((sizes * counts).sum() / 256) + 1
    assert pack(np.array([], int), np.array([], int), 8) == []


def test_the_program_beats_first_fit_and_bounds_it():
    sizes, counts = np.unique(np.random.default_rng(5).choice([341, 342, 300, 400, 171], 20_000), return_counts=True)
    found, bound, plain = packing.solved(sizes, counts, 1024)
    load = containers_of(found.rows, dict(zip(sizes.tolist(), counts.tolist())), 1024)
    assert -(-int((sizes * counts).sum()) // 1024) < bound <= len(load) == found.n < plain
    few = packing.solved(np.array([3, 5]), np.array([1, 2]), 8)
    assert few[0].n == few[1] == 2


def test_knapsack_against_brute_force():
    sizes, price = np.array([3, 5, 7]), np.array([3.1, 5.6, 7.4])
    pattern = packing.best_pattern(sizes, price, 20)
    best = max(price @ np.array([a, b, c]) for a in range(7) for b in range(5) for c in range(3) if a * 3 + b * 5 + c * 7 <= 20)
    assert pattern @ sizes <= 20 and abs(price @ pattern - best) < 1e-9


def test_packing_of_documents(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choice(VOCABULARY) for _ in range(rng.randrange(1, 80)))) for k in range(300)] + [(900, "word " * 3000), (901, None), (902, "")]
    rows += [(2000 + k, "the same text") for k in range(200)]
    kinds = spark.createDataFrame([("small", 128), ("large", 512), ("bad", 0)], "container_kind string, capacity_tokens int")
    sizes = token_counts(spark.createDataFrame(rows, "doc long, body string"), "doc", "body")
    p = Packing(sizes, kinds)
    total = sizes.agg(F.sum("n_tokens")).first()[0]
    items = p.items.collect()
    for kind, capacity in (("small", 128), ("large", 512)):
        own = [r for r in items if r.container_kind == kind]
        load, done = {}, {}
        for r in own:
            load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
            done.setdefault(r.id, []).append((r.first_token, r.n_tokens))
        assert sum(load.values()) == total and max(load.values()) <= capacity and set(load) == set(range(len(load)))
        for key, parts in done.items():
            parts.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and (len(parts) == 1 or sum(n for _, n in parts) > capacity)
    assert min(r.fill for r in p.fill().collect()) > 0.95
    assert Packing(sizes.limit(0), kinds).items.count() == 0


def test_packing_sends_no_items_to_the_driver(spark):
    kinds = spark.createDataFrame([("small", 128), ("large", 512)], "container_kind string, capacity_tokens int")
    p = Packing(spark.range(2000).selectExpr("id", "cast(id % 300 + 1 as int) as n_tokens"), kinds)
    assert sum(r.n_tokens for r in p.items.collect()) == 2 * sum(k % 300 + 1 for k in range(2000))
    plan = p.items._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 2  # tables as small as these would be broadcast otherwise


# 7 leakage


def test_leaks_against_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"n{k}" for k in range(3000)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(30, 70)))) for k in range(25)] + [(100, None), (101, "few words")]
    docs = []
    for k in range(300):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 250))]
        if k % 3 == 0:
            w = rng.choice(items[:25])[1].split()
            part = w[: int(len(w) * rng.choice([0.3, 0.5, 0.7, 1.0]))]
            at = rng.randrange(len(words))
            words[at:at] = part
        docs.append((k, " ".join(words)))
    docs += [(900, None), (901, ""), (902, "z " * 20000)]
    df = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc long, body string, item_id int")
    found = {(r.doc_id, r.item_id) for r in leaks(df, spark.createDataFrame(items, "item long, body string"), "doc", "body", "item", "body").where("kind <> 'paraphrase'").collect()}
    want = {(d, i) for d, t in docs for i, x in items if grams(x, 5) and len(grams(x, 5) & grams(t, 5)) >= 0.4 * len(grams(x, 5))}
    assert not found - want and len(found) >= 0.97 * len(want)
    assert leaks(df.limit(0), spark.createDataFrame(items, "item long, body string"), "doc", "body", "item", "body").count() == 0


def test_common_subsequence():
    a, b = np.array([1, 2, 3, 4], np.uint64), np.array([2, 9, 4, 3], np.uint64)
    assert common_subsequence(a, b) == 2 and common_subsequence(a, b[:0]) == 0


def test_candidates_of_edited_and_reordered_items(spark):
    rng = random.Random(23)
    common = [f"c{k}" for k in range(60)]
    word = lambda: rng.choice(common if rng.random() < 0.5 else VOCABULARY)
    items = [(k, " ".join(word() for _ in range(rng.randrange(34, 120)))) for k in range(60)]
    docs, rows = [], 0
    for k in range(600):
        w = rng.choice(items)[1].split()
        if k % 3 == 0:
            w = [x if j % 9 else word() for j, x in enumerate(w, 1)]
        elif k % 3 == 1:
            units = [w[j : j + 8] for j in range(0, len(w), 8)]
            rng.shuffle(units)
            w = [x for u in units for x in u]
        else:
            n = int(len(w) * 0.5)
            w = w[(at := rng.randrange(len(w) - n)) : at + n]
        around = [word() for _ in range(rng.randrange(200))]
        at = rng.randrange(len(around) + 1)
        docs.append((k, " ".join(around[:at] + w + around[at:])))
    found = leaks(spark.createDataFrame(docs, "doc long, body string"), spark.createDataFrame(items, "item long, body string"), "doc", "body", "item", "body").collect()
    got = {(r.doc_id, r.item_id) for r in found if r.kind != "paraphrase"}
    sets = [(i, grams(x, 5)) for i, x in items]
    want = {(d, i) for d, t in docs for own in [grams(t, 5)] for i, g in sets if len(g & own) >= 0.4 * len(g)}
    assert not got - want and len(got) >= 0.99 * len(want) and len(want) > 500


def test_item_index_finds_what_a_full_search_does():
    from lexigrid.llm.leakage import FEATURES, RANK, ItemIndex, unit

    rng = np.random.default_rng(9)
    words = [f"v{k}" for k in range(500)]
    index = ItemIndex(list(range(80)), [" ".join(rng.choice(words, 50)) for _ in range(80)], 5, rng.standard_normal((FEATURES, RANK)).astype(np.float32))
    asked = unit(index.vectors + 0.05 * rng.standard_normal(index.vectors.shape).astype(np.float32))
    row, item, score = index.near(asked, 0.2, 0.8)
    full = {(r, int(i)) for r, k in zip(*np.nonzero(asked @ index.vectors.T >= 0.8)) for i in [index.of[k]]}
    got = set(zip(row.tolist(), item.tolist()))
    assert got <= full and len(got) >= 0.97 * len(full) and (score >= 0.8).all()
    assert all(len(x) == 0 for x in index.near(asked[:0], 0.2, 0.5))


# 8 abusive content


def test_disguises_are_undone():
    t = abuse.Tokens()
    assert abuse.sentences("You I.d.i.o.t! The d r e c k word. n1ce cre​eeetín", t) == [" you idiot ", " the dreck word ", " nice cretin "]
    assert abuse.sentences("", t) == []


def test_tokens_are_undone_alike_with_and_without_marks():
    t = abuse.Tokens()
    assert abuse.sentences("b a d - a b c d x. y! so a fooool, <br> aa. Bb? e.g. no", t) == [" b a d abcdx y ", " so a fol a b ", " e g ", " no "]
    assert abuse.sentences("!! \0 \1a\n\n - \n\n\u00e9 \u00e0 l o w?", t) == [" a ", " ealo w "]


def test_known_tokens_take_no_step_of_python_each():
    text, calls, tokens = " ".join(["plain words, it'5 a <b>bold</b> end."] * 500), [], abuse.Tokens()
    want = abuse.sentences(text, tokens)
    sys.setprofile(lambda frame, event, what: calls.append(event))
    try:
        assert abuse.sentences(text, tokens) == want
    finally:
        sys.setprofile(None)
    assert len(want) == 500 and len(calls) < 100


def test_classifier_on_held_out_documents(spark):
    rng = random.Random(12)
    bad = ["you are a filthy zorg", "go away you blasted zorg", "all grumbles are vermin zorgs"]

    def make(k):
        offends = k % 4 == 0
        parts = [f"The {rng.choice(VOCABULARY)} stands near the {rng.choice(VOCABULARY)} of {rng.choice(VOCABULARY)}" for _ in range(rng.randrange(3, 9))]
        if offends:
            parts.insert(rng.randrange(len(parts)), rng.choice(bad))
        return k, ". ".join(parts) + ".", offends

    rows = [make(k) for k in range(800)]
    df = spark.createDataFrame([(k, t, "s" if k % 2 else None) for k, t, _ in rows] + [(5000, None, "s"), (5001, " ", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(k, "a", ("abusive" if y else "none") if k % 37 else "none") for k, _, y in rows[:400]] + [(3, "b", None), (None, "a", "none")], "doc_id long, annotator string, category string")
    model = abuse.train(df.select("doc_id", "text"), labels)
    scored = abuse.score_documents(df, model)
    got = {r.doc_id: r.offends for r in scored.collect()}
    right = sum(got[k] == y for k, _, y in rows[400:])
    assert right >= 0.97 * 400 and not got[5000] and not got[5001] and len(got) == 802
    assert sum(r.n_docs for r in abuse.source_rates(scored).collect()) == 802
    none = abuse.train(df.select("doc_id", "text"), labels.limit(0))
    assert abuse.score_documents(df, none).where("offends").count() == 0


def test_ratios_count_labels_outside_the_sample(spark):
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(6)) for _ in range(400)]  # numbers are folded
    rows = []
    for k in range(900):
        parts = [f"The {rng.choice(words)} stands near the {rng.choice(words)} of {rng.choice(words)}" for _ in range(4)]
        if k % 3 == 0:
            parts.insert(2, f"you {rng.choice(words)} quyxvamp" if k % 30 == 0 else f"you are a filthy zorg {rng.choice(words)}")
        rows.append((k, ". ".join(parts) + ".", "abusive" if k % 3 == 0 else "none"))
    df = spark.createDataFrame(rows, "doc_id long, text string, category string")
    sample = df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(60).collect()
    assert sum("quyxvamp" in r.text for r in sample) < 3
    model = abuse.train(df.select("doc_id", "text"), df.select("doc_id", "category"), sample=60)
    assert model.weight[abuse.sentence_features([" quyxvamp "])[0]].min() > 0
