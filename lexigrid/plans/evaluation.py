"""Queries that compare two labellings of a passage: its first label row with its last."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.functions import rules
from lexigrid.operators import pairmap
from lexigrid.operators.linking import greedy_pairs, optimal_pairs
from lexigrid.operators.titles import key
from lexigrid.plans.labels import TRIPLES, triples
from lexigrid.plans.registry import query
from lexigrid.plans.sqltext import key as key_sql
from lexigrid.session import scratch, table

_SIDES = f"""x as (select label_id, id, pos, r, {key_sql('s')} as s, {key_sql('t')} as t from ({TRIPLES}) where id is not null),
  ends as (select id, min(label_id) as a, max(label_id) as b from report where id is not null group by id),
  g as (select x.* from x join ends on x.id = ends.id and x.label_id = ends.a), p as (select x.* from x join ends on x.id = ends.id and x.label_id = ends.b),
  ge as (select distinct id, k from (select id, s as k from g union all select id, t from g) where k <> ''), pe as (select distinct id, k from (select id, s as k from p union all select id, t from p) where k <> ''),
  gd as (select distinct id, s, t from g), pd as (select distinct id, s, t from p)"""


def _two(spark, d):
    """Keyed triplets of each passage's first and last label row."""
    rows = table(spark, d, "report").where("id is not null")
    ends = rows.groupBy("id").agg(F.min("label_id").alias("a"), F.max("label_id").alias("b"))
    x = triples(rows).select("id", "label_id", "pos", "r", key(F.col("s")).alias("s"), key(F.col("t")).alias("t")).join(ends, "id")
    return x.where("label_id = a").drop("a", "b"), x.where("label_id = b").drop("a", "b")


def _entities(x):
    return x.select("id", F.explode(F.array("s", "t")).alias("k")).where("k <> ''").distinct()


def _edges(x):
    return x.select("id", "s", "t").distinct()


def _matched(gold, found, keys):
    """Gold and found rows in one grouping: ``(*keys, g, p)``; no join, no anti join."""
    both = gold.select(*keys, F.lit(1).alias("g"), F.lit(0).alias("p")).union(found.select(*keys, F.lit(0).alias("g"), F.lit(1).alias("p")))
    return both.groupBy(*keys).agg(F.max("g").alias("g"), F.max("p").alias("p"))


@query(f"""with {_SIDES} select (select count(*) from ge) as n_gold, (select count(*) from pe) as n_found, count(*) as tp, count(*)::double / (select count(*) from ge) as recall,
  count(*)::double / (select count(*) from pe) as precision from ge join pe on ge.id = pe.id and ge.k = pe.k""")
def entity_prf_micro(spark, d):
    gold, found = _two(spark, d)
    sums = _matched(_entities(gold), _entities(found), ["id", "k"]).agg(F.sum("g").alias("n_gold"), F.sum("p").alias("n_found"), F.sum(F.col("g") * F.col("p")).alias("tp"))
    return sums.select("n_gold", "n_found", "tp", rules.ratio(F.col("tp"), F.col("n_gold")).alias("recall"), rules.ratio(F.col("tp"), F.col("n_found")).alias("precision"))


@query(f"""with {_SIDES}, m as (select coalesce(ge.id, pe.id) as id, count(ge.k) as n_gold, count(pe.k) as n_found, count(*) filter (ge.k is not null and pe.k is not null) as tp from ge full join pe on ge.id = pe.id and ge.k = pe.k group by 1)
  select id, n_gold, n_found, tp from m""")
def entity_prf_passages(spark, d):
    """Entities per passage: gold, found, both. Macro means are averages over these rows."""
    gold, found = _two(spark, d)
    return _matched(_entities(gold), _entities(found), ["id", "k"]).groupBy("id").agg(F.sum("g").cast("long").alias("n_gold"), F.sum("p").cast("long").alias("n_found"), F.sum(F.col("g") * F.col("p")).cast("long").alias("tp"))


@query(f"""with {_SIDES} select (select count(*) from gd) as n_gold, (select count(*) from pd) as n_found, count(*) as tp, count(*)::double / (select count(*) from gd) as recall,
  count(*)::double / (select count(*) from pd) as precision from gd join pd on gd.id = pd.id and gd.s = pd.s and gd.t = pd.t""")
def edge_prf(spark, d):
    gold, found = _two(spark, d)
    sums = _matched(_edges(gold), _edges(found), ["id", "s", "t"]).agg(F.sum("g").alias("n_gold"), F.sum("p").alias("n_found"), F.sum(F.col("g") * F.col("p")).alias("tp"))
    return sums.select("n_gold", "n_found", "tp", rules.ratio(F.col("tp"), F.col("n_gold")).alias("recall"), rules.ratio(F.col("tp"), F.col("n_found")).alias("precision"))


@query(f"""with {_SIDES} select case when pd.id is not null then 'matched' when a.id is not null and b.id is not null then 'edge_missed' when a.id is null and b.id is null then 'both_ends_missed' else 'end_missed' end as cause, count(*) as n
  from gd left join pd on gd.id = pd.id and gd.s = pd.s and gd.t = pd.t left join pe a on gd.id = a.id and gd.s = a.k left join pe b on gd.id = b.id and gd.t = b.k group by 1""")
def edge_attribution(spark, d):
    """Why gold edges are lost: an end isn't there, or the edge between two ends that are."""
    gold, found = _two(spark, d)
    ends = _entities(found)
    rows = (
        _edges(gold).join(_edges(found).withColumn("hit", F.lit(True)), ["id", "s", "t"], "left")
        .join(ends.select("id", F.col("k").alias("s"), F.lit(True).alias("has_s")), ["id", "s"], "left").join(ends.select("id", F.col("k").alias("t"), F.lit(True).alias("has_t")), ["id", "t"], "left")
    )
    cause = F.expr("case when hit then 'matched' when has_s and has_t then 'edge_missed' when has_s is null and has_t is null then 'both_ends_missed' else 'end_missed' end")
    return rows.groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))


@query(f"""with {_SIDES} select id, sum(least(a, b))::bigint as shared, sum(a)::bigint as n_gold, sum(b)::bigint as n_found from (select id, s, r, t, count(*) filter (side = 0) as a, count(*) filter (side = 1) as b
  from (select id, s, r, t, 0 as side from g union all select id, s, r, t, 1 from p) group by id, s, r, t) group by id""")
def multiset_match(spark, d):
    """Triplets that both labellings have, counted with repeats."""
    gold, found = _two(spark, d)
    both = gold.select("id", "s", "r", "t", F.lit(1).alias("a"), F.lit(0).alias("b")).union(found.select("id", "s", "r", "t", F.lit(0).alias("a"), F.lit(1).alias("b")))
    counts = both.groupBy("id", "s", "r", "t").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return counts.groupBy("id").agg(F.sum(F.least("a", "b")).alias("shared"), F.sum("a").alias("n_gold"), F.sum("b").alias("n_found"))


@query(f"""with {_SIDES} select 'both' as side, count(*) as n from (select * from gd intersect select * from pd) union all select 'gold', count(*) from (select * from gd except select * from pd)
  union all select 'found', count(*) from (select * from pd except select * from gd)""")
def effective_pair_gap(spark, d):
    """Pairs that both labellings have and that only one has."""
    gold, found = _two(spark, d)
    counts = _matched(_edges(gold), _edges(found), ["id", "s", "t"]).agg(F.count_if(F.expr("g = 1 and p = 1")).alias("both"), F.count_if(F.expr("p = 0")).alias("gold"), F.count_if(F.expr("g = 0")).alias("found"))
    return counts.select(F.expr("stack(3, 'both', both, 'gold', gold, 'found', found) as (side, n)"))


@query(f"""with {_SIDES} select ge.id as id, ge.k as gold, count(*) as n_found from ge join pe on ge.id = pe.id and (contains(pe.k, ge.k) or contains(ge.k, pe.k)) group by 1, 2 having count(*) >= 2""")
def split_entities(spark, d):
    """Gold entities that two or more found ones contain or are contained in."""
    gold, found = _two(spark, d)
    e = _entities(found).withColumnRenamed("k", "other")
    pairs = _entities(gold).join(e, "id").where(F.contains("k", "other") | F.contains("other", "k"))
    return pairs.groupBy("id", F.col("k").alias("gold")).agg(F.count("*").alias("n_found")).where("n_found >= 2")


def _lists(spark, d):
    gold, found = _two(spark, d)
    gather = lambda x, name: x.groupBy("id").agg(F.array_sort(F.collect_set("k")).alias(name))  # noqa: E731  (one passage's entities)
    return gather(_entities(gold), "left").join(gather(_entities(found), "right"), "id")


def _paired(rounds: int = 8) -> str:
    """SQL of the greedy pairs ``m (id, lp, rp, score)``, rounds of mutual firsts written out."""
    out = """l as (select id, k, row_number() over (partition by id order by k) - 1 as place from ge), r as (select id, k, row_number() over (partition by id order by k) - 1 as place from pe),
  m0 as (select l.id, l.place as lp, r.place as rp, 2.0::double as score from l join r on l.id = r.id and l.k = r.k),
  c0 as (select l.id, l.place as lp, r.place as rp, 1 + least(len(l.k), len(r.k))::double / greatest(len(l.k), len(r.k))::double as score from l join r on l.id = r.id and (contains(l.k, r.k) or contains(r.k, l.k))
    where not exists (select 1 from m0 where m0.id = l.id and m0.lp = l.place) and not exists (select 1 from m0 where m0.id = r.id and m0.rp = r.place))"""
    for k in range(1, rounds + 1):
        out += f""",
  m{k} as (select id, lp, rp, score from (select *, row_number() over (partition by id, lp order by score desc, lp, rp) as a, row_number() over (partition by id, rp order by score desc, lp, rp) as b from c{k - 1}) where a = 1 and b = 1),
  c{k} as (select * from c{k - 1} c where not exists (select 1 from m{k} m where m.id = c.id and m.lp = c.lp) and not exists (select 1 from m{k} m where m.id = c.id and m.rp = c.rp))"""
    return out + ", m as (" + " union all ".join(f"select * from m{k}" for k in range(rounds + 1)) + ")"


_PAIRED = _paired()


def _placed(x):
    """Entities with their places, by the order of their keys."""
    place = F.row_number().over(Window.partitionBy("id").orderBy("k")) - 1
    return _entities(x).select("id", place.alias("place"), F.col("k").alias("key"))


@query(f"with {_SIDES}, {_PAIRED} select id, lp::int as left_place, rp::int as right_place, score from m")
def greedy_title_pairing(spark, d):
    """Entities of the two labellings paired one to one, equal keys first, then contained ones."""
    return greedy_pairs(*(scratch(_placed(x), "entities") for x in _two(spark, d)))


@query()
def optimal_title_pairing(spark, d):
    """One-to-one pairs with the greatest total lexical similarity, those of 0.5 or more."""
    return optimal_pairs(_lists(spark, d))


_MEASURED = f"""{_SIDES}, {_PAIRED}, txt as (select id, min_by(text, label_id) as p from report where id is not null group by id), pk as (select id, coalesce({key_sql('p')}, '') as p from txt),
  bo as (select distinct l.id from l join r on l.id = r.id),
  te as (select g.id, g.label_id, g.pos, a.place as a, b.place as b from g join l a on g.id = a.id and g.s = a.k join l b on g.id = b.id and g.t = b.k), se as (select p.id, p.label_id, p.pos, a.place as a, b.place as b from p join r a on p.id = a.id and p.s = a.k join r b on p.id = b.id and p.t = b.k),
  mt as (select te.id, te.pos, m1.rp as x, m2.rp as y from te join m m1 on te.id = m1.id and te.a = m1.lp join m m2 on te.id = m2.id and te.b = m2.lp), ms as (select se.id, se.pos, m1.lp as x, m2.lp as y from se join m m1 on se.id = m1.id and se.a = m1.rp join m m2 on se.id = m2.id and se.b = m2.rp),
  al as (select r.id, coalesce(contains(pk.p, r.k) or (len(tk) > 0 and len(list_intersect(tk, tp)) >= len(tk) * 0.6), false) as ok from (select *, list_distinct(regexp_extract_all(k, '[a-z0-9]+')) as tk from r) r join (select *, list_distinct(regexp_extract_all(p, '[a-z0-9]+')) as tp from pk) pk on r.id = pk.id
    where not exists (select 1 from m where m.id = r.id and m.rp = r.place)),
  pm as (select bo.id, (select count(*) from l where l.id = bo.id) as teacher_entities, (select count(*) from r where r.id = bo.id) as student_entities, (select count(*) from m where m.id = bo.id) as teacher_matched, (select count(*) from m where m.id = bo.id) as student_matched,
    (select count(*) from g where g.id = bo.id) as teacher_edges, (select count(*) from p where p.id = bo.id) as student_edges,
    (select count(*) from mt where mt.id = bo.id and exists (select 1 from se where se.id = mt.id and se.a = mt.x and se.b = mt.y)) as teacher_edges_matched, (select count(*) from ms where ms.id = bo.id and exists (select 1 from te where te.id = ms.id and te.a = ms.x and te.b = ms.y)) as student_edges_matched,
    (select count(*) from mt where mt.id = bo.id) as teacher_edges_eligible, (select count(*) from ms where ms.id = bo.id) as student_edges_eligible,
    (select count(*) from al where al.id = bo.id and ok) as novel_grounded, (select count(*) from al where al.id = bo.id and not ok) as ungrounded from bo)"""


@query(f"with {_MEASURED} select * from pm")
def passage_metrics(spark, d):
    """The second labelling of each passage measured against the first, over the greedy pairs of their entities."""
    gold, found = (scratch(x, "labelling") for x in _two(spark, d))
    left, right = (scratch(_placed(x), "entities") for x in (gold, found))
    rows = table(spark, d, "report").where("id is not null")
    passages = rows.groupBy("id").agg(F.min_by("text", "label_id").alias("text")).select("id", key(F.col("text")).alias("key"))
    return pairmap.passage_metrics(left, right, gold.select("id", "pos", "s", "t"), found.select("id", "pos", "s", "t"), greedy_pairs(left, right), passages)


_RATIOS = (
    ("entity_recall", "teacher_matched", "teacher_entities"), ("entity_precision", "student_matched", "student_entities"), ("edge_recall", "teacher_edges_matched", "teacher_edges"),
    ("edge_precision", "student_edges_matched", "student_edges"), ("edge_ceiling", "teacher_edges_eligible", "teacher_edges"), ("edge_conditional_recall", "teacher_edges_matched", "teacher_edges_eligible"),
    ("edge_conditional_precision", "student_edges_matched", "student_edges_eligible"), ("hallucination_rate", "ungrounded", "student_entities"),
)


@query(f"with {_MEASURED} select count(*) as n_passages, " + ", ".join(f"case when sum({b}) = 0 then 0 else sum({a})::double / sum({b})::double end as {n}" for n, a, b in _RATIOS)
       + ", case when sum(teacher_edges) = 0 then 0 else (sum(teacher_edges) - sum(teacher_edges_eligible))::double / sum(teacher_edges)::double end as loss_from_pairing, case when sum(teacher_edges) = 0 then 0 else (sum(teacher_edges_eligible) - sum(teacher_edges_matched))::double / sum(teacher_edges)::double end as loss_from_edges from pm")
def micro_scores(spark, d):
    """Ratios of the passages' sums, and the two parts of the recall that edges lack."""
    x = passage_metrics(spark, d)
    part = lambda a, b, whole: rules.ratio(F.sum(a) - F.sum(b), F.sum(whole))
    return x.agg(
        F.count("*").alias("n_passages"), *[rules.ratio(F.sum(a), F.sum(b)).alias(n) for n, a, b in _RATIOS],
        part("teacher_edges", "teacher_edges_eligible", "teacher_edges").alias("loss_from_pairing"), part("teacher_edges_eligible", "teacher_edges_matched", "teacher_edges").alias("loss_from_edges"),
    )


@query(f"with {_MEASURED} select count(*) as n_passages, " + ", ".join(f"coalesce(sum(case when {b} > 0 then cast(floor({a} * 1000000 / {b}::double) as bigint) end), 0)::bigint as {n}_millionths, count(*) filter ({b} > 0) as {n}_passages" for n, a, b in _RATIOS) + " from pm")
def macro_scores(spark, d):
    """Sums of the passages' ratios in millionths, and over how many passages; a ratio without a denominator counts for none."""
    x = passage_metrics(spark, d)
    own = lambda a, b: F.floor(F.col(a) * 1000000 / F.col(b).cast("double")).cast("long")
    return x.agg(F.count("*").alias("n_passages"), *[c for n, a, b in _RATIOS for c in (
        F.coalesce(F.sum(F.when(F.col(b) > 0, own(a, b))), F.lit(0)).alias(f"{n}_millionths"), F.count_if(F.col(b) > 0).alias(f"{n}_passages"))])


@query(f"""with {_SIDES}, m as (select coalesce(ge.id, pe.id) as id, count(ge.k) as n_gold, count(*) filter (ge.k is not null and pe.k is not null) as tp from ge full join pe on ge.id = pe.id and ge.k = pe.k group by 1)
  select rep, count(*) as n_passages, sum(tp)::bigint as tp, sum(n_gold)::bigint as n_gold, sum(tp)::double / sum(n_gold) as recall from (select m.*, unnest(range(1, 51)) as rep from m where n_gold > 0)
  where substr(md5(rep || ':' || id), 1, 1) < '8' group by rep""")
def bootstrap_recall(spark, d):
    """Recall on 50 random halves of the passages, for a confidence interval."""
    gold, found = _two(spark, d)
    m = _matched(_entities(gold), _entities(found), ["id", "k"]).groupBy("id").agg(F.sum("g").alias("n_gold"), F.sum(F.col("g") * F.col("p")).alias("tp")).where("n_gold > 0")
    reps = m.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(50)).cast("array<bigint>"))).where(F.substring(F.md5(F.concat(F.col("rep").cast("string"), F.lit(":"), F.col("id"))), 1, 1) < "8")
    return reps.groupBy("rep").agg(F.count("*").alias("n_passages"), F.sum("tp").alias("tp"), F.sum("n_gold").alias("n_gold"), (F.sum("tp").cast("double") / F.sum("n_gold")).alias("recall"))


@query("""with v as (select doc_id, annotator, category <> 'none' as y from content_labels where category is not null), m as (select doc_id, sum(case when y then 1 else -1 end) as s from v group by doc_id)
  select annotator, count(*) filter (y and s > 0) as tp, count(*) filter (y and s < 0) as fp, count(*) filter (not y and s > 0) as fn, count(*) filter (not y and s < 0) as tn from v join m on v.doc_id = m.doc_id where s <> 0 group by annotator""")
def confusion_matrix(spark, d):
    """Each annotator against the majority of each document."""
    v = table(spark, d, "content_labels").where("category is not null").select("doc_id", "annotator", F.expr("category <> 'none'").alias("y"))
    m = v.groupBy("doc_id").agg(F.sum(F.when(F.col("y"), 1).otherwise(-1)).alias("s")).where("s <> 0")
    return v.join(m, "doc_id").groupBy("annotator").agg(
        F.count_if(F.expr("y and s > 0")).alias("tp"), F.count_if(F.expr("y and s < 0")).alias("fp"), F.count_if(F.expr("not y and s > 0")).alias("fn"), F.count_if(F.expr("not y and s < 0")).alias("tn")
    )


@query(f"""with {_SIDES} select id, count(*) as n, count(*) filter (least(abs(gw - pw)) <= 0.1 + 1e-12) as close from (select gx.id, gx.w as gw, px.w as pw from
  (select x.id, x.s, x.t, x.r, min(y.w) as w from g x join ({TRIPLES}) y on x.label_id = y.label_id and x.pos = y.pos group by all) gx join
  (select x.id, x.s, x.t, x.r, min(y.w) as w from p x join ({TRIPLES}) y on x.label_id = y.label_id and x.pos = y.pos group by all) px on gx.id = px.id and gx.s = px.s and gx.t = px.t and gx.r = px.r) group by id""")
def weight_agreement(spark, d):
    """Of the triplets that both labellings have, those whose weights lie within 0.1."""
    rows = table(spark, d, "report").where("id is not null")
    ends = rows.groupBy("id").agg(F.min("label_id").alias("a"), F.max("label_id").alias("b"))
    x = triples(rows).select("id", "label_id", "r", "w", key(F.col("s")).alias("s"), key(F.col("t")).alias("t")).join(ends, "id")
    side = lambda which, name: x.where(f"label_id = {which}").groupBy("id", "s", "t", "r").agg(F.min("w").alias(name))
    return side("a", "gw").join(side("b", "pw"), ["id", "s", "t", "r"]).groupBy("id").agg(F.count("*").alias("n"), F.count_if(rules.weight_score(F.col("gw"), F.col("pw")) == 1.0).alias("close"))


@query()
def composite_scores(spark, d):
    """Per passage: entities paired one to one by similarity, exact edges, and their weighted mean.

    Measures without a denominator are left out and the others' weights scaled up.
    """
    gold, found = _two(spark, d)
    pairs = optimal_pairs(_lists(spark, d)).groupBy("id").agg(F.count("*").alias("paired"), F.avg("score").alias("similarity"))
    n = _matched(_entities(gold), _entities(found), ["id", "k"]).groupBy("id").agg(F.sum("g").alias("n_gold"), F.sum("p").alias("n_found"))
    e = _matched(_edges(gold), _edges(found), ["id", "s", "t"]).groupBy("id").agg(F.sum("g").alias("e_gold"), F.sum(F.col("g") * F.col("p")).alias("e_both"))
    rows = n.join(pairs, "id", "left").join(e, "id", "left").fillna(0, ["paired", "e_gold", "e_both"])
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    parts = [(0.3, share("paired", "n_gold")), (0.3, share("paired", "n_found")), (0.2, F.col("similarity")), (0.2, share("e_both", "e_gold"))]
    total = sum(F.when(v.isNotNull(), w).otherwise(0.0) for w, v in parts)
    score = sum(F.coalesce(v * w, F.lit(0.0)) for w, v in parts) / F.when(total > 0, total)
    return rows.select("id", "n_gold", "n_found", "paired", "similarity", score.alias("score"))
