"""Queries that compare ways of labelling a passage: its first label row (``pilot``) with its last (``open``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.functions import rules
from lexigrid.operators.titles import key
from lexigrid.plans.labels import RELATIONS, TRIPLES, triples
from lexigrid.plans.registry import query
from lexigrid.plans.sqltext import key as key_sql
from lexigrid.session import table

_VOCABULARY = ", ".join(f"'{r}'" for r in RELATIONS)
_GROUNDED = rf"""x as (select label_id, id, status, pos, r, s as st, t as tt, {key_sql('s')} as s, {key_sql('t')} as t, {key_sql('text')} as p from ({TRIPLES})),
  gr as (select * from x where (s = '' or contains(p, s)) and (t = '' or contains(p, t)))"""
_ENDS = "ends as (select id, min(label_id) as a, max(label_id) as b from report where id is not null group by id)"


def _keyed(rows):
    """Triplets with keys of their ends and ``grounded``: neither end's key is missing in the passage's."""
    x = triples(rows.withColumn("text", key(F.col("text")))).withColumn("source", F.col("s")).withColumn("target", F.col("t"))
    x = x.withColumn("s", key(F.col("s"))).withColumn("t", key(F.col("t")))
    fine = lambda c: (F.col(c) == "") | F.contains(F.col("text"), F.col(c))
    return x.withColumn("grounded", F.coalesce(fine("s") & fine("t"), F.lit(False)))


def _rows(spark, d):
    rows = table(spark, d, "report").where("id is not null")
    return rows.join(rows.groupBy("id").agg(F.min("label_id").alias("a"), F.max("label_id").alias("b")), "id")


@query(f"with {_GROUNDED} select count(*) as grounded, count(*) filter (r is null or r not in ({_VOCABULARY})) as out_of_set, case when count(*) = 0 then 0 else count(*) filter (r is null or r not in ({_VOCABULARY}))::double / count(*)::double end as gap from gr where status = 'ok'")
def gap_totals(spark, d):
    """Grounded triplets of good rows, and the share of relations outside the vocabulary."""
    outside = F.count_if(F.col("r").isNull() | ~F.col("r").isin(*RELATIONS))
    return _keyed(table(spark, d, "report").where("status = 'ok'")).where("grounded").agg(F.count("*").alias("grounded"), outside.alias("out_of_set"), rules.ratio(outside, F.count("*")).alias("gap"))


@query(f"with {_GROUNDED} select r as relation, count(*) as n from gr where status = 'ok' and r is not null and r not in ({_VOCABULARY}) group by 1 order by n desc, relation limit 20")
def missing_relations(spark, d):
    """The twenty commonest relations outside the vocabulary."""
    found = _keyed(table(spark, d, "report").where("status = 'ok'")).where(F.col("grounded") & ~F.col("r").isin(*RELATIONS))
    return found.groupBy(F.col("r").alias("relation")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "relation").limit(20)


@query(rf"""with {_ENDS}, x as (select distinct r.id, r.label_id = e.a as is_a, r.label_id = e.b as is_b, lower(trim(coalesce(r.s, ''))) as s, lower(trim(coalesce(r.t, ''))) as t from ({TRIPLES}) r join ends e on r.id = e.id where r.status = 'ok' and (r.label_id = e.a or r.label_id = e.b)),
  y as (select id, s, t, bool_or(is_a) as a, bool_or(is_b) as b from x group by 1, 2, 3)
  select id, count(*) filter (b) as n_open, count(*) filter (a) as n_pilot, count(*) filter (a and b) as n_both, count(*) filter (b and not a) as open_only, count(*) filter (a and not b) as pilot_only from y group by id""")
def effective_gap(spark, d):
    """Pairs of titles that each labelling of a passage connects, whatever the relation; failed rows connect none."""
    x = triples(_rows(spark, d).where("status = 'ok' and (label_id = a or label_id = b)")).select(
        "id", "label_id", F.lower(F.trim(F.coalesce("s", F.lit("")))).alias("s"), F.lower(F.trim(F.coalesce("t", F.lit("")))).alias("t")
    )
    ends = table(spark, d, "report").where("id is not null").groupBy("id").agg(F.min("label_id").alias("a"), F.max("label_id").alias("b"))
    y = x.join(ends, "id").groupBy("id", "s", "t").agg(F.bool_or(F.expr("label_id = a")).alias("a"), F.bool_or(F.expr("label_id = b")).alias("b"))
    n = lambda e: F.count_if(F.expr(e))
    return y.groupBy("id").agg(n("b").alias("n_open"), n("a").alias("n_pilot"), n("a and b").alias("n_both"), n("b and not a").alias("open_only"), n("a and not b").alias("pilot_only"))


@query(f"with {_GROUNDED} select count(*) as hard_negatives, count(*) filter (g.label_id is not null) as flipped, case when count(*) = 0 then 0 else count(*) filter (g.label_id is not null)::double / count(*)::double end as flip_rate from (select label_id from report where hard_negative) h left join (select distinct label_id from gr where status = 'ok') g on h.label_id = g.label_id")
def flip_rate(spark, d):
    """Passages held to have no triplet for which a good row has a grounded one."""
    hard = table(spark, d, "report").where("hard_negative")
    flipped = _keyed(hard.where("status = 'ok'")).where("grounded").select("label_id", F.lit(True).alias("hit")).distinct()
    n = F.count_if(F.col("hit"))
    return hard.select("label_id").join(flipped, "label_id", "left").agg(F.count("*").alias("hard_negatives"), n.alias("flipped"), rules.ratio(n, F.count("*")).alias("flip_rate"))


_MATCHED = rf"""{_ENDS}, okb as (select e.id, e.a, e.b from ends e join report x on x.label_id = e.a and x.status = 'ok' join report y on y.label_id = e.b and y.status = 'ok'),
  k as (select label_id, {key_sql('s')} as s, coalesce(r, '') as r, {key_sql('t')} as t, count(*) as n from ({TRIPLES}) group by 1, 2, 3, 4),
  n as (select o.id, coalesce((select len(triplets) from report where label_id = o.a), 0) as n_a, coalesce((select len(triplets) from report where label_id = o.b), 0) as n_b,
    coalesce((select sum(least(k1.n, k2.n)) from k k1 join k k2 on k1.s is not distinct from k2.s and k1.r = k2.r and k1.t is not distinct from k2.t where k1.label_id = o.a and k2.label_id = o.b), 0)::bigint as matched from okb o)"""
_SD = "case when count(*) < 2 then 0 else sqrt((count(*) * sum({0} * {0}) - sum({0}) * sum({0}))::double) / count(*)::double end"


@query(f"""with {_MATCHED} select count(*) as passages, case when count(*) = 0 then 0 else sum(n_a)::double / count(*)::double end as pilot_mean, {_SD.format('n_a')} as pilot_sd, case when count(*) = 0 then 0 else sum(n_b)::double / count(*)::double end as open_mean, {_SD.format('n_b')} as open_sd,
  case when count(*) = 0 then 0 else sum(matched)::double / count(*)::double end as matched_mean from n""")
def labelling_agreement(spark, d):
    """Triplets of the first and the last row of passages where both are good: means, deviations, and how many both have, repeats counted."""
    rows = _rows(spark, d).where("label_id = a or label_id = b").select("id", "label_id", "a", "b", "status", "triplets")
    sizes = rows.groupBy("id").agg(
        F.bool_and(F.coalesce(F.col("status") == "ok", F.lit(False))).alias("good"), F.sum(F.when(F.expr("label_id = a"), F.coalesce(F.size("triplets"), F.lit(0)))).alias("n_a"),
        F.sum(F.when(F.expr("label_id = b"), F.coalesce(F.size("triplets"), F.lit(0)))).alias("n_b"),
    ).where("good")
    x = triples(rows.withColumn("text", F.lit(""))).select("id", "label_id", key(F.col("s")).alias("s"), F.coalesce("r", F.lit("")).alias("r"), key(F.col("t")).alias("t"))
    ends = rows.select("id", "a", "b").distinct()
    counts = x.join(ends, "id").groupBy("id", "s", "r", "t").agg(F.count_if(F.expr("label_id = a")).alias("k_a"), F.count_if(F.expr("label_id = b")).alias("k_b"))
    matched = counts.groupBy("id").agg(F.sum(F.least("k_a", "k_b")).alias("matched"))
    n = sizes.join(matched, "id", "left").fillna(0, ["matched", "n_a", "n_b"])
    count = F.count("*")
    sd = lambda c: F.when(count < 2, F.lit(0.0)).otherwise(F.sqrt((count * F.sum(F.col(c) * F.col(c)) - F.sum(c) * F.sum(c)).cast("double")) / count.cast("double"))
    return n.agg(count.alias("passages"), rules.ratio(F.sum("n_a"), count).alias("pilot_mean"), sd("n_a").alias("pilot_sd"), rules.ratio(F.sum("n_b"), count).alias("open_mean"), sd("n_b").alias("open_sd"), rules.ratio(F.sum("matched"), count).alias("matched_mean"))


@query(f"""with {_MATCHED}, dk as (select label_id, count(*) as d from k group by 1)
  select n.id, n.matched, coalesce(da.d, 0) as gold_keys, coalesce(db.d, 0) as found_keys, case when coalesce(da.d, 0) = 0 then 0 else n.matched::double / da.d::double end as recall, case when coalesce(db.d, 0) = 0 then 0 else n.matched::double / db.d::double end as precision
  from n join okb on n.id = okb.id left join dk da on da.label_id = okb.a left join dk db on db.label_id = okb.b""")
def gold_scores(spark, d):
    """The last row's triplets against the first's where both are good: common ones with repeats, over distinct ones."""
    rows = _rows(spark, d).where("label_id = a or label_id = b").select("id", "label_id", "a", "b", "status", "triplets")
    good = rows.groupBy("id").agg(F.bool_and(F.coalesce(F.col("status") == "ok", F.lit(False))).alias("good")).where("good").select("id")
    x = triples(rows.withColumn("text", F.lit(""))).select("id", "label_id", key(F.col("s")).alias("s"), F.coalesce("r", F.lit("")).alias("r"), key(F.col("t")).alias("t"))
    counts = x.join(rows.select("id", "a", "b").distinct(), "id").groupBy("id", "s", "r", "t").agg(F.count_if(F.expr("label_id = a")).alias("k_a"), F.count_if(F.expr("label_id = b")).alias("k_b"))
    n = counts.groupBy("id").agg(F.sum(F.least("k_a", "k_b")).alias("matched"), F.count_if(F.expr("k_a > 0")).alias("gold_keys"), F.count_if(F.expr("k_b > 0")).alias("found_keys"))
    n = good.join(n, "id", "left").fillna(0, ["matched", "gold_keys", "found_keys"])
    return n.select("*", rules.ratio(F.col("matched"), F.col("gold_keys")).alias("recall"), rules.ratio(F.col("matched"), F.col("found_keys")).alias("precision"))


@query(rf"""with {_GROUNDED}, {_ENDS}, u as (select x.id, 0 as m, x.* from x join ends e on x.label_id = e.a where status = 'ok' union all select gr.id, 1 as m, gr.* from gr join ends e on gr.label_id = e.b where status = 'ok')
  select id, s, coalesce(r, '') as r, t, arg_min(st, m * 100000 + pos) as source, arg_min(tt, m * 100000 + pos) as target, string_agg(distinct case m when 0 then '0pilot' else '1open' end, ',' order by case m when 0 then '0pilot' else '1open' end) as modes from u where s is not null and t is not null group by id, s, coalesce(r, ''), t""")
def union_triplets(spark, d):
    """All triplets of a passage's two rows, with the titles that came first and the ways that gave them; of the last row only grounded ones."""
    x = _keyed(_rows(spark, d).where("status = 'ok'").drop("a", "b"))
    ends = table(spark, d, "report").where("id is not null").groupBy("id").agg(F.min("label_id").alias("a"), F.max("label_id").alias("b"))
    modes = F.filter(F.array(F.when(F.expr("label_id = a"), 0), F.when(F.expr("label_id = b and grounded"), 1)), lambda m: m.isNotNull())
    u = x.join(ends, "id").withColumn("m", F.explode(modes)).where("s is not null and t is not null")
    first = lambda c: F.min_by(c, F.col("m") * 100000 + F.col("pos"))
    names = F.array_join(F.transform(F.array_sort(F.collect_set("m")), lambda m: F.when(m == 0, "0pilot").otherwise("1open")), ",")
    return u.groupBy("id", "s", F.coalesce("r", F.lit("")).alias("r"), "t").agg(first("source").alias("source"), first("target").alias("target"), names.alias("modes"))
