"""Queries that clean and check what answers say: entities and relationships of tuple records, triplets with the paths of their faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.functions import rules
from lexigrid.operators.records import tuple_records
from lexigrid.operators.titles import key
from lexigrid.plans.labels import RELATIONS, TRIPLES, triples
from lexigrid.plans.registry import query
from lexigrid.plans.sqltext import RECORDS
from lexigrid.plans.sqltext import key as key_sql
from lexigrid.session import scratch, table

# Entity types of records, and of triplets.
RECORD_TYPES = ("person", "organization", "geo", "event", "concept")
NODE_TYPES = ("entity", "concept")
_VOCABULARY = ", ".join(f"'{r}'" for r in RELATIONS)
_JUNK_SQL = r"""regexp_matches(description, '##|\*\*|<\|>|<\|COMPLETE\|>|\("entity"|\("relationship"') or len(regexp_extract_all(description, '\(')) > len(regexp_extract_all(description, '\)')) or len(regexp_extract_all(description, '"')) % 2 = 1"""


def records(spark, d):
    """Entities ``(label_id, pos, title, type, description, key)`` and relationships ``(label_id, pos, source, target, description, strength, s, t)`` of all answers with tuple records."""
    rows = table(spark, d, "report").where(F.contains("teacher_raw", F.lit("<|>"))).select("label_id", tuple_records(F.col("teacher_raw")).alias("x"))
    rows = scratch(rows, "records")  # parsed once for all that is made of them
    entities = rows.select("label_id", F.posexplode("x.entities").alias("pos", "e")).select("label_id", "pos", "e.*")
    relationships = rows.select("label_id", F.posexplode("x.relationships").alias("pos", "r")).select("label_id", "pos", "r.*")
    return entities.withColumn("key", key(F.col("title"))), relationships.withColumn("s", key(F.col("source"))).withColumn("t", key(F.col("target")))


def kept_entities(entities, passages):
    """Of each key the longest description, the first of those; keys of three characters or more that stand in the passage ``(label_id, text)``."""
    grounded = entities.where(F.length("key") >= 3).join(passages, "label_id").where(F.contains("text", F.col("key")))
    best = F.min_by(F.struct("title", "type", "description"), F.struct(-F.length("description"), "pos"))
    return grounded.groupBy("label_id", "key").agg(best.alias("x")).select("label_id", "key", "x.*")


def closed(relationships, entities):
    """Relationships that don't loop and whose both ends are keys of ``entities`` of their row."""
    ends = entities.select("label_id", "key")
    some = relationships.where("s <> '' and t <> '' and s <> t")
    for end in ("s", "t"):
        some = some.join(ends.withColumnRenamed("key", end), ["label_id", end], "left_semi")
    return some


def kept_relationships(relationships, entities):
    """Closed relationships, of each directed pair of keys the longest description, the first of those."""
    best = F.min_by(F.struct("description", "strength"), F.struct(-F.length("description"), "pos"))
    return closed(relationships, entities).groupBy("label_id", "s", "t").agg(best.alias("x")).select("label_id", "s", "t", "x.*")


_KEYED = rf"""{RECORDS}, txt as (select label_id, {key_sql('text')} as p from report where text is not null),
  ek as (select ent.*, {key_sql('title')} as key from ent), rk as (select rel.*, {key_sql('source')} as s, {key_sql('target')} as t from rel),
  ke as (select label_id, key, title, type, description from (select ek.*, row_number() over (partition by ek.label_id, key order by len(description) desc, pos) as n from ek join txt on ek.label_id = txt.label_id where len(key) >= 3 and contains(p, key)) where n = 1),
  kr as (select label_id, s, t, description, strength from (select rk.*, row_number() over (partition by label_id, s, t order by len(description) desc, pos) as n from rk where s <> '' and t <> '' and s <> t
    and exists (select 1 from ke where ke.label_id = rk.label_id and ke.key = s) and exists (select 1 from ke where ke.label_id = rk.label_id and ke.key = t)) where n = 1),
  je as (select * from ke where not ({_JUNK_SQL})), jr as (select * from kr where not ({_JUNK_SQL}) and exists (select 1 from je where je.label_id = kr.label_id and je.key = s) and exists (select 1 from je where je.label_id = kr.label_id and je.key = t))"""


def _cleaned(spark, d):
    entities, relationships = records(spark, d)
    passages = table(spark, d, "report").where("text is not null").select("label_id", key(F.col("text")).alias("text"))
    kept = kept_entities(entities, passages)
    return kept, kept_relationships(relationships, kept)


@query(f"with {_KEYED} select label_id, key, title, type, description from ke")
def clean_entities(spark, d):
    """Entities of each answer, grounded in its passage and one for each key."""
    return _cleaned(spark, d)[0]


@query(f"with {_KEYED} select label_id, s, t, description, strength from kr")
def clean_relationships(spark, d):
    """Relationships between kept entities, one for each pair of ends."""
    return _cleaned(spark, d)[1].select("label_id", "s", "t", "description", "strength")


@query(f"with {_KEYED} select e.label_id, e.n as n_entities, coalesce(r.n, 0) as n_relationships from (select label_id, count(*) as n from je group by 1) e left join (select label_id, count(*) as n from jr group by 1) r on e.label_id = r.label_id")
def junk_closure(spark, d):
    """What is left when junk descriptions go, then relationships that lost an end, then answers without entities."""
    entities, relationships = _cleaned(spark, d)
    clean = entities.where(rules.is_clean_description(F.col("description")))
    left = closed(relationships.where(rules.is_clean_description(F.col("description"))), clean)
    counts = clean.select("label_id", F.lit(1).alias("e"), F.lit(0).alias("r")).union(left.select("label_id", F.lit(0).alias("e"), F.lit(1).alias("r")))
    return counts.groupBy("label_id").agg(F.sum("e").alias("n_entities"), F.sum("r").alias("n_relationships")).where("n_entities > 0")


@query(rf"""with {RECORDS}, ek as (select ent.*, {key_sql('title')} as key from ent), rk as (select rel.*, {key_sql('source')} as s, {key_sql('target')} as t from rel),
  ef as (select label_id, title in ('', '-') as placeholder, {key_sql('type')} not in ({', '.join(f"'{t}'" for t in RECORD_TYPES)}) as oov, description = '' as blank, not regexp_matches(title, '[a-zA-Z]') and len(title) <= 3 as letterless from ek),
  rf as (select label_id, pos, s, t, description = '' as blank, s = t as looped, not (exists (select 1 from ek where ek.label_id = rk.label_id and key = s) and exists (select 1 from ek where ek.label_id = rk.label_id and key = t)) as dangling,
    row_number() over (partition by label_id, s, t order by pos) > 1 as again from rk)
  select e.*, coalesce(r.n_relationships, 0) as n_relationships, coalesce(r.empty_relations, 0) as empty_relations, coalesce(r.self_loops, 0) as self_loops, coalesce(r.dangling, 0) as dangling, coalesce(r.duplicates, 0) as duplicates from
  (select label_id, count(*) as n_entities, count(*) filter (placeholder) as placeholders, count(*) filter (oov) as type_oov, count(*) filter (blank) as empty_entities, count(*) filter (letterless) as letterless from ef group by 1) e
  left join (select label_id, count(*) as n_relationships, count(*) filter (blank) as empty_relations, count(*) filter (looped) as self_loops, count(*) filter (dangling) as dangling, count(*) filter (again) as duplicates from rf group by 1) r on e.label_id = r.label_id""")
def record_defects(spark, d):
    """Faults of each answer's records: placeholder and letterless titles, unknown types, empty descriptions, loops, ends without an entity, repeated edges."""
    entities, relationships = records(spark, d)
    e = entities.groupBy("label_id").agg(
        F.count("*").alias("n_entities"), F.count_if(F.col("title").isin("", "-")).alias("placeholders"), F.count_if(~key(F.col("type")).isin(*RECORD_TYPES)).alias("type_oov"),
        F.count_if(F.col("description") == "").alias("empty_entities"), F.count_if(~F.col("title").rlike("[a-zA-Z]") & (F.length("title") <= 3)).alias("letterless"),
    )
    ends = entities.select("label_id", "key").distinct()
    there = relationships.join(ends.select("label_id", F.col("key").alias("s"), F.lit(True).alias("has_s")), ["label_id", "s"], "left").join(ends.select("label_id", F.col("key").alias("t"), F.lit(True).alias("has_t")), ["label_id", "t"], "left")
    edges = there.groupBy("label_id", "s", "t").agg(F.count("*").alias("n"), F.count_if(F.col("description") == "").alias("empty"), F.bool_and(F.expr("has_s and has_t is not null")).alias("whole"))
    r = edges.groupBy("label_id").agg(
        F.sum("n").alias("n_relationships"), F.sum("empty").alias("empty_relations"), F.coalesce(F.sum(F.when(F.col("s") == F.col("t"), F.col("n"))), F.lit(0)).alias("self_loops"),
        F.coalesce(F.sum(F.when(~F.coalesce("whole", F.lit(False)), F.col("n"))), F.lit(0)).alias("dangling"), F.sum(F.col("n") - 1).alias("duplicates"),
    )
    names = ["n_relationships", "empty_relations", "self_loops", "dangling", "duplicates"]
    return e.join(r, "label_id", "left").fillna(0, names)


@query(rf"""select label_id, pos as triplet_index, unnest(list_filter([
    case when st is null and s is null then 'source' end, case when s is null and st is not null then 'source.title' end, case when (s is not null or st is not null) and (st is null or st not in ('entity', 'concept')) then 'source.type' end,
    case when tt is null and t is null then 'target' end, case when t is null and tt is not null then 'target.title' end, case when (t is not null or tt is not null) and (tt is null or tt not in ('entity', 'concept')) then 'target.type' end,
    case when r is null and w is null then 'relation' end, case when (r is not null or w is not null) and (r is null or r not in ({_VOCABULARY})) then 'relation.type' end, case when (r is not null or w is not null) and (w is null or not w between 0 and 1) then 'relation.weight' end],
    lambda y: y is not null)) as path from ({TRIPLES})""")
def triplet_errors(spark, d):
    """Every schema fault of every triplet with its place and path; a part with nothing in it is a fault of its own."""
    c = F.col
    node = lambda side, title, kind: [
        F.when(c(title).isNull() & c(kind).isNull(), side), F.when(c(title).isNull() & c(kind).isNotNull(), f"{side}.title"),
        F.when((c(title).isNotNull() | c(kind).isNotNull()) & (c(kind).isNull() | ~c(kind).isin(*NODE_TYPES)), f"{side}.type"),
    ]
    some = c("r").isNotNull() | c("w").isNotNull()
    relation = [F.when(~some, "relation"), F.when(some & (c("r").isNull() | ~c("r").isin(*RELATIONS)), "relation.type"), F.when(some & (c("w").isNull() | ~c("w").between(0, 1)), "relation.weight")]
    checks = F.array(*node("source", "s", "st"), *node("target", "t", "tt"), *relation)
    return triples(table(spark, d, "report")).select("label_id", c("pos").cast("long").alias("triplet_index"), F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("path"))


@query(rf"""select label_id, count(*) as n, count(*) filter (s is null or t is null or st is null or st not in ('entity', 'concept') or tt is null or tt not in ('entity', 'concept') or r is null or trim(r) = '' or w is null or not w between 0 and 1) as n_invalid from ({TRIPLES}) group by 1""")
def open_list_errors(spark, d):
    """Triplets that are invalid even where any relation may be named."""
    c = F.col
    bad = c("s").isNull() | c("t").isNull() | c("r").isNull() | (F.trim("r") == "") | c("w").isNull() | ~c("w").between(0, 1)
    for kind in ("st", "tt"):
        bad = bad | c(kind).isNull() | ~c(kind).isin(*NODE_TYPES)
    return triples(table(spark, d, "report")).groupBy("label_id").agg(F.count("*").alias("n"), F.count_if(bad).alias("n_invalid"))


@query(rf"""with x as (select label_id, pos, w, {key_sql('text')} as p, {key_sql('s')} as s, {key_sql('t')} as t from ({TRIPLES}) where text is not null)
  select label_id, pos as triplet_index, 'weight' as rule, 'relation.weight' as path from x where least(abs(w - 0.2::double), abs(w - 0.5::double), abs(w - 0.8::double)) >= 1e-9
  union all select label_id, pos, 'grounding', 'source.title' from x where s <> '' and not contains(p, s) union all select label_id, pos, 'grounding', 'target.title' from x where t <> '' and not contains(p, t)""")
def semantic_errors(spark, d):
    """Weights off the anchors and titles that the passage doesn't have, with their places; empty keys are passed over."""
    rows = table(spark, d, "report").where("text is not null").withColumn("text", key(F.col("text")))
    x = triples(rows).withColumn("s", key(F.col("s"))).withColumn("t", key(F.col("t")))
    off = F.least(*[F.abs(F.col("w") - F.lit(a)) for a in rules.WEIGHT_ANCHORS]) >= 1e-9
    fault = lambda when, rule, path: F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(path).alias("path")))
    absent = lambda c: (F.col(c) != "") & ~F.contains(F.col("text"), F.col(c))
    faults = F.array(fault(off, "weight", "relation.weight"), fault(absent("s"), "grounding", "source.title"), fault(absent("t"), "grounding", "target.title"))
    return x.select("label_id", F.col("pos").cast("long").alias("triplet_index"), F.explode(F.filter(faults, lambda v: v.isNotNull())).alias("v")).select("label_id", "triplet_index", "v.*")
