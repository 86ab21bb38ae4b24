"""Queries over label rows: counting, validation, grounding, merging, requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.functions import rules
from lexigrid.functions.text import squeeze, word_count
from lexigrid.operators import keep
from lexigrid.operators import spans
from lexigrid.operators.records import graph_records, parsed_answers
from lexigrid.plans.corpus import squeezed
from lexigrid.operators.titles import key
from lexigrid.plans.registry import query
from lexigrid.plans.sqltext import RECORDS
from lexigrid.plans.sqltext import key as key_sql
from lexigrid.session import table

# Relation types of the closed vocabulary.
RELATIONS = (
    "implements", "trained_on", "evaluates", "part_of", "introduces", "extends", "depends_on", "contrasts_with", "applied_to", "measured_by",
    "founded_by", "developed_by", "defined_as", "consists_of", "is_type_of", "based_on", "used_for", "created_by", "located_in", "predecessor_of",
)
_VOCABULARY = ", ".join(f"'{r}'" for r in RELATIONS)

TRIPLES = """select label_id, id, status, text, i - 1 as pos, t.source.title as s, t.source.type as st, t.relation.type as r, t.relation.weight as w, t.target.title as t, t.target.type as tt
  from (select label_id, id, status, text, unnest(triplets) as t, generate_subscripts(triplets, 1) as i from report)"""


def triples(rows):
    """One row per triplet: ``label_id, id, status, text, pos, s, st, r, w, t, tt``."""
    return rows.select("label_id", "id", "status", "text", F.posexplode("triplets").alias("pos", "x")).select(
        "label_id", "id", "status", "text", "pos", F.col("x.source.title").alias("s"), F.col("x.source.type").alias("st"),
        F.col("x.relation.type").alias("r"), F.col("x.relation.weight").alias("w"), F.col("x.target.title").alias("t"), F.col("x.target.type").alias("tt"),
    )


@query("""select coalesce(x, '') as relation, count(*) as n from (
  select unnest(case when len(triplets) > 0 then list_transform(triplets, lambda y: y.relation.type) else [null] end) as x from report) group by 1""")
def relation_usage(spark, d):
    """Histogram of relations; rows without triplets under the empty name."""
    rows = table(spark, d, "report").select(F.explode_outer("triplets.relation.type").alias("x"))
    return rows.groupBy(F.coalesce("x", F.lit("")).alias("relation")).agg(F.count("*").alias("n"))


@query("""select source, count(*) as total, count(*) filter (status = 'ok') as ok, count(*) filter (status <> 'ok') as failed, count(*) filter (hard_negative) as hard_negatives,
  count(*) filter (len(semantic_violations) > 0) as with_violations, sum(attempts)::bigint as attempts from report group by source""")
def label_stats(spark, d):
    return table(spark, d, "report").groupBy("source").agg(
        F.count("*").alias("total"), F.count_if(F.expr("status = 'ok'")).alias("ok"), F.count_if(F.expr("status <> 'ok'")).alias("failed"),
        F.count_if(F.expr("hard_negative")).alias("hard_negatives"), F.count_if(F.expr("size(semantic_violations) > 0")).alias("with_violations"), F.sum("attempts").alias("attempts"),
    )


@query("select failure_reason, status, count(*) as n from report group by all")
def failure_reasons(spark, d):
    return table(spark, d, "report").groupBy("failure_reason", "status").agg(F.count("*").alias("n"))


@query("select v.rule as rule, count(*) as n, count(distinct label_id) as n_rows from (select label_id, unnest(semantic_violations) as v from report) group by 1")
def violation_counts(spark, d):
    return table(spark, d, "report").select("label_id", F.explode("semantic_violations").alias("v")).groupBy(F.col("v.rule").alias("rule")).agg(
        F.count("*").alias("n"), F.countDistinct("label_id").alias("n_rows")
    )


@query(rf"""select problem, count(*) as n from (select unnest(list_filter([
    case when s is null or trim(s) = '' then 'source.title' end, case when t is null or trim(t) = '' then 'target.title' end,
    case when st is null or st not in ('entity', 'concept') then 'source.type' end, case when tt is null or tt not in ('entity', 'concept') then 'target.type' end,
    case when r is null or r not in ({_VOCABULARY}) then 'relation.type' end, case when w is null or not w between 0 and 1 then 'relation.weight' end],
    lambda x: x is not null)) as problem from ({TRIPLES})) group by 1""")
def triplet_validate(spark, d):
    """Schema rules that triplets break, all of them counted."""
    c = F.col
    checks = F.array(
        F.when(c("s").isNull() | (F.trim("s") == ""), F.lit("source.title")), F.when(c("t").isNull() | (F.trim("t") == ""), F.lit("target.title")),
        F.when(c("st").isNull() | ~c("st").isin("entity", "concept"), F.lit("source.type")), F.when(c("tt").isNull() | ~c("tt").isin("entity", "concept"), F.lit("target.type")),
        F.when(c("r").isNull() | ~c("r").isin(*RELATIONS), F.lit("relation.type")), F.when(c("w").isNull() | ~c("w").between(0, 1), F.lit("relation.weight")),
    )
    return triples(table(spark, d, "report")).select(F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


@query(f"select id, label_id, len(triplets) as n, len(list_filter(triplets, lambda x: x.relation.type in ({_VOCABULARY}) and x.relation.weight between 0 and 1)) as n_valid from report where len(triplets) > 0")
def schema_fraction(spark, d):
    """Triplets per row, and those of known relation with a weight in range."""
    ok = F.filter("triplets", lambda x: x["relation"]["type"].isin(*RELATIONS) & x["relation"]["weight"].between(0, 1))
    return table(spark, d, "report").where("size(triplets) > 0").select("id", "label_id", F.size("triplets").cast("long").alias("n"), F.size(ok).cast("long").alias("n_valid"))


@query(f"select r as relation, count(*) as n, count(*) filter (least(abs(w - 0.2::double), abs(w - 0.5::double), abs(w - 0.8::double)) >= 1e-9) as off_anchor from ({TRIPLES}) group by 1")
def weight_anchor(spark, d):
    off = F.least(*[F.abs(F.col("w") - F.lit(a)) for a in rules.WEIGHT_ANCHORS]) >= 1e-9
    return triples(table(spark, d, "report")).groupBy(F.col("r").alias("relation")).agg(F.count("*").alias("n"), F.count_if(off).alias("off_anchor"))


@query(rf"""with x as (select label_id, {key_sql('text')} as p, {key_sql('s')} as s, {key_sql('t')} as t from ({TRIPLES}))
  select label_id, count(*) as n, count(*) filter (s <> '' and not contains(p, s)) as bad_sources, count(*) filter (t <> '' and not contains(p, t)) as bad_targets from x where p is not null group by 1""")
def grounding_check(spark, d):
    """End points whose key doesn't stand in the passage's; empty keys are passed over."""
    rows = table(spark, d, "report").where("text is not null").withColumn("text", key(F.col("text")))
    keyed = triples(rows).withColumns({"s": key(F.col("s")), "t": key(F.col("t"))})
    absent = lambda c: (F.col(c) != "") & ~F.contains(F.col("text"), F.col(c))
    return keyed.groupBy("label_id").agg(F.count("*").alias("n"), F.count_if(absent("s")).alias("bad_sources"), F.count_if(absent("t")).alias("bad_targets"))


@query(rf"""with x as (select {key_sql('text')} as p, {key_sql('s')} as s, {key_sql('t')} as t, r from ({TRIPLES}))
  select case when s = t then 'self_loop' when r is null or r not in ({_VOCABULARY}) then 'relation' when contains(p, s) and contains(p, t) then 'grounded' else 'ungrounded' end as class,
  count(*) as n from x where p is not null group by 1""")
def hallucination_classes(spark, d):
    """Triplets by the first class that holds: self-loop, unknown relation, grounded, ungrounded."""
    rows = table(spark, d, "report").where("text is not null").withColumn("text", key(F.col("text")))
    keyed = triples(rows).withColumns({"s": key(F.col("s")), "t": key(F.col("t"))})
    both = F.contains(F.col("text"), F.col("s")) & F.contains(F.col("text"), F.col("t"))
    kind = F.when(F.col("s") == F.col("t"), "self_loop").when(F.col("r").isNull() | ~F.col("r").isin(*RELATIONS), "relation").when(both, "grounded").otherwise("ungrounded")
    return keyed.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


@query(rf"select r as relation, count(*) as n from ({TRIPLES}) where status = 'ok' and r not in ({_VOCABULARY}) and contains({key_sql('text')}, {key_sql('s')}) and contains({key_sql('text')}, {key_sql('t')}) group by 1")
def vocabulary_gap(spark, d):
    """Relations outside the vocabulary of grounded triplets in good rows."""
    rows = table(spark, d, "report").where("status = 'ok'").withColumn("text", key(F.col("text")))
    found = triples(rows).where(~F.col("r").isin(*RELATIONS) & F.contains(F.col("text"), key(F.col("s"))) & F.contains(F.col("text"), key(F.col("t"))))
    return found.groupBy(F.col("r").alias("relation")).agg(F.count("*").alias("n"))


@query("select id, label_id, status from (select *, row_number() over (partition by id order by labelled_at desc, label_id desc) as p from report) where p = 1")
def latest_labels(spark, d):
    """The last row of each passage; the end of a resumable run."""
    return keep.keep_last(table(spark, d, "report").select("id", "label_id", "status", "labelled_at"), ["id"], [F.col("labelled_at"), F.col("label_id")]).select("id", "label_id", "status")


@query("select distinct id from report where id not in (select id from report where status = 'ok' and id is not null)")
def resume_antijoin(spark, d):
    """Passages that a resumed run must still do: none of their rows is good."""
    rows = table(spark, d, "report").select("id", "status")
    return rows.select("id").where("id is not null").distinct().join(rows.where("status = 'ok'").select("id"), "id", "left_anti")


@query(rf"""select id, k as entity, n, title from (select id, k, count(*) over (partition by id, k) as n, title, row_number() over (partition by id, k order by len(title) desc, label_id, pos, side) as p
  from (select id, label_id, pos, 0 as side, s as title, {key_sql('s')} as k from ({TRIPLES}) union all select id, label_id, pos, 1, t, {key_sql('t')} from ({TRIPLES})) where k <> '') where p = 1""")
def longest_title_dedup(spark, d):
    """Entities of a passage by key, each with its longest spelling, the first of the longest."""
    x = triples(table(spark, d, "report"))
    both = x.select("id", "label_id", "pos", F.expr("inline(array(struct(0 as side, s as title), struct(1 as side, t as title)))")).withColumn("entity", key(F.col("title"))).where("entity <> ''")
    best = F.min_by("title", F.struct(-F.length("title"), "label_id", "pos", "side"))
    return both.groupBy("id", "entity").agg(F.count("*").alias("n"), best.alias("title"))


@query(rf"""with x as (select label_id, pos, {key_sql('s')} as s, r, {key_sql('t')} as t from ({TRIPLES}))
  select label_id, count(*) as n, count(*) filter (s = t) as self_loops, count(*) filter (p > 1) as duplicates from (select *, row_number() over (partition by label_id, s, r, t order by pos) as p from x) group by 1""")
def redundancy_report(spark, d):
    """Self-loops and repeated edges per label row."""
    x = triples(table(spark, d, "report")).select("label_id", key(F.col("s")).alias("s"), "r", key(F.col("t")).alias("t"))
    edges = x.groupBy("label_id", "s", "r", "t").agg(F.count("*").alias("n"))
    return edges.groupBy("label_id").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("s") == F.col("t"), F.col("n"))), F.lit(0)).alias("self_loops"), F.sum(F.col("n") - 1).alias("duplicates"))


@query(rf"""select id, count(*) as n_requests, sum(len({squeezed('text')}))::bigint as chars, sum(len({squeezed('text')}) // 4)::bigint as tokens, min(id || ':r1') as custom_id
  from report where text is not null and id is not null group by id""")
def batch_requests(spark, d):
    """Requests per passage with their estimated tokens (characters by four)."""
    flat = squeeze(F.col("text"))
    return batch_request_rows(table(spark, d, "report").where("text is not null and id is not null"), flat).groupBy("id").agg(
        F.count("*").alias("n_requests"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"), F.min("custom_id").alias("custom_id")
    )


def batch_request_rows(rows, prompt):
    """Lines of a batch request file: ``custom_id`` and a JSON ``body`` of chat messages."""
    message = F.array(F.struct(F.lit("system").alias("role"), F.lit("Extract the relations.").alias("content")), F.struct(F.lit("user").alias("role"), prompt.alias("content")))
    body = F.to_json(F.struct(F.concat("id", F.lit(":r1")).alias("custom_id"), F.lit("POST").alias("method"), F.struct(message.alias("messages"), F.lit(4096).alias("max_tokens")).alias("body")))
    return rows.select("id", F.concat("id", F.lit(":r1")).alias("custom_id"), body.alias("line"), F.length(prompt).cast("long").alias("chars"), F.expr("1").alias("one"), (F.length(prompt) / 4).cast("long").alias("tokens"))


@query("""select id, count(*) as n_rounds, sum(len(triplets))::bigint as n_triplets, count(*) filter (status = 'ok') as n_ok, bool_or(len(triplets) > 0) as compliant from report where id is not null group by id""")
def round_merge(spark, d):
    """All rounds of a passage merged; it complies when any gave a triplet."""
    return table(spark, d, "report").where("id is not null").groupBy("id").agg(
        F.count("*").alias("n_rounds"), F.sum(F.size("triplets")).alias("n_triplets"), F.count_if(F.expr("status = 'ok'")).alias("n_ok"), F.bool_or(F.size("triplets") > 0).alias("compliant")
    )


@query()
def parse_answers(spark, d):
    """Raw answers parsed as lists, tolerant of damage: how many are whole, repaired or lost."""
    return parsed_answers(table(spark, d, "report"), "label_id", "teacher_raw").groupBy("outcome").agg(F.count("*").alias("n"), F.sum(F.size("items")).alias("n_items"))


@query(rf"""with {RECORDS}, e as (select label_id, count(*) as n, md5(string_agg(title || chr(2) || type || chr(2) || description, chr(3) order by pos)) as d from ent group by 1),
  r as (select label_id, count(*) as n, md5(string_agg(source || chr(2) || target || chr(2) || description, chr(3) order by pos)) as d, sum(cast(round(strength * 1000) as bigint))::bigint as s from rel group by 1)
  select c.label_id, e.n as n_entities, e.d as entities_md5, case when e.n is not null then coalesce(r.n, 0) end as n_relationships, case when e.n is not null then coalesce(r.d, md5('')) end as relationships_md5,
  case when e.n is not null then coalesce(r.s, 0) end as strength from cut c left join e on c.label_id = e.label_id left join r on c.label_id = r.label_id""")
def parse_graph_records(spark, d):
    """Tuple records of raw answers: entities and relationships per row with digests of their fields; null where there is no entity."""
    rows = graph_records(table(spark, d, "report").where(F.contains("teacher_raw", F.lit("<|>"))), "label_id", "teacher_raw")
    digest = lambda name, fields: F.md5(F.array_join(F.transform(name, lambda x: F.concat_ws("\2", *[x[f] for f in fields])), "\3"))
    size = lambda name: F.when(F.col(name).isNotNull(), F.size(name)).cast("long")
    return rows.select(
        "label_id", size("entities").alias("n_entities"), digest("entities", ("title", "type", "description")).alias("entities_md5"),
        size("relationships").alias("n_relationships"), digest("relationships", ("source", "target", "description")).alias("relationships_md5"),
        F.expr("aggregate(relationships, 0L, (a, x) -> a + cast(round(x.strength * 1000) as long))").alias("strength"),
    )


@query(r"""select label_id, len(list_distinct(list_transform(regexp_extract_all(text, '\b\d{1,3}(?:[,.]\d{3})*(?:\.\d+)?\b|\b\d+\.\d+\b|\b\d+%\b'), lambda x: replace(x, ',', '')))) as n_numbers from report where text is not null""")
def numbers_in_text(spark, d):
    return table(spark, d, "report").where("text is not null").select("label_id", F.size(rules.numbers_in(F.col("text"))).cast("long").alias("n_numbers"))


@query("""select label_id, '<|im_start|>system' || chr(10) || 'Extract the relations.' || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10)
  || '<|im_start|>assistant' || chr(10) || teacher_raw || '<|im_end|>' || chr(10) as rendered from report where status = 'ok' and text is not null and teacher_raw is not null""")
def chat_render(spark, d):
    rows = table(spark, d, "report").where("status = 'ok' and text is not null and teacher_raw is not null")
    return rows.select("label_id", rules.chat(F.lit("Extract the relations."), F.col("text"), F.col("teacher_raw")).alias("rendered"))


# Fixed value: tokens of a training row.
CUTOFF = 6144


@query(f"""select label_id, least(n, {CUTOFF}) - least(n, p, {CUTOFF}) as n_active, least(n, p, {CUTOFF}) as n_masked from (select label_id, len(string_split(text, ' ')) as p, len(string_split(text || ' ' || teacher_raw, ' ')) as n
  from report where text is not null and teacher_raw is not null)""")
def response_mask(spark, d):
    """Labels of a row's blank-separated words: the prompt's are -100, cut at ``CUTOFF``; how many remain active (0: masked whole)."""
    rows = table(spark, d, "report").where("text is not null and teacher_raw is not null")
    n_prompt = F.size(F.split("text", " "))
    answer = F.slice(F.split(F.concat_ws(" ", "text", "teacher_raw"), " "), n_prompt + 1, CUTOFF)
    labels = F.slice(F.concat(F.array_repeat(F.lit(-100), n_prompt), F.transform(answer, F.length)), 1, CUTOFF)
    active = F.size(F.filter(labels, lambda x: x != -100))
    return rows.select("label_id", active.cast("long").alias("n_active"), (F.size(labels) - active).cast("long").alias("n_masked"))


@query("""select sample_id, verdict from (select sample_id, lower(trim(verdict)) as verdict, row_number() over (partition by sample_id order by created_at desc, ingested_at desc, reviewer desc, lower(trim(verdict)) desc) as p
  from verdicts where verdict is not null and sample_id is not null) where p = 1""")
def verdict_upsert(spark, d):
    """The verdict that stands for each sample: the latest one."""
    rows = table(spark, d, "verdicts").where("verdict is not null and sample_id is not null").select("sample_id", F.lower(F.trim("verdict")).alias("verdict"), "created_at", "ingested_at", "reviewer")
    return keep.keep_last(rows, ["sample_id"], [F.col("created_at"), F.col("ingested_at"), F.col("reviewer"), F.col("verdict")]).select("sample_id", "verdict")


@query("""select reviewer, count(*) as n, count(*) filter (lower(trim(verdict)) = 'accept') as accepted, count(*) filter (lower(trim(verdict)) = 'accept')::double / count(*) as share from verdicts where verdict is not null group by reviewer""")
def verdict_share(spark, d):
    rows = table(spark, d, "verdicts").where("verdict is not null")
    accepted = F.count_if(F.lower(F.trim("verdict")) == "accept")
    return rows.groupBy("reviewer").agg(F.count("*").alias("n"), accepted.alias("accepted"), (accepted.cast("double") / F.count("*")).alias("share"))


@query("""with f as (select label_id from report where status <> 'ok' or len(semantic_violations) > 0)
  select label_id, 'flagged' as queue from f union all select label_id, 'random' from (select label_id from report where label_id not in (select label_id from f) order by md5('0:' || label_id), label_id limit 50)""")
def review_queue(spark, d):
    """Flagged rows, and 50 others in hash order."""
    rows = table(spark, d, "report").select("label_id", F.expr("status <> 'ok' or coalesce(size(semantic_violations), 0) > 0").alias("flagged"))
    rest = rows.where("not flagged").orderBy(keep.hash_order(F.col("label_id")), "label_id").limit(50)
    return rows.where("flagged").select("label_id", F.lit("flagged").alias("queue")).union(rest.select("label_id", F.lit("random").alias("queue")))


@query(rf"""select label_id, len({squeezed('text')}) as n_chars, md5({squeezed('text')}) as input_md5 from report where status = 'ok' and text is not null""")
def training_rows(spark, d):
    flat = squeeze(F.col("text"))
    return table(spark, d, "report").where("status = 'ok' and text is not null").select("label_id", F.length(flat).cast("long").alias("n_chars"), F.md5(flat).alias("input_md5"))


@query()
def field_token_counts(spark, d):
    """Words of answers by the field of the list that they stand in, ``outside`` for those beside it, and the tenth of the answer."""
    return spans.field_tenths(table(spark, d, "report").where("teacher_raw is not null"), "teacher_raw")
