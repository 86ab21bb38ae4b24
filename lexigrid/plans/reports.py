"""Queries that report on graphs, rounds and pairings: merged nodes and edges, quantiles, layers against gold, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.functions import rules
from lexigrid.functions.text import squeeze
from lexigrid.operators import harness
from lexigrid.operators.linking import greedy_pairs
from lexigrid.operators.titles import COMPANY, company_key, key
from lexigrid.plans.cleaning import record_defects, records
from lexigrid.plans.corpus import squeezed
from lexigrid.plans.evaluation import _PAIRED, _SIDES, _entities, _placed, _two
from lexigrid.plans.graphs import NORM, _norm
from lexigrid.plans.labels import RELATIONS, TRIPLES, triples, verdict_upsert
from lexigrid.plans.registry import SQL, query
from lexigrid.plans.sqltext import RECORDS, nfkc
from lexigrid.plans.sqltext import key as key_sql
from lexigrid.session import scratch, table

_NODES = f"{RECORDS}, nd as (select label_id, pos, type, description, {NORM.format('title')} as title from ent), n as (select * from nd where title <> '')"


def _nodes(spark, d):
    return records(spark, d)[0].withColumn("title", _norm(F.col("title"))).where("title <> ''").drop("key")


@query(f"""with {_NODES}, ty as (select title, type, count(*) as k, min(label_id * 100000 + pos) as first from n group by 1, 2)
  select n.title, (select type from ty where ty.title = n.title order by k desc, first limit 1) as type, count(*) as n_rows, count(distinct label_id) as n_passages, count(distinct description) as n_descriptions, min(label_id) as first_label from n group by n.title""")
def graph_nodes(spark, d):
    """Entities of all answers' records merged by title: their commonest type (the first of equals), how many rows, answers and different descriptions."""
    rows = _nodes(spark, d)
    counts = rows.groupBy("title").agg(F.count("*").alias("n_rows"), F.countDistinct("label_id").alias("n_passages"), F.countDistinct("description").alias("n_descriptions"), F.min("label_id").alias("first_label"))
    types = rows.groupBy("title", "type").agg(F.count("*").alias("k"), F.min(F.struct("label_id", "pos")).alias("first")).groupBy("title").agg(F.min_by("type", F.struct(-F.col("k"), "first")).alias("type"))
    return counts.join(types, "title").select("title", "type", "n_rows", "n_passages", "n_descriptions", "first_label")


@query(f"with {_NODES} select title, description, min(label_id * 100000 + pos) // 100000 as first_label, min(label_id * 100000 + pos) % 100000 as first_pos from n where description <> '' group by 1, 2")
def node_descriptions(spark, d):
    """Different descriptions of each merged entity with the place where each was first seen.

    They stay rows: one title may have a third of all descriptions. ``order by first_label, first_pos`` gives the order to join them in.
    """
    first = F.min(F.struct("label_id", F.col("pos").cast("long").alias("pos")))
    return _nodes(spark, d).where("description <> ''").groupBy("title", "description").agg(first.alias("first")).select("title", "description", F.col("first.label_id").alias("first_label"), F.col("first.pos").alias("first_pos"))


@query(f"""with {RECORDS}, e as (select label_id, pos, description, cast(round(strength * 1000) as bigint) as mils, {NORM.format('source')} as s, {NORM.format('target')} as t from rel),
  m as (select least(s, t) as a, greatest(s, t) as b, count(*) as n, sum(mils)::bigint as total, arg_min(description, label_id * 100000 + pos) as description, min(label_id) as first_label from e where s <> t and s <> '' and t <> '' group by 1, 2)
  select a, b, n, ((10000 * n * 2 + 2 * total + n) // (2 * n))::double / 10000::double as weight, description, first_label from m""")
def graph_edges(spark, d):
    """Relationships of all answers' records merged by their two ends: 1 and a tenth of the mean strength as weight to four places, and the first description."""
    rows = records(spark, d)[1].select("label_id", "pos", "description", F.round(F.col("strength") * 1000).cast("long").alias("mils"), _norm(F.col("source")).alias("s"), _norm(F.col("target")).alias("t"))
    merged = rows.where("s <> t and s <> '' and t <> ''").groupBy(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).agg(
        F.count("*").alias("n"), F.sum("mils").alias("total"), F.min_by("description", F.struct("label_id", "pos")).alias("description"), F.min("label_id").alias("first_label"))
    weight = F.expr("cast((10000 * n * 2 + 2 * total + n) div (2 * n) as double) / cast(10000 as double)")
    return merged.select("a", "b", "n", weight.alias("weight"), "description", "first_label")


@query(f"with {_NODES} select label_id, title, arg_min(type, (10000 - least(len(description), 9999)) * 100000 + pos) as type, max(len(description)) as n_chars from n group by 1, 2")
def entity_index(spark, d):
    """One node for each answer and title: the row with the longest description, the first of those."""
    best = F.min_by(F.struct("type", F.length("description").cast("long").alias("n_chars")), F.struct(-F.length("description"), "pos"))
    return _nodes(spark, d).groupBy("label_id", "title").agg(best.alias("x")).select("label_id", "title", "x.*")


@query(rf"""with {RECORDS} select {key_sql('type')} as type, count(*) as n, count(distinct label_id) as n_answers from ent group by 1 order by n desc, type limit 5""")
def common_types(spark, d):
    """The five commonest entity types of records."""
    return records(spark, d)[0].groupBy(key(F.col("type")).alias("type")).agg(F.count("*").alias("n"), F.countDistinct("label_id").alias("n_answers")).orderBy(F.desc("n"), "type").limit(5)


@query(f"with {RECORDS}, l as (select label_id, list_sort(list(len(description))) as v from ent group by 1) select label_id, len(v) as n, list_aggregate(v, 'median')::double as median, v[least(len(v), 95 * len(v) // 100 + 1)] as p95 from l")
def description_lengths(spark, d):
    """Lengths of an answer's descriptions: the median, and the one at 95 per cent of their order."""
    rows = records(spark, d)[0].groupBy("label_id").agg(F.count("*").alias("n"), F.percentile(F.length("description"), 0.5).alias("median"), F.array_sort(F.collect_list(F.length("description").cast("long"))).alias("v"))
    return rows.select("label_id", "n", "median", F.expr("v[least(size(v) - 1, 95 * size(v) div 100)]").alias("p95"))


def at_share(rows, group: str, value: str, percent: int):
    """``(group, value)``: the value at a share of each group's order, by index rounded down.

    Looked up in running counts of different values, not in sorted rows.
    """
    w = Window.partitionBy(group)
    counts = rows.groupBy(group, value).agg(F.count("*").alias("__n"))
    running = counts.withColumn("__upto", F.sum("__n").over(w.orderBy(value))).withColumn("__total", F.sum("__n").over(w))
    place = F.expr(f"{percent} * __total div 100")
    return running.groupBy(group).agg(F.min(F.when(F.col("__upto") > place, F.col(value))).alias(value))


_DEFECTS = ("placeholders", "type_oov", "letterless", "dangling", "self_loops", "duplicates")
_RUNS = "n_entities", "n_relationships"


@query(f"""with dd as ({SQL['record_defects']}), x as (select coalesce(r.source, '') as source, dd.* from dd join report r on dd.label_id = r.label_id)
  select source, count(*) as answers, sum(n_entities)::bigint as entities, sum(n_relationships)::bigint as relationships, list_sort(list(n_entities))[90 * count(*) // 100 + 1] as entities_p90, max(n_entities) as entities_max, max(n_relationships) as relationships_max,
  {', '.join(f"sum({c})::bigint as {c}" for c in _DEFECTS)}, sum(placeholders)::double / sum(n_entities)::double as placeholder_rate, case when sum(n_relationships) = 0 then 0 else sum(dangling)::double / sum(n_relationships)::double end as dangling_rate from x group by 1""")
def redundancy_runs(spark, d):
    """Volume and faults of the records of each source's answers."""
    x = record_defects(spark, d).join(table(spark, d, "report").select("label_id", F.coalesce("source", F.lit("")).alias("source")), "label_id")
    x = scratch(x, "defects")
    sums = x.groupBy("source").agg(
        F.count("*").alias("answers"), F.sum("n_entities").alias("entities"), F.sum("n_relationships").alias("relationships"), F.max("n_entities").alias("entities_max"), F.max("n_relationships").alias("relationships_max"),
        *[F.sum(c).alias(c) for c in _DEFECTS], rules.ratio(F.sum("placeholders"), F.sum("n_entities")).alias("placeholder_rate"), rules.ratio(F.sum("dangling"), F.sum("n_relationships")).alias("dangling_rate"))
    return sums.join(at_share(x, "source", "n_entities", 90).withColumnRenamed("n_entities", "entities_p90"), "source")


@query("""select source, sum(len(text) // 4)::bigint as prompt_tokens, sum(len(teacher_raw) // 4)::bigint as completion_tokens, (coalesce(sum(len(text) // 4), 0) + coalesce(sum(len(teacher_raw) // 4), 0))::bigint as total_tokens, sum(attempts)::bigint as attempts from report group by source""")
def token_costs(spark, d):
    """Estimated tokens (characters by four) of requests and answers, and attempts, by source."""
    tokens = lambda c: F.sum((F.length(c) / 4).cast("long"))
    zero = F.lit(0)
    return table(spark, d, "report").groupBy("source").agg(tokens("text").alias("prompt_tokens"), tokens("teacher_raw").alias("completion_tokens"), (F.coalesce(tokens("text"), zero) + F.coalesce(tokens("teacher_raw"), zero)).alias("total_tokens"), F.sum("attempts").alias("attempts"))


# Tokens that a request may have with its answer, and those left for the answer.
CONTEXT, ANSWER = 32_768, 4_096


@query(f"select source, count(*) as n, count(*) filter (tokens + {ANSWER} <= {CONTEXT}) as n_fit, max(tokens) as most from (select source, len({squeezed('text')}) // 4 as tokens from wikipedia where text is not null) group by source")
def context_guard(spark, d):
    """Articles by source, and those that fit into a request with room for its answer."""
    rows = table(spark, d, "wikipedia").where("text is not null").select("source", (F.length(squeeze(F.col("text"))) / 4).cast("long").alias("tokens"))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("tokens") + ANSWER <= CONTEXT).alias("n_fit"), F.max("tokens").alias("most"))


@query(rf"""select k as term, count(*) as n_docs from (select {key_sql('title')} as k from documents where title is not null)
  where k <> '' and k not in (select {key_sql('s')} from ({TRIPLES}) where s is not null union all select {key_sql('t')} from ({TRIPLES}) where t is not null) group by 1""")
def vocabulary_gate(spark, d):
    """Document titles that no entity of any label row has."""
    known = triples(table(spark, d, "report")).select(F.explode(F.array("s", "t")).alias("term")).where("term is not null").distinct().select(key(F.col("term")).alias("term"))
    asked = table(spark, d, "documents").where("title is not null").groupBy("title").agg(F.count("*").alias("n")).groupBy(key(F.col("title")).alias("term")).agg(F.sum("n").alias("n_docs"))
    return asked.where("term <> ''").join(known.distinct(), "term", "left_anti")


@query("""select reviewer, count(*) as verified, count(*) filter (v in ('accept', 'reject')) as judged, count(*) filter (v = 'accept') as yes, count(*) filter (v = 'reject') as no, count(*) filter (v is null or v not in ('accept', 'reject')) as unparsed,
  case when count(*) filter (v in ('accept', 'reject')) > 0 then count(*) filter (v = 'reject')::double / count(*) filter (v in ('accept', 'reject'))::double end as no_rate from (select reviewer, lower(trim(verdict)) as v from verdicts) group by reviewer""")
def verify_report(spark, d):
    """Each reviewer's verdicts: judged, yes, no, and those that say neither."""
    rows = table(spark, d, "verdicts").select("reviewer", F.coalesce(F.lower(F.trim("verdict")), F.lit("")).alias("v"))
    yes, no = F.count_if(F.col("v") == "accept"), F.count_if(F.col("v") == "reject")
    return rows.groupBy("reviewer").agg(F.count("*").alias("verified"), (yes + no).alias("judged"), yes.alias("yes"), no.alias("no"), (F.count("*") - yes - no).alias("unparsed"), F.when(yes + no > 0, no.cast("double") / (yes + no).cast("double")).alias("no_rate"))


@query("""with v as (select sample_id, lower(trim(verdict)) as verdict, row_number() over (partition by sample_id order by created_at desc, ingested_at desc, reviewer desc, lower(trim(verdict)) desc) as p from verdicts where verdict is not null and sample_id is not null),
  r as (select distinct id, source from report where id is not null)
  select source, count(*) as passages, count(v.sample_id) as reviewed, count(*) filter (verdict = 'accept') as accepted from r left join v on r.id = v.sample_id and v.p = 1 group by source""")
def reviewed_passages(spark, d):
    """Passages of each source with the verdict that stands for them; those without one count as none."""
    rows = table(spark, d, "report").where("id is not null").select("id", "source").distinct()
    joined = rows.join(verdict_upsert(spark, d).withColumnRenamed("sample_id", "id"), "id", "left")
    return joined.groupBy("source").agg(F.count("*").alias("passages"), F.count("verdict").alias("reviewed"), F.count_if(F.expr("verdict = 'accept'")).alias("accepted"))


@query("""with o as (select id, label_id, status, hard_negative, row_number() over (partition by id order by labelled_at nulls first, label_id) as p from report where id is not null),
  a as (select id, count(*) as n_rounds, max(label_id) filter (p = 1) as first, arg_min(label_id, p) filter (status = 'ok') as done, arg_min(label_id, p) filter (status = 'ok' and hard_negative) as pre from o group by id)
  select id, n_rounds, coalesce(pre, done) as label_id, case when pre is not null then 'given' when done is null then 'none' when done = first then 'first' else 'later' end as origin from a""")
def round_fallback(spark, d):
    """The row that stands for a passage: one marked as without triplets beforehand, else the first good round; null if none is good."""
    order = F.struct("labelled_at", "label_id")
    pick = lambda when: F.min_by(F.when(F.expr(when), F.col("label_id")), F.when(F.expr(when), order))
    x = table(spark, d, "report").where("id is not null").groupBy("id").agg(F.count("*").alias("n_rounds"), F.min_by("label_id", order).alias("first"), pick("status = 'ok'").alias("done"), pick("status = 'ok' and hard_negative").alias("pre"))
    return x.select("id", "n_rounds", F.coalesce("pre", "done").alias("label_id"), F.expr("case when pre is not null then 'given' when done is null then 'none' when done = first then 'first' else 'later' end").alias("origin"))


@query("select id, count(*) as n_rounds from report where id is not null group by id having coalesce(max(len(triplets)), 0) = 0")
def noncompliant_passages(spark, d):
    """Passages of which no round gave a triplet: those that a merge drops."""
    return table(spark, d, "report").where("id is not null").groupBy("id").agg(F.count("*").alias("n_rounds"), F.max(F.coalesce(F.size("triplets"), F.lit(0))).alias("most")).where("coalesce(most, 0) <= 0").drop("most")


@query(f"select label_id, count(*) as n, count(*) filter (s is not null and st is not null and t is not null and tt is not null and r is not null and w between 0 and 1) as n_shaped from ({TRIPLES}) group by 1")
def shape_check(spark, d):
    """Triplets that have all parts and a weight in range, whatever their names."""
    shaped = F.expr("s is not null and st is not null and t is not null and tt is not null and r is not null and w between 0 and 1")
    return triples(table(spark, d, "report")).groupBy("label_id").agg(F.count("*").alias("n"), F.count_if(shaped).alias("n_shaped"))


@query(f"select trim(replace(r, '_', ' ')) as phrase, count(*) as n from ({TRIPLES}) where r is not null group by 1")
def relation_phrases(spark, d):
    """Relations in words."""
    return triples(table(spark, d, "report")).where("r is not null").groupBy(rules.relation_text(F.col("r")).alias("phrase")).agg(F.count("*").alias("n"))


@query(f"with {_SIDES}, {_PAIRED} select m.id, l.k as teacher, r.k as student, score from m join l on m.id = l.id and m.lp = l.place join r on m.id = r.id and m.rp = r.place where l.k <> r.k")
def fuzzy_pairs(spark, d):
    """Greedy pairs of unequal keys: those that a second opinion is asked about."""
    left, right = (scratch(_placed(x), "entities") for x in _two(spark, d))
    pairs = greedy_pairs(left, right).where("score < 2")
    name = lambda side, place, to: side.select("id", F.col("place").alias(place), F.col("key").alias(to))
    return pairs.join(name(left, "left_place", "teacher"), ["id", "left_place"]).join(name(right, "right_place", "student"), ["id", "right_place"]).select("id", "teacher", "student", "score")


@query(f"""with {_SIDES}, {_PAIRED}, h as (select l.id, l.k, l.place, ('0x' || substr(md5(l.id || ':' || l.k), 1, 7))::bigint % n.n as rp from l join (select id, count(*) as n from r group by 1) n on l.id = n.id)
  select h.id, h.k as teacher, r.k as student from h join r on h.id = r.id and h.rp = r.place where h.k <> r.k and not exists (select 1 from m where m.id = h.id and m.lp = h.place and m.rp = h.rp)""")
def negative_pairs(spark, d):
    """For each entity one of the other labelling by a hash, unless they are equal or a pair: pairs that don't belong together, at most one an entity."""
    left, right = (scratch(_placed(x), "entities") for x in _two(spark, d))
    sizes = right.groupBy("id").agg(F.count("*").alias("n"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", "id", "key")), 1, 7), 16, 10).cast("long") % F.col("n")
    asked = left.join(sizes, "id").select("id", F.col("place").alias("left_place"), F.col("key").alias("teacher"), drawn.cast("int").alias("right_place"))
    pairs = asked.join(right.select("id", F.col("place").alias("right_place"), F.col("key").alias("student")), ["id", "right_place"]).where("teacher <> student")
    return pairs.join(greedy_pairs(left, right), ["id", "left_place", "right_place"], "left_anti").select("id", "teacher", "student")


_LAYERS = f"""z as (select x.id, {NORM.format('x.s')} as s, {NORM.format('x.t')} as t, x.label_id = e.a as g, x.label_id = e.b as l, coalesce(x.status = 'ok', false) as o from ({TRIPLES}) x
    join (select id, min(label_id) as a, max(label_id) as b from report where id is not null group by id) e on x.id = e.id where x.s is not null and x.t is not null),
  n as (select k, bool_or(g) as g, bool_or(l) as l, bool_or(o) as o, count(distinct id) filter (g) as df from (select id, s as k, g, l, o from z union all select id, t, g, l, o from z) group by k),
  p as (select least(s, t) as a, greatest(s, t) as b, bool_or(g) as g, bool_or(l) as l, bool_or(o) as o from z where s <> t group by 1, 2)"""


def _layer_sql(name: str, flag: str) -> str:
    return f"""select '{name}' as layer, count(*) filter (g) as entity_gold, count(*) filter ({flag}) as entity_found, count(*) filter (g and {flag}) as entity_both, (select count(*) filter (g) from p) as edge_gold, (select count(*) filter ({flag}) from p) as edge_found, (select count(*) filter (g and {flag}) from p) as edge_both,
      count(*) filter (df >= 2) as links, count(*) filter (df >= 2 and {flag}) as links_kept from n"""


def _scored(part: str) -> str:
    p, r = (f"case when {part}_{x} = 0 then 0 else {part}_both::double / {part}_{x}::double end" for x in ("found", "gold"))
    return f"{p} as {part}_precision, {r} as {part}_recall, case when {part}_found + {part}_gold = 0 then 0 else (2 * {part}_both)::double / ({part}_found + {part}_gold)::double end as {part}_f1"


@query(f"with {_LAYERS}, y as ({_layer_sql('last', 'l')} union all {_layer_sql('good', 'o')}) select *, {_scored('entity')}, {_scored('edge')}, case when links = 0 then 0 else links_kept::double / links::double end as link_survival from y")
def graph_layers(spark, d):
    """The merged graphs of last rows and of good rows against that of first rows: titles, undirected edges, and how many titles that link passages survive."""
    rows = table(spark, d, "report").where("id is not null")
    ends = rows.groupBy("id").agg(F.min("label_id").alias("a"), F.max("label_id").alias("b"))
    z = triples(rows).where("s is not null and t is not null").join(ends, "id").select(
        "id", _norm(F.col("s")).alias("s"), _norm(F.col("t")).alias("t"), F.expr("label_id = a").alias("g"), F.expr("label_id = b").alias("l"), F.expr("coalesce(status = 'ok', false)").alias("o"))
    flags = [F.bool_or(c).alias(c) for c in "glo"]
    titles = z.select("id", "g", "l", "o", F.explode(F.array("s", "t")).alias("k")).groupBy("k", "id").agg(*flags).groupBy("k").agg(F.count_if("g").alias("df"), *flags)
    edges = z.where("s <> t").groupBy(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).agg(*flags)

    def counted(x, part, extra=()):
        layers = F.explode(F.array(F.struct(F.lit("last").alias("layer"), F.col("l").alias("f")), F.struct(F.lit("good").alias("layer"), F.col("o").alias("f"))))
        names = ["g", *[c for c in x.columns if c == "df"]]
        return x.select(*names, layers.alias("y")).select(*names, "y.*").groupBy("layer").agg(F.count_if("g").alias(f"{part}_gold"), F.count_if("f").alias(f"{part}_found"), F.count_if(F.expr("g and f")).alias(f"{part}_both"), *extra)

    links = F.count_if(F.expr("df >= 2")).alias("links"), F.count_if(F.expr("df >= 2 and f")).alias("links_kept")
    y = counted(titles, "entity", links).join(counted(edges, "edge"), "layer")
    c = F.col
    scores = [s for p in ("entity", "edge") for s in (
        rules.ratio(c(f"{p}_both"), c(f"{p}_found")).alias(f"{p}_precision"), rules.ratio(c(f"{p}_both"), c(f"{p}_gold")).alias(f"{p}_recall"), rules.ratio(2 * c(f"{p}_both"), c(f"{p}_found") + c(f"{p}_gold")).alias(f"{p}_f1"))]
    return y.select("*", *scores, rules.ratio(c("links_kept"), c("links")).alias("link_survival"))


#: Measures that a gate compares; layers are alike when all lie within ``GATE`` of one another.
GATED = ("entity_precision", "entity_recall", "entity_f1", "edge_precision", "edge_recall", "edge_f1")
GATE = 0.02


@query(f"with {_LAYERS}, y as ({_layer_sql('last', 'l')} union all {_layer_sql('good', 'o')}), sc as (select {_scored('entity')}, {_scored('edge')} from y) select coalesce(" + " and ".join(f"max({m}) - min({m}) < {GATE}::double" for m in GATED) + ", true) as alike from sc")
def layer_gate(spark, d):
    """Whether the layers are alike in all measures, so that they need no comparison further on."""
    alike = F.lit(True)
    for m in GATED:
        alike = alike & (F.max(m) - F.min(m) < GATE)
    return graph_layers(spark, d).agg(F.coalesce(alike, F.lit(True)).alias("alike"))


_SCHEMES = {"last": "b", "any": "n > 0", "all": "n = rounds"}


@query(f"""with {_SIDES}, al as (select x.id, x.s, x.t, bool_or(x.label_id = ends.a) as a, bool_or(x.label_id = ends.b) as b, count(distinct x.label_id) as n from x join ends on x.id = ends.id group by 1, 2, 3),
  rd as (select id, count(*) as rounds from report group by id), j as (select al.*, rounds from al join rd on al.id = rd.id),
  """ + " union all ".join(f"""select '{name}' as scheme, count(distinct id) filter (a <> ({e})) as passages_off, count(*) filter (({e}) and not a) as fp, count(*) filter (a and not ({e})) as fn, count(*) filter (a and ({e})) as hits,
    case when count(*) filter ({e}) = 0 then 1 else count(*) filter (a and ({e}))::double / count(*) filter ({e})::double end as precision, case when count(*) filter (a) = 0 then 1 else count(*) filter (a and ({e}))::double / count(*) filter (a)::double end as recall from j""" for name, e in _SCHEMES.items()))
def scheme_table(spark, d):
    """Ways to take a passage's pairs from its rounds (the last, any, all) against its first round: passages that differ, wrong, missed and common pairs."""
    rows = table(spark, d, "report").where("id is not null")
    ends = rows.groupBy("id").agg(F.min("label_id").alias("first"), F.max("label_id").alias("final"), F.count("*").alias("rounds"))
    x = triples(rows).select("id", "label_id", key(F.col("s")).alias("s"), key(F.col("t")).alias("t")).distinct().join(ends, "id")
    j = x.groupBy("id", "s", "t", "rounds").agg(F.bool_or(F.expr("label_id = first")).alias("a"), F.bool_or(F.expr("label_id = final")).alias("b"), F.count("*").alias("n"))
    long = j.select("id", "a", F.explode(F.array(*[F.struct(F.lit(name).alias("scheme"), F.expr(e).alias("f")) for name, e in _SCHEMES.items()])).alias("y")).select("id", "a", "y.*")
    n = lambda e: F.count_if(F.expr(e))
    one = lambda part, whole: F.when(whole == 0, 1.0).otherwise(part.cast("double") / whole.cast("double"))
    per = long.groupBy("scheme", "id").agg(n("f and not a").alias("fp"), n("a and not f").alias("fn"), n("a and f").alias("hits"))
    s = per.groupBy("scheme").agg(n("fp + fn > 0").alias("passages_off"), *[F.sum(c).alias(c) for c in ("fp", "fn", "hits")])
    c = F.col
    return s.select("scheme", "passages_off", "fp", "fn", "hits", one(c("hits"), c("hits") + c("fp")).alias("precision"), one(c("hits"), c("hits") + c("fn")).alias("recall"))


_NUM = rules.NUMBER


@query(rf"""with {_SIDES}, tx as (select e.id, a.text as p, coalesce(array_to_string(list_concat(list_transform(b.triplets, lambda y: y.source.title), list_transform(b.triplets, lambda y: y.target.title)), ' '), '') as q from ends e join report a on a.label_id = e.a join report b on b.label_id = e.b),
  nm as (select id, list_distinct(list_transform(regexp_extract_all(coalesce(p, ''), '{_NUM}'), lambda x: replace(x, ',', ''))) as v, q from tx),
  en as (select coalesce(ge.id, pe.id) as id, count(ge.k) as n_gold, count(pe.k) as n_found, count(*) filter (ge.k is not null and pe.k is not null) as n_both from ge full join pe on ge.id = pe.id and ge.k = pe.k group by 1),
  y as (select nm.id, coalesce(n_gold, 0) as n_gold, coalesce(n_found, 0) as n_found, coalesce(n_both, 0) as n_both, len(v) as numbers, len(list_filter(v, lambda x: contains(q, x))) as numbers_kept from nm left join en on nm.id = en.id)
  select *, case when n_gold = 0 then 1 else n_both::double / n_gold::double end as recall, case when n_found = 0 then 0 else n_both::double / n_found::double end as precision, case when numbers = 0 then 1 else numbers_kept::double / numbers::double end as numeric_ratio from y""")
def tracer_coverage(spark, d):
    """Titles of the last labelling against the first's, and which numbers of the passage the last one's titles keep."""
    gold, found = _two(spark, d)
    both = _entities(gold).select("id", "k", F.lit(1).alias("g"), F.lit(0).alias("p")).union(_entities(found).select("id", "k", F.lit(0).alias("g"), F.lit(1).alias("p")))
    titles = both.groupBy("id", "k").agg(F.max("g").alias("g"), F.max("p").alias("p")).groupBy("id").agg(F.sum("g").alias("n_gold"), F.sum("p").alias("n_found"), F.sum(F.col("g") * F.col("p")).alias("n_both"))
    rows = table(spark, d, "report").where("id is not null").groupBy("id").agg(F.min_by(F.struct("text"), "label_id").alias("a"), F.max_by(F.struct("triplets"), "label_id").alias("b"))
    named = F.concat_ws(" ", F.col("b.triplets.source.title"), F.col("b.triplets.target.title"))
    numbers = rows.select("id", rules.numbers_in(F.coalesce("a.text", F.lit(""))).alias("v"), named.alias("q")).select("id", F.size("v").cast("long").alias("numbers"), F.size(F.filter("v", lambda x: F.contains(F.col("q"), x))).cast("long").alias("numbers_kept"))
    y = numbers.join(titles, "id", "left").fillna(0, ["n_gold", "n_found", "n_both"])
    share = lambda a, b, none: F.when(F.col(b) == 0, F.lit(none)).otherwise(F.col(a).cast("double") / F.col(b).cast("double"))
    return y.select("id", "n_gold", "n_found", "n_both", "numbers", "numbers_kept", share("n_both", "n_gold", 1.0).alias("recall"), share("n_both", "n_found", 0.0).alias("precision"), share("numbers_kept", "numbers", 1.0).alias("numeric_ratio"))


@query(f"""with {RECORDS} select label_id, count(*) as n, md5(string_agg('[' || pos || '] ' || {squeezed('type')} || ' ''' || {squeezed('title')} || ''' — ' || substr({squeezed('description')}, 1, 160), chr(10) order by pos)) as md5 from ent group by 1""")
def entry_lines(spark, d):
    """Entities of an answer as the numbered lines of a pairing request: how many, and their digest."""
    line = rules.entry_line(F.col("pos").cast("string"), F.col("type"), F.col("title"), F.col("description"))
    rows = records(spark, d)[0].select("label_id", "pos", line.alias("line")).groupBy("label_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    return rows.select("label_id", "n", F.md5(F.array_join(F.col("lines.line"), "\n")).alias("md5"))


_LEGAL = "|".join(COMPANY)


def _company_sql(x: str) -> str:
    flat = rf"trim(regexp_replace(replace(lower(case when regexp_matches({x}, '[^\x00-\x7f]') then {nfkc(x)} else {x} end), '_', ' '), '[\s\x{{85}}\x{{a0}}\p{{Z}}]+', ' ', 'g'))"
    bare = rf"regexp_replace({flat}, '(?:[ ,]+(?:{_LEGAL})\.? *)+$', '')"
    return rf"trim(regexp_replace(regexp_replace({bare}, '^[^\p{{L}}\p{{N}}]+', ''), '[^\p{{L}}\p{{N}}]+$', ''))"


@query(f"select label_id, pos, {_company_sql('coalesce(s, chr(32))')} as source, lower(trim(coalesce(st, ''))) as source_type, lower(trim(coalesce(r, ''))) as relation, {_company_sql('coalesce(t, chr(32))')} as target, lower(trim(coalesce(tt, ''))) as target_type, s as source_raw, t as target_raw from ({TRIPLES})")
def normalized_triplets(spark, d):
    """Triplets with titles folded as company names are, types in lower case, and the titles as they came."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    x = triples(table(spark, d, "report"))
    return x.select("label_id", F.col("pos").cast("long").alias("pos"), company_key("s").alias("source"), low("st").alias("source_type"), low("r").alias("relation"), company_key("t").alias("target"), low("tt").alias("target_type"), F.col("s").alias("source_raw"), F.col("t").alias("target_raw"))


def _answers(spark, d):
    """``(id, text, gold, found)``: the triplets of each passage's first and last label row."""
    rows = table(spark, d, "report").where("id is not null")
    ends = rows.groupBy("id").agg(F.min("label_id").alias("a"), F.max("label_id").alias("b"), F.min_by(F.struct("text"), "label_id").alias("x"))
    title = lambda c: F.when(F.col(c).isNotNull(), company_key(c))
    low = lambda c: F.lower(F.trim(c))
    item = F.struct(title("s").alias("s"), low("st").alias("st"), low("r").alias("r"), F.col("w").alias("w"), title("t").alias("t"), low("tt").alias("tt"))
    x = triples(rows).select("id", "label_id", F.struct("pos", item.alias("t")).alias("x")).join(ends.select("id", "a", "b"), "id")
    side = lambda end: F.array_sort(F.collect_list(F.when(F.col("label_id") == F.col(end), F.col("x"))))["t"]  # noqa: E731  (one label row's triplets)
    lists = x.groupBy("id").agg(side("a").alias("gold"), side("b").alias("found"))
    return ends.select("id", company_key("x.text").alias("text")).join(lists, "id", "left")


@query()
def harness_scores(spark, d):
    """The last labelling of each passage scored against the first in all measures."""
    return harness.scores(_answers(spark, d), RELATIONS)


@query()
def harness_summary(spark, d):
    """Micro and macro scores of all passages."""
    return harness.summary(harness_scores(spark, d))
