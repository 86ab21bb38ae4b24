"""Queries over vectors, splits, retrieval and events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.functions import rules
from lexigrid.functions.text import outer_trim, word_count
from lexigrid.operators.vectors import nearest
from lexigrid.operators import splits
from lexigrid.operators.titles import key
from lexigrid.plans.labels import TRIPLES, triples
from lexigrid.plans.registry import query
from lexigrid.plans.sqltext import key as key_sql
from lexigrid.session import table
from lexigrid.streaming.events import sessions, windowed_counts

_NEAR = """with q as (select vec_id as qid, embedding::double[] as qv, label as ql from embeddings where vec_id % 100 = 0), a as (select vec_id, embedding::double[] as v, label from embeddings),
  r as (select qid, vec_id, ql, label, row_number() over (partition by qid order by list_cosine_similarity(qv, v) desc, vec_id) as place from q join a on qid <> vec_id)"""


@query(_NEAR + " select qid as query_id, vec_id as id, place as rank from r where place <= 10")
def cosine_topk(spark, d):
    """The ten nearest vectors of every hundredth one, against all."""
    rows = table(spark, d, "embeddings")
    return nearest(rows, rows.where("vec_id % 100 = 0"), "vec_id", "embedding", 10).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@query(_NEAR + """, f as (select qid, min(place) filter (label = ql and place <= 10) as hit from r group by qid)
  select k, count(*) filter (hit <= k) as n_hits, count(*) as n, count(*) filter (hit <= k)::double / count(*) as recall from f, (select unnest([1, 5, 10]) as k) group by k""")
def recall_at_k(spark, d):
    """Share of queries with a vector of their label among the k nearest."""
    rows = table(spark, d, "embeddings")
    asked = rows.where("vec_id % 100 = 0")
    near = nearest(rows, asked, "vec_id", "embedding", 10)
    marked = near.join(rows.select(F.col("vec_id").alias("id"), "label"), "id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    first = marked.groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("wanted"), F.col("rank"))).alias("hit"))
    hits = F.count_if(F.col("hit") <= F.col("k"))
    return first.withColumn("k", F.explode(F.array(*map(F.lit, (1, 5, 10))))).groupBy("k").agg(hits.alias("n_hits"), F.count("*").alias("n"), (hits.cast("double") / F.count("*")).alias("recall"))


@query(rf"""with s as (select article_id, arg_max(case lower(trim(split)) when 'validation' then 'val' else lower(trim(split)) end, assigned_at) as split from split_manifest where split is not null group by article_id),
  e as (select distinct s.split, k, r.article_id from (select label_id, {key_sql('s')} as k from ({TRIPLES}) union all select label_id, {key_sql('t')} from ({TRIPLES})) x join report r on x.label_id = r.label_id
    join s on s.article_id = r.article_id where k <> '')
  select split, count(distinct article_id) as n_articles, count(distinct k) as n_entities from e where split <> 'train' and k in (select k from e where split = 'train') group by split""")
def decontaminate_split(spark, d):
    """Evaluation articles with entities that training articles have too."""
    split = F.lower(F.trim("split"))
    latest = table(spark, d, "split_manifest").where("split is not null").groupBy("article_id").agg(F.max_by(F.when(split == "validation", "val").otherwise(split), "assigned_at").alias("split"))
    rows = table(spark, d, "report")
    keyed = triples(rows).select("label_id", F.explode(F.array(key(F.col("s")), key(F.col("t")))).alias("k")).where("k <> ''").distinct()
    found = keyed.join(rows.select("label_id", "article_id"), "label_id").join(latest, "article_id").select("split", "k", "article_id").distinct()
    shared = found.where("split <> 'train'").join(found.where("split = 'train'").select("k").distinct(), "k", "left_semi")
    return shared.groupBy("split").agg(F.countDistinct("article_id").alias("n_articles"), F.countDistinct("k").alias("n_entities"))


@query(r"""select doc_id, len(terms) as n_terms, len(list_filter(terms, lambda x: contains(flat, x))) as n_hits from (select doc_id, lower(text) as flat, list_distinct(regexp_extract_all(lower(title), '[a-z]+')) as terms
  from documents where text is not null and title is not null)""")
def retrieval_recall(spark, d):
    """Words of a document's title that its text has."""
    rows = table(spark, d, "documents").where("text is not null and title is not null").select("doc_id", F.lower("text").alias("flat"), F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit("[a-z]+"), 0)).alias("terms"))
    return rows.select("doc_id", F.size("terms").cast("long").alias("n_terms"), F.size(F.filter("terms", lambda x: F.contains(F.col("flat"), x))).cast("long").alias("n_hits"))


@query("""select event_id, user_id from (select event_id, user_id, sum(cast(round(value * 100) as bigint)) over (partition by user_id order by ts, event_id) as spent from events) where spent <= 100000""")
def budget_stop(spark, d):
    """Events of each user before a budget is used up, in order."""
    return _in_order(table(spark, d, "events")).where("spent_before + spent <= 100000").select("event_id", "user_id")


def _in_order(events):
    """Events with their place and spending within the user's hour, and those of the user's hours before.

    A user may have a third of all events: no task sorts more than one of a user's hours.
    """
    rows = events.withColumn("cents", F.round(F.col("value") * 100).cast("long")).withColumn("hour", F.date_trunc("hour", "ts"))
    w = Window.partitionBy("user_id", "hour").orderBy("ts", "event_id")
    hours = rows.groupBy("user_id", "hour").agg(F.count("*").alias("n"), F.sum("cents").alias("total"))
    over = Window.partitionBy("user_id").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    before = hours.select(
        "user_id", "hour", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("n_before"), F.coalesce(F.sum("total").over(over), F.lit(0)).alias("spent_before"),
        F.sum("n").over(Window.partitionBy("user_id")).alias("n_all"),
    )
    placed = rows.withColumn("place", F.row_number().over(w) - 1).withColumn("spent", F.sum("cents").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.alias("e").join(before.alias("b"), F.expr("e.user_id <=> b.user_id and e.hour <=> b.hour")).select("e.*", "n_before", "spent_before", "n_all")


@query("""select event_type, bin, count(*) as n, sum(cast(round(value * 100) as bigint))::bigint as total from (select event_type, value, least(10 * (row_number() over (partition by user_id order by ts, event_id) - 1) // count(*) over (partition by user_id), 9) as bin from events)
  group by event_type, bin""")
def field_position_rollup(spark, d):
    """Sums by field and by tenth of the sequence they stand in."""
    rows = _in_order(table(spark, d, "events"))
    tenth = F.least(F.floor((F.col("n_before") + F.col("place")) * 10 / F.col("n_all")), F.lit(9)).cast("long")
    return rows.groupBy("event_type", tenth.alias("bin")).agg(F.count("*").alias("n"), F.sum("cents").alias("total"))


@query("""select event_type, time_bucket(interval 1 hour, ts) as hour, count(*) as n, count(distinct user_id) as n_users from events group by 1, 2""")
def event_windows(spark, d):
    return windowed_counts(table(spark, d, "events"), "1 hour").select("event_type", "hour", "n", "n_users")


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minute then 0 else 1 end as fresh from events),
  s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g)
  select user_id, count(distinct k) as n_sessions, count(*) as n_events from s group by user_id""")
def sessionize(spark, d):
    return sessions(table(spark, d, "events"), "30 minutes").groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events"))


@query("""select event_type, user_id, count(*) as n from (select distinct event_type, user_id, time_bucket(interval 10 minute, ts) as slot from events) group by 1, 2""")
def late_dedupe(spark, d):
    """Events of a user and type counted once in ten minutes."""
    slots = table(spark, d, "events").select("event_type", "user_id", F.window("ts", "10 minutes").start.alias("slot")).distinct()
    return slots.groupBy("event_type", "user_id").agg(F.count("*").alias("n"))


@query("select source, status, count(*) as n, grouping_id(source, status) as level from report group by cube (source, status)")
def status_cube(spark, d):
    """Counts by source and status with all totals in one pass."""
    return table(spark, d, "report").cube("source", "status").agg(F.count("*").alias("n"), F.grouping_id("source", "status").alias("level"))


_W = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SHARES = {"wikipedia": 0.6, "arxiv": 0.4}
_SIZES = {"test": 30, "val": 9, "train": 120}
_STRATA = f"""a as (select article_id, lower(regexp_replace(source, '^[{_W}]+|[{_W}]+$', '', 'g')) as source, len(regexp_extract_all(text, '[^{_W}]+')) as n from wikipedia where text is not null and source is not null),
  b as (select * from a where source in ('wikipedia', 'arxiv') and article_id % 97 <> 0), o as (select *, row_number() over (partition by source order by n, article_id) - 1 as place, count(*) over (partition by source) as total from b),
  c as (select source, max(n) filter (place = total // 3) as t1, max(n) filter (place = 2 * total // 3) as t2 from o group by source),
  s as (select article_id, b.source, case when n <= t1 then 0 when n <= t2 then 1 else 2 end as stratum from b join c on b.source = c.source),
  k as (select *, row_number() over (partition by source, stratum order by md5('0:' || article_id), article_id) as rank from s)"""


def _quota_sql(parts):
    return "case " + " ".join(f"when source = '{s}' and stratum = {k} then {n}" for (s, k), n in parts.items()) + " end"


def _upto(names):
    total = dict.fromkeys(splits.quotas(0, _SHARES), 0)
    for name in names:
        total = {k: total[k] + q for k, q in splits.quotas(_SIZES[name], _SHARES).items()}
    return total


def _articles(spark, d):
    """Articles with a text and a source, and their words."""
    return table(spark, d, "wikipedia").where("text is not null and source is not null").select("article_id", F.lower(outer_trim(F.col("source"))).alias("source"), word_count(F.col("text")).alias("n"))


@query(f"with {_STRATA} select article_id, source, stratum from k where rank <= {_quota_sql(splits.quotas(100, _SHARES))}")
def reserved_sample(spark, d):
    """A sample of 100 articles by shares of two sources and terciles of length; every 97th id is reserved for other ends."""
    rows = _articles(spark, d)
    return splits.sample(rows, "article_id", "source", "n", 100, _SHARES, rows.where("article_id % 97 = 0")).select("article_id", "source", "stratum")


@query(f"with {_STRATA} select article_id, case when rank <= {_quota_sql(_upto(['test']))} then 'test' when rank <= {_quota_sql(_upto(['test', 'val']))} then 'val' else 'train' end as split from k where rank <= {_quota_sql(_upto(_SIZES))}"
       " union all select article_id, 'test' from a where article_id % 97 = 0")
def disjoint_split(spark, d):
    """Disjoint splits drawn by strata; every 97th id is forced into test."""
    rows = _articles(spark, d)
    return splits.disjoint_splits(rows, "article_id", "source", "n", _SIZES, _SHARES, rows.where("article_id % 97 = 0").select("article_id", F.lit("test").alias("split")))


@query("select article_id, case when row_number() over (order by article_id) <= 75 then 'val' else 'train' end as split from (select distinct article_id from wikipedia)")
def first_ids_split(spark, d):
    """The 75 least ids for validation, the others for training."""
    return splits.first_ids(table(spark, d, "wikipedia"), "article_id", 75)
