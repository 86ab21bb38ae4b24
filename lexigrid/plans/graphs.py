"""Queries over the graph that all label rows make together."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.operators.components import connected_components
from lexigrid.plans.labels import TRIPLES, triples
from lexigrid.plans.registry import query
from lexigrid.session import scratch, table

NORM = "upper(trim(regexp_replace({}, '[ \\t\\r\\n]+', ' ', 'g')))"
_EDGES = f"""x as (select label_id, id, w, {NORM.format('s')} as s, {NORM.format('t')} as t from ({TRIPLES}) where s is not null and t is not null)"""


def _norm(c):
    return F.upper(F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " ")))


def _edges(spark, d):
    return triples(table(spark, d, "report")).where("s is not null and t is not null").select("label_id", "id", "w", _norm(F.col("s")).alias("s"), _norm(F.col("t")).alias("t"))


@query(f"""with {_EDGES} select k as title, count(distinct id) as n_passages, count(*) as n_rows from (select id, s as k from x union all select id, t from x) group by 1""")
def doc_frequency(spark, d):
    """Titles by how many passages have them, and by how many rows."""
    rows = _edges(spark, d).select("id", F.explode(F.array("s", "t")).alias("title"))
    per = rows.groupBy("title", "id").agg(F.count("*").alias("n"))
    return per.groupBy("title").agg(F.count("id").alias("n_passages"), F.sum("n").alias("n_rows"))


@query(f"""with {_EDGES} select k as title, count(distinct id) as df from (select id, s as k from x union all select id, t from x) group by 1 having count(distinct id) between 2 and 4""")
def concrete_entities(spark, d):
    rows = _edges(spark, d).select("id", F.explode(F.array("s", "t")).alias("title")).distinct()
    return rows.groupBy("title").agg(F.count("id").alias("df")).where("df between 2 and 4")


@query(f"""with {_EDGES} select least(s, t) as a, greatest(s, t) as b, count(*) as n, min(label_id) as first_label, count(distinct id) as n_passages from x where s <> t group by 1, 2""")
def graph_merge(spark, d):
    """Undirected edges of all rows merged; self-loops left out."""
    per = _edges(spark, d).where("s <> t").groupBy(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"), "id").agg(F.count("*").alias("n"), F.min("label_id").alias("first_label"))
    return per.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("first_label").alias("first_label"), F.count("id").alias("n_passages"))


@query(f"""with {_EDGES}, e as (select distinct least(s, t) as a, greatest(s, t) as b from x where s <> t), n as (select distinct k from (select s as k from x union all select t from x)),
  c as (select k, count(e.k2) as deg from n left join (select a as k2, b from e union all select b, a from e) e on n.k = e.k2 group by k)
  select (select count(*) from n) as n_nodes, (select count(*) from e) as n_edges, count(*) filter (deg = 0) as n_isolated, max(deg) as max_degree from c""")
def graph_stats(spark, d):
    x = _edges(spark, d)
    edges = x.where("s <> t").select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).distinct()
    ends = edges.select(F.explode(F.array("a", "b")).alias("k"), F.lit(1).alias("deg")).union(x.select(F.explode(F.array("s", "t")).alias("k"), F.lit(0).alias("deg")).distinct())
    nodes = ends.groupBy("k").agg(F.sum("deg").alias("deg"))
    return nodes.agg(F.count("*").alias("n_nodes"), (F.sum("deg") / 2).cast("long").alias("n_edges"), F.count_if(F.expr("deg = 0")).alias("n_isolated"), F.max("deg").alias("max_degree"))


@query(f"""with {_EDGES} select k as title, count(*) as degree, sum(n)::bigint as weight from (select least(s, t) as a, greatest(s, t) as b, count(*) as n from x where s <> t group by 1, 2) e, unnest([a, b]) u(k) group by 1""")
def node_degrees(spark, d):
    edges = _edges(spark, d).where("s <> t").groupBy(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).agg(F.count("*").alias("n"))
    return edges.select("n", F.explode(F.array("a", "b")).alias("title")).groupBy("title").agg(F.count("*").alias("degree"), F.sum("n").alias("weight"))


def components_sql(edges: str) -> str:
    """Common tables that end in ``cc (k, c)``: each end of an edge with the least one that it reaches; ``edges`` gives ``(a, b)`` both ways."""
    return f"""e as ({edges}), cc(k, c) using key (k) as (select distinct a, a from e union (select e.b, min(cc.c) from e join cc on e.a = cc.k join recurring.cc r on r.k = e.b where cc.c < r.c group by e.b))"""


_CLUSTERED = f"""with recursive {_EDGES}, n as (select distinct id, k from (select id, s as k from x union all select id, t from x) where id is not null), d as (select k, count(*) as df from n group by 1 having count(*) between 2 and 4),
  {components_sql("select 'p' || n.id as a, 't' || n.k as b from n join d on n.k = d.k union select 't' || n.k, 'p' || n.id from n join d on n.k = d.k")}"""


@query(f"""with recursive {_EDGES}, {components_sql("select s as a, t as b from x where s <> t union select t, s from x where s <> t")}, z as (select count(*) as size from cc group by c) select size, count(*) as n from z group by 1""")
def graph_components(spark, d):
    """Sizes of the connected components of the merged graph."""
    edges = _edges(spark, d).where("s <> t").select(F.xxhash64("s").alias("src"), F.xxhash64("t").alias("dst"))
    sizes = connected_components(edges).groupBy("component").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("n"))


def clustered(titles, least: int = 2, most: int = 4):
    """``(id, anchor, n, cluster)`` from distinct ``(id, title)``: passages by the titles that ``least`` to ``most`` of them have; ``cluster`` is the least passage that they lead to."""
    concrete = titles.groupBy("title").agg(F.count("*").alias("n")).where(F.col("n").between(least, most))
    links = scratch(titles.join(concrete, "title").select("id", F.col("title").alias("anchor"), "n", F.xxhash64(F.lit("id"), "id").alias("node")), "links")
    found = connected_components(links.select(F.col("node").alias("src"), F.xxhash64(F.lit("title"), "anchor").alias("dst")))
    placed = scratch(links.join(found.withColumnRenamed("id", "node"), "node"), "placed")
    return placed.join(placed.groupBy("component").agg(F.min("id").alias("cluster")), "component").select("id", "anchor", "n", "cluster")


def passage_titles(spark, d):
    """Distinct ``(id, title)`` of all label rows."""
    return _edges(spark, d).where("id is not null").select("id", F.explode(F.array("s", "t")).alias("title")).distinct()


@query(f"{_CLUSTERED} select substr(k, 2) as id, substr(c, 2) as cluster from cc where k[1] = 'p'")
def passage_clusters(spark, d):
    """Passages that share concrete entities, directly or through others: ``(id, cluster)``."""
    return clustered(passage_titles(spark, d)).select("id", "cluster").distinct()


@query(f"{_CLUSTERED}, z as (select c, count(*) as size from cc where k[1] = 'p' group by c) select substr(cc.c, 2) as cluster, size, substr(cc.k, 2) as anchor, df as n from cc join z on cc.c = z.c join d on cc.k = 't' || d.k")
def cluster_anchors(spark, d):
    """Clusters of passages with their size and the entities that link them: ``(cluster, size, anchor, n)``."""
    return anchors(passage_titles(spark, d))


def anchors(titles, least: int = 2, most: int = 4):
    """``(cluster, size, anchor, n)`` from distinct ``(id, title)``; ``n`` passages have the anchor."""
    placed = scratch(clustered(titles, least, most), "clustered")
    sizes = placed.select("cluster", "id").distinct().groupBy("cluster").agg(F.count("*").alias("size"))
    return placed.groupBy("cluster", "anchor").agg(F.count("*").alias("n")).join(sizes, "cluster").select("cluster", "size", "anchor", "n")
