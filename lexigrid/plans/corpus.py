"""Queries of the corpus stages: counting, cleaning, filtering, quotas, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.functions import rules
from lexigrid.functions.text import outer_trim, word_count
from lexigrid.operators import chunking, keep
from lexigrid.operators.minhash import keep_first_near_duplicates
from lexigrid.plans.registry import query
from lexigrid.session import table

W = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORDS = f"len(regexp_extract_all(text, '[^{W}]+'))"


def squeezed(text: str) -> str:
    return f"trim(regexp_replace({text}, '[{W}]+', ' ', 'g'))"


SOURCE = f"lower(regexp_replace(source, '^[{W}]+|[{W}]+$', '', 'g'))"
_STOP = ", ".join(f"'{w}'" for w in rules.STOP_WORDS)
_MARKS = " or ".join("contains(flat, '{}')".format(p.replace("'", "''")) for p in rules.BOILERPLATE)
CLEAN = squeezed(r"regexp_replace(text, '@x(?:math\d*|cite)|\[[^\]]*?(?:cols|options)=[^\]]*\]', ' ', 'g')")
ENGLISH = rf"""(len(regexp_replace(text, '[^\p{{L}}]', '', 'g')) > 0
  and 10 * len(regexp_replace(regexp_replace(text, '[^\p{{L}}]', '', 'g'), '[^\x{{00}}-\x{{24f}}]', '', 'g')) >= 9 * len(regexp_replace(text, '[^\p{{L}}]', '', 'g'))
  and len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z]+')), [{_STOP}])) >= 3)"""


@query(f"""select source, count(*) as n_docs, min(n) as least, max(n) as most, sum(n)::bigint as total, sum(n)::double / count(*) as mean
  from (select source, {WORDS} as n from documents where text is not null) group by source""")
def word_stats(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("source", word_count(F.col("text")).alias("n"))
    return rows.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.min("n").cast("long").alias("least"), F.max("n").cast("long").alias("most"), F.sum("n").alias("total"),
        (F.sum("n").cast("double") / F.count("*")).alias("mean"),
    )


@query(f"select {SOURCE} as source, count(*) as n from wikipedia group by 1")
def source_histogram(spark, d):
    return table(spark, d, "wikipedia").groupBy(F.lower(outer_trim(F.col("source"))).alias("source")).agg(F.count("*").alias("n"))


@query(f"select {WORDS} // 50 * 50 as band, count(*) as n from wikipedia where text is not null group by 1")
def length_distribution(spark, d):
    words = word_count(F.col("text"))
    return table(spark, d, "wikipedia").where("text is not null").groupBy((F.floor(words / 50) * 50).cast("long").alias("band")).agg(F.count("*").alias("n"))


@query(f"select article_id, {CLEAN} as cleaned, len(text) - len({CLEAN}) as removed from wikipedia where regexp_matches(text, '@x(?:math|cite)|(?:cols|options)=')")
def artefact_clean(spark, d):
    rows = table(spark, d, "wikipedia").where(F.col("text").rlike("@x(?:math|cite)|(?:cols|options)="))
    cleaned = rules.clean_text(F.col("text"))
    return rows.select("article_id", cleaned.alias("cleaned"), (F.length("text") - F.length(cleaned)).cast("long").alias("removed"))


@query(f"""select source, count(*) filter ({_MARKS}) as n_boilerplate, count(*) as n
  from (select {SOURCE} as source, lower({squeezed('text')}) as flat from wikipedia where text is not null) group by source""")
def boilerplate_flag(spark, d):
    return (
        table(spark, d, "wikipedia").where("text is not null").groupBy(F.lower(outer_trim(F.col("source"))).alias("source"))
        .agg(F.count_if(rules.is_boilerplate(F.col("text"))).alias("n_boilerplate"), F.count("*").alias("n"))
    )


@query(f"select lower(trim(lang)) as lang, count(*) filter ({ENGLISH}) as n_english, count(*) as n from documents where text is not null group by 1")
def english_flag(spark, d):
    return (
        table(spark, d, "documents").where("text is not null").groupBy(F.lower(F.trim("lang")).alias("lang"))
        .agg(F.count_if(rules.is_english(F.col("text"))).alias("n_english"), F.count("*").alias("n"))
    )


def passages(spark, d):
    """Chunked and cleaned articles with the rule that each breaks."""
    chunks = chunking.chunk(table(spark, d, "wikipedia").where("article_id is not null"), ["article_id", "source"], "text")
    return (
        chunks.withColumn("text", rules.clean_text(F.col("text"))).withColumn("word_count", word_count(F.col("text")))
        .withColumn("source", F.lower(outer_trim(F.col("source")))).withColumn("reason", rules.reject_reason(F.col("text"), F.col("word_count")))
    )


@query()
def filter_reasons(spark, d):
    """Chunk, clean and filter all articles; passages per source and reason, kept ones under ``kept``."""
    return passages(spark, d).groupBy("source", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(
        F.count("*").alias("n"), F.sum("word_count").alias("words"), F.count_if(~rules.ends_at_boundary(F.col("text"))).alias("boundary_violations")
    )


@query()
def passage_ids(spark, d):
    """Kept passages numbered within their source: ``source-00001`` and so on.

    Numbers follow article and place; each part of a source's id range is numbered by itself
    and begins where the parts before it end, so no source is sorted in one task.
    """
    kept = passages(spark, d).where("reason is null and source is not null").withColumn("part", F.floor(F.col("article_id") / 4096))
    before = kept.groupBy("source", "part").agg(F.count("*").alias("n")).withColumn(
        "before", F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")
    )
    place = F.row_number().over(Window.partitionBy("source", "part").orderBy("article_id", "chunk_index"))
    numbered = kept.withColumn("place", place).join(before.select("source", "part", "before"), ["source", "part"])
    return numbered.select(
        F.format_string("%s-%05d", "source", (F.col("before") + F.col("place")).cast("long")).alias("id"), "article_id", "chunk_index", "word_count"
    )


@query(f"""select doc_id, source from (select doc_id, source, row_number() over (partition by source order by doc_id) as place from documents
  where {WORDS} between 50 and 300) where place <= 25""")
def source_quota(spark, d):
    """The first 25 documents of middling length of each source."""
    rows = table(spark, d, "documents").where(word_count(F.col("text")).between(50, 300)).select("doc_id", "source")
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return rows.withColumn("place", place).where("place <= 25").drop("place")


@query("select min(doc_id) as doc_id, count(*) as n_copies from documents where text is not null group by md5(text)")
def exact_dedup_keep_first(spark, d):
    return table(spark, d, "documents").where("text is not null").groupBy(F.md5("text").alias("k")).agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies")
    ).drop("k")


@query()
def minhash_dedup(spark, d):
    """Documents with whether a near duplicate before them drops them."""
    return keep_first_near_duplicates(table(spark, d, "documents").where("text is not null"), "doc_id", "text")


@query()
def chunk_stats(spark, d):
    chunks = chunking.chunk(table(spark, d, "documents"), ["doc_id", "lang"], "text")
    return chunks.groupBy(F.lower("lang").alias("lang")).agg(
        F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"), F.min("word_count").alias("least"), F.max("word_count").alias("most"),
        F.count_if(F.expr("word_count > 300")).alias("oversized"),
    )


@query(f"""with t as (select source, n, count(*) over (partition by source) as total, row_number() over (partition by source order by n, doc_id) as place, doc_id
    from (select doc_id, source, {WORDS} as n from documents where text is not null)),
  c as (select source, max(n) filter (place = total // 3 + 1) as t1, max(n) filter (place = 2 * total // 3 + 1) as t2 from t group by source),
  s as (select doc_id, t.source, case when n <= t1 then 0 when n <= t2 then 1 else 2 end as stratum from t join c on t.source = c.source)
  select doc_id, source, stratum from (select *, row_number() over (partition by source, stratum order by md5('0:' || doc_id), doc_id) as p from s) where p <= 20""")
def stratified_sample(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", "source", word_count(F.col("text")).alias("n"))
    return keep.stratified(rows, "doc_id", "source", "n", 20).select("doc_id", "source", "stratum")


@query("""select split, count(*) as n from (select article_id, arg_max(case lower(trim(split)) when 'validation' then 'val' else lower(trim(split)) end, assigned_at) as split
  from split_manifest where split is not null group by article_id) group by split""")
def latest_split(spark, d):
    """Articles per split by their latest assignment."""
    split = F.lower(F.trim("split"))
    rows = table(spark, d, "split_manifest").where("split is not null").select(
        "article_id", "assigned_at", F.when(split == "validation", "val").otherwise(split).alias("split")
    )
    return keep.keep_last(rows, ["article_id"], [F.col("assigned_at"), F.col("split")]).groupBy("split").agg(F.count("*").alias("n"))
