"""Tables in and out: JSON lines, resumable appends, versions and keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StringType, StructType

from lexigrid.operators.keep import keep_last

# The label row's nested types.
TRIPLET = "struct<source:struct<title:string,type:string>,relation:struct<type:string,weight:double>,target:struct<title:string,type:string>>"
ARTICLE = "source string, title string, text string"
SPLIT_MANIFEST = "train array<string>, val array<string>, test array<string>"
BATCH_RESPONSE = "custom_id string, response struct<body:struct<choices:array<struct<message:struct<content:string>>>>>"


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that exist, in order."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = lambda p: jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(p))
    return [p for p in paths if there(p)]


def read_lines(spark: SparkSession, paths: list[str], schema: str, strict: bool = True) -> DataFrame:
    """JSON lines with a stated schema; a malformed line is an error, or left out when not ``strict``.

    Missing paths are passed over; without any the table is empty.
    """
    found = existing(spark, paths)
    if not found:
        return spark.createDataFrame([], schema)
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(found)
    whole = StructType([*spark.createDataFrame([], schema).schema.fields, StructField("_bad", StringType())])
    parsed = F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = spark.read.text(found).where(F.trim("value") != "").select(parsed.alias("x")).select("x.*")
    return rows.where("_bad is null").drop("_bad")


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first of the paths that exists; an error if none does."""
    found = existing(spark, paths)
    if not found:
        raise FileNotFoundError(", ".join(paths))
    return found[0]


def read_from(spark: SparkSession, path: str, schema: str, skip: int) -> DataFrame:
    """JSON lines of a path, the first ``skip`` left out."""
    return read_lines(spark, [path], schema).offset(skip)


def listed(df: DataFrame, column: str) -> DataFrame:
    """``df`` with null lists of a column as empty ones."""
    return df.withColumn(column, F.coalesce(F.col(column), F.array().cast(df.schema[column].dataType)))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``(id, left_place, right_place)`` of stored pairings; rows that failed have none."""
    rows = spark.read.schema("id string, pairs array<array<int>>").json(path)
    return rows.select("id", F.explode("pairs").alias("p")).select("id", F.get("p", 0).alias("left_place"), F.get("p", 1).alias("right_place"))


def write_report(summary: DataFrame, rows: DataFrame, path: str) -> None:
    """A report's one row of totals and its rows, as JSON lines under ``summary`` and ``rows``."""
    if len(summary.take(2)) != 1:
        raise ValueError("a summary has one row")
    summary.write.mode("overwrite").json(f"{path}/summary")
    rows.write.mode("overwrite").json(f"{path}/rows")


def write_counts(df: DataFrame, id_col: str, columns: list[str], path: str) -> None:
    """CSV with how many members each list has; null lists have none."""
    sizes = [F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).alias(c) for c in columns]
    df.select(id_col, *sizes).write.mode("overwrite").option("header", True).csv(path)


def write_requests(df: DataFrame, line: str, path: str) -> None:
    """A request file: one JSON line a row."""
    df.select(F.col(line).alias("value")).write.mode("overwrite").text(path)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """``(id, split)`` from one JSON document with an array of ids per split."""
    row = spark.read.schema(SPLIT_MANIFEST).option("multiLine", "true").json(path)
    return row.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, ("train", "val", "test"))), F.array("train", "val", "test"))).alias("split", "ids")).select(
        F.explode("ids").alias("id"), "split"
    )


def read_batch_responses(spark: SparkSession, path: str) -> DataFrame:
    """``(custom_id, content)``: the last line of each id wins, missing content is empty."""
    # a line's place: its file, the block of it, and the order within the block that one task reads
    rows = spark.read.schema(BATCH_RESPONSE).json(path).select(
        "custom_id", F.coalesce(F.try_element_at("response.body.choices.message.content", F.lit(1)), F.lit("")).alias("content"),
        F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("place"),
    )
    return keep_last(rows, ["custom_id"], [F.col("place")]).select("custom_id", "content")


def only_ids(df: DataFrame, ids: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """Rows whose key is in ``ids``; when ``strict``, an id without a row is an error."""
    if strict and (missing := ids.select(key).distinct().join(df.select(key), key, "left_anti").count()):
        raise ValueError(f"{missing} ids have no row")
    return df.join(ids.select(key).distinct(), key, "left_semi")


def append_missing(df: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the table at ``path`` doesn't have; a rerun appends nothing."""
    if existing(df.sparkSession, [path]):
        df = df.join(df.sparkSession.read.parquet(path).select(key), key, "left_anti")
    df.write.mode("append").parquet(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Both tables' rows, of each key the latest; the new table's where times are equal."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return keep_last(both, keys, [order, F.col("__new")]).drop("__new")


def write_version(df: DataFrame, root: str) -> str:
    """Write a new version beside the old ones, which stay readable; returns its path."""
    spark = df.sparkSession
    k = 1
    while existing(spark, [f"{root}/v{k}"]):
        k += 1
    df.write.parquet(f"{root}/v{k}")
    return f"{root}/v{k}"


def write_splits(df: DataFrame, splits: DataFrame, key: str, path: str) -> DataFrame:
    """Rows of each split under ``split=...``, ``val`` named validation; returns the ids without a row."""
    named = splits.withColumn("split", F.when(F.col("split") == "val", "validation").otherwise(F.col("split")))
    df.join(named, key).write.partitionBy("split").json(path)
    return splits.select(key).join(df.select(key), key, "left_anti")
