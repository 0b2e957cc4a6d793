"""The driver's tables in the roles of files, lines, issues and imports, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.operators import text
from corpuscle.operators.zones import zone_of
from corpuscle.util import table

STATUSES = ("open", "open", "wontfix", "fixed", "false_positive")


def files(spark: SparkSession, d: str) -> DataFrame:
    """(file, area, lang, content, doc_id): documents as source files."""
    docs = table(spark, d, "documents")
    return docs.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("file"), F.col("source").alias("area"), "lang", F.coalesce("text", F.lit("")).alias("content"), "doc_id")


def lines(spark: SparkSession, d: str) -> DataFrame:
    return text.lines(files(spark, d))


def issues(spark: SparkSession, d: str) -> DataFrame:
    """Events as issues: id, detector, file, zone, confidence, status, tier, day."""
    e = table(spark, d, "events")
    folder = F.when(F.col("user_id") % 7 == 0, "/tests").when(F.col("user_id") % 11 == 0, "/vendor").otherwise("/src")
    path = F.concat(F.lit("area"), (F.col("user_id") % 5).cast("string"), folder, F.lit("/u"), F.col("user_id").cast("string"))
    out = e.select(
        F.concat_ws("::", "event_type", F.concat(F.lit("u"), F.col("user_id").cast("string")), F.col("event_id").cast("string")).alias("id"),
        F.col("event_type").alias("detector"),
        path.alias("file"),
        F.when(F.col("value") >= 100, "high").when(F.col("value") >= 30, "medium").otherwise("low").alias("confidence"),
        F.element_at(F.array(*[F.lit(s) for s in STATUSES]), (F.col("event_id") % 5 + 1).cast("int")).alias("status"),
        (F.col("event_id") % 4 + 1).alias("tier"),
        F.dayofmonth("ts").cast("long").alias("day"),
        "event_id", "user_id", "ts", "value",
    )
    return out.withColumn("zone", zone_of(F.col("file")))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst): an import graph derived from line items."""
    li = table(spark, d, "lineitem").where("l_quantity = 50 and l_discount >= 0.09")
    return li.selectExpr("l_suppkey as src", "(l_suppkey div 5) * 5 + l_partkey % 5 as dst").where("src != dst").distinct()


FILES = "files AS (SELECT concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS file, source AS area, lang, coalesce(text, '') AS content, doc_id FROM documents)"
LISTS = FILES + ", raw_lists AS (SELECT *, string_split(content, chr(10)) AS s FROM files), lists AS (SELECT * EXCLUDE s, CASE WHEN s[len(s)] = '' THEN s[1:len(s) - 1] ELSE s END AS ls FROM raw_lists), sizes AS (SELECT *, CAST(len(ls) AS BIGINT) AS loc FROM lists)"
LINES = LISTS + ", lines AS (SELECT file, area, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS no FROM lists)"
ISSUES = """issues AS (SELECT event_type || '::u' || user_id || '::' || event_id AS id, event_type AS detector,
 'area' || (user_id % 5) || CASE WHEN user_id % 7 = 0 THEN '/tests' WHEN user_id % 11 = 0 THEN '/vendor' ELSE '/src' END || '/u' || user_id AS file,
 CASE WHEN user_id % 7 = 0 THEN 'test' WHEN user_id % 11 = 0 THEN 'vendor' ELSE 'production' END AS zone,
 CASE WHEN value >= 100 THEN 'high' WHEN value >= 30 THEN 'medium' ELSE 'low' END AS confidence,
 CASE WHEN value >= 100 THEN 10 WHEN value >= 30 THEN 7 ELSE 3 END AS tenths,
 CASE WHEN value >= 100 THEN 0 WHEN value >= 30 THEN 1 ELSE 2 END AS crank,
 ['open', 'open', 'wontfix', 'fixed', 'false_positive'][1 + event_id % 5] AS status,
 1 + event_id % 4 AS tier, CAST(day(ts) AS BIGINT) AS day, event_id, user_id, ts, value FROM events)"""
FAILING = ISSUES + """, failing AS (SELECT i.*, m.mode FROM issues i, (VALUES ('lenient'), ('strict'), ('verified_strict')) m(mode)
 WHERE zone NOT IN ('test', 'vendor') AND (status = 'open' OR status = 'wontfix' AND mode <> 'lenient' OR status IN ('fixed', 'false_positive') AND mode = 'verified_strict'))"""
EDGES = "edges AS (SELECT * FROM (SELECT DISTINCT l_suppkey AS src, (l_suppkey // 5) * 5 + l_partkey % 5 AS dst FROM lineitem WHERE l_quantity = 50 AND l_discount >= 0.09) WHERE src <> dst)"
