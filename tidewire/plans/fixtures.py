"""The engine's logical tables as views over the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-06-15 12:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items; the date's form depends on the id: none, free text, with and without a zone."""
    docs = table(spark, sf_dir, "documents")
    stamp = F.date_format(F.lit(NOW).cast("timestamp") - F.make_dt_interval((F.col("doc_id") % 15).cast("int")), "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("doc_id") % 7
    return docs.select(
        F.col("doc_id").alias("ord"),
        F.get(F.split("text", "\n"), 0).alias("title"),
        F.col("text").alias("summary"),
        F.when(F.col("doc_id") % 17 == 0, "").otherwise(F.concat(F.lit("https://feeds.example.com/"), F.md5(F.col("text").cast("binary")))).alias("url"),
        F.when(kind == 0, "").when(kind == 1, "soon").when(kind == 3, F.concat(stamp, F.lit("Z"))).otherwise(stamp).alias("published_date"),
        F.col("source").alias("source_name"),
        F.col("lang").alias("language"),
    )


ITEMS_SQL = f"""items AS (
  SELECT doc_id AS ord, split_part(text, chr(10), 1) AS title, text AS summary,
    CASE WHEN doc_id % 17 = 0 THEN '' ELSE 'https://feeds.example.com/' || md5(text) END AS url,
    CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'soon'
      WHEN 3 THEN strftime(TIMESTAMP '{NOW}' - to_days(CAST(doc_id % 15 AS INTEGER)), '%Y-%m-%dT%H:%M:%S') || 'Z'
      ELSE strftime(TIMESTAMP '{NOW}' - to_days(CAST(doc_id % 15 AS INTEGER)), '%Y-%m-%dT%H:%M:%S') END AS published_date,
    source AS source_name, lang AS language FROM documents)"""


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as fetches of sources."""
    events = table(spark, sf_dir, "events")
    return events.select(F.concat(F.lit("s"), "user_id").alias("name"), "ts", F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("failed"))


FETCHES_SQL = "f AS (SELECT 's' || user_id AS name, ts, event_id AS seq, event_type = 'error' AS failed FROM events)"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of documents and of events."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("name"))
    events = table(spark, sf_dir, "events").select(F.concat(F.lit("s"), "user_id").alias("name"))
    n = F.conv(F.substring(F.md5(F.col("name").cast("binary")), 1, 4), 16, 10).cast("int")
    group = F.element_at(F.array(*map(F.lit, ("政府与CERT", "安全厂商", "AI厂商", "其他"))), (n % 4 + 1).cast("int"))
    return docs.unionByName(events).distinct().select("name", group.alias("group"), (n % 10 != 0).alias("enabled"), n.alias("ord"))


SOURCES_SQL = """src AS (
  SELECT name, ['政府与CERT', '安全厂商', 'AI厂商', '其他'][n % 4 + 1] AS grp, n % 10 <> 0 AS enabled, n AS ord
  FROM (SELECT name, CAST('0x' || substr(md5(name), 1, 4) AS INTEGER) AS n
        FROM (SELECT source AS name FROM documents UNION SELECT 's' || user_id FROM events)))"""
