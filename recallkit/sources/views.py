"""The engine's relations, derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallkit.plans.registry import table

#: 2024-02-01 00:00:00 UTC.
NOW = 1706745600


def facts(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id", "quality", "toxic")
    i = F.col("doc_id")
    ts = (F.lit(NOW) - (i % 730) * 86400 - 60).cast("long")
    rows = docs.join(labels, "doc_id", "left")
    return rows.select(
        i.alias("fact_id"), F.col("source").alias("user_id"), F.col("text").alias("memory"), F.col("lang").alias("category"),
        F.concat(F.lit("s"), (i % 4).cast("string")).alias("subcategory"),
        F.coalesce(2 + F.col("quality") * 2 + (1 - F.col("toxic")), F.lit(2)).cast("int").alias("importance"),
        (i % 4).cast("int").alias("tier"), ts.alias("ts"),
        F.when(i % 11 == 0, NOW - 100).when(i % 11 == 1, NOW + 86400).cast("long").alias("valid_to"),
        F.when(i % 7 == 0, F.concat(F.lit("conversation:"), (i % 3).cast("string"))).when(i % 7 == 1, "meta").alias("scope"),
        F.when(i % 5 != 0, F.concat(F.lit("e"), F.floor(i / 6).cast("string"))).alias("episode_id"),
        (1 + i % 5).cast("int").alias("mention_count"), (i % 3).cast("int").alias("recall_count"),
        F.transform(F.sequence(F.lit(1), (1 + i % 5)), lambda k: ts + k * 3600).cast("array<bigint>").alias("reinforced_at"),
        F.when(i % 3 != 0, ts + 7200).cast("long").alias("last_reinforced_at"),
        F.when(i % 9 == 0, "weight").alias("attribute"), F.array().cast("array<string>").alias("gist_of"), F.array().cast("array<string>").alias("tags"),
    )


FACTS_SQL = f"""facts AS (
  SELECT doc_id AS fact_id, source AS user_id, text AS memory, lang AS category, 's' || (doc_id % 4) AS subcategory,
    coalesce(2 + quality * 2 + (1 - toxic), 2)::INT AS importance, (doc_id % 4)::INT AS tier, ({NOW} - (doc_id % 730) * 86400 - 60)::BIGINT AS ts,
    CASE WHEN doc_id % 11 = 0 THEN {NOW} - 100 WHEN doc_id % 11 = 1 THEN {NOW} + 86400 END::BIGINT AS valid_to,
    CASE WHEN doc_id % 7 = 0 THEN 'conversation:' || (doc_id % 3) WHEN doc_id % 7 = 1 THEN 'meta' END AS scope,
    CASE WHEN doc_id % 5 <> 0 THEN 'e' || (doc_id // 6) END AS episode_id, (1 + doc_id % 5)::INT AS mention_count, (doc_id % 3)::INT AS recall_count,
    list_transform(range(1, 2 + doc_id % 5), lambda k: ({NOW} - (doc_id % 730) * 86400 - 60) + k * 3600) AS reinforced_at,
    CASE WHEN doc_id % 3 <> 0 THEN {NOW} - (doc_id % 730) * 86400 - 60 + 7200 END::BIGINT AS last_reinforced_at,
    CASE WHEN doc_id % 9 = 0 THEN 'weight' END AS attribute
  FROM documents LEFT JOIN labels USING (doc_id))"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("fact_id"), "embedding")


def vector_queries(spark: SparkSession, d: str, asked: str = "vec_id < 10") -> DataFrame:
    return table(spark, d, "embeddings").where(asked).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def history(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("channel_id"), F.col("turn").alias("ts"), F.col("turn").alias("seq"), "role", F.lit("").alias("author"), "text")


def edges(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("fact_id"), F.col("l_partkey").alias("entity_id"), F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("created_at"))
    return rows.groupBy("fact_id", "entity_id").agg(F.max("created_at").alias("created_at"))


EDGES_SQL = "edges AS (SELECT l_orderkey AS fact_id, l_partkey AS entity_id, max(epoch(l_shipdate)::BIGINT) AS created_at FROM lineitem GROUP BY ALL)"


def entities(spark: SparkSession, d: str) -> DataFrame:
    n = edges(spark, d).groupBy("entity_id").agg(F.count(F.lit(1)).cast("int").alias("mention_count"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("canonical_name"), F.col("p_type").alias("type"), F.concat(F.lit("u"), (F.col("p_partkey") % 5).cast("string")).alias("user_id"))
    return part.join(n, "entity_id", "left").select("entity_id", "canonical_name", "type", "user_id", F.lit(0).cast("long").alias("created_at"), F.coalesce("mention_count", F.lit(0)).alias("mention_count"))


ENTITIES_SQL = """entities AS (SELECT p_partkey AS entity_id, p_name AS canonical_name, p_type AS type, 'u' || (p_partkey % 5) AS user_id, coalesce(n, 0)::INT AS mention_count
  FROM part LEFT JOIN (SELECT entity_id, count(*) AS n FROM edges GROUP BY 1) c ON entity_id = p_partkey)"""


def aliases(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("entity_id"), F.concat(F.lit("alias "), F.col("p_brand")).alias("alias"))


ALIASES_SQL = "aliases AS (SELECT p_partkey AS entity_id, 'alias ' || p_brand AS alias FROM part WHERE p_partkey % 3 = 0)"


def presentations(spark: SparkSession, d: str) -> DataFrame:
    """Per user and event type: created, the last ten times, mentions."""
    t = F.unix_timestamp(F.col("ts").cast("timestamp"))
    ev = table(spark, d, "events").select("user_id", "event_type", t.alias("t"), "event_id")
    from pyspark.sql import Window

    ranked = ev.withColumn("_k", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("t"), F.desc("event_id"))))
    return ranked.groupBy("user_id", "event_type").agg(F.min("t").alias("created"), F.array_sort(F.collect_list(F.when(F.col("_k") <= 10, F.col("t")))).alias("history"), F.max("t").alias("last_t"), F.count(F.lit(1)).cast("int").alias("mentions"))


PRESENTATIONS_SQL = """ev AS (SELECT user_id, event_type, event_id, epoch(date_trunc('second', ts))::BIGINT AS t FROM events),
pres AS (SELECT user_id, event_type, min(t) AS created, list_slice(list(t ORDER BY t, event_id), -10, -1) AS history, max(t) AS last_t, count(*)::INT AS mentions FROM ev GROUP BY 1, 2)"""


def versions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("fact_id"), F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("attribute"), F.round("value", 4).cast("string").alias("value_text"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("created_at"))
