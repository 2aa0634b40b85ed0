"""Ingest, recall, delete and consolidation through the store."""

from pyspark.sql import functions as F

from recallkit.api import Memory
from recallkit.config import Settings

NOW = 1_706_745_600
COLS = "batch_id int, ordinal int, user_id string, speaker string, text string, importance int, embedding array<float>, category string, attribute string, entities array<struct<name:string,type:string,aliases:array<string>>>"


def test_life_of_facts(spark, tmp_path):
    m = Memory(spark, f"file://{tmp_path}/m", Settings(gist_min_cluster=1), conflict=lambda a, b: F.lit("update"))
    tea = [("Tea", "concept", ["chai"])]
    first = [
        (1, 0, "u", "self", "likes green tea", 3, [1.0, 0.0], "personal", None, tea), (1, 1, "u", "other", "likes beer", 3, [0.0, 1.0], None, None, []),
        (1, 2, "u", "self", "hm", 1, [0.0, 1.0], None, None, []), (1, 3, "u", "self", "likes green tea", 3, [1.0, 0.0], "personal", None, tea), (1, 4, "u", "self", "lives in Oslo", 5, [0.0, 1.0], "personal", "residence", []),
    ]
    got = m.add_memories(spark.createDataFrame(first, COLS), NOW)
    assert [r.outcome for r in got.orderBy("ordinal").collect()] == ["kept", "other", "low", "dup", "kept"]
    second = [(2, 0, "u", "self", "really likes green tea", 3, [0.99, 0.1], "personal", None, [("chai", "concept", [])]), (2, 1, "u", "self", "moved to Rome", 5, [-1.0, 0.5], "personal", "residence", [])]
    got = m.add_memories(spark.createDataFrame(second, COLS), NOW + 10)
    assert [r.outcome for r in got.orderBy("ordinal").collect()] == ["duplicate", "kept"]
    facts = {r.memory: r for r in m.table("facts").collect()}
    assert set(facts) == {"likes green tea", "lives in Oslo", "moved to Rome"}
    assert facts["likes green tea"].mention_count == 2 and facts["lives in Oslo"].valid_to == NOW + 10 and facts["lives in Oslo"].conflict_archived_as == "update"
    assert m.table("entities").count() == 1 and m.table("edges").count() == 1

    q = spark.createDataFrame([(1, "u", "where does tea grow", [1.0, 0.0], "c"), (2, "v", "tea", [1.0, 0.0], "c")], "query_id int, user_id string, text string, q array<float>, channel_id string")
    hits = m.search_memories(q, NOW + 20).collect()
    assert [(r.query_id, r.memory) for r in hits if r.score < 0.5] == [(1, "likes green tea")]
    smart = m.search_memories_smart(q.where("query_id = 1"), NOW + 20).orderBy("pos").collect()
    ids = {r.fact_id: r.memory for r in facts.values()}
    assert [ids[r.fact_id] for r in smart] == ["moved to Rome", "likes green tea"] and smart[0].section == 0
    variants = q.where("query_id = 1").select("*", F.lit(7).alias("question"), F.lit(0).alias("variant_ord"))
    assert m.search_memories_multi(variants, NOW + 20).count() >= 1

    m.reinforce_recalled(m.search_memories(q, NOW + 20).select("fact_id", F.lit(False).alias("is_core"), F.lit(False).alias("is_bundle")), NOW + 20)
    assert {r.memory: r.recall_count for r in m.table("facts").collect()}["likes green tea"] == 1
    assert m.recompute_tiers(NOW + 10_000 * 86400, apply=True).count() >= 1
    assert m.table("facts").where("tier = 3").count() >= 1
    assert m.get_all_memories("u", 2).count() == 2 and m.list_memories(NOW + 20).count() == 3
    assert {r.attribute: r.status for r in m.attribute_history().where("status = 'active'").collect()} == {"residence": "active"} and m.attribute_history().count() == 2
    assert {r.kind: r.n for r in m.stats().collect()} == {"entities": 1, "edges": 1, "relations": 0, "facts": 3, "indexed": 3, "lines": 0, "versions": 2}
    m.delete_memory(m.table("facts").where("memory = 'likes green tea'").select("fact_id"))
    assert m.keywords.stats().first().n_docs == 2
    assert m.table("facts").count() == 2 and m.table("edges").count() == 0


def test_history(spark, tmp_path):
    m = Memory(spark, f"file://{tmp_path}/m")
    lines = spark.sql("select 'c' as channel_id, timestamp'2024-01-01 00:00:00' as ts, 1L as seq, 'user' as role, 'Ann' as author, 'red apples and pears' as text")
    m.index_lines(lines)
    assert m.index_lines(lines).count() == 1
    q = spark.createDataFrame([(1, "c", "apples"), (2, "d", "apples")], "query_id int, channel_id string, text string")
    assert [(r.query_id, r.author) for r in m.search_history(q).collect()] == [(1, "Ann")]
    assert [r.user_text for r in m.replay().collect()] == ["red apples and pears"] and m.replay().count() == 0
    later = lines.select("channel_id", (F.col("ts") + F.expr("interval 1 hour")).alias("ts"), F.lit(2).cast("long").alias("seq"), "role", "author", F.lit("more").alias("text"))
    m.index_lines(later)
    assert [r.user_text for r in Memory(spark, f"file://{tmp_path}/m").replay().collect()] == ["more"]
