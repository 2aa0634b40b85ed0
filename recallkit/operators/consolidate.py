"""Offline consolidation: turns, batches, tier decay, gists, schemas, mergeable clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallkit.config import DEFAULT, Settings
from recallkit.functions import memory_math as M
from recallkit.operators.components import components
from recallkit.operators.filters import gist_exempt, is_active, schema_eligible


def pair_turns(lines: DataFrame, channel: str = "channel_id", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Each user line with the assistant line right behind it ('' if there is none); other roles make no turn."""
    w = Window.partitionBy(channel).orderBy(*order)
    role, text = F.lead("role").over(w), F.lead("text").over(w)
    rows = lines.withColumns({"_r": role, "_t": text}).where("role = 'user'")
    return rows.select(channel, *order, F.col("text").alias("user_text"), F.when(F.col("_r") == "assistant", F.col("_t")).otherwise("").alias("assistant_text"))


def new_lines(lines: DataFrame, known: DataFrame) -> DataFrame:
    """Transcript lines that are not known yet, each (channel, time, role, text) once."""
    keys = ["channel_id", "ts", "role", "text"]
    return lines.dropDuplicates(keys).join(known.select(*keys), keys, "left_anti")


def lines_since(lines: DataFrame, cursors: DataFrame, limit: int = 500, channel: str = "channel_id") -> DataFrame:
    """The first lines of each channel behind its cursor (ts, seq; none: all)."""
    rows = lines.join(cursors.withColumnsRenamed({"ts": "_ts", "seq": "_seq"}), channel, "left")
    rows = rows.where(F.col("_ts").isNull() | (F.struct("ts", "seq") > F.struct(F.col("_ts").alias("ts"), F.col("_seq").alias("seq"))))
    w = Window.partitionBy(channel).orderBy("ts", "seq")
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max(limit, 1)).select(*lines.columns)


def replay(lines: DataFrame, cursors: DataFrame, s: Settings = DEFAULT, channel: str = "channel_id") -> tuple[DataFrame, DataFrame]:
    """The next turns of each channel behind its cursor, and the cursors behind the last processed turn."""
    turns = pair_turns(lines_since(lines, cursors, 4 * s.replay_max_turns, channel), channel)
    w = Window.partitionBy(channel).orderBy("ts", "seq")
    turns = turns.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= s.replay_max_turns)
    return turns, turns.groupBy(channel).agg(F.max(F.struct("ts", "seq")).alias("_l")).select(channel, F.col("_l.ts").alias("ts"), F.col("_l.seq").alias("seq"))


def turn_batches(turns: DataFrame, size: int = DEFAULT.batch_size, channel: str = "channel_id", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Turns in batches of `size`: channel, batch, turns (array of user and assistant text), full."""
    nth = F.row_number().over(Window.partitionBy(channel).orderBy(*order)) - 1
    rows = turns.withColumns({"_n": nth, "batch": F.floor(nth / size).cast("int")})
    turn = F.struct("_n", F.substring("user_text", 1, 2000).alias("user"), F.substring("assistant_text", 1, 3000).alias("assistant"))
    return rows.groupBy(channel, "batch").agg(F.transform(F.array_sort(F.collect_list(turn)), lambda t: F.struct(t["user"].alias("user"), t["assistant"].alias("assistant"))).alias("turns")).withColumn("full", F.size("turns") >= size)


def recomputed_tiers(facts: DataFrame, now: int, s: Settings = DEFAULT) -> DataFrame:
    """Active facts with activation, old_tier and new_tier."""
    b = M.activation(F.col("ts"), F.col("reinforced_at"), F.col("mention_count"), F.col("recall_count"), F.lit(now), s.decay_d)
    rows = facts.where(is_active(F.col("valid_to"))).withColumn("activation", b)
    return rows.select("fact_id", "user_id", "activation", F.col("tier").alias("old_tier"), M.tier_of(F.col("activation"), s).alias("new_tier"))


def tier_transitions(facts: DataFrame, now: int, s: Settings = DEFAULT) -> DataFrame:
    return recomputed_tiers(facts, now, s).groupBy("old_tier", "new_tier").agg(F.count(F.lit(1)).alias("n"))


def main_entity(edges: DataFrame, entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Each fact's most mentioned entity, the least id of several: fact_id, entity_id, type."""
    wanted = edges.join(facts.select("fact_id"), "fact_id", "left_semi").select("fact_id", "entity_id").distinct()
    rows = wanted.join(entities.select("entity_id", "type", "mention_count"), "entity_id")
    best = F.min(F.struct((-F.col("mention_count")).alias("m"), "entity_id", "type")).alias("_b")
    return rows.groupBy("fact_id").agg(best).select("fact_id", F.col("_b.entity_id").alias("entity_id"), F.col("_b.type").alias("type"))


def gists(facts: DataFrame, edges: DataFrame, entities: DataFrame, now: int, s: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Cold facts about one entity, compressed: new gists, and the archive deltas of their members.

    The clusters of each user are taken largest first, as far as the run's budget goes; without a model the longest text
    stands for its cluster.
    """
    cold = facts.where(is_active(F.col("valid_to")) & (F.coalesce("tier", F.lit(1)) == 3) & ~gist_exempt(F.col("importance"), F.col("attribute"), F.col("gist_of"), s))
    rows = cold.join(main_entity(edges, entities, cold), "fact_id")
    groups = rows.groupBy("user_id", "entity_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.col("fact_id").cast("string"))).alias("ids"),
        F.min_by("memory", F.struct((-F.length("memory")).alias("l"), "fact_id")).alias("memory"),
        F.min_by("category", "fact_id").alias("category"),
        F.greatest(F.lit(1), F.min("importance")).alias("importance"),
    )
    order = Window.partitionBy("user_id").orderBy(F.desc("n"), "entity_id")
    groups = groups.where(F.col("n") >= s.gist_min_cluster).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= s.gist_max_clusters)
    new = groups.select(
        F.concat(F.lit("gist:"), F.md5(F.array_join("ids", ","))).alias("gist_id"), "user_id", "entity_id", "memory", "category", "importance",
        F.lit(3).alias("tier"), F.col("ids").alias("gist_of"), F.lit(now).cast("long").alias("ts"),
    )
    members = rows.select("user_id", "entity_id", F.col("fact_id").cast("string").alias("fact_id")).join(new.select("user_id", "entity_id", "gist_id"), ["user_id", "entity_id"])
    return new, members.select("fact_id", F.lit(now).cast("long").alias("valid_to"), F.col("gist_id").alias("gist_superseded_by"))


def schemas(facts: DataFrame, edges: DataFrame, entities: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Groups of facts of one category, subcategory and entity type over several entities: one fact per entity, generalised by a template."""
    ok = facts.where(schema_eligible(F.col("valid_to"), F.col("gist_of"), F.col("tags")))
    rows = ok.join(main_entity(edges, entities, ok), "fact_id")
    keys = ["user_id", "category", "subcategory", "type"]
    one = rows.groupBy(*keys, "entity_id").agg(F.min("fact_id").alias("fact_id"))
    groups = one.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_entities"), F.array_sort(F.collect_list("fact_id")).alias("derived_from")).where(F.col("n_entities") >= s.schema_min_entities)
    order = Window.partitionBy("user_id").orderBy(F.desc("n_entities"), "category", "subcategory", "type")
    text = F.concat_ws(" ", F.col("category"), F.col("subcategory"), F.col("type"), F.concat(F.lit("× "), F.col("n_entities").cast("string")))
    return groups.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.schema_max_groups).select(*keys, "n_entities", "derived_from", text.alias("memory"), F.lit(3).alias("importance"), F.array(F.lit("schema")).alias("tags"))


def mergeable_groups(nodes: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """Connected components of judged pairs (a, b): each node's (id) least member (label); nodes without pairs are their own."""
    found = components(edges)
    return nodes.select(F.col(key).alias("id")).join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("label"))
