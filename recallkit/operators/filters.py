"""Predicates and projections over facts, candidates and hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallkit.config import DEFAULT, Settings
from recallkit.functions import text as T
from recallkit.functions import vocabulary as V

#: Fixed value: what callers may add to a fact.
CALLER_KEYS = ("channel_id", "channel_name", "source", "persona", "episode_id", "interest_tags", "derived_from")


def is_valid(valid_to: Column, now: Column | int, s: Settings = DEFAULT) -> Column:
    """Not archived by now: no end, end 0, or end after now."""
    if not s.hide_archived:
        return F.lit(True)
    return valid_to.isNull() | (valid_to == 0) | (valid_to > now)


def in_scope(scope: Column, channel: Column, s: Settings = DEFAULT) -> Column:
    """Facts of one conversation show only in its channel (if scopes are filtered at all)."""
    if not s.scope_filter:
        return F.lit(True)
    return ~F.coalesce(scope.startswith("conversation"), F.lit(False)) | F.coalesce(scope == F.concat(F.lit("conversation:"), channel), F.lit(False))


def is_active(valid_to: Column) -> Column:
    """For maintenance jobs: any end at all, even a future one, counts as archived."""
    return F.coalesce(valid_to, F.lit(0)) == 0


def within_distance(score: Column, limit: float) -> Column:
    return score.isNull() | (score <= limit)


def is_core(importance: Column, tier: Column, valid_to: Column, now: Column | int) -> Column:
    return F.coalesce((importance >= 5) & tier.isin(0, 1), F.lit(False)) & is_valid(valid_to, now)


def gist_exempt(importance: Column, attribute: Column, gist_of: Column, s: Settings = DEFAULT) -> Column:
    """Too important, the value of an attribute, or a gist itself."""
    return (F.coalesce(importance, F.lit(0)) > s.gist_max_importance) | (F.trim(F.coalesce(attribute, F.lit(""))) != "") | (F.coalesce(F.size(gist_of), F.lit(0)) > 0)


def schema_eligible(valid_to: Column, gist_of: Column, tags: Column) -> Column:
    """Active, no gist, and not the product of an earlier abstraction (exact tag)."""
    return is_active(valid_to) & (F.coalesce(F.size(gist_of), F.lit(0)) <= 0) & ~F.coalesce(F.array_contains(tags, "schema"), F.lit(False))


def same_category(a: Column, b: Column) -> Column:
    """False only if both are named and differ."""
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return ~((x != "") & (y != "") & (x != y))


def countable_recall(hits: DataFrame) -> DataFrame:
    """Hits that count as recalled: no core facts, no bundle members, no sentinel."""
    return hits.where(~F.coalesce("is_core", F.lit(False)) & ~F.coalesce("is_bundle", F.lit(False)) & F.col("fact_id").isNotNull())


def candidate_gate(cands: DataFrame, batch: str = "batch_id", s: Settings = DEFAULT) -> DataFrame:
    """cands (batch, ordinal, speaker, importance, text) with `verdict`: other (speaker), low (importance), dup (same text earlier in the batch) or kept."""
    base = F.when(F.coalesce("speaker", F.lit("")) != "self", "other").when(F.coalesce("importance", F.lit(0)) < s.min_importance, "low").otherwise("kept")
    rows = cands.withColumn("_v", base)
    nth = F.row_number().over(Window.partitionBy(batch, "text", "_v").orderBy("ordinal"))
    return rows.withColumn("verdict", F.when((F.col("_v") == "kept") & (nth > 1), "dup").otherwise(F.col("_v"))).drop("_v")


def gate_counts(gated: DataFrame, batch: str = "batch_id") -> DataFrame:
    return gated.groupBy(batch).agg(*[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("kept", "low", "other", "dup")])


def fact_metadata(facts: DataFrame, now: int, version: str = "v2") -> DataFrame:
    """The stored form of extracted facts: defaults, tier rule, tag list, normalised vocabulary."""
    return facts.select(
        *[c for c in facts.columns if c not in ("importance", "tier", "tags", "attribute", "condition", "scope")],
        F.col("importance").cast("int").alias("importance"),
        F.when(F.col("importance") <= 2, 2).otherwise(F.coalesce("tier", F.lit(1))).cast("int").alias("tier"),
        F.nullif(T.tags_csv(F.col("tags")), F.lit("")).alias("tags_csv"),
        F.nullif(V.attribute(F.col("attribute")), F.lit("")).alias("attribute"),
        F.nullif(V.condition(F.col("condition")), F.lit("")).alias("condition"),
        F.when(V.scope(F.col("scope")) == "conversation", F.concat_ws(":", F.lit("conversation"), F.col("channel_id"))).when(V.scope(F.col("scope")) == "meta", "meta").alias("scope"),
        F.lit(now).cast("long").alias("timestamp"),
        F.lit(version).alias("gate_version"),
    )


def caller_metadata(meta: Column) -> Column:
    """Of a map, the keys that callers may set."""
    return F.map_filter(meta, lambda k, v: k.isin(*CALLER_KEYS) & v.isNotNull())


def conversation_texts(messages: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Per conversation its first user and assistant text and its first system text that isn't empty ('' if there is none)."""
    first = lambda role, cond=F.lit(True): F.coalesce(F.min_by(F.when((F.col("role") == role) & cond, F.col("text")), F.when((F.col("role") == role) & cond, F.col(order))), F.lit(""))
    return messages.groupBy(key).agg(first("user").alias("user_text"), first("assistant").alias("assistant_text"), first("system", F.coalesce("text", F.lit("")) != "").alias("context_hint"))


def valid_relations(rels: Column, most: int = 5) -> Column:
    """Of extracted relations (array of struct src, rel_type, dst), the valid ones among the first `most`."""
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    clean = F.transform(F.slice(rels, 1, most), lambda r: F.struct(trim(r["src"]).alias("src"), trim(r["rel_type"]).alias("rel_type"), trim(r["dst"]).alias("dst")))
    return F.filter(clean, lambda r: (r["src"] != "") & (r["dst"] != "") & r["rel_type"].isin(*V.RELATION_TYPES) & (r["src"] != r["dst"]))


def listing(facts: DataFrame, now: int, user: str = "user_id", limit: int = 50) -> DataFrame:
    """One line per fact, the newest `limit` of each user: id, importance, tier, archive mark, text on one line."""
    nth = F.row_number().over(Window.partitionBy(user).orderBy(F.desc("ts"), "fact_id"))
    mark = F.when(~is_valid(F.col("valid_to"), now), " archived").otherwise("")
    line = F.concat(F.col("fact_id").cast("string"), F.lit(" [imp="), F.col("importance").cast("string"), F.lit(" tier="), F.col("tier").cast("string"), mark, F.lit("]  "), F.translate(F.substring("memory", 1, 200), "\n", " "))
    return facts.withColumn("_n", nth).where(F.col("_n") <= limit).select(user, "fact_id", line.alias("line"))
