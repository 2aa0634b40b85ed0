"""Ingest of candidate facts: near duplicates, attribute conflicts, archiving, snapshots, the attribute ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallkit.config import DEFAULT, Settings
from recallkit.functions import text as T
from recallkit.functions import vocabulary as V
from recallkit.operators.filters import same_category

#: A judge gives a verdict column from the existing and the candidate text; null counts as the safe answer.
Judge = Callable[[Column, Column], Column]


def word_judge(same: float = 0.8, inside: float = 0.9) -> Judge:
    """Without a model: paraphrase if the word sets are alike, mergeable if one nearly holds the other, else different."""

    def judge(a: Column, b: Column) -> Column:
        x, y = (F.array_distinct(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\W+")) for c in (a, b))
        both = F.size(F.array_intersect(x, y)).cast("double")
        return F.when(both / F.size(F.array_union(x, y)) >= same, "paraphrase").when(both / F.least(F.size(x), F.size(y)) >= inside, "mergeable").otherwise("different")

    return judge


def no_conflict(a: Column, b: Column) -> Column:
    """The conflict verdict when no model answers: an addition."""
    return F.lit("addition")


def quantity_conflict(a: Column, b: Column) -> Column:
    """Without a model: an update if both texts name one quantity of the same unit and the numbers differ, else an addition."""
    pattern = r"(-?\d+(?:\.\d+)?)\s*(\p{L}+|%)"

    def named(c: Column) -> tuple[Column, Column, Column]:
        numbers = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
        return F.size(numbers) == 1, F.get(numbers, F.lit(0)).cast("double"), F.lower(F.get(F.regexp_extract_all(c, F.lit(pattern), F.lit(2)), F.lit(0)))

    one, x, unit = named(a)
    two, y, other = named(b)
    return F.when(F.coalesce(one & two & (unit == other) & (x != y), F.lit(False)), "update").otherwise("addition")


def dedup_by_key(cands: DataFrame, user: str = "user_id", text: str = "text", order: str = "ordinal") -> DataFrame:
    """Candidates whose (user, trimmed text) comes first."""
    nth = F.row_number().over(Window.partitionBy(T.fact_key(F.col(user), F.col(text))).orderBy(order))
    return cands.withColumn("_n", nth).where(F.col("_n") == 1).drop("_n")


def dedup_single(cands: DataFrame, near: DataFrame, threshold: float = DEFAULT.dedup_threshold, key: str = "cand_id") -> tuple[DataFrame, DataFrame]:
    """Candidates without, and with, any neighbour at the threshold or nearer; unknown distances don't count. near: key, score."""
    close = near.where(F.col("score") <= threshold).select(key).distinct()
    return cands.join(close, key, "left_anti"), cands.join(close, key, "left_semi")


def dedup_two_stage(near: DataFrame, judge: Judge, conflict: Judge = no_conflict, merge: bool = True, synthesized: str | None = None, key: str = "cand_id", s: Settings = DEFAULT) -> DataFrame:
    """Each candidate's decision by its first decisive neighbour: key, decision, existing_id.

    near: key, rank, existing_id, score, text, category, existing_text, existing_category, and the column named by `synthesized`
    with the merged text (null: synthesis failed). Decisions: duplicate, merge, keep_both, replace (keep, archive the
    existing one), novel. Candidates without a decisive neighbour are novel if they have any row in near.
    """
    verdict = F.coalesce(judge(F.col("existing_text"), F.col("text")), F.lit("different"))
    clash = F.coalesce(conflict(F.col("existing_text"), F.col("text")), F.lit("addition")).isin("update", "correction")
    merged = F.col(synthesized).isNotNull() if synthesized else F.length("existing_text") > 0
    gray = (
        F.when(verdict == "paraphrase", "duplicate")
        .when(verdict == "mergeable", F.when(merged, "merge").otherwise("keep_both") if merge else F.lit("duplicate"))
        .when(clash, "replace")
    )
    skip = F.col("score").isNull() | ~same_category(F.col("category"), F.col("existing_category"))
    decision = F.when(skip, None).when(F.col("score") <= s.dedup_low, "duplicate").when(F.col("score") <= s.dedup_high, gray)
    decided = near.withColumn("_d", decision)
    first = F.min(F.when(F.col("_d").isNotNull(), F.struct("rank", "existing_id", F.col("_d").alias("d")))).alias("_f")
    return decided.groupBy(key).agg(first).select(key, F.coalesce(F.col("_f.d"), F.lit("novel")).alias("decision"), F.col("_f.existing_id").alias("existing_id"))


def attribute_conflicts(cands: DataFrame, facts: DataFrame, conflict: Judge, groups: dict[str, list[str]] | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Existing facts that new ones replace: existing_id, cand_id, verdict; each existing fact once (for the least cand_id).

    cands: cand_id, user_id, attribute, condition, text. facts: fact_id, user_id, attribute, condition, memory.
    """
    new = V.expand_groups(cands, groups).select("cand_id", "user_id", F.col("group_member").alias("_a"), F.col("condition").alias("_cond"), F.col("text").alias("_text"))
    old = facts.where(F.coalesce("memory", F.lit("")) != "")
    if exclude is not None:
        old = old.join(exclude.select("fact_id"), "fact_id", "left_anti")
    pairs = old.join(new.withColumnRenamed("user_id", "_u"), (F.col("user_id") == F.col("_u")) & (F.lower("attribute") == F.col("_a")))
    pairs = pairs.where((F.col("memory") != F.col("_text")) & V.may_conflict(F.col("condition"), F.col("_cond")) & V.replaces(F.col("attribute")))
    judged = pairs.withColumn("verdict", conflict(F.col("memory"), F.col("_text"))).where(F.col("verdict").isin("update", "correction"))
    return judged.groupBy(F.col("fact_id").alias("existing_id")).agg(F.min(F.struct("cand_id", "verdict")).alias("_f")).select("existing_id", F.col("_f.cand_id").alias("cand_id"), F.col("_f.verdict").alias("verdict"))


def update_partial(base: DataFrame, delta: DataFrame, key: str = "fact_id") -> DataFrame:
    """base with the columns of delta where delta has a value; other rows and columns stay."""
    given = [c for c in delta.columns if c != key]
    d = delta.withColumnsRenamed({c: f"_d_{c}" for c in given})
    return base.join(d, key, "left").select(*[F.coalesce(F.col(f"_d_{c}"), F.col(c)).alias(c) if c in given else F.col(c) for c in base.columns])


def archive(facts: DataFrame, pairs: DataFrame, now: int) -> DataFrame:
    """Soft archive: valid_to and the reason set for existing_id of pairs (existing_id, verdict); nothing is deleted."""
    delta = pairs.groupBy(F.col("existing_id").alias("fact_id")).agg(F.min("verdict").alias("conflict_archived_as")).withColumn("valid_to", F.lit(now).cast("long"))
    if "conflict_archived_as" not in facts.columns:
        facts = facts.withColumn("conflict_archived_as", F.lit(None).cast("string"))
    return update_partial(facts, delta)


def delete(gone: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """Every table that has fact_id, without the facts of gone."""
    return {name: df.join(gone.select("fact_id"), "fact_id", "left_anti") for name, df in tables.items()}


def ledger(events: DataFrame) -> DataFrame:
    """The version chain per (user_id, attribute): each version ends where the next begins. events: fact_id, user_id, attribute, value_text, created_at."""
    w = Window.partitionBy("user_id", "attribute").orderBy("created_at", "fact_id")
    nxt = F.lead("created_at").over(w)
    return events.select(
        "fact_id", "user_id", "attribute", F.substring("value_text", 1, 500).alias("value_text"), "created_at",
        F.col("created_at").alias("valid_from"), nxt.alias("valid_to"), F.when(nxt.isNull(), "active").otherwise("superseded").alias("status"),
        F.lag("fact_id").over(w).alias("supersedes"), F.lead("fact_id").over(w).alias("superseded_by"),
    )


def ledger_history(versions: DataFrame, limit: int = 50) -> DataFrame:
    """The newest versions of each (user_id, attribute)."""
    order = Window.partitionBy("user_id", "attribute").orderBy(F.desc("created_at"), F.desc("fact_id"))
    return versions.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def reinforce(facts: DataFrame, events: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """facts with presentations (fact_id, t) counted: mention_count, the last presentations, last_reinforced_at."""
    latest = Window.partitionBy("fact_id").orderBy(F.desc("t"))
    ranked = events.withColumn("_k", F.row_number().over(latest))
    kept = F.collect_list(F.when(F.col("_k") <= s.history_kept, F.col("t")))
    news = ranked.groupBy("fact_id").agg(F.count(F.lit(1)).alias("_n"), F.array_sort(kept).alias("_t"), F.max("t").alias("_last"))
    joined = facts.join(news, "fact_id", "left")
    both = F.concat(F.coalesce("reinforced_at", F.array().cast("array<bigint>")), F.coalesce("_t", F.array().cast("array<bigint>")))
    changed = {
        "mention_count": (F.coalesce("mention_count", F.lit(1)) + F.coalesce("_n", F.lit(0))).cast("int"),
        "reinforced_at": tail(F.array_sort(both), s.history_kept),
        "last_reinforced_at": F.coalesce("_last", "last_reinforced_at").cast("long"),
    }
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in facts.columns])


def tail(values: Column, n: int) -> Column:
    """The last n of an array."""
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), n)



def reinforce_recalled(facts: DataFrame, recalled: DataFrame, now: int, s: Settings = DEFAULT) -> DataFrame:
    """facts with a recall counted for those in recalled (fact_id), unless their last recall is less than the interval ago. Importance never changes."""
    hit = recalled.select("fact_id").distinct().withColumn("_hit", F.lit(True))
    due = F.coalesce("_hit", F.lit(False)) & ((F.coalesce("last_recalled_at", F.lit(0)) == 0) | (F.lit(now) - F.col("last_recalled_at") >= s.recall_interval)) & (F.coalesce("memory", F.lit("")) != "")
    past = F.coalesce("reinforced_at", F.array().cast("array<bigint>"))
    stamp = F.lit(now).cast("long")
    changed = {
        "recall_count": (F.coalesce("recall_count", F.lit(0)) + 1).cast("int"),
        "reinforced_at": tail(F.concat(past, F.array(stamp)), s.history_kept),
        "last_reinforced_at": stamp,
        "last_recalled_at": stamp,
    }
    rows = facts.join(hit, "fact_id", "left")
    return rows.select(*[F.when(due, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in facts.columns])
