"""Recall: core facts, confidence, boosts, rerank fill, episode bundle, final merge, and the composite search."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallkit.config import DEFAULT, Settings
from recallkit.functions import memory_math as M
from recallkit.operators import graph, search
from recallkit.operators.filters import in_scope, is_core, is_valid, within_distance
from recallkit.session import materialize


def core_facts(facts: DataFrame, now: int, most: int = 3, kept: int = 10) -> DataFrame:
    """The most important live or hot facts of each user: live first, then the last reinforced."""
    order = Window.partitionBy("user_id").orderBy("tier", F.coalesce("last_reinforced_at", F.lit(0)).desc(), "fact_id")
    rows = facts.where(is_core(F.col("importance"), F.col("tier"), F.col("valid_to"), now))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= min(most, kept))


def confidence(hits: DataFrame, key: str = "query_id", s: Settings = DEFAULT) -> DataFrame:
    """Per query the best distance, how many hits there are, and confident, weak or no_memory. Queries without hits must come with a row of null score."""
    best = F.min("score")
    status = F.when(best.isNull() | (best >= s.fok_no_memory), "no_memory").when(best >= s.fok_weak, "weak").otherwise("confident")
    return hits.groupBy(key).agg(best.alias("best_distance"), F.count(F.lit(1)).alias("n_hits"), status.alias("status"))


def boosted(hits: DataFrame, boost: Column, key: str = "query_id") -> DataFrame:
    """Distances lowered by the facts' boosts (never below 0; unknown ones count as 1), and ranks by them. Unboosted unknown distances come last."""
    score = F.when(boost != 0, F.greatest(F.lit(0.0), F.coalesce("score", F.lit(1.0)) - boost)).otherwise(F.col("score"))
    rows = hits.withColumn("score", score)
    order = Window.partitionBy(key).orderBy(F.coalesce("score", F.lit(99.0)), "rank", "fact_id")
    return rows.withColumn("rank", F.row_number().over(order))


def rerank(hits: DataFrame, picks: DataFrame, k: int, key: str = "query_id") -> DataFrame:
    """The picked hits (key, pick: 1-based place among the hits by rank, pick_ord) in the order picked, invalid and repeated picks ignored, then the rest by rank; k of them. As many hits as k or fewer stay as they are."""
    once = picks.groupBy(key, "pick").agg(F.min("pick_ord").alias("_p"))
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    rows = hits.withColumn("_all", n).join(once.withColumnRenamed("pick", "rank"), [key, "rank"], "left")
    place = F.when(F.col("_all") > k, F.col("_p"))
    order = Window.partitionBy(key).orderBy(place.asc_nulls_last(), "rank")
    return rows.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= k).drop("_all", "_p")


def episode_bundle(hits: DataFrame, facts: DataFrame, now: int, fetch: int = 15, s: Settings = DEFAULT, key: str = "query_id", asked: DataFrame | None = None) -> DataFrame:
    """Other valid facts of the episode of each query's best hit: key, fact_id, score, rank. With asked (key, channel_id) they must be in its scope."""
    top = hits.where(F.col("rank") == 1).join(facts.select("fact_id", "user_id", "episode_id"), "fact_id").where("episode_id is not null").select(key, F.col("user_id").alias("_u"), F.col("episode_id").alias("_e"))
    rows = facts.join(top, (F.col("user_id") == F.col("_u")) & (F.col("episode_id") == F.col("_e"))).select(key, "fact_id", "valid_to", "ts", *(["scope"] if asked is not None else []))
    order = Window.partitionBy(key).orderBy("ts", "fact_id")
    rows = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= fetch)
    rows = rows.join(hits.select(key, "fact_id"), [key, "fact_id"], "left_anti").where(is_valid(F.col("valid_to"), now, s))
    if asked is not None:
        rows = rows.join(asked.select(key, "channel_id"), key).where(in_scope(F.col("scope"), F.col("channel_id"), s))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.bundle_limit).select(key, "fact_id", F.lit(s.bundle_distance).alias("score"), "rank")


def core_first(core: DataFrame, main: DataFrame, bundle: DataFrame, limit: int, key: str = "query_id") -> DataFrame:
    """Core facts, then main hits that aren't core as far as the limit goes, then the whole bundle: key, fact_id, score, section (0, 1, 2), pos. Inputs: key, fact_id, score, rank."""
    n = core.groupBy(key).agg(F.count(F.lit(1)).alias("_c"))
    own = main.join(core.select(key, "fact_id"), [key, "fact_id"], "left_anti")
    order = Window.partitionBy(key).orderBy("rank", "fact_id")
    own = own.withColumn("_n", F.row_number().over(order)).join(n, key, "left").where(F.col("_n") <= limit - F.coalesce("_c", F.lit(0)))
    parts = [core.withColumn("section", F.lit(0)), own.withColumn("section", F.lit(1)), bundle.join(core.select(key, "fact_id"), [key, "fact_id"], "left_anti").withColumn("section", F.lit(2))]
    cols = [key, "fact_id", F.col("score").cast("double").alias("score"), "section", "rank"]
    rows = parts[0].select(*cols).unionByName(parts[1].select(*cols)).unionByName(parts[2].select(*cols))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy("section", "rank", "fact_id"))).drop("rank")


#: A stored index's search: of queries (with user_id and terms), the limit and the name of their id.
Keywords = Callable[..., DataFrame]


def hybrid(queries: DataFrame, facts: DataFrame, now: int, limit: int = 20, max_distance: float | None = None, s: Settings = DEFAULT, key: str = "query_id", keywords: Keywords | None = None) -> DataFrame:
    """Vector and keyword hits among the facts of each query's user, fused. queries: key, user_id, q, terms, channel_id.

    Word statistics are those of the whole index; archived and out-of-scope facts of either list are left out.
    """
    valid = facts.where(is_valid(F.col("valid_to"), now, s)).select("fact_id", "scope")
    channel = queries.select(key, "channel_id")

    def shown(hits: DataFrame) -> DataFrame:
        return hits.join(valid, "fact_id").join(channel, key).where(in_scope(F.col("scope"), F.col("channel_id"), s)).select(key, "fact_id", "score", "rank")

    near = shown(search.knn(queries, facts.where("embedding is not null"), limit, on=["user_id"], query_id=key, max_distance=max_distance))
    if keywords:
        worded = shown(keywords(queries, s.keyword_limit, query_id=key))
    else:
        worded = shown(search.keyword_search(queries, facts.select("fact_id", "user_id", F.col("memory").alias("text")), s.keyword_limit, query_id=key, scope="user_id"))
    place = Window.partitionBy(key).orderBy("rank")
    near, worded = (x.withColumn("rank", F.row_number().over(place)) for x in (near, worded))
    return search.rrf(near, worded, limit, key, s=s)


def multi_hybrid(queries: DataFrame, facts: DataFrame, now: int, limit: int = 20, max_distance: float | None = None, variants: DataFrame | None = None, s: Settings = DEFAULT, keywords: Keywords | None = None) -> DataFrame:
    """Hybrid search by each query and its variants (query_id, variant_ord from 1, q, terms), merged: the first copy of a fact counts, then the distance."""
    cols = ["query_id", "variant_ord", "q", "terms"]
    forms = queries.withColumn("variant_ord", F.lit(0)).select(*cols)
    forms = forms if variants is None else forms.unionByName(variants.select(*cols))
    forms = forms.join(queries.select("query_id", "user_id", "channel_id"), "query_id").withColumn("form", F.struct("query_id", "variant_ord"))
    hits = hybrid(forms, facts, now, limit, max_distance, s, "form", keywords)
    lists = hits.select(F.col("form.query_id").alias("query_id"), F.col("form.variant_ord").alias("list_ord"), "fact_id", "score", F.col("rank").alias("pos"))
    return search.merge_lists(lists, limit).select("query_id", "fact_id", "score", "rank")


#: Picks of a reranker: from hits (query_id, fact_id, score, rank) to rows (query_id, pick_ord, pick), pick being a place from 1.
Reranker = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Recall:
    """What a smart search finds: its own hits (query_id, fact_id, score, rank), the bundle, and each query's confidence (best_distance, status)."""

    hits: DataFrame
    bundle: DataFrame
    status: DataFrame

    def recalled(self) -> DataFrame:
        """The side output: facts that count as recalled, bundle and core facts not being among them."""
        return self.hits.select("query_id", "fact_id", F.lit(False).alias("is_core"), F.lit(False).alias("is_bundle"))


def smart_recall(
    queries: DataFrame, facts: DataFrame, edges: DataFrame, now: int, limit: int = 5, s: Settings = DEFAULT,
    variants: DataFrame | None = None, primed: DataFrame | None = None, reranker: Reranker | None = None, keywords: Keywords | None = None,
) -> Recall:
    """The search itself: variants, hybrid search, graph siblings, confidence, then either boosts, cut and distance gate, or boosts, rerank and bundle.

    queries: query_id, user_id, q, terms, channel_id; primed: query_id, entity_id. With a reranker no distance gate applies. If
    the confidence gate is on, queries without any evidence keep no hits.
    """
    gate = None if reranker else s.relevance_max_distance
    hits = materialize(multi_hybrid(queries, facts, now, 20, gate, variants, s, keywords))  # 20 rows a query
    wanted = hits.where("rank <= 3").join(edges, "fact_id").select("entity_id")
    siblings = graph.expand_siblings(hits, edges, graph.co_occurrence(edges, 5, wanted), facts, queries, now, primed, s=s)
    last = Window.partitionBy("query_id").orderBy("_late", "rank", F.desc("activation"), "fact_id")
    pool = hits.select("*", F.lit(None).cast("double").alias("activation"), F.lit(0).alias("_late")).unionByName(siblings.select("query_id", "fact_id", "score", F.lit(0).alias("rank"), "activation", F.lit(1).alias("_late")))
    pool = materialize(pool.withColumn("rank", F.row_number().over(last)).select("query_id", "fact_id", "score", "rank"))
    status = queries.select("query_id").join(confidence(pool, s=s), "query_id", "left").select("query_id", "best_distance", F.coalesce("status", F.lit("no_memory")).alias("status"))
    if s.fok_enabled:
        pool = pool.join(status.where("status = 'no_memory'").select("query_id"), "query_id", "left_anti")
    known = facts.select("fact_id", "mention_count", "recall_count", "reinforced_at", "last_reinforced_at", "ts")
    lift = M.boost(F.col("mention_count"), F.col("recall_count"), F.col("reinforced_at"), F.col("last_reinforced_at"), F.col("ts"), F.lit(now), s)
    ranked = boosted(pool.join(known, "fact_id"), lift).select("query_id", "fact_id", "score", "rank")
    if not reranker:
        ranked = ranked.where(F.col("rank") <= limit).where(within_distance(F.col("score"), s.relevance_max_distance))
        return Recall(ranked, ranked.limit(0), status)
    ranked = materialize(ranked)
    kept = rerank(ranked, reranker(ranked), limit).select("query_id", "fact_id", "score", F.col("final_rank").alias("rank"))
    return Recall(kept, episode_bundle(kept, facts, now, s=s, asked=queries), status)


def smart(queries: DataFrame, facts: DataFrame, edges: DataFrame, now: int, limit: int = 5, s: Settings = DEFAULT, include_core: bool = True, found: Recall | None = None, **options) -> DataFrame:
    """The whole recall: what `smart_recall` finds (or has found), core facts of the user first, the bundle last.

    Rows: query_id, fact_id, score, section (0 core, 1 hit, 2 bundle, 3 the sentinel of a query that the confidence gate stopped, without fact_id and
    with the best distance as its score), pos, status. facts needs the columns of the fact table; queries: query_id, user_id, q, terms, channel_id.
    """
    found = found or smart_recall(queries, facts, edges, now, limit, s, **options)
    core = core_facts(facts, now).select("user_id", "fact_id", "scope", "rank").join(queries.select("query_id", "user_id", "channel_id"), "user_id").where(in_scope(F.col("scope"), F.col("channel_id"), s))
    core = core.select("query_id", "fact_id", F.lit(None).cast("double").alias("score"), "rank")
    out = core_first(core if include_core else core.limit(0), found.hits, found.bundle, limit)
    if s.fok_enabled:
        stopped = found.status.where("status = 'no_memory'").join(out.groupBy("query_id").agg(F.max("pos").alias("_pos")), "query_id", "left")
        out = out.unionByName(stopped.select("query_id", F.lit(None).cast(dict(out.dtypes)["fact_id"]).alias("fact_id"), F.col("best_distance").alias("score"), F.lit(3).alias("section"), (F.coalesce("_pos", F.lit(0)) + 1).alias("pos")))
    return out.join(found.status.select("query_id", "status"), "query_id")
