"""Vector and keyword search, fusion, and merging of ranked lists; many queries at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallkit.config import DEFAULT, Settings
from recallkit.operators.filters import within_distance
from recallkit.session import broadcast_if_small, materialize


def _distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Of every row of x from q. Row by row sums, so equal vectors have equal distances wherever they stand."""
    if metric == "l2sq":
        return ((x - q) ** 2).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.maximum(0.0, 1 - (x * q).sum(1) / np.sqrt((x * x).sum(1) * (q * q).sum()))


#: From the distances and ids of a share's facts, and the query's id, the places of those that go on.
Pick = Callable[[np.ndarray, np.ndarray, object], np.ndarray]


def _tiled(queries: DataFrame, facts: DataFrame, metric: str, keys: list[str], query_id: str, fact_id: str, pick: Pick, share: int = 16384, block: int = 4096) -> DataFrame:
    """Rows (query_id, fact_id, score): blocks of queries meet shares of the facts in tiles, as Arrow batches; a tile holds about `block` queries and `share` facts.

    Where keys limit queries to facts of their own, only keys with more than `share` facts are cut into shares. Vectors that are null or
    hold nulls, and pairs of different lengths or without a distance, have no rows.
    """
    kinds = dict(queries.dtypes)[query_id], dict(facts.dtypes)[fact_id]
    asked = queries.where("q is not null").select(F.col(query_id).alias("qid"), F.col("q").cast("array<double>").alias("vec"), *keys)
    known = facts.where("embedding is not null").select(F.col(fact_id).alias("fid"), F.col("embedding").cast("array<double>").alias("vec"), *keys)
    asked, known = asked.dropna(subset=keys) if keys else asked, known.dropna(subset=keys) if keys else known
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    if keys:
        large = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > share).select(*[F.col(c).alias(f"_{c}") for c in keys], F.ceil(F.col("_n") / share).cast("int").alias("_shares"))
        large = broadcast_if_small(large)  # one row per `share` facts at most
        same = F.lit(True)
        for c in keys:
            same = same & (F.col(c) == F.col(f"_{c}"))
        asked, known = (x.join(large, same, "left").withColumn("_shares", F.coalesce("_shares", F.lit(1))) for x in (asked, known))
        blocks, shares = F.lit(1), F.col("_shares")
    else:
        counts = queries.count(), facts.count()
        blocks, shares = (F.lit(max(1, -(-n // size))) for n, size in zip(counts, (block, share), strict=True))
    none = F.lit(None)
    asked = asked.select("qid", none.cast(kinds[1]).alias("fid"), "vec", *keys, F.pmod(F.xxhash64("qid"), blocks).cast("int").alias("qb"), every(shares).alias("fs"))
    known = known.select(none.cast(kinds[0]).alias("qid"), "fid", "vec", *keys, every(blocks).alias("qb"), F.pmod(F.xxhash64("fid"), shares).cast("int").alias("fs"))

    def meet(tile: pa.Table) -> pa.Table:
        mine, sizes = tile.column("qid").is_valid().to_numpy(), pc.list_value_length(tile.column("vec")).to_numpy()
        names, ids = tile.column("qid").to_pylist(), tile.column("fid").to_pylist()
        q_at, f_at, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for n in np.unique(sizes[sizes > 0]).tolist():
            (asking, q), (own, x) = ((at, pc.list_flatten(tile.column("vec").take(pa.array(at))).to_numpy().reshape(-1, n)) for at in (np.flatnonzero(side & (sizes == n)) for side in (mine, ~mine)))
            if not len(asking) or not len(own):
                continue
            fids = np.array([ids[i] for i in own], None if isinstance(ids[own[0]], int) else object)
            for i, v in zip(asking.tolist(), q, strict=True):
                d = _distances(x, v, metric)  # no number where a component is null or none
                at = pick(d, fids, names[i])
                at = at[~np.isnan(d[at])]
                q_at.append(np.full(len(at), i))
                f_at.append(own[at])
                scores.append(d[at])
        q, f = pa.array(np.concatenate(q_at)), pa.array(np.concatenate(f_at))
        return pa.table([tile.column("qid").take(q), tile.column("fid").take(f), pa.array(np.concatenate(scores))], [query_id, fact_id, "score"])

    return asked.unionByName(known).groupBy(*keys, "qb", "fs").applyInArrow(meet, f"`{query_id}` {kinds[0]}, `{fact_id}` {kinds[1]}, score double")


def within(queries: DataFrame, facts: DataFrame, max_distance: float, metric: str = "cosine", query_id: str = "query_id", fact_id: str = "fact_id") -> DataFrame:
    """All facts within a distance of each query, however many: query_id, fact_id, score."""
    return _tiled(queries, facts, metric, [], query_id, fact_id, lambda d, fids, own: np.flatnonzero(d <= max_distance))


def knn(queries: DataFrame, facts: DataFrame, k: int, metric: str = "cosine", on: list[str] | None = None, query_id: str = "query_id", fact_id: str = "fact_id", max_distance: float | None = None, distinct: bool = False) -> DataFrame:
    """The k nearest facts of each query: query_id, fact_id, score, rank; ties go to the smaller fact_id. A distance gate applies after the cut;
    distinct leaves out the fact with the query's own id.

    Queries: query_id, q, and the columns of `on`, in which facts must agree. Each tile of a query block and a share of the facts gives out k rows per query, which one window
    merges: what moves is k rows per query and share.
    """

    def nearest(d: np.ndarray, fids: np.ndarray, own: object) -> np.ndarray:
        at = np.flatnonzero(~np.isnan(d) & (fids != own) if distinct else ~np.isnan(d))
        if len(at) > k:
            at = at[d[at] <= np.partition(d[at], k - 1)[k - 1]]
        return np.array(sorted(at.tolist(), key=lambda i: (d[i], fids[i]))[:k], np.int64)

    found = _tiled(queries, facts, metric, on or [], query_id, fact_id, nearest)
    merged = Window.partitionBy(query_id).orderBy("score", fact_id)
    out = found.withColumn("rank", F.row_number().over(merged)).where(F.col("rank") <= k)
    out = out if max_distance is None else out.where(within_distance(F.col("score"), max_distance))
    return out.select(query_id, fact_id, "score", "rank")


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits, Latin diacritics folded."""
    folded = F.translate(F.lower(c), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+", -1), lambda t: t != "")


def postings(docs: DataFrame, doc: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The keyword index: (term, doc, tf) and (doc, dl)."""
    split = docs.select(doc, tokens(F.col(text)).alias("_t"))
    lengths = split.select(doc, F.size("_t").alias("dl"))
    return split.select(doc, F.explode("_t").alias("term")).groupBy("term", doc).agg(F.count(F.lit(1)).alias("tf")), lengths


def keyword_search(queries: DataFrame, docs: DataFrame, k: int, doc: str = "fact_id", text: str = "text", query_id: str = "query_id", scope: str | None = None) -> DataFrame:
    """BM25 (k1 1.2, b 0.75, statistics of the whole index): the k best documents of each query as query_id, doc, score (higher is better), rank.

    queries: query_id, terms (array; repeated terms count again), and scope if documents are limited to the query's. Words that no query asks
    for are dropped before any shuffle.
    """
    split = docs.select(doc, *([scope] if scope else []), tokens(F.col(text)).alias("_t"))
    lengths = split.select(F.size("_t").alias("dl"))
    found = split.select(doc, *([scope] if scope else []), F.size("_t").alias("dl"), F.explode("_t").alias("term"))
    return rank_postings(queries, found, lengths, k, doc, query_id, scope)


def rank_postings(queries: DataFrame, postings: DataFrame, lengths: DataFrame, k: int, doc: str, query_id: str, scope: str | None = None) -> DataFrame:
    """BM25 of queries (query_id, terms[, scope]) over postings (doc, term, dl[, tf, else one row per occurrence][, scope]); lengths: dl of every document.

    The postings of asked words are written once; document frequencies, statistics and scores read them there.
    """
    asked = queries.select(query_id, F.explode("terms").alias("term"), *([F.col(scope).alias("_scope")] if scope else []))
    asked = asked.groupBy(query_id, "term", *(["_scope"] if scope else [])).agg(F.count(F.lit(1)).alias("times"))
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()  # one row
    wanted = broadcast_if_small(asked.select("term").distinct())
    tf = F.sum("tf") if "tf" in postings.columns else F.count(F.lit(1))
    hits = postings.join(wanted, "term", "left_semi").groupBy("term", doc, "dl", *([F.col(scope).alias("_own")] if scope else [])).agg(tf.alias("tf"))
    hits = materialize(hits)
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    odds = F.ln((F.lit(float(stats["n"])) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = asked.join(df, "term").select(*asked.columns, F.when(odds > 0, odds).otherwise(1e-6).alias("idf"))
    rows = hits.join(weights, "term")
    if scope:
        rows = rows.where(F.col("_own") == F.col("_scope"))
    part = F.col("times") * F.col("idf") * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("dl") / F.lit(float(stats["avgdl"] or 1.0))))
    scored = rows.groupBy(query_id, doc).agg(F.sum(part).alias("score"))
    order = Window.partitionBy(query_id).orderBy(F.desc(F.round("score", 9)), doc)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query_id, doc, "score", "rank")


def rrf(vector: DataFrame, keyword: DataFrame, limit: int, query_id: str = "query_id", fact_id: str = "fact_id", s: Settings = DEFAULT) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists. A fact's distance is its vector distance, else the fixed one of keyword hits; ties stay in vector order."""
    v = vector.select(query_id, fact_id, "rank", F.col("score").alias("_v"), F.col("rank").alias("vec_rank"), F.lit(None).cast("int").alias("bm25_rank"))
    b = keyword.select(query_id, fact_id, "rank", F.lit(None).cast("double").alias("_v"), F.lit(None).cast("int").alias("vec_rank"), F.col("rank").alias("bm25_rank"))
    fused = v.unionByName(b).groupBy(query_id, fact_id).agg(
        F.sum(1.0 / (s.rrf_k + F.col("rank"))).alias("rrf_score"), F.coalesce(F.max("_v"), F.lit(s.keyword_distance)).alias("score"), F.max("vec_rank").alias("vec_rank"), F.max("bm25_rank").alias("bm25_rank")
    )
    order = Window.partitionBy(query_id).orderBy(F.desc(F.round("rrf_score", 12)), F.col("vec_rank").asc_nulls_last(), F.col("bm25_rank").asc_nulls_last())
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(limit, 1))


def merge_lists(hits: DataFrame, limit: int, key: str = "query_id", fact_id: str = "fact_id") -> DataFrame:
    """Lists of one question (list_ord, pos, score) as one: the first copy of a fact counts, then by distance (unknown last), ties in first-seen order."""
    first = Window.partitionBy(key, fact_id).orderBy("list_ord", "pos")
    order = Window.partitionBy(key).orderBy(F.coalesce("score", F.lit(99.0)), "list_ord", "pos")
    once = hits.withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1).drop("_n")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def expand_queries(queries: DataFrame, variants: list[str], query_id: str = "query_id") -> DataFrame:
    """The question and its variants (columns of arrays or strings) as rows (query_id, variant_ord, variant), distinct, empty ones left out."""
    parts = [F.col(c) if dict(queries.dtypes)[c].startswith("array") else F.array(c) for c in variants]
    kept = F.array_distinct(F.filter(F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts]), lambda t: F.coalesce(F.trim(t), F.lit("")) != ""))
    return queries.select(query_id, F.posexplode(kept).alias("variant_ord", "variant"))


def keywords_with_aliases(keywords: Column, aliases: Column, most: int = 10) -> Column:
    return F.slice(F.array_distinct(F.concat(keywords, aliases)), 1, most)
