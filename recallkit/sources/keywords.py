"""The stored keyword index: postings of every document, added, replaced, removed and rebuilt without touching the others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallkit.operators import search
from recallkit.sources.store import Store

#: A column of the terms (array of strings) of a text column.
Tokenizer = Callable[[Column], Column]


class KeywordIndex:
    """One row per document (fact_id, scope, dl, postings: array of term and tf) in a store's table, so searches never tokenize a stored text again.

    Texts without terms are indexed with length 0 and count in the statistics; null ids and texts are left out. Another tokenizer (one that cuts unspaced text into words,
    say) takes the place of the default for texts and queries alike.
    """

    def __init__(self, store: Store, name: str = "postings", tokenize: Tokenizer = search.tokens):
        self.store, self.name, self.tokenize = store, name, tokenize

    def _rows(self, docs: DataFrame, doc: str, text: str, scope: str) -> DataFrame:
        """Counts of terms inside each document's own array; repeated ids count with their least text."""
        rows = docs.select(F.col(doc).cast("string").alias("fact_id"), F.col(scope).cast("string").alias("scope"), F.col(text).alias("_x")).where("fact_id is not null and _x is not null")
        rows = rows.groupBy("fact_id").agg(F.min(F.struct("_x", "scope")).alias("_m")).select("fact_id", "_m.scope", self.tokenize(F.col("_m._x")).alias("_t"))
        exploded = rows.select("fact_id", F.explode("_t").alias("term")).groupBy("fact_id", "term").agg(F.count(F.lit(1)).alias("tf"))
        counted = exploded.groupBy("fact_id").agg(F.collect_list(F.struct("term", "tf")).alias("postings"))
        none = F.array().cast("array<struct<term:string,tf:bigint>>")
        return rows.select("fact_id", "scope", F.size("_t").alias("dl")).join(counted, "fact_id", "left").select("fact_id", "scope", "dl", F.coalesce("postings", none).alias("postings"))

    def rebuild(self, docs: DataFrame, doc: str = "fact_id", text: str = "memory", scope: str = "user_id") -> DataFrame:
        return self.store.write(self.name, self._rows(docs, doc, text, scope))

    def add(self, docs: DataFrame, doc: str = "fact_id", text: str = "memory", scope: str = "user_id") -> DataFrame:
        """Documents indexed, in place of what was indexed under their ids."""
        if not self.store.exists(self.name):
            return self.rebuild(docs, doc, text, scope)
        return self.store.upsert(self.name, self._rows(docs, doc, text, scope))

    def remove(self, ids: DataFrame) -> None:
        self.store.delete(ids, self.name)

    def stats(self) -> DataFrame:
        """One row: n_docs, n_tokens, n_scopes."""
        return self.store.read(self.name).agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_tokens"), F.count_distinct("scope").alias("n_scopes"))

    def search(self, queries: DataFrame, k: int, scoped: bool = True, query_id: str = "query_id") -> DataFrame:
        """BM25 over the stored postings: query_id, fact_id, score, rank. queries: query_id, terms, and user_id, if hits are limited to the query's scope."""
        index = self.store.read(self.name)
        lengths = index.select("dl")
        found = index.select("fact_id", "scope", "dl", F.explode("postings").alias("_p")).select("fact_id", "scope", "dl", F.col("_p.term").alias("term"), F.col("_p.tf").alias("tf"))
        asked = queries.withColumnRenamed("user_id", "scope") if scoped else queries
        return search.rank_postings(asked, found, lengths, k, "fact_id", query_id, "scope" if scoped else None)
