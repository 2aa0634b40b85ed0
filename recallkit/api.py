"""The engine over one store: what an application calls. Every method works on many users and queries at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallkit.config import DEFAULT, Settings
from recallkit.functions import text as T
from recallkit.functions import vocabulary as V
from recallkit.operators import consolidate, filters, graph, ingest, recall, search
from recallkit.session import materialize
from recallkit.sources.keywords import KeywordIndex, Tokenizer
from recallkit.sources.store import ConflictError, Store

FACTS = (
    "fact_id string, user_id string, memory string, embedding array<float>, ts long, category string, subcategory string, importance int, tier int, tags array<string>, attribute string, "
    "condition string, scope string, channel_id string, episode_id string, valid_to long, conflict_archived_as string, mention_count int, recall_count int, reinforced_at array<bigint>, "
    "last_reinforced_at long, last_recalled_at long, gist_of array<string>, gist_superseded_by string"
)
EDGES = "fact_id string, entity_id long, role string, created_at long"
ENTITIES = "entity_id long, canonical_name string, type string, user_id string, created_at long, mention_count int"
ALIASES = "entity_id long, alias string"
RELATIONS = "relation_id long, src_entity_id long, rel_type string, dst_entity_id long, user_id string, created_at long, valid_from long, valid_to long, source_fact_id string"
HISTORY = "channel_id string, ts timestamp, seq long, role string, author string, text string"
POSTINGS = "fact_id string, scope string, dl int, postings array<struct<term:string,tf:bigint>>"
LEDGER = "fact_id string, user_id string, attribute string, value_text string, created_at long"
CURSORS = "channel_id string, ts timestamp, seq long"
SCHEMAS = {"facts": FACTS, "edges": EDGES, "entities": ENTITIES, "aliases": ALIASES, "relations": RELATIONS, "history": HISTORY, "postings": POSTINGS, "ledger": LEDGER, "cursors": CURSORS}
#: What rows of a table are told apart by, where it isn't fact_id.
KEYS = {"entities": "entity_id", "aliases": "entity_id", "relations": "relation_id", "history": "channel_id", "cursors": "channel_id"}

#: A column of a text column; what a model would answer.
Rewriter = Callable[[Column], Column]


@dataclass
class Memory:
    spark: SparkSession
    path: str
    settings: Settings = DEFAULT
    judge: ingest.Judge = field(default_factory=ingest.word_judge)
    conflict: ingest.Judge = ingest.quantity_conflict
    tokenize: Tokenizer = search.tokens

    def __post_init__(self) -> None:
        self.store = Store(self.spark, self.path)
        self.keywords = KeywordIndex(self.store, tokenize=self.tokenize)
        for name, schema in SCHEMAS.items():
            if not self.store.exists(name):
                try:
                    self.store.write(name, self.spark.createDataFrame([], schema), KEYS.get(name, "fact_id"), seen=0)
                except ConflictError:  # another process has just made it
                    continue

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    # Ingest.

    def add_memories(self, extracted: DataFrame, now: int, relations: DataFrame | None = None) -> DataFrame:
        """Extracted facts go through gate, key, near-duplicate and attribute-conflict checks; what stays is stored, what it replaces is archived. Without a model the longer text stands for a merged pair.

        extracted: batch_id, ordinal, user_id, speaker, text, importance, and as far as known embedding, category, tier, tags, attribute,
        condition, scope, channel_id, episode_id, entities (array of struct name, type, aliases). Gives one row per candidate: batch_id,
        ordinal, outcome (kept, low, other, dup, duplicate, merge), fact_id, existing_id.
        """
        s, facts = self.settings, self.table("facts")
        wanted = [f for f in self.spark.createDataFrame([], FACTS).schema if f.name in ("embedding", "category", "subcategory", "tier", "tags", "attribute", "condition", "scope", "channel_id", "episode_id")]
        full = extracted.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in wanted if f.name not in extracted.columns])
        gated = filters.candidate_gate(full, s=s).withColumn("cand_id", T.fact_key(F.col("user_id"), F.col("text")))
        gated = materialize(gated)
        known = facts.select(F.col("fact_id").alias("cand_id")).withColumn("_known", F.lit(True))
        cands = ingest.dedup_by_key(gated.where("verdict = 'kept'")).join(known, "cand_id", "left")
        fresh = materialize(cands.where("_known is null").drop("_known"))
        old = facts.where(filters.is_valid(F.col("valid_to"), now, s) & F.col("embedding").isNotNull())
        asked = fresh.where("embedding is not null").select(F.col("cand_id").alias("query_id"), "user_id", F.col("embedding").alias("q"))
        near = search.knn(asked, old.select("fact_id", "user_id", "embedding"), s.dedup_limit, on=["user_id"], max_distance=s.relevance_max_distance)
        about = facts.select(F.col("fact_id").alias("existing_id"), F.col("memory").alias("existing_text"), F.col("category").alias("existing_category"))
        near = near.select(F.col("query_id").alias("cand_id"), F.col("fact_id").alias("existing_id"), "score", "rank").join(about, "existing_id").join(fresh.select("cand_id", "text", "category"), "cand_id")
        decided = materialize(ingest.dedup_two_stage(near, self.judge, self.conflict, s=s))
        kept = fresh.join(decided, "cand_id", "left").withColumn("decision", F.coalesce("decision", F.lit("novel")))
        kept = materialize(kept.where("decision <> 'duplicate'"))
        replaced = decided.where("decision in ('replace', 'merge')").select("existing_id", F.when(F.col("decision") == "merge", "merge").otherwise("update").alias("verdict"))
        active = facts.where(filters.is_valid(F.col("valid_to"), now, s)).select("fact_id", "user_id", "attribute", "condition", "memory")
        clashes = ingest.attribute_conflicts(kept.select("cand_id", "user_id", V.attribute(F.col("attribute")).alias("attribute"), V.condition(F.col("condition")).alias("condition"), "text"), active, self.conflict)
        pairs = materialize(replaced.unionByName(clashes.select("existing_id", "verdict")))
        longer = F.when((F.col("decision") == "merge") & (F.length("existing_text") > F.length("text")), F.col("existing_text")).otherwise(F.col("text"))
        merged = kept.join(about.select("existing_id", "existing_text"), "existing_id", "left").withColumn("memory", longer)
        meta = filters.fact_metadata(merged, now)
        new = meta.select(
            F.col("cand_id").alias("fact_id"), "user_id", "memory", "embedding", F.col("timestamp").alias("ts"), "category", "subcategory", "importance", "tier", F.split("tags_csv", ",").alias("tags"),
            "attribute", "condition", "scope", "channel_id", "episode_id", F.lit(1).alias("mention_count"), F.lit(0).alias("recall_count"), F.array(F.lit(now).cast("long")).alias("reinforced_at"),
        )
        new = materialize(new)
        again = materialize(decided.where("decision = 'duplicate'").select(F.col("existing_id").alias("fact_id"), F.lit(now).cast("long").alias("t")))
        touched = again.select("fact_id").unionByName(pairs.select(F.col("existing_id").alias("fact_id"))).distinct()
        updated = ingest.archive(ingest.reinforce(facts.join(touched, "fact_id", "left_semi"), again, s), pairs, now)
        rows = materialize(updated.unionByName(new, allowMissingColumns=True))
        self.store.upsert("facts", rows)
        self.keywords.add(new)
        self.store.add("ledger", new.where("attribute is not null").select("fact_id", "user_id", "attribute", F.col("memory").alias("value_text"), F.col("ts").alias("created_at")))
        if "entities" in extracted.columns:
            self._link(kept, now)
        if relations is not None:
            self._relate(relations, now)
        outcome = gated.join(decided.select("cand_id", "decision", "existing_id"), "cand_id", "left").join(known, "cand_id", "left")
        label = F.when(F.col("verdict") != "kept", F.col("verdict")).when(F.col("_known"), "dup").when(F.col("decision").isin("duplicate", "merge"), F.col("decision")).otherwise("kept")
        return outcome.select("batch_id", "ordinal", label.alias("outcome"), F.col("cand_id").alias("fact_id"), "existing_id")

    def _link(self, kept: DataFrame, now: int) -> None:
        rows = kept.select("cand_id", "user_id", F.explode("entities").alias("e")).select("cand_id", "user_id", "e.name", "e.type", "e.aliases")
        entities, aliases = graph.upsert_entities(rows, self.table("entities"), self.table("aliases"), now)
        entities, aliases = self.store.write("entities", materialize(entities)), self.store.write("aliases", materialize(aliases))
        asked = rows.select(F.struct("cand_id", "name").alias("query_id"), "user_id", "name")
        found = graph.find_entities(asked, entities, aliases, fuzzy=False)
        new = found.select(F.col("query_id.cand_id").alias("fact_id"), "entity_id", F.lit("mention").alias("role"), F.lit(now).cast("long").alias("created_at"))
        known = self.table("edges").select("fact_id", "entity_id")
        self.store.add("edges", materialize(new.dropDuplicates(["fact_id", "entity_id"]).join(known, ["fact_id", "entity_id"], "left_anti")))

    def _relate(self, relations: DataFrame, now: int) -> None:
        known = graph.resolve_relations(relations, self.table("entities"), self.table("aliases"))
        old = self.table("relations")
        new = graph.open_relations(old, known).withColumn("created_at", F.lit(now).cast("long"))
        new = new.withColumn("relation_id", F.shiftrightunsigned(F.xxhash64("src_entity_id", "rel_type", "dst_entity_id", "user_id", "created_at"), 1))
        self.store.add("relations", materialize(new))

    def expire_relations(self, ended: DataFrame) -> DataFrame:
        """Relations (relation_id, ended_at) closed, unless they are already."""
        open_ones = self.table("relations").join(ended.select("relation_id"), "relation_id", "left_semi")
        return self.store.upsert("relations", materialize(graph.expire_relations(open_ones, ended)))

    def index_lines(self, lines: DataFrame) -> DataFrame:
        """Transcript lines added, each (channel, time, role, text) once."""
        return self.store.add("history", materialize(consolidate.new_lines(lines, self.table("history"))))

    def replay(self) -> DataFrame:
        """The next turns of every channel; the cursors behind them are stored once they have been written."""
        turns, cursors = consolidate.replay(self.table("history"), self.table("cursors"), self.settings)
        turns, cursors = materialize(turns), materialize(cursors)
        self.store.upsert("cursors", cursors)
        return turns

    def attribute_history(self, limit: int = 50) -> DataFrame:
        """The newest versions of every user's attributes, each with what it replaced and what replaced it."""
        return ingest.ledger_history(ingest.ledger(self.table("ledger")), limit)

    def stats(self) -> DataFrame:
        """Rows (kind, n): entities, edges, relations, facts, indexed facts, transcript lines, attribute versions."""
        counts = [self.table(t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, t in (("facts", "facts"), ("indexed", "postings"), ("lines", "history"), ("versions", "ledger"))]
        return reduce(DataFrame.unionByName, counts, graph.stats(self.table("entities"), self.table("edges"), self.table("relations")))

    # Recall. queries: query_id, user_id, text, q (vector), channel_id.

    def search_memories(self, queries: DataFrame, now: int, limit: int = 8) -> DataFrame:
        """Nearest facts of each query's user: the cut first, then distance, validity and scope."""
        facts, s = self.table("facts"), self.settings
        near = search.knn(queries, facts.where("embedding is not null"), limit, on=["user_id"], max_distance=s.relevance_max_distance)
        known = facts.select("fact_id", "memory", "valid_to", "scope")
        rows = near.join(known, "fact_id").join(queries.select("query_id", "channel_id"), "query_id")
        return rows.where(filters.is_valid(F.col("valid_to"), now, s) & filters.in_scope(F.col("scope"), F.col("channel_id"), s)).select("query_id", "fact_id", "memory", "score", "rank")

    def search_memories_multi(self, variants: DataFrame, now: int, limit: int = 8) -> DataFrame:
        """Variants of questions (question, variant_ord and the query columns) searched and merged: the first copy of a fact counts."""
        hits = self.search_memories(variants, now, limit).join(variants.select("query_id", "question", "variant_ord"), "query_id")
        return search.merge_lists(hits.select("question", F.col("variant_ord").alias("list_ord"), "fact_id", "memory", "score", F.col("rank").alias("pos")), limit, "question")

    def variants_of(self, queries: DataFrame, rewriters: list[Rewriter], embed: Rewriter) -> DataFrame:
        """Other forms of each question for `search_memories_smart`: query_id, variant_ord, q, terms. A rewriter makes a string or an array of strings from a text column (null or
        empty: none, as when no model answers); embed makes the vector."""
        rows = queries.select("query_id", "text", *[f(F.col("text")).alias(f"v{k}") for k, f in enumerate(rewriters)])
        forms = search.expand_queries(rows, ["text", *[f"v{k}" for k in range(len(rewriters))]]).where("variant_ord > 0")
        return forms.select("query_id", "variant_ord", embed(F.col("variant")).alias("q"), F.slice(self.tokenize(F.col("variant")), 1, 10).alias("terms"))

    def search_memories_smart(
        self, queries: DataFrame, now: int, limit: int = 5, include_core: bool = True, variants: DataFrame | None = None,
        primed: DataFrame | None = None, reranker: recall.Reranker | None = None, reinforce: bool = False,
    ) -> DataFrame:
        """The whole recall of `recall.smart`; with reinforce, what was found by search is stored as recalled."""
        asked = queries.withColumn("terms", F.slice(self.tokenize(F.col("text")), 1, 10))
        facts, edges = self.table("facts"), self.table("edges")
        found = recall.smart_recall(asked, facts, edges, now, limit, self.settings, variants, primed, reranker, self.keywords.search)
        out = recall.smart(asked, facts, edges, now, limit, self.settings, include_core, found)
        if reinforce:
            out = materialize(out)
            self.reinforce_recalled(found.recalled(), now)
        return out

    def reinforce_recalled(self, hits: DataFrame, now: int) -> DataFrame:
        ids = materialize(filters.countable_recall(hits).select("fact_id").distinct())
        facts = self.table("facts").join(ids, "fact_id", "left_semi")
        return self.store.upsert("facts", materialize(ingest.reinforce_recalled(facts, ids, now, self.settings)))

    def search_history(self, queries: DataFrame, limit: int = 5) -> DataFrame:
        """Transcript lines of each query's channel by keyword."""
        lines = self.table("history").withColumn("line_id", T.line_id(F.col("channel_id"), F.col("ts").cast("string"), F.col("role"), F.col("text")))
        asked = queries.select("query_id", "channel_id", F.slice(search.tokens(F.col("text")), 1, 10).alias("terms"))
        hits = search.keyword_search(asked, lines, limit, doc="line_id", scope="channel_id")
        return hits.join(lines.select("line_id", "ts", "role", "author", "text"), "line_id")

    def get_all_memories(self, user_id: str, limit: int | None = None) -> DataFrame:
        return self.store.scan("facts", user_id, limit)

    def list_memories(self, now: int, limit: int = 50) -> DataFrame:
        return filters.listing(self.table("facts"), now, limit=limit)

    def delete_memory(self, ids: DataFrame) -> None:
        """Facts, their edges and what the keyword index has of them."""
        self.store.delete(materialize(ids.select("fact_id")), "facts", "edges", self.keywords.name)

    # Consolidation; apply=False only reports.

    def recompute_tiers(self, now: int, apply: bool = False) -> DataFrame:
        tiers = materialize(consolidate.recomputed_tiers(self.table("facts"), now, self.settings))
        if apply:
            self.store.update("facts", tiers.where("old_tier is null or old_tier <> new_tier").select("fact_id", F.col("new_tier").alias("tier")))
        return tiers.groupBy("old_tier", "new_tier").agg(F.count(F.lit(1)).alias("n"))

    def compress_gists(self, now: int, apply: bool = False) -> DataFrame:
        new, members = consolidate.gists(self.table("facts"), self.table("edges"), self.table("entities"), now, self.settings)
        new, members = materialize(new), materialize(members)
        if apply:
            facts = ingest.update_partial(self.store.get("facts", members), members)
            added = new.select(F.col("gist_id").alias("fact_id"), "user_id", "memory", "ts", "category", F.col("importance").cast("int").alias("importance"), "tier", "gist_of")
            self.store.upsert("facts", materialize(facts.unionByName(added, allowMissingColumns=True)))
            self.keywords.add(added)
            edges = new.select(F.col("gist_id").alias("fact_id"), "entity_id", F.lit("gist").alias("role"), F.col("ts").alias("created_at"))
            self.store.add("edges", edges)
        return new

    def abstract_schemas(self) -> DataFrame:
        return consolidate.schemas(self.table("facts"), self.table("edges"), self.table("entities"), self.settings)
