"""The entity graph: lookup, co-occurrence, spreading activation, temporal relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallkit.config import DEFAULT, Settings
from recallkit.functions import memory_math as M
from recallkit.functions import text as T
from recallkit.operators.filters import in_scope, is_valid


def fact_entities(edges: DataFrame, entities: DataFrame) -> DataFrame:
    return edges.join(entities, "entity_id")


def degrees(edges: DataFrame) -> DataFrame:
    """Facts per entity; repeated edges count once."""
    return edges.select("entity_id", "fact_id").distinct().groupBy("entity_id").agg(F.count(F.lit(1)).alias("degree"))


def co_occurrence(edges: DataFrame, limit: int = 10, of: DataFrame | None = None) -> DataFrame:
    """Each entity's neighbours by facts in common: entity_id, other_id, shared, weight = shared / sqrt(degree * degree), at most 1.

    As many as three times the limit are taken by the shared count first, then the limit by weight. `of` (entity_id) limits
    whose neighbours are wanted before the self-join; pairs are counted before the shuffle. One fact names few entities.
    """
    distinct = edges.select("entity_id", "fact_id").distinct()
    deg = degrees(edges)
    own = distinct if of is None else distinct.join(of.select("entity_id").distinct(), "entity_id", "left_semi")
    other = distinct.select(F.col("entity_id").alias("other_id"), "fact_id")
    pairs = own.join(other, "fact_id").where(F.col("entity_id") != F.col("other_id")).groupBy("entity_id", "other_id").agg(F.count(F.lit(1)).alias("shared"))
    first = Window.partitionBy("entity_id").orderBy(F.desc("shared"), "other_id")
    top = pairs.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= max(3 * limit, limit)).drop("_n")
    top = top.join(deg, "entity_id").join(deg.select(F.col("entity_id").alias("other_id"), F.col("degree").alias("_d")), "other_id")
    weighted = top.select("entity_id", "other_id", "shared", F.least(F.lit(1.0), F.col("shared") / F.sqrt(F.col("degree").cast("double") * F.col("_d"))).alias("weight"))
    order = Window.partitionBy("entity_id").orderBy(F.desc(F.round("weight", 12)), "other_id")
    return weighted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def related_facts(edges: DataFrame, wanted: DataFrame, limit: int = 20, exclude: DataFrame | None = None, by: list[str] | None = None, match: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """The newest facts of each wanted (key.., entity_id), facts in exclude (key.., fact_id) left out before the cut. match: columns that edge and wanted row have in common."""
    keys = by or []
    rows = edges.groupBy(*match, "fact_id").agg(F.max("created_at").alias("created_at")).join(wanted, list(match))
    if exclude is not None:
        rows = rows.join(exclude, [*keys, "fact_id"], "left_anti")
    order = Window.partitionBy(*keys, "entity_id").orderBy(F.desc("created_at"), "fact_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def surfaces(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(surface, user_id, entity_id, how): canonical names first, then aliases."""
    return entities.select(F.col("canonical_name").alias("surface"), "user_id", "entity_id", F.lit(0).alias("how")).unionByName(
        aliases.join(entities, "entity_id").select(F.col("alias").alias("surface"), "user_id", "entity_id", F.lit(1).alias("how"))
    )


def find_entities(queries: DataFrame, entities: DataFrame, aliases: DataFrame, fuzzy: bool = True) -> DataFrame:
    """The entity of each (query_id, user_id, name): by canonical name, else by alias, else by prefix (ASCII letters of either case), the most mentioned one.

    Of several on the same level the least entity_id counts, for prefixes the most mentioned first; an entity without an id is none. Names asked
    and surfaces are grouped in one shuffle, and queries meet one answer for each name, so no query is paired with all names of its user. A name
    that stands for several entities is cut once, to the lengths of the names asked that no surface equals. Names can't be null after the
    first filter, and both readers of the groups use all their columns: else Spark adds filters or drops columns, and groups anew for each reader.
    """
    asked = queries.where("user_id is not null and name is not null")
    asked = asked.select("query_id", "user_id", F.coalesce(T.normalize_name(F.col("name")), F.lit("")).alias("name"))
    forms = surfaces(entities, aliases).where("user_id is not null and surface is not null and entity_id is not null")
    forms = forms.select("user_id", F.coalesce("surface", F.lit("")).alias("name"), F.when(F.col("how") == 0, F.col("entity_id")).alias("_e0"), F.when(F.col("how") == 1, F.col("entity_id")).alias("_e1"), F.lit(False).alias("_q"))
    both = forms.unionByName(asked.select("user_id", "name", F.lit(True).alias("_q")), allowMissingColumns=True)
    known = both.groupBy("user_id", "name").agg(F.min("_e0").alias("_e0"), F.min("_e1").alias("_e1"), F.max("_q").alias("_q")).where("_q")
    same = F.struct(F.when(F.col("_e0").isNull(), 1).otherwise(0).alias("level"), F.lit(0).cast("long").alias("_m"), F.coalesce("_e0", "_e1").alias("entity_id"))
    answers = known.where("_e0 is not null or _e1 is not null").select("user_id", "name", same.alias("_b"))
    if fuzzy:
        sought = known.where("_e0 is null and _e1 is null").select("user_id", "name", F.lower("name").alias("_p"))
        lengths = sought.select(F.char_length("_p").alias("_k")).distinct()
        first = F.min(F.struct(F.lit(2).alias("level"), (-F.col("mention_count")).cast("long").alias("_m"), "entity_id")).alias("_b")
        named = entities.where("entity_id is not null").groupBy("user_id", F.lower("canonical_name").alias("_c")).agg(first)
        cut = named.join(F.broadcast(lengths), F.col("_k") <= F.char_length("_c")).select("user_id", F.substring("_c", F.lit(1), F.col("_k")).alias("_p"), "_b")
        begun = cut.groupBy("user_id", "_p").agg(F.min("_b").alias("_b"))
        answers = answers.unionByName(sought.join(begun, ["user_id", "_p"]).select("user_id", "name", "_b"))
    found = asked.join(answers, ["user_id", "name"])
    return found.groupBy("query_id").agg(F.min("_b").alias("_b")).select("query_id", F.col("_b.entity_id").alias("entity_id"), F.col("_b.level").alias("level"))


def upsert_entities(new: DataFrame, entities: DataFrame, aliases: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Mentions (name, type, user_id, aliases array) merged in: the entities and aliases afterwards.

    A mention whose name or alias is known counts for that entity (the least id); others make one new entity per
    (name, user), whose id is their hash. All other surface forms become aliases.
    """
    forms = new.select("user_id", T.normalize_name(F.col("name")).alias("name"), "type", F.monotonically_increasing_id().alias("_m"), F.coalesce("aliases", F.array().cast("array<string>")).alias("_a"))
    forms = forms.withColumn("form", F.explode(F.array_distinct(F.concat(F.array("name"), F.transform("_a", T.normalize_name))))).where("form <> ''")
    known = surfaces(entities, aliases).select(F.col("surface").alias("form"), "user_id", "entity_id")
    hit = forms.join(known, ["form", "user_id"], "left").groupBy("_m", "user_id", "name", "type").agg(F.min("entity_id").alias("entity_id"), F.collect_set("form").alias("forms"))
    fresh = hit.where("entity_id is null").groupBy("name", "user_id").agg(F.min_by("type", "_m").alias("type"), F.count(F.lit(1)).alias("mention_count"), F.flatten(F.collect_set("forms")).alias("forms"))
    fresh = fresh.withColumn("entity_id", F.shiftrightunsigned(F.xxhash64("user_id", "name"), 1))
    counts = hit.where("entity_id is not null").groupBy("entity_id").agg(F.count(F.lit(1)).alias("_more"))
    merged = entities.join(counts, "entity_id", "left").withColumn("mention_count", (F.col("mention_count") + F.coalesce("_more", F.lit(0))).cast("int")).select(*entities.columns)
    added = fresh.select(F.col("entity_id").cast("long").alias("entity_id"), F.col("name").alias("canonical_name"), "type", "user_id", F.lit(now).cast("long").alias("created_at"), F.col("mention_count").cast("int").alias("mention_count"))
    after = merged.unionByName(added.select(*entities.columns))
    pairs = hit.where("entity_id is not null").select("entity_id", F.explode("forms").alias("alias")).unionByName(fresh.select("entity_id", F.explode("forms").alias("alias")))
    names = after.select("entity_id", "canonical_name")
    pairs = pairs.join(names, "entity_id").where(F.col("alias") != F.col("canonical_name")).select("entity_id", "alias")
    return after, aliases.unionByName(pairs).distinct()


def alias_variants(queries: DataFrame, found: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Other names of the entity found for each query (query_id, text), in order, without the query itself."""
    names = entities.select("entity_id", F.col("canonical_name").alias("variant")).unionByName(aliases.select("entity_id", F.col("alias").alias("variant")))
    rows = queries.select("query_id", "text").join(found.select("query_id", "entity_id"), "query_id").join(names, "entity_id")
    return rows.where(F.lower("variant") != F.lower("text")).select("query_id", "variant").distinct()


def top_entities(entities: DataFrame, limit: int = 30) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(F.desc("mention_count"), "entity_id")
    return entities.where("mention_count >= 2").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def primed(touches: DataFrame, now: Column | int | float, s: Settings = DEFAULT) -> DataFrame:
    """The entities touched within the time to live (strictly), the most recent ones of each (user_id, channel_id); touches: user_id, channel_id, entity_id, t."""
    last = touches.groupBy("user_id", "channel_id", "entity_id").agg(F.max("t").alias("touched"))
    order = Window.partitionBy("user_id", "channel_id").orderBy(F.desc("touched"), "entity_id")
    return last.withColumn("_n", F.row_number().over(order)).where((F.col("_n") <= s.priming_max) & (F.lit(now) - F.col("touched") < s.priming_ttl)).drop("_n")


def spread(seeds: DataFrame, neighbours: DataFrame, primed_entities: DataFrame | None = None, s: Settings = DEFAULT) -> DataFrame:
    """Activation (query_id, entity_id, activation) after spreading from seeds over weighted neighbours.

    A hop passes activation * weight * gamma on and keeps the maximum; what falls below the least activation stops.
    As many hops are recorded as max_hops less one: the last frontier is not. Primed entities (query_id, entity_id) get their bonus at
    the end, also if they were not reached.
    """
    frontier = seeds.groupBy("query_id", "entity_id").agg(F.max("activation").alias("activation"))
    seen = frontier
    for _ in range(s.max_hops - 1):
        passed = frontier.join(neighbours, "entity_id").select("query_id", F.col("other_id").alias("entity_id"), (F.col("activation") * F.col("weight") * s.gamma).alias("activation"))
        frontier = passed.where(F.col("activation") >= s.min_activation).groupBy("query_id", "entity_id").agg(F.max("activation").alias("activation"))
        seen = seen.unionByName(frontier).groupBy("query_id", "entity_id").agg(F.max("activation").alias("activation"))
    if primed_entities is not None:
        extra = primed_entities.select("query_id", "entity_id").distinct().withColumn("activation", F.lit(s.priming_bonus))
        seen = seen.unionByName(extra).groupBy("query_id", "entity_id").agg(F.sum("activation").alias("activation"))
    return seen


def expand_siblings(hits: DataFrame, edges: DataFrame, neighbours: DataFrame, facts: DataFrame, asked: DataFrame, now: int, primed_entities: DataFrame | None = None, seeds: int = 3, per_entity: int = 5, s: Settings = DEFAULT) -> DataFrame:
    """Facts of the asking user that share entities with the first hits of each query, or with their neighbours: query_id, fact_id, activation, score.

    hits: query_id, fact_id, score, rank; asked: query_id, user_id, channel_id. Facts among the hits, archived and out-of-scope ones are left out, those of
    other users before the cut per entity.
    """
    first = hits.where(F.col("rank") <= seeds).select("query_id", "fact_id", M.seed_activation(F.col("score")).alias("activation"))
    links = edges.select("fact_id", "entity_id").distinct()
    start = first.join(links, "fact_id").select("query_id", "entity_id", "activation")
    near = neighbours.where(F.col("rank") <= per_entity).select("entity_id", "other_id", "weight")
    active = spread(start, near, primed_entities, s).join(asked.select("query_id", "user_id"), "query_id")
    owned = edges.join(facts.select("fact_id", "user_id"), "fact_id")
    found = related_facts(owned, active, per_entity, hits.select("query_id", "fact_id").distinct(), ["query_id"], ("entity_id", "user_id"))
    best = found.groupBy("query_id", "fact_id").agg(F.max("activation").alias("activation"))
    known = best.join(facts.select("fact_id", "valid_to", "scope"), "fact_id").join(asked.select("query_id", "channel_id"), "query_id")
    shown = known.where(is_valid(F.col("valid_to"), now, s) & in_scope(F.col("scope"), F.col("channel_id"), s))
    return shown.select("query_id", "fact_id", "activation", M.sibling_distance(F.col("activation"), s).alias("score"))


def relations_of(relations: DataFrame, now: int, only_valid: bool = True, limit: int = 50, side: str = "any") -> DataFrame:
    """Each entity's newest relations (entity_id, ..), as source, as target, or either."""
    rows = relations.where(is_valid(F.col("valid_to"), now)) if only_valid else relations
    ends = {"src": ["src_entity_id"], "dst": ["dst_entity_id"], "any": ["src_entity_id", "dst_entity_id"]}[side]
    rows = rows.withColumn("entity_id", F.explode(F.array_distinct(F.array(*ends))))
    order = Window.partitionBy("entity_id").orderBy(F.desc("created_at"), "relation_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def open_relations(relations: DataFrame, new: DataFrame) -> DataFrame:
    """New relations (src, rel_type, dst, user, ..) that are not open yet, each once."""
    keys = ["src_entity_id", "rel_type", "dst_entity_id", "user_id"]
    return new.dropDuplicates(keys).join(relations.where("valid_to is null").select(*keys), keys, "left_anti")


def expire_relations(relations: DataFrame, ended: DataFrame) -> DataFrame:
    """relations with valid_to set for those of ended (relation_id, ended_at), unless an end is set already."""
    return relations.join(ended, "relation_id", "left").withColumn("valid_to", F.coalesce("valid_to", "ended_at")).select(*relations.columns)


def resolve_relations(raw: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Relations by name (user_id, src, rel_type, dst) whose two ends are known entities."""
    names = surfaces(entities, aliases).groupBy("surface", "user_id").agg(F.min(F.struct("how", "entity_id")).alias("_b")).select("surface", "user_id", F.col("_b.entity_id").alias("_id"))
    a = raw.join(names.withColumnsRenamed({"surface": "src", "_id": "src_entity_id"}), ["src", "user_id"])
    return a.join(names.withColumnsRenamed({"surface": "dst", "_id": "dst_entity_id"}), ["dst", "user_id"]).select("user_id", "src_entity_id", "rel_type", "dst_entity_id")


def stats(entities: DataFrame, edges: DataFrame, relations: DataFrame) -> DataFrame:
    """Rows per kind, one column each."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in (("entities", entities), ("edges", edges), ("relations", relations))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
