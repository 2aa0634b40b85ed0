"""Controlled vocabularies: attributes, conditions, scopes, values, cardinalities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
SINGLE_ATTRIBUTES = ("weight", "height", "residence", "occupation", "affiliation", "relationship_status", "current_focus")
DOMAINS = ("habit", "preference", "possession")
CONDITION_AXES = ("time", "context")
SCOPES = ("global", "conversation", "meta")
RELATION_TYPES = ("loves", "dislikes", "knows", "works_at", "lives_in", "made_by", "is_about", "friend_of", "parent_of", "sibling_of")
EMPTY_WORDS = ("", "none", "null", "n/a", "-")
LONGEST, LONGEST_UNIT = 48, 16


def _clean(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", ""))


def _head(c: Column, mark: str) -> Column:
    return F.substring_index(c, mark, 1)


def attribute(raw: Column) -> Column:
    """A known single attribute, domain.x, custom:x, or empty."""
    a = _clean(raw)
    known_domain = a.contains(".") & _head(a, ".").isin(*DOMAINS)
    return (
        F.when(a.isin(*EMPTY_WORDS), "")
        .when(a.isin(*SINGLE_ATTRIBUTES), a)
        .when(known_domain | a.startswith("custom:"), F.substring(a, 1, LONGEST))
        .otherwise(F.substring(F.concat(F.lit("custom:"), a), 1, LONGEST))
    )


def condition(raw: Column) -> Column:
    """time:x, context:x, custom:x, or empty."""
    c = _clean(raw)
    known = (c.contains(":") & _head(c, ":").isin(*CONDITION_AXES)) | c.startswith("custom:")
    return F.when(c.isin(*EMPTY_WORDS), "").when(known, F.substring(c, 1, LONGEST)).otherwise(F.substring(F.concat(F.lit("custom:"), c), 1, LONGEST))


def scope(raw: Column) -> Column:
    s = _clean(raw)
    return F.when(s.isin(*SCOPES), s).otherwise("global")


def quantity(raw: Column) -> Column:
    """From JSON text: struct(type, value, unit) of a quantity with a number and a unit, else null."""
    v = F.try_parse_json(raw)
    kind = F.try_variant_get(v, "$.type", "string")
    number = F.when(F.schema_of_variant(F.try_variant_get(v, "$.value", "variant")).rlike("^(BIGINT|INT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$.value", "double"))
    named = F.schema_of_variant(F.try_variant_get(v, "$.unit", "variant")) == "STRING"
    unit = F.when(named, F.substring(_clean(F.try_variant_get(v, "$.unit", "string")), 1, LONGEST_UNIT))
    return F.when((kind == "quantity") & number.isNotNull() & (F.coalesce(unit, F.lit("")) != ""), F.struct(kind.alias("type"), number.alias("value"), unit.alias("unit")))


def cardinality(name: Column) -> Column:
    """single, temporal (both replaced by news) or set_like (news is added)."""
    a = F.lower(F.coalesce(name, F.lit("")))
    base = _head(_head(a, "."), ":")
    return F.when(a == "weight", "temporal").when(a.isin(*SINGLE_ATTRIBUTES), "single").when(base.isin(*DOMAINS) | a.startswith("custom:"), "set_like").otherwise("single")


def replaces(name: Column) -> Column:
    return cardinality(name).isin("single", "temporal")


def condition_relation(one: Column, other: Column) -> Column:
    """same, disjoint, subset, superset or unknown; only disjoint conditions can't conflict."""
    a, b = _clean(one), _clean(other)
    va, vb = (F.regexp_replace(x, "^[^:]*:", "") for x in (a, b))
    return (
        F.when((a == "") | (b == ""), "unknown")
        .when(a == b, "same")
        .when(_head(a, ":") != _head(b, ":"), "unknown")
        .when(F.startswith(va, F.concat(vb, F.lit("."))), "subset")
        .when(F.startswith(vb, F.concat(va, F.lit("."))), "superset")
        .otherwise("disjoint")
    )


def may_conflict(one: Column, other: Column) -> Column:
    return condition_relation(one, other) != "disjoint"


def compare_quantities(old: Column, new: Column) -> Column:
    """same, changed or unit_mismatch; null unless both are quantities."""
    return F.when(old.isNotNull() & new.isNotNull(), F.when(old["unit"] != new["unit"], "unit_mismatch").when(old["value"] == new["value"], "same").otherwise("changed"))


def expand_groups(facts: DataFrame, groups: dict[str, list[str]] | None = None, name: str = "attribute") -> DataFrame:
    """Rows with `group_member`: every attribute of the row's conflict group, itself alone if it is in none; none for an empty one. groups is configuration, so its table is small."""
    rows = [(m, sorted(ms)) for ms in (groups or {}).values() for m in ms]
    table = facts.sparkSession.createDataFrame(rows, "_a string, _members array<string>")
    own = F.lower(F.col(name))
    joined = facts.where(F.coalesce(F.col(name), F.lit("")) != "").join(F.broadcast(table), own == F.col("_a"), "left")
    return joined.withColumn("group_member", F.explode(F.coalesce("_members", F.array(own)))).drop("_a", "_members")
