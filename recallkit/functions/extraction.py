"""What a model's extraction reply holds: parsed, salvaged where it breaks off, validated and normalised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallkit.functions import text as T
from recallkit.functions import vocabulary as V
from recallkit.operators.filters import valid_relations

ENTITY = "struct<name:string,type:string,aliases:array<string>>"
FACT = f"struct<speaker:string,text:string,importance:int,category:string,subcategory:string,tags:array<string>,attribute:string,condition:string,scope:string,value:struct<type:string,value:double,unit:string>,entities:array<{ENTITY}>>"
RELATION = "struct<src:string,rel_type:string,dst:string>"
REPLY = f"struct<facts:array<{FACT}>,relations:array<{RELATION}>>"
#: Fixed value: words that carry no content in a query.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with")


def signals(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """replies with facts and relations of each reply; a reply that is no JSON gives the complete facts it begins with, and no relations.

    Facts stay if their speaker is self and they have a text; their attribute, condition and scope are normalised.
    """
    body = T.strip_fence(F.col(reply))
    rows = replies.withColumn("_r", F.from_json(body, REPLY))
    whole = F.try_parse_json(body).isNotNull()
    salvaged = F.transform(T.salvage_objects(body, F.lit("facts")), lambda o: F.from_json(o, FACT))
    rows = rows.withColumn("_f", F.when(whole, F.col("_r.facts")).otherwise(salvaged))
    good = F.filter(F.coalesce("_f", F.from_json(F.lit("[]"), f"array<{FACT}>")), lambda f: (f["speaker"] == "self") & (F.coalesce(f["text"], F.lit("")) != ""))
    clean = F.transform(good, lambda f: f.withField("attribute", V.attribute(f["attribute"])).withField("condition", V.condition(f["condition"])).withField("scope", V.scope(f["scope"])))
    relations = F.when(whole, valid_relations(F.col("_r.relations")))
    return rows.withColumns({"facts": clean, "relations": F.coalesce(relations, F.from_json(F.lit("[]"), f"array<{RELATION}>"))}).drop("_r", "_f")


def content_terms(terms: Column, most: int = 8) -> Column:
    """Of a query's terms the first ones with content: no stop words, two characters at least, each once."""
    return F.slice(F.array_distinct(F.filter(terms, lambda t: (F.length(t) >= 2) & ~t.isin(*STOP_WORDS))), 1, most)


def line_vectors(lines: DataFrame, embed, limit: int = 4000) -> DataFrame:
    """Transcript lines with an id and the vector of their (cut) text, the latest copy of each id; embed makes a vector column of a text column."""
    ids = T.line_id(F.col("channel_id").cast("string"), F.col("ts").cast("string"), F.col("role"), F.col("text"))
    rows = lines.where(F.coalesce("text", F.lit("")) != "").withColumn("line_id", ids)
    last = rows.groupBy("line_id").agg(F.max_by(F.struct("channel_id", "ts", "role", "author", "text"), "seq").alias("_l"))
    return last.select("line_id", "_l.*").withColumn("embedding", embed(T.safe_text(F.col("text"), limit)))
