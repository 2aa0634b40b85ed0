"""Corpus cleaning and packing: toxicity, quality classifier, line dedup, near duplicates, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs. The first four return exactly the columns of docs, whatever their names: labels or
scores of a caller's (`toxic`, `quality`, `score`, `evidence`, `good`, `kept`, ..) are neither read nor overwritten. docs has doc_id, text, source and lang. The last stage
returns the pieces. In every stage an empty table gives an empty table, and a text of any length is read as a whole. For the other cases see each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallkit.llm import linededup, nearjoin, packing, qualityclassifier, toxicity
from recallkit.llm.queries import WORD_FILE, small_batches, table
from recallkit.session import broadcast_if_small, discard, materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3, by a model of the labels that are not held out.

    Null and empty texts score 0 and stay; repeated rows and equal texts stay or go together; a null doc_id has no label and is scored
    like any other; null labels are left out; without labels of both kinds all stay; a score of exactly 0.3 goes.
    """
    small_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text"))
    kept = toxicity.score(rows, model).where("score < 0.3")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality by their own evidence and their site's.

    Null and empty texts have the model's score of an empty document; null source or lang are sites of their own; repeated rows stay or
    go together; without labels of both kinds all stay; a posterior of exactly 0.4 stays.
    """
    small_batches(spark)
    model = qualityclassifier.train(docs, table(spark, sf_dir, "labels"))
    return qualityclassifier.keep_good(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; all documents stay.

    A null text stays null, an empty one empty; a line that repeats inside the largest document that holds it keeps all its places there; repeated rows (doc_id and
    text) are one document; rows without doc_id lose lines that documents hold, and keep others.
    """
    return linededup.reduce(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links join: the one with the least doc_id (rows without one come last, ties go to the least hash of the text).

    Of repeated rows (same doc_id and text) one stays; different texts under one doc_id are judged each by itself; texts without
    words (null, empty) have no copies and stay, repeated rows among them once.
    """
    small_batches(spark)
    classes = materialize(nearjoin.near_classes(docs))
    gone = broadcast_if_small(materialize(classes.where("not first").select(F.col("doc_id").alias("_gone_doc"), F.col("text_hash").alias("_gone_text")).distinct()))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_text"))
    left = rows.join(gone, F.col("_doc").eqNullSafe(F.col("_gone_doc")) & (F.col("_text") == F.col("_gone_text")), "left_anti")
    repeated = not classes.where("first").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    discard(classes)
    left = left.dropDuplicates(["_doc", "_text"]) if repeated else left
    return left.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of the documents left and their places in sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece, the end id; longer texts than a sequence are cut; pieces of equal length are told apart by (doc_id, piece), and repeated rows each
    have a place of their own; other columns are left out.
    """
    import public_tokenizers

    small_batches(spark)
    cut = packing.pieces(docs.select("doc_id", "text"), public_tokenizers.path(WORD_FILE))
    narrow = materialize(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return packing.pack(narrow).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("best-fit packing", pack),
]

#: The trained stages can't be put in SQL; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
