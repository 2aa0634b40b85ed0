"""A bounded sample of labelled texts on the driver, for the operators that fit a classifier."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallkit.session import discard, materialize

from .textvec import trim


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, rows: int, most_bytes: int, doc: str = "doc_id", text: str = "text") -> tuple[list[str], np.ndarray]:
    """At most `rows` whole texts of at most `most_bytes` together, with their labels.

    (document, label) pairs are taken in the order of the document's hash; one whose text doesn't fit into the bytes that are left is
    passed over. Null labels, ids and texts are left out; a document with several labels counts once for each; of several texts
    under one id the least counts. Only pairs and lengths are looked at before the bound holds: `rows` of them.
    """
    order = [F.xxhash64("_doc"), "_doc", "_label"]
    pairs = labels.select(F.col(doc).alias("_doc"), F.col(label).cast("double").alias("_label")).dropna().distinct()
    chosen = pairs.orderBy(*order).limit(rows)  # bounded, so its broadcast is
    texts = docs.select(F.col(doc).alias("_id"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    found = materialize(texts.join(F.broadcast(chosen), F.col("_id") == F.col("_doc")).groupBy("_doc", "_label").agg(F.min("_text").alias("_text")))
    left, fits = most_bytes, []
    for r in found.select(F.xxhash64("_doc").alias("_k"), "_doc", "_label", F.octet_length("_text").alias("_n")).orderBy("_k", "_doc", "_label").collect():
        if r["_n"] <= left:
            left -= r["_n"]
            fits.append((r["_doc"], r["_label"]))
    kept = found
    if len(fits) < found.count():
        fitting = docs.sparkSession.createDataFrame(fits, found.select("_doc", "_label").schema)
        kept = found.join(F.broadcast(fitting), ["_doc", "_label"], "left_semi")
    table = kept.toArrow()
    discard(found)
    order = pc.sort_indices(table, [("_doc", "ascending"), ("_label", "ascending")])
    values, where = table.column("_text").to_pylist(), order.to_pylist()
    labels_of = table.column("_label").to_numpy()[order.to_numpy()]
    del table
    trim()  # the copies in Arrow
    return [values[k] for k in where], labels_of
