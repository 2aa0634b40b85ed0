"""Operator 6: quality by hierarchical empirical Bayes.

A logistic model over character classes, word shapes and word endings gives each document's own evidence. Documents
are grouped by host (here `source`) and, inside a host, by path (here `lang`); the groups' mean evidence is shrunk: paths
towards their host, hosts towards the global mean, each by a prior strength that the spread between groups
tells (method of moments). The posterior adds the path's shrunken log-odds, against the global ones, to the document's:

    logit(quality) = logit(document) + logit(path) - logit(global)

Group statistics are sums over all documents (partial sums before any shuffle, so one host may hold any share of the
rows). The document model is fitted on at most `rows` labelled documents and `most_bytes` of whole texts (`labelled_texts`): that is the documented bound
of the sample. Each text is scored once; what the rows carry on is written with its evidence, read for the sums and read again for the posteriors.

Defined cases: null or empty text has the model's score of an empty document; null host or path form a group of
their own; without usable labels of both kinds every document's evidence is 1 (nothing is rejected); several labels of one document all count;
repeated rows score alike; an empty table gives an empty table; other columns pass through, `judge` replaces those that bear the names of its
outputs, `keep_good` leaves them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallkit.session import broadcast_if_small, materialize

from .labelled import labelled_texts
from .textvec import SPACE, Texts, slices, trim

TAIL_BITS = 12
CLASSES = 8
#: Byte classes: lower, upper, digit, white space, stops, symbols, other ASCII, outside ASCII.
KIND = np.full(256, 6, np.int64)
KIND[[*range(97, 123)]], KIND[[*range(65, 91)]], KIND[[*range(48, 58)]] = 0, 1, 2
KIND[SPACE] = 3
KIND[[*b".,;:!?'\"()-"]], KIND[[*b"#*$%&|<>"]], KIND[128:] = 4, 5, 7
DIMS = CLASSES + 6 + 2**TAIL_BITS


def features(texts: Texts) -> np.ndarray:
    """One row per text: shares of byte classes, word shapes, and the square roots of the shares of word endings."""
    n = len(texts)
    out = np.zeros((n, DIMS), np.float32)
    s, e, first = texts.words()
    doc = np.repeat(np.arange(n), np.diff(texts.offsets))
    size, words = np.maximum(np.diff(texts.offsets), 1), np.diff(first)
    kinds = np.bincount(doc * CLASSES + KIND[texts.data], minlength=n * CLASSES).reshape(n, CLASSES)
    out[:, :CLASSES] = np.sqrt(kinds / size[:, None])
    owner = np.repeat(np.arange(n), words)
    per = np.maximum(words, 1)
    keys = texts.hash(s, e)
    distinct = np.bincount(np.unique(owner.astype(np.uint64) << np.uint64(40) | keys >> np.uint64(24)).astype(np.int64) >> 40, minlength=n)[:n] if len(s) else np.zeros(n)
    out[:, CLASSES] = np.bincount(owner, e - s, n) / per / 10
    out[:, CLASSES + 1] = distinct / per
    out[:, CLASSES + 2] = np.minimum(np.log1p(words) / 8, 2)
    out[:, CLASSES + 3] = np.minimum(size / per, 50) / 20
    out[:, CLASSES + 4] = words < 20
    out[:, CLASSES + 5] = words == 0
    ends = np.maximum(e - 3, s)
    tail = (texts.hash(ends, e) >> np.uint64(64 - TAIL_BITS)).astype(np.int64)
    index, inverse = np.unique(owner * 2**TAIL_BITS + tail, return_inverse=True)
    counts = np.bincount(inverse, minlength=len(index))
    rows = index >> TAIL_BITS
    out[rows, CLASSES + 6 + (index & (2**TAIL_BITS - 1))] = np.sqrt(counts / per[rows])
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, texts: Texts) -> np.ndarray:
        z = features(texts) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[str], labels: np.ndarray, epochs: int = 200, rate: float = 0.05, l2: float = 1e-4) -> Model:
    """Logistic regression by Adam on all rows at once."""
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(DIMS, np.float32), 30.0)
    x = np.empty((len(texts), DIMS), np.float32)
    for a in range(0, len(texts), 64):
        x[a : a + 64] = features(Texts(pa.array(texts[a : a + 64])))
    w, b = np.zeros(DIMS, np.float32), 0.0
    m, v = np.zeros(DIMS + 1), np.zeros(DIMS + 1)
    for t in range(1, epochs + 1):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        d = (p - labels).astype(np.float32) / len(labels)
        g = np.append(d @ x + l2 * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), b - step[-1]
    return Model(w, float(b))


def train(docs: DataFrame, labels: DataFrame, rows: int = 4000, most_bytes: int = 48 << 20, doc: str = "doc_id", text: str = "text") -> Model:
    """A model from at most `rows` labels and `most_bytes` of whole texts."""
    model = fit(*labelled_texts(docs, labels, "quality", rows, most_bytes, doc, text))
    trim()  # the driver goes on with other work
    return model


def evidence(df: DataFrame, model: Model, text: str = "text", out: str = "evidence") -> DataFrame:
    """df with the document model's probability of good quality."""

    @F.arrow_udf("double")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in parts:
            done = [model.scores(Texts(p.column(0))) for p in slices(pa.record_batch([column], ["text"]), "text")]
            yield pa.array(np.concatenate([np.zeros(0), *done]))

    return df.withColumn(out, run(F.col(text)))


def posteriors(rows: DataFrame, host: str, path: str, p: str = "evidence") -> DataFrame:
    """One row per (host, path), null-safe as _host and _path: path_quality, host_quality, global_quality. rows has no texts and is read once."""
    sums = [F.count(F.lit(1)).alias("_n"), F.sum(p).alias("_s")]
    paths = rows.groupBy(F.col(host).alias("_host"), F.col(path).alias("_path")).agg(*sums)
    paths = materialize(paths)
    hosts = paths.groupBy("_host").agg(F.sum("_n").alias("_hn"), F.sum("_s").alias("_hs"))
    # One row: the global mean, and how far hosts (paths) spread beyond what their sizes explain.
    total = hosts.agg(F.sum("_hs").alias("s"), F.sum("_hn").alias("n")).first()
    mean = min(max((total["s"] or 0.0) / max(total["n"] or 0, 1), 1e-3), 1 - 1e-3)

    def strength(groups: DataFrame, n: str, s: str, centre) -> float:
        x = groups.agg(F.sum(F.col(n) * (F.col(s) / F.col(n) - centre) ** 2).alias("q"), F.count(F.lit(1)).alias("k"), F.sum(n).alias("n")).first()
        spread = ((x["q"] or 0.0) - max((x["k"] or 0) - 1, 0) * mean * (1 - mean)) / max(x["n"] or 0, 1)
        return min(max(mean * (1 - mean) / max(spread, 1e-9), 1.0), 1e6)

    a = strength(hosts, "_hn", "_hs", F.lit(mean))
    hosts = hosts.withColumn("host_quality", (F.col("_hs") + a * mean) / (F.col("_hn") + a))
    both = paths.join(hosts.withColumnRenamed("_host", "_h"), F.col("_host").eqNullSafe(F.col("_h")))
    b = strength(both, "_n", "_s", F.col("host_quality"))
    return both.select("_host", "_path", ((F.col("_s") + b * F.col("host_quality")) / (F.col("_n") + b)).alias("path_quality"), "host_quality", F.lit(mean).alias("global_quality"))


OUTPUTS = ("evidence", "path_quality", "host_quality", "quality", "good")


def _judged(df: DataFrame, model: Model, carry: list[str], host: str, path: str, text: str, least: float) -> DataFrame:
    """Rows (_row: struct of the columns to carry, and OUTPUTS); the caller's names are inside the struct, so none can clash."""
    rows = df.select(F.struct(*carry).alias("_row"), F.col(host).alias("_h0"), F.col(path).alias("_p0"), F.col(text).alias("_text"))
    rows = materialize(evidence(rows, model, "_text").drop("_text"))
    sites = broadcast_if_small(materialize(posteriors(rows, "_h0", "_p0")))
    rows = rows.join(sites, F.col("_h0").eqNullSafe(F.col("_host")) & F.col("_p0").eqNullSafe(F.col("_path")))
    clamp = lambda c: F.least(F.greatest(F.col(c), F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = lambda c: F.ln(clamp(c) / (1 - clamp(c)))
    quality = 1 / (1 + F.exp(-(logit("evidence") + logit("path_quality") - logit("global_quality"))))
    return rows.withColumn("quality", quality).withColumn("good", F.col("quality") >= least).select("_row", *OUTPUTS)


def judge(df: DataFrame, model: Model, carry: list[str] | None = None, host: str = "source", path: str = "lang", text: str = "text", least: float = 0.4) -> DataFrame:
    """The columns to carry (default: all) with evidence, path_quality, host_quality, quality and good (quality >= least)."""
    rest = [c for c in carry or df.columns if c not in OUTPUTS]
    return _judged(df, model, rest, host, path, text, least).select(*[F.col("_row")[c].alias(c) for c in rest], *OUTPUTS)


def keep_good(df: DataFrame, model: Model, host: str = "source", path: str = "lang", text: str = "text", least: float = 0.4) -> DataFrame:
    """The good rows of df, with all of its columns."""
    return _judged(df, model, df.columns, host, path, text, least).where("good").select(*[F.col("_row")[c].alias(c) for c in df.columns])
