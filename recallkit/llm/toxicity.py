"""Operator 10: toxicity by multiple-instance learning.

A document is a bag of sentences; each sentence has a logistic score over its words and their beginnings, and the
document's score is the noisy-or of its sentences' (at least one is toxic). Only document labels are known, so the
sentence weights are trained through the noisy-or; afterwards the sentence scores locate the offending ones.

Features are the words (runs of letters, digits and bytes outside ASCII, lower-cased) and their first 4, 5 and 6 bytes, told apart by 64-bit hashes,
so inflected forms share weights. The noisy-or's log loss with an L1 penalty chooses among all features of at least `holders` toxic documents (`chosen`);
the loss with a small ridge then fits the weights of those by Newton steps (`fit`). labels, lang, source and doc_id are no features.

Labels come from rows whose crc32(doc_id as text) mod 4 is not 2. Training takes at most `rows` of them and `most_bytes` of whole texts
(`labelled_texts`), collected to the driver: that is the documented bound of the sample.

Defined cases: null or empty text has no sentence, scores 0 and has no spans; without any usable label of both kinds all scores
are 0; null labels and labels of unknown documents are left out; several labels of one document all count; repeated rows score
alike; a null doc_id is not held out; an empty table gives an empty table; other columns pass through, also those that bear the names of label columns, unless they
bear the name of the output.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_texts
from .textvec import ALNUM, Texts, mix, shingle_sets, slices, trim

#: Bits of the table that passes over most features which a model doesn't have.
BITS = 18
PREFIXES = (4, 5, 6)
#: Bytes that end a sentence.
STOPS = np.zeros(256, bool)
STOPS[[*b".!?\n"]] = True


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every (sentence, word part), their sentences, each sentence's first byte, and each text's first sentence."""
    s, e, first = texts.words(ALNUM)
    data = texts.data
    begins = np.zeros(len(data) + 1, bool)
    begins[texts.offsets] = True
    begins[1:] |= STOPS[data]
    begins = np.flatnonzero(begins)  # ends of texts start a sentence as well: of the next text
    sentence = np.searchsorted(begins, s, side="right") - 1
    parts = [texts.hash(s, e)]
    owners = [sentence]
    for k in PREFIXES:
        long = e - s > k
        parts.append(texts.hash(s[long], s[long] + k) ^ np.uint64(k << 40))
        owners.append(sentence[long])
    return np.concatenate(parts), np.concatenate(owners), begins, np.searchsorted(begins, texts.offsets)


def found(names: np.ndarray, table: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the hashes are among the sorted names, and their places there; table marks the names' top bits."""
    at = np.flatnonzero(table[hashes >> np.uint64(64 - BITS)])
    place = np.searchsorted(names, hashes[at])
    hit = place < len(names)
    hit[hit] = names[place[hit]] == hashes[at[hit]]
    return at[hit], place[hit]


def marked(names: np.ndarray) -> np.ndarray:
    table = np.zeros(2**BITS, bool)
    table[names >> np.uint64(64 - BITS)] = True
    return table


@dataclass
class Model:
    """The features' hashes in order, their weights, and the bias of every sentence."""

    names: np.ndarray
    weights: np.ndarray
    bias: float
    table: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.table = marked(self.names)

    def sentences(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each sentence's -log(1 - p), first byte, and each text's first sentence. A feature counts once in a sentence."""
        hashes, owner, begins, first = features(texts)
        at, place = found(self.names, self.table, hashes)
        once = np.unique(owner[at] * max(len(self.names), 1) + place)
        z = self.bias + np.bincount(once // max(len(self.names), 1), self.weights[once % max(len(self.names), 1)] if len(once) else None, len(begins))
        there = np.bincount(owner, minlength=len(begins)) > 0
        return np.where(there, np.logaddexp(0, z), 0.0), begins, first

    def scores(self, texts: Texts) -> np.ndarray:
        loss, _, first = self.sentences(texts)
        total = np.concatenate([[0.0], np.cumsum(loss)])
        return 1 - np.exp(-np.maximum(total[first[1:]] - total[first[:-1]], 0))


NONE = Model(np.zeros(0, np.uint64), np.zeros(0), -40.0)


def unlike(texts: list[str], step: int = 32) -> np.ndarray:
    """Which texts share neither of two MinHash values of their shingles with an earlier one: copies would count their words as evidence again."""
    keep, seen = np.ones(len(texts), bool), set()
    for a in range(0, len(texts), step):
        for i, s in enumerate(shingle_sets(Texts(pa.array(texts[a : a + step]), lower=True)), a):
            keys = {int(s.min()), -int(mix(s).min()) - 1} if len(s) else {0}
            keep[i] = not keys & seen
            seen |= keys
    return keep


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """All parts in one array; each is let go as soon as it is copied."""
    out, at = np.empty(sum(map(len, parts)), parts[0].dtype), 0
    parts.reverse()
    while parts:
        part = parts.pop()
        out[at : at + len(part)] = part
        at += len(part)
    return out


@dataclass
class Bags:
    """Sentences (each one's document) and the features in them (sentence, feature number), of documents labelled toxic or not."""

    doc: np.ndarray
    row: np.ndarray
    col: np.ndarray
    names: np.ndarray
    toxic: np.ndarray

    @classmethod
    def of(cls, texts: list[str], toxic: np.ndarray, holders: int, step: int = 32) -> Bags:
        """With the features that at least `holders` toxic documents have."""
        held = []
        for k in np.flatnonzero(toxic).tolist():
            held.append(np.unique(features(Texts(pa.array([texts[k]]), lower=True))[0]))
        names, n = np.unique(np.concatenate(held), return_counts=True)
        names = names[n >= holders]
        del held
        table, rows, cols, docs, base = marked(names), [], [], [], 0
        for a in range(0, len(texts), step):
            hashes, owner, _, first = features(Texts(pa.array(texts[a : a + step]), lower=True))
            present, row = np.unique(owner, return_inverse=True)  # sentences with any word
            at, place = found(names, table, hashes)
            pairs = np.unique(row[at] * max(len(names), 1) + place)
            rows.append((pairs // max(len(names), 1) + base).astype(np.int32))
            cols.append((pairs % max(len(names), 1)).astype(np.int32))
            docs.append(np.searchsorted(first, present, side="right") - 1 + a)
            base += len(present)
        return cls(np.concatenate(docs), _joined(rows), _joined(cols), names, toxic)

    def spans(self, most: int = 1 << 18) -> list[tuple[int, int, int, int]]:
        """Cuts of the pairs between sentences, about `most` pairs each: from and to which sentence and pair. What is worked out of pairs is then small."""
        at = np.searchsorted(self.row, np.arange(len(self.doc) + 1, dtype=self.row.dtype))  # pairs are in the order of sentences; of one type, or all are copied
        out, a = [], 0
        while a < len(self.doc):
            b = max(a + 1, int(np.searchsorted(at, at[a] + most, side="right")) - 1)
            out.append((a, b, int(at[a]), int(at[b])))
            a = b
        return out

    def only(self, keep: np.ndarray) -> Bags:
        on = keep[self.col]
        return Bags(self.doc, self.row[on], (np.cumsum(keep) - 1).astype(np.int32)[self.col[on]], self.names[keep], self.toxic)


def slope(toxic: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Derivative of each document's loss by the sum of its sentences' -log(1 - p): 1 for clean ones, -1 / (e^total - 1) for toxic ones."""
    return np.where(toxic, -1 / np.expm1(np.minimum(total, 50)), 1.0)


def chosen(bags: Bags, l1: float, epochs: int = 100, rate: float = 0.1) -> tuple[Bags, np.ndarray, float]:
    """Adam on the noisy-or's mean log loss with an L1 penalty (its proximal step); features at zero leave at epochs 40, 80 and the end."""
    n, w, b = len(bags.toxic), np.zeros(len(bags.names)), -6.0
    m, v, spans = np.zeros(len(w) + 1), np.zeros(len(w) + 1), bags.spans()
    z = np.empty(len(bags.doc))
    for t in range(1, epochs + 1):
        for a, e, i, j in spans:
            z[a:e] = b + np.bincount(bags.row[i:j] - a, w[bags.col[i:j]], e - a)
        total = np.maximum(np.bincount(bags.doc, np.logaddexp(0, z), n), 1e-9)
        g_row = slope(bags.toxic, total)[bags.doc] / n / (1 + np.exp(-z))
        g_col = np.zeros(len(w))
        for _, _, i, j in spans:
            g_col += np.bincount(bags.col[i:j], g_row[bags.row[i:j]], len(w))
        g = np.clip(np.append(g_col, g_row.sum()), -1, 1)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        pace = rate / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        step = pace * m / (1 - 0.9**t)
        w, b = w - step[:-1], b - step[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - pace[:-1] * l1, 0)
        if t in (40, 80, epochs):
            keep = w != 0
            bags, w, m, v = bags.only(keep), w[keep], m[np.append(keep, True)], v[np.append(keep, True)]
            spans = bags.spans()
    return bags, w, b


def blocks(x: np.ndarray, rows: int = 1 << 14) -> Iterator[tuple[slice, np.ndarray]]:
    """Some rows of x at a time, as floating-point numbers."""
    for a in range(0, len(x), rows):
        yield slice(a, a + rows), x[a : a + rows].astype(np.float64)


def loss(theta: np.ndarray, x: np.ndarray, doc: np.ndarray, bare: np.ndarray, toxic: np.ndarray, ridge: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The noisy-or's log loss with the ridge, each sentence's logit, and each document's sum of -log(1 - p). x: sentences with features (the last column is 1); bare: sentences without any, per document."""
    z = np.concatenate([np.zeros(0), *[part @ theta for _, part in blocks(x)]])
    total = np.maximum(np.bincount(doc, np.logaddexp(0, z), len(toxic)) + bare * np.logaddexp(0, theta[-1]), 1e-9)
    return float(np.where(toxic, -np.log(-np.expm1(-total)), total).sum() + (ridge * theta**2).sum() / 2), z, total


def gradient(theta: np.ndarray, x: np.ndarray, doc: np.ndarray, bare: np.ndarray, toxic: np.ndarray, ridge: np.ndarray, z: np.ndarray, total: np.ndarray) -> np.ndarray:
    d = slope(toxic, total)
    by_row = d[doc] / (1 + np.exp(-z))
    g = sum((part.T @ by_row[at] for at, part in blocks(x)), ridge * theta)
    g[-1] += (d * bare).sum() / (1 + np.exp(-theta[-1]))
    return g


def fit(texts: list[str], labels: np.ndarray, l1: float = 3e-4, ridge: float = 0.1, holders: int = 3, steps: int = 60) -> Model:
    """The features that the penalised loss chooses, with the weights that the loss with a ridge gives them."""
    keep = unlike(texts)
    trim()  # small pieces that it left, here and below: driver memory is scarce
    texts, toxic = [t for t, k in zip(texts, keep.tolist(), strict=True) if k], labels[keep] > 0
    if not toxic.any() or toxic.all():
        return NONE
    bags = Bags.of(texts, toxic, holders)
    trim()
    bags, w, b = chosen(bags, l1)
    some, at = np.unique(bags.row, return_inverse=True)
    x = np.zeros((len(some), len(w) + 1), np.int8)
    x[:, -1], x[at, bags.col] = 1, 1
    doc = bags.doc[some]
    bare = np.bincount(bags.doc, minlength=len(toxic)) - np.bincount(doc, minlength=len(toxic))
    theta, penalty = np.append(w, b), np.append(np.full(len(w), ridge), 0.0)
    data = (x, doc, bare, toxic, penalty)
    now, z, total = loss(theta, *data)
    for _ in range(steps):
        g = gradient(theta, *data, z, total)
        p, rest = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-theta[-1]))
        curve = p * (1 - p)
        curved = sum(((part * curve[at, None]).T @ part for at, part in blocks(x)), np.diag(penalty + 1e-6))  # of the logistic losses of sentences
        curved[-1, -1] += bare.sum() * rest * (1 - rest)
        way, pace = np.linalg.solve(curved, g), 1.0
        after = loss(theta - way, *data)
        while after[0] >= now and pace > 1e-4:
            pace /= 2
            after = loss(theta - pace * way, *data)
        if now - after[0] < 1e-7 * now:
            break
        theta, (now, z, total) = theta - pace * way, after
    return Model(bags.names, theta[:-1], float(theta[-1]))


def held_out(doc: Column) -> Column:
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = 8000, most_bytes: int = 48 << 20, doc: str = "doc_id", text: str = "text") -> Model:
    """A model from at most `rows` labels and `most_bytes` of whole texts, none of them held out."""
    model = fit(*labelled_texts(docs, labels.where(~held_out(F.col(doc))), "toxic", rows, most_bytes, doc, text))
    trim()  # the driver goes on with other work
    return model


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """df with each text's probability of being toxic."""

    @F.arrow_udf("double")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in parts:
            done = [model.scores(Texts(p.column(0), lower=True)) for p in slices(pa.record_batch([column], ["text"]), "text")]
            yield pa.array(np.concatenate([np.zeros(0), *done]))

    return df.withColumn(out, run(F.col(text)))


def spans(df: DataFrame, model: Model, least: float = 0.3, text: str = "text", score: str = "score", out: str = "offending") -> DataFrame:
    """df with each text's score and the sentences that score at least `least`: an array of start and length in bytes of the lower-cased text, the sentence there, and score, worst first."""
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("sentence", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<score:double,spans:array<struct<start:long,length:long,sentence:string,score:double>>>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in parts:
            sums, rows = [np.zeros(0)], []
            for piece in slices(pa.record_batch([column], ["text"]), "text"):
                texts = Texts(piece.column(0), lower=True)
                worth, begins, first = model.sentences(texts)
                total = np.concatenate([[0.0], np.cumsum(worth)])
                sums.append(1 - np.exp(-np.maximum(total[first[1:]] - total[first[:-1]], 0)))
                p, ends = 1 - np.exp(-worth), np.append(begins[1:], len(texts.data))
                hits = np.flatnonzero(p >= least)
                of = np.searchsorted(first, hits, side="right") - 1
                own: list[list[dict]] = [[] for _ in range(len(texts))]
                for k, i in sorted(zip(of.tolist(), hits.tolist(), strict=True), key=lambda x: (x[0], -p[x[1]], x[1])):
                    own[k].append({"start": int(begins[i] - texts.offsets[k]), "length": int(ends[i] - begins[i]), "sentence": texts.data[begins[i] : ends[i]].tobytes().decode().strip(), "score": float(p[i])})
                rows += own
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(sums)), pa.array(rows, pa.list_(kind))], ["score", "spans"])

    names = [c for c in df.columns if c not in (score, out)]
    return df.select(*names, run(F.col(text)).alias("_tx")).select(*names, F.col("_tx.score").alias(score), F.col("_tx.spans").alias(out))
