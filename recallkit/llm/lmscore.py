"""Operator 7: masked pseudo-likelihood by a bidirectional window network.

Every word is predicted from the two words on each side of it; a document's score is the sum of the conditional
log-probabilities of all its words. The network's tokens are the most common words of the corpus, counted over all
documents (up to `most`, thousands), and classes of shape (length, kinds of characters) for all other words; a text's ends are a token of their own.

The network adds one embedding per side and distance, takes tanh, and gives a softmax in two levels: over groups of MEMBERS tokens, then over the
tokens of the group, so a prediction costs two short rows instead of the whole vocabulary and still sums to 1. It is trained in numpy
on all windows of all documents, each once: in each round every task goes through its share in minibatches from the same parameters, and the tasks'
parameters are averaged, weighted by their windows (block by block, so what is collected is one model). Texts are scored by the network itself.

Within its class each other word of the corpus has a probability of its own (`word_sums`): how often it stands between these two neighbours, of all words
of its class that stand there, counted over the whole corpus and smoothed by PRIOR times an equal share of the class. A word's own
occurrence is left out of its counts. These counts grow with the corpus; they meet by hash of (neighbours, class) in a shuffle, in parts whose number
follows the corpus, and only sums per text leave it. Texts are turned into tokens once (`encoded`) and that table is read by all steps.

Defined cases: null or empty text has no tokens, log-likelihood 0 and null mean and perplexity; ties among common
words go to the smaller hash; repeated rows count and score alike; an empty corpus gives an untrained model; an empty table gives
an empty table; other columns pass through unless they bear the names of the outputs. The averaged parameters depend on how the rows are dealt over tasks,
so scores are the same for the same files and settings, not for any.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallkit.session import discard, materialize

from .textvec import SPACE, Texts, mix, slices

SHAPES = 64
END = 0
#: Where a window's neighbours stand.
SIDES = (-2, -1, 1, 2)
#: Tokens in a group of the softmax.
MEMBERS = 64
#: Logits within this of 0 need no shift before exp, in 32 bits.
SAFE = 80
#: Pseudo-counts of an equal share of the class.
PRIOR = 1.0
#: Occurrences that one part of the neighbours holds, about.
PART = 4_000_000
_KIND = np.zeros(256, np.int64)  # 0: other marks
_KIND[[*range(97, 123)]] = 1
_KIND[[*range(65, 91)]] = 2
_KIND[[*range(48, 58)]] = 3
_KIND[128:] = 4
#: Two kinds' counters each in one number.
_MARKS_UPPER = ((_KIND == 0) + ((_KIND == 2).astype(np.uint64) << np.uint64(32))).astype(np.uint64)
_DIGITS_HIGH = ((_KIND == 3) + ((_KIND == 4).astype(np.uint64) << np.uint64(32))).astype(np.uint64)


def shapes(texts: Texts, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A class from 0 to 63 of each word: eight of length, eight of its characters."""
    n = {}
    for codes, kinds in ((_MARKS_UPPER, (0, 2)), (_DIGITS_HIGH, (3, 4))):
        sums = np.zeros(len(texts.data) + 1, np.uint64)
        np.cumsum(codes[texts.data], out=sums[1:])
        both = sums[e] - sums[s]
        n[kinds[0]], n[kinds[1]] = both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)
    size = e - s
    length = np.searchsorted([2, 3, 4, 6, 8, 11, 15], size, side="right")
    upper_first = _KIND[texts.data[s]] == 2
    form = np.select(
        [n[0] > 1, n[3] > 0, n[2] > 1, (n[0] == 1) & (n[4] > 0), n[0] == 1, upper_first, n[4] > 0],
        [1, 2, 3, 4, 5, 6, 7],
        0,
    )
    return length * 8 + form


#: Words are told apart by the upper 58 bits of their hashes; the others hold a shape where both stand together.
WORD = ~np.uint64(SHAPES - 1)


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """Rows (word, shape, n): all words, by hash, in all their shapes, and how often they occur."""
    none = Tokens(np.zeros(0, np.int64), np.zeros(0, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                t, _, h = none.read(*_both(part.column("text")))
                code, n = np.unique(h & WORD | (t - 1).astype(np.uint64), return_counts=True)
                yield pa.record_batch([code.view(np.int64), n.astype(np.int64)], ["code", "n"])

    counts = df.select(F.col(text).alias("text")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return counts.select((F.col("code").bitwiseAND(F.lit(-SHAPES))).alias("word"), F.col("code").bitwiseAND(F.lit(SHAPES - 1)).cast("int").alias("shape"), "n")


@dataclass
class Tokens:
    """The common words' hashes, sorted, and their token numbers."""

    words: np.ndarray
    numbers: np.ndarray

    @property
    def size(self) -> int:
        return 1 + SHAPES + len(self.words)

    def of(self, texts: Texts, lower: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers of all words, and each text's first; words are found in the lower-cased text, shapes in the text itself."""
        return self.read(texts, lower)[:2]

    def read(self, texts: Texts, lower: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As `of`, and the words' hashes."""
        s, e, first = texts.words()
        alike = len(texts.data) == len(lower.data) and bool((SPACE[texts.data] == SPACE[lower.data]).all())
        ls, le = (s, e) if alike and (texts.offsets == lower.offsets).all() else lower.words()[:2]
        out, h = 1 + shapes(texts, s, e), lower.hash(ls, le)
        if len(self.words) and len(s):
            own = (h & WORD).view(np.int64)
            k = np.minimum(np.searchsorted(self.words, own), len(self.words) - 1)
            hit = self.words[k] == own
            out[hit] = self.numbers[k[hit]]
        return out, first, h


def _both(column: pa.Array) -> tuple[Texts, Texts]:
    return Texts(column), Texts(column, lower=True)


def windows(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each token's neighbours at SIDES, one row per token; END beyond a text's ends."""
    n = len(tokens)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    wide = np.full(n + 2 * len(first) + 2, END, tokens.dtype)
    at = np.arange(n) + 2 * text + 2  # END stands twice around each text
    wide[at] = tokens
    return np.stack([wide[at + k] for k in SIDES], 1) if n else np.zeros((0, len(SIDES)), tokens.dtype)


class Net:
    """The network's parameters; the last group are the shapes, and groups of words are filled by rank."""

    NAMES = ("embed", "base", "group", "group_bias", "member", "member_bias")

    def __init__(self, n_words: int, width: int = 24, counts: np.ndarray | None = None):
        """counts: how often each token occurs, as the start of the biases."""
        self.n_words, self.groups, size = n_words, -(-n_words // MEMBERS) + 1, 1 + SHAPES + n_words
        rng = np.random.Generator(np.random.PCG64(11))
        real = np.zeros(self.groups * MEMBERS, bool)
        real[:n_words] = real[-MEMBERS:] = True
        n = np.zeros(self.groups * MEMBERS)
        if counts is not None:
            n[:n_words], n[-MEMBERS:] = counts[1 + SHAPES :], counts[1 : 1 + SHAPES]
        n = (np.where(real, n + 0.5, 1e-9)).reshape(self.groups, MEMBERS)
        self.embed = rng.normal(0, 0.1, (len(SIDES), size, width)).astype(np.float32)
        self.base = np.zeros(width, np.float32)
        self.group = rng.normal(0, 0.1, (width, self.groups)).astype(np.float32)
        self.group_bias = np.log(n.sum(1) / n.sum()).astype(np.float32)
        self.member = rng.normal(0, 0.1, (self.groups, width, MEMBERS)).astype(np.float32)
        self.member_bias = np.log(n / n.sum(1, keepdims=True)).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).reshape(-1) for k in self.NAMES])

    def load(self, values: np.ndarray) -> Net:
        at = 0
        for k in self.NAMES:
            old = getattr(self, k)
            setattr(self, k, values[at : at + old.size].reshape(old.shape).astype(old.dtype))
            at += old.size
        return self

    def places(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's group and its place there."""
        word = tokens.astype(np.int64) - 1 - SHAPES
        return np.where(word >= 0, word // MEMBERS, self.groups - 1), np.where(word >= 0, word % MEMBERS, word + SHAPES)

    def hidden(self, near: np.ndarray) -> np.ndarray:
        """The hidden layer, and a column of ones for the biases."""
        x = self.base + self.embed[0].take(near[:, 0], 0)
        for k in range(1, len(SIDES)):
            x += self.embed[k].take(near[:, k], 0)
        h = np.ones((len(x), x.shape[1] + 1), x.dtype)
        np.tanh(x, out=h[:, :-1])
        return h

    @staticmethod
    def soft(z: np.ndarray, weights: np.ndarray, whole: bool) -> np.ndarray:
        """The logarithms of the sums of exp(z); z becomes the probabilities if whole, else it is used up. weights: of z's inputs, which lie between -1 and 1."""
        top = 0.0
        if not np.abs(weights).sum(-2).max(initial=0) < SAFE:  # else no sum of exp can overflow or vanish
            top = z.max(1)
            z -= top[:, None]
        total = np.exp(z, out=z) @ np.ones(z.shape[1], z.dtype)
        if whole:
            z /= total[:, None]
        return np.log(total) + top

    def run(self, near: np.ndarray, tokens: np.ndarray, gradients: bool = False) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """The tokens' log-probabilities, and the gradients of minus their sum (of embeddings: by window, as "hidden")."""
        group, place = self.places(tokens)
        order = np.argsort(group.astype(np.uint16), kind="stable")  # 16 bits: sorted by digits
        near, group, place = near.take(order, 0), group[order], place[order]
        cuts = np.searchsorted(group, np.arange(self.groups + 1)).tolist()
        spans = [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
        h, rows = self.hidden(near), np.arange(len(order))
        outer, inner = np.concatenate([self.group, self.group_bias[None]]), np.concatenate([self.member, self.member_bias[:, None]], 1)
        p, q = h @ outer, np.empty((len(order), MEMBERS), h.dtype)  # of groups, and inside each token's group
        for k, a, b in spans:
            np.matmul(h[a:b], inner[k], out=q[a:b])
        out = p[rows, group] + q[rows, place]
        out -= self.soft(p, outer, gradients) + self.soft(q, inner, gradients)
        g: dict[str, np.ndarray] = {}
        if gradients:
            p[rows, group] -= 1
            q[rows, place] -= 1
            by_group, by_member, within = h.T @ p, np.zeros_like(inner), np.empty((len(order), h.shape[1] - 1), h.dtype)
            for k, a, b in spans:
                np.matmul(h[a:b].T, q[a:b], out=by_member[k])
                np.matmul(q[a:b], self.member[k].T, out=within[a:b])
            back = p @ self.group.T
            back += within
            back *= 1 - h[:, :-1] ** 2
            g = {"group": by_group[:-1], "group_bias": by_group[-1], "member": by_member[:, :-1], "member_bias": by_member[:, -1], "hidden": back, "near": near, "base": back.sum(0)}
        logs = np.empty(len(order), np.float32)
        logs[order] = out
        return logs, g


class Training:
    """Minibatches by Adagrad."""

    def __init__(self, net: Net, rate: float = 0.05):
        self.net, self.rate, self.n = net, rate, 0
        self.seen = {k: np.full_like(getattr(net, k), 1e-2) for k in Net.NAMES if k != "embed"}
        self.rows = np.full(net.embed.shape[:2], 1e-2, np.float32)  # one pace per embedding

    def step(self, near: np.ndarray, tokens: np.ndarray) -> None:
        net, (_, g) = self.net, self.net.run(near, tokens, True)
        size = np.float32(1 / max(len(tokens), 1))
        for k, seen in self.seen.items():
            d = g[k] * size
            seen += d * d
            getattr(net, k)[...] -= self.rate * d / np.sqrt(seen)
        for side in range(len(SIDES)):
            key = g["near"][:, side].astype(np.uint16)
            order = np.argsort(key, kind="stable")
            key = key[order]
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else order
            names = key[at]
            d = np.add.reduceat(g["hidden"].take(order, 0), at, axis=0) * size
            self.rows[side][names] += np.einsum("ij,ij->i", d, d) / np.float32(d.shape[1])
            net.embed[side][names] -= self.rate * d / np.sqrt(self.rows[side][names])[:, None]
        self.n += len(tokens)


def encoded(df: DataFrame, tokens: Tokens, row: str = "_row", text: str = "text") -> DataFrame:
    """Rows (row, tokens, places, keys, words): a text's token numbers (16 bits), and for each word outside the network's where it stands, the
    hash of its neighbours and its shape (64 bits), and the top 10 bits of its hash with its shape (16 bits)."""
    names = ["row", "tokens", "keys", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                t, first, h = tokens.read(*_both(part.column("text")))
                text = np.repeat(np.arange(len(first) - 1), np.diff(first))
                wide = np.zeros(len(t) + 2 * len(first) + 2, np.uint64)
                at = np.arange(len(t)) + 2 * text + 2
                wide[at] = h
                k = np.flatnonzero(t <= SHAPES)
                shape = (t[k] - 1).astype(np.uint64)
                key = mix(mix(wide[at[k] - 1] * np.uint64(3) + shape) ^ wide[at[k] + 1])
                word = ((mix(h[k]) >> np.uint64(54)).astype(np.uint16) << np.uint16(6)) | shape.astype(np.uint16)
                mine, t = np.searchsorted(k, first), t.astype(np.uint16)
                cut = lambda x, ends: pa.array([x[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
                yield pa.record_batch([part.column("row"), cut(t, first), cut(key, mine), cut(word, mine)], names)

    return df.select(F.col(row).alias("row"), F.col(text).alias("text")).mapInArrow(run, "row long, tokens binary, keys binary, words binary")


def _texts(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all texts, one after the other, and where each begins."""
    sizes = np.array([len(x.as_py()) for x in column], np.int64) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(x.as_py() for x in column), kind), np.concatenate([[0], np.cumsum(sizes)])


def train(texts: DataFrame, net: Net, rounds: int = 2, every: int = 1, batch: int = 4096, blocks: int = 16) -> Net:
    """The network after `rounds` shares of all texts (`encoded`), each gone through by all tasks from the same parameters, which are averaged.

    All windows of every text are learned from, so what is gathered grows with the corpus; every: only those whose place is a multiple of it (from a start that differs between texts).
    """
    spark = texts.sparkSession.sparkContext
    n_words, size = net.n_words, len(net.flat())
    step = -(-size // blocks)

    for k in range(rounds):
        start = spark.broadcast(net.flat())

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            work = Training(Net(n_words).load(start.value))
            rng = np.random.Generator(np.random.PCG64(5))
            for rows in batches:
                t, first = _texts(rows.column("tokens"), np.uint16)
                place = np.arange(len(t)) - np.repeat(first[:-1] - np.arange(len(first) - 1), np.diff(first))
                order = rng.permutation(np.flatnonzero(place % every == 0))
                near, t = windows(t, first).take(order, 0), t[order]
                for a in range(0, len(order), batch):
                    work.step(near[a : a + batch], t[a : a + batch])
            if work.n:
                values = work.net.flat()
                parts = [values[a : a + step].tobytes() for a in range(0, size, step)]
                yield pa.record_batch([pa.array(range(len(parts)), pa.int32()), pa.array([work.n] * len(parts), pa.int64()), pa.array(parts, pa.binary())], ["block", "n", "values"])

        def mean(table: pa.Table) -> pa.Table:
            total, n = 0.0, 0
            for r in table.sort_by([("n", "ascending"), ("values", "ascending")]).to_pylist():
                total, n = total + r["n"] * np.frombuffer(r["values"], np.float32).astype(np.float64), n + r["n"]
            return pa.table([pa.array([table.column("block")[0].as_py()], pa.int32()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], ["block", "values"])

        share = texts.where(F.pmod(F.xxhash64("row"), F.lit(rounds)) == k).select("tokens")
        found = share.mapInArrow(run, "block int, n long, values binary").groupBy("block").applyInArrow(mean, "block int, values binary")
        parts = sorted((r["block"], bytes(r["values"])) for r in found.collect())  # one model
        if parts:
            net.load(np.frombuffer(b"".join(v for _, v in parts), np.float32))
        start.unpersist()
    return net


def net_sums(texts: DataFrame, net: Net, batch: int = 32768) -> DataFrame:
    """Rows (row, n, l): the number of tokens and the sum of the network's log-probabilities of each text."""
    shared, n_words = texts.sparkSession.sparkContext.broadcast(net.flat()), net.n_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Net(n_words).load(shared.value)
        for rows in batches:
            t, first = _texts(rows.column("tokens"), np.uint16)
            near = windows(t, first)
            logs = [model.run(near[a : a + batch], t[a : a + batch])[0].astype(np.float64) for a in range(0, len(t), batch)]
            total = np.concatenate([[0.0], np.cumsum(np.concatenate(logs))]) if logs else np.zeros(1)
            yield pa.record_batch([rows.column("row"), pa.array(np.diff(first)), pa.array(total[first[1:]] - total[first[:-1]])], ["row", "n", "l"])

    return texts.select("row", "tokens").mapInArrow(run, "row long, n long, l double")


def word_sums(texts: DataFrame, n_rest: int, sizes: np.ndarray) -> DataFrame:
    """Rows (row, l): sums of log-probabilities of words within their classes; a row may have several. sizes: the different words of each shape."""
    parts = 1 << max(5, (n_rest // PART).bit_length())
    bits = np.uint64(64 - (parts.bit_length() - 1))
    names = ["part", "keys", "words", "rows", "texts"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, first = _texts(batch.column("keys"), np.uint64)
            word = _texts(batch.column("words"), np.uint16)[0]
            rows = batch.column("row").to_numpy()
            text = np.repeat(np.arange(len(rows)), np.diff(first)).astype(np.uint16 if len(rows) <= 1 << 16 else np.uint32)
            part = (key >> bits).astype(np.int64)
            order = np.argsort(part, kind="stable")
            held, cuts = np.unique(part[order], return_index=True)
            low = (key >> (bits - np.uint64(32))).astype(np.uint32)  # the next 32 bits tell neighbours apart inside a part
            out = [(p, low[o].tobytes(), word[o].tobytes(), rows.tobytes(), text[o].tobytes()) for p, o in zip(held.tolist(), np.split(order, cuts[1:]), strict=True)]
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), *[pa.binary()] * 4], strict=True)], names)

    def judge(table: pa.Table) -> pa.Table:
        key, word, rows = ([np.frombuffer(x.as_py(), kind) for x in table.column(c)] for c, kind in (("keys", np.uint32), ("words", np.uint16), ("rows", np.int64)))
        texts = [np.frombuffer(x.as_py(), f"u{len(x.as_py()) // len(k)}") for x, k in zip(table.column("texts"), key, strict=True)]
        starts = np.cumsum([0, *map(len, rows)])
        text = np.concatenate([t + s for t, s in zip(texts, starts[:-1], strict=True)])
        code = np.concatenate(key).astype(np.uint64) << np.uint64(16) | np.concatenate(word)
        order = np.argsort(code)
        code = code[order]
        times = _run_lengths(code)
        there = _run_lengths(code >> np.uint64(16))
        p = (times - 1 + PRIOR / sizes[(code & np.uint64(63)).astype(np.int64)]) / (there - 1 + PRIOR)
        l, used = np.bincount(text[order], np.log(p), int(starts[-1])), np.bincount(text, minlength=int(starts[-1])) > 0
        return pa.table([np.concatenate(rows)[used], l[used]], ["row", "l"])

    dealt = texts.select("row", "keys", "words").mapInArrow(deal, "part int, keys binary, words binary, rows binary, texts binary")
    return dealt.groupBy("part").applyInArrow(judge, "row long, l double")


def _run_lengths(x: np.ndarray) -> np.ndarray:
    """How many equal ones each value of a sorted array has, itself included."""
    start = np.concatenate([[True], x[1:] != x[:-1]])
    n = np.diff([*np.flatnonzero(start).tolist(), len(x)])
    return np.repeat(n, n)


def vocabulary(words: DataFrame, most: int) -> tuple[Tokens, np.ndarray, np.ndarray]:
    """Of word_counts, materialized: the words that occur most, up to `most` of them, twice at least; how often each token occurs; and how many different words each shape has besides (one at least)."""
    top = words.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "word").limit(most).collect()  # bounded by the parameter
    own = np.array([r["word"] for r in top], np.int64)
    order = np.argsort(own)
    tokens = Tokens(own[order], 1 + SHAPES + order)
    counts, sizes = np.zeros(tokens.size, np.int64), np.ones(SHAPES, np.int64)
    counts[1 + SHAPES :] = [r["n"] for r in top]
    known = words.sparkSession.createDataFrame([(int(w),) for w in own], "word long")
    rest = words.join(F.broadcast(known), "word", "left_anti").groupBy("shape").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n"))
    for r in rest.collect():  # a row per shape
        sizes[r["shape"]], counts[1 + r["shape"]] = r["words"], r["n"]
    return tokens, counts, sizes


def pseudo_likelihood(df: DataFrame, text: str = "text", most: int = 63 * MEMBERS) -> DataFrame:
    """df with n_tokens, log_likelihood (sum of conditional log-probabilities), mean_log_probability and perplexity."""
    rest = [c for c in df.columns if c not in ("n_tokens", "log_likelihood", "mean_log_probability", "perplexity")]
    rows = df.select(*rest, F.xxhash64(F.coalesce(text, F.lit(""))).alias("_row"))  # equal texts score alike, so their sums are divided by their number
    found = materialize(word_counts(rows, text))
    tokens, counts, sizes = vocabulary(found, most)
    discard(found)
    texts = materialize(encoded(rows, tokens, text=text))
    net = train(texts, Net(len(tokens.words), counts=counts))
    own = net_sums(texts, net).select("row", F.lit(1).cast("long").alias("_times"), F.col("n").alias("_n"), F.col("l").alias("_l"))
    none = F.lit(0).cast("long")
    words = word_sums(texts, int(counts[1 : 1 + SHAPES].sum()), sizes).select("row", none.alias("_times"), none.alias("_n"), F.col("l").alias("_l"))
    sums = materialize(own.unionByName(words).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("_times", "_n", "_l")]))
    discard(texts)
    sums = sums.select(F.col("row").alias("_row"), (F.col("_n") / F.col("_times")).cast("long").alias("_n"), (F.col("_l") / F.col("_times")).alias("_l"))
    mean = F.when(F.col("_n") > 0, F.col("_l") / F.col("_n"))
    return rows.join(sums, "_row").select(*rest, F.col("_n").alias("n_tokens"), F.col("_l").alias("log_likelihood"), mean.alias("mean_log_probability"), F.exp(-mean).alias("perplexity"))
