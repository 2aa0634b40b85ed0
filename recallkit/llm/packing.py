"""Operator 4: vector best-fit packing of token pieces into sequences.

A sequence has three capacities: tokens, documents (pieces), and attention cost (the sum of squared
piece lengths, as attention stays inside a document). A piece goes to the open sequence that has room
for it in all three and scores best: by the weighted dot product of the piece's demands with the
residual capacities, or by the weighted norm of what would stay free. Tokens are given; the other two capacities are chosen from
the data, as small as they can be without another sequence (`tightest`).

All demands follow from a piece's length, so pieces of one length are alike: the plan is made over counts of lengths (at most
`tokens` rows, whatever the input's size), longest first, and each piece then finds its place from
its rank among the pieces of its length. Ranks come from hashed groups, so a length that a third of
all pieces share is still counted and ranked by many tasks.

Defined cases: null or empty text -> the end id alone, one piece; longer documents are cut into
pieces of `tokens` ids, the last may be shorter; equal lengths are told apart by (doc_id, piece)
and repeated rows each get a place of their own; an empty table gives an empty table; other columns of the
pieces pass through unless they bear the names of the outputs.
"""

from __future__ import annotations

import os
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textvec import Texts, slices, trim

#: Fixed value: how the tokenizer file cuts lower-case words, letters limited to those of LETTERS.
PLAIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
#: Characters that normalisation only lower-cases.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: The lower-case letters among them, and the characters that stand for them at a word's end.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
FINALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(map(chr, [*range(0xC0, 0xDF), 0xF7]))
#: By last byte: what stands for it at a word's end.
FINAL_BYTE = np.arange(256, dtype=np.uint8)
FINAL_BYTE[[c.encode()[-1] for c in LETTERS]] = [c.encode()[-1] for c in FINALS]
#: Distinct chunks whose ids a worker remembers (about 40 bytes each): the first ones, among them the common ones.
REMEMBERED = 250_000


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, .. of every run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class WordTokenizer:
    """Ids of a `tokenizers` file whose words never cross white space.

    Texts are cut at ASCII white space. Each distinct chunk (by 64-bit hash and length) is encoded once and
    remembered. Words of LETTERS go through the file's merges in the tiktoken library, many in one call; marks
    and digits, and chunks with any other character or a special token's string, through the file's own pipeline. As in the library, the string of a
    special token in a text is that token, unless `plain_specials`.
    """

    def __init__(self, path: str, plain_specials: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = plain_specials
        self.specials = [] if plain_specials else [t.content.encode() for t in self.full.get_added_tokens_decoder().values()]
        self.engine, self.to_id = _merger(self.full)
        self.final = dict(zip(LETTERS, FINALS, strict=True))
        self.marks: dict[str, bytes] = {}
        alone = [np.frombuffer(self.slow(chr(c)), "<u4") for c in range(0x21, 0x7F)]
        self.alone, self.alone_n = np.concatenate(alone), np.zeros(256, np.int64)
        self.alone_n[0x21:0x7F] = [len(x) for x in alone]
        self.alone_at = np.cumsum(self.alone_n) - self.alone_n
        self.keys, self.at, self.n, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def slow(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def mark(self, text: str) -> bytes:
        if text not in self.marks:
            if len(self.marks) > 10_000:
                self.marks.clear()
            self.marks[text] = self.slow(text)
        return self.marks[text]

    def single(self, chunk: bytes) -> bytes:
        """The ids of a chunk by itself."""
        text = chunk.decode()
        if not PLAIN.fullmatch(text) or any(x in chunk for x in self.specials):
            return self.slow(text)
        parts = []
        for w in PLAIN_WORD.findall(text.lower()):
            parts.append(self.to_id[self.engine(w[:-1] + self.final[w[-1]])].tobytes() if w[0] in self.final else self.mark(w))
        return b"".join(parts)

    def learn(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the chunks data[s:e], as one array, and where each chunk's begin in it and how many they are.

        Chunks of plain characters without an apostrophe are cut and encoded together: a word is a run of letters, one digit, or a run of marks.
        """
        lengths = e - s
        begins = np.cumsum(lengths) - lengths
        blob = data[_runs(s, lengths)]
        lead = blob == 0xC3
        second = np.concatenate([[False], lead[:-1]])
        odd = (blob < 0x21) | (blob == 0x7F) | (blob == 0x27) | ((blob >= 0x80) & ~lead & ~second) | (second & ((blob == 0x97) | (blob == 0xB7)))
        alone = np.add.reduceat(odd, begins) > 0
        if any(x in blob.tobytes() for x in self.specials):
            alone |= [any(x in blob[a : a + n].tobytes() for x in self.specials) for a, n in zip(begins.tolist(), lengths.tolist(), strict=True)]
        singly = [self.single(blob[a : a + n].tobytes()) for a, n in zip(begins[alone].tolist(), lengths[alone].tolist(), strict=True)]
        n, at = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
        n[alone] = [len(x) // 4 for x in singly]
        own = np.frombuffer(b"".join(singly), "<u4")
        at[alone] = np.cumsum(n[alone]) - n[alone]
        together = ~alone
        if not together.any():
            return own, at, n
        inside = np.repeat(together, lengths)
        blob, lead, second, size = blob[inside], lead[inside], second[inside], lengths[together]
        upper = (blob >= 0x41) & (blob <= 0x5A) | second & (blob <= 0x9E)
        blob = blob + np.where(upper, np.uint8(0x20), np.uint8(0))
        kind = np.where((blob >= 0x61) & (blob <= 0x7A) | lead | second, 0, np.where((blob >= 0x30) & (blob <= 0x39), 1, 2)).astype(np.int8)
        start = np.concatenate([[True], kind[1:] != kind[:-1]]) | (kind == 1)
        first = np.cumsum(size) - size
        start[first] = True
        a = np.flatnonzero(start)
        z = np.append(a[1:], len(blob))
        word = kind[a] == 0
        blob[z[word] - 1] = FINAL_BYTE[blob[z[word] - 1]]
        letters = z[word] - a[word]
        line = np.full(int(letters.sum()) + len(letters), 10, np.uint8)
        line[_runs(np.cumsum(letters + 1) - letters - 1, letters)] = blob[kind == 0]
        ranks = np.array(self.engine(line.tobytes().decode()), np.int64)
        ends = np.flatnonzero(ranks == 10)
        source, offset, count = [self.to_id[ranks], self.alone], np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        offset[word] = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else 0
        count[word] = ends - offset[word]
        sign = ~word & (z - a == 1)
        offset[sign] = len(ranks) + self.alone_at[blob[a[sign]]]
        count[sign] = self.alone_n[blob[a[sign]]]
        top, places = len(ranks) + len(self.alone), {}
        for k in np.flatnonzero(~word & (z - a > 1)).tolist():
            mark = blob[a[k] : z[k]].tobytes()
            if mark not in places:
                ids = np.frombuffer(self.mark(mark.decode()), "<u4")
                places[mark] = (top, len(ids))
                source.append(ids)
                top += len(ids)
            offset[k], count[k] = places[mark]
        n[together] = np.add.reduceat(count, np.searchsorted(a, first))
        at[together] = len(own) + np.cumsum(n[together]) - n[together]
        return np.concatenate([own, np.concatenate(source)[_runs(offset, count)]]), at, n

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin and the last's end."""
        s, e, first = texts.words()
        keys, where, which = np.unique(texts.hash(s, e) ^ (e - s).astype(np.uint64), return_index=True, return_inverse=True)
        known = (self.keys, self.at, self.n, self.ids)
        k = np.searchsorted(self.keys, keys)
        there = np.zeros(len(keys), bool)
        inside = k < len(self.keys)
        there[inside] = self.keys[k[inside]] == keys[inside]
        if not there.all():
            new = where[~there]
            ids, at, n = self.learn(texts.data, s[new], e[new])
            at, ids = at + len(self.ids), np.concatenate([self.ids, ids])
            known = (*(np.insert(old, k[~there], add) for old, add in ((self.keys, keys[~there]), (self.at, at), (self.n, n))), ids)
            if len(self.keys) < REMEMBERED:
                self.keys, self.at, self.n, self.ids = known
            k = np.searchsorted(known[0], keys)
        _, at, n, ids = known
        size = n[k][which]
        begin = np.concatenate([[0], np.cumsum(size)])
        return ids[_runs(at[k][which], size)], begin[first]


def _merger(tokenizer):
    """The file's merges of words of LETTERS as ranks of the tiktoken library, and the ids of those ranks.

    The file marks a word's last symbol by an ending. Here the last letter is another character with the same
    number of bytes, which no such word has, so that the merges of last symbols are merges of plain bytes.
    """
    import json

    import tiktoken

    model = json.loads(tokenizer.to_str())["model"]
    ending, vocab = model["end_of_word_suffix"], model["vocab"]
    shown = _shown_bytes()
    last = {a.encode()[-1]: b.encode()[-1] for a, b in zip(LETTERS, FINALS, strict=True)}
    plain = {shown[b]: b for b in {*last, 0xC3}}

    def raw(symbols: str) -> bytes | None:
        final = symbols.endswith(ending)
        body = symbols.removesuffix(ending)
        if not body or any(c not in plain for c in body):
            return None
        code = bytearray(plain[c] for c in body)
        if final:
            if code[-1] not in last:
                return None
            code[-1] = last[code[-1]]
        return bytes(code)

    ranks = {bytes([b]): b for b in range(256)}
    ids = {b: vocab[c] for c, b in plain.items()} | {last[b]: vocab[c + ending] for c, b in plain.items() if b in last}
    for pair in model["merges"]:
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        code = raw(a + b)
        if code is not None and code not in ranks:
            ids[len(ranks)] = vocab[a + b]
            ranks[code] = len(ranks)
    table = np.zeros(len(ranks), "<u4")
    table[list(ids)] = list(ids.values())
    return tiktoken.Encoding("words", pat_str=r"[^\n]+|\n", mergeable_ranks=ranks, special_tokens={}).encode_ordinary, table


def _shown_bytes() -> dict[int, str]:
    """The printable character by which byte-level tokenizer files write each byte."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + k) for k, b in enumerate(rest)}


_TOKENIZERS: dict[tuple[str, bool], WordTokenizer] = {}


def tokenizer(path: str, plain_specials: bool = False) -> WordTokenizer:
    if (path, plain_specials) not in _TOKENIZERS:
        _TOKENIZERS[path, plain_specials] = WordTokenizer(path, plain_specials)
    return _TOKENIZERS[path, plain_specials]


def pieces(df: DataFrame, path: str, tokens: int = 4096, end_id: int = 1, text: str = "text", plain_specials: bool = False) -> DataFrame:
    """One row per piece of each document: df's other columns, piece, start, length, and ids (binary, little-endian unsigned 32-bit). Strings of special tokens are those tokens, as the library has it, unless plain_specials."""
    rest = [c for c in df.columns if c not in (text, "piece", "start", "length", "ids")]

    @F.arrow_udf("array<binary>")
    def cut(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t, end, step = tokenizer(path, plain_specials), np.array([end_id], "<u4").tobytes(), 4 * tokens
        for column in parts:
            out = []
            for part in slices(pa.record_batch([column], ["text"]), "text", 512 << 10):
                flat, begin = t.encode(Texts(part.column(0)))
                for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                    ids = flat[a:b].tobytes() + end
                    out.append([ids[k : k + step] for k in range(0, len(ids), step)])
            yield pa.array(out, pa.list_(pa.binary()))
        _TOKENIZERS.clear()  # a worker's next tasks may be of another kind
        del t
        trim()

    rows = df.select(*rest, cut(F.col(text)).alias("_cut")).select(*rest, F.posexplode("_cut").alias("piece", "ids"))
    return rows.select(*rest, "piece", (F.col("piece").cast("long") * tokens).alias("start"), F.expr("cast(octet_length(ids) div 4 as bigint)").alias("length"), "ids")


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds."""

    tokens: int = 4096
    documents: int = 4096
    cost: int = 4096 * 4096
    #: Of tokens, documents, cost, each measured in parts of its capacity.
    weights: tuple[float, float, float] = (1.0, 0.2, 0.2)
    #: "norm": least weighted norm of the residual after placing; "dot": largest weighted dot product of demand and residual.
    rule: str = "norm"


def sequences(rows: list[tuple[int, int, int, int, int, int, int]]) -> int:
    """The number of sequences of a plan."""
    return max((first + pieces // per for _, _, pieces, per, first, _, _ in rows), default=0)


def tightest(counts: dict[int, int], tokens: int = 4096, slack: float = 0.0, **options) -> tuple[Capacity, list]:
    """The least capacities of documents (a power of two) and then of cost (eighths of tokens squared) that take at most `slack` times more
    sequences than tokens alone would, and the plan. So documents are spread and costs are levelled as far as the number of sequences allows.

    A piece of `tokens` tokens has the highest cost that any sequence can have; where there is one, cost has its full capacity and takes part in choosing
    sequences only.
    """
    cap = Capacity(tokens, tokens, tokens * tokens, **options)
    best = plan(counts, cap)
    most = int(sequences(best) * (1 + slack))
    documents = 1 << max(max((slot + per for _, _, _, per, _, _, slot in best), default=1) - 1, 0).bit_length()
    while documents >= 1:
        rows = plan(counts, replace(cap, documents=documents))
        if sequences(rows) > most:
            break
        cap, best, documents = replace(cap, documents=documents), rows, documents // 2
    for eighths in range(1, 8):
        cost = tokens * tokens * eighths // 8
        if max(counts, default=tokens) ** 2 <= cost:
            rows = plan(counts, replace(cap, cost=cost))
            if sequences(rows) <= most:
                return replace(cap, cost=cost), rows
    return cap, best


def plan(counts: dict[int, int], cap: Capacity) -> list[tuple[int, int, int, int, int, int, int]]:
    """Place all pieces: rows (length, first rank, pieces, pieces per sequence, first sequence, first offset, first slot).

    Sequences in the same state (tokens, documents and cost left) lie in runs of numbers and are filled together.
    """
    whole = (cap.tokens, cap.documents, cap.cost)
    runs: dict[tuple[int, int, int], list[tuple[int, int]]] = defaultdict(list)  # state -> (first sequence, sequences)
    out, made = [], 0

    def fits(state: tuple[int, int, int], n: int) -> int:
        return min(state[0] // n, state[1], state[2] // (n * n))

    def score(state: tuple[int, int, int], need: tuple[int, int, int]) -> float:
        """Smaller is better."""
        if cap.rule == "dot":
            return -sum(w * a * b / (c * c) for w, a, b, c in zip(cap.weights, need, state, whole, strict=True))
        return sum(w * ((b - a) / c) ** 2 for w, a, b, c in zip(cap.weights, need, state, whole, strict=True))

    for n in sorted(counts, reverse=True):
        left, rank, need = counts[n], 0, (n, 1, n * n)
        if fits(whole, n) < 1:
            raise ValueError(f"a piece of {n} tokens is over a sequence's capacities")
        states = sorted((s for s in runs if fits(s, n)), key=lambda s: (score(s, need), s))
        for state in [*states, None]:
            while left and (state is None or runs.get(state)):
                if state is None:  # new sequences
                    per = min(fits(whole, n), left)
                    first, many, had = made, max(1, left // per), whole
                    made += many
                else:
                    per = min(fits(state, n), left)
                    first, many = runs[state].pop()
                    had, use = state, min(many, max(1, left // per))
                    if use < many:
                        runs[state].append((first + use, many - use))
                        many = use
                placed = per * many
                out.append((n, rank, placed, per, first, whole[0] - had[0], whole[1] - had[1]))
                left, rank = left - placed, rank + placed
                now = (had[0] - per * n, had[1] - per, had[2] - per * n * n)
                if min(now) > 0:
                    runs[now].append((first, many))
            if state is not None and not runs.get(state):
                runs.pop(state, None)
            if not left:
                break
    return out


def pack(df: DataFrame, cap: Capacity | None = None, keys: tuple[str, ...] = ("doc_id", "piece"), length: str = "length", tokens: int = 4096, salt: int = 256) -> DataFrame:
    """df with sequence_id, offset (tokens before the piece in its sequence) and slot (pieces before it); without capacities those of `tightest`.

    df is read twice: give it materialized. The table of the plan has at most a few rows per length
    (`tokens` of them), so its broadcast is bounded by the capacity, not by the data.
    """
    spark = df.sparkSession
    df = df.drop("sequence_id", "offset", "slot").withColumn("_g", F.pmod(F.xxhash64(*keys), F.lit(salt)))
    groups = df.groupBy(F.col(length).alias("_n"), "_g").agg(F.count(F.lit(1)).alias("_c"))
    before = groups.withColumn("_before", F.sum("_c").over(Window.partitionBy("_n").orderBy("_g")) - F.col("_c")).select("_n", "_g", "_before")
    counts = {r["_n"]: r["_s"] for r in groups.groupBy("_n").agg(F.sum("_c").alias("_s")).collect()}  # at most `tokens` rows
    rows = plan(counts, cap) if cap else tightest(counts, tokens)[1]
    table: dict[int, list] = defaultdict(list)
    for n, *rest in rows:
        table[n].append(tuple(map(int, rest)))
    places = spark.createDataFrame([(int(n), p) for n, p in table.items()], "_m long, _p array<struct<rank:long,pieces:long,per:long,first:long,offset:long,slot:long>>")
    ranked = df.withColumn("_k", F.row_number().over(Window.partitionBy(length, "_g").orderBy(*keys)) - 1)
    ranked = ranked.join(before.hint("shuffle_hash"), (F.col(length) == F.col("_n")) & (ranked["_g"] == before["_g"])).drop(before["_g"]).drop("_n")
    ranked = ranked.join(F.broadcast(places), F.col(length) == F.col("_m")).withColumn("_r", F.col("_before") + F.col("_k"))
    at = ranked.withColumn("_at", F.expr("filter(_p, p -> p.rank <= _r and _r < p.rank + p.pieces)[0]"))
    inside = F.col("_r") - F.col("_at.rank")
    nth = F.expr("(_r - _at.rank) % _at.per")
    return at.select(
        *[c for c in df.columns if c != "_g"],
        (F.col("_at.first") + F.floor(inside / F.col("_at.per")).cast("long")).alias("sequence_id"),
        (F.col("_at.offset") + nth * F.col(length)).cast("long").alias("offset"),
        (F.col("_at.slot") + nth).cast("long").alias("slot"),
    )
