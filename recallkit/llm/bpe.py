"""Operator 1: byte-level BPE encoding and decoding by the tiktoken library with a local rank file.

Texts are cut before runs of white space that follow another character. A match of the pattern
never crosses such a place (white space stands only at a match's start, or fills it), so each chunk
may be encoded by itself: long texts go part by part, so that time stays linear and memory bounded.
No special tokens: their strings are ordinary text.

Defined cases: null text -> no ids (empty bytes); empty text -> the same; lone or odd characters,
long runs of one character, and white space of any length are encoded as tiktoken does; rows are
independent, so repeated rows and ties repeat their result; an empty table gives an empty table.
Other columns pass through; a column named as the output is replaced. Unknown ids fail in decode().
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: \s of the rank file's pattern. Python's \s also holds 0x1C-0x1F, which are no white space there.
CHUNK = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
LEADING = re.compile(r"[^\S\x1c-\x1f]*")
#: Longer texts, in characters, are encoded part by part.
LONG_TEXT = 50_000
#: Longer runs of white space are split by hand in front of their last character, as the pattern does.
LONG_RUN = 4096


class Codec:
    """Encodes and decodes with one rank file."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if len(text) <= LONG_TEXT:
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        part: list[str] = []
        size = 0
        for chunk in CHUNK.finditer(text):
            part.append(chunk[0])
            size += len(chunk[0])
            if size > LONG_TEXT:
                ids += self._cut(part)
                part, size = [], 0
        return ids + self._cut(part)

    def _cut(self, chunks: list[str]) -> list[int]:
        """The ids of chunks that follow one another. A long run of white space overflows the stack of the pattern's own matching, so it is split by hand: all but its last character are one match."""
        ids: list[int] = []
        for _, group in groupby(chunks, key=lambda c: len(c) > LONG_RUN and len(LEADING.match(c)[0]) > LONG_RUN):
            rest = "".join(group)
            while (run := len(LEADING.match(rest)[0])) > LONG_RUN:
                run -= run < len(rest)
                ids += self.encoding._encode_single_piece(rest[:run].encode())
                head = CHUNK.match(rest, run)
                ids += self.encoding.encode_ordinary(head[0]) if head else []
                rest = rest[head.end() :] if head else ""
            ids += self.encoding.encode_ordinary(rest)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per process and rank file."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the array of token ids of each text in a new column."""

    @F.arrow_udf("array<int>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path, pattern)
        for column in parts:
            coded = [np.array(c.encode(t.as_py() or ""), np.int32) for t in column]
            offsets = np.zeros(len(coded) + 1, np.int32)
            np.cumsum([len(x) for x in coded], out=offsets[1:])
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *coded])))

    return df.withColumn(ids, run(F.col(text)))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the raw bytes that the ids stand for (null ids: empty bytes). Bytes need not be valid UTF-8."""

    @F.arrow_udf("binary")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path, pattern)
        for column in parts:
            offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            there = column.is_valid().to_numpy(zero_copy_only=False)
            yield pa.array([c.decode(flat[a:b].tolist()) if ok else b"" for a, b, ok in zip(offsets[:-1].tolist(), offsets[1:].tolist(), there.tolist(), strict=True)], pa.binary())

    return df.withColumn(out, run(F.col(ids)))
