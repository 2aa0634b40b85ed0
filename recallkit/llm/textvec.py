"""Vectorised word and substring hashes of whole Arrow batches of texts.

A word is a maximal run of bytes of one class; hashes are polynomial sums of random byte codes
modulo 2**64, finished by a mixing step, so any substring's hash comes from one prefix sum.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.Generator(np.random.PCG64(20240229))
CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 2**64)

#: ASCII white space: 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of letters and digits, and all of those outside ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", BASE), ("down", BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Texts:
    """The bytes of some texts, one after the other, and where each begins (null: empty)."""

    def __init__(self, column: pa.Array | pa.ChunkedArray, lower: bool = False):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column.cast(pa.large_string()), "")
        if lower:
            column = pc.utf8_lower(column)
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
        self.data = data[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, member: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the runs of bytes in member (default: not white space), and the index at which each text's first word stands."""
        inside = (~SPACE if member is None else member)[self.data]
        starts, ends = inside.copy(), inside.copy()
        if len(inside):
            starts[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            edges = self.offsets[1:-1]
            cut = edges[(edges > 0) & (edges < len(inside))]
            starts[cut] |= inside[cut]
            ends[cut - 1] |= inside[cut - 1]
        s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        return s, e, np.searchsorted(s, self.offsets)

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the substrings from starts to ends."""
        n = len(self.data)
        up, down = _powers(n + 1)
        if self._sums is None:
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum(CODES[self.data] * up[:n], out=self._sums[1:])
        return mix((self._sums[ends] - self._sums[starts]) * down[starts])


def trim() -> None:
    """Give freed memory back to the system: Python workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    if give_back := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give_back(0)


def slices(batch: pa.RecordBatch | pa.Table, column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices of about most_bytes of text each (a longer text stands alone), so that memory is bounded by the longest text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
    group = np.cumsum(sizes) // most_bytes if len(sizes) else sizes
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
    trim()


def shingle_sets(texts: Texts, width: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of width consecutive words; of all its words if it has fewer; none without words."""
    s, e, first = texts.words()
    w = texts.hash(s, e)
    n = len(w)
    if n >= width:
        h = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            h = mix(h * np.uint64(BASE) + w[k : n - width + 1 + k])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(h[a : b - width + 1]))
        elif b > a:
            x = np.zeros(1, np.uint64)
            for k in range(a, b):
                x = mix(x * np.uint64(BASE) + w[k : k + 1])
            out.append(x ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
