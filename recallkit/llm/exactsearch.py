"""Operator 9: exact top-k inner products by pivot-table elimination.

For every vector the distances to many pivots are computed once and kept beside it. For a query q and a candidate
x, the triangle inequality gives |q - x| >= max over pivots p of |d(q, p) - d(x, p)|, and so
q.x <= (|q|^2 + |x|^2 - bound^2) / 2. Candidates are evaluated in the order of these upper bounds, and a query
stops when no bound left reaches its k-th best score: the result is exact.

It is one job: queries are dealt into blocks of `block` rows and candidates into shares of `share` rows, by hash; each block meets each share in one
task, which holds just these two, keeps k rows per query, and one aggregation merges them. So memory is bounded by the parameters, and what moves is
(blocks) times the candidates and (shares) times the queries, neither of which passes through the driver.

Defined cases: vectors that are null, empty, or hold a null, NaN or infinite component take no part; vectors of
different lengths have no score; ties go to the smaller vec_id; repeated rows each count as candidates, but never a
query's own vec_id, and ask once; fewer candidates than k give all; vectors
of a length that the sample for the pivots doesn't hold have bounds by their norms only; an empty table gives no rows. Components above 2**20 would leave exact
64-bit floats and are computed with whole numbers of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EXACT = float(2**20)


def pivot_table(df: DataFrame, vec_id: str = "vec_id", vector: str = "vector", pivots: int = 48, sample: int = 2000) -> DataFrame:
    """Rows (vec_id, vector, to_pivots) of the vectors that take part; vector has whole numbers as doubles.

    Pivots are chosen far apart, one after the other, from a sample of bounded size (rows of lowest hash); they steer
    the work only, never the result.
    """
    good = df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    )
    seen = [np.array(r["vector"]) for r in good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()]
    dims: dict[int, np.ndarray] = {}
    for n in {len(v) for v in seen}:
        rows = np.array([v for v in seen if len(v) == n])
        chosen, far = [rows[0]], np.full(len(rows), np.inf)
        while len(chosen) < min(pivots, len(rows)):
            far = np.minimum(far, np.linalg.norm(rows - chosen[-1], axis=1))
            chosen.append(rows[int(far.argmax())])
        dims[n] = np.array(chosen)

    @F.pandas_udf("array<double>")
    def distances(column: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(column), dtype=object)
        sizes = column.map(len)
        for n, at in column.groupby(sizes).groups.items():
            x = np.stack(column[at])
            d = np.linalg.norm(x[:, None] - dims[n][None], axis=2) if n in dims else np.zeros((len(x), 1))
            out[at] = list(d)
        return out

    return good.withColumn("to_pivots", distances("vector"))


def _dot(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    if np.abs(x).max(initial=0) < EXACT and np.abs(q).max(initial=0) < EXACT:
        return (x @ q).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in x], object)


class _Block:
    """Some queries of one length and their k best candidates so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, to_pivots: np.ndarray, k: int):
        self.ids, self.q, self.d, self.k = ids, q, to_pivots, k
        self.sq = (q**2).sum(1)
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, vec_id), best first

    def add(self, ids: np.ndarray, x: np.ndarray, d: np.ndarray, chunk: int = 512) -> None:
        norm = (x**2).sum(1)
        for i in range(len(self.ids)):
            bound = np.abs(d - self.d[i]).max(1)
            upper = (norm + self.sq[i] - bound**2) / 2 + 1e-6 * (norm + self.sq[i]) + 1  # above all rounding
            best, left, size = self.best[i], np.arange(len(ids)), chunk
            while len(left):
                if len(best) == self.k:
                    left = left[upper[left] >= -best[-1][0]]  # the others are out for good
                # The next in the order of the bounds.
                order = np.argpartition(-upper[left], size) if len(left) > size else np.arange(len(left))
                part, left, size = left[order[:size]], left[order[size:]], size * 4
                scores, names = _dot(x[part], self.q[i]), ids[part]
                keep = names != self.ids[i]
                if len(best) == self.k:
                    keep &= scores >= -best[-1][0]
                if keep.any():
                    scores, names = scores[keep], names[keep]
                    top = np.lexsort((names, -scores))[: self.k] if scores.dtype != object else range(len(scores))
                    best = sorted(best + [(-int(scores[t]), int(names[t])) for t in top])[: self.k]
            self.best[i] = best


def _matrices(table: pa.Table, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of the rows of one kind: ids, vectors and distances to pivots, for each length of vectors."""
    rows = table.filter(pc.equal(table.column("kind"), kind))
    sizes = pc.list_value_length(rows.column("vector")).to_numpy()
    for n in np.unique(sizes).tolist():
        own = rows.filter(pa.array(sizes == n)).combine_chunks()
        flat = lambda c, own=own: pc.list_flatten(own.column(c)).to_numpy().reshape(own.num_rows, -1)
        yield own.column("vec_id").to_numpy(), flat("vector"), flat("to_pivots")


def top_k(table: DataFrame, queries: DataFrame, k: int = 5, block: int = 4096, share: int = 16384) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) for the queries, rows of the same pivot table.

    table should be materialized: it is counted and read once.
    """
    queries = queries.dropDuplicates(["vec_id"])
    blocks, shares = max(1, -(-queries.count() // block)), max(1, -(-table.count() // share))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(F.lit("q").alias("kind"), "vec_id", "vector", "to_pivots", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("qb"), every(shares).alias("cs"))
    known = table.select(F.lit("c").alias("kind"), "vec_id", "vector", "to_pivots", every(blocks).alias("qb"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shares)).cast("int").alias("cs"))

    def meet(tile: pa.Table) -> pa.Table:
        asked_of = {q.shape[1]: _Block(ids, q, d, k) for ids, q, d in _matrices(tile, "q")}
        for ids, x, d in _matrices(tile, "c"):
            if x.shape[1] in asked_of:
                asked_of[x.shape[1]].add(ids, x, d)
        out = [(q, v, -s) for b in asked_of.values() for q, best in zip(b.ids.tolist(), b.best, strict=True) for s, v in best]
        return pa.table([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["query_id", "vec_id", "score"])

    found = asked.unionByName(known).groupBy("qb", "cs").applyInArrow(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
