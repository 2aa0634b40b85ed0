"""Operator 3: shards as runs of a Hilbert curve over quantised metadata (DataFrame functions only).

Each dimension is quantised to 2**bits bins of about equal row counts (strings by the order of whole distinct values, weighted by their rows); a row's cell has an index on the
Hilbert curve through all cells, rows are ordered by (index, hash of the keys, keys), and the order is cut into
runs of equal row counts (law `rows`) or near equal bytes (law `bytes`). Rows of a shard are close in
every dimension, so a reader that filters on any of them skips most shards by their min/max.

Ranks come from counts per (cell, sub-cell): a cell that a third of all rows share is ranked by many
tasks, in sub-cells whose number follows the table's rows. The curve is a constant table of 2**(bits * dimensions) numbers, and that many rows at most are broadcast.

Defined cases: a null in a dimension sorts before all values; null text has size 1 and the
checksum of no bytes; ties are cut by the keys, then by size, and repeated rows each have a slot of their own;
an empty table gives an empty table; other columns pass through unless they bear the names of the outputs.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallkit.session import discard, materialize

OUTPUTS = ("curve", "shard", "slot")


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def number(df: DataFrame, name: str) -> Column:
    """A column of numbers or times as a number, nulls first."""
    return F.coalesce(F.col(name).cast("double"), F.lit(float("-inf")))


def text_points(df: DataFrame, name: str, n: int) -> list[tuple[int, str]]:
    """The first strings of n runs of about equal row counts, with their runs' numbers, in order (a string of several runs begins the first); whole strings are compared, and equal ones stay together.

    Distinct strings are counted and ordered by ranges; a running count inside each range and one number per range give every
    string the rows before it. What is collected is a row per range and one per run.
    """
    counts = df.groupBy(F.col(name).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ordered = materialize(counts.repartitionByRange(F.col("_v").asc_nulls_first()).withColumn("_p", F.spark_partition_id()))
    sums = {r["_p"]: r["_s"] for r in ordered.groupBy("_p").agg(F.sum("_c").alias("_s")).collect()}
    total, start, before = sum(sums.values()), {}, 0
    for p in sorted(sums):
        start[p], before = before, before + sums[p]
    if not total:
        return []
    first = df.sparkSession.createDataFrame(list(start.items()), "_q int, _b long")
    running = F.sum("_c").over(Window.partitionBy("_p").orderBy(F.col("_v").asc_nulls_first())) - F.col("_c")
    runs = ordered.withColumn("_r", running).join(F.broadcast(first), F.col("_p") == F.col("_q"))  # a row per range
    runs = runs.withColumn("_run", F.expr(f"(_b + _r) * {n} div {total}"))
    points = runs.where("_v is not null and _run > 0").groupBy("_run").agg(F.min("_v").alias("_v")).orderBy("_run").collect()
    discard(ordered)
    return [(r["_run"], r["_v"]) for r in points]


def curve(bits: int, dims: int) -> list[int]:
    """The index on the Hilbert curve of every cell, cells numbered by their bins' bits, first dimension highest.

    The bins are followed from the coarsest level down: each level's bits tell how the levels below are
    exchanged and inverted; what is left is a Gray code of the index.
    """
    out = []
    for cell in range(2 ** (bits * dims)):
        at = [(cell >> bits * (dims - 1 - d)) & (2**bits - 1) for d in range(dims)]
        for level in range(bits - 1, 0, -1):
            low = (1 << level) - 1
            for d in range(dims):
                if at[d] >> level & 1:
                    at[0] ^= low
                else:
                    other = (at[0] ^ at[d]) & low
                    at[0] ^= other
                    at[d] ^= other
        for d in range(1, dims):
            at[d] ^= at[d - 1]
        flip = 0
        for level in range(bits - 1, 0, -1):
            if at[-1] >> level & 1:
                flip ^= (1 << level) - 1
        out.append(sum(((at[d] ^ flip) >> level & 1) << (level * dims + dims - 1 - d) for level in range(bits) for d in range(dims)))
    return out


def bins(df: DataFrame, dims: list[str], bits: int) -> Column:
    """Each row's cell: per dimension the number of cut points (quantiles of all rows) at or below the value, so few distinct values are spread over all bins."""
    cuts = [k / 2**bits for k in range(1, 2**bits)]
    numbers = [d for d in dims if not is_text(df, d)]
    found = df.agg(F.lit(0).alias("_"), *[F.percentile_approx(number(df, d), F.array(*map(F.lit, cuts)), 10_000).alias(f"q{k}") for k, d in enumerate(numbers)]).first()  # bounded by the parameters
    cell = F.lit(0).cast("long")
    for d in dims:
        n = F.lit(0)
        if d in numbers:
            for p, times in sorted(Counter(found[1 + numbers.index(d)] or []).items()):
                n = n + F.when(number(df, d) > F.lit(p), times).otherwise(0)
        else:
            last = 0
            for run, p in text_points(df, d, 2**bits):
                n, last = n + F.when(F.col(d) >= F.lit(p), run - last).otherwise(0), run
        cell = cell * 2**bits + n
    return cell


def shards(df: DataFrame, dims: list[str], n_shards: int, law: str = "rows", keys: list[str] = ["doc_id"], size: str = "size", bits: int = 4, subcells: int | None = None) -> DataFrame:  # noqa: B006
    """df with curve, shard (0 to n_shards - 1, in curve order) and slot (gapless from 0 within the shard).

    df is read several times: give it materialized, without the texts. Each cell is ranked in `subcells` parts (default: as many as
    leave about 2**17 rows in each if all rows share one cell).
    """
    if law not in ("rows", "bytes"):
        raise ValueError("law is rows or bytes")
    df = df.drop(*OUTPUTS)
    subcells = subcells or max(64, 1 << (df.count() >> 17).bit_length())
    table = F.expr(f"array({', '.join(f'{x}L' for x in curve(bits, len(dims)))})")
    rows = df.withColumn("curve", F.get(table, bins(df, dims, bits).cast("int"))).withColumn("_sub", F.pmod(F.xxhash64(*keys), F.lit(subcells)))
    weight = F.col(size).cast("long")
    groups = rows.groupBy("curve", "_sub").agg(F.count(F.lit(1)).alias("_n"), F.sum(weight).alias("_b"))
    # Two levels of running sums: over at most 2**(bits * dims) cells, then over sub-cells inside each cell.
    cells = groups.groupBy("curve").agg(F.sum("_n").alias("_cn"), F.sum("_b").alias("_cb"))
    everything = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.orderBy("curve")
    cells = cells.select("curve", (F.sum("_cn").over(upto) - F.col("_cn")).alias("_n0"), (F.sum("_cb").over(upto) - F.col("_cb")).alias("_b0"), F.sum("_cn").over(everything).alias("_total"), F.sum("_cb").over(everything).alias("_bytes"))
    inner = Window.partitionBy("curve").orderBy("_sub")
    groups = groups.withColumns({"_n1": F.sum("_n").over(inner) - F.col("_n"), "_b1": F.sum("_b").over(inner) - F.col("_b")}).drop("_n", "_b")
    start = groups.join(F.broadcast(cells), "curve").select("curve", "_sub", (F.col("_n0") + F.col("_n1")).alias("_rank0"), (F.col("_b0") + F.col("_b1")).alias("_bytes0"), "_total", "_bytes")
    order = Window.partitionBy("curve", "_sub").orderBy(*keys, size)
    rows = rows.withColumns({"_k": F.row_number().over(order) - 1, "_w": F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, 0)) - weight})
    rows = rows.join(start.hint("shuffle_hash"), ["curve", "_sub"]).withColumns({"_rank": F.col("_rank0") + F.col("_k")})
    if law == "rows":
        shard = F.expr(f"_rank * {n_shards} div _total")
        slot = F.col("_rank") - F.expr(f"(shard * _total + {n_shards - 1}) div {n_shards}")
        out = rows.withColumn("shard", shard.cast("int")).withColumn("slot", slot.cast("long"))
    else:
        out = rows.withColumn("shard", F.least(F.expr(f"(_bytes0 + _w) * {n_shards} div greatest(_bytes, 1)"), F.lit(n_shards - 1)).cast("int"))
        first = out.groupBy("shard").agg(F.min("_rank").alias("_first"))  # n_shards rows
        out = out.join(F.broadcast(first), "shard").withColumn("slot", (F.col("_rank") - F.col("_first")).cast("long"))
    return out.select(*df.columns, *OUTPUTS)
