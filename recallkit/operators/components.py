"""Connected components by contraction, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallkit.session import discard, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root) for every node of an edge whose component's least node is not itself.

    Each round hooks every node to its least neighbour below it, follows these pointers to their ends, and
    replaces the edges by those between ends; edges inside one tree vanish. Minima and distinct edges are
    combined before their shuffles, and the joins on a node's pointer are plain equi-joins that adaptive execution splits
    when one node has many edges. Edges with a null end are left out, repeated ones and those from a node to itself change nothing, and no edges give no rows.
    """
    live = materialize(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct())
    found = None
    while not live.isEmpty():
        hook = materialize(live.groupBy("v").agg(F.min("u").alias("p")))
        while True:
            up = hook.select(F.col("v").alias("_v"), F.col("p").alias("_p"))
            before = hook
            jump = materialize(hook.join(up, F.col("p") == F.col("_v"), "left").select("v", F.coalesce("_p", "p").alias("p"), F.col("_p").isNotNull().alias("moved")))
            discard(before)
            hook = jump.select("v", "p")
            hook._written = jump._written
            if jump.where("moved").isEmpty():
                break
        ends = hook.select(F.col("v").alias("_v"), F.col("p").alias("_p"))
        ru = live.join(ends, F.col("u") == F.col("_v"), "left").select(F.coalesce("_p", "u").alias("u"), "v")
        rv = ru.join(ends, F.col("v") == F.col("_v"), "left").select("u", F.coalesce("_p", "v").alias("v"))
        done = live
        live = materialize(rv.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        discard(done)
        if found is None:
            found = hook
        else:
            onward = found.join(ends, F.col("p") == F.col("_v"), "left").select("v", F.coalesce("_p", "p").alias("p"))
            fresh = hook.join(found.select(F.col("v").alias("_w")), F.col("v") == F.col("_w"), "left_anti")
            found = materialize(onward.unionByName(fresh))
    if found is None:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    return found.select(F.col("v").alias("node"), F.col("p").alias("root"))
