"""Operator 2: n-gram Jaccard join by a MinHash LSH forest.

Documents are sets of hashed five-word shingles (words: runs without ASCII white space, lower-cased). The join works on
classes of equal sets, so copies cost nothing beyond their class.

1. Each class has a signature of trees * depth MinHash values. A tree is the sorted trie of one stretch of the signatures: rows are
   dealt by ranges of (tree, stretch) and sorted, and common prefixes with the neighbouring rows give every node from the full depth
   up to `floor` and its size (`tries`). Nodes that cross the border of two ranges are put together from the ranges' first and last rows.
2. Each class shortens its prefixes from the full depth, all trees together, until a set at the threshold would share one of them with
   the target probability. A tree whose shorter prefix would lead into a node of more than `wide` classes stays behind; the other trees
   then go further up instead, and only if all of them don't reach the target, crowded nodes are opened as well (`opened`).
   A node opened by one of its classes brings all of its classes together.
3. Nodes with the same members in several trees are kept once. Inside a node, sorted by signature, classes are compared by their whole
   signatures, and those that agree clearly less than the threshold allows are parted. A node with many classes is
   dealt out by pairs of blocks, so no task holds more than two blocks.
4. Groups of classes that hang together this way are brought together once, block pair by block pair, with
   their shingles, and every pair in a group is verified exactly (on 64-bit shingle hashes). Only counts and
   spanning links leave a task, never all pairs.

Defined cases: fewer than five words make one shingle of all words; documents without words (null or empty
text) are in no class with others and have no links; equal sets are one class (similarity 1), whatever else differs; repeated rows are copies;
a class is known by its set, so rows without doc_id and different texts under one doc_id have all their links; a group is named by the least doc_id in it (null if no row of
it has one); an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallkit.session import broadcast_if_small, materialize

from recallkit.operators.components import components
from .textvec import BASE, Texts, mix, shingle_sets, slices


@dataclass(frozen=True)
class Forest:
    """threshold: least similarity of a link. target: least probability that a pair at the threshold meets in some tree."""

    threshold: float = 0.8
    width: int = 5
    trees: int = 20
    depth: int = 7
    #: The shortest prefix.
    floor: int = 4
    target: float = 0.9995
    #: Classes in a node from which on a tree stays at a longer prefix as long as the others make up for it.
    wide: int = 64
    #: Agreement of whole signatures below which a pair is parted: 0.8 less six standard errors of 140 values.
    screen: float = 0.59
    #: Classes in a block, which holds about 8 MB of shingles at most.
    block: int = 512

    def weight(self, prefix: int) -> float:
        """What a tree at this prefix adds to -log(probability that a pair at the threshold is missed)."""
        return -math.log1p(-(self.threshold**prefix))

    @property
    def need(self) -> float:
        return -math.log1p(-self.target)

    @property
    def levels(self) -> list[int]:
        return list(range(self.depth, self.floor - 1, -1))

    def prefix(self) -> int:
        """The longest prefix that gives the target if all trees are at it."""
        return next((p for p in self.levels if self.trees * self.weight(p) >= self.need), self.floor)


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(7))
    return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    """The top 16 bits of each hash function's least value."""
    low = np.full(len(a), 2**64 - 1, np.uint64)
    for k in range(0, len(shingles), 2048):
        low = np.minimum(low, (a[:, None] * shingles[None, k : k + 2048] + b[:, None]).min(1))
    return (mix(low) >> np.uint64(48)).astype("<u2").tobytes()


def signed(df: DataFrame, forest: Forest, doc: str, text: str) -> DataFrame:
    """Rows (doc_id, text_hash, k1, k2, n, sig): a 128-bit digest of the shingle set, its size (0: no words), its signature."""
    a, b = _seeds(forest.trees * forest.depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(Texts(part.column("text"), lower=True), forest.width)
                k1, k2 = _digests(sets)
                sigs = [signature(s, a, b) if len(s) else None for s in sets]
                n = np.array([len(s) for s in sets], np.int32)
                yield pa.record_batch([part.column("doc_id"), part.column("text_hash"), k1, k2, n, pa.array(sigs, pa.binary())], ["doc_id", "text_hash", "k1", "k2", "n", "sig"])

    rows = df.select(F.col(doc).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, k1 long, k2 long, n int, sig binary")


def _digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k1 = np.array([np.bitwise_xor.reduce(mix(s)) if len(s) else 0 for s in sets], np.uint64)
    k2 = np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64)
    return k1.view(np.int64), k2.view(np.int64)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys of sorted batches; as many whole groups at once as have come, the last one held back."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = {k: batch.column(k)[-1].as_py() for k in keys}
        same = np.ones(batch.num_rows, bool)
        for k in keys:
            same &= batch.column(k).to_numpy(zero_copy_only=False) == last[k]
        start = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if start or (held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys)):
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
            held = []
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _runs(table: pa.Table, keys: list[str]) -> list[tuple[int, int]]:
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for k in keys:
        c = table.column(k).to_numpy()
        change[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(change).tolist()
    return list(zip(starts, [*starts[1:], table.num_rows], strict=True))


def _forest_links(reps: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links of a symmetric 0/1 matrix: each row's least row of its component."""
    n = len(reps)
    seen, out = np.zeros(n, bool), []
    for i in np.argsort(reps).tolist():
        if seen[i]:
            continue
        reach = np.zeros(n, bool)
        reach[i] = True
        edge = reach
        while edge.any():
            new = linked[edge].any(0) & ~reach
            reach |= new
            edge = new
        seen |= reach
        out += [(int(reps[j]), int(reps[i])) for j in np.flatnonzero(reach).tolist() if j != i]
    return out


def _dealt(df: DataFrame, key: str, size: str, block: int, name: str = "rep") -> DataFrame:
    """df once per pair of blocks of its key's rows; p <= q are the blocks, mine the row's own."""
    df = df.withColumn("_b", F.ceil(F.col(size) / block).cast("int")).withColumn("mine", F.pmod(F.xxhash64(name), F.col("_b")).cast("int"))
    df = df.withColumn("_x", F.explode(F.expr("sequence(0, _b - 1)")))
    return df.withColumns({"p": F.least("mine", "_x"), "q": F.greatest("mine", "_x")}).drop("_b", "_x")


def _nodes(tree: np.ndarray, stretch: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows: the names (hashes) of the nodes they stand in, by level from floor to the full depth, and the nodes' sizes among these rows."""
    n, depth = stretch.shape
    name = mix(tree.astype(np.uint64) + np.uint64(77))
    same = np.concatenate([[False], tree[1:] == tree[:-1]])
    names, sizes = [], []
    for p in range(depth):
        name = mix(name * np.uint64(BASE) + stretch[:, p] + np.uint64(p + 1))
        same = same & np.concatenate([[False], stretch[1:, p] == stretch[:-1, p]])  # the common prefix with the row before goes on
        if p + 1 >= floor:
            run = np.cumsum(~same) - 1
            names.append(name)
            sizes.append(np.bincount(run, minlength=1)[run] if n else run)
    return np.stack(names, 1), np.stack(sizes, 1)


def tries(rows: DataFrame, forest: Forest) -> DataFrame:
    """Rows (rep, tree, nodes, sizes, edge): a class, and its nodes in a tree by level from the floor to the full depth, of those whose floor node holds another class.

    Sizes are those within the range; edge marks rows whose floor node may go on in another range, and ends the first and last row of a range.
    """
    stretch = [F.struct(F.lit(t).alias("tree"), F.substring("sig", 2 * t * forest.depth + 1, 2 * forest.depth).alias("stretch")) for t in range(forest.trees)]
    each = rows.select("rep", F.explode(F.array(*stretch)).alias("_t")).select("rep", "_t.tree", "_t.stretch")
    each = each.withColumn("floor", F.substring("stretch", 1, 2 * forest.floor))
    ranged = each.repartitionByRange("tree", "stretch", "rep").sortWithinPartitions("tree", "stretch", "rep")
    depth, floor = forest.depth, forest.floor
    kind = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, first = _groups(batches, ["tree", "floor"]), True
        table = next(groups, None)
        while table is not None:
            after = next(groups, None)
            if not table.num_rows:
                table = after
                continue
            values = np.frombuffer(b"".join(table.column("stretch").to_pylist()), "<u2").reshape(-1, depth)
            names, sizes = _nodes(table.column("tree").to_numpy(), values, floor)
            edge, ends = np.zeros(len(values), bool), np.zeros(len(values), bool)
            if first:
                edge |= names[:, 0] == names[0, 0]
                ends[0], first = True, False
            if after is None:
                edge |= names[:, 0] == names[-1, 0]
                ends[-1] = True
            keep = np.flatnonzero(edge | (sizes[:, 0] > 1))
            offsets = np.arange(0, len(keep) * names.shape[1] + 1, names.shape[1], dtype=np.int32)
            yield pa.record_batch(
                [table.column("rep").combine_chunks().take(pa.array(keep)), table.column("tree").combine_chunks().take(pa.array(keep)), pa.ListArray.from_arrays(offsets, names[keep].view(np.int64).reshape(-1)), pa.ListArray.from_arrays(offsets, sizes[keep].astype(np.int64).reshape(-1)), pa.array(edge[keep]), pa.array(ends[keep])],
                schema=pa.schema([("rep", pa.int64()), ("tree", pa.int32()), ("nodes", kind), ("sizes", kind), ("edge", pa.bool_()), ("ends", pa.bool_())]),
            )
            table = after

    return ranged.mapInArrow(run, "rep long, tree int, nodes array<long>, sizes array<long>, edge boolean, ends boolean").withColumn("part", F.spark_partition_id())


def opened(found: DataFrame, forest: Forest) -> DataFrame:
    """Rows (rep, node) of the nodes that classes open, each class in the topmost of them in each tree. found: what `tries` gives, materialized."""
    levels = list(range(forest.floor, forest.depth + 1))
    ends = found.where("ends").select("part", F.explode(F.arrays_zip("nodes", "sizes")).alias("_e")).select("part", "_e.nodes", "_e.sizes").distinct()
    across = ends.groupBy(F.col("nodes").alias("_node")).agg(F.sum("sizes").alias("_size"), F.count(F.lit(1)).alias("_parts")).where("_parts > 1").drop("_parts")
    # A few rows per range: the nodes that cross a border, with their whole sizes.
    whole = F.broadcast(across.agg(F.map_from_entries(F.collect_list(F.struct("_node", "_size"))).alias("_across")).withColumn("_all", F.lit(True)))
    rows = found.join(whole, F.col("_all")).withColumn("sizes", F.transform("nodes", lambda x, k: F.coalesce(F.try_element_at("_across", x), F.get("sizes", k)))).drop("_across", "_all", "edge", "ends", "part")
    rows = rows.where(F.col("sizes")[0] > 1)
    # The shortest prefix that leads into no crowded node; the full depth if there is none.
    calm = F.lit(forest.depth)
    for k in range(len(levels) - 1, -1, -1):
        calm = F.when(F.col("sizes")[k] <= forest.wide, levels[k]).otherwise(calm)
    rows = rows.withColumn("calm", calm)
    own = Window.partitionBy("rep")
    held = {p: F.count_if(F.col("calm") == p).over(own) for p in levels}
    rows = rows.withColumns({f"_c{p}": c for p, c in held.items()})
    there = sum((F.col(f"_c{p}") for p in levels), F.lit(0))
    level = F.lit(None).cast("int")
    for p in levels:  # the longest prefix whose estimate reaches the target comes last, so it counts
        estimate = (forest.trees - there) * forest.weight(p) + sum((F.col(f"_c{q}") * forest.weight(max(p, q)) for q in levels), F.lit(0.0))
        level = F.when(estimate >= forest.need, p).otherwise(level)
    level = F.when(level.isNotNull(), F.greatest(level, "calm")).otherwise(forest.prefix())
    rows = rows.select("rep", "tree", "nodes", "sizes", F.get("nodes", level - forest.floor).alias("own"))
    wanted = rows.select(F.col("own").alias("_own")).distinct()
    each = rows.select("rep", "tree", F.posexplode("nodes").alias("level", "node")).join(wanted, F.col("node") == F.col("_own"), "left_semi")
    return each.groupBy("rep", "tree").agg(F.min(F.struct("level", "node")).alias("_n")).select("rep", F.col("_n.node").alias("node"))


def screened(classes: DataFrame, forest: Forest) -> DataFrame:
    """Links (a, b) between classes that share an opened trie node and whose signatures agree: a spanning set of them."""
    # Sets of one to three shingles have no other set at 0.8: nothing to look for.
    least = int(np.ceil(forest.threshold / (1 - forest.threshold) - 1e-9))
    rows = classes.where(F.col("n") >= least)
    nodes = materialize(opened(materialize(tries(rows, forest)), forest))
    shared = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64(F.lit(3), "rep")).alias("y")).where("size > 1")
    shared = shared.groupBy("size", "x", "y").agg(F.min("node").alias("node")).select(F.col("node").alias("_node"), "size")
    members = materialize(nodes.join(shared, F.col("node") == F.col("_node")).select("node", "size", "rep"))
    full = members.join(rows.select(F.col("rep").alias("_rep"), "sig"), F.col("rep") == F.col("_rep")).select("node", "size", "rep", "sig")
    keys = ["node", "p", "q"]
    dealt = _dealt(full, "node", "size", min(128, forest.block)).drop("size")
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "sig", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, keys):
            reps = table.column("rep").to_numpy()
            sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(len(reps), -1)
            a, b = [], []
            runs = _runs(table, keys)
            two = np.array([s for s, e in runs if e - s == 2], np.int64)
            if len(two):
                ok = two[(sigs[two] == sigs[two + 1]).mean(1) >= forest.screen]
                a += np.maximum(reps[ok], reps[ok + 1]).tolist()
                b += np.minimum(reps[ok], reps[ok + 1]).tolist()
            for s, e in runs:
                if e - s > 2:
                    own = sigs[s:e]
                    linked = np.array([(own == x).mean(1) >= forest.screen for x in own])
                    for x, y in _forest_links(reps[s:e], linked):
                        a.append(x)
                        b.append(y)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the common parts of all pairs, from 0/1 matrices over stretches of the shingles that occur."""
    names = np.unique(np.concatenate([*left, *right]))
    out = np.zeros((len(left), len(right)), np.int64)
    at = [[np.searchsorted(names, s) for s in side] for side in (left, right)]
    for k in range(0, len(names), 8192):
        m = []
        for side in at:
            x = np.zeros((len(side), min(8192, len(names) - k)), np.float32)
            for i, s in enumerate(side):
                lo, hi = np.searchsorted(s, (k, k + 8192))
                x[i, s[lo:hi] - k] = 1
            m.append(x)
        out += (m[0] @ m[1].T).astype(np.int64)
    return out


def near_classes(df: DataFrame, forest: Forest = Forest(), doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: doc_id, class_id (least doc_id of the documents that links join), copy_id (least doc_id with an equal set),
    copies (rows with an equal set), n_links (other rows at the threshold or above), n_texts (linked classes), text_hash and first (whether the row's text and doc_id are
    those that stand for the whole group; rows that repeat both are first together)."""
    docs = df.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = materialize(signed(docs, forest, "doc_id", "text"))
    worded = rows.where("n > 0")
    # The row that stands for a class: the least doc_id, rows without one last, then the least hash of the text.
    stand = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("_s")
    classes = worded.groupBy("k1", "k2").agg(stand, F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = materialize(classes.select("k1", "k2", "_s", "copies", "n", "sig", F.monotonically_increasing_id().alias("rep")))
    groups = components(screened(classes, forest))
    # Members of each group, its least class among them, with the group's size.
    roots = groups.select(F.col("root").alias("rep"), "root").distinct()
    members = groups.select(F.col("node").alias("rep"), "root").unionByName(roots)
    copies = classes.select(F.col("rep").alias("_rep"), "copies", "n", "k1", "k2", F.col("_s.doc_id").alias("_doc"), F.col("_s.text_hash").alias("_text"))
    members = materialize(members.join(copies, F.col("rep") == F.col("_rep")).drop("_rep"))
    # A block holds at most `block` classes, and as few long ones as make about `block` * 2048 shingles.
    sizes = members.groupBy(F.col("root").alias("_root")).agg(F.greatest(F.count(F.lit(1)), F.sum("n") / 2048).alias("size"))
    members = members.join(sizes, F.col("root") == F.col("_root")).select("rep", "root", "size", "copies", "k1", "k2", "_doc", "_text")
    few = broadcast_if_small(materialize(members))
    width, threshold, keys = forest.width, forest.threshold, ["root", "p", "q"]

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(Texts(part.column("text"), lower=True), width)
                k1, k2 = _digests(sets)  # another text with the same hash is not the class
                own = np.flatnonzero((k1 == part.column("k1").to_numpy()) & (k2 == part.column("k2").to_numpy()))
                columns = [part.column(c).take(pa.array(own)) for c in ("rep", "root", "size", "copies")]
                yield pa.record_batch([*columns, pa.array([sets[i].tobytes() for i in own.tolist()], pa.binary())], ["rep", "root", "size", "copies", "set"])

    texts = docs.withColumn("_hash", F.xxhash64("text")).join(few, (F.col("_hash") == F.col("_text")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).select("rep", "root", "size", "copies", "k1", "k2", "text")
    sets = texts.mapInArrow(shingled, "rep long, root long, size double, copies long, set binary").dropDuplicates(["rep"])
    dealt = _dealt(sets, "root", "size", forest.block).drop("size").repartition(*keys).sortWithinPartitions(*keys, "rep")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, keys):
            reps, mine, p, q, copies = (table.column(c).to_numpy() for c in ("rep", "mine", "p", "q", "copies"))
            column = table.column("set")
            out: list[tuple[int, int, int, int]] = []
            for s, e in _runs(table, keys):
                left = np.flatnonzero(mine[s:e] == p[s]) + s
                right = np.flatnonzero(mine[s:e] == q[s]) + s
                load = lambda at: [np.frombuffer(column[int(i)].as_py(), np.uint64) for i in at]
                a = load(left)
                b = a if p[s] == q[s] else load(right)
                if not a or not b:
                    continue
                both = _common(a, b)
                size = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None] - both
                link = both >= threshold * size - 1e-9
                if p[s] == q[s]:
                    np.fill_diagonal(link, False)
                    names, near = reps[left], link
                    n, m = link.sum(1), link @ copies[left]
                else:
                    names = np.concatenate([reps[left], reps[right]])
                    near = np.block([[np.zeros((len(left),) * 2, bool), link], [link.T, np.zeros((len(right),) * 2, bool)]])
                    n = np.concatenate([link.sum(1), link.sum(0)])
                    m = np.concatenate([link @ copies[right], link.T @ copies[left]])
                root = {x: x for x in names.tolist()} | dict(_forest_links(names, near))
                out += [(x, root[x], int(i), int(j)) for x, i, j in zip(names.tolist(), n.tolist(), m.tolist(), strict=True) if i]
            yield pa.record_batch([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], ["rep", "root", "texts", "rows"])

    links = materialize(dealt.mapInArrow(verify, "rep long, root long, texts long, rows long"))
    final = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("_node"), F.col("root").alias("_class"))
    sums = links.groupBy(F.col("rep").alias("_rep")).agg(F.sum("texts").alias("_texts"), F.sum("rows").alias("_rows"))
    named = classes.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "rep", "_s", "copies")
    named = named.join(sums, F.col("rep") == F.col("_rep"), "left").join(final, F.col("rep") == F.col("_node"), "left").withColumn("_class", F.coalesce("_class", "rep"))
    # The row that stands for a whole group; groups of several classes only, so no group's classes meet in one task unsummed.
    heads = named.where("_class <> rep or _rep is not null").groupBy(F.col("_class").alias("_c")).agg(F.min("_s").alias("_head"))
    named = named.join(heads, F.col("_class") == F.col("_c"), "left").withColumn("_head", F.coalesce("_head", "_s"))
    named = materialize(named.select("_k1", "_k2", "_s", "_head", "copies", F.coalesce("_texts", F.lit(0)).alias("_texts"), F.coalesce("_rows", F.lit(0)).alias("_rows")))
    keyed = rows.select("doc_id", "text_hash", "n", "k1", "k2").join(named, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")) & (F.col("n") > 0), "left")
    head = F.col("_head.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("_head.text_hash") == F.col("text_hash"))
    return keyed.select(
        "doc_id",
        F.when(F.col("n") > 0, F.col("_head.doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(F.col("n") > 0, F.col("_s.doc_id")).otherwise(F.col("doc_id")).alias("copy_id"),
        F.coalesce("copies", F.lit(1)).alias("copies"),
        (F.coalesce("_rows", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
        F.coalesce("_texts", F.lit(0)).alias("n_texts"),
        "text_hash",
        F.coalesce(head, F.lit(True)).alias("first"),
    )
