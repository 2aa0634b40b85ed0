"""Each operator against brute force, and on every odd case."""

from __future__ import annotations

import hashlib
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H

from recallkit.operators import components
from recallkit.llm import bpe, exactsearch, linededup, lmscore, nearjoin, packing, qualityclassifier, qualityrules, queries, sharding, textvec, toxicity

DIR = "/root/testdata/sf0.001"
RANKS, WORDS = P.path(queries.BYTE_RANKS), P.path(queries.WORD_FILE)


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


def query(spark, name):
    return queries.QUERIES[name](spark, DIR).collect()


@pytest.fixture(scope="module")
def reference():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_query(spark, docs, reference):
    got = {r.doc_id: r for r in query(spark, "op1_byte_bpe")}
    assert got.keys() == docs.keys()
    for i, t in docs.items():
        ids = reference.encode_ordinary(t)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_bpe_odd(spark, reference):
    out = bpe.decode(bpe.encode(H.odd(spark), RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert len(out) == len(H.odd_rows())
    for r in out:
        assert bytes(r.decoded).decode() == (r.text or "") and (r.text is not None or r.ids == [])
    assert bpe.encode(H.empty(spark), RANKS, P.PATTERN).count() == 0


def test_bpe_long_texts_cut_safely(reference):
    c, rng = bpe.Codec(RANKS, P.PATTERN), random.Random(5)
    long = "".join(rng.choice(["a", " ", "  ", "\n", "'s ", "\x1c", "\xa0", "9", "!", "日 ", "don't "]) for _ in range(120_000))
    assert c.encode(long) == reference.encode_ordinary(long)
    run = "b" + " " * 5_000 + "x y" + "\n" * 5_000
    assert c._cut(bpe.CHUNK.findall(run)) == reference.encode_ordinary(run)
    huge = " " * 1_000_000 + "a"
    assert c.decode(c.encode(huge)) == huge.encode()


def test_near_query(spark, docs):
    classes, links = H.near(docs)
    got = {r.doc_id: r for r in query(spark, "op2_jaccard_join")}
    assert {i: r.class_id for i, r in got.items()} == classes and {i: r.n_links for i, r in got.items()} == links


def test_near_large_groups_in_blocks(spark):
    """Groups larger than a block: every link of every pair is found."""
    rng, base = random.Random(3), H.sentence(9, 120).split()
    texts = {}
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(1000)}"
        texts[i] = " ".join(w)
    texts |= {100 + i: H.sentence(50 + i, 40) for i in range(20)} | {200 + i: H.sentence(77, 30) for i in range(40)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = nearjoin.near_classes(df, nearjoin.Forest(block=8)).collect()
    classes, links = H.near(texts)
    assert {r.doc_id: r.class_id for r in got} == classes and {r.doc_id: r.n_links for r in got} == links


def test_near_odd(spark):
    got = nearjoin.near_classes(H.odd(spark)).collect()
    assert len(got) == len(H.odd_rows())
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert {r.class_id for i in (3, 4, 5) for r in by[i]} == {3} and len(by[3]) == 2 and by[4][0].copies == 4 and by[4][0].n_links == 4
    assert by[0][0].n_links == by[1][0].n_links == 0 and by[1][0].class_id == 1
    assert nearjoin.near_classes(H.empty(spark)).count() == 0


def test_forest_recall(spark):
    """Pairs just above the threshold, beside a crowd of near copies: every link is found, however soon nodes count as crowded."""
    f = nearjoin.Forest()
    assert f.floor <= f.prefix() < f.depth and f.trees * f.weight(f.prefix()) >= f.need > f.trees * f.weight(f.prefix() + 1)
    texts = {}
    for i in range(250):
        w = H.sentence(i, 60).split()
        texts[2 * i] = " ".join(w)
        w[20 + i % 20] = "other"
        texts[2 * i + 1] = " ".join(w)
    crowd = H.sentence(999, 90).split()
    texts |= {1000 + i: " ".join([*crowd[:40], f"x{i}", *crowd[40:]]) for i in range(80)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    classes, links = H.near(texts)
    assert sum(links.values()) >= 500 + 80 * 79
    for forest in (f, nearjoin.Forest(wide=4)):
        got = {r.doc_id: r for r in nearjoin.near_classes(df, forest).collect()}
        assert sum(got[i].n_links for i in texts) >= 0.999 * sum(links.values()) and all(got[i].n_links <= links[i] for i in texts)
        assert sum(got[i].class_id == classes[i] for i in texts) >= 0.995 * len(texts)


def test_forest_prefixes_are_shortened_by_what_is_crowded(spark):
    """Classes without company stop at the uniform prefix; a crowd's trees stay longer as far as the target allows; nodes cross the borders of ranges."""
    f = nearjoin.Forest()
    rng = np.random.default_rng(1)
    sigs = [rng.integers(0, 2**16, f.trees * f.depth).astype("<u2") for _ in range(40)]
    crowd = rng.integers(0, 2**16, f.trees * f.depth).astype("<u2")
    for k in range(300):  # all share five values of the first three trees, nothing else
        s = rng.integers(0, 2**16, f.trees * f.depth).astype("<u2")
        for t in range(3):
            s[t * f.depth : t * f.depth + 5] = crowd[t * f.depth : t * f.depth + 5]
        sigs.append(s)
    pair = sigs[0].copy()
    pair[[f.depth * t + 5 for t in range(f.trees)]] = 1  # shares five values with the first in every tree
    rows = [(i, s.tobytes(), 9) for i, s in enumerate([*sigs, pair])]
    classes = spark.createDataFrame(rows, "rep long, sig binary, n int").repartition(4)
    got = [(r.rep, r.node) for r in nearjoin.opened(nearjoin.tries(classes, f).cache(), f).collect()]
    size = {n: sum(m == n for _, m in got) for _, n in got}
    assert sum(size[n] == 2 for r, n in got if r == 0) == f.trees  # the pair meets in every tree
    assert max(size.values()) < 300  # no node of the crowd is opened: 17 trees at the floor reach the target
    assert {0, 340} <= {r for r, n in got if size[n] > 1} and sum(size[n] > 1 for r, n in got if r not in (0, 340)) < 20  # some of the crowd agree in a sixth value by chance
    few = nearjoin.Forest(trees=4, target=0.8)
    got = [(r.rep, r.node) for r in nearjoin.opened(nearjoin.tries(classes, few).cache(), few).collect()]
    assert max(sum(m == n for _, m in got) for _, n in got) == 300  # three of four trees crowded: the target needs them


def test_near_rows_without_id_or_with_one_id_for_two_texts(spark):
    a, b = H.sentence(1, 80), H.sentence(2, 80)
    rows = [(None, a + " x"), (None, a + " y"), (5, a), (1, a + " z"), (1, b), (3, b + " x"), (None, H.sentence(4, 50)), (None, H.sentence(4, 50) + " q"), (5, a)]
    got = nearjoin.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    links = sorted((r.doc_id or 0, r.n_links, r.class_id or 0) for r in got)
    assert links == sorted([(0, 4, 1), (0, 4, 1), (5, 4, 1), (5, 4, 1), (1, 4, 1), (1, 1, 1), (3, 1, 1), (0, 1, 0), (0, 1, 0)])
    assert sorted((r.doc_id or 0) for r in got if r.first) == [0, 1, 1]


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 600)] + [(700, k) for k in range(701, 760)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    want = {x: find(x) for x in list(parent) if find(x) != x}
    got = components.components(spark.createDataFrame(pairs, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == want


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(spark, law):
    df = H.odd(spark).withColumn("size", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long"))
    rows = sharding.shards(df, ["lang", "source", "n_chars"], 4, law).collect()
    assert len(rows) == len(H.odd_rows())
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(x.slot for x in s) == list(range(len(s))) for s in by.values())
    if law == "rows":
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sharding.shards(H.empty(spark).withColumn("size", F.lit(1)), ["lang"], 4).count() == 0


def test_shard_query(spark, docs):
    rows = query(spark, "op3_hilbert_shards")
    assert {r.doc_id for r in rows} == docs.keys()
    n = [sum(r.shard == s for r in rows) for s in range(8)]
    assert max(n) - min(n) <= 1 and all(sorted(r.slot for r in rows if r.shard == s) == list(range(n[s])) for s in range(8))
    for r in rows:
        assert r.size == len(docs[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) and r.grown_shard is None
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert all(a.curve <= b.curve for a, b in zip(order, order[1:], strict=False))


def test_shards_prune_by_every_dimension(spark):
    """Whole strings are ordered, so hosts that begin alike fall into different cells; a filter on any dimension meets fewer shards than in an order by hash."""
    rows = [(i, f"https://host{i % 40:02d}.example.org", "abcd"[i * 7 % 4], i * 37 % 1000) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, host string, lang string, n long").withColumn("size", F.lit(1))
    points = sharding.text_points(df, "host", 16)
    assert points == sorted(set(points)) and [k for k, _ in points] == list(range(1, 16))
    dims = ["host", "lang", "n"]
    shards = {"curve": [(r.shard, r) for r in sharding.shards(df, dims, 8).collect()], "hash": [(hash((r[0], 7)) % 8, dict(zip(df.columns, r, strict=False))) for r in rows]}

    def met(kind, d):
        ends = {}
        for shard, r in shards[kind]:
            lo, hi = ends.get(shard, (r[d], r[d]))
            ends[shard] = (min(lo, r[d]), max(hi, r[d]))
        values = {r[d] for _, r in shards[kind]}
        return sum(lo <= v <= hi for v in values for lo, hi in ends.values()) / len(values)

    by_hash, by_curve = ([met(kind, d) for d in dims] for kind in ("hash", "curve"))
    assert min(by_hash) > 7 and all(c < h for c, h in zip(by_curve, by_hash, strict=True)) and sum(by_curve) < 0.8 * sum(by_hash), (by_hash, by_curve)


@pytest.mark.parametrize(("bits", "dims"), [(1, 2), (2, 2), (4, 2), (3, 3), (2, 4)])
def test_curve_is_a_walk(bits, dims):
    """Every cell once, and neighbours on the curve are neighbours in space."""
    index = sharding.curve(bits, dims)
    assert sorted(index) == list(range(2 ** (bits * dims)))
    at = {h: [(c >> bits * (dims - 1 - d)) & (2**bits - 1) for d in range(dims)] for c, h in enumerate(index)}
    assert all(sum(abs(x - y) for x, y in zip(at[k], at[k + 1], strict=True)) == 1 for k in range(len(index) - 1))


def full_ids(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    return packing.WordTokenizer(WORDS), {x: library.encode(x, add_special_tokens=False).ids for x in texts}


def test_word_tokenizer(docs):
    hard = ["", " ", "It's  the 'S ÀÉ×÷ª", "x\x1c\x1cy! \x1c !\x85\n\n z", "<|endoftext|> a<|startoftext|>", "x'<|endoftext|>'s<|y", "a1b22'c--d...É.Ÿ ÀÁ,Þß(ÿ) 'tis '", "日本語 テ　x", "Ⅷ ﬁ Å Å İ ΑΣ ΑΣ.", "a" * 5000, "3.14 ½", "́ é x ß ẞ Straße ÿ", "👩‍👩‍👧", "don't'store we'll'd"]
    rng = random.Random(5)
    odd = [*"aZéÉß×÷'.-0 9\n\tÿÞ…日’İ", "<|endoftext|>"]
    hard += ["".join(rng.choices(odd, k=rng.randrange(1, 60))) for _ in range(300)]
    t, want = full_ids([*hard, *list(docs.values())[:60]])
    for _ in range(2):
        flat, begin = t.encode(textvec.Texts(__import__("pyarrow").array(list(want))))
        assert [flat[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)] == list(want.values())


def check_places(rows, tokens=4096):
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= tokens
    return len(seqs)


def test_packing_query(spark, docs):
    rows = query(spark, "op4_vector_packing")
    n = check_places(rows)
    assert n <= -(-sum(r.length for r in rows) // 4096) + 1
    _, want = full_ids(docs.values())
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in docs.items():
        ids = [*want[t], 1]
        cut = [ids[k : k + 4096] for k in range(0, len(ids), 4096)]
        got = sorted(by[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in got] == [(k, 4096 * k, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for k, c in enumerate(cut)]


def test_packing_odd(spark):
    cut = packing.pieces(H.odd(spark).drop("piece"), WORDS).cache()
    assert {r.doc_id: r.length for r in cut.where("doc_id < 3").collect()} == {0: 1, 1: 1, 2: 1}
    rows = packing.pack(cut).collect()
    check_places(rows)
    assert len(rows) == cut.count() and cut.count() > len(H.odd_rows())
    assert packing.pack(packing.pieces(H.empty(spark), WORDS)).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_vector_capacities(rule):
    """All three capacities hold, every piece has a place, and few sequences are used."""
    cap, rng = packing.Capacity(100, 4, 3000, (1.0, 0.3, 0.5), rule), random.Random(2)
    counts = {n: rng.randrange(1, 40) for n in range(1, 50)}
    used = {}
    for n, rank, placed, per, first, offset, slot in packing.plan(counts, cap):
        for k in range(placed):
            used.setdefault(first + k // per, []).append((slot + k % per, offset + (k % per) * n, n))
    assert sum(map(len, used.values())) == sum(counts.values())
    for items in used.values():
        items.sort()
        assert [i[0] for i in items] == list(range(len(items))) and len(items) <= 4
        assert [i[1] for i in items] == [sum(x[2] for x in items[:k]) for k in range(len(items))]
        assert sum(i[2] for i in items) <= 100 and sum(i[2] ** 2 for i in items) <= 3000
    least = max(sum(n * c for n, c in counts.items()) / 100, sum(counts.values()) / 4, sum(n * n * c for n, c in counts.items()) / 3000)
    assert len(used) <= 1.3 * least + 1
    with pytest.raises(ValueError):
        packing.plan({101: 1}, cap)


def test_capacities_from_the_data(docs):
    """The query's own setting: the document capacity binds without another sequence, and pieces go elsewhere than by tokens alone; a cost capacity binds where no piece is full."""
    t = packing.WordTokenizer(WORDS)
    _, begin = t.encode(textvec.Texts(__import__("pyarrow").array(list(docs.values()))))
    lengths = [min(4096, int(n) + 1 - k) for n in np.diff(begin) for k in range(0, int(n) + 1, 4096)]
    counts = {n: lengths.count(n) for n in lengths}
    cap, rows = packing.tightest(counts)
    alone = packing.plan(counts, packing.Capacity(weights=(1.0, 0.0, 0.0)))
    held = lambda plan: max(slot + per for _, _, _, per, _, _, slot in plan)
    assert packing.sequences(rows) <= packing.sequences(alone) and cap.documents < 4096 and held(rows) <= cap.documents and rows != alone
    short = {n: 9 for n in range(1, 1200, 7)}
    cap, rows = packing.tightest(short)
    assert cap.cost < 4096**2 and packing.sequences(rows) == packing.sequences(packing.plan(short, packing.Capacity(weights=(1.0, 0.0, 0.0))))
    assert packing.tightest({})[1] == [] and packing.sequences(packing.tightest({1: 3})[1]) == 1


def test_lines_query(spark, docs):
    want = H.kept_lines(list(docs.items()))
    for r in query(spark, "op5_line_dedup"):
        n, dropped, text = want[r.doc_id]
        assert (r.n_lines, r.n_dropped, r.kept_sha256) == (n, dropped, hashlib.sha256(text.encode()).hexdigest())


def test_lines_planted(spark):
    """Passages on many lines, bitmaps over several words, non-ASCII letters, and keys one short of the limits."""
    p, q, short = "Passage One ÀB " * 4, "x" * 40, "y" * 39
    texts = [(i, "\n".join([f"own {i}"] * (i * 13) + ["  " + p.upper() if i % 2 else p + "\t", q, short] + [f"{i} {k}" for k in range(150)] + [p])) for i in range(6)] + [(9, q + "\n" + p.replace("À", "à")), (10, None), (11, "")]
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in texts], "doc_id long, text string, kept string, n_lines string, other string")
    got = {r.doc_id: r for r in linededup.dedup_lines(df).collect()}
    for i, (n, dropped, text) in H.kept_lines(texts).items():
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept) == (n, dropped, text), i
    assert got[11].keep_bitmap is None and got[3].keep_bitmap
    assert all(b.bits != -1 for b in got[3].keep_bitmap) and [b.word for b in got[3].keep_bitmap] == [0, 3]  # words without dropped lines take no room
    same = linededup.reduce(df)
    assert same.columns == df.columns and {(r.kept, r.n_lines, r.other) for r in same.collect()} == {("a", "b", "c")}


def test_lines_hot_hashes_in_shares(spark):
    """Hashes that many documents hold are cut into shares and merged; the sort by document and position is part of the plan."""
    texts = [(i if i % 7 else None, "\n".join(["hot " * 20] * (1 + i % 2) + [f"rare {i % 40} " * 9, f"own {i}"])) for i in range(1, 400)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    lines = linededup.long_lines(df, "doc_id", "text", 40)
    assert len(linededup.frequent(lines)) >= 1
    plan = linededup.ranked(lines, linededup.frequent(lines))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning(_h") == 1 and "hashpartitioning" not in plan and plan.count("Sort [") == 1 and "_doc#" in plan[plan.index("Sort [") :].split("\n")[0] and "_at#" in plan[plan.index("Sort [") :].split("\n")[0]
    holders = {}
    for i, t in texts:
        for line in t.split("\n"):
            holders.setdefault(H.key(line), set()).add(i)
    want = []
    for i, t in texts:
        of = lambda x: holders[H.key(x)] - {None}
        kept = [x for x in t.split("\n") if not (len(H.key(x)) >= 40 and len(of(x)) >= 5 and max(of(x)) != i)]
        want.append((i, "\n".join(kept)))
    got = [(r.doc_id, r.text) for r in linededup.reduce(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_lines_odd(spark):
    got = linededup.dedup_lines(H.odd(spark)).collect()
    assert len(got) == len(H.odd_rows())
    assert all(r.n_dropped == 0 for r in got)
    assert linededup.dedup_lines(H.empty(spark)).count() == 0
    assert {r.text for r in linededup.reduce(H.odd(spark)).collect()} == {r[1] for r in H.odd_rows()}


def test_rules_query(spark, docs):
    for r in query(spark, "op8_quality_rules"):
        want = H.rule_counts(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and (not r.kept or not r.base_failed)


def test_rules_odd(spark):
    got = qualityrules.judge(H.odd(spark)).collect()
    text = {r[0]: r[1] for r in H.odd_rows()}
    assert len(got) == len(H.odd_rows())
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == H.rule_counts(text[r.doc_id]), r.doc_id
    assert not next(r for r in got if r.doc_id == 0).kept
    assert qualityrules.judge(H.empty(spark)).count() == 0


def test_rules_unknown_language_is_judged_by_the_known_ones(spark):
    """Documents of no known language have the mean of all known ones as their reference, never themselves."""
    prose = [(i, "en", f"the cat of house {i} and a dog went to the garden in rain, that is what it was for. " + H.sentence(i, 60)) for i in range(20)]
    strange = [(100, None, "### 12 %% 99 || <> 7 " * 30 + H.sentence(3, 60).upper()), (101, "xx", prose[0][2] + " more"), (102, None, None)]
    got = {r.doc_id: r for r in qualityrules.judge(spark.createDataFrame(prose + strange, "doc_id long, lang string, text string")).collect()}
    assert got[100].char_distance > 0.28 and got[101].char_distance < 0.1 and got[101].word_distance < 0.1 and got[102].char_distance is None
    alone = qualityrules.judge(spark.createDataFrame(strange, "doc_id long, lang string, text string")).collect()
    assert all(r.char_distance is None and r.word_distance is None for r in alone)


def test_distance(spark):
    rows = spark.createDataFrame([([0.5, 0.5], [0.5, 0.5]), ([1.0, 0.0], [0.0, 1.0]), (None, [1.0, 0.0])], "p array<double>, q array<double>")
    assert [r.d for r in rows.select(qualityrules.distance("p", "q").alias("d")).collect()] == [0.0, 1.0, None]


def test_rules_tell_junk(spark):
    """Shouted and symbol-laden texts go, prose stays."""
    rows = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang")
    junk = rows.where("length(text) > 800 and lang = 'en'").orderBy("doc_id").limit(8).select((F.col("doc_id") + 10**6).alias("doc_id"), F.regexp_replace("text", r"(\w+)", "$1%%%").alias("text"), "lang")
    got = qualityrules.judge(rows.unionByName(junk)).where("not base_failed")
    assert got.where("doc_id >= 1000000 and kept").count() == 0


def test_search_query(spark):
    rows = spark.read.parquet(f"{DIR}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.floor(256 * np.array([r.embedding for r in rows], np.float64)).astype(np.int64)
    want = []
    for k in np.flatnonzero(ids % 50 == 0):
        s = x @ x[k]
        top = [t for t in np.lexsort((ids, -s)) if ids[t] != ids[k]][:5]
        want += [(int(ids[k]), n + 1, int(ids[t]), int(s[t])) for n, t in enumerate(top)]
    assert sorted(tuple(r) for r in query(spark, "op9_pivot_search")) == sorted(want)


def test_search_odd(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [2.0, 1.0]), (3, None), (4, []), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [float("inf"), 0.0]), (8, [1.0]), (9, [1e9, -1e9]), (50, [1.0, 2.0]), (50, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    t = exactsearch.pivot_table(df).cache()
    got = exactsearch.top_k(t, t.where("vec_id = 50"), 3).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(0, 5), (1, 4), (2, 4)]
    big = exactsearch.top_k(t, t.where("vec_id = 9"), 1).first()
    assert (big.vec_id, big.score) == (1, 10**9)
    none = exactsearch.pivot_table(df.limit(0)).cache()
    assert exactsearch.top_k(none, none, 3).count() == 0


def test_search_many_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-40, 40, (300, 6)).astype(float)
    t = exactsearch.pivot_table(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<double>"), pivots=8).cache()
    got = {}
    for r in exactsearch.top_k(t, t.where("vec_id % 2 = 0"), 4, block=40, share=70).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in range(0, 300, 2):
        s = (x @ x[q]).astype(int)
        assert got[q] == [(int(k), int(s[k])) for k in np.lexsort((np.arange(300), -s)) if k != q][:4]


TOXIC = ("vile", "scumbag", "hateful")


def labelled(spark, n=600):
    rng, rows = random.Random(8), []
    for i in range(n):
        parts = [H.sentence(i * 31 + k, 8) + "." for k in range(12)]
        if i % 6 == 0:
            for _ in range(3):
                parts.insert(rng.randrange(len(parts)), H.sentence(rng.randrange(999), 4) + f" {rng.choice(TOXIC)}{rng.choice(['', 'ly', 'ness'])}!")
        rows.append((i, " ".join(parts), int(i % 6 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "toxic", (1 - F.col("toxic")).alias("quality"))


def test_toxicity_held_out_and_spans(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    assert len(got) > 100 and all((r.score >= 0.3) == (r.toxic == 1) for r in got) and all(0 <= r.score <= 1 for r in got)
    for r in toxicity.spans(docs.where("doc_id < 30"), model).collect():
        assert all(r.text.lower().encode()[x.start : x.start + x.length].decode().strip() == x.sentence for x in r.offending)
        assert all(any(w in s.sentence for w in TOXIC) for s in r.offending) and bool(r.offending) == (r.doc_id % 6 == 0)


def test_toxicity_query_against_plain_noisy_or(spark, docs):
    """The query's scores and spans from its own model's weights, sentence by sentence."""
    import re

    import pyarrow as pa

    model = toxicity.train(spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet"))
    assert len(model.names) > 0 and (np.diff(model.names.astype(object)) > 0).all()
    weight = dict(zip(model.names.tolist(), model.weights.tolist(), strict=True))

    def key(part: bytes) -> int:
        t = textvec.Texts(pa.array([part.decode("latin-1")]))
        t.data, t.offsets = np.frombuffer(part, np.uint8), np.array([0, len(part)])
        return int(t.hash(np.array([0]), np.array([len(part)]))[0])

    got = {r.doc_id: r for r in query(spark, "op10_noisy_or_toxicity")}
    for i in sorted(docs)[::5]:
        data, at, left, spans = docs[i].lower().encode(), 0, 1.0, []
        for sentence in re.findall(rb"[^.!?\n]*[.!?\n]|[^.!?\n]+$", data):
            parts = set()
            for w in re.findall(rb"[a-zA-Z0-9\x80-\xff]+", sentence):
                parts |= {key(w), *(key(w[:k]) ^ (k << 40) for k in toxicity.PREFIXES if len(w) > k)}
            if parts:
                p = 1 / (1 + np.exp(-model.bias - sum(weight.get(x, 0.0) for x in parts)))
                left *= 1 - p
                spans += [(at, len(sentence), round(p, 6))] if p >= 0.3 else []
            at += len(sentence)
        assert abs(got[i].score - (1 - left)) < 1e-9 and got[i].predicted == int(1 - left >= 0.3)
        assert sorted((x.start, x.length) for x in got[i].offending) == sorted(x[:2] for x in spans)


def test_toxicity_gradient():
    """The noisy-or's gradient against differences of its loss, and the penalty's choice: weights of words without a meaning stay out."""
    rng = np.random.default_rng(3)
    x = np.hstack([rng.integers(0, 2, (40, 3)).astype(float), np.ones((40, 1))])
    data = (x, np.sort(rng.integers(0, 12, 40)), rng.integers(0, 5, 12), rng.integers(0, 2, 12) > 0, np.array([0.1, 0.1, 0.1, 0.0]))
    theta = np.array([0.5, -0.3, 0.2, -1.0])
    _, z, total = toxicity.loss(theta, *data)
    steps = [(toxicity.loss(theta + 1e-6 * e, *data)[0] - toxicity.loss(theta - 1e-6 * e, *data)[0]) / 2e-6 for e in np.eye(4)]
    assert np.allclose(toxicity.gradient(theta, *data, z, total), steps, rtol=1e-4)
    texts = [H.sentence(i, 30) + ". " + H.sentence(i + 7, 9) + (" horrid" if i % 5 == 0 else " lovely") + " common words here." for i in range(300)]
    model = toxicity.fit(texts, np.array([float(i % 5 == 0) for i in range(300)]))
    assert 1 <= len(model.names) < 60
    plain = model.scores(textvec.Texts(__import__("pyarrow").array(["a horrid day", "a lovely day", "common words here"])))
    assert plain[0] > 0.5 > 0.1 > max(plain[1:])


def test_toxicity_sample_is_bounded_by_rows_and_bytes(spark):
    from recallkit.llm.labelled import labelled_texts

    docs = spark.createDataFrame([(i, "x" * (10 if i else 1000), "c") for i in range(20)] + [(3, "x" * 10, "c"), (4, None, "c")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    texts, toxic = labelled_texts(docs, labels, "toxic", 100, 10_000)
    assert len(texts) == 20 and len(toxic) == 20
    assert len(labelled_texts(docs, labels, "toxic", 7, 10_000)[0]) == 7
    texts, _ = labelled_texts(docs, labels, "toxic", 100, 105)
    assert len(texts) == 10 and max(map(len, texts)) == 10
    assert labelled_texts(docs.limit(0), labels, "toxic", 9, 99)[0] == []


def test_toxicity_odd(spark):
    docs, labels = labelled(spark, 200)
    model = toxicity.train(docs, labels.unionByName(spark.createDataFrame([(None, 1, 0), (5, None, 0), (10**9, 1, 0)], labels.schema)))
    got = toxicity.score(H.odd(spark), model).collect()
    assert len(got) == len(H.odd_rows()) and all(r.score == 0 for r in got if not r.text)
    assert toxicity.score(H.empty(spark), model).count() == 0
    blank = toxicity.train(docs, labels.limit(0))
    assert all(r.score < 1e-9 for r in toxicity.score(docs.limit(5), blank).collect())


def test_toxicity_uses_no_held_out_label(spark):
    docs, labels = labelled(spark, 200)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_quality_query(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    rows = [r for r in query(spark, "op6_quality_classifier") if r.doc_id in labels]
    assert sum(r.good == (labels[r.doc_id] == 1) for r in rows) >= 0.95 * len(rows)


def test_quality_query_against_brute_force(spark, docs):
    """Evidence, shrunken sites and posterior of every row, from the query's own document model."""
    import pyarrow as pa

    tables = [spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels")]
    model = qualityclassifier.train(*tables)
    rows = tables[0].select("doc_id", "source", "lang").collect()
    e = {r.doc_id: float(model.scores(textvec.Texts(pa.array([docs[r.doc_id]])))[0]) for r in rows}
    mean = min(max(sum(e.values()) / len(e), 1e-3), 1 - 1e-3)
    hosts, paths = {}, {}
    for r in rows:
        hosts.setdefault(r.source, []).append(e[r.doc_id])
        paths.setdefault((r.source, r.lang), []).append(e[r.doc_id])

    def strength(groups, centre):
        spread = (sum(len(v) * (sum(v) / len(v) - centre[k]) ** 2 for k, v in groups.items()) - (len(groups) - 1) * mean * (1 - mean)) / len(e)
        return min(max(mean * (1 - mean) / max(spread, 1e-9), 1.0), 1e6)

    a = strength(hosts, dict.fromkeys(hosts, mean))
    host = {k: (sum(v) + a * mean) / (len(v) + a) for k, v in hosts.items()}
    b = strength(paths, {k: host[k[0]] for k in paths})
    path = {k: (sum(v) + b * host[k[0]]) / (len(v) + b) for k, v in paths.items()}
    logit = lambda p: np.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    got = {r.doc_id: r for r in query(spark, "op6_quality_classifier")}
    assert got.keys() == e.keys()
    for r in rows:
        q = 1 / (1 + np.exp(-(logit(e[r.doc_id]) + logit(path[r.source, r.lang]) - logit(mean))))
        x = got[r.doc_id]
        assert np.allclose([x.evidence, x.host_quality, x.path_quality, x.quality], [e[r.doc_id], host[r.source], path[r.source, r.lang], q], atol=1e-5) and (x.good == (q >= 0.4) or abs(q - 0.4) < 1e-5)


def test_quality_shrinks_sparse_sites(spark):
    """A site of one poor page moves little from its prior, one of many poor pages moves far."""
    rows = [("big", "p", 0.1)] * 400 + [("small", "p", 0.1)] + [("good", "p", 0.95)] * 2000 + [(None, None, 0.9)] * 5
    sites = {r._host: r for r in qualityclassifier.posteriors(spark.createDataFrame(rows, "host string, path string, evidence double"), "host", "path").collect()}
    mean = sites["big"].global_quality
    assert abs(sites["big"].path_quality - 0.1) < 0.05 < abs(sites["small"].path_quality - 0.1) and sites["big"].path_quality < sites["small"].path_quality < mean
    assert None in sites


def test_quality_odd(spark):
    docs, labels = labelled(spark, 120)
    model = qualityclassifier.train(docs, labels)
    got = qualityclassifier.judge(H.odd(spark), model).collect()
    assert len(got) == len(H.odd_rows()) and all(0 <= r.quality <= 1 for r in got)
    assert qualityclassifier.judge(H.empty(spark), model).count() == 0
    blank = qualityclassifier.train(docs, labels.limit(0))
    assert all(r.good for r in qualityclassifier.judge(H.odd(spark), blank).collect())


def prose(n, seed=0):
    """Texts in which a word depends on its neighbours: chains through pairs of a few words, with rare words between them."""
    rng = random.Random(seed)
    follow = {k: [(5 * k + j) % 40 for j in (1, 2, 3)] for k in range(40)}
    out = []
    for i in range(n):
        k, words = rng.randrange(40), []
        for _ in range(80):
            words.append(f"rare{seed}x{rng.randrange(10**9)}" if rng.random() < 0.2 else f"w{k}")
            k = rng.choice(follow[k])
        out.append((i, " ".join(words)))
    return out


def test_lm_gradients():
    """Of all parameters against differences of the loss, and a softmax in two levels that sums to 1."""
    rng = np.random.default_rng(4)
    net = lmscore.Net(100, width=5)
    for k in net.NAMES:
        setattr(net, k, getattr(net, k).astype(np.float64))
    near, t = rng.integers(0, 165, (30, 4)), rng.integers(1, 165, 30)
    every = np.arange(1, 165)
    assert np.exp(net.run(np.repeat(near[:1], 164, 0), every)[0]).sum() == pytest.approx(1, abs=1e-4)
    _, g = net.run(near, t, True)
    embed = np.zeros_like(net.embed)
    for side in range(4):
        np.add.at(embed[side], g["near"][:, side], g["hidden"])
    exact = lambda: -sum(float(x) for x in net.run(near, t)[0].astype(np.float64))
    for k in net.NAMES:
        values, d = getattr(net, k), embed if k == "embed" else g[k]
        for at in rng.choice(values.size, min(12, values.size), replace=False):
            i = np.unravel_index(int(at), values.shape)
            old = values[i]
            if k == "member_bias" and old < -15:
                continue  # places without a token
            up, down = [], []
            for step, keep in ((1e-2, up), (-1e-2, down)):
                values[i] = old + step
                keep.append(exact())
            values[i] = old
            assert (up[0] - down[0]) / 2e-2 == pytest.approx(float(d[i]), rel=0.02, abs=2e-3), (k, i)


def test_lm_learns_from_both_sides(spark):
    """Held-out texts are likelier by the trained network than by the frequencies it starts from; twice the corpus gives twice the windows."""
    df = spark.createDataFrame(prose(400), "_row long, text string").repartition(3)
    tokens, counts, sizes = lmscore.vocabulary(lmscore.word_counts(df, "text").cache(), 2000)
    v = len(tokens.words)
    assert 38 <= v <= 40 and counts.sum() == 400 * 80 and sizes.max() > 1000
    new = lmscore.encoded(spark.createDataFrame(prose(60, 1), "_row long, text string"), tokens)
    score = lambda net: sum(r.l for r in lmscore.net_sums(new, net).collect()) / (60 * 80)
    start = score(lmscore.Net(v, counts=counts))
    trained = score(lmscore.train(lmscore.encoded(df, tokens).cache(), lmscore.Net(v, counts=counts), every=1, batch=128))
    assert trained > start + 0.3


def test_lm_query_against_brute_force(spark):
    """Every column from the network's own log-probabilities, token by token, and plain counts of words between neighbours."""
    import math
    from collections import Counter

    import pyarrow as pa

    texts = [(i, t) for i, t in prose(40)] + [(100, prose(1)[0][1]), (101, None), (102, ""), (103, "one"), (103, "one"), (104, "Ünder 12,5 % ...")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = lmscore.pseudo_likelihood(df, most=30).collect()
    rows = df.withColumn("_row", F.xxhash64(F.coalesce("text", F.lit(""))))
    tokens, counts, sizes = lmscore.vocabulary(lmscore.word_counts(rows, "text").cache(), 30)
    net = lmscore.train(lmscore.encoded(rows, tokens).cache(), lmscore.Net(len(tokens.words), counts=counts))
    seen, total, n = [], {}, {}
    for text in [t or "" for _, t in texts]:
        t, first, _ = tokens.read(*lmscore._both(pa.array([text])))
        padded, words = [0, 0, *t.tolist(), 0, 0], ["", *text.split(), ""]
        logs = [float(net.run(np.array([[padded[k + 2 + s] for s in lmscore.SIDES]]), t[k : k + 1])[0][0]) for k in range(len(t))]
        total[text], n[text] = sum(logs), len(t)
        seen += [(text, words[k].lower(), words[k + 1].lower(), words[k + 2].lower(), c) for k, c in enumerate(t.tolist()) if c <= lmscore.SHAPES]
    there, times = Counter((a, b, c) for _, a, _, b, c in seen), Counter((a, w, b, c) for _, a, w, b, c in seen)
    repeats = Counter(t or "" for _, t in texts)
    for text, a, w, b, c in seen:
        p = (times[a, w, b, c] - 1 + 1 / sizes[c - 1]) / (there[a, b, c] - 1 + 1)
        total[text] += math.log(p) / repeats[text]
    by = {}
    for r, t in [(r, dict(texts)[r.doc_id] or "") for r in got]:
        by.setdefault(r.doc_id, r)
        assert r.n_tokens == n[t] and r.log_likelihood == pytest.approx(total[t], rel=2e-3, abs=0.05) and (r.perplexity is None) == (n[t] == 0)
    # A text that occurs twice in the corpus, under two ids, comes apart from all others.
    plain = [by[i].mean_log_probability for i in range(1, 40)]
    assert min(by[0].mean_log_probability, by[100].mean_log_probability) > max(plain) + 0.5


def test_lm_odd(spark):
    got = lmscore.pseudo_likelihood(H.odd(spark)).collect()
    assert len(got) == len(H.odd_rows()) and all((r.perplexity is None) == (r.n_tokens == 0) and r.log_likelihood <= 0 for r in got)
    for r in got:
        assert r.n_tokens == len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", r.text or "") if w])
    assert lmscore.pseudo_likelihood(H.empty(spark)).count() == 0


def test_texts_slices_and_offsets():
    import pyarrow as pa

    whole = pa.array(["zz", "a b", None, "", "b  a\n", "é"])
    t, u = textvec.Texts(whole.slice(1)), textvec.Texts(pa.array(["a b", "", "", "b  a\n", "é"]))
    s, e, first = t.words()
    assert first.tolist() == [0, 2, 2, 2, 4, 5] and (t.hash(s, e) == u.hash(*u.words()[:2])).all()
    h = t.hash(s, e)
    assert h[0] == h[3] and h[1] == h[2] and len(set(h.tolist())) == 3


def test_lm_learns_from_every_window(spark):
    """After training by default, the embeddings of all neighbours in all windows have moved, wherever in a text they stand."""
    import pyarrow as pa

    text = " ".join(f"w{k}" for k in range(23))
    df = spark.createDataFrame([(1, text)], "_row long, text string").repartition(1)
    own = np.sort(np.array([(h & lmscore.WORD).view(np.int64) for h in lmscore.Tokens(np.zeros(0, np.int64), np.zeros(0, np.int64)).read(*lmscore._both(pa.array([text])))[2]]))
    tokens = lmscore.Tokens(own, 1 + lmscore.SHAPES + np.arange(23))
    t, first, _ = tokens.read(*lmscore._both(pa.array([text])))
    start = lmscore.Net(23)
    moved = (lmscore.train(lmscore.encoded(df, tokens), lmscore.Net(23)).embed != start.embed).any(2)
    near = lmscore.windows(t, first)
    assert len(set(t.tolist())) == 23 and all(moved[side, near[k, side]] for k in range(23) for side in range(4))


@pytest.mark.parametrize("scale", [0.1, 40.0])  # logits within bounds, and beyond what exp holds in 32 bits
def test_lm_softmax_of_all_groups_at_once(monkeypatch, scale):
    """Log-probabilities against plain ones in 64 bits; a batch costs two softmaxes, however many groups its words are in."""
    rng = np.random.default_rng(8)
    net, calls, soft = lmscore.Net(1000, width=6), [], lmscore.Net.soft
    for k in net.NAMES:
        if "bias" not in k:
            setattr(net, k, rng.normal(0, scale, getattr(net, k).shape).astype(np.float32))
    near, t = rng.integers(0, 1065, (500, 4)).astype(np.uint16), rng.integers(1, 1065, 500).astype(np.uint16)
    monkeypatch.setattr(lmscore.Net, "soft", staticmethod(lambda *a: calls.append(1) or soft(*a)))
    got, g = net.run(near, t, True)
    assert len(calls) == 2
    h = np.tanh(net.base + sum(net.embed[k][near[:, k]] for k in range(4))).astype(np.float64)
    group, place = net.places(t)

    def plain(z: np.ndarray) -> np.ndarray:
        z = z - z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    outer = plain(h @ net.group + net.group_bias)
    inner = plain(np.einsum("nw,nwm->nm", h, net.member[group]) + net.member_bias[group])
    assert np.allclose(got, outer[range(500), group] + inner[range(500), place], rtol=1e-4, atol=1e-3) and len(set(group.tolist())) == 17
    assert np.isfinite(got).all() and all(np.isfinite(x).all() for x in g.values())
    assert (net.run(near, t)[0] == got).all()


def test_toxicity_fit_keeps_driver_memory_small():
    """Working memory of the choice of features is far below the pairs of sentences and features; the cuts between sentences cover all pairs."""
    import tracemalloc

    n, rng = 200_000, np.random.default_rng(2)
    row, col = np.repeat(np.arange(n, dtype=np.int32), 20), rng.integers(0, 500, 20 * n).astype(np.int32)
    bags = toxicity.Bags(np.arange(n) // 20, row, col, np.arange(500, dtype=np.uint64), np.arange(n // 20) % 10 == 0)
    tracemalloc.start()
    try:
        left, w, _ = toxicity.chosen(bags, 1e6, epochs=1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(left.names) == len(w) == 0 and peak < 6 * len(row), peak  # one number in 64 bits for each pair would be 8
    cuts = bags.spans(1000)
    assert [c[0] for c in cuts[1:]] == [c[1] for c in cuts[:-1]] and cuts[-1][1] == n and cuts[-1][3] == len(row) and max(c[3] - c[2] for c in cuts) <= 1000
