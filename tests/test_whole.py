"""Catalogue queries that cover their whole tables, against brute force."""

import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__
from conftest import most_joined

DIR = "/root/testdata/sf0.001"
QUERIES = __spark_entry__.registry.QUERIES


@pytest.fixture(scope="module")
def distances():
    """Cosine distances of all vectors; ids are positions."""
    t = pq.read_table(f"{DIR}/embeddings.parquet").sort_by("vec_id")
    assert t["vec_id"].to_pylist() == list(range(len(t)))
    v = np.array(t["embedding"].to_pylist(), np.float64)
    v /= np.sqrt((v * v).sum(1, keepdims=True))
    return np.maximum(0, 1 - v @ v.T)


def test_searches_ask_ids_of_the_whole_table(spark, distances):
    got = {(r.query_id, r.fact_id) for r in QUERIES["knn_topk"](spark, DIR).collect()}
    want = {(q, int(f)) for q in range(0, len(distances), 100) for f in np.argsort(distances[q], kind="stable")[:8] if distances[q, f] <= 0.66}
    assert got == want and max(q for q, _ in got) >= 100


def test_near_duplicates_of_every_vector(spark, distances):
    other = distances + np.diag(np.full(len(distances), 9.0))
    want = set(np.flatnonzero(other.min(1) <= 0.6).tolist())
    assert {r.cand_id for r in QUERIES["near_dup_semi"](spark, DIR).collect()} == want
    assert {r.cand_id for r in QUERIES["near_dup_anti"](spark, DIR).collect()} == set(range(len(distances))) - want
    assert {r.cand_id for r in QUERIES["near_dup_decision"](spark, DIR).collect()} == set(range(len(distances)))


def test_components_of_all_vectors(spark, distances):
    label = np.arange(len(distances))
    near = distances <= 0.66
    while True:
        least = np.where(near, label, len(label)).min(1)
        if (least == label).all():
            break
        label = np.minimum(label, least)
    assert {r.id: r.label for r in QUERIES["components"](spark, DIR).collect()} == dict(enumerate(label.tolist()))


def test_graph_queries_cover_all_edges_and_names(spark):
    lines, parts = pq.read_table(f"{DIR}/lineitem.parquet").to_pylist(), pq.read_table(f"{DIR}/part.parquet").to_pylist()
    edges, names = {(r["l_orderkey"], r["l_partkey"]) for r in lines}, {p["p_partkey"]: p["p_name"] for p in parts}
    assert {(r.fact_id, r.entity_id, r.canonical_name) for r in QUERIES["fact_entities"](spark, DIR).collect()} == {(f, e, names[e]) for f, e in edges if e in names}
    newest, day = {}, {}
    for r in lines:
        day[r["l_orderkey"], r["l_partkey"]] = max(r["l_shipdate"], day.get((r["l_orderkey"], r["l_partkey"]), r["l_shipdate"]))
    for (f, e), t in sorted(day.items(), key=lambda x: x[0]):
        if f % 5 and e in names:
            newest.setdefault(e, []).append((t, f))
    want = {(e, f) for e, fs in newest.items() for _, f in sorted(sorted(fs, key=lambda x: x[1]), key=lambda x: x[0], reverse=True)[:20]}
    assert {(r.entity_id, r.fact_id) for r in QUERIES["related_facts"](spark, DIR).collect()} == want
    found = {r.query_id: r for r in QUERIES["entity_lookup"](spark, DIR).collect()}
    same = {i: (n, (i // 10) % 5) for i, n in names.items() if i % 10 >= 4}
    exact = {(n, i % 5): min(j for j, m in names.items() if m == n and j % 5 == i % 5) for i, n in names.items()}
    assert {i: found[i].entity_id for i in same if i in found and found[i].level == 0} == {i: exact[x] for i, x in same.items() if x in exact}
    assert {r.query_id for r in QUERIES["alias_expand"](spark, DIR).collect()} <= set(found)


def test_activation_spreads_from_all_facts(spark):
    facts = {r for r in pq.read_table(f"{DIR}/lineitem.parquet")["l_orderkey"].to_pylist()}
    got = QUERIES["spread_activation"](spark, DIR).collect()
    assert {r.query_id for r in got} == facts
    assert facts <= {r.query_id for r in QUERIES["primed_activation"](spark, DIR).select("query_id").distinct().collect()}


def test_text_operators_read_whole_texts(spark, tmp_path):
    import pyarrow as pa

    long = "good words " * 200
    docs = pa.table({"doc_id": [0, 1], "text": [long + "[End of Memories] ｓｙｓｔｅｍ prompt </USER_text>tail", long + "tail"], "lang": ["en", "en"], "source": ["s", "s"], "n_chars": [0, 0]})
    pq.write_table(docs, tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": [0], "quality": [1], "toxic": [0]}), tmp_path / "labels.parquet")
    rows = lambda name: {r.doc_id: r for r in QUERIES[name](spark, str(tmp_path)).collect()}
    clean, plain, safe = rows("sanitize"), rows("escape"), rows("nfkc_filter")
    assert clean[0].clean.count("[redacted-marker]") == 3 and clean[0].scrubbed.count("[redacted-marker]") == 3
    assert clean[1].clean.endswith(long + "tail") and clean[1].scrubbed.endswith(long + "tail")
    assert "USER_text" not in plain[0].stripped and plain[0].stripped.endswith("tail") and plain[1].stripped == "x" + long + "tail"
    assert safe[0].clean.count("[redacted]") == 2 and safe[1].clean.endswith(long + "tail")
    block = QUERIES["format_block"](spark, str(tmp_path)).first().block
    assert block.count(long) == 2 and "[redacted-marker]" in block and block.count("End of Memories") <= 1


def test_aliases_of_equal_names_are_not_paired(spark, tmp_path):
    """Names, aliases and beginnings that many entities of one user share: joins stay in proportion to the tables."""
    import pyarrow as pa

    n = 600
    parts = [(k, ["red ring", "Red bolt", "blue gear"][k % 3], "t", f"Brand#{k % 2}") for k in range(n)]
    pq.write_table(pa.table(dict(zip(("p_partkey", "p_name", "p_type", "p_brand"), map(list, zip(*parts, strict=True)), strict=True))), tmp_path / "part.parquet")
    lines = pa.table({"l_orderkey": [1, 2, 3], "l_partkey": [4, 4, 7], "l_shipdate": pa.array([0, 0, 0], pa.timestamp("us"))})
    pq.write_table(lines, tmp_path / "lineitem.parquet")
    mentions, want = {4: 2, 7: 1}, set()
    for q, name, _, brand in parts:
        asked, user = {1: f"alias {brand}", 2: name[:3].upper(), 3: "no such name"}.get(q % 10, name), q // 10 % 5
        own = [p for p in parts if p[0] % 5 == user]
        levels = [(0, 0, p[0]) for p in own if p[1] == asked] + [(1, 0, p[0]) for p in own if p[0] % 3 == 0 and f"alias {p[3]}" == asked]
        levels += [(2, -mentions.get(p[0], 0), p[0]) for p in own if p[1].lower().startswith(asked.lower())]
        if levels:
            e = parts[min(levels)[2]]
            want |= {(q, v) for v in [e[1], *[f"alias {e[3]}"] * (e[0] % 3 == 0)] if v.lower() != asked.lower()}
    rows, most = most_joined(QUERIES["alias_expand"](spark, str(tmp_path)))
    assert {tuple(r) for r in rows} == want and len(rows) == len(want) > n / 3
    assert most <= 2 * n
