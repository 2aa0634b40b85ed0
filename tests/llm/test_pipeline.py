"""The pipeline's stages, each on its own input, against brute force."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline as C
import helpers as H
from test_operators import check_places

from recallkit.session import materialize

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{DIR}/documents.parquet"), []
    for name, f in C.STAGES:
        after = materialize(f(spark, docs, DIR))
        out.append((name, docs, after))
        docs = after
    return out


def test_columns_and_order(stages):
    assert [s[0] for s in stages] == ["toxicity", "quality classifier", "line dedup", "n-gram Jaccard join", "best-fit packing"]
    for _, before, after in stages[:-1]:
        assert before.columns == after.columns


def test_toxicity_stage(spark, stages):
    """Exactly the rows that a sentence-by-sentence noisy-or of the stage's model leaves below 0.3."""
    import numpy as np
    import pyarrow as pa

    from recallkit.llm import textvec, toxicity

    _, before, after = stages[0]
    model = toxicity.train(before, spark.read.parquet(f"{DIR}/labels.parquet"))
    want = set()
    for r in before.collect():
        parts = "".join(c if c not in ".!?\n" else "\0" for c in (r.text or "").lower()).split("\0")
        loss = model.sentences(textvec.Texts(pa.array(parts)))[0]
        if 1 - np.exp(-loss.sum()) < 0.3:
            want.add(r.doc_id)
    assert {r.doc_id for r in after.collect()} == want and after.exceptAll(before).count() == 0


def test_quality_stage(spark, stages):
    """Exactly the rows that `judge` calls good, which tests/llm/test_operators.py holds against brute force."""
    from recallkit.llm import qualityclassifier

    _, before, after = stages[1]
    rows = qualityclassifier.judge(before, qualityclassifier.train(before, spark.read.parquet(f"{DIR}/labels.parquet"))).collect()
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in rows if r.quality >= 0.4) and 0.7 * len(rows) <= after.count()
    assert after.exceptAll(before).count() == 0


def test_lines(stages):
    _, before, after = stages[2]
    want = H.kept_lines([(r.doc_id, r.text) for r in before.collect()])
    assert {r.doc_id: r.text for r in after.collect()} == {i: w[2] for i, w in want.items()}


def test_near(stages):
    _, before, after = stages[3]
    classes, _ = H.near({r.doc_id: r.text for r in before.collect()})
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, c in classes.items() if c == i)


def test_packing(stages):
    _, before, after = stages[4]
    rows = after.collect()
    check_places(rows)
    assert {r.doc_id for r in rows} == {r.doc_id for r in before.collect()}


def test_run_is_the_stages(spark, stages):
    got = C.run(spark, DIR)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert got.select(*cols).exceptAll(stages[-1][2].select(*cols)).count() == 0 and got.count() == stages[-1][2].count()


CLASHES = ("toxic", "quality", "score", "evidence", "good", "kept", "n_lines", "n_dropped", "keep_bitmap", "class_id", "first", "text_hash", "_row", "_text", "_doc", "row", "length", "piece", "label")


@pytest.mark.parametrize("k", range(5))
def test_odd_tables(spark, k):
    """Nulls, long and empty texts, repeated rows, an empty table, and a caller's columns with the names that stages use, which come back as they were."""
    from pyspark.sql import functions as F

    name, f = C.STAGES[k]
    docs = H.odd(spark).select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHES])
    out = f(spark, docs, DIR)
    assert name == "best-fit packing" or out.columns == docs.columns
    rows = out.collect()
    assert 0 < len(rows) <= docs.count() * 20
    if name != "best-fit packing":
        assert all(r[c] == f"{c} {'-' if r.doc_id is None else r.doc_id}" for r in rows for c in CLASHES)
    assert f(spark, docs.limit(0), DIR).count() == 0

