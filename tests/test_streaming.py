"""Streaming forms against what a batch gives."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from recallkit.config import Settings
from recallkit.streaming import pipelines as P


def drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def streamed(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    return spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")


def test_batches(spark, tmp_path):
    rows = [(c, t, f"u{t}", f"a{t}") for c in (1, 2) for t in range(7 if c == 1 else 2)]
    s = streamed(spark, tmp_path, rows, "channel_id long, ts long, user string, assistant string")
    got = drained(P.batches(s, Settings(batch_size=3)), "batches").orderBy("channel_id", "batch").collect()
    assert [(r.channel_id, r.batch, r.users) for r in got] == [(1, 0, ["u0", "u1", "u2"]), (1, 1, ["u3", "u4", "u5"])]


def test_spacing(spark, tmp_path):
    rows = [(1, t) for t in (0, 3600, 7 * 3600, 12 * 3600, 13 * 3600)] + [(2, 5)]
    got = drained(P.spaced_recalls(streamed(spark, tmp_path, rows, "fact_id long, t long")), "spaced").collect()
    assert sorted((r.fact_id, r.t) for r in got) == [(1, 0), (1, 7 * 3600), (1, 13 * 3600), (2, 5)]


def test_intake_and_claims(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(1, t, "user", "a"), (1, t, "user", "a"), (1, t, "user", "b")]
    s = streamed(spark, tmp_path, rows, "channel_id long, ts timestamp_ntz, role string, text string")
    assert drained(P.intake(s), "intake").count() == 2
    claimed = P.claims(s.withColumn("user_id", F.lit("u")))
    assert drained(claimed, "claimed").count() == 2


def test_priming(spark, tmp_path):
    """The same entities as the batch form: a touch lives its whole time, whatever windows it falls into, and at most the newest ones are kept."""
    from recallkit.operators import graph

    t = datetime(2024, 1, 1)
    rows = [("u", "c", 1, t), ("u", "c", 1, t + timedelta(minutes=29)), ("u", "c", 2, t), ("u", "c", 3, t + timedelta(minutes=31)), ("v", "c", 9, t), *[("v", "c", e, t + timedelta(seconds=e)) for e in range(10, 40)]]
    s = streamed(spark, tmp_path, rows, "user_id string, channel_id string, entity_id long, ts timestamp_ntz")
    got = {(r.user_id, r.entity_id, r.touched) for r in drained(P.priming(s), "primed", "update").collect()}
    touches = spark.createDataFrame(rows, "user_id string, channel_id string, entity_id long, ts timestamp_ntz").withColumn("t", F.unix_timestamp(F.col("ts").cast("timestamp")))
    want = set()
    for user in ("u", "v"):
        own = touches.where(F.col("user_id") == user)
        want |= {(r.user_id, r.entity_id, r.touched) for r in graph.primed(own, own.agg(F.max("t")).first()[0]).collect()}
    assert got == want and {e for u, e, _ in got if u == "u"} == {1, 3} and len(got) == 22
