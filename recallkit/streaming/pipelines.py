"""Structured Streaming forms of the stateful parts: idempotent intake, turn batches, priming, recall spacing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recallkit.config import DEFAULT, Settings
from recallkit.functions.text import fact_key


def intake(lines: DataFrame, time: str = "ts", delay: str = "1 hour", keys: tuple[str, ...] = ("channel_id", "ts", "role", "text")) -> DataFrame:
    """Transcript lines, each once within the watermark. The time column is cast to TIMESTAMP, which watermarks need."""
    return lines.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def claims(facts: DataFrame, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Facts whose (user, trimmed text) was not claimed within the watermark."""
    keyed = facts.withColumn("claim", fact_key(F.col("user_id"), F.col("text"))).withColumn(time, F.col(time).cast("timestamp"))
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["claim"])


def batches(turns: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """A channel's turns (channel_id, ts, user, assistant) in batches, given out as soon as they are full; the rest waits in the state."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, users, assistants = state.get if state.exists else (0, [], [])
        users, assistants = list(users), list(assistants)
        for pdf in parts:
            pdf = pdf.sort_values("ts", kind="stable")
            users += pdf["user"].str.slice(0, 2000).tolist()
            assistants += pdf["assistant"].str.slice(0, 3000).tolist()
        out = []
        while len(users) >= s.batch_size:
            out.append((key[0], number, users[: s.batch_size], assistants[: s.batch_size]))
            users, assistants, number = users[s.batch_size :], assistants[s.batch_size :], number + 1
        state.update((number, users, assistants))
        yield pd.DataFrame(out, columns=["channel_id", "batch", "users", "assistants"])

    schema = "channel_id long, batch int, users array<string>, assistants array<string>"
    return turns.groupBy("channel_id").applyInPandasWithState(run, schema, "batch int, users array<string>, assistants array<string>", "append", GroupStateTimeout.NoTimeout)


def priming(touches: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """What is primed in each (user_id, channel_id) after every micro-batch with touches of it: entity_id, touched, and until, when the touch expires (strictly).

    The state keeps the latest touch of the most recent entities, at most priming_max of them, as the batch form `graph.primed` does; those that the
    latest touch of the channel finds expired leave it, so the state is bounded.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = dict(zip(*state.get, strict=True)) if state.exists else {}
        for pdf in parts:
            for e, t in zip(pdf["entity_id"].tolist(), pdf["t"].tolist(), strict=True):
                last[e] = max(t, last.get(e, t))
        now = max(last.values())
        kept = sorted(((t, e) for e, t in last.items() if now - t < s.priming_ttl), key=lambda x: (-x[0], x[1]))[: s.priming_max]
        state.update(([e for _, e in kept], [t for t, _ in kept]))
        yield pd.DataFrame([(*key, e, t, t + s.priming_ttl) for t, e in kept], columns=["user_id", "channel_id", "entity_id", "touched", "until"])

    rows = touches.select("user_id", "channel_id", "entity_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"))
    schema = "user_id string, channel_id string, entity_id long, touched long, until long"
    return rows.groupBy("user_id", "channel_id").applyInPandasWithState(run, schema, "entities array<long>, times array<long>", "update", GroupStateTimeout.NoTimeout)


def spaced_recalls(events: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Recall events (fact_id, t epoch seconds) that come at least the interval behind the last accepted one of their fact."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, out = (state.get[0] if state.exists else None), []
        for t in sorted(t for pdf in parts for t in pdf["t"].tolist()):
            if last is None or t - last >= s.recall_interval:
                out.append((key[0], t))
                last = t
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["fact_id", "t"]).astype("int64")

    return events.groupBy("fact_id").applyInPandasWithState(run, "fact_id long, t long", "last long", "append", GroupStateTimeout.NoTimeout)
