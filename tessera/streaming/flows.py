"""Structured Streaming twins of the batch operators: usage totals, session budgets, sessions and deltas."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Kinds of usage that count.
EVENTS = ["view", "signup", "error", "click", "purchase"]


def usage(events: DataFrame, late: str | None = None) -> DataFrame:
    """(day, event_type, n, total) of valid events; late: watermark of a stream."""
    rows = events.where(F.col("event_type").isin(EVENTS) & F.col("ts").isNotNull())
    if late:
        rows = rows.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type")
        return rows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.to_date("window.start").alias("day"), "event_type", "n", "total")
    return rows.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(user_id, started, ended, n): events of a user with less than a gap between them."""
    rows = events.withWatermark("ts", late) if late else events
    grouped = rows.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return grouped.select("user_id", F.col("s.start").alias("started"), F.col("last").alias("ended"), "n")


def tumbling(events: DataFrame, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), "event_type", "n")


def budgets(events: DataFrame, budget: float) -> DataFrame:
    """(user_id, accepted, rejected, spent) by folding a user's costs in order of time: one that would exceed the budget is rejected and doesn't count.

    The fold depends on the order, so a user's events pass through one task; they are read as a sorted stream, and only three
    numbers of the current user are held. Null values cost nothing; a null user_id is a user like any other; no events: no rows.
    """

    rows = events.select(F.col("user_id").cast("bigint").alias("user_id"), "ts", "event_id", F.lit(False).alias("back"), F.col("value").cast("double").alias("cost"))
    return _folded(rows, budget, "double").select("user_id", F.col("taken").alias("accepted"), F.col("refused").alias("rejected"), "spent")


def with_rollback(events: DataFrame, budget: int) -> DataFrame:
    """(user_id, spent, steps, refused) of events (user_id, ts, event_id, back, cost) in order of time: a step back gives its cost back, never below nothing."""
    rows = events.select(F.col("user_id").cast("bigint").alias("user_id"), "ts", "event_id", "back", F.col("cost").cast("bigint").alias("cost"))
    return _folded(rows, budget, "bigint").select("user_id", "spent", F.col("taken").alias("steps"), "refused")


def _folded(rows: DataFrame, budget: float, kind: str) -> DataFrame:
    """Each user's rows in order of time, read as a sorted stream: what is spent, how many were taken and how many refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.float64() if kind == "double" else pa.int64(), pa.int64(), pa.int64())

        def out(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["user_id", "spent", "taken", "refused"])

        user, began, spent, taken, refused = None, False, 0, 0, 0
        for batch in batches:
            done = []
            for u, back, cost in zip(*(batch[c].to_pylist() for c in ("user_id", "back", "cost"))):
                if began and u != user:
                    done.append((user, spent, taken, refused))
                    spent, taken, refused = 0, 0, 0
                user, began, cost = u, True, cost or 0
                if back:
                    spent, taken = max(0, spent - cost), max(0, taken - 1)
                elif spent + cost <= budget:
                    spent, taken = spent + cost, taken + 1
                else:
                    refused += 1
            yield out(done)
        if began:
            yield out([(user, spent, taken, refused)])

    ordered = rows.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").select("user_id", "back", "cost")
    return ordered.mapInArrow(run, f"user_id bigint, spent {kind}, taken bigint, refused bigint")


def budget_stream(events: DataFrame, budget: float, late: str = "1 day") -> DataFrame:
    """The same over a stream: state holds what a user has spent, and goes once the watermark is a day past the user's last event."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        spent, accepted, rejected = state.get if state.exists else (0.0, 0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        last = int(rows["ts"].max().timestamp() * 1000)
        for cost in rows["value"].fillna(0.0):
            fits = spent + cost <= budget
            spent, accepted, rejected = spent + cost * fits, accepted + int(fits), rejected + int(not fits)
        state.update((spent, accepted, rejected))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 86_400_000)
        yield pd.DataFrame({"user_id": [key[0]], "accepted": [accepted], "rejected": [rejected], "spent": [spent]})

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(run, "user_id bigint, accepted bigint, rejected bigint, spent double", "spent double, accepted bigint, rejected bigint", "update", GroupStateTimeout.EventTimeTimeout)


def deltas(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that hands each micro-batch of a delta stream, in order, to apply(batch, number), which must be idempotent by number."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()
