"""The queue as streams: idempotent intake, running folds of attempts, stale locks by timers, batched sinks with a ledger."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def intake(new: DataFrame, late: str = "1 hour") -> DataFrame:
    """Jobs (natural_key, ts, ...) once each, within the time that a repeat may come late."""
    return new.withWatermark("ts", late).dropDuplicatesWithinWatermark(["natural_key"])


def windowed(events: DataFrame, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """Counts and sums of value by event type and time window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """A user's events without a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def after(state: tuple[str, int, float], event: str, cost, max_attempts: int) -> tuple[str, int, float]:
    """operators.queue.step() for one event of a stream."""
    status, attempts, spent = state
    if status == "pending" and event == "claim":
        return "running", attempts + 1, spent
    if event in ("complete", "fail"):
        spent += 0.0 if cost is None or pd.isna(cost) else float(cost)
    if event == "complete":
        return "done", attempts, spent
    if status == "running" and event == "release":
        return "pending", max(0, attempts - 1), spent
    if event == "fail" or (status == "running" and event == "reap"):
        return "dead" if attempts >= max_attempts else "pending", attempts, spent
    return status, attempts, spent


def folded(events: DataFrame, stale_ms: int = 900_000, max_attempts: int = 5, late: str = "1 hour") -> DataFrame:
    """Attempt events (job, id, event, cost, ts) folded to job, status, attempts, cost; a claim that stays without an answer is reaped by the watermark."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempts, cost, at = state.get if state.exists else ("pending", 0, 0.0, 0)
        if state.hasTimedOut:
            status, attempts, cost = after((status, attempts, cost), "reap", None, max_attempts)
        for row in pd.concat([*batches, pd.DataFrame(columns=["id", "event", "cost", "ts"])]).sort_values("id").itertuples():
            at = max(at, int(pd.Timestamp(row.ts).timestamp() * 1000))
            status, attempts, cost = after((status, attempts, cost), row.event, row.cost, max_attempts)
        state.update((status, attempts, cost, at))
        if status == "running":
            state.setTimeoutTimestamp(max(at + stale_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job": [key[0]], "status": [status], "attempts": [attempts], "cost": [cost]})

    keyed = events.withWatermark("ts", late).groupBy("job")
    return keyed.applyInPandasWithState(run, "job long, status string, attempts int, cost double", "status string, attempts int, cost double, at long", "update", GroupStateTimeout.EventTimeTimeout)


def batched_sink(write: Callable[[DataFrame, str], None], landed: Callable[[str], int], ledger: Callable[[str, int, str], None], delete: Callable[[str], None] | None = None, attempts: int = 3) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each micro-batch is one batch, named by its epoch, so a repeat is known.

    What has landed whole is not written again; what has landed in part is deleted first, where the store can. A write that fails is unknown until it is held against
    the store: landed whole it is committed, else it is rolled back and written again, `attempts` times at most.
    """

    def run(df: DataFrame, epoch: int) -> None:
        name, expected = f"epoch-{epoch}", df.count()
        for attempt in range(attempts):
            found = landed(name)
            if found == expected and (expected or attempt):
                ledger(name, expected, "committed")
                return
            if found and delete:
                delete(name)
            ledger(name, expected, "inflight")
            try:
                write(df, name)
            except Exception as e:
                ledger(name, expected, "unknown")
                if attempt + 1 == attempts and landed(name) != expected:
                    ledger(name, expected, "failed")
                    raise RuntimeError(f"{name} did not land in {attempts} attempts") from e
        ledger(name, expected, "committed" if landed(name) == expected else "partial")

    return run
