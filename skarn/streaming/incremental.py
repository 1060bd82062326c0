"""Incremental processing: micro-batches with durable offsets, and alerts kept as state."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.events import surge
from ..operators.windows import best_row
from ..sources.store import Store, content_id


def run_batches(stream: DataFrame, body: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None, name: str | None = None) -> StreamingQuery:
    """Each micro-batch goes through body; offsets move only after it returns, so a failed batch comes again.

    Without an interval all that is available is taken in one go and the query ends.
    """
    writer = stream.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
    writer = writer.queryName(name) if name else writer
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


EVENTS, ALERTS, RUNS, SEEN = "events", "alerts", "runs", "watermark"


def collect_since(events: DataFrame, since: tuple | None, limit: int) -> tuple[DataFrame, tuple | None]:
    """The next `limit` events (id, ts) after a watermark (ts, id), and the watermark behind them; the old one if there are none.

    Events of one time go on by id, so a limit between them loses none. Events without a time are left out.
    """
    own = events.where("ts is not null")
    if since is not None:
        at, ident = F.lit(since[0]).cast(events.schema["ts"].dataType), F.lit(since[1]).cast(events.schema["id"].dataType)
        own = own.where((F.col("ts") > at) | ((F.col("ts") == at) & (F.col("id") > ident)))
    batch = own.orderBy("ts", "id").limit(limit)
    last = batch.agg(F.max(F.struct(F.col("ts").cast("string").alias("ts"), "id")).alias("w")).first().w
    return batch, (last.ts, last.id) if last else since


def run_once(store: Store, batch: DataFrame, watermark: object, analyse: Callable[[DataFrame], DataFrame], keys: Iterable[str], least: int = 1) -> dict:
    """Saves a batch of events (id, ts and others), analyses the table and commits alerts, run and watermark together.

    Fewer than `least` events are saved and the watermark moves on, without a run. If the analysis
    fails, the events stay saved, the watermark stays where it was, and the batch comes again. An
    empty batch changes nothing. A run's id follows from its events and watermark, and alerts belong to
    their run: a batch that comes again, from whatever checkpoint, writes the same rows anew, and
    no run's alerts replace those of another. analyse: from all events to alerts, one for each of keys.
    """
    own = batch.where("id is not null").persist()
    try:
        n = own.select("id").distinct().count()
        if not n:
            return {"ran": False, "reason": "not_enough_events", "event_count": 0}
        t = store.begin()
        t.upsert(EVENTS, own, ["id"], ["ts"])
        if n < least:
            t.set(SEEN, watermark)
            t.commit()
            return {"ran": False, "reason": "not_enough_events", "event_count": n}
        t.commit()
        run_id = hashlib.sha256(f"{content_id(own)}:{watermark}".encode()).hexdigest()[:16]
        t = store.begin()
        try:
            alerts = analyse(t.read(EVENTS, own.schema)).withColumn("run_id", F.lit(run_id))
            t.upsert(ALERTS, alerts, ["run_id", *keys])
        except (PySparkException, ArithmeticError, LookupError, TypeError, ValueError) as e:
            return {"ran": False, "reason": "analysis_failed", "event_count": n, "error": type(e).__name__}
        count = t.read(ALERTS, alerts.schema).where(F.col("run_id") == run_id).count()
        row = own.agg(F.lit(run_id).alias("run_id"), F.lit("completed").alias("status"), F.lit(n).cast("long").alias("event_count"), F.lit(count).cast("long").alias("alert_count"), F.max("ts").alias("as_of"))
        t.upsert(RUNS, row, ["run_id"])
        t.set(SEEN, watermark)
        t.commit()
        return {"ran": True, "run_id": run_id, "event_count": n, "alert_count": count}
    finally:
        own.unpersist()


def poll_once(store: Store, batch: DataFrame, watermark: object) -> int:
    """Saves a batch without an analysis; polling has a watermark of its own. Returns the number of events."""
    n = batch.where("id is not null").select("id").distinct().count()
    if n:
        t = store.begin()
        t.upsert(EVENTS, batch.where("id is not null"), ["id"], ["ts"])
        t.set("polled", watermark)
        t.commit()
    return n


def latest_run(store: Store, schema: str = "run_id string, status string, event_count long, alert_count long, as_of timestamp") -> DataFrame:
    """The newest completed run."""
    return best_row(store.table(RUNS, schema).withColumn("_one", F.lit(1)), ["_one"], ["as_of", "run_id"]).drop("_one")


def analysing(spark: SparkSession, path: str, least: int = 1, baseline_days: int = 7) -> Callable[[DataFrame, int], None]:
    """A batch body for run_batches that keeps events, surge alerts and runs in the store at path; a failed analysis fails the batch, so it comes again."""

    def surges(table: DataFrame) -> DataFrame:
        last = table.agg(F.max("ts")).first()[0]
        near = table.where(F.col("ts") >= F.lit(last) - F.expr(f"interval {baseline_days} days"))
        return surge(near, ["department", "region"], baseline_days=baseline_days, as_of=F.lit(last)).where("is_surge")

    def body(batch: DataFrame, number: int) -> None:
        last = batch.agg(F.max(F.col("ts").cast("string"))).first()[0]
        out = run_once(Store(spark, path), batch, last, surges, ["department", "region"], least)
        if out.get("reason") == "analysis_failed":
            raise RuntimeError(f"analysis failed: {out['error']}")

    return body


def windowed_counts(stream: DataFrame, by: Iterable[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """T05 on a stream: counts in event-time windows; rows behind the watermark are dropped by Spark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), *by).agg(F.count("*").alias("n"), F.sum("minutes").alias("minutes"))


ALERT = "alert_id string, status string, n long, first_ts timestamp, last_ts timestamp"
STATE = "n long, first_ts timestamp, last_ts timestamp"


def alert_state(stream: DataFrame) -> DataFrame:
    """One alert for each id, ACTIVE when first seen and UPDATED after, with counts and times merged over all batches."""

    def update(key, batches, state):
        n, first, last = state.get if state.exists else (0, None, None)
        status = "UPDATED" if state.exists else "ACTIVE"
        for b in batches:
            n += len(b)
            first = b["ts"].min() if first is None else min(first, b["ts"].min())
            last = b["ts"].max() if last is None else max(last, b["ts"].max())
        state.update((n, first, last))
        yield pd.DataFrame([(key[0], status, n, first, last)], columns=["alert_id", "status", "n", "first_ts", "last_ts"])

    return stream.groupBy("alert_id").applyInPandasWithState(update, ALERT, STATE, "update", "NoTimeout")
