from pyspark.sql import functions as F

from skarn.sources.store import Store
from skarn.streaming import incremental as I

SCHEMA = "id long, ts timestamp, department string, region string, minutes double"


def rows(spark, lo, hi):
    return spark.range(lo, hi).select("id", F.timestamp_seconds(F.col("id") * 600).alias("ts"), F.lit("d").alias("department"), F.lit("r").alias("region"), F.lit(1.0).alias("minutes"))


def test_batches_upsert_and_resume(spark, tmp_path):
    source, path, offsets = (str(tmp_path / x) for x in ("in", "store", "offsets"))
    body = I.analysing(spark, path)
    for lo, hi in ((0, 30), (20, 40)):
        rows(spark, lo, hi).coalesce(1).write.mode("append").parquet(source)
        I.run_batches(spark.readStream.schema(SCHEMA).parquet(source), body, offsets).awaitTermination()
    store = Store(spark, path)
    assert store.table("events", SCHEMA).count() == 40
    runs = {r.run_id: r for r in store.table("runs", RUN).collect()}
    alerts = sorted(map(tuple, store.table("alerts", "run_id string").collect()))
    assert len(runs) == 2 and I.latest_run(store).first().event_count == 20
    # A fresh checkpoint reads all again: nothing is lost, and the alerts of the runs before stay
    I.run_batches(spark.readStream.schema(SCHEMA).parquet(source), body, offsets + "2").awaitTermination()
    assert store.table("events", SCHEMA).count() == 40
    assert {r.run_id for r in store.table("runs", RUN).collect()} > set(runs)
    assert set(alerts) <= set(map(tuple, store.table("alerts", "run_id string").collect()))


RUN = "run_id string, status string, event_count long, alert_count long, as_of timestamp"


def by_department(table):
    return table.groupBy("department").agg(F.count("*").alias("n"))


def failing(table):
    raise ValueError("no analysis")


def test_scheduler_scenarios(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    empty = rows(spark, 0, 0)
    assert I.run_once(store, empty, 1, by_department, ["department"], 5) == {"ran": False, "reason": "not_enough_events", "event_count": 0} and store.value("watermark") is None
    assert I.run_once(store, rows(spark, 0, 3), 3, by_department, ["department"], 5)["reason"] == "not_enough_events"  # saved, moved on, no run
    assert store.value("watermark") == 3 and store.table("events", SCHEMA).count() == 3 and store.table("runs", RUN).count() == 0
    out = I.run_once(store, rows(spark, 3, 10), 10, failing, ["department"], 5)  # saved, not moved on
    assert out["reason"] == "analysis_failed" and store.value("watermark") == 3 and store.table("events", SCHEMA).count() == 10 and store.table("runs", RUN).count() == 0
    out = I.run_once(store, rows(spark, 3, 10), 10, by_department, ["department"], 5)
    assert out["ran"] and store.value("watermark") == 10 and [r.n for r in store.table("alerts", "n long").collect()] == [10]
    before = store.manifest()["values"]
    assert I.run_once(store, rows(spark, 3, 10), 10, by_department, ["department"], 5)["run_id"] == out["run_id"]  # again: the same rows
    assert store.manifest()["values"] == before and store.table("runs", RUN).count() == 1 and store.table("alerts", "n long").count() == 1
    assert I.poll_once(store, rows(spark, 9, 12), 12) == 3 and store.value("watermark") == 10 and store.value("polled") == 12


def test_collected_events_go_on_after_the_watermark(spark):
    own = spark.createDataFrame([(i, f"2024-01-0{1 + i // 4} 00:00:00") for i in range(12)] + [(99, None)], "id long, t string").select("id", F.to_timestamp("t").alias("ts"))
    seen, at = [], None
    for _ in range(5):
        batch, at = I.collect_since(own, at, 3)
        seen.append([r.id for r in batch.orderBy("ts", "id").collect()])
    assert seen == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9, 10, 11], []]


def test_alert_state_merges(spark, tmp_path):
    source, offsets = str(tmp_path / "in"), str(tmp_path / "offsets")
    seen = []
    for lo, hi in ((0, 3), (3, 5)):
        rows(spark, lo, hi).coalesce(1).select(F.lit("a").alias("alert_id"), "ts").write.mode("append").parquet(source)
        stream = I.alert_state(spark.readStream.schema("alert_id string, ts timestamp").parquet(source))
        q = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend((r.status, r.n) for r in df.collect())).option("checkpointLocation", offsets).trigger(availableNow=True).start()
        q.awaitTermination()
    assert seen == [("ACTIVE", 3), ("UPDATED", 5)]
