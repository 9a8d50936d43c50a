"""The replication log as a stream against the batch forms."""

import pytest
from pyspark.sql import functions as F

from quayside.operators import replication
from quayside.streaming import log

EVENTS = "event_id string, op string, bucket string, key string, status string"


def events(n):
    return [(str(i), "put", "b", f"k{i % 5}", "pending") for i in range(n)]


def test_replayed_events_apply_once(spark, tmp_path):
    src, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    for part in (events(6), events(10), events(10)):
        spark.createDataFrame(part, EVENTS).write.mode("append").parquet(src)
        stream = spark.readStream.schema(EVENTS).parquet(src)
        log.apply_stream(stream, out, state).awaitTermination()
    assert sorted(int(r["event_id"]) for r in spark.read.parquet(out).collect()) == list(range(10))


def test_unseen_equals_batch(spark):
    e = spark.createDataFrame(events(5) + events(3), EVENTS)
    applied = spark.createDataFrame(events(2), EVENTS)
    assert sorted(r["event_id"] for r in replication.unseen(e, applied).collect()) == ["2", "3", "4"]


@pytest.mark.parametrize("per_second,want", [(0.0, 2), (1.0, 4)])
def test_token_bucket(spark, tmp_path, per_second, want):
    rows = [(i, 1, 10 * i) for i in range(4)]
    spark.createDataFrame(rows, "event_id long, user_id long, at long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, user_id long, at long").parquet(str(tmp_path / "in"))
    q = log.token_bucket(stream, 2, per_second).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where(F.col("allowed")).count() == want


@pytest.fixture
def wide_log(spark, tmp_path, monkeypatch):
    """A folder with an events table of 12 files, each read in a part of its own; streams keep their folders in tmp_path."""
    e = F.col("id")
    types = F.element_at(F.array(*map(F.lit, ["view", "signup", "error", "click", "purchase"])), (e % 5 + 1).cast("int"))
    spark.range(0, 1200, 1, 12).select(e.alias("event_id"), F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, id)").alias("ts"), (e % 100).alias("user_id"), types.alias("event_type"), (e / 7).alias("value"), F.lit('{"k": 1}').alias("props")).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(log, "folder", lambda spark, label: str(tmp_path / label))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    yield str(tmp_path)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def parts(path):
    return [p for p in path.iterdir() if p.name.startswith("part-")]


def test_the_applied_log_is_dealt_by_the_parts_it_is_read_in(spark, wide_log, tmp_path):
    got = [int(r["event_id"]) for r in log.run_apply(spark, wide_log).collect()]
    assert sorted(got) == [i for i in range(1200) if i % 10]
    assert len(parts(tmp_path / "stream-apply" / "in")) == 24  # each event twice
    assert 2 <= len([p for p in (tmp_path / "stream-apply" / "out").iterdir() if p.name.startswith("epoch=")]) <= 3


def test_the_counted_log_is_dealt_by_the_parts_it_is_read_in(spark, wide_log, tmp_path):
    got = {r["status"]: r["n"] for r in log.run_status(spark, wide_log).collect()}
    assert got == dict.fromkeys(replication.STATUSES, 240)
    assert len(parts(tmp_path / "stream-status" / "in")) == 12
