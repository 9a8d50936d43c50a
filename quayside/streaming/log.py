"""The replication log as a stream: at-least-once delivery, effectively-once apply, lag counts and rate limits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from quayside.operators import replication
from quayside.sources import tables


def folder(spark: SparkSession, label: str) -> str:
    """A new shared folder for a stream's state and output: below spark.checkpoint.dir, or /tmp/checkpoints in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/quayside-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


PARTS = 256  # folders of an epoch, by a hash of the event's id


def apply_stream(events: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append each event to the table at ``target`` unless it has it: whole-history dedup on event_id.

    Each batch writes to a folder named by its epoch, which a repeated batch overwrites, and compares with all other
    epochs; so a restart after a lost batch neither loses nor repeats an event. Below an epoch rows lie in ``PARTS``
    folders, and a batch reads only those that its own ids fall into.
    """

    def take(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["event_id"]).withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(PARTS)).cast("int"))
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            own = [r["part"] for r in fresh.select("part").distinct().collect()]  # PARTS at most
            known = spark.read.schema("event_id string, epoch long, part int").parquet(target)
            fresh = replication.unseen(fresh, known.where(F.col("part").isin(own) & (F.col("epoch") != epoch)))
        fresh.write.mode("overwrite").partitionBy("part").parquet(f"{target}/epoch={epoch}")

    w = events.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="1 second")).start()


def bounded_dedup(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events once each while repeats come within ``delay``: bounded state, where the whole history is too much."""
    return events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["event_id"])


def status_stream(events: DataFrame) -> DataFrame:
    return events.groupBy("status").agg(F.count("*").alias("n"))


def token_bucket(events: DataFrame, capacity: float, per_second: float) -> DataFrame:
    """event_id, user_id, allowed: a token bucket for each user, in the order of event time within a batch.

    A task holds one user's events of one batch; ``maxFilesPerTrigger`` or the source's rate bounds a batch.
    """

    def run(key, batches, state):
        import pandas as pd

        tokens, last = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        allowed = []
        for at in rows["at"]:
            tokens = tokens if last is None else min(capacity, tokens + max(0, at - last) * per_second)
            last = at if last is None else max(at, last)
            allowed.append(tokens >= 1)
            tokens -= tokens >= 1
        state.update((float(tokens), None if last is None else int(last)))
        yield pd.DataFrame({"event_id": rows["event_id"].to_numpy(), "user_id": key[0], "allowed": allowed})

    return events.groupBy("user_id").applyInPandasWithState(run, "event_id long, user_id long, allowed boolean", "tokens double, last long", "append", "NoTimeout")


def _sent(log: DataFrame, path: str, batches: int = 3) -> DataFrame:
    """``log`` written to ``path`` and read as a stream of some ``batches``.

    Each task writes the part of the log that it reads, so the files grow in number with the log and a batch takes a share of
    them. Only a log of fewer parts than batches, one of a few MB, is dealt out.
    """
    spark, few = log.sparkSession, log.rdd.getNumPartitions() < batches
    (log.repartition(batches) if few else log).write.parquet(path)
    files = len(spark.read.schema(log.schema).parquet(path).inputFiles())
    return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(path)


def _log_source(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """The log as a file source of several batches, every event sent twice."""
    log = tables.replication_log(spark, sf_dir)
    return _sent(log.unionByName(log), path)


def run_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = folder(spark, "stream-apply")
    events = _log_source(spark, sf_dir, f"{root}/in").where(~F.col("key").startswith("staging/"))
    apply_stream(events, f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("event_id", "op", "bucket", "key")


def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = folder(spark, "stream-status")
    events = _sent(tables.replication_log(spark, sf_dir), f"{root}/in")

    def put(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{root}/out")

    status_stream(events).writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out")


def run_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = folder(spark, "stream-limit")
    e = tables.table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    e.write.parquet(f"{root}/in")
    events = spark.readStream.schema(e.schema).parquet(f"{root}/in")
    token_bucket(events, 2, 1 / 86400).writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out")
