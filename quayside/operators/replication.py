"""The replication log in batch: what is due, outcomes and retries, status and fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quayside.functions import keys
from quayside.operators import placement

STATUSES = ["pending", "failed", "dead_letter", "sent", "applied"]


def is_due(now: int) -> Column:
    return (F.col("status") == "pending") | ((F.col("status") == "failed") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)))


def due(events: DataFrame, now: int, limit: int = 32) -> DataFrame:
    """The oldest due events, now pending."""
    return events.where(is_due(now)).orderBy("created_at", "event_id").limit(limit).withColumn("status", F.lit("pending"))


def after_failure(events: DataFrame, now: int, max_attempts: int = 20) -> DataFrame:
    """Events after one more failure: attempts up, dead at the limit, else failed with a later retry."""
    n = F.col("attempts") + 1
    dead = n >= max_attempts
    return events.withColumn("next_retry_at", F.when(~dead, F.lit(now) + keys.backoff_seconds(n)).cast("long")).withColumn("status", F.when(dead, "dead_letter").otherwise("failed")).withColumn("attempts", n.cast("int"))


def replay(events: DataFrame) -> DataFrame:
    """Dead letters made pending again, from no attempts."""
    d = F.col("status") == "dead_letter"
    return events.withColumn("attempts", F.when(d, 0).otherwise(F.col("attempts")).cast("int")).withColumn("next_retry_at", F.when(~d, F.col("next_retry_at"))).withColumn("status", F.when(d, "pending").otherwise(F.col("status")))


def status(events: DataFrame, now: int) -> DataFrame:
    """One row: events by status, and the age of the oldest pending one, null without any."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    age = (F.lit(now) - F.min(F.when(F.col("status") == "pending", F.col("created_at")))).cast("long")
    return events.agg(*counts, F.count_if(is_due(now)).alias("due"), age.alias("oldest_pending_seconds"))


def replicated(include: list[str], exclude: list[str], staging: str = "staging/") -> Column:
    """Whether rules let (bucket, key) replicate: not in staging, not excluded, and included or nothing is listed."""
    path = F.concat_ws("/", "bucket", "key")

    def any_of(prefixes):
        out = F.lit(False)
        for p in prefixes:
            out = out | F.col("key").startswith(p) | path.startswith(p)
        return out

    return ~F.col("key").startswith(staging) & ~any_of(exclude) & (F.lit(True) if not include else any_of(include))


def fan_out(events: DataFrame, peers: DataFrame, factor: int) -> DataFrame:
    """event_id, node_id, rank: the first factor - 1 peers by id for each event, other than its origin."""
    pairs = placement.peers_for(events, peers).where(F.col("node_id") != F.col("origin_node"))
    w = Window.partitionBy("event_id").orderBy("node_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= factor - 1).select("event_id", "node_id", "rank")


def delivered(attempts: DataFrame, factor: int) -> DataFrame:
    """event_id, node_id, rank, ok of attempts (event_id, node_id, ok) that a drain makes: peers by id until factor - 1 of
    them took the event; peers behind the last of those aren't asked."""
    w = Window.partitionBy("event_id").orderBy("node_id")
    before = F.coalesce(F.sum(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return attempts.withColumn("rank", F.row_number().over(w)).withColumn("_taken", before).where(F.col("_taken") < factor - 1).select("event_id", "node_id", "rank", "ok")


def drained(events: DataFrame, asked: DataFrame, factor: int) -> DataFrame:
    """event_id, succeeded, outcome of each event after ``delivered``."""
    took = asked.groupBy("event_id").agg(F.count_if("ok").alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    return events.select("event_id").join(took, "event_id", "left").select("event_id", n.alias("succeeded"), drain_outcome(n, F.lit(factor - 1)).alias("outcome"))


def drain_outcome(succeeded: Column, needed: Column) -> Column:
    """sent if enough peers took it; retry_now if some did; failed if none."""
    return F.when(succeeded >= needed, "sent").when(succeeded > 0, "retry_now").otherwise("failed")


def backfill(objects: DataFrame, limit: int, include: list[str], exclude: list[str]) -> DataFrame:
    """Put events for the oldest active objects that the rules let replicate."""
    some = objects.where(F.col("deleted_at").isNull()).orderBy("updated_at", "bucket", "key").limit(limit)
    return some.where(replicated(include, exclude)).select("bucket", "key", F.lit("put").alias("op"), "size", "etag")


def unseen(events: DataFrame, applied: DataFrame) -> DataFrame:
    """Events that the applied table doesn't have, once each."""
    return events.dropDuplicates(["event_id"]).join(applied.select("event_id"), "event_id", "left_anti")


def apply_events(events: DataFrame) -> DataFrame:
    """The objects that a log leaves: the last event of each key by (created_at, event_id), unless it is a delete."""
    by = F.struct("created_at", F.col("event_id").cast("long"))
    got = events.groupBy("bucket", "key").agg(F.max_by(F.struct("op", "size", "event_id"), by).alias("l"))
    return got.where(F.col("l.op") == "put").select("bucket", "key", F.col("l.size").alias("size"), F.col("l.event_id").alias("event_id"))


def merge_deletes(results: DataFrame) -> DataFrame:
    """One row of many nodes' results (node_id, deleted, failed_keys, truncated, cursor): sums, number of failures, any, first."""
    return results.agg(
        F.sum("deleted").cast("long").alias("deleted"), F.sum(F.size("failed_keys")).cast("long").alias("n_failed"), F.bool_or("truncated").alias("truncated"),
        F.min_by("cursor", F.when(F.col("cursor").isNotNull(), F.col("node_id"))).alias("cursor"),
    )


def failed_keys(results: DataFrame) -> DataFrame:
    """node_id, key of every key that a node failed to delete, one row each."""
    return results.select("node_id", F.explode("failed_keys").alias("key"))


def read_repair(wanted: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """Where each wanted key is read from: local, the smallest node id that has it, or missing."""
    l_ = local.select("bucket", "key").distinct().withColumn("_l", F.lit("local"))
    r = remote.groupBy("bucket", "key").agg(F.min("node_id").alias("_r"))
    return wanted.join(l_, ["bucket", "key"], "left").join(r, ["bucket", "key"], "left").select("bucket", "key", F.coalesce("_l", "_r", F.lit("missing")).alias("source"))


def enqueue(objects: DataFrame, op: str, node: str, now: int, group: str | None = None) -> DataFrame:
    """New pending events for objects; the id is a digest of operation, place and etag, so asking twice adds nothing new."""
    ident = F.md5(F.concat_ws("\x1f", F.lit(op), F.lit(node), "bucket", "key", F.coalesce("etag", F.lit(""))))
    return objects.select(ident.alias("event_id"), F.lit(node).alias("origin_node"), F.lit(op).alias("op"), "bucket", "key", "etag", "size", F.lit(group).cast("string").alias("replication_group"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.lit(now).cast("long").alias("created_at"))
