"""Multipart uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def latest_parts(parts: DataFrame) -> DataFrame:
    """The last upload of each part; the order written_at, tie1, tie2, tie3 is total.

    Parts are dealt by upload first, so that what follows by upload moves nothing again.
    """
    by = F.struct("written_at", "tie1", "tie2", "tie3")
    dealt = parts.repartition("upload_id")
    return dealt.groupBy("upload_id", "part_number").agg(F.max_by("size", by).alias("size"), F.max("written_at").alias("written_at"))


def summary(uploads: DataFrame, parts: DataFrame) -> DataFrame:
    """Parts and bytes of every upload; an upload without parts has none."""
    sums = latest_parts(parts).groupBy("upload_id").agg(F.count("*").alias("n"), F.sum("size").cast("long").alias("b"))
    return uploads.join(sums, "upload_id", "left").select("upload_id", "bucket", "key", F.coalesce("n", F.lit(0)).alias("n_parts"), F.coalesce("b", F.lit(0)).alias("bytes"))


def offsets(parts: DataFrame) -> DataFrame:
    """upload_id, part_number, size, start: where each part begins in the whole object. One row a part, however many."""
    w = Window.partitionBy("upload_id").orderBy("part_number").rowsBetween(Window.unboundedPreceding, 0)
    return latest_parts(parts).select("upload_id", "part_number", "size", (F.sum("size").over(w) - F.col("size")).cast("long").alias("start"))


def manifest(parts: DataFrame) -> DataFrame:
    """upload_id, parts, offsets, bytes: part numbers in ascending order and where each begins."""
    p = F.array_sort(F.collect_list(F.struct("part_number", "start", "size"))).alias("p")
    got = offsets(parts).groupBy("upload_id").agg(p)
    text = lambda f: F.array_join(F.transform("p", lambda x: x[f].cast("string")), ",").alias({"part_number": "parts", "start": "offsets"}[f])
    last = F.element_at("p", -1)
    return got.select("upload_id", text("part_number"), text("start"), (last["start"] + last["size"]).alias("bytes"))


def assemble(parts: DataFrame) -> DataFrame:
    """upload_id, body from rows (upload_id, part_number, body binary), parts in ascending order, joined once.

    For objects that fit a row; ``offsets`` places the parts of larger ones.
    """
    got = parts.groupBy("upload_id").agg(F.array_sort(F.collect_list(F.struct("part_number", F.hex("body").alias("h")))).alias("p"))
    return got.select("upload_id", F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")).alias("body"))


def complete(uploads: DataFrame, parts: DataFrame, now: int) -> DataFrame:
    """upload_id, bucket, key, size, etag, updated_at of the objects that uploads make: the last upload of each part
    (upload_id, part_number, written_at, body), joined in ascending order and hashed anew. An upload without parts makes none."""
    by = F.struct("written_at", "body")
    last = parts.repartition("upload_id").groupBy("upload_id", "part_number").agg(F.max_by("body", by).alias("body"))
    whole = uploads.select("upload_id", "bucket", "key").join(assemble(last), "upload_id")
    return whole.select("upload_id", "bucket", "key", F.octet_length("body").cast("long").alias("size"), F.md5("body").alias("etag"), F.lit(now).cast("long").alias("updated_at"))


def stale(uploads: DataFrame, now: int, ttl_seconds: int | None = None) -> DataFrame:
    """Sessions begun before now - ttl, or, without a TTL, past their own expiry."""
    return uploads.where(F.col("created_at") < now - ttl_seconds) if ttl_seconds is not None else uploads.where(F.col("expires_at") < now)


def owned(uploads: DataFrame, requests: DataFrame) -> DataFrame:
    """verdict of each request (upload_id, bucket, key): ok, wrong_target or missing."""
    u = uploads.select("upload_id", F.col("bucket").alias("_b"), F.col("key").alias("_k"))
    same = (F.col("bucket") == F.col("_b")) & (F.col("key") == F.col("_k"))
    return requests.join(u, "upload_id", "left").select("upload_id", F.when(F.col("_b").isNull(), "missing").when(same, "ok").otherwise("wrong_target").alias("verdict"))
