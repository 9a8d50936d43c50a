"""Catalog against files, and checks of stored content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quayside.functions import keys

PK = ["bucket", "key"]


def orphans(objects: DataFrame, blobs: DataFrame, include_tombstones: bool = False, bucket: str | None = None, prefix: str = "") -> DataFrame:
    """Files without an active object (with tombstones: without any)."""
    own = objects if include_tombstones else objects.where(F.col("deleted_at").isNull())
    if bucket is not None:
        blobs = blobs.where(F.col("bucket") == bucket)
    if prefix:
        blobs = blobs.where(F.col("key").startswith(prefix))
    return blobs.join(own.select(*PK), PK, "left_anti")


def stale_rows(objects: DataFrame, blobs: DataFrame) -> DataFrame:
    """Active objects without a file."""
    return objects.where(F.col("deleted_at").isNull()).join(blobs.select(*PK), PK, "left_anti")


def missing_payloads(events: DataFrame, blobs: DataFrame) -> DataFrame:
    """Pending puts whose payload is not on disk."""
    return events.where((F.col("status") == "pending") & (F.col("op") == "put")).join(blobs.select(*PK).distinct(), PK, "left_anti")


def report(objects: DataFrame, blobs: DataFrame, events: DataFrame) -> DataFrame:
    """One row: stale_rows, orphan_files, orphan_bytes, pending_events, missing_payloads.

    Objects and files meet once, in a full outer join whose two sides are counted together.
    """
    own = objects.where(F.col("deleted_at").isNull()).select(*PK, F.lit(True).alias("_o"))
    both = own.join(blobs.select(*PK, "bytes", F.lit(True).alias("_f")), PK, "full_outer")
    lost, stale = F.col("_o").isNull(), F.col("_f").isNull()
    files = both.agg(
        F.count_if(stale).alias("stale_rows"), F.count_if(lost).alias("orphan_files"), F.coalesce(F.sum(F.when(lost, F.col("bytes"))), F.lit(0)).cast("long").alias("orphan_bytes")
    )
    pending = events.agg(F.count_if(F.col("status") == "pending").alias("pending_events"))
    missing = missing_payloads(events, blobs).agg(F.count("*").alias("missing_payloads"))
    # Each side is one row.
    return files.crossJoin(pending).crossJoin(missing)


def scrub(objects: DataFrame, stored: DataFrame, denominator: int) -> DataFrame:
    """bucket, key, verdict of the sampled active objects against stored (bucket, key, stored_etag): ok, corrupted, missing."""
    some = objects.where(F.col("deleted_at").isNull() & keys.sampled(F.col("bucket"), F.col("key"), denominator))
    j = some.select(*PK, "etag").join(stored.select(*PK, "stored_etag"), PK, "left")
    return j.select(*PK, F.when(F.col("stored_etag").isNull(), "missing").when(keys.etag_equal(F.col("etag"), F.col("stored_etag")), "ok").otherwise("corrupted").alias("verdict"))


def scrub_page(objects: DataFrame, limit: int, after: tuple[str, str] | None = None) -> DataFrame:
    """The next page of a rotating scrub in the order (key, bucket): past the last object it begins again.

    At most two pages are looked at: the one behind the cursor and the first.
    """
    act = objects.where(F.col("deleted_at").isNull())
    first = act.orderBy("key", "bucket").limit(limit).withColumn("lap", F.lit(1))
    if after is None:
        return first.drop("lap")
    behind = act.where((F.col("key") > after[0]) | ((F.col("key") == after[0]) & (F.col("bucket") > after[1])))
    behind = behind.orderBy("key", "bucket").limit(limit).withColumn("lap", F.lit(0))
    both = behind.unionByName(first)
    least = both.agg(F.min("lap").alias("_lap"))
    return both.join(F.broadcast(least), F.col("lap") == F.col("_lap")).drop("lap", "_lap")


def scrub_report(objects: DataFrame, stored: DataFrame, denominator: int) -> DataFrame:
    """One row: scanned, sampled_out, verified, corrupted, missing."""
    scanned = objects.where(F.col("deleted_at").isNull()).agg(F.count("*").alias("scanned"))
    v = scrub(objects, stored, denominator).agg(F.count("*").alias("_n"), *[F.count_if(F.col("verdict") == x).alias(x) for x in ("ok", "corrupted", "missing")])
    return scanned.crossJoin(v).select("scanned", (F.col("scanned") - F.col("_n")).alias("sampled_out"), F.col("ok").alias("verified"), "corrupted", "missing")


def heal(verdicts: DataFrame, replicas: DataFrame) -> DataFrame:
    """Damaged objects with the first node (by id) that has a copy; healed false where none has."""
    first = replicas.groupBy(*PK).agg(F.min("node_id").alias("source_node"))
    bad = verdicts.where(F.col("verdict") != "ok")
    return bad.join(first, PK, "left").select(*PK, "verdict", "source_node", F.col("source_node").isNotNull().alias("healed"))


# The first four bytes of the container formats, as hex, and the least length that counts as one.
CONTAINERS = [("indexed", "4E4F5349", 12), ("blocks", "4E4F5342", 12), ("packed", "4E4F535A", 12), ("packed2", "4E4F5332", 16), ("refs", "4E4F5344", 16)]
HAS_LEVEL = 0x8000  # flag of an indexed container whose header has a level


def container_format(body: Column) -> Column:
    """The container format of binary content by its first bytes and length, else raw."""
    head, n = F.hex(F.substring(body, 1, 4)), F.octet_length(body)
    out = F.lit("raw")
    for name, magic, least in reversed(CONTAINERS):
        out = F.when((head == magic) & (n >= least), name).otherwise(out)
    return out


def sniff(content: DataFrame) -> DataFrame:
    """bucket, key, format of rows with a binary ``body``."""
    return content.select(*PK, container_format(F.col("body")).alias("format"))


def headers(content: DataFrame) -> DataFrame:
    """bucket, key, format, logical_size, block_size, dict_id, flags, zstd_level of the container in ``body``.

    A field is null where the format hasn't got it or the content is too short for it; an indexed container without the
    level flag has level 0.
    """
    body = F.col("body")
    c = content.withColumn("format", container_format(body))
    held = F.col("format") != "raw"
    indexed = F.col("format") == "indexed"
    flags = F.when(indexed, keys.little_endian(body, 22, 2))
    level = F.when(flags.bitwiseAND(HAS_LEVEL) != 0, F.coalesce(keys.little_endian(body, 24, 1), F.lit(0))).when(flags.isNotNull(), 0)
    return c.select(
        *PK, "format", F.when(held, keys.little_endian(body, 4, 8)).alias("logical_size"), F.when(indexed | (F.col("format") == "blocks"), keys.little_endian(body, 12, 4)).alias("block_size"),
        F.when(indexed, keys.little_endian(body, 20, 2)).alias("dict_id"), flags.alias("flags"), level.cast("long").alias("zstd_level"),
    )


def needs_upgrade(level: int, dict_loaded: bool = False, target_dict: int = 0) -> Column:
    """Whether a container of ``headers`` should be written anew: an old block container, one whose header can't be read,
    one of a lower or unknown level, or one without the dictionary that is loaded now. Other formats stay."""
    old = F.col("zstd_level").isNull() | (F.col("zstd_level") == 0) | (F.col("zstd_level") < level)
    if dict_loaded and target_dict > 0:
        old = old | (F.col("dict_id") == 0)
    return (F.col("format") == "blocks") | ((F.col("format") == "indexed") & old)


def recompress_plan(content: DataFrame, level: int, dict_loaded: bool = False, target_dict: int = 0) -> DataFrame:
    """bucket, key, format, upgrade of rows with a binary ``body``."""
    return headers(content).select(*PK, "format", needs_upgrade(level, dict_loaded, target_dict).alias("upgrade"))


def light_check(content: DataFrame, expected: DataFrame) -> DataFrame:
    """bucket, key, format, intact of rows with a binary ``body`` against expected (bucket, key, size), without decoding:
    raw content has the size, block containers say so in a whole header, other containers have something behind their magic.
    Without an expected row ``intact`` is null."""
    h = headers(content).select(*PK, "format", "logical_size", "block_size")
    n = content.select(*PK, F.octet_length("body").alias("_n"))
    j = h.join(n, PK).join(expected.select(*PK, "size"), PK, "left")
    said = F.col("block_size").isNotNull() & (F.col("logical_size") == F.col("size"))
    fine = F.when(F.col("format") == "raw", F.col("_n") == F.col("size")).when(F.col("format").isin("indexed", "blocks"), said).otherwise(F.col("_n") > 8)
    return j.select(*PK, "format", F.when(F.col("size").isNotNull(), fine).alias("intact"))


def migration_plan(page: DataFrame, files: DataFrame) -> DataFrame:
    """bucket, key, action, path of the objects of a page against files (bucket, path, readable, format, upgrade).

    The file at the object's encoded place counts before one at its nested place. skipped: no file, or one that is in
    place and needs nothing; failed: it can't be read; relocate: it only moves; reencode: it is written anew, as are raw
    files that move. ``path`` is where the object is afterwards, null where it has no file.
    """
    key, bucket = F.col("key"), F.col("bucket")
    flat = keys.blob_path(bucket, key)
    places = F.array_compact(F.array(F.struct(F.lit(0).alias("turn"), flat.alias("path")), F.when(keys.nested_path(bucket, key) != flat, F.struct(F.lit(1).alias("turn"), keys.nested_path(bucket, key).alias("path")))))
    at = page.select(*PK, F.explode(places).alias("_p")).select(*PK, "_p.turn", "_p.path")
    seen = at.join(files.select("path", "readable", "format", "upgrade"), "path", "left").withColumn("found", F.col("readable").isNotNull())
    first = F.min_by(F.struct("turn", "path", "found", "readable", "format", "upgrade"), F.when(F.col("found"), F.col("turn")).otherwise(2 + F.col("turn")))
    one = seen.groupBy(*PK).agg(first.alias("f")).select(*PK, "f.*")
    moves = F.col("turn") == 1
    anew = F.col("upgrade") | ((F.col("format") == "raw") & moves)
    action = F.when(~F.col("found"), "skipped").when(~F.col("readable"), "failed").when(anew, "reencode").when(moves, "relocate").otherwise("skipped")
    return one.select(*PK, action.alias("action"), F.when(F.col("found"), F.when(action == "failed", F.col("path")).otherwise(flat)).alias("path"))


def migration_report(plan: DataFrame) -> DataFrame:
    """One row: scanned, migrated, skipped, failed of a ``migration_plan``."""
    a = F.col("action")
    return plan.agg(F.count("*").alias("scanned"), F.count_if(a.isin("relocate", "reencode")).alias("migrated"), F.count_if(a == "skipped").alias("skipped"), F.count_if(a == "failed").alias("failed"))


def recompress_report(plan: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row: scanned, recompressed, skipped, bytes_saved of a ``recompress_plan`` whose files are written anew with sizes
    (bucket, key, old_size, new_size). A container that upgrades is replaced though it grows; a file that can't be written
    (no new size) is skipped."""
    j = plan.join(sizes.select(*PK, "old_size", "new_size"), PK, "left")
    done = F.col("upgrade") & F.col("new_size").isNotNull()
    saved = F.coalesce(F.sum(F.when(done, F.col("old_size") - F.col("new_size"))), F.lit(0)).cast("long")
    return j.agg(F.count("*").alias("scanned"), F.count_if(done).alias("recompressed"), (F.count("*") - F.count_if(done)).alias("skipped"), saved.alias("bytes_saved"))
