"""Changes of a catalog as DataFrame -> DataFrame functions: the result is the new state or the verdict on each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quayside.functions import keys

PK = ["bucket", "key"]


def upsert(writes: DataFrame, order: str = "version", at: str = "written_at", keep: tuple[str, ...] = ("storage_class", "origin_node"), pk: tuple[str, ...] = ("bucket", "key")) -> DataFrame:
    """The latest write of each key. ``keep`` columns hold their last non-null value, created_at the first write's time.
    Of several writes with one order the one with the greatest values counts.

    One aggregation: partial results meet before the shuffle, so a key written very often moves little.
    """
    rest = [c for c in writes.columns if c not in (*pk, order, at, *keep)]
    latest = F.max_by(F.struct(*rest), F.struct(order, at, *rest)).alias("_r")
    kept = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(order, at, c))).alias(c) for c in keep]
    times = F.min_by(at, F.struct(order, at)).alias("created_at"), F.max_by(at, F.struct(order, at)).alias("updated_at")
    got = writes.groupBy(*pk).agg(latest, *kept, *times)
    return got.select(*pk, *[F.col(f"_r.{c}").alias(c) for c in rest], *keep, "created_at", "updated_at")


def soft_delete(objects: DataFrame, named: DataFrame, now: int) -> DataFrame:
    """Tombstones on active rows that ``named`` holds."""
    marked = objects.join(named.select(*PK).distinct().withColumn("_hit", F.lit(True)), PK, "left")
    gone = F.when(F.col("deleted_at").isNull() & F.col("_hit"), F.lit(now)).otherwise(F.col("deleted_at"))
    return marked.withColumn("deleted_at", gone.cast("long")).drop("_hit")


def hard_delete(objects: DataFrame, named: DataFrame) -> DataFrame:
    return objects.join(named.select(*PK).distinct(), PK, "left_anti")


def delete_status(objects: DataFrame, named: DataFrame) -> DataFrame:
    """bucket, key, status of each named key: deleted, or ignored where no active object has it."""
    have = objects.where(F.col("deleted_at").isNull()).select(*PK).distinct().withColumn("_have", F.lit(True))
    return named.join(have, PK, "left").select(*PK, F.when(F.col("_have"), "deleted").otherwise("ignored").alias("status"))


def delete_batch(objects: DataFrame, named: DataFrame) -> DataFrame:
    """bucket, key, status, error of each named key, once each after cleaning: deleted, ignored where no active object has
    it, or failed where the bucket or key is not allowed (the key then as it was named)."""
    clean = named.select("bucket", F.col("key").alias("_said"), keys.clean_bucket(F.col("bucket")).alias("_b"), keys.clean_key(F.col("key")).alias("_k"))
    bad = F.when(F.col("_b").isNull(), "invalid bucket").when(F.col("_k").isNull(), "invalid key")
    asked = clean.select(F.coalesce("_b", "bucket").alias("bucket"), F.when(bad.isNull(), F.col("_k")).otherwise(F.col("_said")).alias("key"), bad.alias("error")).distinct()
    have = objects.where(F.col("deleted_at").isNull()).select(*PK).distinct().withColumn("_have", F.lit(True))
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("_have"), "deleted").otherwise("ignored")
    return asked.join(have, PK, "left").select(*PK, status.alias("status"), "error")


def write_verdict(objects: DataFrame, content: DataFrame, cap: int, read_only: bool = False, max_size: int | None = None) -> DataFrame:
    """bucket, key, size, etag, error of each write of content (bucket, key, body binary): its length, its hash and why it is
    refused, if it is. The reasons in their order: read_only_replica, invalid_bucket, invalid_key, payload_too_large,
    insufficient_storage (``quota`` against the state before all of them)."""
    new = content.select(*PK, F.octet_length("body").cast("long").alias("incoming"), F.md5("body").alias("etag"))
    room = quota(objects, new.select(*PK, "incoming", "etag"), cap, "etag")
    error = F.when(F.lit(read_only), "read_only_replica").when(keys.clean_bucket(F.col("bucket")).isNull(), "invalid_bucket").when(keys.clean_key(F.col("key")).isNull(), "invalid_key")
    if max_size is not None:
        error = error.when(F.col("incoming") > max_size, "payload_too_large")
    return room.select(*PK, F.col("incoming").alias("size"), "etag", error.when(~F.col("accepted"), "insufficient_storage").alias("error"))


def write_objects(objects: DataFrame, content: DataFrame, cap: int, now: int) -> DataFrame:
    """bucket, key, size, etag, created_at, updated_at of the active objects after the writes that ``write_verdict`` allows.
    A key is written once at most; an object that is written again keeps its creation time."""
    done = write_verdict(objects, content, cap).where(F.col("error").isNull())
    new = done.select(*PK, "size", "etag", F.lit(now).cast("long").alias("created_at"), F.lit(now).cast("long").alias("updated_at"), F.lit(1).alias("_new"))
    old = objects.where(F.col("deleted_at").isNull()).select(*PK, "size", "etag", "created_at", "updated_at", F.lit(0).alias("_new"))
    both = old.unionByName(new).groupBy(*PK)
    latest = lambda c: F.max_by(c, "_new").alias(c)
    first = F.min_by("created_at", F.when(F.col("created_at").isNotNull(), F.col("_new"))).alias("created_at")  # also one later than now
    return both.agg(latest("size"), latest("etag"), first, latest("updated_at"))


def set_state(state: DataFrame, updates: DataFrame) -> DataFrame:
    """name, value, updated_at of maintenance values after updates (name, value, updated_at): the latest of each name,
    the greatest value of several at one time."""
    both = state.select("name", "value", "updated_at").unionByName(updates.select("name", "value", "updated_at"))
    return both.groupBy("name").agg(F.max_by("value", F.struct("updated_at", "value")).alias("value"), F.max("updated_at").alias("updated_at"))


def delete_mode(found: Column, ttl_seconds: Column, drop_blob: Column) -> Column:
    """What a single delete does: nothing, a hard delete for a TTL of 0 or less, else a tombstone with or without the blob."""
    return F.when(~found, "noop").when(ttl_seconds <= 0, "hard").when(drop_blob, "soft_drop_blob").otherwise("soft")


def purgeable(objects: DataFrame, cutoff: int) -> DataFrame:
    return objects.where(F.col("deleted_at") < cutoff)


def place(objects: DataFrame, moves: DataFrame) -> DataFrame:
    """Class and node of active rows set to those of ``moves`` (bucket, key, new_class, new_node)."""
    one = moves.groupBy(*PK).agg(F.max(F.struct("new_class", "new_node")).alias("_to"))  # of several moves of a key, the greatest
    j = objects.join(one.select(*PK, "_to.new_class", "_to.new_node", F.lit(True).alias("_m")), PK, "left")
    hit = F.col("_m") & F.col("deleted_at").isNull()
    return j.withColumn("storage_class", F.when(hit, F.col("new_class")).otherwise(F.col("storage_class"))).withColumn("origin_node", F.when(hit, F.col("new_node")).otherwise(F.col("origin_node"))).drop("_m", "new_class", "new_node")


def copies(objects: DataFrame, requests: DataFrame, now: int) -> DataFrame:
    """New rows for requests (bucket, key, to_bucket, to_key) whose source is active."""
    src = objects.where(F.col("deleted_at").isNull())
    got = requests.join(src, PK)
    return got.withColumn("bucket", F.col("to_bucket")).withColumn("key", F.col("to_key")).withColumn("created_at", F.lit(now).cast("long")).withColumn("updated_at", F.lit(now).cast("long")).drop("to_bucket", "to_key")


def quota(objects: DataFrame, requests: DataFrame, cap: int, *more: str) -> DataFrame:
    """bucket, key, incoming, existing, accepted (and ``more`` columns) of each request: the total without the replaced object
    and with the new one must not exceed ``cap``; 0 or less is no cap."""
    act = objects.where(F.col("deleted_at").isNull())
    total = act.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total"))
    own = act.select(*PK, F.col("size").alias("_old"))
    # The total is one row.
    j = requests.join(own, PK, "left").crossJoin(F.broadcast(total)).withColumn("existing", F.coalesce("_old", F.lit(0)).cast("long"))
    ok = F.lit(True) if cap <= 0 else F.col("total") - F.col("existing") + F.col("incoming") <= cap
    return j.select(*PK, "incoming", "existing", ok.alias("accepted"), *more)


def class_counts(objects: DataFrame, normalised: bool) -> DataFrame:
    """Active objects by class. Raw keeps a row for null and one for 'default', both under that label."""
    act = objects.where(F.col("deleted_at").isNull())
    label = F.coalesce("storage_class", F.lit("default"))
    if normalised:
        return act.groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.sum("size").cast("long").alias("bytes"))
    return act.groupBy("storage_class").agg(F.count("*").alias("n"), F.sum("size").cast("long").alias("bytes")).select(label.alias("label"), "n", "bytes")


def totals(objects: DataFrame) -> DataFrame:
    return objects.where(F.col("deleted_at").isNull()).agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))


def multipart_quota(objects: DataFrame, sizes: DataFrame, cap: int) -> DataFrame:
    """upload_id, bytes, accepted: whether completing an upload of so many bytes keeps the total within ``cap``."""
    act = objects.where(F.col("deleted_at").isNull())
    total = act.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("_total"))
    own = act.select(*PK, F.col("size").alias("_old"))
    j = sizes.join(own, PK, "left").crossJoin(F.broadcast(total))
    ok = F.lit(True) if cap <= 0 else F.col("_total") - F.coalesce("_old", F.lit(0)) + F.col("bytes") <= cap
    return j.select("upload_id", "bytes", ok.alias("accepted"))
