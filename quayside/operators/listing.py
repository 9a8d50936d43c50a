"""Listings, lookups and counts over objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quayside.functions import keys

MAX_PAGE = 1000


def active(objects: DataFrame) -> DataFrame:
    return objects.where(F.col("deleted_at").isNull())


def under(objects: DataFrame, bucket: str | None = None, prefix: str = "", start_after: str | None = None) -> DataFrame:
    """Rows of a bucket whose key has the prefix and comes after the cursor, by byte order. All conditions reach the scan."""
    if bucket is not None:
        objects = objects.where(F.col("bucket") == bucket)
    if prefix:
        objects = objects.where(F.col("key").startswith(prefix))
    return objects if start_after is None else objects.where(F.col("key") > start_after)


def entries(objects: DataFrame, prefix: str = "", delimiter: str = "/") -> DataFrame:
    """bucket, kind, entry, n, bytes: keys and folders directly below the prefix."""
    folder = keys.common_prefix(F.col("key"), prefix, delimiter)
    named = objects.select("bucket", F.when(folder.isNull(), "item").otherwise("prefix").alias("kind"), F.coalesce(folder, "key").alias("entry"), "size")
    return named.groupBy("bucket", "kind", "entry").agg(F.count("*").alias("n"), F.sum("size").cast("long").alias("bytes"))


def page(rows: DataFrame, order: str, limit: int = 100) -> DataFrame:
    """The first ``limit`` rows with ``truncated`` and ``next_cursor``; one row more is looked at. Only a page is sorted
    in one place."""
    limit = max(1, min(MAX_PAGE, limit))
    # The window runs over limit + 1 rows at most.
    ahead = rows.orderBy(order).limit(limit + 1).withColumn("_rn", F.row_number().over(Window.orderBy(order))).withColumn("_n", F.count("*").over(Window.partitionBy()))
    cut = F.col("_n") > limit
    last = F.max(F.when(F.col("_rn") == limit, F.col(order))).over(Window.partitionBy())
    return ahead.withColumn("truncated", cut).withColumn("next_cursor", F.when(cut, last)).where(F.col("_rn") <= limit).drop("_rn", "_n")


def list_objects(objects: DataFrame, bucket: str, prefix: str = "", delimiter: str | None = None, limit: int = 100, start_after: str | None = None) -> DataFrame:
    """A page of a bucket. With a delimiter the cursor is an entry, so that no folder is listed twice and no key is skipped."""
    rows = under(active(objects), bucket, prefix, None if delimiter else start_after)
    if not delimiter:
        return page(rows, "key", limit)
    got = entries(rows, prefix, delimiter)
    return page(got if start_after is None else got.where(F.col("entry") > start_after), "entry", limit)


def delete_page(objects: DataFrame, bucket: str, prefix: str, limit: int = MAX_PAGE, start_after: str | None = None) -> DataFrame:
    """The next objects below a prefix to delete, with ``truncated`` and ``next_cursor``. An empty prefix, which would be
    the whole bucket, is refused."""
    if not prefix:
        raise ValueError("deleting by prefix needs a prefix")
    return list_objects(objects, bucket, prefix, None, limit, start_after)


def count_objects(objects: DataFrame, bucket: str | None = None, prefix: str = "", start_after: str | None = None) -> DataFrame:
    return under(active(objects), bucket, prefix, start_after).agg(F.count("*").alias("n"))


def head(objects: DataFrame, bucket: str, key: str) -> DataFrame:
    return active(objects).where((F.col("bucket") == bucket) & (F.col("key") == key))


def require(objects: DataFrame, bucket: str, key: str) -> DataFrame:
    """``head`` that raises KeyError on a miss."""
    got = head(objects, bucket, key)
    if got.isEmpty():
        raise KeyError(f"{bucket}/{key}")
    return got


def existing(objects: DataFrame, wanted: DataFrame) -> DataFrame:
    """bucket, key, exists for each row of ``wanted``."""
    have = active(objects).select("bucket", "key").distinct().withColumn("_have", F.lit(True))
    return wanted.join(have, ["bucket", "key"], "left").select("bucket", "key", F.coalesce("_have", F.lit(False)).alias("exists"))


def not_modified(etag: Column, updated_at: Column, none_match: Column, modified_since: Column) -> Column:
    """True if the condition's tag is * or equals the etag, or the object is no newer than the given time."""
    tag = F.coalesce((none_match == "*") | keys.etag_equal(none_match, etag), F.lit(False))
    return tag | F.coalesce(updated_at <= modified_since, F.lit(False))


def write_allowed(found: Column, etag: Column, if_match: Column, if_none_match: Column) -> Column:
    """Create-only fails on an existing object; If-Match needs one, with this etag unless it is *."""
    create_only = F.coalesce(if_none_match == "*", F.lit(False)) & found
    matches = found & F.coalesce((if_match == "*") | keys.etag_equal(if_match, etag), F.lit(False))
    return ~create_only & (if_match.isNull() | matches)


def migration_page(objects: DataFrame, limit: int, after: tuple[str, str] | None = None) -> DataFrame:
    """A page over all buckets in the order (key, bucket), so that a key in two buckets is not skipped at a page's edge."""
    rows = active(objects)
    if after is not None:
        rows = rows.where((F.col("key") > after[0]) | ((F.col("key") == after[0]) & (F.col("bucket") > after[1])))
    return rows.orderBy("key", "bucket").limit(min(10_000, max(1, limit)))


def oldest(objects: DataFrame, limit: int) -> DataFrame:
    return active(objects).orderBy("updated_at", "bucket", "key").limit(min(10_000, max(1, limit)))


def page_xml(rows: DataFrame, bucket: str, prefix: str | None = None, delimiter: str | None = None) -> DataFrame:
    """One row, xml: the listing document of a page (kind item or prefix, entry, size, etag, updated_at, truncated,
    next_cursor). A page has at most ``MAX_PAGE`` rows, so that the document is small."""
    text = lambda c: keys.xml_escape(F.col(c))
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>\n"))
    quoted = F.concat(F.lit('    <ETag>"'), text("etag"), F.lit('"</ETag>\n'))
    item = F.concat(
        F.lit("  <Contents>\n    "), tag("Key", text("entry")), F.coalesce(quoted, F.lit("")), F.lit("    "), tag("Size", F.col("size").cast("string")),
        F.lit("    "), tag("LastModified", keys.iso_date(F.col("updated_at"))), F.lit("  </Contents>\n"),
    )
    folder = F.concat(F.lit("  <CommonPrefixes>\n    "), tag("Prefix", text("entry")), F.lit("  </CommonPrefixes>\n"))
    is_item = F.col("kind") == "item"

    def all_of(condition, body):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct("entry", body.alias("x"))))), lambda r: r["x"]), "")

    got = rows.agg(
        all_of(is_item, item).alias("items"), all_of(~is_item, folder).alias("folders"), F.count_if(is_item).cast("string").alias("n"),
        F.coalesce(F.bool_or("truncated"), F.lit(False)).cast("string").alias("cut"), F.max("next_cursor").alias("next"),
    )
    said = lambda value: keys.xml_escape(F.lit(value))
    return got.select(
        F.concat(
            F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<ListBucketResult xmlns="http://s3.amazonaws.com/doc/2006-03-01/">\n  '),
            tag("Name", said(bucket)), F.lit("  "), tag("Prefix", said(prefix or "")), F.concat(F.lit("  "), tag("Delimiter", said(delimiter))) if delimiter else F.lit(""),
            F.lit("  "), tag("MaxKeys", F.col("n")), F.lit("  "), tag("IsTruncated", F.col("cut")),
            F.coalesce(F.concat(F.lit("  "), tag("NextContinuationToken", text("next"))), F.lit("")), F.lit("  "), tag("KeyCount", F.col("n")), F.col("folders"), F.col("items"), F.lit("</ListBucketResult>\n"),
        ).alias("xml")
    )


# The gauges of a store and their help texts.
GAUGES = [
    ("objects_total", "Live objects in metadata DB."), ("storage_bytes_total", "Live object bytes in metadata DB."), ("logical_bytes_total", "Logical bytes (same as storage_bytes for v1)."),
    ("replication_pending_events", "Pending replication_log rows."),
]


def metric_lines(objects: DataFrame, events: DataFrame, prefix: str = "store") -> DataFrame:
    """line: the store's gauges in the text form of metrics, with the objects of each class under a class label."""
    act = active(objects)
    one = act.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("b"))
    one = one.crossJoin(events.agg(F.count_if(F.col("status") == "pending").alias("p")))  # each side is one row
    values = dict(zip([g for g, _ in GAUGES], ["n", "b", "b", "p"]))
    said = []
    for name, told in GAUGES:
        full = f"{prefix}_{name}"
        said += [F.lit(f"# HELP {full} {told}"), F.lit(f"# TYPE {full} gauge"), F.concat(F.lit(f"{full} "), F.col(values[name]).cast("string"))]
    full = f"{prefix}_storage_class_objects"
    said += [F.lit(f"# HELP {full} Objects per storage_class label."), F.lit(f"# TYPE {full} gauge")]
    classes = act.groupBy(F.coalesce("storage_class", F.lit("default")).alias("c")).agg(F.count("*").alias("n"))
    labelled = classes.select(F.concat(F.lit(f'{full}{{class="'), keys.label_escape(F.col("c")), F.lit('"} '), F.col("n").cast("string")).alias("line"))
    return one.select(F.explode(F.array(*said)).alias("line")).unionByName(labelled)
