"""The catalog queries by name, each with its DuckDB counterpart on the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quayside.functions import keys
from quayside.operators import blocks, catalog, listing, multipart, placement, reconcile, replication
from quayside.plans.views import sql
from quayside.sources import tables as t
from quayside.streaming import log as stream

NOW = t.NOW
QUERIES: dict = {}
SQL: dict = {}
BLOCK = 1024


def query(oracle: str | None = None, *views: str):
    """Register a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            SQL[f.__name__] = sql(oracle, *views)
        return f

    return put


# --- listings, lookups and counts


@query("""SELECT bucket, CASE WHEN instr(key, '/') > 0 THEN 'prefix' ELSE 'item' END AS kind,
  CASE WHEN instr(key, '/') > 0 THEN substr(key, 1, instr(key, '/')) ELSE key END AS entry,
  count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM page_objects GROUP BY ALL""", "page_objects")
def list_delimiter_rollup(spark, d):
    return listing.entries(t.page_objects(spark, d))


@query("""SELECT key, size, etag, n > 20 AS truncated, CASE WHEN n > 20 THEN max(CASE WHEN rn = 20 THEN key END) OVER () END AS next_cursor FROM (
  SELECT key, size, etag, row_number() OVER (ORDER BY key) AS rn, count(*) OVER () AS n FROM doc_objects
  WHERE bucket = 'src1' AND key > 'en/5' AND deleted_at IS NULL) WHERE rn <= 20""", "doc_objects")
def list_page_keyset(spark, d):
    return listing.list_objects(t.doc_objects(spark, d), "src1", limit=20, start_after="en/5").select("key", "size", "etag", "truncated", "next_cursor")


@query("""SELECT kind, entry, n, bytes, c > 10 AS truncated, CASE WHEN c > 10 THEN max(CASE WHEN rn = 10 THEN entry END) OVER () END AS next_cursor FROM (
  SELECT *, row_number() OVER (ORDER BY entry) AS rn, count(*) OVER () AS c FROM (
    SELECT CASE WHEN instr(substr(key, 4), '1') > 0 THEN 'prefix' ELSE 'item' END AS kind,
      CASE WHEN instr(substr(key, 4), '1') > 0 THEN substr(key, 1, 3 + instr(substr(key, 4), '1')) ELSE key END AS entry,
      count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes
    FROM doc_objects WHERE bucket = 'src2' AND key LIKE 'en/%' AND deleted_at IS NULL GROUP BY ALL)) WHERE rn <= 10""", "doc_objects")
def list_prefix_page_truncated(spark, d):
    return listing.list_objects(t.doc_objects(spark, d), "src2", prefix="en/", delimiter="1", limit=10).select("kind", "entry", "n", "bytes", "truncated", "next_cursor")


@query("SELECT count(*) AS n FROM doc_objects WHERE key LIKE 'fr/%' AND deleted_at IS NULL", "doc_objects")
def count_by_prefix(spark, d):
    return listing.count_objects(t.doc_objects(spark, d), prefix="fr/")


@query("SELECT count(*) AS n FROM doc_objects WHERE bucket = 'src3' AND key LIKE 'en/%' AND key > 'en/3' AND deleted_at IS NULL", "doc_objects")
def count_after_cursor(spark, d):
    return listing.count_objects(t.doc_objects(spark, d), "src3", "en/", "en/3")


@query("SELECT bucket, key, size, mime_type, etag, storage_class FROM doc_objects WHERE doc_id = 17 AND deleted_at IS NULL", "doc_objects")
def head_active(spark, d):
    o = t.doc_objects(spark, d)
    return listing.active(o).where(F.col("doc_id") == 17).select("bucket", "key", "size", "mime_type", "etag", "storage_class")


@query("""SELECT w.bucket, w.key, o.key IS NOT NULL AS exists FROM (SELECT DISTINCT bucket, key || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '.bak' END AS key FROM doc_objects) w
  LEFT JOIN (SELECT bucket, key FROM doc_objects WHERE deleted_at IS NULL) o USING (bucket, key)""", "doc_objects")
def exists_batch(spark, d):
    o = t.doc_objects(spark, d)
    wanted = o.select("bucket", F.concat("key", F.when(F.col("doc_id") % 2 == 0, "").otherwise(".bak")).alias("key")).distinct()
    return listing.existing(o, wanted)


@query("""SELECT doc_id, coalesce(CASE doc_id % 3 WHEN 0 THEN '"' || etag || '"' WHEN 1 THEN 'x' END = '"' || etag || '"', false)
  OR coalesce(updated_at <= CASE WHEN doc_id % 2 = 0 THEN 1704117200 END, false) AS not_modified FROM doc_objects WHERE deleted_at IS NULL""", "doc_objects")
def conditional_status(spark, d):
    o, i = listing.active(t.doc_objects(spark, d)), F.col("doc_id")
    tag = F.when(i % 3 == 0, F.concat(F.lit('"'), "etag", F.lit('"'))).when(i % 3 == 1, "x")
    return o.select("doc_id", listing.not_modified(F.col("etag"), F.col("updated_at"), tag, F.when(i % 2 == 0, 1704117200)).alias("not_modified"))


@query("""SELECT doc_id, NOT (coalesce(inm = '*', false) AND found) AND (im IS NULL OR (found AND (im = '*' OR im = etag))) AS allowed FROM (
  SELECT doc_id, etag, deleted_at IS NULL AS found, CASE doc_id % 4 WHEN 0 THEN '*' WHEN 1 THEN etag WHEN 2 THEN 'other' END AS im, CASE WHEN doc_id % 5 = 0 THEN '*' END AS inm FROM doc_objects)""", "doc_objects")
def write_precondition_status(spark, d):
    o, i = t.doc_objects(spark, d), F.col("doc_id")
    im = F.when(i % 4 == 0, "*").when(i % 4 == 1, F.col("etag")).when(i % 4 == 2, "other")
    return o.select("doc_id", listing.write_allowed(F.col("deleted_at").isNull(), F.col("etag"), im, F.when(i % 5 == 0, "*")).alias("allowed"))


@query("SELECT bucket, key, size FROM doc_objects WHERE deleted_at IS NULL AND (key > 'en/4' OR (key = 'en/4' AND bucket > 'src0')) ORDER BY key, bucket LIMIT 50", "doc_objects")
def migrate_page(spark, d):
    return listing.migration_page(t.doc_objects(spark, d), 50, ("en/4", "src0")).select("bucket", "key", "size")


@query("SELECT bucket, key, updated_at FROM doc_objects WHERE deleted_at IS NULL ORDER BY updated_at, bucket, key LIMIT 40", "doc_objects")
def recompress_candidates(spark, d):
    return listing.oldest(t.doc_objects(spark, d), 40).select("bucket", "key", "updated_at")


# --- aggregates


@query("SELECT count(*) AS n, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM doc_objects WHERE deleted_at IS NULL", "doc_objects")
def totals(spark, d):
    return catalog.totals(t.doc_objects(spark, d))


@query("SELECT coalesce(storage_class, 'default') AS label, n, bytes FROM (SELECT storage_class, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM doc_objects WHERE deleted_at IS NULL GROUP BY storage_class)", "doc_objects")
def class_counts_raw(spark, d):
    return catalog.class_counts(t.doc_objects(spark, d), normalised=False)


@query("SELECT coalesce(storage_class, 'default') AS label, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM doc_objects WHERE deleted_at IS NULL GROUP BY 1", "doc_objects")
def class_counts_normalised(spark, d):
    return catalog.class_counts(t.doc_objects(spark, d), normalised=True)


@query("""SELECT (SELECT count(*) FROM doc_objects WHERE deleted_at IS NULL) AS objects, (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM doc_objects WHERE deleted_at IS NULL) AS bytes,
  (SELECT count(*) FROM replication_log WHERE status = 'pending' OR (status = 'failed' AND (next_retry_at IS NULL OR next_retry_at <= 1706659200))) AS due,
  (SELECT count(DISTINCT coalesce(storage_class, 'default')) FROM doc_objects WHERE deleted_at IS NULL) AS classes""", "doc_objects", "replication_log")
def metrics_snapshot(spark, d):
    o = listing.active(t.doc_objects(spark, d))
    own = o.agg(F.count("*").alias("objects"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"), F.countDistinct(F.coalesce("storage_class", F.lit("default"))).alias("classes"))
    return own.crossJoin(t.replication_log(spark, d).agg(F.count_if(replication.is_due(NOW)).alias("due"))).select("objects", "bytes", "due", "classes")


@query("""SELECT 'store_objects{bucket="' || bucket || '"} ' || count(*) AS line FROM doc_objects WHERE deleted_at IS NULL GROUP BY bucket""", "doc_objects")
def prometheus_lines(spark, d):
    return listing.active(t.doc_objects(spark, d)).groupBy("bucket").agg(F.count("*").alias("n")).select(F.format_string('store_objects{bucket="%s"} %d', "bucket", "n").alias("line"))


@query(r"""SELECT unnest(['# HELP store_objects_total Live objects in metadata DB.', '# TYPE store_objects_total gauge', 'store_objects_total ' || o.n,
    '# HELP store_storage_bytes_total Live object bytes in metadata DB.', '# TYPE store_storage_bytes_total gauge', 'store_storage_bytes_total ' || o.b,
    '# HELP store_logical_bytes_total Logical bytes (same as storage_bytes for v1).', '# TYPE store_logical_bytes_total gauge', 'store_logical_bytes_total ' || o.b,
    '# HELP store_replication_pending_events Pending replication_log rows.', '# TYPE store_replication_pending_events gauge', 'store_replication_pending_events ' || p.n,
    '# HELP store_storage_class_objects Objects per storage_class label.', '# TYPE store_storage_class_objects gauge']) AS line FROM (SELECT count(*) AS n, CAST(coalesce(sum(size), 0) AS BIGINT) AS b FROM doc_objects WHERE deleted_at IS NULL) o, (SELECT count(*) AS n FROM replication_log WHERE status = 'pending') p
  UNION ALL SELECT 'store_storage_class_objects{class="' || CASE c WHEN 'cold' THEN 'co\\\"ld' ELSE c END || '"} ' || count(*) FROM (SELECT coalesce(storage_class, 'default') AS c FROM doc_objects WHERE deleted_at IS NULL) GROUP BY c""", "doc_objects", "replication_log")
def metrics_text(spark, d):
    o = t.doc_objects(spark, d).replace({"cold": 'co\\"ld'}, subset=["storage_class"])  # a label to escape
    return listing.metric_lines(o, t.replication_log(spark, d))


# --- changes


@query("""SELECT bucket, key, arg_max(size, version) AS size, arg_max(storage_class, version) FILTER (storage_class IS NOT NULL) AS storage_class,
  arg_max(origin_node, version) FILTER (origin_node IS NOT NULL) AS origin_node, arg_min(written_at, version) AS created_at, arg_max(written_at, version) AS updated_at
  FROM object_writes GROUP BY bucket, key""", "object_writes")
def upsert_latest(spark, d):
    return catalog.upsert(t.object_writes(spark, d))


@query("SELECT bucket, key, CASE WHEN deleted_at IS NULL AND doc_id % 9 = 0 THEN 1706659200 ELSE deleted_at END AS deleted_at FROM doc_objects", "doc_objects")
def soft_delete_view(spark, d):
    o = t.doc_objects(spark, d)
    return catalog.soft_delete(o, o.where(F.col("doc_id") % 9 == 0), NOW).select("bucket", "key", "deleted_at")


@query("SELECT bucket, key FROM doc_objects WHERE doc_id % 9 <> 0", "doc_objects")
def hard_delete_view(spark, d):
    o = t.doc_objects(spark, d)
    return catalog.hard_delete(o, o.where(F.col("doc_id") % 9 == 0)).select("bucket", "key")


@query("SELECT bucket, key, deleted_at FROM doc_objects WHERE deleted_at < 1705659200", "doc_objects")
def purge_expired(spark, d):
    return catalog.purgeable(t.doc_objects(spark, d), NOW - 1_000_000).select("bucket", "key", "deleted_at")


@query("""SELECT w.bucket, w.key, CASE WHEN o.key IS NULL THEN 'ignored' ELSE 'deleted' END AS status FROM (SELECT bucket, CASE WHEN doc_id % 4 = 0 THEN 'no/' || doc_id ELSE key END AS key FROM doc_objects WHERE doc_id % 5 = 0) w
  LEFT JOIN (SELECT bucket, key FROM doc_objects WHERE deleted_at IS NULL) o USING (bucket, key)""", "doc_objects")
def batch_delete_status(spark, d):
    o, i = t.doc_objects(spark, d), F.col("doc_id")
    named = o.where(i % 5 == 0).select("bucket", F.when(i % 4 == 0, F.concat(F.lit("no/"), i.cast("string"))).otherwise(F.col("key")).alias("key"))
    return catalog.delete_status(o, named)


_NAMED = f"""(SELECT DISTINCT coalesce(b, said_b) AS bucket, CASE WHEN e IS NULL THEN k ELSE said END AS key, e AS error FROM (
  SELECT *, CASE WHEN b IS NULL THEN 'invalid bucket' WHEN k IS NULL THEN 'invalid key' END AS e FROM (SELECT said_b, said,
    CASE WHEN contains(said_b, '..') THEN NULL ELSE said_b END AS b, CASE WHEN starts_with(said, '/') OR contains(said, '/../') THEN NULL ELSE replace(said, '\\', '/') END AS k FROM (
    SELECT CASE WHEN doc_id % 11 = 0 THEN 'x..y' ELSE bucket END AS said_b, CASE doc_id % 5 WHEN 0 THEN '/' || key WHEN 1 THEN 'a/../' || key WHEN 2 THEN replace(key, '/', '\\') WHEN 3 THEN key || '.no' ELSE key END AS said FROM doc_objects))))"""


@query(f"""SELECT n.bucket, n.key, CASE WHEN error IS NOT NULL THEN 'failed' WHEN o.key IS NULL THEN 'ignored' ELSE 'deleted' END AS status, error FROM {_NAMED} n LEFT JOIN (SELECT bucket, key FROM doc_objects WHERE deleted_at IS NULL) o USING (bucket, key)""", "doc_objects")
def delete_batch(spark, d):
    """All objects named once more: some with keys or buckets that are not allowed, some with the other slash, some unknown."""
    o, i, k = t.doc_objects(spark, d), F.col("doc_id"), F.col("key")
    said = F.when(i % 5 == 0, F.concat(F.lit("/"), k)).when(i % 5 == 1, F.concat(F.lit("a/../"), k)).when(i % 5 == 2, F.replace(k, F.lit("/"), F.lit("\\"))).when(i % 5 == 3, F.concat(k, F.lit(".no"))).otherwise(k)
    return catalog.delete_batch(o, o.select(F.when(i % 11 == 0, "x..y").otherwise(F.col("bucket")).alias("bucket"), said.alias("key")))


_WRITES = "(SELECT source AS bucket, CASE doc_id % 5 WHEN 0 THEN 'new/' || doc_id WHEN 1 THEN '../' || doc_id ELSE lang || '/' || doc_id END AS key, text || '+' AS body FROM documents)"


def _writes(spark, d):
    """Every document written again, a byte longer: a fifth under new keys, a fifth under keys that are not allowed."""
    i = F.col("doc_id")
    key = F.when(i % 5 == 0, F.concat(F.lit("new/"), i.cast("string"))).when(i % 5 == 1, F.concat(F.lit("../"), i.cast("string"))).otherwise(F.concat_ws("/", "lang", i.cast("string")))
    return t.table(spark, d, "documents").select(F.col("source").alias("bucket"), key.alias("key"), F.encode(F.concat("text", F.lit("+")), "UTF-8").alias("body"))


@query("""SELECT w.bucket, w.key, size, etag, CASE WHEN starts_with(w.key, '..') THEN 'invalid_key' WHEN size > 9000 THEN 'payload_too_large' WHEN total - existing + size > 40000000 THEN 'insufficient_storage' END AS error,
  CASE WHEN starts_with(w.key, '..') THEN 400 WHEN size > 9000 THEN 413 WHEN total - existing + size > 40000000 THEN 507 ELSE 200 END AS code FROM (
  SELECT w.bucket, w.key, CAST(octet_length(encode(body)) AS BIGINT) AS size, md5(body) AS etag, coalesce(o.size, 0) AS existing, total
  FROM """ + _WRITES + """ w CROSS JOIN (SELECT sum(size) AS total FROM doc_objects WHERE deleted_at IS NULL) LEFT JOIN (SELECT bucket, key, size FROM doc_objects WHERE deleted_at IS NULL) o USING (bucket, key)) w""", "doc_objects")
def write_verdict(spark, d):
    v = catalog.write_verdict(t.doc_objects(spark, d), _writes(spark, d), 40_000_000, max_size=9000)
    return v.withColumn("code", keys.status_code(F.col("error")))


@query("""SELECT coalesce(w.bucket, o.bucket) AS bucket, coalesce(w.key, o.key) AS key, coalesce(w.size, o.size) AS size, coalesce(w.etag, o.etag) AS etag, coalesce(o.created_at, 1706659200) AS created_at, CASE WHEN w.key IS NULL THEN o.updated_at ELSE 1706659200 END AS updated_at
  FROM (SELECT bucket, key, CAST(octet_length(encode(body)) AS BIGINT) AS size, md5(body) AS etag FROM """ + _WRITES + """ WHERE NOT starts_with(key, '..')) w FULL JOIN (SELECT * FROM doc_objects WHERE deleted_at IS NULL) o ON o.bucket = w.bucket AND o.key = w.key""", "doc_objects")
def write_objects(spark, d):
    o = t.doc_objects(spark, d)
    return catalog.write_objects(o, _writes(spark, d), 0, NOW)


@query("SELECT event_type AS name, CAST(arg_max(event_id, (ts, CAST(event_id AS VARCHAR))) AS VARCHAR) AS value, CAST(max(floor(epoch(ts))) AS BIGINT) AS updated_at FROM (SELECT event_type, event_id, date_trunc('second', ts) AS ts FROM events) GROUP BY event_type")
def maintenance_state(spark, d):
    e = t.table(spark, d, "events").select(F.col("event_type").alias("name"), F.col("event_id").cast("string").alias("value"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("updated_at"))
    return catalog.set_state(e.where("updated_at % 2 = 0"), e.where("updated_at % 2 = 1"))


@query("""SELECT key, n > 15 AS truncated FROM (SELECT key, row_number() OVER (ORDER BY key) AS rn, count(*) OVER () AS n FROM doc_objects WHERE bucket = 'src4' AND key LIKE 'en/%' AND deleted_at IS NULL) WHERE rn <= 15""", "doc_objects")
def prefix_delete_plan(spark, d):
    return listing.delete_page(t.doc_objects(spark, d), "src4", "en/", 15).select("key", "truncated")


@query("""SELECT doc_id, CASE WHEN deleted_at IS NOT NULL THEN 'noop' WHEN doc_id % 3 = 0 THEN 'hard' WHEN doc_id % 2 = 0 THEN 'soft_drop_blob' ELSE 'soft' END AS mode FROM doc_objects""", "doc_objects")
def delete_policy(spark, d):
    i = F.col("doc_id")
    return t.doc_objects(spark, d).select("doc_id", catalog.delete_mode(F.col("deleted_at").isNull(), i % 3 * 60, i % 2 == 0).alias("mode"))


@query("""SELECT bucket, key, CASE WHEN doc_id % 7 = 0 AND deleted_at IS NULL THEN 'moved' ELSE storage_class END AS storage_class, CASE WHEN doc_id % 7 = 0 AND deleted_at IS NULL THEN 'nodeX' ELSE origin_node END AS origin_node FROM doc_objects""", "doc_objects")
def set_placement(spark, d):
    o = t.doc_objects(spark, d)
    moves = o.where(F.col("doc_id") % 7 == 0).select("bucket", "key", F.lit("moved").alias("new_class"), F.lit("nodeX").alias("new_node"))
    return catalog.place(o, moves).select("bucket", "key", "storage_class", "origin_node")


@query("SELECT 'copies' AS bucket, bucket || '/' || key AS key, size, etag, 1706659200 AS created_at FROM doc_objects WHERE deleted_at IS NULL", "doc_objects")
def copy_objects(spark, d):
    o = t.doc_objects(spark, d)
    req = o.select("bucket", "key", F.lit("copies").alias("to_bucket"), F.concat_ws("/", "bucket", "key").alias("to_key"))
    return catalog.copies(o, req, NOW).select("bucket", "key", "size", "etag", F.col("created_at").cast("int").alias("created_at"))


@query("""SELECT bucket, key, incoming, CAST(existing AS BIGINT) AS existing, total - existing + incoming <= 2000000 AS accepted FROM (
  SELECT bucket, key, doc_id * 1000 AS incoming, CASE WHEN deleted_at IS NULL THEN size ELSE 0 END AS existing, (SELECT sum(size) FROM doc_objects WHERE deleted_at IS NULL) AS total FROM doc_objects)""", "doc_objects")
def quota_verdict(spark, d):
    o = t.doc_objects(spark, d)
    return catalog.quota(o, o.select("bucket", "key", (F.col("doc_id") * 1000).alias("incoming")), 2_000_000)


# --- scalar functions


_ODD_KEYS = ["", "/a", "a\\b", "c:x", "1:x", "é:x", "a/../b", "a..b/c", "x\ny", "x\ry", "a/..", "..", "\\a", "ok/key"]
_ODD_BUCKETS = ["b..c", "/b", "bucket", "", "C:x", "a\\b", "\\b", "ü:x"]
_LITERALS = {n: "[" + ", ".join("'" + x.replace("\n", "' || chr(10) || '").replace("\r", "' || chr(13) || '") + "'" for x in v) + "]" for n, v in (("k", _ODD_KEYS), ("b", _ODD_BUCKETS))}


@query(f"""SELECT i, CASE WHEN k = '' OR k LIKE '/%' OR (ascii(k) < 128 AND substr(k, 2, 1) = ':') OR list_contains(string_split(k, '/'), '..') OR contains(k, chr(10)) THEN NULL ELSE k END AS key,
  CASE WHEN b = '' OR b LIKE '/%' OR contains(b, '..') OR (ascii(b) < 128 AND substr(b, 2, 1) = ':') THEN NULL ELSE b END AS bucket FROM (
  SELECT doc_id AS i, replace({_LITERALS["k"]}[doc_id % 14 + 1], '\\', '/') AS k, replace({_LITERALS["b"]}[doc_id % 8 + 1], '\\', '/') AS b FROM documents)""")
def sanitize_keys(spark, d):
    i = F.col("doc_id")
    k, b = (F.element_at(F.array(*map(F.lit, v)), (i % len(v) + 1).cast("int")) for v in (_ODD_KEYS, _ODD_BUCKETS))
    return t.table(spark, d, "documents").select(i.alias("i"), keys.clean_key(k).alias("key"), keys.clean_bucket(b).alias("bucket"))


@query("""SELECT version, replace(replace(k, '%', '%25'), '/', '%2F') AS encoded, k AS decoded, bucket || '/' || substr(md5(k), 31, 2) || '/' || replace(replace(k, '%', '%25'), '/', '%2F') AS path FROM (SELECT version, bucket, key || '%2F' AS k FROM page_objects)""", "page_objects")
def encode_key(spark, d):
    k = F.concat("key", F.lit("%2F"))
    return t.page_objects(spark, d).select("version", keys.encode_key(k).alias("encoded"), keys.decode_key(keys.encode_key(k)).alias("decoded"), keys.blob_path(F.col("bucket"), k).alias("path"))


_NAMES = [".ZIP", ".png", ".tar.gz", "", ".pdf", ".docx", ".lz4", ".woff2", ".Opus", ".txt", ".jar", "/.gz", ".heic", ".gz/x"]
_TYPES = ["text/html", " Image/PNG ", "application/pdf", "font/ttf", "application/x-tar", "videos/x", "video", "application/json", "application/wasm"]


@query(f"""SELECT version, ext, size >= 4096 AND NOT coalesce(ext IN ('gz', 'bz2', 'rar', 'zip', '7z', 'xz', 'zst', 'lz4', 'br', 'tgz', 'jpg', 'jpeg', 'png', 'gif', 'webp', 'avif', 'heic', 'heif', 'jxl', 'mp4', 'mkv', 'mov', 'avi', 'wmv', 'flv', 'webm', 'm4v', 'mpeg', 'mpg', 'mp3', 'aac', 'ogg', 'flac', 'wma', 'm4a', 'opus', 'pdf', 'docx', 'xlsx', 'pptx', 'deb', 'rpm', 'jar', 'war', 'apk', 'woff', 'woff2'), false)
    AND NOT (split_part(ct, '/', 1) IN ('video', 'audio', 'image', 'font') OR ct IN ('application/zip', 'application/gzip', 'application/x-gzip', 'application/x-zip-compressed', 'application/x-rar-compressed', 'application/x-7z-compressed', 'application/x-bzip', 'application/x-bzip2', 'application/x-xz', 'application/zstd', 'application/x-zstd', 'application/x-tar', 'application/tar', 'application/pdf', 'application/wasm')) AS eligible FROM
  (SELECT version, size, lower(regexp_extract(key || {_NAMES!r}[version % 14 + 1], '([^/]+)\\.([^/.]+)$', 2)) AS ext, lower(trim({_TYPES!r}[version % 9 + 1])) AS ct FROM page_objects)""", "page_objects")
def compress_eligible(spark, d):
    v = F.col("version")
    name, kind = (F.element_at(F.array(*map(F.lit, x)), (v % len(x) + 1).cast("int")) for x in (_NAMES, _TYPES))
    k = F.concat("key", name)
    return t.page_objects(spark, d).select("version", keys.extension(k).alias("ext"), keys.compressible(k, F.col("size"), kind).alias("eligible"))


_HEADS = ["1F8B08", "504B0304", "504B0506", "28B52FFD", "89504E47", "FFD8FF", "47494638", "494433", "0000001866747970", "524946460000000057454250", "5249464600000000AAAAAAAA", "00", ""]


@query(f"""SELECT page_id, head IN ('1F8B08', '504B0304', '504B0506', '28B52FFD', '89504E47', 'FFD8FF', '47494638', '494433') OR (long AND head IN ('0000001866747970', '524946460000000057454250')) OR (NOT long AND head = '524946460000000057454250') AS packed
  FROM (SELECT page_id, {_HEADS!r}[page_id % 13 + 1] AS head, page_id % 2 = 0 AS long FROM pages)""")
def packed_heads(spark, d):
    i = F.col("page_id")
    head = F.unhex(F.element_at(F.array(*map(F.lit, _HEADS)), (i % 13 + 1).cast("int")))
    body = F.when(i % 2 == 0, F.concat(head, F.encode("html", "UTF-8"))).otherwise(head)
    return t.table(spark, d, "pages").select("page_id", keys.packed_magic(body).alias("packed"))


@query("""SELECT version, valid, CASE WHEN valid THEN s ELSE 0 END AS start, CASE WHEN valid THEN e - s + 1 ELSE size END AS len FROM (SELECT *, coalesce(s <= e AND s < size AND NOT (form = 2 AND n = 0), false) AS valid FROM (
  SELECT version, size, form, n, CASE form WHEN 0 THEN version * 10 WHEN 1 THEN version * 5 WHEN 2 THEN greatest(size - n, 0) WHEN 3 THEN 9 END AS s,
    CASE form WHEN 0 THEN least(version * 10 + 99, size - 1) WHEN 1 THEN size - 1 WHEN 2 THEN size - 1 WHEN 3 THEN least(4, size - 1) END AS e FROM (SELECT version, size, version % 5 AS form, version % 3 * 100 AS n FROM page_objects)))""", "page_objects")
def range_parse(spark, d):
    v = F.col("version")
    s = v.cast("string")
    h = F.when(v % 5 == 0, F.format_string("bytes=%d-%d", v * 10, v * 10 + 99)).when(v % 5 == 1, F.format_string("bytes=%d-", v * 5)).when(v % 5 == 2, F.format_string("bytes=-%d", v % 3 * 100)).when(v % 5 == 3, "bytes=9-4").otherwise(F.concat(F.lit("bytes=x"), s))
    return t.page_objects(spark, d).select("version", keys.parse_range(h, F.col("size")).alias("r")).select("version", "r.valid", "r.start", "r.len")


@query("SELECT substr(md5(key), 31, 2) AS shard, count(*) AS n FROM page_objects GROUP BY 1", "page_objects")
def shard_histogram(spark, d):
    return t.page_objects(spark, d).groupBy(keys.shard(F.col("key")).alias("shard")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, greatest(1, least(22, CAST(doc_id % 40 - 5 AS INTEGER))) AS level, greatest(10, least(27, length(bin(size)))) AS wlog,
  greatest(4096, CAST(ceil(size / 4096.0) * 4096 AS BIGINT)) AS permits, least(CAST(pow(2, least(doc_id % 15, 10)) AS BIGINT), 3600) AS backoff FROM doc_objects""", "doc_objects")
def size_functions(spark, d):
    i = F.col("doc_id")
    return t.doc_objects(spark, d).select("doc_id", keys.zstd_level((i % 40 - 5).cast("int")).alias("level"), keys.window_log(F.col("size")).cast("long").alias("wlog"), keys.permits(F.col("size"), 4096).alias("permits"), keys.backoff_seconds(i % 15).alias("backoff"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped FROM pages""")
def xml_escape(spark, d):
    return t.table(spark, d, "pages").select("page_id", keys.xml_escape(F.col("html")).alias("escaped"))


@query("""SELECT version, CASE WHEN version % 3 = 0 AND key <> '' AND bucket <> '' THEN bucket END AS src_bucket, CASE WHEN version % 3 = 0 AND key <> '' AND bucket <> '' THEN key END AS src_key FROM page_objects""", "page_objects")
def copy_source(spark, d):
    v, path = F.col("version"), F.concat_ws("/", "bucket", "key")
    h = F.when(v % 3 == 0, path).when(v % 3 == 1, F.concat(F.lit("/"), path)).otherwise(F.concat("bucket", F.when(v % 2 == 0, "/").otherwise("")))
    return t.page_objects(spark, d).select("version", keys.copy_source(h).alias("c")).select("version", F.col("c.bucket").alias("src_bucket"), F.col("c.key").alias("src_key"))


_METAS = ['{"storage-class":7,"a":"x"}', '{"storage-class":"hot","n":1.5,"o":{"storage-class":"in"}}', "[1]", "not json", '{"storage-class":null,"b":true,"c":"7"}', '{"storage-class":""}', "{}"]


@query(f"""SELECT doc_id, CASE WHEN json_valid(m) AND json_type(m, '$."storage-class"') = 'VARCHAR' THEN m ->> '$."storage-class"' END AS class FROM (SELECT doc_id, {_METAS!r}[doc_id % 7 + 1] AS m FROM documents)""")
def custom_meta_get(spark, d):
    m = F.element_at(F.array(*map(F.lit, _METAS)), (F.col("doc_id") % 7 + 1).cast("int"))
    return t.table(spark, d, "documents").select("doc_id", keys.meta_get(m, "storage-class").alias("class"))


@query(r"""SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN '{"class":"' || ['cold', 'a\\b', 'q\"'][doc_id % 4] || '"}' END AS meta FROM documents""")
def custom_meta_build(spark, d):
    i = F.col("doc_id")
    value = F.when(i % 4 == 1, "cold").when(i % 4 == 2, "a\\b").otherwise('q"')
    fields = F.when(i % 4 > 0, F.create_map(F.lit("class"), value)).otherwise(F.create_map().cast("map<string,string>"))
    return t.table(spark, d, "documents").select("doc_id", keys.meta_build(fields).alias("meta"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a' || event_id WHEN 1 THEN 'b' ELSE NULL END AS tag, CASE event_id % 2 WHEN 0 THEN 'gz,zip' ELSE 'png' END AS exts FROM events")
def header_lists(spark, d):
    e = F.col("event_id")
    tag = F.when(e % 3 == 0, F.concat(F.lit('"a'), e.cast("string"), F.lit('", "z"'))).when(e % 3 == 1, "b").otherwise("")
    exts = F.when(e % 2 == 0, " .GZ, zip,, ").otherwise("..png")
    return t.table(spark, d, "events").select("event_id", keys.etag_token(tag).alias("tag"), F.array_join(keys.extension_list(exts), ",").alias("exts"))


@query(f"""SELECT doc_id, f AS field, m ->> ('$."' || f || '"') AS value FROM (SELECT doc_id, m, unnest(json_keys(m)) AS f FROM (SELECT doc_id, CASE WHEN m[1] = '{{' THEN m END AS m FROM (SELECT doc_id, {_METAS!r}[doc_id % 7 + 1] AS m FROM documents)))
  WHERE json_type(m, '$."' || f || '"') = 'VARCHAR'""")
def custom_meta_explode(spark, d):
    m = F.element_at(F.array(*map(F.lit, _METAS)), (F.col("doc_id") % 7 + 1).cast("int"))
    return t.table(spark, d, "documents").select("doc_id", F.explode(keys.meta_strings(m)).alias("field", "value"))


@query("""SELECT event_id, strftime(u, '%a, %-d %b %Y %H:%M:%S +0000') AS mail, strftime(u, '%Y-%m-%dT%H:%M:%S.000Z') AS iso, CASE event_id % 8 WHEN 6 THEN s - s % 60 WHEN 7 THEN NULL ELSE s END AS back
  FROM (SELECT event_id, s, to_timestamp(s) AT TIME ZONE 'UTC' AS u FROM (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events))""")
def http_dates(spark, d):
    e = t.table(spark, d, "events").select("event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"))
    e = e.select("event_id", "s", keys.http_date(F.col("s")).alias("mail"), keys.iso_date(F.col("s")).alias("iso"))
    i = F.col("event_id") % 8
    bare = F.regexp_replace("mail", "^[A-Za-z]{3}, ", "")
    later, earlier = keys.http_date(F.col("s") + 7200), keys.http_date(F.col("s") - 18000)
    asked = F.when(i == 0, F.col("mail")).when(i == 1, F.regexp_replace("mail", r"\+0000", "GMT")).when(i == 2, F.regexp_replace(later, r"\+0000", "+0200"))
    asked = asked.when(i == 3, F.regexp_replace(earlier, r"\+0000", "EST")).when(i == 4, bare).when(i == 5, F.regexp_replace(keys.iso_date(F.col("s") + 7200), "Z$", "+02:00"))
    asked = asked.when(i == 6, F.regexp_replace(bare, r":\d\d \+", " +")).otherwise(F.concat("mail", F.lit("?")))
    return e.select("event_id", "mail", "iso", keys.parse_http_date(asked).alias("back"))


_XML_PAGE = """SELECT *, count(*) OVER () AS n FROM (SELECT replace(key, 'e', '&') AS entry, size, etag, updated_at FROM doc_objects WHERE bucket = 'src1' AND key LIKE 'en/%' AND deleted_at IS NULL) ORDER BY entry LIMIT 20"""


@query(f"""SELECT '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<ListBucketResult xmlns="http://s3.amazonaws.com/doc/2006-03-01/">' || chr(10) || '  <Name>src1</Name>' || chr(10) || '  <Prefix>&amp;n/</Prefix>' || chr(10)
  || '  <MaxKeys>' || count(*) || '</MaxKeys>' || chr(10) || '  <IsTruncated>' || (max(n) > 20) || '</IsTruncated>' || chr(10) || CASE WHEN max(n) > 20 THEN '  <NextContinuationToken>' || replace(max(entry), '&', '&amp;') || '</NextContinuationToken>' || chr(10) ELSE '' END
  || '  <KeyCount>' || count(*) || '</KeyCount>' || chr(10) || string_agg('  <Contents>' || chr(10) || '    <Key>' || replace(entry, '&', '&amp;') || '</Key>' || chr(10) || '    <ETag>"' || etag || '"</ETag>' || chr(10) || '    <Size>' || size || '</Size>' || chr(10)
    || '    <LastModified>' || strftime(to_timestamp(updated_at) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.000Z') || '</LastModified>' || chr(10) || '  </Contents>' || chr(10), '' ORDER BY entry) || '</ListBucketResult>' || chr(10) AS xml FROM ({_XML_PAGE})""", "doc_objects")
def list_xml(spark, d):
    o = t.doc_objects(spark, d).withColumn("key", F.replace("key", F.lit("e"), F.lit("&")))  # keys to escape
    page = listing.list_objects(o, "src1", prefix="&n/", limit=20).select(F.lit("item").alias("kind"), F.col("key").alias("entry"), "size", "etag", "updated_at", "truncated", "next_cursor")
    return listing.page_xml(page, "src1", "&n/")


@query("""SELECT event_id, CAST(props ->> '$.k' AS INTEGER) AS k, '{"k":' || (props ->> '$.k') || '}' AS again FROM events""")
def config_json(spark, d):
    c = t.table(spark, d, "events").select("event_id", F.from_json("props", "k int").alias("c"))
    return c.select("event_id", "c.k", F.to_json("c").alias("again"))


@query("SELECT origin_node, count(*) AS n FROM doc_objects WHERE deleted_at IS NULL AND key LIKE 'en/%' GROUP BY 1", "doc_objects")
def node_local_counts(spark, d):
    return listing.under(listing.active(t.doc_objects(spark, d)), prefix="en/").groupBy("origin_node").agg(F.count("*").alias("n"))


@query()
def shard_paths(spark, d):
    """The shard folder of each key and whether a scrub of one in sixteen takes it, both by XXH3."""
    return t.page_objects(spark, d).select("version", "bucket", "key", keys.shard_xxh3()("key").alias("shard"), keys.sampled_xxh3(16)("bucket", "key").alias("sampled"))


# --- multipart


@query("""SELECT upload_id, bytes, (SELECT sum(size) FROM doc_objects WHERE deleted_at IS NULL) + bytes <= 40000000 AS accepted
  FROM (SELECT u.upload_id, CAST(sum(p.size) * 5000 AS BIGINT) AS bytes FROM multipart_uploads u JOIN latest_parts p USING (upload_id) GROUP BY 1)""", "doc_objects", "multipart_uploads", "multipart_parts", "latest_parts")
def multipart_quota(spark, d):
    o = t.doc_objects(spark, d)
    sizes = multipart.summary(t.multipart_uploads(spark, d), t.multipart_parts(spark, d)).where("n_parts > 0").withColumn("bytes", F.col("bytes") * 5000)
    return catalog.multipart_quota(o, sizes, 40_000_000)


@query("""SELECT u.upload_id, u.bucket, u.key, count(p.part_number) AS n_parts, CAST(coalesce(sum(p.size), 0) AS BIGINT) AS bytes FROM multipart_uploads u LEFT JOIN latest_parts p USING (upload_id) GROUP BY ALL""", "multipart_uploads", "multipart_parts", "latest_parts")
def multipart_summary(spark, d):
    return multipart.summary(t.multipart_uploads(spark, d), t.multipart_parts(spark, d))


@query("SELECT upload_id, part_number, size, written_at FROM latest_parts", "multipart_parts", "latest_parts")
def parts_latest(spark, d):
    return multipart.latest_parts(t.multipart_parts(spark, d))


@query("""SELECT upload_id, string_agg(part_number, ',' ORDER BY part_number) AS parts, string_agg(start, ',' ORDER BY part_number) AS offsets, CAST(sum(size) AS BIGINT) AS bytes FROM (
  SELECT *, CAST(sum(size) OVER (PARTITION BY upload_id ORDER BY part_number) - size AS BIGINT) AS start FROM latest_parts) GROUP BY upload_id""", "multipart_parts", "latest_parts")
def assemble_order(spark, d):
    return multipart.manifest(t.multipart_parts(spark, d))


@query("""SELECT u.upload_id, u.bucket, u.key, CAST(length(body) AS BIGINT) AS size, md5(body) AS etag, CAST(1706659200 AS BIGINT) AS updated_at FROM multipart_uploads u JOIN (
  SELECT upload_id, string_agg(repeat(CAST(part_number AS VARCHAR), CAST(size AS INTEGER)), '' ORDER BY part_number) AS body FROM (SELECT upload_id, part_number, arg_max(size, (written_at, size)) AS size FROM multipart_parts GROUP BY ALL) GROUP BY 1) USING (upload_id)""", "multipart_uploads", "multipart_parts")
def multipart_complete(spark, d):
    """Objects of uploads whose parts are their own numbers, repeated to the part's size."""
    body = F.encode(F.repeat(F.col("part_number").cast("string"), F.col("size").cast("int")), "UTF-8")
    return multipart.complete(t.multipart_uploads(spark, d), t.multipart_parts(spark, d).withColumn("body", body), NOW)


@query("SELECT upload_id, bucket, key FROM multipart_uploads WHERE created_at < 1706659200 - 200000000", "multipart_uploads")
def stale_uploads(spark, d):
    return multipart.stale(t.multipart_uploads(spark, d), NOW, 200_000_000).select("upload_id", "bucket", "key")


@query("SELECT upload_id FROM multipart_uploads WHERE expires_at < 1706659200 - 150000000", "multipart_uploads")
def expired_uploads(spark, d):
    return multipart.stale(t.multipart_uploads(spark, d), NOW - 150_000_000).select("upload_id")


@query("""SELECT CAST(i AS VARCHAR) AS upload_id, CASE WHEN u.upload_id IS NULL THEN 'missing' WHEN i % 2 = 0 THEN 'ok' ELSE 'wrong_target' END AS verdict FROM (SELECT o_orderkey * 2 AS i, o_orderkey FROM orders) r LEFT JOIN multipart_uploads u ON u.upload_id = CAST(i AS VARCHAR)""", "multipart_uploads")
def session_check(spark, d):
    u = t.multipart_uploads(spark, d)
    i = F.col("o_orderkey") * 2
    req = t.table(spark, d, "orders").select(i.cast("string").alias("upload_id")).join(u.select("upload_id", "bucket", "key"), "upload_id", "left")
    return multipart.owned(u, req)


# --- blocks


def doc_blocks(spark: SparkSession, d: str, size: int = BLOCK) -> DataFrame:
    """Blocks of the bytes of all documents."""
    docs = t.table(spark, d, "documents").select(F.col("source").alias("bucket"), F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("key"), "text")
    return blocks.chunk(docs, F.encode("text", "UTF-8"), size)


@query("SELECT block_hash, count(*) AS refcount, max(size) AS size FROM doc_blocks GROUP BY block_hash", "doc_blocks")
def block_refcounts(spark, d):
    return blocks.refcounts(doc_blocks(spark, d))


@query("""SELECT *, logical_bytes - stored_bytes AS saved_bytes FROM (SELECT CAST(sum(n * size) AS BIGINT) AS logical_bytes, CAST(sum(size) AS BIGINT) AS stored_bytes, count(*) AS blocks, CAST(sum(n) AS BIGINT) AS refs FROM (SELECT block_hash, count(*) AS n, max(size) AS size FROM doc_blocks GROUP BY 1))""", "doc_blocks")
def dedup_savings(spark, d):
    return blocks.savings(doc_blocks(spark, d))


@query("""SELECT block_hash, CAST(sum(x) AS BIGINT) AS refcount FROM (SELECT block_hash, 1 AS x FROM doc_blocks UNION ALL SELECT block_hash, 1 FROM doc_blocks WHERE block_idx = 0 UNION ALL SELECT block_hash, -1 FROM doc_blocks WHERE block_idx = 1) GROUP BY 1 HAVING sum(x) > 0""", "doc_blocks")
def refcount_delta(spark, d):
    b = doc_blocks(spark, d).select("block_idx", "block_hash", "size")
    return blocks.apply_deltas(blocks.refcounts(b), b.where("block_idx = 0"), b.where("block_idx = 1")).select("block_hash", "refcount")


@query("""SELECT block_hash, count(*) AS refcount, max(size) AS size FROM (SELECT md5(array_slice(body, i * 1024 + 1, i * 1024 + 1024)) AS block_hash, CAST(least(1024, n - i * 1024) AS INTEGER) AS size FROM (
  SELECT body, octet_length(body) AS n, unnest(range(0, CAST(ceil(octet_length(body) / 1024.0) AS BIGINT))) AS i FROM (SELECT encode(text || CASE WHEN doc_id % 4 = 0 THEN '+' ELSE '' END) AS body FROM documents))) GROUP BY block_hash""")
def finalize_refs(spark, d):
    """References after a quarter of the documents are written again, a byte longer."""
    new = t.table(spark, d, "documents").where("doc_id % 4 = 0").select(F.col("source").alias("bucket"), F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("key"), F.concat("text", F.lit("+")).alias("text"))
    return blocks.finalize(doc_blocks(spark, d).drop("body"), blocks.chunk(new, F.encode("text", "UTF-8"), BLOCK).drop("body"))


@query("SELECT block_hash, CAST(count(*) + count(*) FILTER (bucket <> 'src1') AS BIGINT) AS refcount, max(size) AS size FROM doc_blocks GROUP BY block_hash", "doc_blocks")
def copied_refs(spark, d):
    """References after all objects of all buckets but one are copied to a new one."""
    refs = doc_blocks(spark, d).drop("body")
    req = t.doc_objects(spark, d).where("bucket <> 'src1'").select("bucket", "key", F.lit("copies").alias("to_bucket"), F.concat_ws("/", "bucket", "key").alias("to_key"))
    return blocks.finalize(refs, blocks.copy_refs(refs, req))


@query("SELECT source AS bucket, lang || '/' || doc_id AS key, md5(text) AS etag, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents WHERE text <> ''")
def object_etags(spark, d):
    return blocks.object_etags(doc_blocks(spark, d))


@query("""SELECT bucket, key, block_idx, CAST(e - size AS BIGINT) AS logical_start, CAST(e AS BIGINT) AS logical_end FROM (SELECT *, sum(size) OVER (PARTITION BY bucket, key ORDER BY block_idx) AS e FROM doc_blocks)""", "doc_blocks")
def block_offsets(spark, d):
    return blocks.offsets(doc_blocks(spark, d).drop("body")).select("bucket", "key", "block_idx", "logical_start", "logical_end")


@query("""SELECT bucket, key, bool_and(block_idx = rn - 1 AND e > p) AS valid FROM (SELECT *, row_number() OVER w AS rn, coalesce(lag(e) OVER w, 0) AS p FROM
  (SELECT bucket, key, block_idx, sum(size) OVER (PARTITION BY bucket, key ORDER BY block_idx) - CASE WHEN bucket = 'src1' AND block_idx = 2 THEN 5000 ELSE 0 END AS e FROM doc_blocks) WINDOW w AS (PARTITION BY bucket, key ORDER BY block_idx)) GROUP BY ALL""", "doc_blocks")
def block_index_valid(spark, d):
    i = blocks.offsets(doc_blocks(spark, d).drop("body"))
    return blocks.index_valid(i.withColumn("logical_end", F.col("logical_end") - F.when((F.col("bucket") == "src1") & (F.col("block_idx") == 2), 5000).otherwise(0)))


@query("""SELECT bucket, key, block_idx, CAST(greatest(1500 - s, 0) AS BIGINT) AS skip, CAST(least(e, 3100) - s - greatest(1500 - s, 0) AS BIGINT) AS take FROM (
  SELECT *, e - size AS s FROM (SELECT *, sum(size) OVER (PARTITION BY bucket, key ORDER BY block_idx) AS e FROM doc_blocks)) WHERE s < 3100 AND e > 1500""", "doc_blocks")
def range_blocks(spark, d):
    return blocks.overlapping(blocks.offsets(doc_blocks(spark, d).drop("body")), 1500, 3100).select("bucket", "key", "block_idx", "skip", "take")


@query("""SELECT source AS bucket, lang || '/' || doc_id AS key, lower(hex(array_slice(encode(text), 1501, 3100))) AS body_hex FROM documents WHERE octet_length(encode(text)) > 1500""")
def read_range(spark, d):
    b = doc_blocks(spark, d)
    return blocks.read_range(blocks.offsets(b.drop("body")), b, 1500, 3100).select("bucket", "key", F.lower(F.hex("body")).alias("body_hex"))


@query("SELECT bucket, key, block_idx, NOT (block_idx = 3) AS intact FROM doc_blocks", "doc_blocks")
def block_checksum_verify(spark, d):
    b = doc_blocks(spark, d)
    b = b.withColumn("body", F.when(F.col("block_idx") == 3, F.concat("body", F.lit(b"x"))).otherwise(F.col("body")))
    return blocks.verify(b).select("bucket", "key", "block_idx", "intact")


@query("SELECT md5(text) AS etag, count(*) AS copies, min(doc_id) AS keep FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_objects(spark, d):
    return t.doc_objects(spark, d).groupBy("etag").agg(F.count("*").alias("copies"), F.min("doc_id").alias("keep")).where("copies > 1")


@query()
def block_compression(spark, d):
    return blocks.compress_sizes(doc_blocks(spark, d, 4096))


@query()
def dictionary_compression(spark, d):
    """Sizes of small blocks with a dictionary of a sample of them."""
    b = doc_blocks(spark, d, 4096)
    return blocks.compress_sizes(b, dictionary=blocks.train_dictionary(b, 16 << 10))


@query()
def xxh3_etag(spark, d):
    return t.table(spark, d, "documents").select("doc_id", keys.xxh3_hex()(F.encode("text", "UTF-8")).alias("etag"))


@query("SELECT page_id, url_decode(url || '%2Fc%C3%a9+%zz%%41%4') AS decoded FROM pages")
def percent_decode(spark, d):
    """Addresses with escapes behind them, whole and malformed ones."""
    return t.table(spark, d, "pages").select("page_id", keys.percent_decode()(F.concat("url", F.lit("%2Fc%C3%a9+%zz%%41%4"))).alias("decoded"))


# --- reconcile and scrub


@query("SELECT bucket, key, bytes FROM doc_blobs b ANTI JOIN (SELECT bucket, key FROM doc_objects WHERE deleted_at IS NULL) o USING (bucket, key)", "doc_objects", "doc_blobs")
def orphans(spark, d):
    return reconcile.orphans(t.doc_objects(spark, d), t.doc_blobs(spark, d)).select("bucket", "key", "bytes")


@query("SELECT bucket, key, bytes FROM doc_blobs b ANTI JOIN doc_objects o USING (bucket, key)", "doc_objects", "doc_blobs")
def orphans_without_tombstones(spark, d):
    return reconcile.orphans(t.doc_objects(spark, d), t.doc_blobs(spark, d), include_tombstones=True).select("bucket", "key", "bytes")


@query("SELECT count(*) AS removed, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes FROM doc_blobs b ANTI JOIN (SELECT bucket, key FROM doc_objects WHERE deleted_at IS NULL) o USING (bucket, key)", "doc_objects", "doc_blobs")
def orphan_gc(spark, d):
    return reconcile.orphans(t.doc_objects(spark, d), t.doc_blobs(spark, d)).agg(F.count("*").alias("removed"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))


@query("SELECT bucket, key FROM doc_objects o ANTI JOIN doc_blobs b USING (bucket, key) WHERE o.deleted_at IS NULL", "doc_objects", "doc_blobs")
def stale_rows(spark, d):
    return reconcile.stale_rows(t.doc_objects(spark, d), t.doc_blobs(spark, d)).select("bucket", "key")


_PAYLOADS = "SELECT DISTINCT 'b' || (user_id % 4) AS bucket, 'data/' || user_id AS key FROM events WHERE event_id % 3 = 0"


def _payloads(spark, d):
    return t.table(spark, d, "events").where("event_id % 3 = 0").select(F.concat(F.lit("b"), (F.col("user_id") % 4).cast("string")).alias("bucket"), F.concat(F.lit("data/"), F.col("user_id").cast("string")).alias("key")).distinct()


@query(f"SELECT event_id, bucket, key FROM replication_log l ANTI JOIN ({_PAYLOADS}) p USING (bucket, key) WHERE status = 'pending' AND op = 'put'", "replication_log")
def missing_payload(spark, d):
    return reconcile.missing_payloads(t.replication_log(spark, d), _payloads(spark, d)).select("event_id", "bucket", "key")


@query("""SELECT (SELECT count(*) FROM doc_objects o ANTI JOIN doc_blobs b USING (bucket, key) WHERE o.deleted_at IS NULL) AS stale_rows, g.orphan_files, g.orphan_bytes,
  (SELECT count(*) FROM replication_log WHERE status = 'pending') AS pending_events, (SELECT count(*) FROM replication_log l ANTI JOIN doc_blobs b USING (bucket, key) WHERE status = 'pending' AND op = 'put') AS missing_payloads
  FROM (SELECT count(*) AS orphan_files, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS orphan_bytes FROM doc_blobs b ANTI JOIN (SELECT bucket, key FROM doc_objects WHERE deleted_at IS NULL) o USING (bucket, key)) g""", "doc_objects", "doc_blobs", "replication_log")
def reconcile_report(spark, d):
    return reconcile.report(t.doc_objects(spark, d), t.doc_blobs(spark, d), t.replication_log(spark, d))


@query("SELECT bucket, key FROM doc_objects WHERE CAST('0x' || substr(md5(bucket || '/' || key), 1, 8) AS BIGINT) % 16 = 0", "doc_objects")
def scrub_sample(spark, d):
    return t.doc_objects(spark, d).where(keys.sampled(F.col("bucket"), F.col("key"), 16)).select("bucket", "key")


_STORED = "SELECT bucket, key, CASE WHEN doc_id % 13 = 0 THEN 'bad' ELSE etag END AS stored_etag FROM doc_objects WHERE doc_id % 17 <> 0"
_VERDICT = f"""SELECT o.bucket, o.key, CASE WHEN s.stored_etag IS NULL THEN 'missing' WHEN s.stored_etag = o.etag THEN 'ok' ELSE 'corrupted' END AS verdict
  FROM doc_objects o LEFT JOIN ({_STORED}) s USING (bucket, key) WHERE o.deleted_at IS NULL AND CAST('0x' || substr(md5(o.bucket || '/' || o.key), 1, 8) AS BIGINT) % 4 = 0"""


def _stored(o):
    return o.where("doc_id % 17 <> 0").select("bucket", "key", F.when(F.col("doc_id") % 13 == 0, "bad").otherwise(F.col("etag")).alias("stored_etag"))


@query(f"SELECT (SELECT count(*) FROM doc_objects WHERE deleted_at IS NULL) AS scanned, (SELECT count(*) FROM doc_objects WHERE deleted_at IS NULL) - count(*) AS sampled_out, count(*) FILTER (verdict = 'ok') AS verified, count(*) FILTER (verdict = 'corrupted') AS corrupted, count(*) FILTER (verdict = 'missing') AS missing FROM ({_VERDICT})", "doc_objects")
def scrub_report(spark, d):
    o = t.doc_objects(spark, d)
    return reconcile.scrub_report(o, _stored(o), 4)


@query(f"""SELECT v.bucket, v.key, v.verdict, r.source_node, r.source_node IS NOT NULL AS healed FROM ({_VERDICT}) v LEFT JOIN (SELECT bucket, key, min('n' || (doc_id % 3)) AS source_node FROM doc_objects WHERE doc_id % 2 = 0 GROUP BY ALL) r USING (bucket, key) WHERE v.verdict <> 'ok'""", "doc_objects")
def scrub_heal(spark, d):
    o = t.doc_objects(spark, d)
    replicas = o.where("doc_id % 2 = 0").select("bucket", "key", F.concat(F.lit("n"), (F.col("doc_id") % 3).cast("string")).alias("node_id"))
    return reconcile.heal(reconcile.scrub(o, _stored(o), 4), replicas)


@query("SELECT bucket, key FROM doc_objects WHERE deleted_at IS NULL ORDER BY key, bucket LIMIT 25", "doc_objects")
def scrub_page_wrapped(spark, d):
    return reconcile.scrub_page(t.doc_objects(spark, d), 25, ("~", "")).select("bucket", "key")


@query("SELECT bucket, key FROM doc_objects WHERE deleted_at IS NULL AND (key > 'en/5' OR (key = 'en/5' AND bucket > '')) ORDER BY key, bucket LIMIT 25", "doc_objects")
def scrub_page_next(spark, d):
    return reconcile.scrub_page(t.doc_objects(spark, d), 25, ("en/5", "")).select("bucket", "key")


_MAGICS = ["4E4F5349", "4E4F5342", "4E4F535A", "4E4F5332", "4E4F5344", "1F8B0800", "", "4E4F5349"]


def containers(spark: SparkSession, d: str) -> DataFrame:
    """Pages with a container's header before them, or nothing else behind a short one: magic, logical size 70000 + id,
    block size 1 MiB, no blocks, dictionary id % 3, level id % 30 where the flag is set for even ids."""
    i = F.col("page_id")
    le = lambda c, n: F.unhex(F.substring(F.concat(*[F.lpad(F.hex(F.shiftright(c, 8 * k).bitwiseAND(255)), 2, "0") for k in range(n)]), 1, 2 * n))
    magic = F.unhex(F.element_at(F.array(*map(F.lit, _MAGICS)), (i % 8 + 1).cast("int")))
    flags = F.when(i % 2 == 0, 0x8000).otherwise(1).cast("long")
    head = F.concat(magic, le((i + 70000).cast("long"), 8), le(F.lit(1 << 20).cast("long"), 4), le(F.lit(0).cast("long"), 4), le(i % 3, 2), le(flags, 2), le(i % 30, 1))
    short = F.element_at(F.array(*map(F.lit, (11, 12, 15, 16, 24, 25, 3, 0))), (F.floor(i / 8) % 8 + 1).cast("int"))
    body = F.when(i % 5 == 0, F.substring(head, F.lit(1), short)).otherwise(F.concat(head, F.encode("html", "UTF-8")))
    return t.table(spark, d, "pages").select(F.lit("p").alias("bucket"), i.cast("string").alias("key"), body.alias("body"))


_CONTAINERS = """(SELECT *, CASE WHEN m IN (0, 7) AND n >= 12 THEN 'indexed' WHEN m = 1 AND n >= 12 THEN 'blocks' WHEN m = 2 AND n >= 12 THEN 'packed' WHEN m = 3 AND n >= 16 THEN 'packed2' WHEN m = 4 AND n >= 16 THEN 'refs' ELSE 'raw' END AS format
  FROM (SELECT page_id AS i, page_id % 8 AS m, CASE WHEN page_id % 5 = 0 THEN [11, 12, 15, 16, 24, 25, 3, 0][CAST(page_id // 8 AS BIGINT) % 8 + 1] ELSE 1000 END AS n FROM pages))"""
_HEADER = f"""(SELECT i, format, CASE WHEN format <> 'raw' THEN 70000 + i END AS logical_size, CASE WHEN format IN ('indexed', 'blocks') AND n >= 16 THEN 1048576 END AS block_size, CASE WHEN format = 'indexed' AND n >= 22 THEN i % 3 END AS dict_id,
  CASE WHEN format = 'indexed' AND n >= 24 THEN CASE WHEN i % 2 = 0 THEN 32768 ELSE 1 END END AS flags, CASE WHEN format = 'indexed' AND n >= 24 THEN CASE WHEN i % 2 = 0 AND n >= 25 THEN i % 30 ELSE 0 END END AS zstd_level FROM {_CONTAINERS})"""


@query(f"SELECT 'p' AS bucket, CAST(i AS VARCHAR) AS key, format FROM {_CONTAINERS}")
def format_sniff(spark, d):
    return reconcile.sniff(containers(spark, d))


@query(f"SELECT i AS page_id, * EXCLUDE (i) FROM {_HEADER}")
def container_headers(spark, d):
    return reconcile.headers(containers(spark, d)).drop("bucket").withColumnRenamed("key", "page_id").withColumn("page_id", F.col("page_id").cast("long"))


@query(f"SELECT i AS page_id, format, format = 'blocks' OR (format = 'indexed' AND (coalesce(zstd_level, 0) < 22 OR dict_id = 0)) AS upgrade FROM {_HEADER}")
def recompress_plan(spark, d):
    return reconcile.recompress_plan(containers(spark, d), 22, True, 2).select(F.col("key").cast("long").alias("page_id"), "format", "upgrade")


_LENGTHS = """(SELECT i, format, n AS marked, CASE WHEN n < 1000 THEN least(n, hl) ELSE hl + octet_length(encode(html)) END AS n FROM (SELECT *, CASE WHEN m = 6 THEN 21 ELSE 25 END AS hl FROM """ + _CONTAINERS + """ JOIN pages ON page_id = i))"""


@query(f"""SELECT page_id, format, CAST(intact AS VARCHAR) AS intact FROM (SELECT i AS page_id, format, CASE WHEN i % 4 < 3 THEN CASE WHEN format = 'raw' THEN i % 4 = 1 WHEN format IN ('indexed', 'blocks') THEN marked >= 16 AND i % 4 = 0 ELSE n > 8 END END AS intact FROM {_LENGTHS})""")
def scrub_light(spark, d):
    """Containers against sizes of which a quarter is the header's, a quarter the content's length, and a quarter unknown."""
    c = containers(spark, d)
    i = F.col("key").cast("long")
    size = F.when(i % 4 == 0, i + 70000).when(i % 4 == 1, F.octet_length("body")).otherwise(-1)
    checked = reconcile.light_check(c, c.where(i % 4 < 3).select("bucket", "key", size.cast("long").alias("size")))
    return checked.select(i.alias("page_id"), "format", F.col("intact").cast("string").alias("intact"))


_FILES = """(SELECT doc_id, doc_id % 7 <> 0 AS found, doc_id % 3 = 1 AS nested, doc_id % 11 <> 0 AS readable, CASE doc_id % 4 WHEN 0 THEN 'raw' WHEN 1 THEN 'blocks' ELSE 'indexed' END AS format, bucket, key FROM doc_objects WHERE deleted_at IS NULL)"""
_ACTION = f"""(SELECT *, CASE WHEN NOT found THEN 'skipped' WHEN NOT readable THEN 'failed' WHEN format = 'blocks' OR (format = 'raw' AND nested) THEN 'reencode' WHEN nested THEN 'relocate' ELSE 'skipped' END AS action,
  bucket || '/' || substr(md5(key), 31, 2) || '/' AS folder FROM {_FILES})"""


def _migration(spark, d):
    """Files of six in seven objects: a third of them nested, some twice, some unreadable, in three formats."""
    o = listing.active(t.doc_objects(spark, d))
    i, b, k = F.col("doc_id"), F.col("bucket"), F.col("key")
    kind = F.when(i % 4 == 0, "raw").when(i % 4 == 1, "blocks").otherwise("indexed")
    files = o.where(i % 7 != 0).select(F.when(i % 3 == 1, keys.nested_path(b, k)).otherwise(keys.blob_path(b, k)).alias("path"), (i % 11 != 0).alias("readable"), kind.alias("format"), (i % 4 == 1).alias("upgrade"))
    twice = o.where((i % 7 != 0) & (i % 3 == 2)).select(keys.nested_path(b, k).alias("path"), F.lit(False).alias("readable"), F.lit("raw").alias("format"), F.lit(True).alias("upgrade"))
    return reconcile.migration_plan(o, files.unionByName(twice))


@query(f"""SELECT bucket, key, action, CASE WHEN found THEN folder || CASE WHEN action = 'failed' AND nested THEN key ELSE replace(key, '/', '%2F') END END AS path FROM {_ACTION}""", "doc_objects")
def migration_plan(spark, d):
    return _migration(spark, d)


@query(f"SELECT count(*) AS scanned, count(*) FILTER (action IN ('relocate', 'reencode')) AS migrated, count(*) FILTER (action = 'skipped') AS skipped, count(*) FILTER (action = 'failed') AS failed FROM {_ACTION}", "doc_objects")
def migration_report(spark, d):
    return reconcile.migration_report(_migration(spark, d))


@query(f"""SELECT count(*) AS scanned, count(*) FILTER (up AND i % 6 <> 0) AS recompressed, count(*) FILTER (NOT (up AND i % 6 <> 0)) AS skipped, CAST(coalesce(sum(i % 100 - 30) FILTER (up AND i % 6 <> 0), 0) AS BIGINT) AS bytes_saved
  FROM (SELECT i, format = 'blocks' OR (format = 'indexed' AND (coalesce(zstd_level, 0) < 22 OR dict_id = 0)) AS up FROM {_HEADER})""")
def recompress_report(spark, d):
    c = containers(spark, d)
    i = F.col("key").cast("long")
    sizes = c.select("bucket", "key", (i % 100).alias("old_size"), F.when(i % 6 != 0, F.lit(30).cast("long")).alias("new_size"))
    return reconcile.recompress_report(reconcile.recompress_plan(c, 22, True, 2), sizes)


@query("""SELECT version, substr(md5(key), 31, 2) || '/' || CASE WHEN version % 2 = 0 AND contains(key, '/') THEN key ELSE replace(replace(key, '%', '%25'), '/', '%2F') END AS rel, key FROM page_objects""", "page_objects")
def path_keys(spark, d):
    """Keys from paths below their bucket, of both layouts."""
    b, k = F.col("bucket"), F.col("key")
    path = F.when(F.col("version") % 2 == 0, F.coalesce(keys.nested_path(b, k), keys.blob_path(b, k))).otherwise(keys.blob_path(b, k))
    rel = F.substring(path, F.length(b) + 2, F.length(path))
    return t.page_objects(spark, d).select("version", rel.alias("rel"), keys.key_of_path(rel).alias("key"))


# --- placement

_RULES = """CASE WHEN key LIKE 'de/%' AND size >= 4000 THEN 0 WHEN key LIKE '%0' AND mime_type LIKE 'text/%' THEN 1 WHEN mime_type LIKE 'application/%' THEN 2 ELSE 3 END"""
_CLASS = "['archive', 'hot', 'cold', 'default'][r + 1]"


@query(f"SELECT bucket, key, r AS rule_idx, {_CLASS} AS rule_class FROM (SELECT *, {_RULES} AS r FROM doc_objects)", "doc_objects")
def placement_rules(spark, d):
    return placement.first_rule(t.doc_objects(spark, d), t.rules(spark)).select("bucket", "key", "rule_idx", "rule_class")


@query(f"SELECT bucket, key, r AS rule_idx, {_CLASS} AS rule_class FROM (SELECT *, {_RULES} AS r FROM doc_objects)", "doc_objects")
def placement_rules_join(spark, d):
    return placement.first_rule_join(t.doc_objects(spark, d), t.rules(spark))


@query(f"""SELECT bucket, key, coalesce(CASE WHEN doc_id % 10 = 0 THEN 'header' END, CASE WHEN doc_id % 6 = 0 THEN 'hot' END, {_CLASS}) AS storage_class FROM (SELECT *, {_RULES} AS r FROM doc_objects)""", "doc_objects")
def placement_resolve(spark, d):
    o = placement.first_rule(t.doc_objects(spark, d), t.rules(spark))
    header = F.when(F.col("doc_id") % 10 == 0, "header").otherwise("")
    return o.select("bucket", "key", placement.resolve_class(header, keys.meta_get(F.col("custom_meta"), "storage-class"), F.col("rule_class")).alias("storage_class"))


@query("""SELECT * FROM (VALUES ('archive', 'node2'), ('hot', 'node1'), ('cold', (SELECT min(n_name) FROM nation WHERE n_name <> 'ALGERIA')), ('default', 'node0')) v(storage_class, node)""")
def placement_node(spark, d):
    return placement.class_nodes(t.rules(spark), t.peers(spark, d), "ALGERIA")


@query(f"""SELECT bucket, key, CASE WHEN r IN (0, 3) THEN 'local' ELSE 'forward' END AS gate FROM (SELECT *, {_RULES} AS r FROM doc_objects)""", "doc_objects")
def placement_gate(spark, d):
    nodes = placement.class_nodes(t.rules(spark), t.peers(spark, d), "ALGERIA").withColumnRenamed("storage_class", "rule_class")
    o = placement.first_rule(t.doc_objects(spark, d), t.rules(spark)).join(F.broadcast(nodes), "rule_class", "left")
    return o.select("bucket", "key", placement.gate(F.col("rule_class"), ["default", "archive"], F.col("node"), True).alias("gate"))


@query(f"""SELECT bucket, key, c AS storage_class, c IN ('default', 'archive') AS accept_local, CASE WHEN c NOT IN ('default', 'archive') THEN CASE c WHEN 'hot' THEN 'node1' ELSE (SELECT min(n_name) FROM nation WHERE n_name <> 'ALGERIA') END END AS assigned_node
  FROM (SELECT bucket, key, coalesce(CASE WHEN doc_id % 10 = 0 THEN 'header' END, CASE WHEN doc_id % 6 = 0 THEN 'hot' END, {_CLASS}) AS c FROM (SELECT *, {_RULES} AS r FROM doc_objects))""", "doc_objects")
def placement_preview(spark, d):
    header = F.when(F.col("doc_id") % 10 == 0, "header").otherwise("")
    return placement.resolution(t.doc_objects(spark, d), t.rules(spark), t.peers(spark, d), "ALGERIA", ["default", "archive"], header, keys.meta_get(F.col("custom_meta"), "storage-class"))


@query("""SELECT 'user' || (doc_id % 5) AS subject, bucket, (doc_id % 5) < 2 AND bucket IN ('src0', 'src1', 'src2') AS allowed FROM doc_objects""", "doc_objects")
def bucket_policy(spark, d):
    pol = spark.createDataFrame([(f"user{u}", f"src{b}") for u in (0, 1) for b in (0, 1, 2)], "subject string, bucket string")
    return placement.bucket_allowed(pol, t.doc_objects(spark, d).select(F.concat(F.lit("user"), (F.col("doc_id") % 5).cast("string")).alias("subject"), "bucket"))


@query("""SELECT event_id, CASE WHEN r IN (0, 1, 2) THEN true WHEN r IN (3, 4, 5) THEN event_id % 5 < 2 ELSE false END AS allowed FROM (SELECT event_id, event_id % 9 AS r FROM events)""")
def role_method(spark, d):
    e = F.col("event_id")
    roles = F.array(*map(F.lit, ["Admin", "editor", "UPLOADER", "listener", "ReadOnly", "read_only", "reader", "writer", ""]))
    methods = F.array(*map(F.lit, ["GET", "HEAD", "PUT", "DELETE", "PATCH"]))
    return t.table(spark, d, "events").select("event_id", placement.role_allowed(F.element_at(roles, (e % 9 + 1).cast("int")), F.element_at(methods, (e % 5 + 1).cast("int"))).alias("allowed"))


# --- replication

_DUE = "(status = 'pending' OR (status = 'failed' AND (next_retry_at IS NULL OR next_retry_at <= 1705000000)))"


@query(f"SELECT event_id, created_at, 'pending' AS status FROM replication_log WHERE {_DUE} ORDER BY created_at, event_id LIMIT 64", "replication_log")
def replication_due(spark, d):
    return replication.due(t.replication_log(spark, d), 1705000000, 64).select("event_id", "created_at", "status")


@query(f"""SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'dead_letter') AS dead_letter, count(*) FILTER (status = 'sent') AS sent, count(*) FILTER (status = 'applied') AS applied,
  count(*) FILTER ({_DUE}) AS due, 1705000000 - min(created_at) FILTER (status = 'pending') AS oldest_pending_seconds FROM replication_log""", "replication_log")
def replication_status(spark, d):
    return replication.status(t.replication_log(spark, d), 1705000000)


@query("""SELECT event_id, CAST(attempts + 1 AS INTEGER) AS attempts, CASE WHEN attempts + 1 >= 20 THEN 'dead_letter' ELSE 'failed' END AS status, CASE WHEN attempts + 1 < 20 THEN 1706659200 + least(CAST(pow(2, least(attempts + 1, 10)) AS BIGINT), 3600) END AS next_retry_at FROM replication_log WHERE status IN ('pending', 'failed')""", "replication_log")
def replication_backoff(spark, d):
    return replication.after_failure(t.replication_log(spark, d).where("status IN ('pending', 'failed')"), NOW).select("event_id", "attempts", "status", "next_retry_at")


@query("SELECT event_id, CASE WHEN status = 'dead_letter' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'dead_letter' THEN 0 ELSE attempts END AS attempts, CASE WHEN status <> 'dead_letter' THEN next_retry_at END AS next_retry_at FROM replication_log", "replication_log")
def dead_letter_replay(spark, d):
    return replication.replay(t.replication_log(spark, d)).select("event_id", "status", "attempts", "next_retry_at")


@query("SELECT status = 'dead_letter' AS dead, op, count(*) AS n, CAST(sum(attempts) AS BIGINT) AS attempts FROM replication_log GROUP BY ALL", "replication_log")
def dead_letter_split(spark, d):
    return t.replication_log(spark, d).groupBy((F.col("status") == "dead_letter").alias("dead"), "op").agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"))


@query("SELECT event_id FROM replication_log WHERE key NOT LIKE 'staging/%' AND NOT (key LIKE 'logs/1%' OR bucket || '/' || key LIKE 'b3/%') AND (key LIKE 'data/%' OR key LIKE 'logs/%')", "replication_log")
def replicate_filter(spark, d):
    return t.replication_log(spark, d).where(replication.replicated(["data/", "logs/"], ["logs/1", "b3/"])).select("event_id")


@query("""SELECT event_id, node_id, CAST(rank AS INTEGER) AS rank FROM (SELECT event_id, node_id, row_number() OVER (PARTITION BY event_id ORDER BY node_id) AS rank FROM replication_log l JOIN peers p
  ON (len(storage_classes) = 0 OR list_contains(storage_classes, l.storage_class)) AND (p.replication_group IS NULL OR p.replication_group = l.replication_group) WHERE l.status = 'pending' AND node_id <> origin_node) WHERE rank <= 2""", "replication_log", "peers")
def peer_fanout(spark, d):
    return replication.fan_out(t.replication_log(spark, d).where("status = 'pending'"), t.peers(spark, d), 3)


_ASKED = """(SELECT event_id, node_id, ok, rank FROM (SELECT *, coalesce(sum(CAST(ok AS INTEGER)) OVER (PARTITION BY event_id ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken, row_number() OVER (PARTITION BY event_id ORDER BY node_id) AS rank FROM (
  SELECT event_id, 'p' || x AS node_id, (event_id + x * x) % 3 = 0 AS ok FROM events, unnest([0, 1, 2, 3]) u(x))) WHERE taken < 2)"""


def _asked(spark, d):
    """Four peers for each event, of which some take it."""
    e = t.table(spark, d, "events").select("event_id", F.explode(F.array(*map(F.lit, range(4)))).alias("x"))
    return replication.delivered(e.select("event_id", F.concat(F.lit("p"), F.col("x").cast("string")).alias("node_id"), ((F.col("event_id") + F.col("x") * F.col("x")) % 3 == 0).alias("ok")), 3)


@query(f"SELECT event_id, node_id, CAST(rank AS INTEGER) AS rank, ok FROM {_ASKED}")
def delivered(spark, d):
    return _asked(spark, d)


@query(f"""SELECT event_id, n AS succeeded, CASE WHEN n >= 2 THEN 'sent' WHEN n > 0 THEN 'retry_now' ELSE 'failed' END AS outcome FROM (SELECT event_id, count(*) FILTER (ok) AS n FROM {_ASKED} GROUP BY 1)""")
def drained(spark, d):
    return replication.drained(t.table(spark, d, "events"), _asked(spark, d), 3)


@query("SELECT event_id, CASE WHEN event_id % 4 >= 2 THEN 'sent' WHEN event_id % 4 > 0 THEN 'retry_now' ELSE 'failed' END AS outcome FROM events")
def drain_outcome(spark, d):
    return t.table(spark, d, "events").select("event_id", replication.drain_outcome(F.col("event_id") % 4, F.lit(2)).alias("outcome"))


@query("SELECT bucket, key, 'put' AS op, size, etag FROM (SELECT * FROM doc_objects WHERE deleted_at IS NULL ORDER BY updated_at, bucket, key LIMIT 200) WHERE NOT (key LIKE 'fr/%') AND key NOT LIKE 'staging/%'", "doc_objects")
def backfill_plan(spark, d):
    return replication.backfill(t.doc_objects(spark, d), 200, [], ["fr/"])


@query("SELECT md5('put' || chr(31) || 'node0' || chr(31) || bucket || chr(31) || key || chr(31) || etag) AS event_id, bucket, key, size, 'pending' AS status FROM doc_objects WHERE deleted_at IS NULL", "doc_objects")
def replication_enqueue(spark, d):
    return replication.enqueue(listing.active(t.doc_objects(spark, d)), "put", "node0", NOW).select("event_id", "bucket", "key", "size", "status")


@query("SELECT event_id, op FROM replication_log WHERE event_id NOT IN (SELECT event_id FROM replication_log WHERE status = 'applied')", "replication_log")
def idempotent_apply(spark, d):
    log = t.replication_log(spark, d)
    return replication.unseen(log.unionByName(log.where("op = 'put'")), log.where("status = 'applied'")).select("event_id", "op")


@query("SELECT bucket, key, size, event_id FROM (SELECT *, row_number() OVER (PARTITION BY bucket, key ORDER BY created_at DESC, CAST(event_id AS BIGINT) DESC) AS rn FROM replication_log) WHERE rn = 1 AND op = 'put'", "replication_log")
def apply_log(spark, d):
    return replication.apply_events(t.replication_log(spark, d))


@query("SELECT event_id, CASE WHEN CAST(event_id AS BIGINT) % 11 = 0 THEN 'rejected' ELSE 'accepted' END AS verdict FROM replication_log", "replication_log")
def wire_checksum_split(spark, d):
    log = t.replication_log(spark, d)
    got = F.when(F.col("event_id").cast("long") % 11 == 0, "bad").otherwise(F.md5("event_id"))
    return log.select("event_id", F.when(got == F.col("wire_checksum"), "accepted").otherwise("rejected").alias("verdict"))


@query("""SELECT CAST(sum(n) AS BIGINT) AS deleted, count(f) AS n_failed, bool_or(trunc) AS truncated, min(node) FILTER (node <> 'node0') AS cursor FROM (
  SELECT origin_node AS node, count(*) AS n, 'k' || origin_node AS f, origin_node = 'node2' AS trunc FROM doc_objects WHERE deleted_at IS NULL GROUP BY origin_node)""", "doc_objects")
def delete_fanout_merge(spark, d):
    n = listing.active(t.doc_objects(spark, d)).groupBy(F.col("origin_node").alias("node_id")).agg(F.count("*").alias("deleted"))
    n = n.withColumn("failed_keys", F.array(F.concat(F.lit("k"), "node_id"))).withColumn("truncated", F.col("node_id") == "node2").withColumn("cursor", F.when(F.col("node_id") != "node0", F.col("node_id")))
    return replication.merge_deletes(n)


@query("SELECT DISTINCT origin_node AS node_id, 'k' || origin_node AS key FROM doc_objects WHERE deleted_at IS NULL", "doc_objects")
def delete_fanout_failures(spark, d):
    n = listing.active(t.doc_objects(spark, d)).select(F.col("origin_node").alias("node_id")).distinct()
    return replication.failed_keys(n.withColumn("failed_keys", F.array(F.concat(F.lit("k"), "node_id"))))


@query("""SELECT bucket, key, CASE WHEN doc_id % 3 = 0 AND deleted_at IS NULL THEN 'local' WHEN doc_id % 2 = 0 THEN 'n1' ELSE 'missing' END AS source FROM doc_objects""", "doc_objects")
def read_repair(spark, d):
    o = t.doc_objects(spark, d)
    remote = o.where("doc_id % 2 = 0").select("bucket", "key", F.explode(F.array(F.lit("n2"), F.lit("n1"))).alias("node_id"))
    return replication.read_repair(o.select("bucket", "key"), listing.active(o).where("doc_id % 3 = 0"), remote)


# --- streaming


@query("SELECT event_id, op, bucket, key FROM replication_log WHERE key NOT LIKE 'staging/%'", "replication_log")
def stream_idempotent_apply(spark, d):
    return stream.run_apply(spark, d)


@query("SELECT status, count(*) AS n FROM replication_log GROUP BY status", "replication_log")
def stream_status_counts(spark, d):
    return stream.run_status(spark, d)


@query("""WITH RECURSIVE e AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) AS rn FROM (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events)
), r AS (
  SELECT event_id, user_id, sec, rn, CAST(2 AS DOUBLE) AS tokens FROM e WHERE rn = 1
  UNION ALL
  SELECT e.event_id, e.user_id, e.sec, e.rn, least(CAST(2 AS DOUBLE), r.tokens - CASE WHEN r.tokens >= 1 THEN 1 ELSE 0 END + (e.sec - r.sec) * (CAST(1 AS DOUBLE) / 86400))
  FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1
)
SELECT event_id, user_id, tokens >= 1 AS allowed FROM r""")
def stream_rate_limit(spark, d):
    return stream.run_rate_limit(spark, d)
