"""DuckDB forms of the base views of ``quayside.sources.tables``."""

VIEWS = {
    "page_objects": """SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS bucket, regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1) AS key,
  CAST(octet_length(encode(html)) AS BIGINT) AS size, 'text/html' AS mime_type, md5(html) AS etag, page_id AS version FROM pages""",
    "doc_objects": """SELECT source AS bucket, lang || '/' || doc_id AS key, CAST(octet_length(encode(text)) AS BIGINT) AS size,
  CASE doc_id % 5 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/json' ELSE 'text/plain' END AS mime_type, md5(text) AS etag,
  CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'default' WHEN 2 THEN 'cold' ELSE 'archive' END AS storage_class, 'node' || (doc_id % 3) AS origin_node,
  1704067200 + doc_id * 60 AS created_at, 1704067200 + doc_id * 60 + doc_id * 7919 % 100000 AS updated_at,
  CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 1706659200 - doc_id * 3600 END AS deleted_at, doc_id FROM documents""",
    "doc_blobs": """SELECT source AS bucket, lang || '/' || doc_id AS key, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
  UNION ALL SELECT 'stray', 'lost/' || doc_id, doc_id * 10 FROM (SELECT DISTINCT doc_id FROM labels) WHERE doc_id % 3 = 0""",
    "object_writes": """SELECT event_type AS bucket, 'u/' || user_id AS key, CAST(floor(value * 100) AS BIGINT) AS size, CASE WHEN event_id % 3 <> 0 THEN 'class' || (event_id % 3) END AS storage_class,
  CASE WHEN event_id % 5 <> 0 THEN 'node' || (event_id % 5) END AS origin_node, CAST(floor(epoch(ts)) AS BIGINT) AS written_at, event_id AS version FROM events""",
    "replication_log": """SELECT CAST(event_id AS VARCHAR) AS event_id, 'node' || (event_id % 3) AS origin_node, CASE WHEN event_id % 7 = 0 THEN 'delete' ELSE 'put' END AS op, 'b' || (user_id % 4) AS bucket,
  CASE WHEN event_id % 10 = 0 THEN 'staging/' WHEN event_id % 10 < 4 THEN 'logs/' ELSE 'data/' END || user_id AS key, CAST(floor(value * 100) AS BIGINT) AS size,
  CASE WHEN event_id % 2 = 0 THEN 'cold' ELSE 'hot' END AS storage_class, CASE WHEN event_id % 3 <> 0 THEN 'REGION_' || (event_id % 5) END AS replication_group, CAST(floor(epoch(ts)) AS BIGINT) AS created_at,
  CASE event_type WHEN 'view' THEN 'applied' WHEN 'signup' THEN 'sent' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'pending' ELSE 'dead_letter' END AS status,
  CAST(props ->> '$.k' AS INTEGER) % 25 AS attempts, CASE WHEN event_id % 4 <> 0 THEN CAST(floor(epoch(ts)) AS BIGINT) + user_id * 100 END AS next_retry_at FROM events""",
    "multipart_uploads": "SELECT CAST(o_orderkey AS VARCHAR) AS upload_id, 'b' || (o_custkey % 5) AS bucket, 'up/' || o_orderkey AS key, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS created_at, CAST(floor(epoch(o_orderdate)) AS BIGINT) + 86400 AS expires_at FROM orders",
    "multipart_parts": "SELECT CAST(l_orderkey AS VARCHAR) AS upload_id, l_linenumber AS part_number, CAST(l_quantity AS BIGINT) AS size, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS written_at, l_partkey AS tie1, l_suppkey AS tie2, l_extendedprice AS tie3 FROM lineitem",
    "latest_parts": "SELECT upload_id, part_number, size, written_at FROM (SELECT *, row_number() OVER (PARTITION BY upload_id, part_number ORDER BY written_at DESC, tie1 DESC, tie2 DESC, tie3 DESC) AS rn FROM multipart_parts) WHERE rn = 1",
    "doc_blocks": """SELECT bucket, key, CAST(i AS INTEGER) AS block_idx, md5(array_slice(body, i * 1024 + 1, i * 1024 + 1024)) AS block_hash, CAST(least(1024, n - i * 1024) AS INTEGER) AS size FROM (
  SELECT source AS bucket, lang || '/' || doc_id AS key, encode(text) AS body, octet_length(encode(text)) AS n, unnest(range(0, CAST(ceil(octet_length(encode(text)) / 1024.0) AS BIGINT))) AS i FROM documents)""",
    "peers": "SELECT n_name AS node_id, CASE n_nationkey % 3 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['hot'] ELSE ['hot', 'cold'] END AS storage_classes, CASE WHEN n_nationkey % 4 <> 0 THEN r_name END AS replication_group FROM nation JOIN region ON n_regionkey = r_regionkey",
}


def sql(body: str, *views: str) -> str:
    """``body`` with the named views before it."""
    return (f"WITH {', '.join(f'{v} AS ({VIEWS[v]})' for v in views)}\n" if views else "") + body
