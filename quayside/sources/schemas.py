"""Logical schemas of an object-store catalog. Times are seconds since 1970 in UTC; hashes are lower-case hex."""

from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    kinds = {"s": T.StringType(), "l": T.LongType(), "i": T.IntegerType(), "a": T.ArrayType(T.StringType())}
    fields = []
    for item in text.split():
        name, kind = item.rstrip("!").split(":")
        fields.append(T.StructField(name, kinds[kind], not item.endswith("!")))
    return T.StructType(fields)


OBJECTS = _schema("bucket:s! key:s! size:l! mime_type:s etag:s custom_meta:s storage_class:s origin_node:s created_at:l! updated_at:l! deleted_at:l")
MULTIPART_UPLOADS = _schema("upload_id:s! bucket:s! key:s! content_type:s created_at:l! expires_at:l")
MULTIPART_PARTS = _schema("upload_id:s! part_number:i! size:l! etag:s")
BLOCK_REFS = _schema("bucket:s! key:s! block_idx:i! block_hash:s! size:i!")
REPLICATION_LOG = _schema(
    "event_id:s! origin_node:s! op:s! bucket:s! key:s! etag:s size:l payload_path:s storage_class:s replication_group:s "
    "content_type:s custom_meta:s wire_checksum:s created_at:l! applied_at:l status:s! attempts:i next_retry_at:l"
)
BLOBS = _schema("bucket:s! key:s! bytes:l! modified_at:l format:s")
PEERS = _schema("node_id:s! url:s! storage_classes:a replication_group:s")
RULES = _schema("rule_idx:i! storage_class:s! prefix:s suffix:s mime_prefix:s min_bytes:l assigned_node:s")
