"""Column functions on buckets, keys, headers and sizes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F


def encode_key(key: Column) -> Column:
    """Percent-encode % and /, in this order."""
    return F.replace(F.replace(key, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))


def decode_key(key: Column) -> Column:
    """The inverse of ``encode_key``."""
    return F.replace(F.replace(key, F.lit("%2F"), F.lit("/")), F.lit("%25"), F.lit("%"))


def shard(key: Column) -> Column:
    """Two hex digits that spread keys evenly."""
    return F.substring(F.md5(key), 31, 2)


def blob_path(bucket: Column, key: Column) -> Column:
    return F.concat_ws("/", bucket, shard(key), encode_key(key))


def nested_path(bucket: Column, key: Column) -> Column:
    """The older place of a key with a slash, its folders as they are; null for other keys, which have one place only."""
    return F.when(key.contains("/"), F.concat_ws("/", bucket, shard(key), key))


def key_of_path(path: Column) -> Column:
    """The key of a path below a bucket, behind its shard folder: nested keys as they are, others decoded.

    Null for a path without a shard folder or with nothing behind it.
    """
    tail = F.try_element_at(F.split(path, "/", 2), F.lit(2))
    return F.when(tail.contains("/"), tail).when(tail != "", decode_key(tail))


# The HTTP status of each refusal.
STATUS = {
    "not_found": 404, "range_not_satisfiable": 416, "payload_too_large": 413, "insufficient_storage": 507, "invalid_bucket": 400,
    "invalid_key": 400, "precondition_failed": 412, "read_only_replica": 503, "not_assigned": 409, "internal": 500,
}


def status_code(error: Column) -> Column:
    """The HTTP status of a refusal by name: 200 for null, 500 for an unknown one."""
    codes = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return F.when(error.isNull(), 200).otherwise(F.coalesce(F.try_element_at(codes, error), F.lit(500)))


def _rooted(path: Column) -> Column:
    """Whether a path begins with / or has a colon as its second byte, as drives have."""
    return path.startswith("/") | path.rlike(r"^[\x00-\x7F]:")


def clean_bucket(bucket: Column) -> Column:
    """The bucket with / for \\, or null where it is empty, rooted or has two dots in a row."""
    b = F.replace(bucket, F.lit("\\"), F.lit("/"))
    return F.when((b != "") & ~_rooted(b) & ~b.contains(".."), b)


def valid_bucket(bucket: Column) -> Column:
    return clean_bucket(bucket).isNotNull()


def clean_key(key: Column) -> Column:
    """The key with / for \\, or null where it is empty, rooted, has a .. segment or a newline."""
    k = F.replace(key, F.lit("\\"), F.lit("/"))
    return F.when((k != "") & ~_rooted(k) & ~k.rlike(r"(^|/)\.\.(/|\z)") & ~k.contains("\n"), k)


def extension(key: Column) -> Column:
    """Lower-case extension of the last segment; empty where either side of the dot is."""
    return F.lower(F.regexp_extract(key, r"([^/]+)\.([^/.]+)$", 2))


def common_prefix(key: Column, prefix: str, delimiter: str) -> Column:
    """prefix up to and including the first delimiter behind it; null where there is none."""
    rest = F.substring(key, F.lit(len(prefix) + 1), F.length(key))
    at = F.instr(rest, delimiter)
    return F.when(at > 0, F.concat(F.lit(prefix), F.substring(rest, F.lit(1), at + len(delimiter) - 1)))


def etag_equal(a: Column, b: Column) -> Column:
    """Equality without quotes around."""
    return F.btrim(a, F.lit('"')) == F.btrim(b, F.lit('"'))


def parse_range(header: Column, size: Column) -> Column:
    """struct<valid, start, len> of an HTTP range; an invalid or unsatisfiable one is the whole content with valid false."""
    a, b = F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 1), F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 2)
    first, last = F.when(a != "", a.try_cast("long")), F.when(b != "", b.try_cast("long"))
    start = F.when(a != "", first).otherwise(F.greatest(size - last, F.lit(0)))
    end = F.when((a != "") & (b != ""), F.least(last, size - 1)).otherwise(size - 1)
    valid = F.coalesce((start <= end) & (start < size) & ~((a == "") & (F.coalesce(last, F.lit(0)) == 0)), F.lit(False))
    return F.struct(valid.alias("valid"), F.when(valid, start).otherwise(0).cast("long").alias("start"), F.when(valid, end - start + 1).otherwise(size).cast("long").alias("len"))


# Extensions and content types of packed content, and the least size worth compressing.
PACKED_EXTENSIONS = [
    "gz", "bz2", "rar", "zip", "7z", "xz", "zst", "lz4", "br", "tgz",
    "jpg", "jpeg", "png", "gif", "webp", "avif", "heic", "heif", "jxl",
    "mp4", "mkv", "mov", "avi", "wmv", "flv", "webm", "m4v", "mpeg", "mpg",
    "mp3", "aac", "ogg", "flac", "wma", "m4a", "opus",
    "pdf", "docx", "xlsx", "pptx",
    "deb", "rpm", "jar", "war", "apk",
    "woff", "woff2",
]
PACKED_TYPES = [
    "video/*", "audio/*", "image/*",
    "application/zip", "application/gzip", "application/x-gzip", "application/x-zip-compressed", "application/x-rar-compressed",
    "application/x-7z-compressed", "application/x-bzip", "application/x-bzip2", "application/x-xz", "application/zstd",
    "application/x-zstd", "application/x-tar", "application/tar", "application/pdf", "application/wasm",
    "font/*",
]
COMPRESS_MIN_SIZE = 4096
# Leading bytes, as hex, of packed formats; at a place of 4 or 8 bytes, for content of 12 bytes or more.
PACKED_MAGIC = ["1F8B", "504B0304", "504B0506", "28B52FFD", "89504E47", "FFD8FF", "47494638", "494433"]
PACKED_MAGIC_AT_4 = "66747970"
PACKED_MAGIC_RIFF = ("52494646", "57454250")  # at 0 and at 8


def type_matches(mime: Column, pattern: str) -> Column:
    """Whether a content type is the pattern or, for a pattern with /*, of that main type; blanks and case don't count."""
    m = F.lower(F.btrim(mime))
    main = pattern.lower().removesuffix("/*")
    return (m == main) | m.startswith(main + "/") if pattern.endswith("/*") else m == main


def compressible(key: Column, size: Column, mime: Column, extra: tuple[str, ...] = (), least: int = COMPRESS_MIN_SIZE) -> Column:
    """Whether compression is worth trying: large enough, and packed neither by extension nor by content type."""
    packed = F.coalesce(extension(key).isin(PACKED_EXTENSIONS + list(extra)), F.lit(False))
    for p in PACKED_TYPES:
        packed = packed | F.coalesce(type_matches(mime, p), F.lit(False))
    return (size >= max(1, least)) & ~packed


def packed_magic(content: Column) -> Column:
    """Whether binary content begins like a packed format."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.lit(False)
    for m in PACKED_MAGIC:
        out = out | head.startswith(m)
    whole = F.length(head) == 24
    riff, webp = PACKED_MAGIC_RIFF
    return out | (whole & (F.substring(head, 9, 8) == PACKED_MAGIC_AT_4)) | (whole & head.startswith(riff) & head.endswith(webp))


def sampled(bucket: Column, key: Column, denominator: int) -> Column:
    """Whether a hash of bucket/key falls into one of ``denominator`` parts; all do for 1 or less."""
    if denominator <= 1:
        return F.lit(True)
    return F.conv(F.substring(F.md5(F.concat_ws("/", bucket, key)), 1, 8), 16, 10).cast("long") % denominator == 0


def _xxh3():
    import xxhash

    return xxhash.xxh3_64_intdigest


def shard_xxh3():
    """An Arrow function: two hex digits of the last byte of a key's XXH3, the shard of files that use that hash."""

    @F.pandas_udf("string")
    def digits(key: pd.Series) -> pd.Series:
        h = _xxh3()
        return key.map(lambda k: None if k is None else f"{h(k.encode()) & 0xFF:02x}")

    return digits


def sampled_xxh3(denominator: int):
    """An Arrow function (bucket, key) -> whether the XXH3 of bucket/key falls into one of ``denominator`` parts."""

    @F.pandas_udf("boolean")
    def some(bucket: pd.Series, key: pd.Series) -> pd.Series:
        h, n = _xxh3(), max(1, denominator)
        return pd.Series([None if b is None or k is None else h(f"{b}/{k}".encode()) % n == 0 for b, k in zip(bucket, key)], dtype=object)

    return some


def backoff_seconds(attempts: Column) -> Column:
    return F.least(F.pow(F.lit(2.0), F.least(attempts, F.lit(10))).cast("long"), F.lit(3600))


def zstd_level(level: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(22), level))


def window_log(size: Column) -> Column:
    """Bits of the size, held within 10 and 27."""
    return F.greatest(F.lit(10), F.least(F.lit(27), F.length(F.bin(size))))


def permits(size: Column, unit: int) -> Column:
    """Size rounded up to whole units, one at least."""
    return F.greatest(F.lit(unit), F.ceil(size / unit) * unit).cast("long")


def xml_escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def label_escape(text: Column) -> Column:
    """A metric label's value with its backslashes and quotes escaped."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def copy_source(header: Column) -> Column:
    """struct<bucket, key> of a copy header, split at its first /; both null where either is empty."""
    parts = F.split(header, "/", 2)
    key = F.try_element_at(parts, F.lit(2))
    fine = (parts[0] != "") & (key != "")
    return F.struct(F.when(fine, parts[0]).alias("bucket"), F.when(fine, key).alias("key"))


def meta_strings(custom_meta: Column) -> Column:
    """The string fields of JSON metadata as a map; numbers, objects and the like are left out, what is no object has none."""
    fields = F.try_variant_get(F.try_parse_json(custom_meta), "$", "map<string,variant>")
    strings = F.map_filter(F.coalesce(fields, F.create_map().cast("map<string,variant>")), lambda k, v: F.schema_of_variant(v) == "STRING")
    return F.transform_values(strings, lambda k, v: v.cast("string"))


def meta_get(custom_meta: Column, field: str) -> Column:
    """A string field of JSON metadata; null where it is missing or no string."""
    return F.try_element_at(meta_strings(custom_meta), F.lit(field))


def meta_build(fields: Column) -> Column:
    """JSON metadata of a map of strings; null for an empty map."""
    return F.when(F.size(fields) > 0, F.to_json(fields))


def etag_token(header: Column) -> Column:
    """The first tag of a condition header, without quotes; null for an empty one."""
    return F.nullif(F.btrim(F.btrim(F.split(header, ",", 2)[0]), F.lit('"')), F.lit(""))


def extension_list(text: Column) -> Column:
    """A comma-separated list of extensions: trimmed, without dots, lower-case, empty ones dropped."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.lower(F.ltrim(F.btrim(x), F.lit(".")))), lambda x: x != "")


# Minutes east of Greenwich of the zone names in mail dates.
ZONES = {"UT": 0, "UTC": 0, "GMT": 0, "Z": 0, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420}


def parse_http_date(text: Column) -> Column:
    """Seconds since 1970 of an RFC 2822 date (weekday and seconds optional, any zone) or an RFC 3339 date; null for neither."""
    form = r"^\s*(?:[A-Za-z]{3}\s*,\s*)?(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}(?::\d{2})?) ([+-]\d{4}|[A-Za-z]{1,3})\s*$"
    body, zone = F.regexp_extract(text, form, 1), F.upper(F.regexp_extract(text, form, 2))
    far = F.when(zone.rlike(r"^[+-]\d{4}$"), zone)
    for name, minutes in ZONES.items():
        far = far.when(zone == name, f"{'-' if minutes < 0 else '+'}{abs(minutes) // 60:02d}{abs(minutes) % 60:02d}")
    mail = F.try_to_timestamp(F.concat_ws(" ", body, F.coalesce(far, F.lit("?"))), F.lit("d MMM yyyy HH:mm[:ss] xx"))
    iso = F.try_to_timestamp(F.regexp_replace(text, r"\.(\d{1,6})\d*", ".$1"), F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][.SS][.S]XXX"))
    return F.unix_timestamp(F.coalesce(mail, iso)).cast("long")


def _utc(seconds: Column, form: str) -> Column:
    return F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), form)


def http_date(seconds: Column) -> Column:
    """An RFC 2822 date in UTC, as in Mon, 1 Jan 2024 00:00:00 +0000."""
    return _utc(seconds, "EEE, d MMM yyyy HH:mm:ss '+0000'")


def iso_date(seconds: Column) -> Column:
    return _utc(seconds, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def little_endian(content: Column, at: int, size: int) -> Column:
    """The unsigned number of ``size`` bytes from byte ``at`` (0: the first), lowest byte first; null where there are fewer.

    Numbers beyond 63 bits are null.
    """
    part = F.hex(F.substring(content, at + 1, size))
    turned = F.concat(*[F.substring(part, 2 * k + 1, 2) for k in reversed(range(size))])
    return F.when(F.length(part) == 2 * size, F.conv(turned, 16, 10).try_cast("long"))


def xxh3_hex():
    """An Arrow function: 16 hex digits of the 64-bit XXH3 of binary content. Spark has no such function built in."""
    import xxhash

    @F.pandas_udf("string")
    def digest(content: pd.Series) -> pd.Series:
        return content.map(lambda b: None if b is None else xxhash.xxh3_64_hexdigest(b))

    return digest


def percent_decode():
    """An Arrow function: decodes every %XX; a malformed one stays."""
    import re

    part = re.compile(rb"%([0-9A-Fa-f]{2})")

    @F.pandas_udf("string")
    def decode(text: pd.Series) -> pd.Series:
        return text.map(lambda s: None if s is None else part.sub(lambda m: bytes([int(m[1], 16)]), s.encode()).decode("utf-8", "replace"))

    return decode
