"""WARC archives: one gzip member per record, written by partition and read back in sequence.

The writer puts a record for each page into archives below a shared folder. Of records with equal payloads (by length
and SHA-256, at least ``min_bytes`` long) the one with the largest page id is a response and the others revisit it.
The reader inflates a stream in pieces, takes one gzip member at a time, frames it by Content-Length and checks the
block digest of each record and the payload digest of each response. Records of other kinds than response and revisit
are checked and passed over, so archives of other writers can be read as well.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, functions as F

from quayside.llm.common import local_path, scratch, store, table

PIECE = 1 << 16  # compressed bytes read at once
ARCHIVE_BYTES = 1 << 30  # a file is closed once it has so many
CRLF = b"\r\n"


class ArchiveError(ValueError):
    """An archive that doesn't hold what its headers say."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, own: str) -> str:
    """The name of a page's record: from its id and digest, so that a revisit can name a record written elsewhere."""
    name = uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}/{own}")
    return f"<urn:uuid:{name}>"


def target_uri(url: str | None) -> str:
    """``url`` with whatever a header can't hold in percent form; a name of no page where there is none."""
    return quote(url, safe="".join(map(chr, range(33, 127))), errors="replace") if url else "urn:page:none"


def member(head: list[str], block: bytes) -> bytes:
    """Headers and block as one gzip member."""
    lines = ["WARC/1.1", *head, f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + CRLF * 2 + block + CRLF * 2) + z.flush()


def info(date: str, name: str) -> bytes:
    """The record that begins an archive."""
    head = ["WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(None, '')}", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"]
    return member(head, b"software: quayside\r\nformat: WARC File Format 1.1\r\n")


def record(url: str | None, page_id: int | None, payload: bytes, kind: str, refers_to: int | None, refers_url: str | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record as one gzip member. A revisit keeps the HTTP headers, with the full payload's length, and no body.

    A url that is no plain one stands in a header of its own beside its percent form. Equal rows share a record id.
    """
    own = digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id, own)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target_uri(url)}",
        f"WARC-Payload-Digest: sha1:{own}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if target_uri(url) != url:
        head.append(f"Page-URL: <{(url or '').encode('unicode_escape').decode()}>")
    if kind == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to, own)}",
            f"WARC-Refers-To-Target-URI: {target_uri(refers_url)}",
            f"WARC-Refers-To-Date: {date}",
            f"Refers-To-Page-ID: {refers_to}",
        ]
    return member(head, http if kind == "revisit" else http + payload)


def members(stream) -> Iterator[bytes]:
    """The inflated gzip members of a stream, one after another; a cut-off member is an error."""
    z, out, pending = None, [], b""
    while True:
        piece = pending or stream.read(PIECE)
        pending = b""
        if not piece:
            if z is not None:
                raise ArchiveError("the archive ends within a record")
            return
        if z is None:
            z, out = zlib.decompressobj(31), []
        try:
            out.append(z.decompress(piece))
        except zlib.error as e:
            raise ArchiveError(f"not a gzip member: {e}") from e
        if z.eof:
            pending = z.unused_data
            yield b"".join(out)
            z = None


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, mark, rest = raw.partition(CRLF * 2)
    lines = head.decode("utf-8").split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ArchiveError("no WARC header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    block, tail = rest[:size], rest[size:]
    if len(block) != size or tail != CRLF * 2:
        raise ArchiveError("Content-Length doesn't fit the record")
    said = fields.get("warc-block-digest")
    if said and said != f"sha1:{digest(block)}":
        raise ArchiveError("wrong block digest")
    return fields, block


def read_archive(stream) -> Iterator[dict]:
    """page_id, url, record_type, refers_to, payload (None for a revisit), payload_bytes, payload_digest of each page's record.

    What an archive of another writer doesn't say is taken from the record's body, or null.
    """
    number = lambda x: int(x) if x is not None and re.fullmatch("-?[0-9]+", x) else None
    for raw in members(stream):
        fields, block = parse(raw)
        kind = fields.get("warc-type")
        if kind not in ("response", "revisit"):
            continue
        http, _, body = block.partition(CRLF * 2)
        said = next((x.split(b":")[1] for x in http.split(CRLF) if x.lower().startswith(b"content-length:")), None)
        own = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        if kind == "response" and (len(body) != int(len(body) if said is None else said) or (own and digest(body) != own)):
            raise ArchiveError("wrong payload digest or length")
        url = fields.get("warc-target-uri", "")
        if "page-url" in fields:
            url = fields["page-url"][1:-1].encode().decode("unicode_escape")
        yield {
            "page_id": number(fields.get("page-id")),
            "url": url,
            "record_type": kind,
            "refers_to": number(fields.get("refers-to-page-id")) if kind == "revisit" else None,
            "payload": body if kind == "response" else None,
            "payload_bytes": len(body) if said is None else int(said),
            "payload_digest": own or (digest(body) if kind == "response" else None),
        }


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str | None = None
) -> DataFrame:
    """Write archives below ``folder``; path, records of each, as stored.

    A null body is empty. All rows that share the largest id of their payload are responses, and so is a payload whose
    ids are all null. An archive begins with a warcinfo record, which ``records`` doesn't count, and ends with the record
    that takes it to ``archive_bytes``. ``date`` is of all records, now where not given. Each task writes files under
    names of its own and only files of tasks that ended well are listed, so a lost executor leaves nothing but unlisted
    files. An empty table gives no archive.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = F.coalesce(F.encode(F.col(body_col), "UTF-8"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("payload"))
    rows = rows.withColumn("sha", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    # The largest url of the largest id.
    last = rows.groupBy("sha", "size").agg(F.max(F.struct("page_id", "url")).alias("m"))
    last = store(last.select("sha", "size", F.col("m.page_id").alias("last"), F.col("m.url").alias("last_url")), "warc-last")
    # Stored, so that both sides of the join are shuffles: Spark then splits a payload that very many pages share.
    known = rows.join(last, ["sha", "size"])

    def write(batches):
        import pandas as pd
        from pyspark import TaskContext

        ctx = TaskContext.get()
        fs, base = local_path(folder)
        out, name, n, made, size = None, "", 0, 0, 0
        for pdf in batches:
            for page, url, payload, last, last_url in zip(pdf["page_id"], pdf["url"], pdf["payload"], pdf["last"], pdf["last_url"]):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    name = f"part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}-{made:05d}.warc.gz"
                    out, n, size = fs.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                    out.write(info(date, name))
                page, last = None if pd.isna(page) else int(page), None if pd.isna(last) else int(last)
                again = last is not None and page != last and len(payload) >= min_bytes
                raw = record(url, page, payload, *(("revisit", last, last_url) if again else ("response", None, None)), date)
                out.write(raw)
                n, size = n + 1, size + len(raw)
                if size >= archive_bytes:
                    out.close()
                    out, made = None, made + 1
                    yield pd.DataFrame({"path": [f"{folder}/{name}"], "records": [n]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [f"{folder}/{name}"], "records": [n]})

    # Ids as strings keep 64 bits whole beside nulls.
    sent = known.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", F.col("last").cast("string").alias("last"), "last_url")
    return store(sent.mapInPandas(write, "path string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of all archives of a manifest; their number must be the manifest's."""

    def read(batches):
        import pandas as pd

        for pdf in batches:
            for path, n in zip(pdf["path"], pdf["records"]):
                fs, at = local_path(path)
                seen, rows, size = 0, [], 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for r in read_archive(stream):
                        rows.append(r)
                        seen += 1
                        size += r["payload_bytes"]
                        if size > 8 << 20 or len(rows) >= 2000:
                            yield pd.DataFrame(rows).astype({"page_id": "Int64", "refers_to": "Int64"})
                            rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows).astype({"page_id": "Int64", "refers_to": "Int64"})
                if seen != n:
                    raise ArchiveError(f"{path} has {seen} records, not {n}")

    schema = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"
    spread = manifest.repartition(max(1, min(manifest.count(), 10_000)), "path")
    return spread.mapInPandas(read, schema)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write ``pages`` as WARC archives and read them back."""
    manifest = write_archives(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages
), d AS (
  SELECT page_id, last, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha1(body) AS hex FROM p
), q AS (
  SELECT *, list_transform(range(0, 8), lambda g: CAST('0x' || substr(hex, CAST(5 * g + 1 AS INTEGER), 5) AS BIGINT)) AS fives FROM d
)
SELECT page_id, payload_bytes,
       array_to_string(flatten(list_transform(fives, lambda v: list_transform([15, 10, 5, 0],
         lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> s) & 31 AS INTEGER) + 1, 1)))), '') AS payload_digest,
       CASE WHEN page_id = last OR last IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last OR last IS NULL THEN NULL ELSE last END AS refers_to
FROM q
"""
