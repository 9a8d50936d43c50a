"""Content blocks: chunking, reference counts, ranges and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def chunk(content: DataFrame, body: Column, block_size: int) -> DataFrame:
    """bucket, key, block_idx, block_hash, size, body: blocks of fixed size; empty content has none."""
    raw = content.withColumn("_body", body)
    n = F.octet_length("_body")
    at = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(block_size))).otherwise(F.array().cast("array<int>")))
    cut = raw.select("bucket", "key", "_body", at.alias("_at"))
    part = F.substring(F.col("_body"), F.col("_at") + 1, F.lit(block_size))
    return cut.select("bucket", "key", (F.col("_at") / block_size).cast("int").alias("block_idx"), F.md5(part).alias("block_hash"), F.octet_length(part).alias("size"), part.alias("body"))


def refcounts(refs: DataFrame) -> DataFrame:
    return refs.groupBy("block_hash").agg(F.count("*").alias("refcount"), F.max("size").alias("size"))


def apply_deltas(counts: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Counts after references come and go; blocks without any are dropped."""
    rows = counts.select("block_hash", "size", F.col("refcount").alias("d")).unionByName(added.select("block_hash", "size", F.lit(1).cast("long").alias("d"))).unionByName(removed.select("block_hash", "size", F.lit(-1).cast("long").alias("d")))
    return rows.groupBy("block_hash").agg(F.sum("d").alias("refcount"), F.max("size").alias("size")).where(F.col("refcount") > 0)


def finalize(refs: DataFrame, new: DataFrame) -> DataFrame:
    """block_hash, refcount, size after objects are written: ``new`` (bucket, key, block_idx, block_hash, size) takes the
    place of all references of the same objects, and blocks that nothing refers to any more are gone. One anti-join and
    one aggregation."""
    cols = ["block_hash", "size"]
    kept = refs.join(new.select("bucket", "key").distinct(), ["bucket", "key"], "left_anti").select(*cols)
    return refcounts(kept.unionByName(new.select(*cols)))


def copy_refs(refs: DataFrame, requests: DataFrame) -> DataFrame:
    """New references of objects copied by requests (bucket, key, to_bucket, to_key): a copy shares its source's blocks, and
    takes none of its bytes."""
    got = refs.select("bucket", "key", "block_idx", "block_hash", "size").join(requests.distinct(), ["bucket", "key"])
    return got.select(F.col("to_bucket").alias("bucket"), F.col("to_key").alias("key"), "block_idx", "block_hash", "size")


def savings(refs: DataFrame) -> DataFrame:
    c = refcounts(refs).agg(F.sum(F.col("refcount") * F.col("size")).cast("long").alias("logical_bytes"), F.sum("size").cast("long").alias("stored_bytes"), F.count("*").alias("blocks"), F.sum("refcount").cast("long").alias("refs"))
    return c.withColumn("saved_bytes", F.col("logical_bytes") - F.col("stored_bytes"))


def offsets(refs: DataFrame) -> DataFrame:
    """logical_start and logical_end of each block of an object."""
    w = Window.partitionBy("bucket", "key").orderBy("block_idx")
    end = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    return refs.withColumn("logical_end", end).withColumn("logical_start", F.col("logical_end") - F.col("size"))


def index_valid(index: DataFrame) -> DataFrame:
    """Whether each object's block numbers run from 0 without gaps and its ends only grow."""
    w = Window.partitionBy("bucket", "key").orderBy("block_idx")
    ok = (F.col("block_idx") == F.row_number().over(w) - 1) & (F.col("logical_end") > F.lag("logical_end", 1, 0).over(w))
    return index.withColumn("_ok", ok).groupBy("bucket", "key").agg(F.bool_and("_ok").alias("valid"))


def overlapping(index: DataFrame, start: int, end: int) -> DataFrame:
    """Blocks that bytes start..end-1 touch, with the part of each: skip and take."""
    hit = index.where((F.col("logical_start") < end) & (F.col("logical_end") > start))
    skip = F.greatest(F.lit(start) - F.col("logical_start"), F.lit(0)).cast("long")
    return hit.withColumn("skip", skip).withColumn("take", (F.least(F.col("logical_end"), F.lit(end)) - F.col("logical_start") - skip).cast("long"))


def read_range(index: DataFrame, blocks: DataFrame, start: int, end: int) -> DataFrame:
    """bucket, key, body: bytes start..end-1 of each object from its blocks (block_hash, body)."""
    hit = overlapping(index, start, end)
    # Only blocks that are asked for are moved and made one each.
    store = blocks.select("block_hash", "body").join(hit.select("block_hash"), "block_hash", "left_semi").dropDuplicates(["block_hash"])
    cut = hit.join(store, "block_hash")
    piece = F.substring(F.col("body"), (F.col("skip") + 1).cast("int"), F.col("take").cast("int"))
    got = cut.select("bucket", "key", "block_idx", piece.alias("p")).groupBy("bucket", "key").agg(F.array_sort(F.collect_list(F.struct("block_idx", "p"))).alias("p"))
    return got.select("bucket", "key", F.aggregate("p", F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x["p"])).alias("body"))


def verify(blocks: DataFrame) -> DataFrame:
    """Blocks with ``intact``: whether the hash of the bytes is the recorded one."""
    return blocks.withColumn("intact", F.md5("body") == F.col("block_hash"))


def object_etags(blocks: DataFrame) -> DataFrame:
    """bucket, key, etag, size: the hash of each object's bytes, its blocks (block_idx, body) in order. For objects that fit
    a row, as ``read_range``; an object without blocks has no row."""
    got = blocks.groupBy("bucket", "key").agg(F.array_sort(F.collect_list(F.struct("block_idx", F.hex("body").alias("h")))).alias("p"))
    body = F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), ""))
    return got.select("bucket", "key", F.md5(body).alias("etag"), F.octet_length(body).cast("long").alias("size"))


def compress_sizes(blocks: DataFrame, level: int = 3, dictionary: bytes | None = None) -> DataFrame:
    """block_hash, raw, packed, stored: sizes before and after zstd; a block that doesn't shrink is stored raw.
    A dictionary of ``train_dictionary`` goes to every task with the function; it is smaller than its sample's bound."""

    def run(batches):
        import zstandard

        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        z = zstandard.ZstdCompressor(level=max(1, min(22, level)), dict_data=known)
        for pdf in batches:
            raw = pdf["body"].map(len)
            packed = pdf["body"].map(lambda b: len(z.compress(b)))
            yield pdf[["block_hash"]].assign(raw=raw, packed=packed, stored=packed.where(packed < raw, raw))

    return blocks.select("block_hash", "body").dropDuplicates(["block_hash"]).mapInPandas(run, "block_hash string, raw long, packed long, stored long")


def train_dictionary(samples: DataFrame, max_size: int, least: int = 64, most: int = 256 << 10, rows: int = 1000) -> bytes | None:
    """A zstd dictionary from a sample of at most ``rows`` bodies of fitting size, in hash order; None for fewer than two.

    A dictionary is a small model: the sample's bound is a parameter and everything else is compressed with it whole.
    """
    import zstandard

    fit = samples.where(F.octet_length("body").between(least, most)).orderBy(F.xxhash64("body")).limit(rows)
    got = [bytes(r["body"]) for r in fit.select("body").collect()]
    size = min(max_size, sum(map(len, got)) * 3 // 10)
    return zstandard.train_dictionary(max(256, size), got).as_bytes() if len(got) >= 2 else None
