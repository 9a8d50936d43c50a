"""Base views of a catalog: over the sample tables, over stored files, and over other databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quayside.sources import schemas

NOW = 1706659200  # 2024-01-31T00:00:00Z, the clock of the sample queries


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects from web pages: bucket = host, key = path. All are active."""
    bucket, key = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1), F.regexp_extract("url", "^[a-z]+://[^/]+/(.*)$", 1)
    return table(spark, sf_dir, "pages").select(bucket.alias("bucket"), key.alias("key"), F.octet_length("html").cast("long").alias("size"), F.lit("text/html").alias("mime_type"), F.md5("html").alias("etag"), F.col("page_id").alias("version"))


def doc_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects from documents: bucket = source, key = lang/doc_id; a document labelled toxic is a tombstone."""
    toxic = table(spark, sf_dir, "labels").where(F.col("toxic") == 1).select("doc_id").distinct().withColumn("gone", F.lit(True))
    d = table(spark, sf_dir, "documents").join(toxic, "doc_id", "left")
    i = F.col("doc_id")
    kind = F.when(i % 4 == 0, F.lit(None).cast("string")).when(i % 4 == 1, "default").when(i % 4 == 2, "cold").otherwise("archive")
    return d.select(
        F.col("source").alias("bucket"), F.concat_ws("/", "lang", i.cast("string")).alias("key"), F.octet_length("text").cast("long").alias("size"),
        F.when(i % 5 == 0, "text/html").when(i % 5 == 1, "application/json").otherwise("text/plain").alias("mime_type"), F.md5("text").alias("etag"),
        F.concat(F.lit('{"lang":"'), F.col("lang"), F.lit('","storage-class":"'), F.when(i % 6 == 0, "hot").otherwise(""), F.lit('"}')).alias("custom_meta"),
        kind.alias("storage_class"), F.concat(F.lit("node"), (i % 3).cast("string")).alias("origin_node"),
        (F.lit(1704067200) + i * 60).cast("long").alias("created_at"), (F.lit(1704067200) + i * 60 + i * 7919 % 100000).cast("long").alias("updated_at"),
        F.when(F.col("gone"), F.lit(NOW) - i * 3600).cast("long").alias("deleted_at"), i.alias("doc_id"),
    )


def doc_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the document catalog: those of labelled documents, and one for each third label as it were on disk alone."""
    lab = table(spark, sf_dir, "labels").select("doc_id").distinct()
    d = table(spark, sf_dir, "documents").join(lab, "doc_id")
    own = d.select(F.col("source").alias("bucket"), F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("key"), F.octet_length("text").cast("long").alias("bytes"), (F.lit(1704067200) + F.col("doc_id")).cast("long").alias("modified_at"))
    lost = lab.where(F.col("doc_id") % 3 == 0).select(F.lit("stray").alias("bucket"), F.concat(F.lit("lost/"), F.col("doc_id").cast("string")).alias("key"), (F.col("doc_id") * 10).cast("long").alias("bytes"), F.lit(1704067200).cast("long").alias("modified_at"))
    return own.unionByName(lost)


def object_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of object writes from events, in the order of event_id."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("bucket"), F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("key"), F.floor(F.col("value") * 100).cast("long").alias("size"),
        F.when(e % 3 != 0, F.concat(F.lit("class"), (e % 3).cast("string"))).alias("storage_class"), F.when(e % 5 != 0, F.concat(F.lit("node"), (e % 5).cast("string"))).alias("origin_node"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).cast("long").alias("written_at"), e.alias("version"),
    )


def replication_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replication log from events."""
    e = F.col("event_id")
    status = F.when(F.col("event_type") == "view", "applied").when(F.col("event_type") == "signup", "sent").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "pending").otherwise("dead_letter")
    made = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("long")
    return table(spark, sf_dir, "events").select(
        e.cast("string").alias("event_id"), F.concat(F.lit("node"), (e % 3).cast("string")).alias("origin_node"), F.when(e % 7 == 0, "delete").otherwise("put").alias("op"),
        F.concat(F.lit("b"), (F.col("user_id") % 4).cast("string")).alias("bucket"), F.concat(F.when(e % 10 == 0, "staging/").when(e % 10 < 4, "logs/").otherwise("data/"), F.col("user_id").cast("string")).alias("key"),
        F.floor(F.col("value") * 100).cast("long").alias("size"), F.when(e % 2 == 0, "cold").otherwise("hot").alias("storage_class"), F.when(e % 3 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("REGION_"), (e % 5).cast("string"))).alias("replication_group"),
        made.alias("created_at"), status.alias("status"), (F.get_json_object("props", "$.k").cast("int") % 25).alias("attempts"), F.when(e % 4 != 0, made + F.col("user_id") * 100).cast("long").alias("next_retry_at"), F.md5(e.cast("string")).alias("wire_checksum"),
    )


def multipart_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("upload_id"), F.concat(F.lit("b"), (F.col("o_custkey") % 5).cast("string")).alias("bucket"), F.concat(F.lit("up/"), F.col("o_orderkey").cast("string")).alias("key"), at.alias("created_at"), (at + 86400).alias("expires_at"))


def multipart_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part uploads; a part number may come more than once, the latest ship date counts."""
    at = F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).cast("long")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("upload_id"), F.col("l_linenumber").alias("part_number"), F.col("l_quantity").cast("long").alias("size"), at.alias("written_at"), F.col("l_partkey").alias("tie1"), F.col("l_suppkey").alias("tie2"), F.col("l_extendedprice").alias("tie3"))


def peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peers from nations, their group the region's name; node n keeps classes by n modulo 3."""
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    n = F.col("n_nationkey")
    classes = F.when(n % 3 == 0, F.array().cast("array<string>")).when(n % 3 == 1, F.array(F.lit("hot"))).otherwise(F.array(F.lit("hot"), F.lit("cold")))
    return table(spark, sf_dir, "nation").join(r, "n_regionkey").select(F.col("n_name").alias("node_id"), F.concat(F.lit("http://"), F.lower("n_name")).alias("url"), classes.alias("storage_classes"), F.when(n % 4 != 0, F.col("r_name")).alias("replication_group"))


def rules(spark: SparkSession, rows=None) -> DataFrame:
    """Ordered placement rules, first match wins; null conditions always hold."""
    rows = rows or [(0, "archive", "de/", None, None, 4000, "node2"), (1, "hot", None, "0", "text/", None, "node1"), (2, "cold", None, None, "application/", None, None), (3, "default", None, None, None, None, "node0")]
    return spark.createDataFrame(rows, schemas.RULES)


def blob_files(spark: SparkSession, root: str, with_content: bool = False) -> DataFrame:
    """Files below ``root``/bucket/..., bucket and key from the path; dot folders are left out. Content only if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.substring_index(F.col("path"), root.rstrip("/").rpartition("/")[2] + "/", -1)
    out = files.where(~rel.rlike(r"(^|/)\.")).select(F.substring_index(rel, "/", 1).alias("bucket"), F.regexp_replace(rel, "^[^/]*/", "").alias("key"), F.col("length").alias("bytes"), F.unix_timestamp("modificationTime").alias("modified_at"), *(["content"] if with_content else []))
    return out


def jdbc_objects(spark: SparkSession, url: str, dialect: str = "sqlite", column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 64, **options: str) -> DataFrame:
    """An object table of another database in the logical schema; its driver must be on the class path.

    With a numeric ``column`` and its ``bounds`` the table is read in ``parts`` ranges of it at once, else in one task.
    """
    names = {"sqlite": ("key", "size", "mime_type"), "postgres": ("object_key", "size_bytes", "content_type")}[dialect]
    if (column is None) != (bounds is None):
        raise ValueError("column and bounds go together")
    if column is not None:
        options |= {"partitionColumn": column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(parts)}
    raw = spark.read.format("jdbc").options(url=url, **options).load()
    for own, name in zip(names, ("key", "size", "mime_type")):
        raw = raw.withColumnRenamed(own, name)
    return raw


def save(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = None, mode: str = "errorifexists") -> None:
    """Write a table; zstd for Parquet. Spark's commit protocol replaces whole files only."""
    w = df.write.mode(mode).format(fmt)
    w = w.option("compression", "zstd") if fmt == "parquet" else w
    (w.partitionBy(partition_by) if partition_by else w).save(path)
