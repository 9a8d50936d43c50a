"""Shared parts of the training-data operators: tables, scratch storage, whole-text splitting."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local session may do without that setting; it then gets ``/tmp/checkpoints``.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file:///tmp/checkpoints"
    # A path without a scheme is one of Hadoop's default file system.
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{base.rstrip('/')}/quayside-{spark.sparkContext.applicationId}"


_roots: set[str] = set()


def _clean(spark: SparkSession, root: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone; the folder is then left to its owner
        pass


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below the scratch root; all of them go when this driver ends."""
    root = scratch_root(spark)
    if root not in _roots:
        _roots.add(root)
        atexit.register(_clean, spark, root)
    return f"{root}/{label}-{uuid.uuid4().hex[:12]}"


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to shared storage and read it again: lineage ends here, lost executors cost nothing before it."""
    path = scratch(df.sparkSession, label)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def local_path(uri: str) -> tuple[object, str]:
    """A pyarrow file system and the path in it, for any scheme that it knows."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def crc_fold(col: str, folds: int):
    """crc32 of the id as decimal text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % folds
