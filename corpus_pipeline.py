"""A cleaning pipeline over ``documents``: five stages, each written before the next one reads it.

1. quality classifier: documents that it rejects go.
2. line dedup: repeated chunks of lines are cut from all texts but the first; n_chars follows the text.
3. MinHash near-dedup: of each group the document with the smallest doc_id stays.
4. benchmark decontamination: documents that hold a benchmark item go.
5. SentencePiece: ids and decoded text of each document that is left, as counts and digests.

Stages 1 to 4 return the columns of ``documents`` and whatever else their input has, whatever the names. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quayside.llm import common, decontam, linededup, neardup, piecewise, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose quality score is at least ``quality.CUT``. A null or empty text has a score like any other; equal
    rows have equal scores. Without labels every score is one half, and all stay."""
    labels = common.table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, learn=quality.train_fold())
    return docs.where(quality.scorer(spark, model)("text") >= quality.CUT)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated chunks of lines. No document goes. Null texts stay null, with null n_chars; equal rows are one row twice."""
    return linededup.dedup_lines(docs, count_col=None).withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates. Rows with a null id, and empty or null texts, stay.

    A document is an id: rows that repeat one stay together, and go together as soon as one of them is to go.
    """
    gone = neardup.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    gone = common.store(gone, "pipeline-gone")
    return docs.alias("d").join(gone.alias("g").hint("merge"), F.col("d.doc_id") == F.col("g.doc_id"), "left_anti")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no benchmark item. Null and empty texts stay; an empty benchmark takes none."""
    return decontam.clean(docs, common.table(spark, sf_dir, "benchmark"))


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    return piecewise.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("minhash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("sentencepiece", piece_stage),
]

ORACLE_SQL = None  # models and alignments are beyond SQL; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.store(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
