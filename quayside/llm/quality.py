"""Quality scores by nearest-neighbour voting over latent-semantic vectors.

A text's features are its terms (hashed words in lower case), counts of three-character patterns of its shape (letters,
cases, digits, each kind of mark; runs collapsed) and coarse bins of how much it repeats itself. Log counts weighted by
rarity, terms by ``TERM_WEIGHT`` beside the rest, are projected onto ``RANK`` singular directions of a bounded sample of
labelled texts. The sample's vectors go out to all tasks; every text meets all of them in one blocked product, and its
``NEIGHBOURS`` nearest vote with the power ``SHARPNESS`` of their cosine.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from quayside.llm.common import crc_fold, table

SAMPLE = 4_000  # labelled texts that a model holds at most
RANK = 128
NEIGHBOURS = 25
SHARPNESS = 8
PRIOR_WEIGHT = 0.05
CUT = 0.3

_MARKS = ".,;:!?|#$%&*()[]{}<>=_-+/\\\"'@~"
CLASSES = 6 + len(_MARKS)
_CLASS = np.full(256, 0, np.int64)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[128:] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[32, 9]] = 4
_CLASS[[10, 13]] = 5
for _k, _c in enumerate(_MARKS):
    _CLASS[ord(_c)] = 6 + _k
HASHED = 4096
BINS = 12
RATIOS = 8
LOOKS = HASHED + BINS * RATIOS
TERMS = 4096
TERM_WEIGHT = 0.5
WIDTH = LOOKS + TERMS


def features(text: str | None) -> np.ndarray:
    """Counts of shape patterns, indicators of repetition bins and counts of terms; all zero for a null or empty text."""
    out = np.zeros(WIDTH, np.float32)
    if not text:
        return out
    code = _CLASS[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    code = code[np.concatenate([[True], code[1:] != code[:-1]])]
    if len(code) > 2:
        tri = (code[:-2] * CLASSES + code[1:-1]) * CLASSES + code[2:]
        out[:HASHED] = np.bincount((tri * 2654435761 >> 7) % HASHED, minlength=HASHED)
    words, lines = text.split(), text.split("\n")
    n = len(words)
    if n:
        distinct = set(words)
        size = len(text)
        letters = sum(map(len, words))
        ratios = (
            len(distinct) / n,
            sum(a == b for a, b in zip(words, words[1:])) / n,
            len(set(zip(words, words[1:], words[2:]))) / max(1, n - 2),
            len(set(lines)) / len(lines),
            min(1.0, n / len(lines) / 60),
            min(1.0, letters / n / 15),
            min(1.0, np.log2(n + 1) / 14),
            min(1.0, 5 * len(re.findall(r"[^\w\s.,]", text)) / size),
        )
        for k, r in enumerate(ratios):
            out[HASHED + k * BINS + min(BINS - 1, int(r * BINS))] = 3.0
        for w, c in Counter(text.lower().split()).items():
            out[LOOKS + zlib.crc32(w.encode("utf-8", "replace")) % TERMS] += c
    return out


def blocks(texts):
    """Feature matrices of 512 texts at a time."""
    for at in range(0, len(texts), 512):
        yield np.array([features(t) for t in texts[at : at + 512]], np.float32)


class Model:
    """Labelled vectors and the projection that made them."""

    def __init__(self, texts, labels, seed: int = 5):
        self.y = np.asarray(labels, np.float64)
        self.prior = float(self.y.mean()) if len(self.y) else 0.5
        # Features are made twice, block by block, so that the weighted matrix is the only large one.
        seen = sum(((x > 0).sum(axis=0) for x in blocks(texts)), np.zeros(WIDTH, np.int64))
        self.idf = (np.log((1 + len(texts)) / (1 + seen)) + 0.1).astype(np.float32)
        w = np.empty((len(texts), WIDTH), np.float32)
        for k, x in enumerate(blocks(texts)):
            w[512 * k : 512 * (k + 1)] = self._weigh(x)
        rank = min(RANK, *w.shape) if len(w) else 0
        if rank:
            # Singular directions by subspace iteration from a fixed start.
            q = np.linalg.qr(w.T @ np.random.default_rng(seed).standard_normal((len(w), rank + 8)).astype(np.float32))[0]
            for _ in range(4):
                q = np.linalg.qr(w.T @ (w @ q))[0]
            u = np.linalg.svd(w @ q, full_matrices=False)[2]
            self.turn = (q @ u.T)[:, :rank].astype(np.float64)
        else:
            self.turn = np.zeros((WIDTH, 1), np.float32)
        self.v = self._unit(np.concatenate([w[k : k + 512] @ self.turn for k in range(0, len(w), 512)])) if len(w) else np.zeros((0, 1))

    def _weigh(self, x):
        w = np.log1p(x).astype(np.float64) * self.idf
        for part in (w[:, :LOOKS], w[:, LOOKS:]):
            part /= np.maximum(1e-9, np.sqrt((part**2).sum(axis=1, keepdims=True)))
        w[:, LOOKS:] *= TERM_WEIGHT
        return w

    @staticmethod
    def _unit(v):
        return v / np.maximum(1e-9, np.sqrt((v**2).sum(axis=1, keepdims=True)))

    def score(self, texts) -> np.ndarray:
        """Share of label 1 among the weighted neighbours, drawn to the sample's share by ``PRIOR_WEIGHT``.

        Of neighbours at one cosine the earlier in the sample come first.
        """
        x = np.array([features(t) for t in texts], np.float32).reshape(len(texts), WIDTH)
        out = np.full(len(texts), self.prior)
        if not len(self.v):
            return out
        # Cosines to 9 places, so that equal texts and equal neighbours tie in every batch.
        cos = np.round(self._unit(self._weigh(x) @ self.turn) @ self.v.T, 9)
        k = min(NEIGHBOURS, cos.shape[1])
        least = np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k, None]
        over, tied = cos > least, cos == least
        near = np.nonzero(over | (tied & (tied.cumsum(axis=1) <= k - over.sum(axis=1, keepdims=True))))[1].reshape(len(x), k)
        w = np.maximum(0.0, np.take_along_axis(cos, near, 1)) ** SHARPNESS
        return ((w * self.y[near]).sum(axis=1) + PRIOR_WEIGHT * self.prior) / (w.sum(axis=1) + PRIOR_WEIGHT)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, learn=None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model from at most ``sample`` labelled documents, the first in the order of their id's hash.

    ``learn`` is a condition on the labels; null ids, null labels and labels without a document teach nothing. An id
    counts once, by its smallest label and its smallest text. Without labels every score is one half.
    """
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.where(learn) if learn is not None else rows
    some = rows.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).groupBy("_id").agg(F.min("_label").alias("_label"))
    some = some.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    # At most ``sample`` ids and labels are sent out to pick the texts; rows of one id meet before they come here.
    got = texts.join(F.broadcast(some), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.min("_label").alias("_label")).toPandas()
    got = got.sort_values("_id", kind="stable")
    return Model(got["_text"].tolist(), got["_label"].tolist())


def scorer(spark: SparkSession, model: Model):
    """A column function: text -> score."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        own = texts.tolist()
        parts = [sent.value.score(own[i : i + 512]) for i in range(0, len(own), 512)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return score


def train_fold():
    """Rows that labels may be learnt from: crc32 of the id as text, modulo 5, is not 0."""
    return crc_fold("doc_id", 5) != 0


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of every text of ``documents``. A row with a null id is held out."""
    docs = table(spark, sf_dir, "documents")
    score = scorer(spark, fit(docs, table(spark, sf_dir, "labels"), learn=train_fold()))
    out = docs.select("doc_id", F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(True)).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
