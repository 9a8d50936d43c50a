"""Language identification: known words first, shorter and shorter character n-grams for the rest.

A model holds, per language, log frequencies of words and of character n-grams (with word ends marked) from a bounded
sample of texts of each language. A known word adds its log frequencies; for an unknown word the longest order of
n-grams of which the model knows at least one adds the mean of those. Only differences between languages count.
"""

import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quayside.llm.common import crc_fold, table

SAMPLE = 1_000  # texts of each language that a model is fitted on at most
ORDERS = (5, 4, 3, 2, 1)
LEAST = 2  # a word or n-gram seen less often in the sample is unknown
SMOOTH = 0.5
CACHE = 500_000  # words kept by a worker
LANGUAGES = 1_000  # languages that a model knows at most


def _ranges(kinds: str) -> str:
    """Code points of the general categories that begin with one of ``kinds``, as the inside of a character class."""
    have = [c for c in range(0x32400) if unicodedata.category(chr(c))[0] in kinds]
    ends = [c for k, c in enumerate(have) if k + 1 == len(have) or have[k + 1] != c + 1]
    starts = [c for k, c in enumerate(have) if not k or have[k - 1] != c - 1]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends))


#: A letter and the letters and combining marks behind it.
WORD = re.compile(f"[{_ranges('L')}][{_ranges('LM')}]*")


class Model:
    def __init__(self, texts, langs):
        self.key = uuid.uuid4().hex
        self.langs = sorted(set(langs))
        at = {x: i for i, x in enumerate(self.langs)}
        words = [Counter() for _ in self.langs]
        for t, x in zip(texts, langs):
            words[at[x]].update(WORD.findall((t or "").lower()))
        self.words = self._table(words)
        self.grams = {}
        for n in ORDERS:
            counts = [Counter() for _ in self.langs]
            for i, c in enumerate(words):
                for w, k in c.items():
                    for g in grams(w, n):
                        counts[i][g] += k
            self.grams[n] = self._table(counts)

    def _table(self, counts) -> dict[str, tuple]:
        """Centred log frequencies of what occurs ``LEAST`` times or more."""
        total = Counter()
        for c in counts:
            total.update(c)
        keep = sorted(k for k, v in total.items() if v >= LEAST)
        size = np.array([sum(c.values()) for c in counts], float)
        raw = np.array([[c[k] for c in counts] for k in keep], float).reshape(len(keep), len(counts))
        log = np.log((raw + SMOOTH) / (size + SMOOTH * (len(keep) + 1)))
        log -= log.mean(axis=1, keepdims=True) if log.shape[1] else 0
        return dict(zip(keep, map(tuple, log.tolist())))

    def word(self, w: str) -> tuple:
        got = self.words.get(w)
        if got is not None:
            return got
        for n in ORDERS:
            table = self.grams[n]
            known = [table[g] for g in grams(w, n) if g in table]
            if known:
                return tuple(sum(c) / len(known) for c in zip(*known))
        return (0.0,) * len(self.langs)


def grams(word: str, n: int) -> list[str]:
    """N-grams of a word with its ends marked; one character has no marks."""
    if n == 1:
        return list(word)
    w = f"<{word}>"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


class Rows(dict):
    """Words with the numbers of their rows: a new word gets the next one."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.vectors = model, []

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self.vectors)
        self.vectors.append(self.model.word(word))
        return i


class Predictor:
    """Predictions with the vectors of words kept between texts, at most ``CACHE`` of them and those of one text."""

    def __init__(self, model: Model):
        self.model, self.rows, self.filled = model, Rows(model), 0
        self.matrix = np.zeros((4096, len(model.langs)), np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its probability; ("und", 0.0) for a null text or one without letters."""
        words = WORD.findall(text.lower()) if text else []
        if not words or not self.model.langs:
            return "und", 0.0
        if len(self.rows) > CACHE:
            self.rows, self.filled = Rows(self.model), 0
        at = list(map(self.rows.__getitem__, words))
        have = len(self.rows.vectors)
        if have > self.filled:
            if have > len(self.matrix):
                self.matrix = np.concatenate([self.matrix, np.zeros((have, self.matrix.shape[1]), np.float32)])
            self.matrix[self.filled : have] = self.rows.vectors[self.filled : have]
            self.filled = have
        total = self.matrix.take(at, axis=0).sum(axis=0, dtype=np.float64)
        z = total / np.sqrt(len(words))
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.model.langs[best], float(p[best] / p.sum())


_own: list[Predictor] = []


def predictor(model: Model) -> Predictor:
    """The predictor of this worker process for a model, with the words that its earlier tasks have met."""
    if not _own or _own[0].model.key != model.key:
        _own[:] = [Predictor(model)]
    return _own[0]


def fit(docs: DataFrame, sample: int = SAMPLE, learn=None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from at most ``sample`` documents of each language, the first in the order of their id's hash.

    ``learn`` is a condition on the rows; null ids, texts and languages teach nothing. An id counts once in a language, by
    its smallest text. More than ``LANGUAGES`` languages are an error; without any, every prediction is ``und``.
    """
    rows = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.where(learn) if learn is not None else rows
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    many = rows.groupBy("lang").agg(F.approx_count_distinct("id").alias("n")).limit(LANGUAGES + 1).collect()
    if len(many) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages")
    # A share of each language by the hash of the id, about twice what is wanted, and wider where that was too little.
    place = (F.pmod(F.xxhash64("id"), F.lit(1 << 31)) / float(1 << 31)).alias("place")
    share = {r["lang"]: min(1.0, (2 * sample + 100) / max(1, r["n"])) for r in many}
    texts: dict[str, list[str]] = {}
    while share:
        spark = docs.sparkSession
        cut = F.broadcast(spark.createDataFrame(list(share.items()), f"lang {docs.schema[lang_col].dataType.simpleString()}, share double"))
        near = rows.select("*", place).join(cut, "lang").where(F.col("place") <= F.col("share"))
        one = near.groupBy("lang", "id").agg(F.min("text").alias("text"), F.min("place").alias("place"))
        first = Window.partitionBy("lang").orderBy("place", "id")
        got = one.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= sample).toPandas()
        for lang, part in got.sort_values(["lang", "rank"]).groupby("lang"):
            texts[lang] = part["text"].tolist()
        share = {x: min(1.0, 4 * c) for x, c in share.items() if c < 1.0 and len(texts.get(x, [])) < sample}
    pairs = [(t, x) for x in sorted(texts) for t in texts[x]]
    return Model([t for t, _ in pairs], [x for _, x in pairs])


def identify(docs: DataFrame, model: Model, text_col: str = "text"):
    """A column: struct<lang_pred, score> of ``text_col``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        p = predictor(sent.value)
        for texts in batches:
            yield pd.DataFrame([p.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict(F.col(text_col))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of ``documents``. A row with a null id teaches nothing and is held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, learn=crc_fold("doc_id", 3) != 1)
    out = docs.select("doc_id", F.coalesce(crc_fold("doc_id", 3) == 1, F.lit(True)).alias("held_out"), identify(docs, model).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")
