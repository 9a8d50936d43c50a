"""Benchmark decontamination: rare n-gram seeds, then local alignment of words.

Words are runs of letters and digits in lower case. Over all documents the counts of the benchmark's words give each
n-gram of an item its surprise, the bits of its words' frequencies taken as independent. N-grams of at least ``BITS``
bits, and an item's ``FEWEST`` most surprising ones of each size in any case, are its seeds. A document that has a seed is aligned with
the item around the place by Smith-Waterman (match +2, mismatch and gap -1); the score over twice the item's words is the
similarity, 1 for a whole copy.

Surprise comes from single words' counts, so an item that many documents copy keeps its seeds. Items go out in chunks of
bounded size, each against all documents.
"""



import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from quayside.llm.common import table

SEEDS = (2, 3)  # words in a seed
BITS = 24.0
FEWEST = 8
LEAST = 0.5  # similarity from which a document holds an item
CHUNK = 20_000  # items sent out at once
WORD = re.compile(r"[^\W_]+")

HIT = "item_id long, similarity double, first_word int, last_word int"


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def align(item: list[str], window: list[str]) -> tuple[int, int, int]:
    """Best local score, and the first and last word of the window in it."""
    ids = {w: k for k, w in enumerate(dict.fromkeys(item))}
    a = np.array([ids[w] for w in item])
    n = len(a)
    step = np.arange(n + 1)
    prev, start_prev = np.zeros(n + 1, np.int64), np.full(n + 1, -1, np.int64)
    best, first, last = 0, -1, -1
    for j, w in enumerate(window):
        k = ids.get(w, -1)
        diag = prev[:-1] + np.where(a == k, 2, -1)
        cur, start = np.zeros(n + 1, np.int64), np.full(n + 1, j, np.int64)
        fresh = prev[:-1] <= 0
        start[1:] = np.where(fresh, j, start_prev[:-1])
        cur[1:] = diag
        up = prev - 1
        take = up > cur
        cur, start = np.where(take, up, cur), np.where(take, start_prev, start)
        cur = np.maximum(cur, 0)
        # Gaps along the item: the best earlier value less one for each word left out.
        run = np.maximum.accumulate(cur + step)
        src = np.maximum.accumulate(np.where(cur + step == run, step, 0))
        side = run - step
        take = side > cur
        start = np.where(take, start[src], start)
        cur = np.where(take, side, cur)
        top = int(cur.argmax())
        if cur[top] > best:
            best, first, last = int(cur[top]), int(start[top]), j
        prev, start_prev = cur, start
    return best, first, last


class Items:
    """Items with their seeds, found by each seed's rarest word."""

    def __init__(self, items: dict[int, list[str]], counts: dict[str, int], total: int, sizes: tuple[int, ...] = SEEDS, bits: float = BITS, fewest: int = FEWEST):
        self.items = items
        cost = {w: -math.log2((counts.get(w, 0) + 0.5) / (total + 1)) for ws in items.values() for w in ws}
        self.anchors: dict[str, dict[tuple, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        self.offsets: dict[str, set[tuple[int, int]]] = defaultdict(set)
        for i, ws in items.items():
            for n in sorted({min(s, len(ws)) for s in sizes} - {0}):
                ranked = sorted(((sum(cost[w] for w in ws[j : j + n]), -j) for j in range(len(ws) - n + 1)), reverse=True)
                for rank, (c, j) in enumerate(ranked):
                    if c < bits and rank >= fewest:
                        break
                    gram = tuple(ws[-j : -j + n])
                    rare = max(range(n), key=lambda k: cost[gram[k]])
                    self.anchors[gram[rare]][gram].append((i, -j))
                    self.offsets[gram[rare]].add((rare, n))
        self.anchors = {w: {g: x for g, x in d.items()} for w, d in self.anchors.items()}
        self.offsets = dict(self.offsets)
        self.keys = frozenset(self.anchors)

    def find(self, text: str | None, least: float) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, last word): the best place of each item that the text holds."""
        ws = words(text)
        rare = self.keys.intersection(ws)
        if not rare:
            return []
        spots: dict[int, set[int]] = defaultdict(set)
        for p, w in enumerate(ws):
            if w in rare:
                for off, n in self.offsets[w]:
                    if p >= off:
                        for i, j in self.anchors[w].get(tuple(ws[p - off : p - off + n]), ()):
                            spots[i].add(p - off - j)
        out = []
        for i, starts in spots.items():
            item = self.items[i]
            need = Counter(item)
            # Gaps cost one each, so that an alignment of this similarity has no more of them than this.
            pad = math.ceil(2 * (1 - least) * len(item)) + 1
            best, end = None, -1
            merged: list[list[int]] = []
            for s in sorted(starts):
                a, b = max(0, s - pad), min(len(ws), s + len(item) + pad)
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            for a, b in merged:
                window = ws[a:b]
                # No alignment can match more words of the item than are there, each as often as both have it.
                both = need & Counter(filter(need.__contains__, window))
                if sum(both.values()) / len(item) < least:
                    continue
                score, first, last = align(item, window)
                sim = score / (2 * len(item))
                if sim >= least and (best is None or sim > best[1]):
                    best = (i, sim, a + first, a + last)
            if best:
                out.append(best)
        return sorted(out)


def _counts(docs: DataFrame, text_col: str, vocabulary: frozenset[str]) -> tuple[dict[str, int], int]:
    """Occurrences in all documents of the words of ``vocabulary``, and of all words."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        from collections import Counter

        c, n = Counter(), 0
        for pdf in batches:
            for t in pdf["text"]:
                ws = words(t)
                n += len(ws)
                c.update(filter(sent.value.__contains__, ws))
        yield pd.DataFrame({"word": [*c, None], "n": [*c.values(), n]})

    got = docs.select(F.col(text_col).alias("text")).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in got}
    return counts, counts.pop(None, 0)


def _finder(sent, least: float):
    @F.pandas_udf(f"array<struct<{', '.join(x.replace(' ', ':') for x in HIT.split(', '))}>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, ids = sent.value
        for texts in batches:
            rows = []
            for t in texts:
                best = {}
                for k, sim, a, b in own.find(t, least):
                    if ids[k] not in best or sim > best[ids[k]]["similarity"]:
                        best[ids[k]] = {"item_id": ids[k], "similarity": sim, "first_word": a, "last_word": b}
                rows.append([best[i] for i in sorted(best)])
            yield pd.Series(rows, dtype=object)

    return find


def finders(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, chunk: int = CHUNK, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> list:
    """Column functions text -> array<struct<item_id, similarity, first_word, last_word>>, one for each chunk of items.

    Items without words or with a null id or text are held by no document; items that repeat an id are separate texts of
    it, of which the best counts.
    """
    spark = docs.sparkSession
    n_chunks = max(1, math.ceil(benchmark.count() / chunk))
    out = []
    for c in range(n_chunks):
        rows = benchmark.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).where(F.pmod(F.xxhash64(item_id, item_text), F.lit(n_chunks)) == c)
        got = rows.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).distinct().collect()
        texts = sorted((r["i"], r["t"]) for r in got)
        items = {k: words(t) for k, (_, t) in enumerate(texts)}
        names = [i for i, _ in texts]
        items = {k: w for k, w in items.items() if w}
        if not items:
            continue
        counts, total = _counts(docs, text_col, frozenset(w for ws in items.values() for w in ws))
        out.append(_finder(spark.sparkContext.broadcast((Items(items, counts, total), names)), least))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", **named) -> DataFrame:
    """doc_id, item_id, similarity, first_word, last_word: every item of ``benchmark`` that a document holds, once.

    A null or empty text holds nothing. Repeated rows of ``docs`` give repeated results; an empty benchmark none. Of places
    of one similarity the first counts. Other columns of ``docs`` are not looked at.
    """
    out = None
    for find in finders(docs, benchmark, least, text_col=text_col, **named):
        own = docs.select(F.col(id_col).alias("doc_id"), F.explode(find(F.col(text_col))).alias("h")).select("doc_id", "h.*")
        out = own if out is None else out.unionByName(own)
    return out if out is not None else docs.sparkSession.createDataFrame([], f"doc_id long, {HIT}")


def clean(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, text_col: str = "text", **named) -> DataFrame:
    """The rows of ``docs`` that hold no item of ``benchmark``, whole and with all their columns."""
    for find in finders(docs, benchmark, least, text_col=text_col, **named):
        docs = docs.where(F.size(find(F.col(text_col))) == 0)
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which items of ``benchmark`` each text of ``documents`` holds."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
