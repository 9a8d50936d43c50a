"""Exact top-k search by inner product, with norm-sorted scans and rotated partial sums.

Vectors become integers, floor(scale * x). Each partition reads its vectors in descending length.
A query's k-th best score so far is its threshold; it starts from the exact scores against the
longest vectors of the whole table. A batch of vectors is left as soon as |q| * |longest| is below
every threshold. Otherwise the first rotated coordinates (eigenvectors of the Gram matrix of all
vectors) give a partial sum, and Cauchy-Schwarz bounds the rest by the product of the residual
lengths: only pairs whose bound reaches the threshold get their exact integer product.

Queries go out in blocks of bounded size (``QUERY_BLOCK`` vectors), one at a time, each against all vectors.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quayside.llm.common import store, table

QUERY_BLOCK = 16_384  # vectors broadcast at once
HEAD = 2_048  # longest vectors that seed the thresholds
CELLS = 1 << 20  # query-vector pairs bounded at once in a task
DIMS = 1_000  # different dimensions of vectors in one search, each a search of its own
LIMIT = float(1 << 62)


def quantize(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id long, v array<long>, norm double, dim int of the vectors that take part.

    A null id, a null vector and a vector holding a null or non-finite component take no part.
    Scaled components are held within +-2**62.
    """
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fine = F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()
    fine &= F.coalesce(F.forall(F.col(vec_col), lambda x: x.isNotNull()), F.lit(False))
    fine &= F.coalesce(F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    ints = F.transform(v, lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(LIMIT)), F.lit(-LIMIT))).cast("long"))
    out = df.where(fine).select(F.col(id_col).cast("long").alias("id"), ints.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return out.select("id", "v", norm.alias("norm"), F.size("v").alias("dim"))


def matrix(column, dim: int) -> np.ndarray:
    flat = np.concatenate([np.asarray(x, np.int64) for x in column]) if len(column) else np.zeros(0, np.int64)
    return flat.reshape(len(column), dim)


def products(a: np.ndarray, b: np.ndarray, wide: bool) -> np.ndarray:
    """Exact row-wise inner products as int64; sums beyond 64 bits stop at its limits."""
    if not wide:
        return np.einsum("ij,ij->i", a, b)
    big = (a.astype(object) * b.astype(object)).sum(axis=1) if a.shape[1] else np.zeros(len(a), object)
    return np.array([max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in big], np.int64)


def merge(best_s, best_id, q, s, ids, k):
    """Put scores ``s`` of vectors ``ids`` for the queries ``q`` (positions) into the best k of each, in place."""
    touched = np.unique(q)
    qq = np.concatenate([np.repeat(touched, k), q])
    ss = np.concatenate([best_s[touched].ravel(), s])
    ii = np.concatenate([best_id[touched].ravel(), ids])
    have = ii != np.iinfo(np.int64).min
    qq, ss, ii = qq[have], ss[have], ii[have]
    order = np.lexsort((ii, ~ss, qq))
    qq, ss, ii = qq[order], ss[order], ii[order]
    first = np.searchsorted(qq, touched)
    rank = np.arange(len(qq)) - np.repeat(first, np.diff(np.append(first, len(qq))))
    keep = rank < k
    best_s[qq[keep], rank[keep]] = ss[keep]
    best_id[qq[keep], rank[keep]] = ii[keep]


NONE = np.iinfo(np.int64).min


class Block:
    """Queries, their rotated forms, and the best k of each."""

    def __init__(self, ids, vectors, rotation, k):
        self.ids, self.v, self.k = ids, vectors, k
        self.f = vectors.astype(np.float64)
        self.norm = np.sqrt((self.f**2).sum(axis=1))
        d = vectors.shape[1]
        self.h = max(1, math.ceil(d / 4)) if d else 0
        self.rotation = rotation
        self.part = self.f @ rotation[:, : self.h]
        self.rest = np.sqrt(np.maximum(0.0, self.norm**2 - (self.part**2).sum(axis=1)))
        self.floor = np.full(len(ids), -np.inf)
        self.clear()

    def clear(self):
        self.best_s = np.full((len(self.ids), self.k), NONE, np.int64)
        self.best_id = np.full((len(self.ids), self.k), NONE, np.int64)

    def threshold(self):
        own = np.where(self.best_id[:, -1] != NONE, self.best_s[:, -1].astype(np.float64), -np.inf)
        return np.maximum(own, self.floor)

    def scan(self, ids, vectors, norms) -> bool:
        """Take in a batch of descending length; false if no later, shorter one can matter."""
        top = float(norms.max()) if len(norms) else 0.0
        slack = 0.5 + 1e-9 * self.norm * top
        active = np.nonzero(self.norm * top >= self.threshold() - slack)[0]
        if not len(active):
            return False
        f = vectors.astype(np.float64)
        part = f @ self.rotation[:, : self.h]
        rest = np.sqrt(np.maximum(0.0, norms**2 - (part**2).sum(axis=1)))
        wide = float(self.norm.max()) * top >= float(1 << 62)
        step = max(1, CELLS // max(1, len(ids)))
        for at in range(0, len(active), step):
            q = active[at : at + step]
            bound = self.part[q] @ part.T + self.rest[q, None] * rest[None, :]
            reach = bound >= (self.threshold()[q] - slack[q])[:, None]
            reach &= self.ids[q, None] != ids[None, :]
            qi, ci = np.nonzero(reach)
            for cut in range(0, len(qi), 1 << 17):
                a, b = q[qi[cut : cut + (1 << 17)]], ci[cut : cut + (1 << 17)]
                merge(self.best_s, self.best_id, a, products(self.v[a], vectors[b], wide), ids[b], self.k)
        return True


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Eigenvectors of the Gram matrix of all vectors, largest first. Each task sums its own; Spark adds them up."""

    def gram(batches):
        total = np.zeros((dim, dim))
        for pdf in batches:
            f = matrix(pdf["v"], dim).astype(np.float64)
            total += f.T @ f
        import pandas as pd

        yield pd.DataFrame({"i": np.arange(dim, dtype=np.int32), "row": list(total)})

    rows = vectors.select("v").mapInPandas(gram, "i int, row array<double>")
    cells = rows.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    total = np.zeros((dim, dim))
    total[cells["i"].to_numpy(), cells["j"].to_numpy()] = cells["x"].to_numpy()
    scale = np.abs(total).max()
    _, vec = np.linalg.eigh(total / scale if np.isfinite(scale) and scale > 0 else np.eye(dim))
    return vec[:, ::-1].copy()


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products of each query, ties to the smaller id.

    Both inputs are of ``quantize``'s form and kept in storage. A vector with the query's id is no candidate; a
    query meets vectors of its own dimension. A repeated row counts as often as it is there; queries that share an id
    share one list. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    out = None
    dims = sorted(r["dim"] for r in queries.select("dim").distinct().limit(DIMS + 1).collect())
    if len(dims) > DIMS:
        raise ValueError(f"over {DIMS} different dimensions")
    for dim in dims:
        own = vectors.where(F.col("dim") == dim)
        asked = queries.where(F.col("dim") == dim).select("id", "v").distinct()
        turn = rotation(own, dim) if dim else np.zeros((0, 0))
        head = own.orderBy(F.col("norm").desc(), "id").limit(HEAD).select("id", "v", "norm").toPandas()
        n_blocks = max(1, math.ceil(asked.count() / query_block))
        for b in range(n_blocks):
            got = asked.where(F.pmod(F.xxhash64("id", "v"), F.lit(n_blocks)) == b).toPandas()
            if not len(got):
                continue
            block = Block(got["id"].to_numpy(np.int64), matrix(got["v"], dim), turn, k)
            block.scan(head["id"].to_numpy(np.int64), matrix(head["v"], dim), head["norm"].to_numpy(np.float64))
            block.floor = block.threshold()
            block.clear()
            sent = spark.sparkContext.broadcast(block)

            def scan(batches, sent=sent, dim=dim):
                import copy

                import pandas as pd

                blk = copy.copy(sent.value)
                blk.clear()
                going = True
                for pdf in batches:
                    going = going and blk.scan(pdf["id"].to_numpy(np.int64), matrix(pdf["v"], dim), pdf["norm"].to_numpy(np.float64))
                q, r = np.nonzero((blk.best_id != NONE) & (blk.best_s >= blk.floor[:, None]))
                yield pd.DataFrame({"query_id": blk.ids[q], "vec_id": blk.best_id[q, r], "score": blk.best_s[q, r]})

            ordered = own.select("id", "v", "norm").sortWithinPartitions(F.col("norm").desc())
            # A block's results are written before the next block is made, so that one block is held at a time.
            found = store(ordered.mapInPandas(scan, "query_id long, vec_id long, score long"), "topk-found")
            sent.destroy()
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 50, against all other rows of ``embeddings``."""
    vectors = store(quantize(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256), "topk-vectors")
    return top_k(vectors, vectors.where(F.col("id") % 50 == 0), k=5)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
