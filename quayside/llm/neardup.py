"""Near-duplicate documents by tensored minhash banding, links verified on full shingle sets.

Each distinct shingle set gets two collections of ``M`` tuples of two minhashes. The table keys are all ``M * M`` pairs
of a tuple from each, so 4*M minhash functions serve M*M tables of four minhashes. Two sets of similarity 0.75 lack a
common tuple in a collection with probability (1 - 0.75**2)**M, 9e-6 for M = 14. Keys are formed only from tuples that
another set has as well, which changes no match.

Links within a table's bucket are found without pairing up the bucket. First every set is verified against the bucket's
hub, the set with the fewest shingles that no other has, and components are formed. Then, for each hub with members of
several components, a member stands for its difference from the hub: with d the size of the differences of x and y, n
their numbers of shingles and o the common part of the differences, x and y are similar by ``percent`` just when
(100 + percent) * (dx + dy - 2 o) <= (100 - percent) * (nx + ny). Members not linked with the hub therefore need a large
common part, and an exact prefix join over the differences, rarest shingle first, finds all pairs that can have it.
Edits that stand alone come first in that order and meet nobody. These pairs are verified on the full sets as well.

Verification runs in blocks, which send a set once for all its pairs in a block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quayside.llm import shingles as S
from quayside.llm.common import store, table
from quayside.llm.components import components

M = 14  # tuples in each collection
BLOCK = 1 << 17  # shingles on each side of a verification block
PAIRS = 1 << 15  # pairs of a verification block
_RNG = np.random.default_rng(77)
_MULT = _RNG.integers(1, 1 << 63, 4 * M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, 4 * M, dtype=np.uint64)
_PAIR = _RNG.integers(1, 1 << 63, (2, 2 * M), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SIGNED = "n long, f1 long, f2 long, id long, tuples array<long>"
PRINT = ["f1", "f2", "n"]


def _fingerprint(own: np.ndarray) -> tuple[int, int, int]:
    """Size and 128-bit digest of a sorted set."""
    f1, f2 = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64)
    return len(own), int(f1), int(f2)


def _sign(batches):
    for pdf in batches:
        at = 0
        for run in S.grouped(pdf["text"]):
            sh, offs = S.shingles(run)
            low = S.minhashes(sh, offs, _MULT, _ADD)
            tuples = S.mix(low[:, 0::2] * _PAIR[0] + low[:, 1::2] * _PAIR[1] + np.arange(2 * M, dtype=np.uint64))
            tuples = ((tuples | np.uint64(1)) ^ (np.arange(2 * M) < M).astype(np.uint64)).view(np.int64)  # even: first collection
            marks = [_fingerprint(np.unique(sh[offs[i] : offs[i + 1]])) for i in range(len(run))]
            out = pd.DataFrame(marks, columns=["n", "f1", "f2"])
            yield out.assign(id=pdf["id"].iloc[at : at + len(run)].array, tuples=list(tuples)).astype({"id": "Int64"})
            at += len(run)


def _sets(batches):
    for pdf in batches:
        rows = [(*_fingerprint(own), own.tobytes()) for own in S.sets(pdf["text"])]
        yield pd.DataFrame(rows, columns=["n", "f1", "f2", "body"])


FOUND = "x long, y long, linked boolean, diff array<long>"


def _compare(percent: int):
    """Whether each pair of a block has at least ``percent`` similarity; where asked, the shingles that just one has."""

    def compare(_, pairs: pd.DataFrame, bodies: pd.DataFrame) -> pd.DataFrame:
        sets = {s: np.frombuffer(b, np.uint64) for s, b in zip(bodies["sid"], bodies["body"])}
        out = []
        for x, part in pairs.groupby("x"):
            own, ys = sets[x], part["y"].to_numpy()
            lens = np.array([len(sets[y]) for y in ys])
            linked = np.zeros(len(ys), bool)
            for at in range(0, len(ys), 512):
                cut, ln = ys[at : at + 512], lens[at : at + 512]
                flat = np.concatenate([sets[y] for y in cut])
                hit = np.searchsorted(own, flat)
                same = own[np.minimum(hit, len(own) - 1)] == flat
                both = np.add.reduceat(same, np.concatenate([[0], np.cumsum(ln)[:-1]])).astype(np.int64)
                linked[at : at + 512] = 100 * both >= percent * (len(own) + ln - both)
            diff = [np.setxor1d(own, sets[y], assume_unique=True).view(np.int64) if s else None for y, s in zip(ys, part["several"])]
            out.append(pd.DataFrame({"x": x, "y": ys, "linked": linked, "diff": diff}))
        return pd.concat(out) if out else pd.DataFrame({"x": [], "y": [], "linked": [], "diff": []})

    return compare


def in_blocks(pairs: DataFrame, bodies: DataFrame, blocks: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on the ``pairs`` (x, y, several) with their sets. bodies: sid, body; blocks: sid, blk.

    A block pair with very many pairs is split, so that no task gets more than ``PAIRS`` of them or so at once.
    """
    bx, by = (blocks.select(F.col("sid").alias(c), F.col("blk").alias("b" + c)).hint("merge") for c in "xy")
    placed = store(pairs.join(bx, "x").join(by, "y"), "dup-placed")
    parts = placed.groupBy("bx", "by").agg(F.ceil(F.count("*") / PAIRS).alias("parts"))
    dealt = placed.join(parts.hint("merge"), ["bx", "by"])
    dealt = store(dealt.select("bx", "by", F.pmod(F.xxhash64("x", "y"), "parts").alias("part"), "x", "y", "several"), "dup-dealt")
    need = dealt.select(F.col("bx").alias("cx"), F.col("by").alias("cy"), F.col("part").alias("cpart"), F.explode(F.array("x", "y")).alias("sid"))
    sent = bodies.join(need.distinct().hint("merge"), "sid")
    return dealt.groupBy("bx", "by", "part").cogroup(sent.groupBy("cx", "cy", "cpart")).applyInPandas(work, schema)


def _spread(batches):
    for pdf in batches:
        own = [np.frombuffer(b, np.int64) for b in pdf["body"]]
        for at in range(0, len(own), 256):
            cut = own[at : at + 256]
            yield pd.DataFrame({"sid": np.repeat(pdf["sid"].to_numpy()[at : at + 256], [len(s) for s in cut]), "shingle": np.concatenate(cut)})


def _own_shingles(bodies: DataFrame) -> DataFrame:
    """sid, own: how many shingles of each set no other set of ``bodies`` has."""
    spread = bodies.mapInPandas(_spread, "sid long, shingle long")
    single = spread.groupBy("shingle").agg(F.count("*").alias("c"), F.min("sid").alias("sid")).where(F.col("c") == 1)
    return store(single.groupBy("sid").agg(F.count("*").alias("own")), "dup-own")


def _may_link(percent: int, n: str, own: str, n2: str, own2: str):
    """Whether two sets can be similar enough by their sizes and numbers of own shingles alone.

    They share at most the smaller number of shingles that are not their own, and their union has the larger such
    number and both numbers of own ones at least.
    """
    a, b = F.col(n) - F.col(own), F.col(n2) - F.col(own2)
    return 100 * F.least(a, b) >= percent * (F.greatest(a, b) + F.col(own) + F.col(own2))


def _cross(found: DataFrame, labels: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """x, y: every pair of members of one hub, of different components, that can be similar enough.

    found: pairs of a hub x and a member y with their differences; labels: node, component.
    """
    star = found.where(F.col("diff").isNotNull()).select(F.col("x").alias("hub"), F.col("y").alias("sid"), F.size("diff").cast("long").alias("d"))
    named = star.join(labels.withColumnRenamed("node", "sid").hint("merge"), "sid", "left")
    named = store(named.select("hub", "sid", "d", F.coalesce("component", "sid").alias("label")), "dup-named")
    kinds = named.groupBy("hub", "label").agg(F.count("*").alias("c")).groupBy("hub")
    kinds = kinds.agg(F.max(F.struct("c", "label")).alias("m"), F.count("*").alias("kinds")).where(F.col("kinds") > 1)
    mixed = named.join(kinds.select("hub", F.col("m.label").alias("most")).hint("merge"), "hub")
    whole, rest = 100 + percent, 100 - percent
    known = mixed.join(nodes.select("sid", "n").hint("merge"), "sid")
    # Twice ``whole`` times the common part that a pair needs is the sum of both weights.
    known = known.withColumn("w", whole * F.col("d") - rest * F.col("n")).withColumn("outside", F.col("label") != F.col("most"))
    known = store(known, "dup-weights")
    least = known.groupBy("hub").agg(F.min("w").alias("w_all"), F.min(F.when(F.col("outside"), F.col("w"))).alias("w_out"))
    # The common part that any partner needs: by the least weight there, and by what a partner of fitting size can lack.
    need = F.greatest(
        F.ceil((F.col("w") + F.when(F.col("outside"), F.col("w_all")).otherwise(F.col("w_out"))) / (2 * whole)),
        F.ceil(F.col("d") - rest / whole * (F.col("n") + F.col("n") * 100 / percent) - 1e-6),
        F.lit(1),
    )
    known = store(known.join(least.hint("merge"), "hub").select("hub", "sid", "label", "outside", "n", "d", "w", need.alias("need")), "dup-known")
    known = known.where(F.col("need") <= F.col("d"))
    diffs = found.select(F.col("x").alias("hub"), F.col("y").alias("sid"), "diff")
    cells = diffs.join(known.select("hub", "sid").hint("merge"), ["hub", "sid"], "left_semi").select("hub", "sid", F.explode("diff").alias("e"))
    cells = store(cells, "dup-cells")
    often = cells.groupBy("hub", "e").agg(F.count("*").alias("f")).where(F.col("f") > 1)
    own = Window.partitionBy("hub", "sid")
    ranked = cells.join(often.hint("merge"), ["hub", "e"])
    ranked = ranked.select("hub", "sid", "e", F.row_number().over(own.orderBy("f", "e")).alias("r"), F.count("*").over(own).alias("many"))
    # Shingles of one member alone come before all others.
    ranked = ranked.join(known.hint("merge"), ["hub", "sid"]).withColumn("left", F.col("many") - F.col("r") + 1).where(F.col("left") >= F.col("need"))
    ranked = store(ranked.select("hub", "e", "sid", "label", "outside", "n", "d", "w", "left"), "dup-ranked")
    p, q = (ranked.select("hub", "e", *[F.col(c).alias(c + k) for c in ("sid", "label", "outside", "n", "w", "left")]) for k in "xy")
    fits = (F.col("labelx") != F.col("labely")) & (~F.col("outsidey") | (F.col("sidx") < F.col("sidy")))
    fits &= 2 * whole * F.least("leftx", "lefty") >= F.col("wx") + F.col("wy")
    fits &= 100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")
    joined = p.where("outsidex").alias("p").join(q.alias("q").hint("merge"), (F.col("p.hub") == F.col("q.hub")) & (F.col("p.e") == F.col("q.e")) & fits)
    return joined.select(F.least("sidx", "sidy").alias("x"), F.greatest("sidx", "sidy").alias("y"), F.lit(False).alias("several")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``.

    A null or wordless text has no shingles and no links. A text of fewer than five words is one shingle. Equal sets are
    linked without comparison of pairs. A null id takes part in no component: component_id null, kept true. A row that
    repeats an id with another text is another text of that id, with links of its own; component ids are smallest ids all
    the same. An empty table gives an empty result. Other columns of ``docs`` are not looked at.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = store(plain.mapInPandas(_sign, SIGNED), "dup-signed")
    known = signed.where((F.col("n") > 0) & F.col("id").isNotNull())
    sets = known.groupBy(*PRINT).agg(F.min("id").alias("id"), F.first("tuples").alias("tuples"))
    # A number of its own for each set; the table is written once, so that numbers stay.
    sets = store(sets.withColumn("sid", F.monotonically_increasing_id()), "dup-sets")

    half = sets.select("sid", F.explode("tuples").alias("key"))
    shared = store(half.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > 1).select("key"), "dup-shared")
    first = F.col("key").bitwiseAND(1) == 0
    tuples = half.join(shared.hint("merge"), "key").groupBy("sid")
    tuples = tuples.agg(F.collect_list(F.when(first, F.col("key"))).alias("a"), F.collect_list(F.when(~first, F.col("key"))).alias("b"))
    keys = F.explode(F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.xxhash64(x, y)))))
    buckets = store(tuples.where((F.size("a") > 0) & (F.size("b") > 0)).select("sid", keys.alias("key")), "dup-buckets")
    full = buckets.groupBy("key").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where(F.col("lo") < F.col("hi"))
    members = store(buckets.join(store(full, "dup-full").hint("merge"), "key"), "dup-members")

    near = members.groupBy("sid").agg(F.min("lo").alias("near"))
    near = store(sets.select("sid", "id", *PRINT).join(near.hint("merge"), "sid"), "dup-near")
    # One text of each set in a bucket. Rows of the same id with another text fall out by their fingerprints.
    texts = plain.join(near.select("id").distinct().hint("merge"), "id", "left_semi")
    bodies = texts.select("text").mapInPandas(_sets, "n long, f1 long, f2 long, body binary")
    bodies = bodies.join(near.select("sid", *PRINT).hint("merge"), PRINT).dropDuplicates(PRINT).select("sid", "body")
    bodies = store(bodies, "dup-bodies")
    nodes = near.join(_own_shingles(bodies).hint("merge"), "sid", "left").select("sid", "n", "near", F.coalesce("own", F.lit(0)).alias("own"))
    # A set of which too much is its own is linked with nothing.
    nodes = store(nodes.where(100 * (F.col("n") - F.col("own")) >= percent * F.col("n")), "dup-linkable")
    weight = nodes.groupBy("near").agg(F.greatest(F.ceil(F.sum("n") / BLOCK), F.lit(1)).alias("cut"))
    nodes = nodes.join(weight.hint("merge"), "near").select("sid", "n", "own", F.xxhash64("near", F.pmod(F.xxhash64("sid"), "cut")).alias("blk"))
    nodes = store(nodes, "dup-nodes")

    # The hub of a bucket is the set with the fewest shingles of its own: the nearest to what the bucket has in common.
    seen = store(members.select("key", "sid").join(nodes.select("sid", "n", "own").hint("merge"), "sid"), "dup-seen")
    hub = seen.groupBy("key").agg(F.min(F.struct("own", "sid", "n")).alias("h"), F.count("*").alias("c")).where(F.col("c") > 1)
    hub = store(hub.select("key", F.col("h.sid").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.own").alias("hub_own")), "dup-hub")
    star = seen.join(hub.hint("merge"), "key").where(F.col("sid") != F.col("hub")).groupBy("hub", "sid")
    star = store(star.agg(*[F.first(c).alias(c) for c in ("n", "own", "hub_n", "hub_own")]), "dup-star")
    several = star.groupBy("hub").agg((F.count("*") > 1).alias("several"))
    asked = star.join(several.hint("merge"), "hub").withColumn("may", _may_link(percent, "n", "own", "hub_n", "hub_own")).where(F.col("may") | F.col("several"))
    asked = asked.select(F.col("hub").alias("x"), F.col("sid").alias("y"), "several")
    found = store(in_blocks(asked, bodies, nodes, _compare(percent), FOUND), "dup-found")
    labels = components(found.where("linked").select(F.col("x").alias("u"), F.col("y").alias("v")))
    cross = store(_cross(found, labels, nodes, percent), "dup-cross")
    more = store(in_blocks(cross, bodies, nodes, _compare(percent), FOUND).where("linked").select(F.col("x").alias("u"), F.col("y").alias("v")), "dup-more")
    if not more.isEmpty():
        labels = components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))

    # Sets without links are components of their own; a component's id is its smallest document id.
    grouped = sets.select(*PRINT, "sid", "id").join(labels.withColumnRenamed("node", "sid").hint("merge"), "sid", "left").select(*PRINT, "id", F.coalesce("component", "sid").alias("group"))
    grouped = store(grouped, "dup-groups")
    least = store(grouped.groupBy("group").agg(F.min("id").alias("component")), "dup-least")
    whole = store(grouped.join(least.hint("merge"), "group").select(*PRINT, "component"), "dup-whole")
    rows = signed.select("id", *PRINT)
    lone = (F.col("n") == 0) | F.col("id").isNull()
    alone = rows.where(lone).select("id", "n", F.col("id").alias("component"))
    out = rows.where(~lone).join(whole.hint("merge"), PRINT).select("id", "n", "component").unionByName(alone)
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(True))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of ``documents``: five-word shingles, similarity of 0.75 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) END AS sh FROM w
), e AS (SELECT doc_id, unnest(sh) AS g FROM s), n AS (SELECT doc_id, len(sh) AS n FROM s
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)
), ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
  SELECT doc_id, doc_id AS root FROM documents UNION SELECT ways.y, r.root FROM r JOIN ways ON r.doc_id = ways.x
)
SELECT doc_id, n AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept FROM n JOIN r USING (doc_id) GROUP BY doc_id, n
"""
