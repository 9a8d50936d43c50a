"""Line dedup by content-defined chunks of lines, in DataFrame operations alone.

A chunk is a run of lines of two kinds. A window is a shortest run of lines with at least ``LONG_WORDS`` words: from each
line forwards and from each line backwards. Its edges come from its own lines only, and the windows of any passage of
``LONG_WORDS`` words or more cover it, so that such a passage is found whole wherever it stands. Shorter runs of two or
more lines come from cuttings: a document's lines are hashed, and ``SEEDS`` bits of a rolling hash over the last two line
hashes decide where as many independent cuttings end their runs; not all repeated runs are found among those.

Chunks that occur more than once in the whole table are candidates by hash; each occurrence is compared with the first one
byte by byte, and all but the first, and those that overlap it, are removed. The first is the smallest (doc_id, row hash,
line).

Joins are merge joins at every size, so that the exchanges of a small table are those of a large one.

Every line that is removed stays in the smallest row and place that have it in a repeated chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quayside.llm.common import store, table

SEEDS = 8  # independent cuttings; each cuts after a line with probability 1/2
LONG_WORDS = 50  # a repeated passage of so many words is always found; a single line of so many counts as a chunk


def row_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), F.col(text_col))


def second_key(id_col: str, text_col: str):
    """Another hash of a row. What is cut from a row is found under both, 128 bits, and compared on the row's own bytes."""
    return F.xxhash64(F.lit(91), F.col(text_col), F.col(id_col))


def barrier(df: DataFrame, **columns) -> DataFrame:
    """Compute ``columns`` once per row: a generator keeps the optimizer from repeating them where they are used."""
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    out = df.select("*", one.alias("_b"))
    return out.select(*df.columns, *[F.col(f"_b.{n}").alias(n) for n in columns])


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seeds: int = SEEDS, long_words: int = LONG_WORDS) -> DataFrame:
    """id, rk, start, end, h: the eligible chunks of each document as line ranges with a 64-bit hash of their bytes."""
    base = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("rk"), F.split(text_col, "\n", -1).alias("lines_"))
    base = barrier(base.select("id", "rk", "lines_"), lines=F.col("lines_")).drop("lines_")
    hashed = barrier(base, lh=F.transform("lines", lambda x: F.xxhash64(x)))
    before = F.concat(F.array(F.lit(0).cast("long")), F.slice("lh", 1, F.greatest(F.size("lh") - 1, F.lit(0))))
    rolled = barrier(hashed, rh=F.transform(F.arrays_zip(F.col("lh").alias("a"), before.alias("b")), lambda p: F.xxhash64(p["b"], p["a"])))
    n = F.size("lines")

    def cutting(seed: int):
        ends = F.transform("rh", lambda x, i: F.when((F.shiftright(x, seed).bitwiseAND(1) == 0) | (i == n - 1), i + 1))
        return F.filter(ends, lambda e: e.isNotNull())

    def span(start, end):
        return F.shiftleft(start.cast("long"), 32).bitwiseOR(end.cast("long"))

    def ranges(ends):
        starts = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1))
        return F.transform(F.arrays_zip(starts.alias("start"), ends.alias("end")), lambda p: span(p["start"], p["end"]))

    # The line of each word; words of a line beyond the number that makes a window by itself change no window.
    counted = barrier(rolled, wc=F.transform("lines", lambda x: F.regexp_count(x, F.lit(r"\S+"))))
    owned = barrier(counted, owner=F.flatten(F.transform("wc", lambda c, i: F.array_repeat(i, F.least(c, F.lit(long_words))))))
    line, w = lambda k: F.get("owner", k), F.size("owner")
    first_words = F.filter(F.sequence(F.lit(0), w - 1), lambda k: (k == 0) | (line(k) != line(k - 1)))
    headed = barrier(owned, heads=F.when(w > 0, first_words).otherwise(F.array().cast("array<int>")))
    last_words = F.transform("heads", lambda k, i: F.coalesce(F.get("heads", i + 1), w) - 1)
    forwards = F.transform("heads", lambda k: span(line(k), line(k + long_words - 1) + 1))
    backwards = F.transform(last_words, lambda k: span(line(k - long_words + 1), line(k) + 1))
    # Empty lines between two lines that are windows by themselves.
    between = F.transform(last_words, lambda k: F.when((line(k - long_words + 1) == line(k)) & (line(k + long_words) == line(k + 1)) & (line(k + 1) > line(k) + 1), span(line(k), line(k + 1) + 1)))
    windows = F.filter(F.concat(forwards, backwards, between), lambda p: p.isNotNull())

    cut = barrier(headed, windows=windows, **{f"e{s}": cutting(s) for s in range(seeds)})
    start, end = lambda p: F.shiftright(p, 32).cast("int"), lambda p: p.bitwiseAND((1 << 32) - 1).cast("int")
    runs = barrier(cut.drop("owner", "heads"), runs=F.array_distinct(F.concat(*[ranges(F.col(f"e{s}")) for s in range(seeds)])))

    def words(p):
        return F.size(F.split(F.element_at("lines", start(p) + 1), " "))

    def n_words(p):
        return F.aggregate(F.slice("wc", start(p) + 1, end(p) - start(p)), F.lit(0), lambda a, x: a + x)

    # Windows cover runs of so many words.
    short = F.filter("runs", lambda p: (n_words(p) < long_words) & ((end(p) - start(p) >= 2) | (words(p) >= long_words)))
    spans = barrier(runs, spans=F.array_distinct(F.concat("windows", short)))
    body = lambda p: F.array_join(F.slice("lines", start(p) + 1, end(p) - start(p)), "\n")
    with_hash = F.transform("spans", lambda p: F.struct(start(p).alias("start"), end(p).alias("end"), F.xxhash64(body(p)).alias("h")))
    return spans.select("id", "rk", F.explode(with_hash).alias("c")).select("id", "rk", "c.start", "c.end", "c.h")


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seeds: int = SEEDS, long_words: int = LONG_WORDS) -> DataFrame:
    """rk, rk2, gone array<struct<start,end>>: the line ranges of each row that repeat an earlier chunk byte for byte."""
    cut = store(chunks(docs, id_col, text_col, seeds, long_words), "line-chunks")
    place = F.struct("id", "rk", "start", "end")
    seen = cut.groupBy("h").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    repeated = store(seen.where(F.col("n") > 1).select("h", "first"), "line-repeated")
    # Of a document that repeats a chunk, the ranges: few, and bounded by its own lines.
    # One that overlaps the first is no second copy of it.
    is_first = F.struct("id", "rk", "start", "end") == F.col("first")
    apart = (F.col("rk") != F.col("first.rk")) | (F.col("start") >= F.col("first.end"))
    found = cut.join(repeated.hint("merge"), "h").where(is_first | apart).groupBy("rk").agg(F.collect_list(F.struct("start", "end", "h", is_first.alias("is_first"))).alias("occ"))
    texts = docs.where(F.col(text_col).isNotNull())
    texts = texts.select(row_key(id_col, text_col).alias("rk"), second_key(id_col, text_col).alias("rk2"), F.col(text_col).alias("text"))
    both = barrier(texts.join(found.hint("merge"), "rk"), lines=F.split("text", "\n", -1)).drop("text")
    body = lambda p: F.array_join(F.slice("lines", p["start"] + 1, p["end"] - p["start"]), "\n")
    fields = lambda p: [p[f].alias(f) for f in ("start", "end", "h", "is_first")]
    said = both.select("rk", "rk2", F.explode(F.transform("occ", lambda p: F.struct(*fields(p), body(p).alias("body")))).alias("c")).select("rk", "rk2", "c.*")
    said = store(said, "line-occurrences")
    first = said.where("is_first").groupBy("h").agg(F.max("body").alias("first_body"))
    first = store(first, "line-first")
    same = said.where(~F.col("is_first")).join(first.hint("merge"), "h").where(F.col("body") == F.col("first_body"))
    return same.groupBy("rk", "rk2").agg(F.collect_set(F.struct("start", "end")).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seeds: int = SEEDS, long_words: int = LONG_WORDS, count_col: str | None = "lines_removed") -> DataFrame:
    """``docs`` with repeated chunks cut out of ``text_col`` and the number of lines removed in ``count_col`` (None: none).

    A null text stays null and an empty one empty; an empty table gives an empty result. All columns of ``docs`` are kept,
    whatever their names, but for one of ``count_col``'s name, which is replaced. Rows that are equal in id and text are
    one row twice: neither is removed for the other's sake. Ties go to the smaller row hash.
    """
    gone = store(removals(docs, id_col, text_col, seeds, long_words), "line-gone")
    # The row as it came is one column, so that no name of its columns meets one of these.
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("rk"), second_key(id_col, text_col).alias("rk2")
    )
    joined = whole.join(gone.hint("merge"), ["rk", "rk2"], "left").select("doc", "text", "gone")
    dropped = F.array_distinct(F.flatten(F.transform("gone", lambda p: F.sequence(p["start"], p["end"] - 1))))
    held = barrier(joined, lines=F.split("text", "\n", -1), dropped=dropped)
    # Flags by position, so that a long document costs its lines once.
    marks = F.map_from_arrays("dropped", F.transform("dropped", lambda x: F.lit(True)))
    held = barrier(held, flags=F.when(F.col("dropped").isNotNull(), marks))
    left = F.filter("lines", lambda x, i: ~F.map_contains_key(F.col("flags"), i))
    text = F.when(F.col("flags").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    count = F.when(F.col("flags").isNull(), 0).otherwise(F.coalesce(F.size("dropped"), F.lit(0))).cast("int")
    out = [text.alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns if c != count_col]
    return held.select(*out, *([count.alias(count_col)] if count_col else []))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lines_removed, text: every document without the chunks that an earlier one has."""
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "lines_removed", "text")
