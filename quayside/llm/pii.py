"""Personal data: four base kinds by pattern, secrets by their look, and more of all five by patterns learnt from them.

One pass over the texts finds the seeds: the base spans, and tokens that look like random keys (``secret``). It also notes
every other place that may be an identifier: tokens with an @ or ``LEAST_DIGITS`` digits, outside of the seeds. Each place
has five lexical patterns: the one, two and three words before it, the word before with the word behind, and the word
before with the shape of the place. Words of a context are looked for in ``CONTEXT_CHARS`` characters at its side.

Spark then scores the graph of patterns and instances in rounds: a pattern's confidence in a kind is the share of its
distinct instances that count as that kind. Patterns with enough such instances and a high confidence mark the unknown
places that have them, and what they mark counts as that kind from the next round on, under every pattern. Rounds go on
until no pattern enters; each enters once, so that they end.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, functions as F

from quayside.llm.common import store, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
SUPPORT = 5  # distinct instances of a kind, seeds or learnt, that a pattern needs
CONFIDENT = 0.8
LEAST_DIGITS = 3  # of a place without an @
CONTEXT_CHARS = 200
SECRET_LENGTH = 20  # characters of a token that looks like a key, at least
SECRET_BITS = 3.0  # entropy of its characters

# Fixed by the contract of op6: what counts as an address, a number and so on.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARKED = re.compile(r"[0-9@]")
_KEY = re.compile(r"[A-Za-z0-9_+/-]+")
_TURN = re.compile(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")
_GROUP = re.compile(r"[(+]*[0-9][0-9().+/-]*")
_WORDS = re.compile(r"\S+")
RUN_DIGITS = 19  # of a run of number groups; no kind has more


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses: at each @, the characters before it and the domain behind. Linear time."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Four dotted numbers at a time of each dotted run; those with a number over 255 are dropped."""
    out = []
    for m in _DOTTED.finditer(text):
        numbers = m.group().split(".")
        at = m.start()
        for k in range(0, len(numbers) - 3, 4):
            four = numbers[k : k + 4]
            size = sum(map(len, four)) + 3
            # A number of over 3 digits after its zeros is too large, however long.
            if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in four):
                out.append((at, at + size))
            at += size + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            digits = re.sub("[ -]", "", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m.group())) <= 15] if "+" in text else []


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start."""
    return [(k, a, b) for k, f in enumerate((emails, addresses, cards, phones)) for a, b in f(text)]


def looks_random(token: str) -> bool:
    """Long, of letters and digits that take turns often, with characters of high entropy."""
    if len(token) < SECRET_LENGTH or 6 * sum(1 for _ in _TURN.finditer(token)) < len(token):
        return False
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token.lower()).values()) >= SECRET_BITS


def secrets(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Tokens that look like keys, outside of the sorted spans ``taken``."""
    out, at = [], 0
    for m in _KEY.finditer(text):
        a, b = m.span()
        if b - a < SECRET_LENGTH:
            continue
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if (at == len(taken) or taken[at][0] >= b) and looks_random(m.group()):
            out.append((a, b))
    return out


def seeds(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of base spans and secrets, by kind, then start."""
    base = base_spans(text)
    return base + [(len(BASE), a, b) for a, b in secrets(text, sorted((a, b) for _, a, b in base))]


def shape(token: str) -> str:
    """Runs of letters as a, of digits as 0; other characters as they are."""
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", "0", token))


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of a place, in lower case with numbers masked."""
    before = re.sub(r"[0-9]+", "0", text[max(0, start - CONTEXT_CHARS) : start].lower())
    behind = re.sub(r"[0-9]+", "0", text[end : end + CONTEXT_CHARS].lower())
    words = before.split()
    if not words:
        return []
    glue = " " if before[-1:].isspace() else ""
    left = [f"{n} {' '.join(words[-n:])}{glue}" for n in (1, 2, 3) if len(words) >= n]
    right = behind.split(None, 1)[0] if behind.strip() else ""
    return [*left, f"r {words[-1]}{glue}|{'' if behind[:1].isspace() else '+'}{right}", f"s {words[-1]}{glue}|{shape(text[start:end])}"]


def candidates(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Places that may be identifiers, outside of the sorted spans ``taken``.

    These are tokens with an @ or ``LEAST_DIGITS`` digits, without marks and brackets around; number groups with one
    space between them are one place.
    """
    out, at = [], 0
    for m in _WORDS.finditer(text):
        a, b = m.span()
        if not _MARKED.search(text, a, b):
            continue
        while b > a and text[b - 1] in ".,;:!?)]}>\"'":
            b -= 1
        while a < b and text[a] in "[{<\"'":
            a += 1
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if b == a or (at < len(taken) and taken[at][0] < b):
            continue
        digits, group = sum(map(str.isdigit, text[a:b])), _GROUP.fullmatch(text, a, b) is not None
        if out and group and out[-1][3] and text[out[-1][1] : a] in (" ", ") ") and out[-1][2] + digits <= RUN_DIGITS:
            out[-1] = (out[-1][0], b, out[-1][2] + digits, True)
        else:
            out.append((a, b, digits, group))
    return [(a, b) for a, b, digits, _ in out if digits >= LEAST_DIGITS or ("@" in text[a:b] and b - a > 1)]


def places(text: str) -> list[tuple[int, int, int]]:
    """(kind number or -1, start, end) of all seeds and candidates."""
    found = seeds(text)
    return found + [(-1, a, b) for a, b in candidates(text, sorted((a, b) for _, a, b in found))]


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _scan(batches):
    import pandas as pd

    for pdf in batches:
        rows = []
        for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
            text = text if isinstance(text, str) else ""
            found = places(text)
            base = [x for x in found if 0 <= x[0] < len(BASE)]
            seen = [{"kind": k, "start": a, "end": b, "inst": _hash(text[a:b].lower()), "pat": [_hash(p) for p in patterns(text, a, b)]} for k, a, b in found]
            said = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in base)
            counts = [sum(k == i for k, _, _ in base) for i in range(len(BASE))]
            rows.append((doc_id, *counts, hashlib.sha256(said.encode()).hexdigest(), seen))
        yield pd.DataFrame(rows, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "seen"]).astype({"doc_id": "Int64"})


_SEEN = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
    "seen array<struct<kind:int,start:int,end:int,inst:long,pat:array<long>>>"
)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans of each row.

    Counts and digest are of the base spans; ``spans`` holds these, secrets, and what the learnt patterns found, by kind,
    then start, and ``n_spans`` is their number, so that a document with a secret or a learnt span alone is told from a
    clean one. A null or empty text has none. Repeated rows have equal results, and count once as instances. A place
    that patterns of several kinds mark gets the kind of the pattern that entered first, then of the surest, then the
    first kind. An empty table gives an empty result. Other columns of ``docs`` are not looked at.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # A number of its own for each row; the table is written once, so that numbers stay.
    scanned = store(plain.mapInPandas(_scan, _SEEN).withColumn("rk", F.monotonically_increasing_id()), "pii-scanned")
    marks = scanned.select("rk", F.explode("seen").alias("s")).select("rk", "s.kind", "s.start", "s.end", "s.inst", F.explode("s.pat").alias("pat"))
    edges = store(marks.select("pat", "inst").distinct(), "pii-edges")
    # Patterns with fewer instances can never have the support.
    sizes = store(edges.groupBy("pat").agg(F.count("*").alias("all_n")).where(F.col("all_n") >= support), "pii-sizes")
    live = store(edges.join(sizes.hint("merge"), "pat"), "pii-live")
    belief = scanned.select(F.explode("seen").alias("s")).where(F.col("s.kind") >= 0).select("s.inst", F.col("s.kind").alias("want"))
    belief = store(belief.distinct(), "pii-belief")
    good, turn = None, 0
    while True:
        scored = live.join(belief.hint("merge"), "inst").groupBy("pat", "want").agg(F.count("*").alias("hits"), F.max("all_n").alias("all_n"))
        fresh = scored.where((F.col("hits") >= support) & (F.col("hits") / F.col("all_n") >= confident))
        fresh = fresh.select("pat", "want", (F.col("hits") / F.col("all_n")).alias("conf"), F.lit(turn).alias("turn"))
        if good is not None:
            fresh = fresh.join(good.select("pat", "want").hint("merge"), ["pat", "want"], "left_anti")
        fresh = store(fresh, "pii-fresh")
        if good is not None and fresh.isEmpty():
            break
        good = store(fresh if good is None else good.unionByName(fresh), "pii-good")
        learnt = live.join(fresh.hint("merge"), "pat").select("inst", "want")
        belief = store(belief.unionByName(learnt).distinct(), "pii-belief")
        turn += 1
    best = F.max(F.struct(-F.col("turn"), "conf", -F.col("want"))).alias("best")
    more = marks.where(F.col("kind") < 0).join(good.hint("merge"), "pat").groupBy("rk", "start", "end").agg(best)
    more = more.select("rk", (-F.col("best.col3")).alias("kind"), "start", "end").groupBy("rk")
    more = store(more.agg(F.collect_set(F.struct("kind", "start", "end")).alias("more")), "pii-more")
    kept = F.filter("seen", lambda s: s["kind"] >= 0)
    own = F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    name = F.array(*[F.lit(k) for k in KINDS])
    spans = F.sort_array(F.concat(own, F.coalesce("more", F.array().cast("array<struct<kind:int,start:int,end:int>>"))))
    told = lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    out = scanned.join(more.hint("merge"), "rk", "left")
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.array_join(F.transform(spans, told), ",").alias("spans"), F.size(spans).cast("long").alias("n_spans"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text of ``documents``."""
    return find_pii(table(spark, sf_dir, "documents"))
