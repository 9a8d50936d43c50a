"""Where objects go: ordered rules, nodes and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

RULE_LIMIT = 10_000  # rules are configuration; more are refused rather than broadcast


def _holds() -> Column:
    tests = [
        F.col("r.prefix").isNull() | F.col("o.key").startswith(F.col("r.prefix")),
        F.col("r.suffix").isNull() | F.col("o.key").endswith(F.col("r.suffix")),
        F.col("r.mime_prefix").isNull() | F.coalesce(F.col("o.mime_type").startswith(F.col("r.mime_prefix")), F.lit(False)),
        F.col("r.min_bytes").isNull() | (F.col("o.size") >= F.col("r.min_bytes")),
    ]
    return reduce(lambda a, b: a & b, tests)


def first_rule(objects: DataFrame, rules: DataFrame) -> DataFrame:
    """Objects with rule_idx and rule_class of the first rule that holds, null without one.

    The rules become one ordered CASE, so each object is looked at once and nothing is joined or shuffled.
    """
    rows = rules.orderBy("rule_idx").limit(RULE_LIMIT + 1).collect()
    if len(rows) > RULE_LIMIT:
        raise ValueError(f"over {RULE_LIMIT} rules")
    idx, kind = F.lit(None).cast("int"), F.lit(None).cast("string")
    for r in reversed(rows):
        tests = [F.lit(True)]
        if r["prefix"] is not None:
            tests.append(F.col("key").startswith(r["prefix"]))
        if r["suffix"] is not None:
            tests.append(F.col("key").endswith(r["suffix"]))
        if r["mime_prefix"] is not None:
            tests.append(F.coalesce(F.col("mime_type").startswith(r["mime_prefix"]), F.lit(False)))
        if r["min_bytes"] is not None:
            tests.append(F.col("size") >= r["min_bytes"])
        hit = reduce(lambda a, b: a & b, tests)
        idx, kind = F.when(hit, r["rule_idx"]).otherwise(idx), F.when(hit, r["storage_class"]).otherwise(kind)
    return objects.withColumn("rule_idx", idx.cast("int")).withColumn("rule_class", kind)


def first_rule_join(objects: DataFrame, rules: DataFrame) -> DataFrame:
    """The same by a join with a rules table of checked size: bucket, key, rule_idx, rule_class."""
    n = rules.limit(RULE_LIMIT + 1).count()
    if n > RULE_LIMIT:
        raise ValueError(f"over {RULE_LIMIT} rules")
    j = objects.alias("o").join(F.broadcast(rules.alias("r")), _holds(), "left")
    got = j.groupBy("o.bucket", "o.key").agg(F.min("r.rule_idx").alias("rule_idx"), F.min_by("r.storage_class", "r.rule_idx").alias("rule_class"))
    return got.select("bucket", "key", "rule_idx", "rule_class")


def resolve_class(header: Column, meta: Column, rule: Column, default: str = "default") -> Column:
    """Header, then custom metadata, then the first rule, then the default; empty strings are none."""
    return F.coalesce(F.nullif(header, F.lit("")), F.nullif(meta, F.lit("")), rule, F.lit(default))


def class_nodes(rules: DataFrame, peers: DataFrame, here: str) -> DataFrame:
    """storage_class, node of each class of ``rules``: what its first rule names, else the smallest peer id other than ``here``."""
    n = peers.limit(RULE_LIMIT + 1).count()
    if n > RULE_LIMIT:
        raise ValueError(f"over {RULE_LIMIT} peers")
    first = rules.groupBy("storage_class").agg(F.min_by("assigned_node", "rule_idx").alias("named"))
    other = peers.where(F.col("node_id") != here).agg(F.min("node_id").alias("other"))
    # The other side is one row.
    return first.crossJoin(F.broadcast(other)).select("storage_class", F.coalesce("named", "other").alias("node"))


def accepts(storage_class: Column, own_classes: list[str]) -> Column:
    """Whether a node with these classes keeps an object of the class itself."""
    return storage_class.isin(own_classes) if own_classes else F.lit(False)


def gate(storage_class: Column, own_classes: list[str], node: Column, forward: bool) -> Column:
    """local if this node keeps the class, else forward to ``node`` or, without forwarding or a node, reject."""
    away = F.when(node.isNotNull(), "forward").otherwise("reject") if forward else F.lit("reject")
    return F.when(accepts(storage_class, own_classes), "local").otherwise(away)


def resolution(objects: DataFrame, rules: DataFrame, peers: DataFrame, here: str, own_classes: list[str], header: Column, meta: Column, default: str = "default") -> DataFrame:
    """bucket, key, storage_class, accept_local, assigned_node: where each object would go; the node is null where it stays."""
    named = first_rule(objects, rules).select("bucket", "key", resolve_class(header, meta, F.col("rule_class"), default).alias("storage_class"))
    other = peers.where(F.col("node_id") != here).agg(F.min("node_id").alias("_other"))
    nodes = class_nodes(rules, peers, here)
    out = named.join(F.broadcast(nodes), "storage_class", "left").crossJoin(F.broadcast(other))
    stays = accepts(F.col("storage_class"), own_classes)
    return out.select("bucket", "key", "storage_class", stays.alias("accept_local"), F.when(~stays, F.coalesce("node", "_other")).alias("assigned_node"))


def peers_for(events: DataFrame, peers: DataFrame) -> DataFrame:
    """Each event with each peer that keeps its class (none named: all) and takes its group: a peer without a group takes
    every event, a peer with one only events of that group."""
    n = peers.limit(RULE_LIMIT + 1).count()
    if n > RULE_LIMIT:
        raise ValueError(f"over {RULE_LIMIT} peers")
    p = peers.select("node_id", "storage_classes", F.col("replication_group").alias("peer_group"))
    classes = (F.size("storage_classes") == 0) | F.array_contains(F.col("storage_classes"), F.col("storage_class"))
    groups = F.col("peer_group").isNull() | (F.col("peer_group") == F.coalesce("replication_group", F.lit("")))
    return events.join(F.broadcast(p), classes & groups)


def bucket_allowed(policy: DataFrame, requests: DataFrame) -> DataFrame:
    """subject, bucket, allowed of each request: an empty policy allows all, else (subject, bucket) must be in it."""
    if policy.isEmpty():
        return requests.select("subject", "bucket", F.lit(True).alias("allowed"))
    have = policy.select("subject", "bucket").distinct().withColumn("_ok", F.lit(True))
    return requests.join(have, ["subject", "bucket"], "left").select("subject", "bucket", F.coalesce("_ok", F.lit(False)).alias("allowed"))


# Roles that may do everything, and roles that may only read.
WRITING_ROLES = ["admin", "editor", "uploader"]
READING_ROLES = ["listener", "readonly", "read_only"]


def role_allowed(role: Column, method: Column) -> Column:
    """Whether a role, in any case, may use an HTTP method; unknown roles may use none."""
    r = F.lower(role)
    return F.coalesce(F.when(r.isin(WRITING_ROLES), True).when(r.isin(READING_ROLES), method.isin("GET", "HEAD")), F.lit(False))


def parse_peers(text: str) -> list[tuple[str, str, list[str], str | None]]:
    """(node_id, url, classes, group) of entries ``id=url[;class][;group=name]`` separated by commas.

    Configuration is read on the driver. Each further part is a class, but for ``group=``; other named parts are passed
    over. An entry without an id or a url, an id that comes twice and a text without entries are errors.
    """
    out: dict[str, tuple[str, str, list[str], str | None]] = {}
    for entry in filter(None, map(str.strip, text.split(","))):
        node, _, rest = entry.partition("=")
        url, *more = [p for p in map(str.strip, rest.split(";")) if p] or [""]
        if not node or not url:
            raise ValueError(f"peer {entry!r}: id=url is needed")
        if node in out:
            raise ValueError(f"peer {node!r} comes twice")
        named = dict(map(str.strip, p.split("=", 1)) for p in more if "=" in p)
        out[node] = (node, url, [p for p in more if "=" not in p], named.get("group") or None)
    if not out:
        raise ValueError("no peers")
    return list(out.values())


def format_peers(peers: list[tuple[str, str, list[str], str | None]]) -> str:
    """The text of peers; ``parse_peers`` reads it back where no peer has several classes."""
    if not peers or any(not n.strip() or not u.strip() for n, u, _, _ in peers):
        raise ValueError("peers need an id and a url, and one must be there")
    return ",".join(f"{n.strip()}={u.strip()}" + (f";{','.join(c)}" if c else "") + (f";group={g.strip()}" if (g or "").strip() else "") for n, u, c, g in peers)
