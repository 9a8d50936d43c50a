"""Behaviour of single operators on small tables with expected rows."""

import pytest
from pyspark.sql import functions as F

from quayside.functions import keys
from quayside.operators import blocks, catalog, listing, multipart, placement, reconcile, replication
from quayside.sources import schemas, tables


def objects(spark, rows):
    """(bucket, key, size, deleted_at) rows as objects."""
    full = [(b, k, s, "text/plain", f"e{k}", None, None, "n", 1, 10 + i, d) for i, (b, k, s, d) in enumerate(rows)]
    return spark.createDataFrame(full, schemas.OBJECTS)


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_pages_concatenate_to_the_whole_listing(spark):
    o = objects(spark, [("b", k, 1, None) for k in ["a/1", "a/2", "b", "c/x/1", "c/y", "d%", "d_", "D", "é", "z/1", "z/2"]] + [("b", "gone", 1, 5), ("other", "a/1", 1, None)])
    whole = got(listing.entries(listing.under(listing.active(o), "b")), "entry", "kind")
    for limit in (1, 2, 3, 100):
        seen, cursor = [], None
        while True:
            page = listing.list_objects(o, "b", delimiter="/", limit=limit, start_after=cursor).orderBy("entry").collect()
            seen += [(r["entry"], r["kind"]) for r in page]
            if not page or not page[0]["truncated"]:
                break
            cursor = page[0]["next_cursor"]
        assert sorted(seen) == whole and len(seen) == len(set(seen))


def test_prefix_has_no_wildcards(spark):
    o = objects(spark, [("b", k, 1, None) for k in ["a%1", "a_1", "ab1", "A%1"]])
    assert got(listing.list_objects(o, "b", prefix="a%"), "key") == [("a%1",)]


def test_missing_head_is_an_error(spark):
    o = objects(spark, [("b", "k", 1, 5)])
    with pytest.raises(KeyError):
        listing.require(o, "b", "k")


def test_same_key_in_two_buckets_is_not_skipped(spark):
    o = objects(spark, [("a", "k", 1, None), ("b", "k", 2, None), ("a", "l", 3, None)])
    first = listing.migration_page(o, 1).collect()[0]
    assert got(listing.migration_page(o, 5, (first["key"], first["bucket"])), "bucket", "key") == [("a", "l"), ("b", "k")]


def test_upsert_keeps_class_and_creation(spark):
    w = spark.createDataFrame([("b", "k", 1, "cold", None, 100, 1), ("b", "k", 2, None, "n1", 200, 2), ("b", "k", 3, None, None, 300, 3)], "bucket string, key string, size long, storage_class string, origin_node string, written_at long, version long")
    r = catalog.upsert(w).collect()[0]
    assert (r["size"], r["storage_class"], r["origin_node"], r["created_at"], r["updated_at"]) == (3, "cold", "n1", 100, 300)


def test_deletes(spark):
    o = objects(spark, [("b", "x", 1, None), ("b", "y", 1, 5), ("b", "z", 1, None)])
    named = spark.createDataFrame([("b", "x"), ("b", "y"), ("b", "nope")], "bucket string, key string")
    assert got(catalog.soft_delete(o, named, 99), "key", F.coalesce("deleted_at", F.lit(-1))) == [("x", 99), ("y", 5), ("z", -1)]
    assert got(catalog.hard_delete(o, named), "key") == [("z",)]
    assert got(catalog.delete_status(o, named), "key", "status") == [("nope", "ignored"), ("x", "deleted"), ("y", "ignored")]


def test_quota(spark):
    o = objects(spark, [("b", "x", 60, None)])
    req = spark.createDataFrame([("b", "x", 100), ("b", "y", 50)], "bucket string, key string, incoming long")
    assert got(catalog.quota(o, req, 100), "key", "accepted") == [("x", True), ("y", False)]
    assert got(catalog.quota(o, req, 0), "key", "accepted") == [("x", True), ("y", True)]


@pytest.mark.parametrize("header,size,want", [("bytes=0-4", 10, (True, 0, 5)), ("bytes=5-", 10, (True, 5, 5)), ("bytes=-3", 10, (True, 7, 3)), ("bytes=-30", 10, (True, 0, 10)), ("bytes=4-100", 10, (True, 4, 6)), ("bytes=10-", 10, (False, 0, 10)), ("bytes=9-4", 10, (False, 0, 10)), ("bytes=-0", 10, (False, 0, 10)), ("x", 10, (False, 0, 10)), ("bytes=0-0", 0, (False, 0, 0))])
def test_ranges(spark, header, size, want):
    r = spark.createDataFrame([(header, size)], "h string, s long").select(keys.parse_range(F.col("h"), F.col("s")).alias("r")).collect()[0]["r"]
    assert tuple(r) == want


@pytest.mark.parametrize("key,want", [("a/b", "a/b"), ("a\\b", "a/b"), ("", None), ("/a", None), ("c:/x", None), ("a/../b", None), ("a..b", "a..b"), ("a\nb", None), ("1:x", None), ("é:x", "é:x"), ("a\rb", "a\rb"), ("a/..", None)])
def test_clean_keys(spark, key, want):
    assert spark.createDataFrame([(key,)], "k string").select(keys.clean_key(F.col("k"))).collect()[0][0] == want


def test_key_codes_round_trip(spark):
    ks = ["a/b", "100%", "%2F", "a%252Fb/", "é/%"]
    df = spark.createDataFrame([(k,) for k in ks], "k string")
    assert [r[0] for r in df.select(keys.decode_key(keys.encode_key(F.col("k")))).collect()] == ks
    assert [r[0] for r in df.select(keys.percent_decode()(keys.encode_key(F.col("k")))).collect()] == ks


def test_chunks_assemble_and_ranges_cut(spark):
    body = bytes(range(256)) * 20 + b"tail"
    c = spark.createDataFrame([("b", "k", bytearray(body)), ("b", "same", bytearray(body)), ("b", "none", bytearray())], "bucket string, key string, body binary")
    b = blocks.chunk(c, F.col("body"), 1000)
    parts = b.select(F.col("key").alias("upload_id"), F.col("block_idx").alias("part_number"), "body")
    assert {r["upload_id"]: bytes(r["body"]) for r in multipart.assemble(parts).collect()} == {"k": body, "same": body}
    index = blocks.offsets(b.drop("body"))
    for lo, hi in ((0, 1), (999, 1001), (1500, 4200), (5000, 9000)):
        assert {bytes(r["body"]) for r in blocks.read_range(index, b, lo, hi).collect()} == {body[lo:hi]}
    assert all(r["refcount"] == 2 for r in blocks.refcounts(b).collect())
    assert blocks.verify(b).where(~F.col("intact")).count() == 0
    assert got(blocks.index_valid(index), "key", "valid") == [("k", True), ("same", True)]


def test_reconcile(spark):
    o = objects(spark, [("b", "both", 1, None), ("b", "stale", 1, None), ("b", "dead", 1, 5)])
    f = spark.createDataFrame([("b", "both", 1), ("b", "dead", 2), ("b", "lost", 4)], "bucket string, key string, bytes long")
    assert got(reconcile.orphans(o, f), "key") == [("dead",), ("lost",)]
    assert got(reconcile.orphans(o, f, include_tombstones=True), "key") == [("lost",)]
    assert got(reconcile.stale_rows(o, f), "key") == [("stale",)]


def test_rule_forms_agree(spark):
    o = objects(spark, [("b", k, s, None) for k, s in [("de/1", 5000), ("de/2", 1), ("x0", 1), ("y", 9999)]])
    r = tables.rules(spark)
    assert got(placement.first_rule(o, r), "bucket", "key", "rule_idx", "rule_class") == got(placement.first_rule_join(o, r), "bucket", "key", "rule_idx", "rule_class")


def test_too_many_peers_are_refused(spark):
    classes = F.array().cast("array<string>").alias("storage_classes")
    peers = spark.range(placement.RULE_LIMIT + 1).select(F.concat(F.lit("n"), "id").alias("node_id"), classes)
    with pytest.raises(ValueError):
        placement.class_nodes(tables.rules(spark), peers, "me")
    assert placement.class_nodes(tables.rules(spark), peers.limit(3), "me").count() > 0


def test_retries_end_in_dead_letters_and_replay(spark):
    e = spark.createDataFrame([("1", "pending", 0, None), ("2", "failed", 18, 5)], "event_id string, status string, attempts int, next_retry_at long")
    once = replication.after_failure(e, 100)
    assert got(once, "event_id", "status", "attempts") == [("1", "failed", 1), ("2", "failed", 19)]
    twice = replication.after_failure(once, 100)
    assert got(twice, "event_id", "status") == [("1", "failed"), ("2", "dead_letter")]
    assert got(replication.replay(twice), "event_id", "status", "attempts") == [("1", "failed", 2), ("2", "pending", 0)]


def test_stale_and_owned_uploads(spark):
    u = spark.createDataFrame([("u", "b", "k", 100, 200)], "upload_id string, bucket string, key string, created_at long, expires_at long")
    assert multipart.stale(u, 1000, 500).count() == 1 and multipart.stale(u, 150).count() == 0
    req = spark.createDataFrame([("u", "b", "k"), ("u", "b", "z"), ("v", "b", "k")], "upload_id string, bucket string, key string")
    assert sorted(r["verdict"] for r in multipart.owned(u, req).collect()) == ["missing", "ok", "wrong_target"]


def test_blob_files(spark, tmp_path):
    (tmp_path / "store/b1/sub").mkdir(parents=True)
    (tmp_path / "store/b1/sub/a.txt").write_text("hello")
    (tmp_path / "store/.tmp").mkdir()
    (tmp_path / "store/.tmp/x").write_text("no")
    assert got(tables.blob_files(spark, str(tmp_path / "store")), "bucket", "key", "bytes") == [("b1", "sub/a.txt", 5)]


def test_peer_grammar():
    text = "n1=http://a;hot;group=g1,n2=http://b,n3=http://c;group=us"
    assert placement.parse_peers(text) == [("n1", "http://a", ["hot"], "g1"), ("n2", "http://b", [], None), ("n3", "http://c", [], "us")]
    assert placement.format_peers(placement.parse_peers(text)) == text
    assert placement.parse_peers(" n1=http://a ; hot ; cold ; other=x ; group= ,") == [("n1", "http://a", ["hot", "cold"], None)]
    for bad in ("n1", "=http://a", "n1=", "n1= ; ", "n1=http://a,n1=http://b", "", " , "):
        with pytest.raises(ValueError):
            placement.parse_peers(bad)


def test_peers_by_group(spark):
    peers = spark.createDataFrame([("any", [], None), ("one", [], "g1"), ("two", ["hot"], "g2")], "node_id string, storage_classes array<string>, replication_group string")
    events = spark.createDataFrame([("1", "hot", "g1"), ("2", "hot", None), ("3", "cold", "g2")], "event_id string, storage_class string, replication_group string")
    assert got(placement.peers_for(events, peers), "event_id", "node_id") == [("1", "any"), ("1", "one"), ("2", "any"), ("3", "any")]


def test_gate(spark):
    rows = spark.createDataFrame([("hot", "n2"), ("cold", "n2"), ("cold", None)], "c string, node string")
    gate = lambda forward: [r[0] for r in rows.select(placement.gate(F.col("c"), ["hot"], F.col("node"), forward)).collect()]
    assert gate(True) == ["local", "forward", "reject"] and gate(False) == ["local", "reject", "reject"]


def test_xxh3(spark):
    import xxhash

    df = spark.createDataFrame([("b", "k1"), ("b", "é/2"), (None, None)], "bucket string, key string")
    want = [f"{xxhash.xxh3_64_intdigest(k.encode()) & 255:02x}" for k in ("k1", "é/2")]
    assert [r[0] for r in df.select(keys.shard_xxh3()("key")).collect()] == [*want, None]
    assert [r[0] for r in df.select(keys.sampled_xxh3(2)("bucket", "key")).collect()] == [xxhash.xxh3_64_intdigest(f"b/{k}".encode()) % 2 == 0 for k in ("k1", "é/2")] + [None]


def test_listing_document(spark):
    rows = spark.createDataFrame([("prefix", "a&/", None, None, None, True, "b"), ("item", "b", 3, "e1", 1704067200, True, "b")], "kind string, entry string, size long, etag string, updated_at long, truncated boolean, next_cursor string")
    xml = listing.page_xml(rows, "bk", None, "/").first()[0]
    assert "<Delimiter>/</Delimiter>" in xml and "    <Prefix>a&amp;/</Prefix>" in xml and "  <KeyCount>1</KeyCount>" in xml and "<LastModified>2024-01-01T00:00:00.000Z</LastModified>" in xml
    assert xml.index("CommonPrefixes") < xml.index("Contents") and "<NextContinuationToken>b</NextContinuationToken>" in xml


def test_moves_and_ties(spark):
    o = objects(spark, [("b", "k", 1, None)])
    moves = spark.createDataFrame([("b", "k", "x", "n1"), ("b", "k", "y", "n2")], "bucket string, key string, new_class string, new_node string")
    assert got(catalog.place(o, moves), "key", "storage_class", "origin_node") == [("k", "y", "n2")]


def test_scrub_turns_around(spark):
    o = objects(spark, [("b", k, 1, None) for k in "abc"])
    assert got(reconcile.scrub_page(o, 2, ("a", "b")), "key") == [("b",), ("c",)]
    assert got(reconcile.scrub_page(o, 2, ("c", "b")), "key") == [("a",), ("b",)]
    assert got(reconcile.scrub_page(o, 2), "key") == [("a",), ("b",)]


def test_enqueue_is_idempotent(spark):
    o = objects(spark, [("b", "k", 1, None)])
    a, b = (replication.enqueue(o, "put", "n", t) for t in (1, 2))
    assert replication.unseen(b, a).count() == 0


def test_read_repair_and_delete_merge(spark):
    w = spark.createDataFrame([("b", "x"), ("b", "y"), ("b", "z")], "bucket string, key string")
    remote = spark.createDataFrame([("b", "y", "n2"), ("b", "y", "n1"), ("b", "x", "n1")], "bucket string, key string, node_id string")
    assert got(replication.read_repair(w, w.where("key = 'x'"), remote), "key", "source") == [("x", "local"), ("y", "n1"), ("z", "missing")]
    r = spark.createDataFrame([("n1", 2, ["k"], False, None), ("n2", 3, [], True, "c")], "node_id string, deleted long, failed_keys array<string>, truncated boolean, cursor string")
    assert tuple(replication.merge_deletes(r).first()) == (5, 1, True, "c")


def test_deleting_by_prefix_needs_one(spark):
    with pytest.raises(ValueError):
        listing.delete_page(objects(spark, [("b", "k", 1, None)]), "b", "")


def test_writes_are_refused_in_order(spark):
    o = objects(spark, [("b", "k", 8, None), ("b", "gone", 99, 5)])
    w = spark.createDataFrame([("b", "k", bytearray(b"123456789")), ("b", "n", bytearray(b"123")), ("b", "/n", bytearray(b"1")), ("", "n", None), ("b", "big", bytearray(20))], "bucket string, key string, body binary")
    v = catalog.write_verdict(o, w, 10, max_size=19).withColumn("code", keys.status_code(F.col("error")))
    assert got(v, "bucket", "key", "error", "code") == [("", "n", "invalid_bucket", 400), ("b", "/n", "invalid_key", 400), ("b", "big", "payload_too_large", 413), ("b", "k", None, 200), ("b", "n", "insufficient_storage", 507)]
    assert {r["error"] for r in catalog.write_verdict(o, w, 0, read_only=True).collect()} == {"read_only_replica"}
    assert got(catalog.write_objects(o, w.where("key = 'k'"), 10, 7), "key", "size", "updated_at") == [("k", 9, 7)]


def test_an_object_written_again_keeps_a_later_creation_time(spark):
    o = objects(spark, [("b", "early", 1, None), ("b", "late", 1, None), ("b", "rest", 1, None)]).withColumn("created_at", F.when(F.col("key") == "early", 3).otherwise(9).cast("long"))
    w = spark.createDataFrame([("b", k, bytearray(b"12")) for k in ("early", "late", "new")], "bucket string, key string, body binary")
    assert got(catalog.write_objects(o, w, 0, 7), "key", "size", "created_at", "updated_at") == [("early", 2, 3, 7), ("late", 2, 9, 7), ("new", 2, 7, 7), ("rest", 1, 9, 12)]


def test_paths_of_both_layouts(spark):
    df = spark.createDataFrame([("ab/x%2Fy",), ("ab/x/y%2F",), ("ab/",), ("ab",), ("ab/%252F",)], "p string")
    assert [r[0] for r in df.select(keys.key_of_path(F.col("p"))).collect()] == ["x/y", "x/y%2F", None, None, "%2F"]
    assert spark.range(1).select(keys.nested_path(F.lit("b"), F.lit("plain"))).first()[0] is None


def test_the_encoded_place_counts_first(spark):
    page = spark.createDataFrame([("b", "x/y"), ("b", "z")], "bucket string, key string")
    flat = page.where("key = 'x/y'").select(keys.blob_path(F.col("bucket"), F.col("key"))).first()[0]
    nested = page.where("key = 'x/y'").select(keys.nested_path(F.col("bucket"), F.col("key"))).first()[0]
    files = lambda *rows: spark.createDataFrame(list(rows), "path string, readable boolean, format string, upgrade boolean")
    both = reconcile.migration_plan(page, files((nested, True, "raw", True), (flat, True, "indexed", False)))
    assert got(both, "key", "action", "path") == [("x/y", "skipped", flat), ("z", "skipped", None)]
    assert got(reconcile.migration_plan(page, files((nested, True, "indexed", False))), "key", "action", "path") == [("x/y", "relocate", flat), ("z", "skipped", None)]
    assert got(reconcile.migration_plan(page, files((nested, False, "indexed", False))), "key", "action", "path") == [("x/y", "failed", nested), ("z", "skipped", None)]


def test_finalize_releases_and_adds(spark):
    refs = spark.createDataFrame([("b", "k", 0, "h1", 4), ("b", "k", 1, "h2", 4), ("b", "o", 0, "h1", 4)], "bucket string, key string, block_idx int, block_hash string, size int")
    new = spark.createDataFrame([("b", "k", 0, "h3", 4)], refs.schema)
    assert got(blocks.finalize(refs, new), "block_hash", "refcount") == [("h1", 1), ("h3", 1)]


def test_peers_behind_the_quota_are_not_asked(spark):
    a = spark.createDataFrame([(1, "p1", False), (1, "p2", True), (1, "p3", True), (2, "p1", False)], "event_id long, node_id string, ok boolean")
    asked = replication.delivered(a, 2)
    assert got(asked, "event_id", "node_id") == [(1, "p1"), (1, "p2"), (2, "p1")]
    assert got(replication.drained(spark.range(1, 4).withColumnRenamed("id", "event_id"), asked, 2), "event_id", "outcome") == [(1, "sent"), (2, "failed"), (3, "failed")]


def test_dictionary_compression_equals_the_library(spark):
    import zstandard

    bodies = [f'{{"user": {i}, "name": "name {i}", "state": "active", "kind": "customer of the store"}}'.encode() for i in range(300)]
    df = spark.createDataFrame([(bytearray(b),) for b in bodies], "body binary").withColumn("block_hash", F.md5("body"))
    known = blocks.train_dictionary(df, 4096)
    z = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(known))
    want = sorted((len(b), len(z.compress(b)), min(len(b), len(z.compress(b)))) for b in bodies)
    assert got(blocks.compress_sizes(df, 3, known), "raw", "packed", "stored") == want
    assert sum(w[1] for w in want) < sum(r["packed"] for r in blocks.compress_sizes(df, 3).collect())
    assert blocks.train_dictionary(df.limit(1), 4096) is None
