import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cairn.errors import InvalidSpecifier, NodeNotFound, NotUnique
from cairn.functions import columns as C
from cairn.operators import catalog, sharing, store, tree, versions

NODE = "path string, kind string, cid string, size long, symlink_target string, mime_type string"


@pytest.fixture
def nodes(spark):
    rows = [("a/b/1.txt", "file", "c1", 3, None, "text/plain"), ("a/b/2.txt", "file", "c2", 5, None, "text/plain"), ("a/bb.txt", "file", "c1", 3, None, "text/plain"), ("e", "dir", None, 0, None, None)]
    return spark.createDataFrame(rows, NODE)


def paths(df):
    return sorted(r.path for r in df.collect())


def test_tree_listing(nodes):
    assert {(r.name, r.kind, r.n_files, r.bytes) for r in tree.ls(nodes).collect()} == {("a", "dir", 3, 11), ("e", "dir", 0, 0)}
    assert {(r.name, r.kind) for r in tree.ls(nodes, "a").collect()} == {("b", "dir"), ("bb.txt", "file")}
    assert paths(tree.tree(nodes, "a/b")) == ["a/b/1.txt", "a/b/2.txt"]


def test_tree_changes(spark, nodes):
    assert paths(tree.mv(nodes, "a/b", "z")) == ["a/bb.txt", "e", "z/1.txt", "z/2.txt"]
    assert paths(tree.cp(nodes, "a/b", "z")) == ["a/b/1.txt", "a/b/2.txt", "a/bb.txt", "e", "z/1.txt", "z/2.txt"]
    assert paths(tree.rm(nodes, "a/b")) == ["a/bb.txt", "e"]
    with pytest.raises(NodeNotFound):
        tree.mv(nodes, "a/x", "z", check=True)
    dirs = spark.createDataFrame([("p/q",), ("e",)], "path string")
    assert paths(tree.mkdir(nodes, dirs)) == ["a/b/1.txt", "a/b/2.txt", "a/bb.txt", "e", "p", "p/q"]
    new = spark.createDataFrame([("a/b/1.txt", "c9", 9)], "path string, cid string, size long")
    out = tree.write(nodes, new)
    assert tree.get(out, "a/b/1.txt").head()["cid"] == "c9" and "a/b" in paths(out)


def test_history_of_long_and_short_chains(spark):
    rows = [(i, i - 1 if i % 100 else None) for i in range(300)]
    out = {r.id: (r.original, r.depth) for r in versions.history(spark.createDataFrame(rows, "id long, previous long")).collect()}
    assert out[299] == (200, 99) and out[0] == (0, 0) and out[101] == (100, 1) and len(out) == 300


def test_stores(spark):
    rows = spark.createDataFrame([("x", 1, 10), ("x", 12, 20), ("y", 2, 30)], "cid string, delta int, offset long")
    assert {(r.cid, r.delta, r.offset) for r in store.newest(rows, "offset").collect()} == {("x", 12, 20), ("y", 2, 30)}
    want = spark.createDataFrame([("x",), ("z",)], "cid string")
    assert {(r.cid, r.source) for r in store.split_read(want, rows.limit(0), rows).collect()} == {("x", "secondary"), ("z", "missing")}
    assert [r.cid for r in store.missing(want, rows).collect()] == ["z"]


def test_running_start_in_two_levels(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("p"), "id", (F.col("id") % 7).alias("s"))
    got = store.running_start(rows, "p", "id", F.col("s"), "at", span=64).collect()
    total = {}
    for r in sorted(got, key=lambda r: r.id):
        assert r["at"] == total.get(r.p, 0)
        total[r.p] = total.get(r.p, 0) + r.s


def test_catalog(spark):
    drives = spark.createDataFrame([("1", "one", None), ("2", "two", "/o")], "id string, name string, origin string")
    assert catalog.find(drives, catalog.specifier(origin="/o"), "id").head()["id"] == "2"
    assert catalog.find(drives, catalog.specifier(name="none"), "id").count() == 0
    for bad in ({}, {"id": "1", "name": "x"}):
        with pytest.raises(InvalidSpecifier):
            catalog.specifier(**bad)
    with pytest.raises(NotUnique):
        catalog.create(drives, drives.limit(1), "id")
    assert catalog.update(drives, drives.limit(1).withColumn("name", F.lit("new")), "id").count() == 2
    assert catalog.delete(drives, drives.limit(1), "id").count() == 1


def test_enums_and_texts(spark):
    row = spark.range(1).select(C.human_bytes(F.lit(1536)).alias("h"), C.parse_enum(F.lit("HOT"), ["hot"], "class").alias("e"), C.mime_type(F.lit("a/B.HTML")).alias("m"), C.form_encode({"a b": F.lit("x&y")}).alias("f")).head()
    assert row == ("1.50 KiB", "hot", "text/html", "a+b=x%26y")
    with pytest.raises(PySparkException):
        spark.range(1).select(C.parse_enum(F.concat(F.lit("ice"), F.col("id").cast("string")), ["hot"], "class")).collect()


def test_share_map(spark):
    empty = spark.createDataFrame([], "drive string, ref_kind string, fingerprint string, der string, enc_ref string")
    keys = spark.createDataFrame([("d", "f1", "k1"), ("d", "f2", "k2")], "drive string, fingerprint string, der string")
    refs = spark.createDataFrame([], "drive string, ref_kind string, enc_ref string")
    shares = sharing.add_recipient(empty, keys, refs)
    assert shares.count() == 4 and shares.filter("enc_ref = ''").count() == 4
    shares = sharing.update_ref(shares, spark.createDataFrame([("d", "r1")], "drive string, enc_ref string"))
    shares = sharing.update_ref(shares, spark.createDataFrame([("d", "r2")], "drive string, enc_ref string"))
    assert {(r.ref_kind, r.enc_ref) for r in sharing.unlock(shares, "f1").collect()} == {("original", "r1"), ("current", "r2")}
    assert sharing.add_recipient(shares, keys, refs).count() == 4


def test_lz4_and_tokens(spark):
    row = spark.createDataFrame([(bytearray(b"abc" * 99),)], "b binary").select("b", C.lz4_compress("b").alias("z")).select("*", C.lz4_decompress("z").alias("u")).head()
    assert bytes(row["z"][:4]).hex() == "04224d18" and row["u"] == row["b"]
    t = spark.range(1).select(sharing.token(F.lit("p"), F.lit("f"), F.lit("ñ?>~" * 30), F.lit(None).cast("string"), F.lit(3)).alias("t"))
    assert "\n" not in t.head()["t"] and t.select(sharing.read_token(F.col("t")).alias("r")).head()["r"]["file_name"] == "ñ?>~" * 30


def test_previous_by_spans_is_lag(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("drive"), F.timestamp_seconds(F.pmod(F.hash("id"), F.lit(900_000))).alias("ts"), "id")
    plain = versions.previous(rows, ["ts", "id"], "id")
    spread = versions.previous(rows, ["ts", "id"], "id", F.date_trunc("day", "ts"))
    key = lambda df: sorted((r.id, r.previous if r.previous is not None else -1) for r in df.collect())
    assert key(plain) == key(spread)


def test_push_and_snapshot_restore(spark):
    ddl = "id string, drive string, state string"
    old = spark.createDataFrame([("1", "a", "outdated"), ("2", "a", "current"), ("3", "b", "current")], ddl)
    out = versions.push(old, spark.createDataFrame([("4", "a", "pending")], ddl))
    assert {(r.id, r.state) for r in out.collect()} == {("1", "outdated"), ("2", "outdated"), ("3", "current"), ("4", "current")}
    snaps = spark.createDataFrame([("s", "a", "1")], "id string, drive string, metadata_id string")
    back = versions.restore_snapshot(out, snaps, "s")
    assert {(r.id, r.state) for r in back.collect()} == {("1", "current"), ("2", "outdated"), ("3", "current"), ("4", "outdated")}
