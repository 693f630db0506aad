import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cairn.errors import CairnError, NodeNotFound, Unauthorized
from cairn.functions.columns import cid_hex, cid_sha1, node_json, random_id
from cairn.operators import sharing, store, versions
from cairn.plans.mount import Mount
from cairn.sources import car, config, register


def test_mount(spark, tmp_path):
    m = Mount(spark, str(tmp_path / "drive"), str(tmp_path / "remote"))
    m.mkdir("dir/sub")
    m.write("cat.txt", b"hello kitty")
    m.write("dir/dog.txt", b"dog content")
    m.write("cat.txt", b"hello puppy")
    assert m.read_bytes("cat.txt") == b"hello puppy"
    assert {(r.name, r.kind) for r in m.ls().collect()} == {("cat.txt", "file"), ("dir", "dir")}
    m.snapshot("before")
    m.mv("dir", "moved")
    m.cp("moved/dog.txt", "copy.txt")
    m.symlink("cat.txt", "link")
    m.rm("cat.txt")
    assert m.read_bytes("copy.txt") == b"dog content"
    with pytest.raises(NodeNotFound):
        m.read_bytes("cat.txt")
    with pytest.raises(CairnError):
        m.share_file("moved")
    assert m.receive(m.share_file("copy.txt")) == ("copy.txt", b"dog content")
    assert m.has_snapshot("before") and m.snapshot_cids("before").count() == 2 and m.snapshots().head()["size"] == 22
    m.share_with("f1", "key")
    m.share_with("f1", "key")
    assert m.shares().count() == 2 and sharing.open_share(m.shares(), "f1").count() == 2
    with pytest.raises(Unauthorized):
        sharing.open_share(m.shares(), "f2")
    assert m.state() == "unpublished" and m.push() == "all_synced"
    m.write("new.txt", b"n")
    assert m.state() == "ahead"
    other = Mount(spark, str(tmp_path / "other"), str(tmp_path / "remote"))
    assert other.state() == "unlocalized"
    m.push()
    assert other.pull() == "metadata_synced" and other.read_bytes("new.txt") == b"n"
    other.restore(str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["copy.txt", "link", "moved", "new.txt"]
    m.restore_snapshot("before")
    assert m.read_bytes("cat.txt") == b"hello puppy" and m.describe()["nodes"] == 4
    with pytest.raises(CairnError):
        other.write("fork.txt", b"f")
        m.push()
        other.push()
    assert m.history().agg(F.max("depth")).head()[0] == m.describe()["revision"] - 1


def test_config(spark, tmp_path):
    path = str(tmp_path / "a" / "config.json")
    c = config.load(path)
    c = config.put_drive(c, {"local_id": "1", "name": "one", "origin": "/x"})
    c = config.put_drive(c, {"local_id": "2", "name": "two", "origin": "/x"})
    config.save(path, c)
    assert config.load(path) == c and [r.name for r in config.drives(spark, c).collect()] == ["two"]
    assert config.drop_drive(c, "/x")["drives"] == [] and config.drop_drive(c, "/y") == c and config.drop_drive(c)["drives"] == []


def test_archives_in_memory(spark):
    rows = spark.range(20).select((F.col("id") % 3).alias("g"), F.encode(F.concat(F.lit("x"), (F.col("id") % 7).cast("string")), "UTF-8").alias("content"))
    back = car.unpack(car.pack(rows, "g"), "g")
    assert {(r.g, bytes(r.content)) for r in back.collect()} == {(r.g, bytes(r.content)) for r in rows.collect()}


def test_filter_reaches_the_archive(spark, tmp_path):
    register(spark)
    path = str(tmp_path / "c")
    spark.range(9).select(F.encode(F.col("id").cast("string"), "UTF-8").alias("content")).write.format("car").mode("append").save(path)
    df = spark.read.format("car").load(path)
    one = df.filter(F.col("cid") == df.head()["cid"])
    assert one.count() == 1 and "Filter" not in one._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]


def test_small_helpers(spark):
    row = spark.range(1).select(cid_sha1(F.lit("x")).alias("s"), random_id().alias("r"), node_json(F.lit(1), F.lit(2), F.lit("a/b"), F.lit(3)).alias("j")).head()
    assert row["s"].startswith("01551114") and len(row["r"]) == 7 and row["j"] == '{"created":1,"modified":2,"mime_type":"a/b","size":3}'
    a = spark.range(3).select(cid_hex(F.col("id").cast("string")).alias("cid"))
    one, two = store.put_both(a, a.limit(1), a.limit(0))
    assert one.count() == two.count() == 3
    shares = spark.createDataFrame([("d", "current", "f", "k", "r")], "drive string, ref_kind string, fingerprint string, der string, enc_ref string")
    assert sharing.from_map(sharing.to_map(shares)).collect() == shares.collect()
    drives = spark.createDataFrame([("r", None), (None, "l")], "remote_id string, local_remote_id string")
    assert {r.use_id for r in versions.resolve_id(drives).collect()} == {"r", "l"}
    with pytest.raises(PySparkException):
        versions.resolve_id(drives.select(F.lit(None).cast("string").alias("remote_id"), "local_remote_id")).collect()
    assert versions.listing(drives, ["remote_id", "local_remote_id"]).head()["text"] == "l\nr"
    v = spark.createDataFrame([("1", "d", None)], "id string, drive string, created_at timestamp")
    s = spark.createDataFrame([], "id string, drive string, metadata_id string, size long, created_at timestamp")
    out = versions.create_snapshot(s, v, "1", "snap", a.withColumn("len", F.lit(5)))
    assert out.head()["size"] == 15
