import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cairn.errors import CairnError, Conflict, MissingBlock, NodeNotFound
from cairn.functions import codec
from cairn.functions.columns import cid_binary
from cairn.operators import tree
from cairn.plans.pipelines import Catalog, add, copy_revisions, prepare, remove, restore, scan, sync
from cairn.sources import fstree, register


def put(root, path, data):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "wb") as f:
        f.write(data)


@pytest.fixture
def nasty(tmp_path):
    """Empty, hidden, doubled, odd names, links of all kinds, an empty directory."""
    root = str(tmp_path / "tree")
    for path, data in {
        "a.txt": b"alpha", "copy/a.txt": b"alpha", "deep/x/y/a.bin": b"alpha", "empty1": b"", "sub/empty2": b"", ".hidden": b"h",
        "_under": b"u", ".dir/in": b"i", "with space.md": b"s", "ünï/çode.json": "é".encode(), "big": os.urandom(300_000),
    }.items():
        put(root, path, data)
    os.makedirs(f"{root}/void")
    os.symlink("a.txt", f"{root}/link")
    os.symlink("deep", f"{root}/linkdir")
    os.symlink("nowhere", f"{root}/dangling")
    os.symlink(f"{root}/deep/x/y/a.bin", f"{root}/absolute")
    return root


def listing(root):
    out = {}
    for d, dirs, names in os.walk(root):
        for n in dirs + names:
            p = os.path.join(d, n)
            rel = os.path.relpath(p, root)
            if os.path.islink(p):
                out[rel] = ("link", os.path.realpath(p).replace(os.path.realpath(root), ""))
            elif os.path.isdir(p):
                out[rel] = ("dir", None)
            else:
                with open(p, "rb") as f:
                    out[rel] = ("file", f.read())
    return out


def test_tree_scan(spark, nasty):
    register(spark)
    rows = {r.path: r for r in spark.read.format("fstree").option("content", "true").load(nasty).collect()}
    assert set(rows) == set(listing(nasty))
    assert rows["void"].kind == "dir" and rows["linkdir"].kind == "symlink" and rows["linkdir"].symlink_target == "deep"
    assert rows["absolute"].symlink_target == "deep/x/y/a.bin" and bytes(rows["a.txt"].content) == b"alpha" and rows["big"].len == 300_000


def test_archives(spark, tmp_path):
    register(spark)
    path = str(tmp_path / "cars")
    rows = spark.range(300).select(F.encode(F.concat(F.lit("block "), (F.col("id") % 200).cast("string")), "UTF-8").alias("content"))
    rows.repartition(3).write.format("car").mode("append").option("max_bytes", "4000").save(path)
    names = sorted(os.listdir(path))
    assert len(names) > 3 and all(n.endswith(".car") for n in names)
    back = spark.read.format("car").load(path)
    assert back.select("cid").distinct().count() == 200 and back.filter(cid_binary(F.col("content")) != F.col("cid")).count() == 0
    light = spark.read.format("car").option("content", "false").load(path)
    assert light.count() == back.count() and light.filter("content IS NOT NULL").count() == 0
    one = back.filter(F.col("cid") == F.lit(codec.make_cid(b"block 7")))
    assert {bytes(r.content) for r in one.collect()} == {b"block 7"}
    rows.limit(1).write.format("car").mode("append").save(path)
    assert len(os.listdir(path)) == len(names) + 1
    rows.limit(1).coalesce(1).write.format("car").mode("overwrite").save(path)
    assert os.listdir(path) == ["1.car"]


def test_prepare_and_restore(spark, nasty, tmp_path):
    c = Catalog(spark, str(tmp_path / "catalog"))
    prepare(c, nasty)
    restore(c, str(tmp_path / "out"))
    assert listing(str(tmp_path / "out")) == listing(nasty)
    n = c.blocks(content=False).count()
    assert n == c.blocks(content=False).select("cid").distinct().count() == 8
    again = prepare(c, nasty)
    assert c.blocks(content=False).count() == n and again["deleted"].count() == again["changed"].count() == again["added"].count() == 0
    os.remove(f"{nasty}/with space.md")
    os.remove(f"{nasty}/copy/a.txt")
    put(nasty, "a.txt", b"beta")
    put(nasty, "deep/x/y/a.bin", b"beta")
    third = prepare(c, nasty)
    assert {r.path for r in third["deleted"].collect()} == {"with space.md", "copy/a.txt"}
    assert {r.path for r in third["changed"].collect()} == {"a.txt", "deep/x/y/a.bin"}
    assert third["deleted_cids"].count() == 2 and c.revision() == 3
    restore(c, str(tmp_path / "now"))
    restore(c, str(tmp_path / "then"), revision=1)
    assert listing(str(tmp_path / "now")) == listing(nasty) and listing(str(tmp_path / "then"))["a.txt"] == ("file", b"alpha")
    assert {(r.id, r.original, r.depth) for r in c.history().collect()} == {(1, 1, 0), (2, 1, 1), (3, 1, 2)}


def test_add_remove_sync(spark, tmp_path):
    c, other = Catalog(spark, str(tmp_path / "a")), Catalog(spark, str(tmp_path / "b"))
    assert sync(c, other) == "unpublished"
    files = spark.createDataFrame([("x/1.txt", bytearray(b"one")), ("x/2.txt", bytearray(b"two"))], "path string, content binary")
    add(c, files)
    assert sync(other, c) == "unlocalized" and sync(c, c) == "all_synced"
    add(other, files)
    add(c, files.limit(1))
    assert sync(c, other) == "ahead" and sync(other, c) == "behind"
    assert {r.path for r in c.nodes().collect()} == {"x", "x/1.txt", "x/2.txt"}
    remove(c, "x/1.txt")
    assert {r.path for r in c.nodes().collect()} == {"x", "x/2.txt"}
    with pytest.raises(NodeNotFound):
        remove(c, "x/1.txt")


def test_lost_contents_are_an_error_before_anything_is_written(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "a"))
    add(c, spark.createDataFrame([("a.txt", bytearray(b"alpha")), ("b.txt", bytearray(b"beta"))], "path string, content binary"))
    other = Catalog(spark, str(tmp_path / "b"))
    copy_revisions(c, other)
    with pytest.raises(MissingBlock, match="a.txt, b.txt"):
        restore(other, str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "out")
    restore(other, str(tmp_path / "out"), fallback=c)
    assert listing(str(tmp_path / "out")) == {"a.txt": ("file", b"alpha"), "b.txt": ("file", b"beta")}
    rows = spark.createDataFrame([("x", "file", None, None)], "path string, kind string, content binary, symlink_target string")
    with pytest.raises(PySparkException, match="has no content"):
        rows.write.format("fstree").mode("append").save(str(tmp_path / "more"))


def test_unrelated_catalogs_are_not_synced(spark, tmp_path):
    one, two = Catalog(spark, str(tmp_path / "a")), Catalog(spark, str(tmp_path / "b"))
    for c, x in ((one, b"12345"), (two, b"abcde")):
        add(c, spark.createDataFrame([("f", bytearray(x))], "path string, content binary"))
    assert sync(one, two) == sync(two, one) == "unknown"
    with pytest.raises(CairnError):
        copy_revisions(one, two)
    assert one.by_root(one.last()["root"]).head()["cid"] == one.nodes().head()["cid"] != two.nodes().head()["cid"]


def test_of_two_writers_one_gets_an_error(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "a"))
    row = lambda name: spark.createDataFrame([(name,)], "path string")
    c.commit(tree.mkdir(c.nodes(), row("one")))
    parent = c.revision()
    first, second = (c.stage(tree.mkdir(c.nodes(parent), row(n))) for n in ("two", "three"))
    assert c.publish(first, parent) == 2
    with pytest.raises(Conflict):
        c.publish(second, parent)
    assert c.revision() == 2 and {r.path for r in c.nodes().collect()} == {"one", "two"}


def test_a_file_that_changes_is_noticed(spark, nasty):
    rows = scan(spark, nasty).filter("kind = 'file'").select("path", "cid").collect()
    put(nasty, "a.txt", b"other")
    with pytest.raises(PySparkException, match="has changed"):
        fstree.bodies(spark.createDataFrame(rows), nasty).count()


def test_a_moved_subtree_replaces_what_was_there(spark):
    nodes = spark.createDataFrame([("a/x", "file"), ("b/x", "file"), ("b/y", "file"), ("c", "file")], "path string, kind string")
    assert sorted(r.path for r in tree.mv(nodes, "a", "b").collect()) == ["b/x", "c"]
    with pytest.raises(CairnError):
        tree.mv(nodes, "a", "a/b")


def test_stream_ingest(spark, tmp_path):
    from cairn.streaming.ingest import ingest

    src, c = str(tmp_path / "src"), Catalog(spark, str(tmp_path / "cat"))
    rows = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2"))], "path string, content binary")
    rows.write.parquet(src)
    for _ in range(2):
        ingest(spark.readStream.schema(rows.schema).parquet(src), c, str(tmp_path / "cp")).awaitTermination()
    assert c.revision() == 1 and c.blocks().count() == 2
    again = spark.createDataFrame([("a", bytearray(b"3"), 1), ("a", bytearray(b"4"), 2), ("a", bytearray(b"0"), 0)], "path string, content binary, modified int")
    again.write.parquet(str(tmp_path / "more"))
    ingest(spark.readStream.schema(again.schema).parquet(str(tmp_path / "more")), c, str(tmp_path / "cp2")).awaitTermination()
    node = c.nodes().filter("path = 'a'").head()
    assert node["cid"] == codec.make_cid(b"4").hex() and c.index().count() == 5
