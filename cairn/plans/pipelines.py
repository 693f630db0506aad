"""Prepare and restore: a directory against its catalog, block archives, and back to disk.

A catalog is a folder: archives `blocks/<n>.car`, a node table for each revision, and a small record `revisions/<n>.json` that
is created last and never replaced. So a reader never sees a revision without its blocks, and of two writers that start from
the same revision one gets an error. A record names the root of its tree, a CID over the nodes' contents, and a version, a hash
of that root and the version before: equal versions are equal histories.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.errors import CairnError, CodecError, Conflict, MissingBlock, NodeNotFound
from cairn.functions import codec
from cairn.functions.columns import cid_hex, lz4_compress, lz4_decompress, mime_type
from cairn.operators import scan as scans
from cairn.operators import store, tree, versions
from cairn.session import Scratch, task_count
from cairn.sources import car, fstree, register

NODE = "path string, kind string, cid string, size long, symlink_target string, mime_type string, codec string, created timestamp, modified timestamp"
NODE_COLS = [f.split()[0] for f in NODE.split(", ")]
REVISION = "revision long, previous long, root string, version string, n_nodes long, bytes long, nodes string"
BATCH_BYTES, RANGE_BYTES = 8 << 20, 64 << 20
# A root is a CIDv1 of DAG-CBOR's codec with SHA2-256; its tree has a branch for each three hex digits.
ROOT_PREFIX, BRANCH_DIGITS = "01711220", 3


def root_cids(nodes: DataFrame, by: list[str]) -> DataFrame:
    """(by..., root, n_nodes, bytes): the content address of each tree of nodes (path, kind, cid, symlink_target, size).

    Nodes are hashed, the hashes of a branch are hashed in order, and so are the branches; no task holds more than a
    4096th of a tree's hashes. Times and media types are no part of it."""
    text = F.concat_ws("\x1f", "path", "kind", F.coalesce("cid", F.lit("")), F.coalesce("symlink_target", F.lit("")))
    leaves = nodes.select(*by, "size", F.sha2(text, 256).alias("leaf")).withColumn("branch", F.substring("leaf", 1, BRANCH_DIGITS))
    hashed = F.sha2(F.array_join(F.array_sort(F.collect_list("leaf")), ""), 256)
    branches = leaves.groupBy(*by, "branch").agg(hashed.alias("hash"), F.count("*").alias("n"), F.sum("size").alias("bytes"))
    listed = F.array_sort(F.collect_list(F.concat("branch", F.lit(":"), "hash")))
    return branches.groupBy(*by).agg(F.concat(F.lit(ROOT_PREFIX), F.sha2(F.array_join(listed, ","), 256)).alias("root"), F.sum("n").alias("n_nodes"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))


def root_cid(nodes: DataFrame) -> tuple[str, int, int]:
    """Root, number of nodes and bytes of one tree."""
    found = root_cids(nodes.withColumn("__one", F.lit(1)), ["__one"]).head()
    return (found["root"], found["n_nodes"], found["bytes"]) if found else (ROOT_PREFIX + hashlib.sha256(b"").hexdigest(), 0, 0)


@dataclass
class Staged:
    """Nodes that are written but no revision yet."""

    nodes: str
    root: str
    n_nodes: int
    bytes: int


class Catalog:
    """The nodes, blocks and revisions of one drive under a shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        register(spark)
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _exists(self, name: str) -> bool:
        store, path = self._at(name)
        return store.exists(path)

    def _drop(self, name: str) -> None:
        store, path = self._at(name)
        store.delete(path, True)

    def _table(self, name: str, ddl: str, kind: str = "parquet") -> DataFrame:
        return self.spark.read.schema(ddl).format(kind).load(f"{self.root}/{name}") if self._exists(name) else self.spark.createDataFrame([], ddl)

    # revisions

    def roots(self) -> DataFrame:
        """A row for each revision that was committed."""
        return self._table("revisions", REVISION, "json")

    def last(self, revision: int | None = None):
        """The record of a revision, of the newest one by default; None if there is none."""
        rows = self.roots() if revision is None else self.roots().filter(F.col("revision") == revision)
        return rows.orderBy(F.desc("revision")).head()

    def by_root(self, root: str) -> DataFrame:
        """The nodes under a root."""
        found = self.roots().filter(F.col("root") == root).orderBy("revision").head()
        if found is None:
            raise NodeNotFound(root)
        return self.nodes(found["revision"])

    def revision(self) -> int:
        found = self.last()
        return found["revision"] if found else 0

    def nodes(self, revision: int | None = None) -> DataFrame:
        found = self.last(revision)
        if found is None:
            return self.spark.createDataFrame([], NODE)
        return self.spark.read.schema(NODE).parquet(f"{self.root}/{found['nodes']}")

    def stage(self, nodes: DataFrame) -> Staged:
        """Write nodes, which no reader sees yet, and address them."""
        name = f"nodes-{uuid.uuid4().hex}"
        have = {f.name for f in nodes.schema.fields}
        kinds = dict(f.split() for f in NODE.split(", "))
        cols = [F.col(c) if c in have else F.lit(None).cast(kinds[c]).alias(c) for c in NODE_COLS]
        nodes.select(*cols).write.parquet(f"{self.root}/{name}")
        return Staged(name, *root_cid(self.spark.read.schema(NODE).parquet(f"{self.root}/{name}")))

    def publish(self, staged: Staged, parent: int | None = None) -> int:
        """Make staged nodes the revision after parent (by default the newest); if there is one already that's an error."""
        before = self.last(parent) if parent != 0 else None
        n = before["revision"] if before else 0
        version = hashlib.sha256(f"{before['version'] if before else ''}:{staged.root}".encode()).hexdigest()
        record = {"revision": n + 1, "previous": n or None, "root": staged.root, "version": version, "n_nodes": staged.n_nodes, "bytes": staged.bytes, "nodes": staged.nodes}
        self._record(n + 1, record)
        return n + 1

    def _record(self, revision: int, record: dict) -> None:
        files, path = self._at(f"revisions/{revision}.json")
        try:
            out = files.create(path, False)
        except Exception as e:
            if files.exists(path):
                raise Conflict(f"revision {revision} of {self.root} was committed by another writer") from e
            raise
        out.write(bytearray(json.dumps(record).encode()))
        out.close()

    def commit(self, nodes: DataFrame, parent: int | None = None) -> int:
        """Write nodes as the next revision of parent, the one that they were made from."""
        parent = self.revision() if parent is None else parent
        return self.publish(self.stage(nodes), parent)

    def history(self) -> DataFrame:
        return versions.history(self.roots().select(F.col("revision").alias("id"), "previous"))

    # blocks

    def blocks(self, content: bool = True) -> DataFrame:
        """Blocks of all deltas; a content that several deltas hold has a row for each."""
        raw = self.spark.read.format("car").option("content", str(content).lower()).load(f"{self.root}/blocks")
        return raw.withColumn("cid", F.lower(F.hex("cid")))

    def index(self) -> DataFrame:
        """(cid, store, archive, offset): where each content lies in its newest delta. Only indexes are read."""
        if not self._exists("blocks"):
            return self.spark.createDataFrame([], "cid string, store string, archive string, offset long")
        found = self.blocks(content=False).groupBy("cid").agg(F.max(F.struct("delta", "archive", "offset")).alias("b"))
        return found.select("cid", F.lit(f"{self.root}/blocks").alias("store"), "b.archive", "b.offset")

    def put(self, content: DataFrame, root: str | None = None) -> None:
        """Append contents (cid, content) that no delta has as the next deltas, which carry the root. What is known leaves
        before bodies are compared, on the same partitioning."""
        fresh = content.join(self.index().select("cid"), "cid", "left_anti").dropDuplicates(["cid"])
        fresh.select(F.unhex("cid").alias("cid"), "content").write.format("car").mode("append").option("roots", root or "").save(f"{self.root}/blocks")

    def stored(self) -> int:
        """Bytes of the archives."""
        files, _ = car.filesystem(f"{self.root}/blocks")
        return sum(files.get_file_info(p).size for p in car.archives(f"{self.root}/blocks"))

    def uploads(self) -> DataFrame:
        """(delta, length, digest) of the archives that were pushed here: bytes and BLAKE3 in hex."""
        return self._table("uploads", "delta int, length long, digest string")

    def record_uploads(self) -> None:
        """Digest the archives that have no record yet."""
        known = {r["delta"] for r in self.uploads().select("delta").collect()}  # a row for each archive
        found = car.digests(self.spark, f"{self.root}/blocks", known)
        found.select("delta", "length", F.lower(F.hex("digest")).alias("digest")).write.mode("append").parquet(f"{self.root}/uploads")

    # contents that went

    def deleted(self) -> DataFrame:
        """(cid, revision): contents that a revision holds no more, until a push tells the remote."""
        return self._table("deleted", "cid string, revision long")

    def record_deleted(self, cids: DataFrame, revision: int) -> None:
        cids.select("cid", F.lit(revision).cast("long").alias("revision")).write.mode("append").parquet(f"{self.root}/deleted")


def located(cids: DataFrame, *stores: Catalog) -> DataFrame:
    """The rows (cid, ...) with the place of their content in the first store that has it, nulls if none has."""
    found = [s.index().withColumn("nth", F.lit(i)) for i, s in enumerate(stores)]
    places = reduce(DataFrame.unionByName, found).groupBy("cid").agg(F.min(F.struct("nth", "store", "archive", "offset")).alias("p"))
    return cids.join(places.select("cid", "p.store", "p.archive", "p.offset"), "cid", "left")


def fetch(rows: DataFrame) -> DataFrame:
    """The rows (cid, store, archive, offset, ...) with their content, each read by its offset alone; rows of one stretch of an
    archive are read together. A block of another cid is an error."""
    placed = rows.repartition(task_count(rows.sparkSession), "archive", F.floor(F.col("offset") / RANGE_BYTES)).sortWithinPartitions("archive", "offset")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, content binary"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            content: list[bytes] = []
            done = size = 0
            opened: tuple | None = None
            for i, (cid, where, archive, offset) in enumerate(zip(pdf["cid"], pdf["store"], pdf["archive"], pdf["offset"], strict=True)):
                if opened is None or opened[0] != (where, archive):
                    if opened:
                        opened[1].close()
                    f = car.filesystem(where)[0].open_input_file(archive)
                    opened = (where, archive), f, codec.Archive(f)
                found, body = opened[2].get(int(offset))
                if found.hex() != cid:
                    raise CodecError(f"{archive} has another block than {cid} at {offset}")
                content.append(body)
                size += len(body)
                if size >= BATCH_BYTES:
                    yield pdf.iloc[done : i + 1].assign(content=content)
                    content, done, size = [], i + 1, 0
            if opened:
                opened[1].close()
            if content:
                yield pdf.iloc[done:].assign(content=content)

    return placed.mapInPandas(read, schema)


def contents(catalog: Catalog, nodes: DataFrame, *more: Catalog) -> DataFrame:
    """The files among nodes with their content as it was added, from the catalog or else from more stores in turn. Contents
    that none of them has are an error before anything is read."""
    placed = located(nodes.filter("kind = 'file'"), catalog, *more)
    lost = placed.filter("archive IS NULL")
    few = [r["path"] for r in lost.select("path").limit(10).collect()]
    if few:
        raise MissingBlock(f"{lost.count()} files have contents that no store holds: {', '.join(sorted(few))}")
    raw = fetch(placed)
    return raw.withColumn("content", F.coalesce(lz4_decompress(F.when(F.col("codec") == "lz4", F.col("content"))), F.col("content"))).drop("store", "archive", "offset")


def scan(spark: SparkSession, directory: str) -> DataFrame:
    """Entries of a directory with the cid of each file, hashed where it is read; bodies stay there."""
    rows = fstree.hashed(fstree.walk(spark, directory, Scratch(spark, "walk")), directory)
    rows = rows.withColumn("size", F.when(F.col("kind") == "file", F.col("len")).otherwise(0))
    return rows.withColumn("mime_type", F.when(F.col("kind") == "file", mime_type(F.col("path"))))


def prepare(catalog: Catalog, directory: str) -> dict[str, DataFrame]:
    """Bring the catalog to what is on disk; unchanged contents are neither read again, nor written, nor counted.

    The directory is walked and hashed once. Only bodies that no delta has are read a second time, and must still be what was
    hashed. Returns the deleted and changed paths and the contents that nothing holds any more.
    """
    parent = catalog.revision()
    scratch = Scratch(catalog.spark, "prepare")
    rows, old = scratch.write(scan(catalog.spark, directory), "scan"), catalog.nodes(parent)
    staged = catalog.stage(rows)
    fresh = rows.filter("kind = 'file'").groupBy("cid").agg(F.min("path").alias("path")).join(catalog.index().select("cid"), "cid", "left_anti")
    bodies = fstree.bodies(fresh, directory)
    bodies.select(F.unhex("cid").alias("cid"), "content").write.format("car").mode("append").option("roots", staged.root).save(f"{catalog.root}/blocks")
    now = catalog.publish(staged, parent)
    scratch.drop()
    new = catalog.nodes(now)
    mine, theirs = old.filter("kind = 'file'"), new.filter("kind = 'file'")
    gone = mine.select("cid").distinct().join(theirs.select("cid").distinct(), "cid", "left_anti")
    catalog.record_deleted(gone, now)
    return {
        "plan": scans.plan(new.withColumnRenamed("size", "len")), "deleted": scans.deleted(old, new), "changed": scans.changed(mine, theirs),
        "deleted_cids": gone, "added": scans.added(old, new), "previous": catalog.roots().filter(F.col("revision") == parent),
    }


def restore(catalog: Catalog, directory: str, revision: int | None = None, prefix: str = "", fallback: Catalog | None = None) -> None:
    """Write a revision's nodes to disk: contents from the catalog's deltas, else from fallback's. Each body is read by its
    offset where it is written, so none is moved, and contents that no store has are an error before a file is written."""
    nodes = catalog.nodes(revision)
    nodes = nodes if not prefix else nodes.filter(tree.under(F.col("path"), prefix))
    if nodes.isEmpty() and prefix:
        raise NodeNotFound(prefix)
    files = contents(catalog, nodes, *([fallback] if fallback else [])).select("path", "kind", "content", "symlink_target")
    rest = nodes.filter("kind <> 'file'").select("path", "kind", F.lit(None).cast("binary").alias("content"), "symlink_target")
    files.unionByName(rest).write.format("fstree").mode("append").save(directory)


def add(catalog: Catalog, files: DataFrame, compress: bool = False, order: str | None = None) -> int:
    """Write files (path, content) into the catalog: nodes, contents, then the revision. With compress, blocks are LZ4 frames
    and the nodes' codec says so. Of rows that repeat a path the last by order counts (by cid without one); all contents are kept."""
    parent = catalog.revision()
    body = lz4_compress("content") if compress else F.col("content")
    rows = files.withColumn("size", F.octet_length("content").cast("long")).withColumn("content", body).withColumn("cid", cid_hex(F.col("content")))
    rows = rows.withColumn("codec", F.lit("lz4" if compress else None).cast("string"))
    keep = [F.col(order).alias("at")] if order else []
    last = rows.groupBy("path").agg(F.max(F.struct(*keep, "cid", "size", "codec")).alias("v")).select("path", "v.cid", "v.size", "v.codec")
    staged = catalog.stage(tree.write(catalog.nodes(parent), last))
    catalog.put(rows.select("cid", "content"), staged.root)
    return catalog.publish(staged, parent)


def remove(catalog: Catalog, path: str) -> int:
    parent = catalog.revision()
    old = catalog.nodes(parent)
    now = catalog.commit(tree.rm(old, path, check=True), parent)
    gone = old.filter("cid IS NOT NULL").select("cid").distinct().join(catalog.nodes(now).select("cid"), "cid", "left_anti")
    catalog.record_deleted(gone, now)
    return now


def sync(local: Catalog, remote: Catalog) -> str:
    """The state of a local catalog against a remote one, by their versions; `unknown` if neither history holds the other's
    version, so that they have diverged."""
    mine, theirs = local.last(), remote.last()
    if theirs is None:
        return "unpublished"
    if mine is None:
        return "unlocalized"
    if mine["version"] == theirs["version"]:
        wanted = local.nodes().filter("cid IS NOT NULL").select("cid")
        return "all_synced" if store.missing(wanted, local.index()).isEmpty() else "metadata_synced"
    if not remote.roots().filter(F.col("version") == mine["version"]).isEmpty():
        return "behind"
    return "ahead" if not local.roots().filter(F.col("version") == theirs["version"]).isEmpty() else "unknown"


def copy_revisions(src: Catalog, dst: Catalog) -> None:
    """Bring dst's history to src's; if dst's newest version is none of src's the two have diverged, which is an error."""
    have = dst.last()
    if have is not None and src.roots().filter(F.col("version") == have["version"]).isEmpty():
        raise CairnError(f"{dst.root} has versions that {src.root} has not")
    for row in src.roots().filter(F.col("revision") > (have["revision"] if have else 0)).orderBy("revision").collect():  # a row for each revision
        name = f"nodes-{uuid.uuid4().hex}"
        src.nodes(row["revision"]).write.parquet(f"{dst.root}/{name}")
        dst._record(row["revision"], row.asDict() | {"nodes": name})
