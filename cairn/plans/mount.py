"""A drive as a session object: tree operations, sharing, snapshots and exchange with a remote catalog.

Each change is a new revision of the catalog. Snapshots and shares are tables beside it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.errors import CairnError, MissingBlock, NodeNotFound
from cairn.functions.columns import lz4_decompress
from cairn.operators import sharing, tree, versions
from cairn.plans.pipelines import Catalog, add, copy_revisions, fetch, located, remove, restore, sync

SNAPSHOT = "id string, revision long, size long"
PUSH = "version string, revision long, root string, data_size long, fingerprints array<string>, n_deleted long"
SHARE = "drive string, ref_kind string, fingerprint string, der string, enc_ref string"


class Mount:
    def __init__(self, spark: SparkSession, root: str, remote: str | None = None, drive: str = "drive", creator: tuple[str, str] | None = None):
        """A new drive is shared with its creator (fingerprint, key), if one is given."""
        self.spark, self.drive = spark, drive
        self.catalog = Catalog(spark, root)
        self.remote = Catalog(spark, remote) if remote else None
        if creator and not self.catalog.revision() and not self.catalog._exists("shares"):
            self.share_with(*creator)

    # reading

    def nodes(self) -> DataFrame:
        return self.catalog.nodes()

    def ls(self, path: str = "") -> DataFrame:
        return tree.ls(self.nodes(), path)

    def tree(self, path: str = "") -> DataFrame:
        return tree.tree(self.nodes(), path)

    def read_bytes(self, path: str) -> bytes:
        """One file: from the drive's own deltas, else from the remote's."""
        node = tree.get(self.nodes(), path).filter("kind = 'file'").head()
        if node is None:
            raise NodeNotFound(path)
        return self._content(node["cid"], node["codec"], path)

    def _content(self, cid: str, codec: str | None, path: str) -> bytes:
        wanted = self.spark.createDataFrame([(cid, codec)], "cid string, codec string")
        found = fetch(located(wanted, *filter(None, (self.catalog, self.remote))).filter("archive IS NOT NULL"))
        row = found.select(F.coalesce(lz4_decompress(F.when(F.col("codec") == "lz4", F.col("content"))), F.col("content")).alias("content")).head()
        if row is None:
            raise MissingBlock(f"no store holds the content of {path}")
        return bytes(row["content"])

    def describe(self) -> dict:
        """Revision, nodes, bytes of the tree and of the archives."""
        last = self.catalog.last()
        stored = self.catalog.stored() if self.catalog._exists("blocks") else 0
        return {"revision": last["revision"] if last else 0, "root": last["root"] if last else None, "nodes": last["n_nodes"] if last else 0, "bytes": last["bytes"] if last else 0, "stored": stored}

    def unlock(self, fingerprint: str) -> DataFrame:
        """The refs that a key may open; a key without a share is an error."""
        return sharing.open_share(self.shares(), fingerprint)

    # changing

    def _change(self, fn: Callable[[DataFrame], DataFrame]) -> int:
        """Commit what fn makes of the newest nodes, unless another writer was faster."""
        parent = self.catalog.revision()
        return self.catalog.commit(fn(self.catalog.nodes(parent)), parent)

    def mkdir(self, path: str) -> int:
        return self._change(lambda nodes: tree.mkdir(nodes, self.spark.createDataFrame([(path.strip("/"),)], "path string")))

    def write(self, path: str, content: bytes) -> int:
        return add(self.catalog, self.spark.createDataFrame([(path.strip("/"), bytearray(content))], "path string, content binary"))

    def mv(self, src: str, dst: str) -> int:
        return self._change(lambda nodes: tree.mv(nodes, src, dst, check=True))

    def cp(self, src: str, dst: str) -> int:
        return self._change(lambda nodes: tree.cp(nodes, src, dst, check=True))

    def rm(self, path: str) -> int:
        return remove(self.catalog, path)

    def symlink(self, target: str, path: str) -> int:
        return self._change(lambda nodes: tree.symlink(nodes, self.spark.createDataFrame([(path.strip("/"), target)], "path string, symlink_target string")))

    # sharing

    def _table(self, name: str, ddl: str) -> DataFrame:
        return self.catalog._table(name, ddl)

    def shares(self) -> DataFrame:
        """The newest state of each recipient's refs."""
        rows = self._table("shares", f"{SHARE}, at long")
        last = rows.groupBy("drive", "ref_kind", "fingerprint").agg(F.max_by(F.struct("der", "enc_ref"), "at").alias("r"))
        return last.select("drive", "ref_kind", "fingerprint", "r.der", "r.enc_ref")

    def share_with(self, fingerprint: str, der: str) -> None:
        """Make a key a recipient of the original and the current state."""
        root = self._root()
        key = self.spark.createDataFrame([(self.drive, fingerprint, der)], "drive string, fingerprint string, der string")
        refs = self.spark.createDataFrame([(self.drive, k, root) for k in ("original", "current")], "drive string, ref_kind string, enc_ref string")
        new = sharing.add_recipient(self.shares(), key, refs)
        new.withColumn("at", F.lit(self.catalog.revision()).cast("long")).write.mode("append").parquet(f"{self.catalog.root}/shares")

    def _root(self) -> str:
        last = self.catalog.last()
        return last["root"] if last else ""

    def share_file(self, path: str) -> str:
        return sharing.share_file(self.nodes(), path, self._root())

    def receive(self, token: str) -> tuple[str, bytes]:
        """Name and content of a shared file."""
        t = self.spark.range(1).select(sharing.read_token(F.lit(token)).alias("t")).head()["t"]
        node = self.nodes().filter(F.col("cid") == t["payload"]).head()
        return t["file_name"], self._content(t["payload"], node["codec"] if node else None, t["file_name"])

    # versions

    def history(self) -> DataFrame:
        return self.catalog.history()

    def snapshots(self) -> DataFrame:
        return self._table("snapshots", SNAPSHOT)

    def snapshot(self, name: str) -> None:
        """Keep the current revision under a name, with the size of its distinct contents."""
        if self.has_snapshot(name):
            raise CairnError(f"there is a snapshot {name} already")
        live = self.nodes().filter("cid IS NOT NULL").dropDuplicates(["cid"])
        row = live.agg(F.lit(name).alias("id"), F.lit(self.catalog.revision()).cast("long").alias("revision"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("size"))
        row.write.mode("append").parquet(f"{self.catalog.root}/snapshots")

    def has_snapshot(self, name: str) -> bool:
        return not self.snapshots().filter(F.col("id") == name).isEmpty()

    def snapshot_cids(self, name: str) -> DataFrame:
        return versions.snapshot_cids(self.catalog.nodes(self._revision_of(name)))

    def _revision_of(self, name: str) -> int:
        row = self.snapshots().filter(F.col("id") == name).head()
        if row is None:
            raise CairnError(f"there is no snapshot {name}")
        return row["revision"]

    def restore_snapshot(self, name: str) -> int:
        """Make a snapshot's nodes the next revision."""
        return self.catalog.commit(self.catalog.nodes(self._revision_of(name)))

    def restore(self, directory: str) -> None:
        restore(self.catalog, directory, fallback=self.remote)

    # exchange with the remote

    def state(self) -> str:
        if self.remote is None:
            return "unpublished"
        return sync(self.catalog, self.remote)

    def pushes(self) -> DataFrame:
        """What the remote was told with each push."""
        return self.remote._table("pushes", PUSH)

    def push(self) -> str:
        """Bring the remote to the drive's version: contents that it lacks and their archives' digests first, then revisions,
        sizes, the fingerprints that may read, and the contents that went, which the drive then forgets."""
        if self.remote is None:
            raise CairnError("this drive has no remote")
        if self.state() in ("behind", "unknown"):
            raise CairnError("the remote has versions that this drive has not")
        last = self.catalog.last()
        if last is None:
            return self.state()
        lacking = self.catalog.index().join(self.remote.index().select("cid"), "cid", "left_anti")
        if not lacking.isEmpty():
            self.remote.put(fetch(lacking).select("cid", "content"), last["root"])
            self.remote.record_uploads()
        copy_revisions(self.catalog, self.remote)
        gone = self.catalog.deleted().select("cid").distinct().withColumn("version", F.lit(last["version"]))
        gone.write.mode("append").parquet(f"{self.remote.root}/gone")
        prints = self.shares().agg(F.array_sort(F.collect_set("fingerprint")).alias("fingerprints"))  # a drive's recipients are few
        n_deleted = self.remote._table("gone", "cid string, version string").filter(F.col("version") == last["version"]).count()
        told = prints.select(F.lit(last["version"]).alias("version"), F.lit(last["revision"]).alias("revision"), F.lit(last["root"]).alias("root"), F.lit(last["bytes"]).alias("data_size"), "fingerprints", F.lit(n_deleted).cast("long").alias("n_deleted"))
        told.write.mode("append").parquet(f"{self.remote.root}/pushes")
        self.catalog._drop("deleted")
        return self.state()

    def pull(self) -> str:
        """Take the remote's newer revisions; contents stay where they are until they are read or restored."""
        if self.remote is None:
            raise CairnError("this drive has no remote")
        if self.state() != "ahead":
            copy_revisions(self.remote, self.catalog)
        return self.state()
