"""The query catalogue's second part: archives, trees, catalogs and the control plane, written and read back, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import columns as C
from cairn.operators import catalog as drives
from cairn.operators import scan as scans
from cairn.operators import sharing, store, tree, versions
from cairn.plans import pipelines
from cairn.plans.files import files, on_disk
from cairn.plans.mount import Mount
from cairn.plans.pipelines import Catalog
from cairn.plans.queries import query
from cairn.session import Scratch, read_table
from cairn.sources import car, config, register

TEXTS = "(SELECT f.*, text FROM f JOIN documents USING (doc_id) WHERE text IS NOT NULL)"


def _contents(spark, sf) -> DataFrame:
    """doc_id, path, source, cid and content of the documents that have a text."""
    rows = files(spark, sf, content=True).filter("text IS NOT NULL")
    return rows.select("doc_id", "path", "source", "cid", "len", F.encode("text", "UTF-8").alias("content"))


def _disk(spark, sf) -> DataFrame:
    return _contents(spark, sf).join(read_table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")


def _tree(rows: DataFrame, path: str) -> str:
    """The rows' files on disk."""
    rows.select("path", F.lit("file").alias("kind"), "content", F.lit(None).cast("string").alias("symlink_target")).write.format("fstree").mode("append").save(path)
    return path


def _fresh(spark, what: str) -> Scratch:
    register(spark)
    return Scratch(spark, what)


# archives


def _archives(spark, sf) -> str:
    path = _fresh(spark, "car-query").path("archives")
    _contents(spark, sf).select("content").write.format("car").mode("append").save(path)
    return path


@query(f"SELECT DISTINCT cid, len AS length, md5(text) AS digest FROM {TEXTS} t")
def q_car_scan(spark, sf):
    """Documents written as archives and read back block by block."""
    back = spark.read.format("car").load(_archives(spark, sf))
    return back.select(F.lower(F.hex("cid")).alias("cid"), "length", F.md5("content").alias("digest")).distinct()


@query(f"SELECT DISTINCT cid FROM {TEXTS} t")
def q_car_index(spark, sf):
    """The same by the archives' indexes alone."""
    back = spark.read.format("car").option("content", "false").load(_archives(spark, sf))
    return back.select(F.lower(F.hex("cid")).alias("cid")).distinct()


@query(f"SELECT DISTINCT cid, len AS length FROM {TEXTS} t WHERE cid = (SELECT min(cid) FROM f)")
def q_car_lookup(spark, sf):
    """One content, by a look-up in each archive's index."""
    least = files(spark, sf).agg(F.min("cid")).head()[0]
    back = spark.read.format("car").load(_archives(spark, sf)).filter(F.col("cid") == F.lit(bytearray.fromhex(least or "00")))
    return back.select(F.lower(F.hex("cid")).alias("cid"), "length").distinct()


def _packed(spark, sf) -> DataFrame:
    return car.pack(_contents(spark, sf), "doc_id")


@query(f'SELECT doc_id, cid, CAST(69 AS BIGINT) AS "offset", len AS length, md5(text) AS digest FROM {TEXTS} t')
def q_car_memory(spark, sf):
    """An archive in memory for each document, opened again."""
    back = car.unpack(_packed(spark, sf), "doc_id")
    return back.select("doc_id", F.lower(F.hex("cid")).alias("cid"), "offset", "length", F.md5("content").alias("digest"))


_BLOCK = "36 + len + 1 + CAST(36 + len >= 128 AS INT) + CAST(36 + len >= 16384 AS INT) + CAST(36 + len >= 2097152 AS INT) + CAST(36 + len >= 268435456 AS INT)"


@query(f"SELECT doc_id, 2 AS version, 0 AS n_roots, CAST(51 AS BIGINT) AS data_offset, CAST(18 + {_BLOCK} AS BIGINT) AS data_size, CAST(69 + {_BLOCK} AS BIGINT) AS index_offset FROM {TEXTS} t")
def q_car_headers(spark, sf):
    """Both headers of each archive, decoded."""
    return car.headers(_packed(spark, sf), "doc_id")


# trees on disk


@query(f"""SELECT path, 'file' AS kind, len AS size, cid FROM {TEXTS} t UNION ALL SELECT DISTINCT source, 'dir', 0, NULL FROM {TEXTS} t
UNION ALL SELECT DISTINCT source || '/' || lang, 'dir', 0, NULL FROM {TEXTS} t""")
def q_fstree(spark, sf):
    """Documents written as files and scanned: entries with the hash of their content."""
    path = _tree(_contents(spark, sf), _fresh(spark, "tree").path("tree"))
    return pipelines.scan(spark, path).select("path", "kind", F.col("size").cast("long").alias("size"), "cid")


@query(f"SELECT path, md5(text) AS digest FROM {TEXTS} t")
def q_fstree_bodies(spark, sf):
    path = _tree(_contents(spark, sf), _fresh(spark, "tree").path("tree"))
    back = spark.read.format("fstree").option("content", "true").load(path).filter("kind = 'file'")
    return back.select("path", F.md5("content").alias("digest"))


# catalogs: add, prepare, restore, sync


def _catalog(spark, rows: DataFrame, compress: bool = False) -> Catalog:
    catalog = Catalog(spark, _fresh(spark, "catalog").path("drive"))
    pipelines.add(catalog, rows.select("path", "content"), compress)
    return catalog


@query(f"""SELECT path, 'file' AS kind, len AS size, 'lz4' AS codec FROM {TEXTS} t UNION ALL SELECT DISTINCT source, 'dir', 0, NULL FROM {TEXTS} t
UNION ALL SELECT DISTINCT source || '/' || lang, 'dir', 0, NULL FROM {TEXTS} t""")
def q_add_lz4(spark, sf):
    """Documents added with compression: the nodes know their codec and the size of what was added."""
    return _catalog(spark, _contents(spark, sf), True).nodes().select("path", "kind", "size", "codec")


@query(f"SELECT path, md5(text) AS digest FROM {TEXTS} t")
def q_catalog_read(spark, sf):
    """Compressed contents read back by their offsets."""
    catalog = _catalog(spark, _contents(spark, sf), True)
    return pipelines.contents(catalog, catalog.nodes()).select("path", F.md5("content").alias("digest"))


@query(f"""SELECT path, 'deleted' AS what FROM {TEXTS} t WHERE doc_id NOT IN (SELECT doc_id FROM d) UNION ALL
SELECT path, 'kept' FROM {TEXTS} t WHERE doc_id IN (SELECT doc_id FROM d)""")
def q_prepare(spark, sf):
    """A catalog of all documents is brought to a folder that has the labelled ones alone."""
    catalog = _catalog(spark, _contents(spark, sf))
    path = _tree(_disk(spark, sf), _fresh(spark, "disk").path("tree"))
    found = pipelines.prepare(catalog, path)
    gone = found["deleted"].filter("kind = 'file'").select("path", F.lit("deleted").alias("what"))
    return gone.unionByName(catalog.nodes().filter("kind = 'file'").select("path", F.lit("kept").alias("what")))


@query(f"SELECT cid, CAST(2 AS BIGINT) AS revision FROM (SELECT cid FROM {TEXTS} t EXCEPT SELECT cid FROM d) x")
def q_prepare_deleted(spark, sf):
    """The contents that the same step recorded as gone."""
    catalog = _catalog(spark, _contents(spark, sf))
    pipelines.prepare(catalog, _tree(_disk(spark, sf), _fresh(spark, "disk").path("tree")))
    return catalog.deleted()


@query(f"SELECT path, len AS size, cid FROM {TEXTS} t")
def q_restore(spark, sf):
    """Half of the contents are in the drive's own archives, the others in a second store; the tree is put on disk and scanned."""
    rows = _contents(spark, sf)
    own, other = _catalog(spark, rows.filter("source = 'src0'")), _catalog(spark, rows, False)
    own.commit(other.nodes())
    path = _fresh(spark, "restored").path("tree")
    pipelines.restore(own, path, fallback=other)
    return pipelines.scan(spark, path).filter("kind = 'file'").select("path", F.col("size").cast("long").alias("size"), "cid")


@query(f"""SELECT source, '01711220' || sha256(string_agg(branch || ':' || hash, ',' ORDER BY branch || ':' || hash)) AS root, CAST(sum(n) AS BIGINT) AS n_nodes, CAST(sum(bytes) AS BIGINT) AS bytes
FROM (SELECT source, substr(leaf, 1, 3) AS branch, sha256(string_agg(leaf, '' ORDER BY leaf)) AS hash, count(*) AS n, sum(len) AS bytes
      FROM (SELECT source, len, sha256(path || chr(31) || 'file' || chr(31) || cid || chr(31)) AS leaf FROM {TEXTS} t) l GROUP BY source, branch) b GROUP BY source""")
def q_root_cid(spark, sf):
    """The content address of each source's tree."""
    nodes = _contents(spark, sf).select("source", "path", F.lit("file").alias("kind"), "cid", F.lit(None).cast("string").alias("symlink_target"), F.col("len").alias("size"))
    return pipelines.root_cids(nodes, ["source"])


@query("""SELECT * FROM (VALUES ('copy', 'metadata_synced'), ('itself', 'all_synced'), ('longer', 'ahead'), ('nothing', 'unlocalized'), ('other', 'unknown'), ('shorter', 'behind'), ('unpublished', 'unpublished')) t(name, state)""")
def q_sync_roots(spark, sf):
    """States of catalogs of benchmark passages against each other."""
    rows = read_table(spark, sf, "benchmark").select(F.concat("item_id", F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    one, other = _catalog(spark, rows), _catalog(spark, rows.withColumn("content", F.concat("content", F.lit(bytearray(b"!")))))
    copy, longer, empty = (Catalog(spark, _fresh(spark, "catalog").path("drive")) for _ in range(3))
    pipelines.copy_revisions(one, copy)
    pipelines.copy_revisions(one, longer)
    longer.commit(tree.mkdir(longer.nodes(), spark.createDataFrame([("more",)], "path string")))
    pairs = {"copy": (copy, one), "itself": (one, one), "longer": (longer, one), "nothing": (empty, one), "other": (other, one), "shorter": (one, longer), "unpublished": (one, empty)}
    return spark.createDataFrame([(k, pipelines.sync(*v)) for k, v in pairs.items()], "name string, state string")


@query(f"""SELECT CAST(2 AS BIGINT) AS revision, CAST(coalesce(sum(len) FILTER (source <> 'src1'), 0) AS BIGINT) AS data_size, 'f1,f2' AS fingerprints,
(SELECT count(*) FROM (SELECT cid FROM {TEXTS} t WHERE source = 'src1' EXCEPT SELECT cid FROM {TEXTS} t WHERE source <> 'src1') g) AS n_deleted, CAST(0 AS BIGINT) AS left_to_tell FROM {TEXTS} t""")
def q_push_record(spark, sf):
    """A drive with two recipients loses a subtree and is pushed: what the remote is told, and what the drive has still to tell."""
    scratch = _fresh(spark, "mount")
    mount = Mount(spark, scratch.path("drive"), scratch.path("remote"), creator=("f2", "k2"))
    pipelines.add(mount.catalog, _contents(spark, sf).select("path", "content"))
    mount.rm("src1")
    mount.share_with("f1", "k1")
    mount.push()
    left = mount.catalog.deleted().agg(F.count("*").alias("left_to_tell"))
    return mount.pushes().select("revision", "data_size", F.array_join("fingerprints", ",").alias("fingerprints"), "n_deleted").crossJoin(F.broadcast(left))  # one row each


# column functions


@query(f"SELECT doc_id, len AS raw_len, true AS same FROM {TEXTS} t")
def q_lz4(spark, sf):
    rows = _contents(spark, sf).withColumn("packed", C.lz4_compress("content"))
    return rows.select("doc_id", F.col("len").alias("raw_len"), (C.lz4_decompress("packed") == F.col("content")).alias("same"))


_BITS = """list_aggregate(list_transform(range(1, 73), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', substr(cid, i, 1))]), 'string_agg', '') || '00'"""


@query(f"""SELECT doc_id, 'b' || list_aggregate(list_transform(range(0, 58), lambda k: substr('abcdefghijklmnopqrstuvwxyz234567',
  CAST(1 + list_sum(list_transform(range(0, 5), lambda j: CASE WHEN substr(bits, CAST(5 * k + j + 1 AS BIGINT), 1) = '1' THEN 1 << CAST(4 - j AS INT) ELSE 0 END)) AS BIGINT), 1)), 'string_agg', '') AS text_cid
FROM (SELECT doc_id, {_BITS} AS bits FROM f) b""")
def q_cid_text(spark, sf):
    return files(spark, sf).select("doc_id", C.cid_text(F.unhex("cid")).alias("text_cid"))


@query("SELECT doc_id, '01551114' || sha1(text) AS cid FROM documents")
def q_cid_sha1(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", C.cid_sha1(F.col("text")).alias("cid"))


@query("SELECT doc_id, CASE WHEN source = 'src1' THEN substr(path, 6) ELSE path END AS path FROM f")
def q_strip_prefix(spark, sf):
    return files(spark, sf).select("doc_id", C.strip_prefix(F.col("path"), "src1").alias("path"))


@query("SELECT doc_id, md5(to_base64(encode(text))) AS digest FROM documents")
def q_base64(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", F.md5(C.base64_plain(F.encode("text", "UTF-8"))).alias("digest"))


@query("""SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN format('{:.2f} KiB', floor(n / 1024 * 100 + 0.5) / 100)
WHEN n < 1073741824 THEN format('{:.2f} MiB', floor(n / 1048576 * 100 + 0.5) / 100) ELSE format('{:.2f} GiB', floor(n / 1073741824 * 100 + 0.5) / 100) END AS size
FROM (SELECT doc_id, CAST(len * len AS BIGINT) AS n FROM f) t""")
def q_human_bytes(spark, sf):
    return files(spark, sf).select("doc_id", C.human_bytes(F.col("len") * F.col("len")).alias("size"))


@query("SELECT doc_id, 'path=' || replace(path, '/', '%2F') || '&size=' || CAST(len AS VARCHAR) AS body FROM f")
def q_form_encode(spark, sf):
    return files(spark, sf).select("doc_id", C.form_encode({"path": F.col("path"), "size": F.col("len")}).alias("body"))


@query("SELECT doc_id, doc_id % 3 <> 0 AS ok FROM f")
def q_is_uuid(spark, sf):
    """Two of three texts are UUIDs, in either case."""
    h = F.md5(F.col("path"))
    parts = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(h, F.lit("-"))).when(F.col("doc_id") % 3 == 1, parts).otherwise(F.upper(parts))
    return files(spark, sf).select("doc_id", C.is_uuid(text).alias("ok"))


@query("""SELECT doc_id, '{"created":' || doc_id || ',"modified":' || (doc_id + 1) || ',"mime_type":"text/plain","size":' || len || '}' AS node FROM f""")
def q_node_json(spark, sf):
    return files(spark, sf).select("doc_id", C.node_json(F.col("doc_id"), F.col("doc_id") + 1, C.mime_type(F.col("path")), F.col("len")).alias("node"))


# lookups and stores


@query("SELECT cid, max(\"at\") AS \"offset\", CAST(count(*) AS BIGINT) AS n FROM (SELECT cid, doc_id AS \"at\" FROM f UNION ALL SELECT cid, doc_id + 1000000 FROM d) t GROUP BY cid")
def q_index_upsert(spark, sf):
    """Every document's entry, then those on disk again: the last entry of each content."""
    old = files(spark, sf).select("cid", F.col("doc_id").alias("offset"), F.col("doc_id").alias("seq"))
    new = on_disk(spark, sf).select("cid", (F.col("doc_id") + 1_000_000).alias("offset"), (F.col("doc_id") + 1_000_000).alias("seq"))
    n = old.unionByName(new).groupBy("cid").agg(F.count("*").alias("n"))
    return store.upsert_index(old, new, "seq").select("cid", "offset").join(n, "cid")


@query("""SELECT 'primary' AS store, cid FROM (SELECT cid FROM d UNION SELECT '01551220' || sha256(text) FROM benchmark) p
UNION ALL SELECT 'secondary', cid FROM (SELECT cid FROM f UNION SELECT '01551220' || sha256(text) FROM benchmark) s""")
def q_put_both(spark, sf):
    """Benchmark passages put into both of two stores."""
    new = read_table(spark, sf, "benchmark").select(C.cid_hex(F.col("text")).alias("cid"))
    one, two = store.put_both(new, on_disk(spark, sf).select("cid").distinct(), files(spark, sf).select("cid").distinct())
    return one.select(F.lit("primary").alias("store"), "cid").unionByName(two.select(F.lit("secondary").alias("store"), "cid"))


@query("SELECT path, len AS size FROM f WHERE path = (SELECT max(path) FROM f)")
def q_get_node(spark, sf):
    rows = files(spark, sf).select("path", F.col("len").alias("size"))
    return tree.get(rows, rows.agg(F.max("path")).head()[0] or "")


@query("""SELECT path, CASE WHEN text = 'a' THEN 'changed' ELSE 'same' END AS what FROM (SELECT path, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS text FROM d) t""")
def q_changed(spark, sf):
    """Every second file on disk has another content than the catalog's."""
    disk = on_disk(spark, sf).withColumn("cid", F.when(F.col("doc_id") % 2 == 0, C.cid_hex(F.concat("path", F.lit("!")))).otherwise(F.col("cid")))
    changed = scans.changed(files(spark, sf), disk).select("path", F.lit("changed").alias("what"))
    return changed.unionByName(scans.unchanged(files(spark, sf), disk).select("path", F.lit("same").alias("what")))


# drives, keys, snapshots


def _drives(spark, sf) -> DataFrame:
    return read_table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.lower("c_mktsegment").alias("type"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer WHERE c_custkey = (SELECT max(c_custkey) FROM customer)")
def q_find_drive(spark, sf):
    rows = _drives(spark, sf)
    last = rows.orderBy(F.col("id").cast("long").desc()).head()
    return drives.find(rows, drives.specifier(name=last["name"]), "id").select("id", "name")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 5 = 0 THEN 'renamed' ELSE c_name END AS name FROM customer WHERE c_custkey % 7 <> 0
UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation""")
def q_drive_changes(spark, sf):
    """Nations become drives, every fifth customer's is renamed and every seventh's deleted."""
    rows = _drives(spark, sf).select("id", "name")
    new = read_table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"))
    key = F.col("id").cast("long")
    renamed = drives.update(rows, rows.filter(key % 5 == 0).withColumn("name", F.lit("renamed")), "id")
    return drives.create(drives.delete(renamed, rows.filter(key % 7 == 0), "id"), new, "id")


@query("""SELECT DISTINCT conv_id AS drive, sha256(role) AS fingerprint, role = 'user' AS approved, role = 'user' AS is_mine FROM conversations""")
def q_keys(spark, sf):
    """Roles are keys of their conversation; the user's is approved and one's own."""
    keys = read_table(spark, sf, "conversations").select(F.col("conv_id").alias("drive"), C.fingerprint(F.col("role")).alias("fingerprint"), F.lit(False).alias("approved")).distinct()
    mine = keys.sparkSession.range(1).select(C.fingerprint(F.lit("user"))).head()[0]
    return drives.label_keys(drives.approve(keys, mine), mine)


@query("SELECT DISTINCT conv_id AS drive, ref_kind, 'r' || conv_id AS enc_ref FROM conversations CROSS JOIN (SELECT unnest(['original', 'current']) AS ref_kind) k WHERE role = 'user'")
def q_open_share(spark, sf):
    """The refs that the user's key opens."""
    keys = read_table(spark, sf, "conversations").select(F.col("conv_id").alias("drive"), C.fingerprint(F.col("role")).alias("fingerprint"), F.col("role").alias("der")).distinct()
    refs = keys.select("drive").distinct().withColumn("ref_kind", F.explode(F.array(F.lit("original"), F.lit("current")))).withColumn("enc_ref", F.concat(F.lit("r"), "drive"))
    none = spark.createDataFrame([], f"drive {keys.schema['drive'].dataType.simpleString()}, ref_kind string, fingerprint string, der string, enc_ref string")
    mine = spark.range(1).select(C.fingerprint(F.lit("user"))).head()[0]
    return sharing.unlock(sharing.add_recipient(none, keys, refs), mine)


@query("SELECT CAST(c_custkey AS VARCHAR) AS local_id, CASE WHEN c_custkey % 2 = 0 THEN 'r' || c_custkey ELSE 'l' || c_custkey END AS use_id FROM customer")
def q_resolve_id(spark, sf):
    key = F.col("c_custkey").cast("string")
    rows = read_table(spark, sf, "customer").select(key.alias("local_id"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("r"), key)).alias("remote_id"), F.concat(F.lit("l"), key).alias("local_remote_id"))
    return versions.resolve_id(rows).select("local_id", "use_id")


@query("SELECT string_agg(n_name || chr(9) || n_regionkey, chr(10) ORDER BY n_name || chr(9) || n_regionkey) AS text FROM nation")
def q_listing(spark, sf):
    return versions.listing(read_table(spark, sf, "nation"), ["n_name", "n_regionkey"])


@query("SELECT CAST(coalesce(sum(len), 0) AS BIGINT) AS bytes, CAST(1073741824 AS BIGINT) AS \"limit\" FROM f")
def q_account_usage(spark, sf):
    return drives.usage_text(files(spark, sf), 1 << 30).select("bytes", "limit")


@query("SELECT user_id AS drive, event_id AS id, coalesce(CASE WHEN event_type <> 'error' THEN value END, 0) AS data_size FROM events")
def q_project_versions(spark, sf):
    """Versions as the remote answers them, as rows of a drive; a size that is missing is 0."""
    answers = read_table(spark, sf, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") != "error", F.col("value")).alias("data_size"), "user_id")
    return drives.of_drive(answers, F.col("user_id"), sizes=["data_size"]).select("drive", "id", "data_size")


@query("""SELECT user_id AS drive, event_id AS id, CASE WHEN rn = 1 THEN 'current' ELSE 'outdated' END AS state
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) t""")
def q_snapshot_restore(spark, sf):
    """Each drive's first version has a snapshot, and is made current again where the last one was."""
    v = read_table(spark, sf, "events").select(F.col("user_id").alias("drive"), F.col("event_id").alias("metadata"), "ts")
    first = versions.original(v, ["ts", "metadata"], ["metadata"])
    last = versions.current(v, ["ts", "metadata"], ["metadata"]).select("drive", F.col("metadata").alias("id"))
    rows = v.select("drive", F.col("metadata").alias("id")).join(last.withColumn("now", F.lit(True)), ["drive", "id"], "left")
    rows = rows.select("drive", "id", F.when(F.col("now"), "current").otherwise("outdated").alias("state"))
    snapshots = first.select(F.lit("first").alias("id"), "drive", F.col("metadata").alias("metadata_id"))
    return versions.restore_snapshot(rows, snapshots, "first")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS local_id, n_name AS name, '/n/' || n_nationkey AS origin FROM nation WHERE n_regionkey <> 0")
def q_config(spark, sf):
    """Nations' drives in the configuration file, less those of one region; a row for each nation goes through the driver."""
    path = _fresh(spark, "config").path("config.json").removeprefix("file://")
    c = config.load(path)
    rows = read_table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").limit(100).collect()
    for r in rows:
        c = config.put_drive(c, {"local_id": str(r["n_nationkey"]), "name": r["n_name"], "origin": f"/n/{r['n_nationkey']}"})
    for r in rows:
        c = config.drop_drive(c, f"/n/{r['n_nationkey']}") if r["n_regionkey"] == 0 else c
    config.save(path, c)
    return config.drives(spark, config.load(path)).select("local_id", "name", "origin")
