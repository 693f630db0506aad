"""The query catalogue: each query applies an operator to whole tables; SQL gives the same rows where it can."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import columns as C
from cairn.operators import catalog, scan, sharing, store, tree, versions
from cairn.plans.files import DISK_SQL, FILES_SQL, files, hashed_once, on_disk
from cairn.plans.files import versions as version_rows
from cairn.session import Scratch, read_table
from cairn.sources import register

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function under its name, with SQL that may use f (all files) and d (files on disk)."""

    def add(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            used = re.search(r"\b(FROM|JOIN) [fd]\b", sql)
            ORACLES[fn.__name__] = f"WITH f AS ({FILES_SQL}), d AS ({DISK_SQL}) {sql}" if used else sql
        return fn

    return add


# content addressing and duplicate groups


@query("SELECT doc_id, cid, len FROM f")
def q_cid(spark, sf):
    return files(spark, sf).select("doc_id", "cid", "len")


@query("SELECT cid, len, count(*) AS n, min(doc_id) AS canonical FROM f GROUP BY cid, len HAVING count(*) > 1")
def q_dup_groups(spark, sf):
    return scan.groups(files(spark, sf), "doc_id")


@query("SELECT cid, min(doc_id) AS doc_id FROM f GROUP BY cid")
def q_dup_canonical(spark, sf):
    return scan.canonical(files(spark, sf), "doc_id")


@query("SELECT doc_id, canonical FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY cid) AS canonical FROM f) t WHERE doc_id <> canonical")
def q_dup_links(spark, sf):
    return scan.links(hashed_once(spark, sf), "doc_id").select("doc_id", "canonical")


@query("SELECT 'file_group' AS kind, min(doc_id) AS doc_id, cid, count(*) AS n_members, CAST(0 AS INTEGER) AS phase FROM f GROUP BY cid")
def q_plan(spark, sf):
    entries = files(spark, sf).withColumn("symlink_target", F.lit(None).cast("string"))
    return scan.plan(entries, "doc_id").select("kind", "doc_id", "cid", "n_members", "phase")


@query("SELECT doc_id, path, min(path) OVER (PARTITION BY cid) AS canonical FROM f")
def q_plan_members(spark, sf):
    return scan.members(hashed_once(spark, sf)).select("doc_id", "path", "canonical")


# difference of catalog and disk


@query("SELECT path, cid FROM f WHERE doc_id NOT IN (SELECT doc_id FROM d)")
def q_deleted(spark, sf):
    return scan.deleted(files(spark, sf), on_disk(spark, sf)).select("path", "cid")


@query("SELECT cid FROM f WHERE path NOT IN (SELECT path FROM d) EXCEPT SELECT cid FROM d")
def q_deleted_cids(spark, sf):
    rows = hashed_once(spark, sf)
    return scan.deleted_cids(rows, on_disk(spark, sf, rows))


@query("SELECT count(*) AS n, CAST(sum(len) AS BIGINT) AS bytes FROM d WHERE path IN (SELECT path FROM f)")
def q_unchanged(spark, sf):
    return scan.unchanged(files(spark, sf), on_disk(spark, sf)).agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("bytes"))


@query("SELECT doc_id, path FROM f WHERE path NOT IN (SELECT path FROM d)")
def q_added(spark, sf):
    return scan.added(on_disk(spark, sf), files(spark, sf)).select("doc_id", "path")


# block layout

_BLOCKS = """SELECT doc_id, delta, cid, len,
  CAST(36 + len + 1 + CAST(36 + len >= 128 AS INT) + CAST(36 + len >= 16384 AS INT) + CAST(36 + len >= 2097152 AS INT) + CAST(36 + len >= 268435456 AS INT) AS BIGINT) AS block_len
FROM f"""
_PLACED = f"""SELECT *, CAST(69 + coalesce(sum(block_len) OVER (PARTITION BY delta ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
FROM ({_BLOCKS}) b"""


@query(f"SELECT doc_id, len, block_len, block_len - len - 36 AS varint_len FROM ({_BLOCKS}) b")
def q_block_len(spark, sf):
    sized = files(spark, sf).withColumn("block_len", C.block_size(F.col("len")))
    return sized.select("doc_id", "len", "block_len", C.varint_size(F.col("len") + C.CID_LENGTH).alias("varint_len"))


def _placed(spark, sf):
    return store.layout(files(spark, sf), "delta", "doc_id")


@query(f'SELECT doc_id, delta, "offset" FROM ({_PLACED}) p')
def q_offsets(spark, sf):
    return _placed(spark, sf).select("doc_id", "delta", "offset")


@query(f'SELECT delta, cid, min("offset") AS "offset" FROM ({_PLACED}) p GROUP BY delta, cid')
def q_index(spark, sf):
    return store.index(_placed(spark, sf))


@query(f"""SELECT delta, count(*) AS n_blocks, CAST(51 AS BIGINT) AS data_offset, CAST(sum(block_len) + 18 AS BIGINT) AS data_size,
  CAST(max("offset" + block_len) AS BIGINT) AS index_offset FROM ({_PLACED}) p GROUP BY delta""")
def q_archive_header(spark, sf):
    return store.headers(_placed(spark, sf))


def _requests(spark, sf, rows):
    """Contents that are asked for: those on disk and benchmark passages, which the archives lack."""
    extra = read_table(spark, sf, "benchmark").select(C.cid_hex(F.col("text")).alias("cid"))
    return on_disk(spark, sf, rows).select("cid").unionByName(extra)


_REQUESTS = "SELECT cid FROM d UNION SELECT '01551220' || sha256(text) FROM benchmark"


@query(f"""SELECT r.cid, count(i.delta) AS n_archives, max(i.delta) AS delta FROM ({_REQUESTS}) r
LEFT JOIN (SELECT DISTINCT cid, delta FROM f) i ON r.cid = i.cid GROUP BY r.cid""")
def q_block_lookup(spark, sf):
    rows = hashed_once(spark, sf)
    return store.lookup(_requests(spark, sf, rows), rows.select("cid", "delta").distinct())


@query(f"SELECT cid FROM ({_REQUESTS}) r WHERE cid NOT IN (SELECT cid FROM f)")
def q_missing_blocks(spark, sf):
    rows = hashed_once(spark, sf)
    return store.missing(_requests(spark, sf, rows), rows)


@query("SELECT count(*) AS n FROM (SELECT DISTINCT cid FROM f WHERE cid NOT IN (SELECT cid FROM d)) t")
def q_unseen_blocks(spark, sf):
    return store.unseen(files(spark, sf).select("cid"), on_disk(spark, sf)).agg(F.count("*").alias("n"))


# layered stores


@query("SELECT cid, max(delta) AS delta, arg_max(doc_id, row(delta, -doc_id)) AS doc_id FROM f GROUP BY cid")
def q_newest_delta(spark, sf):
    return store.newest(files(spark, sf), "doc_id")


@query("""SELECT cid, CASE WHEN cid IN (SELECT cid FROM d) THEN 'primary' WHEN cid IN (SELECT cid FROM f) THEN 'secondary' ELSE 'missing' END AS source
FROM (SELECT cid FROM f UNION SELECT '01551220' || sha256(text) FROM benchmark) t""")
def q_split_store(spark, sf):
    rows = hashed_once(spark, sf)
    return store.split_read(rows.select("cid").unionByName(_requests(spark, sf, rows)), on_disk(spark, sf, rows), rows)


def _locations(rows):
    """Hosts are sources; what is in Spanish has the mark of an unknown place."""
    return rows.select(F.when(F.col("lang") == "es", "NA").otherwise(F.col("source")).alias("host"), "cid").distinct()


@query("""SELECT cid, min(host) FILTER (host <> 'NA') AS host, count(DISTINCT host) FILTER (host <> 'NA') AS n_hosts
FROM (SELECT cid, CASE WHEN lang = 'es' THEN 'NA' ELSE source END AS host FROM f) t GROUP BY cid""")
def q_locations(spark, sf):
    rows = hashed_once(spark, sf)
    return store.locate(rows, _locations(rows))


@query("""SELECT host, count(*) AS n_cids, min(cid) AS first_cid, max(cid) AS last_cid
FROM (SELECT DISTINCT cid, CASE WHEN lang = 'es' THEN 'NA' ELSE source END AS host FROM f) t GROUP BY host""")
def q_location_map(spark, sf):
    return store.location_map(_locations(files(spark, sf)))


# tree operations


def _nodes(spark, sf):
    return files(spark, sf).select("path", "kind", "cid", F.col("len").alias("size"), F.lit(None).cast("string").alias("symlink_target"), C.mime_type(F.col("path")).alias("mime_type"))


@query("""SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS segment
FROM (SELECT page_id, list_filter(string_split(url, '/'), lambda x: x <> '') AS l FROM pages) t""")
def q_segments(spark, sf):
    pages = read_table(spark, sf, "pages")
    return pages.select("page_id", F.posexplode(C.segments(F.col("url"))).alias("pos", "segment"))


@query("SELECT source AS name, 'dir' AS kind, count(*) AS n_files, CAST(sum(len) AS BIGINT) AS bytes FROM f GROUP BY source")
def q_ls(spark, sf):
    return tree.ls(_nodes(spark, sf))


@query("SELECT lang AS name, 'dir' AS kind, count(*) AS n_files, CAST(sum(len) AS BIGINT) AS bytes FROM f WHERE source = 'src1' GROUP BY lang")
def q_ls_below(spark, sf):
    return tree.ls(_nodes(spark, sf), "src1")


@query("SELECT path, CAST(2 AS INTEGER) AS depth FROM f WHERE source = 'src1'")
def q_tree_recursive(spark, sf):
    return tree.tree(_nodes(spark, sf), "src1", with_dirs=False).select("path", "depth")


@query("SELECT DISTINCT source AS path FROM f UNION SELECT DISTINCT source || '/' || lang FROM f")
def q_directories(spark, sf):
    return tree.directories(_nodes(spark, sf))


@query("SELECT source || '/' || lang AS dir, count(*) AS n_files, CAST(sum(len) AS BIGINT) AS bytes FROM f GROUP BY 1")
def q_dir_sizes(spark, sf):
    return tree.by_parent(_nodes(spark, sf))


@query("SELECT CASE WHEN source = 'src1' THEN 'archive/old' || substr(path, 5) ELSE path END AS path, cid FROM f")
def q_mv(spark, sf):
    return tree.mv(_nodes(spark, sf), "src1", "archive/old").select("path", "cid")


@query("SELECT path, cid FROM f WHERE source <> 'src1'")
def q_rm_subtree(spark, sf):
    return tree.rm(_nodes(spark, sf), "src1").select("path", "cid")


@query("SELECT path, cid FROM f UNION ALL SELECT 'copy/' || path, cid FROM f WHERE source = 'src1'")
def q_cp_link(spark, sf):
    return tree.cp(_nodes(spark, sf), "src1", "copy/src1").select("path", "cid")


@query("SELECT path, 'file' AS kind FROM f UNION ALL SELECT DISTINCT 'inbox/' || lang, 'dir' FROM f UNION ALL SELECT 'inbox', 'dir'")
def q_mkdir(spark, sf):
    wanted = files(spark, sf).select(F.concat(F.lit("inbox/"), "lang").alias("path")).distinct()
    return tree.mkdir(_nodes(spark, sf), wanted).select("path", "kind")


@query("""SELECT path, CASE WHEN doc_id IN (SELECT doc_id FROM d) THEN 'symlink' ELSE 'file' END AS kind,
CASE WHEN doc_id IN (SELECT doc_id FROM d) THEN 'store/' || cid END AS symlink_target FROM f""")
def q_symlink(spark, sf):
    links = on_disk(spark, sf).select("path", F.concat(F.lit("store/"), "cid").alias("symlink_target"))
    return tree.symlink(_nodes(spark, sf), links).select("path", "kind", "symlink_target")


@query("""SELECT path, 'file' AS kind, len AS size FROM f UNION ALL SELECT 'bench/' || CAST(item_id AS VARCHAR) || '.md', 'file', CAST(octet_length(encode(text)) AS BIGINT) FROM benchmark
UNION ALL SELECT 'bench', 'dir', 0 FROM (SELECT count(*) AS n FROM benchmark) t WHERE n > 0""")
def q_write(spark, sf):
    new = read_table(spark, sf, "benchmark").select(F.concat(F.lit("bench/"), F.col("item_id").cast("string"), F.lit(".md")).alias("path"), C.cid_hex(F.col("text")).alias("cid"), C.byte_size(F.col("text")).alias("size"))
    return tree.write(_nodes(spark, sf), new).select("path", "kind", "size")


@query("SELECT path, CAST(octet_length(encode(text)) AS BIGINT) AS size, md5(text) AS digest FROM f JOIN documents USING (doc_id)")
def q_read(spark, sf):
    rows = files(spark, sf, content=True)
    blocks = rows.select("cid", F.col("text").alias("content"))
    part = rows.join(read_table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("cid", F.col("text").alias("content"))
    return tree.read(rows, part, blocks).select("path", C.byte_size(F.col("bytes")).alias("size"), F.md5(F.col("bytes").cast("binary")).alias("digest"))


@query("""SELECT page_id, CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'html' THEN 'text/html' WHEN 'json' THEN 'application/json' WHEN 'md' THEN 'text/markdown' ELSE 'application/octet-stream' END AS mime_type
FROM (SELECT page_id, CAST(page_id AS VARCHAR) || CASE WHEN contains(url, '?') THEN '.json' WHEN contains(url, '#') THEN '.md' WHEN contains(url, 'example.com') THEN '.HTML' ELSE '' END AS path FROM pages) t""")
def q_mime(spark, sf):
    url = F.col("url")
    ext = F.when(F.contains(url, F.lit("?")), ".json").when(F.contains(url, F.lit("#")), ".md").when(F.contains(url, F.lit("example.com")), ".HTML").otherwise("")
    return read_table(spark, sf, "pages").select("page_id", C.mime_type(F.concat(F.col("page_id").cast("string"), ext)).alias("mime_type"))


# usage


@query("SELECT source, lang, CAST(sum(len) AS BIGINT) AS bytes, count(*) AS n_files FROM f GROUP BY ROLLUP (source, lang)")
def q_usage(spark, sf):
    return catalog.usage(files(spark, sf), "source", "lang")


# versions, snapshots, reconciliation

_LOCAL = """SELECT s_suppkey AS drive, arg_max(event_id, row(ts, event_id)) FILTER (event_type IN ('view', 'purchase')) AS metadata,
  arg_max(value, row(ts, event_id)) FILTER (event_type = 'view') AS root FROM supplier LEFT JOIN events ON user_id = s_suppkey GROUP BY s_suppkey"""
_REMOTE = "SELECT user_id AS drive, arg_max(event_id, row(ts, event_id)) AS metadata, arg_max(value, row(ts, event_id)) AS root FROM events GROUP BY user_id"


def _local(spark, sf):
    """Suppliers have local drives: their metadata is their user's last view or purchase, their content the last view."""
    v = version_rows(spark, sf)
    at = F.struct("ts", "metadata")
    seen = v.groupBy("drive").agg(F.max_by("metadata", F.when(F.col("kind").isin("view", "purchase"), at)).alias("metadata"), F.max_by("root", F.when(F.col("kind") == "view", at)).alias("root"))
    return read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("drive")).join(seen, "drive", "left")


def _remote(spark, sf):
    return versions.current(version_rows(spark, sf), ["ts", "metadata"], ["metadata", "root"])


@query("SELECT user_id AS drive, event_id AS metadata, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events")
def q_prev(spark, sf):
    return versions.previous(version_rows(spark, sf), ["ts", "metadata"], "metadata", F.date_trunc("day", "ts")).select("drive", "metadata", "previous")


@query("SELECT user_id AS drive, arg_max(event_id, row(ts, event_id)) AS metadata, arg_max(value, row(ts, event_id)) AS root, count(*) AS n_versions FROM events GROUP BY user_id")
def q_current(spark, sf):
    return _remote(spark, sf)


@query("SELECT user_id AS drive, arg_min(event_id, row(ts, event_id)) AS metadata FROM events GROUP BY user_id")
def q_original(spark, sf):
    return versions.original(version_rows(spark, sf), ["ts", "metadata"], ["metadata"])


@query("""WITH RECURSIVE p AS (SELECT event_id AS id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events),
w AS (SELECT id, id AS original, CAST(0 AS BIGINT) AS depth FROM p WHERE previous IS NULL
      UNION ALL SELECT p.id, w.original, w.depth + 1 FROM p JOIN w ON p.previous = w.id)
SELECT id, original, depth FROM w""")
def q_history(spark, sf):
    chain = versions.previous(version_rows(spark, sf), ["ts", "metadata"], "metadata", F.date_trunc("day", "ts"))
    return versions.history(chain.select(F.col("metadata").alias("id"), "previous"))


_STATE = f"""SELECT coalesce(l.drive, r.drive) AS drive, l.metadata AS local_metadata, r.metadata AS remote_metadata,
  CASE WHEN r.metadata IS NULL THEN 'unpublished' WHEN l.drive IS NULL THEN 'unlocalized'
       WHEN l.metadata = r.metadata AND l.root = r.root THEN 'all_synced' WHEN l.metadata = r.metadata THEN 'metadata_synced'
       WHEN EXISTS (SELECT 1 FROM events e WHERE e.user_id = l.drive AND e.event_id = l.metadata) THEN 'behind' ELSE 'ahead' END AS state
FROM ({_LOCAL}) l FULL JOIN ({_REMOTE}) r ON l.drive = r.drive"""


@query(_STATE)
def q_sync_state(spark, sf):
    return versions.reconcile(_local(spark, sf), _remote(spark, sf), version_rows(spark, sf))


@query(f"SELECT state, count(*) AS n FROM ({_STATE}) s GROUP BY state")
def q_sync_summary(spark, sf):
    return q_sync_state(spark, sf).groupBy("state").agg(F.count("*").alias("n"))


@query("""SELECT l.c_custkey AS local_id, coalesce(l.remote_id, r.user_id) AS remote_id, coalesce('user' || CAST(r.user_id AS VARCHAR), l.c_name) AS name,
  CASE WHEN l.c_custkey IS NULL THEN 'remote' WHEN r.user_id IS NULL THEN 'local' ELSE 'both' END AS side
FROM (SELECT c_custkey, c_name, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_custkey END AS remote_id FROM customer) l
FULL JOIN (SELECT DISTINCT user_id FROM events) r ON l.remote_id = r.user_id""")
def q_drive_ls(spark, sf):
    """Customers have local drives; those in machinery never published theirs."""
    local = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("local_id"), F.col("c_name").alias("name"), F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_custkey")).alias("remote_id"))
    remote = read_table(spark, sf, "events").select(F.col("user_id").alias("id")).distinct().withColumn("name", F.concat(F.lit("user"), F.col("id").cast("string")))
    return catalog.omni(local, remote)


@query("SELECT cid FROM f UNION SELECT '01551220' || sha256(text) FROM benchmark")
def q_snapshot_cids(spark, sf):
    return versions.snapshot_cids(files(spark, sf), read_table(spark, sf, "benchmark").select(C.cid_hex(F.col("text")).alias("cid")))


@query("SELECT source AS drive, count(DISTINCT cid) AS n_cids, CAST(sum(len) AS BIGINT) AS size FROM (SELECT DISTINCT source, cid, len FROM f) t GROUP BY source")
def q_snapshot_sizes(spark, sf):
    live = files(spark, sf).select("source", "cid", "len").distinct()
    return live.groupBy(F.col("source").alias("drive")).agg(F.count("cid").alias("n_cids"), F.sum("len").alias("size"))


@query("""SELECT user_id AS drive, event_id AS id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 THEN 'current' ELSE 'outdated' END AS state FROM events""")
def q_push(spark, sf):
    """The last version of each drive is pushed onto the others, which were current in their time."""
    v = version_rows(spark, sf).select("drive", F.col("metadata").alias("id"))
    last = _remote(spark, sf).select("drive", F.col("metadata").alias("id"))
    old = v.join(last, ["drive", "id"], "left_anti").withColumn("state", F.lit("current"))
    return versions.push(old, last.withColumn("state", F.lit("uploading"))).select("drive", "id", "state")


# sharing


@query("""SELECT doc_id, translate(to_base64(encode('{"payload":"' || cid || '","forest_cid":"' || source || '","file_name":"' || CAST(doc_id AS VARCHAR) || '.txt","mime_type":"text/plain","size":' || CAST(len AS VARCHAR) || '}')), '+/', '-_') AS token FROM f""")
def q_share_token(spark, sf):
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    return files(spark, sf).select("doc_id", sharing.token(F.col("cid"), F.col("source"), name, C.mime_type(name), F.col("len")).alias("token"))


@query("SELECT doc_id, cid AS payload, CAST(doc_id AS VARCHAR) || '.txt' AS file_name, len AS size FROM f")
def q_share_receive(spark, sf):
    return q_share_token(spark, sf).withColumn("t", sharing.read_token(F.col("token"))).select("doc_id", "t.payload", "t.file_name", "t.size")


@query("SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) AS keys, count(DISTINCT role) AS n_keys FROM conversations GROUP BY conv_id")
def q_share_map(spark, sf):
    return sharing.key_list(read_table(spark, sf, "conversations"), "conv_id", "role")


_KEYS = "SELECT DISTINCT conv_id AS drive, sha256(role) AS fingerprint, role AS der FROM conversations"


@query(f"""SELECT drive, ref_kind, fingerprint, CASE WHEN ref_kind = 'current' THEN 'ref2' ELSE 'ref1' END AS enc_ref
FROM ({_KEYS}) k CROSS JOIN (SELECT unnest(['original', 'current']) AS ref_kind) t""")
def q_share_update(spark, sf):
    """Roles become recipients of their conversation's refs; then every current ref is renewed."""
    keys = read_table(spark, sf, "conversations").select(F.col("conv_id").alias("drive"), C.fingerprint(F.col("role")).alias("fingerprint"), F.col("role").alias("der")).distinct()
    drives = keys.select("drive").distinct()
    refs = drives.withColumn("ref_kind", F.explode(F.array(F.lit("original"), F.lit("current")))).withColumn("enc_ref", F.lit("ref1"))
    empty = spark.createDataFrame([], f"drive {keys.schema['drive'].dataType.simpleString()}, ref_kind string, fingerprint string, der string, enc_ref string")
    shares = sharing.add_recipient(empty, keys, refs)
    return sharing.update_ref(shares, drives.withColumn("enc_ref", F.lit("ref2"))).select("drive", "ref_kind", "fingerprint", "enc_ref")


@query("""SELECT event_id, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'error' THEN 'upload_failed' WHEN 'click' THEN 'uploading' WHEN 'view' THEN 'current' WHEN 'purchase' THEN 'outdated' END AS state FROM events""")
def q_enum_parse(spark, sf):
    from cairn.schemas import METADATA_STATES

    name = F.element_at(F.create_map(*[F.lit(x) for x in ("signup", "PENDING", "error", "Upload_Failed", "click", "uploading", "view", "Current", "purchase", "outdated")]), F.col("event_type"))
    return read_table(spark, sf, "events").select("event_id", C.parse_enum(name, METADATA_STATES, "metadata state").alias("state"))


# without SQL: codecs and sources


@query()
def r_cid_text(spark, sf):
    """base32 text of each CID, and whether it parses back."""
    rows = files(spark, sf).withColumn("raw", F.unhex("cid")).withColumn("text_cid", C.cid_text("raw"))
    return rows.select("doc_id", "text_cid", (C.cid_parse("text_cid") == F.col("raw")).alias("same"))


@query()
def r_lz4(spark, sf):
    rows = read_table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw")).withColumn("packed", C.lz4_compress("raw"))
    return rows.select("doc_id", C.byte_size(F.col("packed")).alias("packed_len"), (C.lz4_decompress("packed") == F.col("raw")).alias("same"))


@query()
def r_blake3(spark, sf):
    """BLAKE3 of the bytes of each archive (header, blocks, index), as an upload records it."""
    rows = files(spark, sf, content=True).filter("text IS NOT NULL").withColumn("content", F.encode("text", "UTF-8")).drop("text")
    parts = store.archive_parts(store.layout(rows, "delta", "doc_id"))
    return store.digests(parts, "delta").select("delta", F.hex("digest").alias("digest"))


@query()
def r_car(spark, sf):
    """Documents written as archives and read back: each content, its length, and whether it is what its CID says."""
    register(spark)
    path = Scratch(spark, "car").path("archives")
    rows = read_table(spark, sf, "documents").filter("text IS NOT NULL")
    rows.select(F.encode("text", "UTF-8").alias("content")).write.format("car").mode("append").save(path)
    back = spark.read.format("car").load(path)
    return back.groupBy("cid").agg(F.min("length").alias("length"), F.bool_and(C.cid_binary(F.col("content")) == F.col("cid")).alias("same"))
