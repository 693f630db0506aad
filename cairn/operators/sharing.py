"""Share maps (drive, ref_kind, fingerprint, der, enc_ref) and share tokens. Keys and encrypted refs are opaque text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.errors import CairnError, NodeNotFound, Unauthorized
from cairn.functions.columns import base64_url, unbase64_url

TOKEN = "payload string, forest_cid string, file_name string, mime_type string, size bigint"


def token(payload: Column, forest_cid: Column, file_name: Column, mime: Column, size: Column) -> Column:
    """URL-safe token of one shared file."""
    body = F.struct(payload.alias("payload"), forest_cid.alias("forest_cid"), file_name.alias("file_name"), mime.alias("mime_type"), size.cast("long").alias("size"))
    return base64_url(F.to_json(body).cast("binary"))


def read_token(value: Column) -> Column:
    return F.from_json(unbase64_url(value).cast("string"), TOKEN)


def receive(tokens: DataFrame, blocks: DataFrame) -> DataFrame:
    """Shared files with the content that their token names."""
    read = tokens.withColumn("t", read_token(F.col("token")))
    return read.join(blocks.select(F.col("cid").alias("payload"), "content"), read["t.payload"] == F.col("payload"), "left").select("token", "t.file_name", "t.mime_type", "t.size", "content")


def add_recipient(shares: DataFrame, keys: DataFrame, refs: DataFrame) -> DataFrame:
    """The map with the keys (drive, fingerprint, der) as recipients of both refs (drive, ref_kind, enc_ref); where a
    drive has no ref yet it is the empty text. A recipient that is there stays as it is."""
    kinds = keys.withColumn("ref_kind", F.explode(F.array(F.lit("original"), F.lit("current"))))
    new = kinds.join(refs, ["drive", "ref_kind"], "left").withColumn("enc_ref", F.coalesce("enc_ref", F.lit("")))
    new = new.join(shares.select("drive", "ref_kind", "fingerprint"), ["drive", "ref_kind", "fingerprint"], "left_anti")
    return shares.unionByName(new.select(*shares.columns))


def update_ref(shares: DataFrame, refs: DataFrame) -> DataFrame:
    """The map with a new current ref for every recipient; the original one is set only if it was empty."""
    new = refs.select("drive", F.col("enc_ref").alias("__ref"))
    out = shares.join(new, "drive", "left")
    takes = F.col("__ref").isNotNull() & ((F.col("ref_kind") == "current") | (F.col("enc_ref") == ""))
    return out.withColumn("enc_ref", F.when(takes, F.col("__ref")).otherwise(F.col("enc_ref"))).select(*shares.columns)


def key_list(shares: DataFrame, by: str, key: str) -> DataFrame:
    """Sorted distinct keys of each map, in one text; a map's distinct keys are few."""
    return shares.groupBy(by).agg(F.array_join(F.array_sort(F.collect_set(key)), ",").alias("keys"), F.count_distinct(key).alias("n_keys"))


def unlock(shares: DataFrame, fingerprint: str) -> DataFrame:
    """The refs that a key may open; none is an authorization error for the caller to raise."""
    return shares.filter(F.col("fingerprint") == fingerprint).select("drive", "ref_kind", "enc_ref")


def open_share(shares: DataFrame, fingerprint: str) -> DataFrame:
    """unlock(), where a key without any ref is an error."""
    refs = unlock(shares, fingerprint)
    if refs.isEmpty():
        raise Unauthorized(fingerprint)
    return refs


def share_file(nodes: DataFrame, path: str, forest_cid: str) -> str:
    """The token of one file; directories can't be shared."""
    row = nodes.filter(F.col("path") == path.strip("/")).limit(1)
    name = F.element_at(F.split("path", "/"), -1)
    got = row.select("kind", token(F.col("cid"), F.lit(forest_cid), name, F.col("mime_type"), F.col("size")).alias("token")).head()
    if got is None:
        raise NodeNotFound(path)
    if got["kind"] != "file":
        raise CairnError(f"{path} is no file")
    return got["token"]


def to_map(shares: DataFrame) -> DataFrame:
    """Shares as a map for each drive and kind of ref: fingerprint -> (der, enc_ref). A drive's recipients are few."""
    entry = F.struct("fingerprint", F.struct("der", "enc_ref"))
    return shares.groupBy("drive", "ref_kind").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("recipients"))


def from_map(maps: DataFrame) -> DataFrame:
    return maps.select("drive", "ref_kind", F.explode("recipients").alias("fingerprint", "r")).select("drive", "ref_kind", "fingerprint", "r.der", "r.enc_ref")
