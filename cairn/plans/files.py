"""The test tables as a file catalog: documents are files, sources are archives (deltas), users' events are versions.

`disk` is the part of the documents that has labels, so that the catalog and the disk differ in a natural way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.columns import byte_size, cid_hex
from cairn.session import Scratch, read_table


def files(spark: SparkSession, sf_dir: str, content: bool = False) -> DataFrame:
    """doc_id, path, kind, delta, len, cid of each document, hashed where it is read."""
    docs = read_table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    delta = F.regexp_extract("source", r"(\d+)$", 1).try_cast("int")
    cols = [F.col("doc_id"), path.alias("path"), F.lit("file").alias("kind"), "source", "lang", delta.alias("delta"), byte_size(F.col("text")).alias("len"), cid_hex(F.col("text")).alias("cid")]
    return docs.select(*cols, *(["text"] if content else []))


def hashed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files() as a table, for queries that use it several times: the contents are read and hashed once."""
    return Scratch(spark, "files").write(files(spark, sf_dir), "files")


def on_disk(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels").select("doc_id")
    return (files(spark, sf_dir) if rows is None else rows).join(labels, "doc_id", "left_semi")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """drive, metadata (event id), root (value), ts, kind."""
    return read_table(spark, sf_dir, "events").select(F.col("user_id").alias("drive"), F.col("event_id").alias("metadata"), F.col("value").alias("root"), "ts", F.col("event_type").alias("kind"))


# the same in DuckDB's SQL
FILES_SQL = """
SELECT doc_id, concat_ws('/', source, lang, CAST(doc_id AS VARCHAR) || '.txt') AS path, source, lang,
       TRY_CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) AS delta,
       CAST(octet_length(encode(text)) AS BIGINT) AS len, '01551220' || sha256(text) AS cid
FROM documents
"""
DISK_SQL = "SELECT * FROM f WHERE doc_id IN (SELECT doc_id FROM labels)"
