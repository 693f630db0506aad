"""Shared helpers of the training-data operators: hash folds and bounded labelled samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.session import Scratch, read_table, shared_dir, small_batches

__all__ = ["Scratch", "fold", "hash_sample", "labelled", "one_of_id", "read_table", "shared_dir", "small_batches"]


def fold(col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def hash_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """At most n rows, chosen by a hash of key: the same rows at every run and on every cluster."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def labelled(docs: DataFrame, labels: DataFrame, n: int, seed: int, keep: Callable | None = None) -> DataFrame:
    """Whole texts of the rows of at most n labelled ids; of an id's labels the largest counts. The sample is drawn from the
    small label table, so what is broadcast to the scan of the documents has n rows at most, whatever the input's size.
    Where documents repeat an id all its rows come: one_of_id() leaves one of them, when they are small."""
    rows = labels if keep is None else labels.filter(keep)
    value = [c for c in labels.columns if c != "doc_id"]
    sample = hash_sample(rows.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in value]), "doc_id", n, seed)
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")


def one_of_id(rows: DataFrame) -> DataFrame:
    """One row of each doc_id, the smallest by its other columns, by map-side minima."""
    rest = [c for c in rows.columns if c != "doc_id"]
    return rows.groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("r")).select("doc_id", *[F.col(f"r.{c}").alias(c) for c in rest])
