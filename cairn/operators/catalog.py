"""Drives, keys and usage: the control plane as catalog tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.errors import InvalidSpecifier, NotUnique
from cairn.functions.columns import human_bytes, parse_enum
from cairn.schemas import DRIVE_TYPES, STORAGE_CLASSES


def specifier(*, id: str | None = None, name: str | None = None, origin: str | None = None) -> dict[str, str]:
    """Exactly one way to name a drive."""
    given = {k: v for k, v in (("id", id), ("name", name), ("origin", origin)) if v is not None}
    if len(given) != 1:
        raise InvalidSpecifier("give one of id, name and origin")
    return given


def find(drives: DataFrame, given: dict[str, str], order: str) -> DataFrame:
    """The first drive, in order, that a specifier names; nulls never match."""
    have = [F.col(k) == v for k, v in given.items() if k in drives.columns]
    if not have:
        raise InvalidSpecifier(f"drives have no {', '.join(given)}")
    return drives.filter(reduce(lambda a, b: a | b, have)).orderBy(order).limit(1)


def create(drives: DataFrame, new: DataFrame, key: str) -> DataFrame:
    if not new.join(drives.select(key), key, "left_semi").isEmpty():
        raise NotUnique(f"a drive of this {key} is there already")
    return drives.unionByName(new.select(*drives.columns))


def update(drives: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new replace those of the same key, and are added where there is none."""
    return drives.join(new.select(key), key, "left_anti").select(*drives.columns).unionByName(new.select(*drives.columns))


def delete(drives: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return drives.join(gone.select(key), key, "left_anti").select(*drives.columns)


def omni(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local and remote drives side by side; local ones without a remote id keep a row each."""
    mine = local.select("local_id", "remote_id", F.col("name").alias("local_name"))
    theirs = remote.select(F.col("id").alias("remote_id"), F.col("name").alias("remote_name"))
    out = mine.join(theirs, "remote_id", "full_outer")
    where = F.when(F.col("local_id").isNull(), "remote").when(F.col("remote_name").isNull(), "local").otherwise("both")
    return out.select("local_id", "remote_id", F.coalesce("remote_name", "local_name").alias("name"), where.alias("side"))


def valid_drives(drives: DataFrame) -> DataFrame:
    kind = parse_enum(F.col("type"), DRIVE_TYPES, "drive type")
    return drives.withColumn("type", kind).withColumn("storage_class", parse_enum(F.col("storage_class"), STORAGE_CLASSES, "storage class"))


def of_drive(answers: DataFrame, drive: Column, sizes: list[str]) -> DataFrame:
    """A remote's answers (versions, snapshots, keys) as rows of a drive; a size that is missing is 0."""
    return answers.select(drive.alias("drive"), *[F.coalesce(c, F.lit(0)).alias(c) if c in sizes else F.col(c) for c in answers.columns])


def approve(keys: DataFrame, fingerprint: str, approved: bool = True) -> DataFrame:
    """An approved key; a rejected one goes."""
    if not approved:
        return keys.filter(F.col("fingerprint") != fingerprint)
    return keys.withColumn("approved", F.col("approved") | (F.col("fingerprint") == fingerprint))


def label_keys(keys: DataFrame, mine: str) -> DataFrame:
    return keys.withColumn("is_mine", F.col("fingerprint") == mine)


def usage(files: DataFrame, *by: str) -> DataFrame:
    """Bytes and files by drive and above, to the whole account."""
    total = files.rollup(*by).agg(F.sum("len").cast("long").alias("bytes"), F.count("*").alias("n_files"))
    return total


def usage_text(files: DataFrame, limit: int) -> DataFrame:
    """Usage of the account, its limit, and both for people."""
    total = files.agg(F.coalesce(F.sum("len"), F.lit(0)).cast("long").alias("bytes")).withColumn("limit", F.lit(limit).cast("long"))
    return total.withColumn("text", F.concat(human_bytes(F.col("bytes")), F.lit(" of "), human_bytes(F.col("limit"))))
