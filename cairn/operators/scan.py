"""Scan, grouping of identical content, work plans and the difference to the catalog.

Content is hashed where it is read; what is grouped and joined are hashes and paths. Groups are summed map-side, and
the canonical member is a minimum, so a content that a third of all files share never gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.columns import byte_size, cid_hex


def hashed(files: DataFrame) -> DataFrame:
    """files (path, content) with len and cid instead of the content."""
    return files.withColumn("len", byte_size(F.col("content"))).withColumn("cid", cid_hex(F.col("content"))).drop("content")


def groups(files: DataFrame, order: str = "path") -> DataFrame:
    """Content that several files share: (cid, len, n, canonical)."""
    return files.groupBy("cid", "len").agg(F.count("*").alias("n"), F.min(order).alias("canonical")).filter("n > 1")


def canonical(files: DataFrame, order: str = "path") -> DataFrame:
    """The first file of each content."""
    return files.groupBy("cid").agg(F.min(order).alias(order))


def links(files: DataFrame, order: str = "path") -> DataFrame:
    """The other files of each content with the one they are links to."""
    first = groups(files, order).select("cid", "canonical")
    return files.join(first, "cid").filter(F.col(order) != F.col("canonical"))


def plan(entries: DataFrame, order: str = "path") -> DataFrame:
    """Work plans of scanned entries (path, kind, cid, len, symlink_target): a file group for each content, of one
    member or more, then directories; links come last (phase 1)."""
    files = entries.filter("kind = 'file'")
    grouped = files.groupBy("cid", "len").agg(F.min(order).alias("canonical"), F.count("*").alias("n_members"))
    files_plan = grouped.select(F.lit("file_group").alias("kind"), F.col("canonical").alias(order), "cid", "n_members", F.lit(None).cast("string").alias("symlink_target"))
    rest = entries.filter("kind <> 'file'").select(
        F.when(F.col("kind") == "dir", "directory").otherwise("symlink").alias("kind"), order, F.lit(None).cast("string").alias("cid"), F.lit(1).cast("long").alias("n_members"), "symlink_target"
    )
    return files_plan.unionByName(rest).withColumn("phase", F.when(F.col("kind") == "symlink", 1).otherwise(0))


def members(entries: DataFrame, order: str = "path") -> DataFrame:
    """All disk paths of a plan: each file with its group's canonical path."""
    files = entries.filter("kind = 'file'")
    return files.join(canonical(files, order).withColumnRenamed(order, "canonical"), "cid")


def deleted(nodes: DataFrame, scan: DataFrame) -> DataFrame:
    """Catalog files that are no longer on disk."""
    return nodes.join(scan.select("path"), "path", "left_anti")


def deleted_cids(nodes: DataFrame, scan: DataFrame) -> DataFrame:
    """Contents of deleted files that no file on disk holds any more."""
    return deleted(nodes, scan).select("cid").distinct().join(scan.select("cid").distinct(), "cid", "left_anti")


def changed(nodes: DataFrame, scan: DataFrame) -> DataFrame:
    """Paths whose content differs: replaced contents are recorded too."""
    new = scan.select("path", F.col("cid").alias("new_cid"))
    return nodes.select("path", F.col("cid").alias("old_cid")).join(new, "path").filter("old_cid <> new_cid")


def unchanged(nodes: DataFrame, scan: DataFrame) -> DataFrame:
    """Scanned files that the catalog has with the same content; they need no write."""
    return scan.join(nodes.select("path", "cid"), ["path", "cid"], "left_semi")


def added(nodes: DataFrame, scan: DataFrame) -> DataFrame:
    return scan.join(nodes.select("path"), "path", "left_anti")
