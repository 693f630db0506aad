"""Tree operations on a catalog of nodes (path, kind, cid, size, symlink_target), a row for each file, link or directory.

A subtree is a path prefix, so moves, copies and removals are filters and projections without a shuffle; only
checks for presence join, on whole paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.errors import CairnError, NodeNotFound
from cairn.functions.columns import mime_type, parent, segments, under


def _require(nodes: DataFrame, path: str) -> None:
    if nodes.filter(under(F.col("path"), path)).limit(1).isEmpty():
        raise NodeNotFound(path)


def ls(nodes: DataFrame, path: str = "") -> DataFrame:
    """One level: name, whether it is a directory, number of files and bytes below it."""
    depth = len([s for s in path.split("/") if s])
    parts = segments(F.col("path"))
    below = nodes.filter(under(F.col("path"), path) & (F.size(parts) > depth))
    below = below.select(F.element_at(parts, depth + 1).alias("name"), ((F.size(parts) > depth + 1) | (F.col("kind") == "dir")).alias("dir"), "size", "kind")
    return below.groupBy("name").agg(
        F.when(F.max("dir"), "dir").otherwise(F.min("kind")).alias("kind"),
        F.sum(F.when(F.col("kind") == "dir", 0).otherwise(1)).cast("long").alias("n_files"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"),
    )


def tree(nodes: DataFrame, path: str = "", with_dirs: bool = True) -> DataFrame:
    """All descendants with their depth below path."""
    depth = len([s for s in path.split("/") if s])
    out = nodes.filter(under(F.col("path"), path) & (F.col("path") != path.strip("/")))
    out = out if with_dirs else out.filter("kind <> 'dir'")
    return out.withColumn("depth", F.size(segments(F.col("path"))) - depth)


def get(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.filter(F.col("path") == path.strip("/"))


def ancestors(paths: DataFrame) -> DataFrame:
    """Distinct proper ancestors of paths, as directory rows."""
    parts = segments(F.col("path"))
    every = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return paths.filter(F.size(parts) > 1).select(F.explode(every).alias("path")).distinct()


def directories(nodes: DataFrame) -> DataFrame:
    """All directories, those with a row and those that a deeper path implies."""
    return nodes.filter("kind = 'dir'").select("path").unionByName(ancestors(nodes)).distinct()


def _as_nodes(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    have = set(rows.columns)
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in nodes.schema.fields])


def mkdir(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """The catalog with directories paths (path) and their ancestors; those that are there stay as they are."""
    want = paths.select("path").unionByName(ancestors(paths)).distinct().join(nodes.select("path"), "path", "left_anti")
    return nodes.unionByName(_as_nodes(want.withColumn("kind", F.lit("dir")).withColumn("size", F.lit(0)), nodes))


def _moved(path: str, src: str, dst: str):
    return F.concat(F.lit(dst.strip("/")), F.substr(F.col(path), F.lit(len(src.strip("/")) + 1)))


def mv(nodes: DataFrame, src: str, dst: str, check: bool = False) -> DataFrame:
    """The catalog with subtree src at dst; what was there goes, and a place below src itself is an error. With check, a
    source that isn't there is an error at once."""
    if dst.strip("/").startswith(f"{src.strip('/')}/"):
        raise CairnError(f"{src} can't be moved below itself")
    if check:
        _require(nodes, src)
    moves = under(F.col("path"), src)
    return nodes.filter(moves | ~under(F.col("path"), dst)).withColumn("path", F.when(moves, _moved("path", src, dst)).otherwise(F.col("path")))


def cp(nodes: DataFrame, src: str, dst: str, check: bool = False) -> DataFrame:
    """The catalog with links to src's contents below dst; no content is copied."""
    if check:
        _require(nodes, src)
    copies = nodes.filter(under(F.col("path"), src)).withColumn("path", _moved("path", src, dst))
    return nodes.filter(~under(F.col("path"), dst)).unionByName(copies)


def rm(nodes: DataFrame, path: str, check: bool = False) -> DataFrame:
    if check:
        _require(nodes, path)
    return nodes.filter(~under(F.col("path"), path))


def symlink(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The catalog with links (path, symlink_target); what was at their paths goes."""
    rest = nodes.join(links.select("path"), "path", "left_anti").select(*nodes.columns)
    return rest.unionByName(_as_nodes(links.withColumn("kind", F.lit("symlink")).withColumn("size", F.lit(0)), nodes))


def write(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """The catalog with files (path, cid, size); media types follow from the paths and parents are made."""
    files = files.withColumn("kind", F.lit("file")).withColumn("mime_type", mime_type(F.col("path")))
    rest = nodes.join(files.select("path"), "path", "left_anti").select(*nodes.columns)
    return mkdir(rest.unionByName(_as_nodes(files, nodes)), ancestors(files))


def read(nodes: DataFrame, content: DataFrame, metadata: DataFrame) -> DataFrame:
    """(path, bytes) of files: from the content store, else from the metadata store (each cid, content).

    Of the second store only what the first lacks is moved, and of either only what a file asks for. Archives are read by
    offset instead (pipelines.contents)."""
    files = nodes.filter("kind = 'file'").select("path", "cid")
    wanted = files.select("cid").distinct()
    first = content.select("cid", "content").join(wanted, "cid", "left_semi")
    second = metadata.select("cid", "content").join(wanted.join(content.select("cid"), "cid", "left_anti"), "cid", "left_semi")
    bodies = first.unionByName(second).dropDuplicates(["cid"])
    return files.join(bodies, "cid", "left").select("path", F.col("content").alias("bytes"))


def by_parent(nodes: DataFrame) -> DataFrame:
    """Files and bytes right in each directory."""
    return nodes.filter("kind = 'file'").groupBy(parent(F.col("path")).alias("dir")).agg(F.count("*").alias("n_files"), F.sum("size").cast("long").alias("bytes"))
