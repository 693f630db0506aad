"""Data source `fstree`: a directory tree as rows, hidden files, empty directories and symlinks included.

Links are never followed. Option `content=true` reads file bodies, `hash=true` gives their CIDs, read in pieces. Directories are opened level by level until there are
LEAST_ENTRIES subtrees, which are dealt to at most MOST_PARTITIONS partitions. The writer puts
rows (path, kind, content, symlink_target) back on disk: parents first, links last, in the commit.
"""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from cairn.errors import CairnError, MissingBlock
from cairn.functions import codec
from cairn.schemas import SCAN
from cairn.session import Scratch, task_count


PIECE = 4 << 20
LEAST_ENTRIES, MOST_PARTITIONS = 64, 256


@dataclass
class Entry(InputPartition):
    opened: list[str]
    subtrees: list[str]


def _time(t: float) -> datetime:
    return datetime.fromtimestamp(t, UTC)


class TreeReader(DataSourceReader):
    def __init__(self, root: str, content: bool, hashed: bool = False):
        self.root, self.content, self.hashed = local(root), content, hashed

    def partitions(self) -> list[InputPartition]:
        opened: list[str] = []
        subtrees = sorted(os.listdir(self.root))
        while len(subtrees) < LEAST_ENTRIES and (dirs := [p for p in subtrees if self._is_dir(p)]):
            opened += dirs
            rest = [p for p in subtrees if not self._is_dir(p)]
            subtrees = rest + [f"{d}/{n}" for d in dirs for n in sorted(os.listdir(os.path.join(self.root, d)))]
        n = min(MOST_PARTITIONS, max(1, len(subtrees)))
        return [Entry(opened[i::n], subtrees[i::n]) for i in range(n)]

    def _is_dir(self, path: str) -> bool:
        full = os.path.join(self.root, path)
        return os.path.isdir(full) and not os.path.islink(full)

    def read(self, partition: Entry) -> Iterator[tuple]:
        for path in partition.opened:
            yield self._row(path)
        for path in partition.subtrees:
            yield from self._walk(path)

    def _walk(self, path: str) -> Iterator[tuple]:
        left = [path]
        while left:
            path = left.pop()
            yield self._row(path)
            if self._is_dir(path):
                left += [f"{path}/{name}" for name in sorted(os.listdir(os.path.join(self.root, path)), reverse=True)]

    def _row(self, path: str) -> tuple:
        full = os.path.join(self.root, path)
        s = os.lstat(full)
        kind = "symlink" if stat.S_ISLNK(s.st_mode) else "dir" if stat.S_ISDIR(s.st_mode) else "file"
        target = relative_target(self.root, full) if kind == "symlink" else None
        body = None
        if self.content and kind == "file":
            with open(full, "rb") as f:
                body = f.read()
        cid = cid_of(full) if self.hashed and kind == "file" else None
        canonical = full if kind == "symlink" else os.path.realpath(full)
        return path, canonical, kind, s.st_size if kind == "file" else 0, _time(s.st_mtime), _time(s.st_atime), _time(s.st_ctime), target, body, cid


def local(path: str) -> str:
    """The path of a folder that all executors mount."""
    if "://" in path and not path.startswith("file://"):
        raise CairnError(f"{path} is no folder that is mounted")
    return os.path.abspath(path.removeprefix("file://").removeprefix("file:"))


def cid_of(full: str) -> str:
    """CID of a file's bytes, which are read in pieces."""
    digest = hashlib.sha256()
    with open(full, "rb") as f:
        while piece := f.read(PIECE):
            digest.update(piece)
    return codec.cid_v1(digest.digest()).hex()


ENTRY = SCAN.names[:-2]


def walk(spark: SparkSession, root: str, scratch: Scratch) -> DataFrame:
    """All entries below a root without content and cid, level by level: each level's directories are listed by as many
    tasks, so neither a deep subtree nor the driver holds the others up."""
    root = local(root)
    reader, schema = TreeReader(root, False), StructType(SCAN.fields[:-2])

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                names = sorted(os.listdir(os.path.join(root, path)))
                for i in range(0, len(names), 10_000):
                    rows = [reader._row(f"{path}/{n}" if path else n)[:-2] for n in names[i : i + 10_000]]
                    yield pd.DataFrame(rows, columns=ENTRY)

    level, found, depth = spark.createDataFrame([("",)], "path string"), None, 0
    while found is None or not level.isEmpty():
        entries = scratch.write(level.repartition(task_count(spark) if depth else 1, "path").mapInPandas(listed, schema), f"level-{depth}")
        found = entries if found is None else found.unionByName(entries)
        level, depth = entries.filter("kind = 'dir'").select("path"), depth + 1
    return found


def hashed(entries: DataFrame, root: str) -> DataFrame:
    """The entries with the cid of each file, file by file in as many tasks."""
    root = local(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(cid=[cid_of(os.path.join(root, p)) if k == "file" else None for p, k in zip(pdf["path"], pdf["kind"], strict=True)])

    dealt = entries.repartition(task_count(entries.sparkSession), "path")
    return dealt.mapInPandas(run, StructType([*entries.schema.fields, SCAN["cid"]]))


def bodies(files: DataFrame, root: str) -> DataFrame:
    """(cid, content) of files (path, cid) below a root; a file that isn't what its cid says any more is an error."""
    root = local(root)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, cid in zip(pdf["path"], pdf["cid"], strict=True):
                with open(os.path.join(root, path), "rb") as f:
                    body = f.read()
                if codec.make_cid(body).hex() != cid:
                    raise CairnError(f"{path} has changed while it was read")
                yield pd.DataFrame({"cid": [cid], "content": [body]})

    dealt = files.select("path", "cid").repartition(task_count(files.sparkSession), "path")
    return dealt.mapInPandas(read, "cid string, content binary")


def relative_target(root: str, link: str) -> str:
    """A link's target without the components that it shares with the tree's root."""
    target = os.readlink(link)
    if not os.path.isabs(target):
        return target
    have, base = target.split(os.sep), root.split(os.sep)
    while have and base and have[0] == base[0]:
        have, base = have[1:], base[1:]
    return "/".join(have)


@dataclass
class Restored(WriterCommitMessage):
    links: list[tuple[str, str]] = field(default_factory=list)


class TreeWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root = local(root)

    def _full(self, path: str) -> str:
        full = os.path.normpath(os.path.join(self.root, path))
        if not full.startswith(self.root + os.sep):
            raise CairnError(f"{path} leads out of the tree")
        return full

    def write(self, rows: Iterator) -> Restored:
        links = []
        for r in rows:
            full = self._full(r["path"])
            if r["kind"] == "dir":
                os.makedirs(full, exist_ok=True)
            elif r["kind"] == "symlink":
                links.append((r["path"], r["symlink_target"]))
            else:
                if r["content"] is None:
                    raise MissingBlock(f"{r['path']} has no content")
                os.makedirs(os.path.dirname(full), exist_ok=True)
                part = f"{full}.{os.getpid()}.part"
                with open(part, "wb") as f:
                    f.write(bytes(r["content"]))
                os.replace(part, full)
        return Restored(links)

    def commit(self, messages: list[Restored]) -> None:
        for m in messages:
            for path, target in m.links if m else []:
                full = self._full(path)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                if os.path.lexists(full):
                    os.remove(full)
                inside = os.path.join(self.root, target)
                beside = os.path.join(os.path.dirname(full), target)
                os.symlink(os.path.relpath(inside, os.path.dirname(full)) if os.path.lexists(inside) and not os.path.lexists(beside) else target, full)

    def abort(self, messages: list[Restored]) -> None:
        """Files that were written stay; a restore that is run again replaces them."""


class TreeDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fstree"

    def schema(self) -> StructType:
        return SCAN

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(self.options["path"], self.options.get("content", "false").lower() == "true", self.options.get("hash", "false").lower() == "true")

    def writer(self, schema: StructType, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options["path"])
