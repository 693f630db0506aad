"""Data source `car`: content archives, one partition for each, and a writer that commits by rename.

Reading: columns (archive, delta, cid, offset, length, content). Option `content=false` skips block bodies and, if the
archive has a stored index, reads that alone. A filter on `cid` is pushed down to a look-up. `skip_corrupt=true` leaves
unreadable archives out. Writing: rows need `content` and may have `cid` and `codec`; each task writes one archive of
distinct blocks under a temporary name and the commit renames them all, as the next deltas of the folder.
"""

from __future__ import annotations

import os
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from io import BytesIO

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from cairn.errors import CodecError
from cairn.functions import blake3, codec
from cairn.operators import store as stores
from cairn.schemas import struct

SCHEMA = struct("archive string, delta int, cid binary, offset long, length long, content binary")
BATCH_BYTES = 8 << 20


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """Any store that Arrow opens; a bare path is a folder that all executors mount."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def archives(path: str) -> list[str]:
    """The archives of a file or folder, in the order of their delta numbers."""
    store, at = filesystem(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [at]
    if info.type == fs.FileType.NotFound:
        return []
    found = [x.path for x in store.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.File and x.path.endswith(".car")]
    return sorted(found, key=lambda p: (delta_of(p), p))


def delta_of(path: str) -> int:
    m = re.search(r"(\d+)\.car$", path)
    return int(m[1]) if m else 0


@dataclass
class OneArchive(InputPartition):
    path: str


class CarReader(DataSourceReader):
    def __init__(self, path: str, options: dict[str, str]):
        self.path = path
        self.content = options.get("content", "true").lower() == "true"
        self.skip_corrupt = options.get("skip_corrupt", "false").lower() == "true"
        self.cid: bytes | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("cid",) and self.cid is None:
                self.cid = bytes(f.value)
            elif not (isinstance(f, IsNotNull) and f.attribute == ("cid",)):  # no block lacks one
                yield f

    def partitions(self) -> list[InputPartition]:
        return [OneArchive(p) for p in archives(self.path)] or [OneArchive("")]

    def read(self, partition: OneArchive) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        try:
            yield from self._batches(partition.path)
        except CodecError:
            if not self.skip_corrupt:
                raise

    def _batches(self, path: str) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(self.path)
        with store.open_input_file(path) as f:
            a = codec.Archive(f)
            rows: list[tuple] = []
            size = 0
            for cid, offset, length, content in self._blocks(a):
                rows.append((path, delta_of(path), cid, offset, length, content))
                size += len(content or b"") + 100
                if size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    def _blocks(self, a: codec.Archive) -> Iterator[tuple[bytes, int, int | None, bytes | None]]:
        stored = a.v2 and a.index_offset
        if self.cid is not None and stored:
            if (at := a.index().get(self.cid)) is not None:
                cid, content = a.get(at)
                yield cid, at, len(content), content if self.content else None
        elif stored and not self.content:
            for cid, at in a.index().items():
                yield cid, at, None, None
        else:
            yield from (x for x in a.scan(self.content) if self.cid is None or x[0] == self.cid)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=SCHEMA.names)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class CarWriter(DataSourceWriter):
    """A task's rows go to archives of at most `max_bytes` (one block more at the most), each held once in memory."""

    def __init__(self, path: str, schema: StructType, overwrite: bool, options: dict[str, str]):
        self.path, self.overwrite, self.names = path, overwrite, schema.names
        self.roots = [bytes.fromhex(r) for r in options.get("roots", "").split(",") if r]
        self.max_bytes = int(options.get("max_bytes", str(64 << 20)))
        if "content" not in self.names:
            raise CodecError("archives are written from a column named content")

    def write(self, rows: Iterator) -> Written:
        store, at = filesystem(self.path)
        store.create_dir(at, recursive=True)
        done: list[str] = []
        buffer, out = BytesIO(), None

        def flush() -> None:
            out.close()
            done.append(f"_{uuid.uuid4().hex}.tmp")
            with store.open_output_stream(posixpath.join(at, done[-1])) as f:
                f.write(buffer.getbuffer())

        for r in rows:
            if out is None:
                buffer = BytesIO()
                out = codec.ArchiveWriter(buffer, self.roots)
            kind = r["codec"] if "codec" in self.names and r["codec"] is not None else codec.RAW
            cid = bytes(r["cid"]) if "cid" in self.names and r["cid"] is not None else None
            out.put(bytes(r["content"]), kind, cid)
            if out.at >= self.max_bytes:
                flush()
                out = None
        if out is not None:
            flush()
        return Written(done)

    def commit(self, messages: list[Written]) -> None:
        store, at = filesystem(self.path)
        have = archives(self.path)
        if self.overwrite:
            for p in have:
                store.delete_file(p)
            have = []
        last = max(map(delta_of, have), default=0)
        for i, name in enumerate((n for m in messages if m for n in m.names), start=1):
            store.move(posixpath.join(at, name), posixpath.join(at, f"{last + i}.car"))

    def abort(self, messages: list[Written]) -> None:
        store, at = filesystem(self.path)
        for name in (n for m in messages if m for n in m.names):
            store.delete_file(posixpath.join(at, name))


class CarDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "car"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> CarReader:
        return CarReader(self.options["path"], self.options)

    def writer(self, schema: StructType, overwrite: bool) -> CarWriter:
        return CarWriter(self.options["path"], schema, overwrite, self.options)


def digests(spark: SparkSession, path: str, known: set[int] = frozenset()) -> DataFrame:
    """(delta, archive, length, digest) of a folder's archives but the known deltas: BLAKE3 of their bytes, read in parts where they are hashed."""
    store, _ = filesystem(path)
    found = [(p, delta_of(p), store.get_file_info(p).size) for p in archives(path) if delta_of(p) not in known]
    files = spark.createDataFrame(found, "archive string, delta int, size long")
    size = blake3.PART
    parts = files.select("archive", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.greatest("size", F.lit(1)) - 1) / size))).alias("no"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = filesystem(path)
        for pdf in batches:
            for archive, no in pdf.itertuples(index=False):
                with store.open_input_file(archive) as f:
                    f.seek(no * size)
                    yield pd.DataFrame({"archive": [archive], "no": [no], "raw": [f.read(size)]})

    read_parts = parts.repartition("archive", "no").mapInPandas(read, "archive string, no long, raw binary")
    return files.drop("size").join(stores.digests(read_parts, "archive"), "archive").select("delta", "archive", "length", "digest")


def pack(blocks: DataFrame, by: str, roots: list[bytes] | None = None) -> DataFrame:
    """(by, archive): the blocks (by, content) of each group as one archive in memory. For groups that fit one value;
    larger ones are written with the data source, which starts a new archive every max_bytes."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        f = BytesIO()
        w = codec.ArchiveWriter(f, roots)
        for x in pdf["content"]:
            w.put(bytes(x))
        w.close()
        return pd.DataFrame({by: [pdf[by].iloc[0]], "archive": [f.getvalue()]})

    return blocks.select(by, "content").groupBy(by).applyInPandas(one, f"{by} {blocks.schema[by].dataType.simpleString()}, archive binary")


def unpack(archives_: DataFrame, by: str) -> DataFrame:
    """(by, cid, offset, length, content) of the blocks of archives in a column (by, archive)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, raw in zip(pdf[by], pdf["archive"], strict=True):
                found = list(codec.Archive(BytesIO(bytes(raw))).scan())
                yield pd.DataFrame(found, columns=["cid", "offset", "length", "content"]).assign(**{by: key})[[by, "cid", "offset", "length", "content"]]

    schema = f"{by} {archives_.schema[by].dataType.simpleString()}, cid binary, offset long, length long, content binary"
    return archives_.select(by, "archive").mapInPandas(run, schema)


def headers(archives_: DataFrame, by: str) -> DataFrame:
    """(by, version, n_roots, data_offset, data_size, index_offset) of archives in a column (by, archive); 0 for no index."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            opened = [codec.Archive(BytesIO(bytes(raw))) for raw in pdf["archive"]]
            found = [(a.version, len(a.roots), a.start, a.stop - a.start, a.index_offset) for a in opened]
            yield pd.DataFrame(found, columns=["version", "n_roots", "data_offset", "data_size", "index_offset"]).assign(**{by: pdf[by].to_numpy()})

    schema = f"version int, n_roots int, data_offset long, data_size long, index_offset long, {by} {archives_.schema[by].dataType.simpleString()}"
    return archives_.select(by, "archive").mapInPandas(run, schema)
