"""Block layout, index look-ups and layered stores over tables of blocks (cid, delta, length, ...)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import blake3, codec
from cairn.functions.codec import V2_START
from cairn.functions.columns import block_size

EMPTY_HEADER = 18


def running_start(rows: DataFrame, part: str, order: str, size: Column, alias: str, span: int = 4096) -> DataFrame:
    """Sum of the sizes before each row of its part, in order (an integer column).

    In two levels: sums by ranges of span order values, then within a range. A part of any size is spread over its ranges,
    and the outer window sees a row for each range alone.
    """
    rows = rows.withColumn("__r", F.floor(F.col(order) / span)).withColumn("__s", size.cast("long"))
    sums = rows.groupBy(part, "__r").agg(F.sum("__s").alias("__sum"))
    outer = Window.partitionBy(part).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(part, "__r", F.coalesce(F.sum("__sum").over(outer), F.lit(0)).alias("__base"))
    inner = Window.partitionBy(part, "__r").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum("__s").over(inner), F.lit(0)))
    return rows.join(sums, [part, "__r"]).withColumn(alias, (F.col("__in") + F.col("__base")).cast("long")).drop("__r", "__s", "__in", "__base")


def layout(blocks: DataFrame, part: str = "delta", order: str = "id") -> DataFrame:
    """Offset of each block in its archive, blocks in order and copies included (len: content bytes)."""
    sized = blocks.withColumn("block_len", block_size(F.col("len")))
    out = running_start(sized, part, order, F.col("block_len"), "start")
    return out.withColumn("offset", F.col("start") + F.lit(V2_START + EMPTY_HEADER).cast("long")).drop("start")


def index(placed: DataFrame, part: str = "delta") -> DataFrame:
    """Index of each archive: a content is found at its first block."""
    return placed.groupBy(part, "cid").agg(F.min("offset").alias("offset"))


def headers(placed: DataFrame, part: str = "delta") -> DataFrame:
    """Header of each archive: number of blocks, payload size, where data and index lie."""
    return placed.groupBy(part).agg(
        F.count("*").alias("n_blocks"),
        F.lit(V2_START).cast("long").alias("data_offset"),
        (F.sum("block_len") + EMPTY_HEADER).cast("long").alias("data_size"),
        F.max(F.col("offset") + F.col("block_len")).cast("long").alias("index_offset"),
    )


def _laid_out(kind: str, cid: bytes, content: bytes, x: int, y: int) -> bytes:
    if kind == "block":
        return codec.block(cid, content)
    if kind == "entry":
        return cid + struct.pack("<Q", x)
    if kind == "index":
        return codec.varint(codec.INDEX_SORTED) + struct.pack("<IQ", 44, x)
    return codec.PRAGMA + codec.V2_HEADER.pack(codec.FULLY_INDEXED, V2_START, x, y) + codec.v1_header([], 2)


def archive_parts(placed: DataFrame, part: str = "delta") -> DataFrame:
    """(part column, no, raw): the bytes of each archive that layout() places (cid in hex, content), cut at blake3.PART.

    An index entry's place is its content's rank, a running sum by the first 60 bits of the hashes.
    """
    idx = index(placed, part).withColumn("__o", F.conv(F.substring("cid", 9, 15), 16, 10).cast("long"))
    idx = running_start(idx, part, "__o", F.lit(44), "__at", span=1 << 48)
    heads = headers(placed, part).join(idx.groupBy(part).agg(F.count("*").alias("n")), part)
    none, zero = F.lit(None).cast("binary"), F.lit(0).cast("long")

    def rows(df: DataFrame, kind: str, at: Column, cid: Column = none, content: Column = none, x: Column = zero, y: Column = zero) -> DataFrame:
        return df.select(part, at.cast("long").alias("at"), F.lit(kind).alias("kind"), cid.alias("cid"), content.alias("content"), x.cast("long").alias("x"), y.cast("long").alias("y"))

    raw_cid, end = F.unhex("cid"), F.col("index_offset")
    entries = idx.join(heads.select(part, "index_offset"), part)
    every = rows(placed, "block", F.col("offset"), raw_cid, F.col("content")).unionByName(rows(entries, "entry", end + 14 + F.col("__at"), raw_cid, x=F.col("offset")))
    every = every.unionByName(rows(heads, "index", end, x=F.col("n"))).unionByName(rows(heads, "head", zero, x=F.col("data_size"), y=end))
    size = blake3.PART
    kind = placed.schema[part].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, at, what, cid, content, x, y in pdf.itertuples(index=False):
                raw = _laid_out(what, cid, content, x, y)
                while raw:
                    k = min(len(raw), size - at % size)
                    out.append((key, at // size, at, raw[:k]))
                    raw, at = raw[k:], at + k
            yield pd.DataFrame(out, columns=[part, "no", "at", "raw"])

    def glue(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = b"".join(pdf.sort_values("at")["raw"])
        return pd.DataFrame({part: pdf[part].iloc[:1], "no": pdf["no"].iloc[:1], "raw": [raw]})

    pieces = every.mapInPandas(cut, f"{part} {kind}, no long, at long, raw binary")
    return pieces.groupBy(part, "no").applyInPandas(glue, f"{part} {kind}, no long, raw binary")


def digests(parts: DataFrame, by: str) -> DataFrame:
    """(by, digest, length): BLAKE3 of the bytes whose parts (by, no, raw) are given. A group's list has 72 bytes for each part."""
    kind = parts.schema[by].dataType.simpleString()

    def value(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raws = [bytes(r) for r in pdf["raw"]]
            values = [blake3.part_value(r, int(no)) for r, no in zip(raws, pdf["no"], strict=True)]
            alone = [blake3.whole_value(r) if no == 0 else b"" for r, no in zip(raws, pdf["no"], strict=True)]
            yield pd.DataFrame({by: pdf[by], "no": pdf["no"], "value": values, "alone": alone, "length": [len(r) for r in raws]})

    @F.udf("binary")
    def join(found: list) -> bytes:
        return bytes(found[0]["alone"]) if len(found) == 1 else blake3.join_parts([bytes(x["value"]) for x in found])

    values = parts.select(by, "no", "raw").mapInPandas(value, f"{by} {kind}, no long, value binary, alone binary, length long")
    lists = values.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("no", "value", "alone"))).alias("found"), F.sum("length").alias("length"))
    return lists.select(by, join("found").alias("digest"), "length")


def lookup(requested: DataFrame, idx: DataFrame) -> DataFrame:
    """Requested contents with the number of archives that have them; 0 is a missing block."""
    have = idx.groupBy("cid").agg(F.count("*").alias("n_archives"), F.max("delta").alias("delta"))
    return requested.select("cid").distinct().join(have, "cid", "left").withColumn("n_archives", F.coalesce("n_archives", F.lit(0)).cast("long"))


def missing(requested: DataFrame, idx: DataFrame) -> DataFrame:
    return requested.select("cid").distinct().join(idx.select("cid"), "cid", "left_anti")


def upsert_index(idx: DataFrame, new: DataFrame, seq: str) -> DataFrame:
    """The last entry of each content wins."""
    return idx.unionByName(new).groupBy("cid").agg(F.max_by("offset", seq).alias("offset"), F.max(seq).alias(seq))


def unseen(blocks: DataFrame, store: DataFrame) -> DataFrame:
    """Blocks to be written: each content once and only if the store lacks it."""
    return blocks.dropDuplicates(["cid"]).join(store.select("cid"), "cid", "left_anti")


def newest(blocks: DataFrame, payload: str) -> DataFrame:
    """For each content the newest delta that has it, and what that delta has there (of several, the smallest)."""
    return blocks.groupBy("cid").agg(F.max("delta").alias("delta"), F.max_by(payload, F.struct("delta", -F.col(payload))).alias(payload))


def split_read(requested: DataFrame, primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Where each content is read: the primary store, else the secondary, else nowhere."""
    one = primary.select("cid").distinct().withColumn("__p", F.lit(1))
    two = secondary.select("cid").distinct().withColumn("__s", F.lit(1))
    out = requested.select("cid").distinct().join(one, "cid", "left").join(two, "cid", "left")
    return out.select("cid", F.when(F.col("__p") == 1, "primary").when(F.col("__s") == 1, "secondary").otherwise("missing").alias("source"))


def locate(requested: DataFrame, locations: DataFrame, unknown: str = "NA") -> DataFrame:
    """First host, by name, that has each content; the mark for an unknown place is no host."""
    hosts = locations.filter(F.col("host") != unknown).groupBy("cid").agg(F.min("host").alias("host"), F.count("*").alias("n_hosts"))
    return requested.select("cid").distinct().join(hosts, "cid", "left").withColumn("n_hosts", F.coalesce("n_hosts", F.lit(0)).cast("long"))


def location_map(locations: DataFrame) -> DataFrame:
    """Host -> number and digest-free list size; the lists themselves stay rows."""
    return locations.groupBy("host").agg(F.count("*").alias("n_cids"), F.min("cid").alias("first_cid"), F.max("cid").alias("last_cid"))


def put_both(blocks: DataFrame, primary: DataFrame, secondary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both stores with the blocks that each lacks; the primary one decides what a read returns."""
    return tuple(s.unionByName(unseen(blocks, s).select(*s.columns)) for s in (primary, secondary))
