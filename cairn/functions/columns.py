"""Column functions. All are built-in expressions, but for those at the end, which work on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from cairn.functions import codec

CID_LENGTH = 36
# The extension map of media types.
MIME_TYPES = {
    "txt": "text/plain", "md": "text/markdown", "html": "text/html", "htm": "text/html", "css": "text/css", "csv": "text/csv",
    "js": "application/javascript", "json": "application/json", "xml": "text/xml", "pdf": "application/pdf", "zip": "application/zip",
    "gz": "application/gzip", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml",
    "mp3": "audio/mpeg", "mp4": "video/mp4", "bin": "application/octet-stream",
}
UNKNOWN_MIME = "application/octet-stream"


def cid_hex(content: Column, codec_id: int = codec.RAW) -> Column:
    """CIDv1 with SHA2-256, as lower-case hex."""
    return F.concat(F.lit((b"\x01" + codec.varint(codec_id) + b"\x12\x20").hex()), F.sha2(content.cast("binary"), 256))


def cid_binary(content: Column, codec_id: int = codec.RAW) -> Column:
    return F.unhex(cid_hex(content, codec_id))


def byte_size(content: Column) -> Column:
    return F.octet_length(content).cast("long")


def varint_size(n: Column) -> Column:
    """Bytes of an unsigned varint."""
    size = F.lit(1)
    for bits in range(7, 63, 7):
        size = size + F.when(n >= F.lit(1 << bits), 1).otherwise(0)
    return size.cast("long")


def block_size(content_size: Column) -> Column:
    """Bytes of a block on disk: varint, CID and content."""
    body = content_size + CID_LENGTH
    return varint_size(body) + body


def segments(path: Column) -> Column:
    """Path segments; empty ones are dropped."""
    return F.filter(F.split(path, "/"), lambda s: s != "")


def join_path(parts: Column) -> Column:
    return F.array_join(parts, "/")


def strip_prefix(path: Column, prefix: str) -> Column:
    p = prefix.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(p)), F.substr(path, F.lit(len(p) + 1))).otherwise(path)


def parent(path: Column) -> Column:
    return join_path(F.slice(segments(path), F.lit(1), F.greatest(F.size(segments(path)) - 1, F.lit(0))))


def under(path: Column, prefix: str) -> Column:
    """Whether path is prefix itself or lies below it."""
    p = prefix.strip("/")
    return F.lit(True) if not p else (path == p) | F.startswith(path, F.lit(p + "/"))


def base64_plain(raw: Column) -> Column:
    return F.translate(F.base64(raw), "\r\n", "")


def base64_url(raw: Column) -> Column:
    """URL-safe base64 with padding, in one line."""
    return F.translate(F.base64(raw), "+/\r\n", "-_")


def unbase64_url(text: Column) -> Column:
    return F.unbase64(F.translate(text, "-_", "+/"))


def mime_type(path: Column, types: dict[str, str] = MIME_TYPES) -> Column:
    """Media type by extension."""
    known = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.try_element_at(known, ext), F.lit(UNKNOWN_MIME))


def human_bytes(n: Column) -> Column:
    """Bytes in the largest unit of 1024s, with two places."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB"), start=1):
        out = F.when(n >= F.lit(1 << (10 * i)), F.format_string(f"%.2f {unit}", n / F.lit(float(1 << (10 * i))))).otherwise(out)
    return out


def parse_enum(value: Column, domain: list[str], what: str, strict: bool = True) -> Column:
    """The value in lower case; another than those of the domain is an error, or null if not strict."""
    v = F.lower(F.trim(value))
    other = F.raise_error(F.concat(F.lit(f"no such {what}: "), value)) if strict else F.lit(None).cast("string")
    return F.when(value.isNull(), F.lit(None).cast("string")).when(v.isin(*domain), v).otherwise(other)


def is_uuid(value: Column) -> Column:
    return F.rlike(F.lower(value), F.lit("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"))


def fingerprint(key: Column) -> Column:
    """Hex digest that names a key."""
    return F.sha2(key.cast("binary"), 256)


def form_encode(fields: dict[str, Column]) -> Column:
    return F.concat_ws("&", *[F.concat(F.url_encode(F.lit(k)), F.lit("="), F.url_encode(v.cast("string"))) for k, v in fields.items()])


def cid_sha1(content: Column, codec_id: int = codec.RAW) -> Column:
    """CIDv1 with SHA-1, as some old archives have."""
    return F.concat(F.lit((b"\x01" + codec.varint(codec_id) + b"\x11\x14").hex()), F.sha1(content.cast("binary")))


def random_id(length: int = 7) -> Column:
    """Letters and digits for a new drive; never the same twice, so not for queries that are compared."""
    return F.substr(F.translate(F.uuid(), "-", ""), F.lit(1), F.lit(length))


def node_json(created: Column, modified: Column, mime: Column, size: Column) -> Column:
    """Node metadata for a client."""
    return F.to_json(F.struct(created.alias("created"), modified.alias("modified"), mime.alias("mime_type"), size.cast("long").alias("size")))


@F.pandas_udf(StringType())
def cid_text(cids: pd.Series) -> pd.Series:
    """base32 (version 1) or base58 (version 0) of binary CIDs."""
    return cids.map(lambda c: None if c is None else codec.cid_text(bytes(c)))


@F.pandas_udf(BinaryType())
def cid_parse(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else codec.cid_bytes(t))


@F.pandas_udf(BinaryType())
def lz4_compress(raw: pd.Series) -> pd.Series:
    """LZ4 frames."""

    return raw.map(lambda x: None if x is None else pa.compress(x, codec="lz4", asbytes=True))


@F.pandas_udf(BinaryType())
def lz4_decompress(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: None if x is None else pa.CompressedInputStream(pa.BufferReader(x), "lz4").read())


@F.pandas_udf(BinaryType())
def blake3(raw: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """BLAKE3 of each value; archives are digested part by part (store.digests, car.digests)."""
    for s in raw:
        yield s.map(lambda x: None if x is None else codec.blake3(bytes(x)))
