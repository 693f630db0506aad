"""Byte codecs in plain Python: varints, CIDs, the CBOR subset that headers and tree links use, CAR archives."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from io import BytesIO
from typing import Any, BinaryIO

from cairn.errors import CodecError
from cairn.functions.blake3 import blake3 as blake3

# Fixed values of the formats.
RAW, DAG_PB, DAG_CBOR = 0x55, 0x70, 0x71
SHA2_256 = 0x12
PRAGMA = bytes.fromhex("0aa16776657273696f6e02")
V2_HEADER = struct.Struct("<16sQQQ")
V2_START = len(PRAGMA) + V2_HEADER.size
INDEX_SORTED, MULTIHASH_INDEX = 0x0400, 0x0401
FULLY_INDEXED = (1).to_bytes(16, "little")
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
LINK_TAG = 42


def varint(n: int) -> bytes:
    """Unsigned LEB128."""
    if n < 0:
        raise CodecError("a varint has no sign")
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(f: BinaryIO, most: int = 19) -> int | None:
    """The next varint; None at the very end. Reads no byte beyond it."""
    n = shift = 0
    for i in range(most):
        b = f.read(1)
        if not b:
            if i == 0:
                return None
            raise CodecError("a varint is cut off")
        n |= (b[0] & 127) << shift
        if b[0] < 128:
            return n
        shift += 7
    raise CodecError("a varint is too long")


def cid_v1(digest: bytes, codec: int = RAW) -> bytes:
    """CIDv1 of a SHA2-256 digest."""
    return b"\x01" + varint(codec) + bytes([SHA2_256, 32]) + digest


def make_cid(content: bytes, codec: int = RAW) -> bytes:
    return cid_v1(hashlib.sha256(content).digest(), codec)


def read_cid(f: BinaryIO) -> bytes:
    """A binary CID of version 0 (a bare SHA2-256 multihash) or 1."""
    head = f.read(2)
    if len(head) < 2:
        raise CodecError("a CID is cut off")
    if head == b"\x12\x20":
        digest = f.read(32)
        if len(digest) < 32:
            raise CodecError("a CID is cut off")
        return head + digest
    if head[0] == 0:  # a multibase mark before the CID
        return read_cid(_Joined(head[1:], f))
    if head[0] != 1:
        raise CodecError(f"no CID begins with {head.hex()}")
    rest = _Joined(head[1:], f)
    codec, kind, size = read_varint(rest), read_varint(rest), read_varint(rest)
    if codec is None or kind is None or size is None:
        raise CodecError("a CID is cut off")
    digest = rest.read(size)
    if len(digest) < size:
        raise CodecError("a CID is cut off")
    return b"\x01" + varint(codec) + varint(kind) + varint(size) + digest


class _Joined:
    """Bytes that were read already, before the rest of a file."""

    def __init__(self, head: bytes, f: Any):
        self.head, self.f = head, f

    def read(self, n: int) -> bytes:
        out, self.head = self.head[:n], self.head[n:]
        return out if len(out) == n else out + self.f.read(n - len(out))


def cid_text(cid: bytes) -> str:
    """base32 of a CIDv1, base58 of a CIDv0."""
    if cid[:2] == b"\x12\x20" and len(cid) == 34:
        n, out = int.from_bytes(cid, "big"), ""
        while n:
            n, d = divmod(n, 58)
            out = BASE58[d] + out
        return "1" * (len(cid) - len(cid.lstrip(b"\0"))) + out
    return "b" + base64.b32encode(cid).decode().rstrip("=").lower()


def cid_bytes(text: str) -> bytes:
    if text.startswith("Qm") and len(text) == 46:
        n = 0
        for c in text:
            n = n * 58 + BASE58.index(c)
        return n.to_bytes(34, "big")
    if not text.startswith("b"):
        raise CodecError(f"no base of this CID is known: {text[:8]}")
    body = text[1:].upper()
    return base64.b32decode(body + "=" * (-len(body) % 8))


class Link(bytes):
    """A CID as a CBOR value."""


def _cbor_head(major: int, n: int) -> bytes:
    for limit, code, size in ((24, None, 0), (1 << 8, 24, 1), (1 << 16, 25, 2), (1 << 32, 26, 4), (1 << 64, 27, 8)):
        if n < limit:
            return bytes([major << 5 | n]) if code is None else bytes([major << 5 | code]) + n.to_bytes(size, "big")
    raise CodecError("an integer is too large for CBOR")


def cbor(value: Any) -> bytes:
    """DAG-CBOR: definite lengths, map keys by length and then bytes, links as tag 42."""
    if isinstance(value, bool) or value is None:
        return {False: b"\xf4", True: b"\xf5", None: b"\xf6"}[value]
    if isinstance(value, int):
        return _cbor_head(0, value) if value >= 0 else _cbor_head(1, -1 - value)
    if isinstance(value, float):
        return b"\xfb" + struct.pack(">d", value)
    if isinstance(value, Link):
        return _cbor_head(6, LINK_TAG) + cbor(b"\0" + bytes(value))
    if isinstance(value, bytes):
        return _cbor_head(2, len(value)) + value
    if isinstance(value, str):
        raw = value.encode()
        return _cbor_head(3, len(raw)) + raw
    if isinstance(value, list | tuple):
        return _cbor_head(4, len(value)) + b"".join(map(cbor, value))
    if isinstance(value, dict):
        items = sorted(((k.encode(), v) for k, v in value.items()), key=lambda x: (len(x[0]), x[0]))
        return _cbor_head(5, len(items)) + b"".join(_cbor_head(3, len(k)) + k + cbor(v) for k, v in items)
    raise CodecError(f"no CBOR for {type(value).__name__}")


def uncbor(raw: bytes) -> Any:
    f = BytesIO(raw)
    value = _uncbor(f)
    if f.read(1):
        raise CodecError("bytes are left behind a CBOR item")
    return value


def _uncbor(f: BinaryIO) -> Any:
    first = f.read(1)
    if not first:
        raise CodecError("a CBOR item is cut off")
    major, info = first[0] >> 5, first[0] & 31
    if major == 7:
        if info in (20, 21, 22):
            return {20: False, 21: True, 22: None}[info]
        if info == 27:
            return struct.unpack(">d", f.read(8))[0]
        raise CodecError("a CBOR value that DAG-CBOR doesn't have")
    if info > 27:
        raise CodecError("a CBOR length that isn't definite")
    n = info if info < 24 else int.from_bytes(f.read(1 << (info - 24)), "big")
    if major == 0:
        return n
    if major == 1:
        return -1 - n
    if major in (2, 3):
        raw = f.read(n)
        if len(raw) < n:
            raise CodecError("a CBOR string is cut off")
        return raw if major == 2 else raw.decode()
    if major == 4:
        return [_uncbor(f) for _ in range(n)]
    if major == 5:
        return {_uncbor(f): _uncbor(f) for _ in range(n)}
    inner = _uncbor(f)
    if n != LINK_TAG or not isinstance(inner, bytes) or inner[:1] != b"\0":
        raise CodecError("a CBOR tag that isn't a link")
    return Link(inner[1:])


def v1_header(roots: list[bytes], version: int = 1) -> bytes:
    body = cbor({"roots": [Link(r) for r in roots], "version": version})
    return varint(len(body)) + body


def read_v1_header(f: BinaryIO) -> tuple[int, list[bytes]]:
    size = read_varint(f)
    if size is None:
        raise CodecError("an archive without a header")
    value = uncbor(f.read(size))
    if not isinstance(value, dict) or not isinstance(value.get("version"), int) or not isinstance(value.get("roots"), list):
        raise CodecError("a header needs a version and roots")
    if not all(isinstance(r, Link) for r in value["roots"]):
        raise CodecError("roots must be links")
    return value["version"], [bytes(r) for r in value["roots"]]


def block(cid: bytes, content: bytes) -> bytes:
    return varint(len(cid) + len(content)) + cid + content


def index_bytes(entries: dict[bytes, int]) -> bytes:
    """Sorted index: a bucket for each width of CID, entries (cid, offset) in the order of CIDs."""
    by_width: dict[int, list[bytes]] = {}
    for cid in sorted(entries):
        by_width.setdefault(len(cid), []).append(cid)
    out = varint(INDEX_SORTED)
    for width, cids in sorted(by_width.items()):
        out += struct.pack("<IQ", width + 8, len(cids)) + b"".join(c + struct.pack("<Q", entries[c]) for c in cids)
    return out


def read_index(f: BinaryIO) -> dict[bytes, int]:
    kind = read_varint(f)
    if kind != INDEX_SORTED:
        raise CodecError(f"index codec {kind} isn't supported")
    out: dict[bytes, int] = {}
    while len(head := f.read(12)) == 12:
        width, count = struct.unpack("<IQ", head)
        for _ in range(count):
            raw = f.read(width)
            if len(raw) < width:
                raise CodecError("an index bucket is cut off")
            cid = raw[:-8]
            out[cid[1:] if cid[:1] == b"\0" else cid] = struct.unpack("<Q", raw[-8:])[0]
    if not out:
        raise CodecError("an index without buckets")
    return out


class Archive:
    """An opened archive: version, roots, and where its payload and index lie."""

    def __init__(self, f: BinaryIO):
        self.f = f
        f.seek(0, 2)
        self.size = f.tell()
        f.seek(0)
        self.v2 = f.read(len(PRAGMA)) == PRAGMA
        self.start, self.stop, self.index_offset = 0, self.size, 0
        if self.v2:
            raw = f.read(V2_HEADER.size)
            if len(raw) < V2_HEADER.size:
                raise CodecError("a CARv2 header is cut off")
            _, self.start, data_size, self.index_offset = V2_HEADER.unpack(raw)
            self.stop = self.start + data_size
        f.seek(self.start)
        self.version, self.roots = read_v1_header(f)
        self.first_block = f.tell()

    def scan(self, content: bool = True) -> Iterator[tuple[bytes, int, int, bytes | None]]:
        """(cid, offset, length, content) of each block, in order, up to the payload's end."""
        at = self.first_block
        while at < self.stop:
            self.f.seek(at)
            size = read_varint(self.f)
            if not size:
                return
            body = self.f.tell()
            cid = read_cid(self.f)
            length = size - (self.f.tell() - body)
            raw = None
            if content:
                raw = self.f.read(length)
                if len(raw) < length:
                    raise CodecError("a block is cut off")
            yield cid, at, length, raw
            at = body + size

    def index(self) -> dict[bytes, int]:
        """The stored index, or one from a scan."""
        if self.v2 and self.index_offset:
            self.f.seek(self.index_offset)
            return read_index(self.f)
        return {cid: at for cid, at, _, _ in self.scan(content=False)}

    def get(self, offset: int) -> tuple[bytes, bytes]:
        self.f.seek(offset)
        size = read_varint(self.f)
        if not size:
            raise CodecError("no block at this offset")
        body = self.f.tell()
        cid = read_cid(self.f)
        return cid, self.f.read(size - (self.f.tell() - body))


class ArchiveWriter:
    """Writes a CARv2 in one pass over its blocks; the header follows at the end. Blocks that are there are skipped."""

    def __init__(self, f: BinaryIO, roots: list[bytes] | None = None):
        self.f, self.entries = f, {}
        f.write(PRAGMA + bytes(V2_HEADER.size))
        self.at = V2_START + f.write(v1_header(roots or [], 2))

    def put(self, content: bytes, codec: int = RAW, cid: bytes | None = None) -> bytes:
        cid = cid or make_cid(content, codec)
        if cid not in self.entries:
            self.entries[cid] = self.at
            self.at += self.f.write(block(cid, content))
        return cid

    def close(self) -> None:
        end = self.at
        if self.entries:
            self.f.write(index_bytes(self.entries))
        self.f.seek(len(PRAGMA))
        self.f.write(V2_HEADER.pack(FULLY_INDEXED, V2_START, end - V2_START, end if self.entries else 0))


def v1_archive(blocks: list[tuple[bytes, bytes]], roots: list[bytes]) -> bytes:
    """A CARv1 of (cid, content) in order, duplicates included."""
    return v1_header(roots) + b"".join(block(c, x) for c, x in blocks)


def with_roots(raw: bytes, roots: list[bytes]) -> bytes:
    """A CARv1 with other roots: the blocks follow a header of another size, so all offsets are new."""
    a = Archive(BytesIO(raw))
    return v1_header(roots, a.version) + raw[a.first_block : a.stop]
