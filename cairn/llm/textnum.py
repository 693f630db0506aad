"""Vectorised text statistics: numpy over blocks of UTF-8 bytes.

Texts are taken from Arrow batches in blocks of about BLOCK bytes, so that memory stays bounded whatever the
batch holds; a text longer than that makes a block of its own and is still handled whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from cairn.session import small_batches

BLOCK = 1 << 20
BLOCK_ROWS = 1 << 15
_U = np.uint64
_BASE, _MIX1, _MIX2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64)
    x ^= x >> _U(30)
    x *= _MIX1
    x ^= x >> _U(27)
    x *= _MIX2
    x ^= x >> _U(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n well-mixed 64-bit integers that only depend on the seed."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + _U(seed * 1_000_003 % (1 << 62))) * _BASE)


def uniform(h: np.ndarray) -> np.ndarray:
    """64-bit hashes as numbers in (0, 1)."""
    return ((h >> _U(11)).astype(np.float64) + 0.5) / float(1 << 53)


LANES = 32  # spans of more words of 8 bytes are hashed by BLAKE2
_MASK = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def table(*ranges: tuple[int, int]) -> np.ndarray:
    """A lookup table over bytes, true within the ranges."""
    t = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        t[lo : hi + 1] = True
    return t


SPACE = table((0x20, 0x20), (0x09, 0x0D))
WORD = ~SPACE
CONT = table((0x80, 0xBF))
SYMBOL = table(*((ord(c), ord(c)) for c in "#*$%&|<>"))
ALNUM = table((48, 57), (65, 90), (97, 122), (128, 255))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lowered(buf: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin-1 letters, byte by byte."""
    out = LOWER[buf]
    c3 = np.flatnonzero(buf[:-1] == 0xC3) + 1
    c3 = c3[(buf[c3] >= 0x80) & (buf[c3] <= 0x9E) & (buf[c3] != 0x97)]
    out[c3] += 0x20
    return out


class Texts:
    """A block of texts; in buf each is followed by a line end. start and end are byte offsets."""

    def __init__(self, raw: list[bytes]):
        self.n = len(raw)
        size = np.fromiter(map(len, raw), dtype=np.int64, count=self.n)
        self._hold(b"\n".join([*raw, bytes(8)]))
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size

    def _hold(self, padded: bytes) -> None:
        self._padded = padded
        self.buf = np.frombuffer(padded, dtype=np.uint8)[:-8]

    def with_buf(self, buf: np.ndarray) -> Texts:
        """The same texts with other bytes at the same places (such as lower case)."""
        other = object.__new__(Texts)
        other.n, other.start, other.end = self.n, self.start, self.end
        other._hold(buf.tobytes() + bytes(8))
        return other

    def raw(self, i: int) -> bytes:
        return self._padded[int(self.start[i]) : int(self.end[i])]

    def flags(self, table: np.ndarray) -> np.ndarray:
        """For each byte, whether the table holds it."""
        return np.frombuffer(self._padded.translate(table.tobytes()), dtype=bool)[:-8]

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a number for each byte, by text."""
        if not self.n:
            return np.zeros(0, dtype=np.int64)
        edges = np.stack([self.start, self.end], axis=1).ravel()
        return np.where(self.end > self.start, np.add.reduceat(flags, edges, dtype=np.int64)[::2], 0)

    def spans(self, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each maximal run of word bytes."""
        w = np.zeros(len(self.buf) + 2, dtype=np.int8)
        w[1:-1] = self.flags(is_word)
        if is_word[10]:
            w[self.end + 1] = 0
        d = np.diff(w)
        s, e = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
        return s, e, np.searchsorted(self.end, s, side="left")

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = np.flatnonzero(self.buf == 10)
        s = np.concatenate(([0], e[:-1] + 1)) if len(e) else e
        return s, e, np.searchsorted(self.end, e, side="left")

    def hashes(self, s: np.ndarray, e: np.ndarray, seed: int = 0) -> np.ndarray:
        """64-bit hashes of byte spans: 8 bytes after the other are taken in, each followed by a full scrambling, so that
        no structure of the bytes (as it undoes polynomial hashes) makes two spans meet. Hashes of different seeds are
        independent of each other."""
        size = e - s
        h = mix((size.astype(np.uint64) + _U(1 + (seed << 40))) * _BASE)
        words = np.ndarray((len(self.buf),), dtype="<u8", buffer=self._padded, strides=(1,))
        live = np.flatnonzero((size > 0) & (size <= 8 * LANES))
        left, at = size[live], s[live]
        while len(live):
            h[live] = mix(h[live] ^ (words[at] & _MASK[np.minimum(left, 8)])) + _BASE
            more = left > 8
            live, left, at = live[more], left[more] - 8, at[more] + 8
        raw, key = memoryview(self._padded), seed.to_bytes(8, "little")
        for i in np.flatnonzero(size > 8 * LANES).tolist():
            h[i] = int.from_bytes(blake2b(raw[int(s[i]) : int(e[i])], digest_size=8, key=key).digest(), "little")
        return h


def distinct(t: Texts, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the distinct spans, a second and independent hash of each, its first place, and the place of every span among them."""
    key, check = t.hashes(s, e), t.hashes(s, e, 1)
    keys, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    if (check != check[first][inverse]).any():  # spans that share a key
        keys, first, inverse = np.unique(mix(key ^ check), return_index=True, return_inverse=True)
    return keys, check[first], first, inverse


def raw_texts(col: pa.Array) -> list[bytes]:
    """Texts as bytes; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pc.fill_null(col.cast(pa.large_binary()), b"").to_pylist()


def blocks(col: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, Texts]]:
    """First row, row after the last, and the texts of each block of a column."""
    n = len(col)
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64) if n else []
    at = size = 0
    for i in range(n):
        if i > at and (size + sizes[i] > most or i - at >= BLOCK_ROWS):
            yield at, i, Texts(raw_texts(col.slice(at, i - at)))
            at, size = i, 0
        size += sizes[i] + 1
    if n > at:
        yield at, n, Texts(raw_texts(col.slice(at, n - at)))


def text_map(df: DataFrame, keep: list[str], text: str, fields: str, fn: Callable[[Texts], dict], most: int = BLOCK) -> DataFrame:
    """keep's columns and what fn returns for each block: a dict of arrays, a value for each text."""
    new = StructType.fromDDL(fields)
    schema = StructType([StructField(c, df.schema[c].dataType) for c in keep] + list(new.fields))
    arrow = to_arrow_schema(schema)
    names = [f.name for f in new.fields]
    at = keep.index(text) if text in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [b.column(i) for i in range(len(keep))]
            for lo, hi, texts in blocks(b.column(at), most):
                out = fn(texts)
                cols = [c.slice(lo, hi - lo) for c in kept]
                cols += [out[k] if isinstance(out[k], pa.Array) else pa.array(out[k]) for k in names]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    small_batches(df.sparkSession)
    return df.select(*keep, *([text] if at == len(keep) else [])).mapInArrow(run, schema)


def ragged(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Lists of the given lengths over one array of values."""
    off = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values))


def repeated_windows(h: np.ndarray, doc: np.ndarray, n: int, width: int) -> np.ndarray:
    """For each text, the words in windows of width words that occur twice or more in it."""
    m = len(h) - width + 1
    if m <= 0:
        return np.zeros(n, dtype=np.int64)
    mult = stream(23, width) | _U(1)
    key = np.zeros(m, dtype=np.uint64)
    for k in range(width):
        key += h[k : k + m] * mult[k]
    at = np.flatnonzero(doc[:m] == doc[width - 1 :])
    key = mix(key[at] + doc[at].astype(np.uint64) * _BASE)
    ranked = np.sort(key)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if not len(twice):
        return np.zeros(n, dtype=np.int64)
    i = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    at = at[twice[i] == key]
    edge = np.bincount(at, minlength=len(h) + 1) - np.bincount(at + width, minlength=len(h) + 1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n)


def base_statistics(t: Texts) -> dict[str, np.ndarray]:
    """Counts over words, symbols, lines and repeated windows of each text."""
    s, e, doc = t.spans(WORD)
    n_words = np.bincount(doc, minlength=t.n)
    h = t.hashes(s, e)
    cont = t.flags(CONT)
    ls, le, ldoc = t.lines()
    full = np.searchsorted(s, le) > np.searchsorted(s, ls)  # lines with a word
    ls, le, ldoc = ls[full], le[full], ldoc[full]
    _, first = np.unique(mix(t.hashes(ls, le) + ldoc.astype(np.uint64) * _BASE), return_index=True)
    n_lines = np.bincount(ldoc, minlength=t.n)
    return {
        "n_words": n_words,
        "word_chars": t.per_text(t.flags(WORD) & ~cont),
        "n_symbols": t.per_text(t.flags(SYMBOL)),
        "n_dup_lines": n_lines - np.bincount(ldoc[first], minlength=t.n),
        "n_repeat_words": repeated_windows(h, doc, t.n, 8),
        "n_lines": n_lines,
        "n_distinct_words": np.bincount(doc[np.unique(mix(h + doc.astype(np.uint64) * _BASE), return_index=True)[1]], minlength=t.n),
        "n_chars": t.per_text(~cont),
    }


CLASSES = {
    "upper": table((65, 90)),
    "digit": table((48, 57)),
    "pipe": table((124, 124)),
    "mark": table(*((ord(c), ord(c)) for c in "#*$%&")),
    "stop": table(*((ord(c), ord(c)) for c in ".,;:")),
    "bang": table(*((ord(c), ord(c)) for c in "!?")),
    "other": table((33, 33), (34, 34), (39, 43), (45, 45), (47, 47), (60, 64), (91, 96), (123, 126)),
    "angle": table((60, 60), (62, 62)),
    "slash": table((47, 47), (58, 58), (64, 64), (92, 92), (123, 123), (125, 125)),
}

FEATURES = ["log_words", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "word_length", "line_words",
            *(f"{k}_share" for k in CLASSES), "log_chars"]


def features(t: Texts) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Base statistics, and the matrix of FEATURES made from them; no feature grows without bound."""
    b = base_statistics(t)
    words, chars = np.maximum(b["n_words"], 1), np.maximum(b["n_chars"], 1)
    cols = [
        np.log1p(b["n_words"]), b["n_symbols"] / chars, b["n_dup_lines"] / np.maximum(b["n_lines"], 1),
        b["n_repeat_words"] / words, b["n_distinct_words"] / words, np.minimum(b["word_chars"] / words, 50),
        np.log1p(words / np.maximum(b["n_lines"], 1)), *(t.per_text(t.flags(c)) / chars for c in CLASSES.values()),
        np.log1p(b["n_chars"]),
    ]
    return b, np.stack([np.asarray(c, dtype=np.float64) for c in cols], axis=1)
