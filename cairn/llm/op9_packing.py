"""Packing along a space-filling curve.

Each text is tokenized once; its hashed vector of token counts is projected to DIMS numbers, whose cells have a
place on a Hilbert curve. Documents are range-sorted by that key, their tokens follow each other along the curve,
and the stream is cut every 4096 tokens: neighbours share sequences and only the end can need padding. The end is cut
at powers of two, which need none.

Defined cases: a null text counts as empty and has the end id alone; equal texts lie side by side, each with its own
pieces; null and repeated ids are kept, in the order of a row's own number; an empty table gives no pieces; other
columns are not read.

The token ids are written once, as 16-bit numbers. What is sorted by range is the key table, about 40 bytes a row; a
tie of any size is split, as the row's number is part of the range key. Offsets come from sums by range, which are as many
as there are ranges.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cairn.llm.common import Scratch, read_table
from cairn.llm.textnum import WORD, Texts, distinct, mix, stream, text_map
from cairn.llm.wordcache import WordCache, gather

LENGTH = 4096
END_ID = 2
DIMS, BITS = 3, 10
_cache: dict[str, WordTokens] = {}


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer cells (rows, dims), by Gray-code transposition (Skilling 2004)."""
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            up = (x[i] & q) > 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[-1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class WordTokens:
    """Token ids by word. The tokenizer parts a text at white space and looks no further, so the ids of a text are
    those of its words in a row, and words that were met before come from a cache of bounded size."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.size = self.model.get_vocab_size()
        if self.size > 1 << 16:
            raise ValueError("ids of this tokenizer need more than 16 bits")
        # a special token parts the words that are tokenized in one call; words that may hold one go alone
        self.mark = next((t.content for t in self.model.get_added_tokens_decoder().values() if t.special), None)
        self.mark_id = self.model.token_to_id(self.mark) if self.mark else -1
        self.cache = WordCache()

    def tokenize(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in a row, and their number by word."""
        alone = [i for i, w in enumerate(words) if self.mark is None or self.mark[:2] in w]
        plain = words if not alone else [w for i, w in enumerate(words) if i not in set(alone)]
        texts = [self.mark.join([*plain[i : i + 500], ""]) for i in range(0, len(plain), 500)] if plain else []
        parts = [np.array(e.ids, dtype=np.int32) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
        ends = np.flatnonzero(ids == self.mark_id)
        n = np.diff(ends, prepend=-1) - 1
        ids = ids[ids != self.mark_id]
        if not alone:
            return ids, n
        listed, at = np.split(ids, np.cumsum(n)[:-1]) if len(n) else [], 0
        out = []
        for i, w in enumerate(words):
            if self.mark is None or self.mark[:2] in w:
                out.append(np.array(self.model.encode(w, add_special_tokens=False).ids, dtype=np.int32))
            else:
                out.append(listed[at])
                at += 1
        return np.concatenate(out), np.array([len(x) for x in out])

    def encode(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block's texts, each with END_ID behind it, and their number by text."""
        s, e, doc = t.spans(WORD)
        keys, check, first, inverse = distinct(t, s, e)
        raw = t.buf.tobytes()
        pool, at, n = self.cache.get(keys, check, lambda new: self.tokenize([raw[s[k] : e[k]].decode("utf-8", "replace") for k in first[new]]))
        at, n = at[inverse], n[inverse]
        by_doc = np.bincount(doc, n, minlength=t.n).astype(np.int64)
        ends = np.cumsum(by_doc + 1)
        out = np.empty(int(ends[-1]) if t.n else 0, dtype=np.uint16)
        hole = np.ones(len(out), dtype=bool)
        hole[ends - 1] = False
        out[hole] = gather(pool, at, n)
        out[ends - 1] = END_ID
        return out, by_doc + 1


def tokenizer(path: str) -> WordTokens:
    """One for each worker process."""
    if path not in _cache:
        _cache[path] = WordTokens(path)
    return _cache[path]


def curve_keys(ids: np.ndarray, n: np.ndarray, vocab: int, dims: int = DIMS, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of texts from the mean of hashed signs of their ids: a projection of the hashed count vector.

    A mean of m signs has the spread 1/sqrt(m), so it is scaled by a fixed factor and squashed; the same text has the same
    key in every run and partition.
    """
    doc = np.repeat(np.arange(len(n)), n)
    cells = np.empty((len(n), dims), dtype=np.int64)
    for k in range(dims):
        sign = (mix(stream(90 + k, vocab)) >> np.uint64(40)).astype(np.float64) / (1 << 24) * 2 - 1
        mean = np.bincount(doc, sign[ids], minlength=len(n)) / n
        cells[:, k] = np.minimum((np.tanh(4 * mean) + 1) / 2 * (1 << bits), (1 << bits) - 1)
    return hilbert(cells, bits)


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, row number, ids (16 bits each, little-endian), number of ids, Hilbert key."""

    def fn(t: Texts) -> dict:
        model = tokenizer(path)
        ids, n = model.encode(t)
        edge = np.concatenate([[0], np.cumsum(n)]) * 2
        raw = ids.astype("<u2").tobytes()
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), t.n, [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(raw)])
        return {"ids": packed, "n": n, "key": curve_keys(ids, n, model.size)}

    rows = docs.select("doc_id", "text")
    return text_map(rows, ["doc_id"], "text", "ids binary, n long, key long", fn)


def pieces(start: int, n: int, total: int) -> list[tuple[int, int, int, int]]:
    """(first id, length, sequence, offset) of a document's pieces; start: ids before it on the curve."""
    out, at, end = [], start, start + n
    full = total // LENGTH
    while at < end:
        if at < full * LENGTH:
            seq, low, high = at // LENGTH, at // LENGTH * LENGTH, (at // LENGTH + 1) * LENGTH
        else:  # the end of the stream: sequences of falling powers of two
            low, seq, rest = full * LENGTH, full, total % LENGTH
            while True:
                size = 1 << (rest.bit_length() - 1)
                if at < low + size:
                    high = low + size
                    break
                low, seq, rest = low + size, seq + 1, rest - size
        stop = min(end, high)
        out.append((at - start, stop - at, seq, at - low))
        at = stop
    return out


def pack(docs: DataFrame, path: str) -> DataFrame:
    """The pieces of all documents in sequences of at most LENGTH ids."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    # the row number is written with the ids, and so stays with its row whatever is computed again
    tokens = scratch.write(tokenized(docs, path).withColumn("row", F.monotonically_increasing_id()), "tokens")
    keys = tokens.select("key", "row", "n")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = "row long, n long, range int, before long"

    def cumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, total = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column(2).to_numpy()
            before = total + np.cumsum(n) - n
            total += int(n.sum())
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(np.full(len(n), here, dtype=np.int32)), pa.array(before)], names=["row", "n", "range", "before"])

    order = keys.repartitionByRange(parts, "key", "row").sortWithinPartitions("key", "row").mapInArrow(cumulate, schema)
    order = scratch.write(order, "order")
    sums = sorted((r["range"], r["s"]) for r in order.groupBy("range").agg(F.sum("n").alias("s")).collect())  # a row for each range
    offset, total = {}, 0
    for k, s in sums:
        offset[k] = total
        total += s
    table = spark.createDataFrame(list(offset.items()) or [(0, 0)], "range int, offset long")
    placed = order.join(F.broadcast(table), "range").select("row", (F.col("before") + F.col("offset")).alias("start"))
    joined = tokens.select("row", "doc_id", "ids").join(placed.hint("shuffle_hash"), "row").select("doc_id", "ids", "start")
    kind = docs.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    out_schema = f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for b in batches:
            ids, starts = b.column(1), b.column(2).to_pylist()
            rows: list[tuple] = []
            who: list[int] = []
            for i, start in enumerate(starts):
                x = np.frombuffer(ids[i].as_py(), dtype="<u2").astype("<u4")
                for first, length, seq, off in pieces(start, len(x), total):
                    rows.append((first, length, zlib.crc32(x[first : first + length].tobytes()), len(x), seq, off))
                    who.append(i)
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who, pa.int64())).cast(id_type), *(pa.array(c, pa.int64()) for c in cols)], names=names)

    return joined.mapInArrow(cut, out_schema)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents; see the module for the defined cases."""
    return pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs.select("doc_id", "text"), vocabulary())


QUERIES = {"op9_packing": op9_packing}
ORACLES: dict[str, str] = {}
