"""SentencePiece encoding and decoding with seeded merge-dropout.

Byte-pair merging with an agenda: of all adjacent pieces whose joint piece is in the vocabulary, the best-scored (on
ties the leftmost) comes first; a keyed hash of the seed, the text, the surrounding unit's place in it and the candidate's
place decides whether it is skipped when it comes up. A skipped candidate stays skipped, so the segmentation depends on the
seed and the text alone, and any segmentation decodes to the same text.

Merges never cross from a non-space to a space (no piece of such a vocabulary does), so the units are a run of spaces with
the word behind it. Every unit of every text has a key of its own. What a cache keeps doesn't depend on keys: by unit and
set of skipped candidates, the candidates that come up and the ids that follow if no more of them are skipped. A unit
starts with the empty set; its key decides on the candidates; the first one skipped makes the next set, CACHED_SKIPS of
them at most. Units of more skips or over CACHED_BYTES are merged with their key. Units that aren't in the cache are merged
together, one agenda step for all of them at once; long ones by a heap.

Defined cases: a null or empty text has no ids and decodes to the empty text; a text with the vocabulary's space mark in it keeps
it (as byte pieces); equal texts get equal ids and repeated rows stay repeated; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cairn.llm.common import read_table
from cairn.llm.textnum import _BASE, Texts, mix, ragged, stream, text_map
from cairn.llm.wordcache import WordCache, gather

RATE = 0.1
SEED = 10
BLOCK_BYTES = 2 << 20  # units of a larger block that aren't in the cache share their agenda steps
CACHED_BYTES, CACHED_SKIPS = 24, 3  # places within a cached unit have 6 bits
SPACE_MARK = "▁"
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 20, 24, 32, 48)
_U = np.uint64
_NONE = np.int32(2**31 - 1)
_PAD = np.int32(-(2**31) + 1)
_PLACE = stream(101, 3) | _U(1)
_loaded: dict[tuple, Codec] = {}


def _place(start: np.ndarray, mid: np.ndarray, end: np.ndarray) -> np.ndarray:
    return start | mid << 6 | end << 12


def _runs(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places at, at + 1, ... of runs of n, in a row."""
    return np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Codec:
    def __init__(self, path: str, rate: float = RATE, seed: int = SEED):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        self.byte_id = np.full(256, -1, dtype=np.int32)
        self.raw: list[bytes] = [b""] * size
        own = {}
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                self.byte_id[int(p[1:-1], 16)] = i
                self.raw[i] = bytes([int(p[1:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                own[p] = i
                self.raw[i] = p.replace(SPACE_MARK, " ").encode()
        if (self.byte_id < 0).any():
            raise ValueError("lossless decoding needs a vocabulary with all byte pieces")
        score = np.array([sp.get_score(i) for i in range(size)])
        rank = np.empty(size, dtype=np.int32)
        rank[np.argsort(-score, kind="stable")] = np.arange(size)
        self.rank = rank
        self.char = np.full(0x110000, -1, dtype=np.int32)
        for p, i in own.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.char[0x20], self.char[ord(SPACE_MARK)] = self.char[ord(SPACE_MARK)], -1
        pairs = {}
        for p, i in own.items():
            for k in range(1, len(p)):
                if (a := own.get(p[:k])) is not None and (b := own.get(p[k:])) is not None:
                    pairs[a << 32 | b] = i
            if SPACE_MARK in p.lstrip(SPACE_MARK):
                raise ValueError("a piece holds a space behind another character")
        self.pair = np.array(sorted(pairs), dtype=np.int64)
        self.joint = np.array([pairs[k] for k in sorted(pairs)], dtype=np.int32)
        # one-byte characters that no piece holds stand alone
        self.single = np.array([b < 128 and self.char[b] < 0 for b in range(256)])
        self.single[10] = True
        self.skip_below = _U(min(int(rate * 2.0**64), 2**64 - 1))
        self.key = stream(1_000 + seed, 1)[0]
        self.cache = WordCache(dtype=np.int32)
        self.piece_at = np.cumsum([0] + [len(r) for r in self.raw])
        self.piece_n = np.diff(self.piece_at)
        self.piece_pool = np.frombuffer(b"".join(self.raw), dtype=np.uint8)

    def skipped(self, key: np.ndarray, start: np.ndarray, mid: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(key + start.astype(np.uint64) * _PLACE[0] + mid.astype(np.uint64) * _PLACE[1] + end.astype(np.uint64) * _PLACE[2]) < self.skip_below

    def candidates(self, left: np.ndarray, right: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Agenda rank (_NONE: no such piece, or skipped) and joint piece of neighbours."""
        want = (left.astype(np.int64) << 32) | right.astype(np.int64)
        i = np.minimum(np.searchsorted(self.pair, want), len(self.pair) - 1)
        ok = (self.pair[i] == want) & (left >= 0) & (right >= 0)
        joint = self.joint[i]
        return np.where(ok & ~skip, self.rank[joint], _NONE), joint

    def merge_many(self, sym: np.ndarray, skip: Callable, steps: list | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Merge the rows of a padded matrix; (rows, their pieces) as they finish. skip tells from rows and places whether
        a candidate is skipped; steps gets (rows, places) of the candidates that are merged."""
        done = []
        rows = np.arange(len(sym))
        at = np.broadcast_to(np.arange(sym.shape[1] + 1), (len(sym), sym.shape[1] + 1)).copy()
        prio, joint = self.candidates(sym[:, :-1], sym[:, 1:], skip(rows[:, None], at[:, :-2], at[:, 1:-1], at[:, 2:]))
        while sym.shape[1] > 1:
            c = prio.argmin(axis=1)
            live = prio[np.arange(len(c)), c] != _NONE
            if not live.all():
                done.append((rows[~live], sym[~live]))
                rows, sym, at, prio, joint, c = (x[live] for x in (rows, sym, at, prio, joint, c))
            if not len(rows):
                return done
            m, i = sym.shape[1] - 1, np.arange(len(rows))
            if steps is not None:
                steps.append((rows, _place(at[i, c], at[i, c + 1], at[i, c + 2])))
            step = np.arange(m)
            pick = step + (step > c[:, None])
            new = joint[i, c]
            sym = np.take_along_axis(sym, pick, axis=1)
            sym[i, c] = new
            at = np.take_along_axis(at, np.arange(m + 1) + (np.arange(m + 1) > c[:, None]), axis=1)
            if m == 1:
                break
            pick = pick[:, :-1]  # the merged candidate goes; its neighbours are judged anew
            prio, joint = np.take_along_axis(prio, pick, axis=1), np.take_along_axis(joint, pick, axis=1)
            for side in (-1, 0):
                p = c + side
                r = np.flatnonzero((p >= 0) & (p < m - 1))
                q = p[r]
                prio[r, q], joint[r, q] = self.candidates(sym[r, q], sym[r, q + 1], skip(rows[r], at[r, q], at[r, q + 1], at[r, q + 2]))
        if len(rows):
            done.append((rows, sym))
        return done

    def merge_one(self, sym: np.ndarray, key: np.uint64) -> np.ndarray:
        """The same for one long unit, with a heap and linked neighbours."""
        n = len(sym)
        sym = sym.copy()
        nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        a = np.arange(n - 1)
        rank, joint = self.candidates(sym[:-1], sym[1:], self.skipped(key, a, a + 1, a + 2))
        heap = [(int(rank[i]), i, i + 1, i + 2, int(joint[i])) for i in np.flatnonzero(rank != _NONE).tolist()]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, s, mid, stop, j = heapq.heappop(heap)
            if not (alive[s] and end[s] == mid and mid < n and alive[mid] and end[mid] == stop):
                continue
            sym[s], end[s], alive[mid], nxt[s] = j, stop, False, nxt[mid]
            if nxt[s] < n:
                prv[nxt[s]] = s
            for x in (prv[s], s):
                y = nxt[x] if x >= 0 else n
                if x >= 0 and y < n:
                    one = np.array([x]), np.array([y]), np.array([end[y]])
                    r, q = self.candidates(sym[[x]], sym[[y]], self.skipped(key, *one))
                    if r[0] != _NONE:
                        heapq.heappush(heap, (int(r[0]), x, y, end[y], int(q[0])))
        return sym[np.array(alive)]

    def segment(self, units: list[str], key: np.ndarray | None, sets: np.ndarray | None = None, steps: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units in a row, and their number by unit; by keys, or by sets of skipped candidates (a row for each
        unit, -1 for none) of cached units. steps gets (units, places) of the candidates that are merged."""

        def skip(rows: np.ndarray, start: np.ndarray, mid: np.ndarray, end: np.ndarray) -> np.ndarray:
            if sets is None:
                return self.skipped(key[rows], start, mid, end)
            place, out = _place(start, mid, end), np.zeros(start.shape, dtype=bool)
            for j in range(sets.shape[1]):
                out |= sets[rows, j] == place
            return out

        size = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        code = np.frombuffer("".join(units).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        begin = np.cumsum(size) - size
        sym = self.char[code]
        sym = np.where(sym < 0, -1 - code, sym).astype(np.int32)  # unknown: minus the character, less one
        found: list[tuple[np.ndarray, np.ndarray]] = []
        low = 0
        for width in WIDTHS:
            rows = np.flatnonzero((size > low) & (size <= width))
            low = width
            if len(rows):
                col = np.arange(width)
                inside = col < size[rows][:, None]
                mat = np.where(inside, sym[np.minimum(begin[rows][:, None] + col, len(sym) - 1)], _PAD)
                own: list | None = None if steps is None else []
                found += [(rows[r], m) for r, m in self.merge_many(mat, lambda r, *place, rows=rows: skip(rows[r], *place), own)]
                if steps is not None:
                    steps += [(rows[r], place) for r, place in own]
        for i in np.flatnonzero(size > low).tolist():
            found.append((np.array([i]), self.merge_one(sym[begin[i] : begin[i] + size[i]], key[i])[None, :]))
        count = np.zeros(len(units), dtype=np.int64)
        for r, m in found:
            count[r] = (m != _PAD).sum(axis=1)
        at = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), dtype=np.int32)
        for r, m in found:
            keep = m != _PAD
            flat[(at[r][:, None] + np.arange(m.shape[1]))[keep]] = m[keep]
        if (flat >= 0).all():
            return flat, count
        # unknown characters as their bytes
        unit = np.repeat(np.arange(len(units)), count)
        odd = np.flatnonzero(flat < 0)
        wide = [self.byte_id[list(chr(-1 - int(x)).encode())] for x in flat[odd]]
        times = np.ones(len(flat), dtype=np.int64)
        times[odd] = [len(w) for w in wide]
        out = np.repeat(flat, times)
        out[np.repeat(flat < 0, times)] = np.concatenate(wide)
        return out, np.bincount(unit, times, minlength=len(units)).astype(np.int64)

    def paths(self, units: list[str], sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the cache keeps of each unit: number of the candidates that come up, their places, ids."""
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        ids, n = self.segment(units, None, sets, steps)
        unit, place = (np.concatenate([x[i] for x in steps]) if steps else np.zeros(0, dtype=np.int64) for i in (0, 1))
        order = np.argsort(unit, kind="stable")
        m = np.bincount(unit, minlength=len(units))
        count = 1 + m + n
        at = np.cumsum(count) - count
        out = np.empty(int(count.sum()), dtype=np.int32)
        out[at] = m
        out[_runs(at + 1, m)] = place[order]
        out[_runs(at + 1 + m, n)] = ids
        return out, count

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and their number by text."""
        t = Texts([b" " + x if x else x for x in texts])
        space, single = t.buf == 0x20, self.single[t.buf]
        before = np.roll(space, 1)
        after_single = np.roll(single, 1)
        before[0], after_single[0] = False, True
        start = np.flatnonzero((space & ~before) | single | after_single)
        size = np.diff(np.append(start, len(t.buf)))
        inner = np.ones(len(t.buf), dtype=bool)
        inner[t.end] = False
        start, size = start[inner[start]], size[inner[start]]
        doc = np.searchsorted(t.end, start, side="left")
        key = mix(mix(t.hashes(t.start, t.end) ^ self.key)[doc] + (start - t.start[doc]).astype(np.uint64) * _BASE)
        raw = t.buf.tobytes()

        def units(at: np.ndarray) -> list[str]:
            return [raw[s : s + k].decode() for s, k in zip(start[at].tolist(), size[at].tolist(), strict=True)]

        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # units, their ids in a row, number by unit
        live = np.flatnonzero(size <= CACHED_BYTES)
        node, check = (t.hashes(start[live], start[live] + size[live], i) for i in (0, 1))
        sets = np.full((len(live), CACHED_SKIPS), -1, dtype=np.int32)
        for level in range(CACHED_SKIPS + 1):
            if not len(live):
                break
            distinct, first, inverse = np.unique(node, return_index=True, return_inverse=True)
            if (check != check[first][inverse]).any():  # units that share a key
                distinct, first, inverse = np.unique(mix(node ^ check), return_index=True, return_inverse=True)
            pool, at, n = self.cache.get(distinct, check[first], lambda new: self.paths(units(live[first[new]]), sets[first[new], :level]))  # noqa: B023
            at, n = at[inverse], n[inverse]
            m = pool[at].astype(np.int64)
            owner, place = np.repeat(np.arange(len(live)), m), gather(pool, at + 1, m)
            hit = np.flatnonzero(self.skipped(key[live[owner]], place & 63, place >> 6 & 63, place >> 12))
            hit = hit[np.append(True, owner[hit][1:] != owner[hit][:-1])] if len(hit) else hit
            more, place = owner[hit], place[hit]
            done = np.ones(len(live), dtype=bool)
            done[more] = False
            k = (n - 1 - m)[done]
            parts.append((live[done], gather(pool, (at + 1 + m)[done], k), k))
            step = (place + 1).astype(np.uint64) * _BASE
            live, node, check, sets = live[more], mix(node[more] + step), mix(check[more] ^ step), sets[more]
            if level < CACHED_SKIPS:
                sets[:, level] = place
        rest = np.concatenate([live, np.flatnonzero(size > CACHED_BYTES)])
        if len(rest):
            parts.append((rest, *self.segment(units(rest), key[rest])))
        count = np.zeros(len(start), dtype=np.int64)
        for unit, _, n in parts:
            count[unit] = n
        at = np.cumsum(count) - count
        ids = np.empty(int(count.sum()), dtype=np.int32)
        for unit, values, n in parts:
            ids[_runs(at[unit], n)] = values
        return ids, np.bincount(doc, count, minlength=t.n).astype(np.int64)

    def decode(self, ids: np.ndarray, n: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of all texts in a row, each still with the space put before it, and their length by text."""
        size = self.piece_n[ids]
        raw = gather(self.piece_pool, self.piece_at[ids], size)
        c = np.concatenate([[0], np.cumsum(size)])
        edge = np.concatenate([[0], np.cumsum(n)])
        return raw.tobytes(), c[edge[1:]] - c[edge[:-1]]


def codec(path: str, rate: float, seed: int) -> Codec:
    """One for each worker process and setting."""
    k = (path, rate, seed)
    if k not in _loaded:
        _loaded.clear()
        _loaded[k] = Codec(path, rate, seed)
    return _loaded[k]


def _texts(t: Texts) -> list[bytes]:
    raw = t.buf.tobytes()
    return [raw[s:e] for s, e in zip(t.start.tolist(), t.end.tolist(), strict=True)]


def encode(docs: DataFrame, path: str, rate: float = RATE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column and ids array<int>."""

    def fn(t: Texts) -> dict:
        ids, n = codec(path, rate, seed).encode(_texts(t))
        return {"ids": ragged(ids, n)}

    return text_map(docs, [id_col], text_col, "ids array<int>", fn, BLOCK_BYTES)


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id column and the text of each list of ids; null ids give the empty text."""
    schema = f"{id_col} {rows.schema[id_col].dataType.simpleString()}, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path, RATE, SEED)
        for b in batches:
            lists = b.column(1)
            n = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            raw, size = model.decode(lists.flatten().to_numpy(), n)
            ends = np.cumsum(size)
            out = [raw[e - s + 1 : e].decode("utf-8", "replace") if s else "" for s, e in zip(size.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[id_col, "text"])

    return rows.select(id_col, ids_col).mapInArrow(run, schema)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: number and crc32 of its ids (little-endian unsigned 32-bit), crc32 of the text decoded from
    them, and whether that is the document's text. The text column itself is left to encode() and decode()."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")

    def fn(t: Texts) -> dict:
        model, texts = codec(path, RATE, SEED), _texts(t)
        ids, n = model.encode(texts)
        raw, size = model.decode(ids, n)
        wire, edge, ends = ids.astype("<u4").tobytes(), np.cumsum(n) * 4, np.cumsum(size)
        back = [raw[e - s + 1 : e] if s else b"" for s, e in zip(size.tolist(), ends.tolist(), strict=True)]
        return {
            "n_ids": n,
            "ids_crc32": np.array([zlib.crc32(wire[e - 4 * k : e]) for k, e in zip(n.tolist(), edge.tolist(), strict=True)], dtype=np.int64),
            "decoded_crc32": np.array([zlib.crc32(x) for x in back], dtype=np.int64),
            "lossless": np.array([x == y for x, y in zip(back, texts, strict=True)], dtype=bool),
        }

    docs = read_table(spark, sf_dir, "documents")
    return text_map(docs, ["doc_id"], "text", "n_ids long, ids_crc32 long, decoded_crc32 long, lossless boolean", fn, BLOCK_BYTES)


QUERIES = {"op10_sentencepiece": op10_sentencepiece}
ORACLES: dict[str, str] = {}
