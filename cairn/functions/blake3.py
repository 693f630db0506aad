"""BLAKE3 from its specification, in NumPy: all chunks of a part at once, parts as a stream or in any place, then their tree."""

from __future__ import annotations

import numpy as np

CHUNK = 1024
PART = CHUNK << 10  # bytes of a part: a power of two of chunks
_IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], dtype=np.uint32)
_ORDER = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
_START, _END, _PARENT, _ROOT = 1, 2, 4, 8


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return x >> np.uint32(n) | x << np.uint32(32 - n)


def _compress(cv: np.ndarray, words: np.ndarray, counter: np.ndarray, size: int, flags: int) -> np.ndarray:
    """Columns are independent: cv (8, n), words (16, n), counter (n)."""
    a, b, c = cv[:4], cv[4:], np.repeat(_IV[:4, None], cv.shape[1], axis=1)
    d = np.stack([counter.astype(np.uint32), (counter >> np.uint64(32)).astype(np.uint32), np.full(len(counter), size, np.uint32), np.full(len(counter), flags, np.uint32)])
    for r in range(7):
        for half in (0, 8):
            if half:
                b, c, d = b[[1, 2, 3, 0]], c[[2, 3, 0, 1]], d[[3, 0, 1, 2]]
            for i, (p, q) in enumerate(((16, 12), (8, 7))):
                a = a + b + words[half + i : half + 8 : 2]
                d = _turn(d ^ a, p)
                c = c + d
                b = _turn(b ^ c, q)
            if half:
                b, c, d = b[[3, 0, 1, 2]], c[[2, 3, 0, 1]], d[[1, 2, 3, 0]]
        words = words[_ORDER] if r < 6 else words
    return np.concatenate([a ^ c, b ^ d])


def _chunks(raw: bytes, first: int, last: int) -> np.ndarray:
    """Chaining values (8, n) of the chunks of raw; last is a flag for a chunk that is all there is."""
    n = len(raw) // CHUNK
    out = []
    if n:
        words = np.frombuffer(raw, dtype="<u4", count=n * CHUNK // 4).reshape(n, 16, 16).transpose(1, 2, 0)
        cv, counter = np.repeat(_IV[:, None], n, axis=1), first + np.arange(n, dtype=np.uint64)
        for i in range(16):
            cv = _compress(cv, words[i], counter, 64, _START * (i == 0) | (_END | last) * (i == 15))
        out.append(cv)
    tail = raw[n * CHUNK :]
    if tail or not n:
        cv, counter = _IV[:, None], np.array([first + n], dtype=np.uint64)
        blocks = [tail[i : i + 64] for i in range(0, len(tail), 64)] or [b""]
        for i, x in enumerate(blocks):
            words = np.frombuffer(x.ljust(64, b"\0"), dtype="<u4")[:, None]
            cv = _compress(cv, words, counter, len(x), _START * (i == 0) | (_END | last) * (i == len(blocks) - 1))
        out.append(cv)
    return np.concatenate(out, axis=1)


def _tree(cv: np.ndarray, root: bool) -> bytes:
    while (n := cv.shape[1]) > 1:
        pairs = np.concatenate([cv[:, 0 : n - 1 : 2], cv[:, 1:n:2]])
        up = _compress(np.repeat(_IV[:, None], n // 2, axis=1), pairs, np.zeros(n // 2, dtype=np.uint64), 64, _PARENT | _ROOT * (root and n == 2))
        cv = np.concatenate([up, cv[:, n - 1 :]], axis=1) if n % 2 else up
    return cv[:, 0].astype("<u4").tobytes()


def part_value(raw: bytes, part: int) -> bytes:
    """Chaining value of the part of that number: PART bytes, or fewer at the end of data of several parts."""
    return _tree(_chunks(raw, part * (PART // CHUNK), 0), False)


def whole_value(raw: bytes) -> bytes:
    """Digest of data of one part."""
    return _tree(_chunks(raw, 0, _ROOT if len(raw) <= CHUNK else 0), True)


def join_parts(values: list[bytes]) -> bytes:
    """Digest from the values of two parts or more, in order."""
    return _tree(np.stack([np.frombuffer(v, dtype="<u4").astype(np.uint32) for v in values], axis=1), True)


class Blake3:
    """Streaming digest; holds a part, and 32 bytes of each part before it."""

    def __init__(self) -> None:
        self.rest, self.values = bytearray(), []

    def update(self, raw: bytes) -> Blake3:
        self.rest += raw
        while len(self.rest) > PART:  # the last part stays: it may be the only one
            self.values.append(part_value(bytes(self.rest[:PART]), len(self.values)))
            del self.rest[:PART]
        return self

    def digest(self) -> bytes:
        rest = bytes(self.rest)
        return join_parts([*self.values, part_value(rest, len(self.values))]) if self.values else whole_value(rest)


def blake3(data: bytes) -> bytes:
    """BLAKE3 digest (32 bytes)."""
    return Blake3().update(data).digest()
