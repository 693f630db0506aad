"""Id sequences by 64-bit key in bounded memory: a table with a slot for each key remainder over a pool of ids."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class WordCache:
    """A later key takes its slot; the pool is emptied when full. What was lost is computed again. A slot is only taken for
    a key's own if a second, independent hash agrees too."""

    def __init__(self, slots: int = 1 << 21, pool: int = 1 << 24, dtype: type = np.uint16):
        self.slots, self.pool = slots, np.zeros(pool, dtype=dtype)
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(self.slots, dtype=np.uint64)
        self.check = np.zeros(self.slots, dtype=np.uint32)
        self.at = np.zeros(self.slots, dtype=np.int32)
        self.n = np.zeros(self.slots, dtype=np.int32)
        self.used = 0

    def get(self, keys: np.ndarray, check: np.ndarray, compute: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pool, place and number of ids of distinct keys. compute gets the positions of keys that are not here and
        returns their ids in a row and the number for each; sequences without ids are not kept."""
        slot, check = (keys % np.uint64(self.slots)).astype(np.int64), check.astype(np.uint32)
        new = np.flatnonzero((self.key[slot] != keys) | (self.check[slot] != check) | (self.n[slot] == 0))
        at, n, pool = self.at[slot].astype(np.int64), self.n[slot].astype(np.int64), self.pool
        if not len(new):
            return pool, at, n
        ids, count = compute(new)
        begin = np.cumsum(count) - count
        n[new] = count
        if self.used + len(ids) <= len(self.pool):
            self.pool[self.used : self.used + len(ids)] = ids
            at[new] = self.used + begin
            self.used += len(ids)
            self.key[slot[new]], self.check[slot[new]], self.at[slot[new]], self.n[slot[new]] = keys[new], check[new], at[new], count
        else:  # this call's ids from a copy, and an empty table for the next
            pool = np.concatenate([self.pool, ids.astype(self.pool.dtype)])
            at[new] = len(self.pool) + begin
            self.clear()
        return pool, at, n


def gather(pool: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs pool[at : at + n], in a row."""
    begin = np.cumsum(n) - n
    return pool[np.repeat(at - begin, n) + np.arange(int(n.sum()))]
