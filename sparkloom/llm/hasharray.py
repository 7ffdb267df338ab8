"""Sorted arrays of hashed keys with a bucket index: exact lookups of many keys at a time."""

from __future__ import annotations

import numpy as np


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads them evenly."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


class HashArray:
    """Keys to rows of values; keys are kept mixed and sorted, and a table of bucket starts by their top bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashed = mixed(keys)
        order = np.argsort(hashed)
        self.keys, self.values = hashed[order], values[order]
        self.bits = max(1, min(22, int(len(keys)).bit_length()))
        edges = np.arange((1 << self.bits) + 1, dtype=np.uint64) << np.uint64(64 - self.bits) if self.bits < 64 else None
        edges[-1] = np.uint64(0xFFFFFFFFFFFFFFFF)
        self.starts = np.searchsorted(self.keys, edges).astype(np.int32)
        self.starts[-1] = len(self.keys)
        self.deep = int(np.diff(self.starts).max()) if len(keys) else 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where it is not there."""
        out = np.full(len(keys), -1, dtype=np.int32)
        if not len(self.keys) or not len(keys):
            return out
        wanted = mixed(keys)
        bucket = (wanted >> np.uint64(64 - self.bits)).astype(np.int32)
        at, end = self.starts[bucket], self.starts[bucket + 1]
        todo = None
        for _ in range(self.deep):
            live = np.nonzero(at < end)[0]
            if todo is None:
                todo, at, end, wanted = live, at[live], end[live], wanted[live]
            else:
                todo, at, end, wanted = todo[live], at[live], end[live], wanted[live]
            if not len(todo):
                break
            hit = self.keys[at] == wanted
            out[todo[hit]] = at[hit]
            miss = ~hit
            todo, at, end, wanted = todo[miss], at[miss] + 1, end[miss], wanted[miss]
        return out


class Counts:
    """Counts of 64-bit keys that come in large arrays, merged as they come."""

    def __init__(self, most: int = 1 << 21):
        self.most, self.held, self.waiting = most, 0, []
        self.keys, self.counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(self, keys: np.ndarray) -> None:
        self.waiting.append(keys)
        self.held += len(keys)
        if self.held >= self.most:
            self.merge()

    def merge(self) -> None:
        if not self.waiting:
            return
        keys, counts = np.unique(np.concatenate(self.waiting), return_counts=True)
        both, n = np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts])
        order = np.argsort(both, kind="stable")
        both, n = both[order], n[order]
        first = np.nonzero(np.concatenate([[True], both[1:] != both[:-1]]))[0] if len(both) else np.zeros(0, dtype=np.int64)
        self.keys, self.counts = both[first], np.add.reduceat(n, first) if len(first) else n
        self.waiting, self.held = [], 0
