"""A minimal perfect hash over 64-bit keys, with the keys kept by slot to tell strangers.

Keys are hashed into a bit array of twice their number; those alone on their bit stay there, the
others go on to a next, smaller array. A key's slot is the number of set bits before its own, over
all arrays, so slots run from 0 without gaps.
"""

from __future__ import annotations

import numpy as np

_WIDE = np.uint64


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser of shifts and multiplications; equal seeds give equal values everywhere."""
    x = x.astype(_WIDE) + _WIDE((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _WIDE(30))) * _WIDE(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _WIDE(27))) * _WIDE(0x94D049BB133111EB)
    return x ^ (x >> _WIDE(31))


class PerfectHash:
    def __init__(self, keys: np.ndarray):
        """`keys` are distinct."""
        rest = keys.astype(_WIDE)
        self.starts, self.sizes, marks, at = [], [], [], 0
        while len(rest):
            size = max(64, -(-2 * len(rest) // 64) * 64)
            pos = (mix(rest, len(self.sizes) + 1) % _WIDE(size)).astype(np.int64)
            alone = np.bincount(pos, minlength=size) == 1
            self.starts.append(at)
            self.sizes.append(size)
            marks.append(alone)
            at += size
            rest = rest[~alone[pos]]
        bits = np.concatenate(marks) if marks else np.zeros(0, bool)
        self.words = np.packbits(bits, bitorder="little").view(_WIDE)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]]) if len(ones) else np.zeros(0, np.int64)
        self.keys = np.zeros(len(keys), _WIDE)
        if len(keys):
            self.keys[self._places(keys.astype(_WIDE))] = keys

    def __len__(self) -> int:
        return len(self.keys)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        out, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (start, size) in enumerate(zip(self.starts, self.sizes, strict=True)):
            if not len(rest):
                break
            pos = (mix(keys[rest], level + 1) % _WIDE(size)).astype(np.int64) + start
            word, bit = self.words[pos >> 6], (pos & 63).astype(_WIDE)
            hit = (word >> bit) & _WIDE(1) == 1
            below = word & ((_WIDE(1) << bit) - _WIDE(1))
            out[rest[hit]] = (self.before[pos >> 6] + np.bitwise_count(below))[hit]
            rest = rest[~hit]
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for one that is not in the set."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        out = self._places(keys)
        return np.where((out >= 0) & (self.keys[out] == keys), out, -1)
