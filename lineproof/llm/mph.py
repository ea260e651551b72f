"""Minimal perfect hash over 64-bit hashes: one bit array a level; keys that collide go to the next level."""

from __future__ import annotations

import numpy as np

GAMMA = 2.0
MAX_LEVELS = 64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, by its public constants."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class MinimalPerfectHash:
    """index(keys) gives each built key its own number below n; other keys get any number or -1."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
        self.n = int(self.rank[-1])

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(keys + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        """keys: distinct uint64."""
        sizes, parts, left = [], [], keys
        while len(left):
            if len(sizes) == MAX_LEVELS:
                raise ValueError("keys are not distinct")
            size = max(8, int(GAMMA * len(left)))
            at = cls.place(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(alone)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, bool))

    def index(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_rows = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_rows):
                break
            at = self.place(keys[open_rows], level, size) + self.starts[level]
            hit = self.bits[at]
            out[open_rows[hit]] = self.rank[at[hit]]
            open_rows = open_rows[~hit]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.sizes), *self.sizes], dtype="<i8")
        return head.tobytes() + np.packbits(self.bits).tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> MinimalPerfectHash:
        levels = int(np.frombuffer(raw, "<i8", 1)[0])
        sizes = np.frombuffer(raw, "<i8", levels, 8).tolist()
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, offset=8 + 8 * levels), count=sum(sizes)).astype(bool)
        return cls(sizes, bits)
