"""Compressed bitmaps over integer codes: one container per range of 65,536 codes, a sorted list of
16-bit offsets while it is sparse and 8 KiB of packed bits once that is smaller."""

from __future__ import annotations

import numpy as np

RANGE_BITS = 16
SPARSE_LIMIT = 4096  # offsets; 2 bytes each, so a list above this is larger than the 8 KiB of bits


def _pack(offsets: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << RANGE_BITS, dtype=bool)
    bits[offsets] = True
    return np.packbits(bits)


def _offsets(container: np.ndarray) -> np.ndarray:
    if container.dtype == np.uint16:
        return container
    return np.flatnonzero(np.unpackbits(container)).astype(np.uint16)


def _smallest(offsets: np.ndarray) -> np.ndarray:
    return offsets.astype(np.uint16) if len(offsets) <= SPARSE_LIMIT else _pack(offsets)


class RangeBitmap:
    """A set of codes. Containers are keyed by ``code >> 16`` (the key range)."""

    def __init__(self, containers: dict[int, np.ndarray] | None = None):
        self.containers = containers or {}

    @classmethod
    def of(cls, codes: np.ndarray) -> RangeBitmap:
        codes = np.unique(np.asarray(codes, dtype=np.int64))
        ranges = codes >> RANGE_BITS
        starts = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]]) if len(codes) else np.array([], dtype=int)
        ends = np.r_[starts[1:], len(codes)] if len(codes) else starts
        low = (codes & 0xFFFF).astype(np.uint16)
        return cls({int(ranges[a]): _smallest(low[a:b]) for a, b in zip(starts, ends)})

    def and_not(self, other: RangeBitmap) -> RangeBitmap:
        out = {}
        for key, mine in self.containers.items():
            theirs = other.containers.get(key)
            if theirs is None:
                out[key] = mine
                continue
            if mine.dtype == np.uint16:
                if theirs.dtype == np.uint16:
                    left = np.setdiff1d(mine, theirs, assume_unique=True)
                else:
                    left = mine[(theirs[mine >> 3] >> (7 - (mine & 7)).astype(np.uint8)) & 1 == 0]
            else:
                left = _offsets(mine & ~(theirs if theirs.dtype == np.uint8 else _pack(theirs)))
            if len(left):
                out[key] = _smallest(left)
        return RangeBitmap(out)

    def union(self, other: RangeBitmap) -> RangeBitmap:
        out = dict(self.containers)
        for key, theirs in other.containers.items():
            mine = out.get(key)
            out[key] = theirs if mine is None else _smallest(np.union1d(_offsets(mine), _offsets(theirs)))
        return RangeBitmap(out)

    def decode(self) -> np.ndarray:
        parts = [(np.int64(k) << RANGE_BITS) + _offsets(c).astype(np.int64) for k, c in sorted(self.containers.items())]
        return np.concatenate(parts) if parts else np.array([], dtype=np.int64)

    def __len__(self) -> int:
        return sum(len(c) if c.dtype == np.uint16 else int(np.unpackbits(c).sum()) for c in self.containers.values())

    def nbytes(self) -> int:
        return sum(c.nbytes for c in self.containers.values())
