"""Compressed sets of ordinals.

An ordinal's high bits name a container of 65,536 places; a container is stored as a sorted array of 16-bit values
while it holds at most 4,096 of them, and as 8 KB of bits beyond that. Set operations work container by container.
"""

from __future__ import annotations

import numpy as np

SPAN = 1 << 16
ARRAY_MOST = 4096


def _pack(low: np.ndarray) -> np.ndarray:
    """A container of sorted, distinct values below SPAN: uint16 values, or uint8 bits."""
    if len(low) <= ARRAY_MOST:
        return low.astype(np.uint16)
    bits = np.zeros(SPAN, np.bool_)
    bits[low] = True
    return np.packbits(bits)


def _unpack(container: np.ndarray) -> np.ndarray:
    """The container as SPAN booleans."""
    if container.dtype == np.uint8:
        return np.unpackbits(container).view(np.bool_)
    bits = np.zeros(SPAN, np.bool_)
    bits[container] = True
    return bits


class Bitmap:
    """A set of non-negative ordinals."""

    def __init__(self, containers: dict[int, np.ndarray] | None = None):
        self.containers = containers or {}

    @classmethod
    def of(cls, ordinals: np.ndarray) -> Bitmap:
        ordinals = np.unique(np.asarray(ordinals, np.int64))
        high = ordinals >> 16
        starts = np.flatnonzero(np.r_[True, high[1:] != high[:-1]]) if len(high) else np.array([], np.int64)
        parts = np.split(ordinals & (SPAN - 1), starts[1:]) if len(high) else []
        return cls({int(high[s]): _pack(p) for s, p in zip(starts, parts)})

    def _with(self, other: Bitmap, keep_alone: bool, op) -> Bitmap:
        out = {}
        for key, mine in self.containers.items():
            theirs = other.containers.get(key)
            if theirs is None:
                if keep_alone:
                    out[key] = mine
                continue
            low = np.flatnonzero(op(_unpack(mine), _unpack(theirs)))
            if len(low):
                out[key] = _pack(low)
        return Bitmap(out)

    def and_not(self, other: Bitmap) -> Bitmap:
        return self._with(other, True, lambda a, b: a & ~b)

    def __and__(self, other: Bitmap) -> Bitmap:
        return self._with(other, False, lambda a, b: a & b)

    def __len__(self) -> int:
        return sum(len(c) if c.dtype == np.uint16 else int(np.unpackbits(c).sum()) for c in self.containers.values())

    def ordinals(self) -> np.ndarray:
        """All members in order."""
        parts = [(k << 16) + (c.astype(np.int64) if c.dtype == np.uint16 else np.flatnonzero(_unpack(c))) for k, c in sorted(self.containers.items())]
        return np.concatenate(parts) if parts else np.array([], np.int64)
