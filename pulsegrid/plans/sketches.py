"""Sketches that a state holds instead of sets and counts of ids: their size does not grow with the ids."""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache


@lru_cache(1 << 14)
def hashed(value) -> int:
    """The first 64 bits of the MD5 of a value's text (null: empty), as SQL has them too."""
    text = "" if value is None else str(value)
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "little")


class Distinct:
    """Number of distinct values by 2^p registers (p from 4 to 16), each the largest rank of a hash's first set bit.

    ``add`` keeps the registers' sum up to date, so that a count costs nothing. Few values are counted by the
    registers left empty. The standard error is 1.04 / sqrt(2^p).
    """

    __slots__ = ("p", "registers", "empty", "sum")

    def __init__(self, p: int = 12, registers: bytes | None = None):
        self.p = min(max(p, 4), 16)
        self.registers = bytearray(registers or 1 << self.p)
        empty = not registers  # all ones: told apart, as every id's habits begin with two of these
        self.empty, self.sum = self.registers.count(0), float(1 << self.p) if empty else sum(2.0**-r for r in self.registers)

    def add(self, value) -> None:
        h, rest = hashed(value), 64 - self.p
        i, rank = h >> rest, rest + 1 - (h & ((1 << rest) - 1)).bit_length()
        old = self.registers[i]
        if rank > old:
            self.registers[i] = rank
            self.sum += 2.0**-rank - 2.0**-old
            self.empty -= old == 0

    def count(self) -> float:
        m = 1 << self.p
        bias = {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))
        raw = bias * m * m / self.sum
        return m * math.log(m / self.empty) if raw <= 2.5 * m and self.empty else raw

    def merged(self, other: Distinct) -> Distinct:
        """The sketch of both inputs together."""
        if self.p != other.p:
            raise ValueError("sketches of different sizes can't be merged")
        return Distinct(self.p, bytes(map(max, self.registers, other.registers)))


class CountMin:
    """Counts of values in ``depth`` rows of ``width`` cells; an estimate is never below the true count.

    A value raises only those of its cells that are at its estimate, which keeps collisions small. Merged sketches
    add cell by cell and are still never below.
    """

    __slots__ = ("width", "depth", "cells")

    def __init__(self, width: int = 64, depth: int = 4):
        self.width, self.depth, self.cells = width, depth, [0] * (width * depth)

    def _at(self, value) -> list[int]:
        # Rows by two halves of one hash, as good as a hash a row.
        h = hashed(value)
        a, b = h >> 32, (h & 0xFFFFFFFF) | 1
        return [r * self.width + (a + r * b) % self.width for r in range(self.depth)]

    def add(self, value) -> int:
        """Count a value; its estimate before."""
        at = self._at(value)
        least = min(self.cells[i] for i in at)
        for i in at:
            if self.cells[i] == least:
                self.cells[i] += 1
        return least

    def estimate(self, value) -> int:
        return min(self.cells[i] for i in self._at(value))

    def __contains__(self, value) -> bool:
        return self.estimate(value) > 0

    def merged(self, other: CountMin) -> CountMin:
        if (self.width, self.depth) != (other.width, other.depth):
            raise ValueError("sketches of different sizes can't be merged")
        out = CountMin(self.width, self.depth)
        out.cells = [a + b for a, b in zip(self.cells, other.cells, strict=True)]
        return out
