"""The linear congruential generator that the Java platform documents, for shuffles that must be repeatable."""

from __future__ import annotations

from collections.abc import MutableSequence

_MASK = (1 << 48) - 1
_FACTOR, _STEP = 0x5DEECE66D, 0xB  # fixed values of the published generator


class JavaRandom:
    def __init__(self, seed: int):
        self.state = (seed ^ _FACTOR) & _MASK

    def bits(self, n: int) -> int:
        """The next n bits as a signed number."""
        self.state = (self.state * _FACTOR + _STEP) & _MASK
        value = self.state >> (48 - n)
        return value - (1 << n) if n == 32 and value >= 1 << 31 else value

    def below(self, bound: int) -> int:
        if bound & -bound == bound:
            return bound * self.bits(31) >> 31
        while True:
            drawn = self.bits(31)
            value = drawn % bound
            if drawn - value + bound - 1 < 1 << 31:
                return value

    def double(self) -> float:
        return ((self.bits(26) << 27) + self.bits(27)) / (1 << 53)

    def shuffle(self, items: MutableSequence) -> None:
        for size in range(len(items), 1, -1):
            other = self.below(size)
            items[size - 1], items[other] = items[other], items[size - 1]
