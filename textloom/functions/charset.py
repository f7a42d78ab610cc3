"""Sets of symbols as sorted disjoint ranges: the predicates of the language."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass

TOP = 0x10FFFF


@dataclass(frozen=True)
class CharSet:
    """A set of code points (or bytes); `ranges` are sorted, disjoint and not adjacent."""

    ranges: tuple[tuple[int, int], ...]

    @staticmethod
    def of(pairs: Iterable[tuple[int, int]]) -> CharSet:
        out: list[list[int]] = []
        for low, high in sorted(p for p in pairs if p[0] <= p[1]):
            if out and low <= out[-1][1] + 1:
                out[-1][1] = max(out[-1][1], high)
            else:
                out.append([low, high])
        return CharSet(tuple((a, b) for a, b in out))

    @staticmethod
    def only(*symbols: str | int) -> CharSet:
        codes = [ord(s) if isinstance(s, str) else s for s in symbols]
        return CharSet.of((c, c) for c in codes)

    def __contains__(self, code: int) -> bool:
        at = bisect_right(self.ranges, (code, TOP + 1)) - 1
        return at >= 0 and self.ranges[at][0] <= code <= self.ranges[at][1]

    def __or__(self, other: CharSet) -> CharSet:
        return CharSet.of([*self.ranges, *other.ranges])

    def __and__(self, other: CharSet) -> CharSet:
        return ~(~self | ~other)

    def __invert__(self) -> CharSet:
        out, at = [], 0
        for low, high in self.ranges:
            out.append((at, low - 1))
            at = high + 1
        return CharSet.of([*out, (at, TOP)])

    def __sub__(self, other: CharSet) -> CharSet:
        return self & ~other

    def __le__(self, other: CharSet) -> bool:
        return not (self - other).ranges

    def __len__(self) -> int:
        return sum(b - a + 1 for a, b in self.ranges)

    def __bool__(self) -> bool:
        return bool(self.ranges)

    @property
    def low(self) -> int:
        return self.ranges[0][0]

    @property
    def high(self) -> int:
        return self.ranges[-1][1]

    def rank(self, code: int) -> int:
        """Place of a member in the set."""
        before = 0
        for low, high in self.ranges:
            if low <= code <= high:
                return before + code - low
            before += high - low + 1
        raise ValueError(f"{code} is not in the set")

    def member(self, rank: int) -> int:
        """The member at a place."""
        for low, high in self.ranges:
            if rank <= high - low:
                return low + rank
            rank -= high - low + 1
        raise IndexError("the set has fewer members")

    def java(self) -> str:
        """The set as a Java (and RE2) character class."""
        if self == ANY:
            return r"[\x{0}-\x{10FFFF}]"
        inside = "".join(_quoted(a) if a == b else f"{_quoted(a)}-{_quoted(b)}" for a, b in self.ranges)
        return _quoted(self.low) if len(self) == 1 else f"[{inside}]" if self.ranges else r"[^\x{0}-\x{10FFFF}]"


def _quoted(code: int) -> str:
    c = chr(code)
    return c if c.isalnum() and code < 128 else rf"\x{{{code:X}}}"


EMPTY = CharSet(())
ANY = CharSet(((0, TOP),))


def minterms(sets: Iterable[CharSet]) -> list[CharSet]:
    """The coarsest partition of all symbols in which each set is a union of parts."""
    parts = [ANY]
    for s in sets:
        parts = [p for part in parts for p in (part & s, part - s) if p]
    return parts
