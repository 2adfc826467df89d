"""Order-keeping alignment of two sequences of lines.

Equal lines at both ends are matched. In what is left, lines that occur once on each side are anchors; the longest run of
anchors that rises on both sides is kept, and each gap between its anchors is aligned in the same way. A gap without such
lines pairs the first occurrence of a line with the first, the second with the second, and keeps the longest rising run of
these. Time is about n log n per level of gaps, memory linear.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Hashable, Sequence


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first number, whose second numbers rise."""
    tails: list[int] = []  # smallest last second number of a run of each length
    ends: list[int] = []  # the pair it belongs to
    before = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        length = bisect_left(tails, j)
        before[n] = ends[length - 1] if length else -1
        if length == len(tails):
            tails.append(j)
            ends.append(n)
        else:
            tails[length], ends[length] = j, n
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def _places(lines: Sequence[Hashable], start: int, end: int) -> dict[Hashable, list[int]]:
    out: dict[Hashable, list[int]] = {}
    for n in range(start, end):
        out.setdefault(lines[n], []).append(n)
    return out


def matches(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int]]:
    """Pairs of equal lines, rising on both sides."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a1, a2, b1, b2 = todo.pop()
        while a1 < a2 and b1 < b2 and a[a1] == b[b1]:
            out.append((a1, b1))
            a1, b1 = a1 + 1, b1 + 1
        while a1 < a2 and b1 < b2 and a[a2 - 1] == b[b2 - 1]:
            a2, b2 = a2 - 1, b2 - 1
            out.append((a2, b2))
        if a1 == a2 or b1 == b2:
            continue
        old, new = _places(a, a1, a2), _places(b, b1, b2)
        once = [(x[0], new[line][0]) for line, x in old.items() if len(x) == 1 and len(new.get(line, ())) == 1]
        anchors = _rising(once or sorted(pair for line, x in old.items() for pair in zip(x, new.get(line, ()), strict=False)))
        out += anchors
        for i, j in [*anchors, (a2, b2)] if anchors else ():
            todo.append((a1, i, b1, j))
            a1, b1 = i + 1, j + 1
    return sorted(out)


def changed_blocks(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int, int, int]]:
    """``(a1, a2, b1, b2)`` for each stretch a[a1:a2] that b[b1:b2] replaces; one of the two may be empty."""
    out, i, j = [], 0, 0
    for x, y in [*matches(a, b), (len(a), len(b))]:
        if x > i or y > j:
            out.append((i, x, j, y))
        i, j = x + 1, y + 1
    return out
