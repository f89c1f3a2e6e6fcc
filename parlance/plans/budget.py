"""Character budgets of what the verbs print: plain Python over bounded, collected output."""

from __future__ import annotations

from collections.abc import Callable

#: The least characters that a cut message keeps.
FLOOR = 200


def cut_to_budget(sizes: list[int], budget: int, head: int = 0) -> int:
    """How many of the records fit, in order, after a head of so many characters."""
    used = head
    for k, size in enumerate(sizes):
        used += size
        if used > budget:
            return k
    return len(sizes)


def full_budget(sizes: list[int], head: Callable[[int], int]) -> int:
    """The least budget for all records, where the head names that budget: its digits count, too."""
    want, have = sum(sizes) + head(0), -1
    while want != have:
        have, want = want, sum(sizes) + head(want)
    return want


def grow_around(sizes: list[int], budget: int, focus: int = 0) -> list[int]:
    """Places of the records that fit: the focus, then by turns the one before and the one after.

    A side whose next record doesn't fit ends; the focus is kept, whatever its size.
    """
    if not sizes:
        return []
    first = last = focus
    used, sides = sizes[focus], [True, True]
    while any(sides):
        for k in (0, 1):
            at = first - 1 if k == 0 else last + 1
            if not sides[k] or not 0 <= at < len(sizes) or used + sizes[at] > budget:
                sides[k] = False
                continue
            used += sizes[at]
            first, last = (at, last) if k == 0 else (first, at)
    return list(range(first, last + 1))


def fair_shares(sizes: list[int], budget: int, floor: int = FLOOR) -> list[int]:
    """How much of each body is kept: bodies are served from the smallest on, each with its floor and an
    equal share of what is left, so what short ones don't need goes to the long ones.

    Without room for all floors each gets an equal share of the budget.
    """
    floors = [min(s, floor) for s in sizes]
    fits = sum(floors) <= budget
    extra = budget - sum(floors) if fits else budget
    out = [0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda k: sizes[k])
    for done, k in enumerate(order):
        own = floors[k] if fits else 0
        out[k] = min(sizes[k], own + extra // (len(order) - done))
        extra -= out[k] - own
    return out


def keep_tail(sizes: list[int], budget: int) -> int:
    """The place of the first record that is kept when as many as fit are kept from the end."""
    return len(sizes) - cut_to_budget(sizes[::-1], budget)


def enough(has_hit: list[bool], wanted: int) -> int:
    """How many ranked sessions have to be read until so many had a hit."""
    seen = 0
    for k, hit in enumerate(has_hit):
        seen += hit
        if seen >= wanted:
            return k + 1
    return len(has_hit)
