"""Suffix sorting by linear grouping, and the longest common prefixes of neighbours."""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """The starts of a string's suffixes in order; symbols are whole numbers from 0 on, in proportion to the length.

    First all suffixes stand in groups by their first symbol.  From the
    greatest group down, each member finds the nearest place before it that
    stands in a lower group (following the pointers found so far), and the
    places so found move up behind the rest of their own group, those with
    more members pointing to them further.  Then every group's suffixes share
    a Lyndon prefix, and one pass from the least suffix up emits each group's
    order along the same pointers; nothing is renamed, and nothing is sorted by
    comparison.
    """
    n = len(text)
    order, place, head, size = _by_first_symbol(text)
    before = [OPEN] * (n + 1)
    _group(n, order, place, head, size, before)
    return _emit(n, head, before)[1:]


#: In place of a pointer: not found yet.
OPEN = -2


def _by_first_symbol(text: Sequence[int]):
    """Order, place, group head and group sizes, by counting; the empty suffix, below all, has the first group."""
    n = len(text)
    ends = [0] * (max(text, default=0) + 2)
    for c in text:
        ends[c + 1] += 1
    ends[0] = 1
    for c in range(1, len(ends)):
        ends[c] += ends[c - 1]
    heads = ends[:]
    order, place, head, size = [n] * (n + 1), [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    size[0] = 1
    for at, c in enumerate(text):
        order[ends[c]], place[at], head[at] = at, ends[c], heads[c]
        size[heads[c]] += 1
        ends[c] += 1
    return order, place, head, size


def _group(n, order, place, head, size, before) -> None:
    end = n + 1
    while end > 1:
        first = head[order[end - 1]]
        members = order[first:end]
        pointed: dict[int, int] = {}
        for member in members:
            open_ = [(member, member - 1)]
            while open_:  # members of the same group before it come first
                i, j = open_.pop()
                while j >= 0 and head[j] >= first:
                    if before[j] == OPEN:
                        open_ += [(i, j), (j, j - 1)]
                        break
                    j = before[j]
                else:
                    before[i] = j
        for i in members:
            j = before[i]
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        end = first
        if not pointed:
            continue
        by_count: list[list[int]] = [[] for _ in range(max(pointed.values()) + 1)]
        for j, c in pointed.items():
            by_count[c].append(j)
        for moved in reversed(by_count):
            for j in moved:  # to the end of its group, which shrinks
                g = head[j]
                size[g] -= 1
                to, other = g + size[g], order[g + size[g]]
                order[place[j]], place[other] = other, place[j]
                order[to], place[j] = j, to
            fresh = {head[j]: head[j] + size[head[j]] for j in moved}
            for j in moved:
                head[j] = fresh[head[j]]
                size[head[j]] += 1


def _emit(n, head, before) -> list[int]:
    out, free, done = [-1] * (n + 1), list(range(n + 1)), [False] * (n + 1)
    out[0], done[n] = n, True
    for k in range(n + 1):
        at = out[k] - 1
        while at >= 0 and not done[at]:
            g = head[at]
            out[free[g]] = at
            free[g] += 1
            done[at] = True
            at = before[at]
    return out


def neighbours(text: Sequence[int], order: list[int]) -> list[int]:
    """For each suffix, by its start, the longest prefix it shares with any other suffix."""
    n = len(text)
    rank = [0] * n
    for k, at in enumerate(order):
        rank[at] = k
    longest, shared = [0] * n, 0
    for at in range(n):
        k = rank[at]
        if not k:
            shared = 0
            continue
        other = order[k - 1]
        limit = n - max(at, other)
        while shared < limit and text[at + shared] == text[other + shared]:
            shared += 1
        longest[at] = max(longest[at], shared)
        longest[other] = max(longest[other], shared)
        shared = max(0, shared - 1)
    return longest
