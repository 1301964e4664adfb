"""Sorting suffixes deep-shallow: multikey quicksort at first, blind tries for what stays equal for long.

Quicksort compares eight bytes at a time and parts a set into less, equal and greater; the equal ones go on
with the next eight bytes.  Sets that are still equal after ``SHALLOW`` bytes would be compared again and again over their long
common prefix.  They are inserted into a blind trie instead: it branches at single bytes and is descended without
looking at what lies between, so an insertion compares whole strings once.
"""

from __future__ import annotations

from bisect import bisect_left

from auditloom.llm.tries import shared

WORD = 8
SHALLOW = 64


class _Branch:
    __slots__ = ("depth", "kids", "some")

    def __init__(self, depth: int, kids: dict, some: int):
        self.depth, self.kids, self.some = depth, kids, some


class BlindTrie:
    """Strings that agree on their first ``depth`` bytes, by index.  A leaf is a list of the indices of equal strings."""

    def __init__(self, strings: list[bytes], depth: int = 0):
        self.strings, self.depth, self.root = strings, depth, None

    def _turn(self, i: int, depth: int) -> int:
        s = self.strings[i]
        return s[depth] if depth < len(s) else -1

    def insert(self, i: int) -> None:
        if self.root is None:
            self.root = [i]
            return
        path, at = [], self.root
        while isinstance(at, _Branch):
            path.append(at)
            kid = at.kids.get(self._turn(i, at.depth))
            if kid is None:
                break
            at = kid
        other = at.some if isinstance(at, _Branch) else at[0]
        s, t = self.strings[i], self.strings[other]
        d = shared(s, t, self.depth)
        if d == len(s) == len(t):
            at.append(i)
            return
        above, below = None, at
        for b in path:
            if b.depth >= d:
                below = b
                break
            above = b
        if isinstance(below, _Branch) and below.depth == d:
            below.kids[self._turn(i, d)] = [i]
            return
        new = _Branch(d, {self._turn(i, d): [i], self._turn(other, d): below}, i)
        if above is None:
            self.root = new
        else:
            above.kids[self._turn(i, above.depth)] = new

    def sorted(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            at = stack.pop()
            if isinstance(at, _Branch):
                stack += [at.kids[k] for k in sorted(at.kids, reverse=True)]
            else:
                out += at
        return out


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Indices of ``strings`` in byte order, a prefix before what it begins."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        some, depth = stack.pop()
        if len(some) < 2:
            out += some
        elif depth >= shallow:
            trie = BlindTrie(strings, depth)
            for i in some:
                trie.insert(i)
            out += trie.sorted()
        else:
            parts = [strings[i][depth:depth + WORD] for i in some]
            pivot = parts[len(parts) // 2]
            stack.append(([i for i, p in zip(some, parts) if p > pivot], depth))
            equal = [i for i, p in zip(some, parts) if p == pivot]
            if len(pivot) < WORD:  # these strings end here, so they are the same
                stack += [([i], depth) for i in reversed(equal)]
            else:
                stack.append((equal, depth + WORD))
            stack.append(([i for i, p in zip(some, parts) if p < pivot], depth))
    return out


def meetings(left: list[bytes], right: list[bytes], length: int, least: int) -> list[list[tuple[int, int]]]:
    """For strings that are cut at a mark: which windows of ``length`` bytes around the mark another string has too.

    ``left`` is what precedes the mark, read backwards, ``right`` what follows; a window that begins ``k`` bytes before the mark
    is given as ``k``, in ranges.  Strings meet only where at least ``least`` bytes after the mark agree.

    Strings are joined to sets by falling agreement of neighbours in the order of ``right``.  When two sets meet at an
    agreement of ``d`` bytes, each string of the smaller set is placed among those of the larger one in the order of
    ``left``: its neighbours there agree with it furthest to the left, say ``k`` bytes, and the windows ``length - d`` to
    ``k`` are common.
    """
    by_right, by_left = deep_shallow(right), deep_shallow(left)
    rank = [0] * len(left)
    for r, i in enumerate(by_left):
        rank[i] = r
    found: list[list[tuple[int, int]]] = [[] for _ in left]
    agree = [shared(right[i], right[j]) for i, j in zip(by_right, by_right[1:])]
    owner = list(range(len(by_right)))
    members = [[rank[i]] for i in by_right]

    def top(k: int) -> int:
        while owner[k] != k:
            owner[k] = owner[owner[k]]
            k = owner[k]
        return k

    for k in sorted((k for k, d in enumerate(agree) if d >= least), key=lambda k: -agree[k]):
        d, a, b = agree[k], top(k), top(k + 1)
        if len(members[a]) < len(members[b]):
            a, b = b, a
        large = members[a]
        for r in members[b]:
            at = bisect_left(large, r)
            for near in large[max(0, at - 1):at + 1]:
                x, y = by_left[r], by_left[near]
                n = shared(left[x], left[y])
                if n + d >= length:
                    found[x].append((length - d, n))
                    found[y].append((length - d, n))
            large.insert(at, r)
        owner[b], members[b] = a, []
    return found
