"""Signature trees over sets of hashes, joined by dual traversal.

Every node holds the OR of the token bitmaps below it, the range of set sizes, and the largest
surplus (tokens beyond set bits). Two nodes are visited together only while the largest overlap
that any of their members could have still reaches the smallest overlap a link needs.
"""

from __future__ import annotations

import numpy as np

LEAF = 16
FAN = 8


def width_for(n: int) -> int:
    """Bits of the bitmap of a set: four times its size or more, a power of two."""
    return min(1 << 18, max(256, 1 << max(0, 4 * n - 1).bit_length()))


def narrow_width(n: int) -> int:
    """A quarter of it, enough to tell sets apart that share up to half of their tokens."""
    return min(1 << 18, max(256, 1 << n.bit_length()))


def bitmap(members: np.ndarray, width: int) -> np.ndarray:
    """The tokens of a set as bits; folding one half onto the other gives that of half the width."""
    bits = np.zeros(width, bool)
    bits[(members & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    words = width // 64
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0) if len(bits) > words else bits


class _Node:
    __slots__ = ("bits", "least", "most", "surplus", "below", "members")

    def __init__(self, bits, least, most, surplus, below, members):
        self.bits, self.least, self.most, self.surplus = bits, least, most, surplus
        self.below, self.members = below, members


class Trees:
    """Signature trees over the bitmaps of some sets."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, percent: int) -> None:
        self.maps, self.sizes, self.percent = maps, sizes, percent
        self.surplus = sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)

    def tree(self, rows: list[int]) -> _Node:
        """Leaves hold sets of like size and, within a size, like bitmaps."""
        rows = sorted(rows, key=lambda i: (int(self.sizes[i]), int(self.maps[i, 0])))
        level = [self._leaf(rows[i:i + LEAF]) for i in range(0, len(rows), LEAF)]
        while len(level) > 1:
            level = [self._inner(level[i:i + FAN]) for i in range(0, len(level), FAN)]
        return level[0]

    def _leaf(self, rows: list[int]) -> _Node:
        at = np.array(rows)
        return _Node(np.bitwise_or.reduce(self.maps[at]), int(self.sizes[at].min()), int(self.sizes[at].max()),
                     int(self.surplus[at].max()), None, at)

    def _inner(self, below: list[_Node]) -> _Node:
        return _Node(np.bitwise_or.reduce([x.bits for x in below]), min(x.least for x in below),
                     max(x.most for x in below), max(x.surplus for x in below), below,
                     np.concatenate([x.members for x in below]))

    def _may_link(self, x: _Node, y: _Node) -> bool:
        """Whether any member of x could link with any member of y."""
        if 100 * min(x.most, y.most) < self.percent * max(x.least, y.least):
            return False
        common = int(np.bitwise_count(x.bits & y.bits).sum())
        most = min(x.most, y.most, common + min(x.surplus, y.surplus))
        # overlap * 100 >= percent * (sizes - overlap)
        return most * (100 + self.percent) >= self.percent * (x.least + y.least)

    def candidates(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of some sets that could link with set i."""
        common = np.bitwise_count(self.maps[i] & self.maps[others]).sum(axis=1, dtype=np.int64)
        most = np.minimum(np.minimum(self.sizes[i], self.sizes[others]), common + np.minimum(self.surplus[i], self.surplus[others]))
        return others[most * (100 + self.percent) >= self.percent * (self.sizes[i] + self.sizes[others])]

    def settled(self, x: _Node, y: _Node) -> bool:
        """Whether a pair of nodes has nothing left to find."""
        raise NotImplementedError

    def leaves(self, x: _Node, y: _Node) -> None:
        """What to do with a pair of leaves."""
        raise NotImplementedError

    def traverse(self, x: _Node, y: _Node) -> None:
        """Visits node pairs from the top while they may link and are not settled."""
        stack = [(x, y)]
        while stack:
            x, y = stack.pop()
            if not self._may_link(x, y) or self.settled(x, y):
                continue
            if x.below is None and y.below is None:
                self.leaves(x, y)
            elif x is y:
                stack.extend((x.below[i], x.below[j]) for j in range(len(x.below)) for i in range(j + 1))
            elif y.below is None or (x.below is not None and len(x.members) >= len(y.members)):
                stack.extend((child, y) for child in x.below)
            else:
                stack.extend((x, child) for child in y.below)


class _Hopeful(Trees):
    """Marks the sets that could link with any other, by their bitmaps alone."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, percent: int) -> None:
        super().__init__(maps, sizes, percent)
        self.marked = np.zeros(len(sizes), bool)

    def settled(self, x: _Node, y: _Node) -> bool:
        return bool(self.marked[x.members].all() and self.marked[y.members].all())

    def leaves(self, x: _Node, y: _Node) -> None:
        for i in x.members.tolist():
            found = self.candidates(i, y.members)
            found = found[found != i]
            if len(found):
                self.marked[i] = True
                self.marked[found] = True


def hopeful(bitmaps: list[np.ndarray], sizes: list[int], percent: int) -> np.ndarray:
    """Which sets could link with another one of these.

    Sets that link differ little in size, so bitmaps meet those of their own or twice their width.
    """
    width = np.array([64 * len(x) for x in bitmaps])
    size = np.array(sizes, np.int64)
    out = np.zeros(len(size), bool)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero((width == w) | (width == 2 * w))
        if len(rows) < 2:
            continue
        trees = _Hopeful(np.stack([_folded(bitmaps[i], w) for i in rows]), size[rows], percent)
        top = trees.tree(list(range(len(rows))))
        trees.traverse(top, top)
        out[rows] |= trees.marked
    return out


class Forest(Trees):
    """Sets with a tree over them and a union-find of what is known to be linked."""

    def __init__(self, sets: list[np.ndarray], labels: list[int], percent: int) -> None:
        self.sets = sets
        width = width_for(max(len(s) for s in sets))
        super().__init__(np.stack([bitmap(s, width) for s in sets]), np.array([len(s) for s in sets], np.int64), percent)
        first: dict[int, int] = {}
        self.parent = [first.setdefault(label, i) for i, label in enumerate(labels)]
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def settled(self, x: _Node, y: _Node) -> bool:
        first = self.root(int(x.members[0]))
        return all(self.root(int(i)) == first for n in (x, y) for i in n.members)

    def leaves(self, x: _Node, y: _Node) -> None:
        for i in x.members.tolist():
            for j in self.candidates(i, y.members).tolist():
                if x is y and j <= i:
                    continue
                a, b = self.root(i), self.root(j)
                if a != b and self._linked(i, j):
                    self.parent[b] = a
                    self.links.append((i, j))

    def _linked(self, i: int, j: int) -> bool:
        small, large = sorted((self.sets[i], self.sets[j]), key=len)
        at = np.searchsorted(large, small)
        at[at == len(large)] = 0
        overlap = int((large[at] == small).sum())
        return 100 * overlap >= self.percent * (len(small) + len(large) - overlap)


def links(sets: list[np.ndarray], labels: list[int], percent: int) -> list[tuple[int, int]]:
    """Links that connect everything connected among the sets, labels already joined included."""
    if len(sets) < 2:
        return []
    forest = Forest(sets, labels, percent)
    top = forest.tree(list(range(len(sets))))
    forest.traverse(top, top)
    return forest.links


def cross_links(sets: list[np.ndarray], labels: list[int], left: list[int], right: list[int], percent: int) -> list[tuple[int, int]]:
    """The same between two parts, given by row numbers."""
    forest = Forest(sets, labels, percent)
    forest.traverse(forest.tree(left), forest.tree(right))
    return forest.links
