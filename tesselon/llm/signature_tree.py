"""Signature trees over token bitmaps: nodes hold the OR of their sets' bitmaps and the range of their sizes.

For sets A and B whose tokens are hashed to bits, overlap(A, B) is at most popcount(bits(A) & bits(B)) plus the lesser
number of tokens that share a bit with another token of their set. With the OR of bitmaps and the greatest such number
in each node, the same sum bounds the overlap of every pair below two nodes, and the least sizes below them bound
the overlap that a linked pair needs. A node also knows the component of its sets if they have one in common: nodes
of one component needn't be compared.

Many trees are built and traversed at once, level by level, as arrays of nodes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

WORDS = 16  # of 64 bits in a bitmap
FANOUT = 8
MIXED = -1


def bitmap(tokens: np.ndarray) -> tuple[np.ndarray, int]:
    """Bitmap of 64-bit token hashes, and how many tokens share a bit with an earlier one."""
    bit = np.unique((tokens & np.uint64(WORDS * 64 - 1)).astype(np.int64))
    bits = np.zeros(WORDS * 64, np.uint8)
    bits[bit] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64), len(tokens) - len(bit)


@dataclass
class Level:
    bits: np.ndarray
    low: np.ndarray
    high: np.ndarray
    extra: np.ndarray
    comp: np.ndarray  # numbers of components, MIXED where a node has several
    tree: np.ndarray
    child: np.ndarray  # the first child of each node in the level below, and one more


class Forest:
    """Trees numbered from 0. Their sets lie in order of component, size and bitmap, so that neighbours are alike."""

    def __init__(self, tree: np.ndarray, bits: np.ndarray, sizes: np.ndarray, extra: np.ndarray, comp: np.ndarray):
        comp = np.unique(comp, return_inverse=True)[1]
        self.order = np.lexsort((bits[:, 1], bits[:, 0], sizes, comp, tree))
        tree, bits, sizes, extra, comp = (x[self.order] for x in (tree, bits, sizes, extra, comp))
        self.levels = [Level(bits, sizes, sizes, extra, comp, tree, np.arange(len(tree) + 1))]
        while len(t := self.levels[-1].tree) > 1 and (t[1:] == t[:-1]).any():
            self.levels.append(self._above(self.levels[-1]))

    @staticmethod
    def _above(x: Level) -> Level:
        """Nodes over each FANOUT nodes of a tree."""
        begin = np.flatnonzero(np.diff(x.tree, prepend=-1))
        place = np.arange(len(x.tree)) - np.repeat(begin, np.diff(np.append(begin, len(x.tree))))
        cut = np.flatnonzero(place % FANOUT == 0)
        low, high = np.minimum.reduceat(x.comp, cut), np.maximum.reduceat(x.comp, cut)
        return Level(
            np.bitwise_or.reduceat(x.bits, cut, axis=0), np.minimum.reduceat(x.low, cut), np.maximum.reduceat(x.high, cut), np.maximum.reduceat(x.extra, cut),
            np.where((low == high) & (low != MIXED), low, MIXED), x.tree[cut], np.append(cut, len(x.tree)),
        )


def may_link(x: Level, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether pairs of nodes can hold a pair of sets with |A & B| / |A | B| >= num / den, of different components."""
    most = np.bitwise_count(x.bits[i] & x.bits[j]).sum(axis=1, dtype=np.int64) + np.minimum(x.extra[i], x.extra[j])
    fits = (den * x.high[i] >= num * x.low[j]) & (den * x.high[j] >= num * x.low[i])
    fits &= (num + den) * most >= num * (x.low[i] + x.low[j])
    return fits & ((x.comp[i] != x.comp[j]) | (x.comp[i] == MIXED))


def linked_leaves(forest: Forest, pairs: list[tuple[int, int]] | np.ndarray, num: int, den: int, block: int = 1 << 15, seen: Counter | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Dual traversal of pairs of trees (a tree with itself gives each pair once): places of sets that the bounds don't rule out.

    seen counts the pairs of nodes that are visited and pruned above the leaves, and pairs of leaves likewise.
    """
    at = np.asarray(pairs, np.int64).reshape(-1, 2)
    top = len(forest.levels) - 1
    stack = [(top, at[:, 0], at[:, 1])]  # one node a tree there, in order of their numbers
    while stack:
        level, i, j = stack.pop()
        for cut in range(block, len(i), block):
            stack.append((level, i[cut : cut + block], j[cut : cut + block]))
        i, j = i[:block], j[:block]
        x = forest.levels[level]
        good = may_link(x, i, j, num, den)
        if level == 0:
            good &= i != j
        if seen is not None:
            kind = "leaves" if level == 0 else "nodes"
            seen[kind, "visited"] += len(i)
            seen[kind, "pruned"] += len(i) - int(good.sum())
        i, j = i[good], j[good]
        if not len(i):
            continue
        if level == 0:
            yield forest.order[i], forest.order[j]
            continue
        i, j = _children(x, i, j)
        j, i = _children(x, j, i)
        below = forest.levels[level - 1].tree
        keep = (below[i] != below[j]) | (i <= j)
        stack.append((level - 1, i[keep], j[keep]))


def _children(x: Level, mine: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replaces nodes by their children, repeating the other side."""
    n = x.child[mine + 1] - x.child[mine]
    first = np.cumsum(n) - n
    kids = np.arange(int(n.sum())) - np.repeat(first, n) + np.repeat(x.child[mine], n)
    return kids, np.repeat(other, n)
