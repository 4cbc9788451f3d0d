"""Suffix trees of groups of suffixes, as sorted arrays.

A group holds suffixes that begin with one prefix, each with the ``width`` characters that
stand before the prefix and as many after it. Sorted by what follows, the suffixes and the
lengths that neighbours have in common are the tree: an internal node is a run of suffixes
that agree further than with what lies around the run. Sorted by what precedes, read
backwards, they tell how far the members of a node agree to the left. A node is deep where
both together reach ``width`` characters beside the prefix; those of its members that agree
far enough to the left are the occurrences of a maximal repeat: they go on differently at
both ends. Everything is compared as characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Stands for characters outside of a text; no code point has this value.
FILL = np.uint32(0xFFFFFFFF)
#: Members of nodes looked at together, which bounds a worker's memory.
MEMBERS = 1 << 19


def sort_suffixes(group: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by group and characters, and how many characters each has in common with the one before it (-1: another group)."""
    rows = np.ascontiguousarray(np.column_stack([group.astype(np.uint32), chars]))
    order = np.argsort(rows.view(f"S{4 * rows.shape[1]}").ravel(), kind="stable")
    common = np.full(len(rows), -1, np.int64)
    for at in range(0, len(rows), 1024):
        part = rows[order[max(at - 1, 0) : at + 1024]]
        unlike = part[1:] != part[:-1]
        first = np.where(unlike.any(1), unlike.argmax(1), rows.shape[1]) - 1
        common[max(at, 1) : at + 1024] = first
    return order, common


def internal_nodes(common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and depth of the runs of sorted suffixes that are internal nodes."""
    found: list[tuple[int, int, int]] = []
    open_: list[tuple[int, int]] = []
    for i, d in enumerate([*common.tolist(), -1]):
        start = i - 1
        while open_ and open_[-1][0] > d:
            depth, start = open_.pop()
            found.append((start, i, depth))
        if d >= 0 and (not open_ or open_[-1][0] < d):
            open_.append((d, start))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, end, depth = np.array(found, np.int64).T
    return start, end, depth


class Least:
    """The least of any stretch of an array in one step."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            v, k = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(v[:-k], v[k:]))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least of ``values[a:b]`` for each a < b."""
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][a[at]], self.levels[k][b[at] - (1 << int(k))])
        return out


class Forest:
    """The trees of all groups of some rows. ``chars`` holds ``width`` characters before and after the prefix of each."""

    def __init__(self, group: np.ndarray, doc: np.ndarray, before: np.ndarray, after: np.ndarray, chars: np.ndarray) -> None:
        self.doc, self.before, self.after, self.width = doc, before, after, chars.shape[1] // 2
        at = np.arange(self.width)
        chars = np.where(np.concatenate([self.width - at[None, :] > before[:, None], at[None, :] >= after[:, None]], 1), FILL, chars)
        self.order, common = sort_suffixes(group, chars[:, self.width :])
        by_left, left = sort_suffixes(group, chars[:, : self.width][:, ::-1])
        self.rank = np.empty(len(doc), np.int64)
        self.rank[by_left] = np.arange(len(doc))
        self.left = Least(left)
        self.common = common
        self.start, self.end, self.depth = internal_nodes(common)
        # past the end of a text only fillers agree, and then all members end alike
        self.right = np.minimum(self.depth, after[self.order[self.start]]) if len(self.start) else self.depth

    def _chunks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Node, row and child of each member of nodes, by node and left order."""
        size = self.end - self.start
        upto = np.cumsum(size)
        first = 0
        while first < len(size):
            last = int(np.searchsorted(upto, (upto[first - 1] if first else 0) + MEMBERS, side="right"))
            last = max(last, first + 1)
            s = size[first:last]
            node = np.repeat(np.arange(first, last), s)
            place = np.arange(len(node)) - np.repeat(np.cumsum(s) - s, s) + self.start[node]
            child = np.cumsum((self.common[place] == self.depth[node]) & (place > self.start[node]))
            row = self.order[place]
            by = np.argsort(node * len(self.doc) + self.rank[row])
            yield node[by], row[by], child[by]
            first = last

    def _left_common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many characters before the prefix rows x and y share, x being the lower in left order."""
        return np.minimum(self.left.between(self.rank[x] + 1, self.rank[y] + 1), self.before[x])

    def repeats(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Maximal repeats found in more than one document: the number of one, and a document that has it, in order, each once.

        Repeats whose occurrences all lie within one child are left out, since the child has
        them; so each pair of suffixes that share enough is in the repeat of the node where they part.
        """
        for node, row, child in self._chunks():
            need = self.width - self.right[node]
            new = np.ones(len(node), bool)
            same = node[1:] == node[:-1]
            agree = np.full(len(node) - 1, -1, np.int64)
            agree[same] = self._left_common(row[:-1][same], row[1:][same])
            new[1:] = agree < need[1:]
            heads = np.flatnonzero(new)
            doc = self.doc[row]
            several = (np.minimum.reduceat(doc, heads) != np.maximum.reduceat(doc, heads)) & (np.minimum.reduceat(child, heads) != np.maximum.reduceat(child, heads))
            repeat = np.cumsum(new) - 1
            use = several[repeat]
            repeat, doc = repeat[use], doc[use]
            by = np.lexsort((doc, repeat))
            repeat, doc = repeat[by], doc[by]
            once = np.ones(len(doc), bool)
            once[1:] = (doc[1:] != doc[:-1]) | (repeat[1:] != repeat[:-1])
            if once.any():
                yield repeat[once], doc[once]

    def extents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows that share enough with a suffix of another document, and how far they do to the left and right of the prefix.

        Of a row's nodes the greatest extent to each side is given: all of its shared stretches
        hold the prefix, so together they cover exactly what lies between.
        """
        left, right = np.full(len(self.doc), -1, np.int64), np.full(len(self.doc), -1, np.int64)
        for node, row, _ in self._chunks():
            doc, n = self.doc[row], len(row)
            new = np.ones(n, bool)
            new[1:] = (node[1:] != node[:-1]) | (doc[1:] != doc[:-1])
            run = np.cumsum(new) - 1
            heads = np.flatnonzero(new)
            tails = np.append(heads[1:], n)
            reach = np.full(n, -1, np.int64)
            # the nearest suffix of another document in left order, on either side
            prev = heads[run] - 1
            ok = np.flatnonzero((prev >= 0) & (node[np.maximum(prev, 0)] == node))
            reach[ok] = self._left_common(row[prev[ok]], row[ok])
            nxt = tails[run]
            ok = np.flatnonzero((nxt < n) & (node[np.minimum(nxt, n - 1)] == node))
            reach[ok] = np.maximum(reach[ok], self._left_common(row[ok], row[nxt[ok]]))
            found = reach >= self.width - self.right[node]
            found &= reach >= 0
            np.maximum.at(left, row[found], reach[found])
            np.maximum.at(right, row[found], self.right[node[found]])
        rows = np.flatnonzero(left >= 0)
        return rows, left[rows], right[rows]
