"""BK-trees over bit fingerprints: the children of a node are keyed by their Hamming distance to it.

A tree is searched for many fingerprints at a time, so that every step is an array operation. Small
subtrees are leaves whose members are compared directly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LEAF = 32


def distances(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Hamming distances of rows of 64-bit words to one row."""
    return np.bitwise_count(rows ^ one).sum(axis=-1, dtype=np.int64)


class BKTree:
    """Built over an (n, words) array of uint64; members are named by their row numbers."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.root = self._build(np.arange(len(prints)))

    def _build(self, members: np.ndarray):
        stack, root = [(members, None, None)], None
        while stack:
            rows, parent, edge = stack.pop()
            if len(rows) <= LEAF:
                node = (rows, None)
            else:
                pivot, rest = rows[:1], rows[1:]
                d = distances(self.prints[rest], self.prints[pivot[0]])
                node = (pivot, {})
                if d.max() == d.min() == 0:  # equal fingerprints
                    node = (rows, None)
                else:
                    stack += [(rest[d == e], node[1], int(e)) for e in np.unique(d)]
            if parent is None:
                root = node
            else:
                parent[edge] = node
        return root

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query numbers, member numbers) of all pairs within ``radius``, in pieces."""
        stack = [(self.root, np.arange(len(queries)))]
        while stack:
            (rows, children), asked = stack.pop()
            if not len(asked) or not len(rows):
                continue
            if children is None:
                near = distances(queries[asked][:, None, :], self.prints[rows][None, :, :]) <= radius
                q, m = np.nonzero(near)
                yield asked[q], rows[m]
                continue
            d = distances(queries[asked], self.prints[rows[0]])
            hit = asked[d <= radius]
            yield hit, np.full(len(hit), rows[0])
            for edge, child in children.items():  # the triangle inequality rules out all other edges
                stack.append((child, asked[np.abs(d - edge) <= radius]))


def forest(prints: np.ndarray, radius: int, block: int = 256) -> list[tuple[int, int]]:
    """Row pairs that span the groups of all links within ``radius``: fewer pairs than rows, although
    every link counts. Queries go in blocks, so memory holds ``block`` times the rows at most."""
    tree, label, out = BKTree(prints), np.arange(len(prints)), []
    for at in range(0, len(prints), block):
        asked, found = zip(*tree.search(prints[at : at + block], radius))
        asked, found = np.concatenate(asked), np.concatenate(found)
        order = np.argsort(asked, kind="stable")
        asked, found = asked[order], found[order]
        bounds = np.searchsorted(asked, np.arange(min(block, len(prints) - at) + 1))
        for i in range(len(bounds) - 1):
            near = found[bounds[i] : bounds[i + 1]]
            names, first = np.unique(label[near], return_index=True)
            if len(names) > 1:
                own = label[at + i]
                out += [(at + i, int(near[k])) for name, k in zip(names, first) if name != own]
                label[np.isin(label, names)] = names[0]
    return out
