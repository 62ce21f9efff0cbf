"""Union-find over small local numbers, inside one task."""

from __future__ import annotations

import numpy as np


class Forest:
    """Roots of the nodes 0..n-1; the smallest node of a set is its root."""

    def __init__(self, n: int):
        self.root = np.arange(n, dtype=np.int64)

    def labels(self) -> np.ndarray:
        """The root of every node."""
        while True:
            up = self.root[self.root]
            if np.array_equal(up, self.root):
                return self.root
            self.root = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the sets of a[i] and b[i], all at once: roots hook onto smaller roots until no pair differs."""
        while True:
            root = self.labels()
            x, y = root[a], root[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
