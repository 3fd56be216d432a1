"""Union-find over integer nodes, many links at once."""

from __future__ import annotations

import numpy as np


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Links nodes ``a[i]`` and ``b[i]`` in ``parent``, in place; afterwards every node points at its root, the least of its set.

    Each round hooks the greater root of every link that still joins two sets to the least root it meets, and then
    halves all paths until they are flat. Links within one set leave the round, so later rounds are short.
    """
    while len(a):
        x, y = parent[a], parent[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            return
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up
