"""Half-space trees: random axis cuts, scored by how full the cells were before.

The trees depend on the seed alone, so every task builds the same ones. A window of
events is scored with the node masses of an earlier window (Tan, Ting and Liu, 2011).
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

TREES = 50
HEIGHT = 10
WINDOW = 250
SEED = 42
PADDING = 0.15
# A node lighter than this share of a window ends the walk down a tree.
SIZE_LIMIT = 0.1


def node_hash(seed: int, tree: int, node: int) -> int:
    """60 bits from which a node's cut feature and place are drawn."""
    return int(hashlib.md5(f"{seed}:{tree}:{node}".encode()).hexdigest()[:15], 16)


@lru_cache(maxsize=8)
def forest(features: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Cut feature and cut value of every inner node, trees by heap position."""
    inner = 2**HEIGHT - 1
    drawn = np.array([[node_hash(seed, t, n) for n in range(inner)] for t in range(TREES)])
    axis = drawn % features
    at = PADDING + (1 - 2 * PADDING) * ((drawn // 1000) % 1_000_000) / 1_000_000
    cut = np.empty((TREES, inner))
    trees = np.arange(TREES)[:, None]
    low = np.zeros((TREES, 1, features))
    high = np.ones((TREES, 1, features))
    for depth in range(HEIGHT):
        nodes = np.arange(2**depth - 1, 2 ** (depth + 1) - 1)
        here = np.arange(len(nodes))[None, :]
        a = axis[:, nodes]
        bottom, top = low[trees, here, a], high[trees, here, a]
        cut[:, nodes] = bottom + at[:, nodes] * (top - bottom)
        # Children in heap order: the left one ends at the cut, the right one starts there.
        low, high = np.repeat(low, 2, axis=1), np.repeat(high, 2, axis=1)
        high[trees, 2 * here, a] = cut[:, nodes]
        low[trees, 2 * here + 1, a] = cut[:, nodes]
    return axis, cut


def leaves(points: np.ndarray) -> np.ndarray:
    """Number of the leaf each point falls into, 0 to 2**HEIGHT - 1, in every tree.

    A leaf names the whole way to it: the node at depth d is its first d bits.
    """
    axis, cut = forest(points.shape[1])
    trees = np.arange(TREES)
    rows = np.arange(len(points))[:, None]
    node = np.zeros((len(points), TREES), dtype=np.int64)
    for _ in range(HEIGHT):
        right = points[rows, axis[trees, node]] >= cut[trees, node]
        node = 2 * node + 1 + right
    return node - (2**HEIGHT - 1)


def masses(leaf: np.ndarray) -> np.ndarray:
    """Points per leaf of every tree; inner nodes are sums of their leaves."""
    places = leaf + np.arange(TREES) * 2**HEIGHT
    return np.bincount(places.ravel(), minlength=TREES * 2**HEIGHT).reshape(TREES, -1)


def scores(leaf: np.ndarray, mass: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Anomaly score of each point, 0 (usual) to 1 (never seen), against leaf masses."""
    trees = np.arange(TREES)
    total = np.zeros(len(leaf))
    walking = np.ones(leaf.shape, dtype=bool)
    for depth in range(HEIGHT + 1):
        level = mass.reshape(TREES, 2**depth, -1).sum(axis=2)
        here = level[trees, leaf >> (HEIGHT - depth)]
        total += (here * walking).sum(axis=1) * 2.0**depth
        walking &= here >= SIZE_LIMIT * window
    return 1.0 - total / (TREES * window * (2.0 ** (HEIGHT + 1) - 1))
