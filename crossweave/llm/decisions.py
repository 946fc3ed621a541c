"""A decision tree grown from a small labelled table."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Node:
    """A leaf with the share of label 1, or a test ``feature <= cut`` with two branches."""

    share: float
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def impurity(y: np.ndarray) -> float:
    p = y.mean() if len(y) else 0.0
    return len(y) * p * (1 - p)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 1) -> Node:
    """Splits where impurity falls most; of equal splits, the first feature and the lowest cut."""
    node = Node(float(y.mean()))
    if depth == 0 or node.share in (0.0, 1.0):
        return node
    best = impurity(y) - 1e-9
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            side = x[:, f] <= cut
            if least <= side.sum() <= len(y) - least and (now := impurity(y[side]) + impurity(y[~side])) < best - 1e-12:
                best, node.feature, node.cut = now, f, float(cut)
    if node.feature >= 0:
        side = x[:, node.feature] <= node.cut
        node.low, node.high = grow(x[side], y[side], depth - 1, least), grow(x[~side], y[~side], depth - 1, least)
    return node


def decide(node: Node, x: np.ndarray) -> np.ndarray:
    """Whether each row ends in a leaf where label 1 prevails."""
    out = np.zeros(len(x), bool)
    stack = [(node, np.arange(len(x)))]
    while stack:
        at, rows = stack.pop()
        if at.feature < 0:
            out[rows] = at.share > 0.5
        else:
            low = x[rows, at.feature] <= at.cut
            stack += [(at.low, rows[low]), (at.high, rows[~low])]
    return out
