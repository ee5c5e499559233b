"""Exact Shapley values of tree ensembles, in polynomial time, for batches of rows.

What a tree gives when only some features are known is the mean over the leaves, each weighed by the shares of training rows that go its way at the
splits on unknown features, and by whether the row goes its way at those on known ones. So a leaf is a product over the m features of its
path: the share z of each, or whether the row passes, o. A feature's Shapley value of the leaf is (o - z) times the sum, over the
numbers s of other known features, of s! (m - 1 - s)! / m! times the coefficient of y^s in the product of the others' (z + o y). That
polynomial is multiplied out in m^2 steps, once for each way in which the batch's rows pass the leaf's features.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import factorial

import numpy as np


@dataclass(frozen=True)
class Leaf:
    """What a leaf adds, and of each feature on its path: its index, the interval (low, high] that leads here, and the share of rows inside."""

    value: float
    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    shares: tuple[float, ...]


def trees(model) -> list[list[Leaf]]:
    """The leaves of each tree of a fitted ensemble of numeric features, weighed as in the ensemble."""
    return [_leaves(tree._call_java("rootNode"), weight, {}) for weight, tree in zip(model.treeWeights, model.trees)]


def _leaves(node, weight: float, path: dict[int, tuple[float, float, float]]) -> list[Leaf]:
    if not node.subtreeDepth():
        steps = sorted(path.items())
        return [Leaf(weight * node.prediction(), tuple(f for f, _ in steps), *(tuple(s[k] for _, s in steps) for k in range(3)))]
    split, rows = node.split(), float(node.impurityStats().count())
    if split.getClass().getSimpleName() != "ContinuousSplit":
        raise ValueError("only splits of numbers are known here")
    feature, cut = split.featureIndex(), float(split.threshold())
    low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
    out = []
    for child, ends in ((node.leftChild(), (low, min(high, cut))), (node.rightChild(), (max(low, cut), high))):
        part = float(child.impurityStats().count()) / rows if rows else 0.0
        out += _leaves(child, weight, path | {feature: (*ends, share * part)})
    return out


def expectation(ensemble: list[list[Leaf]]) -> float:
    return sum(leaf.value * float(np.prod(leaf.shares)) for tree in ensemble for leaf in tree)


def _passes(leaf: Leaf, x: np.ndarray) -> np.ndarray:
    """Whether each row goes the leaf's way at each of its features; a value that is no number goes right."""
    own = x[:, leaf.features]
    return ~(own <= np.array(leaf.low)) & ((own <= np.array(leaf.high)) | np.isposinf(leaf.high))


def leaf_values(leaf: Leaf, passes: np.ndarray) -> np.ndarray:
    """The Shapley values of the leaf's features for each way of passing (rows of passes)."""
    m = len(leaf.features)
    o, z = passes.astype(float), np.array(leaf.shares)
    weights = np.array([factorial(s) * factorial(m - 1 - s) / factorial(m) for s in range(m)])
    out = np.empty_like(o)
    for j in range(m):
        product = np.zeros((len(o), m))
        product[:, 0] = 1.0
        for i in range(m):
            if i != j:
                shifted = product[:, :-1] * o[:, i, None]
                product *= z[i]
                product[:, 1:] += shifted
        out[:, j] = leaf.value * (o[:, j] - z[j]) * (product @ weights)
    return out


def values(ensemble: list[list[Leaf]], x: np.ndarray) -> np.ndarray:
    """The Shapley values of each row and feature, summed over the trees."""
    total = np.zeros_like(x)
    for tree in ensemble:
        for leaf in tree:
            if leaf.features:
                ways, which = np.unique(_passes(leaf, x), axis=0, return_inverse=True)
                total[:, leaf.features] += leaf_values(leaf, ways)[which.ravel()]
    return total
