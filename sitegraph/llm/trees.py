"""Perfect binary trees grown from histograms and flattened into arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Trees of one depth: node k has children 2k+1 (value <= limit) and 2k+2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def total(self, x: np.ndarray) -> np.ndarray:
        """`base` and the leaves of all trees, added up, per row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:  # all rows are on the same level
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            total += leaf[node - inner]
        return total


class Bins:
    """The features of a sample, each cut at quantiles."""

    def __init__(self, x: np.ndarray, bins: int):
        cuts = np.linspace(0, 1, bins + 1)[1:-1]
        self.bins = bins
        self.edges = [np.unique(np.quantile(x[:, f], cuts)) if len(x) else np.zeros(0) for f in range(x.shape[1])]
        self.number = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1)

    def grow(
        self,
        gradient: np.ndarray,
        hessian: np.ndarray,
        depth: int,
        ridge: float,
        least: float,
        allowed: np.ndarray | None = None,
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """One tree: features, limits, leaf values G / (H + ridge), and each row's leaf.

        A level's splits come from one histogram per feature. `least` is the hessian or row weight a
        side needs; `allowed` (inner nodes x features) restricts the features of a node.
        """
        n, bins = len(gradient), self.bins
        feature = np.zeros(2**depth - 1, np.int32)
        limit = np.full(2**depth - 1, np.inf, np.float32)
        weight = (hessian > 0).astype(float)
        node = np.zeros(n, np.int64)  # number within the level
        for level in range(depth):
            width = 2**level
            first = width - 1
            gains = np.full(width, 1e-9)
            best = np.full((width, 2), -1)
            for f, e in enumerate(self.edges):
                if not len(e):
                    continue
                cells = node * bins + self.number[:, f]
                g, h, c = (
                    np.bincount(cells, v, width * bins).reshape(width, bins).cumsum(1) for v in (gradient, hessian, weight)
                )
                gt, ht, ct = g[:, -1:], h[:, -1:], c[:, -1:]
                gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
                gain = np.where((c >= least) & (ct - c >= least), gain, 0)[:, : len(e)]
                if allowed is not None:
                    gain *= allowed[first : first + width, f : f + 1]
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                better = top > gains
                gains[better] = top[better]
                best[better] = np.stack([np.full(width, f), at], axis=1)[better]
            for k, (f, at) in enumerate(best):
                if f >= 0:  # without a split all rows go left
                    feature[first + k], limit[first + k] = f, self.edges[f][at]
            f, at = best[node, 0], best[node, 1]
            node = 2 * node + ((f >= 0) & (self.number[np.arange(n), np.maximum(f, 0)] > at))
        g = np.bincount(node, gradient, 2**depth)
        h = np.bincount(node, hessian, 2**depth)
        return feature, limit, g / (h + ridge), node
