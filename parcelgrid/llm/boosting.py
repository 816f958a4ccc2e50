"""Gradient-boosted trees for yes-or-no labels: logistic loss, Newton leaves, splits from histograms."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth: node k of a level has children 2k and 2k+1 of the next."""
    depth: int
    start: float
    feature: np.ndarray    # trees x (2**depth - 1)
    threshold: np.ndarray  # larger values go right
    leaf: np.ndarray       # trees x 2**depth

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = at + (1 << level) - 1
                at = 2 * at + (x[rows, feature[node]] > threshold[node])
            out += leaf[at]
        return out


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 50, depth: int = 5, rate: float = 0.25, bins: int = 32,
          pull: float = 1.0) -> Trees:
    """Fits `trees` trees; rows without weight do nothing, and one label alone, or no rows, give a constant."""
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if n else np.zeros(0) for k in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)])  # bin b: values up to cut b
    ones = [np.flatnonzero(b) if len(c) == 1 else None for b, c in zip(binned, cuts)]
    total = max(weight.sum(), 1e-9)
    share = np.clip((weight * y).sum() / total, 1e-6, 1 - 1e-6)
    margin = np.full(n, np.log(share / (1 - share)))
    start, features, thresholds, leaves = float(margin[0]) if n else 0.0, [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (y - p), weight * p * (1 - p)
        at, feature, threshold = np.zeros(n, np.int64), np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
        for level in range(depth):
            width = 1 << level
            best = np.full(width, 1e-9)
            gt, ht = (np.bincount(at, v, width)[:, None] for v in (g, h))
            for k in np.flatnonzero([len(c) > 0 for c in cuts]):
                m = len(cuts[k]) + 1
                if m == 2:  # sums over the rows beyond the only cut
                    gl, hl = (t - np.bincount(at[ones[k]], v[ones[k]], width)[:, None] for t, v in ((gt, g), (ht, h)))
                else:
                    gl, hl = (np.cumsum(np.bincount(at * m + binned[k], v, width * m).reshape(width, m), axis=1)[:, :-1] for v in (g, h))
                gain = gl ** 2 / (hl + pull) + (gt - gl) ** 2 / (ht - hl + pull) - gt ** 2 / (ht + pull)
                top = gain.argmax(axis=1)
                value = gain[np.arange(width), top]
                better = np.flatnonzero(value > best)
                best[better] = value[better]
                feature[width - 1 + better], threshold[width - 1 + better] = k, cuts[k][top[better]]
            node = at + width - 1
            at = 2 * at + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = rate * np.bincount(at, g, 1 << depth) / (np.bincount(at, h, 1 << depth) + pull)
        margin += leaf[at]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(depth, start, np.array(features), np.array(thresholds, np.float32), np.array(leaves))
