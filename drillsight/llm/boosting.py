"""Gradient-boosted trees for two classes, on bounded samples: fitted and applied with numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from drillsight.llm.fitting import sigmoid


@dataclass
class Trees:
    """Full binary trees of one depth: a feature and a limit at each inner place, values below.

    Place 0 is the root, ``2 k + 1`` and ``2 k + 2`` are below ``k``; a row goes to the second
    if its feature is above the limit.
    """

    start: float
    depth: int
    features: list[np.ndarray] = field(default_factory=list)
    limits: list[np.ndarray] = field(default_factory=list)
    values: list[np.ndarray] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, limit, value in zip(self.features, self.limits, self.values, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
            total += value[at - len(feature)]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x))


def fit_trees(
    x: np.ndarray,
    y: np.ndarray,
    rounds: int = 60,
    depth: int = 4,
    rate: float = 0.2,
    bins: int = 32,
    penalty: float = 1.0,
    least: float = 1.0,
) -> Trees:
    """Newton steps on the logistic loss; features are cut at quantiles of the sample.

    ``least`` is the smallest sum of second derivatives on either side of a split.  One class
    alone gives its smoothed share.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    trees = Trees(float(np.log(share / (1 - share))), depth)
    if not len(y) or y.min() == y.max():
        return trees
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)])
    score = np.full(len(y), trees.start)
    inner = 2**depth - 1
    for _ in range(rounds):
        p = sigmoid(score)
        first, second = y - p, p * (1 - p)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            width, base = 2**level, 2**level - 1
            slot = (at - base) * bins
            gains = np.empty((len(cuts), width, bins))
            for f, row in enumerate(binned):
                g = np.bincount(slot + row, first, width * bins).reshape(width, bins).cumsum(axis=1)
                h = np.bincount(slot + row, second, width * bins).reshape(width, bins).cumsum(axis=1)
                all_g, all_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + penalty) + (all_g - g) ** 2 / (all_h - h + penalty) - all_g**2 / (all_h + penalty)
                gains[f] = np.where((h >= least) & (all_h - h >= least), gain, -1.0)
                gains[f, :, len(cuts[f]) :] = -1.0
            best = gains.transpose(1, 0, 2).reshape(width, -1).argmax(axis=1)
            split = np.full(width, bins)
            for k, choice in enumerate(best):
                f, b = divmod(int(choice), bins)
                if gains[f, k, b] > 1e-9:
                    feature[base + k], limit[base + k], split[k] = f, cuts[f][b], b
            own = at - base
            at = 2 * at + 1 + (binned[feature[at], np.arange(len(y))] > split[own])
        leaf = at - inner
        g = np.bincount(leaf, first, inner + 1)
        h = np.bincount(leaf, second, inner + 1)
        value = rate * g / (h + penalty)
        score += value[leaf]
        trees.features.append(feature)
        trees.limits.append(limit)
        trees.values.append(value)
    return trees
