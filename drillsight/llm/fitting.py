"""Logistic regression on small samples, for the classifiers of this folder."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Logistic:
    """Weights on standardised features; ``weights[0]`` is the constant."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.weights[0] + (np.asarray(x, float) - self.mean) / self.scale @ self.weights[1:]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> Logistic:
    """Newton's method with a squared penalty; one class alone gives its smoothed share."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    width = x.shape[1]
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Logistic(np.zeros(width), np.ones(width), np.r_[np.log(share / (1 - share)), np.zeros(width)])
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-12, scale, 1.0)
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    ridge = np.diag(np.r_[1e-6, np.full(width, penalty)])
    w = np.zeros(width + 1)
    for _ in range(rounds):
        p = sigmoid(z @ w)
        hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge
        step = np.linalg.solve(hessian, z.T @ (y - p) - ridge @ w)
        w += step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-8:
            break
    return Logistic(mean, scale, w)
