"""Linear models for bounded samples: hinge loss by dual coordinate descent, Platt's calibration, logistic curves with signs."""

from __future__ import annotations

import numpy as np


def dual_coordinate_descent(
    starts: np.ndarray, index: np.ndarray, value: np.ndarray, y: np.ndarray, size: int, cost: np.ndarray, epochs: int = 20, seed: int = 0
) -> np.ndarray:
    """Weights (the last is the bias) that minimise |w|^2 / 2 + sum of cost * max(0, 1 - y * f).

    Rows are sparse: index[starts[i]:starts[i + 1]] and value likewise. y is -1 or 1; cost has one entry a row.
    """
    w, n = np.zeros(size + 1), len(y)
    alpha = np.zeros(n)
    rows = [slice(starts[i], starts[i + 1]) for i in range(n)]
    square = np.array([float(value[r] @ value[r]) + 1.0 for r in rows])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(n):
            at, x = index[rows[i]], value[rows[i]]
            slope = y[i] * (w[at] @ x + w[size]) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            if (change := new - alpha[i]) != 0.0:
                alpha[i] = new
                w[at] += change * y[i] * x
                w[size] += change * y[i]
                most = max(most, abs(change) / cost[i])
        if most < 1e-3:
            break
    return w


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a * margin + b))) by Newton's method on smoothed targets, a >= 0; y is 0 or 1."""
    pos, neg = float(y.sum()), float(len(y) - y.sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    if not len(y):
        return 1.0, 0.0
    spread = float(np.std(margin)) or 1.0
    middle = float(np.mean(margin))
    x = (margin - middle) / spread
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, h = p - target, p * (1 - p) + 1e-9
        ga, gb = g @ x + 1e-3 * a, g.sum()
        haa, hab, hbb = h @ (x * x) + 1e-3, h @ x, h.sum()
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        scale = min(1.0, 2.0 / max(abs(da), abs(db), 1e-9))
        a, b = a - scale * da, b - scale * db
        if max(abs(da), abs(db)) < 1e-6:
            break
    a = max(a, 1e-6)
    return a / spread, b - a * middle / spread


def monotone_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, sign: np.ndarray, steps: int = 3000) -> tuple[np.ndarray, float]:
    """Slopes, each zero or of its sign, and base of a ridge-penalised logistic curve, by projected gradients."""
    middle, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z, weight = (x - middle) / spread, weight / weight.mean()
    slopes, base = np.zeros(x.shape[1]), 0.0
    rate = 1.0 / (0.25 * (np.linalg.norm(z * np.sqrt(weight)[:, None], 2) ** 2 / len(z) + 1) + 1 / len(z))
    for _ in range(steps):
        off = (chance(z @ slopes, (1.0, base)) - y) * weight
        slopes = slopes - rate * (z.T @ off + slopes) / len(y)
        base -= rate * off.mean()
        slopes[slopes * sign < 0] = 0.0
    return slopes / spread, base - float(slopes / spread @ middle)


def chance(margin: np.ndarray, ab: tuple[float, float]) -> np.ndarray:
    """Platt's probability."""
    return 1 / (1 + np.exp(-np.clip(ab[0] * margin + ab[1], -30, 30)))
