"""Linear hinge-loss models by dual coordinate descent, and a logistic link for their margins."""

from __future__ import annotations

import numpy as np


def fit_hinge(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dim: int, c: float = 1.0, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of the L2-regularised hinge loss. ``rows`` are (indices, values);
    ``y`` is 1 or -1. Coordinates are visited in seeded order, clipped to [0, c], until none moves much."""
    w, a, order = np.zeros(dim + 1), np.zeros(len(rows)), np.random.default_rng(seed)
    norm = np.array([float(v @ v) + 1.0 for _, v in rows])
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            gradient = y[i] * (w[at] @ v + w[dim]) - 1.0
            new = min(max(a[i] - gradient / norm[i], 0.0), c)
            step = (new - a[i]) * y[i]
            if step:
                w[at] += step * v
                w[dim] += step
                most = max(most, abs(new - a[i]))
                a[i] = new
        if most < 1e-3 * c:
            break
    return w


def fit_link(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + exp(-(a m + b))) fits the labels 0 or 1; smoothed targets, Newton steps.
    The slope is kept positive, so that scores keep the order of the margins."""
    pos, neg = float((y > 0).sum()), float((y <= 0).sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        g = np.array([((p - t) * margin).sum() + 1e-3 * (a - 1), (p - t).sum()])
        s = p * (1 - p)
        h = np.array([[(s * margin * margin).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
