"""The logistic curve and its fit to labelled margins."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through labelled margins, lightly smoothed (Platt)."""
    ones = labels.sum()
    target = np.where(labels > 0, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    scale = max(1e-6, float(np.abs(margins).mean()))
    x, a, b = margins / scale, 1.0, 0.0
    for _ in range(100):
        p = sigmoid(a * x + b)
        q = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * x).sum() + 1e-3 * a, (p - target).sum()])
        h = np.array([[(q * x * x).sum() + 1e-3, (q * x).sum()], [(q * x).sum(), q.sum() + 1e-9]])
        move = np.linalg.solve(h, g)
        a, b = a - np.clip(move[0], -2, 2), b - np.clip(move[1], -2, 2)
    return float(a / scale), float(b)
