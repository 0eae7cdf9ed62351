"""A score carried to a probability."""

from __future__ import annotations

import numpy as np


def logistic(v: np.ndarray, y: np.ndarray, ridge: float, start: tuple[float, float] = (0.1, 0.0)) -> tuple[float, float]:
    """Slope and shift of P(y = 1) = sigmoid(slope v + shift) by Newton's steps with a ridge; the slope is never negative."""
    a, w = np.column_stack([v, np.ones_like(v)]), np.array(start)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (p - y) + ridge * w)
        w = w - step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 1e-6), float(w[1])
