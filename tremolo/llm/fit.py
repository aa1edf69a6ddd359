"""Logistic weights by accelerated proximal gradient, for samples that fit on the driver."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def lasso_logistic(x: np.ndarray, y: np.ndarray, l1: float, l2: float = 0.0, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights that minimise the mean log loss + l1 * |w| + l2 / 2 * w**2."""
    n, k = x.shape
    if n == 0:
        return 0.0, np.zeros(k)
    a = np.hstack([np.ones((n, 1)), x])
    v = np.random.default_rng(0).normal(size=k + 1)
    for _ in range(30):  # largest eigenvalue of the Gram matrix, for the step size
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v) or 1
    step = 1 / (np.linalg.norm(a @ v) ** 2 / (4 * n) + l2 + 1e-12)
    penal = np.r_[0.0, np.full(k, l1)]
    ridge = np.r_[0.0, np.full(k, l2)]
    w = z = np.zeros(k + 1)
    t = 1.0
    for _ in range(steps):
        g = a.T @ (sigmoid(a @ z) - y) / n + ridge * z
        new = z - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * penal, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return float(w[0]), w[1:]


def log_loss(y: np.ndarray, p: np.ndarray) -> float:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
