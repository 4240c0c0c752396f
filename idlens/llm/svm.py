"""A small linear support vector machine for bounded training samples."""

from __future__ import annotations

import numpy as np


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, weight: np.ndarray | None = None, rounds: int = 30, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of the squared-hinge machine, by dual coordinate descent.

    y is +1 or -1; `weight` multiplies the cost of each row. The bias is the weight of a
    further feature of constant 1, so it is regularised like the others. `x` is not copied.
    """
    x = x.astype(np.float32, copy=False)
    soft = 1 / (2 * cost * (np.ones(len(y)) if weight is None else weight))
    norm = np.einsum("ij,ij->i", x, x) + 1 + soft
    alpha, w, bias = np.zeros(len(y)), np.zeros(x.shape[1], np.float32), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            slope = y[i] * (float(x[i] @ w) + bias) - 1 + soft[i] * alpha[i]
            new = max(0.0, alpha[i] - slope / norm[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w += np.float32(step) * x[i]
                bias += step
                moved = max(moved, abs(new - alpha[i]) * norm[i])
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, float(bias)


def train_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Coefficients (the last one constant) of a weighted logistic regression, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * beta
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(bend, slope)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return beta
