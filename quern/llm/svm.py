"""Linear support vector machines by dual coordinate descent, for training samples of a bounded size on the driver."""

from __future__ import annotations

import numpy as np


def train(x: np.ndarray, y: np.ndarray, cost: float = 1.0, epochs: int = 30, seed: int = 7) -> np.ndarray:
    """Weights (with a bias as the last one) of a squared-hinge machine; y holds 1 and -1. Rows of x have unit length."""
    given, x = x, np.ones((len(x), x.shape[1] + 1))  # the one copy in doubles
    x[:, :-1] = given
    square = np.concatenate([(x[k : k + 256] * x[k : k + 256]).sum(1) for k in range(0, len(x), 256)]) + 0.5 / cost
    alpha, w, rng = np.zeros(len(x)), np.zeros(x.shape[1]), np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(x)):
            grad = y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / cost
            if alpha[i] > 0 or grad < 0:
                new = max(alpha[i] - grad / square[i], 0.0)
                w += (new - alpha[i]) * y[i] * x[i]
                most, alpha[i] = max(most, abs(new - alpha[i])), new
        if most < 1e-3:
            break
    return w
