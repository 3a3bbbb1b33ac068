"""Small recurrent networks in numpy: what the language and the personal data models share."""

from __future__ import annotations

import numpy as np

F32 = np.float32


def soft_sign(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place: a bounded squashing function that costs no exponentials."""
    size = np.abs(x)
    size += 1
    x /= size
    return x


def soft_sign_slope(y: np.ndarray) -> np.ndarray:
    """The derivative of ``soft_sign`` in terms of its value."""
    return (1 - np.abs(y)) ** 2


def gate(x: np.ndarray) -> np.ndarray:
    """A gate between 0 and 1, in place."""
    soft_sign(x)
    x *= F32(0.5)
    x += F32(0.5)
    return x


def gate_slope(y: np.ndarray) -> np.ndarray:
    return 0.5 * (1 - np.abs(2 * y - 1)) ** 2


def scatter(symbols: np.ndarray, slopes: np.ndarray, n: int) -> np.ndarray:
    """Sum the columns of ``slopes`` (rows, T*B) by symbol: the gradient of a lookup table."""
    return np.stack([np.bincount(symbols, weights=row, minlength=n) for row in slopes]).astype(F32)


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        clip = min(1.0, 5.0 / (norm + 1e-9))
        for k, g in grads.items():
            g = g * clip
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.99**self.t)
            self.params[k] -= (self.rate * m / (np.sqrt(v) + 1e-8)).astype(F32)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))
