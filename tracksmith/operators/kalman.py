"""Gaussian state estimation: linear and unscented updates, smoothing, and linear (in)equality constraints."""

from __future__ import annotations

import math

import numpy as np


def _phi(x: float) -> float:
    return math.exp(-x * x / 2) / math.sqrt(2 * math.pi) if math.isfinite(x) else 0.0


def _upper(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def truncated_moments(a: float, b: float) -> tuple[float, float, float]:
    """(log probability, mean, variance) of a standard normal cut to [a, b]; either end may be infinite."""
    if a == -math.inf and b == math.inf:
        return 0.0, 0.0, 1.0
    if b < 0:  # work in the upper tail
        logp, mean, var = truncated_moments(-b, -a)
        return logp, -mean, var
    p = _upper(a) - _upper(b)
    if p <= 0:
        if a > 0 and b == math.inf:  # far in the tail: the asymptotic series
            return -a * a / 2 - math.log(a * math.sqrt(2 * math.pi)), a + 1 / a, 1 / (a * a)
        return -math.inf, (a + b) / 2 if math.isfinite(a + b) else 0.0, 0.0
    fa, fb = _phi(a), _phi(b)
    mean = (fa - fb) / p
    edge = (a * fa if math.isfinite(a) else 0.0) - (b * fb if math.isfinite(b) else 0.0)
    return math.log(p), mean, max(0.0, 1 + edge / p - mean * mean)


def cross_covariance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of samples in columns, by the population formula."""
    return (x - x.mean(1, keepdims=True)) @ (y - y.mean(1, keepdims=True)).T / x.shape[1]


class State:
    """A normal distribution with its updates; each returns what the caller scores by."""

    def __init__(self, x, p):
        self.x, self.p = np.array(x, float), np.array(p, float)

    def copy(self) -> State:
        return State(self.x, self.p)

    def predict(self, f: np.ndarray, q: np.ndarray) -> None:
        self.x, self.p = f @ self.x, f @ self.p @ f.T + q

    def _sigma_points(self) -> np.ndarray:
        n = len(self.x)
        values, vectors = np.linalg.eigh(n * (self.p + self.p.T) / 2)
        root = vectors * np.sqrt(np.maximum(values, 0)) @ vectors.T
        return np.hstack([self.x[:, None] + root, self.x[:, None] - root])

    def predict_unscented(self, f, q: np.ndarray) -> None:
        y = np.apply_along_axis(f, 0, self._sigma_points())
        self.x, self.p = y.mean(1), np.cov(y, bias=True) + q

    def _correct(self, innovation, s, gain) -> float:
        self.x = self.x + gain @ innovation
        self.p = self.p - gain @ s @ gain.T
        return float(innovation @ np.linalg.solve(s, innovation)) / 2

    def measure(self, y, h: np.ndarray, r: np.ndarray) -> float:
        """A linear measurement; gives half of the squared Mahalanobis length of the innovation."""
        s = h @ self.p @ h.T + r
        return self._correct(np.asarray(y) - h @ self.x, s, np.linalg.solve(s, h @ self.p).T)

    def measure_unscented(self, y, h, r: np.ndarray) -> float:
        points = self._sigma_points()
        z = np.apply_along_axis(h, 0, points)
        s = np.atleast_2d(np.cov(z, bias=True)) + r
        return self._correct(np.asarray(y) - z.mean(1), s, np.linalg.solve(s, cross_covariance(points, z).T).T)

    def measure_distance(self, y, h: np.ndarray, r: np.ndarray) -> float:
        return self.copy().measure(y, h, r)

    def smooth(self, after: State, f: np.ndarray, q: np.ndarray) -> None:
        """The backward step: after is the smoothed state that follows."""
        ahead = f @ self.p @ f.T + q
        gain = np.linalg.solve(ahead, f @ self.p).T
        self.x = self.x + gain @ (after.x - f @ self.x)
        self.p = self.p + gain @ (after.p - ahead) @ gain.T

    def constrain(self, d, rows: np.ndarray) -> None:
        """rows @ x == d, exactly."""
        gain = np.linalg.solve(rows @ self.p @ rows.T, rows @ self.p).T
        self.x = self.x + gain @ (np.asarray(d) - rows @ self.x)
        self.p = self.p - gain @ rows @ self.p

    def constraint_distance(self, d, rows: np.ndarray) -> float:
        gap = np.asarray(d) - rows @ self.x
        return float(gap @ np.linalg.solve(rows @ self.p @ rows.T, gap)) / 2

    def bound(self, rows: np.ndarray, low, high) -> float:
        """low <= rows @ x <= high, one row after the other by moment matching; gives -log of the probability."""
        cost = 0.0
        for row, a, b in zip(np.atleast_2d(rows), np.atleast_1d(low), np.atleast_1d(high), strict=True):
            var = float(row @ self.p @ row)
            if var <= 0:
                if not a <= row @ self.x <= b:
                    return math.inf
                continue
            sd, mean = math.sqrt(var), float(row @ self.x)
            logp, m, v = truncated_moments((a - mean) / sd, (b - mean) / sd)
            if logp == -math.inf:
                return math.inf
            gain = self.p @ row / sd
            self.x = self.x + gain * m
            self.p = self.p - np.outer(gain, gain) * (1 - v)
            cost -= logp
        return cost

    def bound_distance(self, row: np.ndarray, low: float = -math.inf, high: float = math.inf) -> float:
        """-log of the probability that low <= row @ x <= high."""
        var = float(row @ self.p @ row)
        if var < 0:
            return math.inf
        mean = float(row @ self.x)
        if var == 0:
            return 0.0 if low <= mean <= high else math.inf
        return -truncated_moments((low - mean) / math.sqrt(var), (high - mean) / math.sqrt(var))[0]

    def project(self, rows: np.ndarray) -> State:
        return State(rows @ self.x, rows @ self.p @ rows.T)
