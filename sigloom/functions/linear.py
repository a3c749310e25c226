"""Matrices on the driver and in kernels: symmetric eigenproblems, SPD geometry, decoders, statistics of F."""

from __future__ import annotations

import math

import numpy as np


def fixed_sign(vectors: np.ndarray) -> np.ndarray:
    """Columns turned so that their component of largest size is positive."""
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return vectors * np.where(top < 0, -1.0, 1.0)


def eigen_symmetric(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the largest down, eigenvectors as columns of fixed sign."""
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    return values[::-1], fixed_sign(vectors[:, ::-1])


def generalized_eigen(a: np.ndarray, b: np.ndarray, ridge: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """A w = v B w for positive definite B + ridge I; eigenvectors of unit length."""
    low = np.linalg.cholesky(b + ridge * np.eye(len(b)))
    inverse = np.linalg.inv(low)
    values, vectors = eigen_symmetric(inverse @ a @ inverse.T)
    w = inverse.T @ vectors
    return values, fixed_sign(w / np.linalg.norm(w, axis=0))


def of_eigen(m: np.ndarray, f) -> np.ndarray:
    """f applied to the eigenvalues of (stacked) symmetric matrices."""
    values, vectors = np.linalg.eigh((m + np.swapaxes(m, -1, -2)) / 2)
    return (vectors * f(values)[..., None, :]) @ np.swapaxes(vectors, -1, -2)


def _positive(f):
    def run(values: np.ndarray) -> np.ndarray:
        if (values <= 0).any():
            raise ValueError("matrix is not positive definite")
        return f(values)

    return run


matrix_log = lambda m: of_eigen(m, _positive(np.log))
matrix_exp = lambda m: of_eigen(m, np.exp)
matrix_sqrt = lambda m: of_eigen(m, _positive(np.sqrt))
matrix_inv_sqrt = lambda m: of_eigen(m, _positive(lambda v: 1 / np.sqrt(v)))


def whitening(cov: np.ndarray, epsilon: float = 1e-6, mode: str = "zca") -> np.ndarray:
    values, vectors = eigen_symmetric(cov)
    half = (vectors / np.sqrt(np.maximum(values + epsilon, epsilon))).T
    return vectors @ half if mode == "zca" else half


def riemannian_distance(a: np.ndarray, b: np.ndarray) -> float:
    r = matrix_inv_sqrt(a)
    return float(np.sqrt((np.log(np.linalg.eigvalsh(r @ b @ r)) ** 2).sum()))


def tangent(p: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Upper triangle of R^1/2 log(R^-1/2 P R^-1/2) R^1/2, off-diagonal as it is."""
    root, inverse = matrix_sqrt(reference), matrix_inv_sqrt(reference)
    return (root @ matrix_log(inverse @ p @ inverse) @ root)[np.triu_indices(len(p))]


def from_tangent(v: np.ndarray, reference: np.ndarray) -> np.ndarray:
    n = len(reference)
    s = np.zeros((n, n))
    s[np.triu_indices(n)] = v
    s = s + s.T - np.diag(np.diag(s))
    root, inverse = matrix_sqrt(reference), matrix_inv_sqrt(reference)
    return root @ matrix_exp(inverse @ s @ inverse) @ root


def recenter(c: np.ndarray, mean: np.ndarray) -> np.ndarray:
    m = matrix_inv_sqrt(mean)
    return m @ c @ m


def frechet_step(mean: np.ndarray, logs: np.ndarray, rate: float) -> np.ndarray:
    """The mean moved along the mean logarithm."""
    root = matrix_sqrt(mean)
    return root @ matrix_exp(rate * logs) @ root


def frechet_mean(stack: np.ndarray, most: int = 50, tolerance: float = 1e-8) -> np.ndarray:
    mean, rate, last = stack.mean(axis=0), 1.0, math.inf
    best = mean
    for _ in range(most):
        inverse = matrix_inv_sqrt(mean)
        logs = matrix_log(inverse @ stack @ inverse).mean(axis=0)
        size = float(np.linalg.norm(logs))
        if size < last:
            best, rate, last = mean, rate * 0.95, size
        else:
            rate *= 0.5
        if size <= tolerance or rate <= 1e-12:
            break
        mean = frechet_step(mean, logs, rate)
    return best


def mdm(trial: np.ndarray, means: list[np.ndarray]) -> tuple[int, float]:
    d = [riemannian_distance(trial, m) for m in means]
    k = int(np.argmin(d))
    return k, d[k]


def csp_filters(first: np.ndarray, second: np.ndarray, k: int, ridge: float = 1e-6) -> np.ndarray:
    """Rows: k/2 filters of the largest and k/2 of the least share of the first covariance."""
    _, w = generalized_eigen(first, first + second, ridge)
    return np.concatenate([w[:, : k - k // 2].T, w[:, w.shape[1] - k // 2 :].T])


def xdawn_filters(evoked: np.ndarray, signal_cov: np.ndarray, k: int, ridge: float = 1e-6) -> np.ndarray:
    """Rows: the k filters that favour the evoked response (t x channels) over the whole signal."""
    _, w = generalized_eigen(evoked.T @ evoked / len(evoked), signal_cov, ridge)
    return w[:, :k].T


def cca(x: np.ndarray, y: np.ndarray, ridge: float = 1e-6) -> np.ndarray:
    """Canonical correlations from the largest down."""
    x, y = x - x.mean(axis=0), y - y.mean(axis=0)
    n = max(1, len(x) - 1)
    return canonical(x.T @ x / n, y.T @ y / n, x.T @ y / n, ridge)


def canonical(a: np.ndarray, b: np.ndarray, c: np.ndarray, ridge: float = 1e-6) -> np.ndarray:
    """The same from the covariances of both sides and between them."""
    wa, wb = (np.linalg.inv(np.linalg.cholesky(m + ridge * np.eye(len(m)))) for m in (a, b))
    k = wa @ c @ wb.T
    return np.clip(np.sqrt(np.clip(eigen_symmetric(k @ k.T)[0], 0, None)), 0, 1)[: min(c.shape)]


def ssvep_references(fs: float, n: int, frequency: float, harmonics: int) -> np.ndarray:
    at = 2 * math.pi * frequency * np.arange(n) / fs
    return np.stack([f((h + 1) * at) for h in range(harmonics) for f in (np.sin, np.cos)], axis=1)


#: Contrasts of ICA: g and its derivative.
CONTRASTS = {"logcosh": (np.tanh, lambda u: 1 - np.tanh(u) ** 2), "exp": (lambda u: u * np.exp(-u * u / 2), lambda u: (1 - u * u) * np.exp(-u * u / 2)), "cube": (lambda u: u**3, lambda u: 3 * u * u)}


def decorrelate(w: np.ndarray) -> np.ndarray:
    return matrix_inv_sqrt(w @ w.T) @ w


def lda(means: np.ndarray, scatter: np.ndarray, counts: np.ndarray, shrinkage: float = 0.01) -> tuple[np.ndarray, float, float]:
    """(unit weights, threshold, sigma) of two classes; at or above the threshold is class 0."""
    c = len(scatter)
    pooled = (1 - shrinkage) * scatter + shrinkage * np.trace(scatter) / c * np.eye(c)
    w = np.linalg.solve(pooled, means[0] - means[1])
    w = w / np.linalg.norm(w)
    return w, float(w @ (means[0] + means[1]) / 2), math.sqrt(max(float(w @ scatter @ w) / max(1, counts.sum() - 2), 1e-300))


class Kalman:
    """Linear filter with the Joseph form; ``step`` returns state, covariance and innovation."""

    def __init__(self, f, h, q, r, x0, p0):
        self.f, self.h, self.q, self.r, self.x, self.p = (np.array(m, float) for m in (f, h, q, r, x0, p0))

    def step(self, z) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.x, self.p = self.f @ self.x, self.f @ self.p @ self.f.T + self.q
        innovation = np.atleast_1d(z) - self.h @ self.x
        s = self.h @ self.p @ self.h.T + self.r
        gain = np.linalg.solve(s, self.h @ self.p).T
        self.x = self.x + gain @ innovation
        rest = np.eye(len(self.x)) - gain @ self.h
        p = rest @ self.p @ rest.T + gain @ self.r @ gain.T
        self.p = (p + p.T) / 2
        return self.x, self.p, innovation


def incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for k in range(400):
        m = k // 2
        term = 1.0 if k == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d if abs(1 + term * d) > tiny else tiny)
        c = 1 + term / c if abs(1 + term / c) > tiny else tiny
        f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * (f - 1)


def f_survival(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    return 1.0 if f <= 0 else incomplete_beta(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def least_squares_rss(columns: np.ndarray, target: np.ndarray) -> float:
    """Residual sum of squares of a regression without intercept, with a slight ridge."""
    gram = columns.T @ columns
    gram += 1e-10 * np.trace(gram) / len(gram) * np.eye(len(gram))
    return float(((target - columns @ np.linalg.solve(gram, columns.T @ target)) ** 2).sum())


def _lags(x: np.ndarray, order: int) -> np.ndarray:
    return np.stack([x[order - k - 1 : len(x) - k - 1] for k in range(order)], axis=1)


def granger(x: np.ndarray, y: np.ndarray, order: int, z: np.ndarray | None = None) -> tuple[float, float, float, float]:
    """(F, p, restricted variance, full variance): whether x helps to foretell y (given z)."""
    n = len(y) - order
    own = [_lags(s, order) for s in ([y] if z is None else [y, z])]
    target = y[order:]
    r0, r1 = least_squares_rss(np.hstack(own), target), least_squares_rss(np.hstack([*own, _lags(x, order)]), target)
    d2 = n - (len(own) + 1) * order
    if r1 <= 0 or d2 <= 0:
        return 0.0, 1.0, r0 / n, r1 / n
    f = max(0.0, (r0 - r1) / order / (r1 / d2))
    return f, f_survival(f, order, d2), r0 / n, r1 / n
