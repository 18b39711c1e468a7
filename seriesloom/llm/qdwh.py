"""Leading eigenvectors of a symmetric matrix by spectral divide and conquer.

The polar factor of ``A - shift * I`` has the eigenvalues -1 and 1, for the eigenvalues of A
below and above the shift. So half of it and the identity is the projector on the subspace
above; A restricted to that subspace and to its complement are two smaller problems without
common eigenvalues. The polar factor comes from the dynamically weighted Halley iteration
(QDWH): by QR while the matrix is badly conditioned, by Cholesky after.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Iterations that the weighted Halley iteration never needs in double precision; six are usual.
MOST = 12


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal factor of the polar decomposition of a symmetric ``a``, itself symmetric."""
    n = len(a)
    x = a / np.linalg.norm(a)
    low = EPS  # a bound below the singular values of x that count
    for _ in range(MOST):
        square = low * low
        d = np.cbrt(4 * (1 - square) / square**2) if low < 1 else 0.0
        root = np.sqrt(1 + d)
        weight = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root))
        b = (weight - 1) ** 2 / 4
        c = weight + b - 1
        before = x
        if c > 100:
            q = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(n)]))[0]
            x = b / c * x + (weight - b / c) / np.sqrt(c) * q[:n] @ q[n:].T
        else:
            lower = np.linalg.cholesky(np.eye(n) + c * x.T @ x)
            x = b / c * x + (weight - b / c) * np.linalg.solve(lower.T, np.linalg.solve(lower, x)).T
        x = (x + x.T) / 2
        low = min(1.0, low * (weight + b * square) / (1 + c * square))
        if abs(1 - low) < 10 * EPS and np.linalg.norm(x - before) < np.cbrt(EPS):
            break
    return x


def split(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces above and below ``shift``; none if it does not part them."""
    n = len(a)
    projector = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2
    above = round(np.trace(projector))
    if not 0 < above < n:
        return None
    q = np.random.default_rng(n).standard_normal((n, n))
    for _ in range(2):  # the second round only mends rounding
        q[:, :above] = projector @ q[:, :above]
        q = np.linalg.qr(q)[0]
    upper, lower = q[:, :above], q[:, above:]
    if np.linalg.norm(upper.T @ a @ lower) > 50 * n * EPS * np.linalg.norm(a):
        return None  # the shift is an eigenvalue, or too near to one
    return upper, lower


def leading_eigenvectors(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and unit eigenvectors as columns.

    Eigenvalues that agree to rounding get any orthonormal basis of their common subspace.
    """
    values, vectors = _leading((a + a.T) / 2, min(count, len(a)), EPS * np.linalg.norm(a))
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _leading(a: np.ndarray, count: int, noise: float) -> tuple[np.ndarray, np.ndarray]:
    n = len(a)
    middle = np.trace(a) / n
    spread = np.linalg.norm(a - middle * np.eye(n))
    if n == 1 or spread <= noise:
        return np.diag(a)[:count].copy(), np.eye(n)[:, :count]
    # The mean of the eigenvalues lies strictly between the outer ones; near it, others do.
    for step in (0.0, 1e-3, -1e-3, 1e-2, -1e-2, 0.1, -0.1):
        parts = split(a, middle + step * spread / np.sqrt(n))
        if parts is not None:
            break
    else:  # eigenvalues that no shift tells apart: one subspace up to rounding
        if spread > 1e4 * n * noise:
            raise ArithmeticError("the spectrum could not be divided")
        return np.diag(a)[:count].copy(), np.eye(n)[:, :count]
    values, vectors = [], []
    for basis in parts:
        if count > 0:
            found, inner = _leading_of(a, basis, count, noise)
            values.append(found)
            vectors.append(basis @ inner)
            count -= len(found)
    return np.concatenate(values), np.hstack(vectors)


def _leading_of(a: np.ndarray, basis: np.ndarray, count: int, noise: float) -> tuple[np.ndarray, np.ndarray]:
    inner = basis.T @ a @ basis
    return _leading((inner + inner.T) / 2, min(count, basis.shape[1]), noise)
