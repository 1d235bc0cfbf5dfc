"""Algebra on k x k arrays, k being the number of components. Runs on the driver."""

from __future__ import annotations

import numpy as np


class RankError(ValueError):
    """A small matrix that has to be inverted is singular."""


def symmetric(a: np.ndarray) -> np.ndarray:
    return (a + a.T) / 2.0


def solve(a: np.ndarray, b: np.ndarray, what: str = "matrix") -> np.ndarray:
    """`inv(a) @ b` for a symmetric `a`, refusing a singular one."""
    a = symmetric(np.asarray(a, dtype=float))
    if not np.isfinite(a).all():
        raise RankError(f"{what} holds values that are not finite")
    values = np.abs(np.linalg.eigvalsh(a))
    if values.max() == 0 or values.min() <= values.max() * 1e-14:
        raise RankError(f"{what} is rank-deficient; use fewer components or another start")
    return np.linalg.solve(a, b)


def inverse(a: np.ndarray, what: str = "matrix") -> np.ndarray:
    return solve(a, np.eye(len(a)), what)


def orthonormalizer(gram: np.ndarray) -> np.ndarray:
    """K such that the columns of `W @ K` are orthonormal, largest direction first."""
    values, vectors = np.linalg.eigh(symmetric(gram))
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    if values[0] <= 0 or values[-1] <= values[0] * 1e-14:
        raise RankError("factor is rank-deficient; it has no full orthonormal basis")
    return vectors / np.sqrt(values)


def right_cholesky(gram: np.ndarray) -> np.ndarray:
    """The upper triangular R with `R' R = gram`."""
    return np.linalg.cholesky(symmetric(gram)).T


def whitener(gram: np.ndarray) -> np.ndarray:
    """`inv(R)` of the Cholesky factor; directions without weight are dropped if there are any."""
    gram = symmetric(gram)
    values, vectors = np.linalg.eigh(gram)
    keep = values > max(values[-1], 0.0) * 1e-13
    if keep.all():
        return np.linalg.inv(right_cholesky(gram))
    return vectors[:, keep] / np.sqrt(values[keep])
