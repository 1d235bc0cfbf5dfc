"""Checked parameters of a fit."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class FitParams:
    """What a caller may ask for; `checked` gives what a fit will use.

    n_components  k; as many as there are columns means one less, with a warning
    max_rounds    upper bound for EM rounds
    tolerance     stop when the factor changes by no more than this (None: do not look)
    ss_tolerance  stop when the noise variance changes by no more than this share
    subsample     extra sketch columns, cut down to what the matrix has left, with a warning
    sample_rate   share of rows looked at by sampled errors, whatever the size of the matrix
    """

    n_components: int
    max_rounds: int = 3
    tolerance: float | None = None
    ss_tolerance: float = 1e-5
    subsample: int = 10
    sample_rate: float = 1.0
    seed: int = 42

    def checked(self, n_rows: int, n_cols: int) -> FitParams:
        if n_rows <= 0 or n_cols <= 1:
            raise ValueError("the matrix needs at least one row and two columns")
        k = n_cols - 1 if self.n_components == n_cols else self.n_components
        if not 0 < k < n_cols:
            raise ValueError(f"n_components must lie between 1 and {n_cols}, got {self.n_components}")
        if self.max_rounds < 1:
            raise ValueError("max_rounds must be at least 1")
        if self.tolerance is not None and self.tolerance < 0:
            raise ValueError("tolerance must not be negative")
        subsample = n_cols - k if k + self.subsample >= n_cols else self.subsample
        if not 0 < self.sample_rate <= 1:
            raise ValueError("sample_rate must lie in (0, 1]")
        for what, asked, used in (("n_components", self.n_components, k), ("subsample", self.subsample, subsample)):
            if asked != used:
                warnings.warn(f"{what} is {used} instead of {asked}: the matrix has {n_cols} columns", stacklevel=2)
        return replace(self, n_components=k, subsample=subsample)
