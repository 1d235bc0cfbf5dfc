"""Factor analysis of tall and wide sparse matrices on Spark DataFrames."""

from factorspark.matrix import SparseMatrix
from factorspark.operators.params import FitParams
from factorspark.session import Limits, tune

__all__ = ["FitParams", "Limits", "SparseMatrix", "tune"]
