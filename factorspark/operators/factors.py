"""Steps on factor tables `(col_id, w_0 ..)`."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.functions.columns import combine, formula_uniform, gaussian, names, uniform
from factorspark.functions.smalldense import inverse, orthonormalizer, right_cholesky
from factorspark.operators.small import products, to_arrays

# Start of the noise variance and of a 5 x 3 factor, for checks.
VALIDATION_SS = 0.9644868606768501
VALIDATION_FACTOR = [
    [0.730967787376657, 0.24053641567148587, 0.6374174253501083],
    [0.5504370051176339, 0.5975452777972018, 0.3332183994766498],
    [0.3851891847407185, 0.984841540199809, 0.8791825178724801],
    [0.9412491794821144, 0.27495396603548483, 0.12889715087377673],
    [0.14660165764651822, 0.023238122483889456, 0.5467397571984656],
]

# Fixed value: keeps the relative change defined when the new factor is zero.
TINY = 2.2204e-16


def init_factor(spark: SparkSession, n_cols: int, k: int, mode: str = "uniform", seed: int = 42) -> DataFrame:
    """A start factor with one row for each column of the matrix.

    `uniform` and `gaussian` depend on the column id and the seed only; `formula` is a
    fixed rule other engines can repeat.
    """
    make = {
        "uniform": lambda c, j: uniform(c, seed, stream=10 + j),
        "gaussian": lambda c, j: gaussian(c, seed, stream=10 + j),
        "formula": formula_uniform,
    }
    if mode not in make:
        raise ValueError(f"mode must be one of {sorted(make)}")
    col = F.col("col_id")
    return spark.range(n_cols).select(
        F.col("id").alias("col_id"), *[make[mode](F.col("id"), j).alias(f"w_{j}") for j in range(k)]
    )


def init_noise(seed: int = 42) -> float:
    """A start value in (0, 1) for the noise variance."""
    return float(np.random.default_rng(seed).uniform(0.0, 1.0))


def init_validation(spark: SparkSession) -> DataFrame:
    """The fixed 5 x 3 start factor; its noise variance is `VALIDATION_SS`."""
    rows = [(c, *values) for c, values in enumerate(VALIDATION_FACTOR)]
    return spark.createDataFrame(rows, "col_id bigint, w_0 double, w_1 double, w_2 double")


def right_multiply(factor: DataFrame, weights: np.ndarray, prefix: str = "w", out: str = "w") -> DataFrame:
    """`W K` for a small K: a projection, no shuffle."""
    return combine(factor, prefix, weights, out, keep=["col_id"])


def gram_array(factor: DataFrame, k: int, prefix: str = "w") -> np.ndarray:
    c = names(prefix, k)
    specs = {"ww": (c, c)}
    return to_arrays(products(factor, specs), specs)["ww"]


def posterior_map(factor: DataFrame, k: int, ss: float) -> tuple[DataFrame, np.ndarray]:
    """The map from centred rows to latent rows, `C Sx`, and `Sx = inv(C'C + ss I)`."""
    sx = inverse(gram_array(factor, k) + ss * np.eye(k), "C'C + ss I")
    return right_multiply(factor, sx.T), sx


def orthonormal_basis(factor: DataFrame, k: int) -> DataFrame:
    """Orthonormal columns with the span of the factor, ordered by size.

    The entry of largest size in each column is made positive; among equals the smallest
    column id decides.
    """
    raw = right_multiply(factor, orthonormalizer(gram_array(factor, k)), out="u")
    peaks = raw.agg(
        *[F.max_by(f"u_{j}", F.struct(F.abs(F.col(f"u_{j}")), -F.col("col_id"))).alias(f"t_{j}") for j in range(k)]
    ).first()
    signs = [-1.0 if peaks[f"t_{j}"] < 0 else 1.0 for j in range(k)]
    return raw.select("col_id", *[(F.col(f"u_{j}") * F.lit(s)).alias(f"u_{j}") for j, s in enumerate(signs)])


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two factor tables side by side; a column missing on one side is zero there."""
    joined = left.join(right, "col_id", "full_outer")
    return joined.select("col_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in joined.columns if c != "col_id"])


def deflate(sketch: DataFrame, basis: DataFrame, s: int, k: int) -> DataFrame:
    """`B - V V'B` for `B(col_id, w_0 ..)` and an orthonormal `V(col_id, u_0 ..)`."""
    both = paired(sketch, basis)
    u, w = names("u", k), names("w", s)
    specs = {"ub": (u, w)}
    inner = to_arrays(products(both, specs), specs)["ub"]
    return combine(both, "u", inner, "r", keep=["col_id", *w]).select(
        "col_id", *[(F.col(f"w_{j}") - F.col(f"r_{j}")).alias(f"w_{j}") for j in range(s)]
    )


def tall_orthonormalize(moment: DataFrame, ztz: np.ndarray, prefix: str = "m") -> DataFrame:
    """`Y'Q` for the orthonormal `Q = Z inv(R)`, `R` the Cholesky factor of `Z'Z`.

    `moment` holds `Y'Z`; Q itself, which is as tall as the data, is never formed.
    """
    return right_multiply(moment, np.linalg.inv(right_cholesky(ztz)), prefix=prefix)


def compare_factors(old: DataFrame, new: DataFrame, k: int) -> DataFrame:
    """Old and new factor side by side as `o_j` and `w_j`."""
    before = old.select("col_id", *[F.col(f"w_{j}").alias(f"o_{j}") for j in range(k)])
    return paired(before, new.select("col_id", *names("w", k)))


def factor_change(pairs: DataFrame, k: int) -> DataFrame:
    """Largest change of an entry relative to the largest new entry, one row."""
    moved = [F.abs(F.col(f"o_{j}") - F.col(f"w_{j}")) for j in range(k)]
    size = [F.abs(F.col(f"w_{j}")) for j in range(k)]
    top = (lambda c: c[0]) if k == 1 else (lambda c: F.greatest(*c))
    return pairs.agg(F.max(top(moved)).alias("max_change"), F.max(top(size)).alias("max_new")).select(
        "max_change", "max_new", (F.col("max_change") / (F.lit(TINY) + F.col("max_new"))).alias("dw")
    )
