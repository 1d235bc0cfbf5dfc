"""Column expressions for small vectors kept as numbered columns or as arrays."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: modulus of the universal hash below, the Mersenne prime 2^31 - 1.
HASH_PRIME = 2147483647


def names(prefix: str, k: int) -> list[str]:
    return [f"{prefix}_{j}" for j in range(k)]


def cols(prefix: str, k: int) -> list[Column]:
    return [F.col(c) for c in names(prefix, k)]


def total(terms: list[Column]) -> Column:
    return reduce(add, terms)


def sql_array(values) -> str:
    """Numbers as a SQL array of doubles, nested for a matrix."""
    if np.ndim(values) == 0:
        return f"{float(values)!r}D"
    return "array(" + ", ".join(sql_array(v) for v in values) + ")"


# Small matrices enter expressions as one array constant. Their numbers as constants of their
# own would become part of the generated code, which then had to be compiled in every round.


def combine(table: DataFrame, prefix: str, weights: np.ndarray, out: str, keep: Sequence[str] = ()) -> DataFrame:
    """Row vectors times a small matrix: `out_j = sum_i prefix_i * weights[i, j]`, a projection."""
    weights = np.asarray(weights, dtype=float)
    n, k = weights.shape
    product = (
        f"transform({sql_array(weights.T)}, "
        "w -> aggregate(zip_with(w, v_, (a, b) -> a * b), 0D, (s, x) -> s + x))"
    )
    return (
        table.selectExpr(*keep, f"array({', '.join(names(prefix, n))}) as v_")
        .selectExpr(*keep, f"{product} as v_")
        .selectExpr(*keep, *[f"v_[{j}] as {out}_{j}" for j in range(k)])
    )


def subtract(table: DataFrame, prefix: str, shift, out: str, keep: Sequence[str] = (), key: str = "row_id") -> DataFrame:
    """`out_j = prefix_j - shift[j]`, a projection inside generated code.

    The position is tied to a column (by adding zero), so that the array stays an array.
    """
    k = len(shift)
    ready = table.selectExpr(
        *keep, *names(prefix, k), f"{sql_array(shift)} as v_", f"cast(pmod({key}, 1) as int) as z_"
    )
    return ready.selectExpr(*keep, *[f"{prefix}_{j} - v_[z_ + {j}] as {out}_{j}" for j in range(k)])


def weighted_sums(table: DataFrame, keys: Sequence[str], weight: str, prefix: str, k: int, out: str) -> DataFrame:
    """Per group the sums `out_j = sum(weight * prefix_j)`, in one expression."""
    sums = ", ".join(f"sum({weight} * {prefix}_{j}) as {out}_{j}" for j in range(k))
    grouped = table.groupBy(*keys).agg(F.expr(f"struct({sums}) as v_"))
    return grouped.select(*keys, "v_.*")


def round4(x: Column) -> Column:
    return F.round(x, 4)


# --- arrays -----------------------------------------------------------------


def array_subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def array_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def array_times_matrix(a: Column, weights: np.ndarray) -> Column:
    """Array (length D) times a small D x k matrix, as an array of length k."""
    weights = np.asarray(weights, dtype=float)
    return F.array(*[array_dot(a, F.array(*[F.lit(float(w)) for w in weights[:, j]])) for j in range(weights.shape[1])])


# --- numbers from ids -------------------------------------------------------


def hash_constants(seed: int, stream: int) -> tuple[int, int]:
    """Multiplier and offset of one member of the universal hash family."""
    rnd = random.Random(f"{seed}/{stream}")
    return rnd.randrange(1, HASH_PRIME), rnd.randrange(HASH_PRIME)


def uniform(key: Column, seed: int, stream: int = 0) -> Column:
    """A number in (0, 1) that depends only on the key, the seed and the stream.

    The same under any partitioning, order or retry, unlike `rand`.
    """
    a, b = hash_constants(seed, stream)
    bucket = F.pmod(F.pmod(key, F.lit(HASH_PRIME)) * F.lit(a) + F.lit(b), F.lit(HASH_PRIME))
    return (bucket + F.lit(0.5)) / F.lit(float(HASH_PRIME))


def gaussian(key: Column, seed: int, stream: int = 0) -> Column:
    """A standard normal number per key, from two uniform ones."""
    u, v = uniform(key, seed, 2 * stream), uniform(key, seed, 2 * stream + 1)
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0 * math.pi) * v)


def formula_uniform(key: Column, j: int) -> Column:
    """A fixed start value for column `j` of a factor that any SQL engine can repeat."""
    residue = F.pmod(F.pmod(key, F.lit(1009)) * F.lit((j + 1) * 7919) + F.lit(j * 104729), F.lit(1009))
    return (residue + F.lit(1)) / F.lit(1010.0)
