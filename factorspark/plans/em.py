"""Probabilistic PCA by EM: the round, the loop around it and the three fits."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.functions.columns import combine, names
from factorspark.functions.smalldense import inverse, solve
from factorspark.matrix import SparseMatrix
from factorspark.operators.factors import TINY, init_factor, init_noise, orthonormal_basis, right_multiply
from factorspark.operators.moments import centered_frobenius, noise_variance
from factorspark.operators.params import FitParams
from factorspark.operators.small import products, to_arrays
from factorspark.plans.layout import Layout, Shift, gram_product, prepare
from factorspark.session import claim, path_exists, table_done


@dataclass
class Fit:
    """Result of a fit. Tables stay on the cluster; only `ss` and the metrics are local.

    factor    (col_id, w_0 ..), one row per column of the matrix
    encoder   k x k array E: the last round's latent rows were `Yc (W_before E)`
    before    the factor the last round started from
    metrics   one dict per round
    """

    factor: DataFrame
    before: DataFrame
    encoder: np.ndarray
    ss: float | None
    metrics: list[dict]
    layout: Layout
    k: int
    stopped_by: str = "max_rounds"

    @property
    def rounds(self) -> int:
        return len(self.metrics)

    def components(self) -> DataFrame:
        return orthonormal_basis(self.factor, self.k)


@dataclass
class Step:
    """What one round knows: sums over the table of old factor and `Yc'Yc W`."""

    ww: np.ndarray
    wp: np.ndarray
    pp: np.ndarray
    ss: float | None
    norm2: float | None


# An update gives K with `W_new = (Yc'Yc W) K`, the encoder and the new noise variance.
Update = Callable[[Step], tuple[np.ndarray, np.ndarray, float | None]]
# A product gives `Yc'Yc W` for a factor and its number of components.
Product = Callable[[DataFrame, int, int], DataFrame]
# A score looks at the new factor and at the map from centred rows to latent rows of the round.
Score = Callable[[DataFrame, DataFrame], float]


def wide_update(step: Step) -> tuple[np.ndarray, np.ndarray, None]:
    """Zero-noise M-step: `W_new = Yc'X (X'X)^-1 W'W` with `X = Yc W`, so `X'X = W'P`."""
    return solve(step.wp, step.ww, "X'X"), inverse(step.ww, "W'W"), None


def noise_update(n_rows: int, n_cols: int) -> Update:
    """M-step with noise, from the same product of the data."""

    def update(step: Step):
        k = len(step.ww)
        sx = inverse(step.ww + step.ss * np.eye(k), "C'C + ss I")
        xtx = sx @ step.wp @ sx.T + step.ss * n_rows * sx
        to_new = sx.T @ inverse(xtx, "X'X")
        ctc = to_new.T @ step.pp @ to_new
        return to_new, sx.T, noise_variance(step.norm2, xtx, ctc, n_rows, n_cols)

    return update


@dataclass
class Loop:
    """EM rounds over a prepared matrix.

    Each round writes one table `(col_id, mean, w.., p.., ss)` below the shared folder:
    the factor it started from next to the product of the data with it. The new factor is
    a projection of that table, so the lineage never grows, and a broken fit continues
    from the last table that is complete.

    The tables lie below `rounds/run=<mark>/attempt=<n>`. The mark stands for method, size, start and
    cells, so a fit continues its own rounds only; a fit that does not resume takes a new attempt and
    leaves the tables of others as they are.
    """

    layout: Layout
    k: int
    update: Update
    product: Product | None = None
    max_rounds: int = 3
    tolerance: float | None = None
    ss_tolerance: float | None = None
    track_change: bool = False
    score: Score | None = None
    score_tolerance: float | None = None
    needs_norm: bool = False
    method: str = "wide"
    folder: str = ""
    metrics: list[dict] = field(default_factory=list)

    def path(self, r: int) -> str:
        return f"{self.folder}/round={r}"

    def mark(self, start: DataFrame, ss: float | None) -> str:
        """A digest of method, size, start and cells, their values included, whatever the order of rows."""
        matrix = self.layout.matrix
        rows = start.select(F.xxhash64("col_id", *names("w", self.k)).cast("decimal(38,0)").alias("h"))
        keys = [c for c in ("site", "col_id", "n_nonzero", "digest") if c in self.layout.stats.columns]
        cells = self.layout.stats.select(F.xxhash64(*keys).cast("decimal(38,0)").alias("h"))
        hashed = [table.agg(F.sum("h"), F.count("h")).first() for table in (rows, cells)]
        told = (self.method, self.k, matrix.n_rows, matrix.n_cols, None if ss is None else float(ss), *map(tuple, hashed))
        return hashlib.sha256(repr(told).encode()).hexdigest()[:16]

    def _own_folder(self, start: DataFrame, ss: float | None, resume: bool) -> str:
        """The last attempt of the same fit if it is to be resumed, else a new one, which no other fit can take as well."""
        spark, rounds = start.sparkSession, f"{self.layout.folder}/rounds"
        run, n = f"{rounds}/run={self.mark(start, ss)}", 0
        while path_exists(spark, f"{run}/attempt={n}"):
            n += 1
        if resume and n == 0 and path_exists(spark, rounds):
            raise ValueError(f"nothing to resume: the rounds below {rounds} belong to fits with another method, size, start or other cells")
        if resume and n:
            return f"{run}/attempt={n - 1}"
        while not claim(spark, f"{run}/attempt={n}/owner"):
            n += 1
        return f"{run}/attempt={n}"

    def run(self, start: DataFrame, ss: float | None = None, resume: bool = False) -> Fit:
        spark, k = start.sparkSession, self.k
        norm2 = centered_frobenius(self.layout.stats).first()["norm2"] if self.needs_norm else None
        self.folder = self._own_folder(start, ss, resume)
        start, begin = self._begin(start, resume)
        current, shift = start, list(begin["mw"].ravel())
        last, stopped, to_new, encoder = None, None, None, None
        for r in range(self.max_rounds):
            began = time.time()
            done = resume and table_done(spark, self.path(r))
            if not done:
                self._write(r, current, shift, ss)
            last = spark.read.schema(self._schema()).parquet(self.path(r))
            sums = self._sums(last)
            if done:
                ss = last.select("ss").first()["ss"]
            # Columns without cells take part in W'W of the start only; later they are zero.
            ww = begin["ww"] if r == 0 else sums["ww"]
            to_new, encoder, new_ss = self.update(Step(ww, sums["wp"], sums["pp"], ss, norm2))
            current = combine(last, "p", to_new, "w", keep=["col_id", "mean"])
            shift = list((sums["mp"] @ to_new).ravel())
            row = {"round": r + 1, "ss": new_ss, "dw": None, "error": None}
            if self.tolerance is not None or self.track_change:
                row["dw"] = self._change(last, to_new, start if r == 0 else None)
            if self.score is not None:
                row["error"] = self.score(current.drop("mean"), right_multiply(last, encoder))
            row["seconds"] = time.time() - began
            self.metrics.append(row)
            stopped, ss = self._stop(row, ss if r else None), new_ss
            if stopped:
                break
        full = self._full(right_multiply(last, to_new, prefix="p"))
        before = start.drop("mean") if len(self.metrics) == 1 else self._full(last.select("col_id", *names("w", k)))
        return Fit(full, before, encoder, ss, self.metrics, self.layout, k, stopped or "max_rounds")

    # -- one round

    def _begin(self, start: DataFrame, resume: bool) -> tuple[DataFrame, dict]:
        """The start factor as a table, so that the planner knows its size, and its sums."""
        spark, w, path = start.sparkSession, names("w", self.k), f"{self.folder}/start"
        if not (resume and table_done(spark, path)):
            placed = start.join(self._means(), "col_id", "left").select("col_id", "mean", *w)
            placed.fillna(0.0).write.mode("overwrite").parquet(path)
        schema = ", ".join(["col_id bigint", *[f"{c} double" for c in ["mean", *w]]])
        table = spark.read.schema(schema).parquet(path)
        specs = {"ww": (w, w), "mw": (["mean"], w)}
        return table, to_arrays(products(table, specs), specs)

    def _means(self) -> DataFrame:
        if not self.layout.matrix.has_sites:
            return self.layout.stats.select("col_id", "mean")
        totals = self.layout.stats.groupBy("col_id").agg(F.sum("total").alias("total"))
        return totals.select("col_id", (F.col("total") / F.lit(float(self.layout.matrix.n_rows))).alias("mean"))

    def _write(self, r: int, current: DataFrame, shift: Shift, ss: float | None) -> None:
        """Next to each factor row its row of the product, for the columns that have cells."""
        factor = current.drop("mean")
        if self.product is None:
            moved = gram_product(self.layout, factor, self.k, shift)
        else:
            moved = self.product(factor, self.k, r)
        noise = F.lit(None if ss is None else float(ss)).cast("double")
        joined = current.join(moved, "col_id").withColumn("ss", noise)
        joined.write.mode("overwrite").parquet(self.path(r))

    def _schema(self) -> str:
        doubles = ["mean", *names("w", self.k), *names("p", self.k), "ss"]
        return ", ".join(["col_id bigint", *[f"{c} double" for c in doubles]])

    def _sums(self, table: DataFrame) -> dict:
        w, p = names("w", self.k), names("p", self.k)
        specs = {"ww": (w, w), "wp": (w, p), "pp": (p, p), "mp": (["mean"], p)}
        return to_arrays(products(table, specs), specs)

    def _change(self, table: DataFrame, to_new: np.ndarray, start: DataFrame | None) -> float:
        both = combine(table, "p", to_new, "n", keep=names("w", self.k))
        top = both.agg(
            *[F.expr(f"max(abs(w_{j} - n_{j}))") for j in range(self.k)],
            *[F.expr(f"max(abs(n_{j}))") for j in range(self.k)],
        ).first()
        moved = max(top[: self.k])
        if start is not None:
            # Columns without cells go from their start to zero.
            empty = start.join(table.select("col_id"), "col_id", "left_anti")
            gone = empty.agg(*[F.expr(f"max(abs(w_{j}))") for j in range(self.k)]).first()
            moved = max([moved, *[g for g in gone if g is not None]])
        return moved / (TINY + max(top[self.k :]))

    def _stop(self, row: dict, ss: float | None) -> str | None:
        if self.tolerance is not None and row["dw"] <= self.tolerance:
            return "dw"
        if self.score_tolerance is not None and row["error"] <= self.score_tolerance:
            return "error"
        if self.ss_tolerance is not None and ss is not None and abs(1 - row["ss"] / ss) <= self.ss_tolerance:
            return "ss"
        return None

    def _full(self, factor: DataFrame) -> DataFrame:
        """One row per column of the matrix, zeros where a column has no cells."""
        every = factor.sparkSession.range(self.layout.matrix.n_cols).withColumnRenamed("id", "col_id")
        return every.join(factor, "col_id", "left").fillna(0.0)


def _start(matrix: SparseMatrix, params: FitParams, init: str | DataFrame) -> DataFrame:
    if isinstance(init, DataFrame):
        return init
    return init_factor(matrix.spark, matrix.n_cols, params.n_components, init, params.seed)


def ppca_em_wide(
    matrix: SparseMatrix,
    params: FitParams,
    init: str | DataFrame = "uniform",
    layout: Layout | None = None,
    folder: str | None = None,
    resume: bool = False,
    track_change: bool = False,
) -> Fit:
    """Zero-noise EM for matrices with many columns; stops on `dw <= tolerance`."""
    params = params.checked(matrix.n_rows, matrix.n_cols)
    k = params.n_components
    layout = layout or prepare(matrix, k, folder=folder)
    loop = Loop(
        layout, k, wide_update, max_rounds=params.max_rounds, tolerance=params.tolerance, track_change=track_change
    )
    return loop.run(_start(matrix, params, init), resume=resume)


def ppca_em(
    matrix: SparseMatrix,
    params: FitParams,
    init: str | DataFrame = "uniform",
    ss: float | None = None,
    layout: Layout | None = None,
    folder: str | None = None,
    resume: bool = False,
    score: Score | None = None,
    score_tolerance: float | None = None,
) -> Fit:
    """EM with a noise term; stops when the noise variance settles or the score is low enough."""
    params = params.checked(matrix.n_rows, matrix.n_cols)
    k = params.n_components
    layout = layout or prepare(matrix, k, folder=folder)
    loop = Loop(
        layout,
        k,
        noise_update(matrix.n_rows, matrix.n_cols),
        max_rounds=params.max_rounds,
        ss_tolerance=params.ss_tolerance,
        score=score,
        score_tolerance=score_tolerance,
        needs_norm=True,
        method="noise",
    )
    start_ss = init_noise(params.seed) if ss is None else ss
    return loop.run(_start(matrix, params, init), ss=start_ss, resume=resume)
