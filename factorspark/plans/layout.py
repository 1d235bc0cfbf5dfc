"""A matrix laid out once for many passes, and the pass itself.

Rows are spread over `parts` and stay there: a round moves neither cells nor latent rows,
only factor rows and column sums.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.functions.columns import names, subtract, weighted_sums
from factorspark.matrix import SparseMatrix
from factorspark.operators.moments import col_stats
from factorspark.session import new_dir

# Cells that are multiplied at a time, and a row more, and columns that their factor rows come in.
CELLS_AT_ONCE, COLUMNS = 1 << 20, 1 << 16

# Shifts of a pass: one number per component, or a table (site, x_0 ..) of them.
Shift = Sequence[float] | DataFrame


@dataclass
class Layout:
    """Persisted cells of one matrix.

    light   (part, [site,] row_id, col_id, value), each row inside one part
    heavy   cells of rows too large for one task, or None
    needs   which columns each part refers to, kept when factors are too large to broadcast
    stats   written table of `col_stats`, with digests of the cells
    """

    matrix: SparseMatrix
    light: DataFrame
    heavy: DataFrame | None
    needs: DataFrame | None
    stats: DataFrame
    parts: int
    n_heavy: int
    folder: str
    _packed: DataFrame | None = field(default=None, repr=False)
    _kept: DataFrame | None = field(default=None, repr=False)

    def holds(self, doubles: int) -> bool:
        """Was it prepared for a table of that many numbers per column?"""
        return self.needs is not None or self.matrix.limits.fits(self.matrix.n_cols, doubles)

    def packed(self) -> DataFrame:
        """The light cells as arrays, `CELLS_AT_ONCE` in whole rows by block of columns; persisted, made by the first pass that asks."""
        if self._packed is None:
            schema = "chunk bigint, block int, n_rows int, at binary, cols binary, cell_values binary"
            cells = self.light.select("row_id", "col_id", "value").mapInArrow(_packer(CELLS_AT_ONCE, COLUMNS), schema)
            self._packed = cells.persist(StorageLevel.MEMORY_AND_DISK)
        return self._packed

    def kept(self, sums: DataFrame) -> DataFrame:
        """Persist the sums of a pass that are read more than once; those of the pass before are let go."""
        if self._kept is not None:
            self._kept.unpersist()
        self._kept = sums.persist(StorageLevel.MEMORY_AND_DISK)
        return self._kept

    def release(self) -> None:
        for table in (self.light, self.heavy, self.needs, self._packed, self._kept):
            if table is not None:
                table.unpersist()


def prepare(matrix: SparseMatrix, k: int, parts: int | None = None, folder: str | None = None) -> Layout:
    """Lay a matrix out for passes with up to `k` components."""
    spark, limits = matrix.spark, matrix.limits
    folder = folder or new_dir(spark, "fit")
    if parts is None:
        parts = max(spark.sparkContext.defaultParallelism, math.ceil(matrix.n_cells / limits.cells_per_part))
    cells, heavy, n_heavy = matrix.entries, None, 0
    hot = matrix.hot_keys(matrix.row_keys)
    if hot is not None:
        # At most limits.max_hot rows can be hot, so the list of them is always small.
        hot = F.broadcast(hot.select(*matrix.row_keys))
        n_heavy = hot.count()
        heavy = cells.join(hot, matrix.row_keys, "left_semi").select(*matrix.row_keys, "col_id", "value")
        heavy = heavy.repartition(parts, "col_id").persist(StorageLevel.MEMORY_AND_DISK)
        cells = cells.join(hot, matrix.row_keys, "left_anti")
    whole = limits.fits(matrix.n_cols, k)
    # With needed columns per part the parts are keyed by hash, so that factor rows can be
    # sent to them; more keys than partitions even out the load.
    groups = parts if whole else 4 * parts
    cells = cells.select(
        F.pmod(F.hash(*matrix.row_keys), F.lit(groups)).alias("part"), *matrix.row_keys, "col_id", "value"
    )
    cells = cells.repartitionById(parts, F.col("part")) if whole else cells.repartition(parts, "part")
    light = cells.sortWithinPartitions("part", *matrix.row_keys).persist(StorageLevel.MEMORY_AND_DISK)
    needs = None
    if not whole:
        needs = light.select("part", "col_id").distinct().repartition(parts, "col_id")
        needs = needs.persist(StorageLevel.MEMORY_AND_DISK)
    everything = light.select(*matrix.row_keys, "col_id", "value")
    if heavy is not None:
        everything = everything.unionByName(heavy)
    col_stats(matrix.with_entries(everything), digest=True).write.mode("overwrite").parquet(f"{folder}/col_stats")
    stats = spark.read.parquet(f"{folder}/col_stats")
    return Layout(matrix, light, heavy, needs, stats, parts, n_heavy, folder)


def latent(layout: Layout, factor: DataFrame, k: int) -> tuple[DataFrame, DataFrame | None]:
    """`Y W` of the light rows, which stays in place by part, and of the heavy rows."""
    matrix, limits = layout.matrix, layout.matrix.limits
    small = limits.fits(matrix.n_cols, k)
    keys = ["part", *matrix.row_keys]
    if small:
        joined = layout.light.join(F.broadcast(factor), "col_id")
    elif layout.needs is None:
        raise ValueError("this matrix was prepared for fewer components")
    else:
        local = layout.needs.join(factor, "col_id").repartition(layout.parts, "part")
        joined = layout.light.join(local, ["part", "col_id"])
    light = weighted_sums(joined, keys, "value", "w", k, "x")
    if layout.heavy is None:
        return light, None
    pairs = layout.heavy.join(F.broadcast(factor) if small else factor, "col_id")
    return light, weighted_sums(pairs, matrix.row_keys, "value", "w", k, "x")


def gram_product(layout: Layout, factor: DataFrame, k: int, shift: Shift, by_site: bool = False) -> DataFrame:
    """`Yc'(Yc W)` in one pass: `(col_id, p_0 ..)` for the columns that have cells.

    `shift` is `mu' W`; centring the latent rows is enough to centre both sides. With
    `by_site` the sums of the sites stay apart.
    """
    matrix = layout.matrix
    if not (matrix.has_sites or by_site or isinstance(shift, DataFrame)) and matrix.limits.fits(matrix.n_cols, k):
        return _product_in_place(layout, factor, k, shift)
    pieces = _pieces(layout, *latent_beside(layout, factor, k, shift), k)
    out = ["site", "col_id"] if by_site else ["col_id"]
    every = pieces[0]
    if len(pieces) == 2:
        wanted = [*out, "value", *names("x", k)]
        every = pieces[0].select(*wanted).unionByName(pieces[1].select(*wanted))
    return weighted_sums(every, out, "value", "x", k, "p")


def _product_in_place(layout: Layout, factor: DataFrame, k: int, shift: Sequence[float]) -> DataFrame:
    """The product with a factor that is broadcast: packed cells meet it by blocks of columns and are multiplied where they lie.

    A task goes over as many parts as there are for each core, so that a column has a sum for each core, not one for each part.
    """
    w, p = names("w", k), names("p", k)
    packed, cores = layout.packed(), layout.matrix.spark.sparkContext.defaultParallelism
    if layout.parts > cores:
        packed = packed.coalesce(cores)
    width = F.lit(COLUMNS)
    numbers = F.struct((F.col("col_id") % width).cast("int").alias("at"), F.array(*w).alias("w"))
    blocks = factor.select((F.col("col_id") / width).cast("int").alias("block"), numbers.alias("row"))
    blocks = blocks.groupBy("block").agg(F.collect_list("row").alias("rows"))
    blocks = blocks.select("block", F.col("rows.at").alias("where"), F.flatten("rows.w").alias("w"))
    blocks = blocks.mapInArrow(_dense_blocks(k, COLUMNS, layout.matrix.n_cols), "block int, w binary")
    schema = ", ".join(["col_id bigint", *[f"{c} double" for c in p]])
    sums = packed.join(F.broadcast(blocks), "block", "left").mapInArrow(_chunk_products(list(shift), COLUMNS), schema)
    if layout.heavy is not None:
        _, heavy = _pieces(layout, *latent_beside(layout, factor, k, shift), k)
        sums = sums.unionByName(weighted_sums(heavy, ["col_id"], "value", "x", k, "p"))
    added = ", ".join(f"sum({c}) as {c}" for c in p)
    return sums.groupBy("col_id").agg(F.expr(f"struct({added}) as v_")).select("col_id", "v_.*")


def _packer(at_once: int, columns: int):
    """From cells with those of a row together to records of whole rows by block of columns: first row, number of rows, and
    for each cell its row, counted from 0, its column in the block and its value. Being local, it travels to the workers with the job."""

    def packed(table):
        rows, cols, values = (table.column(c).to_numpy() for c in ("row_id", "col_id", "value"))
        new = np.diff(rows, prepend=rows[0]) != 0
        at, block = np.cumsum(new).astype("i4"), cols // columns
        for b in np.unique(block):
            here = block == b
            cells = at[here], (cols[here] - b * columns).astype("i4"), values[here]
            yield (int(rows[0]), int(b), int(at[-1]) + 1, *[a.tobytes() for a in cells])

    def record(found):
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*found), types)], names=["chunk", "block", "n_rows", "at", "cols", "cell_values"]
        )

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= at_once:
                table = pa.Table.from_batches(held)
                # The last row may go on.
                ends = np.flatnonzero(np.diff(table.column("row_id").to_numpy())) + 1
                cut = int(ends[-1]) if len(ends) else 0
                if cut:
                    yield record(list(packed(table.slice(0, cut))))
                rest = table.slice(cut).combine_chunks()
                held, n = rest.to_batches(), rest.num_rows if cut else 0
        table = pa.Table.from_batches(held) if held else None
        if table is not None and table.num_rows:
            yield record(list(packed(table)))

    return run


def _dense_blocks(k: int, columns: int, n_cols: int):
    """From blocks of factor rows to the bytes of their numbers, component by component; columns without a row have zeros."""

    def run(batches):
        for batch in batches:
            found = []
            for i, block in enumerate(batch.column("block").to_pylist()):
                w = np.zeros((k, min(columns, n_cols - block * columns)))
                w[:, batch.column("where")[i].values.to_numpy()] = batch.column("w")[i].values.to_numpy().reshape(-1, k).T
                found.append((block, w.tobytes()))
            numbers, data = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(data, pa.binary())], names=["block", "w"])

    return run


def _chunk_products(shift: list[float], columns: int):
    """From packed cells next to their block of the factor to sums `(col_id, p_0 ..)` over all rows of a task."""
    k = len(shift)

    def run(batches):
        sums, present = {}, {}

        def numbers(batch, name, i, kind="f8"):
            return np.frombuffer(batch.column(name)[i].as_buffer(), kind)

        def multiply(n_rows, records):
            cells = []
            for block, batch, i in records:
                at, cols = (numbers(batch, c, i, "i4").astype("i8") for c in ("at", "cols"))
                known = batch.column("w")[i].is_valid
                # A block without factor rows has zeros.
                w = numbers(batch, "w", i).reshape(k, -1) if known else np.zeros((k, columns))
                cells.append((block, at, cols, numbers(batch, "cell_values", i), w))
                if block not in sums:
                    sums[block], present[block] = np.zeros((k, columns)), np.zeros(columns, bool)
                present[block][cols] = True
            for j, s in enumerate(shift):
                x = sum(np.bincount(at, values * w[j].take(cols), n_rows) for _, at, cols, values, w in cells) - s
                for block, at, cols, values, _ in cells:
                    sums[block][j] += np.bincount(cols, values * x.take(at), columns)

        held, chunk, n_rows = [], None, 0
        for batch in batches:
            told = zip(*(batch.column(c).to_pylist() for c in ("chunk", "block", "n_rows")))
            for i, (number, block, rows) in enumerate(told):
                if held and number != chunk:
                    multiply(n_rows, held)
                    held = []
                chunk, n_rows = number, rows
                held.append((block, batch, i))
        if held:
            multiply(n_rows, held)
        for b, p in sums.items():
            cols = np.flatnonzero(present[b])
            for i in range(0, len(cols), 10_000):
                some = cols[i : i + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype("i8") + b * columns), *[pa.array(p[j][some]) for j in range(k)]], names=["col_id", *[f"p_{j}" for j in range(k)]]
                )

    return run


def latent_beside(layout: Layout, factor: DataFrame, k: int, shift: Shift) -> tuple[DataFrame, DataFrame | None]:
    """Centred latent rows of the light and of the heavy rows."""
    light, heavy = latent(layout, factor, k)
    return centred(layout.matrix, light, k, shift), None if heavy is None else centred(layout.matrix, heavy, k, shift)


def _pieces(layout: Layout, light: DataFrame, heavy: DataFrame | None, k: int) -> list[DataFrame]:
    """Cells next to their latent rows: the light ones, which stay in place by part, and the heavy ones."""
    matrix = layout.matrix
    pieces = [layout.light.join(light, ["part", *matrix.row_keys])]
    if heavy is not None:
        pieces.append(layout.heavy.join(F.broadcast(heavy) if matrix.limits.fits(layout.n_heavy, k) else heavy, matrix.row_keys))
    return pieces


def cells_beside(layout: Layout, light: DataFrame, heavy: DataFrame | None, columns: DataFrame, k: int, doubles: int) -> DataFrame:
    """Cells next to their latent rows and to their rows of `columns(col_id, ..)`, which has `doubles` numbers in a row."""
    pieces = _pieces(layout, light, heavy, k)
    wanted = [*layout.matrix.row_keys, "col_id", "value", *names("x", k)]
    if layout.matrix.limits.fits(layout.matrix.n_cols, doubles):
        near = F.broadcast(columns)
        beside = [p.select(*wanted).join(near, "col_id") for p in pieces]
    else:
        local = layout.needs.join(columns, "col_id").repartition(layout.parts, "part")
        beside = [pieces[0].join(local, ["part", "col_id"]).drop("part"), *[p.select(*wanted).join(columns, "col_id") for p in pieces[1:]]]
    return beside[0] if len(beside) == 1 else beside[0].unionByName(beside[1])


def centred(matrix: SparseMatrix, rows: DataFrame, k: int, shift: Shift) -> DataFrame:
    """Latent rows minus the shift of their site."""
    keys = [c for c in rows.columns if not c.startswith("x_")]
    if not isinstance(shift, DataFrame):
        return subtract(rows, "x", shift, "x", keep=keys)
    offsets = shift.selectExpr("site", *[f"x_{j} as s_{j}" for j in range(k)])
    if matrix.limits.fits(matrix.n_sites, k):
        offsets = F.broadcast(offsets)
    joined = rows.join(offsets, "site")
    return joined.selectExpr(*keys, *[f"x_{j} - s_{j} as x_{j}" for j in range(k)])
