"""Small sums over large tables: k x k products as one aggregate row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Up to here sums are built-in aggregates; beyond, one aggregate outgrows generated code and
# Arrow blocks are an order of magnitude faster.
MAX_SUMS = 40

Spec = dict[str, tuple[list[str], list[str]]]


def products(table: DataFrame, specs: Spec, by: str | None = None) -> DataFrame:
    """For each named pair of column lists the sums of all products.

    Gives `([by,] kind, i, j, value)`; one pass over the table for all of them. Only partial
    sums leave a task.
    """
    count = sum(len(left) * len(right) for left, right in specs.values())
    return _by_aggregates(table, specs, by) if count <= MAX_SUMS else _by_blocks(table, specs, by)


def _by_aggregates(table: DataFrame, specs: Spec, by: str | None = None) -> DataFrame:
    sums, cells = {}, []
    for kind, (left, right) in specs.items():
        for i, a in enumerate(left):
            for j, b in enumerate(right):
                name = sums.setdefault(tuple(sorted((a, b))), f"s{len(sums)}")
                cells.append(
                    f"named_struct('kind', '{kind}', 'i', {i}, 'j', {j}, 'value', coalesce({name}, 0D))"
                )
    keys = [] if by is None else [by]
    row = table.groupBy(*keys).agg(*[F.expr(f"sum({a} * {b}) as {name}") for (a, b), name in sums.items()])
    return row.selectExpr(*keys, f"inline(array({', '.join(cells)}))")


def _by_blocks(table: DataFrame, specs: Spec, by: str | None = None) -> DataFrame:
    used = sorted({c for left, right in specs.values() for c in [*left, *right]})

    def partial(batches):
        sums = {}
        for batch in batches:
            # Nulls are left out of the sums, NaN and infinity go into them, as in the other form.
            data = {c: batch.column(c).fill_null(0.0).to_numpy(zero_copy_only=False) for c in used}
            coded = batch.column("by").dictionary_encode()
            codes, groups = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            for code, group in enumerate(groups):
                here = slice(None) if len(groups) == 1 else codes == code
                for kind, (left, right) in specs.items():
                    a = np.column_stack([data[c][here] for c in left])
                    b = np.column_stack([data[c][here] for c in right])
                    sums[group, kind] = sums.get((group, kind), 0.0) + a.T @ b
        for (group, kind), block in sums.items():
            i, j = np.indices(block.shape, dtype="int32")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([group] * block.size, pa.string()),
                    pa.array([kind] * block.size, pa.string()),
                    pa.array(i.ravel()),
                    pa.array(j.ravel()),
                    pa.array(block.ravel()),
                ],
                names=["by", "kind", "i", "j", "value"],
            )

    label = "''" if by is None else f"string({by})"
    parts = table.selectExpr(f"{label} as by", *[f"double({c}) as {c}" for c in used]).mapInArrow(
        partial, "by string, kind string, i int, j int, value double"
    )
    out = parts.groupBy("by", "kind", "i", "j").agg(F.sum("value").alias("value"))
    if by is None:
        return out.drop("by")
    return out.withColumn("by", F.col("by").cast(table.schema[by].dataType)).withColumnRenamed("by", by)


def combine_by_blocks(table: DataFrame, columns: list[str], weights: np.ndarray, out: str, keep: list[str]) -> DataFrame:
    """`functions.columns.combine` for many columns, none of them null: `out_j` is the sum of `columns[i] * weights[i, j]`, added up
    in the same order, so that it is rounded in the same way."""
    weights = np.asarray(weights, dtype=float)

    def run(batches):
        for batch in batches:
            data = np.zeros((weights.shape[1], batch.num_rows))
            for c, w in zip(columns, weights):
                data += w[:, None] * batch.column(c).to_numpy(zero_copy_only=False)
            kept = [batch.column(c) for c in keep]
            made = [pa.array(column) for column in data]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[*keep, *[f"{out}_{j}" for j in range(len(made))]])

    schema = [*[f"{c} {table.schema[c].dataType.simpleString()}" for c in keep], *[f"{out}_{j} double" for j in range(weights.shape[1])]]
    needed = [*keep, *[c for c in columns if c not in keep]]
    return table.select(*needed).mapInArrow(run, ", ".join(schema))


def to_arrays(sums: DataFrame, specs: Spec) -> dict[str, np.ndarray]:
    """Bring the result of `products` to the driver; its size depends on k alone."""
    out = {kind: np.zeros((len(left), len(right))) for kind, (left, right) in specs.items()}
    for row in sums.collect():
        out[row["kind"]][row["i"], row["j"]] = row["value"]
    return out
