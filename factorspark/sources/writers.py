"""Writers of matrices as text in the three plain forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = ("dense", "lil", "coo", "parquet")


def row_cells(entries: DataFrame) -> DataFrame:
    """The non-zero cells of each row as an array sorted by column.

    A line of text holds a whole row, so a row has to come together; it has no more cells
    than the matrix has columns.
    """
    cells = F.array_sort(F.collect_list(F.struct("col_id", "value")))
    return entries.filter("value <> 0").groupBy("row_id").agg(cells.alias("cells"))


def every_row(rows: DataFrame, n_rows: int) -> DataFrame:
    """Add the rows without cells."""
    ids = rows.sparkSession.range(n_rows).withColumnRenamed("id", "row_id")
    return ids.join(rows, "row_id", "left")


def dense_lines(entries: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """One line of `n_cols` numbers per row, each followed by a blank."""
    gap = "repeat('0.0 ', int(c.col_id - if(p = 0, -1, cells[p - 1].col_id) - 1))"
    filled = f"array_join(transform(cells, (c, p) -> concat({gap}, string(c.value), ' ')), '')"
    rest = f"repeat('0.0 ', int({n_cols - 1} - element_at(cells, -1).col_id))"
    empty = f"repeat('0.0 ', {n_cols})"
    rows = every_row(row_cells(entries), n_rows)
    return rows.select("row_id", F.expr(f"if(cells is null, {empty}, concat({filled}, {rest}))").alias("value"))


def lil_lines(entries: DataFrame, n_rows: int) -> DataFrame:
    """One line `{col:value,..}` per row, zeros left out."""
    body = "array_join(transform(cells, c -> concat(c.col_id, ':', string(c.value))), ',')"
    rows = every_row(row_cells(entries), n_rows)
    return rows.select("row_id", F.expr(f"concat('{{', coalesce({body}, ''), '}}')").alias("value"))


def coo_lines(entries: DataFrame) -> DataFrame:
    """One line `row,col,value` per non-zero cell."""
    line = F.concat_ws(",", "row_id", "col_id", F.col("value").cast("string"))
    return entries.filter("value <> 0").select("row_id", "col_id", line.alias("value"))


def write_dense_text(entries: DataFrame, path: str, n_rows: int, n_cols: int) -> None:
    lines = dense_lines(entries, n_rows, n_cols).orderBy("row_id")
    lines.select("value").write.mode("overwrite").text(path)


def write_lil_text(entries: DataFrame, path: str, n_rows: int) -> None:
    lil_lines(entries, n_rows).orderBy("row_id").select("value").write.mode("overwrite").text(path)


def write_coo_text(entries: DataFrame, path: str) -> None:
    coo_lines(entries).orderBy("row_id", "col_id").select("value").write.mode("overwrite").text(path)


def save_result(entries: DataFrame, path: str, n_rows: int, n_cols: int, format: str = "parquet") -> None:
    """Write a matrix of cells in the wanted form."""
    if format not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    if format == "dense":
        write_dense_text(entries, path, n_rows, n_cols)
    elif format == "lil":
        write_lil_text(entries, path, n_rows)
    elif format == "coo":
        write_coo_text(entries, path)
    else:
        entries.filter("value <> 0").write.mode("overwrite").parquet(path)


def entries_to_dense(entries: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """Rows as arrays of `n_cols` numbers, for narrow matrices."""
    gap = "array_repeat(0D, int(c.col_id - if(p = 0, -1, cells[p - 1].col_id) - 1))"
    filled = f"flatten(transform(cells, (c, p) -> concat({gap}, array(c.value))))"
    rest = f"array_repeat(0D, int({n_cols - 1} - element_at(cells, -1).col_id))"
    rows = every_row(row_cells(entries), n_rows)
    whole = f"if(cells is null, array_repeat(0D, {n_cols}), concat({filled}, {rest}))"
    return rows.select("row_id", F.expr(whole).alias("values"))
