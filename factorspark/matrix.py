"""The sparse matrix: a DataFrame of cells plus its size."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.session import DEFAULT_LIMITS, Limits


@dataclass
class SparseMatrix:
    """Cells `(row_id, col_id, value)`, one per position, with the size given by the caller.

    `n_rows` counts rows without cells too. With a `site` column a row is known by
    `(site, row_id)` and `site_rows` holds `(site, n_rows)`.
    """

    entries: DataFrame
    n_rows: int
    n_cols: int
    site_rows: DataFrame | None = None
    limits: Limits = DEFAULT_LIMITS
    source: DataFrame | None = field(default=None, repr=False)
    _cells: int | None = field(default=None, repr=False)
    _sites: int | None = field(default=None, repr=False)
    _hot: dict[str, DataFrame | None] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        missing = {"row_id", "col_id", "value"} - set(self.entries.columns)
        if missing:
            raise ValueError(f"entries lack the columns {sorted(missing)}")
        if self.n_rows <= 0 or self.n_cols <= 0:
            raise ValueError("n_rows and n_cols must be positive")
        if self.has_sites and self.site_rows is None:
            raise ValueError("a matrix with sites needs site_rows(site, n_rows)")

    @classmethod
    def from_table(
        cls, table: DataFrame, row: str, col: str, value, n_rows: int, n_cols: int, facts: DataFrame | None = None, **kwargs
    ) -> SparseMatrix:
        """Cells from a fact table; rows of the table with the same position are summed.

        `facts` are the rows of `table` before their sites were joined to them; they are counted instead.
        """
        places = [F.col(row).cast("bigint").alias("row_id"), F.col(col).cast("bigint").alias("col_id")]
        keys = [F.col("site"), *places] if "site_rows" in kwargs else places
        cells = table.groupBy(*keys).agg(F.sum(F.col(value) if isinstance(value, str) else value).alias("value"))
        source = table.select(*keys) if facts is None else facts.select(*places)
        return cls(cells.withColumn("value", F.col("value").cast("double")), n_rows, n_cols, source=source, **kwargs)

    @property
    def checked_entries(self) -> DataFrame:
        """The cells; one outside the matrix is an error. Every fit reads them once in this form, for its column statistics."""
        inside = F.col("row_id").between(0, self.n_rows - 1) & F.col("col_id").between(0, self.n_cols - 1)
        stray = F.concat_ws(" ", F.lit("cell outside the matrix (row, column):"), F.col("row_id"), F.col("col_id"))
        checked = F.when(inside, F.col("value")).otherwise(F.raise_error(stray).cast("double"))
        return self.entries.withColumn("value", checked)

    @property
    def spark(self) -> SparkSession:
        return self.entries.sparkSession

    @property
    def has_sites(self) -> bool:
        return "site" in self.entries.columns

    @property
    def row_keys(self) -> list[str]:
        return ["site", "row_id"] if self.has_sites else ["row_id"]

    @property
    def n_cells(self) -> int:
        """The number of cells, or of the table rows they are summed from, which is no less.

        It sizes partitions and the limit for hot keys; counting rows needs no shuffle.
        """
        if self._cells is None:
            self._cells = (self.entries if self.source is None else self.source).count()
        return self._cells

    @property
    def n_sites(self) -> int:
        if self._sites is None:
            self._sites = 0 if self.site_rows is None else self.site_rows.count()
        return self._sites

    def with_entries(self, entries: DataFrame, **changes) -> SparseMatrix:
        args = {
            "n_rows": self.n_rows,
            "n_cols": self.n_cols,
            "site_rows": self.site_rows,
            "limits": self.limits,
        }
        args.update(changes)
        return SparseMatrix(entries, **args)

    @staticmethod
    def _above(rows: DataFrame, keys: list[str], limit: int) -> DataFrame | None:
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("key_cells"))
        hot = counts.filter(F.col("key_cells") > limit).persist()
        return None if hot.isEmpty() else hot

    def hot_keys(self, keys: list[str]) -> DataFrame | None:
        """Rows or columns with more cells than one task should hold, with their cell counts.

        A row has at most `n_cols` cells and a column at most `n_rows`, so most matrices
        need no look at the data. The answer has at most `limits.max_hot` rows.
        """
        most = self.n_cols if "row_id" in keys else self.n_rows
        if most <= self.limits.hot_cells:
            return None
        name = ",".join(keys)
        if name not in self._hot:
            limit = self.limits.hot_limit(self.n_cells)
            # Table rows that are summed to cells are no fewer, and need not be summed for that.
            rows = self.entries if self.source is None else self.source
            hot = self._above(rows, [c for c in keys if c in rows.columns], limit)
            if hot is not None and not set(keys) <= set(rows.columns):
                # A row number is hot over all sites; is it at one of them?
                hot = self._above(self.entries, keys, limit)
            self._hot[name] = hot
        return self._hot[name]
