"""SQL that computes what the queries compute, written from the textbook form of each step.

Fits are unrolled for two components, with the inverse of a 2 x 2 matrix spelled out. Sums that
the engine derives (such as `X'X` from `W'Y'X`) are taken from the data here.
"""

from __future__ import annotations

from factorspark.functions.columns import HASH_PRIME, hash_constants
from factorspark.operators.factors import TINY, VALIDATION_FACTOR
from workload.queries import SEED, START_SS

CELLS = """cells AS (
  SELECT l_orderkey AS row_id, l_partkey AS col_id, CAST(sum(l_quantity) AS DOUBLE) AS value
  FROM lineitem GROUP BY l_orderkey, l_partkey)"""

DIMS = """dims AS (
  SELECT CAST((SELECT count(*) FROM orders) AS DOUBLE) AS n, CAST((SELECT count(*) FROM part) AS DOUBLE) AS d)"""

MU = """mu AS (
  SELECT col_id, count(*) AS n_nonzero, sum(value) AS total, sum(value) / max(n) AS mean
  FROM cells CROSS JOIN dims GROUP BY col_id)"""

PLACES = """places AS (
  SELECT o_orderkey AS row_id, r_name AS site
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""

SITE_CELLS = """cells AS (
  SELECT site, l_orderkey AS row_id, l_partkey AS col_id, CAST(sum(l_quantity) AS DOUBLE) AS value
  FROM lineitem JOIN places ON l_orderkey = row_id GROUP BY site, l_orderkey, l_partkey)"""

SITE_DIMS = """site_dims AS (SELECT site, CAST(count(*) AS DOUBLE) AS n FROM places GROUP BY site)"""

SITE_MU = """mu AS (
  SELECT c.site, col_id, sum(value) / max(n) AS mean
  FROM cells c JOIN site_dims d ON c.site = d.site GROUP BY c.site, col_id)"""

PART_LINES = """lines AS (
  SELECT l_partkey AS row_id, CAST(l_linenumber AS BIGINT) AS col_id, CAST(sum(l_quantity) AS DOUBLE) AS value
  FROM lineitem GROUP BY l_partkey, l_linenumber),
grid AS (
  SELECT p_partkey AS row_id, c AS col_id, coalesce(value, 0e0) AS value
  FROM part CROSS JOIN (SELECT CAST(unnest(range(8)) AS BIGINT) AS c) LEFT JOIN lines
  ON p_partkey = lines.row_id AND c = lines.col_id)"""


def r(expr: str, digits: int = 6, name: str | None = None) -> str:
    """Rounded; adding zero turns a negative zero into a positive one."""
    return f"round({expr}, {digits}) + 0 AS {name or expr.split('.')[-1]}"


def rule(j: int, key: str = "p_partkey") -> str:
    return f"CAST(({key} * {(j + 1) * 7919} + {j * 104729}) % 1009 + 1 AS DOUBLE) / 1010e0"


def drawn(key: str, stream: int) -> str:
    a, b = hash_constants(SEED, stream)
    return f"(CAST((({key} % {HASH_PRIME}) * {a} + {b}) % {HASH_PRIME} AS DOUBLE) + 5e-1) / {HASH_PRIME}e0"


def start(k: int = 2) -> str:
    columns = ", ".join(f"{rule(j)} AS w_{j}" for j in range(k))
    return f"f0 AS (SELECT p_partkey AS col_id, {columns} FROM part)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes)


def data_pass(i: int) -> list[str]:
    """Latent rows x, their offset s, the product p = Yc'(Yc W), X'X and W'W of factor f{i}."""
    return [
        f"""x{i} AS (SELECT row_id, sum(value * w_0) AS x_0, sum(value * w_1) AS x_1
  FROM cells JOIN f{i} USING (col_id) GROUP BY row_id)""",
        f"s{i} AS (SELECT sum(mean * w_0) AS s_0, sum(mean * w_1) AS s_1 FROM mu JOIN f{i} USING (col_id))",
        f"""p{i} AS (SELECT col_id, sum(value * (x_0 - s_0)) AS p_0, sum(value * (x_1 - s_1)) AS p_1
  FROM cells JOIN x{i} USING (row_id) CROSS JOIN s{i} GROUP BY col_id)""",
        f"""g{i} AS (SELECT
    sum((x_0 - s_0) * (x_0 - s_0)) + (max(n) - count(*)) * max(s_0 * s_0) AS g00,
    sum((x_0 - s_0) * (x_1 - s_1)) + (max(n) - count(*)) * max(s_0 * s_1) AS g01,
    sum((x_1 - s_1) * (x_1 - s_1)) + (max(n) - count(*)) * max(s_1 * s_1) AS g11
  FROM x{i} CROSS JOIN s{i} CROSS JOIN dims)""",
        squares(i),
    ]


def squares(i: int) -> str:
    return f"m{i} AS (SELECT sum(w_0 * w_0) AS m00, sum(w_0 * w_1) AS m01, sum(w_1 * w_1) AS m11 FROM f{i})"


def site_pass(i: int) -> list[str]:
    """The same with each site centred by its own mean."""
    return [
        f"""x{i} AS (SELECT site, row_id, sum(value * w_0) AS x_0, sum(value * w_1) AS x_1
  FROM cells JOIN f{i} USING (col_id) GROUP BY site, row_id)""",
        f"""s{i} AS (SELECT site, sum(mean * w_0) AS s_0, sum(mean * w_1) AS s_1
  FROM mu JOIN f{i} USING (col_id) GROUP BY site)""",
        f"""ps{i} AS (SELECT site, col_id, sum(value * (x_0 - s_0)) AS p_0, sum(value * (x_1 - s_1)) AS p_1
  FROM cells JOIN x{i} USING (site, row_id) JOIN s{i} USING (site) GROUP BY site, col_id)""",
        f"p{i} AS (SELECT col_id, sum(p_0) AS p_0, sum(p_1) AS p_1 FROM ps{i} GROUP BY col_id)",
        f"""gs{i} AS (SELECT site,
    sum((x_0 - s_0) * (x_0 - s_0)) + (max(n) - count(*)) * max(s_0 * s_0) AS g00,
    sum((x_0 - s_0) * (x_1 - s_1)) + (max(n) - count(*)) * max(s_0 * s_1) AS g01,
    sum((x_1 - s_1) * (x_1 - s_1)) + (max(n) - count(*)) * max(s_1 * s_1) AS g11
  FROM x{i} JOIN s{i} USING (site) JOIN site_dims USING (site) GROUP BY site)""",
        f"g{i} AS (SELECT sum(g00) AS g00, sum(g01) AS g01, sum(g11) AS g11 FROM gs{i})",
        squares(i),
    ]


def next_factor(i: int) -> str:
    return f"""f{i + 1} AS (SELECT col_id,
    coalesce(p_0, 0) * k00 + coalesce(p_1, 0) * k10 AS w_0, coalesce(p_0, 0) * k01 + coalesce(p_1, 0) * k11 AS w_1
  FROM f{i} LEFT JOIN p{i} USING (col_id) CROSS JOIN k{i})"""


def wide_step(i: int) -> list[str]:
    return [
        f"""k{i} AS (SELECT
    (g11 * m00 - g01 * m01) / det AS k00, (g11 * m01 - g01 * m11) / det AS k01,
    (g00 * m01 - g01 * m00) / det AS k10, (g00 * m11 - g01 * m01) / det AS k11
  FROM (SELECT *, g00 * g11 - g01 * g01 AS det FROM g{i} CROSS JOIN m{i}))""",
        next_factor(i),
    ]


def posterior(i: int, ss: str) -> str:
    """Sx = inv(W'W + ss I)."""
    return f"""sx{i} AS (SELECT (m11 + ss) / det AS x00, -m01 / det AS x01, (m00 + ss) / det AS x11
  FROM (SELECT *, (m00 + ss) * (m11 + ss) - m01 * m01 AS det FROM m{i} CROSS JOIN {ss}))"""


def noise_step(i: int) -> list[str]:
    ss = f"q{i}"
    return [
        posterior(i, ss),
        f"""t{i} AS (SELECT *, g00 * x00 + g01 * x01 AS t00, g00 * x01 + g01 * x11 AS t01,
    g01 * x00 + g11 * x01 AS t10, g01 * x01 + g11 * x11 AS t11
  FROM g{i} CROSS JOIN sx{i} CROSS JOIN {ss} CROSS JOIN dims)""",
        f"""h{i} AS (SELECT x00, x01, x11, x00 * t00 + x01 * t10 + n * ss * x00 AS h00,
    x00 * t01 + x01 * t11 + n * ss * x01 AS h01, x01 * t01 + x11 * t11 + n * ss * x11 AS h11 FROM t{i})""",
        f"""k{i} AS (SELECT (x00 * h11 - x01 * h01) / det AS k00, (x01 * h00 - x00 * h01) / det AS k01,
    (x01 * h11 - x11 * h01) / det AS k10, (x11 * h00 - x01 * h01) / det AS k11
  FROM (SELECT *, h00 * h11 - h01 * h01 AS det FROM h{i}))""",
        next_factor(i),
        # Noise variance: three sums, each from the data.
        f"""y{i} AS (SELECT row_id, sum(value * w_0) AS y_0, sum(value * w_1) AS y_1
  FROM cells JOIN f{i + 1} USING (col_id) GROUP BY row_id)""",
        f"z{i} AS (SELECT sum(mean * w_0) AS z_0, sum(mean * w_1) AS z_1 FROM mu JOIN f{i + 1} USING (col_id))",
        f"""xy{i} AS (SELECT
    sum(((x_0 - s_0) * x00 + (x_1 - s_1) * x01) * (y_0 - z_0) + ((x_0 - s_0) * x01 + (x_1 - s_1) * x11) * (y_1 - z_1))
    + (max(n) - count(*)) * max((s_0 * x00 + s_1 * x01) * z_0 + (s_0 * x01 + s_1 * x11) * z_1) AS xy
  FROM x{i} JOIN y{i} USING (row_id) CROSS JOIN s{i} CROSS JOIN z{i} CROSS JOIN sx{i} CROSS JOIN dims)""",
        f"""c{i} AS (SELECT sum(w_0 * w_0) AS c00, sum(w_0 * w_1) AS c01, sum(w_1 * w_1) AS c11 FROM f{i + 1})""",
        f"""q{i + 1} AS (SELECT (norm2 + h00 * c00 + 2 * h01 * c01 + h11 * c11 - 2 * xy) / (n * d) AS ss
  FROM norms CROSS JOIN h{i} CROSS JOIN c{i} CROSS JOIN xy{i} CROSS JOIN dims)""",
    ]


NORMS = """norms AS (SELECT
    (SELECT sum(value * value) FROM cells) - max(n) * sum(mean * mean) AS norm2 FROM mu CROSS JOIN dims)"""

Q0 = f"q0 AS (SELECT CAST({START_SS!r} AS DOUBLE) AS ss)"

DATA = [CELLS, DIMS, MU]
SITES = [PLACES, SITE_CELLS, SITE_DIMS, SITE_MU]
FIRST = [*DATA, start(), *data_pass(0)]
WIDE_1 = [*FIRST, *wide_step(0)]
WIDE_2 = [*WIDE_1, *data_pass(1), *wide_step(1)]
NOISE_1 = [*DATA, NORMS, Q0, start(), *data_pass(0), *noise_step(0)]
NOISE_2 = [*NOISE_1, *data_pass(1), *noise_step(1)]
SITES_1 = [*SITES, start(), *site_pass(0)]
SITES_2 = [*SITES_1, *wide_step(0), *site_pass(1), *wide_step(1)]
POSTERIOR = [*FIRST, Q0, posterior(0, "q0")]

W = f"{r('w_0')}, {r('w_1')}"
X = f"{r('x_0')}, {r('x_1')}"

# Dense errors of all rows for the encoder W Sx and the decoder given as f.
DENSE = """latent AS (
  SELECT o_orderkey AS row_id,
    (coalesce(x_0, 0) - s_0) * x00 + (coalesce(x_1, 0) - s_1) * x01 AS e_0,
    (coalesce(x_0, 0) - s_0) * x01 + (coalesce(x_1, 0) - s_1) * x11 AS e_1
  FROM orders LEFT JOIN x0 ON o_orderkey = x0.row_id CROSS JOIN s0 CROSS JOIN sx0),
errors AS (
  SELECT l.row_id, f.col_id, e_0 * w_0 + e_1 * w_1 - (coalesce(value, 0) - coalesce(mean, 0)) AS error,
    coalesce(value, 0) - coalesce(mean, 0) AS centred
  FROM latent l CROSS JOIN {f} f LEFT JOIN mu USING (col_id)
  LEFT JOIN cells c ON c.row_id = l.row_id AND c.col_id = f.col_id)"""

ERROR_NORMS = """norm_sums AS (SELECT col_id, sum(abs(error)) AS error, sum(abs(centred)) AS norm
  FROM errors GROUP BY col_id)"""

SITE_KINDS = """sent AS (
  SELECT site, 'YtX' AS kind, col_id AS i, 0 AS j, p_0 AS value FROM ps0
  UNION ALL SELECT site, 'YtX', col_id, 1, p_1 FROM ps0
  UNION ALL SELECT site, 'XtX', 0, 0, g00 FROM gs0 UNION ALL SELECT site, 'XtX', 0, 1, g01 FROM gs0
  UNION ALL SELECT site, 'XtX', 1, 0, g01 FROM gs0 UNION ALL SELECT site, 'XtX', 1, 1, g11 FROM gs0)"""

SITE_SUMS = f"""{with_(*SITES_1, SITE_KINDS)}
SELECT CAST(0 AS INTEGER) AS round, kind, CAST(i AS BIGINT) AS i, CAST(j AS INTEGER) AS j, {r('sum(value)', 3, 'value')}
FROM sent GROUP BY kind, i, j"""


def wide_cells(value: str = "value", extra: str = "") -> str:
    return f"{with_(CELLS)}\nSELECT row_id, col_id, {value} AS value{extra} FROM cells"


VALIDATION = ", ".join(f"({c}, {', '.join(f'CAST({v!r} AS DOUBLE)' for v in row)})" for c, row in enumerate(VALIDATION_FACTOR))

ORACLE = {
    "read_dense_text": f"{with_(PART_LINES)}\nSELECT row_id, col_id, value FROM grid",
    "read_coo_text": wide_cells(),
    "read_rows": wide_cells() + " WHERE value <> 0",
    "from_vector_column": """SELECT vec_id AS row_id, CAST(i AS BIGINT) AS col_id, CAST(embedding[i + 1] AS DOUBLE) AS value
FROM embeddings CROSS JOIN (SELECT unnest(range(64)) AS i) WHERE embedding[i + 1] <> 0""",
    "write_dense_text": f"""{with_(PART_LINES)}
SELECT string_agg(CAST(value AS VARCHAR), ' ' ORDER BY col_id) || ' ' AS value FROM grid GROUP BY row_id""",
    "write_lil_text": f"""{with_(CELLS)}
SELECT '{{' || coalesce(string_agg(col_id || ':' || CAST(value AS VARCHAR), ',' ORDER BY col_id), '') || '}}' AS value
FROM orders LEFT JOIN cells ON o_orderkey = row_id GROUP BY o_orderkey""",
    "write_coo_text": f"""{with_(CELLS)}
SELECT row_id || ',' || col_id || ',' || CAST(value AS VARCHAR) AS value FROM cells WHERE value <> 0""",
    "save_result": wide_cells() + " WHERE value <> 0",
    "save_factor": f"""{with_(*WIDE_1)}
SELECT col_id, CAST(((col_id + 1) * 4 + CAST(d AS BIGINT) - 1) // CAST(d AS BIGINT) AS INTEGER) AS block,
  {W} FROM f1 CROSS JOIN dims""",
    "load_factor": f"{with_(*WIDE_1)}\nSELECT col_id, {W} FROM f1",
    "load_factor_block": f"""{with_(*WIDE_1)}
SELECT col_id, {W} FROM f1 CROSS JOIN dims WHERE ((col_id + 1) * 4 + CAST(d AS BIGINT) - 1) // CAST(d AS BIGINT) = 2""",
    "write_partials": f"""{with_(*SITES_1, SITE_KINDS)}
SELECT CAST(0 AS INTEGER) AS round, site, kind, CAST(i AS BIGINT) AS i, CAST(j AS INTEGER) AS j, {r('value', 3)} FROM sent
UNION ALL
SELECT 0, site, kind, -1, -1, CAST(count(*) AS DOUBLE) FROM sent GROUP BY site, kind""",
    "save_projection": f"{with_(*FIRST)}\nSELECT row_id, {X} FROM x0",
    "bound_nonzero": f"""SELECT l_orderkey AS row_id, l_partkey AS col_id, {r('sum(l_discount)', 6, 'value')}
FROM lineitem GROUP BY l_orderkey, l_partkey HAVING sum(l_discount) <> 0""",
    "rebase_ids": f"{with_(CELLS)}\nSELECT row_id - 12 AS row_id, col_id - 11 AS col_id, value FROM cells",
    "binarize": wide_cells("1e0"),
    "assign_column_block": f"""{with_(CELLS, DIMS)}
SELECT row_id, col_id, value, CAST(b AS INTEGER) AS block,
  col_id - ((b - 1) * CAST(d AS BIGINT)) // 7 AS "offset"
FROM (SELECT *, ((col_id + 1) * 7 + CAST(d AS BIGINT) - 1) // CAST(d AS BIGINT) AS b FROM cells CROSS JOIN dims)""",
    "sample_rows": f"""{with_(CELLS, DIMS)}
SELECT row_id, col_id, value FROM cells CROSS JOIN dims
WHERE {drawn('row_id', 1)} <= 1e-1""",
    "limit_rows": f"""{with_(CELLS)}
SELECT row_id, col_id, value FROM cells
WHERE row_id IN (SELECT DISTINCT row_id FROM cells ORDER BY row_id LIMIT 1000)""",
    "limit_cols": wide_cells() + " WHERE col_id <= 1000",
    "check_params": f"""{with_(DIMS, 'asked AS (SELECT CAST(10 AS BIGINT) AS asked UNION ALL SELECT CAST(d AS BIGINT) - 3 FROM dims UNION ALL SELECT CAST(d AS BIGINT) FROM dims)')}
SELECT asked, k AS n_components, CASE WHEN k + 10 >= d THEN CAST(d AS BIGINT) - k ELSE 10 END AS subsample,
  1e0 AS sample_rate,
  CAST(3 AS BIGINT) AS max_rounds
FROM (SELECT asked, CASE WHEN asked = CAST(d AS BIGINT) THEN asked - 1 ELSE asked END AS k, n, d FROM asked CROSS JOIN dims)""",
    "vector_arith": f"""SELECT vec_id, {r('sum(v * v)', 6, 'self_dot')}, {r('sum((v - back) * (v - back))', 4, 'gap2')},
  {r('sum(v * (i + 1) / 64e0)', 6, 'p_0')}, {r('sum(v * (64 - i) / 64e0)', 6, 'p_1')}
FROM (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS v, CAST(embedding[64 - i] AS DOUBLE) AS back
  FROM embeddings CROSS JOIN (SELECT unnest(range(64)) AS i)) GROUP BY vec_id""",
    "entries_to_dense": f"""{with_(PART_LINES)}
SELECT row_id, sum(value) AS total, sum(value * (col_id + 1)) AS weighted, count(*) AS width FROM grid GROUP BY row_id""",
    "multiply": f"{with_(*FIRST)}\nSELECT row_id, {X} FROM x0",
    "align_rows": f"{with_(*FIRST)}\nSELECT row_id, col_id, value, {X} FROM cells JOIN x0 USING (row_id)",
    "compare_factors": f"""{with_(*WIDE_1)}
SELECT col_id, {r('f0.w_0', 6, 'o_0')}, {r('f0.w_1', 6, 'o_1')}, {r('f1.w_0')}, {r('f1.w_1')}
FROM f0 JOIN f1 USING (col_id)""",
    "mean_times_factor": f"{with_(*FIRST)}\nSELECT {r('s_0', 6, 'x_0')}, {r('s_1', 6, 'x_1')} FROM s0",
    "reconstruct_sample": f"""{with_(*POSTERIOR, DENSE.format(f='f0'))}
SELECT row_id, {r('sum(abs(error))', 4, 'abs_error')}, {r('sum(error * error)', 4, 'sq_error')}
FROM errors GROUP BY row_id""",
    "attach_site": f"{with_(PLACES, SITE_CELLS)}\nSELECT site, row_id, col_id, value FROM cells",
    "col_means": f"{with_(*DATA)}\nSELECT col_id, n_nonzero, {r('total', 8)}, {r('mean', 8)} FROM mu",
    "centered_frobenius": f"{with_(*DATA, NORMS)}\nSELECT {r('norm2', 2)} FROM norms",
    "latent_sum": f"{with_(*FIRST)}\nSELECT {r('sum(x_0)', 4, 'x_0')}, {r('sum(x_1)', 4, 'x_1')} FROM x0",
    "gramian": f"""{with_(*FIRST)}
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {r('value', 2)} FROM (
  SELECT 0 AS i, 0 AS j, g00 AS value FROM g0 UNION ALL SELECT 0, 1, g01 FROM g0
  UNION ALL SELECT 1, 0, g01 FROM g0 UNION ALL SELECT 1, 1, g11 FROM g0)""",
    "cross_moment": f"{with_(*FIRST)}\nSELECT col_id, {r('p_0', 4, 'm_0')}, {r('p_1', 4, 'm_1')} FROM p0",
    "factor_gramian": f"""{with_(*WIDE_1, squares(1))}
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {r('value', 4)} FROM (
  SELECT 0 AS i, 0 AS j, m00 AS value FROM m1 UNION ALL SELECT 0, 1, m01 FROM m1
  UNION ALL SELECT 1, 0, m01 FROM m1 UNION ALL SELECT 1, 1, m11 FROM m1)""",
    "noise_variance": f"{with_(*NOISE_1)}\nSELECT {r('ss', 7)} FROM q1",
    "error_norms": f"""{with_(*POSTERIOR, DENSE.format(f='f0'), ERROR_NORMS)}
SELECT {r('max(error)', 4, 'error_norm')}, {r('max(norm)', 4, 'data_norm')}, {r('max(error) / max(norm)', 4, 'ratio')}
FROM norm_sums""",
    "factor_change": f"""{with_(*WIDE_1)}
SELECT {r('max_change', 7)}, {r('max_new', 7)}, {r(f'max_change / ({TINY}e0 + max_new)' if 'e' not in repr(TINY) else f'max_change / ({TINY!r} + max_new)', 7, 'dw')}
FROM (SELECT max(greatest(abs(f0.w_0 - f1.w_0), abs(f0.w_1 - f1.w_1))) AS max_change,
  max(greatest(abs(f1.w_0), abs(f1.w_1))) AS max_new FROM f0 JOIN f1 USING (col_id))""",
    "accumulate_partials": SITE_SUMS,
    "accumulate_partials_stream": SITE_SUMS,
    "matrix_profile": f"""{with_(CELLS, DIMS)}
SELECT n_rows_stored, n_nonzero, {r('CAST(n_nonzero AS DOUBLE) / n_rows_stored', 8, 'avg_per_row')},
  {r('n_nonzero / (n * d)', 8, 'density')}
FROM (SELECT count(DISTINCT row_id) AS n_rows_stored, count(*) AS n_nonzero FROM cells) CROSS JOIN dims""",
    "right_multiply": f"""{with_(*WIDE_1)}
SELECT col_id, {r('2e0 * w_0 + 5e-1 * w_1', 6, 'w_0')}, {r('3e0 * w_1 - w_0', 6, 'w_1')} FROM f1""",
    "posterior_map": f"""{with_(*WIDE_1, squares(1), Q0, posterior(1, 'q0'))}
SELECT col_id, {r('w_0 * x00 + w_1 * x01', 7, 'w_0')}, {r('w_0 * x01 + w_1 * x11', 7, 'w_1')} FROM f1 CROSS JOIN sx1""",
    "init_factor": f"""SELECT p_partkey AS col_id, {r(drawn('p_partkey', 10), 9, 'w_0')}, {r(drawn('p_partkey', 11), 9, 'w_1')},
  {r(rule(0), 9, 'f_0')}, {r(rule(1), 9, 'f_1')} FROM part""",
    "init_validation": f"""WITH w(col_id, w_0, w_1, w_2) AS (VALUES {VALIDATION}),
counts AS (SELECT o_custkey AS row_id, CAST(substring(o_orderpriority, 1, 1) AS BIGINT) - 1 AS col_id,
  CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1, 2)
SELECT row_id, {r('sum(value * w_0)', 9, 'x_0')}, {r('sum(value * w_1)', 9, 'x_1')}, {r('sum(value * w_2)', 9, 'x_2')}
FROM counts JOIN w USING (col_id) GROUP BY row_id""",
    "deflate": f"""{with_(*WIDE_1, squares(1), f'z AS (SELECT p_partkey AS col_id, {rule(2)} AS w_2 FROM part)',
  'b AS (SELECT sum(w_0 * w_2) AS b0, sum(w_1 * w_2) AS b1 FROM f1 JOIN z USING (col_id))')}
SELECT col_id, {r('w_2 - (w_0 * (m11 * b0 - m01 * b1) + w_1 * (m00 * b1 - m01 * b0)) / (m00 * m11 - m01 * m01)', 7, 'w_0')}
FROM f1 JOIN z USING (col_id) CROSS JOIN m1 CROSS JOIN b""",
    "tall_orthonormalize": f"""{with_(*FIRST)}
SELECT col_id, {r('p_0 / sqrt(g00)', 6, 'w_0')},
  {r('(p_1 - p_0 * g01 / g00) / sqrt(g11 - g01 * g01 / g00)', 6, 'w_1')} FROM p0 CROSS JOIN g0""",
    "ppca_em": f"{with_(*NOISE_2)}\nSELECT col_id, {W} FROM f2",
    "ppca_em_wide": f"{with_(*WIDE_2)}\nSELECT col_id, {W} FROM f2",
    "fit_loop": f"{with_(*WIDE_2)}\nSELECT col_id, {W} FROM f2",
    "ppca_em_sites": f"{with_(*SITES_2)}\nSELECT col_id, {W} FROM f2",
    "ppca_em_sites_exchange": f"{with_(*SITES_2)}\nSELECT col_id, {W} FROM f2",
    "reconstruction_error": f"""{with_(*NOISE_1, DENSE.format(f='f1'), ERROR_NORMS)}
SELECT {r('max(error) / max(norm)', 7, 'ratio')} FROM norm_sums""",
    "reconstruction_interval": f"""{with_(*NOISE_1, DENSE.format(f='f1'), ERROR_NORMS)}
SELECT {r('max(error) / max(norm)', 7, 'ratio')}, CAST(0 AS DOUBLE) AS width, (SELECT count(*) FROM orders) AS n_rows FROM norm_sums""",
    "transform": f"""{with_(*WIDE_1)}
SELECT row_id, {r('sum(value * w_0)', 6, 'x_0')}, {r('sum(value * w_1)', 6, 'x_1')}
FROM cells JOIN f1 USING (col_id) GROUP BY row_id""",
    "transform_posterior": f"""{with_(*POSTERIOR)}
SELECT row_id, {r('(x_0 - s_0) * x00 + (x_1 - s_1) * x01', 8, 'x_0')}, {r('(x_0 - s_0) * x01 + (x_1 - s_1) * x11', 8, 'x_1')}
FROM x0 CROSS JOIN s0 CROSS JOIN sx0""",
}

# Eigenvectors of W'W, largest first; the entry of largest size in each column is positive.
def basis(f: int, *before: str) -> list[str]:
    """u, the basis of the factor f{f}."""
    return [
        *before,
        squares(f),
        f"l AS (SELECT *, sqrt((m00 - m11) * (m00 - m11) + 4 * m01 * m01) AS gap FROM m{f})",
        "e AS (SELECT *, (m00 + m11 + gap) / 2 AS l0, (m00 + m11 - gap) / 2 AS l1 FROM l)",
        """v AS (SELECT m01 / sqrt(l0 * (m01 * m01 + (l0 - m00) * (l0 - m00))) AS a0,
    (l0 - m00) / sqrt(l0 * (m01 * m01 + (l0 - m00) * (l0 - m00))) AS b0,
        m01 / sqrt(l1 * (m01 * m01 + (l1 - m00) * (l1 - m00))) AS a1,
    (l1 - m00) / sqrt(l1 * (m01 * m01 + (l1 - m00) * (l1 - m00))) AS b1 FROM e)""",
        f"raw AS (SELECT col_id, w_0 * a0 + w_1 * b0 AS u_0, w_0 * a1 + w_1 * b1 AS u_1 FROM f{f} CROSS JOIN v)",
        """sign AS (SELECT CASE WHEN max(u_0) >= -min(u_0) THEN 1 ELSE -1 END AS s_0,
        CASE WHEN max(u_1) >= -min(u_1) THEN 1 ELSE -1 END AS s_1 FROM raw)""",
        "u AS (SELECT col_id, u_0 * s_0 AS u_0, u_1 * s_1 AS u_1 FROM raw CROSS JOIN sign)",
    ]


BASIS = basis(0, start())

ORACLE["orthonormal_basis"] = f"{with_(*basis(1, *WIDE_1))}\nSELECT col_id, {r('u_0', 7)}, {r('u_1', 7)} FROM u"
ORACLE["transform_orthonormal"] = f"""{with_(CELLS, *BASIS)}
SELECT row_id, {r('sum(value * u_0)', 6, 'x_0')}, {r('sum(value * u_1)', 6, 'x_1')}
FROM cells JOIN u USING (col_id) GROUP BY row_id"""
