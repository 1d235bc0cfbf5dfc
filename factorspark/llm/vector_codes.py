"""Codes of vectors by parts, learned with anchors-hierarchy metric trees (operator 11).

Components become whole numbers and a vector is cut into parts of equal width; each part position has a codebook. Vectors lie in
blocks; a block holds, for each part, a tree of balls over its points, built middle-out: about sqrt(n) anchors, each taking from
the others what is nearer to it and looking no further down a list than half way; anchors are merged pairwise into the smallest
balls up to the root, and each anchor's own points are treated the same way below it. A ball caches centre, radius, sum and count.

A round sends the codebooks to the blocks and takes balls from the root. An entry stays a candidate of a ball unless the nearest
entry is nearer to each of its points, whatever they are; children inherit what is left. A ball with one candidate belongs to
it whole, with its cached sum; only points of leaves with several are looked at one by one. Sums and counts of a task are added up
before they are sent, and only codebooks, of a size that does not depend on the data, pass the driver.

All distances that decide are of whole numbers and exact; rules that leave candidates out keep a margin for rounding.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorspark.llm.common import discard, small_batches, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1_024
#: Vectors in a block, points that are not divided further.
BLOCK, LEAF = 4_096, 24
#: Largest component, after scaling, that squares and sums may be made of; below EXACT doubles hold them exactly.
LARGEST, EXACT = 1 << 27, 1 << 22
#: Labels that are broadcast, once counted; beyond, the join is a shuffle.
BROADCAST = 1 << 16


@dataclass
class Balls:
    """A tree as arrays. Ball 0 is the root; points of a ball are `order[start:stop]`; leaves have no child (-1)."""

    centre: np.ndarray
    radius: np.ndarray
    left: np.ndarray
    right: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    total: np.ndarray
    order: np.ndarray


def _distances(points: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - pivot) ** 2).sum(axis=1))


def anchors(points: np.ndarray, most: int) -> list[np.ndarray]:
    """At most `most` groups of the points, as indices: each new anchor is the point furthest from its own, and takes the points that
    are nearer to it. Of an anchor's list, by falling distance, only those further than half way between the two can be."""
    first = _distances(points, points[0])
    order = np.argsort(-first, kind="stable")
    pivots, groups, far = [points[0]], [order], [first[order]]
    while len(groups) < most:
        widest = max(range(len(groups)), key=lambda g: far[g][0])
        if far[widest][0] == 0:
            break
        pivot = points[groups[widest][0]]
        between = _distances(np.array(pivots), pivot)
        reach = [int(np.searchsorted(-f, -b / 2, "right")) for f, b in zip(far, between)]
        asked = [g for g, n in enumerate(reach) if n]
        taken, taken_far = [], []
        own = _distances(points[np.concatenate([groups[g][: reach[g]] for g in asked])], pivot)
        at = 0
        for g in asked:
            n = reach[g]
            new = own[at : at + n]
            at += n
            moves = new < far[g][:n]
            if moves.any():
                taken.append(groups[g][:n][moves])
                taken_far.append(new[moves])
                keep = np.concatenate((~moves, np.ones(len(groups[g]) - n, bool)))
                groups[g], far[g] = groups[g][keep], far[g][keep]
        mine, mine_far = np.concatenate(taken), np.concatenate(taken_far)
        order = np.argsort(-mine_far, kind="stable")
        pivots.append(pivot)
        groups.append(mine[order])
        far.append(mine_far[order])
    return groups


def build(points: np.ndarray, leaf: int = LEAF) -> Balls:
    """The tree over the rows of `points` (whole numbers)."""
    exact = points.astype("float64")
    nodes: list[tuple] = []  # children or points, until all are laid out

    def grow(members: np.ndarray) -> int:
        """Number of the node over these points."""
        groups = anchors(exact[members], max(2, int(len(members) ** 0.5))) if len(members) > leaf else []
        if len(groups) < 2:
            nodes.append((-1, -1, members))
            return len(nodes) - 1
        tops = [grow(members[g]) for g in groups]
        # Middle-out: pairs whose common ball, around the mean of both, is smallest are merged first.
        means = np.array([exact[members[g]].mean(axis=0) for g in groups])
        wide = np.array([_distances(exact[members[g]], m).max() for g, m in zip(groups, means)])
        count = np.array([len(g) for g in groups], "float64")
        alive = np.ones(len(tops), bool)
        gap = np.sqrt(np.maximum(((means[:, None] - means[None]) ** 2).sum(axis=2), 0))
        size = (gap + wide[:, None] + wide[None]) / 2
        np.fill_diagonal(size, np.inf)
        for _ in range(len(tops) - 1):
            i, j = divmod(int(size.argmin()), len(tops))
            nodes.append((tops[i], tops[j], None))
            tops[i] = len(nodes) - 1
            middle = (means[i] * count[i] + means[j] * count[j]) / (count[i] + count[j])
            wide[i] = max(_distances(means[[i]], middle)[0] + wide[i], _distances(means[[j]], middle)[0] + wide[j])
            means[i], count[i], alive[j] = middle, count[i] + count[j], False
            size[j], size[:, j] = np.inf, np.inf
            row = (_distances(means, middle) + wide + wide[i]) / 2
            row[~alive] = np.inf
            row[i] = np.inf
            size[i], size[:, i] = row, row
        return tops[i]

    root = grow(np.arange(len(points)))
    # Laid out from the root, so that the points of each ball are neighbours.
    n = len(nodes)
    left, right, start, stop = (np.full(n, -1, "int32") for _ in range(4))
    order, number, at = np.empty(len(points), "int32"), 0, 0
    stack: list[tuple[int, int, bool]] = [(root, -1, False)]
    place = np.full(n, -1)
    while stack:
        node, up, is_right = stack.pop()
        place[node] = own = number
        number += 1
        if up >= 0:
            (right if is_right else left)[up] = own
        a, b, members = nodes[node]
        if members is None:
            stack += [(b, own, True), (a, own, False)]
        else:
            order[at : at + len(members)] = members
            start[own], stop[own] = at, at + len(members)
            at += len(members)
    for own in range(n - 1, -1, -1):  # children come after their parent
        if left[own] >= 0:
            start[own], stop[own] = start[left[own]], stop[right[own]]
    sums = np.concatenate((np.zeros((1, points.shape[1]), "int64"), np.cumsum(points[order], axis=0, dtype="int64")))
    total = sums[stop] - sums[start]
    centre = total / (stop - start)[:, None]
    # The radius is that of the points, not of the balls below.
    ball = np.repeat(np.arange(n), stop - start)
    inside = np.concatenate([np.arange(a, b) for a, b in zip(start, stop)])
    away = np.empty(len(ball))
    for a in range(0, len(ball), 1 << 16):
        part = slice(a, a + (1 << 16))
        away[part] = _distances(exact[order[inside[part]]], centre[ball[part]])
    radius = np.maximum.reduceat(away, np.cumsum(stop - start) - (stop - start))
    return Balls(centre, radius, left, right, start, stop, total, order)


def exact_distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows of whole numbers, exact."""
    big = max(abs(int(points.min(initial=0))), int(points.max(initial=0)), abs(int(entries.min(initial=0))), int(entries.max(initial=0)))
    if big < EXACT and points.shape[1] <= 1 << 6:
        a, b = points.astype("float64"), entries.astype("float64")
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None]).astype("int64")
    return ((points[:, None] - entries[None]) ** 2).sum(axis=2)


def owners(tree: Balls, points: np.ndarray, entries: np.ndarray, whole: Callable, single: Callable) -> None:
    """Give each ball to the entry nearest to all of its points, by `whole(ball, entry)`, and the points of the leaves that several
    entries share by `single(points, entries, distances)`. Of entries that are equally near the first counts."""
    flat = entries.astype("float64")
    apart = np.sqrt(np.maximum(((flat[:, None] - flat[None]) ** 2).sum(axis=2), 0))
    number = np.arange(len(entries))
    balls, candidates = np.array([0]), np.ones((1, len(entries)), bool)
    while len(balls):
        centre, radius = tree.centre[balls], tree.radius[balls]
        far = ((centre[:, None] - flat[None]) ** 2).sum(axis=2) if len(balls) * len(entries) * centre.shape[1] <= 1 << 22 else (
            (centre**2).sum(axis=1)[:, None] - 2 * centre @ flat.T + (flat**2).sum(axis=1)[None])
        best = np.where(candidates, far, np.inf).argmin(axis=1)
        least = far[np.arange(len(balls)), best]
        # For every x of the ball |x-e|^2 - |x-best|^2 >= far - least - 2 r |e - best|. What remains of rounding is far below `slack`.
        slack = 1e-9 * (np.abs(flat).max(initial=1.0) + np.abs(centre).max(initial=1.0) + 1) ** 2 * flat.shape[1]
        candidates = candidates & ~(far - least[:, None] > 2 * radius[:, None] * apart[best] + slack)
        candidates[np.arange(len(balls)), best] = True
        alone = candidates.sum(axis=1) == 1
        for ball, entry in zip(balls[alone].tolist(), best[alone].tolist()):
            whole(ball, entry)
        balls, candidates = balls[~alone], candidates[~alone]
        leaf = tree.left[balls] < 0
        for ball, mask in zip(balls[leaf].tolist(), candidates[leaf]):
            members = tree.order[tree.start[ball] : tree.stop[ball]]
            some = number[mask]
            distances = exact_distances(points[members], entries[some])
            near = distances.argmin(axis=1)
            single(members, some[near], distances[np.arange(len(members)), near])
        inner, inherited = balls[~leaf], candidates[~leaf]
        balls = np.concatenate((tree.left[inner], tree.right[inner]))
        candidates = np.concatenate((inherited, inherited))


def sums_of(tree: Balls, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and count of the points of each entry."""
    total, count = np.zeros(entries.shape, "int64"), np.zeros(len(entries), "int64")

    def whole(ball: int, entry: int) -> None:
        total[entry] += tree.total[ball]
        count[entry] += tree.stop[ball] - tree.start[ball]

    def single(members: np.ndarray, near: np.ndarray, _) -> None:
        np.add.at(total, near, points[members])
        np.add.at(count, near, 1)

    owners(tree, points, entries, whole, single)
    return total, count


def assigned(tree: Balls, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each point."""
    code, error = np.zeros(len(points), "int64"), np.zeros(len(points), "int64")

    def whole(ball: int, entry: int) -> None:
        members = tree.order[tree.start[ball] : tree.stop[ball]]
        code[members] = entry
        error[members] = exact_distances(points[members], entries[[entry]])[:, 0]

    def single(members: np.ndarray, near: np.ndarray, distances: np.ndarray) -> None:
        code[members], error[members] = near, distances

    owners(tree, points, entries, whole, single)
    return code, error


_ARRAYS = {"centre": "f8", "radius": "f8", "left": "i4", "right": "i4", "start": "i4", "stop": "i4", "total": "i8", "order": "i4"}


def blocks_of(kept: DataFrame, width: int, parts: int, block: int) -> DataFrame:
    """A written table of blocks: ids and labels of its vectors, their components part by part, and the arrays of the trees."""
    label = kept.schema["label"].dataType.simpleString()
    kind = pa.schema([("a", pa.int64())]).field(0).type
    names = ["ids", "labels", "points", *_ARRAYS]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.array(batch.column(2).flatten(), "int64").reshape(-1, parts, width)
            own = [np.ascontiguousarray(flat[:, p]) for p in range(parts)]
            trees = [build(x) for x in own]
            data = [[x.tobytes() for x in own]] + [[np.ascontiguousarray(getattr(t, a), d).tobytes() for t in trees] for a, d in _ARRAYS.items()]
            lists = [pa.array([batch.column(0).to_pylist()], pa.list_(kind)), pa.array([batch.column(1).to_pylist()], pa.list_(batch.schema.field(1).type))]
            yield pa.RecordBatch.from_arrays([*lists, *[pa.array([d], pa.list_(pa.binary())) for d in data]], names=names)

    small_batches(kept.sparkSession, block)
    schema = f"ids array<bigint>, labels array<{label}>, points array<binary>, " + ", ".join(f"{a} array<binary>" for a in _ARRAYS)
    return written(kept.select("vec_id", "label", "x").mapInArrow(of, schema), "balls")


def _trees(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, int, list[tuple[Balls, np.ndarray]]]]:
    """Each block of the batches, with the tree and the points of each part."""
    for batch in batches:
        for row in range(batch.num_rows):
            cells = {a: batch.column(a)[row].as_py() for a in ("points", *_ARRAYS)}
            out = []
            for p, raw in enumerate(cells["points"]):
                arrays = {a: np.frombuffer(cells[a][p], d) for a, d in _ARRAYS.items()}
                arrays["centre"], arrays["total"] = arrays["centre"].reshape(-1, width), arrays["total"].reshape(-1, width)
                out.append((Balls(**arrays), np.frombuffer(raw, "i8").reshape(-1, width)))
            yield batch, row, out


def learn(blocks: DataFrame, books: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """The codebooks after so many rounds; one job each, which sends a task's sums and counts of all entries."""
    width, n = books[0].shape[1], len(books[0])
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], books=books) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((len(books), n, width), "int64"), np.zeros((len(books), n), "int64")
            for *_, trees in _trees(batches, width):
                for p, (tree, points) in enumerate(trees):
                    a, b = sums_of(tree, points, books[p])
                    total[p] += a
                    count[p] += b
            part, entry = np.nonzero(count)
            for p, e in [(part, entry)] if len(part) else []:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p * n + e), pa.array(count[p, e]), *[pa.array(total[p, e, i]) for i in range(width)]],
                    names=["entry", "count", *[f"s{i}" for i in range(width)]],
                )

        columns = [f"s{i}" for i in range(width)]
        sent = blocks.select("points", *_ARRAYS).mapInArrow(sums, "entry bigint, count bigint" + "".join(f", {c} bigint" for c in columns))
        books = [b.copy() for b in books]
        # As many rows as there are entries, whatever the number of vectors.
        for row in sent.groupBy("entry").agg(*[F.sum(c).alias(c) for c in ("count", *columns)]).collect():
            p, e = divmod(row["entry"], n)
            books[p][e] = [row[c] // row["count"] for c in columns]
    return books


def kept_vectors(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, x): vectors in whole numbers, without those that are null or hold null, NaN or an infinity."""
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale))
    # A null vector gives null, which `where` leaves out too.
    whole = F.forall("embedding", lambda v: F.coalesce(~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")), F.lit(False)))
    rows = df.where(whole).select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", "embedding")
    fits = F.forall("embedding", lambda v: F.abs(v.cast("double")) * scale < LARGEST)
    x = F.when(fits, x).otherwise(F.raise_error(F.lit(f"components must be below {LARGEST} after scaling")))
    return rows.select("vec_id", "label", x.cast("array<bigint>").alias("x"))


def encode_vectors(
    df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector of `df` (vec_id, embedding, label).

    Vectors that are null or hold null, NaN or an infinity are dropped. Codebooks start with the first `entries` vectors by id (null
    ids last, equal ids by their components), fewer if there are fewer; repeated rows are vectors of their own. Ties go to the lower
    index. Errors of null labels are added up together. An empty table gives an empty result. Components of 2^27 or more after
    scaling, vectors of several lengths and lengths that are no multiple of `parts` are errors. Other columns are not read.
    """
    if entries > 256:
        raise ValueError("a code has two digits, so at most 256 entries")
    spark: SparkSession = df.sparkSession
    kept = written(kept_vectors(df, scale), "vectors")
    lengths = [r["n"] for r in kept.select(F.size("x").alias("n")).distinct().limit(2).collect()]
    schema = "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string"
    if not lengths:
        return spark.createDataFrame([], schema)
    if len(lengths) > 1 or lengths[0] % parts or not lengths[0]:
        raise ValueError(f"vectors must have one length, a multiple of {parts}: {lengths}")
    width = lengths[0] // parts
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    start = np.array([r["x"] for r in first], "int64").reshape(len(first), parts, width)
    blocks = blocks_of(kept, width, parts, block)
    books = learn(blocks, [np.ascontiguousarray(start[:, p]) for p in range(parts)], rounds)
    joined = ",".join(map(str, np.concatenate([b.reshape(-1) for b in books]).tolist()))
    digest = hashlib.sha256(joined.encode()).hexdigest()
    label = kept.schema["label"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, trees in _trees(batches, width):
            both = [assigned(tree, points, books[p]) for p, (tree, points) in enumerate(trees)]
            digits = np.stack([c for c, _ in both], axis=1).astype("u1")
            ids, labels = batch.column("ids")[row].values, batch.column("labels")[row].values
            text = digits.tobytes().hex()
            codes = pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)])
            yield pa.RecordBatch.from_arrays([ids, labels, codes, pa.array(sum(e for _, e in both))], names=["vec_id", "label", "code", "error"])

    found = written(blocks.mapInArrow(code, f"vec_id bigint, label {label}, code string, error bigint"), "codes")
    for old in (kept, blocks):
        discard(old)
    by_label = written(found.groupBy("label").agg(F.sum("error").alias("label_error")), "labels").withColumnRenamed("label", "of")
    by_label = F.broadcast(by_label) if by_label.count() <= BROADCAST else by_label
    out = found.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql(rounds: int = ROUNDS, entries: int = ENTRIES, parts: int = PARTS) -> str:
    """The same in DuckDB, each part against each entry; doubles hold these numbers exactly."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (
  SELECT r, x.p AS p, min((xx - 2 * list_inner_product(x.v, c.v) + cc)::BIGINT * {entries} + e) AS m
  FROM pieces x JOIN (SELECT p, e, v, list_inner_product(v, v) AS cc FROM book{k}) c ON c.p = x.p GROUP BY r, x.p
)""")
        if k < rounds:
            steps.append(f"""book{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(n.v, b.v) AS v FROM book{k} b LEFT JOIN (
    SELECT p, e, list(c ORDER BY i) AS v FROM (
      SELECT p, e, i, floor(sum(v[i]) / count(*)) AS c FROM (
        SELECT x.p AS p, m % {entries} AS e, v, unnest(range(1, len(v) + 1)) AS i FROM pieces x JOIN near{k} n ON n.r = x.r AND n.p = x.p
      ) GROUP BY p, e, i
    ) GROUP BY p, e
  ) n ON n.p = b.p AND n.e = b.e
)""")
    last, steps = rounds, ",\n".join(steps)
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: floor({SCALE} * v::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), numbered AS MATERIALIZED (
  SELECT vec_id, label, x, row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS r FROM kept
), pieces AS MATERIALIZED (
  SELECT r, p, v, list_inner_product(v, v) AS xx FROM (
    SELECT r, p, x[p * len(x) // {parts} + 1:(p + 1) * len(x) // {parts}] AS v FROM numbered, range({parts}) t(p)
  )
), book0 AS MATERIALIZED (
  SELECT p, r - 1 AS e, v FROM pieces WHERE r <= {entries}
), {steps}, codes AS (
  SELECT r, string_agg(printf('%02x', m % {entries}), '' ORDER BY p) AS code, sum(m // {entries})::BIGINT AS error FROM near{last} GROUP BY r
), digest AS (
  SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(v) AS c, unnest(range(len(v))) AS i FROM book{last})
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM numbered JOIN codes USING (r), digest
"""


SQL = _sql()


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Codes of all `embeddings`."""
    return encode_vectors(table(spark, sf_dir, "embeddings"))
