"""Sums of absolute inner products over all pairs of two tables, without looking at every pair."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.functions.columns import names
from factorspark.session import DEFAULT_LIMITS, Limits, delete, new_dir

# With more dimensions boxes decide too few signs to be worth it.
MAX_DIMS = 4

# Rows of one piece of either table, one record of some MB.
PIECE = 1 << 18


def absolute_sums(points: DataFrame, queries: DataFrame, key: str, d: int, piece: int = PIECE, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """`(key, total)`: for each of `queries(key, q_0 ..)` the exact sum of `|p . q|` over all `points(p_0 ..)`, as a written table.

    Where all products of a box of points with a box of queries have one sign, the sum of the points serves for all of
    them. Both tables are cut into pieces of rows that point much the same way. Pairs of pieces of one sign are settled by
    their sums; the others meet and go on by halves of either piece, down to single products. Both are read several times, so
    they should be written tables. The smaller one is broadcast, if need be some of its pieces after the others; the pieces of the
    other move once for each of these groups, whatever they meet.
    """
    spark, folder = points.sparkSession, new_dir(points.sparkSession, "absolute")
    columns = names("v", d)
    rows = {
        "p": points.select(F.lit(0).cast("bigint").alias("id"), *names("p", d)).toDF("id", *columns),
        "q": queries.select(F.col(key).cast("bigint").alias("id"), *names("q", d)).toDF("id", *columns),
    }
    sizes = {c: t.agg(F.count(F.lit(1)), *[F.sum(F.col(v) * F.col(v)) for v in columns]).first() for c, t in rows.items()}
    scale = [_scale(sizes["p"][j + 1], sizes["q"][j + 1], sizes["p"][0], sizes["q"][0]) for j in range(d)]
    for c, by in (("p", scale), ("q", [1 / s for s in scale])):
        scaled = rows[c].select("id", *[(F.col(v) * F.lit(by[j])).alias(v) for j, v in enumerate(columns)])
        _pieces(scaled, d, sizes[c][0], piece).write.parquet(f"{folder}/{c}")
    p, q = (_named(spark.read.parquet(f"{folder}/{c}"), c) for c in "pq")
    pairs = p.select("p_piece", "p_low", "p_high", "p_total").crossJoin(F.broadcast(q.select("q_piece", "q_low", "q_high")))
    schema = "p_piece string, q_piece string, side double, p_total array<double>"
    pairs.mapInPandas(_judge(), schema).write.parquet(f"{folder}/pairs")
    pairs = spark.read.parquet(f"{folder}/pairs")
    sums = pairs.filter("side != 0").groupBy("q_piece").agg(
        F.array(*[F.sum(F.col("side") * F.col("p_total")[j]) for j in range(d)]).alias("sums")
    )
    settled = q.select("q_piece", "q_ids", "q_data").join(sums, "q_piece").mapInPandas(_apply(d), "id bigint, total double")
    open_ = pairs.filter("side = 0").select("p_piece", "q_piece")
    near, far = p.select("p_piece", "p_data"), q.select("q_piece", "q_ids", "q_data")
    small, large, key_small, key_large = (far, near, "q_piece", "p_piece") if sizes["q"][0] <= sizes["p"][0] else (near, far, "p_piece", "q_piece")
    met = []
    for group in _groups(small, key_small, d, limits):
        here = F.col(key_small).isin(group)
        meeting = open_.filter(here)
        n_large = meeting.select(key_large).distinct().count()
        if key_small == "q_piece":
            # A task has a sum for each query it meets.
            n_large = min(n_large, 4 * spark.sparkContext.defaultParallelism)
        tiles = large.repartition(max(n_large, 1), key_large).join(F.broadcast(meeting), key_large).join(F.broadcast(small.filter(here)), key_small)
        partial = tiles.select("q_ids", "q_data", "p_data").mapInPandas(_meet(d), "id bigint, total double").groupBy("id").agg(F.sum("total").alias("total"))
        partial.write.parquet(f"{folder}/met/{len(met)}")
        met.append(spark.read.schema(partial.schema).parquet(f"{folder}/met/{len(met)}"))
    out = reduce(DataFrame.unionByName, met, settled).groupBy(F.col("id").alias(key)).agg(F.sum("total").alias("total"))
    result = new_dir(spark, "absolute-sums")
    out.write.parquet(result)
    delete(spark, folder)
    return spark.read.schema(out.schema).parquet(result)


def _groups(pieces: DataFrame, key: str, d: int, limits: Limits) -> list[list[str]]:
    """Names of pieces that can be broadcast together, at least one at a time."""
    data = f"{key[0]}_data"
    groups, held = [], 0
    for name, size in pieces.select(key, F.octet_length(data)).orderBy(key).collect():
        rows = size // (8 * d)
        if not groups or not limits.fits(held + rows, d):
            groups.append([])
            held = 0
        groups[-1].append(name)
        held += rows
    return groups


def _scale(p: float | None, q: float | None, n_p: int, n_q: int) -> float:
    """What makes a dimension weigh alike on both sides: a power of two, so that no product changes."""
    if not p or not q or not math.isfinite(p) or not math.isfinite(q):
        return 1.0
    return 2.0 ** round(math.log2((q / n_q) / (p / n_p)) / 4)


def _named(table: DataFrame, side: str) -> DataFrame:
    return table.toDF(*[f"{side}_{c}" for c in table.columns])


def _pieces(table: DataFrame, d: int, n_rows: int, piece: int) -> DataFrame:
    """Rows `(id, v_0 ..)` as records of at most about `piece` rows; `low` and `high` bound their directions, `total` sums them."""
    columns = names("v", d)
    length = F.sqrt(sum((F.col(v) * F.col(v) for v in columns), F.lit(0.0)))
    turned = [F.coalesce(F.try_divide(F.col(v), length), F.lit(0.0)) for v in columns[:-1]]
    cuts = math.ceil((n_rows / piece) ** (1 / max(d - 1, 1))) if n_rows else 1
    cell = [F.lit("0")]
    if cuts > 1:
        share = [i / cuts for i in range(1, cuts)]
        edges = table.agg(*[F.percentile_approx(u, share).alias(f"e_{j}") for j, u in enumerate(turned)]).first()
        cell = [sum(((u > F.lit(e)).cast("int") for e in edges[j]), F.lit(0)).cast("string") for j, u in enumerate(turned)]
    celled = table.withColumn("cell", F.concat_ws("/", *cell))
    parts = celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(piece)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id", *columns), F.col("parts")).cast("string")
    dealt = celled.join(F.broadcast(parts), "cell").select(F.concat_ws("#", "cell", part).alias("piece"), "id", *columns)

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        rows = np.ascontiguousarray(group[columns].to_numpy(dtype=float))
        length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        ways = np.divide(rows, length, out=np.zeros_like(rows), where=length != 0)
        told = {"piece": group["piece"].iloc[0], "ids": group["id"].to_numpy(dtype="int64").tobytes(), "data": rows.tobytes()}
        return pd.DataFrame([told | {"low": ways.min(axis=0), "high": ways.max(axis=0), "total": rows.sum(axis=0)}])

    schema = "piece string, ids binary, data binary, low array<double>, high array<double>, total array<double>"
    return dealt.groupBy("piece").applyInPandas(pack, schema)


def _judge():
    """Which sign all products of two pieces have, 0 if not one."""

    def run(batches):
        for batch in batches:
            box = {c: np.stack(batch[c].to_numpy()) for c in ("p_low", "p_high", "q_low", "q_high")} if len(batch) else {}
            if not box:
                continue
            (pc, ph), (qc, qh) = (((box[f"{s}_low"] + box[f"{s}_high"]) / 2, (box[f"{s}_high"] - box[f"{s}_low"]) / 2) for s in "pq")
            middle, slack = (pc * qc).sum(axis=1), (np.abs(pc) * qh + ph * (np.abs(qc) + qh)).sum(axis=1)
            side = np.where(np.abs(middle) >= slack, np.sign(middle), 0.0)
            yield pd.DataFrame({"p_piece": batch["p_piece"], "q_piece": batch["q_piece"], "side": side, "p_total": batch["p_total"]})

    return run


def _apply(d: int):
    """Queries times the signed sums of the pieces of points they need not meet."""

    def run(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                rows = np.frombuffer(row.q_data).reshape(-1, d)
                yield pd.DataFrame({"id": np.frombuffer(row.q_ids, dtype="int64"), "total": rows @ np.asarray(row.sums)})

    return run


def _meet(d: int, leaf: int = 16, at_once: int = 1 << 17):
    """Sums of absolute products of two pieces, by halves of either until a pair of boxes has one sign or is small."""

    def tree(rows):
        """Rows halved again and again along the widest side of their directions: `levels` of boxes and sums, and the leaves."""
        depth = max(0, int(math.log2(max(len(rows) / leaf, 1))))
        width = -(-len(rows) // 2**depth)
        order = np.arange(2**depth * width) % len(rows)
        filled = rows.copy()
        real = np.arange(2**depth * width) < len(rows)
        length = np.sqrt((filled * filled).sum(axis=1, keepdims=True))
        ways = np.divide(filled, length, out=np.zeros_like(filled), where=length != 0)
        where = np.arange(2**depth * width)
        levels = []
        for level in range(depth + 1):
            place = where.reshape(2**level, -1)
            here = ways[order[place]]
            low, high = here.min(axis=1), here.max(axis=1)
            held = (filled[order[place]] * real[place][:, :, None]).sum(axis=1)
            levels.append(((low + high) / 2, (high - low) / 2, held))
            if level < depth:
                widest = np.argmax(high - low, axis=1)
                along = np.take_along_axis(here, widest[:, None, None], axis=2)[:, :, 0]
                half = place.shape[1] // 2
                where = np.take_along_axis(place, np.argpartition(along, half, axis=1), axis=1).ravel()
        leaves = filled[order[where]] * real[where][:, None]
        return levels, leaves.reshape(2**depth, width, d), where

    def sums(points, queries):
        p_levels, p_leaves, _ = tree(points)
        q_levels, q_leaves, where = tree(queries)
        p_radius, q_radius = ([np.sqrt((half**2).sum(axis=1)).mean() for _, half, _ in levels] for levels in (p_levels, q_levels))
        signed = [np.zeros_like(held) for _, _, held in q_levels]
        total = np.zeros(q_leaves.shape[:2])
        work = [(0, 0, np.zeros(1, dtype="int64"), np.zeros(1, dtype="int64"))]
        while work:
            i, j, a, b = work.pop()
            if len(a) > at_once:
                work += [(i, j, a[s : s + at_once], b[s : s + at_once]) for s in range(0, len(a), at_once)]
                continue
            (pc, ph, held), (qc, qh, _) = p_levels[i], q_levels[j]
            pc, ph, qc, qh = pc[a], ph[a], qc[b], qh[b]
            middle = (pc * qc).sum(axis=1)
            sure = np.abs(middle) >= (np.abs(pc) * qh + ph * (np.abs(qc) + qh)).sum(axis=1)
            if sure.any():
                side = np.sign(middle[sure])
                for c in range(d):
                    signed[j][:, c] += np.bincount(b[sure], weights=side * held[a[sure], c], minlength=2**j)
            a, b = a[~sure], b[~sure]
            if not len(a):
                continue
            p_last, q_last = i == len(p_levels) - 1, j == len(q_levels) - 1
            if p_last and q_last:
                order = np.argsort(b, kind="stable")
                a, b = a[order], b[order]
                ends = np.flatnonzero(np.diff(b, append=-1)) + 1
                begin = 0
                for end in ends:
                    near = p_leaves[a[begin:end]].reshape(-1, d)
                    total[b[begin]] += np.abs(near @ q_leaves[b[begin]].T).sum(axis=0)
                    begin = end
            elif q_last or (not p_last and p_radius[i] >= q_radius[j]):
                work.append((i + 1, j, np.concatenate([2 * a, 2 * a + 1]), np.concatenate([b, b])))
            else:
                work.append((i, j + 1, np.concatenate([a, a]), np.concatenate([2 * b, 2 * b + 1])))
        for j in range(len(signed) - 1):
            signed[j + 1] += np.repeat(signed[j], 2, axis=0)
        total += (q_leaves * signed[-1][:, None, :]).sum(axis=2)
        out = np.empty(total.size)
        out[where] = total.ravel()
        return out[: len(queries)]

    def run(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                points, queries = (np.frombuffer(data).reshape(-1, d) for data in (row.p_data, row.q_data))
                yield pd.DataFrame({"id": np.frombuffer(row.q_ids, dtype="int64"), "total": sums(points, queries)})

    return run
