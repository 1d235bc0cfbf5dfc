"""Approximate nearest neighbours with a forest of random-projection trees (operator 6).

Each tree halves the space again and again: a node splits by the median of a sample's projections onto a random direction. The
trees are built on a bounded sample; every vector is then assigned a leaf in each. Where the sample gives out, leaves go on
being cut by random directions at the origin, so that leaves keep their size however large the table is. A query
searches all trees through one priority queue, ordered by the smallest margin on the way, until the leaves it has opened hold
enough vectors; candidates are ranked by their exact cosine.

Equal vectors are one entry of the index that names its smallest ids: more than a result can show are never needed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorspark.llm.common import small_batches, table, written

NEAREST, QUERY_STEP = 5, 50
#: Vectors that the trees are built on, by the hash of their ids.
SAMPLE = 20_000
TREES, LEAF, SEED = 8, 256, 11
#: A query opens leaves until they hold this many entries, and this share of all; a vector counts in each tree it is met in.
#: Vectors without structure need about as many as there are for a recall of 0.95; see the README for figures.
ENOUGH, SHARE = 4_000, 1.2
#: Leaves next to each other that one task handles together, and queries it handles at once.
BIN, QUERY_BLOCK = 16, 4_096


@dataclass(frozen=True)
class Forest:
    """Complete binary trees of one depth: a direction and a threshold for each inner node, in the order of a heap."""

    directions: np.ndarray  # trees x nodes x dimensions
    thresholds: np.ndarray  # trees x nodes
    depth: int


def grow(sample: np.ndarray, rows: int, trees: int = TREES, leaf: int = LEAF, seed: int = SEED) -> Forest:
    """Trees with leaves of about `leaf` of `rows` unit vectors."""
    rng = np.random.default_rng(seed)
    depth = max(0, int(np.ceil(np.log2(max(1, rows) / leaf))))
    nodes, size = (1 << depth) - 1, sample.shape[1]
    directions, thresholds = np.zeros((trees, nodes, size), "float32"), np.zeros((trees, nodes), "float32")
    for t in range(trees):
        members = {0: np.arange(len(sample))}
        for node in range(nodes):
            here = members.pop(node)
            if len(here) >= 4:
                # The difference of two of its vectors points along the spread of the node.
                a, b = sample[rng.choice(here, 2, replace=False)]
                way = a - b
                if not way.any():
                    way = rng.standard_normal(size).astype("float32")
                values = sample[here] @ (way / np.linalg.norm(way))
                cut = np.median(values)
            else:
                way, values, cut = rng.standard_normal(size).astype("float32"), np.zeros(len(here)), 0.0
                values = sample[here] @ (way / np.linalg.norm(way))
            directions[t, node], thresholds[t, node] = way / np.linalg.norm(way), cut
            members[2 * node + 1], members[2 * node + 2] = here[values <= cut], here[values > cut]
    return Forest(directions, thresholds, depth)


def leaves_of(forest: Forest, unit: np.ndarray) -> np.ndarray:
    """The leaf of each vector in each tree, vectors x trees."""
    out = np.zeros((len(unit), len(forest.directions)), "int64")
    for t in range(out.shape[1]):
        node = np.zeros(len(unit), "int64")
        for _ in range(forest.depth):
            side = np.einsum("ij,ij->i", unit, forest.directions[t, node]) > forest.thresholds[t, node]
            node = 2 * node + 1 + side
        out[:, t] = node - ((1 << forest.depth) - 1)
    return out


def probes(forest: Forest, unit: np.ndarray, sizes: dict[tuple[int, int], int], enough: int) -> list[tuple[int, int]]:
    """(tree, leaf) to open for one query, nearest first, until they hold `enough` vectors. Empty leaves are not opened."""
    margins = np.einsum("tnd,d->tn", forest.directions, unit) - forest.thresholds
    heap = [(-np.inf, t, 0) for t in range(len(margins))]
    last, found, held = (1 << forest.depth) - 1, [], 0
    while heap and held < enough:
        worst, t, node = heapq.heappop(heap)
        while node < last:
            margin = float(margins[t, node])
            heapq.heappush(heap, (max(worst, abs(margin)), t, 2 * node + (1 if margin > 0 else 2)))
            node = 2 * node + (2 if margin > 0 else 1)
        if n := sizes.get((t, node - last)):
            found.append((t, node - last))
            held += n
    return found


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): rows with an id and a vector that is not zero and holds finite numbers only."""
    v = F.col("embedding")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def _unit(rows: pd.Series) -> np.ndarray:
    """Directions in double precision; scaled first, so that squares neither overflow nor vanish."""
    x = np.array(rows.tolist(), "float64")
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distinct_vectors(rows: DataFrame, names: int) -> DataFrame:
    """(entry, v, ids): each different vector once, with its `names` smallest ids in order.

    Every task keeps that many ids of a vector before the shuffle (a limit on row numbers is pushed below it), once more spread
    over salts, so a vector that holds a third of all rows gathers nowhere.
    """
    keyed = rows.withColumn("key", F.to_binary(F.md5(F.array_join("v", ",").cast("binary")), F.lit("hex")))
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(16)))
    part = Window.partitionBy("key", "salt").orderBy("vec_id")
    few = salted.withColumn("n", F.row_number().over(part)).where(F.col("n") <= names)
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("n") <= names)
    entries = few.groupBy("key").agg(F.min_by("v", "vec_id").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return entries.select(F.col("ids")[0].alias("entry"), "v", "ids")


def nearest(
    vectors: DataFrame, queries: DataFrame | None = None, k: int = NEAREST, trees: int = TREES, leaf: int = LEAF,
    enough: int = ENOUGH, share: float = SHARE, sample: int = SAMPLE, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the `k` nearest of all other rows found, by cosine in double precision.

    `queries` has the ids of the rows to search for; without it, those divisible by 50. Ties go to the smaller id. Rows without
    id, and vectors that are null, empty, zero or hold a null or non-finite number take no part, neither do those of another
    length than the vector of the smallest usable id. Rows that repeat an id and its vector are one; of one id with several
    vectors each takes part. Fewer than k candidates give fewer rows.
    """
    spark = vectors.sparkSession
    small_batches(spark, 5_000)
    rows = usable(vectors).dropDuplicates(["vec_id", "v"])
    first = rows.select(F.struct("vec_id", F.size("v").alias("size")).alias("x")).agg(F.min("x")).first()[0]
    size = first["size"] if first else 0
    rows = rows.where(F.size("v") == size)
    kind = rows.schema["v"].dataType.simpleString()
    entries = written(distinct_vectors(rows, k + 1), "entries")
    total = entries.count()
    if queries is None:
        wanted = rows.where(F.col("vec_id") % QUERY_STEP == 0)
    else:
        wanted = rows.join(queries.select("vec_id").distinct(), "vec_id", "left_semi")
    blocks = max(1, -(-wanted.count() // query_block))
    chosen = entries.select("v").orderBy(F.xxhash64("entry"), "entry").limit(sample).toPandas()
    forest = grow(_unit(chosen["v"]).astype("float32") if len(chosen) else np.zeros((0, max(1, size)), "float32"), total, trees, leaf)
    enough = max(enough, int(share * total))

    def index(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                at = leaves_of(forest, _unit(part["v"]).astype("float32"))
                out = part.loc[part.index.repeat(trees)].reset_index(drop=True)
                yield out.assign(tree=np.tile(np.arange(trees), len(part)), leaf=at.ravel())

    at_leaf = "tree int, leaf bigint"
    leaves = written(entries.mapInPandas(index, f"entry bigint, v {kind}, ids array<bigint>, {at_leaf}"), "leaves")
    counts = leaves.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n"))
    # One number for each leaf of a forest that the tasks hold anyway.
    sizes = {(r.tree, r.leaf): r.n for r in counts.toLocalIterator()}

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i, unit in enumerate(_unit(part["v"]).astype("float32") if len(part) else []):
                found = pd.DataFrame(probes(forest, unit, sizes, enough), columns=["tree", "leaf"])
                found["bin"] = found["leaf"] // BIN
                found = found.groupby(["tree", "bin"], as_index=False)["leaf"].agg(list)
                yield found.assign(query_id=part["vec_id"].iloc[i], q=[part["v"].iloc[i]] * len(found))

    # Opened leaves meet their vectors by bins; of a bin, a query takes home no more than it can show.
    opened = wanted.mapInPandas(search, f"query_id bigint, q {kind}, tree int, bin bigint, leaf array<bigint>")
    opened = opened.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    members = leaves.withColumn("bin", F.expr(f"leaf DIV {BIN}")).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    )

    def rank(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            exact = _unit(held["v"])
            by_leaf = held.groupby("leaf").indices
            entry, ids = held["entry"].to_numpy(), held["ids"].to_numpy()
            for query, unit, leaf_list in zip(asked["query_id"], _unit(asked["q"]), asked["leaf"]):
                near = np.concatenate([by_leaf[x] for x in leaf_list])
                score = exact[near] @ unit
                best = np.lexsort((entry[near], -score))[: k + 1]
                out += [(query, entry[near[j]], ids[near[j]], score[j]) for j in best]
        return pd.DataFrame(out, columns=["query_id", "entry", "ids", "score"])

    keys = ["tree", "bin", "block"]
    scored = opened.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInPandas(
        rank, "query_id bigint, entry bigint, ids array<bigint>, score double"
    )
    best = scored.groupBy("query_id", "entry").agg(F.max("score").alias("score"), F.min("ids").alias("ids"))
    # An entry has k + 1 ids at most, one of which may be the query itself.
    named = best.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_ann(spark, sf_dir: str) -> DataFrame:
    """The 5 nearest of all `embeddings` to those whose vec_id is divisible by 50."""
    return nearest(table(spark, sf_dir, "embeddings"))
