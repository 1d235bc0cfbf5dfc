"""Prefix trie of rebuilt conversations by composable fingerprints (operator 13).

A conversation is rebuilt from the head of another and its own suffix, but no rebuilt text is ever made. A turn with hash h at place
i stands for the affine map x -> x + h B^i (modulo the prime 2^31 - 1, in three lanes with bases of their own); the product of a run
of turns is the sum of its terms, a group, so the product of a suffix is that of the whole over that of its first turns, and

    product(rebuilt c, d) = product(head of base) + B^(L - h) (product(c, d - L + h) - product(c, h))

for a head of L turns and a suffix that starts after h. All terms are products of the stored conversations; only numbers and
references to stored turns are joined.

1. Turns are sorted into ranges of (conversation, turn) and keep that order in a written table; places and running products within a
   range come first, then what lies in the ranges before. A conversation of any length is spread over as many ranges.
2. Each prefix of each rebuilt conversation is a member (conversation, depth, product, reference to a stored turn). Members with the same depth and
   product are a node. Where a node has several references, the turns they name must hold the same role and text; as this goes for the
   turns at all depths, equal products are equal prefixes. Should one node fail, all products are made anew with other bases.
3. On the way down a conversation, the smallest member of its nodes can only grow. From the depth where it is the conversation itself
   the nodes are its own, so every sum over a subtree is a sum over members of a node: what members own below it.
"""

from __future__ import annotations

import hashlib
import itertools
import random
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.llm.common import discard, table, written

PRIME, LANES = (1 << 31) - 1, 3
#: Depths of a conversation that are joined or summed as one group.
BLOCK = 4_096
P = [f"p{k}" for k in range(LANES)]
NODE = ["depth", *P]


def bases(seed: int) -> list[int]:
    rng = random.Random(f"bases {seed}")
    return [rng.randrange(1 << 20, PRIME - 1) for _ in range(LANES)]


def power(base: int, exponent: Column) -> Column:
    """base^exponent modulo the prime, for exponents from 0 up to 2^32, by tables of its digits to the base 256."""

    def digit(k: int) -> Column:
        own = [pow(base, i << (8 * k), PRIME) for i in range(256)]
        place = F.pmod(F.shiftright(exponent.cast("bigint"), 8 * k), F.lit(256)).cast("int")
        return F.get(F.lit(own).cast("array<bigint>"), place)

    return reduce(lambda a, b: (a * b) % PRIME, [digit(k) for k in range(4)])


def sorted_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, at, role, text, n): turns in order of conversation and turn within their range, written. `at` grows with the
    order; ranges are `part`. Turns with one number are ordered by role and then text; repeated rows are turns of their own."""
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    # The last key spreads a row that is repeated many times over several ranges.
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("mark", F.md5("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("mark"), F.col("row")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("mark", "row", "turn")
    dealt = written(dealt.withColumn("at", F.monotonically_increasing_id()), "turns")
    return dealt.select("conv_id", F.shiftright("at", 33).alias("part"), "at", "role", "text", F.length("text").cast("bigint").alias("n"))


def before(rows: DataFrame, key: str, order: str, sums: list[str]) -> DataFrame:
    """`rows`, one for each (key, order), with sums of all rows of the key that come earlier."""
    earlier = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(key, order, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in sums])


def placed(turns: DataFrame) -> DataFrame:
    """Turns without texts: their place `pos` from 1 and a hash for each lane."""
    spans = turns.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("m"))
    starts = before(spans, "conv_id", "part", ["m"])
    spans = spans.drop("m").join(starts, ["conv_id", "part"])
    hashes = [F.pmod(F.xxhash64(F.lit(k), "role", "text"), F.lit(PRIME)).alias(f"h{k}") for k in range(LANES)]
    rows = turns.select("conv_id", "part", "at", "n", *hashes).join(spans, ["conv_id", "part"])
    return rows.select("conv_id", "part", "at", (F.col("at") - F.col("first") + F.col("m") + 1).alias("pos"), "n", *[f"h{k}" for k in range(LANES)])


def products(places: DataFrame, of: list[int]) -> DataFrame:
    """(conv_id, part, at, pos, n, p0..): products of all prefixes of the stored conversations, written."""
    terms = places.select("conv_id", "part", "at", "pos", "n", *[((F.col(f"h{k}") * power(b, F.col("pos"))) % PRIME).alias(f"t{k}") for k, b in enumerate(of)])
    sums = [f"t{k}" for k in range(LANES)]
    # Terms are below 2^31, so that sums of 2^32 of them fit.
    totals = terms.groupBy("conv_id", "part").agg(*[(F.sum(t) % PRIME).alias(t) for t in sums])
    earlier = before(totals, "conv_id", "part", sums).withColumnsRenamed({t: f"{t}_before" for t in sums})
    so_far = Window.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = terms.select("conv_id", "part", "at", "pos", "n", *[F.sum(t).over(so_far).alias(t) for t in sums]).join(earlier, ["conv_id", "part"])
    return written(rows.select("conv_id", "part", "at", "pos", "n", *[((F.col(t) + F.col(f"{t}_before")) % PRIME).alias(p) for t, p in zip(sums, P)]), "products")


def members(prefixes: DataFrame, of: list[int], every: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, p0.., n, ref, total): every prefix of at least a turn of every rebuilt conversation; `ref` is the stored turn
    it ends with. And (conv_id, total) of all conversations. Both written."""
    zero = F.lit(0).cast("bigint")
    cut = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    own = [F.coalesce(F.max(F.when(F.col("pos") == cut, F.col(p))), zero).alias(f"own_{p}") for p in P]
    convs = prefixes.groupBy("conv_id").agg(F.max("pos").alias("size"), *own)
    convs = convs.withColumn("cut", cut).withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    turn = F.struct("pos", "at", "n", *P)
    head = prefixes.where((F.col("conv_id") % every == 0) & (F.col("pos") < heads))
    head = head.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(turn)).alias("head"))
    convs = convs.join(head, "base", "left").withColumn("head", F.filter("head", lambda x: x["pos"] <= F.col("cut")))
    convs = convs.withColumn("taken", F.coalesce(F.size("head"), F.lit(0)).cast("bigint"))
    convs = convs.withColumn("taken", F.greatest("taken", zero)).withColumn("last", F.try_element_at("head", F.lit(-1)))
    convs = written(convs.withColumn("total", F.col("taken") + F.greatest(F.col("size") - F.col("cut"), zero)), "rebuilt")
    from_base = convs.select("conv_id", "total", F.explode("head").alias("x")).select(
        "conv_id", F.col("x.pos").alias("depth"), *[F.col(f"x.{p}") for p in P], "x.n", F.col("x.at").alias("ref"), "total"
    )
    # The join is by range as well, so that no conversation is one group.
    parts = prefixes.select("conv_id", "part").distinct().join(convs.where("size > cut").drop("head", "base", "size"), "conv_id")

    def lane(p: str, base: int) -> Column:
        # B^(taken - cut), by the inverse: a head is never longer than the cut.
        moved = power(pow(base, -1, PRIME), F.col("cut") - F.col("taken"))
        suffix = F.pmod(F.col(p) - F.col(f"own_{p}"), F.lit(PRIME))
        return ((suffix * moved) % PRIME + F.coalesce(F.col(f"last.{p}"), zero)) % PRIME

    suffixes = prefixes.join(parts, ["conv_id", "part"]).where("pos > cut").select(
        "conv_id", (F.col("taken") + F.col("pos") - F.col("cut")).alias("depth"), *[lane(p, b).alias(p) for p, b in zip(P, of)], "n",
        F.col("at").alias("ref"), "total",
    )
    return written(from_base.unionByName(suffixes), "members"), convs.select("conv_id", "total")


def wrong_nodes(rows: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes whose references name turns that differ."""
    refs = rows.select(*NODE, "ref").distinct()
    several = refs.groupBy(*NODE).agg(F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    asked = refs.join(several, NODE).join(turns.select(F.col("at").alias("ref"), "role", "text"), "ref")
    contents = asked.groupBy(*NODE, "role", "text").agg(F.lit(1).alias("one"))
    return contents.groupBy(*NODE).agg(F.count(F.lit(1)).alias("m")).where("m > 1")


def digest_ends(rows: DataFrame) -> DataFrame:
    """(depth, p0.., ends_sha256) of the members (conv_id) that end at each node, in order of their numbers, by ranges: a range hashes
    the nodes it holds whole, and packs what it has of the nodes at its edges; of these only the packs are brought together."""
    keys = [*NODE, "conv_id"]
    dealt = rows.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    names = [*NODE, "part", "ids"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        ids: list[int] = []
        part = 0
        for batch in itertools.chain(batches, [None]):
            out = []
            columns = [] if batch is None else [batch.column(c).to_pylist() for c in keys]
            for *node, own in zip(*columns):
                if tuple(node) != held or len(ids) >= 100_000:
                    if ids:
                        out.append((*held, part, ",".join(map(str, ids))))
                        part += 1
                    held, ids = tuple(node), []
                ids.append(own)
            if batch is None and ids:
                out.append((*held, part, ",".join(map(str, ids))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)

    packs = dealt.mapInArrow(pack, f"{', '.join(f'{c} bigint' for c in NODE)}, part bigint, ids string")
    packs = packs.withColumn("range", F.spark_partition_id())
    packs = written(packs, "ends")
    shares = packs.groupBy(*NODE).agg(F.count(F.lit(1)).alias("m"))
    one = packs.join(shares.where("m = 1").drop("m"), NODE).select(*NODE, F.sha2("ids", 256).alias("ends_sha256"))
    many = packs.join(shares.where("m > 1").drop("m"), NODE).repartition(*NODE).sortWithinPartitions(*NODE, "range", "part")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The hash of one node goes on from pack to pack."""
        held, hash_ = None, None
        for batch in itertools.chain(batches, [None]):
            out = []
            for *node, ids in () if batch is None else zip(*(batch.column(c).to_pylist() for c in [*NODE, "ids"])):
                if tuple(node) != held:
                    if held is not None:
                        out.append((*held, hash_.hexdigest()))
                    held, hash_ = tuple(node), hashlib.sha256(ids.encode())
                else:
                    hash_.update(b"," + ids.encode())
            if batch is None and held is not None:
                out.append((*held, hash_.hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*NODE, "ends_sha256"])

    return one.unionByName(many.mapInArrow(join, f"{', '.join(f'{c} bigint' for c in NODE)}, ends_sha256 string"))


def prefix_trie(conversations: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """One row for each different prefix of the rebuilt conversations; see the module for how they are rebuilt and the columns
    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversation c starts with the first h turns of conversation c - c % every, h being the CRC-32 of its number modulo `heads`.
    Turns are ordered by `turn`, null first, then by role and text; repeated rows are turns of their own. Null role or text is empty.
    Rows without conv_id belong to no conversation and are left out. Long texts are hashed and compared whole. Without rows there
    is no node at all. Other columns are not read, whatever their names.
    """
    turns = sorted_turns(conversations)
    places = placed(turns)
    for seed in itertools.count():
        of = bases(seed)
        prefixes = products(places, of)
        rows, convs = members(prefixes, of, every, heads)
        discard(prefixes)
        if wrong_nodes(rows, turns).isEmpty():
            break
    discard(turns)
    ends = F.sum((F.col("depth") == F.col("total")).cast("bigint")).alias("n_ends")
    nodes = rows.groupBy(*NODE).agg(F.min("conv_id").alias("first"), F.count(F.lit(1)).alias("n_convs"), ends)
    mine = F.col("first") == F.col("conv_id")
    known = rows.select("conv_id", "total", *NODE, "n").join(nodes, NODE)
    known = known.withColumn("saved", F.when(mine, (F.col("n_convs") - 1) * F.col("n")).otherwise(0))
    known = known.withColumn("block", F.floor(F.col("depth") / BLOCK))
    known = written(known, "known")

    # By conversation: the depth from which its nodes are its own, who owns the one above, what it saves, whether it ends in a leaf.
    leaf = (F.col("depth") == F.col("total")) & (F.col("n_convs") == F.col("n_ends"))
    paths = known.groupBy("conv_id").agg(
        F.min(F.when(mine, F.col("depth"))).alias("own_from"), F.max(F.when(~mine, F.col("first"))).alias("above"),
        F.sum("saved").alias("all_saved"), F.max((mine & leaf).cast("bigint")).alias("leaf"),
    )
    path = written(convs.join(paths, "conv_id", "left"), "paths")
    # What own nodes save from a depth on: within its block, and in the blocks below.
    sums = known.groupBy("conv_id", "block").agg(F.sum("saved").alias("below"))
    down = Window.partitionBy("conv_id").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "block", F.coalesce(F.sum("below").over(down), F.lit(0)).alias("below"))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("total") / BLOCK)))
    by_block = path.select("conv_id", "own_from", "above", "all_saved", "leaf", blocks.alias("block"))
    each = known.withColumn("inside", F.sum("saved").over(inside)).join(sums, ["conv_id", "block"]).join(by_block, ["conv_id", "block"])
    each = each.select(
        "conv_id", *NODE, "first", "n_convs",
        F.when(mine, F.col("inside") + F.col("below")).otherwise(F.col("all_saved")).alias("saved"),
        ((F.col("depth") < F.col("total")) & (F.col("depth") + 1 >= F.col("own_from"))).cast("bigint").alias("child"), "leaf",
        F.when(mine, F.when(F.col("depth") - 1 >= F.col("own_from"), F.col("conv_id")).otherwise(F.col("above"))).alias("up"),
    )
    out = each.groupBy(*NODE).agg(
        F.min("first").alias("conv_id"), F.max("up").alias("up"), F.max("n_convs").alias("n_convs"), F.sum("child").alias("n_children"),
        F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
    )
    zeros = [F.lit(0).cast("bigint").alias(c) for c in NODE]
    top = path.agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum((F.col("own_from") == 1).cast("bigint")).alias("n_children"),
        F.sum("leaf").alias("n_leaves"), F.coalesce(F.sum("all_saved"), F.lit(0)).alias("saved_tokens"),
    ).where("n_convs > 0")
    top = top.select(*zeros, "conv_id", F.lit(None).cast("bigint").alias("up"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
                     "n_leaves", "saved_tokens")
    ended = known.where("depth = total").select(*NODE, "conv_id").unionByName(path.where("total = 0").select(*zeros, "conv_id"))
    digests = digest_ends(ended)
    # The owner of the node above the first own one is `above`; of a node at depth 1 that is the root's, the smallest of all.
    smallest = path.agg(F.min("conv_id").alias("smallest"))
    found = out.unionByName(top).join(F.broadcast(smallest)).join(digests, NODE, "left")
    # Without a turn anywhere the root is a leaf itself.
    childless = (F.col("depth") == 0) & (F.col("n_children") == 0)
    return found.select(
        "conv_id", "depth", F.when(F.col("depth") == 1, F.col("smallest")).otherwise(F.col("up")).alias("parent_conv_id"), "n_convs", "n_children",
        F.when(childless, 1).otherwise(F.col("n_leaves")).cast("bigint").alias("n_leaves"), "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


#: The same in DuckDB: conversations as lists of turns, prefixes as text of their first turns.
SQL = """
WITH steps AS (
  SELECT i, i::BIGINT AS c FROM range(256) r(i)
), crc_table AS (
  SELECT list(CRC ORDER BY i) AS t FROM (SELECT i, STEPS AS crc FROM steps)
), stored AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), cuts AS (
  SELECT conv_id, turns, conv_id - conv_id % 100 AS base,
    xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295::BIGINT) % 6 AS cut
  FROM stored, crc_table
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.cut], []), c.turns[c.cut + 1:]) AS turns
  FROM cuts c LEFT JOIN stored b ON b.conv_id = c.base
), paths AS (
  SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM rebuilt
), members AS (
  SELECT conv_id, depth, len(turns) AS total, turns[1:depth]::VARCHAR || depth AS node,
    CASE WHEN depth > 0 THEN turns[1:depth - 1]::VARCHAR || (depth - 1) END AS up, CASE WHEN depth > 0 THEN length(turns[depth].text) ELSE 0 END AS n
  FROM paths
), nodes AS (
  SELECT node, any_value(up) AS up, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = total), '')) AS ends_sha256
  FROM members GROUP BY node
), children AS (
  SELECT up, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up
), below AS (
  SELECT DISTINCT a.node AS node, b.node AS inner_node
  FROM members a JOIN members b ON a.conv_id = b.conv_id AND a.depth <= b.depth
), sums AS (
  SELECT w.node, sum(n.saved) AS saved_tokens, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves
  FROM below w JOIN nodes n ON n.node = w.inner_node LEFT JOIN children k ON k.up = w.inner_node GROUP BY w.node
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves,
  s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.node = n.node LEFT JOIN nodes p ON p.node = n.up LEFT JOIN children k ON k.up = n.node
""".replace("list(CRC ", "list(crc ")
_step = "c"
for _ in range(8):
    _step = f"list_transform([{_step}], lambda v: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))[1]"
SQL = SQL.replace("STEPS", _step)


def op13_conversation_trie(spark, sf_dir: str) -> DataFrame:
    """The prefix trie of all `conversations`."""
    return prefix_trie(table(spark, sf_dir, "conversations"))
