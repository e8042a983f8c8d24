"""Prefix trie of conversations: nodes, members and subtree totals by centroid decomposition.

A node is a distinct sequence of first turns. It is known by its smallest member and its depth, as every member passes
through it at that depth. Subtree totals come from the centroid decomposition of the forest of parent edges: the centroid
of a component splits it into its children's components and the rest above; the total of what lay at and below it is added
to the nodes on the path from the centroid to the component's top. Large components are split by Spark, all in a round,
until they are small enough for a task, where arrays do the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, parquet, partitions, tidy, whole_groups

#: A conversation c begins as that of c - c % SHARED does, with crc32(c) % MOST of its turns.
SHARED, MOST = 100, 6
#: Components of more nodes are split by Spark; smaller ones go to a task whole.
COMPONENT = 512
#: Ids that are joined to one string before they are hashed.
RUN = 4096
_PARTS = ("p0", "p1", "p2", "p3")


def numbered(rows: DataFrame, key: str, order: list[Column], sums: tuple[str, ...], name: str) -> DataFrame:
    """rows with __n, a row's number from 1 among those of its key in the given order, and each of `sums` summed up to it.

    The rows are range-sorted by key and order, so that a key with many rows lies in several partitions; a partition's
    rows of a key are numbered by themselves, and what the partitions before have of that key is added.
    """
    spread = rows.withColumn("__row", F.monotonically_increasing_id())  # rows is a table in files: repeated rows are spread, too
    placed = spread.repartitionByRange(partitions(rows.sparkSession), key, *order, "__row").sortWithinPartitions(key, *order, "__row")
    placed = materialize(placed.drop("__row").withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)), name)
    inside = Window.partitionBy("__part", key).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    own = placed.withColumns({"__n": F.count("__at").over(inside)} | {s: F.sum(s).over(inside) for s in sums})
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("__part", key).agg(F.count("__at").alias("__n"), *[F.sum(s).alias(s) for s in sums])
    totals = totals.select(F.col("__part").alias("__p"), F.col(key).alias("__k"), *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"__before_{s}") for s in ("__n", *sums)])
    totals = totals.where(F.col("__before___n") > 0)  # keys that begin in a partition before
    both = own.join(totals, (F.col("__part") == F.col("__p")) & (F.col(key) == F.col("__k")), "left")
    return both.select(
        *[c for c in rows.columns if c not in sums], *[(F.col(s) + F.coalesce(f"__before_{s}", F.lit(0))).alias(s) for s in ("__n", *sums)]
    )


def rebuilt(conversations: DataFrame, shared: int = SHARED, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """The turns of every rebuilt conversation (conv_id, depth from 1, role, text), and all conv_ids with their n_turns.

    Turns stand by turn (null first); those of one turn by role, then text. Null roles and texts are empty; rows
    without a conv_id belong to no conversation. Other columns are not read.
    """
    empty = F.lit("")
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    turns = numbered(materialize(turns, "turns"), "conv_id", [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()], (), "turns-sorted")
    turns = materialize(turns.select("conv_id", "role", "text", F.col("__n").alias("n")), "turns-numbered")
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("head")
    convs = turns.groupBy("conv_id").agg(F.count("n").alias("n_own")).select("conv_id", "n_own", head, (F.col("conv_id") - F.col("conv_id") % shared).alias("base"))
    sizes = convs.select(F.col("conv_id").alias("of_base"), F.col("n_own").alias("n_base"))
    convs = convs.join(sizes, F.col("base") == F.col("of_base"), "left").select("conv_id", "n_own", "head", "base", F.least("head", F.coalesce("n_base", F.lit(0))).alias("taken"))
    convs = materialize(convs.withColumn("n_turns", F.col("taken") + F.greatest(F.col("n_own") - F.col("head"), F.lit(0))), "conversations")
    first = turns.where(F.col("n") < most).select(F.col("conv_id").alias("of_base"), F.col("n").alias("depth"), "role", "text")  # fewer than `most` a conversation
    taken = convs.where("taken > 0").join(first, (F.col("base") == F.col("of_base")) & (F.col("depth") <= F.col("taken"))).select("conv_id", "depth", "role", "text")
    heads = convs.select(F.col("conv_id").alias("own"), "head", "taken")
    kept = turns.join(heads, F.col("conv_id") == F.col("own")).where(F.col("n") > F.col("head")).select("conv_id", (F.col("taken") + F.col("n") - F.col("head")).alias("depth"), "role", "text")
    return taken.unionByName(kept), convs.select("conv_id", "n_turns")


def places(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Where each rebuilt conversation passes: conv_id, depth (0 is the root), node, parent (the node above), length (code
    points of the last text) and ahead (places from here on). node is the smallest conv_id with the same turns up to here.

    A prefix is known by 128 bits: the sum over its turns of a digest of place, role and text, so that prefixes of a
    long conversation need no state but running sums.
    """
    digest = F.md5(F.concat_ws(":", "depth", F.octet_length("role"), "role", "text"))
    parts = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(p) for i, p in enumerate(_PARTS)]
    own = turns.select("conv_id", "depth", F.length("text").cast("long").alias("length"), *parts)
    # sums by place, which numbers the turns as well
    sums = numbered(materialize(own, "digests"), "conv_id", [F.col("depth").asc()], _PARTS, "digests-sorted").drop("__n")
    prefix = F.unhex(F.md5(F.concat_ws(":", *_PARTS)))
    members = materialize(sums.select("conv_id", "depth", "length", prefix.alias("prefix")), "members")
    least = members.groupBy("depth", "prefix").agg(F.min("conv_id").alias("node"))
    named = members.join(least.select(F.col("depth").alias("d"), F.col("prefix").alias("p"), "node"), (F.col("depth") == F.col("d")) & (F.col("prefix") == F.col("p")))
    root = convs.agg(F.min("conv_id").alias("root"))  # one row
    top = convs.crossJoin(F.broadcast(root)).select("conv_id", F.lit(0).cast("long").alias("depth"), F.col("root").alias("node"), F.lit(0).cast("long").alias("length"))
    passed = materialize(top.unionByName(named.select("conv_id", "depth", "node", "length")), "passed")
    above = passed.select(F.col("conv_id").alias("c"), (F.col("depth") + 1).alias("d"), F.col("node").alias("parent"))
    passed = passed.join(above, (F.col("conv_id") == F.col("c")) & (F.col("depth") == F.col("d")), "left").drop("c", "d")
    ends = convs.select(F.col("conv_id").alias("c"), "n_turns")
    ahead = (F.col("n_turns") - F.col("depth") + 1).alias("ahead")
    return materialize(passed.join(ends, F.col("conv_id") == F.col("c")).select("conv_id", "depth", "node", "parent", "length", ahead), "places")


# ---- totals of subtrees --------------------------------------------------------------------------


def decompose(parent: np.ndarray, depth: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Totals of each node's subtree by centroid decomposition of a forest; all components are split in each round.

    parent holds indexes (-1 for tops), depth grows by one from parent to child, values has a column for each total.
    """
    n, up, done = len(parent), parent.copy(), np.zeros(len(parent), bool)
    out = np.zeros_like(values)
    order = np.argsort(depth, kind="stable")
    bounds = np.flatnonzero(np.diff(depth[order])) + 1 if n else np.zeros(0, np.int64)
    levels = np.split(order, bounds)
    while not done.all():
        size, below, top = weight.copy(), values.copy(), np.arange(n)
        size[done] = 0
        for level in reversed(levels):
            inner = level[(up[level] >= 0) & ~done[level]]
            np.add.at(size, up[inner], size[inner])
            np.add.at(below, up[inner], below[inner])
        for level in levels:
            inner = level[(up[level] >= 0) & ~done[level]]
            top[inner] = top[up[inner]]
        heavy = np.flatnonzero(~done & (2 * size >= size[top]))
        heavy = heavy[np.argsort(depth[heavy], kind="stable")]
        centroid = np.full(n, -1)
        centroid[top[heavy]] = heavy  # of a component's heavy nodes the deepest comes last
        at = centroid[centroid >= 0]
        totals, climb = below[at], at.copy()
        while len(climb):  # from each centroid to its component's top
            np.add.at(out, climb, totals)
            climb = up[climb]
            totals, climb = totals[climb >= 0], climb[climb >= 0]
        cut = np.zeros(n, bool)
        cut[at] = True
        done |= cut
        up[(up >= 0) & cut[up]] = -1
    return out


_TOTALS = "node long, depth long, n_leaves long, saved_tokens long"


def _whole_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of whole components, which come one behind the other; several at a time."""
    for table in whole_groups(batches):
        top_node, top_depth, node, depth, parent, weight, leaves, saved = (table.column(c).to_numpy(zero_copy_only=False) for c in table.column_names[1:])
        place = {k: i for i, k in enumerate(zip(top_node.tolist(), top_depth.tolist(), node.tolist(), depth.tolist(), strict=True))}
        above = zip(top_node.tolist(), top_depth.tolist(), parent.tolist(), (depth - 1).tolist(), strict=True)
        up = np.array([place.get(k, -1) for k in above], np.int64)  # the node above a top is in another component
        got = decompose(up, depth, weight, np.stack([leaves, saved], 1))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(depth), pa.array(got[:, 0]), pa.array(got[:, 1])], names=["node", "depth", "n_leaves", "saved_tokens"])


def subtree_totals(nodes: DataFrame, members: DataFrame, most: int = COMPONENT) -> DataFrame:
    """node, depth, n_leaves and saved_tokens of each node's subtree.

    nodes: node, depth, parent (-1 above the root), weight (members), heft (the sum of the subtree's weights, which is what
    the members have ahead of them), leaves (1 without children) and saved (the node's own tokens); members as places() gives
    them. A component is known by its top.

    Each round halves the weight of every component of more than `most` nodes. A node lies below a centroid if its smallest
    member passes through the centroid, and above it if the centroid's smallest member passes through the node: both
    are joins with one partner at most, however deep the trie is.
    """
    spark = nodes.sparkSession
    component, columns = ["top_node", "top_depth"], ["top_node", "top_depth", "node", "depth", "parent", "weight", "leaves", "saved", "heft"]
    root = nodes.where("depth = 0").select(F.col("node").alias("top_node"), F.col("depth").alias("top_depth"))  # one row
    large = materialize(nodes.crossJoin(F.broadcast(root)).select(*columns), "trie")
    passes = members.select(F.col("conv_id").alias("by"), F.col("depth").alias("by_depth"), F.col("node").alias("by_node"), F.col("parent").alias("by_parent"))
    whole, added = [], []

    def of_component(df: DataFrame, other: DataFrame) -> DataFrame:
        named = other.withColumnsRenamed({c: f"of_{c}" for c in component})
        return df.join(named, (F.col("top_node") == F.col("of_top_node")) & (F.col("top_depth") == F.col("of_top_depth"))).drop("of_top_node", "of_top_depth")

    while True:
        sizes = large.groupBy(*component).agg(F.count("node").alias("n"), F.max("heft").alias("all"))
        sized = materialize(of_component(large, sizes), "trie-sized")
        whole.append(sized.where(F.col("n") <= most).select(*columns))
        big = sized.where(F.col("n") > most)
        # the deepest node that has half of its component's weight at or below it
        heavy = big.where(2 * F.col("heft") >= F.col("all")).groupBy(*component).agg(F.max_by(F.struct("node", "depth", "heft"), "depth").alias("c"))
        centroids = materialize(heavy.select(*component, F.col("c.node").alias("c_node"), F.col("c.depth").alias("c_depth"), F.col("c.heft").alias("c_heft")), "centroids")
        if centroids.isEmpty():
            break
        split = of_component(big.select(*columns), centroids)
        tops = centroids.select("c_node", "c_depth").distinct()
        down = passes.join(tops, (F.col("by_parent") == F.col("c_node")) & (F.col("by_depth") == F.col("c_depth") + 1)).select(F.col("by").alias("d_by"), F.col("c_node").alias("d_node"), F.col("c_depth").alias("d_depth"), F.col("by_node").alias("branch"))
        split = split.join(down, (F.col("node") == F.col("d_by")) & (F.col("c_node") == F.col("d_node")) & (F.col("c_depth") == F.col("d_depth")) & (F.col("depth") > F.col("c_depth")), "left")
        climb = passes.join(centroids.select(F.col("c_node").alias("u_by")).distinct(), F.col("by") == F.col("u_by")).select("u_by", F.col("by_depth").alias("u_depth"), F.col("by_node").alias("u_node"))
        split = split.join(climb, (F.col("c_node") == F.col("u_by")) & (F.col("depth") == F.col("u_depth")) & (F.col("node") == F.col("u_node")) & (F.col("depth") <= F.col("c_depth")), "left")
        own = (F.col("depth") == F.col("c_depth")) & F.col("u_by").isNotNull()
        side = F.when(own, "centroid").when(F.col("branch").isNotNull(), "below").otherwise("rest")
        split = materialize(split.select(*columns, "c_depth", "c_heft", "branch", F.col("u_by").isNotNull().alias("on_path"), side.alias("side")), "trie-split")
        totals = split.where("side <> 'rest'").groupBy(*component).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
        added.append(materialize(of_component(split.where("on_path"), totals).select("node", "depth", "n_leaves", "saved_tokens"), "path-totals"))
        rest = split.where("side = 'rest'").withColumn("heft", F.col("heft") - F.when(F.col("on_path"), F.col("c_heft")).otherwise(0)).select(*columns)
        below = split.where("side = 'below'").withColumns({"top_node": F.col("branch"), "top_depth": F.col("c_depth") + 1}).select(*columns)
        large = materialize(rest.unionByName(below), "trie")
    small = reduce(DataFrame.unionByName, whole).select(F.xxhash64(*component).alias("component"), *columns[:-1])
    small = small.repartition(partitions(spark), "component").sortWithinPartitions("component")
    every = reduce(DataFrame.unionByName, added, small.mapInArrow(tidy(_whole_components), _TOTALS))
    return every.groupBy("node", "depth").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))


# ---- who ends where ------------------------------------------------------------------------------


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one node, sorted, as strings of RUN ids at most."""
    names = ["node", "depth", "first", "ids"]
    key, ids, out = None, [], []

    def close() -> None:
        if ids:
            out.append((*key, ids[0], ",".join(map(str, ids))))
            ids.clear()

    for batch in batches:
        for node, depth, conv in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if key != (node, depth) or len(ids) == RUN:
                close()
                key = (node, depth)
            ids.append(conv)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)
            out.clear()
    close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of a node's strings in a row; of a node only the state is held."""
    names = ["node", "depth", "ends_sha256"]
    key, state = None, None
    for batch in batches:
        out = []
        for node, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("node", "depth", "ids")), strict=True):
            if key != (node, depth):
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (node, depth), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([state.hexdigest()])], names=names)


def ends(members: DataFrame) -> DataFrame:
    """node, depth and ends_sha256 of the nodes where conversations end.

    The digest runs through a node's ids in order, so one task must see them; it gets them joined to strings, made by
    a range sort that splits large nodes.
    """
    n = partitions(members.sparkSession)
    order = ["node", "depth", "conv_id"]
    runs = members.where("ahead = 1").select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_runs, "node long, depth long, first long, ids string")
    return runs.repartition(n, "node", "depth").sortWithinPartitions("node", "depth", "first").mapInArrow(_digests, "node long, depth long, ends_sha256 string")


def trie(conversations: DataFrame, shared: int = SHARED, most: int = MOST, component: int = COMPONENT) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations.

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. See rebuilt() for nulls and ties; repeated rows are turns of their own. Conversations without a turn left are
    members of the root alone. An empty table has no conversation and so no root. Only conv_id, turn, role and text are read.
    """
    turns, convs = rebuilt(conversations, shared, most)
    members = places(turns, convs)
    nodes = members.groupBy("node", "depth").agg(F.count("conv_id").alias("weight"), F.sum("ahead").alias("heft"), F.min("parent").alias("parent"), F.min("length").alias("length"))
    nodes = materialize(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("p"), (F.col("depth") - 1).alias("d")).agg(F.count("node").alias("n_children"))
    nodes = nodes.join(children, (F.col("node") == F.col("p")) & (F.col("depth") == F.col("d")), "left").drop("p", "d").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = materialize(nodes, "nodes-children")
    tree = nodes.select("node", "depth", F.coalesce("parent", F.lit(-1)).alias("parent"), "weight", "heft", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("weight") - 1) * F.col("length")).alias("saved"))
    totals = subtree_totals(tree, members, component)
    out = nodes.join(totals, ["node", "depth"]).join(ends(members), ["node", "depth"], "left")
    none = hashlib.sha256().hexdigest()
    return out.select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("weight").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(parquet(spark, sf_dir, "conversations"))


QUERIES = {"op12_prefix_trie": op12_prefix_trie}

#: crc32 of a string in SQL: bit by bit over its bytes.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
  lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, i: xor(v >> 1, 3988292384::BIGINT * (v & 1)))), 4294967295::BIGINT)"""

ORACLE_SQL = {
    "op12_prefix_trie": f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n,
  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT c, c - c % {SHARED} AS base, {_CRC} % {MOST} AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT c.c, t.n, 0 AS own, role, text FROM c JOIN t ON t.c = c.base AND t.n <= c.h
  UNION ALL SELECT c.c, t.n, 1 AS own, role, text FROM c JOIN t ON t.c = c.c AND t.n > c.h),
s AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, n) AS depth, text, sha256(to_json([role, text])) AS k FROM r),
p AS (SELECT c, depth, length(text) AS len, sha256(string_agg(k, ',') OVER (PARTITION BY c ORDER BY depth)) AS prefix FROM s
  UNION ALL SELECT c, 0, 0, '' FROM c),
q AS (SELECT *, min(c) OVER (PARTITION BY depth, prefix) AS node, max(depth) OVER (PARTITION BY c) AS n_turns FROM p),
u AS (SELECT q.*, a.node AS parent FROM q LEFT JOIN q a ON a.c = q.c AND a.depth = q.depth - 1),
m AS (SELECT node, depth, min(parent) AS parent, count(*) AS n_convs, (count(*) - 1) * min(len) AS saved,
  sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE depth = n_turns), '')) AS ends_sha256 FROM u GROUP BY node, depth),
k AS (SELECT m.*, (SELECT count(*) FROM m x WHERE x.parent = m.node AND x.depth = m.depth + 1) AS n_children FROM m),
z AS (SELECT u.node, u.depth, sum(CASE WHEN k.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(k.saved) AS saved_tokens
  FROM u JOIN k ON u.c = k.node AND u.depth <= k.depth GROUP BY ALL)
SELECT k.node AS conv_id, CAST(k.depth AS BIGINT) AS depth, parent AS parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM k JOIN z ON k.node = z.node AND k.depth = z.depth
"""
}
