"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, parquet

#: The ring's slots of equal width; a power of two. Planning works on so many counts, whatever the input.
SLOT_BITS = 13
#: A group's rows are dealt into 2^PART_BITS parts for counting, so that a hot group does not meet in one task.
PART_BITS = 8

_PIECES = T.ArrayType(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("base", T.LongType())]))


def ring(n_shards: int, vnodes: int = 128) -> list[tuple[int, int]]:
    """(ring slot, shard) of each virtual node, clockwise. A shard's nodes do not depend on the others."""
    at = lambda s, v: int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big")
    return [(p >> (64 - SLOT_BITS), s) for p, s in sorted((at(s, v), s) for s in range(n_shards) for v in range(vnodes))]


def plan(counts: dict[int, int], n_shards: int, vnodes: int = 128) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each slot, (from rank, to rank, shard, first place in the shard).

    Every shard takes its own slots' rows up to its capacity, floor or ceil of the mean; what is left
    over goes on clockwise, past full shards, to the next virtual node whose shard has room.
    """
    total = sum(counts.values())
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    filled = [0] * n_shards
    nodes = ring(n_shards, vnodes)
    slots = [p for p, _ in nodes]
    following = list(range(1, len(nodes))) + [0]
    pieces: dict[int, list[tuple[int, int, int, int]]] = {}

    def put(slot: int, shard: int, lo: int, n: int) -> int:
        take = min(n, room[shard] - filled[shard])
        if take:
            pieces.setdefault(slot, []).append((lo, lo + take, shard, filled[shard]))
            filled[shard] += take
        return take

    def open_node(i: int) -> int:
        """The first node from i on whose shard has room; skipped nodes are shortcut."""
        path = []
        while filled[nodes[i][1]] >= room[nodes[i][1]]:
            path.append(i)
            i = following[i]
        for p in path:
            following[p] = i
        return i

    rest = []
    for slot, n in sorted(counts.items()):
        home = bisect_left(slots, slot) % len(nodes)
        if (took := put(slot, nodes[home][1], 0, n)) < n:
            rest.append((slot, home, took, n))
    for slot, i, done, n in rest:
        while done < n:
            i = open_node(i)
            done += put(slot, nodes[i][1], done, n - done)
    return pieces


def shard(df: DataFrame, group: Column, key: Column, n_shards: int, vnodes: int = 128) -> DataFrame:
    """df's rows with `shard` (0 to n_shards - 1) and `slot` (the row's place in it, gapless from 0).

    Rows of one group stand in one ring slot and follow one another there, so that they share a shard as long as it
    has room, and a shard's end tears one group at most; shards' row counts are at most one apart. key orders a
    group's rows. Null groups and keys are values like others; repeated rows take places of their own; an empty df gives no rows.
    """
    spark = df.sparkSession
    ringed = materialize(
        df.withColumns({"__h": F.xxhash64(F.lit(17), group), "__k": F.xxhash64(F.lit(29), key)})
        .withColumns({"__slot": F.shiftrightunsigned("__h", 64 - SLOT_BITS).cast("int"), "__part": F.shiftrightunsigned("__k", 64 - PART_BITS).cast("int")}),
        "ring",
    )
    parts = ringed.groupBy("__slot", "__h", "__part").agg(F.count("*").alias("__n"))
    ahead = Window.partitionBy("__slot").orderBy("__h", "__part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.withColumn("__before", F.coalesce(F.sum("__n").over(ahead), F.lit(0))).drop("__n")
    counts = {r[0]: r[1] for r in ringed.groupBy("__slot").count().collect()}  # 2^SLOT_BITS rows at most
    table = spark.createDataFrame([(s, p) for s, p in plan(counts, n_shards, vnodes).items()], T.StructType([T.StructField("__slot", T.IntegerType()), T.StructField("__pieces", _PIECES)]))
    within = Window.partitionBy("__slot", "__h", "__part").orderBy("__k")
    rank = (F.row_number().over(within) - 1).cast("long")
    placed = (
        ringed.withColumn("__row", rank)
        .join(before, ["__slot", "__h", "__part"])
        .withColumn("__rank", F.col("__row") + F.col("__before"))
        .join(F.broadcast(table), "__slot")
        .withColumn("__piece", F.filter("__pieces", lambda p: (p["lo"] <= F.col("__rank")) & (F.col("__rank") < p["hi"]))[0])
    )
    return placed.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("shard", "slot")], F.col("__piece.shard").alias("shard"), (F.col("__piece.base") + F.col("__rank") - F.col("__piece.lo")).alias("slot"))


def op10_shard_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards by law `rows`; equal texts are the groups."""
    docs = parquet(spark, sf_dir, "documents")
    data = F.encode("text", "UTF-8")
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(data), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64("text", F.isnull("text")).alias("__group"),
    )
    out = shard(narrow, F.col("__group"), F.col("doc_id"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op10_shard_ring": op10_shard_ring}
ORACLE_SQL: dict[str, str] = {}
