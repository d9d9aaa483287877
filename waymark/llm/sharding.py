"""Best-fit-decreasing bin packing of indivisible groups into fixed-capacity shards.

Groups are rows of equal text. Groups of at least capacity / FINE bytes are few (their number is bounded by
shards * FINE); they are placed one by one. All smaller groups are first gathered, by hash, into bundles of about that
size, so the packing sees a bounded number of items however many rows there are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: Small groups are bundled so that a shard holds about this many items.
FINE = 256
#: Rows of a shard that are numbered together, and parts of a shard at least.
PART_ROWS = 50_000
LEAST_PARTS = 64


@dataclass
class _Node:
    key: tuple[int, int]
    rank: int
    left: _Node | None = None
    right: _Node | None = None


class GapTree:
    """A treap of (gap, bin): the tightest gap that holds a size in O(log bins)."""

    def __init__(self) -> None:
        self.root: _Node | None = None
        self._state = 0x2545F491

    def _split(self, node: _Node | None, key: tuple[int, int]) -> tuple[_Node | None, _Node | None]:
        if node is None:
            return None, None
        if node.key < key:
            node.right, rest = self._split(node.right, key)
            return node, rest
        rest, node.left = self._split(node.left, key)
        return rest, node

    def _merge(self, a: _Node | None, b: _Node | None) -> _Node | None:
        if a is None or b is None:
            return a or b
        if a.rank < b.rank:
            a.right = self._merge(a.right, b)
            return a
        b.left = self._merge(a, b.left)
        return b

    def add(self, gap: int, bin_: int) -> None:
        self._state = (self._state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        a, b = self._split(self.root, (gap, bin_))
        self.root = self._merge(self._merge(a, _Node((gap, bin_), self._state)), b)

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the tightest (gap, bin) with gap >= size, ties to the lowest bin."""
        a, b = self._split(self.root, (size, -1))
        if b is None:
            self.root = a
            return None
        node = b
        while node.left is not None:
            node = node.left
        first, rest = self._split(b, (node.key[0], node.key[1] + 1))
        self.root = self._merge(a, rest)
        return first.key


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int) -> dict[int, int]:
    """item -> bin for (item, size) pairs; an item over the capacity gets a bin of its own."""
    tree, out, bins = GapTree(), {}, 0
    for item, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        gap, at = tree.take(size) or (max(capacity, size), bins)
        bins += at == bins
        out[item] = at
        tree.add(gap - size, at)
    return out


def even_bins(sizes: list[tuple[int, int]], bins: int) -> dict[int, int]:
    """Best fit at the smallest of a rising row of capacities that needs no more than `bins` bins.

    An item over a fair share of what is left has a bin to itself, so that the others stay even.
    """
    alone: dict[int, int] = {}
    rest, left = sorted(sizes, key=lambda x: (-x[1], x[0])), sum(s for _, s in sizes)
    while len(rest) > 1 and len(alone) < bins - 1 and rest[0][1] * (bins - len(alone)) > left:
        left -= rest[0][1]
        alone[rest.pop(0)[0]] = len(alone)
    free = bins - len(alone)
    capacity = max(1, math.ceil(left / free), rest[0][1] if rest else 1)
    step = max(1, capacity // 20_000)
    while True:
        out = best_fit_decreasing(rest, capacity)
        if max(out.values(), default=0) < free:
            return alone | {k: v + len(alone) for k, v in out.items()}
        capacity, step = capacity + step, step * 2 if step < capacity // 500 else step


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32 and grp, the hash that rows of equal text share (null text counts as empty)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("grp"))


def _bundle(grp: Column, bundles: int) -> Column:
    return F.pmod(F.xxhash64(grp, F.lit(9)), F.lit(bundles))


def shard_plan(rows: DataFrame, shards: int, fine: int = FINE) -> tuple[DataFrame, DataFrame, int, int]:
    """The shards of large groups (grp, shard) and of bundles (bundle, shard), both of bounded size, the number of bundles and that of rows."""
    spark, bundles = rows.sparkSession, shards * fine
    groups = written(rows.groupBy("grp").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups")
    total, n = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    floor = max(1, total // (shards * fine))
    large = [(r.grp, r.bytes) for r in groups.filter(F.col("bytes") >= floor).collect()]  # at most shards * fine + 1 rows
    small = [(r.bundle, r.bytes) for r in groups.filter(F.col("bytes") < floor).groupBy(_bundle(F.col("grp"), bundles).alias("bundle")).agg(F.sum("bytes").alias("bytes")).collect()]
    items = [(i, s) for i, (_, s) in enumerate(large + small)]
    at = even_bins(items, shards) if items else {}
    big = spark.createDataFrame([(g, at[i]) for i, (g, _) in enumerate(large)], "grp long, big_shard int")
    rest = spark.createDataFrame([(b, at[len(large) + i]) for i, (b, _) in enumerate(small)], "bundle long, small_shard int")
    return big, rest, bundles, n


def shard(rows: DataFrame, shards: int = 40) -> DataFrame:
    """rows of sized() with shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    Rows of equal text share a shard, so a text that holds more than one shard's share makes its shard larger. Null ids
    and repeated rows are placed like others, each with a slot of its own; an empty table gives an empty result. A shard's
    slots are counted in parts of about PART_ROWS rows, so no task needs a whole shard.
    """
    big, rest, bundles, n = shard_plan(rows, shards)
    salts = max(LEAST_PARTS, -(-n // (shards * PART_ROWS)))
    placed = (
        rows.join(F.broadcast(big), "grp", "left")  # bounded by shards * FINE
        .withColumn("bundle", _bundle(F.col("grp"), bundles))
        .join(F.broadcast(rest), "bundle", "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("big_shard", "small_shard").alias("shard"), F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(salts)).alias("salt"))
    )
    return with_slots(placed, ["shard"], "salt", [F.col("doc_id"), F.col("text_crc32")], "slot").drop("salt")


def with_slots(rows: DataFrame, group: list[str], salt: str, order: list[Column], name: str) -> DataFrame:
    """Gapless numbers from 0 within each group, counted per salt first."""
    counts = rows.groupBy(*group, salt).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*group).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select(*group, salt, F.coalesce(before, F.lit(0)).alias("base"))
    in_salt = rows.withColumn("in_salt", F.row_number().over(Window.partitionBy(*group, salt).orderBy(*order)) - 1)
    return in_salt.join(base, [*group, salt]).withColumn(name, (F.col("base") + F.col("in_salt")).cast("long")).drop("base", "in_salt")


def op9_sharding(spark, sf_dir):
    """Every document in one of 40 shards of near equal bytes; equal texts together."""
    from .store import table

    rows = written(sized(table(spark, sf_dir, "documents")), "sized")
    return shard(rows).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
