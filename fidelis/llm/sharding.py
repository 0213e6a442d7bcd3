"""Sharding by best-fit-decreasing bin packing of indivisible groups (equal texts).

Groups of more than total / (shards * units) bytes are packed as they are; there are at most
shards * units of those. Smaller groups are first packed into crates of about that size, by the
task that holds them, largest first: a task holds its open crates only, in a balanced tree of
remaining capacities, while Spark sorts and spills the rows. What the last packing sees is
therefore at most 2 * shards * units + ``deals`` items, whatever the input's size; how many partitions Spark shuffles into changes nothing. It
looks for the smallest capacity with which best fit decreasing needs no more shards than asked
for. Groups larger than an equal share get a shard of their own, the rest share the others.

Defined cases: a null text has size 0 and 8 bytes of overhead; rows that repeat id and text are
each placed; null ids are placed like others; an empty table gives an empty result; with fewer
groups than shards some shards stay empty; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fidelis.llm.common import materialize, text_of


class Spaces:
    """Bins by remaining capacity in a balanced tree (a treap over capacity, bin), for best fit."""

    __slots__ = ("root", "seed")

    def __init__(self) -> None:
        self.root: list | None = None  # [key, priority, left, right]
        self.seed = 88172645463325252

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            node[3], high = self._split(node[3], key)
            return node, high
        low, node[2] = self._split(node[2], key)
        return low, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, space: int, name: int) -> None:
        x = self.seed
        x ^= (x << 13) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 7
        self.seed = x = x ^ ((x << 17) & 0xFFFFFFFFFFFFFFFF)
        low, high = self._split(self.root, (space, name))
        self.root = self._merge(self._merge(low, [(space, name), x, None, None]), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the tightest bin with room for size."""
        node, best = self.root, None
        while node is not None:
            if node[0][0] >= size:
                best, node = node[0], node[2]
            else:
                node = node[3]
        if best is not None:
            low, high = self._split(self.root, best)
            _, high = self._split(high, (best[0], best[1] + 1))
            self.root = self._merge(low, high)
        return best


def best_fit_decreasing(items: list[tuple[int, object]], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each item; items in decreasing size. None if more than ``most`` bins are needed."""
    spaces, bins, out = Spaces(), 0, []
    for size, _ in items:
        if (got := spaces.take(size)) is None:
            if most is not None and bins >= most:
                return None
            got, bins = (max(capacity, size), bins), bins + 1
        spaces.add(got[0] - size, got[1])
        out.append(got[1])
    return out


def pack(items: list[tuple[int, object]], shards: int) -> dict[object, int]:
    """Shard of each (size, name) with the smallest capacity for which best fit decreasing needs no more than ``shards``."""
    items = sorted(items, key=lambda x: (-x[0], str(x[1])))
    out, first = {}, 0
    while items and first < shards - 1 and items[0][0] * (shards - first) > sum(x[0] for x in items):
        out[items[0][1]], items, first = first, items[1:], first + 1
    if not items:
        return out
    total, left = sum(x[0] for x in items), shards - first
    low = max(items[0][0], -(-total // left))
    high = low
    while (best := best_fit_decreasing(items, high, left)) is None:
        high += max(1, total // left // 64)
    while high - low > max(1, total // left // 4096):
        mid = (low + high) // 2
        if (found := best_fit_decreasing(items, mid, left)) is None:
            low = mid
        else:
            high, best = mid, found
    return out | {name: first + b for (_, name), b in zip(items, best, strict=True)}


def shard(docs: DataFrame, shards: int = 24, units: int = 512, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, deals: int = 4096) -> DataFrame:
    """A row per document: id, size, text_crc32, law, shard, slot, grown_shard. Equal texts share a shard; sizes of shards are near equal."""
    spark = docs.sparkSession
    t = text_of(text_col)
    slim = docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(t) + overhead).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(t, 256)).alias("_d")
    )
    slim = materialize(slim, "shard-docs")
    groups = slim.groupBy("_d").agg(F.sum("size").alias("_n"))
    total = slim.agg(F.sum("size")).first()[0] or 0
    unit = max(1, total // (shards * units))

    def crates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Best fit into crates; the rows come by decreasing size."""
        spaces, made, part = Spaces(), 0, None
        for pdf in batches:
            names = []
            for p, n in zip(pdf["_p"], pdf["_n"], strict=True):
                if p != part:
                    spaces, made, part = Spaces(), 0, p
                if n > unit:
                    names.append(None)
                    continue
                if (got := spaces.take(n)) is None:
                    got, made = (unit, made), made + 1
                spaces.add(got[0] - n, got[1])
                names.append(f"{p}-{got[1]}")
            yield pd.DataFrame({"_d": pdf["_d"], "_n": pdf["_n"], "_crate": names})

    # _p deals the small groups out by digest, always in the same way
    dealt = groups.withColumn("_p", F.pmod(F.xxhash64("_d"), F.lit(deals))).repartition("_p").sortWithinPartitions("_p", F.desc("_n"), "_d")
    crated = dealt.select("_d", "_n", "_p").mapInPandas(crates, "_d binary, _n long, _crate string")
    crated = materialize(crated.withColumn("_item", F.coalesce("_crate", F.lower(F.hex("_d")))), "shard-crates")
    # at most 2 * shards * units + deals rows
    items = [(r[1], r[0]) for r in crated.groupBy("_item").agg(F.sum("_n")).collect()]
    placed = spark.createDataFrame([(k, v) for k, v in pack(items, shards).items()], "_item string, shard int")
    where = crated.join(placed, "_item").select("_d", "shard")
    rows = materialize(slim.join(where, "_d").withColumn("_b", F.pmod(F.xxhash64("_id", "_d"), F.lit(deals))), "shard-rows")
    # slots: rows before this bucket, then the place in it, so no shard meets in one task
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    place = F.row_number().over(Window.partitionBy("shard", "_b").orderBy("_id", "_d")) - 1
    return (
        rows.withColumn("_place", place)
        .join(offsets, ["shard", "_b"])
        .select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_before") + F.col("_place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
