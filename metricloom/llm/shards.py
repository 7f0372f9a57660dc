"""Sharding by minimax contiguous partition of ordered atomic groups.

Rows of equal text form a group that stays together. The groups are ordered by a hash of the text and cut into
contiguous shards so that the largest shard is as small as it can be: the capacity is found
by binary search, and a capacity is feasible if filling greedily needs no more than the shards there are. Inside that
capacity the cuts are then placed to keep the shards even.

The driver never sees the groups. It holds a summary, the bytes of every hash range: first 2**14 ranges, then
only those are split further in which a cut could fall for any capacity still in question,
until each of them is a single group or the capacity is known.

Cases: null and empty texts are one group of rows of ``overhead`` bytes. Fewer groups than shards leave shards empty. Equal
rows are rows of their own with slots of their own. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.common import column
from metricloom.session import materialize

FIRST_BITS = 14
MORE_BITS = 6
#: Rows that share a slot counter, about.
SLOT_ROWS = 10_000


class Ranges:
    """Consecutive hash ranges: first key, bytes, groups."""

    def __init__(self, start: np.ndarray, size: np.ndarray, groups: np.ndarray):
        self.start, self.size, self.groups = start, size, groups
        self.upto = np.concatenate(([0], np.cumsum(self.size)))

    def greedy(self, capacity: int, shards: int, divisible: bool) -> list[int]:
        """Byte positions of the cuts when filling to ``capacity``; shorter than ``shards`` if it got stuck."""
        at, cuts = 0, []
        while at < self.upto[-1] and len(cuts) < shards:
            k = int(np.searchsorted(self.upto, at + capacity, "right")) - 1
            to = int(self.upto[k])
            if divisible and k < len(self.size) and self.groups[k] > 1:
                to = at + capacity
            if to <= at:
                break
            at = to
            cuts.append(at)
        return cuts

    def feasible(self, capacity: int, shards: int, divisible: bool) -> bool:
        cuts = self.greedy(capacity, shards, divisible)
        return (cuts[-1] if cuts else 0) >= self.upto[-1]

    def capacity(self, shards: int, divisible: bool) -> int:
        low, high = 0, int(self.upto[-1])
        while low < high:
            mid = (low + high) // 2
            if self.feasible(mid, shards, divisible):
                high = mid
            else:
                low = mid + 1
        return high

    def even_cuts(self, shards: int) -> list[int]:
        """First keys of shard 1, 2, ...: no shard above the smallest capacity, each near an equal part of what is left."""
        most, out, at = self.capacity(shards, False), [], 0
        n = len(self.size)
        for left in range(shards, 1, -1):
            goal = self.upto[at] + (self.upto[-1] - self.upto[at]) / left
            far = int(np.searchsorted(self.upto, self.upto[at] + most, "right")) - 1
            to = int(np.searchsorted(self.upto, goal))
            if to > 0 and to > at + 1 and goal - self.upto[to - 1] < self.upto[min(to, n)] - goal:
                to -= 1
            to = min(max(to, at), far)
            while to < far and not self._rest_fits(to, most, left - 1):
                to += 1
            at = to
            out.append(at)
        return [int(self.start[k]) if k < n else None for k in out]

    def _rest_fits(self, at: int, capacity: int, shards: int) -> bool:
        for _ in range(shards):
            at = int(np.searchsorted(self.upto, self.upto[at] + capacity, "right")) - 1
        return at >= len(self.size)


def _summary(groups: DataFrame, bits: int, within: list[int] | None = None, outer: int = 0) -> list[tuple[int, int, int, int]]:
    """First key, bytes, groups and bits of every range of ``bits`` bits, or of those within the ranges of ``outer`` bits."""
    if within is not None:
        groups = groups.filter(F.shiftright("key", 64 - outer).isin(within))
    found = groups.groupBy(F.shiftright("key", 64 - bits).alias("range")).agg(F.min("key").alias("start"), F.sum("size").alias("size"), F.count("*").alias("groups"))
    return [(r["start"], r["size"], r["groups"], bits) for r in found.collect()]


def minimax_cuts(groups: DataFrame, shards: int, first_bits: int = FIRST_BITS, more_bits: int = MORE_BITS) -> list[int | None]:
    """First key of each shard but shard 0, None for shards past the last group. ``groups`` has key (signed 64-bit) and size."""
    parts = sorted(_summary(groups, first_bits))
    while True:
        ranges = Ranges(*(np.array([p[k] for p in parts], np.int64) for k in range(3)))
        high, low = ranges.capacity(shards, False), ranges.capacity(shards, True)
        first, last = ranges.greedy(low, shards, False), ranges.greedy(high, shards, True)
        first += [first[-1] if first else 0] * (len(last) - len(first))
        touched = np.zeros(len(parts), bool)
        for a, b in zip(first, last):
            touched[max(int(np.searchsorted(ranges.upto, a, "right")) - 1, 0) : int(np.searchsorted(ranges.upto, b, "left"))] = True
        split = {k for k in np.flatnonzero(touched & (ranges.groups > 1)).tolist() if parts[k][3] < 64}
        if high == low or not split:
            return ranges.even_cuts(shards)
        finer = [p for k, p in enumerate(parts) if k not in split]
        for bits in sorted({parts[k][3] for k in split}):
            ids = [parts[k][0] >> (64 - bits) for k in sorted(split) if parts[k][3] == bits]
            for at in range(0, len(ids), 4000):
                finer += _summary(groups, min(64, bits + more_bits), ids[at : at + 4000], bits)
        parts = sorted(finer)


def assign(df: DataFrame, row_id: str = "doc_id", text: str = "text", *, shards: int = 40, overhead: int = 16) -> DataFrame:
    """``row_id, size, text_crc32, shard, slot`` for every row."""
    whole = F.coalesce(column(df, text), F.lit(""))
    plain = df.select(column(df, row_id).alias("id"), (F.octet_length(whole) + overhead).cast("bigint").alias("size"), F.crc32(whole).alias("text_crc32"), F.xxhash64(whole).alias("key"))
    rows = materialize(plain)
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("size")))
    cuts = [c for c in minimax_cuts(groups, shards) if c is not None]
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("key") >= F.lit(c)).cast("int")
    counters = max(1, rows.count() // SLOT_ROWS)
    counter = F.pmod(F.xxhash64("id", "key"), F.lit(counters).cast("bigint"))
    placed = rows.select("id", "size", "text_crc32", "key", shard.alias("shard"), counter.alias("counter"))
    counted = placed.groupBy("shard", "counter").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("counter")) - F.col("n")
    offsets = counted.select("shard", "counter", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "counter").orderBy("id", "key"))
    slotted = placed.withColumn("place", place).join(offsets, ["shard", "counter"])
    return slotted.select(F.col("id").alias(row_id), "size", "text_crc32", "shard", (F.col("before") + F.col("place") - 1).cast("bigint").alias("slot"))
