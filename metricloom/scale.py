"""Ordered and rank-based computations that survive a hot key.

A plain window sends every row of a key to one task. That is the best plan while
each key is small, and the worst when a single key holds a third of the table.
The helpers here measure the largest key first. Below the limit they use the plain
window; above it the rows are range-partitioned by (key, order), so that a hot key
spans many blocks, each block is windowed on its own, and the few values that cross
a block boundary are carried over by a join whose size is bounded by the number of
blocks. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.session import materialize

#: Rows of one key that a single task may hold; above it the key is split.
GROUP_LIMIT_CONF = "metricloom.groupRowLimit"
GROUP_LIMIT_DEFAULT = 1_000_000

BLOCK = "_block"


def group_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(GROUP_LIMIT_CONF, str(GROUP_LIMIT_DEFAULT)))


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the biggest key (map-side combined, reads only the key columns)."""
    counted = df.groupBy(*keys).count() if keys else df.select(F.count("*").alias("count"))
    return counted.agg(F.max("count")).first()[0] or 0


class Sequenced:
    """Rows of each key in a total order.

    ``order`` must be unique inside a key (add the row id as last order column).
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], *, split: bool | None = None):
        self.keys = list(keys)
        self.order = list(order)
        self.split = largest_group(df, self.keys) > group_limit(df) if split is None else split
        if self.split:
            ranged = df.repartitionByRange(*self.keys, *self.order)
            df = materialize(ranged.withColumn(BLOCK, F.spark_partition_id()))
        self.df = df

    @property
    def _window(self) -> Window:
        keys = [*self.keys, BLOCK] if self.split else self.keys
        return Window.partitionBy(*keys).orderBy(*self.order)

    @property
    def _blocks(self) -> Window:
        return Window.partitionBy(*self.keys).orderBy(BLOCK)

    def _carry(self, df: DataFrame, per_block: DataFrame) -> DataFrame:
        """Attach one row per (key, block). Only keys that continue past a block are
        kept, so the joined side never has more rows than there are blocks."""
        names = [*self.keys, BLOCK]
        renamed = per_block.select(*[F.col(n).alias(f"_r_{n}") for n in names], *[c for c in per_block.columns if c not in names])
        same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_r_{n}")) for n in names])
        return df.join(F.broadcast(renamed), same, "left").drop(*[f"_r_{n}" for n in names])

    def with_next(self, columns: dict[str, str]) -> "Sequenced":
        """Add, for each ``new: old``, the value of ``old`` in the following row of the key."""
        out = self.df
        if not self.split:
            for new, old in columns.items():
                out = out.withColumn(new, F.lead(old).over(self._window))
            return self._replace(out)
        picked = F.struct(*[F.col(old).alias(new) for new, old in columns.items()])
        heads = (
            self.df.groupBy(*self.keys, BLOCK)
            .agg(F.min_by(picked, F.struct(*self.order)).alias("_head"))
            .withColumn("_follow", F.lead("_head").over(self._blocks))
            .filter(F.col("_follow").isNotNull())
            .drop("_head")
        )
        out = self._carry(out.withColumn("_ahead", F.lead(picked).over(self._window)), heads)
        ahead = F.coalesce("_ahead", "_follow")
        for new in columns:
            out = out.withColumn(new, ahead[new])
        return self._replace(out.drop("_ahead", "_follow"))

    def _running(self, name: str, in_block: Column, total: Column) -> "Sequenced":
        out = self.df.withColumn(name, in_block)
        if not self.split:
            return self._replace(out)
        before = (
            self.df.groupBy(*self.keys, BLOCK)
            .agg(total.alias("_total"))
            .withColumn("_before", F.sum("_total").over(self._blocks.rowsBetween(Window.unboundedPreceding, -1)))
            .filter(F.col("_before").isNotNull())
            .drop("_total")
        )
        out = self._carry(out, before)
        return self._replace(out.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_before"))

    def with_position(self, name: str) -> "Sequenced":
        """Add the 1-based position of each row inside its key."""
        return self._running(name, F.row_number().over(self._window).cast("bigint"), F.count("*"))

    def with_running_sum(self, name: str, amount: str) -> "Sequenced":
        """Add the sum of ``amount`` up to and including each row of the key."""
        window = self._window.rowsBetween(Window.unboundedPreceding, 0)
        return self._running(name, F.sum(amount).over(window), F.sum(amount))

    def _replace(self, df: DataFrame) -> "Sequenced":
        again = object.__new__(Sequenced)
        again.keys, again.order, again.split, again.df = self.keys, self.order, self.split, df
        return again

    def rows(self) -> DataFrame:
        return self.df.drop(BLOCK) if self.split else self.df


def value_counts(df: DataFrame, keys: Sequence[str], value: str, count: str = "n") -> DataFrame:
    return df.groupBy(*keys, value).agg(F.count("*").alias(count))


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    shares: dict[str, float],
    *,
    weight: str | None = None,
    split: bool | None = None,
) -> DataFrame:
    """Exact linear-interpolation percentiles per key: one column per ``name: share``.

    ``weight`` counts how often each row's value occurs. Small keys use the built-in
    aggregate. For large ones the values are counted first, their running count is
    taken over split blocks, and the two neighbours of each wanted rank are picked, so
    no task ever holds all values of a key.
    """
    weighted = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    present = df.select(*keys, F.col(value).cast("double").alias("_v"), weighted.alias("_w"))
    present = present.filter(F.col("_v").isNotNull())
    if split is None:
        split = largest_group(present, keys) > group_limit(df)
    if not split:
        wanted = F.percentile("_v", F.array(*[F.lit(float(s)) for s in shares.values()]), F.col("_w"))
        return (
            present.groupBy(*keys)
            .agg(wanted.alias("_p"))
            .select(*keys, *[F.col("_p")[i].alias(n) for i, n in enumerate(shares)])
        )
    counted = present.groupBy(*keys, "_v").agg(F.sum("_w").alias("_n"))
    running = Sequenced(counted, keys, ["_v"], split=True).with_running_sum("_upto", "_n").rows()
    totals = counted.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    if keys:
        totals = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_total")
        same = reduce(lambda a, b: a & b, [running[k].eqNullSafe(totals[f"_k_{k}"]) for k in keys])
        ranked = running.join(totals, same)
    else:
        ranked = running.withColumn("_total", F.lit(totals.first()[0]))
    picks = []
    first = F.col("_upto") - F.col("_n")
    for name, share in shares.items():
        rank = F.lit(float(share)) * (F.col("_total") - 1)
        for side, at in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            inside = (first <= at) & (at < F.col("_upto"))
            picks.append(F.max(F.when(inside, F.col("_v"))).alias(f"_{side}_{name}"))
        picks.append(F.max(rank - F.floor(rank)).alias(f"_part_{name}"))
    picked = ranked.groupBy(*keys).agg(*picks)
    between = [
        F.col(f"_lo_{n}") + F.col(f"_part_{n}") * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) for n in shares
    ]
    return picked.select(*keys, *[c.alias(n) for c, n in zip(between, shares)])


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str, *, split: bool | None = None, keep: str | None = None) -> DataFrame:
    """Average rank of every distinct ``value`` inside its key: ``keys, value, name``, and under ``keep`` how often it occurs.

    Ranking happens on value counts, not on the raw rows.
    """
    counted = value_counts(df.filter(F.col(value).isNotNull()), keys, value, "_n")
    ordered = Sequenced(counted, keys, [value], split=split).with_running_sum("_upto", "_n").rows()
    count = [F.col("_n").alias(keep)] if keep else []
    return ordered.select(*keys, value, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name), *count)
