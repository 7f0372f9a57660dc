"""Lexicographic order of whole paths without a path in one cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom import scale
from metricloom.session import materialize


def _placed(blocks: DataFrame) -> DataFrame:
    """Replace each (``_left``, ``_right``) by its place among the different pairs."""
    stored = materialize(blocks)
    pairs = stored.select("_left", "_right").distinct()
    spots = scale.Sequenced(pairs, [], ["_left", "_right"]).with_position("place").rows().select("_left", "_right", "place")
    return stored.join(spots, ["_left", "_right"]).drop("_left", "_right")


def lexical_places(steps: DataFrame, key: str, at: str, step: str) -> DataFrame:
    """``key, place``: the place of each path among all paths, equal paths sharing one.

    ``steps`` has one row per (key, at); positions of a key start at the same number for all keys and have no gaps. Neighbouring
    blocks of steps are replaced by the place of the pair until one block is left, so that the rows halve with each
    round and the rounds grow with the logarithm of the longest path. A missing second half counts as 0, before every
    place: a path stands before its continuations. No steps give no rows.
    """
    first, last = steps.agg(F.min(at), F.max(at)).first()
    width = 1 if first is None else last - first + 1
    start = F.col(at) - F.lit(0 if first is None else first)
    level = _placed(steps.select(key, start.cast("bigint").alias("_block"), F.col(step).alias("_left"), F.lit(0).alias("_right")))
    second = F.col("_block") % 2 == 1
    while width > 1:
        level = _placed(level.groupBy(key, F.shiftright("_block", 1).alias("_half")).agg(
            F.max(F.when(~second, F.col("place"))).alias("_left"),
            F.coalesce(F.max(F.when(second, F.col("place"))), F.lit(0)).alias("_right"),
        ).withColumnRenamed("_half", "_block"))
        width = (width + 1) // 2
    return level.select(key, "place")
