"""Named values, changes and ratios between points of a long or wide table."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions import dates, numbers
from metricloom.operators.common import stacked
from metricloom.operators.profile import _quoted, _types


def _number(df: DataFrame, name: str):
    return numbers.numeric(_quoted(name), _types(df)[name])


def pivot_items(
    df: DataFrame, label: str, items: Sequence, value: str, axis: Sequence[str], ratio: tuple | None = None
) -> DataFrame:
    """One column per named item, summed per axis point, and optionally the ratio of two of them.

    The items are declared, so the pivot needs no extra pass and only their rows are read.
    """
    wanted = df.filter(_quoted(label).isin(list(items)))
    x = _number(df, value)
    sums = [F.sum(F.when(_quoted(label) == F.lit(i), x)).alias(str(i)) for i in items]
    out = wanted.groupBy(*[_quoted(a) for a in axis]).agg(*sums)
    if ratio is None:
        return out
    top, bottom = ratio
    quotient = F.try_divide(_quoted(str(top)), F.when(_quoted(str(bottom)) != 0, _quoted(str(bottom))))
    return out.withColumn(f"{top} / {bottom}", quotient)


def constant_attributes(df: DataFrame, label: str, items: Sequence, columns: Sequence[str]) -> list[str]:
    """Columns with one value per item: they describe the item and are not grouped by."""
    rows = df.filter(_quoted(label).isin(list(items)))
    checks = [
        a for i, c in enumerate(columns)
        for a in (F.min(_quoted(c)).alias(f"l{i}"), F.max(_quoted(c)).alias(f"h{i}"), F.count(_quoted(c)).alias(f"c{i}"))
    ]
    per_item = rows.groupBy(_quoted(label)).agg(F.count("*").alias("_n"), *checks)  # one row per named item
    flags = per_item.agg(*[
        F.bool_and((F.col(f"c{i}") == 0) | ((F.col(f"c{i}") == F.col("_n")) & (F.col(f"l{i}") == F.col(f"h{i}")))).alias(f"k{i}") for i in range(len(columns))
    ]).first()
    return [c for i, c in enumerate(columns) if flags[f"k{i}"]]


def named_points(
    df: DataFrame, axis: str, labels: Sequence, measures: Sequence[str], filters: Mapping[str, Sequence] | None = None, *, use_mean: bool = False
) -> DataFrame:
    """``measure, filter, label, stat, value, rows`` at each named axis point and filter combination.

    A single row gives its value; several give their sum (or mean on request). All combinations
    of filter values are computed in one pass.
    """
    filters = dict(filters or {})
    combos = list(itertools.product(*[[(c, v) for v in vs] for c, vs in filters.items()]))
    rows = df.filter(_quoted(axis).isin(list(labels)))
    tags = []
    for combo in combos:
        hit = F.lit(True)
        for c, v in combo:
            hit = hit & (_quoted(c) == F.lit(v))
        tags.append(F.when(hit, F.lit(", ".join(f"{c} = {v}" for c, v in combo))))
    tagged = rows.withColumn("filter", F.explode(F.array_compact(F.array(*tags))))
    parts = []
    for m in measures:
        x = _number(df, m)
        found = tagged.groupBy("filter", _quoted(axis).alias("label")).agg(F.count(x).alias("rows"), F.sum(x).alias("s"), F.avg(x).alias("a"))
        many = F.when(F.lit(use_mean), F.col("a")).otherwise(F.col("s"))
        stat = F.when(F.col("rows") == 1, "value").otherwise("mean" if use_mean else "sum")
        parts.append(found.filter("rows > 0").select(F.lit(m).alias("measure"), "filter", "label", stat.alias("stat"), F.when(F.col("rows") == 1, F.col("s")).otherwise(many).alias("value"), "rows"))
    return stacked(parts)


def changes(points: DataFrame, keys: Sequence[str], label: str, value: str, *, by_time: bool = True, order: Sequence | None = None) -> DataFrame:
    """Next minus previous point in time order (or in a declared order) with the percentage.

    ``points`` holds named axis labels only, so a key has few rows.
    """
    if by_time:
        place = dates.period_key(F.col(label).cast("string"))
    else:
        place = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(label))
    window = Window.partitionBy(*keys).orderBy("_place", label)
    before = F.lag(value).over(window)
    out = points.withColumn("_place", place).withColumn("before", before).filter(F.col("before").isNotNull())
    diff = F.col(value) - F.col("before")
    pct = F.when(F.col("before") != 0, diff / F.abs("before") * 100)
    return out.select(*keys, label, F.round(diff, 4).alias("change"), F.round(pct, 4).alias("pct_change"))


def ratio_points(df: DataFrame, label: str, top, bottom, value: str, axis: str) -> tuple[DataFrame, DataFrame]:
    """Ratio of two items of a long table at every axis point, and the points where it cannot be computed."""
    wide = pivot_items(df, label, [top, bottom], value, [axis], (top, bottom))
    return _ratio(wide, axis, str(top), str(bottom))


def wide_ratio(df: DataFrame, top: str, bottom: str, axis: str) -> tuple[DataFrame, DataFrame]:
    """Ratio of two columns of a wide table at every axis point."""
    wide = df.groupBy(_quoted(axis)).agg(F.sum(_number(df, top)).alias(top), F.sum(_number(df, bottom)).alias(bottom))
    return _ratio(wide, axis, top, bottom)


def _ratio(wide: DataFrame, axis: str, top: str, bottom: str) -> tuple[DataFrame, DataFrame]:
    ratio = F.try_divide(_quoted(top), F.when(_quoted(bottom) != 0, _quoted(bottom)))
    found = wide.select(_quoted(axis).alias("label"), ratio.alias("ratio"))
    good = found.filter("ratio IS NOT NULL").select("label", F.round("ratio", 4).alias("ratio"), F.round(F.col("ratio") * 100, 4).alias("ratio_pct"))
    refused = found.filter("ratio IS NULL").select(F.lit("ratio").alias("op"), F.col("label").cast("string").alias("subject"), F.lit("a number is missing or the denominator is zero").alias("reason"))
    return good, refused
