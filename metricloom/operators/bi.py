"""Drag-and-drop grouped queries and the data behind charts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom import scale
from metricloom.functions import numbers
from metricloom.operators.profile import _quoted, _types

MAX_CATEGORIES = 60
MAX_POINTS = 1000
MAX_SERIES = 8
MAX_SCATTER = 5000
MAX_VALUES = 200
MIN_BOX_POINTS = 5
MAX_BOXES = 25
WHOLE_TOLERANCE = 1.0
# Labels of the folded rest and of an empty cell.
OTHER = "Khác"
EMPTY = "(trống)"

AGGREGATIONS = ("sum", "mean", "median", "min", "max", "count", "count_distinct")
NUMERIC_ONLY = ("sum", "mean", "median", "min", "max")


class BiError(ValueError):
    """A combination that cannot be computed, with the reason."""


@dataclass(frozen=True)
class Filter:
    field: str
    values: tuple[str, ...] | None = None
    min: float | None = None
    max: float | None = None


@dataclass(frozen=True)
class BiQuery:
    x: str | None = None
    y: str | None = None
    aggregation: str = "mean"
    color: str | None = None
    filters: tuple[Filter, ...] = field(default=())
    top: int | None = None


Fields = dict[str, tuple[str, str]]  # column -> (role, kind)


def fields_of(schema: DataFrame) -> Fields:
    """The result of ``profile.bi_fields`` as a lookup (one entry per column)."""
    return {r["column"]: (r["role"], r["kind"]) for r in schema.collect()}


def _number(df: DataFrame, name: str) -> Column:
    return numbers.numeric(_quoted(name), _types(df)[name])


def _label(df: DataFrame, name: str) -> Column:
    return F.coalesce(_quoted(name).cast("string"), F.lit(EMPTY))


def _role(fields: Fields, name: str) -> str:
    if name not in fields:
        raise BiError(f"the table has no column '{name}'")
    return fields[name][0]


def apply_filters(df: DataFrame, filters: Sequence[Filter], fields: Fields) -> DataFrame:
    """IN lists on labels for dimensions, ranges for measures; an empty list filters nothing.

    A plain column is compared unwrapped where possible, so the condition reaches the scan.
    """
    out = df
    for item in filters:
        role = _role(fields, item.field)
        if item.values is not None or role == "dimension":
            chosen = [str(v) for v in item.values or ()]
            if not chosen:
                continue
            text = _quoted(item.field).cast("string")
            hit = text.isin([v for v in chosen if v != EMPTY])
            out = out.filter(hit | _label(df, item.field).isin(chosen) if EMPTY in chosen else hit)
            continue
        number = _number(df, item.field)
        if item.min is not None:
            out = out.filter(number >= item.min)
        if item.max is not None:
            out = out.filter(number <= item.max)
    return out


def aggregate(df: DataFrame, query: BiQuery, fields: Fields) -> Column:
    if query.aggregation not in AGGREGATIONS:
        raise BiError(f"no aggregation '{query.aggregation}'")
    if query.y is None:
        return F.count("*")
    role = _role(fields, query.y)
    if query.aggregation in NUMERIC_ONLY and role != "measure":
        raise BiError(f"'{query.y}' is not a number, it can only be counted")
    target = _number(df, query.y) if role == "measure" else _quoted(query.y)
    return {
        "sum": F.sum, "mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "count": F.count, "count_distinct": F.countDistinct,
    }[query.aggregation](target)


def grouped(df: DataFrame, keys: Sequence[str], query: BiQuery, fields: Fields, name: str = "value") -> DataFrame:
    """``groupBy(keys)`` with the query's aggregate. A median of large groups takes the exact split way."""
    if query.y is not None and query.aggregation == "median":
        aggregate(df, query, fields)
        rows = df.withColumn("_y", _number(df, query.y))
        found = scale.percentiles(rows, keys, "_y", {name: 0.5})
        groups = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
        if not keys:
            return found
        same = None
        for k in keys:
            one = groups[k].eqNullSafe(found[k])
            same = one if same is None else same & one
        return groups.join(found, same, "left").select(*[groups[k] for k in keys], name)
    return df.groupBy(*keys).agg(aggregate(df, query, fields).alias(name))


def series_names(df: DataFrame, color: str) -> tuple[list[str], bool]:
    """The busiest legend labels, and whether the rest is folded (at most nine labels are read)."""
    label = _label(df, color)
    top = df.groupBy(label.alias("s")).count().orderBy(F.desc("count"), "s").limit(MAX_SERIES + 1).collect()
    names = [r["s"] for r in top]
    return (names, False) if len(names) <= MAX_SERIES else ([*names[: MAX_SERIES - 1], OTHER], True)


def _folded(label: Column, kept: Sequence[str]) -> Column:
    return F.when(label.isin(list(kept)), label).otherwise(OTHER)


@dataclass
class BiResult:
    kind: str
    cells: DataFrame  # x, series, value, position
    rows_used: int
    dropped: int
    other_series: bool = False
    folded_x: bool = False
    correlation: float | None = None
    pairs: int | None = None


def run_query(df: DataFrame, query: BiQuery, fields: Fields) -> BiResult:
    """The cells of a chart: group by X and legend, fold what does not fit, order and cut."""
    x, color = query.x, query.color
    if color is not None and _role(fields, color) != "dimension":
        raise BiError(f"the legend takes a dimension; '{color}' is a measure")
    if x is not None and _role(fields, x) == "measure":
        return scatter(df, query, fields)
    if x is None and color is not None:
        x, color = color, None
    if x is None and query.y is None:
        raise BiError("put at least one column on an axis")
    aggregate(df, query, fields)
    rows = apply_filters(df, query.filters, fields)
    other = folded = False
    series = F.lit(query.y or "rows")
    if color is not None:
        names, other = series_names(rows, color)
        series = _folded(_label(rows, color), names[:-1]) if other else _label(rows, color)
    at = F.lit(None).cast("string") if x is None else _quoted(x)
    if x is not None and query.top is not None:
        at = _label(rows, x)
        ranked = grouped(rows.withColumn("_k", at), ["_k"], query, fields, "_v")
        best = ranked.orderBy(F.desc_nulls_last("_v"), "_k").limit(query.top + 1).collect()  # at most 51 labels
        if len(best) > query.top:
            at = _folded(at, [r["_k"] for r in best[: query.top - 1]])
            folded = True
    keyed = rows.withColumns({"_x": at, "_series": series})
    cells = grouped(keyed, ["_x", "_series"], query, fields).select(F.col("_x").alias("x"), F.col("_series").alias("series"), "value")
    kind = fields[x][1] if x is not None else ""
    shaped, dropped = shape(cells, text_axis=kind == "text" or folded, folded=folded)
    used = rows.count()
    return BiResult("single" if x is None else "line" if kind == "date" else "bar", shaped, used, dropped, other, folded)


def shape(cells: DataFrame, *, text_axis: bool, folded: bool = False) -> tuple[DataFrame, int]:
    """Order the categories and cut: by total for text (60), ascending otherwise (1000).

    Adds ``position``; returns the number of categories left out. The cut is a top-k,
    so only the kept categories meet in one task.
    """
    totals = cells.groupBy("x").agg(F.sum("value").alias("_total"))
    limit = MAX_CATEGORIES if text_axis else MAX_POINTS
    last = (F.col("x").eqNullSafe(F.lit(OTHER)) if folded else F.lit(False)).cast("int")
    order = [last, F.desc_nulls_last("_total"), F.asc_nulls_last("x")] if text_axis else [F.asc_nulls_last("x")]
    kept = totals.orderBy(*order).limit(limit)
    place = kept.withColumn("position", F.row_number().over(Window.orderBy(*order)))  # at most 1000 rows
    place = place.select(F.col("x").alias("_kx"), "position")
    shaped = cells.join(F.broadcast(place), F.col("x").eqNullSafe(F.col("_kx"))).drop("_kx")
    return shaped, max(0, totals.count() - limit)


def scatter(df: DataFrame, query: BiQuery, fields: Fields) -> BiResult:
    """Pairs of two measures: the correlation over all of them and at most 5000 points.

    The points are the ones with the smallest hash of their row, so the sample does not
    depend on partitioning.
    """
    if query.y is None or _role(fields, query.y) != "measure":
        raise BiError("a measure on X needs a measure on Y: two numbers make a scatter plot")
    rows = apply_filters(df, query.filters, fields)
    pairs = rows.withColumns({"_px": _number(rows, query.x), "_py": _number(rows, query.y)}).filter("_px IS NOT NULL AND _py IS NOT NULL")
    seen = pairs.agg(F.count("*").alias("n"), F.corr("_px", "_py").alias("r")).first()
    other = False
    series = F.lit(query.y)
    if query.color is not None:
        names, other = series_names(pairs, query.color)
        series = _folded(_label(pairs, query.color), names[:-1]) if other else _label(pairs, query.color)
    token = F.xxhash64(F.lit(7), *[_quoted(c) for c in df.columns])
    points = pairs.select(F.col("_px").alias("x"), F.col("_py").alias("value"), series.alias("series"), token.alias("_h"))
    if seen["n"] > MAX_SCATTER:
        points = points.orderBy("_h", "x", "value").limit(MAX_SCATTER)
    return BiResult("scatter", points.drop("_h"), rows.count(), 0, other, False, seen["r"], seen["n"])


def field_values(df: DataFrame, name: str, fields: Fields, limit: int = MAX_VALUES) -> tuple[DataFrame, bool]:
    """What a filter can choose from: the most common labels, or the range of a measure."""
    if _role(fields, name) == "measure":
        number = _number(df, name)
        return df.agg(F.min(number).alias("min"), F.max(number).alias("max")), False
    counted = df.groupBy(_label(df, name).alias("value")).agg(F.count("*").alias("count"))
    top = counted.orderBy(F.desc("count"), "value").limit(limit)
    return top, counted.limit(limit + 1).count() > limit


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    return scale.Sequenced(df, list(keys), list(order)).with_running_sum(name, value).rows()


def waterfall(df: DataFrame, position: str, label: str, value: str) -> DataFrame:
    """Running total as chart steps: ``position, label, base, up, down, total`` and a closing total row."""
    steps = df.select(F.col(position).cast("bigint").alias("position"), F.col(label).cast("string").alias("label"), F.coalesce(value, F.lit(0.0)).alias("change"))
    run = running_totals(steps, [], ["position"], "change", "after")
    change, after = F.col("change"), F.col("after")
    rows = run.select(
        "position", "label", F.least(after - change, after).alias("base"), F.when(change > 0, change).alias("up"),
        F.when(change < 0, -change).alias("down"), F.lit(None).cast("double").alias("total"),
    )
    closing = steps.agg((F.max("position") + 1).alias("position"), F.sum("change").alias("total")).select(
        "position", F.lit("Tổng").alias("label"), F.lit(0.0).alias("base"), F.lit(None).cast("double").alias("up"), F.lit(None).cast("double").alias("down"), "total"
    )
    return rows.unionByName(closing)


def matrix(cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Chart cells as a table with, per cell, its sign and its size against the largest of its column."""
    largest = cells.groupBy("series").agg(F.max(F.abs("value")).alias("largest"))
    toned = cells.filter(F.col("series").isin(list(columns))).join(F.broadcast(largest.filter(F.col("series").isin(list(columns)))), "series")
    blank = F.col("value").isNull() | (F.col("value") == 0) | (F.col("largest") <= 0)
    sign = F.when(blank, "none").when(F.col("value") > 0, "pos").otherwise("neg")
    strength = F.when(blank, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.abs("value") / F.col("largest")))
    return toned.select("x", "series", "value", sign.alias("sign"), F.round(strength, 4).alias("strength"))


def stacked_shares(cells: DataFrame) -> DataFrame:
    """Each cell as a percentage of its category."""
    totals = cells.groupBy("x").agg(F.sum("value").alias("_t")).withColumnRenamed("x", "_x")
    share = F.try_divide(100.0 * F.col("value"), F.col("_t"))
    return cells.join(totals, F.col("x").eqNullSafe(F.col("_x"))).select("x", "series", F.round(share, 4).alias("share_pct"))


def grouped_bars(df: DataFrame, group: str, measures: Sequence[str]) -> DataFrame:
    kinds = _types(df)
    return df.filter(_quoted(group).isNotNull()).groupBy(_quoted(group).cast("string").alias("grp")).agg(
        *[F.round(F.avg(numbers.numeric(_quoted(m), kinds[m])), 4).alias(m) for m in measures]
    )


def box_data(df: DataFrame, group: str, value: str) -> DataFrame:
    """Five-number summaries of the groups with at least 5 points; the 25 first by name are drawn."""
    rows = df.select(_quoted(group).cast("string").alias("grp"), _number(df, value).alias("v")).filter("grp IS NOT NULL AND v IS NOT NULL")
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_BOX_POINTS).orderBy("grp").limit(MAX_BOXES)
    kept = rows.join(F.broadcast(sizes.select("grp")), "grp", "left_semi")  # at most 25 groups
    shares = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}
    boxes = scale.percentiles(kept, ["grp"], "v", shares)
    return boxes.join(F.broadcast(sizes), "grp").select("grp", "n", *[F.round(c, 4).alias(c) for c in shares])


def line_data(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Points in time order (a range-partitioned sort)."""
    return df.select(_quoted(ts).alias("ts"), _number(df, value).alias("value")).filter("ts IS NOT NULL AND value IS NOT NULL").orderBy("ts")


def chart_tests(series: DataFrame) -> DataFrame:
    """Per series of ``series, label, value``: do the slices make a whole, are the labels periods."""
    from metricloom.functions.dates import PERIOD_LABEL

    return series.groupBy("series").agg(
        F.count("*").alias("points"), F.round(F.sum("value"), 4).alias("total"),
        (F.abs(F.sum("value") - 100.0) <= WHOLE_TOLERANCE).alias("is_whole"), F.bool_and(F.col("label").rlike(PERIOD_LABEL)).alias("is_timeline"),
    )
