"""The metric set of a table: totals, summaries, category shares, breakdowns and rates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom import scale
from metricloom.functions import numbers, text
from metricloom.operators import counting
from metricloom.operators.common import metric, metric_rows, stacked
from metricloom.operators.profile import _as_text, _quoted, _types, numeric_columns, value_table
from metricloom.session import materialize

TOP_CATEGORIES = 20
MAX_BREAKDOWNS = 2000
MIN_GROUP_ROWS = 5
WIDE = 32  # measures from which matrix products beat one aggregate per measure

# Parts of a key that mark a headline statistic.
HEADLINE = ("rows.total", ".mean", ".median", ".share_pct", ".count", ".corr.", ".r2.", ".p_value", ".eta_sq", ".f_stat")
DETAIL = ".by."


def row_total(df: DataFrame) -> DataFrame:
    return metric_rows(
        df.agg(F.count("*").alias("n")),
        [metric("rows.total", F.col("n"), measure="rows", stat="total", unit="row", source="frame")],
    )


def column_metrics(df: DataFrame) -> DataFrame:
    """``<column>.distinct`` and ``<column>.null_pct`` of every column."""
    columns = df.columns
    sums = counting.unpivot(df, columns, lambda d, c: [_as_text(d, c).isNull().alias("missing")]).groupBy("at").agg(F.count("*").alias("rows"), F.count_if("missing").alias("nulls"))
    shape = counting.named(sums, columns).join(F.broadcast(counting.distinct_counts(df, columns)), "column")  # one row per column
    name = F.col("column")
    return metric_rows(shape, [
        metric(F.concat(name, F.lit(".distinct")), F.col("distinct"), measure=name, stat="distinct", unit="value", source=name),
        metric(F.concat(name, F.lit(".null_pct")), F.coalesce(F.try_divide(100.0 * F.col("nulls"), "rows"), F.lit(0.0)), measure=name, stat="null_pct", unit="%", source=name),
    ])


def summary_metrics(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """``sum, mean, median, min, max`` of numeric columns, read as they are stored (unreadable cells ignored).

    One pass in long form, so the plan does not grow with the number of columns. When the
    table is too long for a task to hold all values of a column, medians take the split way.
    """
    measures, kinds = list(measures), _types(df)
    entries = F.array(*[F.struct(F.lit(m).alias("column"), numbers.numeric(_quoted(m), kinds[m]).alias("x")) for m in measures])
    long = df.select(F.explode(entries).alias("e")).select("e.column", "e.x").filter("x IS NOT NULL")
    short = df.count() <= scale.group_limit(df)
    each = [F.sum("x").alias("sum"), F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max")]
    shape = long.groupBy("column").agg(*each, *([F.median("x").alias("median")] if short else []))
    if not short:
        medians = scale.percentiles(long, ["column"], "x", {"median": 0.5}, split=True)
        shape = shape.join(F.broadcast(medians), "column")  # one row per column
    name = F.col("column")
    return metric_rows(shape, [
        metric(F.concat(name, F.lit(f".{s}")), F.col(s), measure=name, stat=s, source=name)
        for s in ("sum", "mean", "median", "min", "max")
    ])


def flag_metrics(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Counts and shares of numeric columns with exactly two values."""
    columns = list(columns if columns is not None else df.columns)
    flags = [r["column"] for r in counting.distinct_counts(df, columns, counting.as_number, "d").filter("d = 2").collect()] if columns else []  # at most one per column
    if not flags:
        return metric_rows(df.sparkSession.range(0), [metric("", F.lit(0.0))])
    by_number = counting.named(counting.unpivot(df, flags, lambda d, c: [counting.as_number(d, c).alias("x")]).groupBy("at", "x").agg(F.count("*").alias("n")), flags)
    shape = by_number.groupBy("column").agg(F.sum("n").alias("rows"))
    # Two values per kept column: both sides are bounded by the table's width.
    kept = by_number.filter("x IS NOT NULL").join(F.broadcast(shape), "column")
    label = F.when(F.col("x") % 1 == 0, F.col("x").cast("bigint").cast("string")).otherwise(text.slug(F.col("x").cast("string")))
    name, key = F.col("column"), F.concat(F.col("column"), F.lit("."), label)
    return metric_rows(kept, [
        metric(F.concat(key, F.lit(".count")), F.col("n"), measure=name, stat="count", dim=name, grp=label, unit="row", source=name),
        metric(F.concat(key, F.lit(".share_pct")), 100.0 * F.col("n") / F.col("rows"), measure=name, stat="share_pct", dim=name, grp=label, unit="%", source=name),
    ])


def top_categories(counts: DataFrame, top: int = TOP_CATEGORIES) -> DataFrame:
    """``column, value, n, rank`` of the most common values, ties by name."""
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return (
        counts.filter("value IS NOT NULL").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    )


def category_metrics(counts: DataFrame, top: int = TOP_CATEGORIES) -> DataFrame:
    """Count and share of the most common values per dimension and how many were left out."""
    shape = counts.groupBy("column").agg(F.count("value").alias("d"), F.sum("n").alias("rows"))
    kept = top_categories(counts, top).join(F.broadcast(shape), "column")  # one row per column
    name, key = F.col("column"), F.concat(F.col("column"), F.lit("."), text.slug(F.col("value")))
    return metric_rows(kept, [
        metric(F.concat(key, F.lit(".count")), F.col("n"), measure=name, stat="count", dim=name, grp=F.col("value"), unit="row", source=name),
        metric(F.concat(key, F.lit(".share_pct")), 100.0 * F.col("n") / F.col("rows"), measure=name, stat="share_pct", dim=name, grp=F.col("value"), unit="%", source=name),
    ]).unionByName(metric_rows(shape.filter(F.col("d") > top), [
        metric(F.concat(name, F.lit(".categories_omitted")), F.col("d") - top, measure=name, stat="categories_omitted", unit="group", source=name),
    ]))


def _kept_values(df: DataFrame, dimensions: Sequence[str], counts: DataFrame, top: int) -> dict[str, list[str]]:
    """The kept categories per dimension in rank order: at most ``top`` per dimension."""
    found: dict[str, list[str]] = {d: [] for d in dimensions}
    for row in top_categories(counts, top).orderBy("column", "rank").collect():
        found[row["column"]].append(row["value"])
    return found


def _means_by_expand(df: DataFrame, kept: dict[str, list[str]], measures: list[str]) -> DataFrame:
    """``d, r, j, mean``: each row is repeated once per dimension with a kept value."""
    kinds = _types(df)
    entries = [F.when(_place(df, dim, values) > 0, F.struct(F.lit(i).alias("d"), _place(df, dim, values).alias("r"))) for i, (dim, values) in enumerate(kept.items())]
    spread = df.select(
        F.explode(F.array_compact(F.array(*entries))).alias("g"),
        *[numbers.numeric(_quoted(m), kinds[m]).alias(f"m{j}") for j, m in enumerate(measures)],
    )
    grouped = spread.groupBy("g.d", "g.r").agg(*[F.avg(f"m{j}").alias(f"m{j}") for j in range(len(measures))])
    cells = F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"m{j}").alias("mean")) for j in range(len(measures))])
    return grouped.select("d", "r", F.explode(cells).alias("c")).select("d", "r", "c.j", "c.mean")


def _means_by_product(df: DataFrame, kept: dict[str, list[str]], measures: list[str]) -> DataFrame:
    """The same for wide tables: per Arrow batch one matrix product of group indicators and
    measures per dimension; a task emits a single block of partial sums."""
    kinds = _types(df)
    sizes = [len(v) for v in kept.values()]
    coded = df.select(
        *[_place(df, dim, values).alias(f"c{i}") for i, (dim, values) in enumerate(kept.items())],
        *[numbers.numeric(_quoted(m), kinds[m]).alias(f"m{j}") for j, m in enumerate(measures)],
    )

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((k, len(measures))) for k in sizes]
        counts = [np.zeros((k, len(measures))) for k in sizes]
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
            x = np.column_stack(columns[len(sizes):])
            seen, endless = ~np.isnan(x), np.isinf(x)
            up, down = (x > 0) & endless, (x < 0) & endless
            x = np.where(seen & ~endless, x, 0.0)  # a product would turn one infinity into NaN for every group
            for i, k in enumerate(sizes):
                hit = (columns[i][:, None] == np.arange(1, k + 1)).astype(float)
                sums[i] += hit.T @ x
                counts[i] += hit.T @ seen
                if endless.any():
                    with np.errstate(invalid="ignore"):
                        sums[i] += np.where(hit.T @ up > 0, np.inf, 0.0) + np.where(hit.T @ down > 0, -np.inf, 0.0)
        for i, k in enumerate(sizes):
            r, j = np.nonzero(counts[i])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(r), i), pa.int32()), pa.array(r + 1, pa.int32()), pa.array(j, pa.int32()), pa.array(sums[i][r, j]), pa.array(counts[i][r, j])],
                names=["d", "r", "j", "s", "n"],
            )

    blocks = coded.mapInArrow(partial, "d int, r int, j int, s double, n double")
    return blocks.groupBy("d", "r", "j").agg((F.sum("s") / F.sum("n")).alias("mean"))


def _place(df: DataFrame, dim: str, values: list[str]) -> Column:
    """The rank of a row's category among the kept ones, 0 for the others."""
    if not values:
        return F.lit(0)
    ranks = F.create_map(*[x for i, v in enumerate(values, start=1) for x in (F.lit(v), F.lit(i))])
    return F.coalesce(F.try_element_at(ranks, _as_text(df, dim)), F.lit(0))


def breakdowns(
    df: DataFrame, dimensions: Sequence[str], measures: Sequence[str], *, top: int = TOP_CATEGORIES,
    limit: int = MAX_BREAKDOWNS, counts: DataFrame | None = None,
) -> DataFrame:
    """``<measure>.mean.by.<dim>.<value>`` for every kept category, and how many were skipped.

    One pass over the table whatever the number of columns. Only kept categories reach
    the aggregation, so what a task passes on is bounded by the table's width.
    """
    dimensions, measures = list(dimensions), sorted(measures)
    counts = value_table(df, dimensions) if counts is None else counts
    kept = _kept_values(df, dimensions, counts, top)
    means = (_means_by_expand if len(measures) <= WIDE else _means_by_product)(df, kept, measures).filter("mean IS NOT NULL")
    labels = [(i, r, dim, value) for i, (dim, values) in enumerate(kept.items()) for r, value in enumerate(values, start=1)]
    named = df.sparkSession.createDataFrame(labels, "d int, r int, dim string, value string")  # top x dimensions rows
    measure_of = F.array(*[F.lit(m) for m in measures])
    long = means.join(F.broadcast(named), ["d", "r"]).withColumn("measure", F.element_at(measure_of, F.col("j") + 1))
    # At most (dimensions x top x measures) cells, all aggregated: numbering them in one task is safe.
    placed = long.withColumn("_at", F.row_number().over(Window.orderBy("d", "r", "j")))
    key = F.concat("measure", F.lit(".mean.by."), "dim", F.lit("."), text.slug(F.col("value")))
    shown = metric_rows(placed.filter(F.col("_at") <= limit), [
        metric(key, F.col("mean"), measure=F.col("measure"), stat="mean", dim=F.col("dim"), grp=F.col("value"), source=F.concat_ws(" by ", "measure", "dim")),
    ])
    left_out = metric_rows(long.agg((F.count("*") - limit).alias("n")).filter("n > 0"), [
        metric("breakdowns_omitted", F.col("n"), measure="breakdowns", stat="omitted", unit="metric", source="limit"),
    ])
    return shown.unionByName(left_out)


def outcome_rates(
    df: DataFrame, dimensions: Sequence[str], *, top: int = TOP_CATEGORIES, counts: DataFrame | None = None
) -> DataFrame:
    """Share of each value of every two-valued dimension inside the groups of the others."""
    dimensions = list(dimensions)
    counts = value_table(df, dimensions) if counts is None else counts
    kept = _kept_values(df, dimensions, counts, max(top, 3))
    outcomes = [d for d in dimensions if len(kept[d]) == 2]
    pairs = []
    for outcome in outcomes:
        for group in dimensions:
            if group == outcome or not kept[group]:
                continue
            value = _as_text(df, group)
            pairs.append(F.when(
                value.isin(kept[group][:top]) & _quoted(outcome).isNotNull(),
                F.struct(F.lit(outcome).alias("outcome"), F.lit(group).alias("dim"), value.alias("grp"), _as_text(df, outcome).alias("value")),
            ))
    if not pairs:
        return metric_rows(df.sparkSession.range(0), [metric("", F.lit(0.0))])
    cells = df.select(F.explode(F.array_compact(F.array(*pairs))).alias("c")).groupBy("c.outcome", "c.dim", "c.grp", "c.value").agg(F.count("*").alias("n"))
    # Bounded now: two values per outcome, at most ``top`` groups per dimension.
    shares = cells.groupBy("outcome", "dim", "grp").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("value", "n"))).alias("by"))
    values = F.create_map(*[x for o in outcomes for x in (F.lit(o), F.array(*[F.lit(v) for v in sorted(kept[o])]))])
    rows = shares.filter(F.col("total") >= MIN_GROUP_ROWS).select("*", F.explode(values[F.col("outcome")]).alias("value"))
    share = 100.0 * F.coalesce(F.try_element_at("by", F.col("value")), F.lit(0)) / F.col("total")
    key = F.concat("outcome", F.lit("."), text.slug(F.col("value")), F.lit(".share_pct.by."), "dim", F.lit("."), text.slug(F.col("grp")))
    return metric_rows(rows, [
        metric(key, share, measure=F.concat_ws(".", "outcome", "value"), stat="share_pct", dim=F.col("dim"), grp=F.col("grp"), unit="%", source=F.concat_ws(" by ", "outcome", "dim")),
    ])


def compute_metrics(
    df: DataFrame, dimensions: Sequence[str] = (), measures: Sequence[str] = (), *, top: int = TOP_CATEGORIES, limit: int = MAX_BREAKDOWNS
) -> DataFrame:
    """The whole metric set of a table: the ``top`` categories of each dimension and ``limit`` breakdowns, the rest as counts of what was omitted."""
    dimensions = [d for d in dimensions if d in df.columns]
    numeric = [c for c in numeric_columns(df) if not measures or c in measures]
    of_dimensions = materialize(value_table(df, dimensions)) if dimensions else None  # used four times
    parts = [row_total(df), column_metrics(df)]
    if numeric:
        parts += [summary_metrics(df, numeric), flag_metrics(df, numeric)]
    if dimensions:
        parts.append(category_metrics(of_dimensions, top))
        if numeric:
            parts.append(breakdowns(df, dimensions, numeric, top=top, limit=limit, counts=of_dimensions))
        parts.append(outcome_rates(df, dimensions, top=top, counts=of_dimensions))
    return stacked(parts)


def rankings(metrics: DataFrame) -> DataFrame:
    """Top and bottom group of every family with at least two groups: ``family, position, grp, key, value``."""
    families = metrics.filter(F.col("grp").isNotNull()).withColumn("family", F.concat_ws("|", "measure", "stat", "dim"))
    item = F.struct("grp", "key", "value")
    best = families.groupBy("family").agg(
        F.countDistinct("grp").alias("groups"),
        # of equal values the first group by name wins on both ends
        F.min_by(item, F.struct(-F.col("value"), F.col("grp"))).alias("highest"),
        F.min_by(item, F.struct(F.col("value"), F.col("grp"))).alias("lowest"),
    ).filter("groups >= 2")
    ends = F.array(*[F.struct(F.lit(p).alias("position"), F.col(p).alias("e")) for p in ("highest", "lowest")])
    return best.select("family", F.explode(ends).alias("x")).select("family", "x.position", "x.e.grp", "x.e.key", "x.e.value")


def shortlist(metrics: DataFrame, wanted: Sequence[str] = (), budget: int = 40_000) -> tuple[DataFrame, DataFrame]:
    """Metrics that fit a size budget, most relevant first, and one row with the dropped count.

    Order: about a wanted column, then ``rows.total``, headline statistics, their
    breakdowns, the rest; then by key. The first metric is always kept.
    """
    head = F.substring_index("key", ".", 1)
    headline = F.lit(False)
    for mark in HEADLINE:
        headline = headline | F.contains(F.col("key"), F.lit(mark))
    detail = F.contains(F.col("key"), F.lit(DETAIL))
    kind = F.when(F.col("key") == "rows.total", 0).when(headline & ~detail, 1).when(headline, 2).otherwise(3)
    cost = F.length(F.concat_ws("|", "key", F.col("value").cast("string"), "unit", "source")) + 2
    ranked = metrics.select("*", F.when(head.isin(list(wanted)), 0).otherwise(1).alias("_asked"), kind.alias("_kind"), cost.cast("bigint").alias("_cost")).cache()
    running = scale.Sequenced(ranked, [], ["_asked", "_kind", "key"]).with_running_sum("_used", "_cost").with_position("_at").rows()
    keep = (F.col("_at") == 1) | (F.col("_used") <= budget)
    shown = running.filter(keep).select(*metrics.columns, F.col("_used").alias("used"))
    note = running.agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped"))
    return shown, note


def metric_families(metrics: DataFrame, smallest: int = 2) -> DataFrame:
    """Metrics per column: ``family, metrics``; columns with a single metric are pooled as loose ones."""
    head = F.substring_index("key", ".", 1)
    sizes = metrics.groupBy(head.alias("family")).agg(F.count("*").alias("metrics"))
    name = F.when(F.col("metrics") < smallest, "(loose)").otherwise(F.col("family"))
    return sizes.groupBy(name.alias("family")).agg(F.sum("metrics").alias("metrics"))


def _band(value: Column, edges: Sequence[float], names: Sequence[str]) -> Column:
    chain = F.when(value < edges[0], names[0])
    for edge, name in zip(edges[1:], names[1:]):
        chain = chain.when(value < edge, name)
    return chain.otherwise(names[-1])


def read_metrics(metrics: DataFrame) -> DataFrame:
    """A verbal band and a 0..100 position for every metric that has one: ``key, value, kind, level, position``.

    ``metrics`` needs ``key, measure, value``. Values on a column's own scale are placed
    inside that column's ``min`` and ``max`` metrics.
    """
    key, v = F.col("key"), F.col("value")
    leaf = F.substring_index(key, ".", -1)
    head = F.substring_index(key, ".by.", 1)
    stat = F.substring_index(head, ".", -1)
    column = F.when(F.contains(head, F.lit(".")), F.expr("substring(_head, 1, length(_head) - length(_stat) - 1)"))
    span = metrics.filter(F.col("key").endswith(".min") | F.col("key").endswith(".max")).select(
        F.expr("substring(key, 1, length(key) - 4)").alias("_column"), leaf.alias("_end"), v.alias("_v")
    ).groupBy("_column").agg(
        F.max(F.when(F.col("_end") == "min", F.col("_v"))).alias("_low"), F.max(F.when(F.col("_end") == "max", F.col("_v"))).alias("_high")
    ).filter("_high > _low")
    has = lambda part: F.contains(key, F.lit(part))
    kind = (
        F.when(leaf == "p_value", "p_value").when(leaf == "t_stat", "t_stat").when(leaf == "n", None)
        .when(has(".corr.with."), "correlation").when(has(".trend.with."), "trend")
        .when(has(".effect_size.by."), "effect_size").when(has(".eta_sq.by."), "eta_squared")
        .when(has(".r2.") | key.endswith(".r2"), "r_squared")
        .when(key.endswith(".share_pct") | has(".share_pct."), "share")
        .when((stat == "diff") & has(".by."), "gap").when(stat.isin("mean", "median", "min", "max"), "in_range")
    )
    read = (
        metrics.select(key, v, head.alias("_head"), stat.alias("_stat"), kind.alias("kind"))
        .withColumn("_column", column)
        .filter(F.col("kind").isNotNull())
        .join(span, "_column", "left")
        .filter(~F.col("kind").isin("gap", "in_range") | F.col("_low").isNotNull())
    )
    v = F.col("value")
    size = F.abs(v)

    def place(x: Column, low: Column, high: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * (x - low) / (high - low)))

    zero = F.lit(0.0)
    ratio = F.when(v > 1, v / 100.0).otherwise(v)
    inside = place(v, F.col("_low"), F.col("_high"))
    gap = F.round(F.least(F.lit(100.0), 100.0 * size / (F.col("_high") - F.col("_low"))), 1)
    cases = {
        "correlation": (_band(size, (0.1, 0.3, 0.5, 0.7), ("none", "weak", "moderate", "strong", "very strong")), place(v, F.lit(-1.0), F.lit(1.0))),
        "trend": (_band(size, (0.1, 0.3, 0.5, 0.7), ("none", "weak", "moderate", "strong", "very strong")), place(v, F.lit(-1.0), F.lit(1.0))),
        "effect_size": (_band(size, (0.2, 0.5, 0.8, 1.2), ("negligible", "small", "medium", "large", "very large")), place(size, zero, F.greatest(F.lit(2.0), size * 1.1))),
        "p_value": (_band(v, (0.001, 0.01, 0.05), ("very strong", "strong", "significant", "not enough evidence")), place(F.log10(F.greatest(v, F.lit(0.0001))), F.lit(-4.0), zero)),
        "t_stat": (_band(size, (1.96, 2.58, 3.29), ("like chance", "beyond 5 %", "beyond 1 %", "far beyond chance")), place(size, zero, F.greatest(F.lit(5.0), size * 1.1))),
        "eta_squared": (_band(v, (1.0, 6.0, 14.0), ("negligible", "small", "medium", "large")), place(v, zero, F.greatest(F.lit(30.0), v * 1.1))),
        "r_squared": (_band(ratio, (0.02, 0.13, 0.26), ("very little", "little", "moderate", "substantial")), place(ratio, zero, F.lit(1.0))),
        "share": (_band(v, (5.0, 20.0, 50.0, 80.0), ("very small", "small", "notable", "majority", "nearly all")), place(v, zero, F.lit(100.0))),
        "in_range": (_band(inside, (20.0, 40.0, 60.0, 80.0), ("near lowest", "below middle", "around middle", "above middle", "near highest")), inside),
        "gap": (_band(gap, (5.0, 15.0, 30.0), ("very small", "small", "notable", "large")), gap),
    }
    level = position = None
    for name, (band, at) in cases.items():
        hit = F.col("kind") == name
        level = F.when(hit, band) if level is None else level.when(hit, band)
        position = F.when(hit, at) if position is None else position.when(hit, at)
    return read.select("key", "value", "kind", level.alias("level"), F.round(position, 2).alias("position"))
