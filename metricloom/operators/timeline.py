"""Measures over time: periods, trend, change, season and a cautious projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom import scale
from metricloom.functions import dates, numbers
from metricloom.operators.common import Outcome, metric, metric_rows, refusals, stacked
from metricloom.operators.profile import _quoted, _types

MIN_PERIODS = 5
MIN_CYCLES = 2
MAX_PERIODS = 24
PARSED = 0.9
GRAINS = ("month", "quarter", "year")

PROJECT_PERIODS = 8
PROJECT_R2 = 0.6
PROJECT_REACH = 1 / 3


def moments(df: DataFrame, column: str) -> DataFrame | None:
    """Rows with their moment in ``_moment``; None when the column does not hold time."""
    kind = _types(df)[column]
    source = _quoted(column)
    if isinstance(kind, T.StringType):
        seen = df.agg(
            F.count(source).alias("n"), F.count_if(source.rlike(dates.QUARTER)).alias("q"), F.count(dates.parse_mixed(source)).alias("p")
        ).first()
        if not seen["n"]:
            return None
        if seen["q"] / seen["n"] >= PARSED:
            moment = dates.quarter_start(source)
        elif seen["p"] / seen["n"] >= PARSED:
            moment = dates.parse_mixed(source)
        else:
            return None
    else:
        if numbers.is_number_type(kind):
            good = source.between(1900, 2200) & (source % 1 == 0)
            seen = df.agg(F.count(source).alias("n"), F.count_if(good).alias("g")).first()
            if not seen["n"] or seen["n"] != seen["g"]:
                return None
        moment = dates.as_moment(source, kind)
    return df.withColumn("_moment", moment).filter("_moment IS NOT NULL")


def labelled(df: DataFrame, grain: str, moment: str = "_moment") -> DataFrame:
    period = dates.period_of(F.col(moment), grain)
    return df.withColumn("_p", period).select("*", "_p.label", "_p.ord", "_p.season", "_p.season_no").drop("_p")


def choose_grain(df: DataFrame, moment: str = "_moment") -> DataFrame:
    """One row: distinct periods per grain and the finest grain with at most 24 of them."""
    found = df.agg(*[F.countDistinct(dates.period_of(F.col(moment), g)["label"]).alias(f"{g}s") for g in GRAINS])
    grain = F.when(F.col("months") <= MAX_PERIODS, "month").when(F.col("quarters") <= MAX_PERIODS, "quarter").otherwise("year")
    return found.withColumn("grain", grain)


def period_table(df: DataFrame, measures: Sequence[str], grain: str) -> DataFrame:
    """``measure, label, ord, season, season_no, total, n, mean`` per period.

    One pass with partial aggregation; what remains is bounded by the calendar, so the
    windows of the operators below run over a few hundred rows per measure.
    """
    kinds = _types(df)
    aggs = [
        a for i, m in enumerate(measures) for x in [numbers.numeric(_quoted(m), kinds[m])]
        for a in (F.sum(x).alias(f"s{i}"), F.count(x).alias(f"n{i}"))
    ]
    grouped = labelled(df, grain).groupBy("label", "ord", "season", "season_no").agg(*aggs)
    rows = [F.struct(F.lit(m).alias("measure"), F.col(f"s{i}").alias("total"), F.col(f"n{i}").alias("n")) for i, m in enumerate(measures)]
    long = grouped.select("label", "ord", "season", "season_no", F.explode(F.array(*rows)).alias("r"))
    return long.select("r.measure", "label", "ord", "season", "season_no", "r.total", "r.n", (F.col("r.total") / F.col("r.n")).alias("mean")).filter("n > 0")


def _in_order() -> Window:
    return Window.partitionBy("measure").orderBy("ord")


def _first(placed: DataFrame, limit: int | None) -> DataFrame:
    return placed if limit is None else placed.filter(F.col("position") <= limit)


def period_means(periods: DataFrame, limit: int | None = None) -> DataFrame:
    """``measure, label, mean`` of the periods in time order, or of the first ``limit`` of them."""
    placed = periods.withColumn("position", F.row_number().over(_in_order()))
    return _first(placed, limit).select("measure", "position", "label", F.round("mean", 4).alias("mean"))


def trend(periods: DataFrame) -> DataFrame:
    """``measure, periods, rho``: rank correlation of the period mean with its position (>= 5 periods)."""
    ties = Window.partitionBy("measure", "mean")
    by_value = Window.partitionBy("measure").orderBy("mean")
    ranked = periods.select(
        "measure", F.row_number().over(_in_order()).alias("pos"), (F.rank().over(by_value) + (F.count("*").over(ties) - 1) / 2).alias("r")
    )
    rho = F.corr("pos", "r")
    out = ranked.groupBy("measure").agg(F.count("*").alias("periods"), rho.alias("rho"))
    return out.filter(F.col("periods") >= MIN_PERIODS).select("measure", "periods", F.when(~F.isnan("rho"), F.round("rho", 4)).alias("rho"))


def change(periods: DataFrame, limit: int | None = None) -> DataFrame:
    """``measure, label, change`` of each period against the one before."""
    placed = periods.withColumns({"position": F.row_number().over(_in_order()), "before": F.lag("mean").over(_in_order())})
    kept = _first(placed, limit).filter(F.col("before").isNotNull())
    return kept.select("measure", "position", "label", F.round(F.col("mean") - F.col("before"), 4).alias("change"))


def seasons(periods: DataFrame) -> DataFrame:
    """``measure, season, season_no, cycles, mean`` over rows, for seasons seen in at least two cycles."""
    return (
        periods.filter("season <> ''").groupBy("measure", "season", "season_no")
        .agg(F.countDistinct("ord").alias("cycles"), (F.sum("total") / F.sum("n")).alias("mean"))
        .filter(F.col("cycles") >= MIN_CYCLES)
    )


def season_edges(season: DataFrame) -> DataFrame:
    """``measure, edge, season_no, mean``: the highest and lowest season, ties to the first by name."""
    pick = F.struct("season_no", "mean")
    best = season.groupBy("measure").agg(
        F.min_by(pick, F.struct(-F.col("mean"), F.col("season"))).alias("peak"), F.min_by(pick, F.struct(F.col("mean"), F.col("season"))).alias("trough")
    )
    ends = F.array(*[F.struct(F.lit(e).alias("edge"), F.col(e).alias("v")) for e in ("peak", "trough")])
    return best.select("measure", F.explode(ends).alias("x")).select("measure", "x.edge", "x.v.season_no", "x.v.mean")


def measure(df: DataFrame, column: str, measures: Sequence[str], *, grain: str = "") -> Outcome:
    """Everything about ``measures`` along one time column, with refusals."""
    spark = df.sparkSession
    empty = metric_rows(spark.range(0), [metric("", F.lit(0.0))])
    rows = moments(df, column) if column in df.columns else None
    if rows is None:
        return Outcome(empty, refusals(spark, [("timeline", column, "the column does not hold time", None, PARSED)]))
    grain = grain or choose_grain(rows).first()["grain"]
    measures = [m for m in measures if m in df.columns]
    periods = period_table(rows, measures, grain).cache()
    total = labelled(rows.select("_moment"), grain).agg(F.countDistinct("label").alias("n")).first()["n"]
    seen = {
        r["measure"]: r for r in periods.groupBy("measure", "season").agg(F.count("*").alias("p"), F.countDistinct("ord").alias("c"))
        .groupBy("measure").agg(F.sum("p").alias("periods"), F.max("c").alias("cycles")).collect()  # one row per measure
    }
    refused = []
    if total < MIN_PERIODS:
        refused.append(("timeline", column, "too few periods to call a direction a trend", total, MIN_PERIODS))
    flat = {r["measure"] for r in trend(periods).filter("rho IS NULL").collect()}
    for m in measures:
        if m not in seen:
            refused.append(("timeline", m, "no numeric value to follow", 0, 1))
            continue
        if m in flat:
            refused.append(("timeline", m, "the value does not change, there is no trend", None, None))
        if grain != "year" and seen[m]["cycles"] < MIN_CYCLES:
            refused.append(("timeline", m, "only one cycle, nothing can be said about seasons", seen[m]["cycles"], MIN_CYCLES))
    season = seasons(periods)
    m, label = F.col("measure"), F.col("label")
    by = f".by.{column}."
    edge = F.col("edge")
    return Outcome(
        stacked([
            metric_rows(period_means(periods), [metric(F.concat(m, F.lit(by), label), F.col("mean"), measure=m, stat="mean", dim=column, grp=label, source="period mean")]),
            metric_rows(trend(periods), [metric(F.concat(m, F.lit(f".trend.with.{column}")), F.col("rho"), measure=m, stat="trend", dim=column, source=f"rank correlation over {grain}s")]),
            metric_rows(change(periods), [metric(F.concat(m, F.lit(f".change{by}"), label), F.col("change"), measure=m, stat="change", dim=column, grp=label, source="against the period before")]),
            metric_rows(season, [metric(F.concat(m, F.lit(".seasonal."), F.replace(F.col("season"), F.lit(" "), F.lit("_"))), F.col("mean"), measure=m, stat="seasonal", dim=column, grp=F.col("season"), source="season mean over rows")]),
            metric_rows(season_edges(season), [
                metric(F.concat(m, F.lit(".seasonal."), edge, F.lit("_number")), F.col("season_no"), measure=m, stat="seasonal_number", dim=column, grp=edge, source="season"),
                metric(F.concat(m, F.lit(".seasonal."), edge, F.lit("_value")), F.col("mean"), measure=m, stat="seasonal_value", dim=column, grp=edge, source="season")]),
        ]),
        refusals(spark, refused),
    )


def project(series: DataFrame, key: str, order: Sequence[str], value: str, ahead: int = 1) -> DataFrame:
    """A straight line carried ``ahead`` periods, as an interval: ``key, periods, low, high, r2, refusal``.

    Closed form from one aggregate per series; the residual spread follows from r2.
    """
    placed = scale.Sequenced(series.select(key, *order, F.col(value).cast("double").alias("_y")), [key], list(order)).with_position("_pos").rows()
    x = (F.col("_pos") - 1).cast("double")
    fit = placed.groupBy(key).agg(
        F.count("_y").alias("periods"), F.regr_slope("_y", x).alias("_b"), F.regr_intercept("_y", x).alias("_a"), F.regr_r2("_y", x).alias("_r2"),
        F.regr_syy("_y", x).alias("_syy"), F.min("_y").alias("_lo"), F.max("_y").alias("_hi"),
    )
    n = F.col("periods")
    reach = F.floor(n * F.lit(PROJECT_REACH))
    refusal = (
        F.when(n < PROJECT_PERIODS, "too few periods").when(F.lit(ahead < 1), "nothing to project")
        .when(F.lit(ahead) > reach, "too far ahead").when(F.col("_lo") == F.col("_hi"), "the series does not change")
        .when(F.col("_r2") < PROJECT_R2, "the periods do not follow a line")
    )
    centre = F.col("_b") * (n - 1 + ahead) + F.col("_a")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("_syy") * (1 - F.col("_r2"))) / (n - 1))
    shown = lambda c: F.when(F.col("refusal").isNull(), F.round(c, 4))
    return fit.withColumn("refusal", refusal).select(
        key, "periods", shown(centre - spread).alias("low"), shown(centre + spread).alias("high"), shown(F.col("_r2")).alias("r2"), "refusal"
    )


def series_in(metrics: DataFrame, smallest: int = PROJECT_PERIODS) -> DataFrame:
    """Period series inside a metric table: ``series, label, value`` where every group label is a period."""
    families = metrics.filter(F.col("grp").isNotNull() & F.col("dim").isNotNull()).withColumn("series", F.concat(F.concat_ws(".", "measure", "stat"), F.lit(" by "), F.col("dim")))
    is_period = F.col("grp").rlike(dates.PERIOD_LABEL)
    good = families.groupBy("series").agg(F.bool_and(is_period).alias("ok"), F.count("*").alias("n")).filter((F.col("ok")) & (F.col("n") >= smallest))
    return families.join(good.select("series"), "series", "left_semi").select("series", F.col("grp").alias("label"), "value")
