"""Case attributes and the gap in waiting time between two cohorts of cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions import dates, text
from metricloom.operators import process
from metricloom.operators.common import Outcome, metric, metric_rows, refusals, stacked
from metricloom.operators.process import ACTIVITY, CASE, MOMENT, EventLog
from metricloom.operators.profile import value_table

MIN_COHORT = 15
MAX_VALUES = 25
TOP_STEPS = 8


def case_attributes(log: EventLog) -> DataFrame:
    """Columns that never change inside a case and have 2..25 values: ``column, distinct``."""
    roles = {log.case, log.activity, log.ts, log.resource, log.row_id}
    names = sorted(c for c in log.df.columns if c not in roles)
    per_case = log.df.groupBy(log.case).agg(
        F.count("*").alias("_n"),
        *[f(F.col(f"`{c}`")).alias(f"{a}{i}") for i, c in enumerate(names) for a, f in (("c", F.count), ("l", F.min), ("h", F.max))],
    )
    constant = [
        F.bool_and((F.col(f"c{i}") == 0) | ((F.col(f"c{i}") == F.col("_n")) & (F.col(f"l{i}") == F.col(f"h{i}")))).alias(f"k{i}")
        for i in range(len(names))
    ]
    row = per_case.agg(*constant).first()
    kept = [c for i, c in enumerate(names) if row[f"k{i}"]]
    if not kept:
        return log.df.sparkSession.createDataFrame([], "column string, distinct bigint")
    counts = value_table(log.df, kept).filter("value IS NOT NULL").groupBy("column").agg(F.count("*").alias("distinct"))
    return counts.filter(F.col("distinct").between(2, MAX_VALUES))


def case_table(log: EventLog) -> DataFrame:
    """``case_id, events, hours, repeated, variant, head`` per case; ``process.ordered_events`` has the whole traces."""
    hours = dates.hours_between(F.min(MOMENT), F.max(MOMENT))
    spans = log.events.groupBy(CASE).agg(hours.alias("hours"))
    twice = log.events.groupBy(CASE, ACTIVITY).agg(F.count("*").alias("n")).groupBy(CASE).agg((F.max("n") > 1).alias("repeated"))
    traces = process.case_traces(log)
    return traces.join(spans, CASE).join(twice, CASE).select(CASE, "events", F.round("hours", 4).alias("hours"), "repeated", "variant", "head")


def cohort_labels(log: EventLog, attribute: str, focus: str, against: str = "") -> DataFrame:
    """``case_id, is_focus`` for the cases of both cohorts."""
    first = F.min_by(F.col(attribute), F.when(F.col(attribute).isNotNull(), F.col(log.row_id)))
    values = (
        log.df.filter(F.col(log.case).isNotNull())
        .groupBy(F.col(log.case).cast("string").alias(CASE))
        .agg(F.coalesce(first.cast("string"), F.lit("None")).alias("_value"))
    )
    kept = values if not against else values.filter(F.col("_value").isin(focus, against))
    return kept.select(CASE, (F.col("_value") == focus).alias("is_focus"))


def gap_steps(log: EventLog, labels: DataFrame, focus_cases: int, other_cases: int) -> DataFrame:
    """Waiting hours per case and handover in both cohorts. One grouped pass, no join of two aggregates."""
    steps = process.handovers(log).join(labels, CASE)
    mine = F.sum(F.when(F.col("is_focus"), F.col("wait_hours")).otherwise(0.0)) / max(focus_cases, 1)
    other = F.sum(F.when(~F.col("is_focus"), F.col("wait_hours")).otherwise(0.0)) / max(other_cases, 1)
    return (
        steps.groupBy(ACTIVITY, "next_activity")
        .agg(mine.alias("focus_hours"), other.alias("other_hours"))
        .withColumn("gap_hours", F.col("focus_hours") - F.col("other_hours"))
    )


def compare_cohorts(log: EventLog, attribute: str, focus: str, against: str = "") -> tuple[DataFrame, Outcome]:
    """The handovers that explain why ``focus`` cases wait longer, and the metrics of the comparison."""
    spark = log.df.sparkSession
    labels = cohort_labels(log, attribute, focus, against)
    sizes = labels.agg(F.count_if("is_focus").alias("f"), F.count_if(~F.col("is_focus")).alias("o")).first()
    schema = "rank int, activity string, next_activity string, focus_hours double, other_hours double, gap_hours double, share_of_gap_pct double"
    empty = spark.createDataFrame([], schema)
    nothing = metric_rows(spark.range(0), [metric("", F.lit(0.0))])
    if min(sizes) < MIN_COHORT:
        why = [("compare_cohorts", f"{attribute}={focus}", "one of the cohorts has too few cases", min(sizes), MIN_COHORT)]
        return empty, Outcome(nothing, refusals(spark, why))
    if not log.timed:
        why = [("compare_cohorts", attribute, "no usable time column, waits cannot be measured", None, None)]
        return empty, Outcome(nothing, refusals(spark, why))
    gaps = gap_steps(log, labels, sizes["f"], sizes["o"])
    positive = gaps.agg(F.coalesce(F.sum(F.when(F.col("gap_hours") > 0, F.col("gap_hours"))), F.lit(0.0))).first()[0]
    order = [F.desc("gap_hours"), F.asc(ACTIVITY), F.asc("next_activity")]
    top = gaps.filter("gap_hours > 0").orderBy(*order).limit(TOP_STEPS)
    place = F.row_number().over(Window.orderBy(*order))  # at most eight rows
    steps = top.select(
        place.alias("rank"), ACTIVITY, "next_activity",
        *[F.round(c, 4).alias(c) for c in ("focus_hours", "other_hours", "gap_hours")],
        F.round(100.0 * F.col("gap_hours") / F.lit(positive), 4).alias("share_of_gap_pct"),
    )
    step = F.concat(text.slug(F.col(ACTIVITY)), F.lit("__to__"), text.slug(F.col("next_activity")))
    slug = lambda v: text.slug(F.lit(v))
    one = spark.range(1)
    metrics = stacked([
        metric_rows(one, [
            metric("process.gap.total_hours_per_case", F.lit(positive), measure="process.gap", stat="total_hours_per_case", unit="h", source="gap"),
            metric(F.concat(F.lit("process.cases.by."), slug(attribute), F.lit("."), slug(focus)), F.lit(sizes["f"]), measure="process.cases", dim=attribute, grp=focus, stat="cases", unit="case", source="gap"),
        ]),
        metric_rows(steps, [
            metric(F.concat(F.lit("process.gap."), step, F.lit(f".{s}")), F.col(c), measure="process.gap", grp=step, stat=s, unit=u, source="gap")
            for s, c, u in (("hours_per_case", "gap_hours", "h"), ("share_pct", "share_of_gap_pct", "%"), ("focus_hours_per_case", "focus_hours", "h"))
        ]),
    ])
    why = [] if positive else [("compare_cohorts", f"{attribute}={focus}", "the cohort is not slower at any handover", 0, 0)]
    return steps, Outcome(metrics, refusals(spark, why))
