"""Shapes shared by every measuring operator: metric rows and refusal rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DECIMALS = 4

METRIC_SCHEMA = (
    "key string, measure string, stat string, dim string, grp string, value double, unit string, source string"
)
METRIC_COLUMNS = ["key", "measure", "stat", "dim", "grp", "value", "unit", "source"]
REFUSAL_SCHEMA = "op string, subject string, reason string, observed double, required double"


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def metric(
    key: Column | str,
    value: Column,
    *,
    measure: Column | str = "",
    stat: Column | str = "",
    dim: Column | str | None = None,
    grp: Column | str | None = None,
    unit: str = "",
    source: Column | str = "",
) -> Column:
    """One metric as a struct. The dotted key is built here and never parsed back."""
    return F.struct(
        _lit(key).cast("string").alias("key"),
        _lit(measure).cast("string").alias("measure"),
        _lit(stat).cast("string").alias("stat"),
        _lit(dim).cast("string").alias("dim"),
        _lit(grp).cast("string").alias("grp"),
        F.round(_lit(value).cast("double"), DECIMALS).alias("value"),
        F.lit(unit).alias("unit"),
        _lit(source).cast("string").alias("source"),
    )


def metric_rows(df: DataFrame, metrics: Sequence[Column]) -> DataFrame:
    """Emit several metrics per row of ``df``; those without a value are left out."""
    return (
        df.select(F.explode(F.array(*metrics)).alias("_m"))
        .select("_m.*")
        .filter(F.col("value").isNotNull())
    )


def stacked(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def refusals(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """Rows ``(op, subject, reason, observed, required)``; bounded by the number of tests asked for."""
    clean = [
        (op, subject, reason, None if seen is None else float(seen), None if need is None else float(need))
        for op, subject, reason, seen, need in rows
    ]
    return spark.createDataFrame(clean, REFUSAL_SCHEMA)


def side_by_side(*rows: DataFrame) -> DataFrame:
    """Put the columns of several one-row aggregates into one row (no join involved)."""
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return together.agg(*[F.first(c, ignorenulls=True).alias(c) for c in together.columns])


class Outcome:
    """Metrics and what was refused, as two tables."""

    def __init__(self, metrics: DataFrame, refused: DataFrame):
        self.metrics, self.refused = metrics, refused
