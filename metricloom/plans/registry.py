"""Named queries over the standard tables and, where one exists, their SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one folder. Zone-less timestamps become UTC timestamps once, here."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        for field in df.schema.fields:
            if isinstance(field.dataType, T.TimestampNTZType):
                df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
        return df


def query(name: str, sql: str | None = None):
    """Register ``function(tables) -> DataFrame`` under ``name``."""

    def wrap(function: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: function(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return function

    return wrap


def cells_sql(table: str, columns: list[str], keep: str = "") -> str:
    """SQL twin of the unpivoted cells: ``column, value`` as text."""
    lead = f"{keep}, " if keep else ""
    return "(" + " UNION ALL ".join(
        f"SELECT {lead}'{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM {table}" for c in columns
    ) + ")"


#: SQL for a cell read as a plain number.
NUMBER_SQL = (
    "CASE WHEN regexp_matches(trim({0}), '^[-+]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][-+]?[0-9]+)?$') "
    "THEN try_cast(trim({0}) AS DOUBLE) END"
)


def number_sql(expression: str) -> str:
    return NUMBER_SQL.format(expression)
