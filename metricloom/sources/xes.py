"""XES event logs, and a representative slice of whole cases."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.operators.common import stacked
from metricloom.scale import Sequenced
from metricloom.session import materialize

# Elements that carry an attribute.
ATTRIBUTE_TAGS = ("string", "date", "int", "float", "boolean", "id")

_PAIR = T.ArrayType(T.StructType([T.StructField("_key", T.StringType()), T.StructField("_value", T.StringType())]))
_ATTRIBUTES = [T.StructField(tag, _PAIR) for tag in ATTRIBUTE_TAGS]
_SCHEMA = T.StructType([*_ATTRIBUTES, T.StructField("event", T.ArrayType(T.StructType(_ATTRIBUTES)))])


def _attribute(holder: str, key: str) -> Column:
    """The last attribute with this key, whatever its tag."""
    empty = F.array().cast("array<struct<_key:string,_value:string>>")
    pairs = F.concat(*[F.coalesce(F.col(f"{holder}{tag}"), empty) for tag in ATTRIBUTE_TAGS])
    return F.try_element_at(F.filter(pairs, lambda p: p["_key"] == key), F.lit(-1))["_value"]


def _keys(holder: str) -> Column:
    empty = F.array().cast("array<struct<_key:string,_value:string>>")
    pairs = F.concat(*[F.coalesce(F.col(f"{holder}{tag}"), empty) for tag in ATTRIBUTE_TAGS])
    return F.transform(pairs, lambda p: p["_key"])


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """One row per trace element that holds something. Files are cut at the end tags of traces, so many tasks share a large log.

    An end tag inside a comment or a CDATA section is taken for a real one.
    """
    pieces = spark.read.option("lineSep", "</trace>").text(path)
    opened = F.regexp_extract("value", r"(?s)^.*(<trace[\s>].*)$", 1)  # what stands before the first trace belongs to the log
    traces = pieces.select(opened.alias("xml")).filter("xml <> ''").select(F.concat("xml", F.lit("</trace>")).alias("xml"))
    return traces.select(F.from_xml("xml", _SCHEMA, {"attributePrefix": "_"}).alias("t")).select("t.*")


def read_events(spark: SparkSession, path: str, trace_columns: Mapping[str, str], event_columns: Mapping[str, str]) -> DataFrame:
    """One row per event with its trace's attributes and ``event_seq``.

    ``trace_columns`` and ``event_columns`` map attribute keys to column names.
    """
    traces = read_traces(spark, path)
    heads = [_attribute("", key).alias(name) for key, name in trace_columns.items()]
    events = traces.select(*heads, F.posexplode("event").alias("event_seq", "e"))
    return events.select(*trace_columns.values(), "event_seq", *[_attribute("e.", key).alias(name) for key, name in event_columns.items()])


def unmapped_keys(spark: SparkSession, path: str, trace_columns: Mapping[str, str], event_columns: Mapping[str, str]) -> DataFrame:
    """Attribute keys that the maps do not cover, so no attribute is lost silently: ``level, key``."""
    traces = read_traces(spark, path)
    outer = traces.select(F.lit("trace").alias("level"), F.explode(_keys("")).alias("key")).filter(~F.col("key").isin(list(trace_columns)))
    inner = traces.select(F.explode("event").alias("e")).select(F.lit("event").alias("level"), F.explode(_keys("e.")).alias("key")).filter(~F.col("key").isin(list(event_columns)))
    return outer.unionByName(inner).distinct()


def _take(index: DataFrame, budget: int) -> tuple[list[DataFrame], int]:
    """Cases in order that fit a budget, as tables; one that would overflow it is skipped.

    Each round takes the longest start of the cases that still fit. What remains of the budget only shrinks, so a case that
    was skipped never fits later and the choice is exact.
    """
    taken, left, rest = [], budget, index.select("case_id", "events")
    while left > 0:
        fitting = rest.filter(F.col("events") <= left)
        placed = materialize(Sequenced(fitting, [], ["case_id"]).with_running_sum("upto", "events").rows())
        start = placed.filter(F.col("upto") <= left)
        got = start.agg(F.sum("events").alias("events"), F.max("case_id").alias("last")).first()
        if got["last"] is None:
            break
        taken.append(start.select("case_id"))
        left -= got["events"]
        rest = placed.filter(F.col("case_id") > got["last"]).select("case_id", "events")
    return taken, budget - left


def select_cases(index: DataFrame, target_events: int, variant_share: float = 0.5) -> DataFrame:
    """``case_id`` of whole cases up to an event budget, from ``case_id, variant, events``.

    Part of the budget goes to the first case of each variant, the rest is filled in case
    order. Cases of one variant have equally many events, so one per variant is enough.
    """
    index = materialize(index)
    firsts = index.groupBy("variant").agg(F.min("case_id").alias("case_id"), F.first("events").alias("events"))
    variants, used = _take(firsts, int(target_events * variant_share))
    chosen = stacked(variants) if variants else index.select("case_id").limit(0)
    rest = index.join(chosen, "case_id", "left_anti")
    others, _ = _take(rest, target_events - used)
    return stacked([chosen, *others])


def slice_log(df: DataFrame, case: str, activity: str, order: list[str], target_events: int, variant_share: float = 0.5) -> DataFrame:
    """The events of the selected cases. Their number is bounded by the event budget."""
    step = Sequenced(df.select(F.col(case).cast("string").alias("case_id"), F.col(activity).cast("string").alias("_a"), *order), ["case_id"], order)
    placed = step.with_position("_pos").rows()
    # Order-sensitive signature without collecting a trace: two sums over hashes of (position, activity).
    sums = [F.sum(F.xxhash64(F.lit(seed), "_pos", "_a").cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
    index = placed.groupBy("case_id").agg(F.concat_ws("|", F.count("*").cast("string"), *sums).alias("variant"), F.count("*").alias("events"))
    wanted = select_cases(index, target_events, variant_share).withColumnRenamed("case_id", "_case")
    return df.join(wanted, F.col(case).cast("string") == F.col("_case"), "left_semi")
