"""Counting the values of many columns without shuffling the values.

* How often a value occurs is counted on ``(column, 128-bit hash)``: 20 bytes a distinct value, whatever its length. Texts are
  fetched only for the few that are reported.
* Which values come first in text order is settled inside the tasks, a few texts for each column and task.
* Quantiles are narrowed down: approximate percentiles of known error bracket each wanted rank, the rows below the bracket are
  counted, and only the values inside it, well under one percent, are counted one by one.

Hashes of 128 bits make two different values equal with a chance below 1e-18 for ten billion of them. 0.0 and -0.0 are one value.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom import scale
from metricloom.functions import numbers
from metricloom.session import materialize

#: Tied values up to which a winner's text is looked up by its hash, and texts first asked for when there are more ties.
TIES = 200
FIRST_TEXTS = 64
#: Relative error of an approximate percentile is its inverse; a bracket is this many errors wide on each side.
ACCURACY = 1000
MARGIN = 2.0
#: Columns whose approximate percentiles are kept in one aggregate.
WIDTH = 64


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def types_of(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def as_text(df: DataFrame, name: str) -> Column:
    """The cell as text; NaN is null."""
    column, kind = quoted(name), types_of(df)[name]
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        column = F.when(~F.isnan(column), column)
    return column.cast("string")


def as_number(df: DataFrame, name: str) -> Column:
    """The cell as a finite number, if its text reads as one."""
    kind = types_of(df)[name]
    if numbers.is_number_type(kind):
        x = numbers.numeric(quoted(name), kind)
        return F.when(F.abs(x) < F.lit(float("inf")), x)
    if isinstance(kind, T.StringType):
        return numbers.to_double(quoted(name))
    return F.lit(None).cast("double")


def _native(df: DataFrame, name: str) -> Column:
    """The cell for hashing: as it is stored where that tells the same values apart, else as text."""
    kind = types_of(df)[name]
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(quoted(name)), quoted(name))
    atomic = isinstance(kind, (T.StringType, T.IntegralType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType))
    return quoted(name) if atomic else as_text(df, name)


def digest(value: Column) -> list[Column]:
    """Two independent hashes ``a, b``; null for null."""
    return [F.when(value.isNotNull(), F.xxhash64(F.lit(seed), value)).alias(name) for seed, name in ((1, "a"), (2, "b"))]


def unpivot(df: DataFrame, columns: Sequence[str], fields) -> DataFrame:
    """One row per cell: ``at``, the place of its column, and ``fields(cells, "v")``. Columns of one type are exploded together, so that
    expressions are written once for a type and not once for a column."""
    kinds = types_of(df)
    groups: dict[str, list[int]] = {}
    for k, c in enumerate(columns):
        groups.setdefault(kinds[c].simpleString(), []).append(k)
    parts = []
    for places in groups.values():
        exploded = df.select(F.posexplode(F.array(*[quoted(columns[k]) for k in places])).alias("_p", "v"))
        cells = exploded.select(F.element_at(F.array(*map(F.lit, places)), F.col("_p") + 1).alias("at"), "v")
        parts.append(cells.select("at", *fields(cells, "v")))
    return reduce(DataFrame.unionByName, parts)


def named(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``at`` replaced by ``column``."""
    names = F.array(*[F.lit(c) for c in columns])
    return df.select(F.element_at(names, F.col("at") + 1).alias("column"), *[c for c in df.columns if c != "at"])


def hash_counts(df: DataFrame, columns: Sequence[str], value_of=_native) -> DataFrame:
    """``at, a, b, n`` of every distinct value of every column, null among them."""
    return unpivot(df, columns, lambda d, c: digest(value_of(d, c))).groupBy("at", "a", "b").agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, columns: Sequence[str], value_of=_native, name: str = "distinct") -> DataFrame:
    """``column`` and how many different values it has, null not counted."""
    return named(hash_counts(df, columns, value_of).groupBy("at").agg(F.count("a").alias(name)), columns)


def top_values(df: DataFrame, columns: Sequence[str], limit: int) -> DataFrame:
    """``column, rank, value, n`` of the most common values of each column, ties by value. Short tables are counted on the values themselves."""
    columns = list(columns)
    order = Window.partitionBy("at").orderBy(F.desc("n"), F.asc("value"))
    if df.count() <= scale.group_limit(df):
        short = unpivot(df, columns, lambda d, c: [as_text(d, c).alias("value")]).filter("value IS NOT NULL").groupBy("at", "value").agg(F.count("*").alias("n"))
        return named(short.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("at", "rank", "value", "n"), columns)
    counts = materialize(hash_counts(df, columns).filter("a IS NOT NULL"))
    spectrum = counts.groupBy("at", "n").agg(F.count("*").alias("values"))  # few rows: n values need n (n + 1) / 2 rows of the table
    above = F.sum("values").over(Window.partitionBy("at").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))
    needed = spectrum.withColumn("above", F.coalesce(above, F.lit(0))).filter(F.col("above") < limit)
    last = needed.groupBy("at").agg(F.min_by(F.struct("n", "values", "above"), "n").alias("l")).select("at", "l.*").collect()  # one row per column
    if not last:
        return named(df.sparkSession.createDataFrame([], "at int, rank int, value string, n bigint"), columns or [""])
    tied = {r["at"] for r in last if r["values"] > TIES}
    least = F.create_map(*[x for r in last for x in (F.lit(r["at"]), F.lit(r["n"] + (r["at"] in tied)))])
    wanted = counts.filter(F.col("n") >= least[F.col("at")])  # at most (limit + TIES) for each column
    cells = unpivot(df, columns, lambda d, c: [*digest(_native(d, c)), as_text(d, c).alias("value")])
    found = cells.join(F.broadcast(wanted), ["at", "a", "b"]).groupBy("at", "a", "b").agg(F.first("value").alias("value"), F.first("n").alias("n")).select("at", "value", "n")
    ask = FIRST_TEXTS
    while tied:
        known = {r["at"]: r for r in last if r["at"] in tied}
        firsts = _first_texts(df, columns, sorted(tied), ask)
        firsts = materialize(firsts.join(counts, ["at", "a", "b"]))  # at most ``ask`` for each column
        of_rank = F.create_map(*[x for at, r in known.items() for x in (F.lit(at), F.lit(r["n"]))])
        fitting = firsts.filter(F.col("n") == of_rank[F.col("at")]).select("at", "value", "n")
        enough = {r["at"] for r in fitting.groupBy("at").count().collect() if r["count"] >= limit - known[r["at"]]["above"]}
        found = found.unionByName(fitting.filter(F.col("at").isin(sorted(enough)))) if enough else found
        tied -= enough
        ask *= 16  # every text is asked for in the end
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return named(ranked.select("at", "rank", "value", "n"), columns)


def _first_texts(df: DataFrame, columns: Sequence[str], places: Sequence[int], limit: int) -> DataFrame:
    """``at, a, b, value``: the first ``limit`` texts in order of each column. A task passes on no more than that."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = [pa.array([], pa.string()) for _ in places]
        for batch in batches:
            for k in range(len(places)):
                both = pc.unique(pa.concat_arrays([held[k], batch.column(k).cast(pa.string()).drop_null()]))
                held[k] = both.take(pc.select_k_unstable(both, limit, [("", "ascending")])) if len(both) > limit else both
        for k, texts in enumerate(held):
            yield pa.RecordBatch.from_arrays([pa.array([places[k]] * len(texts), pa.int32()), texts], ["at", "value"])

    texts = df.select(*[as_text(df, columns[k]).alias(f"t{k}") for k in places]).mapInArrow(smallest, "at int, value string").distinct()
    order = Window.partitionBy("at").orderBy("value")
    first = texts.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= limit).drop("_r")
    # the hash of a stored value, made from its text
    back = F.coalesce(*[F.when(F.col("at") == k, F.struct(*digest(F.col("value").cast(_hash_type(df, columns[k]))))) for k in places])
    return first.withColumn("h", back).select("at", "h.a", "h.b", "value")


def _hash_type(df: DataFrame, name: str) -> T.DataType:
    return df.select(_native(df, name).alias("x")).schema["x"].dataType


def quantiles(df: DataFrame, columns: Sequence[str], shares: dict[str, float], value_of=as_number) -> DataFrame:
    """``column, n`` and the exact linear-interpolation quantiles of the numbers of each column; no row for columns without one."""
    columns = list(columns)
    parts = [_quantiles(df, columns, columns[k : k + WIDTH], shares, value_of) for k in range(0, len(columns), WIDTH)]
    spark = df.sparkSession
    rows = [(c, *values) for part in parts for c, *values in part]  # one row per column
    return spark.createDataFrame(rows, "column string, n bigint, " + ", ".join(f"`{s}` double" for s in shares))


def _quantiles(df: DataFrame, columns: Sequence[str], own: Sequence[str], shares: dict[str, float], value_of) -> list[tuple]:
    data = df.select(*[value_of(df, c).alias(f"x{k}") for k, c in enumerate(own)])
    half = MARGIN / ACCURACY
    ends = sorted({min(1.0, max(0.0, s + d)) for s in shares.values() for d in (-half, half)})
    first = data.agg(*[a for k in range(len(own)) for a in (F.count(f"x{k}").alias(f"n{k}"), F.percentile_approx(f"x{k}", ends, ACCURACY).alias(f"p{k}"), F.min(f"x{k}").alias(f"l{k}"), F.max(f"x{k}").alias(f"h{k}"))]).first()
    brackets = []  # (column, share, rank, low, high)
    for k in range(len(own)):
        n = first[f"n{k}"]
        for name, share in shares.items() if n else ():
            rank = share * (n - 1)
            slack = half * n - 2  # ranks between the wanted one and an end; the neighbour above is wanted too
            low, high = (first[f"p{k}"][ends.index(min(1.0, max(0.0, share + d)))] for d in (-half, half))
            if slack < n / ACCURACY + 1 or share - half <= 0:
                low = first[f"l{k}"]
            if slack < n / ACCURACY + 1 or share + half >= 1:
                high = first[f"h{k}"]
            brackets.append((k, name, rank, low, high))
    if not brackets:
        return []
    sides = [c for i, (k, _, _, low, high) in enumerate(brackets) for c in (F.count_if(F.col(f"x{k}") < low).alias(f"b{i}"), F.count_if(F.col(f"x{k}").between(low, high)).alias(f"m{i}"))]
    below = data.agg(*sides).first()
    split = max(below[f"m{i}"] for i in range(len(brackets))) > scale.group_limit(df)
    inside = F.array_compact(F.array(*[F.when(F.col(f"x{k}").between(low, high), F.struct(F.lit(i).alias("i"), F.col(f"x{k}").alias("x"))) for i, (k, _, _, low, high) in enumerate(brackets)]))
    counted = data.select(F.explode(inside).alias("e")).groupBy("e.i", "e.x").agg(F.count("*").alias("n"))
    upto = scale.Sequenced(counted, ["i"], ["x"], split=split).with_running_sum("upto", "n").rows()
    start = F.create_map(*[x for i in range(len(brackets)) for x in (F.lit(i), F.lit(below[f"b{i}"]))])
    rank_of = F.create_map(*[x for i, (_, _, rank, _, _) in enumerate(brackets) for x in (F.lit(i), F.lit(float(rank)))])
    last = start[F.col("i")] + F.col("upto")
    hit = lambda at: F.max(F.when((last - F.col("n") <= at) & (at < last), F.col("x")))
    rank = rank_of[F.col("i")]
    picked = {r["i"]: r for r in upto.groupBy("i").agg(hit(F.floor(rank)).alias("lo"), hit(F.ceil(rank)).alias("hi")).collect()}  # one row per bracket
    values: dict[int, list] = {}
    for i, (k, _, rank, _, _) in enumerate(brackets):
        r = picked.get(i)
        if r is None or r["lo"] is None or r["hi"] is None:
            raise ArithmeticError(f"the percentile of {own[k]} lies outside its bracket")
        values.setdefault(k, [first[f"n{k}"]]).append(r["lo"] + (rank - int(rank)) * (r["hi"] - r["lo"]))
    return [(own[k], *v) for k, v in values.items()]
