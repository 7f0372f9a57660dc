"""Joining values to the bands they fall into, by equality of bins.

A band is filed on the level of its own width: on a level whose bins are 2^k wide it touches two or three bins, however wide it is. A value has one
bin on each level that occurs. Values and bands meet by equality of (level, bin) and are compared exactly then, so overlapping, nested and
open-ended bands all work, and no pair is made that shares no bin. Bins that hold very many values are salted.

Where only an aggregate of the bands of each row is wanted, no pair is made at all: a band covers a run of the ordered distinct values, the run is cut
into blocks of 1, 4, 16, ... values, bands are aggregated on the blocks, and a value gathers the blocks that it lies in.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.scale import Sequenced
from metricloom.session import materialize

#: Aggregates of bands by name: a function that may be applied to its own results (sum, min, max), and what a band gives to it.
Fold = Mapping[str, tuple[Callable[[Column], Column], Column]]

#: Values in a block, in blocks of the level below.
RADIX = 4
#: Rows of a bin that one task should join, and rows of a table that may be broadcast.
BIN_ROWS = 1_000_000
BROADCAST_ROWS = 50_000


def _axis(column: Column, kind: T.DataType) -> Column:
    """The value on a line of doubles, in the same order; NaN is null."""
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        column = column.cast("timestamp")
    x = column.cast("double")
    return F.when(~F.isnan(x), x)


def interval_join(df: DataFrame, bands: DataFrame, value: str, low: str, high: str, *, closed: bool = False, bin_rows: int = BIN_ROWS, fold: Fold | None = None) -> DataFrame:
    """Rows of ``df`` beside every band with ``low <= value < high`` (``<= high`` if ``closed``). A null or NaN value matches nothing, nor does a band with
    such an end. The two tables must not share column names.

    With ``fold``, each row of ``df`` that has a band stands once, beside the aggregates of all its bands instead of each of them. The work then grows with
    the rows of both tables and not with the pairs.
    """
    same = {c.lower() for c in df.columns} & {c.lower() for c in bands.columns}
    if same:
        raise ValueError(f"columns in both tables: {sorted(same)}")
    if fold:
        return _folded(df, bands, value, low, high, closed, fold)
    kinds = {f.name: f.dataType for t in (df, bands) for f in t.schema.fields}
    at, lo, hi = (_axis(F.col(f"`{c}`"), kinds[c]) for c in (value, low, high))
    values = df.withColumn("_at", at).filter("_at IS NOT NULL")
    ends = values.agg(F.min("_at"), F.max("_at")).first()
    exact = (F.col(f"`{low}`") <= F.col(f"`{value}`")) & ((F.col(f"`{value}`") <= F.col(f"`{high}`")) if closed else (F.col(f"`{value}`") < F.col(f"`{high}`")))
    if ends[0] is None:
        return df.join(bands, F.lit(False))
    # An end beyond all values says no more than the last value.
    clipped = bands.withColumn("_lo", F.greatest(lo, F.lit(ends[0]))).withColumn("_hi", F.least(hi, F.lit(ends[1]))).filter(lo.isNotNull() & hi.isNotNull() & (F.col("_lo") <= F.col("_hi")))
    width = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(max(abs(ends[0]), abs(ends[1]), 1e-300) * 2.0**-50))
    levelled = clipped.withColumn("_level", F.ceil(F.log2(width)).cast("int"))
    levels = [r[0] for r in levelled.select("_level").distinct().collect()]  # one for each power of two among the widths
    if not levels:
        return df.join(bands, F.lit(False))

    def bin_of(x: Column) -> Column:
        return F.floor(x / F.pow(F.lit(2.0), F.col("_level")))

    filed = levelled.withColumn("_bin", F.explode(F.sequence(bin_of(F.col("_lo")), bin_of(F.col("_hi"))))).drop("_lo", "_hi")
    placed = values.withColumn("_level", F.explode(F.array(*map(F.lit, sorted(levels))))).withColumn("_bin", bin_of(F.col("_at")))
    keys = ["_level", "_bin"]
    if filed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        filed = F.broadcast(filed)
    else:
        hot = materialize(placed.groupBy(*keys).count().filter(F.col("count") > bin_rows).select(*keys, F.ceil(F.col("count") / bin_rows).alias("_shares")))
        few = hot.count()
        if few:
            hot = F.broadcast(hot) if few <= BROADCAST_ROWS else hot
            shares = F.coalesce("_shares", F.lit(1))
            placed = placed.join(hot, keys, "left").withColumn("_salt", F.floor(F.rand(7) * shares)).drop("_shares")
            filed = filed.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), shares - 1))).drop("_shares")
            keys = [*keys, "_salt"]
    return placed.join(filed, keys).filter(exact).select(*[F.col(f"`{c}`") for c in (*df.columns, *bands.columns)])


def _usable(df: DataFrame, name: str) -> Column:
    """The value itself; null for NaN. 0.0 and -0.0 are one."""
    column = F.col(f"`{name}`")
    return F.when(~F.isnan(column), column + F.lit(0).cast(df.schema[name].dataType)) if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)) else column


def _folded(df: DataFrame, bands: DataFrame, value: str, low: str, high: str, closed: bool, fold: Fold) -> DataFrame:
    names, merged = list(fold), [f(F.col(f"`{name}`")).alias(name) for name, (f, _) in fold.items()]
    ends = bands.select(_usable(bands, low).alias("_low"), _usable(bands, high).alias("_high"), *[given.alias(name) for name, (_, given) in fold.items()])
    spans = ends.filter((F.col("_low") <= F.col("_high")) if closed else (F.col("_low") < F.col("_high"))).groupBy("_low", "_high").agg(*merged)
    values = df.withColumn("_x", _usable(df, value)).filter("_x IS NOT NULL")
    points = values.select("_x", F.lit(1).alias("_kind"), F.lit(1).alias("_n")).distinct()
    # How many distinct values lie before each end: ends of kind 0 stand before an equal value, those of kind 2 after it.
    starts = spans.select(F.col("_low").alias("_x"), F.lit(0).alias("_kind"), F.lit(0).alias("_n"), F.lit(True).alias("_start"), *spans.columns)
    stops = spans.select(F.col("_high").alias("_x"), F.lit(2 if closed else 0).alias("_kind"), F.lit(0).alias("_n"), F.lit(False).alias("_start"), *spans.columns)
    marks = materialize(points.unionByName(starts.unionByName(stops), allowMissingColumns=True))
    counted = materialize(Sequenced(marks, [], ["_x", "_kind"]).with_running_sum("_upto", "_n").rows())
    first, stop = F.max(F.when(F.col("_start"), F.col("_upto"))).alias("_0"), F.max(F.when(~F.col("_start"), F.col("_upto"))).alias("_1")
    runs = counted.filter("_start IS NOT NULL").groupBy("_low", "_high", *names).agg(first, stop).filter("_0 < _1")
    places = counted.filter("_start IS NULL").select("_x", (F.col("_upto") - 1).alias("_at"))
    levels = 1
    while RADIX**levels < (places.agg(F.max("_at")).first()[0] or 0) + 1:
        levels += 1
    inner = [(F.ceil(F.col("_0") / RADIX**k), F.floor(F.col("_1") / RADIX**k)) for k in range(levels + 1)]  # whole blocks of a level
    pieces = []
    for k in range(levels):
        (begin, end), (up, down) = inner[k], (inner[k + 1][0] * RADIX, inner[k + 1][1] * RADIX)
        parents = up < down  # blocks of the next level take the middle
        pieces.append(F.struct(F.lit(k).alias("level"), begin.alias("begin"), F.when(parents, up).otherwise(end).alias("end")))
        pieces.append(F.struct(F.lit(k).alias("level"), down.alias("begin"), F.when(parents, end).otherwise(down).alias("end")))
    cut = runs.select(*names, F.explode(F.array(*pieces)).alias("_p")).filter("_p.begin < _p.end")
    blocks = cut.select(*names, F.col("_p.level").alias("_level"), F.explode(F.sequence(F.col("_p.begin"), F.col("_p.end") - 1)).alias("_block"))
    blocks = blocks.groupBy("_level", "_block").agg(*merged)
    homes = F.array(*[F.struct(F.lit(k).alias("_level"), F.floor(F.col("_at") / RADIX**k).alias("_block")) for k in range(levels)])
    gathered = places.select("_x", F.explode(homes).alias("_h")).select("_x", "_h.*").join(blocks, ["_level", "_block"]).groupBy("_x").agg(*merged)
    return values.join(gathered, "_x").select(*[F.col(f"`{c}`") for c in (*df.columns, *names)])
