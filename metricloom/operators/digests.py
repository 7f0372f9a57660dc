"""Content hashes that do not depend on row or column order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.operators.common import side_by_side
from metricloom.operators.profile import _quoted, _types


def ten_digits(number: Column) -> Column:
    """A double with ten significant digits, shortest form: plain below 1e10, otherwise with an exponent."""
    scientific = F.format_string("%.9e", number)
    exponent = F.substring_index(scientific, "e", -1).cast("int")
    mantissa = F.regexp_replace(F.substring_index(scientific, "e", 1), r"\.?0+$", "")
    plain = F.regexp_replace(scientific.try_cast("decimal(38,13)").cast("string"), r"\.?0+$", "")
    plain = F.when(F.contains(scientific.try_cast("decimal(38,13)").cast("string"), F.lit(".")), plain)
    sign = F.when(exponent < 0, "-").otherwise("+")
    power = F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0"))
    return F.when(number == 0, "0").when((exponent < -4) | (exponent >= 10), F.concat(mantissa, F.lit("e"), sign, power)).otherwise(plain)


def _cell(column: Column, kind: T.DataType) -> Column:
    """One canonical text per value: missing is empty, floats with ten digits, breaks escaped."""
    if isinstance(kind, T.BooleanType):
        shown = F.when(column, "true").otherwise("false")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        number = column.cast("double")
        shown = F.when(~F.isnan(number), ten_digits(number))
    else:
        raw = column.cast("string")
        for plain, escaped in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            raw = F.replace(raw, F.lit(plain), F.lit(escaped))
        shown = raw
    return F.when(column.isNull(), "").otherwise(F.coalesce(shown, F.lit("")))


def row_digests(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``digest``: SHA-256 of every row over its columns in name order."""
    kinds = _types(df)
    names = sorted(columns or df.columns)
    return df.select(F.sha2(F.concat_ws("\t", *[_cell(_quoted(c), kinds[c]) for c in names]), 256).alias("digest"))


def content_hash(df: DataFrame) -> DataFrame:
    """``rows, content``: a hash of the whole table as a multiset of rows.

    Row digests are folded by four 60-bit sums, which is associative: no sort, no
    collected group, one tiny partial result per task. Column names enter the hash.
    """
    digests = row_digests(df)
    lanes = [F.conv(F.substring("digest", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    folded = digests.agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(lane), F.lit(0).cast("decimal(38,0)")).alias(f"s{i}") for i, lane in enumerate(lanes)])
    header = "\t".join(sorted(df.columns))
    parts = F.concat_ws("|", F.lit(header), F.col("rows").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(4)])
    return folded.select("rows", F.sha2(parts, 256).alias("content"))


def same_content(left: DataFrame, right: DataFrame) -> bool:
    row = side_by_side(content_hash(left).select(F.col("content").alias("a")), content_hash(right).select(F.col("content").alias("b"))).first()
    return row["a"] == row["b"]
