"""Period labels, mixed date formats and time grains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.functions.text import fold

# Fixed patterns: period labels after folding, each with the positions of year and month.
_PERIODS = (
    (r"^(?:q|quy)\s?([1-4])\s(\d{2}|\d{4})$", 2, 1, 3),
    (r"^(\d{4})\s(?:q|quy)\s?([1-4])$", 1, 2, 3),
    (r"^(?:h|ban nien)\s?([12])\s(\d{4})$", 2, 1, 6),
    (r"^(?:t|thang)\s?(\d{1,2})\s(\d{2}|\d{4})$", 2, 1, 1),
    (r"^(\d{1,2})\s(\d{4})$", 2, 1, 1),
    (r"^(\d{4})\s(\d{1,2})$", 1, 2, 1),
)
_YEAR_ONLY = r"^(?:nam\s|fy\s?)?(\d{4})$"

# Fixed pattern: a quarter cell such as 2026-Q3.
QUARTER = r"^\s*(\d{4})\s*[-/ ]?\s*[Qq]([1-4])\s*$"

# Fixed pattern: a label of the metric table that names a period.
PERIOD_LABEL = r"^\d{4}(-(Q[1-4]|\d{2}))?$"

# Fixed pattern: a cell that looks like a date.
DATE_LIKE = r"^\s*\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}([ T]\d{1,2}:\d{2})?\s*$"

_OFFSET = r"(?:[zZ]|[+-]\d{2}:?\d{2})"

#: Accepted ways of writing a moment, each with the pattern that recognises it. Only the
#: matching format is parsed: a failed parse is far more expensive than a pattern test.
#: Month comes before day, as is usual for mixed input.
_TIME = r"\d{1,2}:\d{1,2}"
MIXED_FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}} {_TIME}$", "yyyy-M-d H:m"),
    (rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}} {_TIME}:\d{{1,2}}$", "yyyy-M-d H:m:s"),
    (rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}T{_TIME}$", "yyyy-M-d'T'H:m"),
    (rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}T{_TIME}:\d{{1,2}}$", "yyyy-M-d'T'H:m:s"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (rf"^\d{{4}}/\d{{1,2}}/\d{{1,2}} {_TIME}:\d{{1,2}}$", "yyyy/M/d H:m:s"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (rf"^\d{{1,2}}/\d{{1,2}}/\d{{4}} {_TIME}:\d{{1,2}}$", "M/d/yyyy H:m:s"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM yyyy"),
)
# Full ISO moments with seconds fractions or an offset; the engine's own parser reads them.
_ISO = rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}[ T]{_TIME}(:\d{{1,2}}(\.\d+)?)?\s*({_OFFSET})?$"


def period_key(text: Column) -> Column:
    """``struct(year, month)`` of the last month of a named period, null for other text."""
    said = F.replace(fold(text), F.lit("_"), F.lit(" "))

    def year(part: Column) -> Column:
        number = part.try_cast("int")
        return F.when(number < 100, number + 2000).otherwise(number)

    chain = None
    for pattern, year_at, month_at, months in _PERIODS:
        month = F.regexp_extract(said, pattern, month_at).try_cast("int") * months
        key = F.when(
            month.between(1, 12),
            F.struct(year(F.regexp_extract(said, pattern, year_at)).alias("year"), month.alias("month")),
        )
        hit = said.rlike(pattern)
        chain = F.when(hit, key) if chain is None else chain.when(hit, key)
    whole = F.regexp_extract(said, _YEAR_ONLY, 1).try_cast("int")
    return chain.when(
        said.rlike(_YEAR_ONLY), F.struct(year(whole.cast("string")).alias("year"), F.lit(12).alias("month"))
    )


def quarter_start(text: Column) -> Column:
    year = F.regexp_extract(text, QUARTER, 1).try_cast("int")
    quarter = F.regexp_extract(text, QUARTER, 2).try_cast("int")
    return F.when(text.rlike(QUARTER), F.make_date(year, quarter * 3 - 2, F.lit(1)).cast("timestamp"))


def has_offset(text: Column) -> Column:
    return text.rlike(r"\d" + _OFFSET + "$")


def parse_mixed(text: Column) -> Column:
    """The moment a cell names, whichever of the accepted formats it uses; null otherwise."""
    bare = F.trim(text)
    chain = None
    for pattern, form in MIXED_FORMATS:
        hit, read = bare.rlike(pattern), F.try_to_timestamp(bare, F.lit(form))
        chain = F.when(hit, read) if chain is None else chain.when(hit, read)
    moment = chain.when(bare.rlike(_ISO), F.try_to_timestamp(bare))
    # Nothing that starts with another character can be a moment: one cheap test for most text.
    return F.when(bare.rlike(r"^[0-9A-Z]"), moment)


def as_moment(column: Column, data_type: T.DataType) -> Column:
    """Any stored form of time as a timestamp."""
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return column.cast("timestamp")
    if isinstance(data_type, T.StringType):
        return F.coalesce(quarter_start(column), parse_mixed(column))
    if isinstance(data_type, T.NumericType):
        return F.when((column.between(1900, 2200)) & (column % 1 == 0), F.make_date(column.cast("int"), F.lit(1), F.lit(1)).cast("timestamp"))
    return F.lit(None).cast("timestamp")


def period_of(moment: Column, grain: str) -> Column:
    """``struct(label, ord, season, season_no)`` of a moment at year, quarter or month grain."""
    year, quarter, month = F.year(moment), F.quarter(moment), F.month(moment)
    if grain == "year":
        return F.struct(
            year.cast("string").alias("label"),
            year.alias("ord"),
            F.lit("").alias("season"),
            F.lit(0).alias("season_no"),
        )
    if grain == "quarter":
        return F.struct(
            F.concat(year.cast("string"), F.lit("-Q"), quarter.cast("string")).alias("label"),
            (year * 4 + quarter).alias("ord"),
            F.concat(F.lit("Q"), quarter.cast("string")).alias("season"),
            quarter.alias("season_no"),
        )
    two = F.lpad(month.cast("string"), 2, "0")
    return F.struct(
        F.concat(year.cast("string"), F.lit("-"), two).alias("label"),
        (year * 12 + month).alias("ord"),
        F.concat(F.lit("thang "), two).alias("season"),
        month.alias("season_no"),
    )


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(3.6e9)
