"""Reading numbers out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.functions.text import strip

INTERNATIONAL = "international"
LOCAL = "local"

# Fixed patterns: how a cell may be read under each convention.
US_GROUPED = r"^[-+]?\d{1,3}(?:,\d{3})+(?:\.\d+)?$"
DOT_DECIMAL = r"^[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?$"
LOCAL_GROUPED = r"^[-+]?[1-9]\d{0,2}(?:\.\d{3})+(?:,\d+)?$"
COMMA_DECIMAL = r"^[-+]?\d+,\d+$"
INTEGER = r"^[-+]?\d+$"
DOT_AMBIGUOUS = r"^[-+]?[1-9]\d{0,2}(?:\.\d{3})+$"

NUMERIC_SHARE = 0.9


def is_number_type(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def to_double(text: Column) -> Column:
    """A plain dot-decimal number, or null. ``1d``, ``NaN`` and words are not numbers."""
    bare = strip(text)
    return F.when(bare.rlike(DOT_DECIMAL), bare.try_cast("double"))


def numeric(column: Column, data_type: T.DataType) -> Column:
    """The column as a double, whatever it is stored as; NaN counts as missing."""
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(column), column.cast("double"))
    if is_number_type(data_type):
        return column.cast("double")
    if isinstance(data_type, T.BooleanType):
        return column.cast("int").cast("double")
    if isinstance(data_type, T.StringType):
        return to_double(column)
    return F.lit(None).cast("double")


def reads_international(text: Column) -> Column:
    return text.rlike(US_GROUPED) | text.rlike(DOT_DECIMAL)


def reads_local(text: Column) -> Column:
    return text.rlike(LOCAL_GROUPED) | text.rlike(COMMA_DECIMAL) | text.rlike(INTEGER)


def with_convention(text: Column, convention: Column) -> Column:
    """Parse a cell under the convention decided for its whole column."""
    bare = strip(text)
    local = F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    plain = F.when(convention == LOCAL, local).otherwise(F.replace(bare, F.lit(","), F.lit("")))
    return F.when(plain.rlike(DOT_DECIMAL), plain.try_cast("double"))
