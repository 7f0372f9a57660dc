"""Jobs over distinct values that need code outside the built-in expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.functions import numbers, words


def unicode_and_word_findings(counts: DataFrame, shape: DataFrame) -> DataFrame:
    """Findings on normal form and spelled-out numbers from value counts ``column, value, n``.

    ``shape`` gives ``column, total, distinct, numbers`` per column (one row per column).
    """
    # Only cells with a non-ASCII character can be in another normal form; only cells
    # that are not numbers can be number words.
    odd = counts.filter(F.col("value").rlike(r"[^\x00-\x7F]")).filter(words.nfc("value") != F.col("value"))
    unnormalised = odd.groupBy("column").agg(F.sum("n").alias("affected"))
    plain = counts.filter(numbers.to_double(F.col("value")).isNull())
    spelled = plain.filter(words.spoken_numbers("value").isNotNull()).groupBy("column").agg(F.sum("n").alias("affected"))
    totals = F.broadcast(shape.select("column", "total", "distinct", "numbers", "filled"))
    spelled = spelled.join(totals, "column").filter(
        (F.col("distinct") >= 2)
        & ((F.col("affected") + F.coalesce(F.try_divide("numbers", "filled"), F.lit(0.0)) * F.col("total")) / F.col("total") >= numbers.NUMERIC_SHARE)
    )
    shared = ["column", "rule_id", "affected", "total", "detail"]
    return (
        unnormalised.join(totals, "column")
        .select("column", F.lit("normalize_unicode_nfc").alias("rule_id"), "affected", "total", F.lit("").alias("detail"))
        .unionByName(
            spelled.select("column", F.lit("cast_words_to_numbers").alias("rule_id"), "affected", "total", F.lit("").alias("detail"))
        )
        .select(*shared)
    )
