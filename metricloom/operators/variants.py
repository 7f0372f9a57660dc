"""Spellings of one value: which form to keep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions import text


def _case_score(form: Column) -> Column:
    letters = form.rlike(r"\p{L}")
    upper = form.rlike(r"\p{Lu}")
    lower_or_other = F.regexp_replace(form, r"[^\p{L}]|\p{Lu}", "") != ""
    return F.when(letters & upper & lower_or_other, 2).when(letters & upper, 0).otherwise(1)


def canonical_forms(counts: DataFrame, keys: Sequence[str], form: str, count: str) -> DataFrame:
    """Forms to rewrite: ``keys, form, kept, count``.

    Forms that fold to the same words are one value. The kept form is the most
    informative one: accented, then mixed case, then frequent, then last by alphabet.
    Works on value counts, so one group holds the distinct spellings of one value.
    """
    keyed = counts.withColumn("_key", text.fold(F.col(form))).filter("_key <> ''")
    rank = F.struct(text.accented(F.col(form)).cast("int"), _case_score(F.col(form)), F.col(count), F.col(form))
    best = keyed.groupBy(*keys, "_key").agg(F.max_by(form, rank).alias("kept"), F.count("*").alias("_forms"))
    best = best.filter("_forms > 1").drop("_forms")
    return (
        keyed.join(best, [*keys, "_key"])
        .filter(F.col(form) != F.col("kept"))
        .select(*keys, form, "kept", count)
    )
