"""Personal data: finding, stable masking, leak checks and safe samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom import scale
from metricloom.functions import pii
from metricloom.operators.profile import _quoted, _types, cells, column_statistics

MAX_SAMPLE_ROWS = 20


def find_pii(df: DataFrame, key: str, source: str) -> DataFrame:
    """``key, position, kind, value`` of every hit, in the order the patterns claim text."""
    found = df.select(key, F.posexplode(pii.hits(_quoted(source))).alias("position", "hit"))
    return found.select(key, "position", "hit.kind", "hit.value")


def pii_kinds(df: DataFrame, key: str, source: str) -> DataFrame:
    """``key, kinds``: the sorted kinds present in each text."""
    kinds = F.array_sort(F.array_distinct(F.transform(pii.hits(_quoted(source)), lambda h: h["kind"])))
    return df.select(key, kinds.alias("kinds"))


def _guarded(column: str) -> tuple[str, ...]:
    """Weak digit kinds are masked only where the column name hints at personal data."""
    return tuple(k for k, _ in pii.PATTERNS) if pii.name_suggests_pii(column) else pii.STRONG


def _masking_hits(source: Column, kinds: Sequence[str]) -> tuple[Column, Column]:
    """Hits in masking order, and the text with each hit replaced by a marker of its kind."""
    found, working = [], source
    for kind in kinds:
        found.append(pii.tagged(kind, pii.extract(kind, working)))
        working = pii.take_out(kind, working, f"\u0001{kind}\u0002")
    return F.concat(*found), working


def token_table(df: DataFrame, row_id: str, columns: Sequence[str]) -> DataFrame:
    """``kind, value, token``: numbered per kind by first appearance (row, then column, then place).

    Numbering runs over distinct values and splits a kind that is too large for one task.
    """
    rows = []
    for i, c in enumerate(columns):
        hits, _ = _masking_hits(_quoted(c), _guarded(c))
        rows.append(df.filter(_quoted(c).isNotNull()).select(F.col(row_id).alias("_row"), F.lit(i).alias("_col"), F.posexplode(hits).alias("_at", "h")))
    from metricloom.operators.common import stacked

    firsts = stacked(rows).groupBy(F.col("h.kind").alias("kind"), F.col("h.value").alias("value")).agg(F.min(F.struct("_row", "_col", "_at")).alias("_first"))
    numbered = scale.Sequenced(firsts, ["kind"], ["_first"]).with_position("_n").rows()
    return numbered.select("kind", "value", F.format_string("<%s_%d>", "kind", "_n").alias("token"))


def mask_rows(df: DataFrame, row_id: str, columns: Sequence[str] | None = None, tokens: DataFrame | None = None) -> DataFrame:
    """The table with every hit replaced by its stable token.

    Hits are joined to their tokens (the planner sizes that join); the tokens of one cell
    return as a short map and are put back in order, inside the row.
    """
    kinds = _types(df)
    columns = [c for c in (columns or df.columns) if isinstance(kinds[c], T.StringType)]
    tokens = token_table(df, row_id, columns) if tokens is None else tokens
    out = df
    for c in columns:
        hits, _ = _masking_hits(_quoted(c), _guarded(c))
        found = df.filter(_quoted(c).isNotNull()).select(F.col(row_id).alias("_row"), F.posexplode(hits).alias("_at", "h"))
        named = found.select("_row", "_at", "h.kind", "h.value").join(tokens, ["kind", "value"])
        # One cell's hits: bounded by the length of its text.
        per_cell = named.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", "kind", "token"))).alias("_tokens"))
        joined = out.join(per_cell, out[row_id] == per_cell["_row"], "left").drop("_row")
        out = joined.withColumn(c, _put_back(_quoted(c), F.col("_tokens"), _guarded(c))).drop("_tokens")
    return out


def _of_kind(tokens: Column, kind: str) -> Column:
    known = F.coalesce(tokens, F.array().cast("array<struct<_at:int,kind:string,token:string>>"))
    return F.transform(F.filter(known, lambda t: t["kind"] == kind), lambda t: t["token"])


def _fill(marked: Column, mark: str, names: Column) -> Column:
    """Replace the n-th marker by the n-th name."""
    joined = F.zip_with(F.split(marked, mark), names, lambda piece, name: F.concat(F.coalesce(piece, F.lit("")), F.coalesce(name, F.lit(""))))
    return F.array_join(joined, "")


def _put_back(source: Column, tokens: Column, kinds: Sequence[str]) -> Column:
    """Replace the markers of each kind, in order, by the cell's tokens of that kind."""
    _, marked = _masking_hits(source, kinds)
    for kind in kinds:
        marked = _fill(marked, f"\u0001{kind}\u0002", _of_kind(tokens, kind))
    return F.when(source.isNotNull(), marked)


def leaks(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, kind, cells``: strong kinds still present. An empty result is a clean table."""
    found = cells(df, columns).filter("value IS NOT NULL")
    flags = pii.kinds(F.col("value"))
    counted = found.groupBy("column").agg(*[F.count_if(flags[k]).alias(k) for k in pii.STRONG])
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("cells")) for k in pii.STRONG])
    return counted.select("column", F.explode(rows).alias("r")).select("column", "r.kind", "r.cells").filter("cells > 0")


def assert_no_pii(df: DataFrame, columns: Sequence[str] | None = None) -> None:
    found = leaks(df, columns).limit(5).collect()
    if found:
        raise ValueError(f"unmasked values remain: {[(r['column'], r['kind'], r['cells']) for r in found]}")


def safe_sample(df: DataFrame, row_id: str, pii_columns: Sequence[str], rows: int = MAX_SAMPLE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Statistics of every column, and at most 20 masked rows of the columns that are not flagged."""
    safe = [c for c in df.columns if c not in set(pii_columns)]
    first = df.select(*[_quoted(c) for c in dict.fromkeys([row_id, *safe])]).orderBy(row_id).limit(min(rows, MAX_SAMPLE_ROWS))
    return column_statistics(df), mask_rows(first, row_id, [c for c in safe if c != row_id])


