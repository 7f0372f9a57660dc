"""Column profiles, roles and diagnosis.

What can be summed cell by cell is summed where the cells are; how many different values a column has, which are the most common and
where its quartiles lie is counted on hashes and brackets (``counting``). Only the rules that group values by their
spelling start from a table of value counts ``(column, value, n)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom import scale
from metricloom.functions import dates, numbers, pii, text
from metricloom.operators import counting
from metricloom.operators import variants as spelling
from metricloom.operators.words import unicode_and_word_findings

TOP_VALUES = 5
OUTLIER_SPREAD = 1.5
PII_SHARE = 0.2
IDENTIFIER_SHARE = 0.9
MAX_CATEGORIES = 50
COUNTER_DENSITY = 0.95
LABEL_SHARE = 0.8

# Fixed pattern: a column name that is a period (quarter, half, month or year).
_YEAR, _YY, _SEP = r"(?:19|20)\d{2}", r"(?:(?:19|20)?\d{2})", r"\s*[-/._ ]?\s*"
PERIOD_HEADER = (
    rf"(?iu)^\s*(?:(?:q|quý|quy)\s*[1-4]{_SEP}{_YY}|{_YEAR}{_SEP}(?:q|quý|quy)\s*[1-4]"
    rf"|(?:h|bán niên|ban nien)\s*[12]{_SEP}{_YEAR}|(?:năm|nam|fy)?\s*{_YEAR}"
    rf"|(?:t|tháng|thang)\s*(?:0?[1-9]|1[0-2]){_SEP}{_YY}|(?:0?[1-9]|1[0-2])\s*[-/.]\s*{_YEAR}"
    rf"|{_YEAR}\s*[-/.]\s*(?:0[1-9]|1[0-2]))\s*$"
)


_quoted, _types, _as_text = counting.quoted, counting.types_of, counting.as_text


def cells(df: DataFrame, columns: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """One row per cell: ``keep..., column, value`` (text, NaN is null)."""
    columns = list(columns or [c for c in df.columns if c not in keep])
    entries = [F.struct(F.lit(c).alias("column"), _as_text(df, c).alias("value")) for c in columns]
    return df.select(*keep, F.explode(F.array(*entries)).alias("_cell")).select(*keep, "_cell.column", "_cell.value")


def value_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, value, n`` with the value null kept as a row of its own."""
    return scale.value_counts(cells(df, columns), ["column"], "value")


def _weighted(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("n")).otherwise(0))


def column_shape(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: counts, shares, distinct values, length and both kinds of extremes."""
    columns = list(columns if columns is not None else df.columns)
    fields = lambda d, c: [F.length(_as_text(d, c)).alias("chars"), counting.as_number(d, c).alias("x")]
    sums = counting.unpivot(df, columns, fields).groupBy("at").agg(
        F.count("*").alias("row_count"), F.count("chars").alias("non_null"), F.sum("chars").alias("_chars"), F.count("x").alias("_numeric"),
        F.min("x").alias("min_number"), F.max("x").alias("max_number"),
    )
    # without a key, extremes of texts need no sort
    ends = df.agg(*[f(_as_text(df, c)).alias(f"{n}{k}") for k, c in enumerate(columns) for f, n in ((F.min, "l"), (F.max, "h"))])
    texts = ends.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"l{k}").alias("min_text"), F.col(f"h{k}").alias("max_text")) for k, c in enumerate(columns)])).alias("e")).select("e.*")
    distinct = counting.distinct_counts(df, columns)
    # one row per column on every side
    return (
        counting.named(sums, columns).join(F.broadcast(distinct), "column").join(F.broadcast(texts), "column")
        .withColumn("null_pct", F.round(100.0 * (F.col("row_count") - F.col("non_null")) / F.col("row_count"), 2))
        .withColumn("avg_length", F.coalesce(F.round(F.try_divide("_chars", "non_null"), 2), F.lit(0.0)))
        .withColumn("numeric_share", F.coalesce(F.round(F.try_divide("_numeric", "non_null"), 4), F.lit(0.0)))
        .drop("_chars", "_numeric")
    )


def top_values(df: DataFrame, columns: Sequence[str] | None = None, limit: int = TOP_VALUES) -> DataFrame:
    """The most common values per column, ties by value: ``column, rank, value, n``."""
    return counting.top_values(df, list(columns or df.columns), limit)


def numeric_view(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of the present cells of each column that read as a number (one scan, no value shuffle)."""
    columns = list(columns or df.columns)
    kinds = _types(df)
    picks = []
    for i, name in enumerate(columns):
        picks.append(F.count(_as_text(df, name)).alias(f"p{i}"))
        picks.append(F.count(numbers.numeric(_quoted(name), kinds[name])).alias(f"n{i}"))
    one = df.agg(*picks)
    rows = [
        F.struct(F.lit(c).alias("column"), F.col(f"p{i}").alias("non_null"), F.col(f"n{i}").alias("numbers"))
        for i, c in enumerate(columns)
    ]
    return (
        one.select(F.explode(F.array(*rows)).alias("r"))
        .select("r.*")
        .withColumn("numeric_share", F.coalesce(F.round(F.try_divide("numbers", "non_null"), 4), F.lit(0.0)))
    )


def numeric_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Names of the columns whose cells are numbers (at least 90 %). Typed columns need no scan."""
    columns = list(columns or df.columns)
    kinds = _types(df)
    doubtful = [c for c in columns if isinstance(kinds[c], T.StringType)]
    text_numbers = set()
    if doubtful:
        found = numeric_view(df, doubtful).filter(F.col("numeric_share") >= numbers.NUMERIC_SHARE)
        text_numbers = {r["column"] for r in found.collect()}  # at most one row per column
    return [c for c in columns if c in text_numbers or numbers.is_number_type(kinds[c])]


def outliers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Numbers outside 1.5 interquartile ranges: ``column, outlier_count``, for columns that have numbers."""
    columns = list(columns if columns is not None else df.columns)
    found = {r["column"]: r for r in counting.quantiles(df, columns, {"q1": 0.25, "q3": 0.75}).collect()}  # one row per column
    schema = "column string, outlier_count bigint"
    if not found:
        return df.sparkSession.createDataFrame([], schema)
    picks = []
    for k, (name, r) in enumerate(found.items()):
        spread, x = r["q3"] - r["q1"], counting.as_number(df, name)
        beyond = (x < r["q1"] - OUTLIER_SPREAD * spread) | (x > r["q3"] + OUTLIER_SPREAD * spread)
        picks.append((F.count_if(beyond) if spread > 0 and r["n"] >= 4 else F.lit(0)).cast("bigint").alias(f"o{k}"))
    rows = F.array(*[F.struct(F.lit(name).alias("column"), F.col(f"o{k}").alias("outlier_count")) for k, name in enumerate(found)])
    return df.agg(*picks, F.count("*").alias("_")).select(F.explode(rows).alias("r")).select("r.*")


def pii_flags(df: DataFrame, row_id: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Whether each column looks like personal data, judged on all present cells."""
    columns = list(columns or [c for c in df.columns if c != row_id])
    present = cells(df, columns).filter(F.col("value").isNotNull())
    flags = pii.kinds(F.col("value"))
    strong = pii.any_of(flags, pii.STRONG)
    weak = ~strong & pii.any_of(flags, tuple(k for k in flags if k not in pii.STRONG))
    hinted = F.col("column").isin([c for c in columns if pii.name_suggests_pii(c)])
    return present.groupBy("column").agg(
        F.avg(strong.cast("int")).alias("_s"), F.avg(weak.cast("int")).alias("_w")
    ).select(
        "column",
        F.round("_s", 4).alias("strong_share"),
        F.round("_w", 4).alias("weak_share"),
        ((F.col("_s") >= PII_SHARE) | ((F.col("_w") >= PII_SHARE) & hinted)).alias("is_pii"),
    )


def profile_columns(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """The full profile, one row per column."""
    columns = [c for c in df.columns if c != row_id] if row_id else df.columns
    shape = column_shape(df, columns)
    numeric = F.col("numeric_share") >= numbers.NUMERIC_SHARE
    common = top_values(df, columns).groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("_top")  # at most 5 per column
    )
    out = (
        shape.join(F.broadcast(common), "column", "left")
        .join(F.broadcast(outliers(df, numeric_columns(df, columns))), "column", "left")
        .select(
            "column", "non_null", "null_pct", "distinct", "avg_length", "numeric_share",
            F.when(numeric, F.col("min_number").cast("string")).otherwise(F.col("min_text")).alias("min_value"),
            F.when(numeric, F.col("max_number").cast("string")).otherwise(F.col("max_text")).alias("max_value"),
            F.transform("_top", lambda t: F.concat(t["value"], F.lit("="), t["n"].cast("string"))).alias("top_values"),
            F.coalesce("outlier_count", F.lit(0).cast("bigint")).alias("outlier_count"),
        )
    )
    if row_id:
        flags = pii_flags(df, row_id, columns).select("column", "is_pii")
        out = out.join(F.broadcast(flags), "column", "left").fillna({"is_pii": False})
    return out


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """How many rows repeat an earlier one."""
    groups = df.groupBy(*[_quoted(c) for c in (columns or df.columns)]).agg(F.count("*").alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    ).withColumn(
        "duplicate_rows_pct",
        F.coalesce(F.round(F.try_divide(100.0 * F.col("duplicate_rows"), F.col("row_count")), 2), F.lit(0.0)),
    )


def _temporal(df: DataFrame) -> list[str]:
    return [
        n for n, k in _types(df).items() if isinstance(k, (T.TimestampType, T.TimestampNTZType, T.DateType))
    ]


def column_roles(df: DataFrame) -> DataFrame:
    """``column, role, distinct``: numeric, temporal, identifier, categorical or text."""
    shape = column_shape(df)
    return shape.select(
        "column",
        F.when(F.col("non_null") == 0, "text")
        .when(F.col("column").isin(_temporal(df)), "temporal")
        .when(F.col("numeric_share") >= numbers.NUMERIC_SHARE, "numeric")
        .when(F.try_divide("distinct", "row_count") >= IDENTIFIER_SHARE, "identifier")
        .when(F.col("distinct") <= MAX_CATEGORIES, "categorical")
        .otherwise("text")
        .alias("role"),
        "distinct",
        "non_null",
    )


def event_features(df: DataFrame, activity: str, resource: str | None = None) -> DataFrame:
    """Activities and resources with their number of events: ``kind, name, events``."""
    out = None
    for kind, column in (("activity", activity), ("resource", resource)):
        if not column or column not in df.columns:
            continue
        part = (
            df.filter(F.col(column).isNotNull())
            .groupBy(F.col(column).cast("string").alias("name"))
            .agg(F.count("*").alias("events"))
            .select(F.lit(kind).alias("kind"), "name", "events")
        )
        out = part if out is None else out.unionByName(part)
    return out


def catalogue(df: DataFrame, source: str, activity: str | None = None, resource: str | None = None) -> DataFrame:
    """Everything that can be chosen for an analysis: ``source, key, kind, name, role, detail``."""
    roles = column_roles(df).select(
        F.lit("column").alias("kind"),
        F.col("column").alias("name"),
        "role",
        F.concat(F.col("distinct").cast("string"), F.lit(" distinct")).alias("detail"),
    )
    if activity:
        roles = roles.unionByName(
            event_features(df, activity, resource).select(
                "kind", "name", F.lit("").alias("role"), F.concat(F.col("events").cast("string"), F.lit(" events")).alias("detail")
            )
        )
    return roles.select(F.lit(source).alias("source"), F.concat_ws(":", "kind", "name").alias("key"), "*")


def merge_catalogues(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of catalogues; of equal keys the first catalogue's entry stays."""
    stacked = None
    for i, part in enumerate(parts):
        tagged = part.withColumn("_order", F.lit(i))
        stacked = tagged if stacked is None else stacked.unionByName(tagged)
    first = Window.partitionBy("key").orderBy("_order")
    return stacked.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_order")


def unknown_choices(keys: DataFrame, known: DataFrame) -> DataFrame:
    """Chosen keys that are not in the catalogue. An empty result means the choice is valid."""
    return keys.select("key").distinct().join(known.select("key"), "key", "left_anti")


def bi_fields(df: DataFrame, row_id: str) -> DataFrame:
    """Role and kind of every column for drag-and-drop queries: ``column, role, kind, distinct``."""
    kinds = _types(df)
    names = [c for c in df.columns if c != row_id]
    fields = lambda d, c: [F.coalesce(text.strip(_as_text(d, c)) != "", F.lit(False)).alias("filled"), counting.as_number(d, c).alias("x")]
    sums = counting.unpivot(df, names, fields).groupBy("at").agg(
        F.count_if("filled").alias("_filled"),
        F.count("x").alias("_numbers"),
        F.coalesce(F.bool_and(F.col("x").isin(0.0, 1.0)), F.lit(False)).alias("_flag"),
    )
    shape = counting.named(sums, names).join(F.broadcast(counting.distinct_counts(df, names)), "column")
    words = [c for c in names if isinstance(kinds[c], T.StringType)]
    if words:
        filled = cells(df, words).withColumn("value", text.strip(F.col("value"))).filter("value <> ''")
        parsed = filled.groupBy("column").agg(F.avg(dates.parse_mixed(F.col("value")).isNotNull().cast("int")).alias("_dates"))
        shape = shape.join(F.broadcast(parsed), "column", "left")
    else:
        shape = shape.withColumn("_dates", F.lit(None).cast("double"))
    column = F.col("column")
    typed_number = column.isin([c for c in names if numbers.is_number_type(kinds[c])])
    kind = (
        F.when(column.isin([c for c in names if isinstance(kinds[c], T.BooleanType)]), "boolean")
        .when(column.isin(_temporal(df)), "date")
        .when(typed_number & F.col("_flag"), "boolean")
        .when(typed_number, "number")
        .when(F.col("_filled") == 0, "text")
        .when((F.try_divide("_numbers", "_filled") >= numbers.NUMERIC_SHARE) & F.col("_flag"), "boolean")
        .when(F.try_divide("_numbers", "_filled") >= numbers.NUMERIC_SHARE, "number")
        .when(F.col("_dates") >= numbers.NUMERIC_SHARE, "date")
        .otherwise("text")
    )
    return shape.select("column", kind.alias("kind"), "distinct").select(
        "column", F.when(F.col("kind") == "number", "measure").otherwise("dimension").alias("role"), "kind", "distinct"
    )


def measurable_and_grouping(df: DataFrame) -> DataFrame:
    """``column, is_measure, is_group``: what statistics may use as a number and as a group."""
    names = df.columns
    fields = lambda d, c: [_as_text(d, c).isNotNull().alias("present"), counting.as_number(d, c).alias("x")]
    sums = counting.unpivot(df, names, fields).groupBy("at").agg(
        F.count("*").alias("rows"), F.count_if("present").alias("present"), F.count("x").alias("nx"), F.min("x").alias("lo"), F.max("x").alias("hi"),
        F.bool_and(F.col("x") % 1 == 0).alias("whole"),
    )
    shape = counting.named(sums, names).join(F.broadcast(counting.distinct_counts(df, names)), "column")
    shape = shape.join(F.broadcast(counting.distinct_counts(df, names, counting.as_number, "dx")), "column")
    numeric = F.try_divide("nx", "present") >= numbers.NUMERIC_SHARE
    counter = (
        (F.col("nx") >= 2) & (F.col("dx") == F.col("nx")) & F.col("whole")
        & (F.col("nx") / (F.col("hi") - F.col("lo") + 1) >= COUNTER_DENSITY)
    )
    return shape.filter("present > 0").select(
        "column",
        F.coalesce(numeric & (F.col("dx") > 1) & ~counter, F.lit(False)).alias("is_measure"),
        F.when(numeric, F.col("dx").between(2, 5) & (F.col("dx") < F.col("rows")))
        .otherwise(F.col("distinct").between(2, 12) & (F.col("distinct") < F.col("rows")))
        .alias("is_group"),
    )


def groupable_columns(df: DataFrame, largest: int = 20) -> DataFrame:
    """Text columns with few, often repeated values: ``column, distinct``."""
    kinds = _types(df)
    skip = set(_temporal(df)) | {c for c, k in kinds.items() if numbers.is_number_type(k)}
    names = [c for c in df.columns if c not in skip]
    shape = column_shape(df, names)
    return shape.filter(F.col("distinct").between(2, largest) & (F.col("distinct") * 2 <= F.col("row_count"))).select(
        "column", "distinct"
    )


def categories(df: DataFrame, largest: int = 12) -> DataFrame:
    """Values of the columns with 2..12 of them: ``column, position, value``, numbers first."""
    few = column_shape(df).filter(F.col("distinct").between(2, largest) & (F.col("distinct") * 2 <= F.col("row_count")))
    names = [r["column"] for r in few.select("column").collect()]  # at most one per column
    if not names:
        return df.sparkSession.createDataFrame([], "column string, position int, value string")
    kept = value_table(df, names).filter("value is not null")
    number = numbers.to_double(F.col("value"))
    order = Window.partitionBy("column").orderBy(number.isNull(), number, "value")
    return kept.select("column", F.row_number().over(order).alias("position"), "value")


def temporal_columns(df: DataFrame) -> DataFrame:
    """Columns that hold time: typed, quarter labels, bare years or parseable text."""
    kinds = _types(df)
    picks, names = [], list(df.columns)
    for i, name in enumerate(names):
        column, kind = _quoted(name), kinds[name]
        if isinstance(kind, T.StringType):
            # A quarter column must be quarters nearly everywhere, otherwise cells are parsed one by one.
            share = F.avg(F.when(column.isNotNull(), dates.as_moment(column, kind).isNotNull().cast("int")))
        elif numbers.is_number_type(kind):
            good = column.between(1900, 2200) & (column % 1 == 0)
            share = F.min(F.when(column.isNotNull(), good.cast("int"))).cast("double")
        else:
            share = F.max(F.when(column.isNotNull(), F.lit(1.0 if name in _temporal(df) else 0.0)))
        picks.append(F.coalesce(share, F.lit(0.0)).alias(f"s{i}"))
    one = df.agg(*picks)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("share")) for i, c in enumerate(names)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.column", F.round("r.share", 4).alias("share")).filter(
        F.col("share") >= numbers.NUMERIC_SHARE
    )


def period_columns(df: DataFrame, largest: int | None = None) -> DataFrame:
    """Columns whose distinct values, two or more and at most ``largest``, are all period labels, in time order: ``column, position, value``."""
    texts = counting.unpivot(df, df.columns, lambda d, c: [_as_text(d, c).alias("value")])
    labelled = texts.select("at", (dates.period_key(F.col("value")).isNotNull() | F.col("value").isNull()).alias("ok"))
    names = [r["column"] for r in counting.named(labelled.groupBy("at").agg(F.bool_and("ok").alias("ok")).filter("ok"), df.columns).collect()]  # at most one per column
    if not names:
        return df.sparkSession.createDataFrame([], "column string, position int, value string, year int, month int")
    keyed = value_table(df, names).filter("value is not null").withColumn("key", dates.period_key(F.col("value")))
    good = keyed.groupBy("column").agg(F.count("*").alias("d"))
    few = F.col("d") >= 2 if largest is None else F.col("d").between(2, largest)
    good = good.filter(few).select("column")
    kept = keyed.join(F.broadcast(good), "column", "left_semi")
    order = Window.partitionBy("column").orderBy("key", "value")
    return kept.select(
        "column", F.row_number().over(order).alias("position"), "value", F.col("key.year").alias("year"), F.col("key.month").alias("month")
    )


def examine(df: DataFrame, *, unicode_forms: bool = True) -> DataFrame:
    """Counted findings, one row per column and rule: ``column, rule_id, affected, total, detail``."""
    kinds = _types(df)
    names = [c for c, k in kinds.items() if isinstance(k, T.StringType)]
    counts = value_table(df, names).filter("value is not null")
    bare = text.strip(F.col("value"))
    sentinel = text.is_sentinel(F.col("value"))
    readable = numbers.reads_international(bare) | numbers.reads_local(bare)
    flagged = counts.select(
        "column", "value", "n",
        (F.col("value") != bare).alias("untrimmed"),
        sentinel.alias("sentinel"),
        (readable & (bare != "")).alias("number"),
        (bare != "").alias("filled"),
        text.has_leading_zero(F.col("value")).alias("zeros"),
        F.col("value").rlike(dates.DATE_LIKE).alias("date"),
        F.lower(bare).alias("low"),
    )
    shape = flagged.groupBy("column").agg(
        F.sum("n").alias("total"),
        F.count("value").alias("distinct"),
        _weighted(F.col("untrimmed")).alias("untrimmed"),
        _weighted(F.col("sentinel")).alias("sentinels"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("sentinel"), F.col("low")))), ", ").alias("which"),
        _weighted(F.col("number")).alias("numbers"),
        _weighted(F.col("filled")).alias("filled"),
        _weighted(F.col("number") & ~F.col("sentinel")).alias("numbers_kept"),
        _weighted(F.col("filled") & ~F.col("sentinel")).alias("kept"),
        F.bool_or("zeros").alias("zeros"),
        _weighted(F.col("date")).alias("dates"),
    )
    wordy = shape.filter(F.coalesce(F.try_divide("numbers", "filled"), F.lit(0.0)) < numbers.NUMERIC_SHARE).select("column")
    changes = spelling.canonical_forms(counts.join(F.broadcast(wordy), "column", "left_semi"), ["column"], "value", "n")
    merged = changes.groupBy("column").agg(F.sum("n").alias("variant_rows"), F.count("*").alias("variant_forms"))
    shape = shape.join(F.broadcast(merged), "column", "left")

    share = F.coalesce(F.try_divide("numbers_kept", "kept"), F.lit(0.0))

    def finding(rule: str, affected: Column, detail: Column) -> Column:
        return F.struct(F.lit(rule).alias("rule_id"), affected.cast("bigint").alias("affected"), detail.alias("detail"))

    found = [
        finding("trim_whitespace", F.col("untrimmed"), F.lit("")),
        finding("merge_text_variants", F.coalesce("variant_rows", F.lit(0)), F.coalesce((F.col("variant_forms") + 1).cast("string"), F.lit(""))),
        finding("replace_sentinel_with_null", F.col("sentinels"), F.col("which")),
        finding(
            "cast_numeric_safe",
            F.when((share >= numbers.NUMERIC_SHARE) & (F.col("distinct") / F.col("total") < COUNTER_DENSITY) & ~F.col("zeros"), F.col("total")).otherwise(0),
            F.lit(""),
        ),
        finding("standardize_datetime", F.when(F.col("dates") / F.col("total") >= numbers.NUMERIC_SHARE, F.col("total")).otherwise(0), F.lit("")),
    ]
    rows = shape.select("column", "total", F.explode(F.array(*found)).alias("f")).select("column", "f.rule_id", "f.affected", "total", "f.detail")
    if unicode_forms:
        rows = rows.unionByName(unicode_and_word_findings(counts, shape))
    twice = duplicate_rows(df).select(
        F.lit("(every column)").alias("column"), F.lit("drop_exact_duplicates").alias("rule_id"),
        F.col("duplicate_rows").alias("affected"), F.col("row_count").alias("total"), F.lit("").alias("detail"),
    )
    return rows.unionByName(twice).filter("affected > 0")


def period_layout(df: DataFrame) -> DataFrame:
    """The label column and the period columns of a sideways table; empty when it is not one."""
    import re

    periods = [c for c in df.columns if re.match(PERIOD_HEADER.replace("(?iu)", ""), c, re.IGNORECASE)]
    others = [c for c in df.columns if c not in periods]
    spark = df.sparkSession
    schema = "label string, periods array<string>, distinct bigint"
    if len(periods) < 2 or not others:
        return spark.createDataFrame([], schema)
    names = df.columns

    def meaningful(df: DataFrame, c: str) -> Column:
        cell = _as_text(df, c)
        return F.when((text.strip(cell) != "") & ~text.is_sentinel(cell), text.strip(cell))

    number = lambda d, c: numbers.reads_international(meaningful(d, c)) | numbers.reads_local(meaningful(d, c))
    sums = counting.unpivot(df, names, lambda d, c: [meaningful(d, c).isNotNull().alias("filled"), number(d, c).alias("number")]).groupBy("at").agg(
        F.count_if("filled").alias("n"), F.count_if("number").alias("numbers")
    )
    shape = counting.named(sums, names).join(F.broadcast(counting.distinct_counts(df, names, meaningful)), "column").filter("n > 0")
    numeric = F.col("numbers") / F.col("n") >= numbers.NUMERIC_SHARE
    all_numeric = shape.filter(F.col("column").isin(periods) & numeric).agg((F.count("*") == len(periods)).alias("ok"))
    labels = shape.filter(
        F.col("column").isin(others) & ~numeric & (F.col("distinct") / F.col("n") >= LABEL_SHARE)
    ).orderBy(F.desc("distinct"), F.array_position(F.array(*[F.lit(c) for c in others]), F.col("column"))).limit(1)
    if not all_numeric.first()["ok"]:
        return spark.createDataFrame([], schema)
    return labels.select(
        F.col("column").alias("label"), F.array(*[F.lit(p) for p in periods]).alias("periods"), "distinct"
    )


def column_statistics(df: DataFrame) -> DataFrame:
    """Value-free description of every column."""
    stored = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    return column_shape(df).select(
        "column", stored[F.col("column")].alias("dtype"), "row_count", "null_pct", "distinct", "avg_length"
    )
