"""Profiling queries (PRF)."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.functions import pii
from metricloom.operators import profile
from metricloom.plans.registry import cells_sql, number_sql, query

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
PART_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
CUSTOMER_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
N = number_sql("value")


def _shape_sql(table: str, columns: list[str]) -> str:
    return f"""
      cells AS {cells_sql(table, columns)},
      counts AS (SELECT "column", value, count(*) AS n FROM cells GROUP BY 1, 2),
      shape AS (
        SELECT "column", count(*) AS row_count, count(value) AS non_null,
          round(100.0 * (count(*) - count(value)) / count(*), 2) AS null_pct,
          count(DISTINCT value) AS "distinct",
          coalesce(round(sum(length(value))::DOUBLE / nullif(count(value), 0), 2), 0.0) AS avg_length,
          coalesce(round(count({N})::DOUBLE / nullif(count(value), 0), 4), 0.0) AS numeric_share,
          min({N}) AS min_number, max({N}) AS max_number, min(value) AS min_text, max(value) AS max_text
        FROM cells GROUP BY 1),
      ranked AS (
        SELECT "column", value, n, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank
        FROM counts WHERE value IS NOT NULL),
      numeric_cells AS (
        SELECT c."column", {N} AS x FROM cells c JOIN shape s USING ("column")
        WHERE s.numeric_share >= 0.9 AND {N} IS NOT NULL),
      quartiles AS (
        SELECT "column", quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM numeric_cells GROUP BY 1),
      outliers AS (
        SELECT "column", CASE WHEN count(*) < 4 THEN 0 ELSE
          count(*) FILTER (WHERE q3 > q1 AND (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1))) END AS outlier_count
        FROM numeric_cells JOIN quartiles USING ("column") GROUP BY 1)"""


@query(
    "prf1_profile_columns",
    f"""WITH {_shape_sql("orders", ORDER_COLUMNS)},
    tops AS (SELECT "column", string_agg(value || '=' || n, '; ' ORDER BY rank) AS top_values FROM ranked WHERE rank <= 5 GROUP BY 1)
    SELECT s."column", non_null, null_pct, "distinct", avg_length, numeric_share,
      CASE WHEN numeric_share >= 0.9 THEN CAST(min_number AS VARCHAR) ELSE min_text END AS min_value,
      CASE WHEN numeric_share >= 0.9 THEN CAST(max_number AS VARCHAR) ELSE max_text END AS max_value,
      top_values, coalesce(outlier_count, 0) AS outlier_count
    FROM shape s LEFT JOIN tops USING ("column") LEFT JOIN outliers USING ("column")""",
)
def _(t):
    out = profile.profile_columns(t.orders.select(ORDER_COLUMNS))
    return out.withColumn("top_values", F.array_join("top_values", "; "))


@query(
    "prf2_top_values",
    f"""WITH {_shape_sql("part", PART_COLUMNS)}
    SELECT "column", rank, value, n FROM ranked WHERE rank <= 5""",
)
def _(t):
    return profile.top_values(t.part)


# Cells of mixed content: the same rule makes them on both sides.
_MIXED = "CASE WHEN p_size % 7 = 0 THEN p_brand ELSE CAST(p_size AS STRING) END AS mixed"


@query(
    "prf3_numeric_view",
    f"""WITH src AS (SELECT p_name, CAST(p_retailprice AS VARCHAR) AS price,
        CASE WHEN p_size % 7 = 0 THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS mixed FROM part),
    cells AS {cells_sql("src", ["p_name", "price", "mixed"])}
    SELECT "column", count(value) AS non_null, count({N}) AS numbers, round(count({N})::DOUBLE / count(value), 4) AS numeric_share
    FROM cells GROUP BY 1""",
)
def _(t):
    return profile.numeric_view(t.part.selectExpr("p_name", "CAST(p_retailprice AS STRING) AS price", _MIXED))


@query(
    "prf4_outliers",
    f"""WITH {_shape_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])}
    SELECT "column", outlier_count FROM outliers""",
)
def _(t):
    return profile.outliers(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


_EMAIL = r"[a-zA-Z0-9_.%+-]+@[a-zA-Z0-9_.-]+[.][A-Za-z]{2,}"


@query("prf5_pii_columns")
def _(t):
    people = t.customer.select(
        "c_custkey",
        "c_name",
        F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@example.com")).alias("contact"),
        F.lpad((F.col("c_custkey") + 100000000000).cast("string"), 12, "0").alias("bank_account"),
        F.lpad((F.col("c_custkey") + 100000000000).cast("string"), 12, "0").alias("batch"),
        F.concat(F.lit("09"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("note"),
    )
    return profile.pii_flags(people, "c_custkey")


@query(
    "prf5_pii_email_share",
    f"""SELECT count(*) AS cells, count(*) FILTER (WHERE regexp_matches(text, '{_EMAIL}')) AS email_cells FROM documents WHERE text IS NOT NULL""",
)
def _(t):
    return t.documents.filter("text IS NOT NULL").agg(F.count("*").alias("cells"), F.count_if(F.col("text").rlike(pii.pattern("EMAIL"))).alias("email_cells"))


@query(
    "prf6_duplicate_rows",
    """WITH g AS (SELECT l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT sum(n)::BIGINT AS row_count, sum(n - 1)::BIGINT AS duplicate_rows, round(100.0 * sum(n - 1) / sum(n), 2) AS duplicate_rows_pct FROM g""",
)
def _(t):
    return profile.duplicate_rows(t.lineitem.select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"))


@query(
    "prf8_column_roles",
    f"""WITH {_shape_sql("customer", CUSTOMER_COLUMNS)}
    SELECT "column", CASE WHEN non_null = 0 THEN 'text' WHEN numeric_share >= 0.9 THEN 'numeric'
      WHEN "distinct"::DOUBLE / row_count >= 0.9 THEN 'identifier' WHEN "distinct" <= 50 THEN 'categorical' ELSE 'text' END AS role,
      "distinct", non_null FROM shape
    UNION ALL SELECT 'seen', 'temporal', 1, count(*) FROM customer""",
)
def _(t):
    return profile.column_roles(t.customer.withColumn("seen", F.lit("2024-05-01").cast("timestamp")))


_EVENTS_AS_LOG = """SELECT 'activity' AS kind, event_type AS name, count(*) AS events FROM events GROUP BY 2
    UNION ALL SELECT 'resource', CAST(user_id AS VARCHAR), count(*) FROM events GROUP BY 2"""


@query("prf9_event_features", _EVENTS_AS_LOG)
def _(t):
    return profile.event_features(t.events, "event_type", "user_id")


@query(
    "prf9_merged_catalogue",
    f"""WITH a AS (SELECT 'column:' || column_name AS key, role FROM (VALUES ('c_custkey', 'numeric'), ('c_name', 'identifier'),
          ('c_nationkey', 'numeric'), ('c_acctbal', 'numeric'), ('c_mktsegment', 'categorical')) v(column_name, role)),
    e AS ({_EVENTS_AS_LOG})
    SELECT 'customers' AS source, key, role FROM a
    UNION ALL SELECT 'events', 'activity:' || name, '' FROM e WHERE kind = 'activity'
    UNION ALL SELECT 'events', 'column:' || c, r FROM (VALUES ('event_type', 'categorical')) v(c, r)""",
)
def _(t):
    customers = profile.catalogue(t.customer, "customers")
    events = profile.catalogue(t.events.select("event_type"), "events", activity="event_type")
    return profile.merge_catalogues([customers, events]).select("source", "key", "role")


@query(
    "prf10_unknown_choices",
    """SELECT 'activity:' || a AS key FROM (VALUES ('click'), ('no_such_step'), ('refund?')) v(a)
    WHERE a NOT IN (SELECT event_type FROM events)""",
)
def _(t):
    keys = t.spark.createDataFrame([("activity:click",), ("activity:no_such_step",), ("activity:refund?",)], "key string")
    known = profile.event_features(t.events, "event_type").select(F.concat_ws(":", "kind", "name").alias("key"))
    return profile.unknown_choices(keys, known)


@query(
    "prf11_bi_fields",
    """SELECT 'o_custkey' AS "column", 'measure' AS role, 'number' AS kind, count(DISTINCT o_custkey) AS "distinct" FROM orders
    UNION ALL SELECT 'o_orderstatus', 'dimension', 'text', count(DISTINCT o_orderstatus) FROM orders
    UNION ALL SELECT 'o_totalprice', 'measure', 'number', count(DISTINCT o_totalprice) FROM orders
    UNION ALL SELECT 'o_orderdate', 'dimension', 'date', count(DISTINCT o_orderdate) FROM orders
    UNION ALL SELECT 'o_orderpriority', 'dimension', 'text', count(DISTINCT o_orderpriority) FROM orders
    UNION ALL SELECT 'urgent', 'dimension', 'boolean', count(DISTINCT o_orderpriority LIKE '1%') FROM orders
    UNION ALL SELECT 'day_text', 'dimension', 'date', count(DISTINCT o_orderdate) FROM orders
    UNION ALL SELECT 'price_text', 'measure', 'number', count(DISTINCT o_totalprice) FROM orders""",
)
def _(t):
    orders = t.orders.withColumns(
        {
            "urgent": F.col("o_orderpriority").startswith("1").cast("int").cast("string"),
            "day_text": F.date_format("o_orderdate", "yyyy-MM-dd"),
            "price_text": F.col("o_totalprice").cast("string"),
        }
    )
    return profile.bi_fields(orders, "o_orderkey")


@query(
    "prf12_measures_and_groups",
    """WITH s AS (
      SELECT 'l_' || c AS "column", dx, nx, lo, hi, whole, n FROM (
        SELECT 'linenumber' AS c, count(DISTINCT l_linenumber) dx, count(l_linenumber) nx, min(l_linenumber)::DOUBLE lo, max(l_linenumber)::DOUBLE hi, true whole, count(*) n FROM lineitem
        UNION ALL SELECT 'quantity', count(DISTINCT l_quantity), count(l_quantity), min(l_quantity), max(l_quantity), true, count(*) FROM lineitem
        UNION ALL SELECT 'discount', count(DISTINCT l_discount), count(l_discount), min(l_discount), max(l_discount), false, count(*) FROM lineitem))
    SELECT "column", dx > 1 AND NOT (nx >= 2 AND dx = nx AND whole AND nx / (hi - lo + 1) >= 0.95) AS is_measure, dx BETWEEN 2 AND 5 AND dx < n AS is_group FROM s
    UNION ALL SELECT 'l_returnflag', false, count(DISTINCT l_returnflag) BETWEEN 2 AND 12 FROM lineitem
    UNION ALL SELECT 'l_linestatus', false, count(DISTINCT l_linestatus) BETWEEN 2 AND 12 FROM lineitem""",
)
def _(t):
    return profile.measurable_and_grouping(
        t.lineitem.select("l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
    )


@query(
    "prf12_counter",
    """SELECT 'o_orderkey' AS "column", NOT (count(DISTINCT o_orderkey) = count(*) AND count(*) / (max(o_orderkey) - min(o_orderkey) + 1.0) >= 0.95) AS is_measure,
      false AS is_group FROM orders
    UNION ALL SELECT 'o_totalprice', true, false""",
)
def _(t):
    return profile.measurable_and_grouping(t.orders.select("o_orderkey", "o_totalprice"))


@query(
    "prf13_groupable_columns",
    """SELECT * FROM (
      SELECT 'p_brand' AS "column", count(DISTINCT p_brand) AS "distinct" FROM part
      UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part
      UNION ALL SELECT 'p_name', count(DISTINCT p_name) FROM part)
    WHERE "distinct" BETWEEN 2 AND 20 AND "distinct" * 2 <= (SELECT count(*) FROM part)""",
)
def _(t):
    return profile.groupable_columns(t.part)


@query(
    "prf14_categories",
    """WITH v AS (SELECT 'quality' AS "column", CAST(quality AS VARCHAR) AS value FROM labels GROUP BY 2
      UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR) FROM labels GROUP BY 2)
    SELECT "column", row_number() OVER (PARTITION BY "column" ORDER BY CAST(value AS DOUBLE)) AS position, value FROM v""",
)
def _(t):
    return profile.categories(t.labels)


@query(
    "prf15_temporal_columns",
    """SELECT * FROM (VALUES ('o_orderdate', 1.0::DOUBLE), ('day_text', 1.0::DOUBLE), ('quarter', 1.0::DOUBLE), ('year', 1.0::DOUBLE)) v("column", share)""",
)
def _(t):
    return profile.temporal_columns(
        t.orders.select(
            "o_orderstatus",
            "o_totalprice",
            "o_orderdate",
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("day_text"),
            F.concat(F.year("o_orderdate"), F.lit("-Q"), F.quarter("o_orderdate")).alias("quarter"),
            F.year("o_orderdate").alias("year"),
        )
    )


@query(
    "prf16_period_columns",
    """WITH q AS (SELECT DISTINCT year(o_orderdate) AS y, quarter(o_orderdate) AS q FROM orders)
    SELECT 'period' AS "column", row_number() OVER (ORDER BY y, q) AS position, 'Q' || q || '-' || y AS value, y AS year, q * 3 AS month FROM q
    UNION ALL
    SELECT 'year', row_number() OVER (ORDER BY y), CAST(y AS VARCHAR), y, 12 FROM (SELECT DISTINCT y FROM q)""",
)
def _(t):
    quarter = F.concat(F.lit("Q"), F.quarter("o_orderdate"), F.lit("-"), F.year("o_orderdate"))
    return profile.period_columns(
        t.orders.select(quarter.alias("period"), F.year("o_orderdate").alias("year"), "o_orderstatus")
    )


def dirty_parts(t):
    """Parts with untrimmed names, re-cased brands, sentinels and numbers as text."""
    return t.part.selectExpr(
        "p_partkey",
        "CASE WHEN p_partkey % 3 = 0 THEN concat('  ', p_name, ' ') ELSE p_name END AS name",
        "CASE WHEN p_partkey % 5 = 0 THEN upper(p_type) WHEN p_partkey % 5 = 1 THEN lower(p_type) ELSE p_type END AS kind",
        "CASE WHEN p_size % 10 = 0 THEN 'N/A' WHEN p_size % 10 = 1 THEN '-' ELSE CAST(p_size AS STRING) END AS size",
        "date_format(date_add(DATE'2020-01-01', CAST(p_partkey % 700 AS INT)), 'yyyy-MM-dd') AS made",
    )


DIRTY_PARTS_SQL = """(SELECT p_partkey,
    CASE WHEN p_partkey % 3 = 0 THEN '  ' || p_name || ' ' ELSE p_name END AS name,
    CASE WHEN p_partkey % 5 = 0 THEN upper(p_type) WHEN p_partkey % 5 = 1 THEN lower(p_type) ELSE p_type END AS kind,
    CASE WHEN p_size % 10 = 0 THEN 'N/A' WHEN p_size % 10 = 1 THEN '-' ELSE CAST(p_size AS VARCHAR) END AS size,
    strftime(DATE '2020-01-01' + CAST(p_partkey % 700 AS INTEGER), '%Y-%m-%d') AS made FROM part)"""

#: SQL twin of "which form is kept": accented, mixed case, frequent, last by alphabet.
CASE_SCORE_SQL = """CASE WHEN regexp_matches({0}, '\\p{{L}}') AND upper({0}) = {0} AND lower({0}) <> {0} THEN 0
    WHEN regexp_matches({0}, '\\p{{Lu}}') THEN 2 ELSE 1 END"""


@query(
    "prf17_examine",
    f"""WITH d AS {DIRTY_PARTS_SQL},
    forms AS (SELECT kind, lower(kind) AS k, count(*) AS n FROM d GROUP BY 1),
    kept AS (SELECT k, arg_max(kind, ({CASE_SCORE_SQL.format("kind")}, n, kind)) AS keep, count(*) AS forms FROM forms GROUP BY 1),
    changed AS (SELECT sum(n) AS rows, count(*) AS forms FROM forms JOIN kept USING (k) WHERE kept.forms > 1 AND kind <> keep),
    name_forms AS (SELECT name, trim(name) AS k, count(*) AS n FROM d GROUP BY 1),
    name_kept AS (SELECT k, arg_max(name, (n, name)) AS keep, count(*) AS forms FROM name_forms GROUP BY 1),
    name_changed AS (SELECT sum(n) AS rows, count(*) AS forms FROM name_forms JOIN name_kept USING (k) WHERE name_kept.forms > 1 AND name <> keep),
    total AS (SELECT count(*) AS total FROM d)
    SELECT 'name' AS "column", 'trim_whitespace' AS rule_id, count(*) FILTER (WHERE name <> trim(name)) AS affected, count(*) AS total, '' AS detail FROM d
    UNION ALL SELECT 'name', 'merge_text_variants', rows::BIGINT, total, CAST(forms + 1 AS VARCHAR) FROM name_changed, total
    UNION ALL SELECT 'kind', 'merge_text_variants', rows::BIGINT, total, CAST(forms + 1 AS VARCHAR) FROM changed, total
    UNION ALL SELECT 'size', 'replace_sentinel_with_null', count(*) FILTER (WHERE size IN ('N/A', '-')), count(*), '-, n/a' FROM d
    UNION ALL SELECT 'size', 'cast_numeric_safe', count(*), count(*), '' FROM d
    UNION ALL SELECT 'made', 'standardize_datetime', count(*), count(*), '' FROM d""",
)
def _(t):
    return profile.examine(dirty_parts(t).drop("p_partkey").withColumn("id", F.col("made").isNull().cast("string")).drop("id"), unicode_forms=False).filter(
        "rule_id <> 'drop_exact_duplicates'"
    )


@query("prf17_examine_unicode")
def _(t):
    decomposed = F.translate(F.regexp_replace("text", "é", "é"), "\u0000", "")
    words = F.element_at(
        F.array(*[F.lit(w) for w in ("hai trăm linh năm", "mười hai", "ba nghìn", "7", "một triệu rưỡi")]),
        (F.col("doc_id") % 5 + 1).cast("int"),
    )
    return profile.examine(
        t.documents.select(
            F.when(F.col("doc_id") % 2 == 0, decomposed).otherwise(F.col("text")).alias("text"), words.alias("amount"), "lang"
        )
    )


@query("prf18_period_layout")
def _(t):
    wide = (
        t.orders.withColumn("customer", F.concat(F.lit("customer "), F.col("o_custkey")))
        .groupBy("customer")
        .pivot("o_orderstatus", ["F", "O", "P"])
        .agg(F.sum("o_totalprice"))
        .toDF("customer", "Q1-2026", "Q2-2026", "Q3-2026")
    )
    return profile.period_layout(wide).withColumn("periods", F.array_join("periods", ", "))


@query(
    "prf19_column_statistics",
    f"""WITH {_shape_sql("supplier", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"])}
    SELECT "column", CASE "column" WHEN 's_suppkey' THEN 'bigint' WHEN 's_nationkey' THEN 'int' WHEN 's_acctbal' THEN 'double' ELSE 'string' END AS dtype,
      row_count, null_pct, "distinct", avg_length FROM shape""",
)
def _(t):
    return profile.column_statistics(t.supplier)
