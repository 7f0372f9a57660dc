"""Cleaning queries (CLN, NUM1, scalar functions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.functions import dates, numbers, text
from metricloom.operators import clean, profile
from metricloom.operators.clean import ROW_ID, Rule
from metricloom.plans.catalog_profile import CASE_SCORE_SQL, DIRTY_PARTS_SQL, dirty_parts
from metricloom.plans.registry import query


def parts(t):
    return dirty_parts(t).withColumnRenamed("p_partkey", ROW_ID)


def log(df):
    return df.select("rule_id", "column", "row_index", "before", "after")


@query("cln1_trim", f"SELECT p_partkey AS _row_id, trim(name) AS name, kind, size FROM {DIRTY_PARTS_SQL}")
def _(t):
    return clean.trim_whitespace(parts(t), Rule("trim_whitespace"))[0].select(ROW_ID, "name", "kind", "size")


@query(
    "cln1_trim_log",
    f"SELECT 'trim_whitespace' AS rule_id, 'name' AS \"column\", p_partkey AS row_index, name AS \"before\", trim(name) AS \"after\" FROM {DIRTY_PARTS_SQL} WHERE name <> trim(name)",
)
def _(t):
    return log(clean.trim_whitespace(parts(t), Rule("trim_whitespace"))[1])


@query(
    "cln1_trim_documents",
    "SELECT doc_id AS _row_id, regexp_replace(regexp_replace(text, '^[\\s\\p{Z}]+', ''), '[\\s\\p{Z}]+$', '') AS text FROM documents",
)
def _(t):
    df = t.documents.select(F.col("doc_id").alias(ROW_ID), "text")
    return clean.trim_whitespace(df, Rule("trim_whitespace"))[0]


@query("cln2_nfc", "SELECT doc_id AS _row_id, nfc_normalize(text) AS text FROM documents")
def _(t):
    decomposed = F.replace(F.replace("text", F.lit("é"), F.lit("e\u0301")), F.lit("è"), F.lit("e\u0300"))
    df = t.documents.select(F.col("doc_id").alias(ROW_ID), decomposed.alias("text"))
    return clean.normalize_unicode_nfc(df, Rule("normalize_unicode_nfc"))[0]


@query("cln3_sentinels", f"SELECT p_partkey AS _row_id, CASE WHEN size IN ('N/A', '-') THEN NULL ELSE size END AS size FROM {DIRTY_PARTS_SQL}")
def _(t):
    rule = Rule("replace_sentinel_with_null", ("size",), {"sentinels": ["N/A", "-"]})
    return clean.replace_sentinel_with_null(parts(t), rule)[0].select(ROW_ID, "size")


@query(
    "cln4_datetime",
    """SELECT o_orderkey AS _row_id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate - INTERVAL 7 HOUR END AS moment FROM orders""",
)
def _(t):
    day = (
        F.when(F.col("o_orderkey") % 11 == 0, "not a day")
        .when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy/MM/dd"))
        .when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "M/d/yyyy"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    )
    df = t.orders.select(F.col("o_orderkey").alias(ROW_ID), day.alias("moment"))
    return clean.standardize_datetime(df, Rule("standardize_datetime", ("moment",), {"assume_timezone": "Asia/Ho_Chi_Minh"}))[0]


# Prices in three ways of writing; dirty cells every 40 rows.
PRICES = """CASE WHEN o_orderkey % 40 = 0 THEN 'unknown' ELSE us END AS us,
    CASE WHEN o_orderkey % 40 = 0 THEN 'unknown' ELSE translate(us, ',.', '.,') END AS local,
    CASE WHEN o_orderkey % 2 = 0 THEN us ELSE translate(us, ',.', '.,') END AS mixed,
    o_orderpriority AS word"""
PRICES_SQL = f"(SELECT o_orderkey AS _row_id, o_totalprice AS price, {PRICES} FROM (SELECT *, format('{{:,.2f}}', o_totalprice) AS us FROM orders))"


def prices(t):
    return (
        t.orders.withColumn("us", F.format_number("o_totalprice", 2))
        .selectExpr(f"o_orderkey AS {ROW_ID}", "o_totalprice AS price", *[p.strip() for p in PRICES.split(",\n")])
    )


@query(
    "num1_conventions",
    f"""WITH p AS {PRICES_SQL}
    SELECT 'us' AS "column", count(*) AS readable, count(*) FILTER (WHERE us <> 'unknown') AS numeric, 'international' AS convention, NULL AS refusal FROM p
    UNION ALL SELECT 'local', count(*), count(*) FILTER (WHERE us <> 'unknown'), 'local', NULL FROM p
    UNION ALL SELECT 'mixed', count(*), count(*), NULL, 'two ways of writing numbers in one column' FROM p
    UNION ALL SELECT 'word', count(*), 0, NULL, 'not a numeric column' FROM p""",
)
def _(t):
    found = clean.conventions(prices(t), ["us", "local", "mixed", "word"])
    return found.select("column", "readable", "numeric", "convention", "refusal")


@query(
    "cln5_cast_numeric",
    f"""SELECT _row_id, CASE WHEN us <> 'unknown' THEN price END AS us, CASE WHEN us <> 'unknown' THEN price END AS local, mixed, word FROM {PRICES_SQL}""",
)
def _(t):
    return clean.cast_numeric_safe(prices(t).drop("price"), Rule("cast_numeric_safe"))[0]


@query(
    "cln5_cast_log",
    f"""WITH p AS {PRICES_SQL}
    SELECT 'cast_numeric_safe' AS rule_id, c AS "column", _row_id AS row_index, 'unknown' AS "before", '' AS "after" FROM p, (VALUES ('us'), ('local')) v(c) WHERE us = 'unknown'
    UNION ALL SELECT 'cast_numeric_safe', c, -1, 'kept', 'kept' FROM (VALUES ('mixed'), ('word')) v(c)""",
)
def _(t):
    out = clean.cast_numeric_safe(prices(t).drop("price"), Rule("cast_numeric_safe"))[1]
    return log(out.filter(~F.col("reason").startswith("read with")))


def _forms_sql(column):
    return f"""forms AS (SELECT {column} AS form, lower({column}) AS k, count(*) AS n FROM d GROUP BY 1),
    kept AS (SELECT k, arg_max(form, ({CASE_SCORE_SQL.format("form")}, n, form)) AS keep FROM forms GROUP BY 1)"""


@query(
    "cln6_merge_variants",
    f"WITH d AS {DIRTY_PARTS_SQL}, {_forms_sql('kind')} SELECT p_partkey AS _row_id, keep AS kind FROM d JOIN kept ON lower(kind) = k",
)
def _(t):
    return clean.merge_text_variants(parts(t), Rule("merge_text_variants", ("kind",)))[0].select(ROW_ID, "kind")


@query(
    "cln6_canonical_accents",
    """WITH v AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Đại lý' WHEN 1 THEN 'dai ly' WHEN 2 THEN 'DAI LY' ELSE 'Đại Lý ' || c_nationkey END AS place FROM customer)
    SELECT c_custkey AS _row_id, CASE WHEN c_custkey % 4 < 3 THEN 'Đại lý' ELSE place END AS place FROM v""",
)
def _(t):
    at = F.col("c_custkey") % 4
    place = F.when(at == 0, "Đại lý").when(at == 1, "dai ly").when(at == 2, "DAI LY").otherwise(F.concat(F.lit("Đại Lý "), "c_nationkey"))
    df = t.customer.select(F.col("c_custkey").alias(ROW_ID), place.alias("place"))
    return clean.merge_text_variants(df, Rule("merge_text_variants"))[0]


@query(
    "cln7_number_words",
    """SELECT p_partkey AS _row_id, CASE p_size % 5 WHEN 0 THEN '205' WHEN 1 THEN '12' WHEN 2 THEN '3000' WHEN 3 THEN CAST(p_size AS VARCHAR) ELSE '1500021' END AS amount FROM part""",
)
def _(t):
    at = F.col("p_size") % 5
    words = (
        F.when(at == 0, "hai trăm linh năm").when(at == 1, "Mười hai").when(at == 2, "ba nghìn")
        .when(at == 3, F.col("p_size").cast("string")).otherwise("một triệu năm trăm nghìn hai mươi mốt")
    )
    df = t.part.select(F.col("p_partkey").alias(ROW_ID), words.alias("amount"))
    return clean.cast_words_to_numbers(df, Rule("cast_words_to_numbers"))[0]


@query(
    "cln8_drop_duplicates",
    """SELECT min(o_orderkey) AS _row_id, o_custkey, o_orderstatus FROM orders GROUP BY 2, 3""",
)
def _(t):
    df = t.orders.select(F.col("o_orderkey").alias(ROW_ID), "o_custkey", "o_orderstatus")
    return clean.drop_exact_duplicates(df, Rule("drop_exact_duplicates"))[0]


@query(
    "cln8_drop_duplicates_log",
    """SELECT 'drop_exact_duplicates' AS rule_id, 'o_custkey' AS "column", o_orderkey AS row_index, 'duplicate row' AS "before", '' AS "after"
    FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 1""",
)
def _(t):
    df = t.orders.select(F.col("o_orderkey").alias(ROW_ID), "o_custkey", "o_orderstatus")
    return log(clean.drop_exact_duplicates(df, Rule("drop_exact_duplicates", ("o_custkey",)))[1])


WIDE_SQL = """(SELECT c_custkey AS _row_id, c_name AS item, CASE WHEN c_custkey % 10 = 0 THEN '-' ELSE format('{:,.2f}', c_acctbal) END AS q1,
    CASE WHEN c_custkey % 20 = 0 THEN 'n/a' ELSE format('{:,.2f}', c_acctbal * 2) END AS q2, c_acctbal AS b FROM customer)"""


def wide(t):
    return t.customer.select(
        F.col("c_custkey").alias(ROW_ID), F.col("c_name").alias("item"),
        F.when(F.col("c_custkey") % 10 == 0, "-").otherwise(F.format_number("c_acctbal", 2)).alias("Q1-2026"),
        F.when(F.col("c_custkey") % 20 == 0, "n/a").otherwise(F.format_number(F.col("c_acctbal") * 2, 2)).alias("Q2-2026"),
    )


UNPIVOT = Rule("unpivot_periods", (), {"label": "item", "periods": ["Q1-2026", "Q2-2026"]})


@query(
    "cln9_unpivot_periods",
    f"""WITH w AS {WIDE_SQL} SELECT item, 'Q1-2026' AS "Kỳ báo cáo", b AS "Giá trị" FROM w WHERE q1 <> '-'
    UNION ALL SELECT item, 'Q2-2026', round(b * 2, 2) FROM w WHERE q2 <> 'n/a'""",
)
def _(t):
    return clean.unpivot_periods(wide(t), UNPIVOT)[0].drop(ROW_ID)


@query(
    "cln9_unpivot_log",
    f"""SELECT 'unpivot_periods' AS rule_id, 'item' AS "column", _row_id AS row_index, item AS "before", '' AS "after" FROM {WIDE_SQL} WHERE q1 = '-' AND q2 = 'n/a'""",
)
def _(t):
    return log(clean.unpivot_periods(wide(t), UNPIVOT)[1].filter("rule_id = 'unpivot_periods'"))


@query(
    "cln10_missing_required",
    """SELECT d.doc_id AS _row_id, quality IS NULL OR text = '' AS _missing_required FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def _(t):
    df = t.documents.join(t.labels, "doc_id", "left").withColumnRenamed("doc_id", ROW_ID)
    return clean.flag_missing_required(df, Rule("flag_missing_required", ("quality", "text")))[0].select(ROW_ID, clean.MISSING_FLAG)


PLAN = [
    Rule("flag_missing_required", ("size",)),
    Rule("drop_exact_duplicates", ("name", "kind", "size")),
    Rule("cast_numeric_safe", ("size",)),
    Rule("merge_text_variants", ("kind",)),
    Rule("replace_sentinel_with_null", ("size",), {"sentinels": ["N/A", "-"]}),
    Rule("trim_whitespace"),
]

CLEAN_SQL = f"""d AS {DIRTY_PARTS_SQL}, {_forms_sql("kind")},
    c AS (SELECT p_partkey, trim(name) AS name, keep AS kind, try_cast(CASE WHEN size IN ('N/A', '-') THEN NULL ELSE size END AS DOUBLE) AS size FROM d JOIN kept ON lower(kind) = k),
    u AS (SELECT *, row_number() OVER (PARTITION BY name, kind, size ORDER BY p_partkey) AS n FROM c)"""


@query("cln11_apply_rules", f"WITH {CLEAN_SQL} SELECT p_partkey AS _row_id, name, kind, size, size IS NULL AS _missing_required FROM u WHERE n = 1")
def _(t):
    return clean.apply_rules(parts(t).drop("made"), PLAN).df


@query(
    "cln11_row_counts",
    f"WITH {CLEAN_SQL} SELECT count(*) AS rows_in, count(*) FILTER (WHERE n = 1) AS rows_out, round(100.0 * count(*) FILTER (WHERE n > 1) / count(*), 4) AS dropped_pct FROM u",
)
def _(t):
    out = clean.apply_rules(parts(t).drop("made"), PLAN)
    return t.spark.createDataFrame([(out.rows_in, out.rows_out, round(out.dropped_pct, 4))], "rows_in bigint, rows_out bigint, dropped_pct double")


@query(
    "cln12_diff_summary",
    f"""WITH {CLEAN_SQL},
    l AS (SELECT 'trim_whitespace' AS rule_id, 'name' AS "column", 'surrounding white space removed' AS reason, p_partkey AS i, name AS b, trim(name) AS a FROM d WHERE name <> trim(name)
      UNION ALL SELECT 'replace_sentinel_with_null', 'size', 'sentinel to empty', p_partkey, size, '' FROM d WHERE size IN ('N/A', '-')
      UNION ALL SELECT 'merge_text_variants', 'kind', 'one spelling per value', p_partkey, kind, keep FROM d JOIN kept ON lower(kind) = k WHERE kind <> keep
      UNION ALL SELECT 'drop_exact_duplicates', 'name,kind,size', 'duplicate row dropped', p_partkey, 'duplicate row', '' FROM u WHERE n > 1
      UNION ALL SELECT 'flag_missing_required', 'size', 'required value missing', p_partkey, '', 'True' FROM u WHERE n = 1 AND size IS NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY rule_id, "column", reason ORDER BY i) AS n FROM l)
    SELECT rule_id, "column", reason, count(*) AS changes, string_agg('''' || b || ''' -> ''' || a || '''', '; ' ORDER BY i) FILTER (WHERE n <= 3) AS examples FROM r GROUP BY 1, 2, 3""",
)
def _(t):
    out = clean.apply_rules(parts(t).drop("made"), PLAN)
    return clean.summarise_diff(out.diff).withColumn("examples", F.array_join("examples", "; "))


@query(
    "cln14_effective_labels",
    """SELECT * FROM (VALUES ('quality', '0', 'Low'), ('quality', '1', 'Đạt chuẩn'), ('toxic', '0', 'Không độc hại'), ('toxic', '1', 'Độc hại')) v("column", value, label)""",
)
def _(t):
    meanings = t.spark.createDataFrame([("quality", "đạt chuẩn"), ("toxic", "độc hại ; toxic")], "column string, meaning string")
    saved = clean.parse_labels(t.spark.createDataFrame([("quality", "0 = Low; 9 = ?")], "column string, text string"))
    return clean.effective_labels(profile.categories(t.labels), saved, meanings)


@query(
    "cln14_labelled_rows",
    "SELECT doc_id, CASE WHEN toxic = 1 THEN 'Toxic' ELSE '0' END AS toxic_label FROM labels",
)
def _(t):
    mine = clean.parse_labels(t.spark.createDataFrame([("toxic", "1 = Toxic")], "column string, text string"))
    return clean.with_labels(t.labels, "toxic", mine).select("doc_id", "toxic_label")


# --- scalar functions --------------------------------------------------------


@query(
    "str1_fold",
    "SELECT doc_id, array_to_string(regexp_extract_all(replace(strip_accents(lower(text)), 'đ', 'd'), '[a-z0-9_]+'), ' ') AS folded FROM documents",
)
def _(t):
    return t.documents.select("doc_id", text.fold(F.col("text")).alias("folded"))


@query("str2_accented", "SELECT doc_id, strip_accents(text) <> nfc_normalize(text) AS accented FROM documents")
def _(t):
    return t.documents.select("doc_id", text.accented(F.col("text")).alias("accented"))


@query("str3_slug", "SELECT doc_id, substr(regexp_replace(text, '[^\\p{L}\\p{N}_-]', '_', 'g'), 1, 40) AS slug FROM documents")
def _(t):
    return t.documents.select("doc_id", text.slug(F.col("text")).alias("slug"))


@query("str4_ascii_slug", "SELECT doc_id, trim(regexp_replace(source || ' ' || lang || '!', '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM documents")
def _(t):
    return t.documents.select("doc_id", text.ascii_slug(F.concat("source", F.lit(" "), "lang", F.lit("!"))).alias("slug"))


@query("str6_blank", f"SELECT p_partkey, lower(trim(size)) IN ('', '-', '--', 'n/a', 'na', 'null', 'none', 'nan') AS is_blank FROM {DIRTY_PARTS_SQL}")
def _(t):
    return dirty_parts(t).select("p_partkey", text.is_blank(F.col("size")).alias("is_blank"))


@query("str7_leading_zero", "SELECT count(*) FILTER (WHERE regexp_matches(lpad(CAST(p_size AS VARCHAR), 2, '0'), '^-?0[0-9]')) AS n FROM part")
def _(t):
    return t.part.agg(F.count_if(text.has_leading_zero(F.lpad(F.col("p_size").cast("string"), 2, "0"))).alias("n"))


@query("dat1_quarters", "SELECT date_trunc('quarter', o_orderdate)::TIMESTAMP AS start, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    label = F.concat(F.year("o_orderdate"), F.lit("-Q"), F.quarter("o_orderdate"))
    return t.orders.groupBy(dates.quarter_start(label).alias("start")).agg(F.count("*").alias("n"))


@query(
    "dat2_period_key",
    "SELECT year(o_orderdate) AS year, CASE o_orderkey % 3 WHEN 0 THEN quarter(o_orderdate) * 3 WHEN 1 THEN month(o_orderdate) ELSE 12 END AS month, count(*) AS n FROM orders GROUP BY ALL",
)
def _(t):
    at = F.col("o_orderkey") % 3
    label = (
        F.when(at == 0, F.concat(F.lit("Quý "), F.quarter("o_orderdate"), F.lit("/"), F.year("o_orderdate")))
        .when(at == 1, F.concat(F.lit("Tháng "), F.month("o_orderdate"), F.lit("-"), F.year("o_orderdate")))
        .otherwise(F.concat(F.lit("Năm "), F.year("o_orderdate")))
    )
    key = dates.period_key(label)
    return t.orders.groupBy(key["year"].alias("year"), key["month"].alias("month")).agg(F.count("*").alias("n"))


@query("dat3_mixed_dates", "SELECT o_orderkey, o_orderdate AS moment FROM orders")
def _(t):
    day = (
        F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "M/d/yyyy"))
        .when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "MMM d, yyyy"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    )
    return t.orders.select("o_orderkey", dates.parse_mixed(day).alias("moment"))


@query("mth1_read_number", f"SELECT _row_id, CASE WHEN local <> 'unknown' THEN price END AS price FROM {PRICES_SQL}")
def _(t):
    return prices(t).select(ROW_ID, numbers.with_convention(F.col("local"), F.lit(numbers.LOCAL)).alias("price"))
