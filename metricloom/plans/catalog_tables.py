"""Mart, join, point, BI and validation queries (SQL, JON, AGG9-19, VAL)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from metricloom.operators import bi, intervals, mart, points, profile, validate
from metricloom.operators.clean import with_labels
from metricloom.plans.registry import query
from metricloom.session import checkpoint_dir

# --- mart --------------------------------------------------------------------

MART = """WITH line AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS revenue, count(*) AS lines FROM lineitem GROUP BY l_orderkey)
SELECT o_orderpriority, count(*) AS orders, round(sum(revenue), 2) AS revenue, max(lines) AS most_lines
FROM orders JOIN line ON o_orderkey = l_orderkey WHERE o_orderstatus IN ('F', 'O') GROUP BY o_orderpriority HAVING count(*) > 10"""


@query("sql1_mart", MART)
def _(t):
    return mart.run_sql(MART, {"orders": t.orders, "lineitem": t.lineitem})


WINDOWED = """SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) x
WHERE place <= 2 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"""


@query("sql1_mart_windows", WINDOWED)
def _(t):
    return mart.run_sql(WINDOWED, {"orders": t.orders, "customer": t.customer})


@query(
    "sql1_mart_set_operations",
    "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000 EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0",
)
def _(t):
    sql = "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000 EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0"
    return mart.run_sql(sql, {"customer": t.customer, "supplier": t.supplier, "nation": t.nation})


@query(
    "sql1_mart_functions",
    """SELECT doc_id, len(string_split(text, ' ')) AS words, length(text) AS chars, date_diff('day', TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-01') AS days FROM documents""",
)
def _(t):
    sql = "SELECT doc_id, size(split(text, ' ')) AS words, length(text) AS chars, datediff(TIMESTAMP'2024-03-01', TIMESTAMP'2024-01-01') AS days FROM documents"
    return mart.run_sql(sql, {"documents": t.documents})


@query(
    "sql2_size_checks",
    """WITH l AS (SELECT count(*) AS n FROM lineitem), o AS (SELECT count(*) AS n FROM orders), e AS (SELECT count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_returnflag = b.l_returnflag AND a.l_shipdate = b.l_shipdate)
    SELECT 'same' AS "case", l.n AS rows_out, '' AS note FROM l UNION ALL
    SELECT 'few', (SELECT count(DISTINCT o_orderstatus) FROM orders), 'only ' || (SELECT count(DISTINCT o_orderstatus) FROM orders) || ' rows from ' || format('{:,}', o.n) FROM o UNION ALL
    SELECT 'exploded', e.n, CASE WHEN e.n > 10 * l.n THEN format('{:,}', e.n) || ' rows from a largest table of ' || format('{:,}', l.n) || ': more than 10 times, check the join conditions' ELSE '' END FROM e, l""",
)
def _(t):
    folder = f"{checkpoint_dir(t.spark)}/marts-{uuid.uuid4().hex}"
    statements = {
        "same": ("SELECT l_orderkey, l_linenumber FROM lineitem", {"lineitem": t.lineitem}),
        "few": ("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1", {"orders": t.orders}),
        "exploded": ("SELECT a.l_orderkey FROM lineitem a JOIN lineitem b ON a.l_returnflag = b.l_returnflag AND a.l_shipdate = b.l_shipdate", {"lineitem": t.lineitem}),
    }
    built = [(case, mart.build_mart(sql, tables, f"{folder}/{case}", max_rows=10**12)) for case, (sql, tables) in statements.items()]
    return t.spark.createDataFrame([(case, m.rows_out, m.note) for case, m in built], "case string, rows_out bigint, note string")


@query(
    "sql4_scope_note",
    """SELECT count(*) AS rows_in, 0 AS rows_out, 'o_totalprice < 0' AS condition, 'o_totalprice: ' || min(o_totalprice) || '..' || max(o_totalprice) AS note FROM orders""",
)
def _(t):
    return mart.scope_note(t.orders, t.orders.filter("o_totalprice < 0"), "o_totalprice < 0", ["o_totalprice"])


@query("sql5_rows_where", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority = '1-URGENT'")
def _(t):
    return mart.rows_where(t.orders, {"o_orderstatus": ["F", "P"], "o_orderpriority": "1-URGENT"}).select("o_orderkey", "o_orderstatus")


ORDER_FIELDS = {
    "o_orderkey": ("measure", "number"), "o_custkey": ("measure", "number"), "o_orderstatus": ("dimension", "text"), "o_totalprice": ("measure", "number"),
    "o_orderdate": ("dimension", "date"), "o_orderpriority": ("dimension", "text"),
}
LINE_FIELDS = {
    "l_suppkey": ("dimension", "text"), "l_linenumber": ("dimension", "text"), "l_quantity": ("measure", "number"), "l_extendedprice": ("measure", "number"),
    "l_discount": ("measure", "number"), "l_returnflag": ("dimension", "text"), "l_shipdate": ("dimension", "date"), "l_partkey": ("dimension", "text"),
}


@query("sql6_bi_filters", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('O') AND o_totalprice BETWEEN 100000 AND 200000")
def _(t):
    filters = [bi.Filter("o_orderstatus", ("O",)), bi.Filter("o_totalprice", min=100000, max=200000), bi.Filter("o_orderpriority", ())]
    return bi.apply_filters(t.orders, filters, ORDER_FIELDS).select("o_orderkey", "o_totalprice")


# --- points ------------------------------------------------------------------

QUARTERLY = """st AS (SELECT o_orderstatus AS item, 'Q' || quarter(o_orderdate) || '-' || year(o_orderdate) AS period, year(o_orderdate) * 4 + quarter(o_orderdate) AS ord, o_totalprice AS amount FROM orders)"""


def statement(t):
    rows = t.orders
    period = F.concat(F.lit("Q"), F.quarter("o_orderdate"), F.lit("-"), F.year("o_orderdate"))
    return rows.select(F.col("o_orderstatus").alias("item"), period.alias("period"), F.col("o_totalprice").alias("amount"))


@query(
    "sql8_pivot_items",
    f"""WITH {QUARTERLY} SELECT period, round(sum(amount) FILTER (WHERE item = 'F'), 2) AS "F", round(sum(amount) FILTER (WHERE item = 'O'), 2) AS "O",
    round(sum(amount) FILTER (WHERE item = 'F') / sum(amount) FILTER (WHERE item = 'O'), 4) AS ratio FROM st GROUP BY 1""",
)
def _(t):
    out = points.pivot_items(statement(t), "item", ["F", "O"], "amount", ["period"], ("F", "O"))
    return out.select("period", F.round("F", 2).alias("F"), F.round("O", 2).alias("O"), F.round("`F / O`", 4).alias("ratio"))


@query("sql8_constant_attributes")
def _(t):
    df = statement(t).withColumn("unit", F.when(F.col("item") == "F", "usd").otherwise("eur"))
    kept = points.constant_attributes(df, "item", ["F", "O"], ["unit", "period"])
    return t.spark.createDataFrame([(c,) for c in kept], "column string")


@query(
    "sql9_named_points",
    f"""WITH {QUARTERLY}, w AS (SELECT item, period, amount FROM st WHERE period IN ('Q1-1996', 'Q2-1996', 'Q1-1997') AND item IN ('F', 'O'))
    SELECT 'amount' AS measure, 'item = ' || item AS filter, period AS label, CASE WHEN count(*) = 1 THEN 'value' ELSE 'sum' END AS stat, round(sum(amount), 2) AS value, count(*) AS "rows" FROM w GROUP BY item, period""",
)
def _(t):
    out = points.named_points(statement(t), "period", ["Q1-1996", "Q2-1996", "Q1-1997"], ["amount"], {"item": ["F", "O"]})
    return out.withColumn("value", F.round("value", 2))


@query(
    "sql10_changes",
    f"""WITH {QUARTERLY}, s AS (SELECT item, period, ord, sum(amount) AS v FROM st GROUP BY 1, 2, 3),
    l AS (SELECT *, lag(v) OVER (PARTITION BY item ORDER BY ord) AS b FROM s)
    SELECT item, period, round(v - b, 4) AS change, round((v - b) / abs(b) * 100, 4) AS pct_change FROM l WHERE b IS NOT NULL""",
)
def _(t):
    totals = statement(t).groupBy("item", "period").agg(F.sum("amount").alias("v"))
    return points.changes(totals, ["item"], "period", "v")


@query(
    "sql11_ratio_long",
    f"""WITH {QUARTERLY}, s AS (SELECT period, sum(amount) FILTER (WHERE item = 'F') / sum(amount) FILTER (WHERE item = 'O') AS r FROM st GROUP BY 1)
    SELECT period AS label, round(r, 4) AS ratio, round(r * 100, 4) AS ratio_pct FROM s WHERE r IS NOT NULL""",
)
def _(t):
    return points.ratio_points(statement(t), "item", "F", "O", "amount", "period")[0]


@query(
    "sql11_ratio_refused",
    "SELECT 'ratio' AS op, CAST(l_linenumber AS VARCHAR) AS subject, 'a number is missing or the denominator is zero' AS reason FROM lineitem GROUP BY l_linenumber HAVING sum(CASE WHEN l_linenumber > 5 THEN 0 ELSE l_tax END) = 0",
)
def _(t):
    df = t.lineitem.select("l_linenumber", "l_quantity", F.when(F.col("l_linenumber") > 5, 0.0).otherwise(F.col("l_tax")).alias("tax"))
    return points.wide_ratio(df, "l_quantity", "tax", "l_linenumber")[1]


@query(
    "sql11_ratio_wide",
    "SELECT l_returnflag AS label, round(sum(l_extendedprice) / sum(l_quantity), 4) AS ratio, round(sum(l_extendedprice) / sum(l_quantity) * 100, 4) AS ratio_pct FROM lineitem GROUP BY 1",
)
def _(t):
    return points.wide_ratio(t.lineitem, "l_extendedprice", "l_quantity", "l_returnflag")[0]


# --- joins -------------------------------------------------------------------

JOINED = {
    "inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000",
    "right": "SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 9000",
    "full": "SELECT c.k AS c_nation, s.k AS s_nation, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey < 20 GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 5 GROUP BY 1) s ON c.k = s.k",
    "using": "SELECT doc_id, quality, n_chars FROM documents JOIN labels USING (doc_id)",
}


def _join_query(kind, sql):
    @query(f"jon1_{kind}_join", sql)
    def _(t):
        tables = {n: getattr(t, n) for n in ("orders", "customer", "supplier", "nation", "documents", "labels") if n in sql}
        return mart.run_sql(sql, tables)


for _kind, _sql in JOINED.items():
    _join_query(_kind, _sql)


@query("jon2_semi_join", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def _(t):
    rich = t.orders.filter("o_totalprice > 450000")
    return t.customer.join(rich, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("jon2_anti_join", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query(
    "jon2_range_join",
    """WITH b AS (SELECT n_nationkey, n_nationkey * 400.0 AS lo, n_nationkey * 400.0 + 400.0 AS hi FROM nation)
    SELECT n_nationkey, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN b ON c_acctbal >= lo AND c_acctbal < hi GROUP BY 1""",
)
def _(t):
    bands = t.nation.select("n_nationkey", (F.col("n_nationkey") * 400.0).alias("lo"), (F.col("n_nationkey") * 400.0 + 400.0).alias("hi"))
    joined = intervals.interval_join(t.customer, bands, "c_acctbal", "lo", "hi")
    return joined.groupBy("n_nationkey").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query(
    "jon2_overlapping_bands",
    """WITH b AS (SELECT o_orderkey, o_totalprice - (o_orderkey % 50) * 2.0 AS lo, o_totalprice + CASE WHEN o_orderkey % 400 = 0 THEN 50000.0 ELSE (o_orderkey % 7) * 1.5 END AS hi FROM orders)
    SELECT l_orderkey, l_linenumber, count(*) AS bands, min(o_orderkey) AS first_band FROM lineitem JOIN b ON l_extendedprice >= lo AND l_extendedprice <= hi GROUP BY 1, 2""",
)
def _(t):
    """As many bands as orders, narrow and wide, nested and overlapping."""
    wide = F.when(F.col("o_orderkey") % 400 == 0, 50000.0).otherwise((F.col("o_orderkey") % 7) * 1.5)
    bands = t.orders.select("o_orderkey", (F.col("o_totalprice") - (F.col("o_orderkey") % 50) * 2.0).alias("lo"), (F.col("o_totalprice") + wide).alias("hi"))
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    fold = {"bands": (F.sum, F.lit(1)), "first_band": (F.min, F.col("o_orderkey"))}
    joined = intervals.interval_join(lines, bands, "l_extendedprice", "lo", "hi", closed=True, fold=fold)
    return joined.groupBy("l_orderkey", "l_linenumber").agg(F.sum("bands").alias("bands"), F.min("first_band").alias("first_band"))


@query(
    "jon3_aligned_aggregates",
    """WITH a AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS nation, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers FROM a FULL JOIN b ON a.k = b.k""",
)
def _(t):
    # One grouped pass over the union instead of a full join of two aggregates.
    both = t.customer.select(F.col("c_nationkey").alias("nation"), F.lit(1).alias("c"), F.lit(0).alias("s")).unionByName(
        t.supplier.filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation"), F.lit(0).alias("c"), F.lit(1).alias("s"))
    )
    return both.groupBy("nation").agg(F.sum("c").alias("customers"), F.sum("s").alias("suppliers"))


@query("jon4_orphans", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 45)")
def _(t):
    return validate.orphans(t.lineitem, "l_partkey", t.part.filter("p_size < 45"), "p_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("jon5_events_of_cases", "SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) > 70)")
def _(t):
    busy = t.events.groupBy("user_id").count().filter("count > 70")
    return t.events.join(busy, "user_id", "left_semi").select("event_id")


@query("jon6_next_row", "SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations")
def _(t):
    from metricloom.scale import Sequenced

    return Sequenced(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], ["turn"]).with_next({"next_role": "role"}).rows()


@query("jon7_dictionary", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' ELSE o_orderstatus END AS o_orderstatus_label FROM orders")
def _(t):
    labels = t.spark.createDataFrame([("o_orderstatus", "F", "Finished"), ("o_orderstatus", "O", "Open")], "column string, value string, label string")
    return with_labels(t.orders, "o_orderstatus", labels).select("o_orderkey", "o_orderstatus_label")


# --- BI ----------------------------------------------------------------------


def cells(result):
    return result.cells.select(F.col("x").cast("string").alias("x"), "series", F.round("value", 4).alias("value"), "position")


_AGG_SQL = {"sum": "sum(o_totalprice)", "mean": "avg(o_totalprice)", "median": "median(o_totalprice)", "min": "min(o_totalprice)", "max": "max(o_totalprice)",
            "count": "count(o_totalprice)", "count_distinct": "count(DISTINCT o_totalprice)"}


@query("agg9_aggregations", " UNION ALL ".join(f"SELECT '{a}' AS agg, o_orderstatus AS x, round({e}, 4)::DOUBLE AS value FROM orders GROUP BY 2" for a, e in _AGG_SQL.items()))
def _(t):
    parts = []
    for name in bi.AGGREGATIONS:
        spec = bi.BiQuery(x="o_orderstatus", y="o_totalprice", aggregation=name)
        found = bi.grouped(t.orders, ["o_orderstatus"], spec, ORDER_FIELDS)
        parts.append(found.select(F.lit(name).alias("agg"), F.col("o_orderstatus").alias("x"), F.round(F.col("value").cast("double"), 4).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "agg10_grouped_query",
    """WITH g AS (SELECT o_orderpriority AS x, o_orderstatus AS series, avg(o_totalprice) AS v FROM orders WHERE o_totalprice >= 50000 GROUP BY 1, 2),
    p AS (SELECT x, row_number() OVER (ORDER BY sum(v) DESC, x) AS position FROM g GROUP BY 1)
    SELECT x, series, round(v, 4) AS value, position FROM g JOIN p USING (x)""",
)
def _(t):
    spec = bi.BiQuery(x="o_orderpriority", y="o_totalprice", color="o_orderstatus", filters=(bi.Filter("o_totalprice", min=50000),))
    return cells(bi.run_query(t.orders, spec, ORDER_FIELDS))


@query(
    "agg11_folded_legend",
    """WITH s AS (SELECT CAST(l_suppkey AS VARCHAR) AS s, row_number() OVER (ORDER BY count(*) DESC, CAST(l_suppkey AS VARCHAR)) AS n FROM lineitem GROUP BY 1),
    f AS (SELECT l_returnflag AS x, CASE WHEN n <= 7 THEN s ELSE 'Khác' END AS series, l_quantity AS q FROM lineitem JOIN s ON s = CAST(l_suppkey AS VARCHAR)),
    g AS (SELECT x, series, avg(q) AS v FROM f GROUP BY 1, 2), p AS (SELECT x, row_number() OVER (ORDER BY sum(v) DESC, x) AS position FROM g GROUP BY 1)
    SELECT x, series, round(v, 4) AS value, position FROM g JOIN p USING (x)""",
)
def _(t):
    return cells(bi.run_query(t.lineitem, bi.BiQuery(x="l_returnflag", y="l_quantity", color="l_suppkey"), LINE_FIELDS))


@query(
    "agg12_folded_axis",
    """WITH r AS (SELECT CAST(l_suppkey AS VARCHAR) AS k, row_number() OVER (ORDER BY sum(l_quantity) DESC, CAST(l_suppkey AS VARCHAR)) AS n FROM lineitem GROUP BY 1),
    g AS (SELECT CASE WHEN n <= 9 THEN k ELSE 'Khác' END AS x, sum(l_quantity) AS v FROM lineitem JOIN r ON k = CAST(l_suppkey AS VARCHAR) GROUP BY 1)
    SELECT x, 'l_quantity' AS series, v AS value, row_number() OVER (ORDER BY CASE WHEN x = 'Khác' THEN 1 ELSE 0 END, v DESC, x) AS position FROM g""",
)
def _(t):
    return cells(bi.run_query(t.lineitem, bi.BiQuery(x="l_suppkey", y="l_quantity", aggregation="sum", top=10), LINE_FIELDS))


@query(
    "agg13_cut_categories",
    """WITH g AS (SELECT l_suppkey AS k, CAST(l_suppkey AS VARCHAR) AS x, sum(l_quantity) AS v FROM lineitem GROUP BY 1),
    p AS (SELECT *, row_number() OVER (ORDER BY v DESC, k) AS position, count(*) OVER () AS c FROM g)
    SELECT x, 'l_quantity' AS series, v AS value, position, greatest(c - 60, 0) AS dropped FROM p WHERE position <= 60""",
)
def _(t):
    result = bi.run_query(t.lineitem, bi.BiQuery(x="l_suppkey", y="l_quantity", aggregation="sum"), LINE_FIELDS)
    return cells(result).withColumn("dropped", F.lit(result.dropped))


@query(
    "agg13_time_axis",
    """WITH g AS (SELECT o_orderdate AS d, count(*) AS v FROM orders GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY d) AS position, count(*) OVER () AS c FROM g)
    SELECT d AS x, 'rows' AS series, v::DOUBLE AS value, position, greatest(c - 1000, 0) AS dropped FROM p WHERE position <= 1000""",
)
def _(t):
    result = bi.run_query(t.orders, bi.BiQuery(x="o_orderdate"), ORDER_FIELDS)
    return result.cells.select("x", "series", F.col("value").cast("double").alias("value"), "position").withColumn("dropped", F.lit(result.dropped))


@query("agg14_field_values", "SELECT p_brand AS value, count(*) AS count, false AS more FROM part GROUP BY 1")
def _(t):
    found, more = bi.field_values(t.part, "p_brand", {"p_brand": ("dimension", "text")})
    return found.withColumn("more", F.lit(more))


@query("agg14_field_range", "SELECT min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders")
def _(t):
    return bi.field_values(t.orders, "o_totalprice", ORDER_FIELDS)[0]


@query("agg15_scatter_correlation", "SELECT count(*) AS pairs, round(corr(l_quantity, l_extendedprice), 6) AS correlation, 5000 AS points FROM lineitem")
def _(t):
    result = bi.run_query(t.lineitem, bi.BiQuery(x="l_quantity", y="l_extendedprice"), LINE_FIELDS)
    return result.cells.agg(F.count("*").alias("points")).select(
        F.lit(result.pairs).alias("pairs"), F.round(F.lit(result.correlation), 6).alias("correlation"), "points"
    )


@query("agg15_scatter_points")
def _(t):
    return bi.run_query(t.lineitem, bi.BiQuery(x="l_quantity", y="l_extendedprice", color="l_returnflag"), LINE_FIELDS).cells


FLOW = """f AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS position, strftime(o_orderdate, '%Y-%m') AS label, round(sum(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END), 2) AS change FROM orders GROUP BY 1, 2)"""


@query(
    "agg16_waterfall",
    f"""WITH {FLOW}, r AS (SELECT *, sum(change) OVER (ORDER BY position) AS after FROM f)
    SELECT position, label, round(least(after - change, after), 2) AS base, CASE WHEN change > 0 THEN change END AS up, CASE WHEN change < 0 THEN -change END AS down, NULL::DOUBLE AS total FROM r
    UNION ALL SELECT max(position) + 1, 'Tổng', 0, NULL, NULL, round(sum(change), 2) FROM f""",
)
def _(t):
    change = F.round(F.sum(F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))), 2)
    flow = t.orders.groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("position"), F.date_format("o_orderdate", "yyyy-MM").alias("label")).agg(change.alias("change"))
    out = bi.waterfall(flow, "position", "label", "change")
    return out.select("position", "label", F.round("base", 2).alias("base"), "up", "down", F.round("total", 2).alias("total"))


SHARED = "g AS (SELECT o_orderpriority AS x, o_orderstatus AS series, sum(CASE WHEN o_orderstatus = 'P' THEN -o_totalprice ELSE o_totalprice END) AS v FROM orders GROUP BY 1, 2)"


def status_cells(t):
    signed = F.when(F.col("o_orderstatus") == "P", -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    return t.orders.groupBy(F.col("o_orderpriority").alias("x"), F.col("o_orderstatus").alias("series")).agg(F.sum(signed).alias("value"))


@query(
    "agg17_matrix",
    f"""WITH {SHARED}, m AS (SELECT series, max(abs(v)) AS largest FROM g GROUP BY 1)
    SELECT x, series, round(v, 2) AS value, CASE WHEN v = 0 THEN 'none' WHEN v > 0 THEN 'pos' ELSE 'neg' END AS sign, round(least(1.0, abs(v) / largest), 4) AS strength FROM g JOIN m USING (series)""",
)
def _(t):
    return bi.matrix(status_cells(t), ["F", "O", "P"]).withColumn("value", F.round("value", 2))


@query("agg17_stacked_shares", f"WITH {SHARED} SELECT x, series, round(100.0 * v / sum(v) OVER (PARTITION BY x), 4) AS share_pct FROM g")
def _(t):
    return bi.stacked_shares(status_cells(t))


@query("agg18_grouped_bars", "SELECT l_returnflag AS grp, round(avg(l_quantity), 4) AS l_quantity, round(avg(l_discount), 4) AS l_discount FROM lineitem GROUP BY 1")
def _(t):
    return bi.grouped_bars(t.lineitem, "l_returnflag", ["l_quantity", "l_discount"])


@query(
    "agg18_box_data",
    """SELECT CAST(s_nationkey AS VARCHAR) AS grp, count(*) AS n, round(min(s_acctbal), 4) AS low, round(quantile_cont(s_acctbal, 0.25), 4) AS q1, round(median(s_acctbal), 4) AS median,
    round(quantile_cont(s_acctbal, 0.75), 4) AS q3, round(max(s_acctbal), 4) AS high FROM supplier GROUP BY 1 HAVING count(*) >= 5 ORDER BY 1 LIMIT 25""",
)
def _(t):
    return bi.box_data(t.supplier, "s_nationkey", "s_acctbal")


@query("agg18_line_data", "SELECT ts, value FROM events WHERE value IS NOT NULL")
def _(t):
    return bi.line_data(t.events, "ts", "value")


@query(
    "agg19_chart_tests",
    """WITH s AS (SELECT 'share by status' AS series, o_orderstatus AS label, 100.0 * count(*) / (SELECT count(*) FROM orders) AS value FROM orders GROUP BY 2
      UNION ALL SELECT 'orders by month', strftime(o_orderdate, '%Y-%m'), count(*) FROM orders GROUP BY 2)
    SELECT series, count(*) AS points, round(sum(value), 4) AS total, abs(sum(value) - 100) <= 1 AS is_whole, bool_and(regexp_matches(label, '^[0-9]{4}(-(Q[1-4]|[0-9]{2}))?$')) AS is_timeline FROM s GROUP BY 1""",
)
def _(t):
    total = t.orders.count()
    shares = t.orders.groupBy(F.col("o_orderstatus").alias("label")).agg((100.0 * F.count("*") / total).alias("value")).withColumn("series", F.lit("share by status"))
    months = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("label")).agg(F.count("*").cast("double").alias("value")).withColumn("series", F.lit("orders by month"))
    return bi.chart_tests(shares.unionByName(months))


# --- validation ---------------------------------------------------------------


def counts(df):
    return df.select("test", "cnt")


@query(
    "val1_schema",
    """SELECT 'quality:not_nullable' AS test, count(*) FILTER (WHERE quality IS NULL) AS cnt FROM documents LEFT JOIN labels USING (doc_id)
    UNION ALL SELECT 'lang:dtype', 1 UNION ALL SELECT 'missing:column_in_dataframe', 1
    UNION ALL SELECT 'source:field_uniqueness', sum(n) FROM (SELECT count(*) AS n FROM documents GROUP BY source HAVING count(*) > 1)
    UNION ALL SELECT 'lang,n_chars:multiple_fields_uniqueness', sum(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang, n_chars HAVING count(*) > 1)""",
)
def _(t):
    df = t.documents.join(t.labels, "doc_id", "left")
    rows = validate.not_null(df, ["doc_id", "quality", "missing"]) + validate.dtypes(df, {"lang": "int", "n_chars": "bigint"})
    return counts(validate.run_row_checks(df, rows, "doc_id").unionByName(validate.unique(df, [["source"], ["lang", "n_chars"], ["doc_id"]])))


@query("val2_row_count_drift", "SELECT 'row_count_drift' AS test, count(*) FILTER (WHERE o_orderstatus = 'P') AS cnt FROM orders")
def _(t):
    kept = t.orders.filter("o_orderstatus <> 'P'")
    return counts(validate.build_checks(kept, {"rows_in": t.orders.count(), "max_drop_pct": 5.0}, "o_orderkey"))


@query(
    "val3_ranges",
    "SELECT 'l_quantity:range' AS test, count(*) FILTER (WHERE l_quantity < 5 OR l_quantity > 45) AS cnt FROM lineitem UNION ALL SELECT 'l_discount:range', count(*) FILTER (WHERE l_discount > 0.08) FROM lineitem UNION ALL SELECT 'nothing:range', 0",
)
def _(t):
    rules = validate.ranges(t.lineitem, [("l_quantity", 5, 45), ("l_discount", None, 0.08), ("l_tax", 0, 1), ("nothing", 0, 1)])
    return counts(validate.run_row_checks(t.lineitem, rules, "l_orderkey"))


@query(
    "val4_comparisons",
    """SELECT 'tax below discount' AS test, count(*) AS cnt FROM lineitem WHERE NOT l_tax <= l_discount
    UNION ALL SELECT 'flags differ', count(*) FROM lineitem WHERE NOT l_returnflag <> l_linestatus HAVING count(*) > 0
    UNION ALL SELECT 'shipped after', count(*) FROM lineitem WHERE NOT l_shipdate > TIMESTAMP '1997-06-01'""",
)
def _(t):
    df = t.lineitem.withColumn("start", F.lit("1997-06-01")).withColumn("ship", F.date_format("l_shipdate", "yyyy-MM-dd"))
    rules = [("tax below discount", "l_tax", "<=", "l_discount"), ("flags differ", "l_returnflag", "!=", "l_linestatus"), ("shipped after", "ship", ">", "start")]
    return counts(validate.run_row_checks(df, validate.comparisons(df, rules), "l_orderkey"))


@query(
    "val5_patterns",
    """SELECT 'c_name:pattern' AS test, count(*) FILTER (WHERE NOT regexp_full_match(c_name, 'Customer#[0-9]{8}[0-4]')) AS cnt FROM customer UNION ALL SELECT 'broken', 0""",
)
def _(t):
    rules = validate.patterns(t.customer, [("", "c_name", "Customer#[0-9]{8}[0-4]"), ("broken", "c_name", "([a-z")])
    return counts(validate.run_row_checks(t.customer, rules, "c_custkey"))


@query("val6_time_window", "SELECT 'l_shipdate:time_window' AS test, count(*) FILTER (WHERE l_shipdate < TIMESTAMP '1996-01-01' OR l_shipdate > TIMESTAMP '2000-12-31') AS cnt FROM lineitem")
def _(t):
    rules = validate.time_windows(t.lineitem, [("", "l_shipdate", "1996-01-01", "2000-12-31")])
    return counts(validate.run_row_checks(t.lineitem, rules, "l_orderkey"))


@query("val7_references", "SELECT 'o_orderstatus:reference' AS test, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS cnt FROM orders")
def _(t):
    return counts(validate.run_row_checks(t.orders, validate.references(t.orders, "o_orderstatus", ["F", "O"]), "o_orderkey"))


@query("val7_table_reference", "SELECT 'doc in labels' AS test, count(*) AS cnt FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return counts(validate.table_reference(t.documents, "doc_id", t.labels, "doc_id", "doc in labels"))


@query(
    "val8_unverifiable",
    "SELECT 'order:view__before__purchase:unverifiable' AS test, 0 AS cnt UNION ALL SELECT 'sod:click__vs__purchase:unverifiable', 0",
)
def _(t):
    spec = {
        "event_log": {"case_id": "user_id", "activity": "event_type", "timestamp": "props"},
        "sequence_order": [{"before": "view", "after": "purchase"}], "segregation_of_duties": [{"first": "click", "second": "purchase"}],
    }
    return counts(validate.conformance(t.events, spec, "event_id"))


SPEC = {
    "not_null": ["l_orderkey", "l_quantity"],
    "unique_together": [["l_orderkey", "l_linenumber"]],
    "ranges": [{"column": "l_quantity", "min": 1, "max": 49}, {"column": "l_discount", "min": 0, "max": 1}],
    "comparisons": [{"name": "tax under discount", "left": "l_tax", "operator": "<", "right": "l_discount"}],
    "patterns": [{"column": "l_returnflag", "pattern": "[AN]"}],
    "time_windows": [{"column": "l_shipdate", "from": "1995-01-01"}],
    "references": [{"column": "l_linestatus", "allowed": ["F"]}],
}

VALIDATED = """f AS (
      SELECT 'l_orderkey,l_linenumber:multiple_fields_uniqueness' AS test, coalesce(sum(n), 0)::BIGINT AS cnt FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
      UNION ALL SELECT 'l_quantity:range', count(*) FROM lineitem WHERE l_quantity > 49 OR l_quantity < 1
      UNION ALL SELECT 'tax under discount', count(*) FROM lineitem WHERE NOT l_tax < l_discount
      UNION ALL SELECT 'l_returnflag:pattern', count(*) FROM lineitem WHERE NOT regexp_full_match(l_returnflag, '[AN]')
      UNION ALL SELECT 'l_shipdate:time_window', count(*) FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-01-01'
      UNION ALL SELECT 'l_linestatus:reference', count(*) FROM lineitem WHERE l_linestatus <> 'F')"""


@query("val9_failures", f"WITH {VALIDATED} SELECT test, cnt FROM f WHERE cnt > 0")
def _(t):
    return counts(validate.validate(t.lineitem, SPEC, "l_orderkey").failures)


@query("val9_report", f"WITH {VALIDATED} SELECT 9 AS checks, 9 - count(*) AS passed, count(*) AS failed, 'failed' AS status FROM f WHERE cnt > 0")
def _(t):
    return validate.validate(t.lineitem, SPEC, "l_orderkey").summary


@query("val9_samples", "SELECT 'o_orderstatus:reference' AS test, o_orderkey FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderkey LIMIT 5")
def _(t):
    out = validate.validate(t.orders, {"references": [{"column": "o_orderstatus", "allowed": ["F"]}]}, "o_orderkey").failures
    return out.select("test", F.explode("sample").alias("s")).select("test", F.get_json_object("s", "$.o_orderkey").cast("bigint").alias("o_orderkey"))


@query("val9_not_validated", "SELECT 0 AS checks, 0 AS passed, 0 AS failed, 'not validated' AS status FROM orders LIMIT 1")
def _(t):
    return validate.validate(t.orders, {}, "o_orderkey").summary
