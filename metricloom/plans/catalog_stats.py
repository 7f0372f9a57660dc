"""Statistics and time-axis queries (STA1-10, TIM)."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.operators import stats, timeline
from metricloom.operators.metrics import compute_metrics
from metricloom.plans.registry import query

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def no_p(df):
    return df.filter(~F.col("key").endswith("p_value")).select("key", "value")


def _rank(c):
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query(
    "sta1_correlate",
    f"""WITH r AS (SELECT l_quantity AS a, l_extendedprice AS b, {_rank("l_quantity")} AS ra, {_rank("l_extendedprice")} AS rb FROM lineitem)
    SELECT 'l_quantity.corr.with.l_extendedprice' AS key, round(corr(a, b), 4) AS value FROM r
    UNION ALL SELECT 'l_quantity.rank_corr.with.l_extendedprice', round(corr(ra, rb), 4) FROM r
    UNION ALL SELECT 'l_quantity.corr.with.l_extendedprice.n', count(*) FROM r
    UNION ALL SELECT 'l_quantity.r2.with.l_extendedprice', round(power(corr(a, b), 2) * 100, 4) FROM r""",
)
def _(t):
    return no_p(stats.correlate(t.lineitem, [("l_quantity", "l_extendedprice")]).metrics)


@query("sta1_p_values")
def _(t):
    pairs = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1:]]
    return stats.correlate(t.lineitem, pairs).metrics.filter(F.col("key").endswith("p_value")).select("key", "value")


@query(
    "sta1_refusals",
    """SELECT * FROM (VALUES ('r_regionkey ~ twice', 'too few complete pairs', 5::DOUBLE, 8::DOUBLE)) v(subject, reason, observed, required)""",
)
def _(t):
    df = t.region.withColumn("twice", F.col("r_regionkey") * 2)
    return stats.correlate(df, [("r_regionkey", "twice")]).refused.select("subject", "reason", "observed", "required")


def _pairs_sql(columns, table):
    return " UNION ALL ".join(
        f"SELECT '{a}' AS l, '{b}' AS r, count(*) AS n, corr({a}, {b}) AS c FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        for i, a in enumerate(columns) for b in columns[i + 1:]
    )


@query("sta2_strongest_pairs", f"""WITH p AS ({_pairs_sql(NUMBERS, "lineitem")}) SELECT l AS "left", r AS "right", n, round(c, 4) AS r FROM p""")
def _(t):
    return stats.strongest_pairs(t.lineitem, NUMBERS)


WIDE = [f"e{i}" for i in range(1, 13)]


@query(
    "sta2_wide_correlations",
    f"""WITH w AS (SELECT {", ".join(f"CASE WHEN vec_id % {i + 8} = 0 THEN NULL ELSE embedding[{i}]::DOUBLE END AS e{i}" for i in range(1, 13))} FROM embeddings),
    p AS ({_pairs_sql(WIDE, "w")}) SELECT l AS "left", r AS "right", n, round(c, 4) AS r FROM p""",
)
def _(t):
    wide = t.embeddings.select(
        *[F.when(F.col("vec_id") % (i + 8) == 0, None).otherwise(F.col("embedding")[i - 1].cast("double")).alias(f"e{i}") for i in range(1, 13)]
    )
    return stats.strongest_pairs(wide, WIDE)


def _eta_sql(measure, group, table):
    return f"""SELECT '{measure}' AS measure, '{group}' AS dim, count(*) AS "rows", sum(power(m - g, 2)) / sum(power({measure} - g, 2)) AS eta FROM (
      SELECT {measure}, avg({measure}) OVER (PARTITION BY {group}) AS m, avg({measure}) OVER () AS g FROM {table} WHERE {group} IS NOT NULL AND {measure} IS NOT NULL)"""


@query(
    "sta3_separation",
    f"""WITH e AS ({_eta_sql("l_quantity", "l_returnflag", "lineitem")} UNION ALL {_eta_sql("l_extendedprice", "l_returnflag", "lineitem")}
      UNION ALL {_eta_sql("l_quantity", "l_linestatus", "lineitem")} UNION ALL {_eta_sql("l_extendedprice", "l_linestatus", "lineitem")})
    SELECT measure, dim, "rows", round(eta, 6) AS eta_sq FROM e""",
)
def _(t):
    found = stats.separation(stats.group_stats(t.lineitem, ["l_quantity", "l_extendedprice"], ["l_returnflag", "l_linestatus"]))
    return found.withColumn("eta_sq", F.round("eta_sq", 6))


@query(
    "sta4_group_means",
    """SELECT 'o_totalprice.mean.by.o_orderpriority.' || o_orderpriority AS key, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY o_orderpriority
    UNION ALL SELECT 'o_totalprice.mean.by.o_orderstatus.' || o_orderstatus, round(avg(o_totalprice), 4) FROM orders GROUP BY o_orderstatus""",
)
def _(t):
    out = stats.compare_groups(t.orders, [("o_totalprice", "o_orderpriority"), ("o_totalprice", "o_orderstatus")]).metrics
    return out.filter(F.col("stat") == "mean").select("key", "value")


@query(
    "sta4_refusals",
    """SELECT 'c_acctbal by c_nationkey' AS subject, 'too many groups: this is an identifier' AS reason, count(DISTINCT c_nationkey)::DOUBLE AS observed, 20::DOUBLE AS required FROM customer""",
)
def _(t):
    return stats.compare_groups(t.customer, [("c_acctbal", "c_nationkey")]).refused.select("subject", "reason", "observed", "required")


@query(
    "sta5_two_groups",
    """WITH g AS (SELECT l_linestatus AS g, count(*)::DOUBLE AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1),
    p AS (SELECT a.n AS n0, b.n AS n1, a.m AS m0, b.m AS m1, a.v AS v0, b.v AS v1 FROM g a JOIN g b ON a.g = 'F' AND b.g = 'O')
    SELECT 'l_quantity.ttest.by.l_linestatus.t_stat' AS key, round((m0 - m1) / sqrt(v0 / n0 + v1 / n1), 4) AS value FROM p
    UNION ALL SELECT 'l_quantity.diff.by.l_linestatus', round(m0 - m1, 4) FROM p
    UNION ALL SELECT 'l_quantity.ttest.by.l_linestatus.n', n0 + n1 FROM p
    UNION ALL SELECT 'l_quantity.effect_size.by.l_linestatus', round((m0 - m1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)), 4) FROM p
    UNION ALL SELECT 'l_quantity.mean.by.l_linestatus.' || g, round(m, 4) FROM g""",
)
def _(t):
    return no_p(stats.compare_groups(t.lineitem, [("l_quantity", "l_linestatus")]).metrics)


@query(
    "sta6_many_groups",
    """WITH g AS (SELECT c_mktsegment AS g, count(*)::DOUBLE AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY 1),
    t AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) / sum(n) AS gm FROM g), s AS (SELECT sum(g.n * power(m - gm, 2)) AS b, sum((g.n - 1) * v) AS w FROM g, t)
    SELECT 'c_acctbal.anova.by.c_mktsegment.f_stat' AS key, round((b / (k - 1)) / (w / (n - k)), 4) AS value FROM s, t
    UNION ALL SELECT 'c_acctbal.anova.by.c_mktsegment.groups', k FROM t
    UNION ALL SELECT 'c_acctbal.eta_sq.by.c_mktsegment', round(100.0 * b / (b + w), 4) FROM s
    UNION ALL SELECT 'c_acctbal.mean.by.c_mktsegment.' || g, round(m, 4) FROM g""",
)
def _(t):
    return no_p(stats.compare_groups(t.customer, [("c_acctbal", "c_mktsegment")]).metrics)


@query("sta6_p_values")
def _(t):
    out = stats.compare_groups(t.orders, [("o_totalprice", "o_orderpriority"), ("o_totalprice", "o_orderstatus")]).metrics
    return out.filter(F.col("key").endswith("p_value")).select("key", "value")


@query(
    "sta7_simple_regression",
    """WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_r2(l_extendedprice, l_quantity) AS r, count(*) AS n FROM lineitem)
    SELECT 'l_extendedprice.intercept' AS key, round(a, 4) AS value FROM f UNION ALL SELECT 'l_extendedprice.coef.l_quantity', round(b, 4) FROM f
    UNION ALL SELECT 'l_extendedprice.regression.r2', round(100 * r, 4) FROM f UNION ALL SELECT 'l_extendedprice.regression.r2_adj', round(100 * (1 - (1 - r) * (n - 1) / (n - 2)), 4) FROM f
    UNION ALL SELECT 'l_extendedprice.regression.n', n FROM f UNION ALL SELECT 'l_extendedprice.regression.predictors', 1""",
)
def _(t):
    return no_p(stats.regress(t.lineitem, "l_extendedprice", ["l_quantity"]).metrics)


@query("sta7_multiple_regression")
def _(t):
    return stats.regress(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]).metrics.select("key", "value")


@query(
    "sta8_collinearity",
    """WITH r AS (SELECT power(corr(l_quantity, l_extendedprice), 2) AS r2 FROM lineitem)
    SELECT 'l_tax.vif.' || c AS key, round(1 / (1 - r2), 4) AS value FROM r, (VALUES ('l_quantity'), ('l_extendedprice')) v(c)""",
)
def _(t):
    out = stats.regress(t.lineitem, "l_tax", ["l_quantity", "l_extendedprice"]).metrics
    return out.filter("stat = 'vif'").select("key", "value")


@query("sta9_suggest")
def _(t):
    spec, _ = stats.suggest_spec(t.lineitem.select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"))
    rows = [("correlation", a, b) for a, b in spec.correlations] + [("group", a, b) for a, b in spec.group_differences]
    return t.spark.createDataFrame(rows, "test string, first string, second string")


@query("sta10_compute")
def _(t):
    spec = stats.Spec(
        correlations=(("l_quantity", "l_extendedprice"),),
        group_differences=(("l_quantity", "l_returnflag"), ("l_quantity", "l_linestatus")),
        regressions=(("l_extendedprice", ("l_quantity", "l_tax")),),
    )
    return stats.compute_statistics(t.lineitem, spec).metrics.select("key", "value", "unit")


# --- time axis -------------------------------------------------------------

DATED = """p AS (SELECT o_totalprice AS v, o_orderdate AS d, strftime(o_orderdate, '%Y-%m') AS label, year(o_orderdate) * 12 + month(o_orderdate) AS ord,
      'thang ' || strftime(o_orderdate, '%m') AS season, month(o_orderdate) AS no FROM orders),
    per AS (SELECT label, ord, season, no, avg(v) AS mean, row_number() OVER (ORDER BY ord) AS pos FROM p GROUP BY 1, 2, 3, 4)"""
QUARTERS = """q AS (SELECT o_totalprice AS v, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS label, year(o_orderdate) * 4 + quarter(o_orderdate) AS ord,
      'Q' || quarter(o_orderdate) AS season, quarter(o_orderdate) AS no FROM orders),
    per AS (SELECT label, ord, season, no, avg(v) AS mean, row_number() OVER (ORDER BY ord) AS pos FROM q GROUP BY 1, 2, 3, 4)"""


def periods(t, grain="month"):
    rows = timeline.moments(t.orders, "o_orderdate")
    return timeline.period_table(rows, ["o_totalprice"], grain)


@query(
    "tim1_labels",
    """SELECT 'month' AS grain, strftime(o_orderdate, '%Y-%m') AS label, (year(o_orderdate) * 12 + month(o_orderdate))::INT AS ord, 'thang ' || strftime(o_orderdate, '%m') AS season, month(o_orderdate)::INT AS season_no, count(*) AS n FROM orders GROUP BY ALL
    UNION ALL SELECT 'quarter', year(o_orderdate) || '-Q' || quarter(o_orderdate), year(o_orderdate) * 4 + quarter(o_orderdate), 'Q' || quarter(o_orderdate), quarter(o_orderdate), count(*) FROM orders GROUP BY ALL
    UNION ALL SELECT 'year', CAST(year(o_orderdate) AS VARCHAR), year(o_orderdate), '', 0, count(*) FROM orders GROUP BY ALL""",
)
def _(t):
    parts = [
        timeline.labelled(t.orders, g, "o_orderdate").groupBy("label", "ord", "season", "season_no").agg(F.count("*").alias("n")).select(F.lit(g).alias("grain"), "*")
        for g in timeline.GRAINS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "tim2_grain",
    """WITH c AS (SELECT count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS months, count(DISTINCT year(o_orderdate) * 4 + quarter(o_orderdate)) AS quarters, count(DISTINCT year(o_orderdate)) AS years FROM orders)
    SELECT *, CASE WHEN months <= 24 THEN 'month' WHEN quarters <= 24 THEN 'quarter' ELSE 'year' END AS grain FROM c""",
)
def _(t):
    return timeline.choose_grain(t.orders, "o_orderdate")


@query("tim3_period_means", f"WITH {DATED} SELECT 'o_totalprice' AS measure, pos AS position, label, round(mean, 4) AS mean FROM per")
def _(t):
    return timeline.period_means(periods(t))


@query("tim4_trend", f"WITH {DATED}, r AS (SELECT pos, {_rank('mean')} AS r FROM per) SELECT 'o_totalprice' AS measure, count(*) AS periods, round(corr(pos, r), 4) AS rho FROM r")
def _(t):
    return timeline.trend(periods(t))


@query("tim5_change", f"WITH {DATED}, c AS (SELECT pos, label, mean - lag(mean) OVER (ORDER BY ord) AS c FROM per) SELECT 'o_totalprice' AS measure, pos AS position, label, round(c, 4) AS change FROM c WHERE pos >= 2")
def _(t):
    return timeline.change(periods(t))


SEASONS = "s AS (SELECT season, no, count(DISTINCT ord) AS cycles, avg(v) AS mean FROM p GROUP BY 1, 2 HAVING count(DISTINCT ord) >= 2)"


@query("tim6_seasons", f"WITH {DATED}, {SEASONS} SELECT 'o_totalprice' AS measure, season, no::INT AS season_no, cycles, round(mean, 4) AS mean FROM s")
def _(t):
    return timeline.seasons(periods(t)).withColumn("mean", F.round("mean", 4))


@query(
    "tim6_season_edges",
    f"""WITH {DATED}, {SEASONS} SELECT 'o_totalprice' AS measure, 'peak' AS edge, no::INT AS season_no, round(mean, 4) AS mean FROM (SELECT * FROM s ORDER BY mean DESC, season LIMIT 1)
    UNION ALL SELECT 'o_totalprice', 'trough', no::INT, round(mean, 4) FROM (SELECT * FROM s ORDER BY mean, season LIMIT 1)""",
)
def _(t):
    return timeline.season_edges(timeline.seasons(periods(t))).withColumn("mean", F.round("mean", 4))


@query(
    "tim7_timeline",
    f"""WITH {QUARTERS}, s AS (SELECT season, no, count(DISTINCT ord) AS cycles, avg(v) AS mean FROM q GROUP BY 1, 2 HAVING count(DISTINCT ord) >= 2),
    r AS (SELECT pos, {_rank("mean")} AS r FROM per), c AS (SELECT pos, label, mean - lag(mean) OVER (ORDER BY ord) AS c FROM per),
    hi AS (SELECT * FROM s ORDER BY mean DESC, season LIMIT 1), lo AS (SELECT * FROM s ORDER BY mean, season LIMIT 1),
    m AS (SELECT 'o_totalprice.by.o_orderdate.' || label AS key, mean AS value FROM per
      UNION ALL SELECT 'o_totalprice.trend.with.o_orderdate', corr(pos, r) FROM r
      UNION ALL SELECT 'o_totalprice.change.by.o_orderdate.' || label, c FROM c WHERE pos >= 2
      UNION ALL SELECT 'o_totalprice.seasonal.' || season, mean FROM s
      UNION ALL SELECT 'o_totalprice.seasonal.peak_number', no FROM hi UNION ALL SELECT 'o_totalprice.seasonal.peak_value', mean FROM hi
      UNION ALL SELECT 'o_totalprice.seasonal.trough_number', no FROM lo UNION ALL SELECT 'o_totalprice.seasonal.trough_value', mean FROM lo)
    SELECT key, round(value, 4) AS value FROM m""",
)
def _(t):
    return timeline.measure(t.orders, "o_orderdate", ["o_totalprice"], grain="quarter").metrics.select("key", "value")


@query(
    "tim7_refusals",
    """SELECT 'o_totalprice' AS subject, 'only one cycle, nothing can be said about seasons' AS reason UNION ALL SELECT 'o_orderdate', 'too few periods to call a direction a trend'
    UNION ALL SELECT 'o_orderpriority', 'no numeric value to follow'""",
)
def _(t):
    few = t.orders.filter((F.year("o_orderdate") == 1996) & (F.quarter("o_orderdate") < 4))
    return timeline.measure(few, "o_orderdate", ["o_totalprice", "o_orderpriority"], grain="quarter").refused.select("subject", "reason")


GROWTH = """g AS (SELECT CAST(c_nationkey AS VARCHAR) AS series, m, sum(v) OVER (PARTITION BY c_nationkey ORDER BY m) AS y FROM (
      SELECT c_nationkey, year(o_orderdate) * 12 + month(o_orderdate) AS m, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2))"""


@query(
    "tim8_project",
    f"""WITH {GROWTH}, x AS (SELECT series, y, row_number() OVER (PARTITION BY series ORDER BY m) - 1.0 AS x FROM g),
    f AS (SELECT series, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, regr_syy(y, x) AS syy FROM x GROUP BY 1)
    SELECT series, n AS periods, round(b * (n + 1) + a - sqrt(syy * (1 - r2) / (n - 1)), 2) AS low, round(b * (n + 1) + a + sqrt(syy * (1 - r2) / (n - 1)), 2) AS high, round(r2, 4) AS r2, NULL AS refusal FROM f""",
)
def _(t):
    from metricloom.operators.bi import running_totals

    monthly = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").cast("string").alias("series"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("m"))
        .agg(F.sum("o_totalprice").alias("v"))
    )
    out = timeline.project(running_totals(monthly, ["series"], ["m"], "v", "y"), "series", ["m"], "y", ahead=2)
    return out.withColumns({"low": F.round("low", 2), "high": F.round("high", 2)})


@query(
    "tim8_refusals",
    """SELECT event_type AS series, count(DISTINCT date_trunc('day', ts)) AS periods, CASE WHEN count(DISTINCT date_trunc('day', ts)) < 8 THEN 'too few periods' ELSE 'too far ahead' END AS refusal FROM events GROUP BY 1""",
)
def _(t):
    daily = t.events.groupBy(F.col("event_type").alias("series"), F.date_trunc("day", "ts").alias("day")).agg(F.avg("value").alias("y"))
    return timeline.project(daily, "series", ["day"], "y", ahead=1000).select("series", "periods", "refusal")


@query(
    "tim9_series_in_metrics",
    """SELECT 'o_totalprice.mean by month' AS series, strftime(o_orderdate, '%Y-%m') AS label, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 2""",
)
def _(t):
    df = t.orders.select("o_totalprice", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    found = timeline.series_in(compute_metrics(df, ["month", "o_orderstatus"], ["o_totalprice"], top=df.select("month").distinct().count()))
    return found.filter(F.col("series").startswith("o_totalprice"))
