"""Metric set queries (AGG1-8, AGG20, AGG21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.operators import metrics
from metricloom.operators.common import side_by_side
from metricloom.operators.profile import value_table
from metricloom.plans.registry import cells_sql, number_sql, query
from metricloom.session import materialize

N = number_sql("value")
LINE_NUMBERS = ["l_discount", "l_extendedprice", "l_linenumber", "l_quantity", "l_tax"]
LINE_GROUPS = ["l_returnflag", "l_linestatus", "l_suppkey"]

LINES = f"""cells AS {cells_sql("lineitem", LINE_NUMBERS + ["l_returnflag", "l_linestatus", "l_suppkey"])},
    total AS (SELECT count(*) AS total FROM lineitem),
    dims AS (SELECT "column", value, count(*) AS n, row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, value) AS rank
      FROM cells WHERE "column" IN ('l_returnflag', 'l_linestatus', 'l_suppkey') AND value IS NOT NULL GROUP BY 1, 2)"""


@query("agg1_rows_total", "SELECT 'rows.total' AS key, count(*)::DOUBLE AS value, 'row' AS unit FROM lineitem")
def _(t):
    return metrics.row_total(t.lineitem).select("key", "value", "unit")


@query(
    "agg2_distinct_and_nulls",
    f"""WITH src AS (SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
    cells AS {cells_sql("src", ["doc_id", "lang", "quality", "toxic"])}
    SELECT "column" || '.distinct' AS key, count(DISTINCT value)::DOUBLE AS value FROM cells GROUP BY "column"
    UNION ALL SELECT "column" || '.null_pct', round(100.0 * (count(*) - count(value)) / count(*), 4) FROM cells GROUP BY "column" """,
)
def _(t):
    df = t.documents.join(t.labels, "doc_id", "left").select("doc_id", "lang", "quality", "toxic")
    return metrics.column_metrics(df).select("key", "value")


@query(
    "agg3_summaries",
    f"""WITH {LINES}, x AS (SELECT "column", {N} AS x FROM cells WHERE "column" NOT IN ('l_returnflag', 'l_linestatus', 'l_suppkey'))
    SELECT "column" || '.' || s AS key, round(v, 4) AS value FROM (
      SELECT "column", unnest(['sum', 'mean', 'median', 'min', 'max']) AS s, unnest([sum(x), avg(x), median(x), min(x), max(x)]) AS v FROM x GROUP BY 1)""",
)
def _(t):
    return metrics.summary_metrics(t.lineitem, LINE_NUMBERS).select("key", "value")


@query(
    "agg4_flag_counts",
    """WITH f AS (SELECT 'quality' AS c, quality AS v, count(*) AS n FROM labels GROUP BY 2 UNION ALL SELECT 'toxic', toxic, count(*) FROM labels GROUP BY 2),
    t AS (SELECT count(*) AS t FROM labels)
    SELECT c || '.' || v || '.count' AS key, n::DOUBLE AS value FROM f UNION ALL SELECT c || '.' || v || '.share_pct', round(100.0 * n / t, 4) FROM f, t""",
)
def _(t):
    return metrics.flag_metrics(t.labels).select("key", "value")


@query(
    "agg5_category_counts",
    f"""WITH {LINES}
    SELECT "column" || '.' || value || '.count' AS key, n::DOUBLE AS value FROM dims WHERE rank <= 20
    UNION ALL SELECT "column" || '.' || value || '.share_pct', round(100.0 * n / total, 4) FROM dims, total WHERE rank <= 20
    UNION ALL SELECT "column" || '.categories_omitted', (count(*) - 20)::DOUBLE FROM dims GROUP BY "column" HAVING count(*) > 20""",
)
def _(t):
    return metrics.category_metrics(value_table(t.lineitem, LINE_GROUPS)).select("key", "value")


def _means_sql(measures, dims):
    return " UNION ALL ".join(
        f"SELECT '{m}' AS m, '{d}' AS d, CAST({d} AS VARCHAR) AS g, avg({m}) AS v FROM lineitem GROUP BY 3" for m in measures for d in dims
    )


@query(
    "agg6_breakdowns",
    f"""WITH {LINES}, b AS ({_means_sql(LINE_NUMBERS, LINE_GROUPS)})
    SELECT m || '.mean.by.' || d || '.' || g AS key, round(v, 4) AS value FROM b JOIN dims ON dims."column" = b.d AND dims.value = b.g WHERE rank <= 20""",
)
def _(t):
    return metrics.breakdowns(t.lineitem, LINE_GROUPS, LINE_NUMBERS).select("key", "value")


@query(
    "agg6_breakdowns_capped",
    f"""WITH {LINES}, b AS ({_means_sql(LINE_NUMBERS, LINE_GROUPS)}),
    o AS (SELECT b.*, row_number() OVER (ORDER BY CASE d WHEN 'l_returnflag' THEN 0 WHEN 'l_linestatus' THEN 1 ELSE 2 END, rank, m) AS place
      FROM b JOIN dims ON dims."column" = b.d AND dims.value = b.g WHERE rank <= 20)
    SELECT m || '.mean.by.' || d || '.' || g AS key, round(v, 4) AS value FROM o WHERE place <= 40
    UNION ALL SELECT 'breakdowns_omitted', (count(*) - 40)::DOUBLE FROM o""",
)
def _(t):
    return metrics.breakdowns(t.lineitem, LINE_GROUPS, LINE_NUMBERS, limit=40).select("key", "value")


@query(
    "agg7_outcome_rates",
    """WITH s AS (SELECT l_linestatus AS o, l_returnflag AS f, CAST(l_linenumber AS VARCHAR) AS n FROM lineitem),
    p AS (SELECT 'l_returnflag' AS d, f AS g, o FROM s UNION ALL SELECT 'l_linenumber', n, o FROM s),
    c AS (SELECT d, g, count(*) AS t, count(*) FILTER (WHERE o = 'F') AS nf, count(*) FILTER (WHERE o = 'O') AS no FROM p GROUP BY 1, 2)
    SELECT 'l_linestatus.F.share_pct.by.' || d || '.' || g AS key, round(100.0 * nf / t, 4) AS value FROM c WHERE t >= 5
    UNION ALL SELECT 'l_linestatus.O.share_pct.by.' || d || '.' || g, round(100.0 * no / t, 4) FROM c WHERE t >= 5""",
)
def _(t):
    return metrics.outcome_rates(t.lineitem, ["l_linestatus", "l_returnflag", "l_linenumber"]).select("key", "value")


def order_metrics(t):
    """The metric set of orders, stored once: the queries below read it several times."""
    return materialize(metrics.compute_metrics(
        t.orders.select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), ["o_orderstatus", "o_orderpriority"], ["o_totalprice"]
    ))


ORDER_METRICS = f"""cells AS {cells_sql("orders", ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])},
    total AS (SELECT count(*) AS total FROM orders),
    dims AS (SELECT "column", value, count(*) AS n FROM cells WHERE "column" IN ('o_orderstatus', 'o_orderpriority') GROUP BY 1, 2),
    slug AS (SELECT *, substr(regexp_replace(value, '[^a-zA-Z0-9_-]', '_', 'g'), 1, 40) AS s FROM dims),
    mean AS (SELECT 'o_orderstatus' AS d, o_orderstatus AS g, avg(o_totalprice) AS v FROM orders GROUP BY 2
      UNION ALL SELECT 'o_orderpriority', o_orderpriority, avg(o_totalprice) FROM orders GROUP BY 2),
    m AS (SELECT 'rows.total' AS key, 'rows' AS measure, 'total' AS stat, NULL AS dim, NULL AS grp, total::DOUBLE AS value FROM total
      UNION ALL SELECT "column" || '.distinct', "column", 'distinct', NULL, NULL, count(DISTINCT value) FROM cells GROUP BY "column"
      UNION ALL SELECT "column" || '.null_pct', "column", 'null_pct', NULL, NULL, 100.0 * (count(*) - count(value)) / count(*) FROM cells GROUP BY "column"
      UNION ALL SELECT 'o_totalprice.' || s, 'o_totalprice', s, NULL, NULL, v FROM (SELECT unnest(['sum', 'mean', 'median', 'min', 'max']) AS s,
        unnest([sum(o_totalprice), avg(o_totalprice), median(o_totalprice), min(o_totalprice), max(o_totalprice)]) AS v FROM orders)
      UNION ALL SELECT "column" || '.' || s || '.count', "column", 'count', "column", value, n FROM slug
      UNION ALL SELECT "column" || '.' || s || '.share_pct', "column", 'share_pct', "column", value, 100.0 * n / total FROM slug, total
      UNION ALL SELECT 'o_totalprice.mean.by.' || d || '.' || s, 'o_totalprice', 'mean', d, g, v FROM mean JOIN slug ON slug."column" = d AND slug.value = g)"""


@query("agg_metric_set", f"WITH {ORDER_METRICS} SELECT key, round(value, 4) AS value FROM m")
def _(t):
    return order_metrics(t).select("key", "value")


@query(
    "agg8_rankings",
    f"""WITH {ORDER_METRICS}, f AS (SELECT measure || '|' || stat || '|' || dim AS family, grp, key, round(value, 4) AS value FROM m WHERE grp IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY value DESC, grp) AS hi, row_number() OVER (PARTITION BY family ORDER BY value, grp) AS lo, count(*) OVER (PARTITION BY family) AS c FROM f)
    SELECT family, 'highest' AS position, grp, key, value FROM r WHERE hi = 1 AND c >= 2 UNION ALL SELECT family, 'lowest', grp, key, value FROM r WHERE lo = 1 AND c >= 2""",
)
def _(t):
    return metrics.rankings(order_metrics(t))


SHORT = f"""{ORDER_METRICS}, k AS (SELECT key, round(value, 4) AS value,
      CASE WHEN split_part(key, '.', 1) = 'o_orderstatus' THEN 0 ELSE 1 END AS asked,
      CASE WHEN key = 'rows.total' THEN 0 WHEN NOT regexp_matches(key, 'rows[.]total|[.](mean|median|share_pct|count|p_value|f_stat)|[.]corr[.]|[.]r2[.]|[.]eta_sq') THEN 3
        WHEN key LIKE '%.by.%' THEN 2 ELSE 1 END AS kind FROM m),
    ranked AS (SELECT *, row_number() OVER (ORDER BY asked, kind, key) AS place FROM k)"""


@query("agg20_shortlist_order", f"WITH {SHORT} SELECT key, value, place FROM ranked")
def _(t):
    shown, _ = metrics.shortlist(order_metrics(t), ["o_orderstatus"], budget=10**9)
    from metricloom.scale import Sequenced

    return Sequenced(shown, [], ["used"]).with_position("place").rows().select("key", "value", "place")


@query("agg20_shortlist_budget")
def _(t):
    shown, note = metrics.shortlist(order_metrics(t), ["o_orderstatus"], budget=900)
    return side_by_side(note, shown.agg(F.max("used").alias("used")))


@query(
    "agg20_metric_families",
    f"""WITH {ORDER_METRICS}, h AS (SELECT split_part(key, '.', 1) AS f, count(*) AS n FROM m GROUP BY 1)
    SELECT CASE WHEN n < 2 THEN '(loose)' ELSE f END AS family, sum(n)::BIGINT AS metrics FROM h GROUP BY 1""",
)
def _(t):
    return metrics.metric_families(order_metrics(t))


@query(
    "agg21_read_metrics",
    f"""WITH {ORDER_METRICS}, v AS (SELECT key, round(value, 4) AS value FROM m),
    span AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
    r AS (SELECT key, value, CASE WHEN key LIKE '%.share_pct' THEN 'share' ELSE 'in_range' END AS kind,
        CASE WHEN key LIKE '%.share_pct' THEN value ELSE greatest(0.0, least(100.0, 100.0 * (value - lo) / (hi - lo))) END AS place FROM v, span
      WHERE key LIKE '%.share_pct' OR (key LIKE 'o_totalprice.%' AND regexp_matches(key, '[.](mean|median|min|max)([.]by[.]|$)')))
    SELECT key, value, kind, CASE kind WHEN 'share' THEN CASE WHEN place < 5 THEN 'very small' WHEN place < 20 THEN 'small' WHEN place < 50 THEN 'notable' WHEN place < 80 THEN 'majority' ELSE 'nearly all' END
      ELSE CASE WHEN place < 20 THEN 'near lowest' WHEN place < 40 THEN 'below middle' WHEN place < 60 THEN 'around middle' WHEN place < 80 THEN 'above middle' ELSE 'near highest' END END AS level,
      round(place, 2) AS position FROM r""",
)
def _(t):
    return metrics.read_metrics(order_metrics(t))
