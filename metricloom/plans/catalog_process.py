"""Process-mining queries (PRC)."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.functions import text
from metricloom.operators import cohorts, process
from metricloom.plans.registry import query


def event_log(t, extra=()):
    return process.EventLog(t.events, "user_id", "event_type", "event_id", ts="ts", extra=tuple(extra))


def dialogue_log(t):
    return process.EventLog(t.conversations, "conv_id", "role", "turn")


def cohort_log(t):
    """Events with a channel that is fixed per user and a weekday that is not."""
    df = t.events.select(
        "event_id", "user_id", "event_type", "ts",
        F.when(F.col("user_id") % 3 == 0, "app").when(F.col("user_id") % 3 == 1, "web").otherwise("shop").alias("channel"),
        F.lit("north").alias("region"),
        F.dayofweek("ts").cast("string").alias("weekday"),
        (F.col("user_id") % 40).cast("string").alias("branch"),
        F.when(F.col("user_id") % 2 == 0, "even").alias("parity"),
    )
    return process.EventLog(df, "user_id", "event_type", "event_id", ts="ts")


STEPS = """ev AS (SELECT CAST(user_id AS VARCHAR) AS case_id, event_type AS activity, ts, event_id FROM events
      WHERE user_id IS NOT NULL AND event_type IS NOT NULL),
    nx AS (SELECT case_id, activity, ts, event_id, lead(activity) OVER w AS next_activity, lead(ts) OVER w AS next_ts,
      row_number() OVER w AS pos FROM ev WINDOW w AS (PARTITION BY case_id ORDER BY ts, event_id)),
    st AS (SELECT case_id, activity, next_activity, (epoch_us(next_ts) - epoch_us(ts)) / 3.6e9 AS wait FROM nx WHERE next_ts IS NOT NULL)"""

TRACES = """traces AS (SELECT conv_id, list(role ORDER BY turn) AS trace FROM conversations GROUP BY 1),
    variants AS (SELECT trace, count(*) AS cases FROM traces GROUP BY 1),
    top AS (SELECT row_number() OVER (ORDER BY cases DESC, trace) AS rank, trace, cases FROM variants)"""

TRANSITIONS = f"""{STEPS},
    tr AS (SELECT activity, next_activity, count(*) AS observations, sum(wait) AS total, median(wait) AS med FROM st GROUP BY 1, 2),
    ranked AS (SELECT row_number() OVER (ORDER BY total DESC, activity, next_activity) AS rank, * FROM tr)"""


@query("prc1_ordered_events", f"WITH {STEPS} SELECT case_id, activity, event_id AS row_id, pos AS position FROM nx")
def _(t):
    return process.ordered_events(event_log(t)).select("case_id", "activity", "row_id", "position")


@query(
    "prc1_unreadable_times",
    """SELECT 'order_events' AS op, 'when_text' AS subject, round(count(*) FILTER (WHERE event_id % 5 <> 0)::DOUBLE / count(*), 4) AS observed, 0.9::DOUBLE AS required FROM events""",
)
def _(t):
    df = t.events.withColumn(
        "when_text", F.when(F.col("event_id") % 5 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    )
    out = process.mine_process(process.EventLog(df, "user_id", "event_type", "event_id", ts="when_text"))
    return out.refused.filter("subject = 'when_text'").select("op", "subject", F.round("observed", 4).alias("observed"), "required")


@query(
    "prc2_volume",
    """SELECT count(DISTINCT user_id) AS cases, count(*) AS events, count(DISTINCT event_type) AS activities,
    round(count(*)::DOUBLE / count(DISTINCT user_id), 4) AS events_per_case FROM events""",
)
def _(t):
    return process.volume(event_log(t))


@query("prc2_activity_counts", "SELECT event_type AS activity, count(*) AS events FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(t):
    return process.activity_counts(event_log(t)).orderBy(F.desc("events"), "activity").limit(10)


def joined(names, separator):
    """Names of steps in the order of their position, as one text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", names))), lambda e: e[names]), separator)


def shown_variants(log):
    best = process.top_variants(log)
    paths = process.variant_paths(log, best).groupBy("rank").agg(joined("activity", " > ").alias("trace"))
    return best.join(paths, "rank")


@query(
    "prc3_variants",
    f"""WITH {TRACES} SELECT rank, array_to_string(trace, ' > ') AS trace, cases,
    round(100.0 * cases / (SELECT count(*) FROM traces), 4) AS share_pct FROM top WHERE rank <= 5""",
)
def _(t):
    return shown_variants(dialogue_log(t)).select("rank", "trace", "cases", "share_pct")


@query(
    "prc3_event_variants",
    """WITH traces AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS trace FROM events GROUP BY 1),
    variants AS (SELECT trace, count(*) AS cases FROM traces GROUP BY 1)
    SELECT row_number() OVER (ORDER BY cases DESC, trace) AS rank, array_to_string(trace, ' > ') AS trace, cases FROM variants QUALIFY rank <= 5""",
)
def _(t):
    return shown_variants(event_log(t)).select("rank", "trace", "cases")


@query(
    "prc4_rework_by_activity",
    """WITH r AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT event_type AS activity, count(*) FILTER (WHERE n > 1) AS cases FROM r GROUP BY 1 HAVING count(*) FILTER (WHERE n > 1) > 0""",
)
def _(t):
    return process.rework_by_activity(event_log(t))


@query(
    "prc4_rework_cases",
    f"""WITH {STEPS}, r AS (SELECT case_id, activity, count(*) AS n FROM ev GROUP BY 1, 2), c AS (SELECT case_id, max(n) > 1 AS rep FROM r GROUP BY 1),
    l AS (SELECT count(DISTINCT case_id) AS n FROM nx WHERE next_activity = activity)
    SELECT count(*) AS cases, count(*) FILTER (WHERE rep) AS repeated_cases, (SELECT n FROM l) AS self_loop_cases,
    round(100.0 * count(*) FILTER (WHERE rep) / count(*), 4) AS repeated_pct, round(100.0 * (SELECT n FROM l) / count(*), 4) AS self_loop_pct FROM c""",
)
def _(t):
    return process.rework_cases(event_log(t))


@query(
    "prc5_durations",
    """WITH d AS (SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 AS h FROM events GROUP BY 1)
    SELECT round(median(h), 4) AS median_hours, round(avg(h), 4) AS mean_hours, round(quantile_cont(h, 0.95), 4) AS p95_hours, round(max(h), 4) AS max_hours FROM d""",
)
def _(t):
    return process.durations(event_log(t))


@query(
    "prc6_transitions",
    f"""WITH {TRANSITIONS} SELECT rank, activity, next_activity, observations, round(total, 4) AS total_hours,
    CASE WHEN observations >= 10 THEN round(med, 4) END AS median_hours FROM ranked WHERE rank <= 5""",
)
def _(t):
    return process.transitions(event_log(t))


@query(
    "prc6_all_transitions",
    f"""WITH {TRANSITIONS} SELECT activity, next_activity, observations, round(total, 4) AS total_hours,
    CASE WHEN observations >= 10 THEN round(med, 4) END AS median_hours FROM ranked""",
)
def _(t):
    return process.transitions(event_log(t), limit=None)


@query(
    "prc7_process_metrics",
    f"""WITH {TRANSITIONS},
    tc AS (SELECT case_id, list(activity ORDER BY ts, event_id) AS trace FROM ev GROUP BY 1),
    va AS (SELECT trace, count(*) AS cases FROM tc GROUP BY 1),
    tv AS (SELECT row_number() OVER (ORDER BY cases DESC, trace) AS rank, cases FROM va),
    n AS (SELECT count(DISTINCT case_id)::DOUBLE AS n FROM ev),
    r AS (SELECT case_id, activity, count(*) AS n FROM ev GROUP BY 1, 2),
    rc AS (SELECT case_id, max(n) > 1 AS rep FROM r GROUP BY 1),
    ac AS (SELECT activity, count(*) AS events FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10),
    ra AS (SELECT activity, count(*) AS cases FROM r WHERE r.n > 1 GROUP BY 1 ORDER BY 1 LIMIT 10),
    d AS (SELECT case_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 AS h FROM ev GROUP BY 1),
    m AS (
      SELECT 'process.cases' AS key, n AS value FROM n
      UNION ALL SELECT 'process.events', count(*) FROM ev
      UNION ALL SELECT 'process.events.per_case.mean', count(*) / (SELECT n FROM n) FROM ev
      UNION ALL SELECT 'process.activities.distinct', count(DISTINCT activity) FROM ev
      UNION ALL SELECT 'process.variants', count(*) FROM va
      UNION ALL SELECT 'process.variant.' || rank || '.cases', cases FROM tv WHERE rank <= 5
      UNION ALL SELECT 'process.variant.' || rank || '.share_pct', 100.0 * cases / (SELECT n FROM n) FROM tv WHERE rank <= 5
      UNION ALL SELECT 'process.variant_coverage.top5_pct', 100.0 * sum(cases) / (SELECT n FROM n) FROM tv WHERE rank <= 5
      UNION ALL SELECT 'process.rework.cases', count(*) FILTER (WHERE rep) FROM rc
      UNION ALL SELECT 'process.rework.cases_pct', 100.0 * count(*) FILTER (WHERE rep) / count(*) FROM rc
      UNION ALL SELECT 'process.selfloop.cases', count(DISTINCT case_id) FROM nx WHERE next_activity = activity
      UNION ALL SELECT 'process.selfloop.cases_pct', 100.0 * count(DISTINCT case_id) / (SELECT n FROM n) FROM nx WHERE next_activity = activity
      UNION ALL SELECT 'process.activity.' || activity || '.events', events FROM ac
      UNION ALL SELECT 'process.rework.' || activity || '.cases', cases FROM ra
      UNION ALL SELECT 'process.rework.' || activity || '.cases_pct', 100.0 * cases / (SELECT n FROM n) FROM ra
      UNION ALL SELECT 'process.duration.median_hours', median(h) FROM d
      UNION ALL SELECT 'process.duration.mean_hours', avg(h) FROM d
      UNION ALL SELECT 'process.duration.p95_hours', quantile_cont(h, 0.95) FROM d
      UNION ALL SELECT 'process.duration.max_hours', max(h) FROM d
      UNION ALL SELECT 'process.wait.' || activity || '__to__' || next_activity || '.total_hours', total FROM ranked WHERE rank <= 5
      UNION ALL SELECT 'process.wait.' || activity || '__to__' || next_activity || '.observations', observations FROM ranked WHERE rank <= 5
      UNION ALL SELECT 'process.wait.' || activity || '__to__' || next_activity || '.median_hours', med FROM ranked WHERE rank <= 5 AND observations >= 10)
    SELECT key, round(value, 4) AS value FROM m""",
)
def _(t):
    return process.mine_process(event_log(t)).metrics.select("key", "value")


@query(
    "prc7_refusals",
    """SELECT * FROM (VALUES ('mine_process', 'timestamp'), ('mine_process', 'resource')) v(op, subject)""",
)
def _(t):
    return process.mine_process(dialogue_log(t)).refused.select("op", "subject")


@query(
    "prc7_slug_map",
    """WITH n AS (SELECT DISTINCT p_brand || CASE WHEN p_size % 2 = 0 THEN '/' ELSE '#' END || p_type AS activity FROM part),
    b AS (SELECT activity, substr(regexp_replace(activity, '[^a-zA-Z0-9_-]', '_', 'g'), 1, 40) AS base FROM n)
    SELECT activity, CASE WHEN row_number() OVER w = 1 THEN base ELSE base || '_' || row_number() OVER w END AS slug FROM b WINDOW w AS (PARTITION BY base ORDER BY activity)""",
)
def _(t):
    name = F.concat("p_brand", F.when(F.col("p_size") % 2 == 0, "/").otherwise("#"), "p_type")
    return process.slug_map(t.part.select(name.alias("activity")))


@query(
    "prc8_case_attributes",
    """SELECT 'channel' AS "column", count(DISTINCT user_id % 3) AS "distinct" FROM events""",
)
def _(t):
    return cohorts.case_attributes(cohort_log(t))


@query(
    "prc9_case_table",
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS case_id, list(event_type ORDER BY ts, event_id) AS trace, count(*) AS events,
      round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 4) AS hours, count(DISTINCT event_type) < count(*) AS repeated FROM events GROUP BY 1)
    SELECT case_id, events, hours, repeated, array_to_string(trace, '>') AS trace FROM e""",
)
def _(t):
    log = event_log(t)
    traces = process.ordered_events(log).groupBy("case_id").agg(joined("activity", ">").alias("trace"))
    return cohorts.case_table(log).join(traces, "case_id").select("case_id", "events", "hours", "repeated", "trace")


GAPS = f"""{STEPS}, lab AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS case_id, user_id % 3 = 0 AS focus FROM events),
    k AS (SELECT count(*) FILTER (WHERE focus)::DOUBLE AS f, count(*) FILTER (WHERE NOT focus)::DOUBLE AS o FROM lab),
    g AS (SELECT activity, next_activity, sum(CASE WHEN focus THEN wait ELSE 0 END) / (SELECT f FROM k) AS fh,
      sum(CASE WHEN focus THEN 0 ELSE wait END) / (SELECT o FROM k) AS oh FROM st JOIN lab USING (case_id) GROUP BY 1, 2),
    p AS (SELECT sum(fh - oh) AS pos FROM g WHERE fh > oh)"""


@query(
    "prc10_cohort_gap",
    f"""WITH {GAPS} SELECT row_number() OVER (ORDER BY fh - oh DESC, activity, next_activity) AS rank, activity, next_activity, round(fh, 4) AS focus_hours,
    round(oh, 4) AS other_hours, round(fh - oh, 4) AS gap_hours, round(100.0 * (fh - oh) / (SELECT pos FROM p), 4) AS share_of_gap_pct
    FROM g WHERE fh > oh QUALIFY rank <= 8""",
)
def _(t):
    steps, _ = cohorts.compare_cohorts(cohort_log(t), "channel", "app")
    return steps


@query(
    "prc10_cohort_metrics",
    f"""WITH {GAPS}, r AS (SELECT row_number() OVER (ORDER BY fh - oh DESC, activity, next_activity) AS rank, *, activity || '__to__' || next_activity AS step FROM g WHERE fh > oh),
    m AS (SELECT 'process.gap.total_hours_per_case' AS key, pos AS value FROM p
      UNION ALL SELECT 'process.cases.by.channel.app', f FROM k
      UNION ALL SELECT 'process.gap.' || step || '.hours_per_case', fh - oh FROM r WHERE rank <= 8
      UNION ALL SELECT 'process.gap.' || step || '.share_pct', 100.0 * (fh - oh) / (SELECT pos FROM p) FROM r WHERE rank <= 8
      UNION ALL SELECT 'process.gap.' || step || '.focus_hours_per_case', fh FROM r WHERE rank <= 8)
    SELECT key, round(value, 4) AS value FROM m""",
)
def _(t):
    _, outcome = cohorts.compare_cohorts(cohort_log(t), "channel", "app")
    return outcome.metrics.select("key", "value")


@query(
    "prc10_cohort_refusal",
    """SELECT 'compare_cohorts' AS op, 'branch=7' AS subject, count(DISTINCT user_id)::DOUBLE AS observed, 15::DOUBLE AS required FROM events WHERE user_id % 40 = 7""",
)
def _(t):
    _, outcome = cohorts.compare_cohorts(cohort_log(t), "branch", "7")
    return outcome.refused.select("op", "subject", "observed", "required")


@query(
    "prc11_variant_edges",
    f"""WITH {TRACES}, kept AS (SELECT rank, list_concat(['(start)'], list_concat(trace, ['(end)'])) AS path FROM top WHERE rank <= 5),
    e AS (SELECT rank, path[i] AS source, path[i + 1] AS target FROM kept, LATERAL (SELECT unnest(range(1, len(path))) AS i))
    SELECT source, target, min(rank) AS first_rank, count(DISTINCT rank) AS variants FROM e GROUP BY 1, 2""",
)
def _(t):
    return process.variant_edges(dialogue_log(t))


def _order_sql(before: str, after: str) -> str:
    return f"""SELECT 'order:{before}__before__{after}' AS test, count(*) AS violations, count(*) FILTER (WHERE b IS NULL) AS missing FROM (
      SELECT case_id, min(pos) FILTER (WHERE activity = '{before}') AS b, min(pos) FILTER (WHERE activity = '{after}') AS a FROM nx GROUP BY 1)
      WHERE a IS NOT NULL AND (b IS NULL OR b > a)"""


@query("prc12_sequence_order", f"WITH {STEPS} {_order_sql('view', 'purchase')} UNION ALL {_order_sql('signup', 'error')}")
def _(t):
    return process.sequence_order(event_log(t), [("view", "purchase"), ("signup", "error")])


@query(
    "prc12_order_violations",
    f"""WITH {STEPS}, f AS (SELECT case_id, min(pos) FILTER (WHERE activity = 'view') AS b, min(pos) FILTER (WHERE activity = 'click') AS a FROM nx GROUP BY 1)
    SELECT f.case_id, nx.event_id AS row_id, b IS NULL AS missing FROM f JOIN nx ON nx.case_id = f.case_id AND nx.pos = f.a WHERE a IS NOT NULL AND (b IS NULL OR b > a)""",
)
def _(t):
    return process.order_violations(event_log(t), "view", "click")


@query(
    "prc13_segregation_of_duties",
    """WITH a AS (SELECT user_id, CAST(event_id % 7 AS VARCHAR) AS res, count(*) AS n FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1, 2 HAVING count(DISTINCT event_type) = 2)
    SELECT 'sod:click__vs__purchase' AS test, coalesce(sum(n), 0)::BIGINT AS events, (SELECT string_agg(res, ', ' ORDER BY res) FROM (SELECT DISTINCT res FROM a ORDER BY res LIMIT 3)) AS culprits FROM a""",
)
def _(t):
    df = t.events.withColumn("agent", F.col("event_id") % 7)
    log = process.EventLog(df, "user_id", "event_type", "event_id", ts="ts", resource="agent")
    return process.segregation_of_duties(log, [("click", "purchase")])


@query(
    "prc14_variant_signature",
    """SELECT CAST(conv_id AS VARCHAR) AS case_id, count(*) AS events, substr(sha256(string_agg(role, '|' ORDER BY turn)), 1, 16) AS signature FROM conversations GROUP BY 1""",
)
def _(t):
    return process.variant_signatures(dialogue_log(t))


@query(
    "sql7_keep_activities",
    """WITH c AS (SELECT user_id, count(*) FILTER (WHERE event_type IN ('click', 'purchase')) AS k, count(*) AS n FROM events GROUP BY 1)
    SELECT sum(n - k)::BIGINT AS dropped_events, count(*) FILTER (WHERE k = 0) AS lost_cases, sum(k)::BIGINT AS kept_events FROM c""",
)
def _(t):
    return process.keep_activities(event_log(t), ["click", "purchase"])[1]


@query(
    "str5_trace_preview",
    """WITH traces AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS tr FROM events GROUP BY 1)
    SELECT CAST(user_id AS VARCHAR) AS case_id, array_to_string(tr[1:6], ' -> ') || CASE WHEN len(tr) > 6 THEN ' -> ... (+' || (len(tr) - 6) || ' steps)' ELSE '' END AS path FROM traces""",
)
def _(t):
    return process.case_traces(event_log(t)).select("case_id", text.preview(F.col("head"), F.col("events")).alias("path"))
