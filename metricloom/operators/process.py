"""Event-log measurements: variants, rework, durations, waiting times, conformance."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom import scale
from metricloom.functions import dates, text
from metricloom.operators import paths
from metricloom.operators.common import Outcome, metric, metric_rows, refusals, side_by_side, stacked
from metricloom.session import materialize

MIN_CASES = 5
MIN_MEDIAN = 10
MIN_PARSED = 0.9
TOP_VARIANTS = 5
TOP_TRANSITIONS = 5
TOP_ACTIVITIES = 10
#: First steps of a path that are kept for previews and settle most ties.
HEAD_STEPS = 100

CASE, ACTIVITY, MOMENT, RESOURCE, ROW, AT = "case_id", "activity", "moment", "resource", "row_id", "_at"
_LAST = 2**63 - 1


@dataclass(frozen=True)
class EventLog:
    """A table with declared roles. ``row_id`` is the original row order and unique."""

    df: DataFrame
    case: str
    activity: str
    row_id: str
    ts: str | None = None
    resource: str | None = None
    extra: tuple[str, ...] = field(default=())

    def __post_init__(self):
        named = [self.case, self.activity, self.row_id, self.ts, self.resource]
        missing = [c for c in named if c and c not in self.df.columns]
        if missing:
            raise ValueError(f"the table has no column {missing}")

    @cached_property
    def events(self) -> DataFrame:
        """Usable events with uniform names; ``_at`` sorts untimed events last."""
        kinds = {f.name: f.dataType for f in self.df.schema.fields}
        moment = dates.as_moment(F.col(self.ts), kinds[self.ts]) if self.ts else F.lit(None).cast("timestamp")
        out = self.df.filter(F.col(self.case).isNotNull() & F.col(self.activity).isNotNull()).select(
            F.col(self.case).cast("string").alias(CASE),
            F.col(self.activity).cast("string").alias(ACTIVITY),
            moment.alias(MOMENT),
            (F.col(self.resource).cast("string") if self.resource else F.lit(None).cast("string")).alias(RESOURCE),
            F.col(self.row_id).alias(ROW),
            *self.extra,
        )
        if not self.timed:
            out = out.withColumn(MOMENT, F.lit(None).cast("timestamp"))
        return out.withColumn(AT, F.coalesce(F.unix_micros(MOMENT), F.lit(_LAST)))

    @cached_property
    def counts(self) -> dict:
        """Rows in, rows usable, timestamps read (one pass)."""
        kinds = {f.name: f.dataType for f in self.df.schema.fields}
        usable = F.col(self.case).isNotNull() & F.col(self.activity).isNotNull()
        moment = dates.as_moment(F.col(self.ts), kinds[self.ts]) if self.ts else F.lit(None)
        row = self.df.agg(
            F.count("*").alias("rows"),
            F.count_if(usable).alias("usable"),
            F.count_if(usable & moment.isNotNull()).alias("timed"),
        ).first()
        return row.asDict()

    @property
    def timed(self) -> bool:
        """Below 90 % readable timestamps the order itself is a guess, so nothing timed is measured."""
        return bool(self.ts and self.counts["usable"] and self.counts["timed"] / self.counts["usable"] >= MIN_PARSED)

    @cached_property
    def sequence(self) -> scale.Sequenced:
        return scale.Sequenced(self.events, [CASE], [AT, ROW])

    def refused(self) -> list[tuple]:
        rows, lost = [], self.counts["rows"] - self.counts["usable"]
        if lost:
            rows.append(("order_events", self.case, "events without case or activity were left out", lost, 0))
        if self.ts and self.counts["usable"] and not self.timed:
            share = self.counts["timed"] / self.counts["usable"]
            rows.append(("order_events", self.ts, "too few readable timestamps, nothing timed is measured", share, MIN_PARSED))
        return rows


def ordered_events(log: EventLog) -> DataFrame:
    """Events with their position inside the case."""
    return log.sequence.with_position("position").rows().drop(AT)


def volume(log: EventLog) -> DataFrame:
    return log.events.agg(
        F.countDistinct(CASE).alias("cases"),
        F.count("*").alias("events"),
        F.countDistinct(ACTIVITY).alias("activities"),
    ).withColumn("events_per_case", F.round(F.try_divide("events", "cases"), 4))


def activity_counts(log: EventLog) -> DataFrame:
    return log.events.groupBy(ACTIVITY).agg(F.count("*").alias("events"))


def slug_map(names: DataFrame, name: str = ACTIVITY) -> DataFrame:
    """Unique key fragments: names that flatten to the same fragment are numbered by name."""
    base = text.slug(F.col(name))
    at = F.row_number().over(Window.partitionBy("_base").orderBy(name))
    return (
        names.select(name).distinct().withColumn("_base", base).withColumn("_at", at)
        .select(name, F.when(F.col("_at") == 1, F.col("_base")).otherwise(F.concat_ws("_", "_base", F.col("_at").cast("string"))).alias("slug"))
    )


def case_traces(log: EventLog) -> DataFrame:
    """One row per case: ``case_id, events, variant, head``.

    ``variant`` is a 128-bit digest folded from (position, activity) of all events, so it needs neither the whole
    trace in one cell nor an order of arrival. ``head`` holds the first steps, at most ``HEAD_STEPS``.
    """
    placed = log.sequence.with_position("_pos").rows()
    folded = [F.hex(F.bit_xor(h)) for h in (F.xxhash64("_pos", ACTIVITY), F.xxhash64(ACTIVITY, "_pos"))]
    first = F.collect_list(F.when(F.col("_pos") <= HEAD_STEPS, F.struct("_pos", ACTIVITY)))
    return placed.groupBy(CASE).agg(
        F.count("*").alias("events"), F.concat_ws("-", *folded, F.count("*").cast("string")).alias("variant"),
        F.transform(F.array_sort(first), lambda e: e[ACTIVITY]).alias("head"),
    )


def variant_table(log: EventLog, traces: DataFrame | None = None) -> DataFrame:
    """``variant, cases, steps, head, example``: every path with its number of cases."""
    traces = case_traces(log) if traces is None else traces
    return traces.groupBy("variant").agg(
        F.count("*").alias("cases"), F.first("events").alias("steps"), F.first("head").alias("head"), F.min(CASE).alias("example")
    )


def top_variants(log: EventLog, table: DataFrame | None = None, limit: int = TOP_VARIANTS) -> DataFrame:
    """The most common paths, ties by the path itself: ``rank, head, cases, steps, share_pct, example``.

    First steps settle most ties. Where paths that may be among the first ``limit`` agree in them, the rest of
    their steps is put in order, whatever its length.
    """
    table = materialize(variant_table(log)) if table is None else table
    total = table.agg(F.sum("cases")).first()[0] or 0
    order = [F.desc("cases"), F.asc("head")]
    last = table.orderBy(*order).limit(limit).agg(F.min("cases"), F.max_by("head", F.struct(-F.col("cases"), F.col("head")))).first()
    near = table
    if last[0] is not None:
        near = table.filter((F.col("cases") > last[0]) | ((F.col("cases") == last[0]) & (F.col("head") <= F.lit(last[1]))))
    seen = near.agg(F.count("*").alias("n"), F.countDistinct("cases", "head").alias("different")).first()
    if seen["n"] > seen["different"]:
        near = near.join(paths.lexical_places(_later_steps(log, near), "variant", "_pos", ACTIVITY), "variant", "left")
        order.append(F.asc_nulls_first("place"))
    ranked = near.orderBy(*order).limit(limit)
    place = Window.orderBy(*order)  # at most ``limit`` rows
    return ranked.select(
        F.row_number().over(place).alias("rank"), "head", "cases", "steps",
        F.round(100.0 * F.col("cases") / F.lit(total), 4).alias("share_pct"), "example",
    )


def _later_steps(log: EventLog, variants: DataFrame) -> DataFrame:
    """``variant, _pos, activity`` of the steps behind ``head``, from the example case of each variant."""
    longer = variants.filter(F.col("steps") > HEAD_STEPS).select("variant", "example")
    later = log.sequence.with_position("_pos").rows().filter(F.col("_pos") > HEAD_STEPS)
    return later.join(longer, F.col(CASE) == F.col("example")).select("variant", "_pos", ACTIVITY)


def variant_paths(log: EventLog, best: DataFrame) -> DataFrame:
    """``rank, position, activity``: every step of the chosen paths, read from their example cases."""
    placed = log.sequence.with_position("position").rows()
    chosen = best.select("rank", "example")
    return placed.join(F.broadcast(chosen), F.col(CASE) == F.col("example")).select("rank", "position", ACTIVITY)  # as many rows as paths were asked for


def variant_signatures(log: EventLog) -> DataFrame:
    """``case_id, events, signature``: first 16 hex digits over the joined activity names.

    The signature is defined on one text of all names, so the names of a case must fit one cell (2 GB). ``case_traces`` has a
    digest without that bound.
    """
    placed = log.sequence.with_position("_pos").rows()
    names = F.transform(F.array_sort(F.collect_list(F.struct("_pos", ACTIVITY))), lambda e: e[ACTIVITY])
    return placed.groupBy(CASE).agg(F.count("*").alias("events"), F.substring(F.sha2(F.array_join(names, "|"), 256), 1, 16).alias("signature"))


def rework_by_activity(log: EventLog) -> DataFrame:
    """``activity, cases``: in how many cases each activity happened more than once."""
    repeats = log.events.groupBy(CASE, ACTIVITY).agg(F.count("*").alias("n")).filter("n > 1")
    return repeats.groupBy(ACTIVITY).agg(F.count("*").alias("cases"))


def rework_cases(log: EventLog) -> DataFrame:
    """One row: cases, cases with a repeated activity, cases with an immediate repeat."""
    repeated = log.events.groupBy(CASE, ACTIVITY).agg(F.count("*").alias("n"))
    per_case = repeated.groupBy(CASE).agg(F.max((F.col("n") > 1).cast("int")).alias("repeated"))
    loops = log.sequence.with_next({"_next": ACTIVITY}).rows()
    loop_cases = loops.filter(F.col("_next") == F.col(ACTIVITY)).select(CASE).distinct()
    a = per_case.agg(F.count("*").alias("cases"), F.coalesce(F.sum("repeated"), F.lit(0)).alias("repeated_cases"))
    b = loop_cases.agg(F.count("*").alias("self_loop_cases"))
    return side_by_side(a, b).select(
        "cases", "repeated_cases", "self_loop_cases",
        F.round(F.try_divide(100.0 * F.col("repeated_cases"), "cases"), 4).alias("repeated_pct"),
        F.round(F.try_divide(100.0 * F.col("self_loop_cases"), "cases"), 4).alias("self_loop_pct"),
    )


def case_durations(log: EventLog) -> DataFrame:
    hours = dates.hours_between(F.min(MOMENT), F.max(MOMENT))
    return log.events.groupBy(CASE).agg(hours.alias("hours")).filter("hours >= 0")


def durations(log: EventLog) -> DataFrame:
    """One row: median, mean, p95 and max hours from first to last event of a case."""
    spans = case_durations(log)
    shares = scale.percentiles(spans, [], "hours", {"median": 0.5, "p95": 0.95})
    rest = spans.agg(F.avg("hours").alias("mean"), F.max("hours").alias("max"))
    return side_by_side(shares, rest).select(
        *[F.round(c, 4).alias(f"{c}_hours") for c in ("median", "mean", "p95", "max")]
    )


def handovers(log: EventLog) -> DataFrame:
    """``case_id, activity, next_activity, wait_hours`` for every timed step."""
    wait = dates.hours_between(F.col(MOMENT), F.col("_next_moment"))
    steps = log.sequence.with_next({"next_activity": ACTIVITY, "_next_moment": MOMENT}).rows()
    steps = steps.withColumn("wait_hours", wait).filter("wait_hours >= 0")
    steps = steps.select(CASE, ACTIVITY, "next_activity", "wait_hours")
    # Large logs are read twice below (totals, then medians): store the steps once.
    return materialize(steps) if log.counts["usable"] > scale.group_limit(log.df) else steps


def transitions(log: EventLog, limit: int | None = TOP_TRANSITIONS, steps: DataFrame | None = None) -> DataFrame:
    """Handovers by total waiting hours: ``rank, activity, next_activity, observations, total_hours, median_hours``.

    The median is withheld below 10 observations.
    """
    steps = handovers(log) if steps is None else steps
    pair = [ACTIVITY, "next_activity"]
    order = [F.desc("_total"), F.asc(ACTIVITY), F.asc("next_activity")]
    totals = [F.count("*").alias("observations"), F.sum("wait_hours").alias("_total")]
    if log.counts["usable"] <= scale.group_limit(log.df):
        found = steps.groupBy(*pair).agg(*totals, F.percentile("wait_hours", F.lit(0.5)).alias("_median"))
        if limit:
            found = found.orderBy(*order).limit(limit)
    else:
        found = steps.groupBy(*pair).agg(*totals)
        if limit:
            found = found.orderBy(*order).limit(limit)
        wanted = found.filter(F.col("observations") >= MIN_MEDIAN).select(*pair)
        if limit:
            wanted = F.broadcast(wanted)  # at most ``limit`` rows
        medians = scale.percentiles(steps.join(wanted, pair, "left_semi"), pair, "wait_hours", {"_median": 0.5})
        found = found.join(medians, pair, "left")
    out = found.select(
        *pair, "observations", F.round("_total", 4).alias("total_hours"),
        F.when(F.col("observations") >= MIN_MEDIAN, F.round("_median", 4)).alias("median_hours"), "_total",
    )
    if limit:
        out = out.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # at most ``limit`` rows
        return out.select("rank", *pair, "observations", "total_hours", "median_hours")
    return out.drop("_total")


def mine_process(log: EventLog) -> Outcome:
    """All process metrics with the list of what was refused."""
    spark = log.df.sparkSession
    refused = log.refused()
    size = volume(log).first()
    one = spark.range(1)
    parts = [
        metric_rows(one, [
            metric("process.cases", F.lit(size["cases"]), measure="process", stat="cases", unit="case", source="volume"),
            metric("process.events", F.lit(size["events"]), measure="process", stat="events", unit="event", source="volume"),
            metric("process.events.per_case.mean", F.lit(size["events_per_case"]), measure="process.events", stat="mean", unit="event", source="volume"),
            metric("process.activities.distinct", F.lit(size["activities"]), measure="process.activities", stat="distinct", unit="activity", source="volume"),
        ])
    ]
    if size["cases"] < MIN_CASES:
        refused.append(("mine_process", log.case, "too few cases for variants, rework or waits", size["cases"], MIN_CASES))
        return Outcome(stacked(parts), refusals(spark, refused))
    cases = F.lit(size["cases"])
    table = materialize(variant_table(log))
    best = top_variants(log, table).cache()
    number = F.col("rank").cast("string")
    parts += [
        metric_rows(table.agg(F.count("*").alias("n")), [
            metric("process.variants", F.col("n"), measure="process", stat="variants", unit="variant", source="variant")]),
        metric_rows(best, [
            metric(F.concat(F.lit("process.variant."), number, F.lit(".cases")), F.col("cases"), measure="process.variant", grp=number, stat="cases", unit="case", source="variant"),
            metric(F.concat(F.lit("process.variant."), number, F.lit(".share_pct")), F.col("share_pct"), measure="process.variant", grp=number, stat="share_pct", unit="%", source="variant")]),
        metric_rows(best.agg((100.0 * F.sum("cases") / cases).alias("c")), [
            metric(f"process.variant_coverage.top{TOP_VARIANTS}_pct", F.col("c"), measure="process.variant_coverage", stat="pct", unit="%", source="variant")]),
    ]
    loops = rework_cases(log)
    parts.append(metric_rows(loops, [
        metric("process.rework.cases", F.col("repeated_cases"), measure="process.rework", stat="cases", unit="case", source="rework"),
        metric("process.rework.cases_pct", F.col("repeated_pct"), measure="process.rework", stat="cases_pct", unit="%", source="rework"),
        metric("process.selfloop.cases", F.col("self_loop_cases"), measure="process.selfloop", stat="cases", unit="case", source="rework"),
        metric("process.selfloop.cases_pct", F.col("self_loop_pct"), measure="process.selfloop", stat="cases_pct", unit="%", source="rework")]))
    busiest = activity_counts(log)
    slugs = slug_map(busiest)
    top = busiest.orderBy(F.desc("events"), F.asc(ACTIVITY)).limit(TOP_ACTIVITIES)
    parts.append(metric_rows(slugs.join(F.broadcast(top), ACTIVITY), [
        metric(F.concat(F.lit("process.activity."), "slug", F.lit(".events")), F.col("events"), measure="process.activity", grp=F.col(ACTIVITY), stat="events", unit="event", source="volume")]))
    repeats = rework_by_activity(log).orderBy(ACTIVITY).limit(TOP_ACTIVITIES)
    parts.append(metric_rows(slugs.join(F.broadcast(repeats), ACTIVITY), [
        metric(F.concat(F.lit("process.rework."), "slug", F.lit(".cases")), F.col("cases"), measure="process.rework", grp=F.col(ACTIVITY), stat="cases", unit="case", source="rework"),
        metric(F.concat(F.lit("process.rework."), "slug", F.lit(".cases_pct")), 100.0 * F.col("cases") / cases, measure="process.rework", grp=F.col(ACTIVITY), stat="cases_pct", unit="%", source="rework")]))
    if log.timed:
        parts.append(metric_rows(durations(log), [
            metric(f"process.duration.{s}_hours", F.col(f"{s}_hours"), measure="process.duration", stat=f"{s}_hours", unit="h", source="duration")
            for s in ("median", "mean", "p95", "max")]))
        waits = transitions(log).cache()
        step = F.concat(text.slug(F.col(ACTIVITY)), F.lit("__to__"), text.slug(F.col("next_activity")))
        parts.append(metric_rows(waits, [
            metric(F.concat(F.lit("process.wait."), step, F.lit(f".{s}")), F.col(s), measure="process.wait", grp=step, stat=s, unit=u, source="bottleneck")
            for s, u in (("total_hours", "h"), ("observations", "times"), ("median_hours", "h"))]))
        seen = waits.agg(F.count("*").alias("n"), F.count_if(F.col("observations") < MIN_MEDIAN).alias("thin")).first()
        if seen["thin"]:
            refused.append(("transitions", "median_hours", "handovers seen too rarely for a typical wait", seen["thin"], MIN_MEDIAN))
        if not seen["n"]:
            refused.append(("transitions", log.case, "no handover could be measured: every case has one event", 0, 1))
    if log.ts is None:
        refused.append(("mine_process", "timestamp", "no time column declared: the order is measured, waits are not", None, None))
    if log.resource is None:
        refused.append(("mine_process", "resource", "no resource column declared: duties are not checked", None, None))
    return Outcome(stacked(parts), refusals(spark, refused))


def keep_activities(log: EventLog, wanted: list[str]) -> tuple[DataFrame, DataFrame]:
    """Events of the chosen activities, and one row saying how many events and cases were lost."""
    chosen = F.col(log.activity).cast("string").isin(wanted)
    lost = (
        log.df.groupBy(log.case).agg(F.count_if(chosen).alias("kept"), F.count("*").alias("n"))
        .agg(
            F.coalesce(F.sum(F.col("n") - F.col("kept")), F.lit(0)).alias("dropped_events"),
            F.count_if(F.col("kept") == 0).alias("lost_cases"),
            F.coalesce(F.sum("kept"), F.lit(0)).alias("kept_events"),
        )
    )
    return log.df.filter(chosen), lost


def variant_edges(log: EventLog, limit: int = TOP_VARIANTS) -> DataFrame:
    """Directly-follows edges of the most common paths: ``source, target, first_rank, variants``.

    Edges come from one example case per path, so a path is never held in one cell.
    """
    best = top_variants(log, limit=limit).select("rank", "example")
    steps = log.sequence.with_next({"_next": ACTIVITY}).with_position("_pos").rows()
    kept = steps.join(F.broadcast(best), F.col(CASE) == F.col("example"))  # at most ``limit`` cases
    inner = kept.select("rank", F.col(ACTIVITY).alias("source"), F.coalesce("_next", F.lit("(end)")).alias("target"))
    first = kept.filter("_pos = 1").select("rank", F.lit("(start)").alias("source"), F.col(ACTIVITY).alias("target"))
    return inner.unionByName(first).groupBy("source", "target").agg(
        F.min("rank").alias("first_rank"), F.countDistinct("rank").alias("variants")
    )


def order_violations(log: EventLog, before: str, after: str) -> DataFrame:
    """Cases in which ``after`` happens although ``before`` never happened or came later.

    Only the first moments matter, so a case is reduced before the shuffle.
    """
    at = F.struct(AT, ROW)
    firsts = log.events.filter(F.col(ACTIVITY).isin(before, after)).groupBy(CASE).agg(
        F.min(F.when(F.col(ACTIVITY) == before, at)).alias("_b"), F.min(F.when(F.col(ACTIVITY) == after, at)).alias("_a")
    )
    return firsts.filter(F.col("_a").isNotNull() & (F.col("_b").isNull() | (F.col("_b") > F.col("_a")))).select(
        CASE, F.col(f"_a.{ROW}").alias(ROW), F.col("_b").isNull().alias("missing")
    )


def _rule_table(log: EventLog, tests: list[str]) -> DataFrame:
    """``rule, test``: one row for each declared rule."""
    return log.events.sparkSession.createDataFrame(list(enumerate(tests)), "rule int, test string")


def _rules(pairs: list[tuple[str, str]]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(pairs)])


def sequence_order(log: EventLog, pairs: list[tuple[str, str]]) -> DataFrame:
    """``test, violations, missing`` per (before, after) pair.

    One scan and one aggregation serve all rules: a case is reduced to the first moment of each named activity, and the rules are data.
    """
    if not pairs:
        return log.events.sparkSession.createDataFrame([], "test string, violations bigint, missing bigint")
    names = sorted({name for pair in pairs for name in pair})
    firsts = log.events.filter(F.col(ACTIVITY).isin(names)).groupBy(CASE, ACTIVITY).agg(F.min(F.struct(AT, ROW)).alias("_at"))
    cases = firsts.groupBy(CASE).agg(F.map_from_entries(F.collect_list(F.struct(ACTIVITY, "_at"))).alias("_m"))  # at most one entry for each name
    before = lambda r: F.try_element_at("_m", r["a"])
    after = lambda r: F.try_element_at("_m", r["b"])
    broken = F.filter(_rules(pairs), lambda r: after(r).isNotNull() & (before(r).isNull() | (before(r) > after(r))))
    hits = cases.select(F.explode(F.transform(broken, lambda r: F.struct(r["rule"].alias("rule"), before(r).isNull().alias("missing")))).alias("h")).select("h.*")
    counts = hits.groupBy("rule").agg(F.count("*").alias("violations"), F.count_if("missing").alias("missing"))
    table = _rule_table(log, [f"order:{b}__before__{a}" for b, a in pairs])
    zero = F.lit(0).cast("bigint")
    return table.join(F.broadcast(counts), "rule", "left").select("test", F.coalesce("violations", zero).alias("violations"), F.coalesce("missing", zero).alias("missing"))


def duty_violations(log: EventLog, first: str, second: str) -> DataFrame:
    """``case_id, resource, events`` where one resource did both activities of a pair."""
    acted = log.events.filter(F.col(ACTIVITY).isin(first, second) & F.col(RESOURCE).isNotNull())
    return (
        acted.groupBy(CASE, RESOURCE)
        .agg(
            F.count("*").alias("events"),
            F.count_if(F.col(ACTIVITY) == first).alias("_f"),
            F.count_if(F.col(ACTIVITY) == second).alias("_s"),
        )
        .filter("_f > 0 AND _s > 0")
        .drop("_f", "_s")
    )


def segregation_of_duties(log: EventLog, pairs: list[tuple[str, str]]) -> DataFrame:
    """``test, events, culprits`` per pair; culprits are the first three names. One scan and one aggregation serve all rules."""
    if not pairs:
        return log.events.sparkSession.createDataFrame([], "test string, events bigint, culprits string")
    names = sorted({name for pair in pairs for name in pair})
    acted = log.events.filter(F.col(ACTIVITY).isin(names) & F.col(RESOURCE).isNotNull()).groupBy(CASE, RESOURCE, ACTIVITY).agg(F.count("*").alias("_n"))
    actors = acted.groupBy(CASE, RESOURCE).agg(F.map_from_entries(F.collect_list(F.struct(ACTIVITY, "_n"))).alias("_m"))  # at most one entry for each name
    did = lambda name: F.coalesce(F.try_element_at("_m", name), F.lit(0))
    broken = F.filter(_rules(pairs), lambda r: (did(r["a"]) > 0) & (did(r["b"]) > 0))
    events = lambda r: did(r["a"]) + F.when(r["a"] != r["b"], did(r["b"])).otherwise(0)
    hits = actors.select(RESOURCE, F.explode(F.transform(broken, lambda r: F.struct(r["rule"].alias("rule"), events(r).alias("events")))).alias("h")).select(RESOURCE, "h.*")
    hits = hits.groupBy("rule", RESOURCE).agg(F.sum("events").alias("events"))
    first = Window.partitionBy("rule").orderBy(RESOURCE)
    named = hits.withColumn("_r", F.row_number().over(first)).filter("_r <= 3").groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list(RESOURCE)), ", ").alias("culprits"))
    totals = hits.groupBy("rule").agg(F.sum("events").alias("events")).join(named, "rule")
    table = _rule_table(log, [f"sod:{a}__vs__{b}" for a, b in pairs])
    found = table.join(F.broadcast(totals), "rule", "left")  # one row for each rule on both sides
    return found.select("test", F.coalesce("events", F.lit(0).cast("bigint")).alias("events"), F.coalesce("culprits", F.lit("")).alias("culprits"))
