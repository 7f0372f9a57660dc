"""Correlation, group comparison and linear regression with minimum-sample rules."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom import scale
from metricloom.functions import numbers, tails
from metricloom.operators.common import Outcome, metric, metric_rows, refusals, stacked
from metricloom.operators.profile import _as_text, _quoted, _types, measurable_and_grouping
from metricloom.session import materialize

MIN_SAMPLE = 8
MIN_GROUP = 5
MAX_GROUPS = 20
MIN_PER_PREDICTOR = 10
MAX_VIF = 10.0
MAX_SUGGESTED = 8
#: A value that more than one row in so many holds is frequent: its rank needs no join.
FREQUENT = 100


@dataclass(frozen=True)
class Spec:
    """Declared tests. Nothing is run that is not named here."""

    correlations: tuple[tuple[str, str], ...] = ()
    group_differences: tuple[tuple[str, str], ...] = ()
    regressions: tuple[tuple[str, tuple[str, ...]], ...] = field(default=())


def _doubles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    kinds = _types(df)
    return df.select(*[numbers.numeric(_quoted(c), kinds[c]).alias(f"x{i}") for i, c in enumerate(columns)])


def _pair_sums(df: DataFrame, width: int, centre: list[float]) -> DataFrame:
    """Sums over pairwise-complete rows for all column pairs, one pass, one small block per task."""
    iu = np.triu_indices(width, 1)
    shift = np.asarray(centre)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, len(iu[0])))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            seen = np.isfinite(x)
            z = np.where(seen, x - shift, 0.0)
            m = seen.astype(float)
            sq = z * z
            parts = (m.T @ m, z.T @ m, m.T @ z, sq.T @ m, m.T @ sq, z.T @ z)
            total += np.stack([p[iu] for p in parts])
        yield pa.RecordBatch.from_arrays(
            [pa.array(iu[0], pa.int32()), pa.array(iu[1], pa.int32()), *[pa.array(t) for t in total]],
            names=["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"],
        )

    schema = "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"
    return df.mapInArrow(sums, schema)


def pair_correlations(df: DataFrame, columns: Sequence[str], wanted: Sequence[str] = ()) -> DataFrame:
    """``left, right, n, r`` of all pairs over rows in which both are finite numbers, strongest first after those about ``wanted`` columns: ``rank`` gives the order."""
    columns = list(columns)
    data = _doubles(df, columns)
    finite = [F.when(F.abs(c) < float("inf"), F.col(c)) for c in data.columns]
    centre = [v or 0.0 for v in data.agg(*[F.avg(c) for c in finite]).first()]
    s = _pair_sums(data, len(columns), centre).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    found = s.select("i", "j", F.col("n").cast("bigint").alias("n"), _correlation(s).alias("r"))
    names = F.array(*[F.lit(c) for c in columns])
    left, right = F.element_at(names, F.col("i") + 1), F.element_at(names, F.col("j") + 1)
    asked = left.isin(list(wanted)).cast("int") + right.isin(list(wanted)).cast("int")
    r = F.when(F.isnan("r"), None).otherwise(F.col("r"))
    # One row per pair of columns: bounded by the table's width.
    return found.select(
        left.alias("left"), right.alias("right"), "n", r.alias("r"), asked.alias("_asked"), (F.col("j") - F.col("i")).alias("_step"), F.col("i").alias("_i")
    )


def strongest_pairs(df: DataFrame, columns: Sequence[str], wanted: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Pairs ranked by |r|, those about ``wanted`` columns first; ties by distance of the columns."""
    order = [F.desc("_asked"), F.desc(F.coalesce(F.abs("r"), F.lit(0.0))), "_step", "_i"]
    ranked = pair_correlations(df, columns, wanted).orderBy(*order)
    if limit:
        ranked = ranked.limit(limit)
    return ranked.select("left", "right", "n", F.round("r", 4).alias("r"))


def _correlation(sums: DataFrame) -> Column:
    cov = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), "n")
    var = (F.col("sxx") - F.try_divide(F.col("sx") ** 2, "n")) * (F.col("syy") - F.try_divide(F.col("sy") ** 2, "n"))
    return F.when((F.col("n") > 1) & (var > 0), cov / F.sqrt(var))


def rank_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``left, right, n, rho``: Spearman's rho of each pair over its complete rows, ties at their average rank.

    All columns are ranked together as long rows, the ranks come back as one row of a matrix, and all pairs are sums over that matrix,
    so the number of jobs does not depend on the number of pairs. A column is ranked once, and once more for each partner with
    missing cells, because the ranks then are those among the rows that the partner has. Ranks come from value counts; those of frequent
    values travel as a small map, so no value's rows meet in one task.
    """
    columns = sorted({c for pair in pairs for c in pair})
    at = {c: i for i, c in enumerate(columns)}
    data = materialize(_doubles(df, columns).withColumn("row", F.monotonically_increasing_id()))
    seen = data.agg(F.count("*").alias("all"), *[F.count(f"x{i}").alias(f"n{i}") for i in range(len(columns))]).first()
    full = [seen[f"n{i}"] == seen["all"] for i in range(len(columns))]
    ranked: dict[tuple[int, int | None], int] = {}
    places = []
    for left, right in pairs:
        i, j = at[left], at[right]
        places.append(tuple(ranked.setdefault((a, None if full[b] else b), len(ranked)) for a, b in ((i, j), (j, i))))
    cells = [
        F.when(F.col(f"x{i}").isNotNull() & (F.lit(True) if j is None else F.col(f"x{j}").isNotNull()), F.struct(F.lit(e).alias("e"), F.col(f"x{i}").alias("x")))
        for (i, j), e in ranked.items()
    ]
    long = data.select("row", F.explode(F.array_compact(F.array(*cells))).alias("c")).select("row", "c.e", "c.x")
    ranks = materialize(scale.average_ranks(long, ["e"], "x", "r", keep="n"))
    hot = [(r["e"], r["x"], r["r"]) for r in ranks.filter(F.col("n") * FREQUENT > seen["all"]).collect()]  # fewer than FREQUENT for each ranking
    known = F.map_from_arrays(F.array(*[F.struct(F.lit(e).alias("e"), F.lit(x).alias("x")) for e, x, _ in hot]), F.array(*[F.lit(r) for *_, r in hot])) if hot else None
    own = F.try_element_at(known, F.struct("e", "x")) if hot else F.lit(None).cast("double")
    long = long.withColumn("r", own)
    rest = long.filter("r IS NULL").drop("r").join(ranks.drop("n"), ["e", "x"])
    matrix = long.filter("r IS NOT NULL").select("row", "e", "r").unionByName(rest.select("row", "e", "r"))
    matrix = matrix.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("e", "r"))).alias("m"))  # one entry for each ranking
    counts = {r["e"]: r["n"] for r in ranks.groupBy("e").agg(F.sum("n").alias("n")).collect()}  # one row for each ranking
    centre = [(counts.get(e, 0) + 1) / 2 for e in range(len(ranked))]
    wide = matrix.select(*[F.try_element_at("m", F.lit(e)).alias(f"r{e}") for e in range(len(ranked))])
    sums = _pair_sums(wide, len(ranked), centre).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    wanted = df.sparkSession.createDataFrame([(*pair, min(p), max(p)) for pair, p in zip(pairs, places)], "left string, right string, i int, j int")
    both = wanted.join(sums, ["i", "j"], "left")
    return both.select("left", "right", F.coalesce("n", F.lit(0.0)).cast("bigint").alias("n"), _correlation(sums).alias("rho"))


def rank_correlation(df: DataFrame, left: str, right: str) -> DataFrame:
    """Spearman's rho of one pair over complete rows: ``n, rho``."""
    return rank_correlations(df, [(left, right)]).select("n", "rho")


def correlate(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> Outcome:
    """Pearson r with its p-value, Spearman's rho, n and shared variance of each declared pair."""
    spark = df.sparkSession
    columns = sorted({c for pair in pairs for c in pair if c in df.columns})
    data = _doubles(df, columns)
    at = {c: f"x{i}" for i, c in enumerate(columns)}
    usable = [(a, b) for a, b in pairs if a in at and b in at]
    refused = [("correlate", f"{a} ~ {b}", "not both columns exist", None, None) for a, b in pairs if (a, b) not in usable]
    aggs = []
    for k, (a, b) in enumerate(usable):
        x, y = F.col(at[a]), F.col(at[b])
        both = x.isNotNull() & y.isNotNull()
        aggs += [
            F.count_if(both).alias(f"n{k}"), F.corr(x, y).alias(f"r{k}"), F.count(x).alias(f"a{k}"), F.count(y).alias(f"b{k}"),
            ((F.min(F.when(both, x)) < F.max(F.when(both, x))) & (F.min(F.when(both, y)) < F.max(F.when(both, y)))).alias(f"v{k}"),
        ]
    seen = data.agg(*aggs).first() if aggs else None  # one row whatever the table's size
    good = []
    for k, (a, b) in enumerate(usable):
        label, n, r = f"{a} ~ {b}", seen[f"n{k}"], seen[f"r{k}"]
        if not seen[f"a{k}"] or not seen[f"b{k}"]:
            refused.append(("correlate", label, "not both columns are numbers", 0, 1))
        elif n < MIN_SAMPLE:
            refused.append(("correlate", label, "too few complete pairs", n, MIN_SAMPLE))
        elif not seen[f"v{k}"]:
            refused.append(("correlate", label, "one column does not vary", 1, 2))
        else:
            t = float("inf") if abs(r) >= 1 else r * ((n - 2) / (1 - r * r)) ** 0.5
            good.append((a, b, n, r, tails.t_two_sided(t, n - 2)))
    if not good:
        return Outcome(metric_rows(spark.range(0), [metric("", F.lit(0.0))]), refusals(spark, refused))
    rho = rank_correlations(df, list(dict.fromkeys((a, b) for a, b, *_ in good))).select("left", "right", "rho")
    tests = spark.createDataFrame(good, "left string, right string, pairs bigint, r double, p double").join(F.broadcast(rho), ["left", "right"])  # one row per pair
    a, b = F.col("left"), F.col("right")
    key, source = F.concat(a, F.lit(".corr.with."), b), F.concat(a, F.lit(" and "), b)
    return Outcome(metric_rows(tests, [
        metric(key, F.col("r"), measure=a, stat="corr", dim=b, source=source),
        metric(F.concat(key, F.lit(".p_value")), F.col("p"), measure=a, stat="corr.p_value", dim=b, source=source),
        metric(F.concat(a, F.lit(".rank_corr.with."), b), F.col("rho"), measure=a, stat="rank_corr", dim=b, source=source),
        metric(F.concat(key, F.lit(".n")), F.col("pairs"), measure=a, stat="corr.n", dim=b, unit="pair", source=source),
        metric(F.concat(a, F.lit(".r2.with."), b), F.col("r") * F.col("r") * 100.0, measure=a, stat="r2", dim=b, unit="%", source=source),
    ]), refusals(spark, refused))


def group_stats(df: DataFrame, measures: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """``measure, dim, grp, n, mean, var, lo, hi`` of every measure in every group, in one pass.

    Rows without a group are left out, as in the category metrics.
    """
    measures, groups = list(measures), list(groups)
    kinds = _types(df)
    keys = F.array(*[F.struct(F.lit(g).alias("dim"), _as_text(df, g).alias("grp")) for g in groups])
    spread = df.select(F.explode(keys).alias("g"), *[numbers.numeric(_quoted(m), kinds[m]).alias(f"m{i}") for i, m in enumerate(measures)])
    aggs = [
        a for i in range(len(measures))
        for a in (F.count(f"m{i}").alias(f"n{i}"), F.avg(f"m{i}").alias(f"a{i}"), F.var_samp(f"m{i}").alias(f"v{i}"), F.min(f"m{i}").alias(f"l{i}"), F.max(f"m{i}").alias(f"h{i}"))
    ]
    grouped = spread.filter("g.grp IS NOT NULL").groupBy("g.dim", "g.grp").agg(*aggs)
    rows = [
        F.struct(F.lit(m).alias("measure"), *[F.col(f"{c}{i}").alias(name) for c, name in (("n", "n"), ("a", "mean"), ("v", "var"), ("l", "lo"), ("h", "hi"))])
        for i, m in enumerate(measures)
    ]
    return grouped.select("dim", "grp", F.explode(F.array(*rows)).alias("r")).select("r.measure", "dim", "grp", "r.n", "r.mean", "r.var", "r.lo", "r.hi").filter("n > 0")


def separation(stats: DataFrame) -> DataFrame:
    """Share of a measure's variation that lies between groups: ``measure, dim, rows, eta_sq``."""
    totals = stats.groupBy("measure", "dim").agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("mean")).alias("_s"))
    joined = stats.join(totals, ["measure", "dim"])
    off = F.col("n") * (F.col("mean") - F.col("_s") / F.col("rows")) ** 2
    within = (F.col("n") - 1) * F.coalesce("var", F.lit(0.0))
    return (
        joined.groupBy("measure", "dim").agg(F.max("rows").alias("rows"), F.sum(off).alias("_b"), F.sum(within + off).alias("_t"))
        .select("measure", "dim", "rows", F.when((F.col("rows") >= 3) & (F.col("_t") > 0), F.col("_b") / F.col("_t")).otherwise(0.0).alias("eta_sq"))
    )


def compare_groups(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> Outcome:
    """Welch's t-test (two groups) or one-way ANOVA (more) for each declared (measure, group)."""
    spark = df.sparkSession
    refused, usable = [], []
    for m, g in pairs:
        if m in df.columns and g in df.columns:
            usable.append((m, g))
        else:
            refused.append(("compare_groups", f"{m} by {g}", "a column does not exist", None, None))
    empty = metric_rows(spark.range(0), [metric("", F.lit(0.0))])
    if not usable:
        return Outcome(empty, refusals(spark, refused))
    asked = F.concat_ws("|", "measure", "dim").isin([f"{m}|{g}" for m, g in usable])
    stats = group_stats(df, sorted({m for m, _ in usable}), sorted({g for _, g in usable})).filter(asked).cache()
    big = F.col("n") >= MIN_GROUP
    shape = {
        (r["measure"], r["dim"]): r
        for r in stats.groupBy("measure", "dim").agg(
            F.count_if(big).alias("kept"), F.count_if(~big).alias("small"), F.count_if(big & (F.col("lo") == F.col("hi"))).alias("flat")
        ).collect()  # one row per declared pair
    }
    good: dict[int, list] = {2: [], 3: []}
    for m, g in usable:
        label, row = f"{m} by {g}", shape.get((m, g))
        if row is None:
            refused.append(("compare_groups", label, "the measure has no numbers", 0, 1))
            continue
        if row["small"]:
            refused.append(("compare_groups", label, "groups with too few rows were left out", row["small"], 0))
        if row["kept"] < 2:
            refused.append(("compare_groups", label, "fewer than two groups are large enough", row["kept"], 2))
        elif row["kept"] > MAX_GROUPS:
            refused.append(("compare_groups", label, "too many groups: this is an identifier", row["kept"], MAX_GROUPS))
        elif row["flat"]:
            refused.append(("compare_groups", label, "a group does not vary", row["flat"], 0))
        else:
            good[2 if row["kept"] == 2 else 3].append(f"{m}|{g}")
    kept = stats.filter(big & F.concat_ws("|", "measure", "dim").isin(good[2] + good[3]))  # at most 20 groups per pair
    m, g = F.col("measure"), F.col("dim")

    def named(stat: str, value, unit: str = ""):
        return metric(F.concat(m, F.lit(f".{stat}"), g) if stat.endswith(".by.") else F.concat(m, F.lit("." + stat.split("|")[0]), g, F.lit(stat.split("|")[1])),
                      value, measure=m, stat=stat.replace(".by.", "").replace("|", ""), dim=g, unit=unit, source=F.concat_ws(" by ", m, g))

    two = (
        kept.filter(F.concat_ws("|", m, g).isin(good[2])).groupBy(m, g)
        .agg(F.array_sort(F.collect_list(F.struct("grp", "n", "mean", "var"))).alias("s"))
        .select(m, g, *[F.col("s")[i][c].alias(f"{c}{i}") for i in (0, 1) for c in ("n", "mean", "var")])
    )
    se0, se1 = F.col("var0") / F.col("n0"), F.col("var1") / F.col("n1")
    diff = F.col("mean0") - F.col("mean1")
    freedom = (se0 + se1) ** 2 / (se0**2 / (F.col("n0") - 1) + se1**2 / (F.col("n1") - 1))
    pooled = F.sqrt(((F.col("n0") - 1) * F.col("var0") + (F.col("n1") - 1) * F.col("var1")) / (F.col("n0") + F.col("n1") - 2))
    two = two.withColumns({"t": diff / F.sqrt(se0 + se1), "freedom": freedom}).withColumn("p", tails.t_p_value("t", "freedom"))
    two_rows = metric_rows(two, [
        named("ttest.by.|.p_value", F.col("p")), named("ttest.by.|.t_stat", F.col("t")), named("diff.by.", diff),
        named("ttest.by.|.n", F.col("n0") + F.col("n1"), "row"), named("effect_size.by.", F.when(pooled > 0, diff / pooled)),
    ])
    many = kept.filter(F.concat_ws("|", m, g).isin(good[3]))
    grand = many.groupBy(m, g).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    off = F.col("n") * (F.col("mean") - F.col("grand")) ** 2
    many = many.join(F.broadcast(grand), ["measure", "dim"]).groupBy(m, g).agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(off).alias("between"), F.sum((F.col("n") - 1) * F.col("var")).alias("within")
    )
    many = many.withColumns({"d1": (F.col("k") - 1).cast("double"), "d2": (F.col("n") - F.col("k")).cast("double")})
    many = many.withColumn("f", (F.col("between") / F.col("d1")) / (F.col("within") / F.col("d2"))).withColumn("p", tails.f_p_value("f", "d1", "d2"))
    many_rows = metric_rows(many, [
        named("anova.by.|.p_value", F.col("p")), named("anova.by.|.f_stat", F.col("f")), named("anova.by.|.groups", F.col("k"), "group"),
        named("eta_sq.by.", F.when(F.col("between") + F.col("within") > 0, 100.0 * F.col("between") / (F.col("between") + F.col("within"))), "%"),
    ])
    means = metric_rows(kept, [
        metric(F.concat(m, F.lit(".mean.by."), g, F.lit("."), F.col("grp")), F.col("mean"), measure=m, stat="mean", dim=g, grp=F.col("grp"), source=F.concat_ws(" by ", m, g))
    ])
    return Outcome(stacked([two_rows, many_rows, means]), refusals(spark, refused))


def _moments(data: DataFrame, width: int) -> dict:
    """Complete-row count, means and centred cross products, from one aggregation."""
    cols = [f"x{i}" for i in range(width)]
    aggs = [F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in cols], *[F.min(c).alias(f"l{c}") for c in cols], *[F.max(c).alias(f"h{c}") for c in cols]]
    aggs += [F.covar_pop(a, b).alias(f"c_{a}_{b}") for i, a in enumerate(cols) for b in cols[i:]]
    row = data.agg(*aggs).first()
    cross = np.zeros((width, width))
    if row["n"]:
        for i, a in enumerate(cols):
            for j, b in enumerate(cols[i:], start=i):
                cross[i, j] = cross[j, i] = row[f"c_{a}_{b}"] * row["n"]
    return {
        "n": row["n"], "means": np.array([row[f"m{c}"] or 0.0 for c in cols]), "cross": cross,
        "flat": [row[f"l{c}"] == row[f"h{c}"] for c in cols],
    }


def regress(df: DataFrame, outcome: str, predictors: Sequence[str]) -> Outcome:
    """Least squares with intercept. The table is scanned once; what is solved on the
    driver is a matrix as wide as the number of predictors."""
    spark = df.sparkSession
    predictors = list(predictors)
    label = f"{outcome} ~ {' + '.join(predictors)}"
    empty = metric_rows(spark.range(0), [metric("", F.lit(0.0))])

    def refuse(reason: str, seen=None, need=None) -> Outcome:
        return Outcome(empty, refusals(spark, [("regress", label, reason, seen, need)]))

    missing = [c for c in (outcome, *predictors) if c not in df.columns]
    if missing:
        return refuse(f"no column {missing}")
    k = len(predictors)
    data = _doubles(df, [*predictors, outcome]).dropna()
    m = _moments(data, k + 1)
    n = m["n"]
    if n < MIN_PER_PREDICTOR * k:
        return refuse("too few rows per predictor", n, MIN_PER_PREDICTOR * k)
    if any(m["flat"][:k]):
        return refuse(f"predictors that do not vary: {[p for p, f in zip(predictors, m['flat']) if f]}", 1, 2)
    sxx, sxy, syy = m["cross"][:k, :k], m["cross"][:k, k], m["cross"][k, k]
    scale_of = np.sqrt(np.diag(sxx))
    corr = sxx / np.outer(scale_of, scale_of)
    freedom = n - k - 1
    if freedom <= 0 or np.linalg.matrix_rank(corr, tol=1e-10) < k:
        return refuse("predictors repeat each other exactly, there is no single solution", None, None)
    inverse = np.linalg.inv(sxx)
    slopes = inverse @ sxy
    intercept = m["means"][k] - slopes @ m["means"][:k]
    residual = max(syy - slopes @ sxy, 0.0)
    errors = np.sqrt(np.abs(np.diag(inverse)) * residual / freedom)
    source = f"regression {label}"
    rows: list[tuple] = [(f"{outcome}.intercept", "intercept", None, intercept, "")]
    for name, slope, error in zip(predictors, slopes, errors):
        rows.append((f"{outcome}.coef.{name}", "coef", name, slope, ""))
        if error > 0:
            rows.append((f"{outcome}.coef.{name}.p_value", "coef.p_value", name, tails.t_two_sided(slope / error, freedom), ""))
    if syy > 0:
        r2 = 1.0 - residual / syy
        rows.append((f"{outcome}.regression.r2", "regression.r2", None, 100.0 * r2, "%"))
        rows.append((f"{outcome}.regression.r2_adj", "regression.r2_adj", None, 100.0 * (1 - (1 - r2) * (n - 1) / max(freedom, 1)), "%"))
    rows.append((f"{outcome}.regression.n", "regression.n", None, n, "row"))
    rows.append((f"{outcome}.regression.predictors", "regression.predictors", None, k, "predictor"))
    refused = []
    if k > 1:
        for name, inflation in zip(predictors, np.diag(np.linalg.inv(corr))):
            rows.append((f"{outcome}.vif.{name}", "vif", name, inflation, ""))
            if inflation > MAX_VIF:
                refused.append(("regress", f"{label}: {name}", "warning: its coefficient cannot be read on its own", inflation, MAX_VIF))
    table = spark.createDataFrame(
        [(key, outcome, stat, dim, float(v), unit) for key, stat, dim, v, unit in rows], "key string, measure string, stat string, dim string, v double, unit string"
    )
    shaped = table.select("key", "measure", "stat", "dim", F.lit(None).cast("string").alias("grp"), F.round("v", 4).alias("value"), "unit", F.lit(source).alias("source"))
    return Outcome(shaped, refusals(spark, refused))


def suggest_spec(
    df: DataFrame, *, dimensions: Sequence[str] = (), measures: Sequence[str] = (), wanted: Sequence[str] = ()
) -> tuple[Spec, list[str]]:
    """Tests worth running: the strongest correlations and best separating groups, 8 each. Never a regression."""
    kinds = {r["column"]: r for r in measurable_and_grouping(df).orderBy("column").collect()}  # one row per column
    numeric = sorted(c for c, r in kinds.items() if r["is_measure"] and (not measures or c in measures))
    grouping = sorted(c for c, r in kinds.items() if r["is_group"] and (not dimensions or c in dimensions))
    notes = []
    correlations: list[tuple[str, str]] = []
    if len(numeric) > 1:
        found = strongest_pairs(df, numeric, wanted, MAX_SUGGESTED).collect()
        correlations = [(r["left"], r["right"]) for r in found]
        total = len(numeric) * (len(numeric) - 1) // 2
        if total > MAX_SUGGESTED:
            notes.append(f"{total} pairs could be correlated, the {MAX_SUGGESTED} strongest were chosen, so their p-values are optimistic")
    differences: list[tuple[str, str]] = []
    if numeric and grouping:
        ranked = separation(group_stats(df, numeric, grouping)).filter("measure <> dim")
        asked = F.col("measure").isin(list(wanted)).cast("int") + F.col("dim").isin(list(wanted)).cast("int")
        order = [F.desc(asked), F.desc("eta_sq"), "measure", "dim"]
        differences = [(r["measure"], r["dim"]) for r in ranked.orderBy(*order).limit(MAX_SUGGESTED).collect()]
        if len(numeric) * len(grouping) > MAX_SUGGESTED:
            notes.append(f"only the {MAX_SUGGESTED} best separating (measure, group) pairs were chosen, so their p-values are optimistic")
    notes.append(f"chosen from the data: {len(correlations)} correlations, {len(differences)} group comparisons; regressions must be declared")
    return Spec(tuple(correlations), tuple(differences)), notes


def compute_statistics(df: DataFrame, spec: Spec) -> Outcome:
    """Run every declared test and return all metrics and all refusals."""
    outcomes = []
    if spec.correlations:
        outcomes.append(correlate(df, spec.correlations))
    if spec.group_differences:
        outcomes.append(compare_groups(df, spec.group_differences))
    outcomes += [regress(df, outcome, predictors) for outcome, predictors in spec.regressions]
    if not outcomes:
        return Outcome(metric_rows(df.sparkSession.range(0), [metric("", F.lit(0.0))]), refusals(df.sparkSession, []))
    return Outcome(stacked([o.metrics for o in outcomes]), stacked([o.refused for o in outcomes]))
