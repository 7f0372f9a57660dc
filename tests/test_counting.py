"""Counting on hashes, quantile brackets, rank matrices, interval joins and versioned tables against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.operators import counting, intervals, process, profile, stats
from metricloom.sources import sinks


@pytest.fixture(scope="module")
def cells(spark):
    rng = random.Random(2)
    rows = []
    for k in range(4000):
        word = rng.choice(["é", "b", "aa", "B", ""]) if k % 9 else None
        rows.append((k, f"id {k * 7919 % 4000:05d}", word, rng.choice([0.0, -0.0, 1.5, float("nan")]), f"{rng.randrange(900)}", None))
    schema = "k int, name string, word string, x double, code string, nothing string"
    return spark.createDataFrame(rows, schema).repartition(5), rows


@pytest.mark.parametrize("short", (True, False))
def test_top_values(spark, cells, request, short):
    if not short:
        request.getfixturevalue("tiny_groups")
    df, rows = cells
    found = {}
    for r in profile.top_values(df, ["k", "name", "word", "code", "nothing"]).collect():
        found.setdefault(r["column"], []).append((r["rank"], r["value"], r["n"]))
    for at, name in ((0, "k"), (1, "name"), (2, "word"), (4, "code")):
        counts = Counter(str(r[at]) for r in rows if r[at] is not None)
        want = sorted(counts.items(), key=lambda e: (-e[1], e[0].encode()))[:5]
        assert sorted(found[name]) == [(i, v, n) for i, (v, n) in enumerate(want, start=1)]
    assert "nothing" not in found


def test_first_of_many_ties_behind_common_values(spark, tiny_groups):
    """Half of the values occur once, but the first texts in order occur three times."""
    rows = [(f"a{k:04d}",) for k in range(300) for _ in range(3)] + [("top",)] * 9 + [(f"b{k:05d}",) for k in range(3000)]
    few = [(f"a{k:04d}",) for k in range(3) for _ in range(3)] + [(f"c{k:05d}",) for k in range(3000)]
    assert [tuple(r)[1:] for r in profile.top_values(spark.createDataFrame(rows, "v string")).orderBy("rank").collect()] == [(1, "top", 9), *[(i + 2, f"a{i:04d}", 3) for i in range(4)]]
    assert [tuple(r)[1:] for r in profile.top_values(spark.createDataFrame(few, "v string")).orderBy("rank").collect()] == [(i + 1, f"a{i:04d}", 3) for i in range(3)] + [(4, "c00000", 1), (5, "c00001", 1)]


def test_shape_counts_distinct_values(cells):
    df, rows = cells
    found = {r["column"]: r for r in profile.column_shape(df).collect()}
    assert (found["x"]["distinct"], found["x"]["non_null"]) == (2, sum(r[3] == r[3] for r in rows))
    assert (found["name"]["distinct"], found["name"]["min_text"], found["name"]["max_text"]) == (4000, "id 00000", "id 03999")
    assert (found["nothing"]["distinct"], found["nothing"]["null_pct"], found["word"]["distinct"]) == (0, 100.0, 5)
    assert (found["code"]["numeric_share"], found["code"]["min_number"]) == (1.0, 0.0)


@pytest.mark.parametrize("n", (1, 2, 7, 5000, 60000))
def test_quantiles_are_exact(spark, n):
    rng = np.random.default_rng(n)
    columns = {"a": rng.standard_normal(n), "b": rng.integers(0, 3, n).astype(float), "c": np.exp(rng.standard_normal(n) * 5), "d": np.where(rng.random(n) < 0.4, 7.0, rng.random(n))}
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*columns.values())], "a double, b double, c double, d double").repartition(6)
    shares = {"least": 0.0, "q1": 0.25, "mid": 0.5, "q3": 0.75, "p99": 0.99, "most": 1.0}
    found = {r["column"]: r for r in counting.quantiles(df, list("abcd"), shares).collect()}
    for name, x in columns.items():
        assert found[name]["n"] == n
        for s, share in shares.items():
            assert found[name][s] == pytest.approx(np.quantile(x, share), rel=1e-12, abs=1e-300)


def test_rank_matrix_of_incomplete_columns(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 12, (600, 4)).astype(float)
    x[:, 1] += x[:, 0]
    x[rng.random((600, 4)) < 0.2] = np.nan
    x[:, 3] = rng.permutation(600)  # complete, no ties
    df = spark.createDataFrame([tuple(None if v != v else float(v) for v in r) for r in x], "a double, b double, c double, d double").repartition(4)
    pairs = [(p, q) for i, p in enumerate("abcd") for q in "abcd"[i + 1 :]] + [("b", "a")]
    found = {(r["left"], r["right"]): r for r in stats.rank_correlations(df, pairs).collect()}
    assert len(found) == len(pairs)

    def ranks(v):
        return np.array([(v < e).sum() + ((v == e).sum() + 1) / 2 for e in v])

    for p, q in pairs:
        a, b = x[:, "abcd".index(p)], x[:, "abcd".index(q)]
        both = ~np.isnan(a) & ~np.isnan(b)
        assert found[p, q]["n"] == both.sum()
        assert found[p, q]["rho"] == pytest.approx(np.corrcoef(ranks(a[both]), ranks(b[both]))[0, 1], abs=1e-12)


@pytest.mark.parametrize("closed", (False, True))
@pytest.mark.parametrize("broadcast", (True, False))
def test_interval_join(spark, monkeypatch, closed, broadcast):
    if not broadcast:
        monkeypatch.setattr(intervals, "BROADCAST_ROWS", 3)
    rng = random.Random(closed)
    values = [(k, rng.choice([rng.uniform(-50, 50), rng.randint(-3, 3) * 1.0, 7.0])) for k in range(400)] + [(900, None), (901, float("nan")), (902, 1e12), (903, -0.0)]
    bands = []
    for k in range(120):
        lo = rng.choice([rng.uniform(-60, 60), float(rng.randint(-3, 3))])
        bands.append((k, lo, lo + rng.choice([0.0, 1e-9, 0.5, 3.0, 40.0, 1e6])))
    bands += [(500, float("-inf"), 0.0), (501, 7.0, float("inf")), (502, None, 3.0), (503, 5.0, 1.0), (504, float("nan"), 3.0), (505, 7.0, 7.0)]
    df = spark.createDataFrame(values, "id int, v double").repartition(3)
    found = intervals.interval_join(df, spark.createDataFrame(bands, "band int, lo double, hi double"), "v", "lo", "hi", closed=closed, bin_rows=20)
    assert found.columns == ["id", "v", "band", "lo", "hi"]
    ok = lambda v, lo, hi: lo <= v and (v <= hi if closed else v < hi)
    want = Counter((i, b) for i, v in values if v is not None for b, lo, hi in bands if lo is not None and ok(v, lo, hi))
    assert Counter((r["id"], r["band"]) for r in found.collect()) == want
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()


def test_interval_join_of_times_and_empty_tables(spark):
    days = spark.sql("SELECT DATE'2024-01-01' + CAST(id AS INT) AS day FROM range(60)")
    months = spark.sql("SELECT 'jan' AS m, DATE'2024-01-01' AS a, DATE'2024-02-01' AS b UNION ALL SELECT 'feb', DATE'2024-02-01', DATE'2024-03-01'")
    assert {r["m"]: r["count"] for r in intervals.interval_join(days, months, "day", "a", "b").groupBy("m").count().collect()} == {"jan": 31, "feb": 29}
    assert intervals.interval_join(days.limit(0), months, "day", "a", "b").count() == 0
    assert intervals.interval_join(days, months.limit(0), "day", "a", "b").count() == 0


def test_a_failing_write_leaves_the_old_table(spark, tmp_path):
    base = str(tmp_path)
    good = spark.range(5)
    bad = spark.range(5).select(F.raise_error(F.lit("broken")).cast("bigint").alias("id"))
    sinks.write_parquet(good, base, "clean", "t")
    with pytest.raises(Exception, match="broken"):
        sinks.write_parquet(bad, base, "clean", "t")
    assert sinks.read_table(spark, base, "clean", "t").count() == 5
    sinks.write_parquet(spark.range(7), base, "clean", "t")
    assert sinks.read_table(spark, base, "clean", "t").count() == 7


def test_tables_of_a_run_appear_together(spark, tmp_path):
    base = str(tmp_path)
    sinks.write_run(base, "r1", metrics=spark.range(3), refusals=spark.range(2))
    sinks.write_run(base, "r2", metrics=spark.range(9))
    broken = spark.range(1).select(F.raise_error(F.lit("broken")).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="broken"):
        sinks.write_run(base, "r1", metrics=spark.range(4), refusals=broken)
    assert (sinks.read_run(spark, base, "metrics", "r1").count(), sinks.read_run(spark, base, "refusals", "r1").count()) == (3, 2)
    sinks.write_run(base, "r1", metrics=spark.range(4))
    assert (sinks.read_run(spark, base, "metrics", "r1").count(), sinks.read_run(spark, base, "metrics", "r2").count()) == (4, 9)
    with pytest.raises(LookupError):
        sinks.read_run(spark, base, "validation", "r1")


def test_many_rules_in_one_pass(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(40), rng.choice("abcdef"), k, rng.choice(["x", "y", "z", "w", None])) for k in range(700)]
    df = spark.createDataFrame(rows, "c int, act string, seq int, who string").repartition(3)
    log = process.EventLog(df, "c", "act", "seq", resource="who")
    pairs = [(a, b) for a in "abcdefg" for b in "abcdefg" if a != b]
    first = {}
    for c, act, seq, _ in sorted(rows, key=lambda r: r[2]):
        first.setdefault((c, act), seq)
    order = {r["test"]: (r["violations"], r["missing"]) for r in process.sequence_order(log, pairs).collect()}
    duty = {r["test"]: (r["events"], r["culprits"]) for r in process.segregation_of_duties(log, pairs).collect()}
    for a, b in pairs:
        late = [first.get((c, a)) for c in range(40) if (c, b) in first and first.get((c, a), 10**9) > first[c, b]]
        assert order[f"order:{a}__before__{b}"] == (len(late), late.count(None))
        did = {}
        for c, act, _, who in rows:
            if who and act in (a, b):
                did.setdefault((c, who), []).append(act)
        guilty = {k: v for k, v in did.items() if len(set(v)) == 2}
        assert duty[f"sod:{a}__vs__{b}"] == (sum(map(len, guilty.values())), ", ".join(sorted({w for _, w in guilty})[:3]))
    plan = process.sequence_order(log, pairs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") <= 2  # the log, and the rules


@pytest.mark.parametrize("closed", [False, True])
def test_folded_bands_equal_the_pairs(spark, tiny_groups, closed):
    draw = random.Random(5)
    rows = [(i, draw.choice([None, float("nan"), -0.0, 0.0, *[round(draw.uniform(-9, 99), 1) for _ in range(60)]])) for i in range(300)]
    ends = [(b, *(lambda at, w: (at, at + w))(round(draw.uniform(-20, 99), 1), draw.choice([-1.0, 0.0, 0.3, 4.0, 60.0, float("inf")]))) for b in range(200)]
    ends += [(200, None, 5.0), (201, 1.0, float("nan")), (202, -0.0, 0.0), (203, 0.0, 0.0), (204, float("-inf"), float("inf"))]
    df, bands = spark.createDataFrame(rows, "n int, v double"), spark.createDataFrame(ends, "band int, lo double, hi double")
    pairs = intervals.interval_join(df, bands, "v", "lo", "hi", closed=closed).groupBy("n").agg(F.count("*").alias("c"), F.min("band").alias("m"))
    fold = {"c": (F.sum, F.lit(1)), "m": (F.min, F.col("band"))}
    folded = intervals.interval_join(df, bands, "v", "lo", "hi", closed=closed, fold=fold).select("n", "c", "m")
    assert sorted(map(tuple, folded.collect())) == sorted(map(tuple, pairs.collect()))
    assert intervals.interval_join(df.limit(0), bands, "v", "lo", "hi", fold=fold).count() == 0
    assert intervals.interval_join(df, bands.limit(0), "v", "lo", "hi", fold=fold).count() == 0


def test_folding_makes_no_pairs(spark):
    """Three thousand rows that all lie in three thousand bands: nine million pairs."""
    df, bands = spark.range(3000).select(F.col("id").cast("double").alias("v")), spark.range(3000).select((-F.col("id") - 1.0).alias("lo"), (F.col("id") + 3000.0).alias("hi"))
    folded = intervals.interval_join(df, bands, "v", "lo", "hi", fold={"c": (F.sum, F.lit(1))})
    assert folded.agg(F.min("c"), F.max("c"), F.count("*")).first()[:] == (3000, 3000, 3000)
