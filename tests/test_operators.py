"""Small literal tables with known answers, and the refusals."""

import math

import pytest
from pyspark.sql import functions as F

from metricloom.functions import tails, words
from metricloom.operators import claims, clean, cohorts, digests, mart, metrics, models, points, privacy, process, profile, stats, textmine, timeline, validate
from metricloom.operators.clean import ROW_ID, Rule
from metricloom.sources import files, markup, xes
from metricloom.sources.heads import file_heads


def values(df, key="key", value="value"):
    return {r[key]: r[value] for r in df.collect()}


def test_rates_by_group_known_answer(spark):
    rows = [("success", "yes", 1)] * 7 + [("success", "no", 2)] * 3 + [("failure", "no", 1)] * 8 + [("failure", "yes", 3)] * 2 + [("other", "no", 1)] * 10
    df = spark.createDataFrame(rows, "poutcome string, y string, campaign int")
    got = values(metrics.outcome_rates(df, ["poutcome", "y"]))
    assert got["y.yes.share_pct.by.poutcome.success"] == 70.0
    assert got["y.yes.share_pct.by.poutcome.other"] == 0.0


def test_thin_groups_are_left_out(spark):
    df = spark.createDataFrame([("a", "x")] * 6 + [("b", "y")] * 4, "g string, o string")
    assert not any(".by.g.b" in k for k in values(metrics.outcome_rates(df, ["g", "o"])))


def test_points_known_answer(spark):
    df = spark.createDataFrame([("Q1-2026", 7702.72), ("Q2-2026", 8445.47)], "period string, v double")
    row = points.changes(df, [], "period", "v").first()
    assert (row["change"], row["pct_change"]) == (742.75, 9.6427)


def test_wide_and_narrow_breakdowns_agree(spark):
    df = spark.createDataFrame([(f"g{i % 3}", float(i), None if i % 4 == 0 else float(i * i)) for i in range(40)], "g string, a double, b double")
    kept = {"g": ["g0", "g1", "g2"]}
    get = lambda f: sorted((r["d"], r["r"], r["j"], round(r["mean"], 9)) for r in f(df, kept, ["a", "b"]).collect())
    assert get(metrics._means_by_expand) == get(metrics._means_by_product)


@pytest.mark.parametrize("said, number", [("hai trăm linh năm", 205), ("mười hai", 12), ("Ba nghìn", 3000), ("một triệu năm trăm nghìn hai mươi mốt", 1500021), ("linh", None), ("xin chào", None), ("hai hai", None), ("tỷ", 10**9)])
def test_number_words(said, number):
    assert words.spoken_number(said) == number


def test_trim_nfc_sentinel(spark):
    df = spark.createDataFrame([(0, "  a "), (1, "é"), (2, "N/A"), (3, None)], f"{ROW_ID} int, c string")
    out = clean.apply_rules(df, [Rule("replace_sentinel_with_null", ("c",), {"sentinels": ["N/A"]}), Rule("normalize_unicode_nfc"), Rule("trim_whitespace")])
    assert [r["c"] for r in out.df.orderBy(ROW_ID).collect()] == ["a", "é", None, None]
    assert out.applied == ("trim_whitespace", "normalize_unicode_nfc", "replace_sentinel_with_null")
    assert out.diff.count() == 3


@pytest.mark.parametrize("rule", [Rule("guess"), Rule("trim_whitespace", (), {"x": 1}), Rule("replace_sentinel_with_null", ("c",)), Rule("replace_sentinel_with_null", (), {"sentinels": ["0"]}), Rule("standardize_datetime", ("c",)), Rule("trim_whitespace", ("nope",))])
def test_rules_refuse(spark, rule):
    df = spark.createDataFrame([(0, "a")], f"{ROW_ID} int, c string")
    with pytest.raises(clean.RuleError):
        clean.apply_rules(df, [rule])


def test_mixed_offsets_refused(spark):
    df = spark.createDataFrame([(0, "2024-01-01 10:00:00"), (1, "2024-01-01T10:00:00Z")], f"{ROW_ID} int, c string")
    with pytest.raises(clean.RuleError):
        clean.apply_rules(df, [Rule("standardize_datetime", ("c",), {"assume_timezone": "UTC"})])


def test_loss_ceiling(spark, tmp_path):
    df = spark.createDataFrame([(i, "same") for i in range(10)], f"{ROW_ID} int, c string")
    out = clean.apply_rules(df, [Rule("drop_exact_duplicates")])
    assert out.dropped_pct == 90.0
    with pytest.raises(clean.RuleError):
        out.write(str(tmp_path / "x"))


@pytest.mark.parametrize("cells, convention", [(["1,234.5", "12"], "international"), (["1.234,5", "12"], "local"), (["1,234.5", "1.234,5"], None), (["1,234", "5,678"], None), (["1.234", "5.678"], None), (["1.5", "2"], "international")])
def test_conventions(spark, cells, convention):
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert clean.conventions(df, ["c"]).first()["convention"] == convention


def test_tails_against_tables():
    assert tails.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=2e-4)
    assert tails.t_two_sided(1.96, 1e7) == pytest.approx(0.05, abs=1e-4)
    assert tails.f_upper(4.26, 2, 9) == pytest.approx(0.05, abs=2e-4)
    assert math.isnan(tails.t_two_sided(1.0, 0))


def test_welch_and_refusals(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(10)] + [("b", float(i) + 5) for i in range(10)] + [("tiny", 1.0)], "g string, v double")
    out = stats.compare_groups(df, [("v", "g")])
    got = values(out.metrics)
    assert got["v.diff.by.g"] == -5.0
    assert got["v.ttest.by.g.t_stat"] == pytest.approx(-3.6927, abs=1e-4)
    assert [r["observed"] for r in out.refused.collect()] == [1.0]


def test_regression_refuses_collinear(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, float(i % 7)) for i in range(60)], "a double, b double, y double")
    assert "no single solution" in stats.regress(df, "y", ["a", "b"]).refused.first()["reason"]


def test_timeline_trend_and_season(spark):
    rows = [(f"{2022 + i // 12}-{i % 12 + 1:02d}-15", float(i)) for i in range(24)]
    got = values(timeline.measure(spark.createDataFrame(rows, "day string, v double"), "day", ["v"]).metrics)
    assert got["v.trend.with.day"] == 1.0
    assert got["v.seasonal.peak_number"] == 12.0
    assert got["v.change.by.day.2022-02"] == 1.0


def test_projection_refusals(spark):
    rows = [("line", i, 2.0 * i) for i in range(12)] + [("short", i, 1.0 * i) for i in range(4)] + [("flat", i, 3.0) for i in range(12)] + [("noise", i, float((i * 7) % 5)) for i in range(12)]
    got = {r["s"]: r for r in timeline.project(spark.createDataFrame(rows, "s string, i int, v double"), "s", ["i"], "v").collect()}
    assert got["line"]["low"] == got["line"]["high"] == 24.0
    assert (got["short"]["refusal"], got["flat"]["refusal"]) == ("too few periods", "the series does not change")
    assert got["noise"]["refusal"] == "the periods do not follow a line"


def test_process_small_log(spark):
    rows = []
    for c in range(6):
        for i, a in enumerate(["start", "check", "check", "end"] if c < 2 else ["start", "end"]):
            rows.append((f"c{c}", a, f"2024-01-0{c + 1} {i:02d}:00:00", len(rows), "ann"))
    df = spark.createDataFrame(rows, "case string, act string, ts string, id int, who string")
    log = process.EventLog(df, "case", "act", "id", ts="ts", resource="who")
    got = values(process.mine_process(log).metrics)
    assert got["process.variants"] == 2 and got["process.variant.1.share_pct"] == 66.6667
    assert got["process.rework.check.cases"] == 2 and got["process.selfloop.cases"] == 2
    assert "process.wait.start__to__end.median_hours" not in got
    assert process.segregation_of_duties(log, [("start", "end")]).first()["events"] == 12
    few = process.EventLog(df.filter("case < 'c3'"), "case", "act", "id", ts="ts")
    assert "process.variants" not in values(process.mine_process(few).metrics)


def test_sequence_order_counts_missing(spark):
    rows = [("a", "pay", 1), ("a", "ship", 2), ("b", "ship", 3), ("b", "pay", 4), ("c", "ship", 5)]
    log = process.EventLog(spark.createDataFrame(rows, "case string, act string, id int"), "case", "act", "id")
    row = process.sequence_order(log, [("pay", "ship")]).first()
    assert (row["violations"], row["missing"]) == (2, 1)


def test_case_attributes(spark):
    rows = [(f"c{c}", "a", i, "web" if c % 2 else "app", "north", f"n{c}-{i}") for c in range(6) for i in range(3)]
    df = spark.createDataFrame(rows, "case string, act string, id int, channel string, region string, note string").withColumn("id", F.monotonically_increasing_id())
    assert [tuple(r) for r in cohorts.case_attributes(process.EventLog(df, "case", "act", "id")).collect()] == [("channel", 2)]


def test_validation_report(spark):
    df = spark.createDataFrame([(1, 5.0, "ab"), (2, None, "abc"), (3, 50.0, None)], "id int, v double, s string")
    report = validate.validate(df, {"not_null": ["v"], "ranges": [{"column": "v", "max": 10}], "patterns": [{"column": "s", "pattern": "ab"}], "unique_together": [["id"]]}, "id")
    assert {r["test"]: r["cnt"] for r in report.failures.collect()} == {"v:not_nullable": 1, "v:range": 1, "s:pattern": 1}
    assert tuple(report.summary.first()) == (4, 1, 3, "failed")


def test_text_phrases_and_figures(spark):
    df = spark.createDataFrame([(1, "Doanh thu tăng 12% trong quý"), (2, "Doanh thu giảm 5,5 tỷ"), (3, "không có gì")], "id int, t string")
    reading = textmine.read(df, "id", "t")
    terms = {r["term"]: r["count"] for r in reading.terms.collect()}
    assert terms["doanh thu"] == 2 and "doanh" not in terms
    near = {(r["term"], r["number"]) for r in textmine.figures_near(df, "id", "t", ["doanh thu"]).collect()}
    assert near == {("doanh thu", "12%"), ("doanh thu", "5,5")}


def test_share_out_keeps_the_limit(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(10)], "id int, t string")
    assert textmine.share_out(textmine.read(df, "id", "t").terms).count() == 40


def test_masking_is_stable_and_leaves_nothing(spark):
    rows = [(1, "mail a@x.com or 0912345678"), (2, "again a@x.com and b@y.org"), (3, None), (4, "code 123456789012")]
    df = spark.createDataFrame(rows, "id int, note string")
    masked = {r["id"]: r["note"] for r in privacy.mask_rows(df, "id").collect()}
    assert masked == {1: "mail <EMAIL_1> or <PHONE_1>", 2: "again <EMAIL_1> and <EMAIL_2>", 3: None, 4: "code 123456789012"}
    privacy.assert_no_pii(spark.createDataFrame([(v,) for v in masked.values()], "note string"))
    with pytest.raises(ValueError):
        privacy.assert_no_pii(df, ["note"])


def test_hash_ignores_order(spark):
    df = spark.createDataFrame([(1, "a", 0.1), (2, "b", None), (2, "b", None)], "i int, s string, d double")
    assert digests.same_content(df, df.select("d", "s", "i").orderBy(F.desc("i")).repartition(3))
    assert not digests.same_content(df, df.dropDuplicates())


@pytest.mark.parametrize("number", [0.1, 3.0, -2.5, 123456.789, 12345678901.0, 1e-7, 1234567890.0, 0.00012345678912])
def test_ten_digits(spark, number):
    assert spark.range(1).select(digests.ten_digits(F.lit(number))).first()[0] == f"{number:.10g}"


def test_claims(spark):
    rows = [("v.mean.by.g.A", "v", "mean", "g", "A", 5.0, "", ""), ("v.mean.by.g.B", "v", "mean", "g", "B", 1234.5, "", ""), ("rows.total", "rows", "total", None, None, 9.0, "row", "")]
    table = spark.createDataFrame(rows, "key string, measure string, stat string, dim string, grp string, value double, unit string, source string")
    said = [(1, "Group {ten:g.B} is highest: {v.mean.by.g.B}"), (2, "Group {ten:g.A} is highest: {v.mean.by.g.A}"), (3, "There are 9 rows"), (4, "{rows.total} counted")]
    batch = spark.createDataFrame([(i, t, [], "ref", 0.5) for i, t in said], "claim_id int, template string, metric_keys array<string>, evidence string, confidence double")
    problems = {(r["claim_id"], r["problem"]) for r in claims.check_claims(batch, table).collect()}
    assert problems == {(2, "wrong extreme"), (3, "typed figure"), (3, "no metric cited")}
    assert values(claims.render(batch, table), "claim_id", "claim") == {1: "Group B is highest: 1,234.50", 4: "9 row counted"}


def test_importance_refuses_noise(spark):
    df = spark.range(60).select(F.rand(1).alias("y"), F.rand(2).alias("x"))
    assert models.measure_importance(df, "y", ["x"], trees=5).metrics.count() == 0
    assert "too few" in models.measure_importance(df.limit(20), "y", ["x"]).refused.first()["reason"]


def test_csv_names_and_dialect(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;name;name; {x} \n1;a;b;c\n2;d;e;\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("1|2\n3|4\n", encoding="utf-8")
    survey = {r["name"]: r for r in files.dialect_survey(spark, str(tmp_path)).collect()}
    assert (survey["a.csv"]["delimiter"], survey["a.csv"]["has_header"]) == (";", False)  # a repeated name is not a header
    assert (survey["b.csv"]["delimiter"], survey["b.csv"]["has_header"]) == ("|", False)
    df = files.read_csv(spark, str(tmp_path / "a.csv"), delimiter=";")
    assert df.columns == ["id", "name", "name__2", "(x)"] and df.count() == 2
    assert files.tidied_names(["", " a ", "a", "a"]) == ["cot_1", "a", "a__2", "a__3"] or files.tidied_names(["", " a ", "a"]) == ["cot_1", "a", "a__2"]


def test_html(spark):
    page = "<html><head><title>x</title></head><body><p>Hello <b>you</b></p><script>no</script><table><tr><th colspan=2>T</th></tr><tr><td>a</td><td>1</td></tr></table>"
    assert markup.visible_lines(page) == ["Hello you", "a 1"]
    assert markup.tables_of(page) == [("T", ["T", "Cột 2"], [["a", "1"]])]
    nested = "<table><tr><th>A<th>A<tr><td>x<table><tr><td>in</table>y<td> 1\n 2</table><table><tr><td></table><p>z<table><tr><td colspan=0>only"
    assert markup.tables_of(nested) == [("A", ["A", "A (2)"], [["xiny", "1 2"]]), ("only", ["only"], [])]


def test_mail():
    lines, attached = markup.mail_lines(b"From: a@x\nSubject: Hi\nContent-Type: text/plain\n\nBody line\n.\n")
    assert lines == ["From: a@x", "Subject: Hi", "Body line"] and attached == []


def brute_cases(index, target, share=0.5):
    chosen, seen, total = {}, set(), 0
    for case, variant, n in sorted(index):
        if variant not in seen and total + n <= int(target * share):
            seen.add(variant)
            chosen[case], total = n, total + n
    for case, _, n in sorted(index):
        if case not in chosen and total + n <= target:
            chosen[case], total = n, total + n
    return sorted(chosen)


@pytest.mark.parametrize("target", [5, 37, 90, 10_000])
def test_slice_equals_brute_force(spark, target):
    index = [(f"c{i:03d}", f"v{i % 7}", 3 + (i % 7) * 2) for i in range(60)]
    df = spark.createDataFrame(index, "case_id string, variant string, events int")
    assert sorted(r["case_id"] for r in xes.select_cases(df, target).collect()) == brute_cases(index, target)


def test_traces_are_shared_among_tasks(spark, tmp_path):
    event = '<event><string key="concept:name" value="a{0}"/><date key="time:timestamp" value="2020-01-0{0}"/></event>'
    traces = [f'<trace>\n<string key="concept:name" value="c{k}"/>' + "".join(event.format(j + 1) for j in range(k % 3 + 1)) + "</trace>" for k in range(2000)]
    (tmp_path / "log.xes").write_text('<?xml version="1.0"?><log><extension name="x"/><global><string key="g" value="1"/></global>' + "\n".join(traces) + "</log>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        events = xes.read_events(spark, str(tmp_path / "log.xes"), {"concept:name": "case_id"}, {"concept:name": "activity"})
        assert events.rdd.getNumPartitions() > 3
        got = events.groupBy("case_id").count().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["case_id"]: r["count"] for r in got} == {f"c{k}": k % 3 + 1 for k in range(2000)}


def test_profile_ignores_partitioning(spark):
    rows = [(i, f"n{i % 4}", str(i % 9), None if i % 5 else "x") for i in range(50)]
    df = spark.createDataFrame(rows, "id int, a string, b string, c string")
    get = lambda d: sorted(map(str, profile.profile_columns(d, "id").collect()))
    assert get(df) == get(df.orderBy(F.rand(3)).repartition(7))


def test_mart_sees_only_granted_tables(spark, tmp_path):
    a = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, v double")
    a.createOrReplaceTempView("hidden")
    assert mart.run_sql("SELECT sum(v) AS s FROM t", {"t": a}).first()["s"] == 5.0
    with pytest.raises(Exception):
        mart.run_sql("SELECT * FROM hidden", {"t": a}).collect()
    with pytest.raises(mart.MartError):
        mart.run_sql("SELECT * FROM t CROSS JOIN u", {"t": a, "u": a})
    with pytest.raises(mart.MartError):
        mart.build_mart("SELECT * FROM t", {"t": a}, str(tmp_path / "m"), max_rows=1)
    assert mart.build_mart("SELECT * FROM t", {"t": a}, str(tmp_path / "n")).rows_out == 2


def test_mart_is_confined(spark, tmp_path):
    a = spark.createDataFrame([("x", 2.0), ("y", 3.0)], "k string, v double")
    a.write.parquet(str(tmp_path / "file"))
    a.write.mode("overwrite").saveAsTable("not_granted")
    refused = (
        f"SELECT count(*) FROM parquet.`{tmp_path}/file`", "CREATE VIEW v AS SELECT 1", f"INSERT OVERWRITE DIRECTORY '{tmp_path}/out' USING parquet SELECT * FROM t",
        "SELECT * FROM default.not_granted", "SELECT (SELECT max(v) FROM default.not_granted) AS m FROM t", "SELECT 1) x; DROP TABLE not_granted --", "SELECT * FROM t, u",
    )
    for sql in refused:
        with pytest.raises(Exception):
            mart.run_sql(sql, {"t": a, "u": a}).collect()
    assert not (tmp_path / "out").exists()
    assert spark.table("not_granted").count() == 2
    spark.sql("DROP TABLE not_granted")
    for sql, rows in (("SELECT 'Join Cross' AS s FROM t", 2), ("WITH w AS (SELECT k FROM t) SELECT * FROM w JOIN t USING (k)", 2), ("SELECT * FROM t, u WHERE t.k = u.k", 2), ("SELECT * FROM t WHERE v IN (SELECT max(v) FROM u)", 1)):
        assert mart.run_sql(sql, {"t": a, "u": a}).count() == rows
    stored = mart.build_mart("SELECT * FROM t", {"t": a.repartition(3)}, str(tmp_path / "many"))
    assert stored.rows_out == 2


def test_named_points_keep_all_combinations(spark):
    rows = [(f"f{k}", "2020", float(k)) for k in range(25)]
    found = points.named_points(spark.createDataFrame(rows, "f string, year string, v double"), "year", ["2020"], ["v"], {"f": [r[0] for r in rows]})
    assert found.count() == 25


def test_infinite_cells_stay_in_their_group(spark):
    inf = float("inf")
    for width in (3, 40):
        rows = [(f"g{k % 3}", inf if k == 0 else float(k), *[float(k + j) for j in range(1, width)]) for k in range(9)]
        df = spark.createDataFrame(rows, ["g", *[f"m{j}" for j in range(width)]])
        found = metrics.breakdowns(df, ["g"], [f"m{j}" for j in range(width)], limit=10**6)
        values = {r["grp"]: r["value"] for r in found.filter("measure = 'm0'").collect()}
        assert values == {"g0": inf, "g1": 4.0, "g2": 5.0}


def test_every_pair_is_kept(spark):
    for width in (8, 10):
        rows = [(*[float((k * (j + 3)) % 7) for j in range(width - 1)], None) for k in range(20)]
        schema = ", ".join(f"c{j} double" for j in range(width))
        found = stats.strongest_pairs(spark.createDataFrame(rows, schema), [f"c{j}" for j in range(width)])
        assert found.count() == width * (width - 1) // 2
        assert found.filter("n = 0").count() == width - 1


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,"two\nlines"\n2,one\n')
    (tmp_path / "b.csv").write_text('id,note\n1,"says ""hi"""\n')
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("1", "two\nlines"), ("2", "one")]
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "b.csv")).collect()] == [("1", 'says "hi"')]


def test_texts_without_a_key_are_no_questions(spark):
    df = spark.createDataFrame([(None, "lead time grew"), ("1", "lead time grew"), ("2", "other words")], "k string, t string")
    got = {r["k"]: r["score"] for r in textmine.relevance(df, "k", "t", "lead time").collect()}
    assert got[None] == got["1"] > got["2"] == 0


def test_late_rows_count_for_personal_data_and_dates(spark):
    rows = [(k, "none" if k < 600 else f"u{k}@mail.example.org", "none" if k < 600 else "2024-03-05") for k in range(20_000)]
    df = spark.createDataFrame(rows, "id bigint, a string, b string")
    assert {r["column"]: r["is_pii"] for r in profile.pii_flags(df, "id", ["a"]).collect()} == {"a": True}
    assert {r["column"]: r["kind"] for r in profile.bi_fields(df, "id").collect()}["b"] == "date"


def test_surveys_read_heads_of_files_of_any_size(spark, tmp_path):
    with open(tmp_path / "huge.csv", "wb") as f:  # sparse: 3 GB that take no room
        f.write(b"name;size\n" + b"ab;1\n" * 20000)
        f.truncate(3 << 30)
    (tmp_path / "small.png").write_bytes(b"\x89PNG\r\n\x1a\n....")
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "_hidden.csv").write_bytes(b"a;b\n")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a b.json").write_bytes(b"{}\n")
    found = {r["name"]: r for r in files.file_survey(spark, str(tmp_path)).collect()}
    assert set(found) == {"huge.csv", "small.png", "empty.txt", "a b.json"}
    assert (found["huge.csv"]["size"], found["huge.csv"]["kind"], found["huge.csv"]["warning"]) == (3 << 30, "text", "large file")
    assert (found["small.png"]["label"], found["empty.txt"]["label"]) == ("PNG", "empty")
    survey = {r["name"]: r for r in files.dialect_survey(spark, str(tmp_path), glob="*.csv").collect()}
    assert (survey["huge.csv"]["delimiter"], survey["huge.csv"]["has_header"]) == (";", True)
    heads = file_heads(spark, str(tmp_path), 4)
    assert {len(r["head"]) for r in heads.collect()} == {0, 3, 4}
    assert file_heads(spark, str(tmp_path / "deep"), 4, glob="*.xml").count() == 0
