"""A plan of rules gives what its rules give one after another, from tables stored once for a run of edits."""

from pyspark.sql import functions as F

from metricloom.operators import clean
from metricloom.operators.clean import Rule
from metricloom.session import checkpoint_dir

ROWS = [
    (1, " Ha Noi ", "1,200.5", "N/A"), (2, "Ha Noi", "1,300.5", "x"), (3, "HA NOI", " 1,400.25", None), (4, "Café", "2,000.75", "N/A "),
    (5, "Ha Noi", "1,300.5", "x"), (6, "Ha Noi", "", ""), (7, None, "7,000.125", "y"), (8, " ", "1,300.5", "x"),
]
PLAN = [
    Rule("cast_numeric_safe", ("amount",)), Rule("trim_whitespace"), Rule("drop_exact_duplicates"), Rule("merge_text_variants", ("city",)),
    Rule("replace_sentinel_with_null", ("code",), {"sentinels": ["N/A"]}), Rule("normalize_unicode_nfc"), Rule("flag_missing_required", ("city", "amount")),
]


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_a_plan_equals_its_rules_in_turn(spark):
    df = spark.createDataFrame(ROWS, "_row_id long, city string, amount string, code string")
    out = clean.apply_rules(df, PLAN)
    table, logs = df, []
    for rule in sorted(PLAN, key=lambda r: clean.RULE_ORDER.index(r.rule_id)):
        table, log = getattr(clean, rule.rule_id)(table, rule)
        logs += rows_of(log)
    assert rows_of(out.df) == rows_of(table) and out.df.columns == table.columns
    assert rows_of(out.diff) == sorted(logs)
    assert (out.rows_in, out.rows_out, out.rows_removed) == (8, 7, 1)
    assert out.applied == tuple(sorted((r.rule_id for r in PLAN), key=clean.RULE_ORDER.index))


def test_the_source_is_not_read_again_for_more_cell_rules(spark):
    source = f"{checkpoint_dir(spark)}/clean-source"
    spark.createDataFrame(ROWS, "_row_id long, city string, amount string, code string").write.mode("overwrite").parquet(source)
    df = spark.read.parquet(source)
    for plan in (PLAN[1:2], [PLAN[1], PLAN[4], PLAN[5]], PLAN):
        out = clean.apply_rules(df, plan)
        assert not [f for part in (out.df, out.diff) for f in part.inputFiles() if "clean-source" in f]
    one, three = clean.apply_rules(df, PLAN[1:2]), clean.apply_rules(df, [PLAN[1], PLAN[4], PLAN[5]])
    assert len({f.rsplit("/", 1)[0] for f in one.diff.inputFiles()}) == len({f.rsplit("/", 1)[0] for f in three.diff.inputFiles()}) == 1


def test_a_hot_row_leaves_one_copy(spark):
    df = spark.range(3000).select(F.col("id").alias("_row_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("c"))
    out = clean.apply_rules(df, [Rule("drop_exact_duplicates")])
    assert out.rows_out == 2001 and out.rows_removed == 999
    assert out.df.filter("c = 'hot'").collect()[0]["_row_id"] == 0
    assert out.diff.count() == 999
