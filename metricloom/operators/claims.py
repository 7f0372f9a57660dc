"""Checking sentence templates against a metric table, in batch.

``claims``: ``claim_id, template, metric_keys ARRAY<STRING>, evidence, confidence``.
``metrics``: the metric schema. A template cites a value as ``{key}`` and a group's name as
``{ten:key}``; it may not contain a typed figure of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions import text
from metricloom.operators.common import stacked
from metricloom.operators.metrics import rankings

VALUE_MARK = r"\{([^{}]+)\}"
NAME_MARK = r"\{ten:([^{}]+)\}"

# Parts of a key that belong to an associational measure.
ASSOCIATIONAL = (
    ".corr.", ".rank_corr.", ".r2.", ".ttest.", ".anova.", ".effect_size.", ".eta_sq.", ".diff.by.", ".coef.", ".vif.",
    ".regression.", ".importance.", ".intercept",
)
# Parts of a key that belong to a statistical test.
TESTED = (".ttest.", ".anova.", ".chi2.", ".corr.", ".rank_corr.", ".effect_size.", ".eta_sq", ".p_value")
# Folded wording.
CAUSAL = (
    "lam tang", "lam giam", "lam cho", "khien", "gay ra", "dan den", "dan toi", "nguyen nhan", "tac dong len",
    "tac dong den", "tac dong toi", "tac dong manh", "anh huong den", "anh huong toi", "cai thien", "thuc day",
    "cause", "causes", "leads to",
)
TEST_WORDS = (
    "t-test", "t test", "ttest", "anova", "chi-square", "chi binh phuong", "kiem dinh", "p-value", "p value",
    "gia tri p", "y nghia thong ke", "co y nghia thong ke",
)
HIGHEST = (
    "cao nhat", "lon nhat", "nhieu nhat", "lau nhat", "dai nhat", "cham nhat", "dung dau", "dan dau",
    "cao hon cac nhom khac", "cao hon tat ca", "nhieu hon cac nhom khac", "highest", "longest",
)
LOWEST = (
    "thap nhat", "nho nhat", "it nhat", "ngan nhat", "nhanh nhat", "thap hon cac nhom khac", "lowest", "shortest",
)


def _tidy(key: Column) -> Column:
    return F.trim(F.regexp_replace(key, r"\s+", " "))


def _mentions(folded: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(folded, F.lit(word))
    return hit


def _any_part(keys: Column, parts: Sequence[str]) -> Column:
    return F.exists(keys, lambda k: _mentions(k, parts))


def _bare(template: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(template, NAME_MARK, ""), VALUE_MARK, "")


def citations(claims: DataFrame) -> DataFrame:
    """``claim_id, at, key, is_name``: every placeholder of every template in order."""
    values = F.regexp_extract_all(F.regexp_replace("template", NAME_MARK, ""), F.lit(VALUE_MARK), F.lit(1))
    names = F.regexp_extract_all("template", F.lit(NAME_MARK), F.lit(1))
    both = F.concat(
        F.transform(values, lambda k: F.struct(_tidy(k).alias("key"), F.lit(False).alias("is_name"))),
        F.transform(names, lambda k: F.struct(_tidy(k).alias("key"), F.lit(True).alias("is_name"))),
    )
    return claims.select("claim_id", F.posexplode(both).alias("at", "c")).select("claim_id", "at", "c.key", "c.is_name")


def resolved(claims: DataFrame, metrics: DataFrame) -> DataFrame:
    """Citations with the metric they point to. A name may leave out the measure (``dim.group``)."""
    rest = ("measure", "stat", "dim", "grp", "value", "unit")
    known = metrics.groupBy(_tidy(F.col("key")).alias("real")).agg(F.min(F.struct(*rest)).alias("m")).select("real", "m.*")  # of equal keys always the same one
    cited = citations(claims)
    exact = cited.join(known, cited["key"] == known["real"], "left")
    short = known.filter(F.contains("real", F.lit(".by."))).select(
        F.substring_index("real", ".by.", -1).alias("_suffix"), F.struct("real", "measure", "stat", "dim", "grp", "value", "unit").alias("_m"))
    short = short.groupBy("_suffix").agg(F.min("_m").alias("_m"))
    loose = exact.join(short, F.col("is_name") & F.col("real").isNull() & (F.col("key") == F.col("_suffix")), "left")
    pick = lambda c: F.coalesce(F.col(c), F.col(f"_m.{c}")).alias(c)
    return loose.select("claim_id", "at", "key", "is_name", *[pick(c) for c in ("real", "measure", "stat", "dim", "grp", "value", "unit")])


def typed_figures(claims: DataFrame, metrics: DataFrame) -> DataFrame:
    """Claims with a figure outside placeholders and outside labels known from the metric keys.

    A label is only compared with texts that share one of its runs of digits.
    """
    bare = claims.select("claim_id", _bare(F.col("template")).alias("bare")).filter(F.col("bare").rlike(r"\d"))
    parts = metrics.select(F.explode(F.split("key", r"\.")).alias("label")).filter(F.col("label").rlike(r"\d")).distinct()
    spelled = parts.select(F.explode(F.array_distinct(F.array("label", F.replace("label", F.lit("_"), F.lit(" ")), F.replace("label", F.lit("_"), F.lit("-"))))).alias("label"))
    spelled = spelled.withColumn("_run", F.regexp_extract("label", r"\d+", 0)).distinct()
    runs = bare.select("claim_id", "bare", F.explode(F.array_distinct(F.regexp_extract_all("bare", F.lit(r"\d+"), F.lit(0)))).alias("_run"))
    found = runs.join(spelled, "_run").filter(F.contains("bare", F.col("label")))
    # Labels inside one short sentence.
    per_claim = found.groupBy("claim_id").agg(F.array_sort(F.collect_set(F.struct((-F.length("label")).alias("n"), "label"))).alias("_labels"))
    stripped = F.aggregate(F.coalesce("_labels", F.array().cast("array<struct<n:int,label:string>>")), F.col("bare"), lambda acc, l: F.replace(acc, l["label"], F.lit(" ")))
    return bare.join(per_claim, "claim_id", "left").filter(stripped.rlike(r"\d")).select("claim_id")


def wrong_extremes(claims: DataFrame, metrics: DataFrame, found: DataFrame) -> DataFrame:
    """Claims that say highest or lowest without citing the real top or bottom group: ``claim_id, detail``."""
    folded = text.plain_lower(F.col("template"))
    says = claims.select("claim_id", _mentions(folded, HIGHEST).alias("top"), _mentions(folded, LOWEST).alias("bottom")).filter("top <> bottom")
    position = says.select("claim_id", F.when(F.col("top"), "highest").otherwise("lowest").alias("position"))
    family = F.concat_ws("|", "measure", "stat", "dim")
    grouped = found.filter(F.col("grp").isNotNull()).select("claim_id", family.alias("family"), "grp")
    ends = rankings(metrics).select("family", "position", F.col("grp").alias("winner"))
    plain_ends = found.filter(F.col("key").rlike(r"\.(max|min)$")).select("claim_id").distinct()
    judged = position.join(plain_ends, "claim_id", "left_anti").join(grouped, "claim_id", "left").join(ends, ["family", "position"], "left")
    per_claim = judged.groupBy("claim_id", "position").agg(
        F.count("winner").alias("ranked"), F.min(F.when(F.col("grp") != F.col("winner"), F.struct("grp", "winner"))).alias("miss")
    )
    return per_claim.filter((F.col("ranked") == 0) | F.col("miss").isNotNull()).select(
        "claim_id",
        F.when(F.col("ranked") == 0, "cites no group of a ranking").otherwise(F.concat_ws(" ", "miss.grp", F.lit("is not the"), "position", F.lit("group:"), "miss.winner")).alias("detail"),
    )


def check_claims(claims: DataFrame, metrics: DataFrame) -> DataFrame:
    """``claim_id, problem, detail``: every reason to reject a claim. A claim without a row is grounded."""
    found = resolved(claims, metrics)
    values = found.filter(~F.col("is_name"))
    parts = [typed_figures(claims, metrics).select("claim_id", F.lit("typed figure").alias("problem"), F.lit("").alias("detail"))]
    cited = values.groupBy("claim_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.when(F.col("real").isNull(), F.col("key")))).alias("unknown"))
    per = claims.join(cited, "claim_id", "left")
    parts.append(per.filter("n IS NULL").select("claim_id", F.lit("no metric cited").alias("problem"), F.lit("").alias("detail")))
    parts.append(per.filter(F.size("unknown") > 0).select("claim_id", F.lit("unknown metric").alias("problem"), F.array_join("unknown", ", ").alias("detail")))
    family = F.concat_ws("|", "measure", "stat", "dim")
    families = rankings(metrics).select(F.col("family")).distinct()
    named = found.filter("is_name").withColumn("family", F.when(F.col("grp").isNotNull(), family))
    parts.append(named.filter("real IS NULL").select("claim_id", F.lit("unknown name").alias("problem"), F.col("key").alias("detail")))
    parts.append(named.filter("real IS NOT NULL").join(families, "family", "left_anti").select("claim_id", F.lit("not a group name").alias("problem"), F.col("key").alias("detail")))
    used = found.groupBy("claim_id").agg(F.array_sort(F.collect_set(F.coalesce("real", "key"))).alias("used"), F.collect_set("key").alias("raw"))
    declared = F.array_sort(F.array_distinct(F.transform("metric_keys", lambda k: _tidy(F.regexp_replace(k, "^ten:", "")))))
    full = claims.join(used, "claim_id", "left").withColumn("declared", declared)
    parts.append(full.filter((F.size("declared") > 0) & ~F.col("declared").eqNullSafe(F.coalesce("used", F.array().cast("array<string>")))).select(
        "claim_id", F.lit("declared keys differ").alias("problem"), F.array_join("declared", ", ").alias("detail")))
    parts.append(claims.filter(F.coalesce("evidence", F.lit("")) == "").select("claim_id", F.lit("no evidence").alias("problem"), F.lit("").alias("detail")))
    parts.append(claims.filter(~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False))).select("claim_id", F.lit("confidence outside 0..1").alias("problem"), F.col("confidence").cast("string").alias("detail")))
    parts.append(wrong_extremes(claims, metrics, found).select("claim_id", F.lit("wrong extreme").alias("problem"), "detail"))
    parts.append(wording(claims))
    return stacked(parts)


def wording(claims: DataFrame) -> DataFrame:
    """Causal wording on associational metrics, and tests named but never cited."""
    keys = F.regexp_extract_all(F.regexp_replace("template", NAME_MARK, ""), F.lit(VALUE_MARK), F.lit(1))
    folded = text.plain_lower(F.col("template"))
    flags = claims.select(
        "claim_id",
        (_any_part(keys, ASSOCIATIONAL) & _mentions(folded, CAUSAL)).alias("causal"),
        (_mentions(folded, TEST_WORDS) & ~_any_part(keys, TESTED)).alias("untested"),
    )
    kinds = F.array_compact(F.array(F.when(F.col("causal"), "causal wording"), F.when(F.col("untested"), "test never run")))
    return flags.select("claim_id", F.explode(kinds).alias("problem"), F.lit("").alias("detail"))


def formatted(value: Column, unit: Column) -> Column:
    """Thousands with commas, no decimals for whole numbers and two otherwise, then the unit."""
    number = F.when(value % 1 == 0, F.format_number(value, 0)).otherwise(F.format_number(value, 2))
    return F.when(F.coalesce(unit, F.lit("")) == "", number).otherwise(F.concat_ws(" ", number, unit))


def render(claims: DataFrame, metrics: DataFrame) -> DataFrame:
    """``claim_id, claim``: accepted templates with values, units and group names in place."""
    rejected = check_claims(claims, metrics).select("claim_id").distinct()
    accepted = claims.join(rejected, "claim_id", "left_anti")
    found = resolved(accepted, metrics)
    marks = found.select(
        "claim_id", "at",
        F.when(F.col("is_name"), F.concat(F.lit("{ten:"), "key", F.lit("}"))).otherwise(F.concat(F.lit("{"), "key", F.lit("}"))).alias("mark"),
        F.when(F.col("is_name"), F.coalesce("grp", F.substring_index("real", ".", -1))).otherwise(formatted(F.col("value"), F.col("unit"))).alias("shown"),
    )
    # The placeholders of one sentence.
    per = marks.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("at", "mark", "shown"))).alias("marks"))
    done = F.aggregate("marks", F.col("template"), lambda acc, m: F.replace(acc, m["mark"], m["shown"]))
    return accepted.join(per, "claim_id").select("claim_id", done.alias("claim"))


def untouched(claims: DataFrame, metrics: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted columns (``column``) that no claim is based on."""
    used = resolved(claims, metrics).filter(F.col("real").isNotNull())
    columns = used.select(F.explode(F.array_compact(F.array(F.substring_index("measure", ".", 1), F.col("dim")))).alias("column")).distinct()
    return wanted.join(columns, "column", "left_anti")
