"""The cleaning rulebook: rules in a fixed order, every changed cell logged.

A rule takes the table and returns the new table and its log. Logs have the schema
``rule_id, column, row_index, before, after, reason``; ``row_index`` is the table's row
id, -1 for a note about a whole column.

Rules that change cells are first compiled to an ``Edit``. A plan writes what consecutive edits change into one array
column beside the cells and stores the table once for all of them; the log is read from what was stored.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom import scale
from metricloom.functions import dates, numbers, text, words
from metricloom.operators import variants
from metricloom.operators.common import stacked
from metricloom.operators.profile import _quoted, cells
from metricloom.session import materialize

ROW_ID = "_row_id"
MISSING_FLAG = "_missing_required"
CHANGES = "_changes"
MAX_LOSS_PCT = 5.0
DIFF_SCHEMA = "rule_id string, column string, row_index bigint, before string, after string, reason string"
# Names of the columns that an unpivot makes.
PERIOD_COLUMN = "Kỳ báo cáo"
VALUE_COLUMN = "Giá trị"

# The rules in the order they run, with the parameters each accepts.
RULE_PARAMETERS = {
    "trim_whitespace": (),
    "normalize_unicode_nfc": (),
    "replace_sentinel_with_null": ("sentinels",),
    "merge_text_variants": (),
    "cast_words_to_numbers": (),
    "standardize_datetime": ("assume_timezone",),
    "cast_numeric_safe": (),
    "drop_exact_duplicates": (),
    "unpivot_periods": ("label", "periods"),
    "flag_missing_required": (),
}
RULE_ORDER = tuple(RULE_PARAMETERS)
RESHAPING = ("unpivot_periods",)


class RuleError(ValueError):
    """A rule that cannot run as asked."""


@dataclass(frozen=True)
class Rule:
    rule_id: str
    columns: tuple[str, ...] = ()
    params: Mapping[str, object] = field(default_factory=dict)


Result = tuple[DataFrame, DataFrame]
Change = tuple[Column, Column, Column, str]


@dataclass(frozen=True)
class Edit:
    """A rule as columns of one projection: the new cells and, per column, (changed?, before, after, reason).

    ``df`` is the table with the ``helpers`` that these columns read; they go afterwards. ``notes`` are log rows about whole columns.
    """

    df: DataFrame
    new: Mapping[str, Column] = field(default_factory=dict)
    changes: Mapping[str, Change] = field(default_factory=dict)
    notes: Sequence[tuple] = ()
    helpers: Sequence[str] = ()

    def table(self) -> DataFrame:
        return self.df.withColumns(dict(self.new)).drop(*self.helpers)

    def entries(self, rule: Rule) -> Column:
        """The changes of one row as an array of log entries."""
        return F.array_compact(F.array(*[
            F.when(hit, F.struct(
                F.lit(rule.rule_id).alias("rule_id"), F.lit(name).alias("column"), F.coalesce(before.cast("string"), F.lit("")).alias("before"),
                F.coalesce(after.cast("string"), F.lit("")).alias("after"), F.lit(reason).alias("reason")))
            for name, (hit, before, after, reason) in self.changes.items()
        ]))

    def alone(self, rule: Rule) -> Result:
        """The new table and the log, for a rule that runs by itself."""
        log = _logged(self.df.withColumn(CHANGES, self.entries(rule))) if self.changes else _no_log(self.df)
        return self.table(), log.unionByName(_notes(self.df, list(self.notes))) if self.notes else log

    def tracked(self, rule: Rule) -> DataFrame:
        """The new table with the changes added to those of earlier rules."""
        known = [F.col(CHANGES)] if CHANGES in self.df.columns else []
        noted = self.df.withColumn(CHANGES, F.concat(*known, self.entries(rule))) if self.changes else self.df
        return noted.withColumns(dict(self.new)).drop(*self.helpers)


def _logged(df: DataFrame) -> DataFrame:
    """The log kept beside the cells, as rows."""
    return df.select(F.col(ROW_ID).cast("bigint").alias("row_index"), F.explode(CHANGES).alias("e")).select(
        "e.rule_id", "e.column", "row_index", "e.before", "e.after", "e.reason")


def _staged(df: DataFrame, new: Mapping[str, Column]) -> tuple[DataFrame, dict[str, Column]]:
    """New cells as helper columns, so that each is computed once for the cell and for its log entry."""
    names = {c: f"_after{i}" for i, c in enumerate(new)}
    return df.withColumns({names[c]: e for c, e in new.items()}), {c: F.col(n) for c, n in names.items()}


def _no_log(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], DIFF_SCHEMA)


def _notes(df: DataFrame, rows: list[tuple]) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, DIFF_SCHEMA)


def _targets(rule: Rule, df: DataFrame) -> list[str]:
    if not rule.columns:
        return [c for c in df.columns if c not in (ROW_ID, CHANGES)]
    missing = [c for c in rule.columns if c not in df.columns]
    if missing:
        raise RuleError(f"rule '{rule.rule_id}' names columns that do not exist: {missing}")
    return list(rule.columns)


def _text_targets(rule: Rule, df: DataFrame) -> list[str]:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in _targets(rule, df) if isinstance(kinds[c], T.StringType)]


def _rewrite(df: DataFrame, new: Mapping[str, Column], reason: str) -> Edit:
    """Replace cells and log those that differ."""
    staged, after = _staged(df, new)
    changes = {c: (~_quoted(c).eqNullSafe(e), _quoted(c), e, reason) for c, e in after.items()}
    return Edit(staged, after, changes, helpers=[f"_after{i}" for i in range(len(new))])


def _trim(df: DataFrame, rule: Rule) -> Edit:
    return _rewrite(df, {c: text.strip(_quoted(c)) for c in _text_targets(rule, df)}, "surrounding white space removed")


def _nfc(df: DataFrame, rule: Rule) -> Edit:
    """Only cells outside ASCII can be in another form, so only their values reach Python."""
    new = {}
    for c in _text_targets(rule, df):
        cell = _quoted(c)
        odd = cell.rlike(r"[^\x00-\x7F]")
        new[c] = F.when(odd, words.nfc(F.when(odd, cell))).otherwise(cell)
    return _rewrite(df, new, "Unicode normal form")


def _sentinels(df: DataFrame, rule: Rule) -> Edit:
    sentinels = rule.params.get("sentinels")
    if not isinstance(sentinels, (list, tuple)) or not sentinels:
        raise RuleError(f"rule '{rule.rule_id}' needs 'sentinels', a list of values; they are never guessed")
    if not rule.columns:
        raise RuleError(f"rule '{rule.rule_id}' needs its columns named: on a whole table it would erase meaningful zeros")
    wanted = [str(s) for s in sentinels]
    new = {c: F.when(~_quoted(c).cast("string").isin(wanted), _quoted(c)) for c in _targets(rule, df)}
    return _rewrite(df, new, "sentinel to empty")


def _datetimes(df: DataFrame, rule: Rule) -> Edit:
    zone = rule.params.get("assume_timezone")
    if not isinstance(zone, str) or not zone:
        raise RuleError(f"rule '{rule.rule_id}' needs 'assume_timezone'; it is never guessed")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    targets = _targets(rule, df)
    texts = [c for c in targets if isinstance(kinds[c], T.StringType)]
    if texts:
        flags = [a for i, c in enumerate(texts) for a in (
            F.count_if(dates.has_offset(_quoted(c))).alias(f"y{i}"), F.count_if(~dates.has_offset(_quoted(c)) & dates.parse_mixed(_quoted(c)).isNotNull()).alias(f"n{i}"))]
        seen = df.agg(*flags).first()
        mixed = [c for i, c in enumerate(texts) if seen[f"y{i}"] and seen[f"n{i}"]]
        if mixed:
            raise RuleError(f"columns {mixed} mix values with and without a time-zone offset")
    new, hits = {}, {}
    for c in targets:
        cell = _quoted(c)
        if isinstance(kinds[c], T.StringType):
            parsed = dates.parse_mixed(cell)
            new[c] = F.when(dates.has_offset(cell), parsed).otherwise(F.to_utc_timestamp(parsed, zone))
            hits[c] = (cell.isNotNull() & (cell != "") & parsed.isNull(), cell, F.lit(""), "not readable as a moment")
        else:
            new[c] = F.to_utc_timestamp(dates.as_moment(cell, kinds[c]), zone)
    return Edit(df, new, hits)


def conventions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How the numbers of each column are written, decided once per column.

    ``column, readable, numeric, only_international, only_local, convention, refusal, example``.
    """
    bare = text.strip(F.col("value"))
    counts = scale.value_counts(cells(df, columns).filter("value IS NOT NULL AND value <> ''"), ["column"], "value")
    us, vn = numbers.reads_international(bare), numbers.reads_local(bare)
    filled = (bare != "") & (F.lower(bare) != "nan")
    read = counts.withColumns({"_b": bare, "_us": us, "_vn": vn, "_f": filled})

    def weigh(c: Column) -> Column:
        return F.sum(F.when(c, F.col("n")).otherwise(0))

    both = F.col("_us") & F.col("_vn")
    marked = F.col("_b").rlike("[.,]")
    shape = read.groupBy("column").agg(
        F.sum("n").alias("readable"), weigh(F.col("_f")).alias("_filled"), weigh(F.col("_us") | F.col("_vn")).alias("numeric"),
        weigh(F.col("_us") & ~F.col("_vn")).alias("only_international"), weigh(F.col("_vn") & ~F.col("_us")).alias("only_local"),
        weigh(both & F.contains(F.col("_b"), F.lit(","))).alias("_comma"), weigh(both & F.col("_b").rlike(numbers.DOT_AMBIGUOUS)).alias("_dotted"),
        F.min(F.when(F.col("_us") & ~F.col("_vn") & F.contains(F.col("_b"), F.lit(",")), F.col("_b"))).alias("_us_example"),
        F.min(F.when(F.col("_vn") & marked, F.col("_b"))).alias("_vn_example"),
    )
    share = F.coalesce(F.try_divide("numeric", "_filled"), F.lit(0.0))
    mixed = (F.col("only_international") > 0) & (F.col("only_local") > 0)
    refusal = (
        F.when(share < numbers.NUMERIC_SHARE, "not a numeric column")
        .when(mixed, "two ways of writing numbers in one column")
        .when((F.col("only_local") > 0) | (F.col("only_international") > 0), None)
        .when(F.col("_comma") > 0, "a comma may group thousands or mark decimals")
        .when((F.col("_dotted") > 0) & (F.col("_dotted") == F.col("_filled")), "a point may group thousands or mark decimals")
    )
    convention = F.when(refusal.isNotNull(), None).when(F.col("only_local") > 0, numbers.LOCAL).otherwise(numbers.INTERNATIONAL)
    example = F.when(F.col("only_local") > 0, F.col("_vn_example")).when(F.col("only_international") > 0, F.col("_us_example"))
    return shape.select("column", "readable", "numeric", "only_international", "only_local", convention.alias("convention"), refusal.alias("refusal"), example.alias("example"))


def _numbers(df: DataFrame, rule: Rule) -> Edit:
    """The whole column decides: mostly numbers and one convention, otherwise it stays and the log says why."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    targets = [c for c in _targets(rule, df) if isinstance(kinds[c], T.StringType)]
    if not targets:
        return Edit(df)
    decided = {r["column"]: r for r in conventions(df, targets).collect()}  # one row per column
    new, hits, notes = {}, {}, []
    for c in targets:
        row, cell = decided.get(c), _quoted(c)
        if row is not None and row["refusal"]:
            notes.append((rule.rule_id, c, -1, "kept", "kept", row["refusal"]))
            continue
        convention = row["convention"] if row is not None else numbers.INTERNATIONAL
        parsed = numbers.with_convention(cell, F.lit(convention))
        new[c] = parsed
        hits[c] = (cell.isNotNull() & (cell != "") & parsed.isNull(), cell, F.lit(""), "not readable as a number")
        if row is not None and row["example"]:
            notes.append((rule.rule_id, c, -1, row["example"], "", f"read with the {convention} convention"))
    if hits:
        failed = df.agg(*[F.count_if(h[0]).alias(f"f{i}") for i, h in enumerate(hits.values())]).first()
        for i, c in enumerate(list(hits)):
            readable = decided[c]["readable"] if c in decided else 0
            if readable and (readable - failed[f"f{i}"]) / readable < numbers.NUMERIC_SHARE:
                notes = [n for n in notes if n[1] != c] + [(rule.rule_id, c, -1, "kept", "kept", "not a numeric column")]
                del new[c], hits[c]
    return Edit(df, new, hits, notes)


def _map_values(df: DataFrame, mapping: DataFrame, columns: Sequence[str], reason: str, notes: Sequence[tuple] = ()) -> Edit:
    """Replace cells through ``column, value, after``. The mapping holds distinct values only;
    whether it is broadcast is left to the planner's size check."""
    out, after = df, {}
    for i, c in enumerate(columns):
        one = mapping.filter(F.col("column") == c).select(F.col("value").alias(f"_from{i}"), F.col("after").alias(f"_to{i}"))
        out = out.join(one, _quoted(c) == F.col(f"_from{i}"), "left")
        after[c] = F.col(f"_to{i}")
    new = {c: F.coalesce(e, _quoted(c)) for c, e in after.items()}
    changes = {c: (e.isNotNull(), _quoted(c), e, reason) for c, e in after.items()}
    return Edit(out, new, changes, notes, [f"_{x}{i}" for i in range(len(columns)) for x in ("from", "to")])


def _counts_with_share(df: DataFrame, targets: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    counts = scale.value_counts(cells(df, targets).filter("value IS NOT NULL AND value <> ''"), ["column"], "value")
    number = numbers.to_double(F.col("value"))
    shape = counts.groupBy("column").agg(
        F.sum("n").alias("readable"), F.count("*").alias("distinct"), F.sum(F.when(number.isNotNull(), F.col("n")).otherwise(0)).alias("numbers")
    )
    return counts, shape


def _one_spelling(df: DataFrame, rule: Rule) -> Edit:
    targets = _text_targets(rule, df)
    if not targets:
        return Edit(df)
    counts, shape = _counts_with_share(df, targets)
    wordy = shape.filter(F.col("numbers") / F.col("readable") < numbers.NUMERIC_SHARE)
    forms = variants.canonical_forms(counts.join(F.broadcast(wordy), "column", "left_semi"), ["column"], "value", "n")
    mapping = forms.select("column", "value", F.col("kept").alias("after")).cache()  # rewritten spellings only
    touched = [r["column"] for r in mapping.select("column").distinct().collect()]  # at most one row per column
    return _map_values(df, mapping, [c for c in targets if c in touched], "one spelling per value")


def _spoken(df: DataFrame, rule: Rule) -> Edit:
    """Spelled-out numbers become digits where at least 90 % of the column reads as numbers."""
    targets = _text_targets(rule, df)
    if not targets:
        return Edit(df)
    counts, shape = _counts_with_share(df, targets)
    spelled = counts.filter(numbers.to_double(F.col("value")).isNull()).withColumn("after", words.spoken_numbers("value").cast("string")).filter("after IS NOT NULL").cache()
    understood = shape.join(spelled.groupBy("column").agg(F.sum("n").alias("spelled")), "column", "left").filter("distinct >= 2")
    share = (F.col("numbers") + F.coalesce("spelled", F.lit(0))) / F.col("readable")
    notes, good = [], []
    for r in understood.select("column", "readable", "spelled", share.alias("share")).collect():  # one row per column
        if r["share"] < numbers.NUMERIC_SHARE:
            notes.append((rule.rule_id, r["column"], -1, "kept", "kept", "not a column of spelled-out numbers"))
        elif r["spelled"]:
            good.append(r["column"])
    return _map_values(df, spelled.select("column", "value", "after"), [c for c in targets if c in good], "number written in words", notes)


def drop_exact_duplicates(df: DataFrame, rule: Rule) -> Result:
    """Keep the first row of equal ones. First rows are found by an aggregate that starts where the rows are, so a
    row with very many copies reaches no task whole; kept and dropped rows are read from one stored table."""
    keys = _targets(rule, df)
    first = df.groupBy(*[_quoted(c) for c in keys]).agg(F.min(ROW_ID).alias("_first")).select(F.col("_first").alias(ROW_ID), F.lit(True).alias("_first"))
    marked = materialize(df.join(first, ROW_ID, "left").select(*[_quoted(c) for c in df.columns], F.coalesce("_first", F.lit(False)).alias("_first")))
    name = ",".join(rule.columns) if rule.columns else "*"
    log = marked.filter(~F.col("_first")).select(
        F.lit(rule.rule_id).alias("rule_id"), F.lit(name).alias("column"), F.col(ROW_ID).cast("bigint").alias("row_index"),
        F.lit("duplicate row").alias("before"), F.lit("").alias("after"), F.lit("duplicate row dropped").alias("reason"),
    )
    return marked.filter("_first").drop("_first"), log


def unpivot_periods(df: DataFrame, rule: Rule) -> Result:
    """One row per (row, period) with a number. Values are read with one convention after the unpivot."""
    label, periods = rule.params.get("label"), rule.params.get("periods")
    if not isinstance(label, str) or not label:
        raise RuleError("rule 'unpivot_periods' needs 'label'")
    if not isinstance(periods, (list, tuple)) or len(periods) < 2:
        raise RuleError("rule 'unpivot_periods' needs at least two 'periods'")
    missing = [c for c in (label, *periods) if c not in df.columns]
    if missing:
        raise RuleError(f"rule 'unpivot_periods' names columns that do not exist: {missing}")
    taken = [c for c in (PERIOD_COLUMN, VALUE_COLUMN) if c in df.columns]
    if taken:
        raise RuleError(f"the table already has {taken}")
    keep = [c for c in df.columns if c not in periods and c != ROW_ID]
    filled = {p: F.when(~text.is_blank(_quoted(p)), _quoted(p).cast("string")) for p in periods}
    heading = F.coalesce(*filled.values()).isNull()
    entries = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(p).alias("period"), e.alias("value")) for i, (p, e) in enumerate(filled.items())])
    long = df.filter(~heading).select(F.col(ROW_ID).alias("_row"), *[_quoted(c) for c in keep], F.explode(entries).alias("e"))
    long = long.filter("e.value IS NOT NULL").select("_row", *[_quoted(c) for c in keep], "e.at", F.col("e.period").alias(PERIOD_COLUMN), F.col("e.value").alias(VALUE_COLUMN))
    # Position in the new table is (row, period); the id stays unique without a global sort.
    wide = len(periods)
    numbered = long.withColumn(ROW_ID, F.col("_row") * wide + F.col("at")).drop("_row", "at")
    cast, cast_log = cast_numeric_safe(numbered, Rule("cast_numeric_safe", (VALUE_COLUMN,)))
    out = cast.filter(_quoted(VALUE_COLUMN).isNotNull())
    log = df.filter(heading).select(
        F.lit(rule.rule_id).alias("rule_id"), F.lit(label).alias("column"), F.col(ROW_ID).cast("bigint").alias("row_index"),
        F.coalesce(_quoted(label).cast("string"), F.lit("")).alias("before"), F.lit("").alias("after"), F.lit("no number in any period").alias("reason"),
    )
    return out.select(ROW_ID, *[_quoted(c) for c in (*keep, PERIOD_COLUMN, VALUE_COLUMN)]), log.unionByName(cast_log)


def _missing(df: DataFrame, rule: Rule) -> Edit:
    required = _targets(rule, df)
    missing = F.lit(False)
    for c in required:
        missing = missing | _quoted(c).isNull() | (_quoted(c).cast("string") == "")
    return Edit(df, {MISSING_FLAG: missing}, {",".join(required): (missing, F.lit(""), F.lit("True"), "required value missing")})


EDITS: dict[str, Callable[[DataFrame, Rule], Edit]] = {
    "trim_whitespace": _trim,
    "normalize_unicode_nfc": _nfc,
    "replace_sentinel_with_null": _sentinels,
    "standardize_datetime": _datetimes,
    "cast_numeric_safe": _numbers,
    "merge_text_variants": _one_spelling,
    "cast_words_to_numbers": _spoken,
    "flag_missing_required": _missing,
}
#: Edits that look at the whole table before they decide; what came before is stored first.
DECIDED = ("standardize_datetime", "cast_numeric_safe", "merge_text_variants", "cast_words_to_numbers")


def _run_alone(rule_id: str) -> Callable[[DataFrame, Rule], Result]:
    def run(df: DataFrame, rule: Rule) -> Result:
        return EDITS[rule_id](df, rule).alone(rule)

    run.__name__, run.__doc__ = rule_id, EDITS[rule_id].__doc__
    return run


trim_whitespace = _run_alone("trim_whitespace")
normalize_unicode_nfc = _run_alone("normalize_unicode_nfc")
replace_sentinel_with_null = _run_alone("replace_sentinel_with_null")
standardize_datetime = _run_alone("standardize_datetime")
cast_numeric_safe = _run_alone("cast_numeric_safe")
merge_text_variants = _run_alone("merge_text_variants")
cast_words_to_numbers = _run_alone("cast_words_to_numbers")
flag_missing_required = _run_alone("flag_missing_required")

#: Rules that change the number of rows.
RESIZING: dict[str, Callable[[DataFrame, Rule], Result]] = {
    "drop_exact_duplicates": drop_exact_duplicates,
    "unpivot_periods": unpivot_periods,
}


@dataclass
class CleanOutcome:
    df: DataFrame
    diff: DataFrame
    rows_in: int
    rows_out: int
    rows_removed: int
    applied: tuple[str, ...]

    @property
    def dropped_pct(self) -> float:
        return 100.0 * self.rows_removed / self.rows_in if self.rows_in else 0.0

    def write(self, path: str, *, max_loss_pct: float = MAX_LOSS_PCT) -> None:
        """Store the clean table; refused when cleaning lost too many rows."""
        if self.dropped_pct > max_loss_pct:
            raise RuleError(f"cleaning dropped {self.dropped_pct:.2f} % of the rows, more than {max_loss_pct} %")
        self.df.write.mode("overwrite").parquet(path)


def apply_rules(df: DataFrame, plan: Sequence[Rule]) -> CleanOutcome:
    """Run a plan in the fixed order. ``df`` carries its row id in ``_row_id``."""
    unknown = [r.rule_id for r in plan if r.rule_id not in RULE_ORDER]
    if unknown:
        raise RuleError(f"unknown rules {unknown}; allowed: {', '.join(RULE_ORDER)}")
    for rule in plan:
        extra = sorted(set(rule.params) - set(RULE_PARAMETERS[rule.rule_id]))
        if extra:
            raise RuleError(f"rule '{rule.rule_id}' does not take {extra}")
    if CHANGES in df.columns:
        raise RuleError(f"the name '{CHANGES}' is taken")
    rows_in = rows = df.count()
    removed, logs, notes, out = 0, [], [], df
    ordered = sorted(plan, key=lambda r: RULE_ORDER.index(r.rule_id))
    for rule in ordered:
        if rule.rule_id in (*DECIDED, *RESIZING):
            out = _settled(out, logs)
        if rule.rule_id in EDITS:
            edit = EDITS[rule.rule_id](out, rule)
            notes += edit.notes
            out = edit.tracked(rule)
            continue
        out, log = RESIZING[rule.rule_id](out, rule)
        if rule.rule_id in RESHAPING:
            out = materialize(out)
        logs.append(log)
        after = out.count()
        removed += 0 if rule.rule_id in RESHAPING else rows - after
        rows = after
    out = _settled(out, logs)
    if notes:
        logs.append(_notes(df, notes))
    return CleanOutcome(out, stacked(logs) if logs else _no_log(df), rows_in, rows, removed, tuple(r.rule_id for r in ordered))


def _settled(df: DataFrame, logs: list[DataFrame]) -> DataFrame:
    """Store the table if edits are pending; their log is read from what was stored."""
    if CHANGES not in df.columns:
        return df
    stored = materialize(df)
    logs.append(_logged(stored))
    return stored.drop(CHANGES)


def summarise_diff(diff: DataFrame, examples: int = 3) -> DataFrame:
    """``rule_id, column, reason, changes, examples``: the first examples by row, ranked before the shuffle."""
    order = Window.partitionBy("rule_id", "column", "reason").orderBy("row_index", "before")
    shown = F.concat(F.lit("'"), "before", F.lit("' -> '"), "after", F.lit("'"))
    few = diff.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= examples)
    few = few.groupBy("rule_id", "column", "reason").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", shown.alias("s")))), lambda e: e["s"]).alias("examples"))
    return diff.groupBy("rule_id", "column", "reason").agg(F.count("*").alias("changes")).join(few, ["rule_id", "column", "reason"])


# --- value labels ------------------------------------------------------------

# Pairs that make a column a flag, and which of them mean yes.
FLAGS = ({"0", "1"}, {"0.0", "1.0"}, {"False", "True"})
TRUTHY = ("1", "1.0", "True")


def suggested_labels(categories: DataFrame, meanings: DataFrame) -> DataFrame:
    """``column, value, label`` for flags whose meaning is known: the meaning and its negation."""
    parts = F.filter(F.split("meaning", r"\s*;\s*|\s+/\s+"), lambda p: F.trim(p) != "")
    said = F.coalesce(F.trim(F.try_element_at(parts, F.lit(1))), F.lit(""))
    flags = categories.groupBy("column").agg(F.array_sort(F.collect_set("value")).alias("_v"))  # 2..12 values each
    is_flag = F.lit(False)
    for pair in FLAGS:
        is_flag = is_flag | (F.col("_v") == F.array(*[F.lit(v) for v in sorted(pair)]))
    known = flags.filter(is_flag).join(meanings, "column").withColumn("_said", said).filter((F.col("_said") != "") & ~F.lower("_said").startswith("không "))
    first, rest = F.substring("_said", 1, 1), F.expr("substring(_said, 2)")
    yes = F.concat(F.upper(first), rest)
    no = F.concat(F.lit("Không "), F.lower(first), rest)
    return known.select("column", F.explode("_v").alias("value"), yes.alias("_yes"), no.alias("_no")).select(
        "column", "value", F.when(F.col("value").isin(*TRUTHY), F.col("_yes")).otherwise(F.col("_no")).alias("label")
    )


def effective_labels(categories: DataFrame, saved: DataFrame, meanings: DataFrame) -> DataFrame:
    """Hand-written labels win per value, flags get a derived pair. All inputs hold categories, not rows."""
    auto = suggested_labels(categories, meanings).withColumnRenamed("label", "_auto")
    mine = saved.select("column", "value", F.col("label").alias("_mine"))
    both = categories.select("column", "value").join(mine, ["column", "value"], "left").join(auto, ["column", "value"], "left")
    return both.select("column", "value", F.coalesce(F.when(F.col("_mine") != "", F.col("_mine")), "_auto").alias("label")).filter("label IS NOT NULL")


def parse_labels(lines: DataFrame) -> DataFrame:
    """``column, text`` such as ``1 = Paid; 0 = Open`` to ``column, value, label`` (the last of equal values wins)."""
    parts = lines.select("column", F.posexplode(F.split("text", r"\s*;\s*|\n")).alias("at", "part"))
    value, label = F.trim(F.substring_index("part", "=", 1)), F.regexp_replace(F.trim(F.expr("substring(part, instr(part, '=') + 1)")), r"\s+", " ")
    pairs = parts.filter("instr(part, '=') > 0").select("column", "at", value.alias("value"), label.alias("label")).filter("value <> '' AND label <> ''")
    return pairs.groupBy("column", "value").agg(F.max_by("label", "at").alias("label"))


def with_labels(df: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """Add ``<column>_label``; values without a label show themselves."""
    one = labels.filter(F.col("column") == column).select(F.col("value").alias("_v"), F.col("label").alias("_l"))
    joined = df.join(one, _quoted(column).cast("string") == F.col("_v"), "left")
    return joined.withColumn(f"{column}_label", F.coalesce("_l", _quoted(column).cast("string"))).drop("_v", "_l")
