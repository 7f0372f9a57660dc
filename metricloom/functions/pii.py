"""Personal-data patterns. Kinds, patterns and the order in which they claim text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERNS = (
    ("EMAIL", r"\b[\w.%+-]+@[\w.-]+\.[A-Za-z]{2,}\b"),
    ("TAX_ID", r"(?<!\d)\d{10}(?:-\d{3})(?!\d)"),
    ("PHONE", r"(?<![\w+])(?:\+84|0)(?:\d[ .-]?){8,9}\d(?![\w])"),
    ("NATIONAL_ID", r"(?<!\d)\d{12}(?!\d)"),
    ("BANK_ACCOUNT", r"(?<!\d)\d{8,19}(?!\d)"),
)
STRONG = ("EMAIL", "PHONE", "TAX_ID")

# Parts of a column name that hint at personal data.
NAME_HINTS = (
    "account", "acct", "bank", "iban", "stk", "tai_khoan", "taikhoan", "tax", "mst", "cccd", "cmnd",
    "national_id", "citizen", "passport", "ssn", "email", "mail", "phone", "mobile", "dien_thoai",
)

# Python's \w, \b and \d are Unicode-aware; Java needs the flag.
_FLAG = "(?U)"


def name_suggests_pii(column: str) -> bool:
    return any(hint in column.lower() for hint in NAME_HINTS)


def pattern(kind: str) -> str:
    return _FLAG + dict(PATTERNS)[kind]


# What a text must contain before a pattern is worth running: cheap tests that skip most texts.
_DIGITS = r"\p{Nd}(?:[ .-]?\p{Nd}){7}"


def worth(kind: str, text: Column) -> Column:
    return F.contains(text, F.lit("@")) if kind == "EMAIL" else text.rlike(_DIGITS)


def extract(kind: str, text: Column) -> Column:
    """All matches of one kind."""
    found = F.regexp_extract_all(text, F.lit(pattern(kind)), F.lit(0))
    return F.when(worth(kind, text), found).otherwise(F.array().cast("array<string>"))


def take_out(kind: str, text: Column, mark: str = "  ") -> Column:
    """The text with every match of one kind replaced; two blanks never join digits of different numbers."""
    return F.when(worth(kind, text), F.regexp_replace(text, pattern(kind), mark)).otherwise(text)


def tagged(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def hits(text: Column) -> Column:
    """``array<struct<kind, value>>``. Each pattern takes its text away from the next ones."""
    found, working = [], text
    for kind, _ in PATTERNS:
        found.append(tagged(kind, extract(kind, working)))
        working = take_out(kind, working)
    return F.concat(*found)


def kinds(text: Column) -> dict[str, Column]:
    """One boolean per kind, with the same order of claims as :func:`hits`."""
    found, working = {}, text
    for kind, _ in PATTERNS:
        found[kind] = worth(kind, working) & working.rlike(pattern(kind))
        working = take_out(kind, working)
    return found


def any_of(flags: dict[str, Column], wanted: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [flags[k] for k in wanted])
