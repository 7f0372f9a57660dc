"""Numbers written in Vietnamese words, and Unicode normal form.

Both work on single short strings and run inside Arrow batches over *distinct* values.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Number words after folding.
DIGIT_WORDS = {
    "khong": 0, "mot": 1, "hai": 2, "ba": 3, "bon": 4, "tu": 4, "nam": 5, "lam": 5, "nham": 5,
    "sau": 6, "bay": 7, "tam": 8, "chin": 9,
}
MULTIPLES = {"ty": 10**9, "ti": 10**9, "trieu": 10**6, "nghin": 10**3, "ngan": 10**3, "tram": 100, "muoi": 10}
LINKS = ("linh", "le")


def words_of(text: str) -> list[str]:
    bare = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    return re.findall("[a-z0-9_]+", bare.replace("đ", "d"))


def _unit(tokens: list[str]) -> int | None:
    if len(tokens) != 1:
        return None
    word = tokens[0]
    return int(word) if word.isdigit() else DIGIT_WORDS.get(word)


def _value(tokens: list[str], sizes: list[str]) -> int | None:
    """Split at the largest multiple present: what stands before it counts it, what follows adds to it."""
    if not tokens:
        return 0
    for at, size in enumerate(sizes):
        if size not in tokens:
            continue
        cut = tokens.index(size)
        before, after, rest = tokens[:cut], tokens[cut + 1:], sizes[at:] if MULTIPLES[size] > 100 else sizes[at + 1:]
        if MULTIPLES[size] > 100:
            many = _value(before, rest) if before else 1
            more = _value(after, rest)
        else:
            many = _unit(before) if before else 1
            more = (_value(after, rest) if size == "tram" else _unit(after)) if after else 0
        return None if many is None or more is None else many * MULTIPLES[size] + more
    if tokens[0] in LINKS:
        return _unit(tokens[1:])
    return _unit(tokens)


def spoken_number(text: str) -> int | None:
    """``hai tram linh nam`` -> 205; None when any word is not a number word."""
    tokens = words_of(str(text))
    known = {*DIGIT_WORDS, *MULTIPLES, *LINKS}
    if not tokens or any(t not in known and not t.isdigit() for t in tokens):
        return None
    # A link word only opens the part below a hundred.
    return _value(tokens, ["ty", "ti", "trieu", "nghin", "ngan", "tram", "muoi"])


@F.pandas_udf(T.LongType())
def spoken_numbers(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else spoken_number(v)).astype("Int64")


@F.pandas_udf(T.StringType())
def nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))
