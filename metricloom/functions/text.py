"""Text expressions: folding, slugs, blanks. All JVM-side."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells that stand for "no number" in a period column.
NO_NUMBER = ("", "-", "--", "n/a", "na", "null", "none", "nan")

# Spellings of an empty cell.
SENTINELS = ("", "na", "n/a", "null", "none", "nil", "-", "--", "?", "khong co", "khong ro")

_WHITESPACE_ENDS = r"(^[\s\p{Z}\x{1C}-\x{1F}\x{85}]+)|([\s\p{Z}\x{1C}-\x{1F}\x{85}]+$)"


def _accent_table() -> tuple[str, str]:
    """Every precomposed Latin letter whose canonical form is an ASCII base plus marks."""
    accented, plain = [], []
    for start, stop in ((0x00C0, 0x0250), (0x1E00, 0x1F00)):
        for code in range(start, stop):
            parts = unicodedata.normalize("NFD", chr(code))
            if len(parts) > 1 and parts[0].isascii():
                accented.append(chr(code))
                plain.append(parts[0])
    return "".join(accented), "".join(plain)


_ACCENTED, _PLAIN = _accent_table()


def strip(text: Column) -> Column:
    """Remove every kind of white space from both ends."""
    return F.regexp_replace(text, _WHITESPACE_ENDS, "")


def plain_lower(text: Column) -> Column:
    """Lower case without accents; other characters stay where they are."""
    lowered = F.lower(text)
    bare = F.translate(lowered, _ACCENTED + "đ", _PLAIN + "d")
    return F.regexp_replace(bare, r"\p{Mn}", "")


def fold(text: Column) -> Column:
    """Lower case, no accents, ASCII words joined by single blanks: the equality key."""
    return F.array_join(F.regexp_extract_all(plain_lower(text), F.lit(r"[a-z0-9_]+"), F.lit(0)), " ")


def accented(text: Column) -> Column:
    return (F.translate(text, _ACCENTED, _PLAIN) != text) | text.rlike(r"\p{Mn}")


def slug(text: Column) -> Column:
    """Letters, digits, ``_`` and ``-`` kept, the rest ``_``, at most 40 characters."""
    return F.substring(F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "_"), 1, 40)


def ascii_slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def is_blank(text: Column) -> Column:
    """Null, or one of the spellings of "no number here"."""
    return text.isNull() | F.lower(strip(text.cast("string"))).isin(*NO_NUMBER)


def is_sentinel(text: Column) -> Column:
    return F.lower(strip(text)).isin(*SENTINELS)


def has_leading_zero(text: Column) -> Column:
    return strip(text).rlike(r"^-?0\d")


def preview(head: Column, length: Column | None = None, steps: int = 6) -> Column:
    """The first steps of a trace and how many follow; ``length`` is that of the whole trace if ``head`` is only its start."""
    shown = F.array_join(F.slice(head, 1, steps), " -> ")
    rest = (F.size(head) if length is None else length) - steps
    return F.when(rest <= 0, shown).otherwise(F.concat(shown, F.lit(" -> ... (+"), rest.cast("string"), F.lit(" steps)")))
