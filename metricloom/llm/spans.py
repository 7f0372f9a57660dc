"""Places of regular-expression matches inside a text, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,hit:string,before:string>>"


def matches(text: Column, pattern: str, keep: Callable[[Column, Column], Column] | None = None, group: int = 0, *, before: bool = False) -> Column:
    """Leftmost matches that do not overlap, as an array of (start, end, hit, before); places in code points, end exclusive. ``before``, if asked for, is what
    ``word_before`` makes of the text since the previous match.

    The texts between the matches and the matches themselves alternate, so adding up their lengths gives
    the places. ``keep(hit, group)`` drops matches after the search.
    """

    def step(state: Column, piece: Column) -> Column:
        start = state["at"] + F.length(piece["gap"])
        end = start + F.length(piece["hit"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), piece["hit"].alias("hit"), (word_before(piece["gap"]) if before else F.lit("")).alias("before")))
        kept = one if keep is None else F.when(keep(piece["hit"], piece["part"]), one).otherwise(nothing())
        return F.struct(end.alias("at"), F.concat(state["out"], kept).alias("out"))

    def after(state: Column, block: Column) -> Column:
        moved = F.transform(block["out"], lambda s: F.struct((s["start"] + state["at"]).alias("start"), (s["end"] + state["at"]).alias("end"), s["hit"].alias("hit"), s["before"].alias("before")))
        return F.struct((state["at"] + block["at"]).alias("at"), F.concat(state["out"], moved).alias("out"))

    def located(pieces: Column) -> Column:
        # In blocks of about the square root of their number, as an array that grows by one piece is copied each time.
        wide = F.ceil(F.sqrt(F.size(pieces))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.size(pieces) - 1, wide), lambda k: F.aggregate(F.slice(pieces, k + 1, wide), first, step))
        return F.aggregate(blocks, first, after)["out"]

    first = F.struct(F.lit(0).alias("at"), nothing().alias("out"))
    parts = bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.arrays_zip(
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"),
        (F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits).alias("part")).cast("array<struct<gap:string,hit:string,part:string>>"))
    return F.when(text.rlike(pattern), bound(parts, located)).otherwise(nothing())


def word_before(gap: Column) -> Column:
    """The last word of a text, of any length and any number of blanks away from its end, and one blank. One blank if there are only blanks, and nothing if the text does not end in one."""
    plain = F.translate(gap, "\t\n\x0b\x0c\r", " " * 5)
    bare = F.rtrim(plain)
    return F.when(F.length(bare) < F.length(plain), F.concat(F.substring_index(bare, " ", -1), F.lit(" "))).otherwise("")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def nothing() -> Column:
    return F.array().cast(SPAN)


def labelled(kind: str, order: int, found: Column) -> Column:
    """Spans with their kind and its place in the list of kinds."""
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("place"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span in its order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def by_start(spans: Column) -> Column:
    return F.array_sort(spans)


def by_kind(spans: Column) -> Column:
    turned = F.transform(spans, lambda s: F.struct(s["place"].alias("place"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(turned)


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
