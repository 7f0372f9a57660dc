"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets: the sources, in code point order and null last, carry repeating weights. They share ``budget`` times all words
by weight; a target stops at ``cap`` times its source's words, and what is above is shared again among the
others. Sorted by cap and weight, the capped sources are a prefix, so running sums settle it at once.

Quotas: a source is cut by a hash of the row into cells of about ``cell_words`` words. Every cell claims
its part of the source's target. The blocks, ``block`` words each, go one by one to the
cell with the highest quotient claim / (2 * blocks + 1). The outcome is the claim divided by one common divisor, rounded;
the divisor is found by evaluating many candidates in each pass over the cells, and blocks that tie at it go by order.

Selection: the rows of a cell are laid end to end in an order drawn from ``seed`` and cut into blocks; the
first blocks are taken, and after a full pass over the cell they are taken again, up to ``cap`` passes. A row's
words lie in taken blocks or not, so a part of a row may be taken.

Cases: a null or blank text has size 0 and gives 0. Null is a source of its own. A source without words has target 0.
Rows that are equal in id and text share one place in the order up to their count. An empty table gives no rows. The same
rows give the same mix in every run and partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.common import column, fresh, n_words, words
from metricloom.scale import Sequenced
from metricloom.session import materialize

#: Divisors that one pass over the cells evaluates.
CANDIDATES = 48


def targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: tuple[int, int] = (3, 2), cap: int = 2) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``. ``budget`` is a fraction of all words."""
    up, down = budget
    placed = Sequenced(sources.withColumn("last", F.col("source").isNull()), [], ["last", "source"]).with_position("place").rows()
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")).cast("bigint")
    ready = placed.withColumn("weight", pick).withColumn("most", F.col("source_size") * cap * down)  # all in 1/down words
    total = ready.agg(F.sum("source_size"), F.sum("weight")).first()
    if total[1] is None:
        return sources.withColumn("target", F.lit(0.0))
    ready = ready.withColumn("ratio", F.col("most") / F.col("weight"))
    ordered = Sequenced(ready, [], ["ratio", "place"]).with_running_sum("most_upto", "most").with_running_sum("weight_upto", "weight").rows()
    left = F.lit(total[0] * up) - F.col("most_upto") + F.col("most")
    rest = F.lit(total[1]) - F.col("weight_upto") + F.col("weight")
    decided = materialize(ordered.withColumn("full", F.col("most") * rest <= left * F.col("weight")))
    held = decided.agg(F.sum(F.when(F.col("full"), F.col("most"))), F.sum(F.when(~F.col("full"), F.col("weight")))).first()
    open_ = total[0] * up - (held[0] or 0)
    level = open_ / (down * held[1]) if held[1] else 0.0
    target = F.when(F.col("full"), (F.col("source_size") * cap).cast("double")).otherwise(F.col("weight") * F.lit(level))
    return decided.select("source", "source_size", target.alias("target"))


def apportion(cells: DataFrame, claim: str, seats: int, order: list[str], name: str = "quota") -> DataFrame:
    """``cells`` with the Sainte-Laguë share of ``seats`` in column ``name``; ties go by ``order``."""
    whole = float(cells.agg(F.sum(F.col(claim).cast("decimal(38,9)"))).first()[0] or 0)  # decimals add up to the same in any order
    if seats <= 0 or whole <= 0:
        return cells.withColumn(name, F.lit(0).cast("bigint"))

    def rounded(divisor: float) -> Column:
        return F.floor(F.col(claim) / F.lit(divisor) + 0.5)

    def given(divisors: list[float]) -> list[int]:
        return [int(x) for x in cells.agg(*[F.sum(rounded(d)) for d in divisors]).first()]

    even = whole / seats
    few, many = even, even  # divisors that give at most and at least the seats
    while given([few])[0] > seats:
        few *= 2
    while given([many])[0] < seats:
        many /= 2
    for _ in range(9):
        if few - many <= 1e-13 * even:
            break
        grid = [many + (few - many) * k / (CANDIDATES + 1) for k in range(1, CANDIDATES + 1)]
        counts = given(grid)
        low = [d for d, c in zip(grid, counts) if c <= seats]
        high = [d for d, c in zip(grid, counts) if c >= seats]
        few, many = min([few, *low]), max([many, *high])
        if seats in counts:
            few = grid[counts.index(seats)]
            break
    sure = cells.withColumn(name, rounded(few).cast("bigint"))
    missing = seats - given([few])[0]
    if not missing:
        return sure
    next_up = F.col(claim) / (2 * F.col(name) + 1)
    tied = Sequenced(sure.filter(rounded(many) > F.col(name)).withColumn("_next", -next_up), [], ["_next", *order]).with_position("_place").rows()
    more = tied.filter(F.col("_place") <= missing).select(*[F.col(c).alias(f"_tied_{c}") for c in order], F.lit(1).alias("_more"))
    same = [F.col(c).eqNullSafe(F.col(f"_tied_{c}")) for c in order]
    joined = sure.join(more, same, "left").withColumn(name, F.col(name) + F.coalesce("_more", F.lit(0)))
    return joined.drop("_more", *[f"_tied_{c}" for c in order])


def mix(
    df: DataFrame,
    row_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    *,
    weights: tuple[int, ...] = (3, 1, 2),
    budget: tuple[int, int] = (3, 2),
    cap: int = 2,
    block: int = 16,
    cell_words: int = 100_000,
    seed: int = 5,
) -> DataFrame:
    """``row_id, seen, size, source_size, target, taken`` for every row; ``seen`` is a hash of the text."""
    plain = df.select(column(df, row_id).alias("id"), column(df, source).alias("source"), n_words(column(df, text)).alias("size"), F.xxhash64(F.coalesce(column(df, text), F.lit(""))).alias("seen"))
    rows = materialize(plain)
    wanted = materialize(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, cap))
    wanted = wanted.withColumnRenamed("source", "_source")
    parts = F.ceil(F.col("source_size") / F.lit(cell_words))
    drawn = F.xxhash64(F.lit(seed), "id", "seen")
    dealt = rows.join(wanted, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    dealt = dealt.withColumn("drawn", drawn).withColumn("cell", F.pmod("drawn", F.greatest(parts, F.lit(1)).cast("bigint")))
    dealt = materialize(dealt.withColumn("drawn", F.xxhash64(F.lit(seed + 1), "drawn")))
    cells = dealt.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"), F.first("source_size").alias("ss"), F.first("target").alias("t"))
    cells = materialize(cells.filter("cell_size > 0").select("source", "cell", "cell_size", (F.col("t") * F.col("cell_size") / F.col("ss")).alias("claim")))
    words_of_all = cells.agg(F.sum("cell_size")).first()[0] or 0
    up, down = budget
    goal = words_of_all * min(up, cap * down)  # the targets' sum in 1/down words: what is above a cap is shared again unless all are capped
    quotas = apportion(cells, "claim", (2 * goal + down * block) // (2 * down * block), ["source", "cell"])
    quotas = quotas.select(F.col("source").alias("_source"), F.col("cell").alias("_cell"), "cell_size", F.least(F.col("quota") * block, F.col("cell_size") * cap).alias("words"))
    both = dealt.join(quotas, F.col("source").eqNullSafe(F.col("_source")) & (F.col("cell") == F.col("_cell")), "left")
    upto = F.sum("size").over(Window.partitionBy("source", "cell").orderBy("drawn", "id", "seen").rowsBetween(Window.unboundedPreceding, 0))
    whole = F.floor(F.col("words") / F.col("cell_size"))
    rest = F.col("words") - whole * F.col("cell_size")
    inside = F.least(F.greatest(rest - upto + F.col("size"), F.lit(0)), F.col("size"))
    taken = F.coalesce(whole * F.col("size") + inside, F.lit(0)).cast("bigint")
    return both.select(F.col("id").alias(row_id), "seen", "size", "source_size", "target", taken.alias("taken"))


def take(df: DataFrame, row_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixed table, with the columns of ``df``: a row whose words are taken twice appears twice, one
    of which only a part is taken keeps its first words. Other rows go."""
    own = mix(df, row_id, text, source, **options).filter("taken > 0")
    marks = {c: fresh(df, f"mix_{c}") for c in ("id", "seen", "size", "taken", "rows", "pass")}
    shares = own.groupBy(F.col(row_id).alias(marks["id"]), F.col("seen").alias(marks["seen"]), F.col("size").alias(marks["size"]))
    shares = materialize(shares.agg(F.sum("taken").alias(marks["taken"]), F.count("*").alias(marks["rows"])))
    seen = fresh(df, "seen")
    first = df.withColumn(seen, F.xxhash64(F.coalesce(column(df, text), F.lit(""))))
    if not shares.filter(F.col(marks["rows"]) > 1).isEmpty():  # equal rows are taken together
        first = first.dropDuplicates([row_id, seen])
    joined = first.join(shares, column(df, row_id).eqNullSafe(F.col(marks["id"])) & (F.col(seen) == F.col(marks["seen"])))
    size, taken, turn = (F.col(marks[c]) for c in ("size", "taken", "pass"))
    copies = joined.withColumn(marks["pass"], F.explode(F.sequence(F.lit(1).cast("bigint"), F.ceil(taken / size))))
    count = F.least(size, taken - (turn - 1) * size).cast("int")
    part = F.array_join(F.slice(words(column(df, text)), F.lit(1), count), " ")
    out = copies.withColumn(text, F.when(count < size, part).otherwise(column(df, text)))
    return out.select(*[column(out, c) for c in df.columns])
