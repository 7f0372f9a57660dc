"""Document fingerprints from prefix polynomial hashes.

``Prefixes`` keeps, for one text, the prefix sums of its code points times powers of a base, modulo two primes. Any span's
hash is then one subtraction, two spans are compared in constant time, and the longest common
extension of two places is found by binary search over lengths.

The fingerprint of a text is the set of its ``KEPT`` smallest span hashes, spans of 20 code points at every place (of fewer in
texts of less than 80), mixed to 32 bits. The likeness of two texts is the share of the
smallest hashes of their union that both hold, an estimate of the share of spans in common. Both are read at the span length of
the shorter text: where that is not the longer one's own, the longer text is sketched again at it, so texts on either side of a limit compare like any others.

Each text is also set against an edit of itself: its last third replaced by the first code points of the next document.
Documents are ranged by descending id (null last, ties by a hash of the text), every partition is walked in order,
and the last row of each is joined with the first row of the following one.

Cases: a null text counts as empty, with an empty fingerprint; two empty ones are alike (1.0), an empty one is unlike any other (0.0).
A single document is followed by itself. Repeated rows follow one another. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.common import column

#: Length of a span by the least length of its text: short texts would have too few long spans to compare.
SPANS = ((80, 20), (16, 4), (0, 1))
KEPT = 64
#: Two primes below 2**31 and a base for each. Fixed values.
FIELDS = ((2147483647, 1103515245), (2147483629, 1812433253))


class Powers:
    """Powers of the bases and of their inverses, grown on demand."""

    def __init__(self):
        self.tables = [[np.ones(1, np.uint64), np.ones(1, np.uint64)] for _ in FIELDS]

    def upto(self, n: int) -> list[list[np.ndarray]]:
        for tables, (prime, base) in zip(self.tables, FIELDS):
            for k, b in enumerate((base, pow(base, -1, prime))):
                while len(tables[k]) < n:
                    have = tables[k]
                    tables[k] = np.concatenate((have, have * np.uint64(pow(b, len(have), prime)) % np.uint64(prime)))
        return self.tables


class Prefixes:
    """Modular prefix arrays of one sequence of code points."""

    def __init__(self, points: np.ndarray, powers: Powers):
        self.n = len(points)
        self.tables = powers.upto(self.n + 1)
        self.sums = []
        for (prime, _), (up, _) in zip(FIELDS, self.tables):
            total = np.zeros(self.n + 1, np.uint64)
            np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: self.n] % np.uint64(prime), out=total[1:])
            self.sums.append(total % np.uint64(prime))

    def spans(self, start: np.ndarray, length: int) -> np.ndarray:
        """62-bit hashes of the spans of ``length`` at the given places."""
        out = np.zeros(len(start), np.uint64)
        for (prime, _), (_, down), total in zip(FIELDS, self.tables, self.sums):
            p = np.uint64(prime)
            out = out << np.uint64(31) | (total[start + length] + p - total[start]) % p * down[start] % p
        return out

    def equal(self, i: int, other: Prefixes, j: int, length: int) -> bool:
        return self.spans(np.array([i]), length)[0] == other.spans(np.array([j]), length)[0]

    def common(self, i: int, other: Prefixes, j: int) -> int:
        """Length of the longest common extension of place ``i`` here and place ``j`` in ``other``."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            if self.equal(i, other, j, mid):
                low = mid
            else:
                high = mid - 1
        return low


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def span_length(n: int) -> int:
    return next(span for least, span in SPANS if n >= least)


def sketch(of: Prefixes, length: int | None = None) -> np.ndarray:
    """The smallest mixed hashes of spans of ``length``, by default the text's own, ascending."""
    if not of.n:
        return np.zeros(0, np.uint32)
    length = length or span_length(of.n)
    x = of.spans(np.arange(of.n - length + 1), length)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    low = (x >> np.uint64(32)).astype(np.uint32)
    if len(low) > 4 * KEPT:  # twice as many as are kept, for repeats; all of them where that is too few
        few = np.unique(np.partition(low, 2 * KEPT)[: 2 * KEPT])
        if len(few) >= KEPT:
            return few[:KEPT]
    return np.unique(low)[:KEPT]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:KEPT]
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def alike(a: Prefixes, sketch_a: np.ndarray, b: Prefixes, sketch_b: np.ndarray) -> float:
    """Likeness at the span length of the shorter text."""
    length = span_length(min(a.n, b.n))
    if a.n and b.n:
        sketch_a, sketch_b = (s if span_length(p.n) == length else sketch(p, length) for p, s in ((a, sketch_a), (b, sketch_b)))
    return likeness(sketch_a, sketch_b)


def _hex(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


FOUND = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, prefix_edited bigint, prefix_next bigint"


class _Walk:
    """Fingerprints of texts against their edits and the texts that follow."""

    def __init__(self):
        self.powers = Powers()

    def of(self, text: str) -> tuple[str, Prefixes, np.ndarray]:
        p = Prefixes(code_points(text), self.powers)
        return text, p, sketch(p)

    def row(self, own: tuple, following: tuple) -> tuple:
        text, prefixes, s = own
        third = len(text) // 3
        edited, e, t = self.of(text[: len(text) - third] + following[0][:third])
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return (len(text), digest, _hex(s), _hex(t), alike(prefixes, s, e, t), alike(prefixes, s, following[1], following[2]), prefixes.common(0, e, 0), prefixes.common(0, following[1], 0))


def _rows(ids: list, rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in FOUND.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array(c, t) for c, t in zip(columns, types))], ["id", *names])


#: Rows given back at once.
GIVEN = 1000


def _inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row of a partition but the last, against the next one."""
    walk, held = _Walk(), None
    for batch in batches:
        ids, rows = [], []
        for row_id, text in zip(batch.column("id"), batch.column("text")):
            now = walk.of(text.as_py())
            if held is not None:
                ids.append(held[0])
                rows.append(walk.row(held[1], now))
                if len(ids) == GIVEN:
                    yield _rows(ids, rows, batch.schema.field("id").type)
                    ids, rows = [], []
            held = (row_id.as_py(), now)
        yield _rows(ids, rows, batch.schema.field("id").type)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that come with the text of the following one."""
    walk = _Walk()
    for batch in batches:
        rows = [walk.row(walk.of(a.as_py()), walk.of(b.as_py())) for a, b in zip(batch.column("text"), batch.column("following"))]
        yield _rows(batch.column("id").to_pylist(), rows, batch.schema.field("id").type)


def fingerprints(df: DataFrame, row_id: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """``row_id`` and the columns of ``FOUND`` for every row."""
    count = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = F.coalesce(column(df, text), F.lit(""))
    own = df.select(column(df, row_id).alias("id"), whole.alias("text"), F.xxhash64(whole).alias("seen"))
    order = [F.col("id").desc_nulls_last(), F.col("seen")]
    ranged = own.repartitionByRange(count, *order).sortWithinPartitions(*order)
    schema = f"id {own.schema['id'].dataType.simpleString()}, {FOUND}"
    inner = ranged.mapInArrow(_inner, schema)
    placed = ranged.withColumn("at", F.monotonically_increasing_id())  # the partition in the high bits
    edges = placed.groupBy(F.shiftright("at", 33).alias("part")).agg(F.min_by("text", "at").alias("first"), F.max_by(F.struct("id", "text"), "at").alias("last"))
    everywhere = Window.orderBy("part")  # a row for each partition
    nexts = edges.select("part", F.coalesce(F.lead("part").over(everywhere), F.min("part").over(Window.partitionBy(F.lit(0)))).alias("next"))
    firsts = edges.select(F.col("part").alias("next"), F.col("first").alias("following"))
    ends = edges.select("part", "last.id", "last.text").join(nexts, "part").join(firsts, "next")
    outer = ends.select("id", "text", "following").mapInArrow(_pairs, schema)
    return inner.unionByName(outer).withColumnRenamed("id", row_id)
