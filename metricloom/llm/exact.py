"""Exact duplicates by Grace hash partitioning: records are dealt to spill files by hash, again and again, until each bucket fits
an open-addressing table that compares complete contents.

1. Each task folds its rows through a table of bounded size. What leaves it is one record for each different text in the table (text,
   count, largest id) and one slim row for each document that names its record. A text that fills a third of the corpus
   so becomes one record for each full table, and its rows never meet on one key.
2. Records are dealt to buckets by bits of their hash, as many as make the mean bucket half a table. A hash whose records alone
   would overflow a table is dealt to several buckets by its record numbers, too.
3. A task reads its buckets one after the other, each into a fresh table. Buckets that fit are settled. Where a table
   overflows, or the bucket is a share of a hot hash, the bucket's folded records go to the next round, with other bits.
4. Rounds end when no record is left; then the rows look up their records.

Equal means equal after lower-casing A-Z, byte by byte in UTF-8; a hash only chooses the slot.

Cases: a null text counts as empty, so null, empty and other empty texts are one group. Of equal texts the row of the largest id stays, a null id
counting as smallest; of rows equal in id and text one stays. An empty table gives no rows. Texts of any length are compared whole; a text that is larger
than a table has a table of its own. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import column, fresh
from metricloom.session import materialize

#: Bytes that one table may hold, each record counting as its text and RECORD_BYTES, and rows that one table may fold.
TABLE_BYTES = 16 << 20
RECORD_BYTES = 200
TABLE_ROWS = 1 << 16
#: Bytes of text given back at once, bytes of records for one shuffle partition, and hot hashes that may be broadcast (16 bytes each).
GIVEN_BYTES = 4 << 20
PARTITION_BYTES = 64 << 20
HOT_BOUND = 1 << 16


class Table:
    """Open addressing with linear probing; the slot comes from a hash, equality from the complete text."""

    def __init__(self) -> None:
        self.slots, self.mask = [-1] * 1024, 1023
        self.hashes: list[int] = []
        self.texts: list[bytes] = []
        self.counts: list[int] = []
        self.tops: list[tuple] = []
        self.bytes = 0
        self.rows = 0

    def place(self, hashed: int, text: bytes) -> int:
        """The place of the text, entered if it is new."""
        slot = hashed & self.mask
        while (at := self.slots[slot]) >= 0:
            if self.hashes[at] == hashed and self.texts[at] == text:
                return at
            slot = (slot + 1) & self.mask
        self.slots[slot] = at = len(self.texts)
        self.hashes.append(hashed)
        self.texts.append(text)
        self.counts.append(0)
        self.tops.append(())
        self.bytes += len(text) + RECORD_BYTES
        if 2 * len(self.texts) > self.mask:
            self._grow()
        return at

    def count(self, at: int, n: int, top: tuple) -> None:
        """Add ``n`` rows; ``top`` is (id is given, id, node, index) of the row that would stay."""
        self.counts[at] += n
        self.tops[at] = max(self.tops[at], top) if self.tops[at] else top
        self.rows += 1

    @property
    def full(self) -> bool:
        """A single text never fills a table by its size alone."""
        return self.bytes >= TABLE_BYTES and len(self.texts) > 1 or self.rows >= TABLE_ROWS

    def _grow(self) -> None:
        self.mask = 2 * self.mask + 1
        self.slots = [-1] * (self.mask + 1)
        for at, hashed in enumerate(self.hashes):
            slot = hashed & self.mask
            while self.slots[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.slots[slot] = at


def _top(id_: object, node: int, index: int) -> tuple:
    return (id_ is not None, id_ if id_ is not None else 0, node, index)


def _records(table: Table, base: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The records of a table, numbered from ``base``, in batches of bounded size."""
    held: list[tuple] = []
    size = 0
    for at, text in enumerate(table.texts):
        given, id_, node, index = table.tops[at]
        held.append((base + at, table.hashes[at] - (1 << 63), text, table.counts[at], id_ if given else None, node, index, len(text) + RECORD_BYTES))
        size += len(text)
        if size >= GIVEN_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    yield _batch(held, schema)


RECORD = ["node", "hash", "text", "n", "top", "top_node", "top_index", "bytes"]


def _batch(rows: list[tuple], schema: pa.Schema, names: list[str] = RECORD) -> pa.RecordBatch:
    columns = dict(zip(names, zip(*rows))) if rows else {}
    empty = [None] * len(rows)
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, empty), f.type) for f in schema], schema=schema)


def _fold(id_type: str):
    """Rows ``id, text`` to slim rows ``id, node, index`` and the records they name."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, base, schema = Table(), TaskContext.get().partitionId() << 40, None
        for batch in batches:
            schema = schema or pa.schema([
                ("id", batch.schema.field("id").type), ("index", pa.int32()), ("node", pa.int64()), ("hash", pa.int64()), ("text", pa.binary()), ("n", pa.int64()),
                ("top", batch.schema.field("id").type), ("top_node", pa.int64()), ("top_index", pa.int32()), ("bytes", pa.int64()),
            ])
            slim = []
            for id_, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                lowered = text.as_buffer().to_pybytes().lower() if text.is_valid else b""
                at = table.place(xxhash.xxh64_intdigest(lowered), lowered)
                slim.append((id_, table.rows, base + at))
                table.count(at, 1, _top(id_, base + at, table.rows))
                if table.full:
                    yield from _records(table, base, schema)
                    base, table = base + len(table.texts), Table()
            yield _batch(slim, schema, ["id", "index", "node"])
        if table.rows:
            yield from _records(table, base, schema)

    columns = f"id {id_type}, index int, node bigint, hash bigint, text binary, n bigint, top {id_type}, top_node bigint, top_index int, bytes bigint"
    return fold, columns


def _settle(id_type: str, round_: int):
    """Records of a bucket, in one run, to ``node`` with what its group came to, or with the ``parent`` record that goes to the next round."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, schema = (round_ << 56) + (TaskContext.get().partitionId() << 32), None
        bucket, table, places, split = None, Table(), [], False

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            """What the table holds; a bucket that is whole and not shared is settled."""
            nonlocal base, table, places
            if last and not split:
                shas = [hashlib.sha256(text).hexdigest() for text in table.texts]
                done = []
                for node, at in places:
                    given, id_, top_node, index = table.tops[at]
                    done.append((node, table.counts[at], id_ if given else None, top_node, index, shas[at]))
                yield _batch(done, schema, ["child", "n", "top", "top_node", "top_index", "sha"])
            else:
                yield _batch([(node, base + at) for node, at in places], schema, ["child", "node"])
                yield from _records(table, base, schema)
                base += len(table.texts)
            table, places = Table(), []

        for batch in batches:
            top = batch.schema.field("top").type
            schema = schema or pa.schema([
                ("child", pa.int64()), ("node", pa.int64()), ("hash", pa.int64()), ("text", pa.binary()), ("n", pa.int64()), ("top", top),
                ("top_node", pa.int64()), ("top_index", pa.int32()), ("bytes", pa.int64()), ("sha", pa.string()),
            ])
            plain = [batch.column(c).to_pylist() for c in ("bucket", "shared", "node", "hash", "n", "top", "top_node", "top_index")]
            for own, shared, node, hashed, n, id_, top_node, index, text in zip(*plain, batch.column("text")):
                if own != bucket:
                    if places:
                        yield from out(last=True)
                    bucket, split = own, shared
                elif table.full:
                    split = True
                    yield from out(last=False)
                at = table.place(hashed + (1 << 63), text.as_buffer().to_pybytes())
                table.count(at, n, _top(id_, top_node, index))
                places.append((node, at))
        if places:
            yield from out(last=True)

    columns = f"child bigint, node bigint, hash bigint, text binary, n bigint, top {id_type}, top_node bigint, top_index int, bytes bigint, sha string"
    return settle, columns


def _dealt(records: DataFrame, round_: int) -> DataFrame:
    """Records in runs of ``bucket``; ``shared`` says that other buckets hold records of the same hash."""
    spark = records.sparkSession
    total = records.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(1, math.ceil(2 * total / TABLE_BYTES))
    sized = records.groupBy("hash").agg(F.sum("bytes").alias("size"), F.count("*").alias("n"))
    shares = F.least(F.ceil(F.col("size") / (TABLE_BYTES / 4)), F.floor(F.col("n") / 2)).alias("shares")  # at least half of the records go
    hot = materialize(sized.filter(F.col("size") > TABLE_BYTES / 2).select("hash", shares).filter("shares > 1"))
    own = F.pmod(F.xxhash64("hash", F.lit(round_)), F.lit(buckets))
    few = hot.count()
    if few:
        records = records.join(F.broadcast(hot) if few <= HOT_BOUND else hot, "hash", "left")
        share = F.pmod(F.xxhash64("node"), F.col("shares"))
        records = records.withColumn("shared", F.col("shares").isNotNull())
        records = records.withColumn("bucket", F.when(F.col("shared"), F.xxhash64("hash", share)).otherwise(own)).drop("shares")
    else:
        records = records.withColumn("shared", F.lit(False)).withColumn("bucket", own)
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / PARTITION_BYTES))
    return records.repartition(files, "bucket").sortWithinPartitions("bucket")


def groups(df: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row_id, keep_id, group_size, kept, text_sha256`` for every row of ``df``."""
    id_type = df.schema[row_id].dataType.simpleString()
    fold, columns = _fold(id_type)
    stored = materialize(df.select(column(df, row_id).alias("id"), column(df, text).cast("binary").alias("text")).mapInArrow(fold, columns))
    records, parents, settled = stored.filter("n IS NOT NULL").select(*RECORD), [], []
    while not records.isEmpty():
        round_ = len(settled) + 1
        settle, columns = _settle(id_type, round_)
        found = materialize(_dealt(records, round_).mapInArrow(settle, columns))
        settled.append(found.filter("sha IS NOT NULL").select(F.col("child").alias("node"), "n", "top", "top_node", "top_index", "sha"))
        parents.append(found.filter("child IS NOT NULL AND sha IS NULL").select("child", "node"))
        records = found.filter("child IS NULL").select(*RECORD)
    known = settled.pop() if settled else stored.limit(0).select("node", "n", "top", "top_node", "top_index", F.lit(None).cast("string").alias("sha"))
    while settled:  # from the last round to the first
        parents.pop()
        later = parents[-1].join(known, "node").drop("node").withColumnRenamed("child", "node")
        known = settled.pop().unionByName(later)
    rows = stored.filter("n IS NULL").select("id", "node", "index").join(known, "node")
    kept = (F.col("node") == F.col("top_node")) & (F.col("index") == F.col("top_index"))
    return rows.select(F.col("id").alias(row_id), F.col("top").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))


def normalised(text: Column) -> Column:
    """The text as it is compared."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(text, F.lit("")), upper, upper.lower())


def keep_one(df: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of equal texts, with the columns of ``df``."""
    found = materialize(groups(df, row_id, text).filter("kept").select(F.col(row_id).alias("_id"), F.col("text_sha256").alias("_sha")))
    mark = fresh(df, "sha")
    own = df.withColumn(mark, F.sha2(normalised(column(df, text)), 256))
    match = column(own, row_id).eqNullSafe(F.col("_id")) & (column(own, mark) == F.col("_sha"))
    left = own.join(found, match, "left_semi")
    names = df.select(column(df, row_id)).columns + [mark]
    repeated = left.groupBy(column(left, row_id), column(left, mark)).count().filter("count > 1").isEmpty()
    return (left if repeated else left.dropDuplicates(names)).drop(mark)
