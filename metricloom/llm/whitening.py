"""Whitening of embeddings with distributed block matrices.

1. Vectors become integers ``x = floor(scale * c) + offset``. Their count n and the sums S of the dimensions are exact.
2. Rows get an index without gaps, and the centred rows ``(n x - S) / n`` are filled into the blocks of a ``BlockMatrix``, 1,024 by 1,024 at most. (Blocks are
   filled in Arrow batches, because ``IndexedRowMatrix.toBlockMatrix`` ships every entry as a boxed pair.)
3. The scatter matrix is the transposed block matrix times itself, summed over splits of the rows, so that no task sees more than a few
   blocks of each. Only this matrix, of dimension x dimension, comes to the driver, for ``eigh``.
4. The block matrix times the whitening matrix (eigenvectors over the roots of the eigenvalues) projects all rows.

Cases: null vectors, and those with null or non-finite entries, take no part; neither do empty ones. Vectors must have one length to have a covariance: where
lengths differ, the most frequent one counts (the greater of equally frequent ones) and the others take no part. Repeated rows and ids, and null ids, are
rows like any other. Components without variance (eigenvalue at most 1e-12 of the largest) cannot be scaled to one and are not returned,
so a single vector, or copies of one, give no rows; neither does an empty table. A ``deviation`` beyond 64 bits is null. Other columns are not read,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.llm.common import column
from metricloom.session import materialize

SCALE, OFFSET = 1024, 100_000
#: Rows of a block, columns of a block, and blocks of rows that one partial product reads.
BLOCK_ROWS, BLOCK_COLUMNS, SPLIT_BLOCKS = 1024, 1024, 8
#: Share of the largest eigenvalue up to which a component counts as flat.
FLAT = 1e-12


@dataclass
class Whitening:
    """What was fitted: count, exact sums, eigenvalues (falling), their total, and unit eigenvectors as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    trace: float
    vectors: np.ndarray


def integers(vector: Column) -> Column:
    """Entries as integers; null for vectors that take no part."""
    wide = F.transform(vector, lambda c: c.cast("double"))
    sound = (F.size(vector) > 0) & F.forall(wide, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(math.inf)), F.lit(False)))
    return F.when(sound, F.transform(wide, lambda c: F.floor(c * SCALE) + OFFSET))


def _rows(df: DataFrame, row_id: str, vector: str) -> DataFrame:
    """``id, x, index`` of the rows that take part, the index running from 0 without gaps."""
    found = df.select(column(df, row_id).alias("id"), integers(column(df, vector)).alias("x")).filter("x IS NOT NULL")
    stored = materialize(found.withColumn("place", F.monotonically_increasing_id()))
    lengths = stored.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(2).collect()
    if len(lengths) > 1:
        stored = stored.filter(F.size("x") == lengths[0]["d"])
        stored = materialize(stored.withColumn("place", F.monotonically_increasing_id()))
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    counts = stored.groupBy(part.alias("part")).count()  # one row for each task that wrote
    starts = counts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("start"))
    return stored.withColumn("part", part).join(F.broadcast(starts), "part").select("id", "x", (F.col("start") + within).alias("index"))


def _centred(x: Column, n: int, sums: list[int]) -> Column:
    """``(n x - S) / n``, the difference in integers."""
    return F.zip_with(x, F.array(*map(F.lit, sums)), lambda a, s: (a * n - s) / n)


def _blocks(rows: DataFrame, vector: Column, n: int, d: int) -> BlockMatrix:
    """Vectors in the order of their index as a block matrix. Tasks fill whole blocks, which are stored, so that no product builds them again."""
    tall, wide = BLOCK_ROWS, BLOCK_COLUMNS
    schema = T.StructType([T.StructField("place", T.StructType([T.StructField(c, T.LongType(), False) for c in ("_1", "_2")]), False), T.StructField("matrix", MatrixUDT(), False)])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the block at hand
        own = None

        def out() -> Iterator[pa.RecordBatch]:
            block = np.concatenate(held)
            for at in range(0, d, wide):
                part = block[:, at : at + wide]
                matrix = {"type": 1, "numRows": len(part), "numCols": part.shape[1], "colPtrs": None, "rowIndices": None, "values": part.ravel(order="F"), "isTransposed": False}
                yield pa.RecordBatch.from_arrays([pa.array([{"_1": own, "_2": at // wide}], kinds.field(0).type), pa.array([matrix], kinds.field(1).type)], schema=kinds)

        kinds = pa.schema([
            ("place", pa.struct([pa.field("_1", pa.int64(), False), pa.field("_2", pa.int64(), False)])),
            ("matrix", pa.struct([
                pa.field("type", pa.int8(), False), pa.field("numRows", pa.int32(), False), pa.field("numCols", pa.int32(), False), ("colPtrs", pa.list_(pa.int32())),
                ("rowIndices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64())), pa.field("isTransposed", pa.bool_(), False),
            ])),
        ])
        for batch in batches:
            block = batch.column("block").to_numpy()
            data = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(block), d)
            starts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
            for a, b in zip(starts, [*starts[1:], len(block)]):
                if held and block[a] != own:
                    yield from out()
                    held = []
                own = int(block[a])
                held.append(data[a:b])
        if held:
            yield from out()

    block = F.floor(F.col("index") / tall).cast("int").alias("block")
    ordered = rows.select(block, "index", vector.alias("vector")).repartition("block").sortWithinPartitions("index")
    stored = materialize(ordered.select("block", "vector").mapInArrow(fill, schema))
    return BlockMatrix(callMLlibFunc("createBlockMatrix", stored, tall, wide, n, d), tall, wide)


def _scatter(matrix: BlockMatrix) -> np.ndarray:
    """Transposed times itself; the rows are split so that partial products run in many tasks."""
    splits = max(1, math.ceil(matrix.numRowBlocks / SPLIT_BLOCKS))
    flipped = matrix.transpose()._java_matrix_wrapper
    product = flipped.call("multiply", matrix._java_matrix_wrapper._java_model, splits)  # multiply() itself has no splits
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def fit(rows: DataFrame) -> tuple[Whitening, BlockMatrix] | None:
    """The whitening of ``index, x``, and the centred rows as blocks; none without rows."""
    d = rows.select(F.size("x")).first()
    if d is None:
        return None
    d = d[0]
    # dimensions are entries of one row of aggregates
    total = rows.agg(F.count("*"), *[F.sum(F.col("x")[k]) for k in range(d)]).first()
    n, sums = total[0], list(total[1:])
    blocks = _blocks(rows, _centred(F.col("x"), n, sums), n, d)
    values, vectors = np.linalg.eigh(_scatter(blocks) / n)
    order = np.argsort(-values, kind="stable")
    values = values[order]
    return Whitening(n, sums, values, float(values.sum()), vectors[:, order]), blocks


def _project(spark: SparkSession, blocks: BlockMatrix, weights: np.ndarray) -> DataFrame:
    """``index, white``: every row times the weights."""
    d, k = weights.shape
    parts = [weights[at : at + BLOCK_COLUMNS] for at in range(0, d, BLOCK_COLUMNS)]
    held = [((i, 0), Matrices.dense(len(part), k, part.ravel(order="F"))) for i, part in enumerate(parts)]
    local = BlockMatrix(spark.sparkContext.parallelize(held, 1), BLOCK_COLUMNS, k, d, k)
    product = blocks.multiply(local).toIndexedRowMatrix()
    rows = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)  # what ``rows`` reads, left in the JVM
    return rows.select("index", vector_to_array("vector").alias("white"))


def whiten(df: DataFrame, row_id: str = "vec_id", vector: str = "embedding", *, components: int = 8) -> DataFrame:
    """``row_id, n, deviation, white, explained, identity_error``: for each row that takes part, its exact squared distance from the mean (times n squared), and
    its coordinates on the first ``components`` components, scaled to variance one; for all rows, the shares of variance of
    these, and the largest difference of the covariance of ``white`` from the identity."""
    rows = materialize(_rows(df, row_id, vector))
    kind = df.schema[row_id].dataType.simpleString()
    fitted = fit(rows)
    k = 0
    if fitted:
        model, blocks = fitted
        k = int(min(components, (model.values > max(FLAT * model.values[0], 0.0)).sum()))
    if not k:
        return rows.limit(0).selectExpr(f"CAST(id AS {kind}) AS `{row_id}`", "0L AS n", "0L AS deviation", "array(0D) AS white", "array(0D) AS explained", "0D AS identity_error")
    white = materialize(_project(df.sparkSession, blocks, model.vectors[:, :k] / np.sqrt(model.values[:k])))
    error = _identity_error(white, k)
    exact = F.zip_with("x", F.array(*map(F.lit, model.sums)), lambda a, s: (a * model.n - s).cast("decimal(19,0)"))
    squares = F.aggregate(exact, F.lit(0).cast("decimal(38,0)"), lambda t, e: (t + (e * e).cast("decimal(38,0)")).cast("decimal(38,0)"))
    return rows.join(white, "index").select(
        F.col("id").alias(row_id), F.lit(model.n).cast("bigint").alias("n"), squares.try_cast("bigint").alias("deviation"), "white",
        F.array(*[F.lit(float(v / model.trace)) for v in model.values[:k]]).alias("explained"), F.lit(error).alias("identity_error"),
    )


def _identity_error(white: DataFrame, k: int) -> float:
    """Largest entry of the covariance of ``white``, centred before multiplying, minus the identity."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = white.agg(*[F.covar_pop(F.col("white")[i], F.col("white")[j]) for i, j in pairs]).first()
    return max(abs(value - (i == j)) for value, (i, j) in zip(found, pairs))


def by_component(white: DataFrame, row_id: str = "vec_id") -> DataFrame:
    """One row for each row and component, components numbered from 1."""
    each = F.posexplode(F.arrays_zip(F.col("white").alias("w"), F.col("explained").alias("e")))
    long = white.select(row_id, "n", "deviation", "identity_error", each)
    return long.select(row_id, (F.col("pos") + 1).alias("component"), "n", "deviation", F.col("col.w").alias("whitened"), F.col("col.e").alias("explained"), "identity_error")
