"""Nearest neighbours by largest inner product, from a hash-prefix forest.

Each tree of the forest hashes a vector to a string of sign bits of random projections and
keeps the strings as one sorted array. A query descends every tree to the longest prefix that it shares with
any row, then climbs all trees in step: at each shorter prefix length the range of
rows that share it grows, until ``share`` of the rows have been met. Those candidates are scored with the
exact inner product in double precision.

Rows are dealt into blocks of about ``block_rows`` by a hash, each with a forest of its own, and
every query block visits every row block, so that a task holds one block of each; a
query's best of each block are merged at the end. For inner products the rows of a block are first lifted by one coordinate
to equal length, which turns the largest product into the smallest angle; rows are centred for hashing only.

The target of candidates is a share of the rows, not a count, because the recall of a fixed count falls as
rows grow. On vectors without structure, such as points spread evenly over a sphere, a
recall of 0.9 needs about half of the rows.

Cases: vectors that are null, all zero, or hold a null or a non-finite component take no part, nor do rows with a null id.
Vectors of another length than the most frequent one take no part. Repeated rows are
candidates of their own, but one query; a query never meets rows of its own id. Ties go to the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.common import column
from metricloom.session import materialize

#: Queries that one task answers at a time.
QUERY_ROWS = 1024


def usable(vector: Column) -> Column:
    """True for vectors that take part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _lift(rows: np.ndarray) -> tuple[np.ndarray, float]:
    """Rows of equal length, by one more coordinate."""
    square = (rows * rows).sum(axis=1)
    top = float(square.max())
    return np.hstack((rows, np.sqrt(np.maximum(top - square, 0))[:, None])), top


def _strings(points: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Bit strings as unsigned integers, first bit highest."""
    bits = planes.shape[1]
    weight = np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64)
    return ((points @ planes) > 0).astype(np.uint64) @ weight


class Forest:
    """Sorted bit strings of one block of rows."""

    def __init__(self, rows: np.ndarray, trees: int, bits: int, seed: int):
        self.bits = bits
        lifted, _ = _lift(rows)
        self.centre = lifted.mean(axis=0)
        rng = np.random.default_rng(seed)
        self.planes = [rng.standard_normal((lifted.shape[1], bits)) for _ in range(trees)]
        self.trees = []
        for planes in self.planes:
            strings = _strings(lifted - self.centre, planes)
            order = np.argsort(strings, kind="stable")
            self.trees.append((strings[order], order))
        self.n = len(rows)
        self.scale = float(np.sqrt((lifted * lifted).sum(axis=1).max()))

    def candidates(self, queries: np.ndarray, wanted: int) -> np.ndarray:
        """A row of flags over the block for each query."""
        length = np.sqrt((queries * queries).sum(axis=1, keepdims=True))
        points = np.hstack((queries / length * self.scale, np.zeros((len(queries), 1)))) - self.centre
        asked = [_strings(points, planes) for planes in self.planes]
        met = np.zeros((len(queries), self.n), bool)
        open_ = np.arange(len(queries))
        ranges = [(np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)) for _ in self.trees]
        for length in range(self.bits, -1, -1):
            drop = np.uint64(self.bits - length)
            for (strings, order), q, (lo, hi) in zip(self.trees, asked, ranges):
                first = (q[open_] >> drop) << drop
                a = np.searchsorted(strings, first, "left")
                b = np.searchsorted(strings, first | ((np.uint64(1) << drop) - np.uint64(1)), "right")
                grown = (b - a) > (hi[open_] - lo[open_])
                for k in np.flatnonzero(grown):
                    i, x, y = open_[k], a[k], b[k]
                    if hi[i] > lo[i]:
                        met[i, order[x : lo[i]]] = True
                        met[i, order[hi[i] : y]] = True
                    else:
                        met[i, order[x:y]] = True
                lo[open_], hi[open_] = a, b
            open_ = open_[met[open_].sum(axis=1) < wanted]
            if not len(open_):
                break
        return met


def _products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed component by component, as a plain sum over the list would be."""
    total = np.zeros(len(rows))
    for k in range(rows.shape[1]):
        total += rows[:, k] * query[k]
    return total


def _best(asked: pd.DataFrame, held: pd.DataFrame, top: int, share: float, trees: int, bits: int, seed: int) -> pd.DataFrame:
    queries, rows = np.array(asked["vector"].tolist(), float), np.array(held["vector"].tolist(), float)
    ids, own = held["id"].to_numpy(), asked["id"].to_numpy()
    wanted = min(len(rows), max(int(np.ceil(share * len(rows))), 4 * top))
    forest = Forest(rows, trees, bits, seed)
    out = []
    for at in range(0, len(queries), QUERY_ROWS):
        some = queries[at : at + QUERY_ROWS]
        met = forest.candidates(some, wanted)
        rough = some @ rows.T
        for k in range(len(some)):
            near = np.flatnonzero(met[k] & (ids != own[at + k]))
            if not len(near):
                continue
            if len(near) > top:  # every row whose rough product reaches the top-th, a rounding margin included
                score = rough[k, near]
                near = near[score >= np.partition(score, len(score) - top)[len(score) - top] - 1e-9 * max(1.0, abs(score).max())]
            score = _products(rows[near], some[k])
            pick = np.lexsort((ids[near], -score))[:top]
            out.append(pd.DataFrame({"query_row": asked["row"].iloc[at + k], "query_id": own[at + k], "vec_id": ids[near][pick], "score": score[pick]}))
    return pd.concat(out) if out else pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []})


def nearest(
    df: DataFrame,
    is_query: Column,
    row_id: str = "vec_id",
    vector: str = "embedding",
    *,
    top: int = 20,
    share: float = 0.6,
    trees: int = 48,
    bits: int = 32,
    block_rows: int = 8000,
    query_block_rows: int = 4000,
    seed: int = 11,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``top`` rows of largest inner product found for each row where ``is_query`` holds."""
    whole = df.select(column(df, row_id).cast("bigint").alias("id"), column(df, vector).cast("array<double>").alias("vector"), is_query.alias("asks"))
    rows = materialize(whole.filter(F.col("id").isNotNull() & usable(F.col("vector"))))
    sizes = rows.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n"), F.count_if("asks").alias("asking"))
    most = sizes.orderBy(F.desc("n"), "width").first()
    if most is None:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.filter(F.size("vector") == most["width"])
    blocks = -(-most["n"] // block_rows)
    asking = max(1, -(-most["asking"] // query_block_rows))
    row = F.xxhash64("id", "vector")
    held = rows.select("id", "vector", F.pmod(row, F.lit(blocks)).cast("bigint").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(asking - 1))).alias("part"))
    asked = rows.filter("asks").withColumn("row", row).dropDuplicates(["row"])  # a repeated query row is one query
    asked = asked.select("id", "vector", "row", F.pmod(F.xxhash64("row"), F.lit(asking)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"))

    def visit(key: tuple, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        return _best(queries, block, top, share, trees, bits, seed)

    schema = "query_row bigint, query_id bigint, vec_id bigint, score double"
    met = asked.groupBy("block", "part").cogroup(held.groupBy("block", "part")).applyInPandas(
        lambda key, q, h: visit(key, q, h) if len(q) and len(h) else pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []}), schema)
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
