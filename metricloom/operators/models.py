"""Variable importance from a forest and clusters, both with the right to refuse."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.functions import numbers
from metricloom.operators.common import METRIC_SCHEMA, Outcome, refusals
from metricloom.operators.profile import _quoted, _types

SEEDS = (0, 7, 13, 21, 42)
TREES = 200
DEPTH = 5
MIN_ROWS = 40
MIN_PER_FEATURE = 10
MIN_R2 = 0.1
HOLDOUT = 4  # one row in four
TOP_FEATURES = 8
CLUSTERS = (2, 3, 4, 5, 6)
MIN_SILHOUETTE = 0.25
MIN_GAP = 0.08
MIN_CLUSTER_ROWS = 5
DRAWN_ROWS = 1000  # of a cluster, to measure distances to it
SCORED_ROWS = 1024  # at a time
TASK_ROWS = 20_000  # of a forest: every row is followed through all its trees


class ModelError(ValueError):
    """A model that cannot be set up as asked."""


def _slug(text: str) -> str:
    return "".join(c if c.isalnum() or c in "_-" else "_" for c in text)[:40]


def _metrics(df: DataFrame, rows: list[tuple]) -> DataFrame:
    full = [(key, measure, stat, None, grp, round(float(value), 4), unit, source) for key, measure, stat, grp, value, unit, source in rows]
    return df.sparkSession.createDataFrame(full, METRIC_SCHEMA)


def _complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ModelError(f"no column {missing}")
    kinds = _types(df)
    return df.select(*[numbers.numeric(_quoted(c), kinds[c]).alias(f"x{i}") for i, c in enumerate(columns)]).dropna()


def _dealt(df: DataFrame, rows: int) -> DataFrame:
    """Rows in enough partitions for their number: a small file is one partition however many rows it holds."""
    parts = min(-(-rows // TASK_ROWS), 4 * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(parts) if parts > df.rdd.getNumPartitions() else df


def measure_importance(df: DataFrame, outcome: str, features: Sequence[str], *, trees: int = TREES, depth: int = DEPTH) -> Outcome:
    """Which features help to guess the outcome, from five forests with different seeds.

    Refused when the data are thin, when the held-out fit is poor, or when the first
    three places change with the seed. Rows are held out by a hash of their values, so
    the split does not depend on partitioning.
    """
    wanted = [f for f in features if f != outcome]
    if not wanted:
        raise ModelError("at least one feature other than the outcome is needed")
    data = _complete(df, [*wanted, outcome])
    names = [f"x{i}" for i in range(len(wanted))]
    label = f"x{len(wanted)}"
    seen = data.agg(F.count("*").alias("n"), F.min(label).alias("lo"), F.max(label).alias("hi")).first()
    spark = df.sparkSession

    def refuse(reason: str, got=None, need=None) -> Outcome:
        return Outcome(_metrics(df, []), refusals(spark, [("measure_importance", outcome, reason, got, need)]))

    need = max(MIN_ROWS, MIN_PER_FEATURE * len(wanted))
    if seen["n"] < need:
        return refuse("too few usable rows", seen["n"], need)
    if seen["lo"] == seen["hi"]:
        return refuse("the outcome does not vary", 1, 2)
    points = VectorAssembler(inputCols=names, outputCol="features").transform(_dealt(data, seen["n"])).cache()
    scores, orders, shares = [], [], [0.0] * len(wanted)
    evaluator = RegressionEvaluator(labelCol=label, metricName="r2")
    try:
        for seed in SEEDS:
            bucket = F.pmod(F.xxhash64(F.lit(seed), *data.columns), F.lit(HOLDOUT))
            forest = RandomForestRegressor(labelCol=label, numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", seed=seed)
            model = forest.fit(points.filter(bucket != 0))
            scores.append(evaluator.evaluate(model.transform(points.filter(bucket == 0))))
            weights = model.featureImportances.toArray()
            orders.append(tuple(sorted(range(len(wanted)), key=lambda i: -weights[i])[:3]))
            shares = [a + b / len(SEEDS) for a, b in zip(shares, weights)]
    finally:
        points.unpersist()
    fit = sum(scores) / len(scores)
    if fit < MIN_R2:
        return refuse("the forest does not explain rows it has not seen", fit, MIN_R2)
    if len(set(orders)) > 1:
        return refuse("the order of importance changes with the seed", len(set(orders)), 1)
    rows = [
        (f"{_slug(outcome)}.model.r2_holdout", outcome, "r2_holdout", None, fit, "", "importance"),
        (f"{_slug(outcome)}.model.rows", outcome, "rows", None, seen["n"], "row", "importance"),
    ]
    for i in sorted(range(len(wanted)), key=lambda i: -shares[i])[:TOP_FEATURES]:
        rows.append((f"{_slug(outcome)}.importance.{_slug(wanted[i])}", outcome, "importance", wanted[i], 100.0 * shares[i], "%", "importance"))
    note = [("measure_importance", outcome, "importance measures association: changing a feature need not change the outcome", None, None)]
    return Outcome(_metrics(df, rows), refusals(spark, note))


def _scores(points: np.ndarray, own: np.ndarray, drawn: Sequence[np.ndarray], sizes: Sequence[int]) -> np.ndarray:
    """Silhouette of each row against the rows drawn from every cluster."""
    square = (points**2).sum(1)[:, None]
    total = np.empty((len(points), len(sizes)))
    for c, rows in enumerate(drawn):
        apart = np.sqrt(np.maximum(square + (rows**2).sum(1) - 2 * points @ rows.T, 0))
        total[:, c] = apart.sum(1) * (sizes[c] / len(rows))
    size = np.asarray(sizes, dtype=float)
    here = np.arange(len(points)), own
    inside = total[here] / np.maximum(size[own] - 1, 1)
    mean = total / size
    mean[here] = np.inf
    outside = mean.min(1)
    larger = np.maximum(inside, outside)
    return np.where((size[own] > 1) & (larger > 0), (outside - inside) / np.where(larger > 0, larger, 1), 0.0)


def silhouette(labelled: DataFrame, sizes: Sequence[int], drawn_rows: int = DRAWN_ROWS) -> float:
    """Mean silhouette of plain distances over all rows; ``prediction`` numbers the clusters of ``sizes``, at least two and none empty.

    A sum of distances to a cluster is taken over ``drawn_rows`` rows drawn from it on average and scaled up; a cluster of
    no more rows is taken whole, which is exact. With 1,000 rows the sum has a standard error of about three percent of the
    spread of the distances. A row alone in its cluster scores 0. The driver holds the drawn rows, whose number
    depends on the clusters and not on the table.
    """
    width = len(sizes)
    points = labelled.select(F.col("prediction").cast("int").alias("c"), vector_to_array("features").alias("p"))
    picked = points.sampleBy("c", {c: min(1.0, drawn_rows / n) for c, n in enumerate(sizes)}, seed=0).collect()
    drawn = [np.array([r["p"] for r in picked if r["c"] == c], dtype=float) for c in range(width)]

    def score(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SCORED_ROWS):
                part = batch.slice(at, SCORED_ROWS)
                own = part.column("c").to_numpy()
                rows = part.column("p").flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                found = _scores(rows, own, drawn, sizes)
                yield pa.RecordBatch.from_pydict({"s": [float(found.sum())], "n": [len(own)]})

    summed = points.mapInArrow(score, "s double, n bigint").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    return summed["s"] / summed["n"]


def _best_split(points: DataFrame, rows: int) -> tuple[tuple[float, int, object] | None, list[tuple[int, float]]]:
    best, tried = None, []
    for k in CLUSTERS:
        if k >= rows:
            continue
        model = KMeans(featuresCol="features", k=k, seed=0, maxIter=50).fit(points)
        labelled = model.transform(points)
        if model.summary.k < k or min(model.summary.clusterSizes) == 0:
            continue
        score = silhouette(labelled, model.summary.clusterSizes)
        tried.append((k, round(score, 4)))
        if best is None or score > best[0]:
            best = (score, k, model)
    return best, tried


def find_clusters(df: DataFrame, columns: Sequence[str]) -> Outcome:
    """Groups of rows in standardised columns, compared with structureless data of the same extent.

    Groups are found by squared distances and judged by the silhouette of plain ones (``silhouette``).
    """
    spark = df.sparkSession
    columns = list(columns)
    data = _complete(df, columns)
    subject = ", ".join(columns[:5])

    def refuse(reason: str, got=None, need=None) -> Outcome:
        return Outcome(_metrics(df, []), refusals(spark, [("find_clusters", subject, reason, got, need)]))

    if len(columns) < 2:
        return refuse("at least two numeric columns are needed", len(columns), 2)
    stats = data.agg(F.count("*").alias("n"), *[f(c).alias(f"{a}{c}") for c in data.columns for a, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    rows = stats["n"]
    if rows < MIN_ROWS:
        return refuse("too few rows", rows, MIN_ROWS)
    raw = VectorAssembler(inputCols=data.columns, outputCol="raw").transform(data)
    points = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(raw).transform(raw).cache()
    try:
        best, tried = _best_split(points, rows)
        if best is None:
            return refuse("no split was possible")
        quality, k, model = best
        values = vector_to_array("features")
        ends = points.agg(*[f(values[i]).alias(f"{a}{i}") for i in range(len(columns)) for a, f in (("l", F.min), ("h", F.max))]).first()
        noise = points.select(*[(F.rand(seed=i + 1) * (ends[f"h{i}"] - ends[f"l{i}"]) + ends[f"l{i}"]).alias(c) for i, c in enumerate(data.columns)])
        noise = VectorAssembler(inputCols=data.columns, outputCol="features").transform(noise).cache()
        reference, _ = _best_split(noise, rows)
        noise.unpersist()
        gap = quality - (reference[0] if reference else 0.0)
        if quality < MIN_SILHOUETTE:
            return refuse("every split is blurred: one cloud, not groups", quality, MIN_SILHOUETTE)
        if gap < MIN_GAP:
            return refuse("structureless data of the same shape split about as well", gap, MIN_GAP)
        sizes = model.transform(points).groupBy("prediction").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in data.columns]).orderBy("prediction").collect()  # at most six rows
    finally:
        points.unpersist()
    out = [
        ("cluster.count", "cluster", "count", None, k, "group", "cluster"),
        ("cluster.quality.silhouette", "cluster", "silhouette", None, quality, "", "cluster"),
        ("cluster.rows", "cluster", "rows", None, rows, "row", "cluster"),
    ]
    refused = [("find_clusters", subject, "splits tried: " + ", ".join(f"{a}: {b:.2f}" for a, b in tried), None, None)]
    for row in sizes:
        label = str(row["prediction"])
        out.append((f"cluster.{label}.size", "cluster", "size", label, row["n"], "row", "cluster"))
        out.append((f"cluster.{label}.share_pct", "cluster", "share_pct", label, 100.0 * row["n"] / rows, "%", "cluster"))
        distance = {
            i: abs(row[f"x{i}"] - stats[f"mx{i}"]) / stats[f"sx{i}"] for i in range(len(columns)) if stats[f"sx{i}"]
        }
        for i in sorted(distance, key=lambda i: -distance[i])[:3]:
            out.append((f"cluster.{label}.mean.{_slug(columns[i])}", "cluster", "mean", label, row[f"x{i}"], "", columns[i]))
        if row["n"] < MIN_CLUSTER_ROWS:
            refused.append(("find_clusters", label, "a group this small may be stray rows", row["n"], MIN_CLUSTER_ROWS))
    return Outcome(_metrics(df, out), refusals(spark, refused))
