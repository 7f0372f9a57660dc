"""Order of long paths, stored pages and the silhouette, against plain Python and numpy."""

import random
import uuid

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from metricloom.operators import mart, models, paths, process
from metricloom.session import checkpoint_dir


def steps_of(spark, table):
    return spark.createDataFrame([(k, i + 1, s) for k, path in table.items() for i, s in enumerate(path)], "k string, at long, step string")


@pytest.mark.parametrize("longest", [1, 2, 3, 13])
def test_lexical_places(spark, longest):
    draw = random.Random(longest)
    table = {f"p{i}": [draw.choice("ab") for _ in range(draw.randint(1, longest))] for i in range(40)}
    got = {r["k"]: r["place"] for r in paths.lexical_places(steps_of(spark, table), "k", "at", "step").collect()}
    different = sorted({tuple(p) for p in table.values()})
    assert got == {k: different.index(tuple(p)) + 1 for k, p in table.items()}


def test_lexical_places_split_and_without_steps(spark, tiny_groups):
    table = {f"p{i}": list(format(i, "b")) for i in range(20)}
    got = {r["k"]: r["place"] for r in paths.lexical_places(steps_of(spark, table), "k", "at", "step").collect()}
    assert sorted(table, key=got.get) == sorted(table, key=table.get)
    assert paths.lexical_places(steps_of(spark, table).limit(0), "k", "at", "step").collect() == []


def test_variants_equal_in_their_first_steps_rank_by_the_path(spark):
    start = ["go"] * 150
    cases = {"c1": [*start, "z"], "c2": [*start, "b", "c"], "c3": [*start, "b"], "c4": start, "c5": ["zz"], "c6": ["zz"], "c7": [*start, "a", *start]}
    rows = [(c, a, n) for n, (c, a) in enumerate((c, a) for c, path in cases.items() for a in path)]
    log = process.EventLog(spark.createDataFrame(rows, "c string, a string, n long"), "c", "a", "n")
    for limit, wanted in ((10, ["c5", "c4", "c7", "c3", "c2", "c1"]), (3, ["c5", "c4", "c7"])):
        best = process.top_variants(log, limit=limit).orderBy("rank").collect()
        assert [r["example"] for r in best] == wanted
    assert process.top_variants(log, limit=1).first()["cases"] == 2
    assert process.top_variants(process.EventLog(log.df.limit(0), "c", "a", "n")).collect() == []


def test_a_deep_page_reads_only_its_blocks(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("n"), F.lit("x").alias("rows"))
    pages = mart.store_pages(df, "n", f"{checkpoint_dir(spark)}/pages-{uuid.uuid4().hex}", block_rows=250)
    for limit, offset in ((25, 0), (25, 4321), (600, 700), (10, 4995), (10, 5000), (0, 3)):
        page = pages.page(limit, offset)
        assert [r["n"] for r in page.collect()] == list(range(offset, min(offset + limit, 5000)))
        blocks = {f.rsplit("/", 2)[1] for f in page.inputFiles()}
        assert len(blocks) <= limit // 100 + 2
    empty = mart.store_pages(df.limit(0), "n", f"{checkpoint_dir(spark)}/pages-{uuid.uuid4().hex}")
    assert empty.page(5).collect() == [] and empty.page(5).columns == ["n", "rows"]
    with pytest.raises(mart.MartError):
        mart.store_pages(df.withColumn(mart.PAGE_BLOCK, F.lit(1)), "n", "unused")


@pytest.mark.parametrize("sizes, off", [((700, 500, 1), 1e-9), ((4000, 1500, 500), 0.01)])
def test_silhouette_of_plain_distances(spark, sizes, off):
    draw = np.random.default_rng(3)
    points = np.concatenate([draw.normal(1.5 * c, 1, (n, 4)) for c, n in enumerate(sizes)])
    own = np.repeat(range(len(sizes)), sizes)
    apart = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(2))
    sums = np.stack([apart[:, own == c].sum(1) for c in range(len(sizes))], 1)
    scores = []
    for i, c in enumerate(own):
        inside = sums[i, c] / max(sizes[c] - 1, 1)
        outside = min(sums[i, d] / sizes[d] for d in range(len(sizes)) if d != c)
        scores.append(0 if sizes[c] == 1 else (outside - inside) / max(inside, outside))
    df = spark.createDataFrame([(int(c), p.tolist()) for c, p in zip(own, points)], "prediction int, p array<double>")
    got = models.silhouette(df.select("prediction", array_to_vector("p").alias("features")), sizes)
    assert abs(got - np.mean(scores)) < off
