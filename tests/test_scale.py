"""The split way must give the same rows as the plain way, also when one key holds a third of the table."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from metricloom import scale
from metricloom.operators import process, stats, textmine


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(30)}", rng.randrange(20), i, rng.choice("abc"), rng.random()) for i in range(600)]
    return spark.createDataFrame(rows, "key string, t int, id int, act string, v double").repartition(5).cache(), rows


def in_order(rows):
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        groups[r[0]].append(r)
    return groups


@pytest.mark.parametrize("split", [False, True])
def test_next_position_and_running_sum(skewed, split):
    df, rows = skewed
    got = scale.Sequenced(df, ["key"], ["t", "id"], split=split).with_next({"nxt": "act"}).with_position("pos").with_running_sum("total", "v").rows()
    found = {r["id"]: (r["nxt"], r["pos"], round(r["total"], 9)) for r in got.collect()}
    for group in in_order(rows).values():
        total = 0.0
        for i, r in enumerate(group):
            total += r[4]
            assert found[r[2]] == (group[i + 1][3] if i + 1 < len(group) else None, i + 1, round(total, 9))


def test_split_spreads_the_hot_key(skewed):
    df, _ = skewed
    blocks = scale.Sequenced(df, ["key"], ["t", "id"], split=True).df
    assert blocks.filter("key = 'hot'").select(scale.BLOCK).distinct().count() > 1


@pytest.mark.parametrize("keys", [[], ["key"]])
def test_percentiles_agree(skewed, keys):
    df, _ = skewed
    shares = {"q1": 0.25, "mid": 0.5, "p95": 0.95}
    plain = scale.percentiles(df, keys, "v", shares, split=False)
    split = scale.percentiles(df, keys, "v", shares, split=True)
    as_set = lambda d: sorted(tuple(round(x, 10) if isinstance(x, float) else x for x in r) for r in d.select(*keys, *shares).collect())
    assert as_set(plain) == as_set(split)


def test_average_ranks_agree(skewed):
    df, rows = skewed
    plain = {r["t"]: r["r"] for r in scale.average_ranks(df, [], "t", "r", split=False).collect()}
    split = {r["t"]: r["r"] for r in scale.average_ranks(df, [], "t", "r", split=True).collect()}
    values = sorted(r[1] for r in rows)
    brute = {v: sum(i + 1 for i, x in enumerate(values) if x == v) / values.count(v) for v in set(values)}
    assert plain == split == pytest.approx(brute)


def log_of(df):
    return process.EventLog(df.withColumn("ts", F.timestamp_seconds(F.col("t") * 3600)), "key", "act", "id", ts="ts")


def test_process_operators_do_not_depend_on_the_way(skewed, spark):
    df, _ = skewed
    def measured():
        log = log_of(df)
        return (
            sorted(map(tuple, process.transitions(log, limit=None).collect()), key=str), process.rework_cases(log).first(), process.durations(log).first(),
            sorted(map(str, process.case_traces(log).collect())), [tuple(r) for r in process.top_variants(log).collect()],
            sorted(map(tuple, process.variant_paths(log, process.top_variants(log)).collect())), sorted(map(tuple, process.variant_signatures(log).collect())),
        )
    plain = measured()
    spark.conf.set(scale.GROUP_LIMIT_CONF, "50")
    try:
        split = measured()
    finally:
        spark.conf.unset(scale.GROUP_LIMIT_CONF)
    assert plain == split


def test_spearman_split(skewed, tiny_groups):
    df, rows = skewed
    rho = stats.rank_correlation(df, "t", "v").first()["rho"]
    def ranks(xs):
        order = sorted(xs)
        count = Counter(xs)
        return [order.index(x) + (count[x] + 1) / 2 for x in xs]
    a, b = ranks([r[1] for r in rows]), ranks([r[4] for r in rows])
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    cov = sum((x - ma) * (y - mb) for x, y in zip(a, b))
    want = cov / (sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b)) ** 0.5
    assert rho == pytest.approx(want)


@pytest.mark.parametrize("hot_grams", [1, 3, 1000])
def test_frequent_and_rare_grams_meet_their_counts(spark, hot_grams):
    rows = [(i, g) for i in range(60) for g in ("everywhere", f"tenth {i % 10}", f"own {i}", "long" * 60)]
    counted = spark.createDataFrame(rows, "k long, gram string")
    spread = Counter(g for _, g in rows)
    got = textmine._with_spread(counted, hot_grams)
    assert sorted((r["k"], r["gram"], r["df"]) for r in got.collect()) == sorted((k, g, spread[g]) for k, g in rows)


def test_tokens_of_a_task_against_plain_python():
    draw = random.Random(4)
    texts = [" ".join(draw.choice(["alpha", "beta", "the", "x", "12,5%", "-3", "gamma_1", "!"]) if draw.random() < 0.2 else draw.choice(["beta", "delta"]) for _ in range(n)) for n in (0, 1, 40, 300, 90)]
    read = textmine._read_texts(texts)
    tok = [[(w, i) for i, w in enumerate(t.replace("!", " ").split())] for t in texts]
    content = lambda w: w[0].isalpha() and len(w) > 1 and w != "the"
    words = [(r, i, w, any(abs(i - j) <= textmine.REACH and not v[0].isalpha() for v, j in own)) for r, own in enumerate(tok) for w, i in own if content(w)]
    at = np.flatnonzero(read.content)
    assert list(zip(read.row[at].tolist(), read.pos[at].tolist(), read.terms.take(pa.array(at)).to_pylist(), read.near(at).tolist())) == words
    pairs = [(r, i) for r, own in enumerate(tok) for (v, i), (w, _) in zip(own, own[1:]) if content(v) and content(w) and v != w]
    assert list(zip(read.row[read.pairs()].tolist(), read.pos[read.pairs()].tolist())) == pairs


def test_texts_are_read_in_chunks_and_counted_in_the_task(monkeypatch):
    monkeypatch.setattr(textmine, "CHUNK_CHARS", 10)
    batch = pa.RecordBatch.from_pydict({"text": ["aa bb aa", "x" * 30, "cc", None, "dd"]})
    assert [c.num_rows for c in textmine._chunks([batch])] == [2, 3]
    read = textmine._read_texts(["aa bb aa bb cc"] * 50)
    found = textmine._folded(read.terms.take(pa.array(read.pairs())), read.terms.take(pa.array(read.pairs() + 1)), read.near(read.pairs()))
    assert sorted((r["a"], r["b"], r["turned"], r["n"]) for b in found for r in b.to_pylist()) == [("aa", "bb", False, 100), ("aa", "bb", True, 50), ("bb", "cc", False, 50)]


def test_texts_of_one_key_are_scored_together(spark):
    df = spark.createDataFrame([(1, "red fox"), (1, "red hen"), (2, "red fox red hen"), (None, "hen"), (None, "fox"), (3, "")], "k long, t string")
    found = textmine.relevance(df, "k", "t", "red fox").orderBy("k", "score").collect()
    assert [r["k"] for r in found] == [None, None, "1", "1", "2", "3"]
    assert found[0]["score"] == found[1]["score"] > 0 and found[2]["score"] == found[3]["score"] > 0 and found[5]["score"] == 0
    marked = textmine._with_spread(df.select(F.col("k"), F.explode(F.split("t", " ")).alias("gram")), 2)
    assert {(r["gram"], r["df"]) for r in marked.collect()} == {("red", 4), ("fox", 3), ("hen", 3), ("", 1)}
