"""Operators over the whole table: near-duplicates, neighbours, mixing, sharding."""

from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.llm import mixing, neighbours, shards, simhash


# ---- near-duplicates --------------------------------------------------------------------------------------------


def test_simhash_matches_brute_force(docs, rows):
    got = Counter((r["doc_id"], r["fp"].hex(), r["component_id"]) for r in simhash.near_duplicates(docs, shingle=3).collect())
    prints = [brute.simhash(r[1], 3) for r in rows]
    root = brute.groups(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    first = {}
    for r, g in zip(rows, root):
        if r[0] is not None:
            first[g] = min(first.get(g, r[0]), r[0])
    assert got == Counter((r[0], f"{p:016x}", first.get(g)) for r, p, g in zip(rows, prints, root))


@pytest.mark.parametrize("budget", (0, 1, 3))
def test_trie_walk_finds_every_pair(budget):
    rng = np.random.default_rng(budget)
    centres = rng.integers(0, 1 << 63, 6, np.uint64)
    values = np.unique(np.concatenate([c ^ np.bitwise_or.reduce([np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64) for _ in range(2)]) for c in centres]))
    got = {tuple(sorted((int(i), int(j)))) for a, b in simhash.trie_links(values[:, None], np.array([0]), budget) for i, j in zip(a, b)}
    assert got == {(i, j) for j in range(len(values)) for i in range(j) if (int(values[i]) ^ int(values[j])).bit_count() <= budget}


def test_any_three_bits_share_a_key():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 3000, np.uint64)
    b = a.copy()
    for _ in range(3):
        b ^= np.uint64(1) << rng.integers(0, 64, len(b)).astype(np.uint64)
    assert (simhash._block_keys(a[:, None]) == simhash._block_keys(b[:, None])).any(axis=1).all()


def test_components_of_a_long_path(spark):
    rng = np.random.default_rng(2)
    names = rng.permutation(400).tolist()
    edges = [(names[k], names[k + 1]) for k in range(199)] + [(names[k], names[k + 1]) for k in range(200, 399)]
    found = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert len(found) == 400 and len(set(found.values())) == 2
    assert len({found[n] for n in names[:200]}) == 1


def test_components_store_few_tables(spark, monkeypatch):
    """Every stored table is a job that the driver keeps account of."""
    stored, plain = [], simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df: stored.append(1) or plain(df))
    found = simhash.components(spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a bigint, b bigint"))
    assert {(r["node"], r["root"]) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)}
    assert len(stored) == 4  # edges, hooks, hooks followed to their ends in one go, no edges


def test_components_are_found_once(spark, monkeypatch):
    asked, plain = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda edges: asked.append(1) or plain(edges))
    words = " ".join(f"w{k}" for k in range(200))
    df = spark.createDataFrame([(3, words), (1, words + " end"), (2, "something else"), (4, None)], "doc_id int, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == [1, 2, 4]
    assert len(asked) == 2  # of the candidates, and of the links that are right


def test_keep_one(docs, rows, no_docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    out = [r["doc_id"] for r in kept.collect()]
    assert len(out) == len(set(out))
    near = [r[0] for r in rows if r[1] and "changed" in r[1]]
    assert len(set(out) & set(near)) == 1
    assert {r[0] for r in rows[:60]} - set(out) == set()  # unrelated texts stay
    assert len([r for r in rows if r[1] == rows[3][1] and r[0] in out]) == 1
    assert simhash.keep_one(no_docs).count() == 0


def test_keep_one_counts_a_repeated_shingle_once(spark):
    shared = " ".join(" ".join(f"s{k}" for k in range(64)) for _ in range(10))
    texts = [shared + " " + " ".join(f"{side}{k}" for k in range(300)) for side in "ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert simhash.keep_one(df).count() == 2


def test_keep_one_links_by_exact_similarity(spark):
    rng = np.random.default_rng(11)
    texts = []
    for base in range(12):  # copies with more and more words changed, most pairs near the threshold
        for _ in range(14):
            words = [f"w{base}x{k}" for k in range(120)]
            for k in rng.choice(120, rng.integers(0, 5), replace=False):
                words[k] = f"c{rng.integers(1 << 30)}"
            texts.append(" ".join(words))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for t in texts]
    alike = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8
    groups = brute.groups(len(texts), alike)
    assert 12 < len(set(groups)) < len(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == sorted(set(groups))


# ---- neighbours -------------------------------------------------------------------------------------------------


def vectors(spark, n, width=16, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, width)).astype(np.float32)
    x[5] = x[20]
    rows = [(k, [float(v) for v in x[k]], "clash") for k in range(n)]
    odd = [(n, None, "c"), (n + 1, [0.0] * width, "c"), (n + 2, [float("nan")] * width, "c"), (n + 3, [None] + [1.0] * (width - 1), "c"), (None, rows[0][1], "c"), (n + 4, [1.0], "c")]
    return x.astype(float), spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, block string").repartition(4)


def test_neighbours_exact_when_all_are_candidates(spark):
    x, df = vectors(spark, 120)
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, share=1.0, block_rows=50, query_block_rows=3).collect()
    ids = np.arange(len(x))
    for q in range(0, 120, 20):
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        want = brute.nearest(ids, x, q, 20)
        assert [r["vec_id"] for r in mine] == [i for i, _ in want]
        assert np.allclose([r["score"] for r in mine], [s for _, s in want])
    assert {r["query_id"] for r in got} == set(range(0, 120, 20))


def test_neighbours_recall(spark):
    x, df = vectors(spark, 900, 32)
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect()
    ids, hit = np.arange(len(x)), []
    for q in range(0, 900, 20):
        hit.append(len({r["vec_id"] for r in got if r["query_id"] == q} & {i for i, _ in brute.nearest(ids, x, q, 20)}) / 20)
    assert np.mean(hit) >= 0.9


def test_neighbours_small(spark):
    schema = "vec_id bigint, embedding array<float>"
    one = spark.createDataFrame([(0, [1.0, 2.0]), (20, [2.0, 1.0]), (3, [0.5, 0.5])], schema)
    assert sorted((r[0], r[1], r[2]) for r in neighbours.nearest(one, F.col("vec_id") % 20 == 0).collect()) == [(0, 1, 20), (0, 2, 3), (20, 1, 0), (20, 2, 3)]
    assert neighbours.nearest(spark.createDataFrame([], schema), F.lit(True)).count() == 0


# ---- mixing -----------------------------------------------------------------------------------------------------


def check_mix(found, rows, block):
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((r[0], len(brute.words(r[1]))) for r in rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(brute.words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, brute.targets([sizes[s] for s in order])))
    taken = dict.fromkeys(order, 0)
    for r in found:
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - want[s]) <= 2 * block * max(1, sizes[s] / 100)


def test_mix_matches_brute_force(docs, rows):
    sourced = docs.select("doc_id", "source").distinct()
    for cell in (100_000, 300):
        found = mixing.mix(docs, block=4, cell_words=cell)
        again = mixing.mix(docs.repartition(3), block=4, cell_words=cell)
        assert Counter(map(tuple, found.collect())) == Counter(map(tuple, again.collect()))
        named = found.join(docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("seen"), "source").distinct().withColumnsRenamed({"doc_id": "_i", "seen": "_s"}), F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("seen") == F.col("_s")))
        check_mix(named.collect(), rows, 4)
    assert sourced.count() > 0


def test_apportionment_is_one_by_one(spark):
    rng = np.random.default_rng(4)
    for claims, seats in (([5.0, 5.0, 5.0, 1.0], 7), ([0.2] * 9, 4), (rng.random(40).tolist(), 333), ([3.0], 5), ([1.0, 2.0], 0)):
        cells = spark.createDataFrame([(k, c) for k, c in enumerate(claims)], "cell int, claim double")
        got = [r["quota"] for r in mixing.apportion(cells, "claim", seats, ["cell"]).orderBy("cell").collect()]
        assert got == brute.webster(claims, seats)


def test_take_follows_the_mix(docs, no_docs):
    shares = mixing.mix(docs, block=4).filter("taken > 0").agg(F.sum("taken")).first()[0]
    mixed = mixing.take(docs, block=4)
    assert mixed.columns == docs.columns
    assert sum(len(brute.words(r["text"])) for r in mixed.collect()) == shares
    assert mixing.mix(no_docs).count() == 0 and mixing.take(no_docs).count() == 0


# ---- sharding ---------------------------------------------------------------------------------------------------


def test_cuts_are_minimax(spark):
    rng = np.random.default_rng(6)
    for n, parts in ((30, 4), (12, 5), (3, 6)):
        sizes = rng.integers(1, 60, n).tolist()
        keys = np.sort(rng.integers(-(1 << 62), 1 << 62, n)).tolist()
        groups = spark.createDataFrame(list(zip(keys, sizes)), "key bigint, size bigint")
        for bits in (14, 1):
            cuts = [c for c in shards.minimax_cuts(groups, parts, first_bits=bits, more_bits=2) if c is not None]
            loads = np.zeros(parts, int)
            for k, s in zip(keys, sizes):
                loads[sum(c <= k for c in cuts)] += s
            assert loads.max() == brute.smallest_capacity(sizes, parts)


def test_shards_of_rows(docs, rows, no_docs):
    found = shards.assign(docs, shards=7).collect()
    assert len(found) == len(rows)
    by_shard = {}
    for r in found:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    by_crc = {}
    for r in found:
        by_crc.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(len(s) == 1 for s in by_crc.values())
    assert Counter(r["size"] for r in found) == Counter(len((r[1] or "").encode()) + 16 for r in rows)
    assert shards.assign(no_docs).count() == 0
