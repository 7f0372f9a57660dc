"""Exact duplicates, spelling variants and whitening against brute force."""

import random
import re
from collections import Counter

import brute
import numpy as np
import pytest

from metricloom.llm import exact, queries, spelling, whitening

# ---- exact duplicates -------------------------------------------------------------------------------------------


def checked_groups(found, rows):
    got = [tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "text_sha256")) for r in found]
    assert Counter(got) == Counter(brute.equal_texts(rows))
    kept = [r for r in found if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in found}) == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_groups_match_brute_force(docs, rows, no_docs):
    checked_groups(exact.groups(docs).collect(), rows)
    assert exact.groups(no_docs).count() == 0


@pytest.mark.parametrize("table_rows", (1 << 16, 3))
def test_small_tables_go_through_rounds(spark, monkeypatch, table_rows):
    """Tables of 2,000 bytes: hot texts are shared out, buckets overflow, and the rounds still end with the same rows."""
    monkeypatch.setattr(exact, "TABLE_BYTES", 2000)
    monkeypatch.setattr(exact, "TABLE_ROWS", table_rows)
    rng = random.Random(table_rows)
    hot, long = "the same TEXT again", "z" * 5000
    rows = [(k, rng.choice([hot, hot.lower(), hot.upper(), f"text {rng.randrange(60)}", f"Only {k}", "", None, long])) for k in range(700)]
    rows += rows[:5] + [(None, hot), (None, None), (None, "nobody")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    checked_groups(exact.groups(df).collect(), rows)


def test_table_compares_texts_not_hashes():
    table = exact.Table()
    places = [table.place(5, b"a"), table.place(5, b"b"), table.place(5, b"a")]
    assert places == [0, 1, 0]
    for k in range(3000):
        table.place(k % 7, b"%d" % k)
    assert table.place(2999 % 7, b"2999") == table.place(2999 % 7, b"2999") and len(table.texts) == 3002


def test_keep_one_row_of_equal_texts(docs, rows):
    kept = exact.keep_one(docs)
    assert kept.columns == docs.columns
    groups = {brute.lowered(r[1]) for r in rows}
    assert Counter(brute.lowered(r["text"]) for r in kept.collect()) == Counter(groups)


def test_groups_of_text_ids(spark):
    df = spark.createDataFrame([("b", "X"), ("a", "x"), ("é", "x"), (None, "y")], "name string, body string")
    found = {(r["name"], r["keep_id"], r["group_size"], r["kept"]) for r in exact.groups(df, "name", "body").collect()}
    assert found == {("b", "é", 3, False), ("a", "é", 3, False), ("é", "é", 3, True), (None, None, 1, True)}


# ---- spelling variants ------------------------------------------------------------------------------------------


def misspelt(n, seed=4):
    rng = random.Random(seed)
    stems = ["".join(rng.choices("abcdefghijklmnoprstué", k=rng.randint(6, 11))) for _ in range(25)]

    def slip(w):
        k = rng.randrange(len(w))
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcdeéÿ") + w[k:], w[:k] + rng.choice("abcdezÀ") + w[k + 1 :]])

    texts = []
    for _ in range(n):
        words = [rng.choice(stems[: rng.choice((2, 10, 25))]) for _ in range(60)]
        texts.append(" ".join(slip(w) if rng.random() < 0.3 else w.capitalize() if rng.random() < 0.2 else w for w in words))
    return texts


@pytest.mark.parametrize("small", (False, True))
def test_variants_match_brute_force(spark, small):
    rows = [(k, t) for k, t in enumerate(misspelt(60))] + [(None, misspelt(1)[0]), (90, None), (91, ""), (92, "12 ß! abcdefg-abcdefg"), (93, "q" * 3000 + " " + "q" * 3000)]
    rows += rows[:2]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, word string, n int").repartition(5)
    counted = spelling.count_words(df).filter("n >= 2")
    sizes = {"filter_bytes": 1 << 7, "page_blocks": 1} if small else {}  # small: many pages and rounds
    found = spelling.group_variants(counted, **sizes).collect()
    want = brute.variants(rows)
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found} == want and len(found) == len(want)
    assert any(f and r != f for f, r, *_ in want.values()) or any(f for f, *_ in want.values())


def test_variants_of_awkward_documents(docs, rows, no_docs):
    found = spelling.group_variants(spelling.count_words(docs).filter("n >= 2")).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found} == brute.variants(rows)
    assert spelling.group_variants(spelling.count_words(no_docs)).count() == 0


def test_chains_end_at_the_last_form(spark):
    words = [("aaaaaaa", 2000), ("aaaaaab", 200), ("aaaaabb", 20), ("aaaabbb", 2), ("zzzzzzz", 7), ("zzzzzzy", 7)]
    found = {r["word"]: r for r in spelling.group_variants(spark.createDataFrame(words, "word string, n bigint")).collect()}
    assert found["aaaabbb"]["form"] == "aaaaabb" and found["aaaabbb"]["root"] == "aaaaaaa" and found["aaaabbb"]["form_n"] == 20
    assert found["zzzzzzz"]["form"] is None and found["zzzzzzz"]["n_near"] == 1 and found["zzzzzzz"]["root"] == "zzzzzzz"


def test_filter_never_misses():
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("abcdefgh"), 8)) for _ in range(4000)})
    (_, _, letters), = spelling._by_length(words)
    hashes = spelling._sums(letters)[:, -1]
    lanes = np.zeros((128, spelling.LANES), np.uint64)
    mixed = spelling._mixed(hashes)
    for lane in range(spelling.LANES):
        np.bitwise_or.at(lanes, (spelling._block(mixed, 125), lane), np.uint64(1) << (mixed * spelling.SALTS[lane] >> np.uint64(58)))
    bloom = spelling.Filter({8: 125}, 128, {(8, 0): lanes.tobytes()})
    assert len(bloom.passes(8, hashes)) == len(words)
    assert len(bloom.passes(8, hashes + np.uint64(1))) < 0.01 * len(words)


# ---- whitening --------------------------------------------------------------------------------------------------


def vectors_of(n, width, seed):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, width)) @ rng.standard_normal((width, width)) * 0.1).astype(np.float32)


def checked_whitening(found, ids, x, components=8):
    deviations, coordinates, shares = brute.whitened(np.floor(1024.0 * x.astype(float)).astype(np.int64) + 100_000, components)
    got = {}
    for r in found:
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(found) == len(ids) * coordinates.shape[1] and len(got) == len(ids)
    signs = {}
    for i, dev, row in zip(ids, deviations, coordinates):
        for k, want in enumerate(row):
            r = got[i][k + 1]
            sign = signs.setdefault(k, 1 if r["whitened"] * want >= 0 else -1)
            assert r["whitened"] * sign == pytest.approx(want, rel=1e-7, abs=1e-7)
            assert r["deviation"] == dev and r["n"] == len(ids) and r["identity_error"] <= 1e-9
            assert r["explained"] == pytest.approx(shares[k], rel=1e-9)


@pytest.mark.parametrize("blocks", ((1024, 1024), (16, 5)))
def test_whitening_matches_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", blocks[0])
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", blocks[1])
    x = vectors_of(230, 12, 1)
    rows = [(k, [float(v) for v in x[k]], "clash") for k in range(len(x))]
    odd = [(900, None, "c"), (901, [float("nan")] * 12, "c"), (902, [None] + [1.0] * 11, "c"), (903, [float("-inf")] * 12, "c"), (904, [], "c"), (905, [1.0] * 3, "c")]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, index string").repartition(6)
    found = whitening.by_component(whitening.whiten(df)).collect()
    checked_whitening(found, range(len(x)), x)


def test_whitening_of_few_directions(spark):
    schema = "vec_id bigint, embedding array<float>"
    flat = vectors_of(40, 5, 2)
    flat[:, 2:] = [0.5, -0.25, 0.125]  # only two dimensions vary
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(flat)], schema)
    found = whitening.by_component(whitening.whiten(df)).collect()
    checked_whitening(found, range(40), flat)
    assert {r["component"] for r in found} == {1, 2}
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)
    assert whitening.by_component(whitening.whiten(one)).count() == 0
    empty = whitening.by_component(whitening.whiten(df.limit(0)))
    assert empty.count() == 0 and empty.dtypes == whitening.by_component(whitening.whiten(df)).dtypes


def test_repeated_vectors_count(spark):
    x = vectors_of(20, 3, 5)
    rows = [(k % 17, [float(v) for v in x[k % 20]]) for k in range(30)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    assert len(found) == 30 and {r["n"] for r in found} == {30}


# ---- as registered ----------------------------------------------------------------------------------------------

FOLDER = "/root/testdata/sf0.001"


def test_registered_queries(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    found = queries.QUERIES["op12_exact_dedup"](spark, FOLDER)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    checked_groups(found.collect(), [tuple(r) for r in docs])
    found = queries.QUERIES["op11_spelling_variants"](spark, FOLDER)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    words = Counter()
    for r in found.collect():
        words[r["word"]] = r["n"]
    want = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = brute.lowered(run)
            h = brute.zlib.crc32(f"{i}:{run}".encode())
            want[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    assert words == Counter({w: n for w, n in want.items() if len(w) >= 7 and n >= 2})
    found = queries.QUERIES["op13_whitening"](spark, FOLDER)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").collect()
    good = [r for r in rows if r["embedding"] and all(v is not None and np.isfinite(v) for v in r["embedding"])]
    checked_whitening(found.collect(), [r["vec_id"] for r in good], np.array([r["embedding"] for r in good], np.float32))
