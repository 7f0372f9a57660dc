"""Relevance of texts by indexed grams, against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from metricloom.operators import textmine

QUESTION = "red fox and red hen"


def grams(text):
    words = [w for w in re.findall("[a-z0-9_]+", text) if len(w) > 1 and w not in textmine.QUESTION_STOPWORDS]
    return Counter(words) + Counter(map(" ".join, zip(words, words[1:])))


def brute(rows, question=QUESTION):
    """Score by key; ``rows`` are (key, text), and texts of one key count together."""
    held = defaultdict(Counter)
    for k, t in rows:
        held[k] += grams(t)
    asked = grams(question)
    spread = Counter(g for c in [*held.values(), asked] for g in c)
    idf = lambda g: math.log((2 + len(rows)) / (1 + spread[g])) + 1
    weight = lambda c: {g: (1 + math.log(n)) * idf(g) for g, n in c.items()}
    long = lambda w: math.sqrt(sum(x * x for x in w.values()))
    q = weight(asked)
    return {k: sum(x * q.get(g, 0) for g, x in w.items()) / (long(w) * long(q)) if w else 0.0 for k, w in ((k, weight(c)) for k, c in held.items())}


def sample(n, seed=2):
    draw = random.Random(seed)
    words = ["red", "fox", "hen", "and", "a", "the", "so", "ünder_9", *[f"w{i}" for i in range(40)]]
    return [(str(k), " ".join(draw.choice(words) for _ in range(draw.choice([0, 1, 2, 9, 30]))) + draw.choice(["", ".", " - "])) for k in range(n)]


class Task:
    @classmethod
    def get(cls):
        return cls()

    def partitionId(self):
        return 0


def scored(blocks, total, by_bucket=True):
    table = pa.Table.from_batches(blocks)
    met = [textmine._count_bucket(table.filter(pa.compute.equal(table["bucket"], b))) for b in set(table["bucket"].to_pylist())]
    met = pa.concat_tables(met)
    out = pa.concat_tables([textmine._weigh(met.filter(pa.compute.equal(met["chunk"], c)), total) for c in set(met["chunk"].to_pylist())])
    sums = defaultdict(lambda: [0.0, 0.0])
    for r in out.to_pylist():
        sums[r["_k"], r["_q"]][0] += r["dot"]
        sums[r["_k"], r["_q"]][1] += r["squares"]
    norm = sums.pop((None, True))[1]
    return {k: dot / math.sqrt(squares * norm) for (k, _), (dot, squares) in sums.items()}, len(met)


@pytest.mark.parametrize("size, buckets", [(1, 1), (150, 7), (10**6, 1), (10**6, 100)])
def test_texts_are_indexed_in_chunks_and_counted_in_buckets(monkeypatch, size, buckets):
    monkeypatch.setattr(textmine, "INDEX_CHARS", size)
    monkeypatch.setattr(textmine, "CHUNK_CHARS", 60)
    monkeypatch.setattr(textmine, "TaskContext", Task)
    rows = [(str(k // 3) if k < 60 else str(k), t) for k, (_, t) in enumerate(sample(120))]  # the first keys have three texts each
    asked = np.unique(textmine._gram_hashes(pa.array([QUESTION]))[1], return_counts=True)
    batches = [pa.RecordBatch.from_pydict({"_k": [k for k, _ in part], "_q": [False] * len(part), "text": [t for _, t in part]}) for part in (rows[:7], rows[7:8], rows[8:])]
    batches.append(pa.RecordBatch.from_pydict({"_k": pa.array([None], pa.string()), "_q": [True], "text": [QUESTION]}))
    got, _ = scored(list(textmine._indexed_texts(iter(batches), asked, buckets)), len(rows) + 1)
    want = {k: v for k, v in brute(rows).items() if any(grams(t) for key, t in rows if key == k)}
    assert got == pytest.approx(want)


def test_rows_of_one_key_may_lie_in_several_chunks(monkeypatch):
    monkeypatch.setattr(textmine, "INDEX_ROWS", 40)
    monkeypatch.setattr(textmine, "TaskContext", Task)
    rows = [(None if k % 4 else "x", t) for k, (_, t) in enumerate(sample(60))]
    asked = np.unique(textmine._gram_hashes(pa.array([QUESTION]))[1], return_counts=True)
    texts = pa.RecordBatch.from_pydict({"_k": pa.array([k for k, _ in rows] + [None], pa.string()), "_q": [False] * 60 + [True], "text": [t for _, t in rows] + [QUESTION]})
    counted = pa.Table.from_batches(textmine._gram_rows([texts])).group_by(["_k", "_q", "h"]).aggregate([("tf", "sum")]).rename_columns(["_k", "_q", "h", "tf"])
    blocks = list(textmine._indexed_rows(iter(counted.to_batches(max_chunksize=30)), asked, 5))
    assert len(blocks) > 2
    assert scored(blocks, len(rows) + 1)[0] == pytest.approx(brute(rows))


def test_numbers_are_packed_and_unpacked():
    for numbers in ([0], [0] * 9, [1, 255, 256, 0], [2**64 - 1, 1, 2**40]):
        block = textmine._pack(np.array(numbers, np.uint64))
        assert textmine._unpack(block, len(numbers)).tolist() == numbers


def test_a_chunk_that_was_read_differently_is_refused(monkeypatch):
    monkeypatch.setattr(textmine, "TaskContext", Task)
    batch = pa.RecordBatch.from_pydict({"_k": ["a"], "_q": [False], "text": ["red fox red hen"]})
    found = pa.Table.from_batches(textmine._indexed_texts(iter([batch]), (np.array([], np.uint64), np.array([], int)), 4))
    with pytest.raises(RuntimeError, match="not the same"):
        textmine._weigh(found.slice(0, len(found) - 1), 2)


@pytest.mark.parametrize("question", [QUESTION, "", "nothing like it"])
def test_relevance_of_every_text(spark, question):
    rows = sample(80)
    got = {r["k"]: (r["score"], r["checked"]) for r in textmine.relevance(spark.createDataFrame(rows, "k string, t string").repartition(5), "k", "t", question).collect()}
    want = brute(rows, question) if grams(question) else dict.fromkeys(got, 0.0)
    assert {k: s for k, (s, c) in got.items() if c} == pytest.approx({k: round(want[k], 4) for k, (_, c) in got.items() if c}, abs=1e-4)
    assert {c for _, c in got.values()} == {True, False}


def test_keys_with_much_text_are_counted_by_gram(spark):
    long = "red fox " * 300_000
    rows = [("a", long), ("a", long + "hen"), (None, long), (None, "blue " + long), ("b", "red hen"), ("b", "fox"), ("c", "blue fox"), ("d", "")]
    got = {r["k"]: r["score"] for r in textmine.relevance(spark.createDataFrame(rows, "k string, t string"), "k", "t", QUESTION).collect()}
    assert got == pytest.approx(brute(rows), abs=1e-4)


def test_grams_are_not_stored_with_every_text(spark):
    draw = random.Random(3)
    rows = [(k, " ".join(f"word{draw.randrange(10**5)}" for _ in range(150))) for k in range(2000)]
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    assert textmine.relevance(spark.createDataFrame(rows, "k long, t string"), "k", "t", QUESTION).count() == 2000
    stored = sum(p.stat().st_size for new in set(folder.iterdir()) - before for p in new.rglob("*.parquet"))
    assert stored < sum(len(t) for _, t in rows) / 8  # the grams themselves took more than the texts
