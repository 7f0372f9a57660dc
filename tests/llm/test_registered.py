"""The registered queries as they are, on the smallest tables, against brute force."""

import os
import zlib
from collections import Counter

import brute
import numpy as np
import pytest

from metricloom.llm import language, pii, queries, simhash

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()
    return {r["doc_id"]: r["text"] for r in rows}


def run(spark, name, columns, key="doc_id"):
    found = queries.QUERIES[name](spark, FOLDER)
    assert found.columns == columns.split()
    return {r[key]: r for r in found.collect()}


def test_op1(spark, texts):
    found = run(spark, "op1_secret_scan", "doc_id n_assign n_access n_hex base_sha256 spans")
    for k, text in texts.items():
        base = brute.secrets(text)
        kinds = Counter(s.split(":")[0] for s in base)
        assert (found[k]["n_assign"], found[k]["n_access"], found[k]["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert found[k]["base_sha256"] == brute.sha(",".join(base)) and set(base) <= set(found[k]["spans"].split(",")) | {""}
    assert found.keys() == texts.keys()


def test_op2(spark, texts):
    found = run(spark, "op2_sentencepiece", "doc_id n_ids ids round_trip")
    assert found.keys() == texts.keys() and all(r["round_trip"] and r["n_ids"] == len(r["ids"]) for r in found.values())


def test_op3(spark, texts):
    found = run(spark, "op3_substring_dedup", "doc_id n_words n_removed kept_sha256")
    want = brute.without_repeats(list(texts.values()), 35)
    assert {k: (r["n_words"], r["n_removed"], r["kept_sha256"]) for k, r in found.items()} == {k: (n, gone, brute.sha(kept)) for k, (n, gone, kept) in zip(texts, want)}


def test_op4(spark, texts):
    found = queries.QUERIES["op4_fingerprints"](spark, FOLDER)
    assert found.columns[:7] == "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next".split()
    found = {r["doc_id"]: r for r in found.collect()}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        text, following = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        assert found[i]["edited_sha256"] == brute.sha(text[: len(text) - len(text) // 3] + following[: len(text) // 3])
        assert 0 <= found[i]["near_next"] <= 1 and 0 <= found[i]["near_edited"] <= 1


def test_op5(spark, texts):
    found = run(spark, "op5_mixing", "doc_id size source_size target taken")
    assert {k: r["size"] for k, r in found.items()} == {k: len(brute.words(t)) for k, t in texts.items()}
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in found.values())
    cells = len({r["source_size"] for r in found.values()})  # each source is one cell here, and loses less than a block of 16 words to its cap
    assert abs(sum(r["taken"] for r in found.values()) - 1.5 * sum(r["size"] for r in found.values())) <= 16 * cells
    again = run(spark, "op5_mixing", "doc_id size source_size target taken")
    assert again == found


def test_op6(spark, texts):
    found = run(spark, "op6_personal_data", "doc_id n_email n_ip n_card n_phone base_sha256 spans")
    for k, text in texts.items():
        base = brute.personal(text)
        assert found[k]["base_sha256"] == brute.sha(",".join(base))
        kinds = Counter(s.split(":")[0] for s in base)
        assert [found[k][f"n_{kind}"] for kind in ("email", "ip", "card", "phone")] == [kinds[kind] for kind in ("email", "ip", "card", "phone")]


def test_op7(spark, texts):
    found = run(spark, "op7_language_id", "doc_id held_out lang_pred score rejected")
    langs = {r[0]: r[1] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").collect()}
    learned = {lang for k, lang in langs.items() if lang and zlib.crc32(str(k).encode()) % 3 != 1}
    for k, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert r["lang_pred"] in (learned if any(c.isalpha() for c in texts[k] or "") else {"und"})
    held = [r["lang_pred"] == langs[k] for k, r in found.items() if r["held_out"] and langs[k]]
    assert sum(held) >= 0.9 * len(held)


def test_op8(spark, texts):
    found = run(spark, "op8_sharding", "doc_id size text_crc32 law shard slot grown_shard")
    assert {k: (r["size"], r["text_crc32"]) for k, r in found.items()} == {k: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in texts.items()}
    slots = {}
    for r in found.values():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op9(spark, texts):
    found = run(spark, "op9_simhash", "doc_id fingerprint component_id")
    prints = [brute.simhash(t, 3) for t in texts.values()]
    root = brute.groups(len(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    ids = list(texts)
    assert {k: (r["fingerprint"], r["component_id"]) for k, r in found.items()} == {k: (f"{p:016x}", ids[g]) for k, p, g in zip(ids, prints, root)}


def test_op10(spark):
    found = queries.QUERIES["op10_nearest"](spark, FOLDER)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").collect()
    good = [r for r in rows if r["embedding"] and all(v is not None and np.isfinite(v) for v in r["embedding"]) and any(r["embedding"])]
    ids, x = np.array([r["vec_id"] for r in good]), np.array([r["embedding"] for r in good], float)
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    asked = [k for k, i in enumerate(ids) if i % 20 == 0]
    assert set(got) == {int(ids[k]) for k in asked}
    hits = []
    for k in asked:
        want = brute.nearest(ids, x, k, 20)
        mine = sorted(got[int(ids[k])])
        assert [r for r, *_ in mine] == list(range(1, len(mine) + 1)) and [s for *_, s in mine] == sorted((s for *_, s in mine), reverse=True)
        hits.append(len({i for _, i, _ in mine} & {i for i, _ in want}) / len(want))
    assert np.mean(hits) >= 0.9


def test_empty_tables(docs, no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert pii.mask(no_docs).count() == 0 and pii.find(no_docs).count() == 0
    model = language.fit(docs)
    assert language.identify(no_docs.drop("seen"), model).count() == 0 and language.keep_identified(no_docs, model).count() == 0
