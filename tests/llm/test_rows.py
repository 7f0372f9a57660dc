"""Operators that answer for each row: secrets, personal data, repeats, fingerprints, languages, pieces."""

from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.llm import fingerprints, language, pieces, pii, secrets, substrings
from metricloom.llm import spans as S

public_tokenizers = pytest.importorskip("public_tokenizers")


def multiset(pairs):
    return Counter(pairs)


# ---- secrets ----------------------------------------------------------------------------------------------------


def test_trigram_queries():
    assert secrets.trigram_query("AKIA[A-Z0-9]{16,}") == frozenset([frozenset(["aki", "kia"])])
    assert secrets.trigram_query("[0-9a-f]{24,}") == secrets.ANYTHING
    assert secrets.trigram_query("ab[cd]ef?") == frozenset([frozenset(["abc", "bce"]), frozenset(["abd", "bde"])])
    assert secrets.trigram_query("(abc|x).*defg") == frozenset([frozenset(["def", "efg"])])
    assert secrets.trigram_query("(?:abc)?") == secrets.ANYTHING
    clauses = secrets.trigram_query(secrets.BASE[0].pattern)
    assert frozenset(["pas", "ass", "ssw", "swo", "wor", "ord"]) in clauses and len(clauses) == 6


def test_secrets_match_brute_force(docs, rows):
    found = secrets.scan(docs)
    assert set(found.columns) == set(docs.columns)
    base = F.filter("spans", lambda s: s["place"] < 3)
    got = multiset((r[0], r[1], r[2]) for r in found.select("doc_id", "text", S.written(base)).collect())
    assert got == multiset((r[0], r[1], ",".join(brute.secrets(r[1]))) for r in rows)


def test_secrets_more_kinds_and_empty(spark, no_docs):
    jwt = "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12
    df = spark.createDataFrame([("ghp_" + "Z" * 36,), (f"é {jwt}",), (None,)], "text string")
    assert [r[0] for r in secrets.scan(df).select(S.written(F.col("spans"))).collect()] == ["github:0:40", "jwt:2:46", ""]
    assert secrets.scan(no_docs).count() == 0


# ---- personal data ----------------------------------------------------------------------------------------------


def test_personal_matches_brute_force(docs, rows):
    found = pii.find(docs)
    got = Counter((r[0], r[1]) for r in found.select("doc_id", S.written(S.by_kind(F.col("base")))).collect())
    assert got == Counter((r[0], ",".join(brute.personal(r[1]))) for r in rows)
    assert pii.find(docs.limit(0)).count() == 0


def test_context_discovers_unseen(spark):
    seeds = [(k, f"please write to contact: u{k}@mail.example.org today", 0) for k in range(6)]
    unseen = [(10, "please write to contact: user-77(at)mail today and the 5000000 others", 0), (11, "nothing here 123456 at all", 0)]
    found = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(seeds + unseen, "doc_id int, text string, spans int")).collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in found[10]] == [("context", 25, 40)]
    assert found[11] == [] and len(found[3]) == 1


def _contexts(spark, texts):
    """The marked contexts of each text, as they stand in it."""
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    return {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "context"] for r in found}


def test_context_taught_by_spans_of_several_tokens(spark):
    phones = [f"please call phone: +1 (017) 555-77{k:02} today" for k in range(6)]
    cards = [f"charge it to visa: 4111 1111 1111 1111{' ' * k} today" for k in range(2)] + ["to visa: 4012 8888 8888 1881 now", "to visa: 5500 0055 5555 5559 now"]
    unseen = ["please call phone: x1234 today", "charge it to visa: u77 u78 today", "phone 12 x5 at 3"]
    found = _contexts(spark, phones + cards + unseen)
    assert [found[k] for k in range(10)] == [[]] * 10
    assert [found[k] for k in range(10, 13)] == [["x1234"], ["u77"], []]


def test_context_behind_long_words_and_gaps(spark):
    word = "w" * 60
    texts = [f"mail {word} u{k}@mail.example.org today" for k in range(6)] + [f"mail ref:{' ' * 70}\t a{k}@mail.example.org today" for k in range(6)]
    unseen = [f"mail {word} known-1 today", f"mail ref:\n{' ' * 90}known-2 today", f"mail {word[:-1]} known-3 today"]
    found = _contexts(spark, texts + unseen)
    assert [found[k] for k in range(12, 15)] == [["known-1"], ["known-2"], []]


def test_context_spreads_through_discovered_instances(spark):
    texts = [f"write to contact: u{k}@mail.example.org today" for k in range(60)]
    texts += [f"write to contact: known-{k} today" for k in range(5)] + [f"booked on acct known-{k} today" for k in range(5)]
    found = _contexts(spark, texts + ["booked on acct further-9 today"])
    assert found[70] == ["further-9"] and found[62] == ["known-2"] and found[3] == []


def test_masking(spark):
    df = spark.createDataFrame([(1, "é a@b.example.org, +1 (555) 010-9999!"), (2, None), (3, "clean")], "doc_id int, text string")
    assert [r["text"] for r in pii.mask(df).orderBy("doc_id").collect()] == ["é <EMAIL>, <PHONE>!", None, "clean"]


# ---- repeats ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("window", (35, 8, 2))
def test_repeats_match_brute_force(docs, rows, window):
    left = substrings.remove_repeats(docs, window=window)
    got = Counter(tuple(r) for r in left.select("doc_id", "n_words", "n_removed", "kept").collect())
    assert got == Counter((r[0], *b) for r, b in zip(rows, brute.without_repeats([r[1] for r in rows], window)))


def test_difference_covers():
    for period, cover in substrings.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_repeats_empty(no_docs):
    assert substrings.remove_repeats(no_docs).count() == 0


# ---- fingerprints -----------------------------------------------------------------------------------------------


def test_prefix_hashes_answer_spans():
    a, b = (fingerprints.Prefixes(fingerprints.code_points(t), fingerprints.Powers()) for t in ("xxabcabcabd🙂", "abcabd🙂y"))
    assert a.equal(5, b, 0, 7) and not a.equal(2, b, 0, 6)
    assert (a.common(5, b, 0), a.common(2, b, 0), a.common(0, b, 7), a.common(12, b, 0)) == (7, 5, 0, 0)


@pytest.mark.parametrize("partitions", (1, 3, 40))
def test_fingerprints_match_brute_force(docs, rows, partitions):
    known = [r for r in rows if r[0] is not None]
    known = [r for k, r in enumerate(known) if r[0] not in {x[0] for x in known[:k]}]  # distinct ids: one order only
    ids = [r[0] for r in known]
    df = docs.filter(F.col("doc_id").isin(ids)).dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(df, partitions=partitions).collect()}
    ordered = sorted(known, key=lambda r: -r[0])
    by_text = {}
    for k, r in enumerate(ordered):
        text, following = r[1] or "", ordered[(k + 1) % len(ordered)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        row = got[r[0]]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == brute.sha(edited)
        assert by_text.setdefault(text, row["fingerprint"]) == row["fingerprint"]
        if edited == text:
            assert row["near_edited"] == 1.0
        elif r[0] < 60 and len(text) > 200:
            assert row["near_edited"] > row["near_next"]
    assert len(got) == len(known)


@pytest.mark.parametrize("long, short", ((82, 78), (80, 79), (81, 80), (16, 15), (17, 16), (20, 12), (90, 14)))
def test_texts_across_a_limit_compare(spark, long, short):
    text = "".join(chr(97 + k * k % 23 + k % 3) for k in range(long))
    found = {r["doc_id"]: r for r in fingerprints.fingerprints(spark.createDataFrame([(2, text), (1, text[:short])], "doc_id int, text string")).collect()}
    length = fingerprints.span_length(short)
    a, b = ({t[k : k + length] for k in range(len(t) - length + 1)} for t in (text, text[:short]))
    assert found[2]["near_next"] == pytest.approx(len(a & b) / len(a | b), abs=0.02) and found[2]["near_next"] > 0


def test_likeness_matches_brute_force(spark):
    """Texts with no more spans than are kept: the estimate is the exact share."""
    rows = [(k, ("abcde fghij klmno"[: 3 + k % 14] * 4)[: 5 + 3 * k]) for k in range(14)] + [(90, ""), (91, None), (92, "x")]
    found = {r["doc_id"]: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    ordered = sorted(rows, reverse=True)
    for k, (own, text) in enumerate(ordered):
        text, following = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        edited = text[: len(text) - len(text) // 3] + following[: len(text) // 3]
        for name, other in (("near_next", following), ("near_edited", edited)):
            length = fingerprints.span_length(min(len(text), len(other)))
            a, b = ({t[i : i + length] for i in range(len(t) - length + 1)} for t in (text, other))
            assert found[own][name] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_fingerprints_odd_rows(docs, rows, no_docs):
    assert fingerprints.fingerprints(docs).count() == len(rows)
    assert fingerprints.fingerprints(no_docs).count() == 0


# ---- languages --------------------------------------------------------------------------------------------------


def test_language_learns_and_rejects(docs, rows):
    model = language.fit(docs, rows=600)
    found = language.identify(docs, model).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        else:
            assert r["lang_pred"] in model.languages and 0 <= r["score"] <= 1
    sure = [r for r in found if r["lang"] and r["text"] and len(r["text"].split()) > 20 and "xxxx" not in r["text"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in sure]) > 0.9
    assert language.keep_identified(docs, model).columns == docs.columns


@pytest.mark.parametrize("wrong", (0, 25))
def test_language_rejects_what_it_never_learned(wrong):
    import random

    import pyarrow as pa
    from conftest import prose

    rng = random.Random(9)
    labelled = [(lang, prose(rng, lang, 40)) for lang in ("en", "fr", "de") for _ in range(200)]
    for k in range(wrong):  # wrong labels, spread over the languages
        lang, text = labelled[k * 24]
        labelled[k * 24] = ("fr" if lang == "en" else "en", text)
    model = language.train(labelled)
    assert model.threshold > 1 / 3

    def rejected(texts):
        return np.mean(model.scores(*language.text_bytes(pa.array(texts))).max(axis=1) < model.threshold)

    strange = "ки на мо ров ст ный ово пре жд".split()
    unlearned = [" ".join("".join(rng.choices(strange, k=3)) for _ in range(40)) for _ in range(100)]
    gibberish = ["".join(rng.choices("bcdfghjkmpqvwxz ", k=300)) for _ in range(100)]
    assert rejected([prose(rng, lang, 40) for lang in ("en", "fr", "de") for _ in range(100)]) < 0.05
    assert rejected(unlearned) > 0.9 and rejected(gibberish) > 0.9


def test_training_leaves_no_small_arrays():
    """Thousands of small arrays, freed, stay with the process; the buckets of all texts are in two long ones."""
    texts = ["Naïve text, naïve", "", "a", "ab ab", "x" * 700]
    bags = language._Bags(texts)
    assert all(bags.of(k)[0].base is bags.index for k in range(len(texts)))
    for k, text in enumerate(texts):
        data = language._LOWER[np.frombuffer(text.encode(), np.uint8)]
        count = Counter(b for order in language.ORDERS if len(data) >= order for b in language._buckets(data, order).tolist())
        index, share = bags.of(k)
        assert dict(zip(index.tolist(), share.tolist())) == {b: n / sum(count.values()) for b, n in count.items()}


def test_language_without_labels(docs, no_docs):
    assert language.fit(no_docs) is None
    found = language.identify(docs, None)
    assert found.filter("lang_pred <> 'und' or score <> 0").count() == 0


def test_language_chunks_change_nothing(docs, monkeypatch):
    import pyarrow as pa

    model = language.fit(docs, rows=300)
    texts = pa.array([r["text"] for r in docs.select("text").collect()])
    whole = model.scores(*language.text_bytes(texts))
    monkeypatch.setattr(language, "CHUNK", 50)
    assert np.allclose(whole, model.scores(*language.text_bytes(texts)))


# ---- pieces -----------------------------------------------------------------------------------------------------

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["Hello  world", "\n\nHi\tthere", "naïve 漢字 𝒳", " trail  ", "a\x00b", "x" * 300 + " " * 40 + "y", " " * 15, "a" + " " * 31, "é🙂🙂", "def f(a):\n    return  a"]


def test_ids_are_the_models_own(spark, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    both = docs.select("doc_id", "text", "ids").unionByName(spark.createDataFrame([(-1, t, "clash") for t in ODD], "doc_id bigint, text string, ids string"))
    found = pieces.encode(both, MODEL, check="n_chars")
    assert found.filter("NOT n_chars").count() == 0
    rows = found.withColumn("again", pieces.decoded(F.col("ids"), MODEL)).collect()
    assert len(rows) == both.count()
    for r in rows:
        assert r["ids"] == (None if r["text"] is None else model.encode(r["text"]))
        assert r["again"] == r["text"]
    assert pieces.encode(docs.limit(0), MODEL).count() == 0


def test_long_words_fold_alike():
    encoder, _ = pieces.coders_of(MODEL)
    word = np.array([[ord(c) for c in pieces.BLANK + "internationalisation"]], np.uint32)
    assert encoder.fold(word)[0].tolist() == encoder.fold_long(word[0]).tolist()


def test_small_batches_are_folded_together(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(pieces, "CHUNK", 4_000)
    texts = [None if k % 7 == 0 else f"row {k} " + "x" * (9_000 if k == 300 else 20) for k in range(600)]
    table = pa.table({"n": list(range(600)), "t": texts})
    found = list(pieces._gathered(iter(table.to_batches(max_chunksize=5)), 1))
    assert [v for b in found for v in b.column(1).to_pylist()] == texts and [v for b in found for v in b.column(0).to_pylist()] == list(range(600))
    assert len(found) < 12 and all(b.num_rows < 300 for b in found)
    assert list(pieces._gathered(iter([]), 0)) == []


def test_decoding_bad_bytes(spark):
    df = spark.createDataFrame([([3 + 0xC3],), ([],), (None,)], "ids array<int>")
    assert [r[0] for r in df.select(pieces.decoded(F.col("ids"), MODEL)).collect()] == ["�", "", None]


def test_viterbi_is_the_unigram_path(spark, docs):
    import sentencepiece

    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto()
    with open(MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback = 1, False
    for k, p in enumerate(proto.pieces):
        if p.type == 1:
            p.score = -float(int(np.sqrt(k)))  # whole numbers, which both sides add without rounding
        elif p.type == 6:
            p.type = 5  # no byte pieces
    model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    words = ["the", "thhandtion", "naïve", "inter漢national", "x", "unbelievably", None]
    asked = spark.createDataFrame([(pieces.BLANK + w if w else None,) for w in words], "word string")
    table = spark.createDataFrame([(p.piece, k, p.score) for k, p in enumerate(proto.pieces) if p.type == 1], "piece string, id int, score double")
    got = {r["word"]: [0 if i < 0 else i for i in r["ids"]] for r in pieces.viterbi(asked, table).collect()}
    score = lambda ids: sum(proto.pieces[i].score for i in ids)
    for w in words[:-1]:
        want = model.encode(w)
        assert got[pieces.BLANK + w] == want or score(got[pieces.BLANK + w]) == score(want)
