"""The registered queries and the pipeline, stage by stage."""

import os

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from metricloom.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = docs.limit(3).withColumns({"doc_id": F.lit(None).cast("bigint"), "text": F.lit(None).cast("string")})
    docs.unionByName(odd).unionByName(docs.limit(2)).write.parquet(f"{folder}/in")
    out = [spark.read.parquet(f"{folder}/in")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], FOLDER).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def test_stages_keep_the_columns(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_language_keeps_clean_documents(stages):
    kept = {r[0] for r in stages[1].select("doc_id").collect()}
    assert None not in kept and len(kept) >= 198


def test_one_of_each_group_stays(stages):
    rows = stages[1].select("doc_id", "text").collect()
    kept = [r[0] for r in stages[2].select("doc_id").collect()]
    assert len(kept) == len(set(kept))

    def shingles(text):
        w = brute.words(text.lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {r[0]: shingles(r[1]) for r in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for i, a in enumerate(kept):
        for b in kept[:i]:
            assert alike(a, b) < 0.82
    for gone in set(sets) - set(kept):
        assert max(alike(gone, x) for x in sets if x != gone) > 0.7


def test_personal_data_is_masked(stages):
    before = {r[0]: r[1] for r in stages[2].select("doc_id", "text").collect()}
    after = {r[0]: r[1] for r in stages[3].select("doc_id", "text").collect()}
    assert before.keys() == after.keys()
    for k, text in before.items():
        assert not [s for s in brute.personal(after[k]) if s in brute.personal(text)]
        assert (after[k] == text) == (not brute.personal(text))


def test_mix_takes_what_it_says(stages):
    before = sum(len(brute.words(r[0])) for r in stages[3].select("text").collect())
    after = sum(len(brute.words(r[0])) for r in stages[4].select("text").collect())
    assert abs(after - 1.5 * before) < 0.01 * before


def test_encoding_loses_nothing(stages):
    assert stages[5].count() == stages[4].count()
    assert stages[5].filter("not round_trip").count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))
