"""One query for each operator, over its whole table, and the SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm import exact, fingerprints, language, mixing, neighbours, pieces, pii, secrets, shards, simhash, spelling, substrings, whitening
from metricloom.llm import spans as S
from metricloom.llm.common import table

#: The public merge model that the encoder is asked for.
PIECE_MODEL = "piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def _secrets_sql() -> str:
    """Places of the matches from the lengths of the texts between them, as the operator counts them, by plain search of every text."""
    each = []
    for place, rule in enumerate(secrets.BASE + secrets.MORE):
        regex = rule.pattern.replace("'", "''")
        each.append(
            f"SELECT r, {place} AS place, '{rule.kind}' AS kind, {rule.least} AS least, string_split_regex(t, '{regex}') AS gaps, "
            f"regexp_extract_all(t, '{regex}') AS hits, regexp_extract_all(t, '{regex}', {rule.group}) AS parts FROM d WHERE regexp_matches(t, '{regex}')"
        )
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{rule.kind}') AS n_{rule.kind}" for rule in secrets.BASE)
    listed = "coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place){}, '')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    m AS ({" UNION ALL ".join(each)}),
    p AS (SELECT r, place, kind, least, gaps, hits, parts, unnest(range(1, len(hits) + 1)) AS i FROM m),
    q AS (SELECT r, place, kind, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS a, length(hits[i]) AS n
      FROM p WHERE length(parts[i]) >= least),
    s AS (SELECT r, place, kind, a::BIGINT AS a, (a + n)::BIGINT AS b FROM q)
    SELECT doc_id, {counts}, sha256({listed.format(f" FILTER (WHERE place < {len(secrets.BASE)})")}) AS base_sha256, {listed.format("")} AS spans
    FROM d LEFT JOIN s USING (r) GROUP BY r, doc_id"""


ORACLES["op1_secret_scan"] = _secrets_sql()


@query
def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(table(spark, folder, "documents", "doc_id", "text"))
    kinds = [rule.kind for rule in secrets.BASE]
    base = F.filter("spans", lambda s: s["place"] < len(kinds))
    counts = [S.count_of(F.col("spans"), kind).alias(f"n_{kind}") for kind in kinds]
    return found.select("doc_id", *counts, F.sha2(S.written(base), 256).alias("base_sha256"), S.written(F.col("spans")).alias("spans"))


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECE_MODEL)


@query
def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text back."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    found = pieces.encode(docs, piece_model(), check="round_trip", keep_text=False)
    return found.select("doc_id", F.size("ids").alias("n_ids"), "ids", "round_trip")


@query
def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    left = substrings.remove_repeats(table(spark, folder, "documents", "doc_id", "text"), window=35)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, folder, "documents", "doc_id", "text"))


@query
def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    found = mixing.mix(table(spark, folder, "documents", "doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


@query
def op6_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(table(spark, folder, "documents", "doc_id", "text"))
    counts = [S.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS[:4]]
    base, spans = (S.written(S.by_kind(F.col(c))) for c in ("base", "spans"))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"))


@query
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Learned from the rows whose crc32 of the id leaves a remainder other than 1 by 3."""
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = language.fit(docs.filter(F.col("doc_id").isNotNull() & ~held_out))
    found = language.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query
def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Law `bytes`: sizes as near equal as groups of equal texts let them be."""
    found = shards.assign(table(spark, folder, "documents", "doc_id", "text"), shards=40)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents", "doc_id", "text"), shingle=3)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


@query
def op10_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 20."""
    return neighbours.nearest(table(spark, folder, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0)


@query
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    counted = spelling.count_words(table(spark, folder, "documents", "doc_id", "text"), least=7, slips=31)
    return spelling.group_variants(counted.filter("n >= 2"), ratio=10)


ORACLES["op12_exact_dedup"] = """WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
      row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
    FROM d WINDOW same AS (PARTITION BY t)"""


@query
def op12_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.groups(table(spark, folder, "documents", "doc_id", "text"))


@query
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each vector and each of the first eight components."""
    return whitening.by_component(whitening.whiten(table(spark, folder, "embeddings", "vec_id", "embedding"), components=8))
