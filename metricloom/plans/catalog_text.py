"""Text, privacy, hashing and claim queries (TXT, PII, HSH, CLM)."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.functions import pii
from metricloom.operators import claims, digests, privacy, textmine
from metricloom.plans.catalog_metrics import ORDER_METRICS, order_metrics
from metricloom.plans.registry import query

STOP = ", ".join(f"'{w}'" for w in textmine.STOPWORDS)


def toks_sql(table="documents", key="doc_id", where="true"):
    return f"""tok AS (SELECT {key} AS place, regexp_extract_all(replace(strip_accents(lower(text)), 'đ', 'd'), '[a-z][a-z0-9_]*|-?[0-9][0-9.,]*%?') AS t FROM {table} WHERE {where}),
    pos AS (SELECT place, unnest(range(len(t))) AS pos, unnest(t) AS term FROM tok),
    subj AS (SELECT place, pos, term FROM pos WHERE length(term) >= 2 AND NOT regexp_matches(term, '^-?[0-9]') AND term NOT IN ({STOP}))"""


TERMS = f"""{toks_sql()},
    total AS (SELECT count(*)::DOUBLE AS n FROM subj),
    fig AS (SELECT place, pos FROM pos WHERE regexp_matches(term, '^-?[0-9]')),
    near AS (SELECT DISTINCT s.place, s.pos FROM subj s JOIN fig f ON f.place = s.place AND f.pos BETWEEN s.pos - 25 AND s.pos + 25),
    flagged AS (SELECT s.place, s.pos, s.term, n.pos IS NOT NULL AS near FROM subj s LEFT JOIN near n ON n.place = s.place AND n.pos = s.pos),
    words AS (SELECT term, count(*) AS count, bool_or(near) AS near_figure FROM flagged GROUP BY 1),
    adj AS (SELECT term AS l, lead(term) OVER w AS r, near, pos, lead(pos) OVER w AS npos FROM flagged WINDOW w AS (PARTITION BY place ORDER BY pos)),
    pairs AS (SELECT l, r, count(*) AS count, bool_or(near) AS near_figure FROM adj WHERE npos = pos + 1 AND l <> r GROUP BY 1, 2),
    phrases AS (SELECT p.l || ' ' || p.r AS term, p.l, p.r, p.count, p.near_figure FROM pairs p LEFT JOIN pairs m ON m.l = p.r AND m.r = p.l WHERE p.count >= 2 AND p.count >= coalesce(m.count, 0)),
    inside AS (SELECT term, sum(count) AS n FROM (SELECT l AS term, count FROM phrases UNION ALL SELECT r, count FROM phrases) GROUP BY 1),
    allterms AS (SELECT w.term, false AS is_phrase, count, near_figure FROM words w LEFT JOIN inside i USING (term) WHERE i.n IS NULL OR i.n < count UNION ALL SELECT term, true, count, near_figure FROM phrases),
    terms AS (SELECT term, is_phrase, count, round(count / n, 4) AS share, CASE WHEN count / n >= 0.05 THEN 'nen' WHEN count <= 3 THEN 'hiem' ELSE 'vua' END AS band, near_figure FROM allterms, total),
    b AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY is_phrase DESC, near_figure DESC, count DESC, term) AS at_band FROM terms),
    first AS (SELECT * FROM b WHERE at_band <= 13),
    rest AS (SELECT * FROM b WHERE at_band > 13 ORDER BY is_phrase DESC, near_figure DESC, count DESC, term LIMIT (SELECT 40 - count(*) FROM first)),
    shown AS (SELECT * FROM first UNION ALL SELECT * FROM rest)"""


@query("txt1_tokens", f"WITH {toks_sql()} SELECT place, pos::INT AS pos, term FROM subj")
def _(t):
    return textmine.word_positions(t.documents, "doc_id", "text")


@query("txt2_term_counts", f"WITH {TERMS} SELECT term, count, near_figure FROM words")
def _(t):
    return textmine.word_counts(t.documents, "doc_id", "text")


@query("txt3_phrases", f"WITH {TERMS} SELECT term, count, near_figure FROM phrases")
def _(t):
    return textmine.phrase_counts(t.documents, "doc_id", "text").select("term", "count", "near_figure")


@query("txt3_terms", f"WITH {TERMS} SELECT term, is_phrase, count, share, band FROM terms")
def _(t):
    return textmine.read(t.documents, "doc_id", "text").terms.select("term", "is_phrase", "count", "share", "band")


CHOSEN = ["tion", "re", "email", "the re"]
FIGURES = f"""{TERMS}, occ AS (SELECT place, pos, term FROM subj WHERE term IN ('tion', 're', 'email'))"""


@query(
    "txt4_figures_near",
    f"""WITH {FIGURES} SELECT o.term, p.term AS number, count(DISTINCT o.place) AS places FROM occ o JOIN pos p ON p.place = o.place AND p.pos BETWEEN o.pos - 25 AND o.pos + 25
    WHERE regexp_matches(p.term, '^-?[0-9]') GROUP BY 1, 2""",
)
def _(t):
    return textmine.figures_near(t.documents, "doc_id", "text", ["tion", "re", "email"])


@query(
    "txt5_mentions",
    f"""WITH {FIGURES}, m AS (SELECT term, place, row_number() OVER (PARTITION BY term ORDER BY place) AS rank FROM occ GROUP BY 1, 2)
    SELECT m.term, rank, m.place, (SELECT count(DISTINCT p.term) FROM occ o JOIN pos p ON p.place = o.place AND p.pos BETWEEN o.pos - 25 AND o.pos + 25 WHERE o.term = m.term AND o.place = m.place AND regexp_matches(p.term, '^-?[0-9]')) AS figures
    FROM m WHERE rank <= 20""",
)
def _(t):
    out = textmine.mentions(t.documents, "doc_id", "text", ["tion", "re", "email"])
    return out.select("term", "rank", "place", F.size("numbers").alias("figures"))


@query("txt6_share_out", f"WITH {TERMS} SELECT term, is_phrase, count, share, band FROM shown")
def _(t):
    return textmine.share_out(textmine.read(t.documents, "doc_id", "text").terms).select("term", "is_phrase", "count", "share", "band")


@query(
    "txt7_lift",
    f"""WITH {toks_sql()}, g AS (SELECT term, quality = 1 AS inside, count(*) AS n FROM subj JOIN labels ON place = doc_id GROUP BY 1, 2),
    w AS (SELECT inside, sum(n)::DOUBLE AS w FROM g GROUP BY 1), s AS (SELECT term, inside, round(n / w, 4) AS share FROM g JOIN w USING (inside))
    SELECT a.term, round(a.share / (coalesce(b.share, 0) + 1 / (SELECT w FROM w WHERE NOT inside)), 2) AS lift FROM s a LEFT JOIN s b ON b.term = a.term AND NOT b.inside WHERE a.inside""",
)
def _(t):
    df = t.documents.join(t.labels, "doc_id")
    sides = []
    for side in (1, 0):
        words = textmine.word_counts(df.filter(F.col("quality") == side), "doc_id", "text")
        total = words.agg(F.sum("count")).first()[0] or 0
        sides.append((words.select("term", F.round(F.col("count") / total, 4).alias("share")), total))
    return textmine.lift(sides[0][0], sides[1][0], sides[1][1])


@query("txt8_mentions_table")
def _(t):
    reading = textmine.read(t.documents, "doc_id", "text")
    top = [r["term"] for r in textmine.share_out(reading.terms).orderBy(F.desc("count"), "term").limit(5).collect()]
    return textmine.mentions_table(t.documents, "doc_id", "text", reading, top)


@query("txt9_group_against_rest")
def _(t):
    df = t.documents.join(t.labels, "doc_id")
    return textmine.read_column(df, "doc_id", "text", inside=F.col("quality") == 1).select("key", "value")


@query(
    "txt10_metrics",
    f"""WITH {TERMS}, top AS (SELECT *, trim(regexp_replace(term, '[^a-z0-9]+', '_', 'g'), '_') AS s FROM shown ORDER BY count DESC, term LIMIT 20)
    SELECT 'text.words.total' AS key, n AS value FROM total UNION ALL SELECT 'text.terms.distinct', count(*) FROM words
    UNION ALL SELECT 'term.' || s || '.count', count FROM top UNION ALL SELECT 'term.' || s || '.share', round(share * 100, 2) FROM top""",
)
def _(t):
    return textmine.read_column(t.documents, "doc_id", "text").select("key", "value")


QUESTION = "The retitioning of the hention and the estion in the oredat"
QSTOP = ", ".join(f"'{w}'" for w in textmine.QUESTION_STOPWORDS)
GRAMS = f"""docs AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT NULL, '{QUESTION}'),
    w AS (SELECT id, text, list_filter(regexp_extract_all(replace(strip_accents(lower(text)), 'đ', 'd'), '[a-z0-9_]+'), lambda x: length(x) > 1 AND x NOT IN ({QSTOP})) AS w FROM docs),
    g AS (SELECT id, unnest(w) AS gram FROM w UNION ALL SELECT id, w[i] || ' ' || w[i + 1] FROM w, LATERAL (SELECT unnest(range(1, len(w))) AS i)),
    tf AS (SELECT id, gram, count(*) AS tf FROM g GROUP BY 1, 2), df AS (SELECT gram, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n FROM docs),
    x AS (SELECT id, gram, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (gram), n),
    q AS (SELECT gram, w AS q FROM x WHERE id IS NULL), qn AS (SELECT sqrt(sum(q * q)) AS n FROM q),
    s AS (SELECT id, sum(x.w * coalesce(q, 0)) / (sqrt(sum(x.w * x.w)) * (SELECT n FROM qn)) AS score FROM x LEFT JOIN q USING (gram) WHERE id IS NOT NULL GROUP BY 1),
    j AS (SELECT doc_id, coalesce(score, 0) AS score, strip_accents(text) = nfc_normalize(text) AS checked FROM documents LEFT JOIN s ON id = doc_id)"""


@query(
    "txt11_relevance",
    f"""WITH {GRAMS} SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN checked THEN round(score, 4) ELSE 0 END AS score, CASE WHEN checked THEN score >= 0.25 ELSE true END AS kept, checked FROM j""",
)
def _(t):
    return textmine.relevance(t.documents, "doc_id", "text", QUESTION)


# --- personal data --------------------------------------------------------------


@query("pii1_find")
def _(t):
    return privacy.find_pii(t.documents, "doc_id", "text")


@query(
    "pii1_emails",
    r"""SELECT doc_id, unnest(regexp_extract_all(text, '\b[a-zA-Z0-9_.%+-]+@[a-zA-Z0-9_.-]+\.[A-Za-z]{2,}\b')) AS value FROM documents""",
)
def _(t):
    return privacy.find_pii(t.documents, "doc_id", "text").filter("kind = 'EMAIL'").select("doc_id", "value")


@query("pii1_kinds")
def _(t):
    return privacy.pii_kinds(t.documents, "doc_id", "text").select("doc_id", F.array_join("kinds", ",").alias("kinds"))


@query("pii2_tokens")
def _(t):
    return privacy.token_table(t.documents, "doc_id", ["text"])


@query(
    "pii2_email_tokens",
    r"""WITH h AS (SELECT doc_id, regexp_extract_all(text, '\b[a-zA-Z0-9_.%+-]+@[a-zA-Z0-9_.-]+\.[A-Za-z]{2,}\b') AS v FROM documents),
    e AS (SELECT doc_id, unnest(range(len(v))) AS place, unnest(v) AS value FROM h), f AS (SELECT value, min((doc_id, place)) AS first FROM e GROUP BY 1)
    SELECT value, '<EMAIL_' || row_number() OVER (ORDER BY first) || '>' AS token FROM f""",
)
def _(t):
    return privacy.token_table(t.documents, "doc_id", ["text"]).filter("kind = 'EMAIL'").select("value", "token")


@query("pii2_masked_rows")
def _(t):
    return privacy.mask_rows(t.documents.select("doc_id", "text"), "doc_id", ["text"])


@query("pii3_leaks_after_masking", "SELECT 'text' AS \"column\", 'EMAIL' AS kind, 0 AS cells FROM documents WHERE false")
def _(t):
    return privacy.leaks(privacy.mask_rows(t.documents.select("doc_id", "text"), "doc_id", ["text"]), ["text"])


@query("pii3_leaks", r"""SELECT 'text' AS "column", 'EMAIL' AS kind, count(*) AS cells FROM documents WHERE regexp_matches(text, '\b[a-zA-Z0-9_.%+-]+@[a-zA-Z0-9_.-]+\.[A-Za-z]{2,}\b')""")
def _(t):
    return privacy.leaks(t.documents, ["text"]).filter("kind = 'EMAIL'")


@query("pii4_safe_sample")
def _(t):
    people = t.documents.withColumn("email", F.regexp_extract("text", pii.pattern("EMAIL"), 0))
    _, rows = privacy.safe_sample(people, "doc_id", ["email", "source"])
    return rows


@query(
    "pii4_statistics",
    """SELECT c AS "column", n AS row_count, d AS "distinct" FROM (SELECT 'c_custkey' AS c, count(*) AS n, count(DISTINCT c_custkey) AS d FROM customer
    UNION ALL SELECT 'c_name', count(*), count(DISTINCT c_name) FROM customer UNION ALL SELECT 'c_nationkey', count(*), count(DISTINCT c_nationkey) FROM customer
    UNION ALL SELECT 'c_acctbal', count(*), count(DISTINCT c_acctbal) FROM customer UNION ALL SELECT 'c_mktsegment', count(*), count(DISTINCT c_mktsegment) FROM customer)""",
)
def _(t):
    stats, _ = privacy.safe_sample(t.customer, "c_custkey", ["c_name"])
    return stats.select("column", "row_count", "distinct")


# --- hashing ---------------------------------------------------------------------

CELL = "replace(replace(replace(replace({0}, chr(92), chr(92) || chr(92)), chr(9), chr(92) || 't'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r')"


@query(
    "hsh1_row_digests",
    """SELECT sha256(concat_ws(chr(9), format('{:.10g}', c_acctbal), CAST(c_custkey AS VARCHAR), c_mktsegment, c_name, CAST(c_nationkey AS VARCHAR))) AS digest FROM customer""",
)
def _(t):
    return digests.row_digests(t.customer)


@query(
    "hsh1_content_hash",
    f"""WITH d AS (SELECT sha256(concat_ws(chr(9), CAST(doc_id AS VARCHAR), lang, CAST(n_chars AS VARCHAR), source, {CELL.format("text")})) AS h FROM documents),
    s AS (SELECT count(*) AS rows, {", ".join(f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::UBIGINT::HUGEINT) AS s{i}" for i in range(4))} FROM d)
    SELECT rows, sha256('doc_id' || chr(9) || 'lang' || chr(9) || 'n_chars' || chr(9) || 'source' || chr(9) || 'text' || '|' || rows || '|' || s0 || '|' || s1 || '|' || s2 || '|' || s3) AS content FROM s""",
)
def _(t):
    return digests.content_hash(t.documents)


# --- claims ----------------------------------------------------------------------

# One templated claim per order and per kind of mistake, so the batch grows with the table.
CLAIM_KINDS = (
    ("{o_totalprice.mean} is the mean over {rows.total}", "o_totalprice.mean,rows.total", "orders", 0.9),
    ("the mean is 17", "", "orders", 0.9),
    ("group 1-URGENT has {o_totalprice.mean.by.o_orderpriority.1-URGENT}", "", "orders", 0.9),
    ("{o_totalprice.missing} was not measured", "", "orders", 0.9),
    ("{rows.total} rows", "o_totalprice.mean", "orders", 0.9),
    ("{rows.total} rows", "rows.total", "", 0.9),
    ("{rows.total} rows", "rows.total", "orders", 1.5),
    ("{o_totalprice.corr.with.o_custkey} causes the price", "", "orders", 0.5),
    ("{o_totalprice.mean} with an anova", "", "orders", 0.5),
    ("group {ten:o_totalprice.mean.by.o_orderstatus.F} is highest with {o_totalprice.mean.by.o_orderstatus.F}", "", "orders", 0.5),
    ("group {ten:o_totalprice.mean.by.o_orderstatus.O} is highest with {o_totalprice.mean.by.o_orderstatus.O}", "", "orders", 0.5),
    ("group {ten:o_totalprice.mean.by.o_orderstatus.P} is highest with {o_totalprice.mean.by.o_orderstatus.P}", "", "orders", 0.5),
    ("{ten:rows.total} is no group, {rows.total}", "", "orders", 0.5),
)


def claim_batch(t):
    kinds = F.array(*[F.struct(F.lit(a).alias("template"), F.lit(b).alias("keys"), F.lit(c).alias("evidence"), F.lit(float(d)).alias("confidence")) for a, b, c, d in CLAIM_KINDS])
    k = F.element_at(kinds, (F.col("o_orderkey") % len(CLAIM_KINDS) + 1).cast("int"))
    keys = F.filter(F.split(k["keys"], ","), lambda x: x != "")
    return t.orders.select(F.col("o_orderkey").alias("claim_id"), k["template"].alias("template"), keys.alias("metric_keys"), k["evidence"].alias("evidence"), k["confidence"].alias("confidence"))


_EXPECTED = {1: "typed figure", 3: "unknown metric", 4: "declared keys differ", 5: "no evidence", 6: "confidence outside 0..1", 12: "not a group name"}
CLAIM_SQL = f"""{ORDER_METRICS}, best AS (SELECT grp FROM m WHERE measure = 'o_totalprice' AND dim = 'o_orderstatus' ORDER BY round(value, 4) DESC, grp LIMIT 1),
    p AS (SELECT o_orderkey AS claim_id, o_orderkey % {len(CLAIM_KINDS)} AS k FROM orders),
    problems AS (SELECT claim_id, CASE k {" ".join(f"WHEN {k} THEN '{v}'" for k, v in _EXPECTED.items())} END AS problem FROM p WHERE k IN ({", ".join(map(str, _EXPECTED))})
      UNION ALL SELECT claim_id, 'no metric cited' FROM p WHERE k = 1
      UNION ALL SELECT claim_id, 'unknown metric' FROM p WHERE k = 7 UNION ALL SELECT claim_id, 'causal wording' FROM p WHERE k = 7
      UNION ALL SELECT claim_id, 'test never run' FROM p WHERE k = 8
      UNION ALL SELECT claim_id, 'wrong extreme' FROM p, best WHERE k IN (9, 10, 11) AND CASE k WHEN 9 THEN 'F' WHEN 10 THEN 'O' ELSE 'P' END <> grp)"""


@query("clm1_check_claims", f"WITH {CLAIM_SQL} SELECT claim_id, problem FROM problems")
def _(t):
    return claims.check_claims(claim_batch(t), order_metrics(t)).select("claim_id", "problem")


@query("clm2_wrong_extremes", f"WITH {CLAIM_SQL} SELECT claim_id FROM problems WHERE problem = 'wrong extreme'")
def _(t):
    batch, metrics = claim_batch(t), order_metrics(t)
    return claims.wrong_extremes(batch, metrics, claims.resolved(batch, metrics)).select("claim_id")


@query("clm3_wording", f"WITH {CLAIM_SQL} SELECT claim_id, problem FROM problems WHERE problem IN ('causal wording', 'test never run')")
def _(t):
    return claims.wording(claim_batch(t)).select("claim_id", "problem")


@query(
    "clm4_render",
    f"""WITH {CLAIM_SQL}, v AS (SELECT max(value) FILTER (WHERE key = 'rows.total') AS n, max(value) FILTER (WHERE key = 'o_totalprice.mean') AS mean,
      max(value) FILTER (WHERE key = 'o_totalprice.mean.by.o_orderpriority.1-URGENT') AS urgent, max(value) FILTER (WHERE measure = 'o_totalprice' AND dim = 'o_orderstatus') AS best FROM (SELECT key, measure, dim, round(value, 4) AS value FROM m))
    SELECT claim_id, CASE k WHEN 0 THEN format('{{:,.2f}}', mean) || ' is the mean over ' || format('{{:,.0f}}', n) || ' row'
      WHEN 2 THEN 'group 1-URGENT has ' || format('{{:,.2f}}', urgent) ELSE 'group ' || (SELECT grp FROM best) || ' is highest with ' || format('{{:,.2f}}', best) END AS claim
    FROM p, v WHERE claim_id NOT IN (SELECT claim_id FROM problems)""",
)
def _(t):
    return claims.render(claim_batch(t), order_metrics(t))


@query("clm5_untouched", """SELECT * FROM (VALUES ('o_custkey')) v("column") WHERE (SELECT count(*) FROM orders) > 13""")
def _(t):
    wanted = t.spark.createDataFrame([("o_totalprice",), ("o_orderstatus",), ("o_custkey",)], "column string")
    return claims.untouched(claim_batch(t), order_metrics(t), wanted)
