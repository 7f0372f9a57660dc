"""Personal data: fixed patterns as seeds, and identifiers found by the contexts that the seeds teach.

Base: mail addresses, network addresses, card numbers with a valid check digit and telephone numbers. Their matches are seeds.

Bootstrapping: every base span is an instance, whatever number of tokens it covers, and so is every other token that holds a digit or an at sign; the word
before the (first) token is its pattern, also if that word is an instance itself. The graph of patterns and instances is counted once. A seed's score is 1. In each round the confidence of a pattern is the score that it
leads to, divided by all its occurrences in the corpus, before whatever word; patterns with enough distinct positive
instances and enough confidence are accepted, and an instance takes the highest confidence among its accepted patterns. After the last round,
the instances that are no seeds and reach the confidence are marked wherever they occur, as kind ``context``, if they have
``shortest`` characters (1: all of them); instances of any length are scored.

Cases: a null text counts as empty. Repeated rows get a row each and the same spans. An empty table gives no rows. Columns
of the table that are not named are ignored. Overlapping spans are all listed; masking merges them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm import spans as S
from metricloom.llm.common import column, fresh, words
from metricloom.session import materialize

#: Kinds in their fixed order, with the kind that this operator adds.
KINDS = ("email", "ip", "card", "phone", "context")

# A look-behind keeps a search from starting again inside a run of the same characters; after a match (\G) it may.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Tokens with a digit or an at sign.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: What may surround an identifier inside its token.
TRIM = "\"'()[]{}<>,;:.!?"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the last digit is the check digit of the others."""

    def add(total: Column, k: Column) -> Column:
        d = F.substring(digits, F.length(digits) - k + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(k % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _card(hit: Column, _: Column) -> Column:
    n = F.length(_digits(hit))
    return F.when(n.between(13, 19), luhn(_digits(hit))).otherwise(False)


def _phone(hit: Column, _: Column) -> Column:
    return F.length(_digits(hit)).between(9, 15)


def _ip(hit: Column, _: Column) -> Column:
    return F.forall(F.split(hit, r"\."), lambda p: p.cast("double") <= 255)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, as (start, place, end, kind)."""
    found = (
        F.when(F.contains(text, F.lit("@")), S.matches(text, EMAIL)).otherwise(S.nothing()),
        S.matches(text, IP, _ip),
        S.matches(text, CARD, _card),
        F.when(F.contains(text, F.lit("+")), S.matches(text, PHONE, _phone)).otherwise(S.nothing()),
    )
    return F.concat(*[S.labelled(kind, place, f) for place, (kind, f) in enumerate(zip(KINDS, found))])


def _instances(tokens: Column, base: Column) -> Column:
    """Base spans and other tokens with a digit or an at sign: place, bare form, word before, whether it is a base span.

    A base span begins in one of the tokens and may go on in others, which are no instances of their own.
    """

    def describe(s: Column, at: Column) -> Column:
        begun = F.filter(base, lambda b: (b["start"] >= s["start"]) & (b["start"] < s["end"]))
        touched = F.exists(base, lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"]))
        until = F.array_max(F.transform(begun, lambda b: b["end"]))
        covered = F.array_join(F.transform(F.filter(tokens, lambda x: (x["start"] >= s["start"]) & (x["start"] < until)), lambda x: x["hit"]), " ")
        bare = F.btrim(F.when(F.size(begun) > 0, covered).otherwise(s["hit"]), F.lit(TRIM))
        lead = F.length(s["hit"]) - F.length(F.ltrim(s["hit"], F.lit(TRIM)))
        start = s["start"] + lead
        last = F.get(tokens, at - 1)  # the word before where only blanks lie between
        left = F.when(s["before"] == " ", F.coalesce(last["hit"], F.lit(""))).otherwise(F.rtrim(s["before"]))
        return F.struct(
            start.alias("start"), (start + F.length(bare)).alias("end"), bare.alias("token"),
            F.lower(left).alias("left"), touched.alias("seed"), (touched & (F.size(begun) == 0)).alias("within"),
        )

    return F.filter(F.transform(tokens, describe), lambda h: ~h["within"])


def _marked(df: DataFrame, row_id: str, text: str) -> DataFrame:
    whole = F.coalesce(column(df, text), F.lit(""))
    own = df.select(column(df, row_id).alias("id"), F.xxhash64(whole).alias("seen"), whole.alias("t"))
    based = own.select("id", "seen", base_spans(F.col("t")).alias("base"), S.matches(F.col("t"), TOKEN, before=True).alias("tokens"))
    return materialize(based.select("id", "seen", "base", _instances(F.col("tokens"), F.col("base")).alias("held")))


def contextual(df: DataFrame, marked: DataFrame, text: str, *, rounds: int = 2, confidence: float = 0.5, support: int = 3, shortest: int = 1) -> DataFrame:
    """``id, seen, extra``: spans of the instances that accepted patterns discover."""
    seen = marked.select("id", "seen", F.explode("held").alias("h")).select("id", "seen", "h.*").filter("token <> ''")
    edges = seen.filter(F.col("left") != "").groupBy("left", "token").agg(F.count("*").alias("n"), F.max(F.col("seed").cast("double")).alias("score"))
    edges = materialize(edges)
    # A pattern before fewer different instances can never have enough positive ones, in whatever round.
    lefts = edges.groupBy("left").agg(F.count("*").alias("instances")).filter(F.col("instances") >= support).select("left")
    spoken = df.select(F.explode(words(F.lower(column(df, text)))).alias("left")).groupBy("left").agg(F.count("*").alias("total"))
    totals = materialize(spoken.join(lefts, "left"))
    tokens = materialize(edges.groupBy("token").agg(F.max("score").alias("score")))
    for _ in range(rounds):
        judged = edges.select("left", "token", "n").join(tokens, "token")
        sums = judged.groupBy("left").agg(F.sum(F.col("n") * F.col("score")).alias("hit"), F.count_if(F.col("score") > 0).alias("support"))
        trust = F.least(F.col("hit") / F.col("total"), F.lit(1.0))
        accepted = sums.join(totals, "left").select("left", trust.alias("trust"), "support")
        accepted = accepted.filter((F.col("support") >= support) & (F.col("trust") >= confidence))
        reached = edges.select("left", "token").join(accepted, "left").groupBy("token").agg(F.max("trust").alias("trust"))
        tokens = materialize(tokens.join(reached, "token", "left").select("token", F.greatest("score", F.coalesce("trust", F.lit(0.0))).alias("score")))
    found = tokens.filter((F.col("score") >= confidence) & (F.col("score") < 1)).select("token")
    certain = edges.filter("score < 1").select("token").distinct().join(tokens.filter("score >= 1"), "token", "left_semi")  # trusted fully
    found = found.unionByName(certain.select("token")).distinct()
    places = seen.filter(~F.col("seed") & (F.length("token") >= shortest)).join(found, "token")
    span = F.struct(F.col("start"), F.lit(KINDS.index("context")).alias("place"), F.col("end"), F.lit("context").alias("kind"))
    return places.groupBy("id", "seen").agg(F.collect_set(span).alias("extra"))


def find(df: DataFrame, row_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``row_id, base, spans`` for every row, spans as (start, place, end, kind)."""
    marked = _marked(df, row_id, text)
    extra = contextual(df, marked, text, **options).withColumnsRenamed({"id": "_id", "seen": "_seen"})
    joined = marked.join(extra, marked["id"].eqNullSafe(extra["_id"]) & (marked["seen"] == extra["_seen"]), "left")
    spans = F.concat("base", F.coalesce("extra", F.array().cast(marked.schema["base"].dataType)))
    return joined.select(F.col("id").alias(row_id), "base", spans.alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlapping spans are one."""

    def step(state: Column, s: Column) -> Column:
        mark = F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        between = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        apart = s["start"] >= state["at"]
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(apart, F.concat(state["out"], between, mark)).otherwise(state["out"]).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(S.by_start(spans), first, step)
    rest = F.substring(text, done["at"] + 1, F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], rest))


def mask(df: DataFrame, row_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``df`` with personal data in the text masked."""
    marked = _marked(df, row_id, text)
    extra = materialize(contextual(df, marked, text, **options).withColumnsRenamed({"id": "_id", "seen": "_seen"}))
    whole = F.coalesce(column(df, text), F.lit(""))
    spans = base_spans(whole)
    own = df
    if not extra.isEmpty():
        key = fresh(df, "seen")
        own = df.withColumn(key, F.xxhash64(whole))
        own = own.join(extra, own[row_id].eqNullSafe(extra["_id"]) & (own[key] == extra["_seen"]), "left")
        spans = F.concat(spans, F.coalesce("extra", F.array().cast(marked.schema["base"].dataType)))
    hidden = F.when(column(df, text).isNotNull(), masked(whole, spans))
    return own.withColumn(text, hidden).select(*[column(own, c) for c in df.columns])
