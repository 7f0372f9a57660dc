"""Secret scan over a trigram inverted index.

From the parse tree of each rule's regular expression a Boolean query over trigrams is derived: literal stretches
must occur, alternatives are joined by or, anything else asks for nothing. The index lists, for every trigram that some rule
asks for, the texts that hold it (lower-cased, by a hash of the text, so copies share one posting). The postings of a
text are brought together, a rule whose query they satisfy makes it a candidate, and only candidates are searched
with the expression itself. Rules without a mandatory trigram search every text.

Cases: a null text counts as empty and has no spans. Repeated rows and equal texts share postings and get a row each.
An empty table gives no rows. All columns of the table are kept; of those added here, one with a taken name replaces it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm import spans as S
from metricloom.llm.common import column, fresh

parser = re._parser

#: Strings that a literal stretch may fan out to before it is treated as unknown.
FAN = 64

Query = frozenset[frozenset[str]]  # any of these sets of trigrams, all of a set
ANYTHING: Query = frozenset([frozenset()])


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a Java and Python expression; matches whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Fixed by the contract of the query.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Formats of widely used tokens, added by this operator.
MORE = (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abpr]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
)


def _all(a: Query, b: Query) -> Query:
    return _least(x | y for x, y in product(a, b))


def _least(clauses) -> Query:
    """Without clauses that another one implies."""
    clauses = set(clauses)
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _asked(strings: set[str]) -> Query:
    return _least(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _walk(nodes) -> tuple[set[str] | None, Query]:
    """The exact strings a sequence can match, or None and the trigrams that it needs."""
    run, need, exact = {""}, ANYTHING, True
    for op, arg in nodes:
        name, strings, inner = str(op), None, ANYTHING
        if name == "LITERAL":
            strings = {chr(arg).lower()}
        elif name == "IN":
            strings = _members(arg)
        elif name == "SUBPATTERN":
            strings, inner = _walk(arg[-1])
        elif name == "BRANCH":
            parts = [_walk(x) for x in arg[1]]
            if all(p[0] is not None for p in parts):
                strings = set().union(*(p[0] for p in parts))
            else:
                inner = _least(c for p in parts for c in (p[1] if p[0] is None else _asked(p[0])))
        elif name.endswith("REPEAT"):
            low, high, sub = arg
            once, under = _walk(sub)
            if (low, high) == (0, 1) and once is not None:
                strings = once | {""}
            elif low == high == 1:
                strings, inner = once, under
            elif low:
                inner = under if once is None else _asked(once)
                if once is not None and len({a + b for a in run for b in once}) <= FAN:  # once for sure, then unknown
                    need, run, exact = _all(need, _asked({a + b for a in run for b in once})), {""}, False
                    continue
        elif name == "AT":
            continue
        joined = {a + b for a in run for b in strings} if strings is not None else None
        if joined is not None and len(joined) <= FAN:
            run = joined
        else:
            need, run, exact = _all(_all(need, _asked(run)), inner if strings is None else _asked(strings)), {""}, False
    return (run, ANYTHING) if exact else (None, _all(need, _asked(run)))


def _members(items) -> set[str] | None:
    out = set()
    for op, arg in items:
        if str(op) != "LITERAL":
            return None
        out.add(chr(arg).lower())
    return out


def trigram_query(pattern: str) -> Query:
    """Sets of lower-case trigrams, one of which every match contains whole; an empty set if nothing is mandatory."""
    strings, need = _walk(parser.parse(pattern))
    return need if strings is None else _asked(strings)


def build_index(df: DataFrame, text: str, grams: list[str]) -> DataFrame:
    """Postings ``gram, key`` for the given trigrams; ``key`` is a hash of the text."""
    own = df.select(F.coalesce(column(df, text), F.lit("")).alias("t"))
    low = own.select(F.xxhash64("t").alias("key"), F.lower("t").alias("low"))
    held = F.filter(F.array(*[F.lit(g) for g in grams]), lambda g: F.contains(F.col("low"), g))
    return low.select("key", F.explode(held).alias("gram")).select("gram", "key")


def candidates(postings: DataFrame, asked: dict[str, Query]) -> DataFrame:
    """``key, kinds``: the rules whose trigram query the postings of a text satisfy."""
    met = postings.groupBy("key").agg(F.collect_set("gram").alias("grams"))

    def holds(query: Query) -> Column:
        each = [F.size(F.array_intersect("grams", F.array(*[F.lit(g) for g in sorted(c)]))) == len(c) for c in sorted(query, key=sorted)]
        some = each[0]
        for more in each[1:]:
            some = some | more
        return some

    kinds = F.array_compact(F.array(*[F.when(holds(q), F.lit(k)) for k, q in asked.items()]))
    return met.select("key", kinds.alias("kinds")).filter(F.size("kinds") > 0)


def _found(text: Column, rule: Rule) -> Column:
    keep = (lambda hit, part: F.length(part) >= rule.least) if rule.least else None
    return S.matches(text, rule.pattern, keep, rule.group)


def scan(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE + MORE, spans: str = "spans") -> DataFrame:
    """``df`` with an array of (start, place, end, kind) ordered by start, then by the place of the rule."""
    asked = {r.kind: q for r in rules if ANYTHING != (q := trigram_query(r.pattern))}
    key, kinds = fresh(df, "key"), fresh(df, "kinds")
    keyed = df.withColumn(key, F.xxhash64(F.coalesce(column(df, text), F.lit(""))))
    if asked:
        grams = sorted({g for q in asked.values() for c in q for g in c})
        found = candidates(build_index(df, text, grams), asked).select(F.col("key").alias(key), F.col("kinds").alias(kinds))
        keyed = keyed.join(found, key, "left")
    whole = F.coalesce(column(keyed, text), F.lit(""))
    parts = []
    for place, rule in enumerate(rules):
        hits = _found(whole, rule)
        if rule.kind in asked:
            hits = F.when(F.array_contains(F.col(kinds), rule.kind), hits).otherwise(S.nothing())
        parts.append(S.labelled(rule.kind, place, hits))
    out = keyed.withColumn(spans, S.by_start(F.concat(*parts)))
    return out.select(*[column(out, c) for c in df.columns if c != spans], spans)
