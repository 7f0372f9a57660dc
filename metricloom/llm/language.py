"""Language identification: averaged hashed subword embeddings under a linear softmax.

Every run of two, three or four UTF-8 bytes of a text is hashed into a bucket; a bucket
has a small vector. A text is the average of its buckets' vectors, and a linear softmax
over that average gives the languages. Both layers are trained together by stochastic
gradient descent in numpy on a bounded sample of labelled rows. Because the average and the
linear layer commute, a trained model is stored as one logit row per bucket, so that a
prediction is a gather and a sum over the whole text.

A fifth of the sample is not trained on. It sets the softmax temperature (least log
loss) and the score below which a prediction is rejected: the ``reject_share`` quantile of the scores, which are the highest
probabilities, of the held-out texts that are recognised as labelled. So at most that share of them is rejected, and texts that are misjudged or
mislabelled do not move it.

Cases: a null text or one without a letter gives ``und`` with score 0 and is rejected. Without
any labelled row every text does. Repeated rows are predicted alike; ties between
languages go to the first by name. Null labels are never learned from. Texts of any length are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import column, fresh, small_batches, text_bytes

UNKNOWN = "und"
ORDERS = (2, 3, 4)
BITS = 16
DIMENSIONS = 12
#: Bytes of text that are turned into buckets at once.
CHUNK = 500_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _buckets(data: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the run of ``order`` bytes that starts at each byte."""
    n = len(data) - order + 1
    key = data[:n].astype(np.uint32)
    for k in range(1, order):
        key |= data[k : n + k].astype(np.uint32) << np.uint32(8 * k)
    key ^= np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF)
    key *= np.uint32(0x85EBCA6B)
    key ^= key >> np.uint32(13)
    key *= np.uint32(0xC2B2AE35)
    return key >> np.uint32(32 - BITS)


def _runs(offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """First run and end of runs of each text: none if it is shorter than a run."""
    start = offsets[:-1]
    return start, np.maximum(offsets[1:] - order + 1, start)


def _sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    last = len(total) - 1
    return total[np.minimum(end, last)] - total[np.minimum(start, last)]


@dataclass(frozen=True)
class LanguageModel:
    """``logits``: a row for each bucket, a column for each language."""

    languages: tuple[str, ...]
    logits: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def raw(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Average logits of each text."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        at, n = 0, len(offsets) - 1
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
            part, own = _LOWER[data[offsets[at] : offsets[to]]], offsets[at : to + 1] - offsets[at]
            count = np.zeros(to - at)
            for order in ORDERS:
                if len(part) < order:
                    continue
                bucket = _buckets(part, order)
                start, end = _runs(own, order)
                count += end - start
                for c in range(len(self.languages)):
                    out[at:to, c] += _sums(self.logits[:, c][bucket], start, end)
            out[at:to] /= np.maximum(count, 1)[:, None]
            at = to
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return _softmax(self.raw(data, offsets) / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def sample(df: DataFrame, text: str, label: str, row_id: str, rows: int, longest: int) -> list[tuple[str, str]]:
    """At most about ``rows`` labelled texts of up to ``longest`` characters, as many from each language,
    picked by a hash of the row so that every run picks the same."""
    known = df.select(column(df, text).alias("t"), column(df, label).alias("l"), F.xxhash64(column(df, row_id), column(df, text)).alias("h"))
    known = known.filter(F.col("t").isNotNull() & F.col("l").isNotNull() & (F.length("t") <= longest) & F.col("t").rlike(r"\p{L}"))
    counted = {r["l"]: r["count"] for r in known.groupBy("l").count().collect()}
    if not counted:
        return []
    each = max(1, rows // len(counted))
    steps = 1 << 30
    keep = F.create_map(*[F.lit(v) for l, n in counted.items() for v in (l, min(steps, each * steps // n))])
    picked = known.filter(F.pmod("h", F.lit(steps)) < keep[F.col("l")]).select("l", "t").collect()
    return sorted((r["l"], r["t"]) for r in picked)


class _Bags:
    """Buckets of each text and how often it has them. Two long arrays hold those of all texts: thousands of small ones would leave
    the driver's memory in pieces that do not go back to the system."""

    def __init__(self, texts: list[str]):
        most = sum(max(0, len(t.encode()) - k + 1) for t in texts for k in ORDERS)
        self.index, self.n = np.empty(most, np.min_scalar_type((1 << BITS) - 1)), np.empty(most, np.uint32)  # what is not written takes no memory
        self.ends = np.zeros(len(texts) + 1, np.int64)
        for i, t in enumerate(texts):
            data, at = _LOWER[np.frombuffer(t.encode(), np.uint8)], self.ends[i]
            found = [_buckets(data, k) for k in ORDERS if len(data) >= k]
            index, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint32), np.zeros(0, int))
            self.ends[i + 1] = to = at + len(index)
            self.index[at:to], self.n[at:to] = index, n

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of text ``i`` and the share of each."""
        some = slice(self.ends[i], self.ends[i + 1])
        return self.index[some], self.n[some] / max(1, int(self.n[some].sum()))


def train(labelled: list[tuple[str, str]], *, epochs: int = 6, rate: float = 6.0, reject_share: float = 0.001, seed: int = 7) -> LanguageModel | None:
    """A model of the labelled texts, None if there are none."""
    languages = tuple(sorted({l for l, _ in labelled}))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(labelled))
    held = set(order[: len(order) // 5].tolist())
    wanted = np.array([languages.index(l) for l, _ in labelled])
    bags = _Bags([t for _, t in labelled])
    vectors = rng.standard_normal((1 << BITS, DIMENSIONS)) / DIMENSIONS
    heads = np.zeros((DIMENSIONS, len(languages)))
    own = [i for i in range(len(labelled)) if i not in held]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(own):
            index, share = bags.of(i)
            mean = share @ vectors[index]
            slope = _softmax(mean @ heads)
            slope[wanted[i]] -= 1
            back = heads @ slope
            heads -= step * 0.1 * np.outer(mean, slope)
            vectors[index] -= (step * 20 * share)[:, None] * back
    model = LanguageModel(languages, np.ascontiguousarray(vectors @ heads).astype(np.float32))
    calm = sorted(held) or own
    texts = pa.array([labelled[i][1] for i in calm])
    raw, truth = model.raw(*text_bytes(texts)), wanted[calm]
    rows = np.arange(len(calm))
    heats = np.geomspace(0.02, 20, 61)
    losses = [-np.log(np.maximum(_softmax(raw / h)[rows, truth], 1e-12)).mean() for h in heats]
    heat = float(heats[int(np.argmin(losses))])
    p = _softmax(raw / heat)
    score, right = p.max(axis=1), p.argmax(axis=1) == truth
    return LanguageModel(languages, model.logits, heat, float(np.quantile(score[right] if right.any() else score, reject_share, method="lower")))


def fit(
    df: DataFrame, text: str = "text", label: str = "lang", row_id: str = "doc_id", *, rows: int = 6000, longest: int = 20_000, **options
) -> LanguageModel | None:
    """Train on at most about ``rows`` labelled rows of ``df``."""
    return train(sample(df, text, label, row_id, rows, longest), **options)


def prediction(model: LanguageModel | None, text: Column) -> Column:
    """A struct of lang_pred, score and rejected for a text column."""
    nothing = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    if model is None:
        return nothing

    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def predict(texts: pa.Array) -> pa.Array:
        p = model.scores(*text_bytes(texts))
        best = p.argmax(axis=1)
        score = p[np.arange(len(best)), best]
        names = pa.array(model.languages).take(pa.array(best))
        return pa.StructArray.from_arrays([names, pa.array(score), pa.array(score < model.threshold)], ["lang_pred", "score", "rejected"])

    return F.when(text.rlike(r"\p{L}"), predict(text)).otherwise(nothing)


def identify(df: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """``df`` with lang_pred, score and rejected; columns of ``df`` with these names are replaced."""
    small_batches(df.sparkSession)
    own = fresh(df, "found")
    out = df.withColumn(own, prediction(model, column(df, text)))
    return out.withColumns({c: F.col(own)[c] for c in ("lang_pred", "score", "rejected")}).drop(own)


def keep_identified(df: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """The rows whose language is recognised, with the columns of ``df``."""
    small_batches(df.sparkSession)
    own = fresh(df, "found")
    return df.withColumn(own, prediction(model, column(df, text))).filter(~F.col(own)["rejected"]).drop(own)
