"""Terms, phrases and figures in text.

A text is tokenised inside its task, and neighbours, phrases and figures near a term
are found there on arrays of tokens. Only ``(term, count, flag)`` partial results are
shuffled, so neither a long text nor a frequent term ends up whole in one task.
Phrases and figures never cross from one text into the next.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions import text
from metricloom.operators.common import metric, metric_rows, stacked
from metricloom.session import materialize

BACKGROUND_SHARE = 0.05
RARE_AT_MOST = 3
MIN_CHARS = 2
REACH = 25
MIN_PHRASE = 2
MAX_MENTIONS = 20
MAX_TERMS = 40
MAX_METRIC_TERMS = 20
HOT_GRAMS = 20_000
HOT_CHARS = 200
BANDS = ("nen", "vua", "hiem")  # fixed values: background, middle, rare

# Words without content (Vietnamese without accents, then English).
STOPWORDS = [
    "la", "cua", "va", "co", "the", "cho", "voi", "tu", "den", "nhu", "nao", "gi", "khong", "duoc", "mot", "cac", "cai", "nhung", "hay",
    "ra", "ve", "theo", "trong", "tren", "duoi", "ban", "toi", "chung", "ta", "minh", "nay", "do", "kia", "se", "da", "dang", "bi", "boi",
    "tai", "khi", "neu", "thi", "ma", "hon", "rat", "cung", "van", "chi", "moi", "nen", "phai", "can", "sau", "truoc", "giua", "hoac",
    "tuy", "vi", "nhat", "vao", "len", "xuong", "qua", "lai", "day", "no", "ho", "ai", "dau", "sao", "bao", "and", "or", "of", "to", "in",
    "on", "for", "with", "is", "are", "was", "were", "be", "been", "an", "this", "that", "these", "it", "as", "at", "by", "from", "has",
    "have", "had", "not", "but", "we", "the", "me", "my", "mine", "us", "our", "you", "your", "they", "them", "their", "he", "him", "his",
    "she", "her", "its", "would", "could", "should", "will", "can", "may", "might", "must", "am", "being", "do", "does", "did", "so", "if",
    "then", "than", "there", "what", "which", "who", "when", "where", "why", "how",
]

# Fixed pattern: a word, or a figure with separators and a percent sign.
TOKEN = r"[a-z][a-z0-9_]*|-?[0-9][0-9.,]*%?"


#: Characters of text that a task reads at a time.
CHUNK_CHARS = 1 << 22

_TOKEN = re.compile(TOKEN)


@dataclass
class _Read:
    """The tokens of some texts, end to end. ``row`` is the text of a token, ``pos`` its place there."""

    terms: pa.Array
    row: np.ndarray
    pos: np.ndarray
    figure: np.ndarray
    content: np.ndarray

    def near(self, at: np.ndarray) -> np.ndarray:
        """Whether a figure of the same text lies within reach of each of the tokens ``at``. Texts are set apart by more than the reach."""
        line = np.arange(len(self.row)) + self.row * (REACH + 1)
        figures = line[self.figure]
        if not len(figures):
            return np.zeros(len(at), bool)
        first = np.searchsorted(figures, line[at] - REACH)
        return (first < len(figures)) & (figures[np.minimum(first, len(figures) - 1)] <= line[at] + REACH)

    def pairs(self) -> np.ndarray:
        """Left places of adjacent, different content words of one text."""
        at = np.flatnonzero(self.content[:-1] & self.content[1:] & (self.row[:-1] == self.row[1:]))
        different = pc.not_equal(self.terms.take(pa.array(at)), self.terms.take(pa.array(at + 1)))
        return at[different.to_numpy(zero_copy_only=False)]


def _read_texts(texts: list[str]) -> _Read:
    found = [_TOKEN.findall(t) for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    terms = pa.array(list(chain.from_iterable(found)), pa.string())
    row = np.repeat(np.arange(len(found)), sizes)
    pos = np.arange(len(terms)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    figure = pc.less(terms, "a").to_numpy(zero_copy_only=False)  # tokens are words or figures, and only words start with a letter
    stop = pc.is_in(terms, value_set=pa.array(STOPWORDS)).to_numpy(zero_copy_only=False)
    long = pc.greater_equal(pc.binary_length(terms), MIN_CHARS).to_numpy(zero_copy_only=False)  # tokens are ASCII
    return _Read(terms, row, pos, figure, ~figure & ~stop & long)


def _chunks(batches: Iterator[pa.RecordBatch], texts: str = "text") -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``CHUNK_CHARS`` of text."""
    for batch in batches:
        begin, held = 0, 0
        for at, size in enumerate(pc.fill_null(pc.binary_length(batch.column(texts)), 0).to_pylist(), start=1):
            held += size
            if held >= CHUNK_CHARS:
                yield batch.slice(begin, at - begin)
                begin, held = at, 0
        if begin < batch.num_rows:
            yield batch.slice(begin)


def _texts(df: DataFrame, source: str, **also: str) -> DataFrame:
    """``text`` as it is read, lower case without accents, and columns ``also`` under other names."""
    return df.filter(F.col(source).isNotNull()).select(text.plain_lower(F.col(source)).alias("text"), *[F.col(c).alias(name) for name, c in also.items()])


def _place_type(df: DataFrame, place: str) -> str:
    return df.schema[place].dataType.simpleString()


def word_positions(df: DataFrame, place: str, source: str) -> DataFrame:
    """``place, pos, term`` of every content word."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            found = _read_texts(batch.column("text").to_pylist())
            at = np.flatnonzero(found.content)
            places = batch.column("place").take(pa.array(found.row[at]))
            yield pa.RecordBatch.from_arrays([places, pa.array(found.pos[at], pa.int32()), found.terms.take(pa.array(at))], ["place", "pos", "term"])

    return _texts(df, source, place=place).mapInArrow(read, f"place {_place_type(df, place)}, pos int, term string")


def _counted(df: DataFrame, source: str, words: bool = True, phrases: bool = True) -> DataFrame:
    """``term, left, right, count, near_figure`` of content words (``left`` and ``right`` are null) and of pairs of adjacent ones seen at least twice; of two
    mirrored orders the rarer goes. Equal ones of a chunk are counted in the task, and both orders of a pair meet in one shuffle of terms and counts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            found = _read_texts(batch.column("text").to_pylist())
            if words:
                at = np.flatnonzero(found.content)
                yield from _folded(found.terms.take(pa.array(at)), None, found.near(at))
            if phrases:
                at = found.pairs()
                yield from _folded(found.terms.take(pa.array(at)), found.terms.take(pa.array(at + 1)), found.near(at))

    rows = _texts(df, source).mapInArrow(read, "a string, b string, turned boolean, n bigint, near boolean")
    kept = lambda turned, column: F.when(F.col("turned") == turned, F.col(column))
    both = rows.groupBy("a", "b").agg(*[f(kept(turned, c)).alias(f"{c}{int(turned)}") for turned in (False, True) for f, c in ((F.sum, "n"), (F.max, "near"))])
    one = F.struct(F.col("a").alias("left"), F.col("b").alias("right"), F.col("n0").alias("n"), F.col("near0").alias("near"), F.coalesce("n1", F.lit(0)).alias("other"))
    two = F.struct(F.col("b").alias("left"), F.col("a").alias("right"), F.col("n1").alias("n"), F.col("near1").alias("near"), F.coalesce("n0", F.lit(0)).alias("other"))
    found = both.filter(F.col("b").isNull() | (F.greatest("n0", "n1") >= MIN_PHRASE)).select(F.explode(F.array(one, two)).alias("w")).select("w.*")
    word = F.col("right").isNull()
    found = found.filter(F.col("n").isNotNull() & (word | ((F.col("n") >= F.col("other")) & (F.col("n") >= MIN_PHRASE))))
    return found.select(F.when(word, F.col("left")).otherwise(F.concat_ws(" ", "left", "right")).alias("term"), F.when(~word, F.col("left")).alias("left"), "right", F.col("n").alias("count"), F.col("near").alias("near_figure"))


def _folded(left: pa.Array, right: pa.Array | None, near: np.ndarray) -> list[pa.RecordBatch]:
    """``a, b, turned, n, near`` of equal words or pairs; ``a`` is the smaller of a pair, and ``turned`` says that it came second."""
    if right is None:
        found = pa.table({"a": left, "near": pa.array(near)}).group_by(["a"]).aggregate([([], "count_all"), ("near", "max")])
        rest = [pa.nulls(len(found), pa.string()), pa.repeat(False, len(found))]
    else:
        found = pa.table({"l": left, "r": right, "near": pa.array(near)}).group_by(["l", "r"]).aggregate([([], "count_all"), ("near", "max")])
        turned = pc.greater(found["l"], found["r"])
        rest = [pc.if_else(turned, found["l"], found["r"]), turned]
        found = found.append_column("a", pc.if_else(turned, found["r"], found["l"]))
    return pa.table([found["a"], *rest, found["count_all"], found["near_max"]], names=["a", "b", "turned", "n", "near"]).to_batches()


def word_counts(df: DataFrame, place: str, source: str) -> DataFrame:
    """``term, count, near_figure`` of every content word."""
    return _counted(df, source, phrases=False).select("term", "count", "near_figure")


def phrase_counts(df: DataFrame, place: str, source: str) -> DataFrame:
    """``term, left, right, count, near_figure`` of pairs seen at least twice; of two mirrored orders the rarer goes."""
    return _counted(df, source, words=False)


def band(count: Column, share: Column) -> Column:
    return F.when(share >= BACKGROUND_SHARE, "nen").when(count <= RARE_AT_MOST, "hiem").otherwise("vua")


@dataclass
class Reading:
    """What was read: all terms, and the totals."""

    terms: DataFrame  # term, is_phrase, count, share, band, near_figure
    every: DataFrame  # the same term and share with the words that phrases absorb
    total_words: int
    distinct_terms: int


def read(df: DataFrame, place: str, source: str) -> Reading:
    """All words and phrases of a text column. Words seen only inside phrases are absorbed by them.

    The vocabulary is stored once, words and pairs from one reading of the text: it is small next to the text and is used several times.
    """
    counted = materialize(_counted(df, source))
    words = counted.filter("right IS NULL").select("term", "count", "near_figure")
    size = words.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"), F.count("*").alias("distinct")).first()
    phrases = counted.filter("right IS NOT NULL")
    inside = phrases.select(F.explode(F.array("left", "right")).alias("term"), "count").groupBy("term").agg(F.sum("count").alias("_inside"))
    alone = words.join(inside, "term", "left").filter(F.col("_inside").isNull() | (F.col("_inside") < F.col("count")))
    both = alone.select("term", F.lit(False).alias("is_phrase"), "count", "near_figure").unionByName(
        phrases.select("term", F.lit(True).alias("is_phrase"), "count", "near_figure")
    )
    share = F.col("count") / F.lit(float(max(size["total"], 1)))
    terms = both.select("term", "is_phrase", "count", F.round(share, 4).alias("share"), band(F.col("count"), share).alias("band"), "near_figure")
    every = words.select("term", "count").unionByName(phrases.select("term", "count")).withColumn("share", share)
    return Reading(terms, every, size["total"], size["distinct"])



def _worth() -> list[Column]:
    return [F.desc("is_phrase"), F.desc("near_figure"), F.desc("count"), F.asc("term")]


def share_out(terms: DataFrame, max_terms: int = MAX_TERMS) -> DataFrame:
    """Terms to show: each band gets a third, unused places go to the best of the rest.

    Both steps are top-k, limited before their shuffle.
    """
    quota = max(1, max_terms // len(BANDS))
    placed = terms.withColumn("_at", F.row_number().over(Window.partitionBy("band").orderBy(*_worth())))
    first = placed.filter(F.col("_at") <= quota).drop("_at").cache()  # at most 3 x quota rows
    spare = max_terms - first.count()
    if spare <= 0:
        return first
    rest = terms.join(F.broadcast(first.select("term")), "term", "left_anti")
    return first.unionByName(rest.orderBy(*_worth()).limit(spare))


def _occurrences(df: DataFrame, place: str, source: str, chosen: Sequence[str]) -> DataFrame:
    """``place, term, times, numbers`` once per text and chosen term, found inside the row."""
    wanted = sorted(set(chosen))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            found = _read_texts(batch.column("text").to_pylist())
            pairs = found.pairs()
            both = pc.binary_join_element_wise(found.terms.take(pa.array(pairs)), found.terms.take(pa.array(pairs + 1)), " ")
            words = np.flatnonzero(found.content)
            at, names = np.concatenate([words, pairs]), pa.concat_arrays([found.terms.take(pa.array(words)), both])
            hits = np.flatnonzero(pc.is_in(names, value_set=pa.array(wanted, pa.string())).to_numpy(zero_copy_only=False))
            places: dict[tuple[int, str], list[int]] = {}
            for i, name in zip(at[hits].tolist(), names.take(pa.array(hits)).to_pylist()):
                places.setdefault((int(found.row[i]), name), []).append(i)
            figures = np.flatnonzero(found.figure)
            numbers = []
            for (row, _), own in places.items():
                near: dict[str, None] = {}
                for i in own:
                    around = figures[np.searchsorted(figures, i - REACH) : np.searchsorted(figures, i + REACH, "right")]
                    near.update(dict.fromkeys(found.terms.take(pa.array(around[found.row[around] == row])).to_pylist()))
                numbers.append(list(near))
            rows = pa.array([row for row, _ in places], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("place").take(rows), pa.array([name for _, name in places], pa.string()), pa.array([len(own) for own in places.values()], pa.int32()), pa.array(numbers, pa.list_(pa.string()))],
                ["place", "term", "times", "numbers"],
            )

    return _texts(df, source, place=place).mapInArrow(read, f"place {_place_type(df, place)}, term string, times int, numbers array<string>")


def mentions(df: DataFrame, place: str, source: str, chosen: Sequence[str], limit: int = MAX_MENTIONS) -> DataFrame:
    """The first places of each chosen term with the figures near it: ``term, rank, place, numbers``."""
    first = Window.partitionBy("term").orderBy("place")
    found = _occurrences(df, place, source, chosen).withColumn("rank", F.row_number().over(first))
    return found.filter(F.col("rank") <= limit).select("term", "rank", "place", "numbers")


def figures_near(df: DataFrame, place: str, source: str, chosen: Sequence[str]) -> DataFrame:
    """All distinct figures near each chosen term as rows: ``term, number, places``."""
    found = _occurrences(df, place, source, chosen).select("term", F.explode("numbers").alias("number"))
    return found.groupBy("term", "number").agg(F.count("*").alias("places"))


def mentions_table(df: DataFrame, place: str, source: str, reading: Reading, wanted: Sequence[str]) -> DataFrame:
    """One row per mention of the wanted terms, with the term's totals."""
    names = [" ".join(w.split()) for w in wanted]
    rows = mentions(df, place, source, names)
    totals = reading.terms.filter(F.col("term").isin(names))  # at most one row per wanted term
    return rows.join(F.broadcast(totals), "term").select(
        "term", "place", F.array_join("numbers", ", ").alias("numbers_near"), "count", F.round(F.col("share") * 100, 2).alias("share_pct"), "band", "is_phrase"
    )


def lift(inside: DataFrame, outside: DataFrame, outside_words: int) -> DataFrame:
    """``term, lift``: how much more often a term occurs inside a group than elsewhere."""
    elsewhere = outside.select("term", F.col("share").alias("_out"))
    ratio = F.col("share") / (F.coalesce("_out", F.lit(0.0)) + F.lit(1.0 / max(outside_words, 1)))
    return inside.join(elsewhere, "term", "left").select("term", F.round(ratio, 2).alias("lift"))


def to_metrics(reading: Reading, shown: DataFrame, lifts: DataFrame | None = None, limit: int = MAX_METRIC_TERMS) -> DataFrame:
    """The reading as metric rows for the most frequent shown terms."""
    spark = shown.sparkSession
    top = shown.orderBy(F.desc("count"), "term").limit(limit)
    if lifts is not None:
        top = top.join(lifts, "term", "left")
    else:
        top = top.withColumn("lift", F.lit(None).cast("double"))
    name = text.ascii_slug(F.col("term"))
    top = top.filter(name != "")
    key = lambda s: F.concat(F.lit("term."), name, F.lit(f".{s}"))
    return stacked([
        metric_rows(spark.range(1), [
            metric("text.words.total", F.lit(reading.total_words), measure="text.words", stat="total", unit="word", source="counted in the text"),
            metric("text.terms.distinct", F.lit(reading.distinct_terms), measure="text.terms", stat="distinct", unit="word", source="counted in the text")]),
        metric_rows(top, [
            metric(key("count"), F.col("count"), measure="term", stat="count", grp=F.col("term"), unit="times", source="text"),
            metric(key("share"), F.round(F.col("share") * 100, 2), measure="term", stat="share", grp=F.col("term"), unit="%", source="text"),
            metric(key("lift"), F.col("lift"), measure="term", stat="lift", grp=F.col("term"), unit="times", source="text")]),
    ])


def read_column(df: DataFrame, place: str, source: str, inside: Column | None = None) -> DataFrame:
    """Metrics of a text column, or of the rows meeting ``inside`` compared with the rest."""
    if inside is None:
        reading = read(df, place, source)
        return to_metrics(reading, share_out(reading.terms))
    hit = F.coalesce(inside, F.lit(False))
    reading, rest = read(df.filter(hit), place, source), read(df.filter(~hit), place, source)
    shown = share_out(reading.terms)
    lifts = lift(shown, rest.every, rest.total_words)
    return to_metrics(reading, shown, lifts)


# --- relevance ----------------------------------------------------------------

RELEVANT = 0.25
# Words that carry no meaning in a question about data.
QUESTION_STOPWORDS = [
    "la", "cua", "va", "co", "the", "cho", "voi", "tu", "den", "nhu", "nao", "gi", "khong", "duoc", "mot", "cac", "cai", "nhung", "hay",
    "o", "ra", "ve", "theo", "trong", "tren", "duoi", "ban", "toi", "chung", "ta", "minh", "nay", "do", "kia", "phan", "tich", "du", "lieu",
    "ket", "qua", "so", "bao", "cao", "muc", "gia", "tri",
]


_BETWEEN_WORDS = "[^a-z0-9_]+"
_QUESTION_STOPS = frozenset(QUESTION_STOPWORDS)


def _with_spread(counted: DataFrame, hot_grams: int = HOT_GRAMS) -> DataFrame:
    """Add ``df``, the number of texts of each gram.

    Grams with at least one in ``hot_grams`` of all rows are at most ``hot_grams`` in number, so the counts of those up to ``HOT_CHARS``
    characters long are broadcast; only the rows of rarer (or longer) ones are shuffled to theirs.
    """
    spread = materialize(counted.groupBy("gram").agg(F.count("*").alias("df")))
    least = -(-counted.count() // hot_grams)
    is_hot = (F.col("df") >= least) & (F.length("gram") <= HOT_CHARS)
    hot = F.broadcast(spread.filter(is_hot))
    rest = counted.join(hot, "gram", "left_anti").join(spread.filter(~is_hot), "gram")
    return counted.join(hot, "gram").unionByName(rest)


#: Characters of the texts whose grams are indexed together, and characters of all texts for one bucket of grams.
INDEX_CHARS = 1 << 22
BUCKET_CHARS = 1 << 23
#: Rows of grams that are indexed together where a key has too much text for one task.
INDEX_ROWS = 1 << 20

_BLOCKS = "bucket int, chunk bigint, n int, block binary, more binary, keys array<string>, asked array<boolean>, sizes array<int>, at array<int>, times array<int>"
_SUMS = "_k string, _q boolean, dot double, squares double"


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers, first their first bytes, then their second ones, ...: equal and empty bytes come together."""
    numbers = np.ascontiguousarray(values).astype(np.uint64)
    width = max(1, -(-int(numbers.max()).bit_length() // 8))
    return bytes([width]) + pa.compress(numbers.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), codec="zstd", asbytes=True)


def _unpack(block: bytes, n: int) -> np.ndarray:
    width = block[0]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(block[1:], decompressed_size=width * n, codec="zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view(np.uint64).ravel()


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _gram_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The text and the 64-bit hash of every word and every pair of adjacent words. Two of a billion grams share a hash with a chance of 3 %."""
    found = pc.split_pattern_regex(texts, _BETWEEN_WORDS)
    words = found.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(found)), found.value_lengths().to_numpy(zero_copy_only=False))
    names, place = words.dictionary.to_numpy(zero_copy_only=False), words.indices.to_numpy(zero_copy_only=False)
    kept = np.array([len(w) > 1 and w not in _QUESTION_STOPS for w in names], bool)[place]
    own = np.frombuffer(b"".join(blake2b(w.encode(), digest_size=8).digest() for w in names), "<u8")
    hashes, row = own[place[kept]], row[kept]
    at = np.flatnonzero(row[:-1] == row[1:])
    second = hashes[at + 1]
    pairs = _mixed(hashes[at] * np.uint64(0x9E3779B97F4A7C15) + ((second << np.uint64(32)) | (second >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
    return np.concatenate([row, row[at]]), np.concatenate([hashes, pairs])


def _index(keys: list, doc: np.ndarray, hashes: np.ndarray, times: np.ndarray | None, question: tuple[np.ndarray, np.ndarray], buckets: int) -> pa.RecordBatch | None:
    """Rows of ``_BLOCKS`` for texts with ``keys`` (key, asked) and their grams, or different grams and how often each occurs.

    The different hashes in order, cut into buckets, go to be counted, each with its number of texts here. The texts stay with a bucket below zero, their grams as places among the
    hashes, so a gram is sent once and its count comes back by its place.
    """
    if not len(hashes):
        return None
    known, place = np.unique(hashes, return_inverse=True)
    pair = doc * len(known) + place
    if times is None:
        pair, tf = np.unique(pair, return_counts=True)
    else:
        order = np.argsort(pair)
        pair, tf = pair[order], times[order]
    doc, place = np.divmod(pair, len(known))
    sizes = np.bincount(doc, minlength=len(keys))
    step = np.diff(place, prepend=0)
    begin = (np.cumsum(sizes) - sizes)[sizes > 0]
    step[begin] = place[begin]
    spread = np.bincount(place, minlength=len(known))
    chunk = int.from_bytes(blake2b(known.tobytes() + repr((TaskContext.get().partitionId(), len(pair), keys[0], keys[-1])).encode(), digest_size=8).digest(), signed=True)
    wanted = np.searchsorted(known, question[0]).clip(max=len(known) - 1)
    held = known[wanted] == question[0]
    kept = [k for k, size in zip(keys, sizes.tolist()) if size]
    rows = [dict(
        bucket=-1 - abs(chunk) % 2**30, chunk=chunk, n=len(known), block=_pack(step), more=_pack(tf), keys=[k for k, _ in kept], asked=[q for _, q in kept], sizes=sizes[sizes > 0], at=wanted[held], times=question[1][held],
    )]
    starts = np.array([-(-(b << 64) // buckets) for b in range(buckets)], np.uint64)
    cuts = np.append(np.searchsorted(known, starts), len(known)).tolist()
    for b, (low, high) in enumerate(zip(cuts, cuts[1:])):
        if low < high:
            rows.append(dict(bucket=b, chunk=chunk, n=high - low, block=_pack(np.diff(known[low:high], prepend=np.uint64(0))), more=_pack(spread[low:high])))
    kinds = {"bucket": pa.int32(), "chunk": pa.int64(), "n": pa.int32(), "block": pa.binary(), "more": pa.binary(), "keys": pa.list_(pa.string()), "asked": pa.list_(pa.bool_()), **dict.fromkeys(("sizes", "at", "times"), pa.list_(pa.int32()))}
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kind) for c, kind in kinds.items()], list(kinds))


def _indexed_texts(batches: Iterator[pa.RecordBatch], question: tuple[np.ndarray, np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Texts ``_k, _q, text`` as rows of ``_BLOCKS``. Neighbours with one key count together and stay together."""
    keys, docs, hashes, size = [], [], [], 0

    def done() -> Iterator[pa.RecordBatch]:
        nonlocal keys, docs, hashes, size
        if keys:
            found = _index(keys, np.concatenate(docs), np.concatenate(hashes), None, question, buckets)
            keys, docs, hashes, size = [], [], [], 0
            if found is not None:
                yield found

    def add(own: list, texts: pa.Array) -> None:
        nonlocal size
        number = []
        for k in own:
            if not keys or keys[-1] != k:
                keys.append(k)
            number.append(len(keys) - 1)
        row, found = _gram_hashes(texts)
        docs.append(np.array(number, np.int64)[row])
        hashes.append(found)
        size += pc.sum(pc.binary_length(texts)).as_py()

    for batch in _chunks(batches):
        own, texts = list(zip(batch.column("_k").to_pylist(), batch.column("_q").to_pylist())), batch.column("text")
        if size >= INDEX_CHARS:
            more = next((i for i, k in enumerate(own) if k != keys[-1]), len(own))
            if more:
                add(own[:more], texts[:more])
            if more == len(own):
                continue
            yield from done()
            own, texts = own[more:], texts[more:]
        add(own, texts)
    yield from done()


def _indexed_rows(batches: Iterator[pa.RecordBatch], question: tuple[np.ndarray, np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Different rows ``_k, _q, h, tf`` as rows of ``_BLOCKS``."""
    held, rows = [], 0
    for batch in chain(batches, [None]):
        if held and (batch is None or rows >= INDEX_ROWS):
            table = pa.Table.from_batches(held)
            key = table["_k"].combine_chunks().dictionary_encode(null_encoding="encode")
            code, doc = np.unique(key.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2 + table["_q"].to_numpy(), return_inverse=True)
            names = key.dictionary.to_pylist()
            found = _index([(names[c // 2], bool(c % 2)) for c in code.tolist()], doc, table["h"].to_numpy().view(np.uint64), table["tf"].to_numpy(), question, buckets)
            held, rows = [], 0
            if found is not None:
                yield found
        if batch is not None:
            held.append(batch)
            rows += batch.num_rows


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_k, _q, h, tf`` of the grams of every text, by their hash."""
    for batch in _chunks(batches):
        row, hashes = _gram_hashes(batch.column("text"))
        counted = pa.table({"row": row, "h": hashes.view(np.int64)}).group_by(["row", "h"]).aggregate([([], "count_all")])
        keys = [pa.chunked_array([batch.column(c)]).take(counted["row"]) for c in ("_k", "_q")]
        yield from pa.table([*keys, counted["h"], counted["count_all"]], names=["_k", "_q", "h", "tf"]).to_batches()


def _count_bucket(table: pa.Table) -> pa.Table:
    """The hashes of a bucket replaced by the number of texts of each, in the same order. Indexed texts pass as they are."""
    if table["bucket"][0].as_py() < 0:
        return table
    sizes = table["n"].to_pylist()
    blocks = [[_unpack(b, n) for b, n in zip(table[c].to_pylist(), sizes)] for c in ("block", "more")]
    _, place = np.unique(np.concatenate([np.cumsum(b, dtype=np.uint64) for b in blocks[0]]), return_inverse=True)
    spread = np.bincount(place, np.concatenate(blocks[1]).astype(np.float64))[place]
    ends = np.cumsum(sizes)[:-1]
    packed = pa.array([_pack(x) for x in np.split(spread, ends)], pa.binary())
    return table.set_column(3, "block", packed).set_column(4, "more", pa.nulls(len(sizes), pa.binary()))


def _weigh(table: pa.Table, total: int) -> pa.Table:
    """``_SUMS`` of the texts of a chunk, from their grams and the counts that came back."""
    rows = table.sort_by("bucket").to_pylist()
    texts, counts = rows[0], rows[1:]
    if texts["bucket"] >= 0 or sum(r["n"] for r in counts) != texts["n"]:
        raise RuntimeError("the texts were not the same when they were read again")
    spread = np.concatenate([_unpack(r["block"], r["n"]) for r in counts])
    idf = np.log((1.0 + total) / (1.0 + spread)) + 1.0
    sizes = np.array(texts["sizes"])
    pairs, begin = int(sizes.sum()), np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)
    step = _unpack(texts["block"], pairs).astype(np.int64)
    place = np.cumsum(step)
    place -= np.repeat(place[begin] - step[begin], sizes)
    weight = (1.0 + np.log(_unpack(texts["more"], pairs))) * idf[place]
    asked, at = np.zeros(len(idf)), np.array(texts["at"], np.int64)
    asked[at] = (1.0 + np.log(np.array(texts["times"], np.float64))) * idf[at]
    sums = [pa.array(np.bincount(doc, x)) for x in (weight * asked[place], weight**2)]
    return pa.table([pa.array(texts["keys"], pa.string()), pa.array(texts["asked"], pa.bool_()), *sums], names=["_k", "_q", "dot", "squares"])


def _indexed(texts: DataFrame, question: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """Rows of ``_BLOCKS`` in which every gram of a key stands once.

    Texts are indexed where they are if every key has one. Else the texts of a key are brought together; keys with more text than a task indexes at a time are few, and
    their grams are counted by key and gram.
    """
    read = lambda df, by: df.mapInArrow(lambda batches: by(batches, question, buckets), _BLOCKS)
    several = texts.groupBy("_k", "_q").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).filter("n > 1")
    if several.isEmpty():
        return read(texts, _indexed_texts)
    heavy = [r["_k"] for r in several.filter(F.col("chars") > INDEX_CHARS).collect()]  # at most one for INDEX_CHARS of text
    is_heavy = F.coalesce(F.col("_k").isin([k for k in heavy if k is not None]), F.lit(None in heavy))
    light = read(texts.filter(~is_heavy).repartition("_k", "_q").sortWithinPartitions("_k", "_q"), _indexed_texts)
    if not heavy:
        return light
    counted = texts.filter(is_heavy).mapInArrow(_gram_rows, "_k string, _q boolean, h bigint, tf bigint").groupBy("_k", "_q", "h").agg(F.sum("tf").alias("tf"))
    return light.unionByName(read(materialize(counted), _indexed_rows))


def relevance(df: DataFrame, key: str, source: str, question: str, threshold: float = RELEVANT) -> DataFrame:
    """Cosine of 1-2-gram TF-IDF (sublinear, smoothed) of every text with a question.

    Texts are judged only when both sides carry accents or both do not:
    ``key, score, kept, checked``.
    """
    spark = df.sparkSession
    mine = df.filter(F.col(source).isNotNull()).select(F.col(key).cast("string").alias("_k"), F.col(source).alias("_t"), F.lit(False).alias("_q"))
    asked = spark.createDataFrame([(None, question, True)], "_k string, _t string, _q boolean")
    texts = mine.unionByName(asked).select("_k", "_q", text.plain_lower(F.col("_t")).alias("text"))
    size = mine.agg(F.count("*").alias("n"), F.sum(F.length("_t")).alias("chars")).first()
    total, buckets = size["n"] + 1, 1 + (size["chars"] or 0) // BUCKET_CHARS
    words = np.unique(_gram_hashes(pa.array([asked.select(text.plain_lower(F.col("_t"))).first()[0]]))[1], return_counts=True)
    met = _indexed(texts, words, buckets).groupBy("bucket").applyInArrow(_count_bucket, _BLOCKS)
    sums = materialize(met.groupBy("chunk").applyInArrow(lambda table: _weigh(table, total), _SUMS))
    sums = sums.groupBy("_k", "_q").agg(F.sum("dot").alias("dot"), F.sqrt(F.sum("squares")).alias("len"))
    norm = sums.filter("_q").agg(F.max("len")).first()[0] or 0.0
    cosine = F.coalesce(F.try_divide("dot", F.col("len") * F.lit(norm)), F.lit(0.0))
    comparable = text.accented(F.col("_t")) == text.accented(F.lit(question))
    judged = mine.select("_k", comparable.alias("checked"))
    scored = judged.join(sums.filter("NOT _q").select(F.col("_k").alias("_key"), cosine.alias("score")), F.col("_k").eqNullSafe(F.col("_key")), "left")
    score = F.coalesce("score", F.lit(0.0))
    return scored.select(
        F.col("_k").alias(key), F.when(F.col("checked"), F.round(score, 4)).otherwise(0.0).alias("score"),
        F.when(F.col("checked"), score >= threshold).otherwise(True).alias("kept"), "checked",
    )
