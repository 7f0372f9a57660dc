"""Exact substring dedup with difference-cover anchors.

A window of ``window`` words is repeated if the same words stand anywhere else in the corpus. All words under a
repeated window are removed.

Anchors: a difference cover is a set of residues modulo a period such that every distance between two places is
the difference of two of its members. Short runs of words are hashed only where the place in its document falls on the cover.
Whatever the places of two equal windows, some offset below the period puts both on the cover, so
they share an anchor. Anchors that occur once are dropped. Extension: of the windows around the others
the full hash (96 bits) is compared; those that occur again are the repeated ones.

No group of equal passages is ever gathered: within an Arrow batch equal hashes are folded into one row
with a count, so a hash has at most one row for each batch of rows, however common the passage is.

Cases: a null or blank text has no words. Repeated rows repeat each other's windows, so they lose all words under a
window, as do equal texts. Documents shorter than a window keep all. Null ids are allowed. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.common import column, text_bytes

#: Perfect difference sets by period. Fixed values.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Shortest anchor, in words, if the window allows it.
ANCHOR = 15
#: Bytes of text hashed at once.
CHUNK = 2_000_000
#: Odd multipliers of the polynomial hashes modulo 2**64: of bytes in a word, and of words in a run.
OF_BYTES, OF_WORDS, OF_WORDS_TOO = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xDA942042E4DD58B5

#: Rows of hashes, with what differs from row to row side by side so that shuffles compress well. ``p`` holds the place in
#: its document and a state (ALONE, KNOWN, COVERED) in its lower half, or for windows in its upper half above the rest of the hash.
FOUND = "k1 bigint, k2 bigint, h bigint, p bigint"
#: Seen once in its batch; known to be repeated; known, and its words are covered by known neighbours.
ALONE, KNOWN, COVERED = 1, 2, 3
#: Every so many of consecutive known windows are reported; must be less than a window.
APART = 16


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """Period and residues: the longest period that leaves anchors of ``ANCHOR`` words, or of half the window."""
    fits = [p for p in COVERS if window - p + 1 >= min(ANCHOR, -(-window // 2))]
    return max(fits), COVERS[max(fits)]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _prefix(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the polynomial, and the inverse powers that bring a difference back to place 0."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values))[: len(values)], out=total[1:])
    return total, _powers(pow(base, -1, 1 << 64), len(values) + 1)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the texts, and the n + 1 offsets of the texts' words."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = ~gap
    begins[1:] &= gap[:-1] | edge[1:-1]
    ends = ~gap
    ends[:-1] &= gap[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    total, back = _prefix(data.astype(np.uint64) + np.uint64(1), OF_BYTES)
    words = _mixed((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))
    return words, np.searchsorted(start, offsets)


def _chunks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First text, word hashes and word offsets of consecutive parts of a batch."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield at, *word_hashes(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def _runs(words: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the run of ``length`` words at each place."""
    out = []
    for base in (OF_WORDS, OF_WORDS_TOO):
        total, back = _prefix(words, base)
        out.append(_mixed((total[places + length] - total[places]) * back[places]))
    return out[0].view(np.int64), (out[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _folded(h: np.ndarray, g: np.ndarray, k1: np.ndarray, k2: np.ndarray, pos: np.ndarray, window: int | None) -> pa.RecordBatch:
    """One row for each hash of a batch. The other rows of a repeated hash are known to be repeated; they carry a hash of
    their own place, so that they spread. Given a ``window``, of consecutive known rows those in between go."""
    _, first, back, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    known = count[back] > 1
    rest = np.ones(len(h), bool)
    rest[first] = False
    own = _mixed(k1.view(np.uint64) + pos.astype(np.uint64) * np.uint64(OF_WORDS)).view(np.int64)
    state = np.where(known, KNOWN, ALONE)
    if window and len(h):
        near = known[1:] & known[:-1] & (pos[1:] == pos[:-1] + 1) & (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])
        between = np.append(False, near) & np.append(near, False) & (pos % min(APART, window) != 0)
        state = np.where(between, COVERED, state)
    place = pos << 2 | state
    if window:
        place = place << 32 | g.view(np.uint32).astype(np.int64)
    stay = ~(rest & (state == COVERED))
    return pa.RecordBatch.from_arrays([pa.array(x[stay]) for x in (k1, k2, np.where(rest, own, h), place)], ["k1", "k2", "h", "p"])


def _emit(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, places_of, length: int, window: int | None) -> pa.RecordBatch:
    """Hashes of the runs at the places that ``places_of(text, words)`` names in each text of a batch."""
    k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
    parts = []
    for first, words, at in _chunks(data, offsets):
        picks = [(i, p) for i in range(len(at) - 1) if at[i + 1] - at[i] >= length and len(p := places_of(first + i, int(at[i + 1] - at[i])))]
        if not picks:
            continue
        places = np.concatenate([at[i] + p for i, p in picks])
        row = np.repeat([first + i for i, _ in picks], [len(p) for _, p in picks])
        parts.append((*_runs(words, places, length), k1[row], k2[row], np.concatenate([p for _, p in picks])))
    if not parts:
        return _folded(*(np.zeros(0, t) for t in (np.int64, np.int32, np.int64, np.int64, np.int64)), window)
    return _folded(*(np.concatenate(x) for x in zip(*parts)), window)


def _repeated(found: DataFrame, windows: bool) -> DataFrame:
    """``k1, k2, pos`` of the rows whose hash occurs again."""
    dealt, place = found.repartition("h"), F.shiftright("p", 32) if windows else F.col("p")
    rest = F.col("p").bitwiseAND(F.lit(0xFFFFFFFF)) if windows else F.lit(0)
    marked = dealt.withColumns({"place": place.cast("int"), "g": rest}).withColumn("times", F.count("*").over(Window.partitionBy("h", "g")))
    state = F.col("place").bitwiseAND(F.lit(3))
    kept = marked.filter(((F.col("times") > 1) & (state != COVERED)) | (state == KNOWN))
    return kept.select("k1", "k2", F.shiftright("place", 2).alias("pos"))


def _packed(text: Column) -> Column:
    """A text compressed on its own; half the bytes to shuffle."""

    @F.arrow_udf("binary")
    def pack(texts: pa.Array) -> pa.Array:
        press = zstandard.ZstdCompressor(level=3)
        return pa.array([press.compress(t.as_buffer().to_pybytes()) for t in texts], pa.binary())

    return pack(text)


def _unpacked(packed: pa.Array) -> list[bytes]:
    press = zstandard.ZstdDecompressor()
    return [press.decompress(t.as_buffer().to_pybytes()) for t in packed]


def remove_repeats(df: DataFrame, row_id: str = "doc_id", text: str = "text", *, window: int = 35) -> DataFrame:
    """``row_id, n_words, n_removed, kept`` for every row; the kept words are joined by one blank."""
    period, cover = cover_for(window)
    anchor = window - period + 1
    whole = F.coalesce(column(df, text), F.lit(""))
    keys = F.xxhash64(column(df, row_id), F.lit(1)).alias("k1"), F.xxhash64(whole).alias("k2")
    plain = df.select(whole.alias("text"), *keys)
    base = df.select(column(df, row_id).alias("id"), _packed(whole).alias("packed"), *keys)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def on_cover(_: int, n: int) -> np.ndarray:
            p = np.arange(n - anchor + 1)
            return p[np.isin(p % period, cover)] if n >= window else p[:0]

        for batch in batches:
            yield _emit(batch, *text_bytes(batch.column("text")), on_cover, anchor, None)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("held")
            places, at = held.flatten().to_numpy().astype(np.int64), np.concatenate(([0], np.cumsum(held.value_lengths().to_numpy())))

            def around(i: int, n: int) -> np.ndarray:
                step = np.zeros(n + 2, np.int64)
                some = places[at[i] : at[i + 1]]
                np.add.at(step, np.maximum(some - period + 1, 0), 1)
                np.add.at(step, some + 1, -1)
                return np.flatnonzero(np.cumsum(step)[: n - window + 1] > 0)

            texts = _unpacked(batch.column("packed"))
            offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
            yield _emit(batch, np.frombuffer(b"".join(texts), np.uint8), offsets, around, window, window)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, left = [], [], []
            for raw, held in zip(_unpacked(batch.column("packed")), batch.column("held")):
                words = raw.split()
                gone = 0
                if held.is_valid:
                    step = np.zeros(len(words) + 1, np.int64)
                    some = held.values.to_numpy()
                    np.add.at(step, some, 1)
                    np.add.at(step, some + window, -1)
                    stay = np.flatnonzero(np.cumsum(step)[:-1] == 0)
                    gone = len(words) - len(stay)
                    left.append(b" ".join([words[k] for k in stay.tolist()]))
                else:
                    left.append(b" ".join(words))
                n_words.append(len(words))
                n_removed.append(gone)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(left, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept"])

    def of_row(places: DataFrame) -> DataFrame:
        return places.groupBy("k1", "k2").agg(F.collect_list("pos").alias("held"))

    shared = of_row(_repeated(plain.mapInArrow(anchors, FOUND), False))
    near = base.join(shared, ["k1", "k2"]).select("id", "packed", "k1", "k2", "held").mapInArrow(windows, FOUND)
    hit = of_row(_repeated(near, True))
    kind = df.select(column(df, row_id).alias("id")).schema["id"].dataType.simpleString()
    done = base.join(hit, ["k1", "k2"], "left").select("id", "packed", "k1", "k2", "held").mapInArrow(kept, f"id {kind}, n_words bigint, n_removed bigint, kept string")
    return done.withColumnRenamed("id", row_id)
