"""SentencePiece encoding and decoding over a lattice of pieces.

A text gets a leading blank, blanks become U+2581, and it is cut before each of them: no piece has one after
another character, so words are independent. The lattice of a word is relational: its substrings up to the longest piece
are exploded, joined by equality with the piece table, grouped by word and folded from left to right.

Two folds stand over the same lattice. For a unigram model the Viterbi fold keeps the best
score for each place (``viterbi``, DataFrame operations only). The piece table at hand belongs to a merge (BPE) model, whose
scores are merge ranks; there the best path is not what the model was trained to emit. ``Encoder``
therefore folds by the rule of merges: the piece that ends at a place is the one that holds together with the piece before it, which
means that no merge across their border comes before the merges inside them. At every place
exactly one piece does. The result is the model's own ids.

Distinct words are folded once for each partition, in numpy, over all words of a length together. Runs of blanks, whose pieces have
the lowest rank, are merged after the words. Characters without a piece become byte pieces.

Cases: a null text has null ids, an empty one none. Repeated rows are encoded alike. U+2581 in a text is decoded as a blank, as the
model does; every other text comes back exactly. Byte pieces that are no UTF-8 decode to U+FFFD. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.llm.common import column, small_batches, text_bytes

BLANK = "▁"
#: Bytes of text encoded at once (small batches are put together; every call of numpy then has more words to do), words that a partition remembers,
#: and the word length from which words are folded singly.
CHUNK = 2_000_000
REMEMBERED = 500_000
LONG = 48
OF_POINTS = 0x9E3779B97F4A7C15
SLOTS = 19  # bits of the number of remembered pairs
NONE, UNKNOWN, START = -1, -2, -3
FREE = 1 << 40  # a rank that no merge has


class PieceTable:
    """Pieces of a model file: text, score and kind; and for merge models the two halves and the rank of each piece."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        self.texts = [model.id_to_piece(i) for i in range(size)]
        self.scores = [model.get_score(i) for i in range(size)]
        self.byte_ids = {int(self.texts[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.unknown = model.unk_id()
        skip = {i for i in range(size) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.normal = {t: i for i, t in enumerate(self.texts) if i not in skip}
        self.longest = max(map(len, self.normal), default=1)
        self.silent = [model.is_control(i) for i in range(size)]

    def merges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rank (-1: a single character, FREE: never formed), left and right half of each piece."""
        size = len(self.texts)
        rank, left, right = np.full(size, FREE), np.arange(size), np.arange(size)
        order = sorted(self.normal.values(), key=lambda i: (-self.scores[i], i))
        place = {i: k for k, i in enumerate(order)}
        for i in order:
            text = self.texts[i]
            if len(text) == 1:
                rank[i] = -1
                continue
            parts = [self.normal.get(c) for c in text]
            while len(parts) > 2 and None not in parts:
                best = None
                for k in range(len(parts) - 1):
                    whole = self.normal.get(self.texts[parts[k]] + self.texts[parts[k + 1]])
                    if whole is not None and place[whole] < place[i] and (best is None or place[whole] < place[best[0]]):
                        best = whole, k
                if best is None:
                    break
                parts[best[1] : best[1] + 2] = [best[0]]
            if len(parts) == 2 and None not in parts:
                rank[i], left[i], right[i] = place[i], parts[0], parts[1]
        return rank, left, right


class Encoder:
    """The ids that a merge model gives to texts."""

    def __init__(self, pieces: PieceTable):
        self.rank, self.left, self.right = pieces.merges()
        formed = {t: i for t, i in pieces.normal.items() if self.rank[i] < FREE and not (len(t) > 1 and t == BLANK * len(t))}
        self.formed, self.longest = formed, max(map(len, formed), default=1)
        self.blank = pieces.normal.get(BLANK, UNKNOWN)
        self.blanks = {len(t): i for t, i in pieces.normal.items() if t == BLANK * len(t)}
        self.byte_ids = np.array([pieces.byte_ids.get(b, pieces.unknown) for b in range(256)], np.int32)
        self.whole_unknown = None if len(pieces.byte_ids) == 256 else pieces.unknown
        joins = {}
        for i in formed.values():
            if self.rank[i] >= 0:
                joins[(int(self.left[i]) << 32) | int(self.right[i])] = int(self.rank[i])
        self.join_keys = np.array(sorted(joins), np.int64)
        self.join_ranks = np.array([joins[k] for k in sorted(joins)] + [FREE], np.int64)
        by_hash = sorted((self._hash(np.array([[ord(c) for c in t]]))[0], i) for t, i in formed.items())
        self.hashes = np.array([h for h, _ in by_hash], np.uint64)
        self.ids = np.array([i for _, i in by_hash], np.int64)
        self.likely = np.zeros(1 << 20, bool)  # by the first bits of a hash: whether any piece has them
        self.likely[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    @staticmethod
    def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for base in (OF_POINTS, pow(OF_POINTS, -1, 1 << 64)):
            p = np.full(max(n, 1), base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        return out[0], out[1]

    def _hash(self, points: np.ndarray) -> np.ndarray:
        up, _ = self._powers(points.shape[1])
        return ((points.astype(np.uint64) + np.uint64(1)) * up[None, :]).sum(axis=1, dtype=np.uint64)

    def hold(self, a: np.ndarray, b: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """True where no merge across the border of pieces ``a`` and ``b`` comes before the merges inside them.

        ``known`` remembers pairs: a key and an answer in each slot, a newer pair taking the slot of an older one.
        """
        if known is None:
            return self._hold(a, b)
        pair = (a << np.int64(32)) + b
        slot = (pair.view(np.uint64) * np.uint64(OF_POINTS) >> np.uint64(64 - SLOTS)).astype(np.int64)
        ok, new = known[1][slot], np.flatnonzero(known[0][slot] != pair)
        if len(new):
            ok[new] = known[1][slot[new]] = self._hold(a[new], b[new])
            known[0][slot[new]] = pair[new]
            clash = new[known[0][slot[new]] != pair[new]]  # two new pairs of this call in one slot: the later one stays
            known[1][slot[new]] = ok[new]
            if len(clash):
                known[0][slot[clash]] = -1
        return ok

    def _hold(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = np.ones(len(a), bool)
        at = np.flatnonzero((a >= 0) & (b >= 0))  # an unknown character or the start of the word merges with nothing
        a, b, limit = a[at], b[at], np.full(len(at), FREE)
        while len(at):
            key = (a << np.int64(32)) | b
            k = np.searchsorted(self.join_keys, key)
            hit = self.join_keys[np.minimum(k, len(self.join_keys) - 1)] == key if len(self.join_keys) else np.zeros(len(key), bool)
            across = np.where(hit, self.join_ranks[np.where(hit, k, -1)], FREE)
            bad = across < limit
            ok[at[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            on = ~bad & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[on], a[on], b[on], ra[on], rb[on]
            left = ra > rb  # undo the later merge; an equal one stands to the right of the border, so it comes later
            limit = np.where(left, ra, rb + 1)
            a, b = np.where(left, self.right[a], a), np.where(left, b, self.left[b])
        return ok

    def fold(self, points: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of one length, a row each: all ids in a row, and how many each word has.

        Short pieces are tried first; a word whose piece is found drops out of the longer ones.
        """
        n, length = points.shape
        up, down = self._powers(length + 1)
        sums = np.zeros((n, length + 1), np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[None, :length], axis=1, out=sums[:, 1:])
        last = np.full((n, length + 1), NONE, np.int64)
        begin = np.zeros((n, length + 1), np.int32)
        last[:, 0] = START
        for j in range(1, length + 1):
            open_ = np.arange(n)
            for i in range(j - 1, max(0, j - self.longest) - 1, -1):
                h = (sums[open_, j] - sums[open_, i]) * down[i]
                some = np.flatnonzero(self.likely[(h >> np.uint64(44)).astype(np.int64)] & (last[open_, i] != NONE))
                rows, h = open_[some], h[some]
                k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                right = self.hashes[k] == h
                rows, piece = rows[right], self.ids[k[right]]
                if len(rows):
                    ok = self.hold(last[rows, i], piece, known)
                    last[rows[ok], j], begin[rows[ok], j] = piece[ok], i
                if i == j - 1:  # a character without a piece is in no longer piece either
                    odd = np.setdiff1d(open_[last[open_, i] != NONE], rows, assume_unique=True)
                    last[odd, j], begin[odd, j] = UNKNOWN, i
                open_ = open_[last[open_, j] == NONE]
                if not len(open_):
                    break
        ends, path, everyone = np.full(n, length), [], np.arange(n)
        while (ends > 0).any():
            path.append(np.where(ends > 0, np.where(last[everyone, ends] == UNKNOWN, -2 - points[everyone, np.maximum(ends - 1, 0)].astype(np.int64), last[everyone, ends]), NONE))
            ends = begin[everyone, ends]
        steps = np.stack(path[::-1], axis=1) if path else np.zeros((n, 0), np.int64)
        return steps[steps != NONE], (steps != NONE).sum(axis=1)

    def fold_long(self, points: np.ndarray) -> np.ndarray:
        """The same for one long word, place by place."""
        word = "".join(map(chr, points.tolist()))
        known: dict[tuple[int, int], bool] = {}
        last, begin = [START], [0]
        for j in range(1, len(word) + 1):
            for i in range(max(0, j - self.longest), j):
                piece = self.formed.get(word[i:j], UNKNOWN if i == j - 1 else NONE)
                if piece == NONE or last[i] == NONE:
                    continue
                pair = (last[i], piece)
                if pair not in known:
                    known[pair] = bool(self.hold(np.array([pair[0]]), np.array([pair[1]]))[0])
                if known[pair]:
                    last.append(piece)
                    begin.append(i)
                    break
            else:
                last.append(NONE)
                begin.append(j - 1)
        out, j = [], len(word)
        while j:
            out.append(last[j] if last[j] != UNKNOWN else -2 - int(points[j - 1]))
            j = begin[j]
        return np.array(out[::-1], np.int64)

    def _spelled(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters (-2 - code point) as byte pieces."""
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids.astype(np.int32), counts
        parts, at, extra = [], 0, np.zeros(len(ids), np.int64)
        for k in odd.tolist():
            raw = np.frombuffer(chr(-2 - ids[k]).encode("utf-8", "surrogatepass"), np.uint8)
            some = self.byte_ids[raw] if self.whole_unknown is None else np.array([self.whole_unknown], np.int32)
            parts += [ids[at:k].astype(np.int32), some]
            extra[k], at = len(some) - 1, k + 1
        parts.append(ids[at:].astype(np.int32))
        more = np.concatenate(([0], np.cumsum(extra)))
        ends = np.cumsum(counts)
        return np.concatenate(parts), counts + more[ends] - more[ends - counts]

    def _blank_run(self, n: int) -> list[int]:
        out = []
        while n:
            k = max((k for k in self.blanks if k <= n), default=1)
            out.append(self.blanks.get(k, self.blank))
            n -= k
        return out

    def words(self, points: np.ndarray, start: np.ndarray, size: np.ndarray, extra: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words given by their place in ``points``: all ids, where each word's begin, and how many it has.
        ``extra`` blanks stand before each."""
        parts, at, n, total = [np.zeros(0, np.int32)], np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), 0

        def store(rows: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
            nonlocal total
            ids, counts = self._spelled(ids, counts)
            at[rows], n[rows] = total + np.cumsum(counts) - counts, counts
            parts.append(ids)
            total += len(ids)

        order = np.argsort(size, kind="stable")
        lengths, first = np.unique(size[order], return_index=True)
        for length, rows in zip(lengths.tolist(), np.split(order, first[1:])):
            if length > LONG:
                for r in rows.tolist():
                    ids = self.fold_long(points[start[r] : start[r] + length])
                    store(np.array([r]), ids, np.array([len(ids)]))
                continue
            for k in range(0, len(rows), 5_000):
                some = rows[k : k + 5_000]
                store(some, *self.fold(points[start[some][:, None] + np.arange(length)], known))
        flat = np.concatenate(parts)
        for r in np.flatnonzero(extra).tolist():
            own = flat[at[r] : at[r] + n[r]].tolist()
            joins = bool(own) and own[0] == self.blank  # the word's own blank is left over too
            ids = np.array(self._blank_run(int(extra[r]) + int(joins)) + own[int(joins) :], np.int32)
            at[r], n[r] = total, len(ids)
            parts.append(ids)
            total += len(ids)
        return np.concatenate(parts), at, n


class _Memory:
    """Words of a partition that are already folded, by hash."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.pairs = np.full(1 << SLOTS, -1, np.int64), np.zeros(1 << SLOTS, bool)
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.n, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def lookup(self, keys: np.ndarray, points: np.ndarray, start: np.ndarray, size: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in ``ids`` and count of every word; ``keys`` are distinct and ascending."""
        if len(self.keys) > REMEMBERED:
            self.clear()
        k = np.searchsorted(self.keys, keys)
        new = np.flatnonzero(self.keys[np.minimum(k, len(self.keys) - 1)] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            ids, at, n = self.encoder.words(points, start[new], size[new], extra[new], self.pairs)
            at = at + len(self.ids)
            order = np.argsort(all_keys := np.concatenate((self.keys, keys[new])), kind="stable")
            self.keys = all_keys[order]
            self.at, self.n = np.concatenate((self.at, at))[order], np.concatenate((self.n, n))[order]
            self.ids = np.concatenate((self.ids, ids))
        k = np.searchsorted(self.keys, keys)
        return self.at[k], self.n[k]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and the n + 1 offsets of the texts."""
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        count = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
        full = np.diff(count) > 0
        points = np.insert(points, count[:-1][full], 32)
        bounds = count + np.concatenate(([0], np.cumsum(full)))
        points = np.where(points == 32, np.uint32(ord(BLANK)), points)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        blank = points == ord(BLANK)
        edge = np.zeros(len(points) + 1, bool)
        edge[bounds] = True
        first = blank.copy()
        first[1:] &= ~blank[:-1] | edge[1:-1]
        core = blank.copy()
        core[:-1] &= ~blank[1:] | edge[1:-1]
        begin, start = np.flatnonzero(first), np.flatnonzero(core)
        end = np.append(begin[1:], len(points))
        up, down = Encoder._powers(len(points) + 1)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=sums[1:])
        extra = start - begin
        h = (sums[end] - sums[start]) * down[start] + (extra.astype(np.uint64) << np.uint64(8)) + (end - start).astype(np.uint64)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        keys, pick, back = np.unique(h, return_index=True, return_inverse=True)
        at, n = self.lookup(keys, points, start[pick], (end - start)[pick], extra[pick])
        n, at = n[back], at[back]
        upto = np.concatenate(([0], np.cumsum(n)))
        flat = np.repeat(at - upto[:-1], n) + np.arange(upto[-1])
        return self.ids[flat], upto[np.searchsorted(begin, bounds)]


class _Decoder:
    """Texts of ids, from one gather of the pieces' bytes."""

    def __init__(self, pieces: PieceTable):
        byte_of = {i: bytes([b]) for b, i in pieces.byte_ids.items()}
        plain = [byte_of.get(i, b"" if pieces.silent[i] else " ⁇ ".encode() if i == pieces.unknown else t.replace(BLANK, " ").encode()) for i, t in enumerate(pieces.texts)]
        bare = [p[1:] if p.startswith(b" ") and i not in byte_of else p for i, p in enumerate(plain)]
        self.size, self.table = len(plain), plain + bare

    def texts(self, flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """``flat`` holds the ids of all texts, ``bounds`` their n + 1 offsets."""
        ids = flat.astype(np.int64)
        ids[bounds[:-1][np.diff(bounds) > 0]] += self.size  # the first piece of a text loses the blank that was put before it
        _, offsets, data = pa.array(self.table, pa.binary()).take(pa.array(ids)).buffers()
        ends = np.frombuffer(offsets, np.int32)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
        texts = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends[bounds])), data])
        try:
            return texts.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([t.as_py().decode("utf-8", "replace") for t in texts], pa.string())


@cache
def coders_of(model_file: str) -> tuple[Encoder, _Decoder]:
    pieces = PieceTable(model_file)
    return Encoder(pieces), _Decoder(pieces)


def _gathered(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts, in column ``place``, have about ``CHUNK`` bytes, or that are given larger."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(place).nbytes
        if size >= CHUNK:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def encode(df: DataFrame, model_file: str, text: str = "text", ids: str = "ids", *, check: str | None = None, keep_text: bool = True) -> DataFrame:
    """``df`` with the ids of ``text`` as an array column, and on request with a column ``check`` that says whether
    decoding them gives the text back. Columns of these names are replaced."""
    small_batches(df.sparkSession)
    encoder, decoder = coders_of(model_file)
    names = [c for c in df.columns if c not in (ids, check)]
    place = names.index(text)
    plain = df.select(*[column(df, c).alias(f"c{k}") for k, c in enumerate(names)])
    kept = [k for k in range(len(names)) if keep_text or k != place]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Memory(encoder)
        for batch in _gathered(batches, place):
            data, offsets = text_bytes(batch.column(place))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
                flat, ends = memory.encode(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
                part = batch.slice(at, to - at)
                gone = part.column(place).is_null()
                out = {f"c{k}": part.column(k) for k in kept}
                out["ids"] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, pa.int32()), mask=gone)
                if check:
                    same = pa.compute.equal(decoder.texts(flat, ends), part.column(place).fill_null(""))
                    out["check"] = pa.compute.if_else(gone, True, same)
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))
                at = to

    kinds = [plain.schema.fields[k] for k in kept] + [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    kinds += [T.StructField("check", T.BooleanType())] if check else []
    return plain.mapInArrow(run, T.StructType(kinds)).toDF(*[names[k] for k in kept], ids, *([check] if check else []))


#: Lists of ids decoded at once.
LISTS = 500


def decoded(ids: Column, model_file: str) -> Column:
    """The text of an array of ids; null for null."""
    _, decoder = coders_of(model_file)

    @F.arrow_udf("string")
    def join(lists: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(lists), LISTS):
            some = lists.slice(at, LISTS)
            bounds = np.concatenate(([0], np.cumsum(np.array(some.value_lengths().fill_null(0)))))
            texts = decoder.texts(some.flatten().to_numpy(zero_copy_only=False), bounds)
            out.append(pa.compute.if_else(some.is_null(), pa.scalar(None, pa.string()), texts))
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    return join(ids)


def piece_rows(spark: SparkSession, model_file: str) -> DataFrame:
    """``piece, id, score`` of the normal pieces; as many rows as the vocabulary has."""
    pieces = PieceTable(model_file)
    return spark.createDataFrame([(t, i, float(pieces.scores[i])) for t, i in pieces.normal.items()], "piece string, id int, score double")


def viterbi(words: DataFrame, pieces: DataFrame, word: str = "word", *, longest: int = 16, penalty: float = 10.0) -> DataFrame:
    """``word, ids``: the path of best total score through the lattice of each distinct word, as a unigram model takes it.

    Substrings are exploded, joined with the piece table, grouped by word and folded with a higher-order aggregate. A character without
    a piece gets id -1 and the lowest score less ``penalty``. Of equal paths the one with the longer last piece stays. Null words go.
    """
    low = (pieces.agg(F.min("score")).first()[0] or 0.0) - penalty
    distinct = words.select(column(words, word).alias("word")).filter(F.col("word").isNotNull() & (F.col("word") != "")).distinct()
    size = F.length("word")
    starts = distinct.select("word", F.explode(F.sequence(F.lit(1), size)).alias("i"))
    spans = starts.select("word", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), size - F.col("i") + 1))).alias("n"))
    named = spans.withColumn("piece", F.substring("word", F.col("i"), F.col("n")))
    edges = named.join(F.broadcast(pieces), "piece", "left").filter(F.col("id").isNotNull() | (F.col("n") == 1))
    edge = F.struct((F.col("i") + F.col("n") - 1).alias("end"), F.col("i").alias("i"), F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("score", F.lit(low)).alias("score"))
    grouped = edges.groupBy("word").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    kind = "array<struct<score:double,i:int,id:int>>"  # best way to each place; place 0 first

    def step(state: Column, e: Column) -> Column:
        total = F.element_at(state, e["i"])["score"] + e["score"]
        way = F.struct(total.alias("score"), e["i"].alias("i"), e["id"].alias("id"))
        open_ = F.size(state) <= e["end"]
        better = F.element_at(state, -1)["score"] < total
        return F.when(open_, F.concat(state, F.array(way))).when(better, F.concat(F.slice(state, F.lit(1), F.size(state) - 1), F.array(way))).otherwise(state)

    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("i"), F.lit(0).alias("id"))).cast(kind)
    ways = grouped.select("word", F.aggregate("edges", first, step).alias("ways"))

    def back(state: Column, _: Column) -> Column:
        at = F.element_at(F.col("ways"), state["at"])
        moved = F.struct(at["i"].alias("at"), F.concat(F.array(at["id"]), state["ids"]).alias("ids"))
        return F.when(state["at"] > 1, moved).otherwise(state)

    last = F.struct(F.size("ways").alias("at"), F.array().cast("array<int>").alias("ids"))
    path = F.aggregate(F.sequence(F.lit(1), F.size("ways")), last, back)["ids"]
    return ways.select("word", path.alias("ids"))
