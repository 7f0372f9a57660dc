"""Spelling variants: words one edit apart, found by asking Bloom filters of the vocabulary for every edit.

1. Words are counted inside tasks, so only (word, count) pairs are shuffled. The vocabulary is what occurs often enough.
2. The vocabulary's blocked Bloom filter is sharded by word length and, within a length, into pages of blocks. Tasks build whole pages from
   8-byte hashes; no page needs another.
3. Pages are broadcast in rounds of at most ``FILTER_BYTES``, whatever the size of the vocabulary. Every word makes its deletions, and its
   replacements by a greater letter, as hashes derived from its own; the reverse edits are the other word's. Those
   whose bits are all set are positives.
4. Only positives are shuffled, to an equi-join with the vocabulary that removes the false ones.

A word is a run of ``[A-Za-z\\u00C0-\\u00FF]``, so a code point is one byte in Latin-1, and matrices of bytes hold the words of a length.

Cases: null, empty and wordless texts have no words. Repeated rows count as often as they occur; a null id is written as an empty one. Ties between forms go to
the smaller word in code-point order. A word that fills a whole text is a word like any other. An empty table gives no rows. Other columns are not read,
whatever their names. The driver sees one count for each length of a word, and one page list; both are small against the vocabulary.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import column
from metricloom.session import materialize

#: One in so many words loses a letter, where a checksum of document and word says so.
SLIP = 31
#: Different words that a task counts before it gives them back.
COUNTED = 1 << 18
#: A block is 8 lanes of 64 bits, each with one bit for a word; 16 bits a word let about one in 1,700 absent words pass.
LANES, BLOCK_BITS, WORD_BITS = 8, 512, 16
#: Blocks of a page (1 MB), and bytes of pages that one round broadcasts.
PAGE_BLOCKS = 1 << 14
FILTER_BYTES = 32 << 20
#: Probes hashed at once, bytes of positives given back at once, and words for one task.
PROBES = 1 << 20
GIVEN_BYTES = 4 << 20
TASK_WORDS = 20_000

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SALTS = np.array([0x2545F4914F6CDD1D * (2 * k + 1) * (2 * k + 3) % (1 << 64) | 1 for k in range(LANES)], np.uint64)
U = np.uint64


def count_words(df: DataFrame, row_id: str = "doc_id", text: str = "text", *, least: int = 7, slips: int | None = SLIP) -> DataFrame:
    """``word, n`` of all words of ``least`` code points or more, A-Z lower-cased. With ``slips``, a run whose CRC-32 of ``<id>:<run>`` is divisible by it has lost
    the code point at that checksum modulo its length."""
    run = re.compile("[a-zÀ-ÿ]{%d,}" % least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for id_, value in zip(batch.column("id").to_pylist(), batch.column("text")):
                if not value.is_valid:
                    continue
                found = run.findall(value.as_buffer().to_pybytes().lower().decode())
                if slips:
                    start = zlib.crc32(f"{id_}:".encode())
                    for k, word in enumerate(found):
                        h = zlib.crc32(word.encode(), start)
                        if h % slips == 0:
                            at = h % len(word)
                            found[k] = word[:at] + word[at + 1 :]
                seen.update(found)
                if len(seen) > COUNTED:
                    yield out()
                    seen.clear()
        yield out()

    rows = df.select(F.coalesce(column(df, row_id).cast("string"), F.lit("")).alias("id"), column(df, text).cast("binary").alias("text"))
    counted = rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.length("word") >= least)


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: the length, which words have it, and their letters, a row of bytes each."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths).tolist():
        which = np.flatnonzero(lengths == length)
        letters = np.frombuffer("".join(words[k] for k in which).encode("latin-1"), np.uint8).reshape(len(which), length)
        yield length, which, letters


def _powers(n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, U), np.cumprod(np.full(n, BASE, U))]) if n else np.ones(1, U)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(29))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


def _sums(letters: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes: column i is that of the first i letters."""
    terms = letters.astype(U) * _powers(letters.shape[1])[:-1]
    return np.concatenate([np.zeros((len(letters), 1), U), np.cumsum(terms, axis=1, dtype=U)], axis=1)


def _block(mixed: np.ndarray, blocks: int) -> np.ndarray:
    return ((mixed >> U(32)) * U(blocks) >> U(32)).astype(np.int64)


class Filter:
    """Some pages of the sharded filter."""

    def __init__(self, blocks: dict[int, int], page_blocks: int, pages: dict[tuple[int, int], bytes]):
        self.blocks, self.page_blocks = blocks, page_blocks
        self.lanes = np.frombuffer(b"".join(pages.values()), U).reshape(-1, LANES)
        self.slots = {}
        for k, (length, page) in enumerate(pages):
            self.slots.setdefault(length, np.full(-(-blocks[length] // page_blocks), -1, np.int64))[page] = k

    def passes(self, length: int, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be words of the length held by these pages."""
        slots = self.slots.get(length)
        if slots is None:
            return np.zeros(0, np.int64)
        mixed = _mixed(hashes)
        block = _block(mixed, self.blocks[length])
        slot = slots[block // self.page_blocks]
        at = np.flatnonzero(slot >= 0)
        mixed, row = mixed[at], slot[at] * self.page_blocks + block[at] % self.page_blocks
        for lane in range(LANES):  # each lane leaves about four in ten
            on = (self.lanes[row, lane] >> (mixed * SALTS[lane] >> U(58))) & U(1) == 1
            at, mixed, row = at[on], mixed[on], row[on]
        return at


def _pages(vocabulary: DataFrame, blocks: dict[int, int], page_blocks: int) -> DataFrame:
    """``length, page, lanes, letters``: all pages of the filter, and the letters of their words."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, _, letters in _by_length(batch.column("word").to_pylist()):
                mixed = _mixed(_sums(letters)[:, -1])
                page = _block(mixed, blocks[length]) // page_blocks
                own, first, which = np.unique(page, return_index=True, return_inverse=True)
                some: list[bytes | None] = [None] * len(page)
                for k, at in enumerate(first.tolist()):  # the letters of a page travel with its first word
                    some[at] = bytes(np.unique(letters[which == k]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(page), length)), pa.array(page), pa.array(mixed.view(np.int64)), pa.array(some, pa.binary())], ["length", "page", "hash", "letters"])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, lanes, letters = None, None, set()

        def out() -> pa.RecordBatch:
            row = [[own[0]], [own[1]], [lanes.tobytes()], [bytes(sorted(letters))]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["length", "page", "lanes", "letters"])

        for batch in batches:
            keys = np.stack([batch.column("length").to_numpy(), batch.column("page").to_numpy()], axis=1)
            mixed = batch.column("hash").to_numpy().view(U)
            starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))) if len(keys) else []
            for a, b in zip(starts, [*starts[1:], len(keys)]):
                key = (int(keys[a, 0]), int(keys[a, 1]))
                if key != own:
                    if own:
                        yield out()
                    own, lanes, letters = key, np.zeros((page_blocks, LANES), U), set()
                some = mixed[a:b]
                row = _block(some, blocks[key[0]]) % page_blocks
                for lane in range(LANES):
                    np.bitwise_or.at(lanes, (row, lane), U(1) << (some * SALTS[lane] >> U(58)))
                for part in batch.column("letters").slice(a, b - a).drop_null().to_pylist():
                    letters.update(part)
        if own:
            yield out()

    rows = vocabulary.select("word").mapInArrow(hashed, "length bigint, page bigint, hash bigint, letters binary")
    return rows.repartition("length", "page").sortWithinPartitions("length", "page").mapInArrow(built, "length bigint, page bigint, lanes binary, letters binary")


def _probe(words: DataFrame, held, alphabet: bytes) -> DataFrame:
    """``word, n, edit`` of edits that pass the filter."""
    letters_of = np.frombuffer(alphabet, np.uint8)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = held.value
        for batch in batches:
            all_words, counts = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            rows: list[tuple] = []
            size = 0
            for word_at, edit in _edits(bloom, all_words, letters_of):
                rows.append((all_words[word_at], counts[word_at], edit))
                size += 2 * len(edit)
                if size > GIVEN_BYTES:
                    yield _given(rows)
                    rows, size = [], 0
            yield _given(rows)

    return words.mapInArrow(probe, "word string, n bigint, edit string")


def _given(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()))], ["word", "n", "edit"])


def _edits(bloom: Filter, words: list[str], alphabet: np.ndarray) -> Iterator[tuple[int, str]]:
    """Each positive: the place of the word, and its edit."""
    for length, which, letters in _by_length(words):
        if length - 1 in bloom.slots:
            yield from _deletions(bloom, words, length, which, letters)
        if length in bloom.slots:
            yield from _replacements(bloom, words, length, which, letters, alphabet)


def _deletions(bloom: Filter, words: list[str], length: int, which: np.ndarray, letters: np.ndarray) -> Iterator[tuple[int, str]]:
    step = max(1, PROBES // length)
    for low in range(0, len(which), step):
        part = letters[low : low + step]
        sums = _sums(part)
        hashes = sums[:, :-1] + (sums[:, -1:] - sums[:, 1:]) * U(INVERSE)
        new = np.ones(part.shape, bool)
        new[:, 1:] = part[:, 1:] != part[:, :-1]  # of equal neighbours any one goes
        row, at = np.nonzero(new)
        for k in bloom.passes(length - 1, hashes[row, at]).tolist():
            word = words[which[low + row[k]]]
            yield int(which[low + row[k]]), word[: at[k]] + word[at[k] + 1 :]


def _replacements(bloom: Filter, words: list[str], length: int, which: np.ndarray, letters: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[int, str]]:
    powers, codes = _powers(length), alphabet.astype(U)
    wide = max(1, min(length, PROBES // max(1, len(alphabet))))  # positions at once
    step = max(1, PROBES // (wide * max(1, len(alphabet))))
    for low in range(0, len(which), step):
        part = letters[low : low + step]
        whole = _sums(part)[:, -1]
        for left in range(0, length, wide):
            some = part[:, left : left + wide]
            row, at, code = np.nonzero(alphabet > some[:, :, None])
            hashes = whole[row] + (codes[code] - some[row, at]) * powers[left + at]
            for k in bloom.passes(length, hashes).tolist():
                place, i = int(which[low + row[k]]), left + int(at[k])
                word = words[place]
                yield place, word[:i] + chr(alphabet[code[k]]) + word[i + 1 :]


def near_pairs(vocabulary: DataFrame, *, filter_bytes: int = FILTER_BYTES, page_blocks: int = PAGE_BLOCKS) -> DataFrame:
    """``a, n_a, b, n_b``: each pair of words ``word, n`` one edit apart, once. No broadcast exceeds ``filter_bytes``."""
    spark = vocabulary.sparkSession
    counts = {r["length"]: r["count"] for r in vocabulary.groupBy(F.length("word").alias("length")).count().collect()}
    blocks = {length: -(-n * WORD_BITS // BLOCK_BITS) for length, n in counts.items()}
    total = sum(counts.values())
    pages = materialize(_pages(vocabulary, blocks, page_blocks))
    keys = sorted((length, page) for length in blocks for page in range(-(-blocks[length] // page_blocks)))
    at_once = max(1, filter_bytes // (page_blocks * BLOCK_BITS // 8))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / TASK_WORDS))
    spread = vocabulary.repartition(tasks)
    alphabet = bytes(sorted({c for r in pages.select("letters").distinct().collect() for c in r["letters"]}))  # at most 90
    positives = []
    for low in range(0, len(keys), at_once):
        own = keys[low : low + at_once]
        first, last = (F.struct(*[F.lit(x).cast("bigint").alias(c) for c, x in zip(("length", "page"), key)]) for key in (own[0], own[-1]))
        between = F.struct("length", "page").between(first, last)
        bloom = Filter(blocks, page_blocks, {(r["length"], r["page"]): bytes(r["lanes"]) for r in pages.filter(between).collect()})
        words = spread if len(keys) <= at_once else spread.filter(F.length("word").between(own[0][0], own[-1][0] + 1))
        positives.append(materialize(_probe(words, spark.sparkContext.broadcast(bloom), alphabet)))
    edits = positives[0] if positives else vocabulary.limit(0).select("word", "n", F.col("word").alias("edit"))
    for more in positives[1:]:
        edits = edits.unionByName(more)
    known = vocabulary.select(F.col("word").alias("edit"), F.col("n").alias("n_edit"))
    return edits.join(known, "edit").select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("edit").alias("b"), F.col("n_edit").alias("n_b"))


def group_variants(vocabulary: DataFrame, *, ratio: int = 10, filter_bytes: int = FILTER_BYTES, page_blocks: int = PAGE_BLOCKS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each of ``word, n``: the most frequent near word if it is ``ratio`` times as frequent, and where following forms ends."""
    vocabulary = materialize(vocabulary.select("word", "n"))
    both = F.array(*[F.struct(F.col(a).alias("word"), F.col(f"n_{b}").alias("n"), F.col(b).alias("near")) for a, b in ("ab", "ba")])
    sides = near_pairs(vocabulary, filter_bytes=filter_bytes, page_blocks=page_blocks).select(F.explode(both).alias("s")).select("s.*")
    best = F.min(F.struct((-F.col("n")).alias("m"), "near")).alias("best")
    near = sides.groupBy("word").agg(F.count("*").alias("n_near"), best).select("word", "n_near", "best.near", (-F.col("best.m")).alias("near_n"))
    follows = F.col("near_n") >= ratio * F.col("n")
    found = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(follows, F.col("near")).alias("form"), F.when(follows, F.col("near_n")).alias("form_n")
    )
    found = materialize(found)
    roots = _roots(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(hooks: DataFrame) -> DataFrame:
    """``word, root`` at the end of each chain. A form is ``ratio`` times as frequent as its word, so chains are short and have no circles."""
    hooks = materialize(hooks)
    while True:
        upper = hooks.select(F.col("word").alias("root"), F.col("root").alias("above"))
        jumped = materialize(hooks.join(upper, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        hooks = jumped.select("word", "root")
        if jumped.filter("moved").isEmpty():
            return hooks
