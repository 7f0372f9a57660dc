"""Near-duplicates by SimHash: fingerprints that differ in few bits, found by walking binary tries.

Fingerprint: lower-case A-Z, take the words, shingle them (``shingle`` words, repeats included, one blank
between; fewer words make one shingle), hash each with XXH64 (seed 42). A bit is set if it is
set in over half of the hashes. A text without words has fingerprint zero.

Links: equal fingerprints are one node from the start, so copies cost nothing further. The different ones are filed under
keys, and the fingerprints of a key form a binary trie, kept as ranges of a sorted array; node pairs are
walked together from the root, differing bits are summed, and a pair of nodes is given up when the sum
exceeds the budget. What leaves a task is a spanning forest of the links, never all pairs. Components
of these edges are found by hooking each node to its smallest neighbour, shortening paths and contracting, until no edge is left.

* ``near_duplicates``: 64 bits, budget 3, exact. Two fingerprints within three bits agree on one of four 16-bit blocks, and on one of four
  12-bit blocks of the remaining 48, so each is filed under 16 keys.
* ``keep_one``: similarity of shingle sets, so each different shingle votes once. 64 bits cannot tell a similarity of 0.8 from 0.6, so the
  fingerprint has 512 bits and the budget is the angle that belongs to the similarity plus three
  standard deviations. A key is a random choice of bits; how many bits follows from the number of fingerprints, and how
  many keys from the bits, so that a pair at the threshold shares a key with a chance of 0.99 at every size. These links are only
  candidates: one counts if the shingle sets themselves are as similar as asked. First the edges of a spanning forest of the
  candidates are measured; where some of a candidate component's edges fail, the nodes outside its largest part meet all its nodes in blocks, and
  each task gives back only links that join parts.

Cases: null, empty and blank texts have fingerprint zero and link like any other. Rows with a
null id are nodes too; a component with no id at all has a null component_id. Repeated rows give repeated result
rows. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import column, fresh, small_batches, text_bytes
from metricloom.session import materialize

BUDGET = 3
SEED = 42
#: 64-bit words of the fingerprint that measures similarity, and the chance that a pair at the threshold shares a key.
WIDE = 8
RECALL = 0.99
#: Node pairs that are walked at once, and hashes whose bits are counted at once.
FRONTIER = 1 << 19
COUNTED = 1 << 16
#: Edges given back at once, and rounds in which each fingerprint has one of its candidate links measured, before all of those that are left are.
GIVEN = 1 << 16
ROUNDS = 2
#: Nodes and shingle hashes of a block whose sets are compared, and 64-bit words that are compared at once.
BLOCK_NODES, BLOCK_ENTRIES = 1024, 1 << 19
COMPARED = 1 << 22


def hashes_of(text: bytes, shingle: int) -> list[int]:
    """Hashes of the shingles in order, repeats included."""
    parts = text.lower().split()
    if not parts:
        return []
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    start = end - size
    span = min(shingle, len(parts))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(start[: len(parts) - span + 1].tolist(), end[span - 1 :].tolist())]


def fingerprint_of(text: bytes, shingle: int, wide: int = 1, once: bool = False) -> bytes:
    """``wide`` big-endian 64-bit words; the first comes from the hashes themselves, each further one from a mix of them.
    With ``once`` a repeated shingle counts once."""
    hashes = hashes_of(text, shingle)
    if once:
        hashes = np.unique(np.array(hashes, np.uint64))
    if not len(hashes):
        return bytes(8 * wide)
    ones = np.zeros(64 * wide, np.int64)
    for at in range(0, len(hashes), COUNTED // wide):
        some = np.array(hashes[at : at + COUNTED // wide], np.uint64)
        all_ = np.stack([some, *(_mixed(some, k) for k in range(1, wide))], axis=1).astype(">u8")
        ones += np.unpackbits(all_.view(np.uint8).reshape(len(some), -1), axis=1).sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    x = x + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: Column, shingle: int = 5, wide: int = 1, once: bool = False) -> Column:
    """The fingerprint as big-endian bytes."""

    @F.arrow_udf("binary")
    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle, wide, once) for t in texts], pa.binary())

    return hashed(text)


def shingle_set(text: Column, shingle: int = 5) -> Column:
    """The different shingle hashes, ascending."""

    @F.arrow_udf("array<bigint>")
    def hashed(texts: pa.Array) -> pa.Array:
        sets = [np.unique(np.array(hashes_of(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle), np.uint64)).view(np.int64) for t in texts]
        return pa.array(sets, pa.list_(pa.int64()))

    return hashed(text)


def trie_links(values: np.ndarray, starts: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``budget`` bits inside each group of ``values`` (a row of 64-bit words each); groups begin at
    ``starts``, and the values of a group are distinct and ascending."""
    ends = np.append(starts[1:], len(values))
    several = ends - starts > 1
    lo, hi = starts[several], ends[several]
    stack = [(0, lo, hi, lo, hi, np.zeros(len(lo), np.int16))]
    while stack:
        bit, a0, a1, b0, b1, diff = stack.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            for part in (slice(half, None), slice(0, half)):
                stack.append((bit, a0[part], a1[part], b0[part], b1[part], diff[part]))
            continue
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            i, j = a0[leaf], b0[leaf]
            i, j = i[i != j], j[i != j]
            total = np.zeros(len(i), np.int16)
            for w in range(values.shape[1]):
                total += np.bitwise_count(values[i, w] ^ values[j, w])
                on = total <= budget
                if not on.all():
                    i, j, total = i[on], j[on], total[on]
            if len(i):
                yield i, j
            a0, a1, b0, b1, diff = (x[~leaf] for x in (a0, a1, b0, b1, diff))
        if not len(a0) or bit == 64 * values.shape[1]:
            continue
        am, bm = _middle(values, a0, a1, bit), _middle(values, b0, b1, bit)
        kids = [(a0, am, b0, bm, diff, None), (am, a1, bm, b1, diff, None), (a0, am, bm, b1, diff + 1, None), (am, a1, b0, bm, diff + 1, a0 != b0)]
        parts = []
        for k0, k1, l0, l1, d, only in kids:
            ok = (k1 > k0) & (l1 > l0) & (d <= budget)
            if only is not None:
                ok &= only
            parts.append([x[ok] for x in (k0, k1, l0, l1, d)])
        stack.append((bit + 1, *(np.concatenate(x) for x in zip(*parts))))


def _middle(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """First index of each range whose value has the bit set, bit 0 being the highest; the bits before are equal in a range."""
    lo, hi, column_, shift = lo.copy(), hi.copy(), values[:, bit // 64], np.uint64(63 - bit % 64)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        one = (column_[np.minimum(mid, len(values) - 1)] >> shift) & np.uint64(1) == 1
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)


def _hook(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return parent
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _forest(value: np.ndarray, starts: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each value with the root of its component."""
    parent = np.arange(len(value))
    for i, j in trie_links(value, starts, budget):
        parent = _hook(parent, i, j)
    low = np.flatnonzero(parent != np.arange(len(value)))
    yield low, parent[low]


def _merging(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Those of the links that join two trees of ``parent``, which then are one."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        high, first = np.unique(np.maximum(a, b), return_index=True)
        parent[high] = np.minimum(a, b)[first]
        yield i[first], j[first]
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def _linked_forest(value: np.ndarray, starts: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest whose edges are links themselves: first that of each value to its nearest, then what else joins trees."""
    none = np.int64(budget + 1 << 40)
    best, spare, met = np.full(len(value), none), [], np.arange(len(value))
    for i, j in trie_links(value, starts, budget):
        bits = np.bitwise_count(value[i] ^ value[j]).sum(axis=1, dtype=np.int64) << 40
        np.minimum.at(best, i, bits | j)
        np.minimum.at(best, j, bits | i)
        spare += _merging(met, i, j)
    parent, linked = np.arange(len(value)), np.flatnonzero(best < none)
    for i, j in [(linked, best[linked] & (1 << 40) - 1), *spare]:
        yield from _merging(parent, i, j)


def _words(prints: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(prints)
    return data.view(">u8").reshape(len(offsets) - 1, -1).astype(np.uint64) if len(data) else np.zeros((0, 1), np.uint64)


def _bytes(words: np.ndarray) -> pa.Array:
    wide = words.shape[1] * 8
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(wide), len(words), [None, pa.py_buffer(words.astype(">u8").tobytes())]).cast(pa.binary())


def _block_keys(words: np.ndarray) -> np.ndarray:
    """The 16 keys of each 64-bit fingerprint: one 16-bit block, and one 12-bit block of the rest."""
    value, out = words[:, 0], []
    for i in range(4):
        block = value >> np.uint64(16 * i) & np.uint64(0xFFFF)
        low = value & np.uint64((1 << 16 * i) - 1)
        rest = low if i == 3 else value >> np.uint64(16 * (i + 1)) << np.uint64(16 * i) | low
        out += [np.uint64((i * 4 + j) << 28) + block * np.uint64(4096) + (rest >> np.uint64(12 * j) & np.uint64(0xFFF)) for j in range(4)]
    return np.stack(out, axis=1).view(np.int64)


def _chosen_keys(bits: int, keys: int, wide: int):
    """A function for keys of ``bits`` bits chosen at random from the whole fingerprint."""
    rng = np.random.default_rng(3)
    chosen = [rng.choice(64 * wide, bits, replace=False) for _ in range(keys)]

    def of(words: np.ndarray) -> np.ndarray:
        out = np.zeros((len(words), keys), np.int64)
        for k, some in enumerate(chosen):
            for b in some.tolist():
                out[:, k] = out[:, k] << 1 | (words[:, b // 64] >> np.uint64(63 - b % 64) & np.uint64(1)).astype(np.int64)
            out[:, k] |= k << 40
        return out

    return of


def links(distinct: DataFrame, budget: int = BUDGET, keys_of=_block_keys, pick=_forest) -> DataFrame:
    """Edges ``a, b`` that ``pick`` takes of the links between the distinct fingerprints ``fp`` at most ``budget`` bits apart that share a key."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = keys_of(_words(batch.column("fp"))) if batch.num_rows else np.zeros((0, 0), np.int64)
            for k in range(keys.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(keys[:, k])), *batch.columns], ["key", *batch.schema.names])

    sorted_ = distinct.select("fp").mapInArrow(file, "key bigint, fp binary").repartition("key").sortWithinPartitions("key")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, (value,) in _runs(batches, lambda batch: [_words(batch.column("fp"))]):
            order = np.lexsort((*value.T[::-1], key))
            key, value = key[order], value[order]
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            for i, j in pick(value, starts, budget):
                yield from _edges(value, i, j)

    return sorted_.mapInArrow(walk, "a binary, b binary").distinct()


def _runs(batches: Iterator[pa.RecordBatch], columns_of) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Keys and columns of sorted batches, cut where a key ends."""
    left = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column("key").to_numpy(), *columns_of(batch)]
        if left is not None:
            now = [np.concatenate(x) for x in zip(left, now)]
        cut = int(np.searchsorted(now[0], now[0][-1]))  # the last key may go on in the next batch
        if cut:
            yield now[0][:cut], [x[:cut] for x in now[1:]]
        left = [x[cut:] for x in now]
    if left is not None:
        yield left[0], left[1:]


def _edges(value: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(i), GIVEN):
        yield pa.RecordBatch.from_arrays([_bytes(value[i[at : at + GIVEN]]), _bytes(value[j[at : at + GIVEN]])], ["a", "b"])


def _width(similarity: float, wide: int) -> tuple[float, int]:
    """The share of bits in which sets of that similarity and equal size differ, and the budget of bits that follows from it."""
    part = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return part, int(64 * wide * part + 3 * math.sqrt(64 * wide * part * (1 - part)))


def candidates(distinct: DataFrame, similarity: float, wide: int = WIDE) -> DataFrame:
    """Edges between fingerprints of ``wide`` words whose shingle sets may be as similar as asked."""
    part, budget = _width(similarity, wide)
    bits = max(10, math.ceil(math.log2(max(2, distinct.count()))) - 4)
    keys = math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - part) ** bits)) if part else 1
    return links(distinct, budget, _chosen_keys(bits, keys, wide), _linked_forest)


def _measured(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``a, b, alike``: whether the Jaccard similarity of the shingle sets ``fp, held`` reaches the one asked; empty sets are equal."""
    sides = [sets.select(F.col("fp").alias(k), F.col("held").alias(f"{k}_held")) for k in ("a", "b")]
    both = pairs.join(sides[1], "b").join(sides[0], "a")
    common = F.size(F.array_intersect("a_held", "b_held"))
    every = F.size("a_held") + F.size("b_held") - common
    return both.select("a", "b", F.coalesce(F.try_divide(common, every) >= similarity, F.lit(True)).alias("alike"))


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Those of the pairs that are alike, as many as are needed for the components, and these components; a pair inside one is passed over."""
    left = materialize(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    held = None
    for k in range(ROUNDS + 1):
        asked = left if k == ROUNDS else left.groupBy("a").agg(F.min("b").alias("b"))
        asked = materialize(_measured(asked, sets, similarity))
        good = asked.filter("alike").select("a", "b")
        held = good if held is None else held.unionByName(good)
        roots = materialize(components(held))  # read several times
        if k == ROUNDS:
            break
        ends = [roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in ("a", "b")]
        left = left.join(asked.select("a", "b"), ["a", "b"], "left_anti").join(ends[0], "a", "left").join(ends[1], "b", "left")
        left = materialize(left.filter(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b"))
        if left.isEmpty():
            break
    return held, roots


def similar(distinct: DataFrame, sets_of, similarity: float, wide: int = WIDE) -> DataFrame:
    """``node, root`` of the fingerprints that hang together by candidates whose shingle sets are as similar as asked. ``sets_of`` gives
    ``fp, held`` for a table of fingerprints."""
    pairs = materialize(candidates(distinct, similarity, wide))
    met = materialize(components(pairs))
    sets = materialize(sets_of(met.select(F.col("node").alias("fp"))))
    held, sure = _confirmed(pairs, sets, similarity)
    both = met.join(sure.select("node", F.col("root").alias("own")), "node", "left")
    both = materialize(both.select("root", F.col("node").alias("fp"), F.coalesce("own", "node").alias("own")))
    broken = both.groupBy("root").agg(F.count("*").alias("n"), F.min("own").alias("low"), F.max("own").alias("high"))
    broken = broken.filter("n > 2 AND low <> high").select("root")  # of two nodes the only link has been measured
    again = materialize(both.join(broken, "root", "left_semi").join(sets, "fp"))
    if again.isEmpty():
        return sure
    return components(held.unionByName(materialize(_rejoined(again, similarity, _width(similarity, wide)[1]))))


def _rejoined(parts: DataFrame, similarity: float, budget: int) -> DataFrame:
    """Links ``a, b`` as similar as asked between different parts ``own`` of the components ``root`` of ``fp, held``, enough of them to join the parts.

    The nodes outside a component's largest part, in blocks of bounded size, meet all its nodes, in such blocks, so no task holds more than two
    blocks and pairs inside the largest part never arise. In a task the tries are walked, the sets of a pair are compared where the pair's parts
    have not met yet, and only links that join parts leave it.
    """
    entries = F.size("held") + 1
    sized = parts.groupBy("root", "own").agg(F.count("*").alias("n"), F.sum(entries).alias("entries"))
    largest = sized.groupBy("root").agg(F.max(F.struct("n", "own"))["own"].alias("main"), F.sum("n").alias("n"), F.sum("entries").alias("entries"))
    rest = sized.join(largest.select("root", "main"), "root").filter("own <> main").groupBy("root").agg(F.sum("n").alias("n"), F.sum("entries").alias("entries"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_NODES), F.ceil(F.col("entries") / BLOCK_ENTRIES))
    plan = largest.select("root", "main", blocks.alias("columns")).join(rest.select("root", blocks.alias("rows")), "root")
    dealt = parts.join(plan, "root").withColumn("at", F.xxhash64("fp"))
    held = [F.col("fp"), F.xxhash64("own").alias("label"), F.col("held")]
    column_at, row_at = F.pmod("at", "columns"), F.pmod("at", "rows")
    each = [
        dealt.filter("own <> main").select("root", row_at.alias("row"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("column"), *held),
        dealt.select("root", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), column_at.alias("column"), *held),
    ]
    keyed = each[0].unionByName(each[1]).select(F.xxhash64("root", "row", "column").alias("key"), "fp", "label", "held").repartition("key").sortWithinPartitions("key")

    def columns_of(batch: pa.RecordBatch) -> list[np.ndarray]:
        lists = batch.column("held")
        flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        sets = np.empty(len(ends), object)
        sets[:] = np.split(flat, ends[:-1])
        return [_words(batch.column("fp")), batch.column("label").to_numpy(), sets]

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, (value, label, sets) in _runs(batches, columns_of):
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            for a, b in zip(starts, [*starts[1:], len(key)]):
                own, first = np.unique(value[a:b], axis=0, return_index=True)  # a node of the rest may be in both blocks
                for i, j in _alike(own, label[a:b][first], sets[a:b][first], similarity, budget):
                    yield from _edges(own, i, j)

    return keyed.mapInArrow(confirm, "a binary, b binary").distinct()


def _alike(value: np.ndarray, label: np.ndarray, sets: np.ndarray, similarity: float, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between values of different labels whose sets are as similar as asked, as far as they join labels."""
    _, first, which = np.unique(label, return_index=True, return_inverse=True)
    parent = first[which]
    sizes = np.array([len(s) for s in sets])
    _, entry, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)  # others are in no intersection
    place = np.full(len(times), -1)
    place[shared] = np.arange(len(shared))
    bits = np.zeros((len(sets), -(-max(1, len(shared)) // 64) * 64 // 8), np.uint8)
    for k, some in enumerate(np.split(place[entry], np.cumsum(sizes)[:-1])):
        row = np.zeros(bits.shape[1] * 8, bool)
        row[some[some >= 0]] = True
        bits[k] = np.packbits(row)
    bits = bits.view(np.uint64)
    step = max(1, COMPARED // bits.shape[1])
    for i, j in trie_links(value, np.array([0]), budget):
        while len(i):
            apart = parent[i] != parent[j]  # parts meet as links are found
            i, j = i[apart], j[apart]
            a, b, i, j = i[:step], j[:step], i[step:], j[step:]
            common = np.bitwise_count(bits[a] & bits[b]).sum(axis=1, dtype=np.int64)
            every = sizes[a] + sizes[b] - common
            good = (common / np.maximum(every, 1) >= similarity) | (every == 0)
            yield from _merging(parent, a[good], b[good])


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of the edges ``a, b``; root is one node of its component.

    Each round hooks every node to its smallest smaller neighbour, follows the hooks to their
    ends and rewrites the edges between those. A node that is smallest among its neighbours is the
    only kind that stays, so the number of nodes at least halves each round.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    found = None
    while not edges.isEmpty():
        hooks = materialize(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("root")))
        while True:
            upper = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            once = hooks.join(upper, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            jumped = materialize(once.join(upper, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
            hooks = jumped.select("node", "root")
            if jumped.filter("moved").isEmpty():  # two steps led every node to the end of its hooks
                break
        if found is None:
            found = hooks
        else:  # nodes of earlier rounds follow their root
            later = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            moved = found.join(later, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            found = materialize(moved.unionByName(hooks))
        ends = [hooks.select(F.col("node").alias(k), F.col("root").alias(f"{k}_root")) for k in ("a", "b")]
        left = edges.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
        edges = materialize(left.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = found.select(F.col("root").alias("node"), "root").distinct()
    return found.unionByName(roots)


def near_duplicates(df: DataFrame, row_id: str = "doc_id", text: str = "text", *, shingle: int = 5, budget: int = BUDGET) -> DataFrame:
    """``row_id, fp, component_id`` for every row: the 64-bit fingerprint as bytes, and the smallest id reachable over links."""
    small_batches(df.sparkSession)
    prints = materialize(df.select(column(df, row_id).alias("id"), fingerprint(column(df, text), shingle).alias("fp")))
    joined = components(links(prints.select("fp").distinct(), budget)).withColumnRenamed("node", "fp")
    rows = materialize(prints.join(joined, "fp", "left").select("id", "fp", F.coalesce("root", "fp").alias("root")))
    smallest = materialize(rows.groupBy("root").agg(F.min("id").alias("component_id")))
    return rows.join(smallest, "root").select(F.col("id").alias(row_id), "fp", "component_id")


def keep_one(df: DataFrame, row_id: str = "doc_id", text: str = "text", *, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near-duplicates, with the columns of ``df``: that of the smallest id, a null id last."""
    small_batches(df.sparkSession)
    seen = F.xxhash64(F.coalesce(column(df, text), F.lit("")))
    prints = materialize(df.select(column(df, row_id).alias("id"), seen.alias("seen"), fingerprint(column(df, text), shingle, WIDE, once=True).alias("fp")))
    nodes = materialize(prints.select("fp").distinct())

    def sets_of(wanted: DataFrame) -> DataFrame:
        """Shingle sets, each from the text of one row."""
        one = prints.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("id", "seen")).alias("first")).select("fp", "first.*")
        texts = df.select(column(df, row_id).alias("_id"), seen.alias("_seen"), column(df, text).alias("t"))
        texts = texts.join(one, texts["_id"].eqNullSafe(one["id"]) & (texts["_seen"] == one["seen"]))
        return texts.dropDuplicates(["fp"]).select("fp", shingle_set(F.col("t"), shingle).alias("held"))

    joined = similar(nodes, sets_of, similarity).withColumnRenamed("node", "fp")
    rows = prints.join(joined, "fp", "left").select("id", "seen", F.coalesce("root", "fp").alias("root"))
    counted = rows.groupBy("root", "id", "seen").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("id").isNull(), "id", "seen", "n")).alias("first")
    winners = materialize(counted.groupBy("root").agg(first).select("first.id", "first.seen", "first.n"))
    own = df.withColumn(mark := fresh(df, "seen"), seen)

    def match(side: DataFrame) -> Column:
        return own[row_id].eqNullSafe(side["id"]) & (own[mark] == side["seen"])

    if winners.filter("n > 1").isEmpty():
        return own.join(winners, match(winners), "left_semi").drop(mark)
    single, repeated = winners.filter("n = 1"), winners.filter("n > 1")
    once = own.join(repeated, match(repeated), "left_semi").dropDuplicates([row_id, mark])
    return own.join(single, match(single), "left_semi").unionByName(once).drop(mark)
