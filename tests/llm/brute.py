"""Plain-Python versions of the operators, for small tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def secrets(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def personal(text):
    text, digits = text or "", lambda m: re.sub("[^0-9]", "", m.group())
    out = [(0, m.start(), "email", m.end()) for m in EMAIL.finditer(text)]
    out += [(1, m.start(), "ip", m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(2, m.start(), "card", m.end()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(3, m.start(), "phone", m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return [f"{k}:{s}:{e}" for _, s, k, e in sorted(out)]


def without_repeats(texts, window):
    """(words, removed, kept) of each text."""
    split = [words(t) for t in texts]
    seen = {}
    for w in split:
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for w in split:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] > 1:
                gone[p : p + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def simhash(text, shingle):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(lowered)
    if not w:
        return 0
    parts = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(n, linked):
    """Smallest index reachable from each of n nodes."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def nearest(ids, vectors, query, top):
    scores = vectors @ vectors[query]
    order = [k for k in np.lexsort((ids, -scores)) if ids[k] != ids[query]]
    return [(int(ids[k]), float(scores[k])) for k in order[:top]]


def targets(sizes, weights=(3, 1, 2)):
    """Targets of sources given in order: 150 % of all words by weight, at most twice a source's words."""
    weight = [weights[k % len(weights)] for k in range(len(sizes))]
    whole, full = 1.5 * sum(sizes), set()
    while True:
        rest = sum(w for k, w in enumerate(weight) if k not in full)
        level = (whole - sum(2 * sizes[k] for k in full)) / rest if rest else 0
        over = {k for k, w in enumerate(weight) if k not in full and level * w > 2 * sizes[k]}
        if not over:
            return [2 * s if k in full else level * weight[k] for k, s in enumerate(sizes)]
        full |= over


def webster(claims, seats):
    """Seats by highest claim / (2 * seats + 1), one by one; ties to the first."""
    given = [0] * len(claims)
    for _ in range(seats):
        k = max(range(len(claims)), key=lambda k: (claims[k] / (2 * given[k] + 1), -k))
        given[k] += 1
    return given


def smallest_capacity(sizes, shards):
    """Largest part of the best cut of a sequence into contiguous parts."""
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        best = [min([best[i]] + [max(best[k], sum(sizes[k:i])) for k in range(i)]) for i in range(len(sizes) + 1)]
    return best[-1]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def equal_texts(rows):
    """(id, largest id, group size, hash) of each row (id, text, ...)."""
    groups = {}
    for r in rows:
        groups.setdefault(lowered(r[1]), []).append(r[0])
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return [(r[0], top[t], len(groups[t]), sha(t)) for r in rows for t in [lowered(r[1])]]


def variants(rows, least=7, often=2, ratio=10):
    """word: (form, root, n, n_near, form_n)."""
    counts = Counter()
    for id_, text, *_ in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                counts[run] += 1
    known = {w: n for w, n in counts.items() if n >= often}
    near = {w: {v for v in known if v != w and one_edit(w, v)} for w in known}
    form = {}
    for w, n in known.items():
        best = min(near[w], key=lambda v: (-known[v], v), default=None)
        form[w] = best if best and known[best] >= ratio * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n, len(near[w]), known.get(form[w])) for w, n in known.items()}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def whitened(vectors, components=8):
    """(deviations, coordinates, shares) of vectors of integers."""
    n, sums = len(vectors), vectors.sum(axis=0)
    deviations = ((n * vectors - sums).astype(object) ** 2).sum(axis=1)
    centred = (n * vectors - sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, (values > 1e-12 * max(values[0], 0)).sum())
    return deviations, centred @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()
