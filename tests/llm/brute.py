"""Plain Python versions of the operators' definitions, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").translate(_LOWER)


def shingles(words, n):
    if not words:
        return set()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)}


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def jaccard_components(texts, n, num, den):
    """Row number -> smallest row number of its component, and set sizes."""
    sets = [shingles(SPACED.findall(lower(t)), n) for t in texts]
    holders, union = defaultdict(list), Union()
    for i, s in enumerate(sets):
        shared = Counter()
        for g in s:
            shared.update(holders[g])
            holders[g].append(i)
        for j, both in shared.items():
            if den * both >= num * (len(s) + len(sets[j]) - both):
                union.join(i, j)
    return [union.find(i) for i in range(len(sets))], [len(s) for s in sets]


def leaks(docs, items, n=5, share=0.8):
    out = set()
    own = {d: shingles(ALNUM.findall(lower(t)), n) for d, t in docs}
    for item, text in items:
        want = shingles(ALNUM.findall(lower(text)), n)
        for d, have in own.items():
            if want and len(want & have) >= share * len(want):
                out.add((d, item, len(want), len(want & have)))
    return out


def phrase_places(text, phrases):
    """Word count and, per phrase, where its words stand."""
    words = ALNUM.findall(lower(text))
    return len(words), {p: [i for i in range(len(words) - len(p.split()) + 1) if words[i:i + len(p.split())] == p.split()]
                        for p in phrases}


def mix(rows, weights=(5, 2, 1), epochs=3):
    """rows (doc_id, source, size) -> {doc_id: taken}, {source: target}."""
    total, by = sum(r[2] for r in rows), defaultdict(int)
    for _, s, size in rows:
        by[s] += size
    names = sorted((s for s in by if s is not None)) + [s for s in by if s is None]
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    target, open_, left = {}, list(names), float(total)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if epochs * by[s] <= level * weight[s]]
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = float(epochs * by[s])
            left -= target[s]
            open_.remove(s)
    queue, upto = [], defaultdict(int)
    for d, s, size in sorted(rows, key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
        upto[s] += size
        queue += [((e * by[s] + upto[s]) / weight[s], names.index(s), e, d, size) for e in range(epochs)]
    taken, run = Counter(), 0
    for _, _, _, d, size in sorted(queue, key=lambda q: q[:3]):
        run += size
        if run > total:
            break
        taken[d] += size
    return taken, target


def simhash(words, number=0):
    """SimHash number ``number`` of words as often as they occur."""
    hashes = [_simhash_word(w, number) for w in words]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(words))


def _simhash_word(word, number):
    """Spark's xxhash64 of (its hash of the word, number)."""
    x = 42
    for i in (murmur3(word.encode()), number):
        x = ((x + 0x27D4EB2F165667C5 + 4) ^ i * 0x9E3779B185EBCA87) % (1 << 64)
        x = ((x << 23 | x >> 41) * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9) % (1 << 64)
        x = (x ^ x >> 33) * 0xC2B2AE3D27D4EB4F % (1 << 64)
        x = (x ^ x >> 29) * 0x165667B19E3779F9 % (1 << 64)
        x ^= x >> 32
    return x


def murmur3(data):
    """Spark's hash of a string, as 32 bits without a sign."""
    m = (1 << 32) - 1
    full = len(data) // 4 * 4
    h = 42
    for k in [int.from_bytes(data[i:i + 4], "little") for i in range(0, full, 4)] + [b - 256 * (b > 127) & m for b in data[full:]]:
        k = k * 0xCC9E2D51 & m
        h ^= (k << 15 | k >> 17) * 0x1B873593 & m
        h = (h << 13 | h >> 19) * 5 + 0xE6546B64 & m
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    return h ^ h >> 16


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]
