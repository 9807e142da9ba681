"""op11: spelling variants against comparing all words."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from clauseflow.llm import common, registry, spelling

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(rows, least_chars=6, least=5, every=199):
    n = Counter()
    for d, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            if len(run) >= least_chars:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= least}


def _near(n):
    """All pairs with exactly one edit, through the strings that a deletion leaves."""
    by = {}
    for w in n:
        for x in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            by.setdefault(x, set()).add(w)
    near = {w: set() for w in n}

    def one(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))
    for ws in by.values():
        for a, b in itertools.combinations(ws, 2):
            if one(a, b):
                near[a].add(b)
                near[b].add(a)
    return near


def _expected(n, times=5):
    near, form = _near(n), {}
    for w, ws in near.items():
        best = min(ws, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def _got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def _rows(seed, n_words=150, n_docs=120):
    rng = random.Random(seed)
    letters = "abcXYé÷ÿÐ"
    base = ["".join(rng.choice(letters) for _ in range(rng.choice([5, 6, 6, 7, 8, 9, 14]))) for _ in range(n_words)]
    base += ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "abababa", "bababab"]
    for w in list(base):
        k = rng.randrange(len(w))
        base += [w[:k] + w[k + 1:], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1:]]
    weights = [rng.choice([1, 1, 2, 10, 60, 400]) for _ in base]
    gaps = [" ", "\n", "-", "1", "ě", "¿", "😀", "_"]
    return [(rng.choice([i, i, None]), "".join(w + rng.choice(gaps) for w in rng.choices(base, weights, k=80))) for i in range(n_docs)]


@pytest.mark.parametrize("most", [50_000, 40])
def test_against_all_words(make_docs, most):
    rows = _rows(most)
    got = _got(spelling.group(make_docs(rows), most=most, every=7))
    assert got == _expected(_words(rows, every=7))
    assert sum(r[4] for r in got) > 150 and any(r[1] for r in got)


def test_odd_rows_and_empty_table(make_docs, odd_rows):
    rows = odd_rows + [(30 + i, "ÉlanÉ colour color COLOUR Colours " + "y" * 3000 + " " + "y" * 2999 + "z") for i in range(6)]
    rows += [(None, "color " * 40), (None, None), (1, "¿¿colourİK")]
    got = _got(spelling.group(make_docs(rows), least_chars=5, every=7))
    want = _words(rows, least_chars=5, every=7)
    assert {r[0]: r[3] for r in got} == want
    rows = [r for r in rows if r[0] is None or r[0] >= 0]
    got = _got(spelling.group(make_docs(rows)))
    assert got == _expected(_words(rows))
    assert spelling.group(make_docs([])).count() == 0


def test_chains_end_at_their_last_form(make_docs):
    words = ["abcdefghij"[:6] + x for x in ("", "k", "kl", "klm", "klmn", "klmno")]
    text = " ".join(w for i, w in enumerate(words) for _ in range(5 * 6 ** i))
    got = {r[0]: r for r in _got(spelling.group(make_docs([(1, text)]), every=1 << 30))}
    assert [got[w][1] for w in words] == [*words[1:], None] and {got[w][2] for w in words} == {words[-1]}


def test_whole_table(spark):
    rows = common.table(spark, SF, "documents").select("doc_id", "text").collect()
    assert _got(registry.QUERIES["op11_spelling_variants"](spark, SF)) == _expected(_words(rows))


def test_checksums_and_index():
    rng = random.Random(4)
    runs = ["".join(rng.choice("abé") for _ in range(k)) for k in (0, 1, 2, 6, 63, 64, 65, 200)]
    data = [r.encode() for r in runs]
    at = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    begin = np.array([zlib.crc32(f"{i}:".encode()) for i in range(len(runs))], np.uint32)
    got = spelling._checksums(begin, np.frombuffer(b"".join(data), np.uint8), at[:-1], at[1:])
    assert got.tolist() == [zlib.crc32(f"{i}:{r}".encode()) for i, r in enumerate(runs)]
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(6, 9))) for _ in range(300)})
    codes, at = spelling._codes(pa.array(words))
    index = spelling.Index(codes, at)
    exact = np.full(len(words), 3)
    q, w = index.near(codes, at[:-1], at[1:], exact)
    near = _near(dict.fromkeys(words, 1))
    want = {(a, b) for a in words for b in near[a] if a[-3:] == b[-3:]}
    got = {(words[i], words[j]) for i, j in zip(q, w)}
    assert len(got) == len(q) and got >= want and all(b in near[a] for a, b in got)
