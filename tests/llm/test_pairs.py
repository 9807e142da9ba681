"""op2 (fuzzy lines), op4 (vector links), op10 (Jaccard join) and the helpers they share."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clauseflow.llm import common, fuzzy_lines, jaccard_join, vector_links, wordhash
import brute

SF = "/root/testdata/sf0.01"


# --- helpers ---

@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(i, i + 1) for i in range(300)], [(0, i) for i in range(1, 200)],
    [(9, 4), (4, 9), (9, 4), (None, 3), (5, None), (7, 8), (8, 4), (20, 21)]])
def test_connected_components(spark, edges):
    union = brute.Union()
    for a, b in edges:
        if a is not None and b is not None and a != b:
            union.join(a, b)
    got = {(r["node"], r["root"]) for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, union.find(x)) for x in list(union.up)}


def test_word_hashes_do_not_depend_on_pieces():
    texts = ["Aé b\tC", None, "", "  ", "x" * 5000 + " y", "one two one", "  lead trail  ", "y" * 700]
    column = pa.array(texts)
    want, at = wordhash.words(column)
    assert np.diff(at).tolist() == [len(brute.SPACED.findall(t or "")) for t in texts]
    flat = [w for t in texts for w in brute.SPACED.findall(brute.lower(t))]
    names = defaultdict(set)
    for w, h in zip(flat, want.tolist()):
        names[w].add(h)
    assert all(len(h) == 1 for h in names.values()) and len(set.union(*names.values())) == len(names)
    for limit in (1, 7, 64, 1000):
        got, at2 = wordhash.words(column, limit=limit)
        assert (got == want).all() and (at2 == at).all()
    part, _ = wordhash.words(column.slice(4, 2))
    assert (part == want[at[4]:at[6]]).all()


def test_shingles():
    column = pa.array(["a b c d", "a b", "", None, "b c d", "a b"])
    h, at = wordhash.words(column)
    s, sa = wordhash.shingles(h, at, 3)
    assert np.diff(sa).tolist() == [2, 1, 0, 0, 1, 1]
    assert s[1] == s[3] and s[2] == s[4] and len(set(s.tolist())) == 3


# --- op10 ---

def _components(rows, n, num, den):
    texts = [t for _, t, *_ in rows]
    roots, sizes = brute.jaccard_components(texts, n, num, den)
    least = {}
    for (d, *_), r in zip(rows, roots):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(((d, s, least.get(r) if s else d) for (d, *_), r, s in zip(rows, roots, sizes)), key=str)


def _collected(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def test_jaccard_odd_rows(make_docs, odd_rows):
    for n, num in ((3, 90), (5, 80), (1, 50)):
        assert _collected(jaccard_join.components(make_docs(odd_rows), n=n, num=num, den=100)) == _components(odd_rows, n, num, 100)


def test_jaccard_chains_and_families(make_docs):
    """Families around a base text, chains whose ends differ, pairs at the very threshold, copies of copies."""
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(400)]
    rows = []

    def add(words):
        rows.append((len(rows) * 3 % 1009, " ".join(words)))
    for size in (8, 30, 100):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(40):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary + [f"u{rng.random()}"])
            if rng.random() < 0.3:
                words = words[:rng.randrange(size // 2, size)]
            add(words)
    chain = [f"c{i}" for i in range(100)]
    for k in range(25):
        add(chain[k:] + [f"d{i}" for i in range(k)])
    for k in range(80, 110):  # one set holds the other
        add(chain[:k] + [f"e{i}" for i in range(max(0, k - 100))])
    for n, num in ((3, 90), (5, 80), (1, 90), (2, 70)):
        assert _collected(jaccard_join.components(make_docs(rows), n=n, num=num, den=100)) == _components(rows, n, num, 100)


def test_jaccard_whole_table(spark):
    docs = common.table(spark, SF, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert _collected(jaccard_join.op10(spark, SF)) == _components(rows, 3, 90, 100)
    assert _collected(jaccard_join.components(docs)) == _components(rows, 5, 80, 100)


def test_one_of_each_component(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    kept = jaccard_join.one_of_each(docs, n=3, num=90, den=100)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    gone = [5, 6, 6, 8, 10]
    want = [r[:2] for r in odd_rows]
    for d in gone:
        want.remove(next(w for w in want if w[0] == d))
    assert got == sorted(want, key=str)


def test_one_of_each_keeps_one_of_equal_rows(make_docs):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, ""), (2, "")]
    assert sorted(r["doc_id"] for r in jaccard_join.one_of_each(make_docs(rows)).collect()) == [1, 2]


def test_jaccard_empty_table(make_docs):
    assert jaccard_join.components(make_docs([])).count() == 0
    assert jaccard_join.one_of_each(make_docs([])).count() == 0


# --- op4 ---

def _links(rows, threshold=0.9):
    unit = {}
    for i, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            a = np.array(v, float)
            unit[i] = a / np.abs(a).max() / np.linalg.norm(a / np.abs(a).max())
    union, n = brute.Union(), [0] * len(rows)
    for i in unit:
        for j in unit:
            if i < j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                union.join(i, j)
                n[i] += 1
                n[j] += 1
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[union.find(i)] = min(d, least.get(union.find(i), d))
    return sorted(((d, n[i], c := least.get(union.find(i)), d == c) for i, (d, _) in enumerate(rows)), key=str)


def _vectors(spark, rows):
    return spark.createDataFrame([(d, v, "clash") for d, v in rows], "vec_id long, embedding array<float>, node string")


def _linked(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


@pytest.mark.parametrize("block", [4096, 7])
def test_vector_links(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(150):
        v = centres[rng.integers(6)] + rng.normal(size=8) * rng.choice([0.05, 0.3, 0.6])
        rows.append((int(1000 - i * 3), [float(np.float32(x)) for x in v * rng.choice([1e-3, 1, 1e6])]))
    rows += [(2000 + i, rows[0][1]) for i in range(5)] + [rows[1], rows[1], (None, rows[2][1]), (5000, [0.0] * 8), (5001, None),
             (5002, []), (5003, [float("nan")] + [1.0] * 7), (5004, [float("inf")] + [1.0] * 7), (5005, [None] + [1.0] * 7),
             (5006, [1.0, 0.0]), (5007, [1.0, 0.01]), (5008, [3.0]), (None, None), (5009, [1e-30] * 8), (5010, [2e30] * 8)]
    assert _linked(vector_links.links(_vectors(spark, rows), block=block)) == _links(rows)


def test_vector_links_whole_table(spark):
    for sf in (SF, "/root/testdata/sf0.1"):
        t = common.table(spark, sf, "embeddings")
        rows = [(r["vec_id"], list(r["embedding"])) for r in t.collect()]
        x = np.array([v for _, v in rows], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        close = x @ x.T >= 0.9
        np.fill_diagonal(close, False)
        got = {r["vec_id"]: r for r in vector_links.links(t, block=300).collect()}
        union = brute.Union()
        for i, j in zip(*np.nonzero(close)):
            union.join(rows[i][0], rows[j][0])
        for (d, _), n in zip(rows, close.sum(axis=1)):
            assert got[d]["n_links"] == n and got[d]["component_id"] == union.find(d) and got[d]["kept"] == (union.find(d) == d)


def test_vector_links_empty_table(spark):
    assert vector_links.links(_vectors(spark, [])).count() == 0
    assert _linked(vector_links.links(_vectors(spark, [(1, None)]))) == [(1, 0, 1, True)]


# --- op2 ---

def _line_groups(rows, similarity=fuzzy_lines.SIMILARITY):
    """(doc_id, line_no) -> (first doc_id, first line_no), by comparing all pairs of distinct lines."""
    found = []
    for d, text, *_ in rows:
        for k, line in enumerate((text or "").lower().split("\n")):
            words = tuple(w for w in re.split(fuzzy_lines.GAP, line) if w)
            if words:
                found.append((d, k, words))
    distinct = sorted({w for *_, w in found})
    hashes, union = [[brute.simhash(w, h) for h in range(fuzzy_lines.HASHES)] for w in distinct], brute.Union()
    for i, a in enumerate(distinct):
        for j in range(i):
            if any(bin(x ^ y).count("1") <= fuzzy_lines.DISTANCE and any((x ^ y) >> low & (1 << high - low) - 1 == 0 for low, high in fuzzy_lines.BLOCKS)
                   for x, y in zip(hashes[i], hashes[j])):
                x, y = a, distinct[j]
                most = math.floor(max(len(x), len(y)) * (1 - similarity) + 1e-9)
                if abs(len(x) - len(y)) <= most and brute.edit_distance(x, y) <= most:
                    union.join(i, j)
    number = {w: union.find(i) for i, w in enumerate(distinct)}
    first = {}
    for d, k, w in found:
        place = (d is not None, d, k)
        first[number[w]] = min(place, first.get(number[w], place))
    return sorted(((d, k, *first[number[w]][1:], (d, k) == first[number[w]][1:]) for d, k, w in found), key=str)


def _grouped(df):
    return sorted((tuple(r) for r in df.select("doc_id", "line_no", "first_doc_id", "first_line_no", "kept").collect()), key=str)


def test_fuzzy_lines(make_docs, odd_rows):
    rng = random.Random(2)
    pool = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{i}" for i in range(60)]
    base = [[rng.choice(pool) for _ in range(40)] for _ in range(4)]
    rows = [r for r in odd_rows if len(r[1] or "") < 100_000]
    for i in range(60):
        lines = []
        for _ in range(3):
            words = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(40)] = rng.choice(pool)
            if rng.random() < 0.1:
                rng.shuffle(words)  # the same words, another line
            line = rng.choice([" ", ", ", "  - "]).join(words)
            lines.append(rng.choice([line, line.upper(), "* " + line + "!", ""]))
        rows.append((100 + i, "\n".join(lines)))
    assert _grouped(fuzzy_lines.groups(make_docs(rows))) == _line_groups(rows)


def test_fuzzy_lines_long_lines_and_cleaning(make_docs):
    long = " ".join(f"w{i}" for i in range(70_000))
    rows = [(1, long + "\nA b c\n\n"), (2, "x\n" + long + " tail\na, B c!\nx y"), (3, None), (4, ""), (5, "\n \n"), (2, "x\nother")]
    docs = make_docs(rows)
    out = fuzzy_lines.cleaned(docs)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(
        [(1, long + "\nA b c\n\n"), (2, "x\nx y"), (3, None), (4, ""), (5, "\n \n"), (2, "x\nother")], key=str)


def test_fuzzy_lines_recall_without_hashes(spark):
    """The registered settings against edit distance alone, on the whole table."""
    docs = common.table(spark, SF, "documents")
    lines, holders = {}, {}
    for r in docs.select("doc_id", "text").collect():
        for k, line in enumerate((r["text"] or "").lower().split("\n")):
            words = tuple(w for w in re.split(fuzzy_lines.GAP, line) if w)
            if len(words) >= 19:
                lines.setdefault(words, []).append((r["doc_id"], k))
    distinct = list(lines)
    pairs = set()
    for i, w in enumerate(distinct):  # similar lines of 19 and more words have 8 words in a row in common
        for g in {w[k:k + 8] for k in range(len(w) - 7)}:
            pairs.update((j, i) for j in holders.setdefault(g, []))
            holders[g].append(i)
    rows = {(r["doc_id"], r["line_no"]): (r["first_doc_id"], r["first_line_no"]) for r in fuzzy_lines.op2(spark, SF).collect()}
    true = found = 0
    for i, j in pairs:
        a, b = distinct[i], distinct[j]
        most = math.floor(max(len(a), len(b)) * 0.05 + 1e-9)
        if abs(len(a) - len(b)) <= most and brute.edit_distance(a, b) <= most:
            true += 1
            found += rows[lines[a][0]] == rows[lines[b][0]]
    assert true > 100 and found >= 0.9 * true, (found, true)


def test_fuzzy_lines_that_share_a_run_make_few_pairs(make_docs):
    rng = random.Random(5)
    rows = [(i, " ".join([f"w{rng.randrange(5000)}" for _ in range(30)] + ["international", "organisation", "representatives", "responsible"]))
            for i in range(2000)]
    classes = fuzzy_lines.classes_of(fuzzy_lines.occurrences(make_docs(rows), 19))
    pairs = 0
    for h in range(fuzzy_lines.HASHES):
        keyed = classes.select(F.explode(fuzzy_lines._keys(F.col("n"), fuzzy_lines.SIMILARITY, h)).alias("key"))
        pairs += keyed.groupBy("key").count().agg(F.sum(F.expr("count * (count - 1) div 2"))).head()[0]
    assert classes.count() == 2000 and pairs < 20_000
    assert fuzzy_lines.groups(make_docs(rows)).filter("not kept").count() == 0


def test_fuzzy_lines_hashes(make_docs):
    """SimHashes and parities against plain Python; words of more than a byte's count."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["a", "bc", "d4e", "é", "fünfzig", "w" * 50, "İx", f"u{rng.randrange(99)}"]) for _ in range(n)))
            for i, n in enumerate([19, 20, 31, 64, 255, 256, 700, 3000])]
    got = {r["n"]: r for r in fuzzy_lines.classes_of(fuzzy_lines.occurrences(make_docs(rows + rows[:2]), 19)).collect()}
    assert len(got) == len(rows)
    for _, text in rows:
        words = [w for w in re.split(fuzzy_lines.GAP, text.replace("İ", "i̇")) if w]
        r = got[len(words)]
        assert [r[f"h{h}"] % (1 << 64) for h in range(fuzzy_lines.HASHES)] == [brute.simhash(words, h) for h in range(fuzzy_lines.HASHES)]
        flips = [0] * fuzzy_lines._PARITIES
        for x in map(brute.murmur3, (w.encode() for w in words)):
            flips[(x >> 6) % fuzzy_lines._PARITIES] ^= 1 << x % 64
        assert [r[f"p{k}"] % (1 << 64) for k in range(fuzzy_lines._PARITIES)] == flips


def test_fuzzy_lines_runs_no_python(spark, make_docs):
    docs = make_docs([(1, " ".join(f"w{i}" for i in range(30)))])
    classes = fuzzy_lines.classes_of(fuzzy_lines.occurrences(docs, 19))
    keyed = classes.select(F.explode(fuzzy_lines._keys(F.col("n"), fuzzy_lines.SIMILARITY, 0)).alias("key"), "line")
    plan = fuzzy_lines._met(keyed)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" in plan and not re.search("Python|Pandas|Arrow", plan)


def test_fuzzy_lines_of_a_wide_family_make_few_pairs(make_docs, monkeypatch):
    """Lines of one bucket that are too far apart to be linked are not handed on as pairs."""
    rng = random.Random(6)
    base = [f"t{k}" for k in range(87)]
    rows = []
    for i in range(300):
        words = list(base)
        for k in rng.sample(range(87), rng.choice([0, 1, 2, 5, 6, 7, 8])):
            words[k] = f"n{rng.randrange(100_000)}"
        rows.append((i, " ".join(words)))
    handed = []
    similar = fuzzy_lines._similar

    def counted(pairs, similarity):
        handed.append(pairs.count())
        return similar(pairs, similarity)

    monkeypatch.setattr(fuzzy_lines, "_similar", counted)
    got = _grouped(fuzzy_lines.groups(make_docs(rows)))
    assert got == _line_groups(rows) and len({g[2:4] for g in got}) > 20
    assert sum(handed) < 8 * len(rows), handed


def test_fuzzy_lines_empty_table_and_blank_rows(spark, make_docs):
    assert fuzzy_lines.groups(make_docs([])).count() == 0
    blank = make_docs([(None, None), (1, ""), (2, " \n--\n"), (3, "one")])
    assert _grouped(fuzzy_lines.groups(blank)) == [(3, 0, 3, 0, True)]


def test_fuzzy_lines_buckets_over_batches(spark, make_docs):
    """Families, some of them alike, whose buckets go on over many small batches."""
    rng = random.Random(9)
    base = [[f"t{i}x{k}" for k in range(60)] for i in range(3)]
    rows = []
    for i in range(90):
        words = list(base[i % 3])
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            words[rng.randrange(60)] = f"n{rng.randrange(900)}"
        rows.append((i, " ".join(words)))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert _grouped(fuzzy_lines.groups(make_docs(rows))) == _line_groups(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
