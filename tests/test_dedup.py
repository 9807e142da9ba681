"""Greedy dedup against brute force."""
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clauseflow.functions import textcols as tc
from clauseflow.operators import dedup as dd


def brute_tfidf_keep(texts, labels, threshold=0.30):
    """Plain restatement: smoothed idf tf-idf over all texts, L2 rows, ordered greedy scan."""
    import re
    norm = [" ".join(re.sub(r"[^a-z0-9\s]", " ", t.lower()).split()) for t in texts]
    grams = []
    for n in norm:
        u = [w for w in n.split(" ") if len(w) >= 2]
        grams.append(Counter(u + [a + " " + b for a, b in zip(u, u[1:])]))
    N = len(texts)
    df = Counter(g for c in grams for g in c)
    vecs = []
    for c in grams:
        w = {g: tf * (math.log((1 + N) / (1 + df[g])) + 1) for g, tf in c.items()}
        z = math.sqrt(sum(v * v for v in w.values())) or 1.0
        vecs.append({g: v / z for g, v in w.items()})
    kept = []
    for i in range(N):
        same = [k for k in kept if labels[k] == labels[i]]
        if same and max(sum(v * vecs[k].get(g, 0.0) for g, v in vecs[i].items()) for k in same) >= threshold:
            continue
        kept.append(i)
    return kept


TEXTS = [
    "Supplier may end the order without notice",
    "Supplier may end the order without notice",                       # exact copy
    "Supplier may end this order without any notice at all",          # near copy
    "Buyer shall pay each invoice in thirty days",
    "Buyer shall pay every invoice within thirty days of receipt",
    "a b c",                                                          # no 2-char token: always kept
    "Completely different wording about shipping crates",
    "Supplier may end the order without notice",                       # copy, other label below
]
LABELS = ["x", "x", "x", "y", "y", "x", "x", "z"]


def test_tfidf_dedup_matches_brute_force(spark):
    rows = [(7, i, t, l) for i, (t, l) in enumerate(zip(TEXTS, LABELS))]
    df = spark.createDataFrame(rows, "contract_id long, clause_idx int, text string, label string")
    out = dd.semantic_dedup_tfidf(df, ["contract_id"], "clause_idx", F.struct(F.col("clause_idx")))
    assert sorted(r["clause_idx"] for r in out.collect()) == brute_tfidf_keep(TEXTS, LABELS)


def test_tfidf_dedup_null_labels_are_a_group(spark):
    rows = [(1, 0, "Buyer shall pay the fee now", None), (1, 1, "Buyer shall pay the fee now", None),
            (1, 2, "Buyer shall pay the fee now", "x")]
    df = spark.createDataFrame(rows, "contract_id long, clause_idx int, text string, label string")
    out = dd.semantic_dedup_tfidf(df, ["contract_id"], "clause_idx", F.struct(F.col("clause_idx")))
    assert sorted(r["clause_idx"] for r in out.collect()) == [0, 2]


def test_dense_chain_keeps_a_and_c(spark):
    # A~B (0.71), B~C (0.71), A!~C (0.0): greedy keeps A and C
    a = [1.0, 0.0, 0.0]
    b = [math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    c = [0.0, 0.0, 1.0]
    rows = [(0, 1, a), (0, 2, b), (0, 3, c)]
    df = spark.createDataFrame(rows, "label int, vec_id long, embedding array<double>")
    out = dd.semantic_dedup_embedding(df, ["label"], "vec_id", "vec_id", block_rows=2)
    assert sorted(r["vec_id"] for r in out.collect()) == [1, 3]


def test_dense_dedup_independent_of_partitioning(spark):
    import random
    rnd = random.Random(3)
    rows = []
    for i in range(60):
        v = [rnd.gauss(0, 1) for _ in range(4)]
        z = math.sqrt(sum(x * x for x in v))
        rows.append((i % 2, i, [x / z for x in v]))
    df = spark.createDataFrame(rows, "label int, vec_id long, embedding array<double>")
    a = sorted(r["vec_id"] for r in dd.semantic_dedup_embedding(df.repartition(1), ["label"], "vec_id", "vec_id").collect())
    b = sorted(r["vec_id"] for r in dd.semantic_dedup_embedding(df.repartition(7), ["label"], "vec_id", "vec_id",
                                                              block_rows=5).collect())
    # brute force
    kept = []
    for lab in (0, 1):
        mine = [r for r in rows if r[0] == lab]
        ks = []
        for r in mine:
            if any(sum(x * y for x, y in zip(r[2], k[2])) >= 0.30 for k in ks):
                continue
            ks.append(r)
        kept += [k[1] for k in ks]
    assert a == b == sorted(kept)


def test_dense_dedup_ties_and_fractions(spark):
    """Equal vectors ordered by a falling confidence; ties go by id."""
    rows = [(1, 5, 0.7, [1.0, 0.0]), (1, 3, 0.9, [1.0, 0.0]), (1, 4, 0.8, [1.0, 0.0]),
            (2, 9, 0.5, [0.0, 1.0]), (2, 8, 0.5, [0.0, 1.0]), (2, 7, None, [0.0, 1.0]), (3, 1, 0.1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "contract_id long, clause_idx int, confidence double, embedding array<double>")
    out = dd.semantic_dedup_embedding(df, ["contract_id"], "clause_idx", [-F.col("confidence")])
    assert sorted((r["contract_id"], r["clause_idx"]) for r in out.collect()) == [(1, 3), (2, 8), (3, 1)]


def test_rounds_follow_chains_of_any_length(spark):
    n = 23
    nodes = spark.createDataFrame([(1, i, "U") for i in range(n)] + [(2, 0, "U"), (2, 1, "D")], "g int, id long, st string")
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(n - 1)], "g int, i long, j long")
    got = sorted((r["g"], r["id"]) for r in dd.resolve_dropped(nodes, edges, ["g"]).collect())
    assert got == [(1, i) for i in range(1, n, 2)] + [(2, 1)]
    circle = spark.createDataFrame([(1, 0, 1), (1, 1, 0)], "g int, i long, j long")
    with pytest.raises(RuntimeError):
        dd.resolve_dropped(nodes, circle, ["g"])


def test_exact_dedup_keeps_first(spark):
    rows = [("t", "l", 3), ("t", "l", 1), ("t", "m", 2), ("u", "l", 5)]
    df = spark.createDataFrame(rows, "text string, label string, pos int")
    got = sorted((r["text"], r["label"], r["pos"]) for r in dd.exact_dedup(df, ["text", "label"], ["pos"]).collect())
    assert got == [("t", "l", 1), ("t", "m", 2), ("u", "l", 5)]


def _greedy(rows, threshold=0.30):
    """rows (group, id, order, vector): ids that the ordered rule keeps."""
    kept, compared = {}, 0
    for g, i, _, v in sorted(rows, key=lambda r: (r[2] is None, r[2] if r[2] is not None else 0, r[1])):
        mine = kept.setdefault(g, [])
        compared += len(mine)
        if not any(sum(x * y for x, y in zip(v, k)) >= threshold for _, k in mine):
            mine.append((i, v))
    return sorted((g, i) for g, ks in kept.items() for i, _ in ks), compared


@pytest.mark.parametrize("first,block_rows", [(8, 5), (40, 16), (4096, 16)])
def test_leader_rounds_give_the_greedy_result(spark, first, block_rows):
    import random
    rnd = random.Random(first)
    rows = []
    for i in range(260):
        v = [rnd.gauss(0, 1) for _ in range(5)]
        z = math.sqrt(sum(x * x for x in v))
        rows.append((rnd.choice(["a", "a", "a", "b", None]), i * 7 % 260, rnd.choice([None, 0.25, 0.5, 0.5, rnd.random()]), [x / z for x in v]))
    df = spark.createDataFrame(rows, "label string, vec_id long, o double, embedding array<double>").repartition(5)
    out = dd.semantic_dedup_embedding(df, ["label"], "vec_id", "o", block_rows=block_rows, first=first, threshold=0.8)
    want, _ = _greedy([r for r in rows if r[0] is not None], 0.8)
    assert sorted((r["label"], r["vec_id"]) for r in out.filter("label is not null").collect()) == want
    assert out.filter("label is null").count() == sum(r[0] is None for r in rows)


def test_tfidf_blocks_of_frequent_tokens_and_bounds(spark):
    """Blocks of a few rows and the whole token give the same candidates, which hold every similar pair and few others."""
    import random
    rnd = random.Random(8)
    pool = [f"word{i}" for i in range(40)]
    texts = [" ".join(["shall", *rnd.choices(pool, k=rnd.randrange(4, 12))]) for _ in range(70)]
    rows = [(1, i, x, "x") for i, x in enumerate(texts)]
    base = spark.createDataFrame(rows, "contract_id long, id long, _norm string, _label string").withColumn("_ok", F.struct("id"))
    vecs = dd.tfidf_vectors(base, ["contract_id"], 0.30, carry=["_label", "_ok"])
    pairs = {size: {(r["i"], r["j"]) for r in dd.tfidf_candidates(vecs, ["contract_id", "_label"], 0.30, block_rows=size).collect()}
             for size in (3, 1024)}
    vectors = {r["id"]: {e["tok"]: e["u"] for e in r["vec"]} for r in vecs.collect()}
    assert all(abs(sum(u * u for u in v.values()) - 1) < 1e-9 for v in vectors.values())
    similar = {(i, j) for i in vectors for j in vectors if i < j and sum(u * vectors[j].get(t, 0) for t, u in vectors[i].items()) >= 0.30}
    assert pairs[3] == pairs[1024] >= similar and all(i < j for i, j in pairs[3])
    shared = sum(1 for i in vectors for j in vectors if i < j and vectors[i].keys() & vectors[j].keys())
    assert shared == 70 * 69 // 2 and len(pairs[3]) < shared
    df = spark.createDataFrame(rows, "contract_id long, clause_idx int, text string, label string")
    out = dd.semantic_dedup_tfidf(df, ["contract_id"], "clause_idx", F.struct(F.col("clause_idx")))
    assert sorted(r["clause_idx"] for r in out.collect()) == brute_tfidf_keep(texts, ["x"] * 70)


def test_tfidf_dedup_goes_in_slices_of_whole_contracts(spark, monkeypatch):
    """the tokens of one slice are on disk at a time, with the same rows kept."""
    import os
    import random
    rnd = random.Random(5)
    pool = [f"word{i}" for i in range(30)]
    texts = {c: [" ".join(["shall", *rnd.choices(pool, k=rnd.randrange(3, 9))]) for _ in range(12)] for c in range(9)}
    rows = [(c, i, t, "x") for c, ts in texts.items() for i, t in enumerate(ts)] + [(None, 0, "word1 word2", "x"), (None, 1, "word1 word2", "x")]
    df = spark.createDataFrame(rows, "contract_id long, clause_idx int, text string, label string")
    tables, most, write = [], [0], dd.written

    def counted(frame, name):
        out, path = write(frame, name)
        if name == "dedup-vectors":
            tables.append((path.removeprefix("file:"), {r["contract_id"] for r in out.select("contract_id").distinct().collect()}))
            most[0] = max(most[0], sum(os.path.isdir(p) for p, _ in tables))
        return out, path
    monkeypatch.setattr(dd, "written", counted)
    monkeypatch.setattr(dd, "SLICE_ROWS", 30)
    kept = dd.semantic_dedup_tfidf(df, ["contract_id"], "clause_idx", F.struct("clause_idx")).collect()
    assert len(tables) == 4 and most[0] == 1 and sorted(c for _, found in tables for c in found) == list(range(9))
    want = {(c, i) for c, ts in texts.items() for i in brute_tfidf_keep(ts, ["x"] * len(ts))} | {(None, 0), (None, 1)}
    assert {(r["contract_id"], r["clause_idx"]) for r in kept} == want

