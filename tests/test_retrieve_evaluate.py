"""V1-V6 and E1-E4."""
import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauseflow.operators import evaluate as ev
from clauseflow.operators import retrieve as rv
from clauseflow.plans import registry


def test_knn_exact_matches_numpy(spark):
    rng = np.random.default_rng(0)
    Q, C = rng.normal(size=(7, 5)), rng.normal(size=(40, 5))
    qdf = spark.createDataFrame([(i, Q[i].tolist()) for i in range(7)], "query_id long, embedding array<double>")
    cdf = spark.createDataFrame([(100 + j, C[j].tolist()) for j in range(40)], "clause_id long, embedding array<double>")
    got = {}
    for r in rv.knn_exact(qdf, cdf.repartition(3), 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["clause_id"]))
    for i in range(7):
        d = ((C - Q[i]) ** 2).sum(axis=1)
        want = [100 + j for j in np.lexsort((np.arange(40), d))[:5]]
        assert [c for _, c in sorted(got[i])] == want


def test_knn_blocks_do_not_change_the_result(spark):
    rng = np.random.default_rng(1)
    Q, C = rng.normal(size=(9, 4)), rng.normal(size=(30, 4))
    qdf = spark.createDataFrame([(i, Q[i].tolist()) for i in range(9)] + [(99, None)], "query_id long, embedding array<double>")
    cdf = spark.createDataFrame([(j, C[j].tolist()) for j in range(30)] + [(98, None)], "clause_id long, embedding array<double>")
    base = sorted(tuple(r) for r in rv.knn_exact(qdf, cdf, 3).select("query_id", "rank", "clause_id").collect())
    got = sorted(tuple(r) for r in rv.knn_exact(qdf, cdf, 3, block_rows=4).select("query_id", "rank", "clause_id").collect())
    assert got == base and len(got) == 27
    every_cell = rv.knn_cells(qdf, cdf, 3, n_cells=5, n_probe=5, block_rows=4)
    assert sorted(tuple(r) for r in every_cell.select("query_id", "rank", "clause_id").collect()) == base
    assert rv.knn_cells(qdf, cdf.limit(0), 3).count() == rv.knn_exact(qdf.limit(0), cdf, 3).count() == 0


def test_knn_k_larger_than_corpus(spark):
    qdf = spark.createDataFrame([(1, [0.0, 0.0])], "query_id long, embedding array<double>")
    cdf = spark.createDataFrame([(5, [1.0, 0.0]), (6, [0.0, 2.0])], "clause_id long, embedding array<double>")
    assert [r["clause_id"] for r in rv.knn_exact(qdf, cdf, 5).orderBy("rank").collect()] == [5, 6]


def test_deterministic_sample_is_stable(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = sorted(r["k"] for r in rv.deterministic_sample(df.repartition(1), "k", 50).collect())
    b = sorted(r["k"] for r in rv.deterministic_sample(df.repartition(9), "k", 50).collect())
    assert a == b and len(a) == 50
    assert rv.deterministic_sample(df, "k", 5000).count() == 1000
    import hashlib
    want = sorted(range(1000), key=lambda k: hashlib.md5(f"42|{k}".encode()).hexdigest())
    for n, prefix in ((50, 3), (333, 1), (0, 2), (999, 1), (1000, 2)):
        assert sorted(r["k"] for r in rv.deterministic_sample(df, "k", n, prefix_hex=prefix).collect()) == sorted(want[:n])


def test_correctness_band_edges(spark):
    sims = [0.95, 0.90, 0.85, 0.8499, 0.75, 0.65, 0.6499]
    df = spark.createDataFrame([(s,) for s in sims], "s double")
    got = [r["b"] for r in df.select(ev.correctness_band(F.col("s")).alias("b")).collect()]
    assert got == [5, 4, 4, 3, 3, 2, 1]


def test_fairness_band_and_merge(spark):
    rows = [("sole discretion without notice exclusive", "either party mutual", 1),   # 2-3 = -1 -> 2
            ("plain", "either party mutual and both parties", None),                    # 3 -> 5
            ("", "x", 4)]                                                               # skipped
    df = spark.createDataFrame(rows, "original string, rewritten string, clarity int") \
        .withColumn("scores", F.struct(F.lit(None).cast("int").alias("correctness"),
                                       F.lit(None).cast("int").alias("fairness"), F.col("clarity")))
    out = ev.score_rewrites(df).collect()
    assert [r["scores"]["fairness"] for r in out] == [2, 5, None]
    assert [r["scores"]["clarity"] for r in out] == [1, None, 4]
    s = ev.rewrite_summary(ev.score_rewrites(df)).first()
    assert s["processed"] == 2 and s["avg_fairness"] == 3.5 and s["avg_correctness"] == 1.0


def test_cell_search_recall_and_work(spark):
    """V6: recall@5 against the exact search, on clustered vectors and on the
    embeddings table, and the share of pairs that is compared."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    C = centres[rng.integers(40, size=3000)] + 0.25 * rng.normal(size=(3000, 16))
    Q = centres[rng.integers(40, size=200)] + 0.25 * rng.normal(size=(200, 16))
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(Q)], "query_id long, embedding array<double>")
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(C)], "clause_id long, embedding array<double>")

    def found(df):
        return {(r["query_id"], r["clause_id"]) for r in df.collect()}
    exact = found(rv.knn_exact(q, c, 5))
    assert len(exact & found(rv.knn_cells(q, c, 5, n_cells=32, n_probe=4))) >= 0.9 * len(exact)

    near = rv.coarse_centres(c, "embedding", 32)
    cell = lambda x, n: np.argsort(((x[:, None, :] - near) ** 2).sum(2), axis=1)[:, :n]
    sizes = np.bincount(cell(C, 1)[:, 0], minlength=32)
    assert sizes[cell(Q, 4)].sum() < 0.3 * len(Q) * len(C)

    t = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    q, c = t.filter("vec_id % 5 = 0"), t.filter("vec_id % 5 <> 0")
    q, c = q.withColumnRenamed("vec_id", "query_id"), c.withColumnRenamed("vec_id", "clause_id")
    exact = found(rv.knn_exact(q, c, 5))
    assert len(exact & found(rv.knn_cells(q, c, 5, n_cells=8, n_probe=6))) >= 0.9 * len(exact)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_registered_cell_search_recall(spark, sf):
    """The registered query itself, against the registered exact search."""
    def found(name):
        return {(r["query_id"], r["clause_id"]) for r in registry.QUERIES[name](spark, f"/root/testdata/{sf}").collect()}
    exact = found("knn_exact")
    assert len(exact & found("knn_cells")) >= 0.9 * len(exact)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_registered_code_search_recall_and_work(spark, sf):
    """V6 by codes: the registered query against the registered exact search, and
    its work per pair (table entries and re-ranked vectors) against exact distances."""
    def found(name):
        return {(r["query_id"], r["clause_id"]): r["distance"] for r in registry.QUERIES[name](spark, f"/root/testdata/{sf}").collect()}
    exact, got = found("knn_exact"), found("knn_codes")
    same = exact.keys() & got.keys()
    assert len(got) == len(exact) and len(same) >= 0.9 * len(exact) and all(abs(exact[p] - got[p]) < 2e-6 for p in same)
    settings = inspect.signature(rv.knn_codes).parameters
    n = registry.emb_split(spark, f"/root/testdata/{sf}").filter("split = 'train'").count()
    assert settings["n_parts"].default / 64 + settings["rerank"].default / n < 0.3


def test_code_search_is_exact_where_all_are_ranked_again(spark):
    """Several tiles, parts of unequal length, repeated and null vectors, fewer rows than k."""
    rng = np.random.default_rng(5)
    vectors = [v.tolist() for v in rng.normal(size=(300, 7))]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(1000 + i, vectors[7]) for i in range(4)] + [(2000, None)]
    c = spark.createDataFrame(rows, "clause_id long, embedding array<double>")
    q = spark.createDataFrame([(i, vectors[i]) for i in range(20)] + [(99, None)], "query_id long, embedding array<double>")

    def found(df):
        return sorted((r["query_id"], r["rank"], r["clause_id"], round(r["distance"], 9)) for r in df.collect())
    assert found(rv.knn_codes(q, c, 5, n_parts=3, rerank=1000, query_rows=8, corpus_rows=50)) == found(rv.knn_exact(q, c, 5))
    assert found(rv.knn_codes(q, c, 5, n_parts=100, rerank=40, corpus_rows=50)) == found(rv.knn_exact(q, c, 5))  # a part a component
    few = c.filter("clause_id < 3")
    assert found(rv.knn_codes(q, few, 5)) == found(rv.knn_exact(q, few, 5)) and len(found(rv.knn_codes(q, few, 5))) == 60
    assert rv.knn_codes(q, c.filter("false"), 5).count() == 0 and rv.knn_codes(q.filter("false"), c, 5).count() == 0


def _brute(q, c, k, decimals=None):
    """(query_id, rank, clause_id) by squared differences, ties by id."""
    out = []
    for i, v in q:
        d = [(float(((np.array(w) - np.array(v)) ** 2).sum()), j) for j, w in c]
        near = sorted((round(x, decimals) if decimals is not None else x, j) for x, j in d)[:k]
        out += [(i, r + 1, j) for r, (_, j) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e-14, 1e18])
def test_search_tells_distances_apart_that_single_precision_cannot(spark, scale):
    """Vectors that differ by less than the rounding of a matrix product, equal ones, and zeros."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(20, 6))
    near = np.concatenate([base + 1e-9 * rng.normal(size=base.shape) for _ in range(8)] + [base[:3]] * 9 + [np.zeros((2, 6))])
    c = [(j, (scale * v).tolist()) for j, v in enumerate(near[rng.permutation(len(near))])]
    q = [(i, (scale * v).tolist()) for i, v in enumerate([*base, *rng.normal(size=(5, 6)), np.zeros(6)])]
    qdf = spark.createDataFrame(q, "query_id long, embedding array<double>")
    cdf = spark.createDataFrame(c, "clause_id long, embedding array<double>")
    for rows in (3, 50, 4096):
        got = sorted((r["query_id"], r["rank"], r["clause_id"]) for r in rv.knn_exact(qdf, cdf, 4, block_rows=rows).collect())
        assert got == _brute(q, c, 4)
    if scale == 1.0:
        got = rv.knn_exact(qdf, cdf, 4, round_decimals=6, block_rows=50).collect()
        assert sorted((r["query_id"], r["rank"], r["clause_id"]) for r in got) == _brute(q, c, 4, 6)


def test_search_of_repeated_and_null_ids(spark):
    """Rows of one id are rows of their own; null ids take part."""
    v = [[float(i), 0.0] for i in range(6)]
    q = spark.createDataFrame([(1, v[0]), (1, v[5]), (None, v[2])], "query_id long, embedding array<double>")
    c = spark.createDataFrame([(7, v[0]), (7, v[0]), (8, v[5]), (None, v[2]), (9, v[3])], "clause_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["clause_id"], r["distance"]) for r in rv.knn_exact(q, c, 3).collect()}
    assert got == {(1, 1): (7, 0.0), (1, 2): (7, 0.0), (1, 3): (8, 0.0), (None, 1): (None, 0.0), (None, 2): (9, 1.0), (None, 3): (7, 4.0)}


def test_search_compares_few_pairs_exactly_and_copies_no_vectors(spark, monkeypatch):
    """a matrix product rules nearly all pairs out; blocks are not dealt out in copies."""
    import pyarrow as pa
    rng = np.random.default_rng(3)
    x = rng.normal(size=(9000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(x), np.int32)), pa.array(np.arange(len(x))), pa.array(list(x))], names=["_cell", "_id", "_v"])
    blocks = list(rv._packer(4096, 5)([rows]))
    assert [b.column(1)[0].as_py() for b in blocks] == [4096, 4096, 808]
    pairs = [pa.RecordBatch.from_arrays([pa.array([7]), *blocks[2].columns[1:], *b.columns[1:]],
                                        names=["q_block", *[f"{s}_{c}" for s in "qc" for c in ("n", "ids", "absent", "vectors")]]) for b in blocks]
    exact, einsum = [0], np.einsum
    monkeypatch.setattr(np, "einsum", lambda how, a, b: (exact.append(len(a)), einsum(how, a, b))[1])
    (best,) = rv._best_of_blocks(5, None)(pairs)
    assert best.num_rows == 5 * 808 and sum(exact) < 0.02 * 808 * 9000
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:50])], "query_id long, embedding array<double>")
    found = rv.knn_exact(q, q.withColumnRenamed("query_id", "clause_id"), 2, block_rows=8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan and "CoGroups" not in plan and found.count() == 100
