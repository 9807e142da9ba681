"""Joins of two sides that grow with the input are not broadcast, however small
Spark takes their files to be."""

from pyspark.sql import functions as F

from clauseflow.operators import dedup as dd
from clauseflow.operators import report as rp
from clauseflow.operators import retrieve as rv
from clauseflow.operators import rewrite as rw
from clauseflow.operators import segment as sg
from clauseflow.streaming import state as ss


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def table(spark, rows, schema):
    """Rows in a written table, whose files Spark takes for its size."""
    return dd._ckpt(spark.createDataFrame(rows, schema))


def clause_rows(spark):
    texts = ["Buyer shall pay each invoice now", "Buyer shall pay each invoice now", "Seller must deliver the goods on time"]
    return table(spark, [(c, i, t, "Audit Rights") for c in (1, 2) for i, t in enumerate(texts)],
                 "contract_id long, clause_idx int, text string, label string")


def test_tfidf_dedup_joins_sort(spark):
    kept = dd.semantic_dedup_tfidf(clause_rows(spark), ["contract_id"], "clause_idx", F.struct("clause_idx"))
    assert "BroadcastHashJoin" not in plan(kept)
    assert sorted((r["contract_id"], r["clause_idx"]) for r in kept.collect()) == [(1, 0), (1, 2), (2, 0), (2, 2)]
    vecs = dd.tfidf_vectors(clause_rows(spark).select("contract_id", F.col("clause_idx").cast("long").alias("id"),
                                                      F.col("text").alias("_norm"), F.col("clause_idx").alias("_ok")),
                            ["contract_id"], 0.9, carry=["_ok"])
    assert "BroadcastHashJoin" not in plan(dd.tfidf_candidates(dd._ckpt(vecs), ["contract_id"], 0.9))


def test_unseen_rows_join_sorts(spark):
    rows = clause_rows(spark)
    left = dd.unseen(rows, rows.filter("clause_idx < 2"), ["text", "label"])
    assert "BroadcastHashJoin" not in plan(left) and left.count() == 2


def test_group_join_broadcasts_a_few_groups_only(spark):
    from clauseflow.session import group_join
    rows = spark.range(20).select((F.col("id") % 5).alias("g"), "id")
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    assert "BroadcastHashJoin" in plan(group_join(rows, sizes, "g"))
    many = group_join(rows, sizes, "g", few=4)
    assert "BroadcastHashJoin" not in plan(many) and many.count() == 20


def test_fragments_join_sorts(spark):
    merged = sg.merge_fragments(clause_rows(spark))
    assert "BroadcastHashJoin" not in plan(merged) and merged.count() == 2


def test_report_joins_sort(spark):
    rows = clause_rows(spark).withColumns({"risk": F.lit("HIGH"), "confidence": F.lit(0.9), "reason": F.lit(""), "bias_score": F.lit(2)})
    contracts = table(spark, [(1, "a"), (2, "b"), (3, "c")], "contract_id long, text string")
    for report in (rp.contract_report(contracts, rows, rows, rows), rp.full_report(contracts, rows, rows, rows)):
        assert "BroadcastHashJoin" not in plan(report)
        assert sorted((r["contract_id"], r["n_clauses"]) for r in report.collect()) == [(1, 3), (2, 3), (3, 0)]


def test_hit_and_review_joins_sort(spark):
    rows = clause_rows(spark).withColumn("risk", F.lit("HIGH"))
    hits = table(spark, [(1, 1, 7, 0.5)], "query_id long, rank int, clause_id long, distance double")
    meta = table(spark, [(7, "c", ["x"])], "clause_id long, clause string, label array<string>")
    queries = table(spark, [(1, 1, 0), (2, 2, 0)], "query_id long, contract_id long, clause_idx int")
    packed = rv.assemble_hits(queries.select("query_id"), hits, meta)
    assert "BroadcastHashJoin" not in plan(packed) and packed.filter("size(hits) = 1").count() == 1
    review = rw.build_review(rows, packed.withColumn("contract_id", F.col("query_id")).withColumn("clause_idx", F.lit(0)).drop("query_id"))
    assert "BroadcastHashJoin" not in plan(review) and review.count() == 6


def test_current_review_join_sorts(spark, tmp_path):
    spark.createDataFrame([(1, 1), (1, 2)], "contract_id long, version long").write.parquet(f"{tmp_path}/changed/epoch_id=0")
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "contract_id long, version long, label string").write.parquet(f"{tmp_path}/review/epoch_id=0")
    now = ss.current_review(spark, str(tmp_path))
    assert "BroadcastHashJoin" not in plan(now) and [r["label"] for r in now.collect()] == ["b"]
