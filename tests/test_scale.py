"""Work that grows with the input is done once, and in bulk."""

import os
import shutil

import numpy as np
from pyspark.sql import functions as F

from clauseflow.operators import dedup as dd
from clauseflow.operators import evaluate as ev
from clauseflow.operators import segment as sg
from clauseflow.plans import pipeline as P
from clauseflow.plans import registry as R
from clauseflow.sources import fixtures as fx
from clauseflow.streaming import stream as st


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stream_reads_a_table_that_is_a_folder_of_files(spark, tmp_path):
    spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/a/documents.parquet")
    found = st.run_review_stream(spark, f"{tmp_path}/a", fx.contracts_from_documents, fx.rule_classifier)
    one = spark.read.parquet(f"{tmp_path}/a/documents.parquet").coalesce(1)
    one.write.parquet(f"{tmp_path}/one")
    os.makedirs(f"{tmp_path}/b")
    part = next(f for f in os.listdir(f"{tmp_path}/one") if f.startswith("part-"))
    shutil.copy(f"{tmp_path}/one/{part}", f"{tmp_path}/b/documents.parquet")
    same = st.run_review_stream(spark, f"{tmp_path}/b", fx.contracts_from_documents, fx.rule_classifier)
    assert found.count() > 0 and found.exceptAll(same).isEmpty() and same.exceptAll(found).isEmpty()


def test_small_groups_are_bundled_and_single_rows_left_out(spark):
    rng = np.random.default_rng(1)
    rows, expect = [], set()
    for g in range(60):
        size = (1, 3, 12)[g % 3]
        base = rng.normal(size=(size, 8))
        base[size // 2:] = base[0] + rng.normal(scale=0.1, size=(size - size // 2, 8))
        base /= np.linalg.norm(base, axis=1, keepdims=True)
        order = rng.permutation(size) / 10
        rows += [(g, g * 100 + k, float(order[k]), [float(x) for x in base[k]]) for k in range(size)]
        expect |= {(g, g * 100 + int(a), g * 100 + int(b)) for a in range(size) for b in range(size)
                   if order[a] < order[b] and base[a] @ base[b] >= 0.9}
    df = spark.createDataFrame(rows, "g int, id long, o double, v array<double>")
    for block in (1024, 6):  # 6: the groups of 12 rows meet in tiles, the others in bundles
        edges = dd.dense_edges(df, ["g"], "v", ["o"], 0.9, block_rows=block)
        assert {(r["g"], r["i"], r["j"]) for r in edges.distinct().collect()} == expect
    text = plan(dd.dense_edges(df, ["g"], "v", ["o"], 0.9))
    assert "_bundle" in text


def test_rewrite_scores_lower_each_text_once(spark):
    rows = spark.createDataFrame([(" A shall be Mutual \n", "Both Parties act", None), ("x", " ", None)],
                                 "original string, rewritten string, scores struct<correctness:int,fairness:int,clarity:int>")
    scored = ev.score_rewrites(rows)
    assert scored.columns == ["original", "rewritten", "scores", "processed"]
    assert [r["processed"] for r in scored.collect()] == [True, False]
    assert plan(scored).count("lower(") == 2


def test_a_rewrite_file_is_scored_once(spark, tmp_path):
    spark.createDataFrame([("a shall pay", "both parties pay")], "original string, rewritten string").write.json(f"{tmp_path}/in")
    summary = P.score_rewrites_file(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert "Scan json" not in plan(summary) and "FileScan json" not in plan(summary)
    assert summary.head()["processed"] == 1


def test_rewrites_read_written_clauses(spark):
    assert "regexp_replace" not in plan(R.rewrites(spark, "/root/testdata/sf0.001"))


def test_texts_are_cut_and_candidates_lowered_once(spark):
    rows = spark.createDataFrame([(1, "Buyer SHALL pay each invoice now. too short. Seller must deliver the goods on time"), (2, None), (3, "")],
                                 "contract_id long, text string")
    got = sg.split_into_clauses(rows)
    assert [(r["contract_id"], r["clause_idx"], r["part_idx"], r["text"]) for r in got.collect()] == [
        (1, 0, 0, "Buyer SHALL pay each invoice now"), (1, 1, 2, "Seller must deliver the goods on time")]
    assert "instr(lower(" not in plan(got)
    for d in (got, sg.split_clause_parts(rows), sg.split_sections(rows)):
        assert plan(d).count(sg.SECTION_OPEN) == 1
