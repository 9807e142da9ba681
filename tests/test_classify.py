"""Softmax, top-k, threshold, split, metrics."""
import math

import numpy as np
from pyspark.sql import functions as F

from clauseflow.operators import classify as cl
from clauseflow.sources import fixtures as fx


def test_softmax_sums_to_one_and_topk(spark):
    head = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])]
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<double>")
    out = cl.apply_linear_head(df, head, temperature=1.0)
    out = out.withColumn("tk", cl.top_k_scores(F.col("probs"), 5))
    for r in out.collect():
        assert abs(sum(p["score"] for p in r["probs"]) - 1.0) < 1e-12
        assert len(r["tk"]) == 3                       # k clamped to n labels
    r2 = out.filter("id = 2").first()
    assert [p["label_id"] for p in r2["tk"]][:2] == [1, 2]   # tie -> smaller label id first
    e = math.e
    assert abs(r2["tk"][0]["score"] - e / (1 + 2 * e)) < 1e-12


def test_threshold_label(spark):
    df = spark.createDataFrame([(0.59,), (0.60,), (None,)], "c double")
    got = [r["l"] for r in df.select(cl.threshold_label(F.lit("x"), F.col("c")).alias("l")).collect()]
    assert got == ["uncertain", "x", "x"]  # NULL confidence compares unknown -> label kept


def test_rule_classifier_blank_gets_empty_prediction(spark):
    df = spark.createDataFrame([(1, 0, "  "), (1, 1, "Buyer shall pay")], "contract_id long, clause_idx int, text string")
    rows = {r["clause_idx"]: r for r in fx.rule_classifier(df).collect()}
    assert rows[0]["label"] == "uncertain" and rows[0]["confidence"] == 0.0 and rows[0]["top_k"] == []
    assert len(rows[1]["top_k"]) == 3


def test_stratified_split_exact_share(spark):
    rows = [(i, "a" if i < 50 else "b") for i in range(80)]
    df = spark.createDataFrame(rows, "id long, label string")
    out = cl.stratified_split(df, F.col("id"))
    counts = {(r["label"], r["split"]): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert counts[("a", "test")] == 10 and counts[("b", "test")] == 6


def test_metrics_match_hand_computation(spark):
    pairs = [(0, 0), (0, 0), (0, 1), (1, 1), (1, 0), (2, 2)]
    df = spark.createDataFrame(pairs, "label int, pred int")
    r = cl.accuracy_weighted_f1(df).first()
    labels = sorted({p for pr in pairs for p in pr})
    f1s, sup = [], []
    for c in labels:
        tp = sum(1 for a, b in pairs if a == c and b == c)
        fp = sum(1 for a, b in pairs if a != c and b == c)
        fn = sum(1 for a, b in pairs if a == c and b != c)
        p = tp / (tp + fp) if tp + fp else 0.0
        rc = tp / (tp + fn) if tp + fn else 0.0
        f1s.append(2 * p * rc / (p + rc) if p + rc else 0.0)
        sup.append(tp + fn)
    assert abs(r["accuracy"] - 4 / 6) < 1e-12
    assert abs(r["weighted_f1"] - np.dot(f1s, sup) / sum(sup)) < 1e-12
    assert abs(r["macro_f1"] - np.mean(f1s)) < 1e-12
    rep = {x["row_name"]: x for x in cl.classification_report(df).collect()}
    assert rep["accuracy"]["f1"] == r["accuracy"] and rep["2"]["support"] == 1


def test_majority_label_tie_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "label string")
    assert cl.majority_label(df) == "a"


def test_label_encode_alphabetical(spark):
    df = spark.createDataFrame([("zeta",), ("alpha",), ("mu",), ("alpha",)], "label string")
    got = {r["label"]: r["label_id"] for r in cl.label_encode(df).collect()}
    assert got == {"alpha": 0, "mu": 1, "zeta": 2}


def test_user_model_hook(spark):
    def proba(texts):
        out = np.zeros((len(texts), 41))
        out[:, 3] = 0.7
        out[:, 4] = 0.3
        return out
    df = spark.createDataFrame([("x shall",), ("",)], "text string")
    rows = cl.predict_with_model(df, proba).collect()
    by = {r["text"]: r for r in rows}
    assert by["x shall"]["label"] == "anti-assignment" and abs(by["x shall"]["confidence"] - 0.7) < 1e-12
    assert by[""]["label"] == "uncertain" and by[""]["top_k"] == []
