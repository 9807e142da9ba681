"""R1-R5 golden cases (phrase precedence, substring hits, overlapping weights)."""
from pyspark.sql import functions as F

from clauseflow.operators import risk as rk
from clauseflow.plans import pipeline as P


def risk_of(spark, text, label):
    df = spark.createDataFrame([(text, label)], "text string, label string")
    r = rk.with_risk(df).first()
    return r["risk"], r["risk_score"], r["reason"]


def test_phrase_beats_label(spark):
    # HIGH label but a MEDIUM phrase -> MEDIUM (phrases are checked first)
    assert risk_of(spark, "Vendor shall keep insurance", "uncapped liability")[:2] == ("MEDIUM", 1)
    assert risk_of(spark, "Vendor shall keep insurance", "uncapped liability")[2] == \
        "Contains 'insurance' (medium-risk language)"


def test_label_reason_has_description(spark):
    risk, score, reason = risk_of(spark, "Plain words only", " Uncapped Liability ")
    assert (risk, score) == ("HIGH", 2)
    assert reason == "High-risk label: 'uncapped liability'. Liability exposure without cap."


def test_unknown_label_is_low(spark):
    risk, _, reason = risk_of(spark, "Plain words", None)
    assert risk == "LOW" and reason == "Label 'unknown' is not in configured risk lists"
    risk, _, reason = risk_of(spark, "Plain words", "uncertain")
    assert reason == "Label 'uncertain' is not in configured risk lists"


def test_substring_semantics(spark):
    assert risk_of(spark, "A non-exclusive licence", "parties")[0] == "HIGH"
    assert risk_of(spark, "The auditor will check", "parties")[0] == "MEDIUM"


def bias(spark, text, fix=False):
    df = spark.createDataFrame([(text,)], "text string")
    r = rk.with_bias(df, fix_word_boundaries=fix).first()
    return r["is_one_sided"], r["bias_score"], r["triggers"]


def test_bias_overlapping_phrases_both_count(spark):
    assert bias(spark, "at its sole discretion") == (True, 4, ["its sole discretion", "sole discretion"])
    assert bias(spark, "the company is not liable") == (True, 4, ["company is not liable", "not liable"])


def test_bias_balanced_only_and_blank(spark):
    assert bias(spark, "either party may terminate") == (False, -2, [])
    assert bias(spark, "commonly used") == (False, 1, [])          # 'only' inside 'commonly'
    assert bias(spark, "   ") == (False, 0, [])
    assert bias(spark, None) == (False, 0, [])


def test_obligation_term_inert_unless_fixed(spark):
    s = "buyer shall pay and must report"
    assert bias(spark, s)[1] == 0
    assert bias(spark, s, fix=True)[1] == 1


def test_important_filter_order_and_floor(spark):
    rows = [(1, 0, "Supplier may end without notice", "parties", 0.70),
            (1, 1, "Vendor shall keep insurance", "parties", 0.90),
            (1, 2, "Vendor shall keep records", "parties", 0.99),     # LOW -> dropped
            (1, 3, "Owner may act at sole discretion", "parties", 0.64),  # under the floor
            (1, 4, "Owner may act at sole discretion", "parties", float("nan")),  # NaN passes
            (1, 5, "   ", "uncapped liability", 0.99),               # blank -> dropped
            (1, 6, "Client shall pay liquidated damages", "parties", None)]  # NULL -> 0
    df = spark.createDataFrame(rows, "contract_id long, clause_idx int, text string, label string, confidence double")
    out = rk.top_n_per_contract(P.important_clauses(df, dedup=False), rk.important_order(), 20)
    got = [(r["clause_idx"], r["risk"]) for r in out.orderBy("rank").collect()]
    assert got == [(4, "HIGH"), (0, "HIGH"), (1, "MEDIUM")]
