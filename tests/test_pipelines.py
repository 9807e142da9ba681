"""P3, P5, P7, P8 composites and the completion hook."""
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from clauseflow.operators import rewrite as rw
from clauseflow.plans import pipeline as P
from clauseflow.plans import registry as R
from clauseflow.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_completer_captures_failures(spark):
    df = spark.createDataFrame([(1, "ok prompt"), (2, "boom prompt")], "id int, p string")

    def completer(prompt):
        if "boom" in prompt:
            raise RuntimeError("service down")
        return " rewritten "

    out = {r["id"]: r for r in rw.apply_completer(df, completer, "p", "rewrite", "Rewrite").collect()}
    assert out[1]["rewrite"] == "rewritten" and out[1]["rewrite_error"] is None
    assert out[2]["rewrite"] == "[Rewrite failed: service down]" and out[2]["rewrite_error"].startswith("RuntimeError")


def test_analyze_end_to_end(spark):
    text = ("1.1 Terms. Supplier may end the order without notice at any time. "
            "Vendor must allow an audit of its books at any time")
    reqs = spark.createDataFrame(
        [(1, text, None, None, None), (2, "", "x.rtf", 10, "x"), (3, None, None, None, None)],
        "request_id long, form_text string, filename string, n_bytes long, file_text string")
    corpus = R.corpus(spark, SF)

    def completer(prompt):
        return "Either party may end the order with written notice."

    out = P.analyze(reqs, fx.rule_classifier, completer=completer, corpus=corpus)
    assert sorted(r["request_id"] for r in out["rejected"].collect()) == [2, 3]
    review = out["review"].collect()
    assert len(review) == out["clauses"].count() > 0
    assert all(r["status"] == "completed" and len(r["hits"]) == 5 for r in review)
    out2 = P.analyze(reqs, fx.rule_classifier)
    assert {r["status"] for r in out2["review"].collect()} == {"missing_api_token"}


def test_corpus_index(spark):
    lines = fx.fx_provisions(spark, SF)
    rows = P.build_corpus_index(lines, sample_size=10).collect()
    assert len(rows) == 10 and all(abs(sum(v * v for v in r["embedding"]) - 1) < 1e-9 for r in rows)
    again = P.build_corpus_index(lines.repartition(5).withColumn("line_no", F.monotonically_increasing_id()), sample_size=10).collect()
    assert sorted(r["clause"] for r in rows) == sorted(r["clause"] for r in again)
    assert P.build_corpus_index(lines).count() == P.build_corpus(lines).count() > 10  # no sample unless asked for


def test_fitted_classifier_reviews_contracts(spark):
    """P6 -> P7 -> P2: a model that beats the majority class by far, then used on contracts."""
    import json
    labels = ["audit rights", "insurance", "price restrictions", "uncapped liability"]
    qas = []
    for i, sentence in enumerate(fx.SENTENCES):
        answers = [{"text": f"{sentence} under part {k} of the {w}"} for k in range(6) for w in ("order", "lease", "plan")]
        qas.append({"question": f'Mark the parts about "{labels[i % 4]}" here.', "answers": answers})
    text = json.dumps({"data": [{"paragraphs": [{"qas": qas}]}]})
    from clauseflow.sources import readers as rd
    docs = spark.createDataFrame([(text,)], "v string").select(F.from_json("v", rd.QA_SCHEMA).alias("d")).select("d.*")
    contracts = spark.createDataFrame([(1, "1.1 Terms. " + ". ".join(fx.SENTENCES[:12])), (2, ""), (3, None)], "contract_id long, text string")
    out = P.train_and_review(docs, contracts, min_confidence=0.0)
    fitted, base = out["metrics"].first(), out["baseline"].first()
    assert fitted["accuracy"] > base["accuracy"] + 0.4 and fitted["n"] == base["n"]
    review = out["review"].collect()
    assert review and {r["contract_id"] for r in review} == {1} and {r["label"] for r in review} <= {*labels, "uncertain"}
    assert all(0 < r["confidence"] <= 1 and len(r["top_k"]) == 3 for r in review)


def test_embedding_dedup_of_candidates(spark):
    """The same candidates by either method; ties go by clause."""
    rows = [(1, i, t, "x", c, 0) for i, (t, c) in enumerate([
        ("Buyer shall pay the fee now", 0.7), ("Buyer shall pay the fee now", 0.9), ("Carrier must hold insurance", 0.8), ("!!", 0.9), ("??", 0.9)])]
    df = spark.createDataFrame(rows, "contract_id long, clause_idx int, text string, label string, confidence double, risk_ord int")
    order = [F.col("risk_ord"), -F.col("confidence"), F.col("clause_idx")]
    for method in ("tfidf", "embedding"):
        assert sorted(r["clause_idx"] for r in P.dedup_clauses(df, order, method).collect()) == [1, 2, 3, 4]
    same = P.dedup_clauses(df, order, "embedding", encode=lambda texts: [[1.0, 0.0]] * len(texts))
    assert sorted(r["clause_idx"] for r in same.collect()) == [1, 3, 4]
    with pytest.raises(ValueError):
        P.dedup_clauses(df, order, "other")


def test_word_and_pdf_requests(spark):
    from test_sources import _docx_bytes
    text = "1.1 Terms. Supplier may end the order without notice at any time"
    rows = [(1, "", "a.docx", 10, None, _docx_bytes([text])), (2, "", "b.pdf", 10, None, b"pdf " + text.encode()), (3, "", "c.docx", 10, None, b"no zip"),
            (4, "", "d.docx", 10, None, None), (5, "", "e.docx", 10, None, _docx_bytes([" "])), (6, text, None, None, None, None),
            (7, "", "f.txt", 10, text, None), (8, "", "g.txt", 3, " ", None), (9, "", "h.exe", 3, "", None), (10, None, None, None, None, None),
            (11, "", "i.txt", 0, "", None), (12, "", "j.pdf", 21 << 20, None, b"x")]
    schema = "request_id long, form_text string, filename string, n_bytes long, file_text string"
    reqs = spark.createDataFrame(rows, schema + ", content binary")
    out = P.analyze(reqs, fx.rule_classifier)
    reasons = {r["request_id"]: r["reject_reason"] for r in out["rejected"].collect()}
    assert reasons == {2: "no_extractor", 3: "unreadable_file", 4: "no_content", 5: "no_text", 8: "no_text", 9: "unsupported_format",
                       10: "no_input", 11: "empty_file", 12: "too_large"}
    assert {r["contract_id"] for r in out["all_clauses"].collect()} == {1, 6, 7}
    read = P.analyze(reqs, fx.rule_classifier, pdf_text=lambda b: b[4:].decode())
    assert {r["contract_id"] for r in read["all_clauses"].collect()} == {1, 2, 6, 7}
    bare = P.analyze(spark.createDataFrame([r[:5] for r in rows[:2]], schema), fx.rule_classifier)
    assert {r["reject_reason"] for r in bare["rejected"].collect()} == {"no_content"}


def test_score_rewrites_file(spark):
    d = tempfile.mkdtemp(prefix="cf-rw-")
    rows = [{"id": 1, "clause_type": "x", "original": "Owner may act at its sole discretion",
             "rewritten": "Either party may act with written notice", "explanation": "",
             "similar_clauses_used": [], "scores": {"correctness": None, "fairness": None, "clarity": 4}},
            {"id": 2, "clause_type": "x", "original": "", "rewritten": "x", "explanation": "",
             "similar_clauses_used": [], "scores": {"correctness": None, "fairness": None, "clarity": None}}]
    with open(os.path.join(d, "in.json"), "w") as fh:
        json.dump(rows, fh)
    s = P.score_rewrites_file(spark, os.path.join(d, "in.json"), os.path.join(d, "out")).first()
    assert s["processed"] == 1 and s["avg_fairness"] == 4.0   # 2 balanced - 1 harmful
    back = {r["id"]: r for r in spark.read.json(os.path.join(d, "out")).collect()}
    assert back[1]["scores"]["clarity"] == 4 and back[1]["scores"]["fairness"] == 4
    assert back[2]["scores"]["fairness"] is None


def test_text_files_to_review(spark):
    """S1 -> P2: whole-text files (CRLF newlines) through segmentation, scoring, dedup, top-n."""
    from clauseflow.sources import readers as rd
    d = tempfile.mkdtemp(prefix="cf-txt-")
    body = ("Intro line.\r\n1.1 Heading. Supplier may end the order without notice at its sole discretion; "
            "Supplier may end the order without notice at its sole discretion.\r\n"
            "1.2 Heading. Vendor must allow an audit of its books at any time")
    for i in range(3):
        with open(os.path.join(d, f"c{i}.txt"), "w", newline="") as fh:
            fh.write(body)
    contracts = rd.read_text_contracts(spark, os.path.join(d, "*.txt"))
    clauses = P.classify_contracts(contracts, fx.rule_classifier)
    assert clauses.count() == 9                     # 3 valid clauses per file
    review = P.review_contracts(contracts, fx.rule_classifier, min_confidence=0.0).collect()
    per = {}
    for r in review:
        per.setdefault(r["contract_id"], []).append(r)
    assert len(per) == 3
    for rows in per.values():
        texts = [r["text"] for r in sorted(rows, key=lambda r: r["rank"])]
        # the exact copy (same label) is removed by dedup; ranks are 1..n
        assert len(texts) == len(set(texts)) and [r["rank"] for r in sorted(rows, key=lambda r: r["rank"])] == \
            list(range(1, len(rows) + 1))
