"""Further driver queries: limits and guards that bite, review outcomes, file
round trips and the streamed review.  Registered beside those of ``registry``,
which imports this module last."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseflow.functions import lexicon as lx
from clauseflow.operators import rewrite as rw
from clauseflow.plans import oracle as O
from clauseflow.plans import pipeline as P
from clauseflow.plans import registry as R
from clauseflow.plans.registry import BASE, IMP_ORDER_SQL, PROV_CTES, QA_CTES, REVIEW_CTES, TOP20_CTES, r6, register
from clauseflow.sources import fixtures as fx

# -- L3, F6: a limit that cuts, contracts without text -----------------------------------------
TOP = 3


@register("top3_per_contract", O.with_ctes(
    BASE + O.important_ctes() + O.dedup_ctes("fx_imp", IMP_ORDER_SQL, "fx_kept"),
    "SELECT contract_id, clause_idx, label, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY contract_id "
    f"ORDER BY {IMP_ORDER_SQL}) AS INTEGER) AS rank FROM fx_kept) WHERE rank <= {TOP}"))
def q_top3_per_contract(spark, sf):
    d = P.review_contracts(R.contracts(spark, sf), fx.rule_classifier, top_n=TOP)
    return d.select("contract_id", "clause_idx", "label", F.col("rank").cast("int").alias("rank"))


@register("classify_blank_contracts", O.with_ctes(BASE, (
    "SELECT contract_id, clause_idx, label, round(confidence, 6) AS confidence FROM fx_pred WHERE contract_id % 10 NOT IN (3, 4)")))
def q_classify_blank_contracts(spark, sf):
    text = (F.when(F.col("contract_id") % 10 == 3, F.lit(" \t\n ")).when(F.col("contract_id") % 10 != 4, F.col("text")))
    d = P.classify_contracts(R.contracts(spark, sf).withColumn("text", text), fx.rule_classifier)
    return d.select("contract_id", "clause_idx", "label", r6("confidence").alias("confidence"))


# -- S12: every reason ---------------------------------------------------------------------------
@register("admission_reasons", (
    "SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'no_input' WHEN 1 THEN 'unsupported_format' WHEN 2 THEN 'empty_file' "
    "WHEN 3 THEN 'too_large' WHEN 4 THEN 'no_text' WHEN 5 THEN 'no_content' WHEN 6 THEN 'unreadable_file' WHEN 7 THEN 'no_extractor' "
    f"WHEN 8 THEN CASE WHEN {O.STRIP('text')} = '' THEN 'no_text' END ELSE CASE WHEN {O.STRIP('text')} = '' THEN 'no_input' END END AS reject_reason, "
    f"CASE doc_id % 10 WHEN 8 THEN CAST(length(text) AS INTEGER) WHEN 9 THEN CASE WHEN {O.STRIP('text')} <> '' THEN "
    f"CAST(length({O.STRIP('text')}) AS INTEGER) END WHEN 4 THEN 3 END AS n_chars FROM documents"))
def q_admission_reasons(spark, sf):
    from clauseflow.sources import readers as rd
    k = F.pmod("doc_id", F.lit(10))
    suffix = F.when(k == 1, ".rtf").when(k.isin(5, 6), ".Docx").when(k == 7, ".pdf").otherwise(".txt")
    name = F.when(~k.isin(0, 9), F.concat(F.lit("upload"), F.col("doc_id").cast("string"), suffix))
    size = F.when(k == 2, 0).when(k == 3, F.lit(lx.MAX_UPLOAD_BYTES) + 1).otherwise(F.octet_length("text")).cast("long")
    d = fx.read_table(spark, sf, "documents").select(
        "doc_id", name.alias("filename"), F.when(k == 9, F.col("text")).otherwise(F.lit("")).alias("form_text"), size.alias("n_bytes"),
        F.when(k == 4, F.lit(" \n\t")).when(~k.isin(2, 3), F.col("text")).alias("file_text"),
        F.when(k != 5, F.encode("text", "UTF-8")).alias("content"))
    d = rd.with_document_text(rd.admission(d))
    return d.select("doc_id", "reject_reason", F.when(k.isin(4, 8, 9), F.length("analysis_text")).cast("int").alias("n_chars"))


# -- W3-W5, W7: completed and failed reviews -----------------------------------------------------
def _counting_completer(prompt: str) -> str:
    """A made-up completion that SQL can state: the length of the request; it
    refuses a request whose clause names a Buyer."""
    clause = prompt.split("Original Clause:\n", 1)[1].split("\n\nSimilar Reference", 1)[0].split("\n\nRewritten Clause", 1)[0]
    if "Buyer" in clause:
        raise ValueError("refused")
    return f"{len(prompt)} characters"


_EXPLAIN_CHARS = len(rw.EXPLAIN_INSTRUCTION + '\n\nClause Type: \n\nOriginal Clause:\n""\n\nRewritten Clause:\n""\n\nChanges:')
_REWRITE_CHARS = len(rw.REWRITE_INSTRUCTION + "\n\nOriginal Clause:\n\n\nSimilar Reference Clauses:\n\n\nRewritten Clause:\n")


@register("review_outcomes", O.with_ctes(REVIEW_CTES + [
    "ro AS (SELECT t.contract_id, t.clause_idx, t.label, t.text, t.contract_id % 11 = 0 AS lost, contains(t.text, 'Buyer') AS refused, "
    f"CAST({_REWRITE_CHARS} + length(t.text) + length(coalesce(r.refs, '')) AS BIGINT)::VARCHAR || ' characters' AS done FROM rq t LEFT JOIN refs r ON r.qid = t.qid)",
], (
    "SELECT contract_id, clause_idx, CASE WHEN lost THEN '' WHEN refused THEN '[Rewrite failed: refused]' ELSE done END AS rewrite, "
    f"CASE WHEN lost THEN '{rw.REVIEW_FAILED}' WHEN refused THEN '[Explanation failed: refused]' ELSE "
    f"CAST({_EXPLAIN_CHARS} + length(label) + length(text) + length(done) AS BIGINT)::VARCHAR || ' characters' END AS explanation, "
    "CASE WHEN lost OR refused THEN 'failed' ELSE 'completed' END AS status FROM ro")))
def q_review_outcomes(spark, sf):
    top, packed = R._review_inputs(spark, sf)
    found = packed.filter(F.col("contract_id") % 11 != 0)  # the search gave the others nothing at all
    return rw.build_review(top, found, _counting_completer, need_hits=True).select(
        "contract_id", "clause_idx", "rewrite", "explanation", "status")


# -- P5: the index half ---------------------------------------------------------------------------
@register("corpus_index", O.with_ctes(PROV_CTES + [c for c in REVIEW_CTES if c.startswith(("cv0 ", "cv "))], (
    "SELECT clause_id, pos, value FROM (SELECT clause_id, CAST(unnest(range(0, 64)) AS INTEGER) AS pos, round(unnest(v), 6) AS value FROM cv) WHERE value > 0")))
def q_corpus_index(spark, sf):
    index = P.build_corpus_index(P.spread(fx.fx_provisions(spark, sf)))
    d = index.select("clause_id", F.posexplode("embedding").alias("pos", "value"))
    return d.filter("value > 0").select("clause_id", "pos", r6("value").alias("value"))


# -- files: what the writers write, the readers read ----------------------------------------------
@register("score_rewrites_file", R.ORACLE["rewrite_score_summary"])
def q_score_rewrites_file(spark, sf):
    """P8 over a written file of rewrites."""
    from clauseflow.sources import sinks as sk
    folder = R._folder(spark, "rewrites")
    sk.write_scored_rewrites(R.rewrites(spark, sf), f"{folder}/in")
    summary = P.score_rewrites_file(spark, f"{folder}/in", f"{folder}/out")
    return summary.select("processed", r6("avg_correctness").alias("avg_correctness"), r6("avg_fairness").alias("avg_fairness"))


@register("qa_files_roundtrip", O.with_ctes(QA_CTES, "SELECT d_idx, p_idx, q_idx, a_idx, question, answer FROM qa_flat"))
def q_qa_files_roundtrip(spark, sf):
    """Annotated documents in files of one JSON array each, of some hundred documents."""
    from clauseflow.sources import readers as rd
    path = R._folder(spark, "qa-json")
    docs = R.qa_docs(spark, sf).withColumn("part", F.floor(F.col("conv_id") / 200))
    (docs.groupBy("part").agg(F.to_json(F.collect_list(F.struct("data"))).alias("value"))
     .write.partitionBy("part").text(path))
    return rd.flatten_qa(rd.read_qa_json(spark, path)).select("d_idx", "p_idx", "q_idx", "a_idx", "question", "answer")


@register("labelled_csv_roundtrip", O.with_ctes(QA_CTES, "SELECT text, label FROM qa_train"))
def q_labelled_csv_roundtrip(spark, sf):
    """K1 and S8."""
    from clauseflow.sources import readers as rd
    from clauseflow.sources import sinks as sk
    path = R._folder(spark, "labelled-csv")
    sk.write_labelled_csv(R.training_set(spark, sf), path)
    return rd.read_labelled_csv(spark, path).select("text", "label")


@register("vectors_roundtrip", (
    "SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS n, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda v: v * v)), 6) AS norm2 FROM embeddings"))
def q_vectors_roundtrip(spark, sf):
    """K3, one folder a label."""
    from clauseflow.sources import sinks as sk
    path = R._folder(spark, "vectors")
    sk.write_vectors(R.embeddings(spark, sf), path, partition_by="label")
    norm2 = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, v: a + v * v)
    return spark.read.parquet(path).select("vec_id", F.col("label").cast("int").alias("label"), F.size("embedding").alias("n"), r6(norm2).alias("norm2"))


@register("report_roundtrip", R.ORACLE["contract_report"])
def q_report_roundtrip(spark, sf):
    """K5: contract reports as JSON lines."""
    from clauseflow.sources import sinks as sk
    report = R.q_contract_report(spark, sf)
    path = R._folder(spark, "reports")
    sk.write_reports(report, path)
    return spark.read.schema(report.schema).json(path)


# -- X1, X2 -----------------------------------------------------------------------------------------
STREAM_SQL = O.with_ctes(BASE + TOP20_CTES, (
    "SELECT contract_id, clause_idx, label, risk, round(confidence, 6) AS confidence, CAST(rank AS INTEGER) AS rank FROM top20"))
R.ORACLE["stream_review"] = STREAM_SQL


@register("stream_review_current", STREAM_SQL)
def q_stream_review_current(spark, sf):
    """Three uploads, the stream started anew for each: older wording of a third of
    the contracts, all contracts as they are, and the same once more."""
    from clauseflow.streaming import state as ss
    folder = R._folder(spark, "uploads")
    now = R.contracts(spark, sf).select("contract_id", "text")
    old = now.withColumn("text", F.when(F.col("contract_id") % 3 == 0, F.concat(F.lit("1.1 Old. Buyer shall pay; "), F.col("text"))).otherwise(F.col("text")))
    for number, upload in enumerate((old, now, now)):
        upload.withColumn("upload", F.lit(number)).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("contract_id long, text string, upload int").parquet(f"{folder}/in")
        ss.review_changes(stream, f"{folder}/out", f"{folder}/checkpoint", fx.rule_classifier, "upload").awaitTermination()
    return ss.current_review(spark, f"{folder}/out").select(
        "contract_id", "clause_idx", "label", "risk", r6("confidence").alias("confidence"), F.col("rank").cast("int").alias("rank"))
