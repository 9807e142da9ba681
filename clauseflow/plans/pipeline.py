"""Composite pipelines (DataFrame in -> DataFrame out).

Contracts are spread round-robin after the scan (a text file / parquet row
group is one split, and segmentation is CPU-heavy), then every stage is keyed
by ``contract_id``: narrow segmentation and scoring, one distributed dedup,
a window-group-limit top-n.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseflow.functions import lexicon as lx
from clauseflow.functions import textcols as tc
from clauseflow.operators import classify as cl
from clauseflow.operators import dedup as dd
from clauseflow.operators import risk as rk
from clauseflow.operators import segment as sg
from clauseflow.session import sort_join


def spread(df: DataFrame, target: int | None = None) -> DataFrame:
    """Round-robin contracts over the cluster only when the scan produced too few
    splits to occupy it (a few large files / row groups).  A large input already
    has many splits and is left alone: re-shuffling all text would cost a full
    network pass of the corpus for no gain."""
    target = target or max(df.sparkSession.sparkContext.defaultParallelism * 2, 1)
    if df.rdd.getNumPartitions() >= target // 2:
        return df
    return df.repartition(target)


Classifier = Callable[[DataFrame], DataFrame]


def classify_contracts(contracts: DataFrame, classifier: Classifier,
                       key: str = "contract_id", text: str = "text") -> DataFrame:
    """Blank contracts give nothing; G4 clauses -> predictions.

    ``classifier`` adds label, confidence and top_k to the clauses: a fitted
    model (``classify.text_model_classifier``), a supplied one
    (``classify.predict_with_model``) or any other DataFrame function."""
    live = contracts.filter(~tc.is_blank(text))
    return classifier(sg.split_into_clauses(live, key=key, text=text))


def dedup_clauses(candidates: DataFrame, order: list[Column], method: str = "tfidf", encode=None,
                  threshold: float = lx.SEMANTIC_DEDUP_THRESHOLD) -> DataFrame:
    """Near-duplicates of one contract and label, earlier ones by ``order``
    (numeric columns) stay.  ``method`` is "tfidf" (D2) or "embedding" (D3), the
    latter with the supplied ``encode`` (list[str] -> unit vectors) over the
    normalised texts, or the built-in hashed vector.  Texts that normalise to
    nothing are never near-duplicates, as in D2."""
    if method == "tfidf":
        key = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)])
        return dd.semantic_dedup_tfidf(candidates, ["contract_id"], "clause_idx", key, threshold=threshold)
    if method != "embedding":
        raise ValueError(f"unknown dedup method {method!r}")
    from clauseflow.operators import retrieve as rv
    # written once: both halves read it
    normal = dd._ckpt(candidates.withColumn("_norm", tc.similarity_norm(F.col("text"))))
    has_words = F.size(tc.unigrams("_norm")) > 0
    texts, blank = normal.filter(has_words), normal.filter(~has_words)
    vectors = (rv.encode_with_model(texts, encode, text="_norm", out="_vec") if encode is not None
               else rv.with_hashed_vector(texts, "_norm", out="_vec"))
    kept = dd.semantic_dedup_embedding(vectors, ["contract_id", "label"], "clause_idx", order, vec="_vec", threshold=threshold)
    return kept.select(*candidates.columns).unionByName(blank.select(*candidates.columns))


def important_clauses(predictions: DataFrame, dedup: bool = True,
                      min_confidence: float = lx.IMPORTANT_MIN_CONFIDENCE, method: str = "tfidf", encode=None) -> DataFrame:
    """F6, F3, R1, F4, L1 order, D4 dedup per contract."""
    cand = rk.important_candidates(predictions, min_confidence)
    if not dedup:
        return cand
    return dedup_clauses(cand, [F.col("risk_ord"), -F.col("confidence"), F.col("clause_idx")], method, encode)


def review_contracts(contracts: DataFrame, classifier: Classifier, top_n: int = lx.TOP_CLAUSES_PER_CONTRACT,
                     min_confidence: float = lx.IMPORTANT_MIN_CONFIDENCE, method: str = "tfidf", encode=None) -> DataFrame:
    """P1 -> R3 -> first ``top_n`` per contract (limit after dedup)."""
    pred = classify_contracts(contracts, classifier)
    imp = important_clauses(pred, min_confidence=min_confidence, method=method, encode=encode)
    return rk.top_n_per_contract(imp, rk.important_order(), top_n)


def one_sided_high_risk(predictions: DataFrame, min_confidence: float = lx.IMPORTANT_MIN_CONFIDENCE,
                        fix_word_boundaries: bool = False, method: str = "tfidf", encode=None) -> DataFrame:
    """HIGH + one-sided, L2 order, D4 dedup per contract."""
    cand = rk.one_sided_candidates(predictions, min_confidence, fix_word_boundaries)
    return dedup_clauses(cand, [-F.col("bias_score"), -F.col("confidence"), F.col("clause_idx")], method, encode)


def one_sided_contracts(contracts: DataFrame, classifier: Classifier) -> DataFrame:
    """P1 -> R4."""
    return one_sided_high_risk(classify_contracts(contracts, classifier))


def build_training_set(qa_docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """S5 flatten -> T5 label (unquoted questions dropped) -> T1 normalise ->
    F2 filters -> D1 keep first (text, label) in document order."""
    from clauseflow.sources import readers as rd
    keep = keep or []
    flat = rd.flatten_qa(qa_docs, keep)
    d = (flat.filter(tc.has_quoted(F.col("question")))
         .withColumn("label", tc.quoted_label(F.col("question")))
         .filter(F.col("answer").isNotNull() & (F.col("answer") != "")))
    d = tc.normalize_clause_text(d, "answer", "text")
    d = (tc.with_computed(d, {"text": F.col("text")})
         .withColumn("n_words", tc.word_count("text")).withColumn("n_chars", F.length("text"))
         .filter((F.col("text") != "") & (F.col("n_words") >= lx.TRAIN_MIN_WORDS)
                 & F.col("n_chars").between(lx.TRAIN_MIN_CHARS, lx.TRAIN_MAX_CHARS)))
    order = [*keep, "d_idx", "p_idx", "q_idx", "a_idx"]
    return dd.exact_dedup(d.select("text", "label", *order), ["text", "label"], order)


def build_corpus(lines: DataFrame, value: str = "value", line_no: str = "line_no") -> DataFrame:
    """P5 (first half): S6 parse (bad lines skipped) -> T2 clean -> F1 20..300 words."""
    from clauseflow.sources import readers as rd
    p = rd.parse_provision_lines(lines, value).filter("ok")
    # cleaning keeps the word count, so filter on the raw text (one regex pass)
    p = tc.with_computed(p, {"n_words": tc.word_count("provision")})
    p = p.filter(F.col("n_words").between(lx.CORPUS_MIN_WORDS, lx.CORPUS_MAX_WORDS))
    p = p.withColumn("clause", tc.clean_text("provision"))
    return p.select(F.col(line_no).cast("long").alias("clause_id"), "clause", "source", "label", "n_words")


def analyze(requests: DataFrame, classifier: Classifier, completer=None, corpus: DataFrame | None = None,
            encoder_dim: int = 64, pdf_text=None, method: str = "tfidf", encode=None) -> dict[str, DataFrame]:
    """Admission (S11/S12, S2 text) -> P1 -> R3 top 20 -> review (W5) -> status.

    ``requests`` carries (request_id, form_text, filename, n_bytes, file_text) and,
    for Word and PDF files, their bytes in ``content``; ``pdf_text(bytes) -> str``
    is the caller's PDF extractor.  Returns DataFrames: rejected requests, each
    with its reason, all clause predictions, the important clauses, and the
    review rows (with per-row status).
    """
    from clauseflow.operators import retrieve as rv
    from clauseflow.operators import rewrite as rw
    from clauseflow.sources import readers as rd
    adm = rd.with_document_text(rd.admission(requests), pdf_text)
    rejected = adm.filter(F.col("reject_reason").isNotNull())
    accepted = (adm.filter(F.col("reject_reason").isNull())
                .select(F.col("request_id").alias("contract_id"), F.col("analysis_text").alias("text")))
    all_clauses = classify_contracts(spread(accepted), classifier)
    important = rk.top_n_per_contract(important_clauses(all_clauses, method=method, encode=encode), rk.important_order())
    if corpus is not None:
        # query ids are assigned once and frozen by a checkpoint (ids stay stable on recompute)
        keyed = dd._ckpt(important.select("contract_id", "clause_idx", "text")
                         .withColumn("query_id", F.monotonically_increasing_id()))
        q = rv.with_hashed_vector(keyed, "text", dim=encoder_dim).select(
            "query_id", "embedding", "contract_id", "clause_idx")
        corp = rv.with_hashed_vector(corpus, "clause", dim=encoder_dim)
        hits = rv.knn_exact(q, corp, lx.RETRIEVAL_K)
        packed = rv.assemble_hits(q.select("query_id"), hits, corp.select("clause_id", "clause", "label"))
        packed = sort_join(packed, q.select("query_id", "contract_id", "clause_idx"), "query_id").drop("query_id")
    else:
        schema = "contract_id long, clause_idx int, hits array<struct<rank:int,clause_id:long,clause:string," \
                 "label:array<string>,distance:double>>"
        packed = important.sparkSession.createDataFrame([], schema)
    review = rw.build_review(important, packed, completer, need_hits=corpus is not None)
    return {"rejected": rejected, "all_clauses": all_clauses, "clauses": important, "review": review}


def build_corpus_index(lines: DataFrame, encode=None, sample_size: int | None = None, dim: int = 64) -> DataFrame:
    """P5: corpus build -> sample of ``sample_size`` (off by default; the first
    by a hash of the clause, the same however the lines are split) -> vectors.
    ``encode`` is a caller-supplied encoder (list[str] -> (n, d)); without one
    the built-in hashed bag-of-words vector is used."""
    from clauseflow.operators import retrieve as rv
    corp = build_corpus(lines)
    if sample_size is not None:
        corp = rv.deterministic_sample(corp, "clause", sample_size)
    if encode is not None:
        return rv.encode_with_model(corp, encode, text="clause")
    return rv.with_hashed_vector(corp, "clause", dim=dim)


def train_and_evaluate(labelled: DataFrame, num_features: int = 1 << 18, max_iter: int = 50,
                       reg_params: tuple[float, ...] = (0.001, 0.01, 0.1)) -> dict:
    """C7 encode -> C8 stratified split -> C9 fit with selection -> C10/C11
    metrics, plus the majority-class baseline (C13).  ``labels`` are the label
    names by id, ready for ``classify.text_model_classifier``."""
    enc = dd._ckpt(cl.label_encode(labelled))
    split = dd._ckpt(cl.stratified_split(enc, F.concat(F.col("label"), F.lit("|"), F.col("text")), label="label"))
    model = cl.fit_text_classifier(split.filter("split = 'train'"), num_features=num_features, max_iter=max_iter, reg_params=reg_params)
    test = split.filter("split = 'test'")
    pred = model.transform(test.withColumn("label_id", F.col("label_id").cast("double")))
    pairs = dd._ckpt(pred.select(F.col("label_id").cast("int").alias("label"), F.col("prediction").cast("int").alias("pred")))
    maj = cl.majority_label(split.filter("split = 'train'").select(F.col("label_id").alias("label")))
    base_pairs = test.select(F.col("label_id").alias("label"), F.lit(maj).cast("int").alias("pred"))
    labels = [r["label"] for r in enc.select("label_id", "label").distinct().orderBy("label_id").collect()]  # one row a class
    return {"model": model, "labels": labels, "split_sizes": split.groupBy("split").count(),
            "metrics": cl.accuracy_weighted_f1(pairs), "report": cl.classification_report(pairs),
            "baseline": cl.accuracy_weighted_f1(base_pairs)}


def train_and_review(qa_docs: DataFrame, contracts: DataFrame, keep: list[str] | None = None, **review) -> dict:
    """P6 -> P7 -> P2: training set from annotated questions, a fitted model, and
    the contracts reviewed with it."""
    trained = train_and_evaluate(build_training_set(qa_docs, keep).select("text", "label"))
    classifier = cl.text_model_classifier(trained["model"], trained["labels"])
    return {**trained, "review": review_contracts(contracts, classifier, **review)}


def score_rewrites_file(spark, path: str, out_path: str | None = None, similarity=None) -> DataFrame:
    """S10 read -> F7/E1/E2/E3 score -> K7 write a new version -> E4 summary."""
    from clauseflow.operators import evaluate as ev
    from clauseflow.sources import readers as rd
    from clauseflow.sources import sinks as sk
    scored = ev.score_rewrites(rd.read_rewrites(spark, path), similarity)
    if out_path:
        scored = dd._ckpt(scored)  # scored once for the file and the summary
        sk.write_scored_rewrites(scored.drop("processed"), out_path)
    return ev.rewrite_summary(scored)
