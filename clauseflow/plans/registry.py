"""Driver query registry: ``queries()`` (Spark) and ``oracle_sql()`` (DuckDB).

Every query reads the driver's parquet tables (or fixtures Spark derives from
them) in full.  Doubles are rounded to 6 places on both sides; list outputs
are joined to '|'-separated strings so both engines hash the same scalars.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseflow.functions import lexicon as lx
from clauseflow.functions import textcols as tc
from clauseflow.operators import classify as cl
from clauseflow.operators import dedup as dd
from clauseflow.operators import rewrite as rw
from clauseflow.operators import risk as rk
from clauseflow.operators import segment as sg
from clauseflow.plans import oracle as O
from clauseflow.plans import pipeline as P
from clauseflow.session import sort_join
from clauseflow.sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c):
    return F.round(c, 6)


# -- shared fixture builders (Spark) --------------------------------------------------
def contracts(spark, sf):
    return P.spread(fx.fx_contracts(spark, sf))


def clauses(spark, sf):
    return sg.split_into_clauses(contracts(spark, sf))


def predictions(spark, sf):
    return fx.rule_classifier(clauses(spark, sf))


BASE = O.base_ctes()

# -- G1-G5 -----------------------------------------------------------------------------


@register("section_split", O.with_ctes(BASE, (
    "SELECT contract_id, CAST(i - 1 AS INTEGER) AS section_idx, "
    "nullif(regexp_extract(s, '^(\\d+\\.\\d+) ', 1), '') AS section_no, s AS section_text "
    "FROM (SELECT contract_id, unnest(secs) AS s, unnest(generate_series(1, len(secs))) AS i FROM fx_secs)")))
def q_section_split(spark, sf):
    return sg.split_sections(contracts(spark, sf))


@register("clause_split", O.with_ctes(BASE, (
    "SELECT contract_id, p.section_idx, p.part_idx, p.text FROM (SELECT contract_id, unnest(parts) AS p FROM fx_parts)")))
def q_clause_split(spark, sf):
    return sg.split_clause_parts(contracts(spark, sf)).select("contract_id", "section_idx", "part_idx", "text")


@register("valid_clauses", O.with_ctes(BASE, (
    f"SELECT contract_id, p.section_idx, p.part_idx, {O.WC('p.text')} AS n_words, "
    f"regexp_matches(p.text, '^\\p{{Lu}}') AS first_upper, {O.VALID('p.text')} AS is_valid "
    "FROM (SELECT contract_id, unnest(parts) AS p FROM fx_parts)")))
def q_valid_clauses(spark, sf):
    d = sg.split_clause_parts(contracts(spark, sf))
    return d.select("contract_id", "section_idx", "part_idx", tc.word_count("text").alias("n_words"),
                    F.col("text").rlike(r"^\p{IsUppercase}").alias("first_upper"), "is_valid")


@register("contract_clauses", O.with_ctes(BASE, "SELECT * FROM fx_clauses"))
def q_contract_clauses(spark, sf):
    return clauses(spark, sf)


@register("merge_fragments", O.with_ctes(BASE + [
    f"m1 AS (SELECT contract_id, clause_idx, text, CASE WHEN {O.WC('text')} >= 12 THEN 1 ELSE 0 END AS lng FROM fx_clauses)",
    "m2 AS (SELECT *, sum(lng) OVER (PARTITION BY contract_id ORDER BY clause_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - lng AS island FROM m1)",
], (
    "SELECT contract_id, clause_idx AS first_idx, text, 1 AS n_parts FROM m2 WHERE lng = 1 UNION ALL "
    "SELECT contract_id, min(clause_idx) AS first_idx, string_agg(text, ' ' ORDER BY clause_idx) AS text, "
    "CAST(count(*) AS INTEGER) AS n_parts FROM m2 WHERE lng = 0 GROUP BY contract_id, island")))
def q_merge_fragments(spark, sf):
    return sg.merge_fragments(clauses(spark, sf))


# -- T6-T10 -----------------------------------------------------------------------------
_LW = "lower(text)"


@register("lexicon_first_match", O.with_ctes(BASE, (
    f"SELECT contract_id, clause_idx, {O.FIRST(_LW, lx.HIGH_RISK_PHRASES)} AS high_phrase, "
    f"{O.FIRST(_LW, lx.MEDIUM_RISK_PHRASES)} AS medium_phrase FROM fx_clauses")))
def q_lexicon_first_match(spark, sf):
    d = clauses(spark, sf).withColumn("_lw", F.lower("text"))
    return d.select("contract_id", "clause_idx", tc.first_match("_lw", lx.HIGH_RISK_PHRASES).alias("high_phrase"),
                    tc.first_match("_lw", lx.MEDIUM_RISK_PHRASES).alias("medium_phrase"))


_HITS = f"list_filter({O.lx_weighted_sql()}, lambda x: contains(lower(text), x.p))"


@register("lexicon_weighted_hits", O.with_ctes(BASE, (
    f"SELECT contract_id, clause_idx, CAST(coalesce(list_sum(list_transform({_HITS}, lambda x: x.w)), 0) AS INTEGER) AS weight_sum, "
    f"array_to_string(list_transform({_HITS}, lambda x: x.p), '|') AS hits, "
    f"{O.ANY(_LW, lx.BIAS_BALANCED_PHRASES)} AS any_balanced, "
    f"CAST({O.NHITS(_LW, lx.FAIRNESS_HARMFUL_PHRASES)} AS INTEGER) AS n_harmful, "
    f"CAST(len(regexp_extract_all(lower(text), '\\b(shall|must|required to|obligated to)\\b')) AS INTEGER) AS obligation_words, "
    f"CAST(len(regexp_extract_all(lower(text), '\\\\b(shall|must|required to|obligated to)\\\\b')) AS INTEGER) AS obligation_literal_b "
    "FROM fx_clauses")))
def q_lexicon_weighted_hits(spark, sf):
    d = clauses(spark, sf).withColumn("_lw", F.lower("text"))
    hits = tc.weighted_hits("_lw", lx.ONE_SIDED_PHRASES)
    return d.select(
        "contract_id", "clause_idx",
        F.aggregate(hits, F.lit(0), lambda a, x: a + x["weight"]).alias("weight_sum"),
        F.array_join(F.transform(hits, lambda x: x["phrase"]), "|").alias("hits"),
        tc.any_phrase("_lw", lx.BIAS_BALANCED_PHRASES).alias("any_balanced"),
        tc.count_phrases("_lw", lx.FAIRNESS_HARMFUL_PHRASES).alias("n_harmful"),
        tc.regex_count("_lw", lx.OBLIGATION_PATTERN_WORD).alias("obligation_words"),
        tc.regex_count("_lw", lx.OBLIGATION_PATTERN_LITERAL_B).alias("obligation_literal_b"))


# -- C6/C4 predictions, R1, R2 ------------------------------------------------------------
@register("confidence_threshold", O.with_ctes(BASE, (
    "SELECT contract_id, clause_idx, label, round(confidence, 6) AS confidence, top1, top2, top3, "
    f"confidence >= {lx.IMPORTANT_MIN_CONFIDENCE} AS passes_floor FROM fx_pred")))
def q_confidence_threshold(spark, sf):
    d = predictions(spark, sf)
    return d.select("contract_id", "clause_idx", "label", r6("confidence").alias("confidence"),
                    F.col("top_k")[0]["label"].alias("top1"), F.col("top_k")[1]["label"].alias("top2"),
                    F.col("top_k")[2]["label"].alias("top3"),
                    (F.col("confidence") >= lx.IMPORTANT_MIN_CONFIDENCE).alias("passes_floor"))


@register("risk_level", O.with_ctes(BASE + [f"rl AS ({O.risk_select('fx_pred')})"], (
    "SELECT contract_id, clause_idx, label, risk, CASE risk WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END AS risk_score, "
    "reason FROM rl")))
def q_risk_level(spark, sf):
    return rk.with_risk(predictions(spark, sf)).select("contract_id", "clause_idx", "label", "risk", "risk_score", "reason")


@register("one_sided_bias", O.with_ctes(BASE, f"SELECT contract_id, clause_idx, {O.bias_cols('text')} FROM fx_pred"))
def q_one_sided_bias(spark, sf):
    d = rk.with_bias(predictions(spark, sf))
    return d.select("contract_id", "clause_idx", "bias_score", "is_one_sided",
                    F.array_join("triggers", "|").alias("triggers"))


# -- R3 / R4 / L3 / D2 -------------------------------------------------------------------
IMP_ORDER_SQL = "risk_ord, confidence DESC, clause_idx"
_IMP_OUT = "contract_id, clause_idx, text, label, risk, risk_score, round(confidence, 6) AS confidence, reason"


@register("important_clauses", O.with_ctes(BASE + O.important_ctes() + O.dedup_ctes("fx_imp", IMP_ORDER_SQL, "fx_kept"),
                                           f"SELECT {_IMP_OUT} FROM fx_kept"))
def q_important_clauses(spark, sf):
    d = P.important_clauses(predictions(spark, sf))
    return d.select("contract_id", "clause_idx", "text", "label", "risk", "risk_score",
                    r6("confidence").alias("confidence"), "reason")


@register("top20_per_contract", O.with_ctes(
    BASE + O.important_ctes() + O.dedup_ctes("fx_imp", IMP_ORDER_SQL, "fx_kept"),
    f"SELECT * FROM (SELECT {_IMP_OUT}, CAST(row_number() OVER (PARTITION BY contract_id ORDER BY {IMP_ORDER_SQL}) AS INTEGER) AS rank "
    f"FROM fx_kept) WHERE rank <= {lx.TOP_CLAUSES_PER_CONTRACT}"))
def q_top20(spark, sf):
    d = P.review_contracts(contracts(spark, sf), fx.rule_classifier)
    return d.select("contract_id", "clause_idx", "text", "label", "risk", "risk_score",
                    r6("confidence").alias("confidence"), "reason", F.col("rank").cast("int").alias("rank"))


@register("one_sided_high_risk", O.with_ctes(
    BASE + O.one_sided_ctes() + O.dedup_ctes("fx_os", "bias_score DESC, confidence DESC, clause_idx", "fx_okept"),
    "SELECT contract_id, clause_idx, text, label, risk, risk_score, round(confidence, 6) AS confidence, bias_score, "
    "reason, triggers FROM fx_okept"))
def q_one_sided(spark, sf):
    d = P.one_sided_high_risk(predictions(spark, sf))
    return d.select("contract_id", "clause_idx", "text", "label", "risk", "risk_score",
                    r6("confidence").alias("confidence"), "bias_score", "reason",
                    F.array_join("triggers", "|").alias("triggers"))


@register("semantic_dedup_tfidf", O.with_ctes(
    BASE + O.dedup_ctes("fx_pred", "clause_idx", "fx_dkept"),
    "SELECT contract_id, clause_idx, label FROM fx_dkept"))
def q_semantic_dedup_tfidf(spark, sf):
    d = dd.semantic_dedup_tfidf(predictions(spark, sf), ["contract_id"], "clause_idx",
                                F.struct(F.col("clause_idx")))
    return d.select("contract_id", "clause_idx", "label")


# =============================================================================================
# Embeddings: stratified split, linear head, metrics, D3, kNN, correctness band
# =============================================================================================
def embeddings(spark, sf):
    return fx.read_table(spark, sf, "embeddings")


def emb_split(spark, sf):
    return cl.stratified_split(embeddings(spark, sf), F.col("vec_id"), label="label")


def emb_scored(spark, sf):
    split = dd._ckpt(emb_split(spark, sf))
    head = cl.fit_centroid_head(split.filter(F.col("split") == "train"))
    return cl.apply_linear_head(split, head)


EMB_CTES = [
    O.label_dim_cte(),
    "e_split AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('42|' || CAST(vec_id AS VARCHAR)), vec_id) "
    "<= round(count(*) OVER (PARTITION BY label) * 0.2) THEN 'test' ELSE 'train' END AS split FROM embeddings)",
    "e_cell AS (SELECT label AS label_id, pos, avg(CAST(v AS DOUBLE)) AS w FROM (SELECT label, unnest(embedding) AS v, "
    "unnest(generate_series(1, len(embedding))) AS pos FROM e_split WHERE split = 'train') GROUP BY label, pos)",
    "e_head AS (SELECT label_id, list(w ORDER BY pos) AS wv FROM e_cell GROUP BY label_id)",
    "e_z AS (SELECT s.vec_id, s.label, s.split, h.label_id, list_dot_product(CAST(s.embedding AS DOUBLE[]), h.wv) / 0.1 AS z "
    "FROM e_split s CROSS JOIN e_head h)",
    "e_zz AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM e_z)",
    "e_p AS (SELECT vec_id, label, split, label_id, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e_zz)",
    "e_rank AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, label_id) AS k FROM e_p)",
    "e_pred AS (SELECT vec_id, label, split, label_id AS pred_id, p AS confidence FROM e_rank WHERE k = 1)",
]


@register("stratified_split", O.with_ctes(EMB_CTES, "SELECT vec_id, label, split FROM e_split"))
def q_stratified_split(spark, sf):
    return emb_split(spark, sf).select("vec_id", "label", "split")


@register("split_sizes", O.with_ctes(EMB_CTES, "SELECT split, count(*) AS n FROM e_split GROUP BY split"))
def q_split_sizes(spark, sf):
    return emb_split(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@register("linear_head_softmax", O.with_ctes(EMB_CTES, "SELECT vec_id, label_id, round(p, 6) AS prob FROM e_p"))
def q_linear_head_softmax(spark, sf):
    d = emb_scored(spark, sf).select("vec_id", F.explode("probs").alias("p"))
    return d.select("vec_id", F.col("p.label_id").alias("label_id"), r6(F.col("p.score")).alias("prob"))


@register("top_k_labels", O.with_ctes(EMB_CTES, (
    "SELECT vec_id, CAST(k AS INTEGER) AS k_rank, label_id, round(p, 6) AS score FROM e_rank WHERE k <= 3")))
def q_top_k_labels(spark, sf):
    d = emb_scored(spark, sf).select("vec_id", F.posexplode(cl.top_k_scores(F.col("probs"))).alias("k", "p"))
    return d.select("vec_id", (F.col("k") + 1).cast("int").alias("k_rank"), F.col("p.label_id").alias("label_id"),
                    r6(F.col("p.score")).alias("score"))


@register("centroid_predict", O.with_ctes(EMB_CTES, (
    "SELECT p.vec_id, p.label, p.pred_id, d.label AS pred_label, round(p.confidence, 6) AS confidence, "
    f"CASE WHEN p.confidence < {lx.UNCERTAIN_BELOW} THEN 'uncertain' ELSE d.label END AS final_label "
    "FROM e_pred p LEFT JOIN label_dim d ON d.label_id = p.pred_id")))
def q_centroid_predict(spark, sf):
    d = emb_scored(spark, sf).withColumn("_top", F.col("probs"))
    d = d.withColumn("_t1", cl.top_k_scores(F.col("probs"), 1)[0])
    d = d.select("vec_id", "label", F.col("_t1.label_id").alias("pred_id"), F.col("_t1.score").alias("confidence"))
    d = cl.with_label_names(d, "pred_id", "pred_label")
    return d.select("vec_id", "label", "pred_id", "pred_label", r6("confidence").alias("confidence"),
                    cl.threshold_label(F.col("pred_label"), F.col("confidence")).alias("final_label"))


def _test_pairs(spark, sf):
    d = emb_scored(spark, sf).filter(F.col("split") == "test")
    return d.select(F.col("label"), cl.top_k_scores(F.col("probs"), 1)[0]["label_id"].alias("pred"))


_METRIC_CTES = [
    "m_cm AS (SELECT label, pred, count(*) AS n FROM m_pairs GROUP BY label, pred)",
    "m_cls AS (SELECT label AS cls FROM m_cm UNION SELECT pred FROM m_cm)",
    "m_c AS (SELECT c.cls, coalesce((SELECT sum(n) FROM m_cm WHERE label = c.cls AND pred = c.cls), 0) AS tp, "
    "coalesce((SELECT sum(n) FROM m_cm WHERE pred = c.cls), 0) AS npred, coalesce((SELECT sum(n) FROM m_cm WHERE label = c.cls), 0) AS support FROM m_cls c)",
    "m_prf AS (SELECT cls, tp, support, CASE WHEN npred > 0 THEN tp / npred ELSE 0.0 END AS precision, "
    "CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM m_c)",
    "m_f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m_prf)",
]
_SUMMARY = ("SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(tp) / sum(support), 6) AS accuracy, "
            "round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(avg(f1), 6) AS macro_f1 FROM m_f")


def _summary(df):
    return df.select(F.col("n").cast("long").alias("n"), r6("accuracy").alias("accuracy"),
                     r6("weighted_f1").alias("weighted_f1"), r6("macro_f1").alias("macro_f1"))


@register("accuracy_weighted_f1", O.with_ctes(
    EMB_CTES + ["m_pairs AS (SELECT label, pred_id AS pred FROM e_pred WHERE split = 'test')"] + _METRIC_CTES, _SUMMARY))
def q_accuracy_weighted_f1(spark, sf):
    return _summary(cl.accuracy_weighted_f1(_test_pairs(spark, sf)))


@register("classification_report", O.with_ctes(
    EMB_CTES + ["m_pairs AS (SELECT label, pred_id AS pred FROM e_pred WHERE split = 'test')"] + _METRIC_CTES, (
        "SELECT CAST(cls AS VARCHAR) AS row_name, round(precision, 6) AS precision, round(recall, 6) AS recall, "
        "round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM m_f UNION ALL "
        "SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM m_f UNION ALL "
        "SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), "
        "round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m_f UNION ALL "
        "SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m_f")))
def q_classification_report(spark, sf):
    d = cl.classification_report(_test_pairs(spark, sf))
    return d.select("row_name", r6("precision").alias("precision"), r6("recall").alias("recall"),
                    r6("f1").alias("f1"), "support")


@register("majority_baseline", O.with_ctes(
    EMB_CTES + [
        "m_major AS (SELECT label FROM e_split WHERE split = 'train' GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)",
        "m_pairs AS (SELECT s.label, (SELECT label FROM m_major) AS pred FROM e_split s WHERE s.split = 'test')",
    ] + _METRIC_CTES, _SUMMARY))
def q_majority_baseline(spark, sf):
    split = emb_split(spark, sf)
    maj = cl.majority_label(split.filter(F.col("split") == "train"))
    pairs = split.filter(F.col("split") == "test").select("label", F.lit(maj).cast("int").alias("pred"))
    return _summary(cl.accuracy_weighted_f1(pairs))


def _dedup_emb_sql(threshold=lx.SEMANTIC_DEDUP_THRESHOLD):
    return [
        "d_n AS (SELECT vec_id AS id, label AS lab, CAST(embedding AS DOUBLE[]) AS v, "
        "row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings)",
        f"d_nbr AS (SELECT b.lab, b.r, list(a.r) AS nbrs FROM d_n a JOIN d_n b ON a.lab = b.lab AND a.r < b.r "
        f"WHERE list_dot_product(a.v, b.v) >= {threshold} GROUP BY b.lab, b.r)",
        "d_o AS (SELECT n.lab, n.r, n.id, coalesce(x.nbrs, []::BIGINT[]) AS nbrs FROM d_n n LEFT JOIN d_nbr x ON x.lab = n.lab AND x.r = n.r)",
        "d_walk AS (SELECT lab, r, [r] AS kept FROM d_o WHERE r = 1 UNION ALL SELECT w.lab, o.r, CASE WHEN list_has_any(w.kept, o.nbrs) "
        "THEN w.kept ELSE list_append(w.kept, o.r) END FROM d_walk w JOIN d_o o ON o.lab = w.lab AND o.r = w.r + 1)",
        "d_kept AS (SELECT lab, unnest(arg_max(kept, r)) AS r FROM d_walk GROUP BY lab)",
    ]


@register("semantic_dedup_embedding", O.with_ctes(_dedup_emb_sql(), (
    "SELECT n.id AS vec_id, n.lab AS label FROM d_n n JOIN d_kept k ON k.lab = n.lab AND k.r = n.r")))
def q_semantic_dedup_embedding(spark, sf):
    d = dd.semantic_dedup_embedding(embeddings(spark, sf), ["label"], "vec_id", "vec_id")
    return d.select("vec_id", "label")


_KNN_SQL = (
    "k_d AS (SELECT q.vec_id AS query_id, c.vec_id AS clause_id, "
    "list_sum(list_transform(list_zip(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance "
    "FROM e_split q JOIN e_split c ON q.split = 'test' AND c.split = 'train')",
    "k_r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, clause_id) AS rank FROM k_d)",
)


def _knn(spark, sf):
    from clauseflow.operators import retrieve as rv
    split = dd._ckpt(emb_split(spark, sf))
    q = split.filter(F.col("split") == "test").select(F.col("vec_id").alias("query_id"), "embedding")
    c = split.filter(F.col("split") == "train").select(F.col("vec_id").alias("clause_id"), "embedding")
    return rv.knn_exact(q, c, lx.RETRIEVAL_K)


@register("knn_exact", O.with_ctes(EMB_CTES + list(_KNN_SQL), (
    f"SELECT query_id, CAST(rank AS INTEGER) AS rank, clause_id, round(distance, 6) AS distance FROM k_r WHERE rank <= {lx.RETRIEVAL_K}")))
def q_knn_exact(spark, sf):
    d = _knn(spark, sf)
    return d.select("query_id", F.col("rank").cast("int").alias("rank"), "clause_id", r6("distance").alias("distance"))


@register("retrieval_hits", O.with_ctes(EMB_CTES + list(_KNN_SQL), (
    f"SELECT q.vec_id AS query_id, coalesce(h.hit_ids, '') AS hit_ids, coalesce(h.hit_labels, '') AS hit_labels, "
    f"CAST(coalesce(h.n_hits, 0) AS INTEGER) AS n_hits FROM e_split q LEFT JOIN (SELECT k.query_id, "
    f"string_agg(CAST(k.clause_id AS VARCHAR), '|' ORDER BY k.rank) AS hit_ids, "
    f"string_agg(CAST(c.label AS VARCHAR), '|' ORDER BY k.rank) AS hit_labels, count(*) AS n_hits "
    f"FROM k_r k JOIN e_split c ON c.vec_id = k.clause_id WHERE k.rank <= {lx.RETRIEVAL_K} GROUP BY k.query_id) h "
    "ON h.query_id = q.vec_id")))
def q_retrieval_hits(spark, sf):
    from clauseflow.operators import retrieve as rv
    split = emb_split(spark, sf)
    hits = _knn(spark, sf)
    meta = split.select(F.col("vec_id").alias("clause_id"), F.col("label").alias("hit_label"))
    out = rv.assemble_hits(split.select(F.col("vec_id").alias("query_id")), hits, meta)
    return out.select("query_id",
                      F.array_join(F.transform("hits", lambda h: h["clause_id"].cast("string")), "|").alias("hit_ids"),
                      F.array_join(F.transform("hits", lambda h: h["hit_label"].cast("string")), "|").alias("hit_labels"),
                      F.size("hits").cast("int").alias("n_hits"))


@register("correctness_band", O.with_ctes(EMB_CTES + [
    "c_all AS (SELECT label AS label_id, pos, avg(CAST(v AS DOUBLE)) AS w FROM (SELECT label, unnest(embedding) AS v, "
    "unnest(generate_series(1, len(embedding))) AS pos FROM embeddings) GROUP BY label, pos)",
    "c_head AS (SELECT label_id, list(w ORDER BY pos) AS wv FROM c_all GROUP BY label_id)",
    "c_sim AS (SELECT e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), h.wv) AS sim FROM embeddings e "
    "JOIN c_head h ON h.label_id = e.label)",
], (
    "SELECT vec_id, round(sim, 6) AS similarity, CASE WHEN sim > 0.90 THEN 5 WHEN sim >= 0.85 THEN 4 WHEN sim >= 0.75 THEN 3 "
    "WHEN sim >= 0.65 THEN 2 ELSE 1 END AS correctness FROM c_sim")))
def q_correctness_band(spark, sf):
    from clauseflow.operators import evaluate as ev
    e = embeddings(spark, sf)
    cent = (e.select("label", F.posexplode("embedding").alias("pos", "v")).groupBy("label", "pos")
            .agg(F.avg(F.col("v").cast("double")).alias("w"))
            .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "w"))).alias("ws"))
            .select("label", F.transform("ws", lambda s: s["w"]).alias("centroid")))
    from clauseflow.session import broadcast_if_small
    d = e.join(broadcast_if_small(cent, 100_000), "label")   # one row per label, size checked
    sim = ev.cosine(F.col("embedding"), F.col("centroid"))
    return d.select("vec_id", r6(sim).alias("similarity"), ev.correctness_band(sim).alias("correctness"))


# =============================================================================================
# Training set (P6): QA flatten, label extraction, filters, keep-first dedup, encoding, counts
# =============================================================================================
def qa_docs(spark, sf):
    return fx.fx_qa(spark, sf)


def training_set(spark, sf):
    return P.build_training_set(qa_docs(spark, sf), keep=["conv_id"])


_LBL = O.L(lx.LABELS)
QA_CTES = [
    "qa_c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, "
    "CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS q_idx, "
    f"{_LBL}[(conv_id * 3 + turn * 5) % 41 + 1] AS lab FROM conversations)",
    "qa_q AS (SELECT conv_id, q_idx, CASE WHEN (conv_id + turn) % 7 = 0 THEN 'Mark any text about ' || lab || ' here.' "
    "ELSE 'Mark the parts (if any) of this contract about \"' || upper(lab) || '\" that a reviewer should see.' END AS question, "
    "[text, coalesce(prev, text), '', 'Too short to keep here'] AS answers FROM qa_c)",
    "qa_flat AS (SELECT conv_id, CAST(0 AS INTEGER) AS d_idx, CAST(0 AS INTEGER) AS p_idx, q_idx, "
    "CAST(unnest(generate_series(0, 3)) AS INTEGER) AS a_idx, question, unnest(answers) AS answer FROM qa_q)",
    "qa_lab AS (SELECT *, regexp_matches(question, '\"([^\"]+)\"') AS has_q, "
    f"lower({O.STRIP(chr(34).join(['regexp_extract(question, ' + chr(39), '([^', ']+)', chr(39) + ', 1)']))}) AS label FROM qa_flat)",
    f"qa_norm AS (SELECT *, {O.CLEAN(chr(39).join(['regexp_replace(answer, ', '<[^>]+>', ', ', ' ', ', ', 'g', ')']))} AS ntext "
    "FROM qa_lab WHERE has_q AND answer IS NOT NULL AND answer <> '')",
    f"qa_len AS (SELECT *, {O.WC('ntext')} AS n_words, CAST(length(ntext) AS INTEGER) AS n_chars FROM qa_norm)",
    f"qa_keep AS (SELECT * FROM qa_len WHERE ntext <> '' AND n_words >= {lx.TRAIN_MIN_WORDS} "
    f"AND n_chars BETWEEN {lx.TRAIN_MIN_CHARS} AND {lx.TRAIN_MAX_CHARS})",
    "qa_train AS (SELECT ntext AS text, label, conv_id, d_idx, p_idx, q_idx, a_idx FROM (SELECT *, row_number() OVER "
    "(PARTITION BY ntext, label ORDER BY conv_id, d_idx, p_idx, q_idx, a_idx) AS rn FROM qa_keep) WHERE rn = 1)",
]


@register("qa_flatten", O.with_ctes(QA_CTES, "SELECT conv_id, d_idx, p_idx, q_idx, a_idx, question, answer FROM qa_flat"))
def q_qa_flatten(spark, sf):
    from clauseflow.sources import readers as rd
    return rd.flatten_qa(qa_docs(spark, sf), ["conv_id"])


@register("quoted_label_extract", O.with_ctes(QA_CTES, (
    "SELECT conv_id, q_idx, has_q AS has_quotes, label FROM qa_lab WHERE a_idx = 0")))
def q_quoted_label_extract(spark, sf):
    from clauseflow.sources import readers as rd
    d = rd.flatten_qa(qa_docs(spark, sf), ["conv_id"]).filter("a_idx = 0")
    return d.select("conv_id", "q_idx", tc.has_quoted(F.col("question")).alias("has_quotes"),
                    tc.quoted_label(F.col("question")).alias("label"))


@register("training_clause_filter", O.with_ctes(QA_CTES, (
    f"SELECT conv_id, q_idx, a_idx, n_words, n_chars, (ntext <> '' AND n_words >= {lx.TRAIN_MIN_WORDS} "
    f"AND n_chars BETWEEN {lx.TRAIN_MIN_CHARS} AND {lx.TRAIN_MAX_CHARS}) AS keep FROM qa_len")))
def q_training_clause_filter(spark, sf):
    from clauseflow.sources import readers as rd
    d = rd.flatten_qa(qa_docs(spark, sf), ["conv_id"])
    d = d.filter(tc.has_quoted(F.col("question")) & F.col("answer").isNotNull() & (F.col("answer") != ""))
    d = tc.normalize_clause_text(d, "answer", "text")
    d = d.withColumn("n_words", tc.word_count("text")).withColumn("n_chars", F.length("text"))
    keep = ((F.col("text") != "") & (F.col("n_words") >= lx.TRAIN_MIN_WORDS)
            & F.col("n_chars").between(lx.TRAIN_MIN_CHARS, lx.TRAIN_MAX_CHARS))
    return d.select("conv_id", "q_idx", "a_idx", "n_words", "n_chars", keep.alias("keep"))


@register("exact_dedup", O.with_ctes(QA_CTES, "SELECT text, label, conv_id, q_idx, a_idx FROM qa_train"))
def q_exact_dedup(spark, sf):
    return training_set(spark, sf).select("text", "label", "conv_id", "q_idx", "a_idx")


@register("label_encode", O.with_ctes(QA_CTES, (
    "SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id FROM (SELECT DISTINCT label FROM qa_train)")))
def q_label_encode(spark, sf):
    return cl.label_encode(training_set(spark, sf).select("label").distinct())


@register("label_top10", O.with_ctes(QA_CTES + [
    "lt AS (SELECT label, count(*) AS n, min(conv_id * 100000 + q_idx * 10 + a_idx) AS first_pos FROM qa_train GROUP BY label)",
], "SELECT label, n, CAST(rank AS INTEGER) AS rank FROM (SELECT label, n, row_number() OVER (ORDER BY n DESC, first_pos) AS rank FROM lt) WHERE rank <= 10"))
def q_label_top10(spark, sf):
    from clauseflow.operators import report as rp
    t = training_set(spark, sf).withColumn("_pos", F.struct("conv_id", "d_idx", "p_idx", "q_idx", "a_idx"))
    return rp.top_labels(t, 10, "label", "_pos")


@register("training_summary", O.with_ctes(QA_CTES, (
    "SELECT count(*) AS n_rows, count(DISTINCT label) AS n_labels FROM qa_train")))
def q_training_summary(spark, sf):
    return training_set(spark, sf).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("label").alias("n_labels"))


# =============================================================================================
# Corpus (P5): provisions parse, clean + length filter, deterministic sample
# =============================================================================================
PROV_CTES = [
    "pv AS (SELECT doc_id AS line_no, CASE WHEN doc_id % 50 = 7 THEN '{\"provision\": \"' || left(source, 5) "
    "WHEN doc_id % 50 = 9 THEN to_json({'provision': NULL::VARCHAR, 'source': source, 'label': [lang]})::VARCHAR "
    "WHEN doc_id % 50 = 11 THEN to_json({'provision': doc_id, 'source': source, 'label': [lang]})::VARCHAR "
    "WHEN doc_id % 50 = 13 THEN to_json({'provision': text, 'source': source, 'label': lang})::VARCHAR "
    "ELSE to_json({'provision': text, 'source': source, 'label': [lang]})::VARCHAR END AS value FROM documents)",
    "pv_v AS (SELECT line_no, CASE WHEN json_valid(value) THEN value END AS js FROM pv)",
    "pv_p AS (SELECT line_no, js IS NOT NULL AND coalesce(json_type(js, '$.provision') = 'VARCHAR', false) AS ok, js FROM pv_v)",
    "pv_f AS (SELECT line_no, ok, CASE WHEN ok THEN json_extract_string(js, '$.provision') END AS provision, "
    "CASE WHEN ok THEN coalesce(json_extract_string(js, '$.source'), '') END AS source, "
    "CASE WHEN ok AND json_type(js, '$.label') = 'ARRAY' THEN coalesce(array_to_string(from_json(json_extract(js, '$.label'), '[\"VARCHAR\"]'), '|'), '') "
    "WHEN ok AND json_type(js, '$.label') = 'VARCHAR' THEN json_extract_string(js, '$.label') WHEN ok THEN '' END AS label FROM pv_p)",
    f"pv_c AS (SELECT line_no AS clause_id, {O.CLEAN('provision')} AS clause, source, label FROM pv_f WHERE ok)",
    f"corpus AS (SELECT clause_id, clause, source, label, {O.WC('clause')} AS n_words FROM pv_c "
    f"WHERE {O.WC('clause')} BETWEEN {lx.CORPUS_MIN_WORDS} AND {lx.CORPUS_MAX_WORDS})",
]


def provisions(spark, sf):
    from clauseflow.sources import readers as rd
    return rd.parse_provision_lines(fx.fx_provisions(spark, sf))


def corpus(spark, sf):
    return P.build_corpus(P.spread(fx.fx_provisions(spark, sf)))


@register("provision_parse", O.with_ctes(PROV_CTES, (
    f"SELECT line_no, ok, source, label, CASE WHEN ok THEN {O.WC(O.CLEAN('provision'))} END AS n_words FROM pv_f")))
def q_provision_parse(spark, sf):
    d = provisions(spark, sf)
    return d.select("line_no", "ok", F.when(F.col("ok"), F.col("source")).alias("source"),
                    F.when(F.col("ok"), F.array_join("label", "|")).alias("label"),
                    F.when(F.col("ok"), tc.word_count(tc.clean_text("provision"))).alias("n_words"))


@register("corpus_length_filter", O.with_ctes(PROV_CTES, "SELECT * FROM corpus"))
def q_corpus_length_filter(spark, sf):
    return corpus(spark, sf).withColumn("label", F.array_join("label", "|"))


@register("deterministic_sample", O.with_ctes(PROV_CTES, (
    f"SELECT clause_id, clause FROM corpus ORDER BY md5('42|' || CAST(clause_id AS VARCHAR)), clause_id LIMIT {lx.CORPUS_SAMPLE_SIZE}")))
def q_deterministic_sample(spark, sf):
    from clauseflow.operators import retrieve as rv
    return rv.deterministic_sample(corpus(spark, sf), "clause_id").select("clause_id", "clause")


@register("sample_preview", O.with_ctes(QA_CTES, (
    "SELECT text, label FROM qa_train ORDER BY md5('42|' || label || '|' || text), label, text LIMIT 5")))
def q_sample_preview(spark, sf):
    from clauseflow.operators import retrieve as rv
    t = training_set(spark, sf).withColumn("_k", F.concat(F.col("label"), F.lit("|"), F.col("text")))
    return rv.deterministic_sample(t, "_k", 5).select("text", "label")


# =============================================================================================
# Admission
# =============================================================================================
def uploads(spark, sf):
    d = fx.read_table(spark, sf, "documents")
    ext = (F.when(F.col("lang") == "en", ".txt").when(F.col("lang") == "fr", ".DOCX")
           .when(F.col("lang") == "de", ".pdf").otherwise(".rtf"))
    return d.select("doc_id", F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), ext).alias("filename"),
                    F.when(F.col("lang") == "de", F.col("text")).otherwise(F.lit("")).alias("form_text"),
                    F.octet_length("text").cast("long").alias("n_bytes"), F.col("text").alias("file_text"))


@register("admission_check", O.with_ctes([
    "up AS (SELECT doc_id, source || '_' || CAST(doc_id AS VARCHAR) || CASE lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.DOCX' "
    "WHEN 'de' THEN '.pdf' ELSE '.rtf' END AS filename, CASE WHEN lang = 'de' THEN text ELSE '' END AS form_text, "
    "CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, text AS file_text FROM documents)",
    "up2 AS (SELECT *, lower(regexp_extract(filename, '(\\.[^./]+)$', 1)) AS ext, " + O.STRIP("form_text") + " AS pasted FROM up)",
], (
    "SELECT doc_id, ext, CASE WHEN pasted <> '' THEN 'text' WHEN ext NOT IN ('.pdf', '.docx', '.txt') OR n_bytes = 0 "
    f"OR n_bytes > {lx.MAX_UPLOAD_BYTES} THEN NULL WHEN ext = '.txt' THEN 'txt' ELSE substr(ext, 2) END AS route, "
    "CASE WHEN pasted <> '' THEN NULL WHEN ext NOT IN ('.pdf', '.docx', '.txt') THEN 'unsupported_format' "
    f"WHEN n_bytes = 0 THEN 'empty_file' WHEN n_bytes > {lx.MAX_UPLOAD_BYTES} THEN 'too_large' "
    f"WHEN ext = '.txt' AND {O.STRIP('file_text')} = '' THEN 'no_text' END AS reject_reason, "
    "CAST(length(CASE WHEN pasted <> '' THEN pasted WHEN ext = '.txt' AND n_bytes > 0 THEN file_text END) AS INTEGER) AS n_chars FROM up2")))
def q_admission_check(spark, sf):
    from clauseflow.sources import readers as rd
    d = rd.admission(uploads(spark, sf))
    return d.select("doc_id", "ext", "route", "reject_reason", F.length("analysis_text").cast("int").alias("n_chars"))


# =============================================================================================
# Rewrite scoring (E2-E4, K7) over derived rewrites: original = a clause, rewrite = the next one
# =============================================================================================
def rewrites(spark, sf):
    c = dd._ckpt(clauses(spark, sf))  # both sides read it
    nxt = c.select("contract_id", (F.col("clause_idx") - 1).alias("clause_idx"), F.col("text").alias("rewritten"))
    r = c.select("contract_id", "clause_idx", F.col("text").alias("original"))
    r = sort_join(r, nxt, ["contract_id", "clause_idx"], "left")
    k = F.col("contract_id") + F.col("clause_idx")
    scores = F.struct(F.lit(None).cast("int").alias("correctness"), F.lit(None).cast("int").alias("fairness"),
                      F.when(k % 3 == 0, (k % 5 + 1).cast("int")).alias("clarity"))
    return r.withColumn("scores", scores)


RW_CTES = BASE + [
    "rw AS (SELECT a.contract_id, a.clause_idx, a.text AS original, b.text AS rewritten, "
    "CASE WHEN (a.contract_id + a.clause_idx) % 3 = 0 THEN CAST((a.contract_id + a.clause_idx) % 5 + 1 AS INTEGER) END AS clarity "
    "FROM fx_clauses a LEFT JOIN fx_clauses b ON b.contract_id = a.contract_id AND b.clause_idx = a.clause_idx + 1)",
    f"rw_s AS (SELECT *, {O.STRIP('coalesce(original, ' + chr(39) * 2 + ')')} <> '' AND {O.STRIP('coalesce(rewritten, ' + chr(39) * 2 + ')')} <> '' AS processed, "
    f"CAST({O.NHITS('lower(original)', lx.FAIRNESS_HARMFUL_PHRASES)} AS INTEGER) AS n_harmful, "
    f"CAST({O.NHITS('lower(rewritten)', lx.FAIRNESS_BALANCED_PHRASES)} AS INTEGER) AS n_balanced FROM rw)",
    "rw_f AS (SELECT *, n_balanced - n_harmful AS delta, CASE WHEN n_balanced - n_harmful >= 2 THEN 5 WHEN n_balanced - n_harmful = 1 THEN 4 "
    "WHEN n_balanced - n_harmful = 0 THEN 3 WHEN n_balanced - n_harmful = -1 THEN 2 ELSE 1 END AS fairness FROM rw_s)",
]


@register("fairness_band", O.with_ctes(RW_CTES, (
    "SELECT contract_id, clause_idx, n_harmful, n_balanced, delta, fairness FROM rw_f WHERE processed")))
def q_fairness_band(spark, sf):
    from clauseflow.operators import evaluate as ev
    r = rewrites(spark, sf).filter(F.col("rewritten").isNotNull())
    h = tc.count_phrases(F.lower("original"), lx.FAIRNESS_HARMFUL_PHRASES)
    b = tc.count_phrases(F.lower("rewritten"), lx.FAIRNESS_BALANCED_PHRASES)
    d = ev.fairness_delta(F.col("original"), F.col("rewritten"))
    return r.select("contract_id", "clause_idx", h.alias("n_harmful"), b.alias("n_balanced"), d.alias("delta"),
                    ev.fairness_band(d).alias("fairness"))


@register("rewrite_scores", O.with_ctes(RW_CTES, (
    "SELECT contract_id, clause_idx, processed, CASE WHEN processed THEN 1 END AS correctness, "
    "CASE WHEN processed THEN fairness END AS fairness, clarity FROM rw_f")))
def q_rewrite_scores(spark, sf):
    from clauseflow.operators import evaluate as ev
    s = ev.score_rewrites(rewrites(spark, sf))
    return s.select("contract_id", "clause_idx", "processed", F.col("scores.correctness").alias("correctness"),
                    F.col("scores.fairness").alias("fairness"), F.col("scores.clarity").alias("clarity"))


@register("rewrite_score_summary", O.with_ctes(RW_CTES, (
    "SELECT count(*) AS processed, round(avg(1), 6) AS avg_correctness, round(avg(fairness), 6) AS avg_fairness "
    "FROM rw_f WHERE processed")))
def q_rewrite_score_summary(spark, sf):
    from clauseflow.operators import evaluate as ev
    s = ev.rewrite_summary(ev.score_rewrites(rewrites(spark, sf)))
    return s.select("processed", r6("avg_correctness").alias("avg_correctness"), r6("avg_fairness").alias("avg_fairness"))


# =============================================================================================
# Text normalisation on the raw tables
# =============================================================================================
@register("text_normalize_html", (
    "SELECT page_id, " + O.CLEAN("regexp_replace(html, '<[^>]+>', ' ', 'g')") + " AS clean_text FROM pages"))
def q_text_normalize_html(spark, sf):
    p = fx.read_table(spark, sf, "pages").select("page_id", "html")
    return tc.normalize_clause_text(p, "html", "clean_text").select("page_id", "clean_text")


@register("text_normalize_similarity", f"SELECT doc_id, {O.SIMNORM('text')} AS norm_text FROM documents")
def q_text_normalize_similarity(spark, sf):
    d = fx.read_table(spark, sf, "documents")
    return d.select("doc_id", tc.similarity_norm(F.col("text")).alias("norm_text"))


@register("word_char_counts", (
    f"SELECT doc_id, {O.WC('text')} AS n_words, CAST(length(text) AS INTEGER) AS n_chars, "
    f"CAST(length({O.CLEAN('text')}) AS INTEGER) AS clean_chars FROM documents"))
def q_word_char_counts(spark, sf):
    d = fx.read_table(spark, sf, "documents")
    return d.select("doc_id", tc.word_count("text").alias("n_words"), F.length("text").alias("n_chars"),
                    F.length(tc.clean_text("text")).alias("clean_chars"))


# =============================================================================================
# Reports (A5, A6, A7)
# =============================================================================================
TOP20_CTES = O.important_ctes() + O.dedup_ctes("fx_imp", IMP_ORDER_SQL, "fx_kept") + [
    f"top20 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY {IMP_ORDER_SQL}) AS rank "
    f"FROM fx_kept) WHERE rank <= {lx.TOP_CLAUSES_PER_CONTRACT})"]


@register("contract_report", O.with_ctes(
    BASE + TOP20_CTES + O.one_sided_ctes() + O.dedup_ctes("fx_os", "bias_score DESC, confidence DESC, clause_idx", "fx_okept"),
    "SELECT c.contract_id, CAST(length(c.text) AS INTEGER) AS text_chars, coalesce(a.n, 0) AS n_clauses, "
    "coalesce(b.n, 0) AS important_count, coalesce(b.nl, 0) AS important_labels, coalesce(d.n, 0) AS one_sided_count "
    "FROM fx_contracts c LEFT JOIN (SELECT contract_id, count(*) AS n FROM fx_clauses GROUP BY 1) a USING (contract_id) "
    "LEFT JOIN (SELECT contract_id, count(*) AS n, count(DISTINCT label) AS nl FROM top20 GROUP BY 1) b USING (contract_id) "
    "LEFT JOIN (SELECT contract_id, count(*) AS n FROM fx_okept GROUP BY 1) d USING (contract_id)"))
def q_contract_report(spark, sf):
    from clauseflow.operators import report as rp
    c = contracts(spark, sf)
    cls = dd._ckpt(sg.split_into_clauses(c))
    pred = fx.rule_classifier(cls)
    imp = rk.top_n_per_contract(P.important_clauses(pred), rk.important_order())
    ones = P.one_sided_high_risk(pred)
    return rp.contract_report(c, cls, imp, ones)


@register("contract_report_grouped", O.with_ctes(BASE + TOP20_CTES, (
    "SELECT contract_id, label, CAST(count(*) AS INTEGER) AS n_clauses, "
    "string_agg(CAST(clause_idx AS VARCHAR), '|' ORDER BY clause_idx) AS clause_ids FROM top20 GROUP BY contract_id, label")))
def q_contract_report_grouped(spark, sf):
    from clauseflow.operators import report as rp
    g = rp.grouped_important(P.review_contracts(contracts(spark, sf), fx.rule_classifier))
    e = g.select("contract_id", F.explode("important_clauses_grouped").alias("label", "clauses"))
    return e.select("contract_id", "label", F.size("clauses").cast("int").alias("n_clauses"),
                    F.array_join(F.transform("clauses", lambda c: c["clause_idx"].cast("string")), "|").alias("clause_ids"))


@register("risk_rollup", O.with_ctes(BASE + [f"rl AS ({O.risk_select('fx_pred')})"], (
    "SELECT risk, label, count(*) AS n, CAST(GROUPING(risk, label) AS INTEGER) AS gid FROM rl GROUP BY ROLLUP (risk, label)")))
def q_risk_rollup(spark, sf):
    from clauseflow.operators import report as rp
    return rp.risk_rollup(rk.with_risk(predictions(spark, sf)))


# =============================================================================================
# Review assembly (V2 encoder + V3 over the corpus, W1-W3, W5, W7)
# =============================================================================================
def _vec_sql(text: str) -> str:
    toks = O.UNIGRAMS(O.SIMNORM(text))
    buckets = f"list_transform({toks}, lambda t: ('0x' || substr(md5(t), 1, 6))::BIGINT % 64)"
    counts = f"list_transform(range(0, 64), lambda b: CAST(len(list_filter({buckets}, lambda x: x = b)) AS DOUBLE))"
    return f"{counts}"


REVIEW_CTES = BASE + TOP20_CTES + PROV_CTES + [
    f"rq0 AS MATERIALIZED (SELECT contract_id, clause_idx, text, label, contract_id * 100000 + clause_idx AS qid, {_vec_sql('text')} AS cnt FROM top20)",
    "rq AS MATERIALIZED (SELECT *, CASE WHEN sqrt(list_sum(list_transform(cnt, lambda v: v * v))) > 0 THEN "
    "list_transform(cnt, lambda v: v / sqrt(list_sum(list_transform(cnt, lambda w: w * w)))) ELSE cnt END AS v FROM rq0)",
    f"cv0 AS MATERIALIZED (SELECT clause_id, clause, label AS lab_str, {_vec_sql('clause')} AS cnt FROM corpus)",
    "cv AS MATERIALIZED (SELECT *, CASE WHEN sqrt(list_sum(list_transform(cnt, lambda v: v * v))) > 0 THEN "
    "list_transform(cnt, lambda v: v / sqrt(list_sum(list_transform(cnt, lambda w: w * w)))) ELSE cnt END AS v FROM cv0)",
    "kd AS MATERIALIZED (SELECT q.qid, c.clause_id, round(list_sum(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS d "
    "FROM rq q CROSS JOIN cv c)",
    f"kr AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, clause_id) AS rank FROM kd) WHERE rank <= {lx.RETRIEVAL_K})",
    "refs AS (SELECT kr.qid, string_agg(chr(10) || CAST(kr.rank AS VARCHAR) || '. \"' || cv.clause || '\"' || chr(10) || '   (Label: ' "
    "|| replace(cv.lab_str, '|', ', ') || ')' || chr(10), '' ORDER BY kr.rank) AS refs, count(*) AS n FROM kr JOIN cv USING (clause_id) GROUP BY kr.qid)",
]


def _review_inputs(spark, sf):
    from clauseflow.operators import retrieve as rv
    top = dd._ckpt(P.review_contracts(contracts(spark, sf), fx.rule_classifier))
    q = rv.with_hashed_vector(top, "text").select(
        (F.col("contract_id") * 100000 + F.col("clause_idx")).alias("query_id"), "embedding", "contract_id", "clause_idx")
    corp = dd._ckpt(rv.with_hashed_vector(corpus(spark, sf), "clause"))
    hits = rv.knn_exact(q, corp, lx.RETRIEVAL_K, vec="embedding", round_decimals=9)
    packed = rv.assemble_hits(q.select("query_id"), hits, corp.select("clause_id", "clause", "label"))
    packed = sort_join(packed, q.select("query_id", "contract_id", "clause_idx"), "query_id").drop("query_id")
    return top, packed


def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@register("rewrite_requests", O.with_ctes(REVIEW_CTES, (
    "SELECT t.contract_id, t.clause_idx, CAST(coalesce(r.n, 0) AS INTEGER) AS n_refs, md5(coalesce(r.refs, '')) AS refs_md5, "
    "CAST(length(" + _sql_lit(rw.REWRITE_INSTRUCTION)
    + " || chr(10) || chr(10) || 'Original Clause:' || chr(10) || t.text || chr(10) || chr(10) || 'Similar Reference Clauses:' || chr(10) "
    "|| coalesce(r.refs, '') || chr(10) || chr(10) || 'Rewritten Clause:' || chr(10)) AS INTEGER) AS request_chars "
    "FROM rq t LEFT JOIN refs r ON r.qid = t.qid")))
def q_rewrite_requests(spark, sf):
    top, packed = _review_inputs(spark, sf)
    d = sort_join(top, packed, ["contract_id", "clause_idx"], "left")
    d = d.withColumn("hits", F.coalesce("hits", F.array().cast(packed.schema["hits"].dataType)))
    return d.select("contract_id", "clause_idx", F.size("hits").cast("int").alias("n_refs"),
                    F.md5(rw.reference_block(F.col("hits"))).alias("refs_md5"),
                    F.length(rw.rewrite_request(F.col("text"), F.col("hits"))).cast("int").alias("request_chars"))


@register("explain_requests", O.with_ctes(BASE + TOP20_CTES, (
    "SELECT contract_id, clause_idx, md5(" + _sql_lit(rw.EXPLAIN_INSTRUCTION)
    + " || chr(10) || chr(10) || 'Clause Type: ' || label || chr(10) || chr(10) || 'Original Clause:' || chr(10) || '\"' || text || '\"' "
    "|| chr(10) || chr(10) || 'Rewritten Clause:' || chr(10) || '\"' || '' || '\"' || chr(10) || chr(10) || 'Changes:') AS explain_md5 FROM top20")))
def q_explain_requests(spark, sf):
    top = P.review_contracts(contracts(spark, sf), fx.rule_classifier)
    return top.select("contract_id", "clause_idx",
                      F.md5(rw.explain_request(F.col("text"), F.lit(""), F.col("label"))).alias("explain_md5"))


@register("review_sheet", O.with_ctes(REVIEW_CTES, (
    "SELECT t.contract_id, t.clause_idx, t.label AS clause_type, CAST(coalesce(h.n, 0) AS INTEGER) AS n_similar, "
    "coalesce(h.prefixes, '') AS similar_clauses_used FROM rq t LEFT JOIN (SELECT kr.qid, count(*) AS n, "
    "string_agg(left(cv.clause, 150), '|' ORDER BY kr.rank) AS prefixes FROM kr JOIN cv USING (clause_id) GROUP BY kr.qid) h "
    "ON h.qid = t.qid")))
def q_review_sheet(spark, sf):
    top, packed = _review_inputs(spark, sf)
    sheet = rw.review_sheet(rw.build_review(top, packed, completer=None))
    return sheet.select("contract_id", "clause_idx", "clause_type",
                        F.size("similar_clauses_used").cast("int").alias("n_similar"),
                        F.array_join("similar_clauses_used", "|").alias("similar_clauses_used"))


@register("review_status", O.with_ctes(BASE + TOP20_CTES, (
    "SELECT contract_id, count(*) AS n_clauses, 'missing_api_token' AS status FROM top20 GROUP BY contract_id")))
def q_review_status(spark, sf):
    top, packed = _review_inputs(spark, sf)
    review = rw.build_review(top, packed, completer=None)
    return review.groupBy("contract_id").agg(F.count(F.lit(1)).alias("n_clauses"), F.max(F.struct(F.when(F.col("status") == "completed", 0).otherwise(1), "status"))["status"].alias("status"))


# =============================================================================================
# Rows-only checks (no SQL formulation: model fitting, approximate search, NFKC, streaming)
# =============================================================================================
@register("classify_ml")
def q_classify_ml(spark, sf):
    t = dd._ckpt(cl.label_encode(training_set(spark, sf)))
    t = cl.stratified_split(t, F.concat(F.col("label"), F.lit("|"), F.col("text")), label="label")
    model = cl.fit_text_classifier(t.filter("split = 'train'"))
    pred = model.transform(t.filter("split = 'test'").withColumn("label_id", F.col("label_id").cast("double")))
    return pred.select("text", F.col("label_id").cast("int").alias("label_id"),
                       F.col("prediction").cast("int").alias("pred_id"))


@register("knn_cells")
def q_knn_cells(spark, sf):
    from clauseflow.operators import retrieve as rv
    split = dd._ckpt(emb_split(spark, sf))
    q = split.filter(F.col("split") == "test").select(F.col("vec_id").alias("query_id"), "embedding")
    c = split.filter(F.col("split") == "train").select(F.col("vec_id").alias("clause_id"), "embedding")
    return rv.knn_cells(q, c, lx.RETRIEVAL_K).select("query_id", "rank", "clause_id", r6("distance").alias("distance"))


@register("knn_codes")
def q_knn_codes(spark, sf):
    from clauseflow.operators import retrieve as rv
    split = dd._ckpt(emb_split(spark, sf))
    q = split.filter(F.col("split") == "test").select(F.col("vec_id").alias("query_id"), "embedding")
    c = split.filter(F.col("split") == "train").select(F.col("vec_id").alias("clause_id"), "embedding")
    return rv.knn_codes(q, c, lx.RETRIEVAL_K).select("query_id", "rank", "clause_id", r6("distance").alias("distance"))


@register("nfkc_normalize")
def q_nfkc_normalize(spark, sf):
    c = fx.read_table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return tc.with_nfkc(c, "text", "text_nfkc").select("conv_id", "turn", "text_nfkc")


@register("stream_review")
def q_stream_review(spark, sf):
    from clauseflow.streaming import stream as st
    out = st.run_review_stream(spark, sf, fx.contracts_from_documents, fx.rule_classifier)
    return out.select("contract_id", "clause_idx", "label", "risk", r6("confidence").alias("confidence"), "rank")


# =============================================================================================
# Dedup by embeddings (D3/D4), label map (S9), incremental training rows (J8), report rows (A5),
# sinks read back by their readers
# =============================================================================================
@register("important_clauses_embedding", O.with_ctes(BASE + O.important_ctes() + [
    "ie0 AS MATERIALIZED (SELECT contract_id, clause_idx, label, row_number() OVER (PARTITION BY contract_id, label "
    f"ORDER BY {IMP_ORDER_SQL}) AS r, {_vec_sql('text')} AS cnt FROM fx_imp)",
    "ie AS MATERIALIZED (SELECT *, list_transform(cnt, lambda v: v / sqrt(list_sum(list_transform(cnt, lambda w: w * w)))) AS v FROM ie0)",
    "ie_nbr AS (SELECT b.contract_id, b.label, b.r, list(a.r) AS nbrs FROM ie a JOIN ie b ON a.contract_id = b.contract_id AND a.label = b.label "
    f"AND a.r < b.r WHERE list_dot_product(a.v, b.v) >= {lx.SEMANTIC_DEDUP_THRESHOLD} GROUP BY ALL)",
    "ie_o AS (SELECT n.contract_id, n.label, n.r, coalesce(x.nbrs, []::BIGINT[]) AS nbrs FROM ie n LEFT JOIN ie_nbr x USING (contract_id, label, r))",
    "ie_walk AS (SELECT contract_id, label, r, [r] AS kept FROM ie_o WHERE r = 1 UNION ALL SELECT o.contract_id, o.label, o.r, "
    "CASE WHEN list_has_any(w.kept, o.nbrs) THEN w.kept ELSE list_append(w.kept, o.r) END FROM ie_walk w JOIN ie_o o "
    "ON o.contract_id = w.contract_id AND o.label = w.label AND o.r = w.r + 1)",
    "ie_kept AS (SELECT contract_id, label, unnest(arg_max(kept, r)) AS r FROM ie_walk GROUP BY contract_id, label)",
], "SELECT n.contract_id, n.clause_idx, n.label FROM ie n JOIN ie_kept k USING (contract_id, label, r)"))
def q_important_clauses_embedding(spark, sf):
    d = P.important_clauses(predictions(spark, sf), method="embedding")
    return d.select("contract_id", "clause_idx", "label")


@register("label_map_check", (
    "SELECT lang, CASE WHEN lang IN ('en', 'fr') THEN source END AS label, CASE WHEN lang = 'en' THEN CAST(count(*) AS INTEGER) END AS label_id, "
    "CASE lang WHEN 'en' THEN NULL WHEN 'fr' THEN 'id is no whole number' WHEN 'de' THEN 'not an object' ELSE 'no entries' END AS problem "
    "FROM documents GROUP BY lang, source QUALIFY lang IN ('en', 'fr') OR row_number() OVER (PARTITION BY lang) = 1"))
def q_label_map_check(spark, sf):
    from clauseflow.sources import readers as rd
    counts = fx.read_table(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).cast("int").alias("n"))
    entries = F.map_from_entries(F.collect_list(F.struct("source", "n")))
    texts = F.map_from_entries(F.collect_list(F.struct("source", F.col("n").cast("string").alias("n"))))
    maps = counts.groupBy("lang").agg(F.to_json(entries).alias("good"), F.to_json(texts).alias("quoted"))
    value = (F.when(F.col("lang") == "en", F.col("good")).when(F.col("lang") == "fr", F.col("quoted"))
             .when(F.col("lang") == "de", F.lit("[1]")).otherwise(F.lit("{}")))
    return rd.label_map_entries(maps.select("lang", value.alias("value")), ["lang"])


@register("unseen_training_rows", O.with_ctes(QA_CTES, (
    "SELECT DISTINCT ntext AS text, label FROM qa_keep n WHERE conv_id % 2 = 1 AND NOT EXISTS "
    "(SELECT 1 FROM qa_keep s WHERE s.conv_id % 2 = 0 AND s.ntext = n.ntext AND s.label = n.label)")))
def q_unseen_training_rows(spark, sf):
    seen, new = (P.build_training_set(qa_docs(spark, sf).filter(F.col("conv_id") % 2 == k), keep=["conv_id"]) for k in (0, 1))
    return dd.unseen(new, seen, ["text", "label"]).select("text", "label")


@register("contract_report_full", O.with_ctes(
    BASE + TOP20_CTES + O.one_sided_ctes() + O.dedup_ctes("fx_os", "bias_score DESC, confidence DESC, clause_idx", "fx_okept"),
    "SELECT c.contract_id, CAST(length(c.text) AS INTEGER) AS text_chars, coalesce(b.labels, '') AS labels, coalesce(d.one_sided, '') AS one_sided "
    "FROM fx_contracts c LEFT JOIN (SELECT contract_id, string_agg(DISTINCT label, '|' ORDER BY label) AS labels FROM top20 GROUP BY 1) b "
    "USING (contract_id) LEFT JOIN (SELECT contract_id, string_agg(CAST(clause_idx AS VARCHAR) || ':' || CAST(bias_score AS VARCHAR), '|' "
    "ORDER BY clause_idx) AS one_sided FROM fx_okept GROUP BY 1) d USING (contract_id)"))
def q_contract_report_full(spark, sf):
    from clauseflow.operators import report as rp
    c = contracts(spark, sf)
    pred = dd._ckpt(predictions(spark, sf))
    imp = rk.top_n_per_contract(P.important_clauses(pred), rk.important_order())
    d = rp.full_report(c, pred, imp, P.one_sided_high_risk(pred))
    pairs = F.transform("one_sided_high_risk_clauses", lambda x: F.concat_ws(":", x["clause_idx"].cast("string"), x["bias_score"].cast("string")))
    return d.select("contract_id", "text_chars", F.array_join(F.array_sort(F.map_keys("important_clauses_grouped")), "|").alias("labels"),
                    F.array_join(pairs, "|").alias("one_sided"))


def _folder(spark, name):
    import uuid

    from clauseflow.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("corpus_roundtrip", O.with_ctes(PROV_CTES, "SELECT clause, source, label FROM corpus"))
def q_corpus_roundtrip(spark, sf):
    from clauseflow.sources import readers as rd
    from clauseflow.sources import sinks as sk
    path = _folder(spark, "corpus-json")
    sk.write_corpus_json(corpus(spark, sf), path)
    return rd.read_corpus_json(spark, path).select("clause", "source", F.array_join("label", "|").alias("label"))


@register("scored_rewrites_roundtrip", O.with_ctes(RW_CTES, (
    "SELECT original, rewritten, CASE WHEN processed THEN 1 END AS correctness, CASE WHEN processed THEN fairness END AS fairness, clarity FROM rw_f")))
def q_scored_rewrites_roundtrip(spark, sf):
    from clauseflow.operators import evaluate as ev
    from clauseflow.sources import readers as rd
    from clauseflow.sources import sinks as sk
    path = _folder(spark, "scored-json")
    sk.write_scored_rewrites(ev.score_rewrites(rewrites(spark, sf)).drop("processed"), path)
    return rd.read_rewrites(spark, path).select("original", "rewritten", "scores.correctness", "scores.fairness", "scores.clarity")


from clauseflow.plans import registry_more  # noqa: E402,F401  registers its queries in the tables above
