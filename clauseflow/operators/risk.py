"""R1-R5 risk scoring, F3-F6 filters and L1-L3 ranking.

Everything is a narrow projection except the label-dimension lookup (a
broadcast of the fixed 41-row table) and the final top-n (a window group
limit).  Orders are carried as columns, never as a per-contract rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clauseflow.functions import lexicon as lx
from clauseflow.functions import textcols as tc


def _label_lookup(df: DataFrame, label_col: str = "_label_canon") -> DataFrame:
    dim = F.broadcast(lx.label_dim(df.sparkSession)
                      .select(F.col("label").alias(label_col), F.col("risk_tier").alias("_tier"),
                              F.col("description").alias("_desc")))
    return df.join(dim, on=label_col, how="left")


def with_risk(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Adds risk, risk_score, reason (phrases beat labels; see lexicon)."""
    d = df.withColumn("_label_canon", tc.canon_label(label))
    # lambdas re-evaluate expression arguments per element: pin the lowered text first
    d = tc.with_computed(d, {"_lw": F.lower(tc.strip_ws(F.coalesce(F.col(text), F.lit(""))))})
    d = tc.with_computed(d, {"_hi": tc.first_match("_lw", lx.HIGH_RISK_PHRASES),
                             "_med": tc.first_match("_lw", lx.MEDIUM_RISK_PHRASES)})
    d = _label_lookup(d)
    lab = F.col("_label_canon")
    tier = F.coalesce(F.col("_tier"), F.lit("LOW"))
    risk = (F.when(F.col("_hi").isNotNull(), F.lit("HIGH"))
            .when(F.col("_med").isNotNull(), F.lit("MEDIUM"))
            .otherwise(tier))
    # FIXED VALUES: the wording of the reasons
    base = (F.when(tier == "HIGH", F.concat(F.lit("High-risk label: '"), lab, F.lit("'")))
            .when(tier == "MEDIUM", F.concat(F.lit("Medium-risk label: '"), lab, F.lit("'")))
            .otherwise(F.concat(F.lit("Label '"), F.when(lab == "", F.lit("unknown")).otherwise(lab),
                                F.lit("' is not in configured risk lists"))))
    label_reason = F.when(F.coalesce(F.col("_desc"), F.lit("")) != "",
                          F.concat(base, F.lit(". "), F.col("_desc"))).otherwise(base)
    reason = (F.when(F.col("_hi").isNotNull(),
                     F.concat(F.lit("Contains '"), F.col("_hi"), F.lit("' (high-risk language)")))
              .when(F.col("_med").isNotNull(),
                    F.concat(F.lit("Contains '"), F.col("_med"), F.lit("' (medium-risk language)")))
              .otherwise(label_reason))
    d = d.withColumn("risk", risk).withColumn("reason", reason)
    d = d.withColumn("risk_score", risk_score(F.col("risk")))
    return d.drop("_label_canon", "_lw", "_tier", "_desc", "_hi", "_med")


def risk_order(risk: Column) -> Column:
    """HIGH 0, MEDIUM 1, LOW 2."""
    return F.when(risk == "HIGH", 0).when(risk == "MEDIUM", 1).otherwise(2)


def risk_score(risk: Column) -> Column:
    """HIGH 2, MEDIUM 1, LOW 0."""
    return F.when(risk == "HIGH", 2).when(risk == "MEDIUM", 1).otherwise(0)


def bias_struct(text, fix_word_boundaries: bool = False, lowered=None) -> Column:
    """R2: struct<is_one_sided, bias_score, triggers> for one clause text.
    Pass ``lowered`` (a column holding lower(strip(text))) to avoid recomputing it
    inside the phrase lambdas."""
    lowered = F.lower(tc.strip_ws(F.coalesce(tc._c(text), F.lit("")))) if lowered is None else tc._c(lowered)
    cleaned = lowered
    hits = tc.weighted_hits(lowered, lx.ONE_SIDED_PHRASES)
    weight = F.aggregate(hits, F.lit(0), lambda acc, x: acc + x["weight"])
    balanced = F.when(tc.any_phrase(lowered, lx.BIAS_BALANCED_PHRASES), -2).otherwise(0)
    if fix_word_boundaries:
        obl, rig = lx.OBLIGATION_PATTERN_WORD, lx.RIGHT_PATTERN_WORD
    else:
        obl, rig = lx.OBLIGATION_PATTERN_LITERAL_B, lx.RIGHT_PATTERN_LITERAL_B
    burden = F.when(tc.regex_count(lowered, obl) > tc.regex_count(lowered, rig), 1).otherwise(0)
    only = F.when(F.instr(lowered, "only") > 0, 1).otherwise(0)
    score = weight + balanced + burden + only
    triggers = tc.sorted_distinct(F.transform(hits, lambda x: x["phrase"]))
    return (F.when(cleaned == "", F.struct(F.lit(False).alias("is_one_sided"), F.lit(0).alias("bias_score"),
                                           F.array().cast("array<string>").alias("triggers")))
            .otherwise(F.struct((score >= 2).alias("is_one_sided"), score.alias("bias_score"),
                                triggers.alias("triggers"))))


def with_bias(df: DataFrame, text: str = "text", fix_word_boundaries: bool = False) -> DataFrame:
    d = tc.with_computed(df, {"_blw": F.lower(tc.strip_ws(F.coalesce(F.col(text), F.lit(""))))})
    return (tc.with_computed(d, {"_bias": bias_struct(text, fix_word_boundaries, lowered="_blw")})
            .drop("_blw")
            .withColumn("is_one_sided", F.col("_bias.is_one_sided"))
            .withColumn("bias_score", F.col("_bias.bias_score"))
            .withColumn("triggers", F.col("_bias.triggers")).drop("_bias"))


def _common_filters(df: DataFrame, min_confidence: float) -> DataFrame:
    """F6 + F3 (cheap predicates first; NULL confidence counts as 0, NaN passes)."""
    return (tc.with_computed(df, {"text": tc.strip_ws(F.coalesce(F.col("text"), F.lit("")))})
            .filter(F.col("text") != "")
            .withColumn("confidence", F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)))
            .filter(F.col("confidence") >= F.lit(min_confidence)))


def important_candidates(pred: DataFrame, min_confidence: float = lx.IMPORTANT_MIN_CONFIDENCE) -> DataFrame:
    """R3 before dedup: F6, F3, R1, F4.  Adds ``risk_ord``; the L1 order is
    (risk_ord, confidence desc, clause_idx) — no per-contract window is needed
    because dedup and the top-n limit take the order columns directly."""
    d = with_risk(_common_filters(pred, min_confidence)).filter(F.col("risk").isin("HIGH", "MEDIUM"))
    return (d.withColumn("label", F.coalesce(F.col("label").cast("string"), F.lit("")))
            .withColumn("risk_ord", risk_order(F.col("risk"))))


def important_order() -> list[Column]:
    return [F.col("risk_ord").asc(), F.col("confidence").desc(), F.col("clause_idx").asc()]


def important_key() -> Column:
    """L1 order as one comparable struct (smaller = earlier)."""
    return F.struct(F.col("risk_ord").alias("a"), (-F.col("confidence")).alias("b"),
                    F.col("clause_idx").alias("c"))


def one_sided_order() -> list[Column]:
    return [F.col("bias_score").desc(), F.col("confidence").desc(), F.col("clause_idx").asc()]


def one_sided_key() -> Column:
    """L2 order as one comparable struct."""
    return F.struct((-F.col("bias_score")).alias("a"), (-F.col("confidence")).alias("b"),
                    F.col("clause_idx").alias("c"))


def one_sided_candidates(pred: DataFrame, min_confidence: float = lx.IMPORTANT_MIN_CONFIDENCE,
                         fix_word_boundaries: bool = False) -> DataFrame:
    """R4 before dedup: F6, F3, R1, F5 (HIGH and one-sided), reason + triggers.
    L2 order is (bias_score desc, confidence desc, clause_idx)."""
    d = with_risk(_common_filters(pred, min_confidence)).filter(F.col("risk") == "HIGH")
    d = with_bias(d, fix_word_boundaries=fix_word_boundaries).filter(F.col("is_one_sided"))
    d = d.withColumn("reason", F.when(F.size("triggers") > 0,
                                      F.concat(F.col("reason"), F.lit(". One-sided triggers: "),
                                               tc.join_list("triggers"))).otherwise(F.col("reason")))
    d = d.withColumn("label", F.coalesce(F.col("label").cast("string"), F.lit("")))
    return d.withColumn("one_sided", F.lit(True)).drop("is_one_sided")


def top_n_per_contract(df: DataFrame, order: list[Column], n: int = lx.TOP_CLAUSES_PER_CONTRACT,
                       key: str = "contract_id") -> DataFrame:
    """L3: first ``n`` rows per contract, 1-based ``rank``.  ``row_number() <= n``
    is planned as a partial WindowGroupLimit before the shuffle, so at most n rows
    per contract per task cross the network (safe for a very large contract)."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
