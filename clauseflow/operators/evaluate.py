"""Rewrite scoring (correctness band, fairness band, score merge, summary)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseflow.functions import lexicon as lx
from clauseflow.functions import textcols as tc


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric array columns (double arithmetic)."""
    ab = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    aa = F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, v: s + v)
    bb = F.aggregate(F.transform(b, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when((aa > 0) & (bb > 0), ab / (F.sqrt(aa) * F.sqrt(bb))).otherwise(F.lit(0.0))


def correctness_band(sim: Column) -> Column:
    """> .90 -> 5, >= .85 -> 4, >= .75 -> 3, >= .65 -> 2, else 1."""
    (t5, _), (t4, _), (t3, _), (t2, _) = lx.CORRECTNESS_BANDS
    return (F.when(sim > t5, 5).when(sim >= t4, 4).when(sim >= t3, 3).when(sim >= t2, 2).otherwise(1))


def fairness_delta(original: Column, rewritten: Column) -> Column:
    """E2 delta: distinct balanced phrases in the rewrite minus distinct harmful
    phrases in the original (substring tests on lower-cased text)."""
    return _lowered_delta(F.lower(original), F.lower(rewritten))


def _lowered_delta(original, rewritten) -> Column:
    return (tc.count_phrases(rewritten, lx.FAIRNESS_BALANCED_PHRASES)
            - tc.count_phrases(original, lx.FAIRNESS_HARMFUL_PHRASES))


def fairness_band(delta: Column) -> Column:
    """>= 2 -> 5, 1 -> 4, 0 -> 3, -1 -> 2, <= -2 -> 1."""
    return F.when(delta >= 2, 5).when(delta == 1, 4).when(delta == 0, 3).when(delta == -1, 2).otherwise(1)


SCORES_TYPE = "struct<correctness:int,fairness:int,clarity:int>"


def score_rewrites(df: DataFrame, similarity: Column | None = None) -> DataFrame:
    """E1-E3 + F7: rows with a blank original or rewrite keep their scores
    untouched; others get correctness (1 without an encoder) and fairness set,
    every other score field preserved."""
    # pinned: the phrase counts would lower and strip the texts anew for every phrase, the band count them anew for every case
    lowered = {f"_{c}": F.lower(tc.strip_ws(F.coalesce(F.col(c), F.lit("")))) for c in ("original", "rewritten")}
    d = tc.with_computed(df, lowered)
    d = tc.with_computed(d, {"_delta": _lowered_delta("_original", "_rewritten")})
    live = (F.col("_original") != "") & (F.col("_rewritten") != "")
    corr = correctness_band(similarity) if similarity is not None else F.lit(1)
    scores = F.coalesce(F.col("scores"), F.lit(None).cast(SCORES_TYPE))
    base = F.when(F.col("scores").isNull(), F.struct(F.lit(None).cast("int").alias("correctness"),
                                                     F.lit(None).cast("int").alias("fairness"),
                                                     F.lit(None).cast("int").alias("clarity"))).otherwise(scores)
    updated = (base.withField("correctness", corr.cast("int"))
               .withField("fairness", fairness_band(F.col("_delta")).cast("int")))
    return (d.withColumn("processed", live).withColumn("scores", F.when(live, updated).otherwise(F.col("scores")))
            .select(*df.columns, "processed"))


def rewrite_summary(scored: DataFrame) -> DataFrame:
    """Processed count and raw averages over processed rows."""
    p = scored.filter("processed")
    return p.agg(F.count(F.lit(1)).alias("processed"),
                 F.avg("scores.correctness").alias("avg_correctness"),
                 F.avg("scores.fairness").alias("avg_fairness"))
