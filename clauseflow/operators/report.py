"""A1-A7 aggregations and reports (all partial/final hash aggregates)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clauseflow.session import sort_join


def top_labels(df: DataFrame, n: int = 10, label: str = "label", pos: str = "_pos") -> DataFrame:
    """A2: the n most frequent labels, ties by first appearance.  The ranking
    window runs over the per-label counts only (one row per class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("_first"))
    w = Window.orderBy(F.col("n").desc(), F.col("_first"))
    return (counts.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= n)
            .select(label, "n", "rank"))


def contract_report(contracts: DataFrame, clauses: DataFrame, important: DataFrame, one_sided: DataFrame,
                    key: str = "contract_id") -> DataFrame:
    """One row per contract; left joins so empty contracts report 0."""
    n_cl = clauses.groupBy(key).agg(F.count(F.lit(1)).alias("n_clauses"))
    n_imp = important.groupBy(key).agg(F.count(F.lit(1)).alias("important_count"),
                                       F.countDistinct("label").alias("important_labels"))
    n_os = one_sided.groupBy(key).agg(F.count(F.lit(1)).alias("one_sided_count"))
    base = contracts.select(key, F.length("text").cast("int").alias("text_chars"))
    out = base
    for counts in (n_cl, n_imp, n_os):
        out = sort_join(out, counts, key, "left")
    return out.select(key, "text_chars",
                      *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
                        for c in ["n_clauses", "important_count", "important_labels", "one_sided_count"]])


def grouped_important(important: DataFrame, key: str = "contract_id") -> DataFrame:
    """A5 map form: label -> ordered clause structs, per contract."""
    per_label = (important.groupBy(key, "label")
                 .agg(F.array_sort(F.collect_list(F.struct("clause_idx", "text", "risk", "confidence", "reason")))
                      .alias("clauses")))
    return per_label.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("label", "clauses")))
                                      .alias("important_clauses_grouped"))


def full_report(contracts: DataFrame, clauses: DataFrame, important: DataFrame, one_sided: DataFrame,
                key: str = "contract_id") -> DataFrame:
    """A5: the counts of ``contract_report``, the important clauses grouped by
    label (a map) and the one-sided high-risk clauses (an ordered list), one row
    per contract; contracts without any have an empty map and list."""
    fields = ["clause_idx", "text", "label", "confidence", "risk", "bias_score", "reason"]
    rows = (one_sided.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("one_sided_high_risk_clauses")))
    grouped = grouped_important(important, key)
    out = sort_join(contract_report(contracts, clauses, important, one_sided, key), grouped, key, "left")
    out = sort_join(out, rows, key, "left")
    empty_map = F.from_json(F.lit("{}"), grouped.schema["important_clauses_grouped"].dataType.simpleString())
    empty_list = F.array().cast(rows.schema["one_sided_high_risk_clauses"].dataType)
    return (out.withColumn("important_clauses_grouped", F.coalesce("important_clauses_grouped", empty_map))
            .withColumn("one_sided_high_risk_clauses", F.coalesce("one_sided_high_risk_clauses", empty_list)))


def risk_rollup(scored: DataFrame) -> DataFrame:
    """Rollup of risk x label with grouping id."""
    return (scored.rollup("risk", "label")
            .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("gid")))
