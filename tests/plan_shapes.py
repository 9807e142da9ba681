"""Summarise physical plans of key registered queries (shuffles, joins, limits,
generators, Python nodes, scan pruning) into docs/PLAN_SHAPES.md.

    python tests/plan_shapes.py [sf_dir]
"""
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KEY = ["contract_clauses", "risk_level", "top20_per_contract", "one_sided_high_risk", "semantic_dedup_tfidf",
       "merge_fragments", "exact_dedup", "stratified_split", "corpus_length_filter", "knn_exact",
       "linear_head_softmax", "contract_report", "text_normalize_similarity"]


def shape(plan: str) -> dict:
    return {
        "Exchange": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobin|SinglePartition)", plan)),
        "BroadcastHashJoin": plan.count("BroadcastHashJoin"),
        "SortMergeJoin": plan.count("SortMergeJoin"),
        "WindowGroupLimit": plan.count("WindowGroupLimit"),
        "Generate": plan.count("Generate "),
        "Python": plan.count("ArrowEvalPython") + plan.count("BatchEvalPython") + plan.count("MapInPandas")
        + plan.count("MapInArrow") + plan.count("FlatMapGroupsInPandas") + plan.count("FlatMapCoGroupsInPandas"),
        "scans": sorted(set(re.findall(r"ReadSchema: (struct<[^>]*>)", plan))),
    }


if __name__ == "__main__":
    from clauseflow.session import get_spark
    from clauseflow.plans import registry as R
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark()
    rows = []
    for name in KEY:
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
        df = R.QUERIES[name](spark, sf)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before
        rows.append((name, {**shape(df._jdf.queryExecution().executedPlan().toString()), "jobs": jobs}))
    out = ["# Plan shapes of key queries", "",
           f"Physical plans of the last job of each query at `{os.path.basename(sf)}` (the initial plan, before AQE). "
           "Generated by `tests/plan_shapes.py`. Queries that write intermediate tables (dedup, reports) run further "
           "jobs before it; `jobs before` counts them (broadcasts included), and their "
           "shuffles are not in the other columns.  Joins are planned for these small tables: larger ones shuffle.", "",
           "| query | shuffles | broadcast joins | sort-merge joins | group limits | generators | Python nodes | jobs before | parquet ReadSchema |",
           "|---|---|---|---|---|---|---|---|---|"]
    for name, s in rows:
        out.append(f"| {name} | {s['Exchange']} | {s['BroadcastHashJoin']} | {s['SortMergeJoin']} | {s['WindowGroupLimit']} | "
                   f"{s['Generate']} | {s['Python']} | {s['jobs']} | {'; '.join(s['scans'])} |")
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "PLAN_SHAPES.md")
    with open(path, "w") as fh:
        fh.write("\n".join(out) + "\n")
    print("\n".join(out))
