"""Headline benchmark: prints one JSON line.

Runs the contract review (P2), the one-sided review (P4), TF-IDF dedup over
all clauses, segmentation, exact kNN, the training-set build and the corpus
build at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS].
Each query's whole result is computed (written to the no-op sink, so no column
is pruned away) and timed wall-clock.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "top20_per_contract",      # P2: flagship
    "one_sided_high_risk",     # R4 / P4
    "semantic_dedup_tfidf",    # D2 over every clause
    "contract_clauses",        # G1-G4 segmentation
    "risk_level",              # R1 over every clause
    "knn_exact",               # V3
    "semantic_dedup_embedding",  # D3
    "exact_dedup",             # P6 training set
    "corpus_length_filter",    # P5 corpus
    "linear_head_softmax",     # C1/C2
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ["BENCH_CPUS"] = cpus
    from clauseflow.session import get_spark
    from clauseflow.plans import registry as R

    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    # warm-up on the smallest scale (JVM JIT, codegen, Python workers), not timed
    for name in ("top20_per_contract", "knn_exact"):
        R.QUERIES[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    times, rows = {}, {}
    for name in HEADLINE:
        t0 = time.time()
        result = R.QUERIES[name](spark, sf_dir)
        result.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        rows[name] = result.count()
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total_wall", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "rows": rows, "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
