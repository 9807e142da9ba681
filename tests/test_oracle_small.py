"""A slice of the driver's oracle check on sf0.001 (the full set runs via
tests/oracle_harness.py at sf0.01)."""
import pytest

import oracle_harness as H

FAST = ["section_split", "contract_clauses", "risk_level", "one_sided_bias", "top20_per_contract",
        "linear_head_softmax", "knn_exact", "exact_dedup", "corpus_length_filter", "admission_check",
        "fairness_band", "risk_rollup", "semantic_dedup_embedding", "classification_report"]


@pytest.fixture(scope="module")
def con():
    return H.duck("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    res = H.compare(spark, name, "/root/testdata/sf0.001", con)
    assert res["status"] == "OK", res
