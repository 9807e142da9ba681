"""Plan shape: broadcasts for the label dimension, group limits, no Python in P2,
pushdown to the parquet scan; the driver entry points."""
from pyspark.sql import functions as F

from clauseflow.functions import lexicon as lx
from clauseflow.operators import risk as rk
from clauseflow.plans import pipeline as P
from clauseflow.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_risk_uses_broadcast_join_and_no_python(spark):
    pred = P.classify_contracts(fx.fx_contracts(spark, SF), fx.rule_classifier)
    p = plan(rk.with_risk(pred))
    assert "BroadcastHashJoin" in p
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_top_n_is_window_group_limit(spark):
    df = spark.range(100).select((F.col("id") % 5).alias("contract_id"), F.col("id").alias("clause_idx"),
                                 F.lit(0).alias("risk_ord"), F.lit(0.9).alias("confidence"))
    p = rk.top_n_per_contract(df, rk.important_order(), 3)
    p._jdf.queryExecution().executedPlan()
    assert "WindowGroupLimit" in p._jdf.queryExecution().optimizedPlan().toString()
    assert p.count() == 15


def test_scan_prunes_columns(spark):
    d = fx.read_table(spark, SF, "documents").select("doc_id").filter(F.col("doc_id") > 5)
    p = plan(d)
    assert "ReadSchema: struct<doc_id:bigint>" in p and "PushedFilters: [IsNotNull(doc_id), GreaterThan(doc_id,5)]" in p


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 40
