"""X1/X2 with state: re-uploads, replays and restarts against the batch review."""
import os
import uuid

import pytest
from pyspark.sql import functions as F

from clauseflow.plans import pipeline as P
from clauseflow.session import ensure_checkpoint_dir
from clauseflow.sources import fixtures as fx
from clauseflow.streaming import state as ss

COLS = ["contract_id", "clause_idx", "label", "risk", "rank"]


@pytest.fixture
def folder(spark):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/uploads-{uuid.uuid4().hex}"


def _run(spark, folder, **settings):
    schema = spark.read.parquet(f"{folder}/in").schema
    uploads = spark.readStream.schema(schema).parquet(f"{folder}/in")
    ss.review_changes(uploads, f"{folder}/out", f"{folder}/ck", fx.rule_classifier, "upload", **settings).awaitTermination()


def _rows(df):
    return sorted(tuple(r) for r in df.select(*COLS).collect())


def test_changed_uploads_replace_and_equal_ones_are_suppressed(spark, folder):
    docs = fx.fx_contracts(spark, "/root/testdata/sf0.001").select("contract_id", "text").filter("contract_id % 2 = 0")
    old = docs.withColumn("text", F.when(F.col("contract_id") % 3 == 0, F.lit("1.1 Old terms. Buyer shall pay a fee; the parties agree to nothing else."))
                          .otherwise(F.col("text")))

    def upload(df, number):
        df.select("contract_id", "text", F.lit(number).alias("upload")).write.mode("append").parquet(f"{folder}/in")
    upload(old, 1)
    _run(spark, folder)
    assert _rows(ss.current_review(spark, f"{folder}/out")) == _rows(P.review_contracts(old, fx.rule_classifier))
    upload(docs, 2)  # a new run from the checkpoint
    _run(spark, folder)
    want = _rows(P.review_contracts(docs, fx.rule_classifier))
    assert _rows(ss.current_review(spark, f"{folder}/out")) == want and len(want) > 0
    changed = spark.read.parquet(f"{folder}/out/changed")
    versions = {r["contract_id"]: r["n"] for r in changed.groupBy("contract_id").agg(F.max("version").alias("n")).collect()}
    assert versions == {r["contract_id"]: 1 + (r["contract_id"] % 3 == 0) for r in docs.collect()}
    upload(docs, 3)  # equal texts: nothing new is written
    before = changed.count()
    _run(spark, folder)
    assert spark.read.parquet(f"{folder}/out/changed").count() == before
    assert _rows(ss.current_review(spark, f"{folder}/out")) == want


def test_a_replayed_batch_replaces_its_output(spark, folder):
    docs = fx.fx_contracts(spark, "/root/testdata/sf0.001").select("contract_id", "text", F.lit(1).alias("upload")).filter("contract_id < 20")
    docs.write.parquet(f"{folder}/in")

    class Stop(Exception):
        pass

    def fails_late(contracts, classifier):
        raise Stop
    with pytest.raises(Exception):
        _run(spark, folder, review=fails_late)
    _run(spark, folder)
    assert spark.read.parquet(f"{folder}/out/changed").count() == docs.count()
    assert _rows(ss.current_review(spark, f"{folder}/out")) == _rows(P.review_contracts(docs.drop("upload"), fx.rule_classifier))


def test_last_upload_of_a_batch_counts_and_odd_rows(spark, folder):
    rows = [(1, "a", 1), (1, "b", 2), (2, None, 1), (2, "c", None), (None, "x", 1), (None, "y", 1), (3, "", 1), (3, "", 1)]
    spark.createDataFrame(rows, "contract_id long, text string, upload int").coalesce(1).write.parquet(f"{folder}/in")
    uploads = spark.readStream.schema("contract_id long, text string, upload int").parquet(f"{folder}/in")

    def sink(batch, epoch):
        batch.write.mode("overwrite").parquet(os.path.join(folder, "out", f"epoch_id={epoch}"))
    for _ in range(2):
        ss.start_available(ss.changed_contracts(uploads, "upload").writeStream.foreachBatch(sink)
                           .option("checkpointLocation", f"{folder}/ck")).awaitTermination()
    got = sorted(((r["contract_id"], r["text"], r["version"]) for r in spark.read.parquet(f"{folder}/out").collect()), key=str)
    assert got == sorted([(1, "b", 1), (2, None, 1), (None, "y", 1), (3, "", 1)], key=str)


def test_forgotten_state_takes_the_text_as_new(spark, folder):
    spark.createDataFrame([(1, "a", 1)], "contract_id long, text string, upload int").write.parquet(f"{folder}/in")
    uploads = spark.readStream.schema("contract_id long, text string, upload int").parquet(f"{folder}/in")
    seen = []
    for number in range(3):
        ss.start_available(ss.changed_contracts(uploads, "upload", keep_ms=1).writeStream.foreachBatch(lambda b, e: seen.extend(b.collect()))
                           .option("checkpointLocation", f"{folder}/ck")).awaitTermination()
        other = (1, "a", 2) if number == 1 else (7 + number, "z", 1)
        spark.createDataFrame([other], "contract_id long, text string, upload int").write.mode("append").parquet(f"{folder}/in")
    assert sum(r["contract_id"] == 1 for r in seen) == 2


def test_one_upload_of_a_contract_is_not_sorted(monkeypatch):
    """only contracts with several uploads in a batch pay for putting them in order."""
    import pandas as pd
    last = ss._last_upload("upload")
    frame = lambda *rows: pd.DataFrame(list(rows), columns=["contract_id", "text", "upload"])
    several = [frame((1, "b", 2), (1, "z", 1)), frame(), frame((1, "c", 2), (1, "y", None))]
    assert last(iter(several)).values.tolist() == [[1, "c", 2]]
    monkeypatch.setattr(pd, "concat", None)
    monkeypatch.setattr(pd.DataFrame, "sort_values", None)
    one = last(iter([frame((1, None, 5)), frame()]))
    assert one.values.tolist() == [[1, None, 5]]
