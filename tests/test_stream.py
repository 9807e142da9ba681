"""The streamed review equals the batch review."""
from pyspark.sql import functions as F

from clauseflow.plans import pipeline as P
from clauseflow.sources import fixtures as fx
from clauseflow.streaming import stream as st

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    streamed = st.run_review_stream(spark, SF, fx.contracts_from_documents, fx.rule_classifier)
    batch = P.review_contracts(fx.fx_contracts(spark, SF), fx.rule_classifier)
    cols = ["contract_id", "clause_idx", "label", "risk", "rank"]
    a = sorted(tuple(r) for r in streamed.select(*cols).collect())
    b = sorted(tuple(r) for r in batch.select(*cols).collect())
    assert a == b and len(a) > 0


def test_resubmitted_texts_are_suppressed(spark):
    """A contract whose text was already seen within the watermark is skipped."""
    import os
    import tempfile

    from clauseflow.session import ensure_checkpoint_dir
    docs = fx.read_table(spark, SF, "documents")
    run = tempfile.mkdtemp(prefix="cf-x2-", dir=ensure_checkpoint_dir(spark))

    def raw_contracts(df):
        return df.select(F.col("doc_id").alias("contract_id"), "text")

    stream = st.contract_stream(spark, SF, raw_contracts, glob="documents.parquet", schema=docs.schema,
                                dedup_resubmits=True)
    q = (stream.writeStream.format("parquet").option("path", os.path.join(run, "out"))
         .option("checkpointLocation", os.path.join(run, "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(os.path.join(run, "out"))
    n_distinct = docs.select("text").distinct().count()
    assert got.count() == n_distinct < docs.count()
