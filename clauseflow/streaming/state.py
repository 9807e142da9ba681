"""X1/X2 with keyed state: one current review per contract.

The stream remembers, per contract, a hash of the text it saw last and how many
versions there were.  An upload with the same text is suppressed, also by a run
that starts again from the checkpoint; a changed one becomes the next version and
its review replaces the one before.  State that saw no upload for ``keep`` is
dropped, so it grows with the contracts of that time, not with the history.

Each micro-batch writes what changed and then its review to directories of its
own with overwrite, so a replayed batch replaces its output.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clauseflow.session import sort_join

#: How long the text of a contract is remembered after its last upload.
KEEP_MS = 30 * 24 * 3600 * 1000


def _last_upload(order: str):
    """The last row of one contract's frames by ``order``, ties by text; nulls first.
    (Nested, so that it travels to workers that do not have this package.)"""
    def last_upload(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
        frames = [f for f in frames if len(f)]
        if len(frames) == 1 and len(frames[0]) == 1:  # most contracts come once in a batch
            return frames[0]
        return pd.concat(frames).sort_values([order, "text"], kind="stable", na_position="first").iloc[[-1]]
    return last_upload


def changed_contracts(contracts: DataFrame, order: str, keep_ms: int = KEEP_MS) -> DataFrame:
    """Streaming (contract_id, text, ..., version long) of the contracts whose text
    is not the one seen last.

    Of several uploads of a contract in one micro-batch the last by ``order`` (ties:
    by text) counts.  A null text is a text of its own; rows with a null
    contract_id are uploads of one contract."""
    schema = T.StructType([*contracts.schema.fields, T.StructField("version", T.LongType())])
    last_upload = _last_upload(order)

    def latest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = last_upload(frames)
        text = last["text"].iloc[0]
        seen = "null" if text is None else hashlib.sha256(text.encode()).hexdigest()
        before, version = state.get if state.exists else (None, 0)
        if seen != before:
            version += 1
            yield last.assign(version=version)
        state.update((seen, version))
        state.setTimeoutDuration(keep_ms)

    return contracts.groupBy("contract_id").applyInPandasWithState(  # old state goes with the next batch that has data
        latest, schema, "seen string, version long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def start_available(writer):
    """Start ``writer`` on what is there now.  Processing-time state would ask for
    batches without data for ever, so that is off for this query."""
    conf, key = SparkSession.active().conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(key)
    conf.set(key, "false")
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        conf.set(key, before)


def review_changes(uploads: DataFrame, out_dir: str, checkpoint: str, classifier, order: str, keep_ms: int = KEEP_MS,
                   review: Callable[..., DataFrame] | None = None):
    """Start an availableNow stream: uploads -> changed contracts -> P2, as
    ``changed/epoch_id=N`` and ``review/epoch_id=N`` under ``out_dir``."""
    from clauseflow.plans import pipeline as P
    review = review or P.review_contracts
    spark = uploads.sparkSession  # a stateful query's own session has no adaptive execution

    def each_batch(batch: DataFrame, epoch_id: int) -> None:
        path = os.path.join(out_dir, "changed", f"epoch_id={epoch_id}")
        batch.write.mode("overwrite").parquet(path)  # read back below, so the state is not run through again
        changed = spark.read.schema(batch.schema).parquet(path)
        rows = review(changed.drop("version"), classifier)
        versions = changed.select(F.col("contract_id").alias("_id"), "version")
        rows = sort_join(rows, versions, F.col("contract_id").eqNullSafe(F.col("_id"))).drop("_id")
        rows.write.mode("overwrite").parquet(os.path.join(out_dir, "review", f"epoch_id={epoch_id}"))

    return start_available(changed_contracts(uploads, order, keep_ms).writeStream.foreachBatch(each_batch)
                           .option("checkpointLocation", checkpoint))


def current_review(spark: SparkSession, out_dir: str) -> DataFrame:
    """Review rows of every contract's last version; a version without important
    clauses has none, and hides those of the versions before it."""
    last = (spark.read.parquet(os.path.join(out_dir, "changed")).groupBy(F.col("contract_id").alias("_id"))
            .agg(F.max("version").alias("_version")))
    rows = spark.read.parquet(os.path.join(out_dir, "review"))
    same = F.col("contract_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version"))
    return sort_join(rows, last, same, "left_semi").drop("epoch_id")
