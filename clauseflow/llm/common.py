"""Helpers shared by the training-data operators: written intermediate tables,
sums of fixed-size arrays over all partitions, and connected components."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

import clauseflow
from clauseflow.session import ensure_checkpoint_dir, shuffle_files_freed


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: their Python
    workers import it, and need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_clauseflow_shipped", False):
        return
    top = Path(clauseflow.__file__).resolve().parent
    archive = Path(context._temp_dir) / "clauseflow_package.zip"  # the application's own folder; Spark serves it from there
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    context.addPyFile(str(archive))
    context._clauseflow_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation, and
    every later use reads only the columns it needs.  The shuffle files behind
    the table are deleted once it is written."""
    ship(df.sparkSession)
    path = shared_folder(df.sparkSession, name)
    with shuffle_files_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_up_to(df: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """``df``, a few numbers a row from a written table, with a broadcast hint if
    it has at most ``most_rows`` rows; beyond that joins shuffle it."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def sum_arrays(df: DataFrame, fold: Callable[[Iterator[pa.RecordBatch]], np.ndarray], length: int,
               block: int = 4096) -> np.ndarray:
    """Element-wise sum, over all partitions of ``df``, of the fixed-length
    int64 array that ``fold`` makes of a partition's batches.

    ``length`` is a parameter of the caller and does not depend on the data, so
    the array that reaches the driver is bounded.  Each partition emits its
    array in blocks; blocks meet by key and are added up as they stream by."""
    ship(df.sparkSession)
    n_blocks = -(-length // block)
    schema = "block int, payload binary"

    def partial(batches):
        total = np.zeros(n_blocks * block, np.int64)
        got = fold(batches)
        total[:length] = got
        parts = total.reshape(n_blocks, block)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array([parts[i].tobytes() for i in used], pa.binary())],
            names=["block", "payload"])

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(payload.as_buffer(), np.int64)
                sums[b] = sums[b] + part if b in sums else part.copy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
            names=["block", "payload"])

    rows = (df.mapInArrow(partial, schema).repartition(min(16, n_blocks), "block")
            .mapInArrow(merge, schema).collect())
    out = np.zeros(n_blocks * block, np.int64)
    for r in rows:
        out[r["block"] * block:(r["block"] + 1) * block] = np.frombuffer(r["payload"], np.int64)
    return out[:length]


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a long, b long)`` -> ``(node long, root long)`` for every node that
    has an edge to another one; ``root`` is the smallest node of its component.

    Alternates large-star and small-star steps (minimum per node by an
    aggregate with map-side combine, joined back), so no component is ever
    gathered.  Each round is a written table; the loop ends when the edges are
    stars, however long the chains are.  Self-edges, repeated edges and edges
    with nulls are ignored."""
    def norm(df):
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()

    def stars(df):  # every node has one neighbour below it, which has none itself
        several = df.groupBy("a").count().filter("count > 1").select("a")
        between = df.select("b").distinct().join(df.select("a"), F.col("a") == F.col("b"), "left_semi").select("b")
        return several.unionAll(between).isEmpty()

    cur = stash(norm(edges.filter("a is not null and b is not null")), "cc")
    while not stars(cur):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = (both.filter("b > a").join(low, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        cur = stash(small, "cc")
    return (cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
