"""K1-K7 sinks.  Parquet is the working format; the text formats mirror the
files the original tools write.  Every writer targets a *new* path (no
read-and-overwrite of the input), so a failed job leaves the input intact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_labelled_csv(df: DataFrame, path: str) -> None:
    """K1: text,label CSV with a header."""
    df.select("text", "label").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_corpus_json(df: DataFrame, path: str) -> None:
    """K2: corpus entries (clause, source, label) as JSON lines."""
    df.select("clause", "source", "label").write.mode("overwrite").json(path)


def write_vectors(df: DataFrame, path: str, vec: str = "embedding", partition_by: str | None = None) -> None:
    """K3: one parquet table holding id, metadata and the vector side by side."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def write_label_map(label_dim: DataFrame, path: str) -> None:
    """K4: label -> id as one JSON object (41 rows: a single small file)."""
    (label_dim.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("label", "label_id")))).alias("value"))
     .coalesce(1).write.mode("overwrite").text(path))


def write_reports(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """K5 / K6: contract reports or review sheets as JSON lines (UTF-8 kept)."""
    w = df.write.mode("overwrite").option("ignoreNullFields", False)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.json(path)


def write_scored_rewrites(df: DataFrame, path: str) -> None:
    """K7: scored rewrites written as a new version next to the input."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
