"""Mixing sources to target weights by weighted fair queueing.

Each document, in a fixed pseudo-random order within its source, gets a virtual
finish time: the source's words up to and including it, divided by the source's
weight.  A source that is used up starts again, ``max_epochs`` times in all.
The mix is the global order by finish time, cut where the running total would
pass the budget.  Sources that run out leave the queue, which hands their share
to the others by weight.

All running totals are two-level over a range sort of the rows: totals per
range, offsets over the (small) table of ranges, then a window inside each
range.  Ranges are cut by sampled quantiles of the order itself, so neither a
source that holds a third of all rows, nor many rows without an id, nor finish
times that lie close together fill one range.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import common

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__size`` (words; 0 for null), ``__key`` (order within the
    source) and ``__hash`` (order of rows with one id)."""
    return docs.withColumns({
        "__size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
        "__key": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "__hash": F.xxhash64("text")})


def _order() -> Column:
    return F.struct("__key", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("__id"), "__size", "__hash")


def _running(rows: DataFrame, keys: list[str], by: list[str], most_rows: int) -> DataFrame:
    """``rows``, a written table, with ``upto``: __size summed up in the order ``by`` inside each of ``keys``."""
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / most_rows))
    order = [F.col(c) for c in (*keys, *by)]
    placed = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = common.stash(placed, "mix-order").withColumn("__range", F.shiftrightunsigned("__at", 33))
    totals = placed.groupBy(*keys, "__range").agg(F.sum("__size").alias("__sum"))
    before = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    inside = W.partitionBy("__range", *keys).orderBy("__at").rowsBetween(W.unboundedPreceding, 0)
    return (placed.withColumn("upto", F.sum("__size").over(inside)).join(totals, [*keys, "__range"])
            .withColumn("upto", F.col("upto") + F.col("__before")).drop("__at", "__range", "__before"))


@dataclass
class Mix:
    """sizes: doc_id, source, __size, __key, __hash of every row; sources: source, idx,
    weight, source_size, target, and cut_0, cut_1, ... (the last document of
    each epoch that the mix takes, null if none)."""
    sizes: DataFrame
    sources: DataFrame
    max_epochs: int

    def copies(self, docs: DataFrame) -> DataFrame:
        """``docs`` (made by ``sized``) with __source_size, __target and __copies."""
        s = self.sources.select(F.col("source").alias("__source"), F.col("source_size").alias("__source_size"),
                                F.col("target").alias("__target"),
                                *[F.col(f"cut_{e}").alias(f"__cut_{e}") for e in range(self.max_epochs)])
        taken = sum((F.coalesce((_order() <= F.col(f"__cut_{e}")).cast("int"), F.lit(0))
                     for e in range(self.max_epochs)), F.lit(0))
        return (docs.join(s, docs["source"].eqNullSafe(s["__source"]), "left").withColumn("__copies", taken)
                .drop("__source", *[f"__cut_{e}" for e in range(self.max_epochs)]))


def plan(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, max_epochs: int = 3, range_rows: int = 1_000_000) -> Mix:
    """Decide how often each document is taken.

    ``weights`` go to the sources in code point order (null last) and repeat.
    ``range_rows``: slim rows that a task puts in order, about.
    ``share`` is the budget as a share of all words.  Null texts and texts
    without words have size 0: they are taken with their neighbours and add
    nothing.  Rows that repeat a doc_id are rows of their own, except that rows
    with the same text as well are taken or left together.  With no words
    at all every target is 0.  The table of sources is an aggregate of one slim
    row per source."""
    n = max_epochs
    sizes = common.stash(sized(docs.select("doc_id", "text", "source")).select("doc_id", "source", "__size", "__key", "__hash"), "mix")
    per = sizes.groupBy("source").agg(F.sum("__size").alias("source_size"))
    everything = W.partitionBy()
    by_name = everything.orderBy(F.col("source").isNull(), "source")
    per = (per.withColumn("idx", F.row_number().over(by_name) - 1)
           .withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("idx") % len(weights)))
           .withColumn("cap", F.col("source_size").cast("double") * n)
           .withColumn("ratio", F.col("cap") / F.col("weight"))
           .withColumn("budget", F.sum("source_size").over(everything).cast("double") * share))
    by_ratio = everything.orderBy("ratio", "idx")
    per = (per.withColumn("before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
           .withColumn("level", (F.col("budget") - F.col("before"))
                       / F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
           .withColumn("first_free", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "idx", "level"))).over(everything))
           .withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("first_free.level") * F.col("weight"), F.col("cap")))))
    sources = common.stash(per.select("source", "idx", "weight", "source_size", "target", "budget"), "mix-sources")
    budget = sources.select("budget").first()
    budget = budget[0] if budget else 0.0

    # words of the source up to each document
    src = sources.select(F.col("source").alias("s"), "idx", "weight", "source_size")
    rows = common.stash(sizes.join(src, F.col("source").eqNullSafe(F.col("s"))).select("idx", "weight", "source_size", "__size", _order().alias("o")), "mix-rows")
    placed = _running(rows, ["idx"], ["o"], range_rows)
    queue = (placed.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(n)])))
             .select("idx", "epoch", "__size", "o",
                     ((F.col("epoch") * F.col("source_size") + F.col("upto")).cast("double") / F.col("weight")).alias("finish")))
    queue = common.stash(queue, "mix-queue")

    # the global order by finish time, cut at the budget
    taken = _running(queue, [], ["finish", "idx", "epoch", "o"], range_rows).filter(F.col("upto") <= F.lit(budget))
    cuts = taken.groupBy("idx").agg(*[F.max(F.when(F.col("epoch") == e, F.col("o"))).alias(f"cut_{e}") for e in range(n)])
    return Mix(sizes, common.stash(sources.join(cuts, "idx", "left"), "mix-cuts"), n)


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix, repeated as often as they are taken; same columns."""
    m = plan(docs, **settings)
    return (m.copies(sized(docs)).filter("__copies > 0")
            .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))


def op9(spark, sf_dir: str) -> DataFrame:
    m = plan(common.table(spark, sf_dir, "documents"))
    return m.copies(m.sizes).select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).cast("long").alias("taken"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS idx FROM s0),
s2 AS (SELECT *, CAST([5, 2, 1][(idx % 3) + 1] AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 3 AS cap,
              CAST(sum(source_size) OVER () AS DOUBLE) AS budget FROM s1),
s3 AS (SELECT *, cap / weight AS ratio FROM s2),
s4 AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY ratio, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
              / sum(weight) OVER (ORDER BY ratio, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s3),
free AS (SELECT level AS free_level FROM s4 WHERE ratio > level ORDER BY ratio, idx LIMIT 1),
s AS (SELECT *, least(cap, coalesce((SELECT free_level FROM free) * weight, cap)) AS target FROM s4),
q0 AS (SELECT d.*, s.idx, s.weight, s.source_size, s.target, s.budget,
              CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
       FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
q1 AS (SELECT q0.*, e, CAST(e * source_size + upto AS DOUBLE) / weight AS finish FROM q0, (VALUES (0), (1), (2)) t(e)),
q2 AS (SELECT *, sum(size) OVER (ORDER BY finish, idx, e, k, doc_id, size ROWS UNBOUNDED PRECEDING) AS total FROM q1)
SELECT doc_id, size, source_size, target,
       CAST(size * count(*) FILTER (WHERE total <= budget) AS BIGINT) AS taken
FROM q2 GROUP BY doc_id, k, size, source_size, target, source, upto
"""
