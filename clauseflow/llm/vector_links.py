"""Near-duplicate vectors by an exact metric range join.

Cosine >= t on unit vectors is a Euclidean distance of at most r = sqrt(2 - 2 t),
a metric.  Every vector belongs to the cell of its nearest pivot and is copied
to each cell of a lower number that could hold a vector within r of it: by the
triangle inequality, a cell whose pivot is nearer than the cell's radius plus r,
and within 2 r of the vector's own pivot distance.  So each pair meets in
exactly one cell, and cells are joined independently of one another.

A cell of any size is cut into blocks of about ``block`` vectors; a task
compares two blocks.  Tasks return link counts and a spanning forest of their
links, never the pairs, so a group of copies costs rows in proportion to its
size.  Equal vectors are compared once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common

#: Pivots at most; larger cells are cut into blocks, so the result does not depend on it.
MOST_PIVOTS = 1024
#: Distances get this slack, so that rounding never prunes a pair.
_SLACK = 1e-6


def _valid(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of a list column, all of one length, as unit vectors."""
    if not len(column):
        return np.empty((0, 0))
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ pivots.T), 0))


def _spread_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows of the sample, each the farthest from those before it."""
    chosen = [0]
    far = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def _join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merge the components of linked positions; a label is its component's smallest position."""
    while True:
        a, b = label[i], label[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if (low == high).all():
            return label
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _tile(nodes, weights, x, right, threshold, same) -> tuple[np.ndarray, np.ndarray]:
    """Link counts and component labels of one tile; ``right`` marks the rows of
    the second block (of the same block, if ``same``)."""
    left = np.flatnonzero(~right)
    other = left if same else np.flatnonzero(right)
    counts, label = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
    for at in range(0, len(left), 256):
        part = left[at:at + 256]
        i, j = np.nonzero(x[part] @ x[other].T >= threshold)
        i, j = part[i], other[j]
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            counts += np.bincount(i, weights[j], len(nodes)).astype(np.int64)
            counts += np.bincount(j, weights[i], len(nodes)).astype(np.int64)
            label = _join_labels(label, i, j)
    return counts, label


def _class_links(classes: DataFrame, threshold: float, block: int) -> DataFrame:
    """``classes(node, weight, v)``, vectors of one length, no two equal ->
    (node, n, other): link counts (other null) and forest edges (n 0)."""
    spark = classes.sparkSession
    n = classes.count()
    n_pivots = max(1, min(MOST_PIVOTS, -(-n // block)))
    drawn = classes.select("v").orderBy(F.xxhash64("v")).limit(4 * n_pivots).toArrow()
    pivots = _spread_pivots(_unit(drawn.column("v").combine_chunks()), n_pivots)
    radius = math.sqrt(max(2 - 2 * threshold, 0)) + _SLACK
    shared = spark.sparkContext.broadcast(pivots)

    def nearest(batches):
        for batch in batches:
            x = _unit(batch.column("v"))
            if len(x):
                d = _distances(x, shared.value)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node"), batch.column("weight"), pa.array([r.tobytes() for r in x], pa.binary()),
                     pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(x)), cell])],
                    names=["node", "weight", "x", "cell", "d"])
    placed = common.stash(classes.select("node", "weight", "v").mapInArrow(
        nearest, "node long, weight long, x binary, cell int, d double"), "vectors")
    reach = np.full(len(pivots), -1.0)  # the radius of each cell
    for r in placed.groupBy("cell").agg(F.max("d")).collect():
        reach[r[0]] = r[1]

    def copies(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([np.frombuffer(v.as_buffer()) for v in batch.column("x")])
            cell = batch.column("cell").to_numpy()
            d = _distances(x, shared.value)
            own = d[np.arange(len(x)), cell][:, None]
            near = (d <= reach + radius) & (d <= own + 2 * radius) & (np.arange(len(pivots)) < cell[:, None])
            row, to = np.nonzero(near)
            row, to = np.concatenate([np.arange(len(x)), row]), np.concatenate([cell, to])
            guest = np.arange(len(row)) >= len(x)
            for at in range(0, len(row), 8192):
                part = slice(at, at + 8192)
                take = pa.array(row[part])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").take(take), batch.column("weight").take(take), batch.column("x").take(take),
                     pa.array(to[part].astype(np.int32)), pa.array(guest[part])],
                    names=["node", "weight", "x", "cell", "guest"])
    members = placed.mapInArrow(copies, "node long, weight long, x binary, cell int, guest boolean")
    # blocks per cell: one row per pivot and kind, so at most 2 * MOST_PIVOTS rows
    counts = members.groupBy("cell", "guest").count().collect()
    blocks = {(r["cell"], r["guest"]): -(-r["count"] // block) for r in counts}
    tiles = spark.createDataFrame(
        [(c, g, k) for (c, g), k in blocks.items()] or [(-1, False, 1)], "cell int, guest boolean, blocks int")
    own = tiles.filter("not guest").select("cell", F.col("blocks").alias("own_blocks"))
    visiting = tiles.filter("guest").select("cell", F.col("blocks").alias("guest_blocks"))
    plan = own.join(visiting, "cell", "left").fillna(0, ["guest_blocks"])
    members = members.join(F.broadcast(plan), "cell")
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("guest"), F.col("guest_blocks")).otherwise(F.col("own_blocks"))).cast("int")

    def span(n, f):  # an array over 0 .. n - 1, empty for n = 0
        return F.transform(F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), F.lit(1), n), f)

    def tile(a, b, guest, right):
        return F.struct(a.alias("a"), b.alias("b"), guest.alias("g"), right.alias("right"))
    no, yes = F.lit(False), F.lit(True)
    blk = F.col("blk")
    as_member = F.concat(
        span(F.col("own_blocks"), lambda k: tile(F.least(k, blk), F.greatest(k, blk), no, k < blk)),
        span(F.col("guest_blocks"), lambda k: tile(blk, k, yes, no)))
    as_guest = span(F.col("own_blocks"), lambda k: tile(k, blk, yes, yes))
    dealt = (members.withColumn("blk", mine)
             .select("cell", "node", "weight", "x", F.explode(F.when(F.col("guest"), as_guest).otherwise(as_member)).alias("t"))
             .select("cell", "t.a", "t.b", "t.g", "t.right", "node", "weight", "x"))

    def compare(key, table):
        x = np.stack([np.frombuffer(v.as_buffer()) for v in table.column("x").combine_chunks()])
        nodes, weights = table.column("node").to_numpy(), table.column("weight").to_numpy()
        same = not key[3].as_py() and key[1].as_py() == key[2].as_py()
        counts, label = _tile(nodes, weights, x, table.column("right").to_numpy(zero_copy_only=False), threshold, same)
        linked, child = np.flatnonzero(counts), np.flatnonzero(label != np.arange(len(label)))
        return pa.table({
            "node": np.concatenate([nodes[linked], nodes[child]]),
            "n": np.concatenate([counts[linked], np.zeros(len(child), np.int64)]),
            "other": pa.array(np.concatenate([nodes[linked], nodes[label[child]]]),
                              mask=np.arange(len(linked) + len(child)) < len(linked))})
    return dealt.groupBy("cell", "a", "b", "g").applyInArrow(compare, "node long, n long, other long")


def links(vectors: DataFrame, threshold: float = 0.9, block: int = 4096) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links,
    component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, and vectors of different lengths not with each other.
    Equal vectors link with each other, repeated rows too.  A component's id
    is its smallest vec_id that is not null."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.withColumn("v", F.when(_valid(F.col("v")), F.col("v")))
    classes = common.stash(
        rows.filter("v is not null").groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"))
        .withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    found = None
    for size in sorted(r[0] for r in classes.select(F.size("v")).distinct().collect()):
        part = _class_links(classes.filter(F.size("v") == size), threshold, block)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "node long, n long, other long")
    found = common.stash(found, "vector-links")
    roots = common.connected_components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    per = (classes.join(counts, "node", "left").join(roots, "node", "left")
           .select("v", "first", F.coalesce("root", "node").alias("root"),
                   (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    first = per.groupBy("root").agg(F.min("first").alias("component_id"))
    per = per.join(first, "root").select(F.col("v").alias("__v"), "n_links", "component_id")
    return (rows.join(per, F.col("v") == F.col("__v"), "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.when(F.col("__v").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(common.table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
      ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings
      UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, vec_id = c.component_id AS kept
FROM embeddings JOIN c ON c.node = vec_id LEFT JOIN n ON n.a = vec_id
"""
