"""Benchmark decontamination by size-partitioned MinHash containment search.

Benchmark items are partitioned by their number of shingles (16, 32, 64, ...).
Items of up to 16 shingles are too small a part of any window and are looked up
exactly: of their shingles so many are keys that a document that holds enough of
the item holds one of these.  For the longer items of up to ``m`` shingles every document is cut into windows of
``2 m`` shingles with stride ``m``, so that a short item, which is a tiny part
of a long document, is a large part of some window: a contained item has a
Jaccard similarity of at least 0.19 with it.  One MinHash value in common (64
functions, bands of one row) makes a candidate; a contained item is missed with
a probability of about 1e-6.  Candidates are verified by exact shingle
containment in the whole document.

Items reach the tasks by broadcast, in blocks of a bounded size; each block is
one narrow pass over the documents.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, wordhash

_U = np.uint64
#: MinHash functions x -> a x + b modulo 2**64.
FUNCTIONS = 64
_A = wordhash.mix(np.arange(1, FUNCTIONS + 1, dtype=_U) * _U(0xD6E8FEB86659FD93)) | _U(1)
_B = wordhash.mix(np.arange(1, FUNCTIONS + 1, dtype=_U) * _U(0xA0761D6478BD642F))
#: Shingles of a block, the unit of windows, and of the smallest size class.
BLOCK = 16
_SCHEMA = "doc_id long, t long, item_id long, n_item_shingles long, n_shared long, containment double"


class Items:
    """Shingle sets of a block of items, keys of the small ones and, by size class and function, MinHash values of the others."""

    def __init__(self, item_ids: list, texts: list, n: int, containment: float):
        hashes, starts = wordhash.words(pa.array(texts, pa.string()), wordhash.ALNUM_WORDS)
        shingle, at = wordhash.shingles(hashes, starts, n)
        self.ids, self.sets = [], []
        for i, item in enumerate(item_ids):
            got = wordhash.distinct(shingle[at[i]:at[i + 1]])
            if len(got):
                self.ids.append(item)
                self.sets.append(got)
        size = np.array([len(s) for s in self.sets], np.int64)
        blocks = 1 << np.maximum(0, np.ceil(np.log2(np.maximum(size, 1) / BLOCK))).astype(np.int64)
        keys, owners = [np.empty(0, _U)], [np.empty(0, np.int64)]
        for i in np.flatnonzero(size <= BLOCK):
            some = self.sets[i][:size[i] - max(1, int(np.ceil(containment * size[i] - 1e-9))) + 1]
            keys.append(some)
            owners.append(np.full(len(some), i))
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = keys.argsort()
        seen = np.zeros(1 << 16, bool)
        seen[keys >> _U(48)] = True
        #: sorted keys of the small items, their items, and a filter of their top bits
        self.small = (keys[order], owners[order], seen)
        #: class (blocks of an item) -> for each function: sorted values, their items, and a filter of their top bits
        self.classes = {}
        for m in np.unique(blocks[size > BLOCK]):
            members = np.flatnonzero((blocks == m) & (size > BLOCK))
            low = np.array([[(self.sets[i] * a + b).min() for i in members] for a, b in zip(_A, _B)])
            order = low.argsort(axis=1)
            low = np.take_along_axis(low, order, 1)
            seen = np.zeros((FUNCTIONS, 1 << 16), bool)
            for f in range(FUNCTIONS):
                seen[f, low[f] >> _U(48)] = True
            self.classes[int(m)] = (low, members[order], seen)


def candidates(shingle: np.ndarray, at: np.ndarray, items: Items) -> np.ndarray:
    """(row, item) pairs, as row * number of items + item, that share a small item's key, or a MinHash value in some window."""
    n_rows, n_items = len(at) - 1, len(items.sets)
    size = np.diff(at)
    blocks = -(-size // BLOCK)
    block_at = np.concatenate([[0], np.cumsum(blocks)])
    found = [np.empty(0, np.int64)]
    if not block_at[-1] or not n_items:
        return found[0]
    keys, owners, seen = items.small
    near = np.flatnonzero(seen[shingle >> _U(48)])
    lo = np.searchsorted(keys, shingle[near], "left")
    n_same = np.searchsorted(keys, shingle[near], "right") - lo
    k = np.repeat(lo - (np.cumsum(n_same) - n_same), n_same) + np.arange(n_same.sum())
    found.append(np.repeat(np.searchsorted(at, near, "right") - 1, n_same) * np.int64(n_items) + owners[k])
    if not items.classes:
        return wordhash.distinct(found[1])
    row = np.repeat(np.arange(n_rows), blocks)
    first = at[row] + (np.arange(block_at[-1]) - block_at[row]) * BLOCK
    # one column per block; a row's last block repeats the row's last shingle
    block = shingle[np.minimum(first + np.arange(BLOCK)[:, None], at[row + 1] - 1)]
    spans = {}
    for m in items.classes:
        count = np.maximum(-(-blocks // m) - 1, (blocks > 0).astype(np.int64))
        window_row = np.repeat(np.arange(n_rows), count)
        window = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        lo = block_at[window_row] + window * m
        hi = np.minimum(lo + 2 * m, block_at[window_row + 1])
        edges = np.empty(2 * len(lo), np.int64)
        edges[::2], edges[1::2] = lo, hi
        spans[m] = window_row, edges
    for f in range(FUNCTIONS):
        low = np.append((block * _A[f] + _B[f]).min(axis=0), _U(0))
        for m, (values, members, seen) in items.classes.items():
            window_row, edges = spans[m]
            least = np.minimum.reduceat(low, edges)[::2]
            near = np.flatnonzero(seen[f, least >> _U(48)])
            if not len(near):
                continue
            lo = np.searchsorted(values[f], least[near], "left")
            n_same = np.searchsorted(values[f], least[near], "right") - lo
            hit = np.repeat(near, n_same)
            k = np.repeat(lo - (np.cumsum(n_same) - n_same), n_same) + np.arange(n_same.sum())
            found.append(window_row[hit] * np.int64(n_items) + members[f][k])
    return wordhash.distinct(np.concatenate(found))


def _blocks(benchmark: DataFrame, most_items: int, most_bytes: int):
    """The benchmark's rows in blocks of a bounded size, one at a time."""
    rows = benchmark.select("item_id", "text").filter("text is not null").distinct()
    n, size, longest = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)),
                                F.coalesce(F.max(F.octet_length("text")), F.lit(0))).first()
    if longest > most_bytes:
        raise ValueError(f"a benchmark item of {longest} bytes is no short test item (limit {most_bytes})")
    parts = max(1, -(-2 * n // most_items), -(-2 * size // most_bytes))
    for k in range(parts):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) if parts > 1 else rows
        got = part.sort("item_id", "text").collect()
        if got:
            yield [r["item_id"] for r in got], [r["text"] for r in got]


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = 5, containment: float = 0.8,
          most_items: int = 20_000, most_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment) of every
    document that holds at least ``containment`` of an item's distinct
    ``n``-word shingles.

    Words are runs of letters and digits, A-Z as a-z, so case and punctuation
    don't matter.  An item of fewer than ``n`` words is one shingle, found only
    in a document of the same words.  Null or wordless texts on either side
    match nothing.  Rows that repeat a doc_id or item_id are compared row by
    row; equal rows of the benchmark count once."""
    return _leaks(docs, benchmark, n, containment, most_items, most_bytes).drop("t")


def _leaks(docs: DataFrame, benchmark: DataFrame, n: int = 5, containment: float = 0.8,
           most_items: int = 20_000, most_bytes: int = 32 << 20) -> DataFrame:
    """``leaks`` with t, the hash of the document's text."""
    spark = docs.sparkSession
    docs = docs.select(docs["doc_id"].cast("long"), docs["text"], F.xxhash64(docs["text"]).alias("t"))

    def search(block):
        def run(batches):
            items: Items = block.value
            for batch in batches:
                for part in wordhash.slices(batch, "text"):
                    hashes, starts = wordhash.words(part.column("text"), wordhash.ALNUM_WORDS)
                    shingle, at = wordhash.shingles(hashes, starts, n)
                    rows = {k: [] for k in ("row", "item", "size", "shared")}
                    last, own = -1, None
                    for pair in candidates(shingle, at, items).tolist():
                        r, i = divmod(pair, len(items.sets))
                        if r != last:
                            last, own = r, wordhash.distinct(shingle[at[r]:at[r + 1]])
                        want = items.sets[i]
                        place = np.minimum(np.searchsorted(own, want), len(own) - 1)
                        shared = int((own[place] == want).sum())
                        if shared >= containment * len(want):
                            for k, v in zip(rows, (r, items.ids[i], len(want), shared)):
                                rows[k].append(v)
                    if rows["row"]:
                        yield pa.RecordBatch.from_arrays(
                            [part.column("doc_id").take(pa.array(rows["row"])), part.column("t").take(pa.array(rows["row"])), pa.array(rows["item"], pa.int64()),
                             pa.array(rows["size"], pa.int64()), pa.array(rows["shared"], pa.int64()),
                             pa.array([a / b for a, b in zip(rows["shared"], rows["size"])])],
                            names=["doc_id", "t", "item_id", "n_item_shingles", "n_shared", "containment"])
        return docs.mapInArrow(run, _SCHEMA)

    found = [search(spark.sparkContext.broadcast(Items(ids, texts, n, containment)))
             for ids, texts in _blocks(benchmark, most_items, most_bytes)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], _SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``docs`` without the documents that hold an item (by doc_id).  While the
    leaks are few their ids are broadcast and no text is shuffled."""
    bad = common.stash(leaks(docs, benchmark, **settings).select(F.col("doc_id").alias("__leak")).distinct(), "leaks")
    bad = common.broadcast_up_to(bad)
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__leak"]), "left_anti")


def clean_rows(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``docs`` without the rows that hold an item, told apart by doc_id and text:
    clean rows of the same or no doc_id stay.  While the leaks are few their ids
    are broadcast and no text is shuffled."""
    bad = _leaks(docs, benchmark, **settings).select(F.col("doc_id").alias("__leak"), F.col("t").alias("__t")).distinct()
    bad = common.broadcast_up_to(common.stash(bad, "leaks"))
    same = docs["doc_id"].eqNullSafe(bad["__leak"]) & (F.xxhash64(docs["text"]) == bad["__t"])
    return docs.join(bad, same, "left_anti")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


OP5_SQL = r"""
WITH w AS (
  SELECT 0 AS side, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT DISTINCT side, id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ')
             ELSE array_to_string(ws[k : k + 4], ' ') END AS g
      FROM (SELECT side, id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS k FROM w WHERE len(ws) > 0)),
i AS (SELECT id AS item_id, g, count(*) OVER (PARTITION BY id) AS n FROM s WHERE side = 1)
SELECT s.id AS doc_id, item_id, n AS n_item_shingles, count(*) AS n_shared, count(*) / n AS containment
FROM s JOIN i USING (g) WHERE side = 0
GROUP BY s.id, item_id, n HAVING count(*) >= 0.8 * n
"""
