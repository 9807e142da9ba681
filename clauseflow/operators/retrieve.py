"""V1-V6: sampling, built-in encoder and exact / approximate k-nearest search.

Exact kNN (V3) compares every query with every corpus vector, like a flat
index: the cost is inherent to exact search.  Both sides are cut into blocks of
a bounded size and a task compares a few blocks of each: a matrix product rules
pairs out, the others are compared exactly; only the k best per query leave a
task and a final group-limit keeps the global k.  No pair table is made and
nothing is collected.  V6 has two approximate forms: cells (a
query visits the cells of its nearest centres only, for clustered vectors) and
product-quantised codes (a vector is a few bytes, a query compares itself to all
of them by looking up distances, and only the best are compared exactly).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from clauseflow.functions import lexicon as lx
from clauseflow.functions import textcols as tc
from clauseflow.session import sort_join, written


# -- V1 ---------------------------------------------------------------------------
def md5_rank_key(key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def deterministic_sample(df: DataFrame, key: str, n: int = lx.CORPUS_SAMPLE_SIZE, seed: int = 42,
                         prefix_hex: int = 3) -> DataFrame:
    """Fixed-size sample: the n rows with the smallest md5(seed|key); all rows if
    there are fewer.  Counts per hash prefix (16^prefix_hex at most) find the
    bucket that the cut falls in, so only that bucket is sorted."""
    d = df.withColumn("_h", md5_rank_key(F.col(key), seed)).withColumn("_b", F.substring("_h", 1, prefix_hex))
    before, cut = 0, None
    for r in d.groupBy("_b").count().orderBy(F.col("_b").asc_nulls_last()).collect():
        if before + r["count"] > n:
            cut = r["_b"]
            break
        before += r["count"]
    if cut is None:
        return d.drop("_h", "_b")
    edge = d.filter(F.col("_b") == cut).orderBy("_h", key).limit(n - before)
    return d.filter(F.col("_b") < cut).unionByName(edge).drop("_h", "_b")


# -- V2: built-in encoder ------------------------------------------------------------
def with_hashed_vector(df: DataFrame, text: str, out: str = "embedding", dim: int = 64) -> DataFrame:
    """Built-in text encoder (V2 default): unigram counts of the similarity-
    normalised text hashed into ``dim`` buckets by md5, L2-normalised.
    The sorted bucket list is materialised once per row; each bucket's count is
    its last minus first position (native array search, no per-bucket scan)."""
    toks = tc.unigrams(tc.similarity_norm(F.col(text)))
    bk = F.array_sort(F.transform(toks, lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 6), 16, 10).cast("long"),
                                                         F.lit(dim))))
    d = tc.with_computed(df, {"_bk": bk}).withColumn("_bkr", F.reverse("_bk"))
    counts = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long")), lambda b: F.when(
        F.array_contains(F.col("_bk"), b),
        F.size("_bk") - F.array_position(F.col("_bkr"), b) - F.array_position(F.col("_bk"), b) + 2)
        .otherwise(F.lit(0)).cast("double"))
    d = tc.with_computed(d, {"_cnt": counts})
    norm = F.sqrt(F.aggregate("_cnt", F.lit(0.0), lambda a, v: a + v * v))
    d = tc.with_computed(d, {"_nrm": norm})
    vec = F.when(F.col("_nrm") > 0, F.transform("_cnt", lambda v: v / F.col("_nrm"))).otherwise(F.col("_cnt"))
    return d.withColumn(out, vec).drop("_bk", "_bkr", "_cnt", "_nrm")


def encode_with_model(df: DataFrame, encode, text: str = "text", out: str = "embedding",
                      batch_size: int = lx.EMBED_BATCH_SIZE) -> DataFrame:
    """Caller-supplied encoder ``encode(list[str]) -> (n, dim)`` per Arrow batch."""
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches):
        for pdf in batches:
            vecs = []
            for s in range(0, len(pdf), batch_size):
                chunk = pdf[text].iloc[s:s + batch_size].fillna("").tolist()
                vecs.extend(np.asarray(encode(chunk), dtype=np.float32).tolist())
            yield pdf.assign(**{out: vecs})

    return df.mapInPandas(run, schema)


# -- V3: exact kNN by squared L2 --------------------------------------------------------
# What runs in Python workers is nested in functions: it travels whole, workers need not have this package.
#: Of a search: query rows of a matrix of distances, columns that give the first bounds, pairs compared exactly at a time,
#: full blocks of the corpus and of the queries that a task takes, pairs that are worth a task of their own.
CHUNK, FIRST, EXACT, CORPUS_BLOCKS, QUERY_BLOCKS, TASK_PAIRS = 256, 1024, 1 << 14, 16, 8, 1 << 28

_BLOCK = "_cell int, n int, ids binary, absent binary, vectors binary"


def _packer(block_rows: int, copies: int | None):
    """(_cell, _id, _v) rows -> blocks of ``block_rows`` rows of one cell, the rest of a
    partition in smaller ones.  Of equal vectors in a block only the first ``copies`` by id
    can be among the ``copies`` nearest of any query; the others are left out."""
    def matrix(vectors: pa.Array) -> np.ndarray:
        """The rows of a list column without nulls, which have to be of one length."""
        sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
        if len(sizes) and (sizes != sizes[0]).any():
            raise ValueError("vectors of different lengths")
        return vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(sizes), sizes[0] if len(sizes) else 0)

    schema = pa.schema([("_cell", pa.int32()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("ids", "absent", "vectors")]])

    def block(cell, ids, absent, x):
        if copies is not None and x.shape[1]:
            same = np.unique(np.ascontiguousarray(x).view(f"V{x.shape[1] * 8}").ravel(), return_inverse=True)[1]
            order = np.lexsort((ids, absent, same))
            start = np.flatnonzero(np.diff(same[order], prepend=-1))
            kept = np.sort(order[np.arange(len(x)) - np.repeat(start, np.diff(start, append=len(x))) < copies])
            ids, absent, x = ids[kept], absent[kept], x[kept]
        row = [cell, len(ids), ids.tobytes(), absent.tobytes(), x.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types)], schema=schema)

    def run(batches):
        waiting = {}
        for batch in batches:
            cells, ids, x = (batch.column(batch.schema.get_field_index(c)) for c in ("_cell", "_id", "_v"))
            absent = ids.is_null().to_numpy(zero_copy_only=False)
            cells, ids, x = cells.to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False), matrix(x)
            for cell in np.unique(cells):
                mine = cells == cell
                parts = waiting.setdefault(int(cell), [])
                parts.append((ids[mine], absent[mine], x[mine]))
                if sum(len(p[0]) for p in parts) >= block_rows:
                    whole = [np.concatenate(p) for p in zip(*parts)]
                    full = len(whole[0]) // block_rows * block_rows
                    for at in range(0, full, block_rows):
                        yield block(int(cell), *[p[at:at + block_rows] for p in whole])
                    waiting[int(cell)] = [tuple(p[full:] for p in whole)]
        for cell, parts in waiting.items():
            whole = [np.concatenate(p) for p in zip(*parts)]
            if len(whole[0]):
                yield block(cell, *whole)
    return run


def _best_of_blocks(k: int, round_decimals: int | None):
    """Pairs of a query block and a corpus block, one query block after the other -> the k best per query."""
    class Nearest:
        """The k best of each query of a block over the corpus blocks seen so far: by distance,
        then id (null ids last).

        A matrix product in single precision gives all distances of a block, and a bound on its
        error what can be among the k best; that is compared exactly, by the sum of squared
        differences."""

        def __init__(self, ids: np.ndarray, absent: np.ndarray, x: np.ndarray):
            self.ids, self.absent, self.x = ids, absent, x
            self.norms = (x * x).sum(axis=1)
            self.distance = np.full((len(x), k), np.inf)
            self.id, self.no_id, self.found = np.zeros((len(x), k), np.int64), np.ones((len(x), k), bool), np.zeros((len(x), k), bool)

        def meet(self, ids: np.ndarray, absent: np.ndarray, c: np.ndarray) -> None:
            length = c.shape[1]
            if self.x.shape[1] != length:
                raise ValueError("vectors of different lengths")
            with np.errstate(all="ignore"):  # odd vectors (infinite, not a number) are compared exactly
                norms = (c * c).sum(axis=1)
                reach = (np.sqrt(self.norms) + np.sqrt(norms[np.isfinite(norms)].max(initial=0.0))) ** 2  # of each query
                single = bool((reach < 1e30).all() and (reach > 1e-20).all())
                kind = np.float32 if single else np.float64
                slack = 4 * (length + 8) * np.finfo(kind).eps / 2 * reach + (0.0 if round_decimals is None else 10.0 ** -round_decimals)
                right = np.vstack([c.T, norms]).astype(kind)
                for at in range(0, len(self.x), CHUNK):
                    part = slice(at, at + CHUNK)
                    left = np.hstack([-2 * self.x[part], np.ones((len(self.x[part]), 1))]).astype(kind)
                    about = left @ right  # distance without the square of the query
                    bound = np.where(self.found[part, -1], self.distance[part, -1] - self.norms[part] + slack[part], np.inf)
                    if not np.isfinite(bound).all():
                        some = about[:, ::max(1, about.shape[1] // FIRST)]
                        if some.shape[1] >= k:
                            bound = np.fmin(bound, np.partition(some, k - 1, axis=1)[:, k - 1] + 2 * slack[part])
                    near = np.flatnonzero(~(about > bound.astype(kind)[:, None]))
                    for low in range(0, len(near), EXACT):
                        row, column = np.divmod(near[low:low + EXACT], about.shape[1])
                        row += at
                        gap = self.x[row] - c[column]
                        exact = np.einsum("ij,ij->i", gap, gap)
                        if round_decimals is not None:
                            exact = np.round(exact, round_decimals)
                        good = ~(self.found[row, -1] & (exact > self.distance[row, -1]))
                        if good.any():
                            self._add(row[good], column[good], exact[good], ids, absent)

        def _add(self, row, column, distance, ids, absent) -> None:
            touched = np.unique(row)
            old = self.found[touched]
            row = np.concatenate([np.repeat(touched, old.sum(axis=1)), row])
            distance = np.concatenate([self.distance[touched][old], distance])
            id_ = np.concatenate([self.id[touched][old], ids[column]])
            no_id = np.concatenate([self.no_id[touched][old], absent[column]])
            order = np.lexsort((id_, no_id, distance, row))
            start = np.flatnonzero(np.diff(row[order], prepend=-1))
            place = np.arange(len(row)) - np.repeat(start, np.diff(start, append=len(row)))
            order, place = order[place < k], place[place < k]
            row = row[order]
            self.distance[row, place], self.id[row, place], self.no_id[row, place], self.found[row, place] = distance[order], id_[order], no_id[order], True

        def rows(self) -> pa.RecordBatch:
            at = np.nonzero(self.found)
            return pa.RecordBatch.from_arrays([pa.array(self.ids[at[0]], pa.int64(), mask=self.absent[at[0]]),
                                               pa.array(self.id[at], pa.int64(), mask=self.no_id[at]), pa.array(self.distance[at])],
                                              names=["query_id", "clause_id", "distance"])

    def read(batch, side, i):
        n, ids, absent, x = (batch.column(batch.schema.get_field_index(f"{side}_{c}"))[i] for c in ("n", "ids", "absent", "vectors"))
        n = n.as_py()
        return np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(absent.as_buffer(), bool), np.frombuffer(x.as_buffer()).reshape(n, x.as_buffer().size // 8 // n)

    def run(batches):
        block = nearest = None
        for batch in batches:
            for i, b in enumerate(batch.column(batch.schema.get_field_index("q_block")).to_pylist()):
                if b != block:
                    if nearest is not None:
                        yield nearest.rows()
                    block, nearest = b, Nearest(*[v.copy() for v in read(batch, "q", i)])
                nearest.meet(*read(batch, "c", i))
        if nearest is not None:
            yield nearest.rows()
    return run


def _tiled_knn(queries: DataFrame, corpus: DataFrame, k: int, round_decimals: int | None, block_rows: int) -> DataFrame:
    """k best per query over (_cell, _id, _v) rows that meet in a cell.

    Both sides are packed into blocks of at most ``block_rows`` rows of a cell, in
    written tables.  A task takes a few blocks of each side and compares those of one cell
    pair by pair; blocks are read again for each task, not copied for it, so the disk
    holds each side about twice whatever its size.  Nothing passes through the driver but
    the two numbers of blocks and rows."""
    sides, sizes = [], []
    for side, name, copies in ((queries, "q", None), (corpus, "c", k)):
        packed = written(side.mapInArrow(_packer(block_rows, copies), _BLOCK).withColumn("block", F.monotonically_increasing_id()), "search-blocks")[0]
        sides.append(packed.select(*[F.col(c).alias(f"{name}{c if c == '_cell' else '_' + c}") for c in packed.columns]))
        sizes.append(packed.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).head())
    (q_blocks, q_rows), (c_blocks, c_rows) = sizes
    tasks = min(2 * queries.sparkSession.sparkContext.defaultParallelism, -(-q_rows * c_rows // TASK_PAIRS))
    c_parts = max(1, -(-c_rows // (CORPUS_BLOCKS * block_rows)))
    q_parts = max(1, -(-q_rows // (QUERY_BLOCKS * block_rows)), min(q_blocks, -(-tasks // c_parts)))
    c_parts = max(c_parts, min(c_blocks, -(-tasks // q_parts)))
    pairs = sides[0].repartition(q_parts).join(sides[1].repartition(c_parts).hint("shuffle_replicate_nl"), F.col("q_cell") == F.col("c_cell"))
    best = pairs.mapInArrow(_best_of_blocks(k, round_decimals), "query_id long, clause_id long, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "clause_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _tiles(queries: DataFrame, corpus: DataFrame, query_rows: int, corpus_rows: int):
    """Both sides grouped by tile: blocks of about so many rows of one cell."""
    n_q = queries.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("_nq"))
    n_c = corpus.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / corpus_rows).cast("int").alias("_nc"))
    blocks = F.broadcast(n_q.join(n_c, "_cell"))  # one row a cell

    def dealt(df, own, other, mine, theirs):
        d = df.join(blocks, "_cell").withColumn(mine, F.pmod(F.xxhash64("_id"), F.col(own)).cast("int"))
        return d.select("_cell", "_id", "_v", mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(theirs))
    tile = ["_cell", "_bq", "_bc"]
    return (dealt(queries, "_nq", "_nc", "_bq", "_bc").groupBy(*tile), dealt(corpus, "_nc", "_nq", "_bc", "_bq").groupBy(*tile))


def _side(df: DataFrame, id_col: str, vec: str, cell) -> DataFrame:
    return df.filter(F.col(vec).isNotNull()).select(cell.alias("_cell"), F.col(id_col).cast("long").alias("_id"),
                                                    F.col(vec).cast("array<double>").alias("_v"))


def knn_exact(queries: DataFrame, corpus: DataFrame, k: int = lx.RETRIEVAL_K, query_id: str = "query_id",
              corpus_id: str = "clause_id", vec: str = "embedding",
              round_decimals: int | None = None, block_rows: int = 4096) -> DataFrame:
    """V3: (query_id, rank 1..k, clause_id, distance) by squared L2, ties by clause_id.

    Every query block meets every corpus block, the cost of exact search; only
    the k best per query leave a task.  Missing hits (k larger than the corpus)
    simply give fewer rows (no -1 ids)."""
    one = F.lit(0)
    found = _tiled_knn(_side(queries, query_id, vec, one), _side(corpus, corpus_id, vec, one), k, round_decimals, block_rows)
    return found.withColumnsRenamed({"query_id": query_id, "clause_id": corpus_id})


# -- V4 / V5 -----------------------------------------------------------------------------
def assemble_hits(queries: DataFrame, hits: DataFrame, meta: DataFrame, query_id: str = "query_id",
                  corpus_id: str = "clause_id") -> DataFrame:
    """V5 + J4 + V4: ordered hit list per query with corpus metadata; queries
    without hits get an empty list."""
    h = sort_join(hits, meta, corpus_id)
    packed = (h.groupBy(query_id)
              .agg(F.array_sort(F.collect_list(F.struct("rank", corpus_id, *[c for c in meta.columns if c != corpus_id],
                                                        "distance"))).alias("hits")))
    out = sort_join(queries.select(query_id), packed, query_id, "left")
    return out.withColumn("hits", F.coalesce("hits", F.array().cast(packed.schema["hits"].dataType)))


# -- V6 -------------------------------------------------------------------------------------
def _vector_sample(corpus: DataFrame, vec: str, most_rows: int) -> np.ndarray:
    """At most ``most_rows`` vectors: the first ones by a hash of the vector."""
    got = corpus.filter(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>").alias("v"))
    rows = got.orderBy(F.xxhash64("v")).limit(most_rows).collect()
    return np.array([r["v"] for r in rows], float) if rows else np.empty((0, 0))


def _kmeans(x: np.ndarray, n: int, rounds: int, rng) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:n]]
    for _ in range(rounds):
        near = _nearest(x, centres)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = x[near == c].mean(axis=0)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x ** 2).sum(1)[:, None] - 2 * x @ centres.T + (centres ** 2).sum(1)).argmin(axis=1)


def coarse_centres(corpus: DataFrame, vec: str, n_cells: int, most_rows: int = 20_000, rounds: int = 8, seed: int = 42) -> np.ndarray:
    """Cell centres: k-means over a bounded sample (the first rows by a hash of
    the vector)."""
    x = _vector_sample(corpus, vec, min(most_rows, 64 * n_cells))
    return _kmeans(x, n_cells, rounds, np.random.default_rng(seed)) if len(x) else x


def knn_cells(queries: DataFrame, corpus: DataFrame, k: int = lx.RETRIEVAL_K, query_id: str = "query_id",
              corpus_id: str = "clause_id", vec: str = "embedding", n_cells: int = 16, n_probe: int = 12,
              block_rows: int = 4096) -> DataFrame:
    """V6: approximate neighbours for corpora past brute force.  The corpus is
    partitioned by nearest centre, a query visits its ``n_probe`` nearest cells,
    and the candidates there are ranked by exact squared L2.  The share of pairs
    compared is about n_probe / n_cells; recall is measured against
    ``knn_exact``, and n_probe = n_cells is exact."""
    spark = corpus.sparkSession
    centres = coarse_centres(corpus, vec, n_cells)
    if not len(centres):
        return knn_exact(queries, corpus, k, query_id, corpus_id, vec, block_rows=block_rows)
    shared = spark.sparkContext.broadcast(centres)

    def nearest(n):
        @F.pandas_udf("array<int>")
        def cells(v: pd.Series) -> pd.Series:
            if v.empty:
                return pd.Series([], dtype=object)
            x = np.stack(v.to_numpy()).astype(np.float64)
            c = shared.value
            d = -2 * x @ c.T + (c ** 2).sum(1)
            return pd.Series(list(np.argsort(d, axis=1, kind="stable")[:, :n].astype(np.int32)))
        return cells

    def celled(df, id_col, n):
        d = df.filter(F.col(vec).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(vec).cast("array<double>").alias("_v"))
        return d.select(F.explode(nearest(n)("_v")).alias("_cell"), "_id", "_v")
    found = _tiled_knn(celled(queries, query_id, min(n_probe, len(centres))), celled(corpus, corpus_id, 1), k, None, block_rows)
    return found.withColumnsRenamed({"query_id": query_id, "clause_id": corpus_id})


def code_books(corpus: DataFrame, vec: str, n_parts: int, n_centres: int = 256, most_rows: int = 20_000, rounds: int = 10,
               seed: int = 42) -> list[np.ndarray]:
    """One code book a part of the vector (``n_parts`` runs of components of about
    the same length): at most 256 centres by k-means over a bounded sample."""
    x = _vector_sample(corpus, vec, most_rows)
    rng = np.random.default_rng(seed)
    return [_kmeans(part, min(n_centres, 256), rounds, rng) for part in np.array_split(x, min(n_parts, x.shape[1]), axis=1)] if len(x) else []


def _best_codes_in_tile(books: list[np.ndarray], most: int, chunk: int = 64):
    """(queries, codes) of one tile -> the ``most`` best per query by looked-up distances."""
    ends = np.cumsum([b.shape[1] for b in books])[:-1]

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "clause_id": pd.Series([], dtype="int64"),
                                 "about": pd.Series([], dtype="float64")})
        c = c.sort_values("_id", kind="stable")
        codes = np.frombuffer(b"".join(c["_v"]), np.uint8).reshape(len(c), len(books))
        vectors, ids, out = np.stack(q["_v"].to_numpy()).astype(np.float64), c["_id"].to_numpy(), []
        kk = min(most, len(ids))
        for at in range(0, len(vectors), chunk):
            about = np.zeros((len(vectors[at:at + chunk]), len(ids)))
            for j, (part, book) in enumerate(zip(np.split(vectors[at:at + chunk], ends, axis=1), books)):
                table = (part ** 2).sum(1)[:, None] - 2 * part @ book.T + (book ** 2).sum(1)
                about += table[:, codes[:, j]]
            near = np.argpartition(about, kk - 1, axis=1)[:, :kk]
            out.append(pd.DataFrame({"query_id": np.repeat(q["_id"].to_numpy()[at:at + chunk], kk), "clause_id": ids[near].ravel(),
                                     "about": np.take_along_axis(about, near, axis=1).ravel()}))
        return pd.concat(out)
    return run


def knn_codes(queries: DataFrame, corpus: DataFrame, k: int = lx.RETRIEVAL_K, query_id: str = "query_id",
              corpus_id: str = "clause_id", vec: str = "embedding", n_parts: int = 12, rerank: int = 40,
              query_rows: int = 1024, corpus_rows: int = 1 << 16) -> DataFrame:
    """V6: approximate neighbours through product-quantised codes.

    The corpus becomes ``n_parts`` bytes a vector; only these are dealt out to the
    tiles.  A query makes a table of its distances to all centres once a tile, a
    distance is the sum of ``n_parts`` entries.  The ``rerank`` best of each query are
    joined to their vectors and ranked by exact squared L2, ties by id.  Per pair
    the work is n_parts / dimension of an exact distance, plus rerank exact ones a
    query; rerank >= corpus rows is exact.  Vectors are of one length; null
    vectors take no part, queries and corpus ids are unique, an empty corpus has
    no hits."""
    spark = corpus.sparkSession
    books = code_books(corpus, vec, n_parts)
    if not books:
        return knn_exact(queries, corpus, k, query_id, corpus_id, vec)
    ends = np.cumsum([b.shape[1] for b in books])[:-1]
    shared = spark.sparkContext.broadcast(books)

    @F.pandas_udf("binary")
    def encode(v: pd.Series) -> pd.Series:
        if v.empty:
            return pd.Series([], dtype=object)
        x = np.stack(v.to_numpy()).astype(np.float64)
        codes = np.stack([_nearest(part, book) for part, book in zip(np.split(x, ends, axis=1), shared.value)], axis=1)
        return pd.Series([row.tobytes() for row in codes.astype(np.uint8)])
    q, c = _side(queries, query_id, vec, F.lit(0)), _side(corpus, corpus_id, vec, F.lit(0))
    tiles = _tiles(q, c.select("_cell", "_id", encode("_v").alias("_v")), query_rows, corpus_rows)
    best = tiles[0].cogroup(tiles[1]).applyInPandas(_best_codes_in_tile(books, rerank), "query_id long, clause_id long, about double")
    near = Window.partitionBy("query_id").orderBy("about", "clause_id")
    best = best.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= rerank).select("query_id", "clause_id")
    pairs = sort_join(best, c.select(F.col("_id").alias("clause_id"), F.col("_v").alias("_c")), "clause_id")
    pairs = sort_join(pairs, q.select(F.col("_id").alias("query_id"), F.col("_v").alias("_q")), "query_id")
    gaps = F.zip_with("_q", "_c", lambda a, b: (a - b) * (a - b))
    pairs = pairs.select("query_id", "clause_id", F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x).alias("distance"))
    w = Window.partitionBy("query_id").orderBy("distance", "clause_id")
    found = pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return found.select("query_id", "clause_id", "distance", "rank").withColumnsRenamed({"query_id": query_id, "clause_id": corpus_id})
