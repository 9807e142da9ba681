"""D1-D4 deduplication.

D1 keeps the first row of each exact (text, label) pair (window on the pair).

D2/D3 reproduce an *ordered greedy* rule: scan clauses in rank order and drop
one when its cosine with an already-kept clause of the same label (same
contract) reaches the threshold.  Done in three distributed steps:

1. **Collapse copies.**  Identical normalised texts in one (contract, label)
   have cosine 1, so every copy after the first is dropped whatever happens to
   the first (it shares all similarities).  A group of copies is settled by an
   aggregate (map-side combine), so a hot copy group never reaches one task.
2. **Similarity edges.**  TF-IDF (D2): weights from distributed counts
   (idf over the whole contract), candidate pairs only through *prefix* tokens —
   in a fixed token order (rarest first) a clause's prefix keeps every token
   except a tail whose L2 mass is below the threshold, so two unit vectors with
   cosine >= t always share a prefix token (exact filter, no cap).  From their
   first shared token on, the cosine is at most the product of what is left of
   the two vectors, which drops most pairs at the join (exact as well).  The rows
   of a frequent token are cut into blocks that meet pairwise, so no task gets
   all of them.  Candidates are verified with the exact dot product.  Whole idf
   groups go in slices, so that the disk holds the tokens of one slice at a time.  Dense vectors (D3): the group is
   cut into tiles; each tile pair is one task comparing two bounded blocks with
   numpy; only edges above the threshold are emitted.
3. **Greedy resolution.**  A clause is dropped if some earlier neighbour is
   kept and kept if every earlier neighbour is dropped; rounds of one join +
   aggregate settle clauses until none is open (each round is a written table).
   No group is ever folded inside a single task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clauseflow.functions import lexicon as lx
from clauseflow.functions import textcols as tc
from clauseflow.session import group_join, remove_written, sort_join, written

EPS = 1e-9
#: Clauses whose tokens are on disk at a time (about 1.7 kB of shuffle files each): contracts go in slices of about so many.
SLICE_ROWS = 1 << 20


# -- D1 ------------------------------------------------------------------------
def exact_dedup(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row (smallest ``order`` tuple, ascending) of every distinct
    ``keys`` tuple.  An aggregate of min(struct(order..., rest...)) — map-side
    combined, so one very large group of copies never lands on one task."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = F.min(F.struct(*[F.col(c) for c in order + rest])).alias("_first")
    out = df.groupBy(*keys).agg(first)
    return out.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in order + rest])


def unseen(new: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """J8 incremental form: rows of ``new`` whose keys are not in ``seen``."""
    return sort_join(new, seen.select(*keys).distinct(), keys, "left_anti")


# -- shared helpers -------------------------------------------------------------
def _ckpt(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder (lineage cut, survives executor loss)."""
    return written(df, "dedup")[0]


def resolve_dropped(nodes: DataFrame, edges: DataFrame, gk: list[str]) -> DataFrame:
    """Ids (gk..., id) dropped by the ordered greedy rule.

    nodes(gk..., id, st): st is K (settled kept), D (settled dropped) or U (open);
    edges(gk..., i, j): i earlier than j, both open.  Only nodes with an edge take
    part.  A round is one join and aggregate: an open node is dropped once an
    earlier neighbour is kept, and kept once all of them are dropped.  The first
    open node of a group is settled in every round, so rounds go on until none
    is open, however long the chains are; a round that settles nothing is an
    error.  The status table is written each round and the one before deleted."""
    spark = nodes.sparkSession
    dropped = nodes.filter(F.col("st") == "D").select(*gk, "id")
    edges, edges_path = written(edges.select(*gk, "i", "j"), "dedup-edges")
    ends = edges.select(*gk, F.col("i").alias("id")).unionByName(edges.select(*gk, F.col("j").alias("id"))).distinct()
    status, path = written(ends.withColumn("st", F.lit("U")), "dedup-status")
    still = status.count()
    while still:
        open_ = status.filter(F.col("st") == "U").select(*gk, F.col("id").alias("j"))
        earlier = status.select(*gk, F.col("id").alias("i"), F.col("st").alias("st_i"))
        seen = (sort_join(sort_join(edges, open_, [*gk, "j"], "left_semi"), earlier, [*gk, "i"]).groupBy(*gk, "j")
                .agg(F.max((F.col("st_i") == "K").cast("int")).alias("any_k"),
                     F.min((F.col("st_i") == "D").cast("int")).alias("all_d")))
        after = (sort_join(status, seen.withColumnRenamed("j", "id"), [*gk, "id"], "left")
                 .select(*gk, "id",
                         F.when(F.col("st") != "U", F.col("st"))
                         .when(F.col("any_k") == 1, F.lit("D"))
                         .when(F.col("all_d").isNull() | (F.col("all_d") == 1), F.lit("K"))
                         .otherwise(F.lit("U")).alias("st")))
        before, (status, new_path) = path, written(after, "dedup-status")
        remove_written(spark, before)
        path, left = new_path, status.filter(F.col("st") == "U").count()
        if left >= still:
            raise RuntimeError(f"a dedup round settled none of {still} open rows; are the edges ordered?")
        still = left
    remove_written(spark, edges_path)
    return dropped.unionByName(status.filter(F.col("st") == "D").select(*gk, "id"))


# -- D2: TF-IDF ---------------------------------------------------------------------
def tfidf_vectors(base: DataFrame, gk: list[str], threshold: float, norm: str = "_norm",
                  carry: list[str] | None = None) -> DataFrame:
    """One row per clause: (gk..., id, carry..., vec array<struct<tok, u, left, dfreq, pre>>)
    with u the L2-normalised tf-idf weight (idf = ln((1 + n) / (1 + df)) + 1, n and df
    over the ``gk`` group).  In rarest-first order, ``left`` is the L2 norm of the
    vector from that token on, and ``pre`` marks the prefix tokens (left >= threshold).

    Shuffles: df per (gk, tok) and its join back, then one regroup per clause,
    which the running mass and the vector share.  All passes over a clause are
    linear in its length.
    """
    carry = carry or []
    toks = tc.with_computed(base, {"_uni": tc.unigrams(norm)})
    toks = tc.with_computed(toks, {"_st": F.array_sort(F.concat("_uni", tc.bigrams_of("_uni")))})
    # where each run of equal tokens starts
    starts = F.filter(F.transform("_st", lambda t, i: F.when((i == 0) | (t != F.get(F.col("_st"), i - 1)), i)), lambda i: i.isNotNull())
    toks = tc.with_computed(toks, {"_at": starts})
    pairs = F.transform("_at", lambda at, k: F.struct(
        F.get(F.col("_st"), at).alias("tok"), (F.coalesce(F.get(F.col("_at"), k + 1), F.size("_st")) - at).alias("tf")))
    rows = toks.select(*gk, "id", *carry, F.explode(pairs).alias("p")).select(*gk, "id", *carry, "p.tok", "p.tf")
    dfreq = rows.groupBy(*gk, "tok").agg(F.count(F.lit(1)).alias("dfreq"))
    n = base.groupBy(*gk).agg(F.count(F.lit(1)).alias("n_docs"))
    w = (group_join(sort_join(rows, dfreq, [*gk, "tok"]), n, gk)
         .withColumn("w", F.col("tf") * (F.log((1 + F.col("n_docs")) / (1 + F.col("dfreq"))) + 1)))
    clause = Window.partitionBy(*gk, "id")
    mass = F.col("w") * F.col("w")
    w = w.withColumn("_all", F.sum(mass).over(clause))
    w = w.withColumn("_upto", F.sum(mass).over(clause.orderBy("dfreq", "tok").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    left = F.sqrt(F.greatest(F.col("_all") - F.col("_upto") + mass, F.lit(0.0)) / F.col("_all"))
    entry = F.struct("tok", (F.col("w") / F.sqrt("_all")).alias("u"), left.alias("left"), "dfreq", (left >= threshold - EPS).alias("pre"))
    # carried columns depend on the clause only: grouping by them avoids a join back
    return w.groupBy(*gk, "id", *carry).agg(F.collect_list(entry).alias("vec"))


def tfidf_candidates(vecs: DataFrame, cg: list[str], threshold: float, block_rows: int = 1024) -> DataFrame:
    """Pairs (cg..., i, j), i earlier by ``_ok``, that share a prefix token and whose
    vectors from there on can reach the threshold.

    A token of many clauses has its rows in ceil(df / block_rows) blocks; block x
    meets block y >= x in one tile, so a tile joins two bounded blocks.  A token of
    one clause has no pair and is left out."""
    pre = (vecs.select(*cg, "id", "_ok", F.explode(F.filter("vec", lambda x: x["pre"] & (x["dfreq"] > 1))).alias("x"))
           .select(*cg, "id", "_ok", F.col("x.tok").alias("tok"), F.col("x.left").alias("left"),
                   F.ceil(F.col("x.dfreq") / block_rows).cast("int").alias("nb")))
    pre = pre.withColumn("b", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    a = pre.withColumn("t1", F.col("b")).withColumn("t2", F.explode(F.sequence("b", F.col("nb") - 1)))
    b = pre.withColumn("t1", F.explode(F.sequence(F.lit(0), "b"))).withColumn("t2", F.col("b"))
    tile = [*cg, "tok", "t1", "t2"]
    a, b = (x.select(*tile, F.struct("_ok", "id").alias(n), F.col("left").alias(f"{n}_left")) for x, n in ((a, "x"), (b, "y")))
    near = F.col("x_left") * F.col("y_left") >= threshold - EPS
    once = (F.col("t1") < F.col("t2")) | (F.col("x._ok") < F.col("y._ok"))  # within a block a pair meets in both orders
    met = sort_join(a, b, tile).filter(near & once & (F.col("x._ok") != F.col("y._ok")))
    return met.select(*cg, F.least("x", "y")["id"].alias("i"), F.greatest("x", "y")["id"].alias("j")).distinct()


def _dot(a: str, b: str) -> Column:
    """Dot product of two sparse vectors array<struct<tok, u>>: equal tokens stand side by side once both are sorted together."""
    start = F.struct(F.lit(None).cast("string").alias("tok"), F.lit(0.0).alias("u"), F.lit(0.0).alias("sum"))
    both = F.array_sort(F.concat(a, b))
    step = lambda acc, e: F.struct(e["tok"].alias("tok"), e["u"].alias("u"),
                                   (acc["sum"] + F.when(acc["tok"] == e["tok"], acc["u"] * e["u"]).otherwise(0.0)).alias("sum"))
    return F.aggregate(both, start, step, lambda acc: acc["sum"])


def semantic_dedup_tfidf(df: DataFrame, gk: list[str], id_col: str, order_key: Column,
                         label: str = "label", text: str = "text",
                         threshold: float = lx.SEMANTIC_DEDUP_THRESHOLD) -> DataFrame:
    """D2 (+D4 guards): rows of ``df`` that survive TF-IDF greedy dedup.

    ``gk`` is the idf grain (e.g. contract); comparisons stay inside (gk, label);
    ``order_key`` (a comparable struct) gives the scan order, ``id_col`` is
    unique inside ``gk``.
    """
    src = _ckpt(df)          # cut the (long, lambda-heavy) lineage: every later plan stays small
    cg = [*gk, "_label"]
    # NULL labels form their own group (a sentinel keeps them joinable)
    base = src.select(*gk, F.col(id_col).cast("long").alias("id"),
                      F.coalesce(F.col(label).cast("string"), F.lit("\u0000")).alias("_label"),
                      order_key.alias("_ok"), tc.similarity_norm(F.col(text)).alias("_norm"))
    base = base.withColumn("_has_tok", F.size(tc.unigrams("_norm")) > 0)
    # 1. collapse copies: every copy after the first of a (gk, label, text) is dropped
    reps = (base.filter("_has_tok").groupBy(*cg, "_norm")
            .agg(F.min(F.struct("_ok", "id")).alias("_rep")).select(*cg, "_norm", F.col("_rep.id").alias("_rep_id")))
    base = sort_join(base, reps, [*cg, "_norm"], "left")
    base = base.withColumn("st", F.when(~F.col("_has_tok"), F.lit("K"))
                           .when(F.col("id") == F.col("_rep_id"), F.lit("U")).otherwise(F.lit("D")))
    base = _ckpt(base.drop("_rep_id"))
    # 2. vectors (idf over every clause of the group), candidates through prefix tokens; whole groups, some at a time
    slices = max(1, -(-base.count() // SLICE_ROWS))
    edges = []
    for k in range(slices):
        part = base if slices == 1 else base.filter(F.pmod(F.xxhash64(*gk), F.lit(slices)) == k)
        vecs = tfidf_vectors(part, gk, threshold, carry=["_label", "_ok", "st"])
        vecs, vecs_path = written(vecs.filter(F.col("st") == "U"), "dedup-vectors")
        # a token of one clause adds nothing to a product
        slim = F.transform(F.filter("vec", lambda x: x["dfreq"] > 1), lambda x: F.struct(x["tok"].alias("tok"), x["u"].alias("u")))
        met = sort_join(tfidf_candidates(vecs, cg, threshold), vecs.select(*gk, F.col("id").alias("i"), slim.alias("vi")), [*gk, "i"])
        near = (sort_join(met, vecs.select(*gk, F.col("id").alias("j"), slim.alias("vj")), [*gk, "j"])
                .filter(_dot("vi", "vj") >= F.lit(threshold)).select(*cg, "i", "j"))
        edges.append(written(near, "dedup-edges"))
        remove_written(src.sparkSession, vecs_path)
    # 3. greedy
    dropped = resolve_dropped(base.select(*cg, "id", "st"), reduce(DataFrame.unionByName, [e for e, _ in edges]), cg)
    for _, path in edges:
        remove_written(src.sparkSession, path)  # the rounds had a copy
    dropped = dropped.select(*gk, F.col("id").cast(src.schema[id_col].dataType).alias(id_col))
    return sort_join(src, dropped, [*gk, id_col], "left_anti")


# -- D3: dense embeddings ---------------------------------------------------------
def _tile_edges(threshold: float, n_order: int):
    """Edges of one tile; rows are ordered by (_o0, _o1, ..., id)."""
    order = [*[f"_o{k}" for k in range(n_order)], "id"]

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        right = (pdf["_side"] == "R").to_numpy()
        if right.all() or not right.any():
            return pd.DataFrame({"i": pd.Series([], dtype="int64"), "j": pd.Series([], dtype="int64")})
        # one rank for each distinct (order, id): in a tile of one block every row is there twice
        keys = [pdf[c].to_numpy() if c == "id" else pdf[c].fillna(np.inf).to_numpy() for c in order]
        place = np.lexsort(keys[::-1])
        rank = np.empty(len(pdf), np.int64)
        rank[place] = np.cumsum(np.append(False, np.any([k[place][1:] != k[place][:-1] for k in keys], axis=0)))
        vectors, ids = np.stack(pdf["_v"].to_numpy()).astype(np.float64), pdf["id"].to_numpy().astype("int64")
        a, b = np.nonzero(vectors[~right] @ vectors[right].T >= threshold)
        left_rank, right_rank, left_ids, right_ids = rank[~right][a], rank[right][b], ids[~right][a], ids[right][b]
        first = left_rank < right_rank
        other = left_rank != right_rank
        i, j = np.where(first, left_ids, right_ids)[other], np.where(first, right_ids, left_ids)[other]
        return pd.DataFrame({"i": i, "j": j}).drop_duplicates()
    return fn


def _bundle_edges(gk: list[str], threshold: float, n_order: int):
    """Edges of many whole groups; rows of a group are ordered by (_o0, _o1, ..., id)."""
    order = [*[f"_o{k}" for k in range(n_order)], "id"]

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        group = pdf.groupby(gk, sort=False, dropna=False).ngroup().to_numpy()
        keys = [group, *[pdf[c].to_numpy() if c == "id" else pdf[c].fillna(np.inf).to_numpy() for c in order]]
        place = np.lexsort(keys[::-1])
        keys = [k[place] for k in keys]
        rank = np.cumsum(np.append(False, np.any([k[1:] != k[:-1] for k in keys], axis=0)))
        vectors = np.stack(pdf["_v"].to_numpy()[place]).astype(np.float64)
        starts = np.flatnonzero(np.append(True, keys[0][1:] != keys[0][:-1]))
        first, second = [], []
        for at, end in zip(starts, np.append(starts[1:], len(place))):
            a, b = np.nonzero(vectors[at:end] @ vectors[at:end].T >= threshold)
            later = rank[at + a] < rank[at + b]
            first.append(at + a[later])
            second.append(at + b[later])
        i, j = np.concatenate(first), np.concatenate(second)
        return pdf[gk].iloc[place[i]].assign(i=keys[-1][i], j=keys[-1][j]).drop_duplicates()
    return fn


def dense_edges(df: DataFrame, gk: list[str], vec: str, order: list[str],
                threshold: float = lx.SEMANTIC_DEDUP_THRESHOLD, block_rows: int = 1024) -> DataFrame:
    """Pairs (i earlier than j by ``order``, ties by id) in the same ``gk`` group
    with dot >= threshold.  ``order`` are numeric columns; nulls come last.

    Rows of a larger group are hashed into ceil(n_group / block_rows) blocks; tile
    (b1, b2), b1 <= b2, is one applyInPandas group holding at most 2 * block_rows
    vectors.  Groups of at most block_rows rows are bundled, about block_rows rows
    to an applyInPandas group; a row alone in its group has no pair.
    """
    sizes = _ckpt(df.groupBy(*gk).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    small = F.when(F.col("_n") <= block_rows, F.col("_n"))
    total = sizes.agg(F.ceil(F.sum(small) / block_rows).alias("bundles"), F.max("_n").alias("largest")).head()
    d = (group_join(df, sizes, gk)
         .withColumn("_nb", F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(block_rows))).cast("int"))
         .withColumn("_b", F.pmod(F.xxhash64(F.col("id")), F.col("_nb")).cast("int")))
    base = [*gk, "id", F.col(vec).alias("_v"), *[F.col(c).cast("double").alias(f"_o{k}") for k, c in enumerate(order)]]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.select(*gk).schema.fields]
                       + ["i long", "j long"])
    bundles = d.filter("_nb = 1").select(*base, F.pmod(F.xxhash64(*gk), F.lit(total["bundles"] or 1)).alias("_bundle"))
    found = bundles.groupBy("_bundle").applyInPandas(_bundle_edges(gk, threshold, len(order)), schema)
    if (total["largest"] or 0) <= block_rows:
        return found
    d = d.filter("_nb > 1")
    as_left = d.select(*base, F.col("_b").alias("_t1"), F.explode(F.sequence(F.col("_b"), F.col("_nb") - 1)).alias("_t2"),
                       F.lit("L").alias("_side"))
    as_right = d.select(*base, F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_t1"), F.col("_b").alias("_t2"),
                        F.lit("R").alias("_side"))
    tiles = as_left.unionByName(as_right)
    fn = _tile_edges(threshold, len(order))

    def with_keys(key, pdf):
        out = fn(pdf)
        for name, val in zip(gk, key):
            out[name] = val
        return out[[*gk, "i", "j"]]

    return found.unionByName(tiles.groupBy(*gk, "_t1", "_t2").applyInPandas(
        lambda key, pdf: with_keys(key[:len(gk)], pdf), schema))


def _ranked(nodes: DataFrame, gk: list[str], order: list[str]) -> DataFrame:
    """``nodes`` with _rank, from 0 by ``order`` and id inside each group: a range
    sort of all rows, whose partitions' sizes (one row a partition) give the offsets."""
    by = [F.when(F.isnull(c) | F.isnan(F.col(c).cast("double")), F.lit(float("inf"))).otherwise(F.col(c).cast("double")) for c in order]
    keys = [*[F.col(c) for c in gk], *by, F.col("id")]
    placed = _ckpt(nodes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part, at = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before, offsets = 0, {}
    for r in placed.groupBy(part.alias("p")).count().orderBy("p").collect():
        offsets[r["p"]], before = before, before + r["count"]
    offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in offsets.items() for x in kv]), part)
    placed = placed.withColumn("_rank", offset + at)
    return group_join(placed, placed.groupBy(*gk).agg(F.min("_rank").alias("_from")), gk).withColumn("_rank", F.col("_rank") - F.col("_from")).drop("_at", "_from")


def _covered(rows: DataFrame, leaders: DataFrame, gk: list[str], vec: str, threshold: float, block_rows: int) -> DataFrame:
    """(gk..., id) of the rows that have dot >= threshold with a leader of their
    group; a task compares a block of rows with a block of leaders."""
    blocks = sort_join(rows.groupBy(*gk).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_nr")),
                       leaders.groupBy(*gk).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_nl")), gk)

    def dealt(df, own, other, mine, theirs):
        d = group_join(df.select(*gk, "id", F.col(vec).alias("_v")), blocks, gk).withColumn(mine, F.pmod(F.xxhash64("id"), F.col(own)).cast("int"))
        return d.select(*gk, "id", "_v", mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(theirs)).groupBy(*gk, "_r", "_l")

    def meet(r: pd.DataFrame, lead: pd.DataFrame) -> pd.DataFrame:
        if r.empty or lead.empty:
            return r[[*gk, "id"]].iloc[:0]
        a, b = (np.stack(x["_v"].to_numpy()).astype(np.float64) for x in (r, lead))
        return r.loc[(a @ b.T >= threshold).any(axis=1), [*gk, "id"]]
    tiles = dealt(rows, "_nr", "_nl", "_r", "_l"), dealt(leaders, "_nl", "_nr", "_l", "_r")
    return tiles[0].cogroup(tiles[1]).applyInPandas(meet, rows.select(*gk, "id").schema).distinct()


def _leader_rounds(nodes: DataFrame, gk: list[str], vec: str, order: list[str], threshold: float, block_rows: int, first: int) -> DataFrame:
    """(gk..., id) of the rows that the greedy rule keeps.  Round 0 takes the first
    ``first`` rows of each group, round b as many as all rounds before it."""
    block = F.when(F.col("_rank") < first, 0).otherwise(F.floor(F.log2(F.col("_rank") / first)) + 1).cast("int")
    ranked = _ckpt(_ranked(nodes, gk, order).withColumn("_round", block))
    leaders = None
    for b in range(ranked.agg(F.max("_round")).head()[0] + 1):
        rows = ranked.filter(F.col("_round") == b).drop("_rank", "_round")
        if leaders is not None:
            rows = _ckpt(sort_join(rows, _covered(rows, leaders, gk, vec, threshold, block_rows), [*gk, "id"], "left_anti"))
        dropped = resolve_dropped(rows.select(*gk, "id", F.lit("U").alias("st")), dense_edges(rows, gk, vec, order, threshold, block_rows), gk)
        kept = _ckpt(sort_join(rows, dropped, [*gk, "id"], "left_anti").select(*gk, "id", vec))
        leaders = kept if leaders is None else leaders.unionByName(kept)
    return leaders.select(*gk, "id")


def semantic_dedup_embedding(df: DataFrame, gk: list[str], id_col: str, order: list[Column | str] | str,
                             vec: str = "embedding", threshold: float = lx.SEMANTIC_DEDUP_THRESHOLD,
                             block_rows: int = 1024, first: int = 4096) -> DataFrame:
    """D3: ordered greedy dedup on unit embeddings inside ``gk`` groups.  ``order``
    are numeric columns, smaller first; rows that tie in all of them go by id.
    Groups of more than ``first`` rows go in rounds, with the same result; a row
    with a null in ``gk`` is in no group and stays."""
    src = _ckpt(df)
    order = [F.col(c) if isinstance(c, str) else c for c in ([order] if isinstance(order, str) else order)]
    names = [f"_ord{k}" for k in range(len(order))]
    nodes = src.select(*gk, F.col(id_col).cast("long").alias("id"), *[c.alias(n) for c, n in zip(order, names)], vec)
    in_group = F.lit(True)
    for c in gk:
        in_group = in_group & F.col(c).isNotNull()
    largest = nodes.filter(in_group).groupBy(*gk).count().agg(F.max("count")).head()[0] or 0
    if largest <= first:
        edges = dense_edges(nodes, gk, vec, names, threshold, block_rows)
        dropped = resolve_dropped(nodes.select(*gk, "id", F.lit("U").alias("st")), edges, gk)
    else:
        nodes = nodes.filter(in_group)
        kept = _leader_rounds(nodes, gk, vec, names, threshold, block_rows, first)
        dropped = sort_join(nodes.select(*gk, "id"), kept, [*gk, "id"], "left_anti")
    dropped = dropped.select(*gk, F.col("id").cast(src.schema[id_col].dataType).alias(id_col))
    return sort_join(src, dropped, [*gk, id_col], "left_anti")
