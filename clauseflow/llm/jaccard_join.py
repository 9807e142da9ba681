"""N-gram Jaccard join by a token-group matrix.

Documents are sets of word shingles ("tokens" below).  Equal sets are one class.
Classes that share a MinHash value are candidates for a star: each is verified
against the most typical of them, so a family of copies is linked by one pair a
class.  Classes of one such head and of nearly one size are a group, those that
are linked apart from the loose ones.  The token-group matrix holds, per token,
the groups whose members have it among their rarest tokens.  A class queries it
with its own rarest tokens: how many of them a similar set must share follows
from the sizes, so the number of matching tokens bounds the overlap with every
member of a group, and only groups that reach the bound are opened.  Classes
that open each other's group and are not linked yet are verified exactly.  A
group of copies is one column of the matrix, so it costs rows in proportion to
its size.

Rarity is the number of occurrences of all tokens in a token's hash bucket,
over all documents; any order would give the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common, wordhash

_U = np.uint64
#: Buckets of the rarity counts; a fixed size that is broadcast.
RARITY_BITS = 18
#: MinHash values per document, used to form groups only.
SKETCH = 4
#: Sizes in a group differ by this factor (1 + BAND) at most.
BAND = 0.004
_SEEDS = wordhash.mix(np.arange(1, SKETCH + 1, dtype=_U) * _U(0x8CB92BA72F3D8DD7))
_PROFILE = ("doc_id long, t long, n long, f1 long, f2 long, rare array<long>, sketch array<long>, common double")
#: What tells classes apart: the size and 128 bits of a set.
_KEY = ["n", "f1", "f2"]


def _tokens(part: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    hashes, starts = wordhash.words(part.column("text"), wordhash.WHITESPACE_WORDS)
    return wordhash.shingles(hashes, starts, n)


def rarity(docs: DataFrame, n: int) -> np.ndarray:
    """Occurrences of all tokens of all documents by the top bits of their hash."""
    shift = _U(64 - RARITY_BITS)

    def fold(batches):
        total = np.zeros(1 << RARITY_BITS, np.int64)
        for batch in batches:
            for part in wordhash.slices(batch, "text"):
                total += np.bincount((_tokens(part, n)[0] >> shift).astype(np.int64), minlength=1 << RARITY_BITS)
        return total
    return common.sum_arrays(docs.select("text"), fold, 1 << RARITY_BITS)


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate([np.empty(0, np.int64), *values]).astype(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _distinct_rows(token: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct tokens of each row, and where they start; sorts in place."""
    for i in range(len(at) - 1):
        token[at[i]:at[i + 1]].sort()
    new = np.append(True, token[1:] != token[:-1])[:len(token)]
    new[at[:-1][at[:-1] < len(token)]] = True
    return token[new], np.append(0, np.cumsum(new))[at] if len(token) else at


def _prints(token: np.ndarray, full: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """128 bits for each row's set, by sums over its members; 0 for no tokens."""
    out = []
    for salted in (token ^ _U(0x243F6A8885A308D3), token + _U(0x13198A2E03707344)):
        sums = np.zeros(size, _U)
        if len(full):
            sums[full] = np.add.reduceat(wordhash.mix(salted), at[:-1][full])
        out.append(sums.view(np.int64))
    return out


def _profiles(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    counts = rarity(docs, n)
    #: occurrences on a logarithmic scale, as the high bits of an order of tokens
    scale = docs.sparkSession.sparkContext.broadcast((np.log2(counts + 1.0) * 64).astype(_U) << _U(52))
    shift = _U(64 - RARITY_BITS)

    def run(batches):
        for batch in batches:
            for part in wordhash.slices(batch, "text"):
                token, at = _distinct_rows(*_tokens(part, n))
                size = np.diff(at)
                full = np.flatnonzero(size)
                seen = scale.value[(token >> shift).astype(np.int64)]
                order = seen | token >> _U(12)
                least = -(-num * size // den)  # the overlap that any similar set has with this one
                most = np.minimum(size, size - least + 4 + size // 24)
                rare = []
                for i in range(len(size)):
                    own = slice(at[i], at[i + 1])
                    keep = token[own] if most[i] == size[i] else token[own][np.argpartition(order[own], most[i])[:most[i]]]
                    rare.append(keep.view(np.int64))
                f1, f2 = _prints(token, full, at, len(size))
                common_ = np.zeros(len(size))
                sketch = np.zeros((len(size), SKETCH), np.int64)
                if len(full):
                    common_[full] = np.add.reduceat((seen >> _U(52)).astype(float), at[:-1][full]) / size[full]
                    for k, seed in enumerate(_SEEDS):
                        sketch[full, k] = np.minimum.reduceat(wordhash.mix(token ^ seed), at[:-1][full]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("t"), pa.array(size.astype(np.int64)), pa.array(f1), pa.array(f2),
                     _lists(rare), _lists(list(sketch)), pa.array(common_)],
                    names=["doc_id", "t", "n", "f1", "f2", "rare", "sketch", "common"])
    return common.stash(docs.withColumn("t", F.xxhash64("text")).mapInArrow(run, _PROFILE), "jaccard-profiles")


def _sets(docs: DataFrame, wanted: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """(node, tokens) of the classes ``wanted(node)``, from the text of each
    class's first document.  Only these documents' texts are read into sets;
    where there are few of them, no other text is shuffled."""
    place = common.stash(classes.select("node", "first", "t", *_KEY).join(wanted, "node"), "jaccard-wanted")
    ids = common.broadcast_up_to(place.select("first").distinct())
    some = docs.withColumn("t", F.xxhash64("text"))
    some = some.join(ids, some["doc_id"].eqNullSafe(ids["first"]), "left_semi")

    def run(batches):
        for batch in batches:
            for part in wordhash.slices(batch, "text"):
                token, at = _distinct_rows(*_tokens(part, n))
                size = np.diff(at)
                f1, f2 = _prints(token, np.flatnonzero(size), at, len(size))
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(token.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(size.astype(np.int64)), pa.array(f1), pa.array(f2), lists],
                                                 names=[*_KEY, "tokens"])
    found = some.mapInArrow(run, "n long, f1 long, f2 long, tokens array<long>")
    names = common.broadcast_up_to(place.select("node", *_KEY))
    return common.stash(found.join(names, _KEY).select("node", "tokens").dropDuplicates(["node"]), "jaccard-sets")


def _similar_sizes(a: Column, b: Column, num: int, den: int) -> Column:
    return F.least(a, b) * den >= F.greatest(a, b) * num


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets are similar enough."""
    pairs = common.stash(pairs, "jaccard-pairs")
    sets = _sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), classes, n)
    one = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return common.stash(
        pairs.join(one, "a").join(two, "b").withColumn("both", both)
        .filter(F.col("both") * den >= (F.size("ta") + F.size("tb") - F.col("both")) * num).select("a", "b"), "jaccard-links")


def _need(n: Column, smallest: Column, largest: Column, num: int, den: int) -> Column:
    """How many rare tokens a class of ``n`` tokens shares at least with a
    similar one of ``smallest`` to ``largest`` tokens.

    If sets of a and b tokens have x in common, the first x - (a - p) of these
    in the order of rarity are among the p rarest of the one, and likewise for
    the other.  x grows with the other's size and the rest of its bound is
    concave in it up to rounding, so the ends of the range decide; within a
    range, 2 are taken off for rounding."""
    low = F.greatest(smallest, F.ceil(n * num / den))
    high = F.least(largest, F.floor(n * den / num))

    def common_with(m):
        return F.ceil((n + m) * num / (num + den))

    def missing(m):  # p - size: how far the rare tokens fall short of all
        return F.least(F.lit(0), F.floor(m / 24) + 4 - F.ceil(m * num / den))
    least = F.least(missing(n) + common_with(low), missing(low) + common_with(low), missing(high) + common_with(high))
    return F.greatest(F.lit(1), least - F.when(low < high, 2).otherwise(0))


def _candidates(entries: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) to verify, from ``entries(token, node, n, own, part, loose)``:
    classes of different parts (not yet linked) of which each opens the other's
    group.  ``own`` is a class's group, ``loose`` that its members are no part."""
    entries = common.stash(entries, "jaccard-entries")
    matrix = entries.groupBy("token", F.col("own").alias("other")).agg(F.count("*").alias("holders"))
    sizes = entries.groupBy(F.col("own").alias("other")).agg(F.min("n").alias("smallest"), F.max("n").alias("largest"))
    matrix = matrix.join(sizes, "other")
    meets = ((F.col("other") != F.col("own")) | F.col("loose") & (F.col("holders") > 1)) \
        & (F.col("largest") * den >= F.col("n") * num) & (F.col("n") * den >= F.col("smallest") * num)
    one = entries.withColumnRenamed("token", "t")
    opened = (one.join(matrix, (one["t"] == matrix["token"]) & meets)
              .groupBy("node", "n", "own", "part", "other", "smallest", "largest").agg(F.count("*").alias("matching"))
              .filter(F.col("matching") >= _need(F.col("n"), F.col("smallest"), F.col("largest"), num, den))
              .select("node", "n", "own", "part", "other"))
    opened = common.stash(opened, "jaccard-opened")
    # groups that open each other, by parts: a large linked part is one row
    cell = opened.select("own", "other", "part").distinct()
    back = cell.select(F.col("own").alias("other"), F.col("other").alias("own"), F.col("part").alias("part_b"))
    cells = cell.join(back, ["own", "other"]).filter("part < part_b")
    two = opened.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("own").alias("other"),
                        F.col("other").alias("own"), F.col("part").alias("part_b"))
    return (cells.join(opened, ["own", "other", "part"]).join(two, ["own", "other", "part_b"])
            .filter(_similar_sizes(F.col("n"), F.col("nb"), num, den))
            .select(F.col("node").alias("a"), "b").distinct())


def members(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of ``docs``: doc_id, t (hash of the text), n_shingles,
    root (a number for each component; null for a text without words) and
    component_id.

    Two documents link when den * |intersection| >= num * |union| of their
    distinct ``n``-word shingles (words: runs of anything but ASCII white
    space, A-Z as a-z).  Fewer than ``n`` words are one shingle; null, empty
    and wordless texts link with nothing and are their own component.  Rows
    that repeat a doc_id are compared each by its own text.  A component's id
    is its smallest doc_id that is not null."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    profiles = _profiles(docs, n, num, den)
    key = _KEY
    classes = common.stash(
        profiles.filter("n > 0").groupBy(*key)
        .agg(F.min(F.struct("doc_id", "t")).alias("p"), F.min("doc_id").alias("least"), F.first("rare").alias("rare"),
             F.first("sketch").alias("sketch"), F.first("common").alias("common"))
        .select(*key, F.col("p.doc_id").alias("first"), F.col("p.t").alias("t"), "least", "rare", "sketch", "common",
                F.monotonically_increasing_id().alias("node")), "jaccard-classes")

    # rare tokens that several classes have, of classes that have enough of them
    rare = classes.select("node", "n", F.explode("rare").alias("token")).repartition("token")
    shared = rare.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("token")
    rare = common.stash(rare.join(shared, "token").select("token", "node", "n"), "jaccard-rare")
    enough = (rare.groupBy("node", "n").agg(F.count("*").alias("matching"))
              .filter(F.col("matching") >= _need(F.col("n"), F.lit(1), F.lit(1 << 62), num, den)).select("node"))
    rare = common.stash(rare.join(enough, "node").select("token", "node", "n"), "jaccard-rare")
    active = rare.select("node", "n").distinct()

    # stars: of the classes that share a MinHash value, the most typical one and those similar to it
    sketch = classes.join(active.select("node"), "node", "left_semi").select("node", "n", "common", F.posexplode("sketch").alias("k", "h"))
    head = (sketch.groupBy("k", "h").agg(F.max(F.struct("common", "n", "node")).alias("head"), F.count("*").alias("members"))
            .filter("members > 1").select("k", "h", "head"))
    headed = common.stash(sketch.join(head, ["k", "h"]).select("node", "n", "head"), "jaccard-heads")
    stars = (headed.filter(F.col("node") != F.col("head.node"))
             .filter(_similar_sizes(F.col("n"), F.col("head.n"), num, den))
             .select(F.col("node").alias("a"), "n", F.col("head.node").alias("b"), F.col("head.n").alias("nb")).distinct())
    stars = (stars.join(rare.select(F.col("node").alias("a"), "token"), "a")
             .join(rare.select(F.col("node").alias("b"), "token"), ["b", "token"])
             .groupBy("a", "b", "n", "nb").agg(F.count("*").alias("matching"))
             .filter(F.col("matching") >= _need(F.col("n"), F.col("nb"), F.col("nb"), num, den)).select("a", "b"))
    links = _verified(stars, docs, classes, n, num, den)
    linked = common.connected_components(links)

    # groups: the most typical head that a class has, a band of sizes, and the linked part or none
    anchor = headed.groupBy("node").agg(F.max("head")["node"].alias("anchor"))
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(1.0 + BAND)))
    member = (active.join(anchor, "node", "left").join(linked, "node", "left")
              .select("node", F.xxhash64(F.coalesce("anchor", "node"), band, "root").alias("own"),
                      F.coalesce("root", "node").alias("part"), F.col("root").isNull().alias("loose")))
    pairs = _candidates(rare.join(member, "node"), num, den)
    links = links.unionByName(_verified(pairs, docs, classes, n, num, den))

    roots = common.connected_components(links)
    per = classes.select("node", "least", *key).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = per.groupBy("root").agg(F.min("least").alias("component_id"))
    per = per.join(ids, "root").select(*[F.col(k).alias(f"c_{k}") for k in key], "root", "component_id")
    rows = profiles.select("doc_id", "t", *key)
    same = (F.col("n") == F.col("c_n")) & (F.col("f1") == F.col("c_f1")) & (F.col("f2") == F.col("c_f2"))
    return (rows.join(per, same, "left")
            .select("doc_id", "t", F.col("n").alias("n_shingles"), "root",
                    F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def components(docs: DataFrame, **settings) -> DataFrame:
    """``members`` as doc_id, n_shingles, component_id."""
    return members(docs, **settings).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest
    doc_id (null last), of rows that repeat it the one with the smallest text
    hash.  Texts without words all stay.  Rows that repeat both id and text
    stay once."""
    rows = common.stash(members(docs, **settings), "jaccard-members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t")).alias("first")
    stay = rows.filter("root is not null").groupBy("root").agg(first).select("first.doc_id", "first.t")
    gone = (rows.filter("root is not null").select("doc_id", "t").distinct()
            .join(stay.withColumnsRenamed({"doc_id": "i", "t": "u"}), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("t") == F.col("u")), "left_anti")
            .select(F.col("doc_id").alias("__id"), F.col("t").alias("__t")))
    gone = common.broadcast_up_to(common.stash(gone, "jaccard-gone"))
    kept = docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]) & (F.xxhash64(docs["text"]) == gone["__t"]), "left_anti")
    again = common.stash(rows.groupBy("doc_id", "t").count().filter("count > 1").select(F.col("doc_id").alias("__id"), F.col("t").alias("__t")), "jaccard-again")
    if again.isEmpty():
        return kept
    # only rows that repeat are combined, in the tasks that read them first; the others are not moved
    again = common.broadcast_up_to(again)
    repeats = kept["doc_id"].eqNullSafe(again["__id"]) & (F.xxhash64(kept["text"]) == again["__t"])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    first = (kept.join(again, repeats, "left_semi").groupBy(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__t"))
             .agg(F.min(F.struct(*columns)).alias("__row")).select(*[F.col(f"__row.`{c}`") for c in docs.columns]))
    return kept.join(again, repeats, "left_anti").unionByName(first)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(common.table(spark, sf_dir, "documents"), n=3, num=90, den=100)


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ')
             ELSE array_to_string(ws[k : k + 2], ' ') END AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS k FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id
FROM documents JOIN c ON c.node = doc_id LEFT JOIN n USING (doc_id)
"""
