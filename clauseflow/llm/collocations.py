"""Phrase collocations by vertical partitioning of a truncated suffix tree.

1. Words are counted; a word is the 64-bit id of its language and spelling.
2. The tree's prefixes of two words are counted.  A prefix that is not frequent
   ends there, as no longer phrase can be frequent.
3. Prefixes are put in groups of about ``BUDGET`` suffixes; a prefix that is too
   large for its share of a group is extended to whole suffixes, which spreads it
   over all groups.  Suffixes are cut at ``longest`` words or before the first
   infrequent pair; a task sends each group its prefixes' suffixes, equal ones
   once, as one block.
4. Each group on its own sorts its suffixes, which is its subtrees in depth-first
   order, and reads the count of every node off the totals of the leaves below
   it.  One group at a time is in memory.

Which words and pairs are frequent reaches the tasks as bitmaps of a fixed
size.  A bit that two of them share keeps a few suffixes too many, whose counts
then show that they are not frequent.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from . import common, wordhash

#: Word bytes are 1; blanks separate words, the others also end a piece.
_BREAKS = [ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]
_WORDS = np.ones(256, np.uint8)
_WORDS[[0x20, 0x09, *_BREAKS]] = 0
_ENDS = np.zeros(256, np.int32)
_ENDS[_BREAKS] = 1

#: Suffixes that a group takes on average.
BUDGET = 4_000_000
#: Bits of the bitmaps of frequent words and frequent pairs: 2 MB and 16 MB, whatever the data.
WORD_BITS, PAIR_BITS = 24, 27
#: Words that a task counts at once.
_AT_ONCE = 1 << 20
_U = np.uint64


def _language(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


class _Words:
    """Words of a slice of rows: ids, whether the next word follows in the same piece, and spellings."""

    def __init__(self, part: pa.RecordBatch):
        text, lang = part.column("text"), part.column("lang").fill_null("und").dictionary_encode()
        self.buf, at = wordhash.text_buffer(text)
        hashes, self.start, self.stop = wordhash.located(text, _WORDS)
        self.names = lang.dictionary.to_pylist()
        self.row_lang = lang.indices.to_numpy()
        counts = np.diff(np.searchsorted(self.start, at, "left"))
        row = np.repeat(np.arange(part.num_rows), counts)
        salt = np.array([_language(x) for x in self.names], _U)[self.row_lang]
        self.lang = self.row_lang[row]
        self.ids = wordhash.mix(hashes ^ wordhash.mix(salt[row]))
        self.ids[self.ids == 0] = 1  # 0 stands for no word
        ends = np.concatenate([[0], np.cumsum(_ENDS[self.buf])])[self.start]
        self.follows = (row[1:] == row[:-1]) & (ends[1:] == ends[:-1])

    def spelling(self, i: int) -> str:
        return wordhash.LOWER_ASCII[self.buf[self.start[i]:self.stop[i]]].tobytes().decode()


def _each(batches):
    for batch in batches:
        for part in wordhash.slices(batch, "text"):
            yield _Words(part)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def words(docs: DataFrame, least: int) -> DataFrame:
    """(id, lang, word, n) of every word with ``least`` occurrences in its
    language, and one row with the null word per language, whose n counts all."""
    schema = "id long, lang string, word string, n long"

    def count(batches):
        for w in _each(batches):
            ids, first, n = np.unique(w.ids, return_index=True, return_counts=True)
            totals = np.bincount(w.lang, minlength=len(w.names))
            names = pa.array(w.names, pa.string())
            lang = pa.concat_arrays([names.take(pa.array(w.lang[first])), names])
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([_signed(ids), _signed(np.array([_language(x) for x in w.names], _U))]), lang,
                 pa.array([w.spelling(i) for i in first] + [None] * len(w.names), pa.string()),
                 pa.array(np.concatenate([n, totals]).astype(np.int64))], names=["id", "lang", "word", "n"])
    return (docs.select("lang", "text").mapInArrow(count, schema).groupBy("id", "lang", "word").agg(F.sum("n").alias("n"))
            .filter(F.col("word").isNull() | (F.col("n") >= least)))


def _key(*ids: np.ndarray) -> np.ndarray:
    out = np.full(len(ids[0]), _U(len(ids)), _U)
    for k, x in enumerate(ids):
        out = wordhash.mix(out + x * _U(2 * k + 3))
    return out


def _bitmap(df: DataFrame, bits: int, block_bits: int = 18) -> np.ndarray:
    """Bitmap over the top ``bits`` bits of ``df(key long)``.  Each block of it is
    made in one task; all of it, at most 2 ** bits bits, comes to the driver."""
    spread = df.select(F.shiftrightunsigned("key", 64 - bits).alias("slot"))
    spread = spread.withColumn("block", F.shiftright("slot", block_bits).cast("int"))

    def build(batches):
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            slot, block = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("slot", "block"))
            for b in np.unique(block).tolist():
                bitmap = made.setdefault(b, np.zeros(1 << (block_bits - 3), np.uint8))
                s = slot[block == b] & ((1 << block_bits) - 1)
                np.bitwise_or.at(bitmap, s >> 3, (1 << (s & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int32()), pa.array([x.tobytes() for x in made.values()], pa.binary())],
                                         names=["block", "payload"])
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in spread.repartition(16, "block").mapInArrow(build, "block int, payload binary").collect():
        out[r["block"] << (block_bits - 3):(r["block"] + 1) << (block_bits - 3)] = np.frombuffer(r["payload"], np.uint8)
    return out


def _has(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    slot = key >> _U(62 - len(bitmap).bit_length())
    return (bitmap[slot >> _U(3)] >> (slot & _U(7)).astype(np.uint8)) & 1 != 0


def _counted(tuples, names):
    """Equal rows of the id columns ``tuples`` as one row with their number."""
    _, first, n = np.unique(_key(*tuples), return_index=True, return_counts=True)
    return pa.RecordBatch.from_arrays([*[_signed(x[first]) for x in tuples], pa.array(n.astype(np.int64))], names=names)


def pairs(docs: DataFrame, frequent, least: int) -> DataFrame:
    """(i1, i2, n, key) of the pairs of words with ``least`` occurrences;
    ``frequent``: broadcast bitmap of word ids."""
    def count(batches):
        held, size = [], 0
        for w in _each(batches):
            known = _has(frequent.value, w.ids)
            at = np.flatnonzero(w.follows & known[1:] & known[:-1])
            held.append((w.ids[at], w.ids[at + 1]))
            size += len(at)
            if size >= _AT_ONCE:
                yield _counted([np.concatenate(x) for x in zip(*held)], ["i1", "i2", "n"])
                held, size = [], 0
        if size:
            yield _counted([np.concatenate(x) for x in zip(*held)], ["i1", "i2", "n"])

    def keyed(batches):
        for b in batches:
            i1, i2 = (b.column(k).to_numpy().view(_U) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, _signed(_key(i1, i2))], names=["i1", "i2", "n", "key"])
    rows = docs.select("lang", "text").mapInArrow(count, "i1 long, i2 long, n long")
    return (rows.groupBy("i1", "i2").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
            .mapInArrow(keyed, "i1 long, i2 long, n long, key long"))


def suffixes(docs: DataFrame, frequent, large, longest: int, groups: int) -> DataFrame:
    """(group int, i1 .. i<longest>, n, large): blocks, as arrays of one entry a
    suffix, of what a task has for each group: suffixes of three words and more up
    to the first pair that is not ``frequent``, 0 after the last word."""
    ids = [f"i{k + 1}" for k in range(longest)]
    names = ["group", *ids, "n", "large"]

    def made(held):
        columns = [np.concatenate(x) for x in zip(*held)]
        whole, first, n = np.unique(_key(*columns), return_index=True, return_counts=True)
        columns = [x[first] for x in columns]
        prefix = _key(*columns[:2])
        big = _has(large.value, prefix)
        group = ((np.where(big, whole, prefix) >> _U(32)) % _U(groups)).astype(np.int32)
        order = np.argsort(group, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], group[order[1:]] != group[order[:-1]]]))
        at = pa.array(np.append(begin, len(order)).astype(np.int32))
        lists = [*[_signed(x[order]) for x in columns], pa.array(n[order].astype(np.int64)), pa.array(big[order])]
        return pa.RecordBatch.from_arrays([pa.array(group[order[begin]]), *[pa.ListArray.from_arrays(at, x) for x in lists]], names=names)

    def cut(batches):
        held, size = [], 0
        for w in _each(batches):
            if len(w.ids) < 3:
                continue
            on = w.follows.copy()
            on[on] = _has(frequent.value, _key(w.ids[:-1][on], w.ids[1:][on]))
            at = np.flatnonzero(on[:-1] & on[1:])
            if not len(at):
                continue
            columns, alive = [w.ids[at], w.ids[at + 1], w.ids[at + 2]], np.ones(len(at), bool)
            for k in range(3, longest):
                place = np.minimum(at + k, len(w.ids) - 1)
                alive = alive & (at + k < len(w.ids)) & on[place - 1]
                columns.append(np.where(alive, w.ids[place], _U(0)))
            held.append(columns)
            size += len(at)
            if size >= _AT_ONCE:
                yield made(held)
                held, size = [], 0
        if size:
            yield made(held)
    return docs.select("lang", "text").mapInArrow(cut, "group int, " + "".join(f"{i} array<long>, " for i in [*ids, "n"]) + "large array<boolean>")


def _nodes(longest: int, least: int):
    """Counts of the nodes of the subtrees, of blocks sorted by group.  Below a
    large prefix, nodes above the leaves may go on in other groups."""
    names = [*[f"i{k + 1}" for k in range(longest)], "n", "part"]

    def entries(blocks):
        columns = zip(*[[x.values for x in b] for b in blocks])
        *ids, n, large = (pa.concat_arrays(x).to_numpy(zero_copy_only=False) for x in columns)
        return np.stack(ids, axis=1), n, large

    def nodes(ids, n, large):
        order = np.lexsort(ids.T[::-1])
        ids, n, large = ids[order], n[order], large[order]
        differs = np.ones((len(ids), longest), bool)
        differs[1:] = ids[1:] != ids[:-1]
        differs = np.logical_or.accumulate(differs, axis=1)
        found = []
        for d in range(3, longest + 1):
            begin = np.flatnonzero(differs[:, d - 1])
            total, part = np.add.reduceat(n, begin), large[begin] & (d < longest)
            node = ids[begin]
            node[:, d:] = 0
            keep = (node[:, d - 1] != 0) & (part | (total >= least))
            found.append((node[keep], total[keep], part[keep]))
        ids, n, part = (np.concatenate(x) for x in zip(*found))
        return pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(ids[:, k])) for k in range(longest)], pa.array(n), pa.array(part)], names=names)

    def run(batches):
        group, blocks = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column(0)[k].as_py() != group and blocks:
                    yield nodes(*entries(blocks))
                    blocks = []
                group = batch.column(0)[k].as_py()
                blocks.append([batch.column(c)[k] for c in range(1, longest + 3)])
        if blocks:
            yield nodes(*entries(blocks))
    return run


def phrases(docs: DataFrame, least: int = 100, longest: int = 5, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(words: id, lang, word, n; phrases: ids array<long>, n) with all phrases of
    1 to ``longest`` (3 and more) words that occur ``least`` times in their
    language.  A null language is ``und``; null and empty texts have no words;
    rows that repeat a doc_id all count; an empty table has no phrase.  Words are
    told apart by 64-bit hashes of language and spelling."""
    spark = docs.sparkSession
    context = spark.sparkContext
    vocabulary = common.stash(words(docs, least), "collocation-words")
    known = vocabulary.filter("word is not null")
    word_bits = context.broadcast(_bitmap(known.select(F.col("id").alias("key")), WORD_BITS))
    two = common.stash(pairs(docs, word_bits, least), "collocation-pairs")
    total = two.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / budget))
    pair_bits = context.broadcast(_bitmap(two.select("key"), PAIR_BITS))
    large = context.broadcast(_bitmap(two.filter(F.col("n") > total / (4 * groups)).select("key"), PAIR_BITS))

    ids = [f"i{k + 1}" for k in range(longest)]
    nodes = common.stash(suffixes(docs, pair_bits, large, longest, groups).repartitionById(groups, "group").sortWithinPartitions("group")
                         .mapInArrow(_nodes(longest, least), "".join(f"{i} long, " for i in ids) + "n long, part boolean"),
                         "collocation-nodes")
    spread = nodes.filter("part").groupBy(*ids).agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    longer = nodes.filter("not part").select(*ids, "n").unionByName(spread)
    every = (known.select(F.array("id").alias("ids"), "n").unionByName(two.select(F.array("i1", "i2").alias("ids"), "n"))
             .unionByName(longer.select(F.filter(F.array(*ids), lambda x: x != 0).alias("ids"), "n")))
    return vocabulary, common.stash(every, "collocation-phrases")


def mine(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, budget: int = BUDGET) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    Candidates are phrases of 2 to ``longest`` words with a >= ``least``
    occurrences.  Cutting one in two gives score floor(1000 a n / (l r)), the
    lowest-scoring cut (ties: the first) counts.  A candidate inside a longer one
    with the same number of occurrences is dropped; as a middle one then has that
    number too, only phrases of one word more are looked at."""
    vocabulary, every = phrases(docs, least, longest, budget)
    candidates = every.filter(F.size("ids") >= 2)
    longer = (candidates.filter(F.size("ids") >= 3)
              .select("n", F.explode(F.array(F.slice("ids", F.lit(1), F.size("ids") - 1), F.slice("ids", 2, longest))).alias("ids")).distinct())
    candidates = candidates.join(longer, ["ids", "n"], "left_anti")

    cuts = candidates.select("ids", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("first"), F.slice("ids", F.col("k") + 1, F.lit(longest)).alias("rest"))
    cuts = (cuts.join(every.select(F.col("ids").alias("first"), F.col("n").alias("l")), "first")
            .join(every.select(F.col("ids").alias("rest"), F.col("n").alias("r")), "rest"))
    langs = vocabulary.filter("word is null").select("lang", F.col("n").alias("n"))
    owner = vocabulary.filter("word is not null").select(F.col("id").alias("i1"), "lang")
    cuts = cuts.withColumn("i1", F.get("ids", F.lit(0))).join(owner, "i1").join(langs, "lang")

    def exact(c) -> Column:
        return F.col(c).cast("decimal(19,0)")
    # both products stay below 10^38; div is exact on decimals
    cuts = cuts.withColumn("x", F.lit(1000).cast("decimal(4,0)") * exact("a") * exact("n")).withColumn("y", exact("l") * exact("r"))
    scored = (cuts.withColumn("score", F.expr("x div y").cast("long")).groupBy("lang", "ids", "a", "n")
              .agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select("lang", "ids", "a", "n", "best.score", "best.l", "best.r"))
    # ties stay until the spelling of the few that are left decides
    best_first = [F.desc("score"), F.desc("a")]
    near = scored.withColumn("rank", F.rank().over(W.partitionBy("lang").orderBy(*best_first))).filter(F.col("rank") <= top).drop("rank")
    spelt = (near.select("lang", "ids", F.posexplode("ids").alias("pos", "id")).join(vocabulary.select("id", "word").filter("word is not null"), "id")
             .groupBy("lang", "ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase")))
    named = near.join(spelt, ["lang", "ids"])
    ranked = named.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best_first, "phrase"))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(common.table(spark, sf_dir, "documents"))


#: Every phrase counted as text.
OP12_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM pieces),
s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, m, array_to_string(ws[i : i + m - 1], ' ') AS phrase FROM s, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE i + m - 1 <= len(ws)),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
t AS (SELECT lang, count(*) AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m >= 2),
inner_ AS (SELECT DISTINCT lang, a, unnest([array_to_string(ws[1 : m - 1], ' '), array_to_string(ws[2 : m], ' ')]) AS phrase FROM c WHERE m >= 3),
left_ AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.a >= 100 * c.a)),
k AS (SELECT *, unnest(range(1, m)) AS k FROM left_),
z AS (SELECT k.lang, k.phrase, a, k, l.f AS l, r.f AS r, n, CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
      FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(ws[1 : k], ' ')
             JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(ws[k + 1 : k.m], ' ') JOIN t ON t.lang = k.lang),
b AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b) WHERE rank <= 2000
"""
