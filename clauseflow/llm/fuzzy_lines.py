"""Fuzzy line dedup.

Lines are normalised to their words (lower case; what is neither letter nor
digit separates them), and equal ones are one class.  Two lines are similar when
1 - edits / words of the longer one, in word edits, is at least the similarity.
A class has three independent 64-bit SimHashes of its words as often as they
occur, each in four blocks of bits.  A block, the smallest hash of two words in a
row (another one for each block) and a class of lengths are a join key: blocks
alone are so few that their buckets would grow with the table, and unlike lines
seldom share the two words as well.  Lines that share a key, agree on a block of a
hash and differ in at most six of its bits are verified by the edit distance of
their word sequences.  By the pigeonhole principle three differing bits always
leave a block equal; four, five and six bits do so in 91, 77 and 62 of 100 cases a
hash (if they fall evenly).  Before that, lines are dropped that differ in too many
parities of their words: an edit changes two of them at most, so no similar pair is
lost.  Each hash is a pass of its own, which leaves only the buckets of several lines.
Within a bucket, lines meet its smallest one; pairs of other lines of a bucket are
made only between lines that are not linked by then, so a family of near-copies
costs about one pair a line.  Of each connected group the first occurrence, by
doc_id and line number, is kept.

All steps are DataFrame functions.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from clauseflow.functions.textcols import with_computed

from . import common

#: What is dropped between words.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Edits in words that lines may be apart, as a share of the longer one.
SIMILARITY = 0.95
#: SimHashes of a line, bits in which one of them may differ, and bits from and to of its blocks,
#: one of which has to be equal.
HASHES, DISTANCE = 3, 6
BLOCKS = ((0, 16), (16, 32), (32, 48), (48, 64))
#: Lengths of one class differ by less than this factor.
_STEP = 1.25
#: The counts of a SimHash's bits k, k + 16, k + 32 and k + 48 are the quarters of a long for
#: up to 2^14 words, those of the bits k and k + 32 its halves for all of a line's words.
_QUARTERS, _LANES = 0x0001000100010001, 1 << 32 | 1
#: Longs of a line's parities: each word flips one of their bits.
_PARITIES = 4
#: What tells whether two lines may be similar.
_OWN = ("n", *[f"h{h}" for h in range(HASHES)], *[f"p{k}" for k in range(_PARITIES)])


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, t: hash of the text, line_no from 0, line: its text in lower case) of every line."""
    return docs.select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(F.split(F.lower("text"), "\n")).alias("line_no", "line"))


def _word(code: Column, number: int) -> Column:
    """Hash of a word for the SimHash ``number``."""
    return F.xxhash64(code, F.lit(number))


def occurrences(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, t, line_no, line: hash of the words, n: words, code: 32 bits of
    the hash of each word) of every line that has a word; ``code`` is null for
    lines of fewer than ``least`` words.  One pass over the texts, without a shuffle."""
    lines = with_computed(_lines(docs), {"line": F.array_remove(F.split("line", GAP), "")}).filter(F.size("line") > 0)
    code = F.when(F.size("line") >= least, F.transform("line", lambda w: F.hash(w)))
    return lines.select("doc_id", "t", "line_no", F.xxhash64("line").alias("line"), F.size("line").alias("n"), code.alias("code"))


def _rotated(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by)) if by else x


def _hashed(classes: DataFrame, number: int) -> DataFrame:
    """(line, h: the SimHash ``number``, m: its pairs of words; with the first, n and
    the parities) of ``classes(line, code)``."""
    both = F.arrays_zip(F.col("code").alias("word"), F.slice("code", 2, F.size("code")).alias("next"))
    word = (classes.select("line", F.posexplode(both).alias("pos", "at"))
            .select("line", F.shiftright("pos", 14).alias("part"), "at.word", "at.next"))
    own = _word(F.col("word"), number)
    two = F.xxhash64("word", "next", F.lit(number))  # the last word stands alone
    part = [F.count("*").alias("n"), *[F.min(_rotated(two, low)).alias(f"m{low}") for low, _ in BLOCKS],
            *[F.sum(F.shiftrightunsigned(own, k).bitwiseAND(F.lit(_QUARTERS))).alias(f"s{k}") for k in range(16)]]
    whole = [F.sum("n").alias("n"), *[F.min(f"m{low}").alias(f"m{low}") for low, _ in BLOCKS],
             *[F.sum(F.shiftrightunsigned(f"s{k % 16}", k // 16 * 16).bitwiseAND(F.lit(_LANES * 0xFFFF))).alias(f"s{k}") for k in range(32)]]
    first = []
    if number == 0:
        flip = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("word").bitwiseAND(F.lit(63)))
        which = F.pmod(F.shiftright("word", 6), F.lit(_PARITIES))
        part += [F.bit_xor(F.when(which == k, flip).otherwise(0)).alias(f"p{k}") for k in range(_PARITIES)]
        whole += [F.bit_xor(f"p{k}").alias(f"p{k}") for k in range(_PARITIES)]
        first = [F.col("n").cast("int").alias("n"), *[f"p{k}" for k in range(_PARITIES)]]
    counted = word.groupBy("line", "part").agg(*part).groupBy("line").agg(*whole)
    # bit 30 of a half is set where its count is more than half of n
    counted = counted.withColumn("least", (F.lit(1 << 30) - 1 - F.floor(F.col("n") / 2)) * F.lit(_LANES))
    most = [(F.col(f"s{k}") + F.col("least")).bitwiseAND(F.lit(_LANES << 30)) for k in range(32)]
    bits = [F.shiftrightunsigned(x, 30 - k) if k <= 30 else F.shiftleft(x, 1) for k, x in enumerate(most)]
    return counted.select("line", *first, reduce(Column.bitwiseOR, bits).alias(f"h{number}"),
                          F.array(*[F.hash(f"m{low}") for low, _ in BLOCKS]).alias(f"m{number}"))


def classes_of(found: DataFrame) -> DataFrame:
    """(line, n, code, h0, h1, ...: its SimHashes, m0, m1, ...: for each block of a
    hash the least of the hashes of two words in a row, p0, p1, ...: parities of its
    words) of every class of lines that has codes.  A class is counted where its
    codes have been brought together, once for each hash: an aggregation of all of
    them at once is slower."""
    classes = found.filter("code is not null").select("line", "code").dropDuplicates(["line"])
    for h in range(HASHES):
        hashed = _hashed(found.filter("code is not null").select("line", "code").dropDuplicates(["line"]), h)
        classes = classes.join(hashed.hint("merge"), "line")
    return classes


def _length_class(n: Column) -> Column:
    return F.floor(F.log(n) / math.log(_STEP)).cast("long")


def _keys(n: Column, similarity: float, number: int) -> Column:
    """Join keys of the SimHash ``number``: hashes of number and bits of each block,
    the block's pair of words and the class of each length that the longer line of a
    similar pair may have."""
    made = []
    for k, (low, high) in enumerate(BLOCKS):
        bits = F.shiftrightunsigned(F.col(f"h{number}"), low).bitwiseAND(F.lit((1 << (high - low)) - 1))
        made.append((F.lit(len(BLOCKS) * number + k), bits, F.col(f"m{number}")[k]))
    longest = F.floor(n / similarity + 1e-9) if similarity > 0 else F.lit(1 << 30)
    classes = F.sequence(_length_class(n), _length_class(longest))
    return F.flatten(F.transform(classes, lambda c: F.array(*[F.xxhash64(*m, c) for m in made])))


def _met(keyed: DataFrame) -> DataFrame:
    """(key, a, b) from ``keyed(key, line)``: each line a of a bucket with the
    bucket's smallest one b."""
    return (keyed.select("key", F.col("line").alias("a"), F.min("line").over(Window.partitionBy("key")).alias("b"))
            .filter("a <> b"))


def _alike(a: str, b: str) -> Column:
    """Whether two lines are within the distance and agree on a block in one of their hashes."""
    def close(h):
        differ = F.col(a + str(h)).bitwiseXOR(F.col(b + str(h)))
        blocks = [F.shiftrightunsigned(differ, low).bitwiseAND(F.lit((1 << (high - low)) - 1)) == 0 for low, high in BLOCKS]
        return (F.bit_count(differ) <= DISTANCE) & reduce(Column.__or__, blocks)
    return reduce(Column.__or__, [close(h) for h in range(HASHES)])


def _near(a: str, b: str, similarity: float) -> Column:
    """Whether the lengths and parities of two lines alone don't rule them out."""
    na, nb = F.col(a + "n"), F.col(b + "n")
    flips = [F.bit_count(F.col(f"{a}p{k}").bitwiseXOR(F.col(f"{b}p{k}"))) for k in range(_PARITIES)]
    most = _most(na, nb, similarity)
    return (F.abs(na - nb) <= most) & (reduce(Column.__add__, flips) <= 2 * most)


def _most(na: Column, nb: Column, similarity: float) -> Column:
    """Edits that two lines of so many words may be apart."""
    return F.floor(F.greatest(na, nb) * (1 - similarity) + 1e-9).cast("int")


def _text(code: Column) -> Column:
    """The codes of a line's words as a string of one character a word (20 bits of
    its hash), so that edit distance counts words."""
    character = F.transform(code, lambda w: F.lpad(F.hex(F.lit(1 << 16) + F.pmod(w, F.lit(1 << 20))), 8, "0"))
    return F.decode(F.unhex(F.array_join(character, "")), "UTF-32")


#: Lines of more words than this lose what both start or end with before the edit
#: distance, which stays the same, is taken; compared in pieces of that length.
_PIECE = 256


def _same_start(a: Column, b: Column) -> Column:
    """Pieces that both strings start with."""
    def piece(x, i):
        return F.substr(x, i * _PIECE + 1, F.lit(_PIECE))
    whole = F.floor(F.least(F.length(a), F.length(b)) / _PIECE).cast("int")
    equal = F.transform(F.sequence(F.lit(0), whole - 1), lambda i: piece(a, i) == piece(b, i))
    first = F.array_position(equal, F.lit(False)).cast("int")
    return F.when(whole == 0, 0).when(first == 0, whole).otherwise(first - 1)


def _similar(pairs: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b, ca, cb)`` in which 1 - edits / words of the longer
    line is at least ``similarity``, as (a, b)."""
    pairs = pairs.withColumn("most", _most(F.length("ca"), F.length("cb"), similarity))
    for _ in range(2):  # the start, then the end as the start of the reversed rest
        cut = F.when(F.length("ca") > _PIECE, _same_start(F.col("ca"), F.col("cb"))).otherwise(0) * _PIECE
        pairs = with_computed(pairs, {"cut": cut})
        pairs = pairs.select("a", "b", "most", *[F.reverse(F.substr(c, F.col("cut") + 1)).alias(c) for c in ("ca", "cb")])
    # more edits than the bound give -1
    return pairs.filter(F.call_function("levenshtein", "ca", "cb", "most") >= 0).select("a", "b")


def _verified(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose lines are near by their hashes and similar enough."""
    pairs = common.stash(pairs, "line-pairs")
    wanted = common.broadcast_up_to(pairs.select(F.explode(F.array("a", "b")).alias("line")).distinct())
    codes = common.stash(classes.join(wanted, "line", "left_semi").select("line", *_OWN, _text(F.col("code")).alias("c")), "line-codes")
    for x in ("a", "b"):
        pairs = pairs.join(codes.select(F.col("line").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in (*_OWN, "c")]), x)
    near = pairs.filter(_near("a_", "b_", similarity) & _alike("a_h", "b_h"))
    return common.stash(_similar(near.select("a", "b", F.col("a_c").alias("ca"), F.col("b_c").alias("cb")), similarity), "line-links")


def groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per line that has a word: doc_id, t (hash of the text), line_no,
    first_doc_id and first_line_no (the group's first occurrence), kept.

    Lines end with a line feed.  Null and empty texts and lines without words
    have no row and are never removed.  In rows that repeat a doc_id, all
    occurrences at the first one's doc_id and line number are kept.  A null
    doc_id comes first.  Lines are told apart by 64-bit hashes, words within a
    compared pair by 20 bits.  Lines too short for one edit within the
    similarity (of fewer than 19 words at 0.95) can only be equal."""
    # a line of n words may differ from its like in n (1 - similarity) words, rounded down: shorter ones have no like
    least = next(n for n in range(1, 1 << 20) if math.floor((n + 1) * (1 - similarity) + 1e-9) >= 1) if similarity < 1 else 1 << 30
    found = common.stash(occurrences(docs, least), "line-occurrences")
    classes = common.stash(classes_of(found), "line-classes")
    found = found.drop("n", "code")

    met = []
    for h in range(HASHES):
        keyed = classes.select(F.explode(_keys(F.col("n"), similarity, h)).alias("key"), "line")
        met.append(common.stash(_met(keyed), "line-met"))
    met = reduce(DataFrame.unionByName, met)
    links = _verified(met.select("a", "b").distinct(), classes, similarity)
    parts = common.connected_components(links)

    # the other pairs of a bucket, between lines that are not linked yet
    parts = common.broadcast_up_to(parts.withColumnRenamed("node", "line"))
    members = (met.withColumnRenamed("a", "line").join(parts, "line", "left")
               .select("key", "line", F.coalesce("root", "line").alias("part")))
    mixed = members.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi").select("key")
    members = common.stash(members.join(mixed, "key").join(classes, "line").select("key", "line", "part", *_OWN), "line-members")
    other = members.select("key", F.col("line").alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("part", *_OWN)])
    rest = (members.join(other, "key")
            .filter((F.col("line") > F.col("b")) & (F.col("part") != F.col("b_part")))
            .filter(_near("", "b_", similarity) & _alike("h", "b_h")).select(F.col("line").alias("a"), "b").distinct())
    links = links.unionByName(_verified(rest, classes, similarity))

    roots = common.connected_components(links)
    found = found.join(roots.withColumnRenamed("node", "line"), "line", "left").withColumn("root", F.coalesce("root", "line"))
    first = (found.groupBy("root").agg(F.min(F.struct("doc_id", "line_no")).alias("first"))
             .select("root", F.col("first.doc_id").alias("first_doc_id"), F.col("first.line_no").alias("first_line_no")))
    kept = F.col("doc_id").eqNullSafe(F.col("first_doc_id")) & (F.col("line_no") == F.col("first_line_no"))
    return found.join(first, "root").select("doc_id", "t", "line_no", "first_doc_id", "first_line_no", kept.alias("kept"))


def cleaned(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with the lines that are not kept taken out of their texts."""
    gone = (groups(docs, **settings).filter("not kept").groupBy("doc_id", "t").agg(F.collect_set("line_no").alias("__gone"))
            .withColumnsRenamed({"doc_id": "__id", "t": "__t"}))
    same = docs["doc_id"].eqNullSafe(gone["__id"]) & (F.xxhash64(docs["text"]) == gone["__t"])
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__gone", i))
    return (docs.join(gone, same, "left")
            .withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(common.table(spark, sf_dir, "documents")).drop("t")
