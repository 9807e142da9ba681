"""Spelling variants by FM-index search schemes.

Words at an edit distance of one share their first or their last half.  Each
word is indexed and looked up twice, as it is and reversed; either time its last
half is matched exactly, then the search goes on across the other half with one
error, as an interval of suffix ranks (rotations of the delimited vocabulary)
that each character narrows.  The reversed pass is the other direction of the
index.

The vocabulary is partitioned by the half that has to be equal, so that a group
holds whole equal halves and is searched on its own.  A half that more than
``MOST_WORDS`` words share is cut into parts, every part of its queries meets
every part of its index.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, wordhash

#: Words of one half (and rows of one group, about) that are searched together.
MOST_WORDS = 50_000
#: Queries whose intervals are held at once.
_AT_ONCE = 8192
#: Bits of a character: a-z are 1 to 26, U+00C0 to U+00FF 27 to 90, 0 stands between words.
_BITS = 7
#: Runs of more bytes have their checksum taken one by one.
_SHORT = 64


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


_CRC = _crc_table()


def _checksums(start_with: np.ndarray, buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """crc32 of each run, going on from the checksum of what stands before it."""
    out = np.zeros(len(start), np.uint32)
    length = stop - start
    order = np.argsort(-length, kind="stable")
    many = int(np.searchsorted(-length[order], -_SHORT, "left"))
    for i in order[:many]:
        out[i] = zlib.crc32(buf[start[i]:stop[i]].tobytes(), int(start_with[i]))
    order = order[many:]
    state, at, length = ~start_with[order], start[order], length[order]
    ends = np.searchsorted(-length, -np.arange(_SHORT + 1), "left")  # runs of more than j bytes
    for j in range(_SHORT):
        k = ends[j]
        if not k:
            break
        state[:k] = _CRC[(state[:k] ^ buf[at[:k] + j]) & 0xFF] ^ (state[:k] >> 8)
    out[order] = ~state
    return out


def _letters(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The texts with A-Z as a-z and a space for each byte of what is neither a
    letter nor U+00C0 to U+00FF: their bytes, and as a column."""
    buf, at = wordhash.text_buffer(column)
    low = wordhash.LOWER_ASCII[buf]
    lead = buf == 0xC3
    keep = ((low >= 0x61) & (low <= 0x7A)) | lead
    keep[1:] |= lead[:-1]
    clean = np.where(keep, low, np.uint8(0x20))
    return clean, pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(at), pa.py_buffer(clean))


def _strings(buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    length = stop - start
    at = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    data = buf[np.repeat(start - at[:-1], length) + np.arange(at[-1])]
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(data)).cast(pa.string())


def vocabulary(docs: DataFrame, least_chars: int = 6, least: int = 5, every: int = 199) -> DataFrame:
    """(word, n) of the words of ``least_chars`` code points and ``least`` occurrences.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, A-Z as a-z.  Where
    ``every`` divides the crc32 h of ``<doc_id>:<word>``, this occurrence lacks
    code point h % length.  A null doc_id is the empty string there; null and
    empty texts have no words; rows that repeat a doc_id all count."""
    def count(batches):
        for batch in batches:
            for part in wordhash.slices(batch, "text"):
                buf, column = _letters(part.column("text"))
                hashes, start, stop = wordhash.located(column, fold=wordhash.KEEP_CASE)
                if not len(hashes):
                    continue
                _, at = wordhash.text_buffer(column)
                before = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) for d in part.column("doc_id").to_pylist()], np.uint32)
                row = np.searchsorted(at, start, "right") - 1
                h = _checksums(before[row], buf, start, stop)
                size = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
                size = size[stop] - size[start]
                cut = h % np.uint32(every) == 0
                plain = np.flatnonzero(~cut & (size >= least_chars))
                _, first, n = np.unique(hashes[plain], return_index=True, return_counts=True)
                first = plain[first]
                altered = []
                for i in np.flatnonzero(cut & (size > least_chars)):
                    word = buf[start[i]:stop[i]].tobytes().decode()
                    k = int(h[i]) % len(word)
                    altered.append(word[:k] + word[k + 1:])
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([_strings(buf, start[first], stop[first]), pa.array(altered, pa.string())]),
                     pa.array(np.concatenate([n, np.ones(len(altered), np.int64)]).astype(np.int64))], names=["word", "n"])
    rows = docs.select(docs["doc_id"].cast("string").alias("doc_id"), "text").mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


class Index:
    """FM-index of distinct words: intervals of sorted rotations of the words'
    characters, a 0 before each word, narrowed by the character before."""

    def __init__(self, codes: np.ndarray, at: np.ndarray):
        n_words = len(at) - 1
        n = len(codes) + n_words
        text = np.zeros(n, np.int64)
        gap = at[:-1] + np.arange(n_words)
        text[np.setdiff1d(np.arange(n), gap, assume_unique=True)] = codes
        order = self._rotations(text)
        before = text[order - 1]
        self.n, self.below = n, np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << _BITS))])[:-1]
        self.word = np.searchsorted(gap, order[:n_words])  # of the rotations that start before a word
        # wavelet matrix of ``before``: zeros up to each place, by bit from the highest
        self.zeros = []
        for bit in reversed(range(_BITS)):
            one = (before >> bit) & 1 != 0
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            before = np.concatenate([before[~one], before[one]])
        every = np.arange(1 << _BITS)
        self.first, _ = self._walk(every, np.zeros_like(every), np.zeros_like(every))

    @staticmethod
    def _rotations(text: np.ndarray) -> np.ndarray:
        """Order of all rotations, by their first 8 characters, then 16 and so on."""
        n, k = len(text), 8
        key = np.zeros(n, np.int64)
        for j in range(k):
            key = key << _BITS | np.roll(text, -j)
        while True:
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[0], key[order[1:]] != key[order[:-1]]])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            if rank[order[-1]] == n - 1 or k >= 2 * n:
                return order
            key = rank * n + np.roll(rank, -k)
            k *= 2

    def _walk(self, c, lo, hi):
        for bit, zeros in zip(reversed(range(_BITS)), self.zeros):
            one = (c >> bit) & 1 != 0
            lo, hi = (np.where(one, zeros[-1] + x - zeros[x], zeros[x]) for x in (lo, hi))
        return lo, hi

    def step(self, c, lo, hi):
        """Intervals with the character ``c`` put before."""
        a, b = self._walk(c, lo, hi)
        shift = self.below[c] - self.first[c]
        return a + shift, b + shift

    def steps(self, lo, hi):
        """(number of interval, character, lo, hi) of every character that stands before some of an interval."""
        which, c = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        for zeros in self.zeros:
            a, b = zeros[lo], zeros[hi]
            left, right = np.flatnonzero(b > a), np.flatnonzero(hi - lo > b - a)
            lo, hi = (np.concatenate([z[left], zeros[-1] + x[right] - z[right]]) for x, z in ((lo, a), (hi, b)))
            which = np.concatenate([which[left], which[right]])
            c = np.concatenate([c[left] << 1, c[right] << 1 | 1])
        shift = self.below[c] - self.first[c]
        return which, c, lo + shift, hi + shift

    def near(self, codes, start, stop, exact) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) with exactly one inserted, deleted or replaced character
        before the last ``exact`` ones of the query; pairs come once."""
        q = np.arange(len(start))
        lo, hi = self.step(np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), self.n))
        for j in range(int(exact.max(initial=0))):
            on = np.flatnonzero(exact > j)
            lo[on], hi[on] = self.step(codes[stop[on] - 1 - j], lo[on], hi[on])
        i = stop - exact  # what is left of the query ends here
        open_ = [x[hi > lo] for x in (q, i, lo, hi)]
        erred = [np.empty(0, np.int64)] * 4
        found = []
        while len(open_[0]) or len(erred[0]):
            # the error is made: the rest is equal
            q, i, lo, hi = erred
            over = i == start[q]
            c = np.where(over, 0, codes[np.maximum(i - 1, 0)])
            lo, hi = self.step(c, lo, hi)
            there = hi > lo
            done = there & over
            found.append((q[done], self.word[lo[done]]))
            go = there & ~over
            after = [(q[go], i[go] - 1, lo[go], hi[go])]
            # it is still to come
            q, i, lo, hi = open_
            more = i > start[q]
            after.append((q[more], i[more] - 1, lo[more], hi[more]))  # the word lacks a character
            which, c, lo, hi = self.steps(lo, hi)
            q, i, more = q[which], i[which], more[which]
            own = more & (c == codes[np.maximum(i - 1, 0)])
            real = c != 0
            after.append((q[real], i[real], lo[real], hi[real]))  # it has one more
            other = real & more & ~own
            after.append((q[other], i[other] - 1, lo[other], hi[other]))
            open_ = [q[own], i[own] - 1, lo[own], hi[own]]
            erred = [np.concatenate(x) for x in zip(*after)]
        pair = np.concatenate([a * len(self.word) + b for a, b in found] or [np.empty(0, np.int64)])
        return np.divmod(wordhash.distinct(pair), max(len(self.word), 1))


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all words, and where each word's start (n + 1)."""
    buf, at = wordhash.text_buffer(column)
    real = buf != 0xC3
    place = np.concatenate([[0], np.cumsum(real)])
    kept = buf[real].astype(np.int64)
    return np.where(kept < 0x80, kept - 0x60, kept - 0x80 + 27), place[at]


def _reversed(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    size = np.diff(at)
    return codes[np.repeat(at[:-1] + at[1:] - 1, size) - np.arange(len(codes))]


def _half(length):
    """Characters at the start or at the end that a word has in common with each near word."""
    return np.maximum(length - 1, 6) // 2


def _same_start(codes, a, b, size) -> np.ndarray:
    same = np.ones(len(a), bool)
    for j in range(int(size.max(initial=0))):
        on = np.flatnonzero(same & (size > j))
        same[on] = codes[a[on] + j] == codes[b[on] + j]
    return same


def _search(side: int, words: pa.Array, n: np.ndarray, indexed: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(word, n_near, form, form_n: of its most frequent near word) of the words
    that are not ``indexed`` and have a near one among those that are."""
    codes, at = _codes(words)
    straight = codes
    if side == 0:
        codes = _reversed(codes, at)
    inside = np.flatnonzero(indexed)
    if not len(inside):
        return
    names = words.take(pa.array(inside)).dictionary_encode().indices.to_numpy()
    inside = inside[np.unique(names, return_index=True)[1]]  # a word comes under several halves
    size = np.diff(at)
    own = np.concatenate([[0], np.cumsum(size[inside])])
    index = Index(codes[np.repeat(at[inside] - own[:-1], size[inside]) + np.arange(own[-1])], own)
    by_name = np.empty(len(words), np.int64)
    by_name[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
    queries = np.flatnonzero(~indexed)
    for k in range(0, len(queries), _AT_ONCE):
        q = queries[k:k + _AT_ONCE]
        which, word = index.near(codes, at[q], at[q + 1], _half(size[q]))
        which, word = q[which], inside[word]
        if side == 1:  # what the other direction finds
            new = ~_same_start(straight, at[which], at[word], _half(size[which]))
            which, word = which[new], word[new]
        if len(which):
            order = np.lexsort((by_name[word], -n[word], which))
            which, word = which[order], word[order]
            first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
            yield pa.RecordBatch.from_arrays(
                [words.take(pa.array(which[first])), pa.array(np.diff(np.append(first, len(which)))),
                 words.take(pa.array(word[first])), pa.array(n[word[first]])], names=["word", "n_near", "form", "form_n"])


def _parts(words: DataFrame, most: int) -> DataFrame:
    """(part, alone, side, word, n, indexed): every word as a query under its own
    half and in the index under the halves of words that may be near it, of
    either side; alone: the part is one of several of its half."""
    length = F.char_length("word")
    sides = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    asks = F.struct(F.floor(F.greatest(length - 1, F.lit(6)) / 2).cast("int").alias("half"), F.lit(False).alias("indexed"))
    held = [F.struct(F.floor(F.greatest(x, F.lit(6)) / 2).cast("int").alias("half"), F.lit(True).alias("indexed"))
            for x in (length - 2, length - 1, length)]
    rows = words.select("word", "n", sides).select("*", F.inline(F.array_distinct(F.array(asks, *held))))
    half = F.when(F.col("side") == 0, F.left("word", F.col("half"))).otherwise(F.right("word", F.col("half")))
    rows = rows.withColumn("key", F.xxhash64("side", "half", half))
    # halves of very many words, at most 6 words.count() / most of them: their parts meet part by part
    large = common.stash(rows.groupBy("key").agg(F.count_if("indexed").alias("held"), F.count_if(~F.col("indexed")).alias("asks"))
                         .filter(F.greatest("held", "asks") > most)
                         .select("key", F.ceil(F.col("held") / most).alias("held_parts"), F.ceil(F.col("asks") / most).alias("asks_parts")),
                         "spelling-large")
    rows = rows.join(common.broadcast_up_to(large), "key", "left")
    own = F.pmod(F.xxhash64(F.lit("part"), "word"), F.when(F.col("indexed"), F.col("held_parts")).otherwise(F.col("asks_parts")))
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.when(F.col("indexed"), F.col("asks_parts")).otherwise(F.col("held_parts")) - 1),
                        lambda other: F.when(F.col("indexed"), F.xxhash64("key", own, other)).otherwise(F.xxhash64("key", other, own)))
    rows = rows.withColumn("part", F.explode(F.when(F.col("held_parts").isNull(), F.array("key")).otherwise(meets)))
    return rows.select("part", F.col("held_parts").isNotNull().alias("alone"), "side", "word", "n", "indexed")


def near_words(words: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """(word, n_near, form, form_n) of the words of ``words(word, n)``, written
    in the alphabet of ``vocabulary`` and of six and more characters, that are
    near another one; form is the most frequent near word, the smallest by code
    point among several."""
    rows = common.stash(_parts(words, most), "spelling-parts")
    groups = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / most))

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        names = [table.column(c).chunk(0) for c in ("word", "n", "indexed")]
        made = list(_search(table.column("side")[0].as_py(), names[0], names[1].to_numpy(), names[2].to_numpy(zero_copy_only=False)))
        empty = pa.schema([("word", names[0].type), ("n_near", pa.int64()), ("form", names[0].type), ("form_n", pa.int64())])
        return pa.Table.from_batches(made, schema=made[0].schema if made else empty)
    together = F.when(F.col("alone"), F.col("part")).otherwise(F.pmod("part", F.lit(groups)))
    found = (rows.withColumn("group", together).groupBy("group", "alone", "side")
             .applyInArrow(search, "word string, n_near long, form string, form_n long"))
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "best.form", (-F.col("best.m")).alias("form_n"))


def group(docs: DataFrame, times: int = 5, most: int = MOST_WORDS, **settings) -> DataFrame:
    """One row per word of ``vocabulary``: word, form, root, n, n_near, form_n.
    A form has at least ``times`` the occurrences of its word, so that chains of
    forms end; their ends come from doubling the steps."""
    words = common.stash(vocabulary(docs, **settings), "spelling-words")
    near = near_words(words, most)
    is_form = F.col("form_n") >= times * F.col("n")
    rows = common.stash(words.join(near, "word", "left").select(
        "word", F.when(is_form, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("form_n")).alias("form_n")), "spelling-forms")
    links = rows.filter("form is not null").select(F.col("word").alias("x"), F.col("form").alias("y"))
    # only words that are a form of others and have one themselves go further
    inner = common.stash(links.join(links.select(F.col("y").alias("x")).distinct(), "x", "left_semi"), "spelling-links")
    while True:
        far = inner.select(F.col("x").alias("y"), F.col("y").alias("z"))
        if inner.join(far, "y", "left_semi").isEmpty():
            break
        inner = common.stash(inner.join(far, "y", "left").select("x", F.coalesce("z", "y").alias("y")), "spelling-links")
    ends = inner.select(F.col("x").alias("form"), F.col("y").alias("end"))
    return rows.join(ends, "form", "left").select("word", "form", F.coalesce("end", "form", "word").alias("root"), "n", "n_near", "form_n")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(common.table(spark, sf_dir, "documents"))
