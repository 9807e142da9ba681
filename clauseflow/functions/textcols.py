"""Column functions for clause text (no actions, no UDFs on the hot path).

Whitespace follows Python's ``str.split()`` / ``\\s``: Java's ``\\s`` is
ASCII-only, so patterns use ``(?U)`` (Unicode White_Space) plus the four ASCII
separators 0x1C-0x1F, which together are exactly the characters for which
``str.isspace()`` is true.  (An explicit list of the same characters is
measurably slower in Java: a chain of range predicates instead of one
property test.)

Filters on columns derived from long texts are written against the raw column
where the value is the same (e.g. the word count of cleaned text equals that of
the raw text): Catalyst pushes a filter below a projection by inlining the
alias, which would re-evaluate the expensive expression in the predicate.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from clauseflow.functions import lexicon as lx

WS_CHARS = r"\s\x1c-\x1f"   # inside a class, with (?U): Python's whitespace set
WS = f"[{WS_CHARS}]"          # one Python-style whitespace character (use with U)
U = "(?U)"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def with_computed(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Add expensive derived columns so that they are evaluated once.

    ``withColumn`` + ``filter`` lets Catalyst push the filter below the
    projection by inlining the expression, so it runs again in the predicate.
    Columns produced by a generator cannot be inlined: a one-element ``inline``
    pins them (the filter stays above, the expression is computed once).
    """
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, F.inline(F.array(F.struct(*[e.alias(n) for n, e in cols.items()]))))


# -- T2 / whitespace ---------------------------------------------------------
def strip_ws(col) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(col), f"{U}^{WS}+|{WS}+$", "")


def collapse_ws(col) -> Column:
    return F.regexp_replace(_c(col), f"{U}{WS}+", " ")


def clean_text(col) -> Column:
    """Collapse whitespace runs to one space, then strip."""
    return strip_ws(collapse_ws(col))


def is_blank(col) -> Column:
    return F.coalesce(strip_ws(col) == F.lit(""), F.lit(True))


# -- T1 ----------------------------------------------------------------------
@F.pandas_udf(StringType())
def nfkc_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda v: unicodedata.normalize("NFKC", v) if isinstance(v, str) else v)


def strip_tags_and_clean(col) -> Column:
    """T1 without NFKC: tags to a space, collapse whitespace, strip."""
    return clean_text(F.regexp_replace(_c(col), r"<[^>]+>", " "))


def with_nfkc(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """NFKC-normalise ``col`` in one pass.  ASCII text is NFKC as it is: the
    Python function gets null for it, so only other texts leave the JVM."""
    out = out or col
    non_ascii = F.coalesce(_c(col).rlike(r"[^\x00-\x7f]"), F.lit(False))
    done = df.withColumn("_nfkc", nfkc_udf(F.when(non_ascii, _c(col))))
    return done.withColumn(out, F.coalesce("_nfkc", _c(col))).drop("_nfkc")


def normalize_clause_text(df: DataFrame, col: str, out: str) -> DataFrame:
    """NFKC -> drop ``<...>`` tags -> collapse whitespace -> strip."""
    return with_nfkc(df, col, out).withColumn(out, strip_tags_and_clean(out))


# -- T3 ----------------------------------------------------------------------
def similarity_norm(col) -> Column:
    """Lower, anything but [a-z0-9] / whitespace to a space, collapse, strip."""
    lowered = F.lower(_c(col))
    return clean_text(F.regexp_replace(lowered, f"{U}[^a-z0-9{WS_CHARS}]", " "))


# -- T4 ----------------------------------------------------------------------
def word_count(col) -> Column:
    """``len(text.split())``: number of maximal non-whitespace runs."""
    return F.coalesce(F.regexp_count(_c(col), F.lit(f"{U}[^{WS_CHARS}]+")), F.lit(0))


# -- T5 ----------------------------------------------------------------------
QUOTED = r'"([^"]+)"'


def quoted_label(col) -> Column:
    """T5: first double-quoted substring, stripped and lower-cased ('' if none)."""
    return F.lower(strip_ws(F.regexp_extract(_c(col), QUOTED, 1)))


def has_quoted(col) -> Column:
    return _c(col).rlike(QUOTED)


# -- T6 .. T10 ---------------------------------------------------------------
def first_match(lowered, phrases: list[str]) -> Column:
    """Alphabetically first phrase that is a substring, else NULL."""
    arr = lx.lit_array(sorted(phrases))
    return F.get(F.filter(arr, lambda p: F.instr(_c(lowered), p) > 0), 0)


def weighted_hits(lowered, pairs: list[tuple[str, int]]) -> Column:
    """array<struct<phrase,weight>> of every phrase present."""
    return F.filter(lx.lit_weighted(pairs), lambda x: F.instr(_c(lowered), x["phrase"]) > 0)


def any_phrase(lowered, phrases: list[str]) -> Column:
    """T8."""
    return F.exists(lx.lit_array(phrases), lambda p: F.instr(_c(lowered), p) > 0)


def count_phrases(lowered, phrases: list[str]) -> Column:
    """Number of distinct phrases present."""
    return F.size(F.filter(lx.lit_array(phrases), lambda p: F.instr(_c(lowered), p) > 0))


def regex_count(col, pattern: str) -> Column:
    """``len(re.findall(pattern, text))`` for patterns with no overlap issue."""
    return F.regexp_count(_c(col), F.lit(pattern))


# -- T11 .. T14 --------------------------------------------------------------
def join_list(col, sep: str = ", ") -> Column:
    return F.array_join(_c(col), sep)


def sorted_distinct(col) -> Column:
    return F.array_sort(F.array_distinct(_c(col)))


def canon_label(col) -> Column:
    """Label as text, stripped, lower-cased (NULL -> '')."""
    return F.lower(strip_ws(F.coalesce(_c(col).cast("string"), F.lit(""))))


# -- T15 / T16 ---------------------------------------------------------------
def unigrams(norm_col) -> Column:
    """Words of 2+ characters of a similarity-normalised text (only [a-z0-9 ] left)."""
    return F.filter(F.split(_c(norm_col), " "), lambda w: F.length(w) >= 2)


def bigrams_of(toks) -> Column:
    """Bigrams of consecutive tokens; ``toks`` should be a column reference
    (array functions re-evaluate expression arguments, never columns)."""
    t = _c(toks)
    m = F.greatest(F.size(t) - 1, F.lit(0))
    return F.zip_with(F.slice(t, 1, m), F.slice(t, 2, m), lambda a, b: F.concat(a, F.lit(" "), b))


def uni_bi_grams(norm_col) -> Column:
    """Unigrams followed by bigrams of consecutive kept unigrams."""
    toks = unigrams(norm_col)
    return F.concat(toks, bigrams_of(toks))


def truncate_tokens(tokens, n: int = lx.MAX_TOKENS) -> Column:
    """Keep the first ``n`` word tokens (model window)."""
    return F.slice(_c(tokens), 1, n)


# -- G3 ----------------------------------------------------------------------
def word_count_stripped(s) -> Column:
    """``len(text.split())`` for text that is already stripped."""
    return word_count(s)


def is_valid_clause(col, stripped: bool = False, lowered=None) -> Column:
    """5..120 words, first character upper case, a modal/obligation keyword.

    Conjuncts are ordered cheapest first (substring tests before the word-count
    split) and short-circuit; pass ``stripped=True`` for text that is already
    stripped (inside array lambdas there is no common-subexpression reuse), and in
    ``lowered`` its lower-cased form, else every keyword lowers the text anew.
    """
    s = _c(col) if stripped else strip_ws(col)
    wc = word_count_stripped(s)
    return (
        (s != "")
        & any_phrase(F.lower(s) if lowered is None else lowered, lx.CLAUSE_KEYWORDS)
        & F.substring(s, 1, 1).rlike(r"^\p{IsUppercase}")
        & (wc >= lx.CLAUSE_MIN_WORDS) & (wc <= lx.CLAUSE_MAX_WORDS)
    )
