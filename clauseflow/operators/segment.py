"""Contract text -> sections -> clause candidates -> valid clauses.

All segmentation is a narrow, per-contract projection (array functions plus a
generator), so it never shuffles: a contract is one row, and clause order is
carried as explicit position columns (section_idx, part_idx, clause_idx)
computed inside the row rather than with a window over the contract.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clauseflow.functions import textcols as tc
from clauseflow.session import sort_join, written

U, WS = tc.U, tc.WS
MARK = "\u0001"
# A section opens at "<digits>.<digits>" followed by whitespace.
D = r"\p{Nd}"   # Python's \d: any Unicode decimal digit
SECTION_OPEN = f"{U}({D}+\\.{D}+{WS}+)"
SECTION_HEAD = f"{U}^({D}+\\.{D}+){WS}+"
CLAUSE_SPLIT = f"{U};{WS}+|\\.{WS}+"


def _section_text(part: Column) -> Column:
    """"<no><ws><body>" -> "<no> <stripped body>"."""
    no = F.regexp_extract(part, f"^({D}+\\.{D}+)", 1)
    body = F.regexp_replace(part, SECTION_HEAD, "")
    return F.concat(no, F.lit(" "), tc.strip_ws(body))


def sections_array(text) -> Column:
    """G1: numbered sections in order; text before the first number is dropped;
    no number at all -> the whole stripped text; '' -> no sections."""
    t = tc._c(text)
    return _sections(t, _marked_parts(t))


def _marked_parts(t: Column) -> Column:
    return F.split(F.regexp_replace(t, SECTION_OPEN, MARK + "$1"), MARK)


def _sections(t: Column, parts: Column) -> Column:
    numbered = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), _section_text)
    return (F.when(t.isNull() | (t == ""), F.array().cast("array<string>"))
            .when(F.size(parts) > 1, numbered)
            .otherwise(F.array(tc.strip_ws(t))))


def clause_parts(section) -> Column:
    """Split on '; ' / '. ' (any whitespace), strip, drop blanks."""
    return F.filter(F.transform(F.split(tc._c(section), CLAUSE_SPLIT), tc.strip_ws), lambda p: p != "")


def clause_structs(text) -> Column:
    """All clause candidates of a contract as array<struct<section_idx, part_idx, text>>."""
    return _structs(sections_array(text))


def _structs(secs: Column) -> Column:
    return F.flatten(F.transform(
        secs,
        lambda s, i: F.transform(
            clause_parts(s),
            lambda p, j: F.struct(i.alias("section_idx"), j.alias("part_idx"), p.alias("text")))))


def valid_clause_structs(text) -> Column:
    """Candidates that pass G3, in document order."""
    return _valid(clause_structs(text))


def _valid(structs: Column) -> Column:
    # each candidate carries its lower-cased text to the keyword test
    low = F.transform(structs, lambda x: F.struct(x.alias("c"), F.lower(x["text"]).alias("low")))
    return F.transform(F.filter(low, lambda x: tc.is_valid_clause(x["c"]["text"], stripped=True, lowered=x["low"])), lambda x: x["c"])


def split_by_section_numbers(text) -> Column:
    """Same as ``sections_array`` (blank input already gives no sections)."""
    return sections_array(text)


# -- DataFrame forms ----------------------------------------------------------
def _with_sections(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """(keep..., _secs): the text is cut at its section numbers once, not for every use of the parts."""
    d = tc.with_computed(df.select(*keep, F.col(text).alias("_t")), {"_parts": _marked_parts(F.col("_t"))})
    return d.select(*keep, _sections(F.col("_t"), F.col("_parts")).alias("_secs"))


def split_sections(df: DataFrame, key: str = "contract_id", text: str = "text") -> DataFrame:
    """sections(contract_id, section_idx, section_no, section_text)."""
    out = _with_sections(df, [key], text).select(key, F.posexplode("_secs").alias("section_idx", "section_text"))
    return out.withColumn(
        "section_no",
        F.nullif(F.regexp_extract("section_text", f"^({D}+\\.{D}+) ", 1), F.lit("")),
    ).select(key, "section_idx", "section_no", "section_text")


def split_clause_parts(df: DataFrame, key: str = "contract_id", text: str = "text") -> DataFrame:
    """Every non-blank clause candidate with positions and its validity flag."""
    out = _with_sections(df, [key], text).select(key, F.explode(_structs(F.col("_secs"))).alias("c"))
    return out.select(key, "c.section_idx", "c.part_idx", F.col("c.text").alias("text"),
                      tc.is_valid_clause(F.col("c.text"), stripped=True).alias("is_valid"))


def split_into_clauses(df: DataFrame, key: str = "contract_id", text: str = "text",
                       keep: list[str] | None = None) -> DataFrame:
    """clauses(contract_id, clause_idx, section_idx, part_idx, text); clause_idx is
    the 0-based position among the contract's valid clauses."""
    keep = keep or []
    cut = _with_sections(df, [key, *keep], text)
    out = cut.select(key, *keep, F.posexplode(_valid(_structs(F.col("_secs")))).alias("clause_idx", "c"))
    return out.select(key, *keep, "clause_idx", "c.section_idx", "c.part_idx",
                      F.col("c.text").alias("text"))


def merge_fragments(clauses: DataFrame, key: str = "contract_id", order: str = "clause_idx",
                    text: str = "text", min_words: int = 12, block: int = 1024) -> DataFrame:
    """Consecutive short clauses (< min_words) are joined with a space into one
    row emitted before the next long clause; long clauses pass through.

    Gaps-and-islands: island id = number of long clauses before the clause.  The
    running count is two-level so no task holds a whole contract: long-clause
    counts per (contract, block of ``block`` positions) come from an aggregate,
    block offsets from a window over that small table, and the running sum
    inside a block from a window per (contract, block).
    """
    # written once: the clauses feed four branches below, whatever made them
    c = written(clauses.select(key, order, tc.strip_ws(text).alias("_t")).filter(F.col("_t") != "")
                .withColumn("_long", (tc.word_count("_t") >= min_words).cast("int"))
                .withColumn("_blk", F.floor(F.col(order) / block)), "fragments")[0]
    per_blk = c.groupBy(key, "_blk").agg(F.sum("_long").alias("_nl"))
    per_blk = per_blk.withColumn("_off", F.coalesce(F.sum("_nl").over(
        Window.partitionBy(key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    c = sort_join(c, per_blk.select(key, "_blk", "_off"), [key, "_blk"])
    w = Window.partitionBy(key, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = c.withColumn("_island", F.col("_off") + F.sum("_long").over(w) - F.col("_long"))
    long_rows = c.filter("_long = 1").select(key, F.col(order).alias("first_idx"),
                                             F.col("_t").alias("text"), F.lit(1).alias("n_parts"))
    short_rows = (c.filter("_long = 0").groupBy(key, "_island")
                  .agg(F.min(order).alias("first_idx"),
                       F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_t"))),
                                                lambda s: s["_t"]), " ").alias("text"),
                       F.count(F.lit(1)).alias("n_parts"))
                  .drop("_island"))
    return long_rows.unionByName(short_rows.select(key, "first_idx", "text", F.col("n_parts").cast("int")))
