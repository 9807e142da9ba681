"""Secret scan through a trigram inverted index.

Every rule's regular expression is turned into a Boolean trigram query: an AND
of clauses, each an OR of trigram sets that must all occur.  Each slice of rows
gets an inverted index over its lower-cased bytes (trigram -> rows), restricted
to the trigrams that any rule asks for; posting lists are united and
intersected, and only the rows that are left are matched with the regular
expression.  Rules without a mandatory trigram scan every row.  The index lives
beside the text it indexes, so the scan is one narrow pass without a shuffle.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as C
import re._parser as parser
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, wordhash


@dataclass(frozen=True)
class Rule:
    """``min_chars`` bounds group ``group`` of a match; shorter matches are
    dropped after matching, so they still use up their characters."""
    kind: str
    pattern: str
    group: int = 0
    min_chars: int = 1
    ignore_case: bool = False
    base: bool = False

    @cached_property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Leftmost non-overlapping matches (code points, end exclusive)."""
        return [m.span() for m in self.regex.finditer(text) if m.end(self.group) - m.start(self.group) >= self.min_chars]


# The rules. Base rules come first, in the order of their kinds.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         group=2, min_chars=6, ignore_case=True, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", min_chars=20, base=True),
    # maximal runs of 24 and more: the same spans as those of [0-9a-f]+ that are long enough
    Rule("hex", r"[0-9a-f]{24,}", min_chars=24, base=True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

#: A set of alternatives with more strings than this counts as "anything".
_MOST_STRINGS = 64


def _strings(node) -> set[str] | None:
    """All strings that a parsed regex item can match, or None if they are too many."""
    op, arg = node
    if op is C.LITERAL:
        return {chr(arg)}
    if op is C.IN:
        out = set()
        for kind, value in arg:
            if kind is C.LITERAL:
                out.add(chr(value))
            elif kind is C.RANGE and value[1] - value[0] < 8:
                out |= {chr(c) for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is C.SUBPATTERN:
        return _sequence_strings(arg[-1])
    if op is C.BRANCH:
        each = [_sequence_strings(x) for x in arg[1]]
        return None if None in each else set().union(*each)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, inner = arg
        if high == 1 and low == 0:
            got = _sequence_strings(inner)
            return None if got is None else got | {""}
        if low == high and low <= 4:
            return _sequence_strings(list(inner) * low)
        return None
    if op is C.AT:
        return {""}
    return None


def _sequence_strings(items) -> set[str] | None:
    out = {""}
    for node in items:
        got = _strings(node)
        if got is None or len(out) * len(got) > _MOST_STRINGS:
            return None
        out = {a + b for a in out for b in got}
    return out


def _trigrams(text: str) -> frozenset[int]:
    data = text.lower().encode()
    return frozenset(data[i] << 16 | data[i + 1] << 8 | data[i + 2] for i in range(len(data) - 2))


def trigram_query(pattern: str) -> list[list[frozenset[int]]]:
    """AND of ORs of trigram sets that any match must contain, on lower-cased
    text; empty if the pattern has no mandatory trigram."""
    clauses: list[list[frozenset[int]]] = []

    def close(strings: set[str]) -> None:
        each = {_trigrams(s) for s in strings}
        if frozenset() not in each:
            clauses.append(sorted((x for x in each if not any(y < x for y in each)), key=sorted))

    def walk(items) -> None:
        run = {""}
        for node in items:
            got = _strings(node)
            if got is not None and len(run) * len(got) <= _MOST_STRINGS:
                run = {a + b for a in run for b in got}
                continue
            close(run)
            run = {""}
            op, arg = node
            if got is not None:
                run = got
            elif op is C.SUBPATTERN:
                walk(arg[-1])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
                walk(arg[2])
        close(run)
    walk(parser.parse(pattern, re.ASCII))
    return clauses


class Index:
    """Postings (trigram -> sorted rows) of one slice of rows, for a given vocabulary."""

    def __init__(self, column: pa.Array, vocabulary: np.ndarray, wanted: np.ndarray, piece: int = 1 << 19):
        """vocabulary: sorted trigram codes; wanted: the same as a mask over all codes."""
        buf, at = wordhash.text_buffer(column)
        pairs = [np.empty(0, np.int64)]
        for lo in range(0, len(buf) - 2, piece):
            low = wordhash.LOWER_ASCII[buf[lo:lo + piece + 2]].astype(np.int32)
            codes = low[:-2] << 16 | low[1:-1] << 8 | low[2:]
            place = np.flatnonzero(wanted[codes])
            row = np.searchsorted(at, place + lo, "right") - 1
            inside = place + lo + 3 <= at[row + 1]
            which = np.searchsorted(vocabulary, codes[place[inside]])
            pairs.append(which * np.int64(len(column)) + row[inside])
        which, row = np.divmod(wordhash.distinct(np.concatenate(pairs)), max(len(column), 1))
        ends = np.searchsorted(which, np.arange(len(vocabulary) + 1))
        self.postings = {int(t): row[ends[i]:ends[i + 1]] for i, t in enumerate(vocabulary)}
        self.n_rows = len(column)

    def rows(self, query: list[list[frozenset[int]]]) -> np.ndarray:
        """Rows that a Boolean query leaves; all rows for an empty query."""
        def both(a, b):
            return np.intersect1d(a, b, assume_unique=True)
        each = [reduce(np.union1d, [reduce(both, [self.postings[t] for t in sorted(s)]) for s in clause])
                for clause in query]
        return reduce(both, each) if each else np.arange(self.n_rows)


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_<kind> of each base rule,
    base_sha256 and spans (``kind:start:end`` by start, then rule order, joined
    by commas).  Null and empty texts have no span; rows that repeat a doc_id
    stay rows of their own; other columns of ``docs`` are not read."""
    rules = tuple(rules)
    base = [r.kind for r in rules if r.base]
    queries = [trigram_query(r.pattern) for r in rules]
    vocabulary = np.array(sorted({t for q in queries for clause in q for s in clause for t in s}), np.int64)
    schema = "doc_id long, " + "".join(f"n_{k} long, " for k in base) + "base_sha256 string, spans string"

    def run(batches):
        wanted = np.zeros(1 << 24, bool)
        wanted[vocabulary] = True
        for batch in batches:
            for part in wordhash.slices(batch, "text"):
                text = part.column("text")
                index = Index(text, vocabulary, wanted)
                found: dict[int, list[tuple[int, int, int]]] = {}
                full = [k for k, q in enumerate(queries) if not q]
                for k, (rule, query) in enumerate(zip(rules, queries)):
                    if query:
                        for i in index.rows(query).tolist():
                            got = rule.spans(text[i].as_py() or "")
                            if got:
                                found.setdefault(i, []).extend((s, k, e) for s, e in got)
                if full:
                    for i, value in enumerate(text.to_pylist()):
                        for k in full if value else ():
                            got = rules[k].spans(value)
                            if got:
                                found.setdefault(i, []).extend((s, k, e) for s, e in got)
                counts = {k: np.zeros(part.num_rows, np.int64) for k in base}
                digests, spans = [hashlib.sha256(b"").hexdigest()] * part.num_rows, [""] * part.num_rows
                for i, got in found.items():
                    got.sort()
                    named = [(rules[k], f"{rules[k].kind}:{s}:{e}") for s, k, e in got]
                    spans[i] = ",".join(x for _, x in named)
                    own = [x for r, x in named if r.base]
                    digests[i] = hashlib.sha256(",".join(own).encode()).hexdigest()
                    for r, _ in named:
                        if r.base:
                            counts[r.kind][i] += 1
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(counts[k]) for k in base], pa.array(digests), pa.array(spans)],
                    names=["doc_id", *[f"n_{k}" for k in base], "base_sha256", "spans"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


def _rule_sql(number: int, rule: Rule) -> str:
    """Matches, group and the pieces between matches of one rule; letters in
    either case are spelt out, as SQL's case folding knows more than ASCII."""
    pattern = rule.pattern
    if rule.ignore_case:
        head, tail = pattern.split(")", 1)  # all letters that matter stand in the first group
        pattern = re.sub(r"[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", head) + ")" + tail
    quoted = "'" + pattern.replace("'", "''") + "'"
    return (f"SELECT rid, {number} AS k, '{rule.kind}' AS kind, {rule.min_chars} AS least, regexp_extract_all(x, {quoted}) AS m, "
            f"regexp_extract_all(x, {quoted}, {rule.group}) AS g, string_split_regex(x, {quoted}) AS p FROM d WHERE regexp_matches(x, {quoted})")


#: Positions from the lengths of the matches and of the pieces between them.
OP6_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents),
found AS ({' UNION ALL '.join(_rule_sql(k, r) for k, r in enumerate(RULES))}),
each AS (SELECT rid, k, kind, least, m, g, p, unnest(range(1, len(m) + 1)) AS i FROM found),
place AS (SELECT rid, k, kind, least, length(g[i]) AS n_group, length(m[i]) AS n,
                 list_sum([length(z) for z in p[1:i]]) + coalesce(list_sum([length(z) for z in m[1:i - 1]]), 0) AS s FROM each),
kept AS (SELECT rid, k, kind, s, kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s + n AS BIGINT) AS VARCHAR) AS span
         FROM place WHERE n_group >= least)
SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
       count(*) FILTER (WHERE kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY s, k) FILTER (WHERE k < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY s, k), '') AS spans
FROM d LEFT JOIN kept USING (rid) GROUP BY rid, doc_id
"""
