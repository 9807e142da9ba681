"""Personal data scan, in DataFrame functions only.

A rule's regular expression proposes spans, a validator confirms them (Luhn for
card numbers, mod-97 for IBANs, ranges for addresses, digit counts for phone
numbers), and words within ``REACH`` characters raise or lower the span's
points.  Spans of base rules always stay; those of other rules need
``ENOUGH`` points.

A text is scanned where it lies: matches and the pieces between them are arrays
of the row, positions are running sums of their lengths, so there is no
shuffle and no row a span.  Patterns are possessive and look behind where a run
could start anew at each of its characters, which keeps them linear in texts of
any length.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clauseflow.functions.textcols import with_computed

from . import common

#: Code points on either side in which context words count.
REACH = 48
#: Points that a context word adds or takes, and that a span of a rule that is not a base rule needs.
CONTEXT, ENOUGH = 25, 50


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _small_parts(match: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
    return match.rlike(rf"^{part}(?:\.{part}){{3}}$")


def _luhn(match: Column) -> Column:
    return F.length(_digits(match)).between(14, 19) & F.call_function("luhn_check", _digits(match))


def _mod97(match: Column) -> Column:
    """ISO 13616: the first four characters go last, letters count from 10."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    chars = F.split(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4))), "")

    def step(rest, c):
        return F.when(c <= "9", (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)
    return F.length(plain).between(15, 34) & (F.aggregate(chars, F.lit(0), step) == 1)


def _any(match: Column) -> Column:
    return F.lit(True)


@dataclass(frozen=True)
class Rule:
    """``pattern`` matches what ``plain`` (the same for engines without
    possessive repeats and look-behind) does.  ``edge``: what may not stand on
    either side of a match."""
    kind: str
    pattern: str
    plain: str
    confirmed: Callable[[Column], Column]
    points: int
    near: str
    edge: str = ""
    base: bool = False


# The rules. Base rules come first, in the order of their kinds.
RULES = (
    Rule("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", _any, 70,
         "e-?mail|mail|contact|write|courriel|correo", base=True),
    Rule("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", _small_parts, 50,
         "ip|address|host|server|login|adresse|servidor", base=True),
    Rule("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9]([\x20-]?[0-9])+", _luhn, 70,
         "card|credit|debit|visa|payment|carte|karte|tarjeta", base=True),
    Rule("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]",
         lambda m: F.length(_digits(m)).between(10, 15), 55,
         "phone|tel|call|mobile|fax|telefon|portable|llama", base=True),
    Rule("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
         r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", _mod97, 75,
         "iban|account|bank|konto|compte|cuenta", edge="[A-Za-z0-9]"),
    Rule("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
         lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), 30,
         "ssn|social|security|taxpayer", edge="[0-9-]"),
)
#: Words that make any span less likely to be a person's.
DOUBT = "example|sample|dummy|placeholder|exemple|beispiel|ejemplo"


def _word(words: str) -> str:
    """Whole ASCII words, in lower case."""
    return f"(?:^|[^a-z])(?:{words})(?:[^a-z]|$)"


def spans(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of ``docs``: doc_id and spans, an array of (start, rule,
    end, points, text) by start, then rule; ``rule`` counts ``rules`` from 0,
    positions are code points, the end is exclusive.

    Matches of one rule don't overlap and are taken from the left; one that is
    not confirmed uses up its characters.  Null and empty texts have no span;
    rows that repeat a doc_id stay rows of their own; other columns of
    ``docs`` are not read."""
    n = range(len(rules))
    none = F.array().cast("array<string>")
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = with_computed(df, {f"m{k}": F.when(F.col("text").rlike(rules[k].pattern),
                                            F.regexp_extract_all("text", F.lit(rules[k].pattern), F.lit(0))).otherwise(none) for k in n})
    some = [F.size(f"m{k}") > 0 for k in n]
    df = with_computed(df, {f"p{k}": F.when(some[k], F.split("text", rules[k].pattern)).otherwise(none) for k in n}).drop("text")

    def step(k):  # from the start of one match to that of the next
        return F.transform(f"m{k}", lambda m, i: F.length(F.get(F.col(f"p{k}"), i))
                           + F.when(i > 0, F.length(F.get(F.col(f"m{k}"), i - 1))).otherwise(0))

    # running sums by blocks of about sqrt(n) matches: time grows as n ** 1.5, not as n ** 2
    def total(lengths):
        return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)

    def blocks(k):
        last = F.ceil(F.size(f"s{k}") / F.col(f"w{k}")).cast("int") - 1
        return F.when(some[k], F.transform(F.sequence(F.lit(0), last),
                                           lambda b: F.slice(f"s{k}", b * F.col(f"w{k}") + 1, F.col(f"w{k}"))))
    df = with_computed(df, {f"s{k}": step(k) for k in n} | {f"w{k}": F.ceil(F.sqrt(F.size(f"m{k}"))).cast("int") for k in n})
    df = with_computed(df, {f"s{k}": blocks(k) for k in n})
    df = with_computed(df, {f"t{k}": F.transform(f"s{k}", total) for k in n})

    def found(k):
        rule = rules[k]

        def span(m, i):
            block = F.floor(i / F.col(f"w{k}")).cast("int")
            start = (total(F.slice(f"t{k}", F.lit(1), block))
                     + total(F.slice(F.get(F.col(f"s{k}"), block), F.lit(1), i % F.col(f"w{k}") + 1)))
            before, after = F.get(F.col(f"p{k}"), i), F.get(F.col(f"p{k}"), i + 1)
            around = F.lower(F.concat(F.right(before, F.lit(REACH)), F.lit(" "), F.left(after, F.lit(REACH))))
            points = (F.lit(rule.points) + F.when(around.rlike(_word(rule.near)), CONTEXT).otherwise(0)
                      - F.when(around.rlike(_word(DOUBT)), CONTEXT).otherwise(0))
            ok = rule.confirmed(m)
            if rule.edge:
                ok = ok & ~F.right(before, F.lit(1)).rlike(rule.edge) & ~F.left(after, F.lit(1)).rlike(rule.edge)
            return F.when(ok, F.struct(start.alias("start"), F.lit(k).alias("rule"), (start + F.length(m)).alias("end"),
                                       F.least(F.lit(100), points).alias("points"), m.alias("text")))
        kept = F.filter(F.transform(f"m{k}", span), lambda x: x.isNotNull())
        return kept if rule.base else F.filter(kept, lambda x: x["points"] >= ENOUGH)
    return with_computed(df, {"spans": F.sort_array(F.concat(*[found(k) for k in n]))}).select("doc_id", "spans")


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_<kind> of each base rule,
    base_sha256, spans (``kind:start:end`` by start, then rule, joined by
    commas) and points (of each span, joined likewise)."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    n_base = sum(r.base for r in rules)

    def text(which):
        return F.array_join(F.transform(which, lambda s: F.concat_ws(
            ":", F.get(names, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    def count(k):
        return F.size(F.filter("spans", lambda s: s["rule"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["rule"] < n_base)
    return spans(docs, rules).select(
        "doc_id", *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(rules) if r.base],
        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["points"].cast("string")), ",").alias("points"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


_PART_SQL = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: The validators once more, in SQL, of the match m.
_CONFIRMED_SQL = {
    "email": "true",
    "ip": rf"regexp_full_match(m, '{_PART_SQL}(\.{_PART_SQL}){{3}}')",
    "card": "length(d) BETWEEN 14 AND 19 AND list_sum([CASE WHEN (length(d) - i) % 2 = 0 THEN CAST(d[i] AS INT) "
            "ELSE CAST(d[i] AS INT) * 2 - CASE WHEN CAST(d[i] AS INT) > 4 THEN 9 ELSE 0 END END FOR i IN range(1, length(d) + 1)]) % 10 = 0",
    "phone": "length(d) BETWEEN 10 AND 15",
    "iban": "length(w) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, [CASE WHEN c <= '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END "
            "FOR c IN string_split(w[5:] || w[:4], '')]), lambda a, x: CASE WHEN x < 10 THEN (a * 10 + x) % 97 ELSE (a * 100 + x) % 97 END) = 1",
    "ssn": "NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$')",
}


def _rule_sql(k: int, rule: Rule) -> str:
    p = "'" + rule.plain.replace("'", "''") + "'"
    edge = f" AND NOT regexp_matches(p0[-1:], '{rule.edge}') AND NOT regexp_matches(p1[:1], '{rule.edge}')" if rule.edge else ""
    least = "" if rule.base else f" AND points >= {ENOUGH}"
    return f"""SELECT rid, {k} AS k, '{rule.kind}:' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s + length(m) AS BIGINT) AS VARCHAR) AS span, s, points
FROM (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS d, replace(m, ' ', '') AS w, least(100, {rule.points}
             + CASE WHEN regexp_matches(around, '{_word(rule.near)}') THEN {CONTEXT} ELSE 0 END
             - CASE WHEN regexp_matches(around, '{_word(DOUBT)}') THEN {CONTEXT} ELSE 0 END) AS points
      FROM (SELECT *, lower(right(p0, {REACH}) || ' ' || left(p1, {REACH})) AS around
            FROM (SELECT rid, ms[i] AS m, ps[i] AS p0, ps[i + 1] AS p1,
                         list_sum([length(z) FOR z IN ps[1:i]]) + coalesce(list_sum([length(z) FOR z IN ms[1:i - 1]]), 0) AS s
                  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i
                        FROM (SELECT rid, regexp_extract_all(x, {p}) AS ms, string_split_regex(x, {p}) AS ps
                              FROM d WHERE regexp_matches(x, {p}))))))
WHERE {_CONFIRMED_SQL[rule.kind]}{edge}{least}"""


OP13_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents),
kept AS ({' UNION ALL '.join(_rule_sql(k, r) for k, r in enumerate(RULES))})
SELECT doc_id, {', '.join(f"count(*) FILTER (WHERE k = {k}) AS n_{r.kind}" for k, r in enumerate(RULES) if r.base)},
       sha256(coalesce(string_agg(span, ',' ORDER BY s, k) FILTER (WHERE k < {sum(r.base for r in RULES)}), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY s, k), '') AS spans,
       coalesce(string_agg(CAST(points AS VARCHAR), ',' ORDER BY s, k), '') AS points
FROM d LEFT JOIN kept USING (rid) GROUP BY rid, doc_id
"""
