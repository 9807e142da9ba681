"""DuckDB SQL for the correctness oracle.

Each driver query has an independent SQL formulation run by DuckDB over the
same parquet tables.  The derived fixtures are rebuilt here in SQL from the
raw tables, so both engines read identical input.  RE2's ``\\s`` is ASCII-only;
the test tables contain no other whitespace, so it agrees with the
Unicode-aware Spark patterns there.
"""

from __future__ import annotations

from clauseflow.functions import lexicon as lx
from clauseflow.sources import fixtures as fx

L = lx.sql_str_list


def STRIP(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def CLEAN(x: str) -> str:
    return STRIP(f"regexp_replace({x}, '\\s+', ' ', 'g')")


def WC(x: str) -> str:
    s = STRIP(x)
    return f"(CASE WHEN {s} = '' THEN 0 ELSE len(regexp_split_to_array({s}, '\\s+')) END)"


def SIMNORM(x: str) -> str:
    return CLEAN(f"regexp_replace(lower({x}), '[^a-z0-9\\s]', ' ', 'g')")


def UNIGRAMS(n: str) -> str:
    return f"list_filter(string_split({n}, ' '), lambda w: length(w) >= 2)"


def GRAMS(n: str) -> str:
    u = UNIGRAMS(n)
    return (f"list_concat({u}, CASE WHEN len({u}) >= 2 THEN "
            f"list_transform(range(1, len({u})), lambda i: {u}[i] || ' ' || {u}[i + 1]) "
            f"ELSE []::VARCHAR[] END)")


def ANY(lw: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({lw}, '{p}')" for p in phrases) + ")"


def NHITS(lw: str, phrases: list[str]) -> str:
    return "(" + " + ".join(f"(CASE WHEN contains({lw}, '{p}') THEN 1 ELSE 0 END)" for p in phrases) + ")"


def FIRST(lw: str, phrases: list[str]) -> str:
    return f"list_filter({L(sorted(phrases))}, lambda p: contains({lw}, p))[1]"


def VALID(x: str) -> str:
    return (f"({x} <> '' AND {WC(x)} BETWEEN {lx.CLAUSE_MIN_WORDS} AND {lx.CLAUSE_MAX_WORDS} "
            f"AND regexp_matches({x}, '^\\p{{Lu}}') AND {ANY(f'lower({x})', lx.CLAUSE_KEYWORDS)})")


def label_dim_cte() -> str:
    rows = ", ".join(
        f"({i}, '{lab}', '{tier}', " + ("NULL" if d is None else "'" + d.replace("'", "''") + "'") + ")"
        for i, lab, tier, d in lx.label_dim_rows())
    return f"label_dim(label_id, label, risk_tier, description) AS (VALUES {rows})"


def contracts_cte() -> str:
    S = L(fx.SENTENCES)
    sec = (
        "(CASE WHEN doc_id % 10 = 0 THEN '' ELSE CAST(k AS VARCHAR) || '.' || CAST(doc_id % 9 + 1 AS VARCHAR) || ' ' END)"
        f" || 'Terms of part. ' || {S}[(doc_id * 7 + k * 8) % 24 + 1] || '. '"
        f" || {S}[(doc_id * 7 + k * 8 + 3) % 24 + 1] || '; ' || {S}[(doc_id * 7 + k * 8 + 6) % 24 + 1]"
        " || (CASE WHEN k % 2 = 0 THEN ' as set out in part ' || CAST(k AS VARCHAR) ELSE '' END) || '.'"
    )
    return (
        "fx_contracts AS (SELECT doc_id AS contract_id, 'contracts/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, "
        "'.txt' AS extension, CAST(octet_length(encode(t)) AS BIGINT) AS n_bytes, t AS text FROM ("
        f"SELECT doc_id, '{fx.PREAMBLE}' || array_to_string(list_transform(range(1, 4 + doc_id % 5), lambda k: {sec}), chr(10))"
        " || chr(10) || text AS t FROM documents))"
    )


def sections_cte(src: str = "fx_contracts") -> str:
    return (
        "fx_secs AS (SELECT contract_id, CASE WHEN text IS NULL OR text = '' THEN []::VARCHAR[] "
        "WHEN len(parts) > 1 THEN list_transform(parts[2:], lambda p: regexp_extract(p, '^(\\d+\\.\\d+)', 1) || ' ' || "
        + STRIP("regexp_replace(p, '^\\d+\\.\\d+\\s+', '')") + ") "
        f"ELSE [{STRIP('text')}] END AS secs FROM (SELECT contract_id, text, "
        "string_split(regexp_replace(text, '(\\d+\\.\\d+\\s+)', chr(1) || '\\1', 'g'), chr(1)) AS parts "
        f"FROM {src} WHERE {STRIP('text')} <> ''))"
    )


def parts_cte() -> str:
    inner = (f"list_filter(list_transform(regexp_split_to_array(s, ';\\s+|\\.\\s+'), lambda p: {STRIP('p')}), "
             "lambda p: p <> '')")
    return (
        "fx_parts AS (SELECT contract_id, flatten(list_transform(secs, lambda s, i: list_transform("
        f"{inner}, lambda p, j: {{'section_idx': CAST(i - 1 AS INTEGER), 'part_idx': CAST(j - 1 AS INTEGER), 'text': p}}))) AS parts "
        "FROM fx_secs)"
    )


def clauses_cte() -> str:
    return (
        "fx_clauses AS (SELECT contract_id, CAST(c.clause_idx AS INTEGER) AS clause_idx, c.section_idx, c.part_idx, c.text "
        "FROM (SELECT contract_id, unnest(list_transform(list_filter(parts, lambda x: "
        + VALID("x.text") +
        "), lambda x, n: {'clause_idx': n - 1, 'section_idx': x.section_idx, 'part_idx': x.part_idx, 'text': x.text})) AS c "
        "FROM fx_parts))"
    )


def predictions_cte() -> str:
    LB = L(lx.LABELS)
    lid = "((ascii(substr(text, 1, 1)) * 7 + ascii(substr(text, 3, 1)) + contract_id) % 41)"
    conf = "(((contract_id * 37 + clause_idx * 29) % 100) / 100.0)"
    return (
        f"fx_pred AS (SELECT contract_id, clause_idx, text, CASE WHEN {conf} < {lx.UNCERTAIN_BELOW} THEN 'uncertain' "
        f"ELSE {LB}[{lid} + 1] END AS label, CAST({conf} AS DOUBLE) AS confidence, "
        f"{LB}[{lid} + 1] AS top1, {LB}[({lid} + 1) % 41 + 1] AS top2, {LB}[({lid} + 2) % 41 + 1] AS top3 "
        "FROM fx_clauses)"
    )


def base_ctes() -> list[str]:
    return [contracts_cte(), sections_cte(), parts_cte(), clauses_cte(), predictions_cte(), label_dim_cte()]


def risk_select(src: str, extra: str = "") -> str:
    """R1 over ``src`` (text, label) -> adds risk, risk_score, reason."""
    lw = f"lower({STRIP('coalesce(t.text, ' + chr(39) + chr(39) + ')')})"
    lab = f"lower({STRIP('coalesce(t.label, ' + chr(39) + chr(39) + ')')})"
    hi, med = FIRST(lw, lx.HIGH_RISK_PHRASES), FIRST(lw, lx.MEDIUM_RISK_PHRASES)
    tier = "coalesce(d.risk_tier, 'LOW')"
    base = (f"(CASE WHEN {tier} = 'HIGH' THEN 'High-risk label: ''' || {lab} || '''' "
            f"WHEN {tier} = 'MEDIUM' THEN 'Medium-risk label: ''' || {lab} || '''' "
            f"ELSE 'Label ''' || (CASE WHEN {lab} = '' THEN 'unknown' ELSE {lab} END) || ''' is not in configured risk lists' END)")
    lreason = f"(CASE WHEN coalesce(d.description, '') <> '' THEN {base} || '. ' || d.description ELSE {base} END)"
    return (
        f"SELECT t.*{extra}, CASE WHEN {hi} IS NOT NULL THEN 'HIGH' WHEN {med} IS NOT NULL THEN 'MEDIUM' ELSE {tier} END AS risk, "
        f"CASE WHEN {hi} IS NOT NULL THEN 'Contains ''' || {hi} || ''' (high-risk language)' "
        f"WHEN {med} IS NOT NULL THEN 'Contains ''' || {med} || ''' (medium-risk language)' ELSE {lreason} END AS reason "
        f"FROM {src} t LEFT JOIN label_dim d ON d.label = {lab}"
    )


def bias_cols(text: str = "text") -> str:
    lw = f"lower({STRIP(f'coalesce({text}, {chr(39)}{chr(39)})')})"
    hits = f"list_filter({lx_weighted_sql()}, lambda x: contains({lw}, x.p))"
    score = (f"(coalesce(list_sum(list_transform({hits}, lambda x: x.w)), 0) + "
             f"(CASE WHEN {ANY(lw, lx.BIAS_BALANCED_PHRASES)} THEN -2 ELSE 0 END) + "
             f"(CASE WHEN len(regexp_extract_all({lw}, '\\\\b(shall|must|required to|obligated to)\\\\b')) > "
             f"len(regexp_extract_all({lw}, '\\\\b(may|entitled to|has the right to)\\\\b')) THEN 1 ELSE 0 END) + "
             f"(CASE WHEN contains({lw}, 'only') THEN 1 ELSE 0 END))")
    trig = f"array_to_string(list_sort(list_distinct(list_transform({hits}, lambda x: x.p))), '|')"
    blank = f"({STRIP(f'coalesce({text}, {chr(39)}{chr(39)})')} = '')"
    return (f"CASE WHEN {blank} THEN 0 ELSE CAST({score} AS INTEGER) END AS bias_score, "
            f"CASE WHEN {blank} THEN false ELSE {score} >= 2 END AS is_one_sided, "
            f"CASE WHEN {blank} THEN '' ELSE {trig} END AS triggers")


def lx_weighted_sql() -> str:
    return "[" + ", ".join(f"{{'p': '{p}', 'w': {w}}}" for p, w in lx.ONE_SIDED_PHRASES) + "]"


def with_ctes(ctes: list[str], body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


def important_ctes(min_conf: float = lx.IMPORTANT_MIN_CONFIDENCE) -> list[str]:
    """fx_imp: R3 candidates (before dedup) with risk_ord."""
    f = (f"SELECT contract_id, clause_idx, {STRIP('text')} AS text, coalesce(label, '') AS label, "
         f"coalesce(confidence, 0.0) AS confidence FROM fx_pred WHERE {STRIP('coalesce(text, ' + chr(39) * 2 + ')')} <> '' "
         f"AND coalesce(confidence, 0.0) >= {min_conf}")
    return [
        f"fx_f AS ({f})",
        f"fx_r AS ({risk_select('fx_f')})",
        "fx_imp AS (SELECT *, CASE risk WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END AS risk_ord, "
        "CASE risk WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END AS risk_score "
        "FROM fx_r WHERE risk IN ('HIGH', 'MEDIUM'))",
    ]


def one_sided_ctes(min_conf: float = lx.IMPORTANT_MIN_CONFIDENCE) -> list[str]:
    f = (f"SELECT contract_id, clause_idx, {STRIP('text')} AS text, coalesce(label, '') AS label, "
         f"coalesce(confidence, 0.0) AS confidence FROM fx_pred WHERE {STRIP('coalesce(text, ' + chr(39) * 2 + ')')} <> '' "
         f"AND coalesce(confidence, 0.0) >= {min_conf}")
    return [
        f"fx_of AS ({f})",
        f"fx_or AS ({risk_select('fx_of')})",
        f"fx_ob AS (SELECT *, {bias_cols('text')} FROM fx_or WHERE risk = 'HIGH')",
        "fx_os AS (SELECT contract_id, clause_idx, text, label, confidence, risk, 2 AS risk_score, bias_score, "
        "CASE WHEN triggers <> '' THEN reason || '. One-sided triggers: ' || replace(triggers, '|', ', ') ELSE reason END AS reason, "
        "triggers FROM fx_ob WHERE is_one_sided)",
    ]


def dedup_ctes(src: str, order_sql: str, out: str, gk: str = "contract_id", idc: str = "clause_idx",
               text: str = "text", label: str = "label", threshold: float = lx.SEMANTIC_DEDUP_THRESHOLD) -> list[str]:
    """Ordered greedy TF-IDF dedup of ``src`` -> ``out`` (kept rows of src)."""
    p = out + "_"
    return [
        f"{p}n AS (SELECT {gk} AS g, {idc} AS id, {label} AS lab, {SIMNORM(text)} AS nrm, "
        f"row_number() OVER (PARTITION BY {gk}, {label} ORDER BY {order_sql}) AS r FROM {src})",
        f"{p}t AS (SELECT g, id, unnest({GRAMS('nrm')}) AS tok FROM {p}n)",
        f"{p}tf AS (SELECT g, id, tok, count(*) AS tf FROM {p}t GROUP BY g, id, tok)",
        f"{p}df AS (SELECT g, tok, count(*) AS dfreq FROM {p}tf GROUP BY g, tok)",
        f"{p}nd AS (SELECT g, count(*) AS n_docs FROM {p}n GROUP BY g)",
        f"{p}w AS (SELECT tf.g, tf.id, tf.tok, tf.tf * (ln((1 + nd.n_docs) / (1 + df.dfreq)) + 1) AS w "
        f"FROM {p}tf tf JOIN {p}df df ON tf.g = df.g AND tf.tok = df.tok JOIN {p}nd nd ON tf.g = nd.g)",
        f"{p}l2 AS (SELECT g, id, sqrt(sum(w * w)) AS l2 FROM {p}w GROUP BY g, id)",
        f"{p}u AS (SELECT w.g, w.id, w.tok, w.w / l2.l2 AS u FROM {p}w w JOIN {p}l2 l2 ON w.g = l2.g AND w.id = l2.id)",
        f"{p}pairs AS (SELECT a.g, a.id AS i, b.id AS j, sum(a.u * b.u) AS cos FROM {p}u a JOIN {p}u b "
        f"ON a.g = b.g AND a.tok = b.tok AND a.id <> b.id GROUP BY a.g, a.id, b.id)",
        f"{p}nbr AS (SELECT nj.g, nj.id, list(ni.r) AS nbrs FROM {p}pairs pr "
        f"JOIN {p}n ni ON ni.g = pr.g AND ni.id = pr.i JOIN {p}n nj ON nj.g = pr.g AND nj.id = pr.j "
        f"WHERE ni.lab = nj.lab AND ni.r < nj.r AND pr.cos >= {threshold} GROUP BY nj.g, nj.id)",
        f"{p}o AS (SELECT n.g, n.lab, n.r, n.id, coalesce(nb.nbrs, []::BIGINT[]) AS nbrs FROM {p}n n "
        f"LEFT JOIN {p}nbr nb ON n.g = nb.g AND n.id = nb.id)",
        f"{p}walk AS (SELECT g, lab, r, [r] AS kept FROM {p}o WHERE r = 1 "
        f"UNION ALL SELECT w.g, w.lab, o.r, CASE WHEN list_has_any(w.kept, o.nbrs) THEN w.kept "
        f"ELSE list_append(w.kept, o.r) END FROM {p}walk w JOIN {p}o o ON o.g = w.g AND o.lab = w.lab AND o.r = w.r + 1)",
        f"{p}kept AS (SELECT g, lab, unnest(arg_max(kept, r)) AS r FROM {p}walk GROUP BY g, lab)",
        f"{out} AS (SELECT s.* FROM {src} s JOIN {p}n n ON n.g = s.{gk} AND n.id = s.{idc} "
        f"JOIN {p}kept k ON k.g = n.g AND k.lab = n.lab AND k.r = n.r)",
    ]
