"""G1-G5 against a plain restatement of the segmentation rules."""
import re

from clauseflow.operators import segment as sg


def ref_sections(text):
    """Brute force: cut the text at every section head, drop what precedes the first."""
    if not text:
        return []
    heads = list(re.finditer(r"(\d+\.\d+)\s+", text))
    if not heads:
        return [text.strip()]
    out = []
    for k, m in enumerate(heads):
        end = heads[k + 1].start() if k + 1 < len(heads) else len(text)
        out.append(m.group(1) + " " + text[m.end():end].strip())
    return out


def ref_clauses(text):
    keys = ["shall", "may", "must", "agree", "liable", "terminate"]
    res = []
    for sec in ref_sections(text) if text else []:
        for p in re.split(r";\s+|\.\s+", sec):
            p = p.strip()
            w = p.split()
            if p and 5 <= len(w) <= 120 and p[0].isupper() and any(k in p.lower() for k in keys):
                res.append(p)
    return res


TEXTS = [
    "Intro text is dropped. 1.1 The Buyer shall pay the fee now. Seller may deliver the goods later; "
    "Either party may terminate with notice.\n1.2 Costs rise by 5.25 million dollars. Agent must keep the books.",
    "No numbers here. The Buyer shall pay the full fee; the Seller may refuse. Final clause shall stay here.",
    "12.3 Twelve point three shall not be cut again at 2.3 here. Buyer shall keep this clause intact",
    "",
    "   ",
    "1.1 2.2 Empty first section. Supplier shall ship all goods on time.",
]


def test_sections_and_clauses_match_reference_rules(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "contract_id long, text string")
    secs = {}
    for r in sg.split_sections(df).collect():
        secs.setdefault(r["contract_id"], []).append((r["section_idx"], r["section_text"]))
    cls = {}
    for r in sg.split_into_clauses(df).collect():
        cls.setdefault(r["contract_id"], []).append((r["clause_idx"], r["text"]))
    for i, t in enumerate(TEXTS):
        assert [s for _, s in sorted(secs.get(i, []))] == ref_sections(t), t
        assert [c for _, c in sorted(cls.get(i, []))] == ref_clauses(t), t


def test_numbered_first_sentence_is_dropped(spark):
    df = spark.createDataFrame([(1, "1.1 Buyer shall pay. Seller shall ship the goods today")], "contract_id long, text string")
    got = [r["text"] for r in sg.split_into_clauses(df).collect()]
    assert got == ["Seller shall ship the goods today"]


import pytest


@pytest.mark.parametrize("block", [1024, 2, 1])
def test_merge_fragments(spark, block):
    rows = [(1, 0, "Short one shall"), (1, 1, "Another short one"),
            (1, 2, "This clause is long enough to count as a long clause for merging purposes here"),
            (1, 3, "Tail fragment shall")]
    df = spark.createDataFrame(rows, "contract_id long, clause_idx int, text string")
    got = sorted((r["first_idx"], r["text"], r["n_parts"]) for r in sg.merge_fragments(df, block=block).collect())
    assert got == [(0, "Short one shall Another short one", 2), (2, rows[2][2], 1), (3, "Tail fragment shall", 1)]
