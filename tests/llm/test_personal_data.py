"""op13: personal data against a plain scan with the contract's own patterns."""

import hashlib
import re
import time

from clauseflow.llm import common, personal_data, registry

SF = "/root/testdata/sf0.01"
KINDS = ("email", "ip", "card", "phone")
EMPTY = hashlib.sha256(b"").hexdigest()


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _expected(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    # Python's engine takes time in the square of a long run that has no match: not asked where there is none
    email, address = text if "@" in text else "", text if "." in text else ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", email)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", address)
              if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
              if 14 <= len(digits(m[0])) <= 19 and _luhn(digits(m[0]))]
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    spans = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))
    return (*(sum(k == i for _, i, _ in found) for k in range(4)), hashlib.sha256(spans.encode()).hexdigest())


def _got(df):
    return sorted(((r["doc_id"], *(r[f"n_{k}"] for k in KINDS), r["base_sha256"]) for r in df.collect()), key=str)


ODD = [
    (30, "é a@b.c@d.e a@b.c.@d.e.f @x.y x@y .@.. a@-.- %@a.b😀ü+1@2.3", None),
    (31, "1.2.3.4.5.6.7.8 256.1.1.1 000255.00.0.1 1.2.3 1..2.3.4 999999999999999999999.1.1.1 10.0.0.1.", None),
    (32, "4465758382889437 4465 7583-8288 9437x4465758382889437 4465  758382889437 00000000000000 0 0 0", None),
    (33, "+1 (743) 555-3824 ++49 30 1234567 +1 5 + 1 +12345678901234567890 +1.2.3.4.5.6.7.8.9.0( +1(((((((2", None),
    (34, "٣٤٥٦ ١.٢.٣.٤ １.２.３.４ +٤٩ 30 1234567", None)]


def test_base_spans(spark, make_docs, odd_rows):
    rows = odd_rows + ODD
    for df, pairs in ((make_docs(rows), [r[:2] for r in rows]),
                      (t := common.table(spark, SF, "documents"), t.select("doc_id", "text").collect())):
        assert _got(personal_data.scan(df)) == sorted(((d, *_expected(x)) for d, x in pairs), key=str)


def test_very_long_runs_and_many_matches(make_docs):
    rows = [(1, "a" * 600_000), (2, "1" * 600_000), (3, "a@" + "b." * 200_000), (4, "+1" + "(" * 300_000), (5, "1." * 200_000),
            (6, "x.y@mail.example 10.0.0.1 +49 30 1234567 " * 20_000), (7, "1 " * 300_000), (8, "A1" * 300_000)]
    began = time.time()
    assert _got(personal_data.scan(make_docs(rows))) == sorted(((d, *_expected(x)) for d, x in rows), key=str)
    assert time.time() - began < 60


def test_rules_of_the_method(make_docs):
    iban = "DE89 3704 0044 0532 0130 00"
    rows = [(1, f"Konto {iban}."), (2, iban.replace("89", "88")), (3, "GB82WEST12345698765432, xGB82WEST12345698765432"),
            (4, "social security 123-45-6789"), (5, "part 123-45-6789"), (6, "ssn 1123-45-6789, ssn 666-45-6789"),
            (7, "mail: ann@site.org"), (8, "an example: ann@site.org"), (9, "ann@site.org")]
    got = {r["doc_id"]: r for r in personal_data.scan(make_docs(rows)).collect()}
    spans = {k: r["spans"] for k, r in got.items()}
    assert spans[1] == f"iban:6:{6 + len(iban)}" and spans[2] == "" and spans[3] == "iban:0:22"
    assert spans[4] == "ssn:16:27" and spans[5] == "" and spans[6] == ""
    assert got[1]["base_sha256"] == EMPTY and got[4]["points"] == "55"
    assert [got[k]["points"] for k in (7, 8, 9)] == ["95", "45", "70"]
    (row,) = personal_data.spans(make_docs([(1, "é " + iban)])).collect()
    assert [tuple(s) for s in row["spans"]] == [(2, 4, 29, 75, iban)]


def test_empty_table_and_plan(spark, make_docs):
    assert personal_data.scan(make_docs([])).count() == 0
    plan = personal_data.op13(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_same_rows_as_the_sql(spark, make_docs, odd_rows):
    import duckdb
    rows = [r for r in odd_rows if len(r[1] or "") < 300_000] + ODD
    for df in (make_docs(rows), common.table(spark, SF, "documents")):
        con = duckdb.connect()
        con.register("documents", df.select("doc_id", "text").toPandas())
        want = con.execute(registry.ORACLE["op13_personal_data"])
        names = [c[0] for c in want.description]
        got = personal_data.scan(df)
        assert sorted(got.columns) == sorted(names)
        assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)
