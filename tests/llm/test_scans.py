"""op3 (licenses), op5 (benchmark leaks), op6 (secrets), op7 (WARC)."""

import base64
import hashlib
import re

import pytest

from clauseflow.llm import common, decontaminate, license_scan, secret_scan, warc
import brute

SF = "/root/testdata/sf0.01"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def _expected_base(text):
    n, places = brute.phrase_places(text, BASE)
    starts = sorted(p for ps in places.values() for p in ps)
    return (n, len(starts), starts[0] if starts else None, starts[-1] if starts else None,
            ",".join(sorted(BASE[p] for p, ps in places.items() if ps)))


def _scanned(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in df.collect()),
                  key=str)


def test_license_base_places(spark, make_docs, odd_rows):
    rows = odd_rows + [(20, "MIT License mit license-MIT\nLICENSE general public mit license", None),
                       (21, "the General, Public; License! v3 apache\tlicense", None), (22, "mit  licenses; mit", None),
                       (23, ("mit license " * 5000) + "general public license", None), (24, "general general public license", None)]
    got = license_scan.scan(make_docs(rows))
    assert _scanned(got) == sorted(((d, *_expected_base(t)) for d, t, *_ in rows), key=str)
    assert all(0 <= r["score"] <= 1 for r in got.collect())


def test_license_notices_survive_small_edits(make_docs):
    notice = next(t.text for t in license_scan.TEMPLATES if t.label == "isc" and t.coverage < 1)
    words = notice.split()
    edited = " ".join(words[:12] + ["really"] + words[12:])
    halved = " ".join(words[:len(words) // 2])
    got = {r["doc_id"]: r for r in license_scan.scan(make_docs([(1, "x " + edited + " y"), (2, halved), (3, "isc license")])).collect()}
    assert got[1]["labels"] == "isc" and got[1]["n_base"] == 0 and 0.8 <= got[1]["score"] < 1
    assert got[2]["labels"] == "" and got[2]["score"] < 0.8
    assert got[3]["labels"] == "isc" and got[3]["score"] == 1


def test_license_whole_table(spark):
    docs = common.table(spark, SF, "documents")
    want = sorted(((r["doc_id"], *_expected_base(r["text"])) for r in docs.select("doc_id", "text").collect()), key=str)
    assert _scanned(license_scan.op3(spark, SF)) == want


def test_license_empty_table(make_docs):
    assert license_scan.scan(make_docs([])).count() == 0


def test_license_uses_no_python(spark):
    plan = license_scan.op3(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


KINDS = ("assign", "access", "hex")


def _either(word):
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def _expected_secrets(text):
    names = "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = re.compile("(" + names + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    spans = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))
    return (*(sum(k == i for _, i, _ in found) for k in range(3)), hashlib.sha256(spans.encode()).hexdigest())


def test_secrets_against_plain_scan(spark, make_docs, odd_rows):
    rows = odd_rows + [
        (30, 'é token = "short" password:hunter22 PassWord=\'abcdefg\' api_key = x.y-z+/=', None),
        (31, "AKIA" + "A" * 16 + " AKIAAKIA" + "0" * 20 + " AKIA" + "B" * 15, None),
        (32, "f" * 24 + " " + "0" * 23 + " " + "a" * 100 + "g", None),
        (33, "tokentoken=tokentoken: Key toKen  =  secret=12345 secret : '1234567", None),
        (34, "ſecret=abcdefgh apiKey:abcdefgh", None), (35, "padding " * 100_000 + "token=abcdef123", None)]
    for df, pairs in ((make_docs(rows), [r[:2] for r in rows]),
                      (t := common.table(spark, SF, "documents"), t.select("doc_id", "text").collect())):
        got = sorted(((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in secret_scan.scan(df).collect()), key=str)
        assert got == sorted(((d, *_expected_secrets(x or "")) for d, x in pairs), key=str)


def test_secret_rules_of_the_method(make_docs):
    text = "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1B2" * 9 + " xoxb-0123456789ab"
    (row,) = secret_scan.scan(make_docs([(1, text)])).collect()
    assert row["spans"].startswith("private_key:0:31,forge_token:32:72,chat_token:73:90")


def test_trigram_queries():
    q = secret_scan.trigram_query
    tri = lambda s: frozenset(ord(s[i]) << 16 | ord(s[i + 1]) << 8 | ord(s[i + 2]) for i in range(len(s) - 2))
    assert q("abcd") == [[tri("abcd")]]
    assert q("abc.*def") == [[tri("abc")], [tri("def")]]
    assert sorted(map(sorted, q("(abc|xyz)")[0])) == sorted(map(sorted, [tri("abc"), tri("xyz")]))
    assert q("ab[cd]") == [sorted([tri("abc"), tri("abd")], key=sorted)]
    assert q("[0-9a-f]+") == [] and q("ab?") == [] and q("(abc)?") == []
    assert q("(abcx)+z") == [[tri("abcx")]]


def test_secret_index_matches_full_scan(make_docs):
    import pyarrow as pa
    import numpy as np
    texts = pa.array(["abc def", "xabcx", None, "", "abdef", "ABCDEF", "ab", "c"])
    query = secret_scan.trigram_query("abc.*def")
    words = np.array(sorted({t for c in query for s in c for t in s}))
    wanted = np.zeros(1 << 24, bool)
    wanted[words] = True
    for piece in (1, 3, 1 << 19):
        assert secret_scan.Index(texts, words, wanted, piece).rows(query).tolist() == [0, 5]


def test_secret_empty_table(make_docs):
    assert secret_scan.scan(make_docs([])).count() == 0


def _leak_rows(df):
    return {(r["doc_id"], r["item_id"], r["n_item_shingles"], r["n_shared"]) for r in df.collect()}


def test_leaks_against_plain_search(spark, make_docs):
    item = " ".join(f"q{i}" for i in range(30))
    far = " ".join(f"f{i}" for i in range(3000))
    edited = item.replace("q15", "zz")  # 21 of 26 shingles: contained at 0.8
    broken = item.replace("q10", "zz").replace("q20", "zz")
    rows = [(1, f"{far} {item.upper()} {far}"), (2, f"{far} {edited} {far}"), (3, f"{far} {broken}"), (4, None), (5, ""),
            (6, "only four words here"), (7, "only four words"), (None, f"x, {item}!"), (1, "other text of the same id"), (8, item[:40] + far + item[40:])]
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "Only four words here."), (5, "q1 q2 q3 q4 q5")], "item_id long, text string")
    got = decontaminate.leaks(make_docs(rows), items)
    assert _leak_rows(got) == {x for x in brute.leaks([(i, t) for i, (_, t, *_) in enumerate(rows)], [(1, item), (4, "Only four words here."), (5, "q1 q2 q3 q4 q5")])
                               for x in [(rows[x[0]][0], *x[1:])]}
    kept = decontaminate.clean(make_docs(rows), items)
    assert kept.columns == make_docs(rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 7]


def test_pipeline_stage_keeps_clean_rows_of_leaking_ids(spark, make_docs, tmp_path):
    import corpus_pipeline
    item = " ".join(f"q{i}" for i in range(30))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = make_docs([(None, f"x {item}"), (None, "no id, clean"), (None, None), (1, item), (1, "clean text"), (2, "other")])
    kept = corpus_pipeline.drop_benchmark_leaks(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(
        [(None, "no id, clean"), (None, None), (1, "clean text"), (2, "other")], key=str)


def test_leaks_small_items_in_long_documents(spark, make_docs):
    """Items of 5 to 24 words, whole and with as much missing as may, each inside a long document."""
    texts = [" ".join(f"i{k}n{n}w{i}" for i in range(n)) for n in range(5, 25) for k in range(20)]
    items = list(enumerate(texts))
    rows = []
    for i, text in items:
        size = len(text.split()) - 4
        whole = text.split()[:4 + -(-4 * size // 5)] if i % 2 else text.split()
        far = [f"f{i}x{k}" for k in range(300)]
        rows.append((i, " ".join(far + whole + far)))
    want = {(i, i) for i, _ in items}
    got = decontaminate.leaks(make_docs(rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want


@pytest.mark.parametrize("most_items", [20_000, 7])
def test_leaks_whole_table(spark, most_items):
    docs, items = common.table(spark, SF, "documents"), common.table(spark, SF, "benchmark")
    want = brute.leaks([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert _leak_rows(decontaminate.leaks(docs, items, most_items=most_items)) == want


def test_leaks_empty_tables(spark, make_docs):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(make_docs([(1, "a b c d e f")]), items).count() == 0
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.leaks(make_docs([]), some).count() == 0
    with pytest.raises(ValueError):
        decontaminate.leaks(make_docs([]), some, most_bytes=5)


def _digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_warc_round_trip(spark):
    pages = [(3, "http://x/é %20?a=b", "<p>é</p>"), (1, "http://y/", "<p>é</p>"), (2, None, None), (5, "", ""), (4, "http://z/\r\nX: y", "a\r\n\r\nb"),
             (None, "http://n/", "<p>é</p>"), (6, "u", "x" * 3_000_000), (7, "same", "twice"), (7, "same", "twice"), (8, "v", "twice")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    folder = common.shared_folder(spark, "test-warc")
    index = warc.write(df, folder)
    assert index.count() == len(pages)
    for gap, most in ((1 << 16, 8 << 20), (0, 100)):
        got = warc.read(index, folder, gap, most).collect()
        first = {"<p>é</p>": 1, "": 2, "twice": 7}
        want = []
        for page_id, url, html in pages:
            f = first.get(html or "", page_id)
            again = f != page_id
            want.append((page_id, url, None if again else (html or "").encode(), len((html or "").encode()), _digest(html),
                         "revisit" if again else "response", f if again else None))
        assert sorted([(r[0], r[1], None if r[2] is None else bytes(r[2]), *r[3:]) for r in got], key=str) == sorted(want, key=str)
    some = warc.read(index.filter("page_id in (1, 6)"), folder).select("page_id", "payload_bytes").collect()
    assert sorted(map(tuple, some)) == [(1, 9), (6, 3_000_000)]
    small = warc.write(df, common.shared_folder(spark, "test-warc"), min_bytes=6)
    assert {r["page_id"] for r in small.filter("record_type = 'revisit'").collect()} == {3, None}


def test_warc_empty_table(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    folder = common.shared_folder(spark, "test-warc")
    assert warc.read(warc.write(empty, folder), folder).count() == 0


def test_warc_finds_damage():
    data, _, _ = warc.record(1, "u", "payload")
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"payload", b"pAyload"))
