"""op12: collocations against plain counting of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from clauseflow.llm import collocations, common, registry, wordhash

SF = "/root/testdata/sf0.01"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _expected(rows, least, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = tuple(w for w in re.split("[ \t]+", piece) if w)
            n[lang] += len(words)
            for i in range(len(words)):
                for m in range(1, min(5, len(words) - i) + 1):
                    f[lang, words[i:i + m]] += 1
    cands = {k: a for k, a in f.items() if len(k[1]) >= 2 and a >= least}
    inside = {(lang, p[i:i + m], a) for (lang, p), a in cands.items() for m in range(2, len(p)) for i in range(len(p) - m + 1)}
    out = {}
    for (lang, p), a in cands.items():
        if (lang, p, a) in inside:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i, ph.decode(), -a, left, right, n[lang], -s) for lang, found in out.items()
                  for i, (s, a, ph, left, right) in enumerate(sorted(found)[:top], 1))


def _got(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def _with_lang(make_docs, rows):
    from pyspark.sql import functions as F
    langs = [lang for lang, _ in rows]
    docs = make_docs([(i, x) for i, (_, x) in enumerate(rows)])
    return docs.withColumn("lang", F.get(F.array(*[F.lit(x) for x in langs]), F.col("doc_id").cast("int")))


def _random_rows(seed):
    rng = random.Random(seed)
    words = ["the", "of", "Élan", "é", "a", "B", "x", "new", "york", "city", "😀"]
    rows = [(None, None), ("en", ""), ("", " \t\n.,"), ("und", "a b c d e f g"), ("en", "x" * 300_000), ("de", "the of " * 3000)]
    for i in range(120):
        text = []
        for _ in range(rng.randrange(60)):
            text.append(rng.choice(["New York City hall is", *words]) if rng.random() < 0.5 else rng.choice(words))
        rows.append((rng.choice(["en", "en", "fr", None]), rng.choice([" ", "  ", "\t", " , ", ". ", "\n"]).join(text)))
    return rows


@pytest.mark.parametrize("least,budget,top", [(3, 4_000_000, 2000), (12, 50, 2000), (3, 200, 7)])
def test_against_counting_all_phrases(make_docs, least, budget, top):
    rows = _random_rows(least + top)
    got = _got(collocations.mine(_with_lang(make_docs, rows), least=least, budget=budget, top=top))
    assert got == _expected(rows, least, top) and len(got) > 10


def test_ties_repeats_and_insides(make_docs):
    rows = [("en", "p q r s t. p q r s t")] * 3 + [("en", "z y"), ("en", "y z")] * 6 + [("fr", "aa aa aa aa aa aa aa")]
    got = _got(collocations.mine(_with_lang(make_docs, rows), least=5))
    assert got == _expected(rows, 5)
    assert [r[2] for r in got if r[0] == "en"] == ["p q r s t", "y z", "z y"]


def test_odd_rows_and_empty_table(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    assert _got(collocations.mine(docs, least=2)) == _expected([("en", x) for _, x, *_ in odd_rows], 2)
    assert collocations.mine(make_docs([])).count() == 0


def test_whole_table_and_sql(spark):
    import duckdb
    docs = common.table(spark, SF, "documents")
    got = _got(registry.QUERIES["op12_collocations"](spark, SF))
    assert got == _expected([tuple(r) for r in docs.select("lang", "text").collect()], 100)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    assert got == sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({registry.ORACLE['op12_collocations']})").fetchall())


def test_located_words():
    texts = pa.array(["ab c", None, "", "d", "e ", " F" + "g" * 700_000, "h"])
    hashes, start, stop = wordhash.located(texts)
    want, at = wordhash.words(texts)
    assert (hashes == want).all() and at.tolist() == [0, 2, 2, 2, 3, 4, 5, 6]
    buf, _ = wordhash.text_buffer(texts)
    assert [buf[a:b].tobytes().decode()[:3] for a, b in zip(start, stop)] == ["ab", "c", "d", "e", "Fgg", "h"]


def test_bitmap(spark):
    keys = np.random.default_rng(1).integers(-2 ** 63, 2 ** 63, 5000)
    bitmap = collocations._bitmap(spark.createDataFrame([(int(k),) for k in keys[:2500]], "key long"), 24)
    has = collocations._has(bitmap, keys.view(np.uint64))
    assert has[:2500].all() and has[2500:].mean() < 0.01
