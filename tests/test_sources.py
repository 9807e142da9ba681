"""S1-S12 readers, admission split, sinks round trip."""
import io
import json
import os
import tempfile
import zipfile

import pytest
from pyspark.sql import functions as F

from clauseflow.functions import lexicon as lx
from clauseflow.sources import readers as rd
from clauseflow.sources import sinks as sk


def test_admission_rules(spark):
    big = lx.MAX_UPLOAD_BYTES
    rows = [
        (1, "  pasted text  ", "c.txt", 10, "file"),        # text wins
        (2, "", "c.TXT", 10, "file body"),                  # upper-case suffix accepted
        (3, "", "c.rtf", 10, "x"),                          # unsupported
        (4, "", "c.txt", 0, ""),                            # empty
        (5, "", "c.pdf", big, "x"),                         # exactly 20 MB: accepted
        (6, "", "c.pdf", big + 1, "x"),                     # too large
        (7, "", "c.txt", 5, "   "),                         # no text
        (8, None, None, None, None),                        # neither
    ]
    df = spark.createDataFrame(rows, "id int, form_text string, filename string, n_bytes long, file_text string")
    got = {r["id"]: (r["route"], r["reject_reason"], r["analysis_text"]) for r in rd.admission(df).collect()}
    assert got[1] == ("text", None, "pasted text")
    assert got[2] == ("txt", None, "file body")
    assert got[3][1] == "unsupported_format"
    assert got[4][1] == "empty_file"
    assert got[5][:2] == ("pdf", None)
    assert got[6][1] == "too_large"
    assert got[7][1] == "no_text"
    assert got[8][1] == "no_input"


def test_provision_lines(spark):
    lines = [(0, json.dumps({"provision": "a  b\n c", "source": "s", "label": ["x"]})),
             (1, '{"provision": "broken'),
             (2, json.dumps({"provision": None, "source": "s"})),
             (3, json.dumps({"source": "only"}))]
    df = spark.createDataFrame(lines, "line_no long, value string")
    got = {r["line_no"]: (r["ok"], r["provision"], r["label"]) for r in rd.parse_provision_lines(df).collect()}
    assert got[0] == (True, "a  b\n c", ["x"])
    assert got[1][0] is False and got[2][0] is False and got[3][0] is False


def _docx_bytes(paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    xml = f'<?xml version="1.0"?><w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", xml)
    return buf.getvalue()


def test_docx_and_text_sources(spark):
    d = tempfile.mkdtemp(prefix="cf-src-")
    with open(os.path.join(d, "a.docx"), "wb") as fh:
        fh.write(_docx_bytes(["First para shall hold.", "Second para."]))
    with open(os.path.join(d, "b.txt"), "wb") as fh:
        fh.write(b"Line one\r\nLine two\rthree")
    docx = rd.read_docx_contracts(spark, d).first()
    assert docx["text"] == "First para shall hold.\nSecond para.\n" and docx["extension"] == ".docx"
    txt = rd.read_text_contracts(spark, os.path.join(d, "*.txt")).first()
    assert txt["text"] == "Line one\nLine two\nthree" and txt["extension"] == ".txt"


def test_docx_tabs_and_breaks(spark):
    body = ('<w:p><w:pPr><w:tabs><w:tab w:val="left" w:pos="720"/></w:tabs></w:pPr><w:r><w:t>1.1</w:t><w:tab/><w:t>Buyer shall pay</w:t>'
            '<w:br/><w:t>each invoice</w:t></w:r></w:p>')
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">'
                   f"<w:body>{body}</w:body></w:document>")
    assert rd.docx_text(buf.getvalue()) == "1.1\tBuyer shall pay\neach invoice\n"


def test_every_json_sink_is_read_back_by_its_reader(spark):
    """Several files and several rows a file."""
    d = tempfile.mkdtemp(prefix="cf-json-")
    corpus = spark.range(100).selectExpr("concat('clause ', id, ' é\n') as clause", "'s' as source", "array('a', 'b') as label").repartition(3)
    sk.write_corpus_json(corpus, os.path.join(d, "corpus"))
    back = rd.read_corpus_json(spark, os.path.join(d, "corpus"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, corpus.collect()))
    rewrites = spark.range(50).selectExpr(
        "cast(id as int) as id", "'t' as clause_type", "concat('o', id) as original", "'r' as rewritten", "'e' as explanation",
        "array('x') as similar_clauses_used", "named_struct('correctness', 1, 'fairness', 2, 'clarity', cast(null as int)) as scores").repartition(2)
    for name, write in (("k7", sk.write_scored_rewrites), ("k6", sk.write_reports)):
        write(rewrites, os.path.join(d, name))
        assert sorted(map(tuple, rd.read_rewrites(spark, os.path.join(d, name)).collect())) == sorted(map(tuple, rewrites.collect()))
    vectors = spark.createDataFrame([(1, [1.0, 2.0], "x"), (2, [3.0, 4.0], "y")], "clause_id long, embedding array<float>, label string")
    sk.write_vectors(vectors, os.path.join(d, "v"), partition_by="label")
    assert sorted(map(tuple, spark.read.parquet(os.path.join(d, "v")).select("clause_id", "embedding", "label").collect())) == \
        sorted(map(tuple, vectors.collect()))
    array = os.path.join(d, "array.json")
    with open(array, "w") as fh:
        json.dump([{"clause": "c1", "source": "s", "label": ["l"]}, {"clause": "c2", "source": "s", "label": []}], fh)
    assert rd.read_corpus_json(spark, array, array=True).count() == 2
    qa = os.path.join(d, "qa.json")
    with open(qa, "w") as fh:
        json.dump({"data": [{"paragraphs": [{"qas": [{"question": "q", "answers": [{"text": "a"}, {"text": "b"}]}]}]}]}, fh, indent=1)
    assert [r["answer"] for r in rd.flatten_qa(rd.read_qa_json(spark, qa)).collect()] == ["a", "b"]


def test_provision_line_numbers_do_not_depend_on_splits(spark):
    d = tempfile.mkdtemp(prefix="cf-prov-")
    path = os.path.join(d, "p.jsonl")
    with open(path, "w") as fh:
        for i in range(200):
            fh.write(json.dumps({"provision": f"text {i}", "source": "s", "label": ["l"]}) + "\n")
        fh.write('{"provision": 5}\n{"provision": "x", "label": "one"}\n{"provision": "y", "label": 7}\nnot json\n[1]\n')
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    got = []
    for split in (size, "500"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        got.append(sorted((r["line_no"], r["ok"], r["provision"], r["label"]) for r in rd.read_provisions(spark, path).collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got[0] == got[1] and sum(r[1] for r in got[0]) == 202
    assert {(r[2], tuple(r[3])) for r in got[0] if r[2] in ("x", "y")} == {("x", ("one",)), ("y", ())}


def test_label_map_validation(spark):
    d = tempfile.mkdtemp(prefix="cf-lm-")
    for k, (text, problem) in enumerate([("[1, 2]", "not an object"), ('{"a": "1"}', "id is no whole number"),
                                         ('{"a": 1.5}', "id is no whole number"), ('{"a": true}', "id is no whole number"),
                                         ("{}", "no entries"), ("{", "not JSON"), ('{"a": 1, "b": null}', "id is no whole number")]):
        bad = os.path.join(d, f"bad{k}.json")
        with open(bad, "w") as fh:
            fh.write(text)
        with pytest.raises(ValueError, match=problem):
            rd.read_label_map(spark, bad)
    p = os.path.join(d, "m.json")
    with open(p, "w") as fh:
        json.dump({lab: i for i, lab in enumerate(lx.LABELS)}, fh)
    dim = rd.read_label_map(spark, p)
    assert dim.count() == 41 and dim.filter("risk_tier = 'HIGH'").count() == 5


def test_sink_round_trip(spark):
    d = tempfile.mkdtemp(prefix="cf-sink-")
    df = spark.createDataFrame([('a "quoted"\nline', "x")], "text string, label string")
    sk.write_labelled_csv(df, os.path.join(d, "csv"))
    back = rd.read_labelled_csv(spark, os.path.join(d, "csv")).first()
    assert back["text"] == 'a "quoted"\nline' and back["label"] == "x"
    sk.write_label_map(lx.label_dim(spark), os.path.join(d, "lm"))
    txt = spark.read.text(os.path.join(d, "lm")).first()["value"]
    assert json.loads(txt)["warranty duration"] == 40
