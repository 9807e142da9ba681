"""S1-S12 readers and the admission split.  Schemas are declared, never inferred."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseflow.functions import lexicon as lx
from clauseflow.functions import textcols as tc

QA_SCHEMA = T.StructType([T.StructField("data", T.ArrayType(T.StructType([
    T.StructField("paragraphs", T.ArrayType(T.StructType([
        T.StructField("qas", T.ArrayType(T.StructType([
            T.StructField("question", T.StringType()),
            T.StructField("answers", T.ArrayType(T.StructType([T.StructField("text", T.StringType())]))),
        ]))),
    ]))),
])))])

PROVISION_SCHEMA = T.StructType([
    T.StructField("provision", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("label", T.ArrayType(T.StringType())),
    T.StructField("_corrupt_record", T.StringType()),
])

CORPUS_SCHEMA = T.StructType([
    T.StructField("clause", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("label", T.ArrayType(T.StringType())),
])

LABELLED_SCHEMA = T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.StringType())])

REWRITE_SCHEMA = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("clause_type", T.StringType()),
    T.StructField("original", T.StringType()),
    T.StructField("rewritten", T.StringType()),
    T.StructField("explanation", T.StringType()),
    T.StructField("similar_clauses_used", T.ArrayType(T.StringType())),
    T.StructField("scores", T.StructType([T.StructField("correctness", T.IntegerType()),
                                          T.StructField("fairness", T.IntegerType()),
                                          T.StructField("clarity", T.IntegerType())])),
])


# -- S1 / S3 ---------------------------------------------------------------------
def extension_of(path: Column) -> Column:
    """S3: lower-cased suffix including the dot ('' when none)."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def read_text_contracts(spark: SparkSession, path: str, min_partitions: int | None = None) -> DataFrame:
    """One row per .txt file (whole text, universal newlines).  Whole-text
    files are unsplittable; when they yield too few partitions the rows are
    spread round-robin afterwards."""
    raw = spark.read.text(path, wholetext=True)
    df = raw.select(F.col("_metadata.file_path").alias("path"),
                    F.col("_metadata.file_size").alias("n_bytes"),
                    F.regexp_replace("value", "\r\n?", "\n").alias("text"))
    df = df.withColumn("contract_id", F.xxhash64("path")).withColumn("extension", extension_of(F.col("path")))
    from clauseflow.plans.pipeline import spread
    return spread(df.select("contract_id", "path", "extension", "n_bytes", "text"), min_partitions)


# -- S2 ----------------------------------------------------------------------------
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """Body paragraphs of a .docx, each followed by a newline (tables ignored).
    A tab is a tab character and a line break a newline, as a reader of the
    document sees them; tab stops in paragraph settings are no text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    body = root.find(f"{_W}body")
    mark = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    out = []
    for p in (body.findall(f"{_W}p") if body is not None else []):
        for run in p.iter(f"{_W}r"):
            out += [(e.text or "") if e.tag == f"{_W}t" else mark.get(e.tag, "") for e in run]
        out.append("\n")
    return "".join(out)


def read_docx_contracts(spark: SparkSession, path: str) -> DataFrame:
    """binaryFile scan -> per-file extraction in Arrow batches (mapInPandas)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)

    def extract(batches):
        for pdf in batches:
            texts, errors = [], []
            for b in pdf["content"]:
                try:
                    texts.append(docx_text(bytes(b)))
                    errors.append(None)
                except Exception as e:  # unreadable file -> quarantined by the caller
                    texts.append("")
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"path": pdf["path"], "n_bytes": pdf["length"], "text": texts, "error": errors})

    out = files.select("path", "length", "content").mapInPandas(
        extract, "path string, n_bytes long, text string, error string")
    return (out.withColumn("contract_id", F.xxhash64("path")).withColumn("extension", extension_of(F.col("path")))
            .select("contract_id", "path", "extension", "n_bytes", "text", "error"))


# -- S4 / S5 -------------------------------------------------------------------------
def read_qa_json(spark: SparkSession, path: str) -> DataFrame:
    """Nested QA-annotation documents (multi-line JSON)."""
    return spark.read.schema(QA_SCHEMA).option("multiLine", True).json(path)


def flatten_qa(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Four-level unnest keeping positions (for keep-first dedup)."""
    keep = keep or []
    d = df.select(*keep, F.posexplode("data").alias("d_idx", "d"))
    d = d.select(*keep, "d_idx", F.posexplode("d.paragraphs").alias("p_idx", "p"))
    d = d.select(*keep, "d_idx", "p_idx", F.posexplode("p.qas").alias("q_idx", "q"))
    d = d.select(*keep, "d_idx", "p_idx", "q_idx", F.col("q.question").alias("question"),
                 F.posexplode("q.answers").alias("a_idx", "a"))
    return d.select(*keep, "d_idx", "p_idx", "q_idx", "a_idx", "question", F.col("a.text").alias("answer"))


# -- S6 / S7 ---------------------------------------------------------------------------
def parse_provision_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """S6 over a column of JSON lines; adds ok, provision, source, label.

    A line is skipped (``ok`` false, the line stays in ``value``) if it is no
    JSON object or its provision is no string.  A label that is no list does
    not cost the line: a string is a list of one, anything else no label."""
    d = lines.withColumn("_v", F.try_parse_json(F.col(value)))
    d = d.withColumn("_p", F.try_variant_get("_v", "$.provision", "variant"))
    d = d.withColumn("_l", F.try_variant_get("_v", "$.label", "variant"))
    ok = F.coalesce(F.schema_of_variant("_p") == "STRING", F.lit(False))
    kind = F.schema_of_variant("_l")
    label = (F.when(kind == "STRING", F.array(F.try_variant_get("_l", "$", "string")))
             .when(kind.startswith("ARRAY"), F.try_variant_get("_l", "$", "array<string>")))
    # one row per line: the parsed value is made once, whatever is derived from it
    parsed = tc.with_computed(d, {"_r": F.struct(
        ok.alias("ok"), F.when(ok, F.try_variant_get("_p", "$", "string")).alias("provision"),
        F.when(ok, F.try_variant_get("_v", "$.source", "string")).alias("source"), F.when(ok, label).alias("label"))})
    return parsed.select("*", "_r.ok", "_r.provision", F.coalesce("_r.source", F.lit("")).alias("source"),
                         F.coalesce("_r.label", F.array().cast("array<string>")).alias("label")).drop("_v", "_p", "_l", "_r")


def read_provisions(spark: SparkSession, path: str) -> DataFrame:
    """S6 from JSONL files: text lines then the same parse (bad lines kept aside).
    ``line_no`` is a hash of file and line, the same however the files are split;
    equal lines of a file share it."""
    lines = spark.read.text(path).withColumn("line_no", F.xxhash64(F.col("_metadata.file_path"), F.col("value")))
    return parse_provision_lines(lines)


def read_corpus_json(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Corpus entries, one JSON object a line as K2 writes them; ``array``
    reads files that are one JSON array each."""
    return spark.read.schema(CORPUS_SCHEMA).option("multiLine", array).json(path)


# -- S8 / S9 / S10 -----------------------------------------------------------------------
def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """Text,label CSV with a header and quoted multi-line fields."""
    return (spark.read.schema(LABELLED_SCHEMA).option("header", True).option("multiLine", True)
            .option("escape", '"').csv(path))


def label_map_entries(maps: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """S9 over a column of JSON texts: (key..., label, label_id, problem), one row
    per entry; a text that holds no usable entry is one row with its problem.

    ``problem`` is null for an entry whose id is a whole number."""
    d = maps.select(*key, F.try_parse_json(F.col(value)).alias("_v"))
    kind = F.coalesce(F.schema_of_variant("_v"), F.lit("VOID"))
    whole = (F.when(F.col("_v").isNull(), F.lit("not JSON")).when(~kind.startswith("OBJECT"), F.lit("not an object"))
             .when(kind == "OBJECT<>", F.lit("no entries")))
    entries = F.map_entries(F.try_variant_get("_v", "$", "map<string,variant>"))
    d = d.select(*key, whole.alias("_whole"), F.explode_outer(F.when(whole.isNull(), entries)).alias("_e"))
    number = F.schema_of_variant("_e.value") == "BIGINT"
    return d.select(*key, F.col("_e.key").alias("label"),
                    F.when(number, F.try_variant_get("_e.value", "$", "int")).alias("label_id"),
                    F.when(F.col("_whole").isNotNull(), F.col("_whole"))
                    .when(~F.coalesce(number, F.lit(False)), F.lit("id is no whole number")).alias("problem"))


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """A file with one ``{label: id}`` JSON object -> label dimension; raises
    ValueError with the problems found."""
    entries = label_map_entries(spark.read.text(path, wholetext=True).withColumn("file", F.lit(path)), ["file"])
    found = entries.agg(F.count_if(F.col("problem").isNull()).alias("good"),
                        F.sort_array(F.collect_set(F.concat_ws(": ", "label", "problem"))).alias("bad")).first()
    wrong = [x for x in found["bad"] if x] if entries.filter("problem is not null").limit(1).count() else []
    if wrong or not found["good"]:
        raise ValueError(f"label map {path}: {'; '.join(wrong[:5]) or 'empty'}")
    known = F.broadcast(lx.label_dim(spark).select("label", "description"))  # 41 rows
    tier = (F.when(F.col("label").isin(*lx.HIGH_RISK_LABELS), "HIGH").when(F.col("label").isin(*lx.MEDIUM_RISK_LABELS), "MEDIUM")
            .otherwise("LOW"))
    return entries.select("label_id", "label", tier.alias("risk_tier")).join(known, "label", "left").select(
        "label_id", "label", "risk_tier", "description")


def read_rewrites(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Rewrite reviews, one JSON object a line as K6 and K7 write them;
    ``array`` reads files that are one JSON array each."""
    return spark.read.schema(REWRITE_SCHEMA).option("multiLine", array).json(path)


# -- S11 / S12 ------------------------------------------------------------------------------
def admission(df: DataFrame, form_text: str = "form_text", filename: str = "filename",
              n_bytes: str = "n_bytes", file_text: str = "file_text") -> DataFrame:
    """S11 + S12: pasted text wins over a file; a file must have an allowed
    suffix (case-insensitive), be non-empty and at most 20 MB; .txt is read
    directly, .pdf/.docx go to the extraction job; blank text is rejected.
    Adds ``ext``, ``route``, ``reject_reason`` (NULL = accepted), ``analysis_text``."""
    pasted = tc.strip_ws(F.coalesce(F.col(form_text), F.lit("")))
    ext = extension_of(F.coalesce(F.col(filename), F.lit("")))
    allowed = ext.isin(*lx.SUPPORTED_EXTENSIONS)
    route = (F.when(pasted != "", F.lit("text"))
             .when(F.col(filename).isNull(), F.lit(None))
             .when(~allowed | (F.col(n_bytes) == 0) | (F.col(n_bytes) > lx.MAX_UPLOAD_BYTES), F.lit(None))
             .when(ext == ".txt", F.lit("txt")).otherwise(F.regexp_replace(ext, r"^\.", "")))
    text = F.when(route == "text", pasted).when(route == "txt", F.col(file_text))
    reason = (F.when(pasted != "", F.lit(None))
              .when(F.col(filename).isNull(), F.lit("no_input"))
              .when(~allowed, F.lit("unsupported_format"))
              .when(F.col(n_bytes) == 0, F.lit("empty_file"))
              .when(F.col(n_bytes) > lx.MAX_UPLOAD_BYTES, F.lit("too_large"))
              .when((route == "txt") & tc.is_blank(F.col(file_text)), F.lit("no_text")))
    return df.withColumn("ext", ext).withColumn("route", route).withColumn("reject_reason", reason) \
             .withColumn("analysis_text", text)


def with_document_text(admitted: DataFrame, pdf_text=None, content: str = "content") -> DataFrame:
    """S2 + S12 for admitted requests with route docx or pdf: fills analysis_text
    from the file's bytes in column ``content``, or gives the reason why not.

    Word files are read here, PDF files by ``pdf_text(bytes) -> str`` of the
    caller.  Reasons: no_content (no bytes came with the request), no_extractor
    (a PDF without ``pdf_text``), unreadable_file, no_text.  Bytes only reach
    Python for the rows that need them, in Arrow batches."""
    waits = F.col("reject_reason").isNull() & F.col("route").isin("docx", "pdf")
    if content not in admitted.columns:
        return admitted.withColumn("reject_reason", F.when(waits, F.lit("no_content")).otherwise(F.col("reject_reason")))

    @F.pandas_udf("text string, reason string")
    def extract(route: pd.Series, data: pd.Series) -> pd.DataFrame:
        out = []
        for kind, raw in zip(route, data):
            if kind is None:
                out.append((None, None))
            elif raw is None:
                out.append((None, "no_content"))
            elif kind == "pdf" and pdf_text is None:
                out.append((None, "no_extractor"))
            else:
                try:
                    text = docx_text(bytes(raw)) if kind == "docx" else pdf_text(bytes(raw))
                    out.append((text, None) if text and text.strip() else (None, "no_text"))
                except Exception:  # damaged or foreign bytes: the request is set aside with its reason
                    out.append((None, "unreadable_file"))
        return pd.DataFrame(out, columns=["text", "reason"])

    got = tc.with_computed(admitted, {"_x": extract(F.when(waits, F.col("route")), F.when(waits, F.col(content)))})
    return (got.withColumn("analysis_text", F.coalesce("analysis_text", "_x.text"))
            .withColumn("reject_reason", F.coalesce("reject_reason", "_x.reason")).drop("_x"))
