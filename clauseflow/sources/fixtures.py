"""Derived test tables.

The driver's tables hold invented prose with no contract wording, so every
contract-level query runs on contracts *derived* from ``documents``: one
contract per document, made of numbered sections built from 24 own-written
sentences (chosen by doc_id) followed by the document's whole text.  The same
derivation is written in DuckDB SQL in ``clauseflow.plans.oracle`` so both
engines see identical input; the work grows with ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clauseflow.functions import lexicon as lx
from clauseflow.functions import textcols as tc
from clauseflow.operators import classify as cl

# FIXED VALUES: the fixture sentences (written for this repository).
SENTENCES = [
    "Supplier may end the order without notice",
    "Buyer shall pay each invoice in thirty days",
    "Either party may terminate this order with written notice",
    "Vendor must allow an audit of its books at any time",
    "Licensee may use the tool on a non-exclusive basis only",
    "Provider is not liable for loss and Buyer shall waive each claim",
    "Owner may in its sole discretion reject the goods",
    "the parties agree to keep the terms private",
    "No fee is due",
    "Carrier shall hold insurance for the full term of the order",
    "Each party shall respectively bear its own costs of the project",
    "Buyer shall meet the minimum purchase set out in the schedule",
    "Maker disclaims all duties and shall not refund any sum",
    "Agent must not share the list with any rival for any reason",
    "Tenant agrees to a price increase after each renewal of the lease",
    "Seller shall give mutual support to both parties during the handover",
    "Client may not assign the order without prior written consent",
    "Company may end the plan for any reason at any time",
    "Staff shall follow the rules of the site while on duty",
    "Payment dates are listed in the annex below",
    "Owner shall seek injunctive relief as the exclusive remedy",
    "Partner shall share the sales data with the other side monthly",
    "Bank may charge interest on sums paid late by the Buyer",
    "Title to the work shall remain with Company and its units",
]
PREAMBLE = "Preamble the sides agree. "


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fx_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contracts(contract_id, path, extension, n_bytes, text) from ``documents``."""
    return contracts_from_documents(read_table(spark, sf_dir, "documents"))


def contracts_from_documents(docs: DataFrame) -> DataFrame:
    """One contract per document row (works on batch and streaming frames)."""
    docs = docs.select("doc_id", "text")
    sent = lx.lit_array(SENTENCES)
    d = F.col("doc_id")

    def section(k):
        s = [F.element_at(sent, ((d * 7 + k * 8 + j * 3) % 24 + 1).cast("int")) for j in range(3)]
        head = F.when(d % 10 == 0, F.lit("")).otherwise(F.concat(k.cast("string"), F.lit("."),
                                                                 (d % 9 + 1).cast("string"), F.lit(" ")))
        suffix = F.when(k % 2 == 0, F.concat(F.lit(" as set out in part "), k.cast("string"))).otherwise(F.lit(""))
        return F.concat(head, F.lit("Terms of part. "), s[0], F.lit(". "), s[1], F.lit("; "), s[2], suffix, F.lit("."))

    secs = F.transform(F.sequence(F.lit(1).cast("long"), 3 + d % 5), section)
    text = F.concat(F.lit(PREAMBLE), F.array_join(secs, "\n"), F.lit("\n"), F.col("text"))
    return docs.select(
        d.alias("contract_id"),
        F.concat(F.lit("contracts/"), d.cast("string"), F.lit(".txt")).alias("path"),
        F.lit(".txt").alias("extension"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        text.alias("text"),
    )


def fx_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested QA-annotation rows built from ``conversations``.

    One document per conversation; one question per turn whose label is a clause
    type chosen by (conv_id, turn) — every seventh question has no quotes; the
    answers are the turn's text, the previous turn's text (a repeat across
    questions), an empty answer and a short one.
    """
    conv = read_table(spark, sf_dir, "conversations")
    labels = lx.lit_array(lx.LABELS)
    lab = F.element_at(labels, ((F.col("conv_id") * 3 + F.col("turn") * 5) % 41 + 1).cast("int"))
    question = F.when((F.col("conv_id") + F.col("turn")) % 7 == 0,
                      F.concat(F.lit("Mark any text about "), lab, F.lit(" here.")))\
        .otherwise(F.concat(F.lit('Mark the parts (if any) of this contract about "'),
                            F.upper(lab), F.lit('" that a reviewer should see.')))
    prev = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    answers = F.array(
        F.struct(F.col("text").alias("text")),
        F.struct(F.coalesce(prev, F.col("text")).alias("text")),
        F.struct(F.lit("").alias("text")),
        F.struct(F.lit("Too short to keep here").alias("text")),
    )
    qas = conv.select("conv_id", "turn", F.struct(question.alias("question"), answers.alias("answers")).alias("qa"))
    return (qas.groupBy("conv_id")
            .agg(F.array_sort(F.collect_list(F.struct("turn", "qa"))).alias("_q"))
            .select("conv_id", F.array(F.struct(
                F.array(F.struct(F.transform("_q", lambda x: x["qa"]).alias("qas"))).alias("paragraphs")
            )).alias("data")))


def fx_provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines (one per document) with broken lines mixed in; column ``value``."""
    docs = read_table(spark, sf_dir, "documents")
    good = F.to_json(F.struct(F.col("text").alias("provision"), F.col("source").alias("source"),
                              F.array(F.col("lang")).alias("label")))
    bad_json = F.concat(F.lit('{"provision": "'), F.left(F.col("source"), F.lit(5)))
    null_prov = F.to_json(F.struct(F.lit(None).cast("string").alias("provision"),
                                   F.col("source").alias("source"), F.array(F.col("lang")).alias("label")))
    number = F.to_json(F.struct(F.col("doc_id").alias("provision"), F.col("source").alias("source"),
                                F.array(F.col("lang")).alias("label")))
    one_label = F.to_json(F.struct(F.col("text").alias("provision"), F.col("source").alias("source"),
                                   F.col("lang").alias("label")))
    value = (F.when(F.col("doc_id") % 50 == 7, bad_json).when(F.col("doc_id") % 50 == 9, null_prov)
             .when(F.col("doc_id") % 50 == 11, number).when(F.col("doc_id") % 50 == 13, one_label).otherwise(good))
    return docs.select(F.col("doc_id").alias("line_no"), value.alias("value"))


def rule_classifier(df: DataFrame, key: str = "contract_id", order: str = "clause_idx",
                    text: str = "text") -> DataFrame:
    """A made-up classifier, for tests and oracle queries only: its labels follow
    from the clause start and its position, so SQL can state them too.

    label id = (code(1st char) * 7 + code(3rd char) + contract) % 41;
    confidence = ((contract * 37 + clause_idx * 29) % 100) / 100;
    top_k = three consecutive label ids with scores c, c/2, c/4;
    label is 'uncertain' below 0.60.  Blank text gets the empty prediction.
    """
    labels = lx.lit_array(lx.LABELS)
    t = F.col(text)
    # ids may be 64-bit hashes: reduce first so the arithmetic cannot overflow
    # (identity for ids below 2^31 - 1)
    k = F.pmod(F.col(key).cast("long"), F.lit(2 ** 31 - 1))
    lid = ((F.ascii(F.substring(t, 1, 1)) * 7 + F.ascii(F.substring(t, 3, 1)) + k) % 41)
    conf = ((k * 37 + F.col(order).cast("long") * 29) % 100) / F.lit(100.0)
    top_k = F.array(*[
        F.struct(F.element_at(labels, ((lid + i) % 41 + 1).cast("int")).alias("label"),
                 (conf / F.lit(float(2 ** i))).alias("score")) for i in range(lx.DEFAULT_TOP_K)])
    label = F.when(conf < lx.UNCERTAIN_BELOW, F.lit("uncertain")).otherwise(
        F.element_at(labels, (lid + 1).cast("int")))
    blank = tc.is_blank(t)
    return (df.withColumn("label", F.when(blank, F.lit("uncertain")).otherwise(label))
            .withColumn("confidence", F.when(blank, F.lit(0.0)).otherwise(conf.cast("double")))
            .withColumn("top_k", F.when(blank, F.array().cast(cl.TOPK_TYPE)).otherwise(top_k.cast(cl.TOPK_TYPE))))
