"""License scan by diagonal voting, in DataFrame functions only.

Every text becomes an array of words and, from it, arrays of 2- and 4-word
hashes.  All positions are joined to the positions of the same grams in the
license templates (a fixed table).  A match votes for its diagonal, the text
position minus the template position: grams of one occurrence share a diagonal,
an inserted or missing word moves the rest to a neighbouring one.  Neighbouring
diagonals are merged and a merged span counts if it covers enough of the
template.  Grams are compared as words after the hash join, so a hash collision
adds no vote.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from . import common

#: What separates words (after A-Z became a-z).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A phrase (every word must stand, in order) or a notice (``coverage`` of
    its 4-word grams must, on diagonals at most ``drift`` words apart)."""
    label: str
    text: str
    base: bool = False
    coverage: float = 1.0
    drift: int = 0

    @property
    def gram(self) -> int:
        return 4 if self.coverage < 1.0 else 2


def _notice(label: str, text: str) -> Template:
    return Template(label, text, coverage=0.8, drift=8)


# Public license names and notices.
TEMPLATES = (
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
    Template("lgpl", "lesser general public license"),
    Template("agpl", "affero general public license"),
    Template("mpl", "mozilla public license"),
    Template("epl", "eclipse public license"),
    Template("bsd", "bsd license"),
    Template("isc", "isc license"),
    Template("cc-by", "cc by"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc0", "cc0 1 0 universal"),
    _notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                   "associated documentation files the software to deal in the software without restriction including "
                   "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
                   "copies of the software and to permit persons to whom the software is furnished to do so"),
    _notice("apache", "you may not use this file except in compliance with the license you may obtain a copy of the "
                      "license at http www apache org licenses license 2 0 unless required by applicable law or agreed "
                      "to in writing software distributed under the license is distributed on an as is basis without "
                      "warranties or conditions of any kind either express or implied"),
    _notice("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
                   "general public license as published by the free software foundation either version 3 of the "
                   "license or at your option any later version"),
    _notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
                   "provided that the following conditions are met"),
    _notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee "
                   "is hereby granted provided that the above copyright notice and this permission notice appear in "
                   "all copies"),
    _notice("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the "
                   "mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
)

#: Stands for no gram: the one row that every text contributes.
_EVERY = 0


def words(text: Column) -> Column:
    """Words of a text, A-Z as a-z.  The Kelvin sign, the one character whose
    lower case is an ASCII letter of its own, is kept out of ``lower``."""
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(chr(0x212A)), F.lit(chr(0x1FFF))))
    return F.array_remove(F.split(low, GAP), "")


def _grams(df: DataFrame) -> DataFrame:
    """Adds __h2 and __h4, the hashes of the 2 and 4 words from each position on."""
    def pairs(a, step):
        return F.zip_with(a, F.slice(a, F.lit(1 + step), F.size(a)), lambda x, y: F.xxhash64(x, y))
    return df.withColumn("__h2", pairs(F.col("__words"), 1)).withColumn("__h4", pairs(F.col("__h2"), 2))


def template_grams(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(hash, template, tpos, tgram: words, gram, and the template's settings) of every gram."""
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(t.label).alias("label"), F.lit(t.base).alias("base"),
                              F.lit(t.text).alias("t"), F.lit(t.gram).alias("gram"),
                              F.lit(t.coverage).alias("coverage"), F.lit(t.drift).alias("drift"))
                     for i, t in enumerate(templates)])
    df = spark.range(1).select(F.inline(rows)).withColumn("__words", words(F.col("t")))
    df = _grams(df).withColumn("n_grams", F.size("__words") - F.col("gram") + 1)
    df = df.select("*", F.posexplode(F.when(F.col("gram") == 2, F.col("__h2")).otherwise(F.col("__h4"))).alias("tpos", "hash"))
    df = df.filter("tpos < n_grams").withColumn("tgram", F.slice("__words", F.col("tpos") + 1, F.col("gram")))
    df = df.select("hash", "template", "label", "base", "coverage", "drift", "n_grams", "gram", "tpos", "tgram")
    every = spark.range(1).select(
        F.lit(_EVERY).cast("long").alias("hash"), F.lit(-1).alias("template"), F.lit("").alias("label"),
        F.lit(False).alias("base"), F.lit(1.0).alias("coverage"), F.lit(0).alias("drift"), F.lit(1).alias("n_grams"),
        F.lit(0).alias("gram"), F.lit(0).alias("tpos"), F.array().cast("array<string>").alias("tgram"))
    return df.unionByName(every)


def spans(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """One row per merged span, and one with template -1 per row of ``docs``:
    __row, doc_id, n_words, template, label, base, first, last (diagonals),
    covered (share of the template's grams), verified.

    Null texts count as empty; rows that repeat a doc_id stay rows of their
    own.  The template table is a constant of this module, so its broadcast
    does not grow with the data."""
    grams = template_grams(docs.sparkSession, templates)
    df = docs.select(F.monotonically_increasing_id().alias("__row"), "doc_id", words(F.col("text")).alias("__words"))
    df = _grams(df).withColumn("n_words", F.size("__words").cast("long"))
    df = df.withColumn("__at", F.concat("__h2", F.array(F.lit(_EVERY).cast("long"))))
    df = df.select("__row", "doc_id", "n_words", "__words", "__h4", F.posexplode_outer("__at").alias("pos", "h2"))
    df = df.select("__row", "doc_id", "n_words", "__words", "pos",
                   F.explode(F.array("h2", F.get("__h4", F.col("pos")))).alias("hash"))
    votes = (df.join(F.broadcast(grams), "hash")
             .filter((F.col("gram") == 0) | (F.slice("__words", F.col("pos") + 1, F.col("gram")) == F.col("tgram")))
             .select("__row", "doc_id", "n_words", "template", "label", "base", "coverage", "drift", "n_grams", "tpos",
                     F.when(F.col("gram") == 0, 0).otherwise(F.col("pos") - F.col("tpos")).alias("diagonal")))
    per_template = ["__row", "doc_id", "n_words", "template", "label", "base", "coverage", "drift", "n_grams"]
    diagonals = (votes.repartition("__row").groupBy(*per_template, "diagonal")
                 .agg(F.collect_set("tpos").alias("tposes")))
    by_diagonal = W.partitionBy("__row", "template").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > F.col("drift"), F.lit(True))
    merged = (diagonals.withColumn("far", far.cast("long")).withColumn("run", F.sum("far").over(by_diagonal))
              .groupBy(*per_template, "run")
              .agg(F.min("diagonal").alias("first"), F.max("diagonal").alias("last"),
                   F.size(F.array_distinct(F.flatten(F.collect_list("tposes")))).alias("n_covered")))
    return (merged.withColumn("covered", F.col("n_covered") / F.col("n_grams"))
            .withColumn("verified", (F.col("covered") >= F.col("coverage")) & (F.col("template") >= 0))
            .drop("coverage", "drift", "n_grams", "n_covered", "run"))


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score (the best share of a template that a
    span covers) and n_spans (verified spans of all templates)."""
    base = F.col("verified") & F.col("base")

    def labels(which):
        return F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    return (spans(docs, templates).groupBy("__row", "doc_id", "n_words").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("last"))).cast("long").alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("verified")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("template") >= 0, F.col("covered"))), F.lit(0.0)).alias("score"),
        F.count_if("verified").alias("n_spans")).drop("__row"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


def _template_sql(number: int, t: Template) -> str:
    return f"({number}, '{t.label}', {str(t.base).lower()}, CAST({t.coverage} AS DOUBLE), {t.drift}, {t.gram}, string_split('{t.text}', ' '))"


#: The same steps on lists of words, with grams compared as text.
OP3_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
tm(template, label, base, coverage, drift, gram, tw) AS (VALUES {', '.join(_template_sql(k, t) for k, t in enumerate(TEMPLATES))}),
tg AS (SELECT *, len(tw) - gram + 1 AS n_grams, unnest(range(0, len(tw) - gram + 1)) AS tpos FROM tm),
tk AS MATERIALIZED (SELECT * EXCLUDE (tw), array_to_string(tw[tpos + 1 : tpos + gram], ' ') AS g FROM tg),
wp AS (SELECT rid, ws, unnest(range(0, len(ws))) AS pos FROM d),
wg AS (SELECT rid, pos, 2 AS gram, array_to_string(ws[pos + 1 : pos + 2], ' ') AS g FROM wp WHERE pos + 2 <= len(ws)
       UNION ALL SELECT rid, pos, 4, array_to_string(ws[pos + 1 : pos + 4], ' ') FROM wp WHERE pos + 4 <= len(ws)),
v AS (SELECT rid, template, label, base, coverage, drift, n_grams, tpos, pos - tpos AS diagonal FROM wg JOIN tk USING (gram, g)),
dd AS (SELECT DISTINCT rid, template, drift, diagonal FROM v),
dl AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) > drift, true) AS far FROM dd),
dr AS (SELECT *, sum(CAST(far AS INTEGER)) OVER (PARTITION BY rid, template ORDER BY diagonal) AS run FROM dl),
sp AS (SELECT v.rid, v.template, any_value(label) AS label, any_value(base) AS base, min(v.diagonal) AS first, max(v.diagonal) AS last,
              count(DISTINCT tpos) / any_value(n_grams) AS covered, count(DISTINCT tpos) / any_value(n_grams) >= any_value(coverage) AS ok
       FROM v JOIN dr USING (rid, template, diagonal) GROUP BY v.rid, v.template, run)
SELECT doc_id, CAST(len(any_value(ws)) AS BIGINT) AS n_words, count(*) FILTER (WHERE ok AND base) AS n_base,
       CAST(min(first) FILTER (WHERE ok AND base) AS BIGINT) AS first_word, CAST(max(last) FILTER (WHERE ok AND base) AS BIGINT) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE ok AND base), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE ok), '') AS labels,
       coalesce(max(covered), 0.0) AS score, count(*) FILTER (WHERE ok) AS n_spans
FROM d LEFT JOIN sp USING (rid) GROUP BY rid, doc_id
"""
