"""Clause classification, label encoding, splits and metrics.

* ``fit_centroid_head`` / ``apply_linear_head`` — a linear head (one weight
  vector per label) over an embedding column: fitting is a distributed
  aggregate; the fitted weights (n_labels x dim) are a model, broadcast once,
  and applied to whole Arrow batches as one matrix product.
* ``fit_text_classifier`` / ``text_model_classifier`` — a fitted Spark ML text
  model as the classifier of the contract pipeline.
* ``predict_with_model`` — a caller-supplied Python model run per Arrow batch.
* metrics are plain aggregates over (label, prediction) counts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from clauseflow.functions import lexicon as lx
from clauseflow.functions import textcols as tc

TOPK_TYPE = "array<struct<label:string,score:double>>"


# -- linear head over embeddings (C1-C4) -------------------------------------
def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def fit_centroid_head(train: DataFrame, vec: str = "embedding", label: str = "label") -> list[tuple[int, list[float]]]:
    """Per-label mean vector (distributed aggregate; returns the small model)."""
    cells = (train.select(F.col(label).alias("label_id"), F.posexplode(vec).alias("pos", "v"))
             .groupBy("label_id", "pos").agg(F.avg(F.col("v").cast("double")).alias("w")))
    model = (cells.groupBy("label_id")
             .agg(F.array_sort(F.collect_list(F.struct("pos", "w"))).alias("ws"))
             .select("label_id", F.transform("ws", lambda s: s["w"]).alias("w"))
             .orderBy("label_id").collect())
    return [(int(r["label_id"]), [float(x) for x in r["w"]]) for r in model]


def apply_linear_head(df: DataFrame, head: list[tuple[int, list[float]]], vec: str = "embedding",
                      temperature: float = 0.1) -> DataFrame:
    """C1 + C2: logits = <w_label, x> / temperature, softmax -> ``probs``
    array<struct<label_id:int, score:double>> in label_id order.  Rows without a
    vector get null."""
    ids = np.array([i for i, _ in head], np.int32)
    weights = df.sparkSession.sparkContext.broadcast(np.array([w for _, w in head], float).reshape(len(head), -1))
    schema = T.StructType(df.schema.fields + [T.StructField("probs", T.ArrayType(T.StructType([
        T.StructField("label_id", T.IntegerType()), T.StructField("score", T.DoubleType())])))])

    def run(batches):
        for batch in batches:
            vectors, n = batch.column(batch.schema.get_field_index(vec)), len(ids)
            size = len(vectors) - vectors.null_count
            x = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(size, -1)
            z = x @ weights.value.T / temperature if size else np.empty((0, n))
            e = np.exp(z - z.max(axis=1, keepdims=True)) if z.size else z
            p = e / e.sum(axis=1, keepdims=True) if z.size else e
            has = ~np.asarray(vectors.is_null())
            cells = pa.StructArray.from_arrays([pa.array(np.tile(ids, size)), pa.array(p.ravel())], ["label_id", "score"])
            ends = np.append(0, np.cumsum(has * n)).astype(np.int32)
            offsets = pa.array(ends, mask=np.append(~has, False))  # a null offset makes a null list
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, cells)],
                                             names=[*batch.schema.names, "probs"])

    return df.mapInArrow(run, schema)


def top_k_scores(probs: Column, k: int = lx.DEFAULT_TOP_K) -> Column:
    """K clamped to [1, n]; score desc, ties by label_id asc."""
    srt = F.array_sort(probs, lambda a, b: F.when(a["score"] > b["score"], -1)
                       .when(a["score"] < b["score"], 1)
                       .when(a["label_id"] < b["label_id"], -1)
                       .when(a["label_id"] > b["label_id"], 1).otherwise(0))
    kk = F.greatest(F.lit(1), F.least(F.lit(k), F.size(probs)))
    return F.slice(srt, F.lit(1), kk)


def with_label_names(df: DataFrame, id_col: str = "pred_id", out: str = "pred_label") -> DataFrame:
    """Class index -> label name (broadcast of the fixed label dimension)."""
    dim = F.broadcast(lx.label_dim(df.sparkSession).select(F.col("label_id").alias(id_col),
                                                           F.col("label").alias(out)))
    return df.join(dim, on=id_col, how="left")


def threshold_label(label: Column, confidence: Column, below: float = lx.UNCERTAIN_BELOW) -> Column:
    """C4: 'uncertain' below the threshold; confidence itself is kept."""
    return F.when(confidence < below, F.lit("uncertain")).otherwise(label)


# -- user-supplied model (C6) -------------------------------------------------
def predict_with_model(df: DataFrame, predict_proba: Callable[[list[str]], np.ndarray],
                       labels: list[str] | None = None, text: str = "text",
                       k: int = lx.DEFAULT_TOP_K) -> DataFrame:
    """Run ``predict_proba(texts) -> (n, n_labels)`` per Arrow batch (mapInPandas).

    Blank texts never reach the model and get the empty prediction.  The model
    is created once per Python worker by the caller's closure.
    """
    labels = labels or lx.LABELS
    out_schema = T.StructType(df.schema.fields + [
        T.StructField("label", T.StringType()), T.StructField("confidence", T.DoubleType()),
        T.StructField("top_k", T.ArrayType(T.StructType([T.StructField("label", T.StringType()),
                                                         T.StructField("score", T.DoubleType())])))])

    def run(batches):
        for pdf in batches:
            texts = pdf[text].fillna("").astype(str)
            live = texts.str.strip() != ""
            lab = pd.Series(["uncertain"] * len(pdf), index=pdf.index, dtype=object)
            conf = pd.Series([0.0] * len(pdf), index=pdf.index)
            tops = pd.Series([[] for _ in range(len(pdf))], index=pdf.index, dtype=object)
            if live.any():
                probs = np.asarray(predict_proba(texts[live].tolist()), dtype=float)
                kk = max(1, min(k, probs.shape[1]))
                order = np.lexsort((np.tile(np.arange(probs.shape[1]), (probs.shape[0], 1)), -probs))[:, :kk]
                for row_i, idx in enumerate(texts[live].index):
                    ids = order[row_i]
                    top = [{"label": labels[j], "score": float(probs[row_i, j])} for j in ids]
                    tops[idx] = top
                    conf[idx] = top[0]["score"]
                    lab[idx] = top[0]["label"] if top[0]["score"] >= lx.UNCERTAIN_BELOW else "uncertain"
            yield pdf.assign(label=lab, confidence=conf, top_k=tops)

    return df.mapInPandas(run, out_schema)


# -- label encoding and split (C7, C8) ----------------------------------------
def label_encode(df: DataFrame, label: str = "label", out: str = "label_id") -> DataFrame:
    """Alphabetical label -> 0..n-1.  The window runs over the distinct
    label set only (bounded by the number of classes), then is joined back."""
    from clauseflow.session import broadcast_if_small
    codes = (df.select(label).distinct()
             .withColumn(out, (F.dense_rank().over(Window.orderBy(label)) - 1).cast("int")))
    return df.join(broadcast_if_small(codes), on=label, how="inner")


def stratified_split(df: DataFrame, key: Column, label: str = "label", test_fraction: float = 0.2,
                     seed: int = 42, prefix_hex: int = 3) -> DataFrame:
    """Exactly round(test_fraction * n_label) rows per label go to 'test',
    the ones first in md5(seed|key) order (deterministic at any partitioning).

    Skew-safe form of "row_number() over (partition by label order by md5)":
    rows are bucketed by the first ``prefix_hex`` hex digits of the hash (md5
    order is bucket order first), bucket sizes come from a combinable
    aggregate, their running totals from a window over the small
    (label, bucket) table, and rows are ranked only inside their bucket —
    a very large label is spread over 16^prefix_hex ranking tasks.
    """
    from clauseflow.session import broadcast_if_small
    h = F.md5(F.concat(F.lit(str(seed)), F.lit("|"), key.cast("string")))
    d = df.withColumn("_h", h).withColumn("_key", key).withColumn("_b", F.substring("_h", 1, prefix_hex))
    sizes = d.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_nb"))
    wl = Window.partitionBy(label).orderBy("_b")
    sizes = (sizes.withColumn("_before", F.coalesce(F.sum("_nb").over(
                wl.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             .withColumn("_n", F.sum("_nb").over(Window.partitionBy(label)))
             .withColumn("_k", F.round(F.col("_n") * test_fraction)))
    d = d.join(broadcast_if_small(sizes.select(label, "_b", "_before", "_k")), [label, "_b"])
    r = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", "_key"))
    d = d.withColumn("split", F.when(F.col("_before") + r <= F.col("_k"), "test").otherwise("train"))
    return d.drop("_h", "_key", "_b", "_before", "_k")


# -- metrics (C10, C11, C13) ---------------------------------------------------
def per_class_counts(pairs: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """(class, tp, fp, fn, support) from (label, pred) rows; pure aggregates."""
    cm = pairs.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))
    tp = cm.filter(F.col(label) == F.col(pred)).select(F.col(label).alias("cls"), F.col("n").alias("tp"))
    sup = cm.groupBy(F.col(label).alias("cls")).agg(F.sum("n").alias("support"))
    predicted = cm.groupBy(F.col(pred).alias("cls")).agg(F.sum("n").alias("n_pred"))
    return (sup.join(predicted, "cls", "full_outer").join(tp, "cls", "left")
            .select("cls", F.coalesce("tp", F.lit(0)).cast("long").alias("tp"),
                    (F.coalesce("n_pred", F.lit(0)) - F.coalesce("tp", F.lit(0))).cast("long").alias("fp"),
                    (F.coalesce("support", F.lit(0)) - F.coalesce("tp", F.lit(0))).cast("long").alias("fn"),
                    F.coalesce("support", F.lit(0)).cast("long").alias("support")))


def _prf(c: DataFrame) -> DataFrame:
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    d = c.withColumn("precision", p.cast("double")).withColumn("recall", r.cast("double"))
    return d.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                     2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                        .otherwise(0.0))


def accuracy_weighted_f1(pairs: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """One row (n, accuracy, weighted_f1, macro_f1)."""
    c = _prf(per_class_counts(pairs, label, pred))
    return c.agg(F.sum("support").alias("n"),
                 (F.sum("tp") / F.sum("support")).alias("accuracy"),
                 (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
                 F.avg("f1").alias("macro_f1"))


def classification_report(pairs: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """C11: per-class precision/recall/f1/support plus accuracy, macro and weighted rows."""
    c = _prf(per_class_counts(pairs, label, pred)).cache()
    per = c.select(F.col("cls").cast("string").alias("row_name"), "precision", "recall", "f1",
                   F.col("support").cast("long").alias("support"))
    macro = c.agg(F.lit("macro avg").alias("row_name"), F.avg("precision").alias("precision"),
                  F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                  F.sum("support").cast("long").alias("support"))
    weighted = c.agg(F.lit("weighted avg").alias("row_name"),
                     (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("precision"),
                     (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("recall"),
                     (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1"),
                     F.sum("support").cast("long").alias("support"))
    acc = c.agg(F.lit("accuracy").alias("row_name"), F.lit(None).cast("double").alias("precision"),
                F.lit(None).cast("double").alias("recall"), (F.sum("tp") / F.sum("support")).alias("f1"),
                F.sum("support").cast("long").alias("support"))
    return per.unionByName(macro).unionByName(weighted).unionByName(acc)


def majority_label(train: DataFrame, label: str = "label"):
    """Most frequent training label (ties -> smallest label).  The ordering
    runs over the per-class counts (one row per class), returning one scalar."""
    row = (train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.col("n").desc(), F.col(label).asc()).first())
    return None if row is None else row[label]


# -- trainable text classifier (C9) --------------------------------------------
def fit_text_classifier(train: DataFrame, text: str = "text", label_id: str = "label_id",
                        num_features: int = 1 << 18, max_iter: int = 50, max_tokens: int | None = None,
                        reg_params: tuple[float, ...] = (0.01,), seed: int = 42):
    """C9 re-aimed: words -> unigrams and bigrams -> hashed tf -> idf -> multinomial
    LR (``softmax``: its coefficients and history stay out of the driver).  With
    several ``reg_params`` the one with the best weighted F1 on a fifth
    of the training rows is chosen (TrainValidationSplit).  ``max_tokens`` cuts a
    text to a supplied model's window (T16); a bag of words has none."""
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, SQLTransformer
    from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit

    from clauseflow.operators.softmax import SoftmaxRegression

    window = "_tok" if max_tokens is None else f"slice(_tok, 1, {int(max_tokens)})"
    features = [
        RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"\w\w+", gaps=False, toLowercase=True),
        SQLTransformer(statement=f"SELECT *, {window} AS _uni FROM __THIS__"),
        NGram(n=2, inputCol="_uni", outputCol="_bi"),
        SQLTransformer(statement="SELECT *, concat(_uni, _bi) AS _grams FROM __THIS__"),
        HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_features"),
    ]
    head = SoftmaxRegression(featuresCol="_features", labelCol=label_id, maxIter=max_iter, regParam=reg_params[0])
    train = train.withColumn(label_id, F.col(label_id).cast("double"))
    if len(reg_params) == 1:
        return Pipeline(stages=[*features, head]).fit(train)
    grid = ParamGridBuilder().addGrid(head.regParam, list(reg_params)).build()
    judge = MulticlassClassificationEvaluator(labelCol=label_id, metricName="f1")
    choice = TrainValidationSplit(estimator=Pipeline(stages=[*features, head]), estimatorParamMaps=grid, evaluator=judge,
                                  trainRatio=0.8, seed=seed)
    return choice.fit(train).bestModel


def text_model_classifier(model, labels: list[str], text: str = "text",
                          k: int = lx.DEFAULT_TOP_K) -> Callable[[DataFrame], DataFrame]:
    """A model of ``fit_text_classifier`` as a pipeline classifier: adds label,
    confidence and top_k; ``labels`` are the names by label id.  Blank texts get
    the empty prediction."""
    from pyspark.ml.functions import vector_to_array

    def classify(df: DataFrame) -> DataFrame:
        columns = df.columns
        scored = model.transform(df.withColumn(text, F.coalesce(F.col(text), F.lit(""))))
        probs = F.transform(vector_to_array("probability"), lambda p, i: F.struct(i.alias("label_id"), p.alias("score")))
        d = tc.with_computed(scored, {"_top": top_k_scores(probs, k)})
        name = F.transform("_top", lambda t: F.struct(F.get(lx.lit_array(labels), t["label_id"]).alias("label"), t["score"].alias("score")))
        d = tc.with_computed(d, {"_named": name})
        blank = tc.is_blank(F.col(text))
        best = F.get("_named", F.lit(0))
        return d.select(*columns,
                        F.when(blank, F.lit("uncertain")).otherwise(threshold_label(best["label"], best["score"])).alias("label"),
                        F.when(blank, F.lit(0.0)).otherwise(best["score"]).alias("confidence"),
                        F.when(blank, F.array().cast(TOPK_TYPE)).otherwise(F.col("_named").cast(TOPK_TYPE)).alias("top_k"))
    return classify
