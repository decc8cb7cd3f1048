"""Trainable text classifier and pluggable batch inference."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StringIndexer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptsieve import constants as K
from promptsieve.session import saved


def train_classifier(
    df: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 16,
    max_iter: int = 20, regularization: float = 0.01,
) -> PipelineModel:
    """TF-IDF and multinomial logistic regression. The hashed feature space bounds the model,
    whatever the vocabulary."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc"),
        LogisticRegression(
            featuresCol="_tfidf", labelCol="_label", probabilityCol="_probability",
            predictionCol="_prediction", rawPredictionCol="_raw", maxIter=max_iter,
            regParam=regularization, family="multinomial"),
    ]
    return Pipeline(stages=stages).fit(df)


def class_labels(model: PipelineModel) -> list[str]:
    """Classes as the fitted model knows them."""
    return list(next(s for s in model.stages if hasattr(s, "labelsArray")).labels)


def _scorer(model: PipelineModel) -> PipelineModel:
    return PipelineModel([s for s in model.stages if not hasattr(s, "labelsArray")])


def _matches(scores: Column, labels: list[str], threshold: float, model_id: str, action: str) -> Column:
    """Candidates of the classes at or above the threshold, without the harmless ones."""
    names = F.array(*[F.lit(x) for x in labels])
    pairs = F.filter(
        F.arrays_zip(names.alias("label"), scores.alias("score")),
        lambda p: (p.score >= threshold) & ~F.lower(p.label).isin(*K.SAFE_LABELS))

    def candidate(p: Column) -> Column:
        category = F.replace(p.label, F.lit("_"), F.lit("-"))
        detail = F.format_string(f"ml:{model_id}:%s:%.2f", category, p.score)
        return F.struct(
            F.lit(action).alias("action"), category.alias("category"),
            F.lit(model_id).alias("signature_id"), detail.alias("detail"),
            p.score.alias("confidence"))

    return F.transform(pairs, candidate)


def classify(
    df: DataFrame, model: PipelineModel, threshold: float = 0.7, action: str = "block",
    model_id: str = "text-classifier", output: str = "ml",
) -> DataFrame:
    """Append ``output``: classifier candidates to be fused with the other detectors."""
    scored = _scorer(model).transform(df)
    found = _matches(
        vector_to_array("_probability"), class_labels(model), threshold, model_id, action)
    return scored.select(*df.columns, found.alias(output))


def _token_counts(df: DataFrame, text: str, by: list[str]) -> DataFrame:
    """(by..., token, n): runs of ASCII letters, lower-cased, summed before any shuffle."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))
    return df.select(*by, F.explode(words).alias("token")).groupBy(*by, F.lower("token").alias("token")).agg(
        F.count("*").alias("n"))


def naive_bayes_fit(df: DataFrame, text: str = "text", label: str = "label") -> tuple[DataFrame, list[Row]]:
    """Multinomial naive Bayes with add-one counts, in closed form over all labelled rows: tokens
    (label, token, n) and, as rows on the driver, the classes (label, docs, tokens, vocabulary).

    Rows without a label take no part; a NULL text has no tokens.
    """
    labelled = df.where(F.col(label).isNotNull())
    # Written once: the vocabulary, the sizes and the scores all read it.
    tokens = saved(_token_counts(labelled, text, [label]).withColumnRenamed(label, "label"), "bayes")
    vocabulary = tokens.select("token").distinct().count()
    sizes = tokens.groupBy("label").agg(F.sum("n").alias("tokens"))
    classes = (
        labelled.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("docs")).join(sizes, "label", "left")
        .select("label", "docs", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.lit(vocabulary).alias("vocabulary"))
    )
    return tokens, sorted(classes.collect(), key=lambda r: r.label)  # a row per class


def naive_bayes_classify(
    df: DataFrame, key: str, tokens: DataFrame, classes: list[Row], text: str = "text",
) -> DataFrame:
    """(key, label, log_score, best) for each row and class; ``key`` is unique.

    log_score = log(docs + 1) + sum of n * log((count + 1) / (tokens + vocabulary)). Known tokens
    are joined and summed; what unknown ones add depends on the row's token total alone, so the
    classes are literals. Of equal scores the first label is best. Without classes no rows.
    """
    counts = _token_counts(df, text, [key])
    # Of repeated keys each row has the total of all; only numbers are shuffled for it.
    sizes = df.groupBy(key).agg(F.sum(F.regexp_count(text, F.lit("[A-Za-z]+"))).alias("total"))
    totals = df.select(key).join(sizes, key, "left")
    known = counts.join(tokens.withColumnRenamed("n", "count"), "token").groupBy(key, "label").agg(
        F.sum(F.col("n") * F.log(F.col("count") + F.lit(1.0))).alias("known"))
    literal = F.array(*(F.struct(
        F.lit(c.label).alias("label"), F.lit(math.log(c.docs + 1)).alias("prior"),
        F.lit(math.log(max(1, c.tokens + c.vocabulary))).alias("shift")) for c in classes)
    ).cast("array<struct<label:string,prior:double,shift:double>>")
    score = F.col("prior") + F.coalesce("known", F.lit(0.0)) - F.coalesce("total", F.lit(0)) * F.col("shift")
    scored = (
        totals.select(key, "total", F.inline(literal)).join(known, [key, "label"], "left")
        .select(key, "label", score.alias("log_score"))
    )
    order = Window.partitionBy(key).orderBy(F.round("log_score", 6).desc(), "label")
    return scored.withColumn("best", F.row_number().over(order) == 1)


def as_probabilities(outputs: np.ndarray) -> np.ndarray:
    """Softmax per row, but only for rows with values outside [0, 1]."""
    scores = np.asarray(outputs, dtype=np.float64)
    logits = (scores.min(axis=1) < 0) | (scores.max(axis=1) > 1)
    grown = np.exp(scores - scores.max(axis=1, keepdims=True))
    return np.where(logits[:, None], grown / grown.sum(axis=1, keepdims=True), scores)


def batch_scorer(
    make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]], batch_size: int = 1024, **kwargs
):
    """Inference hook: ``make_predict`` loads a model once per Python worker and returns a
    function of a feature batch; its outputs become probabilities."""

    def make():
        predict = make_predict()
        return lambda inputs: as_probabilities(predict(inputs))

    return predict_batch_udf(
        make, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size, **kwargs)


def classify_batch(
    df: DataFrame, features: str, make_predict, labels: list[str], threshold: float = 0.7,
    action: str = "block", model_id: str = "batch-model", output: str = "ml", **kwargs,
) -> DataFrame:
    """Append candidates of a plugged-in model over an array column of features. Labels and
    scores of different lengths are cut to the shorter."""
    scores = batch_scorer(make_predict, **kwargs)(F.col(features))
    staged = df.withColumn("_scores", scores)
    size = F.least(F.size("_scores"), F.lit(len(labels)))
    return staged.withColumn(output, _matches(
        F.slice("_scores", F.lit(1), size), labels, threshold, model_id, action
    )).drop("_scores")


def active_model(loads: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Model in force after a sequence of loads (load_seq, tier, model_id).

    A load with a tier is skipped if its rank is below the highest tier loaded before (an
    unknown tier ranks below all); a load without a tier always applies. So the load in force
    is the last one that is untiered or of the highest rank up to then.
    """
    rank = F.lit(-1)
    for tier, value in K.TIER_RANK.items():
        rank = F.when(F.col("tier") == tier, value).otherwise(rank)
    ranked = loads.withColumn("_rank", F.when(F.coalesce("tier", F.lit("")) != "", rank))
    # The last load of the highest rank applies: nothing before it outranks it. After it only
    # untiered loads apply.
    tiered = F.max(F.when(F.col("_rank").isNotNull(), F.struct("_rank", "load_seq", "model_id", "tier")))
    untiered = F.max(F.when(F.col("_rank").isNull(), F.struct("load_seq", "model_id", "tier")))
    best = ranked.groupBy(*by).agg(tiered.alias("_t"), untiered.alias("_u"))
    take_untiered = F.col("_t").isNull() | F.coalesce(F.col("_u.load_seq") > F.col("_t.load_seq"), F.lit(False))
    pick = lambda c: F.when(take_untiered, F.col(f"_u.{c}")).otherwise(F.col(f"_t.{c}")).alias(c)
    return best.select(*by, pick("model_id"), pick("tier"), pick("load_seq"))
