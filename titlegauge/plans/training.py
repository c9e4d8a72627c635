"""Train and evaluate every community at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlegauge.functions.text import STRUCTURAL_NAMES
from titlegauge.operators.evaluate import evaluation_rows, with_mean_row
from titlegauge.operators.features import (
    INTERCEPT, MAX_FEATURES, MIN_DF, attach_vectors, embedding_space, fit_space, intercept_space,
    structural_space, text_space, vocabulary,
)
from titlegauge.operators.labels import fit_ecdf
from titlegauge.operators.models import ALPHAS, FOLDS, INTERCEPT_FACTOR, fit_ridge
from titlegauge.operators.score import predict
from titlegauge.plans.posts import split_sides
from titlegauge.session import cut_lineage
from titlegauge.sources.model_store import read_models, write_models

# Decimals to which the predictions of an iterative fit are compared.
TRAINED_DIGITS = 7
# A plain, reproducible model for checks: term weights come from the labels, these are constants.
FIXED_STRUCTURAL_COEFS = {
    "n_words": 0.01, "n_chars": -0.01, "avg_word_len": 0.02, "has_number": 0.03,
    "has_question": -0.02, "has_exclaim": 0.015, "caps_ratio": -0.03, "starts_wh": 0.025,
}


@dataclass(frozen=True)
class Bundle:
    """Model tables of all communities, with the evaluation they were judged by."""

    model: DataFrame
    ecdf: DataFrame
    metrics: DataFrame
    evaluation: DataFrame


def evaluate_model(
    labelled: DataFrame, model: DataFrame, analyzer: str | None = "word",
    embedding: str | None = None, digits: int = 9,
) -> DataFrame:
    """Evaluation row per community on the held-out posts; predictions that agree to ``digits``
    decimals are ties."""
    train, test = split_sides(labelled)
    keys = ["subreddit", "id", "title", "label"]
    predicted = predict(test, model, keys, analyzer, embedding, with_features=False)
    predicted = cut_lineage(predicted.withColumn("prediction", F.round("prediction", digits)))
    sizes = train.groupBy("subreddit").agg(F.count(F.lit(1)).alias("n_train"))
    return evaluation_rows(predicted, sizes)


def metrics_of(evaluation: DataFrame) -> DataFrame:
    return evaluation.select(
        "subreddit", F.col("rho_model").alias("rho"), "rho_naive",
        F.col("top10_model").alias("top10"), "n_train", "n_test",
    )


def train_and_evaluate(
    labelled: DataFrame, min_df: int = MIN_DF, max_features: int = MAX_FEATURES,
    alphas: Sequence[float] = ALPHAS, folds: int = FOLDS, analyzer: str | None = "word",
) -> Bundle:
    """Fit spaces and ridge models on the training side, evaluate on the other."""
    train, _ = split_sides(labelled)
    space = fit_space(train, min_df, max_features, analyzer, INTERCEPT_FACTOR)
    model = cut_lineage(fit_ridge(train, space, alphas, folds, analyzer))
    rows = cut_lineage(evaluate_model(labelled, model, analyzer, digits=TRAINED_DIGITS))
    alpha = model.select("subreddit", "alpha").distinct()
    return Bundle(
        model=model,
        ecdf=fit_ecdf(train),
        metrics=metrics_of(rows),
        evaluation=with_mean_row(rows.join(alpha, "subreddit")),
    )


def train_and_store(
    folder: str, labelled: DataFrame, analyzer: str | None = "word", alphas: Sequence[float] = ALPHAS
) -> dict[str, DataFrame]:
    """Train the communities of ``labelled``, store them, and read the whole store back.

    Communities that the posts do not hold keep what was stored for them.
    """
    bundle = train_and_evaluate(labelled, alphas=alphas, analyzer=analyzer)
    write_models(folder, bundle.model, bundle.ecdf, bundle.metrics)
    return read_models(labelled.sparkSession, folder)


def train_embedding(
    labelled: DataFrame, vectors: DataFrame, size: int, alphas: Sequence[float] = ALPHAS,
    folds: int = FOLDS, strict: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Ridge on [embedding, structure]; returns the model and its evaluation rows.

    The vectors must cover the posts; with ``strict`` off, the covered posts are used.
    """
    attached = cut_lineage(attach_vectors(labelled, vectors))
    missing = attached.filter("not covered").count()
    if missing and strict:
        raise LookupError(f"{missing} posts have no vector")
    rows = attached.filter("covered").drop("covered")
    train, _ = split_sides(rows)
    space = (
        embedding_space(train, size)
        .unionByName(structural_space(train))
        .unionByName(intercept_space(train, INTERCEPT_FACTOR))
    )
    model = cut_lineage(
        fit_ridge(train, space, alphas, folds, analyzer=None, embedding="embedding")
    )
    return model, evaluate_model(
        rows, model, analyzer=None, embedding="embedding", digits=TRAINED_DIGITS
    )


def fixed_model(
    train: DataFrame, min_df: int = MIN_DF, max_features: int = MAX_FEATURES
) -> DataFrame:
    """A closed-form model: a term's coefficient is the mean label of the titles holding it minus
    the community mean; the intercept is the community mean."""
    means = train.groupBy("subreddit").agg(F.avg("label").alias("mean_label"))
    vocab = vocabulary(train, min_df, max_features, means={"term_label": "label"})
    text = text_space(vocab, extra=["term_label"])
    pairs = [x for name in STRUCTURAL_NAMES for x in (F.lit(name), F.lit(FIXED_STRUCTURAL_COEFS[name]))]
    rest = structural_space(train).unionByName(intercept_space(train))
    coef = (
        F.when(F.col("kind") == "t", F.col("term_label") - F.col("mean_label"))
        .when(F.col("feature") == INTERCEPT, F.col("mean_label"))
        .otherwise(F.try_element_at(F.create_map(*pairs), F.col("feature")))
    )
    return (
        text.unionByName(rest, allowMissingColumns=True)
        .join(means, "subreddit")
        .withColumn("coef", coef)
        .drop("term_label", "mean_label")
    )
