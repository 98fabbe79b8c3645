"""From reviews to sentiment classifiers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplore.functions.columns import binary_label, sentiment
from shoplore.functions.text import clean_text, strip_emoticons, words
from shoplore.operators.evaluation import classification_report
from shoplore.operators.features import (Tfidf, fit_tfidf, stratified_split, with_class_weight)
from shoplore.operators.models import Logistic, TermMatrix, fit_logistic, fit_term_matrix
from shoplore.session import checkpointed


def labelled_reviews(reviews: DataFrame, score: str, message: str, placeholder: str = "Not Defined",
                     negative_max: int = 2, out: str = "sentiment") -> DataFrame:
    """Add the sentiment and drop reviews whose message is only the placeholder; a missing message,
    like any other text, stays."""
    labelled = reviews.withColumn(out, sentiment(score, negative_max))
    return labelled.filter(~F.col(message).eqNullSafe(F.lit(placeholder)))


def prepared_reviews(reviews: DataFrame, key: str, score: str, message: str,
                     placeholder: str = "Not Defined", seed: int = 808) -> DataFrame:
    """``(key, sentiment, label, text, split)``: labelled, cleaned and split 80/10/10."""
    labelled = labelled_reviews(reviews, score, message, placeholder)
    texts = labelled.select(key, "sentiment", binary_label("sentiment").alias("label"),
                            strip_emoticons(clean_text(message)).alias("text"))
    return stratified_split(texts, key, "label", seed)


@dataclass(frozen=True)
class Comparison:
    """Fitted features and the models asked for, predictions for one split and their reports."""

    tfidf: Tfidf
    logistic: DataFrame | None = None
    naive_bayes: DataFrame | None = None
    logistic_model: Logistic | None = None
    bayes_model: TermMatrix | None = None

    def reports(self) -> DataFrame:
        made = (("logistic regression", self.logistic), ("naive Bayes", self.naive_bayes))
        return reduce(DataFrame.unionByName, [
            classification_report(predictions, "label", "predicted").withColumn("model", F.lit(name))
            for name, predictions in made if predictions is not None])


def compare_models(prepared: DataFrame, key: str, split: str = "validation",
                   terms: Callable[[str], Column] = words,
                   fit: Sequence[str] = ("logistic", "naive_bayes")) -> Comparison:
    """Fit the classifiers named in ``fit`` on the training rows and predict the rows of ``split``.

    The texts of both are split into terms once and stored, as later passes read them.
    """
    if not fit or set(fit) - {"logistic", "naive_bayes"}:
        raise ValueError(f"unknown classifiers: {fit}")
    stored = checkpointed(prepared.filter(F.col("split").isin("train", split))
                          .select(key, "label", "split", terms("text").alias("terms")))
    train = stored.filter(F.col("split") == "train")
    judged = stored.filter(F.col("split") == split)
    result = Comparison(fit_tfidf(train, "terms", terms=F.col))
    tfidf = result.tfidf
    if "logistic" in fit:
        weighted = with_class_weight(tfidf.vectors(train, "terms"), "label")
        model = fit_logistic(weighted, "features", "label", "weight")
        result = replace(result, logistic_model=model, logistic=model.predict(
            tfidf.vectors(judged, "terms"), "features").select(key, "label", "probability", "predicted"))
    if "naive_bayes" in fit:
        bayes = fit_term_matrix(tfidf.vectors(train, "terms"), "features", "label")
        result = replace(result, bayes_model=bayes, naive_bayes=bayes.predict(
            tfidf.vectors(judged, "terms"), "features").select(key, "label", "predicted"))
    return result
