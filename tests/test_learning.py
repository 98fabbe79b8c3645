"""Splits, TF-IDF, classifiers and evaluation against numpy, and the whole review job."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplore.operators import evaluation, features, models
from shoplore.operators.words import stem_arrays
from shoplore.functions.text import words
from shoplore.plans.reviews import compare_models, prepared_reviews

TEXTS = [("good product good price", 1), ("bad product late", 0), ("good seller", 1), ("late late bad", 0),
         ("good", 1), ("the product", 1), ("", 1), ("price bad seller", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(TEXTS)], "i int, t string, y int")


def tfidf_matrix():
    n = len(TEXTS)
    terms = sorted({w for t, _ in TEXTS for w in t.split()})
    tf = np.array([[t.split().count(w) for w in terms] for t, _ in TEXTS], float)
    idf = np.log((1 + n) / (1 + (tf > 0).sum(axis=0))) + 1
    weights = tf * idf
    lengths = np.linalg.norm(weights, axis=1, keepdims=True)
    return terms, weights / np.where(lengths == 0, 1, lengths)


def test_tfidf_equals_numpy_in_both_forms(docs):
    fitted = features.fit_tfidf(docs, "t", max_df=1.0)
    terms, expected = tfidf_matrix()
    long = fitted.weights(docs, ["i"], "t").toPandas()
    got = np.zeros_like(expected)
    for r in long.itertuples():
        got[r.i, terms.index(r.term)] = r.weight
    assert np.allclose(got, expected)
    order = [r["term"] for r in fitted.vocabulary.orderBy("index").collect()]
    dense = fitted.vectors(docs, "t").select("i", vector_to_array("features").alias("v")).orderBy("i").collect()
    assert np.allclose([[r["v"][order.index(t)] for t in terms] for r in dense], expected)


def test_vocabulary_limits(docs):
    names = lambda f: {r["term"] for r in f.vocabulary.collect()}
    assert names(features.fit_tfidf(docs, "t", min_df=2, max_df=3)) == {
        "good", "product", "price", "bad", "late", "seller"}
    assert names(features.fit_tfidf(docs, "t", max_df=1.0, max_terms=2)) == {"good", "bad"}
    assert "good" not in names(features.fit_tfidf(docs, "t", max_df=2 / 8))
    counts = {r["term"]: (r["df"], r["total"]) for r in features.fit_tfidf(docs, "t").vocabulary.collect()}
    assert counts["late"] == (2, 3) and counts["good"] == (3, 4)
    with pytest.raises(ValueError, match="limits"):
        features.fit_tfidf(docs, "t", min_df=7)


def test_terms_may_be_stems(docs):
    stems = stem_arrays(lambda w: w[:3])
    fitted = features.fit_tfidf(docs, "t", max_df=1.0, terms=lambda c: stems(words(c)))
    assert {r["term"] for r in fitted.vocabulary.collect()} == {"goo", "pro", "pri", "bad", "lat", "sel", "the"}
    long = {(r["i"], r["term"]): r["tf"] for r in fitted.weights(docs, ["i"], "t").collect()}
    assert long[0, "goo"] == 2 and long[3, "lat"] == 2 and (6, "goo") not in long


def test_fit_on_training_rows_ignores_new_words(docs, spark):
    fitted = features.fit_tfidf(docs, "t")
    new = spark.createDataFrame([(1, "unseen words"), (2, "unseen good")], "i int, t string")
    rows = fitted.weights(new, ["i"], "t").collect()
    assert [(r["i"], r["term"], r["weight"]) for r in rows] == [(2, "good", 1.0)]


@pytest.mark.usefixtures("many_partitions")
@pytest.mark.parametrize("n", [87, 1234])
def test_split_sizes_strata_and_stability(spark, n):
    df = spark.range(n).select(F.concat(F.lit("k"), "id").alias("k"),
                               F.when(F.col("id") % 7 < 2, "neg").otherwise("pos").alias("y"))
    got = features.stratified_split(df, "k", "y").toPandas()
    size = Counter(got["split"])
    assert size["test"] == size["validation"] == n // 10 and len(got) == n
    for _, part in got.groupby("split"):
        share = (got["y"] == "neg").mean() * len(part)
        assert abs((part["y"] == "neg").sum() - share) <= 1
    again = features.stratified_split(df.repartition(5), "k", "y").toPandas()
    assert dict(zip(got["k"], got["split"])) == dict(zip(again["k"], again["split"]))
    other = features.stratified_split(df, "k", "y", seed=1).toPandas()
    assert dict(zip(got["k"], got["split"])) != dict(zip(other["k"], other["split"]))


def test_draws_are_shared_by_largest_remainder(spark):
    def shared(total, sizes):
        table = spark.createDataFrame(list(sizes.items()), "y string, n long")
        return {r["y"]: r["drawn"] for r in features.share_out(table, "y", "n", total, "drawn").collect()}

    assert shared(10, {"a": 50, "b": 30, "c": 19}) == {"a": 5, "b": 3, "c": 2}
    assert shared(1, {"a": 5, "b": 5}) == {"a": 1, "b": 0}


def test_split_and_weights_of_many_labels(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 5_000).alias("y"))
    split = features.stratified_split(df, "id", "y")
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {
        "train": 16_000, "validation": 2_000, "test": 2_000}
    assert split.groupBy("y", "split").count().filter("split <> 'train'").agg(F.max("count")).first()[0] == 1
    weights = features.with_class_weight(df, "y")
    assert weights.count() == 20_000 and weights.select("weight").distinct().collect() == [(1.0,)]
    with pytest.raises(ValueError, match="missing"):
        features.class_weights(df.withColumn("y", F.lit(None).cast("long")), "y")


def test_class_weights(docs):
    weights = {r["y"]: r["weight"] for r in features.class_weights(docs, "y").collect()}
    assert weights == {0: 8 / (2 * 3), 1: 8 / (2 * 5)}
    assert features.with_class_weight(docs, "y").count() == len(TEXTS)


@pytest.mark.usefixtures("many_partitions")
def test_logistic_fit_has_no_gradient_left(docs):
    fitted = features.fit_tfidf(docs, "t", max_df=1.0)
    rows = features.with_class_weight(fitted.vectors(docs, "t"), "y").repartition(5)
    model = models.fit_logistic(rows, "features", "y", "weight", tolerance=1e-9)
    assert model.converged and model.slope <= 1e-9
    with pytest.warns(UserWarning, match="gradient"):
        assert not models.fit_logistic(rows, "features", "y", "weight", iterations=1).converged
    terms, x = tfidf_matrix()
    order = {r["term"]: r["index"] for r in fitted.vocabulary.collect()}
    beta = np.array([model.coefficients[order[t]] for t in terms])
    y = np.array([y for _, y in TEXTS], float)
    w = np.where(y == 1, 8 / 10, 8 / 6)
    p = 1 / (1 + np.exp(-(x @ beta + model.intercept)))
    assert np.abs(x.T @ (w * (p - y)) + beta).max() < 1e-6
    assert abs((w * (p - y)).sum()) < 1e-6
    got = model.predict(fitted.vectors(docs, "t"), "features").orderBy("i").collect()
    assert np.allclose([r["probability"] for r in got], p)
    assert [r["predicted"] for r in got] == list((p > 0.5).astype(int))


def test_naive_bayes_equals_numpy(docs, spark):
    fitted = features.fit_tfidf(docs, "t", max_df=1.0)
    model = models.fit_naive_bayes(docs, fitted.weights(docs, ["i", "y"], "t"), "y")
    terms, x = tfidf_matrix()
    y = np.array([y for _, y in TEXTS])
    sums = np.array([x[y == c].sum(axis=0) for c in (0, 1)]) + 1
    joint = x @ np.log(sums / sums.sum(axis=1, keepdims=True)).T + np.log([3 / 8, 5 / 8])
    got = model.scores(docs, "i", fitted.weights(docs, ["i"], "t")).orderBy("i").toPandas()
    assert np.allclose(got[["score_0", "score_1"]], joint)
    assert got["predicted"].tolist() == list(joint.argmax(axis=1))
    assert model.log_prior == [math.log(3 / 8), math.log(5 / 8)]


def test_batch_scores(spark):
    df = spark.createDataFrame([(i, [float(i), 2.0]) for i in range(50)], "i int, v array<float>")

    def make():
        def predict(batch):
            assert batch.shape[1] == 2 and len(batch) <= 16
            return batch.sum(axis=1)
        return predict

    got = models.batch_score(df, "v", make, T.FloatType(), shapes=[[2]])
    assert all(r["score"] == r["i"] + 2 for r in got.collect())


def test_metrics_and_report(spark):
    pairs = [(1, 1)] * 5 + [(1, 0)] * 2 + [(0, 1)] * 3 + [(0, 0)] * 4
    df = spark.createDataFrame(pairs, "a int, p int")
    m = evaluation.binary_metrics(df, "a", "p").first()
    assert (m["accuracy"], m["precision"], m["recall"]) == (9 / 14, 5 / 8, 5 / 7)
    report = {r["class"]: r for r in evaluation.classification_report(df, "a", "p").collect()}
    assert report["0"]["support"] == 7 and report["0"]["precision"] == 4 / 6
    assert report["weighted avg"]["recall"] == pytest.approx(9 / 14)
    assert report["accuracy"]["precision"] is None and report["accuracy"]["f1"] == 9 / 14
    cells = {r["actual"]: (r["predicted_0"], r["predicted_1"])
             for r in evaluation.confusion_matrix(df, "a", "p").collect()}
    assert cells == {0: (4, 3), 1: (2, 5)}


def test_every_row_is_in_some_cell(spark):
    rows = [(1, 1), (1, None), (0, None), (0, 7), (5, 0), (None, 1), (1, 0), (0, 0)]
    df = spark.createDataFrame(rows, "a int, p int")
    cells = {r["actual"]: tuple(r)[1:] for r in evaluation.confusion_matrix(df, "a", "p").collect()}
    assert cells == {0: (1, 0, 2), 1: (1, 1, 1), None: (1, 1, 0)}
    judged = df.filter("a IN (0, 1)")
    # missing predictions are wrong: of six rows two are right
    assert evaluation.binary_metrics(judged.filter("p IS NULL OR p < 7"), "a", "p").first()["accuracy"] == 2 / 5


def test_undefined_ratios_are_zero_and_absent_cells_too(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "a int, p int")
    assert tuple(evaluation.binary_metrics(df, "a", "p").first()) == (1.0, 0.0, 0.0, 0.0)
    cells = evaluation.confusion_matrix(df, "a", "p").orderBy("actual").collect()
    assert [tuple(r) for r in cells] == [(0, 2, 0, 0), (1, 0, 0, 0)]
    only = spark.createDataFrame([("x", "y")], "a string, p string")
    report = {r["class"]: r for r in evaluation.classification_report(only, "a", "p").collect()}
    assert report["macro avg"]["f1"] == 0.0 and report["y"]["support"] == 0


def test_review_job_learns_an_easy_rule(spark):
    rng = np.random.default_rng(0)
    filler = ["entrega", "prazo", "loja", "dia"]
    rows = []
    for i in range(400):
        good = i % 4 != 0
        text = " ".join([*rng.choice(filler, 3), "ótimo!!" if good else "péssimo :("])
        rows.append((i, 5 if good else 1, text if i % 40 else "Not Defined"))
    reviews = spark.createDataFrame(rows, "i int, score int, message string")
    prepared = prepared_reviews(reviews, "i", "score", "message").cache()
    assert Counter(r["split"] for r in prepared.collect()) == {"train": 312, "validation": 39, "test": 39}
    for split in ("validation", "test"):
        result = compare_models(prepared, "i", split)
        reports = result.reports().toPandas()
        assert len(reports) == 10
        accuracy = reports[reports["class"] == "accuracy"].set_index("model")["f1"]
        assert accuracy["logistic regression"] == 1.0 and accuracy["naive Bayes"] == 1.0
        assert result.logistic.count() == result.naive_bayes.count() == 39


def test_rows_stay_where_they_are_when_labels_meet_them(spark):
    """Two labels would bring all texts together in two tasks."""
    rows = spark.range(400).select("id", (F.col("id") % 2).cast("int").alias("label"), F.col("id").cast("string").alias("text"))
    for joined in (features.stratified_split(rows, "id", "label"), features.with_class_weight(rows, "label")):
        plan = joined._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and joined.count() == 400


def test_scaled_search_takes_fewer_passes_to_the_same_end():
    draw = np.random.default_rng(5)
    x = draw.normal(size=(400, 60)) * 10.0 ** -draw.uniform(0, 2, 60)
    y = (x @ (draw.normal(size=60) / np.abs(x).mean(axis=0)) / 8 + draw.normal(size=400) > 0).astype(float)
    passes = []

    def evaluate(c):
        passes.append(1)
        margin = x @ c
        return float(np.mean(np.logaddexp(0, margin) - y * margin)) + 1e-4 * c @ c / 2, x.T @ (1 / (1 + np.exp(-margin)) - y) / 400 + 1e-4 * c

    plain, _ = models._minimise(evaluate, np.zeros(60), 3000, 1e-9, memory=10)
    slow = len(passes)
    scale = 1 / np.sqrt((x * x).mean(axis=0) / 4 + 1e-4)
    scaled, slope = models._minimise(evaluate, np.zeros(60), 3000, 1e-9, np.minimum(scale, 32))
    assert len(passes) - slow < slow and np.abs(slope).max() <= 1e-9 and np.allclose(plain, scaled, atol=1e-4)


def test_vectors_as_bytes_keep_their_numbers():
    import pyarrow as pa

    rows = [[1, 2], [], [7], [3, 4, 5]]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), pa.array([[v / 3 for v in r] for r in rows], pa.list_(pa.float64())),
                                        pa.array([0.0] * 4), pa.array([1.0] * 4), pa.array([9] * 4, pa.int32())], ["i", "v", "y", "w", "size"])
    for part in (batch, batch.slice(2), batch.slice(1, 1)):
        (packed,) = models._as_bytes([part])
        place, ends = models._unpacked(packed.column("i"), "<i4")
        value, _ = models._unpacked(packed.column("v"), "<f8")
        want = part.column("i").to_pylist()
        assert [place[a:b].tolist() for a, b in zip(ends, ends[1:])] == want
        assert value[:ends[-1]].tolist() == [v / 3 for r in want for v in r]
