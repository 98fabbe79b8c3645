"""Every registered query on the smallest tables, next to its SQL where it has any."""

from __future__ import annotations

import numpy as np
import pytest
from check_proofs import compare, connect

import __spark_entry__ as entry
from conftest import SMALL
from proofs import PROOFS

SLOW = {"elbow_curve", "elbow_curve_scores", "silhouette_curve", "silhouette_curve_normal", "cluster_centres",
        "kmeans_labels", "model_comparison", "logreg_predictions"}


@pytest.fixture(scope="module")
def db():
    return connect(SMALL)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 25


@pytest.mark.parametrize("name", sorted(set(PROOFS) & set(entry.oracle_sql())))
def test_query_equals_sql(spark, db, name):
    assert compare(entry.queries()[name](spark, SMALL), db.sql(entry.oracle_sql()[name])) == []


def test_queries_without_sql_are_the_seeded_and_iterative_ones():
    assert set(PROOFS) - set(entry.oracle_sql()) == SLOW | {"pca_projection"}


def run(spark, name):
    return entry.queries()[name](spark, SMALL)


@pytest.mark.parametrize("name", ["elbow_curve", "elbow_curve_scores"])
def test_elbows(spark, name):
    rows = {r["k"]: (r["cost"], r["chosen"]) for r in run(spark, name).collect()}
    costs = [rows[k][0] for k in range(2, 9)]
    assert costs == sorted(costs, reverse=True) and sum(chosen for _, chosen in rows.values()) == 1


@pytest.mark.parametrize("name", ["silhouette_curve", "silhouette_curve_normal"])
def test_silhouettes(spark, name):
    rows = {r["k"]: r["silhouette"] for r in run(spark, name).collect()}
    assert list(rows) == list(range(2, 9)) and all(0 < s < 1 for s in rows.values())


def test_clusters_and_centres_fit_each_other(spark):
    labelled = run(spark, "kmeans_labels").toPandas()
    centres = run(spark, "cluster_centres").toPandas().sort_values("cluster")
    names = [c for c in centres.columns if c != "cluster"]
    assert list(centres["cluster"]) == list(range(6))
    means = labelled.groupby("cluster")[names].mean()
    assert np.allclose(means, centres[names], atol=1e-3)
    gaps = ((labelled[names].to_numpy()[:, None, :] - centres[names].to_numpy()) ** 2).sum(axis=2)
    assert (gaps.argmin(axis=1) == labelled["cluster"]).all()


def test_projection(spark):
    rows = run(spark, "pca_projection").toPandas()
    assert rows["pc1"].var() >= rows["pc2"].var() > 0 and abs(np.corrcoef(rows["pc1"], rows["pc2"])[0, 1]) < 1e-5


def test_classifiers(spark):
    rows = run(spark, "logreg_predictions").collect()
    assert rows and all(0 < r["probability"] < 1 and r["predicted"] == (r["probability"] > 0.5) for r in rows)
    report = {(r["model"], r["class"]): r for r in run(spark, "model_comparison").collect()}
    assert report["logistic regression", "accuracy"]["support"] == report["naive Bayes", "accuracy"]["support"] == len(rows)
    assert report["logistic regression", "accuracy"]["f1"] == pytest.approx(
        sum(r["label"] == r["predicted"] for r in rows) / len(rows))
