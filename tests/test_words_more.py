"""Stems by rules, words of overlapping subsets, and naive Bayes over vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from shoplore.operators import models, words


def test_longest_fitting_suffix_of_each_step(spark):
    rules = [words.Suffix(1, "s"), words.Suffix(1, "ies", "y", 2), words.Suffix(2, "ly", "", 3), words.Suffix(2, "y", "i", 1)]
    df = spark.createDataFrame([(w,) for w in ("berries", "ies", "cats", "sadly", "fly", "y", "s", "", None, "señories")], "w string")
    got = df.select(words.stem_by_rules("w", rules).alias("s"))
    assert "Python" not in got._jdf.queryExecution().toString()
    assert [r["s"] for r in got.collect()] == ["berri", "ie", "cat", "sad", "fli", "y", "", "", None, "señori"]


def test_rules_and_a_function_of_the_user_agree(spark):
    counts = spark.createDataFrame([("cats", 2), ("cat", 3), ("dogs", 1)], "word string, n long")
    rows = [sorted(tuple(r) for r in words.stem_vocabulary(counts, s).collect())
            for s in ([words.Suffix(1, "s")], lambda w: w.removesuffix("s"))]
    assert rows[0] == rows[1] == [("cat", 2, 5), ("dog", 1, 1)]


def test_words_of_overlapping_subsets(spark):
    df = spark.createDataFrame([("aa aa bb", 1, 1), ("bb cc", 1, 0), ("aa", 0, 0), ("zz", None, 0), (None, 1, 1)], "t string, p int, q int")
    subsets = {"p": F.col("p") == 1, "q": F.col("q") == 1, "none": F.lit(False)}
    counts = words.subset_word_counts(df, "t", subsets)
    assert sorted(tuple(r) for r in counts.collect()) == [("aa", 2, 2, 0), ("bb", 2, 1, 0), ("cc", 1, 0, 0)]
    top = words.top_words_of_subsets(counts, list(subsets), 2)
    assert sorted(tuple(r) for r in top.collect()) == [("p", "aa", 2, 1.0), ("p", "bb", 2, 1.0), ("q", "aa", 2, 1.0), ("q", "bb", 1, 0.5)]
    with pytest.raises(ValueError):
        words.subset_word_counts(df, "t", {str(i): F.lit(True) for i in range(64)})


def test_term_matrix_equals_the_formula(spark):
    draw = np.random.default_rng(1)
    x, y = draw.integers(0, 3, (40, 6)).astype(float), draw.integers(0, 3, 40)
    x[0] = 0
    df = spark.createDataFrame([(int(c), Vectors.sparse(6, [(j, v) for j, v in enumerate(row) if v])) for row, c in zip(x, y)], ["y", "f"])
    model = models.fit_term_matrix(df, "f", "y")
    chance = np.stack([x[y == c].sum(axis=0) + 1 for c in range(3)])
    scores = x @ np.log(chance / chance.sum(axis=1, keepdims=True)).T + np.log(np.bincount(y) / len(y))
    scored = model.predict(df, "f")
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    got = scored.collect()
    assert np.allclose([[r[f"score_{c}"] for c in range(3)] for r in got], scores)
    assert [r["predicted"] for r in got] == scores.argmax(axis=1).tolist()
