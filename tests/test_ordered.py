"""Global order, ranks, quantiles and running means against pandas and numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shoplore.operators.ordered import (ewma_by_key, exact_quantiles, place_bin, quantile_bin,
                                        with_ranks, with_row_number)

pytestmark = pytest.mark.usefixtures("many_partitions")


def hot_rows(n=3000, seed=1):
    """A third of the rows share one key and one value."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 1 / 3, 7, rng.integers(0, 200, n))
    value = np.where(key == 7, 5.0, np.round(rng.gamma(2, 50, n), 2))
    return pd.DataFrame({"id": np.arange(n), "key": key, "value": value})


def test_row_number_over_several_partitions(spark):
    frame = hot_rows()
    numbered = with_row_number(spark.createDataFrame(frame), ["value", "id"]).toPandas()
    assert list(numbered.columns) == ["id", "key", "value", "row_number"]
    expected = frame.sort_values(["value", "id"])["id"].tolist()
    assert numbered.sort_values("row_number")["id"].tolist() == expected
    assert sorted(numbered["row_number"]) == list(range(1, len(frame) + 1))


def test_a_hot_value_is_spread(spark):
    df = spark.createDataFrame(hot_rows())
    parts = df.repartitionByRange("value", "id").filter("value = 5.0")
    assert parts.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_row_number_of_nothing_and_descending(spark):
    empty = spark.createDataFrame([], "id long, value double")
    assert with_row_number(empty, ["value", "id"]).count() == 0
    frame = hot_rows(50)
    got = with_row_number(spark.createDataFrame(frame), [F.col("value").desc(), "id"], "place").toPandas()
    expected = frame.sort_values(["value", "id"], ascending=[False, True])["id"].tolist()
    assert got.sort_values("place")["id"].tolist() == expected


def test_ranks_over_whole_tables(spark):
    frame = hot_rows(500)
    frame.loc[::50, "value"] = None
    ranked = with_ranks(spark.createDataFrame(frame), {"up": ("value", False), "down": ("key", True)}
                        ).toPandas().sort_values("id")
    up = frame["value"].rank(method="min", na_option="bottom")
    down = frame["key"].rank(method="min", ascending=False)
    assert ranked["up"].tolist() == up.astype(int).tolist()
    assert ranked["down"].tolist() == down.astype(int).tolist()


def test_many_groups_are_ranked(spark):
    ranked = with_ranks(spark.range(300_000).select((F.col("id") % 150_000).alias("x"), "id"), {"r": ("x", True)})
    wrong = ranked.filter(F.col("r") != 1 + 2 * (149_999 - F.col("x")))
    assert ranked.count() == 300_000 and wrong.isEmpty()


def test_quantiles_equal_numpy(spark):
    frame = hot_rows()
    frame["odd"] = np.random.default_rng(2).normal(size=len(frame))
    frame.loc[::7, "odd"] = None
    probabilities = [0, 0.2, 0.25, 0.5, 0.75, 0.9, 1]
    got = exact_quantiles(spark.createDataFrame(frame).replace(float("nan"), None),
                          ["value", "odd", "id"], probabilities)
    for c in ("value", "odd", "id"):
        expected = np.quantile(frame[c].dropna(), probabilities)
        assert np.allclose(got[c], expected, rtol=1e-12)


def test_quantile_of_missing_values_is_refused(spark):
    with pytest.raises(ValueError, match="no values"):
        exact_quantiles(spark.createDataFrame([(None,)], "x double"), ["x"], [0.5])


def test_quantile_bins_equal_qcut(spark):
    frame = pd.DataFrame({"x": np.random.default_rng(3).integers(0, 1000, 777)})
    df = spark.createDataFrame(frame)
    edges = exact_quantiles(df, ["x"], [i / 5 for i in range(6)])["x"]
    got = df.select("x", quantile_bin("x", edges, [5, 4, 3, 2, 1]).alias("b")).toPandas()
    expected = pd.qcut(got["x"], 5, labels=[5, 4, 3, 2, 1]).astype(int)
    assert got["b"].tolist() == expected.tolist()


def test_equal_edges_are_refused():
    with pytest.raises(ValueError, match="not unique"):
        quantile_bin("x", [1, 1, 2, 3, 4, 5], [1, 2, 3, 4, 5])


@pytest.mark.parametrize("n", [2, 5, 6, 12, 16, 101, 399])
def test_place_bins_equal_qcut_of_first_ranks(spark, n):
    got = spark.range(1, n + 1).select(place_bin(F.col("id"), n, [1, 2, 3, 4, 5]).alias("b")).toPandas()
    expected = pd.qcut(pd.Series(range(1, n + 1)), 5, labels=[1, 2, 3, 4, 5]).astype(int)
    assert got["b"].tolist() == expected.tolist()


def expected_means(frame, decay):
    means = {}
    for _, rows in frame.sort_values(["key", "id"]).groupby("key", dropna=False):
        mean = None
        for i, x in zip(rows["id"], rows["value"]):
            if not pd.isna(x):
                mean = x if mean is None else decay * mean + (1 - decay) * x
            means[i] = mean
    return means


@pytest.mark.parametrize("batch", ["10000", "37"])
def test_running_mean_crosses_partitions_and_batches(spark, batch):
    rng = np.random.default_rng(4)
    frame = hot_rows(2000)
    frame["value"] = rng.normal(100, 30, len(frame))
    frame.loc[rng.random(len(frame)) < 0.1, "value"] = None
    df = (spark.createDataFrame(frame).replace(float("nan"), None)
          .withColumn("note", F.lit("kept")).withColumn("big", F.lit(2**60 + 1)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = ewma_by_key(df, "key", ["id"], "value", 0.9).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert list(got.columns) == ["id", "key", "value", "note", "big", "ewma"]
    assert set(got["note"]) == {"kept"} and set(got["big"]) == {2**60 + 1}
    expected = expected_means(frame, 0.9)
    for i, mean in zip(got["id"], got["ewma"]):
        assert (pd.isna(mean) and expected[i] is None) or mean == pytest.approx(expected[i], rel=1e-9)


def test_running_mean_of_one_key_and_of_text_keys(spark):
    frame = pd.DataFrame({"id": range(500), "key": "only", "value": np.arange(500) * 1.5})
    got = ewma_by_key(spark.createDataFrame(frame), "key", ["id"], "value").toPandas().sort_values("id")
    expected = frame["value"].ewm(alpha=0.05, adjust=False).mean()
    assert np.allclose(got["ewma"], expected)
