"""Profiles, scaling and clustering against numpy and pandas."""

from __future__ import annotations

import math
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shoplore.operators import clustering, lloyd, quality, rfm, scaling
from shoplore.plans.segmentation import (MEASURES, check_measures, choose_k, exact_silhouette,
                                         scaled_profile, segment)


@pytest.fixture(scope="module")
def shop(spark):
    orders = spark.createDataFrame(
        [("o1", "c1", date(2018, 8, 29)), ("o2", "c1", date(2018, 8, 1)), ("o3", "c2", date(2018, 1, 1)),
         ("o4", "c3", date(2018, 1, 1)), ("o5", "c4", date(2018, 2, 2))],
        "order_id string, cust_id string, order_dt date")
    payments = spark.createDataFrame(
        [("o1", "10.10"), ("o1", "0.20"), ("o2", "5.00"), ("o3", "7.00"), ("o4", "0.00")],
        "order_id string, payment_value string").withColumn(
        "payment_value", F.col("payment_value").cast("decimal(10,2)"))
    customers = spark.createDataFrame([(f"c{i}", "z", "city", "SP") for i in range(1, 6)],
                                      "cust_id string, cust_zip_cd_prefix string, cust_city string, cust_state string")
    return orders, payments, customers


def test_profile_takes_the_latest_order(shop):
    rows = {r["cust_id"]: (r["frequency"], r["recency"], float(r["monetary"]))
            for r in rfm.rfm(*shop, "2018-08-29").collect()}
    assert rows == {"c1": (2, 1, 15.3), "c2": (1, 241, 7.0), "c3": (1, 241, 0.0)}
    assert rfm.rfm(*shop, "2018-08-29", drop_nonpositive=True).count() == 2


def test_profile_per_date_repeats_customers(shop):
    rows = sorted((r["cust_id"], r["recency"]) for r in rfm.rfm(*shop, "2018-08-29", mode="per_date").collect())
    assert rows == [("c1", 1), ("c1", 29), ("c2", 241), ("c3", 241)]
    with pytest.raises(ValueError, match="mode"):
        rfm.recency(shop[0], "2018-08-29", mode="first")


def test_profile_moves_each_table_once(spark, tmp_path, shop):
    """One shuffle each for orders and payments by their keys and one by customer; customers are merged
    over all their columns before they move by key, so that a repeated customer fills no task."""
    names = ("orders", "payments", "customers")
    for name, df in zip(names, shop):
        df.write.parquet(str(tmp_path / name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = [spark.read.parquet(str(tmp_path / name)) for name in names]
        plan = rfm.rfm(*stored, "2018-08-29")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 5 and plan.count("FileScan") == 3
    assert "SinglePartition" not in plan and "Cartesian" not in plan


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(7)
    n = 600
    frame = pd.DataFrame({"id": range(n), "recency": rng.integers(1, 700, n),
                          "frequency": rng.integers(1, 4, n), "monetary": np.round(rng.lognormal(4, 1, n), 2)})
    return frame, spark.createDataFrame(frame).repartition(4).cache()


def test_scores_equal_pandas(people):
    frame, df = people
    got = rfm.total_score(rfm.rfm_scores(df, "id")).toPandas().sort_values("id")
    r = pd.qcut(frame["recency"], 5, labels=[5, 4, 3, 2, 1]).astype(int)
    f = pd.qcut(frame["frequency"].rank(method="first"), 5, labels=[1, 2, 3, 4, 5]).astype(int)
    m = pd.qcut(frame["monetary"], 5, labels=[1, 2, 3, 4, 5]).astype(int)
    assert got["score_recency"].tolist() == r.tolist()
    assert got["score_frequency"].tolist() == f.tolist()
    assert got["score_monetary"].tolist() == m.tolist()
    assert got["score_total"].tolist() == (r + f + m).tolist()


def test_scalers_equal_numpy(people):
    frame, df = people
    x = frame[list(MEASURES)].astype(float)
    standard = scaled_profile(df, "standard").toPandas().sort_values("id")
    robust = scaled_profile(df, "robust").toPandas().sort_values("id")
    for m in MEASURES:
        assert np.allclose(standard[f"norm_{m}"], (x[m] - x[m].mean()) / x[m].std(ddof=0))
        low, mid, high = np.quantile(x[m], [0.25, 0.5, 0.75])
        assert np.allclose(robust[f"norm_{m}"], (x[m] - mid) / (high - low))


def test_constant_columns(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    for scaler in ("standard", "robust"):
        assert scaling.apply_scale(df, scaling.SCALERS[scaler](df, ["x"])).first()["norm_x"] == 0.0
    with pytest.raises(ValueError, match="constant"):
        scaling.fit_box_cox(df, ["x"])


@pytest.mark.parametrize("bad", [0.0, -1.0])
def test_box_cox_needs_positive_values(spark, bad):
    df = spark.createDataFrame([(2.0,), (bad,)], "x double")
    with pytest.raises(ValueError, match="not positive"):
        scaling.fit_box_cox(df, ["x"])


def log_likelihood(x, power):
    y = np.log(x) if power == 0 else (x ** power - 1) / power
    return (power - 1) * np.log(x).sum() - len(x) / 2 * np.log(y.var())


@pytest.mark.parametrize("power", [-3.4, 0.0, 0.31, 4.2])
def test_box_cox_power_is_the_best(spark, power):
    z = np.random.default_rng(11).normal(0, 0.05, 500)
    x = np.exp(z) if power == 0 else (1 + power * z) ** (1 / power)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    best = scaling.fit_box_cox_powers(df, ["x"])["x"]
    around = [log_likelihood(x, best + d) for d in (-1e-3, 0.0, 1e-3)]
    assert around[1] >= max(around)
    scaled = scaling.apply_scale(df, scaling.fit_box_cox(df, ["x"])).toPandas()["norm_x"]
    assert abs(scaled.mean()) < 1e-8 and scaled.std(ddof=0) == pytest.approx(1)


def test_describe_and_correlation_equal_pandas(people):
    frame, df = people
    got = quality.describe_numeric(df, MEASURES).toPandas().set_index("measure")
    expected = frame[list(MEASURES)].describe().T
    assert np.allclose(got[["count", "mean", "std", "min", "p25", "p50", "p75", "max"]].astype(float),
                       expected, rtol=1e-12)
    r = quality.correlation_matrix(df, MEASURES).toPandas().pivot(index="a", columns="b", values="r")
    assert np.allclose(r, frame[list(MEASURES)].corr().loc[r.index, r.columns])


def test_histogram_counts_every_row(people):
    frame, df = people
    bins = quality.histogram(df, "monetary", 12).orderBy("bin").toPandas()
    expected, edges = np.histogram(frame["monetary"], 12)
    assert bins["n"].tolist() == expected.tolist() and np.allclose(bins["high"], edges[1:])


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    centres = [(-6, 0), (0, 6), (6, 0), (0, -6)]
    points = np.concatenate([rng.normal(c, 0.5, (60, 2)) for c in centres])
    frame = pd.DataFrame(points, columns=["x", "y"]).assign(id=range(240), truth=np.repeat(range(4), 60))
    return frame, spark.createDataFrame(frame).cache()


def test_kmeans_finds_the_blobs(blobs):
    frame, df = blobs
    choice = choose_k(df, ["x", "y"], ks=range(2, 7), restarts=3)
    assert choice.by_silhouette == 4 and choice.by_elbow == 4
    model = choice.sweep[4]
    got = model.label(df).toPandas()
    assert len(got) == len(frame) and got.groupby("truth")["cluster"].nunique().max() == 1
    means = got.groupby("cluster")[["x", "y"]].mean()
    assert np.allclose(means, model.centres, atol=1e-6)
    assert means["x"].is_monotonic_increasing
    spread = ((got[["x", "y"]].to_numpy() - means.loc[got["cluster"]].to_numpy()) ** 2).sum()
    assert model.cost == pytest.approx(spread)
    assert [r["cluster"] for r in clustering.centres_table(df, model).orderBy("cluster").collect()] == [0, 1, 2, 3]
    single = [clustering.kmeans(df, ["x", "y"], 4, restarts=1, seed=808 + i).cost for i in range(3)]
    assert model.cost <= min(single) + 1e-9


def test_sweep_steps_equal_plain_lloyd(blobs):
    """From the same centres a pass for several models moves each as a plain loop would."""
    frame, df = blobs
    x = frame[["x", "y"]].to_numpy()
    with lloyd.stored_points(df, ["x", "y"], 1) as points:
        models = [x[:3] - points.mean, x[5:10] - points.mean, np.array([[1e6, 1e6], [0.0, 0.0]])]
        moved, costs = lloyd._step(points, models)
        for model, new, cost in zip(models, moved, costs):
            gaps = ((x[:, None] - points.mean - model[None]) ** 2).sum(axis=2)
            near = gaps.argmin(axis=1)
            want = [(x[near == i] - points.mean).mean(axis=0) if (near == i).any() else model[i] for i in range(len(model))]
            assert np.allclose(new, want) and cost == pytest.approx(gaps.min(axis=1).sum())
        two = [m + points.mean for m in moved[:2]]
        got = lloyd.squared_silhouettes(points, two)
    for centres, score in zip(two, got):
        labels = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert score == pytest.approx(silhouettes(x, labels, 2).mean())


def test_sweep_reports_how_it_ended(spark, blobs):
    _, df = blobs
    with pytest.warns(UserWarning, match="still moved after 1 steps"):
        found = clustering.kmeans_sweep(df, ["x", "y"], [6], restarts=1, iterations=1, tolerance=0.0)[6]
    assert not found.converged and found.steps == 1
    assert clustering.kmeans(df, ["x", "y"], 4, restarts=2).converged
    same = spark.range(50).select(F.lit(2.0).alias("x"), F.lit(3.0).alias("y"))
    assert clustering.kmeans(same, ["x", "y"], 3, restarts=2).centres == [[2.0, 3.0]]
    with pytest.raises(Exception, match="a feature has no value"):
        clustering.kmeans(same.withColumn("y", F.lit(None).cast("double")), ["x", "y"], 2)


def test_two_groups_of_one_feature_are_the_best_cut(spark):
    """Plain steps also settle at the cuts beside the best one."""
    counts = {x: round(10 * math.exp(-((x - 10) / 4.5) ** 2)) + 1 for x in range(1, 26)}
    x = np.repeat(list(counts), list(counts.values())).astype(float)
    costs = {c: sum(((part - part.mean()) ** 2).sum() for part in (x[x <= c], x[x > c])) for c in range(1, 25)}
    settled = [c for c in costs if c < (x[x <= c].mean() + x[x > c].mean()) / 2 <= c + 1]
    assert len(settled) > 1  # so restarts may miss the best
    df = spark.createDataFrame([(v,) for v in x.tolist()], "x double").repartition(4)
    best = min(costs, key=costs.get)
    want = [x[x <= best].mean(), x[x > best].mean()]
    for seed in range(4):
        model = clustering.kmeans(df, ["x"], 2, restarts=1, seed=seed, tolerance=0.0)
        assert model.cost == pytest.approx(costs[best]) and np.allclose(model.centres, np.array(want)[:, None])
    cut = clustering.best_cut(df, "x")
    assert cut.cost == pytest.approx(costs[best]) and np.allclose(cut.centres, np.array(want)[:, None])
    assert clustering.best_cut(spark.range(5).select(F.lit(2.0).alias("x")), "x") is None


def test_segments_keep_every_customer(people):
    _, df = people
    scored = rfm.rfm_scores(df, "id")
    found = segment(scored, "id", list(rfm.SCORES), k=6, restarts=2)
    assert found.profile.agg(F.sum("size")).first()[0] == 600
    assert found.long.count() == 3 * 600
    assert {r["cluster"] for r in found.labelled.select("cluster").distinct().collect()} == set(range(6))


def silhouettes(x, labels, power):
    gaps = np.linalg.norm(x[:, None] - x[None], axis=2) ** power
    out = []
    for i, own in enumerate(labels):
        mine = (labels == own) & (np.arange(len(x)) != i)
        if not mine.any():
            out.append(0.0)
            continue
        a = gaps[i, mine].mean()
        b = min(gaps[i, labels == c].mean() for c in set(labels) if c != own)
        out.append((b - a) / max(a, b))
    return np.array(out)


def test_silhouettes_equal_numpy(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(1, 6, (200, 3)).astype(float)
    labels = rng.integers(0, 3, 200)
    labels[0] = 9
    frame = pd.DataFrame(x, columns=list("abc")).assign(cluster=labels, id=range(200))
    df = spark.createDataFrame(frame)
    euclidean = exact_silhouette(df, list("abc")).first()["silhouette"]
    assert euclidean == pytest.approx(silhouettes(x, labels, 1).mean())
    squared = silhouettes(x, labels, 2)
    assert clustering.silhouette(df, list("abc")) == pytest.approx(squared.mean())
    points = clustering.silhouette_squared_points(
        df.withColumn("v", F.array("a", "b", "c")), "v", "cluster").orderBy("id").toPandas()
    assert np.allclose(points["silhouette"], squared)
    with pytest.raises(Exception, match="off the grid"):
        clustering.silhouette_exact_points(df, list("abc"), values=(1, 2)).collect()


def test_projection_explains_what_numpy_does(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4)) * [5, 3, 1, 0.5]
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")).assign(id=range(300)))
    rows, shares = clustering.project(df, list("abcd"))
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(shares, values[:2] / values.sum())
    got = rows.toPandas()
    assert list(got.columns) == ["a", "b", "c", "d", "id", "pc1", "pc2"]
    assert np.allclose(got[["pc1", "pc2"]].var(), values[:2])


def test_bad_measures_are_refused(spark, people):
    check_measures(people[1])
    with pytest.raises(ValueError, match="monetary"):
        check_measures(people[1].withColumn("monetary", -F.col("monetary")))


def test_curves_of_normal_features_sweep_alike(monkeypatch):
    from proofs import PROOFS, segments

    asked = []
    monkeypatch.setattr(segments, "_normal", lambda t: None)
    monkeypatch.setattr(segments.clustering, "kmeans_sweep", lambda *a, **k: asked.append((a, k)))
    monkeypatch.setattr(segments.clustering, "silhouette_table", lambda *a, **k: None)
    PROOFS["silhouette_curve_normal"].run(None, "/root/testdata/sf0.001")
    assert asked == [((None, segments.NORMED, range(2, 9)), {})]


def euclidean_by_pairs(x, centres):
    labels = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
    gaps = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    scores = []
    for i, own in enumerate(labels):
        others = [gaps[i, labels == c].mean() for c in set(labels) - {own}]
        if (labels == own).sum() == 1 or not others:
            scores.append(0.0)
            continue
        a, b = gaps[i, labels == own].sum() / ((labels == own).sum() - 1), min(others)
        scores.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(scores))


@pytest.mark.parametrize("kind", ["blobs", "repeated", "far"])
def test_bounds_hold_the_euclidean_silhouette(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 3)) + rng.integers(0, 3, 700)[:, None] * 1.5
    if kind == "repeated":
        x = np.round(x)
    if kind == "far":
        x[0], x[1:40] = 500.0, 3.0
    models = [x[rng.choice(len(x), k, replace=False)] + 0.01 * rng.standard_normal((k, 3)) for k in (2, 3, 5)]  # no ties
    models += [np.array([x[0], x[0] + 1e6])]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").repartition(4)
    with lloyd.stored_points(df, ["a", "b", "c"], 0) as points:
        fine = lloyd.euclidean_silhouettes(points, models, tolerance=1e-3)
        coarse = lloyd.euclidean_silhouettes(points, models, tolerance=1e-9, parts=4, most_cells=900)
    for model, near, wide in zip(models, fine, coarse):
        true = euclidean_by_pairs(x, model)
        assert near.bound <= 1e-3 and abs(near.value - true) <= near.bound + 1e-6
        assert abs(wide.value - true) <= wide.bound + 1e-6


def test_a_pass_gets_blocks_of_rows(spark):
    draw = np.random.default_rng(5)
    values = draw.normal(size=(9001, 2)).round(1)  # ties between centres
    df = spark.createDataFrame([tuple(map(float, v)) for v in values], "x double, y double").repartition(2)
    with lloyd.stored_points(df, ["x", "y"], 1) as points:
        assert points.blocks.count() <= 6
        assert points.blocks.selectExpr("sum(length(x)) AS x", "sum(length(u)) AS u").first().asDict() == {"x": 9001 * 16, "u": 9001 * 8}
        assert points.n == 9001 and np.allclose(points.summed(lambda x: x.sum(axis=0)), 0, atol=1e-8)
        everything = points.drawn(np.zeros((1, 2)) + 50, 1.0, 0)
        assert np.allclose(everything + points.mean, np.unique(values, axis=0))
    sizes, centres = [1, 2, 5], draw.normal(size=(8, 2)).round(1)
    centres[5] = centres[4]
    places, least = lloyd._nearest(values, centres, sizes)
    gaps = ((values[:, None] - centres) ** 2).sum(axis=2)
    for m, (begin, end) in enumerate(((0, 1), (1, 3), (3, 8))):
        assert np.allclose(gaps[:, begin:end].min(axis=1), least[:, m])
        assert np.allclose(gaps[np.arange(9001), places[:, m]], least[:, m]) and not (places[:, m] == 5).any()
