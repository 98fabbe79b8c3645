"""K-means with restarts, choosing k, silhouettes, centres and a flat projection."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplore.operators import lloyd
from shoplore.operators.ordered import _offsets, _sorted_parts

VECTOR = "__features"


@dataclass(frozen=True)
class Clustering:
    """Centres, numbered by their order, what they cost, and how the search for them ended."""

    features: tuple[str, ...]
    centres: list[list[float]]
    cost: float
    steps: int = 0
    converged: bool = True

    def label(self, df: DataFrame, out: str = "cluster") -> DataFrame:
        """Add the number of the nearest centre; every other column, the key among them, stays with its row."""
        gaps = F.array(*[sum(((F.col(f).cast("double") - F.lit(x)) ** 2 for f, x in zip(self.features, centre)), F.lit(0.0))
                         for centre in self.centres])
        return df.withColumn(out, F.array_position(gaps, F.array_min(gaps)).cast("int") - 1)


def with_vector(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=VECTOR).transform(df)


def kmeans_sweep(df: DataFrame, features: Sequence[str], ks: Sequence[int], restarts: int = 10,
                 seed: int = 808, iterations: int = 300, tolerance: float = 1e-4) -> dict[int, Clustering]:
    """For every k the cheapest of ``restarts`` fits, all of them fitted in the same passes over the rows. A fit
    that still moves after ``iterations`` steps says so, and the sweep warns. Two clusters of one feature are the best
    there are (:func:`best_cut`), whatever the restarts settle on."""
    with lloyd.stored_points(df, features, seed) as points:
        fits = lloyd.sweep(points, list(ks), restarts, seed, iterations, tolerance)
    best = {}
    for k, found in fits.items():
        fit = min(found, key=lambda f: f.cost)
        centres = sorted([float(x) for x in c] for c in fit.centres)
        best[k] = Clustering(tuple(features), centres, fit.cost, fit.steps, fit.converged)
    if len(features) == 1 and 2 in best and (cut := best_cut(df, features[0])):
        # steps may settle beside the best cut, where no row is nearer to the other centre
        if cut.cost < best[2].cost * (1 - 1e-9):
            best[2] = cut
    if moving := [k for k, c in best.items() if not c.converged]:
        warnings.warn(f"k-means still moved after {iterations} steps for k = {moving}", stacklevel=2)
    return best


def kmeans(df: DataFrame, features: Sequence[str], k: int, restarts: int = 10, seed: int = 808,
           iterations: int = 300, tolerance: float = 1e-4) -> Clustering:
    return kmeans_sweep(df, features, [k], restarts, seed, iterations, tolerance)[k]


def best_cut(df: DataFrame, feature: str) -> Clustering | None:
    """The two clusters of one feature with the least cost, None if it has one value only. They are parted by a cut of
    the sorted values; of equal costs the lowest cut wins.

    Equal values are counted together, then the distinct values are range-partitioned. Rows and sum up to every value
    give the cost of the cut above it; the driver sees the best one.
    """
    x = F.col(feature).cast("double")
    facts = df.agg(F.avg(x).alias("mean")).first()
    # less the mean, so that squares lose no digits
    counts = df.groupBy((x - F.lit(facts["mean"])).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    parts = _sorted_parts(counts.withColumn("s", F.col("n") * F.col("x")), ["x"])
    sums = parts.groupBy("__part").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("s") * F.col("x")).alias("q"))
    whole = sums.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).first()
    inside = Window.partitionBy("__part").orderBy("__index")
    n, s = (F.col(f"{c}_before") + F.sum(c).over(inside) for c in ("n", "s"))
    for c in ("n", "s"):
        parts = parts.join(F.broadcast(_offsets(sums, c).withColumnRenamed("__before", f"{c}_before")), "__part")
    cuts = parts.select("x", n.alias("n"), s.alias("s")).filter(F.col("n") < whole["n"])
    rest_n, rest_s = F.lit(whole["n"]) - F.col("n"), F.lit(whole["s"]) - F.col("s")
    saved = F.col("s") ** 2 / F.col("n") + rest_s ** 2 / rest_n
    top = cuts.agg(F.max(F.struct(saved.alias("saved"), (-F.col("x")).alias("low"), "n", "s")).alias("top")).first()["top"]
    if top is None:
        return None
    centres = [top["s"] / top["n"], (whole["s"] - top["s"]) / (whole["n"] - top["n"])]
    return Clustering((feature,), [[facts["mean"] + c] for c in centres], whole["q"] - top["saved"])


def centres_table(df: DataFrame, clustering: Clustering) -> DataFrame:
    """``(cluster, <feature>, ...)``: one row per cluster."""
    fields = [T.StructField("cluster", T.IntegerType()),
              *[T.StructField(f, T.DoubleType()) for f in clustering.features]]
    rows = [(i, *centre) for i, centre in enumerate(clustering.centres)]
    return df.sparkSession.createDataFrame(rows, T.StructType(fields))


def elbow(costs: dict[int, float]) -> int:
    """The k whose cost lies farthest below the straight line from the first k to the last."""
    (k0, c0), (k1, c1) = min(costs.items()), max(costs.items())
    fall, run = c1 - c0, k1 - k0
    norm = math.hypot(fall, run) or 1.0
    return max(costs, key=lambda k: (fall * (k - k0) - run * (costs[k] - c0)) / norm)


def elbow_table(df: DataFrame, sweep: dict[int, Clustering]) -> DataFrame:
    """``(k, cost, chosen)``."""
    costs = {k: c.cost for k, c in sweep.items()}
    chosen = elbow(costs)
    return df.sparkSession.createDataFrame(
        [(k, cost, k == chosen) for k, cost in sorted(costs.items())],
        "k int, cost double, chosen boolean")


def silhouette(labelled: DataFrame, features: Sequence[str], cluster: str = "cluster") -> float:
    """Mean silhouette under squared Euclidean distance. Its cost is linear in the rows, because the
    mean squared distance to a cluster follows from the cluster's size, sum and sum of squares."""
    # not over merged rows: with weights the library leaves out a row's equals, not the row alone
    return ClusteringEvaluator(featuresCol=VECTOR, predictionCol=cluster,
                               distanceMeasure="squaredEuclidean").evaluate(
        with_vector(labelled, features))


def silhouette_table(df: DataFrame, features: Sequence[str], sweep: dict[int, Clustering]) -> DataFrame:
    """``(k, silhouette)`` for every fitted k."""
    found = sorted(sweep.items())
    with lloyd.stored_points(df, features, 0) as points:
        scores = lloyd.squared_silhouettes(points, [np.array(c.centres) for _, c in found])
    rows = [(k, s) for (k, _), s in zip(found, scores)]
    return df.sparkSession.createDataFrame(rows, "k int, silhouette double")


def euclidean_silhouette_table(df: DataFrame, features: Sequence[str], sweep: dict[int, Clustering],
                               tolerance: float = 1e-3) -> DataFrame:
    """``(k, silhouette, bound)`` under Euclidean distance for every fitted k, for features of any values: the true
    value lies within ``bound`` of the one given. A bound over ``tolerance`` warns."""
    found = sorted(sweep.items())
    with lloyd.stored_points(df, features, 0) as points:
        scores = lloyd.euclidean_silhouettes(points, [np.array(c.centres) for _, c in found], tolerance)
    if (worst := max(s.bound for s in scores)) > tolerance:
        warnings.warn(f"silhouettes are known within {worst:.2g} only", stacklevel=2)
    rows = [(k, s.value, s.bound) for (k, _), s in zip(found, scores)]
    return df.sparkSession.createDataFrame(rows, "k int, silhouette double, bound double")


def silhouette_squared_points(df: DataFrame, vector: str, cluster: str) -> DataFrame:
    """The silhouette of every row under squared Euclidean distance, for an array column.

    Per cluster the size, the vector sum and the sum of squared lengths are aggregated; a row's mean
    squared distance to a cluster then needs no other row. The cluster table, one entry per cluster,
    reaches the tasks as a scalar subquery.
    """
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    rows = df.withColumn("__x", x).withColumn(
        "__sq", F.aggregate("__x", F.lit(0.0), lambda s, v: s + v * v))
    clusters = (rows.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"), F.sum("__sq").alias("sqs"),
        vector_to_array(Summarizer.sum(array_to_vector("__x"))).alias("sums"))
        .agg(F.collect_list(F.struct(F.col(cluster).alias("id"), "n", "sqs", "sums"))))

    def total(c):
        """Sum of the squared distances from the row to the members of cluster ``c``."""
        dot = F.aggregate(F.zip_with("__x", c["sums"], lambda a, b: a * b),
                          F.lit(0.0), lambda s, v: s + v)
        return c["n"] * F.col("__sq") + c["sqs"] - dot * 2

    rows = rows.withColumn("__clusters", clusters.scalar())
    table = F.col("__clusters")
    own = F.transform(F.filter(table, lambda c: c["id"] == F.col(cluster)),
                      lambda c: F.struct(c["n"].alias("n"), total(c).alias("d")))[0]
    other = F.array_min(F.transform(F.filter(table, lambda c: c["id"] != F.col(cluster)),
                                    lambda c: total(c) / c["n"]))
    scored = rows.withColumn("__own", own).withColumn("__b", other)
    a = F.col("__own.d") / (F.col("__own.n") - 1)
    return scored.withColumn("silhouette", F.when(F.col("__own.n") > 1,
                             (F.col("__b") - a) / F.greatest(a, F.col("__b"))).otherwise(F.lit(0.0))
                             ).drop("__clusters", "__x", "__sq", "__own", "__b")


def silhouette_exact_points(labelled: DataFrame, features: Sequence[str], cluster: str = "cluster",
                            values: Sequence[float] = (1, 2, 3, 4, 5)) -> DataFrame:
    """The Euclidean silhouette of every distinct ``(features, cluster)`` point with its row count ``n``,
    for features that take only the declared ``values``.

    Equal rows are merged first. The grid bounds the points: with three features of five values there
    are at most 125 per cluster, however many rows. Each point is compared with the list of all points,
    which reaches the tasks as a scalar subquery. A value off the grid is an error; :func:`silhouette`
    takes any values.
    """
    names = list(features)
    allowed = [float(v) for v in values]

    def on_grid(f: str):
        x = F.col(f).cast("double")
        message = F.concat(F.lit(f"{f} has a value off the grid: "), F.coalesce(x.cast("string"), F.lit("null")))
        return F.when(x.isin(allowed), x).otherwise(F.raise_error(message).cast("double")).alias(f)

    points = (labelled.select(cluster, *[on_grid(f) for f in names]).groupBy(cluster, *names)
              .agg(F.count(F.lit(1)).alias("n")))
    place = F.array(*names)
    every = points.agg(F.collect_list(F.struct(F.col(cluster).alias("id"), "n", place.alias("x"))))
    rows = points.withColumns({"__every": every.scalar(), "__x": place})

    def gap(other):
        squares = F.zip_with("__x", other["x"], lambda a, b: (a - b) * (a - b))
        return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))

    def total(column, ids, amount):
        """Sum of an amount over the points of a cluster."""
        return F.aggregate(F.filter(column, lambda p: p["id"] == ids), F.lit(0.0), lambda s, p: s + amount(p))

    gaps = F.transform("__every", lambda p: F.struct(p["id"].alias("id"), p["n"].alias("n"), (gap(p) * p["n"]).alias("d")))
    rows = rows.withColumn("__gaps", gaps).withColumn(
        "__ids", F.array_distinct(F.transform("__gaps", lambda p: p["id"])))
    sums = F.transform("__ids", lambda i: F.struct(
        i.alias("id"), total(F.col("__gaps"), i, lambda p: p["n"]).alias("n"), total(F.col("__gaps"), i, lambda p: p["d"]).alias("d")))
    rows = rows.withColumn("__sums", sums)
    own = F.filter("__sums", lambda s: s["id"] == F.col(cluster))[0]
    outer = F.array_min(F.transform(F.filter("__sums", lambda s: s["id"] != F.col(cluster)), lambda s: s["d"] / s["n"]))
    rows = rows.withColumns({"__own": own, "__b": outer})
    a = F.col("__own.d") / (F.col("__own.n") - 1)
    score = F.when(F.col("__own.n") > 1, F.coalesce(F.try_divide(F.col("__b") - a, F.greatest(a, F.col("__b"))), F.lit(0.0)))
    return rows.select(cluster, *names, "n", score.otherwise(F.lit(0.0)).alias("silhouette"))


def melt(df: DataFrame, ids: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """One row per id and measure."""
    numbers = df.select(*ids, *[F.col(m).cast("double").alias(m) for m in measures])
    return numbers.unpivot(list(ids), list(measures), "measure", "value")


def project(df: DataFrame, vector_or_features: str | Sequence[str], k: int = 2) -> tuple[DataFrame, list[float]]:
    """Principal components ``pc1..pck`` and the share of variance each explains.

    Give scaled columns, or the name of one vector column, and leave labels out. A component's sign
    is free, so its largest loading is made positive.
    """
    if isinstance(vector_or_features, str):
        vectors, vector = df, vector_or_features
    else:
        vectors, vector = with_vector(df, vector_or_features), VECTOR
    model = PCA(k=k, inputCol=vector, outputCol="__pcs").fit(vectors)
    loadings = model.pc.toArray()
    signs = [1.0 if max(loadings[:, j], key=abs) >= 0 else -1.0 for j in range(k)]
    values = vector_to_array("__pcs")
    columns = {f"pc{j + 1}": values[j] * F.lit(signs[j]) for j in range(k)}
    dropped = ["__pcs"] + ([VECTOR] if vector == VECTOR else [])
    return (model.transform(vectors).withColumns(columns).drop(*dropped),
            [float(v) for v in model.explainedVariance])
