"""Logistic regression, multinomial naive Bayes and batch scoring with any model."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplore.operators.features import label_sizes
from shoplore.session import checkpointed


@dataclass(frozen=True)
class Logistic:
    """A fitted binary classifier. ``slope`` is the largest entry of the gradient where the search
    ended, and ``converged`` whether that is within the tolerance."""

    coefficients: list[float]
    intercept: float
    slope: float = 0.0
    converged: bool = True

    def predict(self, df: DataFrame, features: str, out: str = "predicted",
                probability: str = "probability") -> DataFrame:
        """Add the probability of label 1 and the likelier label; a row needs no other row."""
        spark = df.sparkSession
        table = spark.createDataFrame([(self.coefficients,)], "c array<double>")
        indices, values = sparse_parts(features)
        scored = (df.withColumn("__c", table.scalar())
                  .withColumn("__i", indices).withColumn("__v", values))
        products = F.zip_with("__i", "__v", lambda i, v: v * F.get("__c", i))
        margin = F.aggregate(products, F.lit(self.intercept), lambda total, x: total + x)
        return (scored.withColumn(probability, 1 / (1 + F.exp(-margin)))
                .withColumn(out, (F.col(probability) > 0.5).cast("int")).drop("__c", "__i", "__v"))


def sparse_parts(vector: str) -> tuple[Column, Column]:
    """Indices and values of a vector column as arrays; a dense vector lists all its places."""
    parts = F.unwrap_udt(vector)
    everywhere = F.sequence(F.lit(0), F.size(parts["values"]) - 1)
    return F.coalesce(parts["indices"], everywhere), parts["values"]


def fit_logistic(train: DataFrame, features: str, label: str, weight: str | None = None,
                 strength: float = 1.0, iterations: int = 500, tolerance: float = 1e-5) -> Logistic:
    """Minimise ``strength * sum(weight * loss) + |coefficients|^2 / 2``; the intercept is free.

    Each step of the limited-memory BFGS search is one pass over the stored rows, whose vectors are kept as bytes
    that go to Python as they are; every task adds up its own part of the gradient. The search runs in coefficients
    scaled by the curvature at zero, without which it takes more passes the more rows there are. The executors add the parts, first in as many groups as the
    root of their number, then all; the driver gets one vector. A search that ends before the gradient
    is within ``tolerance`` warns and says so in the result. The library's own solver divides every feature by its deviation first.
    For rare words that spoils the conditioning of this objective: it is still falling after 500
    passes where this search is done in some tens.
    """
    indices, values = sparse_parts(features)
    weights = F.col(weight) if weight else F.lit(1.0)
    plain = train.select(
        indices.alias("i"), values.alias("v"), F.col(label).cast("double").alias("y"),
        weights.cast("double").alias("w"), F.coalesce(F.unwrap_udt(features)["size"], F.size("v")).alias("size"))
    rows = checkpointed(plain.mapInArrow(_as_bytes, "i binary, v binary, y double, w double, size int")
                        ).withColumn("part", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    facts = rows.agg(F.sum("w").alias("mass"), F.max("size").alias("size"),
                     F.countDistinct("part").alias("parts")).first()
    mass, size = facts["mass"], facts["size"]
    groups = max(1, math.isqrt(facts["parts"]))
    penalty = 1.0 / (strength * mass)
    context = train.sparkSession.sparkContext

    def summed(x: np.ndarray, work: Callable) -> tuple[float, np.ndarray]:
        sent = context.broadcast(x)
        parts = rows.select("i", "v", "y", "w", F.pmod("part", F.lit(groups)).alias("g"))
        sums = parts.mapInArrow(_logistic_part(sent, work), "g int, loss double, slope array<double>")
        added = [F.sum("loss").alias("loss"), vector_to_array(Summarizer.sum(array_to_vector("slope"))).alias("slope")]
        table = sums.groupBy("g").agg(*added).agg(*added).toArrow()
        sent.unpersist()
        return table["loss"].to_numpy().sum() / mass, table["slope"].combine_chunks().flatten().to_numpy() / mass

    def evaluate(x: np.ndarray) -> tuple[float, np.ndarray]:
        loss, slope = summed(x, _gradient)
        slope[:-1] += penalty * x[:-1]
        return loss + penalty / 2 * float(x[:-1] @ x[:-1]), slope

    try:
        curvature = summed(np.zeros(size + 1), _curvature)[1]
        curvature[:-1] += penalty
        # rare terms are scaled no further, or steps for them would leave where the curvature at zero holds
        scale = np.minimum(1 / np.sqrt(np.maximum(curvature, 1e-300)), 32)
        best, slope = _minimise(evaluate, np.zeros(size + 1), iterations, tolerance, scale)
    finally:
        rows.unpersist()
    left = float(np.abs(slope).max())
    if left > tolerance:
        warnings.warn(f"the search ended with a gradient of {left:g}, over {tolerance:g}", stacklevel=2)
    return Logistic([float(c) for c in best[:-1]], float(best[-1]), left, left <= tolerance)


def _as_bytes(batches: Iterator) -> Iterator:
    """Lists of places and values as the bytes of 32-bit and 64-bit numbers, without a copy of the numbers."""
    import numpy as np
    import pyarrow as pa

    def packed(lists, kind):
        numbers = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), dtype=kind)
        ends = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer((ends * numbers.itemsize).astype(np.int32)),
                                                               pa.py_buffer(numbers)])

    for batch in batches:
        # 32-bit offsets reach two gigabytes; slices stay far below
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield pa.RecordBatch.from_arrays([packed(part.column("i"), "<i4"), packed(part.column("v"), "<f8"),
                                              *[part.column(c) for c in ("y", "w", "size")]], ["i", "v", "y", "w", "size"])


def _unpacked(column, kind: str):
    """Numbers and ends of the rows of a column of bytes."""
    import numpy as np
    import pyarrow as pa

    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, dtype="<i8" if pa.types.is_large_binary(column.type) else "<i4")[column.offset:column.offset + len(column) + 1]
    size = np.dtype(kind).itemsize
    every = np.frombuffer(data, dtype=kind, count=int(ends[-1]) // size) if data is not None and ends[-1] else np.zeros(0, dtype=kind)
    return every[ends[0] // size:], (ends - ends[0]) // size


def _gradient(x, place, value, row, y, w):
    """Loss and gradient of the rows at the coefficients ``x``, the intercept last."""
    import numpy as np

    margin = x[-1] + np.bincount(row, weights=value * x[place], minlength=len(y))
    pull = w * (1 / (1 + np.exp(-margin)) - y)
    slope = np.bincount(place, weights=value * pull[row], minlength=len(x))
    slope[-1] = pull.sum()
    return float(w @ (np.logaddexp(0, margin) - y * margin)), slope


def _curvature(x, place, value, row, y, w):
    """The diagonal of the second derivative of the rows at coefficients of zero, where every chance is a half."""
    import numpy as np

    bend = np.bincount(place, weights=value * value * w[row] / 4, minlength=len(x))
    bend[-1] = w.sum() / 4
    return 0.0, bend


def _logistic_part(sent, work: Callable):
    """Sums of ``work`` over one task's rows."""

    def part(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        x = sent.value
        slope, loss, group = np.zeros(len(x)), 0.0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column("g")[0].as_py()
            y, w = batch.column("y").to_numpy(), batch.column("w").to_numpy()
            place, ends = _unpacked(batch.column("i"), "<i4")
            value, _ = _unpacked(batch.column("v"), "<f8")
            found, more = work(x, place, value, np.repeat(np.arange(len(y)), np.diff(ends)), y, w)
            loss += found
            slope += more
        if group is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([group], pa.int32()), pa.array([loss]),
                 pa.array([slope], pa.list_(pa.float64()))], ["g", "loss", "slope"])

    return part


def _minimise(evaluate: Callable, start: np.ndarray, iterations: int, tolerance: float,
              scale: np.ndarray | float = 1.0, memory: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Limited-memory BFGS with step halving, for a smooth convex function: where it ends, and the
    gradient there. The search is for ``x / scale``; the tolerance is for the gradient of ``x``."""
    x, (value, plain) = start / scale, evaluate(start)
    slope = plain * scale
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(iterations):
        if np.abs(plain).max() <= tolerance:
            break
        direction, kept = -slope, []
        for s, y, curve in reversed(past):
            kept.append((s @ direction) / curve)
            direction = direction - kept[-1] * y
        if past:
            s, y, curve = past[-1]
            direction = direction * (curve / (y @ y))
        for (s, y, curve), a in zip(past, reversed(kept)):
            direction = direction + (a - (y @ direction) / curve) * s
        step, fall = (1.0 if past else 1.0 / max(1.0, np.linalg.norm(slope))), slope @ direction
        while True:
            there = x + step * direction
            next_value, next_plain = evaluate(there * scale)
            next_slope = next_plain * scale
            if next_value <= value + 1e-4 * step * fall or step < 1e-8:
                break
            step /= 2
        if step < 1e-8:
            break
        s, y = there - x, next_slope - slope
        if s @ y > 0:
            past = [*past[1 - memory:], (s, y, s @ y)]
        x, value, slope, plain = there, next_value, next_slope, next_plain
    return x * scale, plain


@dataclass(frozen=True)
class NaiveBayes:
    """Log prior per class, and a table ``(term, logp_0, logp_1, ...)`` in class order."""

    classes: list
    log_prior: list[float]
    table: DataFrame

    def scores(self, documents: DataFrame, key: str, terms: DataFrame, weight: str = "weight") -> DataFrame:
        """``(key, score_0, score_1, ..., predicted)`` for every document, those without any known term
        included; of equal scores the first class wins.

        The table has one row per term of whatever vocabulary it was fitted with, so whether it is
        broadcast is left to the planner, which knows its size.
        """
        names = [f"score_{i}" for i in range(len(self.classes))]
        sums = (terms.join(self.table, "term").groupBy(key)
                .agg(*[F.sum(F.col(weight) * F.col(f"logp_{i}")).alias(n) for i, n in enumerate(names)]))
        joined = documents.select(key).join(sums, key, "left").select(
            key, *[(F.coalesce(F.col(n), F.lit(0.0)) + F.lit(p)).alias(n)
                   for n, p in zip(names, self.log_prior)])
        best = F.greatest(*names) if len(names) > 1 else F.col(names[0])
        predicted: Column = F.lit(None)
        for n, c in reversed(list(zip(names, self.classes))):
            predicted = F.when(F.col(n) == best, F.lit(c)).otherwise(predicted)
        return joined.withColumn("predicted", predicted)


def fit_naive_bayes(documents: DataFrame, terms: DataFrame, label: str, weight: str = "weight",
                    alpha: float = 1.0) -> NaiveBayes:
    """Multinomial naive Bayes with additive smoothing of the term weights and plain class shares.

    ``terms`` is ``(..., label, term, weight)`` in long form, its vocabulary that of the features;
    ``documents`` has one row per document and gives the class shares.
    """
    sizes = label_sizes(documents, label)
    classes, total = list(sizes), sum(sizes.values())
    sums = checkpointed(terms.groupBy("term").agg(*[
        F.sum(F.when(F.col(label) == F.lit(c), F.col(weight)).otherwise(F.lit(0.0)).cast("double"))
        .alias(f"s_{i}") for i, c in enumerate(classes)]))
    mass = sums.agg(F.count(F.lit(1)).alias("terms"),
                    *[F.sum(f"s_{i}").alias(f"m_{i}") for i in range(len(classes))]).first()
    table = sums.select("term", *[
        F.log((F.col(f"s_{i}") + F.lit(alpha)) / F.lit(mass[f"m_{i}"] + alpha * mass["terms"]))
        .alias(f"logp_{i}") for i in range(len(classes))])
    return NaiveBayes(classes, [math.log(n / total) for n in sizes.values()], table)


@dataclass(frozen=True)
class TermMatrix:
    """Naive Bayes over sparse vectors: log prior and one array of log chances per class, by place in the vector."""

    classes: list
    log_prior: list[float]
    log_chance: list[list[float]]

    def predict(self, df: DataFrame, features: str, out: str = "predicted") -> DataFrame:
        """Add ``score_0, score_1, ...`` and the likeliest class; of equal scores the first class wins. Each class's
        array is sent along, as long as the vocabulary; a row needs no other row and nothing is shuffled."""
        names = [f"score_{k}" for k in range(len(self.classes))]
        table = df.sparkSession.createDataFrame([(self.log_chance,)], "c array<array<double>>")
        indices, values = sparse_parts(features)
        rows = df.withColumn("__c", table.scalar()).withColumn("__i", indices).withColumn("__v", values)
        for k, name in enumerate(names):
            products = F.zip_with("__i", "__v", lambda i, v: v * F.get(F.col("__c")[k], i))  # noqa: B023
            rows = rows.withColumn(name, F.aggregate(products, F.lit(self.log_prior[k]), lambda total, x: total + x))
        best = F.greatest(*names) if len(names) > 1 else F.col(names[0])
        predicted: Column = F.lit(None)
        for name, c in reversed(list(zip(names, self.classes))):
            predicted = F.when(F.col(name) == best, F.lit(c)).otherwise(predicted)
        return rows.withColumn(out, predicted).drop("__c", "__i", "__v")


def fit_term_matrix(train: DataFrame, features: str, label: str, alpha: float = 1.0) -> TermMatrix:
    """Multinomial naive Bayes as :func:`fit_naive_bayes`, from sparse vectors over a vocabulary.

    The vectors of a class are added up where they are, then once per class; the driver gets one dense vector
    per class, as long as the vocabulary. For a handful of classes, as labels of texts are.
    """
    sums = (train.groupBy(label).agg(F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.sum(F.col(features))).alias("s"))
            .orderBy(label).collect())
    total = sum(r["n"] for r in sums)
    chances = []
    for r in sums:
        weights = np.array(r["s"]) + alpha
        chances.append(np.log(weights / weights.sum()).tolist())
    return TermMatrix([r[label] for r in sums], [math.log(r["n"] / total) for r in sums], chances)


def batch_score(df: DataFrame, inputs: str | Sequence[str], make_predict: Callable, returns: T.DataType,
                out: str = "score", batch_size: int = 16,
                shapes: list[list[int]] | None = None) -> DataFrame:
    """Score rows with a model that ``make_predict`` loads once per worker and that takes arrays of
    ``batch_size`` rows."""
    udf = predict_batch_udf(make_predict, return_type=returns, batch_size=batch_size,
                            input_tensor_shapes=shapes)
    names = [inputs] if isinstance(inputs, str) else list(inputs)
    return df.withColumn(out, udf(*names))
