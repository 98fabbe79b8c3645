"""Comparing predictions with labels. The split is whatever rows are passed in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def _f1(precision: Column, recall: Column) -> Column:
    return _ratio(2 * precision * recall, precision + recall)


def binary_metrics(df: DataFrame, actual: str, predicted: str, positive=1) -> DataFrame:
    """One row of accuracy, precision, recall and f1; a ratio over nothing is 0.

    Every row with an actual label counts. A missing prediction is wrong whatever the label: it is one
    of the other class where the label is positive, and of the positive class where it is not.
    """
    truth = F.col(actual) == F.lit(positive)
    guess = F.coalesce(F.col(predicted) == F.lit(positive), ~truth)

    def count(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0))

    cells = df.agg(
        count(truth & guess).alias("tp"), count(~truth & guess).alias("fp"),
        count(truth & ~guess).alias("fn"), count(~truth & ~guess).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (cells.select(_ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
                         _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"))
            .withColumn("f1", _f1(F.col("precision"), F.col("recall"))))


def classification_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """``(class, precision, recall, f1, support)`` per class, then ``accuracy`` (in f1 alone),
    ``macro avg`` and ``weighted avg``.

    The rows are counted once per pair of labels; the rest works on those counts.
    """
    pairs = (df.groupBy(F.col(actual).cast("string").alias("__actual"),
                        F.col(predicted).cast("string").alias("__predicted"))
             .agg(F.count(F.lit(1)).alias("__n")))
    right = F.when(F.col("__actual") == F.col("__predicted"), F.col("__n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("__actual").alias("class"), F.col("__n").alias("support"),
                 F.lit(0).cast("long").alias("guessed"), right.cast("long").alias("tp")),
        F.struct(F.col("__predicted").alias("class"), F.lit(0).cast("long").alias("support"),
                 F.col("__n").alias("guessed"), F.lit(0).cast("long").alias("tp")))
    counts = (pairs.select(F.explode(sides).alias("e")).select("e.*").groupBy("class")
              .agg(F.sum("support").alias("support"), F.sum("guessed").alias("guessed"),
                   F.sum("tp").alias("tp")))
    classes = counts.select(
        "class", _ratio(F.col("tp"), F.col("guessed")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"), "support", "tp")
    classes = classes.withColumn("f1", _f1(F.col("precision"), F.col("recall")))
    scores = ("precision", "recall", "f1")
    total = F.sum("support")
    averages = classes.agg(
        F.sum("tp").alias("tp"), total.alias("support"),
        *[F.avg(s).alias(f"macro_{s}") for s in scores],
        *[_ratio(F.sum(F.col(s) * F.col("support")), total).alias(f"weighted_{s}") for s in scores])
    nothing = F.lit(None).cast("double")

    def row(name: str, *values: Column) -> Column:
        fields = [v.alias(s) for s, v in zip(scores, values)]
        return F.struct(F.lit(name).alias("class"), *fields, F.col("support"))

    summary = averages.select(F.explode(F.array(
        row("accuracy", nothing, nothing, _ratio(F.col("tp"), F.col("support"))),
        row("macro avg", *[F.col(f"macro_{s}") for s in scores]),
        row("weighted avg", *[F.col(f"weighted_{s}") for s in scores]))).alias("e")).select("e.*")
    return classes.select("class", *scores, "support").unionByName(summary)


def confusion_matrix(df: DataFrame, actual: str, predicted: str, labels: Sequence = (0, 1)) -> DataFrame:
    """One row per actual label, one column ``predicted_<label>`` per predicted one, 0 where absent.

    Labels outside the list, and missing ones, are counted too: in a column ``predicted_other``, and in a
    last row whose ``actual`` is null where there are such rows. So the cells add up to the rows.
    """
    named = F.when(F.col(actual).isin(list(labels)), F.col(actual))
    hits = {f"predicted_{p}": F.coalesce(F.col(predicted) == F.lit(p), F.lit(False)) for p in labels}
    hits["predicted_other"] = ~F.coalesce(F.col(predicted).isin(list(labels)), F.lit(False))
    cells = df.groupBy(named.alias("actual")).agg(*[F.count_if(hit).alias(name) for name, hit in hits.items()])
    kind = df.schema[actual].dataType.simpleString()
    rows = df.sparkSession.createDataFrame([(a,) for a in labels], f"actual {kind}")
    known = rows.join(cells, "actual", "left")
    return known.unionByName(cells.filter("actual IS NULL")).select(
        "actual", *[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in hits])
