"""Work that depends on the order of a whole table, without putting the table in one task.

Rows are range-partitioned on the full sort order (ties included, so a value that fills a third of
the table is spread over several partitions), sorted inside each partition and checkpointed. What one
partition passes on to the next is then a single number, so the parts combine through one row per
partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplore.session import checkpointed

_LOW_33_BITS = (1 << 33) - 1


def _sorted_parts(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Globally sorted and checkpointed rows with their partition and place in it."""
    parts = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order))
    return parts.select(
        "*", F.spark_partition_id().alias("__part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_33_BITS)).alias("__index"))


def _offsets(per_part: DataFrame, amount: str) -> DataFrame:
    """Sum of ``amount`` over all earlier partitions; one row per partition, hence small."""
    order = Window.orderBy("__part")
    return per_part.select("__part", (F.sum(amount).over(order) - F.col(amount)).alias("__before"))


def with_row_number(df: DataFrame, order: Sequence[str | Column], out: str = "row_number") -> DataFrame:
    """Number the rows 1, 2, ... in ``order``, which must not leave ties."""
    parts = _sorted_parts(df, order)
    counts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    offsets = F.broadcast(_offsets(counts, "__n"))
    return (parts.join(offsets, "__part")
            .withColumn(out, F.col("__before") + F.col("__index") + 1)
            .drop("__part", "__index", "__before"))


def _rank_map(df: DataFrame, value: str, descending: bool, out: str) -> DataFrame:
    """``(value, rank)``: a value's rank is one more than the rows that come before it."""
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    parts = _sorted_parts(counts, [order])
    sums = parts.groupBy("__part").agg(F.sum("__n").alias("__n"))
    offsets = F.broadcast(_offsets(sums, "__n"))
    inside = Window.partitionBy("__part").orderBy("__index")
    return (parts.withColumn("__run", F.sum("__n").over(inside) - F.col("__n"))
            .join(offsets, "__part")
            .select(F.col(value).alias("__value"), (F.col("__before") + F.col("__run") + 1).alias(out)))


def with_ranks(df: DataFrame, ranks: Mapping[str, tuple[str, bool]]) -> DataFrame:
    """Add ``rank()`` columns over the whole table: ``{out: (column, descending)}``.

    Every column is ranked through its distinct values, range-partitioned, however many rows there
    are. The input is read once for each rank and once for the result, so it is checkpointed.
    """
    result = base = checkpointed(df)
    for out, (column, descending) in ranks.items():
        places = _rank_map(base, column, descending, out)
        result = (result.join(places, F.col(column).eqNullSafe(F.col("__value")), "inner")
                  .drop("__value"))
    return result


def exact_quantiles(df: DataFrame, columns: Sequence[str],
                    probabilities: Sequence[float]) -> dict[str, list[float]]:
    """Exact quantiles with linear interpolation, for all columns together; missing values are skipped.

    Equal values are counted together before the shuffle, then the distinct values are
    range-partitioned. Totals per partition tell which partitions hold the wanted places, and only
    those are searched. The driver sees one number per partition and column, and the answers.
    """
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    counts = (numbers.unpivot([], list(columns), "__name", "__value")
              .filter(F.col("__value").isNotNull())
              .groupBy("__name", "__value").agg(F.count(F.lit(1)).alias("__n")))
    parts = _sorted_parts(counts, ["__name", "__value"])
    sums = (parts.groupBy("__name", "__part").agg(F.sum("__n").alias("n"))
            .orderBy("__name", "__part").collect())

    totals = {c: sum(s["n"] for s in sums if s["__name"] == c) for c in columns}
    places = {}
    for c in columns:
        if totals[c] == 0:
            raise ValueError(f"{c} has no values")
        for p in probabilities:
            at = (totals[c] - 1) * p
            low = int(at)
            places[c, p] = (low, min(low + 1, totals[c] - 1), at - low)

    wanted = {(c, i) for (c, _), (low, high, _) in places.items() for i in (low, high)}
    located = {}
    for c, i in wanted:
        before = 0
        for s in (s for s in sums if s["__name"] == c):
            if i < before + s["n"]:
                located[c, i] = (s["__part"], i - before)
                break
            before += s["n"]

    inside = Window.partitionBy("__name", "__part").orderBy("__index")
    searched = (parts.filter(F.col("__part").isin(sorted({part for part, _ in located.values()})))
                .withColumn("__run", F.sum("__n").over(inside)))
    keys = list(located)
    found = searched.agg(*[
        F.max(F.when((F.col("__name") == c) & (F.col("__part") == located[c, i][0])
                     & (F.col("__run") > located[c, i][1])
                     & (F.col("__run") - F.col("__n") <= located[c, i][1]),
                     F.col("__value"))).alias(f"v{k}")
        for k, (c, i) in enumerate(keys)]).first()
    value = {key: found[f"v{k}"] for k, key in enumerate(keys)}

    def interpolate(c: str, p: float) -> float:
        low, high, share = places[c, p]
        return value[c, low] + (value[c, high] - value[c, low]) * share

    return {c: [interpolate(c, p) for p in probabilities] for c in columns}


def quantile_bin(column: str, edges: Sequence[float], labels: Sequence[int]) -> Column:
    """Label of the bin a value falls in; bins are closed on the right and the lowest value counts.

    ``edges`` are the quantiles at 0, 1/q, ..., 1; equal neighbours make a bin empty and are refused.
    """
    if len(set(edges)) != len(edges):
        raise ValueError(f"quantile edges of {column} are not unique: {list(edges)}")
    value = F.col(column).cast("double")
    label = F.when(value <= F.lit(edges[1]), labels[0])
    for edge, name in zip(edges[2:-1], labels[1:-1]):
        label = label.when(value <= F.lit(edge), name)
    return label.when(value.isNotNull(), labels[-1]).cast("int")


def place_bin(place: Column, total: int, labels: Sequence[int]) -> Column:
    """Quantile bin of the row numbered ``place`` among ``total`` distinct places.

    The q-quantile edges of 1..n are 1 + (n - 1)j/q, so the bin follows from the place alone.
    """
    if total < 2:
        raise ValueError("quantile bins need at least two rows")
    number = F.greatest(F.lit(1), F.ceil(((place - 1) * len(labels)) / F.lit(total - 1)))
    return F.element_at(F.array(*[F.lit(x) for x in labels]), number.cast("int")).cast("int")


def ewma_by_key(df: DataFrame, key: str, order: Sequence[str], value: str,
                decay: float = 0.95, out: str = "ewma") -> DataFrame:
    """Exponentially weighted mean per key, started with the key's first value:
    ``mean = decay * mean + (1 - decay) * value``.

    A key of any length is cut where partitions end. A first pass works out, for the last key of each
    partition, what its rows do to the mean handed to them; the driver chains those (one per
    partition), and a second pass starts each partition from the mean it inherits. Rows without a
    value keep the mean before them. ``order`` must not leave ties.
    """
    numbers = df.select("*", F.col(value).cast("double").alias("__x"))
    parts = checkpointed(
        numbers.repartitionByRange(key, *order).sortWithinPartitions(key, *order))
    kind = numbers.schema[key].dataType
    tagged = parts.select("*", F.spark_partition_id().alias("__part"))

    # per partition: its first and last key, and for the last one the number of values and the mean
    # of those values when it starts from zero and when it starts from the first of them
    summary = tagged.select("__part", F.col(key).alias("__key"), "__x").mapInArrow(
        _tail_summary(decay), T.StructType([
            T.StructField("part", T.IntegerType()), T.StructField("first", kind),
            T.StructField("last", kind), T.StructField("n", T.LongType()),
            T.StructField("from_zero", T.DoubleType()), T.StructField("seeded", T.DoubleType())]))
    inherited, mean, running_key = {}, None, None
    for s in sorted(summary.collect(), key=lambda s: s["part"]):
        if mean is not None and s["first"] == running_key:
            inherited[s["part"]] = mean
        if s["first"] == s["last"] and s["part"] in inherited:
            mean = mean * decay ** s["n"] + s["from_zero"]
        else:
            mean = s["seeded"]
        running_key = s["last"]

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
    return tagged.mapInArrow(_running_mean(key, decay, inherited), schema)


# The two functions below are nested so that they travel to the workers by value.


def _tail_summary(decay: float):
    def summarise(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        part = first = last = None
        n, from_zero, seeded = 0, 0.0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, x = batch.column("__key"), batch.column("__x").to_numpy(zero_copy_only=False)
            if part is None:
                part, first = batch.column("__part")[0].as_py(), keys[0]
                last = keys[0]
            codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
            if keys[len(keys) - 1].as_py() != last.as_py():
                last, n, from_zero, seeded = keys[len(keys) - 1], 0, 0.0, None
            x = x[codes == codes[-1]]
            x = x[~np.isnan(x)]
            if len(x):
                added = float(((1 - decay) * decay ** np.arange(len(x) - 1, -1, -1)) @ x)
                shrink = decay ** len(x)
                seeded = float(x[0] if seeded is None else seeded) * shrink + added
                from_zero = from_zero * shrink + added
                n += len(x)
        if part is not None:
            kind = first.type
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([first.as_py()], kind),
                 pa.array([last.as_py()], kind), pa.array([n], pa.int64()),
                 pa.array([from_zero], pa.float64()), pa.array([seeded], pa.float64())],
                ["part", "first", "last", "n", "from_zero", "seeded"])

    return summarise


def _running_mean(key: str, decay: float, inherited: dict):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        carried, carried_key, begun = None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, x = batch.column(key), batch.column("__x").to_numpy(zero_copy_only=False)
            if not begun:
                carried = inherited.get(batch.column("__part")[0].as_py())
                carried_key, begun = keys[0].as_py(), True
            codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
            runs = np.concatenate([[0], np.cumsum(codes[1:] != codes[:-1])])
            lead = carried is not None and keys[0].as_py() == carried_key
            if lead:
                runs, x = np.concatenate([[0], runs]), np.concatenate([[carried], x])
            means = (pd.Series(x).groupby(runs).ewm(alpha=1 - decay, adjust=False, ignore_na=True)
                     .mean().to_numpy())
            carried_key = keys[len(keys) - 1].as_py()
            carried = None if np.isnan(means[-1]) else float(means[-1])
            kept = batch.columns[:-2]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(means[1:] if lead else means, from_pandas=True)],
                [str(i) for i in range(len(kept) + 1)])

    return run
