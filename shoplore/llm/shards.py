"""A uniform shuffle into shards of exact size, through a hypergeometric communication matrix.

Rows are permuted inside their partitions. How many rows of each partition go to each shard is drawn
exactly as a uniform shuffle of all rows would have it (multivariate hypergeometric, partition by
partition). The rows are exchanged accordingly and permuted again inside their shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplore.llm.common import fresh
from shoplore.operators.ordered import with_row_number
from shoplore.session import checkpointed

#: The matrix is broadcast up to this size; a larger one is joined by shuffling.
BROADCAST_BYTES = 8 << 20
_LOW_33_BITS = (1 << 33) - 1


def hypergeometric(rng, good: int, bad: int, draws: int) -> int:
    """Number of good ones among ``draws`` without replacement, for numbers of any size.

    The probabilities around the mode follow from exact ratios of neighbours; 14 deviations to both
    sides leave out less than double precision can hold.
    """
    import numpy as np

    total = good + bad
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    spread = (draws * (good / total) * (bad / total) * ((total - draws) / max(1, total - 1))) ** 0.5
    reach = int(14 * spread) + 20
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    rising = np.cumprod((good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1)))
    falling = np.cumprod(down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1)))
    weights = np.concatenate([falling[::-1], [1.0], rising])
    place = np.searchsorted(np.cumsum(weights), rng.random() * weights.sum(), side="right")
    return mode - len(falling) + min(int(place), len(weights) - 1)


def communication_matrix(rows: Sequence[int], capacities: Sequence[int], seed: int) -> list[list[int]]:
    """Counts from each partition to each shard; rows and columns add up exactly."""
    import numpy as np

    rng, left = np.random.default_rng(seed), list(capacities)
    if sum(rows) != sum(left):
        raise ValueError("shards do not hold as many rows as there are")
    matrix = []
    for n in rows:
        total, line = sum(left), []
        for s, room in enumerate(left):
            drawn = hypergeometric(rng, room, total - room, n)
            total, n = total - room, n - drawn
            line.append(drawn)
            left[s] = room - drawn
        matrix.append(line)
    return matrix


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Counts that are at most one apart."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def shuffle_into_shards(df: DataFrame, shards: int = 16, seed: int = 42, shard: str = "shard",
                        slot: str = "slot") -> DataFrame:
    """All rows of ``df`` with their shard and their place in it, gapless from 0.

    Every row is placed, whatever it holds: nulls, empty texts and repeated rows are rows like any
    other. If a column is already called like one of the new ones, the new one gets an underscore. An
    empty table gives an empty table. The order is drawn anew from ``seed``; it repeats for the same
    input files and partitions.

    The driver sees one row per partition and the matrix, ``shards`` numbers per partition. Rows
    cross the network once, range-partitioned by shard and a random number, so a shard may be larger
    than a task. Both permutations are checkpointed: a task that runs again finds the same rows.
    """
    shard, slot = fresh(df.columns, shard, slot)
    spark = df.sparkSession
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    local = checkpointed(packed.withColumn("r", F.rand(seed)).sortWithinPartitions("r").drop("r"))
    local = local.select("row", F.spark_partition_id().alias("part"),
                         F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_33_BITS)).alias("place"))
    counts = {r["part"]: r["count"] for r in local.groupBy("part").count().collect()}
    parts = sorted(counts)
    sizes = shard_sizes(sum(counts.values()), shards)
    matrix = communication_matrix([counts[p] for p in parts], sizes, seed)
    ends = []
    for line in matrix:
        total, own = 0, []
        for n in line:
            total += n
            own.append(total)
        ends.append(own)
    plan = spark.createDataFrame(list(zip(parts, ends)), T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("ends", T.ArrayType(T.LongType()))]))
    if 8 * shards * len(parts) <= BROADCAST_BYTES:
        plan = F.broadcast(plan)
    dealt = local.join(plan, "part").select(
        "row", F.size(F.filter("ends", lambda end: end <= F.col("place"))).alias("shard"))
    ordered = with_row_number(dealt.withColumn("r", F.rand(seed + 1)), ["shard", "r"], out="number")
    starts = F.array(*[F.lit(sum(sizes[:s])).cast("long") for s in range(shards)])
    return ordered.select(
        *[F.col("row")[c].alias(c) for c in df.columns], F.col("shard").alias(shard),
        (F.col("number") - 1 - F.element_at(starts, F.col("shard") + 1)).cast("long").alias(slot))
