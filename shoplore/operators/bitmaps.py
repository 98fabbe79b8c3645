"""Exact distinct counts of integer keys from bitmaps that can be stored and merged.

A bitmap holds 32,768 consecutive keys in 4 KB, however few of them occur, so bitmaps are for dense keys: a group costs
4 KB for each stretch of keys it touches. Tasks build bitmaps before the shuffle, which then moves bitmaps, not keys.

A bitmap of hashes is for any keys and never over 8 MB; it rules out most rows whose key is not among some others.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplore.functions.columns import fresh


def key_bitmaps(df: DataFrame, groups: Sequence[str | Column], key: str | Column) -> DataFrame:
    """``(groups, bucket, bits)``: which keys occur in each group. Null keys leave an empty bitmap in their group."""
    column = F.col(key) if isinstance(key, str) else key
    number = column.cast("long")
    return df.groupBy(*groups, F.bitmap_bucket_number(number).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))


def merged(bitmaps: DataFrame, groups: Sequence[str | Column]) -> DataFrame:
    """Bitmaps of wider groups: days become months, cities become states."""
    return bitmaps.groupBy(*groups, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def distinct_keys(bitmaps: DataFrame, groups: Sequence[str | Column], out: str) -> DataFrame:
    """``(groups, out)``: how many different keys each group has. Keys in several of the given bitmaps count once."""
    together = merged(bitmaps, groups)
    names = [c for c in together.columns if c not in ("bucket", "bits")]
    return together.groupBy(*names).agg(F.sum(F.bitmap_count("bits")).cast("long").alias(out))


def distinct_counts(df: DataFrame, counts: Mapping[str, str]) -> DataFrame:
    """One row of ``{out: key}`` distinct counts, read in one pass."""
    keys = F.explode(F.array(*[F.struct(F.lit(out).alias("out"), F.col(c).cast("long").alias("key")) for out, c in counts.items()]))
    pairs = df.select(keys.alias("pair")).select("pair.out", "pair.key")
    found = distinct_keys(key_bitmaps(pairs, ["out"], "key"), ["out"], "n")
    return found.agg(*[F.coalesce(F.max(F.when(F.col("out") == out, F.col("n"))), F.lit(0)).alias(out) for out in counts])


#: Bits of a bitmap of hashes: 8 MB, whatever the number of hashes.
_MAP_BITS, _ROW_BITS = 26, 15


def bitmap_of(hashes: DataFrame) -> DataFrame:
    """``(bucket, bits)``: which places the only column of ``hashes`` (long) falls on, in at most 2,048 rows
    of 4 KB. The more hashes, the more places are set by chance; then it rules out less."""
    place = F.pmod("hash", F.lit(1 << _MAP_BITS))
    return (hashes.toDF("hash").select(place.alias("p")).groupBy(F.shiftright("p", _ROW_BITS).cast("int").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).alias("bits")))


def split_by(df: DataFrame, column: str, bitmap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose hash in ``column`` is marked in the bitmap, and those it rules out; ``df`` is read for
    each of them, without a shuffle. The bitmap is broadcast, 8 MB at most."""
    place = F.pmod(F.col(column), F.lit(1 << _MAP_BITS))
    inside = place.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    bucket, bits = fresh(df.columns, "map_bucket", "map_bits")
    rows = df.join(F.broadcast(bitmap.select(F.col("bucket").alias(bucket), F.col("bits").alias(bits))),
                   F.shiftright(place, _ROW_BITS).cast("int") == F.col(bucket), "left")
    byte = F.conv(F.hex(F.call_function("substring", F.col(bits), (F.shiftright(inside, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.call_function("shiftright", byte, inside.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return rows.filter(is_set).drop(bucket, bits), rows.filter(~is_set).drop(bucket, bits)
