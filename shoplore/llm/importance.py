"""Rows drawn from a corpus so that their words resemble a target's.

Words are hashed into buckets, and the log ratio of a bucket's share in the target to its share in the corpus
is its gain. A document's weight is the sum of the gains of its features; with Gumbel noise added, the
highest scores are a draw without replacement in proportion to the exponent of the weights. The number of
draws is known, so the last one drawn is found by quickselect over the whole table: pivots from random rows,
an exact three-way count around all of them in one pass, then the interval that holds the wanted place.
Only the rows drawn are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplore.llm.common import fresh, in_arrow, per_text, pieces
from shoplore.llm.licenses import word_list
from shoplore.operators.ordered import with_row_number
from shoplore.session import checkpointed

_MOST_WORDS = 500_000


@dataclass(frozen=True)
class Draw:
    """buckets: of the hashed features. longest: words in the longest run that is a feature. least_words: of a
    document that can be drawn. percent: of those that are drawn. seed: of the noise. pivots: tried at a time."""

    buckets: int = 10_000
    longest: int = 1
    least_words: int = 20
    percent: int = 10
    seed: int = 2024
    pivots: int = 16


def features(words: list[bytes], longest: int) -> Iterator[bytes]:
    """Runs of 1 to ``longest`` words, joined by blanks."""
    yield from words
    for n in range(2, longest + 1):
        yield from map(b" ".join, zip(*[words[k:] for k in range(n)]))


def bucket_counts(df: DataFrame, text: str = "text", rules: Draw = Draw()) -> list[int]:
    """How many features of all the texts fall into each bucket.

    A task counts words and hands on one number per bucket it met; the driver gets one per bucket.
    """
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        totals, held = np.zeros(rules.buckets, dtype=np.int64), Counter()

        def settle():
            for word, n in held.items():
                totals[zlib.crc32(word) % rules.buckets] += n
            held.clear()

        for batch in batches:
            for part in pieces(batch):
                for body in part.column("text").to_pylist():
                    held.update(features(word_list(body), rules.longest))
                    if len(held) > _MOST_WORDS:
                        settle()
        settle()
        met = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(totals[met])], ["bucket", "n"])

    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])
    found = in_arrow(df.select(F.col(f"`{text}`").cast("string").alias("text")), run, schema)
    counts = [0] * rules.buckets
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    return counts


def gains(corpus: Sequence[int], target: Sequence[int]) -> list[int]:
    """Thousandths of the log of a bucket's share in the target over its share in the corpus, one added to
    every bucket, rounded down."""
    buckets, all_s, all_t = len(corpus), sum(corpus), sum(target)
    return [math.floor(1000 * math.log(float(t + 1) * (all_s + buckets) / (float(s + 1) * (all_t + buckets))))
            for s, t in zip(corpus, target)]


def importance_scores(df: DataFrame, gain: Sequence[int], key: str = "doc_id", text: str = "text",
                      rules: Draw = Draw()) -> DataFrame:
    """``key``, ``n_words``, ``n_features``, ``weight`` and ``score`` (weight plus noise), all long. No shuffle.

    Each text is an array of bucket counts times the array of gains. The noise of a row comes from the seed
    and its key alone; a null key counts as an empty one.
    """
    def make():
        def work(texts):
            rows = []
            for text in texts:
                words = word_list(text)
                counted = Counter(features(words, rules.longest))
                rows.append((len(words), sum(counted.values()),
                             sum(gain[zlib.crc32(f) % rules.buckets] * n for f, n in counted.items())))
            return list(zip(*rows)) if rows else [[], [], []]

        return work

    fields = [T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight")]
    named = F.concat(F.lit(f"{rules.seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    return per_text(df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias(text)), key, text, fields, make
                    ).withColumn("score", F.col("weight") + noise)


def kth(df: DataFrame, order: Sequence[str], percent: int, pivots: int = 16) -> Row | None:
    """The last row of the first ``percent`` in a hundred rows, rounded down, of the ascending ``order``, in
    which no two rows may be equal; None if that is no row.

    Every round is one pass: it counts the rows before, at and after each pivot and picks, for every interval,
    the row with the smallest hash of each of ``pivots`` slots. The interval that holds the place goes on
    with its own picks as pivots, so about ``log(rows) / log(pivots)`` rounds are needed. The driver gets at
    most ``2 * pivots ** 2 + pivots`` rows a round. ``df`` is read once a round, so it should be stored.
    """
    fields = [df.schema[c] for c in order]
    point = F.struct(*order)

    def literal(row: Row) -> Column:
        return F.struct(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in fields])

    low = high = None
    tried: list[Row] = []
    wanted, turn = 0, 0
    while True:
        rows = df.select(point.alias("point"))
        if low is not None:
            rows = rows.filter(F.col("point") > literal(low))
        if high is not None:
            rows = rows.filter(F.col("point") < literal(high))
        code = F.lit(0)
        for p in tried:
            code = code + F.when(F.col("point") > literal(p), 2).when(F.col("point") == literal(p), 1).otherwise(0)
        mixed = F.xxhash64(F.lit(turn), "point")
        found = (rows.select("point", code.alias("code"), mixed.alias("mixed"))
                 .groupBy("code", F.pmod("mixed", F.lit(pivots)).alias("slot"))
                 .agg(F.count(F.lit(1)).alias("n"), F.min_by("point", "mixed").alias("pick")).collect())
        if turn == 0:
            wanted = sum(r["n"] for r in found) * percent // 100
            if not wanted:
                return None
        counts = Counter()
        for r in found:
            counts[r["code"]] += r["n"]
        for c in sorted(counts):
            if wanted <= counts[c]:
                break
            wanted -= counts[c]
        if c % 2:
            return tried[c // 2]
        low, high = (tried[c // 2 - 1] if c else low), (tried[c // 2] if c // 2 < len(tried) else high)
        # null fields come first, as in Spark's order of structs
        tried = sorted((r["pick"] for r in found if r["code"] == c),
                       key=lambda row: [(v is not None, v) for v in row])
        turn += 1


def importance_draw(df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text",
                    target_text: str = "text", rules: Draw = Draw()) -> DataFrame:
    """``key``, ``n_features``, ``weight``, ``score`` and ``rank`` (long) of every row: 1, 2, 3, ... by descending
    score for the rows drawn, null for the others.

    Words are runs of digits, letters and whatever is not ASCII, A-Z in lower case; null and empty texts have
    none and weigh 0. Of the rows with at least ``least_words`` words, ``percent`` in a hundred are drawn, rounded
    down; equal scores go by the smaller key, null keys last, repeated rows by their place in the input. An
    empty corpus gives no rows; an empty target gives weights all the same. Only the key and the texts are read,
    twice: for the counts and for the scores, which are then stored.
    """
    gain = gains(bucket_counts(df, text, rules), bucket_counts(target, target_text, rules))
    no_key, down, row = fresh([key, "n_words", "n_features", "weight", "score", "rank"], "no_key", "down", "row")
    scored = checkpointed(importance_scores(df, gain, key, text, rules).withColumns({
        down: -F.col("score"), no_key: F.col(key).isNull(), row: F.monotonically_increasing_id()}))
    order = [down, no_key, key, row]
    able = F.col("n_words") >= rules.least_words
    last = kth(scored.filter(able), order, rules.percent, rules.pivots)
    result = [key, "n_features", "weight", "score"]
    if last is None:
        return scored.select(*result, F.lit(None).cast("long").alias("rank"))
    edge = F.struct(*[F.lit(last[c]).cast(scored.schema[c].dataType).alias(c) for c in order])
    drawn = able & (F.struct(*order) <= edge)
    ranked = with_row_number(scored.filter(drawn), order, "rank").select(*result, F.col("rank").cast("long").alias("rank"))
    return ranked.unionByName(scored.filter(~drawn).select(*result, F.lit(None).cast("long").alias("rank")))
