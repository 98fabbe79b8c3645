"""Distinct counts from bitmaps against plain sets."""

from __future__ import annotations

import random

from shoplore.operators import bitmaps


def test_counts_equal_sets(spark):
    rng = random.Random(2)
    edge = [0, 1, -1, 32767, 32768, 32769, -32768, -32769, 2**40, -2**40]
    rows = [(rng.choice("abc"), rng.randint(1, 4), rng.choice([*edge, None, rng.randint(-99999, 99999)])) for _ in range(3000)] + [("d", 1, None)]
    df = spark.createDataFrame(rows, "place string, day int, key long").repartition(5)
    days = bitmaps.key_bitmaps(df, ["place", "day"], "key")
    got = {r["place"]: r["n"] for r in bitmaps.distinct_keys(days, ["place"], "n").collect()}
    want = {p: len({k for q, _, k in rows if q == p and k is not None}) for p in "abcd"}
    assert got == want
    again = bitmaps.distinct_keys(bitmaps.merged(days, ["place"]), [], "n").first()["n"]
    assert again == len({k for _, _, k in rows if k is not None})


def test_several_keys_without_a_shuffle_of_keys(spark):
    df = spark.createDataFrame([(1, 5), (1, 6), (None, 7), (2, 7)], "a int, b long")
    counts = bitmaps.distinct_counts(df, {"as": "a", "bs": "b"})
    assert counts.first().asDict() == {"as": 2, "bs": 3}
    assert "Expand" not in counts._jdf.queryExecution().executedPlan().toString()
    assert bitmaps.distinct_counts(df.limit(0), {"as": "a"}).first().asDict() == {"as": 0}
