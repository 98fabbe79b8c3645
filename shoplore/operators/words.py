"""Word counts and stems."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplore.functions.text import words


def token_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, word, n)``. A text's words meet in one task before the shuffle, so each of its distinct
    words is sent once."""
    return (df.select(key, F.explode(words(text)).alias("word"))
            .groupBy(key, "word").agg(F.count(F.lit(1)).alias("n")))


def default_stop_words(language: str = "portuguese") -> list[str]:
    return StopWordsRemover.loadDefaultStopWords(language)


def drop_stop_words(tokens: str | Column, stop_words: Sequence[str]) -> Column:
    """An array of words without the stop words, repeats kept."""
    stops = F.array(*[F.lit(w.lower()) for w in stop_words])
    return F.filter(tokens, lambda word: ~F.array_contains(stops, word))


def word_counts(df: DataFrame, text: str, stop_words: Sequence[str] = (), keep_numbers: bool = True,
                fold_plurals: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, word, n)`` over all texts, or over each subset that the columns ``by`` mark.

    Stop words, a list in the program, leave the counted vocabulary rather than the running text.
    ``fold_plurals`` adds a word in ``s`` to the same word without it where that one occurs too.
    """
    groups = list(by)
    counts = (df.select(*groups, F.explode(words(text)).alias("word"))
              .groupBy(*groups, "word").agg(F.count(F.lit(1)).alias("n")))
    if stop_words:
        stops = df.sparkSession.createDataFrame([(w.lower(),) for w in stop_words], "word string")
        counts = counts.join(F.broadcast(stops), "word", "left_anti").select(*groups, "word", "n")
    if not keep_numbers:
        counts = counts.filter(~F.col("word").rlike(r"^\p{Nd}+$"))
    if fold_plurals:
        plural = F.col("word").endswith("s") & ~F.col("word").endswith("ss")
        singular = F.when(plural, F.expr("substring(word, 1, length(word) - 1)"))
        known = counts.select(*[F.col(g).alias(f"__{g}") for g in groups], F.col("word").alias("__known"))
        same = F.col("__singular") == F.col("__known")
        for g in groups:
            same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
        counts = (counts.withColumn("__singular", singular).join(known, same, "left")
                  .groupBy(*groups, F.coalesce("__known", "word").alias("word"))
                  .agg(F.sum("n").alias("n")))
    return counts


def with_relative_frequency(counts: DataFrame) -> DataFrame:
    """Add each count divided by the largest count."""
    largest = counts.agg(F.max("n")).scalar()
    return counts.withColumn("relative", F.col("n") / largest)


def top_words(counts: DataFrame, k: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """The ``k`` most frequent words, per subset ``by``, with count and frequency relative to the first
    of them; ties in word order. Each task cuts its words to ``k`` before they meet."""
    order = [F.col("n").desc(), F.col("word")]
    if by:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        top = counts.withColumn("__place", place).filter(F.col("__place") <= k).drop("__place")
    else:
        top = counts.orderBy(*order).limit(k)
    most = F.max("n").over(Window.partitionBy(*(by or [F.lit(0)])))
    return top.withColumn("relative", F.col("n") / most)


def subset_word_counts(df: DataFrame, text: str, subsets: Mapping[str, Column],
                       tokens: Callable[[str], Column] = words) -> DataFrame:
    """``(word, <subset>, ...)``: how often a word occurs in each of the subsets, which may overlap.

    A text's membership travels with its words as one bit mask, so every word crosses the network once, however many
    subsets its text is in. Texts in none are left out; an unknown condition is no membership.
    """
    if len(subsets) > 63:
        raise ValueError("at most 63 subsets at a time")
    mask = sum((F.when(condition, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, condition in enumerate(subsets.values())),
               F.lit(0).cast("long"))
    rows = df.select(tokens(text).alias("w"), mask.alias("m")).filter("m <> 0").select(F.explode("w").alias("word"), "m")
    return rows.groupBy("word").agg(*[F.sum(F.shiftright("m", i).bitwiseAND(F.lit(1))).cast("long").alias(name)
                                      for i, name in enumerate(subsets)])


def top_words_of_subsets(counts: DataFrame, subsets: Sequence[str], k: int = 20) -> DataFrame:
    """``(subset, word, n, relative)``: the ``k`` most frequent words of each subset, see :func:`top_words`."""
    long = counts.unpivot(["word"], list(subsets), "subset", "n").filter("n > 0")
    return top_words(long.select("subset", "word", "n"), k, by=["subset"])


@dataclass(frozen=True)
class Suffix:
    """A word that ends with ``suffix`` gets ``replacement`` instead, if at least ``least`` characters stay before it."""

    step: int
    suffix: str
    replacement: str = ""
    least: int = 0


def stem_by_rules(word: str | Column, rules: Sequence[Suffix]) -> Column:
    """Stem a word by steps in ascending order; in each the longest suffix that fits is replaced, and a word that
    none fits stays as it is. Plain column expressions."""
    stem = F.col(word) if isinstance(word, str) else word
    for step in sorted({r.step for r in rules}):
        fitting = sorted((r for r in rules if r.step == step), key=lambda r: (-len(r.suffix), r.suffix))
        changed = stem
        for r in reversed(fitting):
            stays = F.char_length(stem) - len(r.suffix)
            changed = F.when(F.endswith(stem, F.lit(r.suffix)) & (stays >= r.least),
                             F.concat(F.substring(stem, F.lit(1), stays), F.lit(r.replacement))).otherwise(changed)
        stem = changed
    return stem


def stems_of(stemmer: Callable[[str], str]) -> Callable[[str | Column], Column]:
    """A column function for one word per row, meant for a counted vocabulary."""

    @F.pandas_udf("string")
    def stem(batch: pd.Series) -> pd.Series:
        return batch.map(stemmer, na_action="ignore")

    return stem


def stem_arrays(stemmer: Callable[[str], str], remembered: int = 200_000) -> Callable[[str | Column], Column]:
    """A column function for arrays of words: stems stay with their text, so nothing is shuffled.
    Each worker remembers the stems of that many words."""

    @F.pandas_udf("array<string>")
    def stem(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from functools import lru_cache

        known = lru_cache(maxsize=remembered)(stemmer)
        for batch in batches:
            yield batch.map(lambda tokens: [known(t) for t in tokens], na_action="ignore")

    return stem


def stem_vocabulary(counts: DataFrame, stemmer: Callable[[str], str] | Sequence[Suffix]) -> DataFrame:
    """``(stem, words, n)``: each distinct word is stemmed once, by suffix rules or by a function of the user."""
    stem = stems_of(stemmer)("word") if callable(stemmer) else stem_by_rules("word", stemmer)
    return (counts.withColumn("stem", stem)
            .groupBy("stem").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")))
