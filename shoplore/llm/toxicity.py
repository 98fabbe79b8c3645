"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

The features are densities of lexicon terms, how near the terms stand to a second person, capitals,
punctuation and obfuscation rates. The lexicon is learned from labelled texts: terms, or beginnings of
words, that occur far more often in toxic ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplore.llm.common import bitmap_of, fold, fresh, in_arrow, per_text, pieces, split_by
from shoplore.session import checkpointed

FEATURES = (
    "log_words", "term_hits", "term_kinds", "term_density", "term_weight", "hidden_hits", "obfuscated",
    "second_person", "near_second_person", "capitals", "shouted_words", "exclaims", "punctuation")

# Words for a second person, and characters that stand for letters.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer sie ihnen tu te toi ton ta tes vous "
    "votre vos ti tú tus usted ustedes vos vosotros".split())
LEET = str.maketrans("0134578@$!|", "oieastbasii")

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[^\W\d_][^\w\s]+[^\W\d_]|[^\W\d_][0-9@$!|*]+[^\W\d_]|(.)\1\1")
_RUN = re.compile(r"(.)\1+")
_NOT_LETTER = re.compile(r"[\W\d_]+")
_SPACED = re.compile(r"(?<!\w)(?:\w[ .\-_*]){3,}\w(?!\w)")


@dataclass(frozen=True)
class ToxicitySettings:
    """fit_rows: most labelled texts the trees are learned from, as chosen by a hash of the key; the sample is
    bounded, what the lexicon is counted on and what is scored is not. stems: lengths of word
    beginnings that can be terms. least_texts, least_odds: toxic texts a term needs, and log of how much
    likelier it is there. terms: most terms. near: words between a term and a second person."""

    fit_rows: int = 100_000
    stems: tuple[int, ...] = (4, 5, 6)
    least_texts: int = 5
    least_odds: float = 3.0
    terms: int = 3_000
    near: int = 4
    trees: int = 20
    depth: int = 3
    step: float = 0.3
    seed: int = 11


def terms_of(word: str, stems: tuple[int, ...]) -> list[str]:
    """A bare lower-case word and its beginnings (marked by ``*``)."""
    return [word, *(word[:n] + "*" for n in stems if len(word) > n)]


def _term_counts(rows: DataFrame, stems: tuple[int, ...]) -> DataFrame:
    """``(term, bad, good)`` of rows ``(text, label)``: in how many texts of each label a term occurs, added up per
    slice of texts but not over slices."""
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("bad", T.LongType()),
                           T.StructField("good", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in pieces(batch):
                counts = (Counter(), Counter())
                for body, bad in zip(part.column("text").to_pylist(), part.column("label").to_pylist()):
                    words = {_EDGE.sub("", w) for w in set((body or "").lower().split())} - {""}
                    counts[bad].update({t for w in words for t in terms_of(w, stems)})
                every = list(counts[0].keys() | counts[1].keys())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(every, pa.string()), pa.array([counts[1][t] for t in every], pa.int64()),
                     pa.array([counts[0][t] for t in every], pa.int64())], ["term", "bad", "good"])

    return in_arrow(rows, run, schema)


def _strongest(counts: DataFrame, bad: int, good: int, settings: ToxicitySettings) -> dict[str, float]:
    """The terms of ``(term, bad, good)`` with the highest log odds, given the texts of each label."""
    odds = (F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0)))
    found = (counts.filter(F.col("bad") >= settings.least_texts).withColumn("odds", odds)
             .filter(F.col("odds") >= settings.least_odds)
             .orderBy(F.desc("odds"), "term").limit(settings.terms).collect())
    return {r["term"]: r["odds"] for r in found}


def learn_lexicon(texts: DataFrame, text: str, label: str, settings: ToxicitySettings) -> dict[str, float]:
    """Terms and their log odds, from texts that carry their label.

    Tasks count in how many texts of each label a term occurs; counts are added before and after the
    shuffle. The driver gets the ``terms`` strongest ones.
    """
    rows = texts.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"))
    sizes = rows.agg(F.count_if(F.col("label") == 1).alias("bad"), F.count_if(F.col("label") == 0).alias("good")).first()
    counts = _term_counts(rows, settings.stems).groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    return _strongest(counts, sizes["bad"], sizes["good"], settings)


def learn_lexicon_by_key(docs: DataFrame, known: DataFrame, key: str, text: str,
                         settings: ToxicitySettings) -> dict[str, float]:
    """What ``learn_lexicon`` finds for ``docs`` joined to ``known`` (``key``, ``y``; one row a key), with fewer texts moved.

    Most labelled texts are clean, so clean ones are not joined to their labels: what is counted over all of
    ``docs``, less what toxic and unlabelled texts hold, is theirs. Only toxic and unlabelled texts move, and of
    the counts over all only those of terms in enough toxic texts. Where fewer texts are labelled than are toxic or
    unlabelled, the labelled ones move instead. Which rows move is read from a bitmap of keys (8 MB at any size); the join
    after it is exact. Rows without a key have no label.
    """
    (hashed,) = fresh(docs.columns, "key_hash")
    rows = docs.select(F.col(key), F.col(text).alias("text"), F.xxhash64(key).alias(hashed)).filter(F.col(key).isNotNull())
    told = checkpointed(rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).join(known.select(key, "y"), key, "left"))
    sizes = told.groupBy("y").agg(F.sum("rows").alias("rows")).collect()
    sizes = {r["y"]: r["rows"] for r in sizes}
    bad, good, unlabelled = (sizes.get(y, 0) for y in (1.0, 0.0, None))

    def moved(keys: DataFrame) -> DataFrame:
        near, _ = split_by(rows, hashed, bitmap_of(keys.select(F.xxhash64(key))))
        return near.join(keys, key)

    if bad + good <= bad + unlabelled:
        return learn_lexicon(moved(told.filter("y IS NOT NULL").select(key, "y")), "text", "y", settings)
    odd = moved(told.filter("y IS NULL OR y = 1").select(key, F.coalesce(F.col("y"), F.lit(0.0)).cast("int").alias("label")))
    some = checkpointed(_term_counts(odd.select("text", "label"), settings.stems).groupBy("term")
                        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("unlabelled"))
                        .filter(F.col("bad") >= settings.least_texts))
    every = _term_counts(rows.select("text", F.lit(0).alias("label")), settings.stems)
    every, _ = split_by(every.select("term", F.col("good").alias("n"), F.xxhash64("term").alias("hash")), "hash",
                        bitmap_of(some.select(F.xxhash64("term"))))
    counts = (every.groupBy("term").agg(F.sum("n").alias("n")).join(some, "term")
              .select("term", "bad", (F.col("n") - F.col("bad") - F.col("unlabelled")).alias("good")))
    return _strongest(counts, bad, good, settings)


def toxicity_features(text: str | None, lexicon: Mapping[str, float], settings: ToxicitySettings) -> list[float]:
    """The features of a text in the order of ``FEATURES``; without words, zeros."""
    import math

    counts = Counter((text or "").split())
    n = counts.total()
    if not n:
        return [0.0] * len(FEATURES)
    stems, least = settings.stems, min(settings.stems, default=1)

    def strength(word):
        best = lexicon.get(word, 0.0)
        if len(word) > least:
            for k in stems:
                if len(word) > k:
                    best = max(best, lexicon.get(word[:k] + "*", 0.0))
        return best

    hits = kinds = hidden = odd = second = shouted = 0
    weight = 0.0
    marked = set()
    for raw, c in counts.items():
        low = raw.lower()
        if not low.isalpha():
            if len(raw) > 3 and _INNER.search(low):
                odd += c
                word = _EDGE.sub("", low)
                if not strength(word):
                    plain = _NOT_LETTER.sub("", word.translate(LEET))
                    found = max(strength(plain), strength(_RUN.sub(r"\1", plain)), strength(_RUN.sub(r"\1\1", plain)))
                    if found:
                        hidden, weight = hidden + c, weight + c * found
                        marked.add(raw)
                        continue
            low = _EDGE.sub("", low)
            if not low:
                continue
        elif len(low) > 4 and (low[0] * 3 in low or _INNER.search(low)):
            odd += c
            found = max(strength(_RUN.sub(r"\1", low)), strength(_RUN.sub(r"\1\1", low)))
            if found and not strength(low):
                hidden, weight = hidden + c, weight + c * found
                marked.add(raw)
                continue
        found = strength(low)
        if found:
            hits, kinds, weight = hits + c, kinds + 1, weight + c * found
            marked.add(raw)
        if low in SECOND_PERSON:
            second += c
        if len(raw) > 2 and raw.isupper():
            shouted += c
    if sum(c for w, c in counts.items() if len(w) == 1) > 3 or "-" in text or "." in text:
        for spaced in _SPACED.finditer(text):
            odd += 1
            found = strength(_NOT_LETTER.sub("", spaced.group().lower().translate(LEET)))
            if found:
                hidden, weight = hidden + 1, weight + found
    near = 0
    if marked and second:
        words = text.split()
        persons = [i for i, w in enumerate(words) if _EDGE.sub("", w.lower()) in SECOND_PERSON]
        close = {j for i in persons for j in range(i - settings.near, i + settings.near + 1)}
        near = sum(w in marked and i in close for i, w in enumerate(words))
    letters = max(1, sum(map(len, counts)))
    upper = sum(sum(map(str.isupper, w)) for w in counts if not w.islower())
    marks = sum(map(text.count, ".,;:!?"))
    return [math.log1p(n), float(hits), float(kinds), hits / n, weight / n, float(hidden), odd / n, second / n,
            near / max(1, hits + hidden), upper / letters, shouted / n, (text.count("!") + text.count("?")) / n, marks / n]


def text_features(df: DataFrame, lexicon: Mapping[str, float], key: str = "doc_id", text: str = "text",
                  settings: ToxicitySettings = ToxicitySettings()) -> DataFrame:
    """``key`` and one column per feature; no shuffle. The lexicon has at most ``settings.terms`` terms."""
    lexicon = dict(lexicon)

    def make():
        def work(texts):
            return [list(c) for c in zip(*(toxicity_features(t, lexicon, settings) for t in texts))]

        return work

    return per_text(df, key, text, [T.StructField(n, T.DoubleType()) for n in FEATURES], make)


def _sample(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """About ``rows`` of ``total`` rows, chosen by a hash of the key; all of them if there are fewer."""
    if total <= rows:
        return df
    cut = int(rows / total * (1 << 32))
    return df.filter(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 32)) < cut)


def isotonic(rows: DataFrame, told: str, y: str):
    """The rising step curve of ``y`` over ``told`` with the least squares; it adds a column ``fitted``.

    Rows at one score become one weighted row: the fit is the same, and a common score does not fill a task."""
    steps = rows.groupBy(told).agg(F.avg(y).alias(y), F.count(F.lit(1)).cast("double").alias("rows"))
    return IsotonicRegression(featuresCol=told, labelCol=y, weightCol="rows", predictionCol="fitted").fit(steps)


def toxicity_scores(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
                    folds: int = 4, held: int = 2, threshold: float = 0.3,
                    settings: ToxicitySettings = ToxicitySettings()) -> DataFrame:
    """``key``, ``held_out``, ``score`` and ``predicted`` (1 from ``threshold`` on) for every row of ``df``.

    Labels are learned only outside the held-out fold; a key labelled toxic once is toxic. Of the training
    rows a fifth, by hash, is kept from the trees for the calibration. Null and empty texts have features of zero
    and are scored like any other; repeated rows get a row each, null keys are not held out. If the training labels
    lack one of the two values there is nothing to learn: all scores are then the share of toxic ones (0 if there
    are no labels). Other columns are not read.
    """
    docs = df.select(key, text)
    known = (labels.filter(fold(key, folds) != held).groupBy(key).agg(F.max(label).cast("double").alias("y"))
             .filter("y IN (0, 1)"))
    known = checkpointed(known)
    sizes = known.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("bad")).first()
    held_out = F.coalesce(fold(key, folds) == held, F.lit(False)).alias("held_out")

    def final(scored: DataFrame) -> DataFrame:
        return scored.select(key, held_out, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

    if not sizes["bad"] or sizes["bad"] == sizes["n"]:
        return final(docs.withColumn("score", F.lit((sizes["bad"] or 0.0) / max(1, sizes["n"]))))
    lexicon = learn_lexicon_by_key(docs.filter(fold(key, folds) != held), known, key, text, settings)
    measured = checkpointed(text_features(docs, lexicon, key, text, settings))
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    training = checkpointed(assembler.transform(
        measured.join(_sample(known, key, settings.fit_rows, sizes["n"]), key)
        .withColumn("part", F.pmod(F.xxhash64(F.lit("calibrate"), key), F.lit(5)))).select("features", "y", "part"))
    tree_rows, other_rows = training.filter("part > 0"), training.filter("part = 0")
    found = training.agg(F.count_distinct("y").alias("all"), F.count_distinct(F.when(F.col("part") > 0, F.col("y"))).alias("tree"),
                         F.count_if(F.col("part") == 0).alias("other")).first()
    if found["all"] < 2:  # labels of documents that are not there
        return final(docs.withColumn("score", F.lit(sizes["bad"] / sizes["n"])))
    if found["tree"] < 2 or not found["other"]:
        tree_rows = other_rows = training
    trees = GBTClassifier(labelCol="y", maxIter=settings.trees, maxDepth=settings.depth, stepSize=settings.step,
                          seed=settings.seed, predictionCol="guess").fit(tree_rows)

    def told(rows: DataFrame) -> DataFrame:
        return trees.transform(rows).withColumn("told", vector_to_array("probability")[1])

    curve = isotonic(told(other_rows), "told", "y")
    scored = curve.transform(told(assembler.transform(measured)).select(key, "told"))
    return final(scored.select(key, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("fitted"))).alias("score")))
