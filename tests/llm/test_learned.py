"""Operators that learn, next to their definitions in plain loops; ties of repeated messages next to SQL."""

from __future__ import annotations

import math
import random
import re
import warnings
import zlib
from collections import Counter
from dataclasses import replace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shoplore.llm import pu_quality, toxicity
from shoplore.llm.queries import OP7_SQL, QUERIES
from shoplore.llm.quotes import chat_line, reply_ordered

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


# positive-unlabelled risk

def sigmoid(z):
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def soft(z):
    return max(z, 0.0) + math.log1p(math.exp(-abs(z)))


def rows_of(measured, trusted):
    """Standardised measures with a leading 1, and which rows are positive."""
    raw = [[float(x) for x in m] for m in measured]
    n = len(raw)
    mean = [math.fsum(r[j] for r in raw) / n for j in range(len(raw[0]))]
    scale = [max(math.sqrt(math.fsum((r[j] - m) ** 2 for r in raw) / n), 1e-6) for j, m in enumerate(mean)]
    x = [[1.0] + [max(-6.0, min(6.0, (v - m) / s)) for v, m, s in zip(r, mean, scale)] for r in raw]
    return np.array(x), np.array(trusted)


def newton(x, terms, ridge):
    """Least of sum(weight * loss(sign * z)) + ridge; ``terms`` holds (rows, weight, loss, slope, curve)."""
    w = np.zeros(x.shape[1])
    fine = np.full(len(w), ridge)
    fine[0] = 0

    def value(w):
        return sum(math.fsum(weight * loss(z) for z in x[rows] @ w) for rows, weight, loss, _, _ in terms) + 0.5 * float(fine @ (w * w))

    for _ in range(200):
        grad, curve = fine * w, np.diag(fine + 1e-9)
        for rows, weight, _, slope, bend in terms:
            for r in x[rows]:
                z = float(r @ w)
                grad = grad + weight * slope(z) * r
                curve = curve + weight * bend(z) * np.outer(r, r)
        step = -np.linalg.solve(curve, grad)
        size = 1.0
        while value(w + size * step) > value(w) + 1e-12 and size > 1e-9:
            size /= 2
        w = w + size * step
        if np.abs(grad).max() < 1e-10:
            break
    return w


def as_negative(rows, weight):
    return rows, weight, soft, sigmoid, lambda z: sigmoid(z) * (1 - sigmoid(z))


def as_positive(rows, weight):
    return rows, weight, lambda z: soft(-z), lambda z: sigmoid(z) - 1, lambda z: sigmoid(z) * (1 - sigmoid(z))


def prior_by_hand(z, positive, settings):
    """Over cuts of the score, the least share of all texts above it to the share of positives above it."""
    n, p = len(z), int(positive.sum())
    cell = [min(settings.cells - 1, int((math.tanh(v / 4) + 1) / 2 * settings.cells)) for v in z]
    least = 0.999
    for cut in range(settings.cells):
        a = sum(c >= cut for c in cell) / n
        b = sum(c >= cut for c, good in zip(cell, positive) if good) / p
        if b >= settings.least_share:
            least = min(least, (a + math.sqrt(a * (1 - a) / n)) / max(b - math.sqrt(b * (1 - b) / p), 1e-9))
    return max(0.001, least)


def risk(x, positive, prior, ridge, w):
    """The written risk row by row: value, negative part, gradient of the branch that holds."""
    fine = np.full(len(w), ridge)
    fine[0] = 0
    n, p, z = len(x), positive.sum(), x @ w
    good = prior * math.fsum(soft(-v) for v in z[positive]) / p
    rest = math.fsum(soft(v) for v in z) / n - prior * math.fsum(soft(v) for v in z[positive]) / p
    up = sum(sigmoid(v) * r for v, r in zip(z, x)) / n - prior * sum(sigmoid(v) * r for v, r in zip(z[positive], x[positive])) / p
    if rest < 0:
        return rest, rest, -up
    down = prior * sum((sigmoid(v) - 1) * r for v, r in zip(z[positive], x[positive])) / p
    return good + rest + 0.5 * float(fine @ (w * w)), rest, down + up + fine * w


def turned_back(x, positive, prior, settings):
    """Newton steps while the negative part is not below zero, a tenth of a gradient step back while it is."""
    def at(w):
        return risk(x, positive, prior, settings.ridge, w)

    w = np.zeros(x.shape[1])
    now = at(w)
    best = (now[0], w)
    for _ in range(settings.passes):
        back = now[1] < 0
        if back:
            step = -0.1 * now[2]
        else:
            bend = sum(sigmoid(v) * (1 - sigmoid(v)) * np.outer(r, r) for v, r in zip(x @ w, x)) / len(x)
            step = -np.linalg.solve(bend + np.diag([1e-9] + [settings.ridge + 1e-9] * (len(w) - 1)), now[2])
        step *= min(1, 5 / max(np.abs(step).max(), 1e-12))
        new = at(w + step)
        while not back and new[1] >= 0 and new[0] > now[0] + 1e-9 and np.abs(step).max() > settings.tolerance:
            step = step / 2
            new = at(w + step)
        w, now = w + step, new
        if now[1] >= 0 and now[0] <= best[0]:
            best = (now[0], w)
        if np.abs(step).max() <= settings.tolerance:
            return best[1], best[0], now[1] >= 0
    return best[1], best[0], False


@pytest.mark.parametrize("ridge", [1e-3, 0.05, 0.5])
def test_quality_equals_the_written_risk(spark, ridge):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    trusted = [labels.get(r["doc_id"]) == 1 and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 for r in docs]
    x, positive = rows_of([pu_quality.measures(r["text"]) for r in docs], trusted)
    settings = pu_quality.PuSettings(ridge=ridge, tolerance=1e-6)
    every, some = np.full(len(x), True), positive
    plain = newton(x, [as_positive(some, 1 / some.sum()), as_negative(every, 1 / len(x))], settings.ridge)
    prior = prior_by_hand(x @ plain, positive, settings)

    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in docs], "doc_id long, text string")
    keys = spark.createDataFrame([(r["doc_id"],) for r, t in zip(docs, trusted) if t], "doc_id long")
    measured = pu_quality.text_measures(df)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        model = pu_quality.fit_pu(measured, keys, settings=settings)
    assert abs(model.prior - prior) < 1e-6

    want, low, ended = turned_back(x, positive, prior, settings)
    w = np.array([model.bias, *model.weights])
    assert model.converged == ended and np.abs(w - want).max() < 1e-6
    _, rest, slope = risk(x, positive, prior, settings.ridge, w)
    assert rest >= -1e-9 and abs(np.abs(slope).max() - model.slope) < 1e-6
    if ended:  # then it is the least of the convex sum
        assert model.slope < 1e-4 and low <= risk(x, positive, prior, settings.ridge, np.zeros(len(w)))[0]
    got = {r["doc_id"]: r["score"] for r in pu_quality.pu_scores(measured, model).select("doc_id", "score").collect()}
    assert max(abs(got[r["doc_id"]] - sigmoid(float(v))) for r, v in zip(docs, x @ w)) < 1e-9


def test_a_search_cut_short_says_so(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    keys = spark.read.parquet(f"{SMALL}/labels.parquet").filter("quality = 1").select("doc_id")
    measured = pu_quality.text_measures(df)
    with pytest.warns(UserWarning, match="still fell"):
        short = pu_quality.fit_pu(measured, keys, settings=pu_quality.PuSettings(passes=1))
    assert not short.converged and short.slope > 0


# toxicity

def lexicon_by_hand(texts, settings):
    bad, good, sizes = Counter(), Counter(), [0, 0]
    for text, toxic in texts:
        sizes[toxic] += 1
        words = {re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in (text or "").lower().split()} - {""}
        terms = words | {w[:n] + "*" for w in words for n in settings.stems if len(w) > n}
        (bad if toxic else good).update(terms)
    odds = {t: math.log((n + 0.5) / (sizes[1] + 1)) - math.log((good[t] + 0.5) / (sizes[0] + 1))
            for t, n in bad.items() if n >= settings.least_texts}
    kept = sorted((-o, t) for t, o in odds.items() if o >= settings.least_odds)[:settings.terms]
    return {t: -o for o, t in kept}


def labelled_texts(spark, folder):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    return [(r["doc_id"], r["text"], labels[r["doc_id"]]) for r in docs if r["doc_id"] in labels]


def test_lexicon_equals_plain_counts(spark):
    texts = [(t, y) for _, t, y in labelled_texts(spark, MEDIUM)] + [(None, 0), ("", 1)]
    settings = replace(toxicity.ToxicitySettings(), least_texts=3, least_odds=2.0)
    df = spark.createDataFrame([(t, float(y)) for t, y in texts], "text string, y double").repartition(5)
    got, want = toxicity.learn_lexicon(df, "text", "y", settings), lexicon_by_hand(texts, settings)
    assert want and got.keys() == want.keys() and all(abs(got[t] - o) < 1e-9 for t, o in want.items())


def test_a_term_of_many_rows_is_never_sampled_away(spark):
    """Five toxic texts among 30,000 labelled ones hold the term; the text that is not labelled is told by it."""
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 6000 == 7, "you are a zorgblat").otherwise(
        F.concat(F.lit("plain words of number "), F.col("id").cast("string"))).alias("text"))
    labels = df.select("doc_id", (F.col("doc_id") % 6000 == 7).cast("double").alias("toxic"))
    lexicon = toxicity.learn_lexicon(df.join(labels, "doc_id"), "text", "toxic", toxicity.ToxicitySettings())
    assert "zorgblat" in lexicon


@pytest.mark.parametrize("labelled", [0.9, 0.2])
def test_lexicon_by_key_equals_the_joined_one(spark, labelled):
    """Repeated and missing keys, null texts, labels of absent documents; most or few texts labelled."""
    rng = random.Random(3)
    rows, labels = [(None, "zork gone"), (7, None), (7, "again zork")], [(100_000, 1.0)]
    for i in range(400):
        toxic = i % 8 == 0
        body = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 12))] + (["zorkish", "Blatter!"] if toxic or i % 97 == 5 else [])
        rows += [(i, " ".join(body))] * (2 if i % 50 == 0 else 1)
        if rng.random() < labelled:
            labels.append((i, float(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, y double")
    settings = replace(toxicity.ToxicitySettings(), least_texts=3, least_odds=1.0)
    want = toxicity.learn_lexicon(docs.join(known, "doc_id"), "text", "y", settings)
    got = toxicity.learn_lexicon_by_key(docs, known, "doc_id", "text", settings)
    assert "blatter" in want and got == want


def features_by_hand(text, lexicon, settings):
    """Features of a text without obfuscated words, occurrence by occurrence; capitals are a share of the
    characters of its different words."""
    words = text.split()

    def strength(word):
        return max([lexicon.get(word, 0.0)] + [lexicon.get(word[:n] + "*", 0.0) for n in settings.stems if len(word) > n])

    bare = [re.sub(r"^[\W_]+|[\W_]+$", "", w.lower()) for w in words]
    hit = [i for i, b in enumerate(bare) if b and strength(b) > 0]
    second = [i for i, b in enumerate(bare) if b in toxicity.SECOND_PERSON]
    near = sum(any(abs(i - j) <= settings.near for j in second) for i in hit)
    n, kinds = len(words), "".join(set(words))
    return {"log_words": math.log(1 + n), "term_hits": len(hit), "term_kinds": len({words[i] for i in hit}), "term_density": len(hit) / n,
            "term_weight": sum(strength(bare[i]) for i in hit) / n, "second_person": len(second) / n,
            "near_second_person": near / max(1, len(hit)), "capitals": sum(c.isupper() for c in kinds) / len(kinds),
            "shouted_words": sum(len(w) > 2 and w.isupper() for w, b in zip(words, bare) if b) / n,
            "exclaims": sum(text.count(c) for c in "!?") / n, "punctuation": sum(text.count(c) for c in ".,;:!?") / n}


def test_features_equal_their_definition(spark):
    settings = toxicity.ToxicitySettings()
    texts = labelled_texts(spark, MEDIUM)
    lexicon = lexicon_by_hand([(t, y) for _, t, y in texts], replace(settings, least_texts=3, least_odds=2.0))
    df = spark.createDataFrame([(k, t) for k, t, _ in texts], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.text_features(df, lexicon, settings=settings).collect()}
    compared = 0
    for key, text, _ in texts:
        r = got[key]
        if not (text or "").split():
            assert not any(r[f] for f in toxicity.FEATURES)
        elif not r["obfuscated"]:  # the rest has tests of its own
            compared += 1
            for name, value in features_by_hand(text, lexicon, settings).items():
                assert abs(r[name] - value) < 1e-9, (key, name)
    assert compared > len(texts) / 2


def pooled(pairs):
    """Pool adjacent violators by hand: blocks of (weight, mean, first score, last score)."""
    by_score = {}
    for s, y in pairs:
        by_score.setdefault(s, []).append(y)
    blocks = []
    for s in sorted(by_score):
        blocks.append([len(by_score[s]), sum(by_score[s]) / len(by_score[s]), s, s])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            n, mean, _, last = blocks.pop()
            m = blocks[-1]
            blocks[-1] = [m[0] + n, (m[0] * m[1] + n * mean) / (m[0] + n), m[2], last]
    return blocks


@pytest.mark.parametrize("seed", range(4))
def test_calibration_equals_pooling_by_hand(spark, seed):
    rng = random.Random(seed)
    pairs = [(round(rng.random(), rng.choice([1, 2, 3])), float(rng.random() < 0.4)) for _ in range(150)] + [(0.5, 1.0)] * 40
    df = spark.createDataFrame(pairs, "told double, y double").repartition(3)
    curve = toxicity.isotonic(df, "told", "y")
    asked = sorted({s for s, _ in pairs} | {rng.uniform(-0.2, 1.2) for _ in range(60)})
    got = [r["fitted"] for r in curve.transform(spark.createDataFrame([(s,) for s in asked], "told double")).orderBy("told").collect()]
    blocks = pooled(pairs)
    places = [p for n, mean, first, last in blocks for p in ((first, mean), (last, mean))]
    want = np.interp(asked, [p for p, _ in places], [v for _, v in places])
    assert np.abs(np.array(got) - want).max() < 1e-9


def test_toxicity_scores_are_the_calibrated_ones(spark):
    """Scores take few values, rise with the features' hits, and each is a mean of labels of the calibration part."""
    got = QUERIES["op6_toxicity"].run(spark, MEDIUM).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


# repeated messages

def test_ties_of_repeated_turns_equal_sql(spark):
    rng = random.Random(5)
    rows = [(rng.randint(1, 3), rng.choice([None, 1, 1, 2]), rng.choice(["user", "assistant", None]), rng.choice(["b", "a", "c d", "A"]))
            for _ in range(120)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = reply_ordered(df).withColumn("chat", chat_line("role", "text")).select("conv_id", "turn", "role", "position", "text").toPandas()
    db = duckdb.connect()
    db.register("conversations", df.toPandas().astype({"turn": "Int64"}))
    want = db.sql(OP7_SQL).df()[["conv_id", "turn", "role", "position", "text"]]

    def plain(frame):
        return sorted(tuple("" if x is None or x != x else str(x).removesuffix(".0") for x in row) for row in frame.astype(object).where(frame.notna(), None).itertuples(index=False))

    assert plain(got) == plain(want)
