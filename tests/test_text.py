"""Text cleaning against Python's own regular expressions, and word counts."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from shoplore.functions import text as T
from shoplore.functions.columns import binary_label, sentiment
from shoplore.operators import words as W
from shoplore.plans.reviews import labelled_reviews

SAMPLES = [
    "Ótimo!\r\nChegou em 12/05/2018, paguei R$ 1.234,50 :)", "x² ½ Ⅷ ٣ e²", " a  b\t c   ",
    "veja http://a.com/x?y=1&z=%20#top e https://b.org.", "31.12.18 32/01/2018 09/13/2018", "R$10,5 $ 3.99",
    "não_é 'bom' — 100%", ":(( :)) : (", "", "日本語 テスト", "é combining",
]


def run(spark, expression, samples):
    df = spark.createDataFrame(list(enumerate(samples)), "i int, t string")
    return [r["o"] for r in df.select("i", expression("t").alias("o")).orderBy("i").collect()]


def in_python(text):
    text = re.sub(r"[\n\r]", " ", text)
    text = re.sub(r"https?://(?:[a-zA-Z0-9]|[$-_@.&+]|[!*(),]|%[0-9a-fA-F]{2})+", " link ", text)
    text = re.sub(r"([0-2]\d|3[01])[/.](0\d|1[0-2])[/.]\d{2,4}", " date ", text)
    text = re.sub(r"R?\$ *\d+[,.]\d+", " money ", text)
    text = re.sub(r"[0-9]+", " number ", text)
    return re.sub(r"[ \t]+$", "", re.sub(r"\s+", " ", re.sub(r"\W", " ", text)))


def test_cleaning_equals_python(spark, tables):
    rng = random.Random(5)
    alphabet = "aÉ9 0/.:,$R)(\n\t²_-%h　٣"
    made = ["".join(rng.choices(alphabet, k=60)) for _ in range(400)]
    texts = [r["text"] for r in tables.documents.select("text").collect()]
    for samples in (SAMPLES, made, texts):
        assert run(spark, T.clean_text, samples) == [in_python(s) for s in samples]


def test_collapsing_alone_knows_unicode_spaces(spark):
    samples = ["a  b ", "\x1ca\x85b  "]
    expected = [re.sub(r"[ \t]+$", "", re.sub(r"\s+", " ", s)) for s in samples]
    assert run(spark, T.collapse_spaces, samples) == expected


def test_a_very_long_link_is_one_link(spark):
    assert run(spark, T.mask_links, ["http://" + "aA9/" * 10_000 + " end"]) == [" link  end"]


def test_money_takes_one_separator(spark):
    assert run(spark, T.mask_money, ["R$ 1.234,50"]) == [" money ,50"]


def test_emoticons(spark):
    assert run(spark, T.strip_emoticons, ["ok :)) :( : )"]) == ["ok   : )"]


def test_words_equal_python(spark):
    expected = [re.findall(r"\b\w\w+\b", s.lower()) for s in SAMPLES]
    assert run(spark, T.words, SAMPLES) == expected


def test_sentiment_and_placeholders(spark):
    df = spark.createDataFrame(
        [(1, "a"), (2, "Not Defined"), (3, "c"), (5, None), (None, "e")], "score int, message string")
    rows = [tuple(r) for r in labelled_reviews(df, "score", "message").orderBy("message").collect()]
    assert rows == [(5, None, "Positive"), (1, "a", "Negative"), (3, "c", "Positive"), (None, "e", None)]
    labels = df.select(binary_label(sentiment("score")).alias("b")).collect()
    assert [r["b"] for r in labels] == [0, 0, 1, 1, 0]


@pytest.fixture()
def notes(spark):
    return spark.createDataFrame(
        [(1, "Carros carro casa 12"), (2, "carro de de de passss passs 7")], "i int, t string")


def test_word_counts_fold_plurals_and_drop_stop_words(notes):
    counts = {r["word"]: r["n"] for r in W.word_counts(
        notes, "t", ["DE"], keep_numbers=False, fold_plurals=True).collect()}
    assert counts == {"carro": 3, "casa": 1, "passss": 1, "passs": 1}
    plain = {r["word"]: r["n"] for r in W.word_counts(notes, "t").collect()}
    assert plain == {"carros": 1, "carro": 2, "casa": 1, "12": 1, "de": 3, "passss": 1, "passs": 1}


def test_top_words_break_ties_by_word(notes):
    rows = [tuple(r) for r in W.top_words(W.word_counts(notes, "t"), 3).collect()]
    assert rows == [("de", 3, 1.0), ("carro", 2, pytest.approx(2 / 3)), ("12", 1, pytest.approx(1 / 3))]


def test_words_per_subset(notes):
    counts = W.word_counts(notes, "t", ["de"], fold_plurals=True, by=["i"])
    rows = [tuple(r) for r in W.top_words(counts, 2, by=["i"]).orderBy("i", F.desc("n"), "word").collect()]
    assert rows == [(1, "carro", 2, 1.0), (1, "12", 1, 0.5), (2, "carro", 1, 1.0), (2, "passs", 1, 1.0)]


def test_stop_words_of_arrays(notes):
    kept = notes.select("i", W.drop_stop_words(T.words("t"), ["De"]).alias("w")).orderBy("i").collect()
    assert kept[1]["w"] == ["carro", "passss", "passs"]


def test_stems_of_vocabulary_and_of_arrays(notes):
    def stem(word):
        return word.rstrip("s")

    stems = {r["stem"]: (r["words"], r["n"]) for r in
             W.stem_vocabulary(W.word_counts(notes, "t"), stem).collect()}
    assert stems["carro"] == (2, 3) and stems["pa"] == (2, 2)
    arrays = notes.select("i", W.stem_arrays(stem)(T.words("t")).alias("s")).orderBy("i").collect()
    assert arrays[0]["s"] == ["carro", "carro", "casa", "12"]


def test_default_stop_words():
    assert "não" in W.default_stop_words() and len(W.default_stop_words()) > 150


def test_cleaning_stays_in_the_jvm(spark, tables):
    plan = tables.documents.select(T.clean_text(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Project") == 1
