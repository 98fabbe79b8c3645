"""The pipeline and the registered queries of this subpackage."""

from __future__ import annotations

from collections import Counter

import pytest
from check_proofs import compare, connect

import __spark_entry__ as entry
import corpus_pipeline
from shoplore.llm import quality_rules, tiling
from shoplore.llm.queries import QUERIES
from shoplore.llm.simhash import without_near_copies
from shoplore.llm.common import words_of
from test_near_copies import survivors

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_query_equals_sql(spark, name):
    assert compare(entry.queries()[name](spark, SMALL), connect(SMALL).sql(entry.oracle_sql()[name])) == []


def test_every_operator_and_the_pipeline_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


def test_pipeline_equals_brute_force(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rules, left = quality_rules.LineRules(), []
    for d in docs:
        lines = [x for x in d["text"].split("\n") if not words_of(x) or not quality_rules.line_fails(x, len(words_of(x)), rules)]
        words, kept = words_of(d["text"]), sum(len(words_of(x)) for x in lines)
        windows = Counter(zip(*[words[k:] for k in range(5)]))
        again = len({i + k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(5)})
        if len(words) >= 10 and 100 * again <= 20 * len(words) and 100 * (len(words) - kept) <= 70 * len(words):
            left.append(d | {"text": "\n".join(lines)})
    stay = set(survivors([(d["doc_id"], d["text"]) for d in left]))
    left = [d for d in left if d["doc_id"] in stay]
    items = [tiling.tokens(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]

    def leaks(text):
        words = tiling.tokens(text)
        grams = {tuple(words[i:i + 4]) for i in range(len(words) - 3)}
        return any(len({i + k for i in range(len(t) - 3) if tuple(t[i:i + 4]) in grams for k in range(4)}) >= 0.6 * len(t) for t in items)

    want = {d["doc_id"]: d["text"] for d in left if not leaks(d["text"])}
    import hashlib

    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert sorted(got) == sorted(want)
    assert all(r["decoded_sha256"] == hashlib.sha256(want[k].encode()).hexdigest() and len(r["ids"]) == r["n_tokens"] for k, r in got.items())


def test_stages_keep_columns_and_stand_odd_rows(spark):
    body = "The quick brown fox jumps over the lazy dog near the old river bank today, they say."
    rows = [(1, body, "en", "s", 5, "x"), (1, body, "en", "s", 5, "x"), (2, body, "en", "s", 5, "x"), (None, "Another text about the sea and the hills, which nobody has copied from the one above so far.", None, None, None, "x"),
            (4, None, "en", "s", 0, "x"), (5, "", "en", "s", 0, "x"), (6, "1 2 3 4 5 6 7 8 9 10 11 12 13.", "en", "s", 3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fingerprint string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        assert stage(spark, docs.limit(0), SMALL).count() == 0
        docs = out
    assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["1", "None"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == 2


def test_rows_without_keys_are_told_apart(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "q r s t"), (None, "q r s t"), (3, "q r s t"), (3, "w x y z"), (4, None), (5, "")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in without_near_copies(df).collect())
    assert got == [("3", "q r s t"), ("3", "w x y z"), ("4", "None"), ("None", "a b c d")]


def test_unlike_texts_both_stay(spark):
    """Fingerprints of 185 and 106 are near; their five-word shingles are similar to 0.797 only."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("doc_id IN (106, 185)")
    assert corpus_pipeline.near_duplicates(spark, docs, SMALL).count() == 2
    assert without_near_copies(docs, max_bits=7).count() == 1
