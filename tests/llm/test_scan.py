"""Licence scans, importance draws and ranked search against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from shoplore.llm import importance, licenses, ranked_search
from shoplore.llm.importance import Draw, importance_draw, kth
from shoplore.llm.licenses import BASE_PHRASES, IDENTIFIERS, LIMITS, NOTICES, evaluate, licence_digest, scan_licences
from shoplore.llm.ranked_search import Search, Walk

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ROWS = "doc_id long, text string, score string, n_words int, row int, key int"


def plain_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def texts(seed, n, words, longest):
    draw = random.Random(seed)
    return [" ".join(draw.choice(words) for _ in range(draw.randint(0, longest))) for _ in range(n)]


# licences

def test_phrases_equal_brute_force(spark):
    vocabulary = "under the mit license apache version 2 cc by nc gnu general public all rights reserved ÄÖ x".split()
    bodies = texts(1, 150, vocabulary, 40) + ["CC-BY_NC\ncc by nc by nc", "under the MIT License" * 3, None, ""]
    df = spark.createDataFrame([(i, t, "s", 1, 2, 3) for i, t in enumerate(bodies)], ROWS)
    for r in licence_digest(scan_licences(df)).collect():
        words = plain_words(bodies[r["doc_id"]])
        at = {}
        for phrase, label in BASE_PHRASES + NOTICES:
            p = phrase.split()
            at[phrase, label] = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        base = [i for x in BASE_PHRASES for i in at[x]]
        assert (r["n_words"], r["n_base"]) == (len(words), len(base))
        assert (r["first_word"], r["last_word"]) == ((min(base), max(base)) if base else (None, None))
        assert r["base_labels"] == ",".join(sorted({label for (p, label) in BASE_PHRASES if at[p, label]}))
        labels = sorted({label for (_, label), found in at.items() if found})
        assert r["labels"] == ",".join(labels) and r["score"] == max(map(LIMITS.get, labels), default=0.0)


@pytest.mark.parametrize("source, chosen, limit", [
    ("(MIT OR GPL-3.0-or-later) AND Apache-2.0", {"mit", "apache-2"}, 0.1),
    ("GPL-3.0 OR MIT AND CC-BY-SA-4.0 */", {"mit", "cc-by-sa"}, 0.5),
    ("GPL-2.0+ WITH Classpath-exception-2.0", {"gpl-2"}, 0.4),
    ("GPL-2.0 WITH Some-other-exception", {"gpl-2"}, 0.6),
    ("MIT with nothing OR ( GPL-3.0", {"mit"}, 0.1),
    ("LicenseRef-own", {"other"}, 0.5),
    ("MIT and\nGPL-3.0", {"mit"}, 0.1),
    ("((((ISC)", {"isc"}, 0.1),
    ("ISC) AND GPL-3.0", {"isc"}, 0.1),
])
def test_expressions(source, chosen, limit):
    told = evaluate(source)[1]
    assert (set(told.chosen), told.limit) == (chosen, limit)


def test_no_expression_and_a_very_deep_one():
    assert evaluate("") is None and evaluate(")") is None and evaluate("( AND") is None and evaluate("AND MIT") is None
    assert evaluate("(" * 200_000 + "MIT" + ")" * 200_000)[1].chosen == {"mit"}


def nested(depth=3):
    ids = st.sampled_from(sorted(IDENTIFIERS))
    return st.recursive(ids, lambda inner: st.tuples(inner, st.sampled_from(["AND", "or"]), inner), max_leaves=8)


def written_out(tree):
    return tree if isinstance(tree, str) else f"({written_out(tree[0])} {tree[1]} {written_out(tree[2])})"


def worked_out(tree):
    if isinstance(tree, str):
        return LIMITS[IDENTIFIERS[tree]], {IDENTIFIERS[tree]}
    (a, left), (b, right) = worked_out(tree[0]), worked_out(tree[2])
    if tree[1] == "or":
        return (b, right) if b < a else (a, left)
    return max(a, b), left | right


@settings(max_examples=200, deadline=None)
@given(nested())
def test_expressions_equal_their_tree(tree):
    told = evaluate(written_out(tree))[1]
    assert (told.limit, set(told.chosen)) == worked_out(tree)


def test_tags_in_texts(spark):
    rows = [(1, "# SPDX-License-Identifier: MIT OR GPL-3.0\nimport x\n# SPDX-License-Identifier: CC0-1.0"),
            (2, "The license expression of a face."), (3, "License-Expression: Apache-2.0 AND MIT"),
            (None, "SPDX license identifier: ZLIB"), (4, "word " * 300_000 + "SPDX-License-Identifier: AGPL-3.0-only"), (5, None), (5, None)]
    got = scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    told = {str(r["doc_id"]): ([(t["place"], t["chosen"], t["named"]) for t in r["tags"]], r["labels"], r["score"]) for r in got}
    assert len(got) == 7
    assert told["1"] == ([(0, ["mit"], ["gpl-3", "mit"]), (10, ["cc0"], ["cc0"])], ["cc0", "mit"], 0.1)
    assert told["2"] == ([], [], 0.0) and told["5"] == ([], [], 0.0)
    assert told["3"][1:] == (["apache-2", "mit"], 0.1) and told["None"][1] == ["zlib"]
    assert told["4"] == ([(300_000, ["agpl"], ["agpl"])], ["agpl"], 0.7)
    assert scan_licences(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# importance

def plain_draw(docs, target, rules):
    def runs(text):
        words = plain_words(text)
        return [" ".join(words[i:i + n]) for n in range(1, rules.longest + 1) for i in range(len(words) - n + 1)]

    def counts(all_texts):
        return Counter(zlib.crc32(f.encode()) % rules.buckets for t in all_texts for f in runs(t))

    s, t = counts(x for _, x in docs), counts(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for key, text in docs:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + rules.buckets) / ((s[b] + 1) * (all_t + rules.buckets))))
                     for b in (zlib.crc32(f.encode()) % rules.buckets for f in runs(text)))
        h = int(hashlib.sha256(f"{rules.seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(runs(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), len(plain_words(text))])
    able = sorted((r for r in out if r[4] >= rules.least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): n + 1 for n, r in enumerate(able[:len(able) * rules.percent // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=str)


@pytest.mark.parametrize("rules", [Draw(least_words=5, percent=30, buckets=50, pivots=3), Draw(longest=2, least_words=1, percent=100)])
def test_draw_equals_brute_force(spark, rules):
    words = "a b c dé the of river 7 Zoo".split()
    bodies = texts(2, 300, words, 30) + ["", None]
    docs = [(i, t) for i, t in enumerate(bodies)] + [(None, "the river of a Zoo the river of a"), (7, bodies[7]), (7, bodies[7])]
    target = texts(3, 20, words[4:], 20) + [None]
    df = spark.createDataFrame([(*d, "s", 1, 2, 3) for d in docs], ROWS).repartition(7)
    items = spark.createDataFrame([(t,) for t in target], "text string")
    assert sorted((tuple(r) for r in importance_draw(df, items, rules=rules).collect()), key=str) == plain_draw(docs, target, rules)


def test_draw_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert importance_draw(none, some).count() == 0
    assert [r["rank"] for r in importance_draw(some, none).collect()] == [None, None]


def test_rows_that_are_all_alike(spark):
    """A third of the rows and more may share key and score."""
    df = spark.range(4000).select((F.col("id") % 2).alias("doc_id"), F.lit("one two three four").alias("text"))
    got = importance_draw(df, df, rules=Draw(least_words=2, percent=60)).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 2401))
    first = {r["doc_id"] for r in got if r["rank"] and r["rank"] <= 2000}
    assert len(first) == 1 and all(r["rank"] for r in got if r["doc_id"] in first)


@pytest.mark.parametrize("percent", [1, 37, 99, 100])
def test_kth_is_the_sorted_place(spark, percent):
    df = spark.range(5000).select((F.xxhash64("id") % 40).alias("v"), F.when(F.col("id") % 5 > 0, F.col("id") % 7).alias("w"), "id").cache()
    rows = sorted(df.collect(), key=lambda r: (r["v"], r["w"] is not None, r["w"] or 0, r["id"]))
    assert kth(df, ["v", "w", "id"], percent, 4) == rows[5000 * percent // 100 - 1]
    assert kth(df.limit(3), ["v"], 10) is None


# search

def plain_search(docs, items, k):
    words = [(key, plain_words(t)) for key, t in docs]
    words = [(key, w) for key, w in words if w]
    n, total = len(words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    out = []
    for item, text in items:
        scores = []
        for key, w in words:
            tf, m = Counter(w), 75 + 25 * len(w) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in plain_words(text))
            if s > 0:
                scores.append((-s, key is None, key or 0, key))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("rules", [Search(), Search(k=3, fanout=2, batch_entries=60, first_rows=40), Search(k=5, block_terms=30, first_rows=1)])
def test_search_equals_brute_force(spark, rules):
    draw = random.Random(4)
    words = ["w%d" % (draw.paretovariate(0.7)) for _ in range(400)] + ["Ärger", "the"]
    bodies = texts(5, 250, words, 60)
    docs = [(i, t) for i, t in enumerate(bodies)] + [(None, bodies[3]), (400, bodies[3]), (400, bodies[3]), (9, ""), (10, None)]
    items = [(i, t) for i, t in enumerate(texts(6, 25, words + ["unknown"], 12))] + [(None, bodies[3]), (3, "the THE the"), (3, "the THE the"), (50, None)]
    df = spark.createDataFrame([(*d, "s", 1, 2, 3) for d in docs], ROWS).repartition(5)
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, score int")
    got = sorted((tuple(r) for r in ranked_search.ranked_search(df, asked, rules=rules).collect()), key=str)
    assert got == plain_search(docs, items, rules.k)


def test_search_without_items_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string, item_id long")
    some = spark.createDataFrame([(1, "a b", 1)], "doc_id long, text string, item_id long")
    assert ranked_search.ranked_search(none, some).count() == ranked_search.ranked_search(some, none).count() == 0


def test_node_bounds_prune():
    """Documents that share no rare term with an item are left out by whole nodes."""
    import numpy as np

    walk = Walk([{0: 1000, 1: 5}, {2: 1000, 1: 5}], Search(k=1, fanout=2))
    ids = np.array([sorted((i % 2 * 2, 1)) for i in range(400)]).ravel()
    walk.add(list(range(400)), np.arange(0, 801, 2), ids, np.repeat(400 - np.arange(400), 2))
    assert sorted(walk.found()) == [(0, 0, 402_000), (1, 1, 400_995)]
    assert walk.offers < 40
