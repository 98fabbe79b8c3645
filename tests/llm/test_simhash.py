from __future__ import annotations

import itertools
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from shoplore.llm.components import connected_components
from shoplore.llm.simhash import anchored, fingerprint_hex, fingerprints, near_links, simhash_components


def brute_print(text, k=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ")
             .replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits=3):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(prints)), 2):
        if bin(prints[a] ^ prints[b]).count("1") <= bits:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return [find(i) for i in range(len(prints))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_is_the_stated_one(spark):
    texts = ["", None, "  \n\t", "One", "ONE two", "a b c d e f", "Ä ö A", "x\x0by z w", "the cat " * 300]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["h"] for r in fingerprints(df).select("doc_id", fingerprint_hex("fingerprint").alias("h")).collect()}
    assert got == {i: f"{brute_print(t):016x}" for i, t in enumerate(texts)}


@pytest.mark.parametrize("bits", [1, 3, 5, 7])
@pytest.mark.parametrize("cell", [4, 2048])
def test_links_connect_what_brute_force_connects(spark, bits, cell):
    rng = random.Random(bits)
    values = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for v in list(values):
        for d in range(1, bits + 2):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), d)))
    dense = rng.getrandbits(64)
    values |= {dense ^ (1 << i) ^ (1 << j) for i in range(8) for j in range(i)}
    values = sorted(values)
    df = spark.createDataFrame([(signed(v),) for v in values], "fingerprint long")
    links = [(a, b) for a, b in near_links(df, max_bits=bits, cell=cell).collect()]
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= bits for a, b in links)
    place = {signed(v): i for i, v in enumerate(values)}
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(place[a]), find(place[b])))
        parent[b] = a
    assert [find(i) for i in range(len(values))] == brute_components(values, bits)


def test_replicas_stay_bounded(spark):
    df = spark.range(500).select(F.xxhash64("id").alias("f"))
    most = anchored(df, "f").groupBy("f", "anchor.block").count().agg(F.max("count")).first()[0]
    assert most <= 17


def test_components_on_given_documents(spark, tables):
    docs = tables.documents.select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_components(tables.documents).collect()}
    prints = [brute_print(d["text"]) for d in docs]
    roots = brute_components(prints)
    least = {}
    for d, r in zip(docs, roots):
        least[r] = min(least.get(r, d["doc_id"]), d["doc_id"])
    assert got == {d["doc_id"]: (signed(p), least[r]) for d, p, r in zip(docs, prints, roots)}


def test_edge_cases(spark):
    rows = [(1, "", "x"), (2, None, "x"), (3, "a b c d", "x"), (3, "a b c d", "x"), (None, "a b c d", "x"), (None, "q", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash_components(df).collect())
    assert got == [("1", "1"), ("2", "1"), ("3", "3"), ("3", "3"), ("None", "3"), ("None", "None")]
    assert simhash_components(df.limit(0)).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 40)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "left long, right long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 5 for i in range(5, 40)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "left long, right long")).count() == 0
