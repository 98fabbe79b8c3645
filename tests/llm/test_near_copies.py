"""Near copies against brute force, whatever the sizes of the parts."""

from __future__ import annotations

import math
import random
from dataclasses import replace

import pytest
import xxhash

from shoplore.llm.near_copies import Nearness, without_confirmed_copies

BIG = 1 << 64


def shingles(text, n):
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in (text or "").encode().split()]
    runs = [words[i:i + n] for i in range(len(words) - n + 1)] or ([words] if words else [])
    return {xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs}


def prints(text, rules):
    """Bit by bit from the definition."""
    own, out = shingles(text, rules.print_shingle), []
    for k in range(rules.words):
        odd, ones = (k + 1) * 0x9E3779B97F4A7C15 % BIG | 1, [0] * 64
        for h in own:
            z = h * odd % BIG
            z = (z ^ z >> 32) * 0xD6E8FEB86659FD93 % BIG
            z ^= z >> 29
            for b in range(64):
                ones[b] += z >> b & 1
        out.append(sum(1 << b for b in range(64) if 2 * ones[b] > len(own)))
    return out


def home(value):
    """A word of the Hamming code has places of set bits (from 1) whose exclusive or is 0."""
    s = 0
    for place in range(1, 32):
        if value >> place - 1 & 1:
            s ^= place
    return value ^ (1 << s - 1 if s else 0)


def survivors(docs, rules=Nearness()):
    """Ids that stay of ``(id, text)``: the smallest of each group of copies, by the written rule."""
    sets = [shingles(t, rules.shingle) for _, t in docs]
    long = [prints(t, rules) for _, t in docs]
    blocks = [[home(p >> at & 0xFFFFFFFF) for p in own for at in (0, 32)] for own in long]
    p = math.acos(2 * rules.similarity / (1 + rules.similarity)) / math.pi
    n = 64 * rules.compared
    most = n * p + rules.spread * math.sqrt(n * p * (1 - p))

    def joined(linked):
        group = list(range(len(docs)))
        for a in range(len(docs)):
            for b in range(a):
                if group[a] != group[b] and linked(a, b):
                    old, new = group[a], group[b]
                    group = [new if g == old else g for g in group]
        return group

    def fits(a, b):
        return min(len(sets[a]), len(sets[b])) >= rules.similarity * max(len(sets[a]), len(sets[b]))

    def proposed(a, b):
        return sets[a] == sets[b] or (
            any(x == y for x, y in zip(blocks[a], blocks[b])) and fits(a, b)
            and sum((x ^ y).bit_count() for x, y in zip(long[a][:rules.compared], long[b][:rules.compared])) <= most)

    cluster = joined(proposed)
    group = joined(lambda a, b: sets[a] == sets[b] or (
        cluster[a] == cluster[b] and len(sets[a] & sets[b]) >= rules.similarity * len(sets[a] | sets[b])))
    least = {}
    for g, (key, _) in zip(group, docs):
        least[g] = min(least.get(g, key), key)
    return sorted(least.values())


def edited(text, draw, changes):
    words = text.split()
    for _ in range(changes):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
    return " ".join(words)


def families(seed, bases, size, words):
    """Texts, copies with few words changed, and chains of copies of copies."""
    draw, out = random.Random(seed), []
    for b in range(bases):
        base = " ".join(f"w{draw.randrange(3000)}" for _ in range(words))
        out.append(base)
        for k in range(size):
            out.append(edited(out[-1] if k % 3 else base, draw, draw.randrange(5)))
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("rules", [Nearness(), Nearness(members=3, shingles=400), Nearness(members=10**9, shingles=10**9, words=4)])
def test_equals_brute_force(spark, rules):
    docs = families(1, 4, 14, 120) + [(900, "one two"), (901, "ONE two"), (902, ""), (903, None), (904, "one two three")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert sorted(r[0] for r in without_confirmed_copies(df, rules=rules).collect()) == survivors(docs, rules)


@pytest.mark.parametrize("members", [8, 2048])
def test_near_copies_are_confirmed_by_their_shingles(spark, members):
    draw = random.Random(3)
    texts = []
    for _ in range(12):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.choice([12, 60, 200]))]
        texts.append(words)
        for share in (0.005, 0.02, 0.05, 0.1):
            texts.append([f"x{draw.randrange(5000)}" if draw.random() < share else w for w in words])
    texts = [" ".join(t) for t in texts] + ["", None, "a b c d e a b c d e a b c d e", "a b c d e a b c d e", " ".join(texts[0])]
    docs, rules = list(enumerate(texts)), Nearness(members=members)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(r["doc_id"] for r in without_confirmed_copies(df, rules=rules).collect())
    assert got == survivors(docs, rules)
    # nothing unlike goes, and nearly all that is alike does
    sets = [shingles(t, 5) for t in texts]
    alike = [(a, b) for b in range(len(docs)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert {b for _, b in alike} >= set(range(len(docs))) - set(got)
    assert len({b for _, b in alike} & set(got)) <= 0.1 * len({b for _, b in alike})


def test_parts_do_not_change_the_result(spark):
    docs = families(2, 2, 60, 80) + [(1000 + i, f"{i} " * 3 + "alone") for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    want = sorted(r[0] for r in without_confirmed_copies(df).collect())
    for members, size in ((5, 300), (2, 10**6)):
        got = without_confirmed_copies(df, rules=replace(Nearness(), members=members, shingles=size))
        assert sorted(r[0] for r in got.collect()) == want


def test_odd_rows(spark):
    text = "the quick brown fox jumps over the lazy dog near the bank"
    rows = [(2, text, "a", 1), (2, text, "b", 1), (1, text.upper(), "c", 1), (None, text, "d", 1), (7, None, "e", 1), (7, None, "f", 1),
            (8, "", "g", 1), (None, "x " * 50_000, "h", 1), (3, "other words", "i", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_key string, prints int")
    got = without_confirmed_copies(df)
    assert got.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in got.collect()) == ["1", "3", "7", "None"]
    assert without_confirmed_copies(df.limit(0)).count() == 0


def test_scratch_tables_go(spark, tmp_path):
    from shoplore.llm import near_copies
    from shoplore.session import shared_path

    kept = []
    original = near_copies.Scratch.keep
    near_copies.Scratch.keep = lambda self, df, name: (original(self, df, name), kept.append(self.paths[-1]))[0]
    try:
        df = spark.createDataFrame(families(3, 1, 4, 60), "doc_id long, text string")
        assert without_confirmed_copies(df).count() >= 1
    finally:
        near_copies.Scratch.keep = original
    from pathlib import Path
    from urllib.parse import urlparse

    assert len(kept) > 5 and not any(Path(urlparse(p).path).exists() for p in kept)
    assert shared_path(spark, "x")


def test_near_fingerprints_are_compared_whatever_anchors_the_long_ones_share(spark):
    """A pair within three bits goes to a common anchor in operator 9, but its home anchors may all differ."""
    from shoplore.llm.simhash import _simhash
    from shoplore.llm.common import words_of

    draw, docs = random.Random(8), []
    for i in range(60):
        base = " ".join(f"w{draw.randrange(9000)}" for _ in range(250))
        docs += [(2 * i, base), (2 * i + 1, edited(base, draw, 2))]
    near = {i for i, text in docs if i % 2 and (_simhash(words_of(text), 3) ^ _simhash(words_of(docs[i - 1][1]), 3)).bit_count() <= 3}
    homes = Nearness(words=1, compared=1)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    before = {r[0] for r in without_confirmed_copies(df, rules=homes).select("doc_id").collect()}
    after = {r[0] for r in without_confirmed_copies(df, rules=replace(homes, linked_bits=3)).select("doc_id").collect()}
    assert before & near and not after & near and after <= before and {i for i, _ in docs if i % 2 == 0} <= after
