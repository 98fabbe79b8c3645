from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoplore.llm import bpe, common, language, pu_quality, quality_rules, shards, tiling, toxicity
from shoplore.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


# quality rules

def brute_repeats(words, width=5):
    windows = [tuple(words[i:i + width]) for i in range(len(words) - width + 1)]
    counts = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(width)})


@pytest.mark.parametrize("width", [1, 2, 3, 5, 8])
def test_repeated_words_equal_brute_force(width):
    rng = random.Random(width)
    for _ in range(300):
        words = [rng.choice([b"a", b"b", b"c"][:rng.randint(1, 3)]) for _ in range(rng.randint(0, 30))]
        assert quality_rules.repeated_words(words, width) == brute_repeats(words, width)


def test_quality_rules_on_odd_rows(spark):
    line = "The quick brown fox jumps over the lazy dog near the old river bank today."
    menu = "Home | News | Sport | Weather | Travel | Culture | More | About | Help | Contact"
    texts = {1: None, 2: "", 3: " \n\t", 4: line, 5: line + "\n" + menu, 6: line + "\n" + "\n".join([menu] * 9),
             7: "STOP!! NOW!! " * 20, 8: "a\u00a0b " * 12, 9: line * 400, None: line}
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in texts.items()] + [(4, line, "x", 1)],
                               "doc_id long, text string, n_words string, kept int")
    got = {(r["doc_id"]): r for r in quality_rules.quality_rules(df).collect()}
    assert [k for k in texts if got[k]["kept"]] == [4, 5, None]
    assert (got[1]["n_words"], got[2]["n_words"], got[3]["n_words"], got[8]["n_words"]) == (0, 0, 0, 12)
    assert got[1]["base_failed"] and got[5]["n_lost_lines"] == 1
    kept = quality_rules.clean_lines(df, n_chars=None)
    assert kept.columns == df.columns and rows(kept, "text", "n_words", "kept") == [(line, "x", 1)] * 4
    assert quality_rules.clean_lines(df.limit(0)).count() == 0


def test_clean_documents_stay_and_junk_goes(spark):
    found = QUERIES["op2_quality_rules"].run(spark, MEDIUM).join(spark.read.parquet(f"{MEDIUM}/labels.parquet"), "doc_id")
    share = {r["quality"]: r["share"] for r in found.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share[1] > 0.95 and share[0] < 0.05


# tokens

@pytest.fixture(scope="module")
def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_bpe_equals_the_library(spark, tokenizer_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path)
    rng = random.Random(5)
    pool = [chr(c) for c in [*range(0x250), 0x2028, 0x3000, 0x85, 0x1680, 0x200B, 0x1F600, 0x4E2D, 0x301, 0x660, 0x1C]]
    pool += ["<|endoftext|>", "'s", "'re", "  ", "\n\n", " the", "ing"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    texts += ["", "a" * 5000, "ab" * 3000, "word " * 4000, "<|endoftext|>", " <|endoftext|> x"]
    texts += [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None), (None, "x")], "doc_id long, text string")
    tokenizer = bpe.load_tokenizer(spark, tokenizer_path)
    encoded = bpe.bpe_encode(df, tokenizer)
    got = {r["doc_id"]: r for r in bpe.bpe_decode(encoded, tokenizer, out="back").collect()}
    digests = {r["doc_id"]: r for r in bpe.bpe_digest(df, tokenizer).collect()}
    for i, (text, want) in enumerate(zip(texts, library.encode_batch(texts, add_special_tokens=False))):
        assert got[i]["ids"] == want.ids and got[i]["n_tokens"] == len(want.ids)
        assert got[i]["back"] == library.decode(want.ids, skip_special_tokens=False)
        assert digests[i]["ids_sha256"] == hashlib.sha256(np.array(want.ids, dtype="<u4").tobytes()).hexdigest()
        assert digests[i]["decoded_sha256"] == hashlib.sha256(got[i]["back"].encode()).hexdigest()
    assert got[-1]["ids"] == [] and got[None]["n_tokens"] == 1
    assert bpe.bpe_digest(df.limit(0), tokenizer).count() == 0


def test_bpe_forgets_and_cuts_without_a_difference(tokenizer_path, monkeypatch):
    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as file:
        coder = bpe.ByteBpe(file.read())
    text = " ".join(f"word{i} Ünder{i} 12{i}" for i in range(3000))
    want = Tokenizer.from_file(tokenizer_path).encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "REMEMBERED", 100)
    monkeypatch.setattr(bpe, "SEGMENT", 500)
    monkeypatch.setattr(bpe, "SHORT", 5)
    assert np.frombuffer(coder.encode([text])[0], dtype="<u4").tolist() == want


# language

def test_language_on_held_out_documents(spark):
    got = QUERIES["op5_language"].run(spark, MEDIUM).join(spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got) and len(held) > 100
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98


def test_language_profile_is_the_stated_product():
    space = language.Space(dims=64, n=3)
    text = "Ab1 b"
    letters = [0, ord("a"), ord("b"), 0, ord("b"), 0]
    want = sum(np.roll(language._letter(space, a).astype(int), 2) * np.roll(language._letter(space, b).astype(int), 1)
               * language._letter(space, c) for a, b, c in zip(letters, letters[1:], letters[2:]))
    assert language._bundle(space, [language._grams(text, 3)])[0].astype(int).tolist() == want.tolist()


def test_language_edge_cases(spark):
    df = spark.createDataFrame([(1, None, "en", "z"), (2, "", "en", "z"), (3, "12 34 !", "en", "z"), (4, "the cat and the dog", "en", "z"),
                                (6, "der hund und die katze", "de", "z"), (None, "the dog", None, "z"), (4, "the cat and the dog", "en", "z"),
                                (7, "x", None, "z")], "doc_id long, text string, lang string, lang_pred string")
    got = rows(language.language_predictions(df.fillna({"doc_id": -1}), held=9), "doc_id", "lang_pred")
    assert got == [(-1, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (6, "de"), (7, got[-1][1])]
    assert {r["lang_pred"] for r in language.language_predictions(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.language_predictions(df.limit(0)).count() == 0
    assert language.known_language(df, language.fit_languages(df)).columns == df.columns


# quality and toxicity models

def area(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


def test_quality_scores_on_held_out_labels(spark):
    got = QUERIES["op1_quality"].run(spark, MEDIUM).join(spark.read.parquet(f"{MEDIUM}/labels.parquet"), "doc_id").collect()
    held = [(r["score"], r["quality"]) for r in got if r["held_out"]]
    assert area(held) > 0.97 and np.mean([(s >= 0.5) == y for s, y in held]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_prior_and_edge_cases_of_quality(spark):
    good = "A sentence of plain words that ends well. " * 3
    docs = [(i, good + f"Number {i} here.", "x") for i in range(80)] + [(i, "BUY!! NOW!! $$$ " * 9, "x") for i in range(80, 100)]
    df = spark.createDataFrame(docs + [(None, good, "x"), (200, None, "x"), (201, "", "x"), (1, good, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(3, 1), (None, 1), (5, None)], "doc_id long, quality int")
    measured = pu_quality.text_measures(df)
    model = pu_quality.fit_pu(measured, labels.select("doc_id"))
    assert 0.7 < model.prior < 0.9
    got = pu_quality.quality_scores(df, labels).collect()
    assert len(got) == 104 and all(0 <= r["score"] <= 1 for r in got)
    junk = [r["score"] for r in got if r["doc_id"] is not None and 80 <= r["doc_id"] < 100]
    assert max(junk) < 0.5 < min(r["score"] for r in got if r["doc_id"] is not None and r["doc_id"] < 80)
    assert {r["score"] for r in pu_quality.quality_scores(df, labels.limit(0)).collect()} == {0.5}
    assert pu_quality.quality_scores(df.limit(0), labels).count() == 0


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    got = QUERIES["op6_toxicity"].run(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    held = [(r["score"], r["toxic"]) for r in got if r["held_out"]]
    assert area(held) > 0.95 and np.mean([(s >= 0.3) == y for s, y in held]) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_obfuscated_terms_are_found():
    settings = toxicity.ToxicitySettings()
    place = toxicity.FEATURES.index
    for text in ("you id1ot here", "such an i-d-i-o-t you are", "what an idiooot", "i d i o t you", "an 1d1ot!"):
        found = toxicity.toxicity_features(text, {"idiot": 5.0}, settings)
        assert found[place("hidden_hits")] >= 1 and found[place("obfuscated")] > 0, text
    plain = toxicity.toxicity_features("You IDIOT, a clever one", {"idiot": 5.0}, settings)
    assert plain[place("term_hits")] == 1 and plain[place("near_second_person")] == 1 and plain[place("shouted_words")] > 0
    assert toxicity.toxicity_features(None, {}, settings) == toxicity.toxicity_features(" ", {}, settings)


def test_toxicity_edge_cases(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "hello there", "x"), (3, "hello there", "x"), (None, "you fool", "x")],
                               "doc_id long, text string, capitals string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.toxicity_scores(df, none).collect()] == [0.0] * 5
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 1), (9, 0), (None, 1), (2, None), (2, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(df, labels, held=9).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity_scores(df.limit(0), labels).count() == 0


# leaks

def brute_tiles(a, b, least):
    free_a, free_b, tiles = [True] * len(a), [True] * len(b), []
    while True:
        best, found = least, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and free_a[i + k] and free_b[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best:
                    found.append((i, j))
        if not found:
            return tiles
        for i, j in found:
            if all(free_a[i:i + best]) and all(free_b[j:j + best]):
                free_a[i:i + best] = free_b[j:j + best] = [False] * best
                tiles.append((i, j, best))


def test_tiles_equal_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(0, 25))] for _ in range(2))
        assert tiling.greedy_tiles(a, b, 3) == brute_tiles(a, b, 3)


def test_leaks_equal_brute_force_and_catch_reordered_passages(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    words = tiling.tokens(items[0][1])
    docs.append((10_001, "Before. " + b" ".join(words[12:] + [b"between"] + words[:12]).decode().upper() + ", after."))
    docs += [(10_002, None), (10_003, ""), (None, items[1][1]), (10_004, items[2][1]), (10_004, items[2][1])]
    items += [(900, None), (901, "!!"), (902, "zz1 zz2")]
    docs.append((10_005, "so ZZ1, zz2 it is"))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("coverage", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((str(r["doc_id"]), r["item_id"], round(r["coverage"], 9), r["tiles"]) for r in tiling.leaked_items(df, bench).collect()))
    want = []
    for i, text in items:
        a = tiling.tokens(text)
        for d, body in docs:
            b = tiling.tokens(body)
            if a and len(set(a) & set(b)) >= 0.3 * len(set(a)):
                tiles = brute_tiles(a, b, min(4, len(a))) if len(b) < 400 or any(b[j:j + 4] == a[k:k + 4] for k in range(0, len(a), 4) for j in range(len(b))) else []
                if sum(t[2] for t in tiles) >= 0.6 * len(a):
                    want.append((str(d), i, round(sum(t[2] for t in tiles) / len(a), 9), len(tiles)))
    assert got == sorted(want)
    assert ("10001", items[0][0]) in [g[:2] for g in got] and ("10005", 902) in [g[:2] for g in got]
    blocked = tiling.leaked_items(df, bench, rules=tiling.Tiling(block_tokens=100))
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in blocked.collect()) == sorted(g[:2] for g in got)
    clean = tiling.decontaminated(df, bench)
    assert clean.columns == df.columns
    left = Counter(str(r["doc_id"]) for r in clean.collect())
    assert left == Counter(str(d) for d, _ in docs) - Counter({d: 2 if d == "10004" else 1 for d, *_ in got})
    assert tiling.leaked_items(df.limit(0), bench).count() == 0 and tiling.leaked_items(df, bench.limit(0)).count() == 0


# shards

def test_hypergeometric_draws_have_the_right_spread():
    rng = np.random.default_rng(3)
    drawn = [shards.hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert abs(np.mean(drawn) - 6) < 0.12 and abs(np.var(drawn) - 20 * 0.3 * 0.7 * 80 / 99) < 0.3
    assert shards.hypergeometric(rng, 0, 5, 3) == 0 and shards.hypergeometric(rng, 5, 0, 3) == 3
    big = shards.hypergeometric(rng, 3 * 10**12, 7 * 10**12, 10**9)
    assert abs(big - 3 * 10**8) < 10**5
    matrix = shards.communication_matrix([7, 0, 100, 13], [40, 40, 40], 1)
    assert [sum(x) for x in matrix] == [7, 0, 100, 13] and [sum(x) for x in zip(*matrix)] == [40, 40, 40]


@pytest.mark.parametrize("n, parts", [(0, 1), (1, 1), (15, 4), (1003, 7), (5000, 3)])
def test_shards_have_exact_sizes_and_gapless_slots(spark, n, parts):
    df = spark.range(0, n, 1, parts).select(F.when(F.col("id") % 5 > 0, F.col("id")).alias("doc_id"), F.lit("x").alias("shard"), F.lit(None).cast("string").alias("part"))
    got = shards.shuffle_into_shards(df)
    assert got.columns == ["doc_id", "shard", "part", "shard_", "slot"]
    found = got.collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r["doc_id"] for r in df.collect())
    by_shard = {}
    for r in found:
        by_shard.setdefault(r["shard_"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert [len(by_shard.get(s, [])) for s in range(16)] == shards.shard_sizes(n, 16)


def test_shuffle_looks_uniform(spark):
    found = shards.shuffle_into_shards(spark.range(0, 16_000, 1, 5)).collect()
    place = np.zeros(16_000)
    for r in found:
        place[r["id"]] = r["shard"] * 1000 + r["slot"]
    assert abs(np.corrcoef(np.arange(16_000), place)[0, 1]) < 0.04
    table = np.zeros((16, 16))
    for r in found:
        table[r["id"] // 1000, r["shard"]] += 1
    assert 150 < ((table - 62.5) ** 2 / 62.5).sum() < 320  # chi-square with 225 degrees of freedom


def test_sharding_of_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = QUERIES["op10_shards"].run(spark, SMALL)
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()
    for r in found.collect():
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


def test_unlearned_scripts_have_no_language(spark):
    import random

    from shoplore.llm.language import fit_languages, known_language

    rng = random.Random(1)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    made = [(i, " ".join("".join(chr(rng.randrange(a, b)) for _ in range(rng.randrange(2, 9))) for _ in range(200)))
            for i, (a, b) in enumerate([(0x430, 0x450), (0x3b1, 0x3c9), (0x4e00, 0x9000)] * 15)]
    profiles = fit_languages(docs)
    assert known_language(spark.createDataFrame(made, "doc_id long, text string"), profiles).count() == 0
    long = docs.filter("size(split(trim(text), ' ')) >= 10")
    assert known_language(long, profiles).count() == long.count()


def test_tiling_ends_on_colliding_runs():
    """Thue-Morse runs collide under any polynomial modulo 2^64; tiles are those of brute force all the same."""
    run = [bin(i).count("1") % 2 for i in range(1024)]
    item, document = run, [1 - x for x in run] + [5] + run[:1023]
    got = tiling.greedy_tiles(item, document, 4)
    assert got[0] == (0, 1025, 1023) and sum(t[2] for t in got) == 1023
    short = [bin(i).count("1") % 2 for i in range(64)]
    assert tiling.greedy_tiles(short, [1 - x for x in short] + [5] + short[:63], 4) == brute_tiles(short, [1 - x for x in short] + [5] + short[:63], 4)
    rules = tiling.Tiling()
    block = tiling._Block([(1, [b"ab"[x:x + 1] for x in run])], rules)
    assert block.leaks(" ".join("abxxxc"[x] for x in document))[0][:2] == (1, 1023 / 1024)


def test_equal_hashes_are_compared(monkeypatch):
    """With hashes that say nothing, the tokens still decide and the search still ends."""
    monkeypatch.setattr(tiling._Running, "windows", lambda self, places, length: np.zeros(len(places), dtype=np.int64))
    draw = np.random.default_rng(5)
    for _ in range(30):
        a, b = draw.integers(0, 3, draw.integers(1, 14)), draw.integers(0, 3, draw.integers(1, 20))
        assert tiling.greedy_tiles(a, b, 3) == brute_tiles(a, b, 3)


def test_windows_of_any_length_cost_the_same():
    import time

    draw = np.random.default_rng(6)
    run, free = tiling._Running(draw.integers(0, 10**6, 200_000)), np.ones(200_000, dtype=bool)

    def seconds(length):
        best = 9.0
        for _ in range(5):
            begun = time.perf_counter()
            tiling._open_windows(run, free, length)
            best = min(best, time.perf_counter() - begun)
        return best

    assert seconds(1024) < 2 * seconds(4)


def test_language_memory_of_a_text_with_many_letters():
    import tracemalloc

    draw = np.random.default_rng(7)
    text = "".join(map(chr, draw.integers(0x4E00, 0x9FA5, 400_000)))  # 1.2 MB
    space = language.Space()
    tracemalloc.start()
    ids, amounts = language._grams(text, space.n)
    language._bundle(space, [(ids, amounts)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(ids) > 390_000 and peak < 200e6


def test_slices_of_a_batch_are_bounded_by_bytes():
    import pyarrow as pa

    texts = ["x" * 3000, None, "", "y" * 9000, "z", "z" * 2500, "w" * 100] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["key", "text"])
    parts = list(common.pieces(batch, rows=4, most_bytes=4000))
    assert [x for p in parts for x in p.column("text").to_pylist()] == texts
    assert all(p.num_rows == 1 or (p.num_rows <= 4 and sum(len(x or "") for x in p.column("text").to_pylist()) <= 4000) for p in parts)


def test_all_language_predictions_equal_the_definition(spark):
    """Vectors letter by letter, profiles and cosines in plain loops, for every text of the smallest table."""
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()][:120]
    docs += [(1000, None, "en"), (1001, "12 34", "en"), (1002, "a", None)]
    space = language.Space(dims=128)

    def letter(c):
        return np.random.default_rng([space.seed, ord(c)]).integers(0, 2, space.dims, dtype=np.int8).astype(int) * 2 - 1 if c.isalpha() else \
            np.random.default_rng([space.seed, 0]).integers(0, 2, space.dims, dtype=np.int8).astype(int) * 2 - 1

    cached = {}

    def vector(text):
        letters = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        while "  " in letters:
            letters = letters.replace("  ", " ")
        total = np.zeros(space.dims)
        grams = [letters[i:i + 3] for i in range(len(letters) - 2)]
        for g in grams:
            if g not in cached:
                cached[g] = np.roll(letter(g[0]), 2) * np.roll(letter(g[1]), 1) * letter(g[2])
            total += cached[g]
        return total, len(grams)

    profiles = {}
    for key, text, lang in docs:
        if text and lang and zlib.crc32(str(key).encode()) % 5 != 0 and any(c.isalpha() for c in text):
            total, n = vector(text)
            profiles[lang] = profiles.get(lang, 0) + total / n
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.language_predictions(df, space=space).collect()}
    assert len(got) == len(docs)
    for key, text, _ in docs:
        r = got[key]
        assert r["held_out"] == (zlib.crc32(str(key).encode()) % 5 == 0)
        if not text or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        total, _ = vector(text)
        cosines = {lang: total @ p / np.linalg.norm(total) / np.linalg.norm(p) for lang, p in profiles.items()}
        best = max(cosines, key=cosines.get)
        assert abs(r["score"] - min(1, max(0, cosines[best]))) < 1e-4
        assert r["lang_pred"] == best or abs(cosines[best] - cosines[r["lang_pred"]]) < 1e-5
