"""Near duplicates by SimHash, found through anchor points of a covering code.

A fingerprint is cut into blocks so that two fingerprints within the limit differ in at most one bit
of some block. The anchors of a block are the words of a perfect Hamming code (bits left over are kept
as they are): every value lies within one bit of exactly one anchor, its home. A value is replicated
to every anchor within covering radius plus threshold, two bits, so the home of one of the pair is
always among the anchors of the other. A block of 32 bits has 2^27 anchors, and a value goes to at
most 17 of them. Fingerprints are compared only with those at the same anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplore.llm.common import fresh, in_arrow, per_text, words_of
from shoplore.llm.components import connected_components
from shoplore.session import checkpointed

#: A busier anchor is compared in cells of two parts of about so many fingerprints each.
CELL = 2048
_CHUNK = 1 << 16


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3,
                 out: str = "fingerprint") -> DataFrame:
    """``key`` and a 64-bit SimHash (as a signed long) of a text's shingles, repeats included.

    A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, a shingle is ``shingle`` words joined by
    spaces (all words of a shorter text) and hashed by XXH64 with seed 42. A bit is set if it is set in
    over half of the hashes. A text without words, or null, has fingerprint 0. No shuffle.
    """
    def make():
        def work(texts):
            return [[_simhash(words_of(t), shingle) for t in texts]]

        return work

    return per_text(df, key, text, [T.StructField(out, T.LongType())], make)


def _hashes(words: list[bytes], shingle: int) -> Iterator:
    """Hashes of the shingles in order, in arrays of bounded size."""
    import numpy as np
    import xxhash

    words = [w.lower() for w in words]
    n, digest = max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest
    for at in range(0, n if words else 0, _CHUNK):
        part = words[at:min(at + _CHUNK, n) + shingle - 1]
        joined = map(b" ".join, zip(*[part[k:] for k in range(shingle)])) if n > 1 or len(words) >= shingle else [b" ".join(words)]
        yield np.fromiter((digest(s, 42) for s in joined), dtype="<u8")


def _simhash(words: list[bytes], shingle: int) -> int:
    import numpy as np

    ones, n = np.zeros(64, dtype=np.int64), 0
    for hashes in _hashes(words, shingle):
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _shingle_set(words: list[bytes], shingle: int):
    """The distinct hashes of the shingles, ascending."""
    import numpy as np

    return np.unique(np.concatenate([np.zeros(0, dtype="<u8"), *_hashes(words, shingle)]))


def fingerprint_hex(column: str | Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.col(column) if isinstance(column, str) else column), 16, "0"))


def blocks(max_bits: int) -> list[tuple[int, int]]:
    """Offset and width of the blocks: as few as leave one differing bit to some block."""
    n = max_bits // 2 + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def syndrome(value: Column, r: int) -> Column:
    """Place (from 1) of the bit in which a value differs from the nearest word of the Hamming code of ``2^r - 1``
    bits, 0 for a word of the code."""
    length = (1 << r) - 1
    masks = [sum(1 << (i - 1) for i in range(1, length + 1) if i >> j & 1) for j in range(r)]
    return sum((F.bit_count(value.bitwiseAND(F.lit(m))).bitwiseAND(F.lit(1)) * (1 << j) for j, m in enumerate(masks)),
               F.lit(0)).cast("int")


def anchored(prints: DataFrame, fingerprint: str, max_bits: int = 3) -> DataFrame:
    """``(anchor, fingerprint)``: every value at every anchor within two bits, in every block."""
    parts = []
    for number, (offset, width) in enumerate(blocks(max_bits)):
        r = (width + 1).bit_length() - 1
        length = (1 << r) - 1
        masks = [sum(1 << (i - 1) for i in range(1, length + 1) if i >> j & 1) for j in range(r)]
        value = f"(shiftrightunsigned(`{fingerprint}`, {offset}) & {(1 << width) - 1}L)" if width < 64 else f"`{fingerprint}`"
        syndrome = " + ".join(f"shiftleft(bit_count(w & {m}L) & 1, {j})" for j, m in enumerate(masks))
        free = ", ".join(f"h ^ shiftleft(1L, {i})" for i in range(length, width))
        near = (f"transform(filter(sequence(1, {length}), i -> s <> 0 AND i <> s AND i < (i ^ s)), "
                f"i -> w ^ shiftleft(1L, i - 1) ^ shiftleft(1L, (i ^ s) - 1))")
        parts.append(
            prints.select(F.col(fingerprint), F.expr(value).alias("w"))
            .select("*", F.expr(syndrome).alias("s"))
            .select("*", F.expr("if(s = 0, w, w ^ shiftleft(1L, s - 1))").alias("h"))
            .select(F.col(fingerprint), F.explode(F.expr(f"concat(array(h{', ' + free if free else ''}), {near})")).alias("a"))
            .select(F.struct(F.lit(number).alias("block"), F.col("a").alias("at")).alias("anchor"), F.col(fingerprint)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def near_links(prints: DataFrame, fingerprint: str = "fingerprint", max_bits: int = 3,
               cell: int = CELL) -> DataFrame:
    """``(left, right)``: links between distinct fingerprints, at most one less than there are
    fingerprints per anchor, that connect whatever fingerprints within ``max_bits`` connect.

    ``prints`` holds distinct fingerprints. Anchors with one fingerprint are left out. An anchor with
    more than ``cell`` of them is split into parts by hash, and every two parts meet in a cell of
    their own, so no task holds more than a few parts, and none is skipped.
    """
    near = anchored(prints, fingerprint, max_bits)
    busy = near.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = near.join(busy, "anchor").select(
        "anchor", F.col(fingerprint).alias("f"), F.ceil(F.col("n") / cell).cast("int").alias("k"))
    met = (met.withColumn("mine", F.pmod(F.xxhash64("f"), F.col("k")).cast("int"))
           .select("anchor", "f", "k", "mine", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
           .select("f", F.struct("anchor", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
                   .alias("c")))
    dealt = (met.select(F.col("c.anchor.block").alias("block"), F.col("c.anchor.at").alias("at"),
                        F.col("c.i").alias("i"), F.col("c.j").alias("j"), "f")
             .repartition("block", "at", "i", "j").sortWithinPartitions("block", "at", "i", "j"))
    schema = T.StructType([T.StructField("left", T.LongType()), T.StructField("right", T.LongType())])
    return in_arrow(dealt, _forest(max_bits), schema).distinct()


def _forest(max_bits: int):
    """Streams sorted cells and gives the edges of a spanning forest of each."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def edges(keys, f):
            group = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))])
            root, place = np.arange(len(f)), np.arange(len(f))
            ends = np.searchsorted(group, group, side="right")
            begins = np.searchsorted(group, group, side="left")
            found, lag = [], 1
            while True:
                place = place[:np.searchsorted(place, len(f) - lag)]
                place = place[ends[place] > place + lag]
                if not len(place):
                    return found
                hit = place[np.bitwise_count(f[place] ^ f[place + lag]) <= max_bits]
                for i in hit[root[hit] != root[hit + lag]].tolist():
                    a, b = root[i], root[i + lag]
                    if a != b:
                        own = root[begins[i]:ends[i]]
                        own[own == b] = a
                        found.append((i, i + lag))
                lag += 1

        def links(keys, f):
            pairs = np.array(edges(keys, f), dtype=np.int64).reshape(-1, 2)
            signed = f.view(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(signed[pairs[:, 0]]), pa.array(signed[pairs[:, 1]])], ["left", "right"])

        held_keys, held_f = np.zeros((0, 4), dtype=np.int64), np.zeros(0, dtype=np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            held_keys = np.concatenate([held_keys, np.stack(columns[:4], axis=1)])
            held_f = np.concatenate([held_f, columns[4].view(np.uint64)])
            last = np.flatnonzero((held_keys != held_keys[-1]).any(axis=1))
            done = last[-1] + 1 if len(last) else 0
            if done:
                yield links(held_keys[:done], held_f[:done])
                held_keys, held_f = held_keys[done:], held_f[done:]
        if len(held_f):
            yield links(held_keys, held_f)

    return run


def simhash_components(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3,
                       max_bits: int = 3) -> DataFrame:
    """``key``, ``fingerprint`` (long) and ``component_id``, the smallest key that can be reached over
    links of at most ``max_bits`` differing bits, itself included.

    One row per row: repeated rows and copies meet in one fingerprint before any comparison. Texts
    without words, and null texts, share fingerprint 0 and are linked like any other. Null keys are
    passed over when the smallest key is sought; a component without a key has a null id. Other columns
    are not read. An empty table gives an empty table.
    """
    prints = checkpointed(fingerprints(df.select(key, text), key, text, shingle))
    least = prints.groupBy("fingerprint").agg(F.min(key).alias("least"))
    links = near_links(least.select("fingerprint"), max_bits=max_bits)
    linked = connected_components(links)
    named = least.join(linked, least["fingerprint"] == linked["vertex"], "left").select(
        "fingerprint", "least", F.coalesce("component", "fingerprint").alias("component"))
    roots = (named.groupBy("component").agg(F.min("least").alias("component_id")))
    classes = named.join(roots, "component").select("fingerprint", "component_id")
    return prints.join(classes, "fingerprint").select(key, "fingerprint", "component_id")


def without_near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3,
                        max_bits: int = 3) -> DataFrame:
    """One row of each component, the one with the smallest key, with all its columns.

    Null keys come last; rows with equal keys are told apart by their texts, and of rows that repeat
    both one stays. The survivors' rows cross the network once, by key and text hash.
    """
    k, h = fresh(df.columns, "row_key", "text_hash")
    # a null key must join and must not look like an empty one
    named = df.withColumns({k: F.coalesce(F.concat(F.lit("k"), F.col(f"`{key}`").cast("string")), F.lit("")),
                            h: F.xxhash64(F.col(f"`{text}`"))})
    rank = F.struct(F.col(f"`{key}`").isNull().alias("no_key"), F.col(f"`{key}`").alias("key"), F.col(k).alias("k"), F.col(h).alias("h"))
    prints = checkpointed(fingerprints(named.select(rank.alias("rank"), F.col(f"`{text}`").alias("text")), "rank", "text", shingle))
    least = prints.groupBy("fingerprint").agg(F.min("rank").alias("least"))
    linked = connected_components(near_links(least.select("fingerprint"), max_bits=max_bits))
    stay = (least.join(linked, least["fingerprint"] == linked["vertex"], "left")
            .groupBy(F.coalesce("component", "fingerprint").alias("component")).agg(F.min("least").alias("stays"))
            .select(F.col("stays.k").alias(k), F.col("stays.h").alias(h)))
    return named.join(stay, [k, h], "left_semi").dropDuplicates([k, h]).select(*[F.col(f"`{c}`") for c in df.columns])
