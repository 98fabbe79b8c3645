"""Benchmark decontamination by greedy string tiling.

Documents and test items are joined on shared seeds, runs of ``min_match`` tokens. Where the seeds could
cover enough of an item, the item is tiled with the document: the longest unmarked matches are found
by running Karp-Rabin hashes, marked in both, and the search goes on with shorter ones. The share of
the item under tiles does not depend on the order of its passages.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplore.llm.common import in_arrow, pieces
from shoplore.session import checkpointed

_OTHER = re.compile(r"[^\w\x00-\x7f]+")
_ASCII_OTHER = bytes(b if b > 127 or chr(b).isalnum() or b == 95 else 32 for b in range(256))


@dataclass(frozen=True)
class Tiling:
    """min_match: tokens of the shortest tile, and of a seed. coverage: share of an item's tokens under
    tiles that makes a leak. Items of fewer than min_match tokens count as one tile of their own length.
    block_tokens: test tokens that are sent to the tasks at once; more are worked through in blocks."""

    min_match: int = 4
    coverage: float = 0.6
    block_tokens: int = 2_000_000


def tokens(text: str | None) -> list[bytes]:
    """Runs of letters, digits and underscores in lower case, as UTF-8. What is not ASCII is looked at
    character by character only to blank punctuation; the rest is cut by bytes."""
    if not text:
        return []
    return _OTHER.sub(" ", text.lower()).encode("utf-8", "replace").translate(_ASCII_OTHER).split()


#: Two primes below 2^31, and a base for each drawn once from a fixed seed.
_PRIMES = (2_147_483_647, 2_147_483_629)
_BASES = tuple(random.Random(20_240).randrange(1 << 20, p - 1) for p in _PRIMES)


class _Running:
    """Running Karp-Rabin hashes of a sequence: sums of token times power up to every place, modulo two
    primes, so that the hash of any window is one subtraction, brought to a common power."""

    def __init__(self, values):
        import numpy as np

        self.sums, self.back = [], []
        for prime, base in zip(_PRIMES, _BASES):
            power = _powers(base, len(values), prime)
            self.sums.append(np.concatenate([[0], np.cumsum((values + 2) % prime * power % prime)]))
            self.back.append(_powers(pow(base, -1, prime), len(values), prime))

    def windows(self, places, length: int):
        """Hashes of the windows that begin at ``places``."""
        first, second = ((s[places + length] - s[places]) % p * back[places] % p
                         for s, back, p in zip(self.sums, self.back, _PRIMES))
        return first << 31 | second


def _powers(base: int, n: int, prime: int):
    """1, base, base squared, ... modulo a prime below 2^31, by doubling."""
    import numpy as np

    out = np.ones(max(n, 1), dtype=np.int64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done:done + more] = out[:more] * pow(base, done, prime) % prime
        done += more
    return out[:n]


def greedy_tiles(item, document, min_match: int) -> list[tuple[int, int, int]]:
    """Tiles ``(place in item, place in document, length)`` of two integer arrays, longest first.

    Ties go to the earlier place in the item, then in the document. The longest unmarked match is found by
    bisection over running Karp-Rabin hashes; equal hashes are compared token by token, matches are
    marked, and the search goes on with shorter ones.
    """
    import numpy as np

    item, document = np.asarray(item, dtype=np.int64), np.asarray(document, dtype=np.int64)
    free_i, free_d = np.ones(len(item), dtype=bool), np.ones(len(document), dtype=bool)
    run_i, run_d = _Running(item), _Running(document)
    tiles: list[tuple[int, int, int]] = []
    most = min(len(item), len(document))
    while (length := _longest(run_i, run_d, free_i, free_d, min_match, most)) >= min_match:
        places, own = _open_windows(run_i, free_i, length)
        there, hashes = _open_windows(run_d, free_d, length, own)
        order = np.lexsort((there, hashes))
        there, hashes = there[order], hashes[order]
        at = dict(zip(np.unique(own).tolist(), np.searchsorted(hashes, np.unique(own)).tolist()))
        for i, h in zip(places.tolist(), own.tolist()):
            # windows that were open and overlap a tile of the same length are marked at one of their ends
            if not (free_i[i] and free_i[i + length - 1]):
                continue
            begin = at[h]
            while begin < len(there) and hashes[begin] == h and not (free_d[there[begin]] and free_d[there[begin] + length - 1]):
                begin += 1
            at[h] = begin
            while begin < len(there) and hashes[begin] == h:
                j = int(there[begin])
                if free_d[j] and free_d[j + length - 1] and (item[i:i + length] == document[j:j + length]).all():
                    free_i[i:i + length] = False
                    free_d[j:j + length] = False
                    tiles.append((i, j, length))
                    break
                begin += 1
        most = length - 1  # every match of this length is marked, or shared no more than its hash
    return tiles


def _open_windows(run: _Running, free, length: int, wanted=None):
    """Places and hashes of the windows without a marked token, only those with a wanted hash if given."""
    import numpy as np

    n = len(free) - length + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    marked = np.concatenate([[0], np.cumsum(~free)])
    place = np.flatnonzero(marked[length:] == marked[:n])
    hashes = run.windows(place, length)
    if wanted is not None:
        known = np.isin(hashes, wanted)
        place, hashes = place[known], hashes[known]
    return place, hashes


def _longest(run_i: _Running, run_d: _Running, free_i, free_d, least: int, most: int) -> int:
    """Largest length up to ``most`` at which two unmarked windows share a hash, by bisection; 0 below ``least``.
    No match is longer."""
    def shared(length):
        own = _open_windows(run_i, free_i, length)[1]
        return bool(len(own)) and bool(len(_open_windows(run_d, free_d, length, own)[0]))

    if most < least or not shared(least):
        return 0
    low, high = least, most
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if shared(middle) else (low, middle - 1)
    return low


def _seeds(values, k: int):
    """``(place, hash)`` of all runs of ``k`` tokens."""
    import numpy as np

    n = len(values) - k + 1
    return list(zip(range(n), _Running(values).windows(np.arange(n), k).tolist())) if n > 0 else []


class _Block:
    """Test items of one block: their tokens as numbers and where their seeds are."""

    def __init__(self, items: list[tuple], rules: Tiling):
        import numpy as np

        self.rules = rules
        self.keys = [key for key, _ in items]
        self.number: dict[bytes, int] = {}
        self.items = [np.array([self.number.setdefault(t, len(self.number)) for t in words], dtype=np.int64)
                      for _, words in items]
        self.begins = np.concatenate([[0], np.cumsum([len(x) for x in self.items])])
        self.seeds = {}
        for k in sorted({min(rules.min_match, len(x)) for x in self.items}):
            rows = [(h, n, i) for n, x in enumerate(self.items) if min(rules.min_match, len(x)) == k
                    for i, h in _seeds(x, k)]
            order = sorted(rows)
            self.seeds[k] = (np.array([r[0] for r in order], dtype=np.int64), np.array([r[1] for r in order]),
                             np.array([r[2] for r in order]))

    def leaks(self, text: str | None) -> list[tuple]:
        """``(item key, coverage, tiles, longest tile, tokens covered)`` of each leaked item."""
        import numpy as np

        document = np.fromiter(map(self.number.get, tokens(text), repeat(-1)), dtype=np.int64)
        out, run = [], None
        for k, (hashes, of, place) in self.seeds.items():
            n = len(document) - k + 1
            if n < 1:
                continue
            known = np.concatenate([[0], np.cumsum(document < 0)])
            begin = np.flatnonzero(known[k:] == known[:n])
            if not len(begin):
                continue
            run = run or _Running(document)
            every = run.windows(begin, k)
            h = np.unique(every)
            low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            low, high = low[high > low], high[high > low]
            if not len(low):
                continue
            hits = np.concatenate([np.arange(a, b) for a, b in zip(low, high)])
            # a tile is a union of seeds, so what the seeds cover bounds what tiles can
            spots = np.unique((self.begins[of[hits]] + place[hits])[:, None] + np.arange(k))
            items, covered = np.unique(np.searchsorted(self.begins, spots, "right") - 1, return_counts=True)
            for i, most in zip(items.tolist(), covered.tolist()):
                size = len(self.items[i])
                if min(self.rules.min_match, size) == k and most >= self.rules.coverage * size:
                    own = begin[np.isin(every, hashes[hits[of[hits] == i]])]
                    tiles = greedy_tiles(self.items[i], _only(document, own, k), k)
                    total = sum(t[2] for t in tiles)
                    if total >= self.rules.coverage * size:
                        out.append((self.keys[i], total / size, len(tiles), tiles[0][2], total))
        return out


def _only(document, begins, k: int):
    """The tokens under seeds that begin at ``begins``; what lies between two runs becomes one -1."""
    import numpy as np

    places = np.unique(begins[:, None] + np.arange(k))
    gaps = np.flatnonzero(np.diff(places) > 1) + 1
    return np.insert(document[places], gaps, -1)


def _blocks(benchmark: DataFrame, item: str, text: str, rules: Tiling) -> Iterator[list[tuple]]:
    """Test items with tokens, in blocks of bounded size; the driver holds one block at a time."""
    block, size = [], 0
    for key, body in benchmark.select(item, text).toLocalIterator():
        words = tokens(body)
        if words:
            if block and size + len(words) > rules.block_tokens:
                yield block
                block, size = [], 0
            block.append((key, words))
            size += len(words)
    if block:
        yield block


def leaked_items(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                 item_text: str = "text", rules: Tiling = Tiling()) -> DataFrame:
    """One row per document and test item that leaked into it: ``key``, ``item``, ``coverage`` (share of
    the item's tokens), ``tiles``, ``longest_tile`` and ``covered_tokens``.

    Tokens are runs of letters, digits and underscores in lower case. The test set is a stated query set: it
    goes to the tasks in blocks of bounded size, one after the other, and every document is read whole against every
    block, without a shuffle; with several blocks, the rows found for all but the last are stored. Texts that are null or without a token leak nothing, nor do such items. Repeated documents and
    items give repeated rows; null keys are kept. Other columns are not read. Without items or documents there
    are no rows.
    """
    kind, item_kind = df.schema[key].dataType, benchmark.schema[item].dataType
    schema = T.StructType([
        T.StructField(key, kind), T.StructField(item, item_kind), T.StructField("coverage", T.DoubleType()),
        T.StructField("tiles", T.IntegerType()), T.StructField("longest_tile", T.IntegerType()),
        T.StructField("covered_tokens", T.IntegerType())])
    narrow = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    found = part = shared = None
    for block in _blocks(benchmark, item, item_text, rules):
        if part is not None:  # only one block is out at a time
            part = checkpointed(part)
            found = part if found is None else found.unionByName(part)
            shared.unpersist()
        shared = df.sparkSession.sparkContext.broadcast(block)
        part = in_arrow(narrow, _search(shared, rules, item_kind, schema.names), schema)
    if part is None:
        return df.sparkSession.createDataFrame([], schema)
    return part if found is None else found.unionByName(part)


def _search(shared, rules: Tiling, item_kind, names):
    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(item_kind)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        block = _Block(shared.value, rules)
        for batch in batches:
            for part in pieces(batch):
                rows, found = [], []
                for i, body in enumerate(part.column("text").to_pylist()):
                    for leak in block.leaks(body):
                        rows.append(i)
                        found.append(leak)
                if rows:
                    columns = list(zip(*found))
                    types = [item_type, pa.float64(), pa.int32(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("key").take(pa.array(rows)), *[pa.array(c, t) for c, t in zip(columns, types)]], names)

    return run


def decontaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                   rules: Tiling = Tiling()) -> DataFrame:
    """The rows of ``df`` into whose text no test item leaked, with all their columns.

    Decided row by row without a join, so repeated rows stay or go together and null keys do not matter.
    """
    out, shared = df, None
    for block in _blocks(benchmark, item, item_text, rules):
        if shared is not None:  # only one block is out at a time
            out = checkpointed(out)
            shared.unpersist()
        shared = df.sparkSession.sparkContext.broadcast(block)
        # the text travels once, inside its row
        packed = out.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(out.columns)]).alias("row"))
        clean = in_arrow(packed, _keep(shared, rules, out.columns.index(text)),
                         T.StructType([T.StructField("row", packed.schema["row"].dataType)]))
        out = clean.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(df.columns)])
    return out


def _keep(shared, rules: Tiling, place: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        block = _Block(shared.value, rules)
        for batch in batches:
            rows = batch.column("row")
            for part in pieces(pa.RecordBatch.from_arrays([rows, rows.field(place)], ["row", "text"])):
                clean = [i for i, body in enumerate(part.column("text").to_pylist()) if not block.leaks(body)]
                if clean:
                    yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(clean, pa.int64()))], ["row"])

    return run
