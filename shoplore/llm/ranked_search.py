"""Ranked lexical search by a dual-tree walk.

Items (the queries) and documents are sparse vectors over the items' terms: an item has the terms' weights, a
document their saturated frequencies, and a score is a dot product. Both sides are put into trees whose
nodes hold the largest value of every coordinate below them, so the product of two nodes bounds all scores
between them. A pair of nodes whose bound is below the weakest k-th score among the node's items is left
out whole; nothing that could enter a list is. Documents are indexed once, map-only; the trees over
documents are built a batch at a time inside the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplore.llm.common import in_arrow, pieces, written
from shoplore.llm.licenses import word_list
from shoplore.session import checkpointed


@dataclass(frozen=True)
class Search:
    """k: rows per item. tf_scale, length_share: of the saturation ``scale * tf / (1000 * tf + 12 * m)``, where m is
    ``100 - share + share * (length of the document over the mean length)``. block_terms: terms of the items
    worked on at once; more are worked through in blocks. fanout: children of a tree node. batch_entries:
    entries of the documents in one tree. first_rows: documents, about, that give the first bounds."""

    k: int = 20
    tf_scale: int = 1_000_000_000
    length_share: int = 25
    block_terms: int = 300_000
    fanout: int = 8
    batch_entries: int = 400_000
    first_rows: int = 20_000


class Tree:
    """Levels of sparse nodes, leaves first: ``(starts, ids, values)`` with the largest value of each
    coordinate below a node, and the children of node i at ``fanout * i`` in the level before."""

    def __init__(self, starts, ids, values, fanout: int):
        import numpy as np

        self.fanout = fanout
        self.levels = [(np.asarray(starts, dtype=np.int64), np.asarray(ids, dtype=np.int64), np.asarray(values, dtype=np.int64))]
        while len(self.levels[-1][0]) - 1 > 1:
            self.levels.append(self._above(*self.levels[-1]))

    def _above(self, starts, ids, values):
        import numpy as np

        n = len(starts) - 1
        parent = np.repeat(np.arange(n) // self.fanout, np.diff(starts))
        order = np.lexsort((ids, parent))
        parent, ids, values = parent[order], ids[order], values[order]
        first = np.flatnonzero(np.concatenate([[True], (parent[1:] != parent[:-1]) | (ids[1:] != ids[:-1])])) if len(ids) else np.zeros(0, dtype=np.int64)
        most = np.maximum.reduceat(values, first) if len(ids) else values
        return np.searchsorted(parent[first], np.arange(-(-n // self.fanout) + 1)), ids[first], most

    def entries(self, level: int, nodes):
        """Starts, ids and values of the given nodes of a level, one after the other."""
        import numpy as np

        starts, ids, values = self.levels[level]
        sizes = starts[nodes + 1] - starts[nodes]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(starts[nodes] - ends[:-1], sizes) + np.arange(ends[-1])
        return ends, ids[at], values[at]


def _sums(ends, products):
    """Sum of each run between two ends, 0 for an empty run."""
    import numpy as np

    total = np.concatenate([[0], np.cumsum(products)])
    return total[ends[1:]] - total[ends[:-1]]


def likeness_order(starts, ids, values) -> list[int]:
    """Rows of sparse vectors, alike ones near each other: halves by the likeness to two unlike members,
    again and again."""
    import numpy as np

    rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    width = int(ids.max(initial=-1)) + 1
    length = np.sqrt(np.maximum(np.bincount(rows, values.astype(np.float64) ** 2, len(starts) - 1), 1e-12))

    def likeness(members, to):
        dense = np.zeros(width)
        own = slice(starts[to], starts[to + 1])
        dense[ids[own]] = values[own]
        own = [slice(starts[m], starts[m + 1]) for m in members]
        return np.array([float(values[s] @ dense[ids[s]]) for s in own]) / length[members]

    out: list[int] = []
    stack = [np.arange(len(starts) - 1)]
    while stack:
        members = stack.pop()
        if len(members) <= 2:
            out.extend(members.tolist())
            continue
        one = members[int(np.argmin(likeness(members, members[0])))]
        other = members[int(np.argmin(likeness(members, one)))]
        lean = likeness(members, one) / length[one] - likeness(members, other) / length[other]
        order = np.argsort(-lean, kind="stable")
        half = len(members) // 2
        stack += [members[order[half:]], members[order[:half]]]
    return out


class Walk:
    """Best lists of all items of a block, filled by walking document trees against the item tree."""

    def __init__(self, items: list[dict[int, int]], rules: Search, floor=None):
        import numpy as np

        starts = np.concatenate([[0], np.cumsum([len(x) for x in items])]).astype(np.int64)
        ids = np.array([t for x in items for t in x], dtype=np.int64)
        values = np.array([v for x in items for v in x.values()], dtype=np.int64)
        self.rules, self.width = rules, int(ids.max(initial=-1)) + 1
        self.place = np.array(likeness_order(starts, ids, values), dtype=np.int64)
        parts = [slice(starts[p], starts[p + 1]) for p in self.place]
        self.tree = Tree(np.concatenate([[0], np.cumsum(np.diff(starts)[self.place])]), np.concatenate([np.zeros(0, np.int64), *[ids[s] for s in parts]]),
                         np.concatenate([np.zeros(0, np.int64), *[values[s] for s in parts]]), rules.fanout)
        # a list takes scores of at least this much
        self.least = np.maximum(1, np.asarray(floor, dtype=np.int64)[self.place]) if floor is not None else np.ones(len(items), dtype=np.int64)
        self.best: list[list[tuple]] = [[] for _ in items]
        self.offers = 0  # scores that lists were offered

    def _floors(self):
        """For every node of every level the smallest score that one of its items would take."""
        import numpy as np

        out = [self.least]
        while len(out) < len(self.tree.levels):
            out.append(np.minimum.reduceat(out[-1], np.arange(0, len(out[-1]), self.rules.fanout)))
        return out

    def add(self, keys: list, starts, ids, values) -> None:
        """Walk one batch of documents: their keys and sparse vectors."""
        import numpy as np

        if not len(self.place) or not len(keys):
            return
        top = len(self.tree.levels) - 1
        dense = np.zeros(self.width, dtype=np.int64)
        # documents that match the same top nodes, and are about as long, share a node of the tree
        ends, node_ids, node_values = self.tree.entries(max(top - 1, 0), np.arange(len(self.tree.levels[max(top - 1, 0)][0]) - 1))
        match = np.zeros((len(keys), len(ends) - 1), dtype=np.int64)
        for i in range(len(keys)):
            own = slice(starts[i], starts[i + 1])
            dense[ids[own]] = values[own]
            match[i] = _sums(ends, node_values * dense[node_ids])
            dense[ids[own]] = 0
        order = np.lexsort((-match.max(axis=1), match.argmax(axis=1)))
        parts = [slice(starts[i], starts[i + 1]) for i in order]
        docs = Tree(np.concatenate([[0], np.cumsum(np.diff(starts)[order])]), np.concatenate([ids[s] for s in parts]),
                    np.concatenate([values[s] for s in parts]), self.rules.fanout)
        stack = [(len(docs.levels) - 1, 0, top, np.arange(len(self.tree.levels[top][0]) - 1))]
        floors = self._floors()
        while stack:
            level, node, depth, nodes = stack.pop()
            begin, end = docs.levels[level][0][node:node + 2]
            own = docs.levels[level][1][begin:end]
            dense[own] = docs.levels[level][2][begin:end]
            while True:  # down the item tree as far as the document node stays above
                ends, node_ids, node_values = self.tree.entries(depth, nodes)
                bound = _sums(ends, node_values * dense[node_ids])
                alive = bound >= floors[depth][nodes]
                nodes, bound = nodes[alive], bound[alive]
                if not len(nodes) or depth == 0 or depth < level:
                    break
                depth -= 1
                nodes = (nodes[:, None] * self.rules.fanout + np.arange(self.rules.fanout)).ravel()
                nodes = nodes[nodes < len(self.tree.levels[depth][0]) - 1]
            dense[own] = 0
            if not len(nodes):
                continue
            if level == 0:
                self.offers += len(nodes)
                if self._take(keys[order[node]], nodes, bound):
                    floors = self._floors()
                continue
            children = range(node * self.rules.fanout, min((node + 1) * self.rules.fanout, len(docs.levels[level - 1][0]) - 1))
            stack += [(level - 1, child, depth, nodes) for child in reversed(children)]

    def _take(self, key, items, scores) -> bool:
        """Offer a document's scores to items; whether a list's smallest score rose."""
        rose = False
        for i, score in zip(items.tolist(), scores.tolist()):
            held = self.best[i]
            held.append((-score, key is None, key))
            if len(held) >= 2 * self.rules.k or len(held) == self.rules.k:
                held.sort(key=lambda x: (x[0], x[1], x[2] if x[2] is not None else 0))
                del held[self.rules.k:]
                if -held[-1][0] > self.least[i]:
                    self.least[i] = -held[-1][0]
                    rose = True
        return rose

    def found(self) -> Iterator[tuple]:
        """``(item number, key, score)`` of what the lists hold, at most 2k - 1 an item."""
        for i, held in enumerate(self.best):
            for score, _, key in held:
                yield int(self.place[i]), key, -score


def _item_blocks(items: DataFrame, item: str, text: str, rules: Search) -> Iterator[list[tuple]]:
    """Items with their terms, in blocks of bounded size; the driver holds one block at a time."""
    block, size = [], 0
    for key, body in items.select(item, text).toLocalIterator():
        words = word_list(body)
        if block and size + len(words) > rules.block_terms:
            yield block
            block, size = [], 0
        block.append((key, words))
        size += len(words)
    if block:
        yield block


def index_documents(df: DataFrame, terms, key: str, text: str) -> DataFrame:
    """``key``, ``n`` (terms of the text, with repeats), ``ids`` and ``tfs`` of the known terms in it, for every
    text with a term. ``terms`` is a broadcast dictionary from a term to its number. No shuffle."""
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("n", T.LongType()),
                           T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        number = terms.value
        for batch in batches:
            for part in pieces(batch):
                rows, sizes, ids, tfs = [], [], [], []
                for i, body in enumerate(part.column("text").to_pylist()):
                    words = word_list(body)
                    if words:
                        found = np.fromiter(map(number.get, words, repeat(-1)), dtype=np.int32, count=len(words))
                        one, amount = np.unique(found[found >= 0], return_counts=True)
                        rows.append(i)
                        sizes.append(len(words))
                        ids.append(one)
                        tfs.append(amount.astype(np.int32))
                if rows:
                    ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("key").take(pa.array(rows)), pa.array(sizes, pa.int64()),
                         pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids))),
                         pa.ListArray.from_arrays(ends, pa.array(np.concatenate(tfs)))], ["key", "n", "ids", "tfs"])

    narrow = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return in_arrow(narrow, run, schema)


def _document_counts(index: DataFrame) -> dict[int, int]:
    """Documents that hold a term; a task hands on one number per term it met."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            met = np.bincount(batch.column("ids").flatten().to_numpy(zero_copy_only=False)) if batch.num_rows else total[:0]
            if len(met) > len(total):
                total, met = met.astype(np.int64), total
            total[:len(met)] += met
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(total[ids])], ["id", "n"])

    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("n", T.LongType())])
    counts = in_arrow(index.select("ids"), run, schema).groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: r["n"] for r in counts.collect()}


def _walked(index: DataFrame, facts, rules: Search) -> DataFrame:
    """``(item, key, score)``: for every task the best documents of each item of the block."""
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("key", index.schema["key"].dataType),
                           T.StructField("score", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        items, floor, documents, terms = facts.value
        walk = Walk(items, rules, floor)
        for batch in batches:
            at = 0
            lists = batch.column("ids")
            ends = lists.offsets.to_numpy().astype(np.int64) if batch.num_rows else np.zeros(1, np.int64)
            while at < batch.num_rows:  # as many documents as have batch_entries entries, one at least
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + rules.batch_entries, "right")) - 1)
                part = batch.slice(at, to - at)
                sizes = np.diff(ends[at:to + 1])
                tf = part.column("tfs").flatten().to_numpy().astype(np.int64)
                share = rules.length_share
                m = np.array([100 - share + share * n * documents // terms for n in part.column("n").to_pylist()], dtype=np.int64)
                value = rules.tf_scale * tf // (1000 * tf + 12 * np.repeat(m, sizes))
                walk.add(part.column("key").to_pylist(), np.concatenate([[0], np.cumsum(sizes)]),
                         part.column("ids").flatten().to_numpy().astype(np.int64), value)
                at = to
        rows = list(walk.found())
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], schema_type),
                 pa.array([r[2] for r in rows], pa.int64())], schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    schema_type = to_arrow_type(schema["key"].dataType)
    return in_arrow(index, run, schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each item with their rank; first within groups of tasks, then over all."""
    order = [F.desc("score"), F.col("key").asc_nulls_last()]
    grouped = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    some = (grouped.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order)))
            .filter(F.col("rank") <= k).drop("rank", "part"))
    return (some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
            .filter(F.col("rank") <= k))


def ranked_search(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", rules: Search = Search()) -> DataFrame:
    """``item``, ``rank`` (from 1), ``key`` and ``score`` of the ``k`` best documents of each item, those with a
    score above 0; equal scores go by the smaller key, null keys last.

    Terms are runs of digits, letters and whatever is not ASCII, A-Z in lower case; texts that are null or
    without a term are no documents. Repeated documents take a place each, and repeated items are answered
    one by one. Without items or documents there are no rows. The items are a stated query set: they go to the
    tasks in blocks of bounded size, one block after the other. Per block the documents are read once, into a
    stored index of the block's terms, which then serves the document counts, the first bounds (the k-th scores
    among about ``first_rows`` documents are never above those among all) and the walk over every document.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    kind, item_kind = df.schema[key].dataType, items.schema[item].dataType
    schema = T.StructType([T.StructField(item, item_kind), T.StructField("rank", T.IntegerType()),
                           T.StructField(key, kind), T.StructField("score", T.LongType())])
    result = None
    for block in _item_blocks(items, item, item_text, rules):
        number: dict[bytes, int] = {}
        for _, words in block:
            for w in words:
                number.setdefault(w, len(number))
        if not number:
            continue
        shared = context.broadcast(number)
        index = written(index_documents(df, shared, key, text), "search-index")
        size = index.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
        if not size["n"]:
            return spark.createDataFrame([], schema)
        counts = _document_counts(index)
        weight = {i: math.floor(1000 * math.log((2 * size["n"] + 2) / (2 * counts.get(i, 0) + 1))) for i in number.values()}
        vectors = []
        for _, words in block:
            vector: dict[int, int] = {}
            for w in words:
                vector[number[w]] = vector.get(number[w], 0) + weight[number[w]]
            vectors.append(vector)
        shared.unpersist()
        one_in = max(1, size["n"] // rules.first_rows)
        some = index.filter(F.pmod(F.xxhash64("key", "n"), F.lit(one_in)) == 0)
        facts = context.broadcast((vectors, None, size["n"], size["l"]))
        floor = [0] * len(vectors)
        for r in _best(_walked(some, facts, rules), rules.k).filter(F.col("rank") == rules.k).collect():
            floor[r["item"]] = r["score"]
        facts.unpersist()
        facts = context.broadcast((vectors, floor, size["n"], size["l"]))
        best = checkpointed(_best(_walked(index, facts, rules), rules.k))
        facts.unpersist()
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)],
                                      T.StructType([T.StructField("item", T.IntegerType()), T.StructField("name", item_kind)]))
        part = best.join(names, "item").select(F.col("name").alias(item), F.col("rank").cast("int").alias("rank"),
                                               F.col("key").alias(key), "score")
        result = part if result is None else result.unionByName(part)
    return spark.createDataFrame([], schema) if result is None else result
