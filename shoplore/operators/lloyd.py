"""K-means for many numbers of clusters and restarts at once: every model takes its step in the same pass."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplore.session import checkpointed

_ROWS = 4096


@dataclass(frozen=True)
class Points:
    """Stored blocks of up to 4,096 rows: ``x`` (their features, row after row, as bytes of doubles, so that a pass hands
    Python whole blocks and turns no row into objects), ``u`` (hashes that stay with the rows) and ``g`` (the group of
    tasks whose sums meet first); the mean that is taken off before distances are worked out, and the mean variance of
    a feature."""

    blocks: DataFrame
    mean: np.ndarray
    n: int
    first: np.ndarray
    groups: int
    variance: float

    def summed(self, work: Callable) -> np.ndarray:
        """Sum over all rows of ``work(x) -> vector`` for a matrix of rows less the mean. A task hands on one
        vector, the executors add them up, in two levels if there are more than a few tasks, and the driver gets one."""
        mean = self.mean

        def part(batches: Iterator) -> Iterator:
            import pyarrow as pa

            total, group = None, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                group = batch.column("g")[0].as_py()
                for block in batch.column("x"):
                    found = work(_matrix(block, len(mean)) - mean)
                    total = found if total is None else total + found
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["g", "v"])

        added = vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")
        sums = self.blocks.select("x", "g").mapInArrow(part, "g int, v array<double>")
        if self.groups > 1:
            sums = sums.groupBy("g").agg(added)
        return sums.agg(added).toArrow()["v"].combine_chunks().flatten().to_numpy()

    def drawn(self, centres: np.ndarray, share: float, turn: int) -> np.ndarray:
        """Distinct rows, less the mean, each taken with the chance ``share`` times its squared distance to the
        nearest centre. The chance comes from the row's hash, so a task that runs again takes the same."""
        mean = self.mean

        def part(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                for block, hashes in zip(batch.column("x"), batch.column("u")):
                    raw, u = _matrix(block, len(mean)), np.frombuffer(hashes.as_buffer(), np.uint64)
                    with np.errstate(over="ignore"):
                        u = (u ^ u >> np.uint64(31)) * np.uint64((0x9E3779B97F4A7C15 * (2 * turn + 1)) % (1 << 64))
                    chance = (u >> np.uint64(11)).astype(np.float64) / (1 << 53)
                    taken = raw[chance < share * _gaps(raw - mean, centres).min(axis=1)]
                    if len(taken):
                        yield pa.RecordBatch.from_arrays([pa.array(list(taken), pa.list_(pa.float64()))], ["x"])

        found = self.blocks.select("x", "u").mapInArrow(part, "x array<double>").distinct().toArrow()["x"].to_pylist()
        return np.array(sorted(found), dtype=np.float64).reshape(-1, len(mean)) - mean


def _matrix(block, width: int) -> np.ndarray:
    """The rows of a block."""
    return np.frombuffer(block.as_buffer(), np.float64).reshape(-1, width)


def _blocks(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            yield pa.RecordBatch.from_arrays([
                pa.array([part.column("x").flatten().to_numpy().tobytes()], pa.binary()),
                pa.array([part.column("u").to_numpy().tobytes()], pa.binary()), part.column("g").slice(0, 1)], ["x", "u", "g"])


@contextmanager
def stored_points(df: DataFrame, features: Sequence[str], seed: int):
    """The rows of ``df`` as :class:`Points`, kept for as long as the block runs. A missing value is an error."""
    values = [F.col(f).cast("double") for f in features]
    bad = F.raise_error(F.concat(F.lit("a feature has no value: "), F.to_json(F.struct(*features))))
    whole = [F.when(v.isNull() | F.isnan(v), bad.cast("double")).otherwise(v) for v in values]
    kept = checkpointed(df.select(F.array(*whole).alias("x"), F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)).alias("u")))
    groups = math.isqrt(kept.rdd.getNumPartitions() // 8) or 1
    grouped = kept.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(groups)))
    blocks = grouped.mapInArrow(_blocks, "x binary, u binary, g int").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        facts = kept.agg(F.count(F.lit(1)).alias("n"), F.min_by("x", "u").alias("first"),
                         *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(len(features))],
                         *[F.var_pop(F.col("x")[i]).alias(f"v{i}") for i in range(len(features))]).first()
        if not facts["n"]:
            raise ValueError("no rows to cluster")
        mean = np.array([facts[f"m{i}"] for i in range(len(features))])
        yield Points(blocks, mean, facts["n"], np.array([facts["first"]]) - mean, groups,
                     sum(facts[f"v{i}"] for i in range(len(features))) / len(features))
    finally:
        blocks.unpersist()


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    gaps = (-2 * x) @ centres.T
    gaps += (x * x).sum(axis=1)[:, None]
    gaps += (centres * centres).sum(axis=1)
    return np.maximum(gaps, 0, out=gaps)


def _nearest(x: np.ndarray, centres: np.ndarray, sizes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of every row and model (``sizes`` centres one after the other) the place of the nearest centre and the
    squared distance to it. One model at a time, a line of distances per centre: a few long vector operations in
    the cache, where a minimum over the few centres of every row is a call per row."""
    across = np.ascontiguousarray(x.T)
    squares = (across * across).sum(axis=0)
    places, least = np.empty((len(sizes), len(x)), dtype=np.int64), np.empty((len(sizes), len(x)))
    begin = 0
    for place, best, size in zip(places, least, sizes):
        found = np.zeros(len(x), dtype=np.int32)
        own = centres[begin:begin + size]
        gaps = (-2 * own) @ across
        gaps += squares
        gaps += (own * own).sum(axis=1)[:, None]
        np.maximum(gaps, 0, out=gaps)
        best[:] = gaps[0]
        for j in range(1, size):
            np.maximum(found, (gaps[j] < best) * np.int32(j), out=found)  # the later place is the greater one
            np.minimum(best, gaps[j], out=best)
        np.add(found, begin, out=place)
        begin += size
    return places.T, least.T


def _step(points: Points, models: Sequence[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The means of the rows nearest to each centre (a centre without rows stays), and the costs before."""
    centres, sizes = np.concatenate(models), [len(m) for m in models]
    width = centres.shape[1]

    def work(x):
        places, least = _nearest(x, centres, sizes)
        flat = places.T.ravel()
        columns = [np.bincount(flat, minlength=len(centres))]
        columns += [np.bincount(flat, np.tile(x[:, j], len(sizes)), len(centres)) for j in range(width)]
        return np.concatenate([np.stack(columns).ravel(), least.sum(axis=0)])

    found = points.summed(work)
    table, costs = found[:len(centres) * (width + 1)].reshape(width + 1, -1), found[len(centres) * (width + 1):]
    moved = np.where(table[0] > 0, table[1:] / np.maximum(table[0], 1), centres.T).T
    return np.split(moved, np.cumsum(sizes)[:-1]), costs


def _pool(points: Points, most: int, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Candidates for centres, shared by all models, and the rows nearest to each: every round takes about
    ``4 * most`` rows, each with a chance in proportion to its squared distance to those taken before."""
    pool = points.first
    for turn in range(rounds):
        cost = points.summed(lambda x: np.array([_gaps(x, pool).min(axis=1).sum()]))[0]
        if cost <= 0:
            break
        pool = np.unique(np.concatenate([pool, points.drawn(pool, 4 * most / cost, turn)]), axis=0)
    held = points.summed(lambda x: np.bincount(_gaps(x, pool).argmin(axis=1), minlength=len(pool)).astype(float))
    return pool, held


def _seeded(pool: np.ndarray, held: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ on the weighted candidates; fewer centres if there are no more."""
    draw = np.random.default_rng([seed, k])
    chosen = [int(draw.choice(len(pool), p=held / held.sum()))]
    gaps = _gaps(pool, pool[chosen])[:, 0]
    while len(chosen) < k and (gaps * held).sum() > 0:
        chosen.append(int(draw.choice(len(pool), p=gaps * held / (gaps * held).sum())))
        gaps = np.minimum(gaps, _gaps(pool, pool[chosen[-1:]])[:, 0])
    return pool[chosen]


@dataclass(frozen=True)
class Fit:
    """Centres, the sum of squared distances to them, steps taken, and whether the last moved them no further
    than the tolerance."""

    centres: np.ndarray
    cost: float
    steps: int
    converged: bool


def sweep(points: Points, ks: Sequence[int], restarts: int, seed: int, iterations: int, tolerance: float) -> dict[int, list[Fit]]:
    """For every k the fits of all restarts. A pass moves the centres of every model that has not settled: whose
    last step moved them, in all, by a squared distance of over ``tolerance`` times the mean variance."""
    pool, held = _pool(points, max(ks))
    jobs = [(k, r) for k in ks for r in range(restarts)]
    centres = [_seeded(pool, held, k, seed + r) for k, r in jobs]
    steps, open_ = [0] * len(jobs), list(range(len(jobs)))
    for _ in range(iterations):
        if not open_:
            break
        moved, _ = _step(points, [centres[i] for i in open_])
        still = []
        for i, new in zip(open_, moved):
            far = ((new - centres[i]) ** 2).sum()
            centres[i], steps[i] = new, steps[i] + 1
            if far > tolerance * points.variance:
                still.append(i)
        open_ = still
    costs = _step(points, centres)[1]
    found: dict[int, list[Fit]] = {k: [] for k in ks}
    for i, (k, _) in enumerate(jobs):
        found[k].append(Fit(centres[i] + points.mean, float(costs[i]), steps[i], i not in open_))
    return found


def squared_silhouettes(points: Points, models: Sequence[np.ndarray]) -> list[float]:
    """Mean silhouette under squared Euclidean distance of every model, in two passes for all of them: a row's
    mean squared distance to a cluster follows from the cluster's size, sum and sum of squares."""
    models = [m - points.mean for m in models]
    centres, sizes = np.concatenate(models), [len(m) for m in models]
    width, begins = centres.shape[1], np.cumsum([0, *sizes])

    def facts(x):
        places = _nearest(x, centres, sizes)[0].ravel()
        columns = [np.bincount(places, minlength=len(centres)), np.bincount(places, np.repeat((x * x).sum(axis=1), len(sizes)), len(centres))]
        columns += [np.bincount(places, np.repeat(x[:, j], len(sizes)), len(centres)) for j in range(width)]
        return np.stack(columns).ravel().astype(float)

    table = points.summed(facts).reshape(width + 2, -1)
    n, squares, sums = table[0], table[1], table[2:]

    def scores(x):
        places = _nearest(x, centres, sizes)[0]
        total = n * (x * x).sum(axis=1)[:, None] + squares - 2 * x @ sums
        out, every = [], np.arange(len(x))
        for m in range(len(sizes)):
            own = slice(begins[m], begins[m + 1])
            mine, of = places[:, m], n[places[:, m]]
            a = np.maximum(total[every, mine], 0) / np.maximum(of - 1, 1)
            means = np.where(n[own] > 0, np.maximum(total[:, own], 0) / np.maximum(n[own], 1), np.inf)
            means[every, mine - begins[m]] = np.inf
            b = means.min(axis=1)
            with np.errstate(invalid="ignore"):
                s = np.where((of > 1) & np.isfinite(b) & (np.maximum(a, b) > 0), (b - a) / np.maximum(a, b), 0.0)
            out.append(s.sum())
        return np.array(out)

    return [float(s) / points.n for s in points.summed(scores)]


@dataclass(frozen=True)
class Bounded:
    """A value known to lie within ``bound`` of the true one."""

    value: float
    bound: float


def _cells(points: Points, centres: np.ndarray, sizes: Sequence[int], width: float, most: int) -> np.ndarray | None:
    """One row per cluster and ball cell: cluster, rows, centroid, mean squared distance to the centroid, ordered by
    cluster; None if there are more than ``most``. Tasks and the shuffle merge rows into cells."""
    mean, dims = points.mean, len(points.mean)

    def part(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for block in batch.column("x"):
                x = _matrix(block, dims) - mean
                at = np.floor(x / width)
                inside = x - (at + 0.5) * width  # from the middle of the cell, so that squares lose no digits
                sums = np.concatenate([np.ones((len(x), 1)), inside, (inside * inside).sum(axis=1)[:, None]], axis=1)
                for place in _nearest(x, centres, sizes)[0].T:
                    keys, of = np.unique(np.concatenate([place[:, None], at], axis=1), axis=0, return_inverse=True)
                    table = np.stack([np.bincount(of.ravel(), c, len(keys)) for c in sums.T], axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(list(keys), pa.list_(pa.float64())), *[pa.array(c) for c in table.T]],
                                                     ["cell", *[f"v{j}" for j in range(dims + 2)]])

    names = [f"v{j}" for j in range(dims + 2)]
    found = (points.blocks.select("x").mapInArrow(part, "cell array<double>, " + ", ".join(f"{c} double" for c in names))
             .groupBy("cell").agg(*[F.sum(c).alias(c) for c in names]).limit(most + 1).toArrow())
    if found.num_rows > most:
        return None
    keys = found["cell"].combine_chunks().flatten().to_numpy().reshape(-1, dims + 1)
    values = np.stack([found[c].to_numpy() for c in names], axis=1)
    middle = values[:, 1:-1] / values[:, :1]
    spread = np.maximum(values[:, -1] / values[:, 0] - (middle * middle).sum(axis=1), 0)
    table = np.concatenate([keys[:, :1], values[:, :1], (keys[:, 1:] + 0.5) * width + middle, spread[:, None]], axis=1)
    return table[np.lexsort(table.T[::-1])]


def euclidean_silhouettes(points: Points, models: Sequence[np.ndarray], tolerance: float = 1e-3,
                          parts: int = 16, most_cells: int = 1 << 18) -> list[Bounded]:
    """Mean silhouette under Euclidean distance of every model, each with a bound on its error.

    The rows of a cluster are merged into ball cells: number, centroid c and mean squared distance v to it. The mean
    distance from a row to the members of a cell is at least d = |x - c|, as a norm is convex, and at most
    sqrt(d * d + v), as a root is concave. Summed over cells this bounds a row's mean distance to every cluster, and so
    its silhouette. Cells are halved until every bound is at most ``tolerance``, or would be more than ``most_cells``;
    then the bounds reached are returned, which say so. No pairs of rows are made: a pass costs rows times cells, and the
    cells a bound needs do not grow with the rows, but do with the features. Rows alone in a cluster, and rows
    without another cluster, have a silhouette of 0.
    """
    models = [m - points.mean for m in models]
    centres, sizes = np.concatenate(models), [len(m) for m in models]
    begins = np.cumsum([0, *sizes])
    best = [Bounded(0.0, 1.0)] * len(models)
    while max(b.bound for b in best) > tolerance:
        table = _cells(points, centres, sizes, 4 * math.sqrt(points.variance or 1.0) / parts, most_cells)
        if table is None:
            break
        exact = not table[:, -1].any()
        place = table[:, 0].astype(int)
        n = np.bincount(place, table[:, 1], len(centres))

        def sides(x, m):
            """Least and greatest sum of distances from the rows to the members of every cluster of model ``m``."""
            out = np.zeros((2, len(x), sizes[m]))
            for j in range(sizes[m]):
                own = table[place == begins[m] + j]
                gaps = _gaps(x, own[:, 2:-1])
                out[0, :, j] = np.sqrt(gaps) @ own[:, 1]
                out[1, :, j] = np.sqrt(gaps + own[:, -1]) @ own[:, 1]
            return out

        def scores(x):
            total = np.zeros(2 * len(sizes))
            for at in range(0, len(x), 256):
                rows = x[at:at + 256]
                places, every = _nearest(rows, centres, sizes)[0], np.arange(len(rows))
                for m in range(len(sizes)):
                    sums, count = sides(rows, m), n[begins[m]:begins[m + 1]]
                    mine = places[:, m] - begins[m]
                    a = sums[:, every, mine] / np.maximum(count[mine] - 1, 1)
                    means = np.where(count > 0, sums / np.maximum(count, 1), np.inf)
                    means[:, every, mine] = np.inf
                    b = means.min(axis=2)
                    for side in (0, 1):  # low: nearest others as near, own as far as can be
                        u, v = b[side], a[1 - side]
                        with np.errstate(invalid="ignore", divide="ignore"):
                            s = np.where((count[mine] > 1) & np.isfinite(u) & (np.maximum(u, v) > 0), (u - v) / np.maximum(u, v), 0.0)
                        total[2 * m + side] += s.sum()
            return total

        low, high = (points.summed(scores) / points.n).reshape(-1, 2).T
        best = [Bounded(float(a + b) / 2, float(b - a) / 2) for a, b in zip(low, high)]
        if exact:
            break
        parts *= 2
    return best
