"""Text quality from trusted positives and unlabelled web text (positive-unlabelled learning).

A linear score of dense text measures is fitted by minimising the non-negative unbiased risk

    prior * E_p[l(z)] + max(0, E_u[l(-z)] - prior * E_p[l(-z)]),    l(z) = log(1 + exp(-z)),

over all trusted positives and all texts. The class prior is estimated first, from how the scores of a
plain positive-against-unlabelled fit are spread in both sets.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplore.llm.common import fold, in_arrow, per_text, words_of
from shoplore.llm.quality_rules import BLANKS, repeated_words
from shoplore.session import checkpointed

MEASURES = (
    "log_words", "word_length", "longest_word", "capitals", "non_ascii", "digits", "exclaims", "symbols", "commas",
    "stops", "no_letter_words", "distinct_words", "same_as_before", "repeated_windows", "repeated_lines",
    "words_a_line", "sentence_lines", "ends_well")

_SENTENCE_END = re.compile(r"[.!?…][\"'”’»)\]]*[ \t\r\x0b\x0c]*$")


def measures(text: str | None) -> list[float]:
    """The dense measures of one text, in the order of ``MEASURES``; a text without words has zeros."""
    import numpy as np

    words = words_of(text)
    if not words:
        return [0.0] * len(MEASURES)
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    table = np.bincount(raw, minlength=256)
    upper = int(table[65:91].sum())
    lower = int(table[97:123].sum())
    high = int(table[128:].sum())
    chars = max(1, len(text) - sum(map(text.count, BLANKS)))
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    before = sum(a == b for a, b in zip(words, words[1:]))

    def share(characters):
        return sum(int(table[ord(c)]) for c in characters) / chars

    return [
        float(np.log1p(n)), min(chars / n, 50.0), float(np.log1p(max(map(len, words)))),
        upper / max(1, upper + lower), high / len(raw), share("0123456789"), share("!?"), share("#*$%&|<>=+~^_@\\{}[]"),
        share(",;:"), share("."), sum(not w.isalpha() and not any(c > 127 or chr(c).isalpha() for c in w) for w in words) / n,
        len(set(words)) / n ** 0.9, before / n, repeated_words(words, 5) / n, 1 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))), sum(bool(_SENTENCE_END.search(x)) for x in lines) / len(lines),
        float(bool(_SENTENCE_END.search(lines[-1])))]


@dataclass(frozen=True)
class PuModel:
    """Scores are sigmoid(bias + weights . (measure - mean) / scale), measures cut to 6 deviations. ``slope`` is the
    largest derivative of the risk left at the weights, ``converged`` whether the search ended by itself."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    bias: float
    weights: tuple[float, ...]
    prior: float
    slope: float = 0.0
    converged: bool = True


@dataclass(frozen=True)
class PuSettings:
    """ridge: weight of the squared weights. passes: most passes over the rows of a fit. tolerance: a
    fit ends when no weight moves by more. cells: cells of the histogram the prior is read from.
    least_share: share of the positives that must lie above a cut for it to bound the prior."""

    ridge: float = 1e-3
    passes: int = 25
    tolerance: float = 1e-3
    cells: int = 400
    least_share: float = 0.3


def _columns(names=MEASURES):
    return [F.col(n) for n in names]


def text_measures(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and one column per measure; no shuffle."""
    def make():
        def work(texts):
            return [list(c) for c in zip(*map(measures, texts))]

        return work

    return per_text(df, key, text, [T.StructField(n, T.DoubleType()) for n in MEASURES], make)


def _standard(batch, mean, scale):
    """Measures of an Arrow batch in deviations, with a leading 1, and the column ``positive``."""
    import numpy as np

    x = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in MEASURES], axis=1)
    x = np.clip((x - mean) / scale, -6, 6)
    return np.concatenate([np.ones((len(x), 1)), x], axis=1)


def _sums(data: DataFrame, mean, scale, weights, fields: int, add) -> list[float]:
    """Sum of ``add(x, z, positive)``, a vector, over all rows; a task hands on one vector."""
    width = len(MEASURES) + 1

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total = np.zeros(fields)
        for batch in batches:
            if batch.num_rows:
                x = _standard(batch, np.array(mean), np.array(scale))
                positive = batch.column("positive").to_numpy(zero_copy_only=False).astype(bool)
                total += add(x, x @ np.array(weights), positive)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

    assert len(weights) == width
    parts = in_arrow(
        data.select(*MEASURES, "positive"), run, T.StructType([T.StructField("sums", T.ArrayType(T.DoubleType()))]))
    rows = (parts.select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))).collect()
    out = [0.0] * fields
    for r in rows:
        out[r["i"]] = r["x"]
    return out


def _risk_sums(width: int):
    """Per row set (unlabelled: all rows; positive): count, loss as negative, gradient, curvature."""
    def add(x, z, positive):
        import numpy as np

        out = []
        s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        loss = np.logaddexp(0, z)
        for rows in (slice(None), positive):
            a, p, v = x[rows], s[rows], z[rows]
            out += [len(a), loss[rows].sum(), v.sum(), *(p @ a), *a.sum(axis=0), *((a * (p * (1 - p))[:, None]).T @ a).ravel()]
        return np.array(out)

    return add, 2 * (3 + 2 * width + width * width)


class _Sums:
    """What one pass over the rows says about a set of rows, as means."""

    def __init__(self, values, width):
        import numpy as np

        self.n = values[0]
        m = max(1.0, values[0])
        self.negative, self.z = values[1] / m, values[2] / m
        self.grad = np.array(values[3:3 + width]) / m
        self.mean = np.array(values[3 + width:3 + 2 * width]) / m
        self.curve = np.array(values[3 + 2 * width:]).reshape(width, width) / m


class _Minimum(NamedTuple):
    weights: list[float]
    slope: float
    converged: bool


def _minimise(data: DataFrame, mean, scale, settings: PuSettings, objective) -> _Minimum:
    """Newton steps with halving on ``objective(u, p, weights) -> value, gradient, curvature, uphill``.

    The lowest point met whose negative part is not below zero is returned, not the last one; the start, with all
    weights zero, is such a point. A search that the negative part turns back until the passes are used up has not
    converged."""
    import numpy as np

    width = len(MEASURES) + 1
    add, fields = _risk_sums(width)
    ridge = np.full(width, settings.ridge)
    ridge[0] = 0

    def at(w):
        values = _sums(data, mean, scale, w.tolist(), fields, add)
        half = len(values) // 2
        value, grad, curve, clipped = objective(_Sums(values[:half], width), _Sums(values[half:], width), w)
        if clipped:  # the negative part fell below zero: step back along its gradient instead
            return value, grad, np.eye(width), True
        return value + 0.5 * (ridge * w * w).sum(), grad + ridge * w, curve + np.diag(ridge + 1e-9), False

    w = np.zeros(width)
    value, grad, curve, clipped = at(w)
    best, ended = (value, w, grad), False
    for _ in range(settings.passes):
        step = -0.1 * grad if clipped else -np.linalg.solve(curve, grad)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        new = at(w + step)
        while not clipped and not new[3] and new[0] > value + 1e-9 and np.abs(step).max() > settings.tolerance:
            step = step / 2
            new = at(w + step)
        w, (value, grad, curve, clipped) = w + step, new
        if not clipped and value <= best[0]:
            best = (value, w, grad)
        if np.abs(step).max() <= settings.tolerance:
            ended = not clipped
            break
    return _Minimum(best[1].tolist(), float(np.abs(best[2]).max()), ended)


def _plain(u: _Sums, p: _Sums, w):
    """Positives against all texts, both sets weighing the same."""
    return ((p.negative - p.z) + u.negative, (p.grad - p.mean) + u.grad, p.curve + u.curve, False)


def _non_negative(prior: float):
    def objective(u: _Sums, p: _Sums, w):
        rest = u.negative - prior * p.negative
        if rest < 0:
            return rest, -(u.grad - prior * p.grad), None, True
        # l(z) - l(-z) = -z, so the sum is convex
        return u.negative - prior * p.z, u.grad - prior * p.mean, u.curve, False

    return objective


def _prior(data: DataFrame, mean, scale, weights, settings: PuSettings) -> float:
    """Least ratio, over cuts, of the share of all texts above it to the share of positives above it.

    Above the scores of negatives both shares differ by the prior alone. The ratio is read with one
    deviation added, so that a chance dip does not set it."""
    import numpy as np

    cells = settings.cells

    def add(x, z, positive):
        place = np.clip(((np.tanh(z / 4) + 1) / 2 * cells).astype(int), 0, cells - 1)
        return np.concatenate([np.bincount(place, minlength=cells), np.bincount(place[positive], minlength=cells)])

    values = np.array(_sums(data, mean, scale, weights, 2 * cells, add))
    above = values.reshape(2, cells)[:, ::-1].cumsum(axis=1)
    totals = above[:, -1]
    share = above / np.maximum(totals[:, None], 1)
    ok = share[1] >= settings.least_share
    spread = np.sqrt(share * (1 - share) / np.maximum(totals[:, None], 1))
    ratio = (share[0] + spread[0])[ok] / np.maximum(share[1] - spread[1], 1e-9)[ok]
    return float(min(0.999, max(0.001, ratio.min(initial=0.999))))


def fit_pu(measured: DataFrame, positives: DataFrame, key: str = "doc_id", settings: PuSettings = PuSettings()) -> PuModel | None:
    """Fit on ``measured`` (see :func:`text_measures`), all of it unlabelled, and the keys in ``positives``.

    Every row counts; a pass hands on one vector of sums per task. Null keys are unlabelled. Without
    positives or without texts there is no model.
    """
    flagged = measured.join(positives.select(F.col(key)).dropna().distinct().withColumn("positive", F.lit(True)), key, "left")
    data = checkpointed(flagged.select(*MEASURES, F.coalesce("positive", F.lit(False)).alias("positive")))
    first = data.agg(F.count(F.lit(1)).alias("n"), F.count_if("positive").alias("p"),
                     *[F.avg(n).alias(f"m_{n}") for n in MEASURES], *[F.stddev_pop(n).alias(f"s_{n}") for n in MEASURES]).first()
    if not first["n"] or not first["p"]:
        return None
    mean = [first[f"m_{n}"] for n in MEASURES]
    scale = [max(first[f"s_{n}"] or 0.0, 1e-6) for n in MEASURES]
    prior = _prior(data, mean, scale, _minimise(data, mean, scale, settings, _plain).weights, settings)
    found = _minimise(data, mean, scale, settings, _non_negative(prior))
    if not found.converged:
        warnings.warn(f"the risk still fell after {settings.passes} passes (slope {found.slope:.2g})", stacklevel=2)
    return PuModel(tuple(mean), tuple(scale), found.weights[0], tuple(found.weights[1:]), prior, found.slope, found.converged)


def pu_scores(measured: DataFrame, model: PuModel | None, score: str = "score") -> DataFrame:
    """``measured`` with a score from 0 to 1; 0.5 without a model."""
    if model is None:
        return measured.withColumn(score, F.lit(0.5))
    z = F.lit(model.bias)
    for name, m, s, w in zip(MEASURES, model.mean, model.scale, model.weights):
        z = z + F.lit(w) * F.greatest(F.lit(-6.0), F.least(F.lit(6.0), (F.col(name) - m) / s))
    return measured.withColumn(score, 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z)))))


def quality_scores(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
                   folds: int = 3, held: int = 1, settings: PuSettings = PuSettings()) -> DataFrame:
    """``key``, ``held_out``, ``score`` and ``predicted`` (1 from 0.5 on) for every row of ``df``.

    Trusted positives are the keys outside the held-out fold whose labels are all 1; labels of 0 are not
    used. All texts count as unlabelled. A null or empty text has measures of zero and a score like any
    other. Repeated rows get a row each; a null key is unlabelled and not held out. Without positives
    all scores are 0.5. Other columns are not read.
    """
    measured = checkpointed(text_measures(df.select(key, text), key, text))
    trusted = (labels.filter(fold(key, folds) != held).groupBy(key).agg(F.min(label).alias("least"))
               .filter("least = 1").select(key))
    model = fit_pu(measured, trusted, key, settings)
    return pu_scores(measured, model).select(
        key, F.coalesce(fold(key, folds) == held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
