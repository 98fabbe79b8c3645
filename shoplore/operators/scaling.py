"""Scaling of numeric columns. Each fit ends in a few numbers, which are applied as literals."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplore.operators.ordered import exact_quantiles
from shoplore.session import checkpointed


def _double(column: str) -> Column:
    return F.col(column).cast("double")


@dataclass(frozen=True)
class Shift:
    """``(value - centre) / scale``, after an optional power transform."""

    centre: float
    scale: float
    power: float | None = None

    def __call__(self, column: Column) -> Column:
        value = column.cast("double")
        if self.power is not None:
            value = box_cox(value, self.power)
        return (value - F.lit(self.centre)) / F.lit(self.scale)


def apply_scale(df: DataFrame, fitted: Mapping[str, Shift], out: str = "norm_{}") -> DataFrame:
    """Add the scaled columns, named by the pattern ``out``."""
    return df.withColumns({out.format(c): shift(F.col(c)) for c, shift in fitted.items()})


def fit_standard(df: DataFrame, columns: Sequence[str]) -> dict[str, Shift]:
    """Mean and population standard deviation; a constant column is only centred."""
    row = df.agg(*[f(_double(c)).alias(f"{n}{i}") for i, c in enumerate(columns)
                   for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: Shift(row[f"m{i}"], row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def fit_robust(df: DataFrame, columns: Sequence[str]) -> dict[str, Shift]:
    """Median and distance between the quartiles, both exact."""
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    return {c: Shift(mid, (high - low) or 1.0) for c, (low, mid, high) in quartiles.items()}


def box_cox(value: Column, power: float) -> Column:
    """``(x^power - 1) / power``, the logarithm at 0."""
    logarithm = F.log(value)
    if power == 0:
        return logarithm
    return F.expm1(logarithm * F.lit(power)) / F.lit(power)


#: Powers whose likelihood one pass works out.
BATCH = 24


def _centred_logs(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict[str, tuple[int, float]]]:
    """``ln x`` less its mean; refuses values that are not positive and constant columns."""
    checks = df.agg(*[e.alias(f"{n}{i}") for i, c in enumerate(columns) for n, e in (
        ("n", F.count(c)), ("low", F.min(_double(c))), ("high", F.max(_double(c))),
        ("log", F.avg(F.when(_double(c) > 0, F.log(_double(c))))))]).first()
    facts = {}
    for i, c in enumerate(columns):
        if not checks[f"n{i}"]:
            raise ValueError(f"{c} has no values")
        if checks[f"low{i}"] <= 0:
            raise ValueError(f"{c} holds values that are not positive")
        if checks[f"low{i}"] == checks[f"high{i}"]:
            raise ValueError(f"{c} is constant")
        facts[c] = (checks[f"n{i}"], checks[f"log{i}"])
    # read once for every batch of powers
    logs = checkpointed(df.select(*[(F.log(_double(c)) - F.lit(facts[c][1])).alias(c) for c in columns]))
    return logs, facts


def _log_likelihoods(logs: DataFrame, facts: Mapping[str, tuple[int, float]],
                     grids: Mapping[str, Sequence[float]]) -> dict[str, list[float]]:
    """Profile log-likelihood of every power of every column's grid. A pass works out the variances of
    ``BATCH`` powers side by side, so no row is multiplied and the generated code stays small.

    With z = ln x - m and m the mean log, the value is -n m - n/2 ln var((e^(power z) - 1) / power);
    the centring keeps the powers within range.
    """
    wanted = [(c, k, float(p)) for c, grid in grids.items() for k, p in enumerate(grid)]
    found = {}
    for begin in range(0, len(wanted), BATCH):
        part = wanted[begin:begin + BATCH]
        spreads = [F.col(c) if p == 0 else F.expm1(F.col(c) * p) / p for c, _, p in part]
        row = logs.agg(*[F.var_pop(s).alias(f"v{i}") for i, s in enumerate(spreads)]).first()
        found |= {(c, k): row[f"v{i}"] for i, (c, k, _) in enumerate(part)}
    return {c: [-facts[c][0] * facts[c][1] - facts[c][0] / 2 * math.log(found[c, k])
                for k in range(len(grid))] for c, grid in grids.items()}


def box_cox_log_likelihood(df: DataFrame, column: str, powers: Sequence[float]) -> DataFrame:
    """``(power, loglik)`` for a list of powers."""
    logs, facts = _centred_logs(df, [column])
    values = _log_likelihoods(logs, facts, {column: powers})[column]
    return df.sparkSession.createDataFrame(
        [(float(p), v) for p, v in zip(powers, values)], "power double, loglik double")


def fit_box_cox_powers(df: DataFrame, columns: Sequence[str], low: float = -2.0, high: float = 2.0,
                       finest: float = 1e-3) -> dict[str, float]:
    """The power of greatest likelihood per column.

    A grid of step 0.1 is moved while its best point lies at an end, then narrowed tenfold until the
    step is ``finest``; the top of the parabola through the best three points is the answer. Every
    round is one aggregate over the data for all columns together.
    """
    logs, facts = _centred_logs(df, columns)
    step = 0.1
    points = round((high - low) / step)
    start = {c: low for c in columns}
    best: dict[str, float] = {}
    for _ in range(100):
        grids = {c: [round(start[c] + i * step, 10) for i in range(points + 1)] for c in columns}
        values = _log_likelihoods(logs, facts, grids)
        top = {c: max(range(points + 1), key=values[c].__getitem__) for c in columns}
        at_end = [c for c in columns if top[c] in (0, points)]
        if at_end:
            for c in at_end:
                start[c] = grids[c][top[c]] - points // 2 * step
            continue
        if step <= finest:
            for c in columns:
                left, mid, right = values[c][top[c] - 1:top[c] + 2]
                bend = left - 2 * mid + right
                best[c] = grids[c][top[c]] + (step * (left - right) / (2 * bend) if bend else 0.0)
            return best
        step, points = step / 10, 20
        start = {c: grids[c][top[c]] - 10 * step for c in columns}
    raise ValueError(f"no power of greatest likelihood found for {columns}")


def fit_box_cox(df: DataFrame, columns: Sequence[str],
                powers: Mapping[str, float] | None = None) -> dict[str, Shift]:
    """Fitted power, then mean and population standard deviation of the transformed values."""
    powers = powers or fit_box_cox_powers(df, columns)
    changed = df.select(*[box_cox(_double(c), powers[c]).alias(c) for c in columns])
    moments = fit_standard(changed, columns)
    return {c: Shift(moments[c].centre, moments[c].scale, powers[c]) for c in columns}


SCALERS: dict[str, Callable[[DataFrame, Sequence[str]], dict[str, Shift]]] = {
    "standard": fit_standard,
    "robust": fit_robust,
    "box-cox": fit_box_cox,
}
