"""From customer profiles to segments."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplore.operators.clustering import (Clustering, elbow, kmeans_sweep, melt, silhouette,
                                           silhouette_exact_points)
from shoplore.operators.quality import group_profile, numeric_gate
from shoplore.operators.scaling import SCALERS, apply_scale

MEASURES = ("recency", "frequency", "monetary")


def check_measures(profile: DataFrame, measures: Sequence[str] = MEASURES) -> None:
    """Refuse profiles with missing or negative measures."""
    bad = numeric_gate(profile, measures).filter("nulls > 0 or negatives > 0").collect()
    if bad:
        raise ValueError(f"measures with missing or negative values: {[r['measure'] for r in bad]}")


def scaled_profile(profile: DataFrame, scaler: str = "box-cox",
                   measures: Sequence[str] = MEASURES) -> DataFrame:
    """The profile with ``norm_<measure>`` columns."""
    return apply_scale(profile, SCALERS[scaler](profile, measures))


@dataclass(frozen=True)
class Choice:
    """What each k costs and scores, and the k at the elbow and of the highest silhouette."""

    sweep: dict[int, Clustering]
    costs: dict[int, float]
    silhouettes: dict[int, float]

    @property
    def by_elbow(self) -> int:
        return elbow(self.costs)

    @property
    def by_silhouette(self) -> int:
        return max(self.silhouettes, key=self.silhouettes.__getitem__)


def choose_k(df: DataFrame, features: Sequence[str], ks: Sequence[int] = range(2, 9),
             restarts: int = 10, seed: int = 808) -> Choice:
    sweep = kmeans_sweep(df, features, ks, restarts, seed)
    return Choice(sweep, {k: c.cost for k, c in sweep.items()},
                  {k: silhouette(c.label(df), features) for k, c in sweep.items()})


@dataclass(frozen=True)
class Segments:
    clustering: Clustering
    labelled: DataFrame
    profile: DataFrame
    long: DataFrame


def segment(df: DataFrame, key: str, features: Sequence[str], k: int = 6, restarts: int = 10,
            seed: int = 808, measures: Sequence[str] = MEASURES) -> Segments:
    """Cluster on ``features`` (scaled measures or scores) and describe the clusters by ``measures``."""
    model = kmeans_sweep(df, features, [k], restarts, seed)[k]
    labelled = model.label(df)
    return Segments(model, labelled, group_profile(labelled, "cluster", measures),
                    melt(labelled, [key, "cluster"], measures))


def exact_silhouette(labelled: DataFrame, features: Sequence[str], cluster: str = "cluster",
                     values: Sequence[float] = (1, 2, 3, 4, 5)) -> DataFrame:
    """One row with the mean Euclidean silhouette, for features that take only the declared values."""
    points = silhouette_exact_points(labelled, features, cluster, values)
    return points.agg((F.sum(F.col("silhouette") * F.col("n")) / F.sum("n")).alias("silhouette"))
