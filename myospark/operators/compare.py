"""Tracked sarcomeres against those of single frames, by bootstrap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.signals import bootstrap_angles, bootstrap_means
from ..storage import spread

FRAME = ["movie_id", "frame"]
RUNS = 1000
SHARES = [0.0, 0.25, 0.5, 0.75, 1.0]


def _seed(seed: int, movie: int, frame: int) -> np.random.Generator:
    return np.random.default_rng([seed, int(movie) & 0xFFFFFFFF, int(frame) & 0xFFFFFFFF])


def _schema(shares: list[float] | None, *columns: str) -> str:
    return "movie_id long, frame int, " + ("run int, " if shares is None else "") + ", ".join(f"{c} {'double' if shares is None else 'array<double>'}" for c in columns)


def _drawn(movie: int, frame: int, shares: list[float] | None, **draws: np.ndarray) -> pd.DataFrame:
    """A row a run, or one row with the quantiles at shares."""
    if shares is not None:
        return pd.DataFrame({"movie_id": [movie], "frame": [frame], **{c: [np.quantile(d, shares)] for c, d in draws.items()}})
    runs = len(next(iter(draws.values())))
    return pd.DataFrame({"movie_id": movie, "frame": frame, "run": np.arange(runs), **draws})


def bootstrap_mean_diff(values: DataFrame, column: str = "value", runs: int = RUNS, seed: int = 5, shares: list[float] | None = None) -> DataFrame:
    """(movie_id, frame, run, diff): mu minus the mean of `size` draws with replacement from a frame's values, from rows
    (movie_id, frame, column, mu, size). The draws depend on the seed and the frame alone. With shares, these quantiles of a
    frame's draws, (movie_id, frame, diff array), and the draws stay in their task."""

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        movie, frame = group["movie_id"].iloc[0], group["frame"].iloc[0]
        diff = bootstrap_means(np.sort(group[column].to_numpy(float)), group["mu"].iloc[0], int(group["size"].iloc[0]), runs, _seed(seed, movie, frame))
        return _drawn(movie, frame, shares, diff=diff)

    return spread(values.where(F.col(column).isNotNull()), *FRAME).groupBy(*FRAME).applyInPandas(draw, _schema(shares, "diff"))


def bootstrap_angle_diff(values: DataFrame, column: str = "value", runs: int = RUNS, seed: int = 5, shares: list[float] | None = None) -> DataFrame:
    """(movie_id, frame, run, diff_angle, diff_radius) from rows (movie_id, frame, column, mu, radius, size), or as quantiles at shares."""

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        movie, frame = group["movie_id"].iloc[0], group["frame"].iloc[0]
        angle, radius = bootstrap_angles(np.sort(group[column].to_numpy(float)), group["mu"].iloc[0], group["radius"].iloc[0], int(group["size"].iloc[0]), runs, _seed(seed, movie, frame))
        return _drawn(movie, frame, shares, diff_angle=angle, diff_radius=radius)

    return spread(values.where(F.col(column).isNotNull()), *FRAME).groupBy(*FRAME).applyInPandas(draw, _schema(shares, "diff_angle", "diff_radius"))


def tracked_vs_untracked(tracked: DataFrame, untracked: DataFrame, start: int = 0, stop: int | None = None, runs: int = RUNS, seed: int = 5) -> DataFrame:
    """One row per movie and frame in [start, stop): how far bootstrap means of the frame's untracked sarcomeres lie from the
    tracked mean, as quartiles, for length, width and angle, and the numbers of both."""
    inside = (F.col("frame") >= start) & (F.lit(True) if stop is None else F.col("frame") < stop)
    t, u = tracked.where(inside), untracked.where(inside)
    size = tracked.groupBy("movie_id").agg((F.max("sarc_id") + 1).alias("size"))
    from .analysis import circular_mean

    means = t.groupBy(*FRAME).agg(F.avg("length").alias("length_mu"), F.avg("width").alias("width_mu")).join(circular_mean(t, FRAME), FRAME).join(size, "movie_id")
    counts = u.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("untracked"))
    rows = u.select(*FRAME, "length", "width", "angle").join(means, FRAME)
    out = counts.join(means.select(*FRAME, F.col("size").alias("tracked")), FRAME)
    for name in ("length", "width"):
        d = bootstrap_mean_diff(rows.select(*FRAME, F.col(name).alias("value"), F.col(f"{name}_mu").alias("mu"), "size"), runs=runs, seed=seed, shares=SHARES)
        out = out.join(d.withColumnRenamed("diff", f"{name}_diff"), FRAME)
    a = bootstrap_angle_diff(rows.select(*FRAME, F.col("angle").alias("value"), F.col("mean_angle").alias("mu"), "radius", "size"), runs=runs, seed=seed, shares=SHARES)
    return out.join(a, FRAME)


def untracked_summary(comparison: DataFrame) -> DataFrame:
    return comparison.groupBy("movie_id").agg(F.avg("untracked").alias("untracked_mean"), F.max("tracked").alias("tracked"))
