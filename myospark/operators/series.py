"""Time series of sarcomeres: smoothing, gaps, phases, beats, distances."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import signals
from ..storage import spread

SERIES = ["movie_id", "sarc_id"]
#: Places of the series that have the same frames, which may be all.
LIKE = 16


def smooth_gpr(sarcomeres: DataFrame, columns: tuple[str, ...] = ("x", "y", "length", "angle", "width")) -> DataFrame:
    """sarcomeres with the columns smoothed, and their gaps filled, by Gaussian-process regression of each series; one
    without any value stays null. Series with the same frames share the work on these: each set of frames is dealt to LIKE places."""
    names = sarcomeres.columns

    def smooth(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("frame", kind="stable")
        frames = group["frame"].to_numpy(float)
        return group.assign(**dict(zip(columns, signals.gp_smooth(frames, [group[c].to_numpy(float) for c in columns]), strict=True)))[names]

    kinds = [f"{f.name} {'double' if f.name in columns else f.dataType.simpleString()}" for f in sarcomeres.schema]
    known = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in columns]
    like = F.bit_xor(F.xxhash64("frame", *known)).over(Window.partitionBy(*SERIES))
    dealt = sarcomeres.withColumn("_like", like).withColumn("_place", F.pmod(F.xxhash64(*SERIES), F.lit(LIKE)))
    return spread(dealt, "_like", "_place").groupBy("_like", "_place", *SERIES).applyInPandas(smooth, ", ".join(kinds))


def fill_linear(series: DataFrame, column: str = "length") -> DataFrame:
    """series with the gaps of a column filled between its neighbours, the ends held."""
    order = Window.partitionBy(*SERIES).orderBy("frame")
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(column).isNotNull(), F.col("frame"))
    at = series.withColumn("_f0", F.last(known, True).over(before)).withColumn("_v0", F.last(column, True).over(before)).withColumn("_f1", F.first(known, True).over(after)).withColumn("_v1", F.first(column, True).over(after))
    between = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("frame") - F.col("_f0")) / F.nullif(F.col("_f1") - F.col("_f0"), F.lit(0))
    return at.withColumn(column, F.coalesce(F.col(column), between, F.col("_v0"), F.col("_v1"))).drop("_f0", "_v0", "_f1", "_v1")


def normalize_length(sarcomeres: DataFrame) -> DataFrame:
    mean = F.avg("length").over(Window.partitionBy(*SERIES))
    return sarcomeres.withColumn("length_norm", (F.col("length") - mean) / mean)


def frame_curves(sarcomeres: DataFrame) -> DataFrame:
    return sarcomeres.groupBy("movie_id", "frame").agg(F.avg("length_norm").alias("mean_norm"), F.median("length_norm").alias("median_norm"))


def median_of_five(value: Column, order: Window) -> Column:
    """The median of five neighbours, zeros beyond the ends."""
    five = [F.coalesce(F.lag(value, -k).over(order) if k else value, F.lit(0.0)) for k in range(-2, 3)]
    return F.element_at(F.array_sort(F.array(*five)), 3)


def slope(value: Column, order: Window) -> Column:
    """Central differences, one-sided at the ends."""
    before, after = F.lag(value).over(order), F.lead(value).over(order)
    return F.when(before.isNull(), after - value).when(after.isNull(), value - before).otherwise((after - before) / 2)


def filtered(series: DataFrame, value: str = "length_norm", key: tuple[str, ...] = tuple(SERIES)) -> DataFrame:
    order = Window.partitionBy(*key).orderBy("frame")
    return series.withColumn("med", median_of_five(F.col(value), order)).withColumn("slope", slope(F.col(value), order))


def phase_labels(series: DataFrame, value: str = "length_norm", factor: float = 0.025, of_filtered: bool = True, key: tuple[str, ...] = tuple(SERIES)) -> DataFrame:
    """series with med, slope and phase: R while the slope exceeds the threshold, C while it is under its negative, else F.
    The threshold is `factor` of the range of the median-filtered values, or of the values themselves."""
    whole = Window.partitionBy(*key)
    source = F.col("med" if of_filtered else value)
    threshold = factor * (F.max(source).over(whole) - F.min(source).over(whole))
    at = filtered(series, value, key).withColumn("th", threshold)
    return at.withColumn("phase", F.when(F.col("slope") > F.col("th"), "R").when(F.col("slope") < -F.col("th"), "C").otherwise("F"))


def phase_counts(labelled: DataFrame, key: tuple[str, ...] = tuple(SERIES)) -> DataFrame:
    return labelled.groupBy(*key).agg(*(F.count_if(F.col("phase") == p).alias(f"count_{p.lower()}") for p in "RCF"))


def local_minima(filtered_series: DataFrame, value: str = "med") -> DataFrame:
    """Frames whose value is under both neighbours'."""
    v, order = F.col(value), Window.partitionBy(*SERIES).orderBy("frame")
    low = filtered_series.withColumn("_b", F.lag(v).over(order)).withColumn("_a", F.lead(v).over(order))
    return low.where((v < F.col("_b")) & (v < F.col("_a"))).select(*SERIES, "frame", value)


def find_valleys(filtered_series: DataFrame, value: str = "med", distance: int = 10, width: float = 5.0, key: tuple[str, ...] = tuple(SERIES)) -> DataFrame:
    """(key, frame, value) of the valleys of a series without gaps."""
    kinds = ", ".join(f"{c} {filtered_series.schema[c].dataType.simpleString()}" for c in key)

    def valleys(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("frame", kind="stable")
        at = signals.peaks(-group[value].to_numpy(float), distance, width)
        return group.iloc[at][[*key, "frame", value]]

    return spread(filtered_series.select(*key, "frame", value), *key).groupBy(*key).applyInPandas(valleys, f"{kinds}, frame int, {value} double")


def length_stats(sarcomeres: DataFrame) -> DataFrame:
    low, high = F.min("length"), F.max("length")
    return sarcomeres.groupBy(*SERIES).agg(F.median("length").alias("pix_length_median"), F.avg("length").alias("pix_length_mean"), low.alias("pix_length_min"), high.alias("pix_length_max"), (100 * (high - low) / high).alias("pix_percent_shortening"))


def ts_params(sarcomeres: DataFrame) -> DataFrame:
    """One row per sarcomere: lengths, frames of each phase per beat, period, first valley, beats; without a beat the number
    of beats is infinite and what is counted per beat is 0."""
    labelled = phase_labels(sarcomeres)
    counts = labelled.groupBy(*SERIES).agg(*(F.count_if(F.col("phase") == p).alias(p) for p in "RCF"), F.avg("med").alias("mean_med"), F.max("th").alias("th"))
    last = sarcomeres.groupBy("movie_id").agg((F.max("frame") + 1).alias("num_frames"))
    valleys = find_valleys(labelled).join(counts, SERIES)
    beats = valleys.groupBy(*SERIES).agg(F.min("frame").alias("first"), F.count_if(F.col("med") < F.col("mean_med") - F.col("th")).alias("deep"))
    full = length_stats(sarcomeres).join(counts, SERIES).join(beats, SERIES, "left").join(last, "movie_id")
    n = F.when(F.coalesce("deep", F.lit(0)) > 0, F.col("deep").cast("double")).otherwise(F.lit(float("inf")))
    lengths = [f"pix_{c}" for c in ("length_median", "length_mean", "length_min", "length_max", "percent_shortening")]
    return full.select(
        "movie_id", F.col("sarc_id").alias("sarc_ids"), *lengths, (F.col("C") / n).alias("mean_contraction_time"), (F.col("R") / n).alias("mean_relax_time"),
        (F.col("F") / n).alias("mean_flat_time"), (F.col("num_frames") / n).alias("mean_period_len"), F.coalesce("first", F.lit(0)).cast("double").alias("frames_to_first_peak"), n.alias("peaks_count"),
    )


def as_arrays(series: DataFrame, value: str = "length_norm") -> DataFrame:
    points = F.array_sort(F.collect_list(F.struct("frame", F.col(value).alias("v"))))
    return series.groupBy(*SERIES).agg(F.transform(points, lambda p: p["v"]).alias("series"))


def dtw_distance() -> Callable[[Column, Column], Column]:
    """A column function: the distance of two arrays of numbers under dynamic time warping."""

    @F.pandas_udf("double")
    def dtw(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(signals.dtw_many(list(a), list(b)))

    return dtw


#: Parts into which the series of a movie are dealt; a task's work is the pairs of two parts.
BLOCKS = 8


def pair_distances(series: DataFrame, metric: str = "euclidean", value: str = "length_norm", blocks: int = BLOCKS) -> DataFrame:
    """(movie_id, sarc_a, sarc_b, dist) of all pairs of series of a movie. The pairs of two of its parts arise together, so a
    large movie is blocks * blocks tasks and a series travels `blocks` times, not once a pair. Every pair is the result
    asked for; its number is the square of a movie's series, not of the table."""
    own = F.pmod(F.xxhash64("sarc_id"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    arrays = as_arrays(series, value)
    a = arrays.select("movie_id", own.alias("part_a"), every.alias("part_b"), F.col("sarc_id").alias("sarc_a"), F.col("series").alias("s"))
    b = arrays.select("movie_id", every.alias("part_a"), own.alias("part_b"), F.col("sarc_id").alias("sarc_b"), F.col("series").alias("t"))
    key = ["movie_id", "part_a", "part_b"]
    pairs = spread(a, *key).join(spread(b, *key), key).where("sarc_a < sarc_b")
    if metric == "dtw":
        dist = dtw_distance()(F.col("s"), F.col("t"))
    elif metric == "euclidean":
        dist = F.sqrt(F.aggregate(F.zip_with("s", "t", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x))
    else:
        raise ValueError("metric must be dtw or euclidean")
    return pairs.select("movie_id", "sarc_a", "sarc_b", dist.alias("dist"))


def ward_linkage(distances: DataFrame) -> DataFrame:
    """(movie_id, step, a, b, height, size, leaves): Ward's merges of each movie's series; clusters are numbered on from the
    number of series, and leaves lists the merged series in the order of the tree. A movie is one task that holds the
    square of its series: 0.8 GB for 10,000 of them, in time that grows with that square."""

    def link(group: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([group["sarc_a"], group["sarc_b"]]))
        d = np.zeros((len(ids), len(ids)))
        a, b = np.searchsorted(ids, group["sarc_a"]), np.searchsorted(ids, group["sarc_b"])
        d[a, b] = d[b, a] = group["dist"]
        rows = [(group["movie_id"].iloc[0], k, i, j, h, n, [int(ids[x]) for x in leaves]) for k, (i, j, h, n, leaves) in enumerate(signals.ward(d))]
        return pd.DataFrame(rows, columns=["movie_id", "step", "a", "b", "height", "size", "leaves"])

    return spread(distances, "movie_id").groupBy("movie_id").applyInPandas(link, "movie_id long, step int, a int, b int, height double, size int, leaves array<long>")


def leaf_order(linkage: DataFrame) -> DataFrame:
    """(movie_id, sarc_id, pos): the leaves of each movie's last merge."""
    return linkage.groupBy("movie_id").agg(F.max_by("leaves", "step").alias("leaves")).select("movie_id", F.posexplode("leaves").alias("pos", "sarc_id"))
