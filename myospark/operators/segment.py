"""Z-discs in frames. Every step works on a frame alone, so nothing is shuffled.

The array forms take `frames` (movie_id, frame, height, width, channels, pixels); the pixel forms take one row a pixel
(movie_id, frame, row, col, value) and use windows only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import images
from ..schemas import require_columns

FRAME = ["movie_id", "frame"]
_POINTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
_ZDISC = ["x", "y", "p1_x", "p1_y", "p2_x", "p2_y"]


def _frames(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    cols = {n: batch.column(n).to_pylist() for n in ("movie_id", "frame", "height", "width", "channels")}
    for k, (movie, frame, h, w, c) in enumerate(zip(*cols.values(), strict=True)):
        values = batch.column("pixels")[k].values.to_numpy(zero_copy_only=False).astype(float)
        yield movie, frame, values.reshape(h, w, c)


def _checked(frames: DataFrame) -> DataFrame:
    """Frames of the right number of pixels. Spark sends at most spark.sql.execution.arrow.maxBytesPerBatch of them at once."""
    require_columns(frames, [*FRAME, "height", "width", "channels", "pixels"])
    return frames.where("size(pixels) = height * width * channels").select("movie_id", "frame", "height", "width", "channels", F.col("pixels").cast("array<double>").alias("pixels"))


def _mapped(frames: DataFrame, one, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for movie, frame, pixels in _frames(batch):
                yield one(movie, frame, pixels)

    return _checked(frames).mapInArrow(run, schema)


def to_gray(frames: DataFrame) -> DataFrame:
    return _pixelwise(frames, images.gray)


def filter_frames(frames: DataFrame, sigma: float = 1.0) -> DataFrame:
    """frames, grey, through the Laplacian and the Gaussian."""
    return _pixelwise(frames, lambda p: images.filter_frame(p, sigma))


def _pixelwise(frames: DataFrame, change) -> DataFrame:
    def one(movie, frame, pixels):
        out = change(pixels)
        return pa.RecordBatch.from_arrays([pa.array([movie], pa.int64()), pa.array([frame], pa.int32()), pa.array([out.shape[0]], pa.int32()), pa.array([out.shape[1]], pa.int32()), pa.array([1], pa.int32()), pa.array([out.ravel()], pa.list_(pa.float64()))], names=[*FRAME, "height", "width", "channels", "pixels"])

    return _mapped(frames, one, "movie_id long, frame int, height int, width int, channels int, pixels array<double>")


def detect_contours(filtered: DataFrame, min_length: int = 8) -> DataFrame:
    """(movie_id, frame, contour_id, points) of the lines at each frame's Otsu threshold with min_length points or more."""

    def one(movie, frame, pixels):
        found = [c for c in images.contours(pixels[:, :, 0], images.otsu(pixels)) if len(c) >= min_length]
        points = [[{"x": x, "y": y} for x, y in c] for c in found]
        return pa.RecordBatch.from_arrays([pa.array([movie] * len(found), pa.int64()), pa.array([frame] * len(found), pa.int32()), pa.array(range(len(found)), pa.int32()), pa.array(points, _POINTS)], names=[*FRAME, "contour_id", "points"])

    return _mapped(filtered, one, "movie_id long, frame int, contour_id int, points array<struct<x:double,y:double>>")


def summarize_contours(contours: DataFrame) -> DataFrame:
    """(movie_id, frame, contour_id, centre, the two points furthest apart) of contours of three points or more."""
    require_columns(contours, [*FRAME, "contour_id", "points"])
    kinds = ", ".join(f"{c} {contours.schema[c].dataType.simpleString()}" for c in (*FRAME, "contour_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [images.summary(np.array([(p["x"], p["y"]) for p in points.as_py() or []], float).reshape(-1, 2)) for points in batch.column("points")]
            keep = pa.array([f is not None for f in found])
            values = np.array([f for f in found if f is not None], float).reshape(-1, 6)
            own = batch.select([*FRAME, "contour_id"]).filter(keep)
            yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(values[:, k]) for k in range(6))], names=[*FRAME, "contour_id", *_ZDISC])

    return contours.select(*FRAME, "contour_id", "points").mapInArrow(run, kinds + "".join(f", {c} double" for c in _ZDISC))


def segment_zdiscs(frames: DataFrame, sigma: float = 1.0, min_length: int = 8) -> DataFrame:
    """The z-discs of raw frames: filter, threshold, contours and their summaries in one pass over each frame."""

    def one(movie, frame, pixels):
        filtered = images.filter_frame(pixels, sigma)
        values = images.summaries([c for c in images.contours(filtered, images.otsu(filtered)) if len(c) >= min_length])
        return pa.RecordBatch.from_arrays([pa.array([movie] * len(values), pa.int64()), pa.array([frame] * len(values), pa.int32()), *(pa.array(values[:, k]) for k in range(6))], names=[*FRAME, *_ZDISC])

    return _mapped(frames, one, "movie_id long, frame int" + "".join(f", {c} double" for c in _ZDISC))


def laplace_pixels(pixels: DataFrame) -> DataFrame:
    """The Laplacian, a row a pixel."""
    v = F.col("value")
    down, across = Window.partitionBy(*FRAME, "col").orderBy("row"), Window.partitionBy(*FRAME, "row").orderBy("col")
    around = [F.coalesce(f(v).over(w), v) for f in (F.lag, F.lead) for w in (down, across)]
    return pixels.select(*FRAME, "row", "col", (4 * v - around[0] - around[1] - around[2] - around[3]).alias("value"))


def otsu_threshold(values: DataFrame, bins: int = 256) -> DataFrame:
    """(movie_id, frame, threshold) of each frame's values: only a histogram of a frame leaves a task."""
    v = F.col("value")
    ends = values.groupBy(*FRAME).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.floor((v - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).otherwise(0)
    n = values.select(*FRAME, "value").where(v.isNotNull()).join(ends, FRAME).groupBy(*FRAME, "lo", "hi", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    center = F.col("lo") + (F.col("bin") + 0.5) * width
    upto, frame = Window.partitionBy(*FRAME).orderBy("bin"), Window.partitionBy(*FRAME)
    full = n.withColumn("center", center).withColumn("nc", F.col("n") * F.col("center"))
    full = full.withColumn("w", F.sum("n").over(upto)).withColumn("s", F.sum("nc").over(upto)).withColumn("wt", F.sum("n").over(frame)).withColumn("st", F.sum("nc").over(frame))
    rest = F.col("wt") - F.col("w")
    between = F.when(rest > 0, F.col("w") * rest * F.pow(F.col("s") / F.col("w") - (F.col("st") - F.col("s")) / F.nullif(rest, F.lit(0)), 2)).otherwise(F.lit(-1.0))
    best = full.withColumn("between", between).groupBy(*FRAME).agg(F.max_by("center", F.struct("between", -F.col("bin"))).alias("threshold"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return best.select(*FRAME, F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("threshold")).alias("threshold"))
