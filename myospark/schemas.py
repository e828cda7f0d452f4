"""Schemas of the tables, and checks of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_D, _L, _I, _S = T.DoubleType(), T.LongType(), T.IntegerType(), T.StringType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


_PLACE = (("x", _D), ("y", _D), ("p1_x", _D), ("p1_y", _D), ("p2_x", _D), ("p2_y", _D))
FRAMES = _struct(("movie_id", _L), ("frame", _I), ("height", _I), ("width", _I), ("channels", _I), ("pixels", T.ArrayType(_D)))
CONTOURS = _struct(("movie_id", _L), ("frame", _I), ("contour_id", _I), ("points", T.ArrayType(_struct(("x", _D), ("y", _D)))))
ZDISCS = _struct(("movie_id", _L), ("frame", _I), *_PLACE)
TRACKED_ZDISCS = _struct(("movie_id", _L), ("frame", _I), *_PLACE, ("particle", _L), ("freq", _I))
SARCOMERES = _struct(("movie_id", _L), ("frame", _I), ("sarc_id", _I), ("x", _D), ("y", _D), ("length", _D), ("width", _D), ("angle", _D), ("zdiscs", _S))
SARCOMERES_SMOOTH = T.StructType([*SARCOMERES.fields, T.StructField("length_norm", _D)])


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, or a ValueError that names what it lacks; anything but a DataFrame is a TypeError."""
    if not isinstance(df, DataFrame):
        raise TypeError("a Spark DataFrame is needed")
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df


def bad_frames(frames: DataFrame) -> DataFrame:
    """The frames whose number of pixels is not height * width * channels."""
    require_columns(frames, ["height", "width", "channels", "pixels"])
    return frames.where("pixels is null or size(pixels) <> height * width * channels")


def bad_movies(zdiscs: DataFrame, image: bool = False) -> DataFrame:
    """(movie_id, frames) of movies with a single frame, or with image of images with several."""
    counted = zdiscs.groupBy("movie_id").agg({"frame": "max"}).selectExpr("movie_id", "`max(frame)` + 1 as frames")
    return counted.where("frames > 1" if image else "frames < 2")
