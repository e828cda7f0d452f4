"""Sarcomeres from tracked z-discs and the pruned graph."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import require_columns
from ..storage import materialize
from . import graph

ENDS = ["x", "y", "p1_x", "p1_y", "p2_x", "p2_y"]


def particle_centers(tracks: DataFrame, key: list[str] = ("movie_id",)) -> DataFrame:
    return tracks.groupBy(*key, "particle").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def _numbered(edges: DataFrame, key: list[str]) -> DataFrame:
    order = Window.partitionBy(*key).orderBy("u", "v")
    return edges.select(*key, F.col("u").alias("p1"), F.col("v").alias("p2"), (F.row_number().over(order) - 1).alias("sarc_id"))


def _side(tracks: DataFrame, keys: list[str], name: str) -> DataFrame:
    return tracks.select(*keys, F.col("particle").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ENDS))


def _distance(a: str, b: str) -> Column:
    return F.sqrt((F.col(f"{a}_x") - F.col(f"{b}_x")) ** 2 + (F.col(f"{a}_y") - F.col(f"{b}_y")) ** 2)


def _measures() -> dict[str, Column]:
    angle = F.atan2(F.col("p2_x") - F.col("p1_x"), F.col("p2_y") - F.col("p1_y"))
    return {
        "x": (F.col("p1_x") + F.col("p2_x")) / 2,
        "y": (F.col("p1_y") + F.col("p2_y")) / 2,
        "length": _distance("p1", "p2"),
        "width": (_distance("p1_p1", "p1_p2") + _distance("p2_p1", "p2_p2")) / 2,
        "angle": F.when(angle < 0, angle + math.pi).otherwise(angle),
        "zdiscs": F.concat_ws(",", "p1", "p2"),
    }


def measure_sarcomeres(tracks: DataFrame, edges: DataFrame) -> DataFrame:
    """A row for every sarcomere and every frame up to the movie's last; measures are null where a z-disc is missing.

    The width is the mean distance between a z-disc's two ends; the angle, from the second axis, lies in 0..pi."""
    numbered = _numbered(edges, ["movie_id"])
    last = tracks.groupBy("movie_id").agg(F.max("frame").alias("last"))
    grid = numbered.join(last, "movie_id").select("movie_id", "sarc_id", "p1", "p2", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("frame"))
    keys = ["movie_id", "frame"]
    full = grid.join(_side(tracks, keys, "p1"), [*keys, "p1"], "left").join(_side(tracks, keys, "p2"), [*keys, "p2"], "left")
    m = _measures()
    return full.select(*keys, "sarc_id", "p1", "p2", *(m[c].alias(c) for c in m))


def measure_by_frame(zdiscs: DataFrame, edges: DataFrame) -> DataFrame:
    """Sarcomeres of every frame on its own, from the graphs of the frames."""
    keys = ["movie_id", "frame"]
    full = _numbered(edges, keys).join(_side(zdiscs, keys, "p1"), [*keys, "p1"]).join(_side(zdiscs, keys, "p2"), [*keys, "p2"])
    m = _measures()
    return full.select(*keys, "sarc_id", "p1", "p2", *(m[c].alias(c) for c in m))


def detect_sarcomeres(tracks: DataFrame, **params: float) -> DataFrame:
    """Sarcomeres of tracked movies: the graph of the particles' mean places, measured in every frame."""
    require_columns(tracks, ["movie_id", "frame", "particle", *ENDS])
    centers = materialize(particle_centers(tracks), "centers")  # the graph reads them several times
    return measure_sarcomeres(tracks, graph.detect_edges(centers, ["movie_id"], **params))


def detect(tracks: DataFrame, **params: float) -> tuple[DataFrame, DataFrame]:
    """(sarcomeres, myofibrils) from one graph, which is written once."""
    require_columns(tracks, ["movie_id", "frame", "particle", *ENDS])
    centers = materialize(particle_centers(tracks), "centers")
    edges = materialize(graph.detect_edges(centers, ["movie_id"], **params), "sarcomere-edges")
    return measure_sarcomeres(tracks, edges), graph.myofibrils(centers, edges, ["movie_id"])


def detect_by_frame(zdiscs: DataFrame, **params: float) -> DataFrame:
    """Sarcomeres of numbered z-discs without regard to time."""
    return measure_by_frame(zdiscs, graph.detect_edges(zdiscs, ["movie_id", "frame"], **params))


def frame_slice(zdiscs: DataFrame, sarcomeres: DataFrame, frame: int) -> DataFrame:
    """(movie_id, zdiscs, sarcomeres): how many a frame shows; sarcomeres with a measured length."""
    z = zdiscs.where(F.col("frame") == frame).groupBy("movie_id").agg(F.count(F.lit(1)).alias("zdiscs"))
    s = sarcomeres.where((F.col("frame") == frame) & F.col("length").isNotNull()).groupBy("movie_id").agg(F.count(F.lit(1)).alias("sarcomeres"))
    return z.join(s, "movie_id", "full").select("movie_id", F.coalesce("zdiscs", F.lit(0)).alias("zdiscs"), F.coalesce("sarcomeres", F.lit(0)).alias("sarcomeres"))
