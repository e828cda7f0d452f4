"""Tracks of z-discs through the frames of a movie."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.assignment import cheapest_links
from ..schemas import require_columns
from ..storage import materialize, spread
from .components import components_by_key, connected_components
from .graph import nearest
from .sarcomeres import particle_centers

MEASURES = ["x", "y", "p1_x", "p1_y", "p2_x", "p2_y"]


def link_zdiscs(zdiscs: DataFrame, search_range: float = 4.0, huge: bool = False) -> DataFrame:
    """zdiscs with `particle`: frame by frame, tracks take the z-discs within search_range of where they were last seen,
    so that the squared steps, search_range squared for a track that takes none, add up to the least. Tracks never
    expire. New tracks are numbered in the order of frame, x, y.

    A movie is one task, as each step needs the one before; with `huge`, movies of any size are cut into the parts of
    `with_parts`. Parts do not touch, so a task links about TOGETHER z-discs of many parts at once, a larger part alone, and
    the numbers follow from the tracks' first places. Rows are the same."""
    require_columns(zdiscs, ["movie_id", "frame", "x", "y"])
    if not huge:
        return _linked(zdiscs, ["movie_id"], search_range)
    columns = [c for c in zdiscs.columns if c != "particle"]
    key = ["movie_id", "_group"]
    grouped = _with_parts(zdiscs.drop("particle"), search_range).select(*columns, "_group")
    local = materialize(_linked(spread(grouped, *key), key, search_range), "linked")
    first = local.groupBy(*key, "particle").agg(F.min(F.struct("frame", "x", "y")).alias("first"))
    numbers = _numbered(materialize(first.select(*key, "particle", "first.*"), "tracks"), ["frame", "x", "y", "_group", "particle"])
    return local.join(numbers.select(*key, "particle", "number"), [*key, "particle"]).select(*columns, F.col("number").alias("particle"))


#: Z-discs that a task links at once.
TOGETHER = 10000


def with_parts(zdiscs: DataFrame, search_range: float) -> DataFrame:
    """zdiscs with part_x and part_y: the part of space they lie in, so that no z-disc of any frame has one of another part
    within search_range. Parts are components of the squares, as wide as search_range, that hold z-discs of any frame, joined
    where they touch: a track's last place and what it may take lie in the same or in touching squares."""
    return _with_parts(zdiscs, search_range).drop("_group")


def _with_parts(zdiscs: DataFrame, search_range: float) -> DataFrame:
    """with_parts, and _group: whole parts of a movie dealt into as many groups as hold TOGETHER z-discs each."""
    square = lambda c: F.floor(F.col(c) / F.lit(float(search_range)))
    placed = zdiscs.withColumn("_cx", square("x")).withColumn("_cy", square("y"))
    squares = materialize(placed.groupBy("movie_id", "_cx", "_cy").agg(F.count(F.lit(1)).alias("n")), "squares")
    ahead = F.inline(F.array(*(F.struct((F.col("_cx") + i).alias("_nx"), (F.col("_cy") + j).alias("_ny")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1)))))
    there = squares.select("movie_id", F.col("_cx").alias("_nx"), F.col("_cy").alias("_ny"))
    touching = squares.select("movie_id", "_cx", "_cy", ahead).join(there, ["movie_id", "_nx", "_ny"])
    node = lambda x, y: F.struct("movie_id", F.col(x).alias("x"), F.col(y).alias("y"))
    roots = connected_components(touching.select(node("_cx", "_cy").alias("a"), node("_nx", "_ny").alias("b")))
    parts = roots.select("node.movie_id", F.col("node.x").alias("_cx"), F.col("node.y").alias("_cy"), F.col("root.x").alias("part_x"), F.col("root.y").alias("part_y"))
    groups = materialize(squares.groupBy("movie_id").agg(F.ceil(F.sum("n") / TOGETHER).alias("_groups")), "groups")  # a row a movie
    parted = squares.drop("n").join(parts, ["movie_id", "_cx", "_cy"], "left").join(groups, "movie_id")
    parted = parted.withColumn("part_x", F.coalesce("part_x", "_cx")).withColumn("part_y", F.coalesce("part_y", "_cy"))
    parted = parted.select("movie_id", "_cx", "_cy", "part_x", "part_y", F.pmod(F.xxhash64("part_x", "part_y"), F.col("_groups")).alias("_group"))
    return placed.join(parted, ["movie_id", "_cx", "_cy"], "left").select(*zdiscs.columns, "part_x", "part_y", F.coalesce("_group", F.lit(0)).alias("_group"))


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with `number`, from 0 in the order of each movie. Rows are sorted by ranges, many of which a movie may have; what is
    added up in one place is the count of each range."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(tasks, "movie_id", *order).sortWithinPartitions("movie_id", *order)
    ordered = materialize(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordered").withColumn("_range", F.shiftright("_at", 33))
    ranges = ordered.groupBy("movie_id", "_range").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("movie_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("movie_id", "_range", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return ordered.join(ranges, ["movie_id", "_range"]).withColumn("number", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def _linked(zdiscs: DataFrame, key: list[str], search_range: float) -> DataFrame:
    """zdiscs with `particle`, numbered from 0 in each group of key, which is one task."""
    names = [c for c in zdiscs.columns if c != "particle"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in zdiscs.select(names).schema) + ", particle long"

    def link(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["frame", "x", "y"], kind="stable")
        places, frames = group[["x", "y"]].to_numpy(float), group["frame"].to_numpy()
        particle = np.empty(len(group), np.int64)
        seen = np.zeros((0, 2))
        for a, b in _blocks(frames):
            track_of = cheapest_links(seen, places[a:b], search_range)
            new = np.flatnonzero(track_of < 0)
            track_of[new] = len(seen) + np.arange(len(new))
            seen = np.concatenate([seen, np.zeros((len(new), 2))])
            seen[track_of] = places[a:b]
            particle[a:b] = track_of
        return group.assign(particle=particle)[[*names, "particle"]]

    return zdiscs.groupBy(*key).applyInPandas(link, schema)


def _blocks(values: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(values)) + 1
    return zip(np.concatenate([[0], edges]), np.concatenate([edges, [len(values)]]), strict=True)


def filter_stubs(tracks: DataFrame, least: int = 2) -> DataFrame:
    """Tracks that are seen in `least` frames or more."""
    counted = tracks.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("movie_id", "particle")))
    return counted.where(F.col("_n") >= least).drop("_n")


def with_freq(tracks: DataFrame) -> DataFrame:
    """tracks with freq, the rows of the particle, and num_frames of the movie."""
    last = tracks.groupBy("movie_id").agg((F.max("frame") + 1).alias("num_frames"))
    counted = tracks.withColumn("freq", F.count(F.lit(1)).over(Window.partitionBy("movie_id", "particle")).cast("int"))
    return counted.join(last, "movie_id")


def merge_radius(tracks: DataFrame) -> DataFrame:
    """(movie_id, radius): the mean distance of a particle's centre to the next one's."""
    return nearest_distance(particle_centers(tracks)).groupBy("movie_id").agg(F.avg("d").alias("radius"))


def nearest_distance(centers: DataFrame) -> DataFrame:
    """(movie_id, particle, d) to the nearest other centre of the movie."""
    return nearest(centers, ["movie_id"], 1).select("movie_id", F.col("n").alias("particle"), F.sqrt("d2").alias("d"))


def cluster_partial(tracks: DataFrame) -> DataFrame:
    """(movie_id, particle, cluster) of the partial tracks: those whose centres lie within the merge radius of each other,
    directly or through others, share the least particle of them as cluster; cluster is null for a lone one."""
    partial = with_freq(tracks).where("freq < num_frames").select("movie_id", "particle").distinct()
    centers = particle_centers(tracks).join(partial, ["movie_id", "particle"]).join(merge_radius(tracks), "movie_id")
    width = F.greatest(F.col("radius"), F.lit(1e-9))
    a = centers.withColumn("cx", F.floor(F.col("x") / width)).withColumn("cy", F.floor(F.col("y") / width))
    steps = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    b = a.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps)).select("movie_id", F.col("particle").alias("q"), F.col("x").alias("qx"), F.col("y").alias("qy"), (F.col("cx") + F.col("i")).alias("cx"), (F.col("cy") + F.col("j")).alias("cy"))
    close = a.join(b, ["movie_id", "cx", "cy"]).where("particle < q and sqrt(pow(x - qx, 2) + pow(y - qy, 2)) <= radius")
    labels = components_by_key(close, ["movie_id"], "particle", "q").withColumnsRenamed({"node": "particle", "root": "cluster"})
    return partial.join(labels, ["movie_id", "particle"], "left")


def merge_partial_tracks(tracks: DataFrame, full_track_ratio: float = 0.75, clusters: DataFrame | None = None) -> DataFrame:
    """Full tracks as they are, the partial tracks of a cluster as one of their mean places, lone ones if long enough.

    A merged track is numbered -(i + 1) by its cluster's rank in the movie, ranks beginning at 1 if there are lone
    partial tracks and at 0 if not, and has as freq its frames; it too must be longer than full_track_ratio of the movie.
    """
    columns = ["movie_id", "frame", "particle", *MEASURES, "freq"]
    counted = with_freq(tracks)
    partial = counted.where("freq < num_frames").join(clusters if clusters is not None else cluster_partial(tracks), ["movie_id", "particle"])
    ranked = partial.select("movie_id", "cluster").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("movie_id").orderBy(F.col("cluster").asc_nulls_first())))
    in_cluster = partial.where("cluster is not null")
    merged = in_cluster.groupBy("movie_id", "cluster", "frame").agg(*(F.avg(c).alias(c) for c in MEASURES), F.max("num_frames").alias("num_frames"))
    merged = merged.withColumn("freq", F.count(F.lit(1)).over(Window.partitionBy("movie_id", "cluster")).cast("int")).where(F.col("freq") > full_track_ratio * F.col("num_frames"))
    merged = merged.join(ranked.where("cluster is not null"), ["movie_id", "cluster"]).withColumn("particle", -F.col("rank").cast("long"))
    lone = partial.where("cluster is null").where(F.col("freq") > full_track_ratio * F.col("num_frames"))
    full = counted.where("freq = num_frames")
    return full.select(columns).unionByName(merged.select(columns)).unionByName(lone.select(columns))


def number_image_zdiscs(zdiscs: DataFrame) -> DataFrame:
    """zdiscs of single frames numbered from 0 by x and y."""
    order = Window.partitionBy("movie_id", "frame").orderBy("x", "y")
    return zdiscs.withColumn("particle", F.row_number().over(order).cast("long") - 1)


def track_zdiscs(zdiscs: DataFrame, search_range: float = 4.0, full_track_ratio: float = 0.75, skip_merging: bool = False, image: bool = False, huge: bool = False) -> DataFrame:
    require_columns(zdiscs, ["movie_id", "frame", "x", "y"])
    if image:
        return materialize(number_image_zdiscs(zdiscs), "numbered")  # read for the graph and for the ends of its edges
    tracks = filter_stubs(link_zdiscs(zdiscs, search_range, huge))
    # merging reads the tracks seven times, which would find and link the z-discs as often
    return tracks if skip_merging else merge_partial_tracks(materialize(tracks, "linked-tracks"), full_track_ratio)
