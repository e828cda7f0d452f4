"""Movie-level analysis: deformation, orientation, metrics, spatial graphs, summaries.

`sarcomeres` are smoothed ones without gaps: movie_id, frame, sarc_id, x, y, length, width, angle, length_norm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialize
from . import graph
from .sarcomeres import particle_centers
from .series import SERIES

FRAME = ["movie_id", "frame"]


def _gradient(sarcomeres: DataFrame, reference: DataFrame) -> DataFrame:
    """F and J of every frame against reference(movie_id, sarc_id, rx, ry), by covariances of the places: the least-squares
    map of all pair differences is Cov(now, reference) Cov(reference, reference)^-1, so no pair is formed. Null where
    fewer than three places, or places in line, leave it undefined."""
    cov = {f"{a}_{b}": F.covar_pop(a, b) for a, b in (("x", "rx"), ("x", "ry"), ("y", "rx"), ("y", "ry"), ("rx", "rx"), ("rx", "ry"), ("ry", "ry"))}
    c = sarcomeres.select(*FRAME, "sarc_id", "x", "y").join(reference, SERIES).groupBy(*FRAME).agg(*(v.alias(k) for k, v in cov.items()))
    det = F.col("rx_rx") * F.col("ry_ry") - F.col("rx_ry") ** 2
    det = F.when(F.abs(det) > 1e-12, det)

    def row(t: str) -> tuple[Column, Column]:
        return (F.col(f"{t}_rx") * F.col("ry_ry") - F.col(f"{t}_ry") * F.col("rx_ry")) / det, (F.col(f"{t}_ry") * F.col("rx_rx") - F.col(f"{t}_rx") * F.col("rx_ry")) / det

    (f11, f12), (f21, f22) = row("x"), row("y")
    f = c.select(*FRAME, f11.alias("f11"), f12.alias("f12"), f21.alias("f21"), f22.alias("f22"))
    return f.withColumn("j", F.col("f11") * F.col("f22") - F.col("f12") * F.col("f21"))


def _places(sarcomeres: DataFrame) -> DataFrame:
    return sarcomeres.select(*SERIES, F.col("x").alias("rx"), F.col("y").alias("ry"))


def deformation(sarcomeres: DataFrame, adjust_reference: bool = False) -> DataFrame:
    """(movie_id, frame, f11, f12, f21, f22, j) against frame 0, or with adjust_reference against the frame of the
    largest j, the first of equals."""
    first = _gradient(sarcomeres, _places(sarcomeres.where("frame = 0")))
    if not adjust_reference:
        return first
    widest = first.where("j is not null").groupBy("movie_id").agg(F.max_by("frame", F.struct("j", -F.col("frame"))).alias("frame"))
    return _gradient(sarcomeres, _places(sarcomeres.join(widest, FRAME)))


def order_parameter(sarcomeres: DataFrame) -> DataFrame:
    """(movie_id, frame, oop, oop_vx, oop_vy): the larger eigenvalue, and its vector, of the mean of 2nn' - 1 over angles."""
    means = sarcomeres.groupBy(*FRAME).agg(F.avg(F.cos(2 * F.col("angle"))).alias("a"), F.avg(F.sin(2 * F.col("angle"))).alias("b"))
    half = F.atan2("b", "a") / 2
    return means.select(*FRAME, F.hypot("a", "b").alias("oop"), F.cos(half).alias("oop_vx"), F.sin(half).alias("oop_vy"))


def relative_range(value: Column) -> Column:
    return (F.max(value) - F.min(value)) / (F.max(value) + 1)


def movie_metrics(sarcomeres: DataFrame, deformed: DataFrame, order: DataFrame, frame: int | None = None) -> DataFrame:
    """One row per movie: oop, c_iso and c_oop in the frame of the least j (or the frame given), s_til and s_avg."""
    if frame is None:
        at = deformed.groupBy("movie_id").agg(F.min_by("frame", F.struct("j", "frame")).alias("frame"))
        here = deformed.join(at, FRAME)
    else:
        here = deformed.where(F.col("frame") == frame)
    v0x = (F.col("f22") * F.col("oop_vx") - F.col("f12") * F.col("oop_vy")) / F.col("j")
    v0y = (F.col("f11") * F.col("oop_vy") - F.col("f21") * F.col("oop_vx")) / F.col("j")
    v0 = F.hypot(v0x, v0y)
    geometry = here.join(order, FRAME).select("movie_id", "oop", (1 - F.sqrt("j")).alias("c_iso"), ((v0 - F.hypot("oop_vx", "oop_vy")) / v0).alias("c_oop"))
    each = sarcomeres.groupBy(*SERIES).agg(relative_range(F.col("length_norm")).alias("s")).groupBy("movie_id").agg(F.median("s").alias("s_til"))
    mean = sarcomeres.groupBy(*FRAME).agg(F.avg("length_norm").alias("m")).groupBy("movie_id").agg(relative_range(F.col("m")).alias("s_avg"))
    return geometry.join(each, "movie_id").join(mean, "movie_id")


def principal_stretches(deformed: DataFrame) -> DataFrame:
    """(movie_id, frame, lambda1 <= lambda2, and the direction of each): singular values of F and its left vectors; a frame
    stretched alike in all directions has no directions."""
    q = F.col("f11") ** 2 + F.col("f12") ** 2 + F.col("f21") ** 2 + F.col("f22") ** 2
    gap = F.sqrt(F.greatest(q**2 - 4 * F.col("j") ** 2, F.lit(0.0)))
    a, c = F.col("f11") ** 2 + F.col("f12") ** 2, F.col("f21") ** 2 + F.col("f22") ** 2
    half = F.atan2(2 * (F.col("f11") * F.col("f21") + F.col("f12") * F.col("f22")), a - c) / 2
    turned = deformed.withColumn("q", q).withColumn("gap", gap).withColumn("phi", F.when(F.col("gap") > 1e-6, half))
    low = F.sqrt(F.greatest((F.col("q") - F.col("gap")) / 2, F.lit(0.0)))
    return turned.select(*FRAME, low.alias("lambda1"), F.sqrt((F.col("q") + F.col("gap")) / 2).alias("lambda2"), (-F.sin("phi")).alias("v1_x"), F.cos("phi").alias("v1_y"), F.cos("phi").alias("v2_x"), F.sin("phi").alias("v2_y"))


def spatial_graph(tracks: DataFrame, share: float = 0.1, **params: float) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes): pairs that are an edge of the frame's own graph in at least floor(share * frames) frames, weighted
    by these, and the mean places of the particles that are left. The edges are written once, as the nodes follow from them."""
    edges = graph.detect_edges(tracks.select(*FRAME, "particle", "x", "y"), FRAME, **params)
    frames = tracks.groupBy("movie_id").agg(F.floor(share * (F.max("frame") + 1)).alias("least"))
    weighted = edges.groupBy("movie_id", "u", "v").agg(F.count(F.lit(1)).alias("weight")).join(frames, "movie_id").where("weight >= least").drop("least")
    weighted = materialize(weighted, "spatial-edges")
    ends = weighted.select("movie_id", F.explode(F.array("u", "v")).alias("particle")).distinct()
    return weighted, particle_centers(tracks).join(ends, ["movie_id", "particle"], "left_semi")


def edge_orientation(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(movie_id, u, v, orientation): the share of an edge's length along the second axis."""
    u = nodes.select("movie_id", F.col("particle").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"))
    v = nodes.select("movie_id", F.col("particle").alias("v"), F.col("x").alias("wx"), F.col("y").alias("wy"))
    dy, dist = F.abs(F.col("uy") - F.col("wy")), F.hypot(F.col("ux") - F.col("wx"), F.col("uy") - F.col("wy"))
    return edges.join(u, ["movie_id", "u"]).join(v, ["movie_id", "v"]).select("movie_id", "u", "v", F.when(dy == 0, 0.0).otherwise(dy / dist).alias("orientation"))


def node_alignment(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(movie_id, particle, alignment, level, grey): the mean |cos| between pairs of a node's edges, 0 with fewer than two;
    its class of display, and its shade between the movie's extremes."""
    d = graph.directed(edges, nodes, ["movie_id"])
    length = F.hypot("vx", "vy")
    unit = d.select("movie_id", "n", "m", (F.col("vx") / length).alias("ax"), (F.col("vy") / length).alias("ay"))
    other = unit.select("movie_id", "n", F.col("m").alias("f"), F.col("ax").alias("bx"), F.col("ay").alias("by"))
    pairs = unit.join(other, ["movie_id", "n"]).where("m < f").groupBy("movie_id", F.col("n").alias("particle")).agg(F.avg(F.abs(F.col("ax") * F.col("bx") + F.col("ay") * F.col("by"))).alias("a"))
    full = nodes.select("movie_id", "particle").join(pairs, ["movie_id", "particle"], "left").withColumn("alignment", F.coalesce("a", F.lit(0.0)))
    movie = Window.partitionBy("movie_id")
    low, high = F.min("alignment").over(movie), F.max("alignment").over(movie)
    level = F.when(F.col("alignment") > 0.9, 2).when(F.col("alignment") > 0.75, 1).otherwise(0)
    grey = 1 - (0.75 * F.coalesce((F.col("alignment") - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0)) + 0.25)
    return full.select("movie_id", "particle", "alignment", level.alias("level"), grey.alias("grey"))


def circular_mean(frame: DataFrame, key: list[str], angle: str = "angle") -> DataFrame:
    """(key, mean_angle, radius) of the angles that are known."""
    known = F.when(~F.isnan(angle), F.col(angle))
    means = frame.groupBy(*key).agg(F.avg(F.cos(known)).alias("c"), F.avg(F.sin(known)).alias("s"))
    return means.select(*key, F.atan2("s", "c").alias("mean_angle"), F.hypot("s", "c").alias("radius"))


def histogram(frame: DataFrame, column: str, bins: int = 10, key: str = "movie_id") -> DataFrame:
    """(key, bin, low, high, count, median) of equal bins between the extremes, the last one closed; equal values are all in the first."""
    v = F.col(column).cast("double")
    stats = frame.groupBy(key).agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.median(v).alias("median"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.floor((v - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).otherwise(0)
    counts = frame.select(key, column).where(v.isNotNull()).join(stats, key).groupBy(key, at.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = stats.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).withColumn("bin", F.col("bin").cast("long"))
    return every.join(counts, [key, "bin"], "left").select(key, "bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("count", F.lit(0)).alias("count"), "median")


def contraction_level(sarcomeres: DataFrame) -> DataFrame:
    """sarcomeres with `level`, the strength of colour of a normalised length."""
    a = F.abs("length_norm")
    return sarcomeres.withColumn("level", F.when(a < 0.2, 2.5 * a + 0.5).otherwise(a))
