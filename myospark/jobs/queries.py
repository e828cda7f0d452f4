"""The registered queries of the movie analysis, over the domain views of the given tables, and their SQL.

Doubles are rounded to six places on both sides, so that the order of a sum does not matter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators import analysis, compare, graph, linkage, sarcomeres, segment, series, track
from ..sources import tables
from ..storage import materialize, shared_path
from . import movies, views
from .views import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
MOVIE, FRAME = ["movie_id"], ["movie_id", "frame"]


def rounded(df: DataFrame) -> DataFrame:
    """df with its doubles rounded as DuckDB does: a million times the value, which may be a half where the value's own digits are a little less."""
    near = lambda c: (F.round(F.col(c) * 1e6, 0) / 1e6 + F.lit(0.0)).alias(c)
    return df.select(*(near(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields))


def query(sql: str | None = None, doubles: str = "", **more: str) -> Callable[[Query], Query]:
    """Register a query under its name; sql is what DuckDB runs after the views and `more`, its columns in `doubles` rounded."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            replace = f" replace ({', '.join(f'round({c}, 6) + 0.0::double as {c}' for c in doubles.split())})" if doubles else ""
            ORACLE_SQL[f.__name__] = with_views(f"select *{replace} from ({sql}) q", **more)
        return f

    return add


# --- SQL that several oracles share ---------------------------------------------------------------------------------

CENTERS = "select movie_id, particle, avg(x) as x, avg(y) as y from tracked_movie group by all"
COS = "greatest(-1.0::double, least(1.0::double, ({ax} * {bx} + {ay} * {by}) / (sqrt({ax} * {ax} + {ay} * {ay}) * sqrt({bx} * {bx} + {by} * {by}))))"


#: The terms of a score in SQL, of the lengths {l1} and {l2} and the angle {theta}.
SCORE = ("1 / (1 + abs({l2} - {l1}) / {l1}) + case when {theta} >= 1 then (1 - {theta}) ** 2 else 0 end", "exp(-pi() * (1 - {l1} / 12) ** 2)")
OWN_SCORE = ("3 * exp(-abs({l2} - {l1})) + 0.5::double * {theta}", "2 / (1 + ({l1} - 12) ** 2)")


def graph_sql(nodes: str, key: str, score: tuple[str, str] = SCORE) -> dict[str, str]:
    """knn, scored and pruned edges of the nodes in the expression `nodes`."""
    on = lambda a, b: " and ".join(f"{a}.{k} = {b}.{k}" for k in key.split(", "))
    keys = lambda a: ", ".join(f"{a}.{k} as {k}" for k in key.split(", "))
    theta = "acos(" + COS.format(ax="e.vx", ay="e.vy", bx="(-f.vx)", by="(-f.vy)") + ") / (pi() / 2)"
    bend = "acos(" + COS.format(ax="vx", ay="vy", bx="bx", by="by_") + ") / (pi() / 2)"
    l1, l2 = "sqrt(e.vx * e.vx + e.vy * e.vy)", "sqrt(f.vx * f.vx + f.vy * f.vy)"
    return {
        "knn": f"select distinct {key}, least(n, m) as u, greatest(n, m) as v from (select {keys('a')}, a.particle as n, b.particle as m, row_number() over (partition by {', '.join('a.' + k for k in key.split(', '))}, a.particle order by (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.particle) as r from {nodes} a join {nodes} b on {on('a', 'b')} and a.particle <> b.particle) where r <= 3",
        "dir": f"select {keys('e')}, e.u as n, e.v as m, b.x - a.x as vx, b.y - a.y as vy from knn e join {nodes} a on {on('e', 'a')} and a.particle = e.u join {nodes} b on {on('e', 'b')} and b.particle = e.v union all select {keys('e')}, e.v, e.u, a.x - b.x, a.y - b.y from knn e join {nodes} a on {on('e', 'a')} and a.particle = e.u join {nodes} b on {on('e', 'b')} and b.particle = e.v",
        "best": f"select {keys('e')}, e.n as n, e.m as m, max({score[0].format(l1=l1, l2=l2, theta=theta)}) as best from dir e join dir f on {on('e', 'f')} and f.n = e.m and f.m <> e.n group by all",
        "half": f"select {keys('e')}, e.n as n, e.m as m, {l1} as length, case when {l1} <= 30 then coalesce(b.best, 0) + {score[1].format(l1=l1)} else 0 end as score from dir e left join best b on {on('e', 'b')} and b.n = e.n and b.m = e.m",
        "scored": f"select {key}, least(n, m) as u, greatest(n, m) as v, max(length) as length, max(score) as score from half group by all",
        "ranked": f"select *, first(vx) over w as bx, first(vy) over w as by_, row_number() over w as r from (select d.*, s.score from dir d join scored s on {on('d', 's')} and s.u = least(d.n, d.m) and s.v = greatest(d.n, d.m)) window w as (partition by {key}, n order by score desc, m)",
        "voted": f"select *, min(case when r > 1 and {bend} > 1.2 then r end) over (partition by {key}, n) as second from ranked where score > 0.01",
        "pruned": f"select {key}, least(n, m) as u, greatest(n, m) as v, max(score) as score from voted where r = 1 or r = second group by all having count(*) = 2",
    }


MOVIE_GRAPH = {"centers": CENTERS, **graph_sql("centers", "movie_id")}
FRAME_GRAPH = graph_sql("tracked_movie", "movie_id, frame")
MEASURES = """(a.x + b.x) / 2 as x, (a.y + b.y) / 2 as y, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) as length,
  (sqrt((a.p1_x - a.p2_x) ** 2 + (a.p1_y - a.p2_y) ** 2) + sqrt((b.p1_x - b.p2_x) ** 2 + (b.p1_y - b.p2_y) ** 2)) / 2 as width,
  case when atan2(b.x - a.x, b.y - a.y) < 0 then atan2(b.x - a.x, b.y - a.y) + pi() else atan2(b.x - a.x, b.y - a.y) end as angle, p1 || ',' || p2 as zdiscs"""
NORM = {"norm": "select *, (length - avg(length) over w) / avg(length) over w as length_norm from smooth window w as (partition by movie_id, sarc_id)"}
MED = """select *, list_sort([coalesce(lag(length_norm, 2) over w, 0), coalesce(lag(length_norm) over w, 0), length_norm, coalesce(lead(length_norm) over w, 0), coalesce(lead(length_norm, 2) over w, 0)])[3] as med,
  case when lag(length_norm) over w is null then lead(length_norm) over w - length_norm when lead(length_norm) over w is null then length_norm - lag(length_norm) over w else (lead(length_norm) over w - lag(length_norm) over w) / 2 end as slope
  from norm window w as (partition by movie_id, sarc_id order by frame)"""
NORM_MED = {**NORM, "medians": MED}


def gradient_sql(reference: str) -> str:
    return f"""select movie_id, frame, f11, f12, f21, f22, f11 * f22 - f12 * f21 as j from (
      select movie_id, frame, (xx * syy - xy * sxy) / d as f11, (xy * sxx - xx * sxy) / d as f12, (yx * syy - yy * sxy) / d as f21, (yy * sxx - yx * sxy) / d as f22 from (
      select *, sxx * syy - sxy * sxy as d from (select s.movie_id as movie_id, s.frame as frame, covar_pop(s.x, r.x) as xx, covar_pop(s.x, r.y) as xy, covar_pop(s.y, r.x) as yx, covar_pop(s.y, r.y) as yy,
      var_pop(r.x) as sxx, covar_pop(r.x, r.y) as sxy, var_pop(r.y) as syy from smooth s join ({reference}) r on r.movie_id = s.movie_id and r.sarc_id = s.sarc_id group by all)))"""


DEFORMED = {"deformed": gradient_sql("select * from smooth where frame = 0"), "ordered": "select movie_id, frame, sqrt(a * a + b * b) as oop, cos(atan2(b, a) / 2) as oop_vx, sin(atan2(b, a) / 2) as oop_vy from (select movie_id, frame, avg(cos(2 * angle)) as a, avg(sin(2 * angle)) as b from smooth group by all)"}
SPATIAL = {**FRAME_GRAPH, "weighted": "select movie_id, u, v, count(*) as weight from pruned group by all having count(*) >= 4", "places": f"select c.* from ({CENTERS}) c semi join (select movie_id, unnest([u, v]) as particle from weighted) e using (movie_id, particle)"}


def _centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sarcomeres.particle_centers(views.tracked_movie(spark, sf_dir))


def _pruned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    centers = _centers(spark, sf_dir)
    return centers, graph.detect_edges(centers, MOVIE)


def _smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.normalize_length(views.smooth_sarcomeres(spark, sf_dir))


# --- segmentation ---------------------------------------------------------------------------------------------------


@query("select movie_id, frame, row, col, 4 * value - coalesce(lag(value) over r, value) - coalesce(lead(value) over r, value) - coalesce(lag(value) over c, value) - coalesce(lead(value) over c, value) as value from pixels window r as (partition by frame, col order by row), c as (partition by frame, row order by col)", "value")
def laplace_pixels(spark, sf_dir):
    return segment.laplace_pixels(views.pixels(spark, sf_dir))


@query(
    """select movie_id, frame, arg_max(center, struct_pack(b := between_, k := -bin)) as threshold from (
      select *, case when nt > w then w * (nt - w) * (s / w - (st - s) / (nt - w)) ** 2 else -1.0::double end as between_ from (
      select *, sum(n) over u as w, sum(n * center) over u as s, sum(n) over (partition by frame) as nt, sum(n * center) over (partition by frame) as st from (
      select movie_id, frame, bin, lo + (bin + 0.5::double) * (hi - lo) / 256 as center, count(*) as n from (
      select movie_id, frame, lo, hi, least(floor((value - lo) / ((hi - lo) / 256)), 255)::bigint as bin from (select *, min(value) over (partition by frame) as lo, max(value) over (partition by frame) as hi from grey_values)) group by all)
      window u as (partition by frame order by bin))) group by all""",
    "threshold",
)
def otsu_threshold(spark, sf_dir):
    return segment.otsu_threshold(views.grey_values(spark, sf_dir))


@query(
    """select c.movie_id, c.frame, c.contour_id, x, y, p1_x, p1_y, p2_x, p2_y from (select movie_id, frame, contour_id, avg(x) as x, avg(y) as y from contour_points group by all) c join (
      select a.contour_id, a.x as p1_x, a.y as p1_y, b.x as p2_x, b.y as p2_y from contour_points a join contour_points b on a.contour_id = b.contour_id and a.seq < b.seq
      qualify row_number() over (partition by a.contour_id order by (a.x - b.x) ** 2 + (a.y - b.y) ** 2 desc, a.seq, b.seq) = 1) f on f.contour_id = c.contour_id""",
    "x y p1_x p1_y p2_x p2_y",
)
def contour_summary(spark, sf_dir):
    return segment.summarize_contours(views.contour_points(spark, sf_dir))


@query("select movie_id, frame, i, 0.2125::double * v[3 * i + 1] + 0.7154::double * v[3 * i + 2] + 0.0721::double * v[3 * i + 3] as value from (select 0::bigint as movie_id, vec_id::int as frame, embedding::double[] as v from embeddings), unnest(range(21)) r(i)", "value")
def gray_frames(spark, sf_dir):
    """Every embedding as a line of 21 coloured pixels."""
    return segment.to_gray(views.embedding_frames(spark, sf_dir, 1, 21, 3)).selectExpr("movie_id", "frame", "posexplode(pixels) as (i, value)").withColumn("i", F.col("i").cast("long"))


BLURRED = {
    "edged": "select frame, row, col, 4 * value - coalesce(lag(value) over r, value) - coalesce(lead(value) over r, value) - coalesce(lag(value) over c, value) - coalesce(lead(value) over c, value) as value from pixels window r as (partition by frame, col order by row), c as (partition by frame, row order by col)",
    "weights": "select i, exp(-0.5::double * i * i) / sum(exp(-0.5::double * i * i)) over () as weight from unnest(range(-4, 5)) k(i)",
    "across": "select e.frame as frame, t.row as row, e.col as col, sum(weight * value) as value from weights cross join unnest(range(8)) t(row) join edged e on e.row = greatest(0, least(7, t.row + i)) group by all",
    "blurred": "select e.frame as frame, e.row as row, t.col as col, sum(weight * value) as value from weights cross join unnest(range(8)) t(col) join across e on e.col = greatest(0, least(7, t.col + i)) group by all",
}


@query("select 0::bigint as movie_id, frame::int as frame, row * 8 + col as i, value from blurred", "value", **BLURRED)
def filter_frames(spark, sf_dir):
    """Every embedding as a frame of 8 x 8, through the Laplacian and the Gaussian."""
    return segment.filter_frames(views.embedding_frames(spark, sf_dir, 8, 8, 1)).selectExpr("movie_id", "frame", "posexplode(pixels) as (i, value)").withColumn("i", F.col("i").cast("long"))


@query("select movie_id, frame, x, y from fibre_zdiscs", "x y")
def zdisc_centers(spark, sf_dir):
    """The z-discs found in frames of bars that lie apart: as many as drawn, in the middle of each, to half a pixel (a closed contour has its
    first point twice, which shifts the mean of its points)."""
    found = segment.segment_zdiscs(views.fibre_movie(spark, sf_dir))
    return found.select("movie_id", "frame", (F.round(2 * F.col("x")) / 2).alias("x"), (F.round(2 * F.col("y")) / 2).alias("y"))


@query()
def segment_zdiscs(spark, sf_dir):
    return segment.segment_zdiscs(views.drawn_movie(spark, sf_dir))


@query(
    "select movie_id, frame, count(*) as sarcomeres, avg(length) as mean_length, avg((length - rest) / rest) as mean_norm from (select *, avg(length) over (partition by vec_id, k) as rest from fibre_lengths) group by all",
    "mean_length mean_norm",
)
def frames_to_curves(spark, sf_dir):
    """From raw frames to every movie's curve, against the beat that was drawn."""
    found, _ = movies.movies_to_sarcomeres(views.fibre_movie(spark, sf_dir))
    return series.normalize_length(found).groupBy(*FRAME).agg(F.count("length").alias("sarcomeres"), F.avg("length").alias("mean_length"), F.avg("length_norm").alias("mean_norm"))


# --- tracking -------------------------------------------------------------------------------------------------------


@query("select * from broken_movie qualify count(*) over (partition by movie_id, particle) >= 20", "x y p1_x p1_y p2_x p2_y")
def filter_stubs(spark, sf_dir):
    return track.filter_stubs(views.broken_movie(spark, sf_dir), 20)


@query("select movie_id, particle, count(*)::int as freq, count(*) = max(n) as is_full from (select *, max(frame) over (partition by movie_id) + 1 as n from tracked_movie) group by all")
def track_freq(spark, sf_dir):
    return track.with_freq(views.tracked_movie(spark, sf_dir)).select("movie_id", "particle", "freq", (F.col("freq") == F.col("num_frames")).alias("is_full")).distinct()


@query(CENTERS, "x y")
def particle_centers(spark, sf_dir):
    return _centers(spark, sf_dir)


BROKEN = {
    "parts": "select movie_id, particle, avg(x) as x, avg(y) as y, count(*) as freq from broken_movie group by all",
    "radii": "select movie_id, avg(d) as radius from (select a.movie_id as movie_id, a.particle, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) as d from parts a join parts b on a.movie_id = b.movie_id and a.particle <> b.particle group by all) group by all",
    # every cluster of these tracks is one pair, so the nearer number is the cluster's least
    "pairs": "select a.movie_id as movie_id, least(a.particle, b.particle) as cluster, a.particle as particle from parts a join parts b on a.movie_id = b.movie_id and a.particle <> b.particle and a.freq < 40 and b.freq < 40 join radii r on r.movie_id = a.movie_id where sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= radius",
    "merged": "select movie_id, frame, cluster, avg(x) as x, avg(y) as y, avg(p1_x) as p1_x, avg(p1_y) as p1_y, avg(p2_x) as p2_x, avg(p2_y) as p2_y from broken_movie join pairs using (movie_id, particle) group by all",
}


@query("select * from radii", "radius", **BROKEN)
def merge_radius(spark, sf_dir):
    return track.merge_radius(views.broken_movie(spark, sf_dir))


@query(
    """select movie_id, frame, particle, x, y, p1_x, p1_y, p2_x, p2_y, 40 as freq from broken_movie join (select movie_id, particle from parts where freq = 40) using (movie_id, particle)
      union all select movie_id, frame, -r as particle, x, y, p1_x, p1_y, p2_x, p2_y, (count(*) over (partition by movie_id, cluster))::int as freq from merged
      join (select movie_id, cluster, row_number() over (partition by movie_id order by cluster) as r from (select distinct movie_id, cluster from pairs)) using (movie_id, cluster)
      qualify count(*) over (partition by movie_id, cluster) > 30""",
    "x y p1_x p1_y p2_x p2_y",
    **BROKEN,
)
def merge_tracks(spark, sf_dir):
    return track.merge_partial_tracks(views.broken_movie(spark, sf_dir))


@query("select movie_id, frame, x, y, p1_x, p1_y, p2_x, p2_y, row_number() over (partition by movie_id, frame order by x, y) - 1 as particle from tracked_movie", "x y p1_x p1_y p2_x p2_y")
def image_particles(spark, sf_dir):
    return track.number_image_zdiscs(views.untracked_movie(spark, sf_dir))


@query(
    """select movie_id, frame, x, y, p1_x, p1_y, p2_x, p2_y, r - 1 as particle from tracked_movie t join (select movie_id, particle, row_number() over (partition by movie_id order by frame, x, y) as r from (
      select * from tracked_movie qualify row_number() over (partition by movie_id, particle order by frame) = 1)) using (movie_id, particle)""",
    "x y p1_x p1_y p2_x p2_y",
)
def link_zdiscs(spark, sf_dir):
    return track.link_zdiscs(views.untracked_movie(spark, sf_dir))


@query(
    """select movie_id, frame, x, y, m.r - 1 as particle
      from crowded_movie join (
        select particle, row_number() over (order by frame, x, y) as r
        from (select * from crowded_movie qualify row_number() over (partition by particle order by frame) = 1)) m using (particle)""",
    "x y",
)
def link_crowded(spark, sf_dir):
    """One movie of all z-discs, linked part by part."""
    return track.link_zdiscs(views.crowded_movie(spark, sf_dir).drop("particle"), huge=True)


# --- sarcomeres -----------------------------------------------------------------------------------------------------


@query("select * from knn", **MOVIE_GRAPH)
def knn_edges(spark, sf_dir):
    return graph.knn_edges(_centers(spark, sf_dir), MOVIE)


@query(
    """select distinct movie_id, least(n, m) as u, greatest(n, m) as v
      from (
        select a.movie_id, a.particle as n, b.particle as m,
          row_number() over (partition by a.particle order by (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.particle) as r
        from clumped_nodes a join clumped_nodes b on a.particle <> b.particle)
      where r <= 3"""
)
def knn_clumped(spark, sf_dir):
    """The neighbours in one graph of very uneven density."""
    return graph.knn_edges(views.clumped_nodes(spark, sf_dir), MOVIE)


@query("select * from scored", "length score", centers=CENTERS, **graph_sql("centers", "movie_id", OWN_SCORE))
def score_edges_own(spark, sf_dir):
    """Scores by functions of the caller's own."""
    centers = _centers(spark, sf_dir)
    return graph.score_edges(
        graph.knn_edges(centers, MOVIE), centers, MOVIE, c_avg_length=2.0, c_angle=0.5, c_length_diff=3.0,
        f_angle=lambda theta: theta, f_length_diff=lambda l1, l2: F.exp(-F.abs(l2 - l1)), f_avg_length=lambda l1, l_avg: 1 / (1 + (l1 - l_avg) ** 2),
    )


@query("select * from scored", "length score", **MOVIE_GRAPH)
def score_edges(spark, sf_dir):
    centers = _centers(spark, sf_dir)
    return graph.score_edges(graph.knn_edges(centers, MOVIE), centers, MOVIE)


@query("select * from pruned", "score", **MOVIE_GRAPH)
def prune_edges(spark, sf_dir):
    return _pruned(spark, sf_dir)[1]


@query(
    "select movie_id, particle, min(other) as component_id from reach group by all",
    **MOVIE_GRAPH,
    sides="select movie_id, u as a, v as b from pruned union all select movie_id, v, u from pruned",
    reach="select movie_id, particle, particle as other from centers union select r.movie_id, r.particle, b.b from reach r join sides b on b.movie_id = r.movie_id and b.a = r.other",
)
def myofibrils(spark, sf_dir):
    centers, edges = _pruned(spark, sf_dir)
    return graph.myofibrils(centers, edges, MOVIE)


SARCS = {**MOVIE_GRAPH, "edges": "select movie_id, u as p1, v as p2, row_number() over (partition by movie_id order by u, v) - 1 as sarc_id from pruned", "sarcs": f"select e.movie_id, f.frame::int as frame, sarc_id::int as sarc_id, p1, p2, {MEASURES} from edges e cross join unnest(range(40)) f(frame) left join tracked_movie a on a.movie_id = e.movie_id and a.frame = f.frame and a.particle = p1 left join tracked_movie b on b.movie_id = e.movie_id and b.frame = f.frame and b.particle = p2"}


@query("select * from sarcs", "x y length width angle", **SARCS)
def sarcomere_measures(spark, sf_dir):
    tracks = views.tracked_movie(spark, sf_dir)
    return sarcomeres.detect_sarcomeres(tracks)


@query("select movie_id, frame, avg(length_norm) as mean_norm, median(length_norm) as median_norm from (select *, (length - avg(length) over w) / avg(length) over w as length_norm from sarcs window w as (partition by movie_id, sarc_id)) group by all", "mean_norm median_norm", **SARCS)
def movie_curves(spark, sf_dir):
    """The flagship: from tracked z-discs to every movie's mean normalised length by frame."""
    found = sarcomeres.detect_sarcomeres(views.tracked_movie(spark, sf_dir))
    return series.frame_curves(series.normalize_length(found))


@query(f"select e.movie_id, e.frame, sarc_id::int as sarc_id, p1, p2, {MEASURES} from (select movie_id, frame, u as p1, v as p2, row_number() over (partition by movie_id, frame order by u, v) - 1 as sarc_id from pruned) e join tracked_movie a on a.movie_id = e.movie_id and a.frame = e.frame and a.particle = p1 join tracked_movie b on b.movie_id = e.movie_id and b.frame = e.frame and b.particle = p2", "x y length width angle", **FRAME_GRAPH)
def untracked_detection(spark, sf_dir):
    return sarcomeres.detect_by_frame(views.tracked_movie(spark, sf_dir))


IMAGED = {"imaged": "select movie_id, frame, x, y, p1_x, p1_y, p2_x, p2_y, row_number() over (partition by movie_id, frame order by x, y) - 1 as particle from tracked_movie", **graph_sql("imaged", "movie_id, frame")}


@query(f"select e.movie_id, e.frame, sarc_id::int as sarc_id, p1, p2, {MEASURES} from (select movie_id, frame, u as p1, v as p2, row_number() over (partition by movie_id, frame order by u, v) - 1 as sarc_id from pruned) e join imaged a on a.movie_id = e.movie_id and a.frame = e.frame and a.particle = p1 join imaged b on b.movie_id = e.movie_id and b.frame = e.frame and b.particle = p2", "x y length width angle", **IMAGED)
def image_detection(spark, sf_dir):
    """Every frame as an image of its own, its z-discs numbered by their places."""
    return sarcomeres.detect_by_frame(track.track_zdiscs(views.untracked_movie(spark, sf_dir), image=True))


@query("select movie_id, zdiscs, coalesce(n, 0) as sarcomeres from (select movie_id, count(*) as zdiscs from tracked_movie where frame = 11 group by all) left join (select movie_id, count(*) as n from sarcs where frame = 11 and length is not null group by all) using (movie_id)", **SARCS)
def frame_slice_counts(spark, sf_dir):
    tracks = views.tracked_movie(spark, sf_dir)
    return sarcomeres.frame_slice(tracks, sarcomeres.detect_sarcomeres(tracks), 11)


@query("select * from tracked_movie", "x y p1_x p1_y p2_x p2_y")
def stage_round_trip(spark, sf_dir):
    """The tracked movie as a stage that is written and read again."""
    tracks, path = views.tracked_movie(spark, sf_dir), shared_path(spark, "stages")
    tables.write_stage(tracks, path, "tracked_zdiscs")
    return tables.read_stage(spark, path, "tracked_zdiscs")


# --- series ---------------------------------------------------------------------------------------------------------


@query("select * from norm", "x y length width angle length_norm", **NORM)
def length_norm(spark, sf_dir):
    return _smooth(spark, sf_dir)


@query("select movie_id, frame, avg(length_norm) as mean_norm, median(length_norm) as median_norm from norm group by all", "mean_norm median_norm", **NORM)
def frame_curves(spark, sf_dir):
    return series.frame_curves(_smooth(spark, sf_dir))


@query("select movie_id, sarc_id, frame, med from medians", "med", **NORM_MED)
def median_filter(spark, sf_dir):
    return series.filtered(_smooth(spark, sf_dir)).select("movie_id", "sarc_id", "frame", "med")


@query("select movie_id, sarc_id, frame, slope from medians", "slope", **NORM_MED)
def gradient(spark, sf_dir):
    return series.filtered(_smooth(spark, sf_dir)).select("movie_id", "sarc_id", "frame", "slope")


@query("select movie_id, sarc_id, count(*) filter (slope > th) as count_r, count(*) filter (slope < -th) as count_c, count(*) filter (slope between -th and th) as count_f from (select *, 0.025::double * (max(med) over w - min(med) over w) as th from medians window w as (partition by movie_id, sarc_id)) group by all", **NORM_MED)
def phase_counts(spark, sf_dir):
    return series.phase_counts(series.phase_labels(_smooth(spark, sf_dir)))


@query("select movie_id, count(*) filter (slope > th) as count_r, count(*) filter (slope < -th) as count_c, count(*) filter (slope between -th and th) as count_f from (select *, 0.01::double * (max(j) over w - min(j) over w) as th, case when lag(j) over o is null then lead(j) over o - j when lead(j) over o is null then j - lag(j) over o else (lead(j) over o - lag(j) over o) / 2 end as slope from deformed window w as (partition by movie_id), o as (partition by movie_id order by frame)) group by all", **DEFORMED)
def j_phases(spark, sf_dir):
    deformed = analysis.deformation(views.smooth_sarcomeres(spark, sf_dir))
    return series.phase_counts(series.phase_labels(deformed, "j", 0.01, of_filtered=False, key=("movie_id",)), ("movie_id",))


@query("select movie_id, sarc_id, frame, length_norm from (select *, lag(length_norm) over w as b, lead(length_norm) over w as a from norm window w as (partition by movie_id, sarc_id order by frame)) where length_norm < a and length_norm < b", "length_norm", **NORM)
def local_minima(spark, sf_dir):
    return series.local_minima(_smooth(spark, sf_dir), "length_norm")


@query("select movie_id, sarc_id, median(length) as pix_length_median, avg(length) as pix_length_mean, min(length) as pix_length_min, max(length) as pix_length_max, 100 * (max(length) - min(length)) / max(length) as pix_percent_shortening from smooth group by all", "pix_length_median pix_length_mean pix_length_min pix_length_max pix_percent_shortening")
def length_stats(spark, sf_dir):
    return series.length_stats(_smooth(spark, sf_dir))


FILLED = """select movie_id, sarc_id, frame, coalesce(length, case when f1 > f0 then v0 + (v1 - v0) * (frame - f0) / (f1 - f0) end, v0, v1) as length from (
  select *, last_value(case when length is not null then frame end ignore nulls) over b as f0, last_value(length ignore nulls) over b as v0, first_value(case when length is not null then frame end ignore nulls) over a as f1, first_value(length ignore nulls) over a as v1
  from series window b as (partition by sarc_id order by frame rows between unbounded preceding and current row), a as (partition by sarc_id order by frame rows between current row and unbounded following))"""


@query(FILLED, "length")
def fill_linear(spark, sf_dir):
    return series.fill_linear(views.series(spark, sf_dir))


@query("select a.movie_id, a.sarc_id as sarc_a, b.sarc_id as sarc_b, sqrt(sum((a.length_norm - b.length_norm) ** 2)) as dist from norm a join norm b on a.movie_id = b.movie_id and a.frame = b.frame and a.sarc_id < b.sarc_id group by all", "dist", **NORM)
def euclidean_pairs(spark, sf_dir):
    return series.pair_distances(_smooth(spark, sf_dir), "euclidean")


DTW = """select movie_id, sarc_a, sarc_b, sqrt(list_last(list_reduce(list_prepend(list_prepend(0.0::double, list_transform(t, lambda v: 'inf'::double)), list_transform(s, lambda v: [v])),
  lambda last_row, x: list_reduce(list_prepend(['inf'::double], list_transform(range(1, len(t) + 1), lambda k: [k::double])),
    lambda acc, j: list_append(acc, (x[1] - t[j[1]::int]) ** 2 + least(last_row[j[1]::int], last_row[j[1]::int + 1], acc[j[1]::int])))))) as dist
  from (select a.movie_id as movie_id, a.sarc_id as sarc_a, b.sarc_id as sarc_b, a.s as s, b.s as t from arrays a join arrays b on a.movie_id = b.movie_id and a.sarc_id < b.sarc_id)"""


@query(DTW, "dist", **NORM, arrays="select movie_id, sarc_id, list(length_norm order by frame) as s from norm group by all")
def dtw_pairs(spark, sf_dir):
    return series.pair_distances(_smooth(spark, sf_dir), "dtw")


#: Ward's tree in SQL: the state of a step holds the distances of all clusters that are left; the nearest two of each movie merge.
WARD = {
    **NORM,
    "ward_leaves": """select movie_id, sarc_id, row_number() over (partition by movie_id order by sarc_id) - 1 as leaf,
      count(*) over (partition by movie_id) as leaves
      from (select distinct movie_id, sarc_id from norm)""",
    "ward_states": """select a.movie_id as movie_id, 0::bigint as step, x.leaf as u, y.leaf as v, 1::bigint as nu, 1::bigint as nv,
        sum((a.length_norm - b.length_norm) ** 2) as d, x.leaves as leaves
      from norm a join norm b on a.movie_id = b.movie_id and a.frame = b.frame and a.sarc_id < b.sarc_id
        join ward_leaves x on x.movie_id = a.movie_id and x.sarc_id = a.sarc_id
        join ward_leaves y on y.movie_id = b.movie_id and y.sarc_id = b.sarc_id
      group by all
      union all
      select movie_id, step + 1, p as u, q as v,
        max(case when touched then nk else nu end) as nu, max(case when touched then mn else nv end) as nv,
        case when touched then (sum((ns + nk) * d) - max(nk) * max(md)) / (max(mn) + max(nk)) else max(d) end as d, leaves
      from (
        select movie_id, step, nu, nv, d, leaves, m.d as md, m.nu + m.nv as mn,
          case when u in (m.u, m.v) then v when v in (m.u, m.v) then u else u end as p,
          case when u in (m.u, m.v) or v in (m.u, m.v) then leaves + step else v end as q,
          u in (m.u, m.v) or v in (m.u, m.v) as touched,
          case when u in (m.u, m.v) then nu else nv end as ns, case when u in (m.u, m.v) then nv else nu end as nk
        from ward_states join (
          select movie_id, arg_min({'u': u, 'v': v, 'nu': nu, 'nv': nv, 'd': d}, d) as m from ward_states group by movie_id) using (movie_id)
        where not (u = m.u and v = m.v))
      group by movie_id, step, p, q, touched, leaves""",
    "ward_merges": """select movie_id, step, leaves, m.u as a, m.v as b, sqrt(m.d) as height, m.nu as na, m.nu + m.nv as size
      from (select movie_id, step, leaves, arg_min({'u': u, 'v': v, 'nu': nu, 'nv': nv, 'd': d}, d) as m from ward_states group by all)""",
    "ward_starts": """select movie_id, step, 0::bigint as start from ward_merges where size = leaves
      union all
      select c.movie_id, c.step, s.start + case when p.b = p.leaves + c.step then p.na else 0 end
      from ward_starts s join ward_merges p on p.movie_id = s.movie_id and p.step = s.step
        join ward_merges c on c.movie_id = p.movie_id and (p.a = c.leaves + c.step or p.b = c.leaves + c.step)""",
    "ward_places": """select movie_id, leaf, pos from (
        select movie_id, leaves, unnest([{'leaf': a, 'pos': start}, {'leaf': b, 'pos': start + size - 1}], recursive := true)
        from ward_merges join ward_starts using (movie_id, step))
      where leaf < leaves""",
}
LEAF_ORDER = "select movie_id, sarc_id, pos::int as pos from ward_places join ward_leaves using (movie_id, leaf)"


def _distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.pair_distances(_smooth(spark, sf_dir), "euclidean")


@query(
    """select movie_id, step::int as step, a::int as a, b::int as b, height, size::int as size, string_agg(sarc_id, ',' order by pos) as leaves
      from ward_merges join ward_starts using (movie_id, step) join ward_places using (movie_id) join ward_leaves using (movie_id, leaf)
      where pos >= start and pos < start + size
      group by all""",
    "height",
    **WARD,
)
def ward_linkage(spark, sf_dir):
    return series.ward_linkage(_distances(spark, sf_dir)).withColumn("leaves", F.array_join("leaves", ","))


@query(LEAF_ORDER, **WARD)
def leaf_order(spark, sf_dir):
    return series.leaf_order(series.ward_linkage(_distances(spark, sf_dir)))


@query(
    """select movie_id, step::int as step, a::int as a, b::int as b, height, size::int as size, start::int as start
      from ward_merges join ward_starts using (movie_id, step)""",
    "height",
    **WARD,
)
def ward_tree(spark, sf_dir):
    """Ward's linkage by rounds of joins, for movies of any number of series."""
    return linkage.ward_tree(materialize(_distances(spark, sf_dir), "distances"))


@query(LEAF_ORDER, **WARD)
def leaf_positions(spark, sf_dir):
    distances = materialize(_distances(spark, sf_dir), "distances")
    return linkage.leaf_positions(linkage.ward_tree(distances), linkage.leaf_numbers(distances))


@query()
def smooth_columns(spark, sf_dir):
    """All five columns of the tracked sarcomeres, whose gaps are filled."""
    return series.smooth_gpr(sarcomeres.detect_sarcomeres(views.tracked_movie(spark, sf_dir)))


@query()
def smooth_gpr(spark, sf_dir):
    return series.smooth_gpr(views.series(spark, sf_dir), ("length",))


def valleys_sql(medians: str, width: float = 5.0) -> dict[str, str]:
    """peaks of -med in `medians`: plateaus by runs, the higher of near ones by recursion, the width at half prominence."""
    own = "r.movie_id = x.movie_id and r.sarc_id = x.sarc_id"
    return {
        "turned": f"select movie_id, sarc_id, frame, -med as v from {medians}",
        "numbered": "select *, sum(up) over (partition by movie_id, sarc_id order by frame) as run from (select *, case when v = lag(v) over (partition by movie_id, sarc_id order by frame) then 0 else 1 end as up from turned)",
        "tops": "select * from (select *, lag(v) over w as b, lead(v) over w as a from (select movie_id, sarc_id, run, any_value(v) as v, (min(frame) + max(frame)) // 2 as f from numbered group by all) window w as (partition by movie_id, sarc_id order by run)) where b < v and a < v",
        "chosen": "select movie_id, sarc_id, list(struct_pack(f := f, v := v) order by v desc, f desc) as rest, []::integer[] as kept from tops group by all union all select movie_id, sarc_id, list_filter(rest[2:], lambda c: abs(c.f - rest[1].f) >= 10), list_append(kept, rest[1].f::integer) from chosen where len(rest) > 0",
        "picked": "select r.*, x.v as top from (select movie_id, sarc_id, unnest(kept) as p from chosen where len(rest) = 0) r join turned x on r.movie_id = x.movie_id and r.sarc_id = x.sarc_id and x.frame = p",
        "based": f"select r.*, coalesce(max(x.frame) filter (x.frame < p and x.v > top) + 1, 0) as low, coalesce(min(x.frame) filter (x.frame > p and x.v > top) - 1, max(x.frame)) as high from picked r join turned x on {own} group by all",
        "levels": f"select r.*, any_value(top) - (any_value(top) - greatest(min(x.v) filter (x.frame between low and p), min(x.v) filter (x.frame between p and high))) / 2 as level from based r join turned x on {own} group by all",
        "ends": f"select r.*, coalesce(max(x.frame) filter (x.frame between low and p and x.v <= level), any_value(low)) as i, coalesce(min(x.frame) filter (x.frame between p and high and x.v <= level), any_value(high)) as j from levels r join turned x on {own} group by all",
        "crossed": f"select r.*, max(x.v) filter (x.frame = i) as vi, max(x.v) filter (x.frame = i + 1) as vi1, max(x.v) filter (x.frame = j) as vj, max(x.v) filter (x.frame = j - 1) as vj1 from ends r join turned x on {own} group by all",
        "valleys": "select movie_id, sarc_id, p::int as frame, -top as med from crossed where (j - case when vj < level then (level - vj) / (vj1 - vj) else 0 end) - (i + case when vi < level then (level - vi) / (vi1 - vi) else 0 end) >= " + str(width),
    }


FILLED_NORM = {"filled": FILLED, "filled_norm": "select *, (length - avg(length) over w) / avg(length) over w as length_norm from filled window w as (partition by movie_id, sarc_id)", "filled_medians": MED.replace("from norm window", "from filled_norm window")}
VALLEYS = {**FILLED_NORM, **valleys_sql("filled_medians")}


@query("select * from valleys", "med", **VALLEYS)
def find_valleys(spark, sf_dir):
    filled = series.normalize_length(series.fill_linear(views.series(spark, sf_dir)))
    return series.find_valleys(series.filtered(filled))


@query("select movie_id, frame, med as j from valleys", "j", **DEFORMED, whole_j="select movie_id, 0 as sarc_id, frame, j as med from deformed", **valleys_sql("whole_j", 1.0))
def j_valleys(spark, sf_dir):
    """Frames in which the movie as a whole is smallest, with valleys of any width."""
    deformed = analysis.deformation(views.smooth_sarcomeres(spark, sf_dir))
    return series.find_valleys(series.filtered(deformed, "j", ("movie_id",)), "j", width=1.0, key=("movie_id",))


@query(
    """select s.movie_id as movie_id, s.sarc_id as sarc_ids, pix_length_median, pix_length_mean, pix_length_min, pix_length_max, pix_percent_shortening, c / n as mean_contraction_time, r / n as mean_relax_time, f / n as mean_flat_time, num_frames / n as mean_period_len, coalesce(first, 0)::double as frames_to_first_peak, n as peaks_count
      from (select s.*, first, case when coalesce(deep, 0) > 0 then deep::double else 'inf'::double end as n from stats s left join (select v.movie_id as movie_id, v.sarc_id as sarc_id, min(frame) as first, count(*) filter (med < mean_med - th) as deep from valleys v join stats t on t.movie_id = v.movie_id and t.sarc_id = v.sarc_id group by all) b on b.movie_id = s.movie_id and b.sarc_id = s.sarc_id) s
      join (select movie_id as m, max(frame) + 1 as num_frames from filled group by all) on m = s.movie_id""",
    "pix_length_median pix_length_mean pix_length_min pix_length_max pix_percent_shortening mean_contraction_time mean_relax_time mean_flat_time mean_period_len",
    **VALLEYS,
    stats="""select movie_id, sarc_id, median(length) as pix_length_median, avg(length) as pix_length_mean, min(length) as pix_length_min, max(length) as pix_length_max, 100 * (max(length) - min(length)) / max(length) as pix_percent_shortening, avg(med) as mean_med, any_value(th) as th,
      count(*) filter (slope > th) as r, count(*) filter (slope < -th) as c, count(*) filter (slope between -th and th) as f from (select *, 0.025::double * (max(med) over w - min(med) over w) as th from filled_medians window w as (partition by movie_id, sarc_id)) group by all""",
)
def ts_params(spark, sf_dir):
    return series.ts_params(series.normalize_length(series.fill_linear(views.series(spark, sf_dir))))


# --- analysis -------------------------------------------------------------------------------------------------------


@query("select * from deformed", "f11 f12 f21 f22 j", **DEFORMED)
def deformation(spark, sf_dir):
    return analysis.deformation(views.smooth_sarcomeres(spark, sf_dir))


@query(gradient_sql("select s.* from smooth s join (select movie_id, arg_max(frame, struct_pack(a := j, b := -frame)) as frame from deformed group by all) using (movie_id, frame)"), "f11 f12 f21 f22 j", **DEFORMED)
def deformation_adjusted(spark, sf_dir):
    return analysis.deformation(views.smooth_sarcomeres(spark, sf_dir), adjust_reference=True)


@query("select * from ordered", "oop oop_vx oop_vy", **DEFORMED)
def order_parameter(spark, sf_dir):
    return analysis.order_parameter(views.smooth_sarcomeres(spark, sf_dir))


METRICS = (
    """select movie_id, oop, 1 - sqrt(j) as c_iso, (v0 - v) / v0 as c_oop, s_til, s_avg from (select *, sqrt(oop_vx ** 2 + oop_vy ** 2) as v, sqrt(((f22 * oop_vx - f12 * oop_vy) / j) ** 2 + ((f11 * oop_vy - f21 * oop_vx) / j) ** 2) as v0
      from deformed join ordered using (movie_id, frame) qualify row_number() over (partition by movie_id order by j, frame) = 1)
      join (select movie_id, median(s) as s_til from (select movie_id, sarc_id, (max(length_norm) - min(length_norm)) / (max(length_norm) + 1) as s from norm group by all) group by all) using (movie_id)
      join (select movie_id, (max(m) - min(m)) / (max(m) + 1) as s_avg from (select movie_id, frame, avg(length_norm) as m from norm group by all) group by all) using (movie_id)""",
    "oop c_iso c_oop s_til s_avg",
)


@query(*METRICS, **DEFORMED, **NORM)
def movie_metrics(spark, sf_dir):
    smooth = _smooth(spark, sf_dir)
    return analysis.movie_metrics(smooth, analysis.deformation(smooth), analysis.order_parameter(smooth))


@query(*METRICS, **DEFORMED, **NORM)
def metrics_json(spark, sf_dir):
    """The metrics as JSON that is written and read again."""
    path = shared_path(spark, "metrics")
    smooth = _smooth(spark, sf_dir)
    tables.write_metrics_json(analysis.movie_metrics(smooth, analysis.deformation(smooth), analysis.order_parameter(smooth)), path)
    return spark.read.schema("movie_id long, oop double, c_iso double, c_oop double, s_til double, s_avg double").json(path)


@query(
    """select movie_id, frame, sqrt(greatest((q - gap) / 2, 0)) as lambda1, sqrt((q + gap) / 2) as lambda2, -sin(phi) as v1_x, cos(phi) as v1_y, cos(phi) as v2_x, sin(phi) as v2_y from (
      select *, case when gap > 1e-6 then atan2(2 * (f11 * f21 + f12 * f22), f11 ** 2 + f12 ** 2 - f21 ** 2 - f22 ** 2) / 2 end as phi from (
      select *, sqrt(greatest(q ** 2 - 4 * j ** 2, 0)) as gap from (select *, f11 ** 2 + f12 ** 2 + f21 ** 2 + f22 ** 2 as q from deformed)))""",
    "lambda1 lambda2 v1_x v1_y v2_x v2_y",
    **DEFORMED,
)
def stretches(spark, sf_dir):
    return analysis.principal_stretches(analysis.deformation(views.smooth_sarcomeres(spark, sf_dir)))


@query("select * from weighted", **SPATIAL)
def spatial_graph(spark, sf_dir):
    return analysis.spatial_graph(views.tracked_movie(spark, sf_dir))[0]


@query("select * from places", "x y", **SPATIAL)
def spatial_nodes(spark, sf_dir):
    return analysis.spatial_graph(views.tracked_movie(spark, sf_dir))[1]


@query("select e.movie_id, u, v, case when a.y = b.y then 0 else abs(a.y - b.y) / sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) end as orientation from weighted e join places a on a.movie_id = e.movie_id and a.particle = u join places b on b.movie_id = e.movie_id and b.particle = v", "orientation", **SPATIAL)
def edge_orientation(spark, sf_dir):
    return analysis.edge_orientation(*analysis.spatial_graph(views.tracked_movie(spark, sf_dir)))


@query(
    """select movie_id, particle, alignment, (case when alignment > 0.9 then 2 when alignment > 0.75 then 1 else 0 end)::int as level, 1 - (0.75 * coalesce((alignment - min(alignment) over w) / nullif(max(alignment) over w - min(alignment) over w, 0), 0) + 0.25) as grey from (
      select p.movie_id, p.particle, coalesce(a, 0) as alignment from places p left join (select e.movie_id as movie_id, e.n as particle, avg(abs(e.ax * f.ax + e.ay * f.ay)) as a from units e join units f on e.movie_id = f.movie_id and e.n = f.n and e.m < f.m group by all) q on q.movie_id = p.movie_id and q.particle = p.particle)
      window w as (partition by movie_id)""",
    "alignment grey",
    **SPATIAL,
    units="select movie_id, n, m, vx / sqrt(vx ** 2 + vy ** 2) as ax, vy / sqrt(vx ** 2 + vy ** 2) as ay from (select d.movie_id as movie_id, n, m, b.x - a.x as vx, b.y - a.y as vy from (select movie_id, u as n, v as m from weighted union all select movie_id, v, u from weighted) d join places a on a.movie_id = d.movie_id and a.particle = n join places b on b.movie_id = d.movie_id and b.particle = m)",
)
def node_alignment(spark, sf_dir):
    return analysis.node_alignment(*analysis.spatial_graph(views.tracked_movie(spark, sf_dir)))


@query("select movie_id, frame, atan2(avg(sin(angle)), avg(cos(angle))) as mean_angle, sqrt(avg(sin(angle)) ** 2 + avg(cos(angle)) ** 2) as radius from smooth group by all", "mean_angle radius")
def circular_mean(spark, sf_dir):
    return analysis.circular_mean(views.smooth_sarcomeres(spark, sf_dir), FRAME)


@query(
    """select movie_id, bin::bigint as bin, lo + bin * (hi - lo) / 10 as low, lo + (bin + 1) * (hi - lo) / 10 as high, coalesce(n, 0) as count, median from (select movie_id, min(length) as lo, max(length) as hi, median(length) as median from smooth group by all) cross join unnest(range(10)) b(bin)
      left join (select movie_id as m, k, count(*) as n from (select s.movie_id as movie_id, least(floor((length - lo) / ((hi - lo) / 10)), 9) as k from smooth s join (select movie_id, min(length) as lo, max(length) as hi from smooth group by all) e on e.movie_id = s.movie_id) group by all) c on m = movie_id and k = bin""",
    "low high median",
)
def histogram(spark, sf_dir):
    return analysis.histogram(views.smooth_sarcomeres(spark, sf_dir), "length")


@query("select movie_id, sarc_id, frame, case when abs(length_norm) < 0.2 then 2.5::double * abs(length_norm) + 0.5::double else abs(length_norm) end as level from norm", "level", **NORM)
def contraction_level(spark, sf_dir):
    return analysis.contraction_level(_smooth(spark, sf_dir)).select("movie_id", "sarc_id", "frame", "level")


@query()
def bootstrap_length(spark, sf_dir):
    smooth = views.smooth_sarcomeres(spark, sf_dir)
    mu = smooth.groupBy(*FRAME).agg(F.avg("length").alias("mu"), F.count(F.lit(1)).alias("size"))
    drawn = compare.bootstrap_mean_diff(smooth.select(*FRAME, F.col("length").alias("value")).join(mu, FRAME))
    return drawn.groupBy(*FRAME).agg(F.avg("diff").alias("mean"), F.stddev("diff").alias("sd"))


@query()
def tracked_vs_untracked(spark, sf_dir):
    tracks = views.tracked_movie(spark, sf_dir)
    return compare.tracked_vs_untracked(views.smooth_sarcomeres(spark, sf_dir), sarcomeres.detect_by_frame(tracks))


@query("select movie_id, frame, true as centred, true as as_wide from smooth group by all")
def bootstrap_bounds(spark, sf_dir):
    """Whether the bootstrap of every frame is centred within five standard errors and as wide, within 15 %, as theory says."""
    smooth = views.smooth_sarcomeres(spark, sf_dir)
    known = smooth.groupBy(*FRAME).agg(F.avg("length").alias("mu"), F.count(F.lit(1)).alias("size"), (F.stddev_pop("length") / F.sqrt(F.count(F.lit(1)))).alias("error"))
    drawn = compare.bootstrap_mean_diff(smooth.select(*FRAME, F.col("length").alias("value")).join(known, FRAME))
    seen = drawn.groupBy(*FRAME).agg(F.avg("diff").alias("mean"), F.stddev("diff").alias("sd"), F.count(F.lit(1)).alias("runs")).join(known, FRAME)
    return seen.select(*FRAME, (F.abs("mean") <= 5 * F.col("error") / F.sqrt("runs")).alias("centred"), F.col("sd").between(0.85 * F.col("error"), 1.15 * F.col("error")).alias("as_wide"))


@query("select movie_id, frame, true as centred, true as in_range from smooth group by all")
def angle_bounds(spark, sf_dir):
    """Whether the bootstrap of the angles of every frame is centred on the circular mean and the radius stays in range."""
    smooth = views.smooth_sarcomeres(spark, sf_dir)
    known = analysis.circular_mean(smooth, FRAME).withColumnRenamed("mean_angle", "mu").join(smooth.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("size")), FRAME)
    drawn = compare.bootstrap_angle_diff(smooth.select(*FRAME, F.col("angle").alias("value")).join(known, FRAME)).join(known.select(*FRAME, "radius"), FRAME)
    found = drawn.groupBy(*FRAME, "radius").agg(F.avg("diff_angle").alias("mean"), F.stddev("diff_angle").alias("sd"), F.min("diff_radius").alias("low"), F.max("diff_radius").alias("high"), F.count(F.lit(1)).alias("runs"))
    return found.select(*FRAME, (F.abs("mean") <= 6 * F.col("sd") / F.sqrt("runs")).alias("centred"), ((F.col("low") >= F.col("radius") - 1 - 1e-9) & (F.col("high") <= F.col("radius") + 1e-9)).alias("in_range"))


@query(
    "select movie_id, frame, count(*) as untracked, any_value(n) as tracked, true as ordered from pruned join (select movie_id as m, max(sarc_id) + 1 as n from smooth group by all) on m = movie_id group by movie_id, frame",
    **FRAME_GRAPH,
)
def comparison_counts(spark, sf_dir):
    """How many sarcomeres of each kind are compared in every frame, and whether the quartiles of all differences are in order."""
    found = tracked_vs_untracked(spark, sf_dir)
    names = [f.name for f in found.schema.fields if isinstance(f.dataType, T.ArrayType)]
    in_order = F.forall(F.array(*(F.array_sort(c) == F.col(c) for c in names)), lambda same: same)
    return found.select(*FRAME, "untracked", "tracked", in_order.alias("ordered"))


@query(
    "select movie_id, n - 1 as merges, n as leaves, true as rising, d as first_height from (select movie_id, count(distinct sarc_id) as n from norm group by all) join (select m, min(dist) as d from (select a.movie_id as m, sqrt(sum((a.length_norm - b.length_norm) ** 2)) as dist from norm a join norm b on a.movie_id = b.movie_id and a.frame = b.frame and a.sarc_id < b.sarc_id group by a.movie_id, a.sarc_id, b.sarc_id) group by all) on m = movie_id",
    "first_height",
    **NORM,
)
def ward_shape(spark, sf_dir):
    """What every linkage must be: one merge fewer than series, all leaves in the last, heights that rise from the least distance."""
    linked = series.ward_linkage(series.pair_distances(_smooth(spark, sf_dir), "euclidean"))
    rise = F.col("height") >= F.coalesce(F.lag("height").over(Window.partitionBy("movie_id").orderBy("step")), F.lit(0.0)) - 1e-9
    return linked.withColumn("rise", rise).groupBy("movie_id").agg(F.count(F.lit(1)).alias("merges"), F.max(F.size(F.array_distinct("leaves"))).cast("long").alias("leaves"), F.bool_and("rise").alias("rising"), F.min("height").alias("first_height"))
