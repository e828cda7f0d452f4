"""Known answers, brute force and invariants of the movie operators."""

import itertools
import math
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from myospark import schemas
from myospark.functions import assignment, images, signals
from myospark.jobs import movies, queries, views
from myospark.operators import analysis, compare, components, graph, linkage, sarcomeres, segment, series, track
from myospark.sources import npy, tables

SEGMENTED = [(0, 0.0, 0.0), (0, 40.0, 40.0), (1, 0.2, 0.0), (1, 1.1, 1.0), (1, 39.0, 38.0), (2, 1.2, 1.2), (2, 37.0, 35.0)]


def zdiscs(spark, rows):
    return spark.createDataFrame([(0, f, x, y, 0.0, 1.0, 2.0, 3.0) for f, x, y in rows], schemas.ZDISCS)


def nodes(spark, places, key=0):
    return spark.createDataFrame([(key, i, float(x), float(y)) for i, (x, y) in enumerate(places)], "movie_id long, particle long, x double, y double")


def pairs(df):
    return sorted((r.u, r.v) for r in df.collect())


# --- frames ---


def test_contour_summary(spark):
    points = [(-2, -1), (0, -1), (2, -1), (2, 1), (0, 1), (-2, 1)]
    rows = [(0, 0, 0, [(float(x), float(y)) for x, y in points]), (0, 0, 1, [(0.0, 0.0), (1.0, 1.0)]), (0, 0, 2, None)]
    found = segment.summarize_contours(spark.createDataFrame(rows, schemas.CONTOURS)).collect()
    assert [tuple(r)[3:] for r in found] == [(0.0, 0.0, -2.0, -1.0, 2.0, 1.0)]


@pytest.mark.parametrize("axis", [0, 1])
def test_filter_keeps_a_line(axis):
    frame = np.zeros((65, 65, 1))
    frame[(slice(None), 32) if axis else 32] = 1
    assert (images.filter_frame(frame, 1.0).argmax(axis) == 32).all()


def test_gray_and_bad_channels():
    assert np.allclose(images.gray(np.ones((2, 3, 3))), 1)
    with pytest.raises(ValueError):
        images.gray(np.ones((2, 3, 2)))


def test_otsu_and_contours_of_a_bright_square():
    frame = np.zeros((20, 20))
    frame[5:10, 5:10] = 1.0
    level = images.otsu(frame)
    found = images.contours(frame, level)
    assert len(found) == 1 and (found[0][0] == found[0][-1]).all()
    assert np.allclose(images.summary(found[0][:-1])[:2], [7, 7], atol=0.01)
    assert images.contours(np.zeros((5, 5)), 0.0) == []


def test_open_contour_has_two_ends():
    frame = np.tile(np.arange(6.0), (4, 1))
    (line,) = images.contours(frame, 2.5)
    assert len(line) == 4 and np.allclose(line[:, 1], 2.5)


def test_segmentation_finds_the_drawn_bars(spark, sf_dir):
    frames = views.drawn_movie(spark, sf_dir).where("frame < 3 and movie_id = 0")
    bars = views.tracked_movie(spark, sf_dir).where("frame < 3 and movie_id = 0").count()
    assert segment.segment_zdiscs(frames).count() == bars
    steps = segment.summarize_contours(segment.detect_contours(segment.filter_frames(segment.to_gray(frames))))
    assert steps.count() == bars
    assert schemas.bad_frames(frames.withColumn("height", F.lit(3))).count() == 3


def test_angles_of_stripes(spark):
    upright = zdiscs(spark, [(0, 10.0 * i, 5.0) for i in range(5)]).withColumn("particle", (F.col("x") / 10).cast("long"))
    level = zdiscs(spark, [(0, 5.0, 10.0 * i) for i in range(5)]).withColumn("particle", (F.col("y") / 10).cast("long"))
    assert all(math.isclose(r.angle, math.pi / 2) for r in sarcomeres.detect_by_frame(upright, l_avg=10.0).collect())
    assert all(min(r.angle, math.pi - r.angle) < 0.01 for r in sarcomeres.detect_by_frame(level, l_avg=10.0).collect())


# --- tracking ---


def test_tracking_golden(spark):
    found = track.track_zdiscs(zdiscs(spark, SEGMENTED), search_range=4.0).orderBy(F.desc("particle"), "frame").collect()
    assert [(r.particle, r.frame, round(r.x, 6), round(r.y, 6), r.freq) for r in found] == [
        (1, 0, 40.0, 40.0, 3), (1, 1, 39.0, 38.0, 3), (1, 2, 37.0, 35.0, 3), (-1, 0, 0.0, 0.0, 3), (-1, 1, 0.65, 0.5, 3), (-1, 2, 1.2, 1.2, 3),
    ]
    unmerged = track.track_zdiscs(zdiscs(spark, SEGMENTED), skip_merging=True)
    assert "freq" not in unmerged.columns and unmerged.groupBy("particle").count().where("count < 2").count() == 0


def test_tracking_input_checks(spark):
    with pytest.raises(TypeError):
        track.track_zdiscs([1, 2])
    with pytest.raises(ValueError):
        track.track_zdiscs(zdiscs(spark, SEGMENTED).drop("x"))
    assert schemas.bad_movies(zdiscs(spark, SEGMENTED[:2])).count() == 1
    assert schemas.bad_movies(zdiscs(spark, SEGMENTED), image=True).count() == 1
    assert track.link_zdiscs(zdiscs(spark, [])).count() == 0


def test_assignment_is_the_cheapest():
    rnd = np.random.default_rng(1)
    for _ in range(100):
        a, b = rnd.uniform(0, 6, (rnd.integers(1, 5), 2)), rnd.uniform(0, 6, (rnd.integers(1, 5), 2))
        got = assignment.cheapest_links(a, b, 2.5)

        def cost(links):
            used = [t for t in links if t >= 0]
            return sum(((a[t] - b[j]) ** 2).sum() for j, t in enumerate(links) if t >= 0) + 6.25 * (len(a) - len(used))

        options = [c for c in itertools.product(range(-1, len(a)), repeat=len(b)) if len({t for t in c if t >= 0}) == sum(t >= 0 for t in c) and all(t < 0 or ((a[t] - b[j]) ** 2).sum() <= 6.25 for j, t in enumerate(c))]
        assert math.isclose(cost(got), min(map(cost, options)), abs_tol=1e-9)


# --- graphs ---


def test_knn_of_a_square_is_complete(spark):
    square = nodes(spark, [(0, 0), (1, 0), (0, 1), (1, 1)])
    assert len(pairs(graph.knn_edges(square, ["movie_id"]))) == 6
    assert len(pairs(graph.knn_edges(nodes(spark, [(0, 0), (500, 0)]), ["movie_id"]))) == 1


def nearest_by_brute_force(places, k=3):
    d = ((places[:, None] - places[None]) ** 2).sum(2) + np.where(np.eye(len(places)), np.inf, 0)
    return sorted({(min(i, j), max(i, j)) for i in range(len(places)) for j in np.argsort(d[i], kind="stable")[: min(k, len(places) - 1)].tolist()})


CLUMPS = {
    "even": lambda r: r.uniform(-5, 5, (40, 2)),
    "one far": lambda r: np.vstack([r.uniform(0, 1, (80, 2)), [[1e6, -1e6]]]),
    "two clumps": lambda r: np.vstack([r.uniform(0, 1, (50, 2)), r.uniform(0, 1, (3, 2)) + 1e4]),
    "a line": lambda r: np.column_stack([r.permutation(60) * 1.0, np.zeros(60)]),
    "in one place": lambda r: np.zeros((9, 2)),
    "lattice": lambda r: np.stack(np.meshgrid(np.arange(9.0), np.arange(9.0)), -1).reshape(-1, 2),
    "scales": lambda r: r.normal(0, 1, (90, 2)) * 8.0 ** (np.arange(90) % 9)[:, None],
    "few": lambda r: r.random((3, 2)),
}


@pytest.mark.parametrize("clump", sorted(CLUMPS))
def test_neighbours_of_clumped_graphs(spark, clump):
    places = CLUMPS[clump](np.random.default_rng(2))
    assert pairs(graph.knn_edges(nodes(spark, places), ["movie_id"])) == nearest_by_brute_force(places)


def test_neighbours_of_several_graphs_at_once(spark):
    rnd = np.random.default_rng(3)
    own = {m: CLUMPS[c](rnd) for m, c in enumerate(sorted(CLUMPS))}
    rows = [(m, k, float(x), float(y)) for m, places in own.items() for k, (x, y) in enumerate(places)] + [(0, 999, None, 1.0)]
    found = graph.knn_edges(spark.createDataFrame(rows, "movie_id long, particle long, x double, y double"), ["movie_id"]).collect()
    for m, places in own.items():
        assert sorted((r.u, r.v) for r in found if r.movie_id == m) == nearest_by_brute_force(places)


def test_work_of_a_clumped_graph_follows_its_nodes(spark):
    """Candidates of a graph with one far point are at most half more than those of the even graph."""
    even = np.random.default_rng(4).random((4000, 2))
    reach = {}
    for name, places in (("even", even), ("far", np.vstack([even, [[1e5, 1e5]]]))):
        reached = graph.with_reach(nodes(spark, places), ["movie_id"], 3).toPandas()
        assert reached.reach.notna().all()
        reach[name] = (reached.reach**2).to_numpy()
    assert np.sort(reach["far"])[:-1].sum() <= 1.5 * reach["even"].sum() and reach["even"].sum() * 4000 * np.pi < 30 * 4000


def test_series_with_the_same_frames_share_kernels(monkeypatch):
    rnd, calls, eigh = np.random.default_rng(22), [], np.linalg.eigh
    monkeypatch.setattr(np.linalg, "eigh", lambda m: calls.append(len(m)) or eigh(m))
    monkeypatch.setattr(signals, "_kernels", signals._Kernels(1 << 20))
    x = np.arange(50.0)
    alone = signals._Kernels(0)
    for k in range(40):
        y = np.sin(x / 4 + k) + rnd.normal(0, 0.2, 50)
        y[::7] = np.nan
        found = signals.gp_smooth(x, [y])
        shared = signals._kernels
        monkeypatch.setattr(signals, "_kernels", alone)
        before = len(calls)
        assert (signals.gp_smooth(x + 1000 * (k + 1), [y])[0] == found[0]).all()  # frames of its own
        assert len(calls) - before > 15
        del calls[before:]
        monkeypatch.setattr(signals, "_kernels", shared)
    assert len(calls) < 10 * 40 and signals._kernels.size == sum(n.size() for n, _ in signals._kernels.held.values())
    for k in range(30):
        signals.gp_smooth(np.arange(30.0) * (k + 1), [rnd.normal(0, 1, 30)])
    assert signals._kernels.size <= 1 << 20


def test_graphs_in_tasks_and_by_joins_are_the_same(spark, monkeypatch):
    """Frames of 0 to 60 nodes, on a grid with many equal distances: whole in tasks, in parts that end between batches, or by joins."""
    rnd = np.random.default_rng(21)
    rows = [(k % 3, k, p, float(x), float(y)) for k in range(40) for p, (x, y) in enumerate(rnd.integers(0, 12, (int(rnd.integers(0, 61)), 2)).tolist())]
    frames = spark.createDataFrame(rows, "movie_id long, frame int, particle long, x double, y double")
    key = ["movie_id", "frame"]
    each = lambda: (sorted(graph.nearest(frames, key, 3).collect()), sorted(graph.knn_edges(frames, key).collect()), sorted(tuple(r)[:-1] + (round(r.score, 9),) for r in graph.detect_edges(frames, key, l_avg=1.0).collect()))
    own = each()
    assert len(own[0]) > 2000 and len(own[2]) > 50
    monkeypatch.setattr(graph, "ROWS", 50)
    monkeypatch.setattr(graph, "CELLS", 100)
    assert each() == own
    monkeypatch.setattr(graph, "LOCAL", 20)
    assert each() == own
    monkeypatch.setattr(graph, "LOCAL", 0)
    assert each() == own


def test_edges_of_small_graphs_are_dealt_twice(spark, sf_dir):
    """Once for the neighbours and once for the scores and votes, where each join and each grouping had a shuffle of its own."""
    edges = graph.detect_edges(views.tracked_movie(spark, sf_dir), ["movie_id", "frame"])
    assert edges._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 2


def test_scores_and_pruning_of_a_line(spark):
    line = nodes(spark, [(0, 0), (1, 0), (2, 0), (3, 0)])
    edges = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 2, 3)], "movie_id long, u long, v long")
    scored = graph.score_edges(edges, line, ["movie_id"], l_avg=1.0)
    assert all(math.isclose(r.score, 3.0) for r in scored.collect())
    assert pairs(graph.prune_edges(scored, line, ["movie_id"], 1.0, 1.0)) == [(0, 1), (1, 2), (2, 3)]


def test_coincident_points_do_not_break_the_graph(spark):
    twice = nodes(spark, [(0, 0), (0, 0), (12, 0), (24, 0)])
    assert graph.detect_edges(twice, ["movie_id"]).count() > 0


def test_pruned_nodes_have_two_edges_at_most(spark, sf_dir):
    edges = graph.detect_edges(sarcomeres.particle_centers(views.tracked_movie(spark, sf_dir)), ["movie_id"])
    ends = edges.select("movie_id", F.explode(F.array("u", "v")).alias("n")).groupBy("movie_id", "n").count()
    assert ends.agg(F.max("count")).first()[0] <= 2


def test_components_by_stars_and_by_key(spark):
    rnd = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rnd.integers(0, 60, (45, 2))] + [(k, k + 1) for k in range(100, 140)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    frame = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.root for r in components.connected_components(frame).collect()} == {x: root(x) for x in parent}
    keyed = components.components_by_key(frame.where("a <> b").withColumn("movie_id", F.lit(1)), ["movie_id"]).collect()
    assert {r.node: r.root for r in keyed} == {x: root(x) for x in parent}


def test_partitions_do_not_matter(spark, sf_dir):
    def run():
        return sorted(map(tuple, sarcomeres.detect_sarcomeres(views.tracked_movie(spark, sf_dir).where("movie_id = 1")).select("frame", "p1", "p2", F.round("length", 9)).collect()), key=str)

    first = run()
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert run() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


# --- series ---


def test_dtw_literal_and_naive(spark):
    assert math.isclose(signals.dtw_many([np.array([1, 2, 3])], [np.array([2, 2, 2, 3, 4])])[0] ** 2, 2)
    rnd = np.random.default_rng(4)
    for _ in range(20):
        a, b = rnd.normal(size=rnd.integers(1, 7)), rnd.normal(size=rnd.integers(1, 7))
        t = np.full((len(a) + 1, len(b) + 1), np.inf)
        t[0, 0] = 0
        for i, j in itertools.product(range(len(a)), range(len(b))):
            t[i + 1, j + 1] = (a[i] - b[j]) ** 2 + min(t[i, j], t[i, j + 1], t[i + 1, j])
        assert math.isclose(signals.dtw_many([a], [b])[0], math.sqrt(t[-1, -1]))
    assert np.isnan(signals.dtw_many([None, np.zeros(0)], [np.ones(2), np.ones(2)])).all()
    with pytest.raises(ValueError):
        series.pair_distances(_tiny(), "cosine")


def _tiny():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().createDataFrame([(0, 0, 0, 1.0)], "movie_id long, sarc_id long, frame int, length_norm double")


def test_gp_fills_the_gap():
    (found,) = signals.gp_smooth(np.arange(5.0), [np.array([0, 1, np.nan, 3, 4])])
    assert np.allclose(found, [0, 1, 2, 3, 4], atol=0.01)
    flat, empty = signals.gp_smooth(np.arange(4.0), [np.array([2.0, 2, np.nan, 2]), np.full(4, np.nan)])
    assert np.allclose(flat, 2) and np.isnan(empty).all()


def test_gp_table(spark):
    rows = [(0, k, 0, *[None if c == k else float(k) for c in range(5)]) for k in range(5)]
    frame = spark.createDataFrame(rows, "movie_id long, frame int, sarc_id long, x double, y double, length double, angle double, width double")
    found = series.normalize_length(series.smooth_gpr(frame)).toPandas().sort_values("frame")
    assert not found.isna().any().any() and list(found.frame) == [0, 1, 2, 3, 4] and "length_norm" in found


def test_valleys_of_a_beat():
    x = -np.cos(np.arange(80) * 2 * np.pi / 20)
    assert signals.peaks(-x, 10, 5).tolist() == [20, 40, 60]
    assert signals.peaks(np.array([0, 1, 1, 0.0, 0, 0]), 1, 0).tolist() == [1]
    assert signals.peaks(np.zeros(10), 10, 5).tolist() == []
    close = np.zeros(40)
    close[[10, 15]] = 1, 2
    assert signals.peaks(close, 10, 0).tolist() == [15]


def test_ts_params_of_a_beat_and_of_none(spark):
    t = np.arange(80)
    beat = pd.DataFrame({"movie_id": 0, "sarc_id": 0, "frame": t, "length": 10 - np.cos(t * 2 * np.pi / 20)})
    flat = beat.assign(sarc_id=1, length=10.0)
    found = series.ts_params(series.normalize_length(spark.createDataFrame(pd.concat([beat, flat])).withColumn("frame", F.col("frame").cast("int")))).toPandas().set_index("sarc_ids")
    assert found.peaks_count[0] == 3 and found.frames_to_first_peak[0] == 20 and math.isclose(found.mean_period_len[0], 80 / 3)
    total = found.mean_contraction_time[0] + found.mean_relax_time[0] + found.mean_flat_time[0]
    assert math.isclose(total * 3, 80)
    assert found.peaks_count[1] == math.inf and found.mean_flat_time[1] == 0


def test_ward_heights_and_leaves(spark):
    x = np.array([0.0, 1.0, 10.0, 12.0, 30.0])
    merges = signals.ward(np.abs(x[:, None] - x[None]))
    assert [m[:2] for m in merges] == [(0, 1), (2, 3), (5, 6), (4, 7)]
    assert math.isclose(merges[2][2], math.sqrt(2 * 2 * 2 / 4) * 10.5) and merges[-1][4] == [4, 0, 1, 2, 3]
    rows = [(0, a, b, float(abs(x[a] - x[b]))) for a in range(5) for b in range(a + 1, 5)]
    linked = series.ward_linkage(spark.createDataFrame(rows, "movie_id long, sarc_a long, sarc_b long, dist double"))
    assert [r.sarc_id for r in series.leaf_order(linked).orderBy("pos").collect()] == [4, 0, 1, 2, 3]


# --- analysis ---


def test_deformation_is_the_map_of_all_pairs(spark, sf_dir):
    smooth = views.smooth_sarcomeres(spark, sf_dir).where("movie_id = 0")
    f = analysis.deformation(smooth).orderBy("frame").toPandas()
    p = smooth.toPandas()
    ref, now = (p[p.frame == k].sort_values("sarc_id")[["x", "y"]].to_numpy() for k in (0, 7))
    i, j = np.triu_indices(len(ref), 1)
    r, t = (ref[i] - ref[j]).T, (now[i] - now[j]).T
    wanted = t @ r.T @ np.linalg.inv(r @ r.T)
    row = f[f.frame == 7].iloc[0]
    assert np.allclose([[row.f11, row.f12], [row.f21, row.f22]], wanted)
    zero = f[f.frame == 0].iloc[0]
    assert np.allclose([zero.f11, zero.f12, zero.f21, zero.f22, zero.j], [1, 0, 0, 1, 1])
    s = analysis.principal_stretches(analysis.deformation(smooth)).where("frame = 7").first()
    assert np.allclose([s.lambda1, s.lambda2], np.linalg.svd(wanted)[1][::-1])


def test_deformation_of_a_line_is_null(spark):
    rows = [(0, f, k, float(k), 2.0 * k) for f in (0, 1) for k in range(4)]
    found = analysis.deformation(spark.createDataFrame(rows, "movie_id long, frame int, sarc_id long, x double, y double"))
    assert all(r.j is None for r in found.collect())


def test_order_parameter_and_circular_mean(spark):
    one = spark.createDataFrame([(0, 0, k, 0.3) for k in range(5)], "movie_id long, frame int, sarc_id long, angle double")
    r = analysis.order_parameter(one).first()
    assert np.allclose([r.oop, r.oop_vx, r.oop_vy], [1, math.cos(0.3), math.sin(0.3)])
    two = spark.createDataFrame([(0, math.pi / 6), (0, 5 * math.pi / 6), (0, float("nan")), (0, None)], "movie_id long, angle double")
    r = analysis.circular_mean(two, ["movie_id"]).first()
    assert np.allclose([r.mean_angle, r.radius], [math.pi / 2, 0.5])


def test_histogram_closes_the_last_bin(spark):
    found = analysis.histogram(spark.createDataFrame([(0, float(v)) for v in range(11)], "movie_id long, v double"), "v").orderBy("bin").collect()
    assert [r["count"] for r in found] == [1] * 9 + [2] and found[0].median == 5
    same = analysis.histogram(spark.createDataFrame([(0, 1.0), (0, 1.0)], "movie_id long, v double"), "v").where("count > 0").collect()
    assert [(r.bin, r["count"]) for r in same] == [(0, 2)]


def test_bootstrap_bounds(spark):
    schema = "movie_id long, frame int, value double, mu double, size long"
    same = compare.bootstrap_mean_diff(spark.createDataFrame([(0, 0, 1.0, 1.0, 2)] * 4, schema), runs=5)
    assert [r["diff"] for r in same.collect()] == [0.0] * 5
    less = compare.bootstrap_mean_diff(spark.createDataFrame([(0, 0, float(v), 0.0, 3) for v in (1, 2, 3, 4)], schema), runs=5)
    assert all(r["diff"] < 0 for r in less.collect())
    turned = compare.bootstrap_angle_diff(spark.createDataFrame([(0, 0, 1.0, 0.0, 2.0, 5)] * 10, "movie_id long, frame int, value double, mu double, radius double, size long"), runs=5).collect()
    assert all(math.isclose(r.diff_angle, -1) and math.isclose(r.diff_radius, 1) for r in turned)


def test_comparison_is_the_same_every_time(spark, sf_dir):
    tracks = views.tracked_movie(spark, sf_dir).where("movie_id = 0 and frame < 4")
    smooth = views.smooth_sarcomeres(spark, sf_dir).where("movie_id = 0 and frame < 4")
    found = [sorted(map(tuple, compare.tracked_vs_untracked(smooth, sarcomeres.detect_by_frame(tracks), 1, 3, runs=20).collect())) for _ in range(2)]
    assert found[0] == found[1] and [r[1] for r in found[0]] == [1, 2]


# --- sources and whole jobs ---


def test_npy_and_csv(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(24.0).reshape(2, 3, 4))
    found = tables.read_frames_npy(spark, str(tmp_path)).orderBy("frame").collect()
    assert [(r.frame, r.height, r.width, r.channels, r.pixels[0]) for r in found] == [(0, 3, 4, 1, 0.0), (1, 3, 4, 1, 12.0)]
    (tmp_path / "z.csv").write_text(",frame,x,y,p1_x,p1_y,p2_x,p2_y\n0,0,1.5,,0,1,2,3\n1,1.0,nan,2.0,0,1,2,3\n")
    rows = tables.read_zdiscs(spark, str(tmp_path / "z.csv"), movie_id=7).orderBy("frame").collect()
    assert [(r.movie_id, r.frame, r.x, r.y) for r in rows] == [(7, 0, 1.5, None), (7, 1, None, 2.0)]
    with pytest.raises(FileNotFoundError, match="detect_sarcomeres"):
        tables.read_stage(spark, str(tmp_path), "sarcomeres")


def test_jobs_end_to_end(spark, sf_dir, tmp_path):
    frames = views.drawn_movie(spark, sf_dir).where("movie_id = 0 and frame < 5")
    found, fibrils = movies.movies_to_sarcomeres(frames, save=str(tmp_path))
    assert found.where("length is null").count() < 0.1 * found.count() and fibrils.count() > 50
    again = tables.read_stage(spark, str(tmp_path), "sarcomeres")
    assert again.count() == found.count()
    out = movies.run_all(series.normalize_length(series.smooth_gpr(found)), tables.read_stage(spark, str(tmp_path), "tracked_zdiscs"))
    assert {k: v.count() > 0 for k, v in out.items()} == dict.fromkeys(out, True)
    tables.write_metrics_json(out["metrics"], str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics")).columns == ["c_iso", "c_oop", "movie_id", "oop", "s_avg", "s_til"]


def test_saved_stages_give_what_one_pass_does(spark, sf_dir, tmp_path):
    frames = views.fibre_movie(spark, sf_dir).where("movie_id < 2")
    saved, whole = movies.movies_to_sarcomeres(frames, save=str(tmp_path)), movies.movies_to_sarcomeres(frames)
    for a, b in zip(saved, whole, strict=True):
        assert a.schema == b.schema or [f.name for f in a.schema] == [f.name for f in b.schema]
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() > 0
    assert {p.name for p in tmp_path.iterdir()} == {"filtered", "contours", "zdiscs", "tracked_zdiscs", "sarcomeres", "myofibrils"}


def test_clusters_of_three_and_lone_tracks(spark):
    places = {0: (0.0, 0.0, range(40)), 1: (50.0, 0.0, range(13)), 2: (50.5, 0.0, range(13, 26)), 3: (51.0, 0.0, range(26, 40)), 4: (1000.0, 0.0, range(35)), 5: (0.0, 1000.0, range(20))}
    rows = [(0, f, p, x, y, x, y, x, y) for p, (x, y, frames) in places.items() for f in frames]
    tracks = spark.createDataFrame(rows, "movie_id long, frame int, particle long, x double, y double, p1_x double, p1_y double, p2_x double, p2_y double")
    assert {r.particle: r.cluster for r in track.cluster_partial(tracks).collect()} == {1: 1, 2: 1, 3: 1, 4: None, 5: None}
    merged = track.merge_partial_tracks(tracks)
    assert {(r.particle, r.freq, r["count"]) for r in merged.groupBy("particle", "freq").count().collect()} == {(0, 40, 40), (-2, 40, 40), (4, 35, 35)}


@pytest.mark.parametrize("spread", [1.0, 1000.0])
def test_neighbours_of_any_density(spark, spread):
    rnd = np.random.default_rng(9)
    places = rnd.random((60, 2)) * spread
    found = pairs(graph.knn_edges(nodes(spark, places), ["movie_id"]))
    d = ((places[:, None] - places[None]) ** 2).sum(2) + np.where(np.eye(60), np.inf, 0)
    assert found == sorted({(min(i, j), max(i, j)) for i in range(60) for j in np.argsort(d[i], kind="stable")[:3].tolist()})


def test_ward_of_six_thousand():
    x = np.sort(np.random.default_rng(2).random(6000))
    merges = signals.ward(np.abs(x[:, None] - x[None]))
    assert len(merges) == 5999 and merges[-1][3] == 6000 and sorted(merges[-1][4]) == list(range(6000))
    assert all(a[2] <= b[2] + 1e-12 for a, b in zip(merges, merges[1:]))


@pytest.mark.parametrize("name", ["bootstrap_length", "tracked_vs_untracked"])
def test_bootstrap_queries_draw_the_default_runs(name, spark, monkeypatch):
    from myospark.jobs import queries

    seen = []
    for kind in ("bootstrap_mean_diff", "bootstrap_angle_diff"):
        real = getattr(compare, kind)
        monkeypatch.setattr(compare, kind, lambda *a, real=real, **k: seen.append(k.get("runs", compare.RUNS)) or real(*a, **k))
    queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen and set(seen) == {compare.RUNS}


# --- points furthest apart ---


def test_furthest_points_by_brute_force(monkeypatch):
    monkeypatch.setattr(images, "ALL_PAIRS", 0)
    rnd = np.random.default_rng(17)
    t = np.linspace(0, 2 * np.pi, 64, endpoint=False)
    shapes = [rnd.normal(0, 1, (n, 2)) for n in (3, 4, 9, 60)] + [rnd.integers(0, m, (n, 2)).astype(float) for m in (1, 2, 4, 9) for n in (3, 8, 50) for _ in range(6)]
    shapes += [np.column_stack([np.cos(t), np.sin(t)]), np.column_stack([np.arange(9.0), 2 * np.arange(9.0)]), np.zeros((5, 2)), np.array([[0, 0], [1, 0], [1, 1], [0, 1.0]])]
    shapes += [np.round(4 * np.column_stack([np.cos(t), np.sin(t)])), np.column_stack([rnd.random(200), rnd.random(200) * 1e-9])]
    for points in shapes:
        points = points[rnd.permutation(len(points))]
        d = ((points[:, None] - points[None]) ** 2).sum(2)
        i, j = images.furthest(points)
        assert d[i, j] == d.max() and (i, j) == tuple(np.unravel_index(int(np.argmax(d)), d.shape)), points


def test_furthest_of_fifty_thousand_points():
    t = np.linspace(0, 2 * np.pi, 50_000, endpoint=False)
    line = np.column_stack([3 * np.cos(t), np.sin(t)])
    i, j = images.furthest(line)
    assert {i, j} == {0, 25_000}


# --- bootstraps by counts ---


def test_bootstrap_counts_are_multinomial():
    """Means and variances of the draws against their exact values, however the rows are cut into parts."""
    rnd = np.random.default_rng(15)
    values, size, runs = rnd.gamma(2.0, 3.0, 700), 90, 20_000
    for at_once in (1 << 30, 20_000 * 64):
        signals.DRAWS, kept = at_once, signals.DRAWS
        try:
            found = -signals.bootstrap_means(values, 0.0, size, runs, np.random.default_rng(1))
        finally:
            signals.DRAWS = kept
        error = values.std() / np.sqrt(size)
        assert abs(found.mean() - values.mean()) < 5 * error / np.sqrt(runs)
        assert abs(found.std() / error - 1) < 0.03
        drawn = np.random.default_rng(2).choice(values, (runs, size)).mean(1)  # the draws themselves
        assert np.allclose(np.quantile(found, [0.05, 0.25, 0.5, 0.75, 0.95]), np.quantile(drawn, [0.05, 0.25, 0.5, 0.75, 0.95]), atol=6 * error / np.sqrt(runs) * 2)


def test_bootstrap_of_angles_by_counts():
    values = np.random.default_rng(16).normal(0.4, 0.2, 300)
    angle, radius = signals.bootstrap_angles(values, 0.0, 0.0, 100, 5000, np.random.default_rng(3))
    s, c = np.sin(values).mean(), np.cos(values).mean()
    assert abs(-angle.mean() - np.arctan2(s, c)) < 0.002 and abs(-radius.mean() - np.hypot(s, c)) < 0.002


def test_bootstrap_sums_are_whole():
    rows = np.column_stack([np.ones(50), np.arange(50.0)])
    sums = signals.bootstrap_sums(rows, np.full(50, 0.02), np.array([0, 7, 1000]), np.random.default_rng(4))
    assert sums[:, 0].tolist() == [0, 7, 1000]


# --- movies added to results ---


def test_movies_are_added_one_by_one(spark, tmp_path):
    first = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0)], "movie_id long, frame int, x double")
    tables.write_stage(first, str(tmp_path), "zdiscs")
    tables.write_stage(first.selectExpr("movie_id + 1 as movie_id", "frame", "x"), str(tmp_path), "zdiscs")
    tables.write_stage(first.where("frame = 0"), str(tmp_path), "zdiscs")
    found = sorted((r.movie_id, r.frame, r.x) for r in tables.read_stage(spark, str(tmp_path), "zdiscs").collect())
    assert found == [(1, 0, 1.0), (2, 0, 1.0), (2, 1, 2.0)]


# --- one large movie ---


def test_parts_of_a_movie_link_as_the_whole(spark):
    rnd = np.random.default_rng(12)
    rows = []
    for movie in range(2):
        places = rnd.uniform(0, 120, (150, 2))
        for frame in range(12):
            places = places + rnd.normal(0, 1.2, places.shape)
            rows += [(movie, frame, float(x), float(y)) for x, y in places[rnd.random(150) > 0.15]]
    movie = spark.createDataFrame(rows, "movie_id long, frame int, x double, y double")
    key = lambda df: sorted(map(tuple, df.select("movie_id", "frame", "x", "y", "particle").collect()))
    whole, parts = track.link_zdiscs(movie), track.link_zdiscs(movie, huge=True)
    assert parts.columns == whole.columns and key(parts) == key(whole)
    assert track.with_parts(movie, 4.0).select("movie_id", "part_x", "part_y").distinct().count() > 10


def test_parts_are_linked_many_at_once(spark, monkeypatch):
    """Hundreds of parts are a few groups, each part whole in one, in more than one task; two tracks that begin at one place differ in number."""
    monkeypatch.setattr(track, "TOGETHER", 300)
    rnd = np.random.default_rng(14)
    rows = [(m, f, 10.0 * (k % 20) + float(rnd.normal(0, 0.2)), 10.0 * (k // 20) + float(rnd.normal(0, 0.2))) for m in range(2) for k in range(200) for f in range(5 + m)]
    rows += [(2, f, 1.0, 1.0) for f in range(3)] * 2 + [(3, 0, None, 1.0), (3, 1, 2.0, None), (3, 1, 2.0, 2.0)]
    movie = spark.createDataFrame(rows, "movie_id long, frame int, x double, y double")
    parted = track._with_parts(movie, 4.0)
    own = parted.where("movie_id < 2").groupBy("movie_id", "part_x", "part_y").agg(F.countDistinct("_group").alias("groups")).collect()
    assert len(own) == 400 and {r.groups for r in own} == {1}
    assert [r.n for r in parted.where("movie_id < 2").groupBy("movie_id").agg(F.countDistinct("_group").alias("n")).orderBy("movie_id").collect()] == [4, 4]
    key = lambda df: sorted(map(str, df.select("movie_id", "frame", "x", "y", "particle").collect()))
    whole, parts = (track.link_zdiscs(movie.where("movie_id < 3"), huge=h) for h in (False, True))
    assert key(parts) == key(whole)
    assert track.link_zdiscs(movie, huge=True).count() == len(rows)
    with_number = track._numbered(movie.where("movie_id < 2"), ["frame", "x", "y"])
    order = [(r.movie_id, r.number) for r in with_number.orderBy("movie_id", "frame", "x", "y").collect()]
    assert order == [(m, k) for m in range(2) for k in range(200 * (5 + m))]


def test_parts_lie_further_apart_than_the_search_range(spark):
    places = np.random.default_rng(13).uniform(-60, 60, (300, 2))
    movie = spark.createDataFrame([(0, 0, float(x), float(y)) for x, y in places], "movie_id long, frame int, x double, y double")
    parted = track.with_parts(movie, 4.0).toPandas()
    d = np.hypot(parted.x.to_numpy()[:, None] - parted.x.to_numpy(), parted.y.to_numpy()[:, None] - parted.y.to_numpy())
    part = parted.groupby(["part_x", "part_y"]).ngroup().to_numpy()
    assert d[part[:, None] != part].min() > 4.0


def test_parts_of_no_movie(spark):
    assert track.link_zdiscs(spark.createDataFrame([], "movie_id long, frame int, x double, y double"), huge=True).count() == 0


# --- stacks by byte ranges ---


def test_stacks_are_read_by_ranges(spark, tmp_path):
    stack = np.arange(40 * 6 * 5, dtype=np.int16).reshape(40, 6, 5)
    np.save(tmp_path / "a.npy", stack)
    (tmp_path / "deep").mkdir()
    np.save(tmp_path / "deep" / "b.npy", stack[:7, :, :, None].astype(">f4"))
    (tmp_path / "c.txt").write_text("no stack")
    found = npy.scan_npy(spark, str(tmp_path), part_bytes=10 * 60)
    assert found.rdd.getNumPartitions() == 4 + 2  # frames of 60 bytes, ten a part, and of 120 bytes, five a part
    rows = found.where("frame >= 3 and frame < 6").collect()
    assert sorted((r.path[-5:], r.frame) for r in rows) == [("a.npy", k) for k in (3, 4, 5)] + [("b.npy", k) for k in (3, 4, 5)]
    assert all(r.pixels == stack[r.frame].ravel().tolist() and (r.height, r.width, r.channels) == (6, 5, 1) for r in rows)
    assert npy.scan_npy(spark, str(tmp_path / "a.npy"), 600).where("frame in (1, 2, 30, 99)").rdd.getNumPartitions() == 2
    assert npy.scan_npy(spark, str(tmp_path)).where("frame > 100").count() == 0


def test_bytes_of_other_frames_are_not_read(tmp_path, monkeypatch):
    np.save(tmp_path / "a.npy", np.zeros((100, 20, 30)))
    got = []

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            data = self.f.read(n)
            got.append(len(data))
            return data

    real = npy.store

    class Where:
        def __init__(self, where):
            self.where = where

        def open_input_file(self, path):
            return Counted(self.where.open_input_file(path))

        def get_file_info(self, what):
            return self.where.get_file_info(what)

    monkeypatch.setattr(npy, "store", lambda uri: (Where(real(uri)[0]), real(uri)[1]))
    reader = npy.NpyReader(f"file:{tmp_path}", 10 * 4800)
    assert list(reader.pushFilters([npy.D.GreaterThanOrEqual(("frame",), 40), npy.D.LessThan(("frame",), 60), npy.D.IsNotNull(("frame",))])) == [npy.D.IsNotNull(("frame",))]
    parts = reader.partitions()
    assert len(parts) == 2 and sum(got) < 200
    assert [b.column("frame")[0].as_py() for p in parts for b in reader.read(p)] == list(range(40, 60))
    assert sum(got) < 200 + 20 * 4800


@pytest.mark.parametrize("stack, told", [(np.zeros(5), "dimensions"), (np.asfortranarray(np.ones((3, 4, 5))), "column by column"), (np.array([[[None]]]), "plain numbers")])
def test_stacks_that_are_refused(tmp_path, stack, told):
    np.save(tmp_path / "a.npy", stack)
    with pytest.raises(ValueError, match=told):
        npy.NpyReader(f"file:{tmp_path}", 100).partitions()


# --- linkage by rounds ---


def test_tree_by_rounds_is_that_of_the_chain(spark):
    rnd = np.random.default_rng(14)
    rows, own = [], {}
    for movie, n in ((3, 40), (4, 2), (5, 23)):
        ids = np.sort(rnd.choice(1000, n, replace=False))
        points = rnd.normal(0, 1, (n, 3)) + 6 * rnd.integers(0, 3, (n, 1))
        d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
        own[movie] = (ids, signals.ward(d))
        rows += [(movie, int(ids[i]), int(ids[j]), float(d[i, j])) for i in range(n) for j in range(i + 1, n)]
    distances = spark.createDataFrame(rows, "movie_id long, sarc_a long, sarc_b long, dist double")
    tree = linkage.ward_tree(distances)
    found, places = tree.orderBy("movie_id", "step").collect(), linkage.leaf_positions(tree, linkage.leaf_numbers(distances)).collect()
    for movie, (ids, merges) in own.items():
        mine = [r for r in found if r.movie_id == movie]
        assert [(r.step, r.a, r.b, r["size"]) for r in mine] == [(k, a, b, n) for k, (a, b, _, n, _) in enumerate(merges)]
        assert np.allclose([r.height for r in mine], [m[2] for m in merges], rtol=1e-9)
        order = [r.sarc_id for r in sorted((r for r in places if r.movie_id == movie), key=lambda r: r.pos)]
        assert order == [int(ids[k]) for k in merges[-1][4]]
        for r, (*_, leaves) in zip(mine, merges, strict=True):
            assert order[r.start : r.start + r["size"]] == [int(ids[k]) for k in leaves]


def test_tree_of_equal_distances_and_of_nothing(spark):
    rows = [(0, a, b, 1.0) for a in range(6) for b in range(a)]
    kind = "movie_id long, sarc_a long, sarc_b long, dist double"
    tree = linkage.ward_tree(spark.createDataFrame(rows, kind)).collect()
    assert sorted(r["size"] for r in tree)[-1] == 6 and len(tree) == 5
    assert linkage.ward_tree(spark.createDataFrame([], kind)).count() == 0


def test_workspace_and_discard(spark):
    from myospark import storage

    frame = spark.range(5).toDF("n")
    with storage.workspace(spark) as keep:
        gone = storage.materialize(frame, "gone")
        kept = keep(storage.materialize(frame, "kept"))
    assert kept.count() == 5 and gone.stored_at not in storage._written[spark.sparkContext.applicationId]
    storage.discard(kept)
    with pytest.raises(Exception):
        kept.count()


def test_doubles_round_as_duckdb_does(spark):
    import duckdb

    values = [10.433887499999999, 10.324137499999999, -10.433887499999999, 2.5e-7, 4.5e-6, 1e300, 0.0, *(k / 1e7 + 10 for k in range(5, 2000, 10))]
    found = [r[0] for r in queries.rounded(spark.createDataFrame([(v,) for v in values], "v double")).collect()]
    assert found == [duckdb.execute("select round(?::double, 6)", [v]).fetchone()[0] for v in values]


@pytest.mark.parametrize("name", ["drawn_movie", "fibre_movie"])
def test_bars_travel_and_not_their_pixels(name, spark, sf_dir):
    plan = getattr(views, name)(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "collect_set" not in plan


def test_draws_of_a_comparison_stay_in_their_task(spark):
    rows = [(0, f, k, 10.0 + k / 7, 8.0 - k / 9, 0.1 * k) for f in range(3) for k in range(6)] + [(0, 3, 0, 9.0, None, 0.2)]
    tracked = spark.createDataFrame(rows, "movie_id long, frame int, sarc_id int, length double, width double, angle double")
    found = compare.tracked_vs_untracked(tracked, tracked.drop("sarc_id"), runs=40)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroups") == 3 and "percentile" not in plan
    known = {r.frame: r for r in found.collect()}  # a frame without any width is not compared
    assert set(known) == {0, 1, 2} and all(r.untracked == r.tracked == 6 for r in known.values())
    drawn = signals.bootstrap_means(np.sort([10.0 + k / 7 for k in range(6)]), 10.0 + 15 / 42, 6, 40, np.random.default_rng([5, 0, 1]))
    assert np.allclose(known[1].length_diff, np.quantile(drawn, compare.SHARES), atol=1e-12)


def test_tracking_finds_the_zdiscs_of_a_frame_once(spark, tmp_path):
    def found(batches):
        for batch in batches:
            (tmp_path / uuid.uuid4().hex).touch()
            yield batch

    rows = zdiscs(spark, SEGMENTED).coalesce(1)
    tracks = track.track_zdiscs(rows.mapInArrow(found, rows.schema))
    assert sorted((r.particle, r.frame) for r in tracks.collect()) == [(-1, 0), (-1, 1), (-1, 2), (1, 0), (1, 1), (1, 2)]
    assert len(list(tmp_path.iterdir())) == 1


def test_summaries_are_those_of_each_line():
    rnd = np.random.default_rng(4)
    lines = [rnd.integers(0, 6, (n, 2)).astype(float) for n in (1, 2, 3, 3, 9, 130, 9, 130, 128)]
    assert images.summaries(lines).tolist() == [list(images.summary(c)) for c in lines if len(c) >= 3]
    assert images.summaries([]).shape == (0, 6)
