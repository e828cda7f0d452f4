"""Neighbour graphs of z-discs: nearest neighbours, scores, pruning, components.

`key` names the columns that tell one graph from another: ["movie_id"] for mean places, ["movie_id", "frame"] for a
graph of every frame.  Nodes are (key, particle, x, y), edges (key, u, v) with u < v.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialize
from . import components


#: Bits of a coordinate in the order of places; neighbours in that order that bound a node's reach, beside twice k.
BITS, AROUND = 31, 2
#: Nodes of a graph that one task holds whole; rows that are worked on at once, and cells of a table of distances.
LOCAL, ROWS, CELLS = 4096, 1 << 16, 1 << 20


def _nearest(pairs: DataFrame, key: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*key, "n").orderBy("d2", "m")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _spaced(v: Column) -> Column:
    """The bits of v with a gap after each."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def with_reach(nodes: DataFrame, key: list[str], k: int) -> DataFrame:
    """(key, particle, x, y, reach) with a distance within which a node has k others; null where it is not known, which is
    so for graphs of at most k nodes and at most 2 k nodes of any other.

    Nodes are dealt by ranges of a curve that halves the graph's box again and again along x and y in turn, as a k-d tree does, so
    a task has about as many nodes as any other, however clumped or large a graph is. Nodes next to each other on the curve
    are mostly near; the k-th distance to those around a node is its reach."""
    wide = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    boxes = nodes.groupBy(*key).agg(F.min("x").alias("_x"), F.min("y").alias("_y"), wide.alias("_wide"))
    at = lambda c: F.least(F.floor(F.when(F.col("_wide") > 0, (F.col(c) - F.col(f"_{c}")) / F.col("_wide")).otherwise(0.0) * 2.0**BITS), F.lit(2**BITS - 1)).cast("long")
    curve = F.shiftleft(_spaced(at("x")), 1).bitwiseOR(_spaced(at("y")))
    placed = nodes.join(boxes, key).select(*key, "particle", "x", "y", curve.alias("_curve"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.drop("_curve").schema) + ", reach double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        if not len(table):
            return
        x, y = (table[c].to_numpy() for c in ("x", "y"))
        other = np.zeros(len(x), bool)
        for c in key:
            v = table[c].to_numpy()
            other[1:] |= v[1:] != v[:-1]
        graph, reach, wide = np.cumsum(other), np.empty(len(x)), 2 * k + AROUND
        for at in range(0, len(x), ROWS):
            first, last = max(0, at - wide), min(len(x), at + ROWS + wide)
            px, py, own = x[first:last], y[first:last], graph[first:last]
            far = np.full((last - first, 2 * wide), np.inf)
            for step in range(1, min(wide, len(px) - 1) + 1):
                d2 = np.where(own[step:] == own[:-step], (px[step:] - px[:-step]) ** 2 + (py[step:] - py[:-step]) ** 2, np.inf)
                far[step:, 2 * step - 2], far[:-step, 2 * step - 1] = d2, d2
            reach[at : at + ROWS] = np.sqrt(np.partition(far, k - 1, axis=1)[:, k - 1])[at - first : at - first + ROWS]
        out = table.drop(["_curve"]).append_column("reach", pa.array(reach, mask=~np.isfinite(reach)))
        yield from out.to_batches()

    ranges = placed.repartitionByRange(*key, "_curve").sortWithinPartitions(*key, "_curve")
    return ranges.mapInArrow(run, schema)


def graph_pairs(x: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, d2, rank) of the k nearest others of every node of one graph, whose nodes are in the order of their ids."""
    found, n = [], len(x)
    for s in range(0, n, max(1, CELLS // n)):
        e = min(n, s + max(1, CELLS // n))
        d2 = (x[s:e, None] - x) ** 2 + (y[s:e, None] - y) ** 2
        same = ids[s:e, None] == ids
        d2[same] = np.inf
        near = (d2 <= np.partition(d2, min(k, n) - 1, axis=1)[:, min(k, n) - 1, None]) & ~same
        i, j = np.nonzero(near)
        d2 = d2[i, j]
        order = np.lexsort((d2, i))
        i, j, d2 = i[order], j[order], d2[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i) + 1
        keep = rank <= k
        found.append((i[keep] + s, j[keep], d2[keep], rank[keep]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _near_in_tasks(placed: DataFrame, key: list[str], k: int) -> DataFrame:
    """(key, n, m, d2, rank, x, y, mx, my, sole) for graphs that a task holds whole, many of them in each; sole marks one of the
    two rows of nodes that are among the nearest of each other."""
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in key] + [f"n {kinds['particle']}", f"m {kinds['particle']}", "d2 double, rank int, x double, y double, mx double, my double, sole boolean"])

    def solve(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, y, ids = (table[c].to_numpy() for c in ("x", "y", "particle"))
        found = []
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if e - s > 1:
                i, j, d2, rank = graph_pairs(x[s:e], y[s:e], ids[s:e], k)
                pair, back = i * (e - s) + j, j * (e - s) + i
                found.append((i + s, j + s, d2, rank, (i < j) | ~np.isin(pair, back)))
        if found:
            i, j, d2, rank, sole = (np.concatenate(c) for c in zip(*found, strict=True))
            n, m = table.take(pa.array(i)), table.take(pa.array(j))
            columns = [*(n[c] for c in key), n["particle"], m["particle"], pa.array(d2), pa.array(rank.astype(np.int32)), n["x"], n["y"], m["x"], m["y"], pa.array(sole)]
            yield from pa.table(columns, names=[*key, "n", "m", "d2", "rank", "x", "y", "mx", "my", "sole"]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= ROWS:
                table = pa.Table.from_batches(held)
                starts = _starts(table, key)
                yield from solve(table.slice(0, starts[-1]), starts)  # the last graph may go on
                held, rows = table.slice(starts[-1]).to_batches(), rows - int(starts[-1])
        if rows:
            table = pa.Table.from_batches(held)
            yield from solve(table, np.append(_starts(table, key), rows))

    return placed.repartition(*key).sortWithinPartitions(*key, "particle").mapInArrow(run, schema)


def _starts(table: pa.Table, key: list[str]) -> np.ndarray:
    """The first rows of the graphs of a table in the order of key."""
    other = np.zeros(len(table), bool)
    for c in key:
        v = table[c].to_numpy()
        other[1:] |= v[1:] != v[:-1]
    other[:1] = True
    return np.flatnonzero(other)


def _near_by_joins(placed: DataFrame, key: list[str], k: int) -> DataFrame:
    """(key, n, m, d2, rank, x, y, mx, my) for graphs of any size: every node meets all nodes within its reach, in squares as wide
    as the reach rounded up to a power of two, of which there are four to nine, so dense and thin places of a graph have squares
    of their own; where the reach is not known, the node meets its whole graph."""
    reached = materialize(with_reach(placed, key, k), "reach")
    level = F.ceil(F.log2(F.greatest(F.col("reach"), F.lit(1e-9)))).cast("int")
    asks = reached.where("reach is not null").withColumn("level", level).withColumn("width", F.pow(F.lit(2.0), F.col("level")))
    levels = asks.select(*key, "level", "width").distinct()
    more = F.col("reach") * (1 + 1e-9) + 1e-12
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - more) / F.col("width")), F.floor((F.col(c) + more) / F.col("width"))))
    seek = asks.withColumn("cx", span("x")).withColumn("cy", span("y")).withColumnRenamed("particle", "n")
    there = reached.drop("reach").join(levels, key).select(*key, "level", F.col("particle").alias("m"), F.col("x").alias("mx"), F.col("y").alias("my"), F.floor(F.col("x") / F.col("width")).alias("cx"), F.floor(F.col("y") / F.col("width")).alias("cy"))
    d2 = (F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2
    out = [*key, "n", "m", "d2", "x", "y", "mx", "my"]
    close = seek.join(there, [*key, "level", "cx", "cy"]).where("n <> m").withColumn("d2", d2).where(F.col("d2") <= more**2).select(out)
    every = reached.select(*key, F.col("particle").alias("m"), F.col("x").alias("mx"), F.col("y").alias("my"))
    lone = reached.where("reach is null").withColumnRenamed("particle", "n").join(every, key).where("n <> m").withColumn("d2", d2).select(out)
    return _nearest(close.unionByName(lone), key, k)


def _near(nodes: DataFrame, key: list[str], k: int) -> tuple[DataFrame, DataFrame | None]:
    """The nearest of the nodes of graphs of at most LOCAL nodes, and those of the larger graphs if there are any."""
    known = " and ".join(f"`{c}` is not null" for c in key)
    placed = nodes.select(*key, "particle", "x", "y").where(f"{known} and x is not null and y is not null and not isnan(x) and not isnan(y)")
    large = materialize(placed.groupBy(*key).count().where(F.col("count") > LOCAL).select(key), "large-graphs")
    if large.isEmpty():
        return _near_in_tasks(placed, key, k), None
    return _near_in_tasks(placed.join(large, key, "left_anti"), key, k), _near_by_joins(placed.join(large, key, "left_semi"), key, k)


def nearest(nodes: DataFrame, key: list[str], k: int) -> DataFrame:
    """(key, n, m, d2, rank) of the k nearest others of every node; equal distances go by id.

    Exact. Graphs of at most LOCAL nodes are whole in a task, larger ones are solved by joins."""
    near, far = _near(nodes, key, k)
    out = [*key, "n", "m", "d2", "rank"]
    return near.select(out) if far is None else near.select(out).unionByName(far.select(out))


def placed_edges(nodes: DataFrame, key: list[str], k: int) -> DataFrame:
    """(key, u, v, ux, uy, wx, wy) of nodes u < v of which one is among the k nearest of the other, with their places. Where no graph
    is large, the edges of a graph lie in one task, so that what follows needs no other shuffle."""
    up = F.col("n") < F.col("m")
    side = lambda a, b, name: F.when(up, F.col(a)).otherwise(F.col(b)).alias(name)
    ends = [*key, side("n", "m", "u"), side("m", "n", "v"), side("x", "mx", "ux"), side("y", "my", "uy"), side("mx", "x", "wx"), side("my", "y", "wy")]
    near, far = _near(nodes, key, k)
    sole = near.where("sole").select(ends)
    return sole.repartition(*key) if far is None else sole.unionByName(far.select(ends).dropDuplicates([*key, "u", "v"]))


def knn_edges(nodes: DataFrame, key: list[str], k: int = 3) -> DataFrame:
    """(key, u, v) of nodes of which one is among the k nearest of the other; equal distances go by id."""
    return placed_edges(nodes, key, k).select(*key, "u", "v")


def directed(edges: DataFrame, nodes: DataFrame, key: list[str], extra: list[str] | None = None) -> DataFrame:
    """Each edge from both ends: (key, n, m, the vector (vx, vy) from n to m, extra); edges without length are dropped. Edges that
    have the places of their ends, as placed_edges() gives them, do without the nodes."""
    extra = extra or []
    if "wx" in edges.columns:
        full = edges
    else:
        place = nodes.select(*key, F.col("particle").alias("p"), "x", "y")
        u = place.withColumnsRenamed({"p": "u", "x": "ux", "y": "uy"})
        v = place.withColumnsRenamed({"p": "v", "x": "wx", "y": "wy"})
        full = edges.join(u, [*key, "u"]).join(v, [*key, "v"])
    full = full.withColumn("dx", F.col("wx") - F.col("ux")).withColumn("dy", F.col("wy") - F.col("uy")).where("dx <> 0 or dy <> 0")
    ends = F.array(F.struct(F.col("u").alias("n"), F.col("v").alias("m"), F.col("dx").alias("vx"), F.col("dy").alias("vy")), F.struct(F.col("v").alias("n"), F.col("u").alias("m"), (-F.col("dx")).alias("vx"), (-F.col("dy")).alias("vy")))
    return full.select(*key, F.inline(ends), *extra)


def right_angles(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """The angle between two vectors in units of a right angle."""
    cos = (ax * bx + ay * by) / (F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))) / (math.pi / 2)


def straightness(theta: Column) -> Column:
    """How well two edges lie in line, from the angle between them in right angles, 2 if one goes straight on."""
    return F.when(theta >= 1, (1 - theta) ** 2).otherwise(0.0)


def evenness(l1: Column, l2: Column) -> Column:
    """How alike an edge and the next one are in length."""
    return 1 / (1 + F.abs(l2 - l1) / l1)


def closeness(l1: Column, l_avg: Column) -> Column:
    """How near an edge's length is to the usual one."""
    return F.exp(-math.pi * (1 - l1 / l_avg) ** 2)


def score_edges(
    edges: DataFrame, nodes: DataFrame, key: list[str], c_avg_length: float = 1.0, c_angle: float = 1.0, c_length_diff: float = 1.0, l_avg: float = 12.0, l_max: float = 30.0,
    f_angle: Callable[[Column], Column] = straightness, f_length_diff: Callable[[Column, Column], Column] = evenness, f_avg_length: Callable[[Column, Column], Column] = closeness,
) -> DataFrame:
    """(key, u, v, length, score): how likely two z-discs end a sarcomere.

    From each end, an edge no longer than l_max gets the best agreement, in length and in line, with an edge that goes
    on from its other end, and a term for its own length; the better end counts. Longer edges score 0 but still go on.
    The three terms, c times f each, are functions of columns: f_angle of the angle, f_length_diff of the lengths of the edge and
    the next, f_avg_length of the length and l_avg. An agreement below 0 or null counts as 0; a null term of the own length too.
    """
    places = [c for c in ("ux", "uy", "wx", "wy") if c in edges.columns]
    d = directed(edges, nodes, key, places)
    l1 = F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2)
    own = c_avg_length * F.coalesce(f_avg_length(l1, F.lit(float(l_avg))), F.lit(0.0))

    def agree(e: Column, f: Column) -> Column:
        """How well the edge from e to the middle node goes on to f: in line, the vectors to the middle from both sides are opposite."""
        first, second = (F.sqrt(o["vx"] ** 2 + o["vy"] ** 2) for o in (e, f))
        return c_length_diff * f_length_diff(first, second) + c_angle * f_angle(right_angles(e["vx"], e["vy"], f["vx"], f["vy"]))

    best = lambda e: F.array_max(F.transform(F.filter("around", lambda f: f["n"] != e["n"]), lambda f: agree(e, f)))
    around = d.groupBy(*key, "m").agg(F.collect_list(F.struct("n", "vx", "vy", *places)).alias("around"))
    each = around.select(*key, "m", F.explode(F.transform("around", lambda e: F.struct(e.alias("e"), best(e).alias("best")))).alias("o"))
    scored = each.select(*key, "m", "o.e.*", "o.best").withColumn("length", l1)
    score = F.when(l1 <= l_max, F.greatest(F.lit(0.0), F.coalesce("best", F.lit(0.0))) + own).otherwise(0.0)
    return scored.groupBy(*key, F.least("n", "m").alias("u"), F.greatest("n", "m").alias("v")).agg(F.max("length").alias("length"), F.max(score).alias("score"), *(F.first(c).alias(c) for c in places))


def prune_edges(scored: DataFrame, nodes: DataFrame, key: list[str], score_threshold: float = 0.01, angle_threshold: float = 1.2) -> DataFrame:
    """The edges that both ends vote for: a node votes for its best edge, and for the next one that bends from it by more
    than angle_threshold right angles, both only above score_threshold. Equal scores go by the neighbour's id."""
    d = directed(scored, nodes, key, ["score"])
    order = Window.partitionBy(*key, "n").orderBy(F.desc("score"), "m")
    ranked = d.withColumn("rank", F.row_number().over(order)).withColumn("bx", F.first("vx").over(order)).withColumn("by", F.first("vy").over(order))
    bends = (F.col("rank") > 1) & (right_angles(F.col("vx"), F.col("vy"), F.col("bx"), F.col("by")) > angle_threshold)
    able = ranked.where(F.col("score") > score_threshold).withColumn("bends", bends)
    second = F.min(F.when(F.col("bends"), F.col("rank"))).over(Window.partitionBy(*key, "n"))
    votes = able.withColumn("second", second).where("rank = 1 or rank = second")
    kept = votes.groupBy(*key, F.least("n", "m").alias("u"), F.greatest("n", "m").alias("v")).agg(F.count(F.lit(1)).alias("votes"), F.max("score").alias("score"))
    return kept.where("votes = 2").drop("votes")


def detect_edges(nodes: DataFrame, key: list[str], k: int = 3, score_threshold: float = 0.01, angle_threshold: float = 1.2, **weights: float | Callable) -> DataFrame:
    """The pruned edges of nodes. Edges carry the places of their ends, so no step joins them with the nodes again."""
    return prune_edges(score_edges(placed_edges(nodes, key, k), nodes, key, **weights), nodes, key, score_threshold, angle_threshold)


def myofibrils(nodes: DataFrame, edges: DataFrame, key: list[str], huge: bool = False) -> DataFrame:
    """(key, particle, component_id): the component's least particle; nodes without edges are components of their own.
    A graph is one task's work, but with `huge` the graphs of any size are solved by rounds of joins."""
    if huge:
        node = lambda p: F.struct(*key, F.col(p).alias("p"))
        found = components.connected_components(edges.select(node("u").alias("a"), node("v").alias("b")))
        roots = found.select(*(F.col(f"node.{c}").alias(c) for c in key), F.col("node.p").alias("particle"), F.col("root.p").alias("component_id"))
    else:
        roots = components.components_by_key(edges, key, "u", "v").withColumnsRenamed({"node": "particle", "root": "component_id"})
    return nodes.select(*key, "particle").join(roots, [*key, "particle"], "left").withColumn("component_id", F.coalesce("component_id", "particle"))
