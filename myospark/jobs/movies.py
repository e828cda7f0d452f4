"""Whole jobs: from frames to sarcomeres, and from sarcomeres to all results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import analysis, sarcomeres, segment, series, track
from ..sources.tables import read_stage, write_metrics_json, write_stage
from ..storage import materialize


def movies_to_sarcomeres(frames: DataFrame, sigma: float = 1.0, min_length: int = 8, search_range: float = 4.0, full_track_ratio: float = 0.75, save: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(sarcomeres, myofibrils) of raw frames. With `save` every stage is written there, each from the one before as it was
    written: filtered frames, contours, zdiscs, tracked_zdiscs, sarcomeres, myofibrils. Without it the z-discs of a frame
    come in one pass, and only the tracks are written, as the graph and the measures both read them."""

    def kept(df: DataFrame, stage: str) -> DataFrame:
        write_stage(df, save, stage)
        back = read_stage(df.sparkSession, save, stage)
        return back.select(*(F.col(f.name).cast(f.dataType) for f in df.schema))

    if save:
        contours = kept(segment.detect_contours(kept(segment.filter_frames(frames, sigma), "filtered"), min_length), "contours")
        zdiscs = kept(segment.summarize_contours(contours).drop("contour_id"), "zdiscs")
    else:
        zdiscs = segment.segment_zdiscs(frames, sigma, min_length)
    tracks = track.track_zdiscs(zdiscs, search_range, full_track_ratio)
    tracks = kept(tracks, "tracked_zdiscs") if save else materialize(tracks, "tracks")
    found, fibrils = sarcomeres.detect(tracks)
    return (kept(found, "sarcomeres"), kept(fibrils, "myofibrils")) if save else (found, fibrils)


def run_all(smooth: DataFrame, tracks: DataFrame, adjust_reference: bool = False, save: str | None = None) -> dict[str, DataFrame]:
    """Deformation, order, metrics, series parameters and the spatial graph of smoothed sarcomeres and their tracks."""
    smooth = materialize(smooth, "smooth")
    deformed, order = analysis.deformation(smooth, adjust_reference), analysis.order_parameter(smooth)
    edges, nodes = analysis.spatial_graph(tracks)
    out = {"deformation": deformed, "order_param": order, "metrics": analysis.movie_metrics(smooth, deformed, order), "ts_params": series.ts_params(smooth), "spatial_edges": edges, "spatial_nodes": nodes}
    if save:
        for stage, df in out.items():
            write_stage(df, save, stage)
        write_metrics_json(read_stage(smooth.sparkSession, save, "metrics"), f"{save}/metrics_json")
    return out
