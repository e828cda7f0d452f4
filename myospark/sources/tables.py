"""Reading and writing of frame stacks, tables of every stage, and metrics."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from . import npy

#: The stage to run for each table.
STAGES = {
    "frames": "read_frames_npy", "filtered": "filter_frames", "contours": "detect_contours", "zdiscs": "segment_zdiscs", "tracked_zdiscs": "track_zdiscs", "sarcomeres": "detect_sarcomeres", "myofibrils": "myofibrils",
    "sarcomeres_gpr": "smooth_gpr", "deformation": "deformation", "order_param": "order_parameter", "metrics": "movie_metrics", "ts_params": "ts_params", "spatial_edges": "spatial_graph", "spatial_nodes": "spatial_graph",
}


def read_frames_npy(spark: SparkSession, path: str) -> DataFrame:
    """frames of the stored stacks under path, (frames, height, width[, channels]) each; movies are numbered by a hash of
    their path. Stacks that need unpickling are refused. A stack is read by as many tasks as it has parts of 64 MB, and
    frames that a comparison of `frame` leaves out are not read."""
    return npy.scan_npy(spark, path).select(F.xxhash64("path").alias("movie_id"), "frame", "height", "width", "channels", "pixels")


def _read_table(spark: SparkSession, path: str, schema: T.StructType, movie_id: int | None) -> DataFrame:
    if path.rstrip("/").endswith(".csv"):
        own = T.StructType([f for f in schema.fields if f.name != "movie_id" or movie_id is None])
        named = spark.read.csv(path, header=True)
        found = named.select(*(F.col(f.name).cast("double").cast(f.dataType) if isinstance(f.dataType, T.IntegerType | T.LongType) else F.col(f.name).cast(f.dataType) for f in own.fields if f.name in named.columns))
        if movie_id is not None:
            found = found.withColumn("movie_id", F.lit(movie_id).cast("long"))
    else:
        found = spark.read.parquet(path)
    doubles = [f.name for f in found.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return found.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})


def read_zdiscs(spark: SparkSession, path: str, tracked: bool = False, movie_id: int | None = None) -> DataFrame:
    """Segmented or tracked z-discs from CSV (an index column without name is dropped) or Parquet; NaN becomes null."""
    return _read_table(spark, path, schemas.TRACKED_ZDISCS if tracked else schemas.ZDISCS, movie_id)


def read_sarcomeres(spark: SparkSession, path: str, smooth: bool = False, movie_id: int | None = None) -> DataFrame:
    return _read_table(spark, path, schemas.SARCOMERES_SMOOTH if smooth else schemas.SARCOMERES, movie_id)


def write_stage(df: DataFrame, path: str, stage: str, csv: bool = False) -> None:
    """df under path/stage, a folder for each movie. The folders of movies that df has none of stay as they are, so movies can be
    added to results one by one; those of its own movies are replaced. A table without movies replaces the whole stage."""
    out = df.write.mode("overwrite")
    out = out.partitionBy("movie_id").option("partitionOverwriteMode", "dynamic") if "movie_id" in df.columns else out
    out.option("header", True).csv(f"{path}/{stage}") if csv else out.parquet(f"{path}/{stage}")


def read_stage(spark: SparkSession, path: str, stage: str) -> DataFrame:
    """What write_stage wrote, or a FileNotFoundError that names the step to run first."""
    try:
        found = spark.read.parquet(f"{path}/{stage}")
        return found.withColumn("movie_id", F.col("movie_id").cast("long")) if "movie_id" in found.columns else found
    except AnalysisException as e:
        raise FileNotFoundError(f"{stage} is missing in {path}: run {STAGES.get(stage, stage)} first") from e


def write_metrics_json(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)
