"""Tables that cut lineage, kept where every executor can read them."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def absolute(spark: SparkSession, path: str) -> str:
    """path with the scheme that Spark takes where none is named: that of its default file system."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(found).toString().rstrip("/")


def store(uri: str):
    """(file system, path) of pyarrow for an absolute uri, such as file:/a/b or scheme://host/a/b."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir; a temporary one only on a single machine where none is set."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all hosts share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        named = sc.getCheckpointDir()
    return absolute(spark, named)


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: the new plan starts at the files, so a lost
    executor costs a task and not the whole lineage. The tables stay until release()."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


#: Tables that each application has written and not yet released.
_written: dict[str, list[str]] = {}


def release(spark: SparkSession) -> int:
    """Delete the tables that this application has written; frames that still read them are of no use then."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        delete(spark, p)
    return len(paths)


def delete(spark: SparkSession, uri: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def discard(*frames: DataFrame) -> None:
    """Delete tables that materialize() has written and that nothing reads any more."""
    for frame in frames:
        known = _written.get(frame.sparkSession.sparkContext.applicationId, [])
        if frame.stored_at in known:
            known.remove(frame.stored_at)
            delete(frame.sparkSession, frame.stored_at)


def sweep(spark: SparkSession) -> None:
    """Let the driver collect its garbage, upon which Spark deletes the shuffle files of finished steps that nothing reads any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def workspace(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is written inside goes at the end, all but the frames given to keep: `with workspace(spark) as keep: ... out =
    keep(materialize(...))`. Frames that are not written must not leave it."""
    known = _written.setdefault(spark.sparkContext.applicationId, [])
    before, kept = set(known), set()

    def keep(frame: DataFrame) -> DataFrame:
        kept.add(frame.stored_at)
        return frame

    try:
        yield keep
    finally:
        for path in [p for p in known if p not in before | kept]:
            known.remove(path)
            delete(spark, path)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """df dealt by the columns into as many tasks as a shuffle has, small tables too: for work that weighs far more than its
    rows do, which adaptive execution would gather in one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def unsent(df: DataFrame) -> DataFrame:
    """df as a side of a join that grows with the input: it is shuffled and never sent whole through the driver. Spark would send it by
    the size of its files, of which packed numbers and copies for several places make many times as much."""
    return df.hint("merge")
