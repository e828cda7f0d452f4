"""Shards of near equal size by sampled splitters.

Records are ordered by the digest of their text and then by id, so equal texts stay neighbours and no key of a group
is alone.  A sample of keys, drawn with a chance in proportion to the record's size, gives quantile boundaries that cut
the order into ranges of about equal bytes; a range that turns out overfull is cut again at splitters sampled inside
it.  Every range is then ordered on its own, a running sum of the ranges' exact bytes places each record in the whole
order, and the order is cut into shards at equal shares of the bytes: a shard differs from its share by less than one
record.  The sample only decides how even the tasks are, never the result.

Law `bytes`.  A null text has no bytes and counts one; null ids come first; equal texts are neighbours but not one unit, so
a group that lies across an edge is split; repeated rows take neighbouring slots; a very long text is one record and may
make its shard larger than the share; an empty table gives an empty result.  Extra columns, whatever their names, are left
out of the assignment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialize

#: Keys that a sample holds on average, and shares of the mean size from which a range is overfull.
SAMPLE, OVERFULL, ROUNDS = 16_384, 2.0, 3
LEAST_ID = -(1 << 63)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, and the key (k1, k2) of every record, all without shuffling the texts."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    found = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("md5"))
    k1 = F.conv(F.substring("md5", 1, 15), 16, 10).cast("long")
    return found.select("doc_id", "size", "text_crc32", k1.alias("k1"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("k2"))


def draw(records: DataFrame, per_byte: float, seed: int) -> list[tuple[int, int]]:
    """Distinct keys, each record drawn with the chance size * per_byte; the same draw in every attempt of a task."""
    u = (F.xxhash64(F.lit(seed), "k1", "k2").bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)).cast("double")
    return sorted((r.k1, r.k2) for r in records.where(u < F.col("size") * per_byte).select("k1", "k2").distinct().collect())


def quantiles(sample: list[tuple[int, int]], ranges: int) -> list[tuple[int, int]]:
    return sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []


def in_ranges(records: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
    """records with `range`, the number of splitters at or under the key."""
    s1, s2 = np.array([s[0] for s in splitters], np.int64), np.array([s[1] for s in splitters], np.int64)
    names = records.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (np.asarray(batch.column(names.index(c))) for c in ("k1", "k2"))
            low, high = np.searchsorted(s1, k1, "left"), np.searchsorted(s1, k1, "right")
            for key in np.unique(k1[low < high]):  # keys that hold splitters themselves: the ids decide
                rows = k1 == key
                a, b = low[rows][0], high[rows][0]
                low[rows] = a + np.searchsorted(s2[a:b], k2[rows], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low.astype(np.int64))], names=[*names, "range"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in records.schema) + ", range long"
    return records.mapInArrow(run, schema)


def split(records: DataFrame, total: int, ranges: int, seed: int = 7) -> tuple[list[tuple[int, int]], DataFrame]:
    """(splitters, bytes and rows of each range), overfull ranges subdivided."""
    if not total:
        return [], in_ranges(records, []).groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    splitters, want = quantiles(draw(records, SAMPLE / total, seed), ranges), total / ranges
    for turn in range(ROUNDS + 1):
        placed = in_ranges(records, splitters)
        stats = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
        over = {} if turn == ROUNDS else {r["range"]: r.bytes for r in stats.where(f"bytes > {OVERFULL * want} and n > 1").select("range", "bytes").collect()}
        if not over:
            break
        inside = placed.where(F.col("range").isin(list(over))).drop("range")
        edges = [(LEAST_ID, LEAST_ID), *splitters, (1 << 62, 0)]
        sample = draw(inside, 16 / want, seed + turn + 1)
        for r, size in over.items():
            own = [s for s in sample if edges[r] <= s < edges[r + 1]]
            splitters += quantiles(own, max(2, round(size / want)))
        splitters = sorted(set(splitters))
    return splitters, stats


def assign_shards(docs: DataFrame, shards: int = 16, ranges: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every record. The ranges' sums, a row for each range,
    come to one task to be added up; their number is a parameter and does not grow with the records."""
    spark = docs.sparkSession
    ranges = ranges or max(16 * shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    records = materialize(keyed(docs), "keys")
    total = records.agg(F.sum("size")).first()[0] or 0
    splitters, stats = split(records, total, ranges)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"))
    order = Window.partitionBy("range").orderBy("k1", "k2", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = in_ranges(records, splitters).withColumn("upto", F.sum("size").over(order)).withColumn("nth", F.count(F.lit(1)).over(order))
    middle = F.expr("2 * (bytes_before + upto) - size").cast("decimal(38,0)")
    shard = F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(2 * max(total, 1)).cast("decimal(38,0)"))).cast("int")
    placed = materialize(ordered.join(F.broadcast(stats), "range").withColumn("shard", shard), "placed")
    parts = placed.groupBy("range", "shard").agg(F.min("nth").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("range", "shard", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    slots = placed.join(F.broadcast(parts), ["range", "shard"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("nth") + F.col("shift")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, pieces: int = 8) -> None:
    """Write whole records to path/shard=N, each shard by `pieces` tasks in the order of its slots. Columns of docs named
    shard or slot give way. Equal rows are told apart by the number of the copy, so each is written once."""
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"), F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
    placed = assign_shards(docs, shards).select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("text_crc32").alias("_crc"), "shard", "slot")
    same = ["_id", "_size", "_crc"]
    keyed = whole.withColumn("_size", (F.octet_length("_text") + F.lit(1)).cast("long")).withColumn("_crc", F.crc32("_text")).drop("_text")
    keyed = keyed.withColumn("_copy", F.row_number().over(Window.partitionBy(*same).orderBy(F.hash("_row"))))
    placed = placed.withColumn("_copy", F.row_number().over(Window.partitionBy(*same).orderBy("shard", "slot")))
    met = [F.col(f"k.{c}").eqNullSafe(F.col(f"p.{c}")) for c in (*same, "_copy")]
    full = keyed.alias("k").join(placed.alias("p"), met).select("k._row.*", "p.shard", "p.slot")
    full.repartitionByRange(shards * pieces, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


ORACLE_SQL = """
with t(n) as (select range::uinteger from range(256)),
table_ as (select list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0]::uinteger[], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384::uinteger) else c >> 1 end) order by n) tab from t),
d as (select doc_id, coalesce(text, '') x from documents),
k as (select doc_id, strlen(x) + 1 size, md5(x) m,
  xor(list_reduce(list_prepend(4294967295::uinteger, list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda h: ('0x' || h)::uinteger)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::uinteger)::bigint text_crc32 from d, table_),
o as (select *, sum(size) over (order by substr(m, 1, 15), doc_id) upto, sum(size) over () total from k),
s as (select *, least(15, ((2 * upto - size) * 16) // (2 * total))::int shard from o)
select doc_id, size::bigint size, text_crc32, 'bytes' law, shard, row_number() over (partition by shard order by substr(m, 1, 15), doc_id) - 1 slot, null::int grown_shard from s
"""
