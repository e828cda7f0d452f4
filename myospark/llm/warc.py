"""WARC archives as a PySpark data source named `warc`.

Writing: each task rolls files of gzip members, one record a member; the member's `sl` extra field holds its packed
and unpacked length.  Every commit lists the files of the attempts that succeeded in a _FILES-*.json of its own; readers follow
all lists, so appending adds to an archive, and overwriting deletes the lists and files that were there before.
Reading: the driver packs files into partitions of about equal bytes; filters on record_type, page_id, target_uri,
payload_digest and refers_to are pushed down; a task unpacks the head of a record only, tests it, and goes on to
the payload if the record is wanted and the schema asks for it; else it seeks to the next member.

A null payload is written as an empty one, a null url without its header; line ends in urls are percent-encoded;
repeated rows are written each; an empty table gives an archive without records; a very long payload is one record and
must fit a task's memory.  Columns other than page_id, url and html are left out.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from ..storage import absolute, shared_path, store

SCHEMA = "record_type string, page_id long, target_uri string, payload_digest string, payload_bytes long, refers_to long, payload binary"
HEAD = 4096
FILE_BYTES = 64 << 20
PARTITION_BYTES = 128 << 20
PUSHED = ("record_type", "page_id", "target_uri", "payload_digest", "refers_to")
#: Payloads from so many bytes on are stored once.
LEAST_REVISIT = 1000
#: Places over which the rows of a payload are dealt.
SALTS = 32
RECORDS = uuid.uuid5(uuid.NAMESPACE_URL, "warc-page-records")


def lists(where, path: str) -> list[str]:
    """The lists of files of an archive."""
    from pyarrow import fs

    found = where.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.startswith("_FILES-") and f.base_name.endswith(".json"))


def listed(where, path: str) -> list[tuple[str, int]]:
    files = []
    for name in lists(where, path):
        with where.open_input_file(name) as f:
            files += [(n, size) for n, size in json.loads(f.read())]
    return sorted(files)


def record(row: dict) -> bytes:
    """One record: WARC header, then an HTTP head with the full payload's length, then the payload of a response."""
    payload = row.get("payload") or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(RECORDS, str(row['page_id']))}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if row.get("target_uri") is not None:
        fields.append(("WARC-Target-URI", row["target_uri"].replace("\r", "%0D").replace("\n", "%0A")))
    fields.append(("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"))
    if row["page_id"] is not None:
        fields.append(("Page-ID", row["page_id"]))
    if row.get("refers_to") is not None:
        fields += [("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(RECORDS, str(row['refers_to']))}>"), ("Refers-To-Page-ID", row["refers_to"]), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(http) + len(payload))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + http + payload + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member whose `sl` field tells how long it is."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    extra = b"sl" + struct.pack("<HII", 8, 12 + 12 + len(body) + 8, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def header_of(head: bytes) -> tuple[dict[str, str], int]:
    """The fields of a WARC header, and where its block begins."""
    end = head.index(b"\r\n\r\n") + 4
    lines = head[:end].decode().split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines if x)}, end


def parsed(fields: dict[str, str]) -> dict:
    number = lambda k: int(fields[k]) if k in fields else None
    return {"record_type": fields.get("warc-type"), "page_id": number("page-id"), "target_uri": fields.get("warc-target-uri"), "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, "refers_to": number("refers-to-page-id")}


def read_records(f, want: dict[str, set], payload: bool) -> Iterator[dict]:
    """Records of an open archive that pass `want`. Payloads of others, and without `payload` all, stay packed."""
    while fixed := f.read(12):
        (extra,) = struct.unpack("<H", fixed[10:12])
        field = f.read(extra)
        if fixed[:4] != b"\x1f\x8b\x08\x04" or field[:2] != b"sl":
            raise ValueError("a member without its length")
        size, _ = struct.unpack("<II", field[4:12])
        rest = size - 12 - extra
        unpack, packed, head = zlib.decompressobj(-15), f.read(min(rest, HEAD)), b""
        left = rest - len(packed)
        head = unpack.decompress(packed, HEAD)
        while head.count(b"\r\n\r\n") < 2 and not unpack.eof:  # a header longer than usual
            more = unpack.unconsumed_tail or f.read(min(left, HEAD))
            left -= 0 if unpack.unconsumed_tail else len(more)
            if not more:
                raise ValueError("a truncated member")
            head += unpack.decompress(more, HEAD)
        fields, at = header_of(head)
        row = parsed(fields)
        if any(row[k] not in v for k, v in want.items()):
            f.seek(left, 1)
            continue
        block = head[at:]
        http_end = block.index(b"\r\n\r\n") + 4
        row["payload_bytes"] = next((int(x[15:]) for x in block[:http_end].split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
        if payload and row["record_type"] == "response":
            block += unpack.decompress(unpack.unconsumed_tail + f.read(left))
            row["payload"] = block[http_end : int(fields["content-length"])]
        else:
            f.seek(left, 1)
        yield row


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.path, self.want = schema, options["path"].rstrip("/"), {}
        self.most = int(options.get("partitionbytes", 0))

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) else None
            if name in PUSHED:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.want[name] = self.want.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[Files]:
        where, path = store(self.path)
        files = listed(where, path)
        # as many partitions as a small cluster keeps busy, of at most PARTITION_BYTES
        most = self.most or min(PARTITION_BYTES, max(1 << 20, sum(n for _, n in files) // 48))
        groups, size = [[]], 0
        for name, n in files:
            if groups[-1] and size + n > most:
                groups.append([])
                size = 0
            groups[-1].append(f"{path}/{name}")
            size += n
        return [Files(g) for g in groups]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        payload, rows, size = "payload" in schema.names, [], 0
        where, _ = store(self.path)
        for path in partition.paths:
            with where.open_input_file(path) as f:
                for row in read_records(f, self.want, payload):
                    rows.append({k: row.get(k) for k in schema.names})
                    size += len(row.get("payload") or b"") + 256
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool = False):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, path = store(self.path)
        where.create_dir(path, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, size = where.open_output_stream(f"{path}/{name}", compression=None), 0
                data = member(record(row))
                out.write(data)
                size += len(data)
                if size >= FILE_BYTES:
                    out.close()
                    files.append((name, size))
                    out = None
        if out is not None:
            out.close()
            files.append((name, size))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        where, path = store(self.path)
        where.create_dir(path, recursive=True)
        old, gone = (lists(where, path), listed(where, path)) if self.overwrite else ([], [])
        with where.open_output_stream(f"{path}/_FILES-{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps(sorted(x for m in messages if m for x in m.files)).encode())
        for name in [*old, *(f"{path}/{n}" for n, _ in gone)]:
            where.delete_file(name)

    def abort(self, messages: list[Written | None]) -> None:
        where, path = store(self.path)
        for name, _ in (x for m in messages if m for x in m.files):
            where.delete_file(f"{path}/{name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known, and allow Python sources to take filters, without which Spark refuses one that does."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """The records of pages(page_id, url, html). Of equal payloads from `least` bytes on, the largest page_id's rows are
    responses and the others revisit them. Only digests are aggregated, and only for payloads that come twice; the rows of
    a payload lie in SALTS places, to each of which its keeper goes, so a hot payload does not meet in one place."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    keyed = pages.select("page_id", F.col("url").alias("target_uri"), payload.alias("payload"), F.sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    groups = keyed.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = groups.select(F.col("payload_digest").alias("key"), "keeper", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # what is short has no keeper and lies under a key of its own
    key = F.when(F.col("payload_bytes") >= least, F.col("payload_digest")).otherwise(F.concat(F.lit("#"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    joined = keyed.withColumn("key", key).withColumn("salt", F.pmod(F.xxhash64("page_id", "target_uri"), F.lit(SALTS)).cast("int")).join(groups, ["key", "salt"], "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("keeper")) & F.col("keeper").isNotNull(), F.lit(False))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), "page_id", "target_uri", "payload_digest", "payload_bytes",
        F.when(revisit, F.col("keeper")).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_archive(pages: DataFrame, path: str, mode: str = "append") -> None:
    register(pages.sparkSession)
    with_revisits(pages).write.format("warc").mode(mode).save(absolute(pages.sparkSession, path))


def read_archive(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """Records of an archive; leave `payload` out of the schema to leave the payloads packed."""
    register(spark)
    return spark.read.format("warc").schema(schema).load(absolute(spark, path))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to the shared folder and read them back: sizes and digests of responses are those of the payload read."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archive(pages, path)
    records = read_archive(spark, path)
    own = F.col("record_type") == "response"
    return records.select(
        "page_id", F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(own, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to",
    )


ORACLE_SQL = """
with p as (select page_id, strlen(coalesce(html, ''))::bigint n, sha1(coalesce(html, '')) d from pages),
k as (select d, max(page_id) keeper from p where n >= 1000 group by d)
select page_id, n payload_bytes, p.d payload_digest, case when keeper <> page_id then 'revisit' else 'response' end record_type,
  case when keeper <> page_id then keeper end refers_to
from p left join k on k.d = p.d and n >= 1000
"""
