"""Token ids in directly addressable files.

Every id is split into chunks of eight bits.  Level 0 holds the lowest chunk of each id, level k the k-th chunk of the
ids that have one; a bitmap beside each level marks the ids that go on to the next, and a rank directory counts the
marks before every block of 512, so the place of an id in the next level is one look-up and one popcount.  Any id of
a file is read without decoding a block of its neighbours.

A file holds consecutive documents in ascending order of doc_id; the files of a table are listed, with the ids before
each, by a manifest that is written only for tasks that succeeded.  Nulls count as empty texts (one end id each);
repeated rows are written each; a null doc_id comes first; an empty table has an empty manifest.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import absolute, materialize, shared_path, store
from .batches import bounded_batches

MAGIC = b"DAC1"
BLOCK = 512
FILE_TOKENS = 4_000_000
MEMO_ENTRIES = 250_000
NULL_ID = -(1 << 63)


# --- the format -----------------------------------------------------------------------------------------------------


def pack(ids: np.ndarray) -> bytes:
    """The levels of ids (unsigned, 32 bits)."""
    out = [struct.pack("<Q", len(ids))]
    rest = ids.astype(np.uint32)
    while True:
        more = rest > 255
        pad = np.zeros(-(-len(rest) // BLOCK) * BLOCK, bool)
        pad[: len(rest)] = more
        counts = pad.reshape(-1, BLOCK).sum(1, dtype=np.uint32)
        directory = np.cumsum(counts, dtype=np.uint32) - counts
        out += [(rest & 255).astype(np.uint8).tobytes(), np.packbits(pad, bitorder="little").tobytes(), directory.tobytes()]
        rest = rest[more] >> 8
        out.append(struct.pack("<Q", len(rest)))
        if not len(rest):
            return b"".join(out)


class Levels:
    """Packed ids: whole by ids(), single ones by index. `read(at, n)` gives n bytes of them from the at-th on."""

    def __init__(self, data: bytes | memoryview | None = None, read=None):
        self.read = read or (lambda at, n: data[at : at + n])
        self.levels, at = [], 8
        (n,) = struct.unpack("<Q", self.read(0, 8))
        self.n = n
        while True:
            blocks = -(-n // BLOCK)
            # where the chunks, the bitmap and the directory of a level of n ids begin
            self.levels.append((n, at, at + n, at + n + blocks * BLOCK // 8))
            at += n + blocks * BLOCK // 8 + 4 * blocks
            (n,) = struct.unpack("<Q", self.read(at, 8))
            at += 8
            if not n:
                return

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """One id: of every level that it has, a chunk, a block of the bitmap up to its mark and a count of the directory."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        found = 0
        for k, (_, chunks, bits, directory) in enumerate(self.levels):
            found |= self.read(chunks + i, 1)[0] << (8 * k)
            block, first = i // BLOCK, i // BLOCK * (BLOCK // 8)
            marks = bytes(self.read(bits + first, (i >> 3) - first + 1))
            if not marks[-1] >> (i & 7) & 1:
                return found
            (before,) = struct.unpack("<I", self.read(directory + 4 * block, 4))
            i = before + int.from_bytes(marks[:-1], "little").bit_count() + (marks[-1] & ((1 << (i & 7)) - 1)).bit_count()
        return found

    def ids(self) -> np.ndarray:
        found = None
        for n, chunks, bits, _ in reversed(self.levels):
            here = np.frombuffer(self.read(chunks, n), np.uint8).astype(np.uint32)
            if found is not None:
                marks = np.frombuffer(self.read(bits, -(-n // 8)), np.uint8)
                here[np.unpackbits(marks, count=n, bitorder="little").view(bool)] |= found << 8
            found = here
        return found


def file_bytes(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    keys = np.array([NULL_ID if d is None else d for d in doc_ids], np.int64)
    return MAGIC + struct.pack("<Q", len(keys)) + keys.tobytes() + np.array(counts, np.int64).tobytes() + pack(ids)


def parse_file(data: bytes) -> tuple[list[int | None], np.ndarray, Levels]:
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    (n,) = struct.unpack_from("<Q", data, 4)
    keys = np.frombuffer(data, np.int64, n, 12)
    return [None if k == NULL_ID else int(k) for k in keys], np.frombuffer(data, np.int64, n, 12 + 8 * n), Levels(memoryview(data)[12 + 16 * n :])


def levels_at(f) -> Levels:
    """The levels of an open token file, of which only the bytes asked for are read."""

    def read(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    head = read(0, 12)
    if head[:4] != MAGIC:
        raise ValueError("not a token file")
    first = 12 + 16 * struct.unpack("<Q", head[4:])[0]
    return Levels(read=lambda at, n: read(first + at, n))


def read_bytes(uri: str) -> bytes:
    where, path = store(uri)
    with where.open_input_file(path) as f:
        return f.read()


def write_bytes(uri: str, data: bytes) -> None:
    where, path = store(uri)
    with where.open_output_stream(path) as f:
        f.write(data)


# --- encoding -------------------------------------------------------------------------------------------------------


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Words(dict):
    """Ids, as bytes, of a word after a blank, or of one that begins a line with the line end before it. Two generations:
    what has not been asked for since the last change of generations goes, so the size stays under twice `most`."""

    def __init__(self, encode, most: int = MEMO_ENTRIES):
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.encode(word)
        self[word] = found
        return found

    def turn(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class ByteLevelEncoder:
    """Ids of whole texts by the tokenizers library, equal parts encoded once.

    In a byte-level vocabulary without normaliser no token spans a single blank or line end that follows a character and
    precedes a word, nor a letter and the punctuation after it; so a text is encoded word by word, and each worker keeps a
    bounded memo.  A text with such blanks side by side or at its end, and any other vocabulary, goes whole.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(model)
        with open(model, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.parts = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.irregular = re.compile(r"[ \n]\s|[ \n]\Z").search
        self.word = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?*%$#&|]*)").fullmatch
        self.letters = byte_letters()
        self.words, self.marks = Words(self.part), Words(self.piece)
        self.line_end = self.whole(["\n"])[0]

    def whole(self, texts: list[str]) -> list[bytes]:
        call = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        return [np.array(e.ids, "<u4").tobytes() for e in call(texts, add_special_tokens=False)] if texts else []

    def piece(self, part: str) -> bytes:
        """Ids of what the library's pattern takes as one piece: letters after at most one blank, or marks."""
        tokens = self.library.model.tokenize(part.encode().decode("latin-1").translate(self.letters))
        return array("I", [t.id for t in tokens]).tobytes()

    def part(self, word: str) -> bytes:
        if word[:1] == "\n":
            return self.line_end + self.first(word[1:])
        if m := self.word(" " + word):
            stem, marks = m.groups()
            return self.words[stem[1:]] + self.marks[marks] if marks else self.piece(stem)
        return self.whole([" " + word])[0]

    def first(self, word: str) -> bytes:
        """Ids of a word with nothing before it."""
        if m := self.word(word):
            stem, marks = m.groups()
            return self.piece(stem) + self.marks[marks] if marks else self.piece(stem)
        return self.whole([word])[0] if word else b""

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, out = self.words.__getitem__, []
        for text in texts:
            if not self.parts or self.irregular(text) or any(s in text for s in self.special):
                out += self.whole([text])
            else:
                words = text.replace("\n", " \n").split(" ")
                out.append(self.first(words[0]) + b"".join(map(ids, words[1:])))
        self.words.turn()
        self.marks.turn()
        return out


@lru_cache(maxsize=2)
def encoder(model: str) -> ByteLevelEncoder:
    return ByteLevelEncoder(model)


# --- the jobs -------------------------------------------------------------------------------------------------------


def write_token_files(docs: DataFrame, model: str, out_dir: str, end_id: int = 0, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, append end_id, write files in ascending order of id_col.

    Returns the manifest, in the order of the documents: path, n_docs, n_tokens, start (ids of the files before).
    out_dir must be reachable from all nodes.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = np.array([end_id], "<u4").tobytes()
    out_dir = absolute(spark, out_dir)
    where, path = store(out_dir)
    where.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(model).encode
        part, seq = TaskContext.get().partitionId(), 0
        keys, counts, data = [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal seq, keys, counts, data
            ids = np.frombuffer(b"".join(data), "<u4")
            target = f"{out_dir}/part-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.dac"
            write_bytes(target, file_bytes(keys, counts, ids))
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": target, "n_docs": len(keys), "n_tokens": len(ids)}], schema=pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))
            seq, keys, counts, data = seq + 1, [], [], []
            return row

        for batch in batches:
            found = encode([t or "" for t in batch.column(1).to_pylist()])
            for key, ids in zip(batch.column(0).to_pylist(), found, strict=True):
                keys.append(key)
                counts.append(len(ids) // 4 + 1)
                data += [ids, end]
            if sum(counts) >= FILE_TOKENS:
                yield flush()
        if keys:
            yield flush()

    ranged = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("t")).repartitionByRange(n, "id").sortWithinPartitions("id", "t")
    files = materialize(ranged.mapInArrow(run, "part long, seq long, path string, n_docs long, n_tokens long"), "token-files")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return files.select("path", "n_docs", "n_tokens", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))


def read_token_files(manifest: DataFrame, ids_col: bool = False) -> DataFrame:
    """A row per document: doc_id, start, n_tokens, ids_crc32, and with ids_col the ids."""
    spark = manifest.sparkSession
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids_col

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, counts, levels = parse_file(read_bytes(uri))
                ids = levels.ids().astype("<u4", copy=False)
                ends = np.cumsum(counts)
                starts = ends - counts
                view = memoryview(ids).cast("B")
                crcs = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                for k in range(0, len(keys), 10_000):
                    part = slice(k, k + 10_000)
                    columns = [pa.array(keys[part], pa.int64()), pa.array(starts[part] + start), pa.array(counts[part]), pa.array(crcs[part], pa.int64())]
                    if ids_col:
                        columns.append(pa.array([ids[a:b].astype(np.int64) for a, b in zip(starts[part], ends[part], strict=True)], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "start").repartition(n).mapInArrow(run, schema)


def tokens_at(manifest: DataFrame, positions: DataFrame, span: int = FILE_TOKENS) -> DataFrame:
    """position and id for every row of positions(position long): each file that is asked is opened once a task and
    the few bytes of an id are read by rank: the rest is neither read nor decoded. Positions outside the table have no row."""
    files = manifest.where("n_tokens > 0").select("path", "start", "n_tokens", F.explode(F.expr(f"sequence(start div {span}, (start + n_tokens - 1) div {span})")).alias("cell"))
    asked = positions.select(F.col("position").cast("long"), F.expr(f"position div {span}").alias("cell"))
    found = asked.join(files, "cell").where("position >= start and position < start + n_tokens").select("path", F.expr("position - start").alias("at"), "position")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, levels, f = None, None, None
        for batch in batches:
            ids = []
            for uri, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if uri != path:
                    where, name = store(uri)
                    f = where.open_input_file(name)
                    path, levels = uri, levels_at(f)
                ids.append(levels[at])
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(ids, pa.int64())], names=["position", "id"])

    return found.sortWithinPartitions("path").mapInArrow(run, "position long, id long")


def token_table(docs: DataFrame, model: str, end_id: int = 0) -> DataFrame:
    """Write the files of docs into the shared folder and read them back."""
    return read_token_files(write_token_files(docs, model, shared_path(docs.sparkSession, "tokens"), end_id))
