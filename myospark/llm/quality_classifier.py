"""Document quality by supervised subword embeddings.

Every document is the average of learned vectors: one per hashed word, one per hashed character n-gram (three to five
bytes of UTF-8 within a word and its boundaries), and one each for word trigrams that are new in the document and that
come again.  A softmax over two classes scores the average.  Vectors and output are trained together by stochastic
gradient descent in numpy, in one task, on a bounded sample of labelled documents, equally many of each label as far
as there are; the output is then shifted to the labels' true shares.

As the output is linear in the average, a bucket's contribution to the log-odds is one number, so scoring a text adds
one table entry per feature and needs no vectors.  A null or wordless text scores as the labels' share alone.  Null
labels and labels without a document teach nothing; of repeated labels the least counts, of repeated documents one text, so
the sample is bounded whatever repeats.  Repeated rows are scored each, equal texts equally; very long texts are scored
whole; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .batches import SPACE, bounded_batches, mix, prefix_hash, runs, slice_hash, text_chunks

BITS = 16
NEW, AGAIN = 2 << BITS, (2 << BITS) + 1
BUCKETS = AGAIN + 1
GRAMS = (3, 4, 5)
DIM, EPOCHS, RATE, SEED = 8, 6, 0.5, 11
#: Training takes at most so many documents of each label, those with the least hash of their id.
SAMPLE_PER_LABEL = 1500
PRIME = np.uint64(0x9E3779B97F4A7C15)
HIGH = np.uint64(64 - BITS)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row, bucket) of every feature of a run of texts, rows ascending within each pair."""
    starts, ends, row = runs(~SPACE[data], offsets)
    if not len(starts):
        return
    prefix = prefix_hash(data)
    words = slice_hash(prefix, starts, ends)
    yield row, (words >> HIGH).astype(np.int64) + (1 << BITS)
    of_byte = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    blank = np.concatenate([[0], np.cumsum(SPACE[data], dtype=np.int32)])
    for n in GRAMS:
        m = len(data) - n + 1
        if m > 0:
            at = np.flatnonzero((blank[n - 1 : n - 1 + m] == blank[1 : 1 + m]) & (of_byte[:m] == of_byte[n - 1 :]))
            yield of_byte[at], (slice_hash(prefix, at, at + n) >> HIGH).astype(np.int64)
    if len(words) > 2:
        at = np.flatnonzero(row[2:] == row[:-2])
        key = mix((words[at] * PRIME + words[at + 1]) * PRIME + words[at + 2] + row[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        first = np.zeros(len(at), bool)
        first[np.unique(key, return_index=True)[1]] = True
        yield row[at], np.where(first, NEW, AGAIN)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train_on(docs: list[tuple[np.ndarray, np.ndarray, int]], prior: float, seed: int = SEED) -> tuple[np.ndarray, float]:
    """(log-odds of each bucket, offset) from (buckets, counts, label) of each document and the share of label 1."""
    rnd = np.random.default_rng(seed)
    vectors = rnd.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    share = np.mean([y for _, _, y in docs]) if docs else prior
    steps, done = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for i in rnd.permutation(len(docs)):
            at, weight, y = docs[i]
            rate = RATE * (1 - done / steps)
            done += 1
            v = weight @ vectors[at]
            z = out @ v + bias
            p = np.exp(z - z.max())
            error = p / p.sum()
            error[y] -= 1
            # the gradient of a feature is its weight's share; scaled by the root of their number, it neither dies in long texts nor explodes in short ones
            vectors[at] -= (rate * np.sqrt(len(at))) * weight[:, None] * (error @ out)
            out -= rate * np.outer(error, v)
            bias -= 0.1 * rate * error
    odds = lambda q: np.log(np.clip(q, 1e-3, 1 - 1e-3) / (1 - np.clip(q, 1e-3, 1 - 1e-3)))
    return (vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0] + odds(prior) - odds(share))


def model_of(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> tuple[np.ndarray, float, float]:
    """(table, offset, share of label 1), learned from labels that are not held out. The table is one row of fixed size."""
    teach = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    prior = teach.agg(F.avg("quality")).first()[0]
    prior = 0.5 if prior is None else prior
    picked = [teach.where(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for y in (0, 1)]
    sample = docs.select("doc_id", "text").join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").groupBy("doc_id", "quality").agg(F.max("text").alias("text")).select("text", "quality")
    bounded_batches(docs.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, data, offsets in text_chunks(batch.column(0), 1):
                found = [b for _, b in features(data, offsets)]
                at, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64),) * 2
                out.append((at.astype(np.int32).tobytes(), (n / max(1, n.sum())).astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.binary()), pa.array([w for _, w in out], pa.binary()), batch.column(1)], names=["at", "weight", "quality"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.frombuffer(a, np.int32), np.frombuffer(w, np.float32), int(y)) for b in batches for a, w, y in zip(*(c.to_pylist() for c in b.columns), strict=True) if a]
        rows.sort(key=lambda r: (r[2], r[0].tobytes(), r[1].tobytes()))  # the same order however the rows arrive
        table, offset = train_on(rows, prior)
        yield pa.RecordBatch.from_pylist([{"table": table.tobytes(), "offset": offset}], schema=pa.schema([("table", pa.binary()), ("offset", pa.float64())]))

    found = materialize(sample.mapInArrow(extract, "at binary, weight binary, quality int"), "features")
    row = found.coalesce(1).mapInArrow(learn, "table binary, offset double").first()
    table, offset = (np.zeros(BUCKETS, np.float32), float(np.log(prior + 1e-3) - np.log(1 - prior + 1e-3))) if row is None else (np.frombuffer(bytes(row[0]), np.float32), row[1])
    return table, offset, float(prior)


def score_documents(docs: DataFrame, model: tuple[np.ndarray, float, float], threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, offset, prior = shared.value
        for batch in batches:
            scores = []
            for a, b, data, offsets in text_chunks(batch.column(1)):
                total, n = np.zeros(b - a), np.zeros(b - a, np.int64)
                for row, bucket in features(data, offsets):
                    total += np.bincount(row, table[bucket], b - a)
                    n += np.bincount(row, minlength=b - a)
                with np.errstate(over="ignore"):
                    p = 1 / (1 + np.exp(-(total / np.maximum(n, 1) + offset)))
                scores.append(np.where(n > 0, p, prior))
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
