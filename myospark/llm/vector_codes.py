"""Product codes of vectors in exact integers.

Every component x becomes floor(256 x); a vector is cut into equal consecutive parts, and each part position has a
codebook of its own.  A round builds a kd-tree of each codebook, sends the trees to the tasks, finds every part's nearest
entry by branch and bound, and replaces each entry by the floor of the mean of its parts.  What a task sends on are the
counts and the sums of its entries, so a round shuffles parts x entries rows a task and the driver gets parts x entries.

A node is searched unless its box lies further off than the best entry, or as far off without an entry of a lower number,
so of equally near entries the one of the lowest number wins.

Rows go whose vector is null, empty, of another length than that of the least vec_id (or one that the number of parts does
not divide), or holds a null, a NaN, an infinity or a component so large that a distance would not fit 64 bits (with 64
components 524,288 and beyond). A null vec_id is coded but never the start of an entry; a repeated vec_id starts one entry,
with the least of its vectors; with fewer ids than entries there are fewer entries. Null labels count as one label. Extra
columns are ignored. A table without a vector gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LEAF = 4
#: Places of a stack: halving at most 256 entries leaves fewer nodes open.
DEPTH = 16
#: Vectors searched at once in a task; places over which the rows of a label are dealt.
STEP, SALTS = 2048, 16
FAR = np.iinfo(np.int64).max


@dataclass
class Forest:
    """The kd-trees of all codebooks in one set of arrays. A leaf's entries stand in rising order, -1 where it has fewer."""

    roots: np.ndarray  # by part
    low: np.ndarray  # least corner of a node's box
    high: np.ndarray
    children: np.ndarray  # two a node, -1 at a leaf
    first: np.ndarray  # lowest number of an entry below
    entries: np.ndarray  # of a leaf
    books: np.ndarray  # part, entry, position


def plant(books: np.ndarray) -> Forest:
    """A kd-tree for each codebook: nodes are halved at the median of their widest dimension down to LEAF entries."""
    low, high, children, first, leaves, roots = [], [], [], [], [], []

    def grow(book: np.ndarray, own: np.ndarray) -> int:
        at = len(low)
        points = book[own]
        low.append(points.min(0))
        high.append(points.max(0))
        first.append(own.min())
        children.append((-1, -1))
        leaves.append(np.sort(own))
        wide = high[at] - low[at]
        if len(own) > LEAF and wide.any():
            order = own[np.argsort(points[:, wide.argmax()], kind="stable")]
            half = len(order) // 2
            children[at] = (grow(book, order[:half]), grow(book, order[half:]))
            leaves[at] = own[:0]
        return at

    for book in books:
        roots.append(grow(book, np.arange(len(book))))
    entries = np.full((len(low), max(map(len, leaves))), -1, np.int64)
    for k, own in enumerate(leaves):
        entries[k, : len(own)] = own
    return Forest(np.array(roots), np.array(low), np.array(high), np.array(children), np.array(first), entries, books)


def outside(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to its box."""
    gap = np.maximum(np.maximum(low - points, points - high), 0)
    return (gap * gap).sum(1)


def nearest(forest: Forest, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest entry of every part of every vector (vector, part, position): all searches go
    down their trees together, each with a stack of its own."""
    n, parts, width = vectors.shape
    points, part = vectors.reshape(-1, width), np.tile(np.arange(parts), n)
    best, entry = np.full(len(points), FAR), np.full(len(points), FAR)
    stack = np.zeros((len(points), DEPTH), np.int32)
    bound = np.zeros((len(points), DEPTH), np.int64)
    stack[:, 0] = forest.roots[part]
    top = np.ones(len(points), np.int64)
    active = np.arange(len(points))
    while len(active):
        top[active] -= 1
        node, off = stack[active, top[active]], bound[active, top[active]]
        go = (off < best[active]) | ((off == best[active]) & (forest.first[node] < entry[active]))
        at, node = active[go], node[go]
        leaf = forest.children[node, 0] < 0
        a, k = at[leaf], node[leaf]
        if len(a):
            own = forest.entries[k]
            gap = forest.books[part[a][:, None], own] - points[a][:, None, :]
            d = np.where(own < 0, FAR, (gap * gap).sum(2))
            here = d.argmin(1)  # the first of equals, which has the lowest number
            d, own = d[np.arange(len(a)), here], own[np.arange(len(a)), here]
            better = (d < best[a]) | ((d == best[a]) & (own < entry[a]))
            best[a[better]], entry[a[better]] = d[better], own[better]
        a, k = at[~leaf], forest.children[node[~leaf]]
        if len(a):
            one, two = (outside(points[a], forest.low[c], forest.high[c]) for c in k.T)
            swap = (one < two) | ((one == two) & (forest.first[k[:, 0]] < forest.first[k[:, 1]]))  # the nearer comes off the stack first
            for side, near in ((0, False), (1, True)):
                c = np.where(swap == near, k[:, 0], k[:, 1])
                stack[a, top[a] + side], bound[a, top[a] + side] = c, np.where(swap == near, one, two)
            top[a] += 2
        active = active[top[active] > 0]
    return entry.reshape(n, parts), best.reshape(n, parts)


def searched(batches: Iterator[pa.RecordBatch], column: int, forest: Forest) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, integer vectors, entries, distances) for runs of at most STEP rows."""
    parts, _, width = forest.books.shape
    for batch in batches:
        for k in range(0, batch.num_rows, STEP):
            rows = batch.slice(k, STEP)
            x = rows.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = np.floor(x * SCALE).astype(np.int64).reshape(-1, parts, width)
            yield (rows, x, *nearest(forest, x))


def usable(vectors: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """(vec_id, embedding, label) of the rows that are coded, and the length of their vectors, 0 if there are none."""
    v = F.col("embedding")
    rows = vectors.select("vec_id", v, "label").where(F.size(v) > 0).where(F.size(v) % parts == 0)

    def within(most: float) -> DataFrame:
        return rows.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(most))))

    least = within(float("inf")).orderBy(F.col("vec_id").asc_nulls_last(), v).select(F.size(v).alias("n")).limit(1).collect()
    if not least:
        return rows.limit(0), 0
    n = least[0].n
    return within(isqrt(2**62 // n) // 2 / SCALE).where(F.size(v) == n), n


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The codebooks (part, entry, position) to begin with: the vectors of the least ids."""
    ids = [r.vec_id for r in rows.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    own = rows.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("embedding").alias("v")).orderBy("vec_id").collect()
    x = np.floor(np.array([r.v for r in own], np.float64) * SCALE).astype(np.int64)
    return x.reshape(len(own), parts, -1).transpose(1, 0, 2)


def updated(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: the floor of the mean of each entry's parts; an entry without parts stays."""
    parts, entries, width = books.shape
    sent = rows.sparkSession.sparkContext.broadcast(plant(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for _, x, entry, _ in searched(batches, 0, sent.value):
            cell = (entry + np.arange(parts) * entries).ravel()
            count += np.bincount(cell, minlength=len(count))
            for k in range(width):  # below 2^53, so exact
                total[:, k] += np.bincount(cell, x[:, :, k].ravel(), len(count)).astype(np.int64)
        used = np.flatnonzero(count)
        columns = [pa.array(used), pa.array(count[used]), *(pa.array(total[used, k]) for k in range(width))]
        yield pa.RecordBatch.from_arrays(columns, names=["cell", "n", *(f"s{k}" for k in range(width))])

    names = ["n", *(f"s{k}" for k in range(width))]
    made = rows.select("embedding").mapInArrow(run, "cell long, " + ", ".join(f"{c} long" for c in names))
    sums = made.groupBy("cell").agg(*(F.sum(c).alias(c) for c in names)).collect()  # a row an entry
    sent.unpersist()
    out = books.copy().reshape(-1, width)
    for r in sums:
        out[r.cell] = [r[f"s{k}"] // r.n for k in range(width)]
    return out.reshape(books.shape)


def assigned(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of every row."""
    parts, entries, _ = books.shape
    if entries > 256:
        raise ValueError("a code has two hex digits a part")
    sent = rows.sparkSession.sparkContext.broadcast(plant(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, _, entry, far in searched(batches, 2, sent.value):
            digits = entry.astype(np.uint8).tobytes().hex()
            codes = [digits[k : k + 2 * parts] for k in range(0, len(digits), 2 * parts)]
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(codes, pa.string()), pa.array(far.sum(1))], names=["vec_id", "label", "code", "error"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select("vec_id", "label").schema)
    return rows.select("vec_id", "label", "embedding").mapInArrow(run, f"{kinds}, code string, error long")


def learn(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (part, entry, position) of usable rows."""
    books = first_books(rows, parts, entries)
    for _ in range(rounds):
        books = updated(rows, books)
    return books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of every usable row."""
    rows, length = usable(vectors, parts)
    if not length or rows.where("vec_id is not null").limit(1).count() == 0:
        return rows.limit(0).select("vec_id", "label", F.lit("").alias("code"), *(F.lit(0).cast("long").alias(c) for c in ("error", "label_error")), F.lit("").alias("codebooks_sha256"))
    books = learn(rows, parts, entries, rounds)
    coded = materialize(assigned(rows, books), "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("own"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("place"))
    salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")
    joined = coded.withColumn("salt", salt).join(sums, F.col("label").eqNullSafe(F.col("own")) & (F.col("salt") == F.col("place")))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for the rows over `embeddings`; all distances are formed there."""
    steps = [f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, label, [CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
part AS MATERIALIZED (
  SELECT vec_id, p, list_slice(v, p * (len(v) // {parts}) + 1, (p + 1) * (len(v) // {parts})) AS x
  FROM kept, range({parts}) t(p)),
book0 AS MATERIALIZED (
  SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS e, x FROM part
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))"""]  # fmt: skip
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (
  SELECT vec_id, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT vec_id, p, e,
      CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(part.x, book.x)]) AS BIGINT) AS d
    FROM part JOIN book{k} book USING (p))
  GROUP BY vec_id, p)""")  # fmt: skip
        if k < rounds:
            steps.append(f"""mean{k} AS (
  SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (
    SELECT p, e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n
    FROM near{k} JOIN part USING (vec_id, p), range(1, (SELECT max(len(x)) FROM part) + 1) r(i)
    GROUP BY p, e, i)
  GROUP BY p, e),
book{k + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(mean.x, book.x) AS x FROM book{k} book LEFT JOIN mean{k} mean USING (p, e))""")  # fmt: skip
    steps.append(f"""coded AS (
  SELECT vec_id, string_agg(lpad(to_hex(e), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM near{rounds} GROUP BY vec_id)
SELECT vec_id, lower(code) AS code, error,
  CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)""")  # fmt: skip
    return ",\n".join(steps)


ORACLE_SQL = oracle_sql()
