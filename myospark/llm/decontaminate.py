"""Benchmark items in documents, re-parameterised ones too.

Texts become templates: tokens are runs of letters and digits in lower case, and numbers, names and units are replaced by the
placeholders <num>, <name> and <unit>.  Scripts without blanks (Han, kana, Thai, Lao, Khmer, Burmese) have a token for each
character.  Windows of eight tokens of the benchmark meet those of the documents in a hash join, each twice: by its words as
they stand, in any case, and by its template if that has placeholders.  In every alignment of a document with an item (windows
at a constant distance) the values in the slots of the templates must map one to one; where they don't, the windows found by
their words alone count.  The item is found, as it stands or with other parameters, if at least half of its windows are.

Names are capitalised words inside a sentence; numbers begin with a digit; units are listed words after a number.
Items shorter than a window are one window of their length; those under LEAST_TOKENS tokens meet by their words alone, and
one of a single token is a word, not a passage, and is left out.  Items of 8 to 22 tokens have windows of a third of their
length, so that one changed word leaves half of them, and these must be found in one alignment.  Windows with fewer
ordinary tokens than half their length have no template; with other values they count where the windows found around them
in the same alignment cover them.  All windows of an item count.

Nulls count as empty texts; repeated rows of the benchmark count once, repeated documents give their pairs once; of equal
alignments of a document with an item the one with the most windows counts, the exact one of equals; very long texts are
read whole, in runs of about a megabyte; letters whose lower case takes another number of bytes stay as they are; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .batches import bounded_batches, mix, prefix_hash, runs, slice_hash, text_chunks, turn_to
from .near_dedup import salted

WINDOW, LEAST_TOKENS, COVERAGE = 8, 4, 0.5
#: Tokens of the shortest items.
SHORTEST = 2
#: Items of fewer tokens than this, and a window or more, also have windows of full length, whose templates hold enough words.
WHOLE = 11
#: The filter of window hashes that every task gets has PLACES a window of the benchmark, so it lets one in so many others
#: through, and between these numbers of bits: four megabytes at most. A fuller one lets more through to the join, never less.
PLACES, FILTER_BITS = 1024, (22, 25)
#: Units that follow a number.
UNITS = ["mm", "cm", "m", "km", "g", "kg", "mg", "t", "l", "ml", "s", "min", "h", "hours", "hour", "minutes", "minute", "seconds", "days", "day", "weeks", "years", "miles", "mile", "feet", "inches", "meters", "metres", "kilometers", "grams", "kilograms", "pounds", "litres", "liters", "dollars", "euros", "cents", "percent", "degrees", "usd", "eur", "kmh", "mph"]
NUM, NAME, UNIT, WORD = 1, 2, 3, 0
PLACEHOLDERS = {NUM: "<num>", NAME: "<name>", UNIT: "<unit>"}
PRIME = np.uint64(0x9E3779B97F4A7C15)

DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
STOP = np.zeros(256, bool)
STOP[[10, 33, 46, 58, 59, 63]] = True  # line end ! . : ; ?
#: First and last code points of scripts without blanks, and of marks that are no letters.
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FDF), (0x3021, 0x302F), (0x3031, 0x312F), (0x31A0, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]
MARKS = [(0x00A0, 0x00BF), (0x2000, 0x206F), (0x3000, 0x3020), (0x3030, 0x3030), (0xFF00, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65)]


def within(points: np.ndarray, ranges: list[tuple[int, int]]) -> np.ndarray:
    found = np.zeros(len(points), bool)
    for a, b in ranges:
        found |= (points >= a) & (points <= b)
    return found


def raw(column: pa.Array) -> np.ndarray:
    """The bytes of a column of texts."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]]


def lowered(column: pa.Array, data: np.ndarray) -> np.ndarray:
    """The bytes of a column of texts, `data`, in lower case, every character where it was."""
    low = raw(pc.utf8_lower(column.cast(pa.large_string())))
    follows = lambda x: (x & 0xC0) == 0x80
    if len(low) == len(data) and np.array_equal(follows(low), follows(data)):
        return low
    fold = lambda c: k if len((k := c.lower()).encode()) == len(c.encode()) and len(k) == 1 else c
    return np.frombuffer("".join("".join(map(fold, t or "")) for t in column.to_pylist()).encode(), np.uint8)


def tokens(data: np.ndarray, low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(starts, ends, row, kind, code, word's own code) of the template tokens of a run of UTF-8 texts, low its lower case."""
    n = len(data)
    digit = DIGIT[data]
    inside = digit | LETTER[data]
    if n > 2:  # a point or comma between digits belongs to the number
        mark = ((data == 44) | (data == 46))[1:-1] & digit[:-2] & digit[2:]
        inside[1:-1] |= mark
    alone, begins = np.zeros(n + 1, bool), np.zeros(n + 1, bool)  # bytes of characters that are tokens, and their first bytes
    wide = np.flatnonzero(data >= 0xC2)
    if len(wide):
        size = np.where(data[wide] < 0xE0, 2, np.where(data[wide] < 0xF0, 3, 4))
        at = np.minimum(wide[:, None] + np.arange(1, 4), n - 1)
        more = (data[at] & 0x3F).astype(np.int64)
        head = data[wide].astype(np.int64)
        point = np.where(size == 2, (head & 31) << 6 | more[:, 0], np.where(size == 3, (head & 15) << 12 | more[:, 0] << 6 | more[:, 1], (head & 7) << 18 | more[:, 0] << 12 | more[:, 1] << 6 | more[:, 2]))
        for which, ranges in ((False, MARKS), (True, UNSPACED)):
            own = within(point, ranges)
            for k in range(4):
                place = wide[own & (size > k)] + k
                if which:
                    alone[place] = True
                else:
                    inside[place] = False
            begins[wide[own]] |= which
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1] | begins[1:-1] | (alone[:-2] & ~alone[1:-1])
    after = np.append(start[1:] | ~inside[1:], True) | edge[1:]
    starts, ends = np.flatnonzero(start), np.flatnonzero(inside & after) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    if not len(starts):
        return starts, ends, row, starts.astype(np.int8), starts.astype(np.uint64), starts.astype(np.uint64)
    code = slice_hash(prefix_hash(low), starts, ends)
    kind = np.zeros(len(starts), np.int8)
    kind[digit[starts]] = NUM
    # a capital is a character that lower case changes
    changed = np.concatenate(([0], np.cumsum(data != low)))
    length = lambda x: np.select([x < 0x80, x < 0xE0, x < 0xF0], [1, 2, 3], 4)
    second = starts + length(data[starts])
    third = np.minimum(second + length(data[np.minimum(second, n - 1)]), n)
    title = (changed[np.minimum(second, n)] > changed[starts]) & (second < ends) & (changed[third] == changed[np.minimum(second, n)]) & LETTER[data[np.minimum(second, n - 1)]]
    stops = np.concatenate([[0], np.cumsum(STOP[data])])
    first = np.ones(len(starts), bool)
    first[1:] = (row[1:] != row[:-1]) | (stops[starts[1:]] > stops[ends[:-1]])
    kind[title & ~first] = NAME
    follows = np.zeros(len(starts), bool)
    follows[1:] = (kind[:-1] == NUM) & (row[1:] == row[:-1])
    kind[follows & (kind == WORD) & np.isin(code, UNIT_CODES)] = UNIT
    return starts, ends, row, kind, np.where(kind == WORD, code, kind.astype(np.uint64)), code


def _unit_codes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    starts, ends, _ = runs(data != 32, np.array([0, len(data)]))
    return slice_hash(prefix_hash(data), starts, ends)


UNIT_CODES = _unit_codes()


def item_size(n: np.ndarray) -> np.ndarray:
    """The length of the windows of items of n tokens."""
    return np.where(n < WINDOW, n, np.minimum((n + 1) // 3, WINDOW))


def windows(row: np.ndarray, kind: np.ndarray, code: np.ndarray, own: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first token, hash, whether by its words as they stand) of the windows that lie in one text: all of them by their words,
    and those by their template that have placeholders, and ordinary tokens as the majority."""
    n = len(code) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    plain = np.concatenate([[0], np.cumsum(kind == WORD)])
    ordinary = plain[size:] - plain[:-size]
    good = row[:n] == row[size - 1 :]
    every, some = np.flatnonzero(good), np.flatnonzero(good & (ordinary < size) & (2 * ordinary >= size) & (size >= LEAST_TOKENS))
    h, stands = np.full(n, size, np.uint64), np.full(n, size + WINDOW, np.uint64)
    for i in range(size):
        h = h * PRIME + code[i : i + n]
        stands = stands * PRIME + own[i : i + n]
    return np.concatenate((every, some)), mix(np.concatenate((stands[every], h[some]))), np.arange(len(every) + len(some)) < len(every)


WINDOW_SCHEMA = "template string, hash long, pos int, size int, slots array<string>"


def emitted(data: np.ndarray, starts, ends, kind, at: int, size: int, literal: bool) -> tuple[str, list[str]]:
    """The template of a window as text, and the values in its slots; of one that meets by its words, the words."""
    parts, slots = [], []
    for i in range(at, at + size):
        word = data[starts[i] : ends[i]].tobytes().decode("utf-8", "replace")
        parts.append(word if literal or kind[i] == WORD else PLACEHOLDERS[int(kind[i])])
        if kind[i] != WORD and not literal:
            slots.append(PLACEHOLDERS[int(kind[i])] + word)
    return ("= " if literal else "") + " ".join(parts), slots


def template_windows(texts: DataFrame, id_col: str, sizes: list[int], wanted: np.ndarray | None, own_size: bool = False) -> DataFrame:
    """id, template, hash, pos, size, slots of windows; only those whose hash `wanted` marks, if given. With own_size a
    text gives the windows of its item_size, and of full length if it is little longer."""
    bounded_batches(texts.sparkSession)
    kind_ = texts.schema[id_col].dataType.simpleString()
    shift = np.uint64(64 if wanted is None else 64 - (8 * len(wanted)).bit_length() + 1)
    broadcast = texts.sparkSession.sparkContext.broadcast(wanted) if wanted is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("decontaminate")
        bits = None if broadcast is None else broadcast.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: dict[str, list] = {k: [] for k in ("id", "template", "hash", "pos", "size", "slots")}
            for a, b, data, offsets in text_chunks(batch.column(1)):
                low = lowered(batch.column(1).slice(a, b - a), data)
                starts, ends, row, kind, code, own = tokens(data, low, offsets)
                first = np.searchsorted(row, np.arange(b - a + 1), "left")
                length = np.diff(first)
                for size in sizes:
                    at, h, literal = windows(row, kind, code, own, size)
                    if own_size:
                        n = length[row[at]]
                        fits = (item_size(n) == size) | ((size == WINDOW) & (n >= WINDOW) & (n < WHOLE))
                        at, h, literal = at[fits], h[fits], literal[fits]
                    if bits is not None:
                        place = h >> shift
                        hit = (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1
                        at, h, literal = (x[hit.view(bool)] for x in (at, h, literal))
                    for i, x, stands in zip(at.tolist(), h.view(np.int64).tolist(), literal.tolist(), strict=True):
                        template, slots = emitted(low, starts, ends, kind, i, size, stands)
                        out["id"].append(ids[a + row[i]])
                        out["template"].append(template)
                        out["hash"].append(x)
                        out["pos"].append(i - int(first[row[i]]))
                        out["size"].append(size)
                        out["slots"].append(slots)
            types = [batch.schema.field(0).type, pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    return texts.select(id_col, "text").mapInArrow(run, f"id {kind_}, {WINDOW_SCHEMA}")


def marks_of(items: DataFrame) -> np.ndarray:
    """The filter of the windows' hashes, 32 places gathered in Spark before they come to the driver."""
    windows = items.select("hash").distinct().count()
    bits = min(max((PLACES * windows).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    place = F.shiftrightunsigned("hash", 64 - bits)
    cells = items.select(place.alias("p")).groupBy(F.shiftright("p", 5).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 as int))")).alias("marks"))
    out = np.zeros(1 << (bits - 5), np.uint32)
    for r in cells.collect():
        out[r["cell"]] = r["marks"]
    return out.view(np.uint8)


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, windows found, coverage and kind ('exact' or 'reparameterised') of every item found in a document."""
    sizes = list(range(SHORTEST, WINDOW + 1))
    items = materialize(template_windows(benchmark.select("item_id", "text").dropDuplicates(), "item_id", sizes, None, own_size=True).withColumnRenamed("id", "item_id"), "benchmark-windows")
    used = sorted(r[0] for r in items.select("size").distinct().collect())
    if not used:
        used = [WINDOW]
    found = template_windows(docs.select("doc_id", "text"), "doc_id", used, marks_of(items))
    totals = items.groupBy("item_id", "size").agg(F.countDistinct("pos").alias("total"))
    mine = items.select("item_id", "size", "template", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"))
    # the benchmark's windows lie in several places, so the rows of a template that many documents hold do too
    both = salted(found.select(F.col("id").alias("doc_id"), "template", "pos", "slots").distinct(), mine, "template", by="doc_id")
    met = both.groupBy("doc_id", "item_id", "size", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(
        F.collect_set("item_pos").alias("all_places"),
        F.collect_set(F.when(F.col("template").startswith("= "), F.col("item_pos"))).alias("own_places"),
        F.array_distinct(F.flatten(F.collect_set(F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d"))))).alias("values"),
    )
    item_values, doc_values = F.transform("values", lambda v: v["i"]), F.transform("values", lambda v: v["d"])
    one_to_one = (F.size(F.array_distinct(item_values)) == F.size("values")) & (F.size(F.array_distinct(doc_values)) == F.size("values"))
    same = ~one_to_one | F.forall("values", lambda v: v["i"] == v["d"])
    # windows between two found ones that touch or overlap consist of tokens found
    filled = F.expr("flatten(transform(places, (p, i) -> sequence(p, if(i + 1 < size(places) and places[i + 1] - p <= size, places[i + 1] - 1, p))))")
    met = met.withColumn("same", same).withColumn("places", F.array_sort(F.when(one_to_one, F.col("all_places")).otherwise(F.col("own_places"))))
    consistent = met.where(F.size("places") > 0).join(totals, ["item_id", "size"]).withColumn("places", filled)
    best = F.max(F.struct(F.size("places").alias("n"), "same"))
    pairs = consistent.groupBy("doc_id", "item_id", "total", "size").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), best.alias("best"))
    windows_found = F.when(F.col("size") < WINDOW, F.col("best.n")).otherwise(F.size("places"))
    out = pairs.withColumn("windows", windows_found).withColumn("coverage", F.col("windows") / F.col("total")).where(F.col("coverage") >= coverage)
    out = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", F.col("best.same").alias("same"), "windows")).alias("m"))
    return out.select("doc_id", "item_id", "m.windows", "m.coverage", F.when(F.col("m.same"), "exact").otherwise("reparameterised").alias("kind"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark item. Rows with a null id cannot be told apart and stay."""
    bad = materialize(contaminated_pairs(docs, benchmark).select("doc_id").distinct(), "contaminated")
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)
