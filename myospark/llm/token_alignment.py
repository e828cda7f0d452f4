"""Alignment of two tokenizers' tokens over the same bytes.

A is a byte-level BPE of the tokenizers library, given a space and the text; B is a sentencepiece model, given the text, to
which it puts a space itself.  Where tokens end is marked in packed bitsets, one bit a byte.  The AND of the two holds the
shared cuts; the popcount of all bits up to a cut, by a rank directory, tells how many tokens of either side lie before it,
so consecutive cuts give the token ranges of a group; and every A token of a group links with every B token of it.

Neither tokenizer joins what stands on the two sides of a space that follows another character, so a text falls into
units there, which are also shared cuts.  Equal units have equal tokens: each worker keeps what it has found for them.

The count of a linked pair of ids is the number of rows that hold it.  The pairs of most rows, at most HEAD of them, are
sent to all tasks; the others, which few rows hold, are joined.  So what is sent is bounded and no key of the join is hot.

Null and empty texts, and texts whose tokens don't give back the bytes of a space and the text (such as texts with the word
mark U+2581), have no tokens: all their numbers are zero and the digest is ''. Strings of special tokens are plain text.
Every row counts as a document, repeated rows and rows with a null or repeated id too. Very long texts are read whole. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialize
from .batches import bounded_batches

MARK = "▁"
#: Units that a worker keeps, and characters of new units that it encodes at once.
MEMO_UNITS, MEMO_CHARS = 250_000, 1 << 20
#: Characters of units that are encoded as one text.
ENCODE_CHARS = 1 << 14
#: Pairs that are sent to all tasks, about 60 MB of them.
HEAD = 1 << 20
ID_BITS = 32
#: What either tokenizer may take as a blank beside white space: units begin only after other characters.
BLANK = "\u180e\u200b\u2060\ufeff\u2581"
NOT_PLAIN = re.compile(f"[\\s{BLANK}] | $").search
UNITS = re.compile(f"(?<=[^\\s{BLANK}])(?= [\\s{BLANK}]*[^\\s{BLANK}])").split

LINKS = "array<struct<pair:bigint,times:bigint>>"


def units(text: str) -> list[str]:
    """The pieces of a space and a text that both tokenizers keep apart; each begins with a space."""
    text = " " + text
    return UNITS(text) if NOT_PLAIN(text) else [" " + w for w in text[1:].split(" ")]


class Bits:
    """A packed bitset over bytes, with the number of bits set before each word."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    @classmethod
    def of(cls, places: np.ndarray, size: int) -> Bits:
        marks = np.zeros(-(-(size + 1) // 64) * 64, bool)
        marks[places] = True
        return cls(np.packbits(marks, bitorder="little").view("<u8"))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def select(self) -> np.ndarray:
        """The places of all bits, in order."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little").view(bool))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many bits are set at or before each place."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        upto = self.words[word] & (~np.uint64(0) >> (np.uint64(63) - bit))
        return self.before[word] + np.bitwise_count(upto)


def expand(a: np.ndarray, b: np.ndarray, a_to: np.ndarray, b_to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, pair of ids) of every A-B token pair; a_to and b_to are the tokens before the end of each group."""
    a_from, b_from = np.concatenate(([0], a_to[:-1])), np.concatenate(([0], b_to[:-1]))
    wide = b_to - b_from
    n = (a_to - a_from) * wide
    group = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = a[a_from[group] + at // wide[group]]
    return group, (first << ID_BITS) | b[b_from[group] + at % wide[group]]


def group_text(a: np.ndarray, b: np.ndarray, a_to: np.ndarray, b_to: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All groups as `a1,a2|b1,b2;` and where each ends."""
    # the A tokens of a group stand before its B tokens: each has as many before it as of its own side, and of the other those
    # up to the start or the end of its group
    a_group, b_group = (np.repeat(np.arange(len(x)), np.diff(x, prepend=0)) for x in (a_to, b_to))
    a_place = np.arange(len(a)) + np.concatenate(([0], b_to[:-1]))[a_group]
    b_place = np.arange(len(b)) + a_to[b_group]
    ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[a_place], ids[b_place] = a, b
    mark[a_place[a_to - 1]], mark[b_place[b_to - 1]] = ord("|"), ord(";")
    width = len(str(ids.max()))
    powers = 10 ** np.arange(width - 1, -1, -1)
    shown = np.empty((len(ids), width + 1), np.uint8)
    shown[:, :-1] = ids[:, None] // powers % 10 + ord("0")
    shown[:, -1] = mark
    there = np.ones(shown.shape, bool)
    there[:, : width - 1] = ids[:, None] >= powers[:-1]
    return shown[there].tobytes(), np.cumsum(there.sum(1))[b_place[b_to - 1]]


class Aligner:
    def __init__(self, byte_model: str, piece_model: str):
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        self.a = Tokenizer.from_file(byte_model)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        # the alphabet of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        alphabet = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
        if set(alphabet) != set(pre_tokenizers.ByteLevel.alphabet()):
            raise ValueError("another alphabet of bytes")
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        piece = self.b.id_to_piece
        self.b_bytes = [bytes([int(piece(i)[3:-1], 16)]) if self.b.is_byte(i) else piece(i).replace(MARK, " ").encode() for i in range(self.b.vocab_size())]
        self.cuts = not any(MARK in piece(i).lstrip(MARK) for i in range(self.b.vocab_size()))
        self.a_size, self.b_size = (np.array([*map(len, x)]) for x in (self.a_bytes, self.b_bytes))
        self.known: dict[str, tuple[bytes, bytes, int, bytes] | None] = {}
        self.old: dict[str, tuple[bytes, bytes, int, bytes] | None] = {}

    def units(self, text: str) -> list[str]:
        return units(text) if self.cuts else [" " + text]

    def learn(self, new: list[str]) -> None:
        """For each unit its distinct pairs and their numbers, its numbers of A tokens, B tokens and groups in one integer, and
        its groups as text; None if the tokens don't give back its bytes. Units that end with another character than a blank
        stand in long texts one after the other, as they would in a document."""
        alone = [u for u in new if u[-1].isspace() or u[-1] in BLANK]
        new = [u for u in new if not (u[-1].isspace() or u[-1] in BLANK)] + alone
        together = len(new) - len(alone)
        texts, at, size = [], [0], 0
        for k, u in enumerate(new, 1):
            size += len(u)
            if size > ENCODE_CHARS or k >= together:
                texts.append("".join(new[at[-1] : k]))
                at.append(k)
                size = 0
        fast = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        a_ids, b_ids = [e.ids for e in fast(texts, add_special_tokens=False)], self.b.encode([t[1:] for t in texts], num_threads=1)
        good = []
        for k, (text, x, y) in enumerate(zip(texts, a_ids, b_ids, strict=True)):
            raw = text.encode()
            if b"".join(map(self.a_bytes.__getitem__, x)) == raw and b"".join(map(self.b_bytes.__getitem__, y)) == raw:
                good.append(k)
            elif at[k + 1] - at[k] == 1:
                self.known[new[at[k]]] = None
            else:
                for u in new[at[k] : at[k + 1]]:
                    self.learn([u])
        if good:
            own = [u for k in good for u in new[at[k] : at[k + 1]]]
            a, b = (np.fromiter(chain.from_iterable(x[k] for k in good), np.int64) for x in (a_ids, b_ids))
            self.keep(own, a, b)

    def keep(self, own: list[str], a: np.ndarray, b: np.ndarray) -> None:
        """Align the tokens of units that stand one after the other."""
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        size = int(a_ends[-1])
        a_bits, b_bits = Bits.of(a_ends, size), Bits.of(b_ends, size)
        cuts = (a_bits & b_bits).select()
        a_to, b_to = a_bits.rank(cuts), b_bits.rank(cuts)
        ends = np.cumsum([len(u.encode()) for u in own])
        last = np.searchsorted(cuts, ends, "right")  # groups up to the end of each unit
        if not np.array_equal(cuts[last - 1], ends):
            raise ValueError("a token of either side reaches over the end of a unit")
        group, pairs = expand(a, b, a_to, b_to)
        # equal pairs of a unit meet
        unit = np.repeat(np.arange(len(own)), np.diff(last, prepend=0))[group]
        order = np.lexsort((pairs, unit))
        unit, pairs = unit[order], pairs[order]
        fresh = np.ones(len(pairs), bool)
        fresh[1:] = (unit[1:] != unit[:-1]) | (pairs[1:] != pairs[:-1])
        at = np.flatnonzero(fresh)
        times, pairs = np.diff(np.append(at, len(pairs))).tobytes(), pairs[at].tobytes()
        upto = 8 * np.searchsorted(unit[at], np.arange(len(own)), "right")
        said, said_to = group_text(a, b, a_to, b_to)
        said_to = said_to[last - 1]
        numbers = [x[last - 1] for x in (a_to, b_to)] + [last]
        n = [i | j << 64 | k << 128 for i, j, k in zip(*(np.diff(x, prepend=0).tolist() for x in numbers), strict=True)]
        shifted = lambda x: [0, *x.tolist()[:-1]]
        for u, i, j, k, f, t in zip(own, shifted(upto), upto.tolist(), n, shifted(said_to), said_to.tolist(), strict=True):
            self.known[u] = (pairs[i:j], times[i:j], k, said[f:t])

    def settle(self, texts: list[str]) -> list[list[str]]:
        """The units of the texts, all of them known now."""
        if len(self.known) > MEMO_UNITS:  # what has not been asked for since the last time goes
            self.old, self.known = self.known, {}
        cut = [self.units(t) if t else [] for t in texts]
        known, old, new, size = self.known, self.old, [], 0
        for u in set(chain.from_iterable(cut)).difference(known):
            if u in old:
                known[u] = old[u]
            elif MARK in u:
                known[u] = None  # B would give a space back
            else:
                new.append(u)
                size += len(u)
                if size > MEMO_CHARS:
                    self.learn(new)
                    new, size = [], 0
        if new:
            self.learn(new)
        return cut

    def text(self, own: list[str]) -> tuple[np.ndarray, np.ndarray, int, int, int, bytes]:
        """(pairs, times, A tokens, B tokens, groups, groups as text) of a text by its units."""
        found = [*map(self.known.__getitem__, own)]
        if not found or None in found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0, 0, b""
        pairs = np.frombuffer(b"".join(map(itemgetter(0), found)), np.int64)
        times = np.frombuffer(b"".join(map(itemgetter(1), found)), np.int64)
        order = np.argsort(pairs)
        pairs = pairs[order]
        at = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
        n = sum(map(itemgetter(2), found))
        one = (1 << 64) - 1
        return pairs[at], np.add.reduceat(times[order], at), n & one, n >> 64 & one, n >> 128, b"".join(map(itemgetter(3), found))[:-1]


@lru_cache(maxsize=2)
def aligner(byte_model: str, piece_model: str) -> Aligner:
    """One a Python worker, shared by the tasks that it runs."""
    return Aligner(byte_model, piece_model)


def runs(texts: list[str]) -> Iterator[list[str]]:
    """The texts in runs of about MEMO_CHARS characters."""
    at = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size > MEMO_CHARS:
            yield texts[at : k + 1]
            at, size = k + 1, 0
    if at < len(texts):
        yield texts[at:]


def align_tokens(docs: DataFrame, byte_model: str, piece_model: str, groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and links (distinct pairs as a_id << 32 | b_id, and their numbers) of
    every row; with groups the column `groups`, the ids of either side in each.

    The model files are found under the same paths on every node."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    made = [f"{n} long" for n in numbers] + ["groups_sha256 string", f"links {LINKS}"] + ["groups array<struct<a:array<int>,b:array<int>>>"] * groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(byte_model, piece_model)
        for batch in batches:
            at = 0
            for texts in runs([t or "" for t in batch.column(1).to_pylist()]):
                found = [own.text(u) for u in own.settle(texts)]
                pairs, times, a, b, n, said = zip(*found, strict=True)
                offsets = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
                links = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in (pairs, times)], ["pair", "times"]))
                columns = [batch.column(0).slice(at, len(texts)), *(pa.array(x, pa.int64()) for x in (a, b, n, [int(t.sum()) for t in times]))]
                columns += [pa.array([hashlib.sha256(s).hexdigest() if s else "" for s in said], pa.string()), links]
                if groups:
                    ids = lambda side: [*map(int, side.split(","))]
                    rows = [[dict(zip("ab", map(ids, g.split("|")), strict=True)) for g in s.decode().split(";")] if s else [] for s in said]
                    columns.append(pa.array(rows, pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(m.split()[0] for m in made)])
                at += len(texts)

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join([f"doc_id {kind}", *made]))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, docs (rows that hold it) and best (whether no other pair of its A id is held by more rows). An A id has at most as
    many pairs as B has ids."""
    counts = aligned.select(F.explode("links.pair").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))
    most = F.max("docs").over(Window.partitionBy(F.shiftright("pair", ID_BITS)))
    return counts.select("pair", "docs", (F.col("docs") == most).alias("best"))


def alignment_scores(docs: DataFrame, byte_model: str, piece_model: str, head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    aligned = align_tokens(docs, byte_model, piece_model)
    aligned = materialize(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned")  # numbered once, when written
    counts = materialize(pair_counts(aligned), "pair-counts")
    # the least power of two from which on the pairs are at most `head`
    sizes = counts.groupBy(F.floor(F.log2("docs")).alias("power")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 64 rows
    least, n = 64, 0
    for r in sorted(sizes, key=lambda r: -r.power):
        if (n := n + r.n) > head:
            break
        least = r.power
    often = F.col("docs") >= F.lit(1 << min(least, 62))
    links = aligned.select("row", F.inline("links"))
    seen = links.join(F.broadcast(counts.where(often)), "pair", "left")
    sums = [F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("docs") * F.col("times")).alias("count_sum")]
    scores = seen.groupBy("row").agg(*sums)
    if n > head:
        seldom = seen.where("docs is null").select("pair", "row", "times").join(counts.where(~often), "pair")
        scores = scores.unionByName(seldom.groupBy("row").agg(*sums)).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("n_best", "count_sum")))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return aligned.drop("links").join(scores, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", none("n_best"), none("count_sum"), "groups_sha256")
