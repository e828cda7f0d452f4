"""SentencePiece encoding with merge-type vocabularies.

A text becomes symbols; an agenda (a heap ordered by score, then by place) holds every adjacent pair whose
concatenation is a piece, and the best pair is merged until none is left.  Symbols that no piece covers are
spelled in byte pieces.

Two facts keep it fast without changing a single id.  A merge can never span two neighbouring characters that no piece holds
side by side, so a text falls apart at such places and into units, word marks and all up to the next; and equal units and
parts have equal ids, so each task keeps a bounded memo.  Every unit that enters the memo is compared whole with the
sentencepiece library, one call per Arrow batch; a difference stops the job.

Nulls count as empty; an empty text has no ids; extra columns stay; repeated rows are encoded each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import bounded_batches, turn_to

MARK = "▁"
MEMO_ENTRIES = 300_000
PLACES = 32
PLACE = (1 << PLACES) - 1


class MergeVocabulary:
    """Pieces and scores of a model file with the identity normaliser and a dummy prefix."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        ids = range(sp.vocab_size())
        self.ids = {sp.id_to_piece(i): i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        by_score = {x: k for k, x in enumerate(sorted({-sp.get_score(i) for i in self.ids.values()}))}
        self.rank = {p: by_score[-sp.get_score(i)] << PLACES for p, i in self.ids.items()}
        self.neighbours = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.plain = re.compile(f"{MARK}[{self.companions()}]+").fullmatch
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(MARK in p.lstrip(MARK) for p in self.ids) or any(map(sp.is_unused, ids)):
            raise ValueError("pieces that are unused or hold a word mark after other characters are not supported")

    def companions(self) -> str:
        """Letters every two of which some piece holds side by side, in either order, and each after a word mark."""
        letters = set("abcdefghijklmnopqrstuvwxyz")
        lacking = lambda a: sum((a + b not in self.neighbours) + (b + a not in self.neighbours) for b in letters) + 99 * (MARK + a not in self.neighbours)
        while letters and lacking(worst := max(sorted(letters), key=lacking)):
            letters.remove(worst)
        return "".join(sorted(letters)) or MARK

    def merge(self, symbols: list[str]) -> list[str]:
        """The agenda: the best-scored adjacent pair first, the leftmost of equals. An entry is the rank of the pair's score
        and its place in one number; it is stale unless `now` has that rank for that place."""
        n, rank = len(symbols), self.rank.get
        now = list(map(rank, map(add, symbols, symbols[1:])))
        agenda = [r + i for i, r in enumerate(now) if r is not None]
        heapify(agenda)
        now.append(None)
        right, left = [*range(1, n + 1)], [*range(-1, n)]
        while agenda:
            e = heappop(agenda)
            i = e & PLACE
            if now[i] != e - i:
                continue
            j = right[i]
            piece = symbols[i] = symbols[i] + symbols[j]
            symbols[j], now[j], now[i] = "", None, None
            right[i] = k = right[j]
            left[k] = i
            if k < n and (r := rank(piece + symbols[k])) is not None:
                now[i] = r
                heappush(agenda, r + i)
            if (h := left[i]) >= 0:
                now[h] = r = rank(symbols[h] + piece)
                if r is not None:
                    heappush(agenda, r + h)
        return [s for s in symbols if s]

    def spell(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        return [i] if i is not None else [self.bytes[b] for b in piece.encode()]

    def part_ids(self, part: str) -> list[int]:
        merged = self.merge(list(part))
        found = list(map(self.ids.get, merged))
        return [i for s in merged for i in self.spell(s)] if None in found else found

    def cut(self, unit: str) -> list[str]:
        """The parts of a unit between neighbours that no piece holds side by side, which no merge can span."""
        if self.plain(unit):
            return [unit]
        hold = self.neighbours
        ends = [k for k, pair in enumerate(map(add, unit, unit[1:]), 1) if pair not in hold]
        if not ends:
            return [unit]
        out, at = [], 0
        for k in ends:
            out.append(unit[at:k])
            at = k
        out.append(unit[at:])
        return out

    def checked(self, found: dict[str, list[int]]) -> None:
        """Compare whole units, by what follows their first word mark, with the library in one call. A word mark alone is the
        one unit that the library cannot be asked for."""
        found.pop("", None)
        keys = list(found)
        right = self.library.encode([k.replace(MARK, " ") for k in keys], num_threads=1) if keys else []
        if right != list(found.values()):
            wrong = next(k for k, ids in zip(keys, right, strict=True) if ids != found[k])
            raise ValueError(f"ids differ from the sentencepiece library for {MARK + wrong!r}")


class Memo(dict):
    """What `make` gives for a key, made when first asked for. Two generations: what has not been asked for since the last
    change of generations goes, so the size stays under twice `most`."""

    def __init__(self, make, most: int = MEMO_ENTRIES):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found

    def turn(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Ids of units as text, such as "12,7", by what follows a unit's first word mark."""

    def __init__(self, vocab: MergeVocabulary):
        self.vocab, self.fresh = vocab, {}
        self.units, self.parts = Memo(self.unit), Memo(self.part)
        self.number = {str(i): i for i in range(vocab.library.vocab_size())}

    def part(self, part: str) -> str:
        return ",".join(map(str, self.vocab.part_ids(part)))

    def unit(self, key: str) -> str:
        first, *others = self.vocab.cut(MARK + key)
        if others:  # the first part is a unit too, as which it is kept for others that begin with it
            found = ",".join([self.units[first[1:]], *(self.parts[p] for p in others)])
            self.fresh[key] = self.numbers(found)
            return found
        ids = self.fresh[key] = self.vocab.part_ids(first)
        return ",".join(map(str, ids))

    def encode(self, text: str) -> str:
        return ",".join(map(self.units.__getitem__, units(text))) if text else ""

    def numbers(self, ids: str) -> list[int]:
        return list(map(self.number.__getitem__, ids.split(","))) if ids else []

    def settle(self, check: bool) -> None:
        """At the end of a batch: compare what is new, let go what is old."""
        if check:
            self.vocab.checked(self.fresh)
        self.fresh.clear()
        self.units.turn()
        self.parts.turn()


def units(text: str) -> list[str]:
    """What follows the first word mark of each unit: a unit is a word mark, dummy prefix first, and everything up to the
    next word mark that follows another character."""
    marked = text.replace(MARK, " ")
    words = marked.split(" ")
    if "" not in words:
        return words
    out: list[str] = []
    gap = 0
    for w in words:
        if w:
            out.append(MARK * gap + w)
            gap = 0
        else:
            gap += 1
    return [*out, MARK * (gap - 1)] if gap else out


@lru_cache(maxsize=2)
def vocabulary(model: str) -> MergeVocabulary:
    return MergeVocabulary(model)


@lru_cache(maxsize=2)
def encoder(model: str) -> Encoder:
    """One a Python worker, shared by the tasks that it runs."""
    return Encoder(vocabulary(model))


def forget() -> None:
    encoder.cache_clear()
    vocabulary.cache_clear()


def encode_ids(vocab: MergeVocabulary, text: str) -> list[int]:
    """Ids of one text, without memo."""
    return [i for u in units(text) for p in vocab.cut(MARK + u) for i in vocab.part_ids(p)] if text else []


def encode_text(docs: DataFrame, model: str, text_col: str = "text", ids_col: str | None = "ids", digest: bool = False, check: bool = True) -> DataFrame:
    """docs with the ids of every whole text, and with digest the columns n_tokens, ids_sha256, decoded_sha256.

    model: path of the model file, the same on every node.  ids_col: the column of ids, None to leave it out.
    Decoding is the library's decode(ids).  Columns of those names in docs are replaced.
    """
    made = ([] if ids_col is None else [(ids_col, "array<int>")]) + ([("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")] if digest else [])
    kept = [c for c in docs.columns if c.lower() not in {n.lower() for n, _ in made}]
    rest = [c for c in kept if c != text_col or ids_col is not None or not digest]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(rest).schema] + [f"`{n}` {t}" for n, t in made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("sentencepieces", forget)
        encode, decode = encoder(model), vocabulary(model).library.decode
        for batch in batches:
            ids, n, sums, decoded = [], [], [], []
            for value in batch.column(text_col):
                text = value.as_py() or ""
                joined = encode.encode(text)
                one = encode.numbers(joined)
                if ids_col is not None:
                    ids.append(one)
                if digest:
                    n.append(len(one))
                    sums.append(hashlib.sha256(joined.encode()).hexdigest())
                    decoded.append(hashlib.sha256(decode(one).encode() if one else b"").hexdigest())
            encode.settle(check)
            columns = [batch.column(c) for c in rest] + ([] if ids_col is None else [pa.array(ids, pa.list_(pa.int32()))])
            if digest:
                columns += [pa.array(n, pa.int64()), pa.array(sums, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, *(n for n, _ in made)])

    bounded_batches(docs.sparkSession)
    return docs.select(*map(F.col, [f"`{c}`" for c in kept])).mapInArrow(run, schema)


def decode_ids(frame: DataFrame, model: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """frame with the text of each row's ids; null ids give an empty text."""
    kept = [c for c in frame.columns if c != text_col]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(kept).schema] + [f"`{text_col}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = vocabulary(model).library.decode
        for batch in batches:
            texts = [decode(v) if v else "" for v in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, text_col])

    bounded_batches(frame.sparkSession)
    return frame.select(kept).mapInArrow(run, schema)
