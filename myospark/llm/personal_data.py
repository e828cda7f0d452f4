"""Personal data in texts: fixed patterns, and identifiers that occur where known ones do.

The patterns' finds are the seeds.  Every place of an identifier, found or merely shaped like one (a run of tokens that hold
a digit each, five in all, or an @), yields lexical patterns: the word before, the word after, and both.  Spark scores the graph of patterns and instances in turns: a
pattern is as good as the share of good ones among its distinct instances and the other uses of its words in all
documents, given enough good ones, so words that stand everywhere prove nothing; an instance that is no seed is as
good as its good patterns together make it.  Instances that pass the bound are personal data wherever
they stand.  The start and the end of a text count as words; so does what is glued to an identifier, up to GLUED
characters, with the words that begin or end with it as its uses.

A null text counts as empty and has no spans; repeated rows are searched each; an empty table gives an empty result; very
long texts are searched whole.  Spans are in code points, end exclusive.  Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from . import spans as sp
from .batches import bounded_batches

KINDS = ["email", "ip", "card", "phone"]
CONTEXT = "context"
RANK = {k: i for i, k in enumerate([*KINDS, CONTEXT])}
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]")
# a match can only begin where a run of digits begins, so the look-behind changes nothing but the time it takes
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A run of neighbouring tokens with a digit or an @ each, such as '415 555 7788', and how many digits make it an identifier.
TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*(?:\x20[^\s0-9@]*[0-9]\S*)*")
LEAST_DIGITS = 5
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Turns of scoring; distinct good instances that a pattern needs; score from which a pattern counts and an instance is one.
TURNS, SUPPORT, GOOD_PATTERN, GOOD_INSTANCE = 3, 3, 0.6, 0.8
OCCURRENCES = "array<struct<start:bigint,end:bigint,seed:int,value:string,before:string,after:string,before_new:int,after_new:int,alone:int>>"
WORD = re.compile(r"\S+")
#: Words hold no white space, so a tab tells a text's start and end, and what is glued before ('x\t') or after ('\tx').
START, END, GLUED = "^\t\t", "\t\t$", 64
#: Bits of the filter of contexts whose uses are counted: 2^22 positions, half a megabyte, however many contexts there are.
FILTER_BITS = 22
#: Marks of the words of wanted pairs in that filter; distinct words or contexts that a task holds before it lets them go.
LEFT, RIGHT, COUNTED = "\n<", "\n>", 200_000


def emails(text: str) -> list[tuple[int, int]]:
    """Place by place of an @: the longest local part before it that no earlier match has, and the domain after it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def is_ip(value: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in value.split("."))


def is_card(value: str) -> bool:
    digits = [ord(c) - 48 for c in value if c not in " -"]
    if not 14 <= len(digits) <= 19:
        return False
    doubled = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def is_phone(value: str) -> bool:
    return 10 <= sum(c.isdigit() for c in value) <= 15


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    found = [(s, 0, e, "email") for s, e in emails(text)] if "@" in text else []
    if DIGITS.search(text):
        for k, (kind, pattern, right) in enumerate((("ip", IP, is_ip), ("card", CARD, is_card), ("phone", PHONE, is_phone)), 1):
            found += [(m.start(), k, m.end(), kind) for m in pattern.finditer(text) if right(m[0])]
    return found


def occurrences(text: str, base: list[tuple[int, int, int, str]]) -> list[dict]:
    """Places of identifiers with the words around them: seeds, and other runs of tokens with an @ or at least five digits."""
    places, taken = [], sorted((s, e) for s, _, e, _ in base)
    places += [(s, e, 1) for s, e in dict.fromkeys(taken)]
    for m in TOKEN.finditer(text):
        s, e = m.start(), m.end()
        while e > s and text[e - 1] in ".,;:!?)\"'*#$%&":
            e -= 1
        value = text[s:e]
        if ("@" in value[1:] or sum(c in "0123456789" for c in value) >= LEAST_DIGITS) and not any(a < e and s < b for a, b in taken):
            places.append((s, e, 0))
    if not places:
        return []
    out, begun, ended = [], set(), set()
    words = [m.span() for m in WORD.finditer(text)]
    firsts, lasts = [w[0] for w in words], [w[1] for w in words]

    def word(k: int) -> str:
        return text[slice(*words[k])].lower()

    for s, e, seed in places:
        i, j = bisect_right(firsts, s) - 1, bisect_left(lasts, e)
        before, after = text[firsts[i] : s].lower(), text[e : lasts[j]].lower()
        alone = i == j and not before and not after
        if before:
            before = f"{before}\t" if len(before) <= GLUED else None
        else:
            before = word(i - 1) if i else START
        if after:
            after = f"\t{after}" if len(after) <= GLUED else None
        else:
            after = word(j + 1) if j + 1 < len(words) else END
        out.append({"start": s, "end": e, "seed": seed, "value": re.sub(r"[\s().-]", "", text[s:e]).lower(), "before": before, "after": after, "before_new": int(s not in begun), "after_new": int(e not in ended), "alone": int(alone)})
        begun.add(s)
        ended.add(e)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, the base spans and the occurrences of every document."""
    bounded_batches(docs.sparkSession)
    base_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    text = [("value", pa.string()), ("before", pa.string()), ("after", pa.string()), ("before_new", pa.int32()), ("after_new", pa.int32()), ("alone", pa.int32())]
    found_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("seed", pa.int32()), *text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, found = [], []
            for text in batch.column(1).to_pylist():
                here = base_spans(text) if text else []
                base.append(sp.in_order(here))
                found.append(occurrences(text, here) if text else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, base_type), pa.array(found, found_type)], names=["doc_id", "base", "found"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, base {sp.SPANS}, found {OCCURRENCES}")


def patterns_of(places: DataFrame) -> DataFrame:
    """(pattern, value, seed, places where the pattern's words are those around an identifier): the edges of the graph."""

    def edge(kind: str, here: str, *words: str):
        return F.struct(F.when(F.concat(*words).isNotNull(), F.concat_ws(" ", F.lit(kind), *words)).alias("pattern"), F.col(here).alias("here"))

    made = F.array(edge("before", "before_new", "before"), edge("after", "after_new", "after"), edge("both", "alone", "before", "after"))
    edges = places.select(F.inline(made), "value", "seed").where("pattern is not null")
    return edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed"), F.sum("here").alias("here"))


def uses_of(docs: DataFrame, wanted: bytes, begins: set[int], ends: set[int]) -> DataFrame:
    """(context, total) over all texts: words, starts and ends, beginnings and ends of words, and 'a b' for a and b with
    one word between; only contexts that `wanted` marks (and those that share a place of the filter with them). Beginnings
    and ends of words are those of the lengths in begins and ends."""
    bounded_batches(docs.sparkSession)
    marks = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = marks.value

        def known(context: str) -> int:
            at = zlib.crc32(context.encode("utf-8", "replace")) >> (32 - FILTER_BITS)
            return bits[at >> 3] >> (at & 7) & 1

        def glued(words: Counter) -> None:
            for w, n in words.items():
                if known(w):
                    found[w] += n
                size = min(len(w) - 1, GLUED) if w not in (START, END) else 0
                for k in begins:
                    if 1 <= k <= size and first[w[:k]]:
                        found[f"{w[:k]}\t"] += n
                for k in ends:
                    if 1 <= k <= size and last[w[-k:]]:
                        found[f"\t{w[-k:]}"] += n

        def sent() -> pa.RecordBatch:
            held = {w: n for w, n in found.items() if n}
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["context", "n"])

        class Marked(dict):
            """Whether a word is at one side of a wanted pair, or what begins or ends words is wanted, looked up once."""

            def __init__(self, before: str, after: str = ""):
                self.before, self.after = before, after

            def __missing__(self, w: str) -> int:
                self[w] = out = known(f"{self.before}{w}{self.after}")
                return out

        words, found, left, right, first, last = Counter(), Counter(), Marked(LEFT), Marked(RIGHT), Marked("", "\t"), Marked("\t")
        for batch in batches:
            for text in batch.column(0).to_pylist():
                here = text.lower().split() if text else []
                if here:
                    words.update(here)
                    words.update((START, END))
                    pairs = [f"{a} {b}" for a, b in zip([START, *here[:-1]], [*here[1:], END], strict=True) if left[a] and right[b]]
                    found.update(p for p in pairs if known(p))
                if len(words) >= COUNTED or len(left) >= COUNTED:
                    glued(words)
                    for held in (words, left, right, first, last):
                        held.clear()
                if len(found) >= COUNTED:
                    yield sent()
        glued(words)
        yield sent()

    return docs.select("text").mapInArrow(run, "context string, n long").groupBy("context").agg(F.sum("n").alias("total"))


def with_other_uses(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """The edges (pattern, value, seed) of the patterns with SUPPORT instances, which others never reach, and the number
    of other uses of their words. Where one is glued, a pattern of both words has at most those of either word."""
    counted = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.sum("here").alias("here")).where(f"n >= {SUPPORT}")
    words = F.split("pattern", " ")
    first, second = F.get(words, F.lit(1)), F.get(words, F.lit(2))
    glued = (F.size(words) == 3) & ((first.contains("\t") & (first != START)) | (second.contains("\t") & (second != END)))
    counted = materialize(counted.withColumn("context", F.when(~glued, F.expr("substring(pattern, instr(pattern, ' ') + 1)"))), "contexts")
    bits = np.zeros(1 << FILTER_BITS, bool)
    sided = F.when(F.size(words) == 3, F.array("context", F.concat(F.lit(LEFT), first), F.concat(F.lit(RIGHT), second))).otherwise(F.array("context"))
    place = F.shiftrightunsigned(F.crc32("context"), 32 - FILTER_BITS)
    marked = counted.where("context is not null").select(F.explode(sided).alias("context")).select(place.alias("p")).distinct()
    bits[[r[0] for r in marked.collect()]] = True
    lengths = counted.where(first.contains("\t") & (F.size(words) == 2)).select(words[0].alias("side"), (F.length(first) - 1).alias("k")).distinct().collect()
    begins, ends = ({r["k"] for r in lengths if r["side"] == side} for side in ("before", "after"))
    total = uses_of(docs, np.packbits(bits, bitorder="little").tobytes(), begins, ends)
    known = materialize(counted.where("context is not null").join(total, "context", "left").select("pattern", F.greatest(F.lit(0), F.coalesce("total", F.lit(0)) - F.col("here")).alias("other")), "uses")
    sides = counted.where("context is null").select("pattern", F.explode(F.array(F.concat(F.lit("before "), first), F.concat(F.lit("after "), second))).alias("side"))
    least = sides.join(known.withColumnRenamed("pattern", "side"), "side").groupBy("pattern").agg(F.min("other").alias("other"))
    return materialize(edges.select("pattern", "value", "seed").join(known.unionByName(least), "pattern"), "edges")


def score_patterns(edges: DataFrame, scores: DataFrame | None) -> DataFrame:
    """(pattern, score): the share of good ones, if at least SUPPORT instances are."""
    good = F.col("seed").cast("double")
    if scores is not None:
        edges = edges.join(scores, "value", "left")
        good = F.greatest(good, F.coalesce("score", F.lit(0.0)))
    counted = edges.groupBy("pattern").agg(F.sum(good).alias("good"), (F.count(F.lit(1)) + F.max("other")).alias("n"))
    return counted.where(f"good >= {SUPPORT} and good >= {GOOD_PATTERN} * n").selectExpr("pattern", "good / n as score")


def score_instances(edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """(value, score) of instances that are no seed: one minus the chance that every pattern errs, kinds of pattern
    counted once, so that two different contexts agree."""
    reached = edges.where("seed = 0").join(patterns, "pattern").groupBy("value", F.split("pattern", " ")[0].alias("kind")).agg(F.max("score").alias("score"))
    return reached.groupBy("value").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))).alias("score"))


def bootstrap(places: DataFrame, docs: DataFrame, turns: int = TURNS) -> DataFrame:
    """(value, score) of the instances that the seeds' contexts in docs reach. The edges are written once; each turn joins them."""
    edges = with_other_uses(materialize(patterns_of(places), "places"), docs)
    scores = None
    for _ in range(turns):
        scores = materialize(score_instances(edges, score_patterns(edges, scores)), "instances")
    return scores


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and spans, base and discovered, of every row of docs."""
    scanned = materialize(scan(docs).withColumn("row", F.monotonically_increasing_id()), "identifiers")
    places = scanned.select("row", F.inline("found"))
    known = bootstrap(places, docs).where(F.col("score") >= GOOD_INSTANCE)
    more = places.where("seed = 0").join(known.select("value"), "value", "left_semi")
    new = more.groupBy("row").agg(F.collect_list(F.struct(F.lit(CONTEXT).alias("kind"), "start", "end")).alias("new"))
    rank = F.create_map(*(F.lit(x) for k, v in RANK.items() for x in (k, v)))
    both = F.concat("base", F.coalesce("new", F.expr(f"cast(array() as {sp.SPANS})")))
    keyed = F.array_sort(F.transform(both, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    ordered = F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return scanned.join(new, "row", "left").select("doc_id", F.when(F.col("new").isNull(), F.col("base")).otherwise(ordered).alias("spans"))
