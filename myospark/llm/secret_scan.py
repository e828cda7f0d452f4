"""Secrets in texts: fixed patterns, and strings that look random rather than written.

Two character Markov models of first order, one of random strings and one of ordinary identifiers, are counted by
Spark from labelled samples; a long token that no pattern has is a secret when the log-likelihood ratio of the models
passes a bound set by a quantile of the ordinary samples held out.  Samples: the values that the patterns find and
seeded draws are random; all words of a bounded number of documents, single and put together as identifiers are, are
ordinary.

A null text counts as empty and has no spans; repeated rows are scanned each; an empty table gives an empty result; very long
texts are scanned whole.  Spans are in code points, end exclusive.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans as sp
from .batches import bounded_batches, turn_to

KINDS = ["assign", "access", "hex"]
RANDOM = "markov"
RANK = {k: i for i, k in enumerate([*KINDS, RANDOM])}
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Training takes the words of at most so many documents, those with the least hash of their id.
SAMPLE_DOCS = 2000
#: Seeded draws a document; the share of ordinary samples held out that must score under the bound by MARGIN; values sent at once.
DRAWS, QUANTILE, MARGIN, CHUNK = 8, 0.999, 0.1, 50_000
SEEDED = 4000
ALPHABETS = ["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"]


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text)]
    return found + [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text)]


def base_values(text: str) -> list[str]:
    """What the patterns take as the secret itself."""
    values = [m[2] for m in ASSIGN.finditer(text) if len(m[2]) >= 12] if ":" in text or "=" in text else []
    return values + [m[0] for m in ACCESS.finditer(text)] + [m[0] for m in HEX.finditer(text)]


def identifiers(words: list[str], rnd: random.Random) -> list[str]:
    """Ordinary identifiers put together from words: joined, camel case, snake case, paths, with a number or a date."""
    out = []
    for k in range(0, len(words) - 2, 3):
        a, b, c = (w.lower() for w in words[k : k + 3])
        number = str(rnd.choice([rnd.randint(0, 99), rnd.randint(1990, 2035), rnd.randint(100, 99999)]))
        out += [a + b, f"{a}_{b}_{c}", f"{a}-{b}-{c}-{number}", f"{a}{b.title()}{c.title()}", f"{a.upper()}_{b.upper()}", f"{a}/{b}/{c}{number}", f"{a.title()}{b.title()}{number}"]
    return out


def labelled_sample(docs: DataFrame, most: int = SAMPLE_DOCS, seed: int = 17) -> DataFrame:
    """(value string, secret int, held_out int) from at most `most` documents and seeded draws in each task's share."""
    ids = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).distinct()
    texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("secret_scan")
        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array(secret, pa.int32())], names=["value", "secret"])

        values, secret = [], []
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text, rnd = text or "", random.Random(f"{seed}:{key}")
                hits = base_values(text)
                hidden = {w for h in hits for w in re.findall(r"[A-Za-z]{3,}", h)}
                words = [w for w in re.findall(r"[A-Za-z]{3,}", text) if w not in hidden]
                drawn = ["".join(rnd.choices(rnd.choice(ALPHABETS), k=rnd.randint(20, 44))) for _ in range(DRAWS)]
                ordinary = words + identifiers(words, rnd)
                values += hits + drawn + ordinary
                secret += [1] * (len(hits) + len(drawn)) + [0] * len(ordinary)
                if len(values) >= CHUNK:
                    yield sent()
                    values, secret = [], []
        yield sent()

    sample = texts.mapInArrow(run, "value string, secret int")
    return sample.withColumn("held_out", (F.pmod(F.xxhash64("value"), F.lit(5)) == 0).cast("int"))


class MarkovModel:
    """The table of log-likelihood ratios, random over ordinary, of a character given the one before; 0 is the start."""

    def __init__(self, ratios: np.ndarray, bound: float = 0.0):
        self.ratios, self.bound = ratios, bound

    @classmethod
    def from_counts(cls, counts: np.ndarray, smooth: float = 0.5) -> MarkovModel:
        """counts[secret, before, after]. Unseen transitions are smoothed over the printable characters."""
        p = counts + smooth
        p = np.log(p / p.sum(2, keepdims=True))
        return cls(p[1] - p[0])

    def score(self, value: str) -> float:
        """Mean log-likelihood ratio of a character."""
        codes = np.frombuffer(value.encode("ascii", "replace"), np.uint8)
        return float(self.ratios[np.concatenate([[0], codes[:-1]]), codes].mean()) if len(codes) else -1.0

    def is_secret(self, value: str) -> bool:
        kinds = any(c.isdigit() for c in value) + any(c.islower() for c in value) + any(c.isupper() for c in value)
        return kinds > 1 and self.score(value) > self.bound


def train(docs: DataFrame, most: int = SAMPLE_DOCS) -> MarkovModel:
    """Count transitions in Spark; at most 2 x 128 x 128 counts and one bound come back."""
    sample = labelled_sample(docs, most).where(F.col("value").rlike("^[\\x21-\\x7e]+$"))

    def transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((2, 128 * 128), np.int64)
        for batch in batches:
            secret = batch.column(0).to_numpy()
            for k in (0, 1):
                codes = np.frombuffer("".join(f"\0{v}" for v in batch.column(1).filter(pa.array(secret == k)).to_pylist()).encode("ascii"), np.uint8).astype(np.int64)
                cells[k] += np.bincount((codes[:-1] * 128 + codes[1:])[codes[1:] > 0], minlength=128 * 128)
        k, at = np.nonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(at // 128, pa.int32()), pa.array(at % 128, pa.int32()), pa.array(cells[k, at], pa.int64())], names=["secret", "a", "b", "n"])

    rows = sample.where("held_out = 0").select("secret", "value").mapInArrow(transitions, "secret int, a int, b int, n long").groupBy("secret", "a", "b").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((2, 128, 128))
    for r in rows:
        counts[r["secret"], r["a"], r["b"]] = r["n"]
    model = MarkovModel.from_counts(counts)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(v) for v in batch.column(0).to_pylist() if len(v) >= 16]
            yield pa.RecordBatch.from_arrays([pa.array(scores, pa.float64())], names=["score"])

    held = sample.where("held_out = 1 and secret = 0").select("value").mapInArrow(scored, "score double")
    top = held.agg(F.percentile_approx("score", QUANTILE, 100_000)).first()[0]
    model.bound = max(0.25, (top or 0.0) + MARGIN)
    return model


def spans_of(text: str, model: MarkovModel | None) -> list[tuple[int, int, int, str]]:
    found = base_spans(text)
    if model is None:
        return found
    taken = sorted((s, e) for s, _, e, _ in found)
    for m in CANDIDATE.finditer(text):
        if not any(s < m.end() and m.start() < e for s, e in taken) and model.is_secret(m[0]):
            found.append((m.start(), RANK[RANDOM], m.end(), RANDOM))
    return found


def find_secrets(docs: DataFrame, model: MarkovModel | None, text_col: str = "text", redact: str | None = None) -> DataFrame:
    """docs with the column spans; or with `redact`, docs in whose texts every secret is replaced by it."""
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != "spans" or redact is not None]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*(F.col(f"`{c}`") for c in kept)).schema)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("secret_scan")
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            found = [sp.in_order(spans_of(t, model)) if t else [] for t in texts]
            columns, names = [batch.column(c) for c in kept], list(kept)
            if redact is None:
                columns.append(pa.array(found, kind))
                names.append("spans")
            else:
                columns[at] = pa.array([sp.redacted(t, s, redact) if s else t for t, s in zip(texts, found, strict=True)], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(run, schema + f", spans {sp.SPANS}" * (redact is None))


def redact_documents(docs: DataFrame, model: MarkovModel | None, mark: str = "<secret>") -> DataFrame:
    """docs, columns as they are, with secrets replaced and n_chars, where there is one, counted anew for texts that changed."""
    changed = find_secrets(docs, model, redact=mark)
    if "n_chars" not in docs.columns:
        return changed
    kind = docs.schema["n_chars"].dataType
    return changed.withColumn("n_chars", F.when(F.col("text").contains(mark), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
