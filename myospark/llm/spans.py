"""Spans found in texts: their digest columns, and redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(frame: DataFrame, kinds: list[str], spans: str = "spans") -> DataFrame:
    """doc_id, n_<kind> and base_sha256 of the base kinds, and all spans as a string."""

    def of(kind: str):
        return lambda s: s["kind"] == kind

    base = F.filter(spans, lambda s: s["kind"].isin(kinds))
    counts = [F.size(F.filter(spans, of(k))).cast("long").alias(f"n_{k}") for k in kinds]
    return frame.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col(spans)).alias("spans"))


def in_order(found: list[tuple[int, int, int, str]]) -> list[dict]:
    """(start, rank of the kind, end, kind) as rows, by start and then by kind."""
    return [{"kind": kind, "start": start, "end": end} for start, _, end, kind in sorted(found)]


def redacted(text: str, spans: list[dict], mark: str) -> str:
    """text with every maximal run of overlapping spans replaced by mark."""
    out, at, stop = [], 0, -1
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if s["start"] >= stop:
            if stop >= 0:
                at = stop
            out += [text[at : s["start"]], mark]
            stop = s["end"]
        else:
            stop = max(stop, s["end"])
    return "".join(out) + text[max(stop, 0) :] if spans else text
