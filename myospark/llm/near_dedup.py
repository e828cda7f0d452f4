"""Near-duplicate documents by order MinHash.

A text is the sequence of its five-word shingles, each labelled with the number of its occurrence, so all are distinct.
A sketch has several tables; in each the few labelled shingles that a table's hash puts lowest are taken in the order
of the text, so two texts agree in a table only if they share those shingles in the same order.  Texts that agree in a
table are candidates.  A candidate pair is verified by banded alignment: the longest common subsequence of the two
labelled sequences, m, within a band as wide as the threshold allows gives m / (n1 + n2 - m), and 0.8 or more links.

Exact copies meet first, so only one of them is sketched further.  In each bucket all texts are aligned with its hub, the
text that meets most others; the links make components, and only buckets that still hold several components go on: there
every text outside the largest component meets all others, in blocks of texts, so no pair of a bucket is left out unless it
lies in one component already.  Blocks count the common shingles of a text with all others at once and align only pairs that
have enough of them.  Classes are the connected components of all links.  No side of a join goes through the driver.

A null text counts as empty.  Texts under five words are one shingle of all their words; texts without words are near
nothing but their exact copies; very long texts are read whole, the sketch in steps of bounded memory.  Rows with a null id get
the class of their text; repeated rows share a class; rows of one id with different texts are different documents.  Ids may be of
any type with an order.  A class without any id has the class_id null.  Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..storage import discard, materialize, spread, sweep, unsent, workspace
from .batches import bounded_batches, mix, text_chunks, turn_to, word_hashes

WORDS, SIMILARITY = 5, 0.8
#: (tables, shingles of a table, texts of at most so many shingles). At a similarity of 0.8 a pair misses all tables
#: with a chance of (1 - 0.8^8)^64 = 8e-6, a short one with (1 - 0.8^3)^20 = 6e-7; two texts that share a passage and are
#: half alike agree in a table with a chance of (1/3)^8 = 2e-4.
SKETCHES = ((64, 8, None), (20, 3, 60))
CELLS = 1 << 21
#: Places over which the rows of a hot key are dealt; distances of two tables whose signatures make a narrow bucket; texts of a block.
SALTS, STEPS, BLOCK = 16, (1, 4, 11), 512
PRIME = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Labelled shingles of a sequence of word hashes, in order."""
    if not len(words):
        return words
    with np.errstate(over="ignore"):
        n = max(1, len(words) - k + 1)
        s = np.zeros(n, np.uint64)
        for i in range(min(k, len(words))):
            s = s * PRIME + words[i : i + n]
        s = mix(s + np.uint64(min(k, len(words))))
        order = np.argsort(s, kind="stable")
        ordered = s[order]
        new = np.empty(n, bool)
        new[0], new[1:] = True, ordered[1:] != ordered[:-1]
        if not new.all():
            first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            s[order] = mix(ordered + (np.arange(n) - first).astype(np.uint64) * PRIME)
    return s


def sketch(x: np.ndarray) -> list[int]:
    """Signatures of all tables of a labelled sequence."""
    out: list[np.ndarray] = []
    n = len(x)
    for which, (tables, size, most) in enumerate(SKETCHES):
        if not n or (most is not None and n > most):
            continue
        step = max(1, CELLS // n)
        for first in range(0, tables, step):
            table = np.arange(first, min(tables, first + step), dtype=np.uint64)
            with np.errstate(over="ignore"):
                salt = mix((table + np.uint64(1 + 1000 * which)) * PRIME)
                h = (x[None, :] ^ salt[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(29)
                h *= np.uint64(0x94D049BB133111EB)
                at = np.argpartition(h, size - 1, axis=1)[:, :size] if n > size else np.tile(np.arange(n), (len(table), 1))
                at.sort(axis=1)
                sig = salt.copy()
                for k in range(at.shape[1]):
                    sig = mix(sig * PRIME + x[at[:, k]])
            out.append(sig)
    return np.concatenate(out).view(np.int64).tolist() if out else []


def text_shingles(column: pa.Array) -> Iterator[np.ndarray]:
    for a, b, data, offsets in text_chunks(column):
        words, at = word_hashes(data, offsets)
        for i in range(b - a):
            yield shingles(words[at[i] : at[i + 1]])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, node (digest of the text), n shingles, signatures."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("near_dedup")
        for batch in batches:
            n, sigs = [], []
            for x in text_shingles(batch.column(2)):
                n.append(len(x))
                sigs.append(sketch(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sigs, pa.list_(pa.int64()))], names=["doc_id", "node", "n", "sigs"])

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.unhex(F.md5(text)).alias("node"), text.alias("text")).mapInArrow(run, f"doc_id {kind}, node binary, n long, sigs array<long>")


def alignment(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """m / (n1 + n2 - m) for the longest common subsequence m of two sequences of distinct items; 0 if under `least`.

    As items are distinct, common subsequences are increasing sequences of places. Reaching `least` leaves at most
    `band` items unmatched, so no matched pair lies further off the diagonal."""
    total = len(a) + len(b)
    need = least / (1 + least) * total - 1e-9
    if not total or min(len(a), len(b)) < need:
        return 0.0
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    inside = np.abs(ia - ib) <= int(total - 2 * need) + 1
    if inside.sum() < need:
        return 0.0
    order = np.argsort(ia[inside])
    places = ib[inside][order]
    if len(places) < 2 or (places[1:] > places[:-1]).all():
        m = len(places)
    else:
        tails: list[int] = []
        for p in places.tolist():
            k = bisect_left(tails, p)
            tails[k : k + 1] = [p]
        m = len(tails)
    return m / (total - m) if m >= need else 0.0


def salted(rows: DataFrame, narrow: DataFrame, key: str, by: str = "id", how: str = "inner") -> DataFrame:
    """rows joined with narrow, which has one row a key: the rows of a hot key lie in SALTS places, each with its copy of the one."""
    copies = narrow.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(unsent(copies), [key, "salt"], how).drop("salt")


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, text_a, text_b). The pairs of an `a` lie in up to SALTS places, to each of which its text goes once."""
    pairs = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt"))
    left = pairs.select("a", "salt").distinct().join(unsent(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))), "a")
    right = pairs.join(unsent(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))), "b")
    return right.join(unsent(left), ["a", "salt"]).select("a", "b", "text_a", "text_b")


def aligned(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b, linked): whether the texts of a pair align."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("near_dedup")
        last, own = None, None
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), text_shingles(batch.column(3)), strict=True):
                if last is None or not x.equals(last):
                    last, own = x, next(text_shingles(pa.array([x.as_py()], pa.string())))
                linked.append(alignment(own, y, least) > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    kind = pairs.schema["a"].dataType.simpleString()
    return with_texts(pairs, texts).mapInArrow(run, f"a {kind}, b {kind}, linked boolean").groupBy("a", "b").agg(F.max("linked").alias("linked"))


def similar_size(a, b, least: float):
    return F.least(a, b) >= F.greatest(a, b) * least


def shared_signatures(reps: DataFrame) -> DataFrame:
    """(sig, id, n, place, size) of the signatures that several texts have; place is the number of the table."""
    rows = reps.select("id", "n", F.posexplode("sigs").alias("place", "sig"))
    sizes = materialize(rows.groupBy("sig").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    return materialize(salted(rows, sizes, "sig"), "shared")


def hub_pairs(shared: DataFrame, least: float) -> DataFrame:
    """(a, b) of the hub of a bucket, a, and every other text in it. The hub is the text that meets most others over all tables,
    the least id of equals: of edited copies that is the text they were made from, in nearly every table the same."""
    met = shared.groupBy("id").agg(F.sum("size").alias("met"))
    hubs = shared.join(unsent(met), "id").groupBy("sig").agg(F.min(F.struct((-F.col("met")).alias("minus"), "id", "n")).alias("h"))
    each = salted(shared, hubs.select("sig", F.col("h.id").alias("hub"), F.col("h.n").alias("hub_n")), "sig")
    return each.where((F.col("id") != F.col("hub")) & similar_size(F.col("n"), F.col("hub_n"), least)).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()


def open_buckets(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of buckets that still hold several components, with the root of each text's."""
    rows = shared.drop("size").join(unsent(roots.select(F.col("node").alias("id"), "root")), "id", "left").withColumn("root", F.coalesce("root", "id"))
    several = rows.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("sig")
    return salted(rows, several, "sig", how="left_semi")


def all_pairs(opened: DataFrame, least: float) -> DataFrame:
    """(a, b) of all texts of different components that share a bucket, as a join: what links_of_open_buckets must not lose."""
    side = lambda x: opened.select("sig", *(F.col(c).alias(f"{c}_{x}") for c in ("root", "id", "n")))
    both = side("a").join(side("b"), "sig").where((F.col("root_a") < F.col("root_b")) & similar_size(F.col("n_a"), F.col("n_b"), least))
    return both.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def narrow_pairs(opened: DataFrame, least: float) -> DataFrame:
    """(a, b) of texts of different components that agree in two tables at once, a being a hub of those that do: the two
    that a hash of the key puts first and last, so every such bucket has hubs of its own. Some of all pairs, for a quick look."""
    opened = materialize(opened.groupBy("id", "n", "root").agg(F.collect_set(F.struct("place", "sig")).alias("own")), "open")  # at most a row a table

    def at(place, step: int):
        first, tables = F.lit(0), F.lit(SKETCHES[0][0])
        for k, (count, _, _) in enumerate(SKETCHES[1:], 1):
            before = sum(c for c, _, _ in SKETCHES[:k])
            first, tables = F.when(place >= before, F.lit(before)).otherwise(first), F.when(place >= before, F.lit(count)).otherwise(tables)
        return first + F.pmod(place - first + step, tables)

    def keys(step: int):
        other = lambda e: F.get(F.filter("own", lambda o: o["place"] == at(e["place"], step)), F.lit(0))["sig"]
        return F.array_compact(F.transform("own", lambda e: F.when(other(e).isNotNull(), F.xxhash64(e["sig"], other(e)))))

    keyed = opened.select("id", "n", "root", F.explode(F.array_distinct(F.concat(*(keys(s) for s in STEPS)))).alias("key"))
    member = F.struct(F.xxhash64("key", "id").alias("h"), "id", "n", "root")
    heads = keyed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(member).alias("first"), F.max(member).alias("last")).where("lo < hi")
    heads = materialize(heads.select("key", F.array("first", "last").alias("hubs")), "hubs")
    met = salted(keyed, heads, "key").select("id", "n", "root", F.explode("hubs").alias("hub")).where((F.col("root") != F.col("hub.root")) & similar_size(F.col("n"), F.col("hub.n"), least))
    pairs = met.select(F.col("hub.id").alias("a"), F.col("id").alias("b"), F.least("id", "hub.id").alias("lo"), F.greatest("id", "hub.id").alias("hi"))
    return pairs.dropDuplicates(["lo", "hi"]).select("a", "b")


def families(opened: DataFrame) -> DataFrame:
    """(root, family) of the components that open buckets hold together."""
    low = opened.groupBy("sig").agg(F.min("root").alias("a"))
    joined = connected_components(salted(opened, low, "sig").select("a", F.col("root").alias("b")))
    return joined.select(F.col("node").alias("root"), F.col("root").alias("family"))


def sent(size, rest):
    """How often a text is sent for a group of `size` texts of which `rest` lie outside its largest component."""
    return size * F.ceil(rest / BLOCK) + rest * F.ceil(size / BLOCK)


def groups_to_test(opened: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, groups) such that every two texts of different components that share a bucket are members of one group: the
    texts of a family together or those of each of its buckets, whichever sends fewer texts. Members are (grp, id, root),
    groups (grp, size, big, rest), big being the largest component and rest the number of texts outside it."""
    placed = materialize(salted(opened, families(opened), "root").select("sig", "id", "root", "family"), "families")
    both = placed.select("family", F.struct(F.lit(False).alias("of_bucket"), F.col("family").alias("key")).alias("grp"), "id", "root").distinct()
    both = materialize(both.unionByName(placed.select("family", F.struct(F.lit(True).alias("of_bucket"), F.col("sig").alias("key")).alias("grp"), "id", "root")), "members")
    each = both.groupBy("family", "grp", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("family", "grp").agg(F.sum("n").alias("size"), F.max_by("root", F.struct("n", "root")).alias("big"), (F.sum("n") - F.max("n")).alias("rest"))
    cost = lambda of_bucket: F.sum(F.when(F.col("grp.of_bucket") == of_bucket, sent(F.col("size"), F.col("rest"))))
    apart = each.groupBy("family").agg((cost(True) < cost(False)).alias("apart"))
    groups = materialize(each.join(unsent(apart), "family").where(F.col("grp.of_bucket") == F.col("apart")).select("grp", "size", "big", "rest"), "groups")
    return both.drop("family"), groups


def dealt(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, p, d, id, root, probe, data): the members of each group in blocks, so that every text outside the largest
    component, as a probe, meets every other, as data, in one place (grp, p, d)."""
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    own = salted(members, groups, "grp").withColumn("_p", F.when(F.col("root") != F.col("big"), F.pmod(F.xxhash64("id"), blocks("rest")).cast("int"))).withColumn("_d", F.pmod(F.xxhash64("id"), blocks("size")).cast("int"))
    place = lambda p, d: F.struct(p.alias("p"), d.alias("d"))
    as_data = F.transform(every(blocks("rest")), lambda p: place(p, F.col("_d")))
    as_probe = F.transform(every(blocks("size")), lambda d: place(F.col("_p"), d))
    places = F.when(F.col("_p").isNull(), as_data).otherwise(F.array_distinct(F.concat(as_data, as_probe)))
    at = own.withColumn("at", F.explode(places))
    return at.select("grp", "at.p", "at.d", "id", "root", F.coalesce(F.col("at.p") == F.col("_p"), F.lit(False)).alias("probe"), (F.col("at.d") == F.col("_d")).alias("data"))


def links_between(ids: list[int], roots: list[int], texts: list[np.ndarray], probe: np.ndarray, data: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links of probes with data of other components, as many as join all components that any link joins. Pairs with too few
    common shingles are told apart by a count for all data at once; the rest are aligned."""
    top = {r: r for r in roots}

    def find(r: int) -> int:
        while top[r] != r:
            top[r] = r = top[top[r]]
        return r

    at = np.flatnonzero(data)
    n = np.array([len(texts[k]) for k in at])
    items, owner = np.concatenate([texts[k] for k in at]), np.repeat(np.arange(len(at)), n)
    order = np.argsort(items)
    items, owner = items[order], owner[order]
    out = []
    for k in np.flatnonzero(probe).tolist():
        first, last = np.searchsorted(items, texts[k], "left"), np.searchsorted(items, texts[k], "right")
        many = last - first
        common = np.bincount(owner[np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())], minlength=len(at))
        for j in at[common >= least / (1 + least) * (len(texts[k]) + n) - 1e-9].tolist():
            a, b = find(roots[k]), find(roots[j])
            if a != b and not (j < k and probe[j] and data[k]) and alignment(texts[k], texts[j], least) > 0:
                top[max(a, b)] = min(a, b)
                out.append((ids[k], ids[j]))
    return out


def links_of_open_buckets(opened: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b): links between texts of different components that share a bucket, none of which is left out unless others
    already join its components. A task holds the texts of two blocks."""

    def run(table: pa.Table) -> pa.Table:
        turn_to("near_dedup")
        own = list(text_shingles(table.column("text").combine_chunks()))
        found = links_between(table.column("id").to_pylist(), table.column("root").to_pylist(), own, table.column("probe").to_numpy(), table.column("data").to_numpy(), least)
        return pa.table([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    rows = dealt(*groups_to_test(opened)).join(unsent(texts), "id")
    return spread(rows, "grp", "p", "d").groupBy("grp", "p", "d").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, copy_of for every row: the least id of its class, and of its exact copies."""
    with workspace(docs.sparkSession) as keep:
        return keep(materialize(text_classes(docs, least).select("doc_id", "class_id", "copy_of"), "near-duplicates"))


def text_classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, node (digest of the text), class, class_id, copy_of for every row. A different text is a node of its own, whatever its
    ids are; nodes are numbered when they are written."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    drawn = materialize(sketches(docs), "sketches")
    rows = materialize(drawn.select("doc_id", "node"), "rows")
    lowest = drawn.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "n", "sigs")).alias("m"))
    reps = materialize(lowest.select("node", F.col("m.doc_id").alias("doc_id"), F.col("m.n").alias("n"), F.col("m.sigs").alias("sigs"), F.monotonically_increasing_id().alias("id")), "representatives")
    discard(drawn)
    shared = shared_signatures(reps)
    known = materialize(reps.drop("sigs", "n"), "nodes")
    discard(reps)
    ids = known.join(unsent(shared.select("id").distinct()), "id").select("id", own_place("doc_id", "node"))
    placed = docs.select(F.coalesce("text", F.lit("")).alias("text"), own_place("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit(""))))))
    texts = materialize(placed.join(unsent(ids), "place").dropDuplicates(["place"]).select("id", "text"), "candidates")
    tested = materialize(aligned(hub_pairs(shared, least), texts, least), "tested")
    roots = materialize(connected_components(tested.where("linked")), "roots")
    opened = materialize(open_buckets(shared, roots), "open")
    added = materialize(links_of_open_buckets(opened, texts, least), "links")
    sweep(spark)
    # the new links join whole components
    root = lambda c: unsent(roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")))
    between = added.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    joined = connected_components(between).select(F.col("node").alias("root"), F.col("root").alias("over"))
    known = known.join(unsent(roots.withColumnRenamed("node", "id")), "id", "left").withColumn("root", F.coalesce("root", "id"))
    known = materialize(salted(known, joined, "root", how="left").select("node", "id", F.col("doc_id").alias("copy_of"), F.coalesce("over", "root").alias("class")), "known")
    heads = known.groupBy("class").agg(F.min("copy_of").alias("class_id"))
    classes = salted(known, heads, "class").select("node", "class", "class_id", "copy_of")
    return salted(rows, classes, "node", by="doc_id").select("doc_id", "node", "class", "class_id", "copy_of")


def own_place(doc_id, node):
    """A digest of a row's id and text."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.hex(node)))).alias("place")


def one_of_each(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """docs without all but one document of each class: the one of the least id stays, once. Rows with a null id stay. Rows of one id
    with different texts are different documents."""
    own = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    with workspace(docs.sparkSession) as keep:
        found = text_classes(docs, least).where("doc_id is not null")
        first = keep(materialize(found.groupBy("class").agg(F.min(F.struct("doc_id", "node")).alias("m")).select("m.doc_id", "m.node"), "kept"))
    kept = first.select(own_place("doc_id", "node"))
    placed = docs.withColumn("_place", own_place("doc_id", own))
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    stay = placed.where("doc_id is not null").join(unsent(kept.withColumnRenamed("place", "_place")), "_place", "left_semi")
    stay = stay.dropDuplicates(["_place"]) if repeated else stay
    return stay.select(docs.columns).unionByName(docs.where("doc_id is null").select(docs.columns))
