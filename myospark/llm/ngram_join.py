"""Similarity join of documents by their sets of word n-grams, through prefix trees.

A document's set holds its distinct four-word shingles, with A-Z in lower case; two documents link when the Jaccard
similarity of their sets is 85 % or more.  The result is the components of all links, none of which is lost.

Where to look.  Linked sets of at most `hi` shingles differ in at most d of them (d follows from hi), so of more than d
disjoint parts of all shingles, cut by hash, the two agree in at least one: sets that share a part are candidates.  1 + E
parts more than d make sure that some shared part has two shingles or more; only a set with more than E poorer parts
shows these as well.  Sizes fall into classes; a set shows its parts for its own class and for the next if it may link up.

Which parts count.  A pair that may link shares not one part but a number that follows from the sizes, so a set that shares fewer
with all others together has no link, and a set is sought only by its rarest parts: as many as leave fewer than that number.
Common passages, which make parts that many unlike sets share, so hold few sets together.

How it is joined.  The candidates of a part are put into a prefix tree, most common shingles first, an order that all of them
share.  A probe goes down the tree and counts the overlap with a stretch that many sets share once; it turns back where
the overlap so far and the lesser of what remains on either side cannot reach what the smallest set below needs, and where
all sets below are of its component already.

Groups of copies of any size.  Equal sets meet first.  Then each part's hub (the set that meets most others) probes trees of
at most BLOCK of its candidates, which is linear in the group; groups that the links hold together are done.  In the others the
sets outside the largest component probe all, block by block, so a hot group becomes many tasks of bounded memory.

Null and empty texts and texts without words have empty sets, are linked with nothing and are their own component; fewer than
four words are one shingle of all. Repeated rows, rows of equal texts and rows with a null id get the component of their set;
the component is the least id that is not null. Very long texts are read whole. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..storage import discard, materialize, sweep, workspace
from .batches import bounded_batches, mix, text_chunks, word_hashes
from .near_dedup import PRIME, salted

WORDS, PERCENT = 4, 85
#: Size classes: each upper bound is so many times the one before.
GROWTH = 1.25
#: Sets of a block, shingles of a block, cells of a probe's table at once.
BLOCK, BLOCK_SHINGLES, CELLS = 4096, 1 << 21, 1 << 22
#: What a set does in a unit.
TARGET, PROBE, BOTH = 0, 1, 2


def class_bounds(growth: float = GROWTH) -> np.ndarray:
    """The largest size of each class."""
    bounds = [1]
    while bounds[-1] < 1 << 40:
        bounds.append(max(bounds[-1] + 1, int(bounds[-1] * growth)))
    return np.array(bounds, np.int64)


BOUNDS = class_bounds()


def parts_of(hi: int, percent: int = PERCENT) -> tuple[int, int]:
    """(parts, poor parts that a set may have without showing them) for sets of at most hi shingles."""
    apart = 2 * hi * (100 - percent) // (100 + percent)
    spare = 1 + apart // 8 if apart else 0
    return apart + 1 + spare, spare


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes stay."""
    return data + np.uint8(32) * ((data >= 65) & (data <= 90))


def shingle_set(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """The distinct shingles of a sequence of word hashes, in rising order."""
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    own = min(k, len(words))
    with np.errstate(over="ignore"):
        s = np.zeros(n, np.uint64)
        for i in range(own):
            s = s * PRIME + words[i : i + n]
        return np.unique(mix(s + np.uint64(own)))


def text_sets(column: pa.Array) -> Iterator[np.ndarray]:
    for a, b, data, offsets in text_chunks(column):
        words, at = word_hashes(lower(data), offsets)
        for i in range(b - a):
            yield shingle_set(words[at[i] : at[i + 1]])


def part_keys(x: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The keys of the parts that a set shows."""
    return shown_parts(x, percent)[0]


def shown_parts(x: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, list[int], list[int]]:
    """(keys, firm, need): the keys of the parts that a set shows, whose last three bits are those of the class; for its class
    and the next how many parts are not poor, and how many it shares at least, of those that both show, with any set that it links
    with. Parts that agree are poor in both or in none, so a pair shares all but `spare` of them, though it may show none of these."""
    if not len(x):
        return np.zeros(0, np.int64), [], []
    larger = len(x) * 100 // percent
    first, last = np.searchsorted(BOUNDS, [len(x), larger])
    out, firm, need = [], [], []
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(x), dtype=np.uint64)))
        for which in range(first, last + 1):
            parts, spare = parts_of(int(BOUNDS[which]), percent)
            part = ((x >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # rises with x
            edge = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
            size = np.diff(edge)
            key = mix(total[edge[1:]] - total[edge[:-1]] + mix(np.arange(parts, dtype=np.uint64) + np.uint64(which) * PRIME))
            key = key & ~np.uint64(7) | np.uint64(which & 7)
            poor = size < 2
            out.append(key if poor.sum() > spare else key[~poor])
            firm.append(max(int(parts - poor.sum()), parts - spare))
            need.append(firm[-1] - (len(x) + min(int(BOUNDS[which]), larger)) * (100 - percent) // (100 + percent))
    return np.concatenate(out).view(np.int64), firm, need


def sketches(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, place (digest of id and text), node (digest of the set, null if empty), n, keys, class of the size, firm, need."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, nodes, keys, firm, need = [], [], [], [], []
            for x in text_sets(batch.column(2)):
                n.append(len(x))
                nodes.append(hashlib.md5(x.tobytes()).digest() if len(x) else None)
                shown = shown_parts(x, percent)
                keys.append(shown[0])
                firm.append(shown[1])
                need.append(shown[2])
            offsets = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            columns = [batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys) if keys else [], pa.int64()))]
            columns += [pa.array(np.searchsorted(BOUNDS, n), pa.int32()), pa.array(firm, pa.list_(pa.int32())), pa.array(need, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "place", "node", "n", "keys", "class", "firm", "need"])

    return docs.select("doc_id", place(), "text").mapInArrow(run, f"doc_id {kind}, place binary, node binary, n long, keys array<long>, class int, firm array<int>, need array<int>")


def place():
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))).alias("place")


class PrefixTree:
    """Sets as paths of shingles, the most common first. A node is a stretch of shingles that the sets below it share: those of
    the sorted set `left` from the depth of its parent to its own."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([*map(len, sets)])
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        self.tokens, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
        self.rank = rank
        ranks = rank[token]
        ranks = ranks[np.lexsort((ranks, owner))]
        starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        paths = [ranks[s : s + n] for s, n in zip(starts, self.sizes, strict=True)]
        written = [p.astype(">u4").tobytes() for p in paths]
        self.order = np.array(sorted(range(len(paths)), key=written.__getitem__))
        self.paths, self.starts = ranks, starts[self.order]
        lengths = self.sizes[self.order]
        common = [0]
        for a, b in zip(self.order[:-1].tolist(), self.order[1:].tolist(), strict=True):
            n = min(len(paths[a]), len(paths[b]))
            differ = paths[a][:n] != paths[b][:n]
            common.append(int(differ.argmax()) if differ.any() else n)
        self.grow(common, lengths.tolist())
        both = np.column_stack((self.left, self.right + 1)).ravel()
        self.least, self.most = (f.reduceat(np.append(lengths, lengths[-1]), both)[::2] for f in (np.minimum, np.maximum))
        up = self.parent.copy()
        up[0] = 0
        self.begin = self.starts[self.left] + self.depth[up]
        self.end = self.starts[self.left] + self.depth

    def grow(self, common: list[int], lengths: list[int]) -> None:
        """Nodes from the lengths of the common beginnings of neighbouring paths; node 0 is the root."""
        depth, left, right, parent, leaf = [0], [0], [0], [-1], [False]
        stack = [0]

        def close(l: int, last: int) -> None:
            while leaf[stack[-1]] or depth[stack[-1]] > l:
                v = stack.pop()
                right[v] = last
                if depth[stack[-1]] < l:
                    stack.append(add(l, left[v], False))
                parent[v] = stack[-1]

        def add(d: int, at: int, is_leaf: bool) -> int:
            depth.append(d)
            left.append(at)
            right.append(at)
            parent.append(-1)
            leaf.append(is_leaf)
            return len(depth) - 1

        for i, (l, n) in enumerate(zip(common, lengths, strict=True)):
            close(l, i - 1)
            stack.append(add(n, i, True))
        close(0, len(lengths) - 1)
        right[0] = len(lengths) - 1
        self.depth, self.left, self.right, self.parent, self.leaf = map(np.array, (depth, left, right, parent, leaf))

    def index(self, percent: int) -> None:
        """Which sets have a shingle among their rarest, one more than a set may lack of any that it links with."""
        lengths = self.sizes[self.order]
        many = rarest(lengths, percent)
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.starts + lengths - many, many)
        by_rank = np.argsort(self.paths[at], kind="stable")
        self.holders = np.repeat(np.arange(len(many)), many)[by_rank]
        self.holders_from = np.searchsorted(self.paths[at][by_rank], np.arange(len(self.tokens) + 1))
        leaves = np.flatnonzero(self.leaf)
        self.leaf_of = np.empty(len(lengths), np.int64)
        self.leaf_of[self.left[leaves]] = leaves

    def ways(self, key: np.ndarray, first: np.ndarray, sizes: np.ndarray, roots: np.ndarray, here: np.ndarray, percent: int) -> np.ndarray:
        """Numbers (probe, node) of the nodes, but the root, that lead to sets of other components which share one of a probe's rarest
        shingles: in an order that both have, two that link share the first of their common ones, and few come before it.
        key holds a probe's number and ranks in rising order, those of probe k from first[k]; shingles that no set has are the rarest."""
        tokens, nodes = len(self.tokens), len(self.parent)
        known = np.diff(first)
        many = np.clip(rarest(sizes, percent) - (sizes - known), 0, known)
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[1:] - many, many)
        who, rank = np.divmod(key[at], tokens)
        many = self.holders_from[rank + 1] - self.holders_from[rank]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.holders_from[rank], many)
        who, holder = np.repeat(who, many), self.holders[at]
        other = here[holder] != roots[who]
        now = np.unique(who[other] * nodes + self.leaf_of[holder[other]])
        found = [now]
        while len(now):
            who, node = np.divmod(now, nodes)
            up = self.parent[node]
            now = np.unique((who * nodes + up)[up > 0])
            found.append(now)
        return np.unique(np.concatenate(found))

    def probe(self, probes: list[np.ndarray], roots: np.ndarray, components: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
        """(probe, set) of all links but those inside one component: roots are the probes' components, components the sets'."""
        if not hasattr(self, "holders"):
            self.index(percent)
        here = components[self.order]
        tokens, nodes = len(self.tokens), len(self.parent)
        n = np.array([*map(len, probes)])
        every, owner = np.concatenate(probes), np.repeat(np.arange(len(probes)), n)
        at = np.searchsorted(self.tokens, every)
        at[at == tokens] = 0
        known = self.tokens[at] == every
        key = np.sort(owner[known] * tokens + self.rank[at[known]])
        first = np.searchsorted(key, np.arange(len(probes) + 1) * tokens)
        ways = self.ways(key, first, n, roots, here, percent)
        has = np.zeros(len(probes) * tokens, bool)
        has[key] = True
        who, child = np.divmod(ways, nodes)
        above = who * nodes + self.parent[child]
        by_parent = np.argsort(above, kind="stable")
        child, above = child[by_parent], above[by_parent]
        who, node, overlap = np.arange(len(probes)), np.zeros(len(probes), np.int64), np.zeros(len(probes), np.int64)
        found = [np.zeros((0, 2), np.int64)]
        while len(who):
            start, end = (np.searchsorted(above, who * nodes + node, side) for side in ("left", "right"))
            many = end - start
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start, many)
            who, overlap, node = np.repeat(who, many), np.repeat(overlap, many), child[at]
            # shingles of the stretch that the probe has
            length = self.end[node] - self.begin[node]
            spot = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(self.begin[node], length)
            shared = np.concatenate(([0], np.cumsum(has[np.repeat(who * tokens, length) + self.paths[spot]])))
            overlap = overlap + np.diff(shared[np.concatenate(([0], np.cumsum(length)))])
            last = np.where(self.depth[node] > 0, self.paths[self.end[node] - 1], -1)
            beyond = first[who + 1] - np.searchsorted(key, who * tokens + last + 1)
            rest = np.minimum(beyond, self.most[node] - self.depth[node])
            keep = (100 + percent) * (overlap + rest) >= percent * (n[who] + self.least[node])
            who, overlap, node = who[keep], overlap[keep], node[keep]
            leaf = self.leaf[node]
            found.append(np.column_stack((who[leaf], self.order[self.left[node[leaf]]])))  # what remains is nothing, so the bound was the test
            who, overlap, node = who[~leaf], overlap[~leaf], node[~leaf]
        links = np.concatenate(found)
        return links[:, 0], links[:, 1]


def rarest(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of a set's n shingles must hold one that it shares with any set that it links with."""
    return n - -(-percent * n // 100) + 1


def block_links(sets: list[np.ndarray], ids: np.ndarray, roots: np.ndarray, role: np.ndarray, percent: int = PERCENT) -> tuple[list[int], list[int]]:
    """(a, b) of ids: links of the probes with the targets that together join all that such links join."""
    targets, probes = np.flatnonzero(role != PROBE), np.flatnonzero(role != TARGET)
    if not len(targets) or not len(probes):
        return [], []
    tree = PrefixTree([sets[k] for k in targets])
    _, component = np.unique(np.where(roots < 0, ids, roots), return_inverse=True)
    a, b = [], []
    at, step, most = 0, 1, max(1, CELLS // len(tree.paths))
    while at < len(probes):
        now = probes[at : at + step]
        at, step = at + step, min(2 * step, most)
        for p, t in zip(*(x.tolist() for x in tree.probe([sets[k] for k in now], component[now], component[targets], percent)), strict=True):
            x, y = component[now[p]], component[targets[t]]
            if x != y:
                a.append(int(ids[now[p]]))
                b.append(int(ids[targets[t]]))
                component[component == y] = x
    return a, b


def joined_blocks(units: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b) of links found in units, rows (unit, role, id, root); a set may be in a unit twice, as target and as probe. A unit is one task's."""
    bounded_batches(units.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]] = []
        unit = None

        def solve() -> pa.RecordBatch:
            role, ids, roots = (np.concatenate([h[k] for h in held]) for k in range(3))
            a, b = block_links([x for h in held for x in h[3]], ids, roots, role, percent)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            units, role, ids, roots = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            offsets, values = batch.column(4).offsets.to_numpy(), batch.column(4).values.to_numpy().view(np.uint64)
            edges = [0, *(np.flatnonzero(units[1:] != units[:-1]) + 1).tolist(), len(units)]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if e > s:
                    if held and units[s] != unit:
                        yield solve()
                        held = []
                    unit = units[s]
                    held.append((role[s:e], ids[s:e], roots[s:e], [values[offsets[k] : offsets[k + 1]].copy() for k in range(s, e)]))
        if held:
            yield solve()

    rows = units.join(sets, "id").select("unit", "role", "id", F.coalesce("root", F.lit(-1)).cast("long").alias("root"), "x")
    return rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "a long, b long")


def blocks(sets, shingles):
    """Columns: how many blocks hold so many sets and shingles."""
    return F.greatest(F.ceil(sets / BLOCK), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("long")


def block_of(id_, n):
    return F.pmod(F.xxhash64(id_), n)


def numbered(n):
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def similar_size(a, b, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def shared_keys(keyed: DataFrame, least: int = 2) -> DataFrame:
    """(id, shared) of keyed (id, key): for each set the keys that `least` sets or more show, as (size, key) with the number of sets.
    Rows are dealt by key once, for the count and for the join: the filter that a later join would add to one of them is in both."""
    dealt = keyed.select("id", "key").where("id is not null and key is not null").repartition("key")
    sizes = dealt.groupBy("key").agg(F.count("id").cast("int").alias("size")).where(F.col("size") >= least)
    return dealt.join(sizes, "key").groupBy("id").agg(F.collect_list(F.struct("size", "key")).alias("shared"))


def pruned(shared: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, n, class, firm, need, met, keys, rare) of sets that share as many parts of a class as they need for a link: keys are the
    shared ones of such classes, rare those by which they are sought. Keys have one order, by how many sets show them; two sets that
    need k common ones or more have the first of these before the last k - 1 of either, so these are left out of rare."""
    per = lambda f: F.flatten(F.transform("need", lambda k, i: f(F.filter("shared", lambda s: F.pmod(s["key"].bitwiseAND(F.lit(7)) - F.col("class") - i, F.lit(8)) == 0), k)))
    enough = lambda own, k: F.when(F.size(own) >= k, own).otherwise(F.slice(own, 1, 0))
    rows = shared.join(sets.select("id", "n", "class", "firm", "need"), "id").withColumn("shared", F.array_sort("shared"))
    rows = rows.withColumn("kept", per(enough)).where(F.size("kept") > 0)
    first = lambda own, k: F.slice(own, 1, F.greatest(F.size(own) - k + 1, F.lit(0)))
    rows = rows.withColumn("rare", per(first))
    met = F.aggregate("kept", F.lit(0).cast("long"), lambda a, s: a + s["size"])
    return rows.select("id", "n", "class", "firm", "need", met.alias("met"), F.col("kept.key").alias("keys"), F.col("rare.key").alias("rare"))


def hubs_of(members: DataFrame) -> DataFrame:
    """(key, hub, hub_n): the set of a part that meets most others over all its parts, the least of equals, so the copies of one
    text have nearly everywhere the same hub."""
    return members.groupBy("key").agg(F.max(F.struct("met", (-F.col("id")).alias("minus"), "n")).alias("h")).select("key", (-F.col("h.minus")).alias("hub"), F.col("h.n").alias("hub_n"))


def likely_pairs(members: DataFrame, hubs: DataFrame, owned: DataFrame, percent: int) -> DataFrame:
    """(hub, id, n) of sets of like size that share enough parts to link: of all parts for the class of the larger no more
    differ than shingles may, and the sets show all that agree but those that are poor in both."""
    near = members.join(hubs, "key").where((F.col("id") != F.col("hub")) & similar_size(F.col("n"), F.col("hub_n"), percent)).select("hub", "id").distinct()
    side = lambda c, x: owned.select(F.col("id").alias(c), F.struct("n", "class", "firm", "keys").alias(x))
    both = near.join(side("hub", "a"), "hub").join(side("id", "b"), "id")
    larger = F.greatest("a.class", "b.class")
    firm = F.greatest(*(F.get(f"{x}.firm", larger - F.col(f"{x}.class")) for x in "ab"))
    apart = F.floor((F.col("a.n") + F.col("b.n")) * (100 - percent) / (100 + percent))
    return both.where(F.size(F.array_intersect("a.keys", "b.keys")) >= firm - apart).select("hub", "id", F.col("b.n").alias("n"))


def hub_units(pairs: DataFrame) -> DataFrame:
    """Units in which a hub probes the sets that it is paired with."""
    counts = pairs.groupBy("hub").agg(blocks(F.count(F.lit(1)), F.sum("n")).alias("blocks"))
    none = F.lit(None).cast("long").alias("root")
    targets = pairs.join(counts, "hub").select(F.xxhash64("hub", block_of("id", F.col("blocks"))).alias("unit"), F.lit(TARGET).alias("role"), "id", none)
    probes = counts.select("hub", numbered(F.col("blocks")).alias("block")).select(F.xxhash64("hub", "block").alias("unit"), F.lit(PROBE).alias("role"), F.col("hub").alias("id"), none)
    return targets.unionByName(probes)


def plans(rows: DataFrame) -> DataFrame:
    """(group, main, all_blocks, own_blocks, cost) of rows (group, id, n, root): the largest component, the blocks of all sets and
    of the strays, which are outside it, and how many sets travel."""
    sizes = rows.groupBy("group", "root").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles"))
    largest = sizes.groupBy("group").agg(F.max(F.struct("sets", "root", "shingles")).alias("m"), F.sum("sets").alias("sets"), F.sum("shingles").alias("shingles"))
    strays, every, own = F.col("sets") - F.col("m.sets"), F.col("all_blocks"), F.col("own_blocks")
    largest = largest.withColumn("all_blocks", blocks(F.col("sets"), F.col("shingles"))).withColumn("own_blocks", blocks(strays, F.col("shingles") - F.col("m.shingles")))
    cost = F.col("sets") * own + F.when(every * own > 1, strays * every).otherwise(0)
    return largest.select("group", F.col("m.root").alias("main"), "all_blocks", "own_blocks", cost.alias("cost"))


def open_units(members: DataFrame) -> DataFrame:
    """Units of the parts whose sets beside the hub, which has met them all, still are of several components, one of those with
    the same sets. What such parts hold together is a family, which meets as one where fewer sets travel so than part by part.
    In either, all that are outside the largest component probe all."""
    kept = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size"), F.min("id").alias("least"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(38,0)")).alias("y"))
    several = materialize(kept.where("lo < hi").groupBy("size", "x", "y").agg(F.min(F.struct("key", "least")).alias("k")).select("k.key", "k.least"), "open")
    rows = materialize(members.join(several, "key").select(F.col("key").alias("group"), "id", "n", "root", "least"), "open-members")
    families = connected_components(rows.select(F.col("id").alias("a"), F.col("least").alias("b")).distinct()).withColumnsRenamed({"node": "id", "root": "family"})
    rows = materialize(rows.drop("least").join(families, "id").select("group", "id", "n", "root", "family"), "open-families")
    whole = rows.select(F.col("family").alias("group"), "id", "n", "root").distinct()
    by_part, by_family = plans(rows), plans(whole)
    cost = by_part.join(rows.select("group", "family").distinct(), "group").groupBy("family").agg(F.sum("cost").alias("cost_by_part"))
    better = by_family.join(cost.withColumnRenamed("family", "group"), "group").where("cost <= cost_by_part").drop("cost_by_part")
    rest = rows.join(better.select(F.col("group").alias("family")), "family", "left_anti")
    together = whole.join(better.drop("cost"), "group").withColumn("whole", F.lit(True)).unionByName(rest.drop("family").join(by_part.drop("cost"), "group").withColumn("whole", F.lit(False)))
    planned = together.withColumn("stray", F.col("root") != F.col("main"))
    small = F.col("all_blocks") * F.col("own_blocks") == 1  # all in one unit, each set once
    unit = lambda own, every: F.xxhash64("group", "whole", own, every).alias("unit")
    targets = planned.withColumn("own", numbered(F.col("own_blocks")))
    targets = targets.select(unit(F.col("own"), block_of("id", F.col("all_blocks"))), F.when(small & F.col("stray"), BOTH).otherwise(TARGET).alias("role"), "id", "root")
    probes = planned.where(F.col("stray") & ~small).withColumn("every", numbered(F.col("all_blocks"))).select(unit(block_of("id", F.col("own_blocks")), F.col("every")), F.lit(PROBE).alias("role"), "id", "root")
    return materialize(targets.unionByName(probes), "units")


def candidate_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, x) of wanted, which has id and place: the shingles of each in rising order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [*text_sets(batch.column(1))]
            offsets = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64) if sets else [], pa.int64()))], names=["id", "x"])

    texts = docs.select(place(), "text").join(wanted, "place").dropDuplicates(["place"])
    return texts.select("id", "text").mapInArrow(run, "id long, x array<long>")


def similar_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark = docs.sparkSession
    with workspace(spark) as keep:
        return keep(materialize(_components(docs.select("doc_id", "text"), percent), "components"))


def _components(docs: DataFrame, percent: int) -> DataFrame:
    spark = docs.sparkSession
    drawn = materialize(sketches(docs, percent).withColumn("row", F.monotonically_increasing_id()), "sets")  # numbered once, when written
    rows = materialize(drawn.select("doc_id", "node", "n", "row"), "rows")
    firsts = rows.where("node is not null").groupBy("node").agg(F.min("row").alias("row"), F.min("doc_id").alias("lowest")).drop("node")
    full = materialize(drawn.drop("doc_id").join(firsts, "row").withColumnRenamed("row", "id"), "full")
    discard(drawn)
    sweep(spark)
    reps = materialize(full.drop("keys"), "representatives")
    once = materialize(pruned(shared_keys(full.select("id", F.explode("keys").alias("key"))), reps), "shared")
    discard(full)
    sweep(spark)
    owned = materialize(pruned(shared_keys(once.select("id", F.explode("keys").alias("key"))), reps), "candidates")  # others are gone, so fewer share
    discard(once)
    sweep(spark)
    sets = materialize(candidate_sets(docs, reps.join(owned.select("id"), "id").select("id", "place")), "candidate-sets")
    sweep(spark)
    members = owned.select("id", "n", "met", F.explode("rare").alias("key"))
    hubs = materialize(hubs_of(members), "hubs")
    pairs = materialize(likely_pairs(members, hubs, owned, percent), "hub-pairs")
    first = materialize(joined_blocks(hub_units(pairs), sets, percent), "hub-links")
    sweep(spark)
    roots = materialize(connected_components(first), "roots")
    rooted = owned.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", "n", F.coalesce("root", "id").alias("root"), F.explode("rare").alias("key"))
    beside = rooted.join(hubs.select("key", "hub"), "key").where("id <> hub").drop("hub")
    more = materialize(joined_blocks(open_units(beside), sets, percent), "links")
    sweep(spark)
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    between = more.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    over = connected_components(between).select(F.col("node").alias("root"), F.col("root").alias("over"))
    known = reps.select("id", "lowest").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    known = known.join(over, "root", "left").select("id", "lowest", F.coalesce("over", "root").alias("root"))
    least = known.groupBy("root").agg(F.min("lowest").alias("component_id"))
    classes = salted(known, least, "root").select("id", "component_id")
    nodes = reps.select("node", "id").join(classes, "id").select("node", "component_id")
    out = salted(rows, nodes, "node", by="row", how="left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
