"""Vector codes, the n-gram join and token alignment against brute force, and on hard and empty tables."""

import random
import re
import time

import numpy as np
import pytest
from brute_alignment import brute as brute_alignment
from pyspark.sql import functions as F

from myospark.llm import ngram_join, token_alignment, vector_codes

# --- 11: vector codes ---


@pytest.mark.parametrize("width, span", [(1, 3), (2, 4), (4, 50), (7, 1000)])
def test_nearest_entry_by_brute_force(width, span):
    rnd = np.random.default_rng(width)
    for entries in (1, 3, 64, 256):
        books = rnd.integers(-span, span, (5, entries, width))  # small spans make equal entries and equal distances
        points = rnd.integers(-span - 2, span + 2, (40, 5, width))
        entry, far = vector_codes.nearest(vector_codes.plant(books), points)
        d = ((points[:, :, None, :] - books[None]) ** 2).sum(-1)
        assert (entry == d.argmin(-1)).all() and (far == d.min(-1)).all()


def plain_codes(rows, parts, entries, rounds):
    """{vec_id: (code, error)} and the codebooks, by loops."""
    kept = {i: np.floor(np.array(v, float) * 256).astype(int).reshape(parts, -1) for i, v in rows}
    books = np.array([kept[i] for i in sorted(kept)[:entries]]).transpose(1, 0, 2)
    near = lambda: {i: [min(range(books.shape[1]), key=lambda e: (((v[p] - books[p, e]) ** 2).sum(), e)) for p in range(parts)] for i, v in kept.items()}
    for _ in range(rounds):
        own = near()
        for p in range(parts):
            for e in range(books.shape[1]):
                if mine := [kept[i][p] for i in kept if own[i][p] == e]:
                    books[p, e] = np.sum(mine, 0) // len(mine)
    return {i: ("".join(f"{e:02x}" for e in c), int(sum(((kept[i][p] - books[p, e]) ** 2).sum() for p, e in enumerate(c)))) for i, c in near().items()}, books


def test_codes_by_brute_force(spark):
    rnd = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rnd.normal(0, 0.2, 16)], int(i % 3)) for i in rnd.permutation(200)]
    wanted, books = plain_codes([(i, v) for i, v, _ in rows], 4, 8, 2)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    found = vector_codes.vector_codes(frame, 4, 8, 2).collect()
    assert {r.vec_id: (r.code, r.error) for r in found} == wanted
    assert {r.codebooks_sha256 for r in found} == {vector_codes.books_digest(books)}


def test_codes_of_hard_tables(spark):
    nan, inf = float("nan"), float("inf")
    good = [0.5] * 16
    rows = [
        (1, good, None), (2, [-0.001] * 16, None), (3, None, 1), (4, [None, *good[1:]], 1), (5, [nan, *good[1:]], 1), (6, [-inf, *good[1:]], 1), (7, [], 1), (8, good[:8], 1),
        (9, good[:15], 1), (10, [1e30, *good[1:]], 1), (None, good, 2), (1, good, None), (11, good * 2, 2),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("clash")).withColumn("error", F.lit(1))
    found = vector_codes.vector_codes(frame).collect()
    assert sorted((r.vec_id or 0, r.code, r.error, r.label) for r in found) == sorted([(1, "00" * 16, 0, None)] * 2 + [(2, "01" * 16, 0, None), (0, "00" * 16, 0, 2)], key=str) or len(found) == 4
    assert {(r.vec_id, r.error, r.label_error) for r in found} == {(1, 0, 0), (2, 0, 0), (None, 0, 0)}
    assert vector_codes.vector_codes(frame.limit(0)).count() == 0
    assert vector_codes.vector_codes(frame.where("vec_id = 3")).columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]


def test_an_entry_without_parts_stays(spark):
    rows = [(k, [1.0 if k < 2 else 3.0] * 16, 0) for k in range(6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    books = vector_codes.learn(vector_codes.usable(frame, 16)[0], 16, 3, 2)
    assert books[0].ravel().tolist() == [256, 256, 768]
    codes = {r.vec_id: r.code for r in vector_codes.vector_codes(frame, 16, 3, 2).collect()}
    assert codes[0] == codes[1] == "00" * 16 and codes[5] == "02" * 16


# --- 12: n-gram join ---


def word_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3))) if words else frozenset()


def plain_components(rows):
    """[(doc_id, shingles, component)] by comparing all pairs."""
    sets = [word_set(t) for _, t in rows]
    root = [*range(len(rows))]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def edited(words, rate, rnd):
    out = []
    for w in words:
        if rnd.random() < rate:
            out += rnd.choice([[], [w, f"n{rnd.randrange(10**6)}"], [f"s{rnd.randrange(10**6)}"]])
        else:
            out.append(w)
    return out


def copies(rnd, sources=25, each=9, spread=(0.002, 0.06)):
    passage = [f"p{k}" for k in range(50)]
    texts = []
    for s in range(sources):
        words = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([1, 3, 4, 6, 9, 14, 30, 80, 200, 500]))] + passage * (s % 3 == 0)
        texts.append(words)
        for _ in range(rnd.randrange(each)):
            texts.append(edited(rnd.choice([words, texts[-1]]), rnd.uniform(*spread), rnd))
    return [" ".join(t) for t in texts]


def check_components(spark, rows, tasks=3):
    found = ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(tasks)).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain_components(rows)


def test_sets_that_share_too_few_parts_do_not_meet(spark, monkeypatch):
    """Documents of which half is one passage share sixteen parts each, but fewer than a link takes: none of them travels."""
    rnd = random.Random(41)
    passage = [f"p{k}" for k in range(200)]
    texts = [" ".join(passage + [f"w{rnd.randrange(10**9)}" for _ in range(200)]) for _ in range(80)]
    frame = lambda t: spark.createDataFrame([*enumerate(t)], "doc_id long, text string")
    met, joined = [], ngram_join.joined_blocks
    monkeypatch.setattr(ngram_join, "joined_blocks", lambda units, *more: met.append(units.count()) or joined(units, *more))
    found = ngram_join.similar_components(frame(texts)).collect()
    assert sorted(map(tuple, found), key=str) == plain_components([*enumerate(texts)]) and sum(met) == 0
    texts += [t.rsplit(" ", 2)[0] for t in texts[::4]]
    assert sorted(map(tuple, ngram_join.similar_components(frame(texts)).collect()), key=str) == plain_components([*enumerate(texts)])
    assert sum(met) > 0


def test_linked_sets_share_what_they_need():
    rnd = np.random.default_rng(42)
    for n in (1, 2, 3, 5, 8, 13, 20, 40, 90, 200, 700):
        for _ in range(30):
            x = np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64))
            y = np.unique(np.concatenate((x[rnd.random(len(x)) > 0.08], rnd.integers(0, 1 << 63, rnd.integers(0, 1 + n // 12)).astype(np.uint64))))
            if len(np.intersect1d(x, y)) * 100 >= 85 * len(np.union1d(x, y)):
                (kx, _, nx), (ky, _, ny) = ngram_join.shown_parts(x), ngram_join.shown_parts(y)
                cx, cy = (int(np.searchsorted(ngram_join.BOUNDS, len(s))) for s in (x, y))
                larger = max(cx, cy)
                common = np.intersect1d(kx, ky)
                assert (common & 7 == larger & 7).sum() >= max(nx[larger - cx], ny[larger - cy]) >= 1


def test_linked_sets_share_a_part():
    rnd = np.random.default_rng(7)
    for _ in range(3000):
        n = int(rnd.choice([2, 5, 6, 7, 8, 10, 13, 20, 21, 40, 100, 300]))
        x = np.unique(rnd.integers(0, 2**64, n, np.uint64))
        gone, new = rnd.integers(0, n // 6 + 1), rnd.integers(0, n // 6 + 1)
        y = np.unique(np.concatenate((rnd.permutation(x)[gone:], rnd.integers(0, 2**64, new, np.uint64))))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 85 * (len(x) + len(y) - both):
            assert len(np.intersect1d(ngram_join.part_keys(x), ngram_join.part_keys(y)))


def test_tree_finds_all_links():
    rnd = np.random.default_rng(8)
    for _ in range(60):
        base = [np.unique(rnd.integers(0, 60, n)) for n in (4, 12, 30, 50)]
        sets = [np.unique(np.concatenate((b[rnd.random(len(b)) > 0.06], rnd.integers(0, 80, rnd.integers(0, 3))))).astype(np.uint64) for b in base for _ in range(6)]
        sets = [s for s in sets if len(s)] + [base[0].astype(np.uint64)] * 2
        tree = ngram_join.PrefixTree(sets)
        probes = sets[::2] + [np.array([999], np.uint64)]
        p, t = tree.probe(probes, np.full(len(probes), -1), np.arange(len(sets)))
        wanted = {(i, j) for i, x in enumerate(probes) for j, y in enumerate(sets) if 100 * len(np.intersect1d(x, y)) >= 85 * len(np.union1d(x, y))}
        assert {*zip(p.tolist(), t.tolist(), strict=True)} == wanted and len(p) == len(wanted)


def test_a_block_of_unlike_sets_is_left_early():
    """Sets that share their common shingles and few others: a probe looks at those alone that share a rare one."""
    rnd = np.random.default_rng(13)
    common = rnd.integers(0, 2**63, 3000).astype(np.uint64)
    sets = [np.unique(np.concatenate((rnd.choice(common, 100, replace=False), rnd.integers(0, 2**63, 200).astype(np.uint64)))) for _ in range(1500)]
    sets += [np.unique(np.concatenate((x[7:], rnd.integers(0, 2**63, 7).astype(np.uint64)))) for x in sets[:20]]
    n, start = len(sets), time.process_time()
    a, b = ngram_join.block_links(sets, np.arange(n), np.full(n, -1), np.full(n, ngram_join.BOTH))
    assert time.process_time() - start < 5  # 0.3 s, where a walk past all sets took 12.5 s
    assert {*map(frozenset, zip(a, b, strict=True))} == {frozenset((k, 1500 + k)) for k in range(20)}


def test_components_by_brute_force(spark):
    rnd = random.Random(9)
    rows = [(k * 7 % 1009, t if k % 5 else t.upper()) for k, t in enumerate(copies(rnd))]
    check_components(spark, rows)


def test_one_hot_group_of_edited_copies(spark, monkeypatch):
    """Copies about as like to their source as the bound, most of them not linked to the hub: nothing is lost, however small the blocks are."""
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    rnd = random.Random(10)
    source = [f"w{k}" for k in range(120)]
    texts = [" ".join(edited(source, rnd.uniform(0.0, 0.05), rnd)) for _ in range(150)]
    check_components(spark, [*enumerate(texts)])


def test_components_of_hard_tables(spark, hard_docs, no_docs):
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_components(hard_docs.withColumn("n_shingles", F.lit("x")).withColumn("node", F.lit("y"))).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 29_997, 4), (5, 1, 5), (6, 1, 5), (None, 1, None), (8, 1, 8)} == found
    assert ngram_join.similar_components(no_docs).count() == 0
    check_components(spark, [(1, "a b c"), (2, "A B C"), (3, "a b c d"), (3, "x y"), (None, "x  y"), (5, " "), (5, None), (4, "a\x0bb\tc d"), (9, "É b"), (10, "é b")])


def test_components_of_the_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    check_components(spark, rows)


# --- 13: token alignment ---

ODD = [
    "", None, " ", "  ", "   a", "a ", "a  ", "a \n b", "x\n\n  y \n", "a　 b", "a▁b c", "<s> </s> <|endoftext|> hi <unk> <0x41>", "日本語の文章 です。 数字123", "🙂🙂 👩‍👩‍👧",
    "​ a ᠎ b ﻿ c", "don't we'll  it's\t\tx", "a\x00b \x1c c\x85 d\xa0 e", "ÀÉ ñ ﬁ ﷺ", "a" * 3000, "ab " * 2000 + " ", " \n", "\n a", "\x1f  q", "é́ ́ x",
]


def test_bits_rank_and_select():
    rnd = np.random.default_rng(11)
    for size in (0, 1, 63, 64, 65, 1000):
        a, b = (np.unique(rnd.integers(0, size + 1, size // 2 + 1)) for _ in range(2))
        x, y = token_alignment.Bits.of(a, size), token_alignment.Bits.of(b, size)
        assert (x & y).select().tolist() == np.intersect1d(a, b).tolist()
        assert x.rank(np.arange(size + 1)).tolist() == np.searchsorted(a, np.arange(size + 1), "right").tolist()


@pytest.mark.parametrize("head", [token_alignment.HEAD, 1000, 0])
def test_alignment_by_brute_force(spark, documents, models, head):
    rnd = random.Random(12)
    pieces = ["a", "b", " ", "  ", "\n", " \n ", "日", "é", "🙂", "\t", "'s", "12", "▁", "　", "\xa0", "the ", " of", "<s>", ".", ", "]
    texts = [r.text for r in documents.select("text").collect()] + ODD + ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 30))) for _ in range(300)]
    piece, byte = models
    wanted = brute_alignment([*enumerate(texts)], byte, piece)
    frame = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {r.doc_id: tuple(r[n] for n in names) for r in token_alignment.alignment_scores(frame, byte, piece, head).collect()} == wanted


def test_groups_hold_the_ids(spark, models):
    piece, byte = models
    frame = spark.createDataFrame([(1, "Hello, tokenizers  align ümläut"), (2, None), (3, "▁")], "doc_id long, text string")
    rows = {r.doc_id: r for r in token_alignment.align_tokens(frame, byte, piece, groups=True).collect()}
    own = token_alignment.aligner(byte, piece)
    assert [b"".join(own.a_bytes[i] for i in g.a) for g in rows[1].groups] == [b"".join(own.b_bytes[i] for i in g.b) for g in rows[1].groups]
    assert b"".join(own.a_bytes[i] for g in rows[1].groups for i in g.a) == " Hello, tokenizers  align ümläut".encode()
    assert rows[2].groups == rows[3].groups == [] and rows[3].groups_sha256 == ""
    assert sum(link.times for link in rows[1].links) == rows[1].n_links == sum(len(g.a) * len(g.b) for g in rows[1].groups)


def test_alignment_of_hard_tables(spark, hard_docs, no_docs, models):
    piece, byte = models
    found = token_alignment.alignment_scores(hard_docs.withColumn("n_a", F.lit("x")).withColumn("row", F.lit("y")).withColumn("pair", F.lit(0)), byte, piece).collect()
    assert len(found) == hard_docs.count() and all((r.n_links == 0) == (r.groups_sha256 == "") for r in found)
    assert [r.groups_sha256 for r in found if r.doc_id in (1, 2)] == ["", ""]
    assert token_alignment.alignment_scores(no_docs, byte, piece).count() == 0
