"""Each operator against brute force, and on hard and empty tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from oracle import same
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from myospark.llm import batches, decontaminate, near_dedup, personal_data, quality_classifier, quality_rules, queries, secret_scan, sentencepieces, sharding, spans, token_files, warc


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(name, spark, sf_dir):
    same(queries.QUERIES[name], queries.ORACLE_SQL[name], spark, sf_dir)


# --- 1: quality rules ---


def measured(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = collections.Counter(zip(words, words[1:], words[2:]))
    inside = {k + i for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for i in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_measures_by_brute_force(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(["a ", "b ", "c ", "a b c ", "é", "#", "\n", " \n", "\x0b", "日"]) for _ in range(rnd.randint(0, 60))) for _ in range(150)] + [None, "", "\n\n"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.with_measures(frame).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measured(r.text), repr(r.text)


def test_binomial_tail_is_exact(spark):
    from math import comb

    cases = [(0, 10), (3, 10), (5, 400), (1, 5000), (40, 3000)]
    rows = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.02).alias("p")).collect()
    for r in rows:
        exact = sum(comb(r.n, j) * 0.02**j * 0.98 ** (r.n - j) for j in range(r.k + 1))
        assert np.isclose(r.p, 1.0 if r.k > 0.02 * r.n else exact, rtol=1e-9)


def test_cutoffs_are_certified_or_absent(spark):
    good = " ".join(f"w{k}" for k in range(60))
    docs = [(k, good + " #" * 40 if k % 2 else good + f" u{k}", "en" if k < 2000 else "xx") for k in range(2100)]
    labels = spark.createDataFrame([(k, 0 if k % 2 else 1) for k in range(2100)] + [(9999, 1), (5, None)], "doc_id long, quality int")
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    kept = quality_rules.apply_rules(frame, labels).select("doc_id", "kept").collect()
    assert all(r.kept == (r.doc_id % 2 == 0 or r.doc_id >= 2000) for r in kept)  # the small stratum certifies nothing
    noisy = spark.createDataFrame([(k, 1) for k in range(2100)], "doc_id long, quality int")
    assert all(r.kept for r in quality_rules.apply_rules(frame, noisy).collect())


def test_rules_on_hard_tables(spark, hard_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (None, 0), (4, None)], "doc_id long, quality int")
    found = quality_rules.apply_rules(hard_docs, labels)
    assert found.count() == hard_docs.count() and found.where("n_words = 0 and not base_failed").count() == 0
    clashing = hard_docs.withColumn("n_words", F.lit("x")).withColumn("kept", F.lit("y"))
    kept = quality_rules.kept_documents(clashing, labels)
    assert kept.columns == clashing.columns and kept.where("n_words <> 'x' or kept <> 'y'").count() == 0 and kept.count() == 1
    assert quality_rules.apply_rules(no_docs, labels).count() == 0


# --- 2: sharding ---


def test_shards_are_even_and_gapless(spark, documents, hard_docs, no_docs):
    skewed = documents.select("doc_id", "text").unionByName(spark.range(1000, 1400).select(F.col("id").alias("doc_id"), F.lit("copy " * 200).alias("text")))
    found = sharding.assign_shards(skewed, ranges=40).toPandas()
    assert len(found) == skewed.count()
    sizes = found.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= 2 * found["size"].max()
    for _, part in found.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    text = {r.doc_id: r.text for r in skewed.collect()}
    assert all(zlib.crc32(text[r.doc_id].encode()) == r.text_crc32 and r.size == len(text[r.doc_id].encode()) + 1 for r in found.itertuples())
    assert sorted(sharding.assign_shards(hard_docs).toPandas().groupby("shard").slot.apply(lambda s: sorted(s) == list(range(len(s))))) .count(False) == 0
    assert sharding.assign_shards(no_docs).count() == 0


def test_overfull_ranges_are_cut(spark):
    rows = sharding.keyed(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text")))
    total = rows.agg(F.sum("size")).first()[0]
    splitters, stats = sharding.split(rows, total, 16)
    assert stats.agg(F.max("bytes")).first()[0] < 3 * total / 16 and len(splitters) >= 15


def test_whole_records_by_shard(spark, documents, tmp_path):
    sharding.write_shards(documents, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == documents.count() and back.select("shard").distinct().count() == 4


def test_repeated_rows_are_written_once_each(spark, tmp_path):
    rows = [(1, "same", 9, "x"), (1, "same", 9, "x"), (1, "same", 8, "y"), (1, "other", 7, "z"), (None, None, 6, None), (None, None, 5, None), (2, "", 4, "w")]
    sharding.write_shards(spark.createDataFrame(rows, "doc_id long, text string, slot long, _size string"), str(tmp_path / "out"), shards=3, pieces=2)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(((r.doc_id, r.text, r["_size"]) for r in back), key=str) == sorted(((d, t, x) for d, t, _, x in rows), key=str)
    assert all(sorted(r.slot for r in back if r.shard == k) == list(range(sum(r.shard == k for r in back))) for k in range(3))


# --- 3: quality classifier ---


def test_classifier_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op3_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(found) > 50 and (found.predicted == found.quality).mean() >= 0.95
    assert found.score.between(0, 1).all()


def test_classifier_never_sees_held_out_labels(spark, documents):
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int")
    turned = labels.withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_classifier.model_of(documents, x) for x in (labels, turned))
    assert np.array_equal(a[0], b[0]) and a[1:] == b[1:]


def test_classifier_on_hard_tables(spark, hard_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    scored = quality_classifier.score_documents(hard_docs, quality_classifier.model_of(hard_docs, none)).collect()
    assert len(scored) == hard_docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert quality_classifier.score_documents(no_docs, quality_classifier.model_of(no_docs, none)).count() == 0


# --- 4: WARC ---


PAGES = [(1, "http://a/1", "x" * 2000), (2, "http://a/2", "x" * 2000), (3, None, "x" * 2000), (4, "http://b\r\n/", "short"), (5, "u", "short"), (6, "u", None), (6, "u", None), (7, "é" * 3000, "é" * 1500)]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path)
    full = {r.page_id: r for r in warc.read_archive(spark, path).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in full.items()} == {1: ("revisit", 3), 2: ("revisit", 3), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None)}
    assert full[7].payload.decode() == "é" * 1500 and full[7].target_uri == "é" * 3000 and full[1].payload is None and full[1].payload_bytes == 2000
    assert full[3].target_uri is None and full[4].target_uri == "http://b%0D%0A/" and full[6].payload == b""
    heads = warc.read_archive(spark, path, "record_type string, page_id long")
    assert heads.where("record_type = 'revisit'").count() == 2
    assert sorted(r.page_id for r in heads.where("page_id in (4, 7) and record_type = 'response'").collect()) == [4, 7]
    plan = heads.where("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "revisit" not in plan  # nothing is left for Spark to filter but that the type is known


def test_warc_skips_what_is_not_wanted(spark):
    import io

    rows = [{"record_type": "response", "page_id": k, "target_uri": "u" * 9000, "payload_digest": "d", "payload_bytes": 100_000, "payload": bytes(random.Random(k).randbytes(100_000))} for k in range(3)]
    data = b"".join(warc.member(warc.record(r)) for r in rows)

    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            Counted.taken += len(out)
            return out

    assert [r["page_id"] for r in warc.read_records(Counted(data), {"page_id": {1}}, True)] == [1]
    assert Counted.taken < len(data) / 2
    import gzip

    assert gzip.decompress(data).count(b"WARC/1.1") >= 3


def test_appending_keeps_and_overwriting_replaces(spark, tmp_path):
    pages, path = spark.createDataFrame(PAGES, "page_id long, url string, html string"), str(tmp_path / "archive")
    warc.write_archive(pages.where("page_id < 3"), path)
    warc.write_archive(pages.where("page_id = 4"), path)
    assert sorted(r.page_id for r in warc.read_archive(spark, path).collect()) == [1, 2, 4]
    warc.write_archive(pages.where("page_id = 7"), path, "overwrite")
    assert [r.page_id for r in warc.read_archive(spark, path).collect()] == [7]
    assert len(list((tmp_path / "archive").glob("part-*"))) == 1


def test_a_hot_payload_is_spread(spark):
    pages = spark.range(4000).selectExpr("id as page_id", "concat('u', id) as url", "case when id % 4 < 3 then repeat('x', 2000) else concat(repeat('y', 1500), id) end as html", "1 as salt", "2 as keeper")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = warc.with_revisits(pages).withColumn("part", F.spark_partition_id())
        sizes = [r["count"] for r in found.groupBy("part").count().collect()]
        kinds = {r.record_type: r["count"] for r in found.groupBy("record_type").count().collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(sizes) < 2 * 4000 / len(sizes) and len(sizes) > 1 and kinds == {"response": 1001, "revisit": 2999}


def test_warc_of_nothing(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- 5: decontamination ---


ITEM = "We know that Alice bought 12 apples and then sold 7 kg of pears to Bob for 30 dollars in the market today."
OTHER = "We know that Carol bought 15 apples and then sold 9 kg of pears to Dave for 45 dollars in the market today."
UNLIKE = "Then Carol gave her 8 coins and soon after that we saw Erin lose her 8 coins again in the market."
TWICE = "Then Alice gave her 5 coins and soon after that we saw Alice lose her 5 coins again in the market."


def test_reparameterised_items(spark):
    docs = [(1, ITEM), (2, OTHER), (3, "so " * 30 + ITEM.upper()), (4, None), (5, ""), (6, "nothing of this kind 12 apples"), (7, TWICE.replace("Alice", "Carol").replace("5", "8")), (8, UNLIKE), (8, UNLIKE)]
    bench = [(9, ITEM), (8, None), (7, "one two three four five"), (6, "tiny one"), (5, TWICE), (5, TWICE)]
    found = decontaminate.contaminated_pairs(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    kinds = {(r.doc_id, r.item_id): r.kind for r in found}
    assert kinds[1, 9] == "exact" and kinds[2, 9] == "reparameterised" and kinds[7, 5] == "reparameterised"
    assert (8, 5) not in kinds and not {4, 5, 6} & {d for d, _ in kinds}


def test_benchmark_passages_by_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    wanted = {(d.doc_id, b.item_id) for d in docs for b in bench if b.text.lower() in (d.text or "").lower()}
    assert {(r.doc_id, r.item_id) for r in queries.op5_decontaminate(spark, sf).collect()} == wanted


def test_items_of_placeholders_and_changed_words_are_found(spark):
    sums, title = "What is 12 + 30 - 7 * 4 / 2", "The Quick Brown Fox Jumps Over Lazy Dogs"
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    few = "please add up all of these numbers now " + " ".join(str(k) for k in range(100, 140))
    bench = [(1, sums), (2, title), (3, long), (4, few)]
    docs = [(1, f"Try this. {sums}"), (2, f"Read:\n{title}"), (3, long.replace("eta theta", "eta changed")), (4, "please add up all of these numbers now or never"), (5, f"so {few}")]
    found = decontaminate.contaminated_pairs(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1), (2, 2), (3, 3), (5, 4)}


def test_no_item_is_too_short_or_too_full_of_numbers(spark):
    bench = [(1, "12 + 5 * 3 - 7 / 2 + 9"), (2, "Who wrote Hamlet?"), (3, "yes"), (4, "7 times 8")]
    docs = [(1, "so 12 + 5 * 3 - 7 / 2 + 9 is"), (2, "ask: who wrote hamlet? yes"), (3, "who wrote 12 + 5 letters"), (4, "what is 7 times 8"), (5, "what is 7 times 9")]
    found = decontaminate.contaminated_pairs(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1), (2, 2), (4, 4)}


def test_decontamination_on_hard_tables(spark, hard_docs, no_docs):
    bench = spark.createDataFrame([(1, "word0 word1 word2 word3 word4 word5 word6 word7 word8"), (None, None)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contaminated_pairs(hard_docs, bench).collect()} == {4}
    assert decontaminate.clean_documents(hard_docs, bench).count() == hard_docs.count() - 1
    assert decontaminate.contaminated_pairs(no_docs, bench).count() == 0
    assert decontaminate.contaminated_pairs(hard_docs, bench.limit(0)).count() == 0


# --- 6: secrets ---


def plain_secrets(text):
    out = []
    for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16])


def test_base_secrets_by_brute_force():
    rnd = random.Random(2)
    parts = ["password", "Token", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "AKIAAKIA", "ABC123", "deadbeef", "0123456789abcdef", "x", "\n", "ſecret", "toKen", "é", "abcdefghijkl", "-"]
    for _ in range(20_000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert sorted(secret_scan.base_spans(text)) == plain_secrets(text), text


def test_markov_tells_random_from_written(spark, documents):
    model = secret_scan.train(documents)
    for value in ("ghp_16C7e42F292c6912E7710c838347Ae178B4a", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzzKEY9", "XK4PZ7QWMN2V8RT5BHGJ"):
        assert model.is_secret(value)
    for value in ("thanonontionertionhethere", "http_example_com_fr_825", "configuration_file_name_2021", "ThisIsAnOrdinaryIdentifier12"):
        assert not model.is_secret(value)
    text = "see XK4PZ7QWMN2V8RT5BHGJ and token = abcdefghijklmnop here"
    found = secret_scan.spans_of(text, model)
    assert {(text[s:e], k) for s, _, e, k in found} == {("XK4PZ7QWMN2V8RT5BHGJ", "markov"), ("token = abcdefghijklmnop", "assign")}
    assert spans.redacted(text, spans.in_order(found), "<secret>") == "see <secret> and <secret> here"
    assert spans.redacted("abcdef", [{"start": 1, "end": 4}, {"start": 2, "end": 5}, {"start": 5, "end": 6}], "-") == "a--"


def test_recall_and_precision_of_markov_spans(spark, documents):
    """Random tokens that no pattern knows, and ordinary identifiers, hidden in documents."""
    model, rnd = secret_scan.train(documents), random.Random(12)
    words = sorted({w for r in documents.limit(200).collect() for w in re.findall(r"[A-Za-z]{3,}", r.text or "")})
    drawn = ["".join(rnd.choices(secret_scan.ALPHABETS[k % 3 + 3], k=rnd.randint(24, 40))) for k in range(600)]
    written = [v for v in secret_scan.identifiers(rnd.choices(words, k=1800), rnd) if len(v) >= 20 and secret_scan.CANDIDATE.fullmatch(v)]
    found = lambda values: sum(any(k == "markov" for *_, k in secret_scan.spans_of(f"see {v} there", model)) for v in values)
    hits, wrong = found(drawn), found(written)
    print(f"recall {hits / len(drawn):.3f}, false {wrong / len(written):.4f} of {len(written)}")
    assert hits / len(drawn) >= 0.95 and wrong / len(written) <= 0.01


def test_query_of_secrets_by_brute_force(spark, sf_dir, documents):
    text = {r.doc_id: r.text or "" for r in documents.collect()}
    for r in queries.op6_secret_scan(spark, sf_dir).collect():
        base = [f"{k}:{s}:{e}" for s, _, e, k in plain_secrets(text[r.doc_id])]
        assert r.base_sha256 == sha(",".join(base)) and [r.n_assign, r.n_access, r.n_hex] == [sum(x.startswith(k) for x in base) for k in secret_scan.KINDS]
        assert set(base) <= set(r.spans.split(","))


def test_training_reads_whole_texts(spark, documents):
    late = " ".join(["plain"] * 80 + ["afterwards"])
    assert "afterwards" in {r.value for r in secret_scan.labelled_sample(spark.createDataFrame([(1, late)], "doc_id long, text string")).where("secret = 0").collect()}
    rnd = random.Random(5)
    odd = " ".join("".join(rnd.choices("XQZJKVxqzjkv", k=24)) for _ in range(12))
    docs = documents.select("doc_id", "text")
    assert secret_scan.train(docs.union(spark.createDataFrame([(-1, odd)], docs.schema))).bound <= secret_scan.train(docs).bound + 0.05


def test_secrets_on_hard_tables(spark, hard_docs, no_docs):
    found = secret_scan.find_secrets(hard_docs.withColumn("spans", F.lit(1)), secret_scan.train(hard_docs))
    assert found.count() == hard_docs.count() and found.columns == [*hard_docs.columns, "spans"]
    assert secret_scan.find_secrets(no_docs, secret_scan.train(no_docs)).count() == 0
    again = secret_scan.redact_documents(hard_docs, None)
    assert again.columns == hard_docs.columns and again.count() == hard_docs.count()
    row = spans.digest(found, secret_scan.KINDS).where("doc_id = 1").first()
    assert (row.n_assign, row.n_access, row.n_hex, row.base_sha256, row.spans) == (0, 0, 0, sha(""), "")


# --- 7: SentencePiece ---


def test_ids_are_the_librarys(models):
    vocab = sentencepieces.vocabulary(models[0])
    rnd = random.Random(3)
    texts = ["", " ", "   ", "a▁b▁▁c", "<s> </s> <0x41>", "日本 😀 \x00 a", "x" * 500, "ab" * 400, " " * 37 + "q" + " " * 19] + ["".join(rnd.choice(" ▁ aethnoribx.,!?'0159é漢😀\n\t") for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    for t in texts:
        ids = vocab.library.encode(t)
        assert sentencepieces.encode_ids(vocab, t) == ids, repr(t)
    encoder = sentencepieces.Encoder(vocab)
    encoder.units.most = encoder.parts.most = 5
    for t in texts[-300:]:
        joined = encoder.encode(t)
        assert encoder.numbers(joined) == vocab.library.encode(t) and set(sentencepieces.units(t)) - {""} <= set(encoder.units) | set(encoder.units.old) | {""}
        encoder.settle(True)


def test_whole_units_are_compared(models):
    vocab = sentencepieces.vocabulary(models[0])
    encoder = sentencepieces.Encoder(vocab)
    encoder.encode("abc漢字 12-34 naïve日本\nnext   line")
    assert set(encoder.fresh) >= {"abc漢字", "12-34", "naïve日本\nnext", "▁▁line"}
    encoder.settle(True)
    for wrong in ("the", "▁▁line", "naïve日本\nnext"):
        with pytest.raises(ValueError):
            vocab.checked({wrong: [1, 2, 3]})


def test_pieces_of_a_table(spark, documents, hard_docs, no_docs, models):
    library = sentencepiece.SentencePieceProcessor(model_file=models[0])
    for frame in (documents, hard_docs):
        found = sentencepieces.encode_text(frame, models[0], digest=True).collect()
        assert len(found) == frame.count()
        for r in found:
            ids = library.encode(r.text or "")
            assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == sha(",".join(map(str, ids))) and r.decoded_sha256 == sha(library.decode(ids) if ids else "")
    assert sentencepieces.encode_text(no_docs, models[0]).count() == 0
    back = sentencepieces.decode_ids(sentencepieces.encode_text(documents.withColumn("ids", F.lit(0)), models[0]), models[0])
    assert back.where("decoded <> text").count() == 0


# --- 8: personal data ---


def luhn(digits):
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain_personal(text):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    return sorted(out + [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15])


def test_base_personal_data_by_brute_force():
    rnd = random.Random(4)
    parts = ["a@b.co", "@", ".", "x", "_", "1", "12", "255", "256", "1.2.3.4", "000", "4111 1111 1111 1111", "+1", " (415) ", "555-0100", "-", " ", "é", "٣", "4111111111111"]
    for _ in range(20_000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9)))
        assert sorted(personal_data.base_spans(text)) == plain_personal(text), text
    assert personal_data.base_spans("1" * 20_000) == [] and personal_data.base_spans("a" * 20_000 + "@") == []


def test_contexts_discover_unseen_identifiers(spark, no_docs, hard_docs):
    known = [(k, f"Some words here. Phone: +1 (415) 555-01{k:02d} as stated in text {k}.") for k in range(12)]
    unseen = [(100, "Other words. Phone: 415-555-7788 as stated elsewhere."), (101, "the count was 415-555-7788x9 of units"), (102, "the count was 90210-44 of units")]
    found = {r.doc_id: r.spans for r in personal_data.find_personal_data(spark.createDataFrame(known + unseen, "doc_id long, text string")).collect()}
    assert [(s.kind, s.start) for s in found[100]] == [("context", 20)] and found[102] == []
    assert all([s.kind for s in found[k]] == ["phone"] for k in range(12))
    assert personal_data.find_personal_data(no_docs).count() == 0
    assert personal_data.find_personal_data(hard_docs).count() == hard_docs.count()


def test_recall_and_precision_of_contexts(spark):
    """A quarter of the identifiers in known contexts are spelled so that no pattern knows them; numbers stand elsewhere too."""
    rnd = random.Random(13)
    contexts = ["phone: {} or", "mobile {} (office)", "account {} holder", "reach us at {} today"]
    fill = lambda n: " ".join(f"w{rnd.randrange(400)}" for _ in range(n))
    number = lambda: "".join(rnd.choices("0123456789", k=4))
    docs, hidden, plain = [], {}, set()
    for k in range(400):
        value = f"+1 555 {number()[:3]} {number()}" if k % 4 else rnd.choice([f"{number()}-{number()}x{k}", f"415 {k:03d} {number()}", f"DE{k % 100:02d} {number()} {number()} {number()} 00"])
        before = fill(20) + " " + contexts[k // 4 % 4].split("{}")[0]
        docs.append((k, before + value + contexts[k // 4 % 4].split("{}")[1] + " " + fill(20)))
        if not k % 4:
            hidden[k] = (len(before), len(before) + len(value))
    for k in range(400, 600):
        docs.append((k, f"{fill(15)} total {number()}-{number()}x{k} units {fill(15)}"))
        plain.add(k)
    found = {r.doc_id: {(s.start, s.end) for s in r.spans if s.kind == "context"} for r in personal_data.find_personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    right = sum(place in found[k] for k, place in hidden.items())
    added = sum(map(len, found.values()))
    print(f"recall {right / len(hidden):.3f}, precision {right / max(1, added):.3f}")
    assert right / len(hidden) >= 0.9 and right / added >= 0.95 and not any(found[k] for k in plain)


def test_query_of_personal_data_by_brute_force(spark, sf_dir, documents):
    text = {r.doc_id: r.text or "" for r in documents.collect()}
    for r in queries.op8_personal_data(spark, sf_dir).collect():
        base = [f"{k}:{s}:{e}" for s, _, e, k in plain_personal(text[r.doc_id])]
        assert r.base_sha256 == sha(",".join(base)) and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in base) for k in personal_data.KINDS]
        assert set(base) <= set(r.spans.split(","))


def test_words_that_stand_elsewhere_prove_nothing(spark):
    seeds = [(k, f"mail{k} with p{k}@x.org zu{k}") for k in range(4)] + [(10 + k, f"x{k} +1 415 555 01{k:02d} er he{k}") for k in range(4)] + [(20 + k, f"see{k} <q{k}@x.org oh{k}") for k in range(4)]
    same = [(30 + k, f"contact at r{k}@x.org today") for k in range(4)]
    unseen = [(50, "some with 86420-97531 units"), (51, "some 97531-86420 er"), (52, "one <13579-24680 two"), (53, "contact at 24680-13579 today")]
    plain = [(100 + k, f"he came with a friend {k} er <b or at home or today") for k in range(20)]
    frame = spark.createDataFrame(seeds + same + unseen + plain, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in personal_data.find_personal_data(frame).collect()}
    assert [found[k] for k in (50, 51, 52)] == [[], [], []]
    assert [(s.kind, s.start, s.end) for s in found[53]] == [("context", 11, 22)]


def test_uses_by_brute_force(spark):
    texts = ["a b c", "A x c", "a", "", None, "<ab> a b c"]
    want = collections.Counter()
    for words in ((t or "").lower().split() for t in texts):
        ends = [personal_data.START, *words, personal_data.END] if words else []
        want.update(ends)
        want.update(f"{a} {b}" for a, b in zip(ends, ends[2:]))
        want.update(x for w in words for k in range(1, len(w)) for x in (f"{w[:k]}\t", f"\t{w[-k:]}"))
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    assert {r.context: r.total for r in personal_data.uses_of(frame, b"\xff" * (1 << personal_data.FILTER_BITS - 3), set(range(9)), set(range(9))).collect()} == want


# --- 9: token files ---


def test_levels_give_any_token():
    rnd = random.Random(5)
    for n in (0, 1, 511, 512, 513, 3000):
        ids = np.array([rnd.choice([0, 3, 255, 256, 65535, 65536, 1 << 31, (1 << 32) - 1]) for _ in range(n)], np.uint32)
        levels = token_files.Levels(token_files.pack(ids))
        assert (levels.ids() == ids).all() and [levels[i] for i in range(n)] == ids.tolist()
    with pytest.raises(IndexError):
        levels[n]


def test_one_id_reads_few_bytes(tmp_path):
    rnd = np.random.default_rng(3)
    ids = rnd.integers(0, 1 << 17, 300_000).astype(np.uint32)
    (tmp_path / "f").write_bytes(token_files.file_bytes([1, None], [100_000, 200_000], ids))

    class Counted:
        taken = 0

        def __init__(self, f):
            self.f, self.seek = f, f.seek

        def read(self, n):
            Counted.taken += n
            return self.f.read(n)

    with open(tmp_path / "f", "rb") as f:
        levels = token_files.levels_at(Counted(f))
        Counted.taken = 0
        for i in (0, 511, 512, 150_000, 299_999):
            assert levels[i] == ids[i]
        assert Counted.taken < 5 * 300


def test_parts_have_the_librarys_ids(models):
    library, own = Tokenizer.from_file(models[1]), token_files.ByteLevelEncoder(models[1])
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("  aethn'sibx.,!?²½0159é漢😀\n\t\x1c\x85#*%") for _ in range(rnd.randint(0, 40))) for _ in range(5000)] + ["don't we're I'll", "a<|endoftext|>b"]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_token_files_round_trip(spark, documents, hard_docs, no_docs, models):
    library = Tokenizer.from_file(models[1])
    for frame in (documents, hard_docs):
        out = token_files.shared_path(spark, "test-tokens")
        manifest = token_files.write_token_files(frame, models[1], out, partitions=3)
        got = token_files.read_token_files(manifest, ids_col=True).orderBy("start").collect()
        assert [r.doc_id for r in got] == sorted((r.doc_id for r in frame.collect()), key=lambda d: (d is not None, d or 0))
        texts = {r.doc_id: r.text or "" for r in frame.collect()}
        at = 0
        for r in got:
            ids = [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 0]
            assert r.ids == ids and r.start == at and r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
            at += len(ids)
        whole = [i for r in got for i in r.ids]
        asked = spark.createDataFrame([(0,), (len(whole) - 1,), (len(whole) // 2,), (len(whole),)], "position long")
        assert {r.position: r.id for r in token_files.tokens_at(manifest, asked, span=64).collect()} == {p: whole[p] for p in (0, len(whole) - 1, len(whole) // 2)}
    assert token_files.token_table(no_docs, models[1]).count() == 0


# --- 10: near-duplicates ---


def labelled(text):
    words, seen, out = (text or "").split(), collections.Counter(), []
    grams = [tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))] if words else []
    for g in grams:
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def plain_alignment(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    m = t[-1, -1]
    return m / (len(a) + len(b) - m) if a and b else 0.0


def test_alignment_by_dynamic_programming():
    rnd = random.Random(7)
    for _ in range(200):
        words = [rnd.choice("abcdefgh") + str(rnd.randint(0, 9)) for _ in range(rnd.randint(0, 60))]
        other = list(words)
        for _ in range(rnd.randint(0, 3)):
            k = rnd.randint(0, len(other))
            other[k : k + rnd.randint(0, 2)] = [rnd.choice("xyz")] * rnd.randint(0, 2)
        if rnd.random() < 0.2:
            other = other[len(other) // 2 :] + other[: len(other) // 2]
        a, b = " ".join(words), " ".join(other)
        wanted = plain_alignment(labelled(a), labelled(b))
        x, y = near_dedup.text_shingles(pa.array([a, b]))
        got = near_dedup.alignment(x, y)
        assert np.isclose(got, wanted) if wanted >= 0.8 else got == 0


def test_classes_by_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    sets = {r.doc_id: labelled(r.text) for r in rows}
    where = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    shared = collections.Counter((a, b) for ds in where.values() if len(ds) < 300 for i, b in enumerate(ds) for a in ds[:i])
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    text = {r.doc_id: r.text for r in rows}
    for (a, b), m in shared.items():
        if m / (len(sets[a]) + len(sets[b]) - m) >= 0.8 and plain_order(sets[a], sets[b]) >= 0.8:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    first = {}
    for d in sorted(text):  # exact copies, also of texts without a shingle
        if text[d] in first:
            x, y = sorted((find(first[text[d]]), find(d)))
            root[y] = x
        first.setdefault(text[d], d)
    found = near_dedup.near_duplicates(spark.createDataFrame(list(text.items()), "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in found.collect()} == {d: find(d) for d in sets}


def plain_order(a, b):
    """The alignment of two lists of distinct items, by increasing places."""
    from bisect import bisect_left

    place = {x: k for k, x in enumerate(b)}
    tails = []
    for p in (place[x] for x in a if x in place):
        k = bisect_left(tails, p)
        tails[k : k + 1] = [p]
    return len(tails) / (len(a) + len(b) - len(tails))


def test_open_pairs_meet_without_their_hub(spark):
    """A bucket whose hub is like none of the others: the others still find each other."""
    shared = spark.createDataFrame([(10 * p + 1, i, 100, p, 3) for p in (0, 1, 4) for i in (1, 2, 3)] + [(99, 1, 100, 30, 2), (99, 4, 100, 30, 2)], "sig long, id long, n long, place int, size long")
    none, roots = (spark.createDataFrame(r, "node long, root long") for r in ([], [(1, 1), (2, 1)]))
    for pairs in (near_dedup.narrow_pairs, near_dedup.all_pairs):
        found = {(min(r), max(r)) for r in pairs(near_dedup.open_buckets(shared, none), 0.8).collect()}
        assert found - {(1, 4)} == {(1, 2), (1, 3), (2, 3)}
        found = {(min(r), max(r)) for r in pairs(near_dedup.open_buckets(shared, roots), 0.8).collect()}
        assert found - {(1, 4)} == {(1, 3), (2, 3)}


def edited_copies(rnd, n, words=200, least=0.0, most=0.11):
    """A text and n copies of it, each with a share of its words replaced; pairs of these copies are edited once more."""
    base, out = [f"w{k}" for k in range(words)], []
    for k in range(n):
        if out and k % 5 == 0:
            own = list(rnd.choice(out))
            places = rnd.sample(range(words), 2)
        else:
            own = list(base)
            places = rnd.sample(range(words), int(words * rnd.uniform(least, most)))
        for p in places:
            own[p] = f"e{rnd.randrange(1000)}"
        out.append(own)
    return [" ".join(base), *(" ".join(w) for w in out)]


def test_recall_on_a_large_group_of_edited_copies(spark):
    """500 copies, 0.35 to 0.98 like their source: the classes of all pairs by brute force against those found."""
    texts = dict(enumerate(edited_copies(random.Random(14), 500)))
    x = dict(enumerate(near_dedup.text_shingles(pa.array(list(texts.values())))))
    links = [(a, b) for b in x for a in range(b) if near_dedup.alignment(x[a], x[b]) > 0]
    root = {d: d for d in x}
    for a, b in links:
        a, b = root[a], root[b]
        root = {d: min(a, b) if r in (a, b) else r for d, r in root.items()} if a != b else root
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(frame).collect()}
    kept = sum(found[a] == found[b] for a, b in links)
    print(f"{len(links)} links, {kept / len(links):.4f} kept; {sum(found[d] == root[d] for d in x)} of {len(x)} classes; {len(set(root.values()))} classes")
    assert kept / len(links) >= 0.99 and sum(found[d] == root[d] for d in x) >= 0.98 * len(x)
    assert all(root[d] == root[found[d]] for d in x)  # nothing is joined that no links join


def test_edits_of_a_hub_find_each_other(spark):
    rnd = random.Random(8)
    base = [f"w{k}" for k in range(120)]

    def edited(places):
        words = list(base)
        for p in places:
            words[p] = f"e{p}"
        return " ".join(words)

    # 2 and 3 are too far from the base but share most edits; 4 is as far and shares none
    texts = {1: " ".join(base), 2: edited([10, 30, 50, 70]), 3: edited([10, 30, 50, 71]), 4: edited([20, 40, 60, 80, 100])}
    texts |= {10 + k: edited([rnd.randrange(120)]) for k in range(30)}
    classes = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    x = {d: next(near_dedup.text_shingles(pa.array([t]))) for d, t in texts.items()}
    assert near_dedup.alignment(x[1], x[2]) == 0 and near_dedup.alignment(x[2], x[3]) > 0
    assert classes[2] == classes[3] == 2 and classes[4] == 4 and all(classes[d] == 1 for d in (1, *range(10, 40)))


@pytest.mark.parametrize("block", [512, 40])
def test_no_link_is_lost_around_a_common_passage(spark, monkeypatch, block):
    """All texts are 0.78 alike, which crowds their buckets; pairs of them are 0.81 alike. No text is near its buckets' hubs."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    passage, texts = [f"w{k}" for k in range(350)], {}
    for d in range(300):
        texts[d] = " ".join([*passage, *(f"o{d // 2}x{j}" for j in range(7)), *(f"p{d}x{j}" for j in range(41))])
    x = {d: next(near_dedup.text_shingles(pa.array([t]))) for d, t in texts.items()}
    assert all((near_dedup.alignment(x[a], x[b]) > 0) == (a // 2 == b // 2) for a in range(0, 300, 10) for b in x)
    found = near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in found} == {d: d // 2 * 2 for d in texts}


def test_blocks_link_what_all_pairs_link():
    """Probes and data of one place against brute force, with components that are joined already."""
    texts = edited_copies(random.Random(3), 60, least=0.05, most=0.2)
    x = list(near_dedup.text_shingles(pa.array(texts)))
    ids, roots = list(range(len(x))), [k if k % 4 else 0 for k in range(len(x))]
    probe, data = np.array([r != 0 for r in roots]), np.ones(len(x), bool)
    links = [(a, b) for a in ids for b in range(a) if near_dedup.alignment(x[a], x[b]) > 0]

    def classes(links):
        root = dict(enumerate(roots))
        for a, b in links:
            a, b = root[a], root[b]
            root = {d: min(a, b) if r in (a, b) else r for d, r in root.items()}
        return root

    found = near_dedup.links_between(ids, roots, x, probe, data, 0.8)
    assert {tuple(sorted(f, reverse=True)) for f in found} <= set(links) and classes(found) == classes(links)


def test_near_duplicates_on_hard_tables(spark, hard_docs, no_docs):
    found = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(hard_docs).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5, None: None, 8: 8}
    kept = near_dedup.one_of_each(hard_docs)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 4, 5, 8, None] and kept.columns == hard_docs.columns
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_ids_of_text_and_ids_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [("x2", a), ("x1", a), ("x3", a + " more"), ("y", b), ("y", c), ("y", c), ("z", c), (None, b)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    found = {(r.doc_id, r.class_id, r.copy_of) for r in near_dedup.near_duplicates(docs).collect()}
    assert found == {("x2", "x1", "x1"), ("x1", "x1", "x1"), ("x3", "x1", "x3"), ("y", "y", "y"), ("z", "y", "y"), (None, "y", "y")}
    kept = sorted(near_dedup.one_of_each(docs).collect(), key=str)
    assert [tuple(r) for r in kept] == sorted([("x1", a), ("y", b), ("y", c), (None, b)], key=str) or len(kept) == 4


def test_a_text_in_a_third_of_the_rows_is_spread(spark):
    """The rows of a hot text are joined with their class in many places, and those of a hub with its copies too."""
    words = [f"w{k}" for k in range(80)]
    hot = " ".join(words)
    rows = [(k, hot) for k in range(3000)] + [(3000 + k, " ".join([*words[:k], f"changed{k}", *words[k + 1 :]])) for k in range(80)] + [(5000 + k, " ".join(f"o{k}x{j}" for j in range(30))) for k in range(200)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.where("doc_id < 5000 and class_id = 0").count() == 3080 and found.where("doc_id >= 5000 and class_id = doc_id").count() == 200
    sizes = near_dedup.salted(spark.range(3000).selectExpr("id as doc_id", "1 as node"), spark.createDataFrame([(1, 2)], "node int, x int"), "node", by="doc_id")
    assert sizes.count() == 3000
    salts = spark.range(3000).select(F.pmod(F.xxhash64("id"), F.lit(near_dedup.SALTS)).alias("s")).groupBy("s").count().toPandas()
    assert len(salts) == near_dedup.SALTS and salts["count"].max() < 2 * 3000 / near_dedup.SALTS


def test_workers_let_go_of_what_other_work_has_kept(models):
    before = dict(batches._kept)
    batches._kept.clear()
    try:
        batches.turn_to("sentencepieces", sentencepieces.forget)
        sentencepieces.encoder(models[0]).encode("some words")
        batches.turn_to("sentencepieces", sentencepieces.forget)
        assert sentencepieces.encoder.cache_info().currsize == 1  # kept from task to task
        batches.turn_to("near_dedup")
        assert sentencepieces.encoder.cache_info().currsize == sentencepieces.vocabulary.cache_info().currsize == 0 and not batches._kept
    finally:
        batches._kept.update(before)
