"""The corpus pipeline, stage by stage, against brute force."""

import hashlib

import sentencepiece

import corpus_pipeline
from myospark.llm import decontaminate, near_dedup, quality_rules, secret_scan


def test_every_stage_decides(spark):
    sf = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    names = documents.columns
    labels, benchmark = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    docs, kept = documents, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).toPandas(), documents.schema)
        assert docs.columns == names
        kept.append({r.doc_id: r.text for r in docs.collect()})
    judged = quality_rules.apply_rules(documents, labels)
    assert set(kept[0]) == {r.doc_id for r in judged.where("kept").collect()}
    classes = near_dedup.near_duplicates(documents.where(documents.doc_id.isin(list(kept[0]))))
    assert set(kept[1]) == {r.class_id for r in classes.collect()}
    bad = {r.doc_id for r in decontaminate.contaminated_pairs(documents, benchmark).collect()}
    assert set(kept[2]) == set(kept[1]) - bad
    assert set(kept[3]) == set(kept[2])
    assert not any(secret_scan.base_spans(t) for t in kept[3].values())
    assert all(t == kept[2][d] for d, t in kept[3].items() if "<secret>" not in t)
    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.PIECE_MODEL)
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(kept[3])
    for r in rows:
        ids = library.encode(kept[3][r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def small_sf(spark, folder, docs):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def words(n, at=0):
    return " ".join(f"word{k}" for k in range(at, at + n))


def test_pipeline_of_planted_documents(spark, tmp_path):
    """What goes and what stays is known beforehand; rows of nulls, empty texts, repeated rows and clashing columns too."""
    item = next(r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect() if len((r.text or "").split()) >= 12)
    clean, near = words(80), words(79) + " changed"
    rows = [
        (1, None, "en", "a", 0), (2, "", None, None, None), (3, "few words only", "en", "a", 14), (4, clean, "en", "a", len(clean)), (5, clean, "en", "b", len(clean)), (6, near, "en", "a", len(near)),
        (7, words(80, 500), "en", "a", 1), (7, words(80, 500), "en", "a", 1), (8, words(60, 900) + "\n" + item, "en", "a", 1), (9, words(60, 1300) + " password = abcdefghijklmnop1", "en", "a", 1), (None, words(70, 1700), "en", "a", 1), (10, "again and again " * 40, "en", "a", 1),
    ]
    clash = spark.createDataFrame([(*r, 5, "x", 1.5) for r in rows], DOCS + ", n_words long, spans string, kept double")
    sf = small_sf(spark, tmp_path, clash)
    docs, left = clash, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        docs = spark.createDataFrame(docs.collect(), clash.schema)
        assert docs.columns == clash.columns
        left.append({r.doc_id for r in docs.collect()})
    assert left == [{4, 5, 6, 7, 8, 9, None}, {4, 7, 8, 9, None}, {4, 7, 9, None}, {4, 7, 9, None}]
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.PIECE_MODEL)
    texts = {4: clean, 7: words(80, 500), 9: words(60, 1300) + " <secret>", None: words(70, 1700)}
    assert set(out) == set(texts)
    for k, t in texts.items():
        ids = library.encode(t)
        assert out[k].n_tokens == len(ids) and out[k].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pipeline_of_nothing(spark, tmp_path):
    assert corpus_pipeline.run(spark, small_sf(spark, tmp_path, spark.createDataFrame([], DOCS))).count() == 0


def test_pipeline_leaves_one_table(spark, tmp_path):
    from myospark import storage

    own = storage._written.setdefault(spark.sparkContext.applicationId, [])
    before = len(own)
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert len(own) == before + 1 and "pipeline-secret_scan" in own[-1]


def test_near_dedup_sends_no_table_through_the_driver(spark, monkeypatch):
    from myospark.operators import components
    from myospark.storage import materialize

    plans = []

    def noted(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return materialize(df, name)

    for module in (near_dedup, components):
        monkeypatch.setattr(module, "materialize", noted)
    docs = [(10 * k + c, " ".join(f"w{k}x{i}" for i in range(60 - c))) for k in range(12) for c in range(5)]
    kept = near_dedup.one_of_each(spark.createDataFrame(docs, "doc_id long, text string"))
    plans.append(("kept", kept._jdf.queryExecution().executedPlan().toString()))
    assert {r.doc_id for r in kept.collect()} == {10 * k for k in range(12)}
    assert [name for name, plan in plans if "Broadcast" in plan] == []
