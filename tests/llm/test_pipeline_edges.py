"""The stages of the pipeline on odd rows: nulls, empty texts, repeats, clashing columns, no rows, no labels' documents."""

import pytest

import corpus_pipeline
from tessera.llm import toxicity

WORDS = " ".join(f"w{i}" for i in range(60))
ROWS = [(1, WORDS, "a"), (1, WORDS, "a"), (2, WORDS + " more", "b"), (None, "no id", None), (None, "no id", None), (3, None, "a"), (4, "", "b"), (5, "long " * 50_000, "a"), (6, "vile brute", "b")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    labels = [(100 + i, i % 2) for i in range(60)]
    docs = [(100 + i, ("vile brute" if i % 2 else "kind soul") + f" f{i} g{i}", "c") for i in range(60)] + ROWS
    clash = ", root long, node string, key string, ids string, score double, copies int, u int, n int, shingles string"
    spark.createDataFrame([(*r, 1, "n", "k", "i", 0.5, 2, 3, 4, "s") for r in docs], "doc_id long, text string, source string" + clash).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_on_odd_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    clean = corpus_pipeline.drop_toxic(spark, docs, folder).cache()
    model = toxicity.toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert clean.columns == columns and clean.count() == model.where("predicted = 0").count() and clean.where("doc_id = 6").count() == 0
    single = corpus_pipeline.drop_near_copies(spark, docs, folder).cache()
    assert single.columns == columns
    assert sorted(str(r.doc_id) for r in single.where("doc_id < 100 or doc_id is null").collect()) == ["1", "3", "5", "6", "None"]
    mixed = corpus_pipeline.mix(spark, single, folder).cache()
    assert mixed.columns == columns and 0 < mixed.count() <= 2 * single.count()
    last = corpus_pipeline.encode(spark, mixed, folder)
    assert last.count() == mixed.count() and last.where("not round_trip").count() == 0
    for df in (clean, single, mixed):
        df.unpersist()


def test_stages_on_no_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_encode_without_a_source(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").limit(3)
    assert corpus_pipeline.encode(spark, docs, folder).count() == 3
