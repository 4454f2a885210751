"""Each stage on what the one before kept, and the order of the stages."""
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents
from traceloom.llm import quality, simhash
from traceloom.llm.common import new_path

FOLDER = "/root/testdata/sf0.01"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "packing"]
    docs = first = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        path = new_path(spark, f"test-{name}")
        stage(spark, docs, FOLDER).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == first.columns
        if name == "quality":
            labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
            want = {r.doc_id for r in quality.score_documents(before, labels).where("kept").collect()}
            assert {r.doc_id for r in docs.collect()} == want
            good = before.join(labels.where("quality = 1"), "doc_id")
            assert docs.join(good.select("doc_id"), "doc_id").count() >= 0.99 * good.count()
        if name == "near_duplicates":
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert len(set(texts.values())) == len(texts)
            prints = {d: simhash.fingerprint(t) for d, t in texts.items()}
            own = list(prints.values())
            assert not any(bin(own[i] ^ own[j]).count("1") <= 3 for i in range(len(own)) for j in range(i))
        if name == "secrets":
            assert docs.count() == before.count() and docs.where("text like '%[SECRET]%'").count() > 0
            assert docs.where(F.col("n_chars") != F.char_length("text")).count() == 0
    whole = seen["packing"]
    assert whole.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
    assert whole.where("piece = 0").count() == seen["mixing"].count()


@pytest.mark.parametrize("clash", [False, True])
def test_odd_rows_pass_all_stages(spark, tmp_path, clash):
    docs = documents(spark, clash=clash)
    folder = str(tmp_path)
    before = spark.createDataFrame(docs.collect(), docs.schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, folder) if name != "quality" else before
        assert after.columns == docs.columns and {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and "sequence_id" in out.columns
