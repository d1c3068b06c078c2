"""What the pipeline's stages hold in an executor: one model in a worker, and Arrow batches of few rows."""

import gc
import weakref

import corpus_pipeline
import pyarrow as pa
import pytest

from ticketloom.llm import common, op2_sentencepiece, op8_langid

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_a_worker_holds_one_model():
    path = op2_sentencepiece.model_path()
    first = op2_sentencepiece.encoder(path)
    assert op2_sentencepiece.encoder(path) is first
    gone = weakref.ref(first)
    del first
    model = (("en", b"the quick brown fox and the lazy dog " * 9), ("de", b"der schnelle braune fuchs und der faule hund " * 9))
    assert op8_langid.predict("the lazy dog and the quick brown fox", model)[0] == "en"
    gc.collect()
    assert gone() is None
    common.release()
    assert not common._model
    assert op2_sentencepiece.encoder(path).encode("the lazy dog")


@pytest.mark.parametrize("name", ["language", "decontaminate", "encode"])
def test_batches_of_few_rows(spark, tmp_path, name):
    texts = [(i, f"The quick brown fox number {i} jumps over the lazy dog and looks for its friends in the forest", "en") for i in range(2500)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "an item that no document holds at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    own = spark.conf.get(KEY)
    try:
        got = dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
        sizes = [r.n for r in got.mapInArrow(rows, "n long").collect()]
        assert sum(sizes) == 2500 and max(sizes) <= 1000
        spark.conf.set(KEY, "300")  # a smaller setting stays
        dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
        assert spark.conf.get(KEY) == "300"
    finally:
        spark.conf.set(KEY, own)
