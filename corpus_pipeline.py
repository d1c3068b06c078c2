"""Corpus pipeline over `documents`: five stages, each on all that the one before kept.

1. language: documents whose language can't be told with a safe margin go (op8).
2. lines: lines that an earlier document has go from the text (op6); a document that is left empty stays, as an empty text.
3. near_duplicates: texts with a five-word similarity of at least 0.8 are linked, met by fingerprints first (op3) and then by tables (op12); of each
   component the smallest doc_id stays (near_copies).
4. decontaminate: documents that contain 80 % of a benchmark item's 5-word shingles go (op1).
5. encode: ids as of the public piece model, checked in the tests against its library (op2).

STAGES holds (name, function); a function takes (spark, docs, sf_dir). All stages but the last return the columns of docs.
What a stage returns runs when the caller writes it, so language, decontaminate and encode leave the session's Arrow batches at 1,000 rows at most
(spark.sql.execution.arrow.maxRecordsPerBatch): an executor's memory else follows batches of up to 64 MB for each core.
ORACLE_SQL is None: SQL has neither the compressor of stage 1 nor the encoder of stage 5.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ticketloom.llm import near_copies, op1_decontaminate, op2_sentencepiece, op6_lines, op8_langid
from ticketloom.llm.common import fewer_rows, shared_dir, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    fewer_rows(spark)
    return op8_langid.accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op6_lines.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    fewer_rows(spark)
    return op1_decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    fewer_rows(spark)
    return op2_sentencepiece.encoded(docs, columns=("ids", "n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("encode", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs, at = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
