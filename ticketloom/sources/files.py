"""Inputs: document files, templates, logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.templates import TEMPLATE

MAX_BYTES, MAX_PAGES = 10 << 20, 20


def uploads(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """file, content, sha256, error of binary files: too large ones and ones that aren't PDF stay as rows with an error code. The
    size is known before the content is read."""
    files = spark.read.format("binaryFile").load(path)
    start = F.regexp_replace(F.decode(F.substring("content", 1, 1024), "ISO-8859-1"), r"^[\s\x00]+", "")
    error = F.when(F.col("length") > max_bytes, "FILE_TOO_LARGE").when(~start.startswith("%PDF-"), "UNSUPPORTED_FILE")
    return files.select(F.col("path").alias("file"), F.when(error.isNull(), F.col("content")).alias("content"), F.sha2("content", 256).alias("sha256"), error.alias("error"))


def decoded(files: DataFrame, decode: Callable[[bytes], list[dict]] | None = None) -> DataFrame:
    """slip_id, page, words, text, error of uploads. decode(content) gives a dict for each page: text and words as (text, x0, top, x1,
    bottom); a PDF library is looked for on the executors if none is given. A file that can't be decoded is a row with an error."""
    schema = "slip_id string, page int, text string, words array<struct<text:string,x0:double,top:double,x1:double,bottom:double>>, error string"

    def run(batches):
        import pandas as pd

        def pages(content: bytes) -> list[dict]:
            import io

            import pdfplumber

            with pdfplumber.open(io.BytesIO(content)) as pdf:
                if len(pdf.pages) > MAX_PAGES:
                    raise ValueError("TOO_MANY_PAGES")
                return [{"text": p.extract_text() or "", "words": [(w["text"], w["x0"], w["top"], w["x1"], w["bottom"]) for w in p.extract_words(x_tolerance=1.5, y_tolerance=2)]} for p in pdf.pages]

        for pdf in batches:
            rows = []
            for sha, content, error in zip(pdf["sha256"], pdf["content"], pdf["error"], strict=True):
                try:
                    if error:
                        raise ValueError(error)
                    rows += [(sha, i, p["text"], p["words"], None) for i, p in enumerate((decode or pages)(bytes(content)), 1)]
                except Exception as e:  # noqa: BLE001 - any fault of a file is that file's result
                    rows.append((sha, 0, None, [], str(e)[:200] or "INVALID_PDF"))
            yield pd.DataFrame(rows, columns=["slip_id", "page", "text", "words", "error"])

    return files.select("sha256", "content", "error").mapInPandas(run, schema)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Current versions of templates kept as JSON lines, one row for each version."""
    rows = spark.read.schema(TEMPLATE).json(path)
    return rows.groupBy("template_id").agg(F.max_by(F.struct(*rows.columns), "version").alias("t")).select("t.*")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Audit records kept as JSON lines; blank lines are skipped by the reader."""
    strings = "event_id occurred_at actor_type actor_id actor_name action entity_type entity_id outcome error details request_id ip_address user_agent prev_hash row_hash".split()
    return spark.read.schema("seq long, " + ", ".join(f"{c} string" for c in strings)).json(path)
