"""SparkSession settings that the engine counts on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: HotSpot never compiles a method of more bytes, so a stage with a column for each field of a deal would run in the JVM's interpreter; with this limit
#: Spark splits such a stage's code.
HUGE_METHOD, JIT_LIMIT = "spark.sql.codegen.hugeMethodLimit", 8000


def session(app: str = "ticketloom", **conf: str) -> SparkSession:
    """UTC dates, adaptive execution with skew handling, ANSI arithmetic; conf overrides (dots written as they are)."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.ansi.enabled": "true",
    }
    return SparkSession.builder.appName(app).config(map=base | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which the driver and all executors share. Where none is named, one is made in local mode
    only: there the driver is the one executor."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="ticketloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def dealt(df: DataFrame) -> DataFrame:
    """For the right side of a join whose sides both grow with the input. Spark guesses a table's size without the rows that an explode makes and
    may send it whole through the driver; here both sides are dealt out and sorted."""
    return df.hint("merge")


def beside(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """For the right side of a join that has few rows as a rule: sent whole to the left side if it does, else dealt out. df is counted, so it should be
    a checkpoint."""
    return F.broadcast(df) if df.count() <= rows else dealt(df)


def cut(df: DataFrame) -> DataFrame:
    """Eager checkpoint in the shared folder: it survives lost executors, and what comes after is planned on its own."""
    spark = df.sparkSession
    shared_dir(spark)
    own = spark.conf.get(HUGE_METHOD)
    spark.conf.set(HUGE_METHOD, str(min(int(own), JIT_LIMIT)))
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(HUGE_METHOD, own)
