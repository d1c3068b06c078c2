"""Shared pieces of the training-data operators: inputs, Arrow batches, checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Words of a shingle and least similarity of the near-duplicate stages.
SHINGLE_WORDS = 5
MIN_SIMILARITY = 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of a few rows. Spark closes a batch at 64 MB; what Python makes of one must not be a multiple of that."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
        b = None
        pa.default_memory_pool().release_unused()  # a worker outlives its task, and must not keep the batches' memory


_model: list = []  # of this worker: (make, arguments, model)


def held(make: Callable, *of):
    """make(*of), kept in this worker until another model is asked for. A worker outlives its task and its stage; with a cache for each
    operator it would keep the models of all stages at once."""
    if not _model or _model[0][:2] != (make, of):
        _model.clear()  # before the new one is made
        _model.append((make, of, make(*of)))
    return _model[0][2]


def release() -> None:
    """Let go of the model of an earlier stage, in tasks that need none."""
    _model.clear()


#: Rows of an Arrow batch. Spark's 10,000 rows of text are up to 64 MB, held by the JVM and by Python, for each core.
ARROW_ROWS, ARROW_KEY = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def fewer_rows(spark: SparkSession, rows: int = ARROW_ROWS) -> str:
    """Lowers the session's Arrow batches to so many rows, if they have more; returns the setting before. The setting holds when a query
    runs, not when it is made, so a frame that the caller writes needs it left as it is."""
    own = spark.conf.get(ARROW_KEY, "10000")
    spark.conf.set(ARROW_KEY, str(min(rows, int(own)) if int(own) > 0 else rows))
    return own


@contextmanager
def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> Iterator[None]:
    """Arrow batches of few rows for the jobs that run inside; the session's own setting comes back."""
    own = fewer_rows(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(ARROW_KEY, own)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured, one is made in local mode only: there the driver is
    the one executor."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="ticketloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: For tables whose rows are megabytes. Parquet's writer counts its bytes after 100 rows only, and its reader makes one batch of up to 4,096 rows of a
#: row group, so both would hold all rows of a task; with these a row group is closed after the row that fills it.
LARGE_ROWS = {"parquet.block.size": 4 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1}


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cheaper to read often than a checkpoint. The folder may go when the
    result has been read. options: of the writer."""
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with small_batches(df.sparkSession):
        df.write.options(**options).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def cut(df: DataFrame) -> DataFrame:
    """Eager checkpoint in the shared folder: survives lost executors and cuts the lineage."""
    shared_dir(df.sparkSession)
    with small_batches(df.sparkSession):
        return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def narrowed(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """df, in no more partitions than so many rows need: a small table that many joins and groupings pass on is dealt out over all tasks of a
    large job else, over and over."""
    return df.coalesce(max(1, min(partitions(df.sparkSession), -(-rows // each))))


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the two columns that are needed, so extra columns can't clash and are pruned from the scan."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def map_texts(docs: DataFrame, schema: str, rows: Callable[[list, list[bytes]], dict[str, list]]) -> DataFrame:
    """One output row per document: rows(ids, texts as UTF-8; null is empty) gives the columns of a batch."""
    out = to_arrow(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids = b.column(0).to_pylist()
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield batch(rows(ids, texts), out)

    return id_and_text(docs).mapInArrow(run, schema)


def keep_texts(docs: DataFrame, keep: Callable[[list[bytes]], list[bool]]) -> DataFrame:
    """The rows of docs, all columns as they are, for which keep(texts as UTF-8; null is empty) says so. No shuffle."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(keep([t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()]), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


class Memory:
    """Values of keys met before, in two generations: a full young one becomes the old one, from which keys that are met again come
    back. `places` bounds both together; a key takes one place, and one more for every 32 characters."""

    def __init__(self, places: int, learn: Callable[[list], list]):
        self.places = self.room = places // 2
        self.learn = learn
        self.young: dict = {}
        self.old: dict = {}

    def values(self, keys: list) -> list:
        """The value of each key; learn(keys) gives those of keys that aren't known."""
        got = list(map(self.young.get, keys))
        if None not in got:
            return got
        at, i = [], -1
        try:
            while True:
                i = got.index(None, i + 1)
                at.append(i)
        except ValueError:
            pass
        want = dict.fromkeys(map(keys.__getitem__, at))
        new = []
        for k in want:
            v = self.old.get(k)
            if v is None:
                new.append(k)
            else:
                want[k] = v
        want.update(zip(new, self.learn(new), strict=True))
        self.room -= len(want) + sum(map(len, want)) // 32
        if self.room < 0:
            self.old, self.young, self.room = self.young, {}, self.places
        self.young.update(want)
        for i in at:
            got[i] = want[keys[i]]
        return got


def to_arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
