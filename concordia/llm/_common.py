"""Helpers shared by the text operators: reading tables, shared work tables, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.sources.files import shared_dir

#: Characters of text that a Python step holds at once, beside the Arrow batch.
CHUNK_CHARS = 1 << 21
#: Files of a work table for each core of the cluster, at most.
FILES_A_CORE = 4
#: Rows of an Arrow batch.
BATCH_ROWS, BATCH_CONF = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, label: str, *, slim: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later steps then neither compute it again nor depend on executors that may be lost.
    A ``slim`` table (of hashes) has at most FILES_A_CORE files for each core of the cluster, however many partitions its shuffle had.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/concordia-{label}-{uuid.uuid4().hex}"
    (df.coalesce(max(1, FILES_A_CORE * spark.sparkContext.defaultParallelism)) if slim else df).write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.work_path = path
    return out


_scopes: list[list[str]] = []


@contextlib.contextmanager
def work_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are materialized within are deleted at the end, but for those given to the function that this yields."""
    own, kept = [], set()
    _scopes.append(own)

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.work_path)
        return df

    try:
        yield keep
    finally:
        _scopes.pop()
        for path in own:
            if path in kept:
                if _scopes:
                    _scopes[-1].append(path)
            else:
                at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def map_arrow(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` in batches of at most BATCH_ROWS rows (the session's own bound, if it is lower), that returns freed memory when a task ends.

    Texts can be long and Spark bounds batches by rows alone; workers that wait for their next task keep what they once took.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_CONF)) <= BATCH_ROWS:
        conf.set(BATCH_CONF, str(BATCH_ROWS))

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return df.mapInArrow(task, schema)


def crc_fold(id_col: str, folds: int):
    """crc32 of the id written as text, modulo ``folds``; a null id falls in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)), F.lit(0))


_held: list[tuple[Hashable, object]] = []


def hold(key: Hashable, build: Callable[[], object]):
    """What ``build`` makes, kept by this Python worker until it is asked for something else: one model at a time."""
    if not _held or _held[0][0] != key:
        release()
        _held.append((key, build()))
        # what was needed to build it alone goes
        gc.collect()
        trim()
    return _held[0][1]


def release() -> None:
    """Give up what this worker holds; steps without a model of their own start with this."""
    if _held:
        _held.clear()
        gc.collect()
        trim()


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [t if t is not None else "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def slices(texts: list[str], size: int = CHUNK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Groups of (row, piece of its text) of about ``size`` characters; together they hold every whole text."""
    group, held = [], 0
    for row, text in enumerate(texts):
        for at in range(0, len(text), size):
            piece = text[at : at + size]
            group.append((row, piece))
            held += len(piece)
            if held >= size:
                yield group
                group, held = [], 0
    if group:
        yield group
