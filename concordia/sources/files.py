"""Readers and writers."""

from __future__ import annotations

import tempfile
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.errors import DataError


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a temporary one only where none is set and all runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise DataError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = _own_folder()
    return path.rstrip("/")


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="concordia-")


def read(spark: SparkSession, path: str, kind: str | None = None, schema: str | None = None) -> DataFrame:
    """A Parquet, CSV (with header), JSON-lines or ORC table; the kind follows the path's ending unless given."""
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1].lower()
    kind = {"jsonl": "json", "pq": "parquet"}.get(kind, kind)
    if kind not in ("parquet", "csv", "json", "orc"):
        raise ValueError(f"can't tell how to read {path!r}; give kind as 'parquet', 'csv', 'json' or 'orc'")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("header", True).option("inferSchema", schema is None).csv(path) if kind == "csv" else getattr(reader, kind)(path)


def write(df: DataFrame, path: str, compression: str = "zstd") -> str:
    df.write.option("compression", compression).parquet(path)
    return path


def prepare(spark: SparkSession, source: str, path: str, *, user_col: str = "user_id", partitions: int | None = None, compression: str = "zstd") -> dict[str, object]:
    """Write a table sorted by user, so that readers skip by the users' ranges; its counts.

    Rows go by ranges of the user; one with very many rows is a range of their own.
    """
    df = read(spark, source)
    ordered = (df.repartitionByRange(partitions, user_col) if partitions else df.repartitionByRange(user_col)).sortWithinPartitions(user_col)
    ordered.write.option("compression", compression).parquet(path)
    written = spark.read.parquet(path)
    n = written.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(user_col).alias("users")).first()
    return {"n_rows": n["rows"], "n_users": n["users"], "n_files": len(written.inputFiles()), "output_path": path}
