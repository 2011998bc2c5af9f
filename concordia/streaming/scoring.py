"""Scores of users whose observations arrive as a stream.

Each micro-batch is added to a Parquet table of observations; the users it touches are
scored again over all they have.  State is the table, so a restart loses nothing, and a
replayed batch replaces its own part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from concordia.plans import score
from concordia.sources import ingest


def score_stream(stream: DataFrame, *, store: str, output: str, checkpoint: str, user_col: str, cost_cols: list[str], action_cols: list[str], time_col: str, metrics=("garp", "ccei"), **trigger) -> StreamingQuery:
    """Start a query that keeps the latest scores of touched users in ``output`` (by batch) from a wide stream."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # a column can have several roles
        rows = batch.select(F.col(user_col).cast("string").alias(user_col), *[c for c in dict.fromkeys([time_col, *cost_cols, *action_cols]) if c != user_col])
        rows.write.mode("overwrite").parquet(f"{store}/batch={number}")
        touched = spark.read.parquet(f"{store}/batch={number}").select(user_col).distinct()
        known = spark.read.parquet(store).filter(F.col("batch") <= number).join(touched, user_col, "left_semi")
        wide = ingest.from_wide(known, user_col=user_col, cost_cols=cost_cols, action_cols=action_cols, time_col=time_col)
        score.score_budget(wide, metrics).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest(spark, output: str) -> DataFrame:
    """The last scores of every user in the output of score_stream()."""
    rows = spark.read.parquet(output)
    last = rows.groupBy("user_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["user_id", "batch"]).drop("batch")


def windowed_sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Event counts of session windows with a watermark, for streams and tables alike."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy("user_id", F.session_window("ts", gap).alias("session")).agg(F.count(F.lit(1)).alias("n_events"))
