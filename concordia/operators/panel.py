"""Summaries over the users of a panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.operators.budget import dot, observations


def summary(scores: DataFrame) -> DataFrame:
    """One row: share of consistent users and the distribution of violations."""
    n = F.col("n_violations")
    return scores.agg(
        F.count(F.lit(1)).alias("n_users"), F.avg(F.col("is_garp").cast("double")).alias("share_consistent"), F.avg(n).alias("mean_violations"), F.stddev_pop(n).alias("std_violations"),
        F.percentile(n, 0.25).alias("q25_violations"), F.percentile(n, 0.5).alias("median_violations"), F.percentile(n, 0.75).alias("q75_violations"), F.max(n).alias("max_violations"), F.max("max_scc").alias("max_scc"),
    )


def most_inconsistent(scores: DataFrame, n: int = 5) -> DataFrame:
    """The report of the ``n`` users with most violations."""
    return scores.select("user_id", "n_violations", "max_scc").orderBy(F.col("n_violations").desc(), F.col("max_scc").desc(), "user_id").limit(n)


def periods(rows: DataFrame, chars: int = 4) -> DataFrame:
    """Spending by period, the first characters of t (a year of months)."""
    o = observations(rows).withColumn("own", dot(F.col("p"), F.col("q")))
    return o.groupBy(F.substring("t", 1, chars).alias("period")).agg(F.count(F.lit(1)).alias("n_obs"), F.count_distinct("user_id").alias("n_users"), F.avg("own").alias("mean_spend"), F.percentile("own", 0.5).alias("median_spend"))


def windows(rows: DataFrame, size: int = 4) -> DataFrame:
    """Spending of each user in windows of so many observations."""
    o = observations(rows).withColumn("own", dot(F.col("p"), F.col("q")))
    return o.groupBy("user_id", F.floor(F.col("i") / size).cast("long").alias("w")).agg(F.count(F.lit(1)).alias("n_obs"), F.sum("own").alias("spend"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def audit(scores: DataFrame) -> DataFrame:
    """integrity (ccei), exploitability (mpi) and a verdict for each user of score_budget()."""
    return scores.select("user_id", "is_garp", F.col("ccei").alias("integrity"), F.col("mpi").alias("confusion"), F.when(F.col("is_garp"), "consistent").when(F.col("ccei") >= 0.9, "nearly consistent").otherwise("inconsistent").alias("verdict"))
