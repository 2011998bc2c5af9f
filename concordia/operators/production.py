"""Firms: rows (user_id, obs: array of (t, ip, iq, op, oq)) of input and output prices and quantities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.operators.budget import dot


def profits(rows: DataFrame) -> DataFrame:
    """user_id, i, j, own, e: profit at prices i of the own plan and of plan j."""
    first = rows.select("user_id", "obs", F.posexplode("obs").alias("i", "a"))
    pairs = first.select("user_id", "i", "a", F.posexplode("obs").alias("j", "b"))
    own = dot(F.col("a.op"), F.col("a.oq")) - dot(F.col("a.ip"), F.col("a.iq"))
    other = dot(F.col("a.op"), F.col("b.oq")) - dot(F.col("a.ip"), F.col("b.iq"))
    return pairs.filter("i <> j").select("user_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), own.alias("own"), other.alias("e"))


def maximisation(rows: DataFrame, tol: float = 1e-10) -> DataFrame:
    """Pairs of observations where another plan would have made more profit, and the largest loss by it."""
    found = profits(rows).groupBy("user_id").agg(F.sum((F.col("e") > F.col("own") + tol).cast("long")).alias("n_violations"), F.max(F.greatest(F.lit(0.0), F.col("e") - F.col("own"))).alias("largest_loss"))
    return rows.select("user_id").join(found, "user_id", "left").select("user_id", F.coalesce("n_violations", F.lit(0)).alias("n_violations"), F.coalesce("largest_loss", F.lit(0.0)).alias("largest_loss"))


def cost_minimisation(rows: DataFrame, tol: float = 1e-10) -> DataFrame:
    """Pairs where inputs that made at least as much of every output would have been cheaper."""
    first = rows.select("user_id", "obs", F.posexplode("obs").alias("i", "a"))
    pairs = first.select("user_id", "i", "a", F.posexplode("obs").alias("j", "b")).filter("i <> j")
    enough = F.forall(F.zip_with("a.oq", "b.oq", lambda x, y: y >= x - tol), lambda z: z)
    cheaper = dot(F.col("a.ip"), F.col("b.iq")) < dot(F.col("a.ip"), F.col("a.iq")) - tol
    found = pairs.groupBy("user_id").agg(F.sum((enough & cheaper).cast("long")).alias("n_violations"))
    return rows.select("user_id").join(found, "user_id", "left").select("user_id", F.coalesce("n_violations", F.lit(0)).alias("n_violations"))


def returns_to_scale(rows: DataFrame) -> DataFrame:
    """Slope of log output value over log input value: above one increasing, below one decreasing."""
    o = rows.select("user_id", F.explode("obs").alias("o")).select("user_id", F.log(dot(F.col("o.ip"), F.col("o.iq"))).alias("x"), F.log(dot(F.col("o.op"), F.col("o.oq"))).alias("y"))
    slope = o.groupBy("user_id").agg(F.regr_slope("y", "x").alias("slope"))
    return slope.withColumn("returns", F.when(F.col("slope") > 1.05, "increasing").when(F.col("slope") < 0.95, "decreasing").otherwise("constant"))


def profit_efficiency(rows: DataFrame) -> DataFrame:
    """Mean profit as a share of the largest, 0 to 1; 1 for firms that never make any."""
    o = rows.select("user_id", F.explode("obs").alias("o")).select("user_id", (dot(F.col("o.op"), F.col("o.oq")) - dot(F.col("o.ip"), F.col("o.iq"))).alias("profit"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg("profit") / F.max("profit")))
    return o.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_obs"), F.max("profit").alias("largest_profit"), F.when(F.max("profit") <= 0, 1.0).otherwise(share).alias("efficiency"))


def totals(rows: DataFrame) -> DataFrame:
    """Cost, revenue and profit of every observation."""
    o = rows.select("user_id", F.posexplode("obs").alias("i", "o"))
    cost, revenue = dot(F.col("o.ip"), F.col("o.iq")), dot(F.col("o.op"), F.col("o.oq"))
    return o.select("user_id", F.col("i").cast("long").alias("i"), cost.alias("cost"), revenue.alias("revenue"), (revenue - cost).alias("profit"))
