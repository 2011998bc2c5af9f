"""Choices between a sooner and a later amount: (user_id, amount0, date0, amount1, date1, chosen), chosen 1 for the later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOL = 1e-8


def _implied(beta: Column | float = 1.0) -> Column:
    """The discount factor at which both options are worth the same; an immediate option isn't scaled by beta, a later one is."""
    ahead = (F.col("date1") - F.col("date0")).cast("double")
    scale = F.when(F.col("date0") == 0, beta if isinstance(beta, Column) else F.lit(float(beta))).otherwise(1.0)
    return F.pow(F.col("amount0") / (scale * F.col("amount1")), 1 / ahead)


def exponential(choices: DataFrame) -> DataFrame:
    """Bounds of the discount factor that explain each user's choices, and whether they leave room."""
    rows = choices.filter("date1 > date0 AND amount0 > 0 AND amount1 > 0").withColumn("at", _implied())
    low = F.greatest(F.lit(0.0), F.coalesce(F.max(F.when(F.col("chosen") == 1, F.col("at"))), F.lit(0.0)))
    high = F.least(F.lit(1.0), F.coalesce(F.min(F.when(F.col("chosen") == 0, F.col("at"))), F.lit(1.0)))
    out = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_choices"), low.alias("delta_low"), high.alias("delta_high"))
    return out.withColumn("is_consistent", F.col("delta_low") <= F.col("delta_high") + TOL)


def quasi_hyperbolic(choices: DataFrame, grid: int = 20) -> DataFrame:
    """The largest present-bias factor of a grid from 0.05 to 1 for which some discount factor explains the choices."""
    betas = F.explode(F.array(*[F.lit((k + 1) / grid) for k in range(grid)]))
    rows = choices.filter("date1 > date0 AND amount0 > 0 AND amount1 > 0").withColumn("beta", betas).withColumn("at", _implied(F.col("beta")))
    low = F.greatest(F.lit(0.0), F.coalesce(F.max(F.when(F.col("chosen") == 1, F.col("at"))), F.lit(0.0)))
    high = F.least(F.lit(1.0), F.coalesce(F.min(F.when(F.col("chosen") == 0, F.col("at"))), F.lit(1.0)))
    bounds = rows.groupBy("user_id", "beta").agg(low.alias("low"), high.alias("high"))
    fits = F.when(F.col("low") <= F.col("high") + TOL, F.col("beta"))
    return bounds.groupBy("user_id").agg(F.max(fits).alias("beta"), F.count(fits).alias("n_fitting"))


def present_bias(choices: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Patience (share of later choices) now and in the future; bias where it is lower now by more than the threshold."""
    now = F.col("date0") == 0
    later = F.col("chosen").cast("double")
    out = choices.groupBy("user_id").agg(F.avg(F.when(now, later)).alias("patience_now"), F.avg(F.when(~now, later)).alias("patience_future"))
    return out.withColumn("is_present_biased", F.coalesce(F.col("patience_future") - F.col("patience_now") > threshold, F.lit(False)))


def interest(choices: DataFrame) -> DataFrame:
    """Bounds of the interest rate that the discount bounds imply."""
    e = exponential(choices)
    return e.select("user_id", F.when(F.col("delta_high") > 0, 1 / F.col("delta_high") - 1).alias("rate_low"), F.when(F.col("delta_low") > 0, 1 / F.col("delta_low") - 1).alias("rate_high"))
