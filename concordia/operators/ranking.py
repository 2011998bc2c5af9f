"""Rankings from pairwise wins, and how rankings compare."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concordia.functions import choice


def wins(menus: DataFrame) -> DataFrame:
    """winner, loser, n over all choices."""
    rows = menus.select(F.col("choice").alias("winner"), F.explode("menu").alias("loser")).filter("winner <> loser")
    return rows.groupBy("winner", "loser").agg(F.count(F.lit(1)).alias("n"))


def strengths(matrix: np.ndarray, rounds: int = 1000, tol: float = 1e-8) -> np.ndarray:
    """Bradley-Terry strengths that sum to one, by minorising steps on a matrix of wins."""
    n = len(matrix)
    games, won = matrix + matrix.T, matrix.sum(axis=1)
    s = np.full(n, 1 / n)
    for _ in range(rounds):
        weight = (games / np.maximum(s[:, None] + s[None, :], 1e-300)).sum(axis=1)
        new = np.where(weight > 0, won / np.maximum(weight, 1e-300), s)
        new = np.maximum(new, 1e-12)
        new /= new.sum()
        if np.abs(new - s).max() < tol:
            return new
        s = new
    return s


def bradley_terry(pairs: DataFrame, group: str | None = None) -> DataFrame:
    """item and strength (and log_score, whose least is 0) from winner, loser, n; by ``group`` if there are many contests."""
    key = F.col(group).cast("string") if group else F.lit("all")

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        items = np.unique(np.concatenate([frame["winner"], frame["loser"]]))
        matrix = np.zeros((len(items), len(items)))
        np.add.at(matrix, (np.searchsorted(items, frame["winner"]), np.searchsorted(items, frame["loser"])), frame["n"])
        s = strengths(matrix)
        return pd.DataFrame({"contest": frame["contest"].iloc[0], "item": items, "strength": s, "log_score": np.log(s) - np.log(s).min()})

    # the rows of a contest are its pairs of items: counts are summed before they meet
    return pairs.select(key.alias("contest"), F.col("winner").cast("long").alias("winner"), F.col("loser").cast("long").alias("loser"), "n").groupBy("contest").applyInPandas(fit, "contest string, item long, strength double, log_score double")


def borda(menus: DataFrame) -> DataFrame:
    """Items of each user by how often they were chosen over others; then points summed over users."""
    e = menus.select("user_id", F.col("choice").alias("item"), (F.size("menu") - 1).alias("beaten")).groupBy("user_id", "item").agg(F.sum("beaten").alias("points"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("points").desc(), "item")) - 1
    return e.withColumn("place", place).groupBy("item").agg(F.sum("place").alias("place_sum"), F.count(F.lit(1)).alias("n_rankings"))


def compare(rankings: DataFrame) -> DataFrame:
    """Kendall's tau and the normalised footrule of two rankings: rows (pair_id, item, a, b) with places from 0."""
    x, y = rankings.alias("x"), rankings.alias("y")
    pairs = x.join(y, F.expr("x.pair_id = y.pair_id AND x.item < y.item"))
    order = F.signum(F.expr("CAST((x.a - y.a) * (x.b - y.b) AS DOUBLE)"))
    tau = pairs.groupBy(F.expr("x.pair_id").alias("pair_id")).agg(F.avg(order).alias("tau"))
    foot = rankings.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs(F.col("a") - F.col("b"))).alias("d"))
    most = F.floor(F.col("n") * F.col("n") / 2)
    return foot.join(tau, "pair_id", "left").select("pair_id", "n", F.coalesce("tau", F.lit(1.0)).alias("tau"), F.when(most > 0, F.col("d") / most).otherwise(0.0).alias("footrule"))


def overlap(pairs: DataFrame, p: float = 0.9) -> DataFrame:
    """Rank-biased overlap of lists ``a`` and ``b`` (best first), with the tail of the last depth."""
    depth = F.least(F.size("a"), F.size("b"))
    share = lambda d: F.size(F.array_intersect(F.slice("a", F.lit(1), d), F.slice("b", F.lit(1), d))) / d
    total = F.aggregate(F.sequence(F.lit(1), depth), F.lit(0.0), lambda s, d: s + share(d) * F.pow(F.lit(p), d - 1))
    return pairs.select("pair_id", F.when(depth > 0, (1 - p) * total + share(depth) * F.pow(F.lit(p), depth)).otherwise(0.0).alias("overlap"))


def predict(strength: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with the probability that a beats b."""
    a = strength.select("contest", F.col("item").alias("a"), F.col("strength").alias("sa"))
    b = strength.select("contest", F.col("item").alias("b"), F.col("strength").alias("sb"))
    return pairs.join(a, ["contest", "a"]).join(b, ["contest", "b"]).select("contest", "a", "b", (F.col("sa") / (F.col("sa") + F.col("sb"))).alias("p"))


def pairs_of(rankings: DataFrame) -> DataFrame:
    """winner, loser, n over all rankings (column ``ranking``: array, best first), counted on each partition first."""
    rows = rankings.select("ranking", F.posexplode("ranking").alias("k", "winner"))
    behind = F.slice("ranking", F.col("k") + 2, F.greatest(F.lit(0), F.size("ranking") - F.col("k") - 1))
    return rows.select("winner", F.explode(behind).alias("loser")).groupBy("winner", "loser").agg(F.count(F.lit(1)).alias("n"))


def kemeny(pairs: DataFrame) -> DataFrame:
    """place and item of the order with the fewest disagreements with winner, loser, n (as many rows as pairs of items), and whether that is proven."""

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        items = np.unique(np.concatenate([frame["winner"], frame["loser"]]))
        prefer = np.zeros((len(items), len(items)))
        np.add.at(prefer, (np.searchsorted(items, frame["winner"]), np.searchsorted(items, frame["loser"])), frame["n"])
        order, proven = choice.exact_consensus(items.tolist(), prefer)
        return pd.DataFrame({"place": range(len(order)), "item": order, "is_exact": proven})

    return pairs.withColumn("contest", F.lit(0)).groupBy("contest").applyInPandas(fit, "place long, item long, is_exact boolean")
