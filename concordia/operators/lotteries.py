"""Choices under risk: (user_id, safe, outcomes, probs, chose_risky)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.functions import single


def dominance(choices: DataFrame, tol: float = 1e-8) -> DataFrame:
    """Choices of a sure amount above the best outcome refused, or below the worst taken."""
    safe, risky = F.col("safe"), F.col("chose_risky")
    low, high = F.array_min("outcomes"), F.array_max("outcomes")
    bad = (risky & (safe > high + tol)) | (~risky & (safe < low - tol))
    expected = F.aggregate(F.zip_with("outcomes", "probs", lambda x, p: x * p), F.lit(0.0), lambda s, x: s + x)
    return choices.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_choices"), F.sum(bad.cast("long")).alias("n_dominated"), F.avg(((expected > safe) == risky).cast("double")).alias("share_expected_value")).withColumn("is_consistent", F.col("n_dominated") == 0)


def profiles(choices: DataFrame) -> DataFrame:
    """Relative risk aversion, category and consistency of each user."""
    rows = choices.groupBy("user_id").agg(F.collect_list(F.struct("safe", "outcomes", "probs", "chose_risky")).alias("c"))

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for user, c in zip(frame["user_id"], frame["c"], strict=True):
                found = single.risk_profile(np.array([x["safe"] for x in c], float), np.stack([x["outcomes"] for x in c]).astype(float), np.stack([x["probs"] for x in c]).astype(float), np.array([x["chose_risky"] for x in c], bool))
                kind = "inconsistent" if found["consistency"] < 0.6 else found["category"]
                out.append((user, found["rho"], found["category"], found["consistency"], kind))
            yield pd.DataFrame(out, columns=["user_id", "rho", "category", "consistency", "risk_type"])

    return rows.mapInPandas(run, "user_id string, rho double, category string, consistency double, risk_type string")
