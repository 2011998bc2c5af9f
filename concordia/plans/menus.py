"""One decision maker's menus as rows: orders, consideration sets, attention, logit, production and lotteries."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.functions import choice, demand


def each(rows: DataFrame, columns: str, fn: Callable[[pd.Series], list[tuple]]) -> DataFrame:
    """user_id and ``columns``: any number of rows of fn(obs) for each row (user_id, obs)."""
    names = ["user_id", *(c.split()[0] for c in columns.split(", "))]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(user, *row) for user, obs in zip(frame["user_id"], frame["obs"], strict=True) for row in fn(obs)], columns=names)

    return rows.select("user_id", "obs").mapInPandas(run, f"user_id string, {columns}")


def _menus(obs) -> tuple[list[list[int]], list[int]]:
    return [list(map(int, o["menu"])) for o in obs], [int(o["choice"]) for o in obs]


def preferences(rows: DataFrame) -> DataFrame:
    """Rank and utility of each item, for users whose choices have an order."""

    def one(obs):
        found = choice.preferences(*_menus(obs))
        return [(i, k, found["utility"][i]) for k, i in enumerate(found["order"])]

    return each(rows, "item int, rank int, utility int", one)


def maximality(rows: DataFrame) -> DataFrame:
    return each(rows, "n_not_maximal int", lambda obs: [(choice.maximal(*_menus(obs)),)])


def consideration(rows: DataFrame) -> DataFrame:
    """What each observation's menu is considered to be."""
    return each(rows, "i int, considered array<int>", lambda obs: list(enumerate(choice.consideration(*_menus(obs)))))


def limited_attention(rows: DataFrame) -> DataFrame:
    def one(obs):
        found = choice.limited_attention(*_menus(obs))
        return [(found["success"], len(found["relation"]), found["order"])]

    return each(rows, "is_warp_la boolean, n_pairs int, preference array<int>", one)


def with_filter(rows: DataFrame, keep) -> DataFrame:
    """Whether a given attention filter (frozenset of items to a set of items) explains the choices."""
    return each(rows, "is_explained boolean", lambda obs: [(choice.filtered(*_menus(obs), keep),)])


def _shares(obs) -> tuple[list[list[int]], list[dict[int, float]]]:
    menus = [list(map(int, o["menu"])) for o in obs]
    return menus, [dict(zip(m, (np.array(o["counts"]) / max(1, sum(o["counts"]))).tolist(), strict=True)) for m, o in zip(menus, obs, strict=True)]


def random_attention(rows: DataFrame, alpha: float = 0.05) -> DataFrame:
    """From rows (user_id, obs: array of (menu, counts)): orders that fit, the first one, its distance and the share of orders as distant."""

    def one(obs):
        found = choice.random_attention(*_shares(obs), alpha)
        return [(found["is_consistent"], found["n_orders"], found["order"], found["statistic"], found["p_value"])]

    return each(rows, "is_consistent boolean, n_orders bigint, preference array<int>, statistic double, p_value double", one)


def monotone_attention(rows: DataFrame) -> DataFrame:
    """Orders that the theory of monotone attention allows, from the same rows."""

    def one(obs):
        found = choice.monotone_attention(*_shares(obs))
        return [(found["is_consistent"], found["n_orders"], found["order"])]

    return each(rows, "is_consistent boolean, n_orders bigint, preference array<int>", one)


def logit(rows: DataFrame) -> DataFrame:
    """Logit utilities from rows (user_id, obs: array of (menu, counts))."""

    def one(obs):
        found = choice.logit([list(map(int, o["menu"])) for o in obs], [list(map(int, o["counts"])) for o in obs])
        return [(i, float(u), found["log_likelihood"], found["aic"], found["bic"]) for i, u in found["utility"].items()]

    return each(rows, "item int, utility double, log_likelihood double, aic double, bic double", one)


def technical_efficiency(firms: DataFrame, oriented: str = "output") -> DataFrame:
    def one(obs):
        inputs, outputs = (np.stack([o[k] for o in obs]).astype(float) for k in ("iq", "oq"))
        return [(i, float(x)) for i, x in enumerate(choice.technical_efficiency(inputs, outputs, oriented))]

    return each(firms, "i int, efficiency double", one)


def expected_utility(lotteries: DataFrame, attitude: str = "any") -> DataFrame:
    """From rows (user_id, obs: array of (outcomes: array of arrays, probs, chosen))."""

    def one(obs):
        data = [(np.stack(o["outcomes"]).astype(float), np.array(o["probs"], float), int(o["chosen"])) for o in obs]
        return [(choice.expected_utility(data, attitude), sum(choice.dominated(*x) for x in data))]

    return each(lotteries, "is_consistent boolean, n_dominated int", one)


def rank_dependent(lotteries: DataFrame) -> DataFrame:
    """Dominated choices state by state, the bend of probability weights, and reversals by mixing."""

    def one(obs):
        data = [(np.stack(o["outcomes"]).astype(float), np.array(o["probs"], float), int(o["chosen"])) for o in obs]
        found = demand.rank_dependent(data)
        return [(found["is_consistent"], found["n_dominated"], found["weighting"], demand.independence_violations(data))]

    return each(lotteries, "is_consistent boolean, n_dominated int, weighting string, n_independence int", one)


def as_lotteries(choices: DataFrame) -> DataFrame:
    """Choices of a sure amount or a lottery as lotteries over the same states."""
    sure = F.transform("outcomes", lambda _: F.col("safe"))
    o = F.struct(F.array(sure, F.col("outcomes")).alias("outcomes"), "probs", F.col("chose_risky").cast("int").alias("chosen"))
    return choices.groupBy("user_id").agg(F.collect_list(o).alias("obs"))
