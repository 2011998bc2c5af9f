"""Seeded generators of users: each user's data depend on the seed and the user's number alone."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_OBS = pa.list_(pa.struct([("t", pa.int32()), ("p", pa.list_(pa.float64())), ("q", pa.list_(pa.float64()))]))
_MENUS = pa.list_(pa.struct([("t", pa.int32()), ("menu", pa.list_(pa.int32())), ("choice", pa.int32())]))


def demand(form: str, prices: np.ndarray, wealth: np.ndarray, alpha: np.ndarray, elasticity: float) -> np.ndarray:
    """Bundles (times x goods) that a consumer with weights alpha demands."""
    if form == "cobb_douglas":
        return alpha * wealth[:, None] / prices
    if form == "ces":
        weight = alpha**elasticity * prices ** (1 - elasticity)
        return weight / weight.sum(axis=1, keepdims=True) * wealth[:, None] / prices
    if form == "leontief":
        return alpha * (wealth / (prices * alpha).sum(axis=1))[:, None]
    raise ValueError(f"unknown demand {form!r}; known are cobb_douglas, ces and leontief")


def one_budget(chance: np.random.Generator, n_obs: int, n_goods: int, form: str, elasticity: float, rationality: float, noise: float, prices: tuple[float, float], wealth: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    p = chance.uniform(*prices, (n_obs, n_goods))
    m = chance.uniform(*wealth, n_obs)
    q = demand(form, p, m, chance.dirichlet(np.ones(n_goods)), elasticity)
    off = chance.random(n_obs) >= rationality
    return p, np.where(off[:, None], q * np.exp(chance.normal(0, noise, q.shape)), q)


def _between(chance: np.random.Generator, n: int | tuple[int, int]) -> int:
    return n if isinstance(n, int) else int(chance.integers(n[0], n[1] + 1))


def budgets(
    spark: SparkSession, n_users: int, *, n_obs: int | tuple[int, int] = 15, n_goods: int = 5, form: str = "cobb_douglas", elasticity: float = 0.5, rationality: float = 0.7, noise: float = 0.3,
    prices: tuple[float, float] = (0.5, 2.0), wealth: tuple[float, float] = (50.0, 150.0), seed: int = 42,
) -> DataFrame:
    """Budget rows (user_id, obs): demand of one form, disturbed in a share 1 - rationality of the observations."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for i in ids:
                chance = np.random.default_rng([seed, i])
                p, q = one_budget(chance, _between(chance, n_obs), n_goods, form, elasticity, rationality, noise, prices, wealth)
                rows.append([{"t": t, "p": a, "q": b} for t, (a, b) in enumerate(zip(p.tolist(), q.tolist(), strict=True))])
            yield pa.RecordBatch.from_arrays([pa.array(map(str, ids), pa.string()), pa.array(rows, _OBS)], ["user_id", "obs"])

    return spark.range(n_users).mapInArrow(run, "user_id string, obs array<struct<t:int,p:array<double>,q:array<double>>>")


def menus(spark: SparkSession, n_users: int, *, n_obs: int | tuple[int, int] = 10, n_items: int = 5, menu_size: tuple[int, int] = (2, 5), model: str = "logit", temperature: float = 1.0, rationality: float = 0.7, seed: int = 42) -> DataFrame:
    """Menu rows (user_id, obs): the best item, or one by logit, or any in a share 1 - rationality of the observations."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for i in ids:
                chance = np.random.default_rng([seed, 1, i])
                value, obs = chance.normal(size=n_items), []
                for t in range(_between(chance, n_obs)):
                    menu = np.sort(chance.choice(n_items, min(n_items, _between(chance, menu_size)), replace=False))
                    if chance.random() >= rationality:
                        choice = chance.choice(menu)
                    elif model == "logit":
                        weight = np.exp((value[menu] - value[menu].max()) / temperature)
                        choice = chance.choice(menu, p=weight / weight.sum())
                    else:
                        choice = menu[value[menu].argmax()]
                    obs.append({"t": t, "menu": menu.tolist(), "choice": int(choice)})
                rows.append(obs)
            yield pa.RecordBatch.from_arrays([pa.array(map(str, ids), pa.string()), pa.array(rows, _MENUS)], ["user_id", "obs"])

    return spark.range(n_users).mapInArrow(run, "user_id string, obs array<struct<t:int,menu:array<int>,choice:int>>")


def demo(spark: SparkSession, n_users: int = 100, n_obs: int = 15, n_goods: int = 5, seed: int = 42) -> DataFrame:
    """Two fifths consistent, two fifths noisy, the others at random."""
    parts = []
    edges = (0, n_users * 2 // 5, n_users * 4 // 5, n_users)
    for k, (rationality, noise) in enumerate(((1.0, 0.0), (0.0, 0.2), (0.0, 1.5))):
        rows = budgets(spark, edges[k + 1] - edges[k], n_obs=n_obs, n_goods=n_goods, rationality=rationality, noise=noise, seed=seed + k)
        from pyspark.sql import functions as F

        parts.append(rows.withColumn("user_id", F.concat(F.lit(("consistent-", "noisy-", "random-")[k]), F.col("user_id"))))
    return parts[0].union(parts[1]).union(parts[2])


def production(spark: SparkSession, n_firms: int, *, n_obs: int = 15, n_inputs: int = 3, n_outputs: int = 2, rationality: float = 0.7, noise: float = 0.3, seed: int = 42) -> DataFrame:
    """(user_id, obs: array of (t, ip, iq, op, oq)): Cobb-Douglas firms that minimise the cost of their outputs."""
    kind = pa.list_(pa.struct([("t", pa.int32()), *((n, pa.list_(pa.float64())) for n in ("ip", "iq", "op", "oq"))]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for i in ids:
                chance = np.random.default_rng([seed, 2, i])
                share = chance.dirichlet(np.ones(n_inputs))
                ip, iq = one_budget(chance, n_obs, n_inputs, "cobb_douglas", 0.5, rationality, noise, (0.5, 2.0), (50.0, 150.0))
                level = np.prod(iq**share, axis=1)
                oq = level[:, None] * chance.dirichlet(np.ones(n_outputs))
                op = chance.uniform(1.0, 3.0, (n_obs, n_outputs))
                rows.append([{"t": t, "ip": a, "iq": b, "op": c, "oq": d} for t, (a, b, c, d) in enumerate(zip(ip.tolist(), iq.tolist(), op.tolist(), oq.tolist(), strict=True))])
            yield pa.RecordBatch.from_arrays([pa.array(map(str, ids), pa.string()), pa.array(rows, kind)], ["user_id", "obs"])

    d = "array<double>"
    return spark.range(n_firms).mapInArrow(run, f"user_id string, obs array<struct<t:int,ip:{d},iq:{d},op:{d},oq:{d}>>")


def dated(spark: SparkSession, n_users: int, *, n_obs: int = 10, n_periods: int = 5, discount: tuple[float, float] = (0.8, 0.99), rationality: float = 0.7, seed: int = 42) -> DataFrame:
    """(user_id, t, amount0, date0, amount1, date1, chosen): a sooner and a later amount, weighed with the user's discount factor."""
    kinds = [("user_id", pa.string()), ("t", pa.int32()), ("amount0", pa.float64()), ("date0", pa.int64()), ("amount1", pa.float64()), ("date1", pa.int64()), ("chosen", pa.int32())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in batch.column(0).to_pylist():
                chance = np.random.default_rng([seed, 3, i])
                delta = chance.uniform(*discount)
                for t in range(n_obs):
                    first = int(chance.integers(0, n_periods))
                    later = first + int(chance.integers(1, n_periods + 1))
                    a, b = chance.uniform(10, 100), chance.uniform(10, 150)
                    chosen = int(b * delta ** (later - first) > a) if chance.random() < rationality else int(chance.integers(0, 2))
                    rows.append((str(i), t, a, first, b, later, chosen))
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])

    return spark.range(n_users).mapInArrow(run, "user_id string, t int, amount0 double, date0 bigint, amount1 double, date1 bigint, chosen int")
