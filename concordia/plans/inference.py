"""Power, bootstrap and predictive success: many simulated histories of each user at once.

The simulations of a user are one batch of the kernels, drawn from the seed and a hash of
the user's id, so results don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.functions import kernels

#: Histories of one batch of the kernels, by cells of their cost matrices.
CELLS = 2_000_000


def random_bundles(p: np.ndarray, wealth: np.ndarray, n: int, chance: np.random.Generator, kind: int = 1, shares: np.ndarray | None = None) -> np.ndarray:
    """n x times x goods on the users' budgets: 1 uniform shares, 2 normalised uniforms, 3 around mean shares."""
    t, goods = p.shape
    if kind == 1:
        share = chance.dirichlet(np.ones(goods), (n, t))
    elif kind == 2:
        share = chance.random((n, t, goods))
        share /= share.sum(axis=2, keepdims=True)
    else:
        share = chance.dirichlet((shares if shares is not None else np.full(goods, 1 / goods)) * goods + 0.1, (n, t))
    return share * wealth[None, :, None] / p[None]


def scores(p: np.ndarray, q: np.ndarray, ccei: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Consistency (and efficiency) of histories that are n x times x goods, in bounded batches."""
    fine, level = [], []
    step = max(1, CELLS // max(1, p.shape[-2] ** 2))
    for at in range(0, len(q), step):
        prices = p[at : at + step] if p.ndim == 3 else np.broadcast_to(p, q[at : at + step].shape)
        cost, own = kernels.costs(prices, q[at : at + step])
        weak, strict = kernels.relations(cost, own)
        ok = kernels.violations(kernels.closure(weak), strict) == 0
        fine.append(ok)
        if ccei:
            level.append(kernels.ccei(cost, own, ok))
    return np.concatenate(fine), np.concatenate(level) if ccei else None


def each_user(rows: DataFrame, columns: str, fn: Callable[[np.ndarray, np.ndarray, np.random.Generator], dict], seed: int) -> DataFrame:
    """user_id and ``columns`` of fn(p, q, chance) for every budget row."""
    slim = rows.select("user_id", F.transform("obs", lambda o: o["p"]).alias("p"), F.transform("obs", lambda o: o["q"]).alias("q"))
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = {"double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    types = [kinds[c.split()[1]] for c in columns.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for user, p, q in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.append(fn(np.array(p, float), np.array(q, float), np.random.default_rng([seed, xxhash.xxh3_64_intdigest(user or "")])))
            arrays = [pa.array([None if f[n] is None or f[n] != f[n] else f[n] for f in found], k) for n, k in zip(names, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["user_id", *names])

    return slim.mapInArrow(run, f"user_id string, {columns}")


def power(rows: DataFrame, n: int = 1000, *, kind: int = 1, seed: int = 42) -> DataFrame:
    """Bronars' power: the share of random histories on the same budgets that are inconsistent, and their mean efficiency."""

    def one(p, q, chance):
        fine, level = scores(p, random_bundles(p, (p * q).sum(axis=1), n, chance, kind, _mean_share(p, q)), ccei=True)
        return {"power": float(1 - fine.mean()), "mean_ccei": float(level.mean()), "n_simulations": n}

    return each_user(rows, "power double, mean_ccei double, n_simulations int", one, seed)


def _mean_share(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    spend = (p * q).sum(axis=1, keepdims=True)
    return ((p * q) / np.maximum(spend, 1e-300)).mean(axis=0)


def selten(rows: DataFrame, n: int = 1000, *, kind: int = 1, prior: float = 0.5, seed: int = 42) -> DataFrame:
    """Predictive success: hit (consistent or not) less the share of random histories that are; smoothed by efficiency; posterior of consistency."""

    def one(p, q, chance):
        ok, own = scores(p, q[None], ccei=True)
        fine, level = scores(p, random_bundles(p, (p * q).sum(axis=1), n, chance, kind, _mean_share(p, q)), ccei=True)
        area, hit, rate = float(fine.mean()), float(ok[0]), float((level <= own[0] + 1e-12).mean())
        given = prior * (1.0 if ok[0] else 0.0) + (1 - prior) * (area if ok[0] else 1 - area)
        return {"hit": hit, "area": area, "success": hit - area, "smoothed_hit": rate, "smoothed_success": rate - area, "credibility": prior * hit / given if given > 0 else 0.0}

    return each_user(rows, "hit double, area double, success double, smoothed_hit double, smoothed_success double, credibility double", one, seed)


def optimal_efficiency(rows: DataFrame, n: int = 500, levels: int = 20, *, seed: int = 42) -> DataFrame:
    """The efficiency level at which predictive success is greatest."""

    def one(p, q, chance):
        own = scores(p, q[None], ccei=True)[1][0]
        level = scores(p, random_bundles(p, (p * q).sum(axis=1), n, chance), ccei=True)[1]
        at = np.linspace(0, 1, levels + 1)[1:]
        success = (own >= at - 1e-12).astype(float) - (level[None, :] >= at[:, None] - 1e-12).mean(axis=1)
        best = int(success.argmax())
        return {"level": float(at[best]), "success": float(success[best])}

    return each_user(rows, "level double, success double", one, seed)


def bootstrap(rows: DataFrame, n: int = 1000, *, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """Efficiency with its bootstrap interval and standard error, observations drawn with replacement."""

    def one(p, q, chance):
        own = float(scores(p, q[None], ccei=True)[1][0])
        draw = chance.integers(0, len(p), (n, len(p)))
        level = scores(p[draw], q[draw], ccei=True)[1]
        low, high = np.percentile(level, [50 * (1 - confidence), 50 * (1 + confidence)])
        return {"ccei": own, "low": float(low), "high": float(high), "std_error": float(level.std(ddof=1))}

    return each_user(rows, "ccei double, low double, high double, std_error double", one, seed)


def levels(p: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """The metric of histories that are n x times x goods: ccei, or garp as 0 and 1."""
    fine, level = scores(p, q, ccei=metric == "ccei")
    return level if metric == "ccei" else fine.astype(float)


def difference(first: DataFrame, second: DataFrame, n: int = 1000, *, metric: str = "ccei", confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """Whether two histories of a user (budget rows of one user_id in either table) differ in a metric.

    Observations of both together are drawn with replacement to histories of either length; the p-value
    is the share of draws that differ as much, and low and high are quantiles of the drawn differences.
    """
    if metric not in ("ccei", "garp"):
        raise ValueError("metric is 'ccei' or 'garp'")
    side = lambda rows, name: rows.select("user_id", F.transform("obs", lambda o: F.struct(o["p"].alias("p"), o["q"].alias("q"))).alias(name))
    both = side(first, "a").join(side(second, "b"), "user_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("level_a", "level_b", "difference", "p_value", "low", "high")
        for batch in batches:
            found = []
            for user, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                chance = np.random.default_rng([seed, xxhash.xxh3_64_intdigest(user or "")])
                p, q = (np.array([o[k] for o in [*a, *b]], float) for k in ("p", "q"))
                own = [float(levels(p[part], q[part][None], metric)[0]) for part in (slice(0, len(a)), slice(len(a), None))]
                drawn = [levels(p[at], q[at], metric) for at in (chance.integers(0, len(p), (n, len(part))) for part in (a, b))]
                null = drawn[0] - drawn[1]
                low, high = np.percentile(null, [50 * (1 - confidence), 50 * (1 + confidence)])
                found.append((*own, own[0] - own[1], float((np.abs(null) >= abs(own[0] - own[1]) - 1e-12).mean()), float(low), float(high)))
            columns = list(zip(*found, strict=True)) if found else [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in columns)], ["user_id", *names])

    schema = "user_id string, level_a double, level_b double, difference double, p_value double, low double, high double"
    return both.mapInArrow(run, schema).withColumn("is_significant", F.col("p_value") < 1 - confidence)


def holdout(rows: DataFrame, share: float = 0.2, splits: int = 5, *, seed: int = 42, draws: int = 20) -> DataFrame:
    """How often a held-out observation is consistent with the rest, against random bundles on its budget.

    Each held-out observation is joined alone to the observations that aren't held out; fewer than five give 0.
    """

    def one(p, q, chance):
        n = len(p)
        if n < 5:
            return {"hit_rate": 0.0, "random_rate": 0.0, "success": 0.0}
        k = max(1, int(n * share))
        hits, luck = [], []
        for _ in range(splits):
            order = chance.permutation(n)
            out, rest = order[:k], order[k:]
            if len(rest) < 2:
                continue
            # one history for each held-out observation, the last row being that one
            join = np.column_stack([np.broadcast_to(rest, (k, n - k)), out])
            hits.append(scores(p[join], q[join])[0])
            other = np.repeat(q[join], draws, axis=0)
            other[:, -1] = random_bundles(p[out], (p[out] * q[out]).sum(axis=1), draws, chance).swapaxes(0, 1).reshape(k * draws, -1)
            luck.append(scores(np.repeat(p[join], draws, axis=0), other)[0])
        hit, random = (float(np.concatenate(x).mean()) if x else 0.0 for x in (hits, luck))
        return {"hit_rate": hit, "random_rate": random, "success": hit - random}

    return each_user(rows, "hit_rate double, random_rate double, success double", one, seed)
