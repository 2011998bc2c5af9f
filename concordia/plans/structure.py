"""One user's structure as rows: graphs, cycles, utilities, demand systems, welfare, ideal points.

Users are independent, so every plan is one pass over budget rows without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.functions import demand, single
from concordia.plans.inference import each_user


def _rows(rows: DataFrame, columns: str, fn: Callable[[np.ndarray, np.ndarray], list[tuple]]) -> DataFrame:
    """user_id and ``columns``: any number of rows for each budget row."""
    slim = rows.select("user_id", F.transform("obs", lambda o: o["p"]).alias("p"), F.transform("obs", lambda o: o["q"]).alias("q"))
    names = ["user_id", *(c.split()[0] for c in columns.split(", "))]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(user, *row) for user, p, q in zip(frame["user_id"], frame["p"], frame["q"], strict=True) for row in fn(np.stack(p).astype(float), np.stack(q).astype(float))]
            yield pd.DataFrame(out, columns=names)

    return slim.mapInPandas(run, f"user_id string, {columns}")


def graph_edges(rows: DataFrame) -> DataFrame:
    """Every related pair of observations with its log weight, closure and component."""

    def one(p, q):
        g = single.graph(p, q)
        return [(i, j, float(g["own"][i]), float(g["cost"][i, j]), bool(g["weak"][i, j]), bool(g["strict"][i, j]), float(g["weight"][i, j]), int(g["labels"][i])) for i, j in np.argwhere(g["reach"]).tolist() if i != j]

    return _rows(rows, "i int, j int, own double, e double, r boolean, p boolean, weight double, component int", one)


def graph_json(rows: DataFrame) -> DataFrame:
    """Each user's graph as text: nodes, and links (source, target, weight, strict) of the direct relation."""
    link = F.struct(F.col("i").alias("source"), F.col("j").alias("target"), F.round("weight", 9).alias("weight"), F.col("p").alias("strict"))
    links = graph_edges(rows).filter("r").groupBy("user_id").agg(F.array_sort(F.collect_list(link)).alias("links"))
    both = rows.select("user_id", F.sequence(F.lit(0), F.size("obs") - 1).alias("nodes")).join(links, "user_id", "left")
    return both.select("user_id", F.to_json(F.struct("nodes", F.coalesce("links", F.array().cast("array<struct<source:int,target:int,weight:double,strict:boolean>>")).alias("links"))).alias("graph"))


def sensitivity(rows: DataFrame, share: float = 0.2) -> DataFrame:
    """Efficiency after taking out observations one by one, those of the lowest Varian levels first; two at least stay."""
    from concordia.functions import kernels

    def one(p, q):
        n = len(p)
        cost, own = kernels.costs(p[None], q[None])
        fine = np.array([single.efficiency(p, q) == 1.0])
        order = np.argsort(kernels.varian_levels(cost, own, fine)[0], kind="stable")
        steps = min(max(1, int(n * share)), n - 2)
        return [(k, single.efficiency(p[np.sort(order[k:])], q[np.sort(order[k:])])) for k in range(max(0, steps) + 1)]

    return _rows(rows, "removed int, ccei double", one)


def cycles(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Violating cycles with their length and cost; all of them, or each user's first ``most``."""

    def one(p, q):
        g = single.graph(p, q)
        return [(k, c, len(c), single.cycle_cost(c, g)) for k, c in enumerate(single.cycles(g, most))]

    return _rows(rows, "cycle int, nodes array<int>, length int, cost double", one)


def indices(rows: DataFrame) -> DataFrame:
    """Swaps index, minimum cost index, continuous efficiency and the worst cycle's cost of each user."""

    def one(p, q, _):
        g = single.graph(p, q)
        found = single.swaps(g)
        return {"n_swaps": found["n_swaps"], "swaps_index": found["index"], "minimum_cost_index": single.minimum_cost(g), "continuous_ccei": single.continuous_efficiency(p, q), "worst_cycle_cost": max([0.0, *(single.cycle_cost(c, g) for c in single.cycles(g))])}

    return each_user(rows, "n_swaps int, swaps_index double, minimum_cost_index double, continuous_ccei double, worst_cycle_cost double", one, 0)


def contributions(rows: DataFrame, method: str = "cycles") -> DataFrame:
    return _rows(rows, "i int, share double", lambda p, q: [(i, float(x)) for i, x in enumerate(single.contributions(single.graph(p, q), p, q, method))])


def centrality(rows: DataFrame) -> DataFrame:
    """For each observation the degrees in the direct relation, the violating cycles through it, and betweenness over shortest paths."""

    def one(p, q):
        g = single.graph(p, q)
        edges = g["weak"] & ~np.eye(len(p), dtype=bool)
        through = np.zeros(len(p))
        for c in single.cycles(g):
            through[c] += 1
        return [(i, int(edges[i].sum()), int(edges[:, i].sum()), int(through[i]), float(b)) for i, b in enumerate(betweenness(edges))]

    return _rows(rows, "i int, out_degree int, in_degree int, n_cycles int, betweenness double", one)


def betweenness(edges: np.ndarray) -> np.ndarray:
    """Share of shortest paths between other nodes that pass a node."""
    n = len(edges)
    out = np.zeros(n)
    for s in range(n):
        count, level, order = np.zeros(n), np.full(n, -1), [s]
        count[s], level[s] = 1, 0
        for u in order:
            for v in np.flatnonzero(edges[u]).tolist():
                if level[v] < 0:
                    level[v] = level[u] + 1
                    order.append(v)
                if level[v] == level[u] + 1:
                    count[v] += count[u]
        credit = np.zeros(n)
        for v in order[:0:-1]:
            for u in np.flatnonzero(edges[:, v]).tolist():
                if level[u] == level[v] - 1 and level[u] >= 0:
                    credit[u] += count[u] / count[v] * (1 + credit[v])
            out[v] += credit[v]
    return out / max(1, (n - 1) * (n - 2))


def utilities(rows: DataFrame) -> DataFrame:
    """Recovered utility and multiplier of each observation; none for users without one."""

    def one(p, q):
        found = single.utility(p, q)
        return [(i, float(u), float(m)) for i, (u, m) in enumerate(zip(found["u"], found["multiplier"], strict=True))] if found["success"] else []

    return _rows(rows, "i int, utility double, multiplier double", one)


def demand_at(rows: DataFrame, prices: list[float], wealth: float) -> DataFrame:
    """A bundle of greatest recovered utility at new prices."""
    return _rows(rows, "g int, quantity double", lambda p, q: [(g, None if x != x else float(x)) for g, x in enumerate(single.predict_demand(p, q, np.array(prices, float), wealth))])


def slutsky(rows: DataFrame) -> DataFrame:
    """Substitution effects of each pair of goods."""
    return _rows(rows, "g int, h int, effect double", lambda p, q: [(g, h, float(x)) for (g, h), x in np.ndenumerate(single.slutsky(p, q))])


def integrability(rows: DataFrame, symmetry: float = 0.1, tol: float = 1e-6) -> DataFrame:
    def one(p, q, _):
        found = single.slutsky_tests(single.slutsky(p, q), symmetry, tol)
        return found | {"is_integrable": found["is_symmetric"] and found["is_nsd"]}

    return each_user(rows, "is_symmetric boolean, asymmetry double, is_nsd boolean, max_eigenvalue double, is_integrable boolean", one, 0)


def separability(rows: DataFrame, a: list[int], b: list[int]) -> DataFrame:
    return each_user(rows, "within_a double, within_b double, cross_effect double, is_separable boolean", lambda p, q, _: single.separability(p, q, a, b), 0)


def separability_by_numbers(rows: DataFrame, a: list[int], b: list[int]) -> DataFrame:
    """The sequential test of weak separability."""
    return each_user(rows, "within_a double, within_b double, is_separable boolean", lambda p, q, _: single.separability_by_numbers(p, q, a, b), 0)


def separable_partition(rows: DataFrame, groups: int = 3) -> DataFrame:
    return _rows(rows, "part int, goods array<int>", lambda p, q: list(enumerate(single.partition(p, q, groups))))


def cross_effects(rows: DataFrame) -> DataFrame:
    """Elasticities of each good's quantity to each price, with standard errors."""

    def one(p, q):
        beta, error = single.regress(np.log(np.maximum(q, 1e-10)), np.column_stack([np.log(p), np.log(np.maximum((p * q).sum(axis=1), 1e-10))]))
        goods = p.shape[1]
        return [(g, h, float(beta[h, g]), float(error[h, g])) for g in range(goods) for h in range(goods)]

    return _rows(rows, "g int, h int, elasticity double, std_error double", one)


def characteristics(rows: DataFrame, attributes: list[list[float]]) -> DataFrame:
    """Amounts and shadow prices of characteristics; ``attributes`` has a row for each good."""
    a = np.array(attributes, float)

    def one(p, q):
        found = single.characteristics(p, q, a)
        return [(i, found["z"][i].tolist(), found["shadow"][i].tolist(), float(found["residual"][i])) for i in range(len(p))]

    return _rows(rows, "i int, amounts array<double>, shadow_prices array<double>, residual double", one)


def welfare(rows: DataFrame) -> DataFrame:
    """Exact compensating and equivalent variation from the first half of observations to the second, and the path integral."""

    def one(p, q, _):
        half = len(p) // 2
        if half < 1:
            return {"cv": None, "ev": None, "cv_path": None}
        return single.variation(p[:half], q[:half], p[half:], q[half:]) | {"cv_path": single.vartia(p[:half], q[:half], p[half:])}

    return each_user(rows, "cv double, ev double, cv_path double", one, 0)


def quasilinear(rows: DataFrame) -> DataFrame:
    """Whether no cycle of any length saves money."""
    return each_user(rows, "is_quasilinear boolean", lambda p, q, _: {"is_quasilinear": demand.quasilinear(p, q)}, 0)


def stone_geary(rows: DataFrame) -> DataFrame:
    """Subsistence quantity and share of each good."""

    def one(p, q):
        found = demand.stone_geary(p, q)
        return [(g, float(x), float(b), float(found["slutsky"][g, g])) for g, (x, b) in enumerate(zip(found["subsistence"], found["share"], strict=True))]

    return _rows(rows, "g int, subsistence double, share double, own_effect double", one)


def two_stage_effects(rows: DataFrame) -> DataFrame:
    """Elasticities with lagged prices as instruments."""
    return _rows(rows, "g int, h int, elasticity double", lambda p, q: [(g, h, None if x != x else float(x)) for (g, h), x in np.ndenumerate(demand.two_stage(p, q))])


def slutsky_bootstrap(rows: DataFrame, n: int = 100, seed: int = 42) -> DataFrame:
    return each_user(rows, "max_eigenvalue double, std double, p_value double", lambda p, q, chance: demand.slutsky_bootstrap(p, q, n, chance), seed)


def additive_groups(rows: DataFrame, threshold: float = 0.1) -> DataFrame:
    def one(p, q):
        beta, _ = single.regress(np.log(np.maximum(q, 1e-10)), np.log(p))
        return list(enumerate(demand.additive_groups(beta.T, threshold)))

    return _rows(rows, "part int, goods array<int>", one)


def spatial(menus: DataFrame, items: DataFrame, norms: tuple[float, ...] = (1.0, 2.0, float("inf"))) -> DataFrame:
    """For each user and norm the choices that its ideal point fails, and the norm with the fewest."""
    matrix, place = _features(items)
    slim = menus.select("user_id", F.transform("obs", lambda o: o["menu"]).alias("menus"), F.transform("obs", lambda o: o["choice"]).alias("choices"))

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for user, m, c in zip(frame["user_id"], frame["menus"], frame["choices"], strict=True):
                m, c = [[place[i] for i in x] for x in m], [place[i] for i in c]
                fails = [demand.metric_violations(matrix, m, c, norm)[1] for norm in norms]
                points, left = demand.several_points(matrix, m, c)
                strength = demand.strengths(matrix, m, c, points[0])
                out.append((user, fails, float(norms[int(np.argmin(fails))]), left, float(np.mean(strength))))
            yield pd.DataFrame(out, columns=["user_id", "n_violations", "best_norm", "n_violations_two_points", "mean_strength"])

    return slim.mapInPandas(run, "user_id string, n_violations array<int>, best_norm double, n_violations_two_points int, mean_strength double")


def _features(items: DataFrame) -> tuple[np.ndarray, dict[int, int]]:
    """Features of at most MAX_ITEMS items, for the workers."""
    found = items.select("item", "x").limit(MAX_ITEMS + 1).collect()
    if len(found) > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} items")
    return np.array([r["x"] for r in found], float), {r["item"]: k for k, r in enumerate(found)}


def ideal_points(menus: DataFrame, items: DataFrame) -> DataFrame:
    """An ideal point of each user and the choices it fails: menu rows (user_id, obs), items (item, x: array).

    The features are sent to all workers, behind a check of their size.
    """
    matrix, place = _features(items)
    slim = menus.select("user_id", F.transform("obs", lambda o: o["menu"]).alias("menus"), F.transform("obs", lambda o: o["choice"]).alias("choices"))

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for user, m, c in zip(frame["user_id"], frame["menus"], frame["choices"], strict=True):
                point, fails = single.ideal_point(matrix, [[place[i] for i in x] for x in m], [place[i] for i in c])
                out.append((user, point.tolist(), fails, len(c)))
            yield pd.DataFrame(out, columns=["user_id", "point", "n_violations", "n_choices"])

    return slim.mapInPandas(run, "user_id string, point array<double>, n_violations int, n_choices int")


def euclidean(menus: DataFrame, items: DataFrame) -> DataFrame:
    """Whether any ideal point explains all of a user's choices, and by how much the worst combination of them fails."""
    matrix, place = _features(items)
    slim = menus.select("user_id", F.transform("obs", lambda o: o["menu"]).alias("menus"), F.transform("obs", lambda o: o["choice"]).alias("choices"))

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(user, *single.euclidean(matrix, [[place[i] for i in x] for x in m], [place[i] for i in c])) for user, m, c in zip(frame["user_id"], frame["menus"], frame["choices"], strict=True)]
            yield pd.DataFrame(out, columns=["user_id", "is_rational", "violation"])

    return slim.mapInPandas(run, "user_id string, is_rational boolean, violation double")


#: Items whose features go to every worker, at most.
MAX_ITEMS = 100_000
