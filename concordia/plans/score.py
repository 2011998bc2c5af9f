"""Plans that score users: one row in, one row out, in Arrow batches through the batched kernels.

Users are grouped by the shape of their data within a batch, so NumPy works on many users
at a time.  There is one shuffle before, by user, and none after.
"""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia import errors
from concordia.functions import kernels, search
from concordia.schema import BUDGET, MENU, METRICS, STOCHASTIC, TOLERANCE, ddl

#: Cells of a batch of cost matrices.
CELLS = 2_000_000
#: Items up to which all orders are tried; up to which the best order to add is found among all.
ALL_ORDERS_UP_TO, PRICED_UP_TO = 6, 14

_ARROW = {"boolean": pa.bool_(), "int": pa.int32(), "double": pa.float64(), "bigint": pa.int64()}


def check_metrics(metrics) -> tuple[str, ...]:
    unknown = sorted(set(metrics) - set(METRICS))
    if unknown:
        raise errors.MetricError(f"unknown metrics: {', '.join(unknown)}; known are {', '.join(METRICS)}")
    return tuple(metrics)


def budget_scores(p: np.ndarray, q: np.ndarray, metrics: tuple[str, ...], tol: float = TOLERANCE, search_nodes: int | None = search.BUDGET) -> dict[str, np.ndarray | list]:
    """All columns of BUDGET for users of one shape."""
    began = time.perf_counter()
    users, n = p.shape[:2]
    cost, own = kernels.costs(p, q)
    weak, strict = kernels.relations(cost, own, tol=tol)
    reach = kernels.closure(weak)
    bad = kernels.violations(reach, strict)
    _, n_scc, max_scc = kernels.components(reach)
    fine = bad == 0
    one, zero, none = np.ones(users), np.zeros(users), [None] * users
    out = {
        "is_garp": fine, "n_violations": bad, "n_scc": n_scc, "max_scc": max_scc, "scc_mean_size": n / n_scc, "harp_severity": one,
        "ccei": kernels.ccei(cost, own, fine, tol) if "ccei" in metrics else one,
        "mpi": kernels.mpi(cost, own, weak, fine) if "mpi" in metrics else zero,
        "is_harp": kernels.harp(cost, own, weak, tol) if "harp" in metrics else none,
        "utility_success": fine if "utility" in metrics else none,
        "hm_consistent": none, "hm_total": none, "is_hm_exact": none, "is_vei_exact": none,
    }
    if "hm" in metrics:
        out["hm_consistent"], out["is_hm_exact"] = zip(*[(n, True) if fine[u] else search.largest_consistent(weak[u], strict[u], search_nodes) for u in range(users)], strict=True) if users else ((), ())
        out["hm_total"] = [n] * users
    levels = {"vei": np.ones((users, n)), "vei_exact": np.ones((users, n))}
    if "vei" in metrics:
        levels["vei"] = kernels.varian_levels(cost, own, fine)
    if "vei_exact" in metrics:
        out["is_vei_exact"] = [True] * users
        for u in np.flatnonzero(~fine):
            levels["vei_exact"][u], out["is_vei_exact"][u] = search.cheapest_cut(cost[u], own[u], search_nodes)
    for name, level in levels.items():
        # levels that weren't asked for are all one
        out |= {f"{name}_{k}": v for k, v in (kernels.spread(level) if name in metrics else {"mean": one, "min": one, "std": zero, "q25": one, "q75": one}).items()}
    network = kernels.degrees(weak) if "network" in metrics else dict.fromkeys(("r_density", "r_out_degree_std", "degree_gini"), zero)
    # log weights belong to the ratio test: they are there if both are asked for
    network |= kernels.weights(cost, own, weak, tol) if {"network", "harp"} <= set(metrics) else dict.fromkeys(("ew_mean", "ew_std", "ew_skew"), zero)
    return out | network | {"compute_time_us": np.full(users, int((time.perf_counter() - began) * 1e6 / users))}


def menu_scores(rows: list[tuple[list[list[int]], list[int]]], n_items: int, count: str = "items") -> dict[str, np.ndarray | list]:
    """All columns of MENU for users with items 0 to n_items - 1; ``count``: what hm counts, items or observations."""
    direct = kernels.menu_relation(rows, n_items)
    out = relation_scores(direct, np.array([len(set(c)) / max(1, len(c)) for _, c in rows]))
    if count == "observations":
        kept = [observations_kept(menus, choices, direct[u]) for u, (menus, choices) in enumerate(rows)]
        out |= {"hm_consistent": kept, "hm_total": [len(c) for _, c in rows]}
    return out


def relation_scores(direct: np.ndarray, diversity: np.ndarray) -> dict[str, np.ndarray | list]:
    """All columns of MENU from the direct relations of users with one number of items."""
    began = time.perf_counter()
    users, n_items = direct.shape[:2]
    reach = kernels.closure(direct)
    labels, n_scc, max_scc = kernels.components(reach)
    upper = np.triu(np.ones((n_items, n_items), dtype=bool), 1)
    sarp = (reach & reach.transpose(0, 2, 1) & upper).sum(axis=(1, 2))
    warp = (direct & direct.transpose(0, 2, 1) & upper).sum(axis=(1, 2))
    sizes = np.bincount((labels + np.arange(users)[:, None] * n_items).ravel(), minlength=users * n_items).reshape(users, n_items)
    out_degree = direct.sum(axis=2)
    edges = out_degree.sum(axis=1)
    share = out_degree / np.maximum(1, edges)[:, None]
    entropy = -np.where(share > 0, share * np.log2(np.where(share > 0, share, 1)), 0).sum(axis=1)
    return {
        "is_sarp": sarp == 0, "is_warp": warp == 0, "is_warp_la": kernels.limited_attention(direct), "n_sarp_violations": sarp, "n_warp_violations": warp,
        "hm_consistent": n_items - (sizes // 2).sum(axis=1), "hm_total": np.full(users, n_items), "max_scc": max_scc, "n_scc": n_scc, "r_density": edges / max(1, n_items * (n_items - 1)),
        "pref_entropy": np.abs(entropy), "choice_diversity": diversity, "compute_time_us": np.full(users, int((time.perf_counter() - began) * 1e6 / max(1, users))),
    }


def observations_kept(menus: list[list[int]], choices: list[int], direct: np.ndarray) -> int:
    """Observations left when those go that put a removed item above others; items go by degree inside cycles."""
    alive = np.ones(len(direct), dtype=bool)
    gone = np.zeros(len(direct), dtype=bool)
    while True:
        keep = np.flatnonzero(alive)
        if not len(keep):
            break
        part = direct[np.ix_(keep, keep)]
        reach = kernels.closure(part[None])[0]
        mutual = reach & reach.T & ~np.eye(len(keep), dtype=bool)
        if not mutual.any():
            break
        degree = np.where(mutual.any(axis=1), ((part | part.T) & mutual).sum(axis=1) + (part & part.T & mutual).sum(axis=1), -1)
        item = keep[int(degree.argmax())]
        alive[item], gone[item] = False, True
    return sum(not (gone[c] and len(set(m)) > 1) for m, c in zip(menus, choices, strict=True))


_NUMPY = {"boolean": np.bool_, "int": np.int32, "double": np.float64, "bigint": np.int64}


def _batch(ids: pa.Array, columns: tuple[tuple[str, str], ...], values: dict[str, list | pa.Array]) -> pa.RecordBatch:
    arrays = [values[name] if isinstance(values[name], pa.Array) else pa.array([v if v is None else v.item() if isinstance(v, np.generic) else v for v in values[name]], _ARROW[kind]) for name, kind in columns]
    return pa.RecordBatch.from_arrays([ids, *arrays], ["user_id", *(name for name, _ in columns)])


def _gather(columns, n: int, parts: Iterable[tuple[np.ndarray, dict]]) -> dict[str, pa.Array]:
    """The columns of n users from parts (places of users, their values): arrays are put in at once, lists with gaps one by one."""
    held = {name: (np.zeros(n, dtype=_NUMPY[kind]), np.zeros(n, dtype=bool)) for name, kind in columns}
    for users, found in parts:
        for name, _ in columns:
            values, (out, known) = found[name], held[name]
            if isinstance(values, np.ndarray):
                out[users], known[users] = values, True
            elif values and values.count(None) < len(values):
                for u, v in zip(users, values, strict=True):
                    if v is not None:
                        out[u], known[u] = v, True
    return {name: pa.array(held[name][0], _ARROW[kind], mask=~held[name][1]) for name, kind in columns}


def score_budget(rows: DataFrame, metrics=("garp", "ccei", "mpi"), tol: float = TOLERANCE, *, search_nodes: int | None = search.BUDGET) -> DataFrame:
    """user_id and the columns of BUDGET from budget rows (user_id, obs).

    ``hm`` and ``vei_exact`` search at most ``search_nodes`` nodes for each component of a user's graph (none: to the end) and say whether that was enough.
    """
    metrics = check_metrics(metrics)
    return by_shape(rows, BUDGET, lambda p, q: budget_scores(p, q, metrics, tol, search_nodes))


#: Variants of consistency: strict acyclicity, cycles of strict preference only, and the dual test on prices.
VARIANTS = (("n_sarp", "int"), ("n_acyclical_p", "int"), ("n_gapp", "int"), ("is_sarp", "boolean"), ("is_acyclical_p", "boolean"), ("is_gapp", "boolean"), ("is_differentiable", "boolean"))


def variant_scores(p: np.ndarray, q: np.ndarray, tol: float = TOLERANCE) -> dict[str, np.ndarray]:
    """Columns of VARIANTS for users of one shape."""
    n = p.shape[1]
    cost, own = kernels.costs(p, q)
    weak, strict = kernels.relations(cost, own, tol=tol)
    upper = np.triu(np.ones((n, n), dtype=bool), 1)
    reach = kernels.closure(weak)
    sarp = (reach & reach.transpose(0, 2, 1) & upper).sum(axis=(1, 2))
    through = kernels.closure(strict)
    loops = (through & through.transpose(0, 2, 1)).sum(axis=(1, 2)) - n
    # prices s are better than t if bundle t is cheaper at them
    cheaper = cost <= own[:, None, :] + tol
    much = (cost < own[:, None, :] - tol) & ~np.eye(n, dtype=bool)
    gapp = (kernels.closure(cheaper) & much.transpose(0, 2, 1)).sum(axis=(1, 2))
    same_bundle = (np.abs(q[:, :, None, :] - q[:, None, :, :]) <= 1e-9).all(axis=3) & upper
    other_prices = (np.abs(p[:, :, None, :] - p[:, None, :, :]) > 1e-9).any(axis=3)
    kinks = (same_bundle & other_prices).any(axis=(1, 2))
    return {"n_sarp": sarp, "n_acyclical_p": loops, "n_gapp": gapp, "is_sarp": sarp == 0, "is_acyclical_p": loops == 0, "is_gapp": gapp == 0, "is_differentiable": (sarp == 0) & ~kinks}


def score_variants(rows: DataFrame, tol: float = TOLERANCE) -> DataFrame:
    """user_id and the columns of VARIANTS from budget rows."""
    return by_shape(rows, VARIANTS, lambda p, q: variant_scores(p, q, tol))


#: Columns of the test of quasilinear utility.
QUASILINEAR = (("two_cycles", "bigint"), ("three_cycles", "bigint"), ("is_quasilinear", "boolean"))


def quasilinear_scores(p: np.ndarray, q: np.ndarray, tol: float = TOLERANCE) -> dict[str, np.ndarray]:
    """Cycles of two and three observations along which swapping bundles saves money, for users of one shape."""
    cost, own = kernels.costs(p, q)
    gain = cost - own[:, :, None]
    n = gain.shape[1]
    upper = np.triu(np.ones((n, n), dtype=bool), 1)
    two = ((gain + gain.transpose(0, 2, 1) < -tol) & upper).sum(axis=(1, 2))
    three = np.zeros(len(p), dtype=np.int64)
    for i in range(n - 2):
        # from the least observation of a cycle over two later ones, either way round
        rest = gain[:, i, i + 1 :, None] + gain[:, i + 1 :, i + 1 :] + gain[:, None, i + 1 :, i]
        three += ((rest < -tol) & ~np.eye(n - i - 1, dtype=bool)).sum(axis=(1, 2))
    return {"two_cycles": two, "three_cycles": three, "is_quasilinear": (two + three) == 0}


def score_quasilinear(rows: DataFrame, tol: float = TOLERANCE) -> DataFrame:
    """user_id and the columns of QUASILINEAR from budget rows."""
    return by_shape(rows, QUASILINEAR, lambda p, q: quasilinear_scores(p, q, tol))


#: Columns of a firm's score.
FIRM = (("is_garp", "boolean"), ("n_violations", "int"), ("ccei", "double"), ("max_scc", "int"))


def score_firms(rows: DataFrame, tol: float = TOLERANCE) -> DataFrame:
    """user_id and the columns of FIRM from rows (user_id, obs: array of (t, ip, iq, op, oq)): the budget tests on profits at own prices."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for obs in batch.column(1).to_pylist():
                ip, iq, op, oq = (np.array([o[k] for o in obs], float) for k in ("ip", "iq", "op", "oq"))
                profit = (op @ oq.T - ip @ iq.T)[None]
                own = np.einsum("uii->ui", profit).copy()
                weak, strict = kernels.relations(profit, own, tol=tol)
                reach = kernels.closure(weak)
                bad = kernels.violations(reach, strict)
                found.append({"is_garp": bool(bad[0] == 0), "n_violations": int(bad[0]), "ccei": float(kernels.ccei(profit, own, bad == 0, tol)[0]), "max_scc": int(kernels.components(reach)[2][0])})
            yield _batch(batch.column(0), FIRM, {name: [f[name] for f in found] for name, _ in FIRM})

    return rows.select("user_id", "obs").mapInArrow(run, f"user_id string, {ddl(FIRM)}")


def by_shape(rows: DataFrame, columns: tuple[tuple[str, str], ...], score) -> DataFrame:
    """``score(p, q)`` for users of one number of observations and goods at a time, in batches of bounded size."""
    slim = rows.select("user_id", F.transform("obs", lambda o: o["p"]).alias("p"), F.transform("obs", lambda o: o["q"]).alias("q"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("p", "q"):
                column = batch.column(batch.schema.get_field_index(name))
                inner = column.values
                sides.append((np.asarray(column.offsets).astype(np.int64), np.asarray(inner.offsets).astype(np.int64), inner.values.to_numpy(zero_copy_only=False).astype(float)))
            (outer, inner, _), (outer_q, inner_q, _) = sides
            times = np.diff(outer)
            lengths, lengths_q = np.diff(inner)[outer[0] : outer[-1]], np.diff(inner_q)[outer_q[0] : outer_q[-1]]
            goods = np.zeros(len(times), dtype=np.int64)
            goods[times > 0] = lengths[(outer[:-1] - outer[0])[times > 0]]
            owner = np.repeat(np.arange(len(times)), times)
            unlike = np.flatnonzero((lengths != goods[owner]) | (lengths_q != goods[owner])) if (np.diff(outer_q) == times).all() else np.zeros(1, np.int64)
            if len(unlike):
                raise errors.DataError(f"user {batch.column(0)[int(owner[unlike[0]])]} has observations with different numbers of goods")

            def parts(sides=sides, times=times, goods=goods):
                for n, k in np.unique(np.stack([times, goods], axis=1), axis=0).tolist():
                    users = np.flatnonzero((times == n) & (goods == k))
                    step = max(1, CELLS // max(1, n * n))
                    for at in range(0, len(users), step):
                        some = users[at : at + step]
                        p, q = (v[i[o[some]][:, None] + np.arange(n * k)].reshape(len(some), n, k) if n else None for o, i, v in sides)
                        yield some, score(p, q) if n else dict.fromkeys((c for c, _ in columns), [None] * len(some))

            yield _batch(batch.column(0), columns, _gather(columns, batch.num_rows, parts()))

    return slim.mapInArrow(run, f"user_id string, {ddl(columns)}")


def score_menu(rows: DataFrame, *, count: str = "items") -> DataFrame:
    """user_id and the columns of MENU from menu rows (user_id, obs)."""
    slim = rows.select("user_id", F.transform("obs", lambda o: o["menu"]).alias("menus"), F.transform("obs", lambda o: o["choice"]).alias("choices"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            menus, choices = batch.column(1), batch.column(2)
            outer, inner = np.asarray(menus.offsets), np.asarray(menus.values.offsets)
            users = np.arange(batch.num_rows)
            of_menu = np.repeat(users, np.diff(outer))
            inner = inner[outer[0] : outer[-1] + 1]
            items = np.asarray(menus.values.values)[inner[0] : inner[-1]].astype(np.int64)
            menu_of = np.repeat(np.arange(len(of_menu)), np.diff(inner))
            taken = np.asarray(choices.values)[np.asarray(choices.offsets)[0] : np.asarray(choices.offsets)[-1]].astype(np.int64)
            # items of each user as 0, 1, …
            known, place = np.unique((of_menu[menu_of] << 32) + items, return_inverse=True)
            sizes = np.bincount(known >> 32, minlength=len(users))
            first = np.cumsum(sizes) - sizes
            place = place - first[of_menu[menu_of]]
            chosen = np.searchsorted(known, (of_menu << 32) + taken) - first[of_menu]
            distinct = np.bincount(np.unique((of_menu << 32) + taken) >> 32, minlength=len(users))
            diversity = distinct / np.maximum(1, np.diff(outer))

            def parts(of_item=of_menu[menu_of], place=place, chosen=chosen[menu_of], sizes=sizes, diversity=diversity, batch=batch):
                for n in np.unique(sizes).tolist():
                    mine = np.flatnonzero(sizes == n)
                    step = max(1, CELLS // max(1, n * n))
                    for at in range(0, len(mine), step):
                        some = mine[at : at + step]
                        row = np.full(len(sizes), -1)
                        row[some] = np.arange(len(some))
                        use = row[of_item] >= 0
                        direct = np.zeros((len(some), n, n), dtype=bool)
                        direct[row[of_item[use]], chosen[use], place[use]] = True
                        direct[:, np.arange(n), np.arange(n)] = False
                        found = relation_scores(direct, diversity[some])
                        if count == "observations":
                            index = [{i: k for k, i in enumerate(sorted({i for m in batch.column(1)[u].as_py() for i in m}))} for u in some.tolist()]
                            kept = [observations_kept([[x[i] for i in m] for m in batch.column(1)[u].as_py()], [x[c] for c in batch.column(2)[u].as_py()], d) for u, x, d in zip(some.tolist(), index, direct, strict=True)]
                            found |= {"hm_consistent": kept, "hm_total": [len(batch.column(2)[u]) for u in some.tolist()]}
                        yield some, found

            yield _batch(batch.column(0), MENU, _gather(MENU, batch.num_rows, parts()))

    return slim.mapInArrow(run, f"user_id string, {ddl(MENU)}")


def best_order(sets: list[int], credit: np.ndarray, cells: list[tuple[int, int]], n: int) -> tuple[float, tuple[int, ...]]:
    """The order of n items of greatest credit, by dynamic programming over the sets of items placed first: a menu (bits) pays for the first of its items."""
    size = 1 << n
    masks = np.arange(size)
    gain = np.zeros((n, size))
    for (k, i), value in zip(cells, credit, strict=True):
        gain[i] += np.where(masks & sets[k] == 0, value, 0.0)
    total, last = np.full(size, -np.inf), np.zeros(size, dtype=np.int8)
    total[0] = 0.0
    count = np.zeros(size, dtype=np.int8)
    for u in range(n):
        count[1 << u : 2 << u] = count[: 1 << u] + 1
    by_size = np.argsort(count, kind="stable")
    ends = np.searchsorted(count[by_size], np.arange(n + 2))
    for k in range(n):
        before = by_size[ends[k] : ends[k + 1]]
        for v in range(n):
            some = before[(before >> v) & 1 == 0]
            after, value = some | (1 << v), total[some] + gain[v, some]
            better = value > total[after]
            total[after[better]], last[after[better]] = value[better], v
    order, left = [], size - 1
    while left:
        order.append(int(last[left]))
        left ^= 1 << order[-1]
    return float(total[-1]), tuple(order[::-1])


def random_utility(menus: list[list[int]], counts: list[list[int]], seed: int = 0) -> dict[str, object]:
    """Whether shares are a mixture of orders: the least total deviation over mixtures, by linear programming.

    Up to six items all orders are tried.  Beyond, orders are added while the dual prices of
    the shares find one that lowers the deviation: the best one of all orders up to
    PRICED_UP_TO items, so that the end is proven; with more items by swaps from seeded orders, and
    a deviation that stays is then marked as not exact.
    """
    items = sorted({i for m in menus for i in m})
    at = {i: k for k, i in enumerate(items)}
    cells = [(k, at[i]) for k, m in enumerate(menus) for i in m]
    share = np.array([c / max(1, sum(counts[k])) for k, m in enumerate(menus) for c in counts[k]])
    sets = [set(m) for m in menus]
    bits = [sum(1 << at[i] for i in m) for m in sets]

    def columns(orders: list[tuple[int, ...]]) -> np.ndarray:
        """Of every order (of places of items) which cells it chooses."""
        places = np.argsort(np.array(orders, dtype=int).reshape(len(orders), len(items)), axis=1)
        best = [np.array(sorted(at[i] for i in m))[places[:, sorted(at[i] for i in m)].argmin(axis=1)] for m in sets]
        return np.array([best[k] == i for k, i in cells], dtype=float).reshape(len(cells), len(orders))

    def solve(orders: list[tuple[int, ...]]) -> tuple[float, np.ndarray, np.ndarray]:
        a = columns(orders)
        m, n = a.shape
        full = np.zeros((m + 1, n + 2 * m))
        full[:m, :n], full[:m, n : n + m], full[:m, n + m :], full[m, :n] = a, np.eye(m), -np.eye(m), 1
        _, value, x, price = search.simplex_with_duals(np.concatenate([np.zeros(n), np.ones(2 * m)]), full, np.append(share, 1.0))
        return value, x[:n], price

    n, exact = len(items), True
    if n <= ALL_ORDERS_UP_TO:
        orders = list(permutations(range(n)))
        value, weight, _ = solve(orders)
        rounds = 1
    else:
        chance = np.random.default_rng(seed)
        score = np.zeros(n)
        np.add.at(score, [i for _, i in cells], [c for cs in counts for c in cs])
        first = tuple(np.argsort(-score, kind="stable").tolist())
        orders = [first, first[::-1]]
        value, weight, price = solve(orders)
        rounds = 0
        while value > 1e-9:
            rounds += 1
            if n <= PRICED_UP_TO:
                best, order = best_order(bits, price[:-1], cells, n)
            else:
                best, order = _order_by_swaps(lambda o: float(columns([o])[:, 0] @ price[:-1]), first, chance)
            # a column lowers the deviation if its credit exceeds the price of the weights' sum
            if best + price[-1] <= 1e-9 or order in orders:
                exact = n <= PRICED_UP_TO or value <= 1e-6
                break
            orders.append(order)
            value, weight, price = solve(orders)
    irregular = 0
    for a in range(len(menus)):
        for b in range(len(menus)):
            if a != b and sets[a] < sets[b]:
                small = {i: c / max(1, sum(counts[a])) for i, c in zip(menus[a], counts[a], strict=True)}
                irregular += sum(c / max(1, sum(counts[b])) > small[i] + 1e-10 for i, c in zip(menus[b], counts[b], strict=True) if i in small)
    return {
        "is_consistent": value <= 1e-6, "is_regular": irregular == 0, "distance": max(0.0, value) if value > 1e-6 else 0.0, "n_orderings": int((weight > 1e-9).sum()),
        "n_violations": irregular, "n_iterations": rounds, "is_exact": exact, "weights": {tuple(items[k] for k in o): float(w) for o, w in zip(orders, weight, strict=True) if w > 1e-9},
    }


def _order_by_swaps(credit, first: tuple[int, ...], chance: np.random.Generator, starts: int = 4) -> tuple[float, tuple[int, ...]]:
    """An order that no swap of neighbours betters, the best from the first order and seeded ones."""
    found: list[tuple[float, tuple[int, ...]]] = []
    for start in range(starts):
        order = tuple(chance.permutation(first).tolist()) if start else first
        now, moved = credit(order), True
        while moved:
            moved = False
            for a in range(len(order) - 1):
                other = (*order[:a], order[a + 1], order[a], *order[a + 2 :])
                if (then := credit(other)) > now + 1e-12:
                    order, now, moved = other, then, True
        found.append((now, order))
    return max(found)


def score_stochastic(rows: DataFrame) -> DataFrame:
    """user_id and the columns of STOCHASTIC from rows (user_id, obs: array of (menu, counts))."""
    slim = rows.select("user_id", F.transform("obs", lambda o: o["menu"]).alias("menus"), F.transform("obs", lambda o: o["counts"]).alias("counts"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for menus, counts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                began = time.perf_counter()
                found.append(random_utility(menus, counts) | {"compute_time_us": int((time.perf_counter() - began) * 1e6)})
            yield _batch(batch.column(0), STOCHASTIC, {name: [f[name] for f in found] for name, _ in STOCHASTIC})

    return slim.mapInArrow(run, f"user_id string, {ddl(STOCHASTIC)}")
