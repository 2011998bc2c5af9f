"""Kernels for one decision maker's menus, frequencies, rankings and lotteries."""

from __future__ import annotations

import math
from itertools import combinations, permutations

import numpy as np

from concordia.functions import kernels, search

#: Items up to which all orders are tried, and up to which they are counted through subsets.
ALL_ORDERS_UP_TO, ORDERS_UP_TO = 6, 20
#: Items of a majority cycle up to which an order is searched through all subsets.
KEMENY_UP_TO = 16


def _index(menus: list[list[int]]) -> dict[int, int]:
    return {item: k for k, item in enumerate(sorted({i for m in menus for i in m}))}


def direct(menus: list[list[int]], choices: list[int]) -> tuple[list[int], np.ndarray]:
    """The items, and which of them were chosen over which."""
    index = _index(menus)
    rows = [([[index[i] for i in m] for m in menus], [index[c] for c in choices])]
    return list(index), kernels.menu_relation(rows, len(index))[0]


def order_of(relation: np.ndarray) -> list[int] | None:
    """An order that respects a relation, least number first where it leaves a choice; none if it has a cycle."""
    left, out = relation.copy(), []
    np.fill_diagonal(left, False)
    alive = np.ones(len(relation), dtype=bool)
    while alive.any():
        free = np.flatnonzero(alive & ~(left & alive[:, None]).any(axis=0))
        if not len(free):
            return None
        out.append(int(free[0]))
        alive[free[0]] = False
    return out


def preferences(menus: list[list[int]], choices: list[int]) -> dict[str, object]:
    """An order of the items from best to worst and utilities n - rank, if choices have one."""
    items, d = direct(menus, choices)
    order = order_of(d)
    if order is None:
        return {"success": False, "order": [], "utility": {}}
    ranked = [items[k] for k in order]
    return {"success": True, "order": ranked, "utility": {i: len(ranked) - k for k, i in enumerate(ranked)}}


def maximal(menus: list[list[int]], choices: list[int]) -> int:
    """Observations whose menu holds an item indirectly above the choice, which isn't above it in turn."""
    items, d = direct(menus, choices)
    at = {i: k for k, i in enumerate(items)}
    reach = kernels.closure(d[None])[0]
    return sum(any(reach[at[i], at[c]] and not reach[at[c], at[i]] for i in m if i != c) for m, c in zip(menus, choices, strict=True))


def consideration(menus: list[list[int]], choices: list[int]) -> list[list[int]]:
    """Whole menus if choices have an order; else menus without the items revealed preferred to the choice."""
    items, d = direct(menus, choices)
    at = {i: k for k, i in enumerate(items)}
    if order_of(d) is not None:
        return [sorted(set(m)) for m in menus]
    return [sorted({i for i in m if i == c or not d[at[i], at[c]]}) for m, c in zip(menus, choices, strict=True)]


def filtered(menus: list[list[int]], choices: list[int], keep) -> bool:
    """Whether choices have an order when only the items that ``keep(menu)`` gives are considered; the choice has to be one."""
    seen = [sorted(set(keep(frozenset(m)))) for m in menus]
    if any(c not in s for s, c in zip(seen, choices, strict=True)):
        return False
    return order_of(direct(seen, choices)[1]) is not None


def limited_attention(menus: list[list[int]], choices: list[int]) -> dict[str, object]:
    """x is above y if x is chosen, but no longer once y is taken from the menu; whether that has an order, and one."""
    by_menu = {frozenset(m): c for m, c in zip(menus, choices, strict=True)}
    items = sorted({i for m in menus for i in m})
    at = {i: k for k, i in enumerate(items)}
    above = np.zeros((len(items), len(items)), dtype=bool)
    for m, c in by_menu.items():
        for y in m:
            if y != c and by_menu.get(m - {y}, c) != c:
                above[at[c], at[y]] = True
    order = order_of(above)
    return {"success": order is not None, "order": [items[k] for k in order or []], "relation": [(items[a], items[b]) for a, b in np.argwhere(above).tolist()]}


def monotone_attention(menus: list[list[int]], shares: list[dict[int, float]], tol: float = 1e-9) -> dict[str, object]:
    """Orders that monotone random attention allows.

    An order is ruled out by an item a better one of which leaves the menu and that is
    then chosen less often: attention to a set can't fall when other items go.
    """
    items = sorted({i for m in menus for i in m})
    by_menu = {frozenset(m): s for m, s in zip(menus, shares, strict=True)}
    # x in a menu, y another: x chosen more often with y there than without means x is above y
    above = {(x, y) for m, s in by_menu.items() for y in m if m - {y} in by_menu for x in m - {y} if s.get(x, 0) > by_menu[m - {y}].get(x, 0) + tol}
    n, first = orders_of(items, above)
    return {"is_consistent": n > 0, "n_orders": n, "order": first}


def orders_of(items: list[int], above: set[tuple[int, int]]) -> tuple[int, list[int]]:
    """How many orders keep all pairs (x above y), by dynamic programming over subsets, and the first of them (least items first)."""
    at = {i: k for k, i in enumerate(items)}
    need = [sum(1 << at[x] for x, y in above if y == i) for i in items]
    n = len(items)
    if n > ORDERS_UP_TO:
        raise ValueError(f"more than {ORDERS_UP_TO} items")
    ways = [0] * (1 << n)
    ways[0] = 1
    for mask in range(1 << n):
        if ways[mask]:
            for k in range(n):
                if not mask >> k & 1 and need[k] & ~mask == 0:
                    ways[mask | 1 << k] += ways[mask]
    relation = np.zeros((n, n), dtype=bool)
    for x, y in above:
        relation[at[x], at[y]] = True
    order = order_of(relation)
    return ways[-1], [items[k] for k in order or []]


def attention_distance(menus: list[list[int]], shares: list[dict[int, float]], order: list[int]) -> float:
    """Mean square by which an item is chosen less often than the next one below it in the order, over menus."""
    place = {i: k for k, i in enumerate(order)}
    gaps = []
    for m, s in zip(menus, shares, strict=True):
        ranked = sorted(m, key=place.__getitem__)
        gaps += [max(0.0, s.get(y, 0.0) - s.get(x, 0.0)) ** 2 for x, y in zip(ranked, ranked[1:], strict=False)]
    return sum(gaps) / len(gaps) if gaps else 0.0


def random_attention(menus: list[list[int]], shares: list[dict[int, float]], alpha: float = 0.05, draws: int = 1000, seed: int = 0) -> dict[str, object]:
    """Orders under which no item is never chosen from a menu of which a worse one is; the first one's distance, and the share of orders at least as distant.

    The share is over all orders of up to ALL_ORDERS_UP_TO items, else over ``draws`` seeded ones.  Data are
    consistent if an order fits and its distance is 0 or that share exceeds ``alpha``.
    """
    items = sorted({i for m in menus for i in m})
    seen = [(m, s) for m, s in zip(menus, shares, strict=True) if sum(s.values()) > 0]
    above = {(x, y) for m, s in seen for x in m for y in m if s.get(x, 0) > 0 and not s.get(y, 0)}
    n, first = orders_of(items, above)
    if not n:
        return {"is_consistent": False, "n_orders": 0, "order": [], "statistic": 1.0, "p_value": 0.0}
    menus, shares = [m for m, _ in seen], [s for _, s in seen]
    own = attention_distance(menus, shares, first)
    chance = np.random.default_rng(seed)
    others = permutations(items) if len(items) <= ALL_ORDERS_UP_TO else (chance.permutation(items).tolist() for _ in range(draws))
    as_far = [attention_distance(menus, shares, list(o)) >= own - 1e-12 for o in others]
    p = sum(as_far) / len(as_far)
    return {"is_consistent": own < 1e-6 or p > alpha, "n_orders": n, "order": first, "statistic": own, "p_value": p}


def logit(menus: list[list[int]], counts: list[list[int]], rounds: int = 2000, tol: float = 1e-10) -> dict[str, object]:
    """Logit utilities of largest likelihood (the least is 0), by minorising steps, with likelihood and criteria."""
    index = _index(menus)
    n = len(index)
    sets = [[index[i] for i in m] for m in menus]
    totals = [sum(c) for c in counts]
    won = np.zeros(n)
    for s, c in zip(sets, counts, strict=True):
        np.add.at(won, s, c)
    w = np.full(n, 1 / n)
    for _ in range(rounds):
        weight = np.zeros(n)
        for s, t in zip(sets, totals, strict=True):
            weight[s] += t / w[s].sum()
        new = np.maximum(np.where(weight > 0, won / np.maximum(weight, 1e-300), w), 1e-12)
        new /= new.sum()
        if np.abs(new - w).max() < tol:
            w = new
            break
        w = new
    likelihood = sum(c * math.log(w[i] / w[s].sum()) for s, cs in zip(sets, counts, strict=True) for i, c in zip(s, cs, strict=True) if c)
    free, total = n - 1, max(1, sum(totals))
    u = np.log(w)
    return {"utility": dict(zip(index, (u - u.min()).tolist(), strict=True)), "log_likelihood": likelihood, "aic": 2 * free - 2 * likelihood, "bic": free * math.log(total) - 2 * likelihood}


def kemeny(rankings: list[list[int]]) -> list[int]:
    """The order with the fewest disagreements with rankings (best first)."""
    items = sorted({i for r in rankings for i in r})
    at = {i: k for k, i in enumerate(items)}
    prefer = np.zeros((len(items), len(items)))
    for r in rankings:
        for a, b in combinations(r, 2):
            prefer[at[a], at[b]] += 1
    return consensus(items, prefer)


def consensus(items: list[int], prefer: np.ndarray) -> list[int]:
    """The order of items with the fewest disagreements over pairs."""
    return exact_consensus(items, prefer)[0]


def exact_consensus(items: list[int], prefer: np.ndarray) -> tuple[list[int], bool]:
    """The order with the fewest disagreements, and whether that is proven.

    Groups of items whose every member a majority puts before all of the others' follow each
    other in every such order, so each group of a majority cycle is ordered by itself: by
    dynamic programming over its subsets, or beyond KEMENY_UP_TO items by insertions while they help.
    """
    reach = kernels.closure((prefer >= prefer.T)[None])[0]
    labels = kernels.components(reach[None])[0][0]
    # of two groups one reaches the other, so the order is by how many are reached
    groups = sorted(np.unique(labels).tolist(), key=lambda x: -int(reach[x].sum()))
    out, proven = [], True
    for label in groups:
        nodes = np.flatnonzero(labels == label)
        part = prefer[np.ix_(nodes, nodes)]
        exact = len(nodes) <= KEMENY_UP_TO
        out += [items[nodes[k]] for k in (_order_by_subsets(part) if exact else _order_by_insertions(part))]
        proven &= exact
    return out, proven


def _order_by_subsets(prefer: np.ndarray) -> list[int]:
    n = len(prefer)
    size = 1 << n
    # what item k loses that stands behind the items of a subset
    behind, total, last, count = np.zeros((n, size)), np.full(size, np.inf), np.zeros(size, dtype=np.int8), np.zeros(size, dtype=np.int8)
    for u in range(n):
        half = 1 << u
        behind[:, half : 2 * half] = behind[:, :half] + prefer[:, u][:, None]
        count[half : 2 * half] = count[:half] + 1
    total[0] = 0
    by_size = np.argsort(count, kind="stable")
    ends = np.searchsorted(count[by_size], np.arange(n + 2))
    for k in range(n):
        before = by_size[ends[k] : ends[k + 1]]
        for v in range(n):
            some = before[(before >> v) & 1 == 0]
            after, cost = some | (1 << v), total[some] + behind[v, some]
            better = cost < total[after]
            total[after[better]], last[after[better]] = cost[better], v
    out, left = [], size - 1
    while left:
        out.append(int(last[left]))
        left ^= 1 << out[-1]
    return out[::-1]


def _order_by_insertions(prefer: np.ndarray) -> list[int]:
    order = np.argsort(-(prefer - prefer.T).sum(axis=1), kind="stable").tolist()
    moved = True
    while moved:
        moved = False
        for item in list(order):
            rest = [x for x in order if x != item]
            # losses of the item at each place: of those before it what it wins, of those behind what they win
            ahead = np.concatenate([[0.0], np.cumsum(prefer[item, rest])])
            back = np.concatenate([[0.0], np.cumsum(prefer[rest, item])])
            loss = ahead + back[-1] - back
            best, now = int(loss.argmin()), order.index(item)
            if loss[best] < loss[now] - 1e-12:
                order, moved = [*rest[:best], item, *rest[best:]], True
    return order


def dominated(outcomes: np.ndarray, probs: np.ndarray, chosen: int, tol: float = 1e-8) -> bool:
    """Whether another lottery of the choice first-order dominates the chosen one."""
    from concordia.functions.single import dominates

    return any(dominates(o, outcomes[chosen], probs, tol) for k, o in enumerate(outcomes) if k != chosen)


def expected_utility(choices: list[tuple[np.ndarray, np.ndarray, int]], attitude: str = "any", grid: int = 20, step: float = 0.01, tol: float = 1e-8) -> bool:
    """Whether an increasing utility (concave for ``averse``, convex for ``seeking``) makes every choice best.

    Piecewise-linear utilities on a grid of outcomes, by linear programming: increasing by
    ``step`` at least, with the slack that choices need brought to nothing.
    """
    if any(dominated(o, p, c, tol) for o, p, c in choices):
        return False
    if attitude == "neutral":
        return all((o[c] @ p >= (o @ p).max() - tol) for o, p, c in choices)
    low, high = min(o.min() for o, _, _ in choices), max(o.max() for o, _, _ in choices)
    if high - low < tol:
        return True
    at = np.linspace(low, high, grid)

    def weights(outcome: np.ndarray, p: np.ndarray) -> np.ndarray:
        place = np.clip((outcome - low) / (high - low) * (grid - 1), 0, grid - 1)
        k = np.minimum(place.astype(int), grid - 2)
        out = np.zeros(grid)
        np.add.at(out, k, p * (k + 1 - place))
        np.add.at(out, k + 1, p * (place - k))
        return out

    # utility as a sum of increases, each of ``step`` at least
    up = np.tril(np.ones((grid, grid - 1)), -1)
    rows = [(weights(o[c], p) - weights(x, p)) @ up for o, p, c in choices for k, x in enumerate(o) if k != c]
    if not rows:
        return True
    shape = np.zeros((0, grid - 1))
    if attitude in ("averse", "seeking"):
        sign = 1 if attitude == "averse" else -1
        shape = sign * (np.eye(grid - 1)[:-1] - np.eye(grid - 1)[1:])
    a = np.vstack([np.array(rows), shape])
    m = len(a)
    # a (x + step) - surplus + slack = 0 with the slack of choices minimised
    full = np.hstack([a, -np.eye(m), np.eye(m)])
    cost = np.concatenate([np.zeros(grid - 1 + m), np.ones(m)])
    status, value, _ = search.simplex(cost, full, -a @ np.full(grid - 1, step))
    return status == "optimal" and value <= 1e-6


def technical_efficiency(inputs: np.ndarray, outputs: np.ndarray, oriented: str = "output") -> np.ndarray:
    """Free-disposal efficiency of each observation: how far others with no more inputs made more, or with no fewer outputs used less."""
    n = len(inputs)
    out = np.ones(n)
    for i in range(n):
        if oriented == "output":
            able = (inputs <= inputs[i] + 1e-12).all(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where(outputs[i] > 0, outputs[able] / outputs[i], np.inf).min(axis=1)
            out[i] = 1 / max(1.0, ratio.max())
        else:
            able = (outputs >= outputs[i] - 1e-12).all(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where(inputs[i] > 0, inputs[able] / inputs[i], 0.0).max(axis=1)
            out[i] = min(1.0, ratio.min())
    return out
