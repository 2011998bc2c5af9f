"""Searches on one user's graph, for the few users that need them: hitting sets of cycles, and linear programs."""

from __future__ import annotations

import numpy as np

from concordia.functions import kernels

#: Nodes of a component's search tree before the best answer so far stands, marked as not exact.
BUDGET = 1500
#: Observations of a component up to which the largest consistent subset is searched; larger ones are greedy, marked likewise.
EXACT_UP_TO = 200
#: Observations of a component up to which the cheapest cut comes from orders of all its subsets, without a bound on nodes.
ORDERS_UP_TO = 16


def shortest_cycle(weak: np.ndarray, strict: np.ndarray, alive: np.ndarray) -> list[int] | None:
    """Nodes of a shortest cycle of weak preference that holds a strict step, among nodes alive."""
    best = None
    nodes = np.flatnonzero(alive)
    pairs = strict & weak.T & alive[:, None] & alive[None, :]
    if pairs.any():
        i, j = np.unravel_index(int(pairs.argmax()), pairs.shape)
        return [int(i), int(j)]
    for i, j in zip(*np.nonzero(strict & alive[:, None] & alive[None, :]), strict=True):
        # a path of weak steps from j back to i
        before, front = {int(j): None}, [int(j)]
        while front and int(i) not in before:
            if best is not None and len(before) and _depth(before, front[0]) + 2 >= len(best):
                break
            after = []
            for u in front:
                for v in nodes[weak[u, nodes]]:
                    if int(v) not in before:
                        before[int(v)] = u
                        after.append(int(v))
            front = after
        if int(i) in before:
            path, at = [], int(i)
            while at is not None:
                path.append(at)
                at = before[at]
            if best is None or len(path) < len(best):
                best = path
                if len(best) == 3:
                    return best
    return best


def _depth(before: dict, node: int) -> int:
    n = 0
    while before[node] is not None:
        node, n = before[node], n + 1
    return n


def consistent(weak: np.ndarray, strict: np.ndarray, alive: np.ndarray) -> bool:
    keep = np.flatnonzero(alive)
    w, s = weak[np.ix_(keep, keep)][None], strict[np.ix_(keep, keep)][None]
    return not len(keep) or int(kernels.violations(kernels.closure(w), s)[0]) == 0


def greedy_subset(weak: np.ndarray, strict: np.ndarray) -> np.ndarray:
    """Which observations stay when the one with most relations inside a violating component goes, again and again."""
    alive = np.ones(len(weak), dtype=bool)
    while not consistent(weak, strict, alive):
        keep = np.flatnonzero(alive)
        w = weak[np.ix_(keep, keep)]
        labels = kernels.components(kernels.closure(w[None]))[0][0]
        inside = (labels[:, None] == labels[None, :]) & ~np.eye(len(keep), dtype=bool)
        bad = np.unique(labels[(inside & strict[np.ix_(keep, keep)]).any(axis=1)])
        degree = ((w | w.T) & inside).sum(axis=1) + ((w & w.T) & inside).sum(axis=1)
        degree = np.where(np.isin(labels, bad), degree, -1)
        alive[keep[int(degree.argmax())]] = False
    return alive


def _parts(arcs: np.ndarray) -> list[np.ndarray]:
    """Nodes of each component of more than one node: a cycle lies in one of them."""
    labels = kernels.components(kernels.closure(arcs[None]))[0][0]
    return [nodes for label in np.unique(labels) if len(nodes := np.flatnonzero(labels == label)) > 1]


def largest_consistent(weak: np.ndarray, strict: np.ndarray, budget: int | None = BUDGET) -> tuple[int, bool]:
    """Size of the largest subset of observations without violation, by component, and whether every search came to its end.

    Without a budget every component is searched to its end, whatever its size.
    """
    size, exact = len(weak), True
    for nodes in _parts(weak):
        kept, proven = _largest_of_component(weak[np.ix_(nodes, nodes)], strict[np.ix_(nodes, nodes)], budget)
        size -= len(nodes) - kept
        exact &= proven
    return size, exact


def _largest_of_component(weak: np.ndarray, strict: np.ndarray, budget: int | None) -> tuple[int, bool]:
    """Branch on the nodes of a shortest cycle."""
    n = len(weak)
    best = [int(greedy_subset(weak, strict).sum())]
    # nothing or one removed can't be beaten
    if budget is not None and n > EXACT_UP_TO or best[0] >= n - 1:
        return best[0], best[0] >= n - 1
    spent, stopped = [0], [False]

    def disjoint(alive: np.ndarray, enough: int) -> int:
        """How many cycles without common nodes there are at least: as many removals are needed."""
        left, found = alive.copy(), 0
        while found < enough and (cycle := shortest_cycle(weak, strict, left)):
            left[cycle] = False
            found += 1
        return found

    def branch(alive: np.ndarray, fixed: np.ndarray, size: int) -> None:
        if size <= best[0]:
            return
        if budget is not None and spent[0] > budget:
            stopped[0] = True
            return
        spent[0] += 1
        cycle = shortest_cycle(weak, strict, alive)
        if cycle is None:
            best[0] = size
            return
        if size - disjoint(alive, size - best[0]) <= best[0]:
            return
        kept = fixed.copy()
        for node in cycle:
            if kept[node]:
                continue
            less = alive.copy()
            less[node] = False
            branch(less, kept, size - 1)
            kept[node] = True

    branch(np.ones(n, dtype=bool), np.zeros(n, dtype=bool), n)
    return best[0], not stopped[0]


def exact_levels(cost: np.ndarray, own: np.ndarray, budget: int | None = BUDGET) -> np.ndarray:
    """Efficiency of each observation when the cheapest set of strict preferences is given up that breaks all cycles."""
    return cheapest_cut(cost, own, budget)[0]


def cheapest_cut(cost: np.ndarray, own: np.ndarray, budget: int | None = BUDGET) -> tuple[np.ndarray, bool]:
    """The levels of ``exact_levels``, by component, and whether every search came to its end."""
    n = len(cost)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(own[:, None] > 0, cost / own[:, None], np.inf)
    price = 1 - ratio
    arcs = (price > 1e-12) & ~np.eye(n, dtype=bool)
    level, exact = np.ones(n), True
    for nodes in _parts(arcs):
        search = _cut_by_orders if len(nodes) <= ORDERS_UP_TO else _cut_of_component
        cut, proven = search(arcs[np.ix_(nodes, nodes)], price[np.ix_(nodes, nodes)], budget)
        exact &= proven
        for i, j in cut:
            level[nodes[i]] = min(level[nodes[i]], ratio[nodes[i], nodes[j]])
    return level, exact


def _cut_by_orders(arcs: np.ndarray, price: np.ndarray, budget: int | None) -> tuple[tuple, bool]:
    """What is left without cycles has an order: the cheapest one, in which steps from later nodes to earlier ones are cut."""
    n = len(arcs)
    size = 1 << n
    back, total, last = np.zeros((n, size)), np.full(size, np.inf), np.zeros(size, dtype=np.int8)
    count = np.zeros(size, dtype=np.int8)
    for u in range(n):
        half = 1 << u
        back[:, half : 2 * half] = back[:, :half] + np.where(arcs[:, u], price[:, u], 0.0)[:, None]
        count[half : 2 * half] = count[:half] + 1
    total[0] = 0
    by_size = np.argsort(count, kind="stable")
    ends = np.searchsorted(count[by_size], np.arange(n + 2))
    for k in range(n):
        before = by_size[ends[k] : ends[k + 1]]
        for v in range(n):
            some = before[(before >> v) & 1 == 0]
            after, cost = some | (1 << v), total[some] + back[v, some]
            better = cost < total[after]
            total[after[better]], last[after[better]] = cost[better], v
    cut, left = [], size - 1
    while left:
        v = int(last[left])
        left ^= 1 << v
        cut += [(v, u) for u in range(n) if left >> u & 1 and arcs[v, u]]
    return tuple(cut), True


def _cut_of_component(arcs: np.ndarray, price: np.ndarray, budget: int | None) -> tuple[tuple, bool]:
    """Branch on the steps of a shortest cycle."""
    n = len(arcs)
    best = [np.inf, None]
    spent, stopped = [0], [False]

    def branch(left: np.ndarray, fixed: frozenset, cut: tuple, total: float) -> None:
        if total >= best[0] - 1e-12:
            return
        if budget is not None and spent[0] > budget:
            stopped[0] = True
            return
        spent[0] += 1
        cycle = shortest_cycle(left, left, np.ones(n, dtype=bool))
        if cycle is None:
            best[0], best[1] = total, cut
            return
        # the path runs backwards: cycle[k+1] -> cycle[k], and cycle[0] -> cycle[-1]
        steps = [(cycle[k + 1], cycle[k]) for k in range(len(cycle) - 1)] + [(cycle[0], cycle[-1])]
        for step in sorted((s for s in steps if s not in fixed), key=lambda s: price[s]):
            less = left.copy()
            less[step] = False
            branch(less, fixed, (*cut, step), total + price[step])
            fixed = fixed | {step}

    # a first answer: cut the cheapest step of each cycle found
    left, cut, total = arcs.copy(), [], 0.0
    while (cycle := shortest_cycle(left, left, np.ones(n, dtype=bool))) is not None:
        steps = [(cycle[k + 1], cycle[k]) for k in range(len(cycle) - 1)] + [(cycle[0], cycle[-1])]
        step = min(steps, key=lambda s: price[s])
        left[step] = False
        cut.append(step)
        total += price[step]
    best[:] = [total, tuple(cut)]
    branch(arcs, frozenset(), (), 0.0)
    return best[1], not stopped[0]


def simplex(c: np.ndarray, a: np.ndarray, b: np.ndarray, max_steps: int = 20_000) -> tuple[str, float, np.ndarray]:
    """min c x with a x = b and x >= 0, in two phases by Bland's rule: status, value, x."""
    return simplex_with_duals(c, a, b, max_steps)[:3]


def simplex_with_duals(c: np.ndarray, a: np.ndarray, b: np.ndarray, max_steps: int = 20_000) -> tuple[str, float, np.ndarray, np.ndarray]:
    """The same with the dual price of each row."""
    a, b, c = np.array(a, float), np.array(b, float), np.array(c, float)
    negative = b < 0
    a[negative] *= -1
    b[negative] *= -1
    m, n = a.shape
    table = np.zeros((m + 1, n + m + 1))
    table[:m, :n], table[:m, n : n + m], table[:m, -1] = a, np.eye(m), b
    basis = list(range(n, n + m))

    def run(costs: np.ndarray, usable: int) -> str:
        table[m, :] = 0
        table[m, : len(costs)] = costs
        for row, k in enumerate(basis):
            table[m] -= table[m, k] * table[row]
        for _ in range(max_steps):
            enter = np.flatnonzero(table[m, :usable] < -1e-9)
            if not len(enter):
                return "optimal"
            k = int(enter[0])
            up = np.flatnonzero(table[:m, k] > 1e-9)
            if not len(up):
                return "unbounded"
            ratios = table[up, -1] / table[up, k]
            ties = up[ratios <= ratios.min() + 1e-12]
            row = int(min(ties, key=lambda r: basis[r]))
            table[row] /= table[row, k]
            for other in range(m + 1):
                if other != row and table[other, k]:
                    table[other] -= table[other, k] * table[row]
            basis[row] = k
        return "stopped"

    status = run(np.concatenate([np.zeros(n), np.ones(m)]), n + m)
    x = np.zeros(n + m)
    x[basis] = table[:m, -1]
    if status != "optimal" or x[n:].sum() > 1e-7:
        return ("infeasible" if status == "optimal" else status), float(x[n:].sum()), x[:n], np.zeros(m)
    for row in range(m):  # artificial variables leave where they can
        if basis[row] >= n and len(other := np.flatnonzero(abs(table[row, :n]) > 1e-9)):
            k = int(other[0])
            table[row] /= table[row, k]
            for r in range(m):
                if r != row and table[r, k]:
                    table[r] -= table[r, k] * table[row]
            basis[row] = k
    status = run(c, n)
    x = np.zeros(n + m)
    x[basis] = table[:m, -1]
    # an artificial variable costs nothing now: its reduced cost is the price of its row
    return status, float(c @ x[:n]), x[:n], np.where(negative, 1, -1) * table[m, n : n + m]
