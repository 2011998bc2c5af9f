"""Kernels for one user at a time: cycles, utilities, demand structure, welfare.

p and q are times x goods; all functions are pure, so they run inside any grouped plan.
"""

from __future__ import annotations

import numpy as np

from concordia.functions import kernels, search

TOL = 1e-10


def graph(p: np.ndarray, q: np.ndarray, tol: float = TOL) -> dict[str, np.ndarray]:
    """Costs, own spending, direct relations, closure, component labels and log weights."""
    cost, own = kernels.costs(p[None], q[None])
    weak, strict = kernels.relations(cost, own, tol=tol)
    reach = kernels.closure(weak)
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = np.where((own[0][:, None] > tol) & (cost[0] > tol), np.log(own[0])[:, None] - np.log(cost[0]), -np.inf)
    np.fill_diagonal(weight, 0.0)
    return {"cost": cost[0], "own": own[0], "weak": weak[0], "strict": strict[0], "reach": reach[0], "labels": kernels.components(reach)[0][0], "weight": weight}


def path(relation: np.ndarray, start: int, end: int) -> list[int]:
    """A shortest path, empty if there is none."""
    before, front = {start: None}, [start]
    while front and end not in before:
        after = []
        for u in front:
            for v in np.flatnonzero(relation[u]).tolist():
                if v not in before:
                    before[v] = u
                    after.append(v)
        front = after
    if end not in before:
        return []
    out, at = [], end
    while at is not None:
        out.append(at)
        at = before[at]
    return out[::-1]


def _tree(relation: np.ndarray, start: int) -> dict[int, int | None]:
    """The node before each node on a shortest path from ``start``."""
    before, front = {start: None}, [start]
    while front:
        after = []
        for u in front:
            for v in np.flatnonzero(relation[u]).tolist():
                if v not in before:
                    before[v] = u
                    after.append(v)
        front = after
    return before


def cycles(g: dict[str, np.ndarray], most: int | None = None) -> list[list[int]]:
    """Shortest violating cycles through each strict preference, one for each set of observations; the first ``most`` of them if asked for."""
    seen, out, trees = set(), [], {}
    weak = g["weak"] & ~np.eye(len(g["weak"]), dtype=bool)
    for i, j in np.argwhere(g["strict"] & g["reach"].T).tolist():
        if j not in trees:
            trees[j] = _tree(weak, j)
        if i not in trees[j]:
            continue
        way, at = [], i
        while at is not None:
            way.append(at)
            at = trees[j][at]
        if (key := frozenset(way)) not in seen:
            seen.add(key)
            out.append([i, *way[:0:-1]])
            if most is not None and len(out) >= most:
                break
    return out


def steps(cycle: list[int]) -> list[tuple[int, int]]:
    return list(zip(cycle, [*cycle[1:], cycle[0]], strict=True))


def cycle_cost(cycle: list[int], g: dict[str, np.ndarray]) -> float:
    """Savings along a cycle as a share of its spending."""
    spent = sum(g["own"][i] for i in cycle)
    return float(sum(g["own"][i] - g["cost"][i, j] for i, j in steps(cycle)) / spent) if spent > 0 else 0.0


def swaps(g: dict[str, np.ndarray]) -> dict[str, object]:
    """Preferences to turn around, greedily those on most violating cycles, until none is left; as a share of all pairs."""
    n, left, gone = len(g["own"]), cycles(g), []
    while left:
        count: dict[tuple[int, int], int] = {}
        for c in left:
            for s in steps(c):
                count[s] = count.get(s, 0) + 1
        worst = max(sorted(count), key=count.get)
        gone.append(worst)
        left = [c for c in left if worst not in steps(c)]
    return {"n_swaps": len(gone), "index": len(gone) / max(1, n * (n - 1) / 2), "swaps": gone}


def contributions(g: dict[str, np.ndarray], p: np.ndarray, q: np.ndarray, method: str = "cycles") -> np.ndarray:
    """Share of each observation in the violations: in how many cycles it stands, or what efficiency gains without it."""
    n = len(g["own"])
    out = np.zeros(n)
    if method == "cycles":
        for c in cycles(g):
            out[c] += 1
    elif method == "removal":
        level = efficiency(p, q)
        for i in range(n):
            keep = np.arange(n) != i
            out[i] = max(0.0, efficiency(p[keep], q[keep]) - level) if n > 1 else 0.0
    else:
        raise ValueError("method is 'cycles' or 'removal'")
    return out / out.sum() if out.sum() > 0 else out


def efficiency(p: np.ndarray, q: np.ndarray, tol: float = TOL) -> float:
    cost, own = kernels.costs(p[None], q[None])
    weak, strict = kernels.relations(cost, own, tol=tol)
    return float(kernels.ccei(cost, own, kernels.violations(kernels.closure(weak), strict) == 0, tol)[0])


def continuous_efficiency(p: np.ndarray, q: np.ndarray) -> float:
    """The supremum of consistent efficiency levels: a cycle breaks below its largest cost ratio, so it is the least of these over cycles, one at most."""
    cost, own = kernels.costs(p[None], q[None])
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(own[0][:, None] > 0, cost[0] / own[0][:, None], np.inf)
    np.fill_diagonal(ratio, np.inf)
    for k in range(len(ratio)):
        ratio = np.minimum(ratio, np.maximum(ratio[:, k, None], ratio[None, k, :]))
    return float(min(1.0, np.diag(ratio).min(initial=np.inf)))


def minimum_cost(g: dict[str, np.ndarray], tol: float = 1e-8) -> float:
    """Least adjustment that breaks each violating cycle at its cheapest step, over total spending."""
    need = np.zeros(len(g["own"]))
    for c in cycles(g):
        slack, at = min((g["own"][i] - g["cost"][i, j], i) for i, j in steps(c))
        need[at] = max(need[at], max(0.0, slack) + tol)
    return float(need.sum() / max(g["own"].sum(), 1e-300))


def utility(p: np.ndarray, q: np.ndarray) -> dict[str, object]:
    """Afriat numbers U and L > 0 with U_i <= U_j + L_j (p_j q_i - p_j q_j), built class by class; consistent data only.

    Classes of mutually preferred observations are numbered from the worst; within the
    closure a better class gets its number after those it is preferred to.
    """
    g = graph(p, q)
    n = len(p)
    if (g["reach"] & g["strict"].T).any():
        return {"success": False, "u": np.full(n, np.nan), "multiplier": np.full(n, np.nan)}
    # an observation's rank: how many classes it is preferred to
    order = np.argsort(g["reach"].sum(axis=1), kind="stable")
    u, multiplier = np.zeros(n), np.ones(n)
    gap = g["cost"] - g["own"][:, None]
    groups, seen = [], set()
    for i in order.tolist():
        if i not in seen:
            group = np.flatnonzero(g["reach"][i] & g["reach"][:, i])
            seen.update(group.tolist())
            groups.append(group)
    # the best class first: those not preferred by anyone else
    done: list[int] = []
    for group in groups[::-1]:
        if not done:
            u[group], multiplier[group] = 0.0, 1.0
        else:
            d = np.array(done)
            # at most what any better class allows
            u[group] = np.minimum(0.0, (u[d][:, None] + multiplier[d][:, None] * gap[np.ix_(d, group)]).min()) - 0.0
            for i in group:
                room = gap[i, d]
                need = np.where(room > TOL, (u[d] - u[i]) / np.where(room > TOL, room, 1.0), 0.0)
                multiplier[i] = max(1e-6, 1.0, float(need.max()))
        done += group.tolist()
    return {"success": True, "u": u - u.min(), "multiplier": multiplier}


def utility_of(bundle: np.ndarray, p: np.ndarray, q: np.ndarray, found: dict[str, object]) -> float:
    """The least that any observation's linear bound allows for a bundle."""
    return float((found["u"] + found["multiplier"] * (p @ bundle - np.einsum("tg,tg->t", p, q))).min())


def _bound_program(p: np.ndarray, q: np.ndarray, found: dict[str, object], target: float, prices: np.ndarray) -> tuple[str, float, np.ndarray]:
    """Cheapest bundle at ``prices`` whose recovered utility reaches the target."""
    own = np.einsum("tg,tg->t", p, q)
    a = np.hstack([found["multiplier"][:, None] * p, -np.eye(len(p))])
    b = target - found["u"] + found["multiplier"] * own
    status, value, x = search.simplex(np.concatenate([prices, np.zeros(len(p))]), a, b)
    return status, value, x[: p.shape[1]]


def expenditure(p: np.ndarray, q: np.ndarray, target: float, prices: np.ndarray) -> float:
    """Least spending at ``prices`` that reaches a level of the recovered utility; NaN if data are inconsistent."""
    found = utility(p, q)
    if not found["success"]:
        return float("nan")
    status, value, _ = _bound_program(p, q, found, target, prices)
    return value if status == "optimal" else float("nan")


def hicksian(p: np.ndarray, q: np.ndarray, target: float, prices: np.ndarray) -> np.ndarray:
    found = utility(p, q)
    if not found["success"]:
        return np.full(p.shape[1], np.nan)
    return _bound_program(p, q, found, target, prices)[2]


def predict_demand(p: np.ndarray, q: np.ndarray, prices: np.ndarray, wealth: float) -> np.ndarray:
    """A bundle of the greatest recovered utility on a budget, by linear programming."""
    found = utility(p, q)
    goods = p.shape[1]
    if not found["success"]:
        return np.full(goods, np.nan)
    own = np.einsum("tg,tg->t", p, q)
    n = len(p)
    # variables: bundle, level (split in two), slack of every bound, slack of the budget
    a = np.zeros((n + 1, goods + 2 + n + 1))
    a[:n, :goods], a[:n, goods], a[:n, goods + 1], a[:n, goods + 2 : goods + 2 + n] = -found["multiplier"][:, None] * p, 1, -1, np.eye(n)
    a[n, :goods], a[n, -1] = prices, 1
    b = np.append(found["u"] - found["multiplier"] * own, wealth)
    c = np.zeros(a.shape[1])
    c[goods], c[goods + 1] = -1, 1
    return search.simplex(c, a, b)[2][:goods]


def variation(p0: np.ndarray, q0: np.ndarray, p1: np.ndarray, q1: np.ndarray) -> dict[str, float]:
    """Compensating and equivalent variation from mean baseline to mean policy prices, exact on the utility recovered from both."""
    p, q = np.vstack([p0, p1]), np.vstack([q0, q1])
    found = utility(p, q)
    a, b = p0.mean(axis=0), p1.mean(axis=0)
    if not found["success"]:
        return {"cv": float("nan"), "ev": float("nan")}
    base, policy = utility_of(q0.mean(axis=0), p, q, found), utility_of(q1.mean(axis=0), p, q, found)
    spend = lambda level, prices: _bound_program(p, q, found, level, prices)[1]
    return {"cv": spend(base, b) - spend(policy, b), "ev": spend(policy, a) - spend(base, a)}


def vartia(p0: np.ndarray, q0: np.ndarray, p1: np.ndarray, elasticity: float = -1.0, n: int = 100) -> float:
    """Compensating variation as a path integral from mean baseline prices, by trapezoids."""
    a, b, x = p0.mean(axis=0), p1.mean(axis=0), q0.mean(axis=0)
    at = np.linspace(0, 1, n + 1)[:, None]
    prices = a + at * (b - a)
    h = x * (prices / a) ** elasticity
    return float(np.trapezoid((h * (b - a)).sum(axis=1), at[:, 0]))


def regress(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least squares with a constant: coefficients without the constant, and their standard errors."""
    design = np.column_stack([np.ones(len(x)), x])
    inverse = np.linalg.pinv(design.T @ design)
    beta = inverse @ design.T @ y
    left = y - design @ beta
    freedom = max(1, len(y) - design.shape[1])
    return beta[1:], np.sqrt(np.maximum(0, np.outer(np.diag(inverse), (left**2).sum(axis=0) / freedom)))[1:]


def slutsky(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Substitution effects at means from log-log demand: dx_i/dp_j + x_j dx_i/dm; finite differences if observations are few."""
    n, goods = p.shape
    m = (p * q).sum(axis=1)
    if n < goods + 2:
        dp, dq = np.diff(p, axis=0), np.diff(q, axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            rate = np.where(np.abs(dp)[:, None, :] > 1e-10, dq[:, :, None] / dp[:, None, :], np.nan)
        out = np.zeros((goods, goods))
        for i in range(goods):
            for j in range(goods):
                known = rate[:, i, j][np.isfinite(rate[:, i, j])]
                out[i, j] = known.mean() if len(known) else 0.0
        return out
    x = np.column_stack([np.log(np.maximum(p, 1e-10)), np.log(np.maximum(m, 1e-10))])
    beta, _ = regress(np.log(np.maximum(q, 1e-10)), x)
    mean_q, mean_p, mean_m = q.mean(axis=0), p.mean(axis=0), max(m.mean(), 1e-10)
    by_price = beta[:goods].T * mean_q[:, None] / mean_p[None, :]
    by_wealth = beta[goods] * mean_q / mean_m
    return by_price + np.outer(by_wealth, mean_q)


def slutsky_tests(s: np.ndarray, symmetry: float = 0.1, tol: float = 1e-6) -> dict[str, object]:
    scale = np.maximum(1e-10, (np.abs(s) + np.abs(s.T)) / 2)
    off = float((np.abs(s - s.T) / scale)[~np.eye(len(s), dtype=bool)].max(initial=0.0))
    top = float(np.linalg.eigvalsh((s + s.T) / 2).max())
    return {"is_symmetric": off <= symmetry, "asymmetry": off, "is_nsd": top <= tol, "max_eigenvalue": top}


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Least squares with coefficients that aren't negative, by active sets."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, dtype=bool)
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[passive] = -np.inf
        if passive.all() or w.max() <= 1e-10:
            break
        passive[int(w.argmax())] = True
        while True:
            s = np.zeros(n)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if s[passive].min() > 0:
                break
            back = passive & (s <= 0)
            step = (x[back] / (x[back] - s[back])).min()
            x = x + step * (s - x)
            passive &= x > 1e-12
            if not passive.any():
                s = np.zeros(n)
                break
        x = s
    return x


def characteristics(p: np.ndarray, q: np.ndarray, attributes: np.ndarray) -> dict[str, np.ndarray]:
    """Amounts of characteristics, their shadow prices, and how far prices are from them."""
    shadow = np.array([nnls(attributes, row) for row in p])
    return {"z": q @ attributes, "shadow": shadow, "residual": np.linalg.norm(p - shadow @ attributes.T, axis=1) / np.maximum(np.linalg.norm(p, axis=1), 1e-300)}


def separability(p: np.ndarray, q: np.ndarray, a: list[int], b: list[int]) -> dict[str, object]:
    """Efficiency within two groups of goods, and how far quantities of one follow prices of the other beyond spending."""
    inside = [efficiency(p[:, g], q[:, g]) for g in (a, b)]
    spend = (p * q).sum(axis=1)

    def rest(x: np.ndarray) -> np.ndarray:
        return x - np.column_stack([np.ones(len(x)), spend]) @ np.linalg.lstsq(np.column_stack([np.ones(len(x)), spend]), x, rcond=None)[0]

    x, y = rest(q[:, a].sum(axis=1)), rest(p[:, b].mean(axis=1))
    scale = np.linalg.norm(x) * np.linalg.norm(y)
    cross = float(abs(x @ y) / scale) if scale > 1e-12 else 0.0
    return {"within_a": inside[0], "within_b": inside[1], "cross_effect": cross, "is_separable": min(inside) > 0.9 and cross < 0.2}


def separability_by_numbers(p: np.ndarray, q: np.ndarray, a: list[int], b: list[int]) -> dict[str, object]:
    """Weak separability of group b: its Afriat numbers stand for it as one more good of the other group, whose price is one over the multiplier.

    Where both tests hold, utilities of the theorem are found and the groups are separable; other
    numbers of group b might still hold where these don't.
    """
    inside = [efficiency(p[:, g], q[:, g]) for g in (a, b)]
    own = utility(p[:, b], q[:, b])
    if not own["success"]:
        return {"within_a": inside[0], "within_b": inside[1], "is_separable": False}
    value = own["u"] - own["u"].min()
    prices, amounts = np.column_stack([p[:, a], 1 / own["multiplier"]]), np.column_stack([q[:, a], value])
    cost, spent = kernels.costs(prices[None], amounts[None])
    weak, strict = kernels.relations(cost, spent, tol=TOL)
    return {"within_a": inside[0], "within_b": inside[1], "is_separable": int(kernels.violations(kernels.closure(weak), strict)[0]) == 0}


def euclidean(items: np.ndarray, menus: list[list[int]], choices: list[int], tol: float = 1e-8) -> tuple[bool, float]:
    """Whether a point exists that every choice is nearest to, by linear programming over pairs of a choice and an item left, and by how much the worst weights fail.

    Weights on pairs whose weighted differences of features cancel must not let chosen items have the larger squared norms.
    """
    pairs = [(c, i) for m, c in zip(menus, choices, strict=True) for i in m if i != c]
    if not pairs:
        return True, 0.0
    chosen, left = items[[c for c, _ in pairs]], items[[i for _, i in pairs]]
    a = np.vstack([(chosen - left).T, np.ones(len(pairs))])
    gain = (chosen**2).sum(axis=1) - (left**2).sum(axis=1)
    status, value, _ = search.simplex(-gain, a, np.append(np.zeros(items.shape[1]), 1.0))
    worst = -value if status == "optimal" else 0.0
    return worst <= tol, max(0.0, worst)


def ideal_point(items: np.ndarray, menus: list[list[int]], choices: list[int], rounds: int = 400) -> tuple[np.ndarray, int]:
    """A point that the chosen items are nearer to than the others, by descent on squared hinge losses from the mean and from chosen items; how many choices it fails."""
    chosen, other = [], []
    for m, c in zip(menus, choices, strict=True):
        for i in m:
            if i != c:
                chosen.append(items[c])
                other.append(items[i])
    point = items[choices].mean(axis=0)
    if not chosen:
        return point, 0
    c, o = np.array(chosen), np.array(other)
    # nearer to c than to o: (o - c) . point <= (|o|^2 - |c|^2) / 2
    a, b = o - c, ((o**2).sum(axis=1) - (c**2).sum(axis=1)) / 2
    rate = 1.0 / max(1e-12, np.linalg.norm(a, 2) ** 2)
    best, fails = point, np.inf
    for start in [point, *items[sorted(set(choices))]]:
        point = start
        for _ in range(rounds):
            over = np.maximum(0.0, a @ point - b)
            if (n := _failed(items, menus, choices, point)) < fails:
                best, fails = point, n
            if n == 0 or not over.any():
                break
            point = point - rate * (a.T @ over)
        if fails == 0:
            break
    return best, int(fails)


def _failed(items: np.ndarray, menus: list[list[int]], choices: list[int], point: np.ndarray, norm: float = 2) -> int:
    d = np.linalg.norm(items - point, ord=norm, axis=1)
    return sum(any(d[i] < d[c] - 1e-9 for i in m if i != c) for m, c in zip(menus, choices, strict=True))


def risk_profile(safe: np.ndarray, outcomes: np.ndarray, probs: np.ndarray, risky: np.ndarray, low: float = -2.0, high: float = 5.0) -> dict[str, object]:
    """Relative risk aversion of largest likelihood, by golden section; its category; the share of choices it explains."""

    def value(x: np.ndarray, rho: float) -> np.ndarray:
        x = np.maximum(x, 1e-10)
        return np.log(x) if abs(rho - 1) < 1e-8 else x ** (1 - rho) / (1 - rho)

    def gap(rho: float) -> np.ndarray:
        """Certainty equivalents over safe amounts, less one."""
        u = (value(outcomes, rho) * probs).sum(axis=1)
        with np.errstate(over="ignore"):
            sure = np.exp(u) if abs(rho - 1) < 1e-8 else np.maximum(u * (1 - rho), 1e-300) ** (1 / (1 - rho))
        return sure / np.maximum(safe, 1e-10) - 1

    def loss(rho: float) -> float:
        z = np.clip(10 * gap(rho) * np.where(risky, 1, -1), -500, 500)
        return float(np.logaddexp(0, -z).sum())

    grid = np.linspace(low, high, 29)
    at = int(np.argmin([loss(r) for r in grid]))
    a, b = grid[max(0, at - 1)], grid[min(len(grid) - 1, at + 1)]
    ratio = (5**0.5 - 1) / 2
    for _ in range(60):
        x, y = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, y) if loss(x) <= loss(y) else (x, b)
    rho = float((a + b) / 2)
    share = float(((gap(rho) > 0) == risky).mean()) if len(safe) else 1.0
    return {"rho": rho, "category": "risk_neutral" if abs(rho) < 0.1 else "risk_averse" if rho > 0 else "risk_seeking", "consistency": share}


def dominates(a: np.ndarray, b: np.ndarray, probs: np.ndarray, tol: float = 1e-8) -> bool:
    """Whether lottery a first-order dominates b (outcomes over states with probabilities)."""
    at = np.union1d(a, b)
    fa, fb = ((probs[None, :] * (x[None, :] <= at[:, None])).sum(axis=1) for x in (a, b))
    return bool((fa <= fb + tol).all() and (fa < fb - tol).any())


def partition(p: np.ndarray, q: np.ndarray, groups: int = 3) -> list[list[int]]:
    """Goods whose spending shares move together, by average linkage."""
    share = (p * q) / np.maximum((p * q).sum(axis=1, keepdims=True), 1e-300)
    with np.errstate(invalid="ignore", divide="ignore"):
        like = np.nan_to_num(np.corrcoef(share.T)) if share.shape[1] > 1 else np.ones((1, 1))
    out = [[g] for g in range(p.shape[1])]
    while len(out) > groups:
        a, b = max(((i, j) for i in range(len(out)) for j in range(i)), key=lambda ij: like[np.ix_(out[ij[0]], out[ij[1]])].mean())
        out[b] = sorted(out[b] + out.pop(a))
    return sorted(out)
