import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from concordia.functions import kernels, search, single
from concordia.plans.score import budget_scores, menu_scores, random_utility, variant_scores
from concordia.schema import METRICS

#: prices, quantities and the hand-derived values
GOLDENS = [
    ([[1, 0.1], [0.1, 1]], [[2, 0], [0, 2]], {"is_garp": False, "ccei": 0.1, "mpi": 0.9, "hm_consistent": 1, "vei_mean": 0.1, "vei_min": 0.1, "n_violations": 2, "is_harp": False}),
    ([[1, 3], [3, 1], [0.4, 1]], [[2, 0], [1, 0], [0, 1]], {"is_garp": False, "ccei": 1 / 3, "mpi": 0.633333, "hm_consistent": 2, "vei_mean": 0.544444, "vei_min": 1 / 3, "n_violations": 4}),
    ([[1, 0.1], [0.1, 1], [1, 0.05], [0.05, 1]], [[2, 0], [0, 2], [200, 0], [0, 200]], {"is_garp": False, "ccei": 0.05, "mpi": 0.95, "hm_consistent": 2, "vei_mean": 0.075, "vei_min": 0.05}),
    ([[1, 2], [2, 1]], [[4, 1], [1, 4]], {"is_garp": True, "ccei": 1, "mpi": 0, "is_harp": True, "hm_consistent": 2}),
    ([[1, 1], [1, 2]], [[2, 1], [1, 2]], {"is_garp": False, "ccei": 0.8, "mpi": 0.1, "n_violations": 1}),
    ([[1, 1], [1, 1]], [[2, 1], [1, 2]], {"is_garp": True, "n_violations": 0}),
    ([[1, 2], [2, 1]], [[0.2, 0.4], [0.4, 0.2]], {"ccei": 0.8, "mpi": 0.2}),
    ([[1, 2]], [[3, 1]], {"is_garp": True, "ccei": 1, "mpi": 0, "max_scc": 1, "n_scc": 1}),
]


@pytest.mark.parametrize(("p", "q", "expected"), GOLDENS)
def test_goldens(p, q, expected):
    found = budget_scores(np.array([p], float), np.array([q], float), METRICS)
    for name, value in expected.items():
        assert found[name][0] == pytest.approx(value, abs=1e-5), name


def test_tall_histories():
    chance = np.random.default_rng(42)
    p = chance.uniform(0.5, 2, (2000, 5))
    q = np.full((2000, 5), 0.2) * chance.uniform(50, 150, (2000, 1)) / p
    found = budget_scores(p[None], q[None], ("garp", "ccei", "mpi", "hm"))
    assert (found["is_garp"][0], found["ccei"][0], found["mpi"][0], found["hm_consistent"][0]) == (True, 1.0, 0.0, 2000)


def brute_reach(r):
    n = len(r)
    out = r | np.eye(n, dtype=bool)
    for _ in range(n):
        out = out | (out.astype(int) @ out.astype(int) > 0)
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 30))
def test_closure_and_components(seed, n):
    r = np.random.default_rng(seed).random((3, n, n)) < 1.5 / n
    reach = kernels.closure(r)
    for k in range(3):
        assert (reach[k] == brute_reach(r[k])).all()
    labels, number, largest = kernels.components(reach)
    for k in range(3):
        groups = {i: frozenset(np.flatnonzero(reach[k, i] & reach[k, :, i]).tolist()) for i in range(n)}
        assert number[k] == len(set(groups.values()))
        assert largest[k] == max(map(len, groups.values()))
        assert labels[k].tolist() == [min(groups[i]) for i in range(n)]


def consistent(p, q, e=1.0):
    cost = p @ q.T
    own = e * np.diag(cost)[:, None]
    r, s = own >= cost - 1e-10, own > cost + 1e-10
    np.fill_diagonal(s, False)
    return not (brute_reach(r) & s.T).any()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 6), st.integers(2, 3))
def test_indices_against_brute_force(seed, n, goods):
    chance = np.random.default_rng(seed)
    p, q = chance.uniform(0.1, 1, (n, goods)), chance.uniform(0, 1, (n, goods))
    found = {k: v[0] for k, v in budget_scores(p[None], q[None], METRICS).items()}
    cost = p @ q.T
    own = np.diag(cost)
    assert found["is_garp"] == consistent(p, q) == found["utility_success"]
    ratios = sorted({x for x in (cost / own[:, None]).ravel() if 0 < x < 1})
    level = 1.0 if consistent(p, q) else max([x for x in ratios if consistent(p, q, x)], default=0.0)
    assert found["ccei"] == pytest.approx(level)
    best = max(len(k) for m in range(n + 1) for k in itertools.combinations(range(n), m) if not k or consistent(p[list(k)], q[list(k)]))
    assert found["hm_consistent"] == best
    weak = own[:, None] >= cost - 1e-10
    top, product = 0.0, False
    for m in range(2, n + 1):
        for c in itertools.permutations(range(n), m):
            if c[0] == min(c) and all(weak[i, j] for i, j in single.steps(list(c))):
                top = max(top, np.mean([(own[i] - cost[i, j]) / own[i] for i, j in single.steps(list(c))]))
                product |= sum(np.log(own[i] / cost[i, j]) for i, j in single.steps(list(c))) > 1e-10
    assert found["mpi"] == pytest.approx(0.0 if found["is_garp"] else top)
    assert found["is_harp"] == (not product)
    assert found["vei_min"] <= found["vei_mean"] + 1e-12
    variants = variant_scores(p[None], q[None])
    assert variants["is_sarp"][0] <= found["is_garp"]


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6))
def test_scores_ignore_price_level_and_order(seed):
    chance = np.random.default_rng(seed)
    p, q = chance.uniform(0.1, 1, (6, 3)), chance.uniform(0, 1, (6, 3))
    one = budget_scores(p[None], q[None], METRICS)
    two = budget_scores((p * chance.uniform(0.5, 2, (6, 1)))[None], q[None], METRICS)
    order = chance.permutation(6)
    three = budget_scores(p[order][None], q[order][None], METRICS)
    for name in ("is_garp", "ccei", "mpi", "is_harp", "hm_consistent", "n_violations", "vei_mean", "r_density", "degree_gini"):
        assert one[name][0] == pytest.approx(two[name][0], abs=1e-7), name
        assert one[name][0] == pytest.approx(three[name][0], abs=1e-7), name


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6))
def test_exact_levels_are_cheapest(seed):
    chance = np.random.default_rng(seed)
    p, q = chance.uniform(0.1, 1, (4, 2)), chance.uniform(0, 1, (4, 2))
    cost = p @ q.T
    own = np.diag(cost).copy()
    ratio = cost / own[:, None]
    arcs = [(i, j) for i in range(4) for j in range(4) if i != j and 1 - ratio[i, j] > 1e-12]
    best = np.inf
    for m in range(len(arcs) + 1):
        for cut in itertools.combinations(arcs, m):
            left = np.zeros((4, 4), dtype=bool)
            for a in set(arcs) - set(cut):
                left[a] = True
            reach = brute_reach(left)
            if not (left & reach.T).any():
                best = min(best, sum(1 - ratio[a] for a in cut))
    level = search.exact_levels(cost, own)
    kept = np.array([[ratio[i, j] < 1 - 1e-12 and i != j and ratio[i, j] < level[i] - 1e-12 for j in range(4)] for i in range(4)])
    assert not (kept & brute_reach(kept).T).any()
    assert best < np.inf


def test_searches_go_by_component_and_say_whether_they_are_exact(monkeypatch):
    chance = np.random.default_rng(4)
    n, copies = 6, 40
    weak = np.zeros((n * copies, n * copies), dtype=bool)
    best = 0
    for k in range(copies):
        one = chance.random((n, n)) < 0.4
        np.fill_diagonal(one, False)
        weak[n * k : n * (k + 1), n * k : n * (k + 1)] = one
        best += max(len(s) for m in range(n + 1) for s in itertools.combinations(range(n), m) if not (one[np.ix_(s, s)] & brute_reach(one[np.ix_(s, s)]).T).any())
    # 240 observations, more than are searched in one component
    assert search.largest_consistent(weak, weak) == (best, True)
    p, q = chance.uniform(0.1, 1, (1, 12, 3)), chance.uniform(0, 1, (1, 12, 3))
    q /= (p * q).sum(axis=2, keepdims=True)
    found = budget_scores(p, q, METRICS)
    assert not found["is_garp"][0] and found["is_hm_exact"][0] and found["is_vei_exact"][0]
    assert budget_scores(p, q, ("garp",))["is_hm_exact"] == [None]
    cost, own = p[0] @ q[0].T, (p[0] * q[0]).sum(axis=1)
    few = cost[:6, :6]
    by_orders = search.cheapest_cut(few, own[:6])
    monkeypatch.setattr(search, "ORDERS_UP_TO", 1)
    by_branches = search.cheapest_cut(few, own[:6], budget=10**6)
    assert by_orders[1] and by_branches[1] and by_orders[0] == pytest.approx(by_branches[0])
    assert not search.cheapest_cut(cost, own, budget=1)[1]
    monkeypatch.setattr(search, "EXACT_UP_TO", 1)
    assert not search.largest_consistent(np.ones((5, 5), dtype=bool), ~np.eye(5, dtype=bool))[1]


def test_simplex():
    status, value, x = search.simplex(np.array([-3.0, -5, 0, 0, 0]), np.array([[1.0, 0, 1, 0, 0], [0, 2, 0, 1, 0], [3, 2, 0, 0, 1]]), np.array([4.0, 12, 18]))
    assert (status, value) == ("optimal", pytest.approx(-36)) and x[:2].tolist() == pytest.approx([2, 6])
    assert search.simplex(np.array([1.0]), np.array([[1.0], [1.0]]), np.array([1.0, 2.0]))[0] == "infeasible"
    assert search.simplex(np.array([-1.0, 0.0]), np.array([[1.0, -1.0]]), np.array([1.0]))[0] == "unbounded"


def test_menu_goldens():
    cycle = menu_scores([([[0, 1], [1, 2], [0, 2]], [0, 1, 2])], 3)
    assert (cycle["is_sarp"][0], cycle["is_warp"][0], cycle["hm_consistent"][0], cycle["hm_total"][0]) == (False, True, 2, 3)
    assert menu_scores([([[0, 1], [1, 2], [0, 2]], [0, 1, 2])], 3, "observations")["hm_consistent"] == [2]
    turn = menu_scores([([[0, 1], [0, 1]], [0, 1])], 2)
    assert (turn["is_warp"][0], turn["is_sarp"][0], turn["n_warp_violations"][0]) == (False, False, 1)
    nested = menu_scores([([[0, 1, 2], [1, 2]], [0, 1])], 3)
    assert nested["is_warp"][0] and nested["is_sarp"][0]
    alone = menu_scores([([[0], [1], [2]], [0, 1, 2])], 3)
    assert alone["is_sarp"][0] and alone["n_scc"][0] == 3 and alone["r_density"][0] == 0
    excused = menu_scores([([[0, 1], [0, 1], [0, 2], [1, 2]], [0, 1, 2, 2])], 3)
    assert not excused["is_warp"][0] and excused["is_warp_la"][0]


def test_random_utility_goldens():
    mixture = random_utility([[0, 1], [1, 2], [0, 2]], [[60, 40], [100, 0], [60, 40]])
    assert mixture["is_consistent"] and mixture["is_regular"]
    broken = random_utility([[0, 1], [0, 1, 2]], [[55, 45], [70, 20, 10]])
    assert not broken["is_consistent"] and not broken["is_regular"] and broken["distance"] == pytest.approx(0.3, abs=1e-6)
    assert random_utility([[0, 1], [1, 2], [0, 2]], [[60, 40], [60, 40], [40, 60]])["is_consistent"]
    eight = random_utility([[0, 1, 2, 3, 4, 5, 6, 7], [0, 1]], [[80, 0, 0, 0, 0, 0, 0, 0], [80, 0]])
    assert eight["is_consistent"]


def test_added_orders_reach_the_optimum(monkeypatch):
    """With orders added by their prices the deviation is that over all orders."""
    from concordia.plans import score

    chance = np.random.default_rng(3)
    for _ in range(12):
        menus = [sorted(chance.choice(5, chance.integers(2, 5), replace=False).tolist()) for _ in range(5)]
        counts = [chance.integers(0, 20, len(m)).tolist() for m in menus]
        counts = [c if sum(c) else [1] * len(c) for c in counts]
        every = random_utility(menus, counts)
        monkeypatch.setattr(score, "ALL_ORDERS_UP_TO", 0)
        added = random_utility(menus, counts)
        monkeypatch.setattr(score, "PRICED_UP_TO", 0)
        swapped = random_utility(menus, counts)
        monkeypatch.undo()
        assert added["distance"] == pytest.approx(every["distance"], abs=1e-6) and added["is_exact"] and every["is_exact"]
        assert swapped["distance"] >= every["distance"] - 1e-6 and (swapped["is_exact"] or swapped["distance"] > 0)


def test_searches_without_a_budget_end():
    """The largest consistent subset and the cheapest cut of inconsistent users, against every subset."""
    from itertools import combinations

    from concordia.functions import kernels, search

    chance = np.random.default_rng(8)
    for _ in range(6):
        p, q = chance.uniform(0.5, 2, (9, 3)), chance.uniform(0.1, 5, (9, 3))
        cost, own = kernels.costs(p[None], q[None])
        weak, strict = (x[0] for x in kernels.relations(cost, own))
        best = max(k for k in range(10) for some in combinations(range(9), k) if search.consistent(weak, strict, np.isin(np.arange(9), some)))
        assert search.largest_consistent(weak, strict, None) == (best, True)
    p, q = chance.uniform(0.5, 2, (60, 4)), chance.uniform(0.5, 1.5, (60, 4))
    cost, own = kernels.costs(p[None], q[None])
    weak, strict = (x[0] for x in kernels.relations(cost, own))
    few, proven = search.largest_consistent(weak, strict, 1)
    most, ended = search.largest_consistent(weak, strict, None)
    assert ended and few <= most


def test_all_cycles_and_the_supremum():
    chance = np.random.default_rng(5)
    for _ in range(10):
        p, q = chance.uniform(0.5, 2, (12, 3)), chance.uniform(0.1, 5, (12, 3))
        g = single.graph(p, q)
        found = single.cycles(g)
        assert len({frozenset(c) for c in found}) == len(found)
        for c in found:
            assert g["strict"][c[0], c[1]] and all(g["weak"][i, j] for i, j in single.steps(c))
        assert (len(found) > 0) == (single.efficiency(p, q) < 1)
        assert single.cycles(g, 1) == found[:1]
        sup = single.continuous_efficiency(p, q)
        fine = lambda e, p=p, q=q: int(kernels.violations(kernels.closure((r := kernels.relations(*kernels.costs(p[None], q[None]), e))[0]), r[1])[0]) == 0
        assert fine(sup * (1 - 1e-9)) and (sup == 1 or not fine(sup * (1 + 1e-9)))


def test_exact_programs():
    """A point that explains choices, and one choice between others of a line that none explains; a separable and a joint user."""
    items = np.array([[0.0, 0], [1, 0], [0, 1], [2, 2]])
    assert single.euclidean(items, [[0, 3], [1, 3], [2, 3]], [0, 1, 2]) == (True, 0.0)
    line = np.array([[-1.0], [0.0], [1.0]])
    ends = single.euclidean(line, [[0, 1], [1, 2]], [0, 2])
    assert not ends[0] and ends[1] > 0
    assert single.euclidean(line, [[0, 1, 2]], [1])[0]
    p = np.array([[1.0, 2, 1, 3], [2, 1, 3, 1], [1, 1, 2, 2]])
    spend = np.array([10.0, 12, 14])
    separable = spend[:, None] * np.array([0.2, 0.3, 0.1, 0.4]) / p
    assert single.separability_by_numbers(p, separable, [0, 1], [2, 3])["is_separable"]
    against = np.array([[1.0, 3], [3, 1], [2, 2]])
    assert not single.separability_by_numbers(p, np.column_stack([separable[:, :2], against]), [0, 1], [2, 3])["is_separable"]


def test_risk_goldens():
    outcomes = np.array([[70, 0], [90, 0], [110, 0]], float)
    half = np.full((3, 2), 0.5)
    profile = lambda safe, chose: single.risk_profile(np.array(safe, float), outcomes, half, np.array(chose))
    neutral, averse, seeking = profile([25, 50, 40], [True, False, True]), profile([40, 50, 60], [False] * 3), profile([40, 50, 60], [True] * 3)
    assert neutral["category"] == "risk_neutral" and abs(neutral["rho"]) < 0.5 and neutral["consistency"] == 1
    assert averse["category"] == "risk_averse" and averse["rho"] > 0 and averse["consistency"] == 1
    assert seeking["category"] == "risk_seeking" and seeking["rho"] < 0 and seeking["consistency"] == 1
    odd = single.risk_profile(np.array([30, 40, 50, 60, 70.0]), np.array([[x, 0.0] for x in (70, 90, 110, 130, 150)]), np.full((5, 2), 0.5), np.array([False, False, True, True, True]))
    assert odd["consistency"] < 1


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6))
def test_afriat_numbers(seed):
    chance = np.random.default_rng(seed)
    p = chance.uniform(0.5, 2, (8, 3))
    q = chance.dirichlet(np.ones(3)) * chance.uniform(50, 150, (8, 1)) / p
    found = single.utility(p, q)
    own = (p * q).sum(axis=1)
    assert found["success"] and (found["multiplier"] > 0).all()
    bounds = found["u"][:, None] + found["multiplier"][:, None] * (p @ q.T - own[:, None])
    assert (found["u"][None, :] <= bounds + 1e-8).all()
    best = single.predict_demand(p, q, p[0], own[0])
    assert p[0] @ best <= own[0] + 1e-6
    assert single.utility_of(best, p, q, found) >= found["u"][0] - 1e-6
    assert single.expenditure(p, q, float(found["u"][2]), p[2]) <= own[2] + 1e-6


def test_nonnegative_least_squares():
    chance = np.random.default_rng(1)
    for _ in range(20):
        a, b = chance.normal(size=(6, 3)), chance.normal(size=6)
        x = single.nnls(a, b)
        best = min((np.linalg.norm(b - a[:, k] @ np.linalg.lstsq(a[:, k], b, rcond=None)[0]) for m in range(1, 4) for k in map(list, itertools.combinations(range(3), m)) if (np.linalg.lstsq(a[:, k], b, rcond=None)[0] >= 0).all()), default=np.linalg.norm(b))
        assert (x >= 0).all() and np.linalg.norm(b - a @ x) == pytest.approx(min(best, np.linalg.norm(b)), abs=1e-8)


def test_ideal_point():
    items = np.array([[0, 0], [1, 0], [0, 1], [3, 3]], float)
    _, fails = single.ideal_point(items, [[0, 3], [1, 3], [2, 3], [0, 1]], [0, 1, 2, 0])
    assert fails == 0
    line = np.array([[0.0], [1.0], [2.0]])
    assert single.ideal_point(line, [[0, 1], [1, 2]], [0, 2])[1] == 1
