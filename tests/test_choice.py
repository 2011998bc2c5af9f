import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from concordia.functions import choice
from concordia.panel import Auditor, Encoder, MenuPanel, Panel
from concordia.sources import generate


def test_preferences_and_maximality():
    found = choice.preferences([[0, 1, 2], [1, 2]], [0, 1])
    assert (found["order"], found["utility"]) == ([0, 1, 2], {0: 3, 1: 2, 2: 1})
    assert not choice.preferences([[0, 1], [1, 2], [0, 2]], [0, 1, 2])["success"]
    assert choice.maximal([[0, 1, 2], [1, 2]], [0, 1]) == 0
    assert choice.maximal([[0, 1], [1, 2], [0, 2]], [0, 1, 2]) == 0
    assert choice.consideration([[0, 1], [0, 1]], [0, 1]) == [[0], [1]]


def test_attention():
    assert choice.limited_attention([[0, 1, 2], [0, 1]], [0, 1]) == {"success": True, "order": [0, 1, 2], "relation": [(0, 2)]}
    assert choice.filtered([[0, 1], [0, 1]], [0, 1], lambda m: m) is False
    assert choice.filtered([[0, 1, 2], [0, 1]], [2, 0], lambda m: m) is True
    assert choice.filtered([[0, 1]], [1], lambda m: {0}) is False
    fits = choice.monotone_attention([[0, 1, 2], [0, 1]], [{0: 0.5, 1: 0.3, 2: 0.2}, {0: 0.4, 1: 0.6}])
    assert fits["is_consistent"] and fits["order"].index(0) < fits["order"].index(2)


def test_random_attention():
    """Never chosen items stand below chosen ones of the menu; the distance is that of the first order."""
    none = choice.random_attention([[0, 1], [0, 1]], [{0: 1.0, 1: 0.0}, {0: 0.0, 1: 1.0}])
    assert not none["is_consistent"] and none["statistic"] == 1.0 and none["p_value"] == 0.0
    found = choice.random_attention([[0, 1, 2]], [{0: 0.2, 1: 0.8, 2: 0.0}])
    assert found["order"] == [0, 1, 2] and found["n_orders"] == 2
    assert found["statistic"] == pytest.approx(0.36 / 2)
    distances = [choice.attention_distance([[0, 1, 2]], [{0: 0.2, 1: 0.8, 2: 0.0}], list(o)) for o in itertools.permutations(range(3))]
    assert found["p_value"] == pytest.approx(np.mean([d >= 0.18 - 1e-12 for d in distances]))
    many = choice.random_attention([list(range(9))], [{i: (i == 4) * 1.0 for i in range(9)}])
    assert many["n_orders"] == math.factorial(8) and many["order"][0] == 4 and many["is_consistent"]
    with pytest.raises(ValueError, match="items"):
        choice.random_attention([list(range(21))], [{0: 1.0}])


@pytest.mark.parametrize("n", [5, 12, 30])
def test_consensus_of_many_items(n):
    """Beyond what a search could try, majority groups decide, and cycles are searched one by one."""
    chance = np.random.default_rng(n)
    order = chance.permutation(n).tolist()
    assert choice.exact_consensus(list(range(n)), np.array([[3.0 * (order.index(a) < order.index(b)) for b in range(n)] for a in range(n)])) == (order, True)
    # triples that beat each other in a circle, after one another
    prefer = np.zeros((n, n))
    for a in range(n):
        for b in range(n):
            if a // 3 < b // 3:
                prefer[a, b] = 2
            elif a // 3 == b // 3 and (b - a) % 3 == 1 and a != b:
                prefer[a, b] = 1 + (a % 3 == 2)
    found, proven = choice.exact_consensus(list(range(n)), prefer)
    assert proven and [x // 3 for x in found] == sorted(x // 3 for x in range(n))
    loss = sum(prefer[b, a] for a, b in itertools.combinations(found, 2))
    groups = [list(range(k, min(n, k + 3))) for k in range(0, n, 3)]
    assert loss == sum(min(sum(prefer[b, a] for a, b in itertools.combinations(o, 2)) for o in itertools.permutations(g)) for g in groups)


def test_insertions_when_a_cycle_is_too_large():
    n = choice.KEMENY_UP_TO + 2
    prefer = np.array([[1.0 if (b - a) % n in range(1, n // 2) else 0.0 for b in range(n)] for a in range(n)])
    found, proven = choice.exact_consensus(list(range(n)), prefer)
    assert sorted(found) == list(range(n)) and not proven


def test_logit_recovers_utilities():
    u = np.array([0.0, 1.0, 2.0])
    menus = [[0, 1], [1, 2], [0, 1, 2]]
    counts = [(10**6 * np.exp(u[m]) / np.exp(u[m]).sum()).round().astype(int).tolist() for m in menus]
    found = choice.logit(menus, counts)
    assert [found["utility"][i] for i in range(3)] == pytest.approx([0, 1, 2], abs=1e-3)
    assert found["aic"] == pytest.approx(4 - 2 * found["log_likelihood"])
    assert found["bic"] == pytest.approx(2 * math.log(sum(map(sum, counts))) - 2 * found["log_likelihood"])


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 5), st.integers(1, 6))
def test_kemeny_has_fewest_disagreements(seed, n, voters):
    chance = np.random.default_rng(seed)
    rankings = [chance.permutation(n).tolist() for _ in range(voters)]

    def disagree(order):
        return sum((r.index(a) < r.index(b)) != (order.index(a) < order.index(b)) for r in rankings for a, b in itertools.combinations(range(n), 2))

    assert disagree(choice.kemeny(rankings)) == min(disagree(o) for o in itertools.permutations(range(n)))


def test_expected_utility():
    half = np.array([0.5, 0.5])
    sure = np.array([[40.0, 40.0], [100.0, 0.0]])
    assert choice.expected_utility([(sure, half, 0)])
    assert choice.expected_utility([(sure, half, 0)], "averse") and not choice.expected_utility([(sure, half, 0)], "seeking")
    assert not choice.expected_utility([(sure, half, 0)], "neutral") and choice.expected_utility([(sure, half, 1)], "neutral")
    better = np.array([[50.0, 50.0], [60.0, 55.0]])
    assert not choice.expected_utility([(better, half, 0)]) and choice.dominated(better, half, 0)
    allais = [(np.array([[1.0, 1.0], [2.0, 0.0]]), half, 0), (np.array([[1.0, 1.0], [2.0, 0.0]]), half, 1)]
    assert choice.expected_utility(allais)


def test_technical_efficiency():
    inputs, outputs = np.array([[1.0], [1.0], [2.0]]), np.array([[1.0], [2.0], [2.0]])
    assert choice.technical_efficiency(inputs, outputs).tolist() == [0.5, 1, 1]
    assert choice.technical_efficiency(inputs, outputs, "input").tolist() == [1, 1, 0.5]


def test_panels(spark):
    panel = Panel(generate.budgets(spark, 10, n_obs=7, n_goods=2))
    assert panel.users().count() == 10 and panel.summary().first()["n_users"] == 10
    pieces = panel.windows(3)
    assert pieces.rows.count() == 20 and pieces.of_period("1").rows.count() == 10
    assert panel.filter(panel.rows["user_id"] == "3").users().count() == 1
    audit = Auditor(simulations=20)
    assert {r["verdict"] for r in audit.audit(panel).collect()} <= {"consistent", "nearly consistent", "inconsistent"}
    assert audit.details(panel).count() == audit.power(panel).count() == 10
    assert audit.granular(panel).count() == 70
    assert len({len(r["features"]) for r in Encoder(("garp", "ccei")).transform(panel).collect()}) == 1
    table = spark.createDataFrame([("a", "x", 1, 1.0, 2.0), ("a", "x", 2, 2.0, 1.0), ("a", "y", 1, 1.0, 1.0)], "u string, period string, t int, p double, q double")
    by_period = Panel.from_table(table, user_col="u", cost_cols=["p"], action_cols=["q"], time_col="t", period_col="period")
    assert sorted(r["user_id"] for r in by_period.rows.collect()) == ["a__x", "a__y"] and by_period.periods().count() == 2
    menus = MenuPanel.from_table(spark.createDataFrame([("u", [0, 1], 0), ("u", [0, 1], 1)], "u string, menu array<int>, choice int"), user_col="u")
    assert menus.summary().first()["share_sarp"] == 0 and audit.menus(menus).first()["efficiency"] == 0.5
