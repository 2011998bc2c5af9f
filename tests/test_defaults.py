"""Registered queries run the operators' own numbers of draws."""

import inspect

import pytest

from concordia import registry
from concordia.plans import inference, structure


@pytest.mark.parametrize(
    ("query", "module", "operator"),
    [(f"budget_{n}", inference, n) for n in ("power", "selten", "optimal_efficiency", "bootstrap", "holdout")] + [("budget_slutsky_bootstrap", structure, "slutsky_bootstrap")],
)
def test_draws_are_the_operators_defaults(query, module, operator, spark, monkeypatch):
    seen = []
    own = getattr(module, "each_user")

    def spy(rows, columns, fn, seed):
        seen.append(inspect.getclosurevars(fn).nonlocals)
        return own(rows, columns, fn, seed)

    monkeypatch.setattr(module, "each_user", spy)
    registry.QUERIES[query](spark, "/root/testdata/sf0.001")
    parameters = inspect.signature(getattr(module, operator)).parameters
    counts = [name for name in ("n", "splits") if name in parameters]
    assert counts and all(seen[0][name] == parameters[name].default for name in counts)
