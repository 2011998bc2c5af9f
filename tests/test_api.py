import numpy as np
import pytest

from concordia import api, errors
from concordia.sources import files, generate, ingest

WIDE = [
    ("a", 1, 1.0, 0.1, 2.0, 0.0), ("a", 2, 0.1, 1.0, 0.0, 2.0),
    ("b", 1, 1.0, 2.0, 4.0, 1.0), ("b", 2, 2.0, 1.0, 1.0, 4.0),
    ("c", 1, 1.0, 2.0, 3.0, 1.0),
]
COLUMNS = "user_id string, t int, price_x double, price_y double, qty_x double, qty_y double"
ROLES = {"cost_cols": ["price_x", "price_y"], "action_cols": ["qty_x", "qty_y"], "time_col": None}


@pytest.fixture(scope="module")
def wide(spark):
    return spark.createDataFrame(WIDE, COLUMNS)


def scores(df):
    return {r["user_id"]: r for r in df.collect()}


def test_wide(wide):
    found = scores(api.analyze(wide, cost_cols=["price_x", "price_y"], action_cols=["qty_x", "qty_y"], metrics=["garp", "ccei", "mpi", "harp", "hm"]))
    assert set(found) == {"a", "b", "c"}
    assert (found["a"]["is_garp"], found["a"]["ccei"], found["a"]["hm_consistent"]) == (False, pytest.approx(0.1), 1)
    assert found["b"]["is_garp"] and found["b"]["is_harp"]
    assert found["c"]["ccei"] == 1 and found["c"]["hm_total"] == 1


def test_unasked_metrics(wide):
    row = scores(api.analyze(wide, cost_cols=["price_x", "price_y"], action_cols=["qty_x", "qty_y"], metrics=["garp"]))["a"]
    assert row["is_harp"] is None and row["hm_consistent"] is None and row["utility_success"] is None
    assert (row["ccei"], row["mpi"], row["vei_mean"]) == (1.0, 0.0, 1.0)


def long_of(rows):
    return [(u, t, item, p, q) for u, t, px, py, qx, qy in rows for item, p, q in (("x", px, qx), ("y", py, qy))]


def test_long_equals_wide(spark, wide):
    long = spark.createDataFrame(long_of(WIDE), "who string, week int, product string, price double, quantity double")
    a = scores(api.analyze(long, user_col="who", item_col="product", cost_col="price", action_col="quantity", time_col="week"))
    b = scores(api.analyze(wide, price_cols=["price_x", "price_y"], qty_cols=["qty_x", "qty_y"], time_col="t"))
    assert {k: (v["is_garp"], v["ccei"], v["mpi"]) for k, v in a.items()} == {k: (v["is_garp"], v["ccei"], v["mpi"]) for k, v in b.items()}


def test_menus(spark):
    rows = [("u", 1, [0, 1], 0), ("u", 2, [1, 2], 1), ("u", 3, [2, 0, 2], 2), ("v", 1, [5, 9], 9)]
    df = spark.createDataFrame(rows, "user_id string, t int, shown array<int>, clicked int")
    found = scores(api.analyze(df, menu_col="shown", choice_col="clicked", time_col="t"))
    assert not found["u"]["is_sarp"] and found["u"]["is_warp"] and found["u"]["hm_consistent"] == 2
    assert found["v"]["is_sarp"] and found["v"]["hm_total"] == 2
    with pytest.raises(errors.ValueRangeError):
        api.analyze(spark.createDataFrame([("u", 1, [0, 1], 7)], df.schema), menu_col="shown", choice_col="clicked")
    with pytest.warns(UserWarning, match="no effect"):
        api.analyze(df, menu_col="shown", choice_col="clicked", metrics=["garp"])


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), None])
def test_null_policies(spark, bad):
    df = spark.createDataFrame([*WIDE, ("d", 1, bad, 1.0, 1.0, 1.0), ("d", 2, 1.0, 1.0, 1.0, 1.0)], COLUMNS)
    roles = {"cost_cols": ["price_x", "price_y"], "action_cols": ["qty_x", "qty_y"]}
    with pytest.raises(errors.NonFiniteError, match="1 rows"):
        api.analyze(df, **roles)
    assert scores(api.analyze(df, nan_policy="drop", metrics=["hm"], **roles))["d"]["hm_total"] == 1
    with pytest.warns(UserWarning, match="dropped"):
        api.analyze(df, nan_policy="warn", **roles)


def test_errors(spark, wide):
    with pytest.raises(errors.FormatError, match="no layout"):
        api.analyze(wide)
    with pytest.raises(errors.FormatError, match="several"):
        api.analyze(wide, cost_cols=["price_x"], action_cols=["qty_x"], item_col="t")
    with pytest.raises(errors.ColumnError, match="Similar: price_x"):
        api.analyze(wide, cost_cols=["prices_x", "price_y"], action_cols=["qty_x", "qty_y"])
    with pytest.raises(errors.ColumnError, match="numeric"):
        api.analyze(wide, cost_cols=["user_id"], action_cols=["qty_x"])
    with pytest.raises(errors.MetricError):
        api.Engine(metrics=["speed"])
    with pytest.raises(TypeError):
        api.analyze(wide, nonsense=1)
    low = spark.createDataFrame([("a", 1, 0.0, 1.0, 1.0, 1.0)], COLUMNS)
    with pytest.raises(errors.ValueRangeError):
        api.analyze(low, cost_cols=["price_x", "price_y"], action_cols=["qty_x", "qty_y"])
    schema = "user_id string, time int, item string, price double, quantity double"
    roles = {"item_col": "item", "cost_col": "price", "action_col": "quantity"}
    with pytest.raises(errors.DuplicateError):
        api.analyze(spark.createDataFrame([("a", 1, "x", 1.0, 1.0)] * 2, schema), **roles)
    gaps = spark.createDataFrame([("a", 1, "x", 1.0, 1.0), ("a", 2, "y", 1.0, 1.0)], schema)
    with pytest.raises(errors.NonFiniteError):
        api.analyze(gaps, **roles)
    assert api.analyze(gaps, missing="zero", **roles).count() == 1


def test_parquet(spark, wide, tmp_path):
    wide.write.parquet(f"{tmp_path}/wide")
    engine = api.Engine(metrics=["garp", "ccei"])
    found = scores(engine.analyze_parquet(spark, f"{tmp_path}/wide", cost_cols=["price_x", "price_y"], action_cols=["qty_x", "qty_y"]))
    assert set(found) == {"a", "b"}
    path = engine.analyze_parquet(spark, f"{tmp_path}/wide", output_path=f"{tmp_path}/out", cost_cols=["price_x", "price_y"], action_cols=["qty_x", "qty_y"])
    assert {k: v["ccei"] for k, v in scores(spark.read.parquet(path)).items()} == {k: v["ccei"] for k, v in found.items()}
    wide.write.option("header", True).csv(f"{tmp_path}/table.csv")
    counts = files.prepare(spark, f"{tmp_path}/table.csv", f"{tmp_path}/sorted", partitions=2)
    assert (counts["n_rows"], counts["n_users"]) == (5, 3)
    assert files.read(spark, f"{tmp_path}/sorted", "parquet").count() == 5
    with pytest.raises(ValueError, match="can't tell"):
        files.read(spark, "x.xlsx")


def test_arrays(spark):
    engine = api.Engine(metrics=["garp", "ccei"])
    found = scores(engine.analyze_arrays(spark, [(np.array([[1, 0.1], [0.1, 1]]), np.array([[2, 0], [0, 2]])), (np.ones((3, 2)), np.ones((3, 2)))]))
    assert found["0"]["ccei"] == pytest.approx(0.1) and found["1"]["is_garp"]
    menus = scores(engine.analyze_arrays(spark, [([[0, 1], [0, 1]], [0, 1], 2)], data_type="menu"))
    assert not menus["0"]["is_warp"]
    with pytest.raises(errors.ValueRangeError):
        engine.analyze_arrays(spark, [(np.zeros((1, 2)), np.ones((1, 2)))])


def test_users_of_many_shapes(spark):
    rows = generate.budgets(spark, 60, n_obs=(1, 12), n_goods=3, seed=1).union(generate.budgets(spark, 20, n_obs=5, n_goods=6, seed=2))
    from concordia.plans import score

    one = sorted(map(str, score.score_budget(rows, ("garp", "ccei")).drop("compute_time_us").collect()))
    assert one == sorted(map(str, score.score_budget(rows.repartition(7), ("garp", "ccei")).drop("compute_time_us").collect()))
    assert len(one) == 80


def test_generators(spark):
    best = generate.budgets(spark, 30, rationality=1.0)
    assert api.Engine(metrics=["garp"]).analyze_budgets(best).filter("not is_garp").count() == 0
    for form in ("ces", "leontief"):
        assert api.Engine(metrics=["garp"]).analyze_budgets(generate.budgets(spark, 20, form=form, rationality=1.0)).filter("not is_garp").count() == 0
    a, b = generate.menus(spark, 20, rationality=1.0, model="best"), generate.menus(spark, 20, rationality=1.0, model="best").repartition(5)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert api.Engine().analyze_menus(a).filter("not is_sarp").count() == 0
    assert generate.demo(spark, 50).count() == 50
    assert generate.production(spark, 5).count() == 5
    assert generate.dated(spark, 5, n_obs=4).count() == 20


def test_layouts():
    assert ingest.detect_layout(item_col="i", cost_col="p", action_col="q") == "long"
    assert ingest.detect_layout(menu_col="m") == "menu"
    with pytest.raises(errors.FormatError):
        ingest.detect_layout(cost_cols=["a"], action_cols=["b", "c"])
