"""Queries against their SQL on small tables, operators against goldens, streams against batches."""

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from concordia import checked, checked_datasets, registry
from concordia.operators import budget, dated, production, ranking, stochastic
from concordia.plans import inference, score, structure
from concordia.sources import generate, market
from concordia.streaming import scoring

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    out = []
    for row in frame.astype(object).where(frame.notna(), None).values.tolist():
        out.append(tuple(round(float(x), 5) + 0.0 if isinstance(x, float) else x for x in row))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def db():
    with duckdb.connect() as connection:
        for t in TABLES:
            connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        yield connection


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    mine = registry.QUERIES[name](spark, FOLDER).toPandas()
    theirs = db.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows_of(mine) == rows_of(theirs)


def between(*names):
    return lambda f: f[list(names)].ge(-1e-9).all().all() and f[list(names)].le(1 + 1e-9).all().all()


#: What has to hold of results that SQL doesn't give.
HOLDS = {
    "budget_all_metrics": lambda f: (
        ((f["hm_consistent"] == f["hm_total"]) == f["is_garp"]).all() and (f["vei_exact_mean"] >= f["ccei"] - 1e-6).all() and (f[f["is_garp"]][["ccei", "vei_mean", "vei_exact_min"]] == 1).all().all()
        and (f[f["is_garp"]]["mpi"] == 0).all() and (f["is_harp"] <= f["is_garp"]).all() and (f["utility_success"] == f["is_garp"]).all() and (f["vei_exact_min"] <= f["vei_exact_mean"] + 1e-9).all()
    ),
    "budget_power": between("power", "mean_ccei"),
    "budget_selten": lambda f: between("hit", "area", "smoothed_hit", "credibility")(f) and (abs(f["success"] - f["hit"] + f["area"]) < 1e-5).all(),
    "budget_optimal_efficiency": between("level"),
    "budget_bootstrap": lambda f: between("ccei", "low", "high")(f) and (f["low"] <= f["high"]).all() and (f["std_error"] >= 0).all(),
    "budget_holdout": between("hit_rate", "random_rate"),
    "budget_cycles": lambda f: (f["length"] >= 2).all() and (f["length"] == f["nodes"].map(len)).all() and f["nodes"].map(lambda n: len(set(n)) == len(n)).all() and (f["cost"] > -1e-9).all(),
    "budget_indices": lambda f: ((f["n_swaps"] == 0) == (f["continuous_ccei"] > 1 - 1e-9)).all() and between("continuous_ccei", "swaps_index")(f),
    "budget_contributions": lambda f: between("share")(f) and f.groupby("user_id")["share"].sum().round(4).isin([0, 1]).all(),
    "budget_centrality": lambda f: between("betweenness")(f) and f.groupby("user_id")["out_degree"].sum().equals(f.groupby("user_id")["in_degree"].sum()),
    "budget_utilities": lambda f: (f["multiplier"] > 0).all(),
    "budget_separability": between("within_a", "within_b", "cross_effect"),
    "budget_partition": lambda f: f.groupby("user_id")["goods"].sum().map(lambda g: len(set(g)) == len(g)).all() if f["goods"].map(type).eq(list).all() else f.groupby("user_id")["goods"].agg(lambda g: len(set(np.concatenate(list(g)))) == sum(map(len, g))).all(),
    "budget_integrability": lambda f: (f["is_integrable"] == (f["is_symmetric"] & f["is_nsd"])).all(),
    "menu_audit": lambda f: between("efficiency")(f) and ((f["efficiency"] == 1) == f["is_sarp"]).all(),
    "choice_random_utility": lambda f: bool(f["is_exact"].all()) and (f["distance"] >= 0).all() and ((f["distance"] == 0) == f["is_consistent"]).all(),
    "bradley_terry": lambda f: abs(f["strength"].sum() - 1) < 1e-4 and f["log_score"].min() == 0,
    "kemeny_order": lambda f: sorted(f["place"]) == list(range(len(f))) and f["item"].is_unique and f["is_exact"].all(),
    "ideal_points": lambda f: f["n_violations"].between(0, f["n_choices"]).all(),
    "risk_profiles": between("consistency"),
    "choice_logit": lambda f: (f["utility"] >= 0).all() and (f["log_likelihood"] <= 0).all() and (f["aic"] > -2 * f["log_likelihood"]).all(),
}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_other_queries_hold(spark, name):
    """Values of a query without SQL: what has to hold of them, or at least numbers without a NaN, one user or more."""
    found = registry.QUERIES[name](spark, FOLDER).toPandas()
    assert len(found) > 0 and not found.iloc[:, 0].isna().any()
    numbers = found.select_dtypes("number")
    assert not np.isinf(numbers.to_numpy(dtype=float, na_value=0.0)).any()
    assert HOLDS.get(name, lambda f: True)(found)


@pytest.mark.parametrize("name", sorted(checked.ORACLE_SQL))
def test_checked_query_equals_sql(spark, db, name):
    mine = checked.QUERIES[name](spark, FOLDER).toPandas()
    theirs = db.execute(checked.ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows_of(mine) == rows_of(theirs)


@pytest.mark.parametrize("name", sorted(checked_datasets.ORACLE_SQL))
def test_dataset_query_equals_sql(spark, db, name):
    mine = checked_datasets.QUERIES[name](spark, FOLDER).toPandas()
    theirs = db.execute(checked_datasets.ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows_of(mine) == rows_of(theirs)


def test_datasets_from_folders(spark, tmp_path):
    """Files in their own layouts: headers or none, tabs, gaps in prices and codes that look like numbers."""
    from concordia import errors
    from concordia.sources import datasets

    put = lambda name, text: (tmp_path / name).write_text(text)
    put("transactions_train.csv", "t_dat,customer_id,article_id,price,sales_channel_id\n" + "".join(f"2020-0{m}-15,c{m % 2}000000000000,0{g}10,0.{g}5,1\n" for m in range(1, 9) for g in (1, 2)))
    found = {r["user_id"]: r["obs"] for r in datasets.load(spark, "hm", str(tmp_path), min_periods=3, period="month").collect()}
    assert sorted(found) == ["customer_c00000000000", "customer_c10000000000"] and all(len(o) == 4 and o[0]["q"] == [1.0, 1.0] and o[0]["p"] == [0.15, 0.25] for o in found.values())
    put("UserBehavior.csv", "".join(f"7,{i},1,{'buy' if k == 2 else 'pv'},{1_511_000_000 + s * 9000 + k}\n" for s in range(6) for k, i in enumerate((5, 6, 6))))
    rows = datasets.renumbered(datasets.load(spark, "taobao", str(tmp_path))).collect()
    assert len(rows) == 6 and all(r["menu"] == [0, 1] and r["choice"] == 1 for r in rows)
    put("behaviors.tsv", "".join(f"{k}\tU1\t11/11/2019\tN9\tN1-0 N2-1 N3-0\n" for k in range(5)) + "9\tU2\tx\t\tN1-1 N2-1\n")
    rows = datasets.load(spark, "mind", str(tmp_path)).collect()
    assert len(rows) == 5 and {r["choice"] for r in rows} == {"N2"}
    put("ctr_data_1M.csv", "user_id,item_id,click,like\n" + "".join(f"1,{k},{int(k != 3)},{int(k % 3 == 2)}\n" for k in range(18)))
    assert [r["menu"] for r in datasets.load(spark, "tenrec", str(tmp_path)).orderBy("t").limit(2).collect()] == [[0, 1, 2], [4, 5]]
    prices = {a: p for a, p in spark.createDataFrame([(a,) for a in ("Frozen Juice", "ice cream ice", "cream", "packaged cheese", "nothing known")], "a string").select("a", datasets.aisle_price(F.col("a"))).collect()}
    assert prices == {"Frozen Juice": 3.0, "ice cream ice": 4.5, "cream": 3.5, "packaged cheese": 5.0, "nothing known": 3.0}
    with pytest.raises(errors.FormatError):
        datasets.load(spark, "none", str(tmp_path))


def test_listed_categories_come_before_frequent_ones(spark):
    from concordia.sources import datasets

    sold = [(o, k) for o in (1, 2, 3) for k in ("tv", "tv", "toys", "auto")]
    orders = spark.createDataFrame([(o, o, "delivered", f"2017-0{o}-05 10:00:00") for o in (1, 2, 3)], "order_id long, customer_id long, order_status string, order_purchase_timestamp string")
    customers = spark.createDataFrame([(o, "c") for o in (1, 2, 3)], "customer_id long, customer_unique_id string")
    items = spark.createDataFrame([(o, k, 10.0) for o, k in sold], "order_id long, product_id string, price double")
    products = spark.createDataFrame([(k, k) for k in ("tv", "toys", "auto")], "product_id string, product_category_name string")
    names = spark.createDataFrame([(k, k) for k in ("tv", "toys", "auto")], "product_category_name string, product_category_name_english string")
    bought = lambda n: [o["q"] for o in datasets.olist(orders, customers, items, products, names, n_categories=n).first()["obs"]]
    assert bought(1) == [[1.0]] * 3
    assert bought(2) == [[1.0, 1.0]] * 3
    assert [sum(q) for q in bought(3)] == [4.0] * 3


def test_entry(spark):
    row = entry.entry(spark).first()
    assert set(row.asDict()) == {"user_id", "is_garp", "n_violations", "max_scc", "n_scc"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


def frequencies(spark, cells):
    rows = [("u", menu, item, n, n / sum(by.values())) for menu, by in cells for item, n in by.items()]
    return spark.createDataFrame(rows, "user_id string, menu array<int>, item int, n long, p double")


def test_stochastic_goldens(spark):
    mixed = stochastic.transitivity(frequencies(spark, [([0, 1], {0: 60, 1: 40}), ([1, 2], {1: 100, 2: 0}), ([0, 2], {0: 60, 2: 40})])).first()
    assert (mixed["weak"], mixed["moderate"], mixed["strong"]) == (0, 0, 1)
    cyclic = stochastic.transitivity(frequencies(spark, [([0, 1], {0: 60, 1: 40}), ([1, 2], {1: 60, 2: 40}), ([0, 2], {2: 60, 0: 40})])).first()
    assert cyclic["weak"] > 0
    irregular = stochastic.regularity(frequencies(spark, [([0, 1], {0: 55, 1: 45}), ([0, 1, 2], {0: 70, 1: 20, 2: 10})])).first()
    assert not irregular["is_regular"] and irregular["worst"] == pytest.approx(0.15)
    decoy = stochastic.decoys(frequencies(spark, [([0, 1], {0: 40, 1: 60}), ([0, 1, 2], {0: 60, 1: 35, 2: 5})])).collect()
    assert [(r["target"], r["decoy"]) for r in decoy if r["is_decoy"]] == [(0, 2)]


def test_logit_allows_odds_that_vary_a_little(spark):
    def counts(odd):  # odds of 0 to 1 are 1 in one menu and ``odd`` / 100 in the other
        cells = {(0, 1): (100, 100), (0, 1, 2): (odd, 100, 50)}
        rows = [("u", list(m), i, n, n / sum(ns)) for m, ns in cells.items() for i, n in zip(m, ns, strict=True)]
        return spark.createDataFrame(rows, "user_id string, menu array<int>, item int, n long, p double")

    for odd, held in ((105, True), (115, True), (130, False)):
        row = stochastic.perturbed_utility(counts(odd)).first()
        assert (row["is_apu"], row["is_iia"], row["is_logit"]) == (True, held, held)
    assert not stochastic.perturbed_utility(counts(105), odds_tol=0.01).first()["is_logit"]


def test_rankings(spark):
    same = spark.createDataFrame([("p", i, i, i) for i in range(4)] + [("q", i, i, 3 - i) for i in range(4)], "pair_id string, item int, a int, b int")
    found = {r["pair_id"]: r for r in ranking.compare(same).collect()}
    assert (found["p"]["tau"], found["p"]["footrule"]) == (1, 0)
    assert (found["q"]["tau"], found["q"]["footrule"]) == (-1, 1)
    lists = spark.createDataFrame([("p", [1, 2, 3], [1, 2, 3]), ("q", [1, 2], [3, 4])], "pair_id string, a array<int>, b array<int>")
    overlap = {r["pair_id"]: r["overlap"] for r in ranking.overlap(lists).collect()}
    assert overlap["p"] == pytest.approx(1) and overlap["q"] == 0
    wins = spark.createDataFrame([(1, 2, 75), (2, 1, 25), (2, 3, 50), (3, 2, 50)], "winner long, loser long, n long")
    strength = {r["item"]: r["strength"] for r in ranking.bradley_terry(wins).collect()}
    assert strength[1] / strength[2] == pytest.approx(3, rel=1e-3) and strength[2] == pytest.approx(strength[3], rel=1e-3)


def test_inference(spark):
    rows = generate.budgets(spark, 6, n_obs=8, n_goods=3, rationality=1.0).repartition(2)
    power = inference.power(rows, 60).collect()
    assert all(0 <= r["power"] <= 1 and r["mean_ccei"] <= 1 for r in power)
    assert sorted(power) == sorted(inference.power(rows.repartition(3), 60).collect())
    for r in inference.selten(rows, 60).collect():
        assert r["hit"] == 1 and r["success"] == pytest.approx(1 - r["area"]) and r["credibility"] >= 0.5
    assert all(r["ccei"] == 1 and r["low"] == r["high"] == 1 for r in inference.bootstrap(rows, 40).collect())
    assert all(r["hit_rate"] == 1 for r in inference.holdout(rows, splits=2).collect())
    assert all(0 < r["level"] <= 1 for r in inference.optimal_efficiency(rows, 40).collect())


def test_holdout_scores_single_observations(spark):
    # ten observations, of which the first two violate: only splits that hold out one of them have a consistent rest
    n, share, splits = 10, 0.2, 40
    obs = [(1, [1.0, 0.5], [2.0, 0.0]), (2, [0.5, 1.0], [0.0, 2.0])] + [(3 + k, [1.0, 1.0], [10.0 * (k + 1), 10.0 * (k + 1)]) for k in range(n - 2)]
    rows = spark.createDataFrame([("a", obs), ("short", obs[:4])], "user_id string, obs array<struct<t:int,p:array<double>,q:array<double>>>")
    found = {r["user_id"]: r for r in inference.holdout(rows, share, splits).collect()}
    # one of the two held out: it misses and the other observation hits; both held out: both hit
    chance, hits = np.random.default_rng([42, xxhash.xxh3_64_intdigest("a")]), []
    p, q = (np.array([o[c] for o in obs], float) for c in (1, 2))
    for _ in range(splits):
        order = chance.permutation(n)
        out = order[:2]
        inside = int(0 in out) + int(1 in out)
        hits += [0, 0] if inside == 0 else [0, 1] if inside == 1 else [1, 1]
        inference.random_bundles(p[out], (p[out] * q[out]).sum(axis=1), 20, chance)
    assert 0 < found["a"]["hit_rate"] < 1 and found["a"]["hit_rate"] == pytest.approx(np.mean(hits))
    assert 0 <= found["a"]["random_rate"] <= 1 and found["a"]["success"] == pytest.approx(found["a"]["hit_rate"] - found["a"]["random_rate"])
    assert (found["short"]["hit_rate"], found["short"]["random_rate"], found["short"]["success"]) == (0, 0, 0)


def test_structure(spark):
    cycle = spark.createDataFrame([("a", [(1, [1.0, 0.1], [2.0, 0.0]), (2, [0.1, 1.0], [0.0, 2.0])])], "user_id string, obs array<struct<t:int,p:array<double>,q:array<double>>>")
    found = structure.cycles(cycle).collect()
    assert [(sorted(r["nodes"]), r["cost"]) for r in found] == [([0, 1], pytest.approx(0.9))]
    assert structure.indices(cycle).first()["n_swaps"] == 1
    assert [r["share"] for r in structure.contributions(cycle).collect()] == [0.5, 0.5]
    assert structure.utilities(cycle).count() == 0
    best = generate.budgets(spark, 3, n_obs=20, n_goods=3, rationality=1.0)
    assert structure.utilities(best).count() == 60
    assert structure.integrability(best).count() == 3
    effects = {(r["g"], r["h"]): r["effect"] for r in structure.slutsky(best.limit(1)).collect()}
    assert all(effects[g, g] < 0 for g in range(3))
    bundle = structure.demand_at(best, [1.0, 1.0, 1.0], 100.0).groupBy("user_id").sum("quantity").collect()
    assert all(r[1] == pytest.approx(100, abs=1e-6) for r in bundle)


def test_shares_that_never_change(spark):
    obs = lambda *q: [(str(t), [1.0, 2.0], [float(a), float(b)]) for t, (a, b) in enumerate(q)]
    rows = [("same", obs((1, 0), (2, 0), (5, 0))), ("one", obs((1, 1), (2, 0))), ("moves", obs((1, 1), (2, 0), (0, 3), (4, 1)))]
    df = spark.createDataFrame(rows, "user_id string, obs array<struct<t: string, p: array<double>, q: array<double>>>")
    found = {r["user_id"]: (r["n_changes"], r["correlation"]) for r in budget.cannibalization(df, [0], [1]).collect()}
    assert found["same"][0] == 2 and np.isnan(found["same"][1])
    assert found["one"] == (1, None)
    assert found["moves"] == (3, pytest.approx(-1))


def test_dated(spark):
    rows = [("u", 50.0, 0, 100.0, 1, 1), ("u", 95.0, 0, 100.0, 1, 0), ("v", 90.0, 0, 100.0, 1, 1), ("v", 50.0, 0, 100.0, 1, 0)]
    df = spark.createDataFrame(rows, "user_id string, amount0 double, date0 long, amount1 double, date1 long, chosen int")
    found = {r["user_id"]: r for r in dated.exponential(df).collect()}
    assert (found["u"]["delta_low"], found["u"]["delta_high"], found["u"]["is_consistent"]) == (0.5, 0.95, True)
    assert not found["v"]["is_consistent"]
    exact = generate.dated(spark, 20, rationality=1.0)
    assert dated.exponential(exact).filter("not is_consistent").count() == 0


def test_production(spark):
    firms = generate.production(spark, 8, rationality=1.0)
    assert production.cost_minimisation(firms).count() == 8
    assert {r["returns"] for r in production.returns_to_scale(firms).collect()} <= {"increasing", "decreasing", "constant"}


@pytest.mark.parametrize("name", ["firm_totals", "profit_efficiency"])
def test_firms_whose_mean_price_ends_on_half_a_cent(spark, tmp_path, name):
    """Files whose sums, taken apart and then added, round to another cent than the lines one after the other."""
    draw = np.random.default_rng(7)
    rows = []
    for supplier in range(400):
        cents = draw.integers(90_000, 10_000_000, 8)
        cents[-1] += 4 - cents.sum() % 8  # over 8 pieces the mean ends on half a cent
        rows += [(supplier, c / 100, k) for k, c in enumerate(cents.tolist())]
    with duckdb.connect(config={"threads": 1}) as connection:
        (tmp_path / "lineitem.parquet").mkdir()
        for file, ks in (("a", range(3)), ("b", range(3, 8))):
            values = ", ".join(f"({s}, {c!r}::DOUBLE)" for s, c, k in sorted(rows, key=lambda r: (r[2], r[0])) if k in ks)
            connection.execute(f"COPY (SELECT s::BIGINT AS l_suppkey, TIMESTAMP '1995-02-03' AS l_shipdate, 1.0::DOUBLE AS l_quantity, c AS l_extendedprice, 0.04::DOUBLE AS l_tax, 'N' AS l_returnflag FROM (VALUES {values}) v(s, c)) TO '{tmp_path}/lineitem.parquet/{file}.parquet'")
        connection.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        theirs = connection.execute(checked.ORACLE_SQL[name]).df()
    assert rows_of(checked.QUERIES[name](spark, str(tmp_path)).toPandas()) == rows_of(theirs)


def test_firms_whose_lines_have_no_return_flag(spark, tmp_path):
    """Such a line costs, but its value is neither delivered nor returned."""
    with duckdb.connect(config={"threads": 1}) as connection:
        values = "(1, 100.0, 'N'), (1, 50.0, NULL), (2, 70.0, NULL), (3, 30.0, 'R'), (3, 20.0, 'A')"
        connection.execute(f"CREATE TABLE lineitem AS SELECT s::BIGINT AS l_suppkey, TIMESTAMP '1995-02-03' AS l_shipdate, 1.0::DOUBLE AS l_quantity, c::DOUBLE AS l_extendedprice, 0.04::DOUBLE AS l_tax, f AS l_returnflag FROM (VALUES {values}) v(s, c, f)")
        connection.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet'")
        theirs = connection.execute(checked.ORACLE_SQL["profit_efficiency"]).df()
    assert rows_of(checked.QUERIES["profit_efficiency"](spark, str(tmp_path)).toPandas()) == rows_of(theirs)


def test_stream_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = generate.budgets(spark, 12, n_obs=6, n_goods=2).select("user_id", F.explode("obs").alias("o"))
    flat = rows.select("user_id", F.col("o.t").alias("t"), *[F.col(f"o.{k}")[g].alias(f"{k}{g}") for k in "pq" for g in (0, 1)])
    flat.filter("t < 3").coalesce(1).write.parquet(f"{tmp_path}/in/first")
    flat.filter("t >= 3").coalesce(1).write.parquet(f"{tmp_path}/in/second")
    stream = spark.readStream.schema(flat.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    scoring.score_stream(
        stream, store=f"{tmp_path}/store", output=f"{tmp_path}/out", checkpoint=f"{tmp_path}/checkpoint", user_col="user_id", cost_cols=["p0", "p1"], action_cols=["q0", "q1"], time_col="t"
    ).awaitTermination(120)
    batch = score.score_budget(generate.budgets(spark, 12, n_obs=6, n_goods=2), ("garp", "ccei")).select("user_id", "is_garp", "ccei")
    assert sorted(scoring.latest(spark, f"{tmp_path}/out").select("user_id", "is_garp", "ccei").collect()) == sorted(batch.collect())


def test_plans(spark):
    """Columns are pruned at the scan, and a group by user after the pairs of a user shuffles nothing."""
    plan = registry.QUERIES["budget_warp"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "l_comment" not in plan and "o_totalprice" not in plan.split("== Physical Plan ==")[1]
    rows = market.market(spark, FOLDER)
    from concordia.operators import budget

    lines = budget.features(rows)._jdf.queryExecution().executedPlan().toString()
    assert lines.count("hashpartitioning(user_id") <= rows._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(user_id")
