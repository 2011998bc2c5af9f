"""Queries of entry points, sources, generators, streams and further operators, each with its SQL.

Where results are random or not unique (recovered utilities, fitted strengths, simulations),
the query returns what has to hold of them for every user.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordia import registry as base
from concordia.api import Engine, analyze
from concordia.functions import choice
from concordia.operators import budget, dated, panel, production, ranking, stochastic
from concordia.panel import Panel
from concordia.plans import inference, menus, score, structure
from concordia.sources import files, generate, market
from concordia.sources.market import MENU_SQL
from concordia.streaming import scoring

_B, _M, _F, _GARP = base._B, base._M, base._F, base._GARP
#: New prices (cents) of the bounds on demand: one for each good of the grid.
NEW_PRICES = [120_000.0, 130_000.0, 140_000.0, 150_000.0, 160_000.0, 170_000.0]
GENERATED = 300


def _longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def _joined(column: str) -> F.Column:
    return F.concat_ws(",", F.transform(column, lambda i: i.cast("string")))


# ---------------------------------------------------------------- entry points
def _wide(rows: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """One row for each observation, with a price and a quantity column for each good."""
    goods = rows.select(F.max(F.size(F.get("obs", F.lit(0))["p"]))).first()[0] or 0
    o = rows.select("user_id", F.explode("obs").alias("o"))
    costs, actions = [f"price_{g}" for g in range(goods)], [f"qty_{g}" for g in range(goods)]
    return o.select("user_id", F.col("o.t").alias("month"), *[F.get("o.p", F.lit(g)).alias(costs[g]) for g in range(goods)], *[F.get("o.q", F.lit(g)).alias(actions[g]) for g in range(goods)]), costs, actions


def analyze_wide(rows: DataFrame) -> DataFrame:
    wide, costs, actions = _wide(rows)
    found = analyze(wide, user_col="user_id", cost_cols=costs, action_cols=actions, time_col="month", metrics=("garp", "ccei"))
    return _longs(found.select("user_id", "is_garp", "n_violations", "ccei"), "n_violations")


def analyze_long(rows: DataFrame) -> DataFrame:
    o = rows.select("user_id", F.explode("obs").alias("o")).select("user_id", F.col("o.t").alias("month"), F.posexplode(F.arrays_zip("o.p", "o.q")).alias("good", "x"))
    long = o.select("user_id", "month", "good", F.col("x.p").alias("cost"), F.col("x.q").alias("amount"))
    found = analyze(long, user_col="user_id", item_col="good", cost_col="cost", action_col="amount", time_col="month", metrics=("garp",))
    return _longs(found.select("user_id", "is_garp", "n_violations", "max_scc", "n_scc"), "n_violations", "max_scc", "n_scc")


def analyze_menu(rows: DataFrame) -> DataFrame:
    found = analyze(rows, user_col="user_id", menu_col="menu", choice_col="choice", time_col="t")
    return _longs(found.select("user_id", "is_sarp", "is_warp", "is_warp_la", "n_sarp_violations", "n_warp_violations"), "n_sarp_violations", "n_warp_violations")


def engine_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as observations: price and quantity are bought at, in amounts of quantity and line number."""
    found = Engine(("garp",)).analyze_parquet(spark, f"{sf_dir}/lineitem.parquet", user_col="l_orderkey", cost_cols=["l_extendedprice", "l_quantity"], action_cols=["l_quantity", "l_linenumber"], time_col="l_linenumber")
    return _longs(found.select("user_id", "is_garp", "n_violations"), "n_violations")


def engine_parquet_to_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same written to Parquet and read back, as shares."""
    path = f"{files.shared_dir(spark)}/concordia-scores-{uuid.uuid4().hex}"
    Engine(("garp",)).analyze_parquet(spark, f"{sf_dir}/lineitem.parquet", output_path=path, user_col="l_orderkey", cost_cols=["l_extendedprice", "l_quantity"], action_cols=["l_quantity", "l_linenumber"], time_col="l_linenumber")
    return files.read(spark, path, "parquet").groupBy("is_garp").agg(F.count(F.lit(1)).alias("n_users"), F.sum(F.col("n_violations").cast("long")).alias("n_violations"))


def engine_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three in-memory users: consistent, with one violation, and of menus with a reversal."""
    engine = Engine(("garp", "ccei"))
    budgets = engine.analyze_arrays(spark, [([[1, 2], [2, 1]], [[4, 1], [1, 4]]), ([[2, 1], [1, 2]], [[4, 1], [1, 4]])]).select(F.concat(F.lit("budget "), "user_id").alias("user_id"), F.col("is_garp").alias("is_consistent"))
    chosen = engine.analyze_arrays(spark, [([[0, 1], [0, 1]], [0, 1], 2)], "menu").select(F.concat(F.lit("menu "), "user_id").alias("user_id"), F.col("is_sarp").alias("is_consistent"))
    return budgets.union(chosen)


# ---------------------------------------------------------------- sources and sinks
def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a table written in order of its users."""
    path = f"{files.shared_dir(spark)}/concordia-prepared-{uuid.uuid4().hex}"
    found = files.prepare(spark, f"{sf_dir}/lineitem.parquet", path, user_col="l_suppkey")
    ordered = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.min("l_suppkey").alias("low"), F.max("l_suppkey").alias("high"))
    apart = ordered.select((F.lag("high").over(Window.orderBy("low")) <= F.col("low")).alias("fine")).agg(F.coalesce(F.min("fine"), F.lit(True)).alias("in_order"))
    return apart.select(F.lit(found["n_rows"]).cast("long").alias("n_rows"), F.lit(found["n_users"]).cast("long").alias("n_users"), "in_order")


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as CSV and read back with their schema."""
    path = f"{files.shared_dir(spark)}/concordia-orders-{uuid.uuid4().hex}.csv"
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_totalprice")
    orders.write.option("header", True).csv(path)
    rows = files.read(spark, path, "csv", orders.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    return rows.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# ---------------------------------------------------------------- generators
def generated_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undisturbed demand of three forms is consistent and spends what there is."""
    out = None
    for form in ("cobb_douglas", "ces", "leontief"):
        rows = generate.budgets(spark, GENERATED, n_obs=12, n_goods=4, form=form, rationality=1.0, noise=0.0)
        spend = F.transform("obs", lambda o: budget.dot(o["p"], o["q"]))
        own = rows.select("user_id", F.size("obs").cast("long").alias("n_obs"), (F.forall(spend, lambda x: x.between(50 - 1e-6, 150 + 1e-6))).alias("within"))
        found = score.score_budget(rows, ("garp",)).select("user_id", "is_garp").join(own, "user_id").select(F.lit(form).alias("form"), "user_id", "n_obs", "is_garp", "within")
        out = found if out is None else out.union(found)
    return out


def generated_menus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choices of the best item have an order; menus have two to four of eight items."""
    rows = generate.menus(spark, GENERATED, n_obs=9, n_items=8, menu_size=(2, 4), model="best", rationality=1.0)
    fits = F.forall("obs", lambda o: F.size(o["menu"]).between(2, 4) & F.array_contains(o["menu"], o["choice"]) & (F.array_max(o["menu"]) < 8))
    return score.score_menu(rows).select("user_id", "is_sarp").join(rows.select("user_id", F.size("obs").cast("long").alias("n_obs"), fits.alias("fits")), "user_id")


def generated_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choices by one discount factor are consistent with one."""
    found = dated.exponential(generate.dated(spark, GENERATED, n_obs=8, rationality=1.0).drop("t"))
    return found.select("user_id", F.col("n_choices").cast("long").alias("n_choices"), "is_consistent")


def generated_firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = generate.production(spark, GENERATED, n_obs=7, n_inputs=3, n_outputs=2)
    fits = F.forall("obs", lambda o: (F.size(o["ip"]) == 3) & (F.size(o["oq"]) == 2) & (F.array_min(o["iq"]) > 0) & (F.array_min(o["oq"]) > 0))
    return rows.select("user_id", F.size("obs").cast("long").alias("n_obs"), fits.alias("fits"))


def generated_demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a hundred users two fifths are consistent by construction, two fifths noisy and the others random."""
    found = score.score_budget(generate.demo(spark, 100), ("garp",))
    kind = F.substring_index("user_id", "-", 1)
    return found.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(kind == "consistent", F.col("is_garp")).otherwise(True)).alias("as_made"))


# ---------------------------------------------------------------- streams
def streamed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of order lines that arrive as a stream, after all batches."""
    at = f"{files.shared_dir(spark)}/concordia-stream-{uuid.uuid4().hex}"
    table = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    table.withColumn("l_units", F.col("l_linenumber").cast("double")).repartition(4, "l_linenumber").write.parquet(f"{at}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{at}/in").schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    query = scoring.score_stream(stream, store=f"{at}/store", output=f"{at}/out", checkpoint=f"{at}/checkpoint", user_col="l_orderkey", cost_cols=["l_extendedprice", "l_quantity"], action_cols=["l_quantity", "l_units"], time_col="l_linenumber", metrics=("garp",))
    query.awaitTermination()
    found = scoring.latest(spark, f"{at}/out")
    return _longs(found.select("user_id", "is_garp", "n_violations"), "n_violations")


def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows over events, from the operator that streams use too."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"))
    return scoring.windowed_sessions(events).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.max("n_events").alias("longest"))


# ---------------------------------------------------------------- budgets
def _scored(metrics: tuple[str, ...], *columns: str):
    return lambda rows: score.score_budget(rows, metrics).select("user_id", *columns)


def graph_rows(rows: DataFrame) -> DataFrame:
    return _longs(structure.graph_edges(rows), "i", "j", "component")


def shortest_cycles(rows: DataFrame) -> DataFrame:
    """Length of the shortest violating cycle, 0 for consistent users."""
    found = structure.cycles(rows).groupBy("user_id").agg(F.min("length").cast("long").alias("shortest"))
    return rows.select("user_id").join(found, "user_id", "left").select("user_id", F.coalesce("shortest", F.lit(0)).alias("shortest"))


def paths(rows: DataFrame) -> DataFrame:
    return _longs(structure.centrality(rows).select("user_id", "i", "out_degree", "in_degree", "betweenness"), "i", "out_degree", "in_degree")


def continuous(rows: DataFrame) -> DataFrame:
    return structure.indices(rows).select("user_id", "continuous_ccei")


def afriat(rows: DataFrame) -> DataFrame:
    """Recovered numbers against Afriat's inequalities."""
    u = structure.utilities(rows)
    e = budget.edges(rows).select("user_id", "i", "j", "own", "e")
    name = lambda c: u.select("user_id", F.col("i").alias(c), F.col("utility").alias(f"u_{c}"), F.col("multiplier").alias(f"m_{c}"))
    both = e.join(name("i"), ["user_id", "i"]).join(name("j"), ["user_id", "j"])
    # U_j <= U_i + m_i (p_i x_j - p_i x_i), to rounding
    over = F.col("u_j") > F.col("u_i") + F.col("m_i") * (F.col("e") - F.col("own")) + 1e-6 * (1 + F.abs("u_i") + F.abs("u_j") + F.abs(F.col("m_i") * F.col("own")))
    broken = both.groupBy("user_id").agg(F.sum((over | (F.col("m_i") <= 0)).cast("long")).alias("n_broken"))
    has = u.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_numbers"))
    return rows.select("user_id").join(has, "user_id", "left").join(broken, "user_id", "left").select("user_id", F.coalesce("n_numbers", F.lit(0)).alias("n_numbers"), F.coalesce("n_broken", F.lit(0)).alias("n_broken"))


def holdout_holds(rows: DataFrame) -> DataFrame:
    """A consistent history hits each time, and success is the difference of the rates."""
    found = inference.holdout(rows).join(base.garp(rows).select("user_id", "is_garp"), "user_id").join(rows.select("user_id", F.size("obs").alias("n")), "user_id")
    fits = F.col("hit_rate").between(0, 1) & F.col("random_rate").between(0, 1) & (F.abs(F.col("success") - F.col("hit_rate") + F.col("random_rate")) < 1e-9)
    return found.select("user_id", F.when(F.col("n") < 5, F.col("hit_rate") == 0).when(F.col("is_garp"), F.col("hit_rate") == 1).otherwise(True).alias("hits"), fits.alias("fits"))


def simulations_hold(rows: DataFrame) -> DataFrame:
    """Power, area, bootstrap and level of the same histories agree with the index itself."""
    level = score.score_budget(rows, ("garp", "ccei")).select("user_id", "is_garp", "ccei")
    power = inference.power(rows).select("user_id", "power", "mean_ccei")
    area = inference.selten(rows).select("user_id", "hit", "area", "success")
    boot = inference.bootstrap(rows).select("user_id", F.col("ccei").alias("own"), "low", "high", "std_error")
    best = inference.optimal_efficiency(rows).select("user_id", F.col("level"), F.col("success").alias("gain"))
    all_ = level.join(power, "user_id").join(area, "user_id").join(boot, "user_id").join(best, "user_id")
    share = lambda *names: [F.col(n).between(0, 1) for n in names]
    fits = F.forall(F.array(*share("power", "mean_ccei", "hit", "area", "low", "high", "level")), lambda x: x) & (F.col("low") <= F.col("high") + 1e-12) & (F.col("std_error") >= 0)
    # the same seed draws the same histories for power and area
    fits = fits & (F.abs(F.col("power") + F.col("area") - 1) < 1e-9) & (F.abs(F.col("success") - F.col("hit") + F.col("area")) < 1e-9) & (F.col("own") == F.col("ccei")) & F.col("gain").between(-1, 1)
    # observations drawn from a consistent history are consistent
    return all_.select("user_id", (F.col("hit") == 1).alias("hit"), F.when(F.col("is_garp"), (F.col("low") == 1) & (F.col("std_error") == 0)).otherwise(True).alias("drawn"), fits.alias("fits"))


def halves(rows: DataFrame) -> DataFrame:
    """Efficiency of a user's observations at even and at odd places, and whether the difference tells them apart."""
    part = lambda k: rows.select("user_id", F.filter("obs", lambda _, i: i % 2 == k).alias("obs")).filter(F.size("obs") >= 2)
    found = inference.difference(part(0), part(1))
    fits = F.col("p_value").between(0, 1) & (F.col("low") <= F.col("high") + 1e-12) & ((F.col("difference") != 0) | (F.col("p_value") == 1))
    return found.select("user_id", "level_a", "level_b", "difference", fits.alias("fits"))


def rolling(rows: DataFrame) -> DataFrame:
    return Panel(rows).windows(4).score(("garp", "ccei")).select("user_id", "is_garp", "ccei")


def correlations(rows: DataFrame) -> DataFrame:
    # no negative zeros
    return budget.quantity_correlations(rows).withColumn("correlation", F.round("correlation", 6) + 0.0)


def least_squares(rows: DataFrame) -> DataFrame:
    return budget.varian_least_squares(rows, structure.graph_edges(rows).select("user_id", "i", "j", "own", "e"))


def stone_geary(rows: DataFrame) -> DataFrame:
    return _longs(structure.stone_geary(rows), "g")


def amounts(rows: DataFrame) -> DataFrame:
    """Amounts of two characteristics in what was bought."""
    found = structure.characteristics(rows, [[1, 0], [1, 0.5], [0.5, 1], [0, 1], [1, 1], [0.2, 0.8]])
    return found.select("user_id", F.col("i").cast("long").alias("i"), F.get("amounts", F.lit(0)).alias("first"), F.get("amounts", F.lit(1)).alias("second"))


def within_groups(rows: DataFrame) -> DataFrame:
    return structure.separability(rows, [0, 1, 2], [3, 4, 5]).select("user_id", "cross_effect", F.col("within_a").alias("within"))


def audit(rows: DataFrame) -> DataFrame:
    return panel.audit(score.score_budget(rows, ("garp", "ccei", "mpi")))


# ---------------------------------------------------------------- menus, frequencies, rankings
def preferences(m: DataFrame) -> DataFrame:
    return _longs(menus.preferences(base._obs(m)), "item", "rank", "utility")


def maximality(m: DataFrame) -> DataFrame:
    return _longs(menus.maximality(base._obs(m)), "n_not_maximal")


def consideration(m: DataFrame) -> DataFrame:
    return menus.consideration(base._obs(m)).select("user_id", F.col("i").cast("long").alias("i"), _joined("considered").alias("considered"))


def attention_filter(m: DataFrame) -> DataFrame:
    return menus.with_filter(base._obs(m), lambda menu: sorted(menu)[:3])


def limited_attention(m: DataFrame) -> DataFrame:
    return menus.limited_attention(base._obs(m)).select("user_id", "is_warp_la", F.col("n_pairs").cast("long").alias("n_pairs"))


def menu_panel(m: DataFrame) -> DataFrame:
    return base.MenuPanel(base._obs(m)).summary()


def strengths_hold(m: DataFrame) -> DataFrame:
    """At strengths of largest likelihood every item wins as often as they expect."""
    wins = ranking.wins(m)
    s = ranking.bradley_terry(wins)
    games = wins.union(wins.select("loser", "winner", F.col("n") * 0)).groupBy(F.col("winner").cast("long").alias("item"), F.col("loser").cast("long").alias("other")).agg(F.sum("n").alias("won"))
    back = wins.select(F.col("loser").cast("long").alias("item"), F.col("winner").cast("long").alias("other"), F.col("n").alias("lost"))
    rows = games.join(back, ["item", "other"], "left").join(s.select("item", F.col("strength").alias("a")), "item").join(s.select(F.col("item").alias("other"), F.col("strength").alias("b")), "other")
    expected = (F.col("won") + F.coalesce("lost", F.lit(0))) * F.col("a") / (F.col("a") + F.col("b"))
    return rows.groupBy("item").agg(F.sum("won").alias("won"), F.round(F.sum(expected), 3).alias("expected"))


def logit_holds(freq: DataFrame) -> DataFrame:
    """At logit utilities of largest likelihood every item is chosen as often as they expect."""
    u = menus.logit(base._counts(freq)).select("user_id", "item", F.exp("utility").alias("w"))
    cells = freq.join(u, ["user_id", "item"])
    total = Window.partitionBy("user_id", "menu")
    rows = cells.select("user_id", "item", "n", (F.sum("n").over(total) * F.col("w") / F.sum("w").over(total)).alias("expected"))
    return rows.groupBy("user_id", F.col("item").cast("long").alias("item")).agg(F.sum("n").alias("chosen"), F.round(F.sum("expected"), 3).alias("expected"))


def kemeny_cost(m: DataFrame) -> DataFrame:
    """Disagreements with the order of fewest."""
    pairs = ranking.pairs_of(base._user_rankings(m))
    order = ranking.kemeny(pairs)
    a = order.select(F.col("item").alias("winner"), F.col("place").alias("pw"), "is_exact")
    b = order.select(F.col("item").alias("loser"), F.col("place").alias("pl"))
    return pairs.join(a, "winner").join(b, "loser").agg(F.sum(F.when(F.col("pw") > F.col("pl"), F.col("n")).otherwise(0)).alias("disagreements"), F.min("is_exact").alias("is_exact"))


def random_attention(freq: DataFrame) -> DataFrame:
    found = menus.random_attention(base._counts(freq))
    return found.select("user_id", "is_consistent", "n_orders", _joined("preference").alias("preference"), "statistic", "p_value")


def seven_item_mixtures(m: DataFrame) -> DataFrame:
    """Whether choices among seven items are a mixture of orders, with orders added one by one until the best of all lowers the deviation no more."""
    freq = stochastic.frequencies(m.withColumn("user_id", F.lit("all")))
    found = base._random_utility(freq)
    return found.select("user_id", "is_exact", (F.col("distance") >= 0).alias("fits"), (F.col("n_violations") == 0).alias("is_regular"))


def firm_scores(rows: DataFrame) -> DataFrame:
    return _longs(score.score_firms(rows), "n_violations", "max_scc")


def consensus_of_twelve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of fewest disagreements over twelve items, against the one that made the rankings."""
    order = [7, 2, 11, 4, 0, 9, 1, 10, 3, 8, 5, 6]
    found = choice.kemeny([order] * 3 + [order[::-1]] * 2)
    return spark.createDataFrame([(k, i) for k, i in enumerate(found)], "place long, item long")


QUERIES: dict[str, base.Query] = {
    "analyze_wide": base._market(analyze_wide),
    "analyze_long": base._market(analyze_long),
    "analyze_menu": base._menus(analyze_menu),
    "engine_parquet": engine_parquet,
    "engine_parquet_to_file": engine_parquet_to_file,
    "engine_arrays": engine_arrays,
    "prepared_table": prepared,
    "csv_round_trip": csv_round_trip,
    "generated_budgets": generated_budgets,
    "generated_menus": generated_menus,
    "generated_dates": generated_dates,
    "generated_firms": generated_firms,
    "generated_demo": generated_demo,
    "streamed_scores": streamed_scores,
    "streamed_sessions": streamed_sessions,
    "budget_mpi": base._market(_scored(("garp", "mpi"), "is_garp", "mpi")),
    "budget_harp": base._market(_scored(("garp", "harp"), "is_harp")),
    "budget_scores_audit": base._market(audit),
    "budget_quasilinear_any_length": base._market(structure.quasilinear),
    "budget_graph": base._market(graph_rows),
    "budget_shortest_cycles": base._market(shortest_cycles),
    "budget_betweenness": base._market(paths),
    "budget_continuous_ccei": base._market(continuous),
    "budget_afriat_numbers": base._market(afriat),
    "budget_holdout_checks": base._market(holdout_holds),
    "budget_simulation_checks": base._market(simulations_hold),
    "budget_halves": base._market(halves),
    "panel_rolling": base._market(rolling),
    "quantity_correlations": base._market(correlations),
    "budget_varian_least_squares": base._market(least_squares),
    "budget_stone_geary": base._market(stone_geary),
    "characteristic_amounts": base._market(amounts),
    "demand_bounds": base._market(lambda r: budget.demand_bounds(r, NEW_PRICES)),
    "menu_preferences": base._menus(preferences),
    "menu_maximality": base._menus(maximality),
    "menu_consideration": base._menus(consideration),
    "menu_attention_filter": base._menus(attention_filter),
    "menu_limited_attention": base._menus(limited_attention, base.FEW_ITEMS),
    "menu_panel_summary": base._menus(menu_panel),
    "bradley_terry_checks": base._menus(strengths_hold),
    "logit_checks": base._frequencies(logit_holds),
    "kemeny_cost": base._menus(kemeny_cost),
    "consensus_of_twelve": consensus_of_twelve,
    "choice_random_attention": base._frequencies(random_attention),
    "choice_perturbed_utility": base._frequencies(stochastic.perturbed_utility),
    "seven_item_mixtures": base._menus(seven_item_mixtures, 7),
    "firm_scores": lambda spark, d: base.rounded(firm_scores(market.firms(spark, d))),
    "profit_efficiency": lambda spark, d: base.rounded(production.profit_efficiency(market.firms(spark, d))),
    "firm_totals": lambda spark, d: base.rounded(production.totals(market.firms(spark, d))),
    "budget_separability_by_numbers": base._market(lambda r: structure.separability_by_numbers(r, [0, 1, 2], [3, 4, 5])),
    "euclidean_choices": lambda spark, d: base.rounded(structure.euclidean(base._obs(market.daily_menus(market.events(spark, d, base.ITEMS))), market.item_features(spark, d))),
}

_LINES = """
WITH RECURSIVE o AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS user_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS i, l_extendedprice AS a, l_quantity AS b, l_quantity AS x, CAST(l_linenumber AS DOUBLE) AS y, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem
), edges AS MATERIALIZED (
  SELECT s.user_id, s.i, t.i AS j, s.a * s.x + s.b * s.y >= s.a * t.x + s.b * t.y - 1e-10 AS r, s.a * s.x + s.b * s.y > s.a * t.x + s.b * t.y + 1e-10 AS p FROM o s JOIN o t ON s.user_id = t.user_id AND s.i <> t.i
)""" + base._closure("edges", "r") + """
, scores AS (
  SELECT u.user_id, count(e.i) AS n_violations FROM (SELECT DISTINCT user_id FROM o WHERE n >= {least}) u LEFT JOIN (SELECT e.* FROM edges e JOIN reach b ON b.user_id = e.user_id AND b.i = e.j AND b.j = e.i WHERE e.p) e USING (user_id) GROUP BY u.user_id
)
"""
#: Efficiency of any edges (user_id, i, j, own, e) with their observations (user_id, i).
_CCEI = """
, {n}_steps AS (SELECT user_id, i, j FROM {n}_edges WHERE own >= e - 1e-10), {n}_reach(user_id, i, j) AS (
  SELECT user_id, i, j FROM {n}_steps UNION SELECT a.user_id, a.i, b.j FROM {n}_reach a JOIN {n}_steps b ON b.user_id = a.user_id AND b.i = a.j
), {n}_bad AS (SELECT DISTINCT e.user_id FROM {n}_edges e JOIN {n}_reach b ON b.user_id = e.user_id AND b.i = e.j AND b.j = e.i WHERE e.own > e.e + 1e-10
), {n}_levels AS (SELECT DISTINCT user_id, e / own AS level FROM {n}_edges JOIN {n}_bad USING (user_id) WHERE own > 0 AND e > 0 AND e / own < 1
), {n}_at AS (SELECT l.user_id, l.level, x.i, x.j, l.level * x.own >= x.e - 1e-10 AS r, l.level * x.own > x.e + 1e-10 AS p FROM {n}_levels l JOIN {n}_edges x USING (user_id)
), {n}_at_steps AS (SELECT user_id, level, i, j FROM {n}_at WHERE r), {n}_at_reach(user_id, level, i, j) AS (
  SELECT user_id, level, i, j FROM {n}_at_steps UNION SELECT a.user_id, a.level, a.i, b.j FROM {n}_at_reach a JOIN {n}_at_steps b ON b.user_id = a.user_id AND b.level = a.level AND b.i = a.j
), {n}_broken AS (SELECT DISTINCT x.user_id, x.level FROM {n}_at x JOIN {n}_at_reach b ON b.user_id = x.user_id AND b.level = x.level AND b.i = x.j AND b.j = x.i WHERE x.p
), {n}_ccei AS (
  SELECT u.user_id, b.user_id IS NULL AS is_garp, CASE WHEN b.user_id IS NULL THEN 1.0 ELSE coalesce(l.level, 0.0) END AS ccei
  FROM {n}_users u LEFT JOIN {n}_bad b USING (user_id) LEFT JOIN (SELECT user_id, max(level) AS level FROM {n}_levels ANTI JOIN {n}_broken USING (user_id, level) GROUP BY user_id) l USING (user_id)
)"""
#: Walks of each number of steps, with their largest weight.
_WALKS = """
, walks AS (
  SELECT user_id, 0 AS k, i AS v, CAST(0 AS DOUBLE) AS w FROM obs
  UNION ALL
  SELECT d.user_id, d.k + 1, e.j, max(d.w + (e.own - e.e) / e.own) FROM walks d JOIN edges e ON e.user_id = d.user_id AND e.i = d.v AND e.r AND e.own > 0 JOIN sizes s ON s.user_id = d.user_id WHERE d.k < s.n GROUP BY d.user_id, d.k + 1, e.j
), means AS (
  SELECT l.user_id, l.v, min((l.w - d.w) / (s.n - d.k)) AS m FROM walks l JOIN sizes s ON s.user_id = l.user_id AND l.k = s.n JOIN walks d ON d.user_id = l.user_id AND d.v = l.v AND d.k < s.n GROUP BY l.user_id, l.v
), pump AS (
  SELECT g.user_id, g.is_garp, CASE WHEN g.is_garp THEN 0.0 ELSE greatest(0.0, coalesce(max(m), 0.0)) END AS mpi FROM garp g LEFT JOIN means USING (user_id) GROUP BY g.user_id, g.is_garp
)
"""


def _best_walks(weight: str, where: str, better: str) -> str:
    """The best weight of walks from s to v of up to as many steps as there are observations."""
    return f""", ways AS (
  SELECT user_id, i AS s, j AS v, 1 AS k, {weight} AS w FROM edges WHERE {where}
  UNION ALL
  SELECT d.user_id, d.s, e.j, d.k + 1, {better} FROM ways d JOIN edges e ON e.user_id = d.user_id AND e.i = d.v AND {where} JOIN sizes z ON z.user_id = d.user_id WHERE d.k < z.n GROUP BY d.user_id, d.s, e.j, d.k + 1
)"""


_REACH = base._closure("edges", "r")
_MENU_ORDER = """
, above AS (SELECT x.user_id, x.item, coalesce(list(e.i) FILTER (e.i IS NOT NULL), []) AS above FROM items x LEFT JOIN edges e ON e.user_id = x.user_id AND e.j = x.item GROUP BY x.user_id, x.item
), placed AS (
  SELECT user_id, 0 AS k, CAST([] AS INTEGER[]) AS done FROM users
  UNION ALL
  SELECT o.user_id, o.k + 1, list_append(any_value(o.done), min(x.item)) FROM placed o JOIN above x ON x.user_id = o.user_id WHERE NOT list_contains(o.done, x.item) AND list_has_all(o.done, x.above) GROUP BY o.user_id, o.k
), orders AS (
  SELECT p.user_id, p.done FROM placed p JOIN (SELECT user_id, count(*) AS n FROM items GROUP BY user_id) c ON c.user_id = p.user_id AND p.k = c.n
)"""

ORACLE_SQL: dict[str, str] = {
    "analyze_wide": base.ORACLE_SQL["budget_ccei"].replace("SELECT g.user_id, g.is_garp, round", "SELECT g.user_id, g.is_garp, g.n_violations, round"),
    "analyze_long": base.ORACLE_SQL["budget_garp"],
    "analyze_menu": base.ORACLE_SQL["menu_scores"].split("SELECT s.user_id, sarp.n")[0] + """
SELECT s.user_id, sarp.n IS NULL AS is_sarp, warp.n IS NULL AS is_warp, la.n IS NULL AS is_warp_la, coalesce(sarp.n, 0) AS n_sarp_violations, coalesce(warp.n, 0) AS n_warp_violations
FROM scc s LEFT JOIN sarp USING (user_id) LEFT JOIN warp USING (user_id) LEFT JOIN la USING (user_id)""",
    "engine_parquet": _LINES.replace("{least}", "2") + "SELECT user_id, n_violations = 0 AS is_garp, n_violations FROM scores",
    "engine_parquet_to_file": _LINES.replace("{least}", "2") + "SELECT n_violations = 0 AS is_garp, count(*) AS n_users, CAST(sum(n_violations) AS BIGINT) AS n_violations FROM scores GROUP BY n_violations = 0",
    "engine_arrays": "SELECT * FROM (VALUES ('budget 0', TRUE), ('budget 1', FALSE), ('menu 0', FALSE)) t(user_id, is_consistent)",
    "prepared_table": "SELECT count(*) AS n_rows, count(DISTINCT l_suppkey) AS n_users, TRUE AS in_order FROM lineitem",
    "csv_round_trip": "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderpriority",
    "generated_budgets": f"SELECT form, CAST(range AS VARCHAR) AS user_id, CAST(12 AS BIGINT) AS n_obs, TRUE AS is_garp, TRUE AS within FROM range({GENERATED}), (VALUES ('cobb_douglas'), ('ces'), ('leontief')) f(form)",
    "generated_menus": f"SELECT CAST(range AS VARCHAR) AS user_id, TRUE AS is_sarp, CAST(9 AS BIGINT) AS n_obs, TRUE AS fits FROM range({GENERATED})",
    "generated_dates": f"SELECT CAST(range AS VARCHAR) AS user_id, CAST(8 AS BIGINT) AS n_choices, TRUE AS is_consistent FROM range({GENERATED})",
    "generated_firms": f"SELECT CAST(range AS VARCHAR) AS user_id, CAST(7 AS BIGINT) AS n_obs, TRUE AS fits FROM range({GENERATED})",
    "generated_demo": "SELECT * FROM (VALUES ('consistent', CAST(40 AS BIGINT), TRUE), ('noisy', CAST(40 AS BIGINT), TRUE), ('random', CAST(20 AS BIGINT), TRUE)) t(kind, n, as_made)",
    "streamed_scores": _LINES.replace("{least}", "1") + "SELECT user_id, n_violations = 0 AS is_garp, n_violations FROM scores",
    "streamed_sessions": """
WITH marked AS (SELECT CAST(user_id AS VARCHAR) AS user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 1800000000, FALSE) AS late FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT user_id, sum(CAST(late AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked)
SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM numbered GROUP BY user_id, s) GROUP BY user_id""",
    "budget_mpi": _GARP + _WALKS + "SELECT user_id, is_garp, round(mpi, 6) AS mpi FROM pump",
    "budget_scores_audit": _GARP + _WALKS + base.ORACLE_SQL["budget_ccei"].split(_GARP)[1].rsplit("SELECT g.user_id", 1)[0] + """
SELECT g.user_id, g.is_garp, round(CASE WHEN g.is_garp THEN 1.0 ELSE coalesce(b.level, 0.0) END, 6) AS integrity, round(mpi, 6) AS confusion,
  CASE WHEN g.is_garp THEN 'consistent' WHEN coalesce(b.level, 0.0) >= 0.9 THEN 'nearly consistent' ELSE 'inconsistent' END AS verdict
FROM garp g JOIN pump p USING (user_id) LEFT JOIN best b USING (user_id)""",
    "budget_harp": _B + _best_walks("ln(own) - ln(e)", "r AND own > 1e-10 AND e > 1e-10", "max(d.w + ln(e.own) - ln(e.e))") + """
SELECT s.user_id, count(w.w) FILTER (w.s = w.v AND w.w > 1e-9) = 0 AS is_harp FROM sizes s LEFT JOIN ways w USING (user_id) GROUP BY s.user_id""",
    "budget_quasilinear_any_length": _B + _best_walks("e - own", "TRUE", "min(d.w + e.e - e.own)") + """
, most AS (SELECT user_id, max(e) AS own FROM cost WHERE i = j GROUP BY user_id)
SELECT m.user_id, count(w.w) FILTER (w.s = w.v AND w.w < -1e-10 * greatest(1.0, m.own)) = 0 AS is_quasilinear FROM most m LEFT JOIN ways w USING (user_id) GROUP BY m.user_id""",
    "budget_graph": _GARP + """
SELECT e.user_id, e.i, e.j, e.own, e.e, e.r, e.p, round(ln(e.own) - ln(e.e), 6) AS weight, l.label AS component FROM edges e JOIN reach b USING (user_id, i, j) JOIN labels l USING (user_id, i)""",
    "budget_shortest_cycles": _GARP + """
, ways AS (
  SELECT user_id, i AS s, j AS v, 1 AS k FROM edges WHERE r
  UNION ALL
  SELECT DISTINCT d.user_id, d.s, e.j, d.k + 1 FROM ways d JOIN edges e ON e.user_id = d.user_id AND e.i = d.v AND e.r JOIN sizes z ON z.user_id = d.user_id WHERE d.k < z.n
)
SELECT s.user_id, CAST(coalesce(min(w.k) + 1, 0) AS BIGINT) AS shortest FROM sizes s LEFT JOIN (SELECT d.* FROM ways d JOIN edges e ON e.user_id = d.user_id AND e.i = d.v AND e.j = d.s AND e.p) w USING (user_id) GROUP BY s.user_id""",
    "budget_betweenness": _B + """
, ways AS (
  SELECT user_id, i AS s, j AS v, 1 AS k, CAST(1 AS DOUBLE) AS c FROM edges WHERE r
  UNION ALL
  SELECT d.user_id, d.s, e.j, d.k + 1, sum(d.c) FROM ways d JOIN edges e ON e.user_id = d.user_id AND e.i = d.v AND e.r AND e.j <> d.s JOIN sizes z ON z.user_id = d.user_id WHERE d.k < z.n - 1 GROUP BY d.user_id, d.s, e.j, d.k + 1
), near AS (SELECT user_id, s, v, min(k) AS k, arg_min(c, k) AS c FROM ways GROUP BY user_id, s, v
), through AS (
  SELECT a.user_id, a.v AS i, sum(a.c * b.c / t.c) AS x FROM near a JOIN near b ON b.user_id = a.user_id AND b.s = a.v JOIN near t ON t.user_id = a.user_id AND t.s = a.s AND t.v = b.v AND t.k = a.k + b.k WHERE b.v <> a.s GROUP BY a.user_id, a.v
)
SELECT o.user_id, o.i, (SELECT count(*) FROM edges e WHERE e.user_id = o.user_id AND e.i = o.i AND e.r) AS out_degree, (SELECT count(*) FROM edges e WHERE e.user_id = o.user_id AND e.j = o.i AND e.r) AS in_degree,
  round(coalesce(t.x, 0.0) / greatest(1, (z.n - 1) * (z.n - 2)), 6) AS betweenness
FROM obs o JOIN sizes z USING (user_id) LEFT JOIN through t ON t.user_id = o.user_id AND t.i = o.i""",
    "budget_continuous_ccei": _B + _best_walks("e / own", "own > 0", "min(greatest(d.w, e.e / e.own))") + """
SELECT s.user_id, round(least(1.0, coalesce(min(w.w) FILTER (w.s = w.v), 1.0)), 6) AS continuous_ccei FROM sizes s LEFT JOIN ways w USING (user_id) GROUP BY s.user_id""",
    "budget_afriat_numbers": _GARP + "SELECT user_id, CASE WHEN is_garp THEN n ELSE 0 END AS n_numbers, CAST(0 AS BIGINT) AS n_broken FROM garp JOIN sizes USING (user_id)",
    "budget_holdout_checks": _B + "SELECT user_id, TRUE AS hits, TRUE AS fits FROM sizes",
    "budget_simulation_checks": _GARP + "SELECT user_id, is_garp AS hit, TRUE AS drawn, TRUE AS fits FROM garp",
    "budget_halves": _B + """
, a_edges AS (SELECT * FROM edges WHERE i % 2 = 0 AND j % 2 = 0), a_users AS (SELECT user_id FROM obs WHERE i % 2 = 0 GROUP BY user_id HAVING count(*) >= 2),
b_edges AS (SELECT * FROM edges WHERE i % 2 = 1 AND j % 2 = 1), b_users AS (SELECT user_id FROM obs WHERE i % 2 = 1 GROUP BY user_id HAVING count(*) >= 2)""" + _CCEI.replace("{n}", "a") + _CCEI.replace("{n}", "b") + """
SELECT user_id, round(a.ccei, 6) AS level_a, round(b.ccei, 6) AS level_b, round(a.ccei - b.ccei, 6) + 0.0 AS difference, TRUE AS fits FROM a_ccei a JOIN b_ccei b USING (user_id)""",
    "panel_rolling": _B + """
, w_edges AS (SELECT user_id || '__' || (i // 4) AS user_id, i, j, own, e FROM edges WHERE i // 4 = j // 4),
w_users AS (SELECT user_id || '__' || (i // 4) AS user_id FROM obs GROUP BY ALL HAVING count(*) >= 2)""" + _CCEI.replace("{n}", "w") + "SELECT user_id, is_garp, round(ccei, 6) AS ccei FROM w_ccei",
    "quantity_correlations": _B + base._GOODS + """
SELECT a.user_id, a.g, b.g AS h, round(CASE WHEN stddev_pop(a.quantity) > 1e-9 AND stddev_pop(b.quantity) > 1e-9 THEN covar_pop(a.quantity, b.quantity) / (stddev_pop(a.quantity) * stddev_pop(b.quantity)) END, 6) + 0.0 AS correlation
FROM goods a JOIN goods b ON b.user_id = a.user_id AND b.i = a.i AND a.g < b.g GROUP BY a.user_id, a.g, b.g""",
    "budget_varian_least_squares": _GARP + """
, worst AS (SELECT e.user_id, max(e.e / e.own) AS h FROM edges e JOIN reach b USING (user_id, i, j) GROUP BY e.user_id)
SELECT s.user_id, coalesce(h, 0) <= 1 + 1e-10 AS success, CASE WHEN coalesce(h, 0) <= 1 + 1e-10 THEN 1.0 END AS mean_level, CASE WHEN coalesce(h, 0) <= 1 + 1e-10 THEN 1.0 END AS min_level FROM sizes s LEFT JOIN worst USING (user_id)""",
    "budget_stone_geary": _B + base._GOODS + """
, least_ AS (SELECT user_id, g, 0.9 * min(quantity) AS s, avg(price) AS mp FROM goods GROUP BY user_id, g),
over_ AS (SELECT x.user_id, x.i, x.g, (x.quantity - l.s) * x.price AS v FROM goods x JOIN least_ l USING (user_id, g)),
rest AS (SELECT user_id, i, greatest(sum(v), 1e-12) AS rest, sum(v) AS raw FROM over_ GROUP BY user_id, i),
share AS (SELECT o.user_id, o.g, avg(o.v / r.rest) AS b FROM over_ o JOIN rest r USING (user_id, i) GROUP BY o.user_id, o.g),
total AS (SELECT user_id, sum(b) AS b FROM share GROUP BY user_id), above AS (SELECT user_id, greatest(avg(raw), 1e-12) AS m FROM rest GROUP BY user_id)
SELECT l.user_id, l.g, round(l.s, 6) AS subsistence, round(s.b / t.b, 6) AS share, round(a.m * (power(s.b / t.b, 2) - s.b / t.b) / (l.mp * l.mp), 6) + 0.0 AS own_effect
FROM least_ l JOIN share s USING (user_id, g) JOIN total t USING (user_id) JOIN above a USING (user_id)""",
    "characteristic_amounts": _B + base._GOODS + """
, w(g, a, b) AS (VALUES (0, 1.0, 0.0), (1, 1.0, 0.5), (2, 0.5, 1.0), (3, 0.0, 1.0), (4, 1.0, 1.0), (5, 0.2, 0.8))
SELECT user_id, i, round(sum(quantity * CAST(a AS DOUBLE)), 6) AS first, round(sum(quantity * CAST(b AS DOUBLE)), 6) AS second FROM goods JOIN w USING (g) GROUP BY user_id, i""",
    "demand_bounds": _B + base._GOODS + f"""
, c AS (SELECT user_id, g, price, quantity, CAST({NEW_PRICES}[g + 1] AS DOUBLE) AS new FROM goods),
b AS (SELECT user_id, g, greatest(0.0, coalesce(max(quantity * 0.8) FILTER (new < price), 0.0)) AS low, min(greatest(0.0, quantity * (price / new) * 1.5)) FILTER (new > price) AS high FROM c GROUP BY user_id, g)
SELECT user_id, g, round(CASE WHEN low > high THEN 0.0 ELSE low END, 6) AS low, round(CASE WHEN low > high THEN NULL ELSE high END, 6) AS high, high IS NOT NULL AND NOT coalesce(low > high, FALSE) AS is_bounded FROM b""",
    "menu_preferences": _M + base._MENU_REACH + _MENU_ORDER + """
SELECT user_id, CAST(done[k] AS BIGINT) AS item, k - 1 AS rank, len(done) - k + 1 AS utility FROM (SELECT user_id, done, unnest(range(1, len(done) + 1)) AS k FROM orders)""",
    "menu_maximality": _M + base._MENU_REACH + """
, worse AS (SELECT DISTINCT s.user_id, s.t FROM shown s JOIN reach a ON a.user_id = s.user_id AND a.i = s.item AND a.j = s.choice WHERE s.item <> s.choice AND NOT EXISTS (SELECT 1 FROM reach b WHERE b.user_id = s.user_id AND b.i = s.choice AND b.j = s.item))
SELECT u.user_id, count(w.t) AS n_not_maximal FROM users u LEFT JOIN worse w USING (user_id) GROUP BY u.user_id""",
    "menu_consideration": _M + base._MENU_REACH + """
, cyclic AS (SELECT DISTINCT user_id FROM reach WHERE i = j), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS k FROM menus)
SELECT n.user_id, n.k AS i, array_to_string(list_sort(list(s.item) FILTER (c.user_id IS NULL OR s.item = n.choice OR e.i IS NULL)), ',') AS considered
FROM n JOIN shown s ON s.user_id = n.user_id AND s.t = n.t LEFT JOIN cyclic c ON c.user_id = n.user_id LEFT JOIN edges e ON e.user_id = n.user_id AND e.i = s.item AND e.j = n.choice GROUP BY n.user_id, n.k""",
    "menu_attention_filter": _M + """
, kept AS (SELECT user_id, choice, list_slice(menu, 1, 3) AS seen FROM menus), outside AS (SELECT DISTINCT user_id FROM kept WHERE NOT list_contains(seen, choice)),
few AS (SELECT DISTINCT user_id, choice AS i, item AS j FROM (SELECT user_id, choice, unnest(seen) AS item FROM kept) WHERE item <> choice)""" + base._closure("few", "TRUE") + """
SELECT user_id, user_id NOT IN (SELECT user_id FROM outside) AND user_id NOT IN (SELECT user_id FROM reach WHERE i = j) AS is_explained FROM (SELECT DISTINCT user_id FROM menus)""",
    "menu_limited_attention": "WITH RECURSIVE " + MENU_SQL.format(items=base.FEW_ITEMS) + """
, single AS (SELECT user_id, menu, arg_max(choice, t) AS choice FROM menus GROUP BY user_id, menu),
above AS (SELECT DISTINCT a.user_id, a.choice AS i, a.y AS j FROM (SELECT user_id, menu, choice, unnest(menu) AS y FROM single) a JOIN single b ON a.user_id = b.user_id AND list_filter(a.menu, lambda z: z <> a.y) = b.menu WHERE a.y <> a.choice AND b.choice <> a.choice)""" + base._closure("above", "TRUE") + """
SELECT u.user_id, u.user_id NOT IN (SELECT user_id FROM reach WHERE i = j) AS is_warp_la, (SELECT count(*) FROM above a WHERE a.user_id = u.user_id) AS n_pairs FROM (SELECT DISTINCT user_id FROM menus) u""",
    "menu_panel_summary": "SELECT count(*) AS n_users, round(avg(CAST(is_sarp AS INTEGER)), 6) AS share_sarp, round(avg(CAST(is_warp AS INTEGER)), 6) AS share_warp, round(avg(CAST(is_warp_la AS INTEGER)), 6) AS share_warp_la, round(avg(hm_consistent / hm_total), 6) AS mean_hm FROM (" + base.ORACLE_SQL["menu_scores"] + ")",
    "bradley_terry_checks": _M + "SELECT CAST(item AS BIGINT) AS item, CAST(sum(won) AS BIGINT) AS won, round(CAST(sum(won) AS DOUBLE), 3) AS expected FROM (SELECT choice AS item, count(*) AS won FROM shown WHERE item <> choice GROUP BY choice UNION ALL SELECT item, 0 FROM shown) GROUP BY item",
    "logit_checks": _F + "SELECT user_id, CAST(item AS BIGINT) AS item, CAST(sum(n) AS BIGINT) AS chosen, round(CAST(sum(n) AS DOUBLE), 3) AS expected FROM freq GROUP BY user_id, item",
    "kemeny_cost": _M + """
, c AS (SELECT user_id, choice, count(*) AS c FROM menus GROUP BY user_id, choice), r AS (SELECT user_id, choice, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, choice) AS k FROM c),
pairs AS (SELECT a.choice AS w, b.choice AS l, count(*) AS n FROM r a JOIN r b ON a.user_id = b.user_id AND a.k < b.k GROUP BY a.choice, b.choice),
things AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS b FROM (SELECT w AS item FROM pairs UNION SELECT l FROM pairs)),
wins AS (SELECT x.b AS a, y.b AS b, n FROM pairs JOIN things x ON x.item = w JOIN things y ON y.item = l),
behind AS (SELECT m.range AS mask, k.b AS k, coalesce(sum(n) FILTER ((m.range >> w.b) & 1 = 1), 0) AS loss FROM range(1024) m CROSS JOIN things k LEFT JOIN wins w ON w.a = k.b WHERE (m.range >> k.b) & 1 = 0 GROUP BY m.range, k.b),
best AS (
  SELECT CAST(0 AS BIGINT) AS mask, CAST(0 AS HUGEINT) AS loss, 0 AS k
  UNION ALL
  SELECT d.mask | (CAST(1 AS BIGINT) << CAST(x.k AS INTEGER)), min(d.loss + x.loss), d.k + 1 FROM best d JOIN behind x ON x.mask = d.mask GROUP BY d.mask | (CAST(1 AS BIGINT) << CAST(x.k AS INTEGER)), d.k + 1
)
SELECT CAST(min(loss) AS BIGINT) AS disagreements, TRUE AS is_exact FROM best WHERE k = (SELECT count(*) FROM things)""",
    "consensus_of_twelve": "SELECT CAST(p AS BIGINT) AS place, CAST(i AS BIGINT) AS item FROM (VALUES (0, 7), (1, 2), (2, 11), (3, 4), (4, 0), (5, 9), (6, 1), (7, 10), (8, 3), (9, 8), (10, 5), (11, 6)) t(p, i)",
    "choice_random_attention": _F + """
, things AS (SELECT DISTINCT item FROM freq), seqs AS (
  SELECT [item] AS o FROM things UNION ALL SELECT list_append(s.o, t.item) FROM seqs s JOIN things t ON NOT list_contains(s.o, t.item)
), full_ AS (SELECT o FROM seqs WHERE len(o) = (SELECT count(*) FROM things)),
need AS (SELECT DISTINCT a.item AS x, b.item AS y FROM freq a JOIN freq b ON a.menu = b.menu AND a.n > 0 AND b.n = 0),
fits AS (SELECT o FROM full_ WHERE NOT EXISTS (SELECT 1 FROM need WHERE list_position(o, x) > list_position(o, y))),
ranked AS (SELECT f.o, q.menu, q.p, row_number() OVER (PARTITION BY f.o, q.menu ORDER BY list_position(f.o, q.item)) AS k FROM full_ f, freq q),
gaps AS (SELECT a.o, avg(power(greatest(0.0, b.p - a.p), 2)) AS d FROM ranked a JOIN ranked b ON a.o = b.o AND a.menu = b.menu AND b.k = a.k + 1 GROUP BY a.o),
own AS (SELECT o, d FROM gaps WHERE o = (SELECT min(o) FROM fits)),
p AS (SELECT avg(CAST(g.d >= own.d - 1e-12 AS INTEGER)) AS p FROM gaps g, own)
SELECT 'all' AS user_id, coalesce(own.d < 1e-6 OR p > 0.05, FALSE) AS is_consistent, (SELECT count(*) FROM fits) AS n_orders, coalesce(array_to_string(own.o, ','), '') AS preference, round(coalesce(own.d, 1.0), 6) AS statistic, round(coalesce(p, 0.0), 6) AS p_value
FROM (SELECT 1) one LEFT JOIN own ON TRUE LEFT JOIN p ON TRUE""",
    "choice_perturbed_utility": _F + base._PAIRS + """
, over_ AS (SELECT a.user_id, b.p - a.p AS over FROM freq a JOIN freq b ON a.item = b.item AND len(a.menu) < len(b.menu) AND list_has_all(b.menu, a.menu)),
r AS (SELECT user_id, count(*) FILTER (over > 0.01) AS n, max(greatest(0, over)) AS worst FROM over_ GROUP BY user_id),
i AS (SELECT user_id, count(*) FILTER (n_menus > 1 AND cv > 0.1) = 0 AS is_iia FROM odds GROUP BY user_id)
SELECT user_id, coalesce(n, 0) = 0 AS is_apu, coalesce(n, 0) AS n_irregular, round(coalesce(worst, 0.0), 6) AS worst, is_iia, coalesce(n, 0) = 0 AND is_iia AS is_logit FROM i LEFT JOIN r USING (user_id)""",
    "seven_item_mixtures": "WITH RECURSIVE " + MENU_SQL.format(items=7) + """
, counts AS (SELECT menu, choice, count(*) AS c FROM menus GROUP BY menu, choice), totals AS (SELECT menu, count(*) AS total FROM menus GROUP BY menu),
freq AS (SELECT t.menu, t.item, coalesce(k.c, 0) / t.total AS p FROM (SELECT menu, total, unnest(menu) AS item FROM totals) t LEFT JOIN counts k ON k.menu = t.menu AND k.choice = t.item)
SELECT 'all' AS user_id, TRUE AS is_exact, TRUE AS fits, (SELECT count(*) FROM freq a JOIN freq b ON a.item = b.item AND len(a.menu) < len(b.menu) AND list_has_all(b.menu, a.menu) AND b.p > a.p + 1e-10) = 0 AS is_regular""",
    "firm_scores": base._FIRMS.replace("WITH firms", "WITH RECURSIVE firms") + """
, numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS i FROM firms),
f_edges AS MATERIALIZED (SELECT a.user_id, a.i, b.i AS j, a.o0 + 0.5 * a.o1 - (a.p0 * a.q0 + a.p1 * a.q1) AS own, b.o0 + 0.5 * b.o1 - (a.p0 * b.q0 + a.p1 * b.q1) AS e FROM numbered a JOIN numbered b ON a.user_id = b.user_id AND a.i <> b.i),
f_users AS (SELECT DISTINCT user_id FROM firms)""" + _CCEI.replace("{n}", "f").replace("f_levels AS (SELECT DISTINCT user_id, e / own AS level FROM f_edges JOIN f_bad USING (user_id) WHERE own > 0 AND e > 0 AND e / own < 1", "f_levels AS (SELECT DISTINCT user_id, e / own AS level FROM f_edges JOIN f_bad USING (user_id) WHERE own <> 0 AND e / own > 0 AND e / own < 1") + """
, f_pairs AS (SELECT e.user_id, count(*) AS n FROM f_edges e JOIN f_reach b ON b.user_id = e.user_id AND b.i = e.j AND b.j = e.i WHERE e.own > e.e + 1e-10 GROUP BY e.user_id),
f_labels AS (SELECT o.user_id, o.i, least(o.i, coalesce(min(a.j), o.i)) AS label FROM numbered o LEFT JOIN f_reach a ON a.user_id = o.user_id AND a.i = o.i AND EXISTS (SELECT 1 FROM f_reach b WHERE b.user_id = a.user_id AND b.i = a.j AND b.j = a.i) GROUP BY o.user_id, o.i),
f_scc AS (SELECT user_id, max(n) AS m FROM (SELECT user_id, label, count(*) AS n FROM f_labels GROUP BY user_id, label) GROUP BY user_id)
SELECT c.user_id, c.is_garp, coalesce(p.n, 0) AS n_violations, round(c.ccei, 6) AS ccei, s.m AS max_scc FROM f_ccei c LEFT JOIN f_pairs p USING (user_id) JOIN f_scc s USING (user_id)""",
    "profit_efficiency": base._FIRMS + """
SELECT user_id, count(*) AS n_obs, round(max(o0 + 0.5 * o1 - (p0 * q0 + p1 * q1)), 6) AS largest_profit,
  round(CASE WHEN max(o0 + 0.5 * o1 - (p0 * q0 + p1 * q1)) <= 0 THEN 1.0 ELSE greatest(0.0, least(1.0, avg(o0 + 0.5 * o1 - (p0 * q0 + p1 * q1)) / max(o0 + 0.5 * o1 - (p0 * q0 + p1 * q1)))) END, 6) AS efficiency FROM firms GROUP BY user_id""",
    "firm_totals": base._FIRMS + """
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS i, round(p0 * q0 + p1 * q1, 6) AS cost, round(o0 + 0.5 * o1, 6) AS revenue, round(o0 + 0.5 * o1 - (p0 * q0 + p1 * q1), 6) AS profit FROM firms""",
}
