"""The queries of the library and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.operators import budget, dated, features, lotteries, menu, panel, production, ranking, stochastic
from concordia.panel import Auditor, Encoder, MenuPanel, Panel
from concordia.plans import inference, menus, score, structure
from concordia.schema import METRICS
from concordia.sources import clicklogs, market
from concordia.sources.market import BUDGET_SQL, MENU_SQL

Query = Callable[[SparkSession, str], DataFrame]
#: Items of menus, and of menus that repeat often enough for frequencies.
ITEMS, FEW_ITEMS = 10, 4


def rounded(df: DataFrame) -> DataFrame:
    """Numbers to six decimals, for comparison."""
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _market(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(operator(market.market(spark, sf_dir)))


def _menus(operator: Callable[[DataFrame], DataFrame], items: int = ITEMS) -> Query:
    return lambda spark, sf_dir: rounded(operator(market.daily_menus(market.events(spark, sf_dir, items))))


def _frequencies(operator: Callable[[DataFrame], DataFrame]) -> Query:
    """Choices of all users as those of one decision maker, whose menus repeat."""
    return _menus(lambda m: operator(stochastic.frequencies(m.withColumn("user_id", F.lit("all")))), FEW_ITEMS)


def _events(operator: Callable[[DataFrame], DataFrame], items: int = ITEMS) -> Query:
    return lambda spark, sf_dir: rounded(operator(market.events(spark, sf_dir, items)))


def garp(rows: DataFrame) -> DataFrame:
    return score.score_budget(rows, ("garp",)).select("user_id", "is_garp", *[F.col(c).cast("long").alias(c) for c in ("n_violations", "max_scc", "n_scc")])


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: N802
    return garp(market.market(spark, sf_dir))


def _all_metrics(rows: DataFrame) -> DataFrame:
    return score.score_budget(rows, METRICS).drop("compute_time_us")


def _variants(rows: DataFrame) -> DataFrame:
    return score.score_variants(rows).select("user_id", *[F.col(c).cast("long").alias(c) for c in ("n_sarp", "n_acyclical_p", "n_gapp")])


def _obs(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("t", "menu", "choice"))).alias("obs"))


def _menu_scores(rows: DataFrame) -> DataFrame:
    out = score.score_menu(_obs(rows))
    whole = ("n_sarp_violations", "n_warp_violations", "hm_consistent", "hm_total", "max_scc", "n_scc")
    return out.select("user_id", "is_sarp", "is_warp", "is_warp_la", *[F.col(c).cast("long").alias(c) for c in whole], "r_density", "pref_entropy", "choice_diversity")


def _random_utility(freq: DataFrame) -> DataFrame:
    counts = freq.groupBy("user_id", "menu").agg(F.map_from_entries(F.collect_list(F.struct("item", "n"))).alias("c"))
    rows = counts.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("menu", F.transform("menu", lambda i: F.element_at("c", i)).alias("counts")))).alias("obs"))
    return score.score_stochastic(rows).drop("compute_time_us")


def _vei(rows: DataFrame) -> DataFrame:
    return budget.varian(rows, garp(rows))


def _menu_list(menus: DataFrame) -> DataFrame:
    return menus.select("user_id", "t", F.concat_ws(",", F.transform("menu", lambda i: i.cast("string"))).alias("menu"), F.col("choice").cast("long").alias("choice"))


def _rank_pairs(menus: DataFrame) -> DataFrame:
    """Items of each month's choices ranked by how often they are shown, and by how often chosen."""
    s = menu.shown(menus.withColumn("user_id", F.substring("t", 1, 10)))
    by = s.groupBy(F.col("user_id").alias("pair_id"), "item").agg(F.count(F.lit(1)).alias("shown"), F.sum((F.col("item") == F.col("choice")).cast("long")).alias("chosen"))
    from pyspark.sql import Window

    place = lambda c: F.row_number().over(Window.partitionBy("pair_id").orderBy(F.col(c).desc(), "item")) - 1
    return ranking.compare(by.select("pair_id", "item", place("shown").alias("a"), place("chosen").alias("b")))


QUERIES: dict[str, Query] = {
    "price_grid": lambda spark, d: market.price_grid(market.purchases(spark, d)),
    "budget_edges": _market(budget.edges),
    "budget_garp": _market(garp),
    "budget_variants": _market(_variants),
    "budget_warp": _market(budget.warp),
    "budget_vei": _market(_vei),
    "budget_network": _market(budget.network),
    "budget_weights": _market(budget.weights),
    "budget_savings": _market(budget.savings),
    "budget_quasilinear": _market(score.score_quasilinear),
    "budget_all_metrics": _market(_all_metrics),
    "spending_features": _market(budget.features),
    "law_of_demand": _market(budget.law_of_demand),
    "additivity": _market(budget.additivity),
    "welfare_bounds": _market(budget.welfare),
    "cannibalization": _market(lambda r: budget.cannibalization(r, [0, 1, 2], [3, 4, 5])),
    "panel_summary": _market(lambda r: panel.summary(garp(r))),
    "panel_most_inconsistent": _market(lambda r: panel.most_inconsistent(garp(r), 5)),
    "panel_periods": _market(panel.periods),
    "panel_windows": _market(panel.windows),
    "event_sessions": _events(lambda e: market.sessions(e).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("item").alias("n_items"))),
    "session_menus": _events(lambda e: _menu_list(market.session_menus(e, gap_minutes=600)).withColumn("t", F.col("t").cast("string"))),
    "windowed_menus": _events(lambda e: _menu_list(market.windowed_menus(e, hours=48)).withColumn("t", F.col("t").cast("string"))),
    "daily_menus": _menus(_menu_list),
    "menu_edges": _menus(lambda m: menu.edges(m).select("user_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))),
    "menu_warp": _menus(menu.warp),
    "menu_warp_limited_attention": _menus(menu.warp_limited_attention),
    "menu_scores": _menus(_menu_scores),
    "menu_network": _menus(menu.network),
    "menu_salience": _menus(lambda m: menu.salience(m).withColumn("item", F.col("item").cast("long"))),
    "menu_overload": _menus(menu.overload),
    "menu_overload_slope": _menus(menu.overload_slope),
    "menu_status_quo": _menus(menu.status_quo),
    "menu_attention_relation": _menus(lambda m: menu.attention_relation(m).select("user_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")), FEW_ITEMS),
    "choice_regularity": _frequencies(stochastic.regularity),
    "choice_odds": _frequencies(lambda f: stochastic.odds(f).withColumns({"x": F.col("x").cast("long"), "y": F.col("y").cast("long")})),
    "choice_independence": _frequencies(stochastic.independence),
    "choice_transitivity": _frequencies(stochastic.transitivity),
    "choice_luce": _frequencies(lambda f: stochastic.luce(f).withColumn("item", F.col("item").cast("long"))),
    "choice_decoys": _frequencies(lambda f: stochastic.decoys(f).withColumns({"target": F.col("target").cast("long"), "decoy": F.col("decoy").cast("long")})),
    "choice_random_utility": _frequencies(_random_utility),
    "pairwise_wins": _menus(lambda m: ranking.wins(m).withColumns({"winner": F.col("winner").cast("long"), "loser": F.col("loser").cast("long")})),
    "bradley_terry": _menus(lambda m: ranking.bradley_terry(ranking.wins(m))),
    "borda_count": _menus(lambda m: ranking.borda(m).withColumn("item", F.col("item").cast("long"))),
    "rank_agreement": _menus(_rank_pairs),
}

QUERIES |= {
    "budget_scores_audit": _market(lambda r: panel.audit(score.score_budget(r, ("garp", "ccei", "mpi")))),
    "budget_power": _market(inference.power),
    "budget_selten": _market(inference.selten),
    "budget_optimal_efficiency": _market(inference.optimal_efficiency),
    "budget_bootstrap": _market(inference.bootstrap),
    "budget_holdout": _market(inference.holdout),
    "budget_graph": _market(structure.graph_edges),
    "budget_cycles": _market(structure.cycles),
    "budget_indices": _market(structure.indices),
    "budget_contributions": _market(structure.contributions),
    "budget_centrality": _market(structure.centrality),
    "budget_utilities": _market(structure.utilities),
    "budget_slutsky": _market(structure.slutsky),
    "budget_integrability": _market(structure.integrability),
    "budget_separability": _market(lambda r: structure.separability(r, [0, 1, 2], [3, 4, 5])),
    "budget_partition": _market(structure.separable_partition),
    "budget_cross_effects": _market(structure.cross_effects),
    "budget_characteristics": _market(lambda r: structure.characteristics(r, [[1, 0], [1, 0.5], [0.5, 1], [0, 1], [1, 1], [0.2, 0.8]])),
    "welfare_exact": _market(structure.welfare),
    "substitution": _market(budget.substitution),
    "discounting": lambda spark, d: rounded(dated.exponential(market.dated_choices(spark, d))),
    "present_bias_factor": lambda spark, d: rounded(dated.quasi_hyperbolic(market.dated_choices(spark, d))),
    "present_bias": lambda spark, d: rounded(dated.present_bias(market.dated_choices(spark, d))),
    "interest_bounds": lambda spark, d: rounded(dated.interest(market.dated_choices(spark, d))),
    "profit_maximisation": lambda spark, d: rounded(production.maximisation(market.firms(spark, d))),
    "cost_minimisation": lambda spark, d: rounded(production.cost_minimisation(market.firms(spark, d))),
    "returns_to_scale": lambda spark, d: rounded(production.returns_to_scale(market.firms(spark, d))),
    "risk_dominance": lambda spark, d: rounded(lotteries.dominance(market.lotteries(spark, d))),
    "risk_profiles": lambda spark, d: rounded(lotteries.profiles(market.lotteries(spark, d))),
    "ideal_points": lambda spark, d: structure.ideal_points(_obs(market.daily_menus(market.events(spark, d, ITEMS))), market.item_features(spark, d)).drop("point"),
}

def _reorders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands that customers buy again within a type of part."""
    from pyspark.sql import Window

    lines = market.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = market.table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    orders = market.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    joined = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    rows = joined.select(F.col("o_custkey").cast("string").alias("user_id"), "o_orderdate", "o_orderkey", F.col("p_type").alias("category"), F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int").alias("product"))
    seq = F.dense_rank().over(Window.partitionBy("user_id", "category").orderBy("o_orderdate", "o_orderkey"))
    return clicklogs.from_earlier_orders(rows.withColumn("seq", seq.cast("long")))


def _texts(menus: DataFrame) -> DataFrame:
    return _menu_list(menus.withColumn("t", F.col("t").cast("string")))


QUERIES |= {
    "menus_until_feedback": _events(lambda e: _texts(clicklogs.until_feedback(e))),
    "menus_best_of_day": _events(lambda e: _texts(clicklogs.best_of_day(e))),
    "menus_impressions": _events(lambda e: _texts(clicklogs.impressions(
        e.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("t")).agg(F.concat_ws(" ", F.array_sort(F.collect_list(F.concat_ws("-", F.col("item").cast("string"), (F.col("event_type") == "purchase").cast("int").cast("string"))))).alias("impressions"))
    ))),
    "menus_slates": _events(lambda e: _texts(clicklogs.slates(e.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("t")).agg(F.array_sort(F.collect_set("item")).alias("slate"), F.max("item").alias("click"))).drop("slate", "click"))),
    "menus_pseudo_users": _menus(lambda m: _texts(clicklogs.pseudo_users(m.withColumn("t", F.concat_ws("/", "t", "user_id")), "choice", 4))),
    "menus_from_earlier_orders": lambda spark, d: _texts(_reorders(spark, d).withColumn("t", F.concat_ws("/", "category", "t"))),
    "menus_of_frequent_users": _menus(lambda m: _texts(clicklogs.enough(m, 5))),
    "menus_split": _menus(lambda m: clicklogs.split(m).groupBy("user_id", "part").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("last_t"))),
    "menus_summary": _menus(clicklogs.summary),
    "top_items": lambda spark, d: rounded(clicklogs.top_items(market.purchases(spark, d), 3).groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"))),
    "unpivoted_prices": lambda spark, d: clicklogs.long_from_days(market.price_grid(market.purchases(spark, d)).groupBy("item").agg(F.min("price").alias("low"), F.max("price").alias("high")), ["item"], ["low", "high"]),
    "feature_spending": lambda spark, d: rounded(features.spending(market.purchases(spark, d))),
    "feature_engagement": _menus(features.engagement),
    "feature_iia_violations": _menus(features.iia_violations, FEW_ITEMS),
    "feature_lift": _market(lambda r: features.lift(
        budget.features(r).select("user_id", (F.col("total_spend") % 2 < 1).cast("int").alias("label"), F.col("mean_spend").alias("score")), budget.features(r).select("user_id", F.col("n_obs").alias("score")))),
}

def _counts(freq: DataFrame) -> DataFrame:
    """(user_id, obs: array of (menu, counts)) from frequencies."""
    cells = freq.groupBy("user_id", "menu").agg(F.map_from_entries(F.collect_list(F.struct("item", "n"))).alias("c"))
    return cells.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("menu", F.transform("menu", lambda i: F.element_at("c", i)).alias("counts")))).alias("obs"))


def _user_rankings(m: DataFrame) -> DataFrame:
    """Users' rankings of items by how often they took them."""
    counts = m.groupBy("user_id", "choice").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "choice"))), lambda x: x["choice"]).alias("ranking"))


QUERIES |= {
    "menu_preferences": _menus(lambda m: menus.preferences(_obs(m))),
    "menu_maximality": _menus(lambda m: menus.maximality(_obs(m))),
    "menu_consideration": _menus(lambda m: menus.consideration(_obs(m))),
    "menu_limited_attention_order": _menus(lambda m: menus.limited_attention(_obs(m)), FEW_ITEMS),
    "menu_attention_filter": _menus(lambda m: menus.with_filter(_obs(m), lambda menu: sorted(menu)[:3])),
    "menu_panel_summary": _menus(lambda m: MenuPanel(_obs(m)).summary()),
    "menu_audit": _menus(lambda m: Auditor().menus(MenuPanel(_obs(m)))),
    "choice_random_attention": _frequencies(lambda f: menus.random_attention(_counts(f))),
    "choice_logit": _frequencies(lambda f: menus.logit(_counts(f))),
    "ranking_pairs": _menus(lambda m: ranking.pairs_of(_user_rankings(m)).select(F.col("winner").cast("long").alias("winner"), F.col("loser").cast("long").alias("loser"), "n")),
    "kemeny_order": _menus(lambda m: ranking.kemeny(ranking.pairs_of(_user_rankings(m)))),
    "technical_efficiency": lambda spark, d: rounded(menus.technical_efficiency(market.firms(spark, d))),
    "expected_utility": lambda spark, d: menus.expected_utility(menus.as_lotteries(market.lotteries(spark, d))),
    "audit_observations": _market(lambda r: Auditor().granular(Panel(r))),
    "panel_rolling": _market(lambda r: Panel(r).windows(4).score(("garp", "ccei")).select("user_id", "is_garp", "ccei")),
    "user_vectors": _market(lambda r: Encoder(("garp", "ccei", "mpi")).transform(Panel(r)).select("user_id", F.transform("features", lambda x: F.round(x, 6)).alias("features"))),
}

QUERIES |= {
    "budget_ccei": _market(lambda r: score.score_budget(r, ("garp", "ccei")).select("user_id", "is_garp", "ccei")),
    "budget_harp": _market(lambda r: score.score_budget(r, ("garp", "harp")).select("user_id", "is_harp")),
    "budget_afriat_success": _market(lambda r: score.score_budget(r, ("garp", "utility")).select("user_id", "utility_success")),
    "budget_pump_pairs": _market(budget.pump_pairs),
    "budget_quasilinear_any_length": _market(structure.quasilinear),
    "budget_stone_geary": _market(structure.stone_geary),
    "budget_two_stage": _market(structure.two_stage_effects),
    "budget_slutsky_bootstrap": _market(structure.slutsky_bootstrap),
    "budget_additive_groups": _market(structure.additive_groups),
    "price_effects": _market(budget.price_effects),
    "population_welfare": _market(budget.population_welfare),
    "additive_consistency": _market(budget.additive_consistency),
    "imputed_prices": lambda spark, d: rounded(market.imputed_prices(market.purchases(spark, d))),
    "choice_axioms": _frequencies(stochastic.axioms),
    "choice_attention": _frequencies(lambda f: stochastic.attention(f).withColumn("item", F.col("item").cast("long"))),
    "choice_compromises": lambda spark, d: rounded(stochastic.compromises(
        stochastic.frequencies(market.daily_menus(market.events(spark, d, FEW_ITEMS)).withColumn("user_id", F.lit("all"))), market.item_features(spark, d).select("item", F.get("x", F.lit(0)).alias("a"))).withColumns({"menu": F.concat_ws(",", F.transform("menu", lambda i: i.cast("string"))), "item": F.col("item").cast("long")})),
    "rank_dependent_utility": lambda spark, d: menus.rank_dependent(menus.as_lotteries(market.lotteries(spark, d))),
    "spatial_metrics": lambda spark, d: rounded(structure.spatial(_obs(market.daily_menus(market.events(spark, d, ITEMS))), market.item_features(spark, d))),
}

_B = "WITH RECURSIVE " + BUDGET_SQL
_M = "WITH RECURSIVE " + MENU_SQL.format(items=ITEMS)
_F = "WITH RECURSIVE " + MENU_SQL.format(items=FEW_ITEMS) + """
, counts AS (
  SELECT menu, choice, count(*) AS c FROM menus GROUP BY menu, choice
), totals AS (
  SELECT menu, count(*) AS total FROM menus GROUP BY menu
), freq AS (
  SELECT 'all' AS user_id, t.menu, t.item, coalesce(k.c, 0) AS n, coalesce(k.c, 0) / t.total AS p, t.total
  FROM (SELECT menu, total, unnest(menu) AS item FROM totals) t LEFT JOIN counts k ON k.menu = t.menu AND k.choice = t.item
)
"""

def _closure(source: str, column: str, name: str = "reach") -> str:
    return f""", {name}_steps AS (SELECT user_id, i, j FROM {source} WHERE {column}), {name}(user_id, i, j) AS (
  SELECT user_id, i, j FROM {name}_steps
  UNION
  SELECT a.user_id, a.i, b.j FROM {name} a JOIN {name}_steps b ON b.user_id = a.user_id AND b.i = a.j
)"""


_GARP = _B + _closure("edges", "r") + """
, bad AS (
  SELECT e.user_id, count(*) AS n FROM edges e JOIN reach b ON b.user_id = e.user_id AND b.i = e.j AND b.j = e.i WHERE e.p GROUP BY e.user_id
), labels AS (
  SELECT o.user_id, o.i, least(o.i, coalesce(min(a.j), o.i)) AS label
  FROM obs o LEFT JOIN reach a ON a.user_id = o.user_id AND a.i = o.i AND EXISTS (SELECT 1 FROM reach b WHERE b.user_id = a.user_id AND b.i = a.j AND b.j = a.i)
  GROUP BY o.user_id, o.i
), parts AS (
  SELECT user_id, label, count(*) AS n FROM labels GROUP BY user_id, label
), scc AS (
  SELECT user_id, max(n) AS max_scc, count(*) AS n_scc FROM parts GROUP BY user_id
), garp AS (
  SELECT s.user_id, coalesce(b.n, 0) = 0 AS is_garp, coalesce(b.n, 0) AS n_violations, CAST(s.max_scc AS BIGINT) AS max_scc, s.n_scc FROM scc s LEFT JOIN bad b USING (user_id)
)
"""
_GOODS = """
, goods AS (
  SELECT o.user_id, o.i, dense_rank() OVER (ORDER BY g.item) - 1 AS g, g.price, coalesce(x.quantity, 0) AS quantity
  FROM obs o JOIN grid g USING (t) LEFT JOIN bought x ON x.user_id = o.user_id AND x.t = o.t AND x.item = g.item
), moves AS (
  SELECT a.user_id, a.g, (b.price - a.price) / a.price AS dp, b.price - a.price AS dprice, b.quantity - a.quantity AS dq
  FROM goods a JOIN goods b ON a.user_id = b.user_id AND a.g = b.g AND a.i < b.i
)
"""
_MENU_REACH = ", steps AS (SELECT user_id, i, j FROM edges)" + _closure("edges", "TRUE") + """
, users AS (SELECT DISTINCT user_id FROM menus)
, reversals AS (
  SELECT a.user_id, a.i AS x, a.j AS y FROM edges a JOIN edges b ON a.user_id = b.user_id AND a.i = b.j AND a.j = b.i AND a.i < a.j
), unexcused AS (
  SELECT * FROM reversals r WHERE NOT EXISTS (SELECT 1 FROM edges a JOIN edges b ON a.user_id = b.user_id AND a.i = b.i WHERE a.user_id = r.user_id AND a.j = r.x AND b.j = r.y)
), network AS (
  SELECT user_id, CASE WHEN n > 1 THEN coalesce(e, 0) / (n * (n - 1)) ELSE 0 END AS r_density, CASE WHEN e > 0 THEN log2(e) - s / e ELSE 0 END AS pref_entropy, choice_diversity
  FROM (SELECT user_id, count(*) AS n FROM items GROUP BY user_id)
  JOIN (SELECT user_id, count(DISTINCT choice) / count(*) AS choice_diversity FROM menus GROUP BY user_id) USING (user_id)
  LEFT JOIN (SELECT user_id, sum(d) AS e, sum(d * log2(d)) AS s FROM (SELECT user_id, i, count(*) AS d FROM edges GROUP BY user_id, i) GROUP BY user_id) USING (user_id)
)
"""
_PAIRS = """
, pairwise AS (
  SELECT a.user_id, a.item AS x, b.item AS y, sum(a.n) / (sum(a.n) + sum(b.n)) AS p
  FROM freq a JOIN freq b ON a.user_id = b.user_id AND a.menu = b.menu AND a.item <> b.item GROUP BY a.user_id, a.item, b.item HAVING sum(a.n) + sum(b.n) > 0
), odds AS (
  SELECT a.user_id, a.item AS x, b.item AS y, count(*) AS n_menus, avg(a.p / b.p) AS mean_odds, stddev_pop(a.p / b.p) / avg(a.p / b.p) AS cv
  FROM freq a JOIN freq b ON a.user_id = b.user_id AND a.menu = b.menu AND a.item < b.item WHERE a.n > 0 AND b.n > 0 GROUP BY a.user_id, a.item, b.item
)
"""

ORACLE_SQL: dict[str, str] = {
    "price_grid": _B + "SELECT t, item, price FROM grid",
    "budget_edges": _B + "SELECT user_id, i, j, own, e, r, p FROM edges",
    "budget_garp": _GARP + "SELECT * FROM garp",
    "budget_variants": _B + _closure("edges", "r") + _closure("edges", "p", "through") + """
, duals AS (
  SELECT c.user_id, c.i, c.j, c.e <= o.e + 1e-10 AS r, c.e < o.e - 1e-10 AS p FROM cost c JOIN cost o ON o.user_id = c.user_id AND o.i = c.j AND o.j = c.j WHERE c.i <> c.j
)""" + _closure("duals", "r", "dual_reach") + """
SELECT s.user_id,
  (SELECT count(*) FROM reach a JOIN reach b ON a.user_id = b.user_id AND a.i = b.j AND a.j = b.i WHERE a.user_id = s.user_id AND a.i < a.j) AS n_sarp,
  (SELECT count(*) FROM through a JOIN through b ON a.user_id = b.user_id AND a.i = b.j AND a.j = b.i WHERE a.user_id = s.user_id AND a.i <> a.j) AS n_acyclical_p,
  (SELECT count(*) FROM duals d JOIN dual_reach b ON b.user_id = d.user_id AND b.i = d.j AND b.j = d.i WHERE d.user_id = s.user_id AND d.p) AS n_gapp
FROM sizes s""",
    "budget_warp": _B + """
SELECT s.user_id, coalesce(v.n, 0) AS n_violations, coalesce(v.n, 0) = 0 AS is_warp
FROM sizes s LEFT JOIN (SELECT a.user_id, count(*) AS n FROM edges a JOIN edges b ON a.user_id = b.user_id AND a.i = b.j AND a.j = b.i AND a.i < a.j WHERE (a.r AND b.p) OR (a.p AND b.r) GROUP BY a.user_id) v USING (user_id)""",
    "budget_vei": _GARP + """
, level AS (
  SELECT o.user_id, o.i, least(1.0, greatest(0.0, coalesce(max(e.e / e.own) FILTER (e.own >= e.e - 1e-8), 0))) AS x FROM obs o LEFT JOIN edges e ON e.user_id = o.user_id AND e.i = o.i GROUP BY o.user_id, o.i
)
SELECT g.user_id, round(CASE WHEN any_value(is_garp) THEN 1.0 ELSE avg(x) END, 6) AS vei_mean, round(CASE WHEN any_value(is_garp) THEN 1.0 ELSE min(x) END, 6) AS vei_min FROM garp g JOIN level USING (user_id) GROUP BY g.user_id""",
    "budget_network": _B + """
, deg AS (
  SELECT o.user_id, o.i, count(*) FILTER (e.r AND e.i = o.i) AS d_out, count(*) FILTER (e.r) AS d FROM obs o LEFT JOIN edges e ON e.user_id = o.user_id AND (e.i = o.i OR e.j = o.i) GROUP BY o.user_id, o.i
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d, i) AS k FROM deg
)
SELECT user_id, round(CASE WHEN count(*) > 1 THEN sum(d_out) / (count(*) * (count(*) - 1)) ELSE 0 END, 6) AS r_density, round(coalesce(stddev_pop(d_out), 0), 6) AS r_out_degree_std,
  round(CASE WHEN sum(d) > 0 THEN (2 * sum(k * d) - (count(*) + 1) * sum(d)) / (count(*) * sum(d)) ELSE 0 END, 6) AS degree_gini
FROM ranked GROUP BY user_id""",
    "budget_weights": _B + """
, w AS (SELECT user_id, ln(own) - ln(e) AS w FROM edges WHERE r AND own > 1e-10 AND e > 1e-10),
m AS (SELECT user_id, avg(w) AS m, avg(w * w) AS m2, avg(w * w * w) AS m3 FROM w GROUP BY user_id),
v AS (SELECT *, sqrt(greatest(0, m2 - m * m)) AS sd FROM m)
SELECT s.user_id, round(coalesce(m, 0), 6) AS ew_mean, round(coalesce(sd, 0), 6) AS ew_std, round(coalesce(CASE WHEN sd > 1e-12 THEN (m3 - 3 * m * m2 + 2 * m * m * m) / (sd * sd * sd) ELSE 0 END, 0), 6) AS ew_skew FROM sizes s LEFT JOIN v USING (user_id)""",
    "budget_savings": _B + "SELECT s.user_id, round(coalesce(max((own - e) / own) FILTER (r), 0), 6) AS max_saving FROM sizes s LEFT JOIN edges USING (user_id) GROUP BY s.user_id",
    "budget_quasilinear": _B + """
, gain AS (SELECT user_id, i, j, e - own AS g FROM edges),
two AS (SELECT a.user_id, count(*) AS n FROM gain a JOIN gain b ON a.user_id = b.user_id AND a.j = b.i AND b.j = a.i AND a.i < a.j WHERE a.g + b.g < -1e-10 GROUP BY a.user_id),
three AS (SELECT a.user_id, count(*) AS n FROM gain a JOIN gain b ON a.user_id = b.user_id AND a.j = b.i AND b.j > a.i AND a.i < a.j JOIN gain c ON c.user_id = a.user_id AND c.i = b.j AND c.j = a.i WHERE a.g + b.g + c.g < -1e-10 GROUP BY a.user_id)
SELECT s.user_id, coalesce(two.n, 0) AS two_cycles, coalesce(three.n, 0) AS three_cycles, coalesce(two.n, 0) + coalesce(three.n, 0) = 0 AS is_quasilinear FROM sizes s LEFT JOIN two USING (user_id) LEFT JOIN three USING (user_id)""",
    "spending_features": _B + _GOODS + """
, own AS (SELECT user_id, i, sum(price * quantity) AS own, sum((price * quantity) ** 2) AS squares, CAST(count(*) FILTER (quantity > 0) AS DOUBLE) AS n FROM goods GROUP BY user_id, i)
SELECT user_id, count(*) AS n_obs, round(sum(own), 6) AS total_spend, round(avg(own), 6) AS mean_spend, round(stddev_pop(own), 6) AS std_spend, round(max(own), 6) AS max_spend,
  round(CASE WHEN count(*) > 1 THEN regr_slope(own, i) ELSE 0 END, 6) AS spend_slope, round(avg(squares / (own * own)), 6) AS mean_hhi, round(avg(n), 6) AS mean_goods FROM own GROUP BY user_id""",
    "law_of_demand": _B + _GOODS + "SELECT user_id, g, count(*) FILTER (dp * dq < 0) AS obeying, count(*) FILTER (dp * dq > 0) AS violating FROM moves WHERE abs(dp) >= 0.05 GROUP BY user_id, g",
    "additivity": _B + _GOODS + "SELECT s.user_id, count(*) FILTER (dprice * dq > 1e-6) AS n_violations, count(*) FILTER (dprice * dq > 1e-6) = 0 AS is_additive FROM sizes s LEFT JOIN moves USING (user_id) GROUP BY s.user_id",
    "welfare_bounds": _B + _GOODS + """
, halves AS (SELECT user_id, g, i < n // 2 AS base, avg(price) AS p, avg(quantity) AS q FROM goods JOIN sizes USING (user_id) WHERE n >= 2 GROUP BY user_id, g, i < n // 2),
both_ AS (SELECT a.user_id, sum(b.p * a.q) - sum(b.p * b.q) AS cv, sum(a.p * b.q) - sum(a.p * a.q) AS ev, -sum((b.p - a.p) * a.q) AS surplus FROM halves a JOIN halves b ON a.user_id = b.user_id AND a.g = b.g AND a.base AND NOT b.base GROUP BY a.user_id)
SELECT user_id, round(cv, 6) AS cv, round(ev, 6) AS ev, round(surplus, 6) AS surplus, round(abs(cv - ev) / 2, 6) AS deadweight_loss FROM both_""",
    "cannibalization": _B + _GOODS + """
, shares AS (SELECT user_id, i, sum(price * quantity) FILTER (g < 3) / sum(price * quantity) AS a, sum(price * quantity) FILTER (g >= 3) / sum(price * quantity) AS b FROM goods GROUP BY user_id, i HAVING sum(price * quantity) > 0),
d AS (SELECT user_id, a - lag(a) OVER w AS da, b - lag(b) OVER w AS db FROM shares WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, count(*) AS n_changes, round(CASE WHEN count(*) > 1 THEN corr(da, db) END, 6) AS correlation FROM d WHERE da IS NOT NULL GROUP BY user_id""",
    "panel_summary": _GARP + """
SELECT count(*) AS n_users, round(avg(CAST(is_garp AS INTEGER)), 6) AS share_consistent, round(avg(n_violations), 6) AS mean_violations, round(stddev_pop(n_violations), 6) AS std_violations,
  round(quantile_cont(n_violations, 0.25), 6) AS q25_violations, round(median(n_violations), 6) AS median_violations, round(quantile_cont(n_violations, 0.75), 6) AS q75_violations, max(n_violations) AS max_violations, max(max_scc) AS max_scc FROM garp""",
    "panel_most_inconsistent": _GARP + "SELECT user_id, n_violations, max_scc FROM garp ORDER BY n_violations DESC, max_scc DESC, user_id LIMIT 5",
    "panel_periods": _B + "SELECT substr(o.t, 1, 4) AS period, count(*) AS n_obs, count(DISTINCT o.user_id) AS n_users, round(avg(c.e), 6) AS mean_spend, round(median(c.e), 6) AS median_spend FROM obs o JOIN cost c ON c.user_id = o.user_id AND c.i = o.i AND c.j = o.i GROUP BY substr(o.t, 1, 4)",
    "panel_windows": _B + "SELECT o.user_id, o.i // 4 AS w, count(*) AS n_obs, round(sum(c.e), 6) AS spend, min(o.t) AS first_t, max(o.t) AS last_t FROM obs o JOIN cost c ON c.user_id = o.user_id AND c.i = o.i AND c.j = o.i GROUP BY o.user_id, o.i // 4",
    "event_sessions": _M + """
, marked AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000, FALSE) AS late FROM seen WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT *, CAST(sum(CAST(late AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM marked)
SELECT user_id, session, count(*) AS n_events, count(DISTINCT item) AS n_items FROM numbered GROUP BY user_id, session""",
    "session_menus": _M + """
, marked AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 36000000000, FALSE) AS late FROM seen WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT *, CAST(sum(CAST(late AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM marked)
SELECT user_id, CAST(session AS VARCHAR) AS t, array_to_string(list_sort(list_distinct(list(item))), ',') AS menu, CAST(max(item) FILTER (event_type = 'purchase') AS BIGINT) AS choice
FROM numbered GROUP BY user_id, session HAVING count(item) FILTER (event_type = 'purchase') = 1 AND count(DISTINCT item) BETWEEN 2 AND 50""",
    "windowed_menus": _M + """
, joined AS (
  SELECT b.user_id, b.event_id, b.item AS choice, list(v.item) FILTER (v.item IS NOT NULL) AS viewed
  FROM seen b LEFT JOIN seen v ON v.user_id = b.user_id AND v.event_type IN ('view', 'click') AND epoch_us(v.ts) BETWEEN epoch_us(b.ts) - 172800000000 AND epoch_us(b.ts) - 1
  WHERE b.event_type = 'purchase' GROUP BY b.user_id, b.event_id, b.item
), unions AS (SELECT user_id, event_id, choice, list_sort(list_distinct(list_append(coalesce(viewed, []), choice))) AS menu FROM joined)
SELECT user_id, CAST(event_id AS VARCHAR) AS t, array_to_string(menu, ',') AS menu, CAST(choice AS BIGINT) AS choice FROM unions WHERE len(menu) >= 2""",
    "daily_menus": _M + "SELECT user_id, t, array_to_string(menu, ',') AS menu, CAST(choice AS BIGINT) AS choice FROM menus",
    "menu_edges": _M + "SELECT user_id, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j FROM edges",
    "menu_warp": _M + _MENU_REACH + "SELECT u.user_id, coalesce(n, 0) AS n_warp_violations, coalesce(n, 0) = 0 AS is_warp FROM users u LEFT JOIN (SELECT user_id, count(*) AS n FROM reversals GROUP BY user_id) USING (user_id)",
    "menu_warp_limited_attention": _M + _MENU_REACH + "SELECT u.user_id, coalesce(n, 0) AS n_unexcused, coalesce(n, 0) = 0 AS is_warp_la FROM users u LEFT JOIN (SELECT user_id, count(*) AS n FROM unexcused GROUP BY user_id) USING (user_id)",
    "menu_scores": _M + _MENU_REACH + """
, mutual AS (SELECT a.user_id, a.i, a.j FROM reach a JOIN reach b ON a.user_id = b.user_id AND a.i = b.j AND a.j = b.i),
labels AS (SELECT x.user_id, x.item, least(x.item, coalesce(min(m.j), x.item)) AS label FROM items x LEFT JOIN mutual m ON m.user_id = x.user_id AND m.i = x.item GROUP BY x.user_id, x.item),
parts AS (SELECT user_id, label, count(*) AS n FROM labels GROUP BY user_id, label),
scc AS (SELECT user_id, max(n) AS max_scc, count(*) AS n_scc, sum(n) AS hm_total, sum(n) - sum(n // 2) AS hm_consistent FROM parts GROUP BY user_id),
sarp AS (SELECT user_id, count(*) AS n FROM mutual WHERE i < j GROUP BY user_id), warp AS (SELECT user_id, count(*) AS n FROM reversals GROUP BY user_id), la AS (SELECT user_id, count(*) AS n FROM unexcused GROUP BY user_id)
SELECT s.user_id, sarp.n IS NULL AS is_sarp, warp.n IS NULL AS is_warp, la.n IS NULL AS is_warp_la, coalesce(sarp.n, 0) AS n_sarp_violations, coalesce(warp.n, 0) AS n_warp_violations, CAST(hm_consistent AS BIGINT) AS hm_consistent, CAST(hm_total AS BIGINT) AS hm_total,
  CAST(max_scc AS BIGINT) AS max_scc, n_scc, round(r_density, 6) AS r_density, round(pref_entropy, 6) + 0.0 AS pref_entropy, round(choice_diversity, 6) AS choice_diversity
FROM scc s JOIN network USING (user_id) LEFT JOIN sarp USING (user_id) LEFT JOIN warp USING (user_id) LEFT JOIN la USING (user_id)""",
    "menu_network": _M + _MENU_REACH + "SELECT user_id, round(r_density, 6) AS r_density, round(pref_entropy, 6) AS pref_entropy, round(choice_diversity, 6) AS choice_diversity FROM network",
    "menu_salience": _M + "SELECT CAST(item AS BIGINT) AS item, count(*) AS shown, count(*) FILTER (item = choice) AS chosen, round(count(*) FILTER (item = choice) / count(*), 6) AS salience FROM shown GROUP BY item",
    "menu_overload": _M + """
, top AS (SELECT user_id, arg_max(choice, n * 1000 - choice) AS favourite FROM (SELECT user_id, choice, count(*) AS n FROM menus GROUP BY user_id, choice) GROUP BY user_id)
SELECT len(menu) AS size, count(*) AS n, round(avg(CAST(choice = favourite AS INTEGER)), 6) AS quality, round(ln(len(menu) + 1.0), 6) AS log_size FROM menus JOIN top USING (user_id) GROUP BY len(menu)""",
    "menu_overload_slope": _M + """
, top AS (SELECT user_id, arg_max(choice, n * 1000 - choice) AS favourite FROM (SELECT user_id, choice, count(*) AS n FROM menus GROUP BY user_id, choice) GROUP BY user_id),
by_size AS (SELECT avg(CAST(choice = favourite AS INTEGER)) AS quality, ln(len(menu) + 1.0) AS log_size FROM menus JOIN top USING (user_id) GROUP BY len(menu))
SELECT round(regr_slope(quality, log_size), 6) AS slope, round(regr_r2(quality, log_size), 6) AS r2 FROM by_size""",
    "menu_status_quo": _M + """
, c AS (SELECT user_id, CAST(choice = menu[1] AS INTEGER) AS d, 1.0 / len(menu) AS p FROM (SELECT user_id, choice, menu FROM menus)),
s AS (SELECT user_id, count(*) AS n, sum(d) AS taken, sum(CAST(p AS DOUBLE)) AS expected, sum(CAST(p AS DOUBLE) * (1 - CAST(p AS DOUBLE))) AS variance FROM c GROUP BY user_id)
SELECT user_id, n, round(taken / n, 6) AS default_rate, round(expected / n, 6) AS chance_rate, round(CASE WHEN variance > 0 THEN (taken - expected) / sqrt(variance) ELSE 0 END, 6) AS z FROM s""",
    "menu_attention_relation": "WITH RECURSIVE " + MENU_SQL.format(items=FEW_ITEMS) + """
, single AS (SELECT user_id, menu, arg_max(choice, t) AS choice FROM menus GROUP BY user_id, menu)
SELECT DISTINCT a.user_id, CAST(a.choice AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM (SELECT user_id, menu, choice, unnest(menu) AS y FROM single) a
JOIN single b ON a.user_id = b.user_id AND list_filter(a.menu, lambda z: z <> a.y) = b.menu WHERE a.y <> a.choice AND b.choice <> a.choice""",
    "choice_regularity": _F + """
, pairs AS (SELECT a.user_id, b.p - a.p AS over FROM freq a JOIN freq b ON a.item = b.item AND len(a.menu) < len(b.menu) AND list_has_all(b.menu, a.menu))
SELECT user_id, count(*) AS n_testable, count(*) FILTER (over > 0.01) AS n_violations, round(max(greatest(0, over)), 6) AS worst, count(*) FILTER (over > 0.01) = 0 AS is_regular FROM pairs GROUP BY user_id""",
    "choice_odds": _F + _PAIRS + "SELECT user_id, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, n_menus, round(mean_odds, 6) AS mean_odds, round(cv, 6) AS cv FROM odds",
    "choice_independence": _F + _PAIRS + "SELECT user_id, count(*) FILTER (n_menus > 1 AND cv > 0.1) AS n_violations, count(*) AS n_pairs, count(*) FILTER (n_menus > 1 AND cv > 0.1) = 0 AS is_iia FROM odds GROUP BY user_id",
    "choice_transitivity": _F + _PAIRS + """
, path AS (SELECT a.user_id, a.p AS pxy, b.p AS pyz, coalesce(c.p, 0.5) AS pxz FROM pairwise a JOIN pairwise b ON a.user_id = b.user_id AND a.y = b.x AND a.x <> b.y LEFT JOIN pairwise c ON c.user_id = a.user_id AND c.x = a.x AND c.y = b.y WHERE a.p > 0.51 AND b.p > 0.51)
SELECT user_id, count(*) AS n_triples, count(*) FILTER (pxz < 0.49) AS weak, count(*) FILTER (pxz < least(pxy, pyz) - 0.01) AS moderate, count(*) FILTER (pxz < greatest(pxy, pyz) - 0.01) AS strong FROM path GROUP BY user_id""",
    "choice_luce": _F + """
, s AS (SELECT user_id, item, sum(n) / sum(total) AS share FROM freq GROUP BY user_id, item)
SELECT user_id, CAST(item AS BIGINT) AS item, round(share, 6) AS share, round(ln(greatest(share, 1e-10)) - min(ln(greatest(share, 1e-10))) OVER (PARTITION BY user_id), 6) AS utility FROM s""",
    "choice_decoys": _F + """
SELECT a.user_id, CAST(a.item AS BIGINT) AS target, CAST(list_filter(b.menu, lambda z: NOT list_contains(a.menu, z))[1] AS BIGINT) AS decoy, round(b.p - a.p, 6) AS gain, b.p - a.p > 0.05 AS is_decoy
FROM freq a JOIN freq b ON a.item = b.item AND len(a.menu) = 2 AND len(b.menu) = 3 AND list_has_all(b.menu, a.menu)""",
    "pairwise_wins": _M + "SELECT CAST(choice AS BIGINT) AS winner, CAST(item AS BIGINT) AS loser, count(*) AS n FROM shown WHERE item <> choice GROUP BY choice, item",
    "borda_count": _M + """
, points AS (SELECT user_id, choice AS item, sum(len(menu) - 1) AS points FROM menus GROUP BY user_id, choice),
ranked AS (SELECT item, row_number() OVER (PARTITION BY user_id ORDER BY points DESC, item) - 1 AS place FROM points)
SELECT CAST(item AS BIGINT) AS item, CAST(sum(place) AS BIGINT) AS place_sum, count(*) AS n_rankings FROM ranked GROUP BY item""",
    "rank_agreement": _M + """
, by_day AS (SELECT t AS pair_id, item, count(*) AS n_shown, count(*) FILTER (item = choice) AS n_chosen FROM shown GROUP BY t, item),
places AS (SELECT pair_id, item, row_number() OVER (PARTITION BY pair_id ORDER BY n_shown DESC, item) - 1 AS a, row_number() OVER (PARTITION BY pair_id ORDER BY n_chosen DESC, item) - 1 AS b FROM by_day),
tau AS (SELECT x.pair_id, avg(sign((x.a - y.a) * (x.b - y.b))) AS tau FROM places x JOIN places y ON x.pair_id = y.pair_id AND x.item < y.item GROUP BY x.pair_id),
foot AS (SELECT pair_id, count(*) AS n, sum(abs(a - b)) AS d FROM places GROUP BY pair_id)
SELECT pair_id, n, round(coalesce(tau, 1), 6) AS tau, round(CASE WHEN n * n // 2 > 0 THEN d / (n * n // 2) ELSE 0 END, 6) AS footrule FROM foot LEFT JOIN tau USING (pair_id)""",
}

_DATED = """
WITH o AS (
  SELECT CAST(o_custkey AS VARCHAR) AS user_id, o_totalprice AS amount0, lead(o_totalprice) OVER w AS amount1, date_diff('day', o_orderdate::DATE, (lead(o_orderdate) OVER w)::DATE) AS ahead,
         (row_number() OVER w % 2) * 30 AS date0, o_orderpriority[1] < '3' AS later
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
), c AS (
  SELECT *, date0 + ahead AS date1 FROM o WHERE ahead IS NOT NULL
), bounds AS (
  SELECT user_id, count(*) AS n_choices, greatest(0.0, coalesce(max(implied) FILTER (later), 0.0)) AS delta_low, least(1.0, coalesce(min(implied) FILTER (NOT later), 1.0)) AS delta_high
  FROM (SELECT *, pow(amount0 / amount1, 1.0 / ahead) AS implied FROM c WHERE ahead > 0 AND amount0 > 0 AND amount1 > 0) GROUP BY user_id
)
"""
_FIRMS = """
WITH firms AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS user_id, year(l_shipdate) || '-' || quarter(l_shipdate) AS t, floor(sum(l_extendedprice) / sum(l_quantity) * 100 + 0.5) AS p0, floor((1 + avg(l_tax)) * 100 + 0.5) AS p1, sum(l_quantity) AS q0, CAST(count(*) AS DOUBLE) AS q1,
    floor(coalesce(sum(l_extendedprice) FILTER (l_returnflag <> 'R'), 0) * 100 + 0.5) AS o0, floor(coalesce(sum(l_extendedprice) FILTER (l_returnflag = 'R'), 0) * 100 + 0.5) AS o1
  FROM lineitem GROUP BY l_suppkey, year(l_shipdate) || '-' || quarter(l_shipdate)
), pairs AS (
  SELECT a.user_id, a.o0 + 0.5 * a.o1 - a.p0 * a.q0 - a.p1 * a.q1 AS own, b.o0 + 0.5 * b.o1 - a.p0 * b.q0 - a.p1 * b.q1 AS e, b.o0 >= a.o0 - 1e-10 AND b.o1 >= a.o1 - 1e-10 AS enough,
    a.p0 * b.q0 + a.p1 * b.q1 < a.p0 * a.q0 + a.p1 * a.q1 - 1e-10 AS cheaper
  FROM firms a JOIN firms b ON a.user_id = b.user_id AND a.t <> b.t
), users AS (SELECT DISTINCT user_id FROM firms)
"""
ORACLE_SQL |= {
    "substitution": _B + _GOODS + """
, pairs AS (
  SELECT a.user_id, a.i, b.i AS k, a.g, (b.price - a.price) / a.price AS dp, b.quantity - a.quantity AS dq FROM goods a JOIN goods b ON a.user_id = b.user_id AND a.g = b.g AND a.i < b.i
), clean AS (
  SELECT user_id, i, k, arg_max(g, abs(dp)) AS h, arg_max(dp, abs(dp)) AS dh FROM pairs GROUP BY user_id, i, k HAVING max(abs(dp)) >= 0.05 AND list_sort(list(abs(dp)), 'DESC')[2] <= max(abs(dp)) / 2
)
SELECT p.g, CAST(c.h AS BIGINT) AS h, count(*) FILTER (p.dq * c.dh > 0) AS substitutes, count(*) FILTER (p.dq * c.dh < 0) AS complements
FROM clean c JOIN pairs p ON p.user_id = c.user_id AND p.i = c.i AND p.k = c.k AND p.g <> c.h GROUP BY p.g, c.h""",
    "discounting": _DATED + "SELECT user_id, n_choices, round(delta_low, 6) AS delta_low, round(delta_high, 6) AS delta_high, delta_low <= delta_high + 1e-8 AS is_consistent FROM bounds",
    "present_bias_factor": _DATED + """
, by_beta AS (
  SELECT user_id, beta, greatest(0.0, coalesce(max(implied) FILTER (later), 0.0)) AS low, least(1.0, coalesce(min(implied) FILTER (NOT later), 1.0)) AS high
  FROM (SELECT c.*, beta, pow(amount0 / (CASE WHEN date0 = 0 THEN beta ELSE 1.0 END * amount1), 1.0 / ahead) AS implied FROM c, (SELECT (range + 1) / 20 AS beta FROM range(20)) WHERE ahead > 0 AND amount0 > 0 AND amount1 > 0) GROUP BY user_id, beta
)
SELECT user_id, round(max(beta) FILTER (low <= high + 1e-8), 6) AS beta, count(*) FILTER (low <= high + 1e-8) AS n_fitting FROM by_beta GROUP BY user_id""",
    "present_bias": _DATED + """
, p AS (SELECT user_id, avg(CAST(later AS INTEGER)) FILTER (date0 = 0) AS a, avg(CAST(later AS INTEGER)) FILTER (date0 <> 0) AS b FROM c GROUP BY user_id)
SELECT user_id, round(a, 6) AS patience_now, round(b, 6) AS patience_future, coalesce(b - a > 0.1, FALSE) AS is_present_biased FROM p""",
    "interest_bounds": _DATED + "SELECT user_id, round(CASE WHEN delta_high > 0 THEN 1 / delta_high - 1 END, 6) AS rate_low, round(CASE WHEN delta_low > 0 THEN 1 / delta_low - 1 END, 6) AS rate_high FROM bounds",
    "profit_maximisation": _FIRMS + "SELECT u.user_id, count(*) FILTER (e > own + 1e-10) AS n_violations, round(coalesce(max(greatest(0, e - own)), 0), 6) AS largest_loss FROM users u LEFT JOIN pairs USING (user_id) GROUP BY u.user_id",
    "cost_minimisation": _FIRMS + "SELECT u.user_id, count(*) FILTER (enough AND cheaper) AS n_violations FROM users u LEFT JOIN pairs USING (user_id) GROUP BY u.user_id",
    "returns_to_scale": _FIRMS + """
, s AS (SELECT user_id, CASE WHEN count(*) > 1 THEN regr_slope(ln(o0 + 0.5 * o1), ln(p0 * q0 + p1 * q1)) END AS slope FROM firms GROUP BY user_id)
SELECT user_id, round(slope, 6) AS slope, CASE WHEN slope > 1.05 THEN 'increasing' WHEN slope < 0.95 THEN 'decreasing' ELSE 'constant' END AS returns FROM s""",
    "risk_dominance": """
WITH l AS (SELECT l_orderkey, min(l_extendedprice) AS low, max(l_extendedprice) AS high, avg(l_extendedprice) AS safe, least(1.0, 0.4 + avg(l_discount) * 2) AS p FROM lineitem GROUP BY l_orderkey),
c AS (SELECT CAST(o_custkey AS VARCHAR) AS user_id, low, high, safe, low * (1 - p) + high * p AS expected, o_orderpriority[1] >= '3' AS risky FROM l JOIN orders ON l_orderkey = o_orderkey)
SELECT user_id, count(*) AS n_choices, count(*) FILTER ((risky AND safe > high + 1e-8) OR (NOT risky AND safe < low - 1e-8)) AS n_dominated, round(avg(CAST((expected > safe) = risky AS INTEGER)), 6) AS share_expected_value,
  count(*) FILTER ((risky AND safe > high + 1e-8) OR (NOT risky AND safe < low - 1e-8)) = 0 AS is_consistent FROM c GROUP BY user_id""",
}

_TEXT = "array_to_string(menu, ',') AS menu, CAST(choice AS BIGINT) AS choice"
ORACLE_SQL |= {
    "menus_until_feedback": _M + f"""
, marked AS (SELECT *, coalesce(sum(CAST(event_type = 'purchase' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM seen),
g AS (SELECT user_id, CAST(t AS BIGINT) AS t, list_sort(list_distinct(list(item))) AS menu, max(item) FILTER (event_type = 'purchase') AS choice FROM marked GROUP BY user_id, t)
SELECT user_id, CAST(t AS VARCHAR) AS t, {_TEXT} FROM g WHERE choice IS NOT NULL AND len(menu) >= 2""",
    "menus_best_of_day": "WITH seen AS (SELECT CAST(user_id AS VARCHAR) AS user_id, strftime(ts, '%Y-%m-%d') AS t, value, CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS item FROM events)" + f"""
, g AS (SELECT user_id, t, list_sort(list_distinct(list(item))) AS menu, first(item ORDER BY value DESC, item) AS choice FROM seen GROUP BY user_id, t)
SELECT user_id, t, {_TEXT} FROM g WHERE len(menu) >= 2""",
    "menus_impressions": _M + f"""
, g AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS t, list_sort(list_distinct(list(item))) AS menu, max(item) FILTER (event_type = 'purchase') AS choice FROM seen GROUP BY user_id, strftime(ts, '%Y-%m-%d') HAVING count(*) FILTER (event_type = 'purchase') = 1)
SELECT user_id, t, {_TEXT} FROM g""",
    "menus_slates": _M + f"""
, g AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS t, list_sort(list_distinct(list(item) FILTER (item >= 3))) AS menu, max(item) AS choice FROM seen GROUP BY user_id, strftime(ts, '%Y-%m-%d') HAVING max(item) >= 3)
SELECT user_id, t, {_TEXT} FROM g WHERE len(menu) >= 2""",
    "menus_pseudo_users": _M + f"""
, r AS (SELECT t || '/' || user_id AS t, menu, choice, row_number() OVER (PARTITION BY choice ORDER BY t || '/' || user_id) - 1 AS k FROM menus)
SELECT choice || '-' || (k // 4) AS user_id, t, {_TEXT} FROM r""",
    "menus_from_earlier_orders": f"""
WITH lines AS (
  SELECT CAST(o_custkey AS VARCHAR) AS user_id, p_type AS category, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS product, dense_rank() OVER (PARTITION BY o_custkey, p_type ORDER BY o_orderdate, o_orderkey) AS seq
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
), items AS (SELECT DISTINCT * FROM lines), known AS (
  SELECT DISTINCT a.user_id, a.category, a.seq, b.product FROM (SELECT DISTINCT user_id, category, seq FROM items) a JOIN items b ON a.user_id = b.user_id AND a.category = b.category AND b.seq BETWEEN a.seq - 3 AND a.seq - 1
), again AS (
  SELECT i.user_id, i.category, i.seq, any_value(i.product) AS choice FROM items i JOIN known k USING (user_id, category, seq, product) GROUP BY i.user_id, i.category, i.seq HAVING count(*) = 1
), menus AS (SELECT a.user_id, a.category || '/' || a.seq AS t, list_sort(list(k.product)) AS menu, any_value(a.choice) AS choice FROM again a JOIN known k USING (user_id, category, seq) GROUP BY a.user_id, a.category, a.seq)
SELECT user_id, t, {_TEXT} FROM menus WHERE len(menu) >= 2""",
    "menus_of_frequent_users": _M + f"SELECT user_id, t, {_TEXT} FROM menus WHERE user_id IN (SELECT user_id FROM menus GROUP BY user_id HAVING count(*) >= 5)",
    "menus_split": _M + """
, r AS (SELECT user_id, t, (row_number() OVER (PARTITION BY user_id ORDER BY t) - 1) / count(*) OVER (PARTITION BY user_id) AS k FROM menus)
SELECT user_id, CASE WHEN k < 0.8 THEN 'train' ELSE 'test' END AS part, count(*) AS n, max(t) AS last_t FROM r GROUP BY ALL""",
    "menus_summary": _M + """
, u AS (SELECT user_id, count(*) AS n FROM menus GROUP BY user_id)
SELECT a.*, b.* FROM (SELECT count(*) AS n_users, CAST(sum(n) AS BIGINT) AS n_menus, round(avg(n), 6) AS mean_menus, median(n) AS median_menus FROM u) a, (SELECT round(avg(len(menu)), 6) AS mean_size, median(len(menu)) AS median_size, count(DISTINCT choice) AS n_chosen FROM menus) b""",
    "top_items": "WITH RECURSIVE " + BUDGET_SQL + "SELECT item, count(*) AS n, sum(quantity) AS quantity FROM purchases GROUP BY item ORDER BY count(*) DESC, item LIMIT 3",
    "unpivoted_prices": _B + ", w AS (SELECT item, min(price) AS low, max(price) AS high FROM grid GROUP BY item) SELECT item, 'low' AS day, low AS quantity FROM w UNION ALL SELECT item, 'high', high FROM w",
    "feature_spending": _B + """
, lines AS (SELECT *, quantity * unit AS spend FROM purchases),
items AS (SELECT user_id, count(*) AS n_items, max(s) AS top, sum(s * s) AS squares FROM (SELECT user_id, item, sum(spend) AS s FROM lines GROUP BY user_id, item) GROUP BY user_id),
periods AS (SELECT user_id, t, sum(spend) AS s, CAST(substr(t, 1, 4) AS INTEGER) * 12 + CAST(substr(t, 6, 2) AS INTEGER) AS m FROM lines GROUP BY user_id, t),
steps AS (SELECT user_id, s, m, row_number() OVER w - 1 AS i, abs(s - lag(s) OVER w) AS change, m - lag(m) OVER w AS gap FROM periods WINDOW w AS (PARTITION BY user_id ORDER BY t)),
totals AS (SELECT user_id, count(*) AS n_periods, sum(s) AS total, avg(s) AS mean, stddev_pop(s) AS std, max(s) AS largest, CASE WHEN count(*) > 1 THEN regr_slope(s, i) ELSE 0 END AS slope, coalesce(avg(change), 0) AS mean_change, coalesce(avg(gap), 0) AS mean_gap, coalesce(max(gap), 0) AS max_gap, max(m) - min(m) + 1 AS span FROM steps GROUP BY user_id)
SELECT user_id, n_periods, n_items, round(total, 6) AS total, round(mean, 6) AS mean, round(std, 6) AS std, round(largest, 6) AS largest, round(slope, 6) AS slope, round(mean_change, 6) AS mean_change, round(mean_gap, 6) AS mean_gap, CAST(max_gap AS BIGINT) AS max_gap,
  round(std / mean, 6) AS cv, round(squares / (total * total), 6) AS hhi, round(top / total, 6) AS top_share, round(n_periods / span, 6) AS purchase_rate FROM totals JOIN items USING (user_id)""",
    "feature_engagement": _M + """
, r AS (SELECT user_id, menu, choice, CAST(choice <> lag(choice) OVER w AS INTEGER) AS switch, lag(menu) OVER w AS before FROM menus WINDOW w AS (PARTITION BY user_id ORDER BY t)),
b AS (SELECT user_id, count(*) AS n_menus, count(DISTINCT choice) AS n_chosen, round(avg(len(menu)), 6) AS mean_size, max(len(menu)) AS max_size, round(coalesce(avg(switch), 0), 6) AS switch_rate,
  round(coalesce(avg(CASE WHEN before IS NOT NULL THEN len(list_intersect(menu, before)) / len(list_distinct(list_concat(menu, before))) END), 0), 6) AS mean_overlap FROM r GROUP BY user_id),
c AS (SELECT user_id, choice, count(*) AS c FROM menus GROUP BY user_id, choice),
s AS (SELECT user_id, round(max(c) / sum(c), 6) AS top_share, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS choice_entropy FROM c GROUP BY user_id)
SELECT * FROM b JOIN s USING (user_id)""",
    "feature_iia_violations": "WITH RECURSIVE " + MENU_SQL.format(items=FEW_ITEMS) + """
SELECT a.user_id, count(*) AS n_violations FROM (SELECT DISTINCT user_id, menu, choice FROM menus WHERE len(menu) = 2) a JOIN (SELECT DISTINCT user_id, menu, choice FROM menus WHERE len(menu) = 3) b ON a.user_id = b.user_id AND list_has_all(b.menu, a.menu) AND a.choice <> b.choice AND list_contains(a.menu, b.choice) GROUP BY a.user_id""",
    "feature_lift": _B + """
, own AS (SELECT user_id, e AS own FROM cost WHERE i = j), f AS (SELECT user_id, CAST(sum(own) % 2 < 1 AS INTEGER) AS label, avg(own) AS a, count(*) AS b FROM own GROUP BY user_id),
ra AS (SELECT label, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS r FROM f), rb AS (SELECT label, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS r FROM f),
n AS (SELECT sum(label) AS p, count(*) AS n FROM f),
s AS (SELECT ((SELECT sum(r) FROM ra WHERE label = 1) - p * (p + 1) / 2) / (p * (n - p)) AS auc_a, ((SELECT sum(r) FROM rb WHERE label = 1) - p * (p + 1) / 2) / (p * (n - p)) AS auc_b FROM n)
SELECT round(auc_a, 6) AS auc_a, round(auc_b, 6) AS auc_b, round(CASE WHEN auc_a > 0.5 THEN 100 * (auc_b - auc_a) / auc_a END, 6) AS lift_pct FROM s""",
}

ORACLE_SQL |= {
    "audit_observations": _GARP + """
, level AS (SELECT user_id, i, max(e / own) FILTER (own >= e - 1e-8) AS x FROM edges GROUP BY user_id, i)
SELECT user_id, i, round(CASE WHEN is_garp THEN 1.0 ELSE least(1.0, coalesce(x, 0)) END, 6) AS efficiency, CASE WHEN is_garp THEN 1.0 ELSE least(1.0, coalesce(x, 0)) END < 0.9 AS is_low FROM level JOIN garp USING (user_id)""",
    "technical_efficiency": _FIRMS + """
, f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS i FROM firms),
r AS (SELECT a.user_id, a.i, least(CASE WHEN a.o0 > 0 THEN b.o0 / a.o0 ELSE 'inf'::DOUBLE END, CASE WHEN a.o1 > 0 THEN b.o1 / a.o1 ELSE 'inf'::DOUBLE END) AS ratio FROM f a JOIN f b ON a.user_id = b.user_id AND b.q0 <= a.q0 + 1e-12 AND b.q1 <= a.q1 + 1e-12)
SELECT user_id, CAST(i AS INTEGER) AS i, round(1 / greatest(1.0, max(ratio)), 6) AS efficiency FROM r GROUP BY user_id, i""",
    "ranking_pairs": _M + """
, c AS (SELECT user_id, choice, count(*) AS c FROM menus GROUP BY user_id, choice)
SELECT CAST(a.choice AS BIGINT) AS winner, CAST(b.choice AS BIGINT) AS loser, count(*) AS n FROM c a JOIN c b ON a.user_id = b.user_id AND (a.c > b.c OR (a.c = b.c AND a.choice < b.choice)) GROUP BY a.choice, b.choice""",
}

_STEPS = _GOODS + """
, spent AS (SELECT user_id, i, sum(price * quantity) AS m FROM goods GROUP BY user_id, i)
"""
ORACLE_SQL |= {
    "price_effects": _B + _STEPS + """
, d AS (SELECT user_id, g, quantity AS q, price - lag(price) OVER w AS dp, lag(price) OVER w AS p0, quantity - lag(quantity) OVER w AS dq, m - lag(m) OVER w AS dm FROM goods JOIN spent USING (user_id, i) WINDOW w AS (PARTITION BY user_id, g ORDER BY i)),
e AS (SELECT user_id, g, count(*) AS n, median(dq / dp) AS total, -coalesce(median(CASE WHEN abs(dm) > 1e-10 THEN dq / dm END), 0) * avg(q) AS income FROM d WHERE abs(dp / p0) >= 0.05 GROUP BY user_id, g)
SELECT user_id, g, n, round(total, 6) AS total, round(income, 6) AS income, round(total - income, 6) AS substitution FROM e""",
    "population_welfare": _B + _GOODS + """
, halves AS (SELECT user_id, g, i < n // 2 AS base, avg(price) AS p, avg(quantity) AS q FROM goods JOIN sizes USING (user_id) WHERE n >= 2 GROUP BY user_id, g, i < n // 2),
w AS (SELECT a.user_id, sum(b.p * a.q) - sum(b.p * b.q) AS cv, sum(a.p * b.q) - sum(a.p * a.q) AS ev, -sum((b.p - a.p) * a.q) AS surplus FROM halves a JOIN halves b ON a.user_id = b.user_id AND a.g = b.g AND a.base AND NOT b.base GROUP BY a.user_id)
SELECT count(*) AS n_users, round(avg(CAST(surplus > 0 AS INTEGER)), 6) AS share_better, round(avg(CAST(surplus < 0 AS INTEGER)), 6) AS share_worse, round(avg(cv), 6) AS mean_cv, round(avg(ev), 6) AS mean_ev FROM w""",
    "additive_consistency": _B + _STEPS + """
, o AS (SELECT * FROM goods JOIN spent USING (user_id, i)),
v AS (SELECT a.user_id, count(*) FILTER (abs(a.quantity - b.quantity) > 0.1 * greatest(a.quantity, b.quantity)) AS bad, count(*) AS n_pairs FROM o a JOIN o b ON a.user_id = b.user_id AND a.g = b.g AND a.i < b.i AND abs(a.price - b.price) <= 0.05 * a.price AND abs(a.m - b.m) <= 0.05 * a.m GROUP BY a.user_id)
SELECT s.user_id, coalesce(bad, 0) AS n_violations, coalesce(n_pairs, 0) AS n_pairs FROM sizes s LEFT JOIN v USING (user_id)""",
    "imputed_prices": _B + """
, cell AS (SELECT t, item, median(unit) AS cell, count(unit) AS n FROM purchases GROUP BY t, item), any_ AS (SELECT item, median(unit) AS a FROM purchases GROUP BY item)
SELECT user_id, t, item, round(coalesce(CASE WHEN n >= 3 THEN cell END, a), 6) AS price FROM (SELECT DISTINCT user_id, t, item FROM purchases) LEFT JOIN cell USING (t, item) LEFT JOIN any_ USING (item)""",
    "choice_axioms": _F + _PAIRS + """
, r AS (SELECT a.user_id, count(*) FILTER (b.p - a.p > 0.01) = 0 AS is_regular FROM freq a JOIN freq b ON a.item = b.item AND len(a.menu) < len(b.menu) AND list_has_all(b.menu, a.menu) GROUP BY a.user_id),
i AS (SELECT user_id, count(*) FILTER (n_menus > 1 AND cv > 0.1) = 0 AS is_iia FROM odds GROUP BY user_id)
SELECT user_id, coalesce(is_regular, TRUE) AS is_regular, is_iia, coalesce(is_regular, TRUE) AND is_iia AS is_logit FROM i LEFT JOIN r USING (user_id)""",
    "choice_attention": _F + """
, s AS (SELECT user_id, item, least(1.0, 2 * sum(n) / sum(total)) AS a FROM freq GROUP BY user_id, item)
SELECT user_id, CAST(item AS BIGINT) AS item, round(a, 6) AS attention, round(greatest(0.0, a - 0.2), 6) AS low, round(least(1.0, a + 0.2), 6) AS high FROM s""",
    "budget_ccei": _GARP + """
, levels AS (
  SELECT DISTINCT user_id, e / own AS level FROM edges JOIN garp USING (user_id) WHERE NOT is_garp AND own > 0 AND e > 0 AND e / own < 1
), at_level AS (
  SELECT l.user_id, l.level, x.i, x.j, l.level * x.own >= x.e - 1e-10 AS r, l.level * x.own > x.e + 1e-10 AS p FROM levels l JOIN edges x USING (user_id)
), level_steps AS (SELECT user_id, level, i, j FROM at_level WHERE r),
level_reach(user_id, level, i, j) AS (
  SELECT user_id, level, i, j FROM level_steps
  UNION
  SELECT a.user_id, a.level, a.i, b.j FROM level_reach a JOIN level_steps b ON b.user_id = a.user_id AND b.level = a.level AND b.i = a.j
), broken AS (
  SELECT DISTINCT x.user_id, x.level FROM at_level x JOIN level_reach b ON b.user_id = x.user_id AND b.level = x.level AND b.i = x.j AND b.j = x.i WHERE x.p
), best AS (
  SELECT user_id, max(level) AS level FROM levels ANTI JOIN broken USING (user_id, level) GROUP BY user_id
)
SELECT g.user_id, g.is_garp, round(CASE WHEN g.is_garp THEN 1.0 ELSE coalesce(b.level, 0.0) END, 6) AS ccei FROM garp g LEFT JOIN best b USING (user_id)""",
    "budget_afriat_success": _GARP + "SELECT user_id, is_garp AS utility_success FROM garp",
    "budget_pump_pairs": _GARP + """
SELECT s.user_id, round(greatest(0.0, coalesce(max(((a.own - a.e) / a.own + (b.own - b.e) / b.own) / 2), 0.0)), 6) AS mpi_pairs
FROM sizes s LEFT JOIN edges a ON a.user_id = s.user_id AND a.r AND a.i < a.j LEFT JOIN edges b ON b.user_id = a.user_id AND b.i = a.j AND b.j = a.i AND b.r GROUP BY s.user_id""",
    "choice_compromises": _F + """
, a AS (SELECT label AS item, arg_min(embedding, vec_id)[1] AS a FROM embeddings GROUP BY label),
three AS (SELECT f.user_id, f.menu, f.item, f.p, row_number() OVER (PARTITION BY f.menu ORDER BY a.a, f.item) AS k, count(*) OVER (PARTITION BY f.menu) AS n FROM freq f JOIN a USING (item) WHERE len(f.menu) = 3)
SELECT t.user_id, array_to_string(t.menu, ',') AS menu, CAST(t.item AS BIGINT) AS item, round(max(t.p) - avg(f.p), 6) AS gain, max(t.p) - avg(f.p) > 0.05 AS is_compromise
FROM three t JOIN freq f ON f.item = t.item AND len(f.menu) = 2 AND list_has_all(t.menu, f.menu) WHERE t.k = 2 GROUP BY t.user_id, t.menu, t.item""",
}
