"""Queries of the tables behind reports and pictures, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia import checked, report
from concordia import registry as base
from concordia.operators import budget, charts, stochastic
from concordia.panel import Auditor, Encoder, Panel
from concordia.plans import menus, score, structure
from concordia.sources import market

_B, _M, _GARP = base._B, base._M, base._GARP


def _related(rows: DataFrame) -> DataFrame:
    return structure.graph_edges(rows).select("user_id", "i", "j", "own", "e", "r", "p")


def _severity(rows: DataFrame) -> DataFrame:
    return charts.histogram(charts.severities(_related(rows)), "severity", 10)


def _sensitivity(rows: DataFrame) -> DataFrame:
    """How many points each user has, and the first one."""
    return structure.sensitivity(rows).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_points"), F.max(F.when(F.col("removed") == 0, F.col("ccei"))).alias("first"))


def _graphs(rows: DataFrame) -> DataFrame:
    """What is read back from the graphs' text."""
    links = F.from_json(F.get_json_object("graph", "$.links"), "array<struct<source:int,target:int,weight:double,strict:boolean>>")
    found = structure.graph_json(rows).select("user_id", F.json_array_length(F.get_json_object("graph", "$.nodes")).cast("long").alias("n_nodes"), links.alias("l"))
    return found.select("user_id", "n_nodes", F.size("l").cast("long").alias("n_links"), F.size(F.filter("l", lambda x: x["strict"])).cast("long").alias("n_strict"), F.aggregate("l", F.lit(0.0), lambda s, x: s + x["weight"]).alias("weight"))


def _labels(m: DataFrame) -> DataFrame:
    labels = m.sparkSession.createDataFrame([(k, f"label {k}") for k in range(5)], "item int, label string")
    return charts.labelled(m, labels).select("user_id", "t", F.concat_ws(",", "menu_labels").alias("menu"), F.col("choice_label").alias("choice"))


def _reports(rows: DataFrame) -> DataFrame:
    """Lines of the text and rows of the table that report the five most inconsistent users."""
    found = report.small(base.panel.most_inconsistent(base.garp(rows), 5))
    made = [(r["user_id"], len(report.text(r).split("\n")), report.result_html(r).count("<tr>"), report.table_html(found).count("<tr>")) for r in found]
    return rows.sparkSession.createDataFrame(made, "user_id string, n_lines long, n_rows long, n_table_rows long")


def _features(rows: DataFrame) -> DataFrame:
    f = budget.features(rows).select("user_id", "total_spend", "mean_spend", "mean_hhi")
    s = score.score_budget(rows, ("garp", "ccei")).select("user_id", "ccei", "n_violations", "max_scc")
    return f.join(s, "user_id")


def _correlations(rows: DataFrame) -> DataFrame:
    f = _features(rows)
    return charts.correlations(f, ["total_spend", "mean_spend", "mean_hhi"], ["ccei", "n_violations", "max_scc"]).union(charts.correlations(f, ["ccei", "n_violations", "max_scc"]))


def _considered(m: DataFrame) -> DataFrame:
    return charts.sizes(menus.consideration(base._obs(m)), "considered")


QUERIES: dict[str, base.Query] = {
    "chart_efficiency": base._market(lambda r: charts.histogram(score.score_budget(r, ("garp", "ccei")), "ccei")),
    "chart_efficiency_over_time": base._market(lambda r: charts.over_time(Panel(r).windows(4).score(("garp", "ccei")), "ccei")),
    "chart_pump_over_time": base._market(lambda r: charts.over_time(Panel(r).windows(4).score(("garp", "mpi")), "mpi")),
    "chart_relations": base._market(lambda r: charts.relations(_related(r))),
    "chart_severity": base._market(_severity),
    "chart_sensitivity": base._market(_sensitivity),
    "chart_intersections": base._market(charts.intersections),
    "chart_budget_lines": base._market(charts.budget_lines),
    "chart_positions": base._menus(charts.positions),
    "chart_consideration": base._menus(_considered),
    "chart_attention": base._menus(charts.attention),
    "chart_attention_bounds": base._frequencies(lambda f: stochastic.attention(f).select("user_id", F.col("item").cast("long").alias("item"), "low", "high")),
    "graph_texts": base._market(_graphs),
    "menu_labels": base._menus(_labels),
    "report_rows": base._market(_reports),
    "audit_scores": base._market(lambda r: Auditor().scores(Panel(r))),
    "encoder_status": base._market(lambda r: Encoder(("garp",)).status(Panel(r))),
    "describe_budgets": base._market(charts.describe_budgets),
    "describe_menus": base._menus(charts.describe_menus),
    "feature_correlations": base._market(_correlations),
    "risk_choice_summary": lambda spark, d: base.rounded(market.lotteries(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_choices"), F.sum(F.col("chose_risky").cast("long")).alias("n_risky"), F.round(F.avg("safe"), 2).alias("mean_safe"), F.max(F.array_max("outcomes")).alias("largest"))),
}

_BINS = "SELECT CAST(greatest(0, least({bins} - 1, floor({x} * {bins}))) AS BIGINT) AS bin, count(*) AS n FROM ({source}) GROUP BY 1"
_WINDOWS = _B + """
, w_edges AS (SELECT user_id || '__' || (i // 4) AS user_id, i, j, own, e, own >= e - 1e-10 AS r FROM edges WHERE i // 4 = j // 4),
w_obs AS (SELECT user_id || '__' || (i // 4) AS user_id, i FROM obs), w_users AS (SELECT user_id FROM w_obs GROUP BY user_id HAVING count(*) >= 2), w_sizes AS (SELECT user_id, count(*) AS n FROM w_obs JOIN w_users USING (user_id) GROUP BY user_id)""" + checked._CCEI.replace("{n}", "w")
_FEATURES = f"""
(SELECT f.user_id, total_spend, mean_spend, mean_hhi, ccei, n_violations, max_scc FROM ({base.ORACLE_SQL["spending_features"]}) f JOIN ({checked.ORACLE_SQL["analyze_wide"]}) c USING (user_id) JOIN ({base.ORACLE_SQL["budget_garp"].replace("SELECT * FROM garp", "SELECT user_id, max_scc FROM garp")}) g USING (user_id))"""
_PAIRS = [(a, b) for a in ("total_spend", "mean_spend", "mean_hhi") for b in ("ccei", "n_violations", "max_scc")] + [("ccei", "n_violations"), ("ccei", "max_scc"), ("n_violations", "max_scc")]


def _quartiles(column: str, name: str) -> str:
    return f"round(CAST(median({column}) AS DOUBLE), 6) AS {name}_median, round(quantile_cont({column}, 0.25), 6) AS {name}_p25, round(quantile_cont({column}, 0.75), 6) AS {name}_p75, CAST(min({column}) AS DOUBLE) AS {name}_min, CAST(max({column}) AS DOUBLE) AS {name}_max"


ORACLE_SQL: dict[str, str] = {
    "chart_efficiency": 'SELECT bin, round(bin * 0.05, 6) AS "from", n FROM (' + _BINS.format(bins=20, x="ccei", source=base.ORACLE_SQL["budget_ccei"]) + ")",
    "chart_efficiency_over_time": _WINDOWS + "SELECT CAST(split_part(user_id, '__', 2) AS BIGINT) AS \"window\", count(*) AS n_users, round(avg(ccei), 6) AS mean, round(min(ccei), 6) AS least FROM w_ccei GROUP BY 1",
    "chart_pump_over_time": _WINDOWS + checked._WALKS.replace("FROM obs", "FROM w_obs JOIN w_users USING (user_id)").replace("JOIN edges e", "JOIN w_edges e").replace("JOIN sizes s", "JOIN w_sizes s").replace("FROM garp g", "FROM w_ccei g")
    + "SELECT CAST(split_part(user_id, '__', 2) AS BIGINT) AS \"window\", count(*) AS n_users, round(avg(mpi), 6) AS mean, round(min(mpi), 6) AS least FROM pump GROUP BY 1",
    "chart_relations": _GARP + "SELECT i, j, count(*) FILTER (e.r) AS n_weak, count(*) FILTER (e.p) AS n_strict, count(*) AS n_reached FROM edges e JOIN reach USING (user_id, i, j) GROUP BY i, j",
    "chart_severity": 'SELECT bin, round(bin * 0.1, 6) AS "from", n FROM (' + _BINS.format(bins=10, x="s", source=_GARP + "SELECT (e.own - e.e) / e.own AS s FROM edges e JOIN reach b ON b.user_id = e.user_id AND b.i = e.j AND b.j = e.i WHERE e.p") + ")",
    "chart_sensitivity": "SELECT user_id, greatest(0, least(greatest(1, n // 5), n - 2)) + 1 AS n_points, ccei AS first FROM (" + base.ORACLE_SQL["budget_ccei"].replace("AS ccei FROM garp g", "AS ccei, z.n FROM garp g JOIN sizes z USING (user_id)") + ")",
    "chart_intersections": _B + base._GOODS + """
, m AS (SELECT user_id, i, e AS m FROM cost WHERE i = j),
x AS (SELECT a.user_id, a.i, b.i AS j, max(a.price * mb.m - b.price * ma.m) > 1e-9 AND min(a.price * mb.m - b.price * ma.m) < -1e-9 AS crossing
  FROM goods a JOIN goods b ON b.user_id = a.user_id AND b.g = a.g AND a.i < b.i JOIN m ma ON ma.user_id = a.user_id AND ma.i = a.i JOIN m mb ON mb.user_id = a.user_id AND mb.i = b.i GROUP BY a.user_id, a.i, b.i),
w AS (SELECT a.user_id, count(*) AS n FROM edges a JOIN edges b ON a.user_id = b.user_id AND a.i = b.j AND a.j = b.i AND a.i < a.j WHERE (a.r AND b.p) OR (a.p AND b.r) GROUP BY a.user_id)
SELECT x.user_id, count(*) AS n_pairs, count(*) FILTER (crossing) AS n_crossing, coalesce(any_value(w.n), 0) AS n_contradicting FROM x LEFT JOIN w USING (user_id) GROUP BY x.user_id""",
    "chart_budget_lines": _B + base._GOODS + """
SELECT a.user_id, a.i, round(c.e / a.price, 6) AS most_first, round(c.e / b.price, 6) AS most_second, a.quantity AS first, b.quantity AS second
FROM goods a JOIN goods b ON b.user_id = a.user_id AND b.i = a.i AND a.g = 0 AND b.g = 1 JOIN cost c ON c.user_id = a.user_id AND c.i = a.i AND c.j = a.i""",
    "chart_positions": _M + """
, k AS (SELECT unnest(range(1, len(menu) + 1)) AS place, menu, choice FROM menus)
SELECT place, count(*) AS shown, count(*) FILTER (menu[place] = choice) AS chosen, round(avg(CAST(menu[place] = choice AS INTEGER)), 6) AS share FROM k GROUP BY place""",
    "chart_consideration": "SELECT len(string_split(considered, ',')) AS size, count(*) AS n FROM (" + checked.ORACLE_SQL["menu_consideration"] + ") GROUP BY 1",
    "chart_attention": _M + "SELECT CAST(s.item AS BIGINT) AS item, len(m.menu) AS size, count(*) AS shown, count(*) FILTER (s.item = s.choice) AS chosen, round(avg(CAST(s.item = s.choice AS INTEGER)), 6) AS share FROM shown s JOIN menus m ON m.user_id = s.user_id AND m.t = s.t GROUP BY 1, 2",
    "chart_attention_bounds": "SELECT user_id, item, low, high FROM (" + base.ORACLE_SQL["choice_attention"] + ")",
    "graph_texts": _B + "SELECT s.user_id, s.n AS n_nodes, count(e.i) AS n_links, count(e.i) FILTER (e.p) AS n_strict, round(coalesce(sum(round(ln(own) - ln(e), 9)), 0), 6) + 0.0 AS weight FROM sizes s LEFT JOIN (SELECT * FROM edges WHERE r) e USING (user_id) GROUP BY s.user_id, s.n",
    "menu_labels": _M + "SELECT user_id, t, array_to_string(list_transform(menu, lambda i: CASE WHEN i < 5 THEN 'label ' || i ELSE 'item_' || i END), ',') AS menu, CASE WHEN choice < 5 THEN 'label ' || choice ELSE 'item_' || choice END AS choice FROM menus",
    "report_rows": base.ORACLE_SQL["panel_most_inconsistent"].replace("SELECT user_id, n_violations, max_scc", "SELECT user_id, CAST(5 AS BIGINT) AS n_lines, CAST(3 AS BIGINT) AS n_rows, CAST(6 AS BIGINT) AS n_table_rows"),
    "audit_scores": "SELECT user_id, round((i + 1 - least(1.0, c)) / 2, 6) AS score FROM (" + checked.ORACLE_SQL["budget_scores_audit"].replace("round(CASE WHEN g.is_garp THEN 1.0 ELSE coalesce(b.level, 0.0) END, 6) AS integrity, round(mpi, 6) AS confusion", "CASE WHEN g.is_garp THEN 1.0 ELSE coalesce(b.level, 0.0) END AS i, mpi AS c") + ")",
    "encoder_status": _GARP + "SELECT user_id, is_garp AS is_fitted, CASE WHEN is_garp THEN 'optimal' ELSE 'inconsistent' END AS status FROM garp",
    "describe_budgets": _B + base._GOODS + f"""
, o AS (SELECT user_id, i, sum(price * quantity) AS spend, count(*) FILTER (quantity > 0) AS active, count(*) AS goods, arg_max(g, quantity * 1000000 - g) AS best FROM goods GROUP BY user_id, i),
n AS (SELECT *, CAST(best = lag(best) OVER (PARTITION BY user_id ORDER BY i) AS INTEGER) AS again FROM o),
u AS (SELECT user_id, count(*) AS t, CASE WHEN count(*) > 1 AND avg(spend) > 0 THEN stddev_pop(spend) / avg(spend) END AS cv, count(DISTINCT best) / count(*) AS unlike FROM o GROUP BY user_id),
s AS (SELECT user_id, sum(q * q) / pow(sum(q), 2) AS hhi, max(q) / sum(q) AS top FROM (SELECT user_id, g, sum(quantity) AS q FROM goods GROUP BY user_id, g) GROUP BY user_id HAVING sum(q) > 0),
a AS (SELECT count(*) AS n_users, {_quartiles("t", "t")}, round(avg(CAST(t >= 10 AS INTEGER)), 6) AS share_t_ge_10, round(median(hhi), 6) AS hhi_median, round(median(top), 6) AS top_share_median, round(median(cv), 6) AS spend_cv_median, round(median(unlike), 6) AS unique_choice_median FROM u LEFT JOIN s USING (user_id)),
b AS (SELECT count(*) AS n_obs, max(goods) AS n_goods, round(median(spend), 6) AS spend_median, median(active) AS active_median, round(1 - sum(active) / sum(goods), 6) AS zero_share, round(avg(again), 6) AS repeat_rate FROM n)
SELECT a.*, b.* FROM a, b""",
    "describe_menus": _M + f"""
, m AS (SELECT user_id, t, choice, menu, len(menu) AS size, lag(choice) OVER w AS last, lag(menu) OVER w AS last_menu, row_number() OVER (PARTITION BY user_id, choice ORDER BY t) > 1 AS seen, count(*) OVER (PARTITION BY user_id) AS k FROM menus WINDOW w AS (PARTITION BY user_id ORDER BY t)),
c AS (SELECT user_id, choice, count(*) AS c FROM menus GROUP BY user_id, choice),
e AS (SELECT user_id, max(c) / sum(c) AS modal, count(*) / sum(c) AS unlike, (log2(sum(c)) - sum(c * log2(c)) / sum(c)) / log2(greatest(count(*), 2)) AS entropy FROM c GROUP BY user_id),
i AS (SELECT user_id, count(*) AS items FROM items GROUP BY user_id),
u AS (SELECT user_id, count(*) AS t, avg(CAST(choice <> last AS INTEGER)) AS switch FROM m GROUP BY user_id),
a AS (SELECT count(*) AS n_users, {_quartiles("t", "t")}, round(median(items), 6) AS items_median, round(median(modal), 6) AS modal_median, round(median(switch), 6) AS switch_median, round(median(entropy), 6) AS entropy_median, round(median(unlike), 6) AS unlike_median FROM u JOIN e USING (user_id) JOIN i USING (user_id)),
b AS (SELECT count(*) AS n_menus, {_quartiles("size", "size")}, round(avg(CASE WHEN last_menu IS NOT NULL THEN CAST(list_has_any(menu, last_menu) AS INTEGER) END), 6) AS overlap_rate, round(avg(CASE WHEN k > 1 THEN CAST(seen AS INTEGER) END), 6) AS repeat_rate, round(avg(CAST(size <= 1 AS INTEGER)), 6) AS singleton_share FROM m)
SELECT a.*, b.* FROM a, b""",
    "feature_correlations": "WITH features AS MATERIALIZED (SELECT * FROM " + _FEATURES + ") " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM features" for a, b in _PAIRS),
    "risk_choice_summary": """
WITH l AS (SELECT l_orderkey, max(l_extendedprice) AS high, avg(l_extendedprice) AS safe FROM lineitem GROUP BY l_orderkey)
SELECT CAST(o_custkey AS VARCHAR) AS user_id, count(*) AS n_choices, count(*) FILTER (o_orderpriority[1] >= '3') AS n_risky, round(avg(safe), 2) AS mean_safe, round(max(high), 6) AS largest FROM l JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey""",
}
