"""Reports, pictures and the evaluation of features."""

import xml.etree.ElementTree as ET

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from concordia import checked_reports, report
from concordia.operators import charts
from concordia.plans import evaluate, structure
from concordia.sources import generate

from test_operators import FOLDER, TABLES, rows_of


@pytest.fixture(scope="module")
def db():
    with duckdb.connect() as connection:
        for t in TABLES:
            connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        yield connection


@pytest.mark.parametrize("name", sorted(checked_reports.ORACLE_SQL))
def test_report_query_equals_sql(spark, db, name):
    mine = checked_reports.QUERIES[name](spark, FOLDER).toPandas()
    theirs = db.execute(checked_reports.ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows_of(mine) == rows_of(theirs)


def test_texts_and_html():
    audit = {"user_id": "u<1>", "is_garp": True, "integrity": 0.97, "confusion": 0.01}
    assert report.score(audit) == pytest.approx(0.98) and report.score({"efficiency": 0.5}) == 0.5
    assert "score  0.9800" in report.audit_text(audit) and report.advice(audit) in report.audit_text(audit)
    assert len({report.advice({"is_garp": False, "integrity": x}) for x in (0.9, 0.8, 0.5)}) == 3
    page = report.result_html(audit, "A & B")
    assert "u&lt;1&gt;" in page and "A &amp; B" in page and page.count("<tr>") == 4
    assert report.table_html([audit, {"other": None}]).count("<td>") == 10
    assert report.summary_html({"GARP": True, "WARP": False}, {"ccei": 1.3}).count("<li>") == 3


def test_pictures(spark):
    rows = generate.budgets(spark, 1, n_obs=5, n_goods=3)
    lines = report.small(charts.budget_lines(rows))
    graph = report.graph_dict(structure.graph_json(rows).first()["graph"])
    links = [(x["source"], x["target"]) for x in graph["links"]]
    drawn = [
        report.budgets_svg(lines), report.bars_svg([{"a": 1, "n": 3}, {"a": 0, "n": 1}], "a", "n", "t<"), report.line_svg([{"a": 1, "n": 3}], "a", "n"), report.line_svg([], "a", "n"),
        report.heat_svg([{"i": 0, "j": 1, "n": 3}], "i", "j", "n"), report.ranges_svg([{"item": 1, "low": 0.1, "high": 0.4}], "item", "low", "high"), report.graph_svg([n["id"] for n in graph["nodes"]], links),
    ]
    for picture in drawn:
        assert ET.fromstring(picture).tag.endswith("svg")
    assert drawn[0].count("<circle") == 5 and drawn[6].count("<line") == len(links) and len(graph["nodes"]) == 5
    with pytest.raises(ValueError, match="rows"):
        report.small(spark.range(50), 10)


def test_areas_by_pairs():
    chance = np.random.default_rng(1)
    bins, labels = chance.integers(0, evaluate.BINS, 300), chance.integers(0, 2, 300)
    positive, negative = (np.bincount(bins[labels == y], minlength=evaluate.BINS) for y in (1, 0))
    pairs = [(a > b) + (a == b) / 2 for a in bins[labels == 1] for b in bins[labels == 0]]
    assert evaluate.area(positive, negative) == pytest.approx(np.mean(pairs))
    assert evaluate.average_precision(np.array([0, 0, 4]), np.array([3, 2, 0])) == 1
    assert evaluate.average_precision(np.zeros(3), np.ones(3)) == 0 and evaluate.area(np.zeros(3), np.ones(3)) == 0.5


def test_shuffled_values_stay_together(spark):
    rows = spark.range(500).select(F.col("id").cast("string").alias("user_id"), "id", (F.col("id") * 2).alias("b"), (F.col("id") * 3).alias("c"))
    found = evaluate.shuffled(rows, ["b", "c"]).toPandas()
    assert sorted(found["b"]) == [2 * k for k in range(500)] and (found["b"] * 3 == found["c"] * 2).all()
    assert (found["b"] != 2 * found["id"]).mean() > 0.9


def test_three_way_finds_what_scores_add(spark):
    chance = np.random.default_rng(5)
    x, y, z = chance.normal(size=(3, 1200))
    label = (x + 2 * y + 0.3 * chance.normal(size=1200) > 0).astype(int)
    table = lambda columns: spark.createDataFrame([(str(k), *map(float, r)) for k, r in enumerate(zip(*columns.values(), strict=True))], ["user_id", *columns])
    found = evaluate.three_way(table({"x": x, "z": z}), table({"y": y}), table({"label": label}), rounds=5, depth=3, repeats=2, draws=200)
    assert found["n_test"] + found["n_train"] == 1200 and 150 < found["n_test"] < 330
    assert found["auc_combined_test"] > found["auc_base_test"] + 0.1 and found["auc_combined_train"] >= found["auc_combined_test"] - 0.05
    assert found["lift_pct"] > 5 and found["low"] <= found["lift_pct"] <= found["high"] and found["p_value"] < 0.05
    assert found["importance_scores"] > found["importance_base"] > -0.05
    assert found["feature_importance"]["y"] > found["feature_importance"].get("z", 0)
