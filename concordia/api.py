"""Entry points: ``analyze`` for one call, ``Engine`` for a fixed set of metrics."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession

from concordia import errors
from concordia.plans import score
from concordia.schema import TOLERANCE
from concordia.sources import files, ingest


class Engine:
    """Scores budget, menu and frequency data under one set of metrics."""

    def __init__(self, metrics=("garp", "ccei"), tolerance: float = TOLERANCE) -> None:
        self.metrics = score.check_metrics(metrics)
        self.tolerance = tolerance

    def analyze_budgets(self, rows: DataFrame) -> DataFrame:
        """Scores of budget rows (user_id, obs: array of (t, p, q))."""
        return score.score_budget(rows, self.metrics, self.tolerance)

    def analyze_menus(self, rows: DataFrame, *, count: str = "items") -> DataFrame:
        return score.score_menu(rows, count=count)

    def analyze_frequencies(self, rows: DataFrame) -> DataFrame:
        return score.score_stochastic(rows)

    def analyze_arrays(self, spark: SparkSession, users, data_type: str = "budget") -> DataFrame:
        """Scores of in-memory users: pairs (prices, quantities), or triples (menus, choices, number of items)."""
        if data_type == "menu":
            data = [(str(k), [(i, sorted(set(map(int, m))), int(c)) for i, (m, c) in enumerate(zip(menus, choices, strict=True))]) for k, (menus, choices, *_) in enumerate(users)]
            return self.analyze_menus(spark.createDataFrame(data, "user_id string, obs array<struct<t:int,menu:array<int>,choice:int>>"))
        data = []
        for k, (prices, quantities) in enumerate(users):
            p, q = ([[float(x) for x in row] for row in m] for m in (prices, quantities))
            if [len(r) for r in p] != [len(r) for r in q] or not p:
                raise errors.DataError(f"user {k}: prices and quantities need one shape and an observation at least")
            if not all(0 < x < float("inf") for r in p for x in r) or not all(0 <= x < float("inf") for r in q for x in r):
                raise errors.ValueRangeError(f"user {k}: prices have to be positive and quantities not negative, and both finite")
            data.append((str(k), [(i, a, b) for i, (a, b) in enumerate(zip(p, q, strict=True))]))
        return self.analyze_budgets(spark.createDataFrame(data, "user_id string, obs array<struct<t:int,p:array<double>,q:array<double>>>"))

    def analyze_parquet(self, spark: SparkSession, path: str, *, output_path: str | None = None, user_col: str = "user_id", nan_policy: str = "drop", **roles) -> DataFrame | str:
        """Scores of a Parquet table; with ``output_path`` they are written there (zstd) and the path is returned."""
        found = analyze(spark.read.parquet(path), user_col=user_col, metrics=self.metrics, nan_policy=nan_policy, missing="zero", min_obs=2, tolerance=self.tolerance, **roles)
        return files.write(found, output_path) if output_path else found


def analyze(
    df: DataFrame | str, *, user_col: str = "user_id", item_col: str | None = None, cost_col: str | None = None, action_col: str | None = None, time_col: str | None = None, cost_cols: list[str] | None = None,
    action_cols: list[str] | None = None, menu_col: str | None = None, choice_col: str | None = None, metrics=None, nan_policy: str = "raise", missing: str = "raise", min_obs: int = 1, tolerance: float = TOLERANCE,
    spark: SparkSession | None = None, **aliases,
) -> DataFrame:
    """One row of scores for each user of a long, wide or menu table (or of a Parquet path)."""
    roles = {"item_col": item_col, "cost_col": cost_col, "action_col": action_col, "time_col": time_col, "cost_cols": cost_cols, "action_cols": action_cols, "menu_col": menu_col, "choice_col": choice_col}
    for name, value in aliases.items():
        if name not in ingest.ALIASES:
            raise TypeError(f"unknown argument {name!r}")
        roles[ingest.ALIASES[name]] = value
    if isinstance(df, str):
        df = (spark or SparkSession.active()).read.parquet(df)
    layout = ingest.detect_layout(**roles)
    names = {k: v for k, v in roles.items() if v is not None}
    if layout == "menu":
        names.setdefault("menu_col", "menu")
        names.setdefault("choice_col", "choice")
        ingest.require(df, [user_col, *names.values()])
        if metrics is not None:
            warnings.warn("metrics have no effect on menu data", stacklevel=2)
        return score.score_menu(ingest.from_menus(df, user_col=user_col, menu_col=names["menu_col"], choice_col=names["choice_col"], time_col=time_col))
    metrics = score.check_metrics(metrics or ("garp", "ccei", "mpi"))
    if layout == "wide":
        ingest.require(df, [user_col, *names["cost_cols"], *names["action_cols"], *([time_col] if time_col else [])])
        numbers = [*names["cost_cols"], *names["action_cols"]]
        ingest.require_numbers(df, numbers)
        df = ingest.clean(df, numbers, nan_policy, (names["cost_cols"], names["action_cols"]))
        rows = ingest.from_wide(df, user_col=user_col, cost_cols=names["cost_cols"], action_cols=names["action_cols"], time_col=time_col, min_obs=min_obs)
        return score.score_budget(rows, metrics, tolerance)
    cost, action, time = names.get("cost_col", "price"), names.get("action_col", "quantity"), names.get("time_col", "time")
    ingest.require(df, [user_col, names["item_col"], cost, action, time])
    ingest.require_numbers(df, [cost, action])
    df = ingest.clean(df, [cost, action], nan_policy, ([cost], [action]))
    rows = ingest.from_long(df, user_col=user_col, item_col=names["item_col"], cost_col=cost, action_col=action, time_col=time, missing=missing, min_obs=min_obs, min_items=min(2, min_obs))
    return score.score_budget(rows, metrics, tolerance)
