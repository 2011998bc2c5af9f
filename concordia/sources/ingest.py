"""From tables of observations to one row for each user.

A budget row is (user_id, obs: array of (t, p, q)); a menu row is (user_id, obs: array of
(t, menu, choice)).  Everything is grouped once, by user, and stays in the engine.
"""

from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordia import errors

#: Former names of roles.
ALIASES = {"price_col": "cost_col", "qty_col": "action_col", "price_cols": "cost_cols", "qty_cols": "action_cols"}


def detect_layout(*, item_col=None, cost_col=None, action_col=None, time_col=None, cost_cols=None, action_cols=None, menu_col=None, choice_col=None) -> str:
    """``long``, ``wide`` or ``menu`` from the roles that are named."""
    long = any(x is not None for x in (item_col, cost_col, action_col))
    wide = any(x is not None for x in (cost_cols, action_cols))
    menu = any(x is not None for x in (menu_col, choice_col))
    named = [name for name, on in (("long", long), ("wide", wide), ("menu", menu)) if on]
    if len(named) > 1:
        raise errors.FormatError(f"roles of several layouts are named: {', '.join(named)}")
    if not named:
        raise errors.FormatError("no layout is named: give item_col, cost_col and action_col (long), cost_cols and action_cols (wide), or menu_col and choice_col (menu)")
    if wide and (not cost_cols or not action_cols or len(cost_cols) != len(action_cols)):
        raise errors.FormatError("the wide layout needs cost_cols and action_cols of one length")
    if long and item_col is None:
        raise errors.FormatError("the long layout needs item_col")
    return named[0]


def require(df: DataFrame, columns: list[str]) -> None:
    """Raise for columns that aren't there, with the most similar names."""
    for name in columns:
        if name not in df.columns:
            near = difflib.get_close_matches(name, df.columns, 3, 0.5)
            raise errors.ColumnError(f"no column {name!r}" + (f". Similar: {', '.join(near)}" if near else f". Columns: {', '.join(df.columns)}"))


def require_numbers(df: DataFrame, columns: list[str]) -> None:
    for name in columns:
        if not isinstance(df.schema[name].dataType, T.NumericType):
            raise errors.ColumnError(f"column {name!r} isn't numeric but {df.schema[name].dataType.simpleString()}")


def is_bad(name: str) -> Column:
    value = F.col(name).cast("double")
    return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))


def clean(df: DataFrame, columns: list[str], policy: str = "raise", check_range: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """Rows with missing or infinite numbers: ``raise`` an error, ``drop`` them, or ``warn`` and drop.

    ``raise`` and ``warn`` look at the data once, together with the ranges of prices and quantities.
    """
    if policy not in ("raise", "warn", "drop"):
        raise errors.FormatError(f"the policy is 'raise', 'warn' or 'drop', not {policy!r}")
    bad = F.lit(False)
    for name in columns:
        bad = bad | is_bad(name)
    if policy != "drop":
        low, negative = F.lit(False), F.lit(False)
        for name in (check_range or ([], []))[0]:
            low = low | (F.col(name) <= 0)
        for name in (check_range or ([], []))[1]:
            negative = negative | (F.col(name) < 0)
        n = df.agg(*[F.coalesce(F.sum((F.coalesce(x, F.lit(False)) & ~y).cast("long")), F.lit(0)).alias(k) for k, x, y in (("bad", bad, F.lit(False)), ("low", low, bad), ("negative", negative, bad))]).first()
        if n["bad"] and policy == "raise":
            raise errors.NonFiniteError(f"{n['bad']} rows have missing, NaN or infinite values in {', '.join(columns)}; drop them with the policy 'drop'")
        if n["bad"]:
            import warnings

            warnings.warn(f"{n['bad']} rows with missing, NaN or infinite values are dropped", stacklevel=3)
        if n["low"]:
            raise errors.ValueRangeError(f"{n['low']} rows have prices that aren't positive")
        if n["negative"]:
            raise errors.ValueRangeError(f"{n['negative']} rows have negative quantities")
    return df.filter(~bad)


def _in_order(*fields: Column) -> Column:
    """Observations of a user by time."""
    return F.array_sort(F.collect_list(F.struct(*fields)))


def from_wide(df: DataFrame, *, user_col: str, cost_cols: list[str], action_cols: list[str], time_col: str | None = None, min_obs: int = 1) -> DataFrame:
    """Budget rows from one row for each observation, with a price and a quantity column for each good.

    Without ``time_col`` observations stand in the order of the rows as they are read.
    """
    numbers = lambda names: F.array(*[F.col(c).cast("double") for c in names])
    time = F.col(time_col) if time_col else F.monotonically_increasing_id()
    rows = df.select(F.col(user_col).cast("string").alias("user_id"), time.alias("t"), numbers(cost_cols).alias("p"), numbers(action_cols).alias("q"))
    return rows.groupBy("user_id").agg(_in_order(F.col("t"), F.col("p"), F.col("q")).alias("obs")).filter(F.size("obs") >= min_obs)


def from_long(df: DataFrame, *, user_col: str, item_col: str, cost_col: str, action_col: str, time_col: str, missing: str = "raise", min_obs: int = 1, min_items: int = 1) -> DataFrame:
    """Budget rows from one row for each user, time and item; each user has a column for each item of their own.

    ``missing``: where a user has no row for an item at some time, ``raise`` an error or put ``zero``.
    """
    rows = df.select(
        F.col(user_col).cast("string").alias("user_id"), F.col(time_col).alias("t"), F.col(item_col).cast("string").alias("item"), F.col(cost_col).cast("double").alias("price"), F.col(action_col).cast("double").alias("quantity")
    )
    times = rows.groupBy("user_id", "t").agg(F.collect_list(F.struct("item", F.struct("price", "quantity").alias("v"))).alias("cells"))
    users = times.groupBy("user_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("cells", lambda c: c["item"]))))).alias("items"),
        F.max(F.size("cells") - F.size(F.array_distinct(F.transform("cells", lambda c: c["item"])))).alias("repeats"),
        F.min(F.size("cells")).alias("fewest"),
        F.array_sort(F.collect_list(F.struct("t", "cells"))).alias("times"),
    )
    if missing == "raise":
        worst = users.agg(F.max("repeats").alias("repeats"), F.max(F.size("items") - F.col("fewest")).alias("gaps")).first()
        if worst["repeats"]:
            raise errors.DuplicateError("several rows have one user, time and item")
        if worst["gaps"]:
            raise errors.NonFiniteError("some users have no price for an item at some time")
    elif missing != "zero":
        raise errors.FormatError(f"missing is 'raise' or 'zero', not {missing!r}")
    def dense(cells: Column, field: str) -> Column:
        # of repeated cells the last counts, as in a table that is filled row by row
        values = F.map_from_entries(F.transform(cells, lambda c: F.struct(c["item"], c["v"][field])))
        return F.transform("items", lambda i: F.coalesce(F.element_at(values, i), F.lit(0.0)))

    obs = F.transform("times", lambda x: F.struct(x["t"].alias("t"), dense(x["cells"], "price").alias("p"), dense(x["cells"], "quantity").alias("q")))
    return users.filter((F.size("times") >= min_obs) & (F.size("items") >= min_items)).select("user_id", obs.alias("obs"))


def from_menus(df: DataFrame, *, user_col: str, menu_col: str, choice_col: str, time_col: str | None = None, check: bool = True) -> DataFrame:
    """Menu rows from one row for each choice; menus are sets."""
    time = F.col(time_col) if time_col else F.monotonically_increasing_id()
    rows = df.select(F.col(user_col).cast("string").alias("user_id"), time.alias("t"), F.array_sort(F.array_distinct(F.col(menu_col).cast("array<int>"))).alias("menu"), F.col(choice_col).cast("int").alias("choice"))
    if check:
        outside = F.coalesce(~F.array_contains("menu", F.col("choice")), F.lit(True)) | (F.coalesce(F.array_min("menu"), F.lit(-1)) < 0)
        if (n := rows.agg(F.coalesce(F.sum(outside.cast("long")), F.lit(0)).alias("n")).first()["n"]):
            raise errors.ValueRangeError(f"{n} choices are outside their menu, or menus are empty or have negative items")
    return rows.groupBy("user_id").agg(_in_order(F.col("t"), F.col("menu"), F.col("choice")).alias("obs"))


def from_frequencies(df: DataFrame, *, user_col: str, menu_col: str, item_col: str, count_col: str) -> DataFrame:
    """(user_id, obs: array of (menu, counts)) from one row for each user, menu and chosen item; counts follow the menu's order."""
    rows = df.select(F.col(user_col).cast("string").alias("user_id"), F.array_sort(F.array_distinct(F.col(menu_col).cast("array<int>"))).alias("menu"), F.col(item_col).cast("int").alias("item"), F.col(count_col).cast("long").alias("n"))
    cells = rows.groupBy("user_id", "menu", "item").agg(F.sum("n").alias("n")).groupBy("user_id", "menu").agg(F.map_from_entries(F.collect_list(F.struct("item", "n"))).alias("by_item"))
    cells = cells.select("user_id", "menu", F.transform("menu", lambda i: F.coalesce(F.element_at("by_item", i), F.lit(0)).cast("long")).alias("counts"))
    return cells.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("menu", "counts"))).alias("obs"))
