"""Menus and budgets from raw logs, one function for each way in which choices are recorded.

All are plain expressions; what they group by is a user, a day, a session or an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def until_feedback(seen: DataFrame, feedback: str = "purchase", smallest: int = 2) -> DataFrame:
    """Items gather until one gets feedback: that one is the choice, the gathered ones the menu; then it starts anew."""
    by_time = Window.partitionBy("user_id").orderBy("ts", "event_id")
    liked = (F.col("event_type") == feedback).cast("long")
    rows = seen.withColumn("liked", liked).withColumn("t", F.coalesce(F.sum("liked").over(by_time.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    groups = rows.groupBy("user_id", "t").agg(F.array_sort(F.collect_set("item")).alias("menu"), F.max(F.when(F.col("liked") == 1, F.col("item"))).alias("choice"))
    return groups.filter(F.col("choice").isNotNull() & (F.size("menu") >= smallest)).select("user_id", "t", "menu", "choice")


def best_of_day(seen: DataFrame, value: str = "value", smallest: int = 2) -> DataFrame:
    """The menu of a day is all that was seen, the choice what had the greatest value (the least item of ties)."""
    days = seen.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("t")).agg(F.array_sort(F.collect_set("item")).alias("menu"), F.max(F.struct(F.col(value), (-F.col("item")).alias("m"))).alias("top"))
    return days.filter(F.size("menu") >= smallest).select("user_id", "t", "menu", (-F.col("top.m")).alias("choice"))


def impressions(rows: DataFrame, column: str = "impressions") -> DataFrame:
    """Rows with menu and choice from strings like "12-0 7-1 3-0", where exactly one part ends in 1."""
    parts = F.transform(F.filter(F.split(F.trim(F.coalesce(F.col(column), F.lit(""))), r"\s+"), lambda x: x.rlike(r"^[0-9]+-[01]$")), lambda x: F.struct(F.split_part(x, F.lit("-"), F.lit(1)).cast("int").alias("item"), x.endswith("-1").alias("hit")))
    rows = rows.withColumn("__parts", parts)
    hits = F.filter("__parts", lambda p: p["hit"])
    return rows.filter(F.size(hits) == 1).withColumns({"menu": F.array_sort(F.array_distinct(F.transform("__parts", lambda p: p["item"]))), "choice": F.get(hits, F.lit(0))["item"]}).drop("__parts")


def slates(rows: DataFrame, slate: str = "slate", click: str = "click", first: int = 3, smallest: int = 2) -> DataFrame:
    """Rows with menu and choice from slates whose ids below ``first`` are padding; the click belongs to the menu."""
    kept = F.filter(slate, lambda x: x >= first)
    menu = F.array_sort(F.array_union(kept, F.array(click)))
    return rows.filter(F.col(click) >= first).withColumns({"menu": menu, "choice": F.col(click)}).filter(F.size("menu") >= smallest)


def pseudo_users(menus: DataFrame, by: str, size: int = 10, order: str = "t") -> DataFrame:
    """Menus of strangers as users of ``size`` menus each within the groups of ``by``, for logs without user ids."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    return menus.withColumn("user_id", F.concat_ws("-", F.col(by).cast("string"), F.floor(rank / size).cast("string")))


def from_earlier_orders(orders: DataFrame, back: int = 3, smallest: int = 2) -> DataFrame:
    """Reorders as choices: orders (user_id, order_id, seq, category, product), seq numbering the user's orders of a category from 1.

    Where exactly one product of an order was in the ``back`` orders of that category
    before, it is the choice, and the menu is all of those orders, and it.
    """
    baskets = orders.groupBy("user_id", "category", "seq").agg(F.array_sort(F.collect_set("product")).alias("basket"))
    by_seq = Window.partitionBy("user_id", "category").orderBy("seq").rowsBetween(-back, -1)
    known = baskets.withColumn("known", F.array_distinct(F.flatten(F.collect_list("basket").over(by_seq))))
    again = F.array_intersect("basket", "known")
    rows = known.filter(F.size(again) == 1).select("user_id", "category", F.col("seq").alias("t"), F.array_sort(F.array_union("known", again)).alias("menu"), F.get(again, F.lit(0)).alias("choice"))
    return rows.filter(F.size("menu") >= smallest)


def enough(menus: DataFrame, least: int = 5) -> DataFrame:
    """Menus of users with so many at least."""
    return menus.join(menus.groupBy("user_id").count().filter(F.col("count") >= least).select("user_id"), "user_id", "left_semi")


def top_items(bought: DataFrame, n: int) -> DataFrame:
    """Purchases of the ``n`` items bought most often (by rows, then by name): a report's cut of categories."""
    top = bought.groupBy("item").agg(F.count(F.lit(1)).alias("c")).orderBy(F.col("c").desc(), "item").limit(n)
    return bought.join(top.select("item"), "item", "left_semi")


def long_from_days(wide: DataFrame, keys: list[str], days: list[str]) -> DataFrame:
    """One row for each key and day from a table with a column for each day."""
    return wide.unpivot(keys, days, "day", "quantity")


def split(menus: DataFrame, share: float = 0.8) -> DataFrame:
    """``menus`` with part: ``train`` for the first share of each user's menus by time, else ``test``."""
    by_time = Window.partitionBy("user_id").orderBy("t")
    place = (F.row_number().over(by_time) - 1) / F.count(F.lit(1)).over(Window.partitionBy("user_id"))
    return menus.withColumn("part", F.when(place < share, "train").otherwise("test"))


def summary(menus: DataFrame) -> DataFrame:
    """One row: users, menus, items, mean and median menus of a user and items of a menu."""
    users = menus.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    a = users.agg(F.count(F.lit(1)).alias("n_users"), F.sum("n").alias("n_menus"), F.avg("n").alias("mean_menus"), F.percentile("n", 0.5).alias("median_menus"))
    b = menus.agg(F.avg(F.size("menu")).alias("mean_size"), F.percentile(F.size("menu"), 0.5).alias("median_size"), F.count_distinct("choice").alias("n_chosen"))
    # both sides are one row
    return a.join(b, F.lit(True))
