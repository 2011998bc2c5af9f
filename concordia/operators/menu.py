"""Operators over menu rows (user_id, t, menu, choice) that are plain expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shown(menus: DataFrame) -> DataFrame:
    """user_id, t, choice, item, size for every item of every menu."""
    return menus.select("user_id", "t", "choice", F.size("menu").alias("size"), F.explode("menu").alias("item"))


def edges(menus: DataFrame) -> DataFrame:
    """user_id, i, j: i was chosen while j was there."""
    return shown(menus).filter("item <> choice").select("user_id", F.col("choice").alias("i"), F.col("item").alias("j")).distinct()


def _reversals(menus: DataFrame) -> DataFrame:
    e = edges(menus)
    both = e.groupBy("user_id", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return both.filter("n = 2").drop("n")


def users(menus: DataFrame) -> DataFrame:
    return menus.select("user_id").distinct()


def warp(menus: DataFrame) -> DataFrame:
    """Pairs of items chosen over each other."""
    n = _reversals(menus).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    out = users(menus).join(n, "user_id", "left").select("user_id", F.coalesce("n", F.lit(0)).alias("n_warp_violations"))
    return out.withColumn("is_warp", F.col("n_warp_violations") == 0)


def warp_limited_attention(menus: DataFrame) -> DataFrame:
    """Reversals that no third item chosen over both excuses."""
    e = edges(menus)
    r = _reversals(menus)
    excused = r.join(e.select("user_id", F.col("i").alias("z"), F.col("j").alias("x")), ["user_id", "x"]).join(e.select("user_id", F.col("i").alias("z"), F.col("j").alias("y")), ["user_id", "z", "y"])
    bad = r.join(excused.select("user_id", "x", "y").distinct(), ["user_id", "x", "y"], "left_anti").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    out = users(menus).join(bad, "user_id", "left").select("user_id", F.coalesce("n", F.lit(0)).alias("n_unexcused"))
    return out.withColumn("is_warp_la", F.col("n_unexcused") == 0)


def attention_relation(menus: DataFrame) -> DataFrame:
    """user_id, x, y: x is chosen from a menu, but not from the same menu without y; so y draws attention to x."""
    single = menus.groupBy("user_id", "menu").agg(F.max(F.struct("t", "choice")).alias("last")).select("user_id", "menu", F.col("last.choice").alias("choice"))
    less = single.select("user_id", "menu", "choice", F.explode("menu").alias("y")).filter("y <> choice").withColumn("menu", F.array_except("menu", F.array("y")))
    other = single.select("user_id", "menu", F.col("choice").alias("then"))
    return less.join(other, ["user_id", "menu"]).filter("then <> choice").select("user_id", F.col("choice").alias("x"), "y").distinct()


def network(menus: DataFrame) -> DataFrame:
    """Density of the direct relation, entropy of the shares of out-degrees in bits, share of distinct choices."""
    out_degree = edges(menus).groupBy("user_id", "i").agg(F.count(F.lit(1)).alias("d"))
    totals = out_degree.groupBy("user_id").agg(F.sum("d").alias("edges"), F.sum(F.col("d") * F.log2("d")).alias("s"))
    items = shown(menus).groupBy("user_id").agg(F.count_distinct("item").alias("n"))
    chosen = menus.groupBy("user_id").agg((F.count_distinct("choice") / F.count(F.lit(1))).alias("choice_diversity"))
    rows = items.join(chosen, "user_id").join(totals, "user_id", "left")
    edges_ = F.coalesce("edges", F.lit(0))
    return rows.select(
        "user_id",
        F.when(F.col("n") > 1, edges_ / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("r_density"),
        F.when(edges_ > 0, F.log2("edges") - F.col("s") / F.col("edges")).otherwise(0.0).alias("pref_entropy"),
        "choice_diversity",
    )


def salience(menus: DataFrame) -> DataFrame:
    """For each item how often it was shown and chosen."""
    s = shown(menus)
    return s.groupBy("item").agg(F.count(F.lit(1)).alias("shown"), F.sum((F.col("item") == F.col("choice")).cast("long")).alias("chosen")).withColumn("salience", F.col("chosen") / F.col("shown"))


def overload(menus: DataFrame) -> DataFrame:
    """By menu size the share of choices of the user's most frequent item, and the slope of it over log(size + 1)."""
    counts = menus.groupBy("user_id", "choice").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("user_id").agg(F.max(F.struct("n", -F.col("choice"))).alias("m")).select("user_id", (-F.col("m.col2")).alias("favourite"))
    by_size = menus.join(top, "user_id").groupBy(F.size("menu").cast("long").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("choice") == F.col("favourite")).cast("double")).alias("quality"))
    return by_size.withColumn("log_size", F.log(F.col("size") + 1.0))


def overload_slope(menus: DataFrame) -> DataFrame:
    return overload(menus).agg(F.regr_slope("quality", "log_size").alias("slope"), F.regr_r2("quality", "log_size").alias("r2"))


def status_quo(menus: DataFrame) -> DataFrame:
    """How often each user takes the least item (the default), against chance, as a normal score."""
    rows = menus.select("user_id", (F.col("choice") == F.array_min("menu")).cast("double").alias("default"), (1 / F.size("menu")).alias("chance"))
    n = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("default").alias("taken"), F.sum("chance").alias("expected"), F.sum(F.col("chance") * (1 - F.col("chance"))).alias("variance"))
    return n.select("user_id", "n", (F.col("taken") / F.col("n")).alias("default_rate"), (F.col("expected") / F.col("n")).alias("chance_rate"), F.when(F.col("variance") > 0, (F.col("taken") - F.col("expected")) / F.sqrt("variance")).otherwise(0.0).alias("z"))
