"""The numbers behind pictures and reports, as small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordia.operators.budget import dot, observations, pairs, warp


def histogram(rows: DataFrame, column: str, bins: int = 20, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """bin (from 0), from, n of a column's values; those outside fall in the first or last bin."""
    at = F.floor((F.col(column) - low) / (high - low) * bins)
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), at)).cast("long")
    counts = rows.filter(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("bin", (low + F.col("bin") * ((high - low) / bins)).alias("from"), "n")


def over_time(scores: DataFrame, column: str) -> DataFrame:
    """Mean of a score of windows (entries "user__window") by the number of the window."""
    w = F.substring_index("user_id", "__", -1).cast("long")
    return scores.groupBy(w.alias("window")).agg(F.count(F.lit(1)).alias("n_users"), F.avg(column).alias("mean"), F.min(column).alias("least"))


def relations(related: DataFrame) -> DataFrame:
    """For each pair of places how many users' graphs have the relation, strictly, and in the closure."""
    count = lambda c: F.sum(F.col(c).cast("long"))
    return related.groupBy(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).agg(count("r").alias("n_weak"), count("p").alias("n_strict"), F.count(F.lit(1)).alias("n_reached"))


def severities(related: DataFrame) -> DataFrame:
    """user_id, i, j and the share of spending saved by strict preferences that are contradicted."""
    back = related.select("user_id", F.col("i").alias("j"), F.col("j").alias("i")).distinct()
    bad = related.filter("p").join(back, ["user_id", "i", "j"], "left_semi")
    return bad.select("user_id", "i", "j", ((F.col("own") - F.col("e")) / F.col("own")).alias("severity"))


def intersections(rows: DataFrame) -> DataFrame:
    """Pairs of a user's budget sets that cross, and how many of all pairs contradict each other directly."""
    both = pairs(rows).withColumns({"m0": dot(F.col("p0"), F.col("q0")), "m1": dot(F.col("p1"), F.col("q1"))})
    gap = F.zip_with("p0", "p1", lambda a, b: a * F.col("m1") - b * F.col("m0"))
    crossing = F.exists(gap, lambda x: x > 1e-9) & F.exists(gap, lambda x: x < -1e-9)
    found = both.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(crossing.cast("long")).alias("n_crossing"))
    bad = warp(rows).select("user_id", F.col("n_violations").alias("n_contradicting"))
    return found.join(bad, "user_id").select("user_id", "n_pairs", "n_crossing", "n_contradicting")


def budget_lines(rows: DataFrame, goods: tuple[int, int] = (0, 1)) -> DataFrame:
    """Ends of each budget line over two goods, and what was bought of them."""
    o = observations(rows)
    m = dot(F.col("p"), F.col("q"))
    p, q = (lambda k: F.get("p", F.lit(goods[k]))), (lambda k: F.get("q", F.lit(goods[k])))
    return o.select("user_id", F.col("i").cast("long").alias("i"), (m / p(0)).alias("most_first"), (m / p(1)).alias("most_second"), q(0).alias("first"), q(1).alias("second"))


def positions(menus: DataFrame) -> DataFrame:
    """For each place in a menu how many menus reach it, and how many choices stand there."""
    rows = menus.select(F.posexplode("menu").alias("k", "item"), "choice")
    return rows.groupBy((F.col("k") + 1).cast("long").alias("place")).agg(F.count(F.lit(1)).alias("shown"), F.sum((F.col("item") == F.col("choice")).cast("long")).alias("chosen"), F.avg((F.col("item") == F.col("choice")).cast("double")).alias("share"))


def sizes(rows: DataFrame, column: str) -> DataFrame:
    """How many rows have an array of each size."""
    return rows.groupBy(F.size(column).cast("long").alias("size")).agg(F.count(F.lit(1)).alias("n"))


def attention(menus: DataFrame) -> DataFrame:
    """For each item and size of menu how often it was shown and chosen."""
    rows = menus.select(F.size("menu").cast("long").alias("size"), F.explode("menu").alias("item"), "choice")
    chosen = (F.col("item") == F.col("choice")).cast("long")
    return rows.groupBy(F.col("item").cast("long").alias("item"), "size").agg(F.count(F.lit(1)).alias("shown"), F.sum(chosen).alias("chosen"), F.avg(chosen.cast("double")).alias("share"))


def labelled(menus: DataFrame, labels: DataFrame) -> DataFrame:
    """Menus (user_id, t, menu, choice) with their items' labels (item, label); items without one are "item_<number>"."""
    rows = menus.select("user_id", "t", "choice", F.posexplode("menu").alias("k", "item")).join(labels.select("item", "label"), "item", "left")
    rows = rows.withColumn("label", F.coalesce("label", F.concat(F.lit("item_"), F.col("item").cast("string"))))
    found = rows.groupBy("user_id", "t").agg(F.array_sort(F.collect_list(F.struct("k", "label"))).alias("m"), F.max(F.when(F.col("item") == F.col("choice"), F.col("label"))).alias("choice_label"))
    return found.select("user_id", "t", F.transform("m", lambda x: x["label"]).alias("menu_labels"), "choice_label")


# ---------------------------------------------------------------- descriptions of data
def _quartiles(column: str, name: str) -> list[Column]:
    return [F.percentile(column, 0.5).alias(f"{name}_median"), F.percentile(column, 0.25).alias(f"{name}_p25"), F.percentile(column, 0.75).alias(f"{name}_p75"), F.min(column).cast("double").alias(f"{name}_min"), F.max(column).cast("double").alias(f"{name}_max")]


def _first_of_most(q: Column) -> Column:
    return F.array_position(q, F.array_max(q))


def describe_budgets(rows: DataFrame) -> DataFrame:
    """One row about budget rows: users, observations, spending, concentration, repetition."""
    o = observations(rows).select("user_id", "i", "p", "q", dot(F.col("p"), F.col("q")).alias("spend"), _first_of_most(F.col("q")).alias("best"), F.size(F.filter("q", lambda x: x > 0)).alias("active"), F.size("q").alias("goods"))
    o = o.withColumn("again", (F.col("best") == F.lag("best").over(Window.partitionBy("user_id").orderBy("i"))).cast("long"))
    sums = F.transform(F.get("obs", F.lit(0))["q"], lambda _, g: F.aggregate("obs", F.lit(0.0), lambda s, x: s + F.get(x["q"], g)))
    total = F.aggregate("sums", F.lit(0.0), lambda s, x: s + x)
    shares = rows.select("user_id", sums.alias("sums")).select("user_id", F.aggregate("sums", F.lit(0.0), lambda s, x: s + x * x).alias("squares"), F.array_max("sums").alias("most"), total.alias("total")).filter("total > 0")
    users = o.groupBy("user_id").agg(F.count(F.lit(1)).alias("t"), F.when((F.count(F.lit(1)) > 1) & (F.avg("spend") > 0), F.stddev_pop("spend") / F.avg("spend")).alias("cv"), (F.count_distinct("best") / F.count(F.lit(1))).alias("unlike"))
    a = users.join(shares.select("user_id", (F.col("squares") / F.col("total") ** 2).alias("hhi"), (F.col("most") / F.col("total")).alias("top")), "user_id", "left")
    a = a.agg(F.count(F.lit(1)).alias("n_users"), *_quartiles("t", "t"), F.avg((F.col("t") >= 10).cast("double")).alias("share_t_ge_10"), F.percentile("hhi", 0.5).alias("hhi_median"), F.percentile("top", 0.5).alias("top_share_median"), F.percentile("cv", 0.5).alias("spend_cv_median"), F.percentile("unlike", 0.5).alias("unique_choice_median"))
    b = o.agg(F.count(F.lit(1)).alias("n_obs"), F.max("goods").cast("long").alias("n_goods"), F.percentile("spend", 0.5).alias("spend_median"), F.percentile("active", 0.5).alias("active_median"), (1 - F.sum("active") / F.sum("goods")).alias("zero_share"), F.avg("again").alias("repeat_rate"))
    # both sides are one row
    return a.join(b, F.lit(True))


def describe_menus(menus: DataFrame) -> DataFrame:
    """One row about menus: users, sizes, overlap, concentration, switching, entropy."""
    by_time = Window.partitionBy("user_id").orderBy("t")
    before = by_time.rowsBetween(Window.unboundedPreceding, -1)
    m = menus.select(
        "user_id", "choice", "menu", F.size("menu").alias("size"), F.lag("choice").over(by_time).alias("last"), F.lag("menu").over(by_time).alias("last_menu"), F.array_contains(F.collect_set("choice").over(before), F.col("choice")).alias("seen"), F.count(F.lit(1)).over(Window.partitionBy("user_id")).alias("t"),
    )
    counts = menus.groupBy("user_id", "choice").agg(F.count(F.lit(1)).alias("c")).groupBy("user_id").agg(
        (F.max("c") / F.sum("c")).alias("modal"), (F.count(F.lit(1)) / F.sum("c")).alias("unlike"),
        ((F.log2(F.sum("c").cast("double")) - F.sum(F.col("c") * F.log2(F.col("c").cast("double"))) / F.sum("c")) / F.log2(F.greatest(F.count(F.lit(1)), F.lit(2)).cast("double"))).alias("entropy"),
    )
    items = menus.select("user_id", F.explode("menu").alias("item")).groupBy("user_id").agg(F.count_distinct("item").alias("items"))
    users = m.groupBy("user_id").agg(F.count(F.lit(1)).alias("t"), F.avg((F.col("choice") != F.col("last")).cast("double")).alias("switch")).join(counts, "user_id").join(items, "user_id")
    a = users.agg(F.count(F.lit(1)).alias("n_users"), *_quartiles("t", "t"), *[F.percentile(c, 0.5).alias(f"{c}_median") for c in ("items", "modal", "switch", "entropy", "unlike")])
    overlap = F.when(F.col("last_menu").isNotNull(), F.arrays_overlap("menu", "last_menu").cast("double"))
    b = m.agg(F.count(F.lit(1)).alias("n_menus"), *_quartiles("size", "size"), F.avg(overlap).alias("overlap_rate"), F.avg(F.when(F.col("t") > 1, F.coalesce("seen", F.lit(False)).cast("double"))).alias("repeat_rate"), F.avg((F.col("size") <= 1).cast("double")).alias("singleton_share"))
    # both sides are one row
    return a.join(b, F.lit(True))


def correlations(features: DataFrame, first: list[str], second: list[str] | None = None) -> DataFrame:
    """a, b, r of every pair of columns of one group, or of two; one pass over the table."""
    pairs = [(a, b) for i, a in enumerate(first) for b in (second if second is not None else first[i + 1 :])]
    row = features.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])
    return row.select(F.explode(cells).alias("c")).select("c.a", "c.b", "c.r")
