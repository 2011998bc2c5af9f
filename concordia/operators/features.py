"""Features of users for prediction, from purchases and from menus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Buckets of neighbouring scores for ranks.
BUCKETS = 200


def spending(bought: DataFrame) -> DataFrame:
    """Features of spending by user from (user_id, t, item, quantity, unit): totals, spread, concentration, trend, gaps."""
    lines = bought.withColumn("spend", F.col("quantity") * F.col("unit"))
    by_item = lines.groupBy("user_id", "item").agg(F.sum("spend").alias("s"))
    items = by_item.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_items"), F.max("s").alias("top"), F.sum(F.col("s") ** 2).alias("squares"))
    periods = lines.groupBy("user_id", "t").agg(F.sum("spend").alias("s"))
    by_time = Window.partitionBy("user_id").orderBy("t")
    month = F.substring("t", 1, 4).cast("int") * 12 + F.substring("t", 6, 2).cast("int")
    steps = periods.select("user_id", "s", (F.row_number().over(by_time) - 1).cast("double").alias("i"), F.abs(F.col("s") - F.lag("s").over(by_time)).alias("change"), month.alias("m"), (month - F.lag(month).over(by_time)).alias("gap"))
    totals = steps.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_periods"), F.sum("s").alias("total"), F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"), F.max("s").alias("largest"),
        F.when(F.count(F.lit(1)) > 1, F.regr_slope("s", "i")).otherwise(0.0).alias("slope"), F.coalesce(F.avg("change"), F.lit(0.0)).alias("mean_change"), F.coalesce(F.avg("gap"), F.lit(0.0)).alias("mean_gap"),
        F.coalesce(F.max("gap"), F.lit(0)).alias("max_gap"), (F.max("m") - F.min("m") + 1).alias("span"),
    )
    rows = totals.join(items, "user_id")
    return rows.select(
        "user_id", "n_periods", "n_items", "total", "mean", "std", "largest", "slope", "mean_change", "mean_gap", F.col("max_gap").cast("long").alias("max_gap"),
        F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(0.0).alias("cv"), F.when(F.col("total") > 0, F.col("squares") / (F.col("total") * F.col("total"))).otherwise(0.0).alias("hhi"),
        F.when(F.col("total") > 0, F.col("top") / F.col("total")).otherwise(0.0).alias("top_share"), (F.col("n_periods") / F.col("span")).alias("purchase_rate"),
    )


def engagement(menus: DataFrame) -> DataFrame:
    """Features of choices by user: numbers of menus and items, sizes, repeats, switches, entropy."""
    by_time = Window.partitionBy("user_id").orderBy("t")
    rows = menus.withColumns({"switch": (F.col("choice") != F.lag("choice").over(by_time)).cast("double"), "overlap": F.size(F.array_intersect("menu", F.lag("menu").over(by_time))) / F.size(F.array_union("menu", F.lag("menu").over(by_time)))})
    base = rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_menus"), F.count_distinct("choice").alias("n_chosen"), F.avg(F.size("menu")).alias("mean_size"), F.max(F.size("menu")).cast("long").alias("max_size"),
        F.coalesce(F.avg("switch"), F.lit(0.0)).alias("switch_rate"), F.coalesce(F.avg("overlap"), F.lit(0.0)).alias("mean_overlap"),
    )
    counts = menus.groupBy("user_id", "choice").agg(F.count(F.lit(1)).alias("c"))
    shares = counts.groupBy("user_id").agg(F.max("c").alias("top"), F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    shares = shares.select("user_id", (F.col("top") / F.col("n")).alias("top_share"), (F.log2("n") - F.col("s") / F.col("n")).alias("choice_entropy"))
    return base.join(shares, "user_id")


def iia_violations(menus: DataFrame) -> DataFrame:
    """Users' pairs chosen one way from two items and the other way from three: user_id, x (chosen of two), y, third menu's choice y."""
    two = menus.filter(F.size("menu") == 2).select("user_id", F.col("menu").alias("pair"), F.col("choice").alias("x")).distinct()
    three = menus.filter(F.size("menu") == 3).select("user_id", "menu", F.col("choice").alias("y")).distinct()
    joined = two.join(three, "user_id").filter((F.size(F.array_except("pair", "menu")) == 0) & (F.col("x") != F.col("y")) & F.array_contains("pair", F.col("y")))
    return joined.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_violations"))


def lift(base: DataFrame, other: DataFrame) -> DataFrame:
    """One row: area under the curve of two scores (user_id, score) against labels (in ``base``: label), by ranks."""
    both = base.select("user_id", "label", F.col("score").alias("a")).join(other.select("user_id", F.col("score").alias("b")), "user_id")

    def area(column: str) -> DataFrame:
        # mean ranks by distinct score, inside buckets of neighbouring scores and behind the counts of the buckets before
        counts = both.groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))
        cuts = counts.agg(F.percentile_approx("v", [(k + 1) / BUCKETS for k in range(BUCKETS - 1)])).first()[0] or []
        bounds = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
        dealt = counts.withColumn("bucket", F.size(F.filter(bounds, lambda b: b < F.col("v"))))
        sizes = dealt.groupBy("bucket").agg(F.sum("n").alias("all"))
        # at most BUCKETS rows
        sizes = sizes.withColumn("before", F.coalesce(F.sum("all").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        inside = Window.partitionBy("bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
        ranked = dealt.join(sizes, "bucket").withColumn("rank", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0)) + (F.col("n") + 1) / 2)
        t = ranked.agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
        return t.select(((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))).alias(f"auc_{column}"))

    joined = area("a").join(area("b"), F.lit(True))
    return joined.withColumn("lift_pct", F.when(F.col("auc_a") > 0.5, 100 * (F.col("auc_b") - F.col("auc_a")) / F.col("auc_a")))
