"""Operators over choice frequencies (user_id, menu, item, n) that are plain expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frequencies(menus: DataFrame) -> DataFrame:
    """user_id, menu, item, n, p for every item of every distinct menu of menu rows; items never chosen have n = 0."""
    counts = menus.groupBy("user_id", "menu", F.col("choice").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    cells = counts.groupBy("user_id", "menu").agg(F.map_from_entries(F.collect_list(F.struct("item", "n"))).alias("by_item"), F.sum("n").alias("total"))
    rows = cells.select("user_id", "menu", "total", "by_item", F.explode("menu").alias("item"))
    n = F.coalesce(F.element_at("by_item", F.col("item")), F.lit(0))
    return rows.select("user_id", "menu", "item", n.alias("n"), (n / F.col("total")).alias("p"))


def regularity(freq: DataFrame, tol: float = 0.01) -> DataFrame:
    """Items that a larger menu makes likelier: how many of the pairs of menus that can be tested, and the worst by how much."""
    small = freq.select("user_id", "item", F.col("menu").alias("small"), F.col("p").alias("ps"))
    large = freq.select("user_id", "item", F.col("menu").alias("large"), F.col("p").alias("pl"))
    pairs = small.join(large, ["user_id", "item"]).filter((F.size("small") < F.size("large")) & (F.size(F.array_except("small", "large")) == 0))
    over = F.col("pl") - F.col("ps")
    return pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_testable"), F.sum((over > tol).cast("long")).alias("n_violations"), F.max(F.greatest(F.lit(0.0), over)).alias("worst")).withColumn("is_regular", F.col("n_violations") == 0)


def odds(freq: DataFrame) -> DataFrame:
    """Ratios of the shares of two items over the menus that hold both: mean and coefficient of variation."""
    a = freq.filter("n > 0").select("user_id", "menu", F.col("item").alias("x"), F.col("p").alias("px"))
    b = freq.filter("n > 0").select("user_id", "menu", F.col("item").alias("y"), F.col("p").alias("py"))
    ratio = a.join(b, ["user_id", "menu"]).filter("x < y").select("user_id", "x", "y", (F.col("px") / F.col("py")).alias("odds"))
    return ratio.groupBy("user_id", "x", "y").agg(F.count(F.lit(1)).alias("n_menus"), F.avg("odds").alias("mean_odds"), (F.stddev_pop("odds") / F.avg("odds")).alias("cv"))


def independence(freq: DataFrame, tol: float = 0.1) -> DataFrame:
    """Pairs of items whose odds vary over menus."""
    o = odds(freq)
    return o.groupBy("user_id").agg(F.sum(((F.col("n_menus") > 1) & (F.col("cv") > tol)).cast("long")).alias("n_violations"), F.count(F.lit(1)).alias("n_pairs")).withColumn("is_iia", F.col("n_violations") == 0)


def pairwise(freq: DataFrame) -> DataFrame:
    """user_id, x, y, p: the share of x among choices of x or y from all menus that hold both."""
    a = freq.select("user_id", "menu", F.col("item").alias("x"), F.col("n").alias("nx"))
    b = freq.select("user_id", "menu", F.col("item").alias("y"), F.col("n").alias("ny"))
    sums = a.join(b, ["user_id", "menu"]).filter("x <> y").groupBy("user_id", "x", "y").agg(F.sum("nx").alias("wins"), F.sum("ny").alias("losses"))
    return sums.filter("wins + losses > 0").withColumn("p", F.col("wins") / (F.col("wins") + F.col("losses")))


def transitivity(freq: DataFrame, tol: float = 0.01) -> DataFrame:
    """Triples x over y over z by majority, and how many fail weak, moderate and strong transitivity."""
    p = pairwise(freq).select("user_id", "x", "y", "p")
    up = p.filter(F.col("p") > 0.5 + tol)
    path = up.select("user_id", "x", "y", F.col("p").alias("pxy")).join(up.select("user_id", F.col("x").alias("y"), F.col("y").alias("z"), F.col("p").alias("pyz")), ["user_id", "y"]).filter("x <> z")
    ends = path.join(p.select("user_id", "x", F.col("y").alias("z"), F.col("p").alias("pxz")), ["user_id", "x", "z"], "left").withColumn("pxz", F.coalesce("pxz", F.lit(0.5)))
    fails = lambda least: F.sum((F.col("pxz") < least - tol).cast("long"))
    return ends.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_triples"), fails(F.lit(0.5)).alias("weak"), fails(F.least("pxy", "pyz")).alias("moderate"), fails(F.greatest("pxy", "pyz")).alias("strong"))


def luce(freq: DataFrame) -> DataFrame:
    """Logarithm of the share of showings in which an item was chosen, shifted so that the least is 0."""
    totals = freq.groupBy("user_id", "menu").agg(F.sum("n").alias("total"))
    shares = freq.join(totals, ["user_id", "menu"]).groupBy("user_id", "item").agg((F.sum("n") / F.sum("total")).alias("share"))
    from pyspark.sql import Window

    value = F.log(F.greatest("share", F.lit(1e-10)))
    return shares.select("user_id", "item", "share", (value - F.min(value).over(Window.partitionBy("user_id"))).alias("utility"))


def decoys(freq: DataFrame, threshold: float = 0.05) -> DataFrame:
    """What the third item of {t, c, d} adds to the share of t in {t, c}; a decoy if more than the threshold."""
    two = freq.filter(F.size("menu") == 2).select("user_id", F.col("menu").alias("pair"), F.col("item").alias("target"), F.col("p").alias("p2"))
    three = freq.filter(F.size("menu") == 3).select("user_id", "menu", F.col("item").alias("target"), F.col("p").alias("p3"))
    both = two.join(three, ["user_id", "target"]).filter(F.size(F.array_except("pair", "menu")) == 0)
    rows = both.select("user_id", "target", F.get(F.array_except("menu", "pair"), F.lit(0)).alias("decoy"), (F.col("p3") - F.col("p2")).alias("gain"))
    return rows.withColumn("is_decoy", F.col("gain") > threshold)


def axioms(freq: DataFrame) -> DataFrame:
    """Regularity and independence together: both hold for a logit, the first for any additive perturbed utility."""
    r = regularity(freq).select("user_id", "is_regular")
    i = independence(freq).select("user_id", "is_iia")
    both = i.join(r, "user_id", "left").select("user_id", F.coalesce("is_regular", F.lit(True)).alias("is_regular"), "is_iia")
    return both.withColumn("is_logit", F.col("is_regular") & F.col("is_iia"))


def attention(freq: DataFrame) -> DataFrame:
    """For each item the share of showings in which it was chosen, doubled and cut at one as an attention probability, with bounds."""
    totals = freq.groupBy("user_id", "menu").agg(F.sum("n").alias("total"))
    shares = freq.join(totals, ["user_id", "menu"]).groupBy("user_id", "item").agg((F.sum("n") / F.sum("total")).alias("share"))
    p = F.least(F.lit(1.0), 2 * F.col("share"))
    return shares.select("user_id", "item", p.alias("attention"), F.greatest(F.lit(0.0), p - 0.2).alias("low"), F.least(F.lit(1.0), p + 0.2).alias("high"))


def compromises(freq: DataFrame, attributes: DataFrame, threshold: float = 0.05) -> DataFrame:
    """What the item in the middle of three by an attribute (item, a) gains over its mean share in pairs of them; a compromise if more than the threshold."""
    three = freq.filter(F.size("menu") == 3).join(attributes, "item")
    cells = three.groupBy("user_id", "menu").agg(F.array_sort(F.collect_list(F.struct("a", "item", "p"))).alias("c"))
    middle = cells.select("user_id", "menu", F.get("c", F.lit(1))["item"].alias("item"), F.get("c", F.lit(1))["p"].alias("p3"))
    two = freq.filter(F.size("menu") == 2).select("user_id", F.col("menu").alias("pair"), "item", F.col("p").alias("p2"))
    both = middle.join(two, ["user_id", "item"]).filter(F.size(F.array_except("pair", "menu")) == 0)
    return both.groupBy("user_id", "menu", "item").agg((F.max("p3") - F.avg("p2")).alias("gain")).withColumn("is_compromise", F.col("gain") > threshold)


def perturbed_utility(freq: DataFrame, tol: float = 0.01, odds_tol: float = 0.1) -> DataFrame:
    """Additive perturbed utility: held if regularity is, with the number of violations and whether odds are independent of menus too (a logit).

    ``tol`` is a difference of shares, ``odds_tol`` a coefficient of variation of odds, as ``independence`` has it.
    """
    r = regularity(freq, tol).select("user_id", "n_testable", F.col("n_violations").alias("n_irregular"), "worst")
    i = independence(freq, odds_tol).select("user_id", "is_iia")
    both = i.join(r, "user_id", "left")
    n = F.coalesce("n_irregular", F.lit(0))
    return both.select("user_id", (n == 0).alias("is_apu"), n.alias("n_irregular"), F.coalesce("worst", F.lit(0.0)).alias("worst"), "is_iia", ((n == 0) & F.col("is_iia")).alias("is_logit"))
