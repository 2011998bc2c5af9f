"""Operators over budget rows (user_id, obs) that are plain expressions.

A user's pairs of observations are made by exploding their own row, so after the one
shuffle that makes rows of users nothing is shuffled again: groups by user keep the
partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOL = 1e-10


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def observations(rows: DataFrame) -> DataFrame:
    """user_id, i, t, p, q."""
    return rows.select("user_id", F.posexplode("obs").alias("i", "o")).select("user_id", F.col("i").cast("long").alias("i"), "o.t", "o.p", "o.q")


def edges(rows: DataFrame, tol: float = TOL) -> DataFrame:
    """user_id, i, j, own, e, r, p for all pairs i <> j: what bundle j costs at prices i, and whether i is revealed preferred.

    The costs of a user are one matrix of numbers, so that no prices or bundles are copied to pairs.
    """
    costs = F.transform("obs", lambda a: F.transform("obs", lambda b: dot(a["p"], b["q"])))
    first = rows.select("user_id", F.posexplode(costs).alias("i", "row"))
    cost = first.select("user_id", F.col("i").cast("long").alias("i"), F.get("row", F.col("i")).alias("own"), F.posexplode("row").alias("j", "e")).filter("i <> j")
    cost = cost.select("user_id", "i", F.col("j").cast("long").alias("j"), "own", "e")
    return cost.withColumns({"r": F.col("own") >= F.col("e") - tol, "p": F.col("own") > F.col("e") + tol})


def pairs(rows: DataFrame) -> DataFrame:
    """user_id, i < j and prices and quantities of both (p0, q0, p1, q1), out of each user's own row."""
    first = rows.select("user_id", "obs", F.posexplode("obs").alias("i", "a"))
    later = F.slice("obs", F.col("i") + 2, F.greatest(F.lit(0), F.size("obs") - F.col("i") - 1))
    both = first.select("user_id", "i", F.col("a.p").alias("p0"), F.col("a.q").alias("q0"), F.posexplode(later).alias("k", "b"))
    return both.select("user_id", F.col("i").cast("long").alias("i"), (F.col("i") + F.col("k") + 1).cast("long").alias("j"), "p0", "q0", F.col("b.p").alias("p1"), F.col("b.q").alias("q1"))


def moves(rows: DataFrame) -> DataFrame:
    """user_id, i < j, g (good) and its price and quantity at both (p0, q0, p1, q1), with what both bundles cost (m0, m1)."""
    both = pairs(rows).withColumns({"m0": dot(F.col("p0"), F.col("q0")), "m1": dot(F.col("p1"), F.col("q1"))})
    each = both.select("user_id", "i", "j", "m0", "m1", F.posexplode(F.arrays_zip("p0", "q0", "p1", "q1")).alias("g", "x"))
    return each.select("user_id", "i", "j", "m0", "m1", F.col("g").cast("long").alias("g"), "x.p0", "x.q0", "x.p1", "x.q1")


def both_ways(rows: DataFrame) -> DataFrame:
    """user_id, i < j with costs and relations both ways, from the edges of each user without a join."""
    lower = F.least("i", "j")
    upper = F.greatest("i", "j")
    forth = F.col("i") < F.col("j")
    pick = lambda c, d: F.max(F.when(forth if d else ~forth, F.col(c)))
    return edges(rows).groupBy("user_id", lower.alias("i"), upper.alias("j")).agg(
        pick("own", True).alias("own_i"), pick("own", False).alias("own_j"), pick("e", True).alias("e_ij"), pick("e", False).alias("e_ji"),
        pick("r", True).alias("r_ij"), pick("p", True).alias("p_ij"), pick("r", False).alias("r_ji"), pick("p", False).alias("p_ji"),
    )


def per_user(rows: DataFrame, found: DataFrame, **defaults) -> DataFrame:
    """One row for each user; those without a row in ``found`` get the defaults."""
    out = rows.select("user_id").join(found, "user_id", "left")
    return out.select("user_id", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in defaults.items()])


def warp(rows: DataFrame) -> DataFrame:
    """Pairs of observations that are revealed preferred to each other, once at least strictly."""
    bad = (F.col("r_ij") & F.col("p_ji")) | (F.col("r_ji") & F.col("p_ij"))
    found = both_ways(rows).groupBy("user_id").agg(F.sum(bad.cast("long")).alias("n_violations"))
    return per_user(rows, found, n_violations=0).withColumn("is_warp", F.col("n_violations") == 0)


def network(rows: DataFrame) -> DataFrame:
    """Density, deviation of out-degrees and Gini coefficient of degrees of the direct relation."""
    e = edges(rows).filter("r")
    ends = e.select("user_id", F.explode(F.array(F.struct(F.col("i").alias("k"), F.lit(1).alias("out")), F.struct(F.col("j").alias("k"), F.lit(0).alias("out")))).alias("x"))
    degrees = ends.groupBy("user_id", "x.k").agg(F.count(F.lit(1)).alias("d"), F.sum("x.out").alias("o"))
    lists = degrees.groupBy("user_id").agg(F.array_sort(F.collect_list("d")).alias("ds"), F.sum("o").alias("edges"), F.sum(F.col("o") * F.col("o")).alias("squares"))
    n = F.size("obs").cast("double")
    all_ = rows.select("user_id", n.alias("n")).join(lists, "user_id", "left")
    zero = F.coalesce("edges", F.lit(0)).cast("double")
    mean = zero / F.col("n")
    # sorted degrees stand behind the zeros of observations without any relation
    shift = F.col("n") - F.size("ds")
    weighted = F.aggregate(F.transform("ds", lambda d, i: d * (i + 1 + shift)), F.lit(0.0), lambda s, x: s + x)
    total = zero * 2
    return all_.select(
        "user_id",
        F.when(F.col("n") > 1, zero / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("r_density"),
        F.sqrt(F.greatest(F.lit(0.0), F.coalesce("squares", F.lit(0)) / F.col("n") - mean * mean)).alias("r_out_degree_std"),
        F.when(total > 0, (2 * weighted - (F.col("n") + 1) * total) / (F.col("n") * total)).otherwise(0.0).alias("degree_gini"),
    )


def weights(rows: DataFrame) -> DataFrame:
    """Mean, population deviation and skewness of log spending ratios over the direct relation."""
    w = edges(rows).filter((F.col("r")) & (F.col("own") > TOL) & (F.col("e") > TOL)).select("user_id", (F.log("own") - F.log("e")).alias("w"))
    moments = w.groupBy("user_id").agg(F.avg("w").alias("m"), F.avg(F.col("w") ** 2).alias("m2"), F.avg(F.col("w") ** 3).alias("m3"))
    variance = F.greatest(F.lit(0.0), F.col("m2") - F.col("m") ** 2)
    std = F.sqrt(variance)
    found = moments.select("user_id", F.col("m").alias("ew_mean"), std.alias("ew_std"), F.when(std > 1e-12, (F.col("m3") - 3 * F.col("m") * F.col("m2") + 2 * F.col("m") ** 3) / std**3).otherwise(0.0).alias("ew_skew"))
    return per_user(rows, found, ew_mean=0.0, ew_std=0.0, ew_skew=0.0)


def savings(rows: DataFrame) -> DataFrame:
    """The largest share of spending that one revealed worse bundle would have saved: an upper bound of the money pump."""
    found = edges(rows).filter("r").groupBy("user_id").agg(F.max((F.col("own") - F.col("e")) / F.col("own")).alias("max_saving"))
    return per_user(rows, found, max_saving=0.0)


def varian(rows: DataFrame, consistent: DataFrame) -> DataFrame:
    """Mean and least efficiency of observations; ``consistent`` has user_id and is_garp."""
    worst = edges(rows, 1e-8).groupBy("user_id", "i").agg(F.max(F.when(F.col("r"), F.col("e") / F.col("own"))).alias("x"))
    level = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("x", F.lit(0.0))))
    found = worst.groupBy("user_id").agg(F.avg(level).alias("m"), F.min(level).alias("l"))
    out = consistent.select("user_id", "is_garp").join(found, "user_id", "left")
    pick = lambda c: F.when(F.col("is_garp"), F.lit(1.0)).otherwise(F.coalesce(c, F.lit(0.0)))
    return out.select("user_id", pick("m").alias("vei_mean"), pick("l").alias("vei_min"))


def features(rows: DataFrame) -> DataFrame:
    """Spending of each user: level, deviation, trend over observations, concentration over goods, baskets."""
    o = observations(rows).withColumn("own", dot(F.col("p"), F.col("q")))
    shares = F.aggregate(F.zip_with("p", "q", lambda x, y: F.pow(x * y, F.lit(2.0))), F.lit(0.0), lambda s, x: s + x) / (F.col("own") * F.col("own"))
    goods = F.size(F.filter("q", lambda x: x > 0))
    return o.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_obs"), F.sum("own").alias("total_spend"), F.avg("own").alias("mean_spend"), F.stddev_pop("own").alias("std_spend"), F.max("own").alias("max_spend"),
        F.coalesce(F.regr_slope("own", F.col("i").cast("double")), F.lit(0.0)).alias("spend_slope"), F.avg(shares).alias("mean_hhi"), F.avg(goods.cast("double")).alias("mean_goods"),
    )


def goods(rows: DataFrame) -> DataFrame:
    """user_id, i, g (good), price, quantity."""
    o = observations(rows).select("user_id", "i", F.posexplode(F.arrays_zip("p", "q")).alias("g", "x"))
    return o.select("user_id", "i", F.col("g").cast("long").alias("g"), F.col("x.p").alias("price"), F.col("x.q").alias("quantity"))


def law_of_demand(rows: DataFrame, threshold: float = 0.05) -> DataFrame:
    """For each good and user the pairs of observations whose price differs by the threshold: how many obey, how many don't."""
    changes = moves(rows).select("user_id", "g", ((F.col("p1") - F.col("p0")) / F.col("p0")).alias("dp"), (F.col("q1") - F.col("q0")).alias("dq"))
    moved = changes.filter(F.abs("dp") >= threshold)
    sign = F.signum("dp") * F.signum("dq")
    return moved.groupBy("user_id", "g").agg(F.sum((sign < 0).cast("long")).alias("obeying"), F.sum((sign > 0).cast("long")).alias("violating"))


def substitution(rows: DataFrame, threshold: float = 0.05) -> DataFrame:
    """For goods g and h: how often quantity g moves with price h (substitutes) or against it (complements).

    Counted over pairs of observations in which price h changes by the threshold at least,
    and every other price by half of that change at most.
    """
    dp = F.zip_with("p0", "p1", lambda s, t: (t - s) / s)
    dq = F.zip_with("q0", "q1", lambda s, t: t - s)
    rows = pairs(rows).select(dp.alias("dp"), dq.alias("dq")).withColumn("size", F.sort_array(F.transform("dp", F.abs), asc=False))
    clean = rows.filter((F.get("size", F.lit(0)) >= threshold) & (F.coalesce(F.get("size", F.lit(1)), F.lit(0.0)) <= F.get("size", F.lit(0)) / 2))
    moved = clean.withColumn("h", F.array_position(F.transform("dp", F.abs), F.get("size", F.lit(0))) - 1)
    goods_ = moved.select("h", F.get("dp", F.col("h").cast("int")).alias("dh"), F.posexplode("dq").alias("g", "d")).filter("g <> h")
    sign = F.signum("d") * F.signum("dh")
    return goods_.groupBy(F.col("g").cast("long").alias("g"), F.col("h").cast("long").alias("h")).agg(F.sum((sign > 0).cast("long")).alias("substitutes"), F.sum((sign < 0).cast("long")).alias("complements"))


def additivity(rows: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Pairs of observations in which a good's price and quantity rise together, by user: none in additive demand."""
    bad = (F.col("p1") - F.col("p0")) * (F.col("q1") - F.col("q0")) > tol
    found = moves(rows).groupBy("user_id").agg(F.sum(bad.cast("long")).alias("n_violations"))
    return per_user(rows, found, n_violations=0).withColumn("is_additive", F.col("n_violations") == 0)


def welfare(rows: DataFrame) -> DataFrame:
    """First-order bounds of compensating and equivalent variation, surplus and loss, from the first half of observations to the second."""
    half = F.floor(F.size("obs") / 2).cast("int")
    mean = lambda part, field: F.transform(F.sequence(F.lit(0), F.size(F.col("obs")[0][field]) - 1), lambda g: F.aggregate(part, F.lit(0.0), lambda s, o: s + F.get(o[field], g)) / F.size(part))
    parts = rows.filter(F.size("obs") >= 2).select("user_id", "obs", F.slice("obs", F.lit(1), half).alias("base"), F.slice("obs", half + 1, F.size("obs")).alias("policy"))
    m = parts.select("user_id", mean(F.col("base"), "p").alias("p0"), mean(F.col("base"), "q").alias("q0"), mean(F.col("policy"), "p").alias("p1"), mean(F.col("policy"), "q").alias("q1"))
    cv, ev = dot(F.col("p1"), F.col("q0")) - dot(F.col("p1"), F.col("q1")), dot(F.col("p0"), F.col("q1")) - dot(F.col("p0"), F.col("q0"))
    return m.select("user_id", cv.alias("cv"), ev.alias("ev"), (-dot(F.zip_with("p1", "p0", lambda a, b: a - b), F.col("q0"))).alias("surplus"), (F.abs(cv - ev) / 2).alias("deadweight_loss"))


def cannibalization(rows: DataFrame, group_a: list[int], group_b: list[int]) -> DataFrame:
    """Correlation of changes of the spending shares of two groups of goods, by user: null of one change, NaN where a share never changes otherwise."""
    spend = lambda group: sum((F.get(F.col("p"), F.lit(g)) * F.get(F.col("q"), F.lit(g)) for g in group), F.lit(0.0))
    from pyspark.sql import Window

    o = observations(rows).withColumn("own", dot(F.col("p"), F.col("q"))).filter("own > 0")
    o = o.select("user_id", "i", (spend(group_a) / F.col("own")).alias("a"), (spend(group_b) / F.col("own")).alias("b"))
    by_time = Window.partitionBy("user_id").orderBy("i")
    d = o.select("user_id", (F.col("a") - F.lag("a").over(by_time)).alias("da"), (F.col("b") - F.lag("b").over(by_time)).alias("db")).filter("da IS NOT NULL")
    # corr itself fails by a division by zero where a share's changes are all equal
    spread = F.stddev_pop("da") * F.stddev_pop("db")
    correlation = F.when(F.count(F.lit(1)) > 1, F.when(spread > 0, F.covar_pop("da", "db") / spread).otherwise(float("nan")))
    return d.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_changes"), correlation.alias("correlation"))


def price_effects(rows: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Median change of a good's quantity by its price's, over steps in which the price moves by the threshold, with the income effect taken out."""
    from pyspark.sql import Window

    by_time = Window.partitionBy("user_id", "g").orderBy("i")
    o = observations(rows).withColumn("m", dot(F.col("p"), F.col("q"))).select("user_id", "i", "m", F.posexplode(F.arrays_zip("p", "q")).alias("g", "x"))
    o = o.select("user_id", "i", "m", "g", F.col("x.p").alias("p"), F.col("x.q").alias("q"))
    d = o.select("user_id", "g", "q", (F.col("p") - F.lag("p").over(by_time)).alias("dp"), (F.lag("p").over(by_time)).alias("p0"), (F.col("q") - F.lag("q").over(by_time)).alias("dq"), (F.col("m") - F.lag("m").over(by_time)).alias("dm"))
    moved = d.filter(F.abs(F.col("dp") / F.col("p0")) >= threshold)
    e = moved.groupBy("user_id", F.col("g").cast("long").alias("g")).agg(F.count(F.lit(1)).alias("n"), F.percentile(F.col("dq") / F.col("dp"), 0.5).alias("total"), F.percentile(F.when(F.abs("dm") > 1e-10, F.col("dq") / F.col("dm")), 0.5).alias("by_income"), F.avg("q").alias("q"))
    income = -F.coalesce("by_income", F.lit(0.0)) * F.col("q")
    return e.select("user_id", "g", "n", "total", income.alias("income"), (F.col("total") - income).alias("substitution"))


def population_welfare(rows: DataFrame) -> DataFrame:
    """One row: users whose mean bundle costs less or more at the mean prices of their second half of observations."""
    w = welfare(rows)
    return w.agg(F.count(F.lit(1)).alias("n_users"), F.avg((F.col("surplus") > 0).cast("double")).alias("share_better"), F.avg((F.col("surplus") < 0).cast("double")).alias("share_worse"), F.avg("cv").alias("mean_cv"), F.avg("ev").alias("mean_ev"))


def additive_consistency(rows: DataFrame, tol: float = 0.05) -> DataFrame:
    """Pairs of observations with like spending in which a good has one price but quantities that differ by a tenth."""
    alike = (F.abs(F.col("p0") - F.col("p1")) <= tol * F.col("p0")) & (F.abs(F.col("m0") - F.col("m1")) <= tol * F.col("m0"))
    bad = F.abs(F.col("q0") - F.col("q1")) > 0.1 * F.greatest("q0", "q1")
    found = moves(rows).filter(alike).groupBy("user_id").agg(F.sum(bad.cast("long")).alias("n_violations"), F.count(F.lit(1)).alias("n_pairs"))
    return per_user(rows, found, n_violations=0, n_pairs=0)


def pump_pairs(rows: DataFrame) -> DataFrame:
    """The money pump over cycles of two observations: a lower bound of the index over all cycles."""
    both = both_ways(rows).filter(F.col("r_ij") & F.col("r_ji"))
    saved = ((F.col("own_i") - F.col("e_ij")) / F.col("own_i") + (F.col("own_j") - F.col("e_ji")) / F.col("own_j")) / 2
    return per_user(rows, both.groupBy("user_id").agg(F.max(F.greatest(F.lit(0.0), saved)).alias("mpi_pairs")), mpi_pairs=0.0)


def varian_least_squares(rows: DataFrame, related: DataFrame) -> DataFrame:
    """Levels of least squared distance from one that are no lower than the cost ratios of all observations revealed worse.

    ``related`` has user_id, i, j, own, e of every pair in the closure.  Levels are at most one, so they are
    all one if no ratio is above one, and there are none otherwise.
    """
    worst = related.groupBy("user_id").agg(F.max(F.col("e") / F.col("own")).alias("highest"))
    fine = F.coalesce(F.col("highest"), F.lit(0.0)) <= 1 + 1e-10
    return rows.select("user_id").join(worst, "user_id", "left").select("user_id", fine.alias("success"), F.when(fine, 1.0).alias("mean_level"), F.when(fine, 1.0).alias("min_level"))


def demand_bounds(rows: DataFrame, prices: list[float]) -> DataFrame:
    """Bounds of each good's quantity at new prices: four fifths of what was bought when it was dearer, half as much again as the same spending buys when it was cheaper."""
    o = observations(rows).select("user_id", F.posexplode(F.arrays_zip("p", "q")).alias("g", "x"))
    new = F.get(F.array(*[F.lit(float(x)) for x in prices]), F.col("g"))
    cells = o.select("user_id", F.col("g").cast("long").alias("g"), F.when(new < F.col("x.p"), F.col("x.q") * 0.8).alias("low"), F.when(new > F.col("x.p"), F.greatest(F.lit(0.0), F.col("x.q") * (F.col("x.p") / new) * 1.5)).alias("high"))
    found = cells.groupBy("user_id", "g").agg(F.greatest(F.lit(0.0), F.coalesce(F.max("low"), F.lit(0.0))).alias("low"), F.min("high").alias("high"))
    crossed = F.coalesce(F.col("low") > F.col("high"), F.lit(False))
    return found.select("user_id", "g", F.when(crossed, 0.0).otherwise(F.col("low")).alias("low"), F.when(crossed, None).otherwise(F.col("high")).alias("high"), (~crossed & F.col("high").isNotNull()).alias("is_bounded"))


def quantity_correlations(rows: DataFrame) -> DataFrame:
    """Correlation of the quantities of every pair of goods over a user's observations; none for one that never varies."""
    o = observations(rows).select("user_id", "q", F.posexplode("q").alias("g", "a"))
    pairs = o.select("user_id", F.col("g").cast("long").alias("g"), "a", F.posexplode("q").alias("h", "b")).filter("g < h")
    found = pairs.groupBy("user_id", "g", F.col("h").cast("long").alias("h")).agg(F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"), F.covar_pop("a", "b").alias("c"))
    return found.select("user_id", "g", "h", F.when((F.col("sa") > 1e-9) & (F.col("sb") > 1e-9), F.col("c") / (F.col("sa") * F.col("sb"))).alias("correlation"))
