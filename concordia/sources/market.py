"""Budget, menu and frequency data from order, part and event tables.

The recipes are those of retail panels: monthly purchases by category, a grid of median
unit prices that is filled forward, then backward, then with 1; and of click logs: what a
user saw on a day is the menu of a day with one single purchase.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Periods of a price grid at most; they are named in the plan.
MAX_PERIODS = 20_000
#: Cells of a price grid that are held on the driver and broadcast at most; a larger grid is shuffled.
MAX_CELLS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, t (month), item (part type), quantity, unit (price of one) of every order line."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    joined = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return joined.select(
        F.col("o_custkey").cast("string").alias("user_id"), F.date_format("o_orderdate", "yyyy-MM").alias("t"), F.col("p_type").alias("item"), F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit")
    )


def fill_grid(prices: DataFrame) -> DataFrame:
    """t, item, price for every period and item of (t, item, price): last price, else next price, else 1."""
    periods = sorted(r["t"] for r in prices.select("t").distinct().limit(MAX_PERIODS + 1).collect())
    if len(periods) > MAX_PERIODS:
        raise ValueError(f"more than {MAX_PERIODS} periods")
    known = prices.groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("t", "price"))).alias("by_t"))
    cells = known.select("item", "by_t", F.explode(F.array(*[F.lit(t) for t in periods]) if periods else F.array().cast("array<string>")).alias("t"))
    cells = cells.select("item", "t", F.element_at("by_t", F.col("t")).alias("price"))
    by_time = Window.partitionBy("item").orderBy("t")
    past = F.last("price", ignorenulls=True).over(by_time.rowsBetween(Window.unboundedPreceding, 0))
    next_ = F.first("price", ignorenulls=True).over(by_time.rowsBetween(0, Window.unboundedFollowing))
    return cells.select("t", "item", F.coalesce(past, next_, F.lit(1.0)).alias("price"))


def price_grid(bought: DataFrame) -> DataFrame:
    """Median unit prices in whole cents, so that costs are exact and ties are ties everywhere."""
    medians = bought.groupBy("t", "item").agg(F.percentile("unit", 0.5).alias("price"))
    # periods and items are few: their medians are computed once, however often the grid is read
    found = medians.limit(MAX_CELLS + 1).collect()
    if len(found) <= MAX_CELLS:
        medians = bought.sparkSession.createDataFrame(found, medians.schema)
    grid = fill_grid(medians)
    return grid.select("t", "item", F.floor(F.col("price") * 100 + 0.5).cast("double").alias("price"))


def imputed_prices(bought: DataFrame) -> DataFrame:
    """user_id, t, item, price: the median unit price of the user's own purchases, else of period and item, else of the item, else of all."""
    own = bought.groupBy("user_id", "t", "item").agg(F.percentile(F.when(F.col("quantity") > 0, F.col("unit")), 0.5).alias("own"))
    cell = bought.groupBy("t", "item").agg(F.percentile("unit", 0.5).alias("cell"), F.count("unit").alias("n"))
    item = bought.groupBy("item").agg(F.percentile("unit", 0.5).alias("any"))
    rows = own.join(cell, ["t", "item"], "left").join(item, "item", "left")
    return rows.select("user_id", "t", "item", F.coalesce(F.when(F.col("n") >= 3, F.col("cell")), F.col("any"), F.col("own")).alias("price"))


def budgets(bought: DataFrame) -> DataFrame:
    """Budget rows (user_id, obs) over all items of the grid, which are few.

    Purchases are dealt by user once; the groups by user, time and item that follow keep that.
    """
    grid = price_grid(bought).groupBy("t").agg(F.array_sort(F.collect_list(F.struct("item", "price"))).alias("cells"))
    grid = grid.select("t", F.transform("cells", lambda c: c["item"]).alias("items"), F.transform("cells", lambda c: c["price"]).alias("p"))
    rows = grid.limit(MAX_CELLS // 100 + 1).collect()
    if len(rows) <= MAX_CELLS // 100 and sum(len(r["p"]) for r in rows) <= MAX_CELLS:
        # checked just above
        grid = F.broadcast(bought.sparkSession.createDataFrame(rows, grid.schema))
    cells = bought.repartition("user_id").groupBy("user_id", "t", "item").agg(F.sum("quantity").alias("quantity"))
    cells = cells.groupBy("user_id", "t").agg(F.map_from_entries(F.collect_list(F.struct("item", "quantity"))).alias("by_item"))
    q = F.transform("items", lambda i: F.coalesce(F.element_at("by_item", i), F.lit(0.0)))
    rows = cells.join(grid, "t").select("user_id", "t", "p", q.alias("q"))
    return rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("t", "p", "q"))).alias("obs"))


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budgets(purchases(spark, sf_dir))


def events(spark: SparkSession, sf_dir: str, items: int) -> DataFrame:
    """user_id, ts, event_type, value and item (of ``items``) of every event."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value", "props")
    return rows.select(F.col("user_id").cast("string").alias("user_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", (F.get_json_object("props", "$.k").cast("int") % items).alias("item"))


def daily_menus(seen: DataFrame, *, smallest: int = 2) -> DataFrame:
    """user_id, t (day), menu, choice: days with one purchased item; the menu is all that was seen, and it."""
    shown = F.col("event_type").isin("view", "click", "purchase")
    bought = F.when(F.col("event_type") == "purchase", F.col("item"))
    days = seen.filter(shown & F.col("item").isNotNull()).groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("t"))
    days = days.agg(F.array_sort(F.collect_set("item")).alias("menu"), F.count(bought).alias("n"), F.max(bought).alias("choice"))
    return days.filter((F.col("n") == 1) & (F.size("menu") >= smallest)).select("user_id", "t", "menu", "choice")


def sessions(seen: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Events with session: a running number of each user that rises after a gap."""
    by_time = Window.partitionBy("user_id").orderBy("ts", "event_id")
    late = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(by_time)) > gap_minutes * 60_000_000
    return seen.withColumn("session", F.sum(F.coalesce(late, F.lit(False)).cast("long")).over(by_time.rowsBetween(Window.unboundedPreceding, 0)))


def session_menus(seen: DataFrame, gap_minutes: int = 30, smallest: int = 2, largest: int = 50) -> DataFrame:
    """user_id, t (session), menu, choice of sessions with one purchase."""
    bought = F.when(F.col("event_type") == "purchase", F.col("item"))
    rows = sessions(seen, gap_minutes).groupBy("user_id", F.col("session").alias("t")).agg(F.array_sort(F.collect_set("item")).alias("menu"), F.count(bought).alias("n"), F.max(bought).alias("choice"))
    return rows.filter((F.col("n") == 1) & F.size("menu").between(smallest, largest)).select("user_id", "t", "menu", "choice")


def windowed_menus(seen: DataFrame, hours: int = 6, smallest: int = 2) -> DataFrame:
    """For every purchase the items seen by its user in the hours before it: user_id, t, menu, choice."""
    seconds = F.unix_micros("ts")
    before = Window.partitionBy("user_id").orderBy(seconds).rangeBetween(-hours * 3_600_000_000, -1)
    viewed = F.collect_set(F.when(F.col("event_type").isin("view", "click"), F.col("item"))).over(before)
    rows = seen.withColumn("viewed", viewed).filter(F.col("event_type") == "purchase")
    rows = rows.select("user_id", F.col("event_id").alias("t"), F.array_sort(F.array_union("viewed", F.array("item"))).alias("menu"), F.col("item").alias("choice"))
    return rows.filter(F.size("menu") >= smallest)



def dated_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between an order's amount and the customer's next one's, later by the days between; urgent orders take the later one."""
    by_time = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    ahead = F.datediff(F.lead("o_orderdate").over(by_time), "o_orderdate")
    rows = o.select(
        F.col("o_custkey").cast("string").alias("user_id"), F.col("o_totalprice").alias("amount0"), F.lead("o_totalprice").over(by_time).alias("amount1"), ahead.alias("ahead"),
        ((F.row_number().over(by_time) % 2) * 30).cast("long").alias("date0"), (F.substring("o_orderpriority", 1, 1) < "3").cast("int").alias("chosen"),
    )
    return rows.filter("ahead IS NOT NULL").select("user_id", "amount0", "date0", "amount1", (F.col("date0") + F.col("ahead")).alias("date1"), "chosen")


def firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by quarter as firms (user_id, obs): goods and handling go in, delivered and returned value comes out, in cents.

    A line without a return flag is neither delivered nor returned.
    A mean price that lies on half a cent is rounded by the last bits of its sums, so lines are added one after the other
    as they stand in their files (by name): the sums are those of one thread, whatever the partitions.
    """
    quarter = F.concat(F.year("l_shipdate").cast("string"), F.lit("-"), F.quarter("l_shipdate").cast("string"))
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("user_id"), quarter.alias("t"), "l_quantity", "l_extendedprice", "l_tax", "l_returnflag", *place)
    lines = lines.repartition("user_id", "t").sortWithinPartitions("user_id", "t", "file", "row")
    cents = lambda c: F.floor(c * 100 + 0.5).cast("double")
    value = lambda flagged: F.sum(F.when(flagged, F.col("l_extendedprice")).otherwise(0.0))
    rows = lines.groupBy("user_id", "t").agg(
        cents(F.sum("l_extendedprice") / F.sum("l_quantity")).alias("p0"), cents(1 + F.avg("l_tax")).alias("p1"), F.sum("l_quantity").alias("q0"), F.count(F.lit(1)).cast("double").alias("q1"),
        cents(value(F.col("l_returnflag") != "R")).alias("o0"), cents(value(F.col("l_returnflag") == "R")).alias("o1"),
    )
    o = F.struct("t", F.array("p0", "p1").alias("ip"), F.array("q0", "q1").alias("iq"), F.array(F.lit(1.0), F.lit(0.5)).alias("op"), F.array("o0", "o1").alias("oq"))
    return rows.groupBy("user_id").agg(F.array_sort(F.collect_list(o)).alias("obs"))


def lotteries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as choices between a sure amount and a lottery of two of its lines' prices; late priorities take the lottery."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), F.avg("l_extendedprice").alias("safe"), F.avg("l_discount").alias("d"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    p = F.least(F.lit(1.0), 0.4 + F.col("d") * 2)
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return joined.select(F.col("o_custkey").cast("string").alias("user_id"), "safe", F.array("low", "high").alias("outcomes"), F.array(1 - p, p).alias("probs"), (F.substring("o_orderpriority", 1, 1) >= "3").alias("chose_risky"))


def item_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item (label) and x: the first embedding of each label."""
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("item")).agg(F.min_by("embedding", "vec_id").cast("array<double>").alias("x"))


BUDGET_SQL = """
purchases AS (
  SELECT CAST(o_custkey AS VARCHAR) AS user_id, strftime(o_orderdate, '%Y-%m') AS t, p_type AS item, l_quantity AS quantity, l_extendedprice / l_quantity AS unit
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
), medians AS (
  SELECT t, item, median(unit) AS price FROM purchases GROUP BY t, item
), cells AS (
  SELECT t, item, price FROM (SELECT DISTINCT t FROM purchases) CROSS JOIN (SELECT DISTINCT item FROM purchases) LEFT JOIN medians USING (t, item)
), grid AS MATERIALIZED (
  SELECT t, item, floor(coalesce(
    last_value(price IGNORE NULLS) OVER (PARTITION BY item ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(price IGNORE NULLS) OVER (PARTITION BY item ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) * 100 + 0.5) AS price
  FROM cells
), bought AS MATERIALIZED (
  SELECT user_id, t, item, sum(quantity) AS quantity FROM purchases GROUP BY user_id, t, item
), obs AS MATERIALIZED (
  SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS i FROM (SELECT DISTINCT user_id, t FROM bought)
), cost AS MATERIALIZED (
  SELECT a.user_id, a.i, b.i AS j, sum(g.price * x.quantity) AS e
  FROM obs a JOIN obs b USING (user_id) JOIN bought x ON x.user_id = b.user_id AND x.t = b.t JOIN grid g ON g.t = a.t AND g.item = x.item
  GROUP BY a.user_id, a.i, b.i
), edges AS MATERIALIZED (
  SELECT c.user_id, c.i, c.j, o.e AS own, c.e, o.e >= c.e - 1e-10 AS r, o.e > c.e + 1e-10 AS p
  FROM cost c JOIN cost o ON o.user_id = c.user_id AND o.i = c.i AND o.j = c.i WHERE c.i <> c.j
), sizes AS (
  SELECT user_id, count(*) AS n FROM obs GROUP BY user_id
)
"""

MENU_SQL = """
seen AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id, event_id, ts, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) % {items} AS item FROM events
), menus AS (
  SELECT user_id, strftime(ts, '%Y-%m-%d') AS t, list_sort(list_distinct(list(item))) AS menu, max(item) FILTER (event_type = 'purchase') AS choice
  FROM seen WHERE event_type IN ('view', 'click', 'purchase') AND item IS NOT NULL GROUP BY user_id, strftime(ts, '%Y-%m-%d')
  HAVING count(*) FILTER (event_type = 'purchase') = 1 AND count(DISTINCT item) >= 2
), shown AS (
  SELECT user_id, t, choice, unnest(menu) AS item FROM menus
), edges AS (
  SELECT DISTINCT user_id, choice AS i, item AS j FROM shown WHERE item <> choice
), items AS (
  SELECT DISTINCT user_id, item FROM shown
)
"""
