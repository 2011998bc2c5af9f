"""Queries that run the recipes of public data sets over the tables at hand, put into their layouts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordia.registry import Query, rounded
from concordia.sources import clicklogs, datasets, market

TYPES = ("toys", "auto", "baby", "stationery", "tv", "music")
AISLES = ("fresh fruits", "packaged cheese", "water seltzer", "frozen meals", "red wines", "other aisle", "mystery")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders, parts = (market.table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    # the price of one, and the number of a line's place in its order
    return joined.withColumn("u", F.col("l_extendedprice") / F.col("l_quantity")).withColumn("place", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")))


def _spent(rows: DataFrame) -> DataFrame:
    """Of each user the observations, what was bought and what it cost."""
    total = lambda f: F.aggregate("obs", F.lit(0.0), lambda s, o: s + f(o))
    sum_ = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    cost = lambda o: sum_(F.zip_with(o["p"], o["q"], lambda p, q: p * q))
    return rows.select("user_id", F.size("obs").cast("long").alias("n_obs"), F.round(total(lambda o: sum_(o["q"])), 2).alias("quantity"), F.round(total(cost), 2).alias("spending"), F.get("obs", F.lit(0))["t"].alias("first"))


def _named(column: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (column % len(names) + 1).cast("int"))


def _text(menus: DataFrame) -> DataFrame:
    join = lambda c: F.concat_ws(",", F.transform(c, lambda i: i.cast("string")))
    return menus.select("user_id", "t", join("menu").alias("menu"), F.col("choice").cast("string").alias("choice"))


def _dunnhumby(spark, d, period=None):
    x = _lines(spark, d)
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")) + 1
    t = x.select(F.col("o_custkey").alias("household_key"), F.col("l_partkey").alias("PRODUCT_ID"), day.alias("DAY"), F.col("l_quantity").alias("QUANTITY"), (F.col("l_extendedprice") / 100).alias("SALES_VALUE"), F.col("l_discount").alias("RETAIL_DISC"), F.col("l_tax").alias("COUPON_DISC"))
    p = market.table(spark, d, "part").select(F.col("p_partkey").alias("PRODUCT_ID"), F.upper("p_type").alias("COMMODITY_DESC"))
    goods = tuple(sorted(r[0] for r in p.select("COMMODITY_DESC").distinct().collect()))
    return _spent(datasets.dunnhumby(t, p, min_weeks=5, period=period, goods=goods[1:]))


def _open_ecommerce(spark, d):
    kind = _named(F.col("l_partkey"), ("Kindle book", "Phone case", "PET TOYS", "Stuff"))
    x = _lines(spark, d).select(F.col("o_custkey").alias("Survey ResponseID"), F.col("o_orderdate").alias("Order Date"), kind.alias("Category"), F.col("l_quantity").alias("Quantity"), (F.col("u") / 10).alias("Purchase Price Per Unit"))
    return _spent(datasets.open_ecommerce(x, top_n=3))


def _invoices(spark, d, names):
    invoice = F.concat(F.when(F.col("l_returnflag") == "R", "C").otherwise(""), F.col("l_orderkey").cast("string"))
    return _lines(spark, d).select(*[c.alias(n) for c, n in zip((invoice, F.col("o_custkey"), F.col("p_brand"), F.col("l_quantity"), F.col("u") / 10, F.col("o_orderdate")), names, strict=True)])


def _olist(spark, d):
    x = _lines(spark, d)
    orders = market.table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderkey").alias("customer_id"), F.when(F.col("o_orderstatus") == "F", "delivered").otherwise("shipped").alias("order_status"), F.col("o_orderdate").alias("order_purchase_timestamp"))
    customers = market.table(spark, d, "orders").select(F.col("o_orderkey").alias("customer_id"), F.col("o_custkey").alias("customer_unique_id"))
    items = x.select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), F.col("u").alias("price"))
    products = market.table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), (F.col("p_partkey") % 6).alias("product_category_name"))
    translation = spark.createDataFrame(list(enumerate(TYPES[:5])), "product_category_name long, product_category_name_english string")
    return _spent(datasets.olist(orders, customers, items, products, translation, n_categories=4))


def _pakistan(spark, d):
    date = F.col("o_orderdate").cast("date")
    x = _lines(spark, d).select(F.when(F.col("l_returnflag") == "A", "Complete ").otherwise("canceled").alias("status"), F.col("o_custkey").cast("string").alias("Customer ID"), F.col("u").cast("string").alias("price"), F.col("l_quantity").cast("string").alias("qty_ordered"), F.col("p_type").alias("category_name_1"), F.year(date).cast("string").alias("Year"), F.month(date).cast("string").alias("Month"))
    return _spent(datasets.pakistan(x, min_months=2))


def _hm(spark, d):
    article = F.concat(F.lpad((F.col("l_partkey") % 25).cast("string"), 2, "0"), F.lit("7000"))
    x = _lines(spark, d).select(F.col("o_orderdate").cast("date").alias("t_dat"), F.col("o_custkey").cast("string").alias("customer_id"), article.alias("article_id"), F.col("u").alias("price"))
    return _spent(datasets.hm(x, max_users=200, min_periods=3, top_k=10, period="quarter"))


def _m5(spark, d, aggregation):
    x = _lines(spark, d).withColumn("item_id", F.col("l_partkey") % 20).withColumn("store_id", F.concat(F.lit("S"), (F.col("l_suppkey") % 8).cast("string"))).withColumn("n", F.dayofmonth(F.col("l_shipdate").cast("date")))
    dept = _named(F.col("item_id"), datasets.DEPARTMENTS)
    x = x.withColumns({"dept_id": dept, "cat_id": F.split_part(dept, F.lit("_"), F.lit(1)), "d": F.concat(F.lit("d_"), F.col("n").cast("string")), "wk": (11100 + F.floor((F.col("n") - 1) / 7)).cast("int")})
    sales = x.groupBy("item_id", "dept_id", "cat_id", "store_id").pivot("d", [f"d_{k}" for k in range(1, 29)]).agg(F.sum("l_quantity"))
    calendar = spark.createDataFrame([(f"d_{k}", 11100 + (k - 1) // 7) for k in range(1, 29)], "d string, wm_yr_wk int")
    prices = x.filter("n <= 28").groupBy("store_id", "item_id", F.col("wk").alias("wm_yr_wk")).agg(F.avg("u").alias("sell_price"))
    return _spent(datasets.m5(calendar, prices, sales, aggregation=aggregation, min_weeks=2))


def _favorita(spark, d):
    items = market.table(spark, d, "part").select(F.col("p_partkey").alias("item_nbr"), _named(F.col("p_partkey"), ("DAIRY", "EGGS", "SEAFOOD", "no family")).alias("family"))
    sales = market.table(spark, d, "lineitem").select(F.col("l_shipdate").alias("date"), F.col("l_suppkey").alias("store_nbr"), F.col("l_partkey").alias("item_nbr"), F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("unit_sales"))
    return _spent(datasets.favorita(items, sales, min_weeks=20))


def _baskets(spark, d):
    """orders, order_products, products, aisles; a product is reordered if an earlier order of the user has it."""
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    orders = market.table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"), number.alias("order_number"), F.when(F.col("o_orderkey") % 50 == 0, "train").otherwise("prior").alias("eval_set"))
    x = _lines(spark, d).select(F.col("l_orderkey").alias("order_id"), (F.col("l_partkey") % 60).alias("product_id"), F.col("place").alias("add_to_cart_order"))
    x = x.groupBy("order_id", "product_id").agg(F.min("add_to_cart_order").alias("add_to_cart_order")).join(orders, "order_id")
    first = F.min("order_number").over(Window.partitionBy("user_id", "product_id"))
    products = spark.range(60).select(F.col("id").alias("product_id"), (F.col("id") % 7).alias("aisle_id"), (F.col("id") % 3).alias("department_id"))
    aisles = spark.createDataFrame(list(enumerate(AISLES)), "aisle_id long, aisle string")
    return orders, x.withColumn("reordered", (F.col("order_number") > first).cast("int")).select("order_id", "product_id", "add_to_cart_order", "reordered"), products, aisles


def _seen(spark, d):
    e = market.table(spark, d, "events")
    kind = F.when(F.col("event_type") == "purchase", "buy").when(F.col("event_type").isin("view", "click"), "pv").otherwise("other")
    return e.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), "value", (F.get_json_object("props", "$.k").cast("int") % 10).alias("item"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


def _retailrocket(spark, d):
    e = _seen(spark, d).select(F.col("user_id").alias("visitorid"), F.unix_millis("ts").alias("timestamp"), F.when(F.col("kind") == "buy", "transaction").when(F.col("kind") == "pv", "view").otherwise("addtocart").alias("event"), F.col("item").alias("itemid"))
    return _text(datasets.renumbered(datasets.retailrocket(e, min_sessions=2, gap_minutes=600)))


def _rees46(spark, d):
    e = _seen(spark, d).select(F.when(F.col("kind") == "buy", "purchase").when(F.col("kind") == "pv", "view").otherwise("cart").alias("event_type"), F.col("item").alias("product_id"), "user_id", F.concat_ws("-", F.col("user_id").cast("string"), "day").alias("user_session"))
    return _text(datasets.rees46(e, min_sessions=2))


def _taobao(spark, d, **options):
    e = _seen(spark, d).select("user_id", F.col("item").alias("item_id"), F.col("kind").alias("behavior_type"), F.unix_seconds("ts").alias("timestamp"))
    return _text(datasets.taobao(e, min_sessions=2, **options))


def _yoochoose(spark, d):
    e = _seen(spark, d).withColumn("session_id", F.col("user_id") * 1000 + F.datediff("day", F.lit("2020-01-01")))
    clicks = e.filter("kind = 'pv'").select("session_id", F.col("event_id").alias("timestamp"), F.col("item").alias("item_id"), (F.col("item") % 3).alias("category"))
    return _text(datasets.yoochoose(clicks, e.filter("kind = 'buy'").select("session_id", F.col("item").alias("item_id")), min_sessions=4))


def _kuairec(spark, d):
    return _text(datasets.kuairec(_seen(spark, d).select("user_id", F.col("item").alias("video_id"), F.col("value").alias("watch_ratio"), F.col("day").alias("date")), min_sessions=3))


def _mind(spark, d):
    token = F.concat(F.lit("N-"), F.col("item").cast("string"), F.when(F.col("kind") == "buy", "-1").otherwise("-0"))
    rows = _seen(spark, d).groupBy(F.col("user_id").cast("string").alias("user_id"), "day").agg(F.concat_ws(" ", F.array_sort(F.collect_list(token))).alias("impressions"))
    return _text(datasets.mind(rows.withColumn("impression_id", F.col("day")), min_sessions=2))


def _mind_targets(spark, d):
    m = clicklogs.split(market.daily_menus(market.events(spark, d, 10)))
    kinds = spark.range(10).select(F.col("id").cast("int").alias("item"), (F.col("id") % 4).cast("string").alias("category"))
    return rounded(datasets.mind_targets(m.filter("part = 'train'"), m.filter("part = 'test'"), kinds)).withColumn("engagement", F.col("engagement").cast("long"))


def _tenrec(spark, d):
    rows = _seen(spark, d).select("user_id", F.col("item").alias("item_id"), (F.col("kind") != "other").cast("int").alias("click"), (F.col("kind") == "buy").cast("int").alias("like"), "event_id")
    return _text(datasets.tenrec(rows, order="event_id", min_sessions=3))


def _finn(spark, d):
    rows = _seen(spark, d).groupBy("user_id", "day").agg(F.array_sort(F.collect_set("item")).alias("slate"), F.max("item").alias("click"))
    number = F.datediff("day", F.lit("2020-01-01"))
    return _text(datasets.finn_slates(rows.select("user_id", number.alias("t"), "slate", "click"), min_sessions=3))


QUERIES: dict[str, Query] = {
    "dataset_list": lambda spark, d: datasets.datasets(spark).select("name", "kind", F.size("files").cast("long").alias("n_files")),
    "dataset_dunnhumby": _dunnhumby,
    "dataset_dunnhumby_months": lambda spark, d: _dunnhumby(spark, d, "month"),
    "dataset_open_ecommerce": _open_ecommerce,
    "dataset_uci_retail": lambda spark, d: _spent(datasets.uci_retail(_invoices(spark, d, ("InvoiceNo", "CustomerID", "StockCode", "Quantity", "UnitPrice", "InvoiceDate")), top_n=10)),
    "dataset_online_retail_ii": lambda spark, d: _spent(datasets.online_retail_ii(_invoices(spark, d, ("Invoice", "Customer ID", "StockCode", "Quantity", "Price", "InvoiceDate")), top_n=7)),
    "dataset_olist": _olist,
    "dataset_pakistan": _pakistan,
    "dataset_hm": _hm,
    "dataset_m5_stores": lambda spark, d: _m5(spark, d, "store"),
    "dataset_m5_departments": lambda spark, d: _m5(spark, d, "store_dept"),
    "dataset_favorita": _favorita,
    "dataset_instacart": lambda spark, d: _spent(datasets.instacart(*_baskets(spark, d), min_orders=6)),
    "dataset_retailrocket": _retailrocket,
    "dataset_rees46": _rees46,
    "dataset_taobao": lambda spark, d: _taobao(spark, d, gap_seconds=36_000),
    "dataset_taobao_windows": lambda spark, d: _taobao(spark, d, mode="buy_window", window_seconds=172_800),
    "dataset_yoochoose": _yoochoose,
    "dataset_instacart_menu": lambda spark, d: _text(datasets.instacart_menus(*_baskets(spark, d)[:3], min_sessions=2)),
    "dataset_instacart_menu_v2": lambda spark, d: _text(datasets.instacart_reorders(*_baskets(spark, d)[:3], min_sessions=2, min_pair_events=2)),
    "dataset_kuairec": _kuairec,
    "dataset_mind": _mind,
    "dataset_mind_targets": _mind_targets,
    "dataset_tenrec": _tenrec,
    "dataset_finn_slates": _finn,
    "dataset_retailrocket_summary": lambda spark, d: rounded(clicklogs.summary(datasets.retailrocket(_seen(spark, d).select(F.col("user_id").alias("visitorid"), F.unix_millis("ts").alias("timestamp"), F.when(F.col("kind") == "buy", "transaction").when(F.col("kind") == "pv", "view").otherwise("addtocart").alias("event"), F.col("item").alias("itemid")), min_sessions=2, gap_minutes=600))),
}

_LINES = """
WITH lines AS (
  SELECT *, l_extendedprice / l_quantity AS u, strftime(o_orderdate::DATE, '%Y-%m') AS month, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_quantity) AS place
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
)"""


def _panel(raw: str, least: int, goods: str = "TRUE", own: str = "NULL", grid_user: str = "") -> str:
    """What users spend who have ``least`` periods, from CTE text that ends with ``raw`` (user_id, t, item, quantity, unit)."""
    return _LINES + raw + f"""
, kept AS (SELECT * FROM raw WHERE {goods}),
prices AS (SELECT t, item, median(unit) AS price FROM kept GROUP BY t, item),
cells AS (SELECT user_id, t, item, sum(quantity) AS quantity, {own} AS own FROM kept GROUP BY user_id, t, item),
active AS (SELECT user_id, t, sum(quantity) AS quantity, sum(quantity * coalesce(own, price)) AS spending FROM cells JOIN prices USING (t, item) GROUP BY user_id, t HAVING sum(quantity) > 0)
SELECT user_id, count(*) AS n_obs, round(sum(quantity), 2) AS quantity, round(sum(spending), 2) AS spending, min(t) AS first FROM active GROUP BY user_id HAVING count(*) >= {least}"""


def _top(n: int) -> str:
    return f"item IN (SELECT item FROM raw GROUP BY item ORDER BY count(*) DESC, item LIMIT {n})"


_DUNNHUMBY = """
, types AS (SELECT DISTINCT upper(p_type) AS g FROM part ORDER BY g OFFSET 1),
raw AS (SELECT 'household_' || o_custkey AS user_id, lpad(CAST(CAST(floor(date_diff('day', DATE '1992-01-01', o_orderdate::DATE) / 7) AS BIGINT) + 1 AS VARCHAR), 4, '0') AS t, upper(p_type) AS item, l_quantity AS quantity, (l_extendedprice / 100 - l_discount - l_tax) / l_quantity AS unit
  FROM lines WHERE upper(p_type) IN (SELECT g FROM types) AND (l_extendedprice / 100 - l_discount - l_tax) / l_quantity BETWEEN 0.01 AND 50.0)"""
_INVOICES = """
, raw AS (SELECT 'customer_' || o_custkey AS user_id, month AS t, p_brand AS item, l_quantity AS quantity, u / 10 AS unit FROM lines WHERE l_returnflag <> 'R' AND u / 10 BETWEEN 0.01 AND 500.0)"""
_M5 = """
, x AS (SELECT *, l_partkey % 20 AS item_id, 'S' || (l_suppkey % 8) AS store_id, day(l_shipdate::DATE) AS n FROM lines WHERE day(l_shipdate::DATE) <= 28),
y AS (SELECT *, ['FOODS_1', 'FOODS_2', 'FOODS_3', 'HOBBIES_1', 'HOBBIES_2', 'HOUSEHOLD_1', 'HOUSEHOLD_2'][item_id % 7 + 1] AS dept_id, CAST(11100 + (n - 1) // 7 AS VARCHAR) AS t FROM x),
p AS (SELECT store_id, item_id, dept_id, t, avg(u) AS price, sum(l_quantity) AS units FROM y GROUP BY store_id, item_id, dept_id, t),
c AS (SELECT {user} AS user_id, {item} AS item, t, sum(units) AS quantity, avg(price) AS price FROM p GROUP BY ALL),
weeks AS (SELECT user_id, t, sum(quantity) AS quantity, sum(quantity * price) AS spending FROM c GROUP BY user_id, t HAVING sum(quantity) > 0)
SELECT user_id, count(*) AS n_obs, round(sum(quantity), 2) AS quantity, round(sum(spending), 2) AS spending, min(t) AS first FROM weeks GROUP BY user_id HAVING count(*) >= 2"""
_BASKETS = _LINES + """
, o AS (SELECT o_orderkey AS order_id, o_custkey AS user_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS order_number, o_orderkey % 50 <> 0 AS prior FROM orders),
op AS (SELECT l_orderkey AS order_id, l_partkey % 60 AS product_id, min(place) AS place FROM lines GROUP BY ALL),
r AS (SELECT op.*, o.user_id, o.order_number, o.prior, o.order_number > min(o.order_number) OVER (PARTITION BY o.user_id, product_id) AS again, product_id % 7 AS aisle_id, product_id % 3 AS dept FROM op JOIN o USING (order_id))"""
_SEEN = """
WITH seen AS (
  SELECT user_id, event_id, ts, CASE WHEN event_type = 'purchase' THEN 'buy' WHEN event_type IN ('view', 'click') THEN 'pv' ELSE 'other' END AS kind, value, CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS item, strftime(ts, '%Y-%m-%d') AS day FROM events
)"""


def _menus(least: int, smallest: int = 2, largest: int = 50) -> str:
    """Rows of users with ``least`` menus, from m (user_id, t, menu, choice)."""
    return f"""
, fit AS (SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(t AS VARCHAR) AS t, menu, choice FROM m WHERE len(menu) BETWEEN {smallest} AND {largest}),
kept AS (SELECT * FROM fit WHERE user_id IN (SELECT user_id FROM fit GROUP BY user_id HAVING count(*) >= {least}))"""


_ROWS = " SELECT user_id, t, array_to_string(menu, ',') AS menu, CAST(choice AS VARCHAR) AS choice FROM kept"
_VISITS = _SEEN + """
, marked AS (SELECT *, coalesce(epoch_ms(ts) - epoch_ms(lag(ts) OVER w) > 36000000, FALSE) AS late FROM seen WINDOW w AS (PARTITION BY user_id ORDER BY epoch_ms(ts))),
numbered AS (SELECT *, CAST(sum(CAST(late AS INTEGER)) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) RANGE UNBOUNDED PRECEDING) AS BIGINT) AS session FROM marked),
m AS (SELECT user_id, session AS t, list_sort(list_distinct(list(item))) AS menu, max(item) FILTER (kind = 'buy') AS choice FROM numbered WHERE kind <> 'other' GROUP BY user_id, session HAVING count(*) FILTER (kind = 'buy') = 1)""" + _menus(2)

ORACLE_SQL: dict[str, str] = {
    "dataset_list": "SELECT * FROM (VALUES "
    + ", ".join(f"('{n}', '{k}', CAST({f} AS BIGINT))" for n, k, f in (
        ("dunnhumby", "budgets", 2), ("open_ecommerce", "budgets", 1), ("uci_retail", "budgets", 1), ("online_retail_ii", "budgets", 1), ("olist", "budgets", 5), ("pakistan", "budgets", 1), ("hm", "budgets", 1), ("m5", "budgets", 3),
        ("favorita", "budgets", 2), ("instacart", "budgets", 4), ("retailrocket", "menus", 1), ("rees46", "menus", 1), ("taobao", "menus", 1), ("yoochoose", "menus", 2), ("instacart_menu", "menus", 3), ("instacart_menu_v2", "menus", 3),
        ("kuairec", "menus", 1), ("mind", "menus", 1), ("tenrec", "menus", 1), ("finn_slates", "menus", 1), ("demo", "budgets", 0),
    )) + ") t(name, kind, n_files)",
    "dataset_dunnhumby": _panel(_DUNNHUMBY, 5),
    "dataset_dunnhumby_months": (_LINES + _DUNNHUMBY + """
, prices AS (SELECT t, item, median(unit) AS price FROM raw GROUP BY t, item),
weeks AS (SELECT user_id || '__period_' || ((CAST(t AS BIGINT) - 1) // 4 + 1) AS user_id, t, sum(quantity) AS quantity, sum(quantity * price) AS spending FROM raw JOIN prices USING (t, item) GROUP BY ALL)
SELECT user_id, count(*) AS n_obs, round(sum(quantity), 2) AS quantity, round(sum(spending), 2) AS spending, min(t) AS first FROM weeks GROUP BY user_id HAVING count(*) >= 2"""),
    "dataset_open_ecommerce": _panel("""
, raw AS (SELECT 'user_' || o_custkey AS user_id, month AS t, ['Books', 'Electronics', 'Toys & Games', 'Other'][l_partkey % 4 + 1] AS item, l_quantity AS quantity, u / 10 AS unit FROM lines WHERE u / 10 BETWEEN 0.01 AND 1000)""", 5, _top(3), "median(unit)"),
    "dataset_uci_retail": _panel(_INVOICES, 5, _top(10)),
    "dataset_online_retail_ii": _panel(_INVOICES, 4, _top(7)),
    "dataset_olist": _panel("""
, sold AS (SELECT 'customer_' || o_custkey AS user_id, o_orderkey, month AS t, ['toys', 'auto', 'baby', 'stationery', 'tv', NULL][l_partkey % 6 + 1] AS item, 1.0 AS quantity, u AS unit FROM lines WHERE o_orderstatus = 'F' AND u BETWEEN 0.01 AND 5000),
four AS (SELECT * FROM sold WHERE item IN ('toys', 'auto', 'baby', 'stationery')),
raw AS (SELECT * FROM four WHERE user_id IN (SELECT user_id FROM four GROUP BY user_id HAVING count(DISTINCT o_orderkey) >= 3))""", 2),
    "dataset_pakistan": _panel("""
, raw AS (SELECT 'customer_' || o_custkey AS user_id, month AS t, p_type AS item, l_quantity AS quantity, u AS unit FROM lines WHERE l_returnflag = 'A' AND u BETWEEN 0.01 AND 500000)""", 2),
    "dataset_hm": _panel("""
, everything AS (SELECT CAST(o_custkey AS VARCHAR) AS c, strftime(date_trunc('quarter', o_orderdate::DATE), '%Y-%m-%d') AS t, lpad(CAST(l_partkey % 25 AS VARCHAR), 2, '0') AS item, 1.0 AS quantity, u AS unit FROM lines),
raw AS (SELECT 'customer_' || c AS user_id, t, item, quantity, unit FROM everything WHERE c IN (SELECT c FROM everything GROUP BY c ORDER BY count(*) DESC, c LIMIT 200)
  AND item IN (SELECT item FROM everything GROUP BY item ORDER BY count(*) DESC, item LIMIT 10))""", 3, own="avg(unit)"),
    "dataset_m5_stores": _LINES + _M5.format(user="store_id", item="dept_id"),
    "dataset_m5_departments": _LINES + _M5.format(user="store_id || '__' || dept_id", item="split_part(dept_id, '_', 1)"),
    "dataset_favorita": """
WITH raw AS (SELECT 'store_' || l_suppkey AS user_id, strftime(l_shipdate::DATE, '%G-%V') AS t, greatest(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END, 0) AS q FROM lineitem WHERE l_partkey % 4 <> 3),
weeks AS (SELECT user_id, t, sum(q) AS q FROM raw GROUP BY user_id, t HAVING sum(q) > 0)
SELECT user_id, count(*) AS n_obs, round(sum(q), 2) AS quantity, round(sum(q), 2) AS spending, min(t) AS first FROM weeks GROUP BY user_id HAVING count(*) >= 20""",
    "dataset_instacart": _BASKETS + """
, often AS (SELECT user_id FROM o WHERE prior GROUP BY user_id HAVING count(*) >= 6),
w AS (SELECT user_id, lpad(CAST(order_number AS VARCHAR), 6, '0') AS t, count(*) AS q, sum([2.5, 5.0, 2.0, 4.5, 10.0, 3.0, 3.0][aisle_id + 1]) AS s FROM r WHERE prior AND user_id IN (SELECT user_id FROM often) GROUP BY user_id, order_number)
SELECT 'user_' || user_id AS user_id, count(*) AS n_obs, round(CAST(sum(q) AS DOUBLE), 2) AS quantity, round(CAST(sum(s) AS DOUBLE), 2) AS spending, min(t) AS first FROM w GROUP BY user_id HAVING count(*) >= 6""",
    "dataset_retailrocket": _VISITS + """
, known AS (SELECT user_id, list_sort(list_distinct(flatten(list(menu)))) AS known FROM kept GROUP BY user_id)
SELECT user_id, t, array_to_string(list_transform(menu, lambda i: list_position(known, i) - 1), ',') AS menu, CAST(list_position(known, choice) - 1 AS VARCHAR) AS choice FROM kept JOIN known USING (user_id)""",
    "dataset_retailrocket_summary": _VISITS + """
, u AS (SELECT user_id, count(*) AS n FROM kept GROUP BY user_id)
SELECT a.*, b.* FROM (SELECT count(*) AS n_users, CAST(sum(n) AS BIGINT) AS n_menus, round(avg(n), 6) AS mean_menus, median(n) AS median_menus FROM u) a, (SELECT round(avg(len(menu)), 6) AS mean_size, median(len(menu)) AS median_size, count(DISTINCT choice) AS n_chosen FROM kept) b""",
    "dataset_rees46": _SEEN + """
, m AS (SELECT user_id, user_id || '-' || day AS t, list_sort(list_distinct(list(item))) AS menu, max(item) FILTER (kind = 'buy') AS choice FROM seen WHERE kind <> 'other' GROUP BY user_id, day HAVING count(*) FILTER (kind = 'buy') = 1 AND count(*) FILTER (kind = 'pv') > 0)""" + _menus(2) + _ROWS,
    "dataset_taobao": _SEEN + """
, shown AS (SELECT *, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s FROM seen WHERE kind <> 'other'),
marked AS (SELECT *, coalesce(s - lag(s) OVER w > 36000, FALSE) AS late FROM shown WINDOW w AS (PARTITION BY user_id ORDER BY s)),
numbered AS (SELECT *, CAST(sum(CAST(late AS INTEGER)) OVER (PARTITION BY user_id ORDER BY s RANGE UNBOUNDED PRECEDING) AS BIGINT) AS session FROM marked),
m AS (SELECT user_id, session AS t, list_sort(list_distinct(list(item))) AS menu, max(item) FILTER (kind = 'buy') AS choice FROM numbered GROUP BY user_id, session HAVING count(DISTINCT item) FILTER (kind = 'buy') = 1 AND count(*) FILTER (kind = 'pv') > 0)""" + _menus(2) + _ROWS,
    "dataset_taobao_windows": _SEEN + """
, s AS (SELECT *, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s FROM seen),
m AS (SELECT b.user_id, b.s || '/' || b.item AS t, list_sort(list_distinct(list(v.item))) AS menu, b.item AS choice FROM s b JOIN s v ON v.user_id = b.user_id AND v.kind = 'pv' AND v.s BETWEEN b.s - 172800 AND b.s - 1 WHERE b.kind = 'buy' GROUP BY b.user_id, b.event_id, b.s, b.item HAVING list_contains(list(v.item), b.item))""" + _menus(2) + _ROWS,
    "dataset_yoochoose": _SEEN + """
, e AS (SELECT *, user_id * 1000 + date_diff('day', DATE '2020-01-01', day::DATE) AS sid FROM seen), b AS (SELECT sid, max(item) AS choice FROM e WHERE kind = 'buy' GROUP BY sid HAVING count(DISTINCT item) = 1),
c AS (SELECT sid, list(item) AS items, arg_min(item % 3, event_id) AS category FROM e WHERE kind = 'pv' GROUP BY sid),
f AS (SELECT lpad(CAST(sid AS VARCHAR), 12, '0') AS t, category, list_sort(list_distinct(list_append(items, choice))) AS menu, choice FROM c JOIN b USING (sid)),
n AS (SELECT *, (row_number() OVER (PARTITION BY category ORDER BY t) - 1) // 8 AS k FROM f WHERE len(menu) BETWEEN 2 AND 50),
m AS (SELECT category || '-' || k AS user_id, t, menu, choice FROM n)""" + _menus(4) + _ROWS,
    "dataset_instacart_menu": _BASKETS + """
, d AS (SELECT user_id, dept, count(*) AS n FROM r WHERE again GROUP BY ALL), best AS (SELECT user_id, arg_max(dept, n * 10 - dept) AS dept FROM d GROUP BY user_id),
k AS (SELECT user_id, order_number, list(product_id) AS basket, arg_min(product_id, place) AS choice FROM r JOIN best USING (user_id, dept) GROUP BY user_id, order_number),
m AS (SELECT a.user_id, lpad(CAST(a.order_number AS VARCHAR), 6, '0') AS t, list_sort(list_distinct(flatten(list(b.basket)))) AS menu, any_value(a.choice) AS choice FROM k a JOIN k b ON a.user_id = b.user_id AND b.order_number < a.order_number GROUP BY a.user_id, a.order_number HAVING list_contains(flatten(list(b.basket)), any_value(a.choice)))""" + _menus(2, 3, 30) + _ROWS,
    "dataset_instacart_menu_v2": _BASKETS + """
, k AS (SELECT user_id, aisle_id, order_number, list(product_id) AS basket, count(*) FILTER (again) AS n, max(product_id) FILTER (again) AS choice, row_number() OVER (PARTITION BY user_id, aisle_id ORDER BY order_number) AS seq FROM r GROUP BY user_id, aisle_id, order_number),
f AS (SELECT a.user_id, a.aisle_id, lpad(CAST(a.order_number AS VARCHAR), 6, '0') || '/' || a.aisle_id AS t, list_sort(list_distinct(list_append(flatten(list(b.basket)), any_value(a.choice)))) AS menu, any_value(a.choice) AS choice
  FROM k a JOIN k b ON a.user_id = b.user_id AND a.aisle_id = b.aisle_id AND b.seq BETWEEN a.seq - 3 AND a.seq - 1 WHERE a.n = 1 GROUP BY a.user_id, a.aisle_id, a.order_number),
g AS (SELECT * FROM f WHERE len(menu) >= 2), m AS (SELECT g.* FROM g JOIN (SELECT user_id, aisle_id FROM g GROUP BY ALL HAVING count(*) >= 2) USING (user_id, aisle_id))""" + _menus(2, 2, 1 << 30) + _ROWS,
    "dataset_kuairec": _SEEN + """
, fit AS (SELECT CAST(user_id AS VARCHAR) AS user_id, day AS t, list_sort(list_distinct(list(item))) AS menu, first(item ORDER BY value DESC, item) AS choice FROM seen GROUP BY user_id, day HAVING count(*) BETWEEN 2 AND 50),
kept AS (SELECT * FROM fit WHERE user_id IN (SELECT user_id FROM fit GROUP BY user_id HAVING count(*) >= 3))""" + _ROWS,
    "dataset_mind": _SEEN + """
, fit AS (SELECT CAST(user_id AS VARCHAR) AS user_id, day AS t, list_sort(list_distinct(list('N-' || item))) AS menu, 'N-' || max(item) FILTER (kind = 'buy') AS choice FROM seen GROUP BY user_id, day HAVING count(*) FILTER (kind = 'buy') = 1 AND count(*) BETWEEN 2 AND 200),
kept AS (SELECT * FROM fit WHERE user_id IN (SELECT user_id FROM fit GROUP BY user_id HAVING count(*) >= 2))""" + _ROWS,
    "dataset_mind_targets": "WITH RECURSIVE " + market.MENU_SQL.format(items=10) + """
, r AS (SELECT user_id, t, choice, (row_number() OVER (PARTITION BY user_id ORDER BY t) - 1) / count(*) OVER (PARTITION BY user_id) < 0.8 AS old FROM menus),
a AS (SELECT user_id, list_distinct(list(choice)) AS old FROM r WHERE old GROUP BY user_id), b AS (SELECT user_id, count(*) AS n, list_distinct(list(choice)) AS new FROM r WHERE NOT old GROUP BY user_id),
c AS (SELECT user_id, choice % 4 AS k, count(*) AS c FROM r WHERE NOT old GROUP BY ALL), e AS (SELECT user_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM c GROUP BY user_id)
SELECT user_id, coalesce(n, 0) AS engagement, round(coalesce(len(list_filter(new, lambda x: NOT list_contains(old, x))) / len(new), 0.0), 6) AS novelty, round(coalesce(e, 0.0), 6) AS entropy FROM a LEFT JOIN b USING (user_id) LEFT JOIN e USING (user_id)""",
    "dataset_tenrec": _SEEN + """
, g AS (SELECT *, coalesce(sum(CAST(kind = 'buy' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM seen WHERE kind <> 'other'),
m AS (SELECT user_id, lpad(CAST(CAST(k AS BIGINT) AS VARCHAR), 9, '0') AS t, list_sort(list_distinct(list(item))) AS menu, max(item) FILTER (kind = 'buy') AS choice FROM g GROUP BY user_id, k HAVING max(item) FILTER (kind = 'buy') IS NOT NULL)""" + _menus(3) + _ROWS,
    "dataset_finn_slates": _SEEN + """
, m AS (SELECT user_id, lpad(CAST(date_diff('day', DATE '2020-01-01', day::DATE) AS VARCHAR), 6, '0') AS t, list_sort(list_distinct(list(item) FILTER (item >= 3))) AS menu, max(item) AS choice FROM seen GROUP BY user_id, day HAVING max(item) >= 3)""" + _menus(3) + _ROWS,
}
