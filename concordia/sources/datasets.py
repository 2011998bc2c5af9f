"""Public purchase and click-stream data sets as budget rows (user_id, obs) or menus (user_id, t, menu, choice).

Each function takes the data set's own tables as DataFrames, with their own column names;
``load`` reads them from a folder.  Budgets are those of purchases by user, period and
category at a grid of median prices (the last known price, else the next, else one);
periods without a purchase and users with few periods go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordia import errors
from concordia.sources import clicklogs, files, market

# ---------------------------------------------------------------- fixed values: lists and bounds that results have to agree on
COMMODITIES = ("SOFT DRINKS", "FLUID MILK PRODUCTS", "BAKED BREAD/BUNS/ROLLS", "CHEESE", "BAG SNACKS", "SOUP", "YOGURT", "BEEF", "FROZEN PIZZA", "LUNCHMEAT")
MARKETPLACE_CATEGORIES = (
    "bed_bath_table", "health_beauty", "sports_leisure", "furniture_decor", "computers_accessories", "housewares", "watches_gifts", "telephony", "garden_tools", "auto",
    "toys", "cool_stuff", "perfumery", "baby", "electronics", "stationery", "fashion_bags_accessories", "pet_shop", "office_furniture", "luggage_accessories",
)
DEPARTMENTS = ("FOODS_1", "FOODS_2", "FOODS_3", "HOBBIES_1", "HOBBIES_2", "HOUSEHOLD_1", "HOUSEHOLD_2")
SALES_CATEGORIES = ("FOODS", "HOBBIES", "HOUSEHOLD")
FAMILIES = (
    "AUTOMOTIVE", "BABY CARE", "BEAUTY", "BEVERAGES", "BOOKS", "BREAD/BAKERY", "CELEBRATION", "CLEANING", "DAIRY", "DELI", "EGGS", "FROZEN FOODS", "GROCERY I", "GROCERY II", "HARDWARE",
    "HOME AND KITCHEN", "HOME APPLIANCES", "HOME CARE", "LADIESWEAR", "LAWN AND GARDEN", "LINGERIE", "LIQUOR,WINE,BEER", "MAGAZINES", "MEATS", "PERSONAL CARE", "PET SUPPLIES",
    "PLAYERS AND ELECTRONICS", "POULTRY", "PREPARED FOODS", "PRODUCE", "SCHOOL AND OFFICE SUPPLIES", "SEAFOOD", "STATIONERY",
)
#: Words in a raw category and the group that the first of them gives.
CATEGORY_WORDS = (
    ("book", "Books"), ("kindle", "Books"), ("electronic", "Electronics"), ("computer", "Electronics"), ("phone", "Electronics"), ("clothing", "Clothing"), ("apparel", "Clothing"), ("shoe", "Clothing"),
    ("home", "Home & Garden"), ("garden", "Home & Garden"), ("kitchen", "Home & Garden"), ("grocery", "Grocery"), ("food", "Grocery"), ("gourmet", "Grocery"), ("health", "Health & Beauty"),
    ("beauty", "Health & Beauty"), ("personal care", "Health & Beauty"), ("toy", "Toys & Games"), ("game", "Toys & Games"), ("sport", "Sports & Outdoors"), ("outdoor", "Sports & Outdoors"),
    ("baby", "Baby Products"), ("pet", "Pet Supplies"), ("office", "Office Products"), ("automotive", "Automotive"), ("tool", "Tools & Home Improvement"), ("music", "Music & Entertainment"),
    ("movie", "Music & Entertainment"), ("video", "Music & Entertainment"),
)
#: Words in an aisle's name and its price, the first line that fits; others cost OTHER_AISLES.
AISLE_PRICES = (
    ("spirit", 14.00),
    ("champagne", "specialty wine", 12.00),
    ("red wine", "white wine", 10.00),
    ("beer", "cooler", 8.00),
    ("seafood counter", 8.00),
    ("packaged seafood", "canned meat seafood", 5.50),
    ("meat counter", "packaged meat", 6.00),
    ("poultry counter", "packaged poultry", 5.50),
    ("hot dog", "bacon", "sausage", 5.00),
    ("lunch meat", 4.50),
    ("frozen meat", 6.00),
    ("vitamin", "supplement", 8.00),
    ("baby food", "formula", 5.00),
    ("baby accessor", 6.00),
    ("baby bath", 5.50),
    ("diaper", "wipe", 7.00),
    ("first aid", 6.00),
    ("cold flu", "allergy", "muscles joints", "pain relief", 6.50),
    ("oral hygiene", 4.50),
    ("hair care", 6.00),
    ("skin care", "facial care", 6.50),
    ("body lotion", "soap", 5.50),
    ("deodorant", 4.50),
    ("shave", 5.50),
    ("feminine care", 5.00),
    ("eye ear care", 5.50),
    ("beauty", 6.00),
    ("digestion", 6.00),
    ("specialty cheese", 6.00),
    ("packaged cheese", "other cream", "cheese", 5.00),
    ("ice cream", 4.50),
    ("cream", 3.50),
    ("butter", 3.50),
    ("yogurt", 3.00),
    ("milk", 3.00),
    ("soy lactosefree", 3.50),
    ("egg", 3.00),
    ("pudding", 3.00),
    ("frozen pizza", 5.00),
    ("frozen meal", 4.50),
    ("frozen appetizer", "frozen side", 4.00),
    ("frozen breakfast", 3.50),
    ("frozen bread", "frozen dough", 3.50),
    ("frozen vegan", "frozen vegetarian", 4.50),
    ("frozen juice", 3.00),
    ("frozen produce", 3.00),
    ("frozen dessert", 4.00),
    ("bakery dessert", 4.00),
    ("bread", 3.00),
    ("bun", "roll", "tortilla", "flat bread", 3.00),
    ("breakfast bar", "pastri", 3.50),
    ("breakfast bakery", 3.00),
    ("bulk", 3.00),
    ("fresh fruit", 2.50),
    ("fresh vegetable", 2.00),
    ("fresh herb", 2.50),
    ("fresh pasta", 3.00),
    ("fresh dip", "tapenade", 3.50),
    ("packaged produce", "packaged vegetable", "packaged fruit", 3.00),
    ("honey", "syrup", 3.50),
    ("energy granola", 3.00),
    ("energy sport", 3.00),
    ("protein", "meal replacement", 5.00),
    ("juice", "nectar", 3.00),
    ("water", "seltzer", "sparkling", 2.00),
    ("soft drink", 2.50),
    ("coffee", 4.00),
    ("tea", 3.00),
    ("cocoa", "drink mix", 3.00),
    ("chip", "pretzel", 3.50),
    ("popcorn", "jerky", 3.50),
    ("cookie", " cake", 3.50),
    ("candy", "chocolate", 3.00),
    ("cracker", 3.00),
    ("mint", "gum", 2.00),
    ("trail mix", "snack mix", 3.50),
    ("fruit vegetable snack", 3.00),
    ("nut", "seed", "dried fruit", 3.50),
    ("granola", 3.50),
    ("canned meal", "bean", 2.00),
    ("canned jarred vegetable", 2.00),
    ("canned fruit", "applesauce", 2.00),
    ("prepared soup", "prepared salad", 3.50),
    ("soup", "broth", "bouillon", 2.50),
    ("prepared meal", 4.50),
    ("pasta sauce", 2.50),
    ("dry pasta", 1.50),
    ("grain", "rice", "dried good", 2.50),
    ("baking ingredient", "baking supplie", "baking decor", 2.50),
    ("dough", "gelatin", "bake mix", 2.50),
    ("spice", "season", 3.00),
    ("condiment", 2.50),
    ("salad dressing", "topping", 3.00),
    ("oil", "vinegar", 3.50),
    ("spread", 3.00),
    ("preserved dip", 3.00),
    ("pickle", "olive", 3.00),
    ("marinade", "meat preparation", 3.00),
    ("hot cereal", "pancake mix", 3.00),
    ("cereal", 3.50),
    ("instant food", 2.50),
    ("tofu", "meat alternative", 3.50),
    ("latino", 2.50),
    ("asian", 2.50),
    ("indian", 2.50),
    ("kosher", 3.00),
    ("cleaning product", 4.00),
    ("dish detergent", 3.50),
    ("laundry", 5.00),
    ("trash bag", "liner", 4.00),
    ("paper good", 4.50),
    ("air freshener", "candle", 3.50),
    ("food storage", 3.50),
    ("plate", "bowl", "cup", "flatware", 3.00),
    ("kitchen supplie", 3.00),
    ("more household", 3.50),
    ("dog food", "dog care", 5.00),
    ("cat food", "cat care", 5.00),
    ("pet", 5.00),
    ("refrigerated", 3.00),
    ("other", 3.00),
    ("missing", 3.00),
)
OTHER_AISLES = 3.00
SMALLEST_MENU, LARGEST_MENU, LARGEST_IMPRESSION = 2, 50, 200
#: Cells of a price grid that are broadcast at most; a larger grid is shuffled.
MAX_CELLS = 200_000


# ---------------------------------------------------------------- budgets
def panel(rows: DataFrame, goods: list[str] | None = None, *, min_periods: int = 1, grid: DataFrame | None = None, own_price: str | None = None) -> DataFrame:
    """Budget rows from purchases (user_id, t, item, quantity, unit), over ``goods`` or all items in order.

    ``grid`` (t, item, price) is that of median units unless given; with ``own_price`` (``median`` or
    ``mean``) a user's own unit price of the period and item comes first.
    """
    if goods is None:
        goods = sorted(r["item"] for r in rows.select("item").distinct().collect())
    if not goods:
        return rows.sparkSession.createDataFrame([], "user_id string, obs array<struct<t:string,p:array<double>,q:array<double>>>")
    names = F.array(*[F.lit(g) for g in goods])
    rows = rows.filter(F.array_contains(names, F.col("item")))
    if grid is None:
        grid = market.fill_grid(rows.groupBy("t", "item").agg(F.percentile("unit", 0.5).alias("price")))
    by_t = grid.groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("item", "price"))).alias("market"))
    if grid.count() <= MAX_CELLS:
        by_t = F.broadcast(by_t)  # just counted
    own = {"median": F.percentile("unit", 0.5), "mean": F.avg("unit")}.get(own_price, F.lit(None).cast("double"))
    cells = rows.groupBy("user_id", "t", "item").agg(F.sum("quantity").cast("double").alias("quantity"), own.alias("own"))
    cells = cells.groupBy("user_id", "t").agg(F.map_from_entries(F.collect_list(F.struct("item", F.struct("quantity", "own").alias("v")))).alias("cell"), F.sum("quantity").alias("all"))
    cells = cells.filter(F.col("all") > 0).join(by_t, "t")
    q = F.transform(names, lambda g: F.coalesce(F.element_at("cell", g)["quantity"], F.lit(0.0)))
    p = F.transform(names, lambda g: F.coalesce(F.element_at("cell", g)["own"], F.element_at("market", g), F.lit(1.0)))
    obs = cells.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.col("t").cast("string").alias("t"), p.alias("p"), q.alias("q")))).alias("obs"))
    return obs.filter(F.size("obs") >= min_periods)


def top(rows: DataFrame, n: int, column: str = "item") -> list[str]:
    """The ``n`` values of most rows, then by name."""
    found = rows.filter(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.col("count").desc(), column).limit(n).collect()
    return sorted(r[column] for r in found)


def _month(c: Column) -> Column:
    return F.date_format(c.cast("timestamp"), "yyyy-MM")


def dunnhumby(transactions: DataFrame, products: DataFrame, *, min_weeks: int = 10, period: str | None = None, goods: tuple[str, ...] = COMMODITIES) -> DataFrame:
    """Household weeks over ten commodities; with ``period="month"`` an entry for each four weeks, of two weeks at least."""
    unit = (F.col("SALES_VALUE") - F.col("RETAIL_DISC") - F.col("COUPON_DISC")) / F.col("QUANTITY")
    week = F.floor((F.col("DAY") - 1) / 7) + 1
    rows = transactions.filter(F.col("QUANTITY") > 0).join(products.select("PRODUCT_ID", F.col("COMMODITY_DESC").alias("item")), "PRODUCT_ID")
    rows = rows.filter(F.col("item").isin(*goods)).select(F.concat(F.lit("household_"), F.col("household_key").cast("string")).alias("user_id"), F.lpad(week.cast("string"), 4, "0").alias("t"), "item", F.col("QUANTITY").alias("quantity"), unit.alias("unit"))
    rows = rows.filter(F.col("unit").between(0.01, 50.0))
    if period != "month":
        return panel(rows, list(goods), min_periods=min_weeks)
    grid = market.fill_grid(rows.groupBy("t", "item").agg(F.percentile("unit", 0.5).alias("price")))
    month = F.floor((F.col("t").cast("int") - 1) / 4) + 1
    return panel(rows.withColumn("user_id", F.concat("user_id", F.lit("__period_"), month.cast("string"))), list(goods), min_periods=2, grid=grid)


def open_ecommerce(purchases: DataFrame, *, min_observations: int = 5, top_n: int = 50) -> DataFrame:
    """Months over groups of categories; own prices first."""
    raw = F.lower(F.coalesce(F.col("Category").cast("string"), F.lit("nan")))
    group = F.coalesce(*[F.when(raw.contains(word), F.lit(name)) for word, name in CATEGORY_WORDS], F.lit("Other"))
    price = F.col("`Purchase Price Per Unit`").cast("double")
    rows = purchases.select(F.concat(F.lit("user_"), F.col("`Survey ResponseID`").cast("string")).alias("user_id"), _month(F.col("`Order Date`")).alias("t"), group.alias("item"), F.col("Quantity").cast("double").alias("quantity"), price.alias("unit"))
    rows = rows.filter(F.col("t").isNotNull() & F.col("unit").between(0.01, 1000.0) & (F.col("quantity") > 0))
    return panel(rows, top(rows, top_n), min_periods=min_observations, own_price="median")


def _invoices(sales: DataFrame, invoice: str, customer: str, price: str) -> DataFrame:
    """Lines of invoices that aren't cancelled, with a customer, a date and a price."""
    rows = sales.filter(~F.col(f"`{invoice}`").cast("string").startswith("C") & F.col(f"`{customer}`").isNotNull())
    rows = rows.select(
        F.concat(F.lit("customer_"), F.col(f"`{customer}`").cast("double").cast("long").cast("string")).alias("user_id"), _month(F.col("InvoiceDate")).alias("t"),
        F.col("StockCode").cast("string").alias("item"), F.col("Quantity").cast("double").alias("quantity"), F.col(price).cast("double").alias("unit"),
    )
    return rows.filter(F.col("t").isNotNull() & F.col("unit").between(0.01, 500.0) & (F.col("quantity") > 0))


def uci_retail(sales: DataFrame, *, min_transactions: int = 5, top_n: int = 50) -> DataFrame:
    rows = _invoices(sales, "InvoiceNo", "CustomerID", "UnitPrice")
    return panel(rows, top(rows, top_n), min_periods=min_transactions)


def online_retail_ii(sales: DataFrame, *, min_months: int = 4, top_n: int = 30) -> DataFrame:
    rows = _invoices(sales, "Invoice", "Customer ID", "Price")
    return panel(rows, top(rows, top_n), min_periods=min_months)


def olist(orders: DataFrame, customers: DataFrame, items: DataFrame, products: DataFrame, translation: DataFrame, *, min_months: int = 2, min_orders: int = 3, n_categories: int = 20) -> DataFrame:
    """Months over categories of customers with several delivered orders; each item counts one.

    Categories are those of the list that occur, in its order, then others by how often they do.
    """
    delivered = orders.filter(F.col("order_status") == "delivered").join(customers.select("customer_id", "customer_unique_id"), "customer_id", "left")
    named = items.join(products.select("product_id", "product_category_name"), "product_id", "left").join(translation, "product_category_name", "left")
    rows = named.join(delivered.select("order_id", "customer_unique_id", "order_purchase_timestamp"), "order_id").select(
        F.concat(F.lit("customer_"), F.col("customer_unique_id").cast("string")).alias("user_id"), "order_id", _month(F.col("order_purchase_timestamp")).alias("t"),
        F.col("product_category_name_english").alias("item"), F.lit(1.0).alias("quantity"), F.col("price").cast("double").alias("unit"),
    )
    rows = rows.filter(F.col("item").isNotNull() & F.col("unit").between(0.01, 5000.0))
    counts = {r["item"]: r["count"] for r in rows.groupBy("item").count().collect()}
    known = [c for c in MARKETPLACE_CATEGORIES if c in counts]
    goods = [*known, *sorted((c for c in counts if c not in known), key=lambda c: (-counts[c], c))][:n_categories]
    rows = rows.filter(F.col("item").isin(*goods)) if goods else rows.limit(0)
    often = rows.groupBy("user_id").agg(F.count_distinct("order_id").alias("n")).filter(F.col("n") >= min_orders).select("user_id")
    return panel(rows.join(often, "user_id", "left_semi"), goods, min_periods=min_months)


def pakistan(sales: DataFrame, *, min_months: int = 5) -> DataFrame:
    """Months over all categories of complete orders."""
    number = lambda c: F.col(c).try_cast("double")
    text = lambda c: F.trim(F.col(c).cast("string"))
    rows = sales.filter((F.lower(text("status")) == "complete") & (text("Customer ID") != "")).select(
        F.concat(F.lit("customer_"), F.col("Customer ID").cast("string")).alias("user_id"),
        F.concat(number("Year").cast("int").cast("string"), F.lit("-"), F.lpad(number("Month").cast("int").cast("string"), 2, "0")).alias("t"),
        text("category_name_1").alias("item"), number("qty_ordered").alias("quantity"), number("price").alias("unit"),
    )
    rows = rows.filter(F.col("t").isNotNull() & F.col("item").isNotNull() & F.col("unit").between(0.01, 500_000.0) & (F.col("quantity") > 0))
    return panel(rows, min_periods=min_months)


def hm(transactions: DataFrame, *, max_users: int | None = 50_000, min_periods: int = 6, top_k: int = 20, period: str = "month") -> DataFrame:
    """Periods over groups of articles (their first two digits) of the customers with most lines; own mean prices, else the period's median, the group's, that of all."""
    if period not in ("week", "month", "quarter"):
        raise errors.FormatError("period is 'week', 'month' or 'quarter'")
    rows = transactions.select(F.col("customer_id").cast("string").alias("customer"), F.date_format(F.date_trunc(period, F.col("t_dat").cast("timestamp")), "yyyy-MM-dd").alias("t"), F.substring(F.col("article_id").cast("string"), 1, 2).alias("item"), F.lit(1.0).alias("quantity"), F.col("price").cast("double").alias("unit"))
    goods = top(rows, top_k)
    if max_users is not None:
        most = rows.groupBy("customer").count().orderBy(F.col("count").desc(), "customer").limit(max_users)
        rows = rows.join(most.select("customer"), "customer", "left_semi")
    rows = rows.filter(F.col("item").isin(*goods)).withColumn("user_id", F.concat(F.lit("customer_"), F.substring("customer", 1, 12))) if goods else rows.withColumn("user_id", F.col("customer")).limit(0)
    cell = rows.groupBy("t", "item").agg(F.percentile("unit", 0.5).alias("cell"))
    item = rows.groupBy("item").agg(F.percentile("unit", 0.5).alias("any"))
    grid = rows.select("t").distinct().join(item, F.lit(True)).join(cell, ["t", "item"], "left").select("t", "item", F.coalesce("cell", "any").alias("price"))
    return panel(rows, goods, min_periods=min_periods, grid=grid, own_price="mean")


def m5(calendar: DataFrame, prices: DataFrame, sales: DataFrame, *, aggregation: str = "store", min_weeks: int = 100) -> DataFrame:
    """Weeks of stores over departments, or of stores' departments over categories; each user's own mean prices, carried on and back."""
    if aggregation not in ("store", "store_dept"):
        raise errors.FormatError("aggregation is 'store' or 'store_dept'")
    days = [c for c in sales.columns if c.startswith("d_") and c[2:].isdigit() and int(c[2:]) <= 1941]
    long = sales.select("item_id", "dept_id", "cat_id", "store_id", *days).unpivot(["item_id", "dept_id", "cat_id", "store_id"], days, "d", "units")
    rows = long.join(calendar.select("d", F.col("wm_yr_wk").cast("int").alias("wm_yr_wk")), "d").join(prices.select("store_id", "item_id", F.col("wm_yr_wk").cast("int").alias("wm_yr_wk"), "sell_price"), ["store_id", "item_id", "wm_yr_wk"])
    rows = rows.filter(F.col("sell_price") >= 0.01)
    whole = aggregation == "store"
    goods = DEPARTMENTS if whole else SALES_CATEGORIES
    user = F.col("store_id").cast("string") if whole else F.concat_ws("__", "store_id", "dept_id")
    cells = rows.groupBy(user.alias("user_id"), F.col("wm_yr_wk").cast("string").alias("t"), F.col("dept_id" if whole else "cat_id").alias("item")).agg(F.sum("units").cast("double").alias("quantity"), F.avg("sell_price").alias("price"))
    cells = cells.filter(F.col("item").isin(*goods))
    # every week that any user has, for each item of a user, so that prices are carried over weeks without sales
    frame = cells.select("user_id", "item").distinct().join(F.broadcast(cells.groupBy().agg(F.collect_set("t").alias("ts"))), F.lit(True)).select("user_id", "item", F.explode("ts").alias("t"))
    by_time = Window.partitionBy("user_id", "item").orderBy("t")
    filled = frame.join(cells, ["user_id", "item", "t"], "left").select(
        "user_id", "item", "t", F.coalesce("quantity", F.lit(0.0)).alias("quantity"),
        F.coalesce(F.last("price", True).over(by_time.rowsBetween(Window.unboundedPreceding, 0)), F.first("price", True).over(by_time.rowsBetween(0, Window.unboundedFollowing))).alias("price"),
    )
    weeks = filled.groupBy("user_id", "t").agg(F.map_from_entries(F.collect_list(F.struct("item", F.struct("quantity", "price").alias("v")))).alias("cell"), F.sum("quantity").alias("all")).filter(F.col("all") > 0)
    names = F.array(*[F.lit(g) for g in goods])
    side = lambda field, none: F.transform(names, lambda g: F.coalesce(F.element_at("cell", g)[field], F.lit(none)))
    return weeks.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("t", side("price", 1.0).alias("p"), side("quantity", 0.0).alias("q")))).alias("obs")).filter(F.size("obs") >= min_weeks)


def favorita(items: DataFrame, sales: DataFrame, *, min_weeks: int = 50) -> DataFrame:
    """Weeks of stores over product families, returns as nothing sold; all prices are one."""
    day = F.col("date").cast("date")
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
    rows = sales.join(items.select("item_nbr", F.col("family").alias("item")), "item_nbr").filter(F.col("item").isNotNull())
    rows = rows.select(F.concat(F.lit("store_"), F.col("store_nbr").cast("int").cast("string")).alias("user_id"), week.alias("t"), "item", F.greatest(F.col("unit_sales").cast("double"), F.lit(0.0)).alias("quantity"), F.lit(1.0).alias("unit"))
    return panel(rows, list(FAMILIES), min_periods=min_weeks)


def aisle_price(name: Column) -> Column:
    """The price of an aisle by the words in its name."""
    name = F.lower(name)
    fits = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: name.contains(w))
    return F.coalesce(*[F.when(fits(words), F.lit(price)) for *words, price in AISLE_PRICES], F.lit(OTHER_AISLES))


def instacart(orders: DataFrame, order_products: DataFrame, products: DataFrame, aisles: DataFrame, *, min_orders: int = 10) -> DataFrame:
    """Orders as periods over aisles, counted in items, at prices by the aisle's name."""
    prior = orders.filter(F.col("eval_set") == "prior").select("order_id", "user_id", "order_number")
    often = prior.groupBy("user_id").agg(F.count_distinct("order_id").alias("n")).filter(F.col("n") >= min_orders).select("user_id")
    rows = order_products.select("order_id", "product_id").join(products.select("product_id", "aisle_id"), "product_id").join(aisles.select("aisle_id", aisle_price(F.col("aisle")).alias("unit")), "aisle_id")
    rows = rows.join(prior.join(often, "user_id", "left_semi"), "order_id")
    rows = rows.select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("user_id"), F.lpad(F.col("order_number").cast("string"), 6, "0").alias("t"), F.lpad(F.col("aisle_id").cast("string"), 6, "0").alias("item"), F.lit(1.0).alias("quantity"), "unit")
    return panel(rows, min_periods=min_orders)


# ---------------------------------------------------------------- menus
def renumbered(menus: DataFrame) -> DataFrame:
    """Menus with each user's items as 0, 1, … in their order."""
    known = menus.groupBy("user_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("menu")))).alias("known"))
    number = lambda i: (F.array_position("known", i) - 1).cast("int")
    return menus.join(known, "user_id").select("user_id", "t", F.transform("menu", number).alias("menu"), number(F.col("choice")).alias("choice"))


def _menus(sessions: DataFrame, smallest: int = SMALLEST_MENU, largest: int = LARGEST_MENU) -> DataFrame:
    return sessions.filter(F.size("menu").between(smallest, largest)).select(F.col("user_id").cast("string").alias("user_id"), F.col("t").cast("string").alias("t"), "menu", "choice")


def _single_purchases(events: DataFrame, user: str, session: str, item: str, is_view: Column, is_buy: Column, *, distinct: bool, viewed: bool) -> DataFrame:
    """Sessions with one purchase (or one distinct item bought): the menu is what was viewed, and it."""
    bought = F.when(is_buy, F.col(item))
    rows = events.filter(is_view | is_buy).groupBy(user, session).agg(
        F.collect_set(F.when(is_view, F.col(item))).alias("seen"), (F.count_distinct(bought) if distinct else F.count(bought)).alias("n"), F.max(bought).alias("choice")
    )
    rows = rows.filter((F.col("n") == 1) & ((F.size("seen") > 0) if viewed else F.lit(True)))
    return rows.select(F.col(user).alias("user_id"), F.col(session).alias("t"), F.array_sort(F.array_union("seen", F.array("choice"))).alias("menu"), "choice")


def _sessions(events: DataFrame, user: str, time: str, gap: int) -> DataFrame:
    """Events with session: a number of the user's that rises after a longer gap."""
    by_time = Window.partitionBy(user).orderBy(time)
    late = F.coalesce(F.col(time) - F.lag(time).over(by_time) > gap, F.lit(False))
    return events.withColumn("session", F.sum(late.cast("long")).over(by_time.rangeBetween(Window.unboundedPreceding, 0)))


def retailrocket(events: DataFrame, *, min_sessions: int = 5, gap_minutes: int = 30) -> DataFrame:
    """Visits apart by half an hour (milliseconds) with one transaction."""
    rows = _single_purchases(_sessions(events, "visitorid", "timestamp", gap_minutes * 60_000), "visitorid", "session", "itemid", F.col("event") == "view", F.col("event") == "transaction", distinct=False, viewed=False)
    return clicklogs.enough(_menus(rows), min_sessions)


def rees46(events: DataFrame, *, min_sessions: int = 5) -> DataFrame:
    """Recorded sessions with views and one purchase."""
    rows = _single_purchases(events, "user_id", "user_session", "product_id", F.col("event_type") == "view", F.col("event_type") == "purchase", distinct=False, viewed=True)
    return clicklogs.enough(_menus(rows), min_sessions)


def taobao(events: DataFrame, *, mode: str = "session", min_sessions: int = 5, gap_seconds: int = 1800, window_seconds: int | None = None) -> DataFrame:
    """Sessions with one distinct item bought, or what was viewed in the seconds before each purchase if that was viewed too."""
    events = events.filter(F.col("behavior_type").isin("pv", "buy"))
    if mode == "session":
        rows = _single_purchases(_sessions(events, "user_id", "timestamp", gap_seconds), "user_id", "session", "item_id", F.col("behavior_type") == "pv", F.col("behavior_type") == "buy", distinct=True, viewed=True)
    elif mode == "buy_window" and window_seconds:
        before = Window.partitionBy("user_id").orderBy(F.col("timestamp").cast("long")).rangeBetween(-window_seconds, -1)
        seen = F.array_sort(F.collect_set(F.when(F.col("behavior_type") == "pv", F.col("item_id"))).over(before))
        rows = events.withColumn("menu", seen).filter((F.col("behavior_type") == "buy") & F.array_contains("menu", F.col("item_id")))
        rows = rows.select("user_id", F.concat_ws("/", F.col("timestamp").cast("string"), F.col("item_id").cast("string")).alias("t"), "menu", F.col("item_id").alias("choice"))
    else:
        raise errors.FormatError("mode is 'session', or 'buy_window' with window_seconds")
    return clicklogs.enough(_menus(rows), min_sessions)


def yoochoose(clicks: DataFrame, buys: DataFrame, *, min_sessions: int = 5) -> DataFrame:
    """Sessions with one distinct item bought; sessions of one first category are dealt to users of twice ``min_sessions``."""
    single = buys.groupBy("session_id").agg(F.count_distinct("item_id").alias("n"), F.max("item_id").alias("choice")).filter("n = 1")
    first = F.min(F.struct("timestamp", F.col("category").cast("string").alias("category")))
    rows = clicks.groupBy("session_id").agg(F.collect_set("item_id").alias("seen"), first.alias("first")).join(single, "session_id")
    rows = rows.select(F.col("first.category").alias("user_id"), F.col("session_id").alias("t"), F.array_sort(F.array_union("seen", F.array("choice"))).alias("menu"), "choice")
    rows = _menus(rows.filter(F.col("user_id").isNotNull()).withColumn("t", F.lpad(F.col("t").cast("string"), 12, "0")))
    dealt = clicklogs.pseudo_users(rows.withColumnRenamed("user_id", "category"), "category", 2 * min_sessions)
    return clicklogs.enough(dealt.select("user_id", "t", "menu", "choice"), min_sessions)


def instacart_menus(orders: DataFrame, order_products: DataFrame, products: DataFrame, *, min_sessions: int = 5, smallest: int = 3, largest: int = 30) -> DataFrame:
    """In the department a user reorders most: what was bought in earlier orders is the menu, the first product in the cart the choice if it is known."""
    rows = order_products.join(products.select("product_id", "department_id"), "product_id").join(orders.select("order_id", "user_id", "order_number"), "order_id")
    counts = rows.filter(F.col("reordered") == 1).groupBy("user_id", "department_id").count()
    best = counts.groupBy("user_id").agg(F.max(F.struct("count", (-F.col("department_id")).alias("d"))).alias("m")).select("user_id", (-F.col("m.d")).alias("department_id"))
    baskets = rows.join(best, ["user_id", "department_id"]).groupBy("user_id", "order_number").agg(F.collect_set("product_id").alias("basket"), F.min_by("product_id", "add_to_cart_order").alias("choice"))
    before = Window.partitionBy("user_id").orderBy("order_number").rowsBetween(Window.unboundedPreceding, -1)
    known = F.array_sort(F.array_distinct(F.flatten(F.collect_list("basket").over(before))))
    found = baskets.withColumn("menu", known).filter(F.array_contains("menu", F.col("choice")))
    return clicklogs.enough(_menus(found.withColumn("t", F.lpad(F.col("order_number").cast("string"), 6, "0")), smallest, largest), min_sessions)


def instacart_reorders(orders: DataFrame, order_products: DataFrame, products: DataFrame, *, min_sessions: int = 5, smallest: int = 2, min_pair_events: int = 3) -> DataFrame:
    """Orders with one reordered product of an aisle: it, and what the three orders of that aisle before held."""
    rows = order_products.join(products.select("product_id", "aisle_id"), "product_id").join(orders.select("order_id", "user_id", "order_number"), "order_id")
    baskets = rows.groupBy("user_id", "aisle_id", "order_number").agg(
        F.collect_set("product_id").alias("basket"), F.count(F.when(F.col("reordered") == 1, 1)).alias("n"), F.max(F.when(F.col("reordered") == 1, F.col("product_id"))).alias("choice")
    )
    before = Window.partitionBy("user_id", "aisle_id").orderBy("order_number").rowsBetween(-3, -1)
    found = baskets.withColumn("known", F.flatten(F.collect_list("basket").over(before))).filter("n = 1")
    found = found.select("user_id", "aisle_id", F.concat_ws("/", F.lpad(F.col("order_number").cast("string"), 6, "0"), F.col("aisle_id").cast("string")).alias("t"), F.array_sort(F.array_union("known", F.array("choice"))).alias("menu"), "choice").filter(F.size("menu") >= smallest)
    pairs = found.groupBy("user_id", "aisle_id").count().filter(F.col("count") >= min_pair_events).select("user_id", "aisle_id")
    return clicklogs.enough(_menus(found.join(pairs, ["user_id", "aisle_id"], "left_semi"), smallest, 1 << 30), min_sessions)


def kuairec(watched: DataFrame, *, min_sessions: int = 5) -> DataFrame:
    """Days: what was watched, and what was watched for the largest share of its length (the least id of ties)."""
    best = F.max(F.struct(F.col("watch_ratio").cast("double").alias("r"), (-F.col("video_id")).alias("v")))
    days = watched.groupBy("user_id", F.col("date").cast("string").alias("t")).agg(F.array_sort(F.collect_set("video_id")).alias("menu"), F.count(F.lit(1)).alias("n"), best.alias("best"))
    days = days.filter(F.col("n").between(SMALLEST_MENU, LARGEST_MENU)).withColumn("choice", -F.col("best.v"))
    return clicklogs.enough(days.select(F.col("user_id").cast("string").alias("user_id"), "t", "menu", "choice"), min_sessions)


def mind(behaviors: DataFrame, *, min_sessions: int = 5) -> DataFrame:
    """Impressions "id-0 id-1" with one click; items are the articles' ids as text."""
    tokens = F.filter(F.split(F.trim(F.coalesce("impressions", F.lit(""))), r"\s+"), lambda x: x.contains("-"))
    parts = F.transform(tokens, lambda x: F.struct(F.regexp_extract(x, "^(.*)-[^-]*$", 1).alias("id"), F.regexp_extract(x, "-([^-]*)$", 1).alias("label")))
    rows = behaviors.withColumn("parts", parts).withColumn("hits", F.filter("parts", lambda p: p["label"] == "1"))
    rows = rows.filter((F.size("hits") == 1) & F.size("parts").between(SMALLEST_MENU, LARGEST_IMPRESSION))
    rows = rows.select("user_id", F.col("impression_id").alias("t"), F.array_sort(F.array_distinct(F.transform("parts", lambda p: p["id"]))).alias("menu"), F.get("hits", F.lit(0))["id"].alias("choice"))
    return clicklogs.enough(_menus(rows, 1, LARGEST_IMPRESSION), min_sessions)


def mind_targets(train: DataFrame, test: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """For each training user what the test menus hold: choices, the share of new items among them, and the entropy of their categories (item, category) or items."""
    old = train.groupBy("user_id").agg(F.collect_set("choice").alias("old"))
    late = test.groupBy("user_id").agg(F.count(F.lit(1)).alias("engagement"), F.collect_set("choice").alias("new"))
    kinds = test.withColumn("kind", F.col("choice").cast("string"))
    if categories is not None:
        kinds = test.join(categories.select(F.col("item").alias("choice"), F.col("category").alias("kind")), "choice").select("user_id", "kind")
    c = kinds.groupBy("user_id", "kind").count()
    entropy = c.groupBy("user_id").agg((F.log2(F.sum("count").cast("double")) - F.sum(F.col("count") * F.log2(F.col("count").cast("double"))) / F.sum("count")).alias("entropy"))
    rows = old.join(late, "user_id", "left").join(entropy, "user_id", "left")
    novelty = F.size(F.array_except("new", "old")) / F.size("new")
    return rows.select("user_id", F.coalesce("engagement", F.lit(0)).alias("engagement"), F.coalesce(novelty, F.lit(0.0)).alias("novelty"), F.coalesce("entropy", F.lit(0.0)).alias("entropy"))


def tenrec(clicks: DataFrame, *, feedback: str = "like", order: str, min_sessions: int = 5) -> DataFrame:
    """Clicked items, in the order of a column, gather until one gets feedback: it is the choice, what gathered the menu."""
    if feedback not in ("like", "follow", "share"):
        raise errors.FormatError("feedback is 'like', 'follow' or 'share'")
    hit = F.col(feedback) == 1
    rows = clicks.filter(F.col("click") == 1)
    before = Window.partitionBy("user_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("t", F.coalesce(F.sum(hit.cast("long")).over(before), F.lit(0)))
    found = rows.groupBy("user_id", "t").agg(F.array_sort(F.collect_set("item_id")).alias("menu"), F.max(F.when(hit, F.col("item_id"))).alias("choice")).filter(F.col("choice").isNotNull())
    return clicklogs.enough(_menus(found.withColumn("t", F.lpad(F.col("t").cast("string"), 9, "0"))), min_sessions)


def finn_slates(steps: DataFrame, *, min_sessions: int = 5) -> DataFrame:
    """Steps (user_id, t, slate, click) whose slates have two real items at least; the click belongs to the menu."""
    real = F.array_distinct(F.filter("slate", lambda i: i >= 3))
    rows = steps.filter((F.col("click") >= 3) & (F.size(real) >= SMALLEST_MENU))
    rows = rows.select(F.col("user_id").cast("string").alias("user_id"), F.lpad(F.col("t").cast("string"), 6, "0").alias("t"), F.array_sort(F.array_union(real, F.array("click"))).alias("menu"), F.col("click").alias("choice"))
    return clicklogs.enough(rows, min_sessions)


# ---------------------------------------------------------------- folders
#: Of each data set: what it is, its function, and its files in the order of the function's arguments.
DATASETS = {
    "dunnhumby": ("grocery purchases of households by week", dunnhumby, ("transaction_data.csv", "product.csv")),
    "open_ecommerce": ("online purchases of consumers by month", open_ecommerce, ("amazon-purchases.csv",)),
    "uci_retail": ("online retail invoices by month", uci_retail, ("online_retail.csv",)),
    "online_retail_ii": ("online retail invoices of two years by month", online_retail_ii, ("online_retail_II.csv",)),
    "olist": ("marketplace orders by month", olist, ("olist_orders_dataset.csv", "olist_customers_dataset.csv", "olist_order_items_dataset.csv", "olist_products_dataset.csv", "product_category_name_translation.csv")),
    "pakistan": ("online orders by month", pakistan, ("Pakistan Largest Ecommerce Dataset.csv",)),
    "hm": ("fashion purchases by month", hm, ("transactions_train.csv",)),
    "m5": ("unit sales of stores by week", m5, ("calendar.csv", "sell_prices.csv", "sales_train_evaluation.csv")),
    "favorita": ("unit sales of stores by week, without prices", favorita, ("items.csv", "train.csv")),
    "instacart": ("grocery orders over aisles", instacart, ("orders.csv", "order_products__prior.csv", "products.csv", "aisles.csv")),
    "retailrocket": ("visits of a shop with one transaction", retailrocket, ("events.csv",)),
    "rees46": ("sessions of a shop with one purchase", rees46, ("2019-*.csv",)),
    "taobao": ("page views before purchases", taobao, ("UserBehavior.csv",)),
    "yoochoose": ("sessions of clicks with one item bought", yoochoose, ("yoochoose-clicks.dat", "yoochoose-buys.dat")),
    "instacart_menu": ("known products and the first in the cart", instacart_menus, ("orders.csv", "order_products__prior.csv", "products.csv")),
    "instacart_menu_v2": ("single reorders of an aisle", instacart_reorders, ("orders.csv", "order_products__prior.csv", "products.csv")),
    "kuairec": ("videos watched on a day", kuairec, ("big_matrix.csv",)),
    "mind": ("news impressions with one click", mind, ("behaviors.tsv",)),
    "tenrec": ("clicks until feedback", tenrec, ("ctr_data_1M.csv",)),
    "finn_slates": ("slates of a market place with one click", finn_slates, ("slates.parquet",)),
}
#: Columns of files without a header.
HEADERS = {
    "UserBehavior.csv": "user_id long, item_id long, category_id long, behavior_type string, timestamp long",
    "yoochoose-clicks.dat": "session_id long, timestamp timestamp, item_id long, category string",
    "yoochoose-buys.dat": "session_id long, timestamp timestamp, item_id long, price double, quantity long",
    "behaviors.tsv": "impression_id string, user_id string, time string, history string, impressions string",
}
#: Columns that are text though they look like numbers.
TEXT = {"transactions_train.csv": "t_dat date, customer_id string, article_id string, price double, sales_channel_id int"}


def datasets(spark: SparkSession) -> DataFrame:
    """The data sets by name, with what they are, the kind of their rows and their files."""
    rows = [(name, about, "budgets" if list(DATASETS).index(name) < list(DATASETS).index("retailrocket") else "menus", list(names)) for name, (about, _, names) in DATASETS.items()]
    return spark.createDataFrame([*rows, ("demo", "generated users: two fifths consistent, two fifths noisy, the others random", "budgets", [])], "name string, about string, kind string, files array<string>")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    path = f"{folder.rstrip('/')}/{name}"
    if name in HEADERS:
        return spark.read.schema(HEADERS[name]).option("sep", "\t" if name.endswith(".tsv") else ",").csv(path)
    if name in TEXT:
        return spark.read.schema(TEXT[name]).option("header", True).csv(path)
    return files.read(spark, path)


def load(spark: SparkSession, name: str, folder: str, **options) -> DataFrame:
    """Budget rows or menus of a data set whose files lie in ``folder``."""
    if name not in DATASETS:
        raise errors.FormatError(f"unknown data set {name!r}; known are {', '.join(DATASETS)}")
    _, build, names = DATASETS[name]
    tables = [read_table(spark, folder, n) for n in names]
    if name == "tenrec" and "order" not in options:
        # rows stand in the order of the file
        tables, options = [tables[0].withColumn("__row", F.monotonically_increasing_id())], options | {"order": "__row"}
    return build(*tables, **options)
