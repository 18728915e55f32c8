"""Price comparison: listings, baskets over stores, substitution and savings.

Money is summed as decimal(18,2) and turned into double last. Ties are broken by store or product id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trolley.operators.windows import best_per_key

PRICE_TIES = ("batch_id", "line_no", "price_kes")


def money(price: Column) -> Column:
    return price.cast("decimal(18,2)")


def latest_prices(prices: DataFrame, as_of: str | None = None) -> DataFrame:
    """The last price of each (product, store) known at as_of."""
    if as_of is not None:
        prices = prices.where(F.col("verified_at") <= F.lit(as_of).cast("timestamp"))
    row = F.struct("verified_at", *PRICE_TIES, "source", "is_promotional")
    newest = prices.groupBy("product_id", "store_id").agg(F.max(row).alias("p"))
    return newest.select("product_id", "store_id", "p.price_kes", "p.verified_at", "p.source", "p.is_promotional")


def price_listing(prices: DataFrame, stores: DataFrame, mode: str = "all", town: str | None = None) -> DataFrame:
    """Every price with its store, cheapest first within a product; mode "latest" keeps one price a store."""
    if mode == "latest":
        prices = latest_prices(prices)
    if town is not None:
        stores = town_filter(stores, town)
    joined = prices.join(stores, "store_id")
    return joined.select("product_id", "store_id", F.concat_ws(" - ", "chain", "town").alias("store"), "price_kes", price_text(F.col("price_kes")).alias("price_text"), "is_promotional", "verified_at")


def price_text(price: Column) -> Column:
    return F.concat(F.round(price, 0).cast("long").cast("string"), F.lit(" KES"))


def format_price(price: Column) -> Column:
    """Whole numbers without decimals, others with one."""
    return F.when(price == F.floor(price), F.concat(price.cast("long").cast("string"), F.lit(" KES"))).otherwise(F.concat(F.format_string("%.1f", price), F.lit(" KES")))


def newest_price_date(prices: DataFrame) -> DataFrame:
    return prices.groupBy("product_id").agg(F.max("verified_at").alias("newest"), F.count(F.lit(1)).alias("listings"))


def town_filter(stores: DataFrame, town: str) -> DataFrame:
    return stores.where(F.lower(F.trim("town")) == town.strip().lower())


def price_spread(latest: DataFrame) -> DataFrame:
    """Dearest minus cheapest price of each product, and where it is cheapest."""
    return latest.groupBy("product_id").agg(
        (F.max(money(F.col("price_kes"))) - F.min(money(F.col("price_kes")))).cast("double").alias("saving"),
        F.min(F.struct("price_kes", "store_id"))["store_id"].alias("cheapest_store"), F.count(F.lit(1)).alias("stores"))


def cheapest_per_product(latest: DataFrame) -> DataFrame:
    return latest.groupBy("product_id").agg(F.min(F.struct("price_kes", "store_id")).alias("p")).select("product_id", "p.store_id", "p.price_kes")


def store_basket_totals(basket: DataFrame, latest: DataFrame) -> DataFrame:
    """For each store the sum of its latest prices of the basket's products, how many it has, and the list with N/A for the others.

    basket: product_id. It is one user's list and goes to all tasks; stores with nothing drop out.
    """
    wanted = basket.select("product_id").distinct()
    found = latest.join(F.broadcast(wanted), "product_id")
    totals = found.groupBy("store_id").agg(
        F.sum(money(F.col("price_kes"))).cast("double").alias("total"), F.count(F.lit(1)).alias("items_found"),
        F.map_from_entries(F.collect_list(F.struct("product_id", "price_kes"))).alias("priced"))
    everything = wanted.agg(F.array_sort(F.collect_list("product_id")).alias("wanted"))
    listed = F.transform("wanted", lambda p: F.concat_ws(":", p.cast("string"), F.coalesce(F.try_element_at("priced", p).cast("decimal(18,2)").cast("string"), F.lit("N/A"))))
    return totals.crossJoin(F.broadcast(everything)).select("store_id", "total", "items_found", F.array_join(listed, ",").alias("items"))


def basket_recommendation(totals: DataFrame) -> DataFrame:
    """The best store (most items, then cheapest) and what it saves against the dearest total."""
    best = totals.agg(F.min(F.struct((-F.col("items_found")).alias("fewer"), "total", "store_id")).alias("b"), F.max("total").alias("dearest"))
    return best.where(F.col("b").isNotNull()).select(
        F.col("b.store_id").alias("store_id"), F.col("b.total").alias("total"), (-F.col("b.fewer")).alias("items_found"),
        F.round(F.col("dearest") - F.col("b.total"), 2).alias("savings"))


def avg_prices(prices: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    start = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return prices.where((F.col("verified_at") >= start) & (F.col("verified_at") < F.lit(as_of).cast("timestamp"))).groupBy("product_id").agg(
        F.round(F.avg("price_kes"), 4).alias("avg_price"), F.count(F.lit(1)).alias("samples"))


def priced_products(products: DataFrame, prices: DataFrame) -> DataFrame:
    return products.join(prices.select("product_id"), "product_id", "left_semi")


def fallback_products(wanted: DataFrame, products: DataFrame, latest: DataFrame) -> DataFrame:
    """wanted (product_id, store_id) with its price there, or that of another product of the same name: the cheapest one."""
    own = wanted.join(latest.select("product_id", "store_id", "price_kes"), ["product_id", "store_id"], "left")
    names = products.select("product_id", F.lower("name").alias("term"))
    missing = own.where(F.col("price_kes").isNull()).select("product_id", "store_id").join(names, "product_id")
    others = latest.select(F.col("product_id").alias("other_id"), "store_id", F.col("price_kes").alias("other_price")).join(
        names.select(F.col("product_id").alias("other_id"), "term"), "other_id")
    best = missing.join(others, ["term", "store_id"]).groupBy("product_id", "store_id").agg(F.min(F.struct("other_price", "other_id")).alias("o"))
    return own.join(best, ["product_id", "store_id"], "left").select(
        "product_id", "store_id", F.coalesce("price_kes", F.col("o.other_price")).alias("price_kes"), F.coalesce(F.when(F.col("price_kes").isNotNull(), F.col("product_id")), F.col("o.other_id")).alias("used_id"))


def cheapest_match(matches: DataFrame, cheapest: DataFrame, top: int = 5) -> DataFrame:
    """Of each term's best `top` matches (term, product_id, confidence) the cheapest; one without a price only where none has one."""
    first = best_of(matches, top)
    return best_per_key(first.join(cheapest.select("product_id", "price_kes"), "product_id", "left"), ["term"], [F.col("price_kes").asc_nulls_last(), F.col("confidence").desc(), "product_id"])


def best_of(matches: DataFrame, top: int) -> DataFrame:
    from trolley.operators.windows import top_n_per_group

    return top_n_per_group(matches, ["term"], [F.col("confidence").desc(), "product_id"], top, "_r").drop("_r")


def ordered_id_lookup(ids: DataFrame, products: DataFrame) -> DataFrame:
    """ids (request, ids array) to known products with their place in the request, malformed and unknown ids dropped."""
    asked = ids.select("request", F.posexplode("ids").alias("place", "raw"))
    asked = asked.withColumn("product_id", F.col("raw").try_cast("long")).where(F.col("product_id").isNotNull())
    return asked.join(products.select("product_id", "name"), "product_id").select("request", F.col("place").cast("long").alias("place"), "product_id", "name")


def recent_prices(prices: DataFrame, products: DataFrame, stores: DataFrame, n: int = 50) -> DataFrame:
    """The n newest prices with product and store names; the limit comes before the joins."""
    newest = prices.orderBy(F.col("verified_at").desc(), *[F.col(c).desc() for c in ("batch_id", "line_no", "product_id", "store_id", "price_kes")]).limit(n)
    return newest.join(products.select("product_id", "name"), "product_id", "left").join(stores.select("store_id", "chain"), "store_id", "left").select(
        "product_id", "name", "store_id", "chain", "price_kes", "verified_at")


#: Rows of a partition of a product of tables, about; rows up to which its smaller table goes to all tasks.
PART_PAIRS, BROADCAST_ROWS = 20_000_000, 1_000_000


def every_pair(products: DataFrame, stores: DataFrame) -> DataFrame:
    """Every product at every store. The larger table is dealt to as many partitions as pairs ask for: a small file would be one. Give few columns."""
    n, m = products.count(), stores.count()
    parts = max(4 * products.sparkSession.sparkContext.defaultParallelism, -(-n * m // PART_PAIRS))
    large, small = (products, stores) if n >= m else (stores, products)
    return large.repartition(parts).crossJoin(F.broadcast(small) if min(n, m) <= BROADCAST_ROWS else small)


def generate_prices(products: DataFrame, stores: DataFrame, factors: dict[str, float], seed: int = 42) -> DataFrame:
    """A price for every product at every store: base x chain factor x noise of 5 %, and some promotions 10 to 20 % off.

    Noise comes from hashes, so a rerun gives the same prices.
    """
    factor = F.coalesce(F.create_map(*[F.lit(x) for kv in factors.items() for x in kv])[F.col("chain")], F.lit(1.0)) if factors else F.lit(1.0)
    unit = lambda salt: F.pmod(F.xxhash64("product_id", "store_id", F.lit(seed), F.lit(salt)), F.lit(1_000_000)) / 1_000_000.0
    promo = unit("promo") < 0.12
    price = F.col("base_price") * F.col("factor") * (0.95 + 0.1 * unit("noise")) * F.when(promo, 0.8 + 0.1 * unit("off")).otherwise(1.0)
    pairs = every_pair(products.select("product_id", "base_price"), stores.select("store_id", factor.alias("factor")))
    return pairs.select("product_id", "store_id", F.round(price, 2).alias("price_kes"), promo.alias("is_promotional"))


def resolve_or_create(rows: DataFrame, known: DataFrame, keys: list[str], id_column: str) -> tuple[DataFrame, DataFrame]:
    """(rows with an id, the keys created): keys are matched without regard to case; new ones get an id from their hash."""
    key = F.md5(F.concat_ws("\x1f", *[F.lower(F.coalesce(F.col(k).cast("string"), F.lit(""))) for k in keys]))
    rows, known = rows.withColumn("_key", key), known.withColumn("_key", key)
    old = known.groupBy("_key").agg(F.min(id_column).cast("string").alias("_id"))
    made = rows.join(old, "_key", "left_anti").groupBy("_key").agg(*[F.min(k).alias(k) for k in keys]).withColumn(id_column, F.concat(F.lit("new-"), F.substring("_key", 1, 16)))
    ids = old.unionByName(made.select("_key", F.col(id_column).alias("_id")))
    return rows.join(ids, "_key").drop("_key").withColumnRenamed("_id", id_column), made.drop("_key")


def dedup_items(items: DataFrame) -> DataFrame:
    """One row for each (product, store, price to 2 places, source in lower case), by its signature."""
    signed = items.withColumn("item_key", item_key())
    return best_per_key(signed, ["item_key"], ["verified_at", *PRICE_TIES])


def item_key() -> Column:
    return F.md5(F.concat_ws("|", F.col("product_id").cast("string"), F.col("store_id").cast("string"), F.col("price_kes").cast("decimal(18,2)").cast("string"), F.lower("source")))


def daily_upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Both tables merged on (product, store, source, day): the incoming row wins, the last of several wins."""
    rows = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1))).withColumn("day", F.to_date("verified_at"))
    newest = F.max(F.struct("_new", "verified_at", *PRICE_TIES, "is_promotional")).alias("p")
    return rows.groupBy("product_id", "store_id", "source", "day").agg(newest, F.min("verified_at").alias("created_at")).select(
        "product_id", "store_id", "source", "day", "p.price_kes", "p.verified_at", "p.is_promotional", "created_at")
