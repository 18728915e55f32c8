"""Query-log analytics: what is asked, where, when and how that changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trolley.operators.windows import share_of_total, top_n_per_group
from trolley.sources.tables import stored


def since(as_of: str, days: int) -> Column:
    return F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))


def lookback_filter(df: DataFrame, as_of: str, days: int, time: str = "ts") -> DataFrame:
    return df.where(F.col(time) >= since(as_of, days))


def half_open_window(df: DataFrame, start: Column, end: Column, time: str = "ts") -> DataFrame:
    return df.where((F.col(time) >= start) & (F.col(time) < end))


def week_of_year(time: Column) -> Column:
    """Weeks 0 to 53 that start on Sunday; days before the first Sunday are week 0."""
    return F.floor((F.dayofyear(time) + 7 - F.dayofweek(time)) / 7).cast("long")


def explode_lookup(logs: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """A row for each product of each log, with the product's name; unknown products drop out."""
    return logs.join(items.select("log_id", "product_id"), "log_id").join(products.select("product_id", "name"), "product_id")


def count_by_town_product(logs: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    return explode_lookup(logs, items, products).groupBy("town", "product_id", "name").agg(F.count(F.lit(1)).alias("query_count"))


def top_products_by_town(logs: DataFrame, items: DataFrame, products: DataFrame, n: int = 20) -> DataFrame:
    return _top_by_town(count_by_town_product(logs, items, products), n)


def _top_by_town(counted: DataFrame, n: int) -> DataFrame:
    return top_n_per_group(counted, ["town"], [F.col("query_count").desc(), "product_id"], n)


def volume_by_hour(logs: DataFrame) -> DataFrame:
    """Mean count over weekdays for each hour, and its rank among the busiest hours."""
    return _hour_means(logs.groupBy(F.hour("ts").cast("long").alias("hour"), F.dayofweek("ts").alias("dow")).agg(F.count(F.lit(1)).alias("n")))


def _hour_means(per_day: DataFrame) -> DataFrame:
    hours = per_day.groupBy("hour").agg(F.avg("n").alias("mean_count"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("weekdays"))
    return hours.withColumn("mean_count", F.round("mean_count", 4))


def rough_total_queries(logs: DataFrame) -> DataFrame:
    """The sum of hourly means times 24 beside the true count."""
    return volume_by_hour(logs).agg((F.round(F.sum("mean_count") * 24, 2)).alias("rough_total_queries"), F.sum("total").alias("true_total"))


def peak_hours(logs: DataFrame, n: int = 5) -> DataFrame:
    return volume_by_hour(logs).orderBy(F.col("mean_count").desc(), "hour").limit(n)


def basket_size_distribution(baskets: DataFrame, products: str = "products") -> DataFrame:
    size = F.size(F.coalesce(F.col(products), F.array()))
    return _size_shares(baskets.select(size.cast("long").alias("basket_size")).groupBy("basket_size").agg(F.count(F.lit(1)).alias("n")))


def _size_shares(counts: DataFrame) -> DataFrame:
    kind = F.when(F.col("basket_size") <= 2, "small").when(F.col("basket_size") <= 5, "medium").otherwise("large")
    return share_of_total(counts.withColumn("kind", kind), "n")


def basket_size_summary(baskets: DataFrame, products: str = "products") -> DataFrame:
    size = F.size(F.coalesce(F.col(products), F.array()))
    return baskets.select(size.alias("s")).agg(
        F.count(F.lit(1)).alias("total"), F.round(F.avg("s"), 2).alias("average"), F.count_if(F.col("s") <= 2).alias("small"),
        F.count_if((F.col("s") >= 3) & (F.col("s") <= 5)).alias("medium"), F.count_if(F.col("s") >= 6).alias("large"))


def seasonal_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy(F.dayofweek("ts").cast("long").alias("dow"), week_of_year(F.col("ts")).alias("week"), F.month("ts").cast("long").alias("month")).agg(
        F.count(F.lit(1)).alias("n"))


def seasonal_patterns(logs: DataFrame, part: str = "dow") -> DataFrame:
    """Mean of the (weekday, week, month) counts by weekday or month."""
    return _season_means(seasonal_counts(logs), part)


def _season_means(counts: DataFrame, part: str) -> DataFrame:
    return counts.groupBy(part).agg(F.round(F.avg("n"), 4).alias("mean_count"), F.sum("n").alias("total"))


def busiest_and_quietest(logs: DataFrame) -> DataFrame:
    days = seasonal_patterns(logs, "dow")
    return days.agg(
        F.max_by("dow", F.struct("mean_count", -F.col("dow"))).alias("busiest"), F.min_by("dow", F.struct("mean_count", "dow")).alias("quietest"))


def distinct_users_by_season(logs: DataFrame) -> DataFrame:
    return logs.groupBy(F.year("ts").cast("long").alias("year"), F.month("ts").cast("long").alias("month")).agg(F.countDistinct("user_id").alias("users"))


def term_momentum(logs: DataFrame, items: DataFrame, products: DataFrame, as_of: str, days: int, top: int = 50, shown: int = 20, least: int = 5) -> DataFrame:
    """Terms whose counts rose, fell or stayed between the two halves of the window, by the halves' top lists.

    A new term has infinite growth. Each label shows its first `shown` terms.
    """
    start, middle, end = halves(as_of, days)

    def half(a: Column, b: Column) -> DataFrame:
        named = explode_lookup(half_open_window(logs, a, b), items, products)
        return named.groupBy(F.col("name").alias("term")).agg(F.count(F.lit(1)).alias("n"))

    return _momentum(half(start, middle), half(middle, end), top, shown, least)


def halves(as_of: str, days: int) -> tuple[Column, Column, Column]:
    """Start, middle and end of a window."""
    start, end = since(as_of, days), F.lit(as_of).cast("timestamp")
    return start, F.timestamp_micros(((F.unix_micros(start) + F.unix_micros(end)) / 2).cast("long")), end


def _momentum(previous: DataFrame, current: DataFrame, top: int, shown: int, least: int) -> DataFrame:
    """term_momentum from the counts (term, n) of the two halves."""
    best = lambda df, name: df.select("term", F.col("n").alias(name)).orderBy(F.col("n").desc(), "term").limit(top)
    both = best(previous, "previous_count").join(best(current, "current_count"), "term", "full_outer").fillna(0, ["previous_count", "current_count"])
    change = F.col("current_count") - F.col("previous_count")
    growth = F.when(F.col("previous_count") > 0, change / F.col("previous_count")).otherwise(F.lit(float("inf")))
    both = both.where(F.col("current_count") >= least).withColumn("growth_rate", growth)
    label = F.when(F.col("growth_rate") > 0.5, "up").when(F.col("growth_rate") < -0.3, "down").otherwise("stable")
    first = F.when(F.col("label") == "up", -F.col("growth_rate")).when(F.col("label") == "down", F.col("growth_rate")).otherwise(
        -(F.col("previous_count") + F.col("current_count")) / 2)
    ranked = top_n_per_group(both.withColumn("label", label).withColumn("_first", first), ["label"], ["_first", "term"], shown)
    return ranked.withColumn("growth_rate", F.round("growth_rate", 2)).drop("_first")


def daily_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def popular_queries(logs: DataFrame, n: int = 20) -> DataFrame:
    """The n texts asked most; empty ones don't count."""
    return logs.where(F.length("text") > 0).groupBy("text").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "text").limit(n)


def zero_filled(counts: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """Every bin from first to last, missing ones as 0; the bins are a fixed range."""
    bins = counts.sparkSession.range(first, last + 1).withColumnRenamed("id", key)
    return bins.join(F.broadcast(counts), key, "left").fillna(0, ["n"])


def hourly_traffic(logs: DataFrame) -> DataFrame:
    return zero_filled(logs.groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n")), "hour", 0, 23)


def weekday_traffic(logs: DataFrame) -> DataFrame:
    return zero_filled(logs.groupBy(F.dayofweek("ts").cast("long").alias("weekday")).agg(F.count(F.lit(1)).alias("n")), "weekday", 1, 7)


def usage_stats(logs: DataFrame, as_of: str, approximate: bool = False) -> DataFrame:
    """Totals in one pass; today is the day before as_of."""
    today = F.col("ts") >= since(as_of, 1)
    distinct = (lambda c: F.approx_count_distinct(c)) if approximate else (lambda c: F.countDistinct(c))
    return logs.agg(F.count(F.lit(1)).alias("total"), F.count_if(today).alias("today"), distinct(F.when(today, F.col("user_id"))).alias("users_today"), distinct(F.col("user_id")).alias("users"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


_SETS = {
    "town_product": ("town", "product_id"), "half_product": ("half", "product_id"), "hours": ("hour", "dow"), "sizes": ("basket_size",), "seasons": ("dow", "week", "month")}


def report_counts(logs: DataFrame, items: DataFrame, as_of: str, days: int) -> dict[str, DataFrame]:
    """All counts that the report needs, from one pass over the window: grouping sets over logs and their items, stored once.

    A log is one row, with its basket's size, and so is each of its items; each set counts rows of one kind.
    """
    start, middle, end = halves(as_of, days)
    recent = logs.where(F.col("ts") >= start).select("log_id", "ts", "town")
    basket = items.groupBy("log_id").agg(F.collect_list("product_id").alias("products"))
    rows = recent.join(basket, "log_id", "left")
    kind = items.schema["product_id"].dataType
    products = F.coalesce("products", F.array().cast(basket.schema["products"].dataType))
    rows = rows.select(
        "town", F.when((F.col("ts") >= start) & (F.col("ts") < middle), "previous").when((F.col("ts") >= middle) & (F.col("ts") < end), "current").alias("half"),
        F.hour("ts").cast("long").alias("hour"), F.dayofweek("ts").cast("long").alias("dow"), week_of_year(F.col("ts")).alias("week"), F.month("ts").cast("long").alias("month"),
        F.size(products).cast("long").alias("basket_size"), F.explode(F.concat(F.array(F.struct(F.lit(True).alias("log"), F.lit(None).cast(kind).alias("product_id"))), F.transform(products, lambda p: F.struct(F.lit(False).alias("log"), p.alias("product_id"))))).alias("row"))
    rows = rows.select("*", "row.log", "row.product_id").drop("row")
    columns = ["town", "half", "product_id", "hour", "dow", "basket_size", "week", "month"]
    which = F.grouping_id(*columns)
    counted = rows.groupingSets([[F.col(c) for c in cs] for cs in _SETS.values()], *columns).agg(which.alias("which"), F.count_if("log").alias("logs"), F.count_if(~F.col("log")).alias("items"))
    counted = stored(counted, "report-counts")
    out = {}
    for name, keys in _SETS.items():
        bits = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in keys)
        kind = "items" if "product_id" in keys else "logs"
        out[name] = counted.where((F.col("which") == bits) & (F.col(kind) > 0)).select(*keys, F.col(kind).alias("n"))
    return out


def trends_report(logs: DataFrame, items: DataFrame, products: DataFrame, as_of: str, days: int, n: int = 20) -> dict[str, DataFrame]:
    """The five analyses of one look-back window by name, from one scan of logs and items."""
    counts = report_counts(logs, items, as_of, days)
    names = products.select("product_id", "name")
    by_town = counts["town_product"].join(names, "product_id").select("town", "product_id", "name", F.col("n").alias("query_count"))
    terms = stored(counts["half_product"].where("half is not null").join(names, "product_id").groupBy("half", F.col("name").alias("term")).agg(F.sum("n").alias("n")), "report-terms")
    half = lambda h: terms.where(F.col("half") == h).select("term", "n")
    return {
        "top_products_by_town": _top_by_town(by_town, n),
        "query_volume_by_hour": _hour_means(counts["hours"]),
        "basket_size_distribution": _size_shares(counts["sizes"]),
        "seasonal_patterns": _season_means(counts["seasons"], "dow"),
        "search_term_trends": _momentum(half("previous"), half("current"), 50, n, 5),
    }


def report_rows(report: dict[str, DataFrame]) -> DataFrame:
    """The report as one table: analysis, label, k (the number that a row is about), n (its count), value (its mean, share, rank or growth; null if without bound)."""
    form = {
        "top_products_by_town": (F.concat_ws("|", "town", "name"), "product_id", "query_count", F.col("rank").cast("double")),
        "query_volume_by_hour": (F.lit(""), "hour", "total", F.col("mean_count")), "basket_size_distribution": (F.col("kind"), "basket_size", "n", F.col("percent")),
        "seasonal_patterns": (F.lit(""), "dow", "total", F.col("mean_count")),
        "search_term_trends": (F.concat_ws("|", "label", "term"), "rank", "current_count", F.when(F.col("growth_rate") != float("inf"), F.col("growth_rate")))}
    out = None
    for name, df in report.items():
        label, k, count, value = form[name]
        one = df.select(F.lit(name).alias("analysis"), label.alias("label"), F.col(k).cast("long").alias("k"), F.col(count).cast("long").alias("n"), value.alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def stream_query_volume(logs: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts by hour; on a stream, hours close once the watermark has passed them."""
    return logs.withWatermark("ts", late).groupBy(F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("hour_start"), "n")
