"""Registered queries of price comparison, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trolley.operators import prices as P
from trolley.operators import windows as W
from trolley.plans.bindings import AS_OF, Tables, with_tables

#: A user's list: every hundredth product below 1000.
BASKET = "product_id % 100 = 7 and product_id < 1000"


def _latest(t: Tables):
    return P.latest_prices(t.prices())


def _basket(t: Tables):
    return t.products().where(BASKET)


def _totals(t: Tables):
    return P.store_basket_totals(_basket(t), _latest(t))


def _wanted(t: Tables):
    # one user's basket is what goes to all tasks
    return t.stores().select("store_id").crossJoin(F.broadcast(_basket(t).select("product_id")))


def _matches(t: Tables):
    return t.products().select(F.lower("name").alias("term"), "product_id", (F.col("size") / 50.0).alias("confidence"))


def _items(t: Tables):
    return t.prices().withColumn("price_kes", F.round(F.col("price_kes") / 10000, 0) * 10000)


def _requests(t: Tables):
    return t.baskets().select(F.col("log_id").alias("request"), F.concat(F.transform("products", lambda p: (p * 2).cast("string")), F.array(F.lit("bad"))).alias("ids"))


_LATEST = "latest as (select * from prices qualify row_number() over (partition by product_id, store_id order by verified_at desc, batch_id desc, line_no desc, price_kes desc, source desc, is_promotional desc) = 1)"

QUERIES = {
    "latest_price_join": lambda t: P.latest_prices(t.prices(), "2000-01-01 00:00:00"),
    "latest_per_key": lambda t: W.latest_per_key(t.prices().select("store_id", "verified_at", "batch_id", "line_no", "product_id", "price_kes"), ["store_id"], "verified_at", ["batch_id", "line_no", "product_id", "price_kes"]),
    "price_listing": lambda t: P.price_listing(t.prices(), t.stores(), "latest"),
    "price_listing_town": lambda t: P.price_listing(t.prices(), t.stores(), "all", " nation_3 "),
    "newest_price_date": lambda t: P.newest_price_date(t.prices()),
    "prices_stores_join": lambda t: t.prices().join(t.stores(), "store_id").groupBy("county").agg(F.count(F.lit(1)).alias("n"), F.sum(P.money(F.col("price_kes"))).cast("double").alias("total")),
    "price_spread": lambda t: P.price_spread(_latest(t)),
    "cheapest_per_product": lambda t: P.cheapest_per_product(_latest(t)),
    "store_basket_totals": _totals,
    "basket_recommendation": lambda t: P.basket_recommendation(_totals(t)),
    "sort_multi": lambda t: _totals(t).select("store_id", "items_found", "total").orderBy(F.col("items_found").desc(), "total", "store_id"),
    "avg_price_7d": lambda t: P.avg_prices(t.prices(), AS_OF),
    "priced_products_semi": lambda t: P.priced_products(t.products(), t.prices()).select("product_id", "name"),
    "fallback_product_join": lambda t: P.fallback_products(_wanted(t), t.products(), _latest(t)),
    "cheapest_match": lambda t: P.cheapest_match(_matches(t), P.cheapest_per_product(_latest(t))),
    "ordered_id_lookup": lambda t: P.ordered_id_lookup(_requests(t), t.products()),
    "double_left_lookup": lambda t: P.recent_prices(t.prices(), t.products(), t.stores(), 50),
    "cross_join_prices": lambda t: P.every_pair(t.products().select("product_id", "base_price"), t.stores().select("store_id")).select("product_id", "store_id", (F.floor((F.round(F.col("base_price") * 100).cast("long") * (100 + F.col("store_id") % 10) + 50) / 100) / 100.0).alias("price")),
    "generate_prices": lambda t: P.generate_prices(t.products(), t.stores(), {"Supplier#000000001": 1.1}),
    "resolve_or_create_store": lambda t: P.resolve_or_create(t.stores().select("chain", "town"), t.stores().where("store_id % 2 = 0"), ["chain", "town"], "store_id")[0],
    "dedup_items": lambda t: P.dedup_items(_items(t)).select("product_id", "store_id", "source", "price_kes", "item_key"),
    "sink_daily_upsert": lambda t: P.daily_upsert(t.prices().where("batch_id % 3 > 0"), t.prices().where("batch_id % 3 = 0")),
    "format_price": lambda t: t.prices().select("batch_id", "line_no", "product_id", "store_id", P.format_price(F.floor(F.col("price_kes")) + F.when(F.col("line_no") % 2 == 0, 0.5).otherwise(0.0)).alias("shown")),
    "share_of_max": lambda t: W.share_of_max(P.cheapest_per_product(_latest(t)).join(t.products(), "product_id").select("brand", "product_id", "price_kes"), ["brand"], "price_kes").select("product_id", F.round("share", 6).alias("share")),
    "tail_align": lambda t: W.tail_align(t.prices().select("product_id", "store_id", "verified_at", "batch_id", "line_no"), ["product_id", "store_id"], "verified_at", ["batch_id", "line_no"]),
    "running_position": lambda t: W.running_position(t.prices().select("product_id", "store_id", "verified_at", "batch_id", "line_no"), ["product_id", "store_id"], "verified_at", ["batch_id", "line_no"]),
    "first_seen_distinct": lambda t: t.baskets().select("log_id", F.array_join(W.first_seen_distinct(F.col("products")), ",").alias("items")),
    "in_set": lambda t: t.prices().where(F.col("source").isin("A", "R")).select("batch_id", "line_no", "product_id", "store_id"),
    "iequals": lambda t: t.products().where(F.lower("name") == "small ring").select("product_id"),
    "array_first": lambda t: t.baskets().select("log_id", F.try_element_at("products", F.lit(1)).alias("first")),
    "topk": lambda t: t.prices().select("product_id", "store_id", "price_kes").orderBy(F.col("price_kes").desc(), "product_id", "store_id").limit(50),
    "paginate": lambda t: t.products().select("product_id", "name").orderBy("name", "product_id").offset(100).limit(50),
    "point_lookup": lambda t: t.products().where(F.col("product_id") == 77).select("product_id", "name", "brand", "category"),
    "price_bounds": lambda t: t.prices().where(F.col("price_kes").between(0.01, 50000)).groupBy("source").agg(F.count(F.lit(1)).alias("n")),
}

ORACLES = {
    "latest_price_join": with_tables("with p as (select * from prices where verified_at <= timestamp '2000-01-01') select product_id, store_id, price_kes, verified_at, source, is_promotional from p qualify row_number() over (partition by product_id, store_id order by verified_at desc, batch_id desc, line_no desc, price_kes desc, source desc, is_promotional desc) = 1", "prices"),
    "latest_per_key": with_tables("select store_id, verified_at, batch_id, line_no, product_id, price_kes from prices qualify row_number() over (partition by store_id order by verified_at desc, batch_id desc, line_no desc, product_id desc, price_kes desc) = 1", "prices"),
    "price_listing": with_tables(f"with {_LATEST} select product_id, store_id, chain || ' - ' || town as store, price_kes, cast(cast(round(price_kes, 0) as bigint) as varchar) || ' KES' as price_text, is_promotional, verified_at from latest join stores using (store_id)", "prices", "stores"),
    "price_listing_town": with_tables("select product_id, store_id, chain || ' - ' || town as store, price_kes, cast(cast(round(price_kes, 0) as bigint) as varchar) || ' KES' as price_text, is_promotional, verified_at from prices join stores using (store_id) where town = 'NATION_3'", "prices", "stores"),
    "newest_price_date": with_tables("select product_id, max(verified_at) as newest, count(*) as listings from prices group by product_id", "prices"),
    "prices_stores_join": with_tables("select county, count(*) as n, cast(sum(cast(price_kes as decimal(18,2))) as double) as total from prices join stores using (store_id) group by county", "prices", "stores"),
    "price_spread": with_tables(f"with {_LATEST} select product_id, cast(max(cast(price_kes as decimal(18,2))) - min(cast(price_kes as decimal(18,2))) as double) as saving, arg_min(store_id, struct_pack(a := price_kes, b := store_id)) as cheapest_store, count(*) as stores from latest group by product_id", "prices"),
    "cheapest_per_product": with_tables(f"with {_LATEST} select product_id, store_id, price_kes from latest qualify row_number() over (partition by product_id order by price_kes, store_id) = 1", "prices"),
    "store_basket_totals": with_tables(f"with {_LATEST}, w as (select product_id from products where {BASKET}), f as (select store_id, product_id, price_kes from latest join w using (product_id)), t as (select store_id, cast(sum(cast(price_kes as decimal(18,2))) as double) as total, count(*) as items_found from f group by store_id), l as (select t.store_id, string_agg(w.product_id || ':' || coalesce(cast(cast(f.price_kes as decimal(18,2)) as varchar), 'N/A'), ',' order by w.product_id) as items from t cross join w left join f on f.store_id = t.store_id and f.product_id = w.product_id group by t.store_id) select store_id, total, items_found, items from t join l using (store_id)", "prices", "products"),
    "basket_recommendation": with_tables(f"with {_LATEST}, t as (select store_id, cast(sum(cast(price_kes as decimal(18,2))) as double) as total, count(*) as items_found from latest join products using (product_id) where {BASKET} group by store_id) select store_id, total, items_found, round((select max(total) from t) - total, 2) as savings from t order by items_found desc, total, store_id limit 1", "prices", "products"),
    "sort_multi": with_tables(f"with {_LATEST} select store_id, count(*) as items_found, cast(sum(cast(price_kes as decimal(18,2))) as double) as total from latest join products using (product_id) where {BASKET} group by store_id", "prices", "products"),
    "avg_price_7d": with_tables(f"select product_id, round(avg(price_kes), 4) as avg_price, count(*) as samples from prices where verified_at >= timestamp '{AS_OF}' - interval 7 day and verified_at < timestamp '{AS_OF}' group by product_id", "prices"),
    "priced_products_semi": with_tables("select product_id, name from products where product_id in (select product_id from prices)", "products", "prices"),
    "fallback_product_join": with_tables(f"with {_LATEST}, w as (select product_id, lower(name) as term, store_id from products cross join stores where {BASKET}), o as (select latest.store_id, lower(name) as term, price_kes, latest.product_id from latest join products using (product_id)), b as (select store_id, term, arg_min(product_id, struct_pack(a := price_kes, b := product_id)) as other, min(price_kes) as other_price from o group by all) select w.product_id, w.store_id, coalesce(l.price_kes, other_price) as price_kes, coalesce(case when l.price_kes is not null then w.product_id end, other) as used_id from w left join latest l on l.product_id = w.product_id and l.store_id = w.store_id left join b on b.term = w.term and b.store_id = w.store_id", "prices", "products", "stores"),
    "cheapest_match": with_tables(f"with {_LATEST}, c as (select product_id, min(price_kes) as price_kes from latest group by product_id), m as (select lower(name) as term, product_id, size / 50.0 as confidence from products qualify row_number() over (partition by lower(name) order by size / 50.0 desc, product_id) <= 5) select product_id, term, cast(confidence as double) as confidence, price_kes from m left join c using (product_id) qualify row_number() over (partition by term order by price_kes nulls last, confidence desc, product_id) = 1", "prices", "products"),
    "ordered_id_lookup": with_tables("with i as (select log_id, product_id * 2 as product_id, row_number() over (partition by log_id order by line_no, product_id) - 1 as place from log_items) select log_id as request, place, product_id, name from i join products using (product_id)", "log_items", "products"),
    "double_left_lookup": with_tables("with n as (select * from prices order by verified_at desc, batch_id desc, line_no desc, product_id desc, store_id desc, price_kes desc limit 50) select product_id, name, store_id, chain, price_kes, verified_at from n left join products using (product_id) left join stores using (store_id)", "prices", "products", "stores"),
    "cross_join_prices": with_tables(f"select product_id, store_id, floor((cast(round(base_price * 100) as bigint) * (100 + store_id % 10) + 50) / 100) / 100.0 as price from products cross join stores", "products", "stores"),
    "resolve_or_create_store": with_tables("select chain, town, case when store_id % 2 = 0 then cast(store_id as varchar) else 'new-' || substr(md5(lower(chain) || chr(31) || lower(town)), 1, 16) end as store_id from stores", "stores"),
    "dedup_items": with_tables("with i as (select product_id, store_id, source, round(price_kes / 10000, 0) * 10000 as price_kes from prices) select distinct product_id, store_id, source, price_kes, md5(product_id || '|' || store_id || '|' || cast(cast(price_kes as decimal(18,2)) as varchar) || '|' || lower(source)) as item_key from i", "prices"),
    "sink_daily_upsert": with_tables("with r as (select *, case when batch_id % 3 = 0 then 1 else 0 end as fresh, cast(verified_at as date) as day from prices) select product_id, store_id, source, day, price_kes, verified_at, is_promotional, min(verified_at) over (partition by product_id, store_id, source, day) as created_at from r qualify row_number() over (partition by product_id, store_id, source, day order by fresh desc, verified_at desc, batch_id desc, line_no desc, price_kes desc, is_promotional desc) = 1", "prices"),
    "format_price": with_tables("select batch_id, line_no, product_id, store_id, case when line_no % 2 = 0 then cast(cast(floor(price_kes) as bigint) as varchar) || '.5 KES' else cast(cast(floor(price_kes) as bigint) as varchar) || ' KES' end as shown from prices", "prices"),
    "share_of_max": with_tables(f"with {_LATEST}, c as (select product_id, min(price_kes) as p from latest group by product_id) select product_id, round(p / max(p) over (partition by brand), 6) as share from c join products using (product_id)", "prices", "products"),
    "tail_align": with_tables("select product_id, store_id, verified_at, batch_id, line_no, row_number() over (partition by product_id, store_id order by verified_at desc, batch_id desc, line_no desc) as from_end from prices", "prices"),
    "running_position": with_tables("select product_id, store_id, verified_at, batch_id, line_no, row_number() over (partition by product_id, store_id order by verified_at, batch_id, line_no) as position from prices", "prices"),
    "first_seen_distinct": with_tables("with f as (select log_id, product_id, min(struct_pack(a := line_no, b := product_id)) as seen from log_items group by all), s as (select log_id, string_agg(product_id, ',' order by seen) as items from f group by log_id) select log_id, items from logs left join s using (log_id)", "log_items", "logs"),
    "in_set": with_tables("select batch_id, line_no, product_id, store_id from prices where source in ('A', 'R')", "prices"),
    "iequals": with_tables("select product_id from products where lower(name) = 'small ring'", "products"),
    "array_first": with_tables("with f as (select log_id, arg_min(product_id, struct_pack(a := line_no, b := product_id)) as first from log_items group by log_id) select log_id, first from logs left join f using (log_id)", "log_items", "logs"),
    "topk": with_tables("select product_id, store_id, price_kes from prices order by price_kes desc, product_id, store_id limit 50", "prices"),
    "paginate": with_tables("select product_id, name from products order by name, product_id limit 50 offset 100", "products"),
    "point_lookup": with_tables("select product_id, name, brand, category from products where product_id = 77", "products"),
    "price_bounds": with_tables("select source, count(*) as n from prices where price_kes between 0.01 and 50000 group by source", "prices"),
}
