"""Registered queries of the remaining operators, most of them parts or combinations of others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.functions import scores as S
from trolley.functions import text as X
from trolley.operators import curation as C
from trolley.operators import graph as G
from trolley.operators import mining as M
from trolley.operators import prices as P
from trolley.operators import search as Q
from trolley.operators import trends as R
from trolley.operators import trust as U
from trolley.operators import validate as V
from trolley.operators import windows as W
from trolley.plans import ingest_queries as I
from trolley.plans import model_queries as MQ
from trolley.plans import price_queries as PQ
from trolley.plans import text_queries as TQ
from trolley.plans.bindings import AS_OF, EVENTS_AS_OF, Tables, with_tables


def _report(t: Tables) -> DataFrame:
    return R.report_rows(R.trends_report(t.logs(), t.log_items(), t.products(), AS_OF, 730))


def _shown_sellers(t: Tables) -> DataFrame:
    """Sellers with scores, of which some hide, are banned or have no description."""
    n = F.col("seller_id")
    return U.credibility_score(MQ._sellers(t), t.reviews(), AS_OF).withColumns({
        "opted_in_visible": n % 4 > 0, "is_banned": F.when(n % 11 == 0, True), "description": F.when(n % 2 == 0, F.concat(F.lit("A Supplier in "), F.col("town"))),
        "display_name": F.when(n % 3 == 0, F.concat(F.lit("Shop "), n.cast("string"))).otherwise(F.col("display_name")), "categories": F.when(n % 5 > 0, F.array(F.lit("milk"), F.lit("bread")))})


def _requests(t: Tables) -> DataFrame:
    """Chat requests from the events; they run out after ten minutes, some never began."""
    n = F.col("event_id")
    return t.traffic().select(
        n.alias("request_id"), F.when(n % 9 > 0, F.col("user_id")).otherwise(0).alias("buyer_user_id"), F.element_at(F.array(*map(F.lit, ("pending", "accepted", "declined", "expired", "lost"))), (n % 5 + 1).cast("int")).alias("status"),
        F.when(n % 6 == 0, F.repeat(F.lit("x"), 501)).alias("buyer_message"), F.col("ts").cast("timestamp").alias("created_at"), (F.col("ts").cast("timestamp") + F.make_dt_interval(mins=F.when(n % 8 > 0, 10).otherwise(-1))).alias("expires_at"))


def _recent_reviews(t: Tables) -> DataFrame:
    """The last month's reviews moved into the last week, each by a reviewer of its own for two sellers of three."""
    moved = t.reviews().where(F.col("created_at") >= "2001-08-01")
    return moved.select("seller_id", F.when(F.col("seller_id") % 3 > 0, -F.col("session_id") * 10 - F.col("line_no")).otherwise(F.col("reviewer_id") % 5).alias("reviewer_id"), "rating", F.lit("2001-11-02").cast("timestamp").alias("created_at"))


def _items(t: Tables) -> DataFrame:
    return t.products().where("product_id % 2 = 0").select("name", F.upper("brand").alias("brand"), F.col("size"))


def _known(t: Tables) -> DataFrame:
    """One catalogue row for each name and brand of the odd products."""
    return t.products().where("product_id % 2 = 1").groupBy("name", "brand").agg(F.min("product_id").alias("product_id"), F.array_sort(F.collect_set("size")).alias("sizes"))


def _found(t: Tables) -> DataFrame:
    return M.lead_lag(MQ._series(t), "brand", "town")


QUERIES = {
    "recent_prices": lambda t: P.recent_prices(t.prices(), t.products(), t.stores(), 50),
    "town_filter": lambda t: P.town_filter(t.stores(), " nation_3").select("store_id"),
    "project_price_rows": PQ.QUERIES["price_listing"],
    "item_key": lambda t: t.prices().select("batch_id", "line_no", "product_id", "store_id", P.item_key().alias("item_key")),
    "validate_business_rules": lambda t: TQ._raw_prices(t).select("batch_id", "line_no", "product_id", F.array_join(V.business_warnings(AS_OF), ",").alias("warnings")),
    "conditional_column": lambda t: C.category_suggestions(I._catalogue(t), I._dictionary(t)).select("product_id", F.when(F.col("category_status") == "suggested", F.col("suggested_category")).otherwise(F.col("brand")).alias("sort_key")),
    "lag_join": lambda t: M.lag_join(MQ._series(t), "brand", "town").groupBy("brand", "store_a", "store_b", "lag").agg(F.count(F.lit(1)).alias("points")),
    "correlations_for_product": lambda t: M.correlations_for(_found(t), "brand", "Brand#7"),
    "correlations_for_pair": lambda t: M.correlations_for(_found(t), "brand", "Brand#7", (3, 5)),
    "recommendation_details": lambda t: M.recommendation_details(M.most_similar(MQ._cooccur(t), 3), t.products()),
    "reason_text": lambda t: M.reasons_of(M.most_similar(MQ._cooccur(t), 2)),
    "reason_texts": lambda t: M.reasons_of(M.most_similar(MQ._cooccur(t), 2)),
    "cheaper_substitute_7d": lambda t: M.cheaper_substitutes(MQ._cooccur(t), P.avg_prices(t.prices(), "2001-01-08 00:00:00").select("product_id", "avg_price")),
    "reranked": lambda t: TQ._pairs(t).select("product_id", S.reranked(F.round(S.fuzzy_rerank_score(F.col("name"), F.col("other")), 6)).alias("score")).where("score is not null"),
    "find_sellers": lambda t: U.find_sellers(_shown_sellers(t), "supplier", "nation_1", "milk").select("seller_id", "credibility_score", "position"),
    "open_requests": lambda t: U.open_requests(_requests(t), "2024-01-15 00:00:00").select("request_id"),
    "seller_rules": lambda t: V.validate_schema(t.sellers().select("seller_id", F.when(F.col("seller_id") % 7 > 0, F.col("seller_id")).otherwise(-1).alias("telegram_user_id"), F.when(F.col("seller_id") % 5 > 0, F.col("town")).otherwise(" ").alias("town"), F.when(F.col("seller_id") % 3 == 0, "unknown").otherwise(F.col("verification_status")).alias("verification_status")), "sellers").select("seller_id", "reject_reason"),
    "request_rules": lambda t: V.validate_schema(_requests(t), "chat_requests").select("request_id", "reject_reason"),
    "session_rules": lambda t: V.validate_schema(_requests(t).select("request_id", "buyer_user_id", (F.col("buyer_user_id") - 40).alias("grocer_telegram_user_id"), F.when(F.col("request_id") % 4 == 0, "pending").otherwise("active").alias("status")), "chat_sessions").select("request_id", "reject_reason"),
    "review_bursts_7d": lambda t: U.review_bursts(_recent_reviews(t), AS_OF, 7, 5, 0.6).select("seller_id", "recent", "new_accounts"),
    "train_guards": lambda t: M.train_guard(t.logs(), 10, "logs").unionByName(M.train_guard(t.prices().where("product_id < 0"), 50, "prices")).unionByName(M.train_guard(M.frequent_items(t.log_items(), 5), 2, "items")),
    "recalculate_all_scores": lambda t: U.review_stats(U.credibility_score(MQ._sellers(t), t.reviews(), AS_OF), t.reviews()).select("seller_id", "credibility_score", "avg_rating", "review_count"),
    "resolve_or_create_product": lambda t: C.resolve_or_create_product(_items(t), _known(t)).select("product_id", F.lower("name").alias("name"), F.lower("brand").alias("brand"), F.size("sizes").cast("long").alias("n_sizes")),
    "build_graph": lambda t: G.build_graph(t.products().withColumn("sizes", F.array("size")), MQ._sessions(t))[1],
    "trends_report": _report,
    "best_per_key": lambda t: W.best_per_key(t.products().select("name", "product_id", "size"), ["name"], [F.col("size").desc(), "product_id"]),
    "last_wins": lambda t: W.last_wins(t.products().select("name", "product_id", "size"), ["name"], "product_id"),
    "recent_n": lambda t: t.logs().select("log_id", "user_id", "ts").orderBy(F.col("ts").desc(), F.col("log_id").desc()).limit(10),
    "category_score": lambda t: TQ._pairs(t).select("product_id", S.containment_score(F.col("name"), F.col("other")).alias("score")),
    "fuzzy_rerank_score": lambda t: TQ._pairs(t).select("product_id", F.round(S.fuzzy_rerank_score(F.col("name"), F.col("other")), 6).alias("score")),
    "query_attributes": lambda t: X.parse_query(TQ.titles(t).select("product_id", "title"), "title", TQ.WORDS).select("product_id", "query_category", "query_size", "query_unit"),
    "extract_package_type": lambda t: TQ.titles(t).select("product_id", X.first_contained(F.concat("title", F.lit(" in a box")), TQ.WORDS.packages).alias("package_type")),
    "extract_variant_flavour": lambda t: TQ._attributes(t).select("product_id", "variant", "flavour"),
    "canonical_name": lambda t: TQ._canonical(t).select("product_id", "canonical_name"),
    "canonical_aliases": lambda t: TQ._aliases(t).select("product_id", F.array_join("aliases", "|").alias("aliases")),
    "normalize_item": lambda t: TQ._aliases(t).select("product_id", "canonical_name", "brand", "category", "size", "unit", F.size("aliases").cast("long").alias("n_aliases")),
    "find_product_matches": lambda t: Q.find_product_matches(MQ._asked(t), Q.product_terms(t.products()), P.cheapest_per_product(PQ._latest(t))),
    "query_single_product": lambda t: Q.query_single_product(MQ._asked(t), Q.product_terms(t.products()), P.price_listing(t.prices(), t.stores(), "latest")),
    "backfill": lambda t: C.backfill(t.products(), C.change_rows(I._changes(t)), EVENTS_AS_OF, force=True).select("product_id", "intent", "status", "created_at"),
    "sweep": lambda t: C.fifo_batch(C.reset_stale(C.change_rows(I._changes(t)).withColumn("status", F.when(F.col("product_id") % 2 == 0, "processing").otherwise(F.col("status"))), EVENTS_AS_OF), EVENTS_AS_OF, 10).select("product_id", "created_at"),
}

ORACLES = {
    "recent_prices": PQ.ORACLES["double_left_lookup"],
    "town_filter": with_tables("select store_id from stores where town = 'NATION_3'", "stores"),
    "project_price_rows": PQ.ORACLES["price_listing"],
    "item_key": with_tables("select batch_id, line_no, product_id, store_id, md5(product_id || '|' || store_id || '|' || cast(cast(price_kes as decimal(18,2)) as varchar) || '|' || lower(source)) as item_key from prices", "prices"),
    "validate_business_rules": with_tables(f"with {TQ._RAW} select batch_id, line_no, product_id, concat_ws(',', case when try_cast(price_kes as double) > 100000 then 'high price' end, 'unknown source', case when line_no <> 2 and is_promotional then 'promotion without details' end, case when line_no <> 4 and verified_at < timestamp '{AS_OF}' - interval 730 day then 'very old' end) as warnings from raw", "prices"),
    "conditional_column": with_tables(f"with {I._GENERAL} select product_id, case when category_status = 'suggested' then suggested_category else brand end as sort_key from r", "products"),
    "lag_join": f"with {MQ._LAGGED}, k as (select lg.brand, store_a, store_b, lag, count(*) as points from lg join series a on a.brand = lg.brand and a.town = store_a join series b on b.brand = lg.brand and b.town = store_b and b.position = a.position + lag group by all) select * from k",
    "correlations_for_product": f"with {MQ._LAGGED} select * from best where brand = 'Brand#7'",
    "correlations_for_pair": f"with {MQ._LAGGED} select * from best where brand = 'Brand#7' and store_a = 3 and store_b = 5",
    "recommendation_details": with_tables(f"with {MQ._COSINE}, s as (select item_a, item_b, similarity, row_number() over (partition by item_a order by similarity desc, item_b) as rank from sim where similarity > 0 qualify rank <= 3) select item_a, item_b, similarity, rank, name, brand, category from s join products on product_id = item_b", "log_items", "products"),
    "reason_text": with_tables(f"with {MQ._COSINE}, s as (select item_a, item_b, row_number() over (partition by item_a order by similarity desc, item_b) as rank from sim where similarity > 0 qualify rank <= 2) select item_a, string_agg('Users who viewed ' || item_b, '; ' order by rank) as reason from s group by item_a", "log_items"),
    "train_guards": with_tables("select 'logs' as part, count(*) as n, count(*) >= 10 as enough from logs union all select 'prices', count(*) filter (product_id < 0), false from prices union all select 'items', count(*), count(*) >= 2 from (select product_id from log_items group by 1 having count(*) >= 5)", "logs", "prices", "log_items"),
    "recalculate_all_scores": with_tables(f"with {MQ._SELLERS} select seller_id, credibility_score, round(coalesce(a, 0), 2) as avg_rating, coalesce(n, 0) as review_count from scored left join r using (seller_id)", "sellers", "reviews"),
    "resolve_or_create_product": with_tables("with i as (select lower(name) as name, lower(brand) as brand, list(distinct size) as more from products where product_id % 2 = 0 group by all), k as (select lower(name) as name, lower(brand) as brand, min(product_id) as product_id, list(distinct size) as sizes from products where product_id % 2 = 1 group by all) select coalesce(cast(product_id as varchar), 'new-' || substr(md5(coalesce(i.name, k.name) || chr(31) || coalesce(i.brand, k.brand)), 1, 16)) as product_id, coalesce(i.name, k.name) as name, coalesce(i.brand, k.brand) as brand, len(list_distinct(list_concat(coalesce(more, []), coalesce(sizes, [])))) as n_sizes from i full join k on i.name = k.name and i.brand = k.brand", "products"),
    "best_per_key": with_tables("select name, product_id, size from products qualify row_number() over (partition by name order by size desc, product_id) = 1", "products"),
    "last_wins": with_tables("select name, product_id, size from products qualify row_number() over (partition by name order by product_id desc) = 1", "products"),
    "recent_n": with_tables("select log_id, user_id, ts from logs order by ts desc, log_id desc limit 10", "logs"),
    "category_score": with_tables(f"with {TQ._PAIR} select product_id, case when a = b then 1.0 when contains(a, b) or contains(b, a) then 0.5 else 0.0 end::double as score from p", "products"),
    "fuzzy_rerank_score": with_tables(f"with {TQ._PAIR}, q as (select *, array_to_string(list_sort(list_distinct(string_split(a, ' '))), ' ') as sa, array_to_string(list_sort(list_distinct(string_split(b, ' '))), ' ') as sb from p) select product_id, round(greatest(1 - levenshtein(a, b) / greatest(n, m), 1 - levenshtein(sa, sb) / greatest(length(sa), length(sb))), 6) as score from q", "products"),
    "query_attributes": with_tables("select product_id, case when name = 'small ring' then 'small ring' when name like '% ring' then 'ring' when name like '% widget' then 'widget' when name like '% gear' then 'gear' when name like '% bolt' then 'bolt' when name like '% nut' then 'nut' end as query_category, cast(size as double) as query_size, (['kg', 'ml', 'L', 'g', 'pcs'])[product_id % 5 + 1] as query_unit from products", "products"),
    "extract_package_type": with_tables("select product_id, 'box' as package_type from products", "products"),
    "backfill": with_tables(f"select product_id, 'backfill' as intent, 'pending' as status, timestamp '{EVENTS_AS_OF}' as created_at from products", "products"),
    "sweep": with_tables(f"select product_id, ts as created_at from traffic where product_id % 2 <> 0 or ts < timestamp '{EVENTS_AS_OF}' - interval 5 minute order by ts, product_id limit 10", "traffic"),
}
ORACLES["trends_report"] = with_tables(f"""with bounds as (select timestamp '{AS_OF}' - interval 730 day as a, timestamp '{AS_OF}' - interval 365 day as mid, timestamp '{AS_OF}' as z),
recent as (select logs.* from logs, bounds where ts >= a),
named as (select recent.town, recent.ts, product_id, name from recent join log_items using (log_id) join products using (product_id)),
town as (select town, product_id, name, count(*) as c from named group by all),
h as (select hour(ts) as hour, dayofweek(ts) as dow, count(*) as n from recent group by all),
sizes as (select count(product_id) as k from recent left join log_items using (log_id) group by log_id),
sized as (select k, count(*) as n from sizes group by k),
season as (select dayofweek(ts) + 1 as dow, strftime(ts, '%U') as week, month(ts) as month, count(*) as n from recent group by all),
prev as (select name as term, count(*) as p from named, bounds where ts < mid group by name order by p desc, term limit 50),
cur as (select name as term, count(*) as c from named, bounds where ts >= mid and ts < z group by name order by c desc, term limit 50),
g as (select coalesce(prev.term, cur.term) as term, coalesce(p, 0) as p, coalesce(c, 0) as c, case when coalesce(p, 0) > 0 then (coalesce(c, 0) - p) / p else 'inf'::double end as g from prev full join cur on prev.term = cur.term),
l as (select *, case when g > 0.5 then 'up' when g < -0.3 then 'down' else 'stable' end as label from g where c >= 5),
o as (select *, row_number() over (partition by label order by case label when 'up' then -g when 'down' then g else -(p + c) / 2 end, term) as rank from l)
select 'top_products_by_town' as analysis, town || '|' || name as label, product_id as k, c as n, cast(row_number() over (partition by town order by c desc, product_id) as double) as value from town qualify value <= 20
union all select 'query_volume_by_hour', '', hour, cast(sum(n) as bigint), round(avg(n), 4) from h group by hour
union all select 'basket_size_distribution', case when k <= 2 then 'small' when k <= 5 then 'medium' else 'large' end, k, n, round(n * 100.0 / sum(n) over (), 2) from sized
union all select 'seasonal_patterns', '', dow, cast(sum(n) as bigint), round(avg(n), 4) from season group by dow
union all select 'search_term_trends', label || '|' || term, rank, c, case when isfinite(g) then round(g, 2) end from o where rank <= 20""", "logs", "log_items", "products")
_REQUESTS = """requests as (select event_id as request_id, case when event_id % 9 > 0 then user_id else 0 end as buyer_user_id, (['pending', 'accepted', 'declined', 'expired', 'lost'])[event_id % 5 + 1] as status,
  event_id % 6 = 0 as too_long, ts as created_at, ts + to_minutes(cast(case when event_id % 8 > 0 then 10 else -1 end as int)) as expires_at from traffic)"""
ORACLES["open_requests"] = with_tables(f"with {_REQUESTS} select request_id from requests where status = 'pending' and expires_at > timestamp '2024-01-15'", "traffic")
ORACLES["request_rules"] = with_tables(f"""with {_REQUESTS} select request_id, case when coalesce(buyer_user_id, 0) <= 0 then 'buyer id' when status = 'lost' then 'status' when too_long then 'message length'
  when expires_at < created_at then 'expiry' end as reject_reason from requests""", "traffic")
ORACLES["session_rules"] = with_tables(f"with {_REQUESTS} select request_id, case when coalesce(buyer_user_id, 0) <= 0 then 'buyer id' when buyer_user_id <= 40 then 'seller id' when request_id % 4 = 0 then 'status' end as reject_reason from requests", "traffic")
ORACLES["seller_rules"] = with_tables("select seller_id, case when seller_id % 7 = 0 then 'seller id' when seller_id % 5 = 0 then 'town' when seller_id % 3 = 0 then 'verification status' end as reject_reason from sellers", "sellers")
ORACLES["find_sellers"] = with_tables(f"""with {MQ._SELLERS}, shown as (select *, case when seller_id % 3 = 0 then 'Shop ' || seller_id else display_name end as shown_name, case when seller_id % 2 = 0 then 'A Supplier in ' || town end as description from scored)
select seller_id, credibility_score, row_number() over (order by credibility_score desc, seller_id) as position from shown
where verification_status = 'verified' and seller_id % 4 > 0 and seller_id % 11 > 0 and (contains(lower(shown_name), 'supplier') or coalesce(contains(lower(description), 'supplier'), false)) and contains(lower(town), 'nation_1') and seller_id % 5 > 0
qualify position <= 10""", "sellers", "reviews")
ORACLES["review_bursts_7d"] = with_tables("""with r as (select seller_id, case when seller_id % 3 > 0 then -session_id * 10 - line_no else reviewer_id % 5 end as reviewer_id from reviews where created_at >= timestamp '2001-08-01'),
l as (select reviewer_id, count(*) as lifetime from r group by all)
select seller_id, count(*) as recent, count(*) filter (lifetime = 1) as new_accounts from r join l using (reviewer_id) group by seller_id having count(*) > 5 and count(*) filter (lifetime = 1) > 0.6 * count(*)""", "reviews")
ORACLES["reason_texts"] = with_tables(f"""with {MQ._COSINE}, top as (select item_a, item_b, row_number() over (partition by item_a order by similarity desc, item_b) as rank from sim qualify rank <= 2)
select item_a, string_agg('Users who viewed ' || item_b, '; ' order by rank) as reason from top group by item_a""", "log_items")
ORACLES["cheaper_substitute_7d"] = with_tables(f"""with {MQ._COSINE}, av as (select product_id, round(avg(price_kes), 4) as p from prices where verified_at >= timestamp '2001-01-01' and verified_at < timestamp '2001-01-08' group by product_id),
j as (select item_a, item_b, similarity, x.p as price_a, y.p as price_b from sim join av x on x.product_id = item_a join av y on y.product_id = item_b where y.p <= x.p)
select *, case when price_a > 0 then round((price_a - price_b) * 100 / price_a, 1) else 0.0 end as savings_percent from j qualify row_number() over (partition by item_a order by similarity desc, item_b) = 1""", "log_items", "prices")
ORACLES["reranked"] = f"select * from ({ORACLES['fuzzy_rerank_score']}) where score >= 0.6"
