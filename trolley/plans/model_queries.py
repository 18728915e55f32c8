"""Registered queries of mining, graph, trust and search, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.operators import anomaly as A
from trolley.operators import graph as G
from trolley.operators import mining as M
from trolley.operators import search as Q
from trolley.operators import trust as U
from trolley.operators import windows as W
from trolley.plans.bindings import AS_OF, EVENTS_AS_OF, Tables, with_tables
from trolley.plans.price_queries import _LATEST
from trolley.plans.text_queries import RAW_UNITS, WORDS


def _cooccur(t: Tables) -> DataFrame:
    return M.cooccurrence_counts(t.log_items(), 5)


def _similar(t: Tables) -> DataFrame:
    return M.cosine_similarity_items(_cooccur(t))


def _recommended(t: Tables) -> DataFrame:
    basket = t.products().where("product_id % 40 = 3").select("product_id")
    return M.recommend_for_basket(basket, M.most_similar(_cooccur(t), 100, basket).drop("rank"), 10)


def _by_brand(t: Tables) -> DataFrame:
    """Prices with brand as product and town as store: long enough series."""
    towns = t.raw("supplier").select(F.col("s_suppkey").alias("store_id"), F.col("s_nationkey").alias("town"))
    return t.prices().join(t.products().select("product_id", "brand"), "product_id").join(towns, "store_id")


def _series(t: Tables) -> DataFrame:
    return M.mean_series(_by_brand(t), ["brand", "town"], "month")


def _typed(t: Tables) -> DataFrame:
    return t.products().withColumn("category", F.concat_ws(" ", "category", "brand")).withColumn("sizes", F.array("size"))


def _sessions(t: Tables) -> DataFrame:
    return G.anchored_sessions(t.traffic())


def _sellers(t: Tables) -> DataFrame:
    made = lambda days: F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(days.cast("int"))
    return t.sellers().withColumn("created_at", made((F.col("s_suppkey") % 10) * 100 + 30)).withColumn("updated_at", made((F.col("s_suppkey") % 7) * 20))


def _queries(t: Tables) -> DataFrame:
    return t.vectors().where("product_id % 50 = 0").select(F.col("product_id").alias("query_id"), "embedding")


def _asked(t: Tables) -> DataFrame:
    """Misspelt names: every product's name without its second letter, as queries."""
    return t.products().select(F.col("product_id").alias("query_id"), F.concat(F.substring("name", 1, 1), F.expr("substring(name, 3)")).alias("text"), "brand", "category")


def _shelf(t: Tables) -> DataFrame:
    """Products with the unit that their titles are written with, and their category's last word as an alias."""
    unit = F.element_at(F.array(*map(F.lit, RAW_UNITS)), (F.col("product_id") % 5 + 1).cast("int"))
    return t.products().withColumns({"unit": unit, "aliases": F.array(F.lower(F.element_at(F.split("category", " "), -1)))})


def _misspelt(t: Tables) -> DataFrame:
    """Whole searches: a name without its second letter, then brand and quantity."""
    return _shelf(t).where("product_id % 50 = 0").select(
        F.col("product_id").alias("query_id"), F.concat(F.substring("name", 1, 1), F.expr("substring(name, 3)"), F.lit(" "), F.col("brand"), F.lit(" "), F.col("size").cast("string"), F.col("unit")).alias("text"))


def _submitted(t: Tables, lines: int = 1) -> DataFrame:
    return t.reviews().where(F.col("line_no") <= lines).select("session_id", "seller_id", F.when(F.col("session_id") % 5 == 0, -1).otherwise(F.col("reviewer_id")).alias("reviewer_id"), F.col("created_at").alias("at"))


def _buyers(t: Tables) -> DataFrame:
    return t.raw("orders").where("o_orderkey % 7 > 0").select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("buyer_id"))


_ITEMS5 = "kept as (select * from log_items where product_id in (select product_id from log_items group by product_id having count(*) >= 5)), placed as (select *, row_number() over (partition by log_id order by line_no, product_id) as place from kept), half as (select least(a.product_id, b.product_id) as item_a, greatest(a.product_id, b.product_id) as item_b, count(*) as n from placed a join placed b on a.log_id = b.log_id and a.place < b.place and a.product_id <> b.product_id group by all), pairs as (select * from half union all select item_b, item_a, n from half)"
_COSINE = f"{_ITEMS5}, norms as (select item_a, sqrt(sum(n * n)) as norm from pairs group by item_a), unit as (select item_a as item, item_b as shared, n / norm as w from pairs join norms using (item_a)), halfsim as (select a.item as item_a, b.item as item_b, round(least(1.0, sum(a.w * b.w) + 1e-9), 6) as similarity from unit a join unit b on a.shared = b.shared and a.item < b.item group by all), sim as (select * from halfsim union all select item_b, item_a, similarity from halfsim)"
_SERIES = "b as (select p_brand as brand, s_nationkey as town, date_trunc('month', l_shipdate) as t, floor(sum(cast(round(l_extendedprice * 100) as bigint)) * 100 / count(*)) / 10000.0 as price from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey group by all), series as (select *, row_number() over (partition by brand, town order by t) as position from b)"
_TYPED = "typed as (select product_id as id, name, category || ' ' || brand as key, brand, size from products)"
_CORR = "corr_pairs as (select a.brand, a.town as store_a, b.town as store_b, count(*) as points, round(coalesce(case when isnan(corr(a.price, b.price)) then 0 else corr(a.price, b.price) end, 0), 6) as correlation from series a join series b on a.brand = b.brand and a.t = b.t and a.town < b.town group by all having count(*) >= 10)"
_SELLERS = f"s as (select *, timestamp '{AS_OF}' - to_days(cast((s_suppkey % 10) * 100 + 30 as int)) as created_at, timestamp '{AS_OF}' - to_days(cast((s_suppkey % 7) * 20 as int)) as updated_at from sellers), r as (select seller_id, avg(rating) as a, count(*) as n from reviews group by seller_id), scored as (select s.*, round(greatest(0, least(5, case when n > 0 then 0.4 * a + 0.2 * least(n / 50 * 5, 5) + 0.2 * (least(5.0, least(age, 365) / 365 * 5) * case when age > 365 then pow(0.95, (age - 365) / 365) else 1.0 end) + 0.1 * case verification_status when 'verified' then 5.0 when 'rejected' then 0.0 else 1.0 end + 0.1 * case when idle > 90 then 0.0 else greatest(0.0, 5.0 - idle / 30) end else case verification_status when 'verified' then 3.0 when 'rejected' then 0.0 else 1.0 end end)), 6) as credibility_score from (select *, (s_suppkey % 10) * 100 + 30 as age, (s_suppkey % 7) * 20 as idle from s) s left join r using (seller_id))"

QUERIES = {
    "basket_pairs": lambda t: M.basket_pairs(t.log_items()).groupBy("log_id").agg(F.count(F.lit(1)).alias("n")),
    "cooccurrence_counts": _cooccur,
    "cosine_similarity_items": _similar,
    "similar_products": lambda t: M.most_similar(_cooccur(t), 10),
    "recommend_for_basket": _recommended,
    "cheaper_substitute": lambda t: M.cheaper_substitutes(_cooccur(t), t.prices().groupBy("product_id").agg(M.mean_price().alias("avg_price"))),
    "price_series": _series,
    "store_pair_series": lambda t: M.series_pairs(_series(t), "brand", "town").select("brand", "store_a", "store_b", "n_a", "n_b"),
    "pearson_corr": lambda t: M.pearson_corr(_series(t), "brand", "town"),
    "pearson_corr_tail": lambda t: M.pearson_corr(_series(t), "brand", "town", align="tail"),
    "lead_lag": lambda t: M.lead_lag(_series(t), "brand", "town"),
    "price_correlations": lambda t: M.mirrored(M.lead_lag(_series(t), "brand", "town")),
    "leader_followers": lambda t: M.leader_followers(M.lead_lag(_series(t), "brand", "town")),
    "same_category_pairs": lambda t: G.same_category_pairs(t.products()),
    "substitute_pairs": lambda t: G.substitute_pairs(t.products()),
    "size_variant_pairs": lambda t: G.size_variant_pairs(_typed(t)),
    "same_category_links": lambda t: G.same_category_links(_typed(t)),
    "substitute_links": lambda t: G.substitute_links(t.products().withColumn("category", F.concat_ws(" ", "category", "name"))),
    "size_variant_links": lambda t: G.size_variant_links(_typed(t)).select("product_id", "members", "links"),
    "anchored_sessions": _sessions,
    "co_queried_pairs": lambda t: G.co_queried_pairs(_sessions(t), t.products()),
    "align_vectors": lambda t: G.align_vectors(t.products(), t.vectors(), 64).select("product_id", "known", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total")),
    "alignment_stats": lambda t: G.alignment_stats(t.products(), t.vectors()),
    "unmatched_vectors": lambda t: t.vectors().join(t.products(), "product_id", "left_anti").select("product_id"),
    "known_ids_intersection": lambda t: t.vectors().join(t.products(), "product_id", "left_semi").select("product_id"),
    "graph_stats": lambda t: G.graph_totals(_typed(t), _sessions(t)),
    "vector_stats": lambda t: t.vectors().agg(F.count(F.lit(1)).alias("points"), F.max(F.size("embedding")).cast("long").alias("dimension")),
    "review_stats": lambda t: U.review_stats(t.sellers(), t.reviews()).select("seller_id", "avg_rating", "review_count"),
    "credibility_score": lambda t: U.credibility_score(_sellers(t), t.reviews(), AS_OF).select("seller_id", "credibility_score"),
    "credibility_new_sellers": lambda t: U.credibility_score(_sellers(t), t.reviews().where("seller_id % 2 = 0"), AS_OF).where("seller_id % 2 = 1").select("seller_id", "credibility_score"),
    "review_bursts": lambda t: U.review_bursts(t.reviews(), AS_OF, 120, 5, 0.0),
    "flag_sellers": lambda t: U.flag_sellers(t.sellers(), U.review_bursts(t.reviews(), AS_OF, 120, 5, 0.0), AS_OF).select("seller_id", "is_flagged", "flag_reason", "flagged_at"),
    "seller_topk": lambda t: U.seller_topk(U.credibility_score(_sellers(t), t.reviews(), AS_OF), "supplier").select("seller_id", "credibility_score", "position"),
    "review_rate_limit": lambda t: U.review_rate_limit(_submitted(t), t.reviews().where("line_no > 1")).select("session_id", "seller_id", "reviewer_id"),
    "admit_ratings": lambda t: U.admit_ratings(_submitted(t, 2), _buyers(t), t.reviews().where("line_no > 2")).select("session_id", "seller_id", "reviewer_id", "outcome"),
    "session_party_join": lambda t: U.session_party_join(t.reviews().select("session_id", "seller_id", F.col("reviewer_id").alias("buyer_id")), t.sellers().select(F.col("seller_id").alias("user_id"))).groupBy("user_id", "party").agg(F.count(F.lit(1)).alias("n")),
    "reviewer_totals_join": lambda t: t.reviews().where("rating = 5").join(t.reviews().groupBy("reviewer_id").agg(F.count(F.lit(1)).alias("lifetime")), "reviewer_id").groupBy("seller_id").agg(F.sum("lifetime").alias("lifetime")),
    "knn_join": lambda t: Q.knn_join(_queries(t), t.vectors(), 20),
    "fuzzy_cross_match": lambda t: Q.fuzzy_cross_match(_asked(t), Q.product_terms(t.products())),
    "exact_then_fuzzy": lambda t: Q.exact_then_fuzzy(_asked(t), Q.product_terms(t.products())),
    "suggest_corrections": lambda t: Q.suggest_corrections(_asked(t), Q.product_terms(t.products())),
    "keep_best_score": lambda t: Q.best_scores(_asked(t), Q.product_terms(t.products())),
    "find_product": lambda t: Q.find_product(_asked(t), Q.product_terms(t.products())),
    "search_products": lambda t: Q.search_products(_misspelt(t), _shelf(t), WORDS),
    "embed_text": lambda t: A.embed_text(t.products(), "name").select("product_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding")),
    "anomaly_features": lambda t: A.anomaly_features(t.prices()).select("product_id", "store_id", "batch_id", "line_no", F.round("log_price", 6).alias("log_price")),
    "flag_anomalies": lambda t: A.flag_by_median(t.prices(), "source").select("product_id", "store_id", "batch_id", "line_no", "is_anomaly"),
    "iforest_fit": lambda t: A.iforest_fit(t.prices(), AS_OF, 400),
    "iforest_score": lambda t: A.iforest_score(t.prices(), A.iforest_fit(t.prices(), AS_OF, 400)).select("product_id", "store_id", "batch_id", "line_no", "anomaly_score", "is_anomaly"),
    "assign_rank": lambda t: W.assign_rank(t.stores().select("store_id", "county"), ["store_id"], ["county"]),
    "symmetric_edges": lambda t: G.symmetric_edges(t.log_items().select(F.col("log_id").alias("src"), F.col("product_id").alias("dst"))),
    "union_keys": lambda t: t.vectors().select("product_id").union(t.products().select("product_id")).distinct(),
    "halves_full_outer": lambda t: t.log_items().where("line_no <= 3").groupBy("product_id").agg(F.count(F.lit(1)).alias("old")).join(t.log_items().where("line_no > 3").groupBy("product_id").agg(F.count(F.lit(1)).alias("new")), "product_id", "full_outer").fillna(0),
}

ORACLES = {
    "basket_pairs": with_tables("with placed as (select *, row_number() over (partition by log_id order by line_no, product_id) as place from log_items) select a.log_id, count(*) as n from placed a join placed b on a.log_id = b.log_id and a.place < b.place and a.product_id <> b.product_id group by a.log_id", "log_items"),
    "cooccurrence_counts": with_tables(f"with {_ITEMS5} select * from pairs", "log_items"),
    "cosine_similarity_items": with_tables(f"with {_COSINE} select * from sim", "log_items"),
    "similar_products": with_tables(f"with {_COSINE} select item_a, item_b, similarity, row_number() over (partition by item_a order by similarity desc, item_b) as rank from sim where similarity > 0 qualify rank <= 10", "log_items"),
    "cheaper_substitute": with_tables(f"with {_COSINE}, av as (select product_id, floor(sum(cast(round(price_kes * 100) as bigint)) * 100 / count(*)) / 10000.0 as p from prices group by product_id), j as (select item_a, item_b, similarity, x.p as price_a, y.p as price_b from sim join av x on x.product_id = item_a join av y on y.product_id = item_b where y.p <= x.p) select *, case when price_a > 0 then round((price_a - price_b) * 100 / price_a, 1) else 0.0 end as savings_percent from j qualify row_number() over (partition by item_a order by similarity desc, item_b) = 1", "log_items", "prices"),
    "price_series": f"with {_SERIES} select * from series",
    "store_pair_series": f"with {_SERIES}, n as (select brand, town, count(*) as n from series group by all having count(*) >= 10) select a.brand, a.town as store_a, b.town as store_b, a.n as n_a, b.n as n_b from n a join n b on a.brand = b.brand and a.town < b.town",
    "pearson_corr": f"with {_SERIES}, {_CORR} select * from corr_pairs",
    "pearson_corr_tail": f"with {_SERIES.replace('series as (select *,', 'series0 as (select *,')}, series as (select brand, town, price, row_number() over (partition by brand, town order by t desc) as t from series0), {_CORR} select * from corr_pairs",
    "same_category_pairs": with_tables("select a.product_id as src, b.product_id as dst from products a join products b on a.category = b.category and a.product_id <> b.product_id", "products"),
    "substitute_pairs": with_tables("select a.product_id as src, b.product_id as dst from products a join products b on a.category = b.category and a.brand <> b.brand", "products"),
    "size_variant_pairs": with_tables(f"with {_TYPED} select a.id as src, b.id as dst from typed a join typed b on lower(a.name) = lower(b.name) and lower(a.brand) = lower(b.brand) and a.id <> b.id and a.size <> b.size", "products"),
    "same_category_links": with_tables(f"with {_TYPED} select id as product_id, key as class, count(*) over (partition by key) as members, count(*) over (partition by key) - 1 as links from typed", "products"),
    "substitute_links": with_tables("select product_id, category || ' ' || name as class, count(*) over (partition by category, name) as members, count(*) over (partition by category, name) - count(*) over (partition by category, name, brand) as links from products", "products"),
    "size_variant_links": with_tables("select product_id, count(*) over (partition by lower(name), lower(brand)) as members, count(*) over (partition by lower(name), lower(brand)) - count(*) over (partition by lower(name), lower(brand), size) as links from products", "products"),
    "alignment_stats": with_tables("select count(*) filter (p.product_id is not null and v.product_id is not null) as aligned, count(*) filter (v.product_id is null) as without_vector, count(*) filter (p.product_id is null) as without_product from products p full join vectors v on p.product_id = v.product_id", "products", "vectors"),
    "unmatched_vectors": with_tables("select product_id from vectors where product_id not in (select product_id from products)", "products", "vectors"),
    "known_ids_intersection": with_tables("select product_id from vectors intersect select product_id from products", "products", "vectors"),
    "vector_stats": with_tables("select count(*) as points, max(len(embedding)) as dimension from vectors", "vectors"),
    "review_stats": with_tables("select seller_id, round(coalesce(avg(rating), 0), 2) as avg_rating, count(rating) as review_count from sellers left join reviews using (seller_id) group by seller_id", "sellers", "reviews"),
    "credibility_score": with_tables(f"with {_SELLERS} select seller_id, credibility_score from scored", "sellers", "reviews"),
    "credibility_new_sellers": with_tables("select seller_id, case verification_status when 'verified' then 3.0 when 'rejected' then 0.0 else 1.0 end::double as credibility_score from sellers where seller_id % 2 = 1", "sellers"),
    "review_bursts": with_tables(f"with l as (select reviewer_id, count(*) as lifetime from reviews group by all) select seller_id, count(*) as recent, count(*) filter (lifetime = 1) as new_accounts from reviews join l using (reviewer_id) where created_at >= timestamp '{AS_OF}' - interval 120 day group by seller_id having count(*) > 5 and count(*) filter (lifetime = 1) > 0", "reviews"),
    "flag_sellers": with_tables(f"with l as (select reviewer_id, count(*) as lifetime from reviews group by all), b as (select seller_id from reviews join l using (reviewer_id) where created_at >= timestamp '{AS_OF}' - interval 120 day group by seller_id having count(*) > 5 and count(*) filter (lifetime = 1) > 0) select seller_id, seller_id in (select * from b) as is_flagged, case when seller_id in (select * from b) then 'review burst' end as flag_reason, case when seller_id in (select * from b) then timestamp '{AS_OF}' end as flagged_at from sellers", "reviews", "sellers"),
    "seller_topk": with_tables(f"with {_SELLERS} select seller_id, credibility_score, row_number() over (order by credibility_score desc, seller_id) as position from scored qualify position <= 10", "sellers", "reviews"),
    "review_rate_limit": with_tables("with c as (select session_id, seller_id, case when session_id % 5 = 0 then -1 else reviewer_id end as reviewer_id, created_at as at_time from reviews where line_no = 1) select session_id, seller_id, reviewer_id from c where not exists (select 1 from reviews r where r.line_no > 1 and r.seller_id = c.seller_id and r.reviewer_id = c.reviewer_id and r.created_at < at_time and r.created_at >= at_time - interval 30 day)", "reviews"),
    "session_party_join": with_tables("with u as (select seller_id as user_id from sellers) select user_id, 'buyer' as party, count(*) as n from reviews join u on reviewer_id = user_id group by all union all select user_id, 'seller', count(*) from reviews join u on seller_id = user_id group by all", "reviews", "sellers"),
    "reviewer_totals_join": with_tables("with l as (select reviewer_id, count(*) as lifetime from reviews group by all) select seller_id, cast(sum(lifetime) as bigint) as lifetime from reviews join l using (reviewer_id) where rating = 5 group by seller_id", "reviews"),
    "knn_join": with_tables("with q as (select product_id as query_id, embedding as qe from vectors where product_id % 50 = 0), s as (select query_id, product_id, round(list_cosine_similarity(cast(qe as double[]), cast(embedding as double[])), 6) as score from q, vectors) select *, row_number() over (partition by query_id order by score desc, product_id) as rank from s qualify rank <= 20", "vectors"),
    "anomaly_features": with_tables("select product_id, store_id, batch_id, line_no, round(ln(price_kes + 1e-8), 6) as log_price from prices where price_kes > 0", "prices"),
    "flag_anomalies": with_tables("with m as (select source, median(price_kes) as med from prices group by source), d as (select source, median(abs(price_kes - med)) as mad from prices join m using (source) group by source) select product_id, store_id, batch_id, line_no, abs(price_kes - med) > 2.0 * mad as is_anomaly from prices join m using (source) join d using (source)", "prices"),
    "assign_rank": with_tables("select store_id, county, row_number() over (partition by county order by store_id) as rank from stores", "stores"),
    "symmetric_edges": with_tables("select log_id as src, product_id as dst from log_items union select product_id, log_id from log_items", "log_items"),
    "union_keys": with_tables("select product_id from vectors union select product_id from products", "vectors", "products"),
    "halves_full_outer": with_tables("select product_id, count(*) filter (line_no <= 3) as old, count(*) filter (line_no > 3) as new from log_items group by product_id", "log_items"),
}
_LAGGED = f"{_SERIES}, n as (select brand, town, count(*) as n from series group by all having count(*) >= 10), pr as (select a.brand, a.town as store_a, b.town as store_b, a.n as n_a, b.n as n_b from n a join n b on a.brand = b.brand and a.town < b.town), lg as (select pr.*, lag from pr, range(-10, 11) r(lag) where abs(lag) <= least(n_a // 2, n_b // 2, 10)), pt as (select lg.brand, store_a, store_b, lag, round(coalesce(case when isnan(corr(a.price, b.price)) then 0 else corr(a.price, b.price) end, 0), 6) as c from lg join series a on a.brand = lg.brand and a.town = store_a join series b on b.brand = lg.brand and b.town = store_b and b.position = a.position + lag group by all having count(*) >= 10), z as (select *, row_number() over (partition by brand, store_a, store_b order by abs(c) desc, abs(lag), lag desc) as k, max(case when lag = 0 then c end) over (partition by brand, store_a, store_b) as c0 from pt), best as (select brand, store_a, store_b, coalesce(c0, 0.0) as correlation, lag, c as lag_correlation from z where k = 1 and abs(c) >= 0.1)"
ORACLES["lead_lag"] = f"with {_LAGGED} select * from best"
ORACLES["price_correlations"] = f"with {_LAGGED} select * from best union all select brand, store_b, store_a, correlation, -lag, lag_correlation from best"
ORACLES["leader_followers"] = f"with {_LAGGED} select brand, correlation, lag, lag_correlation, case when lag > 0 then store_a else store_b end as leader, case when lag > 0 then store_b else store_a end as follower, abs(lag_correlation) as confidence from best where abs(lag_correlation) > abs(correlation) + 0.1 and abs(lag_correlation) > 0.3 and lag <> 0"
ORACLES["anchored_sessions"] = with_tables("""with recursive e as (select user_id, ts, product_id, row_number() over (partition by user_id order by ts, product_id) as i from traffic),
walk as (select user_id, ts, product_id, i, ts as anchor, 0 as session from e where i = 1
  union all select e.user_id, e.ts, e.product_id, e.i, case when e.ts - walk.anchor > interval 30 minute then e.ts else walk.anchor end, case when e.ts - walk.anchor > interval 30 minute then walk.session + 1 else walk.session end from walk join e on e.user_id = walk.user_id and e.i = walk.i + 1)
select user_id, ts, product_id, cast(session as bigint) as session from walk""", "traffic").replace("with traffic", "with recursive traffic", 1).replace(", recursive e as", ", e as")
_GRAPH = f"""{_TYPED}, sess as ({ORACLES["anchored_sessions"]}),
visits as (select distinct user_id, session, product_id as id from sess where product_id in (select product_id from products)),
co_queried as (select distinct a.id as src, b.id as dst from visits a join visits b using (user_id, session) where a.id <> b.id),
edges as (
  select a.id as src, b.id as dst, 'same_category' as edge_type from typed a join typed b on a.key = b.key and a.id <> b.id
  union all select a.id, b.id, 'size_variant' from typed a join typed b on lower(a.name) = lower(b.name) and lower(a.brand) = lower(b.brand) and a.size <> b.size
  union all select a.id, b.id, 'substitute' from typed a join typed b on a.key = b.key and a.brand <> b.brand
  union all select src, dst, 'co_queried' from co_queried)"""
ORACLES["co_queried_pairs"] = with_tables(f"with {_GRAPH} select * from co_queried", "products")
ORACLES["build_graph"] = with_tables(f"with {_GRAPH.replace("category || ' ' || brand as key", 'category as key')} select * from edges", "products")
ORACLES["graph_stats"] = with_tables(f"with {_GRAPH} select edge_type, count(*) as edges, count(distinct src) as nodes from edges group by all", "products")
ORACLES["align_vectors"] = with_tables("select product_id, embedding is not null as known, round(coalesce(list_sum(cast(embedding as double[])), 0), 4) as total from products left join vectors using (product_id)", "products", "vectors")
ORACLES["recommend_for_basket"] = with_tables(f"""with {_COSINE}, basket as (select product_id from products where product_id % 40 = 3),
lists as (select *, row_number() over (partition by item_a order by similarity desc, item_b) as place from sim where item_a in (from basket) qualify place <= 100),
other as (
  select item_b, sum(similarity) filter (place <= 20) as total, count(*) as n, list(item_a order by similarity desc, item_a) filter (place <= 20) as why
  from lists where item_b not in (from basket) group by item_b)
select item_b as product_id, round(total / n, 6) as score, array_to_string(list_transform(why[1:2], lambda x: 'Users who viewed ' || x), '; ') as reasons
from other where total is not null order by score desc, item_b limit 10""", "log_items", "products")
ORACLES["admit_ratings"] = with_tables("""with asked as (select session_id, seller_id, case when session_id % 5 = 0 then -1 else reviewer_id end as reviewer_id, created_at as at_time from reviews where line_no <= 2),
judged as (select asked.*, case when o_custkey is null then 'no session' when o_custkey <> reviewer_id then 'not the buyer'
  when exists (select 1 from reviews r where r.line_no > 2 and r.seller_id = asked.seller_id and r.reviewer_id = asked.reviewer_id and r.created_at < at_time and r.created_at >= at_time - interval 30 day) then 'rate limited'
  else 'ok' end as outcome from asked left join orders on o_orderkey = session_id and o_orderkey % 7 > 0)
select session_id, seller_id, reviewer_id, case when outcome = 'ok' and rank() over (partition by session_id, outcome order by at_time, seller_id) > 1 then 'already rated' else outcome end as outcome from judged""", "reviews")
