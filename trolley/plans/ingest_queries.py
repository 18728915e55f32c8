"""Registered queries of page extraction, curation, the outbox and streams, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.operators import curation as C
from trolley.plans.bindings import EVENTS_AS_OF, Tables, with_tables
from trolley.sources import pages as G
from trolley.sources import tables as B
from trolley.streaming import streams as S

_INTENTS = {"signup": "create", "view": "update", "click": "update", "error": "delete", "purchase": "backfill"}


def _changes(t: Tables) -> DataFrame:
    intent = F.create_map(*[F.lit(x) for kv in _INTENTS.items() for x in kv])[F.col("text")]
    return t.traffic().select(F.col("event_id").alias("record_id"), "product_id", F.coalesce(intent, F.lit("update")).alias("intent"), F.col("ts").alias("created_at"))


def _catalogue(t: Tables) -> DataFrame:
    """Products of which every third has no category yet."""
    return t.products().withColumn("category", F.when(F.col("product_id") % 3 == 0, "general").otherwise(F.col("category")))


def _dictionary(t: Tables) -> DataFrame:
    """Categories by the last word of categorised names, without one of them."""
    last = F.element_at(F.split("name", " "), -1)
    return t.products().where("product_id % 3 > 0").select(last.alias("word"), F.upper(last).alias("suggested")).where("word <> 'ring'").distinct()


_GENERAL = "g as (select *, case when list_extract(string_split(name, ' '), -1) <> 'ring' then upper(list_extract(string_split(name, ' '), -1)) end as suggested_category from products where product_id % 3 = 0), r as (select *, case when suggested_category is null then 'unmatched' else 'suggested' end as category_status from g)"
_INTENT = "case text when 'signup' then 'create' when 'view' then 'update' when 'click' then 'update' when 'error' then 'delete' when 'purchase' then 'backfill' else 'update' end"

QUERIES = {
    "extract_html_items": lambda t: G.extract_html_items(t.raw("pages")),
    "extract_jsonld_items": lambda t: G.extract_jsonld_items(t.raw("pages").withColumn("html", F.concat("html", F.lit('<script type="application/ld+json">{"@type":"Product","name":"P'), "page_id", F.lit(' &amp; co","offers":{"price":"'), F.col("page_id") * 10, F.lit('","priceCurrency":"KES"}}</script>')))),
    "extract_links": lambda t: G.extract_links(t.raw("pages")),
    "detect_promo": lambda t: t.prices().select("batch_id", "line_no", "product_id", "store_id", G.detect_promo(F.col("price_kes") * 0.9, F.when(F.col("is_promotional"), F.col("price_kes")), F.lit(" ")).alias("promo")),
    "item_defaults": lambda t: G.item_defaults(t.products().select("product_id", F.when(F.col("size") > 25, "Shop").alias("store_branch")), "Naivas", EVENTS_AS_OF),
    "scan_table": lambda t: B.scan_table(t.spark, f"{t.dir}/lineitem.parquet", (F.col("l_shipdate") >= "2001-01-01") & (F.col("l_discount") >= 0.09), ("l_orderkey", "l_linenumber", "l_extendedprice")),
    "scan_vectors": lambda t: B.scan_table(t.spark, f"{t.dir}/embeddings.parquet", None, ("vec_id", "label")),
    "sink_vector_upsert": lambda t: B.merge_last_wins(t.products().select("product_id", "name", F.lit(0).alias("seq")), t.products().where("product_id % 5 = 0").select("product_id", F.upper("name").alias("name"), F.lit(1).alias("seq")), ["product_id"], "seq"),
    "sink_delete_keys": lambda t: B.delete_keys(t.vectors().select("product_id", "label"), t.products().where("product_id % 4 = 0"), ["product_id"]),
    "category_suggestions": lambda t: C.category_suggestions(_catalogue(t), _dictionary(t)).select("product_id", "suggested_category", "category_status"),
    "category_status_counts": lambda t: C.category_suggestions(_catalogue(t), _dictionary(t)).groupBy("category_status").agg(F.count(F.lit(1)).alias("n")),
    "confirm_category": lambda t: C.confirm_category(_catalogue(t), t.products().where("product_id % 6 = 0").select("product_id", F.lit("decided").alias("decided"))).select("product_id", "category"),
    "conditional_sort": lambda t: C.category_review(C.category_suggestions(_catalogue(t), _dictionary(t))).select("product_id", "category_status", "sort_key", "name"),
    "category_review_filter": lambda t: C.category_review(C.category_suggestions(_catalogue(t), _dictionary(t)), "unmatched").select("product_id", "sort_key"),
    "add_to_set": lambda t: t.products().select("product_id", F.size(C.add_to_set(F.array("size"), F.array(F.lit(10), F.lit(20)))).cast("long").alias("n")),
    "alias_union": lambda t: t.products().select("product_id", F.array_join(F.array_sort(F.array_union(F.split("name", " "), F.array(F.lower("brand"), F.lit("red")))), ",").alias("aliases")),
    "change_row": lambda t: C.change_rows(_changes(t)).groupBy("intent", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("attempts").alias("attempts")),
    "latest_intents": lambda t: C.latest_intents(_changes(t)),
    "fifo_batch": lambda t: C.fifo_batch(C.change_rows(_changes(t)), EVENTS_AS_OF, 10).select("product_id", "intent", "created_at"),
    "backoff_filter": lambda t: C.claimable(C.change_rows(_changes(t)).withColumn("backoff_until", F.when(F.col("product_id") % 2 == 0, F.lit("2024-02-01").cast("timestamp"))), EVENTS_AS_OF).groupBy("product_id").agg(F.count(F.lit(1)).alias("n")),
    "claim_state": lambda t: C.claim_state(C.change_rows(_changes(t)), _changes(t).where("product_id < 60").select("record_id", (F.col("product_id") % 3 > 0).alias("ok"), F.lit("timeout").alias("error")), EVENTS_AS_OF).groupBy("status", "attempts", "last_error").agg(F.count(F.lit(1)).alias("n")),
    "reset_stale": lambda t: C.reset_stale(C.change_rows(_changes(t)).withColumn("status", F.lit("processing")), "2024-01-15 00:00:00").groupBy("status").agg(F.count(F.lit(1)).alias("n")),
    "unindexed_products_anti": lambda t: C.backfill(t.products(), C.change_rows(_changes(t)).withColumn("status", F.when(F.col("product_id") % 2 == 0, "processed").otherwise(F.col("status"))), EVENTS_AS_OF).select("product_id", "intent", "status"),
    "embedded_changes": lambda t: S.embedded_changes(_changes(t), t.products())[0].select("product_id", "text"),
    "removed_products": lambda t: S.embedded_changes(_changes(t), t.products())[1],
    "changed_products": lambda t: S.changed_products(t.prices()),
    "stream_dedup": lambda t: S.stream_dedup(t.prices().select("product_id", "store_id", F.round(F.col("price_kes") / 10000).alias("price_kes"), "source", "verified_at")).select("product_id", "store_id", "price_kes", "source"),
    "completed_sessions": lambda t: t.raw("orders").where(F.col("o_orderstatus").isin("F", "P")).select(F.col("o_orderkey").alias("session_id")),
    "available_requests": lambda t: t.traffic().where((F.col("text") == "view") & (F.col("ts") >= F.lit("2024-01-20"))).select("event_id"),
}

ORACLES = {
    "extract_links": "with l as (select page_id, regexp_extract_all(html, 'href=\"([^\"#]+)\"', 1) as a from pages), u as (select page_id, unnest(a) as link, generate_subscripts(a, 1) as i from l), d as (select page_id, link, min(i) as i from u group by all) select page_id, link, row_number() over (partition by page_id order by i) - 1 as place from d",
    "extract_jsonld_items": "select page_id, 'P' || page_id || ' & co' as name, cast(page_id * 10 as varchar) as price, 'KES' as currency from pages",
    "detect_promo": with_tables("select batch_id, line_no, product_id, store_id, is_promotional and price_kes > 0 as promo from prices", "prices"),
    "item_defaults": with_tables(f"select product_id, case when size > 25 then 'Shop' else 'Online Store' end as store_branch, 'Naivas' as store_chain, timestamp '{EVENTS_AS_OF}' as verified_at, false as is_promotional from products", "products"),
    "scan_table": "select l_orderkey, l_linenumber, l_extendedprice from lineitem where l_shipdate >= timestamp '2001-01-01' and l_discount >= 0.09",
    "scan_vectors": "select vec_id, label from embeddings",
    "sink_vector_upsert": with_tables("select product_id, case when product_id % 5 = 0 then upper(name) else name end as name, case when product_id % 5 = 0 then 1 else 0 end as seq from products", "products"),
    "sink_delete_keys": with_tables("select product_id, label from vectors where product_id not in (select product_id from products where product_id % 4 = 0)", "vectors", "products"),
    "category_suggestions": with_tables(f"with {_GENERAL} select product_id, suggested_category, category_status from r", "products"),
    "category_status_counts": with_tables(f"with {_GENERAL} select category_status, count(*) as n from r group by 1", "products"),
    "confirm_category": with_tables("select product_id, case when product_id % 6 = 0 then 'decided' when product_id % 3 = 0 then 'general' else category end as category from products", "products"),
    "conditional_sort": with_tables(f"with {_GENERAL} select product_id, category_status, case when category_status = 'suggested' then suggested_category else brand end as sort_key, name from r", "products"),
    "category_review_filter": with_tables(f"with {_GENERAL} select product_id, brand as sort_key from r where category_status = 'unmatched'", "products"),
    "add_to_set": with_tables("select product_id, len(list_distinct([size, 10, 20])) as n from products", "products"),
    "alias_union": with_tables("select product_id, array_to_string(list_sort(list_distinct(list_concat(string_split(name, ' '), [lower(brand), 'red']))), ',') as aliases from products", "products"),
    "change_row": with_tables(f"select {_INTENT} as intent, 'pending' as status, count(*) as n, cast(0 as bigint) as attempts from traffic group by all", "traffic"),
    "latest_intents": with_tables(f"select product_id, {_INTENT} as intent, ts as created_at from traffic qualify row_number() over (partition by product_id order by ts desc, {_INTENT} desc) = 1", "traffic"),
    "fifo_batch": with_tables(f"select product_id, {_INTENT} as intent, ts as created_at from traffic order by ts, product_id, 2 limit 10", "traffic"),
    "backoff_filter": with_tables("select product_id, count(*) as n from traffic where product_id % 2 <> 0 group by product_id", "traffic"),
    "claim_state": with_tables("select case when product_id < 60 and product_id % 3 > 0 then 'processed' else 'pending' end as status, case when product_id < 60 then 1 else 0 end as attempts, case when product_id < 60 and product_id % 3 = 0 then 'timeout' end as last_error, count(*) as n from traffic group by all", "traffic"),
    "reset_stale": with_tables("select case when ts < timestamp '2024-01-14 23:55:00' then 'pending' else 'processing' end as status, count(*) as n from traffic group by 1", "traffic"),
    "unindexed_products_anti": with_tables("select product_id, 'backfill' as intent, 'pending' as status from products where product_id not in (select product_id from traffic where product_id % 2 = 0)", "products", "traffic"),
    "embedded_changes": with_tables(f"with l as (select product_id, {_INTENT} as intent from traffic qualify row_number() over (partition by product_id order by ts desc, {_INTENT} desc) = 1), k as (select product_id, name, brand from l join products using (product_id) where intent <> 'delete') select product_id, name as text from k union select product_id, brand from k", "traffic", "products"),
    "removed_products": with_tables(f"with l as (select product_id, {_INTENT} as intent from traffic qualify row_number() over (partition by product_id order by ts desc, {_INTENT} desc) = 1) select product_id from l left join products using (product_id) where intent = 'delete' or name is null", "traffic", "products"),
    "changed_products": with_tables("select distinct product_id from prices", "prices"),
    "stream_dedup": with_tables("select distinct product_id, store_id, round(price_kes / 10000) as price_kes, source from prices", "prices"),
    "completed_sessions": "select o_orderkey as session_id from orders where o_orderstatus in ('F', 'P')",
    "available_requests": with_tables("select event_id from traffic where text = 'view' and ts >= timestamp '2024-01-20'", "traffic"),
}
