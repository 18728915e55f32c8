"""Registered queries of streams, jobs, sinks and file scans. Each writes its source from the given tables into a scratch folder that all
executors share, and runs the operator on that."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.operators import anomaly as A
from trolley.operators import curation as C
from trolley.operators import trends as R
from trolley.plans import ingest_queries as I
from trolley.plans import jobs
from trolley.plans import model_queries as MQ
from trolley.plans.bindings import AS_OF, EVENTS_AS_OF, Tables, with_tables
from trolley.sources import tables as B
from trolley.streaming import claims as K
from trolley.streaming import streams as S


#: Rows of a compressed JSON file at most.
FILE_ROWS = 500_000


def _ingested(t: Tables) -> DataFrame:
    out = B.scratch(t.spark, "ingest")
    raw = t.prices().select(
        "product_id", F.col("store_id").cast("string").alias("store_id"), F.col("price_kes").cast("decimal(18,2)").cast("string").alias("price_kes"), "source",
        F.date_format("verified_at", "yyyy-MM-dd HH:mm:ss").alias("verified_at"), F.col("is_promotional").cast("string").alias("is_promotional"),
        F.lit(None).cast("string").alias("promotion_details"), "batch_id", F.col("line_no").cast("int").alias("line_no"))
    raw.write.option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS).json(f"{out}/in")  # such a file is read by one task
    S.stream_ingest_prices(t.spark, f"{out}/in", f"{out}/out", f"{out}/state", AS_OF).awaitTermination()
    return S.read_ingested(t.spark, f"{out}/out").select("product_id", "store_id", "source", F.col("day").cast("string").alias("day"), "price_kes", "is_promotional")


def _outbox(t: Tables) -> str:
    out = B.scratch(t.spark, "outbox")
    C.change_rows(I._changes(t)).write.parquet(f"{out}/in")
    return out


def _embedded(t: Tables) -> DataFrame:
    out = _outbox(t)
    S.stream_embed_upsert(S.stream_outbox(t.spark, f"{out}/in"), t.products(), out, f"{out}/state").awaitTermination()
    return S.read_vectors(t.spark, out).select("product_id", "text")


def _collected(df: DataFrame, out: str, mode: str) -> DataFrame:
    """What a stream gives until its source is used up."""
    def write(batch: DataFrame, batch_no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/out/batch_no={batch_no}")

    df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{out}/out")


def _pending(t: Tables) -> DataFrame:
    out = _outbox(t)
    return _collected(S.stream_outbox(t.spark, f"{out}/in"), out, "append")


#: What is told of a record after its change, by its number modulo 6: kind and seconds after the change.
TOLD = {1: (("claim", 60), ("ok", 120)), 2: (("claim", 60), ("failed", 120)), 3: (("claim", 60),), 4: (("claim", 60), ("failed", 120), ("claim", 150), ("claim", 240), ("ok", 300)), 5: (("claim", 60), ("claim", 400), ("failed", 420))}


def _claims(t: Tables) -> DataFrame:
    """Every event is a record; a last message long after the others makes all timers run out."""
    out = B.scratch(t.spark, "claims")
    changes = t.traffic().select(F.col("event_id").alias("record_id"), "product_id", "ts")
    messages = changes.select("record_id", "product_id", F.lit("change").alias("kind"), F.col("ts").cast("timestamp").alias("at"), F.lit(None).cast("string").alias("error"))
    for k, told in TOLD.items():
        for kind, seconds in told:
            some = changes.where(F.pmod("record_id", F.lit(6)) == k)
            messages = messages.unionByName(some.select("record_id", "product_id", F.lit(kind).alias("kind"), (F.col("ts").cast("timestamp") + F.make_dt_interval(secs=F.lit(seconds))).alias("at"), F.lit("timeout").alias("error")))
    end = t.spark.range(1).select(F.lit(-1).cast("long").alias("record_id"), F.lit(-1).cast("long").alias("product_id"), F.lit("end").alias("kind"), (F.lit(EVENTS_AS_OF).cast("timestamp") + F.make_dt_interval(days=F.lit(30))).alias("at"), F.lit(None).cast("string").alias("error"))
    kept = t.spark.conf.get(K.STATE_STORE[0], None)
    t.spark.conf.set(*K.STATE_STORE)
    try:
        for batch in (messages, end):  # a run of the stream for each
            batch.write.mode("append").parquet(f"{out}/live")
            rows = _collected(K.stream_claims(t.spark.readStream.schema(K.MESSAGES).parquet(f"{out}/live")), out, "append")
    finally:
        t.spark.conf.set(K.STATE_STORE[0], kept) if kept else t.spark.conf.unset(K.STATE_STORE[0])
    return rows


def _deduplicated(t: Tables) -> DataFrame:
    out = B.scratch(t.spark, "dedup")
    keys = t.prices().select("product_id", "store_id", F.round(F.col("price_kes") / 10000).alias("price_kes"), "source", F.col("verified_at").cast("timestamp").alias("verified_at"))
    keys.write.parquet(f"{out}/in")
    live = S.stream_dedup(t.spark.readStream.schema(keys.schema).parquet(f"{out}/in"))
    return _collected(live, out, "append").select("product_id", "store_id", "price_kes", "source")


def _volume(t: Tables) -> DataFrame:
    out = B.scratch(t.spark, "volume")
    t.traffic().select("ts", "event_id").write.parquet(f"{out}/in")
    live = R.stream_query_volume(t.spark.readStream.schema("ts timestamp, event_id long").parquet(f"{out}/in"))
    return _collected(live, out, "update").groupBy("hour_start").agg(F.max("n").alias("n"))


def _scored(t: Tables) -> DataFrame:
    """Fit, save, load and score."""
    root = B.scratch(t.spark, "forest")
    B.save_version(A.iforest_fit(t.prices(), AS_OF, 400), root, 1)
    return A.iforest_score(t.prices(), B.load_version(t.spark, root, 1)).select("product_id", "store_id", "batch_id", "line_no", "anomaly_score", "is_anomaly")


def _maintained(t: Tables) -> DataFrame:
    root = B.scratch(t.spark, "maintenance")
    return jobs.maintenance_job(t.spark, t.prices(), t.log_items(), MQ._series(t), MQ._sellers(t), t.reviews(), AS_OF, root, 1)


def _seeded(t: Tables) -> DataFrame:
    counts = B.seed_job(t.spark, t.products(), t.stores(), t.prices(), B.scratch(t.spark, "seed"))
    return t.spark.createDataFrame(sorted(counts.items()), "part string, n long")


def _arrays(df: DataFrame, out: str, rows: int = 500) -> str:
    """df as files that each hold one JSON array, of `rows` rows at most."""
    numbered = df.select(F.floor(F.monotonically_increasing_id() / rows).alias("k"), F.to_json(F.struct(*df.columns)).alias("j"))
    numbered.groupBy("k").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(out)
    return out


def _scanned_products(t: Tables) -> DataFrame:
    rows = t.products().select("name", F.when(F.col("product_id") % 10 > 0, F.col("category")).otherwise(" ").alias("category"), "brand", F.array(F.col("size").cast("string")).alias("sizes_variants"))
    good, bad = B.scan_products_json(t.spark, _arrays(rows, B.scratch(t.spark, "products")))
    return good.select("name", "category", "brand", F.lit("").alias("reject_reason")).unionByName(bad.select("name", "category", "brand", "reject_reason"))


def _scanned_stores(t: Tables) -> DataFrame:
    old, new = t.stores().where("store_id % 2 = 0"), t.stores().where("store_id % 2 = 1")
    out = B.scratch(t.spark, "stores")
    _arrays(old.select("chain", F.col("town").alias("branch"), "county"), f"{out}/form=1")
    _arrays(new.select(F.col("chain").alias("chain_name"), F.when(F.col("store_id") % 5 > 0, F.col("town")).alias("branch_name"), "county"), f"{out}/form=2")
    return B.scan_stores_json(t.spark, out).select("chain", "branch", "county")


def _scanned_synonyms(t: Tables) -> DataFrame:
    out = B.scratch(t.spark, "synonyms")
    t.products().select(F.concat(F.lit(" "), F.upper("name"), F.col("product_id").cast("string"), F.when(F.col("product_id") % 2 == 0, "\t").otherwise(" , "), F.col("brand"))).write.text(out)
    return B.scan_synonyms(t.spark, out)


def _targets(t: Tables) -> DataFrame:
    return B.active_targets(t.stores().select(
        F.col("store_id"), (F.col("store_id") % 4 > 0).alias("is_active"), F.concat(F.lit("Chain "), (F.col("store_id") % 3).cast("string")).alias("store_chain"),
        F.when(F.col("store_id") % 5 > 0, "https://shop.example/").alias("target_url"), F.when(F.col("store_id") % 2 == 0, "dairy").alias("category"),
        F.lit(None).cast("boolean").alias("use_stealth"), F.lit(None).cast("string").alias("store_branch")), "chain 1")


def _overwritten(t: Tables) -> DataFrame:
    out = B.scratch(t.spark, "overwrite")
    B.sink_overwrite(t.products().select("product_id", "name"), out)
    B.sink_overwrite(t.products().where("product_id % 2 = 0").select("product_id", F.upper("name").alias("name")), out)
    return B.read_table(t.spark, out)


def _appended(t: Tables) -> DataFrame:
    out = B.scratch(t.spark, "append")
    for k in range(2):
        B.sink_append(t.logs().where(f"log_id % 2 = {k}").select("log_id", "user_id", "text"), out)
    return t.spark.read.parquet(out)


def _product_changes(t: Tables) -> DataFrame:
    root = B.scratch(t.spark, "product-changes")
    C.product_with_change_record(t.products().where("product_id % 2 = 0").select("product_id", F.upper("name").alias("name"), "brand"), t.products().where("product_id % 3 = 0").select("product_id", "name", "brand"), EVENTS_AS_OF, root, 1)
    products, changes = C.read_product_changes(t.spark, root)
    return products.join(changes.select("product_id", "intent", "status"), "product_id", "left")


QUERIES = {
    "stream_ingest_prices": _ingested,
    "stream_outbox": lambda t: _pending(t).groupBy("product_id", "intent").agg(F.count(F.lit(1)).alias("n")),
    "stream_embed_upsert": _embedded,
    "stream_dedup_live": _deduplicated,
    "stream_claims": lambda t: K.current_records(_claims(t)).select("record_id", "product_id", "reason", "status", "attempts", "at", "last_error"),
    "stream_claims_log": lambda t: _claims(t).groupBy("reason", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("attempts").cast("long").alias("attempts")),
    "stream_query_volume_live": _volume,
    "model_io": _scored,
    "maintenance_job": _maintained,
    "seed_job": _seeded,
    "scan_products_json": _scanned_products,
    "scan_stores_json": _scanned_stores,
    "scan_synonyms": _scanned_synonyms,
    "active_targets": lambda t: _targets(t).select("store_id", "category", "use_stealth", "store_branch"),
    "sink_overwrite": _overwritten,
    "sink_append_log": _appended,
    "product_with_change_record": _product_changes,
}

ORACLES = {
    "stream_ingest_prices": with_tables("select product_id, cast(store_id as varchar) as store_id, source, strftime(verified_at, '%Y-%m-%d') as day, price_kes, is_promotional from prices where price_kes > 0 qualify row_number() over (partition by product_id, store_id, source, cast(verified_at as date) order by verified_at desc, batch_id desc, line_no desc, price_kes desc, is_promotional desc) = 1", "prices"),
    "stream_outbox": with_tables(f"select product_id, {I._INTENT} as intent, count(*) as n from traffic group by all", "traffic"),
    "stream_embed_upsert": I.ORACLES["embedded_changes"],
    "stream_dedup_live": I.ORACLES["stream_dedup"],
    "stream_claims": with_tables("""with m as (select event_id as record_id, product_id, event_id % 6 as m, ts from traffic)
select record_id, product_id, (['created', 'processed', 'ready', 'reset', 'processed', 'ready'])[m + 1] as reason, (['pending', 'processed', 'pending', 'pending', 'processed', 'pending'])[m + 1] as status, cast(([0, 1, 1, 1, 2, 2])[m + 1] as int) as attempts,
  ts + to_seconds(([0, 120, 180, 360, 300, 480])[m + 1]) as at, case when m in (2, 5) then 'timeout' end as last_error from m""", "traffic"),
    "stream_claims_log": with_tables("""with m as (select event_id % 6 as m from traffic),
r as (select m, unnest(case m when 0 then [['created', 'pending', '0']] when 1 then [['created', 'pending', '0'], ['claimed', 'processing', '1'], ['processed', 'processed', '1']]
  when 2 then [['created', 'pending', '0'], ['claimed', 'processing', '1'], ['failed', 'pending', '1'], ['ready', 'pending', '1']] when 3 then [['created', 'pending', '0'], ['claimed', 'processing', '1'], ['reset', 'pending', '1']]
  when 4 then [['created', 'pending', '0'], ['claimed', 'processing', '1'], ['failed', 'pending', '1'], ['ready', 'pending', '1'], ['claimed', 'processing', '2'], ['processed', 'processed', '2']]
  else [['created', 'pending', '0'], ['claimed', 'processing', '1'], ['reset', 'pending', '1'], ['claimed', 'processing', '2'], ['failed', 'pending', '2'], ['ready', 'pending', '2']] end) as x from m)
select x[1] as reason, x[2] as status, count(*) as n, cast(sum(cast(x[3] as int)) as bigint) as attempts from r group by all""", "traffic"),
    "stream_query_volume_live": with_tables("select date_trunc('hour', ts) as hour_start, count(*) as n from traffic group by all", "traffic"),
    "seed_job": with_tables("select 'prices' as part, count(*) as n from prices union all select 'products', count(*) from products union all select 'stores', count(*) from stores", "prices", "products", "stores"),
    "scan_products_json": with_tables("select name, case when product_id % 10 > 0 then category else ' ' end as category, brand, case when product_id % 10 > 0 then '' else 'category' end as reject_reason from products", "products"),
    "scan_stores_json": with_tables("select chain, town as branch, county from stores where store_id % 2 = 0 or store_id % 5 > 0", "stores"),
    "scan_synonyms": with_tables("select lower(name || product_id) as word, lower(brand) as synonym from products", "products"),
    "active_targets": with_tables("select store_id, case when store_id % 2 = 0 then 'dairy' else 'general' end as category, false as use_stealth, 'Online Store' as store_branch from stores where store_id % 4 > 0 and store_id % 3 = 1 and store_id % 5 > 0", "stores"),
    "sink_overwrite": with_tables("select product_id, upper(name) as name from products where product_id % 2 = 0", "products"),
    "sink_append_log": with_tables("select log_id, user_id, text from logs", "logs"),
    "product_with_change_record": with_tables("select product_id, case when product_id % 2 = 0 then upper(name) else name end as name, brand, case when product_id % 6 = 0 then 'update' when product_id % 2 = 0 then 'create' end as intent, case when product_id % 2 = 0 then 'pending' end as status from products where product_id % 2 = 0 or product_id % 3 = 0", "products"),
}
