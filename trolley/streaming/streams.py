"""Structured Streaming: price ingest, deduplication, and vectors kept up to date from a log of changes.

Sinks are idempotent: each micro-batch writes under its batch id, so a replay after a failure replaces its own
files, and readers merge the batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trolley.functions.text import text_variants
from trolley.operators import curation, validate
from trolley.operators.anomaly import embed_text

RAW_ITEMS = "product_id long, store_id string, price_kes string, source string, verified_at string, is_promotional string, promotion_details string, batch_id long, line_no int"
CHANGES = "product_id long, intent string, status string, created_at timestamp"


def stream_ingest_prices(spark: SparkSession, source: str, out: str, checkpoint: str, as_of: str) -> StreamingQuery:
    """JSON items to typed prices: valid rows and rejects of each batch, last row of a (product, store, source, day) wins within it."""
    items = spark.readStream.schema(RAW_ITEMS).json(source)

    def write(batch: DataFrame, batch_no: int) -> None:
        valid, rejected = validate.split_valid(validate.validate_items(batch, as_of))
        newest = F.max(F.struct("verified_at", "batch_id", "line_no", "price_kes", "is_promotional")).alias("p")
        keyed = valid.groupBy("product_id", "store_id", "source", F.to_date("verified_at").alias("day")).agg(newest).select("product_id", "store_id", "source", "day", "p.*")
        keyed.write.mode("overwrite").parquet(f"{out}/prices/batch_no={batch_no}")
        rejected.write.mode("overwrite").parquet(f"{out}/rejects/batch_no={batch_no}")

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_ingested(spark: SparkSession, out: str) -> DataFrame:
    """One price for each (product, store, source, day) over all batches."""
    rows = spark.read.parquet(f"{out}/prices")
    newest = F.max(F.struct("verified_at", "batch_no", "batch_id", "line_no", "price_kes", "is_promotional")).alias("p")
    return rows.groupBy("product_id", "store_id", "source", "day").agg(newest).select("product_id", "store_id", "source", "day", "p.verified_at", "p.batch_id", "p.line_no", "p.price_kes", "p.is_promotional")


def changed_products(batch: DataFrame) -> DataFrame:
    return batch.select("product_id").distinct()


def stream_dedup(items: DataFrame, time: str = "verified_at", late: str = "1 day", keys: tuple[str, ...] = ("product_id", "store_id", "price_kes", "source")) -> DataFrame:
    """Items without repeats; on a stream, without those that come within the watermark."""
    if not items.isStreaming:
        return items.dropDuplicates(list(keys))
    return items.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def stream_outbox(spark: SparkSession, path: str) -> DataFrame:
    """The pending records of a folder of change records."""
    return spark.readStream.schema(CHANGES).parquet(path).where(F.coalesce("status", F.lit("pending")) == "pending").drop("status")


def embedded_changes(changes: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vectors of changed products, products to remove): by the newest intent; a missing product is removed."""
    newest = curation.latest_intents(changes)
    joined = newest.join(products.select("product_id", "name", "brand"), "product_id", "left")
    gone = joined.where((F.col("intent") == "delete") | F.col("name").isNull()).select("product_id")
    kept = joined.where((F.col("intent") != "delete") & F.col("name").isNotNull())
    texts = kept.select("product_id", F.explode(text_variants(F.col("name"), F.array("brand"))).alias("text"))
    return embed_text(texts, "text", 64), gone


def stream_embed_upsert(changes: DataFrame, products: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Each batch leaves its vectors and its removed products under its number."""
    def write(batch: DataFrame, batch_no: int) -> None:
        vectors, gone = embedded_changes(batch, products)
        vectors.write.mode("overwrite").parquet(f"{out}/vectors/batch_no={batch_no}")
        gone.write.mode("overwrite").parquet(f"{out}/removed/batch_no={batch_no}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_vectors(spark: SparkSession, out: str) -> DataFrame:
    """The vectors in force: of each product's newest batch, unless that removed it."""
    vectors, gone = spark.read.parquet(f"{out}/vectors"), spark.read.parquet(f"{out}/removed")
    last = vectors.select("product_id", "batch_no", F.lit(0).alias("gone")).unionByName(gone.select("product_id", "batch_no", F.lit(1).alias("gone"))).groupBy("product_id").agg(
        F.max(F.struct("batch_no", "gone")).alias("l")).where("l.gone = 0").select("product_id", F.col("l.batch_no").alias("batch_no"))
    return vectors.join(last, ["product_id", "batch_no"]).drop("batch_no")
