"""Catalogue upkeep: category suggestions and decisions, review lists, sizes; and the outbox of product changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.operators.windows import best_per_key


def category_suggestions(products: DataFrame, dictionary: DataFrame) -> DataFrame:
    """For products of category "general": the category of the longest dictionary word in the name.

    dictionary: word, suggested. Words are looked up by the name's tokens, in a join that Spark chooses by their sizes.
    """
    tokens = products.where(F.lower("category") == "general").select("product_id", F.explode(F.split(F.lower("name"), r"\s+")).alias("word"))
    hit = best_per_key(tokens.join(dictionary, "word"), ["product_id"], [F.length("word").desc(), "word"]).select("product_id", F.col("suggested").alias("suggested_category"))
    general = products.where(F.lower("category") == "general").join(hit, "product_id", "left")
    return general.withColumn("category_status", F.when(F.col("suggested_category").isNull(), "unmatched").otherwise("suggested"))


def confirm_category(products: DataFrame, decisions: DataFrame) -> DataFrame:
    """products with the categories decided on (product_id, decided)."""
    joined = products.join(decisions, "product_id", "left")
    return joined.withColumn("category", F.coalesce("decided", "category")).drop("decided")


def category_review(products: DataFrame, status: str = "both") -> DataFrame:
    """The list to review: status, then suggested category (or brand), then name."""
    wanted = ("suggested", "unmatched") if status == "both" else (status,)
    key = F.when(F.col("category_status") == "suggested", F.col("suggested_category")).otherwise(F.col("brand"))
    return products.where(F.col("category_status").isin(*wanted)).withColumn("sort_key", key).orderBy("category_status", "sort_key", "name", "product_id")


def add_to_set(items: Column, more: Column) -> Column:
    none = F.array().cast("array<int>")
    return F.array_union(F.coalesce(items, none), F.coalesce(more, none))


def resolve_or_create_product(items: DataFrame, known: DataFrame) -> DataFrame:
    """The catalogue (product_id, name, brand, sizes) after items (name, brand, size): known ones gain sizes, others are new."""
    key = F.md5(F.concat_ws("\x1f", F.lower("name"), F.lower(F.coalesce("brand", F.lit("")))))
    seen = items.withColumn("_key", key).groupBy("_key").agg(F.min("name").alias("new_name"), F.min("brand").alias("new_brand"), F.array_sort(F.collect_set("size")).alias("more"))
    both = known.withColumn("_key", key).join(seen, "_key", "full_outer")
    return both.select(
        F.coalesce(F.col("product_id").cast("string"), F.concat(F.lit("new-"), F.substring("_key", 1, 16))).alias("product_id"), F.coalesce("name", "new_name").alias("name"),
        F.coalesce("brand", "new_brand").alias("brand"), F.array_sort(add_to_set(F.col("sizes"), F.col("more"))).alias("sizes"))


# --- outbox -------------------------------------------------------------------------------------------------------


def change_rows(changes: DataFrame) -> DataFrame:
    """New change records of (product_id, intent, created_at): pending, no attempts. record_id is taken over, or made of the three."""
    none = F.lit(None)
    record = F.col("record_id") if "record_id" in changes.columns else F.xxhash64("product_id", "intent", "created_at")
    return changes.select(
        record.alias("record_id"), "product_id", "intent", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), "created_at", F.col("created_at").alias("updated_at"),
        none.cast("timestamp").alias("processed_at"), none.cast("timestamp").alias("backoff_until"), none.cast("string").alias("last_error"))


def claimable(outbox: DataFrame, as_of: str) -> DataFrame:
    now = F.lit(as_of).cast("timestamp")
    return outbox.where((F.col("status") == "pending") & (F.col("backoff_until").isNull() | (F.col("backoff_until") <= now)))


def fifo_batch(outbox: DataFrame, as_of: str, n: int = 10) -> DataFrame:
    return claimable(outbox, as_of).orderBy("created_at", "product_id", "intent").limit(n)


def product_with_change_record(incoming: DataFrame, existing: DataFrame, as_of: str, root: str, version: int) -> None:
    """Writes products and their change records together, as one version.

    incoming's products (product_id, ...) are put over existing ones of the same id; each has one record: update where the product was
    there, else create. A version counts once its row in `complete` is written, which comes last, so readers see both tables or neither; a rerun
    replaces its own version only.
    """
    once = incoming.dropDuplicates(["product_id"])
    was = existing.select("product_id", F.lit(True).alias("_was"))
    changes = change_rows(once.select("product_id").join(was, "product_id", "left").select(
        "product_id", F.when(F.col("_was"), "update").otherwise("create").alias("intent"), F.lit(as_of).cast("timestamp").alias("created_at")))
    merged = existing.join(once.select("product_id"), "product_id", "left_anti").unionByName(once)
    merged.write.mode("overwrite").parquet(f"{root}/products/version={version}")
    changes.write.mode("overwrite").parquet(f"{root}/changes/version={version}")
    incoming.sparkSession.range(1).select(F.lit(version).alias("done")).write.mode("overwrite").parquet(f"{root}/complete/version={version}")


def read_product_changes(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(products of the newest complete version, change records of all complete versions)."""
    done = spark.read.parquet(f"{root}/complete").select("version")
    newest = done.agg(F.max("version")).first()[0]
    changes = spark.read.parquet(f"{root}/changes").join(F.broadcast(done), "version", "left_semi")  # a row a version
    return spark.read.parquet(f"{root}/products/version={newest}"), changes.drop("version")


def claim_state(outbox: DataFrame, results: DataFrame, as_of: str, backoff_seconds: int = 60, key: str = "record_id") -> DataFrame:
    """outbox after a batch: results (key, ok, error) end their records as processed or send them back with a pause.

    One result touches one record, whatever other records its product has. Of several results for a record a success counts, else the least error.
    """
    now = F.lit(as_of).cast("timestamp")
    once = results.groupBy(key).agg(F.max("ok").alias("ok"), F.min("error").alias("error"))
    df = outbox.join(once, key, "left")
    touched = F.col("ok").isNotNull() & F.col("status").isin("pending", "processing")
    done, failed = touched & F.col("ok"), touched & ~F.col("ok")
    return df.withColumns({
        "status": F.when(done, "processed").when(failed, "pending").otherwise(F.col("status")), "attempts": F.col("attempts") + touched.cast("int"),
        "processed_at": F.when(done, now).otherwise(F.col("processed_at")), "last_error": F.when(failed, F.col("error")).otherwise(F.col("last_error")),
        "backoff_until": F.when(failed, now + F.make_dt_interval(secs=F.lit(backoff_seconds))).otherwise(F.col("backoff_until")),
        "updated_at": F.when(touched, now).otherwise(F.col("updated_at"))}).drop("ok", "error")


def reset_stale(outbox: DataFrame, as_of: str, minutes: int = 5) -> DataFrame:
    stale = (F.col("status") == "processing") & (F.col("updated_at") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes)))
    return outbox.withColumn("status", F.when(stale, "pending").otherwise(F.col("status")))


def backfill(products: DataFrame, outbox: DataFrame, as_of: str, force: bool = False) -> DataFrame:
    """Change records for products without a processed one (all with force)."""
    left = products if force else products.join(outbox.where(F.col("status") == "processed").select("product_id"), "product_id", "left_anti")
    return change_rows(left.select("product_id", F.lit("backfill").alias("intent"), F.lit(as_of).cast("timestamp").alias("created_at")))


def latest_intents(changes: DataFrame) -> DataFrame:
    """The newest intent of each product."""
    return changes.groupBy("product_id").agg(F.max(F.struct("created_at", "intent")).alias("c")).select("product_id", "c.intent", "c.created_at")
