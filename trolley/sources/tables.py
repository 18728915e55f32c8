"""Scans and sinks. Sinks that replace rows write a new version beside the old one: a table is never overwritten while it is read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trolley.operators.validate import first_reason

_STRINGS = T.ArrayType(T.StringType())
PRODUCTS = T.StructType([T.StructField(n, t) for n, t in (("name", T.StringType()), ("category", T.StringType()), ("brand", T.StringType()), ("sizes_variants", _STRINGS), ("swahili_aliases", _STRINGS), ("sheng_aliases", _STRINGS))])
STORES = T.StructType([T.StructField(n, t) for n, t in (
    ("chain", T.StringType()), ("branch", T.StringType()), ("chain_name", T.StringType()), ("branch_name", T.StringType()), ("town", T.StringType()), ("county", T.StringType()),
    ("gps_latitude", T.DoubleType()), ("gps_longitude", T.DoubleType()), ("address", T.StringType()), ("phone_number", T.StringType()))])


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); only a local session may do without one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="trolley-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/trolley/{name}-{uuid.uuid4().hex}"


#: Rows up to which a table of unknown origin goes to all tasks.
SMALL_ROWS = 10_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written in the shared folder and read again: cuts lineage, survives lost executors."""
    path = f"{scratch(df.sparkSession, name)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df, marked for broadcast if it is counted to have no more than so many rows. Give a stored table, as it is read twice."""
    return F.broadcast(df) if df.count() <= rows else df


def scan_products_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) products of a JSON array or object."""
    rows = spark.read.schema(PRODUCTS).json(path, multiLine=True)
    reason = first_reason([("name", F.length(F.trim(F.coalesce("name", F.lit("")))) == 0), ("category", F.length(F.trim(F.coalesce("category", F.lit("")))) == 0)])
    checked = rows.withColumn("reject_reason", reason)
    return checked.where("reject_reason is null").drop("reject_reason"), checked.where("reject_reason is not null")


def scan_stores_json(spark: SparkSession, path: str) -> DataFrame:
    """Stores of a JSON array; chain_name and branch_name are other names of chain and branch."""
    rows = spark.read.schema(STORES).json(path, multiLine=True)
    return rows.withColumns({"chain": F.coalesce("chain", "chain_name"), "branch": F.coalesce("branch", "branch_name")}).drop("chain_name", "branch_name").where("chain is not null and branch is not null")


def scan_table(spark: SparkSession, path: str, condition: Column | None = None, columns: Sequence[str] = ("*",)) -> DataFrame:
    """A Parquet table with filter and projection, both of which reach the scan."""
    df = spark.read.parquet(path)
    return (df if condition is None else df.where(condition)).select(*columns)


def scan_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """word, synonym of lines "word<tab or comma>synonym"; # starts a comment, the last line for a word wins."""
    # a line's place: its file, the block of the file that a task reads, and its order within the task
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("no"))
    lines = spark.read.text(path).select(F.trim("value").alias("line"), at.alias("at"))
    parts = lines.where(~F.col("line").startswith("#")).select("at", F.split(F.lower("line"), r"\s*[\t,]\s*", 2).alias("p")).where(F.size("p") == 2)
    return parts.groupBy(F.col("p")[0].alias("word")).agg(F.max_by(F.col("p")[1], "at").alias("synonym"))


def active_targets(targets: DataFrame, chain: str) -> DataFrame:
    """A chain's active targets (case aside) with defaults; targets without URL drop out."""
    mine = targets.where(F.col("is_active") & (F.lower("store_chain") == chain.lower()) & (F.length(F.trim(F.coalesce("target_url", F.lit("")))) > 0))
    return mine.withColumns({"category": F.coalesce("category", F.lit("general")), "use_stealth": F.coalesce("use_stealth", F.lit(False)), "store_branch": F.coalesce("store_branch", F.lit("Online Store"))})


def sink_overwrite(df: DataFrame, path: str) -> None:
    """Puts df in place of the table: written as a version beside the old ones, which counts once its row in `complete` is there.

    A failure midway leaves the old table for readers (read_table).
    """
    version = 1 + (_newest(df.sparkSession, path) or 0)
    df.write.mode("overwrite").parquet(f"{path}/version={version}")
    df.sparkSession.range(1).select(F.lit(version).alias("done")).write.mode("overwrite").parquet(f"{path}/complete/version={version}")


def _newest(spark: SparkSession, path: str) -> int | None:
    """The newest complete version of a table, None if there is none yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/complete")
    if not hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop):
        return None
    return spark.read.parquet(f"{path}/complete").agg(F.max("done")).first()[0]


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of a table that sink_overwrite writes."""
    return spark.read.parquet(f"{path}/version={_newest(spark, path)}")


def sink_append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def merge_last_wins(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """existing with incoming's rows put over those of the same key; of several the largest sequence stays.

    Both sides carry the columns of incoming.
    """
    newest = incoming.groupBy(*keys).agg(F.max(F.struct(sequence, *[c for c in incoming.columns if c not in (*keys, sequence)])).alias("_r")).select(*keys, "_r.*")
    return existing.join(newest.select(*keys), list(keys), "left_anti").unionByName(newest.select(*existing.columns))


def delete_keys(existing: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return existing.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def save_version(df: DataFrame, root: str, version: int, options: Mapping[str, str] | None = None) -> str:
    """Writes a numbered version of a table and returns its path; a rerun of a version replaces only itself. options are those of Parquet."""
    path = f"{root}/version={version}"
    df.write.mode("overwrite").options(**(options or {})).parquet(path)
    return path


def load_version(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root}/version={version}")


def seed_job(spark: SparkSession, products: DataFrame, stores: DataFrame, prices: DataFrame, root: str) -> Mapping[str, int]:
    """Writes the three tables and returns their row counts."""
    for name, df in (("products", products), ("stores", stores), ("prices", prices)):
        sink_overwrite(df, f"{root}/{name}")
    return {name: read_table(spark, f"{root}/{name}").count() for name in ("products", "stores", "prices")}
