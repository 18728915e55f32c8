"""The star-schema tables seen as a price-intelligence data model, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Reference time of the historical tables; the events end a little before EVENTS_AS_OF.
AS_OF = "2001-11-05 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"

_SQL = {
    "products": "select p_partkey as product_id, p_name as name, p_brand as brand, p_type as category, p_size as size, p_retailprice as base_price from part",
    "stores": "select s_suppkey as store_id, s_name as chain, n_name as town, r_name as county from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey",
    "prices": "select l_partkey as product_id, l_suppkey as store_id, l_extendedprice as price_kes, l_returnflag as source, l_shipdate as verified_at, l_discount >= 0.05 as is_promotional, l_orderkey as batch_id, l_linenumber as line_no from lineitem",
    "logs": "select o_orderkey as log_id, o_custkey as user_id, o_orderdate as ts, o_orderpriority as text, n_name as town, o_totalprice as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey",
    "log_items": "select l_orderkey as log_id, l_linenumber as line_no, l_partkey as product_id from lineitem",
    "traffic": "select event_id, ts, user_id, event_type as text, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as product_id, value from events",
    "sellers": "select s_suppkey as seller_id, s_name as display_name, n_name as town, case s_suppkey % 3 when 0 then 'verified' when 1 then 'pending' else 'rejected' end as verification_status, s_acctbal as balance, s_suppkey from supplier join nation on s_nationkey = n_nationkey",
    "reviews": "select l_suppkey as seller_id, o_custkey as reviewer_id, 1 + l_linenumber % 5 as rating, l_shipdate as created_at, l_orderkey as session_id, l_linenumber as line_no from lineitem join orders on l_orderkey = o_orderkey",
    "vectors": "select vec_id as product_id, embedding, label from embeddings",
}


def with_tables(body: str, *names: str) -> str:
    """A query over the tables named, bound by common table expressions."""
    ctes = ", ".join(f"{n} as ({_SQL[n]})" for n in names)
    body = body.strip()
    return f"with {ctes}{', ' + body[5:] if body.lower().startswith('with ') else ' ' + body}"


class Tables:
    """The same tables as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def products(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
            F.col("p_type").alias("category"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("base_price"))

    def nations(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("town"), F.col("n_regionkey").alias("region"))

    def stores(self) -> DataFrame:
        regions = self.raw("region").select(F.col("r_regionkey").alias("region"), F.col("r_name").alias("county"))
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("store_id"), F.col("s_name").alias("chain"), F.col("s_nationkey").alias("nation")).join(
            self.nations(), "nation").join(regions, "region").select("store_id", "chain", "town", "county")

    def prices(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("store_id"), F.col("l_extendedprice").alias("price_kes"),
            F.col("l_returnflag").alias("source"), F.col("l_shipdate").alias("verified_at"), (F.col("l_discount") >= 0.05).alias("is_promotional"),
            F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("line_no"))

    def logs(self) -> DataFrame:
        towns = self.raw("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("nation")).join(self.nations(), "nation")
        return self.raw("orders").select(
            F.col("o_orderkey").alias("log_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"),
            F.col("o_orderpriority").alias("text"), F.col("o_totalprice").alias("total")).join(towns, "user_id").select(
            "log_id", "user_id", "ts", "text", "town", "total")

    def log_items(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_orderkey").alias("log_id"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("product_id"))

    def baskets(self) -> DataFrame:
        """Logs with their products array, null where a log has none."""
        items = self.log_items().groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "product_id"))).alias("items"))
        return self.logs().join(items, "log_id", "left").withColumn("products", F.col("items.product_id")).drop("items")

    def traffic(self) -> DataFrame:
        return self.raw("events").select(
            "event_id", "ts", "user_id", F.col("event_type").alias("text"), F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("product_id"), "value")

    def sellers(self) -> DataFrame:
        status = F.when(F.col("s_suppkey") % 3 == 0, "verified").when(F.col("s_suppkey") % 3 == 1, "pending").otherwise("rejected")
        return self.raw("supplier").select("s_suppkey", "s_name", "s_acctbal", F.col("s_nationkey").alias("nation")).join(self.nations(), "nation").select(
            F.col("s_suppkey").alias("seller_id"), F.col("s_name").alias("display_name"), "town", status.alias("verification_status"), F.col("s_acctbal").alias("balance"), "s_suppkey")

    def reviews(self) -> DataFrame:
        orders = self.raw("orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("reviewer_id"))
        return self.raw("lineitem").select(
            F.col("l_suppkey").alias("seller_id"), (1 + F.col("l_linenumber") % 5).alias("rating"), F.col("l_shipdate").alias("created_at"),
            F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("line_no")).join(orders, "session_id")

    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("vec_id").alias("product_id"), "embedding", "label")
