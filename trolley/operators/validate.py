"""Validation: rows keep a reason when they are rejected and warnings when they are odd."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sources known to be valid, words for true and false.
SOURCES = ("naivas_online", "carrefour_online", "quickmart_online", "chandarana_online", "manual", "api")
TRUE, FALSE = ("true", "yes", "1"), ("false", "no", "0")


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, else null."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in rules])


def blank(col: str) -> Column:
    return F.coalesce(F.trim(F.col(col).cast("string")), F.lit("")) == ""


def to_price(raw: Column) -> Column:
    return F.trim(raw).try_cast("double")


def to_time(raw: Column) -> Column:
    """ISO 8601 (with Z or an offset) or "yyyy-MM-dd HH:mm:ss"."""
    raw = F.trim(raw)
    return F.coalesce(raw.try_cast("timestamp"), F.try_to_timestamp(raw, F.lit("yyyy-MM-dd HH:mm:ss")))


def to_flag(raw: Column) -> Column:
    low = F.lower(F.trim(raw))
    return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)


def validate_required(columns: Sequence[str] = ("store_id", "price_kes", "source", "verified_at")) -> list[tuple[str, Column]]:
    return [(f"missing {c}", blank(c)) for c in columns]


def validate_types() -> list[tuple[str, Column]]:
    price = to_price(F.col("price_kes"))
    return [
        ("invalid price_kes", ~blank("price_kes") & (price.isNull() | F.isnan(price))),
        ("price_kes not positive", price <= 0),
        ("invalid verified_at", ~blank("verified_at") & to_time(F.col("verified_at")).isNull()),
        ("invalid is_promotional", F.col("is_promotional").isNotNull() & to_flag(F.col("is_promotional")).isNull()),
    ]


def business_warnings(as_of: str) -> Column:
    """Odd but accepted: high price, unknown source, promotion without details, far future, very old."""
    now, ts = F.lit(as_of).cast("timestamp"), to_time(F.col("verified_at"))
    checks = [
        ("high price", to_price(F.col("price_kes")) > 100000), ("unknown source", ~F.lower("source").isin(*SOURCES)),
        ("promotion without details", to_flag(F.col("is_promotional")) & blank("promotion_details")),
        ("far in the future", ts > now + F.expr("interval 365 days")), ("very old", ts < now - F.expr("interval 730 days")),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in checks]))


def validate_items(raw: DataFrame, as_of: str) -> DataFrame:
    """All rows of raw (strings) with typed columns, reject_reason (null if valid) and warnings."""
    return raw.select(
        *[c for c in raw.columns if c not in ("price_kes", "verified_at", "is_promotional")],
        to_price(F.col("price_kes")).alias("price_kes"), to_time(F.col("verified_at")).alias("verified_at"),
        F.coalesce(to_flag(F.col("is_promotional")), F.lit(False)).alias("is_promotional"),
        first_reason(validate_required() + validate_types()).alias("reject_reason"), business_warnings(as_of).alias("warnings"))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.where(F.col("reject_reason").isNull()).drop("reject_reason"), checked.where(F.col("reject_reason").isNotNull())


#: Constraints of the tables: name of the rule and SQL that is true for a bad row.
SCHEMA_RULES: Mapping[str, Sequence[tuple[str, str]]] = {
    "products": (("name length", "name is null or length(trim(name)) not between 1 and 200"), ("category length", "category is null or length(trim(category)) not between 1 and 100")),
    "stores": (("latitude", "gps_latitude not between -90 and 90"), ("longitude", "gps_longitude not between -180 and 180")),
    "prices": (("price", "price_kes is null or price_kes <= 0"), ("price places", "abs(price_kes * 100 - round(price_kes * 100)) > 0.000001")),
    "reviews": (("rating", "rating is null or rating not between 1 and 5"),),
    "sellers": (
        ("seller id", "telegram_user_id is null or telegram_user_id <= 0"), ("town", "town is null or length(trim(town)) = 0"),
        ("verification status", "verification_status is null or verification_status not in ('pending', 'verified', 'rejected')")),
    "chat_requests": (
        ("buyer id", "buyer_user_id is null or buyer_user_id <= 0"), ("status", "status is null or status not in ('pending', 'accepted', 'declined', 'expired')"),
        ("message length", "length(buyer_message) > 500"), ("expiry", "expires_at is null or expires_at < created_at")),
    "chat_sessions": (
        ("buyer id", "buyer_user_id is null or buyer_user_id <= 0"), ("seller id", "grocer_telegram_user_id is null or grocer_telegram_user_id <= 0"),
        ("status", "status is null or status not in ('active', 'ended_by_buyer', 'ended_by_grocer', 'expired')")),
    "chat_messages": (("text", "text is null or length(trim(text)) = 0"), ("role", "role not in ('user', 'assistant', 'system')"), ("turn", "turn < 0")),
}


def validate_schema(df: DataFrame, table: str) -> DataFrame:
    return df.withColumn("reject_reason", first_reason([(name, F.expr(bad)) for name, bad in SCHEMA_RULES[table]]))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that break uniqueness, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def truncate_text(text: Column, longest: int = 50) -> Column:
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest), F.lit("..."))).otherwise(text)


def coalesce_columns(df: DataFrame, candidates: Sequence[str]) -> Column:
    """The first of the candidate columns that the table has and that isn't null."""
    there = [F.col(c) for c in candidates if c in df.columns]
    return F.coalesce(*there) if there else F.lit(None)


def url_host_in(url: Column, domains: Sequence[str]) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1)).isin(*[d.lower() for d in domains]), F.lit(False))


def array_iequals(items: Column, value: str) -> Column:
    return F.exists(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.lower(x) == value.lower())


def text_contains_any(columns: Sequence[str], term: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(c).contains(term.lower()), F.lit(False))
    return out
