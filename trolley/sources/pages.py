"""Items, links and promotions out of stored product pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trolley.operators.windows import best_per_key

_BLOCK = r"(?s)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"
# The entities that shops use.
ENTITIES = {"&quot;": '"', "&#34;": '"', "&#39;": "'", "&apos;": "'", "&lt;": "<", "&gt;": ">", "&nbsp;": " ", "&amp;": "&"}


def unescape_html(text: Column) -> Column:
    for entity, plain in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def extract_jsonld_items(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, name, price (text), currency of the first Product block of each page that has one.

    A block may be one object or a list; broken JSON gives nothing. Names and prices are unescaped.
    """
    blocks = pages.select("page_id", F.posexplode(F.regexp_extract_all(html, F.lit(_BLOCK), F.lit(1))).alias("place", "raw"))
    parsed = blocks.withColumn("v", F.try_parse_json(F.trim("raw"))).where(F.col("v").isNotNull())
    one = F.array(F.col("v"))
    items = parsed.withColumn("list", F.coalesce(F.try_variant_get("v", "$", "array<variant>"), one)).select("page_id", "place", F.posexplode("list").alias("inner", "item"))
    text = lambda path: F.try_variant_get("item", path, "string")
    found = items.where(text("$['@type']") == "Product").select(
        "page_id", "place", "inner", unescape_html(text("$.name")).alias("name"),
        F.coalesce(text("$.offers.price"), text("$.offers[0].price")).alias("price"), F.coalesce(text("$.offers.priceCurrency"), text("$.offers[0].priceCurrency")).alias("currency"))
    return best_per_key(found, ["page_id"], ["place", "inner"]).select("page_id", "name", "price", "currency")


#: Field to patterns in order of preference; a real crawl has a set for each shop.
RULES: Mapping[str, Sequence[str]] = {
    "name": (r"(?is)<h1[^>]*>(.*?)</h1>", r"(?is)<title[^>]*>(.*?)</title>"),
    "price": (r"(?is)class=\"[^\"]*price[^\"]*\"[^>]*>([^<]*)<", r"(?i)(KES\s*[0-9][0-9,.]*)"),
    "original_price": (r"(?is)class=\"[^\"]*old-price[^\"]*\"[^>]*>([^<]*)<",),
    "promotion_details": (r"(?is)class=\"[^\"]*badge[^\"]*\"[^>]*>([^<]*)<",),
}


def extract_html_items(pages: DataFrame, rules: Mapping[str, Sequence[str]] = RULES, html: str = "html") -> DataFrame:
    """page_id and a field for each rule: the first pattern with a non-blank hit, without tags, unescaped."""
    def hit(patterns: Sequence[str]) -> Column:
        each = [F.nullif(F.trim(unescape_html(F.regexp_replace(F.regexp_extract(html, p, 1), "<[^>]*>", ""))), F.lit("")) for p in patterns]
        return F.coalesce(*each)

    return pages.select("page_id", *[hit(ps).alias(name) for name, ps in rules.items()])


def extract_links(pages: DataFrame, html: str = "html", pattern: str = r'href="([^"#]+)"') -> DataFrame:
    """page_id and each different link with its place among them."""
    links = F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)))
    return pages.select("page_id", F.posexplode(links).alias("place", "link")).select("page_id", F.col("place").cast("long").alias("place"), "link")


def detect_promo(current: Column, original: Column, badge: Column) -> Column:
    return (F.coalesce(F.trim(badge), F.lit("")) != "") | F.coalesce(current < original, F.lit(False))


def item_defaults(items: DataFrame, chain: str, as_of: str) -> DataFrame:
    """Missing columns and nulls filled: chain, branch, time, promotion flag."""
    defaults = {"store_chain": F.lit(chain), "store_branch": F.lit("Online Store"), "verified_at": F.lit(as_of).cast("timestamp"), "is_promotional": F.lit(False)}
    return items.withColumns({c: F.coalesce(F.col(c), d) if c in items.columns else d for c, d in defaults.items()})
