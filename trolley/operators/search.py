"""Product search for tables of queries: nearest vectors, fuzzy names, exact names, and the ranked mix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.functions import scores as S
from trolley.functions import text as X
from trolley.operators import fuzzy
from trolley.operators import vectors as nearest
from trolley.operators.anomaly import embed_text
from trolley.operators.windows import best_per_key, top_n_per_group
from trolley.sources.tables import stored


def knn_join(queries: DataFrame, vectors: DataFrame, k: int = 50, block_rows: int = 1024, threshold: float = -1.0) -> DataFrame:
    """The k nearest vectors by cosine for each query (query_id, embedding), exactly; by an inverted file of the vectors.

    Queries go to the tasks in blocks of block_rows; a ring of vectors is compared only with the queries it can matter to.
    """
    # both are read several times, and may come from an encoder
    queries, vectors = stored(queries.select("query_id", "embedding"), "queries"), stored(vectors.select("product_id", "embedding"), "vectors")
    if vectors.isEmpty():
        return vectors.sparkSession.createDataFrame([], "query_id long, product_id long, score double, rank long")
    return nearest.knn(queries, nearest.build(vectors), k, block_rows).where(F.col("score") >= threshold)


def product_terms(products: DataFrame) -> DataFrame:
    """Names and brands as terms of a product, with their type."""
    return products.select("product_id", F.lower("name").alias("term"), F.lit("name").alias("term_type")).unionByName(
        products.select("product_id", F.lower("brand").alias("term"), F.lit("brand").alias("term_type")))


#: So many pairs are compared in less time than it takes to find candidates.
FEW_PAIRS = 1 << 20


def alike(rows: DataFrame, key: str, what: list[str]) -> DataFrame:
    """key, rep: keys whose rows have the same set of `what` stand for each other, the smallest one for all. Stored."""
    sets = rows.groupBy(key).agg(F.sha2(F.to_json(F.array_sort(F.collect_set(F.struct(*what)))), 256).alias("_set"))
    sets = stored(sets, "sets")
    return stored(sets.join(sets.groupBy("_set").agg(F.min(key).alias("rep")).hint("merge"), "_set").select(key, "rep"), "alike")


def _queries_alike(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one query for each text, which stands for which)."""
    asking = alike(queries.select("query_id", F.lower(F.trim("text")).alias("asked")), "query_id", ["asked"])
    return queries.select("query_id", "text").join(asking.where("query_id = rep").hint("merge"), "query_id", "left_semi"), asking


def _first_products(terms: DataFrame, n: int) -> DataFrame:
    """The terms of the n smallest products of those that have all terms in common: the others rank behind them in every search."""
    first = top_n_per_group(alike(terms, "product_id", ["term", "term_type"]), ["rep"], ["product_id"], n)
    return terms.join(first.select("product_id").hint("merge"), "product_id", "left_semi")


def _for_all(found: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """Rows found for one key, for all that it stands for. Nothing is shuffled after this."""
    each = members.select(F.col(key).alias("_each"), F.col("rep").alias("_rep")).hint("merge")
    return found.join(each, F.col(key) == F.col("_rep")).withColumn(key, F.col("_each")).drop("_each", "_rep")


def fuzzy_cross_match(queries: DataFrame, terms: DataFrame, threshold: float = 0.6, block_rows: int = 2048) -> DataFrame:
    """Best term of each product for each query (query_id, text), where the combined score reaches the threshold.

    Worked out once for all queries of one text and all products of one set of terms.
    """
    few, asking = _queries_alike(queries)
    products = alike(terms, "product_id", ["term", "term_type"])
    found = _best_terms(few, terms.join(products.where("product_id = rep").hint("merge"), "product_id", "left_semi"), threshold, block_rows)
    return _for_all(_for_all(found, "query_id", asking), "product_id", products)


def best_scores(queries: DataFrame, terms: DataFrame, threshold: float = 0.6) -> DataFrame:
    """keep_best_score of fuzzy_cross_match."""
    few, asking = _queries_alike(queries)
    products = alike(terms, "product_id", ["term", "term_type"])
    found = _best_terms(few, terms.join(products.where("product_id = rep").hint("merge"), "product_id", "left_semi"), threshold)
    return _for_all(_for_all(keep_best_score(found), "query_id", asking), "product_id", products)


def _best_terms(queries: DataFrame, terms: DataFrame, threshold: float, block_rows: int = 2048) -> DataFrame:
    """fuzzy_cross_match of few queries and products.

    Exact. Different query texts meet different terms by shared keys (`fuzzy.candidates`). Thresholds below about 0.56 leave no key that all
    matches share; there, and where all pairs are no more than FEW_PAIRS, queries go to the terms in blocks of block_rows, each block one pass over the terms.
    """
    asked, term = F.col("asked"), F.col("term")
    q = queries.select(F.lower(F.trim("text")).alias("asked")).where(F.length("asked") > 0).distinct()
    t = terms.select("term").where(F.length("term") > 0).distinct()
    q = stored(q.withColumn("asked_sounds", S.sounds(asked)), "asked")
    t = stored(t.withColumn("term_sounds", S.sounds(term)), "terms")
    if fuzzy.indexed(threshold) and q.count() * t.count() > FEW_PAIRS:
        pairs = fuzzy.candidates(q, t, threshold, len(S.PHONETIC_CODES)).join(q, "asked").join(t, "term")
    else:
        pairs = _all_pairs(q, t, threshold, block_rows)
    score = S.combined_match_score(S.string_similarity(asked, term), S.same_sounds(F.col("asked_sounds"), F.col("term_sounds")), asked == term, F.lit(False))
    good = pairs.withColumn("score", score).where(F.col("score") >= threshold).select("asked", "term", "score")
    full = queries.select("query_id", F.lower(F.trim("text")).alias("asked")).join(good, "asked").join(terms, "term")
    return best_per_key(full, ["query_id", "product_id"], [F.col("score").desc(), "term", "term_type"]).select("query_id", "product_id", "score", F.col("term").alias("matched_term"), F.col("term_type").alias("match_type"))


def _all_pairs(q: DataFrame, t: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """All pairs but those whose lengths rule the threshold out."""
    asked, term = F.col("asked"), F.col("term")
    shorter, longer = F.least(F.length(asked), F.length(term)), F.greatest(F.length(asked), F.length(term))
    best = 0.7 * F.greatest(1.1 - 1.3 * (longer - shorter) / longer, 0.7 + 0.3 * shorter / longer) + 0.4  # of any pair with these lengths
    blocks = max(1, -(-q.count() // block_rows))
    out = None
    for k in range(blocks):
        block = q if blocks == 1 else q.where(F.pmod(F.xxhash64("asked"), F.lit(blocks)) == k)
        part = t.join(F.broadcast(block), best >= threshold)
        out = part if out is None else out.unionByName(part)
    return out


def exact_then_fuzzy(queries: DataFrame, terms: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Products whose term equals the query; for queries without one, the best fuzzy match."""
    q = queries.select("query_id", F.lower(F.trim("text")).alias("term"))
    exact = q.join(terms, "term").groupBy("query_id", "product_id").agg(F.lit(1.0).alias("score"), F.first("term").alias("matched_term"), F.lit("exact").alias("match_type"))
    rest = queries.join(exact.select("query_id").distinct(), "query_id", "left_anti")
    few, asking = _queries_alike(rest)
    fuzzy = best_per_key(_best_terms(few, _first_products(terms, 1), threshold), ["query_id"], [F.col("score").desc(), "product_id"])
    return exact.unionByName(_for_all(fuzzy, "query_id", asking).withColumn("match_type", F.lit("fuzzy")))


def suggest_corrections(queries: DataFrame, terms: DataFrame, low: float = 0.3, high: float = 0.8, n: int = 5) -> DataFrame:
    """Terms near a query but not the same, the best n."""
    few, asking = _queries_alike(queries)
    near = _best_terms(few, _first_products(terms, 1), low).where(F.col("score") < high)
    once = near.groupBy("query_id", "matched_term").agg(F.max("score").alias("score"))
    return _for_all(top_n_per_group(once, ["query_id"], [F.col("score").desc(), "matched_term"], n), "query_id", asking)


def keep_best_score(results: DataFrame) -> DataFrame:
    return results.groupBy("query_id", "product_id").agg(F.max("score").alias("score"))


def search_products(
    queries: DataFrame, products: DataFrame, words: X.Vocabulary, encode: Callable[[DataFrame, str], DataFrame] = embed_text,
    candidates: int = 50, limit: int = 20,
) -> DataFrame:
    """Texts of queries (query_id, text) to ranked products (product_id, name, brand, category, size, unit, aliases).

    A query is parsed into brand, category, quantity and keywords, and encoded as the products' texts are. Candidates are the nearest
    vectors and the fuzzy matches of names and brands; each is scored on vector, name, brand, category, quantity and aliases.
    """
    parsed = X.parse_query(queries.select("query_id", "text"), "text", words).withColumn("plain", X.normalize_text_search(F.col("text")))
    asked = encode(parsed, "plain").select("query_id", "embedding")
    shown = X.normalize_text_search(F.concat_ws(" ", "name", "brand", "category"))
    near = knn_join(asked, encode(products.select("product_id", shown.alias("shown")), "shown"), candidates, threshold=0.1)
    near = near.select("query_id", "product_id", F.col("score").alias("vector"))
    named = F.concat_ws(" ", F.array_join("keywords", " "), F.col("query_category"))
    fuzzy = fuzzy_cross_match(parsed.select("query_id", named.alias("text")), product_terms(products)).select("query_id", "product_id", F.col("score").alias("fuzzy"), "match_type")
    both = near.join(fuzzy, ["query_id", "product_id"], "full_outer")
    both = both.join(products.select("product_id", "name", X.normalize_text_search(F.col("brand")).alias("has_brand"), F.col("category").alias("has_category"), "size", "unit", "aliases"), "product_id")
    both = both.join(parsed.select("query_id", "keywords", "query_brand", "query_category", "query_size", "query_unit"), "query_id")
    parts = {
        "vector": F.col("vector"), "fuzzy": F.col("fuzzy"),
        "brand": S.containment_score(F.col("query_brand"), F.col("has_brand")), "category": S.containment_score(F.col("query_category"), F.col("has_category")),
        "quantity": S.quantity_score(F.col("query_size"), F.col("query_unit"), F.col("size").cast("double"), F.col("unit")),
        "alias": S.alias_score(F.col("keywords"), F.col("aliases"))}
    scored = both.withColumn("final_score", F.round(S.final_score(parts), 6)).withColumn("match_type", F.coalesce("match_type", F.lit("vector")))
    return top_n_per_group(scored, ["query_id"], [F.col("final_score").desc(), "product_id"], limit).select("query_id", "rank", "product_id", "name", "final_score", "match_type")


def find_product(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """The one product for each query."""
    few, asking = _queries_alike(queries)
    return _for_all(best_per_key(exact_then_fuzzy(few, _first_products(terms, 1)), ["query_id"], [F.col("score").desc(), "product_id"]), "query_id", asking)


def find_product_matches(queries: DataFrame, terms: DataFrame, cheapest: DataFrame, n: int = 5) -> DataFrame:
    """The n best products of each query with their cheapest price."""
    few, asking = _queries_alike(queries)
    first = stored(_first_products(terms, n), "first-products")
    found = exact_then_fuzzy(few, first).unionByName(fuzzy_cross_match(few, first))
    once = best_per_key(found, ["query_id", "product_id"], [F.col("score").desc(), "matched_term", "match_type"])
    top = top_n_per_group(once, ["query_id"], [F.col("score").desc(), "product_id"], n)
    return _for_all(top.join(cheapest.select("product_id", "price_kes", "store_id"), "product_id", "left"), "query_id", asking)


def query_single_product(queries: DataFrame, terms: DataFrame, listing: DataFrame) -> DataFrame:
    """The price listing of the one product found for each query."""
    return find_product(queries, terms).select("query_id", "product_id", "match_type").join(listing, "product_id")
