"""Registered queries do the whole job of their operators: brute force over the smallest tables."""

import gzip
from collections import Counter, defaultdict
from math import sqrt

import pytest
from pyspark.sql import functions as F

from trolley.operators import graph, mining
from trolley.plans import jobs, model_queries, stream_queries
from trolley.plans.bindings import Tables
from trolley.plans.registry import QUERIES
from trolley.sources import tables


def test_similarity_counts_every_pair(spark, sf):
    baskets, often = defaultdict(list), Counter()
    for r in Tables(spark, sf).log_items().collect():
        baskets[r.log_id].append(r.product_id)
        often[r.product_id] += 1
    row = defaultdict(Counter)
    for items in baskets.values():
        items = [x for x in items if often[x] >= 5]
        for i, a in enumerate(items):
            for b in items[i + 1 :]:
                if a != b:
                    row[a][b] += 1
                    row[b][a] += 1
    norm = {a: sqrt(sum(n * n for n in r.values())) for a, r in row.items()}
    want = {}
    for a in row:
        for b in row:
            if a != b and (dot := sum(n * row[b][x] for x, n in row[a].items() if x in row[b])):
                want[a, b] = dot / norm[a] / norm[b]
    got = {(r.item_a, r.item_b): r.similarity for r in QUERIES["cosine_similarity_items"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - min(1, want[k])) < 2e-6 for k in got)


def test_lags_reach_ten_points(spark, sf):
    series = defaultdict(dict)
    for r in model_queries._series(Tables(spark, sf)).collect():
        series[r.brand, r.town][r.position] = r.price
    want = {}
    for brand, a in series:
        for other, b in series:
            x, y = series[brand, a], series[other, b]
            if brand == other and a < b and min(len(x), len(y)) >= 10:
                bound = min(len(x) // 2, len(y) // 2, 10)
                want |= {(brand, a, b, lag): n for lag in range(-bound, bound + 1) if (n := sum(p + lag in y for p in x))}
    got = {(r.brand, r.store_a, r.store_b, r.lag): r.points for r in QUERIES["lag_join"](spark, sf).collect()}
    assert got == want and max(lag for *_, lag in got) == 10


def test_registered_leads_are_those_of_the_operator(spark, sf):
    found = mining.lead_lag(model_queries._series(Tables(spark, sf)), "brand", "town").cache()
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(QUERIES["lead_lag"](spark, sf)) == rows(found) and any(abs(r.lag) > 4 for r in found.collect())
    assert rows(QUERIES["price_correlations"](spark, sf)) == rows(mining.mirrored(found))
    assert rows(QUERIES["leader_followers"](spark, sf)) == rows(mining.leader_followers(found))
    assert rows(QUERIES["correlations_for_product"](spark, sf)) == rows(found.where("brand = 'Brand#7'"))


def test_whole_tables(spark, sf):
    t = Tables(spark, sf)
    assert {r.product_id for r in QUERIES["changed_products"](spark, sf).collect()} == {r.product_id for r in t.prices().select("product_id").collect()}
    review = QUERIES["conditional_sort"](spark, sf).collect()
    assert {r.product_id for r in review} == {r.product_id for r in t.products().where("product_id % 3 = 0").collect()}
    order = [(r.category_status, r.sort_key, r.name, r.product_id) for r in review]
    assert len(order) > 50 and order == sorted(order)
    users, want = {r.seller_id for r in t.sellers().collect()}, Counter()
    for r in t.reviews().collect():
        want.update([(r.reviewer_id, "buyer")] * (r.reviewer_id in users) + [(r.seller_id, "seller")] * (r.seller_id in users))
    assert {(r.user_id, r.party): r.n for r in QUERIES["session_party_join"](spark, sf).collect()} == want
    assert QUERIES["iforest_fit"](spark, sf).select("tree").distinct().count() == 100


def test_pages_give_all_fields(spark, tmp_path):
    html = '<h1>Milk</h1><b class="price">KES 90</b><s class="old-price">KES 99</s><i class="badge">Offer</i>'
    spark.createDataFrame([(1, html)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert QUERIES["extract_html_items"](spark, str(tmp_path)).first().asDict() == {
        "page_id": 1, "name": "Milk", "price": "KES 90", "original_price": "KES 99", "promotion_details": "Offer"}


def test_pair_counts_take_partitions_by_rows(spark, sf, monkeypatch):
    items = Tables(spark, sf).log_items().union(spark.createDataFrame([(None, 1, 7), (None, 2, 8)], "log_id long, line_no int, product_id long"))
    want = {tuple(r) for r in mining.cooccurrence_counts(items).collect()}
    monkeypatch.setattr(mining, "PART_ITEMS", 100)
    counts = mining.cooccurrence_counts(items)
    assert counts.rdd.getNumPartitions() >= items.count() / 100
    assert {tuple(r) for r in counts.collect()} == want
    assert mining.basket_pairs(items).where("log_id is null").isEmpty()


def test_items_to_ingest_are_written_compressed(spark, sf, monkeypatch, tmp_path):
    monkeypatch.setattr(stream_queries, "FILE_ROWS", 1000)
    monkeypatch.setattr(stream_queries.B, "scratch", lambda spark, name: str(tmp_path / name))
    rows = Tables(spark, sf).prices().count()
    assert QUERIES["stream_ingest_prices"](spark, sf).count() > 0
    files = list((tmp_path / "ingest" / "in").glob("part-*"))
    held = [gzip.decompress(f.read_bytes()).count(b"\n") for f in files]
    assert sum(held) == rows and max(held) <= 1000
    assert sum(f.stat().st_size for f in files) < 50 * rows


def pairs_of(rows, same, different=lambda r: None):
    return sorted((a.product_id, b.product_id) for a in rows for b in rows if a.product_id != b.product_id and same(a) == same(b) and (different(a) is None or different(a) != different(b)))


def test_same_category_pairs_are_all_of_a_category(spark, sf, monkeypatch):
    rows = Tables(spark, sf).products().collect()
    assert sorted(map(tuple, QUERIES["same_category_pairs"](spark, sf).collect())) == pairs_of(rows, lambda r: r.category)
    monkeypatch.setattr(graph, "BLOCK_MEMBERS", 5)
    found = graph.same_category_pairs(Tables(spark, sf).products())
    made = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(made) > 6 and sum(n for _, n in made) == found.count()  # a class is made by more than one task


def test_substitutes_may_have_other_names(spark, sf):
    rows = Tables(spark, sf).products().collect()
    want = pairs_of(rows, lambda r: r.category, lambda r: r.brand)
    assert sorted(map(tuple, QUERIES["substitute_pairs"](spark, sf).collect())) == want and len(want) > 1000


def test_graph_links_all_of_a_category(spark, sf):
    rows = Tables(spark, sf).products().collect()
    edges = QUERIES["build_graph"](spark, sf).cache()
    of = lambda kind: sorted((r.src, r.dst) for r in edges.where(F.col("edge_type") == kind).collect())
    assert of("same_category") == pairs_of(rows, lambda r: r.category)
    assert of("substitute") == pairs_of(rows, lambda r: r.category, lambda r: r.brand) != []


@pytest.mark.parametrize("name", ["exact_then_fuzzy", "find_product", "find_product_matches", "fuzzy_cross_match", "keep_best_score", "suggest_corrections"])
def test_every_product_is_asked_for(spark, sf, name):
    assert {r.query_id for r in QUERIES[name](spark, sf).select("query_id").distinct().collect()} == {r.product_id for r in Tables(spark, sf).products().collect()}


def test_reason_text_joins_two_reasons(spark, sf):
    similar = defaultdict(list)
    for r in QUERIES["cosine_similarity_items"](spark, sf).collect():
        if r.similarity > 0:
            similar[r.item_a].append((-r.similarity, r.item_b))
    want = {a: "; ".join(f"Users who viewed {b}" for _, b in sorted(found)[:2]) for a, found in similar.items()}
    assert {r.item_a: r.reason for r in QUERIES["reason_text"](spark, sf).collect()} == want and any("; " in x for x in want.values())


@pytest.mark.parametrize("name", ["generate_prices", "cross_join_prices"])
def test_prices_of_a_small_file_are_made_by_many_tasks(spark, sf, name):
    found = QUERIES[name](spark, sf)
    made = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(made) >= 8 and sum(n for _, n in made) == 200 * 10 == found.select("product_id", "store_id").distinct().count()


def test_similarities_are_stored_packed(spark, sf, tmp_path):
    found = QUERIES["cosine_similarity_items"](spark, sf).coalesce(1)
    rows = sorted(map(tuple, found.collect()))
    size = lambda path: sum(f.stat().st_size for f in tmp_path.joinpath(path).glob("**/part-*"))
    found.write.parquet(f"{tmp_path}/plain")
    path = tables.save_version(found, f"{tmp_path}/similarities", 1, jobs.PACKED)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == rows
    assert size("similarities/version=1") < 0.9 * size("plain")
