"""Registered queries without SQL, against plain Python over the smallest tables."""

import re
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F
from test_retail import _distance, _metaphone

from trolley.functions import text as X
from trolley.plans import model_queries as MQ
from trolley.plans import text_queries as TQ
from trolley.plans.bindings import Tables
from trolley.plans.registry import QUERIES

WORDS = TQ.WORDS


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def squeeze(text):
    return re.sub(r"\s+", " ", text).strip()


def first_contained(text, words):
    return next((w for w in words if w in text.lower()), None)


def normal_unit(word):
    return X.UNITS[word.lower()][0]


def attributes(title):
    """Brand, then category, size and the rest of a title, each looked for in what the ones before it left."""
    clean = squeeze(title)
    low = clean.lower()
    places = [(m.start(), -len(b), b) for b in WORDS.brands for m in re.finditer(rf"\b{re.escape(b.lower())}\b", low)]
    brand = min(places)[2] if places else None
    hits = [(-len(c), i, c) for i, c in enumerate(WORDS.categories) if re.search(rf"\b{re.escape(c)}\b", low)]
    category = min(hits)[2] if hits else None
    subcategory = next((c for _, _, c in sorted(hits, key=lambda h: h[1]) if c not in category and category not in c), None)
    size = re.search(X.SIZE_PATTERN, clean)
    part = re.search(X.FRACTION_PATTERN, clean)
    number = float(size[1]) if size else X.FRACTIONS[part[1].lower()] if part else None
    unit = normal_unit(size[2] if size else part[2]) if size or part else None
    without = lambda text, gone: squeeze(text.replace(gone.lower(), "")) if gone else squeeze(text)
    left = squeeze(re.sub(X.SIZE_PATTERN, "", without(without(low, brand), category)))
    flavour = first_contained(left, WORDS.flavours)
    left = without(left, flavour)
    variant = first_contained(left, WORDS.variants)
    rest = without(left, variant)
    rest = rest if len(rest) > 2 else None
    return {"brand": brand, "category": category, "subcategory": subcategory, "size": number, "unit": unit, "package_type": first_contained(clean, WORDS.packages), "colour": first_contained(clean, WORDS.colours),
            "variant": variant or rest, "flavour": flavour or (rest if variant else None)}


def size_text(size):
    return str(int(size)) if size == int(size) else str(size)


def canonical(a, title):
    parts = [a["brand"], a["category"], a["subcategory"], size_text(a["size"]) + a["unit"] if a["size"] is not None and a["unit"] else None, a["variant"], a["flavour"]]
    kept = [p for p in parts if p is not None and p.lower() not in ("", "unknown")]
    once = [p for i, p in enumerate(kept) if p.lower() not in [q.lower() for q in kept[:i]]]
    name = squeeze(" ".join(once))[:100].rstrip(" ")
    return {"canonical_name": name or title[:100] or "Unknown Product", "brand": a["brand"] or "unknown", "category": a["category"] or "general", "size": a["size"],
            "unit": a["unit"] or WORDS.default_units.get(a["category"]), "variant": a["variant"], "flavour": a["flavour"]}


def aliases(c):
    synonyms = {**WORDS.synonyms, "ring": ("pete",)}
    join = lambda *parts: " ".join(parts).lower() if all(p is not None for p in parts) else None
    measure = size_text(c["size"]) + c["unit"] if c["size"] is not None and c["unit"] else None
    brand, category = c["brand"], c["category"]
    local = synonyms.get(category.lower(), ())
    found = [c["canonical_name"], brand, join(brand, category), join(brand, measure), category, join(category, measure), join(category, c["variant"]), join(category, c["flavour"]), measure, join(measure, category)]
    found = [f.lower() for f in found if f is not None] + [x for w in local for x in (w, join(brand, w), f"{w} {measure}" if measure else None) if x is not None]
    return sorted({squeeze(f) for f in found if 2 <= len(squeeze(f)) <= 100 and not re.fullmatch("[0-9]+", squeeze(f).replace(" ", ""))})[:20]


def test_attributes_names_and_aliases(spark, sf):
    titles = {r.product_id: r.title for r in TQ.titles(Tables(spark, sf)).collect()}
    read = {i: attributes(t) for i, t in titles.items()}
    for r in QUERIES["extract_attributes"](spark, sf).collect():
        assert {c: r[c] for c in read[r.product_id]} == read[r.product_id], titles[r.product_id]
    made = {i: canonical(read[i], t) for i, t in titles.items()}
    for r in QUERIES["canonical_product"](spark, sf).collect():
        assert {c: r[c] for c in made[r.product_id]} == made[r.product_id]
    known = {i: aliases(c) for i, c in made.items()}
    assert {r.product_id: r.aliases for r in QUERIES["generate_aliases"](spark, sf).collect()} == {i: "|".join(a) for i, a in known.items()}
    assert {r.product_id: r.n_aliases for r in QUERIES["normalize_item"](spark, sf).collect()} == {i: len(a) for i, a in known.items()}
    want = {i: f"Product Name: {c['canonical_name']}\nBrand: {c['brand']}\nCategory: {c['category']}\nAliases: {c['brand']}, {c['category']}" for i, c in made.items()}
    assert {r.product_id: r.text for r in QUERIES["embedding_text_labelled"](spark, sf).collect()} == want


def keywords(text):
    low = re.sub(r"[^\w\s.]|_(?!)", " ", (text or "").strip(" ").lower())
    low = re.sub(r"(^|[^0-9])\.|\.([^0-9]|$)", lambda m: (m[1] or "") + " " + (m[2] or ""), low)
    units = "|".join(sorted(X.UNITS, key=lambda u: (-len(u), u)))
    for word, value in X.FRACTIONS.items():
        low = re.sub(rf"\b{word}\s+({units})\b", rf"{value:g} \1", low)
    for unit in dict.fromkeys(u for u, _, _ in X.UNITS.values()):
        own = "|".join(sorted([s for s, (u, _, _) in X.UNITS.items() if u == unit], key=lambda s: (-len(s), s)))
        low = re.sub(rf"\b([0-9]+(?:\.[0-9]+)?)\s*(?:{own})\b", rf"\1 {unit}", low)
    low = " ".join(low.split())
    for words in (WORDS.brands, WORDS.categories):
        every = sorted({w.lower().replace("#", " ") for w in words}, key=lambda w: (-len(w), w))
        low = re.sub(rf"\b({'|'.join(map(re.escape, every))})\b", " ", low)
    low = re.sub(X.FRACTION_PATTERN, " ", re.sub(X.SIZE_PATTERN, " ", low))
    return " ".join(w for w in low.split() if len(w) > 1)


def test_query_keywords(spark, sf):
    said = {(r.conv_id, r.turn): r.text for r in TQ._messages(Tables(spark, sf)).collect()}
    got = {(r.conv_id, r.turn): r.keywords for r in QUERIES["query_keywords"](spark, sf).collect()}
    assert got == {k: keywords(t) for k, t in said.items()}


@pytest.fixture(scope="module")
def scorer(spark, sf):
    t = Tables(spark, sf)
    asked = {r.query_id: r.text.strip(" ").lower() for r in MQ._asked(t).collect()}
    terms = [(r.product_id, x.lower(), k) for r in t.products().collect() for x, k in ((r.name, "name"), (r.brand, "brand"))]
    words = sorted({*asked.values(), *(x for _, x, _ in terms)})
    codes = {r.w: (r.s, _metaphone(r.w)) for r in spark.createDataFrame([(w,) for w in words], "w string").withColumn("s", F.soundex("w")).collect()}

    def score(a, b):
        small, large = sorted((len(a), len(b)))
        if a == b:
            sim = 1.0
        elif a in b or b in a:
            sim = 0.7 + 0.3 * small / large
        else:
            sim = max(0.0, min(1.0, 1 - _distance(a, b) / large + 0.1 * (a[0] == b[0])) - 0.3 * (large - small) / large)
        sound = sum(x == y for x, y in zip(codes[a], codes[b], strict=True)) / 2
        return float(Decimal(repr(round(min(1.0, 0.7 * sim + 0.3 * sound + 0.1 * (a == b)), 9))).quantize(Decimal("0.001"), ROUND_HALF_UP))

    return asked, terms, score


def fuzzy(asked, terms, score, least):
    """(query, product): (score, term, type) of the best term."""
    known, out = {}, {}
    for q, a in asked.items():
        for pid, x, kind in terms:
            s = known.setdefault((a, x), score(a, x) if (a, x) not in known else None)
            if s >= least:
                out[q, pid] = min(out.get((q, pid), (9, "", "")), (-s, x, kind))
    return {k: (-s, x, kind) for k, (s, x, kind) in out.items()}


def test_fuzzy_and_exact_matches(spark, sf, scorer):
    asked, terms, score = scorer
    want = fuzzy(asked, terms, score, 0.6)
    got = {(r.query_id, r.product_id): (r.score, r.matched_term, r.match_type) for r in QUERIES["fuzzy_cross_match"](spark, sf).collect()}
    # a score that lies between two roundings may go either way
    assert got.keys() == want.keys() and len(got) > 20 and all(got[k][1:] == want[k][1:] and abs(got[k][0] - want[k][0]) < 0.0011 for k in got)
    want = got
    assert rows(QUERIES["keep_best_score"](spark, sf)) == sorted(((q, p, s) for (q, p), (s, _, _) in want.items()), key=str)
    best = {}
    for q, a in asked.items():
        same = [(p, 1.0, x, "exact") for p, x, _ in terms if x == a]
        near = sorted((-s, p, x) for (k, p), (s, x, _) in want.items() if k == q)[:1]
        best[q] = sorted(set(same)) or [(p, -s, x, "fuzzy") for s, p, x in near]
    assert rows(QUERIES["exact_then_fuzzy"](spark, sf).select("query_id", "product_id", "score", "matched_term", "match_type")) == sorted(((q, *b) for q, bs in best.items() for b in bs), key=str)
    one = {r.query_id: r.product_id for r in QUERIES["find_product"](spark, sf).collect()}
    assert one == {q: min(bs, key=lambda b: (-b[1], b[0]))[0] for q, bs in best.items() if bs}


def test_suggested_corrections(spark, sf, scorer):
    asked, terms, score = scorer
    near = {}
    for (q, _), (s, x, _) in fuzzy(asked, terms, score, 0.3).items():
        if s < 0.8:
            near.setdefault(q, {}).update({x: max(s, near.get(q, {}).get(x, 0))})
    want = {(q, x, s, i + 1) for q, found in near.items() for i, (s, x) in enumerate(sorted(((s, x) for x, s in found.items()), key=lambda k: (-k[0], k[1]))[:5])}
    got = {(r.query_id, r.matched_term, r.rank): r.score for r in QUERIES["suggest_corrections"](spark, sf).collect()}
    want = {(q, x, i): s for q, x, s, i in want}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 0.0011 for k in got)


def test_phonetic_scores(spark, sf):
    pairs = TQ._pairs(Tables(spark, sf)).select("product_id", "name", "other", F.soundex("name").alias("a"), F.soundex("other").alias("b")).collect()
    want = {r.product_id: ((r.a == r.b) + (_metaphone(r.name) == _metaphone(r.other))) / 2 for r in pairs}
    assert {r.product_id: r.phonetic for r in QUERIES["phonetic_score"](spark, sf).collect()} == want
