"""Similarity and ranking scores, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from trolley.functions.text import dimension, to_base_units

# Weights of the parts of a result's score; they are divided by their sum.
WEIGHTS = {"vector": 0.45, "fuzzy": 0.25, "brand": 0.15, "category": 0.10, "quantity": 0.10, "alias": 0.05}


def string_similarity(a: Column, b: Column) -> Column:
    """1 if equal, 0.7 and more if one contains the other, else edit similarity with a bonus for the first letter and a penalty for length.

    The base is 1 - levenshtein / longer length. Null or empty: 0.
    """
    s, t = F.lower(F.trim(a)), F.lower(F.trim(b))
    n, m = F.length(s), F.length(t)
    shorter, longer = F.least(n, m), F.greatest(n, m)
    base = 1 - F.levenshtein(s, t) / longer
    bonus = F.least(F.lit(1.0), base + F.when(F.substring(s, 1, 1) == F.substring(t, 1, 1), 0.1).otherwise(0.0))
    edited = F.greatest(F.lit(0.0), bonus - 0.3 * (longer - shorter) / longer)
    score = F.when(s == t, 1.0).when(s.contains(t) | t.contains(s), 0.7 + 0.3 * shorter / longer).otherwise(edited)
    return F.when((F.coalesce(n, F.lit(0)) == 0) | (F.coalesce(m, F.lit(0)) == 0), 0.0).otherwise(score)


#: Letters that sound the same wherever they stand, but for the contexts below.
_PLAIN = {"b": "B", "c": "K", "d": "T", "f": "F", "g": "K", "j": "J", "k": "K", "l": "L", "m": "M", "n": "N", "p": "P", "q": "K", "r": "R", "s": "S", "t": "T", "v": "F", "x": "KS", "z": "S"}
_VOWELS = ("a", "e", "i", "o", "u")


def metaphone(text: Column) -> Column:
    """The Metaphone code of a text, its words apart by spaces: each letter is coded by the two letters on either side of it.

    A first letter that is silent is dropped; of a doubled letter (but c) the last one counts; vowels count only at the start of a word.
    What isn't a letter from a to z is silent.
    """
    low = F.regexp_replace(F.lower(text), "^(?:(?=kn|gn|pn|wr)[kgpw]|a(?=e))", "")
    letters = F.split(low, "")
    n = F.size(letters)
    moved = lambda k: F.concat(F.array_repeat(F.lit(""), k), F.slice(letters, 1, F.greatest(n - k, F.lit(0))))
    ahead = lambda k: F.slice(letters, k + 1, F.greatest(n - k, F.lit(0)))
    places = F.arrays_zip(letters.alias("c"), moved(1).alias("b"), moved(2).alias("bb"), ahead(1).alias("d"), ahead(2).alias("dd"))
    coded = F.transform(F.filter(places, lambda z: z["c"].isNotNull()), _sound)
    return F.trim(F.regexp_replace(F.array_join(coded, ""), " +", " "))


def _sound(z: Column) -> Column:
    """The code of one letter: c, with b and bb before it and d and dd after it (empty or null beyond the ends)."""
    c, b, bb = z["c"], z["b"], z["bb"]
    d, dd = F.coalesce(z["d"], F.lit("")), F.coalesce(z["dd"], F.lit(""))
    first, soft = b == "", ("i", "e", "y")
    shun = (d == "i") & dd.isin("o", "a")
    rules = (
        ("every", (c == d) & (c != "c"), ""),
        ("aeiou", first | (b == " "), F.upper(c)), ("aeiou", F.lit(True), ""),
        ("c", (d == "h") | (d == "i") & (dd == "a"), "X"), ("c", d.isin(*soft), "S"),
        ("d", (d == "g") & dd.isin(*soft), "J"),
        ("g", (b == "d") & d.isin(*soft), ""), ("g", d.isin(*soft), "J"), ("g", (d == "h") & ~dd.isin(*_VOWELS), ""),
        ("h", b.isin("c", "p", "s", "t") | (b == "g") & ~d.isin(*_VOWELS) | (b == "w") & (bb == ""), ""), ("h", first | d.isin(*_VOWELS) | ~b.isin(*_VOWELS), "H"), ("h", F.lit(True), ""),
        ("k", b == "c", ""), ("p", d == "h", "F"), ("s", (d == "h") | shun, "X"),
        ("t", shun, "X"), ("t", d == "h", "0"), ("t", (d == "c") & (dd == "h"), ""),
        ("w", d.isin(*_VOWELS) | first & (d == "h"), "W"), ("w", F.lit(True), ""),
        ("x", first & ((d == "h") | shun), "X"), ("x", first, "S"),
        ("y", (b == "c") | (b == "g") & (bb == "d"), ""), ("y", d.isin(*_VOWELS), "Y"), ("y", F.lit(True), ""), (" ", F.lit(True), " "))
    out = None
    for letters, when, code in rules:
        test = when if letters == "every" else c.isin(*letters) & when
        code = code if isinstance(code, Column) else F.lit(code)
        out = F.when(test, code) if out is None else out.when(test, code)
    for letter, code in _PLAIN.items():
        out = out.when(c == letter, F.lit(code))
    return out.otherwise(F.lit(""))


#: What texts that sound alike may have in common.
PHONETIC_CODES = (F.soundex, metaphone)


def sounds(text: Column) -> Column:
    """The phonetic codes of a text, to be worked out once for each text where many pairs are scored."""
    return F.array(*[code(text) for code in PHONETIC_CODES])


def same_sounds(a: Column, b: Column) -> Column:
    """The share of the codes that are the same."""
    same = [F.coalesce((F.get(a, F.lit(i)) == F.get(b, F.lit(i))).cast("double"), F.lit(0.0)) for i in range(len(PHONETIC_CODES))]
    return sum(same[1:], same[0]) / len(same)


def phonetic_score(a: Column, b: Column) -> Column:
    """The mean of whether the texts have the same Soundex and the same Metaphone code."""
    return F.when((a == "") | (b == ""), 0.0).otherwise(same_sounds(sounds(a), sounds(b)))


def combined_match_score(similarity: Column, phonetic: Column, exact: Column, alias: Column) -> Column:
    return F.round(F.least(F.lit(1.0), 0.7 * similarity + 0.3 * phonetic + F.when(exact, 0.1).otherwise(0.0) + F.when(alias, 0.05).otherwise(0.0)), 3)


def containment_score(asked: Column, has: Column) -> Column:
    """1 if equal, 0.5 if one contains the other, else 0 (case aside); the score of brands and of categories."""
    a, b = F.lower(asked), F.lower(has)
    score = F.when(a == b, 1.0).when(a.contains(b) | b.contains(a), 0.5).otherwise(0.0)
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0).otherwise(score)


def quantity_score(size: Column, unit: Column, other_size: Column, other_unit: Column) -> Column:
    """1 if equal in base units, 0.5 within 10 %, else 0; different dimensions never match."""
    a, b = to_base_units(size, unit), to_base_units(other_size, other_unit)
    largest = F.greatest(a, b)
    off = F.abs(a - b) / F.when(largest > 0, largest)
    score = F.when(F.abs(a - b) <= 1e-9 * largest, 1.0).when(off <= 0.1, 0.5).otherwise(0.0)
    return F.coalesce(F.when(dimension(unit) == dimension(other_unit), score), F.lit(0.0))


def alias_score(terms: Column, aliases: Column) -> Column:
    """1 if a term contains or is contained in an alias."""
    low = lambda xs: F.filter(F.transform(F.coalesce(xs, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.exists(low(terms), lambda t: F.exists(low(aliases), lambda a: a.contains(t) | t.contains(a))).cast("double")


def final_score(parts: Mapping[str, Column], weights: Mapping[str, float] = WEIGHTS) -> Column:
    """The weighted mean of the parts, each held between 0 and 1; a missing part is 0."""
    total = sum(weights.values())
    out = F.lit(0.0)
    for name, weight in weights.items():
        if name in parts:
            out = out + weight / total * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(parts[name], F.lit(0.0))))
    return out


def reranked(score: Column, cutoff: float = 0.6) -> Column:
    """A rerank score, null below the cut-off: such a candidate is no match."""
    return F.when(score >= cutoff, score)


def fuzzy_rerank_score(a: Column, b: Column) -> Column:
    """The larger of plain and token-sorted edit similarity, 0 to 1; word order and repeats don't matter for the second."""
    sort = lambda c: F.array_join(F.array_sort(F.array_distinct(F.split(F.lower(F.trim(c)), r"\s+"))), " ")
    ratio = lambda x, y: F.try_divide(F.greatest(F.length(x), F.length(y)) - F.levenshtein(x, y), F.greatest(F.length(x), F.length(y)))
    return F.coalesce(F.greatest(ratio(F.lower(F.trim(a)), F.lower(F.trim(b))), ratio(sort(a), sort(b))), F.lit(0.0))
