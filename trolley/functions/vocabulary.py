"""Vocabularies of any size as tables, and texts searched for all their terms at once.

A vocabulary has rows kind, term, rank. Its terms are laid out as a trie of tokens: a table of edges from a prefix, by a token, to a
longer prefix. Texts are walked level by level: tokens join the edges from the root, the places that are left join the next edges, and so on, so
a text costs one join with the first tokens and little more, whether there are ten terms or a million. Nothing that grows with the texts is broadcast. Tokens are runs of letters, digits and _, or
one other character; white space counts as one space. A term is found where its tokens stand, so never inside a word.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trolley.sources.tables import SMALL_ROWS, stored

TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]"
VOCABULARY = "kind string, term string, rank long"


def scan_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """kind, term, rank from JSON lines of them: lower case, single spaces, the least rank of a term that repeats; terms without a word go."""
    return vocabulary(spark.read.schema(VOCABULARY).json(path))


def vocabulary(rows: DataFrame) -> DataFrame:
    clean = rows.select("kind", squeezed(F.col("term")).alias("term"), "rank").where(F.col("term").rlike(r"[\p{L}\p{N}_]"))
    return clean.groupBy("kind", "term").agg(F.min("rank").alias("rank"))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def trie(words: DataFrame) -> tuple[DataFrame, int]:
    """(edges: level, parent, token, node, and ends, whether a term ends there; number of levels). Nodes are named by their prefix."""
    each = words.select("term").distinct().select(tokens(F.col("term")).alias("t"))
    levels = each.agg(F.max(F.size("t"))).first()[0] or 0
    steps = each.select("t", F.posexplode("t").alias("level", "token"))
    edges = steps.select("level", F.array_join(F.slice("t", F.lit(1), F.col("level")), "").alias("parent"), "token",
                         F.array_join(F.slice("t", F.lit(1), F.col("level") + 1), "").alias("node"), (F.col("level") + 1 == F.size("t")).alias("ends"))
    return stored(edges.groupBy("level", "parent", "token", "node").agg(F.max("ends").alias("ends")), "trie"), levels


def find_places(texts: DataFrame, key: str, text: str, words: DataFrame, starts: bool = False) -> DataFrame:
    """key, at (number of its first token), start if asked for (characters of the squeezed text), term of every place of every term.

    Levels with few edges follow each other within a task; a level with many is a join by key, and what it leaves is stored.
    """
    edges, levels = trie(words)
    sizes = {r["level"]: r["n"] for r in edges.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a level
    rows = texts.select(F.col(key).alias("key"), tokens(squeezed(F.col(text))).alias("t"))
    start = F.lit(0).cast("long")
    if starts:
        rows = rows.withColumn("starts", _starts(F.transform("t", F.length)))
        start = F.col("starts")
    # what may follow a token goes with it, so that no level needs the text again
    ahead = F.transform("t", lambda token, i: F.struct(i.alias("at"), (F.get(start, i) if starts else start).alias("start"), F.slice("t", i + 1, max(1, levels)).alias("rest")))
    places = rows.select("key", F.explode(ahead).alias("p")).select("key", "p.at", "p.start", "p.rest", F.lit("").alias("parent"))
    found, level = None, 0
    while level < levels:
        ends, first = [], level
        while level < levels and (level == first or sizes[first] <= SMALL_ROWS >= sizes[level]):
            step = edges.where(F.col("level") == level).select(F.col("parent").alias("_from"), F.col("token").alias("_token"), F.col("node").alias("_node"), F.col("ends").alias("_ends"))
            step = F.broadcast(step) if sizes[level] <= SMALL_ROWS else step.hint("merge")
            met = (F.col("parent") == F.col("_from")) & (F.get("rest", F.lit(level)) == F.col("_token"))
            places = places.join(step, met, "inner" if level == first else "left").withColumns({"parent": F.col("_node"), f"_term{level}": F.when(F.col("_ends"), F.col("_node"))})
            places = places.drop("_from", "_token", "_node", "_ends")
            ends.append(f"_term{level}")
            level += 1
        if level < levels:
            places = stored(places, "trie-places")
        terms = F.filter(F.array(*ends), lambda term: term.isNotNull())
        part = places.select("key", "at", "start", F.explode(terms).alias("term"))
        found = part if found is None else found.unionByName(part)
        places = places.where("parent is not null").drop(*ends)
    if found is None:
        found = rows.select("key", F.lit(0).alias("at"), F.lit(0).cast("long").alias("start"), F.lit("").alias("term")).where("false")
    return found.select(F.col("key").alias(key), "at", *(["start"] if starts else []), "term")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _starts(lengths: pd.Series) -> pd.Series:
    """The sum of the lengths before each one."""
    return lengths.map(lambda n: None if n is None else np.cumsum(n) - n)


def find_terms(texts: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """key, kind, term, rank, start, end (characters of the squeezed text) of every place of every term. Keys are different."""
    placed = find_places(texts, key, text, words, starts=True)
    named = placed.join(_joined(stored(words, "vocabulary")), "term")
    return named.select(key, "kind", "term", "rank", "start", (F.col("start") + F.length("term")).alias("end"))


def _joined(df: DataFrame) -> DataFrame:
    """A stored table to join: to all tasks if it is small, else by key; its file says too little of its size in memory."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df.hint("merge")


def brand_and_category(texts: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """key, brand, category, subcategory of each text, from the kinds brand and category of a vocabulary.

    brand: the first in the text, of those at one place the longest. category: the longest, of those the one with the least rank; subcategory: the
    one with the least rank that doesn't hold the category and isn't held by it. Null where there is none.
    """
    hits = find_terms(texts, key, text, words)
    brand = F.min_by(F.when(F.col("kind") == "brand", F.col("term")), F.when(F.col("kind") == "brand", F.struct("start", -F.length("term"))))
    kinds = F.array_sort(F.collect_set(F.when(F.col("kind") == "category", F.struct("rank", "term"))))  # terms of one text
    each = hits.groupBy(key).agg(brand.alias("brand"), kinds.alias("kinds"))
    best = F.element_at(F.array_sort(F.transform("kinds", lambda k: F.struct((-F.length(k["term"])).alias("n"), k["rank"].alias("rank"), k["term"].alias("term")))), 1)["term"]
    each = each.withColumn("category", F.when(F.size("kinds") > 0, best))
    other = F.filter("kinds", lambda k: ~k["term"].contains(F.col("category")) & ~F.col("category").contains(k["term"]))
    each = each.select(F.col(key).alias("of"), "brand", "category", F.when(F.size(other) > 0, F.get(other, F.lit(0))["term"]).alias("subcategory"))
    return texts.select(key).join(each.hint("merge"), F.col(key) == F.col("of"), "left").drop("of")
