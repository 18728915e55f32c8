"""Marketplace trust: review statistics, credibility, bursts of reviews, seller search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trolley.operators.windows import assign_rank, best_per_key


def age_days(as_of: str, time: str) -> Column:
    """Whole days elapsed."""
    return F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col(time).cast("timestamp"))) / 86400)


def review_stats(sellers: DataFrame, reviews: DataFrame) -> DataFrame:
    stats = reviews.groupBy("seller_id").agg(F.avg("rating").alias("avg_rating"), F.count(F.lit(1)).alias("review_count"))
    return sellers.join(stats, "seller_id", "left").withColumns({"avg_rating": F.round(F.coalesce("avg_rating", F.lit(0.0)), 2), "review_count": F.coalesce("review_count", F.lit(0).cast("long"))})


def credibility_score(sellers: DataFrame, reviews: DataFrame, as_of: str) -> DataFrame:
    """Score from 0 to 5: rating 40 %, reviews 20 % (full at 50), tenure 20 % (slow decay after a year), verification 10 %, activity 10 % (none after 90 days).

    Without reviews only the verification status counts, on a scale of its own.
    """
    stats = reviews.groupBy("seller_id").agg(F.avg("rating").alias("avg"), F.count(F.lit(1)).alias("n"))
    df = sellers.join(stats, "seller_id", "left")
    status = F.coalesce("verification_status", F.lit("pending"))
    age, idle = age_days(as_of, "created_at"), age_days(as_of, "updated_at")
    tenure = F.least(F.lit(5.0), F.least(age, F.lit(365)) / 365 * 5) * F.when(age > 365, F.pow(F.lit(0.95), (age - 365) / 365)).otherwise(1.0)
    active = F.when(idle > 90, 0.0).otherwise(F.greatest(F.lit(0.0), 5.0 - idle / 30))
    verified = F.when(status == "verified", 5.0).when(status == "rejected", 0.0).otherwise(1.0)
    known = 0.4 * F.col("avg") + 0.2 * F.least(F.col("n") / 50 * 5, F.lit(5.0)) + 0.2 * tenure + 0.1 * verified + 0.1 * active
    new = F.when(status == "verified", 3.0).when(status == "rejected", 0.0).otherwise(1.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(5.0), F.when(F.coalesce("n", F.lit(0)) > 0, known).otherwise(new)))
    return df.withColumn("credibility_score", F.round(score, 6)).drop("avg", "n")


def review_bursts(reviews: DataFrame, as_of: str, days: int = 7, least: int = 5, share: float = 0.6) -> DataFrame:
    """Sellers with more than `least` reviews in the last days, more than `share` of them from reviewers with one review ever."""
    lifetime = reviews.groupBy("reviewer_id").agg(F.count(F.lit(1)).alias("lifetime"))
    recent = reviews.where(F.col("created_at") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))
    per = recent.join(lifetime, "reviewer_id").groupBy("seller_id").agg(F.count(F.lit(1)).alias("recent"), F.count_if(F.col("lifetime") == 1).alias("new_accounts"))
    return per.where((F.col("recent") > least) & (F.col("new_accounts") > share * F.col("recent")))


def flag_sellers(sellers: DataFrame, bursts: DataFrame, as_of: str) -> DataFrame:
    marked = sellers.join(bursts.select("seller_id", F.lit(True).alias("_burst")), "seller_id", "left")
    hit = F.coalesce("_burst", F.lit(False))
    return marked.withColumns({"is_flagged": hit, "flag_reason": F.when(hit, "review burst"), "flagged_at": F.when(hit, F.lit(as_of).cast("timestamp"))}).drop("_burst")


def visible_sellers(sellers: DataFrame) -> DataFrame:
    """Verified sellers who want to be found and aren't banned."""
    return sellers.where((F.col("verification_status") == "verified") & F.col("opted_in_visible") & ~F.coalesce("is_banned", F.lit(False)))


def find_sellers(sellers: DataFrame, term: str | None = None, town: str | None = None, category: str | None = None, k: int = 10) -> DataFrame:
    """The k most credible visible sellers whose name or description holds the term or who sell it, in towns that hold `town`, who sell `category`."""
    found = visible_sellers(sellers)
    holds = lambda c, text: F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
    sells = lambda what: F.coalesce(F.array_contains("categories", what), F.lit(False))
    if term:
        found = found.where(holds("display_name", term) | holds("description", term) | sells(term))
    if town:
        found = found.where(holds("town", town))
    if category:
        found = found.where(sells(category))
    return _most_credible(found, k)


def open_requests(requests: DataFrame, as_of: str) -> DataFrame:
    """Pending chat requests whose time hasn't run out."""
    return requests.where((F.col("status") == "pending") & (F.col("expires_at") > F.lit(as_of).cast("timestamp")))


def seller_topk(sellers: DataFrame, term: str, k: int = 10) -> DataFrame:
    return _most_credible(sellers.where(F.lower("display_name").contains(term.lower()) | (F.lower("town") == term.lower())), k)


def _most_credible(found: DataFrame, k: int) -> DataFrame:
    best = found.orderBy(F.col("credibility_score").desc(), "seller_id").limit(k)
    return assign_rank(best, [F.col("credibility_score").desc(), "seller_id"], rank="position")


def review_rate_limit(candidates: DataFrame, reviews: DataFrame, days: int = 30) -> DataFrame:
    """Candidates (seller_id, reviewer_id, at) without a review of the pair in the days before."""
    old = reviews.select(F.col("seller_id").alias("_s"), F.col("reviewer_id").alias("_r"), F.col("created_at").alias("_t"))
    near = (F.col("_s") == F.col("seller_id")) & (F.col("_r") == F.col("reviewer_id")) & (F.col("_t") < F.col("at")) & (F.col("_t") >= F.col("at") - F.make_dt_interval(F.lit(days)))
    return candidates.join(old, near, "left_anti")


def admit_ratings(submitted: DataFrame, sessions: DataFrame, reviews: DataFrame) -> DataFrame:
    """submitted (session_id, seller_id, reviewer_id, at) with its outcome; of a session's admitted ones the first stays admitted."""
    buyers = sessions.groupBy("session_id").agg(F.min("buyer_id").alias("buyer_id"))
    df = submitted.join(buyers, "session_id", "left")
    free = review_rate_limit(submitted, reviews).select("session_id", "seller_id", "reviewer_id", "at", F.lit(True).alias("_free")).distinct()
    df = df.join(free, ["session_id", "seller_id", "reviewer_id", "at"], "left")
    outcome = F.when(F.col("buyer_id").isNull(), "no session").when(F.col("buyer_id") != F.col("reviewer_id"), "not the buyer").when(F.col("_free").isNull(), "rate limited").otherwise("ok")
    df = df.withColumn("_outcome", outcome)
    first = best_per_key(df.where(F.col("_outcome") == "ok"), ["session_id"], ["at", "seller_id"]).select("session_id", F.col("at").alias("_at"), F.col("seller_id").alias("_seller"))
    df = df.join(first, "session_id", "left")
    done = (F.col("_outcome") == "ok") & ~((F.col("at") == F.col("_at")) & (F.col("seller_id") == F.col("_seller")))
    return df.select("session_id", "seller_id", "reviewer_id", "at", F.when(done, "already rated").otherwise(F.col("_outcome")).alias("outcome"))


def session_party_join(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Sessions of users as buyer or seller: two equi-joins rather than one on either."""
    u = users.select("user_id")
    as_buyer = sessions.join(u, sessions["buyer_id"] == u["user_id"]).withColumn("party", F.lit("buyer"))
    as_seller = sessions.join(u, sessions["seller_id"] == u["user_id"]).withColumn("party", F.lit("seller"))
    return as_buyer.unionByName(as_seller)
