"""Candidate rows of impression logs: expansion, audit, temporal split, analytics columns.

A candidate row is one article of one impression's slate; ``(impression_id,
candidate_position)`` is its key and its order everywhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tidemark.errors import ContractError

REQUIRED = {
    "articles": ["article_id", "category", "premium", "published_time", "subtitle", "title"],
    "behaviors": ["article_ids_clicked", "article_ids_inview", "impression_id", "impression_time", "user_id"],
    "history": ["article_id_fixed", "user_id"],
}


def require(df: DataFrame, columns: list[str], table: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ContractError(f"{table} is missing required columns: {', '.join(missing)}")


def expand_candidates(behaviors: DataFrame) -> DataFrame:
    """One row per in-view article with its 0-based ``candidate_position``, the slate's
    ``candidate_count`` and ``label`` 1 if the article is among the row's clicks. A missing
    slate is an error of the job; an empty one has no rows."""
    require(behaviors, REQUIRED["behaviors"], "behaviors")
    clicked = F.exists("article_ids_clicked", lambda x: x.eqNullSafe(F.col("article_id")))
    missing = F.raise_error(F.concat(F.lit("no in-view list in impression "), F.coalesce(F.col("impression_id").cast("string"), F.lit("null"))))
    slate = F.when(F.col("article_ids_inview").isNotNull(), F.col("article_ids_inview")).otherwise(missing.cast(behaviors.schema["article_ids_inview"].dataType))
    rows = behaviors.select("*", F.posexplode(slate).alias("candidate_position", "article_id"))
    rows = rows.withColumn("label", F.coalesce(clicked, F.lit(False)).cast("int")).withColumn("candidate_count", F.size("article_ids_inview"))
    return rows.drop("article_ids_inview", "article_ids_clicked")


def expand_scoring_candidates(behaviors: DataFrame) -> DataFrame:
    """Candidate rows without labels. Empty input, empty slates and slates that repeat an
    article are errors."""
    require(behaviors, [c for c in REQUIRED["behaviors"] if c != "article_ids_clicked"], "behaviors")
    slate = F.col("article_ids_inview")
    bad = behaviors.agg(
        F.count("*").alias("rows"),
        F.count_if(F.coalesce(F.size(slate), F.lit(0)) < 1).alias("empty"),
        F.count_if(F.size(F.array_distinct(slate)) < F.size(slate)).alias("repeats"),
    ).first()
    if not bad["rows"]:
        raise ContractError("behaviors must not be empty")
    if bad["empty"]:
        raise ContractError("article_ids_inview must not be empty")
    if bad["repeats"]:
        raise ContractError("article_ids_inview contains duplicate articles")
    rows = behaviors.select("*", F.posexplode(slate).alias("candidate_position", "article_id"))
    return rows.withColumn("candidate_count", F.size("article_ids_inview")).drop("article_ids_inview", "article_ids_clicked")


#: Microseconds.
DAY, SECOND = 86_400_000_000, 1_000_000


def _reach(counts: list[tuple[int, int]], wanted: int) -> tuple[int, int]:
    """The bucket in which the ``wanted``-th comes, and how far into it."""
    for bucket, n in counts:
        if n >= wanted:
            return bucket, wanted
        wanted -= n
    raise ValueError("fewer than wanted")


def temporal_split(candidates: DataFrame, *, valid_fraction: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(train, valid) by whole timestamps: of n distinct times the last
    ``ceil(n * valid_fraction)``, at least one and not all, are for validation. The cutoff is
    found by counting distinct times by day, then by second of its day, then in that second,
    so no task sorts and the driver sees counts of bounded number."""
    if not 0 < valid_fraction < 1:
        raise ContractError("valid_fraction must be between zero and one")
    times = candidates.select("impression_time", F.unix_micros(F.col("impression_time").cast("timestamp")).alias("micros")).where(F.col("micros").isNotNull()).distinct().persist(StorageLevel.MEMORY_AND_DISK)

    def counts(width: int, low: int | None = None, high: int | None = None) -> list[tuple[int, int]]:
        here = times if low is None else times.where(F.col("micros").between(low, high))
        bucket = F.floor(F.col("micros") / F.lit(width)).cast("bigint") if width > 1 else F.col("micros")
        found = here.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).collect()
        return sorted(((r["bucket"], r["n"]) for r in found), reverse=True)

    days = counts(DAY)
    n = sum(k for _, k in days)
    if n < 2:
        raise ContractError("temporal split requires at least two distinct impression times")
    v = min(n - 1, max(1, math.ceil(n * valid_fraction)))
    day, left = _reach(days, v)
    second, left = _reach(counts(SECOND, day * DAY, day * DAY + DAY - 1), left)
    micros, _ = _reach(counts(1, second * SECOND, second * SECOND + SECOND - 1), left)
    cutoff = times.where(F.col("micros") == micros).agg(F.min("impression_time")).first()[0]
    times.unpersist()
    limit = F.lit(cutoff).cast(candidates.schema["impression_time"].dataType)
    return candidates.where(F.col("impression_time") < limit), candidates.where(F.col("impression_time") >= limit)


#: Kinds of violations in the order in which they are reported.
CHECKS = ["duplicate_impression", "duplicate_article", "empty_slate", "duplicate_in_slate", "click_outside_slate", "unknown_article", "future_article"]

MESSAGES = {
    "duplicate_impression": "behaviors contains duplicate impression {0}",
    "duplicate_article": "articles contains duplicate article {1}",
    "empty_slate": "impression {0} has no in-view articles",
    "duplicate_in_slate": "impression {0} has duplicate in-view articles",
    "click_outside_slate": "impression {0} has clicked articles not present in article_ids_inview",
    "unknown_article": "impression {0} references unknown article {1}",
    "future_article": "article {1} was published after impression {0}",
}


def violations(behaviors: DataFrame, articles: DataFrame) -> DataFrame:
    """(check, impression_id, article_id): every violation of the data contract. One scan of
    the impressions serves the row checks, one exploded join the catalogue checks."""
    none = F.lit(None).cast(articles.schema["article_id"].dataType)
    no_impression = F.lit(None).cast(behaviors.schema["impression_id"].dataType)
    repeated = behaviors.groupBy("impression_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_impression").alias("check"), "impression_id", none.alias("article_id"))
    twice = articles.groupBy("article_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_article").alias("check"), no_impression.alias("impression_id"), "article_id")
    slate = F.coalesce("article_ids_inview", F.array().cast(behaviors.schema["article_ids_inview"].dataType))
    outside = F.array_except(F.coalesce("article_ids_clicked", F.array().cast(behaviors.schema["article_ids_clicked"].dataType)), slate)

    def found(name: str, condition: Column) -> Column:
        return F.when(condition, F.lit(name))

    rows = behaviors.select(
        "impression_id",
        F.explode(
            F.array_compact(
                F.array(
                    found("empty_slate", F.size(slate) == 0),
                    found("duplicate_in_slate", F.size(F.array_distinct(slate)) < F.size(slate)),
                    found("click_outside_slate", F.size(outside) > 0),
                )
            )
        ).alias("check"),
    ).select("check", "impression_id", none.alias("article_id"))
    shown = behaviors.select("impression_id", "impression_time", F.explode(F.array_distinct(slate)).alias("article_id"))
    known = articles.select("article_id", "published_time", F.lit(True).alias("known")).dropDuplicates(["article_id"])
    joined = shown.join(known, "article_id", "left").select(
        F.when(F.col("known").isNull(), "unknown_article").when(F.col("published_time") > F.col("impression_time"), "future_article").alias("check"), "impression_id", "article_id"
    )
    return repeated.unionByName(twice).unionByName(rows).unionByName(joined.where(F.col("check").isNotNull()))


def audit_summary(behaviors: DataFrame) -> DataFrame:
    """One row: users, impressions, candidates, clicks and the time range."""
    return behaviors.agg(
        F.count_distinct("user_id").alias("users"),
        F.count("*").alias("impressions"),
        F.coalesce(F.sum(F.size("article_ids_inview")), F.lit(0)).cast("bigint").alias("candidates"),
        F.coalesce(F.sum(F.size("article_ids_clicked")), F.lit(0)).cast("bigint").alias("clicks"),
        F.min("impression_time").alias("min_time"),
        F.max("impression_time").alias("max_time"),
    )


def audit(behaviors: DataFrame, articles: DataFrame, history: DataFrame) -> dict:
    """The summary of a bundle that meets the contract; the first violation is an error."""
    for name, df in (("articles", articles), ("behaviors", behaviors), ("history", history)):
        require(df, REQUIRED[name], name)
    order = F.array_position(F.array(*[F.lit(c) for c in CHECKS]), F.col("check"))
    first = violations(behaviors, articles).withColumn("order", order).orderBy("order", "impression_id", "article_id").limit(1).collect()
    summary = audit_summary(behaviors).first()
    if not summary["impressions"]:
        raise ContractError("behaviors must not be empty")
    if first:
        raise ContractError(MESSAGES[first[0]["check"]].format(first[0]["impression_id"], first[0]["article_id"]))
    nulls = behaviors.agg(F.count_if(F.col("impression_time").isNull())).first()[0] + articles.agg(F.count_if(F.col("published_time").isNull())).first()[0]
    if nulls:
        raise ContractError("timestamps must not be null")
    if history.where(F.col("article_id_fixed").isNull()).limit(1).count():
        raise ContractError("history.article_id_fixed must contain lists")
    out = summary.asDict()
    return {
        "users": out["users"],
        "impressions": out["impressions"],
        "candidates": out["candidates"],
        "clicks": out["clicks"],
        "articles": articles.count(),
        "min_impression_time": out["min_time"].isoformat(),
        "max_impression_time": out["max_time"].isoformat(),
    }


def with_articles(candidates: DataFrame, articles: DataFrame) -> DataFrame:
    """Candidates with article columns, ``article_age_days`` (signed) and ``device_type``
    (``unknown`` if missing). An article that is listed twice is an error of the job."""
    facts = F.struct("published_time", "category", "premium")
    catalogue = articles.groupBy("article_id").agg(F.count("*").alias("n"), F.first(facts).alias("article"))
    kind = catalogue.schema["article"].dataType
    once = F.when(F.col("n") == 1, F.col("article")).otherwise(F.raise_error(F.concat(F.lit("articles lists twice: "), F.col("article_id").cast("string"))).cast(kind))
    catalogue = catalogue.select("article_id", once.alias("article")).select("article_id", "article.*")
    age = (F.unix_micros(F.col("impression_time").cast("timestamp")) - F.unix_micros(F.col("published_time").cast("timestamp"))) / 86_400_000_000
    device = F.col("device_type") if "device_type" in candidates.columns else F.lit("unknown")
    return candidates.join(catalogue, "article_id", "left").withColumns({"article_age_days": age, "device_type": device})


def analytics_candidates(candidates: DataFrame, articles: DataFrame, history: DataFrame) -> DataFrame:
    """``with_articles`` and ``history_length`` (the longest list of the user, 0 without one).
    Spark broadcasts the smaller sides where their size allows it."""
    lengths = history.groupBy("user_id").agg(F.max(F.size("article_id_fixed")).alias("history_length"))
    joined = with_articles(candidates, articles).join(lengths, "user_id", "left")
    return joined.withColumn("history_length", F.coalesce("history_length", F.lit(0)))
