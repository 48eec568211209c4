"""The five product-analytics tables over analytics candidates.

Each is one pass over its input: branches that read as unions are one aggregation and an
unpivot, or one explode of labelled values before one grouping. Distinct counts are steps of
plain groupings, by impression and user first, then by user: every step keeps counts that add
up, and no row is multiplied for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import dealt, stored


def _ratio(a: Column, b: Column) -> Column:
    return a.cast("double") / F.nullif(b, F.lit(0)).cast("double")


def _by_impression(candidates: DataFrame) -> DataFrame:
    """The rows, stored for their number, dealt by impression over tasks of bounded rows."""
    rows = stored(candidates)
    return dealt(rows, rows.count(), "impression_id")


def exposure_totals(candidates: DataFrame) -> DataFrame:
    """One row: distinct ``impressions`` and ``users``, ``candidates``, ``clicks`` and
    ``mean_candidates``. An impression with several users counts once, for its first."""
    own = candidates.groupBy("impression_id", "user_id").agg(
        F.count("*").alias("n"), F.sum("label").alias("clicks"), F.sum(F.col("candidate_count").cast("double")).alias("slates"), F.count("candidate_count").alias("sized")
    )
    once = (F.row_number().over(W.partitionBy("impression_id").orderBy("user_id")) == 1) & F.col("impression_id").isNotNull()
    users = own.withColumn("once", once).groupBy("user_id").agg(F.count_if("once").alias("impressions"), *[F.sum(c).alias(c) for c in ("n", "clicks", "slates", "sized")])
    return users.agg(
        F.coalesce(F.sum("impressions"), F.lit(0)).alias("impressions"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("candidates"),
        F.sum("clicks").cast("bigint").alias("clicks"),
        F.count("user_id").alias("users"),
        (F.sum("slates") / F.nullif(F.sum("sized"), F.lit(0))).alias("mean_candidates"),
    )


def kpi_summary(candidates: DataFrame) -> DataFrame:
    """One row: impressions, candidates, clicks, ctr, active users, mean slate size."""
    totals = exposure_totals(candidates)
    return totals.select("impressions", "candidates", "clicks", _ratio(F.col("clicks"), F.col("candidates")).alias("ctr"), F.col("users").alias("active_users"), "mean_candidates")


def exposure_funnel(candidates: DataFrame) -> DataFrame:
    """Users, impressions, candidates and clicks, each with its rate from the stage before."""
    totals = exposure_totals(candidates)
    steps = [("active_users", "users", None), ("impressions", "impressions", "users"), ("candidates", "candidates", "impressions"), ("clicks", "clicks", "candidates")]
    stages = F.array(
        *[F.struct(F.lit(name).alias("stage"), F.col(c).alias("units"), (F.lit(1.0) if before is None else _ratio(F.col(c), F.col(before))).alias("rate_from_previous")) for name, c, before in steps]
    )
    return totals.select(F.posexplode(stages).alias("stage_order", "s")).orderBy("stage_order").select("s.stage", "s.units", "s.rate_from_previous")


def count_bucket(c: Column) -> Column:
    return F.when(c <= 5, "01-05").when(c <= 10, "06-10").otherwise("11+")


def history_bucket(c: Column) -> Column:
    return F.when(c == 0, "0").when(c <= 3, "1-3").when(c <= 9, "4-9").otherwise("10+")


def freshness_bucket(days: Column) -> Column:
    return F.when(days < 1, "<1d").when(days < 7, "1-7d").otherwise("7d+")


def segment_kpis(candidates: DataFrame, *, min_cell_count: int | None = None) -> DataFrame:
    """Impressions, candidates, clicks and ctr by device, position, slate size, history and
    freshness; ``low_support`` with ``min_cell_count``. One scan: rows are added up by
    impression, by position apart from the other four, whose values an impression's rows
    mostly share; only those sums are turned into cells."""
    values = {
        "device_type": F.coalesce(F.col("device_type").cast("string"), F.lit("unknown")),
        "candidate_count": count_bucket(F.col("candidate_count")),
        "history_length": history_bucket(F.col("history_length")),
        "freshness": freshness_bucket(F.col("article_age_days")),
    }
    both = F.explode(F.array(F.lit(True), F.lit(False)))
    rows = _by_impression(candidates.select("impression_id", "label", F.col("candidate_position").alias("position"), *[v.alias(n) for n, v in values.items()])).withColumn("placed", both)
    apart = rows.select("impression_id", "label", "placed", F.when(F.col("placed"), F.col("position")).alias("position"), *[F.when(~F.col("placed"), F.col(n)).alias(n) for n in values])
    sums = apart.groupBy("impression_id", "placed", "position", *values).agg(F.count("*").alias("n"), F.sum("label").alias("c"))
    cell = lambda name, value: F.struct(F.lit(name).alias("segment"), value.alias("value"))
    place = F.array(cell("candidate_position", F.col("position").cast("string")))
    cells = F.explode(F.when(F.col("placed"), place).otherwise(F.array(*[cell(n, F.col(n)) for n in values])))
    units = sums.select("impression_id", "n", "c", cells.alias("x")).groupBy("impression_id", "x.segment", "x.value").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    out = units.groupBy("segment", "value").agg(F.count("impression_id").alias("units"), F.sum("n").alias("candidates"), F.sum("c").cast("bigint").alias("clicks"))
    out = out.withColumn("ctr", _ratio(F.col("clicks"), F.col("candidates")))
    if min_cell_count is not None:
        out = out.withColumn("low_support", F.col("units") < min_cell_count)
    return out.orderBy("segment", "value")


def data_quality(candidates: DataFrame) -> DataFrame:
    """(metric, numeric_value, text_value): 16 counts, null rates and the time range, from one
    scan: rows are added up by impression, article and user, those sums by impression, and so
    on, so that what is distinct is a count of groups."""
    rates = ["impression_id", "user_id", "article_id", "impression_time", "published_time", "label"]
    flags = {
        "invalid_label_rows": F.col("label").isNull() | ~F.col("label").isin(0, 1),
        "missing_article_metadata": F.col("published_time").isNull(),
        "future_article_rows": F.col("published_time") > F.col("impression_time"),
        **{f"null_{c}_rate": F.col(c).isNull() for c in rates[3:]},
    }
    keys = [f"null_{c}_rate" for c in rates[:3]]  # those of the groups' own columns follow from their counts
    ends = {"low": (F.min, "candidate_count"), "high": (F.max, "candidate_count"), "from": (F.min, "impression_time"), "to": (F.max, "impression_time")}
    dealt_rows = _by_impression(candidates.select("article_id", "user_id", "candidate_count", *[c for c in rates if c not in ("user_id", "article_id")]))
    own = dealt_rows.groupBy("impression_id", "article_id", "user_id").agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in flags.items()], *[f(c).alias(k) for k, (f, c) in ends.items()])
    own = own.withColumns({f"null_{c}_rate": F.when(F.col(c).isNull(), F.col("n")).otherwise(0) for c in rates[:3]})
    flags |= dict.fromkeys(keys)
    merged = [F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in flags], *[f(k).alias(k) for k, (f, _) in ends.items()]]
    # Pairs of an impression and an article, null a value of its own, are those that come first
    # in order; an impression's row counts whatever users it has.
    slate = W.partitionBy("impression_id")
    before = F.lag(F.struct("article_id")).over(slate.orderBy("article_id", "user_id"))
    own = own.withColumn("pair", ~before.eqNullSafe(F.struct("article_id")))
    users = own.groupBy("impression_id", "user_id").agg(F.count_if("pair").alias("pairs"), *merged)
    first = F.row_number().over(slate.orderBy("user_id")) == 1
    whole = [F.sum("n").over(slate).alias("slate_n"), F.min("low").over(slate).alias("slate_low"), F.max("high").over(slate).alias("slate_high"), first.alias("first")]
    users = users.select("*", *whole)
    wrong = F.col("first") & ((F.col("slate_n") != F.col("slate_low")) | (F.col("slate_low") != F.col("slate_high")))
    by_user = users.groupBy("user_id").agg(
        F.sum("pairs").alias("pairs"), F.count_if(F.col("first") & F.col("impression_id").isNotNull()).alias("impressions"), F.count_if(wrong).alias("wrong"), *merged
    )
    total = by_user.agg(F.count("user_id").alias("users"), F.sum("pairs").alias("pairs"), F.sum("impressions").alias("impressions"), F.sum("wrong").alias("wrong"), *merged)
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = total.select(
        none("n").alias("candidate_rows"),
        none("impressions").alias("impression_rows"),
        F.col("users").alias("unique_users"),
        (none("n") - none("pairs")).alias("duplicate_impression_article"),
        *[none(k).alias(k) for k in flags if not k.endswith("_rate")],
        *[(F.col(k) / F.nullif(F.col("n"), F.lit(0))).alias(k) for k in flags if k.endswith("_rate")],
        F.col("from").cast("string").alias("min_impression_time"),
        F.col("to").cast("string").alias("max_impression_time"),
        none("wrong").alias("impression_candidate_count_mismatch"),
    )
    text = {"min_impression_time", "max_impression_time"}
    cells = [
        F.struct(
            F.lit(c).alias("metric"),
            (F.lit(None).cast("double") if c in text else F.col(c).cast("double")).alias("numeric_value"),
            (F.col(c) if c in text else F.lit(None).cast("string")).alias("text_value"),
        )
        for c in both.columns
    ]
    return both.select(F.explode(F.array(*cells)).alias("m")).select("m.*").orderBy("metric")


def user_cohorts(activity: DataFrame) -> DataFrame:
    """Weekly retention: users by the (Monday) week of their first activity and the weeks
    since; empty if there is only one week. Null users count in a cohort's size and are in
    no retained count, as the inner join has it."""
    weeks = activity.select("user_id", F.date_trunc("week", F.col("impression_time").cast("timestamp")).cast("date").alias("activity_week")).distinct()
    span = weeks.agg(F.count_distinct("activity_week").alias("weeks"))
    eligible = weeks.crossJoin(F.broadcast(span)).where("weeks >= 2").drop("weeks")  # span is one row
    cohort = eligible.groupBy("user_id").agg(F.min("activity_week").alias("cohort_week"))
    sizes = cohort.groupBy("cohort_week").agg(F.count("*").alias("cohort_users"))
    retained = (
        eligible.join(cohort, "user_id")
        .groupBy("cohort_week", (F.datediff("activity_week", "cohort_week") / 7).cast("bigint").alias("week_offset"))
        .agg(F.count("user_id").alias("active_users"))
    )
    out = retained.join(sizes, "cohort_week")
    return out.select(F.col("cohort_week").cast("string").alias("cohort_week"), "week_offset", "cohort_users", "active_users", _ratio(F.col("active_users"), F.col("cohort_users")).alias("retention_rate")).orderBy(
        "cohort_week", "week_offset"
    )
