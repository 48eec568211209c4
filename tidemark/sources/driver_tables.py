"""Star-schema tables as ranking logs, experiments and market panels.

``orders`` are impressions, ``lineitem`` their candidate parts, a returned line a click;
``events`` is a log of user activity; customers are units of an experiment; nations are
markets of a rollout. Every function takes (spark, folder) and returns a lazy DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import dealt


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """(article_id, title, subtitle, published_time, category, premium) from parts. Parts
    appear one every six hours, so the last ones appear after some impressions."""
    published = F.expr("timestampadd(HOUR, CAST(6 * (p_partkey % 6000) AS INT), TIMESTAMP_NTZ '1997-01-01 00:00:00')")
    return read(spark, folder, "part").select(
        F.col("p_partkey").alias("article_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("subtitle"),
        published.alias("published_time"),
        F.col("p_type").alias("category"),
        (F.col("p_retailprice") > 950.0).alias("premium"),
    )


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """One row per impression and article: the parts of an order in the order of their first
    line. (order, part) is made unique first; the window then sees one order at a time. Lines
    are dealt by order once, which serves the grouping, the window and the join."""
    table = read(spark, folder, "lineitem")
    lines = dealt(table.select("l_orderkey", "l_partkey", "l_returnflag", "l_linenumber"), table.count(), "l_orderkey").groupBy("l_orderkey", "l_partkey").agg(
        F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("label"), F.min("l_linenumber").alias("line")
    )
    slate = W.partitionBy("l_orderkey")
    placed = lines.select(
        F.col("l_orderkey").alias("impression_id"),
        F.col("l_partkey").alias("article_id"),
        "label",
        (F.row_number().over(slate.orderBy("line", "l_partkey")) - 1).alias("candidate_position"),
        F.count("*").over(slate).cast("int").alias("candidate_count"),
    )
    orders = read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("impression_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("impression_time"),
        F.col("o_orderpriority").alias("device_type"),
    )
    return placed.join(orders, "impression_id").select(
        "impression_id", "user_id", "impression_time", "article_id", "label", "candidate_position", "candidate_count", "device_type"
    )


def behaviors(spark: SparkSession, folder: str) -> DataFrame:
    """The impressions with their slates as lists."""
    rows = candidates(spark, folder).groupBy("impression_id", "user_id", "impression_time", "device_type").agg(
        F.array_sort(F.collect_list(F.struct("candidate_position", "article_id", "label"))).alias("slate")
    )
    return rows.select(
        "impression_id",
        "user_id",
        "impression_time",
        "device_type",
        F.col("slate.article_id").alias("article_ids_inview"),
        F.transform(F.filter("slate", lambda x: x["label"] == 1), lambda x: x["article_id"]).alias("article_ids_clicked"),
    )


def history(spark: SparkSession, folder: str, rows: DataFrame | None = None) -> DataFrame:
    """What every customer had ordered before 1999, oldest first. ``rows`` are the candidates,
    if they are at hand."""
    earlier = (candidates(spark, folder) if rows is None else rows).where(F.col("impression_time") < F.expr("TIMESTAMP_NTZ '1999-01-01 00:00:00'"))
    earlier = dealt(earlier.select("user_id", "impression_time", "impression_id", "candidate_position", "article_id"), read(spark, folder, "lineitem").count(), "user_id")
    rows = earlier.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("impression_time", "impression_id", "candidate_position", "article_id"))).alias("seen"))
    return rows.select("user_id", F.col("seen.article_id").alias("article_id_fixed"), F.col("seen.impression_time").alias("impression_time_fixed"))


def activity(spark: SparkSession, folder: str) -> DataFrame:
    """(user_id, impression_time) from the event log."""
    return read(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp_ntz").alias("impression_time"))


def experiment(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer with orders: odd keys are treated."""
    lines = read(spark, folder, "lineitem").select("l_orderkey", "l_returnflag", "l_extendedprice", "l_quantity")
    orders = read(spark, folder, "orders").select("o_orderkey", "o_custkey")
    per_unit = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(
        F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("any_return"),
        F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("return_rate"),
        F.avg("l_extendedprice").alias("price"),
        F.avg("l_quantity").alias("quantity"),
    )
    units = read(spark, folder, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return units.join(per_unit, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_custkey").alias("user_id"),
        F.when(F.col("c_custkey") % 2 == 1, "treatment").otherwise("control").alias("variant"),
        F.col("c_acctbal").alias("balance"),
        (F.col("return_rate") > 0.3).cast("int").alias("click"),
        "price",
        "quantity",
        F.col("c_mktsegment").alias("segment"),
    )


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """One row per nation and quarter from 1995 on: even nations are treated from 1999 on."""
    lines = read(spark, folder, "lineitem").select("l_orderkey", "l_returnflag")
    orders = read(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    nation = read(spark, folder, "customer").select("c_custkey", "c_nationkey")
    facts = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(nation, F.col("o_custkey") == F.col("c_custkey"))
    quarter = (F.year("o_orderdate") - 1999) * 4 + F.quarter("o_orderdate") - 1
    rows = facts.groupBy(F.col("c_nationkey").alias("market"), quarter.alias("period")).agg(
        F.count("*").alias("exposures"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("clicks")
    )
    treated = (F.col("market") % 2 == 0).cast("int")
    return rows.select(
        F.concat(F.lit("market_"), F.lpad(F.col("market").cast("string"), 3, "0")).alias("market_id"),
        F.col("period").cast("int").alias("relative_week"),
        treated.alias("treated_market"),
        (treated * (F.col("period") >= 0).cast("int")).alias("policy_active"),
        F.col("exposures").alias("candidate_exposures"),
        "clicks",
        (F.col("clicks") / F.col("exposures")).alias("ctr"),
        F.col("exposures").cast("double").alias("market_size_index"),
    )


#: The same tables in SQL that DuckDB reads, as common table expressions.
SQL = {
    "articles": """articles AS (
  SELECT p_partkey AS article_id, p_name AS title, p_brand AS subtitle,
    TIMESTAMP '1997-01-01 00:00:00' + to_hours(CAST(6 * (p_partkey % 6000) AS INTEGER)) AS published_time,
    p_type AS category, p_retailprice > 950.0 AS premium
  FROM part
)""",
    "candidates": """candidates AS (
  SELECT l_orderkey AS impression_id, o_custkey AS user_id, CAST(o_orderdate AS TIMESTAMP) AS impression_time, l_partkey AS article_id, label,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY line, l_partkey) - 1 AS INTEGER) AS candidate_position,
    CAST(count(*) OVER (PARTITION BY l_orderkey) AS INTEGER) AS candidate_count, o_orderpriority AS device_type
  FROM (SELECT l_orderkey, l_partkey, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS label, min(l_linenumber) AS line FROM lineitem GROUP BY ALL)
  JOIN orders ON o_orderkey = l_orderkey
)""",
    "history": """history AS (
  SELECT user_id, list(article_id ORDER BY impression_time, impression_id, candidate_position) AS article_id_fixed,
    list(impression_time ORDER BY impression_time, impression_id, candidate_position) AS impression_time_fixed
  FROM candidates WHERE impression_time < TIMESTAMP '1999-01-01 00:00:00' GROUP BY user_id
)""",
    "activity": "activity_log AS (SELECT user_id, CAST(ts AS TIMESTAMP) AS impression_time FROM events)",
    "experiment": """units AS (
  SELECT c_custkey AS user_id, CASE WHEN c_custkey % 2 = 1 THEN 'treatment' ELSE 'control' END AS variant, c_acctbal AS balance,
    CASE WHEN return_rate > 0.3 THEN 1 ELSE 0 END AS click, price, quantity, c_mktsegment AS segment
  FROM customer JOIN (
    SELECT o_custkey, avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS return_rate, avg(l_extendedprice) AS price, avg(l_quantity) AS quantity
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey
  ) ON o_custkey = c_custkey
)""",
    "panel": """panel AS (
  SELECT 'market_' || lpad(CAST(market AS VARCHAR), 3, '0') AS market_id, CAST(period AS INTEGER) AS relative_week,
    CASE WHEN market % 2 = 0 THEN 1 ELSE 0 END AS treated_market,
    CASE WHEN market % 2 = 0 AND period >= 0 THEN 1 ELSE 0 END AS policy_active,
    exposures AS candidate_exposures, clicks, clicks::DOUBLE / exposures AS ctr, exposures::DOUBLE AS market_size_index
  FROM (
    SELECT c_nationkey AS market, (year(o_orderdate) - 1999) * 4 + quarter(o_orderdate) - 1 AS period, count(*) AS exposures,
      CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS clicks
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
  )
)""",
}


def with_tables(*names: str) -> str:
    """``WITH`` and the named tables; a query, or more tables, may follow."""
    return "WITH " + ",\n".join(SQL[n] for n in names)
