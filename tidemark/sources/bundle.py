"""Ranking bundles: articles, behaviors and history as three lazy tables."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import ContractError
from tidemark.operators import candidates as C
from tidemark.sources import files

# Other names of columns, by table.
ALIASES = {
    "articles": {"published_at": "published_time", "category_id": "category", "is_premium": "premium"},
    "behaviors": {
        "article_id_inview": "article_ids_inview",
        "article_id_clicked": "article_ids_clicked",
        "timestamp": "impression_time",
        "is_subscriber_user": "is_subscriber",
    },
    "history": {"article_ids": "article_id_fixed", "article_ids_fixed": "article_id_fixed", "timestamps": "impression_time_fixed"},
}

TIMES = {"published_time", "impression_time"}


@dataclass(frozen=True)
class Bundle:
    articles: DataFrame
    behaviors: DataFrame
    history: DataFrame
    source_name: str


def canonical(df: DataFrame, table: str) -> DataFrame:
    """Aliased columns under their own name, where that is not taken."""
    for other, name in ALIASES[table].items():
        if other in df.columns and name not in df.columns:
            df = df.withColumnRenamed(other, name)
    return df


def naive_times(df: DataFrame) -> DataFrame:
    """Time columns as timestamps without zone. Nanosecond Parquet arrives as whole numbers
    (``spark.sql.legacy.parquet.nanosAsLong``), text is parsed strictly."""

    def fixed(name: str, kind: T.DataType):
        c = F.col(f"`{name}`")
        if isinstance(kind, T.LongType):
            return F.timestamp_micros(F.expr(f"`{name}` div 1000")).cast("timestamp_ntz")
        return c.cast("timestamp_ntz")

    out = df
    for f in df.schema.fields:
        if f.name in TIMES and not isinstance(f.dataType, T.TimestampNTZType):
            out = out.withColumn(f.name, fixed(f.name, f.dataType))
        elif f.name == "impression_time_fixed" and isinstance(f.dataType, T.ArrayType):
            if isinstance(f.dataType.elementType, T.LongType):
                out = out.withColumn(f.name, F.transform(f.name, lambda x: F.timestamp_micros((x / 1000).cast("bigint")).cast("timestamp_ntz")))
            else:
                out = out.withColumn(f.name, F.col(f.name).cast("array<timestamp_ntz>"))
    return out


def load_bundle(spark: SparkSession, path: str, *, split: str = "train", check: bool = True) -> Bundle:
    """Articles from ``path``, behaviors and history from its folder ``split`` (or from
    ``path`` itself without one), renamed, typed and audited."""
    root = path.rstrip("/")
    inner = f"{root}/{split}" if files.exists(spark, f"{root}/{split}") else root
    places = {"articles": f"{root}/articles.parquet", "behaviors": f"{inner}/behaviors.parquet", "history": f"{inner}/history.parquet"}
    missing = [p for p in places.values() if not files.exists(spark, p)]
    if missing:
        raise ContractError(f"missing dataset files: {', '.join(missing)}")
    source = "ebnerd"
    if files.exists(spark, f"{root}/dataset.json"):
        try:
            source = str(json.loads(files.read_text(spark, f"{root}/dataset.json"))["source"])
        except (ValueError, KeyError, TypeError) as bad:
            raise ContractError(f"dataset.json cannot be read: {bad}") from None
    tables = {name: naive_times(canonical(spark.read.parquet(p), name)) for name, p in places.items()}
    bundle = Bundle(**tables, source_name=f"{source}:{split}")
    if check:
        C.audit(bundle.behaviors, bundle.articles, bundle.history)
    return bundle
