"""The Spark session that the command line, the tests and the benchmark use."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(name: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` adds settings, with ``_`` for ``.``.

    Nanosecond timestamps of other writers are read as numbers (see ``sources.bundle``).
    """
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.legacy.parquet.nanosAsLong": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names (a temporary one if the setting is
    missing and the master is local)."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint in the shared folder."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, its columns and filters
    pushed into the scan, its size known to the joins that follow."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table that a join may send to all tasks, at most.
SENT_ROWS = 20_000


def joined(left: DataFrame, right: DataFrame, key: str, how: str = "inner", *, by: str | None = None) -> DataFrame:
    """``left`` joined with the stored table ``right``, which is sent to all tasks if it has at
    most ``SENT_ROWS`` rows; else both sides are dealt by the key, and the result by ``by``, if
    given. The size of files, by which Spark decides, says little: rows of few different values
    take many times as much in the driver that sends them."""
    if right.count() <= SENT_ROWS:
        return left.join(F.broadcast(right), key, how)
    found = left.join(right.hint("shuffle_hash"), key, how)
    return found.repartition(by) if by else found


#: Rows, about, that a task should hold at once where it groups, sorts or joins them.
TASK_ROWS = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of some ``rows`` rows, by ``keys`` over so many tasks that each has some
    ``TASK_ROWS`` of them, whatever the size of the input; groupings and windows by these keys
    and more need no other exchange."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)
