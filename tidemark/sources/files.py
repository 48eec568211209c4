"""Small files and folders through Hadoop's file systems, so any store that Spark reads works."""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def read_text(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise OSError(f"no such file: {path}")
    rows = spark.read.format("binaryFile").load(path).select("content").collect()
    return bytes(rows[0][0]).decode()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, where = _at(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    fs, where = _at(spark, source)
    if not fs.rename(where, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"could not rename {source} to {target}")


def plain(value):
    """JSON-ready: numpy scalars and times as Python values, NaN an error."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if hasattr(value, "item"):
        value = value.item()
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def canonical(value):
    """Numbers rounded to 10 places without negative zero, at every depth."""
    if isinstance(value, dict):
        return {k: canonical(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [canonical(v) for v in value]
    return round(value, 10) + 0.0 if isinstance(value, float) and math.isfinite(value) else value


def to_json(value) -> str:
    return json.dumps(plain(value), indent=2, sort_keys=True, allow_nan=False) + "\n"


@contextmanager
def published(spark: SparkSession, output: str, artifacts: set[str] | None = None) -> Iterator[str]:
    """A staging folder beside ``output`` that becomes it in one rename; on any error, or if
    the files are not exactly ``artifacts``, nothing is left. An existing output is an error."""
    output = output.rstrip("/")
    if exists(spark, output):
        raise ValueError(f"output already exists: {output}")
    staging = f"{output}.staging-{uuid.uuid4().hex}"
    fs, where = _at(spark, staging)
    fs.mkdirs(where)
    try:
        yield staging
        if artifacts is not None:
            found = {s.getPath().getName() for s in fs.listStatus(where)}
            found = {f for f in found if not f.endswith(".crc")}
            if found != artifacts:
                raise RuntimeError(f"unexpected artifacts: {sorted(found ^ artifacts)}")
        rename(spark, staging, output)
    except BaseException:
        fs.delete(where, True)
        raise


def fingerprint(spark: SparkSession, path: str) -> str:
    """SHA-256 over the sorted (relative path, size, content hash) of a folder's Parquet and
    JSON files. Contents are hashed by the executors, in parallel."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    wanted = files.where(F.col("path").rlike(r"\.(parquet|json)$")).select("path", "length", F.sha2("content", 256).alias("sha"))
    root = _at(spark, path)[1].toUri().getPath().rstrip("/")
    rows = sorted((r["path"].partition(root)[2].lstrip("/"), r["length"], r["sha"]) for r in wanted.collect())
    total = hashlib.sha256()
    for name, size, sha in rows:
        total.update(f"{name}\0{size}\0{sha}\n".encode())
    return total.hexdigest()


def file_sha256(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file, or of the sorted file hashes of a Parquet folder."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).select("path", F.sha2("content", 256).alias("sha")).orderBy("path").collect()
    shas = [r["sha"] for r in rows]
    return shas[0] if len(shas) == 1 else hashlib.sha256("\n".join(shas).encode()).hexdigest()


def write_csv(df, path: str) -> None:
    """A small table as a single CSV file with ``%.10f`` floats; nulls are empty."""
    spark = df.sparkSession
    lines = [",".join(df.columns)]
    for row in df.collect():  # result tables: a row for each segment, metric or week
        lines.append(",".join("" if v is None else f"{v:.10f}" if isinstance(v, float) else _quoted(v) for v in row))
    write_text(spark, path, "\n".join(lines) + "\n")


def _quoted(v) -> str:
    text = str(v)
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n') else text


def rows_csv(spark: SparkSession, rows: list[dict], path: str, columns: list[str] | None = None) -> None:
    columns = columns or list(rows[0])
    lines = [",".join(columns)] + [",".join("" if r[c] is None else f"{r[c]:.10f}" if isinstance(r[c], float) else _quoted(r[c]) for c in columns) for r in rows]
    write_text(spark, path, "\n".join(lines) + "\n")
