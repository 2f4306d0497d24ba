"""Sources and sinks: pinned CSV, result texts, JSON documents, deterministic output."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.functions.nulls import na_to_null


class SourceFailure(Exception):
    """An input is missing or isn't the pinned one."""


def sha256_of(spark: SparkSession, path: str) -> str:
    """The digest of a file's bytes, read as a stream from whatever store it lies in: no size is too large."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    try:
        stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
        try:
            return jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
        finally:
            stream.close()
    except Exception as e:
        raise SourceFailure(f"{path}: cannot be read") from e


def read_csv(spark: SparkSession, path: str, sha256: str | None = None, trim: bool = False) -> DataFrame:
    """A CSV as text columns, missing tokens as NULL; fails closed on another digest."""
    if sha256 is not None and sha256_of(spark, path) != sha256:
        raise SourceFailure(f"{path}: digest differs from the pinned one")
    with_blanks = {"ignoreLeadingWhiteSpace": trim, "ignoreTrailingWhiteSpace": trim}
    raw = spark.read.csv(path, header=True, inferSchema=False, escape='"', **with_blanks)
    return raw.select(*[na_to_null(F.col(f"`{c}`")).alias(c) for c in raw.columns])


def read_key_values(spark: SparkSession, path: str, required: list[str] = ()) -> dict[str, str]:
    """key=value lines of a result text (a few); fails on missing keys."""
    parts = F.split("value", "=", 2)
    rows = spark.read.text(path).where(F.contains("value", F.lit("="))).select(F.trim(parts[0]).alias("k"), F.trim(parts[1]).alias("v")).collect()
    found = {r["k"]: r["v"] for r in rows}
    if missing := [k for k in required if k not in found]:
        raise SourceFailure(f"{path}: missing keys {missing}")
    return found


def read_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON documents of a declared schema."""
    return spark.read.schema(schema).json(path, multiLine=True)


def write_table(df: DataFrame, path: str, sort_by: list[str] = (), fmt: str = "parquet", single_file: bool = False) -> None:
    """Columns by name, rows by ``sort_by`` (missing last); written only once guards have passed."""
    keys = [F.col(k).asc_nulls_last() for k in sort_by if k in df.columns]
    df = df.select(*sorted(df.columns))
    df = df.orderBy(*keys) if keys else df
    writer = (df.coalesce(1) if single_file else df).write.mode("errorifexists")
    writer.csv(path, header=True, lineSep="\n", escape='"') if fmt == "csv" else writer.parquet(path)


def write_log(log: dict, path: str) -> None:
    """Indent 2, UTF-8, LF, a line end at the end."""
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        json.dump(log, f, indent=2, ensure_ascii=False)
        f.write("\n")
