"""Idempotent sinks and the comparisons behind them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; a local session without one gets a temporary folder."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-pitlake-"))
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def insert_absent(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key is new, the first of each."""
    return incoming.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def upsert_status(incoming: DataFrame, stored: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Every key of either side with what an upsert does to it: insert, update, unchanged, or kept."""
    new, old = F.struct(*[F.col(f"i.{v}") for v in values]), F.struct(*[F.col(f"s.{v}") for v in values])
    both = incoming.withColumn("_in", F.lit(1)).alias("i").join(stored.withColumn("_st", F.lit(1)).alias("s"), keys, "full")
    status = F.when(F.col("_st").isNull(), "insert").when(F.col("_in").isNull(), "kept").when(new.eqNullSafe(old), "unchanged").otherwise("update")
    return both.select(*keys, status.alias("status"), *[F.when(F.col("_in").isNull(), F.col(f"s.{v}")).otherwise(F.col(f"i.{v}")).alias(v) for v in values])


#: Rows of a task that writes.
FILE_ROWS = 2_000_000


def write_years(df: DataFrame, path: str, date: str, rows: int = FILE_ROWS) -> None:
    """Partitioned by year; only years that the rows touch are replaced.

    The rows are counted and dealt by ranges of date and a hash of the row, so a task writes about ``rows`` of them, however
    many a year or a day has; a range may hold the end of one year and the start of the next.
    """
    parts = max(1, -(-df.count() // rows))
    dealt = df.withColumn("year", F.year(date)).repartitionByRange(parts, "year", date, F.xxhash64(*df.columns))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def content_hash(df: DataFrame, keys: list[str]) -> DataFrame:
    """One digest per key of the rows' hashes, whatever their order."""
    row = F.xxhash64(*[c for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.bit_xor(row).alias("digest"))


def write_once(incoming: DataFrame, archive: DataFrame, keys: list[str]) -> DataFrame:
    """Per key of ``incoming``: new, unchanged, or conflict with what the archive holds."""
    old = content_hash(archive, keys).select(*keys, F.col("digest").alias("_d"), F.col("rows").alias("_r"))
    status = F.when(F.col("_d").isNull(), "new").when((F.col("_d") == F.col("digest")) & (F.col("_r") == F.col("rows")), "unchanged").otherwise("conflict")
    return content_hash(incoming, keys).join(old, keys, "left").select(*keys, "rows", status.alias("status"))


def export_csv(df: DataFrame, path: str, numbers: list[str], decimals: int = 8) -> None:
    """CSV files with a header; ``numbers`` are written with a fixed count of decimals, nulls as empty fields."""
    fixed = {c: F.when(F.col(c).isNotNull(), F.format_string(f"%.{decimals}f", F.col(c))) for c in numbers}
    df.withColumns(fixed).write.option("header", True).csv(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a scratch path and read back: what follows reads it instead of planning it anew."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
