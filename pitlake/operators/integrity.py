"""Contracts of input files, findings on snapshots, and parity of two computations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def header_check(lines: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Per CSV file its rows and the required columns that its header lacks; ``lines`` is read with the text source.

    A file's header is its first line, wherever the reader cut the file; one aggregation with partial results.
    """
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    placed = lines.select(F.col("_metadata.file_path").alias("file"), at.alias("at"), "value")
    files = placed.groupBy("file").agg(F.min_by("value", "at").alias("header"), (F.count("*") - 1).alias("rows"))
    return files.select("file", "rows", F.array_except(F.array(*map(F.lit, required)), F.split("header", ",")).alias("missing"))


def _all(findings: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, findings)


def market_snapshot_findings(snapshots: DataFrame, terminals: DataFrame) -> DataFrame:
    """Negative capitalisation, capitalisation without shares, and snapshots after the security's terminal event."""
    named = lambda df, rule: df.select("security_id", "snapshot_date", F.lit(rule).alias("rule"))
    late = snapshots.join(terminals.select("security_id", "ended"), "security_id").where("snapshot_date > ended")
    return _all([named(snapshots.where("market_cap < 0"), "negative_cap"), named(snapshots.where("market_cap is not null and shares is null"), "cap_without_shares"), named(late, "after_terminal")])


def research_findings(snapshots: DataFrame, bridge: DataFrame) -> DataFrame:
    """Snapshots whose checksum and status disagree or whose worlds are mixed, and bridge rows that reach into the next of their key."""
    named = lambda cond, rule: snapshots.where(cond).select(F.col("name").alias("entity"), F.lit(rule).alias("rule"), F.lit(1).cast("long").alias("n"))
    following = F.lead("valid_from").over(Window.partitionBy("identifier").orderBy("valid_from", "security_id"))
    reach = bridge.withColumn("_next", following).where("_next is not null and (valid_to is null or valid_to >= _next)")
    rules = (("status <> 'frozen' and checksum is not null", "unfrozen_with_checksum"), ("status = 'frozen' and checksum is null", "frozen_without_checksum"), ("outcome_world = 'security' and feature_world = 'instrument'", "mixed_worlds"))
    return _all([*[named(c, r) for c, r in rules], reach.groupBy(F.col("identifier").alias("entity")).agg(F.count("*").alias("n")).select("entity", F.lit("bridge_overlap").alias("rule"), "n")])


def parity(legacy: DataFrame, native: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Every key of either side, whether both values are null (which passes) and whether they differ by more than the tolerance."""
    both = legacy.select(*keys, F.col("value").alias("_a")).join(native.select(*keys, F.col("value").alias("_b")), keys, "full")
    none = F.col("_a").isNull() & F.col("_b").isNull()
    return both.select(*keys, none.alias("both_null"), (~none & F.coalesce(F.abs(F.col("_a") - F.col("_b")) > tolerance, F.lit(True))).alias("outside"))
