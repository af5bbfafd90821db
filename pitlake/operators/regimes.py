"""Regime tables: rows of (family, priority, feature, op, limit, label); the first that holds in a family is active."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.operators.research import holds


def rates_table() -> list[tuple[str, int, str, str, float, str]]:
    """Two series, four windows, moves of 0.50, 0.25 and 0.10 either way, strongest first."""
    rows = []
    for code in ("DGS2", "DGS10"):
        for window in (5, 21, 63, 126):
            limits = [(sign, step) for step in (0.50, 0.25, 0.10) for sign in (1, -1)]
            for priority, (sign, step) in enumerate(limits):
                rows.append((f"{code}_{window}", priority, f"{code}_{window}", ">=" if sign > 0 else "<=", sign * step, f"{code}_{window}_{'up' if sign > 0 else 'down'}_{step:.2f}"))
    return rows


def active(values: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """The active label of each family per key; a missing value makes a regime inactive."""
    tested = values.join(F.broadcast(table), "feature").where(holds(F.col("value"), F.col("op"), F.col("limit")))
    return tested.groupBy(*keys, "family").agg(F.min_by("label", "priority").alias("label"))


#: What scored days are labelled by.
DIMENSIONS = ("trend", "volatility", "rates", "inflation", "breadth", "technology", "earnings_window")


def labelled(rows: DataFrame) -> DataFrame:
    """Rows per dimension with the label of their latest values ``bull, pctile, move, accel, breadth, lead`` and of the days ``since`` a report.

    Only the trend can be unknown and then has no row; where a default stands in for a missing value, 0 counts as missing.
    """
    bull, pctile, move, breadth = (F.col(c) for c in ("bull", "pctile", "move", "breadth"))
    of = (
        F.when(bull == 1, "bull").when(bull == 0, "bear"),
        F.when(pctile >= 0.8, "high").when((pctile <= 0.2) & (pctile != 0), "low").otherwise("mid"),
        F.when(move > 0.25, "rising").when(move < -0.25, "falling").otherwise("stable"),
        F.when(F.col("accel") > 0, "accelerating").otherwise("decelerating"),
        F.when(breadth >= 0.7, "strong").when((breadth <= 0.3) & (breadth != 0), "weak").otherwise("mixed"),
        F.when(F.col("lead") > 0, "leading").otherwise("lagging"),
        F.when(F.col("since") <= 10, "post").otherwise("outside"),
    )
    each = [F.struct(F.lit(name).alias("dimension"), label.alias("regime")) for name, label in zip(DIMENSIONS, of, strict=True)]
    values = {"bull", "pctile", "move", "accel", "breadth", "lead", "since"}
    return rows.select(*[c for c in rows.columns if c not in values], F.inline(F.array(*each))).where("regime is not null")


def collect_evidence(days: DataFrame, fwd: DataFrame, least: int = 5) -> DataFrame:
    """Per regime and horizon: events, mean excess over all days, and its error."""
    base = fwd.where("fwd is not null").groupBy("horizon").agg(F.avg("fwd").alias("base"))
    joined = days.join(fwd.where("fwd is not null"), "d").join(F.broadcast(base), "horizon")
    out = joined.groupBy("family", "label", "horizon").agg(F.count("*").alias("n"), (F.avg("fwd") - F.first("base")).alias("effect"), (F.stddev_samp("fwd") / F.sqrt(F.count("*"))).alias("se"))
    return out.where((F.col("n") >= least) & (F.col("se") > 0))
