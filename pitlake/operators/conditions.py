"""Conditions resolved from templates, and match sets of whole condition sets as masks over daily bitmaps.

Each template has two sides, so a set of conditions is a mask of bits. Every day of an instrument carries two bitmaps: of
the templates that can be evaluated and of the sides that hold, the latter with the instrument's own thresholds as of the
scoring date. Any rung of the ladder, and any set less one condition, is then a mask over the same days.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pitlake.operators import research as rs

#: Name, family, mode, feature, whose series it is, upper and lower cut, band of a direction, window of a catalyst.
TEMPLATES = (
    ("market_trend", "market", "flag", "regime_bull", "market", 0.5, 0.5, 0.0, 0.0),
    ("market_volatility", "market", "bucket", "vix_pctile_252d", "market", 0.8, 0.2, 0.0, 0.0),
    ("rates_direction", "market", "direction", "dgs10_chg_63d", "market", 0.0, 0.0, 0.25, 0.0),
    ("inflation_direction", "market", "direction", "cpi_yoy_accel", "market", 0.0, 0.0, 0.0, 0.0),
    ("sector_trend", "sector", "structural", "etf_price_to_ma50", "sector", 0.0, 0.0, 0.0, 0.0),
    ("sector_relative_strength", "sector", "structural", "rel_ret_sector_63d", "own", 0.0, 0.0, 0.0, 0.0),
    ("own_momentum", "company", "own", "ret_63d", "own", 0.8, 0.2, 0.0, 0.0),
    ("own_trend", "company", "structural", "price_to_ma200", "own", 0.0, 0.0, 0.0, 0.0),
    ("own_extension", "company", "own", "dist_52w_high", "own", 0.8, 0.2, 0.0, 0.0),
    ("valuation_pe", "valuation", "own", "pe_forward", "own", 0.8, 0.2, 0.0, 0.0),
    ("valuation_ps", "valuation", "own", "price_to_sales", "own", 0.8, 0.2, 0.0, 0.0),
    ("pre_earnings", "catalyst", "window", "days_until_earnings", "own", 0.0, 0.0, 0.0, 10.0),
    ("post_earnings", "catalyst", "window", "days_since_earnings", "own", 0.0, 0.0, 0.0, 10.0),
)
SCHEMA = "bit int, name string, family string, mode string, feature string, src string, high double, low double, band double, most double"
#: The families that a rung needs, from the most to the least specific; valuation counts as company.
LADDER = (("market", "sector", "company", "catalyst"), ("market", "sector", "company"), ("market", "company", "catalyst"), ("market", "company"), ("market", "sector"), ("market",))
GROUPS = {"market": ("market",), "sector": ("sector",), "company": ("company", "valuation"), "catalyst": ("catalyst",)}
#: Matches, calendar episodes and years at least, shares of one symbol and one year at most; sessions of the main horizon.
SUPPORT, FOCUS = (40, 12, 3, 0.5, 0.6), 21
#: A return that counts as large, episodes for a confidence of one half and for a score at all.
BEYOND, PRIOR_EPISODES, LEAST_EPISODES = 0.05, 20.0, 5.0
#: The quantiles of own buckets.
CUTS = (0.2, 0.8)
#: One bit of each template: those that can be evaluated.
EVEN = sum(4**k for k in range(len(TEMPLATES)))


def table() -> list[tuple]:
    return [(k, *row) for k, row in enumerate(TEMPLATES)]


def side(mode: Column, value: Column, high: Column, low: Column, band: Column, most: Column) -> Column:
    """0 or 1 for the side that the target is on, null where its state says nothing. Cuts of own buckets are quantiles."""
    first, second = F.lit(0), F.lit(1)
    return (
        F.when(value.isNull(), F.lit(None)).when(mode == "flag", F.when(value >= 0.5, first).otherwise(second))
        .when(mode.isin("bucket", "own"), F.when(value >= high, first).when(value <= low, second))
        .when(mode == "direction", F.when(value > band, first).when(value < -band, second))
        .when(mode == "structural", F.when(value >= 0, first).otherwise(second))
        .when(value <= most, first)
    )


def holding(mode: Column, value: Column, high: Column, low: Column, most: Column) -> Column:
    """Which sides of a template a day satisfies: 1 the first, 2 the second, 3 both."""
    yes = lambda c, bit: F.when(c, bit).otherwise(0)
    return (
        F.when(mode == "flag", yes(value == 1, 1) + yes(value == 0, 2)).when(mode.isin("bucket", "own"), yes(value >= high, 1) + yes(value <= low, 2))
        .when(mode == "direction", yes(value > 0, 1) + yes(value < 0, 2)).when(mode == "structural", yes(value >= 0, 1) + yes(value < 0, 2)).otherwise(yes(value <= most, 1))
    )


def resolved(cells: DataFrame, states: DataFrame, templates: DataFrame) -> DataFrame:
    """Every template at every cell: its side, or why it has none.

    ``states`` has the latest value and the quantiles CUTS per cell and feature.
    """
    rows = cells.crossJoin(F.broadcast(templates)).join(states, [*cells.columns, "feature"], "left")
    own = F.col("mode") == "own"
    high, low = F.when(own, F.col("q")[1]).otherwise(F.col("high")), F.when(own, F.col("q")[0]).otherwise(F.col("low"))
    on = side(F.col("mode"), F.col("value"), high, low, F.col("band"), F.col("most"))
    reason = F.when(F.col("value").isNull(), "unavailable").when(own & F.col("q").isNull(), "thin history").when(F.col("side").isNull(), F.when(F.col("mode") == "window", "far").otherwise("middle"))
    limit = F.when(F.col("side").isNull(), F.lit(None)).when(F.col("mode") == "window", F.col("most")).when(F.col("mode").isin("own", "bucket"), F.when(F.col("side") == 0, high).otherwise(low)).when(F.col("mode") == "flag", 1.0 - F.col("side")).otherwise(0.0)
    return rows.withColumn("side", on).withColumns({"reason": reason, "threshold": limit}).select(*cells.columns, "bit", "name", "family", "mode", "feature", "value", "side", "reason", "threshold")


def rungs(states: DataFrame) -> DataFrame:
    """``rung, mask`` of each cell for the rungs whose groups all have a condition; ``whole`` is the mask of all conditions."""
    bit = F.coalesce(F.expr("shiftleft(1, 2 * bit + side)"), F.lit(0))
    groups = states.groupBy("instrument_id", "as_of").agg(*[F.sum(F.when(F.col("family").isin(*fs), bit).otherwise(0)).cast("int").alias(g) for g, fs in GROUPS.items()])
    each = [F.when(F.least(*map(F.col, r), F.lit(1 << 30)) > 0, F.struct(F.lit(i).alias("rung"), sum(map(F.col, r)).cast("int").alias("mask"))) for i, r in enumerate(LADDER)]
    rows = groups.withColumn("whole", sum(map(F.col, GROUPS)).cast("int"))
    return rows.select("instrument_id", "as_of", "whole", F.inline(F.filter(F.array(*each), lambda x: x.isNotNull())))


def apply_masks(pool: DataFrame, masks: DataFrame, horizon: int = FOCUS) -> DataFrame:
    """Per scoring date, mask and instrument: events (first days of matches among the days that can be evaluated), and sums
    of complete outcomes over events and over all such days.

    ``pool`` has one row per date and instrument with arrays ``days, known, hold`` and ``fwd<horizon>``, as long as the
    calendar; ``masks`` are the distinct masks of a date, as many as its targets have rungs.
    """
    asked = masks.select("as_of", "mask").distinct().groupBy("as_of").agg(F.sort_array(F.collect_list("mask")).alias("masks"))
    schema = "as_of date, mask int, instrument_id long, n long, events array<int>, n_done long, s_done double, n_base long, s_base double"
    out = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict[str, list] = {f.name: [] for f in out}
            for r in b.to_pylist():
                days, known, hold = (np.array(r[c], np.int64) for c in ("days", "known", "hold"))
                fwd = np.array([np.nan if x is None else x for x in r["fwd"]])
                for m in r["masks"]:
                    need = (m | m >> 1) & EVEN
                    own = np.flatnonzero((known & need) == need)
                    if not len(own):
                        continue
                    match = (hold[own] & m) == m
                    first = own[match & ~np.concatenate(([False], match[:-1]))]
                    done, base = fwd[first], fwd[own]
                    done, base = done[~np.isnan(done)], base[~np.isnan(base)]
                    for c, x in zip(rows, (r["as_of"], m, r["instrument_id"], len(first), days[first].tolist(), len(done), float(done.sum()), len(base), float(base.sum())), strict=True):
                        rows[c].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in out], schema=out)

    return pool.join(F.broadcast(asked), "as_of").select("as_of", "instrument_id", "days", "known", "hold", F.col(f"fwd{horizon}").alias("fwd"), "masks").mapInArrow(run, schema)


def described(rows: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """Per key (with ``horizon``) what followed the events: distribution, effect against the base, its error on the
    independent episodes, shares beyond 5 %, and the largest shares of one symbol and one year.
    """
    x = F.col("fwd")
    share = lambda c: F.avg(c.cast("double"))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.stddev_samp(x).alias("std"), share(x > 0).alias("p_up"), share(x > BEYOND).alias("p_above"), share(x < -BEYOND).alias("p_below"),
        *[F.percentile(x, q / 100).alias(f"p{q}") for q in (10, 25, 75, 90)],
    )
    profile = rs.independence(rows, keys, F.col("horizon")).select(*keys, "episodes", "hhi_symbol", "hhi_year")
    joined = out.join(profile, keys).join(base.select(*keys, "base"), keys, "left")
    return joined.withColumns({"effect": F.col("mean") - F.col("base"), "se": F.col("std") / F.sqrt("episodes")})


def effects(found: DataFrame) -> DataFrame:
    """Per date and mask: events, and the mean outcome after events less that of all days that can be evaluated."""
    s = found.groupBy("as_of", "mask").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in ("n_done", "s_done", "n_base", "s_base")])
    return s.select("as_of", "mask", "n", F.when(F.col("n_done") > 0, F.col("s_done") / F.col("n_done") - F.col("s_base") / F.col("n_base")).alias("effect"))
