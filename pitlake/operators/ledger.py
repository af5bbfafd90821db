"""Transactions to lots, closures, daily snapshots and portfolio risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlake.operators import pit
from pitlake.sources import sinks

BUYS, SELLS = ("buy", "transfer_in", "opening_balance"), ("sell", "transfer_out")
LONG_DAYS = 365
#: Places on the quantity axis stay exact; at 38 digits a difference would lose decimals.
AXIS = "decimal(30,8)"
#: Transactions of one instrument that are sorted together when lots meet disposals, in expectation.
CUTS = 100_000
#: Shared dates that covariances and the worst window need.
MIN_OVERLAP = 60


def placed(tx: DataFrame) -> DataFrame:
    """Transactions with the quantity bought and sold up to each, ``_b`` and ``_s``.

    A day's start comes from sums by day, of which there are as many as the calendar is long, so only the transactions of one instrument and day are
    sorted together; decimals make the sums exact. ``txn_id`` may be of any type that has an order.
    """
    bought, sold = F.when(F.col("txn_type").isin(*BUYS), F.col("quantity")).otherwise(0), F.when(F.col("txn_type").isin(*SELLS), F.col("quantity")).otherwise(0)
    before = Window.partitionBy("_i").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    daily = tx.groupBy(F.col("instrument_id").alias("_i"), F.col("trade_date").alias("_d")).agg(F.sum(bought).cast(AXIS).alias("_b"), F.sum(sold).cast(AXIS).alias("_s"))
    start = daily.select("_i", "_d", *[F.coalesce(F.sum(c).over(before), F.lit(0)).cast(AXIS).alias(f"{c}0") for c in ("_b", "_s")])
    w = Window.partitionBy("instrument_id", "trade_date").orderBy("txn_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = tx.withColumns({"_b": F.sum(bought).over(w).cast(AXIS), "_s": F.sum(sold).over(w).cast(AXIS)})
    met = rows.join(start, F.col("instrument_id").eqNullSafe(F.col("_i")) & F.col("trade_date").eqNullSafe(F.col("_d")))
    return met.select(*tx.columns, *[(F.col(c) + F.col(f"{c}0")).cast(AXIS).alias(c) for c in ("_b", "_s")])


def _short() -> Column:
    return F.col("txn_type").isin(*SELLS) & (F.col("_s") > F.col("_b"))


def oversells(tx: DataFrame) -> DataFrame:
    """Disposals that exceed what is held at that moment, in order of date and id."""
    return placed(tx).where(_short()).select("instrument_id", "txn_id", "trade_date", (F.col("_s") - F.col("_b")).cast("double").alias("short"))


def covered(tx: DataFrame) -> DataFrame:
    """Transactions of instruments without an oversell, with their places; written once, as lots and closures both read them.

    ``_w`` is the width that cuts an instrument's quantity axis into parts of about :data:`CUTS` transactions.
    """
    rows = sinks.written(placed(tx), "placed")
    top, parts = F.max(F.greatest("_b", "_s")).cast("double"), F.ceil(F.count("*") / CUTS)
    each = rows.groupBy("instrument_id").agg(F.bool_or(_short()).alias("_bad"), F.greatest(top / parts, F.lit(1e-8)).alias("_w"))
    return rows.join(F.broadcast(each.where("not _bad").drop("_bad")), "instrument_id")


def _basis() -> Column:
    return F.bround(F.abs("total_amount").cast("double") / F.col("quantity").cast("double"), 6)


def lots(tx: DataFrame) -> DataFrame:
    """Acquisitions with their place [c0, c1) in the instrument's bought quantity and their basis per share (6 places, half to even)."""
    rows = tx if "_b" in tx.columns else placed(tx)
    return rows.where(F.col("txn_type").isin(*BUYS)).select("instrument_id", F.col("txn_id").alias("lot_id"), F.col("trade_date").alias("acquired"), F.col("quantity").cast("double").alias("quantity"), _basis().alias("basis"), (F.col("_b") - F.col("quantity")).cast(AXIS).alias("c0"), F.col("_b").alias("c1"))


def _part(place: str) -> Column:
    return F.floor(F.col(place).cast("double") / F.col("_w"))


def closures(tx: DataFrame) -> DataFrame:
    """Disposals matched to lots, oldest first, for instruments without an oversell.

    Buys and sells both tile the quantity axis, so cutting it at the starts of both gives pieces that belong to one
    lot and one disposal: one pass over the transactions instead of a join of all lots with all disposals. The axis is
    sorted in parts; a lot or disposal that reaches into later parts is told there, and a piece belongs to the part that it
    starts in, so it stays whole. Transactions of no quantity match nothing.
    """
    buy, sell = F.col("txn_type").isin(*BUYS), F.col("txn_type").isin(*SELLS)
    rows = (tx if "_w" in tx.columns else covered(tx)).where((buy | sell) & (F.col("quantity") > 0))
    cuts = rows.withColumn("_end", F.when(buy, F.col("_b")).otherwise(F.col("_s"))).withColumn("p", (F.col("_end") - F.col("quantity")).cast(AXIS)).select(
        "instrument_id", "p", _part("p").alias("home"), F.explode(F.sequence(_part("p"), _part("_end"))).alias("part"),
        F.when(buy, F.struct(F.col("txn_id").alias("lot_id"), F.col("trade_date").alias("acquired"), _basis().alias("basis"), F.col("_b").alias("c1"))).alias("lot"),
        F.when(sell, F.struct(F.col("txn_id").alias("sell_id"), "trade_date", F.col("quantity").cast("double").alias("sold"), F.col("total_amount").cast("double").alias("amount"), F.col("_s").alias("s1"))).alias("sell"),
    )
    w = Window.partitionBy("instrument_id", "part").orderBy("p")  # its frame takes in all cuts at one place
    pieces = cuts.withColumns({"next": F.lead("p").over(w), "lot": F.last("lot", True).over(w), "sell": F.last("sell", True).over(w)}).where("home = part and lot is not null and sell is not null")
    matched = pieces.withColumn("quantity", (F.least("next", "lot.c1", "sell.s1") - F.col("p")).cast("double")).where("quantity > 0")
    proceeds, cost = F.col("sell.amount") * F.col("quantity") / F.col("sell.sold"), F.col("lot.basis") * F.col("quantity")
    days = F.datediff("sell.trade_date", "lot.acquired")
    return matched.select("instrument_id", "lot.lot_id", "sell.sell_id", F.col("sell.trade_date").alias("closed"), "quantity", proceeds.alias("proceeds"), cost.alias("cost"), (proceeds - cost).alias("gain"), days.alias("days"), (days > LONG_DAYS).alias("long_term"))


def open_positions(own: DataFrame, closed: DataFrame, day: Column) -> DataFrame:
    """Quantity and basis still held on a day."""
    gone = closed.where(F.col("closed") <= day).groupBy("instrument_id", "lot_id").agg(F.sum("quantity").alias("gone"))
    left = own.where(F.col("acquired") <= day).join(gone, ["instrument_id", "lot_id"], "left").withColumn("remaining", F.col("quantity") - F.coalesce("gone", F.lit(0.0))).where("remaining > 0")
    return left.groupBy("instrument_id").agg(F.sum("remaining").alias("quantity"), F.sum(F.bround(F.col("remaining") * F.col("basis"), 6)).alias("basis"))


def snapshots(own: DataFrame, closed: DataFrame, calendar: DataFrame, px: DataFrame) -> DataFrame:
    """Per calendar day and held instrument: quantity, basis, value at the latest adjusted close, gain and weight."""
    moves = own.select("instrument_id", F.col("acquired").alias("t"), "quantity", (F.col("quantity") * F.col("basis")).alias("cost")).union(closed.select("instrument_id", F.col("closed").alias("t"), -F.col("quantity"), -F.col("cost")))
    daily = moves.groupBy("instrument_id", "t").agg(F.sum("quantity").alias("q"), F.sum("cost").alias("c"))
    w = Window.partitionBy("instrument_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    state = daily.select("instrument_id", "t", F.sum("q").over(w).alias("quantity"), F.sum("c").over(w).alias("basis"))
    grid = own.select("instrument_id").distinct().crossJoin(F.broadcast(calendar.select("d")))
    held = pit.asof(grid, state, ["instrument_id"], "d", "t", ["quantity", "basis"]).where("quantity > 1e-9")
    valued = pit.asof(held, px.select("instrument_id", F.col("d").alias("pd"), "adj"), ["instrument_id"], "d", "pd", ["adj"]).withColumn("value", F.col("quantity") * F.col("adj"))
    return valued.select("instrument_id", "d", "quantity", "basis", "value", (F.col("value") - F.col("basis")).alias("gain"), (F.col("value") / F.sum("value").over(Window.partitionBy("d"))).alias("weight"))


def weights(held: DataFrame) -> DataFrame:
    """One day's positions with rank, share of concentration, and sector weight."""
    return held.select(
        "instrument_id", "sector_id", "value", "weight", F.row_number().over(Window.orderBy(F.desc("value"), "instrument_id")).alias("rank"),
        (F.col("weight") ** 2 / F.sum(F.col("weight") ** 2).over(Window.partitionBy(F.lit(1)))).alias("hhi_share"), F.sum("weight").over(Window.partitionBy("sector_id")).alias("sector_weight"),
    )


def return_panel(px: DataFrame, names: DataFrame, prices: int = 253) -> DataFrame:
    """Returns over the trailing prices of each name, on the dates that all names share."""
    latest = px.join(F.broadcast(names.select("instrument_id")), "instrument_id").withColumn("_n", F.row_number().over(Window.partitionBy("instrument_id").orderBy(F.desc("d")))).where(F.col("_n") <= prices)
    rets = latest.withColumn("r", F.col("adj") / F.lag("adj").over(Window.partitionBy("instrument_id").orderBy("d")) - 1).where("r is not null").select("instrument_id", "d", "r")
    full = rets.groupBy("d").agg(F.count("*").alias("_c")).crossJoin(F.broadcast(names.agg(F.count("*").alias("_k")))).where("_c = _k").select("d")
    return rets.join(F.broadcast(full), "d")


def covariance(panel: DataFrame, names: DataFrame) -> DataFrame:
    """Covariance and correlation of each pair of names; null under :data:`MIN_OVERLAP` shared dates."""
    a, b = (panel.select("d", F.col("instrument_id").alias(f"i{k}"), F.col("r").alias(f"r{k}")) for k in (1, 2))
    enough = lambda x: F.when(F.count("*") >= MIN_OVERLAP, x)
    found = a.join(b, "d").groupBy("i1", "i2").agg(enough(F.covar_samp("r1", "r2")).alias("cov"), enough(F.corr("r1", "r2")).alias("corr"))
    i1, i2 = (names.select(F.col("instrument_id").alias(f"i{k}")) for k in (1, 2))
    return i1.crossJoin(i2).join(found, ["i1", "i2"], "left")


def worst_window(panel: DataFrame, held: DataFrame) -> DataFrame:
    """Peak and trough of the deepest drawdown of the portfolio's index, and each position's return over it; null under :data:`MIN_OVERLAP` shared dates."""
    w = Window.orderBy("d")  # at most 252 dates
    daily = panel.join(F.broadcast(held.select("instrument_id", "weight")), "instrument_id").groupBy("d").agg(F.sum(F.col("weight") * F.col("r")).alias("r"))
    index = daily.withColumn("v", F.exp(F.sum(F.log1p("r")).over(w))).withColumn("top", F.max("v").over(w)).withColumn("peak", F.max_by("d", "v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    index = index.withColumn("_n", F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).where(F.col("_n") >= MIN_OVERLAP)
    deepest = index.orderBy(F.col("v") / F.col("top"), "d").limit(1).select("peak", F.col("d").alias("trough"), (F.col("v") / F.col("top") - 1).alias("dd"))
    inside = panel.crossJoin(F.broadcast(deepest)).where("d > peak and d <= trough")
    found = inside.groupBy("instrument_id", "peak", "trough", "dd").agg((F.exp(F.sum(F.log1p("r"))) - 1).alias("contribution"))
    return held.select("instrument_id").join(found, "instrument_id", "left")


def risk(cov: DataFrame, held: DataFrame) -> DataFrame:
    """Own volatility, share of variance, marginal risk, and what the volatility would be without the position."""
    w1, w2 = (held.select(F.col("instrument_id").alias(f"i{k}"), F.col("weight").alias(f"w{k}")) for k in (1, 2))
    terms = cov.join(F.broadcast(w1), "i1").join(F.broadcast(w2), "i2")
    by = terms.groupBy("i1", "w1").agg(F.sum(F.col("w2") * F.col("cov")).alias("sw"), F.sum(F.when(F.col("i1") == F.col("i2"), F.col("cov"))).alias("var"))
    total = by.agg(F.sum(F.col("w1") * F.col("sw")).alias("v"))
    out = by.crossJoin(F.broadcast(total))
    without = (F.col("v") - 2 * F.col("w1") * F.col("sw") + F.col("w1") ** 2 * F.col("var")) / (1 - F.col("w1")) ** 2
    return out.select(
        F.col("i1").alias("instrument_id"), F.sqrt(F.col("var") * 252).alias("own_vol"), F.sqrt(F.col("v") * 252).alias("portfolio_vol"), (F.col("w1") * F.col("sw") / F.col("v")).alias("risk_share"),
        (F.col("sw") * 252 / F.sqrt(F.col("v") * 252)).alias("marginal"), (F.sqrt(F.greatest(F.lit(0.0), without) * 252) - F.sqrt(F.col("v") * 252)).alias("diversification"),
    )


def drawdowns(px: DataFrame) -> DataFrame:
    """Current and deepest drawdown of each instrument."""
    w = Window.partitionBy("instrument_id").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    dd = px.withColumn("dd", F.col("adj") / F.max("adj").over(w) - 1)
    return dd.groupBy("instrument_id").agg(F.max_by("dd", "d").alias("current"), F.min("dd").alias("deepest"))
