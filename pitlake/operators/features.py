"""Feature calculators over a price panel keyed (instrument_id, d), and over market series keyed by day.

A rolling value exists only where its window is full and without nulls; what can't be computed is null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pitlake.operators import pit

YEAR = 252


def own_days() -> WindowSpec:
    return Window.partitionBy("instrument_id").orderBy("d")


def market_days() -> WindowSpec:
    """For series that are as long as a calendar, never for fact rows."""
    return Window.orderBy("d")


def rolling(fn, col: Column | str, n: int, window: WindowSpec | None = None) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    frame = (window or own_days()).rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(frame) == n, fn(c).over(frame))


def growth(col: str, n: int, window: WindowSpec | None = None) -> Column:
    return F.try_divide(F.col(col), F.lag(col, n).over(window or own_days())) - 1


def change(col: str, n: int, window: WindowSpec | None = None) -> Column:
    return F.col(col) - F.lag(col, n).over(window or own_days())


def returns(px: DataFrame, windows=(1, 5, 21, 63, 126, 252)) -> DataFrame:
    return px.select("instrument_id", "d", *[growth("adj", n).alias(f"ret_{n}d") for n in windows])


def price_features(px: DataFrame) -> DataFrame:
    """All price-only features of the registry, wide."""
    prior = px.withColumn("daily", growth("adj", 1)).withColumn("pc", F.lag("close").over(own_days()))
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("pc")), F.abs(F.col("low") - F.col("pc")))
    first = prior.select(
        "*", true_range.alias("tr"), rolling(F.avg, "adj", 50).alias("ma50"), rolling(F.avg, "adj", 200).alias("ma200"),
        (rolling(F.stddev_samp, "daily", 21) * YEAR**0.5).alias("vol_21d"), (rolling(F.stddev_samp, "daily", 63) * YEAR**0.5).alias("vol_63d"),
        rolling(F.max, "close", YEAR).alias("top"), rolling(F.min, "close", YEAR).alias("bottom"),
    ).withColumn("ma50_ma200_spread", F.try_divide("ma50", "ma200") - 1)
    return first.select(
        "instrument_id", "d", *[growth("adj", n).alias(f"ret_{n}d") for n in (1, 5, 21, 63, 126, 252)],
        F.ln(F.try_divide(F.col("adj"), F.lag("adj", 1).over(own_days()))).alias("log_ret_1d"), (F.try_divide("open", "pc") - 1).alias("gap_1d"),
        (F.try_divide("adj", "ma50") - 1).alias("price_to_ma50"), (F.try_divide("adj", "ma200") - 1).alias("price_to_ma200"),
        "ma50_ma200_spread", change("ma50_ma200_spread", 21).alias("ma50_ma200_spread_chg_21d"), "vol_21d", "vol_63d",
        F.when(F.col("vol_63d") > 0, F.col("vol_21d") / F.col("vol_63d") - 1).alias("vol_ratio_21_63"),
        F.try_divide(rolling(F.avg, "tr", 14), F.col("close")).alias("atr14_pct"),
        (F.try_divide("close", "top") - 1).alias("dist_52w_high"), (F.try_divide("close", "bottom") - 1).alias("dist_52w_low"),
    )


def relative_returns(px: DataFrame, other: DataFrame, on: list[str], name: str, windows=(5, 21, 63, 126)) -> DataFrame:
    """Own return less that of a benchmark (sessions of its own) on the same date; absent where the benchmark is."""
    base = other.select(*on, *[growth("adj", n, Window.partitionBy(*[c for c in on if c != "d"]).orderBy("d") if len(on) > 1 else market_days()).alias(f"_b{n}") for n in windows])
    own = px.select("instrument_id", *on, *[growth("adj", n).alias(f"_r{n}") for n in windows])
    return own.join(base, on, "left").select("instrument_id", "d", *[(F.col(f"_r{n}") - F.col(f"_b{n}")).alias(f"rel_ret_{name}_{n}d") for n in windows])


def macro_wide(days: DataFrame, observations: DataFrame, codes: list[str]) -> DataFrame:
    """One column per code with its latest public value on each day."""
    aligned = pit.align_availability(days, observations.where(F.col("code").isin(codes)))
    return aligned.groupBy("d").pivot("code", codes).agg(F.first("value"))


def macro_change(observations: DataFrame, code: str, n: int) -> DataFrame:
    """Change over n observations (nulls count as such), public with the newer one."""
    w = Window.partitionBy("code").orderBy("obs_date")
    return observations.where(F.col("code") == code).withColumn("value", F.col("value") - F.lag("value", n).over(w))


def curve_slope(observations: DataFrame, long: str, short: str) -> DataFrame:
    """Difference of two series on common dates, public when both are."""
    a = observations.where(F.col("code") == long).select("obs_date", F.col("value").alias("a"), F.col("available_from").alias("fa"))
    b = observations.where(F.col("code") == short).select("obs_date", F.col("value").alias("b"), F.col("available_from").alias("fb"))
    return a.join(b, "obs_date").select(F.lit("slope").alias("code"), "obs_date", (F.col("a") - F.col("b")).alias("value"), F.greatest("fa", "fb").alias("available_from"))


def year_on_year(observations: DataFrame, code: str, months_earlier: int = 0) -> DataFrame:
    """Value over that of exactly 12 months before, less 1; with ``months_earlier``, less the same so much earlier."""
    own = observations.where(F.col("code") == code)
    past = own.select(F.add_months("obs_date", 12).alias("obs_date"), F.col("value").alias("_past"))
    yoy = own.join(past, "obs_date").withColumn("value", F.try_divide("value", "_past") - 1).drop("_past")
    if not months_earlier:
        return yoy
    before = yoy.select(F.add_months("obs_date", months_earlier).alias("obs_date"), F.col("value").alias("_past"))
    return yoy.join(before, "obs_date").withColumn("value", F.col("value") - F.col("_past")).drop("_past")


def trailing_percentile(observations: DataFrame, code: str, n: int = YEAR) -> DataFrame:
    """Share of the trailing n non-null observations that are at most the current one."""
    w = Window.partitionBy("code").orderBy("obs_date").rowsBetween(-(n - 1), 0)
    own = observations.where((F.col("code") == code) & F.col("value").isNotNull()).withColumn("_all", F.collect_list("value").over(w))
    share = F.when(F.size("_all") == n, F.size(F.filter("_all", lambda x: x <= F.col("value"))) / n)
    return own.withColumn("value", share).drop("_all")


def on_calendar(days: DataFrame, dated: DataFrame, name: str) -> DataFrame:
    """A dated market series as known on each day."""
    return pit.align_availability(days, dated).select("d", F.col("value").alias(name))


def fundamental_features(px: DataFrame, fu: DataFrame) -> DataFrame:
    """Latest snapshot fields and what derives from them, per panel row."""
    f = fu.select(
        "instrument_id", "as_of", "pe_trailing", "profit_margin",
        F.when(F.col("market_cap") > 0, F.log10("market_cap")).alias("log_market_cap"), F.when(F.col("revenue") > 0, F.col("market_cap") / F.col("revenue")).alias("price_to_sales"),
    )
    fields = ["pe_trailing", "profit_margin", "log_market_cap", "price_to_sales"]
    out = reduce(lambda p, c: pit.ffill(p, f, ["instrument_id"], "as_of", c), fields, px.select("instrument_id", "d"))
    return out.withColumn("pe_trailing_chg_63d", change("pe_trailing", 63))


def revenue_growth(fu: DataFrame, days_back: int = 350) -> DataFrame:
    """Revenue over that of the latest snapshot at least so many days earlier, less 1, where that is positive."""
    now = fu.select("instrument_id", "as_of", "revenue", F.date_sub("as_of", days_back).alias("_then"))
    past = fu.select("instrument_id", F.col("as_of").alias("_past_date"), F.col("revenue").alias("_past"))
    joined = pit.asof(now, past, ["instrument_id"], "_then", "_past_date", ["_past"])
    return joined.select("instrument_id", "as_of", F.when(F.col("_past") > 0, F.col("revenue") / F.col("_past") - 1).alias("revenue_growth_yoy"))


def reports(ea: DataFrame) -> DataFrame:
    """One row per report: the last known estimate and result, each the latest that isn't null."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("observed_on"))).alias(c)
    return ea.groupBy("instrument_id", "earnings_date").agg(last("eps_estimate"), last("eps_actual"))


def earnings_features(px: DataFrame, ea: DataFrame) -> DataFrame:
    done = reports(ea).where("eps_actual is not null")
    w = Window.partitionBy("instrument_id").orderBy("earnings_date")
    base = F.lag("eps_actual", 4).over(w)
    derived = done.select(
        "instrument_id", "earnings_date", F.col("earnings_date").alias("last_report"),
        F.when(base > 0, F.col("eps_actual") / base - 1).alias("eps_growth_yoy"),
        F.when(F.col("eps_estimate") != 0, (F.col("eps_actual") - F.col("eps_estimate")) / F.abs("eps_estimate")).alias("eps_surprise"),
    )
    out = reduce(lambda p, c: pit.ffill(p, derived, ["instrument_id"], "earnings_date", c), ["last_report", "eps_growth_yoy", "eps_surprise"], px.select("instrument_id", "d"))
    since = F.datediff("d", "last_report")
    return out.select("instrument_id", "d", since.alias("days_since_earnings"), F.exp(-F.ln(F.lit(2.0)) * since / 21).alias("earnings_recency"), "eps_growth_yoy", "eps_surprise")


def sector_breadth(sx: DataFrame) -> DataFrame:
    """Share of sector benchmarks above their 50-session mean, where at least half are computable."""
    w = Window.partitionBy("sector_id").orderBy("d")
    flags = sx.select("d", F.when(rolling(F.avg, "adj", 50, w).isNotNull(), (F.col("adj") > rolling(F.avg, "adj", 50, w)).cast("int")).alias("above"))
    n = sx.select("sector_id").distinct().agg(F.count("*").alias("n"))
    per_day = flags.groupBy("d").agg(F.avg("above").alias("share"), F.count("above").alias("known")).crossJoin(F.broadcast(n))
    return per_day.select("d", F.when(F.col("known") >= F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") / 2)), F.col("share")).alias("sector_breadth_ma50"))


def to_narrow(wide: DataFrame, keys: list[str]) -> DataFrame:
    """Feature rows (keys, feature, value); what is absent has no row."""
    names = [c for c in wide.columns if c not in keys]
    return wide.select(*keys, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(keys, names, "feature", "value").where("value is not null")
