"""Queries of the feature calculators and point-in-time primitives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.operators import features as ft
from pitlake.operators import pit
from pitlake.plans.registry import CTE, Tables, query

BY = "PARTITION BY instrument_id ORDER BY d"


def rolled(fn: str, x: str, n: int, by: str = BY) -> str:
    over = f"OVER ({by} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {over} = {n} THEN {fn}({x}) {over} END"


def grown(x: str, n: int, by: str = BY) -> str:
    return f"({x} / nullif(lag({x}, {n}) OVER ({by}), 0) - 1)"


def rounded(df: DataFrame, *columns: str, keys: tuple[str, ...] = ("instrument_id", "d"), digits: int = 6) -> DataFrame:
    return df.select(*keys, *[F.round(c, digits).alias(c) for c in columns])


def sql_rounded(table: str, *columns: str, keys: str = "instrument_id, d") -> str:
    return f"SELECT {keys}, {', '.join(f'round({c}, 6) AS {c}' for c in columns)} FROM {table}"


# Price features -----------------------------------------------------------------------------------------------

CTE["f0"] = (("px",), f"SELECT *, {grown('adj', 1)} AS daily, lag(close) OVER ({BY}) AS pc FROM px")
CTE["f1"] = (
    ("f0",),
    f"SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, {rolled('avg', 'adj', 50)} AS ma50, {rolled('avg', 'adj', 200)} AS ma200,"
    f" {rolled('stddev_samp', 'daily', 21)} * sqrt(252.0) AS vol_21d, {rolled('stddev_samp', 'daily', 63)} * sqrt(252.0) AS vol_63d, {rolled('max', 'close', 252)} AS top, {rolled('min', 'close', 252)} AS bottom FROM f0",
)
CTE["f2"] = (("f1",), "SELECT *, ma50 / nullif(ma200, 0) - 1 AS ma50_ma200_spread FROM f1")
RETS = {f"ret_{n}d": grown("adj", n) for n in (1, 5, 21, 63, 126, 252)}
CTE["pf"] = (
    ("f2",),
    f"SELECT instrument_id, d, {', '.join(f'{e} AS {c}' for c, e in RETS.items())}, ln(adj / nullif(lag(adj) OVER ({BY}), 0)) AS log_ret_1d, open / nullif(pc, 0) - 1 AS gap_1d, adj / nullif(ma50, 0) - 1 AS price_to_ma50,"
    f" adj / nullif(ma200, 0) - 1 AS price_to_ma200, ma50_ma200_spread, ma50_ma200_spread - lag(ma50_ma200_spread, 21) OVER ({BY}) AS ma50_ma200_spread_chg_21d, vol_21d, vol_63d,"
    f" CASE WHEN vol_63d > 0 THEN vol_21d / vol_63d - 1 END AS vol_ratio_21_63, {rolled('avg', 'tr', 14)} / nullif(close, 0) AS atr14_pct, close / nullif(top, 0) - 1 AS dist_52w_high, close / nullif(bottom, 0) - 1 AS dist_52w_low FROM f2",
)
PRICE = {
    "feat_ret": tuple(RETS), "feat_log_ret": ("log_ret_1d",), "feat_gap": ("gap_1d",), "feat_price_to_ma": ("price_to_ma50", "price_to_ma200"), "feat_ma_spread": ("ma50_ma200_spread",),
    "feat_ma_spread_chg": ("ma50_ma200_spread_chg_21d",), "feat_vol": ("vol_21d", "vol_63d"), "feat_vol_ratio": ("vol_ratio_21_63",), "feat_atr": ("atr14_pct",), "feat_dist_52w": ("dist_52w_high", "dist_52w_low"),
}
for _key, _columns in PRICE.items():
    query(_key, "pf", sql_rounded("pf", *_columns))(lambda t, c=_columns: rounded(ft.price_features(t.px), *c))

REL = tuple(f"rel_ret_spy_{n}d" for n in (5, 21, 63, 126))
CTE["rb0"] = (("bm",), "SELECT d, " + ", ".join(f"{grown('adj', n, 'ORDER BY d')} AS b{n}" for n in (5, 21, 63, 126)) + " FROM bm")
CTE["rb1"] = (("px",), "SELECT instrument_id, d, " + ", ".join(f"{grown('adj', n)} AS r{n}" for n in (5, 21, 63, 126)) + " FROM px")
CTE["rb"] = (("rb0", "rb1"), "SELECT instrument_id, d, " + ", ".join(f"r{n} - b{n} AS rel_ret_spy_{n}d" for n in (5, 21, 63, 126)) + " FROM rb1 LEFT JOIN rb0 USING (d)")
SECT = "PARTITION BY sector_id ORDER BY d"
CTE["pxs"] = (("px", "inst"), "SELECT px.*, sector_id FROM px LEFT JOIN inst USING (instrument_id)")
CTE["rs0"] = (("sx",), "SELECT sector_id, d, " + ", ".join(f"{grown('adj', n, SECT)} AS b{n}" for n in (5, 21, 63, 126)) + " FROM sx")
CTE["rs1"] = (("pxs",), "SELECT instrument_id, sector_id, d, " + ", ".join(f"{grown('adj', n)} AS r{n}" for n in (5, 21, 63, 126)) + " FROM pxs")
CTE["rs"] = (("rs0", "rs1"), "SELECT instrument_id, d, " + ", ".join(f"r{n} - b{n} AS rel_ret_sector_{n}d" for n in (5, 21, 63, 126)) + " FROM rs1 LEFT JOIN rs0 USING (sector_id, d)")


def with_sector(t: Tables) -> DataFrame:
    return t.px.join(F.broadcast(t.inst.select("instrument_id", "sector_id")), "instrument_id", "left")


def relative(t: Tables) -> DataFrame:
    return ft.relative_returns(t.px, t.bm, ["d"], "spy")


query("feat_rel_ret_bench", "rb", sql_rounded("rb", *REL))(lambda t: rounded(relative(t), *REL))
query("feat_rel_ret_sector", "rs", sql_rounded("rs", *[c.replace("spy", "sector") for c in REL]))(
    lambda t: rounded(ft.relative_returns(with_sector(t), t.sx, ["sector_id", "d"], "sector"), *[c.replace("spy", "sector") for c in REL])
)
query("feat_rel_accel", "rb", f"SELECT instrument_id, d, round(rel_ret_spy_21d - lag(rel_ret_spy_21d, 21) OVER ({BY}), 6) AS rel_ret_spy_accel_21d FROM rb")(
    lambda t: rounded(relative(t).withColumn("rel_ret_spy_accel_21d", ft.change("rel_ret_spy_21d", 21)), "rel_ret_spy_accel_21d")
)

# Macro and market features ------------------------------------------------------------------------------------


def on_days(name: str, code: str) -> str:
    """SQL: a dated series ``name`` as known on each day of the calendar."""
    return f"SELECT cal.d, a.value AS {code} FROM cal ASOF LEFT JOIN {name} a ON cal.d >= a.available_from"


def market(key: str, column: str, needs: str, series_sql: str, f) -> None:
    CTE[f"s_{key}"] = (tuple(needs.split()), series_sql)
    query(key, f"cal s_{key}", f"SELECT d, round({column}, 9) AS {column} FROM ({on_days(f's_{key}', column)})")(lambda t: rounded(ft.on_calendar(t.cal, f(t), column), column, keys=("d",), digits=9))


OBS = "PARTITION BY code ORDER BY obs_date"
for _key, _column, _code in (("feat_macro_level", "vix_level", "VIX"),):
    market(_key, _column, "mo", f"SELECT * FROM mo WHERE code = '{_code}'", lambda t, c=_code: t.mo.where(F.col("code") == c))
market("feat_macro_chg", "dgs10_chg_63d", "mo", f"SELECT obs_date, available_from, value - lag(value, 63) OVER ({OBS}) AS value FROM mo WHERE code = 'DGS10'", lambda t: ft.macro_change(t.mo, "DGS10", 63))
CTE["slope"] = (("mo",), "SELECT a.obs_date, a.value - b.value AS value, greatest(a.available_from, b.available_from) AS available_from FROM mo a JOIN mo b ON a.obs_date = b.obs_date AND a.code = 'DGS10' AND b.code = 'DGS2'")
market("feat_curve_slope", "curve_slope_10y2y", "slope", "SELECT * FROM slope", lambda t: ft.curve_slope(t.mo, "DGS10", "DGS2"))
query("feat_market_chg", "cal slope", f"SELECT d, round(x - lag(x, 63) OVER (ORDER BY d), 9) AS curve_slope_10y2y_chg_63d FROM ({on_days('slope', 'x')})")(
    lambda t: rounded(ft.on_calendar(t.cal, ft.curve_slope(t.mo, "DGS10", "DGS2"), "x").withColumn("curve_slope_10y2y_chg_63d", ft.change("x", 63, ft.market_days())), "curve_slope_10y2y_chg_63d", keys=("d",), digits=9)
)
CTE["yoy"] = (("mo",), "SELECT a.obs_date, a.available_from, a.value / nullif(b.value, 0) - 1 AS value FROM mo a JOIN mo b ON a.code = 'CPI' AND b.code = 'CPI' AND a.obs_date = b.obs_date + INTERVAL 12 MONTH")
market("feat_macro_yoy", "cpi_yoy", "yoy", "SELECT * FROM yoy", lambda t: ft.year_on_year(t.mo, "CPI"))
market("feat_macro_yoy_accel", "cpi_yoy_accel", "yoy", "SELECT a.obs_date, a.available_from, a.value - b.value AS value FROM yoy a JOIN yoy b ON a.obs_date = b.obs_date + INTERVAL 3 MONTH", lambda t: ft.year_on_year(t.mo, "CPI", 3))
CTE["pct"] = (("mo",), "SELECT obs_date, available_from, value, list(value) OVER (PARTITION BY code ORDER BY obs_date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS seen FROM mo WHERE code = 'VIX' AND value IS NOT NULL")
market("feat_macro_pctile", "vix_pctile_252d", "pct", "SELECT obs_date, available_from, CASE WHEN len(seen) = 252 THEN len(list_filter(seen, lambda x: x <= value)) / 252.0 END AS value FROM pct", lambda t: ft.trailing_percentile(t.mo, "VIX"))

# Fundamentals and earnings ------------------------------------------------------------------------------------


CTE["fuf"] = (("fu",), "SELECT instrument_id, as_of, pe_trailing, profit_margin, CASE WHEN market_cap > 0 THEN log10(market_cap) END AS log_market_cap, CASE WHEN revenue > 0 THEN market_cap / revenue END AS price_to_sales FROM fu")


def filled(table: str, column: str, date: str) -> str:
    return f"SELECT px.instrument_id, px.d, f.{column} FROM px ASOF LEFT JOIN (SELECT * FROM {table} WHERE {column} IS NOT NULL) f ON px.instrument_id = f.instrument_id AND px.d >= f.{date}"


for _key, _column in (("feat_fund_field", "pe_trailing"), ("feat_fund_log10", "log_market_cap"), ("feat_price_to_sales", "price_to_sales")):
    query(_key, "px fuf", f"SELECT instrument_id, d, round({_column}, 6) AS {_column} FROM ({filled('fuf', _column, 'as_of')})")(lambda t, c=_column: rounded(ft.fundamental_features(t.px, t.fu), c))
query("feat_fund_chg", "px fuf", f"SELECT instrument_id, d, round(pe_trailing - lag(pe_trailing, 63) OVER ({BY}), 6) AS pe_trailing_chg_63d FROM ({filled('fuf', 'pe_trailing', 'as_of')})")(
    lambda t: rounded(ft.fundamental_features(t.px, t.fu), "pe_trailing_chg_63d")
)
CTE["rg"] = (("fu",), "SELECT a.instrument_id, a.as_of, CASE WHEN b.revenue > 0 THEN a.revenue / b.revenue - 1 END AS revenue_growth_yoy FROM fu a ASOF LEFT JOIN fu b ON a.instrument_id = b.instrument_id AND a.as_of - 350 >= b.as_of")
query("feat_revenue_growth", "px rg", f"SELECT instrument_id, d, round(revenue_growth_yoy, 6) AS revenue_growth_yoy FROM ({filled('rg', 'revenue_growth_yoy', 'as_of')})")(
    lambda t: rounded(pit.ffill(t.px.select("instrument_id", "d"), ft.revenue_growth(t.fu), ["instrument_id"], "as_of", "revenue_growth_yoy"), "revenue_growth_yoy")
)
CTE["rep"] = (("ea",), "SELECT instrument_id, earnings_date, arg_max(eps_estimate, observed_on) FILTER (eps_estimate IS NOT NULL) AS eps_estimate, arg_max(eps_actual, observed_on) FILTER (eps_actual IS NOT NULL) AS eps_actual FROM ea GROUP BY 1, 2")
CTE["ed"] = (
    ("rep",),
    "SELECT instrument_id, earnings_date, earnings_date AS last_report, CASE WHEN lag(eps_actual, 4) OVER w > 0 THEN eps_actual / lag(eps_actual, 4) OVER w - 1 END AS eps_growth_yoy,"
    " CASE WHEN eps_estimate <> 0 THEN (eps_actual - eps_estimate) / abs(eps_estimate) END AS eps_surprise FROM rep WHERE eps_actual IS NOT NULL WINDOW w AS (PARTITION BY instrument_id ORDER BY earnings_date)",
)
query("feat_eps_growth", "px ed", f"SELECT instrument_id, d, round(eps_growth_yoy, 6) AS eps_growth_yoy FROM ({filled('ed', 'eps_growth_yoy', 'earnings_date')})")(lambda t: rounded(ft.earnings_features(t.px, t.ea), "eps_growth_yoy"))
query("feat_eps_surprise", "px ed", f"SELECT instrument_id, d, round(eps_surprise, 6) AS eps_surprise FROM ({filled('ed', 'eps_surprise', 'earnings_date')})")(lambda t: rounded(ft.earnings_features(t.px, t.ea), "eps_surprise"))
CTE["since"] = (("px", "ed"), filled("ed", "last_report", "earnings_date"))
query("feat_days_since", "since", "SELECT instrument_id, d, CAST(d - last_report AS INTEGER) AS days_since_earnings FROM since")(lambda t: ft.earnings_features(t.px, t.ea).select("instrument_id", "d", "days_since_earnings"))
query("feat_earnings_recency", "since", "SELECT instrument_id, d, round(exp(-ln(2.0) * (d - last_report) / 21), 6) AS earnings_recency FROM since")(lambda t: rounded(ft.earnings_features(t.px, t.ea), "earnings_recency"))
UNTIL = "SELECT px.instrument_id, px.d, min(e.earnings_date) AS next_event FROM px LEFT JOIN (SELECT DISTINCT instrument_id, earnings_date, min(observed_on) OVER (PARTITION BY instrument_id, earnings_date) AS known FROM ea) e ON e.instrument_id = px.instrument_id AND e.known <= px.d AND e.earnings_date > px.d GROUP BY 1, 2"


def until(t: Tables) -> DataFrame:
    return pit.known_min_future(t.px.select("instrument_id", "d"), t.ea, "instrument_id", "earnings_date", "observed_on")


query("pit_known_min_future", "px ea", UNTIL)(until)
query("feat_days_until", "px ea", f"SELECT instrument_id, d, CAST(next_event - d AS INTEGER) AS days_until_earnings FROM ({UNTIL})")(lambda t: until(t).select("instrument_id", "d", F.datediff("next_event", "d").alias("days_until_earnings")))

# Regimes ------------------------------------------------------------------------------------------------------

query("feat_regime_bull", "bm", f"SELECT d, CASE WHEN ma IS NOT NULL THEN CASE WHEN adj > ma THEN 1.0 ELSE 0.0 END END::DOUBLE AS regime_bull FROM (SELECT d, adj, {rolled('avg', 'adj', 200, 'ORDER BY d')} AS ma FROM bm)")(
    lambda t: t.bm.withColumn("ma", ft.rolling(F.avg, "adj", 200, ft.market_days())).select("d", (F.col("adj") > F.col("ma")).cast("double").alias("regime_bull"))
)
query("feat_regime_high_vol", "cal mo", f"SELECT d, CASE WHEN v > 15 THEN 1.0 WHEN v <= 15 THEN 0.0 END::DOUBLE AS regime_high_vol FROM ({on_days('(SELECT * FROM mo WHERE code = ' + chr(39) + 'VIX' + chr(39) + ')', 'v')})")(
    lambda t: ft.on_calendar(t.cal, t.mo.where("code = 'VIX'"), "v").select("d", (F.col("v") > 15).cast("double").alias("regime_high_vol"))
)
query("feat_regime_rates", "cal s_feat_macro_chg", f"SELECT d, CASE WHEN v > 0.25 THEN 1.0 WHEN v <= 0.25 THEN 0.0 END::DOUBLE AS regime_rising_rates, CASE WHEN v < -0.25 THEN 1.0 WHEN v >= -0.25 THEN 0.0 END::DOUBLE AS regime_falling_rates FROM ({on_days('s_feat_macro_chg', 'v')})")(
    lambda t: ft.on_calendar(t.cal, ft.macro_change(t.mo, "DGS10", 63), "v").select("d", (F.col("v") > 0.25).cast("double").alias("regime_rising_rates"), (F.col("v") < -0.25).cast("double").alias("regime_falling_rates"))
)
query("feat_sector_breadth", "sx", f"SELECT d, CASE WHEN count(f) >= greatest(1, floor((SELECT count(DISTINCT sector_id) FROM sx) / 2)) THEN round(avg(f), 6) END AS sector_breadth_ma50 FROM (SELECT d, CASE WHEN ma IS NOT NULL THEN CASE WHEN adj > ma THEN 1 ELSE 0 END END AS f FROM (SELECT d, adj, {rolled('avg', 'adj', 50, SECT)} AS ma FROM sx)) GROUP BY d")(
    lambda t: rounded(ft.sector_breadth(t.sx), "sector_breadth_ma50", keys=("d",))
)

# The store: narrow, wide, versions ----------------------------------------------------------------------------

STORE = ("price_to_ma50", "ret_21d", "vol_21d")
CTE["store"] = (("pf",), "SELECT instrument_id, d, feature, round(value, 6) AS value FROM pf UNPIVOT (value FOR feature IN (price_to_ma50, ret_21d, vol_21d))")


def store(t: Tables, names: tuple[str, ...] = STORE) -> DataFrame:
    """The narrow feature store of some price features."""
    return ft.to_narrow(ft.price_features(t.px).select("instrument_id", "d", *names), ["instrument_id", "d"]).withColumn("value", F.round("value", 6))


query("pit_wide_to_narrow", "store", "SELECT instrument_id, d, feature, round(value, 6) AS value FROM store")(lambda t: store(t).withColumn("value", F.round("value", 6)))
WIDE = "SELECT instrument_id, d, " + ", ".join(f"round(max(value) FILTER (feature = '{c}'), 6) AS {c}" for c in STORE) + " FROM store GROUP BY 1, 2"
query("pit_narrow_to_wide", "store", WIDE)(lambda t: rounded(store(t).groupBy("instrument_id", "d").pivot("feature", list(STORE)).agg(F.first("value")), *STORE))
query("src_feature_matrix", "store cal mo", f"SELECT w.*, round(m.vix_level, 9) AS vix_level FROM ({WIDE}) w LEFT JOIN ({on_days('(SELECT * FROM mo WHERE code = ' + chr(39) + 'VIX' + chr(39) + ')', 'vix_level')}) m USING (d)")(
    lambda t: rounded(store(t).groupBy("instrument_id", "d").pivot("feature", list(STORE)).agg(F.first("value")), *STORE).join(F.broadcast(ft.on_calendar(t.cal, t.mo.where("code = 'VIX'"), "vix_level")).select("d", F.round("vix_level", 9).alias("vix_level")), "d", "left")
)
CTE["versions"] = (("store",), "SELECT *, 1 AS version FROM store UNION ALL SELECT instrument_id, d, feature, value * 2, 2 FROM store WHERE feature = 'ret_21d'")
query("src_feature_series", "versions", "SELECT instrument_id, d, version, round(value, 6) AS value FROM versions WHERE feature = 'ret_21d' AND version = (SELECT max(version) FROM versions WHERE feature = 'ret_21d')")(
    lambda t: (lambda v: v.join(F.broadcast(v.groupBy("feature").agg(F.max("version").alias("version"))), ["feature", "version"]).select("instrument_id", "d", "version", F.round("value", 6).alias("value")))(
        store(t).withColumn("version", F.lit(1)).union(store(t).where("feature = 'ret_21d'").withColumn("value", F.col("value") * 2).withColumn("version", F.lit(2))).where("feature = 'ret_21d'")
    )
)
ALL = [c for cs in PRICE.values() for c in cs]
query("feat_build_all", "pf rb", "SELECT instrument_id, feature, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT instrument_id, feature, value FROM pf UNPIVOT (value FOR feature IN (" + ", ".join(ALL) + ")) UNION ALL SELECT instrument_id, feature, value FROM rb UNPIVOT (value FOR feature IN (" + ", ".join(REL) + "))) GROUP BY 1, 2")(
    lambda t: ft.to_narrow(ft.price_features(t.px), ["instrument_id", "d"]).union(ft.to_narrow(relative(t), ["instrument_id", "d"])).groupBy("instrument_id", "feature").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
)

# Point-in-time primitives -------------------------------------------------------------------------------------

CTE["mo_nulls"] = (("mo",), "SELECT code, obs_date, available_from, CASE WHEN day(obs_date) % 7 = 3 THEN NULL ELSE value END AS value FROM mo WHERE frequency = 'D'")


def daily_with_nulls(t: Tables) -> DataFrame:
    return t.mo.where("frequency = 'D'").withColumn("value", F.when(F.dayofmonth("obs_date") % 7 != 3, F.col("value")))


ALIGN = "SELECT cal.d, s.code, a.obs_date, round(a.value, 9) AS value FROM cal CROSS JOIN (SELECT DISTINCT code FROM mo_nulls) s ASOF LEFT JOIN {} a ON a.code = s.code AND cal.d >= a.available_from"
query("pit_align_availability", "cal mo_nulls", ALIGN.format("mo_nulls"))(lambda t: pit.align_availability(t.cal, daily_with_nulls(t)).select("d", "code", "obs_date", F.round("value", 9).alias("value")))
query("pit_ffill_asof", "cal mo_nulls", ALIGN.format("(SELECT * FROM mo_nulls WHERE value IS NOT NULL)"))(
    lambda t: pit.align_availability(t.cal, daily_with_nulls(t).where("value is not null")).select("d", "code", "obs_date", F.round("value", 9).alias("value"))
)
CTE["days"] = ((), "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders")


def order_days(t: Tables) -> DataFrame:
    return t.table("orders").select(F.to_date("o_orderdate").alias("day")).distinct()


query("pit_latest_close", "px days", "SELECT i.instrument_id, days.day, px.d AS close_date, round(px.close, 10) AS close FROM days CROSS JOIN (SELECT DISTINCT instrument_id FROM px) i ASOF LEFT JOIN px ON px.instrument_id = i.instrument_id AND days.day >= px.d")(
    lambda t: pit.asof(order_days(t).crossJoin(t.px.select("instrument_id").distinct()), t.px.withColumn("close_date", F.col("d")), ["instrument_id"], "day", "d", ["close_date", "close"]).withColumn("close", F.round("close", 10))
)
CTE["sectors_dated"] = (("inst",), "SELECT instrument_id, DATE '1993-01-01' + CAST(k * 400 AS INTEGER) AS as_of, CASE WHEN k = 1 AND instrument_id % 3 = 0 THEN NULL ELSE (sector_id + k) % 5 END AS sector FROM inst CROSS JOIN range(3) r(k)")


def sectors_dated(t: Tables) -> DataFrame:
    k = t.inst.crossJoin(t.spark.range(3).withColumnRenamed("id", "k"))
    return k.select("instrument_id", F.date_add(F.lit("1993-01-01").cast("date"), (F.col("k") * 400).cast("int")).alias("as_of"), F.when(~((F.col("k") == 1) & (F.col("instrument_id") % 3 == 0)), (F.col("sector_id") + F.col("k")) % 5).alias("sector"))


query("pit_sector_asof", "px sectors_dated", filled("sectors_dated", "sector", "as_of"))(lambda t: pit.ffill(t.px.select("instrument_id", "d"), sectors_dated(t), ["instrument_id"], "as_of", "sector"))
CTE["renames"] = (("inst",), "SELECT 'T' || (instrument_id % 7) AS ticker, instrument_id AS security_id, DATE '1992-01-01' + CAST(instrument_id * 120 AS INTEGER) AS valid_from FROM inst")
CTE["tickers"] = (("renames",), "SELECT *, lead(valid_from) OVER (PARTITION BY ticker ORDER BY valid_from) AS valid_to FROM renames")


def renames(t: Tables) -> DataFrame:
    return t.inst.select(F.concat(F.lit("T"), (F.col("instrument_id") % 7).cast("string")).alias("ticker"), F.col("instrument_id").alias("security_id"), F.date_add(F.lit("1992-01-01").cast("date"), (F.col("instrument_id") * 120).cast("int")).alias("valid_from"))


query("pit_rename", "tickers", "SELECT * FROM tickers")(lambda t: pit.close_intervals(renames(t), "ticker"))
query("pit_interval_resolve", "tickers days", "SELECT days.day, ticker, security_id FROM days CROSS JOIN (SELECT DISTINCT ticker FROM tickers) k JOIN tickers USING (ticker) WHERE valid_from <= day AND (valid_to IS NULL OR day < valid_to)")(
    lambda t: pit.interval_resolve(order_days(t).crossJoin(renames(t).select("ticker").distinct()), F.broadcast(pit.close_intervals(renames(t), "ticker")), ["ticker"], "day").select("day", "ticker", "security_id")
)
query("pit_session_offset", "cal days", "SELECT day, e.d AS entry, x.d AS exit_day FROM days ASOF LEFT JOIN cal e ON day >= e.d LEFT JOIN cal x ON x.idx = e.idx + 21")(
    lambda t: pit.session_offset(pit.session_at(order_days(t), t.cal, "day"), t.cal, 21, "exit_day").select("day", "entry", "exit_day")
)
query("pit_truncate_as_of", "px", "SELECT g.as_of, instrument_id, count(*) AS n, max(d) AS last_day FROM px JOIN (SELECT DISTINCT CAST(date_trunc('year', d) AS DATE) AS as_of FROM px) g ON px.d <= g.as_of GROUP BY 1, 2")(
    lambda t: t.px.select("instrument_id", "d").join(F.broadcast(t.cal.select(F.trunc("d", "year").alias("as_of")).distinct()), F.col("d") <= F.col("as_of")).groupBy("as_of", "instrument_id").agg(F.count("*").alias("n"), F.max("d").alias("last_day"))
)
CUT = "DATE '1997-06-30'"
CTE["obs"] = (
    ("px", "cal"),
    f"SELECT g.instrument_id, g.d, CASE WHEN g.d > {CUT} THEN 'after_cutoff' WHEN last_pos IS NULL THEN 'missing_calendar' WHEN p.pos IS NULL THEN 'unavailable' WHEN p.pos + 63 > last_pos THEN 'crosses_cutoff' ELSE 'eligible' END AS reason"
    " FROM (SELECT instrument_id, d FROM (SELECT DISTINCT instrument_id FROM px) CROSS JOIN (SELECT d FROM cal)) g LEFT JOIN (SELECT instrument_id, d, row_number() OVER (PARTITION BY instrument_id ORDER BY d) AS pos FROM px) p USING (instrument_id, d)"
    f" LEFT JOIN (SELECT instrument_id, count(*) AS last_pos FROM px WHERE d <= {CUT} GROUP BY 1) l ON l.instrument_id = g.instrument_id",
)


def observability(t: Tables) -> DataFrame:
    grid = t.px.select("instrument_id").distinct().crossJoin(F.broadcast(t.cal.select("d")))
    return pit.label_observability(grid, t.px, F.lit("1997-06-30").cast("date"), 63)


query("pit_label_observable", "obs", "SELECT reason, count(*) AS n FROM obs GROUP BY 1")(lambda t: observability(t).groupBy("reason").agg(F.count("*").alias("n")))
query(
    "pit_leakage_report", "obs",
    "SELECT instrument_id, count(*) AS used, count(*) FILTER (reason = 'eligible') AS observable, count(*) FILTER (reason IN ('after_cutoff', 'crosses_cutoff')) AS embargoed, count(*) FILTER (reason IN ('unavailable', 'missing_calendar')) AS unavailable,"
    " count(*) - count(*) FILTER (reason = 'eligible') AS violations, round(count(*) FILTER (reason IN ('after_cutoff', 'crosses_cutoff')) * 100.0 / count(*), 6)::DOUBLE AS embargo_pct FROM obs GROUP BY 1",
)(
    lambda t: observability(t).groupBy("instrument_id").agg(
        F.count("*").alias("used"), F.count_if(F.col("reason") == "eligible").alias("observable"), F.count_if(F.col("reason").isin("after_cutoff", "crosses_cutoff")).alias("embargoed"), F.count_if(F.col("reason").isin("unavailable", "missing_calendar")).alias("unavailable"),
    ).withColumn("violations", F.col("used") - F.col("observable")).withColumn("embargo_pct", F.round(F.col("embargoed") * 100.0 / F.col("used"), 6))
)
query("pit_rebuild_window", "px", f"SELECT instrument_id, d, round(v, 6) AS price_to_ma50 FROM (SELECT instrument_id, d, adj / nullif({rolled('avg', 'adj', 50)}, 0) - 1 AS v FROM px WHERE d >= DATE '1997-06-30' - 20 - 110) WHERE d >= DATE '1997-06-30' - 20 AND v IS NOT NULL")(
    lambda t: rounded(ft.price_features(t.px.where("d >= date_sub(date'1997-06-30', 130)")).where("d >= date_sub(date'1997-06-30', 20)").where("price_to_ma50 is not null"), "price_to_ma50")
)
