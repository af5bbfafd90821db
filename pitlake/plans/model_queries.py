"""Queries of the regime models: active regimes per date, their evidence as known then, scores, verdicts and sections.

The grid is the first session of each quarter, for the earnings model alone that of each month (its regimes last 14 days). Features without a source in the panel (forward P/E, policy rate, payrolls, retail
sales, output, housing, sentiment) have no rows, so rules that need them are never active. Evidence of a regime at a date pools
all instruments and earlier dates whose outcome was complete by then.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlake.functions import stats
from pitlake.operators import evidence as evd
from pitlake.operators import features as ft
from pitlake.operators import grammar as gr
from pitlake.operators import pit
from pitlake.plans.feature_queries import BY, PRICE, REL, SECT, filled, on_days, relative, rolled, with_sector
from pitlake.plans.registry import CTE, Tables, query
from pitlake.sources import sinks
from pitlake.sources.versioned import VersionedTable

MODELS = tuple(gr.TEXTS)
DECILES = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
HORIZON = 21

# Features by what they belong to: instrument, sector benchmark, market -------------------------------------------

FUND = ("pe_trailing", "profit_margin", "price_to_sales")
SECTOR = ("ret_5d", "ret_21d", "ret_63d", "ret_126d", *REL, "rel_ret_spy_accel_21d")
MARKET = ("cpi_yoy", "cpi_yoy_accel", "curve_slope_10y2y", "vix_pctile_252d", "vix_chg_21d", "unrate_chg_6m")


def own_features(t: Tables, names: set[str]) -> DataFrame:
    keys = ["instrument_id", "d"]
    groups = [
        lambda: ft.price_features(t.px),
        lambda: relative(t).withColumn("rel_ret_spy_accel_21d", ft.change("rel_ret_spy_21d", 21)),
        lambda: ft.relative_returns(with_sector(t), t.sx, ["sector_id", "d"], "sector"),
        lambda: ft.fundamental_features(t.px, t.fu),
        lambda: pit.ffill(t.px.select(*keys), ft.revenue_growth(t.fu), ["instrument_id"], "as_of", "revenue_growth_yoy"),
        lambda: ft.earnings_features(t.px, t.ea),
    ]
    found = [(df, sorted(names.intersection(df.columns))) for df in (g() for g in groups)]
    return reduce(DataFrame.unionByName, [ft.to_narrow(df.select(*keys, *columns), keys) for df, columns in found if columns])


def sector_features(t: Tables) -> DataFrame:
    sx = t.sx.withColumnRenamed("sector_id", "instrument_id")
    rel = ft.relative_returns(sx, t.bm, ["d"], "spy").withColumn("rel_ret_spy_accel_21d", ft.change("rel_ret_spy_21d", 21))
    rows = [ft.to_narrow(df, ["instrument_id", "d"]) for df in (ft.returns(sx, (5, 21, 63, 126)), rel)]
    return rows[0].unionByName(rows[1]).select(F.col("instrument_id").alias("sector_id"), "d", F.concat(F.lit("etf:"), "feature").alias("feature"), "value")


def market_features(t: Tables) -> DataFrame:
    dated = {
        "cpi_yoy": ft.year_on_year(t.mo, "CPI"), "cpi_yoy_accel": ft.year_on_year(t.mo, "CPI", 3), "curve_slope_10y2y": ft.curve_slope(t.mo, "DGS10", "DGS2"),
        "vix_pctile_252d": ft.trailing_percentile(t.mo, "VIX"), "vix_chg_21d": ft.macro_change(t.mo, "VIX", 21), "unrate_chg_6m": ft.macro_change(t.mo, "UNRATE", 6),
        "vix": t.mo.where("code = 'VIX'"), "move": ft.macro_change(t.mo, "DGS10", 63),
    }
    days = reduce(lambda a, b: a.join(b, "d"), [ft.on_calendar(t.cal, df, name) for name, df in dated.items()])
    days = days.withColumn("curve_slope_10y2y_chg_63d", ft.change("curve_slope_10y2y", 63, ft.market_days()))
    days = days.withColumn("regime_high_vol", F.col("vix") > 15).withColumn("regime_rising_rates", F.col("move") > 0.25).withColumn("regime_falling_rates", F.col("move") < -0.25)
    ma = ft.rolling(F.avg, "adj", 200, ft.market_days())
    index = t.bm.select("d", (F.col("adj") > ma).alias("regime_bull"), *[ft.growth("adj", n, ft.market_days()).alias(f"spy_ret_{n}d") for n in (5, 21, 63, 126)])
    return ft.to_narrow(days.drop("vix", "move"), ["d"]).unionByName(ft.to_narrow(index, ["d"]))


def quarters(t: Tables) -> DataFrame:
    return t.cal.groupBy(F.trunc("d", "quarter").alias("q")).agg(F.min("d").alias("as_of")).select("as_of")


def months(t: Tables) -> DataFrame:
    return t.cal.groupBy(F.trunc("d", "month").alias("m")).agg(F.min("d").alias("as_of")).select("as_of")


def active(t: Tables, *models: str, dates: DataFrame | None = None) -> DataFrame:
    """(instrument, as_of, model, family, label); market states have the same rows for every instrument."""
    rows = gr.rules(*models)
    table = t.spark.createDataFrame(rows, gr.SCHEMA)
    names = {r[5] for r in rows}
    grid = [r["as_of"] for r in (quarters(t) if dates is None else dates).collect()]  # at most one a session
    keys = ["instrument_id", "as_of"]
    market = gr.state(market_features(t), grid, [], DECILES)
    if models == ("macro",):
        return gr.active(market, table, ["as_of"], DECILES)
    own = gr.state(own_features(t, names), grid, ["instrument_id"], DECILES)
    sectors = gr.state(sector_features(t), grid, ["sector_id"], DECILES)
    inst = F.broadcast(t.inst.select("instrument_id", "sector_id"))
    seen = own.select(*keys).distinct()
    states = own.unionByName(sectors.join(inst, "sector_id").drop("sector_id").join(seen, keys, "left_semi")).unionByName(seen.join(F.broadcast(market), "as_of"))
    found = gr.active(states, table, keys, DECILES).join(inst, "instrument_id", "left")
    return found.select(*keys, "model", "family", F.replace("label", F.lit("{etf}"), F.concat(F.lit("sector "), F.coalesce(F.col("sector_id").cast("string"), F.lit("?")))).alias("label"))


_own = [("pf", c) for cs in PRICE.values() for c in cs] + [("rb", c) for c in REL] + [("rs", c.replace("spy", "sector")) for c in REL]
_fills = [("fuf", c, "as_of") for c in FUND] + [("rg", "revenue_growth_yoy", "as_of"), ("ed", "eps_growth_yoy", "earnings_date"), ("ed", "eps_surprise", "earnings_date")]


def _narrow(table: str, columns: list[str], keys: str, prefix: str = "") -> str:
    return f"SELECT {keys}, '{prefix}' || feature AS feature, value FROM (SELECT {keys}, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in columns)} FROM {table}) UNPIVOT (value FOR feature IN ({', '.join(columns)}))"


CTE["acc"] = (("rb",), f"SELECT instrument_id, d, rel_ret_spy_21d - lag(rel_ret_spy_21d, 21) OVER ({BY}) AS rel_ret_spy_accel_21d FROM rb")
CTE["pechg"] = (("px", "fuf"), f"SELECT instrument_id, d, pe_trailing - lag(pe_trailing, 63) OVER ({BY}) AS pe_trailing_chg_63d FROM ({filled('fuf', 'pe_trailing', 'as_of')})")
CTE["sincedays"] = (("since",), "SELECT instrument_id, d, d - last_report AS days_since_earnings FROM since")
CTE["ownf"] = (
    ("pf", "rb", "rs", "acc", "px", "fuf", "rg", "ed", "pechg", "sincedays"),
    " UNION ALL ".join(
        [_narrow(n, [c for m, c in _own if m == n], "instrument_id, d") for n in ("pf", "rb", "rs")]
        + [_narrow("acc", ["rel_ret_spy_accel_21d"], "instrument_id, d"), _narrow("pechg", ["pe_trailing_chg_63d"], "instrument_id, d"), _narrow("sincedays", ["days_since_earnings"], "instrument_id, d")]
        + [_narrow(f"({filled(n, c, d)})", [c], "instrument_id, d") for n, c, d in _fills]
    ),
)
CTE["sr0"] = (("rs0", "rb0"), "SELECT sector_id, d, " + ", ".join(f"rs0.b{n} AS ret_{n}d, rs0.b{n} - rb0.b{n} AS rel_ret_spy_{n}d" for n in (5, 21, 63, 126)) + " FROM rs0 LEFT JOIN rb0 USING (d)")
CTE["sr"] = (("sr0",), f"SELECT *, rel_ret_spy_21d - lag(rel_ret_spy_21d, 21) OVER ({SECT}) AS rel_ret_spy_accel_21d FROM sr0")
CTE["sectf"] = (("sr",), _narrow("sr", list(SECTOR), "sector_id, d", "etf:"))
CTE["mseries"] = (
    ("yoy", "slope", "pct", "mo"),
    "SELECT 'cpi_yoy' AS code, obs_date, available_from, value FROM yoy UNION ALL SELECT 'cpi_yoy_accel', a.obs_date, a.available_from, a.value - b.value FROM yoy a JOIN yoy b ON a.obs_date = b.obs_date + INTERVAL 3 MONTH"
    " UNION ALL SELECT 'curve_slope_10y2y', obs_date, available_from, value FROM slope UNION ALL SELECT 'vix_pctile_252d', obs_date, available_from, CASE WHEN len(seen) = 252 THEN len(list_filter(seen, lambda x: x <= value)) / 252.0 END FROM pct"
    + "".join(f" UNION ALL SELECT '{name}', obs_date, available_from, value - lag(value, {n}) OVER (ORDER BY obs_date) FROM mo WHERE code = '{c}'" for name, c, n in (("vix_chg_21d", "VIX", 21), ("unrate_chg_6m", "UNRATE", 6), ("move", "DGS10", 63)))
    + " UNION ALL SELECT 'vix', obs_date, available_from, value FROM mo WHERE code = 'VIX'",
)
CTE["mdays"] = (("cal", "mseries"), "SELECT cal.d, s.code, CAST(a.value AS DOUBLE) AS value FROM cal CROSS JOIN (SELECT DISTINCT code FROM mseries) s ASOF LEFT JOIN mseries a ON a.code = s.code AND cal.d >= a.available_from")
CTE["mktf"] = (
    ("mdays", "bm", "rb0"),
    "SELECT d, code AS feature, value FROM mdays WHERE code NOT IN ('vix', 'move') AND value IS NOT NULL UNION ALL SELECT d, 'curve_slope_10y2y_chg_63d', value - lag(value, 63) OVER (ORDER BY d) FROM mdays WHERE code = 'curve_slope_10y2y'"
    " UNION ALL SELECT d, 'regime_high_vol', CASE WHEN value > 15 THEN 1.0 ELSE 0.0 END FROM mdays WHERE code = 'vix' AND value IS NOT NULL UNION ALL SELECT d, 'regime_rising_rates', CASE WHEN value > 0.25 THEN 1.0 ELSE 0.0 END FROM mdays WHERE code = 'move' AND value IS NOT NULL"
    " UNION ALL SELECT d, 'regime_falling_rates', CASE WHEN value < -0.25 THEN 1.0 ELSE 0.0 END FROM mdays WHERE code = 'move' AND value IS NOT NULL"
    f" UNION ALL SELECT d, 'regime_bull', CASE WHEN adj > ma THEN 1.0 ELSE 0.0 END FROM (SELECT d, adj, {rolled('avg', 'adj', 200, 'ORDER BY d')} AS ma FROM bm) WHERE ma IS NOT NULL"
    + "".join(f" UNION ALL SELECT d, 'spy_ret_{n}d', b{n} FROM rb0 WHERE b{n} IS NOT NULL" for n in (5, 21, 63, 126)),
)
CTE["quarters"] = (("cal",), "SELECT min(d) AS as_of FROM cal GROUP BY date_trunc('quarter', d)")
_lit = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
CTE["rules"] = ((), "SELECT model, family, priority, label, k, feature, op, q::DOUBLE AS q, lim::DOUBLE AS lim FROM (VALUES " + ", ".join(f"({', '.join(_lit(x) for x in r)})" for r in gr.rules(*MODELS)) + ") t(model, family, priority, label, k, feature, op, q, lim)")
_state = "SELECT {k}as_of, feature, arg_max(value, d) AS value, CASE WHEN count(value) >= 252 THEN quantile_cont(value, {q}) END AS q FROM {n} JOIN {g} ON d <= as_of WHERE value IS NOT NULL AND feature IN (SELECT feature FROM rules{w}) GROUP BY ALL"
for _end, _grid, _where in (("", "quarters", ""), ("m", "months", " WHERE model = 'earnings'")):
    for _name, _from, _keys in (("ownst", "ownf", "instrument_id, "), ("sectst", "sectf", "sector_id, "), ("mktst", "mktf", "")):
        CTE[_name + _end] = ((_from, _grid, "rules"), _state.format(k=_keys, n=_from, q=DECILES, g=_grid, w=_where))
_cond = "CASE op WHEN '>=' THEN value >= x WHEN '<=' THEN value <= x WHEN '>' THEN value > x WHEN '<' THEN value < x ELSE value = x END"


def _active(states: str, keys: str) -> str:
    return (
        f"SELECT {keys}, model, family, arg_min(label, priority) AS label FROM (SELECT {keys}, model, family, priority, label, k FROM"
        f" (SELECT s.*, r.*, coalesce(r.lim, CASE WHEN r.q IS NOT NULL THEN s.q[CAST(round(r.q * 10) AS INTEGER)] END) AS x FROM ({states}) s JOIN rules r USING (feature)) WHERE {_cond}"
        f" GROUP BY ALL HAVING count(*) = k) GROUP BY ALL"
    )


CTE["mktact"] = (("mktst", "rules"), _active("SELECT * FROM mktst", "as_of"))
for _end in ("", "m"):
    _own, _sect, _mkt = f"ownst{_end}", f"sectst{_end}", f"mktst{_end}"
    CTE[f"ract0{_end}"] = (
        (_own, _sect, _mkt, "rules", "inst"),
        _active(f"SELECT * FROM {_own} UNION ALL SELECT instrument_id, as_of, feature, value, q FROM {_sect} JOIN inst USING (sector_id) SEMI JOIN {_own} USING (instrument_id, as_of) UNION ALL SELECT instrument_id, as_of, feature, value, q FROM (SELECT DISTINCT instrument_id, as_of FROM {_own}) JOIN {_mkt} USING (as_of)", "instrument_id, as_of"),
    )
    CTE[f"ract{_end}"] = ((f"ract0{_end}", "inst"), f"SELECT instrument_id, as_of, model, family, replace(label, '{{etf}}', 'sector ' || coalesce(CAST(sector_id AS VARCHAR), '?')) AS label FROM ract0{_end} LEFT JOIN inst USING (instrument_id)")

for _m in MODELS:
    if _m == "macro":
        query("mod_macro", "mktact", "SELECT as_of, family, label FROM mktact WHERE model = 'macro'", stored=True)(lambda t: active(t, "macro").select("as_of", "family", "label"))
    elif _m == "earnings":
        query("mod_earnings", "ractm", "SELECT instrument_id, as_of, family, label FROM ractm WHERE model = 'earnings'", stored=True)(lambda t: active(t, "earnings", dates=months(t)).select("instrument_id", "as_of", "family", "label"))
    else:
        query(f"mod_{_m}", "ract", f"SELECT instrument_id, as_of, family, label FROM ract WHERE model = '{_m}'", stored=True)(lambda t, m=_m: active(t, m).select("instrument_id", "as_of", "family", "label"))

# Evidence as known at the date, scores, verdicts -----------------------------------------------------------------

MARKS = ["model", "family", "label"]
#: The six horizons in sessions.
HORIZONS = (5, 10, 21, 63, 126, 252)
_marks, _keys = "model, family, label", "model, family, label, horizon, as_of"
CTE["fx6"] = (("px",), " UNION ALL ".join(f"SELECT instrument_id, d, {h} AS horizon, lead(adj, {h}) OVER ({BY}) / adj - 1 AS fwd, lead(d, {h}) OVER ({BY}) AS exit_day FROM px" for h in HORIZONS))
CTE["lastd"] = (("px", "quarters"), "SELECT i.instrument_id, as_of, p.d FROM (SELECT DISTINCT instrument_id FROM px) i CROSS JOIN quarters ASOF JOIN (SELECT instrument_id, d FROM px) p ON p.instrument_id = i.instrument_id AND quarters.as_of >= p.d")
CTE["gridfx6"] = (("lastd", "fx6"), "SELECT instrument_id, as_of, horizon, fwd, exit_day FROM lastd JOIN fx6 USING (instrument_id, d)")
CTE["gridfx"] = (("gridfx6",), f"SELECT instrument_id, as_of, fwd, exit_day FROM gridfx6 WHERE horizon = {HORIZON}")
CTE["base"] = (("gridfx",), "SELECT exit_day, sum(n) OVER (ORDER BY exit_day) AS n, sum(s) OVER (ORDER BY exit_day) AS s FROM (SELECT exit_day, count(*) AS n, sum(fwd) AS s FROM gridfx WHERE fwd IS NOT NULL GROUP BY 1)")
CTE["out6"] = (("gridfx6", "quarters"), "SELECT g.*, q.as_of AS known FROM (SELECT * FROM gridfx6 WHERE fwd IS NOT NULL) g ASOF JOIN quarters q ON g.exit_day <= q.as_of")
CTE["ev6"] = (("ract", "out6"), f"SELECT {_marks}, horizon, as_of AS u, fwd AS x, known, pow(2, (as_of - DATE '{evd.ORIGIN}') / 365.25 / {evd.HALF_LIFE}) AS e FROM ract JOIN out6 USING (instrument_id, as_of)")
CTE["mo6"] = (
    ("ev6",),
    f"SELECT {_marks}, horizon, known, " + ", ".join(f"sum({c}) OVER w AS {c}" for c in ("n", "w", "w2", "wx", "wxx", "wh")) + f", min(u0) OVER w AS first_event, max(u1) OVER w AS last_event FROM (SELECT {_marks}, horizon, known, count(*) AS n, sum(e) AS w, sum(e * e) AS w2, sum(e * x) AS wx, sum(e * x * x) AS wxx, sum(CASE WHEN x > 0 THEN e ELSE 0.0::DOUBLE END) AS wh, min(u) AS u0, max(u) AS u1 FROM ev6 GROUP BY ALL)"
    f" WINDOW w AS (PARTITION BY {_marks}, horizon ORDER BY known)",
)
CTE["asked"] = (("ract",), f"SELECT DISTINCT {_marks}, as_of FROM ract")
CTE["cnt6"] = (("asked", "ev6"), f"SELECT {_keys}, u, count(*)::DOUBLE AS c FROM asked JOIN ev6 USING ({_marks}) WHERE known <= as_of GROUP BY ALL")
CTE["sm6"] = (("cnt6", "quarters"), f"SELECT {', '.join('c.' + k for k in _keys.split(', '))}, v.as_of AS spot, sum(c.c * greatest(0, 1 - abs(v.as_of - c.u) / (1.4::DOUBLE * c.horizon))) AS s FROM cnt6 c JOIN quarters v ON abs(v.as_of - c.u) < 1.4 * c.horizon GROUP BY ALL")
CTE["gr6"] = (("cnt6", "sm6"), f"SELECT {_keys}, sum(c * s) AS gram FROM cnt6 JOIN sm6 USING ({_keys}) WHERE spot = u GROUP BY ALL")
CTE["base6"] = (("out6", "quarters"), "SELECT q.as_of, horizon, sum(fwd) / count(*) AS base FROM quarters q JOIN out6 o ON o.known <= q.as_of GROUP BY 1, 2")
CTE["stu6"] = (
    ("gr6", "mo6", "base6"),
    f"SELECT {_keys}, n, size * n / gram AS n_eff, gram / n AS inflation, mean, wh / w AS hit_rate, base, mean - base AS effect, sqrt(spread / (size - 1) * gram / n) AS se, first_event, last_event, gram FROM (SELECT g.*, m.* EXCLUDE ({_marks}, horizon), b.base, w * w / w2 AS size, wx / w AS mean, wxx / w - (wx / w) * (wx / w) AS spread"
    f" FROM gr6 g ASOF JOIN mo6 m ON g.model = m.model AND g.family = m.family AND g.label = m.label AND g.horizon = m.horizon AND g.as_of >= m.known JOIN base6 b ON b.horizon = g.horizon AND b.as_of = g.as_of) WHERE n >= {evd.LEAST} AND size > 1 + 1e-9 AND spread > {evd.SPREAD}",
)
CTE["rev6"] = (("ract", "stu6"), f"SELECT instrument_id, s.* FROM ract JOIN stu6 s USING ({_marks}, as_of)")
_same = lambda a, b, cols: " AND ".join(f"{a}.{x} = {b}.{y}" for x, y in cols)
CTE["pair6"] = (("rev6",), "SELECT DISTINCT a.model, a.horizon, a.as_of, a.family AS fa, a.label AS la, b.family AS fb, b.label AS lb, a.gram AS ga, b.gram AS gb FROM rev6 a JOIN rev6 b USING (instrument_id, as_of, model, horizon) WHERE (a.family, a.label) < (b.family, b.label)")
CTE["rho6"] = (
    ("pair6", "cnt6", "sm6"),
    "SELECT *, crossed / sqrt(ga * gb) AS rho FROM (SELECT p.*, coalesce(sum(c.c * s.s), 0) AS crossed FROM pair6 p JOIN cnt6 c ON c.model = p.model AND c.family = p.fa AND c.label = p.la AND c.horizon = p.horizon AND c.as_of = p.as_of LEFT JOIN sm6 s ON s.model = p.model AND s.family = p.fb AND s.label = p.lb AND s.horizon = p.horizon AND s.as_of = p.as_of AND s.spot = c.u GROUP BY ALL)",
)
_best = lambda sign, name: f"(SELECT instrument_id, as_of, model, horizon, string_agg(label, '; ' ORDER BY place) AS {name} FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id, as_of, model, horizon ORDER BY round(abs(effect) / se, 6) DESC, label) AS place FROM rev6 WHERE effect {sign} 0) WHERE place <= 3 GROUP BY 1, 2, 3, 4)"
_cell = "instrument_id, as_of, model, horizon"
CTE["magg"] = (
    ("rev6", "rho6", "ract"),
    f"SELECT *, 100 * ({stats.norm_cdf_sql('z')}) AS score, least(1, greatest(0, n_eff / (n_eff + {evd.PRIOR_EVENTS}) * agreement)) AS confidence, abs(z_raw) > {evd.Z_CLIP} AS saturated FROM (SELECT *, greatest(-{evd.Z_CLIP}, least({evd.Z_CLIP}, z_raw)) AS z FROM"
    f" (SELECT {_cell}, studies, effect, expected, hit_rate, n_eff, events, active, coalesce(correlation, 0) AS correlation, effect * w / sqrt(w + 2 * coalesce(crossed, 0)) AS z_raw, CASE WHEN effect >= 0 THEN up ELSE w - up END / w AS agreement, supporting, negative FROM (SELECT {_cell}, count(*) AS studies, sum(1 / (se * se)) AS w, sum(effect / (se * se)) / sum(1 / (se * se)) AS effect, sum(mean / (se * se)) / sum(1 / (se * se)) AS expected, sum(hit_rate / (se * se)) / sum(1 / (se * se)) AS hit_rate, max(n_eff) AS n_eff, sum(CASE WHEN effect >= 0 THEN 1 / (se * se) ELSE 0.0::DOUBLE END) AS up, max(n) AS events FROM rev6 GROUP BY ALL)"
    f" LEFT JOIN (SELECT {_cell}, sum(rho / (a.se * b.se)) AS crossed, avg(rho) AS correlation FROM rev6 a JOIN rev6 b USING ({_cell}) JOIN rho6 r ON r.model = a.model AND r.horizon = a.horizon AND r.as_of = a.as_of AND r.fa = a.family AND r.la = a.label AND r.fb = b.family AND r.lb = b.label GROUP BY ALL) USING ({_cell})"
    f" LEFT JOIN {_best('>', 'supporting')} USING ({_cell}) LEFT JOIN {_best('<', 'negative')} USING ({_cell}) JOIN (SELECT instrument_id, as_of, model, count(*) AS active FROM ract GROUP BY ALL) USING (instrument_id, as_of, model)))",
)
CTE["rev"] = (("rev6",), f"SELECT instrument_id, as_of, {_marks}, n, effect, se FROM rev6 WHERE horizon = {HORIZON}")
CTE["msc"] = (("magg",), f"SELECT instrument_id, as_of, model, studies AS regimes, events AS n, effect, score FROM magg WHERE horizon = {HORIZON}")


def outcomes(t: Tables) -> DataFrame:
    """Forward return of each instrument at each date of the grid from its latest session, per horizon, and the day it is complete."""
    if not hasattr(t, "_outcomes"):
        own = Window.partitionBy("instrument_id").orderBy("d")
        each = [F.struct(F.lit(h).alias("horizon"), (F.lead("adj", h).over(own) / F.col("adj") - 1).alias("fwd"), F.lead("d", h).over(own).alias("exit_day")) for h in HORIZONS]
        cells = t.inst.select("instrument_id").crossJoin(F.broadcast(quarters(t)))
        found = pit.asof(cells, t.px.select("instrument_id", "d", F.array(*each).alias("o")), ["instrument_id"], "as_of", "d", ["o"])
        t._outcomes = sinks.written(found.select("instrument_id", "as_of", F.inline("o")), "outcomes")
    return t._outcomes


def grid_outcomes(t: Tables) -> DataFrame:
    """The outcomes of the main horizon; cells before an instrument's first session are there without one."""
    cells = t.inst.select("instrument_id").crossJoin(F.broadcast(quarters(t)))
    return cells.join(outcomes(t).where(F.col("horizon") == HORIZON).drop("horizon"), ["instrument_id", "as_of"], "left")


def known_active(t: Tables, *models: str) -> DataFrame:
    """:func:`active`, written once per set of models."""
    cache = t.__dict__.setdefault("_active", {})
    if models not in cache:
        cache[models] = sinks.written(active(t, *models), "active")
    return cache[models]


def studies(t: Tables, *models: str) -> DataFrame:
    """Evidence of all horizons, written once: every later step reads it."""
    cache = t.__dict__.setdefault("_studies", {})
    if models not in cache:
        found, dates = known_active(t, *models), quarters(t)
        rows = sinks.written(evd.events(found, outcomes(t), dates), "events")
        cache[models] = sinks.written(evd.collect(found, evd.running_moments(rows, MARKS), evd.counted_dates(rows, found, MARKS), evd.running_base(outcomes(t), dates), MARKS), "studies")
    return cache[models]


def evidence(t: Tables, *models: str) -> DataFrame:
    return studies(t, *models).where(F.col("horizon") == HORIZON).select("instrument_id", "as_of", *MARKS, "n", "effect", "se")


def aggregated(t: Tables, *models: str) -> DataFrame:
    """Scores per instrument, date, model and horizon with their diagnostics."""
    cache = t.__dict__.setdefault("_aggregated", {})
    if models not in cache:
        rows = studies(t, *models)
        count = known_active(t, *models).groupBy("instrument_id", "as_of", "model").agg(F.count("*").alias("active"))
        cache[models] = sinks.written(evd.aggregate(rows, evd.correlations(rows, MARKS), count, MARKS), "aggregated")
    return cache[models]


def scores(t: Tables, *models: str) -> DataFrame:
    return aggregated(t, *models).where(F.col("horizon") == HORIZON).select("instrument_id", "as_of", "model", F.col("studies").alias("regimes"), F.col("events").alias("n"), "effect", "score")


STUDY = ("n_eff", "inflation", "mean", "hit_rate", "base", "effect", "se")
query("mod_collect_evidence", "rev6", f"SELECT instrument_id, {_keys}, n, {', '.join(f'round({c}, 6) AS {c}' for c in STUDY)}, first_event, last_event FROM rev6", stored=True)(
    lambda t: studies(t, *MODELS).select("instrument_id", *MARKS, "horizon", "as_of", "n", *[F.round(c, 6).alias(c) for c in STUDY], "first_event", "last_event")
)
AGGREGATE = ("effect", "expected", "hit_rate", "n_eff", "correlation", "agreement", "z_raw", "z", "score", "confidence")
query("mod_aggregate_horizon", "magg", f"SELECT {_cell}, studies, events, active, {', '.join(f'round({c}, 5) AS {c}' for c in AGGREGATE)}, saturated, supporting, negative FROM magg", stored=True)(
    lambda t: aggregated(t, *MODELS).select(*evd.CELL, "studies", "events", "active", *[F.round(c, 5).alias(c) for c in AGGREGATE], "saturated", "supporting", "negative")
)
CAPTURED = "instrument_id long, as_of date, model string, horizon int, marker string, reason string, score double, confidence double, expected double, effect double, batch int"
FIRST_RUN = "1995-01-01"
CTE["capcell"] = (("inst", "quarters", "lastd"), f"SELECT i.instrument_id, q.as_of, m.model, h.horizon, l.d FROM inst i CROSS JOIN quarters q CROSS JOIN (VALUES {', '.join(f'({m!r})' for m in MODELS)}) m(model) CROSS JOIN (VALUES {', '.join(f'({h})' for h in HORIZONS)}) h(horizon) LEFT JOIN lastd l ON l.instrument_id = i.instrument_id AND l.as_of = q.as_of")


@query(
    "wf_capture",
    "magg capcell ract",
    f"SELECT {_cell}, CASE WHEN d IS NULL THEN 'omitted' WHEN score IS NULL THEN 'neutral' WHEN NOT isfinite(score) THEN 'model_error' ELSE 'evidence' END AS marker, CASE WHEN d IS NULL THEN 'no session' WHEN score IS NOT NULL THEN NULL WHEN k.active IS NULL THEN 'no active regime' ELSE 'thin evidence' END AS reason, round(score, 4) AS score, round(confidence, 5) AS confidence, round(expected, 6) AS expected, round(effect, 6) AS effect, CASE WHEN as_of < DATE '{FIRST_RUN}' THEN 0 ELSE 1 END AS batch"
    " FROM capcell LEFT JOIN magg USING (instrument_id, as_of, model, horizon) LEFT JOIN (SELECT instrument_id, as_of, model, count(*) AS active FROM ract GROUP BY ALL) k USING (instrument_id, as_of, model)",
    stored=True,
)
def capture(t: Tables) -> DataFrame:
    """Every model at every cell and horizon, in two runs into one table: the second meets the whole grid and adds only cells
    that the first has not stored. A cell has evidence, is neutral (with the reason), was omitted for want of data, or failed.
    """
    table = VersionedTable(t.spark, sinks.scratch(t.spark, "capture"), CAPTURED, F.year("as_of"))
    cells = outcomes(t).select("instrument_id", "as_of", F.lit(True).alias("seen")).distinct()
    lists = lambda names, kind: F.explode(F.array(*[F.lit(n).cast(kind) for n in names]))
    grid = t.inst.select("instrument_id").crossJoin(F.broadcast(quarters(t))).join(cells, ["instrument_id", "as_of"], "left").withColumn("model", lists(MODELS, "string")).withColumn("horizon", lists(HORIZONS, "int"))
    active_count = known_active(t, *MODELS).groupBy("instrument_id", "as_of", "model").agg(F.count("*").alias("k"))
    rows = grid.join(aggregated(t, *MODELS).select(*evd.CELL, "score", "confidence", "expected", "effect"), evd.CELL, "left").join(active_count, ["instrument_id", "as_of", "model"], "left")
    finite = ~F.isnan("score") & (F.abs("score") < float("inf"))
    marker = F.when(F.col("seen").isNull(), "omitted").when(F.col("score").isNull(), "neutral").when(~finite, "model_error").otherwise("evidence")
    reason = F.when(F.col("seen").isNull(), "no session").when(F.col("score").isNotNull(), F.lit(None)).when(F.col("k").isNull(), "no active regime").otherwise("thin evidence")
    whole = rows.select(*evd.CELL, marker.alias("marker"), reason.alias("reason"), "score", "confidence", "expected", "effect")
    for batch, part in enumerate((whole.where(F.col("as_of") < F.lit(FIRST_RUN).cast("date")), whole)):
        fresh = part.join(table.read().select("instrument_id", "as_of").distinct(), ["instrument_id", "as_of"], "left_anti").withColumn("batch", F.lit(batch))
        table.merge(fresh, lambda stored, new: stored.unionByName(new), "capture", batch)
    return table.read().select(*evd.CELL, "marker", "reason", F.round("score", 4).alias("score"), *[F.round(c, n).alias(c) for c, n in (("confidence", 5), ("expected", 6), ("effect", 6))], "batch")


_side = f"CASE WHEN regexp_matches(label, '{gr.EXPENSIVE}') THEN 'expensive' WHEN regexp_matches(label, '{gr.CHEAP}') THEN 'cheap' ELSE 'neither' END"
_fits = " ".join(f"WHEN side = '{s}' AND sign = '{g}' AND regexp_matches(label, '{'|'.join(c)}') THEN '{w}'" for s, g, c, w in gr.VERDICTS)
query("mod_valuation_verdict", "rev", f"SELECT instrument_id, as_of, label, CASE {_fits} END AS verdict FROM (SELECT *, {_side} AS side, CASE WHEN effect > 0 THEN 'good' ELSE 'bad' END AS sign FROM (SELECT * FROM rev WHERE model = 'valuation' QUALIFY row_number() OVER (PARTITION BY instrument_id, as_of ORDER BY round(abs(effect) / se, 6) DESC, family) = 1))", stored=True)(
    lambda t: evidence(t, "valuation").withColumn("rank", F.row_number().over(Window.partitionBy("instrument_id", "as_of").orderBy(F.round(F.abs("effect") / F.col("se"), 6).desc(), "family"))).where("rank = 1")
    .select("instrument_id", "as_of", "label", gr.verdict(F.col("label"), F.col("effect")).alias("verdict"))
)
#: The models that speak in each section.
SECTIONS = (("company", "valuation"), ("company", "earnings"), ("technical", "momentum"), ("technical", "relative"), ("macro", "macro"), ("market", "macro"), ("sector", "sector"), ("catalysts", "earnings"))
_mean = "round(avg(score), 6)"
query("eng_section_verdict", "msc ownst gridfx", f"SELECT instrument_id, as_of, section, CASE WHEN {_mean} IS NULL THEN 'no active evidence' WHEN {_mean} >= 60 THEN 'supportive' WHEN {_mean} <= 40 THEN 'unfavorable' ELSE 'mixed' END AS verdict FROM (SELECT DISTINCT instrument_id, as_of FROM gridfx WHERE instrument_id IS NOT NULL) CROSS JOIN (VALUES {', '.join(str(s) for s in SECTIONS)}) v(section, model) LEFT JOIN msc USING (instrument_id, as_of, model) GROUP BY 1, 2, 3", stored=True)(
    lambda t: sections(t)
)


def sections(t: Tables) -> DataFrame:
    cells = grid_outcomes(t).join(t.px.groupBy("instrument_id").agg(F.min("d").alias("first")), "instrument_id").where("first <= as_of").select("instrument_id", "as_of")
    table = t.spark.createDataFrame(list(SECTIONS), "section string, model string")
    mean = F.round(F.avg("score"), 6)
    verdict = F.when(mean.isNull(), "no active evidence").when(mean >= 60, "supportive").when(mean <= 40, "unfavorable").otherwise("mixed")
    return cells.crossJoin(F.broadcast(table)).join(scores(t, *MODELS), ["instrument_id", "as_of", "model"], "left").groupBy("instrument_id", "as_of", "section").agg(verdict.alias("verdict"))


# Notes between horizons ---------------------------------------------------------------------------------------------

#: Points of a jump, and of a drop of confidence.
JUMP, DROP = 20.0, 0.25
CTE["adj"] = (
    ("magg",),
    f"SELECT instrument_id, as_of, model, horizon, lead(horizon) OVER w AS next_horizon, score, lead(score) OVER w AS s2, confidence, lead(confidence) OVER w AS c2, driver, lead(driver) OVER w AS d2 FROM (SELECT *, split_part(CASE WHEN effect > 0 THEN supporting WHEN effect < 0 THEN negative END, '; ', 1) AS driver FROM magg) WINDOW w AS (PARTITION BY instrument_id, as_of, model ORDER BY horizon)",
)


@query(
    "eng_cross_horizon", "adj",
    f"SELECT instrument_id, as_of, model, horizon, next_horizon, abs(s2 - score) >= {JUMP} AS jump, (score - 50) * (s2 - 50) < 0 AS reversal, confidence - c2 >= {DROP} AS confidence_drop, CASE WHEN driver IS DISTINCT FROM d2 THEN coalesce(driver, '-') || ' -> ' || coalesce(d2, '-') END AS driver_change FROM adj"
    f" WHERE next_horizon IS NOT NULL AND (abs(s2 - score) >= {JUMP} OR (score - 50) * (s2 - 50) < 0 OR confidence - c2 >= {DROP} OR driver IS DISTINCT FROM d2)",
    stored=True,
)
def cross_horizon(t: Tables) -> DataFrame:
    """What changes from one horizon to the next in a model's scores of a cell: a jump, the side, confidence, or the largest driver."""
    w = Window.partitionBy("instrument_id", "as_of", "model").orderBy("horizon")
    best = F.when(F.col("effect") > 0, F.col("supporting")).when(F.col("effect") < 0, F.col("negative"))
    rows = aggregated(t, *MODELS).withColumn("driver", F.split_part(best, F.lit("; "), F.lit(1)))
    rows = rows.select("instrument_id", "as_of", "model", "horizon", F.lead("horizon").over(w).alias("next_horizon"), "score", F.lead("score").over(w).alias("s2"), "confidence", F.lead("confidence").over(w).alias("c2"), "driver", F.lead("driver").over(w).alias("d2"))
    changed = F.when(~F.col("driver").eqNullSafe(F.col("d2")), F.concat(F.coalesce("driver", F.lit("-")), F.lit(" -> "), F.coalesce("d2", F.lit("-"))))
    notes = rows.where("next_horizon is not null").select(
        "instrument_id", "as_of", "model", "horizon", "next_horizon", (F.abs(F.col("s2") - F.col("score")) >= JUMP).alias("jump"), ((F.col("score") - 50) * (F.col("s2") - 50) < 0).alias("reversal"), (F.col("confidence") - F.col("c2") >= DROP).alias("confidence_drop"), changed.alias("driver_change")
    )
    return notes.where("jump or reversal or confidence_drop or driver_change is not null")
