"""Queries of the analogue search: every instrument at every date of the quarterly grid, four domains, twelve configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlake.functions import stats
from pitlake.operators import analogues as an
from pitlake.operators import evidence as evd
from pitlake.operators import features as ft
from pitlake.operators import pit
from pitlake.plans import model_queries as mq
from pitlake.plans.feature_queries import BY
from pitlake.plans.registry import CTE, Tables, query
from pitlake.sources import sinks

MARKET = ("cpi_yoy", "cpi_yoy_accel", "curve_slope_10y2y", "curve_slope_10y2y_chg_63d", "vix_pctile_252d", "vix_chg_21d", "unrate_chg_6m", "regime_bull", "regime_high_vol", "spy_ret_63d")
SECTOR = ("etf:ret_21d", "etf:ret_63d", "etf:rel_ret_spy_63d")
HOLDING = ("rel_ret_sector_21d", "rel_ret_sector_63d", "rel_ret_sector_126d")
COMPANY = ("ret_5d", "ret_21d", "ret_63d", "ret_126d", "vol_21d", "vol_ratio_21_63", "price_to_ma50", "price_to_ma200", "dist_52w_high", "rel_ret_spy_21d", "rel_ret_spy_63d", "atr14_pct")
CATALYSTS = ("days_since_earnings", "eps_surprise")
OF = {"market": {"market_map": MARKET}, "sector": {"sector_map": SECTOR, "own_map": HOLDING}, "company": {"own_map": COMPANY}, "catalysts": {"own_map": CATALYSTS}}
MOMENTS = {"market_map": "market_mom", "sector_map": "sector_mom", "own_map": "own_mom"}
HORIZONS = mq.HORIZONS


def history(t: Tables) -> dict[str, DataFrame]:
    """The three narrow tables of features, written once."""
    if not hasattr(t, "_history"):
        rows = {"own": (mq.own_features(t, {*HOLDING, *COMPANY, *CATALYSTS}), (*HOLDING, *COMPANY, *CATALYSTS)), "sector": (mq.sector_features(t), SECTOR), "market": (mq.market_features(t), MARKET)}
        t._history = {n: sinks.written(df.where(F.col("feature").isin(*names) & F.col("value").isNotNull()).withColumn("value", F.col("value").cast("double")), n) for n, (df, names) in rows.items()}
    return t._history


def positions(t: Tables) -> DataFrame:
    return pit.positions(t.px.select("instrument_id", "d", "adj")).join(F.broadcast(t.inst.select("instrument_id", "sector_id")), "instrument_id", "left")


def cells(t: Tables) -> DataFrame:
    """Instrument and date of the grid with its latest session and that session's place."""
    grid = t.inst.select("instrument_id").crossJoin(F.broadcast(mq.quarters(t)))
    own = positions(t).select("instrument_id", "sector_id", "d", F.col("d").alias("day"), "pos")
    return pit.asof(grid, own, ["instrument_id"], "as_of", "day", ["d", "pos", "sector_id"]).where("pos is not null").withColumnRenamed("pos", "target_pos")


def vectors(t: Tables) -> DataFrame:
    """Per instrument and session the four vectors."""
    if not hasattr(t, "_vectors"):
        h = history(t)
        rows = positions(t).drop("adj").join(an.as_map(h["own"], ["instrument_id"], "own_map"), ["instrument_id", "d"], "left")
        rows = rows.join(an.as_map(h["sector"], ["sector_id"], "sector_map"), ["sector_id", "d"], "left").join(an.as_map(h["market"], [], "market_map"), "d", "left")
        t._vectors = sinks.written(rows.select("instrument_id", "sector_id", "d", "pos", *[an.picked(of).alias(f"v_{n}") for n, of in OF.items()]), "vectors")
    return t._vectors


def targets(t: Tables) -> DataFrame:
    """Cells with the moments as of their session and their own standardised vectors."""
    if not hasattr(t, "_targets"):
        h, rows = history(t), cells(t)
        rows = an.moments_at(rows, h["own"], ["instrument_id"], "own_mom")
        rows = an.moments_at(rows, h["sector"], ["sector_id"], "sector_mom")
        rows = an.moments_at(rows, h["market"], [], "market_mom")
        rows = rows.join(vectors(t).drop("pos", "sector_id"), ["instrument_id", "d"])
        moments = {n: an.picked({MOMENTS[m]: f for m, f in of.items()}) for n, of in OF.items()}
        rows = rows.select("instrument_id", "as_of", "target_pos", F.col("d").alias("target_d"), "sector_id", *[c.alias(f"m_{n}") for n, c in moments.items()], *[F.col(f"v_{n}").alias(f"own_{n}") for n in OF])
        rows = rows.withColumns({f"t_{n}": an.standardised(F.col(f"own_{n}"), F.col(f"m_{n}")) for n in OF}).drop(*[f"own_{n}" for n in OF])
        t._targets = sinks.written(rows.withColumn("has_sector", F.exists("m_sector", lambda m: m.isNotNull())), "targets")
    return t._targets


def sims(t: Tables) -> DataFrame:
    if not hasattr(t, "_sims"):
        t._sims = sinks.written(an.similarities(an.candidates(targets(t).drop("sector_id", "target_d"), vectors(t).drop("sector_id"))), "similarities")
    return t._sims


def variants(t: Tables, *names: str) -> DataFrame:
    return t.spark.createDataFrame([v for v in an.VARIANTS if not names or v[0] in names], an.VARIANT)


def ranked(t: Tables, *names: str) -> DataFrame:
    return an.staged(sims(t), variants(t, *(names or ("full",))))


def chosen(t: Tables, *names: str) -> DataFrame:
    """The analogues of each cell: apart from each other, at most 30; cells with fewer than 10 have none."""
    rows = an.dedup_gap(ranked(t, *names), ["variant", *an.CELL, "target_pos"], most=an.MATCHES)
    n = F.count("*").over(Window.partitionBy("variant", *an.CELL))
    place = F.row_number().over(Window.partitionBy("variant", *an.CELL).orderBy("rank"))
    return rows.withColumns({"n_matches": n, "place": place}).where(F.col("n_matches") >= an.LEAST_MATCHES)


def kept(t: Tables) -> DataFrame:
    if not hasattr(t, "_kept"):
        t._kept = sinks.written(chosen(t, "full"), "analogues")
    return t._kept


def followed(t: Tables) -> DataFrame:
    """Outcomes of the analogues per cell and horizon, with what the instrument's candidates did on average."""
    if hasattr(t, "_followed"):
        return t._followed
    prices = t.px.groupBy("instrument_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "adj"))), lambda p: p["adj"]).alias("adj"))
    ends = targets(t).select("instrument_id", "as_of", "target_d", "sector_id")
    paths = an.path_metrics(kept(t), prices, HORIZONS).join(ends, an.CELL)

    def over(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("d")  # benchmark and sectors: as long as the calendar
        each = [F.struct(F.lit(h).alias("horizon"), (F.lead("adj", h).over(w) / F.col("adj") - 1).alias(name), F.lead("d", h).over(w).alias(f"{name}_end")) for h in HORIZONS]
        return df.select(*keys, "d", F.array(*each).alias("o")).select(*keys, "d", F.inline("o"))

    seen = lambda name: F.when(F.col(f"{name}_end") <= F.col("target_d"), F.col(name))
    paths = paths.join(over(t.bm, [], "market"), ["d", "horizon"], "left").join(over(t.sx, ["sector_id"], "peers"), ["sector_id", "d", "horizon"], "left").withColumns({"market": seen("market"), "peers": seen("peers")})
    each = [F.struct(F.lit(h).alias("horizon"), (F.lead("adj", h).over(ft.own_days()) / F.col("adj") - 1).alias("x")) for h in HORIZONS]
    own = positions(t).select("instrument_id", "pos", F.array(*each).alias("o")).select("instrument_id", "pos", F.inline("o"))
    upto = Window.partitionBy("instrument_id", "horizon").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = own.where((F.col("pos") > an.LEAST_HISTORY) & F.col("x").isNotNull()).select("instrument_id", "horizon", "pos", (F.sum("x").over(upto) / F.count("x").over(upto)).alias("base"))
    out = an.outcomes(paths, an.CELL).join(targets(t).select(*an.CELL, "target_pos"), an.CELL).withColumn("last", F.col("target_pos") - F.greatest(F.lit(an.LEAST_GAP), F.col("horizon")))
    t._followed = sinks.written(pit.asof(out, run, ["instrument_id", "horizon"], "last", "pos", ["base"]).drop("last", "target_pos"), "followed")
    return t._followed


# The same in SQL, feature by feature ------------------------------------------------------------------------------

_q = lambda names: ", ".join(f"'{n}'" for n in names)
CTE["apos"] = (("px", "inst"), f"SELECT instrument_id, sector_id, d, adj, row_number() OVER ({BY}) AS pos FROM px LEFT JOIN inst USING (instrument_id)")
CTE["acell"] = (("apos", "quarters", "inst"), "SELECT i.instrument_id, q.as_of, p.d, p.pos AS target_pos, p.sector_id FROM (SELECT instrument_id FROM inst) i CROSS JOIN quarters q ASOF JOIN apos p ON p.instrument_id = i.instrument_id AND q.as_of >= p.d")
CTE["ahist"] = (
    ("ownf", "sectf", "mktf"),
    f"SELECT 'own' AS src, instrument_id AS key, d, CASE WHEN feature IN ({_q(HOLDING)}) THEN 'sector' WHEN feature IN ({_q(COMPANY)}) THEN 'company' ELSE 'catalysts' END AS domain, feature, CAST(value AS DOUBLE) AS value FROM ownf WHERE feature IN ({_q((*HOLDING, *COMPANY, *CATALYSTS))}) AND value IS NOT NULL"
    f" UNION ALL SELECT 'sector', sector_id, d, 'sector', feature, CAST(value AS DOUBLE) FROM sectf WHERE feature IN ({_q(SECTOR)}) AND value IS NOT NULL UNION ALL SELECT 'market', 0, d, 'market', feature, CAST(value AS DOUBLE) FROM mktf WHERE feature IN ({_q(MARKET)}) AND value IS NOT NULL",
)
CTE["arun"] = (("ahist",), "SELECT src, key, d, domain, feature, count(*) OVER w AS n, sum(value) OVER w AS s, sum(value * value) OVER w AS ss FROM ahist WINDOW w AS (PARTITION BY src, key, feature ORDER BY d)")
CTE["akey"] = (("acell",), "SELECT instrument_id, as_of, d, target_pos, 'own' AS src, instrument_id AS key FROM acell UNION ALL SELECT instrument_id, as_of, d, target_pos, 'sector', sector_id FROM acell UNION ALL SELECT instrument_id, as_of, d, target_pos, 'market', 0 FROM acell")
CTE["amom"] = (
    ("akey", "arun"),
    f"SELECT * FROM (SELECT k.instrument_id, k.as_of, k.d AS target_d, k.src, k.key, r.domain, r.feature, r.s / r.n AS mean, sqrt(greatest(0, r.ss / r.n - (r.s / r.n) * (r.s / r.n))) AS std FROM (SELECT k.*, f.feature FROM akey k JOIN (SELECT DISTINCT src, feature FROM ahist) f USING (src)) k ASOF JOIN arun r ON r.src = k.src AND r.key = k.key AND r.feature = k.feature AND k.d >= r.d) WHERE std > {an.CONSTANT} * (1 + abs(mean))",
)
CTE["akept"] = (("amom",), "SELECT instrument_id, as_of, domain, count(*)::DOUBLE AS k FROM amom GROUP BY 1, 2, 3")
CTE["atz"] = (("amom", "ahist"), "SELECT m.*, (h.value - m.mean) / m.std AS z FROM amom m JOIN ahist h ON h.src = m.src AND h.key = m.key AND h.feature = m.feature AND h.d = m.target_d")
CTE["acand"] = (("acell", "apos"), f"SELECT c.instrument_id, c.as_of, c.target_pos, c.d AS target_d, p.d, p.pos, p.sector_id FROM acell c JOIN apos p USING (instrument_id) WHERE p.pos > {an.LEAST_HISTORY} AND p.pos <= c.target_pos - {an.LEAST_GAP}")
CTE["asims"] = (
    ("acand", "atz", "ahist", "akept"),
    "WITH x AS (SELECT c.instrument_id, c.as_of, c.d, z.domain, z.z AS a, (h.value - z.mean) / z.std AS b FROM acand c JOIN atz z USING (instrument_id, as_of) JOIN ahist h ON h.src = z.src AND h.key = z.key AND h.feature = z.feature AND h.d = c.d),"
    f" y AS (SELECT instrument_id, as_of, d, domain, sum(a * b) AS dot, sqrt(sum(a * a)) * sqrt(sum(b * b)) AS norm, count(*) / any_value(k) AS cover FROM x JOIN akept USING (instrument_id, as_of, domain) GROUP BY 1, 2, 3, 4), w AS (SELECT *, CASE WHEN cover >= {an.COVERAGE} THEN CASE WHEN norm > 0 THEN dot / norm ELSE 0.0::DOUBLE END END AS v FROM y)"
    " SELECT c.instrument_id, c.as_of, c.d, any_value(c.pos) AS pos, any_value(c.target_pos) AS target_pos, " + ", ".join(f"max(v) FILTER (domain = '{n}') AS {n}, coalesce(max(cover) FILTER (domain = '{n}'), 0) AS cover_{n}" for n in an.DOMAINS) + " FROM acand c LEFT JOIN w USING (instrument_id, as_of, d) GROUP BY 1, 2, 3",
)
CTE["avar"] = ((), "SELECT variant, w_market::DOUBLE AS w_market, w_sector::DOUBLE AS w_sector, w_company::DOUBLE AS w_company, w_catalysts::DOUBLE AS w_catalysts, km, ks FROM (VALUES " + ", ".join(map(str, an.VARIANTS)) + ") t(variant, w_market, w_sector, w_company, w_catalysts, km, ks)")
_there = lambda expr: " + ".join(f"CASE WHEN {n} IS NOT NULL THEN {expr.format(n=n)} ELSE 0.0::DOUBLE END" for n in an.DOMAINS)
_vcell = "variant, instrument_id, as_of"
CTE["arank"] = (
    ("asims", "avar", "akept"),
    f"SELECT *, row_number() OVER (PARTITION BY {_vcell} ORDER BY round(similarity, 9) DESC, d) AS rank FROM (SELECT {_vcell}, d, pos, target_pos, market, sector, company, catalysts, ({_there('w_{n} * {n}')}) / ({_there('w_{n}')}) AS similarity, ({_there('cover_{n}')}) / ({_there('1.0')}) AS coverage FROM"
    f" (SELECT *, row_number() OVER (PARTITION BY {_vcell} ORDER BY round(coalesce(sector, -2), 9) DESC, d) AS r2 FROM (SELECT s.*, v.*, k.k AS sk, row_number() OVER (PARTITION BY {_vcell} ORDER BY round(market, 9) DESC, d) AS r1 FROM asims s CROSS JOIN avar v LEFT JOIN (SELECT * FROM akept WHERE domain = 'sector') k USING (instrument_id, as_of) WHERE market IS NOT NULL) WHERE r1 <= km) WHERE (sk IS NULL OR r2 <= ks) AND company IS NOT NULL)",
)


def _dedup(which: str) -> str:
    rows = f"SELECT * FROM arank{which}"
    return (
        f"WITH RECURSIVE r0 AS ({rows}), g AS (SELECT DISTINCT {_vcell}, 0::BIGINT AS rank, []::BIGINT[] AS kept, false AS taken FROM r0 UNION ALL SELECT variant, instrument_id, as_of, rank, CASE WHEN ok THEN list_append(kept, pos) ELSE kept END, ok FROM"
        f" (SELECT g.variant, g.instrument_id, g.as_of, r.rank, g.kept, r.pos, len(g.kept) < {an.MATCHES} AND len(list_filter(g.kept, lambda p: abs(p - r.pos) < {an.LEAST_GAP})) = 0 AS ok FROM g JOIN r0 r ON r.variant = g.variant AND r.instrument_id = g.instrument_id AND r.as_of = g.as_of AND r.rank = g.rank + 1))"
        f" SELECT r0.*, row_number() OVER (PARTITION BY {_vcell} ORDER BY rank) AS place FROM r0 JOIN g USING (variant, instrument_id, as_of, rank) WHERE taken QUALIFY count(*) OVER (PARTITION BY {_vcell}) >= {an.LEAST_MATCHES}"
    )


CTE["akeep"] = (("arank",), _dedup(" WHERE variant = 'full'"))
CTE["akeepall"] = (("arank",), _dedup(""))
_six = ", ".join(f"({h})" for h in HORIZONS)
CTE["apath"] = (
    ("akeep", "apos", "acell"),
    f"WITH p AS (SELECT k.instrument_id, k.as_of, k.d, k.similarity, h.horizon, x.pos - k.pos AS step, x.adj FROM akeep k CROSS JOIN (VALUES {_six}) h(horizon) JOIN apos x ON x.instrument_id = k.instrument_id AND x.pos BETWEEN k.pos AND k.pos + h.horizon WHERE k.pos + h.horizon <= k.target_pos),"
    " q AS (SELECT *, max(adj) OVER w AS top, ln(adj / lag(adj) OVER w) AS lr, first_value(adj) OVER w AS a0 FROM p WINDOW w AS (PARTITION BY instrument_id, as_of, d, horizon ORDER BY step))"
    " SELECT instrument_id, as_of, d, horizon, any_value(similarity) AS similarity, arg_max(adj, step) / any_value(a0) - 1 AS fwd, min(adj / top - 1) AS drawdown, min(adj) FILTER (step > 0) / any_value(a0) - 1 AS mae, max(adj) FILTER (step > 0) / any_value(a0) - 1 AS mfe, stddev_samp(lr) * sqrt(252) AS vol FROM q GROUP BY 1, 2, 3, 4",
)
_lead = lambda table, key, name: " UNION ALL ".join(f"SELECT {key}d, {h} AS horizon, lead(adj, {h}) OVER w / adj - 1 AS {name}, lead(d, {h}) OVER w AS e FROM {table} WINDOW w AS ({'PARTITION BY sector_id ' if key else ''}ORDER BY d)" for h in HORIZONS)
CTE["abase"] = (("apos",), f"SELECT instrument_id, horizon, pos, sum(x) OVER w / count(x) OVER w AS base FROM (" + " UNION ALL ".join(f"SELECT instrument_id, pos, {h} AS horizon, lead(adj, {h}) OVER (PARTITION BY instrument_id ORDER BY pos) / adj - 1 AS x FROM apos" for h in HORIZONS) + f") WHERE x IS NOT NULL AND pos > {an.LEAST_HISTORY} WINDOW w AS (PARTITION BY instrument_id, horizon ORDER BY pos)")
CTE["aout"] = (
    ("apath", "acell", "bm", "sx", "abase"),
    f"WITH m AS ({_lead('bm', '', 'market')}), s AS ({_lead('sx', 'sector_id, ', 'peers')}), j AS (SELECT p.*, CASE WHEN m.e <= c.d THEN m.market END AS market, CASE WHEN s.e <= c.d THEN s.peers END AS peers, c.target_pos FROM apath p JOIN acell c USING (instrument_id, as_of) LEFT JOIN m ON m.d = p.d AND m.horizon = p.horizon LEFT JOIN s ON s.sector_id = c.sector_id AND s.d = p.d AND s.horizon = p.horizon),"
    " o AS (SELECT instrument_id, as_of, horizon, count(*) AS n, avg(fwd) AS mean, median(fwd) AS median, CASE WHEN sum(similarity) > 0 THEN sum(similarity * fwd) / sum(similarity) ELSE avg(fwd) END AS weighted_mean, avg(fwd - market) AS market_relative, avg(fwd - peers) AS sector_relative, avg(CASE WHEN fwd > 0 THEN 1.0::DOUBLE ELSE 0 END) AS p_up, avg(CASE WHEN fwd > market THEN 1.0::DOUBLE WHEN fwd <= market THEN 0 END) AS p_beat,"
    f" median(drawdown) AS drawdown, median(mae) AS mae, median(mfe) AS mfe, avg(vol) AS vol, {', '.join(f'quantile_cont(fwd, {q / 100}) AS p{q}' for q in (10, 25, 75, 90))}, any_value(target_pos) - greatest({an.LEAST_GAP}, horizon) AS last FROM j GROUP BY 1, 2, 3) SELECT o.* EXCLUDE (last), b.base FROM o ASOF LEFT JOIN abase b ON b.instrument_id = o.instrument_id AND b.horizon = o.horizon AND o.last >= b.pos",
)

_dims = lambda n: F.size(F.filter(f"v_{n}", lambda x: x.isNotNull())).alias(n)
query("ana_vectors", "apos ahist", "SELECT instrument_id, d, " + ", ".join(f"CAST(count(*) FILTER (domain = '{n}') AS INTEGER) AS {n}" for n in an.DOMAINS) + " FROM (SELECT p.instrument_id, p.d, h.domain FROM (SELECT instrument_id, d, 'own' AS src, instrument_id AS key FROM apos UNION ALL SELECT instrument_id, d, 'sector', sector_id FROM apos UNION ALL SELECT instrument_id, d, 'market', 0 FROM apos) p LEFT JOIN ahist h ON h.src = p.src AND h.key = p.key AND h.d = p.d) GROUP BY 1, 2", stored=True)(
    lambda t: vectors(t).select("instrument_id", "d", *map(_dims, an.DOMAINS))
)
query("ana_zscore", "atz", "SELECT instrument_id, as_of, feature, round(z, 6) + 0.0::DOUBLE AS z FROM atz", stored=True)(
    lambda t: targets(t).select(*an.CELL, F.explode(F.map_from_arrays(F.array(*[F.lit(f) for of in OF.values() for fs in of.values() for f in fs]), F.concat(*[f"t_{n}" for n in OF]))).alias("feature", "z")).where("z is not null").select(*an.CELL, "feature", (F.round("z", 6) + 0.0).alias("z"))
)
query("ana_candidates", "acand", "SELECT instrument_id, as_of, count(*) AS n, min(d) AS first, max(d) AS last FROM acand GROUP BY 1, 2", stored=True)(
    lambda t: an.candidates(cells(t).select(*an.CELL, "target_pos"), positions(t).select("instrument_id", "d", "pos")).groupBy(*an.CELL).agg(F.count("*").alias("n"), F.min("d").alias("first"), F.max("d").alias("last"))
)
query("ana_masked_cosine", "asims", "SELECT instrument_id, as_of, d, " + ", ".join(f"round({n}, 6) AS {n}" for n in an.DOMAINS) + " FROM asims", stored=True)(lambda t: sims(t).select(*an.CELL, "d", *[F.round(n, 6).alias(n) for n in an.DOMAINS]))
query("ana_staged_topk", "arank", "SELECT instrument_id, as_of, d, CAST(rank AS INTEGER) AS rank, round(similarity, 6) AS similarity, round(coverage, 6) AS coverage FROM arank WHERE variant = 'full'", stored=True)(
    lambda t: ranked(t).select(*an.CELL, "d", "rank", F.round("similarity", 6).alias("similarity"), F.round("coverage", 6).alias("coverage"))
)
query("ana_dedup_gap", "akeep", "SELECT instrument_id, as_of, d, CAST(rank AS INTEGER) AS rank, CAST(place AS INTEGER) AS place FROM akeep", stored=True)(lambda t: kept(t).select(*an.CELL, "d", "rank", "place"))
FOLLOWED = ("mean", "median", "weighted_mean", "market_relative", "sector_relative", "p_up", "p_beat", "drawdown", "mae", "mfe", "vol", "p10", "p25", "p75", "p90", "base")
query("ana_outcomes", "aout", f"SELECT instrument_id, as_of, horizon, n, {', '.join(f'round({c}, 5) AS {c}' for c in FOLLOWED)} FROM aout", stored=True)(lambda t: followed(t).select(*an.CELL, "horizon", "n", *[F.round(c, 5).alias(c) for c in FOLLOWED]))
_count = lambda table, name: f"LEFT JOIN (SELECT instrument_id, as_of, count(*) AS {name} FROM {table} GROUP BY 1, 2) USING (instrument_id, as_of)"
query(
    "ana_sufficiency", "acell acand arank akeep",
    f"SELECT *, CASE WHEN candidates < 10 THEN 'candidates' WHEN covered < 10 THEN 'coverage' WHEN matches < 10 THEN 'matches' ELSE 'sufficient' END AS verdict FROM (SELECT instrument_id, as_of, coalesce(candidates, 0) AS candidates, coalesce(covered, 0) AS covered, coalesce(matches, 0) AS matches FROM acell {_count('acand', 'candidates')} {_count('(SELECT * FROM arank WHERE variant = {v})', 'covered').format(v=chr(39) + 'full' + chr(39))} {_count('akeep', 'matches')})",
    stored=True,
)(lambda t: an.sufficiency(cells(t), sims(t), ranked(t), kept(t)).select(*an.CELL, "candidates", "covered", "matches", "verdict"))
CTE["ainf"] = (
    ("akeep", "aout"),
    "SELECT o.instrument_id, o.as_of, o.horizon, sum(greatest(0, 1 - abs(a.d - b.d) / (1.4::DOUBLE * o.horizon))) / any_value(o.n) AS inflation FROM aout o JOIN akeep a ON a.instrument_id = o.instrument_id AND a.as_of = o.as_of AND a.place <= o.n JOIN akeep b ON b.instrument_id = o.instrument_id AND b.as_of = o.as_of AND b.place <= o.n GROUP BY 1, 2, 3",
)
query(
    "ana_score", "aout ainf",
    f"SELECT instrument_id, as_of, horizon, n, round(effect, 6) AS effect, round(n_eff, 5) AS n_eff, round(100 * ({stats.norm_cdf_sql('z')}), 4) AS score, round(n_eff / (n_eff + {evd.PRIOR_EVENTS}), 5) AS confidence FROM (SELECT *, greatest(-4, least(4, effect / (greatest((p75 - p25) / 1.349, 1e-6) / sqrt(greatest(n_eff, 1e-9))))) AS z FROM (SELECT *, weighted_mean - base AS effect, n / inflation AS n_eff FROM aout JOIN ainf USING (instrument_id, as_of, horizon) WHERE n >= {an.LEAST_MATCHES} AND base IS NOT NULL))",
    stored=True,
)(lambda t: scored(t).select(*an.CELL, "horizon", "n", F.round("effect", 6).alias("effect"), F.round("n_eff", 5).alias("n_eff"), F.round("score", 4).alias("score"), F.round("confidence", 5).alias("confidence")))


def scored(t: Tables) -> DataFrame:
    """The analogue model's score: effect against the candidates' mean, error from the spread of outcomes and their overlap."""
    dates = kept(t).groupBy(*an.CELL).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "d"))), lambda p: F.struct(F.datediff(p["d"], F.lit(evd.ORIGIN).cast("date")).alias("day"), F.lit(1.0).alias("c"))).alias("dates"))
    rows = followed(t).where((F.col("n") >= an.LEAST_MATCHES) & F.col("base").isNotNull()).join(dates, an.CELL).withColumn("dates", F.slice("dates", F.lit(1), F.col("n").cast("int")))
    rows = rows.withColumn("inflation", evd.gram(F.col("dates"), F.col("dates"), F.col("horizon")) / F.col("n"))
    rows = rows.withColumns({"effect": F.col("weighted_mean") - F.col("base"), "n_eff": F.col("n") / F.col("inflation")})
    se = F.greatest((F.col("p75") - F.col("p25")) / 1.349, F.lit(1e-6)) / F.sqrt(F.greatest("n_eff", F.lit(1e-9)))
    z = F.greatest(F.lit(-evd.Z_CLIP), F.least(F.lit(evd.Z_CLIP), F.col("effect") / se))
    return rows.withColumns({"score": stats.score_from_z(z), "confidence": stats.confidence("n_eff", evd.PRIOR_EVENTS)})


query("ana_variants", "akeepall", "SELECT variant, instrument_id, as_of, count(*) AS n, round(avg(similarity), 6) AS similarity, min(d) AS first, max(d) AS last, arg_min(d, place) AS best FROM akeepall GROUP BY 1, 2, 3", stored=True)(
    lambda t: chosen(t, *[v[0] for v in an.VARIANTS]).groupBy("variant", *an.CELL).agg(F.count("*").alias("n"), F.round(F.avg("similarity"), 6).alias("similarity"), F.min("d").alias("first"), F.max("d").alias("last"), F.min_by("d", "place").alias("best"))
)
