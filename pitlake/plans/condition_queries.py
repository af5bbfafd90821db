"""Queries of condition templates, the ladder of condition sets and the change by leaving one condition out, on the quarterly grid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlake.functions import stats
from pitlake.operators import conditions as cd
from pitlake.operators import features as ft
from pitlake.operators import grammar as gr
from pitlake.operators import research as rs
from pitlake.plans import model_queries as mq
from pitlake.plans import search_queries as sq
from pitlake.plans.feature_queries import SECT, UNTIL, rolled, until
from pitlake.plans.registry import CTE, Tables, query
from pitlake.sources import sinks

OWN = {r[3] for r in cd.TEMPLATES if r[4] == "own"}
MARKET = ("regime_bull", "vix_pctile_252d", "cpi_yoy_accel")
GAP = cd.FOCUS * rs.OVERLAP_DAYS
HORIZONS = mq.HORIZONS


def series(t: Tables) -> dict[str, DataFrame]:
    """The templates' series, narrow and written once."""
    if not hasattr(t, "_condition_series"):
        keys = ["instrument_id", "d"]
        ahead = until(t).select(*keys, F.datediff("next_event", "d").cast("double").alias("days_until_earnings"))
        rates = ft.on_calendar(t.cal, ft.macro_change(t.mo, "DGS10", 63), "dgs10_chg_63d")
        sector = t.sx.withColumn("ma", ft.rolling(F.avg, "adj", 50, Window.partitionBy("sector_id").orderBy("d"))).select("sector_id", "d", (F.try_divide("adj", "ma") - 1).alias("etf_price_to_ma50"))
        rows = {
            "own": mq.own_features(t, OWN - {"days_until_earnings"}).unionByName(ft.to_narrow(ahead, keys)),
            "sector": ft.to_narrow(sector, ["sector_id", "d"]),
            "market": mq.market_features(t).where(F.col("feature").isin(*MARKET)).unionByName(ft.to_narrow(rates, ["d"])),
        }
        t._condition_series = {n: sinks.written(df.where("value is not null").withColumn("value", F.col("value").cast("double")), f"series_{n}") for n, df in rows.items()}
    return t._condition_series


def templates(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(cd.table(), cd.SCHEMA)


def states(t: Tables) -> DataFrame:
    """Per cell and feature the latest value and the own quantiles as of the date."""
    if not hasattr(t, "_states"):
        s, dates = series(t), [r["as_of"] for r in mq.quarters(t).collect()]
        at = {n: gr.state(s[n], dates, keys, list(cd.CUTS)) for n, keys in (("own", ["instrument_id"]), ("sector", ["sector_id"]), ("market", []))}
        cells = F.broadcast(sq.cells(t).select("instrument_id", "as_of", "sector_id"))
        every = at["own"].join(F.broadcast(sq.cells(t).select("instrument_id", "as_of")), ["instrument_id", "as_of"]).unionByName(at["sector"].join(cells, ["sector_id", "as_of"]).drop("sector_id")).unionByName(at["market"].join(cells, "as_of").drop("sector_id"))
        t._states = sinks.written(every, "states")
    return t._states


def resolved(t: Tables) -> DataFrame:
    if not hasattr(t, "_resolved"):
        t._resolved = sinks.written(cd.resolved(sq.cells(t).select("instrument_id", "as_of"), states(t), templates(t)), "resolved")
    return t._resolved


def pool(t: Tables) -> DataFrame:
    """Per date and instrument the bitmaps of all its days up to the date."""
    if not hasattr(t, "_pool"):
        s, tpl = series(t), templates(t)
        days = sq.positions(t).select("instrument_id", "sector_id", "d")
        every = s["own"].unionByName(days.join(s["sector"], ["sector_id", "d"]).drop("sector_id")).unionByName(days.join(s["market"], "d").drop("sector_id")).join(F.broadcast(tpl), "feature")
        mine = every.where("mode <> 'own'").withColumn("h", cd.holding(F.col("mode"), F.col("value"), F.col("high"), F.col("low"), F.col("most")))
        fixed = mine.groupBy("instrument_id", "d").agg(F.sum(F.expr("shiftleft(1, 2 * bit)")).cast("int").alias("known"), F.sum(F.expr("shiftleft(h, 2 * bit)")).cast("int").alias("hold"))
        buckets = [(k, r[3]) for k, r in enumerate(cd.TEMPLATES) if r[2] == "own"]
        values = every.where("mode = 'own'").groupBy("instrument_id", "d").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("values"))
        cuts = states(t).where(F.col("q").isNotNull() & F.col("feature").isin(*[f for _, f in buckets])).groupBy("instrument_id", "as_of").agg(F.map_from_entries(F.collect_list(F.struct("feature", "q"))).alias("cuts"))
        fwd = sq.positions(t).select("instrument_id", "d", "pos", *[(F.lead("adj", h).over(ft.own_days()) / F.col("adj") - 1).alias(f"x{h}") for h in HORIZONS])
        rows = fwd.join(fixed, ["instrument_id", "d"], "left").join(values, ["instrument_id", "d"], "left")
        cells = sq.cells(t).select("instrument_id", "as_of", "target_pos").join(cuts, ["instrument_id", "as_of"], "left")
        rows = rows.join(F.broadcast(cells), "instrument_id").where("pos <= target_pos")
        v, q = lambda f: F.col("values")[f], lambda f, i: F.col("cuts")[f][i]
        there = lambda f: v(f).isNotNull() & q(f, 0).isNotNull()
        known = sum((F.when(there(f), 4**k).otherwise(0) for k, f in buckets), F.coalesce("known", F.lit(0)))
        hold = sum((F.when(there(f), (F.when(v(f) >= q(f, 1), 1).otherwise(0) + F.when(v(f) <= q(f, 0), 2).otherwise(0)) * 4**k).otherwise(0) for k, f in buckets), F.coalesce("hold", F.lit(0)))
        whole = rows.select("instrument_id", "as_of", F.unix_date("d").alias("day"), known.cast("int").alias("known"), hold.cast("int").alias("hold"), *[F.when(F.col("pos") + h <= F.col("target_pos"), F.col(f"x{h}")).alias(f"x{h}") for h in HORIZONS])
        arrays = whole.groupBy("as_of", "instrument_id").agg(F.sort_array(F.collect_list(F.struct("day", "known", "hold", *[f"x{h}" for h in HORIZONS]))).alias("a"))
        t._pool = sinks.written(arrays.select("as_of", "instrument_id", F.col("a.day").alias("days"), F.col("a.known").alias("known"), F.col("a.hold").alias("hold"), *[F.col(f"a.x{h}").alias(f"fwd{h}") for h in HORIZONS]), "pool")
    return t._pool


def chosen(t: Tables) -> DataFrame:
    """The first rung of each cell whose match set has the support, with its profile; cells without one have none."""
    if not hasattr(t, "_chosen"):
        steps = cd.rungs(resolved(t))
        found = sinks.written(cd.apply_masks(pool(t), steps), "matches")
        events = t._events = found.select("as_of", "mask", "instrument_id", F.explode("events").alias("day")).select("as_of", "mask", "instrument_id", F.date_from_unix_date("day").alias("d"))
        profile = rs.independence(events, ["as_of", "mask"], cd.FOCUS)
        raw, episodes, years, symbol, year = cd.SUPPORT
        good = profile.where((F.col("raw") >= raw) & (F.col("episodes") >= episodes) & (F.col("years") >= years) & (F.col("hhi_symbol") <= symbol) & (F.col("hhi_year") <= year))
        best = steps.join(good, ["as_of", "mask"]).withColumn("n", F.row_number().over(Window.partitionBy("instrument_id", "as_of").orderBy("rung"))).where("n = 1").drop("n")
        t._chosen = sinks.written(best.join(cd.effects(found).select("as_of", "mask", "effect"), ["as_of", "mask"]), "chosen")
    return t._chosen


def matches(t: Tables) -> DataFrame:
    """The match sets that are used: per date and mask the candidates' events."""
    asked = chosen(t).select("as_of", "mask").distinct()
    return t._events.join(F.broadcast(asked), ["as_of", "mask"])


def pooled(t: Tables) -> DataFrame:
    """Events of the match sets with each complete outcome."""
    each = [F.struct(F.lit(h).alias("horizon"), (F.lead("adj", h).over(ft.own_days()) / F.col("adj") - 1).alias("fwd")) for h in HORIZONS]
    fwd = sq.positions(t).select("instrument_id", "d", "pos", F.array(*each).alias("o")).select("instrument_id", "d", "pos", F.inline("o"))
    ends = sq.cells(t).select("instrument_id", "as_of", "target_pos")
    return matches(t).join(fwd, ["instrument_id", "d"]).join(ends, ["instrument_id", "as_of"]).where("pos + horizon <= target_pos").select("as_of", "mask", "horizon", "instrument_id", "d", "fwd")


def outcomes(t: Tables) -> DataFrame:
    """What followed the match sets per date, mask and horizon, against all days that can be evaluated."""
    if not hasattr(t, "_outcomes_of_sets"):
        asked = chosen(t).select("as_of", "mask").distinct()
        base = reduce(DataFrame.unionByName, [cd.apply_masks(pool(t), asked, h).groupBy("as_of", "mask").agg(F.sum("s_base").alias("s"), F.sum("n_base").alias("n")).select("as_of", "mask", F.lit(h).alias("horizon"), F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("base")) for h in HORIZONS])
        t._outcomes_of_sets = sinks.written(cd.described(pooled(t), base, ["as_of", "mask", "horizon"]), "described")
    return t._outcomes_of_sets


def scored(t: Tables) -> DataFrame:
    """Per cell and horizon the score of its match set; without spread or with few episodes there is none."""
    rows = chosen(t).select("instrument_id", "as_of", "mask").join(outcomes(t), ["as_of", "mask"]).where((F.col("se") > 0) & F.col("effect").isNotNull() & (F.col("episodes") >= cd.LEAST_EPISODES))
    z = F.greatest(F.lit(-4.0), F.least(F.lit(4.0), F.col("effect") / F.col("se")))
    diverse = 1 - F.greatest("hhi_symbol", "hhi_year")
    return rows.withColumns({"score": stats.score_from_z(z), "confidence": stats.confidence(F.col("episodes"), cd.PRIOR_EPISODES, diverse)})


def leave_one_out(t: Tables) -> DataFrame:
    """For each condition of the chosen sets of two and more: the effect with it less that without it."""
    bits = resolved(t).where("side is not null").select("instrument_id", "as_of", "name", F.expr("shiftleft(1, 2 * bit + side)").alias("one"))
    rows = chosen(t).where("effect is not null").join(bits, ["instrument_id", "as_of"]).where(F.col("mask").bitwiseAND(F.col("one")) != 0).where("mask <> one")
    rows = rows.select("instrument_id", "as_of", "name", F.col("raw").alias("n_with"), F.col("effect").alias("full"), (F.col("mask") - F.col("one")).alias("mask"))
    rest = cd.effects(cd.apply_masks(pool(t), rows))
    return rows.join(rest, ["as_of", "mask"]).select("instrument_id", "as_of", "name", "n_with", F.col("n").alias("n_without"), (F.col("full") - F.col("effect")).alias("change"))


# The same in SQL ---------------------------------------------------------------------------------------------------

_q = lambda names: ", ".join(f"'{n}'" for n in sorted(names))
CTE["ctpl"] = ((), "SELECT bit, name, family, mode, feature, src, high::DOUBLE AS high, low::DOUBLE AS low, band::DOUBLE AS band, most::DOUBLE AS most FROM (VALUES " + ", ".join(map(str, cd.table())) + ") t(bit, name, family, mode, feature, src, high, low, band, most)")
CTE["cval"] = (
    ("ownf", "px", "ea", "sx", "mktf", "mdays"),
    f"SELECT 'own' AS src, instrument_id AS key, d, feature, CAST(value AS DOUBLE) AS value FROM ownf WHERE feature IN ({_q(OWN)}) AND value IS NOT NULL UNION ALL SELECT 'own', instrument_id, d, 'days_until_earnings', CAST(next_event - d AS DOUBLE) FROM ({UNTIL}) WHERE next_event IS NOT NULL"
    f" UNION ALL SELECT 'sector', sector_id, d, 'etf_price_to_ma50', adj / nullif(ma, 0) - 1 FROM (SELECT sector_id, d, adj, {rolled('avg', 'adj', 50, SECT)} AS ma FROM sx) WHERE ma IS NOT NULL"
    f" UNION ALL SELECT 'market', 0, d, feature, CAST(value AS DOUBLE) FROM mktf WHERE feature IN ({_q(MARKET)}) AND value IS NOT NULL UNION ALL SELECT 'market', 0, d, 'dgs10_chg_63d', value FROM mdays WHERE code = 'move' AND value IS NOT NULL",
)
CTE["cstate"] = (("cval", "quarters"), "SELECT src, key, as_of, feature, arg_max(value, d) AS value, CASE WHEN count(value) >= 252 THEN quantile_cont(value, [0.2, 0.8]) END AS q FROM cval JOIN quarters ON d <= as_of GROUP BY ALL")
CTE["cres"] = (
    ("akey", "ctpl", "cstate"),
    "SELECT *, CASE WHEN value IS NULL THEN 'unavailable' WHEN mode = 'own' AND q IS NULL THEN 'thin history' WHEN side IS NULL THEN CASE WHEN mode = 'window' THEN 'far' ELSE 'middle' END END AS reason, CASE WHEN side IS NULL THEN NULL WHEN mode = 'window' THEN most WHEN mode IN ('own', 'bucket') THEN CASE WHEN side = 0 THEN hi ELSE lo END WHEN mode = 'flag' THEN 1.0 - side ELSE 0 END::DOUBLE AS threshold FROM"
    " (SELECT *, CASE mode WHEN 'flag' THEN CASE WHEN value >= 0.5 THEN 0 WHEN value < 0.5 THEN 1 END WHEN 'direction' THEN CASE WHEN value > band THEN 0 WHEN value < -band THEN 1 END WHEN 'structural' THEN CASE WHEN value >= 0 THEN 0 WHEN value < 0 THEN 1 END WHEN 'window' THEN CASE WHEN value <= most THEN 0 END ELSE CASE WHEN value >= hi THEN 0 WHEN value <= lo THEN 1 END END AS side FROM"
    " (SELECT k.instrument_id, k.as_of, t.*, s.value, s.q, CASE WHEN mode = 'own' THEN s.q[2] ELSE high END AS hi, CASE WHEN mode = 'own' THEN s.q[1] ELSE low END AS lo FROM akey k JOIN ctpl t ON t.src = k.src LEFT JOIN cstate s ON s.src = k.src AND s.key = k.key AND s.as_of = k.as_of AND s.feature = t.feature))",
)
_sum = lambda g: f"sum(CASE WHEN side IS NOT NULL AND family IN ({_q(cd.GROUPS[g])}) THEN 1 << (2 * bit + side) ELSE 0 END)::BIGINT AS {g}"
CTE["crung"] = (
    ("cres",),
    "WITH g AS (SELECT instrument_id, as_of, " + ", ".join(map(_sum, cd.GROUPS)) + " FROM cres GROUP BY 1, 2) " + " UNION ALL ".join(f"SELECT instrument_id, as_of, {' + '.join(cd.GROUPS)} AS whole, {i} AS rung, {' + '.join(r)} AS mask FROM g WHERE " + " AND ".join(f"{x} > 0" for x in r) for i, r in enumerate(cd.LADDER)),
)
CTE["cpool"] = (
    ("apos", "acell", "ctpl", "cval", "cstate"),
    "WITH p AS (SELECT instrument_id, d, 'own' AS src, instrument_id AS key FROM apos UNION ALL SELECT instrument_id, d, 'sector', sector_id FROM apos UNION ALL SELECT instrument_id, d, 'market', 0 FROM apos), v AS (SELECT p.instrument_id, p.d, t.*, c.value FROM p JOIN cval c USING (src, key, d) JOIN ctpl t ON t.src = c.src AND t.feature = c.feature),"
    " f AS (SELECT instrument_id, d, sum(1 << (2 * bit))::BIGINT AS known, sum((CASE mode WHEN 'flag' THEN CASE WHEN value = 1 THEN 1 ELSE 0 END + CASE WHEN value = 0 THEN 2 ELSE 0 END WHEN 'bucket' THEN CASE WHEN value >= high THEN 1 ELSE 0 END + CASE WHEN value <= low THEN 2 ELSE 0 END WHEN 'direction' THEN CASE WHEN value > 0 THEN 1 ELSE 0 END + CASE WHEN value < 0 THEN 2 ELSE 0 END WHEN 'structural' THEN CASE WHEN value >= 0 THEN 1 ELSE 2 END ELSE CASE WHEN value <= most THEN 1 ELSE 0 END END) << (2 * bit))::BIGINT AS hold FROM v WHERE mode <> 'own' GROUP BY 1, 2),"
    " o AS (SELECT v.instrument_id, s.as_of, v.d, sum(1 << (2 * bit))::BIGINT AS known, sum((CASE WHEN v.value >= s.q[2] THEN 1 ELSE 0 END + CASE WHEN v.value <= s.q[1] THEN 2 ELSE 0 END) << (2 * bit))::BIGINT AS hold FROM v JOIN cstate s ON s.src = 'own' AND s.key = v.instrument_id AND s.feature = v.feature AND s.q IS NOT NULL AND v.d <= s.as_of WHERE mode = 'own' GROUP BY 1, 2, 3)"
    f" SELECT c.as_of, c.instrument_id, a.d, coalesce(f.known, 0) + coalesce(o.known, 0) AS known, coalesce(f.hold, 0) + coalesce(o.hold, 0) AS hold, CASE WHEN a.pos + {cd.FOCUS} <= c.target_pos THEN a.x END AS x FROM acell c JOIN (SELECT *, lead(adj, {cd.FOCUS}) OVER (PARTITION BY instrument_id ORDER BY d) / adj - 1 AS x FROM apos) a ON a.instrument_id = c.instrument_id AND a.pos <= c.target_pos LEFT JOIN f ON f.instrument_id = a.instrument_id AND f.d = a.d LEFT JOIN o ON o.instrument_id = a.instrument_id AND o.d = a.d AND o.as_of = c.as_of",
)


def _matched(masks: str) -> str:
    need = f"((mask | (mask >> 1)) & {cd.EVEN})"
    rows = f"SELECT p.as_of, mask, p.instrument_id, p.d, p.x, (hold & mask) = mask AS match FROM cpool p JOIN (SELECT DISTINCT as_of, mask FROM {masks}) m ON m.as_of = p.as_of WHERE (known & {need}) = {need}"
    return f"SELECT *, match AND NOT coalesce(lag(match) OVER (PARTITION BY as_of, mask, instrument_id ORDER BY d), false) AS event FROM ({rows})"


_EFFECT = "SELECT as_of, mask, count(*) FILTER (event) AS n, avg(x) FILTER (event) - avg(x) AS effect FROM {t} GROUP BY 1, 2"
CTE["cmat"] = (("cpool", "crung"), _matched("crung"))
_raw, _epi, _yrs, _sym, _yr = cd.SUPPORT
_hhi = lambda k, n: f"(SELECT as_of, mask, sum(c * c)::DOUBLE / (sum(c) * sum(c)) AS {n} FROM (SELECT as_of, mask, {k} AS k, count(*) AS c FROM e GROUP BY 1, 2, 3) GROUP BY 1, 2)"
CTE["cchosen"] = (
    ("cmat", "crung"),
    f"WITH e AS (SELECT * FROM cmat WHERE event), g AS (SELECT as_of, mask, d, CASE WHEN d - lag(d) OVER (PARTITION BY as_of, mask ORDER BY d) <= {GAP} THEN 0 ELSE 1 END AS fresh FROM (SELECT DISTINCT as_of, mask, d FROM e)), x AS (SELECT as_of, mask, sum(fresh)::BIGINT AS episodes FROM g GROUP BY 1, 2),"
    f" s AS (SELECT as_of, mask, count(*) AS raw, count(DISTINCT year(d)) AS years FROM e GROUP BY 1, 2), y AS ({_EFFECT.format(t='cmat')}) SELECT r.*, s.raw, s.years, x.episodes, y.effect FROM crung r JOIN s USING (as_of, mask) JOIN x USING (as_of, mask) JOIN {_hhi('instrument_id', 'hs')} USING (as_of, mask) JOIN {_hhi('year(d)', 'hy')} USING (as_of, mask) JOIN y USING (as_of, mask)"
    f" WHERE raw >= {_raw} AND episodes >= {_epi} AND years >= {_yrs} AND hs <= {_sym} AND hy <= {_yr} QUALIFY row_number() OVER (PARTITION BY instrument_id, as_of ORDER BY rung) = 1",
)
CTE["cbit"] = (("cres",), "SELECT instrument_id, as_of, name, (1 << (2 * bit + side))::BIGINT AS one FROM cres WHERE side IS NOT NULL")
CTE["cloo"] = (("cchosen", "cbit"), "SELECT instrument_id, as_of, name, raw AS n_with, effect AS whole_effect, mask - one AS mask FROM cchosen JOIN cbit USING (instrument_id, as_of) WHERE effect IS NOT NULL AND (mask & one) <> 0 AND mask <> one")

query("cpe_templates", "cres", "SELECT instrument_id, as_of, name, family, mode, feature, round(value, 6) AS value, CAST(side AS INTEGER) AS side, reason, round(threshold, 6) AS threshold FROM cres", stored=True)(
    lambda t: resolved(t).select("instrument_id", "as_of", "name", "family", "mode", "feature", F.round("value", 6).alias("value"), "side", "reason", F.round("threshold", 6).alias("threshold"))
)
_level = "CASE rung " + " ".join(f"WHEN {i} THEN '{'+'.join(r)}'" for i, r in enumerate(cd.LADDER)) + " ELSE 'insufficient' END"
query(
    "cpe_ladder", "acell cchosen cbit",
    f"SELECT c.instrument_id, c.as_of, {_level} AS level, raw, years, episodes, round(effect, 6) AS effect, d.dropped FROM acell c LEFT JOIN cchosen h USING (instrument_id, as_of) LEFT JOIN (SELECT b.instrument_id, b.as_of, string_agg(name, ',' ORDER BY name) AS dropped FROM cbit b JOIN cchosen h ON h.instrument_id = b.instrument_id AND h.as_of = b.as_of AND (h.mask & b.one) = 0 GROUP BY 1, 2) d USING (instrument_id, as_of)",
    stored=True,
)(lambda t: ladder(t))


def ladder(t: Tables) -> DataFrame:
    """Per cell the rung that was taken, its support, and the resolved conditions that it leaves out."""
    bits = resolved(t).where("side is not null").select("instrument_id", "as_of", "name", F.expr("shiftleft(1, 2 * bit + side)").alias("one"))
    out = bits.join(chosen(t).select("instrument_id", "as_of", "mask"), ["instrument_id", "as_of"]).where(F.col("mask").bitwiseAND(F.col("one")) == 0).groupBy("instrument_id", "as_of").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("dropped"))
    level = F.coalesce(*[F.when(F.col("rung") == i, "+".join(r)) for i, r in enumerate(cd.LADDER)], F.lit("insufficient"))
    rows = sq.cells(t).select("instrument_id", "as_of").join(chosen(t), ["instrument_id", "as_of"], "left").join(out, ["instrument_id", "as_of"], "left")
    return rows.select("instrument_id", "as_of", level.alias("level"), "raw", "years", "episodes", F.round("effect", 6).alias("effect"), "dropped")


CTE["cloom"] = (("cpool", "cloo"), _matched("cloo"))
query("cpe_leave_one_out", "cloo cloom", f"SELECT l.instrument_id, l.as_of, l.name, l.n_with, e.n AS n_without, round(l.whole_effect - e.effect, 6) + 0.0::DOUBLE AS change FROM cloo l JOIN ({_EFFECT.format(t='cloom')}) e USING (as_of, mask)", stored=True)(
    lambda t: leave_one_out(t).select("instrument_id", "as_of", "name", "n_with", "n_without", (F.round("change", 6) + 0.0).alias("change"))
)


# Match sets and what followed them ---------------------------------------------------------------------------------

CTE["cuse"] = (("cmat", "cchosen"), "SELECT m.* FROM cmat m SEMI JOIN cchosen c ON c.as_of = m.as_of AND c.mask = m.mask")
CTE["cfwd"] = (("apos",), " UNION ALL ".join(f"SELECT instrument_id, d, pos, {h} AS horizon, lead(adj, {h}) OVER (PARTITION BY instrument_id ORDER BY d) / adj - 1 AS fwd FROM apos" for h in HORIZONS))
CTE["cdone"] = (("cuse", "cfwd", "acell"), "SELECT u.as_of, u.mask, u.instrument_id, u.d, u.event, f.horizon, f.fwd FROM cuse u JOIN cfwd f ON f.instrument_id = u.instrument_id AND f.d = u.d JOIN acell a ON a.instrument_id = u.instrument_id AND a.as_of = u.as_of AND f.pos + f.horizon <= a.target_pos")
_key = "as_of, mask, horizon"
_share = lambda k, n: f"(SELECT {_key}, sum(c * c)::DOUBLE / (sum(c) * sum(c)) AS {n} FROM (SELECT {_key}, {k} AS k, count(*) AS c FROM e GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)"
_p = lambda c: f"avg(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0 END)"
CTE["cdesc"] = (
    ("cdone",),
    f"WITH e AS (SELECT * FROM cdone WHERE event), g AS (SELECT {_key}, d, CASE WHEN d - lag(d) OVER (PARTITION BY {_key} ORDER BY d) <= 1.4 * horizon THEN 0 ELSE 1 END AS fresh FROM (SELECT DISTINCT {_key}, d FROM e)), x AS (SELECT {_key}, sum(fresh)::BIGINT AS episodes FROM g GROUP BY 1, 2, 3),"
    f" s AS (SELECT {_key}, count(*) AS n, avg(fwd) AS mean, median(fwd) AS median, stddev_samp(fwd) AS std, {_p('fwd > 0')} AS p_up, {_p(f'fwd > {cd.BEYOND}')} AS p_above, {_p(f'fwd < -{cd.BEYOND}')} AS p_below, {', '.join(f'quantile_cont(fwd, {q / 100}) AS p{q}' for q in (10, 25, 75, 90))} FROM e GROUP BY 1, 2, 3), b AS (SELECT {_key}, avg(fwd) AS base FROM cdone GROUP BY 1, 2, 3)"
    f" SELECT *, mean - base AS effect, std / sqrt(episodes) AS se FROM s JOIN x USING ({_key}) JOIN {_share('instrument_id', 'hhi_symbol')} USING ({_key}) JOIN {_share('year(d)', 'hhi_year')} USING ({_key}) JOIN b USING ({_key})",
)
_own = [r[3] for r in cd.TEMPLATES if r[2] == "own"]
query("cpe_own_quantile", "cstate acell", f"SELECT c.instrument_id, c.as_of, s.feature, round(s.q[1], 6) AS low, round(s.q[2], 6) AS high FROM cstate s JOIN acell c ON s.src = 'own' AND s.key = c.instrument_id AND s.as_of = c.as_of WHERE q IS NOT NULL AND feature IN ({_q(_own)})", stored=True)(
    lambda t: states(t).where(F.col("q").isNotNull() & F.col("feature").isin(_own)).select("instrument_id", "as_of", "feature", F.round(F.col("q")[0], 6).alias("low"), F.round(F.col("q")[1], 6).alias("high"))
)
_conds = "SELECT DISTINCT as_of, name, mode, feature, side, CASE WHEN mode <> 'own' THEN threshold END AS fixed FROM cres WHERE side IS NOT NULL"
query(
    "cpe_threshold", "cres acell cstate",
    f"SELECT k.as_of, k.name, CAST(k.side AS INTEGER) AS side, c.instrument_id, round(CASE WHEN k.mode = 'own' THEN CASE WHEN k.side = 0 THEN s.q[2] ELSE s.q[1] END ELSE k.fixed END, 6) AS threshold FROM ({_conds}) k JOIN acell c USING (as_of) LEFT JOIN cstate s ON s.src = 'own' AND s.key = c.instrument_id AND s.as_of = k.as_of AND s.feature = k.feature",
    stored=True,
)(lambda t: thresholds(t).withColumn("threshold", F.round("threshold", 6)))


def thresholds(t: Tables) -> DataFrame:
    """Every condition that some target has at a date, with its limit for every candidate; null where a candidate's history is thin."""
    conds = resolved(t).where("side is not null").select("as_of", "name", "mode", "feature", "side", F.when(F.col("mode") != "own", F.col("threshold")).alias("fixed")).distinct()
    rows = conds.join(sq.cells(t).select("instrument_id", "as_of"), "as_of").join(states(t).select("instrument_id", "as_of", "feature", "q"), ["instrument_id", "as_of", "feature"], "left")
    own = F.when(F.col("side") == 0, F.col("q")[1]).otherwise(F.col("q")[0])
    return rows.select("as_of", "name", "side", "instrument_id", F.when(F.col("mode") == "own", own).otherwise(F.col("fixed")).alias("threshold"))


query("cpe_match", "cuse", "SELECT as_of, CAST(mask AS INTEGER) AS mask, instrument_id, d FROM cuse WHERE event", stored=True)(matches)
DESCRIBED = ("mean", "median", "std", "p_up", "p10", "p25", "p75", "p90")
query("cpe_pooled_returns", "cdesc", f"SELECT as_of, CAST(mask AS INTEGER) AS mask, horizon, n, {', '.join(f'round({c}, 6) AS {c}' for c in DESCRIBED)} FROM cdesc", stored=True)(lambda t: outcomes(t).select("as_of", "mask", "horizon", "n", *[F.round(c, 6).alias(c) for c in DESCRIBED]))
OUTCOME = ("base", "effect", "se", "p_above", "p_below", "hhi_symbol", "hhi_year")
query("cpe_horizon_outcome", "cdesc", f"SELECT as_of, CAST(mask AS INTEGER) AS mask, horizon, n, episodes, {', '.join(f'round({c}, 6) AS {c}' for c in OUTCOME)} FROM cdesc", stored=True)(lambda t: outcomes(t).select("as_of", "mask", "horizon", "n", "episodes", *[F.round(c, 6).alias(c) for c in OUTCOME]))
query(
    "cpe_score", "cchosen cdesc",
    f"SELECT instrument_id, as_of, horizon, round(100 * ({stats.norm_cdf_sql('z')}), 5) AS score, round(least(1, greatest(0, episodes / (episodes + {cd.PRIOR_EPISODES}) * (1 - greatest(hhi_symbol, hhi_year)))), 6) AS confidence, round(effect, 6) AS effect FROM (SELECT c.instrument_id, d.*, greatest(-4, least(4, d.effect / d.se)) AS z FROM cchosen c JOIN cdesc d USING (as_of, mask) WHERE d.se > 0 AND d.effect IS NOT NULL AND d.episodes >= {cd.LEAST_EPISODES})",
    stored=True,
)(lambda t: scored(t).select("instrument_id", "as_of", "horizon", F.round("score", 5).alias("score"), F.round("confidence", 6).alias("confidence"), F.round("effect", 6).alias("effect")))
