"""Queries of regime tables, remaining evaluation metrics, and quality of native tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlake.operators import evaluate as ev
from pitlake.operators import features as ft
from pitlake.operators import pit, regimes
from pitlake.operators import research as rs
from pitlake.plans.evaluate_queries import KEY, prepared
from pitlake.plans.registry import CTE, Tables, query
from pitlake.plans.research_queries import neat
from pitlake.plans.security_queries import bars, terminals

WINDOWS = (5, 21, 63, 126)
_move = "SELECT '{c}_{n}' AS code, obs_date, available_from, value - lag(value, {n}) OVER (ORDER BY obs_date) AS value FROM mo WHERE code = '{c}'"
CTE["moves"] = (("mo",), " UNION ALL ".join(_move.format(c=c, n=n) for c in ("DGS2", "DGS10") for n in WINDOWS))
CTE["mv"] = (("moves", "cal"), "SELECT cal.d, s.code AS feature, a.value FROM cal CROSS JOIN (SELECT DISTINCT code FROM moves) s ASOF LEFT JOIN moves a ON a.code = s.code AND cal.d >= a.available_from")
CTE["reg"] = ((), "SELECT * FROM (VALUES " + ", ".join(f"('{f}', {p}, '{x}', '{o}', {v}::DOUBLE, '{n}')" for f, p, x, o, v, n in regimes.rates_table()) + ") t(family, priority, feature, op, lim, label)")
CTE["act"] = (("mv", "reg"), "SELECT d, family, arg_min(label, priority) AS label FROM mv JOIN reg USING (feature) WHERE CASE op WHEN '>=' THEN value >= lim ELSE value <= lim END GROUP BY 1, 2")


def moves(t: Tables) -> DataFrame:
    w = Window.partitionBy("code").orderBy("obs_date")
    own = t.mo.where(F.col("code").isin("DGS2", "DGS10"))
    wide = own.select("code", "obs_date", "available_from", *[(F.col("value") - F.lag("value", n).over(w)).alias(str(n)) for n in WINDOWS])
    rows = wide.unpivot(["code", "obs_date", "available_from"], [str(n) for n in WINDOWS], "n", "value").withColumn("code", F.concat_ws("_", "code", "n"))
    return pit.align_availability(t.cal, rows).select("d", F.col("code").alias("feature"), "value")


def active(t: Tables) -> DataFrame:
    table = t.spark.createDataFrame(regimes.rates_table(), "family string, priority int, feature string, op string, `limit` double, label string")
    return regimes.active(moves(t), table, ["d"])


query("mod_rates", "act", "SELECT d, family, label FROM act")(active)
query("mod_select_active", "act", "SELECT family, label, count(*) AS days, min(d) AS first, max(d) AS last FROM act GROUP BY 1, 2")(lambda t: active(t).groupBy("family", "label").agg(F.count("*").alias("days"), F.min("d").alias("first"), F.max("d").alias("last")))
# Evaluation by regime and model stability ----------------------------------------------------------------------

CTE["dayreg"] = (("bm", "cal", "mo"), "SELECT d, CASE WHEN adj > ma THEN 'bull' WHEN adj <= ma THEN 'bear' END AS trend, CASE WHEN v >= 15 THEN 'high' WHEN v < 15 THEN 'low' END AS vol FROM (SELECT d, adj, CASE WHEN count(adj) OVER (ORDER BY d ROWS 199 PRECEDING) = 200 THEN avg(adj) OVER (ORDER BY d ROWS 199 PRECEDING) END AS ma FROM bm) b JOIN (SELECT cal.d, a.value AS v FROM cal ASOF LEFT JOIN (SELECT * FROM mo WHERE code = 'VIX') a ON cal.d >= a.obs_date) USING (d)")


def day_regimes(t: Tables) -> DataFrame:
    trend = t.bm.withColumn("ma", ft.rolling(F.avg, "adj", 200, ft.market_days())).select("d", F.when(F.col("adj") > F.col("ma"), "bull").when(F.col("adj") <= F.col("ma"), "bear").alias("trend"))
    vix = ft.on_calendar(t.cal, t.mo.where("code = 'VIX'").withColumn("available_from", F.col("obs_date")), "v")
    return trend.join(vix, "d").select("d", "trend", F.when(F.col("v") >= 15, "high").when(F.col("v") < 15, "low").alias("vol"))


query("ev_regime_classify", "dayreg", "SELECT * FROM dayreg")(day_regimes)
query("ev_regime_analytics", "dayreg wr", "SELECT dimension, label, system, count(*) AS n, round(avg(hit), 6) AS accuracy FROM wr JOIN (SELECT d, 'trend' AS dimension, trend AS label FROM dayreg WHERE trend IS NOT NULL UNION ALL SELECT d, 'vol', vol FROM dayreg WHERE vol IS NOT NULL) r ON r.d = wr.as_of GROUP BY 1, 2, 3")(
    lambda t: prepared(t).join(F.broadcast(day_regimes(t).unpivot(["d"], ["trend", "vol"], "dimension", "label").where("label is not null").withColumnRenamed("d", "as_of")), "as_of").groupBy("dimension", "label", "system").agg(F.count("*").alias("n"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("accuracy"))
)
query("wf_weight_stability", "wr", "SELECT horizon, round(max(a) - min(a), 6) AS spread, max(a) - min(a) <= 0.08 AS stable FROM (SELECT horizon, system, avg(hit) AS a FROM wr GROUP BY 1, 2) GROUP BY 1")(
    lambda t: prepared(t).groupBy(*KEY).agg(F.avg(F.col("hit").cast("double")).alias("a")).groupBy("horizon").agg(F.round(F.max("a") - F.min("a"), 6).alias("spread"), ((F.max("a") - F.min("a")) <= 0.08).alias("stable"))
)
query("wf_shadow_decision", "wr", "SELECT CASE WHEN count(*) FILTER (c > b) * 2 > count(*) THEN 'promote' WHEN count(*) FILTER (c < b) * 2 > count(*) THEN 'retire' ELSE 'keep shadow' END AS decision FROM (SELECT horizon, avg(hit) FILTER (system = 'combined') AS c, avg(hit) FILTER (system = 'baseline') AS b FROM wr GROUP BY 1)")(
    lambda t: prepared(t).groupBy("horizon").pivot("system", ["combined", "baseline"]).agg(F.avg(F.col("hit").cast("double"))).agg(
        F.when(F.count_if(F.col("combined") > F.col("baseline")) * 2 > F.count("*"), "promote").when(F.count_if(F.col("combined") < F.col("baseline")) * 2 > F.count("*"), "retire").otherwise("keep shadow").alias("decision")
    )
)
CTE["real"] = (("px",), "SELECT instrument_id, d, horizon, fwd, adverse FROM (SELECT instrument_id, d, 21 AS horizon, lead(adj, 21) OVER (PARTITION BY instrument_id ORDER BY d) / adj - 1 AS fwd, min(adj) OVER (PARTITION BY instrument_id ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING) / adj - 1 AS adverse FROM px)")
query("wf_realized", "real", "SELECT instrument_id, d, horizon, fwd IS NOT NULL AS complete, round(fwd, 6) AS actual, CASE WHEN fwd IS NOT NULL THEN round(adverse, 6) END AS adverse FROM real")(
    lambda t: rs.forward_returns(t.px, (21,)).join(rs.path_excursions(t.px, 21).select("instrument_id", "d", "mae"), ["instrument_id", "d"], "left").select("instrument_id", "d", "horizon", F.col("fwd").isNotNull().alias("complete"), F.round("fwd", 6).alias("actual"), F.round("mae", 6).alias("adverse"))
)
CTE["wrm"] = (
    ("wr", "pr0"),
    "SELECT system, model, share, CASE model WHEN 'momentum' THEN 0.05 * (a / (1 + abs(a))) - 0.01 ELSE 0.05 * (b / (1 + abs(b))) - 0.01 END AS effect, expected_excess, realized_excess FROM wr JOIN pr0 USING (instrument_id, as_of)"
    " JOIN (VALUES ('baseline', 'momentum', 1.0::DOUBLE), ('combined', 'momentum', 0.5::DOUBLE), ('combined', 'trend', 0.5::DOUBLE)) v(system, model, share) USING (system)",
)
_same = "avg(CASE WHEN effect <> 0 AND {c} THEN CASE WHEN sign(effect) = sign({y}) THEN 1.0::DOUBLE ELSE 0.0 END END)"
_err = "avg(CASE WHEN effect <> 0 AND realized_excess IS NOT NULL THEN abs({x}) END)"
MEASURES = {"weight_share": 6, "contribution": 8, "mean_effect": 8, "agreement": 6, "contradiction": 6, "hit_rate": 6, "edge": 6, "mae": 6, "naive_mae": 6, "information_gain": 6}
query(
    "ev_model_analytics", "wrm",
    f"SELECT system, model, n, {', '.join(f'round({c}, {k}) AS {c}' for c, k in MEASURES.items())} FROM (SELECT *, 1 - agreement AS contradiction, hit_rate - 0.5 AS edge, naive_mae - mae AS information_gain FROM (SELECT system, model, count(*) AS n, avg(share) AS weight_share, avg(abs(share * effect)) AS contribution, avg(effect) AS mean_effect,"
    f" {_same.format(c='expected_excess <> 0', y='expected_excess')} AS agreement, {_same.format(c='realized_excess IS NOT NULL', y='realized_excess')} AS hit_rate, {_err.format(x='realized_excess - effect')} AS mae, {_err.format(x='realized_excess')} AS naive_mae FROM wrm GROUP BY 1, 2))",
)(lambda t: ev.model_analytics(prepared(t), ["system"]).select("system", "model", "n", *[F.round(c, k).alias(c) for c, k in MEASURES.items()]))
query("int_world_guard", "wr", "SELECT instrument_id, count(DISTINCT system) AS systems, count(DISTINCT horizon) AS horizons, count(*) FILTER (bench IS NULL) AS unstamped FROM wr GROUP BY 1")(
    lambda t: prepared(t).groupBy("instrument_id").agg(F.countDistinct("system").alias("systems"), F.countDistinct("horizon").alias("horizons"), F.count_if(F.col("bench").isNull()).alias("unstamped"))
)
