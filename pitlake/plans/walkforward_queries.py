"""Queries of systems rebuilt from captured evidence, ablation, match quality, condition targets and snapshots of the environment.

The experiment is the relative-strength model; it overlaps with the sector and momentum models.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlake.functions import stats
from pitlake.operators import evaluate as ev
from pitlake.operators import features as ft
from pitlake.operators import pit, regimes, systems
from pitlake.operators import research as rs
from pitlake.operators.decision import OTHERS, OVERLAPPING
from pitlake.plans.evaluate_queries import ACC, ACC_COLUMNS, KEY, prepared, sql_spearman
from pitlake.plans.feature_queries import SECT, on_days, rolled, until, with_sector
from pitlake.plans.model_queries import MODELS, evidence, grid_outcomes, outcomes, quarters
from pitlake.plans.registry import CTE, Tables, query
from pitlake.plans.research_queries import neat
from pitlake.plans.search_queries import followed, kept
from pitlake.sources import sinks

EXPERIMENT, PARTNERS = "relative", ("sector", "momentum")
#: Correlations that are tried for the experiment.
RHOS = (0.25, 0.50, 0.75, 0.90)
HOLDOUT = "1996-01-01"
MEMBERS = systems.memberships(list(MODELS), EXPERIMENT, RHOS, OVERLAPPING)
NUMBERS = ("effect", "score", "confidence", "trim")

# Systems and ablation ----------------------------------------------------------------------------------------------

_weighted = "sum(effect / (se * se)) / sum(1 / (se * se)) AS effect, 1 / sqrt(sum(1 / (se * se))) AS se"
CTE["cap"] = (("rev",), f"SELECT instrument_id, as_of, model, {_weighted} FROM rev GROUP BY 1, 2, 3")
CTE["members"] = ((), "SELECT system, model, rho::DOUBLE AS rho FROM (VALUES " + ", ".join(map(str, MEMBERS)) + ") t(system, model, rho)")


def combined_sql(rows: str, by: str) -> str:
    part = lambda cond: f"sum(CASE WHEN {cond} THEN 1 / se ELSE 0.0 END)"
    sums = (
        f"SELECT {by}, count(*) AS n, sum(1 / (se * se)) AS w, sum(effect / (se * se)) AS we, sum(1 / se) AS p, max(rho) AS rho, {part(f'model = {EXPERIMENT!r}')} AS x, {part(f'model IN {PARTNERS}')} AS y,"
        f" sum(CASE WHEN effect > 0 THEN 1 / (se * se) ELSE 0.0 END) AS up, sum(CASE WHEN effect < 0 THEN 1 / (se * se) ELSE 0.0 END) AS down FROM ({rows}) GROUP BY {by}"
    )
    z = f"greatest(-4, least(4, we / sqrt({OTHERS} * p * p + {1 - OTHERS} * w + 2 * (rho - {OTHERS}) * x * y)))"
    scored = f"SELECT {by}, n, we / w AS effect, 100 * ({stats.norm_cdf_sql('z')}) AS score, least(1, n / (n + 2.0) * CASE WHEN we > 0 THEN up WHEN we < 0 THEN down ELSE w - up - down END / w) AS confidence FROM (SELECT *, {z} AS z FROM ({sums}))"
    return f"SELECT *, 50 + confidence * (50 - score) AS trim FROM ({scored})"


def pooled(rows: DataFrame, by: list[str]) -> DataFrame:
    """Evidence of regimes weighted by inverse variance."""
    w = 1 / (F.col("se") * F.col("se"))
    return rows.groupBy(*by).agg((F.sum(F.col("effect") * w) / F.sum(w)).alias("effect"), (1 / F.sqrt(F.sum(w))).alias("se"))


def members(t: Tables) -> DataFrame:
    return F.broadcast(t.spark.createDataFrame(MEMBERS, "system string, model string, rho double"))


CTE["sys"] = (("cap", "members"), combined_sql("SELECT * FROM cap JOIN members USING (model)", "system, instrument_id, as_of"))
query("wf_systems", "sys", "SELECT system, instrument_id, as_of, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in NUMBERS) + " FROM sys", stored=True)(
    lambda t: neat(systems.combine(pooled(evidence(t, *MODELS), [*systems.CELL, "model"]).join(members(t), "model"), ["system", *systems.CELL], EXPERIMENT, PARTNERS), *NUMBERS)
)
CTE["kbase"] = (("quarters", "base"), "SELECT as_of, b.s / b.n AS base FROM quarters ASOF JOIN base b ON as_of >= b.exit_day")
CTE["variants"] = (("rev",), f"SELECT family AS variant, instrument_id, as_of, model, {_weighted} FROM rev WHERE model = '{EXPERIMENT}' GROUP BY ALL")
CTE["abl0"] = (
    ("variants", "cap"),
    f"SELECT variant, 'alone' AS system, instrument_id, as_of, model, effect, se FROM variants UNION ALL SELECT variant, 'combined', instrument_id, as_of, model, effect, se FROM variants"
    f" UNION ALL SELECT v.variant, s.system, c.* FROM variants v JOIN cap c ON c.instrument_id = v.instrument_id AND c.as_of = v.as_of AND c.model <> '{EXPERIMENT}' CROSS JOIN (VALUES ('baseline'), ('combined')) s(system)",
)
CTE["abl"] = (
    ("abl0", "gridfx", "kbase"),
    f"SELECT variant, system, score, fwd - base AS realized FROM ({combined_sql(f'SELECT *, {OVERLAPPING} AS rho FROM abl0', 'variant, system, instrument_id, as_of')}) JOIN gridfx USING (instrument_id, as_of) JOIN kbase USING (as_of) WHERE as_of >= DATE '{HOLDOUT}' AND fwd IS NOT NULL",
)


def scored_variants(t: Tables) -> DataFrame:
    """Scores of each family of the experiment alone, with the other models on the same cells, and of those without it."""
    rows = evidence(t, *MODELS)
    of = rows.where(F.col("model") == EXPERIMENT).withColumnRenamed("family", "variant")
    alone = pooled(of, ["variant", *systems.CELL, "model"])
    others = pooled(rows.where(F.col("model") != EXPERIMENT), [*systems.CELL, "model"]).join(alone.select("variant", *systems.CELL), systems.CELL)
    tag = lambda df, *names: df.withColumn("system", F.explode(F.array(*map(F.lit, names))))
    both = tag(alone, "alone", "combined").unionByName(tag(others, "baseline", "combined")).withColumn("rho", F.lit(OVERLAPPING))
    cells = grid_outcomes(t)
    done = cells.where("fwd is not null").groupBy(F.col("exit_day").alias("day")).agg(F.count("*").alias("n"), F.sum("fwd").alias("s"))
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # days of outcomes
    known = done.select(F.lit(1).alias("all"), "day", (F.sum("s").over(upto) / F.sum("n").over(upto)).alias("base"))
    base = pit.asof(quarters(t).withColumn("all", F.lit(1)), known, ["all"], "as_of", "day", ["base"]).where("base is not null")
    scored = systems.combine(both, ["variant", "system", *systems.CELL], EXPERIMENT, PARTNERS).where(F.col("as_of") >= F.lit(HOLDOUT).cast("date"))
    return scored.join(cells, systems.CELL).join(F.broadcast(base.select("as_of", "base")), "as_of").withColumn("realized", F.col("fwd") - F.col("base"))


_hit = "avg(CASE WHEN system = '{s}' THEN CASE WHEN (score > 50) = (realized > 0) THEN 1.0::DOUBLE ELSE 0.0 END END)"
_y = "(score / 100 - CASE WHEN realized > 0 THEN 1 ELSE 0 END)"
query(
    "wf_ablation", "abl",
    f"SELECT variant, n, round(experiment, 6) AS experiment, round(brier, 6) AS brier, round(combined, 6) AS combined, round(baseline, 6) AS baseline, round(coalesce(combined, 0) - coalesce(baseline, 0), 6) AS incremental"
    f" FROM (SELECT variant, count(*) FILTER (system = 'alone') AS n, {_hit.format(s='alone')} AS experiment, avg({_y} * {_y}) FILTER (system = 'alone') AS brier, {_hit.format(s='combined')} AS combined, {_hit.format(s='baseline')} AS baseline FROM abl GROUP BY 1)",
    stored=True,
)(lambda t: neat(systems.ablation(scored_variants(t)), "experiment", "brier", "combined", "baseline", "incremental"))

# Quality of matches against accuracy -------------------------------------------------------------------------------

CTE["qual"] = (("akeep",), "SELECT instrument_id, as_of, round(sum(s) / sum(c), 9) AS similarity, max(c) / sum(c) AS concentration FROM (SELECT instrument_id, as_of, year(d), count(*) AS c, sum(similarity) AS s FROM akeep GROUP BY 1, 2, 3) GROUP BY 1, 2")
CTE["qhit"] = (
    ("qual", "aout", "gridfx6"),
    "SELECT q.*, o.horizon, CASE WHEN (o.weighted_mean > 0) = (f.fwd > 0) THEN 1.0::DOUBLE ELSE 0.0 END AS hit FROM qual q JOIN aout o USING (instrument_id, as_of) JOIN gridfx6 f ON f.instrument_id = q.instrument_id AND f.as_of = q.as_of AND f.horizon = o.horizon WHERE f.fwd IS NOT NULL",
)


def quality_hits(t: Tables) -> DataFrame:
    """Per cell and horizon whether the analogues' mean had the sign of what came, with the quality of the matches."""
    quality = systems.match_quality(kept(t)).withColumn("similarity", F.round("similarity", 9))
    told = followed(t).select("instrument_id", "as_of", "horizon", "weighted_mean")
    actual = outcomes(t).where("fwd is not null").select("instrument_id", "as_of", "horizon", "fwd")
    return quality.join(told, ["instrument_id", "as_of"]).join(actual, ["instrument_id", "as_of", "horizon"]).withColumn("hit", ((F.col("weighted_mean") > 0) == (F.col("fwd") > 0)).cast("double"))


query("wf_quality_split", "qhit", "SELECT horizon, count(*) AS n, round(avg(hit) FILTER (similarity >= m), 6) AS high, round(avg(hit) FILTER (similarity < m), 6) AS low, round(any_value(m), 6) AS median_similarity, round(avg(concentration), 6) AS concentration FROM qhit JOIN (SELECT horizon, median(similarity) AS m FROM qhit GROUP BY 1) USING (horizon) GROUP BY 1", stored=True)(
    lambda t: neat((lambda h: h.join(F.broadcast(h.groupBy("horizon").agg(F.median("similarity").alias("m"))), "horizon").groupBy("horizon").agg(
        F.count("*").alias("n"), F.avg(F.when(F.col("similarity") >= F.col("m"), F.col("hit"))).alias("high"), F.avg(F.when(F.col("similarity") < F.col("m"), F.col("hit"))).alias("low"), F.first("m").alias("median_similarity"), F.avg("concentration").alias("concentration")
    ))(quality_hits(t)), "high", "low", "median_similarity", "concentration")
)

# What a condition is read from -------------------------------------------------------------------------------------

ON = (("own rise", "ret_21d", "self"), ("own quarter", "ret_63d", "self"), ("sector rise", "ret_21d", "sector"), ("market rise", "ret_21d", "market"), ("market quarter", "ret_63d", "market"))
_read = {"self": "SELECT '{c}' AS condition, instrument_id, d, r{n} AS value FROM rb1", "sector": "SELECT '{c}', instrument_id, d, b{n} FROM pxs JOIN rs0 USING (sector_id, d)", "market": "SELECT '{c}', instrument_id, d, b{n} FROM pxs JOIN rb0 USING (d)"}
_reads = " UNION ALL ".join(_read[k].format(c=c, n=f.split("_")[1].rstrip("d")) for c, f, k in ON)


def read_conditions(t: Tables) -> DataFrame:
    names = (21, 63)
    own, sectors = ft.to_narrow(ft.returns(t.px, names), ["instrument_id", "d"]), ft.to_narrow(ft.returns(t.sx.withColumnRenamed("sector_id", "instrument_id"), names), ["instrument_id", "d"]).withColumnRenamed("instrument_id", "sector_id")
    market = ft.to_narrow(t.bm.select("d", *[ft.growth("adj", n, ft.market_days()).alias(f"ret_{n}d") for n in names]), ["d"])
    table = t.spark.createDataFrame(list(ON), "condition string, feature string, evaluate_on string")
    return systems.evaluate_on(table, with_sector(t).select("instrument_id", "sector_id", "d"), own, sectors, market).where("value is not null")


query("cpe_evaluate_on", "rb1 rs0 rb0 pxs", f"SELECT condition, instrument_id, d, round(value, 6) AS value FROM ({_reads}) WHERE value IS NOT NULL")(lambda t: neat(read_conditions(t), "value"))

# Environment and catalysts -----------------------------------------------------------------------------------------

SERIES = {"bull": "regime_bull", "move": "dgs10_chg_63d", "accel": "cpi_yoy_accel", "pctile": "vix_pctile_252d", "vix": "vix_level", "breadth": "sector_breadth_ma50", "lead": "the first sector's rel_ret_spy_63d"}
CTE["brd"] = (("sx",), f"SELECT d, CASE WHEN count(f) >= greatest(1, floor((SELECT count(DISTINCT sector_id) FROM sx) / 2)) THEN avg(f) END AS breadth FROM (SELECT d, CASE WHEN ma IS NOT NULL THEN CASE WHEN adj > ma THEN 1.0::DOUBLE ELSE 0.0 END END AS f FROM (SELECT d, adj, {rolled('avg', 'adj', 50, SECT)} AS ma FROM sx)) GROUP BY d")
CTE["envd"] = (
    ("cal", "bm", "s_feat_macro_chg", "s_feat_macro_yoy_accel", "s_feat_macro_pctile", "s_feat_macro_level", "brd", "rs0", "rb0"),
    f"SELECT cal.d, bull, move, accel, pctile, vix, breadth, lead FROM cal LEFT JOIN (SELECT d, CASE WHEN ma IS NOT NULL THEN CASE WHEN adj > ma THEN 1.0 ELSE 0.0 END END AS bull FROM (SELECT d, adj, {rolled('avg', 'adj', 200, 'ORDER BY d')} AS ma FROM bm)) USING (d)"
    + "".join(f" LEFT JOIN ({on_days(s, c)}) USING (d)" for s, c in (("s_feat_macro_chg", "move"), ("s_feat_macro_yoy_accel", "accel"), ("s_feat_macro_pctile", "pctile"), ("s_feat_macro_level", "vix")))
    + " LEFT JOIN brd USING (d) LEFT JOIN (SELECT d, rs0.b63 - rb0.b63 AS lead FROM rs0 JOIN rb0 USING (d) WHERE sector_id = 0) USING (d)",
)
CTE["env"] = (("envd",), "SELECT d, " + ", ".join(f"last_value({c} IGNORE NULLS) OVER (ORDER BY d) AS {c}" for c in SERIES) + " FROM envd")


def latest_values(t: Tables) -> DataFrame:
    """The latest market values of each day."""
    ma = ft.rolling(F.avg, "adj", 200, ft.market_days())
    first = ft.relative_returns(t.sx.where("sector_id = 0").withColumnRenamed("sector_id", "instrument_id"), t.bm, ["d"], "spy", (63,)).select("d", F.col("rel_ret_spy_63d").alias("lead"))
    parts = [
        t.bm.select("d", (F.col("adj") > ma).cast("double").alias("bull")), ft.on_calendar(t.cal, ft.macro_change(t.mo, "DGS10", 63), "move"), ft.on_calendar(t.cal, ft.year_on_year(t.mo, "CPI", 3), "accel"),
        ft.on_calendar(t.cal, ft.trailing_percentile(t.mo, "VIX"), "pctile"), ft.on_calendar(t.cal, t.mo.where("code = 'VIX'"), "vix"), ft.sector_breadth(t.sx).withColumnRenamed("sector_breadth_ma50", "breadth"), first,
    ]
    days = reduce(lambda a, b: a.join(b, "d", "left"), parts, t.cal.select("d"))
    upto = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)  # days of the calendar
    return days.select("d", *[F.last(c, True).over(upto).alias(c) for c in SERIES])


def environment(t: Tables) -> DataFrame:
    """Labels of each day from the latest values; where a default stands in for a missing value, 0 counts as missing."""
    return latest_values(t).select(
        "d", F.when(F.col("bull") == 1, "bull").alias("trend"), F.when(F.col("move") > 0.25, "rising").when(F.col("move") < -0.25, "falling").otherwise("stable").alias("rates"),
        F.when(F.col("accel") > 0, "accelerating").when(F.col("accel").isNotNull(), "decelerating").alias("inflation"),
        F.when(F.col("pctile") >= 0.8, "elevated").when((F.col("pctile") <= 0.2) & (F.col("pctile") != 0), "low").otherwise("normal").alias("volatility"), F.round("vix", 6).alias("vix"),
        F.when(F.col("breadth") >= 0.7, "strong").when((F.col("breadth") <= 0.3) & (F.col("breadth") != 0), "weak").when(F.col("breadth").isNotNull(), "mixed").alias("breadth"),
        F.when(F.col("lead") > 0, "leading").when(F.col("lead").isNotNull(), "lagging").alias("sector_leadership"),
    )


query(
    "ana_environment", "env",
    "SELECT d, CASE WHEN bull = 1 THEN 'bull' END AS trend, CASE WHEN move > 0.25 THEN 'rising' WHEN move < -0.25 THEN 'falling' ELSE 'stable' END AS rates, CASE WHEN accel > 0 THEN 'accelerating' WHEN accel IS NOT NULL THEN 'decelerating' END AS inflation,"
    " CASE WHEN pctile >= 0.8 THEN 'elevated' WHEN pctile <= 0.2 AND pctile <> 0 THEN 'low' ELSE 'normal' END AS volatility, round(vix, 6) AS vix, CASE WHEN breadth >= 0.7 THEN 'strong' WHEN breadth <= 0.3 AND breadth <> 0 THEN 'weak' WHEN breadth IS NOT NULL THEN 'mixed' END AS breadth,"
    " CASE WHEN lead > 0 THEN 'leading' WHEN lead IS NOT NULL THEN 'lagging' END AS sector_leadership FROM env",
)(environment)
CTE["wlab0"] = (("wr", "env", "since"), "SELECT wr.*, bull, pctile, move, accel, breadth, lead, wr.as_of - s.last_report AS since FROM wr LEFT JOIN env ON env.d = wr.as_of LEFT JOIN since s ON s.instrument_id = wr.instrument_id AND s.d = wr.as_of")
_label = {
    "trend": "WHEN bull = 1 THEN 'bull' WHEN bull = 0 THEN 'bear'",
    "volatility": "WHEN pctile >= 0.8 THEN 'high' WHEN pctile <= 0.2 AND pctile <> 0 THEN 'low' ELSE 'mid'",
    "rates": "WHEN move > 0.25 THEN 'rising' WHEN move < -0.25 THEN 'falling' ELSE 'stable'",
    "inflation": "WHEN accel > 0 THEN 'accelerating' ELSE 'decelerating'",
    "breadth": "WHEN breadth >= 0.7 THEN 'strong' WHEN breadth <= 0.3 AND breadth <> 0 THEN 'weak' ELSE 'mixed'",
    "technology": "WHEN lead > 0 THEN 'leading' ELSE 'lagging'",
    "earnings_window": "WHEN since <= 10 THEN 'post' ELSE 'outside'",
}
CTE["wlab"] = (("wlab0",), " UNION ALL ".join(f"SELECT '{n}' AS dimension, CASE {c} END AS regime, system, horizon, score, p_up, hit, realized_excess FROM wlab0" for n, c in _label.items()))
_cells = ["dimension", "regime", *KEY]
_by = ", ".join(_cells)
_rho = sql_spearman("wlab", "score", "realized_excess", _by).replace("corr(rx, ry)", "CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END")


def labelled_predictions(t: Tables) -> DataFrame:
    """Evaluated predictions once per dimension, with the label of their instrument and date."""
    values = latest_values(t).drop("vix").withColumnRenamed("d", "as_of")  # one row a session
    since = ft.earnings_features(t.px, t.ea).select("instrument_id", F.col("d").alias("as_of"), F.col("days_since_earnings").alias("since"))
    rows = prepared(t).select("instrument_id", "as_of", *KEY, "score", "p_up", "hit", "realized_excess")
    return regimes.labelled(sinks.written(rows.join(F.broadcast(values), "as_of", "left").join(since, ["instrument_id", "as_of"], "left"), "scored"))


query("wf_regime_labels", "wlab", f"SELECT a.*, round(s.spearman, 6) AS spearman FROM (SELECT {_by}, {ACC} FROM wlab WHERE regime IS NOT NULL GROUP BY ALL) a JOIN ({_rho}) s USING ({_by})", stored=True)(
    lambda t: neat(ev.accuracy(labelled_predictions(t), _cells), *ACC_COLUMNS)
)
_known = "SELECT px.instrument_id, px.d, CASE WHEN n.next_event IS NOT NULL THEN n.next_event - px.d END AS days_until, px.d - s.last_report AS days_since, exp(-ln(2.0) * (px.d - s.last_report) / 21) AS recency, g.eps_surprise FROM px"
CTE["untild"] = (("px", "ea"), "SELECT px.instrument_id, px.d, min(e.earnings_date) AS next_event FROM px LEFT JOIN (SELECT DISTINCT instrument_id, earnings_date, min(observed_on) OVER (PARTITION BY instrument_id, earnings_date) AS known FROM ea) e ON e.instrument_id = px.instrument_id AND e.known <= px.d AND e.earnings_date > px.d GROUP BY 1, 2")
CTE["surp"] = (("px", "ed"), "SELECT px.instrument_id, px.d, f.eps_surprise FROM px ASOF LEFT JOIN (SELECT * FROM ed WHERE eps_surprise IS NOT NULL) f ON px.instrument_id = f.instrument_id AND px.d >= f.earnings_date")
CTE["cat"] = (("px", "untild", "since", "surp"), f"{_known} LEFT JOIN untild n USING (instrument_id, d) LEFT JOIN since s USING (instrument_id, d) LEFT JOIN surp g USING (instrument_id, d)")
CTE["catl"] = (
    ("cat",),
    "SELECT instrument_id, d, max(CASE WHEN days_until IS NOT NULL THEN d END) OVER w AS until_on, last_value(days_until IGNORE NULLS) OVER w AS days_until, last_value(days_since IGNORE NULLS) OVER w AS days_since, last_value(recency IGNORE NULLS) OVER w AS recency, last_value(eps_surprise IGNORE NULLS) OVER w AS eps_surprise FROM cat WINDOW w AS (PARTITION BY instrument_id ORDER BY d)",
)


def catalysts(t: Tables) -> DataFrame:
    """Latest catalyst values of each instrument at each date of the grid; days until a report hold on their own date only."""
    days = ft.earnings_features(t.px, t.ea).join(until(t), ["instrument_id", "d"]).withColumn("days_until", F.datediff("next_event", "d"))
    days = days.withColumnsRenamed({"days_since_earnings": "days_since", "earnings_recency": "recency"}).withColumn("until_on", F.when(F.col("days_until").isNotNull(), F.col("d")))
    names = ["until_on", "days_until", "days_since", "recency", "eps_surprise"]
    upto = Window.partitionBy("instrument_id").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    latest = days.select("instrument_id", "d", *[F.last(c, True).over(upto).alias(c) for c in names])
    cells = t.inst.select("instrument_id").crossJoin(F.broadcast(quarters(t)))
    found = pit.asof(cells, latest, ["instrument_id"], "as_of", "d", ["d", *names]).where("d is not null")
    return found.select("instrument_id", "as_of", F.when(F.col("until_on") == F.col("as_of"), F.col("days_until")).cast("int").alias("days_until"), F.col("days_since").cast("int").alias("days_since"), "recency", "eps_surprise")


query("ana_catalysts", "catl quarters", "SELECT c.instrument_id, as_of, CAST(CASE WHEN until_on = as_of THEN days_until END AS INTEGER) AS days_until, CAST(days_since AS INTEGER) AS days_since, round(recency, 6) AS recency, round(eps_surprise, 6) AS eps_surprise FROM (SELECT DISTINCT instrument_id FROM px) i CROSS JOIN quarters ASOF JOIN catl c ON c.instrument_id = i.instrument_id AND as_of >= c.d")(
    lambda t: neat(catalysts(t), "recency", "eps_surprise")
)
