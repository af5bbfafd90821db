"""Queries of evidence combination, scoring, attribution and reports; model evidence is fixed arithmetic on features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlake.functions import stats
from pitlake.operators import decision as dc
from pitlake.operators import evaluate as ev
from pitlake.operators import features as ft
from pitlake.plans.evaluate_queries import LABEL
from pitlake.plans.registry import CTE, Tables, query
from pitlake.plans.research_queries import neat

MODELS = {"momentum": "ret_63d", "trend": "price_to_ma50", "reversal": "-ret_5d", "calm": "0.2 - vol_21d / 500"}
CTE["months"] = (("cal",), "SELECT min(d) AS as_of FROM cal GROUP BY date_trunc('month', d)")
CTE["me0"] = (("pf", "months"), "SELECT pf.*, as_of FROM pf JOIN months ON pf.d = months.as_of")
CTE["me1"] = (("me0",), " UNION ALL ".join(f"SELECT instrument_id, as_of, '{m}' AS model, ({x}) / (1 + abs({x})) AS x FROM me0" for m, x in MODELS.items()))
CTE["me"] = (("me1",), "SELECT *, CASE WHEN x IS NULL THEN 'omitted' WHEN abs(x) < 0.05 THEN 'neutral' ELSE 'participating' END AS part, 0.02 * x AS effect, 0.01 * (1 + abs(x)) AS se FROM me1")


def evidence(t: Tables) -> DataFrame:
    months = t.cal.groupBy(F.trunc("d", "month").alias("m")).agg(F.min("d").alias("as_of")).select("as_of")
    f = ft.price_features(t.px).join(F.broadcast(months), F.col("d") == F.col("as_of"))
    x = F.expr("stack(4, " + ", ".join(f"'{m}', ({e}) / (1 + abs({e}))" for m, e in MODELS.items()) + ") as (model, x)")
    return f.select("instrument_id", "as_of", x).withColumn("effect", 0.02 * F.col("x")).withColumn("se", 0.01 * (1 + F.abs("x")))


PRIOR = "SELECT a.model AS s1, b.model AS s2, CASE WHEN a.model = b.model THEN 1.0 WHEN (a.model = 'momentum' AND b.model = 'trend') OR (a.model = 'trend' AND b.model = 'momentum') THEN 0.5 ELSE 0.2 END::DOUBLE AS rho FROM (SELECT DISTINCT model FROM me) a CROSS JOIN (SELECT DISTINCT model FROM me) b"
CTE["prior"] = (("me",), PRIOR)


def prior(t: Tables) -> DataFrame:
    return dc.prior_correlations(t.spark.createDataFrame([("momentum", "trend")], "s1 string, s2 string"), t.spark.createDataFrame([(m,) for m in MODELS], "model string"))


query("eng_prior_correlation", "prior", "SELECT * FROM prior")(lambda t: dc.prior_correlations(t.spark.createDataFrame([("momentum", "trend")], "s1 string, s2 string"), evidence(t).select("model").distinct()))
CTE["mp"] = (("me",), "SELECT *, 1 / (se * se) AS w FROM me WHERE part = 'participating'")
CTE["mc"] = (
    ("mp", "prior"),
    "SELECT t.instrument_id, t.as_of, t.effect, sqrt(v) / t.sw AS se, greatest(-4, least(4, t.effect / (sqrt(v) / t.sw))) AS z, g.agreement, t.n FROM (SELECT instrument_id, as_of, sum(w) AS sw, sum(w * effect) / sum(w) AS effect, count(*) AS n FROM mp GROUP BY 1, 2) t"
    " JOIN (SELECT a.instrument_id, a.as_of, sum(a.w * b.w * rho * a.se * b.se) AS v FROM mp a JOIN mp b USING (instrument_id, as_of) JOIN prior ON s1 = a.model AND s2 = b.model GROUP BY 1, 2) q USING (instrument_id, as_of)"
    " JOIN (SELECT m.instrument_id, m.as_of, sum(CASE WHEN sign(m.effect) = sign(c.effect) THEN w ELSE 0 END) / sum(w) AS agreement FROM mp m JOIN (SELECT instrument_id, as_of, sum(w * effect) / sum(w) AS effect FROM mp GROUP BY 1, 2) c USING (instrument_id, as_of) GROUP BY 1, 2) g USING (instrument_id, as_of)",
)
CTE["asm"] = (("mc",), f"SELECT *, 100 * ({stats.norm_cdf_sql('z')}) AS score, least(1, n / (n + 2.0) * agreement) AS confidence FROM mc")
NUMBERS = ("effect", "se", "z", "agreement", "score", "confidence")


def assessed(t: Tables) -> DataFrame:
    return dc.combine(evidence(t), prior(t))


query("eng_combine", "asm", "SELECT instrument_id, as_of, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in NUMBERS) + " FROM asm")(lambda t: neat(assessed(t), *NUMBERS))
CTE["tr"] = (
    ("asm",),
    "SELECT *, greatest(0, least(100, evidence + adjustment)) AS trim FROM (SELECT *, 50 + confidence * (50 - score) AS evidence, greatest(-10, least(10, 10 * greatest(0, weight / 0.15 - 1) + 25 * (risk_share - weight))) AS adjustment FROM (SELECT *, (1 + instrument_id % 5) / 12.0 AS weight, (1 + instrument_id % 7) / 14.0 AS risk_share FROM asm))",
)


def trimmed(t: Tables) -> DataFrame:
    return dc.trim(assessed(t).withColumn("weight", (1 + F.col("instrument_id") % 5) / 12.0).withColumn("risk_share", (1 + F.col("instrument_id") % 7) / 14.0))


query("eng_trim_score", "tr", "SELECT instrument_id, as_of, round(evidence, 5) AS evidence, round(adjustment, 5) AS adjustment, round(trim, 5) AS trim FROM tr")(lambda t: trimmed(t).select("instrument_id", "as_of", *[F.round(c, 5).alias(c) for c in ("evidence", "adjustment", "trim")]))
TRIM_LABEL = LABEL.replace("score", "trim")
NAMES = [n for _, n in ev.BANDS]
AT = "CASE " + " ".join(f"WHEN band = '{n}' THEN {i}" for i, n in enumerate(NAMES)) + " END"
CTE["lb"] = (("tr",), f"SELECT *, list_extract([{', '.join(repr(n) for n in NAMES)}], CAST(CASE WHEN confidence >= 0.3 THEN k WHEN k > 2 THEN k - 1 WHEN k < 2 THEN k + 1 ELSE k END + 1 AS BIGINT)) AS label FROM (SELECT *, {AT} AS k FROM (SELECT *, {TRIM_LABEL} AS band FROM tr))")


def labelled(t: Tables) -> DataFrame:
    return dc.label(trimmed(t))


query("eng_label", "lb", "SELECT instrument_id, as_of, label FROM lb")(lambda t: labelled(t).select("instrument_id", "as_of", "label"))
query("eng_data_quality", "asm", "SELECT instrument_id, as_of, CASE WHEN n = 0 THEN 'no_evidence' WHEN n < 2 THEN 'sparse' WHEN confidence < 0.2 THEN 'conflicted' WHEN confidence >= 0.5 THEN 'strong' ELSE 'moderate' END AS quality FROM asm")(lambda t: assessed(t).select("instrument_id", "as_of", dc.data_quality(F.col("n"), F.col("confidence")).alias("quality")))
CTE["contrib"] = (
    ("mp", "asm"),
    "SELECT *, row_number() OVER o AS rank, 50 + sum(contribution) OVER (PARTITION BY instrument_id, as_of ORDER BY abs(contribution) DESC, model ROWS UNBOUNDED PRECEDING) AS running FROM (SELECT instrument_id, as_of, model, confidence * (50 - score) * share AS contribution, evidence FROM (SELECT instrument_id, as_of, model, w * effect / sum(w * effect) OVER (PARTITION BY instrument_id, as_of) AS share FROM mp) JOIN (SELECT *, 50 + confidence * (50 - score) AS evidence FROM asm) USING (instrument_id, as_of)) WINDOW o AS (PARTITION BY instrument_id, as_of ORDER BY abs(contribution) DESC, model)",
)


def attributed(t: Tables) -> DataFrame:
    return dc.attribution(evidence(t), assessed(t))


query("eng_attribution", "contrib", "SELECT instrument_id, as_of, model, round(contribution, 4) AS contribution, CAST(rank AS INTEGER) AS rank, round(running, 4) AS running FROM contrib")(lambda t: attributed(t).select("instrument_id", "as_of", "model", F.round("contribution", 4).alias("contribution"), "rank", F.round("running", 4).alias("running")))
query("eng_attribution_check", "contrib", "SELECT count(*) AS checked, count(*) FILTER (abs(total - evidence) > 1e-6) AS broken FROM (SELECT instrument_id, as_of, 50 + sum(contribution) AS total, any_value(evidence) AS evidence FROM contrib GROUP BY 1, 2)")(
    lambda t: attributed(t).groupBy("instrument_id", "as_of").agg((50 + F.sum("contribution")).alias("total"), F.first(50 + F.col("confidence") * (50 - F.col("score"))).alias("evidence")).agg(F.count("*").alias("checked"), F.count_if(F.abs(F.col("total") - F.col("evidence")) > 1e-6).alias("broken"))
)
query("eng_band_distance", "tr", f"SELECT instrument_id, as_of, round(trim - (SELECT max(b) FROM (VALUES {', '.join(f'({x}::DOUBLE)' for x, _ in ev.BANDS)}) v(b) WHERE b <= trim), 5) AS to_lower, round((SELECT min(b) FROM (VALUES {', '.join(f'({x}::DOUBLE)' for x, _ in ev.BANDS)}) v(b) WHERE b > trim) - trim, 5) AS to_upper FROM tr")(
    lambda t: dc.band_distance(trimmed(t)).select("instrument_id", "as_of", F.round("to_lower", 5).alias("to_lower"), F.round("to_upper", 5).alias("to_upper"))
)
_arrow = "CASE WHEN lag(as_of) OVER w IS NOT NULL AND {c} IS DISTINCT FROM lag({c}) OVER w THEN coalesce(lag({c}) OVER w, '-') || ' -> ' || coalesce({c}, '-') END"
_less = "CASE WHEN lag(as_of) OVER w IS NOT NULL THEN nullif(array_to_string(list_sort(list_filter({a}, lambda m: NOT list_contains({b}, m))), ', '), '') END"
CTE["asd"] = (
    ("lb", "contrib", "mp"),
    "SELECT lb.*, d.driver, m.models FROM lb LEFT JOIN (SELECT instrument_id, as_of, model AS driver FROM contrib WHERE rank = 1) d USING (instrument_id, as_of) LEFT JOIN (SELECT instrument_id, as_of, list_sort(list(model)) AS models FROM mp GROUP BY 1, 2) m USING (instrument_id, as_of)",
)
CTE["asdl"] = (("asd",), "SELECT *, lag(models) OVER (PARTITION BY instrument_id ORDER BY as_of) AS p_models FROM asd")
query(
    "eng_diff_previous", "asdl",
    f"SELECT instrument_id, as_of, lag(as_of) OVER w AS previous_as_of, round(trim - lag(trim) OVER w, 5) AS delta, {_arrow.format(c='label')} AS label_change, {_arrow.format(c='driver')} AS driver_change, {_less.format(a='models', b='p_models')} AS appeared, {_less.format(a='p_models', b='models')} AS went_quiet,"
    " coalesce(abs(confidence - lag(confidence) OVER w) >= 0.15, false) AS confidence_moved, coalesce((effect > 0) <> (lag(effect) OVER w > 0), false) AS direction_flipped, coalesce(abs(adjustment - lag(adjustment) OVER w) > 1, false) AS adjustment_moved FROM asdl WINDOW w AS (PARTITION BY instrument_id ORDER BY as_of)",
)(lambda t: dc.diff_previous(assessments(t)).withColumn("delta", F.round("delta", 5)))


def assessments(t: Tables) -> DataFrame:
    """Labelled scores with their largest driver and the models that took part."""
    driver = attributed(t).where("rank = 1").select("instrument_id", "as_of", F.col("model").alias("driver"))
    models = dc.participation(evidence(t)).where("part = 'participating'").groupBy("instrument_id", "as_of").agg(F.sort_array(F.collect_list("model")).alias("models"))
    return labelled(t).join(driver, ["instrument_id", "as_of"], "left").join(models, ["instrument_id", "as_of"], "left")


query("eng_unknowns", "me", "SELECT instrument_id, as_of, model, part FROM me WHERE part <> 'participating'")(lambda t: dc.participation(evidence(t)).where("part <> 'participating'").select("instrument_id", "as_of", "model", "part"))
query("mod_neutral", "me", "SELECT model, part, count(*) AS n FROM me GROUP BY 1, 2")(lambda t: dc.participation(evidence(t)).groupBy("model", "part").agg(F.count("*").alias("n")))
query("mod_normalize", "mp", "SELECT instrument_id, as_of, model, round(effect - se, 8) AS downside, round(effect + se, 8) AS upside, round(abs(effect / se) / 4, 6) AS strength FROM mp")(
    lambda t: dc.participation(evidence(t)).where("part = 'participating'").select("instrument_id", "as_of", "model", F.round(F.col("effect") - F.col("se"), 8).alias("downside"), F.round(F.col("effect") + F.col("se"), 8).alias("upside"), F.round(F.abs(F.col("effect") / F.col("se")) / 4, 6).alias("strength"))
)
query("mod_validate", "me", "SELECT model, count(*) FILTER (se <= 0) AS bad_error, count(*) FILTER (part = 'omitted' AND effect IS NOT NULL) AS omitted_with_value FROM me GROUP BY 1")(
    lambda t: dc.participation(evidence(t)).groupBy("model").agg(F.count_if(F.col("se") <= 0).alias("bad_error"), F.count_if((F.col("part") == "omitted") & F.col("effect").isNotNull()).alias("omitted_with_value"))
)
query("eng_theses", "mp", "SELECT instrument_id, as_of, model, side, CAST(n AS INTEGER) AS n FROM (SELECT *, CASE WHEN effect > 0 THEN 'for' ELSE 'against' END AS side, row_number() OVER (PARTITION BY instrument_id, as_of, effect > 0 ORDER BY abs(effect / se) DESC, model) AS n FROM mp) WHERE n <= 5")(
    lambda t: dc.participation(evidence(t)).where("part = 'participating'").withColumn("side", F.when(F.col("effect") > 0, "for").otherwise("against")).withColumn("n", F.row_number().over(Window.partitionBy("instrument_id", "as_of", "side").orderBy(F.desc(F.abs(F.col("effect") / F.col("se"))), "model"))).where("n <= 5").select("instrument_id", "as_of", "model", "side", "n")
)
query("rep_overview", "lb", "SELECT as_of, label, count(*) AS n, arg_max(instrument_id, (weight, instrument_id)) AS largest FROM lb GROUP BY 1, 2")(
    lambda t: labelled(t).groupBy("as_of", "label").agg(F.count("*").alias("n"), F.max_by("instrument_id", F.struct("weight", "instrument_id")).alias("largest"))
)
RANKS = {"highest_trim": "trim DESC", "strongest_maintain": "trim ASC", "uncertainty": "confidence ASC", "pressure": "adjustment DESC"}
query("rep_rankings", "lb", " UNION ALL ".join(f"SELECT as_of, '{n}' AS list, instrument_id, CAST(r AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY round({o.split()[0]}, 6) {o.split()[1]}, instrument_id) AS r FROM lb) WHERE r <= 10" for n, o in RANKS.items()))(
    lambda t: (lambda rows: reduce(DataFrame.union, [
        rows.withColumn("place", F.row_number().over(Window.partitionBy("as_of").orderBy(F.expr(f"round({o.split()[0]}, 6)").desc() if o.endswith("DESC") else F.expr(f"round({o.split()[0]}, 6)").asc(), "instrument_id"))).where("place <= 10").select("as_of", F.lit(n).alias("list"), "instrument_id", "place")
        for n, o in RANKS.items()
    ]))(labelled(t))
)
query("rep_segments", "lb", "SELECT instrument_id, label, min(as_of) AS from_at, max(as_of) AS to_at, count(*) AS n FROM (SELECT *, sum(nw) OVER (PARTITION BY instrument_id ORDER BY as_of) AS run FROM (SELECT *, CASE WHEN label IS NOT DISTINCT FROM lag(label) OVER (PARTITION BY instrument_id ORDER BY as_of) THEN 0 ELSE 1 END AS nw FROM lb)) GROUP BY instrument_id, run, label")(
    lambda t: dc.segments(labelled(t), ["instrument_id"], "as_of", "label")
)
query("rep_spread", "pr", "SELECT instrument_id, as_of, spread FROM (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY spread DESC, instrument_id) AS n FROM (SELECT instrument_id, as_of, round(max(score) - min(score), 4) AS spread FROM pr GROUP BY 1, 2)) WHERE n <= 10")(
    lambda t: _predictions(t).groupBy("instrument_id", "as_of").agg(F.round(F.max("score") - F.min("score"), 4).alias("spread")).withColumn("n", F.row_number().over(Window.partitionBy("as_of").orderBy(F.desc("spread"), "instrument_id"))).where("n <= 10").drop("n")
)
query("rep_position_summary", "pr", "SELECT instrument_id, as_of, max(score) FILTER (horizon = 21) AS h21, max(score) FILTER (horizon = 63) AS h63 FROM pr WHERE system = 'combined' GROUP BY 1, 2")(
    lambda t: _predictions(t).where("system = 'combined'").groupBy("instrument_id", "as_of").pivot("horizon", [21, 63]).agg(F.max("score")).withColumnsRenamed({"21": "h21", "63": "h63"})
)


def _predictions(t: Tables) -> DataFrame:
    from pitlake.plans.evaluate_queries import predictions

    return predictions(t)
