"""Queries of the research engine: studies over the feature store, their statistics, and how independent they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.functions import stats
from pitlake.operators import research as rs
from pitlake.plans.feature_queries import BY, store
from pitlake.plans.registry import CTE, Tables, query

#: Three studies as rows of filters.
FILTERS = (("trend", "price_to_ma50", ">", 0.0), ("dip", "ret_21d", "<", -0.02), ("dip", "vol_21d", ">", 120.0), ("calm", "price_to_ma50", ">=", 0.01), ("calm", "ret_21d", ">", 0.0), ("calm", "vol_21d", "<=", 120.0))
CTE["filt"] = ((), "SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{f}', '{o}', {x}::DOUBLE)" for s, f, o, x in FILTERS) + ") t(study, feature, op, lim)")
OK = "CASE op WHEN '>' THEN value > lim WHEN '>=' THEN value >= lim WHEN '<' THEN value < lim WHEN '<=' THEN value <= lim END"
CTE["elig"] = (("store", "filt"), f"SELECT study, instrument_id, d, bool_and({OK}) AS match FROM store JOIN filt USING (feature) JOIN (SELECT study, count(*) AS n FROM filt GROUP BY 1) USING (study) GROUP BY study, instrument_id, d, n HAVING count(*) = n")
CTE["ev"] = (("elig",), "SELECT study, instrument_id, d FROM (SELECT *, lag(match) OVER (PARTITION BY study, instrument_id ORDER BY d) AS b FROM elig) WHERE match AND NOT coalesce(b, false)")
CTE["fwd"] = (("px",), " UNION ALL ".join(f"SELECT instrument_id, d, {h} AS horizon, lead(adj, {h}) OVER ({BY}) / adj - 1 AS fwd FROM px" for h in rs.HORIZONS))
CTE["evf"] = (("ev", "fwd"), "SELECT study, instrument_id, d, horizon, fwd FROM ev JOIN fwd USING (instrument_id, d) WHERE fwd IS NOT NULL")


def filters(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(list(FILTERS), 'study string, feature string, op string, `limit` double')


def days(t: Tables) -> DataFrame:
    return rs.eligible_days(store(t), filters(t))


def found(t: Tables) -> DataFrame:
    """Events with their forward returns."""
    return rs.events(days(t)).join(rs.forward_returns(t.px), ["instrument_id", "d"]).where("fwd is not null")


SUMMARY = (
    "count(*) AS n, round(avg(fwd), 6) AS mean, round(median(fwd), 6) AS median, round(stddev_samp(fwd), 6) AS std, round(avg(CASE WHEN fwd > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(max(fwd), 6) AS max_gain, round(min(fwd), 6) AS max_loss,"
    " round(quantile_cont(fwd, 0.25), 6) AS q25, round(quantile_cont(fwd, 0.75), 6) AS q75, round(avg(fwd) - 1.959963984540054 * stddev_samp(fwd) / sqrt(count(*)), 6) AS ci_low, round(avg(fwd) + 1.959963984540054 * stddev_samp(fwd) / sqrt(count(*)), 6) AS ci_high"
)
NUMBERS = ("mean", "median", "std", "hit_rate", "max_gain", "max_loss", "q25", "q75", "ci_low", "ci_high")


def neat(df: DataFrame, *numbers: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in numbers else F.col(c) for c in df.columns])


query("res_filter_ops", "store filt", f"SELECT study, feature, count(*) AS n, count(*) FILTER ({OK}) AS passing FROM store JOIN filt USING (feature) GROUP BY 1, 2")(
    lambda t: store(t).join(F.broadcast(filters(t)), "feature").groupBy("study", "feature").agg(F.count("*").alias("n"), F.count_if(rs.holds(F.col("value"), F.col("op"), F.col("limit"))).alias("passing"))
)
query("res_eligible", "elig", "SELECT study, instrument_id, count(*) AS n FROM elig GROUP BY 1, 2")(lambda t: days(t).groupBy("study", "instrument_id").agg(F.count("*").alias("n")))
query("res_match_and", "elig", "SELECT study, instrument_id, d FROM elig WHERE match AND study = 'calm'")(lambda t: days(t).where("match and study = 'calm'").drop("match"))
query("res_collapse_events", "ev", "SELECT * FROM ev")(lambda t: rs.events(days(t)))
query("res_mode_all", "elig", "SELECT study, instrument_id, d FROM elig WHERE match")(lambda t: days(t).where("match").drop("match"))
query("res_forward_returns", "fwd", "SELECT instrument_id, d, horizon, round(fwd, 6) AS fwd FROM fwd")(lambda t: neat(rs.forward_returns(t.px), "fwd"))
query("res_summary", "evf", f"SELECT study, horizon, {SUMMARY} FROM evf GROUP BY 1, 2")(lambda t: neat(rs.summary(found(t), ["study", "horizon"]), *NUMBERS))
query(
    "res_histogram", "evf",
    "SELECT study, horizon, CAST(least(floor((fwd - lo) / ((hi - lo) / bins)), bins - 1) AS INTEGER) AS bin, count(*) AS n FROM evf JOIN (SELECT study, horizon, least(10, count(*)) AS bins, CASE WHEN min(fwd) = max(fwd) THEN min(fwd) - 0.5 ELSE min(fwd) END AS lo, CASE WHEN min(fwd) = max(fwd) THEN max(fwd) + 0.5 ELSE max(fwd) END AS hi FROM evf GROUP BY 1, 2) USING (study, horizon) GROUP BY 1, 2, 3",
)(lambda t: rs.histogram(found(t), ["study", "horizon"]))
CTE["base"] = (("elig", "fwd"), "SELECT study, instrument_id, d, horizon, fwd FROM elig JOIN fwd USING (instrument_id, d) WHERE fwd IS NOT NULL")
query("res_baseline", "base", f"SELECT study, horizon, {SUMMARY} FROM base GROUP BY 1, 2")(lambda t: neat(rs.summary(days(t).join(rs.forward_returns(t.px), ["instrument_id", "d"]), ["study", "horizon"]), *NUMBERS))
STUDY = f"SELECT study, horizon, {SUMMARY}, 'match' AS part FROM evf GROUP BY 1, 2 UNION ALL SELECT study, horizon, {SUMMARY}, 'baseline' FROM base GROUP BY 1, 2"
query("res_query", "evf base", STUDY)(lambda t: neat(rs.study(t.px, store(t), filters(t)), *NUMBERS))
AS_OF = "1998-12-31"
CTE["wev"] = (("evf",), f"SELECT *, pow(0.5, (DATE '{AS_OF}' - d) / 365.25 / 3.0) AS w FROM evf")
CTE["wm"] = (("wev",), "SELECT study, horizon, sum(w * fwd) / sum(w) AS m, sum(w) AS sw, sum(w * w) AS sw2, sum(w) * sum(w) / sum(w * w) AS n_eff FROM wev GROUP BY 1, 2")
query(
    "res_recency_stats", "wev wm",
    "SELECT study, horizon, count(*) AS n, round(any_value(m), 6) AS mean, round(sum(w * CASE WHEN fwd > 0 THEN 1.0 ELSE 0.0 END) / sum(w), 6) AS hit_rate, min(d) AS first_event, max(d) AS last_event, round(any_value(n_eff), 6) AS n_eff,"
    " round(sum(w * (fwd - m) * (fwd - m)) / sum(w) * any_value(n_eff) / (any_value(n_eff) - 1), 6) AS variance, round(sqrt(sum(w * (fwd - m) * (fwd - m)) / sum(w) / (any_value(n_eff) - 1)), 6) AS se FROM wev JOIN wm USING (study, horizon) GROUP BY 1, 2 HAVING count(*) >= 2 AND any_value(n_eff) > 1",
)(lambda t: neat(rs.recency_stats(found(t), ["study", "horizon"], F.lit(AS_OF).cast("date"), 3.0), "mean", "hit_rate", "n_eff", "variance", "se"))
query("res_overlap_inflation", "ev", "SELECT study, round(sum(greatest(0, 1 - abs(a.d - b.d) / 29.4) * a.c * b.c) / any_value(n), 6) AS inflation, CAST(any_value(n) AS BIGINT) AS n FROM (SELECT study, d, count(*) AS c FROM ev GROUP BY 1, 2) a JOIN (SELECT study, d, count(*) AS c FROM ev GROUP BY 1, 2) b USING (study) JOIN (SELECT study, count(*) AS n FROM ev GROUP BY 1) USING (study) GROUP BY 1")(
    lambda t: neat(rs.overlap_inflation(rs.events(days(t)), ["study"], 21), "inflation")
)
GRAM = "SELECT a.study AS s1, b.study AS s2, sum(greatest(0, 1 - abs(a.d - b.d) / 29.4) * a.c * b.c) AS g FROM (SELECT study, d, count(*) AS c FROM ev GROUP BY 1, 2) a JOIN (SELECT study, d, count(*) AS c FROM ev GROUP BY 1, 2) b ON abs(a.d - b.d) <= 29 GROUP BY 1, 2"
CTE["gram"] = (("ev",), GRAM)
CTE["rho"] = (("gram",), "SELECT g.s1, g.s2, g.g / sqrt(x.g * y.g) AS rho FROM gram g JOIN gram x ON x.s1 = g.s1 AND x.s2 = g.s1 JOIN gram y ON y.s1 = g.s2 AND y.s2 = g.s2")


def correlations(t: Tables, horizon: int = 21) -> DataFrame:
    """Normalised overlap of two studies' dates; a band join over distinct dates in buckets as wide as the kernel."""
    width = rs.OVERLAP_DAYS * horizon
    dates = rs.events(days(t)).groupBy("study", F.datediff("d", F.lit("1970-01-01").cast("date")).alias("day")).agg(F.count("*").alias("c")).withColumn("bucket", F.floor(F.col("day") / width))
    a = dates.select(F.col("study").alias("s1"), F.col("day").alias("day1"), F.col("c").alias("c1"), F.explode(F.array(F.col("bucket") - 1, "bucket", F.col("bucket") + 1)).alias("bucket"))
    b = dates.select(F.col("study").alias("s2"), F.col("day").alias("day2"), F.col("c").alias("c2"), "bucket")
    kernel = F.greatest(F.lit(0.0), 1 - F.abs(F.col("day1") - F.col("day2")) / width)
    gram = a.join(b, "bucket").groupBy("s1", "s2").agg(F.sum(kernel * F.col("c1") * F.col("c2")).alias("g"))
    own = gram.where("s1 = s2").select("s1", F.col("g").alias("g1"))
    return gram.join(F.broadcast(own), "s1").join(F.broadcast(own.select(F.col("s1").alias("s2"), F.col("g1").alias("g2"))), "s2").select("s1", "s2", (F.col("g") / F.sqrt(F.col("g1") * F.col("g2"))).alias("rho"))


query("res_cross_correlation", "rho", "SELECT s1, s2, round(rho, 6) AS rho FROM rho")(lambda t: neat(correlations(t), "rho"))
CTE["eff"] = (("evf",), "SELECT horizon, study, avg(fwd) AS effect, stddev_samp(fwd) / sqrt(count(*)) AS se, 1 / (var_samp(fwd) / count(*)) AS w FROM evf GROUP BY 1, 2")
CTE["comb"] = (
    ("eff", "rho"),
    "SELECT t.horizon, t.effect, sqrt(v.v) / t.w AS se, greatest(-4, least(4, t.effect / (sqrt(v.v) / t.w))) AS z, g.agreement FROM (SELECT horizon, sum(w) AS w, sum(w * effect) / sum(w) AS effect FROM eff GROUP BY 1) t"
    " JOIN (SELECT a.horizon, sum(a.w * b.w * CASE WHEN a.study = b.study THEN 1.0 ELSE coalesce(rho, 0.0) END * a.se * b.se) AS v FROM eff a JOIN eff b USING (horizon) LEFT JOIN rho ON rho.s1 = a.study AND rho.s2 = b.study GROUP BY 1) v USING (horizon)"
    " JOIN (SELECT e.horizon, sum(CASE WHEN sign(e.effect) = sign(c.effect) THEN e.w ELSE 0 END) / sum(e.w) AS agreement FROM eff e JOIN (SELECT horizon, sum(w * effect) / sum(w) AS effect FROM eff GROUP BY 1) c USING (horizon) GROUP BY 1) g USING (horizon)",
)


def effects(t: Tables) -> DataFrame:
    return found(t).groupBy("horizon", "study").agg(F.avg("fwd").alias("effect"), (F.stddev_samp("fwd") / F.sqrt(F.count("*"))).alias("se"))


query("res_combine_evidence", "comb", "SELECT horizon, round(effect, 6) AS effect, round(se, 6) AS se, round(z, 6) AS z, round(agreement, 6) AS agreement FROM comb")(
    lambda t: neat(rs.combine_evidence(effects(t), correlations(t), ["horizon"]), "effect", "se", "z", "agreement")
)
query("res_score_from_z", "eff", f"SELECT horizon, study, round(100 * ({stats.norm_cdf_sql('(effect / se / 10)')}), 6) AS score FROM eff")(lambda t: effects(t).select("horizon", "study", F.round(stats.score_from_z(F.col("effect") / F.col("se") / 10), 6).alias("score")))
query("res_confidence", "evf", "SELECT study, horizon, round(least(1, greatest(0, count(*) / (count(*) + 30.0) * avg(CASE WHEN fwd > 0 THEN 1.0 ELSE 0.0 END))), 6) AS confidence FROM evf GROUP BY 1, 2")(
    lambda t: found(t).groupBy("study", "horizon").agg(F.count("*").alias("n"), F.avg((F.col("fwd") > 0).cast("double")).alias("a")).select("study", "horizon", F.round(stats.confidence("n", 30.0, F.col("a")), 6).alias("confidence"))
)


def weighted(t: Tables) -> DataFrame:
    return found(t).withColumn("w", F.pow(F.lit(0.5), F.datediff(F.lit(AS_OF).cast("date"), "d") / 365.25 / 3.0))


query("res_weighted_moments", "wev wm", "SELECT study, horizon, round(any_value(m), 6) AS mean, round(any_value(n_eff), 6) AS n_eff, round(sum(CASE WHEN fwd > 0 THEN w ELSE 0 END) / sum(w), 6) AS p_positive, CASE WHEN any_value(n_eff) > 1 THEN round(sqrt(sum(w * (fwd - m) * (fwd - m)) / sum(w) * any_value(n_eff) / (any_value(n_eff) - 1)), 6) END AS std FROM wev JOIN wm USING (study, horizon) GROUP BY 1, 2")(
    lambda t: neat(rs.weighted_moments(weighted(t), ["study", "horizon"], "fwd", "w"), "mean", "n_eff", "p_positive", "std")
)
CTE["hazen"] = (("wev",), "SELECT study, horizon, fwd, p, lead(p) OVER o AS np, lead(fwd) OVER o AS nx, row_number() OVER o AS n FROM (SELECT *, (sum(w) OVER (PARTITION BY study, horizon ORDER BY fwd, w ROWS UNBOUNDED PRECEDING) - w / 2) / sum(w) OVER (PARTITION BY study, horizon) AS p, w FROM wev) WINDOW o AS (PARTITION BY study, horizon ORDER BY fwd, w)")
query("res_weighted_quantile", "hazen", "SELECT study, horizon, round(coalesce(max(CASE WHEN p <= 0.25 AND np > 0.25 THEN fwd + (0.25 - p) / (np - p) * (nx - fwd) END), max(CASE WHEN n = 1 AND p > 0.25 THEN fwd END), max(CASE WHEN np IS NULL THEN fwd END)), 6) AS quantile FROM hazen GROUP BY 1, 2")(
    lambda t: neat(rs.weighted_quantile(weighted(t), ["study", "horizon"], "fwd", "w", 0.25), "quantile")
)
CTE["epi"] = (("ev",), "SELECT study, d, sum(nw) OVER (PARTITION BY study ORDER BY d) AS episode FROM (SELECT study, d, CASE WHEN d - lag(d) OVER (PARTITION BY study ORDER BY d) <= 7.0 THEN 0 ELSE 1 END AS nw FROM (SELECT DISTINCT study, d FROM ev))")
query("res_calendar_episodes", "epi", "SELECT study, d, CAST(episode AS BIGINT) AS episode FROM epi")(lambda t: rs.calendar_episodes(rs.events(days(t)), ["study"], 5))
query("res_effective_sample", "wm epi evf", "SELECT study, horizon, round(n_eff * e.episodes / n.raw, 6) AS n_effective FROM wm JOIN (SELECT study, count(DISTINCT episode) AS episodes FROM epi GROUP BY 1) e USING (study) JOIN (SELECT study, horizon, count(*) AS raw FROM evf GROUP BY 1, 2) n USING (study, horizon)")(
    lambda t: weighted(t).groupBy("study", "horizon").agg((F.sum("w") ** 2 / F.sum(F.col("w") ** 2)).alias("k"), F.count("*").alias("raw"))
    .join(rs.calendar_episodes(rs.events(days(t)), ["study"], 5).groupBy("study").agg(F.max("episode").alias("episodes")), "study").select("study", "horizon", F.round(F.col("k") * F.col("episodes") / F.col("raw"), 6).alias("n_effective"))
)

WIL = f"({{p}} + {stats.Z95 ** 2} / (2 * n) {{s}} {stats.Z95} * sqrt({{p}} * (1 - {{p}}) / n + {stats.Z95 ** 2} / (4 * n * n))) / (1 + {stats.Z95 ** 2} / n)"
query("res_wilson", "evf", f"SELECT study, horizon, round({WIL.format(p='p', s='-')}, 6) AS low, round({WIL.format(p='p', s='+')}, 6) AS high FROM (SELECT study, horizon, count(*)::DOUBLE AS n, avg(CASE WHEN fwd > 0 THEN 1.0::DOUBLE ELSE 0 END) AS p FROM evf GROUP BY 1, 2)")(
    lambda t: (lambda w: found(t).groupBy("study", "horizon").agg(F.count("*").cast("double").alias("n"), F.avg((F.col("fwd") > 0).cast("double")).alias("p")).select("study", "horizon", F.round(w[0], 6).alias("low"), F.round(w[1], 6).alias("high")))(stats.wilson("p", "n"))
)
AHEAD = f"OVER ({BY} ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING)"
query("res_path_excursions", "px", f"SELECT instrument_id, d, round(mn / adj - 1, 6) AS mae, round(mx / adj - 1, 6) AS mfe FROM (SELECT instrument_id, d, adj, count(adj) {AHEAD} AS c, min(adj) {AHEAD} AS mn, max(adj) {AHEAD} AS mx FROM px) WHERE c = 21")(
    lambda t: neat(rs.path_excursions(t.px, 21).select("instrument_id", "d", "mae", "mfe"), "mae", "mfe")
)
query("res_forward_vol", "px", f"SELECT instrument_id, d, round(sd * sqrt(252.0), 6) AS fwd_vol FROM (SELECT instrument_id, d, count(adj) {AHEAD} AS c, stddev_samp(lr) {AHEAD} AS sd FROM (SELECT *, ln(adj / lag(adj) OVER ({BY})) AS lr FROM px)) WHERE c = 21")(
    lambda t: neat(rs.path_excursions(t.px, 21).select("instrument_id", "d", "fwd_vol"), "fwd_vol")
)
query("res_distribution", "evf", f"SELECT study, horizon, count(*) AS n, round(avg(fwd), 6) AS mean, round(stddev_samp(fwd), 6) AS std, round(avg(CASE WHEN fwd > 0 THEN 1.0 ELSE 0 END), 6) AS p_positive, {', '.join(f'round(quantile_cont(fwd, {x / 100}), 6) AS p{x}' for x in (10, 25, 75, 90))} FROM evf GROUP BY 1, 2")(
    lambda t: neat(found(t).groupBy("study", "horizon").agg(F.count("*").alias("n"), F.avg("fwd").alias("mean"), F.stddev_samp("fwd").alias("std"), F.avg((F.col("fwd") > 0).cast("double")).alias("p_positive"), *[F.percentile("fwd", x / 100).alias(f"p{x}") for x in (10, 25, 75, 90)]), "mean", "std", "p_positive", "p10", "p25", "p75", "p90")
)
query("res_exceedance", "wev", "SELECT study, horizon, round(sum(CASE WHEN fwd > 0.05 THEN w ELSE 0 END) / sum(w), 6) AS above, round(sum(CASE WHEN fwd < -0.05 THEN w ELSE 0 END) / sum(w), 6) AS below FROM wev GROUP BY 1, 2")(
    lambda t: weighted(t).groupBy("study", "horizon").agg(*[F.round(F.sum(F.when(c, F.col("w")).otherwise(0)) / F.sum("w"), 6).alias(n) for c, n in ((F.col("fwd") > 0.05, "above"), (F.col("fwd") < -0.05, "below"))])
)
HHI = "SELECT study, round(CAST(sum(c * c) AS DOUBLE) / (sum(c) * sum(c)), 6) AS {n} FROM (SELECT study, {x} AS k, count(*) AS c FROM {f} GROUP BY 1, 2) GROUP BY 1"
query("res_herfindahl", "ev", HHI.format(n="hhi_instrument_id", x="instrument_id", f="ev"))(lambda t: neat(rs.herfindahl(rs.events(days(t)), ["study"], "instrument_id"), "hhi_instrument_id"))
CTE["eve"] = (("ev", "epi"), "SELECT study, instrument_id AS symbol, d, year(d) AS year, episode FROM ev JOIN epi USING (study, d)")
CTE["indep"] = (
    ("eve",),
    "SELECT * FROM (SELECT study, count(*) AS raw, count(DISTINCT symbol) AS symbols, count(DISTINCT year) AS years, count(DISTINCT episode) AS episodes FROM eve GROUP BY 1)"
    + "".join(f" JOIN ({HHI.format(n=f'hhi_{x}', x=x, f='eve')}) USING (study)" for x in ("symbol", "year", "episode")),
)
query("res_independence", "indep", "SELECT * FROM indep")(lambda t: neat(rs.independence(rs.events(days(t)), ["study"], 5), "hhi_symbol", "hhi_year", "hhi_episode"))
query("cpe_support_gate", "indep", "SELECT study, raw >= 40 AND episodes >= 12 AND years >= 3 AND hhi_symbol <= 0.5 AND hhi_year <= 0.6 AS supported FROM indep")(
    lambda t: rs.independence(rs.events(days(t)), ["study"], 5).select("study", ((F.col("raw") >= 40) & (F.col("episodes") >= 12) & (F.col("years") >= 3) & (F.col("hhi_symbol") <= 0.5) & (F.col("hhi_year") <= 0.6)).alias("supported"))
)
