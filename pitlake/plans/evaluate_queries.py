"""Queries of the prediction archive and of walk-forward validation; predictions are fixed arithmetic on features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlake.operators import evaluate as ev
from pitlake.operators import features as ft
from pitlake.operators import research as rs
from pitlake.plans.registry import CTE, Tables, query
from pitlake.plans.research_queries import neat

SQUASH = "({x} / (1 + abs({x})))"
CTE["pr0"] = (("pf",), "SELECT instrument_id, d AS as_of, ret_21d AS a, price_to_ma50 AS b FROM pf WHERE ret_21d IS NOT NULL AND price_to_ma50 IS NOT NULL")
CTE["pr"] = (
    ("pr0",),
    "SELECT instrument_id, as_of, horizon, system, round(50 - 45 * s, 4) AS score, round(abs(s), 6) AS confidence, 0.05 * s AS expected, 0.05 * s - 0.01 AS expected_excess FROM (SELECT instrument_id, as_of, system, CASE system WHEN 'baseline' THEN a / (1 + abs(a)) ELSE (a / (1 + abs(a)) + b / (1 + abs(b))) / 2 END AS s FROM pr0 CROSS JOIN (VALUES ('baseline'), ('combined')) v(system)) CROSS JOIN (VALUES (21), (63)) h(horizon)",
)


def predictions(t: Tables) -> DataFrame:
    """Scores of two systems on every session of each instrument with all features, with what each model gave to them.

    The baseline is the momentum model alone; combined, momentum and trend weigh the same. Contributions add up to the expected excess.
    """
    rows = ft.price_features(t.px).select("instrument_id", F.col("d").alias("as_of"), F.col("ret_21d").alias("a"), F.col("price_to_ma50").alias("b")).where("a is not null and b is not null")
    a, b = (F.col(c) / (1 + F.abs(c)) for c in "ab")
    both = rows.select("instrument_id", "as_of", "a", "b", F.explode(F.array(F.struct(F.lit("baseline").alias("system"), a.alias("s")), F.struct(F.lit("combined").alias("system"), ((a + b) / 2).alias("s")))).alias("v")).select("instrument_id", "as_of", "a", "b", "v.*")
    part = lambda model, share, x: F.struct(F.lit(model).alias("model"), F.lit(share).alias("weight_share"), (0.05 * x - 0.01).alias("effect"))
    contributions = F.when(F.col("system") == "baseline", F.array(part("momentum", 1.0, a))).otherwise(F.array(part("momentum", 0.5, a), part("trend", 0.5, b)))
    return both.withColumn("horizon", F.explode(F.array(F.lit(21), F.lit(63)))).select(
        "instrument_id", "as_of", "horizon", "system", F.round(50 - 45 * F.col("s"), 4).alias("score"), F.round(F.abs("s"), 6).alias("confidence"), (0.05 * F.col("s")).alias("expected"), (0.05 * F.col("s") - 0.01).alias("expected_excess"),
        contributions.alias("contributions"),
    )


CTE["bfwd"] = (("bm",), " UNION ALL ".join(f"SELECT d, {h} AS horizon, lead(adj, {h}) OVER (ORDER BY d) / adj - 1 AS fwd FROM bm" for h in (21, 63)))
CTE["oc"] = (
    ("pr", "fwd", "bfwd"),
    "SELECT pr.*, f.fwd AS actual, b.fwd AS bench, f.fwd - b.fwd AS excess, f.fwd - expected AS error, abs(f.fwd - expected) AS abs_error, CASE WHEN expected <> 0 THEN sign(expected) = sign(f.fwd) END AS direction_ok FROM pr JOIN fwd f ON f.instrument_id = pr.instrument_id AND f.d = pr.as_of AND f.horizon = pr.horizon LEFT JOIN bfwd b ON b.d = pr.as_of AND b.horizon = pr.horizon WHERE f.fwd IS NOT NULL",
)


def evaluated(t: Tables) -> DataFrame:
    bench = t.bm.select("d", *[(F.lead("adj", h).over(ft.market_days()) / F.col("adj") - 1).alias(str(h)) for h in (21, 63)]).unpivot(["d"], ["21", "63"], "horizon", "fwd").withColumn("horizon", F.col("horizon").cast("int"))
    return ev.outcomes(predictions(t), rs.forward_returns(t.px, (21, 63)), F.broadcast(bench))


KEY = ["system", "horizon"]
CTE["wr"] = (("oc",), "SELECT *, actual - (expected - expected_excess) AS realized_excess, score / 100 AS p_up, CASE WHEN (score > 50) = (actual - (expected - expected_excess) > 0) THEN 1 ELSE 0 END AS hit FROM oc")


def prepared(t: Tables) -> DataFrame:
    return ev.prepare(evaluated(t))


query("ev_outcome", "oc", "SELECT instrument_id, as_of, horizon, system, round(actual, 6) AS actual, round(excess, 6) AS excess, round(error, 6) AS error, round(abs_error, 6) AS abs_error, direction_ok FROM oc")(
    lambda t: neat(evaluated(t).select("instrument_id", "as_of", "horizon", "system", "actual", "excess", "error", "abs_error", "direction_ok"), "actual", "excess", "error", "abs_error")
)
query("ev_archive", "pr", "SELECT horizon, system, count(*) AS inserted, count(*) FILTER (year(as_of) = 1995) AS skipped FROM pr GROUP BY 1, 2")(
    lambda t: (lambda p: p.join(p.where("year(as_of) = 1995").select("instrument_id", "as_of", "horizon", "system", F.lit(1).alias("old")), ["instrument_id", "as_of", "horizon", "system"], "left").groupBy("horizon", "system").agg(F.count("*").alias("inserted"), F.count("old").alias("skipped")))(predictions(t))
)
query("ev_pending", "pr fwd", "SELECT pr.instrument_id, pr.as_of, pr.horizon, pr.system FROM pr LEFT JOIN fwd f ON f.instrument_id = pr.instrument_id AND f.d = pr.as_of AND f.horizon = pr.horizon WHERE f.fwd IS NULL")(
    lambda t: predictions(t).join(evaluated(t).select("instrument_id", "as_of", "horizon", "system"), ["instrument_id", "as_of", "horizon", "system"], "left_anti").select("instrument_id", "as_of", "horizon", "system")
)
query("ev_maturity", "pr oc", "SELECT horizon, count(o.as_of) AS evaluated, count(*) - count(o.as_of) AS pending FROM pr LEFT JOIN oc o USING (instrument_id, as_of, horizon, system) GROUP BY 1")(
    lambda t: predictions(t).join(evaluated(t).select("instrument_id", "as_of", "horizon", "system", F.lit(1).alias("done")), ["instrument_id", "as_of", "horizon", "system"], "left").groupBy("horizon").agg(F.count("done").alias("evaluated"), (F.count("*") - F.count("done")).alias("pending"))
)
query("ev_calibration", "oc", "SELECT CAST(k AS INTEGER) AS bucket, count(o.score) AS n, round(avg(confidence), 6) AS confidence, round(avg(CASE WHEN direction_ok THEN 1.0 WHEN NOT direction_ok THEN 0.0 END), 6) AS accuracy, round(avg(abs_error), 6) AS mae FROM range(5) r(k) LEFT JOIN oc o ON least(floor(confidence / 0.2), 4) = k GROUP BY 1")(
    lambda t: t.spark.range(5).select(F.col("id").cast("int").alias("bucket")).join(evaluated(t).withColumn("bucket", ev.bucket("confidence", ev.CONFIDENCE_EDGES)).groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.avg(F.col("direction_ok").cast("double")), 6).alias("accuracy"), F.round(F.avg("abs_error"), 6).alias("mae")), "bucket", "left").fillna(0, ["n"])
)
query("ev_horizon_analytics", "oc", "SELECT horizon, round(sqrt(avg(error * error)), 6) AS rmse, round(avg(abs_error), 6) AS mae, round(avg(CASE WHEN direction_ok THEN 1.0 WHEN NOT direction_ok THEN 0.0 END), 6) AS accuracy, round(avg(excess), 6) AS mean_excess, round(avg(confidence) - avg(CASE WHEN direction_ok THEN 1.0 WHEN NOT direction_ok THEN 0.0 END), 6) AS calibration_gap FROM oc GROUP BY 1")(
    lambda t: neat(evaluated(t).groupBy("horizon").agg(F.sqrt(F.avg(F.col("error") ** 2)).alias("rmse"), F.avg("abs_error").alias("mae"), F.avg(F.col("direction_ok").cast("double")).alias("accuracy"), F.avg("excess").alias("mean_excess"), (F.avg("confidence") - F.avg(F.col("direction_ok").cast("double"))).alias("calibration_gap")), "rmse", "mae", "accuracy", "mean_excess", "calibration_gap")
)
query("ev_trim_buckets", "oc", "SELECT bucket, n, mean_score, mean_excess, coalesce(mean_excess > lag(mean_excess) OVER (ORDER BY bucket), false) AS inverted FROM (SELECT CAST(least(floor(score / 20), 4) AS INTEGER) AS bucket, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(excess), 6) AS mean_excess FROM oc GROUP BY 1)")(
    lambda t: evaluated(t).groupBy(ev.bucket("score", ev.SCORE_EDGES).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg("excess"), 6).alias("mean_excess")).withColumn("inverted", F.coalesce(F.col("mean_excess") > F.lag("mean_excess").over(Window.orderBy("bucket")), F.lit(False)))
)


def sql_spearman(table: str, x: str, y: str, keys: str) -> str:
    rank = "rank() OVER (PARTITION BY {k} ORDER BY {x}) + (count(*) OVER (PARTITION BY {k}, {x}) - 1) / 2.0"
    return f"SELECT {keys}, corr(rx, ry) AS spearman FROM (SELECT {keys}, {rank.format(k=keys, x=x)} AS rx, {rank.format(k=keys, x=y)} AS ry FROM {table} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) GROUP BY {keys}"


query("ev_spearman", "oc", f"SELECT system, horizon, round(spearman, 6) AS spearman FROM ({sql_spearman('oc', 'score', 'excess', 'system, horizon')})")(lambda t: neat(ev.spearman(evaluated(t), KEY, "score", "excess"), "spearman"))
query("wf_grid_stride", "cal", "SELECT d FROM cal WHERE (idx - 1) % 21 = 0")(lambda t: t.cal.where("(idx - 1) % 21 = 0").select("d"))
query("wf_grid_monthly", "cal px", "SELECT m.as_of, count(*) AS targets FROM (SELECT min(d) AS as_of FROM cal GROUP BY date_trunc('month', d)) m JOIN (SELECT instrument_id, min(d) AS first FROM px GROUP BY 1) f ON f.first <= m.as_of GROUP BY 1")(
    lambda t: t.px.groupBy("instrument_id").agg(F.min("d").alias("first")).join(F.broadcast(t.cal.groupBy(F.trunc("d", "month").alias("m")).agg(F.min("d").alias("as_of"))), F.col("first") <= F.col("as_of")).groupBy("as_of").agg(F.count("*").alias("targets"))
)
query("wf_prepare", "wr", "SELECT instrument_id, as_of, system, horizon, round(realized_excess, 6) AS realized_excess, round(p_up, 6) AS p_up, hit FROM wr")(lambda t: neat(prepared(t).select("instrument_id", "as_of", "system", "horizon", "realized_excess", "p_up", "hit"), "realized_excess", "p_up"))
query("wf_cohort", "wr", "SELECT instrument_id, as_of, system, horizon FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id, system, horizon ORDER BY as_of) - 1 AS n FROM wr) WHERE n % horizon = 0")(
    lambda t: ev.cohort(prepared(t), F.col("horizon"), ["instrument_id", "system", "horizon"]).select("instrument_id", "as_of", "system", "horizon")
)
Y = "CASE WHEN realized_excess > 0 THEN 1.0::DOUBLE ELSE 0.0 END"
PC = "greatest(0.01, least(0.99, p_up))"
ACC = f"count(*) AS n, round(avg(hit), 6) AS accuracy, round(avg((p_up - {Y}) * (p_up - {Y})), 6) AS brier, round(avg((0.5 - {Y}) * (0.5 - {Y})), 6) AS brier_half, round(avg(-({Y} * ln({PC}) + (1 - {Y}) * ln(1 - {PC}))), 6) AS log_loss, round(avg(realized_excess), 6) AS mean_excess"
ACC_COLUMNS = ("accuracy", "brier", "brier_half", "log_loss", "mean_excess", "spearman")
query("wf_accuracy", "wr", f"SELECT a.*, round(s.spearman, 6) AS spearman FROM (SELECT system, horizon, {ACC} FROM wr GROUP BY 1, 2) a JOIN ({sql_spearman('wr', 'score', 'realized_excess', 'system, horizon')}) s USING (system, horizon)")(lambda t: neat(ev.accuracy(prepared(t), KEY), *ACC_COLUMNS))
query("wf_per_holding", "wr", f"SELECT instrument_id, system, {ACC} FROM wr WHERE horizon = 21 GROUP BY 1, 2")(lambda t: neat(ev.accuracy(prepared(t).where("horizon = 21"), ["instrument_id", "system"]).drop("spearman"), *ACC_COLUMNS[:-1]))
query("wf_design_holdout", "wr", f"SELECT system, horizon, CASE WHEN as_of < DATE '1996-01-01' THEN 'design' ELSE 'holdout' END AS part, {ACC} FROM wr GROUP BY 1, 2, 3")(
    lambda t: neat(ev.accuracy(prepared(t).withColumn("part", F.when(F.col("as_of") < F.lit("1996-01-01").cast("date"), "design").otherwise("holdout")), [*KEY, "part"]).drop("spearman"), *ACC_COLUMNS[:-1])
)
query("wf_deciles", "wr", "SELECT system, horizon, CAST(greatest(1, ceil((r - 1) * 10.0 / (n - 1))) AS INTEGER) AS decile, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(realized_excess), 6) AS mean_excess, round(median(realized_excess), 6) AS median_excess, round(avg(CASE WHEN realized_excess > 0 THEN 1.0 ELSE 0.0 END), 6) AS p_positive FROM (SELECT *, row_number() OVER (PARTITION BY system, horizon ORDER BY score, as_of, instrument_id) AS r, count(*) OVER (PARTITION BY system, horizon) AS n FROM wr) WHERE n >= 20 GROUP BY 1, 2, 3")(
    lambda t: neat(ev.deciles(prepared(t), KEY), "mean_score", "mean_excess", "median_excess", "p_positive")
)
BINS = "SELECT system, horizon, CAST(least(floor(p_up / 0.2), 4) AS INTEGER) AS bin, count(*) AS n, avg(p_up) AS predicted, avg(CASE WHEN realized_excess > 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS realized FROM wr GROUP BY 1, 2, 3"
query("wf_calibration_bins", "wr", f"SELECT system, horizon, bin, n, round(predicted, 6) AS predicted, round(realized, 6) AS realized, round(sum(n * abs(predicted - realized)) OVER (PARTITION BY system, horizon) / sum(n) OVER (PARTITION BY system, horizon), 6) AS ece FROM ({BINS})")(
    lambda t: neat(ev.calibration_bins(prepared(t), KEY).withColumn("ece", F.sum(F.col("n") * F.abs(F.col("predicted") - F.col("realized"))).over(Window.partitionBy(*KEY)) / F.sum("n").over(Window.partitionBy(*KEY))), "predicted", "realized", "ece")
)
LABEL = "CASE " + " ".join(f"WHEN score >= {low} THEN '{name}'" for low, name in reversed(ev.BANDS[1:])) + f" ELSE '{ev.BANDS[0][1]}' END"
_worst = "OVER (PARTITION BY instrument_id ORDER BY d ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
CTE["adverse"] = (("px",), " UNION ALL ".join(f"SELECT instrument_id, d, {h} AS horizon, CASE WHEN count(adj) {_worst.format(h=h)} = {h} THEN min(adj) {_worst.format(h=h)} / adj - 1 END AS adverse FROM px" for h in (21, 63)))
query(
    "wf_band_outcomes", "wr adverse",
    f"SELECT system, horizon, label, count(*) AS n, round(avg(realized_excess), 6) AS mean_excess, round(median(adverse), 6) AS median_adverse, round(avg({Y}), 6) AS p_positive FROM (SELECT wr.*, {LABEL} AS label, a.adverse FROM wr LEFT JOIN adverse a ON a.instrument_id = wr.instrument_id AND a.d = wr.as_of AND a.horizon = wr.horizon) GROUP BY 1, 2, 3",
)(lambda t: neat(ev.band_outcomes(prepared(t).join(rs.adverse_moves(t.px, (21, 63)).withColumnRenamed("d", "as_of"), ["instrument_id", "as_of", "horizon"], "left"), KEY), "mean_excess", "median_adverse", "p_positive"))
query(
    "wf_turnover", "wr",
    f"SELECT system, horizon, round(avg(abs(delta)), 6) AS mean_move, round(quantile_cont(abs(delta), 0.95), 6) AS p95_move, round(avg(changed), 6) AS band_change_rate, round(avg(CASE WHEN back IS NOT NULL THEN CASE WHEN abs(delta) >= 10 AND abs(back) >= 10 AND sign(delta) <> sign(back) THEN 1.0 ELSE 0.0 END END), 6) AS reversal_rate"
    f" FROM (SELECT *, lag(delta) OVER w AS back, CASE WHEN label <> lag(label) OVER w THEN 1.0::DOUBLE ELSE 0.0 END AS changed FROM (SELECT *, {LABEL} AS label, score - lag(score) OVER (PARTITION BY system, horizon, instrument_id ORDER BY as_of) AS delta FROM wr) WINDOW w AS (PARTITION BY system, horizon, instrument_id ORDER BY as_of)) WHERE delta IS NOT NULL GROUP BY 1, 2",
)(lambda t: neat(ev.turnover(prepared(t), KEY), "mean_move", "p95_move", "band_change_rate", "reversal_rate"))
query("wf_false_missed", "wr", "SELECT system, horizon, count(*) FILTER (score >= 65 AND realized_excess > 0) AS false_trim, count(*) FILTER (score < 60 AND realized_excess <= q) AS missed, round(avg(realized_excess) FILTER (score < 40), 6) AS keep_excess FROM wr JOIN (SELECT system, horizon, quantile_cont(realized_excess, 0.25) AS q FROM wr GROUP BY 1, 2) USING (system, horizon) GROUP BY 1, 2")(
    lambda t: (lambda w: w.join(F.broadcast(w.groupBy(*KEY).agg(F.percentile("realized_excess", 0.25).alias("q"))), KEY).groupBy(*KEY).agg(F.count_if((F.col("score") >= 65) & (F.col("realized_excess") > 0)).alias("false_trim"), F.count_if((F.col("score") < 60) & (F.col("realized_excess") <= F.col("q"))).alias("missed"), F.round(F.avg(F.when(F.col("score") < 40, F.col("realized_excess"))), 6).alias("keep_excess")))(prepared(t))
)
query("wf_confidence_split", "wr", "SELECT system, horizon, round(avg(hit) FILTER (confidence >= m), 6) AS above, round(avg(hit) FILTER (confidence < m), 6) AS below FROM wr JOIN (SELECT system, horizon, median(confidence) AS m FROM wr GROUP BY 1, 2) USING (system, horizon) GROUP BY 1, 2")(
    lambda t: (lambda w: w.join(F.broadcast(w.groupBy(*KEY).agg(F.median("confidence").alias("m"))), KEY).groupBy(*KEY).agg(*[F.round(F.avg(F.when(c, F.col("hit").cast("double"))), 6).alias(n) for c, n in ((F.col("confidence") >= F.col("m"), "above"), (F.col("confidence") < F.col("m"), "below"))]))(prepared(t))
)
query("wf_participation", "pr", "SELECT horizon, count(*) AS cells, count(*) FILTER (confidence < 0.1) AS neutral, round(count(*) FILTER (confidence >= 0.1) * 1.0 / count(*), 6)::DOUBLE AS participation FROM pr GROUP BY 1")(
    lambda t: predictions(t).groupBy("horizon").agg(F.count("*").alias("cells"), F.count_if(F.col("confidence") < 0.1).alias("neutral"), F.round(F.count_if(F.col("confidence") >= 0.1) / F.count("*"), 6).alias("participation"))
)
query("wf_naive_momentum", "wr pf", "SELECT system, horizon, round(avg(CASE WHEN sign(ret_63d) = sign(realized_excess) THEN 1.0 ELSE 0.0 END), 6) AS naive, round(avg(hit), 6) AS model FROM wr JOIN pf ON pf.instrument_id = wr.instrument_id AND pf.d = wr.as_of WHERE ret_63d IS NOT NULL GROUP BY 1, 2")(
    lambda t: prepared(t).join(ft.price_features(t.px).select("instrument_id", F.col("d").alias("as_of"), "ret_63d"), ["instrument_id", "as_of"]).where("ret_63d is not null").groupBy(*KEY).agg(F.round(F.avg((F.signum("ret_63d") == F.signum("realized_excess")).cast("double")), 6).alias("naive"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("model"))
)
query("wf_compare_runs", "wr", "SELECT horizon, round(avg(hit) FILTER (system = 'combined') - avg(hit) FILTER (system = 'baseline'), 6) AS accuracy_gain, round(avg(realized_excess) FILTER (system = 'combined' AND score < 50) - avg(realized_excess) FILTER (system = 'baseline' AND score < 50), 6) AS excess_gain FROM wr GROUP BY 1")(
    lambda t: (lambda w, of: w.groupBy("horizon").agg(F.round(F.avg(F.when(of("combined"), F.col("hit").cast("double"))) - F.avg(F.when(of("baseline"), F.col("hit").cast("double"))), 6).alias("accuracy_gain"), F.round(F.avg(F.when(of("combined") & (F.col("score") < 50), F.col("realized_excess"))) - F.avg(F.when(of("baseline") & (F.col("score") < 50), F.col("realized_excess"))), 6).alias("excess_gain")))(prepared(t), lambda s: F.col("system") == s)
)
CRITERIA = "(VALUES ('accuracy', '>=', 0.5, 21), ('accuracy', '>=', 0.9, 63), ('brier', '<=', 0.3, 21), ('missing', '>=', 0.0, 21)) c(metric, comparator, threshold, horizon)"
query("wf_promotion", "wr", f"SELECT c.metric, c.horizon, CASE WHEN v IS NULL THEN 'not measurable' WHEN (c.comparator = '>=' AND v >= threshold) OR (c.comparator = '<=' AND v <= threshold) THEN 'pass' ELSE 'fail' END AS verdict FROM {CRITERIA} LEFT JOIN (SELECT horizon, 'accuracy' AS metric, avg(hit) AS v FROM wr WHERE system = 'combined' GROUP BY 1 UNION ALL SELECT horizon, 'brier', avg((p_up - {Y}) * (p_up - {Y})) FROM wr WHERE system = 'combined' GROUP BY 1) m USING (metric, horizon)")(
    lambda t: t.spark.createDataFrame([("accuracy", ">=", 0.5, 21), ("accuracy", ">=", 0.9, 63), ("brier", "<=", 0.3, 21), ("missing", ">=", 0.0, 21)], "metric string, comparator string, threshold double, horizon int")
    .join(ev.accuracy(prepared(t).where("system = 'combined'"), ["horizon"]).unpivot(["horizon"], ["accuracy", "brier"], "metric", "v"), ["metric", "horizon"], "left")
    .select("metric", "horizon", F.when(F.col("v").isNull(), "not measurable").when(((F.col("comparator") == ">=") & (F.col("v") >= F.col("threshold"))) | ((F.col("comparator") == "<=") & (F.col("v") <= F.col("threshold"))), "pass").otherwise("fail").alias("verdict"))
)
DRAWS = 1000


def mixed_sql(seed: str, *parts: str) -> str:
    """The SQL of the mixing that the bootstrap does, in steps of one subquery column each."""
    out = seed
    for p in parts:
        step = f"((({out}) * 48271 + ({p})::BIGINT * 69621 + 1) % {ev.MODULUS})"
        out = f"(list_transform([{step}], lambda v: (v * v + 12345) % {ev.MODULUS})[1])"
    return out


CTE["bs0"] = (
    ("wr",),
    "SELECT horizon, instrument_id, row_number() OVER (PARTITION BY horizon, instrument_id ORDER BY as_of) - 1 AS i, count(*) OVER (PARTITION BY horizon, instrument_id) AS n, x FROM (SELECT instrument_id, as_of, horizon, max(hit) FILTER (system = 'combined') - max(hit) FILTER (system = 'baseline') AS x FROM wr GROUP BY 1, 2, 3) WHERE x IS NOT NULL",
)
CTE["bs1"] = (("bs0",), f"SELECT horizon, instrument_id, n, i AS place, draw, {mixed_sql('7::BIGINT', 'draw', 'instrument_id', 'i')} % n AS s FROM bs0 CROSS JOIN range({DRAWS}) r(draw) WHERE i % 4 = 0")
CTE["bs2"] = (("bs0", "bs1"), "SELECT k.horizon, k.draw, avg(x) AS m FROM (SELECT *, (s + j) % n AS i FROM bs1 CROSS JOIN range(4) q(j) WHERE place + j < n) k JOIN bs0 b ON b.horizon = k.horizon AND b.instrument_id = k.instrument_id AND b.i = k.i GROUP BY 1, 2")
query(
    "wf_block_bootstrap", "bs0 bs2",
    "SELECT horizon, round(any_value(point), 6) AS point, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(avg(CASE WHEN m > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_positive FROM bs2 JOIN (SELECT horizon, avg(x) AS point FROM bs0 GROUP BY 1) USING (horizon) GROUP BY 1",
)(
    lambda t: neat(ev.block_bootstrap(ev.paired(prepared(t), "hit", "combined", "baseline"), ["horizon"], "hit", 1000), "point", "low", "high", "share_positive")
)
