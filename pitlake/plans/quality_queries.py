"""Queries of the data-quality rules, over the panel with defects that follow from the date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlake.operators import pit
from pitlake.operators import quality as q
from pitlake.plans.registry import CTE, Tables, query

DOY = "dayofyear(d)"
CTE["raw"] = (
    ("px",),
    f"SELECT instrument_id, d, open, CASE WHEN {DOY} % 83 = 11 THEN low * 0.5 ELSE high END AS high, low, CASE WHEN {DOY} % 97 = 5 THEN -close WHEN {DOY} % 89 = 7 THEN NULL ELSE close END AS close, adj,"
    f" CASE WHEN {DOY} % 71 = 3 THEN -volume WHEN {DOY} % 67 = 4 THEN 0 ELSE volume END AS volume, 1 AS seq FROM px UNION ALL SELECT instrument_id, d, open, high, low, close * 1.02, adj, volume, 2 FROM px WHERE {DOY} % 61 = 9",
)


def raw(t: Tables) -> DataFrame:
    doy = F.dayofyear("d")
    first = t.px.select(
        "instrument_id", "d", "open", F.when(doy % 83 == 11, F.col("low") * 0.5).otherwise(F.col("high")).alias("high"), "low",
        F.when(doy % 97 == 5, -F.col("close")).when(doy % 89 == 7, None).otherwise(F.col("close")).alias("close"), "adj",
        F.when(doy % 71 == 3, -F.col("volume")).when(doy % 67 == 4, 0).otherwise(F.col("volume")).alias("volume"), F.lit(1).alias("seq"),
    )
    again = t.px.where(doy % 61 == 9).select("instrument_id", "d", "open", "high", "low", (F.col("close") * 1.02).alias("close"), "adj", "volume", F.lit(2).alias("seq"))
    return first.union(again)


CTE["flagged"] = (
    ("raw",),
    "SELECT *, row_number() OVER (PARTITION BY instrument_id, d ORDER BY seq) > 1 AS duplicate_date, NOT coalesce(close > 0, false) AS nonpositive_close,"
    " coalesce(close > 0 AND (high < low OR open < low OR open > high OR close < low OR close > high), false) AS ohlc_incoherent, coalesce(volume < 0, false) AS negative_volume, coalesce(volume = 0, false) AS zero_volume FROM raw",
)
for _key, _rule in (("dq_duplicate_date", "duplicate_date"), ("dq_nonpositive_close", "nonpositive_close"), ("dq_ohlc_incoherent", "ohlc_incoherent")):
    query(_key, "flagged", f"SELECT instrument_id, d, seq FROM flagged WHERE {_rule}")(lambda t, r=_rule: q.price_rules(raw(t)).where(r).select("instrument_id", "d", "seq"))
query("dq_volume", "flagged", "SELECT instrument_id, d, seq, CASE WHEN negative_volume THEN 'error' ELSE 'warning' END AS severity FROM flagged WHERE negative_volume OR zero_volume")(
    lambda t: q.price_rules(raw(t)).where("negative_volume or zero_volume").select("instrument_id", "d", "seq", F.when(F.col("negative_volume"), "error").otherwise("warning").alias("severity"))
)
ROW_ERRORS = ("duplicate_date", "nonpositive_close", "ohlc_incoherent", "negative_volume")
RULE = "CASE " + " ".join(f"WHEN {e} THEN '{e}'" for e in ROW_ERRORS) + " END"
CTE["sorted_out"] = (("flagged",), f"SELECT *, {RULE} AS rule FROM flagged")


def sorted_out(t: Tables) -> DataFrame:
    return q.quarantine(q.price_rules(raw(t)), ROW_ERRORS)


query("dq_quarantine_split", "sorted_out", "SELECT instrument_id, coalesce(rule, 'valid') AS rule, count(*) AS n FROM sorted_out GROUP BY 1, 2")(lambda t: sorted_out(t).groupBy("instrument_id", F.coalesce("rule", F.lit("valid")).alias("rule")).agg(F.count("*").alias("n")))
query("dq_accepted_suppression", "sorted_out", "SELECT instrument_id, d, seq, rule FROM sorted_out WHERE rule IS NOT NULL AND NOT (rule = 'ohlc_incoherent' AND instrument_id % 2 = 0 AND year(d) = 1995)")(
    lambda t: (lambda s: s.join(s.where("rule = 'ohlc_incoherent' and instrument_id % 2 = 0 and year(d) = 1995").select("rule", "instrument_id", "d").distinct(), ["rule", "instrument_id", "d"], "left_anti").select("instrument_id", "d", "seq", "rule"))(sorted_out(t).where("rule is not null"))
)
SPLITS = "SELECT instrument_id, d FROM px WHERE dayofyear(d) % 41 = 0"


def splits(t: Tables) -> DataFrame:
    return t.px.where(F.dayofyear("d") % 41 == 0).select("instrument_id", "d")


CTE["splits"] = (("px",), SPLITS)
CTE["clean"] = (("sorted_out", "splits"), "SELECT s.instrument_id, s.d, s.close, p.d IS NOT NULL AS split, row_number() OVER (PARTITION BY s.instrument_id ORDER BY s.d) AS n FROM sorted_out s LEFT JOIN splits p USING (instrument_id, d) WHERE rule IS NULL")
query(
    "dq_return_jump", "clean",
    "WITH RECURSIVE f AS (SELECT instrument_id, 0::BIGINT AS n, NULL::DATE AS d, NULL::DOUBLE AS close, NULL::DOUBLE AS last, NULL::DOUBLE AS previous FROM (SELECT DISTINCT instrument_id FROM clean) UNION ALL"
    " SELECT c.instrument_id, c.n, c.d, c.close, CASE WHEN f.last IS NOT NULL AND NOT c.split AND abs(c.close / f.last - 1) > 0.4 THEN f.last ELSE c.close END, CASE WHEN f.last IS NOT NULL AND NOT c.split AND abs(c.close / f.last - 1) > 0.4 THEN f.last END FROM f JOIN clean c ON c.instrument_id = f.instrument_id AND c.n = f.n + 1)"
    " SELECT instrument_id, d, round(close, 9) AS close, round(previous, 9) AS previous FROM f WHERE previous IS NOT NULL",
)(lambda t: q.return_jumps(sorted_out(t).where("rule is null"), splits(t)).select("instrument_id", "d", F.round("close", 9).alias("close"), F.round("previous", 9).alias("previous")))
CTE["coarse"] = (("px",), "SELECT instrument_id, d, floor(close / 400) AS close FROM px")
query(
    "dq_stale_closes", "coarse",
    "SELECT instrument_id, from_d, to_d, length FROM (SELECT instrument_id, run, min(d) AS from_d, max(d) AS to_d, count(*) AS length FROM (SELECT *, sum(nw) OVER (PARTITION BY instrument_id ORDER BY d) AS run FROM (SELECT *, CASE WHEN close IS NOT DISTINCT FROM lag(close) OVER (PARTITION BY instrument_id ORDER BY d) THEN 0 ELSE 1 END AS nw FROM coarse)) GROUP BY 1, 2) WHERE length >= 5",
)(lambda t: q.stale_runs(t.px.select("instrument_id", "d", F.floor(F.col("close") / 400).alias("close"))))
query("dq_calendar_gap", "px cal", "SELECT f.instrument_id, cal.d FROM (SELECT instrument_id, min(d) AS first FROM px GROUP BY 1) f JOIN cal ON cal.d >= f.first AND cal.d < (SELECT max(d) FROM cal) ANTI JOIN px ON px.instrument_id = f.instrument_id AND px.d = cal.d")(
    lambda t: q.calendar_gaps(t.px, t.cal)
)
query("dq_macro_range", "mo", "SELECT code, obs_date, round(value, 9) AS value FROM mo WHERE value < 5 OR value > 30")(
    lambda t: t.mo.join(F.broadcast(t.ms.withColumn("min_value", F.lit(5.0)).withColumn("max_value", F.lit(30.0))), ["code", "frequency"]).where("value < min_value or value > max_value").select("code", "obs_date", F.round("value", 9).alias("value"))
)
query("dq_macro_frequency", "mo", "SELECT code, CAST(date_trunc('month', obs_date) AS DATE) AS period, count(*) - 1 AS extra FROM mo GROUP BY 1, 2 HAVING count(*) > 1")(
    lambda t: t.mo.groupBy("code", F.trunc("obs_date", "month").alias("period")).agg((F.count("*") - 1).alias("extra")).where("extra > 0")
)
CTE["mo_holes"] = (("mo",), "SELECT * FROM mo WHERE NOT (month(obs_date) IN (3, 4) AND year(obs_date) % 2 = 1)")


def mo_holes(t: Tables) -> DataFrame:
    return t.mo.where(~(F.month("obs_date").isin(3, 4) & (F.year("obs_date") % 2 == 1)))


query("dq_macro_missing_periods", "mo_holes", "SELECT code, count(*) AS n_gaps, array_to_string(list_slice(list(CAST(obs_date AS VARCHAR) ORDER BY obs_date), 1, 10), ',') AS first_gaps FROM (SELECT *, lag(obs_date) OVER (PARTITION BY code ORDER BY obs_date) AS p FROM mo_holes) WHERE obs_date - p > CASE frequency WHEN 'D' THEN 10 ELSE 45 END GROUP BY code")(
    lambda t: q.macro_gaps(mo_holes(t))
)
TODAY = "DATE '1998-10-01'"
query("dq_macro_stale", "mo ms", f"SELECT code, max(obs_date) AS last_obs FROM mo JOIN ms USING (code, frequency) GROUP BY code, frequency, lag_days HAVING DATE '1999-03-01' - max(obs_date) > lag_days + 3 * CASE frequency WHEN 'D' THEN 1 ELSE 31 END")(
    lambda t: t.mo.groupBy("code", "frequency").agg(F.max("obs_date").alias("last_obs")).join(F.broadcast(t.ms), ["code", "frequency"]).where(F.datediff(F.lit("1999-03-01").cast("date"), "last_obs") > F.col("lag_days") + 3 * q.by_frequency(q.PERIOD_DAYS)).select("code", "last_obs")
)
CTE["fu_bad"] = (("fu",), "SELECT instrument_id, as_of, CASE WHEN month(as_of) = 5 THEN -market_cap ELSE market_cap END AS market_cap, CASE WHEN month(as_of) = 7 THEN -shares ELSE shares END AS shares, revenue FROM fu")


def fu_bad(t: Tables) -> DataFrame:
    return t.fu.select("instrument_id", "as_of", F.when(F.month("as_of") == 5, -F.col("market_cap")).otherwise(F.col("market_cap")).alias("market_cap"), F.when(F.month("as_of") == 7, -F.col("shares")).otherwise(F.col("shares")).alias("shares"), "revenue")


query("dq_fund_negative", "fu_bad", "SELECT instrument_id, as_of, field, observed FROM (SELECT instrument_id, as_of, market_cap, shares, revenue FROM fu_bad) UNPIVOT (observed FOR field IN (market_cap, shares, revenue)) WHERE observed < 0")(
    lambda t: fu_bad(t).unpivot(["instrument_id", "as_of"], ["market_cap", "shares", "revenue"], "field", "observed").where("observed < 0")
)
query("dq_fund_marketcap", "fu px", "SELECT f.instrument_id, f.as_of, round(abs(market_cap - close * shares * 100) / market_cap, 6) AS gap FROM fu f ASOF LEFT JOIN px ON f.instrument_id = px.instrument_id AND f.as_of >= px.d WHERE abs(market_cap - close * shares * 100) / market_cap > 0.15")(
    lambda t: pit.asof(t.fu, t.px.select("instrument_id", "d", "close"), ["instrument_id"], "as_of", "d", ["close"]).withColumn("gap", F.abs(F.col("market_cap") - F.col("close") * F.col("shares") * 100) / F.col("market_cap")).where("gap > 0.15").select("instrument_id", "as_of", F.round("gap", 6).alias("gap"))
)
query("dq_fund_shares_jump", "fu splits", "SELECT instrument_id, as_of, round(jump, 6) AS jump FROM (SELECT *, shares / lag(shares) OVER (PARTITION BY instrument_id ORDER BY as_of) - 1 AS jump FROM fu) f WHERE abs(jump) > 0.5 AND NOT EXISTS (SELECT 1 FROM splits s WHERE s.instrument_id = f.instrument_id AND s.d BETWEEN f.as_of - 10 AND f.as_of)")(
    lambda t: t.fu.withColumn("jump", F.col("shares") / F.lag("shares").over(Window.partitionBy("instrument_id").orderBy("as_of")) - 1).where("abs(jump) > 0.5")
    .join(splits(t).withColumnRenamed("instrument_id", "_i"), (F.col("instrument_id") == F.col("_i")) & F.col("d").between(F.date_sub("as_of", 10), F.col("as_of")), "left_anti").select("instrument_id", "as_of", F.round("jump", 6).alias("jump"))
)
query("dq_earnings_date", "ea", f"SELECT instrument_id, earnings_date, observed_on FROM ea WHERE earnings_date < DATE '1993-01-01' OR earnings_date > {TODAY} - 1000 + 730")(
    lambda t: t.ea.where((F.col("earnings_date") < F.lit("1993-01-01").cast("date")) | (F.col("earnings_date") > F.date_add(F.lit("1998-10-01").cast("date"), -270))).select("instrument_id", "earnings_date", "observed_on")
)
CTE["px2"] = (
    ("px",),
    "SELECT instrument_id, d, open, high, low, CASE WHEN instrument_id % 6 = 1 THEN close * 1.1 WHEN instrument_id % 6 = 2 AND day(d) = 3 THEN NULL ELSE close END AS close, CASE WHEN instrument_id % 6 = 3 THEN adj * 1.01 WHEN instrument_id % 6 = 4 THEN adj * 1.000001 ELSE adj END AS adj, CASE WHEN day(d) = 9 THEN volume + 1 ELSE volume END AS volume FROM px WHERE d >= DATE '1998-06-01'",
)


def refetched(t: Tables) -> DataFrame:
    i, day = F.col("instrument_id") % 6, F.dayofmonth("d")
    return t.px.where("d >= date'1998-06-01'").select(
        "instrument_id", "d", "open", "high", "low", F.when(i == 1, F.col("close") * 1.1).when((i == 2) & (day == 3), None).otherwise(F.col("close")).alias("close"),
        F.when(i == 3, F.col("adj") * 1.01).when(i == 4, F.col("adj") * 1.000001).otherwise(F.col("adj")).alias("adj"), F.when(day == 9, F.col("volume") + 1).otherwise(F.col("volume")).alias("volume"),
    )


FIELDS = ("open", "high", "low", "close", "adj", "volume")
_arm = "SELECT a.instrument_id, a.d, '{f}' AS field, CAST(a.{f} AS DOUBLE) AS old, CAST(b.{f} AS DOUBLE) AS new FROM px a JOIN px2 b USING (instrument_id, d) WHERE a.{f} IS DISTINCT FROM b.{f} AND {m}"
CTE["rev"] = (("px", "px2"), " UNION ALL ".join(_arm.format(f=f, m="true" if f == "volume" else f"coalesce(abs(b.{f} - a.{f}) > greatest(2e-6, abs(a.{f}) * 1e-5), true)") for f in FIELDS))


def price_revisions(t: Tables) -> DataFrame:
    return q.revisions(t.px, refetched(t), ["instrument_id", "d"], list(FIELDS), exact=("volume",))


query("dq_price_revisions", "rev", "SELECT instrument_id, d, field, round(old, 10) AS old, round(new, 10) AS new FROM rev")(lambda t: price_revisions(t).select("instrument_id", "d", "field", F.round("old", 10).alias("old"), F.round("new", 10).alias("new")))
CTE["new_splits"] = (("splits",), "SELECT * FROM splits WHERE d >= DATE '1998-11-20' AND instrument_id % 6 = 5")


def new_splits(t: Tables) -> DataFrame:
    return splits(t).where("d >= date'1998-11-20' and instrument_id % 6 = 5")


query(
    "dq_adj_tripwire", "rev px2 new_splits",
    "SELECT DISTINCT instrument_id FROM (SELECT r.instrument_id FROM (SELECT instrument_id, d, bool_or(field = 'adj') AS adj, bool_or(field = 'close') AS raw FROM rev GROUP BY 1, 2) r JOIN (SELECT instrument_id, max(d) AS newest FROM px2 GROUP BY 1) n USING (instrument_id) WHERE adj AND NOT raw AND d < newest UNION ALL SELECT instrument_id FROM new_splits)",
)(lambda t: q.refresh_needed(price_revisions(t), refetched(t), new_splits(t)))
query("dq_raw_shift_guard", "px px2 new_splits", "SELECT instrument_id, count(*) AS compared, count(*) FILTER (coalesce(abs(b.close - a.close) > greatest(2e-6, abs(a.close) * 1e-5), a.close IS DISTINCT FROM b.close)) AS shifted FROM px a JOIN px2 b USING (instrument_id, d) WHERE instrument_id NOT IN (SELECT instrument_id FROM new_splits) GROUP BY 1 HAVING compared >= 5 AND shifted > 0.5 * compared")(
    lambda t: q.raw_shift_guard(t.px, refetched(t), new_splits(t))
)
query("dq_macro_revisions", "mo", "SELECT code, obs_date, round(value, 9) AS old, round(CASE WHEN day(obs_date) = 5 THEN value + 0.5 END, 9) AS new FROM mo WHERE day(obs_date) IN (5, 6)")(
    lambda t: q.revisions(t.mo, t.mo.withColumn("value", F.when(F.dayofmonth("obs_date") == 5, F.col("value") + 0.5).when(F.dayofmonth("obs_date") != 6, F.col("value"))), ["code", "obs_date"], ["value"], exact=("value",)).select("code", "obs_date", F.round("old", 9).alias("old"), F.round("new", 9).alias("new"))
)
query("dq_fund_revisions", "fu", "SELECT instrument_id, as_of, field, old, new FROM (SELECT instrument_id, as_of, 'shares' AS field, shares AS old, shares + 1 AS new FROM fu WHERE month(as_of) = 2 UNION ALL SELECT instrument_id, as_of, 'revenue', revenue, NULL FROM fu WHERE month(as_of) = 3)")(
    lambda t: q.revisions(t.fu, t.fu.withColumn("shares", F.when(F.month("as_of") == 2, F.col("shares") + 1).otherwise(F.col("shares"))).withColumn("revenue", F.when(F.month("as_of") != 3, F.col("revenue"))), ["instrument_id", "as_of"], ["shares", "revenue"], exact=("shares", "revenue"))
)
query("dq_overlap_window", "px", "SELECT instrument_id, min(d) AS read_from FROM (SELECT instrument_id, d, row_number() OVER (PARTITION BY instrument_id ORDER BY d DESC) AS n FROM px WHERE d <= DATE '1998-06-01') WHERE n <= 10 GROUP BY 1")(
    lambda t: t.px.where("d <= date'1998-06-01'").withColumn("n", F.row_number().over(Window.partitionBy("instrument_id").orderBy(F.desc("d")))).where("n <= 10").groupBy("instrument_id").agg(F.min("d").alias("read_from"))
)
CTE["ea_in"] = (("ea",), "SELECT instrument_id, earnings_date, eps_estimate, CASE WHEN month(earnings_date) = 1 THEN eps_actual + 0.5 ELSE eps_actual END AS eps_actual, observed_on + 5 AS observed_on FROM ea WHERE eps_actual IS NOT NULL")
query("dq_append_on_change", "ea ea_in", "SELECT i.instrument_id, i.earnings_date, round(i.eps_actual, 5) AS eps_actual, i.observed_on FROM ea_in i JOIN (SELECT instrument_id, earnings_date, arg_max_null(eps_actual, observed_on) AS a, arg_max_null(eps_estimate, observed_on) AS e FROM ea GROUP BY 1, 2) l USING (instrument_id, earnings_date) WHERE i.eps_actual IS DISTINCT FROM l.a OR i.eps_estimate IS DISTINCT FROM l.e")(
    lambda t: q.append_on_change(
        t.ea.where("eps_actual is not null").withColumn("eps_actual", F.when(F.month("earnings_date") == 1, F.col("eps_actual") + 0.5).otherwise(F.col("eps_actual"))).withColumn("observed_on", F.date_add("observed_on", 5)),
        t.ea, ["instrument_id", "earnings_date"], "observed_on", ["eps_estimate", "eps_actual"],
    ).select("instrument_id", "earnings_date", F.round("eps_actual", 5).alias("eps_actual"), "observed_on")
)
