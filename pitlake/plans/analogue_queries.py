"""Two studies of conditions on own quantiles at one date, which the integrity queries look at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.operators import features as ft
from pitlake.operators import research as rs
from pitlake.plans.registry import CTE, Tables

COLUMNS = ["ret_21d", "price_to_ma50", "vol_21d", "ret_5d"]
AS_OF = "1997-06-30"
CTE["vec"] = (("pf",), f"SELECT instrument_id, d, {', '.join(COLUMNS)} FROM pf WHERE d <= DATE '{AS_OF}'")
# Conditions on own quantiles ----------------------------------------------------------------------------------

CONDITIONS = (("hot", "ret_21d", ">=", 0.8), ("hot", "price_to_ma50", ">=", 0.6), ("quiet", "vol_21d", "<=", 0.3))
CTE["cond"] = ((), "SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{f}', '{o}', {q}::DOUBLE)" for s, f, o, q in CONDITIONS) + ") t(study, feature, op, q)")
CTE["own"] = (("vec",), "SELECT instrument_id, feature, CASE WHEN count(value) >= 252 THEN quantile_cont(value, 0.8) END AS q80, CASE WHEN count(value) >= 252 THEN quantile_cont(value, 0.6) END AS q60, CASE WHEN count(value) >= 252 THEN quantile_cont(value, 0.3) END AS q30 FROM vec UNPIVOT (value FOR feature IN (ret_21d, price_to_ma50, vol_21d)) GROUP BY 1, 2")


def narrow(t: Tables) -> DataFrame:
    return ft.to_narrow(ft.price_features(t.px).where(F.col("d") <= F.lit(AS_OF).cast("date")).select("instrument_id", "d", "ret_21d", "price_to_ma50", "vol_21d"), ["instrument_id", "d"])


def own_quantiles(t: Tables) -> DataFrame:
    enough = lambda q: F.when(F.count("value") >= 252, F.percentile("value", q))
    return narrow(t).groupBy("instrument_id", "feature").agg(enough(0.8).alias("q80"), enough(0.6).alias("q60"), enough(0.3).alias("q30"))


CTE["thr"] = (("own", "cond"), "SELECT study, instrument_id, feature, op, CASE q WHEN 0.8 THEN q80 WHEN 0.6 THEN q60 ELSE q30 END AS lim FROM cond JOIN own USING (feature)")


def thresholds(t: Tables) -> DataFrame:
    cond = t.spark.createDataFrame(list(CONDITIONS), "study string, feature string, op string, q double")
    return own_quantiles(t).join(F.broadcast(cond), "feature").select("study", "instrument_id", "feature", "op", F.when(F.col("q") == 0.8, F.col("q80")).when(F.col("q") == 0.6, F.col("q60")).otherwise(F.col("q30")).alias("limit"))


CTE["celig"] = (
    ("vec", "thr", "cond"),
    "SELECT study, instrument_id, d, bool_and(CASE op WHEN '>=' THEN value >= lim ELSE value <= lim END) AS match FROM (SELECT instrument_id, d, feature, value FROM vec UNPIVOT (value FOR feature IN (ret_21d, price_to_ma50, vol_21d))) JOIN thr USING (instrument_id, feature) JOIN (SELECT study, count(*) AS n FROM cond GROUP BY 1) USING (study) WHERE lim IS NOT NULL GROUP BY study, instrument_id, d, n HAVING count(*) = n",
)


def conditioned(t: Tables) -> DataFrame:
    """Days on which all conditions of a study can be evaluated for an instrument, and whether they hold."""
    rows = narrow(t).join(F.broadcast(thresholds(t).where("limit is not null")), ["instrument_id", "feature"])
    n = F.broadcast(t.spark.createDataFrame([(s, sum(c[0] == s for c in CONDITIONS)) for s in {c[0] for c in CONDITIONS}], "study string, n int"))
    days = rows.groupBy("study", "instrument_id", "d").agg(F.count("*").alias("c"), F.bool_and(rs.holds(F.col("value"), F.col("op"), F.col("limit"))).alias("match"))
    return days.join(n, "study").where("c = n").select("study", "instrument_id", "d", "match")


CTE["cev"] = (("celig",), "SELECT study, instrument_id, d FROM (SELECT *, lag(match) OVER (PARTITION BY study, instrument_id ORDER BY d) AS b FROM celig) WHERE match AND NOT coalesce(b, false)")
