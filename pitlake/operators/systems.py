"""Systems rebuilt from captured evidence: which models take part, how they combine, and what one model adds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlake.functions.stats import norm_cdf
from pitlake.operators.decision import OTHERS

CELL = ["instrument_id", "as_of"]


def memberships(models: list[str], experiment: str, rhos: tuple[float, ...], declared: float) -> list[tuple[str, str, float]]:
    """(system, model, rho): baseline and its shadow without the experiment, the experiment alone, all, and all at other correlations."""
    others = [m for m in models if m != experiment]
    sets = {"baseline": others, "shadow": others, "alone": [experiment], "combined": models}
    rows = [(name, m, declared) for name, of in sets.items() for m in of]
    return rows + [(f"rho_{round(r * 100):02d}", m, r) for r in rhos if r != declared for m in models]


def combine(captured: DataFrame, by: list[str], experiment: str, partners: tuple[str, ...]) -> DataFrame:
    """Evidence score, confidence and trim score per ``by`` of rows with ``model, effect, se, rho``.

    The experiment correlates by ``rho`` with its partners, all other pairs by the prior. The variance of the weighted
    mean needs sums only: with p = 1 / se it is OTHERS (sum p)^2 + (1 - OTHERS) sum p^2 plus what the partners add, so
    models are never joined with each other.
    """
    p, w = 1 / F.col("se"), 1 / (F.col("se") * F.col("se"))
    total = lambda x, cond=None: F.sum(x if cond is None else F.when(cond, x).otherwise(0.0))
    sums = captured.groupBy(*by).agg(
        F.count("*").alias("n"), total(w).alias("_w"), total(w * F.col("effect")).alias("_we"), total(p).alias("_p"), total(p * p).alias("_pp"), F.max("rho").alias("_rho"),
        total(p, F.col("model") == experiment).alias("_x"), total(p, F.col("model").isin(*partners)).alias("_y"),
        total(w, F.col("effect") > 0).alias("_up"), total(w, F.col("effect") < 0).alias("_down"),
    )
    variance = OTHERS * F.col("_p") * F.col("_p") + (1 - OTHERS) * F.col("_pp") + 2 * (F.col("_rho") - OTHERS) * F.col("_x") * F.col("_y")
    z = F.greatest(F.lit(-4.0), F.least(F.lit(4.0), F.col("_we") / F.sqrt(variance)))
    agreement = F.when(F.col("_we") > 0, F.col("_up")).when(F.col("_we") < 0, F.col("_down")).otherwise(F.col("_w") - F.col("_up") - F.col("_down")) / F.col("_w")
    out = sums.select(*by, "n", (F.col("_we") / F.col("_w")).alias("effect"), (100 * norm_cdf(z)).alias("score"), F.least(F.lit(1.0), F.col("n") / (F.col("n") + 2.0) * agreement).alias("confidence"))
    return out.withColumn("trim", 50 + F.col("confidence") * (50 - F.col("score")))


def hit(score: Column, realized: Column) -> Column:
    return ((score > 50) == (realized > 0)).cast("double")


def ablation(scored: DataFrame) -> DataFrame:
    """Per variant: accuracy of the experiment alone, of all and of the baseline on the variant's cells, and the gain; needs ``variant, system, score, realized``."""
    of = lambda s: F.avg(F.when(F.col("system") == s, hit(F.col("score"), F.col("realized"))))
    error = F.col("score") / 100 - (F.col("realized") > 0).cast("double")
    rows = scored.where("realized is not null").groupBy("variant").agg(
        F.count_if(F.col("system") == "alone").alias("n"), of("alone").alias("experiment"), F.avg(F.when(F.col("system") == "alone", error * error)).alias("brier"), of("combined").alias("combined"), of("baseline").alias("baseline")
    )
    return rows.withColumn("incremental", F.coalesce("combined", F.lit(0.0)) - F.coalesce("baseline", F.lit(0.0)))


def match_quality(matches: DataFrame) -> DataFrame:
    """Per target: mean similarity of its matches and the largest share that one year has of them."""
    years = matches.groupBy(*CELL, F.year("d").alias("year")).agg(F.count("*").alias("c"), F.sum("similarity").alias("s"))
    return years.groupBy(*CELL).agg((F.sum("s") / F.sum("c")).alias("similarity"), (F.max("c") / F.sum("c")).alias("concentration"))


def evaluate_on(conditions: DataFrame, days: DataFrame, own: DataFrame, sectors: DataFrame, market: DataFrame) -> DataFrame:
    """Value of each condition's feature on each of ``days(instrument_id, sector_id, d)``, read from the series it names: its own, its sector's or the market's."""
    series = own.join(F.broadcast(conditions.where("evaluate_on = 'self'")), "feature").select("condition", "instrument_id", "d", "value")
    for kind, table, on in (("sector", sectors, ["sector_id", "d"]), ("market", market, ["d"])):
        named = table.join(F.broadcast(conditions.where(F.col("evaluate_on") == kind)), "feature").select("condition", *on, "value")
        series = series.unionByName(days.join(named, on).select("condition", "instrument_id", "d", "value"))
    return series
