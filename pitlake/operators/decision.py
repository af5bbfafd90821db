"""Evidence of several models combined, scored, labelled, attributed and reported per instrument and date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlake.functions.stats import norm_cdf
from pitlake.operators.evaluate import BANDS, band
from pitlake.operators.research import combine_evidence

#: Prior correlation of models that share inputs, and of all others.
OVERLAPPING, OTHERS = 0.5, 0.2
GROUP = ["instrument_id", "as_of"]


def prior_correlations(pairs: DataFrame, models: DataFrame) -> DataFrame:
    """(s1, s2, rho) for all models: declared pairs overlap, others share little, a model is itself."""
    a, b = models.select(F.col("model").alias("s1")), models.select(F.col("model").alias("s2"))
    declared = pairs.select("s1", "s2", F.lit(True).alias("_p")).union(pairs.select("s2", "s1", F.lit(True)))
    rho = F.when(F.col("s1") == F.col("s2"), 1.0).when(F.col("_p"), OVERLAPPING).otherwise(OTHERS)
    return a.crossJoin(b).join(F.broadcast(declared), ["s1", "s2"], "left").select("s1", "s2", rho.alias("rho"))


def participation(evidence: DataFrame) -> DataFrame:
    """Each model's part: omitted without a value, neutral with hardly any, else participating."""
    return evidence.withColumn("part", F.when(F.col("x").isNull(), "omitted").when(F.abs("x") < 0.05, "neutral").otherwise("participating"))


def combine(evidence: DataFrame, correlations: DataFrame) -> DataFrame:
    """Combined effect, error, z, score and confidence of the participating models."""
    active = participation(evidence).where("part = 'participating'").withColumn("study", F.col("model"))
    combined = combine_evidence(active, correlations, GROUP)
    n = active.groupBy(*GROUP).agg(F.count("*").alias("n"))
    confidence = F.least(F.lit(1.0), F.col("n") / (F.col("n") + 2.0) * F.col("agreement"))
    return combined.join(n, GROUP).withColumn("score", 100 * norm_cdf("z")).withColumn("confidence", confidence)


def trim(assessed: DataFrame) -> DataFrame:
    """Evidence, weight and risk terms of the trim score, clipped: needs score, confidence, weight and risk_share."""
    e = 50 + F.col("confidence") * (50 - F.col("score"))
    adjust = 10 * F.greatest(F.lit(0.0), F.col("weight") / 0.15 - 1) + 25 * (F.col("risk_share") - F.col("weight"))
    adjust = F.greatest(F.lit(-10.0), F.least(F.lit(10.0), adjust))
    return assessed.withColumn("evidence", e).withColumn("adjustment", adjust).withColumn("trim", F.greatest(F.lit(0.0), F.least(F.lit(100.0), e + adjust)))


def label(scored: DataFrame, floor: float = 0.3) -> DataFrame:
    """Band of the score; extreme bands need confidence and step toward neutral without it."""
    order = [name for _, name in BANDS]
    at = F.coalesce(*[F.when(band("trim") == name, i) for i, name in enumerate(order)])
    stepped = F.when(F.col("confidence") >= floor, at).when(at > 2, at - 1).when(at < 2, at + 1).otherwise(at)
    return scored.withColumn("label", F.element_at(F.array(*map(F.lit, order)), stepped + 1))


def attribution(evidence: DataFrame, combined: DataFrame) -> DataFrame:
    """Each model's share of the score's distance from 50, ranked, with the running total from 50."""
    active = participation(evidence).where("part = 'participating'").withColumn("w", 1 / F.col("se") ** 2)
    share = F.col("w") * F.col("own") / F.sum(F.col("w") * F.col("own")).over(Window.partitionBy(*GROUP))
    rows = active.withColumnRenamed("effect", "own").withColumn("share", share).select(*GROUP, "model", "share").join(combined.select(*GROUP, "score", "confidence"), GROUP)
    rows = rows.withColumn("contribution", F.col("confidence") * (50 - F.col("score")) * F.col("share"))
    order = Window.partitionBy(*GROUP).orderBy(F.desc(F.abs("contribution")), "model")
    return rows.withColumn("rank", F.row_number().over(order)).withColumn("running", 50 + F.sum("contribution").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def diff_previous(rows: DataFrame, moved: float = 0.15, adjusted: float = 1.0) -> DataFrame:
    """Each assessment against the instrument's previous one: eight changes, null or false where there is nothing to tell.

    ``rows`` has ``trim, label, confidence, effect, adjustment, driver`` and the participating ``models`` as a sorted array.
    """
    w = Window.partitionBy("instrument_id").orderBy("as_of")
    before = {c: F.lag(c).over(w) for c in ("as_of", "trim", "label", "confidence", "effect", "adjustment", "driver", "models")}
    told = rows.withColumns({f"p_{c}": x for c, x in before.items()})
    there, was = F.col("p_as_of").isNotNull(), lambda c: F.col(f"p_{c}")
    arrow = lambda c: F.when(there & ~F.col(c).eqNullSafe(was(c)), F.concat(F.coalesce(was(c), F.lit("-")), F.lit(" -> "), F.coalesce(c, F.lit("-"))))
    names = lambda a, b: F.when(there, F.nullif(F.array_join(F.array_except(a, b), ", "), F.lit("")))
    return told.select(
        *GROUP, F.col("p_as_of").alias("previous_as_of"), (F.col("trim") - was("trim")).alias("delta"), arrow("label").alias("label_change"), arrow("driver").alias("driver_change"),
        names(F.col("models"), was("models")).alias("appeared"), names(was("models"), F.col("models")).alias("went_quiet"),
        F.coalesce(F.abs(F.col("confidence") - was("confidence")) >= moved, F.lit(False)).alias("confidence_moved"), F.coalesce((F.col("effect") > 0) != (was("effect") > 0), F.lit(False)).alias("direction_flipped"),
        F.coalesce(F.abs(F.col("adjustment") - was("adjustment")) > adjusted, F.lit(False)).alias("adjustment_moved"),
    )


def data_quality(n: Column, confidence: Column) -> Column:
    return F.when(n == 0, "no_evidence").when(n < 2, "sparse").when(confidence < 0.2, "conflicted").when(confidence >= 0.5, "strong").otherwise("moderate")


def segments(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Runs of equal consecutive values."""
    w = Window.partitionBy(*keys).orderBy(order)
    run = rows.withColumn("_new", (~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int")).withColumn("_run", F.sum("_new").over(w))
    return run.groupBy(*keys, "_run", value).agg(F.min(order).alias("from_at"), F.max(order).alias("to_at"), F.count("*").alias("n")).drop("_run")


def band_distance(rows: DataFrame, score: str = "trim") -> DataFrame:
    """Points down to the band below and up to the next."""
    lows = F.array(*[F.lit(low) for low, _ in BANDS])
    below, above = F.array_max(F.filter(lows, lambda x: x <= F.col(score))), F.array_min(F.filter(lows, lambda x: x > F.col(score)))
    return rows.withColumn("to_lower", F.col(score) - below).withColumn("to_upper", above - F.col(score))
