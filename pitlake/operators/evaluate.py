"""Evaluation of archived predictions and walk-forward validation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Score bands, from the lowest score of each, and the edges of confidence and score buckets.
BANDS = ((0.0, "strong keep"), (25.0, "keep"), (40.0, "neutral"), (60.0, "watch"), (75.0, "trim"), (90.0, "strong trim"))
CONFIDENCE_EDGES, SCORE_EDGES = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0), (0.0, 20.0, 40.0, 60.0, 80.0, 100.0)


def band(score: str) -> Column:
    out = F.lit(BANDS[0][1])
    for low, name in BANDS[1:]:
        out = F.when(F.col(score) >= low, name).otherwise(out)
    return out


def bucket(x: str, edges: tuple[float, ...]) -> Column:
    """Index of the bucket [edge, next edge), the last one closed."""
    width = (edges[-1] - edges[0]) / (len(edges) - 1)
    return F.least(F.floor((F.col(x) - edges[0]) / width), F.lit(len(edges) - 2)).cast("int")


def ranks(rows: DataFrame, keys: list[str], x: str, name: str) -> DataFrame:
    """Average ranks: ties share the mean of their places."""
    first = F.rank().over(Window.partitionBy(*keys).orderBy(x))
    ties = F.count("*").over(Window.partitionBy(*keys, x))
    return rows.withColumn(name, first + (ties - 1) / 2)


def spearman(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation per key; null when a side doesn't vary."""
    both = ranks(ranks(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()), keys, x, "_rx"), keys, y, "_ry")
    varies = (F.stddev_pop("_rx") > 0) & (F.stddev_pop("_ry") > 0)
    return both.groupBy(*keys).agg(F.when(varies, F.corr("_rx", "_ry")).alias("spearman"))


def outcomes(predictions: DataFrame, fwd: DataFrame, bench: DataFrame) -> DataFrame:
    """Predictions with actual and excess return, errors, and whether the direction was right (null without one)."""
    joined = predictions.join(fwd.withColumnRenamed("d", "as_of").withColumnRenamed("fwd", "actual"), ["instrument_id", "as_of", "horizon"]).join(bench.withColumnRenamed("d", "as_of").withColumnRenamed("fwd", "bench"), ["as_of", "horizon"], "left")
    done = joined.where("actual is not null").withColumn("excess", F.col("actual") - F.col("bench")).withColumn("error", F.col("actual") - F.col("expected"))
    return done.withColumn("abs_error", F.abs("error")).withColumn("direction_ok", F.when(F.col("expected") != 0, F.signum("expected") == F.signum("actual")))


def prepare(rows: DataFrame) -> DataFrame:
    """Realised excess over the prediction's own baseline, chance of a rise, and hits."""
    out = rows.withColumn("realized_excess", F.col("actual") - (F.col("expected") - F.col("expected_excess"))).withColumn("p_up", F.col("score") / 100)
    return out.withColumn("hit", ((F.col("score") > 50) == (F.col("realized_excess") > 0)).cast("int"))


def cohort(rows: DataFrame, stride_of: Column, keys: list[str]) -> DataFrame:
    """Non-overlapping cohort: every k-th date of each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("as_of")) - 1
    return rows.withColumn("_n", n).where(F.col("_n") % stride_of == 0).drop("_n")


def accuracy(rows: DataFrame, keys: list[str]) -> DataFrame:
    p, y = F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("p_up"))), (F.col("realized_excess") > 0).cast("double")
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.col("hit").cast("double")).alias("accuracy"), F.avg((F.col("p_up") - y) ** 2).alias("brier"), F.avg((F.lit(0.5) - y) ** 2).alias("brier_half"),
        F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"), F.avg("realized_excess").alias("mean_excess"),
    )
    return out.join(spearman(rows, keys, "score", "realized_excess"), keys)


def deciles(rows: DataFrame, keys: list[str], least: int = 20) -> DataFrame:
    """Ten buckets of the first-come rank of the score, cut as equal parts of the range of ranks."""
    w, by = Window.partitionBy(*keys).orderBy("score", "as_of", "instrument_id"), Window.partitionBy(*keys)
    cut = rows.withColumn("_r", F.row_number().over(w)).withColumn("_n", F.count("*").over(by)).where(F.col("_n") >= least)
    at = F.greatest(F.lit(1).cast("long"), F.ceil((F.col("_r") - 1) * 10 / (F.col("_n") - 1)))
    return cut.groupBy(*keys, at.cast("int").alias("decile")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg("realized_excess").alias("mean_excess"), F.median("realized_excess").alias("median_excess"), F.avg((F.col("realized_excess") > 0).cast("double")).alias("p_positive"))


def calibration_bins(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.withColumn("bin", bucket("p_up", (0.0, 0.2, 0.4, 0.6, 0.8, 1.0))).groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg("p_up").alias("predicted"), F.avg((F.col("realized_excess") > 0).cast("double")).alias("realized"))


def model_analytics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per model in the ``contributions(model, weight_share, effect)`` of evaluated predictions: mean weight, contribution and effect,
    agreement with the combined forecast, hits, and the error of its own effect against that of expecting nothing.

    An effect of 0 takes no side: it counts in the means of weight, contribution and effect only. Nulls likewise.
    """
    each = rows.select(*keys, "expected_excess", "realized_excess", F.inline("contributions"))
    effect, combined, actual = F.col("effect"), F.col("expected_excess"), F.col("realized_excess")
    scored = (effect != 0) & actual.isNotNull()
    same = lambda cond, y: F.avg(F.when(cond, (F.signum(effect) == F.signum(y)).cast("double")))
    out = each.groupBy(*keys, "model").agg(
        F.count("*").alias("n"), F.avg("weight_share").alias("weight_share"), F.avg(F.abs(F.col("weight_share") * effect)).alias("contribution"), F.avg(effect).alias("mean_effect"),
        same((effect != 0) & (combined != 0), combined).alias("agreement"), same(scored, actual).alias("hit_rate"),
        F.avg(F.when(scored, F.abs(actual - effect))).alias("mae"), F.avg(F.when(scored, F.abs(actual))).alias("naive_mae"),
    )
    return out.select(
        *keys, "model", "n", "weight_share", "contribution", "mean_effect", "agreement", (1 - F.col("agreement")).alias("contradiction"),
        "hit_rate", (F.col("hit_rate") - 0.5).alias("edge"), "mae", "naive_mae", (F.col("naive_mae") - F.col("mae")).alias("information_gain"),
    )


def band_outcomes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """What came after each label of the score: needs ``score, realized_excess, adverse``."""
    return rows.groupBy(*keys, band("score").alias("label")).agg(
        F.count("*").alias("n"), F.avg("realized_excess").alias("mean_excess"), F.median("adverse").alias("median_adverse"), F.avg((F.col("realized_excess") > 0).cast("double")).alias("p_positive")
    )


def turnover(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Change of the score from date to date: mean, high percentile, band changes, and reversals of at least 10 points."""
    w = Window.partitionBy(*keys, "instrument_id").orderBy("as_of")
    moved = rows.withColumn("delta", F.col("score") - F.lag("score").over(w)).withColumn("label", band("score"))
    moved = moved.withColumn("changed", (F.col("label") != F.lag("label").over(w)).cast("double")).withColumn("back", F.lag("delta").over(w))
    reversal = F.when(F.col("back").isNotNull(), ((F.abs("delta") >= 10) & (F.abs("back") >= 10) & (F.signum("delta") != F.signum("back"))).cast("double"))
    return moved.where("delta is not null").groupBy(*keys).agg(F.avg(F.abs("delta")).alias("mean_move"), F.percentile(F.abs("delta"), 0.95).alias("p95_move"), F.avg("changed").alias("band_change_rate"), F.avg(reversal).alias("reversal_rate"))


#: The prime that mixing is done by.
MODULUS = 2147483647


def paired(rows: DataFrame, x: str, system: str, against: str) -> DataFrame:
    """``instrument_id, as_of, horizon`` and ``x`` as ``system`` minus ``against``, where both are known."""
    on = ["instrument_id", "as_of", "horizon"]
    of = lambda s, n: F.max(F.when(F.col("system") == s, F.col(x).cast("double"))).alias(n)
    both = rows.where(F.col("system").isin(system, against)).groupBy(*on).agg(of(system, "_a"), of(against, "_b"))
    return both.where("_a is not null and _b is not null").select(*on, (F.col("_a") - F.col("_b")).alias(x))


def _mixed(seed: int, *parts: Column) -> Column:
    """A number under 2**31 - 1 from whole numbers: sums are squared in turn, so that no two parts only shift each other."""
    out = F.lit(seed).cast("long")
    for p in parts:
        out = (out * 48271 + p.cast("long") * 69621 + 1) % MODULUS
        out = (out * out + 12345) % MODULUS
    return out


def block_bootstrap(rows: DataFrame, keys: list[str], x: str, draws: int, block: int = 4, seed: int = 7) -> DataFrame:
    """Mean of ``x`` and its 95 % interval by circular blocks within each instrument's series; starts come from integer mixing of (seed, draw, instrument, block).

    Sums of all blocks are made once from the series, so a draw reads n / block rows, spread over keys, instruments and draws.
    Draw -1 takes each block where it is and so gives the mean itself.
    """
    of = [*keys, "instrument_id"]
    series = Window.partitionBy(*of)
    numbered = rows.select(*of, (F.row_number().over(series.orderBy("as_of")) - 1).alias("_i"), F.count("*").over(series).cast("int").alias("_n"), F.col(x).alias("_x"))
    wrapped = numbered.withColumn("_i", F.explode(F.when(F.col("_i") < block, F.array(F.col("_i"), F.col("_i") + F.col("_n"))).otherwise(F.array("_i"))))
    w = series.orderBy("_i")
    sums = wrapped.select(*of, "_i", "_n", F.array(*[F.sum("_x").over(w.rowsBetween(0, k)) for k in range(block)]).alias("_sums")).where("_i < _n").drop("_n")
    blocks = numbered.where(F.col("_i") % block == 0).select(*of, "_n", F.col("_i").alias("_at"), F.explode(F.sequence(F.lit(-1), F.lit(draws - 1))).alias("draw"))
    start = _mixed(seed, F.col("draw"), F.col("instrument_id"), F.col("_at")) % F.col("_n")
    picked = blocks.withColumn("_i", F.when(F.col("draw") < 0, F.col("_at")).otherwise(start)).withColumn("_k", F.least(F.lit(block), F.col("_n") - F.col("_at")))
    means = picked.join(sums, [*of, "_i"]).groupBy(*keys, "draw").agg((F.sum(F.element_at("_sums", F.col("_k"))) / F.sum("_k")).alias("_m"))
    drawn = F.when(F.col("draw") >= 0, F.col("_m"))
    return means.groupBy(*keys).agg(F.max(F.when(F.col("draw") < 0, F.col("_m"))).alias("point"), F.percentile(drawn, 0.025).alias("low"), F.percentile(drawn, 0.975).alias("high"), F.avg((drawn > 0).cast("double")).alias("share_positive"))
