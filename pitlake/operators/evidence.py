"""Evidence of regimes as it stood at each date: recency weights, overlap of outcome windows, correlation between studies.

A study is a regime (``marks``); its events are the cells (instrument, date) in which it was active and whose outcome was
complete by the date of asking. Weights halve with age, 2 ** (day / half life), so a study's moments are running sums over
the days on which outcomes become known. Overlap is the sum of a triangular kernel over pairs of event dates; dates are
counted first, so it depends on the calendar and not on how many instruments share a date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlake.functions import stats
from pitlake.operators import pit
from pitlake.operators.research import OVERLAP_DAYS

#: Years in which a weight halves, events of a study at least, events for a confidence of one half, bound of z.
HALF_LIFE, LEAST, PRIOR_EVENTS, Z_CLIP = 10.0, 5, 30.0, 4.0
ORIGIN = "1992-01-01"
CELL = ["instrument_id", "as_of", "model", "horizon"]
SPREAD = 1e-12


def first_date_from(rows: DataFrame, dates: DataFrame, day: str, name: str) -> DataFrame:
    """``rows`` with the first of ``dates`` at or after ``day``; rows past the last go. Distinct days only meet the dates."""
    met = rows.select(day).distinct().join(F.broadcast(dates.select(F.col("as_of").alias(name))), F.col(name) >= F.col(day)).groupBy(day).agg(F.min(name).alias(name))
    return rows.join(F.broadcast(met), day)


def events(found: DataFrame, outcomes: DataFrame, dates: DataFrame) -> DataFrame:
    """One row per active regime, cell and horizon with a complete outcome: ``known`` is the first date that sees it."""
    rows = found.join(outcomes.where("fwd is not null"), ["instrument_id", "as_of"])
    age = F.datediff("as_of", F.lit(ORIGIN).cast("date")) / 365.25 / HALF_LIFE
    return first_date_from(rows, dates, "exit_day", "known").withColumn("e", F.pow(F.lit(2.0), age))


def running_moments(rows: DataFrame, marks: list[str]) -> DataFrame:
    """Per study, horizon and ``known``: what all outcomes known by then come to."""
    e, x = F.col("e"), F.col("fwd")
    sums = {"n": F.count("*"), "w": F.sum(e), "w2": F.sum(e * e), "wx": F.sum(e * x), "wxx": F.sum(e * x * x), "wh": F.sum(F.when(x > 0, e).otherwise(0.0))}
    day = rows.groupBy(*marks, "horizon", "known").agg(*[c.alias(n) for n, c in sums.items()], F.min("as_of").alias("first_event"), F.max("as_of").alias("last_event"))
    upto = Window.partitionBy(*marks, "horizon").orderBy("known").rowsBetween(Window.unboundedPreceding, 0)
    return day.select(*marks, "horizon", "known", *[F.sum(n).over(upto).alias(n) for n in sums], F.min("first_event").over(upto).alias("first_event"), F.max("last_event").over(upto).alias("last_event"))


def running_base(outcomes: DataFrame, dates: DataFrame) -> DataFrame:
    """``horizon, as_of, base``: mean of all outcomes that are complete by each date."""
    day = first_date_from(outcomes.where("fwd is not null"), dates, "exit_day", "known").groupBy("horizon", "known").agg(F.sum("fwd").alias("s"), F.count("*").alias("n"))
    upto = Window.partitionBy("horizon").orderBy("known").rowsBetween(Window.unboundedPreceding, 0)
    run = day.select("horizon", "known", (F.sum("s").over(upto) / F.sum("n").over(upto)).alias("base"))
    asked = dates.select("as_of").crossJoin(F.broadcast(run.select("horizon").distinct()))
    return pit.asof(asked, run, ["horizon"], "as_of", "known", ["base"]).where("base is not null")


def counted_dates(rows: DataFrame, asked: DataFrame, marks: list[str]) -> DataFrame:
    """``dates`` per study, horizon and date of asking: (day, count) of its known events, as many as the grid has dates."""
    counts = rows.groupBy(*marks, "horizon", F.datediff("as_of", F.lit(ORIGIN).cast("date")).alias("day"), "known").agg(F.count("*").cast("double").alias("c"))
    seen = asked.select(*marks, "as_of").distinct().join(counts, marks).where("known <= as_of")
    each = seen.groupBy(*marks, "horizon", "as_of", "day").agg(F.sum("c").alias("c"))
    return each.groupBy(*marks, "horizon", "as_of").agg(F.sort_array(F.collect_list(F.struct("day", "c"))).alias("dates"))


def gram(a: Column, b: Column, horizon: Column) -> Column:
    """Sum over pairs of event dates of how far their outcome windows overlap."""
    width = horizon * OVERLAP_DAYS
    near = lambda x, y: F.greatest(F.lit(0.0), 1 - F.abs(x["day"] - y["day"]) / width)
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x["c"] * F.aggregate(b, F.lit(0.0), lambda t, y: t + y["c"] * near(x, y)))


def collect(found: DataFrame, moments: DataFrame, dates: DataFrame, base: DataFrame, marks: list[str]) -> DataFrame:
    """Evidence rows per cell, study and horizon: moments as known at the date, adjusted for overlap, against the base.

    ``base`` is the mean outcome known at each date, per horizon. Studies of fewer than LEAST events, of an effective
    size of one, or without spread are left out.
    """
    keys = [*marks, "horizon", "as_of"]
    own = pit.asof(dates, moments, [*marks, "horizon"], "as_of", "known", ["n", "w", "w2", "wx", "wxx", "wh", "first_event", "last_event"]).join(F.broadcast(base), ["horizon", "as_of"])
    inflation, mean = F.col("gram") / F.col("n"), F.col("wx") / F.col("w")
    size = F.col("w") * F.col("w") / F.col("w2")
    own = own.withColumn("gram", gram(F.col("dates"), F.col("dates"), F.col("horizon"))).withColumns({"size": size, "spread": F.col("wxx") / F.col("w") - mean * mean})
    kept = own.where((F.col("n") >= LEAST) & (F.col("size") > 1 + 1e-9) & (F.col("spread") > SPREAD))
    error = F.sqrt(F.col("spread") / (F.col("size") - 1) * inflation)
    study = kept.select(*keys, "n", (F.col("size") / inflation).alias("n_eff"), inflation.alias("inflation"), mean.alias("mean"), (F.col("wh") / F.col("w")).alias("hit_rate"), "base", (mean - F.col("base")).alias("effect"), error.alias("se"), "first_event", "last_event", "gram", "dates")
    return found.join(study, [*marks, "as_of"])


def correlations(rows: DataFrame, marks: list[str]) -> DataFrame:
    """``rho`` of the pairs of studies that stand together in a cell, from their event dates; each pair once per date."""
    rest = [m for m in marks if m != "model"]
    side = lambda s: rows.select(*CELL, *[F.col(c).alias(f"{s}_{c}") for c in (*rest, "gram", "dates")])
    pairs = side("a").join(side("b"), CELL).where(F.struct(*[f"a_{c}" for c in rest]) < F.struct(*[f"b_{c}" for c in rest]))
    shared = ["model", "horizon", "as_of", *[f"{s}_{c}" for s in "ab" for c in rest]]
    each = pairs.groupBy(*shared).agg(*[F.first(f"{s}_{c}").alias(f"{s}_{c}") for s in "ab" for c in ("gram", "dates")])
    return each.select(*shared, (gram(F.col("a_dates"), F.col("b_dates"), F.col("horizon")) / F.sqrt(F.col("a_gram") * F.col("b_gram"))).alias("rho"))


def aggregate(rows: DataFrame, rhos: DataFrame, active: DataFrame, marks: list[str], names: str = "label") -> DataFrame:
    """Per cell and horizon the studies combined: effect, score, confidence, expected return, best studies and diagnostics.

    Weights are inverse variances; the error is that of correlated studies. ``active`` counts the regimes of a cell.
    """
    rest = [m for m in marks if m != "model"]
    w = 1 / (F.col("se") * F.col("se"))
    total = rows.groupBy(*CELL).agg(
        F.count("*").alias("studies"), F.sum(w).alias("w"), (F.sum(w * F.col("effect")) / F.sum(w)).alias("effect"), (F.sum(w * F.col("mean")) / F.sum(w)).alias("expected"), (F.sum(w * F.col("hit_rate")) / F.sum(w)).alias("hit_rate"),
        F.max("n_eff").alias("n_eff"), F.sum(F.when(F.col("effect") >= 0, w).otherwise(0.0)).alias("up"), F.max("n").alias("events"),
    )
    side = lambda s: rows.select(*CELL, *[F.col(c).alias(f"{s}_{c}") for c in (*rest, "se")])
    both = side("a").join(side("b"), CELL).where(F.struct(*[f"a_{c}" for c in rest]) < F.struct(*[f"b_{c}" for c in rest]))
    both = both.join(rhos, ["model", "horizon", "as_of", *[f"{s}_{c}" for s in "ab" for c in rest]])
    cross = both.groupBy(*CELL).agg(F.sum(F.col("rho") / (F.col("a_se") * F.col("b_se"))).alias("cross"), F.avg("rho").alias("correlation"))
    out = total.join(cross, CELL, "left").na.fill(0.0, ["cross", "correlation"]).join(active, ["instrument_id", "as_of", "model"])
    z = F.col("effect") * F.col("w") / F.sqrt(F.col("w") + 2 * F.col("cross"))
    agreement = F.when(F.col("effect") >= 0, F.col("up")).otherwise(F.col("w") - F.col("up")) / F.col("w")
    out = out.withColumns({"z_raw": z, "agreement": agreement}).withColumn("z", F.greatest(F.lit(-Z_CLIP), F.least(F.lit(Z_CLIP), F.col("z_raw"))))
    out = out.withColumns({"score": stats.score_from_z("z"), "confidence": stats.confidence("n_eff", PRIOR_EVENTS, F.col("agreement")), "saturated": F.abs("z_raw") > Z_CLIP})
    return out.join(_best(rows, F.col("effect") > 0, "supporting", names), CELL, "left").join(_best(rows, F.col("effect") < 0, "negative", names), CELL, "left").drop("w", "cross", "up")


def _best(rows: DataFrame, which: Column, name: str, names: str, k: int = 3) -> DataFrame:
    """The ``k`` studies with the largest |effect| / se of one sign, joined by "; "."""
    order = Window.partitionBy(*CELL).orderBy(F.round(F.abs("effect") / F.col("se"), 6).desc(), names)
    first = rows.where(which).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    return first.groupBy(*CELL).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", names))), lambda s: s[names]), "; ").alias(name))
