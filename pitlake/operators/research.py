"""Conditional forward-return studies: filters are rows, thousands of studies are one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlake.functions.stats import Z95
from pitlake.operators.features import own_days

OPS = (">", ">=", "<", "<=", "==", "!=")
HORIZONS = (5, 21, 63)
OVERLAP_DAYS = 1.4


def holds(value: Column, op: Column, limit: Column) -> Column:
    tests = {">": value > limit, ">=": value >= limit, "<": value < limit, "<=": value <= limit, "==": value == limit, "!=": value != limit}
    return F.coalesce(*[F.when(op == o, t) for o, t in tests.items()])


def eligible_days(store: DataFrame, filters: DataFrame) -> DataFrame:
    """(study, instrument_id, d, match): days where all features of a study exist, and whether all filters hold."""
    counted = filters.groupBy("study").agg(F.count("*").alias("n_filters"))
    tested = store.join(F.broadcast(filters.join(counted, "study")), "feature").select("study", "n_filters", "instrument_id", "d", holds(F.col("value"), F.col("op"), F.col("limit")).alias("ok"))
    days = tested.groupBy("study", "instrument_id", "d", "n_filters").agg(F.count("ok").alias("n"), F.bool_and("ok").alias("match"))
    return days.where("n = n_filters").select("study", "instrument_id", "d", "match")


def events(days: DataFrame) -> DataFrame:
    """First day of each episode: the eligible day before did not match."""
    w = Window.partitionBy("study", "instrument_id").orderBy("d")
    return days.withColumn("_before", F.lag("match").over(w)).where(F.col("match") & ~F.coalesce("_before", F.lit(False))).drop("_before", "match")


def forward_returns(px: DataFrame, horizons=HORIZONS) -> DataFrame:
    """(instrument_id, d, horizon, fwd): null past the edge of the data."""
    wide = px.select("instrument_id", "d", *[(F.lead("adj", h).over(own_days()) / F.col("adj") - 1).alias(str(h)) for h in horizons])
    return wide.unpivot(["instrument_id", "d"], [str(h) for h in horizons], "horizon", "fwd").withColumn("horizon", F.col("horizon").cast("int"))


def adverse_moves(px: DataFrame, horizons=HORIZONS) -> DataFrame:
    """(instrument_id, d, horizon, adverse): the worst return over the next sessions, null past the edge of the data."""
    ahead = lambda h: own_days().rowsBetween(1, h)
    wide = px.select("instrument_id", "d", *[F.when(F.count("adj").over(ahead(h)) == h, F.min("adj").over(ahead(h)) / F.col("adj") - 1).alias(str(h)) for h in horizons])
    return wide.unpivot(["instrument_id", "d"], [str(h) for h in horizons], "horizon", "adverse").withColumn("horizon", F.col("horizon").cast("int"))


def summary(rows: DataFrame, keys: list[str], x: str = "fwd") -> DataFrame:
    """Size, moments, quantiles and 95 % interval of a column; nulls are left out."""
    out = rows.where(F.col(x).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.stddev_samp(x).alias("std"), F.avg((F.col(x) > 0).cast("double")).alias("hit_rate"),
        F.max(x).alias("max_gain"), F.min(x).alias("max_loss"), F.percentile(x, 0.25).alias("q25"), F.percentile(x, 0.75).alias("q75"),
    )
    half = Z95 * F.col("std") / F.sqrt("n")
    return out.withColumn("ci_low", F.col("mean") - half).withColumn("ci_high", F.col("mean") + half)


def histogram(rows: DataFrame, keys: list[str], x: str = "fwd", most: int = 10) -> DataFrame:
    """Equal-width bins between the extremes, the last one closed; a single value gets half a unit on each side."""
    rows = rows.where(F.col(x).isNotNull())
    edges = rows.groupBy(*keys).agg(F.least(F.lit(most), F.count("*")).cast("int").alias("bins"), F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    edges = edges.withColumn("lo", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo"))).withColumn("hi", F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5).otherwise(F.col("_hi")))
    at = F.floor((F.col(x) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / F.col("bins")))
    return rows.join(F.broadcast(edges), keys).groupBy(*keys, F.least(at, F.col("bins") - 1).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def study(px: DataFrame, store: DataFrame, filters: DataFrame, horizons=HORIZONS, mode: str = "events") -> DataFrame:
    """Metrics of matches and of the baseline (all eligible days) per study and horizon."""
    days = eligible_days(store, filters)
    chosen = events(days) if mode == "events" else days.where("match").drop("match")
    fwd = forward_returns(px, horizons)
    part = lambda rows, name: summary(rows.join(fwd, ["instrument_id", "d"]), ["study", "horizon"]).withColumn("part", F.lit(name))
    return part(chosen, "match").unionByName(part(days.drop("match"), "baseline"))


def recency_stats(rows: DataFrame, keys: list[str], as_of: Column, half_life: float, x: str = "fwd") -> DataFrame:
    """Weighted by 0.5 ** (age in years / half life): mean, Kish size, corrected variance, error, hit rate."""
    weighted = rows.where(F.col(x).isNotNull()).withColumn("w", F.pow(F.lit(0.5), F.datediff(as_of, "d") / 365.25 / half_life))
    mean = weighted.groupBy(*keys).agg((F.sum(F.col("w") * F.col(x)) / F.sum("w")).alias("_m"))
    both = weighted.join(F.broadcast(mean), keys)
    out = both.groupBy(*keys).agg(
        F.count("*").alias("n"), F.first("_m").alias("mean"), F.sum("w").alias("_w"), F.sum(F.col("w") ** 2).alias("_w2"), F.sum(F.col("w") * (F.col(x) - F.col("_m")) ** 2).alias("_ss"),
        (F.sum(F.col("w") * (F.col(x) > 0).cast("double")) / F.sum("w")).alias("hit_rate"), F.min("d").alias("first_event"), F.max("d").alias("last_event"),
    )
    out = out.withColumn("n_eff", F.col("_w") ** 2 / F.col("_w2")).where("n >= 2 and n_eff > 1")
    out = out.withColumn("variance", F.col("_ss") / F.col("_w") * F.col("n_eff") / (F.col("n_eff") - 1)).withColumn("se", F.sqrt(F.col("variance") / F.col("n_eff")))
    return out.drop("_w", "_w2", "_ss")


def overlap_inflation(rows: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """Variance inflation of overlapping windows: sum over pairs of max(0, 1 - gap / (1.4 h)), by n, without a self-join.

    Per row a range frame over day numbers has the count and sum of the days that reach it from before; the whole
    sum is twice that, less what ties count double. Dates are counted first, so ties are one row.
    """
    width = OVERLAP_DAYS * horizon
    days = rows.groupBy(*keys, F.datediff("d", F.lit("1970-01-01").cast("date")).cast("long").alias("day")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys).orderBy("day").rangeBetween(-int(width), 0)
    reach = days.withColumn("_n", F.sum("c").over(w)).withColumn("_s", F.sum(F.col("c") * F.col("day")).over(w))
    own = F.col("c") * (F.col("_n") - (F.col("_n") * F.col("day") - F.col("_s")) / width)
    return reach.groupBy(*keys).agg(((2 * F.sum(own) - F.sum(F.col("c") ** 2)) / F.sum("c")).alias("inflation"), F.sum("c").alias("n"))


def calendar_episodes(rows: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """Distinct dates of each key with their episode: a gap over 1.4 h days begins a new one."""
    w = Window.partitionBy(*keys).orderBy("d")
    dates = rows.select(*keys, "d").distinct().withColumn("_gap", F.datediff("d", F.lag("d").over(w)))
    return dates.withColumn("episode", F.sum(F.when(F.col("_gap") <= OVERLAP_DAYS * horizon, 0).otherwise(1)).over(w)).drop("_gap")


def herfindahl(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    counts = rows.groupBy(*keys, label).agg(F.count("*").alias("c"))
    return counts.groupBy(*keys).agg((F.sum(F.col("c") * F.col("c")) / (F.sum("c") * F.sum("c"))).alias(f"hhi_{label}"))


def independence(rows: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """Raw and distinct counts of symbols, years and episodes, and their concentration."""
    full = rows.join(calendar_episodes(rows, keys, horizon), [*keys, "d"]).withColumn("year", F.year("d")).withColumn("symbol", F.col("instrument_id"))
    out = full.groupBy(*keys).agg(F.count("*").alias("raw"), F.countDistinct("symbol").alias("symbols"), F.countDistinct("year").alias("years"), F.countDistinct("episode").alias("episodes"))
    for label in ("symbol", "year", "episode"):
        out = out.join(herfindahl(full, keys, label), keys)
    return out


def weighted_moments(rows: DataFrame, keys: list[str], x: str, w: str) -> DataFrame:
    mean = rows.groupBy(*keys).agg((F.sum(F.col(w) * F.col(x)) / F.sum(w)).alias("mean"))
    out = rows.join(F.broadcast(mean), keys).groupBy(*keys).agg(
        F.first("mean").alias("mean"), (F.sum(w) ** 2 / F.sum(F.col(w) ** 2)).alias("n_eff"), (F.sum(F.col(w) * (F.col(x) - F.col("mean")) ** 2) / F.sum(w)).alias("_v"), (F.sum(F.when(F.col(x) > 0, F.col(w)).otherwise(0)) / F.sum(w)).alias("p_positive"),
    )
    return out.withColumn("std", F.when(F.col("n_eff") > 1, F.sqrt(F.col("_v") * F.col("n_eff") / (F.col("n_eff") - 1)))).drop("_v")


def weighted_quantile(rows: DataFrame, keys: list[str], x: str, w: str, q: float) -> DataFrame:
    """Quantile at Hazen positions (cumulative weight less half the own, by the total), linear between, clamped at the ends."""
    by = Window.partitionBy(*keys)
    order = by.orderBy(x, w)
    pos = rows.withColumn("_p", (F.sum(w).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col(w) / 2) / F.sum(w).over(by))
    seen = pos.withColumn("_np", F.lead("_p").over(order)).withColumn("_nx", F.lead(x).over(order)).withColumn("_first", F.row_number().over(order) == 1)
    between = (F.col("_p") <= q) & (F.col("_np") > q)
    value = F.col(x) + (q - F.col("_p")) / (F.col("_np") - F.col("_p")) * (F.col("_nx") - F.col(x))
    return seen.groupBy(*keys).agg(F.coalesce(F.max(F.when(between, value)), F.max(F.when(F.col("_first") & (F.col("_p") > q), F.col(x))), F.max(F.when(F.col("_np").isNull(), F.col(x)))).alias("quantile"))


def path_excursions(px: DataFrame, h: int) -> DataFrame:
    """Per day: worst and best return over the next h sessions, the deepest drawdown of that path, and its volatility."""
    ahead = own_days().rowsBetween(1, h)
    full = F.count("adj").over(ahead) == h
    path = F.collect_list("adj").over(own_days().rowsBetween(0, h))
    fold = F.aggregate("_path", F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("dd")), lambda a, p: F.struct(F.greatest(a["top"], p).alias("top"), F.least(a["dd"], p / F.greatest(a["top"], p) - 1).alias("dd")), lambda a: a["dd"])
    logs = px.withColumn("_lr", F.ln(F.col("adj") / F.lag("adj").over(own_days())))
    rows = logs.select("instrument_id", "d", F.when(full, F.min("adj").over(ahead) / F.col("adj") - 1).alias("mae"), F.when(full, F.max("adj").over(ahead) / F.col("adj") - 1).alias("mfe"), F.when(full, F.stddev_samp("_lr").over(ahead) * 252**0.5).alias("fwd_vol"), F.when(full, path).alias("_path"))
    return rows.withColumn("max_drawdown", fold).drop("_path").where("mae is not null")


def combine_evidence(studies: DataFrame, correlations: DataFrame, group: list[str]) -> DataFrame:
    """Fixed-effect combination of (group, study, effect, se) with correlated errors: effect, se, z clipped to 4, agreement."""
    weighted = studies.withColumn("w", 1 / F.col("se") ** 2)
    total = weighted.groupBy(*group).agg(F.sum("w").alias("_W"), (F.sum(F.col("w") * F.col("effect")) / F.sum("w")).alias("effect"))
    a, b = (weighted.select(*group, F.col("study").alias(f"s{i}"), F.col("w").alias(f"w{i}"), F.col("se").alias(f"se{i}")) for i in (1, 2))
    rho = F.when(F.col("s1") == F.col("s2"), 1.0).otherwise(F.coalesce("rho", F.lit(0.0)))
    pairs = a.join(b, group).join(F.broadcast(correlations), ["s1", "s2"], "left")
    variance = pairs.groupBy(*group).agg(F.sum(F.col("w1") * F.col("w2") * rho * F.col("se1") * F.col("se2")).alias("_v"))
    agree = weighted.select(*group, "w", F.col("effect").alias("own")).join(total, group).groupBy(*group).agg((F.sum(F.when(F.signum("own") == F.signum("effect"), F.col("w")).otherwise(0)) / F.sum("w")).alias("agreement"))
    out = total.join(variance, group).join(agree, group).withColumn("se", F.sqrt("_v") / F.col("_W"))
    return out.withColumn("z", F.greatest(F.lit(-4.0), F.least(F.lit(4.0), F.col("effect") / F.col("se")))).select(*group, "effect", "se", "z", "agreement")
