"""Historical analogues: for each instrument and scoring date the past days that look like it, and what followed them.

A day is four vectors (domains). A column is standardised by its own history up to the scoring date, whose sums run along
the days, so every date of a grid has its moments without another pass. Similarities are numbers made where the vectors
meet; only they are ranked (rounded to nine digits, so that sums in another order rank alike), and Spark keeps the best of each cell per task before rows move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlake.operators import pit

DOMAINS = ("market", "sector", "company", "catalysts")
CELL = ["instrument_id", "as_of"]
#: Sessions before a candidate, sessions between a candidate and the target or another match, shared dimensions, analogues at least and at most.
LEAST_HISTORY, LEAST_GAP, COVERAGE, LEAST_MATCHES, MATCHES = 504, 10, 0.6, 10, 30
#: A standard deviation up to which a column counts as constant, for a mean of about one.
CONSTANT = 1e-6
BIG = 1_000_000
#: Name, weights of the domains, days kept by the market and by the sector.
VARIANTS = (
    ("full", 0.35, 0.20, 0.30, 0.15, 500, 200),
    ("no_market", 0.0, 0.20, 0.30, 0.15, BIG, 200),
    ("no_sector", 0.35, 0.0, 0.30, 0.15, 500, BIG),
    ("no_company", 0.35, 0.20, 0.0, 0.15, 500, 200),
    ("no_catalysts", 0.35, 0.20, 0.30, 0.0, 500, 200),
    ("market_only", 0.35, 0.0, 1e-9, 0.0, 500, BIG),
    ("company_only", 0.0, 0.0, 0.30, 0.0, BIG, BIG),
    ("market_company", 0.5, 0.0, 0.5, 0.0, 500, BIG),
    ("equal_weights", 0.25, 0.25, 0.25, 0.25, 500, 200),
    ("company_heavy", 0.15, 0.15, 0.55, 0.15, 500, 200),
    ("market_heavy", 0.55, 0.15, 0.20, 0.10, 500, 200),
    ("catalyst_light", 0.40, 0.22, 0.33, 0.05, 500, 200),
)
VARIANT = "variant string, w_market double, w_sector double, w_company double, w_catalysts double, keep_market int, keep_sector int"


def as_map(history: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Per key and day a map from feature to value."""
    return history.groupBy(*keys, "d").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias(name))


def moments_at(targets: DataFrame, history: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``targets(keys, d)`` with a map from feature to (mean, std) of its history through ``d``; constant columns are absent."""
    w = Window.partitionBy(*keys, "feature").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    run = history.where("value is not null").select(*keys, "feature", "d", F.count("value").over(w).alias("n"), F.sum("value").over(w).alias("s"), F.sum(F.col("value") * F.col("value")).over(w).alias("ss"))
    asked = targets.select(*keys, "d").distinct().crossJoin(F.broadcast(history.select("feature").distinct()))
    known = pit.asof(asked, run, [*keys, "feature"], "d", "d", ["n", "s", "ss"]).where("n is not null")
    mean = F.col("s") / F.col("n")
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - mean * mean))
    kept = known.select(*keys, "d", "feature", mean.alias("mean"), std.alias("std")).where(F.col("std") > CONSTANT * (1 + F.abs("mean")))
    maps = kept.groupBy(*keys, "d").agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std")))).alias(name))
    return targets.join(maps, [*keys, "d"], "left")


def picked(of: dict[str, list[str]]) -> Column:
    """An array of the named features from maps: ``{map column: features}``."""
    return F.array(*[F.col(m)[f] for m, features in of.items() for f in features])


def standardised(values: Column, moments: Column) -> Column:
    return F.zip_with(values, moments, lambda v, m: (v - m["mean"]) / m["std"])


def cosine(a: Column, b: Column) -> Column:
    """Struct of dot product, squared norms and count over the dimensions that both sides have."""
    both = F.filter(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    zero = F.struct(F.lit(0.0).alias("dot"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("n"))
    return F.aggregate(both, zero, lambda s, p: F.struct((s["dot"] + p["x"] * p["y"]).alias("dot"), (s["a"] + p["x"] * p["x"]).alias("a"), (s["b"] + p["y"] * p["y"]).alias("b"), (s["n"] + 1).alias("n")))


def candidates(cells: DataFrame, days: DataFrame) -> DataFrame:
    """Cells with the earlier days of their instrument that have enough history and lie far enough before the target."""
    return cells.join(days, "instrument_id").where((F.col("pos") > LEAST_HISTORY) & (F.col("pos") <= F.col("target_pos") - LEAST_GAP))


def similarities(pairs: DataFrame) -> DataFrame:
    """Per pair and domain the similarity (null with too little coverage) and the coverage.

    ``pairs`` has for each domain the target's standardised vector ``t_``, the moments ``m_`` and the candidate's ``v_``.
    """
    rows = pairs.withColumns({f"c_{n}": cosine(F.col(f"t_{n}"), standardised(F.col(f"v_{n}"), F.col(f"m_{n}"))) for n in DOMAINS})
    out = rows.select(*CELL, "d", "pos", "target_pos", "has_sector", *[F.col(f"c_{n}") for n in DOMAINS], *[F.size(F.filter(f"m_{n}", lambda m: m.isNotNull())).alias(f"k_{n}") for n in DOMAINS])
    for n in DOMAINS:
        norm, cover = F.sqrt(F.col(f"c_{n}.a")) * F.sqrt(F.col(f"c_{n}.b")), F.try_divide(F.col(f"c_{n}.n"), F.col(f"k_{n}"))
        value = F.when(norm > 0, F.col(f"c_{n}.dot") / norm).otherwise(0.0)
        out = out.withColumns({n: F.when((F.col(f"c_{n}.n") > 0) & (cover >= COVERAGE), value), f"cover_{n}": F.coalesce(cover, F.lit(0.0))})
    return out.drop(*[f"{p}_{n}" for p in "ck" for n in DOMAINS])


def staged(sims: DataFrame, variants: DataFrame) -> DataFrame:
    """Per variant and cell: the best by market, of these the best by sector (all where there is no sector), then the
    weighted overall similarity of those with a company similarity, ranked; equal ones by day.
    """
    cell = ["variant", *CELL]
    rows = sims.where("market is not null").crossJoin(F.broadcast(variants))
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*cell).orderBy(F.round("market", 9).desc(), "d"))).where(F.col("_r") <= F.col("keep_market"))
    order = Window.partitionBy(*cell).orderBy(F.round(F.coalesce("sector", F.lit(-2.0)), 9).desc(), "d")
    second = first.withColumn("_r", F.row_number().over(order)).where(~F.col("has_sector") | (F.col("_r") <= F.col("keep_sector"))).where("company is not null")
    total = lambda terms: sum(terms, F.lit(0.0))
    there = {n: F.col(n).isNotNull() for n in DOMAINS}
    weight = total(F.when(there[n], F.col(f"w_{n}")).otherwise(0.0) for n in DOMAINS)
    overall = total(F.when(there[n], F.col(f"w_{n}") * F.col(n)).otherwise(0.0) for n in DOMAINS)
    cover = total(F.when(there[n], F.col(f"cover_{n}")).otherwise(0.0) for n in DOMAINS) / total(there[n].cast("double") for n in DOMAINS)
    scored = second.select(*cell, "d", "pos", "target_pos", *DOMAINS, (overall / weight).alias("similarity"), cover.alias("coverage"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*cell).orderBy(F.round("similarity", 9).desc(), "d")))


def dedup_gap(matches: DataFrame, keys: list[str] | None = None, gap: int = LEAST_GAP, most: int | None = None) -> DataFrame:
    """Best first, kept only if ``gap`` sessions away from all that are kept, ``most`` of them.

    A fold over the matches of a cell, of which there are as many as its stages keep.
    """
    keys = keys or CELL
    rows = matches.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", "pos", "d", "similarity"))).alias("rows"))
    start = F.array().cast("array<struct<rank:int,pos:int,d:date,similarity:double>>")
    near = lambda acc, x: F.exists(acc, lambda k: F.abs(k["pos"] - x["pos"]) < gap)
    full = lambda acc: F.size(acc) >= F.lit(most if most else 1 << 30)
    kept = F.aggregate("rows", start, lambda acc, x: F.when(full(acc) | near(acc, x), acc).otherwise(F.array_append(acc, x)))
    return rows.select(*keys, F.inline(kept))


def sufficiency(cells: DataFrame, pairs: DataFrame, ranked: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per cell the counts of each stage and the first that is too small."""
    count = lambda df, name: df.groupBy(*CELL).agg(F.count("*").alias(name))
    out = cells.select(*CELL)
    for df, name in ((pairs, "candidates"), (ranked, "covered"), (chosen, "matches")):
        out = out.join(count(df, name), CELL, "left")
    out = out.na.fill(0)
    few = lambda c: F.col(c) < LEAST_MATCHES
    return out.withColumn("verdict", F.when(few("candidates"), "candidates").when(few("covered"), "coverage").when(few("matches"), "matches").otherwise("sufficient"))


def path_metrics(matches: DataFrame, prices: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """Matches per horizon whose window ends by the target: return, worst, best, deepest drawdown and volatility of the path.

    ``prices`` has one array of all closes per instrument, as long as the calendar.
    """
    rows = matches.join(prices, "instrument_id").withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).where(F.col("pos") + F.col("horizon") <= F.col("target_pos"))
    rows = rows.withColumn("path", F.slice("adj", F.col("pos"), F.col("horizon") + 1)).drop("adj")
    first, last = F.col("path")[0], F.element_at("path", -1)
    ahead = F.slice(F.col("path"), F.lit(2), F.col("horizon"))
    logs = F.zip_with(ahead, F.slice(F.col("path"), F.lit(1), F.col("horizon")), lambda b, a: F.ln(b / a))
    fold = F.aggregate("path", F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("dd")), lambda a, p: F.struct(F.greatest(a["top"], p).alias("top"), F.least(a["dd"], p / F.greatest(a["top"], p) - 1).alias("dd")), lambda a: a["dd"])
    mean = F.aggregate("_logs", F.lit(0.0), lambda s, x: s + x) / F.size("_logs")
    var = F.aggregate("_logs", F.lit(0.0), lambda s, x: s + (x - F.col("_mean")) * (x - F.col("_mean"))) / (F.size("_logs") - 1)
    out = rows.withColumns({"fwd": last / first - 1, "mae": F.array_min(ahead) / first - 1, "mfe": F.array_max(ahead) / first - 1, "drawdown": fold, "_logs": logs}).withColumn("_mean", mean)
    return out.withColumn("vol", F.when(F.size("_logs") > 1, F.sqrt(var) * 252**0.5).otherwise(0.0)).drop("path", "_logs", "_mean")


def outcomes(paths: DataFrame, keys: list[str]) -> DataFrame:
    """What followed the matches, per ``keys`` and horizon; ``market`` and ``peers`` are returns of benchmark and sector over the same window."""
    x, w = F.col("fwd"), F.col("similarity")
    share = lambda c: F.avg(c.cast("double"))
    return paths.groupBy(*keys, "horizon").agg(
        F.count("*").alias("n"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.when(F.sum(w) > 0, F.sum(w * x) / F.sum(w)).otherwise(F.avg(x)).alias("weighted_mean"),
        F.avg(x - F.col("market")).alias("market_relative"), F.avg(x - F.col("peers")).alias("sector_relative"), share(x > 0).alias("p_up"), share(x > F.col("market")).alias("p_beat"),
        F.median("drawdown").alias("drawdown"), F.median("mae").alias("mae"), F.median("mfe").alias("mfe"), F.avg("vol").alias("vol"), *[F.percentile(x, q / 100).alias(f"p{q}") for q in (10, 25, 75, 90)],
    )
