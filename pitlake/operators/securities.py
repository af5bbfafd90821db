"""Security master, universe, identity bridge and delist-aware forward outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlake.operators import pit

FAR = "9999-12-31"


#: Owners of one key that meet as many others in one group of the join, in expectation.
BLOCK = 512


def overlaps(rows: DataFrame, key: str, owner: str, block: int = BLOCK) -> DataFrame:
    """Pairs of intervals of one key that overlap and belong to different owners, each pair once.

    An owner's intervals become one row per key. The owners of a key are dealt into blocks of about ``block`` by a hash,
    as many as the key's count asks for, and each pair of blocks is a group of its own: a hot key spreads over tasks, a
    group holds two blocks, and pairs are found once, so none are kept to compare them.
    """
    spans = rows.groupBy(key, owner).agg(F.collect_set(F.struct("valid_from", F.coalesce("valid_to", F.lit(FAR).cast("date")).alias("valid_to"))).alias("spans"))
    n = spans.groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    dealt = spans.join(n, key).withColumn("_own", F.pmod(F.xxhash64(owner), F.col("_n")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    a = dealt.select(key, F.col("_own").alias("_x"), F.col("_other").alias("_y"), F.col(owner).alias("a"), F.col("spans").alias("sa"))
    b = dealt.select(key, F.col("_other").alias("_x"), F.col("_own").alias("_y"), F.col(owner).alias("b"), F.col("spans").alias("sb"))
    meets = F.exists("sa", lambda x: F.exists("sb", lambda y: (x["valid_from"] < y["valid_to"]) & (y["valid_from"] < x["valid_to"])))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as given: the pairs outgrow the rows that adaptive sizes go by
    a, b = (side.repartition(parts, key, "_x", "_y") for side in (a, b))
    return a.join(b.hint("merge"), [key, "_x", "_y"]).where((F.col("a") < F.col("b")) & meets).select(key, "a", "b")


def universe(master: DataFrame, dates: DataFrame, least_days: int = 252) -> DataFrame:
    """Every security on every reconstitution date: included, or the first reason why not."""
    grid = master.crossJoin(F.broadcast(dates))
    reason = (
        F.when(F.col("listed").isNull(), "no_first_date").when(F.col("listed") > F.col("as_of"), "not_listed").when(F.col("delisted") <= F.col("as_of"), "delisted")
        .when(F.col("kind") != "stock", "type").when(F.datediff("as_of", "listed") < least_days, "history").otherwise("included")
    )
    return grid.select("security_id", "as_of", reason.alias("status"))


def members_asof(members: DataFrame, days: DataFrame) -> DataFrame:
    """Per day the members of the last reconstitution at or before it."""
    dates = members.select(F.col("as_of").alias("recon")).distinct().withColumn("_all", F.lit(0))
    at = pit.asof(days.withColumn("_all", F.lit(0)), dates.withColumn("_t", F.col("recon")), ["_all"], "day", "_t", ["recon"]).select("day", "recon")
    return at.join(members.withColumnRenamed("as_of", "recon"), "recon").select("day", "security_id")


def manifest(members: DataFrame) -> DataFrame:
    """Per date the number of members and a digest of their sorted ids."""
    ids = F.array_join(F.sort_array(F.collect_list(F.lpad(F.col("security_id").cast("string"), 12, "0"))), ",")
    return members.groupBy("as_of").agg(F.count("*").alias("n"), F.sha2(ids, 256).alias("sha256"))


def daily_returns(bars: DataFrame, terminals: DataFrame) -> DataFrame:
    """Daily returns with a status; a terminal event adds a row of its own, unresolved when its value isn't known."""
    w = Window.partitionBy("security_id").orderBy("d")
    ret = F.try_divide(F.col("adj"), F.lag("adj").over(w)) - 1
    rows = bars.select("security_id", "d", ret.alias("ret"), F.when(F.lag("adj").over(w).isNull(), "missing").when(F.col("split") != 1, "corporate_action").otherwise("normal").alias("status"))
    ends = terminals.select("security_id", F.col("ended").alias("d"), F.col("value").alias("ret"), F.when(F.col("value").isNull(), "unresolved").otherwise("delisting").alias("status"))
    return rows.unionByName(ends)


def forward_outcomes(grid: DataFrame, bars: DataFrame, terminals: DataFrame, last_day: Column, horizons=(30, 91, 365)) -> DataFrame:
    """Per (security, as_of, horizon in calendar days) what an entry at the next bar came to; no row is dropped.

    A terminal event inside the window ends it with its own return; otherwise the last bar up to the target
    counts, as truncated when the data end before the target.
    """
    h = grid.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    back = bars.select("security_id", (-F.datediff("d", F.lit("1970-01-01").cast("date"))).alias("_n"), F.col("d").alias("entry"), F.col("adj").alias("entry_price"))
    h = h.withColumn("_t", -F.datediff("as_of", F.lit("1970-01-01").cast("date")))
    entered = pit.asof(h, back, ["security_id"], "_t", "_n", ["entry", "entry_price"]).withColumn("target", F.date_add("entry", F.col("horizon")))
    fwd = bars.select("security_id", F.col("d").alias("_d"), F.col("d").alias("exit"), F.col("adj").alias("exit_price"))
    exited = pit.asof(entered.withColumn("_until", F.coalesce("target", "as_of")), fwd, ["security_id"], "_until", "_d", ["exit", "exit_price"])
    joined = exited.join(terminals, "security_id", "left")
    ended = (F.col("ended") > F.col("entry")) & (F.col("ended") <= F.col("target"))
    price = F.col("exit_price") / F.col("entry_price")
    status = F.when(F.col("entry").isNull(), "no_entry_price").when(ended & F.col("value").isNull(), "unresolved").when(ended, "delisted").when(F.col("target") > last_day, "truncated").otherwise("complete")
    value = F.when(status.isin("complete", "truncated"), price - 1).when(status == "delisted", price * (1 + F.col("value")) - 1)
    return joined.select("security_id", "as_of", "horizon", "entry", status.alias("status"), value.alias("fwd"))


def bridge(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Status of incoming instrument -> security mappings against the active ones."""
    hit = (F.col("i.valid_from") <= F.col("e.valid_to")) & (F.col("e.valid_from") <= F.col("i.valid_to"))
    met = incoming.alias("i").join(existing.alias("e"), (F.col("i.instrument_id") == F.col("e.instrument_id")) & hit, "left")
    flags = met.groupBy("i.instrument_id", "i.security_id", "i.valid_from", "i.valid_to", "i.manual").agg(F.bool_or(F.col("e.security_id") != F.col("i.security_id")).alias("other"), F.bool_or(F.col("e.security_id") == F.col("i.security_id")).alias("same"))
    status = F.when(F.col("manual"), "supersedes").when(F.coalesce("other", F.lit(False)), "quarantined").when(F.coalesce("same", F.lit(False)), "skipped").otherwise("active")
    return flags.select("instrument_id", "security_id", "valid_from", status.alias("status"))
