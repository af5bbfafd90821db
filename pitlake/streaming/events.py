"""Structured Streaming versions of the ingestion steps, over the events table as a file stream.

Steps with state join each micro-batch with a versioned table of one row per key and write their results to another, both
under the batch's number: a batch that comes again after a crash changes nothing, a key with most of a batch is sorted by
Spark and never held in Python, and what a step knows outlives the process. A step started again on the same folder goes on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitlake.sources.sinks import scratch
from pitlake.sources.versioned import VersionedTable

BUCKETS = 16


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream with a proper timestamp."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process what there is, then stop; the result is what the sink holds."""
    spark = stream.sparkSession
    out = scratch(spark, name)
    stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", scratch(spark, f"{name}-state")).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain(stream: DataFrame, step: Callable[[DataFrame, int], None], root: str, mode: str = "append") -> None:
    """Hand each micro-batch to ``step``; the checkpoint lies under ``root``, so a second call goes on where the first ended."""
    stream.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def bucket(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))


def results(spark: SparkSession, root: str, schema: str) -> VersionedTable:
    """Rows of a step, each batch a partition of its own: written again it replaces itself."""
    return VersionedTable(spark, f"{root}/results", f"{schema}, batch long", F.col("batch"))


def append(table: VersionedTable, rows: DataFrame, batch: int) -> None:
    table.merge(rows.withColumn("batch", F.lit(batch).cast("long")), lambda _, new: new, "results", batch)


def newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; partial maxima meet in the shuffle, so a hot key costs no more than others."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*rows.columns)


def bars(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Tumbling bars per event type; works on a table and, with a watermark, on a stream."""
    at = F.struct("ts", "event_id")
    grouped = events.groupBy("event_type", F.window("ts", width).alias("w")).agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("n"))
    return grouped.select("event_type", F.to_date("w.start").alias("d"), "open", "high", "low", "close", "n")


def kept_bars(events: DataFrame, root: str) -> DataFrame:
    """Bars of the stream as they stand: a batch brings the bars that it changed, and these replace what was kept of them."""
    table = VersionedTable(events.sparkSession, f"{root}/bars", "event_type string, d date, open double, high double, low double, close double, n long", F.trunc("d", "month"))
    keys = ["event_type", "d"]

    def step(batch: DataFrame, n: int) -> None:
        table.merge(batch, lambda stored, new: stored.join(new.select(*keys), keys, "left_anti").unionByName(new), "bars", n)

    drain(bars(events), step, root, "update")
    return table.read()


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Episodes of a user's activity, closed by a gap."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("started"), "n")


def dedup_late(events: DataFrame, key: list[str], late: str = "3 days") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def quarantine(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected ones with the rule."""
    rule = F.when(F.col("value").isNull(), "no_value").when(F.col("value") < 0, "negative").when(F.col("props").isNull() | (F.col("props") == ""), "no_props")
    flagged = events.withColumn("rule", rule)
    return flagged.where("rule is null").drop("rule"), flagged.where("rule is not null")


def append_on_change(events: DataFrame, root: str) -> DataFrame:
    """Rows of a user whose event type differs from the user's latest one before. Rows that come later than a newer one of
    their user change nothing.
    """
    spark = events.sparkSession
    state = VersionedTable(spark, f"{root}/latest", "user_id long, ts timestamp, event_id long, event_type string", bucket("user_id"))
    out = results(spark, root, "user_id long, event_id long, event_type string")
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")

    def step(batch: DataFrame, n: int) -> None:
        new = batch.select("user_id", "ts", "event_id", "event_type").withColumn("old", F.lit(False))
        old = state.read().join(new.select("user_id").distinct(), "user_id", "left_semi").withColumn("old", F.lit(True))
        seen = new.unionByName(old).withColumns({"before": F.lag("event_type").over(own), "first": F.max("old").over(own.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
        changed = seen.where(~F.col("old") & ~F.col("first") & ~F.col("event_type").eqNullSafe(F.col("before")))
        append(out, changed.select("user_id", "event_id", "event_type"), n)
        state.merge(newest(new.drop("old"), ["user_id"], ["ts", "event_id"]), lambda stored, rows: newest(stored.unionByName(rows), ["user_id"], ["ts", "event_id"]), "changes", n)

    drain(events, step, root)
    return out.read().drop("batch")


def stale_feeds(events: DataFrame, root: str, key: str, allowance: str) -> DataFrame:
    """``feed, since, ended``: silences of a feed beyond the allowance, each told once.

    A silence is told as soon as the stream's latest time is that far ahead of the feed's, without a next event of the
    feed; one that began and ended between two batches is told with its end.
    """
    spark = events.sparkSession
    state = VersionedTable(spark, f"{root}/latest", "feed string, last timestamp, told boolean", bucket("feed"))
    out = results(spark, root, "feed string, since timestamp, ended timestamp")
    own = Window.partitionBy("feed").orderBy("t", F.desc("told"))

    def step(batch: DataFrame, n: int) -> None:
        stored = state.read()
        new = batch.select(F.col(key).cast("string").alias("feed"), F.col("ts").alias("t"), F.lit(False).alias("told"))
        rows = new.unionByName(stored.select("feed", F.col("last").alias("t"), "told")).withColumns({"before": F.lag("t").over(own), "known": F.coalesce(F.lag("told").over(own), F.lit(False))})
        late = F.col("t") > F.col("before") + F.expr(f"interval {allowance}")
        over = rows.where(late & ~F.col("known")).select("feed", F.col("before").alias("since"), F.col("t").alias("ended"))
        last = newest(rows.select("feed", "t", "told"), ["feed"], ["t", "told"])
        clock = last.agg(F.max("t").alias("now"))  # one row
        silent = last.crossJoin(F.broadcast(clock)).withColumn("silent", F.col("now") > F.col("t") + F.expr(f"interval {allowance}"))
        told = silent.where("silent and not told").select("feed", F.col("t").alias("since"), F.lit(None).cast("timestamp").alias("ended"))
        append(out, over.unionByName(told), n)
        latest = silent.select("feed", F.col("t").alias("last"), (F.col("told") | F.col("silent")).alias("told"))
        fresh = latest.join(stored, ["feed", "last", "told"], "left_anti")
        state.merge(fresh, lambda old, rows: old.join(rows.select("feed"), "feed", "left_anti").unionByName(rows), "feeds", n)

    drain(events, step, root)
    return out.read().drop("batch")


def enrich_asof(events: DataFrame, dated: DataFrame, root: str) -> DataFrame:
    """Events with the latest known value of their type, joined per micro-batch against the static table."""
    out = results(events.sparkSession, root, "event_id long, event_type string, level double")

    def step(batch: DataFrame, n: int) -> None:
        told = dated.select("event_type", F.col("known").alias("t"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("event_id"), "level")
        asked = batch.select("event_type", F.col("ts").alias("t"), F.lit(1).alias("side"), "event_id", F.lit(None).cast("double").alias("level"))
        w = Window.partitionBy("event_type").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
        append(out, told.union(asked).withColumn("level", F.last("level", ignorenulls=True).over(w)).where("side = 1").select("event_id", "event_type", "level"), n)

    drain(events, step, root)
    return out.read().drop("batch")


def incremental_ingest(events: DataFrame, root: str) -> DataFrame:
    """Latest row per (user, type), merged batch by batch; only the buckets that a batch touches are written anew."""
    keys, order = ["user_id", "event_type"], ["ts", "event_id"]
    table = VersionedTable(events.sparkSession, f"{root}/table", "user_id long, event_type string, ts timestamp, event_id long, value double", bucket("user_id"))

    def step(batch: DataFrame, n: int) -> None:
        rows = newest(batch.select("user_id", "event_type", "ts", "event_id", "value"), keys, order)
        table.merge(rows, lambda stored, new: newest(stored.unionByName(new), keys, order), "ingest", n)

    drain(events, step, root)
    return table.read().drop("ts")
