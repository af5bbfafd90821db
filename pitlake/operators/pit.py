"""Point-in-time primitives: what was known on a day, and positions in a calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, values: list[str], skip_null: str | None = None) -> DataFrame:
    """``left`` with ``values`` of the latest row of ``right`` per ``on`` whose time is not after the left row's.

    One sort of the union, no self-join. The latest row wins even when its values are null; ``skip_null`` names a
    column whose null rows are left out first.
    """
    if skip_null:
        right = right.where(F.col(skip_null).isNotNull())
    r = right.select(*on, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*values).alias("_v"), F.lit(None).cast(left.schema).alias("_l"))
    l_ = left.select(*on, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_v"), F.struct(*left.columns).alias("_l"))
    w = Window.partitionBy(*on).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(l_).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return both.select("_l.*", *[F.col(f"_v.{v}").alias(v) for v in values])


def align_availability(days: DataFrame, observations: DataFrame, value: str = "value") -> DataFrame:
    """Per (code, day) the latest observation that is public by then, null values included."""
    codes = observations.select("code").distinct()
    return asof(days.select("d").crossJoin(codes), observations, ["code"], "d", "available_from", ["obs_date", value])


def ffill(panel: DataFrame, dated: DataFrame, on: list[str], date: str, value: str) -> DataFrame:
    """Per panel row the latest non-null value at or before its day."""
    return asof(panel, dated, on, "d", date, [value], skip_null=value)


def interval_resolve(facts: DataFrame, intervals: DataFrame, on: list[str], day: str) -> DataFrame:
    """Facts with the interval row (``valid_from <= day < valid_to``, open end allowed) of their key."""
    inside = (F.col(day) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(day) < F.col("valid_to")))
    return facts.join(intervals, on).where(inside)


def close_intervals(changes: DataFrame, key: str, start: str = "valid_from") -> DataFrame:
    """A batch of dated changes as intervals: each ends where the next of its key begins."""
    return changes.withColumn("valid_to", F.lead(start).over(Window.partitionBy(key).orderBy(start)))


def known_min_future(days: DataFrame, events: DataFrame, on: str, event: str, known: str) -> DataFrame:
    """Per row the nearest event after its day among those announced by then; superseded announcements count."""
    seen = days.select(on, "d", F.lit(None).cast("date").alias("_e"), F.lit(1).alias("_side"))
    told = events.select(on, F.col(known).alias("d"), F.col(event).alias("_e"), F.lit(0).alias("_side"))
    order = Window.partitionBy(on).orderBy("d", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return seen.unionByName(told).withColumn("_known", F.collect_set("_e").over(order)).where("_side = 1").select(on, "d", F.array_min(F.filter("_known", lambda e: e > F.col("d"))).alias("next_event"))


def session_at(days: DataFrame, calendar: DataFrame, day: str) -> DataFrame:
    """Rows with the calendar's last session at or before ``day``: ``entry`` and its position ``entry_idx``.

    Only the distinct days, of which there are as many as the calendar is long, are aligned and sent to the rows.
    """
    cal = calendar.select(F.col("d").alias("entry"), F.col("idx").alias("entry_idx"), F.lit(0).alias("_all"))
    found = asof(days.select(day).distinct().withColumn("_all", F.lit(0)), cal, ["_all"], day, "entry", ["entry", "entry_idx"]).drop("_all")
    return days.join(F.broadcast(found), day, "left")


def completed_session(rows: DataFrame, calendar: DataFrame, now: str, close_minutes: int = 16 * 60, buffer_minutes: int = 60) -> DataFrame:
    """Rows with the last session that is over at their time ``now``: its regular close and a buffer have passed."""
    day = F.to_date(F.col(now) - F.expr(f"interval {close_minutes + buffer_minutes} minutes"))
    return session_at(rows.withColumn("_done", day), calendar, "_done").drop("_done")


def is_half_day(d: Column) -> Column:
    """Early closes: the day after Thanksgiving, Christmas Eve, and the third of July, on days that are traded."""
    weekday = F.weekday(d)  # Monday is 0
    friday = (F.month(d) == 11) & (weekday == 4) & F.dayofmonth(d).between(23, 29)
    eve = ((F.month(d) == 12) & (F.dayofmonth(d) == 24)) | ((F.month(d) == 7) & (F.dayofmonth(d) == 3))
    return friday | (eve & (weekday < 4))


def session_offset(rows: DataFrame, calendar: DataFrame, k: Column | int, name: str) -> DataFrame:
    """The session ``k`` places after ``entry_idx``; null past the calendar's end."""
    cal = calendar.select(F.col("idx").alias("_i"), F.col("d").alias(name))
    return rows.join(cal, F.col("entry_idx") + k == F.col("_i"), "left").drop("_i")


def positions(panel: DataFrame) -> DataFrame:
    """Rows with their position in the instrument's own sessions, from 1."""
    return panel.withColumn("pos", F.row_number().over(Window.partitionBy("instrument_id").orderBy("d")))


def label_observability(rows: DataFrame, panel: DataFrame, cutoff: Column, horizon: int) -> DataFrame:
    """Whether a label ``horizon`` sessions after ``d`` lies at or before the cutoff, with the reason."""
    pos = positions(panel.select("instrument_id", "d"))
    last = pos.where(F.col("d") <= cutoff).groupBy("instrument_id").agg(F.max("pos").alias("last_pos"))
    joined = rows.join(pos, ["instrument_id", "d"], "left").join(last, "instrument_id", "left")
    reason = (
        F.when(F.col("d") > cutoff, "after_cutoff").when(F.col("last_pos").isNull(), "missing_calendar").when(F.col("pos").isNull(), "unavailable")
        .when(F.col("pos") + horizon > F.col("last_pos"), "crosses_cutoff").otherwise("eligible")
    )
    return joined.select("instrument_id", "d", reason.alias("reason"))
