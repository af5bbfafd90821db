"""Data quality: rules as columns, quarantine, and comparison of fetched rows with stored ones."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pitlake.operators.features import own_days

#: The greatest plausible daily return, the length of a stale run, allowed gaps and periods in days by frequency.
MAX_RETURN, STALE_RUN = 0.40, 5
GAP_DAYS = {"D": 10, "W": 21, "M": 45, "Q": 120}
PERIOD_DAYS = {"D": 1, "W": 7, "M": 31, "Q": 92}
ERRORS = ("duplicate_date", "nonpositive_close", "ohlc_incoherent", "negative_volume", "return_jump")


def by_frequency(days: dict[str, int]) -> Column:
    return F.coalesce(*[F.when(F.col("frequency") == f, n) for f, n in days.items()])


def price_rules(raw: DataFrame) -> DataFrame:
    """``raw`` (with ``seq``, the order of arrival) and a flag per rule that looks at a row alone or its date."""
    ok = F.col("close") > 0
    bad = (F.col("high") < F.col("low")) | (F.col("open") < F.col("low")) | (F.col("open") > F.col("high")) | (F.col("close") < F.col("low")) | (F.col("close") > F.col("high"))
    nth = F.row_number().over(Window.partitionBy("instrument_id", "d").orderBy("seq"))
    return raw.select(
        "*", (nth > 1).alias("duplicate_date"), (~F.coalesce(ok, F.lit(False))).alias("nonpositive_close"), F.coalesce(ok & bad, F.lit(False)).alias("ohlc_incoherent"),
        F.coalesce(F.col("volume") < 0, F.lit(False)).alias("negative_volume"), F.coalesce(F.col("volume") == 0, F.lit(False)).alias("zero_volume"),
    )


def return_jumps(clean: DataFrame, splits: DataFrame, limit: float = MAX_RETURN) -> DataFrame:
    """Rows whose return on the last *accepted* close is over the limit on a date without a split.

    A rejected row does not become the previous close, so the rule is a fold in order of the days. The rows of an
    instrument are sorted in one partition and streamed; the fold carries one number, whatever the history's length.
    """
    schema = "instrument_id long, d date, close double, previous double"
    out = to_arrow_schema(T._parse_datatype_string(schema))
    marked = clean.join(splits.select("instrument_id", "d", F.lit(True).alias("split")), ["instrument_id", "d"], "left")
    rows = marked.select(F.col("instrument_id").cast("long").alias("instrument_id"), "d", F.col("close").cast("double").alias("close"), F.coalesce("split", F.lit(False)).alias("split"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        instrument, last = None, None
        for b in batches:
            at, previous = [], []
            for n, (i, close, split) in enumerate(zip(*(b.column(c).to_pylist() for c in ("instrument_id", "close", "split")), strict=True)):
                if i != instrument:
                    instrument, last = i, None
                if close is None:
                    continue
                if last and not split and abs(close / last - 1) > limit:
                    at.append(n)
                    previous.append(last)
                else:
                    last = close
            part = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("instrument_id"), part.column("d"), part.column("close"), pa.array(previous, pa.float64())], schema=out)

    return rows.repartition("instrument_id").sortWithinPartitions("instrument_id", "d").mapInArrow(run, schema)


def stale_runs(px: DataFrame, least: int = STALE_RUN) -> DataFrame:
    """Runs of equal consecutive closes."""
    island = px.withColumn("_new", (~F.col("close").eqNullSafe(F.lag("close").over(own_days()))).cast("int")).withColumn("_run", F.sum("_new").over(own_days()))
    runs = island.groupBy("instrument_id", "_run").agg(F.min("d").alias("from_d"), F.max("d").alias("to_d"), F.count("*").alias("length"))
    return runs.where(F.col("length") >= least).drop("_run")


def calendar_gaps(px: DataFrame, calendar: DataFrame) -> DataFrame:
    """Trading days that an instrument lacks between its first day and the newest expected one, which is forgiven."""
    newest = calendar.agg(F.max("d").alias("newest"))
    span = px.groupBy("instrument_id").agg(F.min("d").alias("first"))
    expected = span.join(F.broadcast(calendar.select("d").crossJoin(newest)), (F.col("d") >= F.col("first")) & (F.col("d") < F.col("newest"))).select("instrument_id", "d")
    return expected.join(px.select("instrument_id", "d"), ["instrument_id", "d"], "left_anti")


def macro_gaps(mo: DataFrame, shown: int = 10) -> DataFrame:
    """Per series the gaps over its allowance: how many, and the first ones."""
    w = Window.partitionBy("code").orderBy("obs_date")
    gaps = mo.withColumn("_prev", F.lag("obs_date").over(w)).where(F.datediff("obs_date", "_prev") > by_frequency(GAP_DAYS))
    firsts = F.array_join(F.transform(F.slice(F.sort_array(F.collect_list("obs_date")), 1, shown), lambda d: d.cast("string")), ",")
    return gaps.groupBy("code").agg(F.count("*").alias("n_gaps"), firsts.alias("first_gaps"))


def quarantine(flagged: DataFrame, errors: tuple[str, ...]) -> DataFrame:
    """Rows with the first error rule that they break, null for valid ones."""
    found = F.filter(F.array(*[F.when(F.col(e), e) for e in errors]), lambda r: r.isNotNull())
    return flagged.withColumn("rule", F.try_element_at(found, F.lit(1)))


def material(old: Column, new: Column) -> Column:
    """A change beyond max(2e-6, 1e-5 |old|); null against a value always counts."""
    return ~old.eqNullSafe(new) & F.coalesce(F.abs(new - old) > F.greatest(F.lit(2e-6), F.abs(old) * 1e-5), F.lit(True))


def revisions(stored: DataFrame, fetched: DataFrame, keys: list[str], fields: list[str], exact: tuple[str, ...] = ()) -> DataFrame:
    """Field-level differences of re-fetched rows: (keys, field, old, new)."""
    both = stored.select(*keys, *[F.col(f).cast("double").alias(f"_o_{f}") for f in fields]).join(fetched.select(*keys, *[F.col(f).cast("double").alias(f"_n_{f}") for f in fields]), keys)
    changed = F.array(*[
        F.when(~F.col(f"_o_{f}").eqNullSafe(F.col(f"_n_{f}")) if f in exact else material(F.col(f"_o_{f}"), F.col(f"_n_{f}")), F.struct(F.lit(f).alias("field"), F.col(f"_o_{f}").alias("old"), F.col(f"_n_{f}").alias("new")))
        for f in fields
    ])
    return both.select(*keys, F.inline(F.filter(changed, lambda x: x.isNotNull())))


def refresh_needed(revised: DataFrame, fetched: DataFrame, new_splits: DataFrame) -> DataFrame:
    """Instruments whose adjusted close moved while the raw one didn't, before the newest fetched day, or with a new split."""
    newest = fetched.groupBy("instrument_id").agg(F.max("d").alias("newest"))
    moved = revised.groupBy("instrument_id", "d").agg(F.bool_or(F.col("field") == "adj").alias("adj"), F.bool_or(F.col("field") == "close").alias("raw"))
    tripped = moved.join(newest, "instrument_id").where(F.col("adj") & ~F.col("raw") & (F.col("d") < F.col("newest"))).select("instrument_id")
    return tripped.union(new_splits.select("instrument_id")).distinct()


def raw_shift_guard(stored: DataFrame, fetched: DataFrame, new_splits: DataFrame, least: int = 5, share: float = 0.5) -> DataFrame:
    """Instruments to reject: most raw closes shifted and no new split explains it."""
    both = stored.select("instrument_id", "d", F.col("close").alias("_o")).join(fetched.select("instrument_id", "d", F.col("close").alias("_n")), ["instrument_id", "d"])
    counted = both.groupBy("instrument_id").agg(F.count("*").alias("compared"), F.count_if(material(F.col("_o"), F.col("_n"))).alias("shifted"))
    return counted.where((F.col("compared") >= least) & (F.col("shifted") > share * F.col("compared"))).join(new_splits.select("instrument_id").distinct(), "instrument_id", "left_anti")


def append_on_change(incoming: DataFrame, stored: DataFrame, keys: list[str], order: str, state: list[str]) -> DataFrame:
    """Incoming rows whose state differs from the latest stored one of their key."""
    latest = stored.groupBy(*keys).agg(F.max_by(F.struct(*state), order).alias("_last"))
    return incoming.join(latest, keys, "left").where(~F.struct(*state).eqNullSafe(F.col("_last"))).drop("_last")
