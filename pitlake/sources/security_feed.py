"""The nested vendor feed of securities: one master and four histories, merged by natural key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitlake.sources import sinks

FEED = (
    "source string, data_version string, seq long, source_security_id string, security_type string, name string, share_class string, country string, currency string, primary_exchange string,"
    " first_trade_date date, last_trade_date date, active boolean, delisted boolean, delisting_date date, delisting_reason string,"
    " identifiers array<struct<identifier_type: string, identifier_value: string, valid_from: date, valid_to: date, exchange: string, is_primary: boolean>>,"
    " lifecycle_events array<struct<event_type: string, effective_date: date, announcement_date: date, successor_source_id: string, predecessor_source_id: string, details: string>>,"
    " delisting struct<delisting_date: date, delisting_code: string, delisting_reason: string, successor_source_id: string>,"
    " classifications array<struct<scheme: string, valid_from: date, valid_to: date, sector: string, industry_group: string, industry: string, sub_industry: string>>"
)
_OWN = "security_type string, share_class string, country string, currency string, primary_exchange string, first_trade_date date, last_trade_date date, active boolean, delisted boolean, delisting_date date, delisting_reason string"
#: Natural key and values of each table; ``data_version`` is the last that touched a row and no value.
TABLES: dict[str, tuple[str, str]] = {
    "master": ("security_id long", f"source string, source_security_id string, {_OWN}"),
    "identifiers": ("security_id long, identifier_type string, valid_from date", "identifier_value string, exchange string, valid_to date, is_primary boolean, source string"),
    "lifecycle": ("security_id long, event_type string, effective_date date", "announcement_date date, successor_id long, predecessor_id long, details string, source string"),
    "delistings": ("security_id long", "delisting_date date, delisting_code string, delisting_reason string, successor_id long, source string"),
    "classifications": ("security_id long, scheme string, valid_from date", "sector string, industry_group string, industry string, sub_industry string, valid_to date, source string"),
}
#: Identifiers that belong to one security for good.
PERMANENT = ("CUSIP", "ISIN", "FIGI")
FAR = "9999-12-31"


def names_of(fields: str) -> list[str]:
    return [f.split()[0] for f in fields.split(", ")]


def schema_of(table: str) -> str:
    return f"{TABLES[table][0]}, {TABLES[table][1]}, data_version string"


def empty_store(spark: SparkSession) -> dict[str, DataFrame]:
    return {t: spark.createDataFrame([], schema_of(t)) for t in TABLES}


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """A feed of JSON lines; ``seq`` is the place of a record in the vendor's order."""
    return spark.read.schema(FEED).json(path)


def security_id(source: Column, vendor_id: Column) -> Column:
    """60 bits of a digest of the vendor's permanent key: the same id on every run, without a counter."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", source, vendor_id)), 1, 15), 16, 10).cast("long")


def large(df: DataFrame) -> DataFrame:
    """``df``, to be joined by a shuffle: it grows with the feed, and what files hold packed is much larger on the driver."""
    return df.hint("merge")


def conflicts(feed: DataFrame, stored: DataFrame) -> DataFrame:
    """``seq, held_by``: records with a permanent identifier that another security holds over an interval that overlaps.

    A record meets what is stored after all accepted records before it, so an interval that an earlier record closes is
    free and one that a later record closes is not. Only identifiers of several owners are looked at. In each round the
    records that are first in all their islands of overlapping intervals are decided, without pairs of records; a round
    decides at least one record of every island, mostly all.
    """
    permanent = F.col("identifier_type").isin(*PERMANENT)
    rows = feed.select("seq", "security_id", F.inline("identifiers")).where(permanent).select("seq", "security_id", "identifier_type", "identifier_value", "valid_from", F.coalesce("valid_to", F.lit(FAR).cast("date")).alias("valid_to"))
    value, own = ["identifier_type", "identifier_value"], ["security_id", "identifier_type", "valid_from"]
    live = stored.where(permanent).select("security_id", *value, "valid_from", F.coalesce("valid_to", F.lit(FAR).cast("date")).alias("valid_to"))
    shared = rows.select(*value, "security_id").union(live.select(*value, "security_id")).groupBy(*value).agg(F.min("security_id").alias("a"), F.max("security_id").alias("b")).where("a <> b").select(*value)
    keep = lambda df, name: sinks.written(df, name)
    rows, live = keep(rows.join(large(shared), value, "left_semi"), "contested"), keep(live.join(large(shared), value, "left_semi"), "live")
    waiting, found = rows, None
    while not waiting.isEmpty():
        first = waiting.groupBy(*own).agg(F.min("seq").alias("seq"))
        both = waiting.select("seq", *value, "valid_from", "valid_to").union(live.join(large(first), own).select("seq", *value, "valid_from", "valid_to"))
        at = Window.partitionBy(*value).orderBy("valid_from", "valid_to", "seq")
        apart = F.col("valid_from") > F.max("valid_to").over(at.rowsBetween(Window.unboundedPreceding, -1))
        islands = both.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("island", F.sum("apart").over(at.rowsBetween(Window.unboundedPreceding, 0)))
        blocked = islands.withColumn("first", F.min("seq").over(Window.partitionBy(*value, "island"))).where("seq > first").select("seq").distinct()
        blocked = keep(blocked, "blocked")
        ready = waiting.join(large(blocked), "seq", "left_anti")
        held = live.select(F.col("security_id").alias("other"), *value, F.col("valid_from").alias("f"), F.col("valid_to").alias("t"))
        met = ready.join(large(held), value).where("other <> security_id and valid_from <= t and f <= valid_to")
        lost = keep(met.groupBy("seq").agg(F.min("other").alias("held_by")), "lost")
        won = ready.join(large(lost), "seq", "left_anti")
        last = won.withColumn("n", F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("seq"), F.desc("identifier_value")))).where("n = 1")
        live = keep(live.join(large(won.select(*own)), own, "left_anti").unionByName(last.select(*live.columns)), "live")
        waiting = keep(waiting.join(large(blocked), "seq", "left_semi"), "waiting")
        found = lost if found is None else found.union(lost)
    return feed.sparkSession.createDataFrame([], "seq long, held_by long") if found is None else found


def flatten(feed: DataFrame, known: DataFrame) -> dict[str, DataFrame]:
    """The rows of each table that the records bring, the last of each natural key; ``known`` are all (source, vendor id, id)."""
    base = [F.col("seq"), F.col("security_id"), F.col("source"), F.col("data_version")]
    of = lambda name: known.select("source", F.col("source_security_id").alias(f"{name}_source_id"), F.col("security_id").alias(f"{name}_id"))
    linked = lambda rows, name: rows.join(large(of(name)), ["source", f"{name}_source_id"], "left")
    rows = {
        "master": feed,
        "identifiers": feed.select(*base, F.inline("identifiers")),
        "lifecycle": linked(linked(feed.select(*base, F.inline("lifecycle_events")), "successor"), "predecessor"),
        "delistings": linked(feed.where("delisting is not null").select(*base, "delisting.*"), "successor"),
        "classifications": feed.select(*base, F.inline("classifications")),
    }
    out = {}
    for table, df in rows.items():
        key, values = (names_of(x) for x in TABLES[table])
        whole = df.select("seq", *key, *values, "data_version")
        order = Window.partitionBy(*key).orderBy(F.desc("seq"), *[F.desc(v) for v in values])
        out[table] = whole.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "seq")
    return out


def merged(table: str, incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """All rows of either side with ``change``: opened, closed, superseded, unchanged, or kept (not in the feed).

    A row is closed where only an open end was given a date. ``data_version`` moves only when the row changes.
    """
    key, values = (names_of(x) for x in TABLES[table])
    side = lambda df, s: df.select(*key, F.struct(*values, "data_version").alias(s))
    both = side(incoming, "i").join(side(stored, "s"), key, "full")
    same = lambda names: F.struct(*[F.col(f"i.{v}") for v in names]).eqNullSafe(F.struct(*[F.col(f"s.{v}") for v in names]))
    end = [v for v in values if v == "valid_to"]
    closed = same([v for v in values if v not in end]) & F.col("s.valid_to").isNull() if end else F.lit(False)
    change = F.when(F.col("i").isNull(), "kept").when(F.col("s").isNull(), "opened").when(same(values), "unchanged").when(closed, "closed").otherwise("superseded")
    rows = both.select(*key, F.when(change.isin("kept", "unchanged"), F.col("s")).otherwise(F.col("i")).alias("r"), change.alias("change"))
    return rows.select(*key, *[F.col(f"r.{v}").alias(v) for v in (*values, "data_version")], "change")


def ingest(feed: DataFrame, stored: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The merged tables, each with ``change``, and ``seq, entity, rule, detail`` of quarantined records.

    A record without its vendor's permanent id, or with a permanent identifier that another security holds over an
    overlapping interval, goes to quarantine with all its rows. Successors are looked up among everything stored or
    accepted, so a rerun of the same feed changes nothing.
    """
    feed = feed.withColumn("security_id", security_id(F.col("source"), F.col("source_security_id")))
    named = sinks.written(feed.where("source_security_id <> ''"), "feed")
    lost = conflicts(named, stored["identifiers"])
    accepted = named.join(large(lost), "seq", "left_anti")
    known = stored["master"].select("source", "source_security_id", "security_id").union(accepted.select("source", "source_security_id", "security_id")).distinct()
    tables = {t: merged(t, rows, stored[t]) for t, rows in flatten(accepted, known).items()}
    missing = feed.where("source_security_id is null or source_security_id = ''").select("seq", F.lit("<missing>").alias("entity"), F.lit("missing_permanent_id").alias("rule"), F.col("name").alias("detail"))
    ambiguous = named.join(large(lost), "seq").select("seq", F.col("source_security_id").alias("entity"), F.lit("ambiguous_identity").alias("rule"), F.concat(F.lit("also held by "), F.col("held_by").cast("string")).alias("detail"))
    return tables, missing.union(ambiguous)
