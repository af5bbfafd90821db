"""Vendor rows resolved to securities at ingest, and the quality rules of what was stored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlake.operators import pit

FAR = "9999-12-31"
#: Fixed value: the rule of a terminal event whose outcome the vendor does not know.
UNKNOWN = "unknown"


def holders(identifiers: DataFrame, kind: str = "TICKER") -> DataFrame:
    """``vendor_id, since, holder, holding``: from ``since`` on, so many securities hold the identifier; ``holder`` if it is one.

    Starts and ends of the intervals (end exclusive) are summed up in order, so intervals of one value are never paired.
    """
    rows = identifiers.where(F.col("identifier_type") == kind).select(F.col("identifier_value").alias("vendor_id"), "security_id", "valid_from", F.coalesce("valid_to", F.lit(FAR).cast("date")).alias("valid_to"))
    own = Window.partitionBy("vendor_id", "security_id").orderBy("valid_from", "valid_to")
    apart = F.col("valid_from") > F.max("valid_to").over(own.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.where("valid_from < valid_to").withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int"))
    rows = rows.withColumn("run", F.sum("apart").over(own.rowsBetween(Window.unboundedPreceding, 0))).groupBy("vendor_id", "security_id", "run").agg(F.min("valid_from").alias("valid_from"), F.max("valid_to").alias("valid_to"))
    wide = F.col("security_id").cast("decimal(38,0)")
    steps = rows.select("vendor_id", F.col("valid_from").alias("since"), F.lit(1).alias("n"), wide.alias("id")).union(rows.select("vendor_id", "valid_to", F.lit(-1), -wide))
    days = steps.groupBy("vendor_id", "since").agg(F.sum("n").alias("n"), F.sum("id").cast("decimal(38,0)").alias("id"))
    upto = Window.partitionBy("vendor_id").orderBy("since").rowsBetween(Window.unboundedPreceding, 0)
    sums = days.select("vendor_id", "since", F.sum("n").over(upto).alias("holding"), F.sum("id").over(upto).alias("id"))
    return sums.select("vendor_id", "since", F.when(F.col("holding") == 1, F.col("id").cast("long")).alias("holder"), "holding")


def resolve(rows: DataFrame, master: DataFrame, identifiers: DataFrame, day: str) -> DataFrame:
    """``rows`` (``source, vendor_id``, a day) with ``security_id`` and ``problem``.

    A vendor's permanent id counts first, on any day; what is none is a ticker and belongs to the one security that held
    it on the row's day. No holder is ``unresolved_security``, several are ``ambiguous_security``.
    """
    known = master.select("source", F.col("source_security_id").alias("vendor_id"), F.col("security_id").alias("by_id"))
    joined = rows.join(known.hint("merge"), ["source", "vendor_id"], "left")  # the master grows with the feed
    found = pit.asof(joined, holders(identifiers), ["vendor_id"], day, "since", ["holder", "holding"])
    problem = F.when(F.col("by_id").isNotNull(), F.lit(None)).when(F.col("holding") > 1, "ambiguous_security").when(F.col("holder").isNull(), "unresolved_security")
    return found.withColumns({"security_id": F.coalesce("by_id", "holder"), "problem": problem}).drop("by_id", "holder", "holding")


def terminal_state(rows: DataFrame) -> DataFrame:
    """Resolved terminals with ``state``: a vendor's unknown outcome without any value is unresolved, never a total loss."""
    open_end = ~F.coalesce("resolved", F.lit(False)) | ((F.col("rule") == UNKNOWN) & F.col("terminal_return").isNull() & F.col("terminal_value").isNull())
    last = Window.partitionBy("security_id").orderBy(F.desc("event_date"), F.desc("rule"))
    return rows.withColumn("state", F.when(open_end, "unresolved").otherwise("resolved")).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def findings(domain: str, rules: dict[str, DataFrame]) -> DataFrame:
    """``domain, rule, entity, detail`` of all rules; each frame has ``entity`` and ``detail``."""
    named = [df.select(F.lit(domain).alias("domain"), F.lit(rule).alias("rule"), F.col("entity").cast("string").alias("entity"), F.col("detail").cast("string").alias("detail")) for rule, df in rules.items()]
    return reduce(DataFrame.unionByName, named)


def _flagged(rows: DataFrame, checks: dict[str, tuple[Column, Column]], entity: Column, domain: str) -> DataFrame:
    """One pass over ``rows``: a finding for every check that holds."""
    hits = F.array(*[F.when(test, F.struct(F.lit(rule.split(":")[0]).alias("rule"), detail.cast("string").alias("detail"))) for rule, (test, detail) in checks.items()])
    return rows.select(entity.cast("string").alias("entity"), F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h")).select(F.lit(domain).alias("domain"), "h.rule", "entity", "h.detail")


def _dated(day: str) -> Column:
    return F.concat_ws("/", F.col("security_id").cast("string"), F.col(day).cast("string"))


def check_prices(bars: DataFrame, terminals: DataFrame) -> DataFrame:
    """Six rules of stored bars: repeated days, negative closes, impossible ranges, missing lineage, trading after the end."""
    joined = bars.join(terminals.select("security_id", "event_date"), "security_id", "left")
    outside = lambda c: ~F.col(c).between(F.col("low"), F.col("high"))
    checks = {
        "negative_price": (F.col("close") < 0, F.lit("close<0")),
        "impossible_ohlc": (F.col("high") < F.col("low"), F.lit("high<low")),
        "ohlc_out_of_range:open": (outside("open"), F.lit("open outside [low,high]")),
        "ohlc_out_of_range:close": (outside("close"), F.lit("close outside [low,high]")),
        "missing_lineage": (F.coalesce("source", F.lit("")) == "", F.lit("no source")),
        "trading_after_terminal": (F.col("trade_date") > F.col("event_date"), F.concat(F.lit("after terminal "), F.col("event_date").cast("string"))),
    }
    repeated = bars.groupBy("security_id", "trade_date").agg(F.count("*").alias("n")).where("n > 1").select(_dated("trade_date").alias("entity"), F.concat(F.col("n").cast("string"), F.lit(" rows")).alias("detail"))
    return _flagged(joined, checks, _dated("trade_date"), "prices").unionByName(findings("prices", {"duplicate_security_date": repeated}))


def check_returns(returns: DataFrame, terminals: DataFrame) -> DataFrame:
    """Two rules of daily returns: a delisting return needs its event, an unresolved one has no value."""
    ends = terminals.select("security_id", F.lit(True).alias("ended")).distinct()
    checks = {
        "delisting_return_without_event": ((F.col("status") == "delisting") & F.col("ended").isNull(), F.lit("no terminal_outcome")),
        "unresolved_with_value": ((F.col("status") == "unresolved") & F.col("ret").isNotNull(), F.lit("unresolved but total_return set")),
    }
    return _flagged(returns.join(ends, "security_id", "left"), checks, _dated("d"), "returns")


def check_forward(rows: DataFrame, delistings: DataFrame) -> DataFrame:
    """Four rules of forward outcomes: order of days, delistings inside the window, identity world, snapshot checksum."""
    joined = rows.join(delistings.select("security_id", "delisting_date"), "security_id", "left")
    inside = (F.col("entry") <= F.col("delisting_date")) & (F.col("delisting_date") <= F.coalesce("exit", "delisting_date"))
    checks = {
        "exit_before_entry": (F.col("exit") < F.col("entry"), F.lit("exit<entry")),
        "delisting_in_window_untreated": (inside & (F.col("status") == "normal"), F.concat(F.lit("delisted "), F.col("delisting_date").cast("string"), F.lit(" but status normal"))),
        "non_native_outcome": (~F.col("world").eqNullSafe("native_security"), F.lit("outcome not native")),
        "missing_snapshot_checksum": (F.coalesce("checksum", F.lit("")) == "", F.lit("no checksum")),
    }
    return _flagged(joined, checks, _dated("as_of"), "forward")


def check_master(store: dict[str, DataFrame]) -> DataFrame:
    """Four rules of the security master: shared identifiers, delisted without event, delisted before listed, late classes.

    A finding of the first rule is a pair of securities that held one value over overlapping intervals (both ends count);
    only values of several owners meet at all.
    """
    name = F.concat(F.lit("security_id="), F.col("security_id").cast("string")).alias("entity")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).alias("detail")
    value = ["identifier_type", "identifier_value"]
    several = store["identifiers"].groupBy(*value).agg(F.min("security_id").alias("x"), F.max("security_id").alias("y")).where("x <> y").select(*value)
    ident = store["identifiers"].join(several, value, "left_semi").select(*value, "security_id", "valid_from", F.coalesce("valid_to", F.lit(FAR).cast("date")).alias("until"))
    a, b = (ident.select(*value, F.col("security_id").alias(x), F.col("valid_from").alias(f"f{x}"), F.col("until").alias(f"t{x}")) for x in "ab")
    pairs = a.join(b, value).where("a < b and fa <= tb and fb <= ta").select(*value, "a", "b").distinct()
    shared = pairs.select(F.concat_ws("=", *value).alias("entity"), say("held by security_id ", F.col("a"), " and ", F.col("b"), " over overlapping intervals"))
    master = store["master"]
    events = store["delistings"].select("security_id", F.col("delisting_date").alias("event_date"))
    joined = master.join(events, "security_id", "left")
    late = store["classifications"].select("security_id", "valid_from").join(master.select("security_id", "delisting_date"), "security_id").where("valid_from > delisting_date")
    return findings("security-master", {
        "identifier_shared_over_overlap": shared,
        "delisted_without_event": joined.where("delisted and event_date is null").select(name, F.lit("delisted_flag=true but no delisting_event").alias("detail")),
        "delisting_before_listing": joined.where("event_date < first_trade_date").select(name, say("delisted ", F.col("event_date"), " < first_trade ", F.col("first_trade_date"))),
        "classification_after_delisting": late.select(name, say("classification valid_from ", F.col("valid_from"), " > delisting ", F.col("delisting_date"))),
    })
