"""Queries of the nested security feed and of what is resolved by it; parts stand for the vendor's securities.

The feed has two versions, and the second comes twice: version 1 lacks every fifth security, version 2 has all in reverse
order, closes intervals and adds delistings. ``sacc`` in SQL decides record by record, in the feed's order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlake.operators import native
from pitlake.plans.registry import CTE, Tables, query
from pitlake.plans.security_queries import outcomes, terminals
from pitlake.sources import panel, security_feed, sinks

_ID = lambda vid: f"CAST('0x' || substr(md5('vendor|' || {vid}), 1, 15) AS BIGINT)"
CTE["pt"] = ((), "SELECT CAST(l_partkey AS BIGINT) AS p, min(CAST(l_shipdate AS DATE)) AS first, max(CAST(l_shipdate AS DATE)) AS last FROM lineitem GROUP BY 1")
CTE["sfeed"] = (
    ("pt",),
    "SELECT ver, p, CASE WHEN ver = 1 THEN p ELSE 100000000 - p END AS seq, CASE WHEN p % 97 <> 0 THEN 'P' || p END AS vid, first, last, CASE WHEN p % 9 = 2 THEN 'etf' ELSE 'common' END AS kind,"
    " CASE WHEN ver > 1 AND p % 10 = 3 THEN 'AMEX' WHEN p % 2 = 0 THEN 'NYSE' ELSE 'NASDAQ' END AS venue, CASE WHEN p % 14 = 3 OR (ver > 1 AND p % 7 = 3) THEN last + 30 END AS gone,"
    " DATE '1992-01-01' + CAST(p * 37 % 1500 AS INTEGER) AS figi_from FROM pt CROSS JOIN (VALUES (1), (2), (3)) v(ver) WHERE ver > 1 OR p % 5 <> 4",
)
CTE["figi"] = (("sfeed",), "SELECT *, CASE WHEN ver > 1 AND p % 3 = 0 THEN figi_from + 100 WHEN p % 4 <> 1 THEN figi_from + 300 + CAST(p * 11 % 900 AS INTEGER) END AS figi_to FROM sfeed WHERE vid IS NOT NULL")
CTE["sdec"] = (
    ("figi",),
    "WITH RECURSIVE o AS (SELECT ver, p, seq, p // 4 AS g, figi_from AS f, coalesce(figi_to, DATE '9999-12-31') AS t, row_number() OVER (PARTITION BY p // 4 ORDER BY ver, seq) AS n FROM figi),"
    " r AS (SELECT DISTINCT g, 0::BIGINT AS n, []::STRUCT(p BIGINT, f DATE, t DATE)[] AS live, NULL::INTEGER AS ver, NULL::BIGINT AS p, false AS lost FROM o UNION ALL"
    " SELECT g, n, CASE WHEN lost THEN live ELSE list_append(list_filter(live, lambda x: NOT (x.p = p AND x.f = f)), {'p': p, 'f': f, 't': t}) END, ver, p, lost FROM"
    " (SELECT r.g, o.n, r.live, o.ver, o.p, o.f, o.t, len(list_filter(r.live, lambda x: x.p <> o.p AND o.f <= x.t AND x.f <= o.t)) > 0 AS lost FROM r JOIN o ON o.g = r.g AND o.n = r.n + 1))"
    " SELECT ver, p, lost FROM r WHERE p IS NOT NULL",
)
CTE["sacc"] = (("figi", "sdec"), f"SELECT f.*, {_ID('vid')} AS sid FROM figi f JOIN sdec d ON d.ver = f.ver AND d.p = f.p AND NOT lost")
_N = lambda c: f"coalesce(CAST({c} AS VARCHAR), '-')"
_SUCC = "CASE WHEN (SELECT bool_or(k.p = s.p + 1) FROM sacc k WHERE k.ver <= s.ver AND k.p = s.p + 1) THEN " + _ID("'P' || (s.p + 1)") + " END"
#: Rows of all tables: key and values as text, and the open end apart, for which a closed interval is known.
CTE["srow"] = (
    ("sacc",),
    f"SELECT ver, 'master' AS tbl, sid, '' AS k, concat_ws('|', vid, kind, venue, CAST(first AS VARCHAR), CAST(last AS VARCHAR), CAST(gone IS NULL AS VARCHAR), CAST(gone IS NOT NULL AS VARCHAR), {_N('gone')}) AS v, '-' AS until FROM sacc"
    f" UNION ALL SELECT ver, 'identifiers', sid, 'TICKER|' || first, 'T' || p, {_N('CASE WHEN p % 6 = 1 THEN first + 200 WHEN ver > 1 AND p % 6 = 2 THEN first + 300 END')} FROM sacc"
    " UNION ALL SELECT ver, 'identifiers', sid, 'TICKER|' || (first + 200), 'N' || p, '-' FROM sacc WHERE p % 6 = 1"
    " UNION ALL SELECT ver, 'identifiers', sid, 'TICKER|' || (first + 250), 'T' || (p - 4), '-' FROM sacc WHERE p % 6 = 5"
    f" UNION ALL SELECT ver, 'identifiers', sid, 'FIGI|' || figi_from, 'F' || (p // 4), {_N('figi_to')} FROM sacc"
    " UNION ALL SELECT ver, 'lifecycle', sid, 'ticker_changed|' || (first + 200), (first + 190) || '|-', '-' FROM sacc WHERE p % 6 = 1"
    f" UNION ALL SELECT ver, 'lifecycle', sid, 'acquired|' || gone, '-|' || {_N(_SUCC)}, '-' FROM sacc s WHERE gone IS NOT NULL"
    f" UNION ALL SELECT ver, 'delistings', sid, '', gone || '|' || {_N(_SUCC)}, '-' FROM sacc s WHERE gone IS NOT NULL"
    f" UNION ALL SELECT ver, 'classifications', sid, 'GICS|' || first, 'S' || (p % 11), {_N('CASE WHEN p % 8 = 0 THEN first + 500 END')} FROM sacc"
    " UNION ALL SELECT ver, 'classifications', sid, 'GICS|' || (first + 500), 'S' || (p % 11 + 1), '-' FROM sacc WHERE p % 8 = 0",
)
CTE["schg"] = (
    ("srow",),
    "SELECT *, CASE WHEN pv IS NULL THEN 'opened' WHEN pv = v AND pu = until THEN 'unchanged' WHEN pv = v AND pu = '-' THEN 'closed' ELSE 'superseded' END AS change FROM (SELECT *, lag(v) OVER w AS pv, lag(until) OVER w AS pu FROM srow WINDOW w AS (PARTITION BY tbl, sid, k ORDER BY ver))",
)


def parts(t: Tables) -> DataFrame:
    return t.table("lineitem").groupBy(F.col("l_partkey").cast("long").alias("p")).agg(F.min(F.to_date("l_shipdate")).alias("first"), F.max(F.to_date("l_shipdate")).alias("last"))


def feed(rows: DataFrame, version: int) -> DataFrame:
    """The vendor's records of ``parts`` in one version of the feed."""
    p, first, later, none = F.col("p"), F.col("first"), version > 1, F.lit(None)
    text = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    day = lambda base, n: F.date_add(base, n if isinstance(n, int) else n.cast("int"))
    ident = lambda kind, value, start, end: F.struct(F.lit(kind).alias("identifier_type"), value.alias("identifier_value"), start.alias("valid_from"), end.cast("date").alias("valid_to"), none.cast("string").alias("exchange"), F.lit(kind == "TICKER").alias("is_primary"))
    event = lambda kind, on, told, successor: F.struct(F.lit(kind).alias("event_type"), on.alias("effective_date"), told.cast("date").alias("announcement_date"), successor.cast("string").alias("successor_source_id"), none.cast("string").alias("predecessor_source_id"), none.cast("string").alias("details"))
    sector = lambda n, start, end: F.struct(F.lit("GICS").alias("scheme"), start.alias("valid_from"), end.cast("date").alias("valid_to"), text("S", n).alias("sector"), *[none.cast("string").alias(c) for c in ("industry_group", "industry", "sub_industry")])
    some = lambda *items: F.filter(F.array(*items), lambda x: x.isNotNull())
    gone = F.when((p % 14 == 3) | (F.lit(later) & (p % 7 == 3)), day(F.col("last"), 30))
    figi = day(F.lit("1992-01-01").cast("date"), p * 37 % 1500)
    figi_end = F.when(F.lit(later) & (p % 3 == 0), day(figi, 100)).when(p % 4 != 1, day(figi, 300 + p * 11 % 900))
    ticker_end = F.when(p % 6 == 1, day(first, 200)).when(F.lit(later) & (p % 6 == 2), day(first, 300))
    records = rows if later else rows.where("p % 5 <> 4")
    return records.select(
        F.lit("vendor").alias("source"), F.lit(f"v{min(version, 2)}").alias("data_version"), (F.lit(100000000) - p if later else p).alias("seq"), F.when(p % 97 != 0, text("P", p)).alias("source_security_id"),
        F.when(p % 9 == 2, "etf").otherwise("common").alias("security_type"), text("Part ", p).alias("name"), F.lit("US").alias("country"), F.lit("USD").alias("currency"),
        F.when(F.lit(later) & (p % 10 == 3), "AMEX").when(p % 2 == 0, "NYSE").otherwise("NASDAQ").alias("primary_exchange"), first.alias("first_trade_date"), F.col("last").alias("last_trade_date"),
        gone.isNull().alias("active"), gone.isNotNull().alias("delisted"), gone.alias("delisting_date"),
        some(ident("TICKER", text("T", p), first, ticker_end), F.when(p % 6 == 1, ident("TICKER", text("N", p), day(first, 200), none)), F.when(p % 6 == 5, ident("TICKER", text("T", p - 4), day(first, 250), none)), ident("FIGI", text("F", F.floor(p / 4)), figi, figi_end)).alias("identifiers"),
        some(F.when(p % 6 == 1, event("ticker_changed", day(first, 200), day(first, 190), none)), F.when(gone.isNotNull(), event("acquired", gone, none, text("P", p + 1)))).alias("lifecycle_events"),
        F.when(gone.isNotNull(), F.struct(gone.alias("delisting_date"), text("P", p + 1).alias("successor_source_id"))).alias("delisting"),
        some(sector(p % 11, first, F.when(p % 8 == 0, day(first, 500))), F.when(p % 8 == 0, sector(p % 11 + 1, day(first, 500), none))).alias("classifications"),
    )


def ingested(t: Tables, versions: int = 3) -> tuple[dict[str, DataFrame], dict[int, DataFrame], dict[int, dict[str, DataFrame]]]:
    """The store after the versions of the feed, and the quarantine and merged tables of each."""
    rows, store, held, steps = parts(t), security_feed.empty_store(t.spark), {}, {}
    for version in range(1, versions + 1):
        path = sinks.scratch(t.spark, "feed")
        feed(rows, version).write.json(path)
        tables, held[version] = security_feed.ingest(security_feed.read_feed(t.spark, path), store)
        steps[version] = {name: sinks.written(df, f"security_{name}") for name, df in tables.items()}
        store = {name: df.drop("change") for name, df in steps[version].items()}
    return store, held, steps


def as_text(name: str, df: DataFrame, *more: str) -> DataFrame:
    """Rows of one table with their keys and values as text."""
    n = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    say: dict[str, tuple[Column, Column, Column]] = {
        "master": (F.lit(""), F.concat_ws("|", "source_security_id", "security_type", "primary_exchange", F.col("first_trade_date").cast("string"), F.col("last_trade_date").cast("string"), F.col("active").cast("string"), F.col("delisted").cast("string"), n("delisting_date")), F.lit("-")),
        "identifiers": (F.concat_ws("|", "identifier_type", F.col("valid_from").cast("string")), F.col("identifier_value"), n("valid_to")),
        "lifecycle": (F.concat_ws("|", "event_type", F.col("effective_date").cast("string")), F.concat_ws("|", n("announcement_date"), n("successor_id")), F.lit("-")),
        "delistings": (F.lit(""), F.concat_ws("|", F.col("delisting_date").cast("string"), n("successor_id")), F.lit("-")),
        "classifications": (F.concat_ws("|", "scheme", F.col("valid_from").cast("string")), F.col("sector"), n("valid_to")),
    }
    k, v, until = say[name]
    return df.select(F.lit(name).alias("tbl"), F.col("security_id").alias("sid"), k.alias("k"), v.alias("v"), until.alias("until"), *more)


query(
    "src_security_master",
    "schg sfeed sdec",
    "SELECT tbl, sid, k, v, until, CASE WHEN changed = 1 THEN 'v1' ELSE 'v2' END AS data_version FROM (SELECT *, max(CASE WHEN change <> 'unchanged' THEN ver END) OVER (PARTITION BY tbl, sid, k) AS changed, row_number() OVER (PARTITION BY tbl, sid, k ORDER BY ver DESC) AS n FROM schg) WHERE n = 1"
    " UNION ALL SELECT 'quarantine', p, 'v' || ver, CASE WHEN vid IS NULL THEN 'missing_permanent_id' ELSE 'ambiguous_identity' END, coalesce(vid, '<missing>'), '-' FROM sfeed LEFT JOIN sdec USING (ver, p) WHERE vid IS NULL OR lost",
)(lambda t: _store_rows(*ingested(t)[:2]))
query("src_security_changes", "schg", "SELECT ver, tbl, change, count(*) AS n FROM schg GROUP BY ALL UNION ALL SELECT v.ver, tbl, 'kept', count(*) FROM (SELECT tbl, sid, k, min(ver) AS since, list(ver) AS vers FROM srow GROUP BY 1, 2, 3) x JOIN (VALUES (1), (2), (3)) v(ver) ON v.ver > since AND NOT list_contains(vers, v.ver) GROUP BY 1, 2")(
    lambda t: reduce(DataFrame.union, [df.groupBy(F.lit(ver).alias("ver"), F.lit(name).alias("tbl"), "change").agg(F.count("*").alias("n")) for ver, tables in ingested(t)[2].items() for name, df in tables.items()])
)


def _store_rows(store: dict[str, DataFrame], held: dict[int, DataFrame]) -> DataFrame:
    rows = [as_text(name, df, "data_version") for name, df in store.items()]
    part = lambda ver: F.col("seq") if ver == 1 else 100000000 - F.col("seq")
    rows += [q.select(F.lit("quarantine").alias("tbl"), part(ver).alias("sid"), F.lit(f"v{ver}").alias("k"), F.col("rule").alias("v"), F.col("entity").alias("until"), F.lit("-").alias("data_version")) for ver, q in held.items()]
    return reduce(DataFrame.unionByName, rows)


# Native outcomes: vendor rows of parts, every fourth part named by its ticker.
VENDOR = "CASE WHEN p % 4 = 0 THEN 'T' || p WHEN p % 24 = 13 THEN 'T' || p ELSE 'P' || p END"
CTE["sid1"] = (("srow",), "SELECT DISTINCT v.vid AS vendor_id, v.sid FROM (SELECT split_part(v, '|', 1) AS vid, sid FROM srow WHERE tbl = 'master') v")
CTE["tick"] = (
    ("schg",),
    "SELECT v AS vendor_id, sid, CAST(split_part(k, '|', 2) AS DATE) AS f, coalesce(TRY_CAST(until AS DATE), DATE '9999-12-31') AS u FROM (SELECT *, row_number() OVER (PARTITION BY sid, k ORDER BY ver DESC) AS n FROM schg WHERE tbl = 'identifiers' AND k LIKE 'TICKER%') WHERE n = 1",
)
CTE["lp"] = ((), "SELECT CAST(l_partkey AS BIGINT) AS p, CAST(l_shipdate AS DATE) AS d, l_orderkey, l_linenumber, l_extendedprice, l_quantity FROM lineitem")
CTE["vrow"] = (
    ("lp",),
    f"SELECT 'price' AS feed, {VENDOR} AS vendor_id, p, d, close AS value, open, high, low, bar, NULL AS rule FROM (SELECT p, d, l_orderkey * 10 + l_linenumber AS bar, CASE WHEN l_linenumber = 7 THEN -l_extendedprice / l_quantity ELSE l_extendedprice / l_quantity END AS close, l_extendedprice / l_quantity AS open, CASE WHEN l_linenumber = 6 THEN 0.5 ELSE 1.0 END * l_extendedprice / l_quantity AS high, 0.99 * l_extendedprice / l_quantity AS low FROM lp)"
    f" UNION ALL SELECT 'market_snapshot', {VENDOR}, p, d, cap, NULL, NULL, NULL, NULL, NULL FROM (SELECT p, CAST(date_trunc('month', d) AS DATE) + 14 AS d, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,6))) AS DOUBLE) AS cap FROM lp GROUP BY 1, 2)"
    f" UNION ALL SELECT 'terminal', {VENDOR}, p, d, CASE WHEN p % 3 = 0 THEN -0.3 END, NULL, NULL, NULL, NULL, CASE WHEN p % 7 = 3 THEN 'cash_acquisition' WHEN p % 35 = 5 THEN 'unknown' ELSE 'bankruptcy' END FROM (SELECT p, max(d) - 60 AS d FROM lp GROUP BY 1) WHERE p % 7 IN (3, 5)",
)
CTE["vres"] = (
    ("vrow", "sid1", "tick"),
    "SELECT v.*, coalesce(s.sid, CASE WHEN h.n = 1 THEN h.sid END) AS security_id, CASE WHEN s.sid IS NOT NULL OR h.n = 1 THEN NULL WHEN h.n > 1 THEN 'ambiguous_security' ELSE 'unresolved_security' END AS problem FROM vrow v LEFT JOIN sid1 s USING (vendor_id)"
    " LEFT JOIN (SELECT vendor_id, d, count(DISTINCT sid) AS n, min(sid) AS sid FROM (SELECT DISTINCT vendor_id, d FROM vrow) JOIN tick USING (vendor_id) WHERE f <= d AND d < u GROUP BY 1, 2) h USING (vendor_id, d)",
)


def vendor_rows(t: Tables) -> dict[str, DataFrame]:
    """Prices, market snapshots and terminals as the vendor sends them."""
    p, price = F.col("p"), F.col("l_extendedprice") / F.col("l_quantity")
    text = lambda prefix: F.concat(F.lit(prefix), p.cast("string"))
    vendor = (F.lit("vendor").alias("source"), F.when((p % 4 == 0) | (p % 24 == 13), text("T")).otherwise(text("P")).alias("vendor_id"))
    lines = t.table("lineitem").select(F.col("l_partkey").cast("long").alias("p"), F.to_date("l_shipdate").alias("d"), "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    n = F.col("l_linenumber")
    prices = lines.select(*vendor, "p", "d", F.when(n == 7, -price).otherwise(price).alias("close"), price.alias("open"), (F.when(n == 6, 0.5).otherwise(1.0) * F.col("l_extendedprice") / F.col("l_quantity")).alias("high"), (0.99 * F.col("l_extendedprice") / F.col("l_quantity")).alias("low"), (F.col("l_orderkey") * 10 + n).alias("bar"))
    caps = lines.groupBy("p", F.date_add(F.trunc("d", "month"), 14).alias("d")).agg(F.sum(F.col("l_extendedprice").cast(panel.DEC)).cast("double").alias("market_cap"))
    ends = lines.groupBy("p").agg(F.date_sub(F.max("d"), 60).alias("d")).where("p % 7 in (3, 5)")
    rule = F.when(p % 7 == 3, "cash_acquisition").when(p % 35 == 5, native.UNKNOWN).otherwise("bankruptcy")
    return {"price": prices, "market_snapshot": caps.select(*vendor, "p", "d", "market_cap"), "terminal": ends.select(*vendor, "p", "d", rule.alias("rule"), F.when(p % 3 == 0, -0.3).alias("terminal_return"), F.lit(None).cast("double").alias("terminal_value"), F.lit(True).alias("resolved"))}


def resolved_rows(t: Tables) -> dict[str, DataFrame]:
    """The vendor's rows with their security or what is wrong, against the store after all versions of the feed."""
    if not hasattr(t, "resolved"):
        store = ingested(t)[0]
        t.resolved = {name: sinks.written(native.resolve(df, store["master"], store["identifiers"], "d"), f"native_{name}") for name, df in vendor_rows(t).items()}
        t.store = store
    return t.resolved


def stored_terminals(t: Tables) -> DataFrame:
    return native.terminal_state(resolved_rows(t)["terminal"].where("problem is null").withColumn("event_date", F.col("d")))


CTE["vterm"] = (("vres",), "SELECT *, CASE WHEN rule = 'unknown' AND value IS NULL THEN 'unresolved' ELSE 'resolved' END AS state FROM vres WHERE feed = 'terminal' AND problem IS NULL QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY d DESC, rule DESC) = 1")


@query(
    "src_native_outcomes",
    "vterm vres bm",
    "SELECT feed, vendor_id, d, security_id, coalesce(problem, 'stored') AS state, value, bar FROM vres WHERE feed <> 'terminal' OR problem IS NOT NULL UNION ALL SELECT feed, vendor_id, d, security_id, state, value, NULL FROM vterm"
    " UNION ALL SELECT 'benchmark', 'market', d, NULL, 'stored', round(adj / lag(adj) OVER (ORDER BY d) - 1, 6), NULL FROM bm",
)
def native_outcomes(t: Tables) -> DataFrame:
    """Rows of all four feeds: stored, unresolved (terminals without a known outcome), or the reason of quarantine."""
    rows, null = resolved_rows(t), F.lit(None).cast("long").alias("bar")
    state = F.coalesce("problem", F.lit("stored")).alias("state")
    of = lambda feed, df, value, state, bar: df.select(F.lit(feed).alias("feed"), "vendor_id", "d", "security_id", state, F.col(value).alias("value"), bar)
    market = t.bm.select(F.lit("benchmark").alias("feed"), F.lit("market").alias("vendor_id"), "d", F.lit(None).cast("long").alias("security_id"), F.lit("stored").alias("state"), F.round(F.col("adj") / F.lag("adj").over(Window.orderBy("d")) - 1, 6).alias("value"), null)
    out = of("price", rows["price"], "close", state, F.col("bar")).union(of("market_snapshot", rows["market_snapshot"], "market_cap", state, null))
    out = out.union(of("terminal", rows["terminal"].where("problem is not null"), "terminal_return", F.col("problem").alias("state"), null)).union(of("terminal", stored_terminals(t), "terminal_return", F.col("state"), null))
    return out.union(market)


_ENT = "security_id || '/' || d"
query(
    "dq_native_prices",
    "vres vterm",
    f"WITH b AS (SELECT *, CASE WHEN p % 13 = 4 THEN '' ELSE 'vendor' END AS src FROM vres WHERE feed = 'price' AND problem IS NULL) SELECT 'prices' AS domain, rule, entity, detail FROM (SELECT 'negative_price' AS rule, {_ENT} AS entity, 'close<0' AS detail FROM b WHERE value < 0"
    f" UNION ALL SELECT 'impossible_ohlc', {_ENT}, 'high<low' FROM b WHERE high < low UNION ALL SELECT 'ohlc_out_of_range', {_ENT}, 'open outside [low,high]' FROM b WHERE NOT open BETWEEN low AND high UNION ALL SELECT 'ohlc_out_of_range', {_ENT}, 'close outside [low,high]' FROM b WHERE NOT value BETWEEN low AND high"
    f" UNION ALL SELECT 'missing_lineage', {_ENT}, 'no source' FROM b WHERE src = '' UNION ALL SELECT 'trading_after_terminal', b.security_id || '/' || b.d, 'after terminal ' || t.d FROM b JOIN vterm t ON t.security_id = b.security_id AND b.d > t.d"
    f" UNION ALL SELECT 'duplicate_security_date', {_ENT}, count(*) || ' rows' FROM b GROUP BY security_id, d HAVING count(*) > 1)",
)(lambda t: native.check_prices(resolved_rows(t)["price"].where("problem is null").select("security_id", F.col("d").alias("trade_date"), "open", "high", "low", "close", F.when(F.col("p") % 13 != 4, F.col("source")).otherwise("").alias("source")), stored_terminals(t)))
CTE["smaster"] = (("schg",), "SELECT sid, CAST(split_part(v, '|', 4) AS DATE) AS first, split_part(v, '|', 7) = 'true' AS delisted, TRY_CAST(split_part(v, '|', 8) AS DATE) AS gone FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY ver DESC) AS n FROM schg WHERE tbl = 'master') WHERE n = 1")
query(
    "dq_security_master",
    "schg smaster",
    "WITH l AS (SELECT *, row_number() OVER (PARTITION BY tbl, sid, k ORDER BY ver DESC) AS n FROM schg), c AS (SELECT * FROM l WHERE n = 1), i AS (SELECT split_part(k, '|', 1) AS kind, v, sid, CAST(split_part(k, '|', 2) AS DATE) AS f, coalesce(TRY_CAST(until AS DATE), DATE '9999-12-31') AS u FROM c WHERE tbl = 'identifiers'),"
    " e AS (SELECT sid, CAST(split_part(v, '|', 1) AS DATE) - CASE WHEN sid % 5 = 0 THEN 4000 ELSE 0 END AS d FROM c WHERE tbl = 'delistings' AND sid % 4 <> 0) SELECT 'security-master' AS domain, * FROM (SELECT DISTINCT 'identifier_shared_over_overlap' AS rule, a.kind || '=' || a.v AS entity, 'held by security_id ' || a.sid || ' and ' || b.sid || ' over overlapping intervals' AS detail FROM i a JOIN i b ON a.kind = b.kind AND a.v = b.v AND a.sid < b.sid AND a.f <= b.u AND b.f <= a.u"
    " UNION ALL SELECT 'delisted_without_event', 'security_id=' || sid, 'delisted_flag=true but no delisting_event' FROM smaster WHERE delisted AND sid NOT IN (SELECT sid FROM e) UNION ALL SELECT 'delisting_before_listing', 'security_id=' || m.sid, 'delisted ' || e.d || ' < first_trade ' || m.first FROM smaster m JOIN e USING (sid) WHERE e.d < m.first"
    " UNION ALL SELECT 'classification_after_delisting', 'security_id=' || sid, 'classification valid_from ' || split_part(k, '|', 2) || ' > delisting ' || gone FROM c JOIN smaster USING (sid) WHERE tbl = 'classifications' AND CAST(split_part(k, '|', 2) AS DATE) > gone)",
)(lambda t: (lambda s: native.check_master(s | {"delistings": s["delistings"].where("security_id % 4 <> 0").withColumn("delisting_date", F.expr("date_sub(delisting_date, if(security_id % 5 = 0, 4000, 0))"))}))(ingested(t)[0]))


def native_returns(t: Tables) -> DataFrame:
    """Daily returns of stored bars with the terminals' own rows; some statuses lack their event or carry a value they must not."""
    bars = resolved_rows(t)["price"].where("problem is null").groupBy("security_id", "d").agg(F.max("close").alias("close"))
    ret = F.try_divide("close", F.lag("close").over(Window.partitionBy("security_id").orderBy("d"))) - 1
    daily = bars.select("security_id", "d", ret.alias("ret"), F.when(F.col("security_id") % 17 == 0, "delisting").when(F.col("security_id") % 19 == 0, "unresolved").otherwise("normal").alias("status"))
    ends = stored_terminals(t).select("security_id", "d", F.col("terminal_return").alias("ret"), F.when(F.col("state") == "unresolved", "unresolved").otherwise("delisting").alias("status"))
    return daily.union(ends)


query(
    "dq_native_returns",
    "vres vterm",
    "WITH b AS (SELECT security_id, d, max(value) AS close FROM vres WHERE feed = 'price' AND problem IS NULL GROUP BY 1, 2), r AS (SELECT security_id, d, close / nullif(lag(close) OVER (PARTITION BY security_id ORDER BY d), 0) - 1 AS ret, CASE WHEN security_id % 17 = 0 THEN 'delisting' WHEN security_id % 19 = 0 THEN 'unresolved' ELSE 'normal' END AS status FROM b UNION ALL SELECT security_id, d, value, CASE WHEN state = 'unresolved' THEN 'unresolved' ELSE 'delisting' END FROM vterm)"
    f" SELECT 'returns' AS domain, 'delisting_return_without_event' AS rule, {_ENT} AS entity, 'no terminal_outcome' AS detail FROM r WHERE status = 'delisting' AND security_id NOT IN (SELECT security_id FROM vterm) UNION ALL SELECT 'returns', 'unresolved_with_value', {_ENT}, 'unresolved but total_return set' FROM r WHERE status = 'unresolved' AND ret IS NOT NULL",
)(lambda t: native.check_returns(native_returns(t), stored_terminals(t)))


def forward_rows(t: Tables) -> DataFrame:
    """Forward outcomes as stored; some delistings are called normal, some rows lack their checksum or come from another identity world."""
    s, status = F.col("security_id"), F.col("status")
    plain = status.isin("complete", "truncated") | ((status == "delisted") & (s % 8 == 5))
    rows = outcomes(t).where("entry is not null")
    return rows.select("security_id", "as_of", "entry", F.date_add("entry", F.when(s % 31 == 0, -1).otherwise(F.col("horizon"))).alias("exit"), F.when(plain, "normal").otherwise(status).alias("status"), F.when(s % 23 == 0, "survivor").otherwise("native_security").alias("world"), F.when(s % 29 != 0, "c0ffee").alias("checksum"))


query(
    "dq_forward",
    "outs terms",
    "WITH f AS (SELECT security_id, as_of, entry, entry + CASE WHEN security_id % 31 = 0 THEN -1 ELSE horizon END AS exit, CASE WHEN status IN ('complete', 'truncated') OR (status = 'delisted' AND security_id % 8 = 5) THEN 'normal' ELSE status END AS status FROM outs WHERE entry IS NOT NULL), n AS (SELECT *, security_id || '/' || as_of AS entity FROM f)"
    " SELECT 'forward' AS domain, 'exit_before_entry' AS rule, entity, 'exit<entry' AS detail FROM n WHERE exit < entry UNION ALL SELECT 'forward', 'delisting_in_window_untreated', entity, 'delisted ' || ended || ' but status normal' FROM n JOIN terms USING (security_id) WHERE entry <= ended AND ended <= exit AND status = 'normal'"
    " UNION ALL SELECT 'forward', 'non_native_outcome', entity, 'outcome not native' FROM n WHERE security_id % 23 = 0 UNION ALL SELECT 'forward', 'missing_snapshot_checksum', entity, 'no checksum' FROM n WHERE security_id % 29 = 0",
)(lambda t: native.check_forward(forward_rows(t), terminals(t).select("security_id", F.col("ended").alias("delisting_date"))))
