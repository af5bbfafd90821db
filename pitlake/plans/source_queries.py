"""Queries of the readers' contracts and the sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlake.operators import pit
from pitlake.plans.feature_queries import store
from pitlake.plans.quality_queries import raw, refetched
from pitlake.plans.registry import CTE, Tables, query
from pitlake.sources import sinks

query("src_prices", "raw", "SELECT instrument_id, d, round(close, 10) AS close, volume, seq FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id, d ORDER BY seq) AS n FROM raw WHERE close IS NOT NULL) WHERE n = 1")(
    lambda t: raw(t).where("close is not null").withColumn("n", F.row_number().over(Window.partitionBy("instrument_id", "d").orderBy("seq"))).where("n = 1").select("instrument_id", "d", F.round("close", 10).alias("close"), "volume", "seq")
)
query("src_actions", "px", "SELECT instrument_id, d, 'split' AS action, 2.0::DOUBLE AS value FROM px WHERE dayofyear(d) % 50 = 0 UNION ALL SELECT instrument_id, d, 'dividend', round(low * 0.01, 8) FROM px WHERE dayofyear(d) % 30 = 1")(
    lambda t: t.px.select("instrument_id", "d", F.when(F.dayofyear("d") % 50 == 0, 2.0).alias("split"), F.when(F.dayofyear("d") % 30 == 1, F.round(F.col("low") * 0.01, 8)).alias("dividend")).unpivot(["instrument_id", "d"], ["split", "dividend"], "action", "value").where("value is not null and value <> 0")
)
query("src_macro", "mo", "SELECT code, obs_date, CASE WHEN day(obs_date) % 7 = 3 THEN NULL ELSE round(value, 9) END AS value FROM mo")(
    lambda t: t.mo.select("code", "obs_date", F.when(F.dayofmonth("obs_date") % 7 == 3, ".").otherwise(F.round("value", 9).cast("string")).alias("text")).select("code", "obs_date", F.expr("try_cast(nullif(text, '.') as double)").alias("value"))
)
query("src_fundamentals", "fu", "SELECT instrument_id, as_of, CAST(CAST(market_cap AS DECIMAL(20,2)) AS DOUBLE) AS market_cap, CAST(CAST(profit_margin AS DECIMAL(8,6)) AS DOUBLE) AS profit_margin FROM fu")(
    lambda t: t.fu.select("instrument_id", "as_of", F.col("market_cap").cast("decimal(20,2)").cast("double").alias("market_cap"), F.col("profit_margin").cast("decimal(8,6)").cast("double").alias("profit_margin"))
)
query("src_earnings", "", "SELECT user_id, day, tod FROM (SELECT user_id, CAST(ts AS DATE) AS day, CASE WHEN hour(ts) = 0 AND minute(ts) = 0 THEN 'unknown' WHEN hour(ts) < 12 THEN 'BMO' ELSE 'AMC' END AS tod, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")(
    lambda t: t.table("events").select("user_id", F.to_date("ts").alias("day"), F.when((F.hour("ts") == 0) & (F.minute("ts") == 0), "unknown").when(F.hour("ts") < 12, "BMO").otherwise("AMC").alias("tod"), F.row_number().over(Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")).alias("n")).where("n = 1").drop("n")
)
query("src_universe", "inst", "SELECT instrument_id, symbol, r_name AS sector FROM inst LEFT JOIN region ON r_regionkey = sector_id")(
    lambda t: t.inst.join(F.broadcast(t.table("region").select(F.col("r_regionkey").cast("long").alias("sector_id"), F.col("r_name").alias("sector"))), "sector_id", "left").select("instrument_id", "symbol", "sector")
)
HALF = "(month(d) = 11 AND isodow(d) = 5 AND day(d) BETWEEN 23 AND 29) OR (month(d) = 12 AND day(d) = 24 AND isodow(d) < 5) OR (month(d) = 7 AND day(d) = 3 AND isodow(d) < 5)"
query("src_calendar", "cal", f"SELECT event_id, c.d AS last_session, c.half_day FROM (SELECT event_id, ts - INTERVAL 9000 DAY AS now FROM events) e ASOF LEFT JOIN (SELECT d, {HALF} AS half_day, CAST(d AS TIMESTAMP) + INTERVAL 16 HOUR + INTERVAL 60 MINUTE AS complete FROM cal) c ON e.now >= c.complete")(
    lambda t: pit.completed_session(t.table("events").select("event_id", F.expr("cast(ts as timestamp_ntz) - interval 9000 days").alias("now")), t.cal, "now").select("event_id", F.col("entry").alias("last_session"), pit.is_half_day(F.col("entry")).alias("half_day"))
)
query("src_macro_asof", "mo ms", "SELECT code, count(*) AS known, max(obs_date) AS last_obs FROM mo JOIN ms USING (code, frequency) WHERE obs_date + lag_days <= DATE '1996-06-30' GROUP BY 1")(
    lambda t: t.mo.join(F.broadcast(t.ms), ["code", "frequency"]).where(F.date_add("obs_date", F.col("lag_days")) <= F.lit("1996-06-30").cast("date")).groupBy("code").agg(F.count("*").alias("known"), F.max("obs_date").alias("last_obs"))
)
query("src_earnings_current", "ea", "SELECT instrument_id, earnings_date, max(observed_on) AS observed_on, round(arg_max_null(eps_actual, observed_on), 5) AS eps_actual FROM ea GROUP BY 1, 2")(
    lambda t: t.ea.groupBy("instrument_id", "earnings_date").agg(F.max("observed_on").alias("observed_on"), F.round(F.max_by("eps_actual", "observed_on"), 5).alias("eps_actual"))
)
HASH = "substr(sha256(concat_ws('|', txn_type, CAST(trade_date AS VARCHAR), CAST(instrument_id AS VARCHAR), CAST(CAST(quantity AS BIGINT) AS VARCHAR), CAST(CAST(total_amount * 100 AS BIGINT) AS VARCHAR))), 1, 24)"
FIELDS = "external_id string, txn_type string, trade_date date, instrument_id long, quantity decimal(20,8), total_amount decimal(20,6)"
CTE["csv_in"] = (
    ("tx",),
    f"SELECT *, CASE WHEN txn_id % 5 = 0 THEN 'X' || instrument_id || '-' || txn_id ELSE 'sha256:' || {HASH} END AS id FROM tx WHERE txn_id > 0 UNION ALL SELECT *, CASE WHEN txn_id % 5 = 0 THEN 'X' || instrument_id || '-' || txn_id ELSE 'sha256:' || {HASH} END FROM tx WHERE txn_id > 0 AND txn_id % 50 = 3",
)


def ledger_file(t: Tables) -> str:
    """The ledger as a broker exports it: CSV, an external id on some rows only, some rows twice."""
    external = F.when(F.col("txn_id") % 5 == 0, F.concat(F.lit("X"), F.col("instrument_id").cast("string"), F.lit("-"), F.col("txn_id").cast("string")))
    rows = t.tx.where("txn_id > 0").select(external.alias("external_id"), "txn_type", "trade_date", "instrument_id", "quantity", "total_amount", "txn_id")
    path = sinks.scratch(t.spark, "ledger")
    rows.unionByName(rows.where("txn_id % 50 = 3")).drop("txn_id").write.option("header", True).csv(path)
    return path


def with_ids(rows: DataFrame) -> DataFrame:
    """Transactions with their external id, or a digest of their contents where they have none."""
    fields = F.concat_ws("|", "txn_type", F.col("trade_date").cast("string"), F.col("instrument_id").cast("string"), F.col("quantity").cast("long").cast("string"), (F.col("total_amount") * 100).cast("long").cast("string"))
    digest = F.concat(F.lit("sha256:"), F.substring(F.sha2(fields, 256), 1, 24))
    return rows.withColumn("id", F.when(F.coalesce(F.trim("external_id"), F.lit("")) != "", F.trim("external_id")).otherwise(digest))


@query("src_ledger_csv", "csv_in", "SELECT id, count(*) AS copies, CASE WHEN bool_or(trade_date < DATE '1996-01-01') THEN 'existing' ELSE 'inserted' END AS status, max(trade_date) AS trade_date FROM csv_in GROUP BY 1")
def ledger_import(t: Tables) -> DataFrame:
    """A ledger file imported a second time, when the first import held its rows before 1996: per id the copies in the file
    and whether the ledger had it already.
    """
    rows = with_ids(t.spark.read.schema(FIELDS).option("header", True).csv(ledger_file(t)))
    had = rows.where("trade_date < date'1996-01-01'").select("id").distinct().withColumn("had", F.lit(True))
    each = rows.groupBy("id").agg(F.count("*").alias("copies"), F.max("trade_date").alias("trade_date"))
    return each.join(had, "id", "left").select("id", "copies", F.when(F.col("had"), "existing").otherwise("inserted").alias("status"), "trade_date")


query("src_opening_balances", "tx", "SELECT instrument_id, CAST(quantity AS DOUBLE) AS quantity, round(CAST(-total_amount AS DOUBLE), 2) AS basis FROM tx WHERE txn_type = 'opening_balance'")(
    lambda t: t.tx.where("txn_type = 'opening_balance'").select("instrument_id", F.col("quantity").cast("double").alias("quantity"), F.round((-F.col("total_amount")).cast("double"), 2).alias("basis"))
)
CTE["tx_bad"] = (("tx",), "SELECT instrument_id AS i, txn_id, CASE WHEN txn_id % 19 = 0 THEN NULL ELSE instrument_id END AS instrument_id, CASE WHEN txn_id % 17 = 0 THEN -quantity ELSE quantity END AS quantity, CASE WHEN txn_id % 13 = 0 THEN 0 ELSE total_amount END AS total_amount FROM tx WHERE txn_id > 0")
query("src_txn_validate", "tx_bad", "SELECT i, txn_id, concat_ws(',', CASE WHEN instrument_id IS NULL THEN 'symbol' END, CASE WHEN quantity <= 0 THEN 'quantity' END, CASE WHEN total_amount = 0 THEN 'amount' END) AS problems FROM tx_bad WHERE instrument_id IS NULL OR quantity <= 0 OR total_amount = 0")(
    lambda t: t.tx.where("txn_id > 0").select(F.col("instrument_id").alias("i"), "txn_id", F.filter(F.array(F.when(F.col("txn_id") % 19 == 0, "symbol"), F.when((F.col("txn_id") % 17 == 0) & (F.col("quantity") > 0), "quantity"), F.when(F.col("txn_id") % 13 == 0, "amount")), lambda x: x.isNotNull()).alias("p")).where("size(p) > 0").select("i", "txn_id", F.array_join("p", ",").alias("problems"))
)
query("sink_insert_absent", "px", "SELECT instrument_id, count(*) AS inserted FROM px WHERE d > DATE '1998-06-01' GROUP BY 1")(
    lambda t: sinks.insert_absent(t.px.union(t.px.where("d > date'1998-09-01'")), t.px.where("d <= date'1998-06-01'"), ["instrument_id", "d"]).groupBy("instrument_id").agg(F.count("*").alias("inserted"))
)
query("sink_guarded_upsert", "px px2", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN o.d IS NULL THEN 'insert' WHEN b.d IS NULL THEN 'kept' WHEN b.close IS NOT DISTINCT FROM o.close AND b.adj IS NOT DISTINCT FROM o.adj THEN 'unchanged' ELSE 'update' END AS status FROM px2 b FULL JOIN (SELECT * FROM px WHERE d < DATE '1998-10-01') o ON o.instrument_id = b.instrument_id AND o.d = b.d) GROUP BY 1")(
    lambda t: sinks.upsert_status(refetched(t), t.px.where("d < date'1998-10-01'"), ["instrument_id", "d"], ["close", "adj"]).groupBy("status").agg(F.count("*").alias("n"))
)
query("sink_run_counts", "sorted_out", "SELECT year(d) AS run, count(*) FILTER (rule IS NULL) AS inserted, count(*) FILTER (rule IS NOT NULL) AS quarantined, CASE WHEN count(*) FILTER (rule IS NULL) = 0 THEN 'failed' WHEN count(*) FILTER (rule IS NOT NULL) > 0 THEN 'partial' ELSE 'success' END AS status FROM sorted_out GROUP BY 1")(
    lambda t: (lambda s: s.groupBy(F.year("d").alias("run")).agg(F.count_if(F.col("rule").isNull()).alias("inserted"), F.count_if(F.col("rule").isNotNull()).alias("quarantined")).withColumn("status", F.when(F.col("inserted") == 0, "failed").when(F.col("quarantined") > 0, "partial").otherwise("success")))(_sorted(t))
)
query("sink_write_once", "px", "SELECT year(d) AS year, count(*) AS rows, CASE WHEN year(d) = 1997 THEN 'conflict' WHEN year(d) >= 1998 THEN 'new' ELSE 'unchanged' END AS status FROM px GROUP BY 1")(
    lambda t: (lambda p: sinks.write_once(p, p.where("year < 1998").withColumn("close", F.when(F.col("year") == 1997, F.col("close") + 1).otherwise(F.col("close"))), ["year"]))(t.px.withColumn("year", F.year("d")))
)


def _sorted(t: Tables) -> DataFrame:
    from pitlake.plans.quality_queries import sorted_out

    return sorted_out(t)


@query("sink_partition_year", "store", "SELECT year(d) AS year, feature, count(*) AS n FROM store GROUP BY 1, 2")
def partitioned(t: Tables) -> DataFrame:
    """The store written by year, one year rewritten, and read again: a rerun changes nothing."""
    path, rows = sinks.scratch(t.spark, "store"), store(t)
    sinks.write_years(rows, path, "d")
    sinks.write_years(rows.where("year(d) = 1995"), path, "d")
    return t.spark.read.parquet(path).groupBy("year", "feature").agg(F.count("*").alias("n"))


@query("src_archive_scan", "px", "SELECT CAST(year(d) AS VARCHAR) AS run, count(*) AS n FROM px GROUP BY 1")
def archive_scan(t: Tables) -> DataFrame:
    """CSV files of an archive with the run read from the path."""
    path = sinks.scratch(t.spark, "archive")
    t.px.select("instrument_id", "d", "close", F.year("d").alias("run")).write.partitionBy("run").option("header", True).csv(f"{path}/prices")
    files = t.spark.read.schema("instrument_id long, d date, close double").option("header", True).option("recursiveFileLookup", True).csv(path)
    return files.select(F.regexp_extract("_metadata.file_path", r"/prices/run=(\d+)/", 1).alias("run")).groupBy("run").agg(F.count("*").alias("n"))
