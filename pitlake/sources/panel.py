"""The domain's input tables, derived from the star schema so that their work grows with it.

Every function takes (spark, sf_dir), or the table that it is made of, and returns a lazy DataFrame. ``CTE`` holds the same derivation in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DEC = "decimal(18,6)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_linestatus", F.to_date("l_shipdate").alias("d"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return line.join(supplier, line.l_suppkey == supplier.s_suppkey).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))


def day_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What bars are made of, per nation of the supplier, its region and day: one pass over the lines for all three panels.

    Sums are exact decimals, so they don't depend on the order of rows, nor bars on how lines are grouped first.
    """
    qty, ext, disc = (F.col(c).cast(DEC) for c in ("l_quantity", "l_extendedprice", "l_discount"))
    price: Column = F.col("l_extendedprice") / F.col("l_quantity")
    return _lines(spark, sf_dir).groupBy(F.col("s_nationkey").cast("long").alias("instrument_id"), F.col("n_regionkey").cast("long").alias("sector_id"), "d").agg(
        F.min(F.struct("l_orderkey", "l_linenumber", price.alias("price"))).alias("first"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.sum(ext).alias("ext"),
        F.sum((ext * (1 - disc)).cast("decimal(28,10)")).alias("net"),
        F.sum(qty).alias("qty"),
    )


def _bars(sums: DataFrame, *key: str) -> DataFrame:
    """Daily bars."""
    return sums.groupBy(*key, "d").agg(
        F.min("first").getField("price").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        (F.sum("ext").cast("double") / F.sum("qty").cast("double")).alias("close"),
        (F.sum("net").cast("double") / F.sum("qty").cast("double")).alias("adj"),
        F.sum("qty").cast("long").alias("volume"),
    )


def price_panel(sums: DataFrame) -> DataFrame:
    """px: one row per instrument (nation of the supplier) and day with trades."""
    return _bars(sums, "instrument_id")


def benchmark_panel(sums: DataFrame) -> DataFrame:
    """bm: one row per day over all trades; its days are the calendar."""
    return _bars(sums)


def sector_panel(sums: DataFrame) -> DataFrame:
    """sx: one row per sector (region) and day."""
    return _bars(sums, "sector_id")


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """inst: instrument and its sector."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("instrument_id"), F.col("n_name").alias("symbol"), F.col("n_regionkey").cast("long").alias("sector_id"))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cal: trading days and their position from 1; as long as the calendar, not as the facts."""
    days = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("d")).distinct()
    return days.select("d", F.row_number().over(Window.orderBy("d")).cast("long").alias("idx"))


#: Series code by order priority, its frequency, lag in days and legal range.
SERIES = {"1-URGENT": ("DGS10", "D", 1), "2-HIGH": ("DGS2", "D", 1), "3-MEDIUM": ("VIX", "D", 1), "4-NOT SPECIFIED": ("CPI", "M", 45), "5-LOW": ("UNRATE", "M", 35)}


def macro_series(spark: SparkSession) -> DataFrame:
    rows = [(code, freq, lag, 0.0, 1_000_000.0) for code, freq, lag in SERIES.values()]
    return spark.createDataFrame(rows, "code string, frequency string, lag_days int, min_value double, max_value double")


def macro_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mo: (code, frequency, obs_date, value, available_from); daily or monthly means of order prices, scaled to a rate."""
    orders = table(spark, sf_dir, "orders")
    code = F.coalesce(*[F.when(F.col("o_orderpriority") == p, c) for p, (c, _, _) in SERIES.items()])
    freq = F.coalesce(*[F.when(F.col("o_orderpriority") == p, f) for p, (_, f, _) in SERIES.items()])
    lag = F.coalesce(*[F.when(F.col("o_orderpriority") == p, n) for p, (_, _, n) in SERIES.items()])
    day = F.to_date("o_orderdate")
    obs = orders.select(code.alias("code"), freq.alias("frequency"), lag.alias("lag"), F.when(freq == "D", day).otherwise(F.trunc(day, "month")).alias("obs_date"), F.col("o_totalprice").cast(DEC).alias("p"))
    means = obs.where("code is not null").groupBy("code", "frequency", "lag", "obs_date").agg((F.sum("p").cast("double") / F.count("p") / 10000.0).alias("value"))
    return means.select("code", "frequency", "obs_date", "value", F.date_add("obs_date", F.col("lag")).alias("available_from"))


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fu: monthly snapshots per instrument (nation of the customer), as of the month's end."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    p = F.col("o_totalprice").cast(DEC)
    monthly = joined.groupBy(F.col("c_nationkey").cast("long").alias("instrument_id"), F.last_day(F.to_date("o_orderdate")).alias("as_of")).agg(F.sum(p).cast("double").alias("revenue"), F.count("*").alias("shares"), F.sum(F.when(F.col("o_orderstatus") == "F", p)).cast("double").alias("earned"))
    return monthly.select(
        "instrument_id", "as_of", F.col("revenue"), F.col("shares").cast("double").alias("shares"), (F.col("revenue") * 12).alias("market_cap"),
        (F.col("earned") / F.col("shares")).alias("eps"), (F.col("revenue") / F.col("earned")).alias("pe_trailing"), (F.col("earned") / F.col("revenue")).alias("profit_margin"),
    )


def earnings(fundamentals: DataFrame) -> DataFrame:
    """ea: quarterly reports per instrument; the estimate is the quarter before's result, each is seen twice."""
    q = fundamentals.groupBy("instrument_id", F.trunc("as_of", "quarter").alias("quarter")).agg((F.sum("eps") / F.count("eps")).alias("eps_actual"))
    w = Window.partitionBy("instrument_id").orderBy("quarter")
    base = q.withColumn("eps_estimate", F.lag("eps_actual").over(w)).withColumn("earnings_date", F.date_add(F.add_months("quarter", 3), 20))
    first = base.select("instrument_id", "earnings_date", "eps_estimate", F.lit(None).cast("double").alias("eps_actual"), F.date_sub("earnings_date", 30).alias("observed_on"))
    last = base.select("instrument_id", "earnings_date", F.lit(None).cast("double").alias("eps_estimate"), "eps_actual", F.date_add("earnings_date", 1).alias("observed_on"))
    return first.unionByName(last)


#: Order keys of one part of the numbering of transactions.
ORDERS = 1 << 16
_TXN = ("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "d", "l_linestatus")


def ledger(spark: SparkSession, sf_dir: str, numbered: bool = True) -> DataFrame:
    """tx: F lines buy and O lines sell; even instruments open with all that they sell, odd ones may oversell.

    Lines are numbered within parts of the order keys, from where the parts before end. Without ``numbered``, ``txn_id`` is the lines' own order and no line is sorted.
    """
    lines = _lines(spark, sf_dir)
    if numbered:
        lines = lines.withColumn("_p", F.floor(F.col("l_orderkey") / ORDERS))
        before = Window.partitionBy("_k").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
        start = lines.groupBy(F.col("s_nationkey").alias("_k"), F.col("_p").alias("_q")).agg(F.count("*").alias("_n")).select("_k", "_q", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"))
        lines = lines.withColumn("_r", F.row_number().over(Window.partitionBy("s_nationkey", "_p").orderBy(*_TXN))).join(start, F.col("s_nationkey").eqNullSafe(F.col("_k")) & F.col("_p").eqNullSafe(F.col("_q")))
    rows = lines.select(
        ((F.col("_r") + F.col("_n")).cast("long") if numbered else F.struct(F.lit(1).alias("side"), *_TXN)).alias("txn_id"),
        F.when(F.col("l_linestatus") == "F", "buy").otherwise("sell").alias("txn_type"),
        F.col("d").alias("trade_date"),
        F.col("s_nationkey").cast("long").alias("instrument_id"),
        F.col("l_quantity").cast("decimal(20,8)").alias("quantity"),
        F.when(F.col("l_linestatus") == "F", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).cast("decimal(20,6)").alias("total_amount"),
    )
    sold = rows.where("txn_type = 'sell' and instrument_id % 2 = 0").groupBy("instrument_id").agg(F.sum("quantity").alias("q"), F.sum("total_amount").alias("a"))
    first = -F.col("instrument_id") - 1 if numbered else F.struct(F.lit(0).alias("side"), *[F.lit(None).cast(rows.schema["txn_id"].dataType[c].dataType).alias(c) for c in _TXN])
    opening = sold.select(first.alias("txn_id"), F.lit("opening_balance").alias("txn_type"), F.lit("1990-01-01").cast("date").alias("trade_date"), "instrument_id", F.col("q").cast("decimal(20,8)").alias("quantity"), (-F.col("a") / 2).cast("decimal(20,6)").alias("total_amount"))
    return rows.unionByName(opening)


_BARS = """
    arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_extendedprice / l_quantity)) AS open, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,6))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,6))) AS DOUBLE) AS close,
    CAST(sum(CAST(CAST(l_extendedprice AS DECIMAL(18,6)) * (1 - CAST(l_discount AS DECIMAL(18,6))) AS DECIMAL(28,10))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,6))) AS DOUBLE) AS adj,
    CAST(sum(CAST(l_quantity AS DECIMAL(18,6))) AS BIGINT) AS volume"""
_SERIES = ", ".join(f"('{p}', '{c}', '{f}', {n})" for p, (c, f, n) in SERIES.items())
#: The same tables in SQL: name -> (tables it needs, query).
CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "li": ((), "SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_linestatus, CAST(l_shipdate AS DATE) AS d, CAST(s_nationkey AS BIGINT) AS instrument_id, CAST(n_regionkey AS BIGINT) AS sector_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"),
    "px": (("li",), f"SELECT instrument_id, d, {_BARS} FROM li GROUP BY instrument_id, d"),
    "bm": (("li",), f"SELECT d, {_BARS} FROM li GROUP BY d"),
    "sx": (("li",), f"SELECT sector_id, d, {_BARS} FROM li GROUP BY sector_id, d"),
    "inst": ((), "SELECT CAST(n_nationkey AS BIGINT) AS instrument_id, n_name AS symbol, CAST(n_regionkey AS BIGINT) AS sector_id FROM nation"),
    "cal": ((), "SELECT d, row_number() OVER (ORDER BY d) AS idx FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem)"),
    "ms": ((), f"SELECT code, frequency, lag_days, 0.0::DOUBLE AS min_value, 1000000.0::DOUBLE AS max_value FROM (VALUES {_SERIES}) t(priority, code, frequency, lag_days)"),
    "mo": (
        (),
        f"SELECT code, frequency, obs_date, CAST(sum(p) AS DOUBLE) / count(p) / 10000.0 AS value, obs_date + lag_days AS available_from FROM (SELECT code, frequency, lag_days, CAST(o_totalprice AS DECIMAL(18,6)) AS p,"
        f" CASE WHEN frequency = 'D' THEN CAST(o_orderdate AS DATE) ELSE CAST(date_trunc('month', o_orderdate) AS DATE) END AS obs_date FROM orders JOIN (VALUES {_SERIES}) t(priority, code, frequency, lag_days) ON o_orderpriority = priority) GROUP BY code, frequency, lag_days, obs_date",
    ),
    "fu0": ((), "SELECT CAST(c_nationkey AS BIGINT) AS instrument_id, last_day(CAST(o_orderdate AS DATE)) AS as_of, CAST(sum(CAST(o_totalprice AS DECIMAL(18,6))) AS DOUBLE) AS revenue, CAST(count(*) AS DOUBLE) AS shares, CAST(sum(CAST(o_totalprice AS DECIMAL(18,6))) FILTER (o_orderstatus = 'F') AS DOUBLE) AS earned FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"),
    "fu": (("fu0",), "SELECT instrument_id, as_of, revenue, shares, revenue * 12 AS market_cap, earned / shares AS eps, revenue / earned AS pe_trailing, earned / revenue AS profit_margin FROM fu0"),
    "ea0": (("fu",), "SELECT instrument_id, quarter, eps_actual, lag(eps_actual) OVER (PARTITION BY instrument_id ORDER BY quarter) AS eps_estimate, CAST(quarter + INTERVAL 3 MONTH AS DATE) + 20 AS earnings_date FROM (SELECT instrument_id, CAST(date_trunc('quarter', as_of) AS DATE) AS quarter, sum(eps) / count(eps) AS eps_actual FROM fu GROUP BY 1, 2)"),
    "ea": (("ea0",), "SELECT instrument_id, earnings_date, eps_estimate, NULL::DOUBLE AS eps_actual, earnings_date - 30 AS observed_on FROM ea0 UNION ALL SELECT instrument_id, earnings_date, NULL::DOUBLE, eps_actual, earnings_date + 1 FROM ea0"),
    "tx0": (("li",), "SELECT row_number() OVER (PARTITION BY instrument_id ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity, d, l_linestatus) AS txn_id, CASE WHEN l_linestatus = 'F' THEN 'buy' ELSE 'sell' END AS txn_type, d AS trade_date, instrument_id, CAST(l_quantity AS DECIMAL(20,8)) AS quantity, CAST(CASE WHEN l_linestatus = 'F' THEN -l_extendedprice ELSE l_extendedprice END AS DECIMAL(20,6)) AS total_amount FROM li"),
    "tx": (("tx0",), "SELECT * FROM tx0 UNION ALL SELECT -instrument_id - 1, 'opening_balance', DATE '1990-01-01', instrument_id, CAST(sum(quantity) AS DECIMAL(20,8)), CAST(-sum(total_amount) / 2 AS DECIMAL(20,6)) FROM tx0 WHERE txn_type = 'sell' AND instrument_id % 2 = 0 GROUP BY instrument_id"),
}
