"""Queries of input contracts, market snapshots, research integrity and the export of studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlake.operators import features as ft
from pitlake.operators import integrity as it
from pitlake.operators import research as rs
from pitlake.operators import securities as sec
from pitlake.plans.analogue_queries import conditioned
from pitlake.plans.registry import CTE, Tables, query
from pitlake.plans.security_queries import identifiers, terminals, universe
from pitlake.sources import panel, sinks

REQUIRED = ("instrument_id", "d", "close", "volume")


@query("dq_contract_columns", "px", "SELECT CAST(year(d) AS VARCHAR) AS run, count(*) AS n, CASE WHEN year(d) % 3 = 0 THEN 'volume' ELSE '' END AS missing, CASE WHEN year(d) % 3 = 0 THEN 'rejected' ELSE 'accepted' END AS status FROM px GROUP BY ALL")
def contract_columns(t: Tables) -> DataFrame:
    """An archive of CSV files by year, those of every third year without a column; its files checked by their headers."""
    path = sinks.scratch(t.spark, "contract")
    rows = t.px.select("instrument_id", "d", "close", "volume", F.year("d").alias("run"))
    for part, name in ((rows.where("run % 3 <> 0"), "whole"), (rows.where("run % 3 = 0").drop("volume"), "short")):
        part.write.partitionBy("run").option("header", True).csv(f"{path}/{name}")
    files = it.header_check(t.spark.read.option("recursiveFileLookup", True).text(path), REQUIRED)
    run = F.regexp_extract("file", r"/run=(\d+)/", 1)
    return files.groupBy(run.alias("run")).agg(F.sum("rows").alias("n"), F.max(F.array_join("missing", ",")).alias("missing"), F.max(F.when(F.size("missing") > 0, "rejected").otherwise("accepted")).alias("status"))


CTE["caps"] = (
    (),
    "SELECT CAST(l_suppkey AS BIGINT) AS security_id, last_day(CAST(l_shipdate AS DATE)) AS snapshot_date, CAST(sum(CASE WHEN l_returnflag = 'R' THEN -2 ELSE 1 END * CAST(l_extendedprice AS DECIMAL(18,6))) AS DOUBLE) AS market_cap, CAST(sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS DECIMAL(18,6)) END) AS DOUBLE) AS shares FROM lineitem GROUP BY 1, 2",
)


def market_snapshots(t: Tables) -> DataFrame:
    """Monthly capitalisation and shares of each security; returned lines count against it, and shares are those of open lines."""
    price = F.col("l_extendedprice").cast(panel.DEC) * F.when(F.col("l_returnflag") == "R", -2).otherwise(1)
    return t.table("lineitem").groupBy(F.col("l_suppkey").cast("long").alias("security_id"), F.last_day(F.to_date("l_shipdate")).alias("snapshot_date")).agg(
        F.sum(price).cast("double").alias("market_cap"), F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity").cast(panel.DEC))).cast("double").alias("shares")
    )


query(
    "dq_market_snapshots", "caps terms",
    "SELECT security_id, snapshot_date, 'negative_cap' AS rule FROM caps WHERE market_cap < 0 UNION ALL SELECT security_id, snapshot_date, 'cap_without_shares' FROM caps WHERE market_cap IS NOT NULL AND shares IS NULL UNION ALL SELECT c.security_id, snapshot_date, 'after_terminal' FROM caps c JOIN terms USING (security_id) WHERE snapshot_date > ended",
)(lambda t: it.market_snapshot_findings(market_snapshots(t), terminals(t)))
CTE["rsnap"] = (
    ("quarters", "uni", "terms"),
    "SELECT CAST(as_of AS VARCHAR) AS name, CASE WHEN as_of < DATE '1999-01-01' THEN 'frozen' ELSE 'draft' END AS status, n > 0 AS checksum, CASE WHEN as_of < DATE '1997-01-01' THEN 'instrument' ELSE 'security' END AS feature_world, CASE WHEN ends > 0 THEN 'security' ELSE 'instrument' END AS outcome_world FROM (SELECT as_of, count(*) FILTER (status = 'included') AS n, count(*) FILTER (ended > as_of) AS ends FROM uni LEFT JOIN terms USING (security_id) GROUP BY 1)",
)


def research_snapshots(t: Tables) -> DataFrame:
    """A research snapshot per reconstitution date: frozen until 1998, with the checksum of its members where it has any."""
    day = lambda s: F.lit(s).cast("date")
    u = universe(t)
    sums = sec.manifest(u.where("status = 'included'")).select("as_of", F.col("sha256").alias("checksum"))
    ends = u.select("as_of", "security_id").join(terminals(t), "security_id", "left").groupBy("as_of").agg(F.count_if(F.col("ended") > F.col("as_of")).alias("ends"))
    return ends.join(sums, "as_of", "left").select(
        F.col("as_of").cast("string").alias("name"), F.when(F.col("as_of") < day("1999-01-01"), "frozen").otherwise("draft").alias("status"), "checksum",
        F.when(F.col("as_of") < day("1997-01-01"), "instrument").otherwise("security").alias("feature_world"), F.when(F.col("ends") > 0, "security").otherwise("instrument").alias("outcome_world"),
    )


query(
    "dq_research_integrity", "rsnap idents",
    "SELECT name AS entity, 'unfrozen_with_checksum' AS rule, 1::BIGINT AS n FROM rsnap WHERE status <> 'frozen' AND checksum UNION ALL SELECT name, 'frozen_without_checksum', 1 FROM rsnap WHERE status = 'frozen' AND NOT checksum UNION ALL SELECT name, 'mixed_worlds', 1 FROM rsnap WHERE outcome_world = 'security' AND feature_world = 'instrument'"
    " UNION ALL SELECT identifier, 'bridge_overlap', count(*) FROM (SELECT *, lead(valid_from) OVER (PARTITION BY identifier ORDER BY valid_from, security_id) AS nxt FROM idents) WHERE nxt IS NOT NULL AND (valid_to IS NULL OR valid_to >= nxt) GROUP BY 1",
)(lambda t: it.research_findings(research_snapshots(t), identifiers(t)))


@query("sink_study_export", "cev fwd", "SELECT study, instrument_id, d AS event_date, horizon, round(fwd, 8) AS fwd FROM cev JOIN fwd USING (instrument_id, d) WHERE fwd IS NOT NULL")
def study_export(t: Tables) -> DataFrame:
    """Forward returns of a study's events as CSV with eight decimals, read back."""
    path = sinks.scratch(t.spark, "study")
    rows = rs.events(conditioned(t)).join(rs.forward_returns(t.px).where("fwd is not null"), ["instrument_id", "d"]).select("study", "instrument_id", F.col("d").alias("event_date"), "horizon", "fwd")
    sinks.export_csv(rows, path, ["fwd"])
    return t.spark.read.schema("study string, instrument_id long, event_date date, horizon int, fwd double").option("header", True).csv(path)


CTE["retl"] = (("px",), "SELECT instrument_id, d, adj / lag(adj, 21) OVER w - 1 AS legacy, CASE WHEN count(adj) OVER w22 = 22 THEN exp(sum(ln(adj / prev)) OVER w21) - 1 END AS native FROM (SELECT *, lag(adj) OVER (PARTITION BY instrument_id ORDER BY d) AS prev FROM px) WINDOW w AS (PARTITION BY instrument_id ORDER BY d), w21 AS (PARTITION BY instrument_id ORDER BY d ROWS 20 PRECEDING), w22 AS (PARTITION BY instrument_id ORDER BY d ROWS 21 PRECEDING)")


def computations(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The month's return from two prices, and from the sum of its daily log returns."""
    own = Window.partitionBy("instrument_id").orderBy("d")
    legacy = ft.returns(t.px, (21,)).withColumnRenamed("ret_21d", "value")
    daily = t.px.withColumn("r", F.ln(F.col("adj") / F.lag("adj").over(own)))
    native = daily.select("instrument_id", "d", F.when(F.count("adj").over(own.rowsBetween(-21, 0)) == 22, F.exp(F.sum("r").over(own.rowsBetween(-20, 0))) - 1).alias("value"))
    return legacy, native


query("par_computation", "retl", "SELECT instrument_id, count(*) AS n, count(*) FILTER (legacy IS NULL AND native IS NULL) AS both_null, count(*) FILTER (NOT (legacy IS NULL AND native IS NULL) AND coalesce(abs(legacy - native) > 1e-9, true)) AS outside FROM retl GROUP BY 1")(
    lambda t: it.parity(*computations(t), ["instrument_id", "d"], 1e-9).groupBy("instrument_id").agg(F.count("*").alias("n"), F.count_if("both_null").alias("both_null"), F.count_if("outside").alias("outside"))
)
