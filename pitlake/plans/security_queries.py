"""Queries of the security master, universe, bridge and native outcomes; suppliers stand for securities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlake.operators import securities as sec
from pitlake.plans.registry import CTE, Tables, query
from pitlake.sources import panel

CTE["bars"] = (("li",), "SELECT CAST(l_suppkey AS BIGINT) AS security_id, d, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,6))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,6))) AS DOUBLE) AS adj, CASE WHEN dayofyear(d) % 50 = 0 THEN 2.0 ELSE 1.0 END AS split FROM li GROUP BY 1, 2")
CTE["master"] = (
    ("bars",),
    "SELECT security_id, CASE WHEN security_id % 11 = 3 THEN NULL ELSE min(d) END AS listed, CASE WHEN security_id % 4 = 1 THEN DATE '1996-03-01' + CAST(security_id % 300 AS INTEGER) END AS delisted, CASE WHEN security_id % 9 = 2 THEN 'fund' ELSE 'stock' END AS kind FROM bars GROUP BY 1",
)
CTE["terms"] = (("master",), "SELECT security_id, delisted AS ended, CASE WHEN security_id % 8 = 1 THEN NULL WHEN security_id % 8 = 5 THEN -0.3 END::DOUBLE AS value FROM master WHERE delisted IS NOT NULL")


def bars(t: Tables) -> DataFrame:
    q, e = F.col("l_quantity").cast(panel.DEC), F.col("l_extendedprice").cast(panel.DEC)
    rows = t.table("lineitem").groupBy(F.col("l_suppkey").cast("long").alias("security_id"), F.to_date("l_shipdate").alias("d"))
    return rows.agg((F.sum(e).cast("double") / F.sum(q).cast("double")).alias("adj")).withColumn("split", F.when(F.dayofyear("d") % 50 == 0, 2.0).otherwise(1.0))


def master(t: Tables) -> DataFrame:
    s = F.col("security_id")
    first = t.table("lineitem").groupBy(F.col("l_suppkey").cast("long").alias("security_id")).agg(F.min(F.to_date("l_shipdate")).alias("first"))
    return first.select(s, F.when(s % 11 != 3, F.col("first")).alias("listed"), F.when(s % 4 == 1, F.date_add(F.lit("1996-03-01").cast("date"), (s % 300).cast("int"))).alias("delisted"), F.when(s % 9 == 2, "fund").otherwise("stock").alias("kind"))


def terminals(t: Tables) -> DataFrame:
    return master(t).where("delisted is not null").select("security_id", F.col("delisted").alias("ended"), F.when(F.col("security_id") % 8 == 5, -0.3).alias("value"))


CTE["quarters"] = (("cal",), "SELECT min(d) AS as_of FROM cal GROUP BY date_trunc('quarter', d)")


def quarters(t: Tables) -> DataFrame:
    return t.cal.groupBy(F.trunc("d", "quarter").alias("q")).agg(F.min("d").alias("as_of")).select("as_of")


CTE["uni"] = (
    ("master", "quarters"),
    "SELECT security_id, as_of, CASE WHEN listed IS NULL THEN 'no_first_date' WHEN listed > as_of THEN 'not_listed' WHEN delisted <= as_of THEN 'delisted' WHEN kind <> 'stock' THEN 'type' WHEN as_of - listed < 252 THEN 'history' ELSE 'included' END AS status FROM master CROSS JOIN quarters",
)


def universe(t: Tables) -> DataFrame:
    return sec.universe(master(t), quarters(t))


query("uni_build", "uni", "SELECT * FROM uni")(universe)
query("uni_manifest", "uni", "SELECT as_of, count(*) AS n, sha256(array_to_string(list(lpad(CAST(security_id AS VARCHAR), 12, '0') ORDER BY security_id), ',')) AS sha256 FROM uni WHERE status = 'included' GROUP BY 1")(lambda t: sec.manifest(universe(t).where("status = 'included'")))
query("uni_members_asof", "uni days", "SELECT day, count(*) AS members, CAST(sum(security_id) AS BIGINT) AS ids FROM (SELECT days.day, q.as_of FROM days ASOF JOIN (SELECT DISTINCT as_of FROM uni WHERE status = 'included') q ON days.day >= q.as_of) JOIN uni USING (as_of) WHERE status = 'included' GROUP BY 1")(
    lambda t: sec.members_asof(universe(t).where("status = 'included'").select("as_of", "security_id"), t.table("orders").select(F.to_date("o_orderdate").alias("day")).distinct()).groupBy("day").agg(F.count("*").alias("members"), F.sum("security_id").alias("ids"))
)
query("out_daily_returns", "bars terms", "SELECT security_id, d, round(ret, 6) AS ret, status FROM (SELECT security_id, d, adj / nullif(lag(adj) OVER w, 0) - 1 AS ret, CASE WHEN lag(adj) OVER w IS NULL THEN 'missing' WHEN split <> 1 THEN 'corporate_action' ELSE 'normal' END AS status FROM bars WINDOW w AS (PARTITION BY security_id ORDER BY d) UNION ALL SELECT security_id, ended, value, CASE WHEN value IS NULL THEN 'unresolved' ELSE 'delisting' END FROM terms)")(
    lambda t: sec.daily_returns(bars(t), terminals(t)).withColumn("ret", F.round("ret", 6))
)
LAST = "DATE '1998-06-30'"
CTE["outs"] = (
    ("bars", "terms", "quarters"),
    f"SELECT security_id, as_of, horizon, entry, status, CASE WHEN status IN ('complete', 'truncated') THEN px - 1 WHEN status = 'delisted' THEN px * (1 + value) - 1 END AS fwd FROM (SELECT *, exit_price / entry_price AS px, CASE WHEN entry IS NULL THEN 'no_entry_price' WHEN ended > entry AND ended <= target AND value IS NULL THEN 'unresolved' WHEN ended > entry AND ended <= target THEN 'delisted' WHEN target > {LAST} THEN 'truncated' ELSE 'complete' END AS status"
    " FROM (SELECT e.*, x.adj AS exit_price FROM (SELECT g.security_id, g.as_of, g.horizon, b.d AS entry, b.adj AS entry_price, b.d + g.horizon AS target, coalesce(b.d + g.horizon, g.as_of) AS until FROM (SELECT s.security_id, q.as_of, h.horizon FROM (SELECT DISTINCT security_id FROM bars) s CROSS JOIN quarters q CROSS JOIN (VALUES (30), (91), (365)) h(horizon)) g ASOF LEFT JOIN bars b ON b.security_id = g.security_id AND g.as_of <= b.d) e ASOF LEFT JOIN bars x ON x.security_id = e.security_id AND e.until >= x.d) LEFT JOIN terms USING (security_id))",
)


def outcomes(t: Tables) -> DataFrame:
    b = bars(t)
    grid = b.select("security_id").distinct().crossJoin(F.broadcast(quarters(t)))
    return sec.forward_outcomes(grid, b, terminals(t), F.lit("1998-06-30").cast("date"))


query("out_forward", "outs", "SELECT security_id, as_of, horizon, entry, status, round(fwd, 6) AS fwd FROM outs")(lambda t: outcomes(t).withColumn("fwd", F.round("fwd", 6)))
query("out_snapshot", "outs", "SELECT horizon, status, count(*) AS n, count(DISTINCT security_id) AS securities, count(DISTINCT as_of) AS dates FROM outs GROUP BY 1, 2")(
    lambda t: outcomes(t).groupBy("horizon", "status").agg(F.count("*").alias("n"), F.countDistinct("security_id").alias("securities"), F.countDistinct("as_of").alias("dates"))
)
query("out_verify", "outs", "SELECT horizon, CAST(bit_xor(CAST(('0x' || substr(md5(concat_ws('|', security_id, as_of, horizon, status)), 1, 15)) AS BIGINT)) AS BIGINT) AS checksum FROM outs GROUP BY 1")(
    lambda t: outcomes(t).groupBy("horizon").agg(F.bit_xor(F.conv(F.substring(F.md5(F.concat_ws("|", "security_id", "as_of", "horizon", "status")), 1, 15), 16, 10).cast("long")).alias("checksum"))
)
query("out_benchmark_cum", "bm quarters", "SELECT as_of, round(exp(sum(ln(1 + r))) - 1, 6) AS cum FROM quarters JOIN (SELECT d, adj / lag(adj) OVER (ORDER BY d) - 1 AS r FROM bm) b ON b.d > as_of AND b.d <= as_of + 91 GROUP BY 1")(
    lambda t: t.bm.withColumn("r", F.col("adj") / F.lag("adj").over(Window.orderBy("d")) - 1).join(F.broadcast(quarters(t)), (F.col("d") > F.col("as_of")) & (F.col("d") <= F.date_add("as_of", 91))).groupBy("as_of").agg(F.round(F.exp(F.sum(F.log1p("r"))) - 1, 6).alias("cum"))
)
CTE["idents"] = (("master",), "SELECT 'ID' || (security_id % 40) AS identifier, security_id, DATE '1992-01-01' + CAST(security_id * 13 % 2000 AS INTEGER) AS valid_from, CASE WHEN security_id % 3 = 0 THEN NULL ELSE DATE '1992-01-01' + CAST(security_id * 13 % 2000 + 400 AS INTEGER) END AS valid_to FROM master")


def identifiers(t: Tables) -> DataFrame:
    s, day = F.col("security_id"), lambda n: F.date_add(F.lit("1992-01-01").cast("date"), n.cast("int"))
    return master(t).select(F.concat(F.lit("ID"), (s % 40).cast("string")).alias("identifier"), s, day(s * 13 % 2000).alias("valid_from"), F.when(s % 3 != 0, day(s * 13 % 2000 + 400)).alias("valid_to"))


OVERLAP = "SELECT DISTINCT x.identifier, x.security_id AS a, y.security_id AS b FROM idents x JOIN idents y ON x.identifier = y.identifier AND x.security_id < y.security_id AND x.valid_from < coalesce(y.valid_to, DATE '9999-12-31') AND y.valid_from < coalesce(x.valid_to, DATE '9999-12-31')"
query("sec_identity_conflict", "idents", f"SELECT DISTINCT b AS security_id, identifier FROM ({OVERLAP})")(lambda t: sec.overlaps(identifiers(t), "identifier", "security_id").select(F.col("b").alias("security_id"), "identifier").distinct())
query("bridge_overlaps", "idents", OVERLAP)(lambda t: sec.overlaps(identifiers(t), "identifier", "security_id"))
query("sec_delisted_between", "master", "SELECT security_id, delisted FROM master WHERE delisted BETWEEN DATE '1996-04-01' AND DATE '1996-09-30'")(lambda t: master(t).where("delisted between date'1996-04-01' and date'1996-09-30'").select("security_id", "delisted"))
query("sec_classification_asof", "idents", "SELECT identifier, security_id FROM idents WHERE valid_from <= DATE '1995-06-30' AND (valid_to IS NULL OR DATE '1995-06-30' < valid_to)")(
    lambda t: identifiers(t).where("valid_from <= date'1995-06-30' and (valid_to is null or date'1995-06-30' < valid_to)").select("identifier", "security_id")
)
query("sec_lifecycle_asof", "master", "SELECT security_id, 'listed' AS event, listed AS d FROM master WHERE listed <= DATE '1996-06-30' UNION ALL SELECT security_id, 'delisted', delisted FROM master WHERE delisted <= DATE '1996-06-30'")(
    lambda t: master(t).select("security_id", F.col("listed").alias("listed"), "delisted").unpivot(["security_id"], ["listed", "delisted"], "event", "d").where("d <= date'1996-06-30'")
)
query("dq_universe", "uni master", "SELECT security_id, as_of FROM uni JOIN master USING (security_id) WHERE status IN ('included', 'type', 'history') AND (delisted <= as_of + 30)")(
    lambda t: universe(t).where("status in ('included', 'type', 'history')").join(master(t), "security_id").where("delisted <= date_add(as_of, 30)").select("security_id", "as_of")
)
CTE["br_in"] = (("inst",), "SELECT instrument_id, instrument_id * 10 + CASE WHEN instrument_id % 3 = 0 THEN 1 ELSE 0 END AS security_id, DATE '1995-01-01' AS valid_from, DATE '1996-01-01' AS valid_to, instrument_id % 7 = 0 AS manual FROM inst")
CTE["br_old"] = (("inst",), "SELECT instrument_id, instrument_id * 10 AS security_id, DATE '1995-06-01' AS valid_from, DATE '1999-01-01' AS valid_to FROM inst WHERE instrument_id % 2 = 0")


def mappings(t: Tables) -> tuple[DataFrame, DataFrame]:
    i, day = F.col("instrument_id"), lambda d: F.lit(d).cast("date")
    new = t.inst.select(i, (i * 10 + F.when(i % 3 == 0, 1).otherwise(0)).alias("security_id"), day("1995-01-01").alias("valid_from"), day("1996-01-01").alias("valid_to"), (i % 7 == 0).alias("manual"))
    return new, t.inst.where("instrument_id % 2 = 0").select(i, (i * 10).alias("security_id"), day("1995-06-01").alias("valid_from"), day("1999-01-01").alias("valid_to"))


query("bridge_ingest", "br_in br_old", "SELECT i.instrument_id, i.security_id, i.valid_from, CASE WHEN any_value(i.manual) THEN 'supersedes' WHEN coalesce(bool_or(o.security_id <> i.security_id), false) THEN 'quarantined' WHEN coalesce(bool_or(o.security_id = i.security_id), false) THEN 'skipped' ELSE 'active' END AS status FROM br_in i LEFT JOIN br_old o ON o.instrument_id = i.instrument_id AND i.valid_from <= o.valid_to AND o.valid_from <= i.valid_to GROUP BY 1, 2, 3")(
    lambda t: sec.bridge(*mappings(t))
)
query("bridge_resolve", "br_old px", "SELECT px.instrument_id, count(o.security_id) AS mapped, count(*) - count(o.security_id) AS uncovered FROM px LEFT JOIN br_old o ON o.instrument_id = px.instrument_id AND px.d BETWEEN o.valid_from AND o.valid_to GROUP BY 1")(
    lambda t: (lambda o: t.px.select("instrument_id", "d").join(F.broadcast(o.withColumnRenamed("instrument_id", "_i")), (F.col("instrument_id") == F.col("_i")) & F.col("d").between(F.col("valid_from"), F.col("valid_to")), "left").groupBy("instrument_id").agg(F.count("security_id").alias("mapped"), (F.count("*") - F.count("security_id")).alias("uncovered")))(mappings(t)[1])
)
query("par_divergence", "px", "SELECT instrument_id, d, CASE WHEN abs(adj - close) / close > 0.06 THEN 'material' WHEN abs(adj - close) / close > 0.04 THEN 'minor' ELSE 'none' END AS class FROM px")(
    lambda t: t.px.select("instrument_id", "d", F.when(F.abs(F.col("adj") - F.col("close")) / F.col("close") > 0.06, "material").when(F.abs(F.col("adj") - F.col("close")) / F.col("close") > 0.04, "minor").otherwise("none").alias("class"))
)
