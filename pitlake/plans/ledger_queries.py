"""Queries of the ledger and of portfolio risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlake.operators import ledger as lg
from pitlake.plans.registry import CTE, Tables, query
from pitlake.plans.research_queries import neat
from pitlake.sources import sinks

RUN = "OVER (PARTITION BY instrument_id ORDER BY trade_date, txn_id ROWS UNBOUNDED PRECEDING)"
IS_BUY, IS_SELL = "txn_type IN ('buy', 'transfer_in', 'opening_balance')", "txn_type IN ('sell', 'transfer_out')"
CTE["over"] = (("tx",), f"SELECT instrument_id, txn_id, trade_date, CAST(s - b AS DOUBLE) AS short FROM (SELECT *, sum(CASE WHEN {IS_BUY} THEN quantity ELSE 0 END) {RUN} AS b, sum(CASE WHEN {IS_SELL} THEN quantity ELSE 0 END) {RUN} AS s FROM tx) WHERE {IS_SELL} AND s > b")
CTE["okt"] = (("tx", "over"), "SELECT * FROM tx WHERE instrument_id NOT IN (SELECT instrument_id FROM over)")
#: Half to even at 6 places: a tie goes to the even neighbour.
_V = "(CAST(abs(total_amount) AS DOUBLE) / CAST(quantity AS DOUBLE) * 1e6)"
EVEN = f"CASE WHEN abs({_V} - floor({_V}) - 0.5) < 1e-5 THEN 2 * round(floor({_V}) / 2 + 0.25) ELSE round({_V}) END / 1e6"
LOTS = f"SELECT instrument_id, txn_id AS lot_id, trade_date AS acquired, CAST(quantity AS DOUBLE) AS quantity, {EVEN} AS basis, CAST(sum(quantity) {RUN} - quantity AS DOUBLE) AS c0, CAST(sum(quantity) {RUN} AS DOUBLE) AS c1 FROM {{}} WHERE {IS_BUY}"
CTE["lots"] = (("okt",), LOTS.format("okt"))
CTE["sells"] = (("okt",), f"SELECT instrument_id, txn_id AS sell_id, trade_date, CAST(quantity AS DOUBLE) AS sold, CAST(total_amount AS DOUBLE) AS amount, CAST(sum(quantity) {RUN} - quantity AS DOUBLE) AS s0, CAST(sum(quantity) {RUN} AS DOUBLE) AS s1 FROM okt WHERE {IS_SELL}")
CTE["clo"] = (("lots", "sells"), "SELECT l.instrument_id, lot_id, sell_id, trade_date AS closed, least(c1, s1) - greatest(c0, s0) AS quantity, amount * (least(c1, s1) - greatest(c0, s0)) / sold AS proceeds, basis * (least(c1, s1) - greatest(c0, s0)) AS cost, acquired FROM lots l JOIN sells s ON l.instrument_id = s.instrument_id AND c0 < s1 AND s0 < c1")

query("led_oversell", "over", "SELECT * FROM over")(lambda t: lg.oversells(t.tx))
query("led_fifo_lots", "tx", f"SELECT instrument_id, lot_id, acquired, quantity, basis, c0, c1 FROM ({LOTS.format('tx')})")(lambda t: lg.lots(t.tx).withColumns({c: F.col(c).cast("double") for c in ("c0", "c1")}))
query("led_fifo_closures", "clo", "SELECT instrument_id, lot_id, sell_id, closed, round(quantity, 6) AS quantity, round(proceeds, 7) AS proceeds, round(cost, 7) AS cost, round(proceeds - cost, 7) AS gain, CAST(closed - acquired AS INTEGER) AS days, closed - acquired > 365 AS long_term FROM clo")(
    lambda t: (lambda c: c.select("instrument_id", "lot_id", "sell_id", "closed", F.round("quantity", 6).alias("quantity"), *[F.round(x, 7).alias(x) for x in ("proceeds", "cost", "gain")], "days", "long_term"))(lg.closures(t.tx))
)
DAY = "1996-06-28"
OPEN = f"SELECT instrument_id, sum(remaining) AS quantity, sum(round_even(remaining * basis, 6)) AS basis FROM (SELECT l.instrument_id, l.basis, l.quantity - coalesce(g.gone, 0) AS remaining FROM lots l LEFT JOIN (SELECT instrument_id, lot_id, sum(quantity) AS gone FROM clo WHERE closed <= DATE '{DAY}' GROUP BY 1, 2) g USING (instrument_id, lot_id) WHERE acquired <= DATE '{DAY}') WHERE remaining > 0 GROUP BY 1"
query("led_open_positions", "lots clo", f"SELECT instrument_id, round(quantity, 4) AS quantity, round(basis, 2) AS basis FROM ({OPEN})")(
    lambda t: (lambda own: lg.open_positions(lg.lots(own), lg.closures(own), F.lit(DAY).cast("date")).select("instrument_id", F.round("quantity", 4).alias("quantity"), F.round("basis", 2).alias("basis")))(lg.covered(t.txo))
)
CTE["state"] = (
    ("lots", "clo"),
    "SELECT instrument_id, t, sum(q) OVER (PARTITION BY instrument_id ORDER BY t) AS quantity, sum(c) OVER (PARTITION BY instrument_id ORDER BY t) AS basis FROM (SELECT instrument_id, t, sum(q) AS q, sum(c) AS c FROM (SELECT instrument_id, acquired AS t, quantity AS q, quantity * basis AS c FROM lots UNION ALL SELECT instrument_id, closed, -quantity, -cost FROM clo) GROUP BY 1, 2)",
)
CTE["snap"] = (
    ("lots", "state", "cal", "px"),
    "SELECT instrument_id, d, quantity, basis, value, value / sum(value) OVER (PARTITION BY d) AS weight FROM (SELECT h.instrument_id, h.d, h.quantity, h.basis, h.quantity * px.adj AS value FROM (SELECT g.instrument_id, g.d, s.quantity, s.basis FROM (SELECT DISTINCT l.instrument_id, cal.d FROM lots l CROSS JOIN cal) g ASOF JOIN state s ON s.instrument_id = g.instrument_id AND g.d >= s.t WHERE s.quantity > 1e-9) h ASOF LEFT JOIN px ON px.instrument_id = h.instrument_id AND h.d >= px.d)",
)


def snapshots(t: Tables) -> DataFrame:
    own = lg.covered(t.txo)
    return lg.snapshots(lg.lots(own), lg.closures(own), t.cal, t.px)


query("led_snapshots", "snap", "SELECT instrument_id, d, round(quantity, 4) AS quantity, round(basis + 4.7e-7, 2) AS basis, round(value + 4.7e-7, 2) AS value, round(value - basis + 4.7e-7, 2) AS gain, round(weight, 8) AS weight FROM snap")(
    lambda t: snapshots(t).select("instrument_id", "d", F.round("quantity", 4).alias("quantity"), *[F.round(F.col(c) + 4.7e-7, 2).alias(c) for c in ("basis", "value", "gain")], F.round("weight", 8).alias("weight"))
)


def held(t: Tables) -> DataFrame:
    """The positions of one day, a row per instrument; written, as risk reads them many times."""
    if "held" not in t.__dict__:
        own, t.__dict__["px"] = lg.covered(t.txo), sinks.written(t.px, "px")
        one_day = lg.snapshots(lg.lots(own), lg.closures(own), t.cal.where(F.col("d") == F.lit(DAY).cast("date")), t.px)
        t.__dict__["held"] = sinks.written(one_day.join(F.broadcast(t.inst.select("instrument_id", "sector_id")), "instrument_id"), "held")
    return t.__dict__["held"]


CTE["held"] = (("snap", "inst"), f"SELECT instrument_id, sector_id, value, weight FROM snap JOIN inst USING (instrument_id) WHERE d = DATE '{DAY}'")
query("pf_weights", "held", "SELECT instrument_id, sector_id, round(value, 2) AS value, round(weight, 8) AS weight, CAST(row_number() OVER (ORDER BY value DESC, instrument_id) AS INTEGER) AS rank, round(weight * weight / sum(weight * weight) OVER (), 8) AS hhi_share, round(sum(weight) OVER (PARTITION BY sector_id), 8) AS sector_weight FROM held")(
    lambda t: lg.weights(held(t)).select("instrument_id", "sector_id", F.round("value", 2).alias("value"), F.round("weight", 8).alias("weight"), "rank", F.round("hhi_share", 8).alias("hhi_share"), F.round("sector_weight", 8).alias("sector_weight"))
)
CTE["panel0"] = (("px", "held"), "SELECT instrument_id, d, adj / lag(adj) OVER (PARTITION BY instrument_id ORDER BY d) - 1 AS r FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY d DESC) AS n FROM px WHERE instrument_id IN (SELECT instrument_id FROM held)) WHERE n <= 253")
CTE["panel"] = (("panel0", "held"), "SELECT * FROM panel0 WHERE r IS NOT NULL AND d IN (SELECT d FROM panel0 WHERE r IS NOT NULL GROUP BY d HAVING count(*) = (SELECT count(*) FROM held))")

def panel(t: Tables) -> DataFrame:
    if "panel" not in t.__dict__:
        t.__dict__["panel"] = sinks.written(lg.return_panel(t.px, held(t)), "panel")
    return t.__dict__["panel"]


def covariance(t: Tables) -> DataFrame:
    return lg.covariance(panel(t), held(t))


query("pf_return_panel", "panel", "SELECT instrument_id, d, round(r, 6) AS r FROM panel")(lambda t: panel(t).select("instrument_id", "d", F.round("r", 6).alias("r")))
CTE["cov"] = (("panel", "held"), "SELECT h.instrument_id AS i1, k.instrument_id AS i2, cov, corr FROM held h CROSS JOIN held k LEFT JOIN (SELECT a.instrument_id AS i1, b.instrument_id AS i2, covar_samp(a.r, b.r) AS cov, corr(a.r, b.r) AS corr FROM panel a JOIN panel b USING (d) GROUP BY 1, 2 HAVING count(*) >= 60) c ON c.i1 = h.instrument_id AND c.i2 = k.instrument_id")
query("pf_covariance", "cov", "SELECT i1, i2, round(cov, 6) AS cov, round(corr, 6) AS corr FROM cov")(lambda t: neat(covariance(t), "cov", "corr"))
CTE["fw"] = (("held",), "SELECT instrument_id, weight FROM held")
CTE["sig"] = (("cov", "fw"), "SELECT i1, a.weight AS w, sum(b.weight * cov) AS sw, sum(CASE WHEN i1 = i2 THEN cov END) AS var FROM cov JOIN fw a ON a.instrument_id = i1 JOIN fw b ON b.instrument_id = i2 GROUP BY 1, 2")
CTE["risk"] = (
    ("sig",),
    "SELECT i1 AS instrument_id, sqrt(var * 252) AS own_vol, sqrt(v * 252) AS portfolio_vol, w * sw / v AS risk_share, sw * 252 / sqrt(v * 252) AS marginal, sqrt(greatest(0, (v - 2 * w * sw + w * w * var) / ((1 - w) * (1 - w))) * 252) - sqrt(v * 252) AS diversification FROM sig CROSS JOIN (SELECT sum(w * sw) AS v FROM sig)",
)
for _key, _cols in (("pf_volatility", ("own_vol", "portfolio_vol")), ("pf_risk_contrib", ("risk_share", "marginal")), ("pf_diversification", ("diversification",))):
    query(_key, "risk", f"SELECT instrument_id, {', '.join(f'round({c}, 6) AS {c}' for c in _cols)} FROM risk")(lambda t, c=_cols: neat(lg.risk(covariance(t), held(t)).select("instrument_id", *c), *c))
CTE["dd"] = (("px",), "SELECT instrument_id, d, adj / max(adj) OVER (PARTITION BY instrument_id ORDER BY d) - 1 AS dd FROM px")
query("pf_drawdown", "dd", "SELECT instrument_id, round(arg_max(dd, d), 6) AS current, round(min(dd), 6) AS deepest FROM dd GROUP BY 1")(lambda t: neat(lg.drawdowns(t.px), "current", "deepest"))
CTE["idx"] = (("panel", "fw"), "SELECT d, exp(sum(ln(1 + r)) OVER (ORDER BY d)) AS v FROM (SELECT d, sum(weight * r) AS r FROM panel JOIN fw USING (instrument_id) GROUP BY 1)")
CTE["worst"] = (("idx",), "SELECT d AS trough, top_d AS peak, v / top - 1 AS dd FROM (SELECT d, v, max(v) OVER (ORDER BY d) AS top, arg_max(d, v) OVER (ORDER BY d) AS top_d FROM idx) WHERE (SELECT count(*) FROM idx) >= 60 ORDER BY v / top, d LIMIT 1")


def worst_window(t: Tables) -> DataFrame:
    return lg.worst_window(panel(t), held(t))


query("pf_worst_window", "held panel worst", "SELECT instrument_id, peak, trough, round(dd, 6) AS dd, round(contribution, 6) AS contribution FROM held LEFT JOIN (SELECT instrument_id, peak, trough, dd, exp(sum(ln(1 + r))) - 1 AS contribution FROM panel CROSS JOIN worst WHERE d > peak AND d <= trough GROUP BY 1, 2, 3, 4) USING (instrument_id)")(lambda t: neat(worst_window(t), "dd", "contribution"))
query("pf_correlation_flags", "cov", "SELECT i1, i2, round(corr, 6) AS corr, CAST(n AS INTEGER) AS n, corr >= 0.75 AS flagged FROM (SELECT *, row_number() OVER (PARTITION BY i1 ORDER BY corr DESC, i2) AS n FROM cov WHERE i1 <> i2 AND corr IS NOT NULL) WHERE n <= 3 OR corr >= 0.75")(
    lambda t: covariance(t).where("i1 <> i2 and corr is not null").withColumn("n", F.row_number().over(Window.partitionBy("i1").orderBy(F.desc("corr"), "i2"))).where("n <= 3 or corr >= 0.75").select("i1", "i2", F.round("corr", 6).alias("corr"), "n", (F.col("corr") >= 0.75).alias("flagged"))
)
query("pf_concentration_flags", "held", "SELECT 'position' AS kind, instrument_id AS id, round(weight, 8) AS weight FROM held WHERE weight > 0.15 UNION ALL SELECT 'sector', sector_id, round(sum(weight), 8) FROM held GROUP BY 2 HAVING sum(weight) > 0.35")(
    lambda t: (lambda h: h.where("weight > 0.15").select(F.lit("position").alias("kind"), F.col("instrument_id").alias("id"), F.round("weight", 8).alias("weight")).union(h.groupBy("sector_id").agg(F.sum("weight").alias("w")).where("w > 0.35").select(F.lit("sector"), "sector_id", F.round("w", 8))))(held(t))
)
query("pf_risk_notes", "risk fw dd", "SELECT instrument_id, 'diversifier' AS note FROM risk WHERE diversification > 0 UNION ALL SELECT instrument_id, 'risk over weight' FROM risk JOIN fw USING (instrument_id) WHERE risk_share > 1.5 * weight UNION ALL SELECT instrument_id, 'drawdown' FROM (SELECT instrument_id, min(dd) AS m FROM dd GROUP BY 1) JOIN fw USING (instrument_id) WHERE m < -0.25")(
    lambda t: (lambda r, f, d: r.where("diversification > 0").select("instrument_id", F.lit("diversifier").alias("note")).union(r.join(f, "instrument_id").where("risk_share > 1.5 * weight").select("instrument_id", F.lit("risk over weight"))).union(d.join(f, "instrument_id").where("deepest < -0.25").select("instrument_id", F.lit("drawdown"))))(
        lg.risk(covariance(t), held(t)), held(t).select("instrument_id", "weight"), lg.drawdowns(t.px)
    )
)


@query("led_rebuild_idempotent", "snap", "SELECT 'unchanged' AS status, count(*) AS n FROM snap")
def rebuilt(t: Tables) -> DataFrame:
    """Snapshots written, built again and compared by the guarded upsert: a rebuild changes nothing."""
    rows = snapshots(t).select("instrument_id", "d", *[F.round(c, 6).alias(c) for c in ("quantity", "weight")], *[F.round(c, 2).alias(c) for c in ("basis", "value")])
    path = sinks.scratch(t.spark, "snapshots")
    rows.write.parquet(path)
    return sinks.upsert_status(rows, t.spark.read.parquet(path), ["instrument_id", "d"], ["quantity", "weight", "basis", "value"]).groupBy("status").agg(F.count("*").alias("n"))
