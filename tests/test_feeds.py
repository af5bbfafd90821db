"""The security feed, resolution of vendor rows, versioned tables and streaming steps against sequential versions and restarts."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from pitlake.operators import native
from pitlake.sources import security_feed as sf
from pitlake.sources import sinks
from pitlake.sources.versioned import VersionedTable
from pitlake.streaming import events as st

D = dt.date


def ident(kind, value, start, end=None):
    return {"identifier_type": kind, "identifier_value": value, "valid_from": str(start), "valid_to": end and str(end), "exchange": "NYSE", "is_primary": True}


def security(seq, vid, identifiers, gone=None, reason=None, successor=None, **more):
    row = {"source": "fixture", "data_version": "v1", "seq": seq, "source_security_id": vid, "security_type": "common", "first_trade_date": "2015-01-01", "active": gone is None, "delisted": gone is not None, "delisting_date": gone and str(gone), "identifiers": identifiers}
    if gone:
        row |= {"delisting_reason": reason, "delisting": {"delisting_date": str(gone), "delisting_code": "M", "delisting_reason": reason, "successor_source_id": successor}}
    return row | more


def scenarios():
    t = lambda v, a, b=None: ident("TICKER", v, a, b)
    start = D(2015, 1, 1)
    return [
        security(1, "KEEP", [t("KEEP", start)], classifications=[{"scheme": "GICS", "valid_from": "2015-01-01", "sector": "Information Technology"}]),
        security(2, "RENAME", [t("OLD", start, D(2020, 6, 1)), t("NEW", D(2020, 6, 1))], lifecycle_events=[{"event_type": "ticker_changed", "effective_date": "2020-06-01"}]),
        security(3, "REUSE", [t("OLD", D(2021, 1, 1))]),
        security(4, "CASHACQ", [t("CASH", start, D(2019, 3, 1))], D(2019, 3, 1), "acquired_cash"),
        security(5, "STKACQ", [t("STK", start, D(2019, 6, 1))], D(2019, 6, 1), "merged_stock", "KEEP"),
        security(6, "BUST", [t("BUST", start, D(2018, 11, 1))], D(2018, 11, 1), "bankruptcy"),
        security(7, "UNK", [t("UNK", start, D(2019, 5, 1))], D(2019, 5, 1), "stopped"),
        security(8, "SPLIT", [t("SPL", start)]),
        security(9, "DIV", [t("DIV", start)]),
    ]


def feed_of(spark, tmp_path, rows, name):
    path = tmp_path / f"{name}.json"
    path.write_text("\n".join(map(json.dumps, rows)))
    return sf.read_feed(spark, str(path))


def test_nine_scenarios_and_a_rerun(spark, tmp_path):
    feed = feed_of(spark, tmp_path, scenarios(), "one")
    tables, held = sf.ingest(feed, sf.empty_store(spark))
    assert held.count() == 0
    count = {n: df.count() for n, df in tables.items()}
    assert count == {"master": 9, "identifiers": 10, "lifecycle": 1, "delistings": 4, "classifications": 1}
    ids = {r.source_security_id: r.security_id for r in tables["master"].collect()}
    assert {r.security_id: r.successor_id for r in tables["delistings"].where("successor_id is not null").collect()} == {ids["STKACQ"]: ids["KEEP"]}
    stored = {n: sinks.written(df.drop("change"), n) for n, df in tables.items()}
    again, held = sf.ingest(feed, stored)
    assert held.count() == 0 and all(df.where("change <> 'unchanged'").count() == 0 for df in again.values())
    later = scenarios()[:2]
    later[0]["identifiers"][0]["valid_to"] = "2022-01-01"
    later[1] |= {"primary_exchange": "AMEX", "data_version": "v2"}
    moved, _ = sf.ingest(feed_of(spark, tmp_path, later, "two"), stored)
    changes = {n: sorted((r.change, r["count"]) for r in df.groupBy("change").count().collect()) for n, df in moved.items()}
    assert changes["identifiers"] == [("closed", 1), ("kept", 7), ("unchanged", 2)]
    assert changes["master"] == [("kept", 7), ("superseded", 1), ("unchanged", 1)]
    # the reused ticker belongs to whom held it on the day
    rows = spark.createDataFrame([("fixture", "OLD", D(2016, 1, 1)), ("fixture", "OLD", D(2020, 8, 1)), ("fixture", "OLD", D(2021, 5, 1)), ("fixture", "UNK", D(2030, 1, 1)), ("fixture", "NONE", D(2016, 1, 1))], "source string, vendor_id string, d date")
    got = {(r.vendor_id, r.d): (r.security_id, r.problem) for r in native.resolve(rows, stored["master"], stored["identifiers"], "d").collect()}
    assert got == {
        ("OLD", D(2016, 1, 1)): (ids["RENAME"], None), ("OLD", D(2020, 8, 1)): (None, "unresolved_security"), ("OLD", D(2021, 5, 1)): (ids["REUSE"], None),
        ("UNK", D(2030, 1, 1)): (ids["UNK"], None), ("NONE", D(2016, 1, 1)): (None, "unresolved_security"),
    }
    terminal = spark.createDataFrame([(1, D(2019, 1, 1), "unknown", None, None, True), (2, D(2019, 1, 1), "unknown", -0.5, None, True), (3, D(2019, 1, 1), "bankruptcy", None, None, False), (3, D(2018, 1, 1), "bankruptcy", -1.0, None, True)], "security_id long, event_date date, rule string, terminal_return double, terminal_value double, resolved boolean")
    assert {r.security_id: r.state for r in native.terminal_state(terminal).collect()} == {1: "unresolved", 2: "resolved", 3: "unresolved"}


def test_missing_ids_and_empty_feeds(spark, tmp_path):
    rows = [security(1, None, []), security(2, "", [ident("ISIN", "X", D(2015, 1, 1))]), security(3, "A", None)]
    tables, held = sf.ingest(feed_of(spark, tmp_path, rows, "missing"), sf.empty_store(spark))
    assert [r.rule for r in held.collect()] == ["missing_permanent_id"] * 2
    assert tables["master"].count() == 1 and tables["identifiers"].count() == 0
    tables, held = sf.ingest(spark.createDataFrame([], sf.FEED), sf.empty_store(spark))
    assert held.count() == 0 and all(df.count() == 0 for df in tables.values())


def in_order(stored, records):
    """The records that are lost when one is taken after the other."""
    live, lost = list(stored), set()
    meets = lambda a, b: a[1:3] == b[1:3] and a[0] != b[0] and a[3] <= b[4] and b[3] <= a[4]
    for seq, rows in records:
        if any(meets(r, x) for r in rows for x in live):
            lost.add(seq)
            continue
        own = {(r[0], r[1], r[3]) for r in rows}
        live = [x for x in live if (x[0], x[1], x[3]) not in own] + rows
    return lost


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_identity_decisions_equal_the_sequence(spark, seed):
    rng = random.Random(seed)
    day = lambda n: D(2000, 1, 1) + dt.timedelta(days=n)
    some = lambda owner: (owner, rng.choice(["ISIN", "FIGI"]), f"v{rng.randrange(6)}", rng.randrange(0, 60) * 10)
    stored: list = []
    for owner in range(100, 108):
        o, kind, value, a = some(owner)
        row = (o, kind, value, day(a), day(a + 30))
        if not in_order(stored, [(0, [row])]):
            stored.append(row)
    records = []
    for seq in range(30):
        owner = rng.choice([100, 101, 102, *range(20)])
        rows = {}
        for _ in range(rng.randrange(1, 3)):
            o, kind, value, a = some(owner)
            rows[o, kind, day(a)] = (o, kind, value, day(a), day(a + rng.randrange(5, 60)))
        old = [x for x in stored if x[0] == owner]
        if old and rng.random() < 0.7:
            x = old[0]
            rows[x[0], x[1], x[3]] = (*x[:4], x[3] + dt.timedelta(days=1))
        records.append((seq, list(rows.values())))
    want = in_order(stored, records)
    feed = spark.createDataFrame([(seq, rows[0][0], [(k, v, a, b) for _, k, v, a, b in rows]) for seq, rows in records], "seq long, security_id long, identifiers array<struct<identifier_type:string,identifier_value:string,valid_from:date,valid_to:date>>")
    kept = spark.createDataFrame(stored, "security_id long, identifier_type string, identifier_value string, valid_from date, valid_to date")
    assert {r.seq for r in sf.conflicts(feed, kept).collect()} == want and want


def test_versioned_table_replaces_touched_parts_once(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "k long, v string", F.col("k") % 3)
    assert table.read().count() == 0
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    upsert = lambda stored, new: stored.join(new, "k", "left_anti").unionByName(new)
    assert table.merge(rows((1, "a"), (2, "b"), (4, "c")), upsert, "w", 0)
    before = table.manifest()["parts"]
    assert table.merge(rows((4, "d"), (7, "e")), upsert, "w", 1)
    assert table.manifest()["parts"]["2"] == before["2"] and table.manifest()["parts"]["1"] != before["1"]
    assert not table.merge(rows((9, "x")), upsert, "w", 1)
    assert not table.merge(rows(), upsert, "w", 0)
    assert {tuple(r) for r in table.read().collect()} == {(1, "a"), (2, "b"), (4, "d"), (7, "e")}
    with pytest.raises(Exception, match="[Ee]xist"):  # another writer has taken the version
        table._commit(table.manifest())


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def write_events(spark, path, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(path)


def stream_of(spark, path):
    return spark.readStream.schema(EVENTS).parquet(path)


def test_steps_go_on_where_they_stopped(spark, tmp_path):
    rng = random.Random(7)
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [(i, at(i * 2 + rng.random()), rng.randrange(5), rng.choice("abc"), float(i), "{}") for i in range(60)]
    rows = [r for r in rows if not (r[2] == 3 and r[0] > 20)]  # one user falls silent
    path, half = str(tmp_path / "in"), len(rows) // 2
    got = {}
    for n, part in enumerate((rows[:half], rows[half:])):
        write_events(spark, path, part)
        roots = {name: str(tmp_path / name) for name in ("changes", "stale", "ingest", "bars", "enrich")}
        got["changes"] = {r.event_id for r in st.append_on_change(stream_of(spark, path), roots["changes"]).collect()}
        got["stale"] = sorted((r.feed, r.since) for r in st.stale_feeds(stream_of(spark, path), roots["stale"], "user_id", "20 hours").collect())
        got["ingest"] = {(r.user_id, r.event_type): r.event_id for r in st.incremental_ingest(stream_of(spark, path), roots["ingest"]).collect()}
        got["bars"] = {(r.event_type, r.d): r.n for r in st.kept_bars(stream_of(spark, path).withWatermark("ts", "1 hour"), roots["bars"]).collect()}
        seen = rows[: half if n == 0 else len(rows)]
        last, changed, newest = {}, set(), {}
        for i, _, user, kind, _, _ in seen:
            if last.get(user) != kind:
                changed.add(i)
            last[user] = kind
            newest[user, kind] = i
        assert got["changes"] == changed and got["ingest"] == newest
        silences = []
        for user in {r[2] for r in seen}:
            own = [r[1] for r in seen if r[2] == user]
            silences += [(str(user), a) for a, b in zip(own, [*own[1:], max(r[1] for r in seen)], strict=True) if b - a > dt.timedelta(hours=20)]
        assert got["stale"] == sorted(silences) and silences
        assert sum(got["bars"].values()) == len(seen)
    # a batch that comes again changes nothing
    state = VersionedTable(spark, f"{tmp_path}/changes/results", "user_id long, event_id long, event_type string, batch long", F.col("batch"))
    version = state.manifest()["version"]
    st.append(state, spark.createDataFrame([(1, 1, "z")], "user_id long, event_id long, event_type string"), 1)
    assert state.manifest()["version"] == version


def test_yearly_sink_replaces_the_same_years(spark, tmp_path):
    path = str(tmp_path / "years")
    rows = spark.range(5000).select(F.col("id"), F.expr("date_add(date'2020-06-01', cast(id % 400 as int))").alias("d"))
    sinks.write_years(rows, path, "d", rows=700)
    assert max(r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()) < 1500
    sinks.write_years(rows.where("year(d) = 2021").limit(3), path, "d")
    assert {r.year: r["count"] for r in spark.read.parquet(path).groupBy("year").count().collect()} == {2020: rows.where("year(d) = 2020").count(), 2021: 3}


def test_tables_of_the_feed_are_not_sent_to_the_driver(spark):
    """What grows with the feed is joined by a shuffle, however small its files are."""
    rows = spark.createDataFrame([("vendor", "P1", dt.date(2020, 1, 1))], "source string, vendor_id string, d date")
    store = sf.empty_store(spark)
    plans = [native.resolve(rows, store["master"], store["identifiers"], "d"), *sf.flatten(spark.createDataFrame([], sf.FEED).withColumn("security_id", F.lit(1).cast("long")), store["master"].select("source", "source_security_id", "security_id")).values()]
    told = [df._jdf.queryExecution().sparkPlan().toString() for df in plans]
    assert any("SortMergeJoin" in plan for plan in told) and not any("BroadcastHashJoin" in plan for plan in told)
