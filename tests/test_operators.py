"""Operators against hand-made cases: null rules, look-ahead, folds, and reruns."""

import datetime as dt
import decimal
import functools
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from pitlake import plans
from pitlake.operators import analogues, evaluate, integrity, regimes, systems
from pitlake.operators import features as ft
from pitlake.operators import ledger, pit, quality, research, securities
from pitlake.plans import evaluate_queries
from pitlake.plans.registry import Tables
from pitlake.sources import panel as panel_source
from pitlake.sources import sinks

SF = "/root/testdata/sf0.001"
DAY = dt.date(2026, 1, 5)


def day(n):
    return DAY + dt.timedelta(days=n)


def panel(spark, closes, instrument=1):
    rows = [(instrument, day(i), c, c * 1.02, c * 0.98, c, c, 1000) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "instrument_id long, d date, open double, high double, low double, close double, adj double, volume long")


def test_entry_and_registration(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(plans.QUERIES) == len(plans.ORACLE_SQL) == 267
    assert len(__spark_entry__.queries()) == 267 + 14 * os.path.isdir(os.path.join(os.path.dirname(plans.__file__), "..", "llm"))  # none vanishes for want of a library


def test_rolling_needs_a_full_window(spark):
    got = ft.price_features(panel(spark, [100.0 + i for i in range(60)])).orderBy("d").collect()
    assert [r.price_to_ma50 is None for r in got] == [True] * 49 + [False] * 11
    assert got[49].price_to_ma50 == pytest.approx(149 / 124.5 - 1)
    assert got[21].ret_21d == pytest.approx(121 / 100 - 1)
    assert got[0].log_ret_1d is None


def test_latest_published_row_wins_even_when_null(spark):
    obs = spark.createDataFrame([("A", day(0), 1.0, day(2)), ("A", day(1), None, day(3)), ("A", day(2), 3.0, day(9))], "code string, obs_date date, value double, available_from date")
    days = spark.createDataFrame([(day(i),) for i in range(6)], "d date")
    aligned = {r.d: r.value for r in pit.align_availability(days, obs).collect()}
    assert [aligned[day(i)] for i in range(6)] == [None, None, 1.0, None, None, None]
    carried = {r.d: r.value for r in pit.align_availability(days, obs.where("value is not null")).collect()}
    assert [carried[day(i)] for i in range(6)] == [None, None, 1.0, 1.0, 1.0, 1.0]


def test_later_rows_never_change_earlier_features(spark):
    px = panel(spark, [100.0 + (i * 37) % 11 for i in range(90)])
    cut = F.lit(day(60))
    poisoned = px.withColumn("adj", F.when(F.col("d") > cut, F.col("adj") * 99).otherwise(F.col("adj"))).withColumn("close", F.when(F.col("d") > cut, 0.01).otherwise(F.col("close")))
    before = ft.price_features(px).where(F.col("d") <= cut)
    after = ft.price_features(poisoned).where(F.col("d") <= cut)
    assert before.exceptAll(after).count() == 0 == after.exceptAll(before).count()


def test_return_jump_is_a_fold_over_accepted_rows(spark):
    random.seed(1)
    closes = [100.0 * random.choice([1, 1, 1.3, 2.0, 0.5]) for _ in range(200)]
    split = {day(i) for i in range(0, 200, 17)}
    last, want = None, []
    for i, c in enumerate(closes):
        if last is not None and day(i) not in split and abs(c / last - 1) > 0.4:
            want.append((day(i), c, last))
        else:
            last = c
    splits = spark.createDataFrame([(1, d) for d in split], "instrument_id long, d date")
    got = quality.return_jumps(panel(spark, closes).select("instrument_id", "d", "close"), splits).orderBy("d").collect()
    assert [(r.d, r.close, r.previous) for r in got] == want


def test_fifo_equals_sequential_replay(spark):
    random.seed(2)
    rows, held = [], 0
    for i in range(150):
        q = random.randint(1, 20)
        if held >= q and random.random() < 0.5:
            rows.append((i, "sell", day(i), 1, q, 10.0 * q))
            held -= q
        else:
            rows.append((i, "buy", day(i), 1, q, -7.0 * q))
            held += q
    lots, want = [], []
    for i, kind, _, _, q, _ in rows:
        if kind == "buy":
            lots.append([i, q])
        while kind == "sell" and q:
            take = min(q, lots[0][1])
            want.append((lots[0][0], i, float(take)))
            lots[0][1] -= take
            q -= take
            if not lots[0][1]:
                lots.pop(0)
    tx = spark.createDataFrame(rows, "txn_id long, txn_type string, trade_date date, instrument_id long, quantity int, total_amount double").withColumn("quantity", F.col("quantity").cast("decimal(20,8)")).withColumn("total_amount", F.col("total_amount").cast("decimal(20,6)"))
    got = [(r.lot_id, r.sell_id, r.quantity) for r in ledger.closures(tx).collect()]
    assert sorted(got) == sorted(want)
    short = tx.union(spark.createDataFrame([(999, "sell", day(999), 1, 10**6, 1.0)], "a long, b string, c date, d long, e int, f double"))
    assert ledger.oversells(short).count() == 1
    assert ledger.closures(short).count() == 0


def test_overlap_inflation_equals_the_double_sum(spark):
    random.seed(3)
    dates = [random.randint(0, 120) for _ in range(60)]
    rows = spark.createDataFrame([("s", i, day(n)) for i, n in enumerate(dates)], "study string, instrument_id int, d date")
    width = 1.4 * 10
    want = sum(max(0.0, 1 - abs(a - b) / width) for a in dates for b in dates) / len(dates)
    assert research.overlap_inflation(rows, ["study"], 10).first().inflation == pytest.approx(want)


def test_greedy_gap_equals_a_loop(spark):
    random.seed(4)
    positions = random.sample(range(400), 60)
    rows = [(1, day(999), rank + 1, pos, day(pos), 1.0) for rank, pos in enumerate(positions)]
    kept = []
    for pos in positions:
        if all(abs(pos - k) >= 10 for k in kept):
            kept.append(pos)
    matches = spark.createDataFrame(rows, "instrument_id long, as_of date, rank int, pos int, d date, similarity double")
    assert [r.pos for r in analogues.dedup_gap(matches).orderBy("rank").collect()] == kept


def test_first_regime_that_holds_is_active(spark):
    table = spark.createDataFrame([("f", 1, "x", ">=", 0.5, "strong"), ("f", 2, "x", ">=", 0.1, "weak"), ("g", 1, "y", "<=", 0.0, "down")], "family string, priority int, feature string, op string, `limit` double, label string")
    values = spark.createDataFrame([(1, "x", 0.7), (1, "y", None), (2, "x", 0.2), (2, "y", -1.0), (3, "x", 0.0)], "d int, feature string, value double")
    assert {(r.d, r.family, r.label) for r in regimes.active(values, table, ["d"]).collect()} == {(1, "f", "strong"), (2, "f", "weak"), (2, "g", "down")}


def test_sinks_write_nothing_on_a_rerun(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, None)], "k long, v double")
    assert sinks.insert_absent(rows, rows, ["k"]).count() == 0
    assert {r.status for r in sinks.upsert_status(rows, rows, ["k"], ["v"]).collect()} == {"unchanged"}
    more = rows.union(spark.createDataFrame([(3, 1.0)], "k long, v double")).withColumn("v", F.when(F.col("k") == 2, 5.0).otherwise(F.col("v")))
    assert {(r.k, r.status) for r in sinks.upsert_status(more, rows, ["k"], ["v"]).collect()} == {(1, "unchanged"), (2, "update"), (3, "insert")}


def test_empty_tables(spark):
    empty = panel(spark, [1.0]).limit(0)
    assert ft.price_features(empty).count() == 0
    assert research.path_excursions(empty, 21).count() == 0
    assert quality.stale_runs(empty).count() == 0


def test_portfolio_risk_covers_all_positions(spark):
    run = lambda key: __spark_entry__.queries()[key](spark, "/root/testdata/sf0.01")
    names = {r.instrument_id for r in run("pf_weights").collect()}
    risk = {r.instrument_id for r in run("pf_risk_contrib").collect()}
    assert len(names) > 4 and risk == names


def test_covariance_needs_sixty_shared_dates(spark):
    rng = random.Random(3)
    closes = {i: [100 * (1 + rng.random() / 10) for _ in range(61)] for i in range(6)}
    names = spark.createDataFrame([(i, (i + 1) / 21) for i in closes], "instrument_id long, weight double")
    for n, known in ((61, True), (60, False)):
        px = functools.reduce(lambda a, b: a.union(b), [panel(spark, c[:n], i) for i, c in closes.items()])
        returns = ledger.return_panel(px, names)
        cov = ledger.covariance(returns, names)
        assert [r.cov is not None for r in cov.collect()] == [known] * 36
        risk = ledger.risk(cov, names).collect()
        window = ledger.worst_window(returns, names).collect()
        assert len(risk) == len(window) == 6
        assert {r.portfolio_vol is not None for r in risk} == {r.dd is not None for r in window} == {known}
        if known:
            r = np.array([np.diff(c) / c[:-1] for c in map(np.array, closes.values())])
            w = np.arange(1, 7) / 21
            assert risk[0].portfolio_vol == pytest.approx(np.sqrt(w @ np.cov(r) @ w * 252))


def test_bootstrap_of_the_paired_difference(spark):
    rng = random.Random(5)
    cells = [(i, day(d), 21, system, rng.random() < p) for i in range(3) for d in range(30 + i) for system, p in (("combined", 0.7), ("baseline", 0.4))]
    rows = spark.createDataFrame([*cells, (9, day(0), 21, "combined", True)], "instrument_id long, as_of date, horizon int, system string, hit boolean")
    got = evaluate.block_bootstrap(evaluate.paired(rows, "hit", "combined", "baseline"), ["horizon"], "hit", 1000).first()
    mean = lambda s: np.mean([h for *_, system, h in cells if system == s])
    series = [np.array([h for j, *_, s, h in cells if (j, s) == (i, "combined")], float) - [h for j, *_, s, h in cells if (j, s) == (i, "baseline")] for i in range(3)]
    draws = []
    for _ in range(1000):
        taken = [x[[(s + j) % len(x) for b in range(0, len(x), 4) for s in [rng.randrange(len(x))] for j in range(min(4, len(x) - b))]] for x in series]
        draws.append(np.concatenate(taken).mean())
    assert got.point == pytest.approx(mean("combined") - mean("baseline"))
    assert (got.low, got.high) == pytest.approx(tuple(np.percentile(draws, [2.5, 97.5])), abs=0.03)


def test_predictions_cover_every_session(spark):
    t = Tables(spark, SF)
    sessions = ft.price_features(t.px).where("ret_21d is not null and price_to_ma50 is not null").count()
    assert evaluate_queries.predictions(t).count() == 4 * sessions > 0
    kept = evaluate_queries.predictions(t).groupBy("instrument_id").agg(F.count_distinct("as_of").alias("n"), F.count_distinct(F.trunc("as_of", "month")).alias("months"))
    assert kept.where("n > months").count() > 0


def test_model_analytics_by_hand(spark):
    """Weights, sides and errors per model: effects of 0 take no side, a null outcome scores nothing."""
    cells = [
        ([("a", 0.75, 0.04), ("b", 0.25, -0.04)], 0.02, 0.03),
        ([("a", 0.5, -0.02), ("b", 0.5, 0.0)], -0.01, 0.01),
        ([("a", 1.0, 0.01)], 0.0, -0.05),
        ([("a", 1.0, 0.02)], 0.02, None),
    ]
    rows = spark.createDataFrame([("s", *c) for c in cells], "system string, contributions array<struct<model string, weight_share double, effect double>>, expected_excess double, realized_excess double")
    a, b = evaluate.model_analytics(rows, ["system"]).orderBy("model").collect()
    assert (a.n, b.n) == (4, 2)
    assert (a.weight_share, a.contribution, a.mean_effect) == pytest.approx((3.25 / 4, (0.03 + 0.01 + 0.01 + 0.02) / 4, 0.05 / 4))
    assert (a.agreement, a.contradiction, a.hit_rate, a.edge) == pytest.approx((1.0, 0.0, 1 / 3, -1 / 6))
    assert (a.mae, a.naive_mae, a.information_gain) == pytest.approx(((0.01 + 0.03 + 0.06) / 3, 0.03, 0.03 - 0.1 / 3))
    assert (b.weight_share, b.contribution, b.mean_effect, b.agreement, b.contradiction, b.hit_rate, b.mae, b.naive_mae) == pytest.approx((0.375, 0.005, -0.02, 0.0, 1.0, 0.0, 0.07, 0.03))


def test_models_of_every_evaluated_prediction_are_analysed(spark):
    t = Tables(spark, SF)
    rows = evaluate_queries.prepared(t)
    parts = F.aggregate("contributions", F.lit(0.0), lambda s, c: s + c.weight_share * c.effect)
    assert rows.where(F.abs(parts - F.col("expected_excess")) > 1e-12).count() == 0
    n = {r.system: r.n for r in rows.groupBy("system").agg(F.count("*").alias("n")).collect()}
    got = {(r.system, r.model): r.n for r in __spark_entry__.queries()["ev_model_analytics"](spark, SF).collect()}
    assert got == {("baseline", "momentum"): n["baseline"], ("combined", "momentum"): n["combined"], ("combined", "trend"): n["combined"]}


def test_outcomes_of_bands_have_the_worst_of_the_path(spark):
    rng = random.Random(8)
    closes = [100 * (1 + rng.random()) for _ in range(12)]
    moves = {(r.d, r.horizon): r.adverse for r in research.adverse_moves(panel(spark, closes), (2, 5)).collect()}
    for i, c in enumerate(closes):
        for h in (2, 5):
            want = min(closes[i + 1 : i + h + 1]) / c - 1 if i + h < len(closes) else None
            assert moves[day(i), h] == (want if want is None else pytest.approx(want))
    cells = [(10.0, 0.1, -0.2), (20.0, -0.1, -0.4), (24.9, 0.3, None), (50.0, 0.2, -0.1)]
    rows = spark.createDataFrame([("s", *c) for c in cells], "system string, score double, realized_excess double, adverse double")
    got = {r.label: (r.n, r.mean_excess, r.median_adverse, r.p_positive) for r in evaluate.band_outcomes(rows, ["system"]).collect()}
    assert got == {"strong keep": (3, pytest.approx(0.1), pytest.approx(-0.3), pytest.approx(2 / 3)), "neutral": (1, 0.2, -0.1, 1.0)}
    assert all(r.median_adverse is not None for r in __spark_entry__.queries()["wf_band_outcomes"](spark, SF).collect())


def test_seven_labels_of_scored_days(spark):
    """The limits of each label; missing values and zeros that stand for them; an unknown trend alone has no row."""
    names = "bull double, pctile double, move double, accel double, breadth double, lead double, since int"
    cells = [(1.0, 0.8, 0.26, 0.1, 0.7, 0.1, 10), (0.0, 0.2, -0.26, 0.0, 0.3, -0.1, 11), (None, None, None, None, None, None, None), (None, 0.0, 0.25, -0.1, 0.0, 0.0, 0)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cells)], f"id int, {names}")
    found = regimes.labelled(rows)
    assert found.columns == ["id", "dimension", "regime"]
    got = {i: {r.dimension: r.regime for r in found.where(F.col("id") == i).collect()} for i in range(4)}
    rest = ("mid", "stable", "decelerating", "mixed", "lagging")
    assert got[0] == dict(zip(regimes.DIMENSIONS, ("bull", "high", "rising", "accelerating", "strong", "leading", "post")))
    assert got[1] == dict(zip(regimes.DIMENSIONS, ("bear", "low", "falling", "decelerating", "weak", "lagging", "outside")))
    assert got[2] == dict(zip(regimes.DIMENSIONS[1:], (*rest, "outside")))
    assert got[3] == dict(zip(regimes.DIMENSIONS[1:], (*rest, "post")))


def test_every_evaluated_prediction_counts_once_a_dimension(spark):
    n = {(r.system, r.horizon): r.n for r in evaluate_queries.prepared(Tables(spark, SF)).groupBy("system", "horizon").agg(F.count("*").alias("n")).collect()}
    rows = __spark_entry__.queries()["wf_regime_labels"](spark, SF)
    got = {(r.dimension, r.system, r.horizon): r.n for r in rows.groupBy("dimension", "system", "horizon").agg(F.sum("n").alias("n")).collect()}
    assert {d for d, *_ in got} == set(regimes.DIMENSIONS)
    assert all(c == n[k] if d != "trend" else 0 < c < n[k] for (d, *k), c in got.items() for k in [tuple(k)])


def test_overlaps_of_a_hot_key_are_found_once_and_spread(spark):
    """Pairs equal brute force with blocks of a few owners, and a key's pairs come from many partitions."""
    rng = random.Random(11)
    rows = [(f"K{rng.randrange(2)}", rng.randrange(60), day(s), None if rng.random() < 0.2 else day(s + rng.randrange(40))) for s in (rng.randrange(200) for _ in range(240))]
    got = securities.overlaps(spark.createDataFrame(rows, "identifier string, security_id long, valid_from date, valid_to date"), "identifier", "security_id", block=8)
    met = lambda x, y: x[2] < (y[3] or dt.date.max) and y[2] < (x[3] or dt.date.max)
    found = [tuple(r) for r in got.collect()]
    assert sorted(found) == sorted({(x[0], x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1] and met(x, y)})
    spread = got.withColumn("p", F.spark_partition_id()).groupBy("identifier").agg(F.count_distinct("p").alias("n"))
    assert min(r.n for r in spread.collect()) > 1


def test_ledger_of_one_instrument_is_sorted_in_parts(spark, monkeypatch):
    """Places and closures of one instrument come from many partitions, and equal a plain FIFO loop when lots reach over parts."""
    monkeypatch.setattr(ledger, "CUTS", 7)
    rng, txns, lots, want, stock = random.Random(17), [], [], [], 0
    for i in range(120):
        buy = stock < 20 or rng.random() < 0.5
        q = rng.choice([1, 3, 90]) if buy else rng.randrange(1, 20)
        stock += q if buy else -q
        txns.append((1, i, "buy" if buy else "sell", day(i // 4), decimal.Decimal(q), decimal.Decimal(10 * q)))
        if buy:
            lots.append([i, q])
        while not buy and q:
            n = min(q, lots[0][1])
            want.append((lots[0][0], i, float(n)))
            q, lots[0][1] = q - n, lots[0][1] - n
            lots = lots if lots[0][1] else lots[1:]
    tx = spark.createDataFrame(txns, "instrument_id long, txn_id long, txn_type string, trade_date date, quantity decimal(20,8), total_amount decimal(20,6)")
    assert sorted(tuple(r) for r in ledger.closures(tx).select("lot_id", "sell_id", "quantity").collect()) == sorted(want)
    placed = ledger.placed(tx.repartition(4)).withColumn("p", F.spark_partition_id())
    assert placed.select("p").distinct().count() > 1
    bought = {i: sum(int(t[4]) for t in txns[: i + 1] if t[2] == "buy") for i in range(120)}
    assert {r.txn_id: int(r["_b"]) for r in placed.collect()} == bought


def test_transactions_are_numbered_in_parts(spark, monkeypatch):
    whole = panel_source.ledger(spark, SF).select("instrument_id", "txn_id", "trade_date", "quantity", "total_amount")
    monkeypatch.setattr(panel_source, "ORDERS", 100)
    assert panel_source.ledger(spark, SF).select(*whole.columns).exceptAll(whole).count() == 0
    own = panel_source.ledger(spark, SF).where("txn_id > 0").groupBy("instrument_id").agg(F.min("txn_id").alias("a"), F.max("txn_id").alias("b"), F.count_distinct("txn_id").alias("n"), F.count("*").alias("m"))
    assert own.where("a <> 1 or b <> n or n <> m").count() == 0


def test_calendar_covers_all_events(spark):
    got = __spark_entry__.queries()["src_calendar"](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/events.parquet").count() > 0


def test_regime_grammar(spark):
    """The first rule whose conditions all hold wins; a missing value, or a quantile of under 252 rows, makes it inactive."""
    from pitlake.operators import grammar as gr

    assert {m: len(t.strip().splitlines()) for m, t in gr.TEXTS.items()} == {"sector": 52, "momentum": 23, "valuation": 22, "earnings": 21, "macro": 35, "relative": 22}
    day = dt.date(2020, 1, 1)
    rows = [(1, day + dt.timedelta(days=i), "x", float(i)) for i in range(300)] + [(2, day + dt.timedelta(days=i), "x", float(i)) for i in range(100)] + [(1, day, "y", 1.0)]
    history = spark.createDataFrame(rows, "k int, d date, feature string, value double")
    grid = spark.createDataFrame([(day + dt.timedelta(days=400),)], "as_of date")
    states = gr.state(history, grid, ["k"], [0.2, 0.8])
    table = spark.createDataFrame(
        [
            ("m", "f", 0, "both", 2, "x", ">=", 0.8, None), ("m", "f", 0, "both", 2, "gone", ">", None, 0.0),
            ("m", "f", 1, "high", 1, "x", ">=", 0.8, None), ("m", "f", 2, "any", 1, "x", ">=", None, 0.0), ("m", "g", 3, "low", 1, "x", "<=", 0.2, None),
        ],
        gr.SCHEMA,
    )
    got = {(r.k, r.family): r.label for r in gr.active(states, table, ["k", "as_of"], [0.2, 0.8]).collect()}
    assert got == {(1, "f"): "high", (2, "f"): "any"}


def test_known_evidence_and_verdict(spark):
    """Outcomes count from the day they are complete; verdicts follow label and sign."""
    from pyspark.sql import functions as F

    from pitlake.operators import grammar as gr

    a, b = dt.date(2020, 1, 1), dt.date(2020, 2, 1)
    rows = spark.createDataFrame([("m", a, 0.1), ("m", b, 0.3), ("m", b, 0.2), ("m", b, None)], "mark string, exit_day date, fwd double")
    got = {r.exit_day: (r.n, round(r.s, 6)) for r in gr.known_evidence(rows, ["mark"]).collect()}
    assert got == {a: (1, 0.1), b: (3, 0.6)}
    cases = spark.createDataFrame([("cheap, weak growth", -0.1), ("expensive, strong margins", 0.1), ("trailing P/E ≥ p90", -0.1), ("multiple expansion", 0.1)], "label string, effect double")
    words = [r[0] for r in cases.select(gr.verdict(F.col("label"), F.col("effect"))).collect()]
    assert words == ["Cheap because fundamentals are deteriorating (value-trap history)", "Expensive but historically justified by quality", "Expensive and historically vulnerable", "Historically favorable setup"]


def test_fifo_against_a_queue(spark):
    """Random buys and sells, several at one place of the quantity axis and with eight decimals, against a queue."""
    from decimal import Decimal

    rnd, rows, expected = random.Random(5), [], []
    for inst in range(4):
        queue, held, day = [], Decimal(0), dt.date(2000, 1, 1)
        for n in range(60):
            day += dt.timedelta(days=rnd.randrange(3))
            q = Decimal(rnd.choice([1, 2, 5])) + Decimal(rnd.randrange(3)) / Decimal(10**8)
            if held >= q and rnd.random() < 0.5:
                rows.append((inst, n, "sell", day, q, Decimal(10) * q))
                held, left = held - q, q
                while left:
                    lot, has = queue[0]
                    take = min(has, left)
                    expected.append((inst, lot, n, float(take)))
                    left, queue[0] = left - take, (lot, has - take)
                    if not queue[0][1]:
                        queue.pop(0)
            else:
                rows.append((inst, n, "buy", day, q, -Decimal(7) * q))
                queue.append((n, q))
                held += q
    rows += [(9, 0, "sell", dt.date(2000, 1, 1), Decimal(1), Decimal(1)), (9, 1, "buy", dt.date(2000, 1, 2), Decimal(5), Decimal(-1))]  # oversold: left out
    tx = spark.createDataFrame(rows, "instrument_id long, txn_id long, txn_type string, trade_date date, quantity decimal(20,8), total_amount decimal(20,6)")
    got = [tuple(r) for r in ledger.closures(tx).select("instrument_id", "lot_id", "sell_id", "quantity").collect()]
    assert sorted(got) == sorted(expected)
    assert [r.txn_id for r in ledger.oversells(tx).collect()] == [0]


def test_systems_against_pairs_of_models(spark):
    """The variance by sums equals the double sum over pairs of models."""
    models = {"a": (0.02, 0.01), "b": (-0.01, 0.02), "c": (0.03, 0.015)}
    rows = [(1, dt.date(2000, 1, 1), m, e, s, 0.5) for m, (e, s) in models.items()]
    df = spark.createDataFrame(rows, "instrument_id long, as_of date, model string, effect double, se double, rho double")
    got = systems.combine(df, systems.CELL, "a", ("b",)).first()
    w = {m: 1 / s**2 for m, (_, s) in models.items()}
    effect = sum(w[m] * models[m][0] for m in w) / sum(w.values())
    rho = lambda x, y: 1 if x == y else 0.5 if {x, y} == {"a", "b"} else 0.2
    v = sum(w[x] * w[y] * rho(x, y) * models[x][1] * models[y][1] for x in w for y in w)
    z = effect / (v**0.5 / sum(w.values()))
    assert abs(got.effect - effect) < 1e-12
    assert abs(got.score - 50 * (1 + math.erf(min(z, 4) / 2**0.5))) < 1e-3
    assert abs(got.confidence - 3 / 5 * (w["a"] + w["c"]) / sum(w.values())) < 1e-12
    assert {s for s, _, _ in systems.memberships(list("abc"), "a", (0.25, 0.5), 0.5)} == {"baseline", "shadow", "alone", "combined", "rho_25"}


def test_headers_of_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3,4\n")
    (tmp_path / "b.csv").write_text("x,z\n" + "1,2\n" * 50)
    found = {r.file.rsplit("/", 1)[1]: (r.rows, r.missing) for r in integrity.header_check(spark.read.text(str(tmp_path)), ("x", "y")).collect()}
    assert found == {"a.csv": (2, []), "b.csv": (50, ["y"])}


def test_parity_and_empty_tables(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 1.0), (4, 1.0)], "k int, value double")
    b = spark.createDataFrame([(1, 1.0), (2, None), (3, 1.1), (5, 1.0)], "k int, value double")
    got = {r.k: (r.both_null, r.outside) for r in integrity.parity(a, b, ["k"], 1e-6).collect()}
    assert got == {1: (False, False), 2: (True, False), 3: (False, True), 4: (False, True), 5: (False, True)}
    assert integrity.parity(a.limit(0), b.limit(0), ["k"], 0.0).isEmpty()


def test_bars_of_one_pass_equal_bars_from_lines(spark, tmp_path):
    """The three panels of bars read the lines once, and so do reports the orders."""
    from pitlake.plans.registry import Stored, Tables

    sf = str(tmp_path / "sf")
    lines = [(k % 7, k % 3 + 1, k % 5, float(k % 4 + 1), 10.0 * (k % 11) + k / 7, (k % 10) / 100, "F", f"1995-01-0{k % 3 + 1}") for k in range(300)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_linestatus string, l_shipdate string").write.parquet(f"{sf}/lineitem.parquet")
    spark.createDataFrame([(k, k % 4) for k in range(5)], "s_suppkey long, s_nationkey int").write.parquet(f"{sf}/supplier.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(4)], "n_nationkey int, n_regionkey int").write.parquet(f"{sf}/nation.parquet")
    t = Stored(spark, sf)
    of = {"px": lambda s: (s % 4,), "sx": lambda s: (s % 4 % 2,), "bm": lambda s: ()}
    for name, key in of.items():
        groups = {}
        for o, n, s, q, x, disc, _, d in lines:
            groups.setdefault((*key(s), d), []).append((o, n, x / q, q, x, disc))
        want = {k: (min(g)[2], max(r[2] for r in g), min(r[2] for r in g), sum(r[4] for r in g) / sum(r[3] for r in g), sum(r[4] * (1 - r[5]) for r in g) / sum(r[3] for r in g), sum(r[3] for r in g)) for k, g in groups.items()}
        keys = [c for c in ("instrument_id", "sector_id") if c in getattr(t, name).columns]
        got = {(*[r[c] for c in keys], str(r.d)): (r.open, r.high, r.low, r.close, r.adj, r.volume) for r in getattr(t, name).collect()}
        assert set(got) == set(want)
        for k, w in want.items():
            assert all(abs(a - b) < 1e-5 for a, b in zip(got[k], w, strict=True)), (name, k)
    table = Tables(spark, sf)
    table.sums, table.fu = t.sums, spark.createDataFrame([], "instrument_id long, as_of date, eps double")
    for name in ("px", "bm", "sx", "ea"):
        plan = getattr(table, name)._jdf.queryExecution().toString()
        assert "lineitem" not in plan and "orders" not in plan, name
