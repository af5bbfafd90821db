"""What was known at each date of a grid, against versions that look at the rows of one date at a time."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitlake.operators import analogues as an
from pitlake.operators import conditions as cd
from pitlake.operators import evidence as evd
from pitlake.operators.orderstats import running_quantiles

DAY = dt.date(2000, 1, 3)


def day(n):
    return DAY + dt.timedelta(days=int(n))


def test_running_quantiles_equal_a_sort_per_date(spark):
    rng = np.random.default_rng(0)
    rows = [(k, f, day(n), float(rng.integers(0, 30)) if rng.random() > 0.1 else None) for k in range(3) for f in ("a", "b") for n in sorted(rng.choice(400, 150, replace=False))]
    dates = [day(n) for n in (0, 5, 90, 91, 250, 399, 800)]
    history = spark.createDataFrame(rows, "k long, feature string, d date, value double").repartition(7)
    got = {(r.k, r.feature, r.as_of): (r.value, r.q) for r in running_quantiles(history, dates, ["k"], [0.1, 0.5, 0.9], 40).collect()}
    want = {}
    for k in range(3):
        for f in ("a", "b"):
            for at in dates:
                seen = [r for r in rows if r[0] == k and r[1] == f and r[2] <= at and r[3] is not None]
                if seen:
                    want[k, f, at] = (max(seen, key=lambda r: r[2])[3], np.percentile([r[3] for r in seen], [10, 50, 90]).tolist() if len(seen) >= 40 else None)
    assert set(got) == set(want)
    for key, (value, q) in want.items():
        assert got[key][0] == value and (got[key][1] is None) == (q is None) and (q is None or got[key][1] == pytest.approx(q))
    assert running_quantiles(history.limit(0), dates, ["k"], [0.5], 1).count() == 0


def brute_studies(events, as_of, h):
    """Moments and overlap of one study's events (date, exit, return) as they stood at a date."""
    seen = [(u, x) for u, e, x in events if e <= as_of]
    if len(seen) < evd.LEAST:
        return None
    w = np.array([2 ** ((u - dt.date(1992, 1, 1)).days / 365.25 / evd.HALF_LIFE) for u, _ in seen])
    x = np.array([x for _, x in seen])
    mean, size = (w * x).sum() / w.sum(), w.sum() ** 2 / (w * w).sum()
    spread = (w * (x - mean) ** 2).sum() / w.sum()
    gram = sum(max(0.0, 1 - abs((a - b).days) / (1.4 * h)) for a, _ in seen for b, _ in seen)
    inflation = gram / len(seen)
    return len(seen), size / inflation, mean, (w * (x > 0)).sum() / w.sum(), math.sqrt(spread / (size - 1) * inflation)


def test_evidence_as_known_at_each_date(spark):
    rng = np.random.default_rng(3)
    grid = [day(91 * i) for i in range(14)]
    marks = ["model", "family", "label"]
    found, outcome = [], []
    for i in range(6):
        for g in grid:
            for h in (21, 126):
                gap = int(h * 1.45) + int(rng.integers(0, 4))
                outcome.append((i, g, h, float(rng.normal(0.01, 0.05)) if rng.random() > 0.05 else None, g + dt.timedelta(days=gap)))
            for family in ("f", "g"):
                if rng.random() < 0.7:
                    found.append((i, g, "m", family, f"{family}{rng.integers(0, 2)}"))
    actives = spark.createDataFrame(found, "instrument_id long, as_of date, model string, family string, label string")
    done = spark.createDataFrame(outcome, "instrument_id long, as_of date, horizon int, fwd double, exit_day date")
    dates = spark.createDataFrame([(g,) for g in grid], "as_of date")
    ev = evd.events(actives, done, dates)
    rows = evd.collect(actives, evd.running_moments(ev, marks), evd.counted_dates(ev, actives, marks), evd.running_base(done, dates), marks)
    got = {(r.instrument_id, r.as_of, r.family, r.label, r.horizon): r for r in rows.collect()}
    by = {(i, g, h): (x, e) for i, g, h, x, e in outcome}
    of = lambda f, label, h: [(g, by[i, g, h][1], by[i, g, h][0]) for i, g, _, ff, ll in found if (ff, ll) == (f, label) and by[i, g, h][0] is not None]
    # an outcome is seen from the first date of the grid at or after its end
    checked = 0
    for i, g, _, f, label in found:
        for h in (21, 126):
            want = brute_studies(of(f, label, h), g, h)
            assert (want is None) == ((i, g, f, label, h) not in got)
            if want:
                r = got[i, g, f, label, h]
                base = np.mean([x for (_, _, hh), (x, e) in by.items() if hh == h and x is not None and e <= g])
                assert (r.n, r.n_eff, r.mean, r.hit_rate, r.se) == pytest.approx(want) and r.effect == pytest.approx(want[2] - base)
                checked += 1
    assert checked > 50
    rhos = {(r.horizon, r.as_of, r.a_label, r.b_label): r.rho for r in evd.correlations(rows, marks).collect()}
    kernel = lambda a, b, h: sum(max(0.0, 1 - abs((x - y).days) / (1.4 * h)) for x in a for y in b)
    for (h, g, la, lb), rho in rhos.items():
        a, b = ([u for u, e, _ in of(label[0], label, h) if e <= g] for label in (la, lb))
        assert rho == pytest.approx(kernel(a, b, h) / math.sqrt(kernel(a, a, h) * kernel(b, b, h)))
    count = actives.groupBy("instrument_id", "as_of", "model").agg(F.count("*").alias("active"))
    for r in evd.aggregate(rows, evd.correlations(rows, marks), count, marks).collect():
        own = [x for x in got.values() if (x.instrument_id, x.as_of, x.horizon) == (r.instrument_id, r.as_of, r.horizon)]
        w = np.array([1 / x.se**2 for x in own])
        corr = np.array([[1.0 if a is b else rhos[(r.horizon, r.as_of, *sorted((a.label, b.label)))] for b in own] for a in own])
        effect, inner = (w * [x.effect for x in own]).sum() / w.sum(), w * [x.se for x in own]
        z = effect / (math.sqrt(inner @ corr @ inner) / w.sum())
        assert (r.studies, r.effect, r.z_raw) == pytest.approx((len(own), effect, z))
        assert (r.supporting is None) == (not any(x.effect > 0 for x in own))


def test_masks_equal_rows_of_conditions(spark):
    rng = np.random.default_rng(5)
    as_of, rows, want = day(500), [], {}
    masks = [0b01, 0b10, 0b0101, 0b1001_0001, 0b10_0110]
    for i in range(4):
        known = [sum(4**k for k in range(5) if rng.random() < 0.8) for _ in range(120)]
        hold = [sum(int(rng.integers(0, 4)) * 4**k for k in range(5) if x >> 2 * k & 1) for x in known]
        fwd = [float(rng.normal()) if rng.random() < 0.9 else None for _ in known]
        rows.append((as_of, i, list(range(120)), known, hold, fwd))
        for m in masks:
            bits = [b for b in range(10) if m >> b & 1]
            able = [n for n in range(120) if all(known[n] >> b // 2 * 2 & 1 for b in bits)]
            match = {n: all(hold[n] >> b & 1 for b in bits) for n in able}
            events = [n for at, n in enumerate(able) if match[n] and not (at and match[able[at - 1]])]
            want[m, i] = (events, sum(fwd[n] for n in events if fwd[n] is not None), sum(fwd[n] is not None for n in able))
    pool = spark.createDataFrame(rows, "as_of date, instrument_id long, days array<int>, known array<int>, hold array<int>, fwd21 array<double>")
    asked = spark.createDataFrame([(as_of, m) for m in masks], "as_of date, mask int")
    got = {(r.mask, r.instrument_id): (r.events, r.s_done, r.n_base) for r in cd.apply_masks(pool, asked).collect()}
    assert set(got) == {k for k, v in want.items() if v[0] or k in got}
    for key, (events, total, base) in got.items():
        assert events == want[key][0] and total == pytest.approx(want[key][1]) and base == want[key][2]


@pytest.mark.parametrize(("mode", "value", "high", "low", "band", "most", "on", "sides"), [
    ("flag", 1.0, 0.5, 0.5, 0.0, 0.0, 0, 1), ("flag", 0.0, 0.5, 0.5, 0.0, 0.0, 1, 2), ("bucket", 0.85, 0.8, 0.2, 0.0, 0.0, 0, 1), ("bucket", 0.5, 0.8, 0.2, 0.0, 0.0, None, 0),
    ("direction", 0.1, 0.0, 0.0, 0.25, 0.0, None, 1), ("direction", -0.3, 0.0, 0.0, 0.25, 0.0, 1, 2), ("structural", 0.0, 0.0, 0.0, 0.0, 0.0, 0, 1), ("structural", -0.1, 0.0, 0.0, 0.0, 0.0, 1, 2),
    ("own", 3.0, 2.0, 1.0, 0.0, 0.0, 0, 1), ("own", 1.5, 1.5, 1.5, 0.0, 0.0, 0, 3), ("window", 4.0, 0.0, 0.0, 0.0, 10.0, 0, 1), ("window", 11.0, 0.0, 0.0, 0.0, 10.0, None, 0), ("structural", None, 0.0, 0.0, 0.0, 0.0, None, None),
])
def test_seven_modes_resolve(spark, mode, value, high, low, band, most, on, sides):
    row = spark.createDataFrame([(mode, value, high, low, band, most)], "mode string, value double, high double, low double, band double, most double")
    c = [F.col(x) for x in ("mode", "value", "high", "low")]
    got = row.select(cd.side(*c, F.col("band"), F.col("most")).alias("side"), cd.holding(*c, F.col("most")).alias("sides")).first()
    assert got.side == on and (sides is None or got.sides == sides)


def test_analogues_by_hand(spark):
    a, b = F.array(F.lit(1.0), F.lit(None).cast("double"), F.lit(2.0)), F.array(F.lit(2.0), F.lit(5.0), F.lit(-1.0))
    r = spark.range(1).select(an.cosine(a, b).alias("c")).first().c
    assert (r.dot, r.a, r.b, r.n) == (0.0, 5.0, 5.0, 2.0)
    rows = [("x", 1, DAY, day(i), i, 900, True, m, s, c, k, 1.0, 1.0, 1.0, 1.0) for i, (m, s, c, k) in enumerate([(0.9, 0.1, 0.5, None), (0.8, None, 0.9, 0.2), (0.7, 0.9, 0.1, 0.3), (None, 1.0, 1.0, 1.0), (0.6, 1.0, None, 1.0), (0.95, -0.5, 1.0, 1.0)])]
    sims = spark.createDataFrame([r[1:] for r in rows], "instrument_id long, as_of date, d date, pos int, target_pos int, has_sector boolean, market double, sector double, company double, catalysts double, cover_market double, cover_sector double, cover_company double, cover_catalysts double")
    variants = spark.createDataFrame([("v", 0.35, 0.2, 0.3, 0.15, 4, 3)], an.VARIANT)
    got = [(r.pos, r.similarity) for r in an.staged(sims, variants).orderBy("rank").collect()]
    # by market 5, 0, 1, 2 stay; by sector 2, 0, 5 (a missing one is last)
    assert got == [(5, pytest.approx((0.35 * 0.95 - 0.2 * 0.5 + 0.3 + 0.15) / 1.0)), (0, pytest.approx((0.35 * 0.9 + 0.2 * 0.1 + 0.3 * 0.5) / 0.85)), (2, pytest.approx(0.35 * 0.7 + 0.2 * 0.9 + 0.3 * 0.1 + 0.15 * 0.3))]
    path = [100.0, 110.0, 99.0, 120.0]
    matches = spark.createDataFrame([(1, DAY, 1, 4)], "instrument_id long, as_of date, pos int, target_pos int")
    r = an.path_metrics(matches, spark.createDataFrame([(1, path)], "instrument_id long, adj array<double>"), (3, 5)).collect()
    logs = np.diff(np.log(path))
    assert len(r) == 1 and (r[0].fwd, r[0].mae, r[0].mfe, r[0].drawdown, r[0].vol) == pytest.approx((0.2, -0.01, 0.2, -0.1, logs.std(ddof=1) * 252**0.5))
