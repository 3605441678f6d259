"""Scans over blocks against plain loops, with keys cut into many blocks."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import accounts, scans, windows

SPANS = (1, 7, 10_000)


def series(seed=1, keys=("a", "b", None), n=60):
    rnd = random.Random(seed)
    return [(k, t, rnd.randint(-9, 9), rnd.random() < 0.1) for k in keys for t in sorted(rnd.sample(range(n * 3), n))]


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("span", SPANS)
def test_scans_by_definition(spark, span):
    rows = series()
    df = spark.createDataFrame(rows, "k string, t long, x long, f boolean").repartition(3)
    got = scans.previous(df, ["k"], ["t"], {"x": "px", "t": "pt"}, span)
    got = scans.numbered(got, ["k"], ["t"], "n", span)
    got = scans.lifted(got, ["k"], ["t"], F.col("x"), F.col("x") + 3, span)
    got = scans.after_first(got, ["k"], ["t"], "f", "broken", span)
    got = scans.latest(got, ["k"], ["t"], F.when(F.col("f"), F.col("t")), "since", span)
    found = {(r["k"], r["t"]): r for r in got.collect()}
    assert len(found) == len(rows)
    for k, own in by_key(rows).items():
        total, peak, broken, since, was = 0, None, 0, None, (None, None)
        for i, (_, t, x, f) in enumerate(own, 1):
            peak = max(total + x + 3, total + x + 3 if peak is None else peak)
            since = t if f else since
            r = found[k, t]
            assert (r["px"], r["pt"], r["n"], r["before"], r["peak"], r["broken"], r["since"]) == (*was, i, total, peak, broken, since)
            total, broken, was = total + x, broken + f, (x, t)


@pytest.mark.parametrize("span", (1, 7, 50))
def test_decays_by_definition(spark, span):
    rows = series(2, ("a", "b"))
    df = spark.createDataFrame(rows, "k string, t long, x long, f boolean").repartition(3)
    got = {(r["k"], r["t"]): r["d"] for r in scans.decayed(df, ["k"], ["t"], F.col("x"), F.col("t"), 0.9, "d", span).collect()}
    for k, own in by_key(rows).items():
        total, last = 0.0, 0
        for _, t, x, _ in own:
            total, last = total * 0.9 ** (t - last) + x, t
            assert got[k, t] == pytest.approx(total, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("span", (2, 60, 60 * 1_000))
@pytest.mark.parametrize("n", (1, 3))
def test_wilder_over_many_blocks(spark, span, n):
    rnd = random.Random(4)
    bars = [(k, 60 * t, c + 5, c - 5, c) for k in "ab" for t in range(90) if rnd.random() > 0.05 for c in [rnd.randint(50, 150)]]
    df = spark.createDataFrame(bars, "k string, event_at_ns long, high_nano long, low_nano long, close_nano long").repartition(3)
    got = {(r["k"], r["event_at_ns"]): r for r in windows.wilder_series(df, ["k"], n, 60, span).collect()}
    last = {(r["k"], r["event_at_ns"]): (r["run"], r["bars"], r["atr"]) for r in windows.wilder_atr(df, ["k"], n, 60, span).collect()}
    for _, own in by_key(bars).items():
        run, trs, was, number = [], [], None, -1
        for i, (k, t, h, low, c) in enumerate(own):
            if was is None or t - run[-1] != 60:
                run, trs, number = [], [h - low], number + 1
            else:
                trs.append(max(h - low, abs(h - was), abs(low - was)))
            run.append(t)
            was = c
            want = None
            if len(trs) >= n:
                want = sum(trs[:n]) / n
                for x in trs[n:]:
                    want = (want * (n - 1) + x) / n
            r = got[k, t]
            assert (r["run_start"], r["bars"], r["true_range"]) == (run[0], len(run), trs[-1])
            assert r["atr"] is None if want is None else r["atr"] == pytest.approx(want, rel=1e-12)
            if i + 1 == len(own) or own[i + 1][1] - t != 60:
                assert last[k, t] == (number, len(run), r["atr"])


def test_wilder_windows_by_definition(spark):
    rnd = random.Random(5)
    rows = [(k, i, float(rnd.randint(1, 40)) if i > 1 else None) for k in "ab" for i in range(1, 48)]
    df = spark.createDataFrame(rows, "k string, i long, tr double")
    got = {(r["k"], r["bar"]): r["atr"] for r in windows.wilder_windows(df, ["k"], "i", "tr", 4, 6, 5).collect()}
    assert set(got) == {(k, i) for k in "ab" for i in range(11, 48, 5)}
    for (k, i), atr in got.items():
        own = [r[2] for r in rows if r[0] == k and i - 9 <= r[1] <= i]
        want = sum(own[:4]) / 4
        for x in own[4:]:
            want = (3 * want + x) / 4
        assert atr == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("span", SPANS)
def test_accounts_over_many_blocks(spark, span):
    rows = series(6)
    df = spark.createDataFrame(rows, "k string, t long, x long, f boolean").repartition(3)
    dd = {(r["k"], r["t"]): (r["equity"], r["peak"], r["drawdown"]) for r in windows.drawdown(df, ["k"], ["t"], "x", span).collect()}
    marks = df.select("k", F.col("t").alias("at"), F.col("x").alias("close"), (F.col("x") + 2).alias("best"), (F.col("x") - 2).alias("worst"))
    path = {(r["k"], r["at"]): (r["peak"], r["state"], r["equity"]) for r in accounts.account_path(marks, ["k"], 100, 25, span).collect()}
    floor = {(r["k"], r["t"]): r["floor"] for r in accounts.trailing_floor(df.union(df), ["k"], "t", "x", 4, 3, span).collect()}
    for k, own in by_key(rows).items():
        equity, peak, high, low, broken = 0, 0, 100, None, False
        for _, t, x, _ in own:
            high = max(high, 100 + equity + x + 2)
            breach = 100 + equity + x - 2 <= high - 25
            state = "HALTED" if broken else "LIQUIDATED" if breach else "OPEN"
            assert path[k, t] == (high, state, 100 + equity + x if state == "OPEN" else None)
            broken, equity = broken or breach, equity + x
            peak, low = max(peak, equity), max(x - 4, x - 4 if low is None else low)
            assert dd[k, t] == (equity, peak, peak - equity)
            assert floor[k, t] == min(3, low)
