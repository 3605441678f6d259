"""Hand-made cases of the operators' semantics."""

import random

import numpy as np
import pandas as pd
import pytest

from marlstone.functions import clock, codes, prices
from marlstone.operators import accounts, asof, bars, folds, inference, labels, pointintime, ridge, sets, windows
from marlstone.plans import registry


def collected(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_newey_west_by_hand(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in (1, 2, 3, 4)], "k string, i int, x double")
    r = inference.newey_west(df, ["k"], "i", "x", 1).first()
    assert (r["mean"], r["long_run_variance"], r["standard_error"]) == (2.5, 1.5625, 0.625)
    flat = spark.createDataFrame([("a", i, 1.0) for i in range(4)], "k string, i int, x double")
    assert inference.newey_west(flat, ["k"], "i", "x", 1).first()["status"] == "DEGENERATE"


def test_stationary_bootstrap_kernel():
    got = inference.bootstrap_indices(np.array([0, 0.9, 0.1, 0.8, 0.2]), np.array([0.65, 0.2, 0.99, 0.4, 0.0]), 2)
    assert got.tolist() == [3, 4, 4, 0, 0]


def test_resamples_are_rows_of_one_generator():
    g = np.random.Generator(np.random.PCG64(7))
    for r in range(4):
        a, b = g.random(10), g.random(10)
        assert inference.resample(10, 3.0, 7, r).tolist() == inference.bootstrap_indices(a, b, 3.0).tolist()


def test_stepdown_adds_one_and_never_falls(spark):
    stats = spark.createDataFrame([(r, c, float(t)) for r, ts in enumerate([(0.5, 0.1), (3.0, 0.2), (0.1, 2.5)]) for c, t in enumerate(ts)], "row long, column int, t double")
    assert inference.romano_wolf(stats, [2.0, 1.0], 3) == [0.75, 0.75]


def test_bootstrap_in_spark_equals_local(spark):
    x = np.arange(24.0).reshape(12, 2) ** 1.5
    got = inference.bootstrap_statistics(spark, x, 6, 3.0, 5, 1).orderBy("row", "column").toPandas()["t"].to_numpy()
    centre = x - x.mean(axis=0)
    want = [inference.hac_t(centre[inference.resample(12, 3.0, 5, r)][:, j], 1) for r in range(6) for j in range(2)]
    assert np.allclose(got, want)


def test_as_of_is_inclusive_and_keeps_unmatched(spark):
    d = spark.createDataFrame([("a", 100, 1), ("a", 50, 2), ("b", 100, 3)], "k string, at long, id int")
    c = spark.createDataFrame([("a", 100, "now"), ("a", 60, "was"), ("c", 1, "other")], "k string, received long, v string")
    assert collected(asof.as_of(d, c, ["k"], "at", "received", ["v"]).select("id", "known_at", "v"), "id") == [(1, 100, "now"), (2, None, None), (3, None, None)]
    assert collected(asof.as_of(d, c, ["k"], "at", "received", ["v"], strict=True).select("id", "v"), "id") == [(1, "was"), (2, None), (3, None)]


def test_later_news_does_not_change_an_earlier_decision(spark):
    # the halt happened at 10 but was received at 1000: a decision at 100 still sees TRADING
    c = spark.createDataFrame([("a", 0, "TRADING"), ("a", 1000, "HALT")], "k string, received long, v string")
    d = spark.createDataFrame([("a", 100), ("a", 1000)], "k string, at long")
    assert collected(asof.as_of(d, c, ["k"], "at", "received", ["v"]).select("at", "v"), "at") == [(100, "TRADING"), (1000, "HALT")]


def test_ties_conflict_only_when_sources_differ(spark):
    c = spark.createDataFrame([("a", 1, "f1", 0, "x"), ("a", 1, "f1", 1, "y"), ("a", 1, "f2", 0, "y"), ("b", 1, "f1", 0, "x"), ("b", 1, "f2", 0, "z")], "k string, at long, f string, n int, v string")
    assert collected(asof.tied(c, ["k"], "at", "f", "n", ["v"]), "k") == [("a", 1, "y", False), ("b", 1, "x", True)]


def test_interval_join_is_half_open(spark):
    p = spark.createDataFrame([("a", t) for t in (0, 9, 10, 19, 20)], "k string, at long")
    i = spark.createDataFrame([("a", 0, 10, "x"), ("a", 10, 20, "y")], "k string, s long, e long, v string")
    assert [r[2] for r in collected(asof.in_interval(p, i, ["k"], "at", "s", "e", ["v"], 7), "at")] == ["x", "x", "y", "y", None]


def test_islands_and_gaps(spark):
    i = spark.createDataFrame([("a", 0, 10), ("a", 10, 20), ("a", 5, 8), ("a", 30, 40)], "k string, s long, e long")
    merged = bars.islands(i, ["k"], "s", "e")
    assert collected(merged, "s") == [("a", 0, 20, 3), ("a", 30, 40, 1)]
    assert collected(bars.gaps(merged, ["k"], "s", "e", -5, 50), "gap_start") == [("a", -5, 0), ("a", 20, 30), ("a", 40, 50)]
    assert collected(bars.islands(i, ["k"], "s", "e", slack=10), "s") == [("a", 0, 40, 4)]


def test_invalid_bars_stay_with_a_code(spark):
    b = spark.createDataFrame([(1, 0, 5, 6, 4, 5, 3), (1, 0, 5, 4, 4, 5, 3), (1, 2, 5, 6, 4, 5, 3), (1, 0, None, 6, 4, 5, 3), (1, 0, 5, 6, 4, 5, 0)], "available_at_ns long, event_at_ns long, open_nano long, high_nano long, low_nano long, close_nano long, volume long")
    assert [r[0] for r in b.select(bars.disposition()).collect()] == ["ELIGIBLE", "INVALID_PRICES", "ACAUSAL", "MISSING_PRICE", "THIN"]


def test_session_rolls_at_17_local(spark):
    df = spark.sql("SELECT timestamp'2024-03-10 21:59:59' AS a, timestamp'2024-03-10 22:00:00' AS b, timestamp'2024-01-05 22:59:59' AS c, timestamp'2024-01-05 23:00:00' AS d")
    got = df.select(*(clock.session_date(c).cast("string") for c in "abcd"), clock.session_start("d").cast("string")).first()
    assert tuple(got) == ("2024-03-10", "2024-03-11", "2024-01-05", "2024-01-06", "2024-01-05 23:00:00")


def test_exact_prices(spark):
    df = spark.createDataFrame([(4_503_599_627_370_497_123,), (2**63 - 1,), (-7,)], "n long")
    assert [r[0] for r in df.select(prices.as_decimal("n").cast("string")).collect()] == ["4503599627.370497123", None, "-0.000000007"]
    assert tuple(df.where("n < 0").select(clock.floor_div("n", 5), prices.tick_ceil("n", 5), prices.tick_valid("n", 7)).first()) == (-2, -5, True)


def test_codes(spark):
    df = spark.createDataFrame([("Y",), ("",), (None,), ("?",)], "c string")
    assert [r[0] for r in df.select(codes.tri_state("c")).collect()] == ["YES", "UNKNOWN_EMPTY", "UNKNOWN_EMPTY", "UNKNOWN_3F"]
    s = spark.createDataFrame([("ESH4",), ("6EZ23",), ("bad",)], "s string")
    assert [tuple(r) for r in s.select(codes.contract_root("s"), codes.contract_month("s")).collect()][:2] == [("ES", 3), ("6E", 12)]


def bar_rows(spark, opens, step=60, key="m"):
    return spark.createDataFrame([(key, i * step, o, o + 10, o - 10, o + 1, 5, "c", "ELIGIBLE") for i, o in enumerate(opens) if o is not None], "market string, event_at_ns long, open_nano long, high_nano long, low_nano long, close_nano long, volume long, contract string, disposition string")


def test_grid_outcome_matures_or_says_why(spark):
    b = bar_rows(spark, [100, 100, 110, 120, None, 140])
    d = spark.createDataFrame([("m", 0, "c"), ("m", 120, "c"), ("m", 0, "other")], "market string, at long, contract string").where("contract = 'c'")
    got = collected(labels.grid_outcome(d, b, ["market"], "at", ["contract"], 60, 1, 3), "at")
    assert got[0][2] == "MATURED" and got[0][3] == pytest.approx(0.2)
    assert got[1][2:] == ("MISSING_SOURCE", None)
    rolled = b.withColumn("contract", __import__("pyspark").sql.functions.expr("if(event_at_ns >= 120, 'd', 'c')"))
    first = labels.grid_outcome(d.where("at = 0"), rolled, ["market"], "at", ["contract"], 60, 1, 4).first()["status"]
    assert first == "ROLL_UNRESOLVED"
    gap_then_roll = labels.grid_outcome(d.where("at = 120"), rolled, ["market"], "at", ["contract"], 60, 1, 3)
    assert gap_then_roll.first()["status"] == "ROLL_UNRESOLVED"


def test_bracket_stops_before_target_on_one_bar(spark):
    b = spark.createDataFrame([("m", 60, 100, 105, 95, 100, "c"), ("m", 120, 100, 200, 1, 100, "c")], "market string, event_at_ns long, open_nano long, high_nano long, low_nano long, close_nano long, contract string")
    d = spark.createDataFrame([("m", 0, 1, 10.0), ("m", 0, -1, 10.0)], "market string, at long, direction int, atr double")
    got = collected(labels.bracket(d, b, ["market"], "at", ["contract"], 60, 2).select("direction", "exit_step", "exit_reason", "gross_nano"), "direction")
    assert got == [(-1, 2, "STOP", -15), (1, 2, "STOP", -15)]


def test_limit_needs_a_trade_through(spark):
    b = spark.createDataFrame([("m", 60 * k, 100, low, 100) for k, low in enumerate([99, 90, 89, 95, 95, 95])], "market string, event_at_ns long, high_nano long, low_nano long, close_nano long")
    d = spark.createDataFrame([("m", 0, 1, 90)], "market string, at long, direction int, limit_nano long")
    r = labels.limit_path(d, b, ["market"], "at", 60, 1, 3, 1).first()
    assert (r["fill_step"], r["exit_step"], r["state"], r["gross_nano"]) == (2, 3, "FILLED_CLOSED", 10)


def test_wilder_restarts_with_each_run(spark):
    b = bar_rows(spark, [100, 100, 100, None, 100, 100])
    got = collected(windows.wilder_atr(b, ["market"], 2, 60).select("run", "bars", "atr"), "run")
    assert got == [(0, 3, 20.0), (1, 2, 20.0)]


def test_folds_have_an_embargo(spark):
    s = folds.numbered(spark.range(12).selectExpr("'m' AS market", "id AS session"), ["market"], "session")
    got = folds.expanding(s, 2, 4, 2, 3).groupBy("fold", "role").count()
    assert collected(got, "fold", "role") == [(0, "EMBARGO", 1), (0, "EVALUATE", 3), (0, "FIT", 4), (1, "EMBARGO", 1), (1, "EVALUATE", 3), (1, "FIT", 6)]


def test_ridge_equals_the_normal_equations(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 2)) * [1, 20]
    y = x @ [2.0, -0.1] + 3 + rng.normal(size=50)
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "x0": x[:, 0], "x1": x[:, 1], "y": y}))
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + 2 * np.eye(2), z.T @ (y - y.mean())) / x.std(0)
    r = ridge.fit(df, ["g"], ["x0", "x1"], ["y"], 2.0).first()
    assert np.allclose(r["weights"], w)
    assert r["intercept"] == pytest.approx(y.mean() - x.mean(0) @ w)
    assert r["mse"] == pytest.approx(np.mean((y - x @ w - r["intercept"]) ** 2))
    raw = ridge.fit(df, ["g"], ["x0", "x1"], ["y"], 2.0, standardised=False).first()
    a = np.column_stack([np.ones(50), x])
    assert np.allclose([raw["intercept"], *raw["weights"]], np.linalg.solve(a.T @ a + 2 * np.diag([0, 1, 1]), a.T @ y))


def test_schedule_is_sequential(spark):
    c = spark.createDataFrame([("a", 1, "d1", 0, 10, 5, -60), ("a", 2, "d1", 5, 15, 5, 50), ("a", 3, "d1", 10, 20, 5, -50), ("a", 4, "d1", 30, 40, 5, 10), ("a", 5, "d2", 50, 60, 500, 10), ("a", 6, "d2", 60, 70, 5, 10)], "k string, candidate int, session string, entry long, exit long, risk long, pnl long")
    got = collected(accounts.schedule(c, ["k"], 100, 3, 100, 1000).select("candidate", "state"), "candidate")
    assert [s for _, s in got] == ["ADMITTED", "OVERLAP", "ADMITTED", "DAILY_STOP", "RISK_CAP", "ADMITTED"]


def test_floor_never_falls_and_locks(spark):
    b = spark.createDataFrame([("a", 1, 100), ("a", 2, 130), ("a", 2, 130), ("a", 3, 90), ("a", 4, 500)], "k string, day int, balance int")
    assert [r[3] for r in collected(accounts.trailing_floor(b, ["k"], "day", "balance", 50, 120), "day")] == [50, 80, 80, 120]


def test_duplicates_are_told_apart(spark):
    r = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, None), (3, "x")], "k int, v string")
    assert collected(sets.duplicates(r, ["k"], ["v"]), "k") == [(1, 2, "EXACT_DUPLICATE"), (2, 2, "DISTINCT_UPDATE"), (3, 1, "UNIQUE")]


def test_fingerprint_ignores_layout(spark):
    r = spark.range(100).selectExpr("1 AS k", "id", "id * 2 AS v")
    a = sets.fingerprint(r.repartition(7), ["k"], ["id", "v"]).first()
    assert a == sets.fingerprint(r.coalesce(1).orderBy("id", ascending=False), ["k"], ["id", "v"]).first()
    assert a != sets.fingerprint(r.where("id < 99"), ["k"], ["id", "v"]).first()


@pytest.mark.parametrize(("proposed", "mode"), [([(1, "a"), (2, "b")], "UNCHANGED"), ([(1, "a"), (2, "b"), (3, "c")], "APPEND_ONLY"), ([(1, "a")], "FULL_SUCCESSOR"), ([(1, "z"), (2, "b")], "FULL_SUCCESSOR")])
def test_catalog_modes(spark, proposed, mode):
    now = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sets.catalog_update(now, spark.createDataFrame(proposed, "k int, v string"), ["k"], ["v"]).first()["mode"] == mode
    assert sets.catalog_update(now.limit(0), now, ["k"], ["v"]).first()["mode"] == "INITIAL"


def test_hash_chain_depends_on_all_before(spark):
    r = spark.createDataFrame([("l", i, i * 10) for i in range(4)], "k string, i int, v int")
    a = [x["link"] for x in sets.hash_chain(r, ["k"], "i", ["i", "v"]).orderBy("i").collect()]
    changed = r.selectExpr("k", "i", "if(i = 1, 99, v) AS v")
    b = [x["link"] for x in sets.hash_chain(changed, ["k"], "i", ["i", "v"]).orderBy("i").collect()]
    assert a[0] == b[0] and all(x != y for x, y in zip(a[1:], b[1:], strict=True))


def test_as_of_over_spans_equals_one_window(spark):
    import random

    rnd = random.Random(3)
    changes = [(k, at, f"{k}{at}") for k in "ab" for at in sorted(rnd.sample(range(500), 25))]
    asked = [(rnd.choice("abc"), rnd.randrange(520), i) for i in range(300)]
    d, c = spark.createDataFrame(asked, "k string, at long, id int"), spark.createDataFrame(changes, "k string, received long, v string")
    for strict in (False, True):
        one = collected(asof.as_of(d, c, ["k"], "at", "received", ["v"], strict=strict).select("id", "known_at", "v"), "id")
        assert one == collected(asof.as_of(d, c, ["k"], "at", "received", ["v"], strict=strict, span=40).select("id", "known_at", "v"), "id")
        assert one == [(i, *max(((at, v) for k2, at, v in changes if k2 == k and (at < now if strict else at <= now)), default=(None, None))) for k, now, i in sorted(asked, key=lambda x: x[2])]


def test_bars_take_equal_times_in_their_order(spark):
    t = spark.createDataFrame([("m", 5, 3, 100, 1), ("m", 5, 1, 90, 1), ("m", 5, 2, 95, 1), ("m", 9, 5, 70, 1), ("m", 9, 4, 80, 1)], "market string, at long, ordinal long, price long, size long")
    assert collected(bars.ohlcv(t, ["market"], "at", "price", "size", 10, "ordinal"), "market") == [("m", 0, 90, 100, 70, 70, 5)]


def test_definitions_are_replayed_with_deletes_and_ties(spark):
    from marlstone.operators import pointintime

    log = [  # instrument, day, received, file, ordinal, action, class, active, expired, multiplier
        (1, 0, 10, "a", 1, "ADD", "FUTURE", 0, 99, 5), (1, 0, 20, "a", 2, "DELETE", "FUTURE", 0, 99, 5), (1, 0, 30, "b", 1, "ADD", "FUTURE", 0, 99, 7), (1, 0, 30, "a", 9, "ADD", "FUTURE", 0, 99, 6),
        (2, 0, 10, "a", 1, "ADD", "SPREAD", 0, 99, 5), (3, 0, 10, "a", 1, "ADD", "FUTURE", 0, 15, 5), (4, 0, 10, "a", 1, "OTHER", "FUTURE", 0, 99, 5), (4, 0, 11, "a", 2, "ADD", "FUTURE", 0, 99, 5)]
    asked = [(i, 0, at, until, f"{i}@{at}-{until}") for i, at, until in ((1, 5, 6), (1, 15, 16), (1, 15, 20), (1, 20, 25), (1, 30, 31), (2, 12, 13), (3, 15, 16), (3, 14, 14), (4, 12, 13))]
    df = spark.createDataFrame(log, "instrument int, day int, received_ns long, file string, ordinal long, action string, class string, active_ns long, expired_ns long, multiplier long")
    got = pointintime.definition_of(spark.createDataFrame(asked, "instrument int, day int, at long, until long, id string"), df, ["instrument", "day"], "at", "until", ["file", "ordinal"], ["multiplier"])
    assert {r["id"]: (r["code"], r["multiplier"]) for r in got.collect()} == {
        "1@5-6": ("NO_DEFINITION_BY_START", None), "1@15-16": ("RESOLVED", 5), "1@15-20": ("CHANGED_BEFORE_DECISION", None), "1@20-25": ("DELETED", None), "1@30-31": ("RESOLVED", 7),
        "2@12-13": ("NOT_OUTRIGHT", None), "3@15-16": ("NOT_ACTIVE", None), "3@14-14": ("RESOLVED", 5), "4@12-13": ("UNKNOWN_ACTION", None)}


def test_features_over_spans_equal_one_window(spark):
    rows = [(k, i * 60, 100 + (i * 7) % 13, 110 + i % 5, 90 - i % 3, 101 + (i * 5) % 11, 1 + i % 4) for k in "ab" for i in range(300) if (i + ord(k)) % 97 != 5]
    b = spark.createDataFrame(rows, "k string, event_at_ns long, open_nano long, high_nano long, low_nano long, close_nano long, volume long")
    one, many = ([tuple(r) for r in windows.features(b, ["k"], 60, 30, span).orderBy("k", "event_at_ns").collect()] for span in (10_000, 40))
    assert one == many and len(one) > 200


def test_bootstrap_means_are_those_of_the_resamples(spark):
    x = np.arange(40.0) ** 1.5
    got = {(r["block"], r["row"]): r["mean"] for r in inference.bootstrap_means(spark, x, 5, [2, 7], 3).collect()}
    assert got == {(b, r): x[inference.resample(40, b, 3 + b, r)].mean() for b in (2, 7) for r in range(5)}


def test_long_run_variances_that_say_nothing(spark):
    df = spark.createDataFrame([("short", i, float(i)) for i in range(2)] + [("flat", i, 0.1) for i in range(9)] + [("ok", i, float(i % 3)) for i in range(9)], "k string, i int, x double")
    got = {r["k"]: (r["status"], r["standard_error"]) for r in inference.newey_west(df, ["k"], "i", "x", 2).collect()}
    assert got["short"] == ("TOO_SHORT", None) and got["flat"] == ("DEGENERATE", 0.0) and got["ok"][0] == "OK" and got["ok"][1] > 0
    with pytest.raises(ValueError, match="more than 3"):
        inference.hac_t(np.array([1.0, 2.0, 3.0]), 3)
    with pytest.raises(ValueError, match="no variance"):
        inference.hac_t(np.full(9, 0.1), 2)


def test_links_are_resolved_against_their_page(spark):
    from pyspark.sql import functions as F

    from marlstone.functions import links

    page = "https://a.example/x/y.html?q=1"
    html = '<A HREF="no"><a class="n" href="b.pdf">t</a><a href="../c.XLSX?v=2#t"><a\nhref="//a.example/d.zip"><a href="http://a.example/e"><a href="https://b.example/"><a href="mailto:a@b"><a href="#top"><a href="/f/./g"><a href="?p=1&amp;q=2"><a href="">'
    df = spark.createDataFrame([(html, page), (None, page)], "html string, page string")
    rows = df.select(F.posexplode(links.hrefs("html")).alias("i", "href"), "page").withColumn("url", links.resolved("href", "page")).select("i", "url", links.kind("url", "page").alias("kind"))
    own = page.split("?")[0]
    assert collected(rows.select("url", "kind", "i"), "i") == [(u, k, i) for i, (u, k) in enumerate([
        ("https://a.example/x/b.pdf", "PDF"), ("https://a.example/c.XLSX", "SPREADSHEET"), ("https://a.example/d.zip", "ARCHIVE"), ("http://a.example/e", "INSECURE"), ("https://b.example/", "FOREIGN"), ("", "NOT_A_PAGE"), (own, "SELF"), ("https://a.example/f/g", "PAGE"), (own, "SELF"), (own, "SELF")])]


def most_rows(df):
    """The most rows that any step of the plan made as ``df`` was collected, and the rows."""
    got = df.collect()

    def walk(node):
        name = node.getClass().getSimpleName()
        inner = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else []
        below = node.children()
        found = node.metrics().get("numOutputRows")
        yield found.get().value() if found.isDefined() else 0
        for n in [*inner, *(below.apply(i) for i in range(below.size()))]:
            yield from walk(n)

    return max(walk(df._jdf.queryExecution().executedPlan())), got


def test_identities_by_force_and_without_pairs(spark):
    """bars used to be joined with all of a day's observations."""
    rnd = random.Random(3)
    seen = [(k, *(lambda r, late: (r, r + late))(rnd.randrange(0, 40, 4), rnd.choice([0, 0, 0, 5, -2])), rnd.choice("xy"), i // rnd.choice([1, 1, 1, 2]), rnd.choice(["ADD", "ADD", "DELETE"]), rnd.choice(["FUTURE"] * 5 + ["SPREAD"]), 0, 30, rnd.randrange(2)) for k in range(60) for i in range(rnd.choice([0, 3, 8]))]
    seen += [(99, 4, 4, f, o, "ADD", "FUTURE", 0, 30, m) for f in "xyz" for o, m in ((1, 0), (2, 1))] + [(None, 4, 4, "x", 1, "ADD", "FUTURE", 0, 30, 0), (98, 4, None, "x", 1, "ADD", "FUTURE", 0, 30, 0)]
    bars = [(f"{k}-{i}", k, at, at + rnd.choice([0, 3, 9])) for k in (*range(60), 99, 98, None) for i, at in enumerate(rnd.choices(range(45), k=4))] + [("late", 99, 9, 5), ("open", 99, None, 9), ("open", 99, 9, None)] + [("twice", 99, 9, 9)] * 2
    left = spark.createDataFrame(bars, "id string, k int, at long, until long")
    right = spark.createDataFrame(seen, "k int, received_ns long, available_ns long, file string, ordinal long, action string, class string, active_ns long, expired_ns long, multiplier int")
    got = pointintime.identity_of(left, right, ["k"], "at", "until", ["multiplier"]).collect()

    def want(_, k, at, until):
        own = [s for s in seen if k is not None and s[0] == k and None not in s[1:3] and None not in (at, until)]
        near = [s for s in own if max(s[1:3]) <= until]
        known = [s for s in near if max(s[1:3]) <= at]
        if not known:
            return "NO_DEFINITION_BY_START", None
        last = [s for s in known if s[1] == max(s[1] for s in known)]
        told = [sorted(s[4:] for s in last if s[3] == f) for f in {s[3] for s in last}]
        if any(len({o[0] for o in t}) < len(t) for t in told):
            return "REPEATED_ORDINAL", None
        if len({tuple(o[1:] for o in t) for t in told}) > 1:
            return "CONFLICTING_FILES", None
        if len(near) > len(known):
            return "CHANGED_BEFORE_DECISION", None
        action, kind, a, e, m = told[0][-1][1:]
        return ("RESOLVED", m) if action != "DELETE" and kind == "FUTURE" and a <= at < e else ("NOT_AN_ACTIVE_FUTURE", None)

    found = sorted(((r["id"], r["k"], r["at"], r["until"]), r["code"], r["multiplier"]) for r in got if None not in (r["k"], r["at"], r["until"]))
    assert found == sorted((b, *want(*b)) for b in bars if None not in b)
    assert {r["code"] for r in got} == {"NO_DEFINITION_BY_START", "REPEATED_ORDINAL", "CONFLICTING_FILES", "CHANGED_BEFORE_DECISION", "NOT_AN_ACTIVE_FUTURE", "RESOLVED"}
    assert len(got) == len(bars) and {r["code"] for r in got if None in (r["k"], r["at"], r["until"])} == {"NO_DEFINITION_BY_START"}
    n = 400
    many = spark.range(n).selectExpr("'b' AS id", "1 AS k", "id AS at", "id + 3 AS until")
    logs = spark.range(n).selectExpr("1 AS k", "id - id % 40 AS received_ns", "id - id % 40 AS available_ns", "'x' AS file", "id AS ordinal", "'ADD' AS action", "'FUTURE' AS class", "0L AS active_ns", "900L AS expired_ns", "0 AS multiplier")
    assert most_rows(pointintime.identity_of(many, logs, ["k"], "at", "until", ["multiplier"]))[0] <= 4 * n


def test_first_quotes_by_force_and_without_pairs(spark):
    """targets used to be joined with all quotes of their steps."""
    rnd = random.Random(4)
    quotes = [(rnd.choice("ab"), rnd.randrange(0, 300), i, rnd.choice([1, 1, 1, 1, 2, None])) for i in range(90)] + [("c", 5, 1, 1), ("c", 5, 0, 1), ("c", 9, 2, 2), (None, 5, 1, 1), ("d", 7, 1, None)]
    targets = [(i, rnd.choice(["a", "b"]), s, s + rnd.choice([0, 4, 9, 30]), rnd.choice([1, 1, 2, None])) for i, s in enumerate(rnd.choices(range(-5, 320), k=150))]
    targets += [(200, "c", 5, 8, 1), (201, "c", 5, 9, 1), (202, "c", 6, 9, 2), (203, None, 0, 9, 1), (204, "d", 0, 9, 1), (205, "e", 0, 9, 1)]
    left, right = spark.createDataFrame(targets, "id int, k string, s long, e long, own int"), spark.createDataFrame(quotes, "k string, available_ns long, ordinal int, instrument_id int")
    for span in (7, 1_000):
        got = {r["id"]: (r["state"], r["available_ns"], r["ordinal"]) for r in pointintime.first_quote(left, right, ["k"], "s", "e", "own", span).collect()}
        assert len(got) == len(targets)
        for i, k, s, e, own in targets:
            inside = [q for q in quotes if k is not None and q[0] == k and s <= q[1] <= e]
            foreign = any(None not in (own, q[3]) and q[3] != own for q in inside)
            want = ("NO_QUOTE_BY_DEADLINE", None, None) if not inside else ("FOREIGN_INSTRUMENT", None, None) if foreign else ("COMPLETE", *min(q[1:3] for q in inside))
            assert got[i] == want, (i, k, s, e, own)
    n = 400
    many = spark.range(n).selectExpr("id", "'a' AS k", "id AS s", "id + 50 AS e", "1 AS own")
    asked = spark.range(n).selectExpr("'a' AS k", "id AS available_ns", "id AS ordinal", "1 AS instrument_id")
    assert most_rows(pointintime.first_quote(many, asked, ["k"], "s", "e", "own", 1_000))[0] <= 4 * n


def test_fills_without_pairs(spark, tmp_path):
    """orders used to be joined with all bars of half an hour."""
    n = 600
    events = spark.range(n).selectExpr("id AS event_id", "timestamp_micros(1704067200000000 + id * 1000000) AS ts", "id % 3 AS user_id", "'view' AS event_type", "1.0 AS value", "'{}' AS props")
    events.write.parquet(f"{tmp_path}/events.parquet")
    most, got = most_rows(registry.queries()["first_fill"](spark, str(tmp_path)))
    assert len(got) == n // 6 and most <= 4 * n


def test_predictions_do_not_deal_rows_by_the_models_key(spark):
    """rows were shuffled by a key of three values, so three tasks read them all."""
    rows = spark.range(300).selectExpr("id % 3 AS k", "cast(id AS double) AS x", "cast(2 * id + id % 3 AS double) AS y")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ridge.predicted(rows, ridge.fit(rows, ["k"], ["x"], ["y"], 0.0), ["k"], ["x"], "y")
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert all(abs(r["prediction"] - r["y"]) < 1e-6 for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
