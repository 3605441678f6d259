"""Accounts on merged events, by hand."""

from marlstone.operators import accounts

ORDER = "account string, order_id long, session string, market string, side int, at long, entry long, exit_at long, exit_price long, fee long, loss long, score double"
BAR = "market string, at long, open long, high long, low long, close long"


def simulated(spark, orders, bars, flattens=(), starting=1_000):
    o, b = spark.createDataFrame(orders, ORDER), spark.createDataFrame(bars, BAR)
    f = spark.createDataFrame(list(flattens), "account string, at long")
    events = accounts.account_events(o, b, f, 7, 5)
    return {int(r["order_id"]): (r["state"], r["closed_at"], r["net"], r["equity"], r["max_drawdown"]) for r in accounts.simulated(events, starting, 250, 2, 100, 150).collect()}


def order(i, at, exit_at, entry=100, exit_price=110, side=1, session="d", market="m", loss=0, score=1.0, account="a"):
    return account, i, session, market, side, at, entry, exit_at, exit_price, 2, loss, score


def test_a_breach_is_liquidated_at_the_next_open(spark):
    bars = [("m", 10, 100, 130, 95, 120), ("m", 11, 120, 120, 20, 30), ("m", 12, 25, 90, 20, 80)]
    # favourable 130: peak 1028; adverse 20: 1000 - 80 - 2 = 918, which is 110 below the peak and 82 below the start
    assert simulated(spark, [order(1, 10, 13)], bars)[1] == ("EXIT", 13, 8, 1008, 110)
    assert simulated(spark, [order(1, 10, 13)], [*bars, ("m", 13, 1, 1, 1, 1)])[1][0] == "INCOMPLETE"  # the exit's own bar breaches, none comes after it
    deeper = [bars[0], ("m", 11, 120, 120, -1, 30), *bars[2:]]
    assert simulated(spark, [order(1, 10, 13)], deeper)[1] == ("RISK_DAILY", 12, -77, 923, 131)  # open of the bar after
    peak = [("m", 10, 100, 200, 95, 120), ("m", 11, 120, 120, 50, 60), ("m", 12, 70, 70, 70, 70)]
    assert simulated(spark, [order(1, 10, 13)], peak)[1] == ("RISK_DRAWDOWN", 12, -32, 968, 150)


def test_what_has_no_later_bar_is_incomplete(spark):
    bars = [("m", 10, 100, 100, -5, 90)]
    assert simulated(spark, [order(1, 10, 12), order(2, 13, 14, session="e")], bars) == {1: ("INCOMPLETE", (1 << 63) - 1, 0, 1_000, 107), 2: ("OVERLAP", 13, 0, 1_000, 107)}
    assert simulated(spark, [order(1, 10, 12)], [], [("a", 11)])[1] == ("INCOMPLETE", 11, 0, 1_000, 0)


def test_refusals_in_their_order_and_flatten_times(spark):
    bars = [("m", t, 100, 101, 99, 100) for t in range(10, 30)]
    got = simulated(spark, [order(1, 10, 12), order(2, 12, 13), order(3, 13, 20, score=1.0), order(4, 13, 14, score=2.0), order(5, 15, 16), order(6, 16, 17, session="e", loss=251), order(7, 17, 25, session="e"), order(8, 26, 27, session="e")], bars, [("a", 21)])
    assert {i: r[0] for i, r in got.items()} == {1: "EXIT", 2: "OVERLAP", 3: "OVERLAP", 4: "EXIT", 5: "ENTRY_CAP", 6: "RISK_CAP", 7: "FLATTENED", 8: "EXIT"}
    assert got[7][1:3] == (21, -2)  # at the last close, less the fee


def test_a_session_or_the_account_is_blocked(spark):
    bars = [("m", 10, 100, 100, -5, 90), ("m", 11, 50, 50, 50, 50), *(("m", t, 100, 101, 99, 100) for t in range(12, 30))]
    got = simulated(spark, [order(1, 10, 12), order(2, 12, 13), order(3, 13, 14, session="e")], bars)
    assert {i: r[0] for i, r in got.items()} == {1: "RISK_DAILY", 2: "DAILY_STOP", 3: "EXIT"}
    bars[0] = ("m", 10, 100, 160, 5, 90)
    got = simulated(spark, [order(1, 10, 12), order(2, 12, 13), order(3, 13, 14, session="e")], bars)
    assert {i: r[0] for i, r in got.items()} == {1: "RISK_DRAWDOWN", 2: "DRAWDOWN", 3: "DRAWDOWN"}


def test_accounts_are_apart_and_short_positions_mark_the_other_way(spark):
    bars = [("m", 10, 100, 220, 100, 210), ("m", 11, 150, 150, 150, 150)]
    got = simulated(spark, [order(1, 10, 11, side=-1), order(2, 10, 11, account="b", exit_price=150)], bars)
    assert got[1][:3] == ("RISK_DAILY", 11, -52) and got[2][:3] == ("EXIT", 11, 48)


def test_one_contract_takes_the_best_of_each_time(spark):
    rows = [("f", 1, 3, 10, 0.5, 1.0, 0), ("f", 1, 2, 11, -2.0, 2.0, 1), ("f", 1, 9, 12, 2.0, 2.0, 0), ("f", 5, 6, 13, 9.0, 1.0, 0), ("f", 9, 10, 14, 0.0, 1.0, 0)]
    df = spark.createDataFrame(rows, "k string, entry long, exit long, candidate long, prediction double, volatility double, order int")
    assert {r["candidate"]: r["state"] for r in accounts.one_contract(df, ["k"]).collect()} == {10: "SIMULTANEOUS", 11: "SIMULTANEOUS", 12: "SELECTED", 13: "OVERLAP", 14: "SELECTED"}


def test_every_opportunity_of_a_strategy_ends_once(spark):
    kinds = "k string, candidate long, session long, checkpoint long, market int, score double, risk long, entry long, exit long, net long, complete boolean"
    rows = [
        ("s", 1, 1, 0, 0, None, 0, 1, 2, 5, True), ("s", 2, 1, 0, 0, 1.0, 0, 1, 2, None, True), ("s", 3, 1, 0, 0, 1.0, 9, 1, 2, 5, True), ("s", 4, 1, 0, 1, 2.0, 0, 1, 5, -3, True), ("s", 5, 1, 0, 2, 2.0, 0, 1, 5, 5, True),
        ("s", 6, 1, 1, 0, 1.0, 0, 4, 6, 5, True), ("s", 7, 1, 2, 0, 1.0, 0, 5, 6, -8, True), ("s", 8, 1, 3, 0, 1.0, 0, 7, 8, 5, True), ("s", 9, 2, 0, 0, 1.0, 0, 9, 9, 1, False), ("s", 10, 3, 0, 0, 1.0, 0, 10, 11, -20, True), ("s", 11, 4, 0, 0, 1.0, 0, 12, 13, 5, True), ("t", 12, 4, 0, 0, 1.0, 0, 12, 13, 5, True)]
    got = {r["candidate"]: (r["state"], r["net"]) for r in accounts.strategy_path(spark.createDataFrame(rows, kinds), ["k"], 8, 3, 10, 30).collect()}
    assert got == {1: ("HURDLE_FAILURE", 0), 2: ("MISSING_PRICE_PATH", 0), 3: ("RISK_CAP_REJECTION", 0), 4: ("ADMITTED_TRADE", -3), 5: ("CROSS_MARKET_RANKING_LOSS", 0), 6: ("OVERLAP_ABSTENTION", 0), 7: ("ADMITTED_TRADE", -8),
                   8: ("DAILY_STOP_ABSTENTION", 0), 9: ("MISSING_PRICE_PATH", 0), 10: ("ADMITTED_TRADE", -20), 11: ("DRAWDOWN_ABSTENTION", 0), 12: ("ADMITTED_TRADE", 5)}
