"""Account paths and admission rules: state machines over the ordered trades of one strategy or account.

What has a closed form over windows is written so; the others are folds over the rows of a key in their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock
from . import scans
from .sequences import folded


def schedule(candidates: DataFrame, keys: list[str], most_risk: int, most_per_session: int, daily_stop: int, most_drawdown: int) -> DataFrame:
    """One position at a time; each candidate (session, entry, exit, risk, pnl) gets its terminal state.

    In order of entry: RISK_CAP, OVERLAP, SESSION_CAP, DAILY_STOP and DRAWDOWN refuse it, else it's ADMITTED. Losses
    count when a trade is closed, before the next entry; the daily stop lasts its session, the drawdown for good.
    """

    def step(state: tuple, row) -> tuple[tuple, tuple]:
        free, session, taken, day, equity, peak, halted = state
        if row.session != session:
            session, taken, day = row.session, 0, 0
        code = "RISK_CAP" if row.risk > most_risk else "OVERLAP" if row.entry < free else "SESSION_CAP" if taken >= most_per_session else "DAILY_STOP" if day <= -daily_stop else "DRAWDOWN" if halted else "ADMITTED"
        if code == "ADMITTED":
            free, taken, day, equity = row.exit, taken + 1, day + row.pnl, equity + row.pnl
            peak = max(peak, equity)
            halted = peak - equity >= most_drawdown
        return (free, session, taken, day, equity, peak, halted), (code,)

    return folded(candidates, keys, ["entry", "candidate"], lambda: (-(1 << 62), None, 0, 0, 0, 0, False), step, [*keys, "candidate", "session", "entry", "pnl"], "state string")


def account_path(marks: DataFrame, keys: list[str], starting: int, most_loss: int, span: int = scans.SPAN) -> DataFrame:
    """Equity over ordered marks (at, best, worst, close as amounts): the first that breaches the floor is LIQUIDATED.

    On each mark the favourable extreme lifts the peak before the adverse one is tested. Marks after the breach are
    HALTED. An account is cut into blocks of ``span`` of ``at``.
    """
    rows = scans.lifted(marks, keys, ["at"], F.col("close"), F.col("best"), span)
    rows = rows.withColumn("before", F.col("before") + starting).withColumn("peak", F.greatest(F.lit(starting), F.col("peak") + starting))
    rows = rows.withColumn("breach", F.col("before") + F.col("worst") <= F.col("peak") - most_loss)
    rows = scans.after_first(rows, keys, ["at"], "breach", "_broken", span)
    state = F.when(F.col("_broken") > 0, "HALTED").when(F.col("breach"), "LIQUIDATED").otherwise("OPEN")
    out = rows.withColumn("state", state).withColumn("equity", F.when(F.col("state") == "OPEN", F.col("before") + F.col("close")))
    return out.select(*marks.columns, "peak", "state", "equity")


_EVENT = "account, at, rank, tie, order_id, session, market, side, entry, fee, loss, exit_price, open, high, low, close"


def account_events(orders: DataFrame, bars: DataFrame, flattens: DataFrame, bucket: int, reach: int) -> DataFrame:
    """One stream of events for each account: bars (rank 0), exits (1), flatten times (2), orders (3) and an end (4).

    ``orders``: account, order_id, session, market, side (1 or -1), at, entry, exit_at, exit_price, fee, loss, score;
    ``bars``: market, at, open, high, low, close; ``flattens``: account, at. An account gets the bars of a market from
    an order's entry to ``reach`` after its exit, each once; orders are dealt over buckets of time, so that they meet
    bars by equality. An order carries the bar that it enters in. Orders of one time stand by falling score, then id.
    """
    spanned = orders.select("account", "market", F.col("at").alias("_from"), (F.col("exit_at") + reach).alias("_to"))
    dealt = spanned.withColumn("_bucket", F.explode(F.sequence(clock.floor_div("_from", bucket), clock.floor_div("_to", bucket)))).join(bars.withColumn("_bucket", clock.floor_div("at", bucket)), ["market", "_bucket"])
    seen = dealt.where("at BETWEEN _from AND _to").select("account", "market", "at", "open", "high", "low", "close").distinct()
    none = lambda kind: F.lit(None).cast(kind)
    money = dict(orders.dtypes)["entry"]

    def event(rows: DataFrame, rank: int, **columns: F.Column | str) -> DataFrame:
        kinds = {"order_id": "string", "session": "string", "market": "string", "side": "int"}
        given = {"rank": F.lit(rank), "tie": F.lit(0.0), **columns}
        return rows.select(*(given[c].alias(c) if c in given else F.col(c) if c in rows.columns else none(kinds.get(c, money)).alias(c) for c in _EVENT.split(", ")))

    orders = orders.withColumn("order_id", F.col("order_id").cast("string"))
    entered = orders.join(bars.select("market", "at", "open", "high", "low", "close"), ["market", "at"], "left").withColumn("side", F.col("side").cast("int"))
    exits = orders.select("account", "order_id", F.col("exit_at").alias("at"), "exit_price")
    ends = orders.select("account").distinct().withColumn("at", F.lit((1 << 63) - 1))
    parts = [event(seen, 0), event(exits, 1), event(flattens.select("account", "at").distinct(), 2), event(entered, 3, tie=-F.col("score").cast("double")), event(ends, 4)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def simulated(events: DataFrame, starting: int, most_loss: int, most_entries: int, daily_limit: int, drawdown_limit: int) -> DataFrame:
    """Each order's end on its account's events: account, order_id, state, closed_at, net, equity, peak, max_drawdown.

    An order is refused by RISK_CAP, OVERLAP (also at the very time of an exit), DAILY_STOP, DRAWDOWN or ENTRY_CAP, in
    this order, or opens the account's only position. Every bar of that marks the equity, the favourable extreme first; where the adverse one loses
    ``daily_limit`` of the session's start or ``drawdown_limit`` of the peak, the position is liquidated at the next
    bar's open, as RISK_DRAWDOWN or RISK_DAILY, and the session, or the account for good, takes no more orders. Else it
    ends by its own EXIT, or at a flatten time at the last close, as FLATTENED. What finds no price to end at is
    INCOMPLETE and leaves the equity as it was.
    """

    def step(state: tuple, e) -> tuple[tuple, tuple]:
        pos, equity, peak, worst, session, start, entries, blocked, halted, pending, last, until = state
        out: tuple = (None, None, None)
        value = lambda price: equity + pos[3] * (int(price) - pos[4]) - pos[5]

        def marked(bar) -> None:
            nonlocal peak, worst, pending, last
            good, bad = (bar.high, bar.low) if pos[3] > 0 else (bar.low, bar.high)
            peak = max(peak, value(good))
            down = value(bad)
            worst, last = max(worst, peak - down), int(bar.close)
            pending = "RISK_DRAWDOWN" if peak - down >= drawdown_limit else "RISK_DAILY" if pos[6] - down >= daily_limit else None

        def closed(how: str, price) -> None:
            nonlocal pos, equity, peak, worst, blocked, halted, pending, last, until, out
            after = value(price)
            if how in ("EXIT", "FLATTENED"):
                peak = max(peak, after)
            worst = max(worst, peak - after)
            out = (pos[0], how, after - equity)
            blocked = blocked or (how == "RISK_DAILY" and pos[2] == session)
            halted = halted or how == "RISK_DRAWDOWN" or peak - after >= drawdown_limit
            pos, equity, pending, last, until = None, after, None, None, e.at

        if e.rank == 0 and pos is not None and e.market == pos[1]:
            closed(pending, e.open) if pending else marked(e)
        elif e.rank == 1 and pos is not None and e.order_id == pos[0] and not pending:
            closed("EXIT", e.exit_price)
        elif e.rank == 2 and pos is not None and not pending and last is not None:
            closed("FLATTENED", last)
        elif e.rank == 4 or (e.rank == 2 and pos is not None and not pending):
            if pos is not None:
                out, pos, pending = (pos[0], "INCOMPLETE", 0), None, None
        elif e.rank == 3:
            if e.session != session:
                session, start, entries, blocked = e.session, equity, 0, False
            why = "RISK_CAP" if e.loss > most_loss else "OVERLAP" if pos is not None or e.at <= until else "DAILY_STOP" if blocked else "DRAWDOWN" if halted else "ENTRY_CAP" if entries >= most_entries else None
            if why:
                out = (e.order_id, why, 0)
            else:
                pos, entries, peak, last = (e.order_id, e.market, session, int(e.side), int(e.entry), int(e.fee), start), entries + 1, max(peak, equity), None
                if e.high == e.high:  # there is a bar
                    marked(e)
        return (pos, equity, peak, worst, session, start, entries, blocked, halted, pending, last, until), (*out, equity, peak, worst)

    begin = lambda: (None, starting, starting, 0, None, starting, 0, False, False, None, None, -(1 << 63))
    made = folded(events, ["account"], ["at", "rank", "tie", "order_id", "market"], begin, step, ["account", "at"], "order_id string, state string, net long, equity long, peak long, max_drawdown long")
    return made.where("state is not null").withColumnRenamed("at", "closed_at")


def one_contract(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """One position at a time, chosen by risk-adjusted score: candidates (entry, exit, candidate, prediction, volatility, order).

    Of the candidates of one entry time the one with the largest |prediction| / volatility is SELECTED, ties by
    ``order``, then by candidate, and the others are SIMULTANEOUS; all of a time before the open position's exit are
    OVERLAP. A candidate without a positive volatility is an error of the caller.
    """
    score = F.abs("prediction") / F.col("volatility")
    ranked = candidates.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "entry").orderBy(F.desc(score), "order", "candidate")))

    def step(state: tuple, row) -> tuple[tuple, tuple]:
        until, now, taken = state
        first = row.entry != now
        if first:
            taken = row.entry >= until
        if first and taken:
            until = row.exit
        return (until, row.entry, taken), ("OVERLAP" if not taken else "SELECTED" if first else "SIMULTANEOUS",)

    return folded(ranked, keys, ["entry", "_rank"], lambda: (-(1 << 62), None, False), step, [*keys, "candidate", "entry"], "state string")


def strategy_path(opportunities: DataFrame, keys: list[str], most_risk: int, most_entries: int, daily_stop: int, drawdown_stop: int) -> DataFrame:
    """The terminal state of every opportunity of a strategy, and what the admitted ones made: keys, candidate, state, net, equity.

    ``opportunities``: candidate, session, checkpoint, market (by its place), score (null: no signal), risk, entry, exit,
    net (null: no outcome), complete (whether the session is). HURDLE_FAILURE, MISSING_PRICE_PATH and RISK_CAP_REJECTION
    need no order; of what is left at one session and checkpoint the best score goes on, ties by market, and the others
    are CROSS_MARKET_RANKING_LOSS. The winners are taken by entry time: a session that isn't complete, an open position,
    the session's loss, the drawdown and the session's entries refuse them, in this order.
    """
    early = F.when(F.col("score").isNull(), "HURDLE_FAILURE").when(F.col("net").isNull(), "MISSING_PRICE_PATH").when(F.col("risk") > most_risk, "RISK_CAP_REJECTION")
    told = opportunities.withColumn("_early", early)
    best = F.row_number().over(Window.partitionBy(*keys, "session", "checkpoint").orderBy(F.desc("score"), "market", "candidate"))
    ranked = told.where("_early is null").withColumn("_rank", best)
    done = told.where("_early is not null").select(*keys, "candidate", F.col("_early").alias("state"))
    done = done.unionByName(ranked.where("_rank > 1").select(*keys, "candidate", F.lit("CROSS_MARKET_RANKING_LOSS").alias("state")))
    done = done.select("*", F.lit(0).cast("long").alias("net"), F.lit(None).cast("long").alias("equity"))

    def step(state: tuple, row) -> tuple[tuple, tuple]:
        until, session, taken, day, equity, peak = state
        if row.session != session:
            session, taken, day = row.session, 0, 0
        code = (
            "MISSING_PRICE_PATH" if not row.complete else "OVERLAP_ABSTENTION" if row.entry < until else "DAILY_STOP_ABSTENTION" if day <= -daily_stop
            else "DRAWDOWN_ABSTENTION" if peak - equity >= drawdown_stop else "ENTRY_CAP_ABSTENTION" if taken >= most_entries else "ADMITTED_TRADE")
        net = int(row.net) if code == "ADMITTED_TRADE" else 0
        if code == "ADMITTED_TRADE":
            until, taken, day, equity = row.exit, taken + 1, day + net, equity + net
            peak = max(peak, equity)
        return (until, session, taken, day, equity, peak), (code, net, equity)

    kept = [*keys, "candidate"]
    winners = folded(ranked.where("_rank = 1"), keys, ["entry", "market", "candidate"], lambda: (-(1 << 62), None, 0, 0, 0, 0), step, kept, "state string, net long, equity long")
    return winners.unionByName(done)


def pilot(actions: DataFrame, keys: list[str], halt: int) -> DataFrame:
    """Sessions in order (session, filled, net, best, worst as the marks' extremes, best first): halted for good once ``halt`` below the peak.

    Marks move the peak and the drawdown, only realised equity halts. A session without a fill is NO_FILL whatever
    the account's state.
    """

    def step(state: tuple, row) -> tuple[tuple, tuple]:
        equity, peak, worst, halted = state
        code, net = "NO_FILL" if not row.filled else "DRAWDOWN_BLOCKED" if halted else "ADMITTED", 0
        if code == "ADMITTED":
            peak = max(peak, equity + row.best)
            worst = max(worst, peak - equity - row.worst)
            net, equity = row.net, equity + row.net
            peak = max(peak, equity)
            worst, halted = max(worst, peak - equity), peak - equity >= halt
        return (equity, peak, worst, halted), (code, net, equity, worst)

    return folded(actions, keys, ["session"], lambda: (0, 0, 0, False), step, [*keys, "session"], "state string, net long, equity long, max_drawdown long")


def audited_paths(paths: DataFrame, keys: list[str], most_risk: int, most_entries: int, daily_stop: int, drawdown_stop: int, most_hold: int, cutoff: int) -> DataFrame:
    """Paths (path, session, entry, exit, risk, ok, to_roll, ends_session, gross, worst, cost) judged for what could really happen.

    REJECTED by risk, source or nearness to the roll; SKIPPED by the schedule or a circuit; BYPASS if held too long
    without a session's end. An accepted path whose worst open loss breaks the daily or the drawdown stop is FLATTENED
    at the worse of both results, and the circuit is locked: the session's, or the account's for good.
    """

    def step(state: tuple, row) -> tuple[tuple, tuple]:
        until, session, taken, day, locked, equity, peak, halted = state
        if row.session != session:
            session, taken, day, locked = row.session, 0, 0, False
        code, net = None, 0
        if row.risk > most_risk or not row.ok or row.to_roll < cutoff:
            code = "REJECTED"
        elif row.entry < until or taken >= most_entries or locked or halted:
            code = "SKIPPED"
        elif row.exit - row.entry > most_hold and not row.ends_session:
            code = "BYPASS"
        else:
            net, low = row.gross - row.cost, row.worst - row.cost
            by_day, by_peak = day + low <= -daily_stop, peak - (equity + min(low, 0)) >= drawdown_stop
            if by_day or by_peak:
                net, locked, halted = min(net, low), locked or by_day, halted or by_peak
            code = "FLATTENED" if by_day or by_peak else "ACCEPTED"
            until, taken, day, equity = row.exit, taken + 1, day + net, equity + net
            peak = max(peak, equity)
        return (until, session, taken, day, locked, equity, peak, halted), (code, net, equity)

    return folded(paths, keys, ["entry", "path"], lambda: (0, None, 0, 0, False, 0, 0, False), step, [*keys, "path"], "state string, net long, equity long")


def scenario_trades(trades: DataFrame, keys: list[str], daily_stop: int, drawdown_stop: int) -> DataFrame:
    """Closed trades (trade, session, entry, gross, cost, quantity) under one cost scenario: SKIPPED after either stop, which lasts while it is broken.

    Costs are per contract. A session's loss is its own; equity below the peak skips until it rises, which it can't,
    as nothing is traded then.
    """

    def step(state: tuple, row) -> tuple[tuple, tuple]:
        session, day, equity, peak = state
        if row.session != session:
            session, day = row.session, 0
        if day <= -daily_stop or peak - equity >= drawdown_stop:
            return (session, day, equity, peak), ("SKIPPED", 0, equity)
        net = row.gross - row.cost * abs(row.quantity)
        day, equity = day + net, equity + net
        return (session, day, equity, max(peak, equity)), ("TRADED", net, equity)

    return folded(trades, keys, ["entry", "trade"], lambda: (None, 0, 0, 0), step, [*keys, "trade"], "state string, net long, equity long")


def trailing_floor(balances: DataFrame, keys: list[str], order: str, balance: str, most_loss: int, lock: int, span: int = scans.SPAN) -> DataFrame:
    """End-of-day floor: never falls, follows the balance less the allowed loss, and locks; repeated events count once."""
    once = balances.dropDuplicates([*keys, order])
    rows = scans.lifted(once, keys, [order], F.lit(0), F.col(balance) - most_loss, span)
    return rows.withColumn("floor", F.least(F.lit(lock), "peak")).select(*once.columns, "floor")


def payouts(requests: DataFrame, keys: list[str], cushion: int, share: float) -> DataFrame:
    """Requests (request, at, balance, floor, amount) once each: PAID with the trader's share, or REFUSED for the cushion.

    Earlier payments lower the balance that later requests see.
    """

    def step(paid: int, row) -> tuple[int, tuple]:
        ok = row.amount > 0 and row.balance - paid - row.amount >= row.floor + cushion
        return paid + (row.amount if ok else 0), ("PAID" if ok else "REFUSED", row.amount * share if ok else 0.0)

    once = requests.dropDuplicates([*keys, "request"])
    return folded(once, keys, ["at", "request"], lambda: 0, step, [*keys, "request", "at", "amount"], "state string, trader_share double")


def order_guard(orders: DataFrame, keys: list[str], at: str, fields: list[str], window: int, most: int) -> DataFrame:
    """Orders with RATE where more than ``most`` fall in the trailing window, DUPLICATE where an equal one is in it."""
    trailing = Window.partitionBy(*keys).orderBy(at).rangeBetween(-window + 1, 0)
    same = Window.partitionBy(*keys, *fields).orderBy(at).rangeBetween(-window + 1, 0)
    state = F.when(F.count("*").over(same) > 1, "DUPLICATE").when(F.count("*").over(trailing) > most, "RATE").otherwise("OK")
    return orders.withColumn("state", state)


def inactivity(last_seen_days: str) -> F.Column:
    d = F.col(last_seen_days)
    return F.when(d >= 7, "CLOSED").when(d == 6, "FINAL_NOTICE").when(d == 5, "WARNING").otherwise("ACTIVE")


def position_units(minis: str, micros: str) -> F.Column:
    """Open size in micro contracts."""
    return F.coalesce(F.col(minis), F.lit(0)) * 10 + F.coalesce(F.col(micros), F.lit(0))


def order_size(requests: DataFrame, exposures: DataFrame, account: str, symbol: str, caps: dict[str, int]) -> DataFrame:
    """Largest size that every cap allows: risk per trade, open risk, symbol size and the cushion above the floor.

    ``requests``: account, symbol, unit_risk, cushion; ``exposures``: account, symbol, size, risk.
    """
    total = exposures.groupBy(account).agg(F.sum("risk").alias("_risk"))
    own = exposures.groupBy(account, symbol).agg(F.sum("size").alias("_size"))
    r = requests.join(total, account, "left").join(own, [account, symbol], "left")
    per = lambda amount: F.floor(amount / F.col("unit_risk")).cast("long")
    risk, size = F.coalesce("_risk", F.lit(0)), F.coalesce("_size", F.lit(0))
    allowed = F.least(per(F.lit(caps["trade_risk"])), per(caps["open_risk"] - risk), caps["symbol_size"] - size, per(F.col("cushion") - caps["reserve"]))
    return r.withColumn("allowed", F.greatest(F.lit(0), allowed).cast("long")).withColumn("state", F.when(allowed > 0, "SIZED").otherwise("BREACH")).drop("_risk", "_size")
