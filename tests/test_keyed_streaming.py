"""Keyed streaming state: timers, restarts in mid-stream, and the order in which history and live meet."""

import itertools

import pytest

from marlstone.streaming import keyed

S = 1_000_000_000
TICKS = "market string, at_ns long, seq long, price_nano long"
RECORDS = "instrument long, seq long, kind string, at_ns long, value long, until_ns long"


@pytest.fixture
def feed(spark, tmp_path):
    """Append files to a feed, and run a stream over what is there, from where its checkpoint stands."""

    def put(rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run(make, schema, out):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        processor = {"drain": keyed.Drain, "throttle": keyed.Throttle, "merge": keyed.Merge, "overview": keyed.Status, "stale": keyed.Stale, "sessions": keyed.Sessions}[out]
        return sorted(map(tuple, keyed.run(make(stream), f"{tmp_path}/{out}", f"{tmp_path}/{out}-state", processor.OUT).collect()), key=repr)

    return put, run


def test_batches_end_by_number_gap_and_timer_over_a_restart(feed):
    put, run = feed
    make = lambda s: keyed.drained(s, 3, 5 * S)
    put([("a", i * S, i, i) for i in (1, 2, 3, 10)], TICKS)
    assert run(make, TICKS, "drain") == [("a", 0, i, i - 1, "FULL") for i in (1, 2, 3)]
    put([("a", i * S, i, i) for i in (11, 20)] + [("b", 12 * S, 12, 0)], TICKS)  # goes on from the state of the first run
    now = run(make, TICKS, "drain")
    assert ("a", 1, 10, 0, "IDLE") in now and ("a", 1, 11, 1, "IDLE") in now and ("a", 2, 20, 0, "IDLE") not in now
    put([("~", 10**6 * S, 99, 0)], TICKS)  # time goes by, no record of a or b comes
    assert run(make, TICKS, "drain") == sorted([("a", 0, i, i - 1, "FULL") for i in (1, 2, 3)] + [("a", 1, 10, 0, "IDLE"), ("a", 1, 11, 1, "IDLE"), ("a", 2, 20, 0, "IDLE"), ("b", 0, 12, 0, "IDLE")], key=repr)
    assert run(make, TICKS, "drain") == run(make, TICKS, "drain")  # nothing new, nothing twice


def test_updates_are_given_out_once(feed):
    put, run = feed
    make = lambda s: keyed.throttled(s, 10 * S)
    put([("a", 1 * S, 1, 5), ("a", 3 * S, 2, 6)], TICKS)
    assert run(make, TICKS, "throttle") == []
    put([("a", 4 * S, 3, 7), ("a", 12 * S, 4, 8), ("a", 12 * S, 5, 9)], TICKS)
    put([("~", 10**6 * S, 99, 0)], TICKS)
    assert run(make, TICKS, "throttle") == [("a", 0, 7, 3), ("a", 1, 9, 2)]


def test_late_history_replaces_live_once_and_settled_time_stays(feed):
    put, run = feed
    put([(1, 1, "LIVE", 10, 100, 0), (1, 2, "LIVE", 20, 200, 0), (1, 3, "LIVE", 20, 200, 0), (2, 4, "HISTORY", 10, 5, 30)], RECORDS)
    first = run(keyed.merged, RECORDS, "merge")
    assert first == sorted([(1, 10, 100, "LIVE", "NEW", 1), (1, 20, 200, "LIVE", "NEW", 2), (2, 10, 5, "HISTORY", "NEW", 4)], key=repr)
    put([(1, 5, "HISTORY", 10, 101, 20), (1, 6, "HISTORY", 10, 101, 20), (1, 7, "HISTORY", 20, 201, 20), (2, 8, "LIVE", 10, 6, 0), (1, 9, "COMPLETED", 0, 0, 20)], RECORDS)
    put([(1, 10, "LIVE", 10, 999, 0), (1, 11, "HISTORY", 10, 998, 40), (1, 12, "HISTORY", 20, 202, 40), (1, 13, "HISTORY", 30, 300, 40)], RECORDS)
    found = run(keyed.merged, RECORDS, "merge")
    assert found == sorted([*first, (1, 10, 101, "HISTORY", "REPLACED", 5), (1, 20, 202, "HISTORY", "REPLACED", 12), (1, 30, 300, "HISTORY", "NEW", 13)], key=repr)


def test_the_last_mapping_names_the_market_over_batches(feed):
    put, run = feed
    kinds = "instrument_id long, at_ns long, seq long, symbol string, contract string, close double"
    put([(1, 1, 1, None, None, 5.0), (1, 2, 2, "ES", "ESH", None), (1, 3, 3, None, None, 10.0)], kinds)
    run(keyed.overview, kinds, "overview")
    put([(1, 4, 4, None, None, 11.0), (2, 5, 5, "ES", "ESM", None), (2, 6, 6, None, None, 22.0), (1, 7, 7, "NQ", "NQH", None), (1, 8, 8, None, None, 3.0), (3, 9, 9, None, None, 1.0)], kinds)
    got = {r[4]: (r[0], r[1], r[2], r[5], None if r[6] is None else round(r[6], 9)) for r in run(keyed.overview, kinds, "overview")}
    assert got == {3: ("ES", "ESH", 1, 10.0, None), 4: ("ES", "ESH", 1, 11.0, 10.0), 6: ("ES", "ESM", 2, 22.0, 100.0), 8: ("NQ", "NQH", 1, 3.0, None)}


def test_a_stream_cut_into_any_batches_gives_the_same(spark, tmp_path):
    """All at once, or file by file with a restart after each: the same rows."""
    rows = [("ab"[i % 2], (1 + i * 7 + (i % 5) * (i % 11)) * S, i, i) for i in range(40)]
    rows.sort(key=lambda r: r[1])
    end = [("~", 10**6 * S, 99, 0)]
    found = []
    for cut in ([0, 40], [0, 13, 14, 29, 40]):
        path = f"{tmp_path}/{len(cut)}"
        for i, (a, b) in enumerate(itertools.pairwise(cut)):
            spark.createDataFrame(rows[a:b] + (end if b == 40 else []), TICKS).coalesce(1).write.mode("append").parquet(f"{path}/in")
            stream = spark.readStream.schema(TICKS).parquet(f"{path}/in")
            got = keyed.run(keyed.drained(stream, 4, 9 * S), f"{path}/out", f"{path}/state", keyed.Drain.OUT)
        found.append(sorted(map(tuple, got.collect())))
    assert found[0] == found[1] and len(found[0]) == 40


def test_markets_go_stale_once_and_live_again(feed):
    put, run = feed
    make = lambda s: keyed.staleness(s, 10 * S)
    put([("a", 5 * S, 1, 0), ("a", 9 * S, 2, 0), ("b", 5 * S, 1, 0)], TICKS)
    put([("b", 17 * S, 2, 0)], TICKS)  # twelve seconds after: stale in between
    first = run(make, TICKS, "stale")
    assert ("b", "STALE", 15 * S, 5 * S) in first and ("b", "LIVE", 17 * S, 17 * S) in first and ("a", "STALE", 19 * S, 9 * S) not in first
    put([("~", 10**6 * S, 99, 0)], TICKS)
    assert [r for r in run(make, TICKS, "stale") if r[0] != "~"] == sorted([("a", "LIVE", 5 * S, 5 * S), ("a", "STALE", 19 * S, 9 * S), ("b", "LIVE", 5 * S, 5 * S), ("b", "STALE", 15 * S, 5 * S), ("b", "LIVE", 17 * S, 17 * S), ("b", "STALE", 27 * S, 17 * S)], key=repr)


def test_a_session_is_observed_once_and_never_goes_back(feed):
    put, run = feed
    kinds = "market string, at_ns long, seq long, session long, price_nano long"
    make = lambda s: keyed.sessions(s, 1_000 * S)
    put([("a", 1 * S, 1, 1, 10), ("a", 2 * S, 2, 1, 12)], kinds)
    put([("a", 3 * S, 3, 1, 11), ("a", 4 * S, 4, 2, 20), ("a", 5 * S, 5, 3, 9)], kinds)
    assert run(make, kinds, "sessions") == [("a", 1, 10, 11, 3, "NONE"), ("a", 2, 20, 20, 1, "UP")]
    put([("~", 10**6 * S, 99, 9, 0)], kinds)
    assert run(make, kinds, "sessions")[-1] == ("a", 3, 9, 9, 1, "FLAT")
    put([("a", (10**6 + 5) * S, 6, 2, 1)], kinds)
    with pytest.raises(Exception, match="session 2 after 3"):
        run(make, kinds, "sessions")
