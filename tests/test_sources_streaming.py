import pytest

from marlstone.operators import bars
from marlstone.plans import tables
from marlstone.sources import readers, sinks
from marlstone.streaming import candles

SMALL = "/root/testdata/sf0.001"


def test_exact_schema(spark, tmp_path):
    df = spark.range(3).selectExpr("id", "cast(id AS string) AS name")
    df.write.parquet(str(tmp_path / "t"))
    found = spark.read.parquet(str(tmp_path / "t")).schema
    assert readers.exact(spark, str(tmp_path / "t"), found).count() == 3
    with pytest.raises(readers.SourceError):
        readers.exact(spark, str(tmp_path / "t"), df.select("name", "id").schema)
    with pytest.raises(readers.SourceError):
        readers.projected(spark, str(tmp_path / "t"), ["id", "price"])
    assert "value" not in readers.without_prices(spark, f"{SMALL}/events.parquet").columns


def test_sentinels_become_nulls_with_a_state(spark):
    df = spark.sql("SELECT cast(18446744073709551615 AS decimal(20,0)) AS v UNION ALL SELECT cast(7 AS decimal(20,0))")
    assert sorted(map(tuple, readers.nullified(df, {"v": 2**64 - 1}).collect()), key=str) == [(7, "DEFINED"), (None, "UNDEFINED")]


def test_json_lines_fail_closed(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{"a": \n')
    assert readers.json_lines(spark, str(tmp_path / "good.jsonl"), "a int").count() == 2
    with pytest.raises(Exception, match=r"(?i)malformed"):
        readers.json_lines(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    assert [r["record"] for r in readers.numbered_json_lines(spark, str(tmp_path / "bad.jsonl"), "a int").orderBy("line_number").collect()][0]["a"] == 1


def test_catalog_opens_one_path_for_a_purpose(spark):
    c = spark.createDataFrame([("es", 2020, "p1", ["research"]), ("es", 2021, "p2", ["holdout"])], "market string, year int, path string, purposes array<string>")
    assert readers.resolved(c, "es", 2020, "research") == "p1"
    with pytest.raises(readers.SourceError):
        readers.resolved(c, "es", 2021, "research")


def test_publication_verifies_and_refuses_a_second(spark, tmp_path):
    df = spark.range(10).selectExpr("id % 2 AS k", "id", "array(id) AS l")
    m = sinks.published(df.drop("l"), str(tmp_path / "r"), ["k"], ["id"], ["src"], {"by": "test"})
    assert sinks.verified(spark, str(tmp_path / "r"), ["k"], ["id"]).count() == 10
    assert m["release_id"] == sinks.manifest(df, ["k"], ["id"], ["src"], {"by": "test"})["release_id"]
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.published(df.drop("l"), str(tmp_path / "r"), ["k"], ["id"], ["src"], {})
    sinks.csv(df, str(tmp_path / "c"))
    assert readers.csv(spark, str(tmp_path / "c"), "k long, id long, l string").where("l = '[3]'").first()["id"] == 3


def test_intervals_must_not_overlap(spark):
    a, b = spark.range(0, 5), spark.range(5, 9)
    assert sinks.merged_intervals([a, b], "id").count() == 9
    with pytest.raises(readers.SourceError):
        sinks.merged_intervals([a, spark.range(4, 9)], "id")


def test_versioned_upsert(spark, tmp_path):
    row = "k int, at int, v string"
    sinks.upsert(spark, str(tmp_path), spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], row), ["k"], "at", 0)
    got = sinks.upsert(spark, str(tmp_path), spark.createDataFrame([(1, 0, "new")], row), ["k"], "at", 1)
    assert sorted(map(tuple, got.select("k", "at", "v").collect())) == [(1, 0, "new"), (2, 1, "c")]


def test_streamed_candles_equal_the_batch(spark, tmp_path):
    t = tables.trades(spark, SMALL).select("market", "event_at_ns", "price_nano", "size")
    step = 3600 * 10**9
    cut = t.agg({"event_at_ns": "avg"}).first()[0]
    t.where(f"event_at_ns < {cut}").coalesce(1).write.parquet(str(tmp_path / "in"))
    t.where(f"event_at_ns >= {cut}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = {}

    def sink(batch, _):
        for r in batch.collect():
            seen[r["market"], r["bucket_ns"]] = tuple(r)[2:7]

    candles.run_once(candles.candles(candles.trades(spark, str(tmp_path / "in"), t.schema.simpleString()[7:-1].replace(":", " "), 10), step), str(tmp_path / "cp"), sink)
    want = {(r["market"], r["event_at_ns"]): tuple(r)[2:] for r in bars.ohlcv(t, ["market"], "event_at_ns", "price_nano", "size", step).collect()}
    assert seen == want


def test_late_trades_are_ignored_and_counted(spark, tmp_path):
    schema = "market string, event_at_ns long, price_nano long, size long"
    for i, rows in enumerate([[("a", 10, 5, 1), ("a", 70, 6, 1)], [("a", 65, 99, 1), ("a", 80, 7, 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/part={i}"))
    out = []
    stream = candles.candles(candles.trades(spark, str(tmp_path / "in/*"), schema), 60)
    candles.run_once(stream, str(tmp_path / "cp"), lambda b, _: out.extend(map(tuple, b.collect())))
    assert out[-1] == ("a", 60, 6, 7, 6, 7, 2, 1)


def test_aggregated_candles_equal_those_of_the_state(spark, tmp_path):
    import random

    rnd, schema = random.Random(1), "market string, event_at_ns long, price_nano long, size long"
    out = []
    for i in range(5):
        rows = [(rnd.choice(["a", "b", None]) if i else "a", at, rnd.randint(1, 99), rnd.randint(1, 3)) for at in rnd.sample(range(max(0, 120 * i - 40), 120 * i + 100), 30)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/part={i}")
    stream = lambda: candles.trades(spark, str(tmp_path / "in/*"), schema)
    candles.run_once(candles.candles(stream().where("market is not null"), 60), str(tmp_path / "cp"), lambda b, n: out.extend((n, *r) for r in b.collect()))
    candles.run_once(stream().where("market is not null"), str(tmp_path / "cp2"), candles.aggregated(str(tmp_path / "out"), 60))
    got = {(r["batch"], r["market"], r["bucket_ns"]): (r["open_nano"], r["high_nano"], r["low_nano"], r["close_nano"], r["volume"]) for r in spark.read.parquet(f"{tmp_path}/out/candles").collect()}
    assert got == {(n, m, b): tuple(r[:5]) for n, m, b, *r in out}
    ignored = {r["market"]: r["ignored"] for r in spark.read.parquet(f"{tmp_path}/out/state/batch=4").collect()}
    assert ignored == {m: max(r[-1] for r in out if r[1] == m) for m in "ab"} and sum(ignored.values()) > 0
    again = candles.aggregated(str(tmp_path / "out"), 60)
    again(spark.read.schema(schema).parquet(f"{tmp_path}/in/part=4").where("market is not null"), 4)  # given again: replaces itself
    assert {(r["batch"], r["market"], r["bucket_ns"]) for r in spark.read.parquet(f"{tmp_path}/out/candles").collect()} == set(got)


def test_staleness_and_replay(spark):
    df = spark.createDataFrame([("a", 100), ("b", 10)], "market string, last_ns long")
    assert sorted(r["state"] for r in candles.stale(df, 120, 50).collect()) == ["LIVE", "STALE"]
    w = spark.createDataFrame([("a", 5), ("b", None)], "market string, watermark_ns long")
    assert [r["replay_from_ns"] for r in candles.replay_start(w, 3).orderBy("market").collect()] == [5, 3]


def test_binary_records(spark, tmp_path):
    import numpy as np
    import zstandard

    from marlstone.sources import binary

    kind = np.dtype([("ts_recv", "<i8"), ("id", "<u4"), ("price", "<i8")])
    rows = np.array([(i * 10, 4_000_000_000 + i, -i) for i in range(1000)], kind)
    (tmp_path / "a.bin").write_bytes(b"HDR" + rows.tobytes())
    (tmp_path / "b.bin").write_bytes(zstandard.compress(b"HDR" + rows[:10].tobytes()))
    fields = {"ts_recv": "i8", "id": "u4", "price": "i8"}
    got = binary.with_row_ids(binary.records(spark, str(tmp_path), fields, "ts_recv", b"HDR", rows=64))
    assert got.count() == 1010
    assert got.select("row_sha256").distinct().count() == 1010
    assert got.agg({"id": "max", "price": "min", "ordinal": "max"}).first().asDict() == {"max(id)": 4_000_000_999, "min(price)": -999, "max(ordinal)": 999}
    (tmp_path / "c.bin").write_bytes(b"HDR" + rows[::-1].tobytes())
    with pytest.raises(Exception, match="ts_recv falls"):
        binary.records(spark, str(tmp_path / "c.bin"), fields, "ts_recv", b"HDR").count()
    (tmp_path / "d.bin").write_bytes(b"HDR" + rows.tobytes()[:-1])
    with pytest.raises(Exception, match="cut off"):
        binary.records(spark, str(tmp_path / "d.bin"), fields, "ts_recv", b"HDR").count()
