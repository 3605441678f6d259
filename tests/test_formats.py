"""Files read in parts, and exact ranks, against plain definitions."""

import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import ranks
from marlstone.sources import ranges, readers
from marlstone.sources.readers import SourceError

FIELDS = {"at": "i8", "code": "u2", "x": "f8"}
KIND = np.dtype([("at", "<i8"), ("code", "<u2"), ("x", "<f8")])


def records_file(path, at, header=b"HDR"):
    rows = np.zeros(len(at), KIND)
    rows["at"], rows["code"], rows["x"] = at, np.arange(len(at)) % 7, np.arange(len(at)) / 3
    path.write_bytes(header + rows.tobytes())
    return rows


@pytest.mark.parametrize("rows", [1, 7, 100])
def test_records_by_ranges(spark, tmp_path, rows):
    want = {f"{n}.bin": records_file(tmp_path / f"{n}.bin", np.sort(np.random.default_rng(n).integers(0, 50, n))) for n in (0, 5, 23)}
    got = ranges.ranged_records(spark, str(tmp_path), FIELDS, "at", b"HDR", rows)
    assert got.rdd.getNumPartitions() == sum(max(1, -(-n // rows)) for n in (0, 5, 23))
    found = got.collect()
    assert len(found) == 28
    for r in found:
        own = want[r["file"].rsplit("/", 1)[1]][r["ordinal"]]
        assert (r["at"], r["code"], r["x"], bytes(r["raw"])) == (own["at"], own["code"], own["x"], own.tobytes())


def test_many_short_ranges_share_tasks(spark, tmp_path):
    """every range had a task of its own, so tasks grew with records, not with bytes."""
    want = {f"{n}.bin": records_file(tmp_path / f"{n}.bin", np.sort(np.random.default_rng(n).integers(0, 50, n))) for n in (0, 5, 700, 1_300)}
    got = ranges.ranged_records(spark, str(tmp_path), FIELDS, "at", b"HDR", 2)
    assert got.rdd.getNumPartitions() <= ranges.TASKS
    found = got.select("file", "ordinal", "at").collect()
    assert len({(r["file"], r["ordinal"]) for r in found}) == len(found) == 2_005
    assert all(r["at"] == want[r["file"].rsplit("/", 1)[1]][r["ordinal"]]["at"] for r in found)


def test_splits_of_lines_grow_with_bytes():
    """F8: splits had 8,192 bytes whatever the size of the files."""
    assert [readers.split_bytes(n) for n in (0, 64 * 8_192, 64 * 8_192 + 1)] == [8_192, 8_192, 8_193]
    for size in (10**8, 10**9, 10**10, 10**12):
        assert size / readers.split_bytes(size) <= max(64, size / (128 << 20))


def test_an_order_that_falls_across_a_seam_is_refused(spark, tmp_path):
    records_file(tmp_path / "a.bin", [1, 2, 3, 2, 5, 6])
    read = lambda rows, by="at": ranges.ranged_records(spark, str(tmp_path), FIELDS, by, b"HDR", rows).collect()
    for rows in (1, 2, 3, 6):  # with 3 the seam is where it falls
        with pytest.raises(Exception, match="at falls"):
            read(rows)
    assert len(read(3, None)) == 6


def test_files_that_are_no_records_are_refused(spark, tmp_path):
    for name, body, says in (("cut", b"HDR" + b"\0" * 17, "whole records"), ("short", b"HD", "whole records"), ("other", b"XXX" + b"\0" * 18, "another header")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.bin").write_bytes(body)
        with pytest.raises(Exception, match=says):
            ranges.ranged_records(spark, str(tmp_path / name), FIELDS, None, b"HDR").collect()


def test_written_records_come_back_and_are_counted(spark, tmp_path):
    rows = [(i, i * 7 % 5 // 2, -1.0 if i % 4 == 0 else i / 2) for i in range(40)]
    df = spark.createDataFrame(rows + rows[3:6], "at long, code int, x double")
    ranges.write_records(df.repartition(1).sortWithinPartitions("at"), f"{tmp_path}/out", FIELDS, b"HDR")
    back = ranges.ranged_records(spark, f"{tmp_path}/out", FIELDS, "at", b"HDR", 6)
    assert sorted((r["at"], r["code"], r["x"]) for r in back.collect()) == sorted(rows + rows[3:6])
    for span in (2, 100):
        c = ranges.counters(back, ["file"], "code", "at", {"x": -1.0}, span).first()
        codes = [r[1] for r in sorted(rows + rows[3:6])]
        want = (43, 43 * 18, 11, len(set(codes)), sum(a != b for a, b in zip(codes, codes[1:])), 0, 39, 3)  # noqa: B905
        assert (c["records"], c["bytes"], c["undefined"], c["identities"], c["rolls"], c["first"], c["last"], c["repeated"]) == want
    with pytest.raises(SourceError, match="budget"):
        ranges.decoded_to_parquet(back, f"{tmp_path}/parquet", 43 * 18 - 1, ["at"])
    assert ranges.decoded_to_parquet(back, f"{tmp_path}/parquet", 43 * 18, ["at", "code"]).count() == 43
    with pytest.raises(Exception, match="code is null"):
        ranges.write_records(spark.createDataFrame([(1, None, 1.0)], "at long, code int, x double"), f"{tmp_path}/bad", FIELDS)
    assert not list(tmp_path.glob("bad/*.bin"))


@pytest.mark.parametrize("split", [16, 100, 1 << 20])
def test_line_numbers_do_not_depend_on_splits(spark, tmp_path, split):
    rnd = random.Random(1)
    files = {f"{k}.jsonl": [rnd.choice([json.dumps({"a": i}), json.dumps({"a": i, "b": "ü" * rnd.randint(0, 40)}), "", "[1]", "{", '{"a": 1}']) for i in range(n)] for k, n in (("x", 60), ("y", 7), ("z", 1))}
    for name, lines in files.items():
        (tmp_path / name).write_text("\n".join(lines) + ("\n" if name != "y.jsonl" else ""), encoding="utf-8")
    key = "spark.sql.files.maxPartitionBytes"
    was = spark.conf.get(key)
    spark.conf.set(key, str(split))
    try:
        got = readers.numbered_json_lines(spark, str(tmp_path), "a long, b string").collect()
    finally:
        spark.conf.set(key, was)
    found = {(r["file"].rsplit("/", 1)[1], r["line_number"]): r for r in got}
    n = {name: len(lines) - (name == "y.jsonl" and lines[-1] == "") for name, lines in files.items()}
    assert len(got) == len(found) == sum(n.values())
    for name, lines in files.items():
        seen = set()
        for i, line in enumerate(lines[: n[name]], 1):
            r = found[name, i]
            assert r["line_sha256"] == hashlib.sha256(line.encode()).hexdigest()
            assert r["state"] == ("BLANK" if not line else "INVALID" if line in ("[1]", "{") else "DUPLICATE" if line in seen else "OK"), line
            assert (r["record"] is not None) == (line.startswith("{") and line != "{") and (r["record"] is None or r["record"]["a"] == json.loads(line)["a"])
            seen.add(line)


def test_ranks_of_any_group(spark):
    rnd = random.Random(2)
    rows = [(k, v) for k, n in (("a", 1), ("b", 2), ("c", 97), (None, 30), ("ties", 50), ("none", 0)) for v in [float(rnd.choice([1, 1, 2, 3]) if k == "ties" else rnd.randint(-99, 99)) for _ in range(n)]]
    df = spark.createDataFrame([*rows, ("none", None), ("c", None)], "k string, x double").repartition(5)
    shares = (0.0, 0.25, 0.5, 0.6, 0.95, 1.0)
    asked = {f"r{i}": ranks.nearest_rank(p) for i, p in enumerate(shares)} | {f"i{i}": ranks.nearest_index(p) for i, p in enumerate(shares)}
    got = {r["k"]: r for r in ranks.selected(df, ["k"], "x", asked).collect()}
    assert set(got) == {"a", "b", "c", None, "ties"}
    whole = ranks.selected(df, [], "x", asked).first()
    for r, own in [(got[k], sorted(v for g, v in rows if g == k)) for k in got] + [(whole, sorted(v for _, v in rows))]:
        assert r["n"] == len(own)
        for i, p in enumerate(shares):
            assert r[f"r{i}"] == own[max(1, math.ceil(p * len(own))) - 1]
            assert r[f"i{i}"] == own[round((len(own) - 1) * p)] == float(np.quantile(own, p, method="nearest"))
    assert ranks.selected(df.where("k = 'none'"), ["k"], "x", asked).count() == 0
    assert {(r["k"], r["level"]): r["n"] for r in ranks.coverage(df.where(F.col("k") == "ties"), ["k"], "x", [1.0, 2.5]).collect()} == {("ties", v): sum(x <= v for g, x in rows if g == "ties") for v in (1.0, 2.5)}
