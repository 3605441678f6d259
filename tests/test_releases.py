"""Releases by interval, by hand."""

from pyspark.sql import functions as F

from marlstone.operators import releases

KINDS = "k string, part long, at long, x string"
KEYS, COLUMNS = ["k", "part"], ["k", "at", "x"]


def test_parts_are_checked_and_only_verified_ones_are_used(spark):
    rows = [("a", p, p * 10 + i, f"v{i}") for p in range(4) for i in range(3)] + [(None, 0, 1, None)]
    df = spark.createDataFrame(rows, KINDS)
    stated = releases.manifest(df, "raw", KEYS, "at", COLUMNS)
    assert {(r["k"], r["part"]): (r["rows"], r["first"], r["last"]) for r in stated.collect()} == {("a", p): (3, p * 10, p * 10 + 2) for p in range(4)} | {(None, 0): (1, 1, 1)}
    assert stated.select("release_id").distinct().count() == 5
    again = releases.manifest(df.repartition(7), "raw", KEYS, "at", COLUMNS)
    assert set(map(tuple, again.collect())) == set(map(tuple, stated.collect()))  # neither order nor files matter
    now = df.where("part <> 1 OR at <> 11").where("part <> 2").union(spark.createDataFrame([("b", 9, 1, "new")], KINDS)).withColumn("x", F.when((F.col("part") == 3) & (F.col("at") == 30), "w").otherwise(F.col("x")))
    states = releases.checked(now, stated, "raw", KEYS, "at", COLUMNS)
    assert {(r["k"], r["part"]): r["state"] for r in states.collect()} == {("a", 0): "VERIFIED", ("a", 1): "CHANGED", ("a", 2): "MISSING", ("a", 3): "CHANGED", ("b", 9): "UNEXPECTED", (None, 0): "VERIFIED"}
    used = releases.consumed(now, states, KEYS)
    assert {(r["k"], r["part"]) for r in used.collect()} == {("a", 0), (None, 0)}
    causal = releases.manifest(used, "causal", KEYS, "at", COLUMNS, used.groupBy(*KEYS).agg(F.min("source_id").alias("source_id")))
    ids = {(r["k"], r["part"]): r["release_id"] for r in stated.collect()}
    assert all(r["source_id"] == ids[r["k"], r["part"]] != r["release_id"] for r in causal.collect())


def test_merged_parts_must_not_overlap_nor_miss(spark):
    parts = spark.createDataFrame([("a", 0, 0, 9), ("a", 1, 10, 19), ("b", 0, 0, 10), ("b", 1, 10, 19), ("c", 0, 0, 9), ("c", 1, 5, 19), ("d", 0, 0, 9)], "k string, part long, first long, last long").withColumn("rows", F.lit(5))
    states = parts.select("k", "part", F.when((F.col("k") == "c") & (F.col("part") == 1), "CHANGED").otherwise("VERIFIED").alias("state"), F.lit("id").alias("release_id"))
    expected = spark.createDataFrame([("a", 2), ("d", 2)], "k string, parts long")
    got = {r["k"]: (r["parts"], r["rows"], r["first"], r["last"], r["refused"], r["overlaps"], r["state"]) for r in releases.merged(parts, states, ["k", "part"], ["k"], expected).collect()}
    assert got == {"a": (2, 10, 0, 19, 0, 0, "COMPLETE"), "b": (2, 10, 0, 19, 0, 1, "OVERLAP"), "c": (1, 5, 0, 9, 1, 0, "INCOMPLETE"), "d": (1, 5, 0, 9, 0, 0, "INCOMPLETE")}
