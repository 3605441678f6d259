"""Fingerprint trees, commits of several writers, and chunked draws against one generator."""

import random
import threading

import numpy as np
import pytest

from marlstone.operators import draws, trees
from marlstone.sources.commits import ConflictError, Table, put_if_absent

KINDS = "k string, id long, at long, x string"


def test_trees_name_what_differs_and_look_at_little(spark):
    rows = [(k, i, i, "v") for k in ("a", "b", None) for i in range(400)]
    other = [(k, i, at, "w" if (k, i) == ("a", 37) else x) for k, i, at, x in rows if (k, i) != (None, 399)] + [("b", 500, 8, "new"), ("b", 3, 3, "v")]
    a, b = spark.createDataFrame(rows, KINDS), spark.createDataFrame(random.Random(1).sample(other, len(other)), KINDS).repartition(5)
    shape = ["k"], "at", ["k", "id", "at", "x"], 5, 4, 4
    left, right = trees.tree(a, *shape), trees.tree(b, *shape)
    assert left.count() == 3 * (80 + 20 + 5 + 2)
    seen = trees.descended(left, right, ["k"], 4, 4)
    got = {(r["k"], r["id"]): r["state"] for r in trees.differing_rows(a, b, ["k"], "at", ["k", "id"], ["x"], seen, 5).collect()}
    assert got == {("a", 37): "CHANGED", (None, 399): "LEFT_ONLY", ("b", 500): "RIGHT_ONLY", ("b", 3): "REPEATED"}
    found = {r["k"]: (r["compared"], r["leaves"], r["state"]) for r in trees.certified(seen, ["k"]).collect()}
    assert found["a"] == (2 + 4 + 4 + 4, 1, "DIFFERENT") and found["b"][1] == 2 and found[None][2] == "DIFFERENT"
    same = trees.descended(left, trees.tree(a.repartition(7), *shape), ["k"], 4, 4)
    assert {tuple(r) for r in trees.certified(same, ["k"]).collect()} == {(k, 2, 0, "CERTIFIED") for k in ("a", "b", None)}
    nothing = trees.tree(a.limit(0), *shape)
    assert trees.descended(nothing, nothing, ["k"], 4, 4).count() == 0
    assert trees.differing_rows(a, a.limit(0), ["k"], "at", ["k", "id"], ["x"], trees.descended(left, nothing, ["k"], 4, 4), 5).where("state = 'LEFT_ONLY'").count() == len(rows)


def test_further_rows_of_an_ident_are_repeats_where_its_least_contents_agree(spark):
    """a row that is there twice, once changed, was CHANGED for the tree and REPEATED for the SQL."""
    a = spark.createDataFrame([("k", 1, 0, "b"), ("k", 2, 1, "b"), ("k", 3, 2, "b"), ("k", 4, 3, "a"), ("k", 4, 3, "b"), ("k", 5, 4, None)], KINDS)
    b = spark.createDataFrame([("k", 1, 0, "b"), ("k", 1, 0, "c"), ("k", 2, 1, "a"), ("k", 2, 1, "b"), ("k", 3, 2, "b"), ("k", 4, 3, "a"), ("k", 4, 3, "c"), ("k", 5, 4, None), ("k", 5, 4, None)], KINDS)
    shape = ["k"], "at", ["k", "id", "at", "x"], 5, 4, 4
    seen = trees.descended(trees.tree(a, *shape), trees.tree(b, *shape), ["k"], 4, 4)
    got = {r["id"]: r["state"] for r in trees.differing_rows(a, b, ["k"], "at", ["k", "id"], ["x"], seen, 5).collect()}
    assert got == {1: "REPEATED", 2: "CHANGED", 4: "CHANGED", 5: "REPEATED"}


ROWS = "id long, v string, at long, k string"


@pytest.fixture
def table(spark, tmp_path):
    return Table(spark, f"file://{tmp_path}/t", "k", ROWS)


def contents(t, version=None):
    return sorted(map(tuple, t.read(version).collect()))


def test_one_of_several_puts_succeeds(spark, tmp_path):
    (tmp_path / "log").mkdir()
    won = []
    threads = [threading.Thread(target=lambda i=i: put_if_absent(spark, f"file://{tmp_path}/log/1.json", str(i)) and won.append(i)) for i in range(8)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert len(won) == 1 and (tmp_path / "log" / "1.json").read_text() == str(won[0])
    assert [p.name for p in (tmp_path / "log").iterdir() if not p.name.endswith(".crc")] == ["1.json"]


def test_a_stale_replacement_is_refused_and_versions_stay(spark, table):
    df = lambda *rows: spark.createDataFrame(list(rows), ROWS)
    assert contents(table) == [] and table.append(df((1, "a", 0, "x"), (2, "b", 0, "y"))) == 1
    one, two, apart = table.begin(), table.begin(), table.begin()
    assert two.upsert(df((1, "two", 1, "x"), (3, "two", 1, "x")), ["k", "id"], "at") == 2
    with pytest.raises(ConflictError, match="version 2"):
        one.upsert(df((1, "one", 2, "x")), ["k", "id"], "at")
    assert apart.upsert(df((2, "apart", 1, "y")), ["k", "id"], "at") == 3  # began at 1, but touched another key
    assert table.append(df((9, "more", 0, "x"))) == 4
    assert table.upsert(df((1, "one", 2, "x")), ["k", "id"], "at") == 5
    assert contents(table) == [(1, "one", 2, "x"), (2, "apart", 1, "y"), (3, "two", 1, "x"), (9, "more", 0, "x")]
    assert contents(table, 1) == [(1, "a", 0, "x"), (2, "b", 0, "y")]
    assert contents(table, 3) == [(1, "two", 1, "x"), (2, "apart", 1, "y"), (3, "two", 1, "x")]
    assert contents(Table(spark, table.path, "k", ROWS)) == contents(table)


@pytest.mark.parametrize("first", [0, 1])
def test_two_writers_in_either_order_lose_nothing(spark, table, first):
    df = lambda w, n: spark.createDataFrame([(i, f"w{w}", w, "xy"[i % 2]) for i in range(w * 3, w * 3 + n)], ROWS)
    table.append(df(0, 3))
    writers = [table.begin(), table.begin()]
    batches = [df(1, 4), df(2, 4)]
    writers[first].upsert(batches[first], ["k", "id"], "at")
    with pytest.raises(ConflictError):
        writers[1 - first].upsert(batches[1 - first], ["k", "id"], "at")
    table.upsert(batches[1 - first], ["k", "id"], "at")
    got = {r[0]: r[1] for r in contents(table)}
    last = f"w{2 - first}"
    assert got == {0: "w0", 1: "w0", 2: "w0", 3: "w1", 4: "w1", 5: "w1", 6: last, 7: "w2", 8: "w2", 9: "w2"}


def test_writers_at_once(spark, table):
    table.append(spark.createDataFrame([(0, "start", 0, "x")], ROWS))
    def write(w):
        own = Table(spark, table.path, "k", ROWS)
        for i in range(3):
            own.upsert(spark.createDataFrame([(100 * w + i, f"w{w}", 1, "x")], ROWS), ["k", "id"], "at")

    threads = [threading.Thread(target=write, args=(w,)) for w in (1, 2, 3)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert {r[0] for r in contents(table)} == {0} | {100 * w + i for w in (1, 2, 3) for i in range(3)} and table.refresh() == 10


def plain_chunks(n, m, resamples, block, seed, chunk):
    """One generator, chunk after chunk, as matrices."""
    rng, rows = np.random.default_rng(seed), []
    for a in range(0, resamples, chunk):
        count = min(chunk, resamples - a)
        starts = rng.integers(0, n, size=(count, m), dtype=np.int64)
        restarts = rng.random((count, m)) < 1 / block
        restarts[:, 0] = True
        for r in range(count):
            at = []
            for i in range(m):
                at.append(int(starts[r, i]) if restarts[r, i] else (at[-1] + 1) % n)
            rows.append(at)
    return rows


@pytest.mark.parametrize(("n", "m", "resamples", "chunk"), [(31, 7, 23, 5), (1, 3, 4, 2), (40, 40, 6, 4), (3_000_000_019, 5, 40, 3), (2**31 + 11, 3, 30, 7)])
def test_chunks_stand_where_one_generator_has_them(spark, n, m, resamples, chunk):
    """Large n reject up to half of all draws, so chunks begin far from where they would, and with halves of words left over."""
    counts = [min(chunk, resamples - a) for a in range(0, resamples, chunk)]
    starts = draws.planned(spark, n, [c * m for c in counts], 11)
    got = [row.tolist() for c, s in zip(counts, starts, strict=True) for row in draws.chunk_rows(n, m, c, 4, 11, s)]
    assert got == plain_chunks(n, m, resamples, 4, 11, chunk)


def test_power_and_means_equal_one_generator(spark):
    x = np.random.default_rng(1).normal(size=45)
    got = draws.power(spark, x, 33, 0.3, 27, 10, 5, 6).orderBy("row").toPandas()["value"].to_numpy()
    centre = x - x.mean()
    want = [(s := centre[at] + 0.3).mean() / (np.std(s, ddof=1) / np.sqrt(33)) for at in plain_chunks(45, 33, 27, 10, 5, 6)]
    assert np.allclose(got, want, rtol=1e-12)
    got = draws.means(spark, x, 20, 4, 7, 6).orderBy("row").toPandas()["value"].to_numpy()
    assert np.allclose(got, [x[at].mean() for at in plain_chunks(45, 45, 20, 4, 11, 6)], rtol=1e-12)
    flat = draws.power(spark, np.ones(40), 30, 0.0, 3, 10, 0, 2).toPandas()["value"]
    assert (flat == -np.inf).all()
