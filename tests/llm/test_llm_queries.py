"""The registered queries against DuckDB, and the pipeline's stages against what they promise."""

import os
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from marlstone.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SMALL}/{f}')")
    return con


def rows(frame, columns):
    return sorted(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SMALL).toPandas(), duck.execute(queries.ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs_over_the_whole_table(spark, name):
    n = queries.QUERIES[name](spark, SMALL).count()
    table = "pages" if name.startswith("op5_") else "embeddings" if name.startswith("op6_") else "documents"
    whole = spark.read.parquet(f"{SMALL}/{table}.parquet").count()
    assert n == (10 * -(-whole // 100) if table == "embeddings" else whole)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = corpus_pipeline.written(stage(spark, docs, SMALL), name)
        after = {r["doc_id"]: r for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "batches":
            assert set(after) == set(before)
            continue
        assert docs.columns == columns
        if name == "repeated_lines":
            assert set(after) == set(before)
            seen = Counter(x for r in after.values() for x in (r["text"] or "").split("\n") if any(c.isalnum() for c in x))
            assert max(seen.values()) == 1
            assert {x for r in before.values() for x in r["text"].split("\n")} >= {x for r in after.values() for x in (r["text"] or "").split("\n")} - {""}
        elif name == "repeated_passages":
            assert set(after) == set(before)
        else:
            assert all(after[i]["text"] == before[i]["text"] for i in after)


@pytest.mark.parametrize("filled", [True, False])
def test_pipeline_on_odd_tables(spark, tmp_path, filled):
    """Null, empty, repeated and very long texts, null ids, columns with names that the stages use; and no row at all."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long, key int, row int, toxic int, label int, `group` int, doc int, id int, _key int, _len int, _spans int, spans int, len int"
    long = " ".join(f"word{i % 977} and{i}" for i in range(6_000))
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (4, "a"), (None, "no id here"), (None, None), (7, long), (8, long), (9, long + " end"), (10, "Ünïcödé ½ 😀 " * 40), (11, "one line\n\none line\n")]
    rows = [(i, t, "en", "s", len(t or ""), *range(1, 13)) for i, t in texts] if filled else []
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (7, 1, 0), (10, 0, 1), (None, 1, 1)] if filled else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns
        if not filled:
            assert docs.count() == 0
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(got) == docs.count()
    assert {r["doc_id"] for r in got} <= {i for i, _ in texts}
    assert not filled or {None, 4, 7} <= {r["doc_id"] for r in got} and not {8, 9} & {r["doc_id"] for r in got}


def test_scratch_tables_go(spark, tmp_path, monkeypatch):
    """Repeats delete what they read on the way; the pipeline keeps one stage's rows at a time."""
    from marlstone.llm import _common

    monkeypatch.setattr(_common, "scratch_root", lambda spark: f"file://{tmp_path}/scratch")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    corpus_pipeline.repeats.without_repeats(docs).count()
    assert {n.rsplit("-", 1)[0] for n in os.listdir(f"{tmp_path}/scratch")} == {"spans"}
    corpus_pipeline.run(spark, SMALL).count()
    left = {n.rsplit("-", 1)[0] for n in os.listdir(f"{tmp_path}/scratch")}
    assert not left & {"anchors", "kinds", "sample", "counts", *(name for name, _ in corpus_pipeline.STAGES[:-2])}


def test_planted_near_copies_are_caught_by_the_stages(spark):
    """Line dedup empties copies of one line, the near-duplicate stage removes them and copies with other line breaks."""
    import random

    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    clean = [" ".join(word() for _ in range(rnd.randint(60, 300))) for _ in range(30)]
    near = []
    for t in clean[:15]:
        w = t.split()
        w[rnd.randrange(len(w))] = word()
        near.append(" ".join(w))
    rewrapped = [" ".join(w[: len(w) // 2]) + "\n" + " ".join(w[len(w) // 2 :]) for w in map(str.split, clean[15:25])]  # neither half is like the whole line
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean + near + rewrapped)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("repeated_lines", "near_duplicates"):
        docs = corpus_pipeline.written(dict(corpus_pipeline.STAGES)[name](spark, docs, ""), name)
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(range(30)) <= set(kept) and all(kept[i] == clean[i] for i in range(30))
    assert len([i for i in kept if i >= 30 and kept[i].strip()]) == 0 and len(kept) <= 31
