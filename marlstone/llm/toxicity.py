"""Toxic passages: maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

1. From a bounded sample of labelled rows: distinct texts with each token or beginning of a token, by label. Their
   log-odds under a Dirichlet prior (the pooled counts, scaled) are weights, if large over their standard deviation.
2. A text is a row of scores: for each token the largest log-odds of what marks it as toxic, else the least of what
   marks it as clean, else a negative drift.
   One scan finds all maximal scoring segments (Ruzzo and Tompa).
3. Segment scores of clean texts follow an extreme-value law with P(S > x) about K n exp(-lambda x). Each segment's
   significance is lambda S - ln(K n); a document's is the sum over its significant segments.
4. A logistic curve, fitted on the same sample, turns it into a score from 0 to 1.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import dropped, sliced, utf8, written

_TOKEN = re.compile(r"[^\W_]+")
#: Labelled rows that the model is fitted on, those with the least hash of the id; this bounds the driver's share.
SAMPLE_ROWS = 10_000
#: Beginnings of tokens, in characters, that are features besides the whole tokens.
STEMS = (3, 4, 5, 6)
_HELD = 1 << 18


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def features(token: str) -> list[str]:
    """The token, and its beginnings with a star."""
    return [token, *(token[:n] + "*" for n in STEMS if n < len(token))]


@dataclass
class Model:
    weights: dict[str, float]
    drift: float
    rate: float
    log_k: float
    slope: float
    offset: float
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def marks(self, words: list[str]) -> list[tuple[int, float]]:
        """Places and weights of the tokens that have one; weights of tokens are kept in a bounded dictionary."""
        known, out = self.known, []
        if len(known) > _HELD:
            known.clear()
        for i, w in enumerate(words):
            v = known.get(w)
            if v is None:
                own = [self.weights[f] for f in features(w) if f in self.weights]
                v = known[w] = max(own) if max(own, default=-1) > 0 else min(own, default=0.0)
            if v:
                out.append((i, v))
        return out

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        """All maximal scoring segments (first, end, score) of the words, by one scan."""
        found = self.marks(words)
        out: list[tuple[int, int, float, float]] = []  # first, end, sum before, sum after
        total, end = 0.0, 0
        for i, s in found:
            total -= self.drift * (i - end)
            before, total, first, end = total, total + s, i, i + 1
            if s <= 0:
                continue
            after = total
            while True:
                j = len(out) - 1
                while j >= 0 and out[j][2] >= before:
                    j -= 1
                if j < 0 or out[j][3] >= after:
                    out.append((first, end, before, after))
                    break
                first, before = out[j][0], out[j][2]
                del out[j:]
        return [(a, b, y - x) for a, b, x, y in out]

    def significance(self, words: list[str]) -> float:
        """Sum of the significant segments' lambda S - ln(K n), or the largest of them if none is significant."""
        if not words:
            return -math.inf
        level = self.log_k + math.log(len(words))
        values = [self.rate * s - level for _, _, s in self.segments(words)]
        over = [v for v in values if v > 0]
        return sum(over) if over else max(values, default=-level)

    def score(self, text: str) -> float:
        x = self.slope * max(self.significance(tokens(text)), -30.0) + self.offset
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of a logistic curve, by Newton steps with a weak ridge."""
    w = np.zeros(2)
    a = np.column_stack([x, np.ones_like(x)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (y - p) - 1e-3 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 0.0), float(w[1])


def _rate(scores: np.ndarray, chances: np.ndarray) -> float:
    """The positive root of sum(chance * exp(rate * score)) = 1; the mean score is negative."""
    low, high = 0.0, 1.0
    moment = lambda t: float(chances @ np.exp(np.minimum(t * scores, 600))) - 1
    while moment(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (low, mid) if moment(mid) > 0 else (mid, high)
    return max(high, 1e-3)


def fit(sample: DataFrame, least_z: float = 3.0, least_odds: float = 3.0, prior: float = 2.0) -> Model:
    """A model from ``sample`` (text, toxic 0/1), a bounded number of rows.

    Copies of a text count once, with the larger label. Features are counted once a text, in Spark; the driver gets
    those of them that mark (as the sample is bounded, so are they), and later the segments of each row of the sample. Without
    any toxic or clean row every text gets the share of toxic rows, or 0 without rows.
    """
    spark = sample.sparkSession

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())

        def batch() -> pa.RecordBatch:
            names = list(found[0] | found[1])
            rows = [pa.array([c[w] for w in names], pa.int64()) for c in found]
            found[0].clear(), found[1].clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *rows], ["token", "clean", "toxic"])

        for b in sliced(batches, "text"):
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found[y].update({f for w in set(tokens(text or "")) for f in features(w)} | {""})
                if len(found[0]) + len(found[1]) > 2 * _HELD:
                    yield batch()
        yield batch()

    sample = written(sample.groupBy("text").agg(F.max(F.col("toxic").cast("int")).alias("toxic")), "sample")
    counts = sample.mapInArrow(counted, "token string, clean long, toxic long").groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = written(counts, "counts")
    totals = counts.where("token = ''").first()
    n0, n1 = (totals["clean"], totals["toxic"]) if totals else (0, 0)
    if not n0 or not n1:
        dropped(sample, counts)
        share = min(max(n1 / max(n0 + n1, 1), 1e-9), 1 - 1e-9)
        return Model({}, 1.0, 1.0, 0.0, 0.0, math.log(share / (1 - share)))
    alpha = F.lit(prior) * (F.col("clean") + F.col("toxic")) / F.lit(n0 + n1) + 0.5
    a1, a0 = F.col("toxic") + alpha, F.col("clean") + alpha
    odds = F.log(a1 / (F.lit(n1 + prior + 1.0) - a1 + alpha)) - F.log(a0 / (F.lit(n0 + prior + 1.0) - a0 + alpha))
    marked = counts.where("token <> ''").select("token", odds.alias("odds"), (odds / F.sqrt(1 / a1 + 1 / a0)).alias("z"))
    rows = marked.where((F.abs("z") >= least_z) & (F.abs("odds") >= math.log(least_odds))).orderBy("token").collect()
    weights = {r["token"]: r["odds"] for r in rows}
    model = Model(weights, 0.05, 1.0, 0.0, 1.0, 0.0)
    shared = spark.sparkContext.broadcast(model)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in sliced(batches, "text"):
            out = []
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = tokens(text or "")
                own = Counter(v for _, v in m.marks(words))
                out.append((y, len(words), [s for _, _, s in m.segments(words)], list(own), list(own.values())))
            y, n, s, v, c = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(n, pa.int64()), pa.array(s, pa.list_(pa.float64())), pa.array(v, pa.list_(pa.float64())), pa.array(c, pa.list_(pa.int64()))], ["y", "n", "segments", "values", "counts"])

    seen = sample.mapInArrow(scanned, "y int, n long, segments array<double>, values array<double>, counts array<long>").collect()
    seen.sort(key=lambda r: (r["y"], r["n"], r["segments"]))
    clean = [r for r in seen if r["y"] == 0]
    length = max(sum(r["n"] for r in clean), 1)
    marks: Counter = Counter()
    for r in clean:
        marks.update(dict(zip(r["values"], r["counts"], strict=True)))
    scores = np.array([*marks, -model.drift])
    chances = np.array([*marks.values(), max(length - sum(marks.values()), 1)], float)
    chances /= chances.sum()
    if scores @ chances >= 0:  # the law needs a negative mean
        model.drift = 1.1 * float(np.clip(scores, 0, None) @ chances) / chances[-1]
        scores[-1] = -model.drift
    model.rate = _rate(scores, chances) if marks else 1.0
    tops = np.array([model.rate * max(r["segments"], default=0.0) - math.log(max(r["n"], 1)) for r in clean if r["n"]])
    model.log_k = float(np.log(max(np.mean(np.exp(np.minimum(tops, 0.0))), 1e-9))) if len(tops) else 0.0
    level = [(-30.0 if not r["n"] else _total(model, r)) for r in seen]
    model.slope, model.offset = _logistic(np.array(level), np.array([float(r["y"]) for r in seen]))
    shared.unpersist()
    dropped(sample, counts)
    return model


def _total(model: Model, row) -> float:
    level = model.log_k + math.log(row["n"])
    values = [model.rate * s - level for s in row["segments"]]
    over = [v for v in values if v > 0]
    return max(sum(over) if over else max(values, default=-level), -30.0)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled documents (id, text, toxic) whose crc32 of the id as text isn't divisible by 5.

    Those with the least hash of the id are taken; the list of their ids, and it alone, is broadcast. Labels other
    than 0 and 1 are left out, an id with several labels counts with the largest.
    """
    ok = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0))
    one = ok.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("toxic"))
    bounded = one.orderBy(F.xxhash64("id"), "id").limit(rows)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(bounded), "id")


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and score of each document; null and empty texts have a score too, the lowest."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in sliced(batches, "text"):
            off, body = utf8(b.column(1))
            raw = body.tobytes()
            scores = [m.score(raw[s:e].decode()) for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    one = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return one.mapInArrow(work, f"id {dict(one.dtypes)['id']}, score double").withColumnRenamed("id", id_col)


def passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every significant toxic passage: id_col, first and end word, log of 1 / its expected number, and its words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in sliced(batches, "text"):
            out = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = tokens(text or "")
                for a, e, s in m.segments(words):
                    if (v := m.rate * s - m.log_k - math.log(len(words))) > 0:
                        out.append((i, a, e, v, " ".join(words[a:e])))
            cols = zip(*out, strict=True) if out else ((),) * 5
            kinds = (b.schema.types[0], pa.int64(), pa.int64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "first", "end", "significance", "words"])

    one = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return one.mapInArrow(work, f"id {dict(one.dtypes)['id']}, first long, end long, significance double, words string").withColumnRenamed("id", id_col)


def rejected(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that the model predicts to be toxic (score of 0.5 or more), in one narrow scan."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in sliced(batches, text_col):
            off, body = utf8(b.column(b.schema.get_field_index(text_col)))
            raw = body.tobytes()
            yield b.filter(pa.array([m.score(raw[s:e].decode()) < 0.5 for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
