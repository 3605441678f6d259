"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Words are runs of letters, lower-cased, with a space at both ends; their n-grams of one to three characters are told by
a hash of ``BITS`` bits. The value of an n-gram in a text is its number times its inverse document frequency, divided
by the root of the number of n-grams in the text (which is the length of the vector where no n-gram is repeated). So a
score is a sum over the places of a text, and no text's counts have to be held.

The weights are learned by follow-the-regularised-leader with an elastic net from a bounded sample of labelled rows,
that many for each language; a part of the sample is kept out, and one temperature is fitted on it. As each language
has the same share of the sample, the shares of all labelled rows come in last.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import sliced, utf8

#: Labelled rows that the model is fitted on, or one of each language if there are more of these.
SAMPLE_ROWS = 6_000
BITS = 20
#: Longest n-gram.
LONGEST = 3
UNKNOWN = "und"
#: Share of the sample, one of so many rows, that the temperature is fitted on.
KEPT_OUT = 5
#: Candidates of a language's sample, as a multiple of it; were an id repeated very often, fewer rows might be taken.
_AHEAD = 4
_ASCII_GAP = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
#: Longer texts are read in pieces that end between words; a single word of over twice this many bytes is cut.
_PIECE = 1 << 20


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point the lower case of a letter, and a space for all else."""
    return np.fromiter((ord(c.lower()[0]) if (c := chr(i)).isalpha() else 32 for i in range(0x110000)), np.uint32, 0x110000)


def _pieces(off: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ends of pieces (from 0 on), and the row of each; a piece is a text or a part of one."""
    ends, rows = [0], []
    for row, (s, e) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        while e - s > _PIECE:
            gap = _ASCII_GAP.search(raw, s + _PIECE, min(s + 2 * _PIECE, e))
            at = gap.start() if gap else min(s + 2 * _PIECE, e)
            while at < e and raw[at] & 0xC0 == 0x80:
                at += 1
            if at >= e:
                break
            ends.append(at)
            rows.append(row)
            s = at
        ends.append(e)
        rows.append(row)
    return np.array(ends, np.int64), np.array(rows, np.int64)


def grams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the n-grams of texts and the row of each, in order of rows; a few megabytes of text and one n at a time."""
    off, body = utf8(column)
    raw = body.tobytes()
    ends, rows = _pieces(off, raw)
    first = 0
    while first < len(rows):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + 2 * _PIECE, "right")) - 1)
        yield from _grams(raw[ends[first] : ends[last]], np.diff(ends[first : last + 1]), rows[first:last])
        first = last


def _grams(raw: bytes, sizes: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    points = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = np.frombuffer(raw, np.uint8) & 0xC0 != 0x80
    length = np.diff(np.concatenate([[0], np.cumsum(starts)])[np.concatenate([[0], np.cumsum(sizes)])])
    text = np.full(len(points) + 2 * len(sizes), 32, np.uint32)  # a space at both ends of each piece
    text[np.arange(len(points)) + 2 * np.repeat(np.arange(len(sizes)), length) + 1] = _letters()[points]
    of = np.repeat(np.arange(len(sizes)), length + 2)
    keep = np.concatenate([[True], (text[1:] != 32) | (text[:-1] != 32) | (of[1:] != of[:-1])])[: len(text)]
    text, of = text[keep], of[keep]
    letter = text != 32
    code, inner = np.zeros(len(text), np.uint32), np.ones(len(text), bool)
    for n in range(1, min(LONGEST, len(text)) + 1):
        long = len(text) - n + 1
        code = code[:long] * np.uint32(0x01000193) + text[n - 1 :]
        if n > 2:
            inner = inner[:long] & letter[n - 2 : n - 2 + long]
        whole = letter if n == 1 else inner[:long] & (of[n - 1 :] == of[:long])
        mixed = (code ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        yield (mixed >> np.uint32(32 - BITS))[whole].astype(np.int64), rows[of[:long][whole]]


@dataclass
class Model:
    """``slots`` gives each hash its row of ``weights``, 0 for none; these have the inverse document frequency in them."""

    langs: list[str]
    slots: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    shift: np.ndarray

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each language for each text, and the number of n-grams in it."""
        n = np.zeros(len(column), np.int64)
        total = np.zeros((len(column), len(self.langs)))
        for codes, rows in grams(column):
            if not len(codes):
                continue
            first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            n[rows[first]] += np.diff(np.concatenate([first, [len(rows)]]))
            at = self.slots[codes]
            for i in range(len(self.langs)):
                total[rows[first], i] += np.add.reduceat(self.weights[i][at], first)
        logits = total / np.sqrt(np.maximum(n, 1))[:, None] + self.bias
        return softmax(logits / self.temperature + self.shift), n


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def ftrl(starts: np.ndarray, at: np.ndarray, values: np.ndarray, y: np.ndarray, features: int, classes: int, alpha: float = 3.0, beta: float = 1.0, l1: float = 1e-5, l2: float = 1e-5, epochs: int = 4, batch: int = 16) -> np.ndarray:
    """Weights (features, classes) of a multinomial logistic regression on sparse rows, by follow-the-regularised-leader.

    Row i has ``values`` for the features ``at``, from starts[i] to starts[i + 1]; no row is empty. Rows are taken in
    their order, ``batch`` at a time, ``epochs`` times. A step adds the gradient less what the proximal term grows by.
    """
    z, n = np.zeros((features, classes)), np.zeros((features, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    blocks = []
    for b in range(0, len(y), batch):
        e = min(b + batch, len(y))
        s = slice(starts[b], starts[e])
        used, inside = np.unique(at[s], return_inverse=True)
        order = np.argsort(inside, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], np.diff(inside[order]) > 0]))
        row = np.repeat(np.arange(e - b), np.diff(starts[b : e + 1]))
        blocks.append((s, used, inside, order, heads, row, starts[b:e] - starts[b], np.eye(classes)[y[b:e]]))
    for _ in range(epochs):
        for s, used, inside, order, heads, row, first, truth in blocks:
            zu, nu, x = z[used], n[used], values[s][:, None]
            w = weights(zu, nu)
            wrong = (softmax(np.add.reduceat(x * w[inside], first)) - truth) / len(truth)
            g = np.add.reduceat((wrong[row] * x)[order], heads)
            z[used] = zu + g - (np.sqrt(nu + g * g) - np.sqrt(nu)) / alpha * w
            n[used] = nu + g * g
    return weights(z, n)


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature from 1/32 to 32 with the least cross entropy, by golden sections of its inverse's logarithm.

    The truth counts 1 - 1 / (rows + 2), the rest is shared by the other classes, as rows that are all told rightly
    say no more than that.
    """
    rest = 1 / (len(y) + 2) if logits.shape[1] > 1 else 0.0
    truth = np.full(logits.shape, rest / max(logits.shape[1] - 1, 1))
    truth[np.arange(len(y)), y] = 1 - rest
    loss = lambda t: float(-(truth * np.log(np.maximum(softmax(logits * math.exp(t)), 1e-300))).sum(axis=1).mean())
    low, high, part = -math.log(32), math.log(32), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - part * (high - low), low + part * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp(-(low + high) / 2)


def learned(id_col: str) -> Column:
    """Whether a row is one to learn from: crc32 of its id as text isn't 1 mod 3; false without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from the labelled rows that ``learned`` admits; None if there is none with a letter.

    At most ``rows`` texts are taken, equally many of each language (one at least), those with the least hash of the
    id; an id has one text, the least. Their n-grams are counted in Spark, the fit itself runs over this bounded
    sample on the driver. N-grams of a single text of the sample are left out.
    """
    ok = docs.where(learned(id_col) & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    shares = {r["lang"]: r["count"] for r in ok.groupBy("lang").count().collect()}  # a class of the model each
    if not shares:
        return None
    quota = max(1, rows // len(shares))
    part = F.pmod(F.xxhash64("id"), F.lit(1 << 32))  # ids beyond this are far from the least ones; what is left is bounded
    ahead = F.create_map(*(F.lit(x) for lang, n in shares.items() for x in (lang, min(1 << 32, _AHEAD * quota * (1 << 32) // n))))
    few = ok.where(part < F.element_at(ahead, F.col("lang"))).select("id", "lang").distinct()
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(part, "id")))
    chosen = ranked.where(F.col("rank") <= quota).select("id", "lang")
    sample = ok.where("text is not null").join(F.broadcast(chosen), ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text"))
    kinds = "lang string, hash long, codes array<int>, counts array<int>"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", 1 << 20):
            codes, of = (np.concatenate(x) for x in zip(*grams(b.column(2)), (np.zeros(0, np.int64),) * 2, strict=True))
            key, number = np.unique(of << BITS | codes, return_counts=True)
            ends = np.searchsorted(key >> BITS, np.arange(b.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (key & ((1 << BITS) - 1), number)]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(3), *lists], ["lang", "hash", "codes", "counts"])

    found = sample.select("id", F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("id").alias("hash")).mapInArrow(counted, kinds)
    table = found.where(F.size("codes") > 0).toArrow().sort_by([("hash", "ascending"), ("lang", "ascending")]).combine_chunks()
    if not table.num_rows:
        return None
    langs = sorted(set(table["lang"].to_pylist()))
    y = np.array([langs.index(x) for x in table["lang"].to_pylist()])
    lists = table["codes"].combine_chunks() if isinstance(table["codes"], pa.ChunkedArray) else table["codes"]
    sizes = np.diff(np.asarray(lists.offsets))
    codes = np.asarray(lists.flatten()).astype(np.int64)
    counts = np.asarray(table["counts"].combine_chunks().flatten()).astype(float)
    row = np.repeat(np.arange(len(y)), sizes)
    seen = np.bincount(codes, minlength=1 << BITS)
    known = np.flatnonzero(seen > 1) if len(y) > 1 else np.flatnonzero(seen)
    slots = np.zeros(1 << BITS, np.int32)
    slots[known] = np.arange(1, len(known) + 1)
    idf = np.concatenate([[0.0], np.log((1 + len(y)) / (1 + seen[known])) + 1])
    at = slots[codes]
    values = counts * idf[at] / np.sqrt(np.bincount(row, counts, len(y)))[row]
    own = at > 0
    ends = np.cumsum(np.bincount(row[own], minlength=len(y)) + 1)  # every row has the bias, slot 0
    place = np.arange(own.sum()) + row[own]
    all_at, all_values = np.zeros(ends[-1], np.int64), np.ones(ends[-1])
    all_at[place], all_values[place] = at[own], values[own]
    starts = np.concatenate([[0], ends])
    held = np.arange(len(y)) % KEPT_OUT == KEPT_OUT - 1
    weights = ftrl(*_rows(starts, all_at, all_values, ~held), y[~held], len(known) + 1, len(langs))
    if held.any():
        s, a, v = _rows(starts, all_at, all_values, held)
        temperature = best_temperature(np.add.reduceat(v[:, None] * weights[a], s[:-1]), y[held])
    else:
        temperature = 1.0
    n = np.bincount(y, minlength=len(langs))
    total = sum(shares[x] for x in langs)
    shift = np.log([shares[x] / total for x in langs]) - np.log(np.maximum(n, 1) / n.sum())
    bias = weights[0].copy()
    weights *= idf[:, None]
    return Model(langs, slots, np.ascontiguousarray(weights.T), bias, temperature, shift)


def _rows(starts: np.ndarray, at: np.ndarray, values: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chosen sparse rows."""
    sizes = np.diff(starts)
    inside = np.repeat(chosen, sizes)
    return np.concatenate([[0], np.cumsum(sizes[chosen])]), at[inside], values[inside]


def identified(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred and score (the probability of that language) of each document.

    A null text and one without a letter have ``und`` and score 0, as all have without a model; ties go to the least
    language; repeated rows each have a row; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*(m.langs if m else []), UNKNOWN], object)
        for b in sliced(batches, "text", 4 << 20):
            best, score = np.full(b.num_rows, len(names) - 1), np.zeros(b.num_rows)
            if m:
                p, n = m.scores(b.column(1))
                best, score = np.where(n > 0, p.argmax(axis=1), best), np.where(n > 0, p.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[best], pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    one = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return one.mapInArrow(work, f"id {dict(one.dtypes)['id']}, lang_pred string, score double").withColumnRenamed("id", id_col)
