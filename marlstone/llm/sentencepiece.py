"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

The vocabulary comes from a model file, whose path is a parameter; the driver reads it, builds the trie and broadcasts
it, so its size is that of the vocabulary. A space becomes the mark U+2581, one more stands before each text. No piece
has the mark after another character, so the best path splits at each mark that follows one: texts are cut there, and
the words of a batch that are new run through the trie and the Viterbi recursion together, as arrays.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import sliced, utf8

MARK = "▁"
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: How much less than the least piece score an unknown character scores.
UNKNOWN_PENALTY = 10.0
_RUNS = re.compile(" *[^ ]+| +")
#: Encoded words that a Python worker keeps, so that it encodes a frequent word once.
WORDS_HELD = 400_000
_NONE = np.float64(-1e300)


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """Pieces (text, log score, kind) of a model file, by id."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: CONTROL if p.is_control(i) else UNKNOWN if p.is_unknown(i) else BYTE if p.is_byte(i) else UNUSED if p.is_unused(i) else NORMAL
    return [(p.id_to_piece(i), p.get_score(i), kind(i)) for i in range(p.get_piece_size())]


def zipf_scores(pieces: list[tuple[str, float, int]]) -> list[tuple[str, float, int]]:
    """Pieces of a file that ranks them (scores 0, -1, -2 and so on) with log probabilities by Zipf's law.

    The piece of rank r has a probability in proportion to 1 / (r + 1), so all normal pieces together have 1. No text
    is looked at: the vocabulary stays as published, only the scale of its scores changes.
    """
    ranks = [-s for _, s, kind in pieces if kind == NORMAL]
    total = math.log(sum(1 / (r + 1) for r in ranks))
    return [(p, -math.log(1 - s) - total if kind == NORMAL else s, kind) for p, s, kind in pieces]


def double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base, check and value of a trie: the child of state s by byte c is t = base[s] + c where check[t] = s."""
    root: dict = {}
    for key, value in keys.items():
        node = root
        for c in key:
            node = node.setdefault(c, {})
        node[-1] = value
    size = 1 << 16
    base, check, value = [0] * size, [-1] * size, [-1] * size
    check[0], first = 0, 1
    todo = [(0, root)]
    while todo:
        state, node = todo.pop()
        value[state] = node.pop(-1, -1)
        if not node:
            continue
        codes = sorted(node)
        while check[first] >= 0:
            first += 1
        at = first  # moves on past a crowded stretch, which leaves some gaps in it
        while True:  # the first place where all children fit
            if at + 512 > size:
                base += [0] * size
                check += [-1] * size
                value += [-1] * size
                size *= 2
            b = at - codes[0]
            if check[at] < 0 and b > 0 and all(check[b + c] < 0 for c in codes):
                break
            at += 1
        if at - first > 200:
            first = at
        base[state] = b
        for c in codes:
            check[b + c] = state
            todo.append((b + c, node[c]))
    return np.array(base, np.int64), np.array(check, np.int64), np.array(value, np.int64)


@dataclass
class Vocabulary:
    """A vocabulary ready to encode and decode."""

    pieces: list[tuple[str, float, int]]
    base: np.ndarray = field(init=False, repr=False)
    check: np.ndarray = field(init=False, repr=False)
    value: np.ndarray = field(init=False, repr=False)

    def __post_init__(self) -> None:
        keys = {p.encode(): i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED) and p}
        if any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED)):
            raise ValueError("a piece has the space mark after another character")
        self.base, self.check, self.value = double_array(keys)
        self.score = np.array([s for _, s, _ in self.pieces])
        self.unknown = next(i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN)
        self.unknown_score = float(self.score[[i for i, (_, _, kind) in enumerate(self.pieces) if kind == NORMAL]].min()) - UNKNOWN_PENALTY
        self.bytes = np.full(256, -1, np.int64)
        for i, (p, _, kind) in enumerate(self.pieces):
            if kind == BYTE:
                self.bytes[int(p[3:-1], 16)] = i
        body = [bytes([int(p[3:-1], 16)]) if kind == BYTE else b"" if kind == CONTROL else b" \xe2\x81\x87 " if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in self.pieces]
        self.out = np.frombuffer(b"".join(body), np.uint8)
        self.out_at = np.cumsum([0, *map(len, body)])

        self._forget()

    def _forget(self) -> None:
        self._known: dict[str, int] = {}
        self._off, self._ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _matches(self, body: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces in the words: place, end and id. ``ends``: for each byte the end of its word."""
        places, stops, ids = [], [], []
        at = np.flatnonzero(body & 0xC0 != 0x80)
        state, here = np.zeros(len(at), np.int64), at.copy()
        while len(at):
            to = self.base[state] + body[here]
            ok = (to < len(self.check)) & (self.base[state] > 0)
            ok[ok] = self.check[to[ok]] == state[ok]
            at, here, state = at[ok], here[ok] + 1, to[ok]
            hit = self.value[state] >= 0
            places.append(at[hit])
            stops.append(here[hit])
            ids.append(self.value[state[hit]])
            on = here < ends[at]
            at, here, state = at[on], here[on], state[on]
        return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (places, stops, ids))

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of the words' best paths. Of paths of one score the one whose last piece begins first wins."""
        sizes = np.array([len(w) for w in words], np.int64)
        off = np.concatenate([[0], np.cumsum(sizes)])
        body = np.frombuffer(b"".join(words), np.uint8)
        n = len(body)
        ends, starts = np.repeat(off[1:], sizes), np.repeat(off[:-1], sizes)
        place, stop, piece = self._matches(body, ends)
        lead = np.flatnonzero(body & 0xC0 != 0x80)
        width = np.diff(np.append(lead, n))
        single = np.zeros(n + 1, bool)
        size_at = np.zeros(n + 1, np.int64)
        size_at[lead] = width
        single[place[stop - place == size_at[place]]] = True
        missing = lead[~single[lead]]
        place = np.concatenate([place, missing])
        stop = np.concatenate([stop, missing + size_at[missing]])
        score = np.concatenate([self.score[piece], np.full(len(missing), self.unknown_score)])
        piece = np.concatenate([piece, np.full(len(missing), -1)])
        depth = stop - starts[place]
        order = np.lexsort((place, stop, depth))
        place, stop, score, piece, depth = (x[order] for x in (place, stop, score, piece, depth))
        # best path to each place; a word's beginning counts as 0, whatever the word before ends with
        best = np.full(n + 2, _NONE)
        back = np.full(n + 2, -1, np.int64)
        begin = np.zeros(n + 1, bool)
        begin[off[:-1]] = True
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(depth)) + 1, [len(depth)]]) if len(depth) else np.zeros(1, np.int64)
        for s, e in zip(cuts, cuts[1:], strict=False):
            p = place[s:e]
            total = np.where(begin[p], 0.0, best[p]) + score[s:e]
            to = stop[s:e]
            first = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1])
            top = np.maximum.reduceat(total, first)
            lengths = np.diff(np.append(first, e - s))
            at = np.where(total == np.repeat(top, lengths), np.arange(e - s), e - s)
            arg = np.minimum.reduceat(at, first)
            best[to[first]], back[to[first]] = top, arg + s
        # walk back from all word ends at once
        now, path_at, path_edge = off[1:][sizes > 0], [], []
        word = np.flatnonzero(sizes > 0)
        word_at, words_ = [], word
        step = 0
        while len(now):
            edge = back[now]
            path_edge.append(edge)
            path_at.append(np.full(len(edge), step))
            word_at.append(words_)
            now = place[edge]
            on = ~begin[now]
            now, words_ = now[on], words_[on]
            step += 1
        if not path_edge:
            return np.zeros(len(words) + 1, np.int64), np.zeros(0, np.int32)
        edge, at, word = map(np.concatenate, (path_edge, path_at, word_at))
        order = np.lexsort((-at, word))
        edge, word = edge[order], word[order]
        ids = piece[edge]
        if (lost := ids < 0).any():
            if (self.bytes >= 0).all():  # unknown characters as their bytes
                many = np.where(lost, stop[edge] - place[edge], 1)
                rows = np.repeat(np.arange(len(ids)), many)
                inner = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)
                ids = np.where(lost[rows], self.bytes[body[np.minimum(place[edge][rows] + inner, n - 1)]], ids[rows])
                word = word[rows]
            else:  # a run of unknown characters is one
                keep = ~(lost & np.concatenate([[False], lost[:-1] & (word[1:] == word[:-1])]))
                ids, word = np.where(lost, self.unknown, ids)[keep], word[keep]
        return np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))]), ids.astype(np.int32)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of all texts; an empty text has none."""
        if len(self._known) > WORDS_HELD:
            self._forget()
        known, before = self._known, len(self._known)
        number: list[int] = []
        sizes = []
        for t in texts:
            words = (t.split(" ") if "  " not in t and not t.endswith(" ") and not t.startswith(" ") else [w[1:] for w in _RUNS.findall(" " + t)]) if t else []
            sizes.append(len(words))
            number += [known.setdefault(w, len(known)) for w in words]
        if len(known) > before:
            off, ids = self.encode_words([(MARK + w.replace(" ", MARK)).encode() for w in islice(known, before, None)])
            self._off = np.concatenate([self._off, off[1:] + self._off[-1]])
            self._ids = np.concatenate([self._ids, ids])
        off, ids = self._off, self._ids
        rows = np.array(number, np.int64)
        many = off[rows + 1] - off[rows]
        ends = np.concatenate([[0], np.cumsum(many)])
        flat = ids[np.repeat(off[rows] - ends[:-1], many) + np.arange(ends[-1])]
        return ends[np.cumsum([0, *sizes])], flat

    def decode_batch(self, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        """Texts of the ids; bytes that aren't UTF-8 become U+FFFD."""
        many = self.out_at[ids + 1] - self.out_at[ids]
        ends = np.concatenate([[0], np.cumsum(many)])
        raw = self.out[np.repeat(self.out_at[ids] - ends[:-1], many) + np.arange(ends[-1])].tobytes()
        at = ends[offsets].tolist()
        texts = [raw[s:e].decode("utf-8", "replace") for s, e in zip(at, at[1:], strict=False)]
        return [t[1:] if t.startswith(" ") else t for t in texts]


def encoded(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """id_col, ids (array of int) and n_ids of each text, with ``decode`` also the decoded text.

    A null or empty text has no ids. Repeated rows each have a row; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for b in sliced(batches, "text", 4 << 20):
            off, body = utf8(b.column(1))
            raw = body.tobytes()
            at, ids = v.encode_batch([raw[s:e].decode() for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
            cols = [b.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)), pa.array(np.diff(at))]
            if decode:
                cols.append(pa.array(v.decode_batch(at, ids), pa.string()))
            yield pa.RecordBatch.from_arrays(cols, ["id", "ids", "n_ids", "decoded"][: len(cols)])

    one = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return one.mapInArrow(work, f"id {dict(one.dtypes)['id']}, ids array<int>, n_ids long" + ", decoded string" * decode).withColumnRenamed("id", id_col)


def decoded(rows: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and decoded text of arrays of ids; a null array is an empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for b in batches:
            lists = [x or [] for x in b.column(1).to_pylist()]
            ids = np.array([i for x in lists for i in x], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v.decode_batch(np.cumsum([0, *map(len, lists)]), ids), pa.string())], ["id", "decoded"])

    one = rows.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return one.mapInArrow(work, f"id {dict(one.dtypes)['id']}, decoded string").withColumnRenamed("id", id_col)
