"""Repeated byte strings by the common-prefix interval tree of an enhanced suffix array.

A suffix array over every byte of a corpus doesn't fit one machine, so it's built where repeats can be:

1. Anchors. In every window of ``length`` bytes the 64-byte gram with the least hash is an anchor (the leftmost of
   equals). The choice depends on the window's bytes alone, so two equal windows have their anchors at the same place:
   every repeat of ``length`` bytes shows as an anchor that occurs twice. Rows of anchors carry hashes, no text.
2. Occurrences of an anchor whose whole surroundings (136 bytes before, 200 from its start) agree are repeats at once.
3. Anchors with several different surroundings, at the ends of repeats, have one row of each kind fetched from the
   texts. Their suffixes are sorted with their common prefixes (the enhanced suffix array); a stack scan gives the
   common-prefix intervals; in each interval the left extensions are tested: occurrences whose left contexts agree far
   enough make up a repeat group with all its members, a diverse interval is split into such groups.
4. An anchor with more kinds of surroundings than one task should hold is counted window by window instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded, dropped, partitions, sliced, utf8, written

GRAM = 64
SEGMENT = 1 << 20
#: Kinds of surroundings of one anchor that a task holds; beyond, windows are counted.
KINDS_AT_ONCE = 20_000
_P1, _P2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= _M1
    h ^= h >> np.uint64(29)
    h *= _M2
    h ^= h >> np.uint64(32)
    return h


class _Rolling:
    """Hashes of any substring of a segment from two prefix sums modulo 2**64."""

    def __init__(self, most: int):
        def powers(base: int) -> np.ndarray:
            steps = np.full(most + 1, base, np.uint64)
            steps[0] = 1
            return np.multiply.accumulate(steps)

        self.up = [powers(_P1), powers(_P2)]
        self.down = [powers(pow(p, -1, 1 << 64)) for p in (_P1, _P2)]

    def sums(self, body: np.ndarray, which: int) -> np.ndarray:
        out = np.zeros(len(body) + 1, np.uint64)
        np.cumsum((body.astype(np.uint64) + np.uint64(1)) * self.up[which][: len(body)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.down[which][start]


def _segment_anchors(roll: _Rolling, body: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, position in the segment and hash of the anchors of all windows that lie within one text."""
    n, w = len(body), length - GRAM + 1
    none = np.zeros(0, np.int64)
    sizes = np.diff(off)
    if n < length or not (sizes >= length).any():
        return none, none, none.astype(np.uint64)
    sums = roll.sums(body, 0)
    grams = _mix((sums[GRAM:] - sums[:-GRAM]) * roll.down[0][: n - GRAM + 1])
    low = np.uint64(SEGMENT - 1)
    least = (grams & ~low) | np.arange(n - GRAM + 1, dtype=np.uint64)
    span = 1
    while 2 * span <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < w:
        least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
    inside = np.zeros(n + 1, np.int8)
    long = np.flatnonzero(sizes >= length)
    inside[off[long]] += 1
    inside[off[long + 1] - length + 1] -= 1
    picked = (least[np.cumsum(inside[: len(least)]).astype(bool)] & low).astype(np.int64)
    picked = picked[np.concatenate([[True], picked[1:] != picked[:-1]])]
    return np.searchsorted(off, picked, "right") - 1, picked, grams[picked]


def _third_on(anchor: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Whether two rows before it have the same anchor and surroundings: two tell others that these repeat."""
    order = np.lexsort((np.arange(len(anchor)), full, anchor))
    a, f = anchor[order], full[order]
    out = np.zeros(len(anchor), bool)
    out[order[2:]] = (a[2:] == a[:-2]) & (f[2:] == f[:-2])
    return out


def _runs(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of intervals in each text; ``start`` rises, as the texts do."""
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (start[1:] > reach[:-1])])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(text) - 1)
    return text[new], start[new], reach[last]


def _rows(anchor: np.ndarray, full: np.ndarray, key: np.ndarray, total: np.ndarray, text: np.ndarray, pos: np.ndarray, end: np.ndarray | None) -> pa.RecordBatch:
    last = pa.nulls(len(text), pa.int32()) if end is None else pa.array(end.astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(full), pa.array(key[text]), pa.array(total[text].astype(np.int32)), pa.array(pos.astype(np.int32)), last], ["anchor", "full", "key", "len", "pos", "end"])


def _anchor_rows(length: int):
    """Anchors with the hash of their surroundings (end is null), and stretches that are seen to repeat on the spot."""
    before = length - GRAM

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, seen = _Rolling(SEGMENT + 1), set()
        for b in sliced(batches, "text", SEGMENT):
            off, body = utf8(b.column(1))
            keys = b.column(0).to_numpy()
            if len(body) <= SEGMENT:
                fresh = np.array([(k, n) not in seen and not seen.add((k, n)) for k, n in zip(keys.tolist(), np.diff(off).tolist(), strict=True)], bool)
                parts = [(body, off, np.zeros(len(keys), np.int64), fresh, keys, np.diff(off))]
            else:  # one long text, in segments that overlap
                if (k := (int(keys[0]), len(body))) in seen:
                    continue
                seen.add(k)
                parts = [(part := body[s : s + SEGMENT], np.array([0, len(part)]), np.array([s]), np.array([True]), keys, np.array([len(body)])) for s in range(0, max(1, len(body) - length + 1), SEGMENT - 4 * length)]
            for part, o, base, fresh, key, total in parts:
                text, pos, h = _segment_anchors(roll, part, o, length)
                ok = fresh[text]
                text, pos, h = text[ok], pos[ok], h[ok]
                if not len(text):
                    continue
                whole = roll.sums(part, 1)
                s, e = np.maximum(o[text], pos - before), np.minimum(o[text + 1], pos + length)
                at = pos - o[text] + base[text]
                left, right = np.minimum(at, before), np.minimum(total[text] - at, length)
                if len(o) == 2 and len(part) < total[0]:  # a segment: its own edges aren't the text's
                    ok = ((pos - s) == left) & ((e - pos) == right)
                    text, s, e, at, left, right, h = (x[ok] for x in (text, s, e, at, left, right, h))
                full = _mix(roll.of(whole, 1, s, e) + left.astype(np.uint64) * _M1 + right.astype(np.uint64) * _M2)
                more = _third_on(h, full)
                few = ~more
                yield _rows(h[few].view(np.int64), full[few].view(np.int64), key, total, text[few], at[few], None)
                if more.any():
                    t, first, last = _runs(text[more], s[more], e[more])
                    shift = base[t] - o[t]
                    yield _rows(_mix(key[t].view(np.uint64) + first.astype(np.uint64)).view(np.int64), np.zeros(len(t), np.int64), key, total, t, first + shift, last + shift)

    return work


def _contexts(length: int):
    before = length - GRAM

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in sliced(batches, "text", SEGMENT):
            off, body = utf8(b.column(3))
            raw = body.tobytes()
            out = ([], [], [], [], [], [])
            for i, (key, n, places) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if (key, n) in seen:
                    continue
                seen.add((key, n))
                s, e = int(off[i]), int(off[i + 1])
                for x in places:
                    p = s + x["pos"]
                    for o, v in zip(out, (x["anchor"], key, n, x["pos"], raw[max(s, p - before) : p], raw[p : min(e, p + length)]), strict=True):
                        o.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.binary()), pa.array(out[5], pa.binary())], ["anchor", "key", "len", "pos", "left", "right"])

    return work


def _padded(values: list[bytes], width: int) -> np.ndarray:
    """Rows of bytes, each one more than in the text; what is missing is 0."""
    out = np.zeros((len(values), width), np.uint8)
    for i, v in enumerate(values):
        out[i, : len(v)] = np.frombuffer(v, np.uint8)
        out[i, : len(v)] += 1
    return out


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each two rows."""
    differ = (x != y) | (x == 0)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), x.shape[1])


def _intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """Common-prefix intervals (first, last, depth) of a suffix array, children before parents, by one stack scan.

    lcp[i] belongs to the suffixes i and i + 1.
    """
    stack = [(0, 0)]
    for i, depth in enumerate([*lcp, 0], 1):
        first = i - 1
        while stack and stack[-1][1] > depth:
            first, deep = stack.pop()
            yield first, i - 1, deep
        if not stack or stack[-1][1] < depth:
            stack.append((first, depth))


def group_spans(left: list[bytes], right: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Repeat groups of one anchor: members, how far each extends to the left, and how far all extend to the right.

    Each group is a common-prefix interval, or one of the parts into which diverse left extensions split it; its
    members share at least ``length`` bytes with another member.
    """
    r, lt = _padded(right, length), _padded([x[::-1] for x in left], length - GRAM)
    order = np.argsort(r.view(f"S{length}").ravel(), kind="stable")
    lcp = _common(r[order[1:]], r[order[:-1]])
    rank = np.empty(len(order), np.int64)
    rank[np.argsort(lt.view(f"S{length - GRAM}").ravel(), kind="stable")] = np.arange(len(order))
    for first, last, depth in _intervals(lcp.tolist()):
        need = length - depth
        if need > length - GRAM:
            continue
        members = order[first : last + 1]
        members = members[np.argsort(rank[members])]
        lcs = _common(lt[members[1:]], lt[members[:-1]])
        if lcs.max(initial=-1) < need:  # left-diverse throughout: no repeat of this depth
            continue
        reach = np.maximum(np.concatenate([[-1], lcs]), np.concatenate([lcs, [-1]]))
        cuts = np.flatnonzero(lcs < need) + 1
        for part in np.split(np.arange(len(members)), cuts):
            if len(part) > 1:
                yield members[part], reach[part], depth


def _edges(length: int):
    def batch(rows: list) -> pa.RecordBatch:
        g, k, n, s, e = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(k, pa.int64()), *(pa.array(x, pa.int32()) for x in (n, s, e))], ["repeat", "key", "len", "start", "end"])

    def group(cols: list[list]) -> Iterator[tuple]:
        keys, lens, pos, left, right = cols
        if len(keys) < 2:
            return
        for members, reach, depth in group_spans(left, right, length):
            i = members[0]
            name = xxhash.xxh64_intdigest(left[i][len(left[i]) - int(reach.min()) :] + right[i][:depth]) - (1 << 63)
            for m, back in zip(members.tolist(), reach.tolist(), strict=True):
                yield name, keys[m], lens[m], pos[m] - back, pos[m] + depth

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cols, rows = None, [[] for _ in range(5)], []
        for b in batches:  # sorted by anchor
            anchors = b.column(0).to_numpy()
            values = [b.column(i).to_pylist() for i in range(1, 6)]
            cuts = np.concatenate([[0], np.flatnonzero(anchors[1:] != anchors[:-1]) + 1, [len(anchors)]]).tolist() if len(anchors) else [0]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if anchors[s] != now:
                    rows.extend(group(cols))
                    now, cols = anchors[s], [[] for _ in range(5)]
                for c, v in zip(cols, values, strict=True):
                    c.extend(v[s:e])
            if len(rows) > 50_000:
                yield batch(rows)
                rows = []
        rows.extend(group(cols))
        if rows:
            yield batch(rows)

    return work


def _windows(length: int):
    """Every window of ``length`` bytes that holds the anchor, as a hash."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512).to_pydict()
                rows = [(xxhash.xxh128_digest(c[i : i + length]), k, n, p - len(lt) + i) for k, n, p, lt, rt in zip(part["key"], part["len"], part["pos"], part["left"], part["right"], strict=True) for c in [lt + rt] for i in range(min(len(lt), len(c) - length) + 1)]
                if rows:
                    h, k, n, s = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h, pa.binary()), pa.array(k, pa.int64()), pa.array(n, pa.int32()), pa.array(s, pa.int32())], ["window", "key", "len", "start"])

    return work


def repeat_groups(docs: DataFrame, text_col: str = "text", length: int = 200, kinds_at_once: int = KINDS_AT_ONCE, scratch: list[DataFrame] | None = None) -> DataFrame:
    """Repeats of at least ``length`` bytes: rows (repeat, key, len, start, end), one for each occurrence in a text.

    The tables that the result reads are added to ``scratch``.

    ``repeat`` names the group; ``key`` is xxhash64 of the text and ``len`` its bytes. Copies of a whole text count as
    one text here. Together the rows cover every byte that a repeated string of ``length`` bytes covers.
    """
    if length < GRAM + 8:
        raise ValueError(f"repeats have at least {GRAM + 8} bytes")
    spark = docs.sparkSession
    texts = docs.select(F.xxhash64(text_col).alias("key"), F.octet_length(text_col).alias("len"), F.col(text_col).alias("text")).where(F.col("len") >= length)
    anchors = texts.select("key", "text").mapInArrow(_anchor_rows(length), "anchor long, full long, key long, len int, pos int, end int")
    anchors = written(anchors, "anchors")
    before, here = length - GRAM, F.struct("key", "len", "pos")
    spans = anchors.where("end is not null").select(F.col("anchor").alias("repeat"), "key", "len", F.col("pos").alias("start"), "end").distinct()
    # each anchor's kinds of surroundings, with the first and last place that has them: one row however many places
    kinds = written(anchors.where("end is null").groupBy("anchor", "full").agg(F.min(here).alias("first"), F.max(here).alias("last")), "kinds")
    again = written(kinds.where("first <> last").select("anchor", "full"), "again")
    whole = anchors.where("end is null").join(bounded(again, again.count()), ["anchor", "full"])
    spans = spans.union(whole.select(F.xxhash64("anchor", "full").alias("repeat"), "key", "len", F.greatest(F.lit(0), F.col("pos") - before).alias("start"), F.least("len", F.col("pos") + length).alias("end")).distinct())
    several = written(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor"), "several")
    ask = kinds.join(bounded(several, several.count()), "anchor", "left_semi").select("anchor", "first.*").groupBy("key", "len").agg(F.collect_list(F.struct("anchor", "pos")).alias("places"))
    around = texts.join(ask, ["key", "len"]).select("key", "len", "places", "text").mapInArrow(_contexts(length), "anchor long, key long, len int, pos int, left binary, right binary")
    around = written(around.dropDuplicates(["anchor", "key", "len", "pos"]), "contexts")
    n = around.count()
    hot = written(around.groupBy("anchor").count().where(F.col("count") > kinds_at_once).select("anchor"), "hot") if n > kinds_at_once else None
    plain = around
    if hot is not None and not hot.isEmpty():
        plain = around.join(hot, "anchor", "left_anti")
        windows = around.join(hot, "anchor", "left_semi").select("key", "len", "pos", "left", "right").mapInArrow(_windows(length), "window binary, key long, len int, start int").distinct()
        twice = windows.groupBy("window").count().where("count > 1").select("window")
        spans = spans.union(windows.join(twice, "window").select(F.xxhash64("window"), "key", "len", "start", F.col("start") + length))
    if scratch is not None:
        scratch += [anchors, kinds, again, several, around, *([] if hot is None else [hot])]
    edges = plain.repartition(partitions(spark, n, 100_000), "anchor").sortWithinPartitions("anchor").mapInArrow(_edges(length), "repeat long, key long, len int, start int, end int")
    return spans.where(F.col("end") - F.col("start") >= length).union(edges)


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The union of half-open intervals, as maximal runs; intervals that touch make one run."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    if not len(s):
        return []
    new = np.concatenate([[True], s[1:] > e[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(s) - 1]])
    return list(zip(s[new].tolist(), e[last].tolist(), strict=True))


def _with_spans(docs: DataFrame, text_col: str, length: int) -> DataFrame:
    """Each row of ``docs`` as ``doc``, with ``spans``: null where nothing repeats, or pairs of start and end."""
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64(text_col).alias("key"), F.coalesce(F.octet_length(text_col), F.lit(0)).alias("len"))
    copies = keyed.where(F.col("len") >= length).groupBy("key", "len").count().where("count > 1").select("key", "len", F.lit(0).alias("start"), F.col("len").alias("end"))
    scratch: list[DataFrame] = []
    spans = repeat_groups(docs, text_col, length, scratch=scratch).select("key", "len", "start", "end").union(copies)
    by_text = spans.groupBy("key", "len", "start").agg(F.max("end").alias("end")).groupBy("key", "len").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    by_text = written(by_text, "spans")
    dropped(*scratch)
    return keyed.join(by_text, ["key", "len"], "left").select("doc", "spans")


def _each_text(b: pa.RecordBatch, text: int, spans: int) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    off, body = utf8(b.column(text))
    raw = body.tobytes()
    lists = b.column(spans)
    at, flat = lists.offsets.to_numpy(), lists.values
    start, end = flat.field(0).to_numpy(), flat.field(1).to_numpy()
    valid = lists.is_valid().to_numpy(zero_copy_only=False)
    for i in range(b.num_rows):
        runs = merged(start[at[i] : at[i + 1]], end[at[i] : at[i + 1]]) if valid[i] else []
        yield raw[off[i] : off[i + 1]], runs


def removal_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """What removing every repeated byte leaves: id_col, n_bytes, n_removed, n_spans, kept_sha256 for each document.

    A byte is removed if a ``length``-byte string that starts anywhere else too covers it, in the same text or another;
    overlapping occurrences count. A null text is empty. Nothing is removed from texts under ``length`` bytes; whole
    copies go altogether. Repeated rows each have a row; an empty table gives an empty one.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            out = []
            for raw, runs in _each_text(b, 1, 2):
                h, at = hashlib.sha256(), 0
                for s, e in runs:
                    h.update(raw[at:s])
                    at = e
                h.update(raw[at:])
                out.append((len(raw), sum(e - s for s, e in runs), len(runs), h.hexdigest()))
            n, r, k, d = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n, r, k)), pa.array(d, pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    marked = _with_spans(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", length).select("doc.id", "doc.text", "spans")
    return marked.mapInArrow(work, f"id {dict(marked.dtypes)['id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, text_col: str = "text", length: int = 200) -> DataFrame:
    """``docs`` with all repeated strings cut out of ``text_col``; of a character that is cut in part, nothing goes.

    Every document stays, also one of which nothing is left. A null text stays null. ``n_chars``, if there, is renewed.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, text_col):
            out = []
            for raw, runs in _each_text(b, b.schema.get_field_index(text_col), b.num_columns - 1):
                parts, at = [], 0
                for s, e in runs:
                    while s < e and raw[s] & 0xC0 == 0x80:
                        s += 1
                    while e < len(raw) and e > s and raw[e] & 0xC0 == 0x80:
                        e -= 1
                    parts.append(raw[at:s])
                    at = e
                out.append(b"".join([*parts, raw[at:]]).decode())
            text = pa.array(out, pa.string())
            nulls = b.column(b.schema.get_field_index(text_col)).is_null()
            text = pa.compute.if_else(nulls, None, text)
            yield pa.RecordBatch.from_arrays([text if n == text_col else b.column(i) for i, n in enumerate(b.schema.names[:-1])], b.schema.names[:-1])

    import pyarrow.compute  # noqa: F401

    name = max(docs.columns, key=len) + "_spans"  # no column of the documents has it
    out = _with_spans(docs, text_col, length).select("doc.*", F.col("spans").alias(name)).mapInArrow(work, docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.char_length(text_col), F.lit(0)).cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
