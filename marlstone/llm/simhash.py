"""SimHash near-duplicates by anchor-point covering.

Fingerprints have 64 bits, cut into pieces, which are points of a space with a perfect code; the code's words are the
anchors, and its covering radius is R. Two fingerprints that differ in at most k t + k - 1 bits differ in at most t
bits of some of their k pieces. Each fingerprint is replicated to every anchor within R + t of each of its pieces, and
is at home at the one anchor within R. A pair of that kind meets at the home anchor of either, so comparing the homes
of an anchor with all that stands there misses nothing.

Three pieces have the Hamming code on 15 bits (R = 1), or from six bits on, the Golay code on 23 (R = 3); two pieces of
32 bits have the Hamming code on 31. A piece's other bits are part of the anchor. Two pieces have 2**27 anchors each
instead of 2**18 or less, but more replicas; which of the two is less work is worked out from the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain, combinations, repeat
from operator import xor

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded, components, dropped, local_components, partitions, sliced, utf8, written
from .lines import _simhashes

#: The pieces' first bits and lengths.
THREE, TWO = ((0, 22), (22, 21), (43, 21)), ((0, 32), (32, 32))
#: Bits that the codes cover between them.
MOST_BITS = 8
#: Min-hashes of each text in the search for near copies, beside its SimHash; texts with the same of any are candidates.
PRINTS = 4
#: Texts whose sets of shingles a task holds at once; classes of more are cut into tiles.
TEXTS_AT_ONCE = 1_000
#: Work of comparing two fingerprints, where that of a replica is one.
COMPARISON = 0.01
#: Homes at one anchor that a task holds at once; more are dealt out over salts, with their anchor's rows sent to each.
HOMES_AT_ONCE = 50_000
#: A word, as Java writes it.
WORD = r"[^\x20\x09-\x0D]"
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: The primes of XXH64, strings that are hashed side by side, and the longest of them in bytes.
_P1, _P2, _P3, _P4, _P5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_STRINGS, _LONGEST = 1 << 15, 256


def _mixed(h: np.ndarray, i: int) -> np.ndarray:
    """Hashes for the fingerprint number ``i``; those of number 0 are as they are."""
    if not i:
        return h
    h = h ^ np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64))
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(m)
    return h ^ (h >> np.uint64(29))


def _shingle_hashes(text: bytes, shingle: int, seed: int) -> np.ndarray:
    """Hashes of the shingles of lower-cased words, repeats included; fewer words: of the whole sequence; none: no hash."""
    words = text.lower().split()
    n = len(words)
    body = b" ".join(words)
    if n <= shingle:
        return np.array([xxhash.xxh64_intdigest(body, seed)] if n else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[: n - shingle] + 1]).tolist()
    grams = map(body.__getitem__, map(slice, starts, ends[shingle - 1 :].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64, n - shingle + 1)


def _turned(h: np.ndarray, bits: int) -> np.ndarray:
    return (h << np.uint64(bits)) | (h >> np.uint64(64 - bits))


def _xxh64(body: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of strings of ``body`` with at most _LONGEST bytes, in the order of their size; eight bytes may follow the last string."""
    low = int(start.min())
    body = body[low : int((start + size).max()) + 8]
    eight = np.lib.stride_tricks.as_strided(body, (len(body) - 7, 8), (1, 1)).copy().view(np.uint64).ravel()  # from each byte on
    at, end = start - low, start - low + size
    seed = np.full(len(at), seed, np.uint64)
    h = seed + _P5
    if k := len(at) - int(np.searchsorted(size, 32)):  # the last k have stripes of 32 bytes
        four = [seed[-k:] + _P1 + _P2, seed[-k:] + _P2, seed[-k:].copy(), seed[-k:] - _P1]
        for stripe in range(int(size[-1]) // 32):
            g = len(at) - int(np.searchsorted(size, 32 * stripe + 32))
            for i, v in enumerate(four):
                v[-g:] = _turned(v[-g:] + eight[at[-g:] + 8 * i] * _P2, 31) * _P1
            at[-g:] += 32
        mixed = _turned(four[0], 1) + _turned(four[1], 7) + _turned(four[2], 12) + _turned(four[3], 18)
        for v in four:
            mixed = (mixed ^ (_turned(v * _P2, 31) * _P1)) * _P1 + _P4
        h[-k:] = mixed
    h += size.astype(np.uint64)
    for n in (8, 8, 8, 4, 1, 1, 1):
        some = np.flatnonzero(end - at >= n)
        x = eight[at[some]]
        if n == 8:
            h[some] = _turned(h[some] ^ (_turned(x * _P2, 31) * _P1), 27) * _P1 + _P4
        elif n == 4:
            h[some] = _turned(h[some] ^ ((x & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
        else:
            h[some] = _turned(h[some] ^ ((x & np.uint64(0xFF)) * _P5), 11) * _P1
        at[some] += n
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def shingle_hashes(texts: list[bytes], shingle: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """``_shingle_hashes`` of all texts, one after the other, and how many each text has."""
    words = [text.lower().split() for text in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    raw = b" ".join([*chain.from_iterable(words), b"\0" * 8])
    body = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(body == 32)
    starts = np.append(0, ends[:-1] + 1)
    grams = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    owner = np.repeat(np.arange(len(n)), grams)
    first = (np.cumsum(n) - n)[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(grams) - grams, grams)
    start = starts[first]
    size = ends[first + np.minimum(n, shingle)[owner] - 1] - start
    out = np.empty(len(start), np.uint64)
    for i in np.flatnonzero(size > _LONGEST).tolist():
        out[i] = xxhash.xxh64_intdigest(raw[start[i] : start[i] + size[i]], seed)
    for s in range(0, len(start), _STRINGS):
        own = size[s : s + _STRINGS]
        order = np.argsort(np.minimum(own, _LONGEST + 1).astype(np.uint16), kind="stable")
        order = s + order[: int(np.count_nonzero(own <= _LONGEST))]
        if len(order):
            out[order] = _xxh64(body, start[order], size[order], seed)
    return out, grams


def text_fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    h = _shingle_hashes(text, shingle, seed)
    return _votes(h.view(np.uint8).reshape(-1, 8)) if len(h) else 0


def steep_fingerprints(text: bytes, shingle: int = 5, seed: int = 42, prints: int = PRINTS) -> list[int]:
    """Min-hashes: for each print the mixed hash of the shingle that comes first in an order of its own.

    Two texts have a fingerprint in common with a chance of the Jaccard similarity of their sets of shingles.
    """
    return _least_hashes(_shingle_hashes(text, shingle, seed), prints)


def _least_hashes(h: np.ndarray, prints: int) -> list[int]:
    return [int(_mixed(_mixed(h, i).min(keepdims=True), prints + i)[0]) for i in range(1, prints + 1)] if len(h) else [0] * prints


def all_fingerprints(text: bytes, shingle: int = 5, seed: int = 42, prints: int = PRINTS) -> list[int]:
    """The SimHash of the text's shingles, then its min-hashes."""
    h = _shingle_hashes(text, shingle, seed)
    return [_votes(h.view(np.uint8).reshape(-1, 8)) if len(h) else 0, *_least_hashes(h, prints)]


def _fingerprints_of(texts: list[bytes], shingle: int, prints: int) -> np.ndarray:
    """``all_fingerprints`` of each text, a row each."""
    h, size = shingle_hashes(texts, shingle)
    out, some = np.zeros((len(texts), 1 + prints), np.uint64), np.flatnonzero(size)
    if len(some):
        size = size[some]
        first = np.cumsum(size) - size
        out[some, 0] = _simhashes(h, size)
        for i in range(1, prints + 1):
            out[some, i] = _mixed(np.minimum.reduceat(_mixed(h, i), first), prints + i)
    return out


def _votes(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have, given as rows of eight bytes."""
    m = len(h)
    if m < 64:
        ones = _BITS[h].sum(axis=0).ravel()
    else:
        ones = np.concatenate([np.bincount(h[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(2 * ones > m, bitorder="little").view(np.uint64)[0])


def _by_text(docs: DataFrame, id_col: str, text_col: str, names: list[str], of: Callable[[list[bytes]], list | np.ndarray]) -> DataFrame:
    """Rows (id_col, and a long for each of ``names``) of all documents, from what ``of`` gives for some texts, a row each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", 1 << 20):
            off, body = utf8(b.column(1))
            raw = body.tobytes()
            fps = of([raw[s:e] for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
            cols = np.array(fps, np.uint64).reshape(len(fps), len(names)).T.copy().view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols)], ["id", *names])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, f"id {dict(rows.dtypes)['id']}, " + ", ".join(f"{c} long" for c in names)).withColumnRenamed("id", id_col)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """Rows (id_col, fp long) of all documents. Null and blank texts have fingerprint zero."""
    return _by_text(docs, id_col, text_col, ["fp"], lambda texts: [text_fingerprint(text, shingle, seed) for text in texts])


def _golay() -> list[int]:
    """Remainders of x**i by a generator of the Golay code, x**11 + x**9 + x**7 + x**6 + x**5 + x + 1."""
    out, r = [], 1
    for _ in range(23):
        out.append(r)
        r <<= 1
        r ^= 0xAE3 if r >> 11 else 0
    return out


class _Anchors:
    """A code on ``bits`` bits by the syndromes of single bits (0: a bit outside the code), radius and threshold."""

    def __init__(self, singles: list[int], radius: int, threshold: int) -> None:
        self.singles = singles
        kinds = 1 << max(singles).bit_length()
        flips, syndromes, homes = [], [], []
        for weight in range(radius + threshold + 1):
            for places in combinations(range(len(singles)), weight):
                flips.append(sum(1 << i for i in places))
                syndromes.append(reduce(xor, (singles[i] for i in places), 0))
                homes.append(weight <= radius and all(singles[i] for i in places))
        order = np.argsort(syndromes, kind="stable")
        self.flips, self.homes = np.array(flips)[order], np.array(homes)[order]
        self.counts = np.bincount(syndromes, minlength=kinds)
        self.starts = np.cumsum(self.counts) - self.counts

    def replicas(self) -> float:
        """Anchors that a piece is replicated to, on average."""
        return len(self.flips) / len(self.counts)

    def near(self, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the piece, anchor and whether it's the home, for all anchors that each piece is replicated to."""
        s = np.zeros(len(piece), np.int64)
        for i, one in enumerate(self.singles):
            if one:
                s ^= ((piece >> i) & 1) * one
        n = self.counts[s]
        at = np.repeat(np.arange(len(piece)), n)
        flip = np.repeat(self.starts[s] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return at, piece[at] ^ self.flips[flip], self.homes[flip]


def _cover(most_bits: int, rows: int) -> tuple[tuple[tuple[int, int], ...], _Anchors]:
    """Pieces and code for ``rows`` fingerprints, by the number of replicas and of comparisons that each choice makes."""
    if not 0 <= most_bits <= MOST_BITS:
        raise ValueError(f"the anchors cover up to {MOST_BITS} bits")
    hamming = lambda bits, n, t: _Anchors(list(range(1, bits + 1)) + [0] * (n - bits), 1, t)
    if most_bits > 5:
        return THREE, _Anchors(_golay(), 3, 2)
    choices = [(THREE, hamming(15, 22, most_bits // 3), 1 << 18), (TWO, hamming(31, 32, most_bits // 2), 1 << 27)]
    work = lambda pieces, code, anchors: len(pieces) * code.replicas() * (1 + COMPARISON * rows / anchors)
    return min(choices, key=lambda c: work(*c))[:2]


def _replicate(pieces: tuple[tuple[int, int], ...], code: _Anchors):
    """Rows (anchor, home, and those given) of each row (fp, print and whatever follows); the anchors of prints are apart."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 4096):
                part = b.slice(start, 4096)
                fps, prints = part.column(0).to_numpy().view(np.uint64), part.column(1).to_numpy().astype(np.int64)
                for p, (low, bits) in enumerate(pieces):
                    at, anchor, home = code.near((fps >> np.uint64(low)).astype(np.int64) & ((1 << bits) - 1))
                    anchor |= (prints[at] * len(pieces) + p) << 33
                    rest = [part.column(i).to_numpy()[at] for i in (0, *range(2, part.num_columns))]
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(home), *map(pa.array, rest)], ["anchor", "home", "fp", *part.schema.names[2:]])

    return work


def _compare(most_bits: int, columns: int, labelled: bool):
    """Links at each anchor: spanning stars of a run of anchors or, with labels, all pairs whose labels differ.

    The rows have the fingerprint, then what stands for it in a link, if that's something else, then a label.
    """
    most_pairs = 1 << 20
    name = int(columns - labelled > 1)

    def links(h: np.ndarray, p: np.ndarray) -> np.ndarray:
        near = np.bitwise_count((h[0] ^ p[0]).view(np.uint64)) <= most_bits
        near &= h[-1] != p[-1]
        return np.stack([h[name][near], p[name][near]])

    def batch(found: list) -> pa.RecordBatch:
        a, b = np.concatenate(found, axis=1)
        if not labelled:
            a, b = local_components(a, b)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, homes, found, held = None, None, [], 0
        for rb in batches:  # sorted by group, homes first
            group = rb.column(0).to_numpy() * 65536 + rb.column(1).to_numpy()
            if not len(group):
                continue
            home = rb.column(2).to_numpy(zero_copy_only=False)
            rows = np.stack([rb.column(i).to_numpy() for i in range(3, 3 + columns)])
            cuts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
            ids = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
            if group[0] == key:  # the group goes on from the batch before
                own = rows[:, : cuts[1]]
                for s in range(0, homes.shape[1], 1024):
                    for t in range(0, own.shape[1], 1024):
                        h, o = homes[:, s : s + 1024], own[:, t : t + 1024]
                        found.append(links(np.repeat(h, o.shape[1], axis=1), np.tile(o, h.shape[1])))
                        held += found[-1].shape[1]
            at = np.flatnonzero(home)
            size = np.diff(cuts)[ids[at]]
            todo, start = np.cumsum(size), 0
            while start < len(at):  # as many homes as make about most_pairs pairs with their groups
                end = max(start + 1, int(np.searchsorted(todo, todo[start] - size[start] + most_pairs, "right")))
                own, n = at[start:end], size[start:end]
                offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                found.append(links(np.repeat(rows[:, own], n, axis=1), rows[:, np.repeat(cuts[ids[own]], n) + offset]))
                held += found[-1].shape[1]
                start = end
                if held > most_pairs:
                    yield batch(found)
                    found, held = [], 0
            last = slice(cuts[-2], cuts[-1])
            mine = rows[:, last][:, home[last]]
            homes = np.concatenate([homes, mine], axis=1) if key == group[-1] else mine
            key = group[-1]
        if found:
            yield batch(found)

    return work


def fingerprint_links(fps: DataFrame, most_bits: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fps`` (fp) that differ in at most ``most_bits`` bits.

    They span: linked fingerprints are in one component of the result just when they are in one component of all such
    pairs. With a column print only fingerprints of one print are compared, with a column node the links are between
    those, with a column label too they are all pairs whose labels differ.
    """
    spark, rest = fps.sparkSession, [c for c in ("node", "label") if c in fps.columns]
    n = fps.count()
    pieces, code = _cover(most_bits, n)
    longs = ", ".join(f"{c} long" for c in ("fp", *rest))
    prints = F.col("print") if "print" in fps.columns else F.lit(0).alias("print")
    rows = fps.select("fp", prints, *rest).mapInArrow(_replicate(pieces, code), f"anchor long, home boolean, {longs}")
    homes = rows.where("home").groupBy("anchor").count().where(F.col("count") > HOMES_AT_ONCE)
    hot = written(homes.select("anchor", F.ceil(F.col("count") / HOMES_AT_ONCE).cast("int").alias("salts")), "hot") if n > HOMES_AT_ONCE else None
    cols = ["anchor", "salt", "home", "fp", *rest]
    if hot is not None and not hot.isEmpty():
        rows = rows.join(hot, "anchor", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
        own = F.pmod(F.xxhash64("fp", *rest), F.col("salts")).cast("int")
        rows = rows.withColumn("salt", F.explode(F.when(F.col("home"), F.array(own)).otherwise(F.sequence(F.lit(0), F.col("salts") - 1)))).select(*cols)
        others = rows.where("home").join(hot, "anchor").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).where("to <> salt")
        rows = rows.union(others.select("anchor", F.col("to").alias("salt"), F.lit(False).alias("home"), "fp", *rest))
    else:
        rows = rows.withColumn("salt", F.lit(0)).select(*cols)
    dealt = rows.repartition(partitions(spark, int(len(pieces) * code.replicas() * n), 1_000_000), "anchor", "salt").sortWithinPartitions("anchor", "salt", F.desc("home"))
    return dealt.mapInArrow(_compare(most_bits, 1 + len(rest), "label" in rest), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """Rows (id_col, fp long, component_id) of all documents; component_id is the least id reachable over links.

    Texts are lower-cased in A-Z, words are runs without ASCII white space, shingles have ``shingle`` words. Blank and
    null texts have fingerprint zero and are linked like any other; repeated rows stay; a null id is never the
    component's id unless all its ids are null; an empty table gives an empty one; other columns are left out.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    firsts = written(fps.groupBy("fp").agg(F.min(id_col).alias("first")), "firsts")
    roots = written(components(fingerprint_links(firsts.select("fp"), most_bits)), "roots")
    linked = firsts.join(bounded(roots.withColumnRenamed("node", "fp"), roots.count()), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = written(linked.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("size")).where("size > 1").drop("size"), "least")
    classes = linked.join(bounded(least, least.count()), "root", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return fps.join(written(classes, "classes"), "fp").select(id_col, "fp", "component_id")


def _shingle_sets(shingle: int):
    none = np.array([xxhash.xxh64_intdigest(b"")], np.uint64).view(np.int64)  # of a text without words

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", 1 << 20):
            off, body = utf8(b.column(1))
            raw = body.tobytes()
            h, size = shingle_hashes([raw[s:e] for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], shingle, 0)
            sets = [np.unique(x) if len(x) else none for x in np.split(h.view(np.int64), np.cumsum(size)[:-1])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["key", "grams"])

    return work


def like_sets(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of links that span the same groups as all pairs of sets with a Jaccard similarity of ``similarity`` do.

    Each set is held against all later ones at once; a set is skipped where everything after it is linked to it already.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    flat, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
    values, at = np.unique(flat, return_inverse=True)
    mark, label = np.zeros(len(values), np.int64), np.arange(len(sets))
    a, b = [], []
    for i in range(len(sets) - 1):
        rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if not len(rest):
            continue
        own = at[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[at[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1])[rest - i - 1]
        mark[own] = 0
        near = rest[both >= similarity * (sizes[i] + sizes[rest] - both)]
        for j in near.tolist():
            if label[j] != label[i]:
                a.append(i)
                b.append(j)
                label[label == label[j]] = label[i]
    return np.array(a, np.int64), np.array(b, np.int64)


def _like_texts(similarity: float):
    """Links between the texts of each group, from their sets of shingles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, sets, found = None, [], [], []

        def close() -> None:
            if len(keys) > 1:
                a, b = like_sets(sets, similarity)
                known = np.array(keys, np.int64)
                found.append((known[a], known[b]))
            keys.clear(), sets.clear()

        def batch() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for rb in batches:  # sorted by group
            groups, own = rb.column(0).to_pylist(), rb.column(1).to_pylist()
            lists = rb.column(2)
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for i, group in enumerate(groups):
                if group != now:
                    close()
                    now = group
                keys.append(own[i])
                sets.append(flat[at[i] : at[i + 1]].copy())
            if len(found) > 10_000:
                yield batch()
        close()
        if found:
            yield batch()

    return work


def near_copies(docs: DataFrame, id_col: str, text_col: str, similarity: float = 0.8, shingle: int = 5, most_bits: int = 5, prints: int = PRINTS) -> DataFrame:
    """(id_col, component_id): documents in groups of near copies, component_id the group's least id.

    Candidates are texts whose SimHashes differ in at most ``most_bits`` bits, found by anchors, which miss none, and
    texts with any of ``prints`` min-hashes in common, which also reach pairs of lower similarity; a pair is linked if
    the Jaccard similarity of its sets of ``shingle``-word shingles reaches ``similarity``. All candidates are tried
    where their sets stand together, in tiles of bounded size, and only links that join groups leave the task. A pair
    of similarity j has a min-hash in common with a chance of 1 - (1 - j)**prints: 0.998 at 0.8 with four; edits at
    just those shingles undo them all, but hardly a bit of a long text's SimHash. Texts without words are copies of
    each other. Texts whose 64-bit keys collide, as their fingerprints show, are in no group.
    """
    names = [f"fp{i}" for i in range(1 + prints)]
    keyed = docs.select(F.col(id_col).alias("id"), F.when(F.col(text_col).rlike(WORD), F.col(text_col)).otherwise("").alias("text"))
    keyed = keyed.withColumn("key", F.xxhash64("text"))
    ids = _by_text(keyed.select(F.struct("id", "key").alias("id"), "text"), "id", "text", names, lambda texts: _fingerprints_of(texts, shingle, prints))
    ids = written(ids.select("id.id", "id.key", *names), "fingerprints")
    once = ids.groupBy("key").agg(*(F.min(c).alias(c) for c in names), F.max("fp0").alias("other"), F.min("id").alias("first"), F.count("*").alias("times"))
    texts = written(once.where("fp0 = other").drop("other"), "distinct")

    def by_print(rows: DataFrame, *more: str) -> DataFrame:
        return rows.select("key", *more, F.posexplode(F.array(*names)).alias("print", "fp"))

    # texts of one class stand together: those of one min-hash, or of one SimHash and of others that anchors link to it
    node = F.xxhash64("print", "fp").alias("node")
    heads = written(by_print(texts).groupBy("print", "fp").agg(F.count("*").alias("texts"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("told"), F.min("key").alias("least")).withColumn("node", node), "heads")
    near = written(fingerprint_links(heads.where("print = 0"), most_bits), "near")
    alone = near.isEmpty()
    classes = None if alone else components(near).withColumnsRenamed({"root": "class"})
    classed = heads if alone else heads.join(bounded(classes, classes.count()), "node", "left")
    classed = classed.withColumn("class", F.col("node") if alone else F.coalesce("class", "node"))
    several = classed.groupBy("class").agg(F.sum("texts").alias("texts"), F.sum("told").alias("told"), F.min("least").alias("least")).where("texts > 1")
    once = written(several.groupBy("texts", "told", "least").agg(F.min("class").alias("class")).select("class", "texts"), "classes-once")  # not again by another fingerprint
    own = written(classed.select("print", "fp", "class").join(bounded(once, once.count()), "class"), "own")
    member = by_print(texts).join(bounded(own, own.count()), ["print", "fp"]).select("class", "key", F.ceil(F.col("texts") / TEXTS_AT_ONCE).cast("int").alias("salts"))
    salt = F.pmod(F.xxhash64("key"), F.col("salts")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda o: F.xxhash64("class", F.least(salt, o), F.greatest(salt, o)))
    member = written(member.select("key", F.explode(F.when(F.col("salts") > 1, tiles).otherwise(F.array("class"))).alias("group")).distinct(), "members")
    n = member.count()
    sets = keyed.join(bounded(member.select("key").distinct(), n), "key", "left_semi").select("key", "text").mapInArrow(_shingle_sets(shingle), "key long, grams array<long>")
    sets = written(sets.dropDuplicates(["key"]), "sets", 4 * n)
    dealt = member.join(sets, "key").select("group", "key", "grams").repartition(partitions(keyed.sparkSession, n, 20_000), "group").sortWithinPartitions("group")
    groups = components(dealt.mapInArrow(_like_texts(similarity), "a long, b long"))
    groups = written(groups, "groups")
    n = groups.count()
    rooted = texts.join(bounded(groups.withColumnRenamed("node", "key"), n), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("times").alias("times")).where("times > 1").drop("times")
    least = written(least, "least")
    classes = written(rooted.join(bounded(least, least.count()), "root").select("key", "component_id"), "classes")
    dropped(heads, near, once, own, member, sets, groups, least)
    out = ids.join(bounded(classes, classes.count()), "key", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("component_id", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """The documents without near copies: of each group of ``near_copies`` the row with the least id stays, whole.

    Of repeated rows with that id one stays. Texts without words, null ones too, are copies of each other, so one of
    them stays. Rows without an id take no part and stay as they are. The columns are those of ``docs``.
    """
    takes_part = F.col(id_col).isNotNull()
    marked = written(near_copies(docs.where(takes_part), id_col, text_col, similarity, shingle), "marked")
    gone = written(marked.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), "gone")
    again = marked.groupBy(id_col).count().where("count > 1").select(id_col)
    kept = docs.join(bounded(gone, gone.count()), id_col, "left_anti")
    if not again.isEmpty():
        once = docs.where(takes_part).join(again, id_col, "left_semi").join(gone, id_col, "left_anti").dropDuplicates([id_col])
        kept = kept.where(~takes_part).unionByName(kept.where(takes_part).join(again, id_col, "left_anti")).unionByName(once)
    return kept.select(*docs.columns)
