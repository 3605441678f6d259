"""How far the sources of a language diverge from each other, exactly, by baseline and corrections.

The value of a pair of sources is a sum over all V terms of the language, most of which occur in neither. So each pair
starts at V times the value of a term that neither has, and an inverted index corrects that:

1. Terms that one of the two has are corrected as if the other had none. That depends on the other's baseline share
   alone, so a source's terms are first summed up by their share.
2. Terms that both have: the posting list of a term gives the correction of each two of its sources, and no others.

Terms are counted inside the tasks that read the texts and sent as partial counts. Hot sources are spread over their
terms, and what leaves a posting list is summed by pair before it is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded, dropped, sliced, utf8, written

#: Terms in lower-cased UTF-8: letters of ASCII and whatever isn't ASCII.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_GAP = re.compile(rb"[^a-z\x80-\xff]")
#: Shares are counted in parts of this.
SCALE = 1_000_000_000
#: Documents of a language that a term must be in.
LEAST_DOCUMENTS = 3
#: Ranks that are listed of a source's terms.
TOP_TERMS = 200
_PIECE = 1 << 20
#: Partial counts that a task holds at a time.
_HELD = 400_000
#: Pairs of postings that are corrected at a time.
_PAIRS = 1 << 20


def terms(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists of bounded size; a term is never cut."""
    start = 0
    while start < len(raw):
        end = start + _PIECE
        if end < len(raw):
            gap = _GAP.search(raw, end)
            end = gap.start() if gap else len(raw)
        yield _TERM.findall(raw[start:end])
        start = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (lang, source, term, n, docs) of rows (lang, source, text)."""
    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def batch() -> pa.RecordBatch:
        langs, sources, names, n, docs = [], [], [], [], []
        for (lang, source), (total, seen) in found.items():
            names += total
            n += total.values()
            docs += [seen[t] for t in total]
            langs += [lang] * len(total)
            sources += [source] * len(total)
        found.clear()
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in (langs, sources, names)), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])

    held = 0
    for b in sliced(batches, "text"):
        off, body = utf8(b.column(2))
        raw = body.tobytes().lower()  # of bytes: A-Z alone
        keys = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
        for key, s, e in zip(keys, off[:-1].tolist(), off[1:].tolist(), strict=True):
            total, seen = found.setdefault(key, (Counter(), Counter()))
            was, own = len(total), set()
            for words in terms(raw[s:e]):
                total.update(words)
                own.update(words)
            seen.update(own)
            held += len(total) - was
            if held > _HELD:
                yield batch()
                held = 0
    yield batch()


def share(n: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + kept)), exact for any count."""
    small = f"1L + ({n} + 1L) * {SCALE}L DIV ({total} + {kept})"
    large = f"1L + CAST({n} + 1L AS DECIMAL(20,0)) * CAST({SCALE} AS DECIMAL(10,0)) DIV CAST({total} + {kept} AS DECIMAL(20,0))"
    return F.expr(f"CASE WHEN {n} < 9000000000 THEN {small} ELSE {large} END")


def distance(p: str, q: str) -> Column:
    """floor((p - q)^2 / q) of two shares; at most SCALE^2."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) DIV {q}")


def _joint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting lists (lang, list of source number, share, baseline share) to corrections (lang, a, b, value), summed by pair.

    The correction of sources a and b of a list: its value, less what step 1 gave to either on its own.
    """

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // q

    for b in batches:
        column = b.column(1)
        ends = np.asarray(column.offsets)
        ids, p, p0 = (np.asarray(x)[ends[0] : ends[-1]] for x in column.values.flatten())
        langs = b.column(0).dictionary_encode()
        long = np.diff(ends)
        start = np.repeat(ends[:-1] - ends[0], long)  # of the list of each posting
        of = np.repeat(np.asarray(langs.indices).astype(np.int64), long)
        reach = np.repeat(long, long).astype(np.int64)  # pairs that each posting is the first of
        before = np.concatenate([[0], np.cumsum(reach)])
        done, keys, sums = 0, [], []
        while done < len(ids):
            end = max(done + 1, int(np.searchsorted(before, before[done] + _PAIRS, "right")) - 1)
            one = np.repeat(np.arange(done, end), reach[done:end])
            two = np.arange(before[done], before[end]) - before[one] + start[one]
            one, two = one[one != two], two[one != two]
            value = f(p[one], p[two]) - f(p[one], p0[two]) - f(p0[one], p[two]) + f(p0[one], p0[two])
            key, at = np.unique((of[one] << 42) | (ids[one] << 21) | ids[two], return_inverse=True)  # up to two million sources a language
            total = np.zeros(len(key), np.int64)
            np.add.at(total, at, value)
            keys.append(key)
            sums.append(total)
            done = end
        key, at = np.unique(np.concatenate([*keys, np.zeros(0, np.int64)]), return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, at, np.concatenate([*sums, np.zeros(0, np.int64)]))
        if len(key):
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(key >> 42)), pa.array((key >> 21) & 0x1FFFFF), pa.array(key & 0x1FFFFF), pa.array(total)], ["lang", "a", "b", "value"])


def audited(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """Divergence of every source from every other of its language, and the terms that it has more of than the language.

    Rows (lang, source, part, item, value, rank). Part ``pair``: each other source of the language, by value; part
    ``term``: terms with a share over the language's, the ``top`` first. Values are exact integers; ties stand in the
    order of the item's UTF-8. Null languages, sources and texts are empty ones; a repeated row counts as often as it
    occurs; a source without terms has its pairs, a language without terms has pairs of value 0, one with a single
    source none; an empty table gives an empty one; other columns don't matter.
    """
    one = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counts = one.mapInArrow(_counted, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    counts = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    kept = counts.withColumn("docs", F.sum("docs").over(term)).withColumn("all", F.sum("n").over(term)).where(F.col("docs") >= least)
    rows = written(kept.select("lang", "term", "source", "n", "all"), "terms")

    sizes = rows.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    vocabulary = rows.groupBy("lang").agg(F.sum("n").alias("whole"), F.count_distinct("term").alias("kept"))
    groups = one.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("size", "whole", "kept")))
    groups = groups.withColumn("id", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
    base = F.when(F.col("kept") > 0, share("0L", "size", "kept"))  # null: no terms at all
    groups = written(groups.withColumn("base", base), "groups")
    n_groups = groups.count()
    small = bounded(groups, n_groups)

    posted = rows.join(small.drop("base"), ["lang", "source"]).withColumn("p", share("n", "size", "kept"))
    based = posted.withColumn("base", share("0L", "size", "kept"))
    lists = based.groupBy("lang", "term").agg(F.collect_list(F.struct("id", "p", "base")).alias("of"))  # a language's sources bound a list
    both = lists.where(F.size("of") > 1).select("lang", "of").mapInArrow(_joint, "lang string, a long, b long, value long")
    shares = based.groupBy("lang", "id", "base", "p").count()
    other = bounded(groups.select("lang", F.col("id").alias("other"), F.col("base").alias("based")), n_groups)
    single = shares.join(other, "lang").where("id <> other")
    ahead = single.select("lang", F.col("id").alias("a"), F.col("other").alias("b"), (F.col("count") * (distance("p", "based") - distance("base", "based"))).alias("value"))
    behind = single.select("lang", F.col("other").alias("a"), F.col("id").alias("b"), (F.col("count") * (distance("based", "p") - distance("based", "base"))).alias("value"))
    start = groups.join(other, "lang").where("id <> other").select("lang", F.col("id").alias("a"), F.col("other").alias("b"), F.coalesce(F.col("kept") * distance("base", "based"), F.lit(0)).alias("value"))
    sums = start.unionByName(ahead).unionByName(behind).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    named = lambda c, n: bounded(groups.select("lang", F.col("id").alias(c), F.col("source").alias(n)), n_groups)
    pairs = sums.join(named("a", "source"), ["lang", "a"]).join(named("b", "item"), ["lang", "b"])

    ordered = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ordered))
    over = posted.withColumn("q", share("`all`", "whole", "kept")).where("p > q")
    best = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance("p", "q").alias("value"))
    best = best.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= top)  # each task sends its own first ones only
    result = written(pairs.unionByName(best), "divergence")
    dropped(rows, groups)
    return result


def oracle(least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> str:
    """The same in DuckDB SQL, by the plain definition over all terms."""
    f = lambda p, q: f"(({p} - {q}) * ({p} - {q}) // {q})"
    p = lambda n, size: f"(1 + {SCALE}::HUGEINT * ({n} + 1) // ({size} + kept))"
    return f"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
o AS MATERIALIZED (SELECT i, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
v AS MATERIALIZED (SELECT lang, term, count(*) AS c FROM o GROUP BY ALL HAVING count(DISTINCT i) >= {least}),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM o SEMI JOIN v USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS kept, sum(c) AS whole FROM v GROUP BY lang),
g AS MATERIALIZED (SELECT s.lang, s.source, coalesce(n.size, 0) AS size, coalesce(l.kept, 0) AS kept, coalesce(l.whole, 0) AS whole
  FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN (SELECT lang, source, sum(c) AS size FROM c GROUP BY ALL) n USING (lang, source) LEFT JOIN l USING (lang)),
m AS MATERIALIZED (SELECT g.lang, g.source, v.term, coalesce(c.c, 0) AS n, {p('coalesce(c.c, 0)', 'g.size')} AS p, {p('v.c', 'g.whole')} AS q
  FROM g JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT a.lang, a.source, b.source AS item, sum({f('a.p', 'b.p')}) AS value FROM m a JOIN m b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, {f('p', 'q')} FROM m WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r
QUALIFY part = 'pair' OR rank <= {top}"""
