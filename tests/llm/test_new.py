"""Divergence of sources, languages and conversations against plain definitions."""

import re
from collections import Counter

import pytest

from marlstone.llm import conversations, divergence, langid

KINDS = "doc_id long, text string, lang string, source string, term int, n int, id int, `all` int"


def plain_divergence(rows, least=3, top=200):
    docs = [(x or "", y or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for t, x, y in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        within = Counter(w for d in own for w in set(d[2]))
        kept = {w for w, c in within.items() if c >= least}
        counts = {s: Counter(w for d in own if d[1] == s for w in d[2] if w in kept) for s in {d[1] for d in own}}
        whole = sum(counts.values(), Counter())
        p = lambda c, w: 1 + 1_000_000_000 * (c[w] + 1) // (c.total() + len(kept))
        f = lambda a, b: (a - b) ** 2 // b
        for s, c in counts.items():
            pairs = [(t, sum(f(p(c, w), p(d, w)) for w in kept)) for t, d in counts.items() if t != s]
            words = [(w, f(p(c, w), p(whole, w))) for w in kept if c[w] and p(c, w) > p(whole, w)]
            for part, found in (("pair", pairs), ("term", words)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(found, 1) if part == "pair" or r <= top]
    return sorted(out)


ODD = [
    (None, "en", "a"), ("", "en", "b"), ("12 34 -- !", None, None), ("The the THE cat", "en", "a"), ("the Cat sat", "en", "c"), ("the cat and the sät", "en", "c"),
    ("sät Sät SÄT", "en", "d"), ("the cat sat sät", "en", None), ("same same", "de", "x"), ("same same", "de", "x"), ("same same", "de", "y"), ("solo solo solo", "fr", "z"),
    ("naïve😀word naïve", "en", "a"), ("naïve, naïve", "en", "d"), ("naïve [naïve]", "en", "c"),
]


@pytest.mark.parametrize("long", [False, True])
def test_divergence_by_definition(spark, long, monkeypatch):
    rows = list(ODD)
    if long:
        monkeypatch.setattr(divergence, "_PIECE", 64)
        monkeypatch.setattr(divergence, "_HELD", 50)
        monkeypatch.setattr(divergence, "_PAIRS", 7)
        rows += [(" ".join(f"w{chr(97 + i * k % 23)}{chr(97 + i % 5)}" for i in range(400)), "en", f"s{k % 9}") for k in range(30)]
    docs = spark.createDataFrame([(i, t, x, s, 1, 2, 3, 4) for i, (t, x, s) in enumerate(rows)], KINDS)
    for top in (2, 200):
        got = divergence.audited(docs, top=top)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, got.collect())) == plain_divergence(rows, top=top)


def test_divergence_of_nothing(spark):
    assert divergence.audited(spark.createDataFrame([], KINDS)).count() == 0


def test_shares_of_large_counts_are_exact(spark):
    n = 5_000_000_000_000
    one = spark.range(1).selectExpr(f"{n}L AS n", f"{3 * n + 1}L AS size", "17L AS kept").select(divergence.share("n", "size", "kept").alias("p")).first()
    assert one["p"] == 1 + 1_000_000_000 * (n + 1) // (3 * n + 18)


COSTS = {"K": 0, "R": 2, "D": 3, "I": 2}


def plain_repair(rows):
    """All edit sequences by force: rows (role, text) in order; faults, cost, audit and lines."""
    space = " \t\n\x0b\x0c\r"
    faults, seen = [], set()
    for role, text in rows:
        said = text.strip(space)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None

    def go(i, roles, lines, audit, cost):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best or (cost, audit, lines), (cost, audit, lines))
        if re.fullmatch("s?(ua)*u?", roles):
            if len(roles) <= 2 * len(rows):
                for role in ("user", "assistant"):
                    go(i, roles + role[0], [*lines, role + ":"], audit + "I", cost + 2)
            if i < len(rows):
                role, text = rows[i]
                if faults[i] not in ("blank", "duplicate"):
                    cut = faults[i] == "truncated"
                    if role:
                        go(i + 1, roles + role[:1], [*lines, f"{role}:{text}"], audit + "K", cost + cut)
                    for new in ("user", "assistant"):
                        go(i + 1, roles + new[0], [*lines, f"{new}:{text}"], audit + "R", cost + 2 + cut)
                go(i + 1, roles, lines, audit + "D", cost + 3)

    best = (3 * len(rows), "D" * len(rows), [])
    go(0, "", [], "", 0)
    illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))  # noqa: B905
    return [faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, best


def odd_conversations(n, seed):
    import random

    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t", "Done. \n", "ü."]
    out = []
    for c in range(n):
        for t in range(rnd.randint(1, 6)):
            out.append((None if c == 3 else c, None if rnd.random() < 0.1 else t * rnd.choice([1, 1, 1, 2]), rnd.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), rnd.choice([*texts, f"Own {t}.", None])))
    return out


@pytest.mark.parametrize("block", [1, 2, 3, 4096])
def test_repair_by_force(spark, block):
    import hashlib

    rows = odd_conversations(60, 1)
    turns = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, pos int, block string")
    got = {r["conv_id"]: r for r in conversations.repaired(turns, turns.union(turns.limit(1).selectExpr("99L", "turn", "role", "text", "pos", "block")), block).collect()}
    assert set(got) == {r[0] for r in rows} | {99}
    assert tuple(got[99])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, " " if a is None else a, " " if b is None else b) for c, t, a, b in rows if c == conv))
        faults, illegal, (cost, audit, lines) = plain_repair([r[2:] for r in own])
        seen = [r[1] for r in own if r[0]]
        want = (conv, max(seen) - min(seen) + 1 - len(set(seen)) if seen else 0, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
        assert tuple(got[conv]) == want, own


def test_repair_of_nothing_and_of_one_long_conversation(spark):
    kinds = "conv_id long, turn long, role string, text string"
    empty = spark.createDataFrame([], kinds)
    assert conversations.repaired(empty, empty).count() == 0
    n = 3_000  # a conversation over many blocks, half of its rows equal
    rows = [(1, t if t % 2 else 0, ("user", "assistant")[t % 2] if t % 2 else "user", f"Text {t}." if t % 2 else "Same.") for t in range(n)]
    turns = spark.createDataFrame(rows, kinds)
    one, two = (conversations.repaired(turns, turns, b).collect() for b in (64, 4096))
    assert one == two and one[0]["duplicate"] == n // 2 - 1


def test_damage(spark):
    import zlib

    rows = odd_conversations(40, 2)
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            want += [(c, t, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    got = conversations.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert Counter(map(tuple, got)) == Counter(want)


def plain_grams(text):
    words = re.findall(r"[^\W\d_]+", "".join(c if c.isalpha() else " " for c in text))
    out = []
    for w in words:
        w = " " + "".join(c.lower()[0] for c in w) + " "
        out += [w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1) if w[i : i + n] != " "]
    return out


@pytest.mark.parametrize("piece", [8, 1 << 20])
def test_grams_by_definition(monkeypatch, piece):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(langid, "_PIECE", piece)
    texts = ["Ein Haus, ein HAUS", "", None, "½ 12 --", "a", "Ünïcödé 😀 ł x" * 3, "one\ttwo  three four five six seven", "日本語の 文"]
    hashes = {}
    own = [Counter() for _ in texts]
    for codes, rows in langid.grams(pa.array(texts)):
        for c, r in zip(codes.tolist(), rows.tolist(), strict=True):
            own[r][c] += 1
    for i, t in enumerate(texts):
        want = Counter(plain_grams(t or ""))
        assert own[i].total() == want.total()
        if piece > 8:  # alone, a text has the same hashes as among others
            alone = Counter(np.concatenate([c for c, _ in langid.grams(pa.array([t], pa.string()))] or [np.zeros(0, np.int64)]).tolist())
            assert alone == own[i]
        for g, n in want.items():
            (code,) = [c for c, _ in langid.grams(pa.array([g]))][len(g.strip()) - 1][:1] if " " not in g and len(g) == 1 else (None,)
            if code is not None:
                assert hashes.setdefault(code, g) == g and own[i][int(code)] == n


def test_ftrl_by_definition():
    import math
    import random

    import numpy as np

    rnd = random.Random(3)
    rows = [sorted(rnd.sample(range(6), rnd.randint(1, 4))) for _ in range(23)]
    values = [[rnd.uniform(-1, 2) for _ in r] for r in rows]
    y = [rnd.randrange(3) for _ in rows]
    alpha, beta, l1, l2, epochs, batch = 0.3, 1.0, 0.15, 0.1, 3, 4
    z, n = [[0.0] * 3 for _ in range(6)], [[0.0] * 3 for _ in range(6)]
    w = lambda f, k: 0.0 if abs(z[f][k]) <= l1 else -(z[f][k] - math.copysign(l1, z[f][k])) / ((beta + math.sqrt(n[f][k])) / alpha + l2)
    for _ in range(epochs):
        for b in range(0, len(rows), batch):
            part = range(b, min(b + batch, len(rows)))
            g, held = {}, {(f, k): w(f, k) for f in range(6) for k in range(3)}
            for i in part:
                e = [math.exp(sum(x * held[f, k] for f, x in zip(rows[i], values[i], strict=True))) for k in range(3)]
                for f, x in zip(rows[i], values[i], strict=True):
                    for k in range(3):
                        g[f, k] = g.get((f, k), 0.0) + (e[k] / sum(e) - (k == y[i])) * x / len(part)
            for (f, k), v in g.items():
                z[f][k] += v - (math.sqrt(n[f][k] + v * v) - math.sqrt(n[f][k])) / alpha * held[f, k]
                n[f][k] += v * v
    starts = np.cumsum([0, *map(len, rows)])
    got = langid.ftrl(starts, np.concatenate(rows), np.concatenate(values), np.array(y), 6, 3, alpha, beta, l1, l2, epochs, batch)
    assert (langid.ftrl(starts, np.concatenate(rows), np.concatenate(values), np.array(y), 6, 3, l1=2.0) == 0).any()
    assert np.allclose(got, [[w(f, k) for k in range(3)] for f in range(6)], atol=1e-12)


def test_temperature_is_the_best():
    import numpy as np

    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 400)
    logits = 4 * rng.normal(size=(400, 3)) + 3 * np.eye(3)[y]
    t = langid.best_temperature(logits, y)
    loss = lambda t: -np.log(langid.softmax(logits / t)[np.arange(400), y]).mean()
    assert 1 < t < 10 and loss(t) <= min(loss(t * f) for f in (0.8, 0.9, 1.1, 1.25)) + 1e-4


def test_languages_are_told(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identified(docs, langid.fit(docs)).join(docs.withColumn("held", ~langid.learned("doc_id")), "doc_id").where("held").toPandas()
    right = found["lang"] == found["lang_pred"]
    assert len(found) > 250 and right.mean() > 0.98
    assert abs(found["score"].mean() - right.mean()) < 0.03 and found["score"].between(0, 1).all()


def test_languages_of_odd_rows(spark):
    kinds = "doc_id long, text string, lang string, score double, id int, hash int"
    rows = [(i, "the cat sat on the mat", "en", 0.0, 1, 2) for i in range(1, 40)] + [(i, "die katze saß auf der matte", "de", 0.0, 1, 2) for i in range(40, 80)]
    odd = [(100, None, "en", 0.0, 1, 2), (101, "", "de", 0.0, 1, 2), (102, "12 - 34 😀", "en", 0.0, 1, 2), (None, "the mat", "en", 0.0, 1, 2), (103, "the cat " * 400_000, None, 0.0, 1, 2), (103, "katze", "de", 0.0, 1, 2), (5, "the cat", "en", 0.0, 1, 2), (5, "the cat", "en", 0.0, 1, 2)]
    docs = spark.createDataFrame(rows + odd, kinds)
    got = langid.identified(docs, langid.fit(docs)).collect()
    assert len(got) == len(rows) + len(odd)
    assert Counter((r["doc_id"], r["lang_pred"]) for r in got) == Counter((d, "und" if d in (100, 101, 102) else "de" if "katze" in t else "en") for d, t, *_ in rows + odd)
    assert all((r["score"] == 0) == (r["lang_pred"] == "und") for r in got)
    nothing = spark.createDataFrame([], kinds)
    assert langid.fit(nothing) is None and langid.identified(nothing, None).count() == 0
    assert {r["lang_pred"] for r in langid.identified(docs, None).collect()} == {"und"}
    one = langid.fit(docs.where("lang = 'en'"), rows=1)
    assert one.langs == ["en"] and {r["lang_pred"] for r in langid.identified(docs, one).collect()} == {"en", "und"}
