"""Operators on texts against brute force, and on odd tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from marlstone.llm import html_text, licenses, lines, packing, repeats, sentencepiece, simhash, toxicity
from marlstone.llm._common import components, local_components

DOCS = "doc_id long, text string"


def words(rnd, n):
    return " ".join(rnd.choice(["the", "idé", "of", "thnter", "on", "re", "ßo", "and"]) + rnd.choice(["", "x", "yy"]) for _ in range(n))


def closure(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in linked:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (4, "a"), (None, "a b c d e f"), (None, None), (7, "word " * 30_000), (8, "Ünïcödé ½ 😀 " * 40)]


# ---- components

def test_components_of_random_graphs(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(140)] + [(300 + i, 301 + i) for i in range(60)] + [(500, x) for x in range(501, 560)]
    want = closure(600, edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    seen = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: want[x] for x in seen}
    u, v = local_components(*map(np.array, zip(*edges, strict=True)))
    assert {(int(a), int(b)) for a, b in zip(u, v, strict=True)} == {(x, want[x]) for x in seen if want[x] != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1

@pytest.fixture(scope="module")
def vocabulary():
    return sentencepiece.Vocabulary(sentencepiece.zipf_scores(sentencepiece.read_pieces("/opt/tokenizers/piece_bpe_32k.model")))


def test_scores_are_log_probabilities(vocabulary):
    normal = [s for _, s, kind in vocabulary.pieces if kind == sentencepiece.NORMAL]
    assert abs(sum(np.exp(normal)) - 1) < 1e-9 and max(normal) < 0
    ranks = [s for _, s, kind in sentencepiece.read_pieces("/opt/tokenizers/piece_bpe_32k.model") if kind == sentencepiece.NORMAL]
    assert np.argsort(normal).tolist() == np.argsort(ranks).tolist()


def viterbi(v, text):
    """Score of the best path by the plain recursion over characters."""
    s = ("▁" + text.replace(" ", "▁")) if text else ""
    score = {p: x for p, x, kind in v.pieces if kind in (sentencepiece.NORMAL, sentencepiece.USER_DEFINED)}
    best = [0.0] + [-1e300] * len(s)
    for e in range(1, len(s) + 1):
        for b in range(max(0, e - 16), e):
            if (x := score.get(s[b:e])) is not None:
                best[e] = max(best[e], best[b] + x)
        if s[e - 1] not in score:
            best[e] = max(best[e], best[e - 1] + v.unknown_score)
    return best[-1]


def test_encoding_is_a_best_path_and_round_trips(spark, vocabulary):
    rnd = random.Random(3)
    texts = ["", " ", "  ", "a", " lead", "trail ", "Hello  wörld \n ok😀 ", "日本語テキスト😀😀", "<0x0A> <s>", "a\tb", "1234 5678  ", "x" * 300]
    texts += [words(rnd, rnd.randint(1, 60)) + rnd.choice(["", "  ", "\n", "€", "😀"]) for _ in range(60)]
    at, ids = vocabulary.encode_batch(texts)
    assert vocabulary.decode_batch(at, ids) == texts
    for i, t in enumerate(texts):
        own = ids[at[i] : at[i + 1]].tolist()
        kinds = [vocabulary.pieces[k] for k in own]
        unknown = len([c for c in t.replace(" ", "▁") if (c not in {p for p, _, k in vocabulary.pieces if k == sentencepiece.NORMAL})])
        assert sum(x for _, x, k in kinds if k == sentencepiece.NORMAL) + unknown * vocabulary.unknown_score == pytest.approx(viterbi(vocabulary, t)), t
    got = sentencepiece.encoded(spark.createDataFrame([*enumerate(texts), (99, None)], DOCS).selectExpr("*", "1 AS ids"), vocabulary, decode=True).collect()
    assert {r["doc_id"]: r["decoded"] for r in got} == dict(enumerate(texts)) | {99: ""}
    back = sentencepiece.decoded(spark.createDataFrame([(r["doc_id"], r["ids"]) for r in got], "doc_id long, ids array<int>"), vocabulary)
    assert {r["doc_id"]: r["decoded"] for r in back.collect()} == dict(enumerate(texts)) | {99: ""}


def test_words_kept_are_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(sentencepiece, "WORDS_HELD", 3)
    want = vocabulary.encode_batch(["one two three four five"])[1].tolist()
    for _ in range(3):
        assert vocabulary.encode_batch(["one two three four five"])[1].tolist() == want


def test_double_array_holds_exactly_its_keys():
    rnd = random.Random(2)
    keys = {bytes(rnd.choice(b"abc\xe2\x96") for _ in range(rnd.randint(1, 6))): i for i in range(300)}
    base, check, value = sentencepiece.double_array(keys)

    def find(key):
        s = 0
        for c in key:
            t = base[s] + c
            if not base[s] or t >= len(check) or check[t] != s:
                return -1
            s = t
        return value[s]

    assert all(find(k) == v for k, v in keys.items())
    assert all(find(k + b"z") == -1 for k in keys)


# ---- 2

def licences_of(spark, texts):
    rows = spark.createDataFrame([*enumerate(texts)], DOCS).selectExpr("*", "'x' AS digest", "'y' AS license", "3 AS row")
    return {r["doc_id"]: (r["license"], r["notices"]) for r in licenses.scanned(rows, licenses.known(spark)).collect()}


def test_license_texts_survive_formatting(spark):
    mit, bsd = dict(licenses.TEXTS)["MIT"], dict(licenses.TEXTS)["BSD-3-Clause"]
    one = " ".join(mit.split())
    docs = {
        "MIT License\nCopyright (c) 2020 Someone\n\n" + mit: ("MIT", ""), "Copyright 1999 A. B.\n" + mit.upper().replace(" ", "  "): ("MIT", ""), mit.replace(",", " ;"): ("MIT", ""), mit + " extra": (None, ""),
        "Some text.\nRELEASED under the MIT Licence!\nmore\nAll rights reserved.": (None, "MIT,proprietary"), "© 2020 X\n(c) Y": (None, ""),
        "Copyright (c) 2020 A. " + one: ("MIT", "MIT"), "The MIT License (MIT) Copyright © 2020-2021 Foo Inc. All rights reserved. " + one: ("MIT", "MIT"),
        "Copyright (c) 2001 A. Smith\n" + mit: ("MIT", ""), "(c) 2020 A. B. C. Released under the MIT License.": ("MIT", "MIT"),
        "Copyright (c) 1998, Foo\nAll rights reserved.\n\n" + bsd.replace("1.", "(a)").replace("2.", "(b)").replace("3.", "(c)"): (None, "proprietary"),
        "Copyright (c) 1998, Foo <a@b.org>\nAll rights reserved.\n\n" + bsd: ("BSD-3-Clause", "proprietary"), "BSD 3-Clause Licence\n\nCopyright 2001 X\n" + bsd: ("BSD-3-Clause", ""),
        "All rights reserved.": ("proprietary", "proprietary"), "": (None, ""), " .\n": (None, ""),
    }
    assert licences_of(spark, docs) == dict(enumerate(docs.values()))


def test_license_texts_wrapped_anywhere(spark):
    import textwrap

    docs, want = [], []
    for name, text in licenses.TEXTS:
        for width in range(60, 81):
            docs.append("\n".join(textwrap.fill(part, width) for part in ["Copyright (c) 2015 A B", *text.split("\n")]))
            want.append((name, ""))
    assert licences_of(spark, docs) == dict(enumerate(want))


def test_published_license_texts(spark):
    from pathlib import Path

    folder = Path("/usr/share/common-licenses")
    found = {n: f for n, f in (("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")) if (folder / f).exists()}
    texts = [(folder / f).read_text() for f in found.values()]
    assert {r[0] for r in licences_of(spark, texts).values()} == set(found)
    assert {r[0] for r in licences_of(spark, [" ".join(t.replace("license", "licence").split()) for t in texts if "Copyright" not in t]).values()} <= set(found)


# ---- 3

def padding(lengths, bounds):
    return sum(min(b for b in bounds if b >= n) - n for n in lengths)


def test_bounds_are_optimal():
    from itertools import combinations

    rnd = random.Random(4)
    for _ in range(20):
        lens = [rnd.randint(0, 14) for _ in range(rnd.randint(1, 30))]
        c = Counter(lens)
        for k in (1, 2, 3, 4):
            got = packing.best_bounds(np.array(list(c)), np.array(list(c.values())), k)
            free = min(k, len(c)) - 1
            want = min(padding(lens, [*part, max(lens)]) for part in combinations(sorted(c)[:-1], free))
            assert len(got) == free + 1 and got[-1] == max(lens) and padding(lens, got) == want


def test_batches_fit_the_budget_and_lose_no_row(spark):
    rnd = random.Random(5)
    docs = [(i, words(rnd, rnd.choice([0, 1, 3, 10, 50, 120]))) for i in range(300)] + [(7, "dup"), (None, None)]
    got = packing.packed(spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS n", "2 AS bucket", "3 AS id"), budget=100, buckets=3).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in docs)
    batches = {}
    for r in got:
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for (bucket, _), rows in batches.items():
        assert sorted(r["place"] for r in rows) == list(range(len(rows)))
        assert len({r["bucket_tokens"] for r in rows}) == 1 if bucket >= 0 else len(rows) == 1
        assert all(r["n_tokens"] <= r["bucket_tokens"] for r in rows)
        assert bucket < 0 or len(rows) * rows[0]["bucket_tokens"] <= 100
    for b in range(3):  # only the last batch of a bucket has room left
        own = sorted((k, len(v)) for k, v in batches.items() if k[0] == b)
        assert all(n == own[0][1] for _, n in own[:-1])


# ---- 4

def fingerprint(text, shingle):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + shingle]).encode(), 42) for i in range(max(1, len(w) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("at_once", [50_000, 2])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, at_once):
    monkeypatch.setattr(simhash, "HOMES_AT_ONCE", at_once)
    rnd = random.Random(5)
    texts = [None, "", " \t", "one", "One two", "É É é"] + [words(rnd, rnd.randint(1, 250)) for _ in range(60)]
    for t in texts[6:50]:
        for _ in range(2):
            w = t.split()
            w[rnd.randrange(len(w))] = "zz"
            texts.append(" ".join(w))
    fps = [fingerprint(t, 4) for t in texts]
    want = closure(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    got = {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame([*enumerate(texts)], DOCS).selectExpr("*", "1 AS fp")).collect()}
    assert got == {i: (fps[i], want[i]) for i in range(len(texts))}


@pytest.mark.parametrize(("bits", "most", "pieces"), [*((n, 5, 3) for n in range(6)), *((n, 5, 2) for n in (1, 4, 5)), (1, 1, 2), (2, 2, 3), *((n, 8, 3) for n in (1, 5, 6, 7, 8))])
def test_anchors_miss_no_pair(spark, monkeypatch, bits, most, pieces):
    monkeypatch.setattr(simhash, "COMPARISON", 0 if pieces == 3 else 1e9)  # many rows are searched by two pieces
    assert len(simhash._cover(most, 100)[0]) == pieces
    rnd = random.Random(bits)
    pairs = []
    for _ in range(200):
        a = rnd.getrandbits(64)
        b = a
        for i in rnd.sample(range(64), bits):
            b ^= 1 << i
        pairs.append((a, b))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = spark.createDataFrame([(signed(x),) for p in pairs for x in set(p)], "fp long").distinct()
    found = {frozenset(r) for r in simhash.fingerprint_links(rows, most).collect()}
    assert found == ({frozenset(map(signed, p)) for p in pairs} if bits else set())


def test_steep_fingerprints_are_simhashes_of_halving_weights():
    rnd = random.Random(4)
    for n in (5, 6, 12, 40):
        t = words(rnd, n).encode()
        grams = {xxhash.xxh64_intdigest(b" ".join(t.lower().split()[i : i + 5]), 42) for i in range(max(1, n - 4))}
        for i, got in enumerate(simhash.steep_fingerprints(t, prints=3), 1):
            order = sorted(int(simhash._mixed(np.array([h], np.uint64), i)[0]) for h in grams)
            bits = [int(simhash._mixed(np.array([h], np.uint64), 3 + i)[0]) for h in order]
            votes = [sum((1 if h >> b & 1 else -1) * 2.0**-k for k, h in enumerate(bits)) for b in range(64)]
            assert got == sum(1 << b for b in range(64) if votes[b] > 0)
    assert simhash.steep_fingerprints(b" ") == [0] * simhash.PRINTS


@pytest.mark.parametrize("at_once", [50_000, 2])
def test_near_copies_equal_brute_force(spark, monkeypatch, at_once):
    monkeypatch.setattr(simhash, "HOMES_AT_ONCE", at_once)
    monkeypatch.setattr(simhash, "TEXTS_AT_ONCE", at_once)
    rnd = random.Random(15)
    texts = [words(rnd, rnd.randint(1, 120)) for _ in range(25)] + ["one", "One", "two"]
    for t in list(texts):
        for edits in (0, 1, 2, 4, 6):
            w = t.split()
            for _ in range(edits):
                w[rnd.randrange(len(w))] = rnd.choice(["zz", "the", "qq"])
            texts.append("  ".join(w))
    fps = [simhash.steep_fingerprints(t.encode()) for t in texts]
    near = lambda i, j: any((x ^ y).bit_count() <= 2 for x, y in zip(fps[i], fps[j], strict=True))

    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [grams(t) for t in texts]
    alike = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    want = closure(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if near(i, j) and alike(i, j)])
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame([*enumerate(texts)], DOCS), "doc_id", "text").collect()}
    assert got == dict(enumerate(want))


def five_word_sets(texts):
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]


@pytest.mark.parametrize("at_once", [1_000, 2])
def test_near_copies_of_one_class_are_all_tried(spark, monkeypatch, at_once):
    monkeypatch.setattr(simhash, "TEXTS_AT_ONCE", at_once)
    rnd = random.Random(31)
    texts = []
    for _ in range(4):  # segments between equal words: their order changes no pair of neighbours
        order = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(8)) for _ in range(16)]
        for at in (None, 1, 5, 9, 13):
            if at is not None:
                order[at], order[at + 1] = order[at + 1], order[at]
            texts.append("x " + " x ".join(order) + " x")
    sets = five_word_sets(texts)
    want = closure(20, [(i, j) for i in range(20) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    assert len(sets[0] & sets[2]) < 0.8 * len(sets[0] | sets[2]) and want == [i // 5 * 5 for i in range(20)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame([*enumerate(texts)], DOCS), "doc_id", "text").collect()}
    assert got == dict(enumerate(want))


def test_near_copies_without_a_common_min_hash_meet_at_anchors(spark):
    rnd = random.Random(35)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    texts = []
    for _ in range(6):
        w = [word() for _ in range(3000)]
        texts.append(" ".join(w))
        h = simhash._shingle_hashes(texts[-1].encode(), 5, 42)
        for i in range(1, simhash.PRINTS + 1):  # an edit in just the shingle that makes the print
            w[int(simhash._mixed(h, i).argmin()) + 2] = word()
        texts.append(" ".join(w))
    for i in range(0, 12, 2):
        a, b = (simhash.all_fingerprints(t.encode()) for t in texts[i : i + 2])
        assert a[1:] == simhash.steep_fingerprints(texts[i].encode()) and a[0] == simhash.text_fingerprint(texts[i].encode(), 5)
        assert not set(a[1:]) & set(b[1:]) and 0 < (a[0] ^ b[0]).bit_count() <= 5
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame([*enumerate(texts)], DOCS), "doc_id", "text").collect()}
    assert got == {i: i // 2 * 2 for i in range(12)}
    assert sorted(r["doc_id"] for r in simhash.keep_one(spark.createDataFrame([*enumerate(texts)], DOCS)).collect()) == list(range(0, 12, 2))


def test_near_copies_with_blocks_appended_or_cut(spark):
    rnd = random.Random(32)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    texts, copies = [], []
    for i in range(120):
        w = [word() for _ in range(rnd.choice([200, 500, 1000]))]
        texts.append(" ".join(w))
        extra = len(w) * 18 // 100
        copies.append(" ".join(w + [word() for _ in range(extra)] if i % 2 else w[:-extra]))
    sets = five_word_sets(texts + copies)
    assert all(len(sets[i] & sets[120 + i]) >= 0.8 * len(sets[i] | sets[120 + i]) for i in range(120))
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame([*enumerate(texts + copies)], DOCS)).collect()}
    assert kept >= set(range(120)) and len(kept) <= 120 + 6


def test_keep_one_keeps_a_whole_document_of_each_group(spark):
    rnd = random.Random(6)
    a, b = words(rnd, 400), words(rnd, 400)
    docs = [(3, a, 1), (1, a, 2), (2, b, 3), (2, b, 3), (5, "", 4), (6, "", 5), (7, None, 6), (None, a, 7)]
    got = simhash.keep_one(spark.createDataFrame(docs, DOCS + ", extra int")).collect()
    assert sorted(r["extra"] for r in got) == [2, 3, 4, 7]


# ---- 5

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="with-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- <p>no</p> --><div class="cookie-notice">We use cookies on this long long site.</div><div class="ad">Buy this now, it is a very good thing to buy for all.</div>
%s<form><label>Mail</label><input></form><aside>Side text.</aside><div id="comments"><p>Nice post, I really liked it a lot!</p></div><footer>&copy; x</footer></body></html>"""
BODY = """<h1>A &amp; B&eacute;</h1><p><b>Lead  line
goes here for some while, long enough to be read as the text of this page.<br><p>Short.</p><div class="promo">Promo.</div><p>Last one&nbsp;with <a href="x">a link</a>, and more words to be found.</p>"""


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main><div>%s</div></main>", "<div id='content'>%s</div>", "<div>%s</div>"])
def test_main_text_of_pages(wrap):
    want = "A & Bé\nLead line goes here for some while, long enough to be read as the text of this page.\nShort.\nLast one with a link, and more words to be found."
    assert html_text.main_text(PAGE % (wrap % BODY)) == want


LONG = "This is a long paragraph of the article, with many words in it, and it goes on for some while so that it surges."
SHAPES = [  # page, main text
    (f"<div><p>{LONG}</p><div class='ad'>Ad</div><p>Second short paragraph.</p></div>", f"{LONG}\nSecond short paragraph."),
    (f"<article><p class='social'>{LONG}</p><div class='share-price'>Price: 3</div></article>", f"{LONG}\nPrice: 3"),
    (f"<div class='layout has-sidebar'><article><p>{LONG}</p></article></div>", LONG),
    (f"<div id='header-and-content'><p>{LONG}</p></div>", LONG),
    (f"<div class='long-form'><p>{LONG}</p></div>", LONG),
    (f"<div class='search-result'><p>{LONG}</p></div>", LONG),
    (f"<div class='post with-comments'><p>{LONG}</p></div>", LONG),
    (f"<article class='post comments-open'><p>{LONG}</p></article>", LONG),
    (f"<div><h1>Title</h1></div><div><p>{LONG}</p></div><div><p>Short.</p></div>", f"Title\n{LONG}\nShort."),
    (f"<article><a href='1'>Card one</a></article><article><a href='2'>Card two</a></article><div><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div>", f"T\n{LONG}\n{LONG}"),
    (f"<div><a href='1'>Home</a></div><div><a href='2'>News</a></div><div><a href='3'>About</a></div><div><p>{LONG}</p></div>", LONG),
    (f"<article><header><h1>T</h1><p>By A</p></header><p>{LONG}</p><footer>Filed under B</footer></article>", f"T\n{LONG}"),
    (f"<main><p>{LONG}</p><ul><li><a href='1'>one</a></li><li><a href='2'>two</a></li><li><a href='3'>three</a></li></ul><p>End.</p></main>", f"{LONG}\none\ntwo\nthree\nEnd."),
    (f"<main><p>{LONG}</p></main><section class='comments-area'><article class='comment'><p>{LONG} {LONG}</p></article></section>", LONG),
    (f"<form id='page'><div role='main'><p>{LONG}</p></div></form>", LONG),
    (f"<div class='content'><p>{LONG}</p><p>{LONG}</p></div><ol class='commentlist'><li>Nice post! {LONG}</li></ol>", f"{LONG}\n{LONG}"),
    (f"<div id='sidebar-left'>{LONG}</div><div id=main>{LONG}</div><div class='cookieConsent'>{LONG}</div>", LONG),
    (f"<nav>{LONG}<div>{LONG}</div></nav><p>{LONG}<p>B<p>C", f"{LONG}\nB\nC"),
    (f"<article><p>{LONG}</p><p hidden>no</p><p style='display: none'>no</p><table><tr><td>1<td>2</tr></table></article>", f"{LONG}\n1 2"),
    (f"<article><h2>A</h2><p>{LONG}</p><div class='newsletter-signup'>Mail us</div><h2>B</h2><p>x <a href='1'>y</a> z</p></article><div>Other site text</div>", f"A\n{LONG}\nB\nx y z"),
    (f"<div class='widget'><p>{LONG}</p></div>", LONG),
    ("<p>a<br>b &lt;c&gt; <i>d</i>e</p><blockquote>f <q>g</q></blockquote>", "a b <c> de\nf g"),
]


@pytest.mark.parametrize(("page", "want"), SHAPES)
def test_main_text_of_shapes(page, want):
    around = "<html><head><title>T</title></head><body class='sidebar-right'><header>Site</header><nav><a href='/'>Home</a></nav>%s<footer>Foot</footer></body></html>"
    assert html_text.main_text(page) == want
    assert html_text.main_text(around % page) == want


def test_passages_equal_their_definition():
    """A line belongs to a passage if lines with weight stand on both sides, or it has some, with no empty window between."""
    rnd = random.Random(12)
    for _ in range(400):
        w = [rnd.choice([0, 0, rnd.randrange(200), 3]) for _ in range(rnd.randrange(25))]
        window = lambda i: sum(w[i : i + html_text.WINDOW])  # noqa: E731, B023
        best = max(map(window, range(len(w))), default=0)
        least = 80 if best >= 159 else min(80, best // 2 + 1)
        want = set()
        for a in range(len(w)):
            for b in range(a, len(w)):
                if w[a] and w[b] and all(window(i) for i in range(a, b + 1)) and any(window(i) >= least for i in range(a, b + 1)):
                    want |= set(range(a, b + 1))
        assert {i for a, b in html_text.passages(w) for i in range(a, b)} == want


def test_html_of_many_open_tags_is_quick():
    for page in ("<b>" * 200_000 + "x", "<div>" * 50_000 + "x", "<span hidden>" * 50_000 + "<p>x", "<p><i>" * 50_000 + "y", "</b></div>" * 50_000):
        html_text.main_text(page)


@pytest.mark.parametrize("html", [("<b " + "x" * 10) * 150_000, ('<b "' + "x" * 10) * 150_001, "<b '\"" * 400_001, "<script " * 250_000, '<div class="a" ' * 130_000, "<a \"b'>" * 280_000, "<!x" * 600_000, "<![CDATA[" * 220_000])
def test_html_of_unfinished_markup_is_quick(html):
    import time

    began = time.perf_counter()
    for _ in html_text._tags(html):
        pass
    assert time.perf_counter() - began < 8  # 2 MB; rescanning took hours


def test_html_tags_end_outside_quotes():
    tags = lambda h: [h[s:e] for s, e, *_ in html_text._tags(h)]
    assert tags('<a title="x > y" href=\'>\'>t</A >') == ['<a title="x > y" href=\'>\'>', "</A >"]
    assert tags('<b "open><i>x</i>') == ["<i>", "</i>"]  # a quote that never ends is text
    assert tags("<!-- <p> --><p><script>if (a<b) '</p>'</script >1 < 2<") == ["<!-- <p> -->", "<p>", "<script>if (a<b) '</p>'</script >"]
    assert tags("<!doctype html><?x?><![CDATA[<p>") == ["<!doctype html>", "<?x?>", "<![CDATA[", "<p>"]


def test_html_odd_cases(spark):
    pages = [(1, "u", None), (2, None, ""), (3, "u", "<p>unclosed <b>bold"), (4, "u", "<<>&#x41;&bogus;<p"), (5, "u", "plain text"), (5, "u", "plain text"), (6, "u", "<nav>only</nav>"), (7, "u", "<p>" + "long " * 50_000)]
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_text.extracted(spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")).collect()]
    assert [g for g in got if g[0] in (1, 2, 3, 5, 6)] == [(1, "", 0), (2, "", 0), (3, "unclosed bold", 13), (5, "plain text", 10), (5, "plain text", 10), (6, "", 0)]
    assert [n for i, _, n in got if i == 7] == [249_999]


# ---- 7

def segments_by_force(scores):
    """Maximal scoring segments by their recursive definition."""
    out = []

    def split(lo, hi):
        best = None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += scores[j]
                if total > 1e-12 and (best is None or total > best[0] + 1e-12):
                    best = (total, i, j + 1)
        if best:
            split(lo, best[1])
            out.append((best[1], best[2], best[0]))
            split(best[2], hi)

    split(0, len(scores))
    return out


def test_segments_equal_their_definition():
    rnd = random.Random(7)
    m = toxicity.Model({"bad": 2.0, "mean*": 1.3}, 0.37, 1.0, 0.0, 1.0, 0.0)
    for _ in range(200):
        w = [rnd.choice(["bad", "ok", "fine", "meanest", "meaner"]) for _ in range(rnd.randint(0, 25))]
        scores = [{"bad": 2.0, "ok": -0.37, "fine": -0.37}.get(x, 1.3) for x in w]
        got = m.segments(w)
        want = segments_by_force(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_toxic_words_are_learned(spark):
    rnd = random.Random(8)
    clean = [words(rnd, rnd.randint(20, 200)) for _ in range(150)]
    bad = []
    for _ in range(60):
        w = words(rnd, rnd.randint(20, 200)).split()
        for x in rnd.choices(["idiot", "lowlife", "lowlier"], k=4):
            w.insert(rnd.randrange(len(w)), x)
        bad.append(" ".join(w))
    rows = [(t, 0) for t in clean[:100]] + [(t, 1) for t in bad[:40]]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"))
    assert {"idiot", "lowl*"} <= set(model.weights)
    assert all(model.score(t) < 0.5 for t in clean[100:])
    assert all(model.score(t) >= 0.5 for t in bad[40:])
    assert 0 <= model.score("") < 0.5
    found = toxicity.passages(spark.createDataFrame([(1, "fine words here idiot idiot lowlife and then fine words again"), (2, "fine")], DOCS), model).collect()
    assert [(r["doc_id"], r["words"]) for r in found] == [(1, "idiot idiot lowlife")]


def test_toxicity_without_labels(spark):
    empty = toxicity.fit(spark.createDataFrame([], "text string, toxic int"))
    assert empty.score("anything") < 0.5
    one = toxicity.fit(spark.createDataFrame([("a b", 1)], "text string, toxic int"))
    assert one.score("a") > 0.5
    labels = spark.createDataFrame([(i, t) for i, t in enumerate([0, 1, None, 7, 1])] + [(None, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(5)] + [(None, "x")], DOCS).selectExpr("*", "1 AS toxic", "2 AS score")
    assert toxicity.training_rows(docs, labels).count() <= 3
    assert toxicity.scored(docs, empty).count() == 6
    assert toxicity.rejected(docs, empty).columns == docs.columns


# ---- 9

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def line_hash(ws):
    votes = [0] * 64
    for w in set(ws):
        h = int(lines.word_bits(np.array([lines.word_hash(w)], np.uint64))[0])
        for b in range(64):
            votes[b] += 1 if h >> b & 1 else -1
    return sum(1 << b for b in range(64) if votes[b] > 0)


def line_blocks(ws):
    """The blocks by their definition: word triples from 6 words on, pairs for 3 to 7 words, words for 2 and 3."""
    found = set()
    for size, fits, blocks in ((3, len(ws) >= 6, 5), (2, 3 <= len(ws) <= 7, 5), (1, 2 <= len(ws) <= 3, 4)):
        for i in range(blocks if fits else 0):
            grams = []
            for j in range(len(ws) - size + 1):
                h = 0
                for w in ws[j : j + size]:
                    h = (h * 0x9E3779B97F4A7C15 + lines.word_hash(w)) % (1 << 64)
                grams.append(int(lines.mixed(np.array([h], np.uint64), 16 * size + i)[0]))
            found.add(min(grams))
    return found


def test_shingles_are_hashed_side_by_side(monkeypatch):
    rnd = random.Random(8)
    longest = simhash._LONGEST
    texts = [words(rnd, n).encode() for n in (*range(12), 70, 900, 4000)] + [b"", b" \t\n", b"\x0b A\x1cb  \x00 c ", b"x" * (longest + 1) + b" y", ("É " * 40).encode(), b"z" * 5000]
    texts += [bytes(rnd.randrange(33, 256) for _ in range(n)) for n in range(longest - 40, longest + 3)] + [bytes(rnd.randrange(33, 256) for _ in range(n)) for n in range(1, 100)]
    for shingle, seed in ((5, 42), (4, 7), (1, 0)):
        want = [simhash._shingle_hashes(t, shingle, seed) for t in texts]
        for at_once in (50, 1 << 15):
            monkeypatch.setattr(simhash, "_STRINGS", at_once)
            h, size = simhash.shingle_hashes(texts, shingle, seed)
            assert size.tolist() == list(map(len, want)) and (h == np.concatenate(want)).all()
    want = [simhash.all_fingerprints(t) for t in texts]
    calls, one = [], xxhash.xxh64_intdigest
    monkeypatch.setattr(simhash.xxhash, "xxh64_intdigest", lambda text, seed=0: calls.append(len(text)) or one(text, seed))
    assert simhash._fingerprints_of(texts, 5, simhash.PRINTS).tolist() == want
    assert min(calls) > longest
    assert simhash._fingerprints_of([b"", b" "], 5, 2).tolist() == [[0] * 3] * 2


def test_sets_of_shingles_are_those_of_each_text():
    texts = ["", " ", "a b", "A b c d e f a b c d e f a b c d e", "w " * 3000]
    batch = pa.RecordBatch.from_pydict({"key": list(range(len(texts))), "text": texts})
    got = [r for b in simhash._shingle_sets(5)(iter([batch])) for r in b.to_pylist()]
    for t, r in zip(texts, got, strict=True):
        w = t.lower().split()
        grams = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
        assert r["grams"] == sorted(np.array([xxhash.xxh64_intdigest(g) for g in grams], np.uint64).view(np.int64).tolist())


def test_spanning_forests_are_least():
    rnd = np.random.default_rng(2)
    for n in (2, 5, 40, 300):
        a, b, w = rnd.integers(0, n, 2 * n), rnd.integers(0, n, 2 * n), rnd.integers(0, 6, 2 * n)
        root, total, links = list(range(n)), 0, 0
        for i in np.argsort(w, kind="stable"):  # the least link first, if it joins two trees
            x, y = root[a[i]], root[b[i]]
            if x != y:
                root, total, links = [x if r == y else r for r in root], total + w[i], links + 1
        some = lines.spanning_forest(a, b, w)
        assert len(some) == links and w[some].sum() == total
        assert closure(n, list(zip(a[some], b[some], strict=True))) == closure(n, list(zip(a, b, strict=True)))


def test_a_large_block_is_searched_in_windows_of_length_and_gives_one_forest(monkeypatch):
    rnd = np.random.default_rng(4)
    n, tried, near = 1200, [], lines._near

    def counted(key, size, sim, u, v, similarity):
        tried.append(len(u))
        return near(key, size, sim, u, v, similarity)

    monkeypatch.setattr(lines, "_near", counted)
    group = np.sort(np.concatenate([np.full(n, 7), np.full(n, 8), np.arange(100, 150)]))
    key = rnd.permutation(1 << 20)[: len(group)] - (1 << 19)
    size = np.where(group == 7, rnd.integers(95, 105, len(group)), rnd.integers(20, 100_000, len(group))).astype(np.int32)
    sim = np.where(group == 7, 1 << rnd.integers(0, 8, len(group)), rnd.integers(0, 1 << 20, len(group)))
    rows = pa.RecordBatch.from_arrays([*map(pa.array, (group, key, size, sim))], ["group", "key", "size", "sim"])
    links = [tuple(p.values()) for b in lines._forests(0.8)(iter([rows.slice(i, 500) for i in range(0, rows.num_rows, 500)])) for p in b.to_pylist()]
    place = {k: i for i, k in enumerate(key.tolist())}
    fits = [(i, j) for i in range(len(group)) for j in np.flatnonzero((group[i + 1 :] == group[i]) & (np.bitwise_count(sim[i + 1 :] ^ sim[i]) <= 14) & (np.minimum(size[i], size[i + 1 :]) >= 0.8 * np.maximum(size[i], size[i + 1 :]))) + i + 1]
    assert closure(len(group), [(place[a], place[b]) for a, b in links]) == closure(len(group), fits)
    assert len(links) <= 2 * n - 2 and all(a < b for a, b in links)
    assert sum(tried) < 0.65 * n * (n - 1)


def test_blocks_of_the_same_lines_give_the_same_links():
    rnd = np.random.default_rng(6)
    key = np.sort(rnd.permutation(10_000)[:300])
    found = []
    for order in (np.arange(300), rnd.permutation(300)):
        rows = pa.RecordBatch.from_arrays([*map(pa.array, (np.zeros(300, np.int64), key[order], np.full(300, 50, np.int32), np.zeros(300, np.int64)))], ["group", "key", "size", "sim"])
        found.append({tuple(p.values()) for b in lines._forests(0.8)(iter([rows])) for p in b.to_pylist()})
    assert found[0] == found[1] and len(found[0]) == 299


def test_edit_distances_side_by_side(monkeypatch):
    rnd = random.Random(3)
    x, y = [], []
    for _ in range(1500):
        a = [rnd.choice("abcd é") for _ in range(rnd.choice([0, 1, 5, 63, 64, 65, 127, 128, 129, 190, 900]))] if len(x) % 50 else []
        b = a[:]
        for _ in range(rnd.choice([0, 1, len(a) // 5, len(a) // 4])):
            i = rnd.randrange(len(b) + 1)
            b[i : i + rnd.randrange(2)] = rnd.choice(["", "b", "éd"])
        for into, t in zip((x, y), rnd.sample([a, b], 2), strict=True):
            into.append("".join(t))
    some = [i for i in range(len(x)) if len(x[i]) < 300 or i % 40 == 0]
    x, y = [x[i] for i in some], [y[i] for i in some]
    want = np.array([distance(a, b) for a, b in zip(x, y, strict=True)])
    for off in (-1, 0, 1):
        assert (lines.within(x, y, want + off) == (off >= 0)).all()
    assert len(lines.within([], [], np.zeros(0, np.int64))) == 0
    for few in (0, 20):
        monkeypatch.setattr(lines, "_FEW", few)
        for off in (-1, 0, 1):
            assert (lines.side_by_side(x, y, want + off) == (off >= 0)).all()
    assert len(lines.side_by_side([], [], np.zeros(0, np.int64))) == 0
    short = 100  # the same by the paths for long texts
    monkeypatch.setattr(lines, "_SIDE_BY_SIDE", short)
    for off in (-1, 0, 1):
        assert (lines.within(x, y, want + off) == (off >= 0)).all()


@pytest.mark.parametrize(("words_", "table"), [(1, 1 << 20), (2, 1 << 20), (3, 9_000)])
def test_windows_tell_distances_up_to_their_width(monkeypatch, words_, table):
    monkeypatch.setattr(lines, "_TABLE", table)
    rnd = random.Random(5)
    pairs = []
    for i in range(60):  # every third pair is of unlike texts, which leave before their end
        a = [rnd.choice("abcdé😀") for _ in range(rnd.randint(1, 350))]
        b = [rnd.choice("abcdxy") for _ in a] if i % 3 == 0 else a[:]
        for _ in range(rnd.randint(0, 40)):
            at = rnd.randrange(len(b) + 1)
            b[at : at + rnd.randrange(2)] = rnd.choice(["", "b", "éd"])
        pairs.append(tuple(sorted(("".join(a), "".join(b)), key=len)))
    want = np.array([distance(a, b) for a, b in pairs])
    for off in (-3, -1, 0, 1, 9):
        most = np.minimum(want + off, 64 * words_ - 1)
        some = [i for i, (a, b) in enumerate(pairs) if len(b) - len(a) <= most[i]]
        got = lines._in_window([pairs[i] for i in some], most[some], words_)
        assert (got == (want <= most)[some]).all()
        assert all((lines.edit_distance(*pairs[i], int(most[i])) <= most[i]) == (want <= most)[i] for i in range(60))


def test_only_lines_asked_for_are_normalised_again(spark):
    docs = [(i, f"{i}", "\n".join(f"Line {chr(97 + j)}{chr(97 + i)},  É" for j in range(10))) for i in range(6)] + [(9, None, "")]
    source = spark.createDataFrame(docs, "row long, id string, text string")
    places = source.mapInArrow(lines._line_rows(False), lines._ROWS.format(id="string")).select("key", "row", "line").toPandas()
    asked = places[places["row"].isin([1, 4]) & places["line"].isin([0, 7])]
    got = lines._texts(source, spark.createDataFrame(places), spark.createDataFrame(asked[["key"]]), 4).collect()
    assert {r["key"]: r["norm"] for r in got} == {k: f"line {chr(97 + j)}{chr(97 + i)} é" for k, i, j in asked.itertuples(index=False)}


def test_second_search_tries_each_pair_once_and_none_that_was_refused(monkeypatch):
    seen, alike = Counter(), lines._alike

    def counted(x, y, similarity):
        seen.update(tuple(sorted(p)) for p in zip(x, y, strict=True))
        return alike(x, y, similarity)

    monkeypatch.setattr(lines, "_alike", counted)
    norms = ["a" * 20 + str(i) * n for i, n in ((1, 0), (2, 2), (3, 9), (4, 12))]
    key = np.array([5, 3, 9, 7])
    rows = {"group": np.zeros(4, np.int64), "slot": np.zeros(4, np.int64), "key": key, "size": np.full(4, 20), "sim": np.zeros(4, np.int64), "label": key, "norm": norms}
    rows |= {"refused": pa.array([[7], [9], None, None], pa.list_(pa.int64()))} | {f"f{i}": np.zeros(4, np.int64) if i == 0 else key for i in range(10)}
    out = [tuple(sorted(p.values())) for b in lines._joined(0.8)(iter([pa.RecordBatch.from_pydict(rows)])) for p in b.to_pylist()]
    assert out == [(3, 5)]
    assert seen == {tuple(sorted((norms[i], norms[j]))): 1 for i in range(4) for j in range(i) if {key[i], key[j]} not in ({5, 7}, {3, 9})}


@pytest.mark.parametrize("at_once", [100_000, 12])
def test_line_dedup_equals_brute_force(spark, monkeypatch, at_once):
    monkeypatch.setattr(lines, "LINES_AT_ONCE", at_once)
    rnd = random.Random(9)
    pool = [words(rnd, rnd.randint(1, 60)) for _ in range(15)]
    docs = []
    for i in range(24):
        own = []
        for _ in range(rnd.randint(1, 6)):
            w = rnd.choice(pool).split()
            if rnd.random() < 0.5:
                w[rnd.randrange(len(w))] = rnd.choice(["zz", "the", "12", "99"])
            own.append(rnd.choice(["", "  "]) + " ".join(w) + rnd.choice(["", ".", " !!"]))
        docs.append((i, "\n".join([*own, rnd.choice(["", "---"])])))
    docs += [(50, None), (51, ""), (52, "\n\n")]
    place = [(i, n, lines.normalised(line)) for i, t in docs for n, line in enumerate((t or "").split("\n"))]
    place = [p for p in place if p[2]]
    distinct = {" ".join(w): (line_hash(w), line_blocks(w)) for *_, w in place}
    names = list(distinct)
    linked = [(a, b) for a in range(len(names)) for b in range(a) if (distinct[names[a]][0] ^ distinct[names[b]][0]).bit_count() <= (22 if max(len(names[a]), len(names[b])) <= 80 else 14) and distinct[names[a]][1] & distinct[names[b]][1] and distance(names[a], names[b]) <= 0.2 * max(len(names[a]), len(names[b])) + 1e-9]
    root = dict(zip(names, closure(len(names), linked), strict=True))
    gone, seen = set(), set()
    for i, n, w in sorted(place):
        r = root[" ".join(w)]
        if r in seen:
            gone.add((i, n))
        seen.add(r)
    want = {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in docs}
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS row", "2 AS key", "3 AS line", "0L AS n_chars")
    out = lines.without_repeated_lines(df, counts=True).collect()
    assert {r["doc_id"]: r["text"] for r in out} == want
    assert sum(r["n_removed"] for r in out) == len(gone)
    assert all(r["n_chars"] == len(r["text"] or "") for r in out)


def test_line_dedup_finds_alike_lines_without_a_candidate_rule(spark):
    """Held against all pairs by edit similarity alone: no bits, no blocks."""
    rnd = random.Random(21)
    pool = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8))) for _ in range(3000)]
    ws = [[rnd.choice(pool) for _ in range(rnd.choice([4, 5, 6, 8, 12, 20, 40, 80]))] for _ in range(300)]
    texts = [" ".join(w) for w in ws]
    for w in ws:
        w = w[:]
        for i in sorted(rnd.sample(range(len(w)), max(1, len(w) // 8)), reverse=True):
            w[i : i + 1] = rnd.choice([[rnd.choice(pool)], [], [w[i], rnd.choice(pool)]])
        texts.append(" ".join(w))
    alike = [distance(texts[i], texts[300 + i]) <= 0.2 * max(len(texts[i]), len(texts[300 + i])) for i in range(300)]
    assert sum(alike) > 200
    out = lines.without_repeated_lines(spark.createDataFrame([*enumerate(texts)], DOCS), counts=True).collect()
    gone = {r["doc_id"] for r in out if r["n_removed"]}
    assert gone <= {300 + i for i in range(300) if alike[i]}
    assert len(gone) >= 0.95 * sum(alike)


# ---- 10

def removed_by_force(texts, length=200):
    c = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        m = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if c[t[i : i + length]] > 1:
                m[i : i + length] = b"\1" * length
        kept = bytes(x for x, f in zip(t, m, strict=True) if not f)
        out.append((len(t), sum(m), sum(1 for i, f in enumerate(m) if f and (i == 0 or not m[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def repeat_texts():
    rnd = random.Random(11)
    passages = [words(rnd, 60) for _ in range(6)]
    texts = ["", None, "a" * 900, "a" * 199, "ab" * 300, ("xyz" * 30 + "q") * 12, "\0" * 250, "z\0" * 130]
    for _ in range(50):
        t = words(rnd, rnd.randint(0, 80))
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randint(0, 40)
            t += p[a : a + rnd.randint(150, 320)] + words(rnd, rnd.randint(0, 20))
        texts.append(t)
    return [*texts, *texts[10:14], texts[20] + " " + texts[21], texts[30][5:]]


@pytest.mark.parametrize("kinds", [20_000, 3])
def test_repeats_equal_brute_force(spark, monkeypatch, kinds):
    monkeypatch.setattr(repeats.repeat_groups, "__defaults__", ("text", 200, kinds))
    texts = repeat_texts()
    got = sorted(tuple(r) for r in repeats.removal_digest(spark.createDataFrame([*enumerate(texts)], DOCS).selectExpr("*", "1 AS key", "2 AS len")).collect())
    assert [g[1:] for g in got] == removed_by_force([(t or "").encode() for t in texts])


def test_long_texts_are_cut_into_segments(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 4096)
    rnd = random.Random(12)
    p = words(rnd, 80)
    long = words(rnd, 1500) + p + words(rnd, 900) + p[10:] + words(rnd, 300)
    texts = [long, words(rnd, 30) + p[50:300]]
    body = [t.encode() for t in texts]
    roll = repeats._Rolling(4097)
    monkeypatch.setattr(repeats, "_Rolling", lambda most: roll)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(texts)], ["key", "text"])
    rows = [tuple(r.values()) for b in repeats._anchor_rows(200)(iter([batch])) for r in b.to_pylist()]
    anchors = Counter(r[0] for r in rows)
    assert {r[3] for r in rows} == {len(x) for x in body}
    for _, full, key, _, pos, _ in rows:
        assert 0 <= pos <= len(body[key - 1]) - repeats.GRAM
    assert sum(n > 1 for n in anchors.values()) >= 2


def test_texts_stay_valid_after_cuts(spark):
    rnd = random.Random(13)
    p = "é" * 3 + words(rnd, 70) + "ü" * 3
    docs = [(1, "xé" + p + "ñ tail"), (2, "yã" + p + "ð end"), (3, None)]
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in repeats.without_repeats(spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS n_chars")).collect()}
    assert out == {1: ("xéñ tail", 8), 2: ("yãð end", 7), 3: (None, 0)}


def test_repeat_groups_list_all_occurrences(spark):
    rnd = random.Random(14)
    p = words(rnd, 60)
    docs = [(i, words(rnd, 20) + p + words(rnd, 20)) for i in range(5)]
    g = repeats.repeat_groups(spark.createDataFrame(docs, DOCS)).groupBy("repeat").count().collect()
    assert max(r["count"] for r in g) == 5


# ---- all

@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_tables(spark, vocabulary, rows):
    df = spark.createDataFrame(rows, DOCS)
    n = len(rows)
    assert sentencepiece.encoded(df, vocabulary, decode=True).count() == n
    assert licenses.scanned(df, licenses.known(spark)).count() == n
    assert packing.packed(df).count() == n
    assert simhash.near_duplicates(df).count() == n
    assert lines.without_repeated_lines(df).count() == n
    assert repeats.removal_digest(df).count() == n
    assert repeats.without_repeats(df).count() == n
    assert simhash.keep_one(df).count() == (n - 3 if n else 0)  # one of the blank texts and one of the repeated rows
