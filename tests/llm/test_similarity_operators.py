"""Jaccard join, components, embedding dedup, decontamination and HTML extraction against brute force, with odd rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from topograph.llm import decontaminate, embedding_dedup, html_extract, jaccard
from topograph.llm.components import components


def top(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def shingles(text, k):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode())) if text else []
    return frozenset([tuple(words)] if 0 < len(words) < k else zip(*(words[i:] for i in range(k)), strict=False))


def brute(docs, k, num, den):
    sets = {i: shingles(t, k) for i, t in docs}
    parent = {i: i for i in sets}
    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if min(len(sets[a]), len(sets[b])) * den < max(len(sets[a]), len(sets[b])) * num:
                continue
            both = len(sets[a] & sets[b])
            if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(parent, a), top(parent, b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(parent, i)) for i in sets}


def corpus(seed, n=160):
    rng, docs = random.Random(seed), []
    words = [f"w{i}" for i in range(60)]
    for _ in range(n):
        if docs and rng.random() < 0.6:
            base = docs[rng.randrange(len(docs))][1].split()
            for _ in range(rng.randrange(0, 4)):
                base[rng.randrange(len(base))] = rng.choice(words)
            text = " ".join(base)
        else:
            text = " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 20, 40, 80, 150])))
        docs.append((len(docs) * 3 + 1, text))
    return docs


ODD = [(1001, None), (1002, ""), (1003, " \n "), (1004, "One"), (1005, "oNE\t"), (1006, "a b"), (1007, "A  B"), (1008, "é É"), (1009, "x " * 3000), (1010, "x\v" * 2990)]


@pytest.mark.parametrize(("k", "num", "den", "few"), [(3, 90, 100, 24), (5, 80, 100, 24), (3, 90, 100, 2), (2, 70, 100, 3), (5, 80, 100, 1)])
def test_jaccard(spark, k, num, den, few, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", few)  # small values send pairs through the way for hot signatures
    monkeypatch.setattr(jaccard, "BLOCK", 7 if few < 24 else 2000)
    monkeypatch.setattr(jaccard, "GROUP", 5 if few < 24 else 512)
    monkeypatch.setattr(jaccard, "PIVOTS", 1 if few < 24 else 3)
    monkeypatch.setattr(jaccard, "HELD", 6 if few == 2 else 4096)
    docs = corpus(k * few) + ODD
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"key": F.lit("x"), "sig": F.lit(1)})
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, k, num, den).collect()}
    assert got == brute(docs, k, num, den)


def test_signatures_lose_nothing():
    """Random linked pairs share a signature, for allocations with and without one-deletion neighbourhoods."""
    rng = np.random.default_rng(3)
    for num, hist in ((90, 0), (80, 0), (90, 10**9), (80, 10**9)):
        bands = jaccard.Bands(num, 100, dict.fromkeys(range(200), hist), 3000)
        assert not hist or any(p and p[2] for p in bands.plans)
        for n in [*range(1, 60), 100, 333, 1000]:
            for _ in range(20):
                x = np.unique(rng.integers(0, 2**64, n, np.uint64))
                drop, add = rng.integers(0, n // 5 + 2), rng.integers(0, n // 5 + 2)
                y = np.union1d(rng.choice(x, max(1, n - drop), replace=False), rng.integers(0, 2**64, add, np.uint64))
                both = len(np.intersect1d(x, y))
                if 100 * both >= num * (len(x) + len(y) - both) and jaccard.set_key(x) != jaccard.set_key(y):
                    large, small = (x, y) if len(x) >= len(y) else (y, x)
                    own = bands.files(small)[0][0] >> np.uint64(2)
                    for sigs, slack, near in bands.files(large):
                        if not {*(sigs >> np.uint64(2)).tolist()} & {*own.tolist()}:
                            continue
                        exact = (sigs & np.uint64(jaccard.EXACT)) > 0
                        shared = np.isin(sigs >> np.uint64(2), own)
                        spared = np.flatnonzero(exact & shared)[: max(0, slack)]  # the worst choice of lists that aren't probed
                        assert np.delete(shared, spared).any(), (num, hist, n)
                        if near and slack >= 2 * near:  # or those of all neighbourhoods, and fewer exact ones
                            spared = np.append(np.flatnonzero(~exact), np.flatnonzero(exact & shared)[: slack - 2 * near])
                            assert np.delete(shared, spared).any(), (num, hist, n)
                        break
                    else:
                        raise AssertionError((num, hist, n))


def test_one_of_each(spark):
    docs = corpus(9) + ODD
    df = spark.createDataFrame([*docs, docs[0]], "doc_id long, text string")
    want = brute(docs, 5, 80, 100)
    assert sorted(r["doc_id"] for r in jaccard.one_of_each(df, 5, 80, 100).collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    assert jaccard.jaccard_components(df.limit(0), 3, 90, 100).count() == 0 and jaccard.one_of_each(df.limit(0), 5, 80, 100).count() == 0


def test_one_of_each_row(spark):
    """Rows with one id and different texts, null ids and clashing columns: what goes is the row, not its id."""
    one, two = (" ".join(f"{c}{i}" for i in range(30)) for c in "xy")
    rows = [(1, one, "a"), (7, one, "b"), (7, two, "c"), (None, two, "d"), (None, one, "e"), (None, "alone in the world of all words", "f"), (8, None, "g"), (8, None, "h"), (9, two + " more", "i"), (9, two + " more", "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tag string").withColumns({"id": F.lit(5), "key": F.lit("k"), "part": F.lit(0)})
    got = jaccard.one_of_each(df, 5, 80, 100)
    assert got.columns == df.columns and sorted(r["tag"] for r in got.collect()) == ["a", "c", "f", "g", "h"]
    assert {r["tag"]: r["id"] for r in got.collect()}["a"] == 5


def test_sketches_lose_nothing():
    """Folded sketches never differ in more bits than sets in elements, whatever their sizes."""
    rng = np.random.default_rng(4)
    for n in (1, 20, 33, 500, 70000):
        x = np.unique(rng.integers(0, 2**64, n, np.uint64))
        y = np.union1d(x[: n - n // 6], rng.integers(0, 2**64, n // 3 + 1, np.uint64))
        a, b = (np.frombuffer(jaccard.sketch(h), np.uint8)[None] for h in (x, y))
        least = min(a.shape[1], b.shape[1])
        assert jaccard.apart(jaccard.folded(a, least), jaccard.folded(b, least))[0] <= len(np.setxor1d(x, y))


def test_frequent_passages_and_a_family(spark, monkeypatch):
    """Hot signatures of a passage that most documents share, and of a large family of copies with edits, against brute force."""
    monkeypatch.setattr(jaccard, "FEW", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3000)}"
    passage, base, docs = [word() for _ in range(40)], [word() for _ in range(90)], []
    for i in range(220):
        words = [word() for _ in range(rng.randrange(5, 120))]
        words[2:2] = passage
        if i % 3 == 0:
            words = base.copy()
            for _ in range(rng.randrange(0, 5)):
                words[rng.randrange(len(words))] = word()
        docs.append((i, " ".join(words)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), 5, 80, 100).collect()}
    assert got == brute(docs, 5, 80, 100)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (200, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    monkeypatch.setattr(embedding_dedup, "VISITORS", 60)
    monkeypatch.setattr(embedding_dedup, "PER_LIST", 30)
    rng, rows = np.random.default_rng(1), []
    base = rng.normal(size=(60, 16))
    for i in range(500):
        v = base[rng.integers(60)] if i % 3 else base[0]
        rows.append((i * 2, (v + rng.normal(size=16) * rng.choice([0, 0.1, 0.2, 0.4])).astype(np.float32).tolist(), int(rng.integers(3)) if i % 3 else 0))
    odd = [(5001, None, 1), (5003, [0.0] * 16, 1), (5005, [float("nan")] * 16, 1), (5007, rows[0][1], None), (5009, [1.0, None], 1), (5011, [], 1), (5013, [2.0, 1.0], 1), (5015, [4.0, 2.0], 1), (5017, [float("inf"), 1.0], 1), (5019, [1e-30] * 16, 1), (5021, [3e-30] * 16, 1)]
    every = rows + odd
    df = spark.createDataFrame(every, "vec_id long, embedding array<float>, label int").withColumns({"key": F.lit(1), "list": F.lit(2)})
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    ok = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    n, parent = dict.fromkeys((i for i, *_ in every), 0), {i: i for i, *_ in every}
    good = [(i, np.array(v, np.float64), c) for i, v, c in every if c is not None and ok(v)]
    for a, (i, v, c) in enumerate(good):
        for j, w, d in good[a + 1 :]:
            if c == d and len(v) == len(w):
                v1, w1 = v / np.abs(v).max(), w / np.abs(w).max()
                if v1 @ w1 / np.linalg.norm(v1) / np.linalg.norm(w1) >= 0.98:
                    n[i] += 1
                    n[j] += 1
                    x, y = top(parent, i), top(parent, j)
                    parent[max(x, y)] = min(x, y)
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (n[i], top(parent, i), top(parent, i) == i) for i in n}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_decontamination(spark):
    items = [
        (1, "A train leaves Boston at 5 km per hour and meets Alice after 12 minutes of waiting near the river."), (2, "short one here"), (3, None), (4, ""), (5, "1 2 3 4 5 6 7 8"),
        (6, "The red fox jumps over the lazy dog while many birds sing in the tall old trees."),
    ]
    docs = [
        (10, "Intro text. A train leaves Denver at 9 km per hour and meets Carol after 30 minutes of waiting near the river. More."), (11, "A train leaves Boston at 5 km per hour and meets Alice after 12 minutes of waiting near the river."),
        (12, "a train leaves the station early in the morning and nobody meets anyone"), (13, "THE RED FOX. the red fox jumps over the lazy dog while many birds sing in the tall old trees!"), (14, None), (15, ""),
        (16, "A train leaves Denver at 9 km per hour and meets Carol after 30 minutes of waiting near the river. " * 2), (17, "it was a short one here indeed"), (18, "9 8 7 6 5 4 3 2 1"), (None, "The red fox jumps over the lazy dog while many birds sing in the tall old trees."),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item_id": F.lit(0), "cover": F.lit(0)})
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["same_values"] for r in decontaminate.leaked(d, b).collect()}
    assert got == {(10, 1): False, (11, 1): True, (13, 6): True, (16, 1): False, (17, 2): True, (None, 6): True}
    assert decontaminate.leaked(d, b.limit(0)).count() == 0 and decontaminate.leaked(d.limit(0), b).count() == 0
    swapped = spark.createDataFrame([(1, "Then Ann paid 5 dollars and Ben paid 5 dollars so that Ann and Ben were even at last.")], "item_id long, text string")
    texts = spark.createDataFrame([(1, "Then Eve paid 7 dollars and Tom paid 7 dollars so that Eve and Tom were even at last."), (2, "Then Eve paid 7 dollars and Tom paid 8 dollars so that Tom and Max were even at last.")], "doc_id long, text string")
    assert [r["doc_id"] for r in decontaminate.leaked(texts, swapped).collect()] == [1]


def test_decontamination_in_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 100)
    items = [(i, f"item number word{i} with some thing{i} and other stuff{i} that nobody else writes{i} down") for i in range(20)]
    docs = [(i, f"before. {items[i][1]} after") for i in range(0, 20, 2)]
    got = decontaminate.leaked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(i, i) for i in range(0, 20, 2)]


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_html(spark):
    cases = {
        1: (page("<nav><ul><li>Home</li></ul></nav><article><header><h1>A&amp;B</h1></header><p>One <b>two</b>\n three<br>four<p>Five &#233;&nbsp;six</article><footer>c</footer>"), "A&B\nOne two three four\nFive é six"),
        2: (None, ""), 3: ("", ""), 4: (page("<article><p>x<script>var a='</p><p>no'</script>y</p><form>f</form><div class='ad-box'>buy</div><section id=comments><article class=comment>c</article></section></article>"), "xy"),
        5: (page("<main><p>Main text</p></main><p>outside</p>"), "Main text"), 6: ("<article><p>cut &am", "cut &am"), 7: ("<article><p>cut<p cla", "cut"), 8: ("<article><!-- c <p>no</p> --><p>1 < 2 &lt; 3</p></article>", "1 < 2 < 3"),
        9: (page("<div class=sidebar>s</div><div role=navigation>n</div><article><aside>x</aside><p>" + "long " * 20000 + "</p></article>"), ("long " * 20000).strip()),
    }
    cases[10] = (page("<div class='site has-sidebar'><div id=sidebar>s</div><article><p>kept</p></article></div><div id=comments><article><p>c</p></article></div>"), "kept")
    cases[11] = (page("<aside><article>a</article></aside><article><header><h2>H</h2></header>b<footer>f</footer></article><article>c</article>"), "H\nb\nc")
    boiler = "<div>All rights belong to the host of this fine site</div>"
    for i in range(6):
        cases[20 + i] = (page(f"{boiler}<p>Unique words of page number {i} alone and {i} more</p><p>Sign up and stay in touch with us every single day</p>"), f"Unique words of page number {i} alone and {i} more")
    cases[30] = (page("<p>Lonely page on another host says this once only here</p>"), "Lonely page on another host says this once only here")
    rows = [(i, "http://other.org/x" if i == 30 else f"http://h.com/{i}", t, "old") for i, (t, _) in cases.items()] + [(31, None, page("<p>no url but some text in it</p>"), "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_extract.extract(df).collect()}
    for i, (_, want) in cases.items():
        assert (got[i]["text"], got[i]["n_chars"]) == (want, len(want)), i
    assert got[31]["text"] == "no url but some text in it" and len(got) == len(rows)
    assert html_extract.extract(df.limit(0)).count() == 0 and html_extract.extract(df.unionByName(df)).count() == 2 * len(rows)
