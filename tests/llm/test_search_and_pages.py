"""M-trees and page extraction."""

import random
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import html, mtree


def cases():
    rng = np.random.default_rng(1)
    x = np.floor(rng.integers(-200, 200, (1500, 8))).astype(float)
    half = x.copy()
    half[:700] = half[0]
    clusters = np.floor((rng.normal(size=(12, 8)) * 300)[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 8)) * 5)
    return {"random": x, "copies": half, "clusters": clusters, "zeros": x * 0, "few": x[:3], "ties": np.floor(x / 100)}


@pytest.mark.parametrize("name", list(cases()))
def test_tree_finds_what_a_scan_finds(name):
    x = cases()[name]
    n, largest = len(x), float((x * x).sum(axis=1).max())
    tree = mtree.Tree.unpacked(mtree.Tree.build(np.arange(n), x, largest).packed())
    computed = []
    for q in range(0, n, 37):
        s = x @ x[q]
        want = [(int(s[i]), -i) for i in np.lexsort((np.arange(n), -s)) if i != q][:5]
        got, count = tree.search(x[q], q, 5, largest)
        assert got == want
        computed.append(count)
    if name == "clusters":
        assert np.mean(computed) < 0.2 * n  # the stored distances spare most computations


def brute_top(rows, every, k):
    ok = {i: np.floor(256 * np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    wide = max((len(v) for v in ok.values()), default=0)
    ok = {i: np.pad(v, (0, wide - len(v))) for i, v in ok.items()}
    out = set()
    for q in ok:
        if q % every == 0:
            best = sorted((-int(ok[q] @ v), i) for i, v in ok.items() if i != q)[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def test_large_components_and_a_hot_id(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([1e6, -2e5, 3.5]) * rng.random() for _ in range(3)]) for i in range(120)] + [(200, [2e7, 1.0]), (250, [1e300]), (300, [8e6, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    fits = [(i, v) for i, v in rows if i not in (200, 250)]
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in fits}  # Python integers: doubles don't hold these scores
    want = set()
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], w, strict=False)), i) for i, w in whole.items() if i != q)[:5]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    assert set(map(tuple, mtree.top_k(df).collect())) == want
    hot = spark.createDataFrame([(100 if i % 3 == 0 else i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(600)], "vec_id long, embedding array<float>")
    rows = mtree.integer_vectors(hot)
    shard = F.pmod(F.xxhash64(F.lit("shard"), "vec_id", "v"), F.lit(12))
    assert rows.groupBy(shard).count().agg(F.max("count")).first()[0] < 90


@pytest.mark.parametrize("shard", [4096, 40])
def test_top_k(spark, monkeypatch, shard):
    monkeypatch.setattr(mtree, "SHARD", shard)
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(300)] + [(400 + i, [0.25] * 6) for i in range(150)]
    rows += [(700, None), (701, [0.1, None, 0.2]), (702, [float("nan")] * 6), (750, [float("inf")] * 6), (800, [0.5, 0.5]), (None, [1.0] * 6), (850, [])]
    df = spark.createDataFrame(rows + rows[:10], "vec_id long, embedding array<float>").withColumn("shard", F.lit("x")).withColumn("v", F.lit(1))
    rows = [(i, None if v is None else [None if e is None else float(np.float32(e)) for e in v]) for i, v in rows]
    got = [tuple(r) for r in mtree.top_k(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_top(rows, 50, 5)


def test_top_k_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [0.5]), (1, [0.5]), (50, [-0.5])], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in mtree.top_k(df).collect()} == {(0, 1, 1, 16384), (0, 2, 50, -16384), (50, 1, 0, -16384), (50, 2, 1, -16384)}
    assert mtree.top_k(df.limit(0)).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a>b">Menu</a></li></ul></nav><!-- x <p>no</p> --><div class="ad">Buy &amp; win</div>
<article><h1>Head&nbsp;line</h1><p><b>One<br>two &lt;3 a < b.<p>Three <i>four</i> five, six seven.</p></article>
<section id="comments"><p>First! A long comment by a reader, with some words.</p></section>
<form><p>Your name, please, and your address.</p></form><footer>&copy; 2020</footer></body></html>"""


def test_blocks():
    found = html.blocks(PAGE)
    assert [b.text for b in found] == [
        "Menu", "Buy & win", "Head line", "One two <3 a < b.", "Three four five, six seven.",
        "First! A long comment by a reader, with some words.", "Your name, please, and your address.", "© 2020",
    ]
    assert found[0].linked == 1 and "ad" in found[1].roles and "talk" in found[5].roles and "form" in found[6].place.tags
    assert html.blocks(None) == [] and html.blocks("") == [] and [b.text for b in html.blocks("a<p>b<script>c")] == ["a", "b"]
    assert [b.text for b in html.blocks("<ul><li>x<li>y<p>z<table><tr><td>q<td>r<p unfinished")] == ["x", "y", "z", "q", "r"]


def test_drawings_formulas_and_odd_ends_lose_no_text():
    def said(page):
        return [b.text for b in html.blocks(page)]

    assert said('<p>a <svg width="1"/> b<p>c') == ["a b", "c"] and said("<p>a <math/>b</p><p>c") == ["a b", "c"]
    assert said("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> hold.</p>") == ["Let x=1 hold."]
    assert said("<p>a<svg><title/><g><text>no</text></g></svg>b<p>c") == ["ab", "c"]
    assert said("<div><svg><path><p>a</p></div><p>b<svg></svg>") == ["a", "b"] and said("<p>a<svg></p>b") == ["a", "b"]
    assert said("<svg><foreignObject><p>a</p></foreignObject></svg>b") == ["a", "b"]
    assert said("<p>a <object data=x>b</object> c") == ["a b c"]
    assert said("<noscript><p>a</p><p>b") == ["a", "b"] and said("<iframe src=x><p>a") == ["a"] and said("<select><option>x</select>y") == ["x", "y"]


def test_deep_pages_cost_their_length():
    deep = "<div>a" * 100_000
    for page, n in ((deep, 100_000), (deep + "</div>" * 100_000, 100_000), ("<p>" + "<b>a" * 100_000 + "</i>" * 100_000, 1), ("<b>a</x>" * 100_000, 100_000)):
        began = time.process_time()
        found = html.blocks(page)
        assert len(found) == n and time.process_time() - began < 10
    tracemalloc.start()  # tracing slows the work, so it isn't timed
    found = html.blocks(deep)
    assert tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()
    assert html.describe(found[:3])[2].count("as before") == 0 and html.describe(html.blocks("<ul><li>a<li>b"))[1].count("as before") == 1


def test_captions_and_links_in_articles_are_content():
    page = html.blocks('<nav><a href=x>Menu</a></nav><article><figure><figcaption>Cap</figcaption></figure><p><a href=x>Linked words</a></p></article>')
    assert list(zip([b.text for b in page], html.structural_labels(page))) == [("Menu", 0), ("Cap", 1), ("Linked words", 1)]


def test_fit_sees_whole_pages():
    n = html.MAX_TRAIN_BLOCKS
    model = html.fit([([["early"]] * n + [["late"]] * n, [0] * n + [1] * n)])
    assert "late" in model.weights and model.decode([["late"]] * 3) == [1, 1, 1]


def expected(page):
    if page is None or "<article>" not in page:
        return ""
    import html as entities
    import re

    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    parts = (" ".join(entities.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split("</?(?:p|h1)>", inner))
    return "\n\n".join(p for p in parts if p)


def test_extraction(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    odd = spark.createDataFrame([(9000, "u", None), (9001, None, ""), (9002, "v", PAGE), (9002, "v", PAGE)], "page_id long, url string, html string")
    both = pages.unionByName(odd).withColumn("text", F.lit("mine"))
    want = {r.page_id: expected(r.html) for r in both.collect()}
    rows = html.extract(both, html.train(pages)).collect()
    assert len(rows) == pages.count() + 4
    assert [r.page_id for r in rows if r.text != want[r.page_id] and r.page_id != 9002] == []
    assert {r.text for r in rows if r.page_id == 9002} == {"Head line\n\nOne two <3 a < b.\n\nThree four five, six seven."}
    assert html.extract(both.limit(0), html.train(both.limit(0))).count() == 0


def test_chain_learns_steps():
    rng = random.Random(0)
    pages = []
    for _ in range(80):
        labels = [0] * rng.randrange(1, 4) + [1] * rng.randrange(3, 9) + [0] * rng.randrange(1, 4)
        pages.append(([[f"word:{y if rng.random() < 0.8 else 1 - y}"] for y in labels], labels))
    model = html.fit(pages)
    right = np.mean([a == b for rows, labels in pages for a, b in zip(model.decode(rows), labels)])
    alone = np.mean([r[0] == f"word:{y}" for rows, labels in pages for r, y in zip(rows, labels)])
    assert right > alone + 0.03
    assert html.fit([]).decode([["x"]]) in ([0], [1]) and model.decode([]) == []


def test_upper_pages_spare_shards(spark, monkeypatch):
    for name, value in (("SHARD", 50), ("PAGE", 8), ("QUERIES", 16)):
        monkeypatch.setattr(mtree, name, value)
    sent = []
    choose = mtree.chosen_shards

    def counted(asked, trees, shards, dim, largest):
        out = choose(asked, trees, shards, dim, largest)
        meant = asked.select(F.explode("asked")).count()
        sent.append((out.agg(F.sum(F.size("asked"))).first()[0] or 0, meant * (shards - 1)))
        return out

    monkeypatch.setattr(mtree, "chosen_shards", counted)
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(20, 8))
    middle *= 4 / np.linalg.norm(middle, axis=1)[:, None]
    x = middle[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 8)) * 0.05
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    got = {tuple(r) for r in mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == brute_top(rows, 50, 5)
    assert sent[0][0] < 0.3 * sent[0][1]
