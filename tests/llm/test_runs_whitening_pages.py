"""Periodic runs, whitening and main texts against brute force, on small given tables and on awkward ones."""
from __future__ import annotations

import hashlib
import html
import random
import re
import zlib

import numpy as np
import pytest
from test_llm import AWKWARD, SF, awkward, empty, frame, given, repeats, spark  # noqa: F401  fixtures


def brute_runs(w, least=6, times=4):
    n, found = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, times * q) and not any(all(w[k] == w[k + d] for k in range(i, i + size - d)) for d in range(1, q)):
                found.append((i, size, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h, n = (zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(runs), *((top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4),
            sha("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_of_random_words():
    from parcelgrid.llm.periodic_runs import runs_of
    rng = random.Random(5)
    for _ in range(400):
        n, k = rng.randint(6, 70), rng.choice((1, 2, 2, 3, 6))
        w = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.6:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 4))
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        for least, times in ((6, 4), (2, 2)):
            assert [tuple(map(int, r)) for r in runs_of(np.array(w), least, times)] == brute_runs(w, least, times)


def test_suffix_tree_gives_common_prefixes():
    from parcelgrid.llm.periodic_runs import Extensions
    rng = random.Random(6)
    for _ in range(100):
        s = [rng.randrange(2) for _ in range(rng.randint(1, 40))] + [9]
        e, (i, j) = Extensions(s), np.triu_indices(len(s), 1)
        want = [next(k for k in range(len(s)) if s[a + k] != s[b + k]) for a, b in zip(i, j)]
        assert e.common(i, j).tolist() == want and np.argsort(e.rank).tolist() == sorted(range(len(s)), key=lambda k: s[k:])


LOOPS = [(20, "a b c d " * 9 + "x y"), (21, "spam " * 50), (22, "A a " * 10), (23, "one two " * 3), (24, "é ñ " * 8 + "日 " * 7)]


def run_rows(df):
    from parcelgrid.llm.periodic_runs import collapse, digests, looped
    columns = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    return sorted((tuple(r[c] for c in columns) for r in digests(collapse(df, edit=looped)).collect()), key=str)


@pytest.mark.parametrize("name", ["awkward", "repeats"])
def test_periodic_runs(name, spark, request):  # noqa: F811
    df = request.getfixturevalue(name).unionByName(frame(spark, [(d, t, "en", "a") for d, t in LOOPS] + [(d, "w1 w2 w3 w4 w5 " * 20 + "end", "en", "a") for d in range(100, 160)]))
    short = df.filter("coalesce(length(text), 0) < 20000")  # brute force is quadratic
    assert run_rows(short) == sorted((brute_row(r["doc_id"], r["text"]) for r in short.collect()), key=str)
    assert len(run_rows(df)) == df.count()


def test_periodic_runs_given(given, empty, spark):  # noqa: F811
    from parcelgrid.llm.periodic_runs import collapse
    assert run_rows(given) == sorted((brute_row(r["doc_id"], r["text"]) for r in given.collect()), key=str)
    assert run_rows(empty) == []
    out = collapse(frame(spark, [(1, "p q r p q r p q r p q r s", "en", "a")])).first()
    assert [tuple(r) for r in out["runs"]] == [(0, 12, 3)] and bytes(out["text"]) == b"p q r s"
    long = collapse(frame(spark, [(1, " ".join(f"k{i % 30000}" for i in range(300_000)), "en", "a")])).first()
    assert [tuple(r) for r in long["runs"]] == [(0, 300_000, 30_000)]


VECTORS = [(1, [0.1, 0.2, -0.3]), (2, [0.5, 0.1, 0.2]), (2, [0.5, 0.1, 0.2]), (3, None), (4, [0.1, None, 0.2]), (5, [float("nan"), 0.0, 0.0]), (6, [float("inf"), 1.0, 2.0]),
           (7, []), (8, [1.0]), (None, [0.9, -0.4, 0.7]), (9, [-0.25, 0.75, 0.5]), (10, [0.3, 0.3, 0.31]), (11, [-1.0, 2.0, 0.1])]


def whitened_by_hand(rows):
    x = {i: np.floor(256 * np.array(v, dtype=np.float64)).astype(np.int64) for i, v in enumerate(v for _, v in rows)}
    fit = np.unique(np.stack(list(x.values())), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1], q[:, ::-1]
    return n, s, e, q, x


def check_whitening(rows, out, components=4):
    n, s, e, q, x = whitened_by_hand(rows)
    k = min(components, int((e > 1e-12 * e.sum()).sum()))
    got = {}
    for r in out.collect():
        got.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r)
    assert sum(len(v) for c in got.values() for v in c.values()) == k * len(rows)
    for i, (vec_id, _) in enumerate(rows):
        found = got[vec_id, int(sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[i], s)))]
        for c in range(k):
            r = found[c + 1][0]
            assert r["n"] == n and abs(r["explained"] - e[c] / e.sum()) <= 1e-10 and r["identity_error"] <= 1e-9 and r["residual"] <= 1e-9
            assert abs(abs(r["whitened"]) - abs((x[i] - s / n) @ q[:, c] / np.sqrt(e[c]))) <= 1e-6


def vectors(spark, rows):  # noqa: F811
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, x string, n int")


def test_whitening_of_awkward_vectors(spark):  # noqa: F811
    from parcelgrid.llm.whitening import whiten
    rows = [(i, v) for i, v in VECTORS if v and len(v) == 3 and None not in v and np.isfinite(v).all()]
    rows = [(i, np.array(v, np.float32).tolist()) for i, v in rows]
    check_whitening(rows, whiten(vectors(spark, VECTORS)))
    assert whiten(vectors(spark, VECTORS).limit(0)).count() == 0
    assert whiten(vectors(spark, [(1, None), (2, [])])).count() == 0
    assert whiten(vectors(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])).count() == 0  # no direction is spanned
    wide = whiten(vectors(spark, [(1, [1e30, 0.5]), (2, [0.5, 0.5]), (3, [0.1, 0.2])]))  # beyond a long: no exact figure, but rows
    assert {r["deviation"] for r in wide.collect()} == {None}


@pytest.mark.parametrize("guard", [28, 8, 2])
def test_whitening_of_given_vectors(guard, spark):  # noqa: F811
    from parcelgrid.llm import whitening
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    check_whitening(rows, whitening.whiten(df, guard=guard))


def test_partial_sums_merge_in_groups(spark, monkeypatch):  # noqa: F811
    from parcelgrid.llm import whitening
    monkeypatch.setattr(whitening, "MERGE", 3)
    df = whitening.quantized(spark.read.parquet(f"{SF}/embeddings.parquet")).repartition(20)
    total = whitening.summed(df, lambda m: m.sum(axis=0), (64,), np.int64)
    assert total.tolist() == np.sum([r["x"] for r in df.collect()], axis=0).tolist()


def article(source):
    body = re.search(r"<article[^>]*>(.*)</article>", source, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", re.sub(r"</?b>", "", body)))
    return "\n\n".join(p for p in (" ".join(html.unescape(x).split()) for x in parts) if p)


PAGE = """<html><body><div class="site-header"><p>The Daily Thing</p></div><div id="menu"><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></div>
<div class="cookie-notice"><p>We use cookies to make this site better for all of its readers.</p><button>Fine</button></div>
<div class="wrap"><div class="post-content"><h1>A title &amp; more</h1><p>The first paragraph has   several words, and a <a href="/x">link</a>, and it
goes on for a while so that it is <b>long enough</b>.</p><div class="ads">Buy <a href=/b>this</a> now</div><p>The second one follows, with some more words in it; it has an end as well.
<p>Third, unclosed, 2 &lt; 3 and &quot;quoted&quot; words in a paragraph of some length, too.</div>
<div class="comments"><h3>Comments</h3><div class="comment"><p>I have read this article and I do not agree with any of it, sorry to say so.</p></div></div></div>
<div class="sidebar"><h3>Popular</h3><ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li></ul></div><form><label>Search</label><input></form>
<div class="footer">&copy; 2020 The Daily Thing <script>var x = "<p>no</p>";</script></div></body></html>"""


@pytest.fixture(scope="module")
def trees(spark):  # noqa: F811
    from parcelgrid.llm.extraction import train
    return train(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet"))


def test_main_text_of_given_pages(spark, trees):  # noqa: F811
    from parcelgrid.llm.extraction import extract
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    got = extract(pages, trees).collect()
    assert len(got) == len(want) and all(r["text"] == want[r["page_id"]] and r["n_chars"] == len(r["text"]) for r in got)


def test_main_text_of_an_unseen_layout(trees):
    from parcelgrid.llm.extraction import main_texts
    assert main_texts([PAGE], trees)[0].split("\n\n") == [
        "A title & more", "The first paragraph has several words, and a link, and it goes on for a while so that it is long enough.",
        "The second one follows, with some more words in it; it has an end as well.",
        'Third, unclosed, 2 < 3 and "quoted" words in a paragraph of some length, too.']


def test_main_text_on_held_out_layouts(spark, trees):  # noqa: F811
    from parcelgrid.llm.extraction import Layout, decoded, kept, material
    from parcelgrid.llm.dom import Forest
    rng, forest, n = random.Random(77), Forest(), 0
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner, outer = material(r["html"])
        for _ in range(4 if inner else 0):
            forest.add(n, Layout(inner, outer, rng).page(), training=True)
            n += 1
    keep, want, w = decoded(forest, trees.score(forest.features())), kept(forest), np.array(forest.chars)
    assert 2 * (w * (keep & want)).sum() / ((w * keep).sum() + (w * want).sum()) > 0.95


def test_choices_do_not_contradict_and_are_the_best(trees):
    from parcelgrid.llm.dom import Forest
    from parcelgrid.llm.extraction import SWITCH, decoded, weights
    rng = np.random.default_rng(3)
    for _ in range(40):
        forest = Forest()
        forest.element(0, -1, 0, 0)
        for _ in range(rng.integers(0, 7)):
            forest.element(0, 0, 0, 0) if rng.random() < 0.3 else None
            k = len(forest.page)
            up = k - 1 if rng.random() < 0.5 else forest.parent[k - 1]
            forest.element(0, max(up, 0), 0, 0)
        n = len(forest.page)
        for k in range(n - 1, 0, -1):
            forest.last[forest.parent[k]] = max(forest.last[forest.parent[k]], forest.last[k])
        forest.chars = rng.integers(0, 200, n).tolist()
        odds, w = rng.normal(0, 4, n), weights(forest)
        yes, no = -w * np.logaddexp(0, -odds), -w * np.logaddexp(0, odds)

        def value(states):
            total = 0.0
            for k, s in enumerate(states):
                above = states[forest.parent[k]] if k else 0
                if s != above and (above, s) not in ((0, 1), (1, 2)):
                    return -np.inf
                total += (yes if s == 1 else no)[k] - SWITCH * (s != above)
            return total

        import itertools
        if n <= 9:
            best = max(value(s) for s in itertools.product(range(3), repeat=n))
            keep = decoded(forest, odds)
            mine = max(value(s) for s in itertools.product(*[(1,) if x else (0, 2) for x in keep]))
            assert abs(best - mine) < 1e-6


def test_main_text_of_awkward_pages(spark, trees):  # noqa: F811
    from parcelgrid.llm.extraction import extract, train
    odd = [(1, "u", None), (2, None, ""), (3, "u", "no markup at all"), (None, "u", "<p>" * 3000 + "deep" + "</div>" * 3000), (4, "u", "<" * 5000), (5, "u", "<div " * 2000),
           (6, "u", "<!-- open"), (7, "u", "<script>never closed <p>x</p>"), (7, "u", "<a href='x\" <b>q</b>"), (8, "u", "<div>" * 30000 + "x"), (9, "u", "&bogus; &#x110000; &amp"),
           (10, "u", PAGE + PAGE), (11, "u", "<article><p>" + "word " * 100_000 + "</article>"), (12, "u", "</p></html><table><tr><td>a<td>b<tr><td>c</table><li>x<li>y<option>z")]
    df = spark.createDataFrame([(*r, "t", 3) for r in odd], "page_id long, url string, html string, text string, n_chars int")
    out = extract(df, trees).collect()
    assert len(out) == len(odd) and all(r["text"] is not None and r["n_chars"] == len(r["text"]) for r in out)
    assert [r["text"] for r in out if r["page_id"] in (1, 2, 6)] == ["", "", ""]
    assert extract(df.limit(0), train(df.limit(0))).count() == 0
    assert extract(df, train(df.filter("html is null"))).count() == len(odd)
    assert extract(df, train(df)).count() == len(odd)


def test_scratch_tables_go(spark, tmp_path):  # noqa: F811
    import os

    from parcelgrid.llm.common import save, scratch
    path = lambda df: df.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    with scratch(spark) as made:
        first, second = save(spark.range(3), "a"), save(spark.range(4), "b")
        assert len(made) == 2
        made.pop()
        gone, stays = path(first), path(second)
    assert not os.path.exists(gone) and os.path.exists(stays) and second.count() == 4


def test_a_family_without_links_meets_once(spark, monkeypatch):  # noqa: F811
    """Texts that share most words without being linked: few candidates come out of the joins."""
    from parcelgrid.llm import parity_join
    rng, base, rows = random.Random(3), [f"w{i}" for i in range(400)], []
    for d in range(400):
        w = list(base)
        for k in rng.sample(range(400), 24):
            w[k] = f"d{d}x{k}"
        rows.append((d, " ".join(w), "en", "a"))
    rows.append((400, " ".join(base), "en", "a"))
    sizes, real = [], parity_join.links
    monkeypatch.setattr(parity_join, "links", lambda docs, pairs: sizes.append(pairs.count()) or real(docs, pairs))
    out = parity_join.join(frame(spark, rows)).collect()
    assert all(r["component_id"] == r["doc_id"] for r in out)
    assert sizes[0] <= 2 * len(rows) and sizes[1] <= len(rows)


def test_pipeline_stages_on_awkward_tables(spark, repeats, empty):  # noqa: F811
    """Empty tables, null ids, repeated rows, clashing columns and a very long text go through all stages."""
    import corpus_pipeline as cp
    long = frame(spark, [(900, " ".join(f"long{i} words" for i in range(100_000)), "en", "a")])
    for docs, least in ((empty, 0), (repeats.unionByName(long), 1)):
        docs = docs.withColumn("row", docs["n"]).withColumn("text_a", docs["n"])
        for name, stage in cp.STAGES:
            out = stage(spark, docs, SF)
            if name != "packing":
                assert tuple(out.columns) == cp.COLUMNS
                docs = spark.createDataFrame(out.collect(), out.schema)
        assert out.count() >= least
