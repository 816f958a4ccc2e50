"""Operators for training data against brute-force versions, on small given tables and on awkward ones."""
from __future__ import annotations

import hashlib
import math
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
SF = "/root/testdata/sf0.001"
NON = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.fixture(scope="session")
def spark():
    from parcelgrid.session import build_session
    session = build_session("llm-tests", "local[8]", 8)
    session.sparkContext.setLogLevel("OFF")
    return session


BASE = " ".join(f"word{i} of the" for i in range(60))
AWKWARD = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE.replace("word3 ", "other "), "en", "b"), (4, None, "en", "a"), (5, "", None, None),
    (6, "one two three", "en", "a"), (7, "One TWO three", "en", "a"), (8, "é" * 150 + " ñandú 日本語 " + "é" * 150, "fr", "a"),
    (9, "x" * 300, "en", "a"), (10, "ab" * 700, "en", "a"), (11, BASE + " " + "tail words here " * 30, "en", "c"), (12, "  \n\t ", "en", "a"),
    (13, "call +1 (555) 555-1234 or mail a.b@c.de, 4111 1111 1111 1111; 10.0.0.1 " + "y" * 99, "en", "a"), (14, BASE[:400], "en", "a"),
    (15, "z y x w v u t s r q p o n m l k j i h g f e d c b a " * 3000, "en", "a"),
]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame([(d, t, l, s, len(t or "")) for d, t, l, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        df = df.selectExpr("*", "'x' as key", "1 as n", "'y' as id", "0 as start", "'z' as word", "3 as score")
    return df


@pytest.fixture(scope="session")
def awkward(spark):
    return frame(spark, AWKWARD).repartition(3)


@pytest.fixture(scope="session")
def repeats(spark):
    """Repeated rows, repeated and null ids."""
    return frame(spark, AWKWARD + [AWKWARD[0], (3, "other text under one id", "en", "a"), (None, BASE, "en", "a"), (None, None, None, None)])


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, AWKWARD).limit(0)


@pytest.fixture(scope="session")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(df):
    return {r["doc_id"]: r["text"] or "" for r in df.collect()}


@pytest.mark.parametrize("name", ["awkward", "given"])
def test_packing(name, request):
    import public_tokenizers
    from tokenizers import Tokenizer

    from parcelgrid.llm.packing import pack
    df = request.getfixturevalue(name)
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, want = Tokenizer.from_file(path), {}
    for d, t in texts_of(df).items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        want[d] = ids
    rows, places = pack(df, path).collect(), defaultdict(list)
    per = defaultdict(list)
    for r in rows:
        per[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["ids_crc32"] == zlib.crc32(want[r["doc_id"]][r["start"]:r["start"] + r["length"]].tobytes())
    assert set(per) == set(want)
    for d, ps in per.items():
        ps.sort(key=lambda r: r["piece"])
        assert [p["piece"] for p in ps] == list(range(len(ps))) and sum(p["length"] for p in ps) == len(want[d])
        at = 0
        for p in ps:
            assert p["start"] == at and (p["piece"] == 0 or p["length"] == 2048)
            at += p["length"]
    for seq in places.values():
        at = 0
        for o, n in sorted(seq):
            assert o == at
            at += n
        assert at <= 2048
    total = sum(map(len, want.values()))
    assert len(places) <= 1.05 * math.ceil(total / 2048) + 2


def test_packing_plan_is_close_to_the_bound():
    from parcelgrid.llm.packing import plan
    r = np.random.default_rng(1)
    x = np.clip(r.lognormal(6.0, 0.9, 20000).astype(int), 1, 2048)
    runs, used = plan(dict(zip(*(a.tolist() for a in np.unique(x, return_counts=True)))))
    assert runs[:, 2].sum() == len(x) and used <= 1.02 * math.ceil(x.sum() / 2048)


def tokens(t):
    return WORD.findall(lower(t)) + [None]


@pytest.mark.parametrize("name", ["awkward", "given"])
def test_suffix_lm(name, request):
    from parcelgrid.llm.suffix_lm import score
    df = request.getfixturevalue(name)
    docs = texts_of(df)
    train = Counter(w for d, t in docs.items() if zlib.crc32(str(d).encode()) % 5 != 1 for w in tokens(t))
    n, v = sum(train.values()), len(train)
    rows, gain = score(df).collect(), 0.0
    assert len(rows) == len(docs)
    for r in rows:
        ws = tokens(docs[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(train[w] > 0 for w in ws), n)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
        base = sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
        assert r["score"] <= 0
        gain += r["score"] - r["base_score"]
    assert gain >= 0


def test_suffix_lm_distributions_sum_to_one(given):
    from pyspark.sql import functions as F

    from parcelgrid.llm import suffix_lm as lm
    texts = given.select("doc_id", F.col("text").cast("binary").alias("text"))
    vocabulary, tree, total, distinct = lm.train(texts, least=20.0, depth=1)
    words = np.sort(np.array([r["word"] for r in vocabulary.collect()], dtype=np.int64).view(np.uint64))
    root = 10 ** tree.roots  # every word is a head word here
    unknown = 0.5 / (total + 0.5 * (distinct + 1))
    assert abs(root.sum() + unknown - 1) < 1e-9
    assert np.array_equal(tree.words, words)
    ones = lm.extended(np.full(len(words), 1, np.uint64), words)
    at, hit = lm.member(tree.sequences, ones)
    assert hit.any()
    for c, left in zip(ones[hit][:20], 10 ** tree.values[at[hit]][:20]):  # the value of a context is what it leaves to the root
        k, explicit = lm.member(tree.sequences, lm.extended(np.full(len(words), c), words))
        assert explicit.any() and abs((left * root * 10 ** np.where(explicit, tree.values[k], 0.0)).sum() + left * unknown - 1) < 1e-9


def test_suffix_lm_counts_follow_the_corpus(spark):
    """Sequences repeated a fixed number of times count in a corpus of any size, and joined values equal broadcast ones."""
    from parcelgrid.llm import suffix_lm as lm
    r = np.random.default_rng(8)
    other = [" ".join(f"u{x}" for x in r.integers(0, 400, 9000)) for _ in range(200)]
    phrase = "alpha beta gamma delta epsilon"
    docs = {i: f"{t} {phrase if i % 16 == 0 else 'none'}" for i, t in enumerate(other)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    settings = dict(least=8.0)
    got = {x["doc_id"]: (x["base_score"], x["score"]) for x in lm.score(df, **settings).collect()}
    joined = {x["doc_id"]: x["score"] for x in lm.score(df, head=20, **settings).collect()}
    assert all(abs(joined[d] - s) < 1e-6 * abs(s) for d, (_, s) in got.items())
    train = [tokens(t) for d, t in docs.items() if zlib.crc32(str(d).encode()) % 5 != 1]
    n = [Counter(tuple(t[i:i + k]) for t in train for i in range(len(t) - k + 1)) for k in range(1, 5)]
    total, distinct = sum(n[0].values()), len(n[0])
    assert 8 <= n[3]["alpha", "beta", "gamma", "delta"] < 1e-5 * total
    explicit = [defaultdict(dict) for _ in range(4)]
    for k in (1, 2, 3):
        for g, c in n[k].items():
            if c >= 8:
                explicit[k][g[:-1]][g[-1]] = c

    def p(c, w):
        if not c:
            return (n[0][w,] + 0.5) / (total + 0.5 * (distinct + 1))
        share, of = explicit[len(c)].get(c, {}), n[len(c) - 1][c] + 20.0
        return share.get(w, 0) / of + (of - sum(share.values())) / of * p(c[1:], w) if share else p(c[1:], w)

    far = lambda a, b: a >= 1.3 * b or b >= 1.3 * a
    kept = {c for k in (1, 2, 3) for c, ws in explicit[k].items() if any(far(p(c, w), p(c[1:], w)) for w in ws)}
    kept |= {c[i:] for c in kept for i in range(1, len(c))}
    assert ("alpha", "beta") in kept
    for d in (0, 1, 16):
        ws, want = tokens(docs[d]), 0.0
        for i, w in enumerate(ws):
            c = next((tuple(ws[i - k:i]) for k in (3, 2, 1) if i >= k and tuple(ws[i - k:i]) in kept), ())
            want += math.log10(p(c, w))
        assert abs(got[d][1] - want) < 1e-6 * abs(want)


def test_decontamination(spark, awkward, given):
    from parcelgrid.llm.decontamination import decontaminate
    bench = [(1, " ".join(BASE.split()[5:25])), (2, "ONE two, three!"), (3, ""), (4, None), (5, "k j i h g f e d c b a z y x"), (None, "one two three"), (2, "one two three")]
    items = spark.createDataFrame(bench, "item_id long, text string").selectExpr("*", "'q' as doc_id")
    real = spark.read.parquet(f"{SF}/benchmark.parquet")
    for df, b in ((awkward, items), (given, real)):
        win = defaultdict(set)
        for i, t in ((r["item_id"], r["text"]) for r in b.collect()):
            w = NON.findall(lower(t or ""))
            for k in range(max(1, len(w) - 9) if w and i is not None else 0):
                win[tuple(w[k:k + 10])].add(str(i))
        sizes = {len(k) for k in win}
        want = {}
        for d, t in texts_of(df).items():
            w, hit, ids = NON.findall(lower(t)), set(), set()
            for n in sizes:
                for k in range(len(w) - n + 1):
                    if tuple(w[k:k + n]) in win:
                        hit |= set(range(k, k + n))
                        ids |= win[tuple(w[k:k + n])]
            want[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
        for block in (200_000, 3):
            got = decontaminate(df, b, block=block).collect()
            assert {r["doc_id"]: tuple(r)[1:6] for r in got} == want
            texts = texts_of(df)
            for r in got:
                covered = [w for s in r["spans"] for w in NON.findall(lower(texts[r["doc_id"]][s["start"]:s["end"]]))]
                assert len(covered) == r["n_hit"]


def test_warc_fixity(spark):
    from parcelgrid.llm.fixity import audit
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>") for i in range(3000)] + [(None, None, None), (7, "again", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as node", "2 as digest")
    assert audit(pages, pages.repartition(5)).count() == 0
    other = [r for r in rows if r[0] != 100] + [(5000, "new", "n")]
    other[1234] = (other[1234][0], other[1234][1], "broken")
    replica = spark.createDataFrame(other, "page_id long, url string, html string")
    got = {(r["page_id"], r["kind"]): r for r in audit(pages, replica).collect()}
    assert set(got) == {(100, "missing"), (5000, "extra"), (other[1234][0], "changed")}
    low = [(-(1 << 63), "u", "a"), ((1 << 63) - 1, "u", "b"), (-1, "u", "c"), (None, "u", "d"), (None, "u", "d")]
    kinds = lambda a, b: sorted((str(r["page_id"]), r["kind"]) for r in audit(*(spark.createDataFrame(x, pages.schema.simpleString()[7:-1].split(",node")[0].replace(":", " ")) for x in (a, b))).collect())
    assert kinds(low, low) == [] and kinds(low, low[:2] + low[3:]) == [("-1", "missing")]
    assert kinds(low, low[1:4] + [(None, "u", "e")]) == sorted([("-9223372036854775808", "missing"), ("None", "changed")])
    sizes = lambda x: len(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <page:{x[0]}>\r\nWARC-Target-URI: {x[1]}\r\nContent-Length: {len(x[2])}\r\n\r\n{x[2]}\r\n\r\n")
    ordered = sorted([r for r in rows if r[0] is not None and r[0] < 100])
    assert got[100, "missing"]["offset"] == sum(map(sizes, ordered))
    assert audit(pages.limit(0), replica.limit(0)).count() == 0


def removed_by_brute_force(docs: dict[int, str]):
    seen, out = set(), {}
    for d in sorted(docs):
        b = docs[d].encode()
        gone = np.zeros(len(b), dtype=bool)
        for s in range(len(b) - 99):
            w = b[s:s + 100]
            if w in seen:
                gone[s:s + 100] = True
            seen.add(w)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1)
        out[d] = (len(b), int(gone.sum()), len(edges), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("name", ["awkward", "given"])
def test_suffix_dedup(name, request):
    from parcelgrid.llm.suffix_dedup import deduplicate
    df = request.getfixturevalue(name)
    got = {r["doc_id"]: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in deduplicate(df).collect()}
    assert got == removed_by_brute_force(texts_of(df))


def test_suffix_dedup_many_partial_repeats(spark):
    from parcelgrid.llm import suffix_dedup as sd
    r = np.random.default_rng(3)
    passages = ["".join(r.choice(list("abc de"), n)) for n in (70, 90, 99, 100, 101, 130, 180, 400)]
    docs = {i: "".join(x for _ in range(4) for x in ("".join(r.choice(list("abcdefgh "), 60)), passages[r.integers(len(passages))])) for i in range(80)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    want = removed_by_brute_force(docs)
    got = {x["doc_id"]: tuple(x[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for x in sd.deduplicate(df).collect()}
    assert got == want
    names = df.selectExpr("doc_id as id", "cast(text as binary) as text")  # all routes as heavy ones
    covered = defaultdict(set)
    for x in sd.spans(names, heavy=1).collect():
        covered[x["id"]] |= set(range(x["start"], x["start"] + x["n"] + 99))
    assert all(len(covered[d]) == want[d][1] for d in docs)


def test_suffix_array_is_sorted():
    from parcelgrid.llm.suffix_dedup import suffix_array
    r = np.random.default_rng(5)
    for alphabet in (1, 2, 5, 200):
        t = np.concatenate([np.append(r.integers(1, alphabet + 1, n), 0) for n in (1, 3, 50, 200, 200)])
        order, _ = suffix_array(t, 300)
        assert sorted(order) == list(range(len(t)))
        ends = np.flatnonzero(t == 0)
        body = lambda i: tuple(t[i:ends[np.searchsorted(ends, i)] + 1])  # noqa: B023, E731
        assert [body(i) for i in order] == sorted(body(i) for i in range(len(t)))


@pytest.mark.parametrize("name", ["awkward", "given"])
def test_fingerprints(name, request):
    from parcelgrid.llm.fingerprints import edited_fingerprints, hexes, joined, signatures
    df = request.getfixturevalue(name)
    docs = texts_of(df)
    ids = sorted(docs, reverse=True)
    rows = {r["doc_id"]: r for r in edited_fingerprints(df).collect()}
    assert set(rows) == set(ids)
    sign = lambda t: hexes(signatures(*joined([t.encode()])))[0]
    like = lambda a, b: sum(a[i:i + 4] == b[i:i + 4] for i in range(0, len(a), 4)) / (len(a) // 4)
    for d, nxt in zip(ids, ids[1:] + ids[:1]):
        t, r = docs[d], rows[d]
        k = len(t) // 3
        edit = t[:len(t) - k] + docs[nxt][:k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edit.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (sign(t), sign(edit))
        assert (r["near_edited"], r["near_next"]) == (like(sign(t), sign(edit)), like(sign(t), sign(docs[nxt])))


def test_minhash_pairs_are_verified(given):
    from parcelgrid.llm.fingerprints import near_duplicates
    sets = {d: shingle_set(t) for d, t in texts_of(given).items()}
    pairs = {(r["a"], r["b"]) for r in near_duplicates(given).collect()}
    assert all(10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) for a, b in pairs)
    same = {frozenset(s): d for d, s in sorted(sets.items(), reverse=True) if s}
    assert all(same[frozenset(s)] == d or any(b == d for _, b in pairs) for d, s in sets.items() if s)


def minhash_family():
    """Variants of one text in groups: texts of a group are alike, texts of different groups share bands but are not."""
    r, docs = np.random.default_rng(12), {}
    base = [f"w{i}" for i in range(120)]
    for group in range(60):
        centre = list(base)
        for at in r.choice(12, 2, replace=False):
            centre[int(at) * 10 + int(r.integers(10))] = f"g{group}x{at}"
        for _ in range(3):
            w = list(centre)
            w[int(r.integers(len(w)))] = f"e{r.integers(1 << 40)}"
            docs[len(docs)] = " ".join(w)
    order = r.permutation(len(docs))
    return {int(order[d]): t for d, t in docs.items()}


def test_minhash_recall(spark):
    from parcelgrid.llm.fingerprints import near_duplicates
    docs = minhash_family()
    pairs = near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)).collect()
    parent = {d: d for d in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert {d: find(d) for d in docs} == {d: c for d, (_, c) in linked_by_brute_force(docs).items()}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_pii(t):
    from parcelgrid.llm.pii import luhn
    n = lambda s: sum(c.isdigit() for c in s)
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= n(m[0]) <= 19 and luhn("".join(c for c in m[0] if c.isdigit()))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= n(m[0]) <= 15]


@pytest.mark.parametrize("name", ["awkward", "given"])
def test_personal_data(name, request):
    from parcelgrid.llm import pii
    df = request.getfixturevalue(name)
    weights = pii.train(df)
    docs = texts_of(df)
    for r in pii.find(df, weights).collect():
        base = base_pii(docs[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(b[0] == k for b in base) for k in pii.BASE]
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["spans"].startswith(text)
    assert pii.redact(df, weights).filter("text like '%@mail%'").count() == 0


def test_personal_data_edges():
    from parcelgrid.llm import pii
    for t in ("a@b.c%d@e.f", "@a.b", "a@@b.c", "x@y", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "1" * 50 + ".1.1.1", "0" * 30 + "1.2.3.4", "+1 23 +44 20 7946 0958-",
              "4111-1111 1111 1111 4111111111111111", "a.b@c.d.e-", "é@b.co", "p@q.r@s.t"):
        assert [(k, *s) for k in pii.BASE for s in pii.base_spans(t)[k]] == base_pii(t), t
    pii.base_spans("a" * 300_000 + "@" + "1." * 100_000 + "7" * 100_000)
    secrets = [f"text {i} password={hashlib.md5(str(i).encode()).hexdigest()[:18]} more AKIA{hashlib.md5(str(i).encode()).hexdigest()[:16].upper()} end" for i in range(30)]
    counted, rows = Counter(), Counter()
    for t in secrets:
        for k, _, _, v, f in pii.candidates(t, pii.base_spans(t)):
            counted[k, v] += 1
            rows[k, v, f] += 1
    w = pii.classifier([(*k, n) for k, n in rows.items()], pii.reliabilities([(*k, n) for k, n in counted.items()]))
    assert all(len(pii.spans_of(t, w)[1]) == 2 for t in secrets)
    assert pii.spans_of("width=fullscreen and look at the dot in it", w)[1] == []
    key = hashlib.sha512(b"k").hexdigest() * 2  # 256 characters
    for text in (f"password: {key} end", f"token:\"{key}\"", f"secret = '{key}'"):
        at = text.index(key)
        assert ("secret", at, at + len(key)) in pii.spans_of(text, w)[1]
    assert [k for k, *_ in pii.candidates("ssn: 123-45-6789 and call: 555-123-4567", {})] == ["ssn", "local_phone"]


def test_redacting_keeps_rows(repeats):
    from parcelgrid.llm import pii
    more = repeats.union(repeats.filter("doc_id = 13"))
    out = pii.redact(more, pii.train(more))
    assert out.columns == more.columns and out.count() == more.count()
    kept = [r["text"] for r in out.filter("doc_id = 13").collect()]
    assert len(kept) == 2 and kept[0] == kept[1] and "[EMAIL]" in kept[0] and "[CARD]" in kept[0] and "a.b@c.de" not in kept[0]
    assert out.filter("text is null").count() == more.filter("text is null").count()


def noisy_or(model, docs, toxicity):
    """Scores of whole documents and of their sentences against a plain noisy-or over split texts."""
    from parcelgrid.llm.hashing import prefix_hash, span_hash
    weights = dict(zip(model.words.tolist(), model.weights.tolist()))

    def word_hash(w):
        data = np.frombuffer(lower(w).encode(), np.uint8)
        return int(span_hash(prefix_hash(data), np.array([0]), np.array([len(data)]))[0])

    rows = sorted(toxicity.score(docs, model).collect(), key=lambda r: (r["doc_id"], r["score"]))
    texts = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: r[0])
    for r, (d, t) in zip(rows, texts):
        parts = [p for p in re.split(r"[\n!.?]", t) if re.search(r"[0-9A-Za-z\x80-\U0010ffff]", p)]
        odds = [model.bias + sum(weights.get(word_hash(w), 0.0) for w in {lower(w) for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", p)}) for p in parts]
        p = [1 / (1 + math.exp(-z)) for z in odds] or [1 / (1 + math.exp(-model.bias))]
        assert r["doc_id"] == d and abs(r["score"] - (1 - math.prod(1 - x for x in p))) < 1e-9
        assert r["n_offending"] == sum(x >= 0.5 for x in p if odds) and (r["worst_score"] is None) == (not odds)
        if odds:
            worst = t.encode()[r["worst_start"]:r["worst_end"]].decode("utf-8", "replace")
            assert abs(r["worst_score"] - max(p)) < 1e-9 and re.search(r"[0-9A-Za-z\x80-\U0010ffff].*", parts[p.index(max(p))], re.S)[0][:20] in worst


def test_toxicity(spark, given, awkward, empty):
    from parcelgrid.llm import toxicity
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels)
    rows = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [(rows[d]["score"], y) for d, y in truth.items() if rows[d]["held_out"]]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.75, auc
    noisy_or(model, docs.limit(300), toxicity)
    noisy_or(model, awkward, toxicity)
    spans = toxicity.offending(docs, model).collect()
    assert spans and all(0 <= s["start"] < s["end"] for s in spans)
    bad = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0), (99, 1)], "doc_id long, toxic int")
    assert toxicity.score(awkward, toxicity.train(awkward, bad)).count() == len(AWKWARD)
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(awkward, model).collect())
    assert toxicity.flagged(awkward, model).columns == awkward.columns


@pytest.mark.parametrize("name", ["awkward", "given", "repeats", "empty"])
def test_shards(name, request):
    from parcelgrid.llm.sharding import shard
    df = request.getfixturevalue(name)
    rows, docs = shard(df).collect(), df.collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (d["doc_id"], len((d["text"] or "").encode()) + 1, zlib.crc32((d["text"] or "").encode())) for d in docs)
    slots = defaultdict(list)
    for r in rows:
        assert r["law"] == "rows" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(k, [])) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1
    again = {(r["doc_id"], r["text_crc32"]): (r["shard"], r["slot"]) for r in shard(df.repartition(2)).collect()}
    if name in ("awkward", "given"):
        assert again == {(r["doc_id"], r["text_crc32"]): (r["shard"], r["slot"]) for r in rows}


def shingle_set(t):
    w = WORD.findall(lower(t))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def linked_by_brute_force(docs):
    sets, parent = {d: shingle_set(t) for d, t in docs.items()}, {d: d for d in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in docs}


@pytest.mark.parametrize("name", ["awkward", "given", "empty"])
def test_parity_join(name, request):
    from parcelgrid.llm.parity_join import join
    df = request.getfixturevalue(name)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in join(df).collect()} == linked_by_brute_force(texts_of(df))


def test_parity_join_at_the_threshold(spark):
    from parcelgrid.llm.parity_join import join
    r, docs = np.random.default_rng(4), {}
    for family in range(30):
        n = int(r.choice([5, 8, 20, 60, 64, 70, 255, 260]))
        base = [f"f{family}w{i}" for i in range(n)]
        for _ in range(5):
            w = list(base)
            for _ in range(int(r.integers(0, 2 + n // 50))):
                w[int(r.integers(len(w)))] = f"e{r.integers(1 << 40)}"
            w += [f"t{r.integers(1 << 40)}" for _ in range(int(r.integers(0, n // 5 + 1)))]
            docs[len(docs)] = " ".join(w)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in join(df).collect()} == linked_by_brute_force(docs)


def test_repeated_and_null_ids(repeats):
    """Defined results for rows that share an id or have none."""
    import public_tokenizers

    from parcelgrid.llm import decontamination, fingerprints, packing, parity_join, pii, suffix_dedup, suffix_lm
    n = repeats.count()
    assert packing.pack(repeats, public_tokenizers.path("byte_bpe_50k.json")).filter("piece = 0").count() == n
    assert suffix_lm.score(repeats).count() == n
    assert decontamination.decontaminate(repeats, repeats.selectExpr("doc_id as item_id", "text")).count() == n
    assert fingerprints.edited_fingerprints(repeats).count() == n
    assert pii.find(repeats, pii.train(repeats)).count() == n
    joined = parity_join.join(repeats).collect()
    assert len(joined) == n and all((r["component_id"] is None) == (r["doc_id"] is None) for r in joined)
    dedup = suffix_dedup.deduplicate(repeats).collect()
    assert len(dedup) == n
    null = [r for r in dedup if r["doc_id"] is None and r["n_bytes"]]
    assert len(null) == 1 and null[0]["n_removed"] == 0  # null ids come first, so their text is the earliest
    assert {r["n_removed"] for r in dedup if r["doc_id"] == 1} == {len(BASE)}


def test_empty_tables(empty):
    import public_tokenizers

    from parcelgrid.llm import decontamination, fingerprints, packing, pii, suffix_dedup, suffix_lm, toxicity
    labels = empty.selectExpr("doc_id", "n as toxic")
    assert packing.pack(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert suffix_lm.score(empty).count() == 0
    assert decontamination.decontaminate(empty, empty.selectExpr("doc_id as item_id", "text")).count() == 0
    assert fingerprints.edited_fingerprints(empty).count() == 0 and fingerprints.near_duplicates(empty).count() == 0
    assert pii.find(empty, pii.train(empty)).count() == 0
    assert suffix_dedup.deduplicate(empty).count() == 0
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as cp
    docs = frame(spark, AWKWARD, extra=False)
    kept = cp.drop_near_duplicates(spark, docs, SF)
    want = linked_by_brute_force(texts_of(docs))
    assert {r["doc_id"] for r in kept.collect()} == {d for d, (_, c) in want.items() if c == d}
    real = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        real = spark.createDataFrame(stage(spark, real, SF).collect(), real.schema)
        assert tuple(real.columns) == cp.COLUMNS
    assert 0 < real.count() <= 200
    assert {r["doc_id"] for r in cp.STAGES[-1][1](spark, real, SF).select("doc_id").collect()} == {r["doc_id"] for r in real.collect()}


def test_pipeline_decides_by_row(spark, repeats, tmp_path):
    import corpus_pipeline as cp
    rows = [(i, r["doc_id"], r["text"]) for i, r in enumerate(repeats.collect())]
    docs = repeats.select(*cp.COLUMNS)
    group, want = linked_by_brute_force({i: t or "" for i, _, t in rows}), {}
    for i, d, t in rows:
        c = group[i][1]
        want[c] = min(want.get(c, (True, 0, "")), (d is None, d or 0, t or ""))
    kept = Counter((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in cp.drop_near_duplicates(spark, docs, SF).collect())
    assert kept == Counter(want.values())
    spark.createDataFrame([(1, "other text under one id"), (2, BASE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    more = docs.union(frame(spark, [(None, "clean text without an id", "en", "a")], extra=False))
    windows = [NON.findall(lower(BASE))[k:k + 10] for k in range(171)] + [["other", "text", "under", "one", "id"]]
    hit = lambda t: any(" " + " ".join(w) + " " in " " + " ".join(NON.findall(lower(t or ""))) + " " for w in windows)
    texts = [(d, t) for _, d, t in rows] + [(None, "clean text without an id")]
    got = Counter((r["doc_id"], r["text"]) for r in cp.drop_contaminated(spark, more, str(tmp_path)).collect())
    assert got == Counter(x for x in texts if not hit(x[1])) and (3, BASE.replace("word3 ", "other ")) not in got
    assert got[None, None] == 1 and got[None, "clean text without an id"] == 1 and (None, BASE) not in got
