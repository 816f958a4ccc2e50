"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark windows."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelgrid.llm.common import bytes_of

WINDOW = 10
#: Words are runs of ASCII letters, digits and all bytes from 0x80 on; A-Z becomes a-z and all else a space, byte by byte.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCHEMA = ("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
          "items array<string>, spans array<struct<start:long,end:long>>")
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
                 ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("items", pa.list_(pa.string())),
                 ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def windows(text: bytes, size: int = WINDOW) -> Iterator[bytes]:
    """A text's runs of `size` words; one run if it has fewer words, none if it has none."""
    w = text.translate(NORMAL).split()
    for i in range(max(1, len(w) - size + 1) if w else 0):
        yield b" " + b" ".join(w[i:i + size]) + b" "


def automaton(patterns: list[tuple[bytes, list[str], int]]):
    """`patterns`: (window, items, number of words)."""
    a = ahocorasick.Automaton()
    for text, items, n in patterns:
        a.add_word(text.decode("latin-1"), (items, n))
    a.make_automaton()
    return a


def scan(text: bytes, automata) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, merged runs of hit words [first, last), items found."""
    flat = text.translate(NORMAL)
    w = flat.split()
    line = (b" " + b" ".join(w) + b" ").decode("latin-1")
    hits, items = [], set()
    for a in automata:
        word, at = 0, 0
        for end, (ids, n) in a.iter(line) if len(a) else ():
            word += line.count(" ", at, end)  # the space at `end` closes the last word of the window
            at = end
            hits.append((word - n, word))
            items.update(ids)
    merged: list[tuple[int, int]] = []
    for s, e in sorted(hits):
        if merged and s <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    return len(w), merged, items


def original_spans(text: bytes, hit: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Hit words as code-point offsets of the original text; normalising keeps byte offsets."""
    flat, places, at = text.translate(NORMAL), [], 0
    for w in flat.split():
        at = flat.index(w, at)
        places.append((at, at + len(w)))
        at += len(w)
    chars = lambda b: len(text[:b].decode("utf-8", "replace"))
    return [(chars(places[s][0]), chars(places[e - 1][1])) for s, e in hit]


def spread(benchmark: DataFrame, size: int, block: int) -> list:
    """Broadcasts of the distinct windows of a benchmark with their items, at most `block` windows each."""
    spark = benchmark.sparkSession

    def cut(batches):
        for pdf in batches:
            rows = [(w, str(i), len(w.split())) for i, t in zip(pdf["item_id"], pdf["text"])
                    for w in set(windows(bytes(t), size))]
            yield pd.DataFrame(rows, columns=["window", "item", "n"])

    found = (benchmark.filter(F.col("item_id").isNotNull())
             .select(F.col("item_id").cast("string"), bytes_of().alias("text"))
             .mapInPandas(cut, "window binary, item string, n int").groupBy("window", "n")
             .agg(F.array_sort(F.collect_set("item")).alias("items")))
    shared, part = [], []
    for r in found.toLocalIterator():
        part.append((bytes(r["window"]), list(r["items"]), r["n"]))
        if len(part) == block:
            shared.append(spark.sparkContext.broadcast(part))
            part = []
    shared.append(spark.sparkContext.broadcast(part))
    return shared


def scanned(texts: list[bytes], shared: list, only):
    """`scan` of each text by `only`, or by the automata of `shared` where there are several."""
    return [scan(t, [only]) for t in texts] if only else _joined(texts, (automaton(s.value) for s in shared))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block: int = 200_000) -> DataFrame:
    """A row for each document: words, hit words, items with occurring windows, and hit spans of the original text.

    Null or wordless texts have no words and no hits; items without words or without id are left out; items and
    documents that repeat are treated alike.  Windows of the benchmark are distinct rows grouped by Spark; automata hold at
    most `block` windows each, so a larger benchmark is scanned for in several automata, one in memory at a time.
    """
    shared = spread(benchmark, size, block)

    def look(batches):
        only = automaton(shared[0].value) if len(shared) == 1 else None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            results = scanned(texts, shared, only)
            cols = [batch.column("doc_id"), *([] for _ in range(7))]
            for t, (n, hit, ids) in zip(texts, results):
                ids = sorted(ids)
                for c, v in zip(cols[1:], (n, sum(e - s for s, e in hit), len(ids),
                                           hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit), ids,
                                           [{"start": s, "end": e} for s, e in original_spans(t, hit)] if hit else [])):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c.cast(f.type)
                                              for c, f in zip(cols, OUT)], schema=OUT)

    return docs.select(F.col("doc_id").cast("long"), bytes_of().alias("text")).mapInArrow(look, SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block: int = 200_000) -> DataFrame:
    """Rows of `docs` with all their columns whose text has no window of the benchmark; each row is judged by its own text."""
    shared = spread(benchmark, size, block)

    @F.pandas_udf("boolean")
    def free(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        only = automaton(shared[0].value) if len(shared) == 1 else None
        for text in parts:
            yield pd.Series([not hit for _, hit, _ in scanned([bytes(t) for t in text], shared, only)], dtype=bool)

    return docs.filter(free(bytes_of()))


def _joined(texts, automata):
    """As `scan` of each text, with one automaton in memory at a time."""
    total = [[0, [], set()] for _ in texts]
    for a in automata:
        for x, t in zip(total, texts):
            n, hit, ids = scan(t, [a])
            x[0] = n
            x[1] += hit
            x[2] |= ids
    for x in total:
        merged = []
        for s, e in sorted(x[1]):
            if merged and s <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
            else:
                merged.append((s, e))
        x[1] = merged
    return total
