"""Toxicity by multiple-instance learning: document labels train a sentence scorer through a noisy-or."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelgrid.llm.common import bytes_of
from parcelgrid.llm.hashing import LOWER, U, binary, blocks, prefix_hash, span_hash

WORD = np.zeros(256, dtype=bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
STOP = np.zeros(256, dtype=bool)
STOP[[10, 33, 46, 63]] = True


@dataclass
class Model:
    """Log-odds of a sentence: bias plus the weights of its distinct words (sorted hashes)."""
    words: np.ndarray
    weights: np.ndarray
    bias: float


def sentence_words(data: np.ndarray, bounds: np.ndarray):
    """Word hashes with their byte spans, each one's sentence (numbered over the block), and each document's sentences.

    Sentences end at . ! ? or a line break; those without words do not count, a document without any counts as one.
    """
    if not len(data):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.ones(len(bounds) - 1, np.int64)
    low = LOWER[data]
    inside = WORD[low]
    edge = np.zeros(len(low) + 1, dtype=bool)
    edge[bounds] = True
    start = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:-1]))
    end = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])) + 1
    hashes = span_hash(prefix_hash(low), start, end)
    doc = np.searchsorted(bounds, start, side="right") - 1
    stops = np.cumsum(STOP[low])[start] if len(start) else start
    new = np.ones(len(start), dtype=bool)
    new[1:] = (stops[1:] != stops[:-1]) | (doc[1:] != doc[:-1])
    sentence = np.cumsum(new) - 1
    per_doc = np.bincount(doc[new], minlength=len(bounds) - 1)
    return hashes, start, sentence, doc, np.maximum(per_doc, 1)


def softplus(z):
    return np.logaddexp(0.0, z)


def sentence_scores(model: Model, hashes, sentence, n: int) -> np.ndarray:
    z = np.full(n, model.bias)
    if len(model.words) and len(hashes):
        at = np.minimum(np.searchsorted(model.words, hashes), len(model.words) - 1)
        hit = model.words[at] == hashes
        key = np.unique(sentence[hit] * len(model.words) + at[hit])
        np.add.at(z, key // len(model.words), model.weights[key % len(model.words)])
    return z


def document_scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Noisy-or of the sentences of each document."""
    return located(model, data, offsets)[0]


def located(model: Model, data: np.ndarray, offsets: np.ndarray, least: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Score of each document, its number of sentences that score `least` or more by themselves, and of the sentence that scores
    highest (the first of equals) the bytes it spans, first word to the next sentence, and its score; -1 without words."""
    n_docs = len(offsets) - 1
    out, many, start_, end_, top = np.zeros(n_docs), np.zeros(n_docs, np.int64), np.full(n_docs, -1), np.full(n_docs, -1), np.full(n_docs, -1.0)
    for i, j, part, bounds in blocks(data, offsets):
        hashes, start, sentence, doc, _ = sentence_words(part, bounds)
        n = int(sentence[-1]) + 1 if len(sentence) else 0
        raw = sentence_scores(model, hashes, sentence, n)
        z, p = softplus(raw), 1 / (1 + np.exp(-raw))
        first = np.concatenate([[0], np.flatnonzero(sentence[1:] != sentence[:-1]) + 1]) if n else np.zeros(0, np.int64)
        of = doc[first] if n else np.zeros(0, np.int64)
        total, worded = np.bincount(of, weights=z, minlength=j - i), np.bincount(of, minlength=j - i) > 0
        total[~worded] = softplus(model.bias)
        out[i:j] = -np.expm1(-total)
        many[i:j] = np.bincount(of[p >= least], minlength=j - i)
        best = np.lexsort((first, -raw, of))
        best = best[np.concatenate([[True], of[best][1:] != of[best][:-1]])] if n else best
        ends = np.minimum(np.append(start[first[1:]], len(part)) if n else first, bounds[of + 1])
        start_[i + of[best]], end_[i + of[best]], top[i + of[best]] = start[first[best]] - bounds[of[best]], ends[best] - bounds[of[best]], p[best]
    return out, many, start_, end_, top


def fit(bags: list[tuple[int, np.ndarray, np.ndarray]], weight: tuple[float, float], rounds: int = 300, least_df: int = 5,
        least_z: float = 4.0, most: int = 4000, decay: float = 2e-4) -> Model:
    """`bags`: (label, word hashes, sentence numbers) of each document; `weight`: what a document of either label stands for."""
    if not bags:
        return Model(np.zeros(0, U), np.zeros(0), -10.0)
    label = np.array([b[0] for b in bags])
    doc = np.repeat(np.arange(len(bags)), [len(b[1]) for b in bags])
    word = np.concatenate([b[1] for b in bags])
    n_sent = np.array([max(1, len(np.unique(b[2]))) for b in bags])
    sent = np.concatenate([np.unique(b[2], return_inverse=True)[1] + o if len(b[2]) else b[2]
                           for b, o in zip(bags, np.concatenate([[0], np.cumsum(n_sent)[:-1]]))]).astype(np.int64)
    vocabulary, index = np.unique(word, return_inverse=True)
    seen = np.unique(index.astype(np.int64) * len(bags) + doc)
    pos, neg = max(1, int((label == 1).sum())), max(1, int((label == 0).sum()))
    one = np.bincount(seen // len(bags), weights=label[seen % len(bags)] == 1, minlength=len(vocabulary))
    df = np.bincount(seen // len(bags), minlength=len(vocabulary))
    p1, p0 = (one + 0.5) / (pos + 1), (df - one + 0.5) / (neg + 1)
    z = (p1 - p0) / np.sqrt(p1 * (1 - p1) / pos + p0 * (1 - p0) / neg)
    chosen = np.flatnonzero((df >= least_df) & (np.abs(z) >= least_z))
    chosen = np.sort(chosen[np.argsort(-np.abs(z[chosen]), kind="stable")[:most]])
    place = np.full(len(vocabulary), -1)
    place[chosen] = np.arange(len(chosen))
    at = place[index]
    pairs = np.unique(sent[at >= 0] * max(1, len(chosen)) + at[at >= 0])
    row, col = pairs // max(1, len(chosen)), pairs % max(1, len(chosen))
    of_doc = np.repeat(np.arange(len(bags)), n_sent)
    w = np.log(p1 / p0)[chosen] * 0.5
    prior = weight[1] * pos / (weight[1] * pos + weight[0] * neg)
    bias = np.log(max(prior, 1e-6) / max(1.0, n_sent.mean()))
    share = np.where(label == 1, weight[1], weight[0])
    share = share / share.sum()
    theta = np.concatenate([w, [bias]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        zs = theta[-1] + np.bincount(row, weights=theta[col], minlength=len(of_doc))
        total = np.bincount(of_doc, weights=softplus(zs), minlength=len(bags)) + 1e-9
        slope = np.where(label == 1, -1 / np.expm1(np.minimum(total, 50)), 1.0) * share
        g = slope[of_doc] / (1 + np.exp(-zs))
        grad = np.concatenate([np.bincount(col, weights=g[row], minlength=len(chosen)) + decay * theta[:-1] / max(1, len(chosen)) ** 0.5,
                               [g.sum()]])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta - 0.08 * (0.01 ** (t / rounds)) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9)
    return Model(vocabulary[chosen], theta[:-1], float(theta[-1]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000) -> Model:
    """Fits on at most `per_class` labelled documents of either label, those of the least hashed id, none of them held out.

    Class totals over all labelled rows set the weights, so scores keep the corpus' own rate.  Null labels and ids are
    left out; an id labelled twice counts once, with its greatest label.
    """
    usable = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")))
    totals = dict(usable.groupBy("toxic").count().collect())
    spark = docs.sparkSession
    ids = [tuple(r) for y in (0, 1) for r in
           usable.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    sample = spark.createDataFrame(ids, "doc_id long, toxic int")

    def bag(batches):
        for batch in batches:
            rows = []
            for y, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                data = np.frombuffer(text, dtype=np.uint8)
                hashes, _, sentence, _, _ = sentence_words(data, np.array([0, len(data)]))
                _, first = np.unique(np.stack([sentence.astype(U), hashes]), axis=1, return_index=True) if len(hashes) else (0, np.zeros(0, int))
                rows.append((y, hashes[first].tobytes(), sentence[first].astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()),
                                              pa.array([r[2] for r in rows], pa.binary())], names=["toxic", "words", "sentences"])

    found = (docs.select("doc_id", bytes_of().alias("text")).join(F.broadcast(sample), "doc_id").select("toxic", "text")
             .mapInArrow(bag, "toxic int, words binary, sentences binary").collect())
    bags = [(r["toxic"], np.frombuffer(r["words"], dtype=U), np.frombuffer(r["sentences"], dtype=np.int32)) for r in found]
    count = {y: max(1, sum(b[0] == y for b in bags)) for y in (0, 1)}
    return fit(bags, (totals.get(0, 0) / count[0], totals.get(1, 0) / count[1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, and where: the number of sentences that score at least 0.5 by themselves,
    and start and end (bytes) and score of the one that scores highest.

    Null and empty texts score as one sentence without known words, and have no such span; rows with equal or null ids are
    rows of their own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            out, many, start, end, top = located(shared.value, *binary(batch.column("text")))
            none = start < 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out), pa.array(many), pa.array(start, mask=none), pa.array(end, mask=none), pa.array(top, mask=none)],
                                             names=["doc_id", "score", "n_offending", "worst_start", "worst_end", "worst_score"])

    return (docs.select(F.col("doc_id").cast("long"), bytes_of().alias("text"))
            .mapInArrow(run, "doc_id long, score double, n_offending long, worst_start long, worst_end long, worst_score double")
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                    "n_offending", "worst_start", "worst_end", "worst_score"))


def flagged(docs: DataFrame, model: Model, keep_flagged: bool = False) -> DataFrame:
    """Rows of `docs` with all their columns whose score is below 0.5 (or, with `keep_flagged`, at least 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(text):
        texts = [bytes(t) for t in text]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        import pandas as pd
        return pd.Series(document_scores(shared.value, np.frombuffer(b"".join(texts), dtype=np.uint8), offsets))

    s = rate(bytes_of())
    return docs.filter(s >= 0.5 if keep_flagged else s < 0.5)


def offending(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, start, end, score): byte spans, first word to last, of sentences that score `least` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            ids, out = batch.column("doc_id").to_pylist(), []
            data, offsets = binary(batch.column("text"))
            for i, j, part, bounds in blocks(data, offsets):
                hashes, start, sentence, doc, _ = sentence_words(part, bounds)
                if not len(sentence):
                    continue
                first = np.concatenate([[0], np.flatnonzero(sentence[1:] != sentence[:-1]) + 1])
                ends = np.concatenate([start[first[1:]], bounds[doc[-1] + 1:doc[-1] + 2]])
                p = 1 / (1 + np.exp(-sentence_scores(shared.value, hashes, sentence, len(first))))
                for k in np.flatnonzero(p >= least):
                    d = doc[first[k]]
                    out.append((ids[i + d], int(start[first[k]] - bounds[d]), int(min(ends[k], bounds[d + 1]) - bounds[d]), float(p[k])))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in
                                              enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))],
                                             names=["doc_id", "start", "end", "score"])

    return (docs.select(F.col("doc_id").cast("long"), bytes_of().alias("text"))
            .mapInArrow(run, "doc_id long, start long, end long, score double"))
