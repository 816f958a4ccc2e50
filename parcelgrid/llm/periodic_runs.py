"""Periodic runs of words: stretches in which the words repeat with a period, at least `times` periods long.

Longest common extensions of any two places come from two suffix trees, one of the document's words and one of their
reversal, both built by Ukkonen's algorithm; an Euler tour over the tree turns the lowest common ancestor of two leaves
into a minimum over a range, which a sparse table answers in constant time.  Each run holds a Lyndon word as its root under one
of two opposite orders of the words, and that root is the longest Lyndon word at its place; it ends where the next smaller
(or greater) suffix begins.  Each such root is extended in both directions.

A word of a run of `times` periods occurs `times` times or more within the run.  So words that are rarer in their
stretch belong to no run and only separate: a tree holds the stretches between them, each with a separator of its own.
"""
from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelgrid.llm.common import bytes_of

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def suffix_tree(s: list[int]) -> tuple[list[dict[int, int]], list[int], list[int]]:
    """Ukkonen's tree of a list that ends with a symbol found nowhere else.

    Returns the children of each inner node by first symbol, and where the edge into each inner node begins and ends.
    Leaf i, the suffix from i on, is written ~i.
    """
    kids: list[dict[int, int]] = [{}]
    begin, end, link, tail = [0], [0], [0], []
    node = edge = length = pending = 0
    for i, symbol in enumerate(s):
        above = 0
        pending += 1
        while pending:
            if not length:
                edge = i
            down = kids[node]
            child = down.get(s[edge])
            if child is None:
                down[symbol] = ~len(tail)
                tail.append(i)
                if above:
                    link[above] = node
                    above = 0
            else:
                if child >= 0:
                    span = end[child] - begin[child]
                    if length >= span:
                        edge += span
                        length -= span
                        node = child
                        continue
                    at = begin[child] + length
                else:
                    at = tail[~child] + length
                if s[at] == symbol:
                    length += 1
                    if above:
                        link[above] = node
                    break
                middle = len(kids)
                kids.append({s[at]: child, symbol: ~len(tail)})
                begin.append(at - length)
                end.append(at)
                link.append(0)
                down[s[edge]] = middle
                if child >= 0:
                    begin[child] = at
                else:
                    tail[~child] = at
                tail.append(i)
                if above:
                    link[above] = middle
                above = middle
            pending -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - pending + 1
    return kids, begin, end


class Extensions:
    """Constant-time longest common prefixes of the suffixes of a list."""

    def __init__(self, s: list[int]):
        kids, begin, end = suffix_tree(s)
        leaves, turns = [], []  # the Euler tour, kept to its leaves and the inner node where it turns before each
        stack, depths, turn = [0], [~0], 0  # ~depth marks a first child: the tour does not turn before it
        while stack:
            node, depth = stack.pop(), depths.pop()
            if depth < 0:
                depth = ~depth
            else:
                turn = depth
            if node < 0:
                leaves.append(~node)
                turns.append(turn)
                continue
            below = depth + end[node] - begin[node]
            down = kids[node]
            order = sorted(down, reverse=True)
            stack += [down[c] for c in order]
            depths += [below] * len(order)
            depths[-1] = ~below
        m = len(leaves)
        self.rank = np.empty(m, np.int64)
        self.rank[leaves] = np.arange(m)
        self.table = [np.array(turns, np.int32)]
        step = 1
        while 2 * step <= m:
            last = self.table[-1]
            self.table.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes i and j, for i <> j."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << int(k))])
        return out


def lyndon_ends(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the longest Lyndon word from each place ends, under the order of the ranks and under its opposite."""
    m = len(rank)
    r = rank.tolist()
    smaller, greater = [m] * m, [m] * m
    down, up = [], []
    for i in range(m):
        x = r[i]
        while down and r[down[-1]] > x:
            smaller[down.pop()] = i
        down.append(i)
        while up and r[up[-1]] < x:
            greater[up.pop()] = i
        up.append(i)
    return np.array(smaller, np.int64), np.array(greater, np.int64)


def stretches(codes: np.ndarray, least: int, times: int) -> np.ndarray:
    """Places of all words that may belong to a run: stretches of `least` words or more in which each word occurs `times` times."""
    at = np.flatnonzero(np.bincount(codes)[codes] >= times)
    while len(at):
        first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        size = np.diff(np.append(first, len(at)))
        part = np.repeat(np.arange(len(first)), size)
        long = size[part] >= least
        at, part = at[long], part[long]
        if not len(at):
            break
        _, which, n = np.unique(part * (int(codes.max()) + 1) + codes[at], return_inverse=True, return_counts=True)
        keep = n[which] >= times
        if keep.all():
            break
        at = at[keep]
    return at


def runs_of(codes: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """Rows (start, length, period) of all runs of at least `least` words and `times` periods, by start, then period."""
    at = stretches(codes, least, times)
    if not len(at):
        return np.zeros((0, 3), np.int64)
    gaps = np.flatnonzero(np.diff(at) != 1) + 1
    symbols = np.unique(codes[at], return_inverse=True)[1]
    own = int(symbols.max()) + 1  # each stretch is followed by a symbol of its own
    s = np.insert(symbols, np.append(gaps, len(at)), own + np.arange(len(gaps) + 1)).tolist()
    place = np.insert(at, np.append(gaps, len(at)), -1)
    m = len(s)
    ahead = Extensions(s)
    starts, periods = [], []
    for ends in lyndon_ends(ahead.rank):
        i = np.flatnonzero((ends < m) & (times * (ends - np.arange(m)) <= m))
        starts.append(i)
        periods.append(ends[i] - i)
    i, p = np.concatenate(starts), np.concatenate(periods)
    right = ahead.common(i, i + p)
    del ahead
    behind = Extensions(s[-2::-1] + [own + len(gaps) + 1])
    left = np.zeros(len(i), np.int64)
    inner = np.flatnonzero(i > 0)
    left[inner] = behind.common(m - 1 - i[inner], m - 1 - i[inner] - p[inner])
    length = left + p + right
    keep = (length >= least) & (length >= times * p)
    return np.unique(np.stack([place[(i - left)[keep]], length[keep], p[keep]], axis=1)[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def kept_words(n: int, found: np.ndarray) -> np.ndarray:
    """Whether each of n words stays when every run is cut to its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def looped(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Every tenth document by the checksum of its id gets a tail that repeats with a period; the others are left as they are."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def collapse(docs: DataFrame, least: int = 6, times: int = 4,
             edit: Callable[[list[bytes], int | None], list[bytes]] | None = None) -> DataFrame:
    """doc_id, runs (start, length, period in words, by start, then period) and the text without repetitions, for each row.

    Words are separated by ASCII white space and compared as bytes; in the text that is left they are joined by one space.
    `edit` changes the words of a document beforehand.  Null and empty texts have no words, no runs and an empty text; rows with
    equal or null ids are rows of their own; other columns of `docs` are not looked at.  A task holds one document at a time.
    """
    def run(batches):
        for batch in batches:
            ids, found, texts = batch.column("doc_id").to_pylist(), [], []
            for doc_id, text in zip(ids, batch.column("text")):
                words = text.as_py().split()
                if edit is not None:
                    words = edit(words, doc_id)
                number = defaultdict(count().__next__)
                codes = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                rows = runs_of(codes, least, times) if len(words) >= least else np.zeros((0, 3), np.int64)
                if len(rows):
                    words = [words[k] for k in np.flatnonzero(kept_words(len(words), rows))]
                found.append(rows)
                texts.append(b" ".join(words))
            flat = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            struct = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(RUN))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), struct),
                                              pa.array(texts, pa.binary())], names=["doc_id", "runs", "text"])

    return (docs.select(F.col("doc_id").cast("long"), bytes_of().alias("text"))
            .mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, text binary"))


def digests(collapsed: DataFrame) -> DataFrame:
    """The longest run of each row (ties: smallest start, then period) and checksums of all its runs and of its text."""
    one = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    return (collapsed.withColumn("top", one)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"),
                    (-F.col("top.period")).alias("period"),
                    F.floor(1000 * F.col("top.length") / -F.col("top.period")).cast("long").alias("exponent_milli"),
                    F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256")))
