"""Packing documents into sequences by linear grouping.

Only the histogram of piece lengths reaches the driver (at most `capacity` rows, whatever the input).  Large lengths are
rounded up within groups of equal cardinality, the few rounded sizes are packed by a linear program over configurations
(column generation), actual documents take the places of rounded ones, and all that is left is put by best fit, longest
first, into the space that real lengths leave.  The plan is a list of runs: documents of one length, by rank, go to
consecutive sequences at one offset.
"""
from __future__ import annotations

import base64
import zlib
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelgrid.llm.common import bytes_of, save

CAPACITY = 2048
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64()), ("part", pa.int32()), ("local_rank", pa.int64())])
_encoders: dict[str, object] = {}


def encoder(json_path: str):
    """Ids of a text by the vocabulary of `json_path`.

    The byte-level ranks file beside it holds the same vocabulary and splits four times as fast; texts that contain a
    special token's string, or stretches without white space that are long enough to matter, go through the JSON one.
    """
    if json_path not in _encoders:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        full = Tokenizer.from_file(json_path)
        with open(json_path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        special = [t.content for t in full.get_added_tokens_decoder().values()]

        def encode(text: str) -> list[int]:
            if any(s in text for s in special):
                return full.encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        _encoders[json_path] = encode
    return _encoders[json_path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of `n` tokens; all but the first are full."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, json_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenised pieces without their ids, and each piece's rank among those of its length within its partition."""
    def tokenise(batches):
        encode, seen, part = encoder(json_path), np.zeros(capacity + 1, dtype=np.int64), TaskContext.get().partitionId()
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for doc, text in zip(ids, batch.column("text")):
                tokens = np.array([*encode(text.as_py().decode("utf-8", "replace")), 0], dtype="<u4")
                for k, (s, n) in enumerate(cut(len(tokens), capacity)):
                    rows.append((doc, k, s, n, zlib.crc32(tokens[s:s + n].tobytes()), part, int(seen[n])))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 7, PIECES)],
                                             schema=PIECES)

    return (docs.select(F.col("doc_id").cast("long"), bytes_of().alias("text"))
            .mapInArrow(tokenise, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"))


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within capacity of the greatest worth."""
    value, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)  # the best of what is within each capacity
    for i in np.flatnonzero(worth > 1e-9):
        size = int(sizes[i])
        for _ in range(capacity // size):
            gain = value[:-size] + worth[i]
            better = gain > value[size:] + 1e-12
            if not better.any():
                break
            value[size:] = np.where(better, gain, value[size:])
            pick[size:][better] = i
    out, c = np.zeros(len(sizes)), capacity
    while pick[c] >= 0:
        out[pick[c]] += 1
        c -= int(sizes[pick[c]])
    return float(worth @ out), out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, steps: int = 1500) -> list[tuple[np.ndarray, int]]:
    """Configurations of few sizes and how often each is used: the linear program's optimum, rounded down."""
    k = len(sizes)
    columns = np.diag(np.maximum(1, capacity // sizes)).astype(float)
    inverse = np.linalg.inv(columns)
    amount = inverse @ demand
    for step in range(steps):
        worth, configuration = best_configuration(sizes, np.maximum(inverse.sum(axis=0), 0), capacity)
        if worth <= 1 + 1e-3:
            break
        change = inverse @ configuration
        ratio = np.where(change > 1e-9, amount / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratio.argmin())
        columns[:, out] = configuration
        if step % 40 == 39:
            inverse = np.linalg.inv(columns)
            amount = np.maximum(inverse @ demand, 0)
            continue
        theta = ratio[out]
        amount = np.maximum(amount - theta * change, 0)
        amount[out] = theta
        row = inverse[out] / change[out]
        inverse = inverse - np.outer(change, row)
        inverse[out] = row
    return [(columns[:, i].astype(int), int(amount[i] + 1e-6)) for i in range(k) if amount[i] + 1e-6 >= 1]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 64, small: int = 128) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, count, first sequence, offset) that place every piece, and the number of sequences."""
    rank, runs, sequences = defaultdict(int), [], 0
    spare: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free space -> (first sequence, count)

    def put(length: int, count: int, sequence: int, offset: int) -> None:
        runs.append((length, rank[length], count, sequence, offset))
        rank[length] += count

    left = {n: c for n, c in histogram.items() if c}
    if capacity in left:
        put(capacity, left[capacity], 0, 0)
        sequences = left.pop(capacity)
    large = sorted((n for n in left if n > small), reverse=True)
    total = sum(left[n] for n in large)
    if total:
        per, queues, sizes, demand, room = -(-total // groups), [], [], [], 0
        for n in large:  # groups of equal cardinality, longest first; each is rounded up to its first length
            count = left[n]
            while count:
                if not room:
                    if not sizes or sizes[-1] != n:
                        queues.append(deque())
                        sizes.append(n)
                        demand.append(0)
                    room = per
                take = min(room, count)
                queues[-1].append([n, take])
                demand[-1] += take
                room -= take
                count -= take
        for configuration, times in configurations(np.array(sizes), np.array(demand, dtype=float), capacity):
            slots = [q for q in np.flatnonzero(configuration) for _ in range(configuration[q])]
            while times:
                lengths, here = [], times
                # the slots' next lengths hold for as many sequences as the shortest supply allows
                need = {q: slots.count(q) for q in set(slots)}
                for q in need:
                    n, c = queues[q][0]
                    if c >= need[q]:
                        here = min(here, c // need[q])
                    else:
                        here = 1
                at, used = sequences, 0
                for q in slots:
                    if here == 1:
                        while queues[q][0][1] == 0:
                            queues[q].popleft()
                    n = queues[q][0][0]
                    put(n, here, at, used)
                    queues[q][0][1] -= here
                    if queues[q][0][1] == 0:
                        queues[q].popleft()
                    used += n
                    lengths.append(n)
                spare[capacity - used].append((at, here))
                sequences += here
                times -= here
        left = {n: c for n, c in left.items() if n <= small}
        for q in queues:
            for n, c in q:
                left[n] = left.get(n, 0) + c
    for n in sorted(left, reverse=True):  # best fit: the least space that is enough
        count = left[n]
        while count:
            fit = min((s for s in spare if s >= n and spare[s]), default=None)
            if fit is None:
                opened = -(-count // (capacity // n))
                spare[capacity].append((sequences, opened))
                sequences += opened
                fit = capacity
            at, have = spare[fit].pop()
            take = min(have, count)
            put(n, take, at, capacity - fit)
            if have > take:
                spare[fit].append((at + take, have - take))
            spare[fit - n].append((at, take))
            count -= take
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 5), sequences


def pack(docs: DataFrame, json_path: str, capacity: int = CAPACITY, groups: int = 64) -> DataFrame:
    """A row for each piece with its sequence and offset.  `docs`: doc_id, text.

    Null and empty texts are the end token alone.  Repeated rows are packed each; extra columns are ignored; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    rows = save(pieces(docs, json_path, capacity), "pieces")
    counts = save(rows.groupBy("length", "part").agg(F.count("*").alias("n")), "piece_counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan(histogram, capacity, groups)
    before = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))
                           .alias("before"))
    shared = spark.sparkContext.broadcast(runs)

    def place(batches):
        table = shared.value
        keys = (table[:, 0] << 40) | table[:, 1]
        for batch in batches:
            col = {f: batch.column(f) for f in batch.schema.names}
            length, rank = col["length"].to_numpy(), col["local_rank"].to_numpy() + col["before"].to_numpy()
            at = np.searchsorted(keys, (length << 40) | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(col[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                 pa.array(table[at, 3] + rank - table[at, 1]), pa.array(table[at, 4])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return (rows.join(before, ["length", "part"])
            .select("doc_id", "piece", "start", "length", "ids_crc32", "local_rank", "before")
            .mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))
