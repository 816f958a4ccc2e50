"""Repeated 100-byte strings by suffix arrays.

Every window of 100 bytes has an anchor: its k-byte string of the least hash, leftmost of equals.  Neighbouring windows with
one anchor form a piece.  Equal pieces hold equal windows, so all but the first are repeated.  Different pieces that share
an anchor meet again in one task, with their bytes, if they also agree on the bytes beside the anchor; there a suffix array
is built in two stages (suffixes smaller than their successors are sorted, the rest is induced by bucket scans) and windows
whose neighbours in it share 100 bytes are repeated.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelgrid.llm.common import bytes_of, save
from parcelgrid.llm.hashing import INVERSE, U, binary, blocks, mix, powers, prefix_hash, runs, span_hash
from parcelgrid.llm.sharding import numbered

LENGTH, ANCHOR = 100, 24
SIDE = (LENGTH - ANCHOR) // 2
BITS = 27
PLACE = 24  # bits of a position within a block


def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, by prefix and suffix minima of blocks of w."""
    n = len(x)
    pad = -n % w
    full = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    right = np.minimum.accumulate(full, axis=1).ravel()
    left = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[:n - w + 1], right[w - 1:n])


def pieces(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, k: int = ANCHOR):
    """(document, first window, number of windows, anchor's place, anchor hash, piece hash) of a block of texts."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, U, U))
    prefix = prefix_hash(data)
    at = np.arange(n - k + 1)
    grams = mix((prefix[k:] - prefix[:n - k + 1]) * powers(INVERSE, n + 1)[:n - k + 1])
    low = U((1 << PLACE) - 1)
    place = (sliding_minimum((grams & ~low) | at.astype(U), length - k + 1) & low).astype(np.int64)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    s = np.flatnonzero(np.arange(len(place)) + length <= ends[:len(place)])
    p = place[s]
    if not len(s):
        return pieces(data[:0], bounds)
    new = np.ones(len(s), dtype=bool)
    new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(s)))
    start, anchor = s[first], p[first]
    doc = np.searchsorted(bounds, start, side="right") - 1
    return doc, start, count, anchor, mix(grams[anchor] ^ U(0xA5A5)), span_hash(prefix, start, start + count - 1 + length)


def cuts(data: np.ndarray, offsets: np.ndarray, limit: int = 1 << 20, length: int = LENGTH):
    """Blocks of texts as (first document, bytes, bounds, start in its text); a long text comes in several blocks."""
    for i, j, part, bounds in blocks(data, offsets, limit):
        if j == i + 1 and len(part) > 4 * limit:
            for a in range(0, len(part) - length + 1, limit):
                piece = part[a:a + limit + length - 1]
                yield i, piece, np.array([0, len(piece)]), a
        else:
            yield i, part, bounds, 0


def suffix_array(t: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places of `t` in order of their suffixes (to `depth` characters at least), and 7-character keys of all places.

    `t`: characters from 1, texts ended by 0.  Order beyond a 0 is by place.
    """
    n = len(t)
    wide = np.concatenate([t.astype(U), np.zeros(depth + 14, U)])
    seven = np.zeros(n + depth + 7, dtype=U)
    for j in range(7):
        seven = (seven << U(9)) | wide[j:j + len(seven)]
    # smaller than the successor: decided where a run of equal characters ends
    change = np.flatnonzero(np.append(t[1:] != t[:-1], True))
    rises = np.zeros(n, dtype=bool)
    following = np.append(t, 0)[change + 1]
    rises[:] = np.repeat(t[change] < following, np.diff(np.append(-1, change)))
    direct = np.flatnonzero(rises & (t > 0))
    key = seven[direct]
    order = np.argsort(key, kind="stable")
    direct, key = direct[order], key[order]
    group = np.cumsum(np.append(True, key[1:] != key[:-1])) if len(direct) else np.zeros(0, np.int64)
    live = np.arange(len(direct))
    for d in range(7, depth + 7, 7):  # sort on only where equal so far
        g = group[live]
        same = np.zeros(len(live), dtype=bool)
        same[1:] = g[1:] == g[:-1]
        same[:-1] |= same[1:].copy()
        live = live[same]
        if not len(live):
            break
        g, places = group[live], direct[live]
        key = seven[places + d]
        order = np.lexsort((key, g))
        direct[live], key = places[order], key[order]
        fresh = np.append(True, (key[1:] != key[:-1]) | (g[1:] != g[:-1]))
        group[live] = np.cumsum(fresh)  # only equality of neighbours matters
    bounds = np.searchsorted(t[direct], np.arange(258))
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []
    for c in range(257):
        if c == 0:
            bucket = np.flatnonzero(t == 0)
        else:
            level = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
            levels = []
            while len(level):
                levels.append(level)
                level = level[level > 0] - 1
                level = level[t[level] == c]
            waiting[c] = []
            bucket = np.concatenate([*levels, direct[bounds[c]:bounds[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[t[before] > c]
        chars = t[before]
        order = np.argsort(chars, kind="stable")
        before, chars = before[order], chars[order]
        for a, b in zip(first := runs(chars), [*first[1:], len(chars)]):
            waiting[chars[a]].append(before[a:b])
    return np.concatenate(out) if out else np.zeros(0, np.int64), seven


def common(seven: np.ndarray, a: np.ndarray, b: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether places a and b share `length` characters."""
    same = np.ones(len(a), dtype=bool)
    for d in [*range(0, length - 7, 7), length - 7]:
        live = np.flatnonzero(same)
        same[live] = seven[a[live] + d] == seven[b[live] + d]
    return same


def repeated(texts: list[bytes], counts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(text, window) of windows that occur before; texts come in order, text i has counts[i] windows."""
    sizes = np.array([len(x) + 1 for x in texts])
    t = np.zeros(int(sizes.sum()), dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    body = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
    t[:] = body.astype(np.int64) + 1
    t[begin + sizes - 1] = 0
    order, seven = suffix_array(t, length)
    owner = np.repeat(np.arange(len(texts)), sizes)
    window = np.arange(len(t)) - begin[owner] < counts[owner]
    order = order[window[order]]
    if len(order) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.append(True, ~common(seven, order[1:], order[:-1], length))
    first = np.flatnonzero(new)
    earliest = np.minimum.reduceat(order, first)
    again = np.sort(order[order != np.repeat(earliest, np.diff(np.append(first, len(order))))])
    return owner[again], again - begin[owner[again]]


def batched(batches, limit: int):
    """Rows of whole routes, about `limit` bytes at a time; rows arrive sorted by (route, doc_id, start)."""
    held, size, route = [], 0, None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("route", "doc_id", "start", "n", "body"))):
            if row[0] != route and size >= limit:
                yield held
                held, size = [], 0
            route = row[0]
            held.append(row)
            size += len(row[4])
    if held:
        yield held


def unique_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(id, text) with ids that are distinct and keep the order of documents; where doc_id already is, nothing is dealt."""
    slim = docs.select(F.col("doc_id").cast("long"), bytes_of().alias("text"))
    ids = slim.select("doc_id")
    if ids.filter("doc_id is null").isEmpty() and ids.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return slim.withColumnRenamed("doc_id", "id"), None
    slim = slim.withColumn("h", F.sha2("text", 256))
    names = save(numbered(slim.select("doc_id", "h").distinct(), [F.col("doc_id").asc_nulls_first(), F.col("h")], "id"), "document_ids")
    joined = slim.dropDuplicates(["doc_id", "h"]).withColumnRenamed("doc_id", "d").withColumnRenamed("h", "g")
    cond = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("g") == F.col("h"))
    return joined.join(names, cond).select("id", "text"), slim.select("doc_id", "h").join(
        names.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "id"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))).select("doc_id", "id")


def spans(texts: DataFrame, heavy: int = 20_000) -> DataFrame:
    """(id, start, n): runs of windows of `texts` (id, text) that occur earlier.

    Routes with more than `heavy` pieces (one passage within very many different texts) are settled window by window with
    128-bit hashes, so that no group has to fit in a task.
    """
    spark = texts.sparkSession

    def anchors(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for i, part, bounds, shift in cuts(*binary(batch.column("text"))):
                doc, start, n, place, anchor, piece = pieces(part, bounds)
                at = (start - bounds[doc] + shift) * 65536 + n * 256 + (place - start)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(piece.view(np.int64)), pa.array(ids[i + doc]),
                                                  pa.array(at)], names=["anchor", "piece", "id", "at"])

    of_anchor = Window.partitionBy("anchor")
    turn = Window.partitionBy("anchor", "piece").orderBy("id", "at")
    marked = (texts.mapInArrow(anchors, "anchor long, piece long, id long, at long")
              .withColumn("p0", F.min("piece").over(of_anchor)).withColumn("p1", F.max("piece").over(of_anchor))
              .withColumn("rn", F.row_number().over(turn)).filter("rn > 1 or p0 < p1"))
    marks = save(marked.select((F.col("rn") > 1).alias("again"), F.when(F.col("rn") == 1, F.col("piece")).alias("piece"), "id", "at"), "anchors")
    open_ = marks.filter(~F.col("again"))
    filled = np.zeros((1 << BITS) // 8, dtype=np.uint8)
    place_bits = F.shiftleft("id", 64 - BITS).bitwiseXOR(F.shiftleft(F.shiftright("at", 16), 68 - BITS))
    slot = F.shiftrightunsigned(F.col("piece").bitwiseXOR(place_bits), 64 - BITS) + 1  # Spark counts bits from 1
    for r in (open_.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m")).toLocalIterator()):  # at most 2**BITS bits
        block = np.frombuffer(bytes(r["m"]), dtype=np.uint8)
        filled[(r["b"] - 1) * 4096:(r["b"] - 1) * 4096 + len(block)] = block
    shared = spark.sparkContext.broadcast(filled)

    def bodies(batches):
        """Bytes of first pieces (and of few others that fall on their bits) that share an anchor with a different piece, cut by the side on which the bytes beside it are compared."""
        marks_ = shared.value
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for i, part, bounds, shift in cuts(*binary(batch.column("text"))):
                doc, start, n, place, _, piece = pieces(part, bounds)
                where = (ids[i + doc].astype(U) << U(64 - BITS)) ^ ((start - bounds[doc] + shift).astype(U) << U(68 - BITS))
                s = ((piece ^ where) >> U(64 - BITS)).astype(np.int64)
                hit = np.flatnonzero((marks_[s >> 3] >> (s & 7).astype(np.uint8)) & 1)
                raw, rows = part.tobytes(), []
                for d, a, k, p in zip(doc[hit].tolist(), start[hit].tolist(), n[hit].tolist(), place[hit].tolist()):
                    middle = min(max(p - SIDE, a), a + k)  # windows from here on reach SIDE bytes beyond the anchor
                    for first, last, key in ((a, middle, (0, p - SIDE, p + ANCHOR)), (middle, a + k, (1, p, p + ANCHOR + SIDE))):
                        if first < last:
                            rows.append((xxhash.xxh64_intdigest(raw[key[1]:key[2]], seed=key[0]) - (1 << 63), int(ids[i + d]),
                                         int(first - bounds[d] + shift), last - first, raw[first:last - 1 + LENGTH]))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in
                                                  enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                                 names=["route", "id", "start", "n", "body"])

    met = (texts.mapInArrow(bodies, "route long, id long, start long, n long, body binary")
           .withColumn("members", F.count("*").over(Window.partitionBy("route"))).filter("members > 1"))
    met = save(met, "suffixes")

    def sort(batches):
        for rows in batched((b.rename_columns(["route", "doc_id", "start", "n", "body"]) for b in batches), 1 << 20):
            rows.sort(key=lambda r: (r[1], r[2]))
            owner, window = repeated([r[4] for r in rows], np.array([r[3] for r in rows]))
            first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (window[1:] != window[:-1] + 1))) if len(owner) else owner
            count = np.diff(np.append(first, len(owner)))
            yield pa.RecordBatch.from_arrays([pa.array([rows[o][1] for o in owner[first]], pa.int64()),
                                              pa.array([rows[o][2] + int(w) for o, w in zip(owner[first], window[first])], pa.int64()),
                                              pa.array(count, pa.int64())], names=["id", "start", "n"])

    def windows(batches):
        for batch in batches:
            rows = []
            for d, s, n, body in zip(*(batch.column(c).to_pylist() for c in ("id", "start", "n", "body"))):
                rows += [(xxhash.xxh128_digest(body[w:w + LENGTH]), d, s + w) for w in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()),
                                              pa.array([r[2] for r in rows], pa.int64())], names=["w", "id", "start"])

    sorted_ = (met.filter(F.col("members") <= heavy).select("route", "id", "start", "n", "body").repartition("route")
               .sortWithinPartitions("route", "id", "start").mapInArrow(sort, "id long, start long, n long"))
    each = met.filter(F.col("members") > heavy).select("id", "start", "n", "body").mapInArrow(windows, "w binary, id long, start long")
    least = each.groupBy("w").agg(F.min(F.struct("id", "start")).alias("least"))
    single = (each.join(least, "w").filter((F.col("id") != F.col("least.id")) | (F.col("start") != F.col("least.start")))
              .select("id", "start", F.lit(1).cast("long").alias("n")))
    same = marks.filter("again").select("id", F.shiftright("at", 16).alias("start"), F.shiftright("at", 8).bitwiseAND(255).cast("long").alias("n"))
    return same.union(sorted_).union(single)


SCHEMA = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>"


def deduplicate(docs: DataFrame) -> DataFrame:
    """A row for each document: bytes, removed bytes, removed runs, and the hash of what is kept.

    A byte goes if a 100-byte string that also starts earlier covers it.  Null and empty texts have no bytes.  Documents go
    by doc_id, null first; different texts with one doc_id go by their hash, equal rows are one document.
    """
    texts, names = unique_documents(docs)
    removed = (spans(texts).groupBy("id").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("n") - 1 + LENGTH).alias("end"))).alias("spans")))

    def cut(batches):
        for batch in batches:
            rows = []
            lists = batch.column("spans")
            for k, text in enumerate(batch.column("text").to_pylist()):
                at, gone, out, kept = 0, 0, [], hashlib.sha256()
                if lists[k].is_valid:
                    flat = lists[k].values.flatten()
                    pairs = np.stack([x.to_numpy() for x in flat], axis=1)
                    for s, e in pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))].tolist():
                        if out and s <= out[-1][1]:
                            out[-1][1] = max(out[-1][1], e)
                        else:
                            out.append([s, e])
                for s, e in out:
                    kept.update(text[at:s])
                    gone, at = gone + e - s, e
                kept.update(text[at:])
                rows.append((len(text), gone, len(out), kept.hexdigest(), [{"start": s, "end": e} for s, e in out]))
            cols = list(zip(*rows)) if rows else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(cols, types))],
                                             names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    out = texts.join(removed, "id", "left").select("id", "text", "spans").mapInArrow(cut, SCHEMA)
    if names is None:
        return out.withColumnRenamed("id", "doc_id")
    return names.join(out, "id").drop("id")
