"""N-gram Jaccard join by parity sketches.

A document's set of five-word shingles becomes a bit sketch: each shingle flips one bit, so the Hamming distance of two
sketches is at most the size of the sets' symmetric difference, which for a Jaccard index of 0.8 is at most a ninth of
both sizes together.  Sketches are cut into parts, by size band as many as the band's largest set has shingles.  At most D
parts of a linked pair differ, so among the D + 1 rarest parts of either one at least one is shared (pigeonhole); only
those are joined.  Rarity comes from a table of shingle counts over all documents, hashed to counters whose number follows the
input up to a bound; it steers the order alone, so collisions cost work and never links.

Texts that share a part are not paired with each other.  Each shared part has a centre, the text whose shingles are the most
common ones, so the parts of a family agree on it; each text is compared with the centres of its parts.  Texts with the same
centre that are still in different components are then compared by sketches within the join, which are the wider
the larger the sets, so that only pairs at the threshold come out of it.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelgrid.llm.common import bytes_of, save
from parcelgrid.llm.hashing import U, binary, blocks, distinct_shingles, mix, runs
from parcelgrid.llm.similarity import components, links

LEAST, MOST = 18, 20  # the counters are a power of two between these
CHUNK = 1 << 14  # counters that travel in one row, those that are not zero, each as its place and its count
PLACE = 44  # bits of the count
BAND = 64  # sizes below 64, 256, 1024, ... form the bands
LONGS = 4  # longs of a sketch in the first band, four times as many in each further one


def passed(batches, emit):
    """Runs `emit(doc ids, distinct shingles, their documents)` on blocks of every batch."""
    for batch in batches:
        ids = np.array([-1 if i is None else i for i in batch.column("doc_id").to_pylist()], dtype=np.int64)
        known = np.array(batch.column("doc_id").is_valid())
        data, offsets = binary(batch.column("text"))
        for i, j, part, bounds in blocks(data, offsets):
            h, doc = distinct_shingles(part, bounds)
            yield from emit(ids[i:j], known[i:j], h, doc)


def sums(h: np.ndarray, doc: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of m sets and two sums of hashes that stand for their contents."""
    first, n, out = runs(doc), np.bincount(doc, minlength=m), np.zeros((2, m), U)
    if len(h):
        at = doc[first]
        out[0, at] = np.add.reduceat(mix(h + U(0x51ED27)), first)
        out[1, at] = np.add.reduceat(mix(h ^ U(0x7A31F5B3D1)), first)
    return n, out


def class_of(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """A number of 40 bits for a set; sets that share it by chance are compared in vain."""
    return mix(total[0] ^ mix(total[1] + n.astype(U))) >> U(24)


def sketches(h: np.ndarray, doc: np.ndarray, n: np.ndarray) -> pa.Array:
    """The parity sketch of each set, as wide as its size band asks for."""
    longs = LONGS * 4 ** band_of(n)
    ends = np.concatenate([[0], np.cumsum(longs)])
    bit = h % (U(64) * longs[doc].astype(U))
    flat = np.zeros(ends[-1], U)
    np.bitwise_xor.at(flat, ends[doc] + (bit >> U(6)).astype(np.int64), U(1) << (bit & U(63)))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.view(np.int64)))


def counter_bits(docs: DataFrame) -> int:
    """About a counter for every sixteen words, between the bounds."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(np.clip(int(size // 96).bit_length(), LEAST, MOST))


def sets_and_counts(docs: DataFrame, bits: int) -> DataFrame:
    """One pass: rows of kind 0 describe documents (n, two set sums, sketch), rows of kind 1 hold counters of shingles."""
    def run(batches):
        counters = np.zeros(1 << bits, dtype=np.int64)

        def emit(ids, known, h, doc):
            np.add.at(counters, (h >> U(64 - bits)).astype(np.int64), 1)
            n, total = sums(h, doc, len(ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(ids), np.int32)), pa.array(ids, mask=~known), pa.array(n, pa.int64()), pa.array(total[0].view(np.int64)),
                 pa.array(total[1].view(np.int64)), pa.array(class_of(n, total).view(np.int64)), sketches(h, doc, n)],
                names=["kind", "id", "n", "s1", "s2", "class", "sketch"])

        yield from passed(batches, emit)
        for k in range(0, len(counters), CHUNK):
            at = np.flatnonzero(counters[k:k + CHUNK])
            if len(at):
                none, packed = pa.nulls(1, pa.int64()), at << PLACE | counters[k + at]
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([k // CHUNK]), none, none, none, none,
                                                  pa.array([packed], pa.list_(pa.int64()))], names=["kind", "id", "n", "s1", "s2", "class", "sketch"])

    return docs.mapInArrow(run, "kind int, id long, n long, s1 long, s2 long, class long, sketch array<long>")


def rarity(info: DataFrame, bits: int) -> np.ndarray:
    """Counts of all documents together, on a scale of sixteenths of a doubling; at most 2**MOST bytes."""
    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, dtype=np.int64)
        for part in table.column("sketch").chunks:
            for row in part:
                packed = row.values.to_numpy()
                total[packed >> PLACE] += packed & (1 << PLACE) - 1
        scale = np.minimum(np.round(16 * np.log2(total + 1.0)), 65535).astype(np.uint16)
        return pa.table({"id": table.column("id")[:1], "counts": pa.array([scale.tobytes()], pa.binary())})

    out = np.zeros(1 << bits, dtype=np.uint16)
    for r in info.filter("kind = 1").select("id", "sketch").groupBy("id").applyInArrow(add, "id long, counts binary").toLocalIterator():
        out[r["id"] * CHUNK:(r["id"] + 1) * CHUNK] = np.frombuffer(bytes(r["counts"]), dtype=np.uint16)
    return out


def band_of(n: np.ndarray) -> np.ndarray:
    band, top = np.zeros(len(n), np.int64), BAND
    while len(n) and top <= n.max():
        band += n >= top
        top *= 4
    return band


def parts(h: np.ndarray, doc: np.ndarray, n_docs: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, document) of the rarest parts of each document's sketch, as many as a linked document must share one of."""
    n = np.bincount(doc, minlength=n_docs)
    band, shift = band_of(n), U(64 - (len(counts) - 1).bit_length())
    keys, owners = [], []
    for up in (0, 1):  # a set within 4/5 of its band's end also goes with the next band
        b = band + up
        top = BAND * 4 ** band
        takes = (n > 0) if up == 0 else (n > 0) & (5 * n >= 4 * top)
        sel = takes[doc]
        x, d = h[sel], doc[sel]
        if not len(x):
            continue
        size = (BAND * 4 ** b)[d].astype(U)
        part = (x >> U(20)) % size
        bit = (part << U(32)) | (mix(x) & U(0xFFFFFFFF))  # size * 2**32 bits, of which a document sets few
        order = np.lexsort((bit, d))
        bit, d, rare = bit[order], d[order], counts[(x[order] >> shift).astype(np.int64)].astype(np.int64)
        start = np.ones(len(bit), dtype=bool)
        start[1:] = (bit[1:] != bit[:-1]) | (d[1:] != d[:-1])
        first = np.flatnonzero(start)
        odd = np.diff(np.append(first, len(bit))) % 2 == 1  # a bit that was flipped twice is off
        bit, d, rare = bit[first][odd], d[first][odd], rare[first][odd]
        part = bit >> U(32)
        start = np.ones(len(bit), dtype=bool)
        start[1:] = (part[1:] != part[:-1]) | (d[1:] != d[:-1])
        first = np.flatnonzero(start)
        if not len(first):
            key, owner, score = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        else:
            owner, score = d[first], np.minimum.reduceat(rare, first)
            key = mix(np.add.reduceat(mix(bit), first) ^ mix(b[owner].astype(U) + U(77)))
        need = np.where(takes, n // 4 + 1, 0)
        missing = need - np.bincount(owner, minlength=n_docs)
        for k in np.flatnonzero(missing > 0):  # too few parts are set: parts without bits count too, after all others
            p = np.setdiff1d(np.arange(BAND * 4 ** b[k], dtype=U), part[first][owner == k] if len(first) else np.zeros(0, U))
            key = np.concatenate([key, mix(mix(p + U(0xE0)) ^ mix(np.full(len(p), b[k], U) + U(78)))])
            owner = np.concatenate([owner, np.full(len(p), k)])
            score = np.concatenate([score, np.full(len(p), np.iinfo(np.int64).max)])
        order = np.lexsort((key, score, owner))
        key, owner = key[order], owner[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        keep = rank < need[owner]
        keys.append(key[keep])
        owners.append(owner[keep])
    return (np.concatenate(keys), np.concatenate(owners)) if keys else (np.zeros(0, U), np.zeros(0, np.int64))


def far(x: str, y: str) -> Column:
    """Hamming distance of two sketches; the wider one is folded to the width of the other."""
    def folded(wide: str, slim: str) -> str:
        return f"transform(sequence(0, size({slim}) - 1), i -> aggregate(sequence(0, size({wide}) div size({slim}) - 1), 0L, (s, k) -> s ^ {wide}[i + k * size({slim})]))"

    def apart(p: str, q: str) -> str:
        return f"aggregate(zip_with({p}, {q}, (u, v) -> bit_count(u ^ v)), 0, (s, b) -> s + b)"

    return F.expr(f"case when size({x}) = size({y}) then {apart(x, y)} when size({x}) < size({y}) then {apart(x, folded(y, x))} else {apart(folded(x, y), y)} end")


def may_link(x: str, y: str) -> Column:
    """Whether sizes and sketches allow a link."""
    return (F.expr(f"5 * {x}.n >= 4 * {y}.n and 5 * {y}.n >= 4 * {x}.n")) & (9 * far(f"{x}.sketch", f"{y}.sketch") <= F.expr(f"{x}.n + {y}.n"))


def ordered(a: str, b: str, df: DataFrame) -> DataFrame:
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct()


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    Null and wordless texts have no shingles and link with nothing; fewer than five words make one shingle.  Rows that
    share a doc_id are one node with several texts; a null doc_id has a null component.  Two linked texts share a part, hence
    its centre: either they end up in one component, or they are compared.  So no link between components is lost,
    and links within a component need no check.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long"), bytes_of().alias("text"))
    bits = counter_bits(slim)
    info = save(sets_and_counts(slim, bits), "parity_sets")
    every = info.filter("kind = 0").select(F.col("id").alias("doc_id"), "n", "s1", "s2", "class", "sketch")
    linked = every.filter("n > 0 and doc_id is not null")
    reps = linked.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("class").alias("class"))
    classes = save(linked.join(reps.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"]).select("doc_id", "rep").distinct(), "parity_classes")
    shared = spark.sparkContext.broadcast(rarity(info, bits))

    def run(batches):
        seen: set[int] = set()  # a task tells the parts of copies once

        def emit(ids, known, h, doc):
            m = len(ids)
            n, total = sums(h, doc, m)
            name = class_of(n, total)
            new = np.zeros(m, dtype=bool)
            for k in np.flatnonzero(known & (n > 0)):
                if (c := int(name[k])) not in seen:
                    seen.add(c)
                    new[k] = True
            mine = new[doc]
            h, doc = h[mine], doc[mine]
            common = np.bincount(doc, shared.value[(h >> U(64 - bits)).astype(np.int64)], minlength=m) / np.maximum(n, 1)
            typical = np.minimum(common / 2, 255).astype(np.uint64) << U(40) | name  # the order of classes is how common their shingles are
            key, owner = parts(h, doc, m, shared.value)
            yield pa.RecordBatch.from_arrays([pa.array((key >> U(16)).view(np.int64)), pa.array(typical[owner].view(np.int64))], names=["key", "class"])

        yield from passed(batches, emit)

    of_key, name = Window.partitionBy("key"), F.col("class").bitwiseAND(F.lit((1 << 40) - 1))
    groups = save(slim.mapInArrow(run, "key long, class long")
                  .select("class", F.min("class").over(of_key).alias("least"), F.max("class").over(of_key).alias("centre"))
                  .filter("least < centre").select(F.col("centre").bitwiseAND(F.lit((1 << 40) - 1)).alias("centre"), name.alias("class")).distinct(), "parity_groups")
    wanted = groups.select("class").distinct()  # every centre is a member too
    sets = save(reps.join(wanted, "class", "left_semi").join(linked.select("doc_id", "n", "s1", "s2", "sketch"), ["n", "s1", "s2"])
                .filter("doc_id = rep").groupBy("rep", "class", "n").agg(F.first("sketch").alias("sketch")), "parity_reps")
    members = save(groups.join(sets.select("class", "rep", "n", "sketch"), "class")
                   .join(sets.select(F.col("class").alias("centre"), F.col("rep").alias("star")).distinct(), "centre").select("star", "rep", "n", "sketch"), "parity_members")
    x, y = members.filter("star <> rep").alias("x"), sets.alias("y")
    tried = save(ordered("x1", "y1", x.join(y, (F.col("x.star") == F.col("y.rep")) & may_link("x", "y"))
                         .select(F.col("x.star").alias("x1"), F.col("x.rep").alias("y1"))), "parity_tried")
    spread = classes.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a < z")
    several = classes.join(spread, "doc_id").filter("a < rep").select("a", F.col("rep").alias("b"))  # an id holds its texts together
    edges = save(links(docs, tried).union(several), "parity_links")

    def component_of(nodes: DataFrame, links_: DataFrame) -> DataFrame:
        return (nodes.join(components(links_).withColumnRenamed("id", "rep"), "rep", "left")
                .withColumn("component", F.coalesce("component", "rep")))

    placed = component_of(members, edges)
    open_ = save(placed.join(placed.groupBy("star").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 < c1").select("star"), "star"),
                 "parity_open")
    x, y = open_.alias("x"), open_.alias("y")
    apart = (F.col("x.star") == F.col("y.star")) & (F.col("x.component") < F.col("y.component")) & may_link("x", "y")
    rest = (ordered("r1", "r2", x.join(y, apart).select(F.col("x.rep").alias("r1"), F.col("y.rep").alias("r2")))
            .join(tried, ["a", "b"], "left_anti"))
    more = save(links(docs, save(rest, "parity_rest")), "parity_links")
    of = component_of(classes, edges if more.isEmpty() else edges.union(more))
    return (every.select("doc_id", F.col("n").alias("n_shingles")).join(of.select("doc_id", "component").distinct(), "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))
