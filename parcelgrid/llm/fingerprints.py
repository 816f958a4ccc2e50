"""MinHash fingerprints over five-word shingles."""
from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelgrid.llm.common import bytes_of, save
from parcelgrid.llm.hashing import U, binary, blocks, mix, runs, shingles, words
from parcelgrid.llm.similarity import components, links

PERMUTATIONS = 128
_draw = np.random.default_rng(6)
FACTORS = _draw.integers(0, 1 << 63, PERMUTATIONS, dtype=U) * U(2) + U(1)
SHIFTS = _draw.integers(0, 1 << 63, PERMUTATIONS, dtype=U) * U(2)


def signatures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, permutations) of 16-bit minima; a text without words has all bits set.

    Each permutation is a multiply-add-shift hash of the 32-bit shingle hash, which is universal.
    """
    out = np.full((len(offsets) - 1, PERMUTATIONS), 0xFFFF, dtype=np.uint16)
    for i, j, part, bounds in blocks(data, offsets):
        h, doc = shingles(*words(part, bounds))
        if not len(h):
            continue
        x, start = h >> U(32), runs(doc)
        for k in range(PERMUTATIONS):
            least = np.minimum.reduceat((x * FACTORS[k] + SHIFTS[k]) >> U(32), start)
            out[doc[start] + i, k] = (mix(least) >> U(48)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal places, an estimate of the Jaccard index."""
    return (a == b).mean(axis=1)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), dtype=np.uint8), offsets


def hexes(s: np.ndarray) -> list[str]:
    text, width = s.astype(">u2").tobytes().hex(), s.shape[1] * 4
    return [text[i:i + width] for i in range(0, len(text), width)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the hex fingerprint of its text; null texts count as empty, equal texts have equal fingerprints."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(hexes(signatures(*binary(batch.column("text")))), pa.string())],
                                             names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), bytes_of().alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def near_duplicates(docs: DataFrame, rows: int = 5, percent: int = 80) -> DataFrame:
    """Verified pairs (a, b) that hold together all documents which share a signature band and reach `percent`.

    Documents are first compared with the least one of their signature, the others then with the least one of each band;
    members of a band that are still in different components are compared with each other, so no link between
    components is lost.  The exact Jaccard index decides each pair.  Texts without words and rows without doc_id pair
    with nothing.
    """
    bands = PERMUTATIONS // rows
    width = rows * 4
    cut = F.array(*(F.xxhash64(F.lit(i), F.substring("fingerprint", i * width + 1, width)) for i in range(bands)))
    prints = save(fingerprints(docs).filter(F.col("doc_id").isNotNull() & (F.col("fingerprint") != "f" * (PERMUTATIONS * 4))).distinct(), "minhash_prints")
    least = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("a"))
    stars = prints.join(least, "fingerprint").select("a", F.col("doc_id").alias("b")).filter("a < b").distinct()
    same = save(links(docs, save(stars, "minhash_pairs"), percent).distinct(), "minhash_links")
    copies = same.join(least, "a").select(F.col("b").alias("doc_id"), "fingerprint").distinct()
    keyed = save(prints.join(copies, ["doc_id", "fingerprint"], "left_anti").select("doc_id", F.explode(cut).alias("band")).distinct(), "minhash_bands")
    stars = keyed.join(keyed.groupBy("band").agg(F.min("doc_id").alias("a")), "band").select("a", F.col("doc_id").alias("b")).filter("a < b").distinct()
    tried = save(stars, "minhash_pairs")
    edges = same.union(save(links(docs, tried, percent).distinct(), "minhash_links"))
    of = components(edges).withColumnRenamed("id", "doc_id")
    members = save(keyed.join(of, "doc_id", "left").select("band", "doc_id", F.coalesce("component", "doc_id").alias("component")), "minhash_members")
    several = members.groupBy("band").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 < c1").select("band")
    x, y = (members.join(several, "band").select("band", F.col("doc_id").alias(d), F.col("component").alias(c)) for d, c in (("d0", "c0"), ("d1", "c1")))
    rest = (x.join(y, "band").filter("c0 < c1").select(F.least("d0", "d1").alias("a"), F.greatest("d0", "d1").alias("b")).filter("a < b").distinct()
            .join(tried, ["a", "b"], "left_anti"))
    return edges.union(links(docs, save(rest, "minhash_pairs"), percent)).distinct()


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text (its last third replaced by the next document's beginning).

    The next document is the one of the next smaller doc_id (null comes last, equal ids go by checksum), after the last
    the first.  Documents are dealt once into ranges of doc_id; each range also gets the first row of the next one, so
    neighbours meet while a sorted partition streams by.  A lone document is its own successor.
    """
    spark = docs.sparkSession
    low = -(1 << 63)
    keyed = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("k"),
                        bytes_of().alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = np.array(sorted({int(c) for c in keyed.approxQuantile("k", [i / parts for i in range(1, parts)], 0.2 / parts)}),
                    dtype=np.int64)

    @F.pandas_udf("long")
    def bucket(k: pd.Series) -> pd.Series:
        return pd.Series(len(cuts) - np.searchsorted(cuts, k.to_numpy()))

    heads = dict(keyed.select("k").withColumn("r", bucket("k")).groupBy("r").agg(F.max("k")).collect())  # a row per range
    order = sorted(heads)
    before = {heads[r]: order[i - 1] for i, r in enumerate(order)}  # first key of a range -> the range before it

    @F.pandas_udf("array<struct<r:long,tail:boolean>>")
    def dealt(k: pd.Series) -> pd.Series:
        own = len(cuts) - np.searchsorted(cuts, k.to_numpy())
        return pd.Series([[{"r": int(r), "tail": False}] + ([{"r": before[x], "tail": True}] if x in before else [])
                          for r, x in zip(own, k)])

    rows = (keyed.withColumn("at", F.explode(dealt("k"))).select("doc_id", "k", "text", "at.r", "at.tail")
            .repartitionByRange(parts, "r").sortWithinPartitions("r", "tail", F.desc("k"), F.crc32("text"), "text"))

    def run(batches):
        held = None  # (doc_id, tail, text, signature): the row whose successor is still to come
        for batch in batches:
            ids, tails = batch.column("doc_id").to_pylist(), batch.column("tail").to_pylist()
            texts = batch.column("text").to_pylist()
            step = 256
            for i in range(0, len(ids), step):
                signs = signatures(*joined(texts[i:i + step]))
                new = [*zip(ids[i:i + step], tails[i:i + step], texts[i:i + step], signs)]
                line = ([held] if held else []) + new
                held = line[-1]
                pairs = [(c, n) for c, n in zip(line, line[1:]) if not c[1]]
                if not pairs:
                    continue
                chars, edits = [], []
                for c, n in pairs:
                    text = c[2].decode("utf-8", "replace")
                    third = len(text) // 3
                    chars.append(len(text))
                    edits.append((text[:len(text) - third] + n[2][:4 * third].decode("utf-8", "ignore")[:third]).encode())
                own, after = np.stack([c[3] for c, _ in pairs]), np.stack([n[3] for _, n in pairs])
                changed = signatures(*joined(edits))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c[0] for c, _ in pairs], pa.int64()), pa.array(chars, pa.int64()),
                     pa.array([hashlib.sha256(e).hexdigest() for e in edits]), pa.array(hexes(own)), pa.array(hexes(changed)),
                     pa.array(likeness(own, changed)), pa.array(likeness(own, after))],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return rows.select("doc_id", "tail", "text").mapInArrow(run, SCHEMA)
