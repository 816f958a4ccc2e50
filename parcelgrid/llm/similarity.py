"""Exact Jaccard of candidate pairs, and classes of linked documents, both as Spark jobs."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelgrid.llm.common import bitmap, bytes_of, in_bitmap, save
from parcelgrid.llm.hashing import binary, blocks, distinct_shingles, runs


def shared_counts(left, right) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes of both texts and of what they share, pair by pair."""
    (d1, o1), (d2, o2) = binary(left), binary(right)
    n = len(o1) - 1
    out = np.zeros((3, n), dtype=np.int64)
    for i, j, _, _ in blocks(np.zeros(0), o1 + o2 - o1[0] - o2[0]):
        h1, a = distinct_shingles(d1[o1[i]:o1[j]], o1[i:j + 1] - o1[i])
        h2, b = distinct_shingles(d2[o2[i]:o2[j]], o2[i:j + 1] - o2[i])
        h, doc = np.concatenate([h1, h2]), np.concatenate([a, b])
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        for k, x in enumerate((a, b, doc[1:][same])):
            out[k, i:j] = np.bincount(x, minlength=j - i)
    return out[0], out[1], out[2]


def links(docs: DataFrame, pairs: DataFrame, percent: int = 80) -> DataFrame:
    """Pairs (a, b) of ids whose texts' sets of five-word shingles have a Jaccard index of `percent` or more.

    Only texts that some pair asks for are shuffled; a bitmap of bounded size sorts out most others beforehand.
    """
    spark = docs.sparkSession
    wanted = bitmap(pairs.select(F.explode(F.array("a", "b")).alias("id")), "id")
    if not wanted:
        return spark.createDataFrame([], "a long, b long")
    texts = in_bitmap("id", wanted, spark, docs.select(F.col("doc_id").alias("id"), bytes_of().alias("text")))

    def check(batches):
        for batch in batches:
            n1, n2, both = shared_counts(batch.column("text_a"), batch.column("text_b"))
            keep = pa.array((both * 100 >= percent * (n1 + n2 - both)) & (both > 0))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(keep)

    return (pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
            .join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
            .select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each linked id reaches.

    Alternating large-star and small-star steps; each writes its edges to the shared folder, and stars of one centre
    are only ever aggregated, never gathered.
    """
    def smallest(e: DataFrame) -> DataFrame:
        """The least neighbour of each node, itself included."""
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
        return both, both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))

    current = save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .filter("a <> b").distinct(), "edges")
    before = None
    while True:
        both, least = smallest(current)
        large = save(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                     .filter("a <> b").distinct(), "edges")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(down.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        current = save(small, "edges")
        state = current.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before:
            break
        before = state
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
