"""Merkle fixity audit of WARC records: only DataFrame functions.

A record's key is its page id; nodes of level k cover keys that agree above their lowest 4*k bits, so a missing or longer
record changes one branch only.  Repeated ids share a leaf, whose digest is a sum over its records' digests.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelgrid.llm.common import save

BITS = 4
FILE_BITS = 10


def record(page_id: Column, url: Column, body: Column) -> Column:
    """The bytes of a WARC response record; nulls count as empty."""
    body, url = F.coalesce(body, F.lit("")), F.coalesce(url, F.lit(""))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <page:"), F.coalesce(page_id.cast("string"), F.lit("")),
                    F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"),
                    F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def records(pages: DataFrame) -> DataFrame:
    """page_id, known, file_no, offset, length, digest of every record; files hold 1,024 ids, in order of id and digest.

    Records without an id lie beside those of id -1 and share their leaf; `known` tells them apart.
    """
    key = F.coalesce(F.col("page_id").cast("long"), F.lit(-1))
    r = record(F.col("page_id"), F.col("url"), F.col("html"))
    slim = pages.select(key.alias("page_id"), F.col("page_id").isNotNull().alias("known"), F.octet_length(r).cast("long").alias("length"), F.sha2(r.cast("binary"), 256).alias("digest"))
    order = Window.partitionBy("file_no").orderBy("page_id", "digest")
    return (slim.withColumn("file_no", F.shiftright("page_id", FILE_BITS))
            .withColumn("offset", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")))


def leaves(recs: DataFrame) -> DataFrame:
    """(node, digest, bytes) of level 0: one row for each id."""
    pieces = [F.sum(F.conv(F.substring("digest", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
    return (recs.groupBy(F.col("page_id").alias("node")).agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), *pieces)
            .select("node", F.sha2(F.concat_ws(":", "n", "bytes", "s0", "s1", "s2", "s3").cast("binary"), 256).alias("digest"), "bytes"))


def parents(level: DataFrame) -> DataFrame:
    """The next level: each node hashes its children in order, at most 16 of them, with the bytes they span."""
    child = F.struct("node", "digest", "bytes")
    return (level.groupBy(F.shiftright("node", BITS).alias("node"))
            .agg(F.array_sort(F.collect_list(child)).alias("c"), F.sum("bytes").alias("bytes"))
            .select("node", F.sha2(F.concat_ws(",", F.transform("c", lambda x: F.concat_ws(":", x.node, x.digest, x.bytes)))
                                   .cast("binary"), 256).alias("digest"), "bytes"))


def tree(recs: DataFrame, levels: int) -> list[DataFrame]:
    out = [save(leaves(recs), "merkle")]
    for _ in range(levels):
        out.append(save(parents(out[-1]), "merkle"))
    return out


def mismatches(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """Ids whose leaves differ: from the top level down, only children of differing nodes are looked at."""
    bad = None
    for left, right in zip(reversed(a), reversed(b)):
        if bad is not None:
            left, right = (x.join(bad, F.shiftright(x.node, BITS) == bad.bad, "left_semi") for x in (left, right))
        bad = save(left.select("node", "digest").join(right.select("node", F.col("digest").alias("other")), "node", "full_outer")
                   .filter(~F.col("digest").eqNullSafe(F.col("other"))).select(F.col("node").alias("bad")), "mismatches")
    return bad


def audit(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """Records that differ between two copies: kind 'changed', 'missing' (from the replica) or 'extra', with the offset
    range in either copy.  Equal copies and two empty tables give no rows; records without an id are compared among themselves
    and come out with a null id; ids may be any long."""
    first, second = save(records(pages), "records"), save(records(replica), "records")
    ends = [r for recs in (first, second) for r in recs.agg(F.min("page_id"), F.max("page_id")).first() if r is not None]
    levels = max([1] + [-(-(r if r >= 0 else -(r + 1)).bit_length() // BITS) for r in ends])
    bad = mismatches(tree(first, levels), tree(second, levels))

    def numbered(recs: DataFrame, mark: str) -> DataFrame:
        same = Window.partitionBy("page_id", "digest").orderBy("offset")
        return (recs.join(bad, recs.page_id == bad.bad, "left_semi").withColumn("occ", F.row_number().over(same))
                .select("page_id", "known", "digest", "occ", "file_no", F.col("offset").alias(f"{mark}offset"), F.col("length").alias(f"{mark}length")))

    a, b = numbered(first, ""), numbered(second, "replica_")
    keys = ["page_id", "known", "digest", "occ"]
    turn = Window.partitionBy("page_id", "known").orderBy("digest", "occ")
    only_a = a.join(b, keys, "left_anti").withColumn("rn", F.row_number().over(turn)).drop("occ")
    only_b = (b.join(a, keys, "left_anti").withColumn("rn", F.row_number().over(turn))
              .select("page_id", "known", "rn", F.col("digest").alias("replica_digest"), F.col("file_no").alias("f2"), "replica_offset", "replica_length"))
    return (only_a.join(only_b, ["page_id", "known", "rn"], "full_outer")
            .select(F.when(F.col("known"), F.col("page_id")).alias("page_id"), F.when(F.col("replica_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra")
                    .otherwise("changed").alias("kind"), F.coalesce("file_no", "f2").alias("file_no"), "offset", "length", "digest",
                    "replica_offset", "replica_length", "replica_digest"))
