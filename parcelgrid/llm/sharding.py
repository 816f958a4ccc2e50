"""Shards by a Feistel permutation of global row numbers.

Row numbers 0..N-1 are permuted by a keyed Feistel network over Z_a x Z_b with a*b >= N; numbers that land beyond N
walk the cycle until they come back.  Shard and slot follow from the permuted number alone, so any row's place can be
computed without looking at other rows, and shard counts differ by one at most.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelgrid.llm.common import save

ROUNDS = 6


def feistel(df: DataFrame, name: str, out: str, a: int, b: int, seed: int, rounds: int = ROUNDS) -> DataFrame:
    """Adds `out`, a bijection of 0..a*b-1 of column `name`: each round adds a hash of one half to the other half."""
    df = df.withColumn("_l", F.pmod(name, F.lit(a))).withColumn("_r", F.expr(f"`{name}` div {a}"))
    for i in range(rounds):
        to, of, size = ("_r", "_l", b) if i % 2 else ("_l", "_r", a)
        df = df.withColumn("_h", F.xxhash64(of, F.lit(seed), F.lit(i))).withColumn(to, F.pmod(F.col(to) + F.pmod("_h", F.lit(size)), F.lit(size)))
    return df.withColumn(out, F.col("_l") + F.col("_r") * F.lit(a)).drop("_l", "_r", "_h")


def numbered(df: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """Dense row numbers from 0 by `order`.

    Rows are dealt by range, sorted inside partitions and written once; only the row count of each partition goes
    through one small window.  Equal rows are spread over ranges by their place in the input.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tied = df.withColumn("_input", F.monotonically_increasing_id())
    keys = [*order, F.col("_input")]
    ranged = tied.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = save(ranged.drop("_input").withColumn("_place", F.monotonically_increasing_id())
                  .withColumn("_part", F.shiftright("_place", 33)), "numbered")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    # one row for each shuffle partition, so the table is small whatever the input
    return (placed.join(F.broadcast(before), "_part")
            .withColumn(name, F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1))
            .drop("_part", "_place", "_before"))


def shard(docs: DataFrame, shards: int = 16, seed: int = 20) -> DataFrame:
    """doc_id, size, text_crc32, law 'rows', shard, slot, grown_shard (null) for every row of `docs`.

    Null texts have no bytes; rows are ordered by (doc_id, checksum, size), nulls first, so the result does not depend
    on file layout, and rows equal in all three are interchangeable.  An empty table gives no rows.
    """
    slim = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
                       F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("text_crc32"))
    rows = numbered(slim, [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")])
    n = rows.count()
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    b = max(1, -(-n // a))
    placed = feistel(rows, "row_number", "p", a, b, seed)
    while True:  # the share of numbers still outside falls by 1/a with each step of the walk
        placed = (feistel(placed, "p", "q", a, b, seed)
                  .withColumn("p", F.when(F.col("p") < n, F.col("p")).otherwise(F.col("q"))).drop("q"))
        if (placed.agg(F.max("p")).first()[0] or 0) < max(n, 1):
            break
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
                         F.pmod("p", F.lit(shards)).cast("int").alias("shard"),
                         F.expr(f"p div {shards}").alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"))
