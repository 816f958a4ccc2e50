"""Exact ranks, percentiles and first-k rows that never pull a group into one task.

Spark's `percentile`, `ntile` and plain window ranks hold a whole group in one
task.  Here a group is cut by value into many small buckets, only bucket counts
are scanned in order, and rows are ranked inside their own bucket.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelgrid.session import fresh_path
from parcelgrid.functions.common import col


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on equal keys where NULL equals NULL, keeping one copy of the keys.

    No forced broadcast: adaptive execution broadcasts the right side when its
    measured size is small and splits skewed partitions of the left otherwise.
    """
    renamed = small.select(*[F.col(k).alias(f"__{k}") for k in keys],
                           *[c for c in small.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & df[k].eqNullSafe(renamed[f"__{k}"])
    return df.join(renamed, cond, how).drop(*[f"__{k}" for k in keys])


# --- Percentiles ---------------------------------------------------------------------

def value_bucket(value) -> Column:
    """Order-keeping bucket of a number, about 0.05 % wide."""
    value = col(value)
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * 2000.0).cast("long")


def exact_percentiles(df: DataFrame, by: Sequence[str], value: str,
                      probs: Mapping[str, float]) -> DataFrame:
    """Linear-interpolation percentiles per group, with the group size as `n`.

    Rows: one per group.  Equal values are counted before any shuffle, bucket
    totals find where each wanted rank falls, and only those buckets are ordered.
    """
    by = list(by)
    values = (df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
              .groupBy(*by, "__v").agg(F.count("*").alias("__n"))
              .withColumn("__b", value_bucket("__v")))
    in_group = Window.partitionBy(*by)
    ordered = in_group.orderBy("__b")
    buckets = (values.groupBy(*by, "__b").agg(F.sum("__n").alias("__bn"))
               .withColumn("__before", F.coalesce(
                   F.sum("__bn").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .withColumn("__total", F.sum("__bn").over(in_group)))

    def position(p):
        return F.lit(float(p)) * (F.col("__total") - 1)

    wanted = F.lit(False)
    for p in probs.values():
        wanted = wanted | ((F.col("__before") <= F.ceil(position(p)))
                           & (F.col("__before") + F.col("__bn") > F.floor(position(p))))
    hits = buckets.filter(wanted).drop("__bn")
    inside = Window.partitionBy(*by, "__b").orderBy("__v")
    ranked = (attach(values, hits, [*by, "__b"], "inner")
              .withColumn("__lo", F.col("__before") + F.coalesce(
                  F.sum("__n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))

    def value_at(rank):
        return F.min(F.when((F.col("__lo") <= rank) & (rank < F.col("__lo") + F.col("__n")), F.col("__v")))

    aggs = [F.first("__total").alias("n")]
    for i, p in enumerate(probs.values()):
        aggs.append(value_at(F.floor(position(p))).alias(f"__a{i}"))
        aggs.append(value_at(F.ceil(position(p))).alias(f"__z{i}"))
    out = ranked.groupBy(*by).agg(*aggs)
    cols = []
    for i, (name, p) in enumerate(probs.items()):
        pos = F.lit(float(p)) * (F.col("n") - 1)
        a, z = F.col(f"__a{i}"), F.col(f"__z{i}")
        cols.append((a + (z - a) * (pos - F.floor(pos))).alias(name))
    return out.select(*by, "n", *cols)


def exact_median(df: DataFrame, by: Sequence[str], value: str, name: str = "median") -> DataFrame:
    return exact_percentiles(df, by, value, {name: 0.5})


# --- Ranks ------------------------------------------------------------------------------

def rank_within(df: DataFrame, by: Sequence[str], order: str, id_col: str,
                scale: float = 1e4, rank: str = "rank", total: str = "group_size") -> DataFrame:
    """Zero-based rank of each row in its group by `order`, then by the hash of the id.

    Ranks come from counts at three nested levels (strip of width 1/scale, value, hash
    digits), so a single value shared by a large part of a group is still spread over
    thousands of small pieces.
    """
    by = list(by)
    rows = df.withColumns({
        "__l1": F.floor(F.col(order) * F.lit(scale)).cast("long"),
        "__l2": F.col(order),
        "__h": F.md5(F.col(id_col).cast("string")),
    }).withColumn("__l3", F.substring("__h", 1, 3))
    c3 = rows.groupBy(*by, "__l1", "__l2", "__l3").agg(F.count("*").alias("__n3"))
    c2 = c3.groupBy(*by, "__l1", "__l2").agg(F.sum("__n3").alias("__n2"))
    c1 = c2.groupBy(*by, "__l1").agg(F.sum("__n2").alias("__n1"))

    def before(n, part, order_by):
        w = Window.partitionBy(*part).orderBy(order_by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(n).over(w), F.lit(0))

    o1 = c1.select(*by, "__l1", before("__n1", by, "__l1").alias("__o1"),
                   F.sum("__n1").over(Window.partitionBy(*by)).alias(total))
    o2 = c2.select(*by, "__l1", "__l2", before("__n2", [*by, "__l1"], "__l2").alias("__o2"))
    o3 = c3.select(*by, "__l1", "__l2", "__l3",
                   before("__n3", [*by, "__l1", "__l2"], "__l3").alias("__o3"))
    offsets = attach(attach(o3, o2, [*by, "__l1", "__l2"], "inner"), o1, [*by, "__l1"], "inner")
    key = [*by, "__l1", "__l2", "__l3"]
    local = F.row_number().over(Window.partitionBy(*key).orderBy("__h", id_col)) - 1
    placed = attach(rows, offsets, key, "inner").withColumn(
        rank, F.col("__o1") + F.col("__o2") + F.col("__o3") + local)
    return placed.drop("__l1", "__l2", "__l3", "__h", "__o1", "__o2", "__o3")


def dense_positions(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Adds the zero-based place of each row in a total order.

    Rows are dealt by range, sorted inside partitions and written with their partition and their place in it, in packed
    columns; only the row counts of the partitions, one number each, go through a single window and to all tasks.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = fresh_path(spark, "places")
    dealt = (df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
             .withColumn("__at", F.monotonically_increasing_id()))
    dealt.write.parquet(path)
    placed = spark.read.schema(dealt.schema).parquet(path)
    part = F.shiftright("__at", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    start = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__start"))
    return (placed.withColumn("__part", part).join(F.broadcast(start), "__part")
            .withColumn(name, F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__part", "__at", "__start"))


def tile(rank: str, total: str, k: int) -> Column:
    """Part 0..k-1 of an even split where the first parts take the remainder."""
    q = F.floor(F.col(total) / F.lit(k))
    r = F.col(total) % F.lit(k)
    big = r * (q + 1)
    return F.when(F.col(rank) < big, F.floor(F.col(rank) / (q + 1))).otherwise(
        r + F.floor((F.col(rank) - big) / F.greatest(q, F.lit(1)))).cast("int")


def top_k_per_probe(df: DataFrame, key: str | Sequence[str], order: Sequence, k: int,
                    rank: str = "rank") -> DataFrame:
    """First k rows per key.  Spark trims each partition to k rows per key before
    the shuffle, so a key with very many rows costs no more than k per task."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
