"""Tables in the shared folder and bounded lookups that the operators share."""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelgrid.session import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
_made: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that `save` writes within the block are deleted at its end, but for those taken out of the list it gives."""
    made: list[str] = []
    _made.append(made)
    try:
        yield made
    finally:
        _made.pop()
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in made:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage without a second run of it.

    Nothing reads the shuffles of the write again, so Spark is told to delete their files when it ends.  Texts go to Python
    a few megabytes at a time, as batches are held outside the heap, and twice where pairs of texts are compared.
    """
    path, conf = fresh_path(df.sparkSession, name), df.sparkSession.conf
    before = {k: conf.get(k, None) for k in WRITING}
    try:
        for k, v in WRITING.items():
            conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    if _made:
        _made[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bytes_of(name: str = "text") -> Column:
    """A text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def bitmap(ids: DataFrame, column: str, bits: int = 24) -> dict[int, bytes]:
    """A filter of 2**bits bits over hashed ids, as blocks of 4 kB; bounded by `bits` whatever the number of ids.

    False positives only add rows that a join drops later.
    """
    slot = F.shiftrightunsigned(F.xxhash64(column), 64 - bits)
    rows = (ids.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m")).collect())
    return {r["b"]: bytes(r["m"]) for r in rows}


def in_bitmap(column: str, blocks: dict[int, bytes], spark: SparkSession, df: DataFrame, bits: int = 24, inside: bool = True) -> DataFrame:
    """Rows whose hashed id may be among those of `blocks`, or those whose id is surely not."""
    marks = spark.createDataFrame([(b, bytearray(m)) for b, m in sorted(blocks.items())], "b long, m binary")
    slot = F.shiftrightunsigned(F.xxhash64(column), 64 - bits)
    at = F.bitmap_bit_position(F.col("_slot")).cast("int")
    byte = F.conv(F.hex(F.substring("m", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = (byte.bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(_slot) % 8 as int))")) != 0)
    return (df.withColumn("_slot", slot).withColumn("_block", F.bitmap_bucket_number("_slot"))
            .join(F.broadcast(marks), F.col("_block") == F.col("b"), "inner" if inside else "left")
            .filter(held if inside else ~F.coalesce(held, F.lit(False))).drop("_slot", "_block", "b", "m"))
