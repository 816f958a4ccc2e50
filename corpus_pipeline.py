"""From raw documents to packed training sequences: each stage takes what the one before kept."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelgrid.llm import decontamination, packing, parity_join, pii, toxicity
from parcelgrid.llm.common import bitmap, in_bitmap, save, scratch, table
from parcelgrid.llm.queries import vocabulary_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; rows with null or empty text stay."""
    docs = docs.select(*COLUMNS)
    return toxicity.flagged(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the smallest doc_id (null comes last); unlinked rows stay.

    Rows are told apart by a hash of all their columns, so equal and null ids neither hold texts together nor keep them out,
    and no copy of the table with row numbers is needed; of rows that are equal in all columns and have words, one stays.
    """
    rows = docs.select(*COLUMNS).withColumn("row", F.xxhash64(*(x for c in COLUMNS for x in (F.col(c), F.col(c).isNull()))))
    groups = (parity_join.join(rows.select(F.col("row").alias("doc_id"), "text")).filter("n_shingles > 0")
              .groupBy("component_id", F.col("doc_id").alias("row")).agg(F.count("*").alias("times")))
    groups = save(groups, "pipeline_groups")
    several = groups.groupBy("component_id").agg(F.sum("times").alias("size")).filter("size > 1").select("component_id")
    linked = save(groups.join(several, "component_id").join(rows.select("row", "doc_id").distinct(), "row"), "pipeline_linked")
    first = linked.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("kept")).select("kept.row")
    lost, again = linked.join(first, "row", "left_anti").select("row"), linked.join(first, "row").filter("times > 1").select("row")
    # a filter of bounded size tells most rows that stay; only the others are shuffled
    marks = bitmap(lost.union(again), "row")
    held = in_bitmap("row", marks, spark, rows)
    kept = in_bitmap("row", marks, spark, rows, inside=False).unionByName(held.join(lost.union(again), "row", "left_anti"))
    if not again.isEmpty():
        kept = kept.unionByName(held.join(again, "row", "left_semi").dropDuplicates(["row"]))
    return kept.select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has no window of the benchmark, whatever their doc_id."""
    docs = docs.select(*COLUMNS)
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the new text."""
    docs = docs.select(*COLUMNS)
    return (pii.redact(docs, pii.train(docs)).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                                                         .otherwise(F.char_length("text").cast("long"))).select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets."""
    return packing.pack(docs.select(*COLUMNS), vocabulary_file())


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated),
          ("personal_data", mask_personal_data), ("packing", pack_sequences)]

#: Trained models and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before: list[str] = []
    for name, stage in STAGES:
        with scratch(spark) as made:  # what a stage has written on its way goes once its output is there, as does its input
            docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
            output = made.pop()
            made += before
        before = [output]
    return docs
