"""Reading listing documents and enrichment runs."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelgrid import fixed_values as V
from parcelgrid.functions.common import filled, null_if_empty
from parcelgrid.schema import DOCUMENT, PRICE_INDEX

CORRUPT = "_corrupt_record"


def read_lines(spark: SparkSession, path: str, schema: T.StructType = DOCUMENT) -> DataFrame:
    """JSON lines with `_corrupt_record` and `_ordinal`, the place of a line in its file."""
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    raw = (spark.read.schema(with_corrupt).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", CORRUPT).json(path))
    return raw.withColumn("_ordinal", F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row")))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, value, _ordinal): lines that are not blank."""
    return (spark.read.text(path).filter(F.trim("value") != "")
            .select(F.col("_metadata.file_path").alias("file"), "value",
                    F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                             F.monotonically_increasing_id().alias("row")).alias("_ordinal")))


def object_of(value: Column) -> Column:
    """The JSON object of a text, NULL where the syntax is broken or it is no object."""
    return F.when(F.ltrim(value).startswith("{"), F.try_parse_json(value))


def lenient(v: str, path: str, kind: T.DataType) -> Column:
    """A value by its path, cast where it can be and NULL where not."""
    if isinstance(kind, T.StructType):
        return F.struct(*[lenient(v, f"{path}.{f.name}", f.dataType).alias(f.name) for f in kind.fields])
    return F.try_variant_get(F.col(v), path, kind.simpleString())


def corrupt_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of every line that is not a JSON object, for a quarantine table."""
    return text_lines(spark, path).filter(object_of(F.col("value")).isNull()).select("file", F.col("value").alias("line"))


def read_collection(spark: SparkSession, path: str, schema: T.StructType = DOCUMENT) -> DataFrame:
    """Documents by `_id`: lines of broken JSON and documents without an id are left out, and
    of several lines with one id the last wins.

    A line whose values have the expected types is read in one typed pass.  In any other, a value of an unexpected type is
    cast if it can be and NULL if not; its document stays.  Keys of `current` that the schema does not name
    are kept as text in the map `extra`.
    """
    known = F.array(*[F.lit(n) for n in schema["current"].dataType.fieldNames()]) if "current" in schema.fieldNames() else F.array()
    strict = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    typed = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    loose = T.StructType([T.StructField("current", T.MapType(T.StringType(), T.StringType()))])
    lines = text_lines(spark, path).select("_ordinal", "value", F.from_json("value", typed, strict).alias("t"), F.from_json("value", loose, strict)["current"].alias("all"))
    refused = F.col("t").isNull() | F.col("t").getField(CORRUPT).isNotNull()

    def unknown(entries: Column) -> Column:
        return F.map_filter(entries, lambda key, _: ~F.array_contains(known, key)).alias("extra")

    typed_lines = lines.filter(~refused).select("_ordinal", *[F.col("t").getField(n).alias(n) for n in schema.fieldNames()], unknown(F.col("all")))
    # the typed pass refuses a line for one value; only such lines are parsed again, value by value
    mixed = lines.filter(refused).select("_ordinal", object_of(F.col("value")).alias("v")).filter("v IS NOT NULL").select(
        "_ordinal", *[lenient("v", f"$.{f.name}", f.dataType).alias(f.name) for f in schema.fields], unknown(F.try_variant_get("v", "$.current", "map<string,string>")))
    usable = typed_lines.unionByName(mixed).filter(filled("_id"))
    body = [f for f in schema.fieldNames() if f != "_id"]
    return (usable.groupBy("_id").agg(F.max_by(F.struct(*body, "extra"), F.col("_ordinal")).alias("d"))
            .select(F.col("_id").alias("doc_id"), "d.*"))


def flatten_documents(docs: DataFrame) -> DataFrame:
    """One flat row per document, without its history."""
    current = [f for f in docs.schema["current"].dataType.fieldNames() if f not in docs.columns]
    extra = ["extra"] if "extra" in docs.columns else []
    return docs.select("doc_id", "source", "country", "first_seen", "last_seen", *extra,
                       *[F.col(f"current.{f}").alias(f) for f in current])


def document_events(docs: DataFrame) -> DataFrame:
    """History events as rows (doc_id, source, date, event, changes)."""
    return docs.select("doc_id", "source", F.explode("history").alias("h")).select(
        "doc_id", "source", "h.date", "h.event", "h.changes")


def union_collections(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# --- Enrichment runs -----------------------------------------------------------------------------

def feature_schema(with_images: bool = True) -> T.StructType:
    fields = {**V.RESPONSE_TEXT_FIELDS, **(V.RESPONSE_IMAGE_FIELDS if with_images else {})}
    kinds = {"long": T.LongType(), "string": T.StringType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in fields.items()])


def read_enrichment_run(spark: SparkSession, run_dir: str, run_id: str) -> DataFrame:
    """(run_id, doc_id, features); the last record of a document wins."""
    schema = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("features", feature_schema())])
    lines = read_lines(spark, f"{run_dir}/enrichments.jsonl", schema).filter(filled("doc_id"))
    return (lines.groupBy("doc_id").agg(F.max_by("features", "_ordinal").alias("features"))
            .select(F.lit(run_id).alias("run_id"), "doc_id", "features"))


def merge_enrichment_runs(runs: Sequence[DataFrame]) -> DataFrame:
    """(doc_id, features); a later run in the list overrides an earlier one."""
    numbered = [r.select("doc_id", "features", F.lit(i).alias("nth")) for i, r in enumerate(runs)]
    return (union_collections(numbered).groupBy("doc_id")
            .agg(F.max_by("features", "nth").alias("features")))


def list_enrichment_runs(spark: SparkSession, root: str, pattern: str = "*/metadata.json") -> DataFrame:
    schema = ("run_id string, collection string, model string, with_images boolean, started_at string, "
              "finished_at string, doc_count long, status string")
    return (spark.read.schema(schema).option("multiLine", True).json(f"{root}/{pattern}")
            .orderBy("run_id"))


def join_enrichment(docs: DataFrame, features: DataFrame, out: str = "text") -> DataFrame:
    """Features of a run replace a document's own as a whole, not field by field."""
    run = features.select("doc_id", F.col("features").alias("__run"))
    joined = docs.join(run, "doc_id", "left")
    if out in docs.columns:
        return joined.withColumn(out, F.coalesce(F.col("__run"), F.col(out))).drop("__run")
    return joined.withColumnRenamed("__run", out)


# --- Reference data --------------------------------------------------------------------------------

def read_pois(spark: SparkSession, directory: str, country: str | None = None) -> DataFrame:
    """(country, category, lat, lon) from JSON arrays of pairs, one array per line.

    The category is the file's name (`schools.json`, `bg_schools.json` for BG) or its
    folder's (`name=bg_schools/`); a name without prefix belongs to MT.
    """
    path = F.col("_metadata.file_path")
    name = F.coalesce(null_if_empty(F.regexp_extract(path, r"/name=([^/]+)/", 1)),
                      F.regexp_extract(path, r"/([^/]+)\.json$", 1))
    lines = (spark.read.option("recursiveFileLookup", True).text(directory)
             .select(name.alias("name"), F.from_json("value", "array<array<double>>").alias("ps")))
    prefix = r"^(bg|cy|hr)_"
    rows = lines.select(
        F.coalesce(F.upper(null_if_empty(F.regexp_extract("name", prefix, 1))), F.lit("MT")).alias("country"),
        F.regexp_replace("name", prefix, "").alias("category"), F.explode("ps").alias("p"))
    out = rows.select("country", "category", F.col("p")[0].alias("lat"), F.col("p")[1].alias("lon"))
    return out.filter(F.col("country") == country) if country else out


def read_populations(spark: SparkSession, path: str) -> DataFrame:
    """(country, city, population) from a nested JSON map; a city named twice keeps the
    figure of the country that comes last."""
    text = spark.read.option("wholetext", True).text(path)
    nested = F.from_json("value", "map<string,map<string,long>>")
    pairs = (text.select(F.posexplode(F.map_entries(nested)).alias("nth", "c"))
             .select("nth", F.col("c.key").alias("country"), F.explode("c.value").alias("city", "population")))
    return pairs.groupBy("city").agg(F.max_by(F.struct("country", "population"), "nth").alias("r")).select(
        "r.country", "city", "r.population")


def read_geocode_cache(spark: SparkSession, path: str) -> DataFrame:
    """(cache_key, found, lat, lon) from a JSON map whose null entries are misses."""
    text = spark.read.option("wholetext", True).text(path)
    entries = F.explode(F.from_json("value", "map<string,struct<lat:double,lon:double>>")).alias("cache_key", "v")
    return text.select(entries).select("cache_key", F.col("v").isNotNull().alias("found"),
                                       F.col("v.lat").alias("lat"), F.col("v.lon").alias("lon"))


def import_price_index(spark: SparkSession, csv: str, country: str) -> DataFrame:
    rows = spark.read.schema(PRICE_INDEX).option("header", True).csv(csv)
    return rows.filter(F.col("index_value").isNotNull()).select(F.lit(country.upper()).alias("country"), "*")


def read_jdbc_table(spark: SparkSession, url: str, table: str, partition_column: str, lower: int, upper: int,
                    partitions: int = 64, **options) -> DataFrame:
    """A relational table read in parallel slices of a numeric key."""
    return (spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=partition_column,
                                              lowerBound=str(lower), upperBound=str(upper),
                                              numPartitions=str(partitions), **options).load())


def migrate_relational_to_docs(properties: DataFrame, countries: DataFrame) -> DataFrame:
    """Flat rows as documents with two seed events; JSON text columns become arrays."""
    codes = countries.select(F.col("id").alias("country_id"), F.col("code").alias("__code"))
    rows = properties.join(codes, "country_id", "left")
    current = []
    for name in V.MIGRATED_FIELDS:
        if name in properties.columns:
            value = F.col(name)
            if name in V.JSON_TEXT_FIELDS and properties.schema[name].dataType == T.StringType():
                value = F.from_json(value, "array<string>")
            current.append(value.alias(name))

    def col(name):
        return F.col(name).cast("timestamp") if name in properties.columns else F.lit(None).cast("timestamp")

    first = F.coalesce(col("created_at"), col("scraped_at"))
    last = F.coalesce(col("scraped_at"), col("updated_at"), first)
    external = F.coalesce(null_if_empty("external_id"), F.col("id").cast("string")) \
        if "external_id" in properties.columns else F.col("id").cast("string")
    none = F.lit(None).cast("map<string,struct<old:string,new:string>>")
    note = F.create_map(F.lit("row_id"), F.struct(F.lit(None).cast("string").alias("old"),
                                                  F.col("id").cast("string").alias("new")))
    events = F.array(
        F.struct(first.alias("date"), F.lit("created").alias("event"), none.alias("changes")),
        F.struct(last.alias("date"), F.lit("migrated").alias("event"), note.alias("changes")))
    return rows.select(
        F.concat(F.col("source"), F.lit(":"), external).alias("_id"), "source",
        F.coalesce("__code", F.lit("")).alias("country"), first.alias("first_seen"), last.alias("last_seen"),
        F.struct(*current).alias("current"), events.alias("history"))
