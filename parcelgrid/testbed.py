"""Listing tables derived from the star-schema tables by portable SQL.

The same statements, with `STRING` in place of `VARCHAR`, run in Spark and in a
SQL database, so results can be compared table by table.
"""
from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelgrid import testbed_texts as texts

LISTINGS = """
SELECT
  concat(CASE l_suppkey % 3 WHEN 0 THEN 'mt_api' WHEN 1 THEN 'mt_class' ELSE 'bg_board' END, ':',
         CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR), '-',
         CAST(l_partkey AS VARCHAR), '-', CAST(l_suppkey AS VARCHAR)) AS doc_id,
  l_orderkey AS ok, l_partkey AS pk,
  CASE l_suppkey % 3 WHEN 0 THEN 'mt_api' WHEN 1 THEN 'mt_class' ELSE 'bg_board' END AS source,
  CASE WHEN l_suppkey % 3 = 2 THEN 'BG' ELSE 'MT' END AS country,
  concat(n_name, CASE WHEN l_suppkey % 3 = 2 THEN ', Sofia' ELSE '' END) AS locality,
  CASE p_type WHEN 'ECONOMY' THEN 'apartment' WHEN 'STANDARD' THEN 'apartment'
              WHEN 'MEDIUM' THEN 'penthouse' WHEN 'SMALL' THEN 'studio'
              WHEN 'LARGE' THEN 'house' ELSE 'other' END AS property_type,
  CASE WHEN l_returnflag = 'R' THEN 'rent' ELSE 'sale' END AS listing_type,
  CASE WHEN l_orderkey % 97 = 0 THEN NULL
       WHEN l_orderkey % 89 = 0 THEN CAST(1 AS DOUBLE)
       WHEN l_orderkey % 83 = 0 THEN CAST(20000000 AS DOUBLE)
       WHEN l_returnflag = 'R' THEN CAST(floor(l_extendedprice / 1000) * 25 + 300 AS DOUBLE)
       ELSE CAST(floor(l_extendedprice / 2000) * 10000 + 40000 AS DOUBLE) END AS price_eur,
  CASE WHEN l_orderkey % 11 = 0 THEN NULL WHEN l_orderkey % 53 = 0 THEN CAST(1 AS DOUBLE)
       ELSE CAST(p_size * 3 + 20 AS DOUBLE) END AS area_sqm,
  CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE 1 + p_size % 5 END AS bedrooms,
  CASE WHEN l_orderkey % 41 = 0 THEN NULL
       WHEN l_suppkey % 3 = 2 THEN (4120000 + (l_orderkey * 7919) % 300000) / 100000
       ELSE (3580000 + (l_orderkey * 7919) % 30000) / 100000 END AS lat,
  CASE WHEN l_orderkey % 41 = 0 THEN NULL
       WHEN l_suppkey % 3 = 2 THEN (2235000 + (l_partkey * 104729) % 600000) / 100000
       ELSE (1418000 + (l_partkey * 104729) % 40000) / 100000 END AS lon,
  concat(p_name, ' in ', n_name, CASE WHEN l_partkey % 29 = 0 THEN ' - wanted' ELSE '' END) AS title,
  CASE WHEN l_suppkey % 23 = 0 THEN 'short text'
       ELSE concat('Bright ', p_name, ' by ', s_name, ' near ', n_name) END AS description,
  l_shipdate AS first_seen,
  l_shipdate + INTERVAL 30 DAY AS last_seen,
  l_orderkey % 31 <> 0 AS is_active
FROM lineitem JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
"""

BATCH1 = "SELECT * FROM listings WHERE ok % 10 <> 3"

BATCH2 = """
SELECT doc_id, ok, pk, source, country, locality, property_type, listing_type,
  CASE WHEN ok % 5 = 0 THEN CAST(floor(price_eur * 0.95) AS DOUBLE) ELSE price_eur END AS price_eur,
  area_sqm, bedrooms, lat, lon,
  CASE WHEN ok % 7 = 0 THEN concat(title, ' (updated)') ELSE title END AS title,
  description, first_seen, last_seen + INTERVAL 14 DAY AS last_seen,
  CASE WHEN ok % 13 = 0 THEN FALSE ELSE is_active END AS is_active
FROM listings WHERE ok % 10 <> 7
"""

POIS = """
SELECT c_custkey AS poi_id,
  CASE c_custkey % 5 WHEN 0 THEN 'schools' WHEN 1 THEN 'restaurants' WHEN 2 THEN 'cafes'
                     WHEN 3 THEN 'hospitals' ELSE 'parks' END AS category,
  (3580000 + (c_custkey * 6571) % 30000) / 100000 AS lat,
  (1418000 + (c_custkey * 9973) % 40000) / 100000 AS lon
FROM customer
"""

REQUESTS = """
SELECT o_orderkey AS request_id, o_custkey AS user_id, 'MT' AS country,
  (3580000 + (o_orderkey * 4729) % 30000) / 100000 AS lat,
  (1418000 + (o_custkey * 7907) % 40000) / 100000 AS lon,
  'apartment' AS property_type,
  CASE WHEN o_orderstatus = 'F' THEN 'rent' ELSE 'sale' END AS listing_type,
  CAST(40 + o_orderkey % 120 AS DOUBLE) AS area_sqm, o_orderdate AS requested_at
FROM orders
"""

LLM_TEXT = """
SELECT doc_id,
  CASE WHEN ok % 50 = 0 THEN 'not json'
       ELSE concat(CASE WHEN ok % 3 = 0 THEN concat('```json', chr(10)) ELSE '' END,
         '{"condition": ', CAST(ok % 8 AS VARCHAR), ', "construction_status": "',
         CASE ok % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'off_plan' ELSE 'unknown' END,
         '", "quality_tier": "',
         CASE ok % 4 WHEN 0 THEN 'budget' WHEN 1 THEN 'standard' WHEN 2 THEN 'premium' ELSE 'luxury' END,
         '", "actual_living_area": ',
         CASE WHEN ok % 6 = 0 THEN CAST(25 + pk % 90 AS VARCHAR) ELSE 'null' END, '}',
         CASE WHEN ok % 3 = 0 THEN concat(chr(10), '```') ELSE '' END) END AS response
FROM listings
"""

# Text-derived features as plain columns: what a correct parse of LLM_TEXT gives.
TEXT_FEATURES = """
SELECT doc_id, CAST(greatest(1, least(5, ok % 8)) AS BIGINT) AS condition,
  CASE ok % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'off_plan' ELSE 'unknown' END AS construction_status,
  CASE ok % 4 WHEN 0 THEN 'budget' WHEN 1 THEN 'standard' WHEN 2 THEN 'premium' ELSE 'luxury' END AS quality_tier,
  CASE WHEN ok % 6 = 0 THEN CAST(25 + pk % 90 AS BIGINT) END AS actual_living_area,
  CASE WHEN ok % 4 = 1 THEN concat('near ', title) END AS location_reference
FROM listings WHERE ok % 50 <> 0
"""

# The relational twin: flat properties, countries, regions.
COUNTRIES = """
SELECT 1 AS id, 'MT' AS code, 'Malta' AS name UNION ALL SELECT 2, 'BG', 'Bulgaria'
"""
REGIONS = """
SELECT n_nationkey + 1 AS id, 1 + n_nationkey % 2 AS country_id, n_name AS name FROM nation
"""
PROPERTIES = """
SELECT doc_id AS id, CASE country WHEN 'MT' THEN 1 ELSE 2 END AS country_id,
  CASE WHEN ok % 17 = 0 THEN NULL ELSE CAST(1 + pk % 25 AS INT) END AS region_id,
  source, locality, title, lat, lon, property_type, listing_type, area_sqm, bedrooms,
  CASE WHEN ok % 9 = 0 THEN NULL ELSE CAST(ok % 12 AS INT) END AS floor,
  CAST(1 + bedrooms AS INT) AS rooms,
  CASE WHEN pk % 5 = 0 THEN NULL ELSE CAST(1950 + pk % 70 AS INT) END AS year_built,
  CASE ok % 6 WHEN 0 THEN 'new' WHEN 1 THEN 'excellent' WHEN 2 THEN 'good'
              WHEN 3 THEN 'needs_renovation' WHEN 4 THEN 'shell' END AS condition,
  CASE WHEN pk % 7 = 0 THEN NULL ELSE pk % 2 = 0 END AS has_parking,
  CASE WHEN ok % 4 = 0 THEN 'transaction' ELSE 'asking' END AS price_type,
  price_eur,
  CASE WHEN price_eur IS NULL THEN NULL WHEN ok % 4 = 0 THEN price_eur
       ELSE round_even_2(price_eur * CASE country WHEN 'MT' THEN CAST(0.97 AS DOUBLE) ELSE CAST(0.93 AS DOUBLE) END)
       END AS price_adjusted_eur,
  first_seen AS created_at, last_seen AS scraped_at, is_active
FROM listings
"""

# Named places with a position, one per nation, on both islands.
CENTROIDS = """
SELECT CASE n_nationkey WHEN 0 THEN 'Sliema' WHEN 1 THEN 'Gzira' WHEN 2 THEN 'Zejtun' WHEN 3 THEN 'Birzebbuga' WHEN 4 THEN 'St Julian''s'
       WHEN 5 THEN 'Msida' WHEN 6 THEN 'Rabat' WHEN 7 THEN 'Gozo - Rabat' WHEN 8 THEN 'Gozo - Victoria' WHEN 9 THEN 'Gozo - Qala'
       ELSE n_name END AS locality,
  (3580000 + n_nationkey * 7919 % 20000 + CASE WHEN n_nationkey IN (7, 8, 9) THEN 25000 ELSE 0 END) / 100000 AS lat,
  (1418000 + n_nationkey * 104729 % 40000) / 100000 AS lon FROM nation
"""
# A geocode cache with hits, remembered misses and gaps.
GEOCODE_CACHE = """
SELECT concat('near ', lower(title), '|', locality) AS cache_key, length(title) % 3 <> 0 AS found,
  CASE WHEN length(title) % 3 <> 0 THEN CAST(30 + length(title) AS DOUBLE) END AS lat,
  CASE WHEN length(title) % 3 <> 0 THEN CAST(14 AS DOUBLE) END AS lon
FROM (SELECT DISTINCT title, locality FROM listings) d WHERE length(title) % 5 <> 0
"""

STATEMENTS = {
    "centroids": CENTROIDS, "geocode_cache": GEOCODE_CACHE,
    "listings": LISTINGS, "batch1": BATCH1, "batch2": BATCH2, "pois": POIS,
    "requests": REQUESTS, "llm_text": LLM_TEXT, "text_features": TEXT_FEATURES,
    "countries": COUNTRIES, "regions": REGIONS, "properties": PROPERTIES,
    "texts": texts.TEXTS, "api_raw": texts.API_RAW, "portal_pages": texts.PORTAL_PAGES,
    "card_pages": texts.CARD_PAGES, "detail_pages": texts.DETAIL_PAGES,
}
NEEDS = {
    "centroids": (), "geocode_cache": ("listings",),
    "listings": (), "batch1": ("listings",), "batch2": ("listings",), "pois": (),
    "requests": (), "llm_text": ("listings",), "text_features": ("listings",),
    "countries": (), "regions": (), "properties": ("listings",), "texts": ("listings",),
    "api_raw": ("texts",), "portal_pages": ("texts",), "card_pages": ("texts",), "detail_pages": ("texts",),
}
BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")


def _round_calls(sql: str, dialect: str) -> str:
    """Writes `round_even_2(x)` in the dialect's own words."""
    out, mark = sql, "round_even_2("
    while mark in out:
        start = out.index(mark)
        depth, i = 1, start + len(mark)
        while depth:
            depth += {"(": 1, ")": -1}.get(out[i], 0)
            i += 1
        inner = out[start + len(mark):i - 1]
        fn = f"rint(({inner}) * 100)" if dialect == "spark" else f"round_even(({inner}) * 100, 0)"
        out = f"{out[:start]}({fn} / 100){out[i:]}"
    return out


def statement(name: str, dialect: str) -> str:
    sql = _round_calls(STATEMENTS[name], dialect)
    if dialect == "spark":
        sql = sql.replace("AS VARCHAR", "AS STRING")
    return sql


def with_clause(*names: str) -> str:
    """`WITH` prefix that defines the named tables, and what they need, for a database."""
    order: list[str] = []

    def add(name):
        for need in NEEDS[name]:
            add(need)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({statement(n, 'duckdb')})" for n in order) + "\n"


SPREAD_KEYS = {"lineitem": ("l_orderkey", "l_linenumber", "l_partkey"), "orders": ("o_orderkey",), "events": ("event_id",)}


SPREAD_BYTES = 16 << 20  # a task's share of a table that its own splits keep all tasks busy with


@lru_cache(maxsize=64)
def _size(spark: SparkSession, path: str, files: int) -> int:
    """Bytes of a table's files, from one listing."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.sum("length")).first()[0] or 0


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table.  A fact table that is a few small files is spread over all
    tasks; one of many files, or of large ones that Spark splits, already is, and is not shuffled."""
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    tasks = spark.sparkContext.defaultParallelism
    files = len(df.inputFiles()) if name in SPREAD_KEYS else tasks
    if files < tasks and _size(spark, path, files) < tasks * SPREAD_BYTES:
        df = df.repartition(tasks, *SPREAD_KEYS[name])
    return df


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a lazy plan over the parquet inputs."""
    def inputs():
        if NEEDS[name]:
            return {n: derived(spark, sf_dir, n) for n in NEEDS[name]}
        return {n: base(spark, sf_dir, n) for n in BASE_TABLES if n in STATEMENTS[name]}

    frames = inputs()
    sql = statement(name, "spark")
    return spark.sql(_with_placeholders(sql, frames), **frames)


def _with_placeholders(sql: str, frames) -> str:
    sql = sql.replace("{", "{{").replace("}", "}}")
    for n in frames:
        sql = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", sql)
    return sql
