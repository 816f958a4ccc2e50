"""Place names, centroids, geocode cache."""
from __future__ import annotations

from pyspark.sql import functions as F

from parcelgrid.checks.market import r
from parcelgrid.checks.registry import query
from parcelgrid.checks.scalars import haversine_sql
from parcelgrid.functions.common import round_even
from parcelgrid.operators import places as P

NAMES = {"Tas-Sliema": "sliema", "Il-Gżira": "gzira", "Iż-Żejtun": "zejtun", "Birżebbuġa": "birzebbuga", "San Ġiljan": "san giljan",
         "L-Imsida": "imsida", "Ir-Rabat": "rabat", "Zzz Nowhere": "zzz nowhere", "Sliema": "sliema"}
_CASE = "CASE place_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items()) + " ELSE '' END"
query("normalize_place_name", f"SELECT doc_id, {_CASE} AS value FROM texts", ("texts",))(
    lambda t: t.texts.select("doc_id", P.normalize_place_name("place_name").alias("value")))

# Nearest centroid among those allowed on the row's island.
_NEAREST = f"""spots AS (SELECT DISTINCT lat, lon FROM listings WHERE lat IS NOT NULL),
nearest AS (SELECT lat, lon, arg_min(locality, (d, locality)) AS nearest FROM (SELECT s.lat, s.lon, c.locality, {haversine_sql('s.lat', 's.lon', 'c.lat', 'c.lon')} AS d
  FROM spots s JOIN centroids c ON (s.lat > 36) = (c.locality LIKE 'Gozo%')) GROUP BY lat, lon)"""
query("nearest_centroid", f", {_NEAREST} SELECT doc_id, nearest FROM listings LEFT JOIN nearest USING (lat, lon)", ("listings", "centroids"))(
    lambda t: P.nearest_centroid(t.listings.select("doc_id", "lat", "lon"), t.centroids).select("doc_id", "nearest"))
_BY_NAME = {"Tas-Sliema": ("Sliema", "normalised"), "Il-Gżira": ("Gzira", "normalised"), "Iż-Żejtun": ("Zejtun", "normalised"),
            "Birżebbuġa": ("Birzebbuga", "normalised"), "San Ġiljan": ("St Julian''s", "alias"), "L-Imsida": ("Msida", "fuzzy"),
            "Ir-Rabat": ("Rabat", "normalised"), "Sliema": ("Sliema", "exact")}
_KEY = "CASE place_name " + " ".join(f"WHEN '{n}' THEN '{k}'" for n, (k, _) in _BY_NAME.items()) + " END"
_HOW = "CASE place_name " + " ".join(f"WHEN '{n}' THEN '{h}'" for n, (_, h) in _BY_NAME.items()) + " END"
query("resolve_locality", f""", {_NEAREST}, named AS (SELECT doc_id, lat, lon,
  CASE WHEN lat > 36 THEN CASE WHEN place_name = 'Ir-Rabat' THEN 'Gozo - Rabat' END WHEN lat IS NULL AND place_name = 'Ir-Rabat' THEN 'Gozo - Rabat' ELSE {_KEY} END AS k,
  CASE WHEN lat > 36 THEN CASE WHEN place_name = 'Ir-Rabat' THEN 'normalised' END ELSE {_HOW} END AS how FROM texts)
SELECT doc_id, COALESCE(k, nearest) AS locality, COALESCE(how, CASE WHEN nearest IS NOT NULL THEN 'nearest' END) AS method
FROM named LEFT JOIN nearest USING (lat, lon)""", ("texts", "centroids"))(
    lambda t: P.resolve_locality(t.texts.select("doc_id", "lat", "lon", F.col("place_name").alias("name")), t.centroids)
    .select("doc_id", "locality", "method"))
_CENT = f"SELECT locality, {r('median(lat)', 6)} AS lat, {r('median(lon)', 6)} AS lon FROM listings WHERE lat IS NOT NULL GROUP BY locality"
query("locality_centroids", _CENT)(lambda t: P.locality_centroids(t.listings))
query("encoder_localities", "SELECT DISTINCT locality AS key FROM listings")(
    lambda t: P.encoder_localities(t.listings.filter("listing_type = 'sale'"), t.listings.filter("listing_type = 'rent'")))
query("missing_keys", "SELECT DISTINCT locality AS key FROM listings WHERE locality NOT IN (SELECT locality FROM centroids)", ("listings", "centroids"))(
    lambda t: P.missing_keys(P.encoder_localities(t.listings, t.listings), t.centroids))


def _population(t):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("city")).agg(F.count("*").alias("population")) \
        .filter("length(city) < 9").unionByName(t.supplier.agg(F.lit("Sofia").alias("city"), F.count("*").alias("population")))


query("city_population", f"""
, pop AS (SELECT n_name AS city, count(*) AS population FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING length(n_name) < 9
  UNION ALL SELECT 'Sofia', count(*) FROM supplier)
SELECT doc_id, COALESCE(a.population, b.population)::DOUBLE AS city_population, {r('ln(COALESCE(a.population, b.population))', 6)} AS city_population_log
FROM listings l LEFT JOIN pop a ON a.city = l.locality LEFT JOIN pop b ON contains(l.locality, ',') AND b.city = trim(split_part(l.locality, ',', -1))""")(
    lambda t: P.city_population(t.listings.select("doc_id", "locality"), _population(t)).select(
        "doc_id", "city_population", round_even("city_population_log", 6).alias("city_population_log")))

# --- Geocode cache --------------------------------------------------------------------------------------
CACHE = ("listings", "text_features", "geocode_cache")
_REFS = """refs AS (SELECT f.doc_id, lower(trim(location_reference)) AS ref, trim(location_reference) AS original, locality AS context
  FROM text_features f JOIN listings l USING (doc_id) WHERE location_reference IS NOT NULL),
idx AS (SELECT ref, arg_min(original, doc_id) AS original, min(context) AS locality, count(DISTINCT context) AS n_localities, count(*) AS n FROM refs GROUP BY ref)"""


def index(t):
    return P.location_ref_index(t.text_features.select("doc_id", "location_reference"), t.listings)


query("location_ref_index", f", {_REFS} SELECT ref, original, locality, n_localities, CAST(n AS BIGINT) AS n FROM idx", CACHE)(
    lambda t: index(t))
query("location_ref_contexts", f""", {_REFS}, d AS (SELECT ref, context, (row_number() OVER (PARTITION BY ref ORDER BY context) - 1) // 3 AS piece FROM (SELECT DISTINCT ref, context FROM refs WHERE context IS NOT NULL))
SELECT ref, CAST(piece AS INT) AS piece, string_agg(context, '|' ORDER BY context) AS contexts, count(*) AS n FROM d GROUP BY ref, piece""", CACHE)(
    lambda t: P.location_ref_contexts(t.text_features.select("doc_id", "location_reference"), t.listings, 3).withColumn("contexts", F.concat_ws("|", "contexts")))
query("join_geocode_cache", f""", {_REFS} SELECT doc_id, CASE WHEN c.found IS NULL THEN 'uncached' WHEN c.found THEN 'found' ELSE 'not_found' END AS status, c.lat, c.lon
FROM refs LEFT JOIN geocode_cache c ON c.cache_key = concat(ref, '|', context)""", CACHE)(
    lambda t: P.join_geocode_cache(
        P.location_refs(t.text_features, t.listings).select("doc_id", P.cache_key("ref", "context").alias("cache_key")), t.geocode_cache)
    .select("doc_id", "status", "lat", "lon"))
query("uncached_refs", f", {_REFS} SELECT DISTINCT concat(ref, '|', context) AS cache_key FROM refs WHERE concat(ref, '|', context) NOT IN (SELECT cache_key FROM geocode_cache)", CACHE)(
    lambda t: P.uncached_refs(P.location_refs(t.text_features, t.listings).select(P.cache_key("ref", "context").alias("cache_key")), t.geocode_cache))
query("geocode_stats", f""", {_REFS} SELECT CASE WHEN c.found IS NULL THEN 'uncached' WHEN c.found THEN 'found' ELSE 'not_found' END AS status, count(*) AS n
FROM idx LEFT JOIN geocode_cache c ON c.cache_key = concat(ref, '|', locality) GROUP BY 1""", CACHE)(
    lambda t: P.geocode_stats(index(t), t.geocode_cache))
query("top_refs", f""", {_REFS} SELECT original, n, CASE WHEN c.found IS NULL THEN 'uncached' WHEN c.found THEN 'found' ELSE 'not_found' END AS status, c.lat, c.lon
FROM (SELECT * FROM idx ORDER BY n DESC, ref LIMIT 20) i LEFT JOIN geocode_cache c ON c.cache_key = concat(ref, '|', locality)""", CACHE)(
    lambda t: P.top_refs(index(t), t.geocode_cache))
query("apply_geocode", """
, c AS (SELECT locality, min(lat) AS lat, min(lon) AS lon FROM listings WHERE country = 'BG' AND length(locality) % 2 = 0 GROUP BY locality)
SELECT doc_id, COALESCE(c.lat, t.lat) AS lat, COALESCE(c.lon, t.lon) AS lon FROM texts t LEFT JOIN c ON t.locality = c.locality""", ("texts",))(
    lambda t: P.apply_geocode(t.texts.select("doc_id", "locality", "address_raw", "lat", "lon"), t.listings.filter("country = 'BG' AND length(locality) % 2 = 0")
                              .groupBy(F.concat("locality", F.lit("|Sofia")).alias("cache_key")).agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
                              .withColumn("found", F.lit(True))).select("doc_id", "lat", "lon"))
query("centroid_locality_join", """
, d AS (SELECT doc_id, CASE WHEN ok % 3 = 0 THEN lat END AS lat, CASE WHEN ok % 3 = 0 THEN lon END AS lon,
  CASE pk % 7 WHEN 0 THEN 'Swatar' WHEN 1 THEN 'Rabat (Gozo)' WHEN 2 THEN '*Outside Malta' WHEN 3 THEN 'Sliema' WHEN 4 THEN 'Nowhere' WHEN 5 THEN 'Qawra' ELSE locality END AS locality FROM listings),
x AS (SELECT d.*, CASE locality WHEN 'Swatar' THEN 'Msida' WHEN 'Rabat (Gozo)' THEN 'Gozo - Victoria' ELSE locality END AS target FROM d)
SELECT doc_id, CASE WHEN x.lat IS NOT NULL THEN x.lat WHEN x.locality = 'Nowhere' THEN 35.25 ELSE c.lat END::DOUBLE AS lat,
  CASE WHEN x.lat IS NOT NULL THEN x.lon WHEN x.locality = 'Nowhere' THEN 14.25 ELSE c.lon END::DOUBLE AS lon FROM x LEFT JOIN centroids c ON c.locality = x.target""",
      ("listings", "centroids"))(
    lambda t: P.centroid_locality_join(
        t.listings.select("doc_id", F.when(F.col("ok") % 3 == 0, F.col("lat")).alias("lat"), F.when(F.col("ok") % 3 == 0, F.col("lon")).alias("lon"),
                          F.expr("CASE pk % 7 WHEN 0 THEN 'Swatar' WHEN 1 THEN 'Rabat (Gozo)' WHEN 2 THEN '*Outside Malta' WHEN 3 THEN 'Sliema' "
                                 "WHEN 4 THEN 'Nowhere' WHEN 5 THEN 'Qawra' ELSE locality END").alias("locality")),
        t.centroids, cache=t.spark.range(1).select(F.lit("nowhere|").alias("cache_key"), F.lit(True).alias("found"), F.lit(35.25).alias("lat"), F.lit(14.25).alias("lon")))
    .select("doc_id", "lat", "lon"))
