"""Market statistics, browsing, search, set operations and work lists."""
from __future__ import annotations


from pyspark.sql import functions as F

from parcelgrid.checks.registry import query
from parcelgrid.functions.common import round_even
from parcelgrid.operators import market as M
from parcelgrid.operators.ranking import dense_positions
from parcelgrid.operators import yields as Y
from parcelgrid.operators.ranking import top_k_per_probe
from parcelgrid.sources.collections import union_collections

PROPS = ("properties", "countries", "regions")


def r(expr: str, digits: int) -> str:
    if digits < 0:
        return f"round_even(({expr}) / {10 ** -digits}, 0) * {10 ** -digits}"
    return f"round_even(({expr}) * {10 ** digits}, 0) / {10 ** digits}"


# --- Summaries -----------------------------------------------------------------------------
query("list_collections", "SELECT DISTINCT source FROM listings")(lambda t: M.list_collections(t.listings))
query("collection_summary", f"""
SELECT source, count(*) AS n, count(price_eur) FILTER (price_eur <> 0) AS n_price, count(*) FILTER (lat <> 0) AS n_coords,
  count(*) FILTER (area_sqm <> 0) AS n_area, count(*) FILTER (description <> '') AS n_description, 0::BIGINT AS n_images,
  count(*) FILTER (locality <> '') AS n_locality, {r('avg(price_eur)', 4)} AS avg_price FROM listings GROUP BY source""")(
    lambda t: M.collection_summary(t.listings).withColumn("avg_price", round_even("avg_price", 4)))
query("country_price_stats", f"""
SELECT country, count(*) AS n, {r('avg(price_eur)', 4)} AS avg_price, min(price_eur) AS min_price, max(price_eur) AS max_price
FROM listings WHERE price_eur > 0 GROUP BY country""")(
    lambda t: M.country_price_stats(t.listings).withColumn("avg_price", round_even("avg_price", 4)))
_BY = "SELECT '{0}' AS \"by\", {0} AS name, count(*) AS n, {1} AS avg_price, min(price_eur) AS min_price, max(price_eur) AS max_price FROM listings WHERE price_eur > 0 GROUP BY {0}"
_AVG = r("avg(price_eur)", 4)
query("market_stats", f"""
SELECT * FROM ({_BY.format('locality', _AVG)} ORDER BY n DESC, name LIMIT 30) UNION ALL {_BY.format('property_type', _AVG)}
UNION ALL {_BY.format('country', _AVG)}""")(
    lambda t: M.market_stats(t.listings).withColumn("avg_price", round_even("avg_price", 4)))
query("api_market_stats", f"""
SELECT 'MT' AS country_code, count(*) AS total_properties, {r('avg(price_adjusted_eur)', 2)} AS avg_price_eur,
  {r('avg(price_adjusted_eur / nullif(area_sqm, 0))', 2)} AS avg_price_per_sqm, min(price_adjusted_eur) AS min_price_eur, max(price_adjusted_eur) AS max_price_eur
FROM properties WHERE country_id = 1 AND is_active AND price_adjusted_eur IS NOT NULL""", PROPS)(
    lambda t: M.api_market_stats(t.properties, t.countries, "mt"))
query("region_heatmap", f"""
SELECT r.name, {r('avg(price_adjusted_eur / nullif(area_sqm, 0))', 2)} AS avg_price_per_sqm, count(*) AS n
FROM properties p JOIN regions r ON p.region_id = r.id WHERE is_active AND price_adjusted_eur IS NOT NULL GROUP BY r.name""", PROPS)(
    lambda t: M.region_heatmap(t.regions, t.properties))
query("regions_join", """
SELECT p.id, r.name AS region_name, price_adjusted_eur FROM properties p JOIN regions r ON p.region_id = r.id
WHERE is_active AND price_adjusted_eur IS NOT NULL""", PROPS)(
    lambda t: M.regions_join(t.regions, t.properties).select("id", "region_name", "price_adjusted_eur"))


def _price_index(t):
    """Quarterly mean sale price per country, the shape of an imported index."""
    ts = F.col("first_seen")
    year = F.year(ts)
    return (t.listings.filter("listing_type = 'sale' AND price_eur IS NOT NULL")
            .groupBy("country", year.alias("year"), F.concat(year.cast("string"), F.lit("Q"), F.quarter(ts).cast("string")).alias("quarter"))
            .agg(round_even(F.avg("price_eur"), 2).alias("index_value")).withColumn("source", F.lit("derived")))


query("latest_index", f"""
, idx AS (SELECT country, year(first_seen) AS y, concat(CAST(year(first_seen) AS VARCHAR), 'Q', CAST(quarter(first_seen) AS VARCHAR)) AS quarter,
  {r('avg(price_eur)', 2)} AS value FROM listings WHERE listing_type = 'sale' AND price_eur IS NOT NULL GROUP BY ALL)
SELECT country, quarter, value, 'derived' AS source FROM idx QUALIFY row_number() OVER (PARTITION BY country ORDER BY y DESC, quarter DESC) = 1""")(
    lambda t: M.latest_index(_price_index(t)))
query("value_counts", "SELECT locality AS value, count(*) AS n FROM listings GROUP BY locality ORDER BY n DESC, value LIMIT 10")(
    lambda t: M.value_counts(t.listings, "locality", 10))
query("filter_options", "SELECT DISTINCT property_type AS value FROM listings")(lambda t: M.filter_options(t.listings, "property_type"))
query("vat_crosstab", f"""
, x AS (SELECT construction_status, CASE ok % 3 WHEN 0 THEN 'excluded' WHEN 1 THEN 'included' ELSE 'unknown' END AS v
  FROM listings JOIN text_features USING (doc_id) WHERE property_type = 'apartment' AND construction_status IN ('completed', 'under_construction', 'off_plan'))
SELECT construction_status, count(*) AS n, count(*) FILTER (v = 'excluded') AS excluded, count(*) FILTER (v = 'included') AS included,
  count(*) FILTER (v = 'unknown') AS unknown, {r("count(*) FILTER (v = 'excluded') / count(*) * 100", 2)} AS excluded_pct,
  {r("count(*) FILTER (v = 'included') / count(*) * 100", 2)} AS included_pct, {r("count(*) FILTER (v = 'unknown') / count(*) * 100", 2)} AS unknown_pct
FROM x GROUP BY construction_status""", ("listings", "text_features"))(
    lambda t: M.vat_crosstab(t.listings.withColumn("vat_status", F.when(F.col("ok") % 3 == 0, "excluded").when(F.col("ok") % 3 == 1, "included").otherwise("unknown")),
                             t.text_features))

# --- Browse, search, pages -------------------------------------------------------------------
query("browse_filter", """
SELECT doc_id FROM listings WHERE (lower(title) LIKE '%red%' OR lower(locality) LIKE '%red%' OR lower(description) LIKE '%red%')
  AND listing_type = 'sale' AND COALESCE(price_eur, 0) >= 100000 AND (price_eur IS NULL OR price_eur <= 300000)""")(
    lambda t: M.browse_filter(t.listings, "Red", listing_type="sale", min_price=100000, max_price=300000).select("doc_id"))
query("browse_sort", """
SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN price_eur <> 0 THEN price_eur END ASC NULLS LAST, doc_id) AS price_asc,
  row_number() OVER (ORDER BY CASE WHEN price_eur <> 0 THEN price_eur ELSE 0 END DESC, doc_id) AS price_desc,
  row_number() OVER (ORDER BY COALESCE(area_sqm, 0) DESC, doc_id) AS area_desc,
  row_number() OVER (ORDER BY last_seen DESC NULLS LAST, doc_id) AS newest FROM listings""")(lambda t: _numbered(t.listings))


def _numbered(df):
    """Place of every row under each of the four orders, so that order itself is compared."""
    placed = None
    for sort in ("price_asc", "price_desc", "area_desc", "newest"):
        shown = df.select("doc_id", {"area_desc": "area_sqm", "newest": "last_seen"}.get(sort, "price_eur"))
        places = dense_positions(shown, M.browse_order(sort), sort).select("doc_id", (F.col(sort) + 1).alias(sort))
        placed = places if placed is None else placed.join(places.hint("merge"), "doc_id")
    return placed


query("paginate", """
SELECT doc_id, count(*) OVER () AS total, CAST(ceil(count(*) OVER () / 24.0) AS BIGINT) AS pages FROM listings
WHERE property_type = 'studio' ORDER BY COALESCE(area_sqm, 0) DESC, doc_id LIMIT 24 OFFSET 48""")(lambda t: _page(t))


def _page(t):
    rows, total, pages = M.paginate(M.browse_sort(M.browse_filter(t.listings, prop_type="studio"), "area_desc"), 3)
    return rows.select("doc_id", F.lit(total).cast("long").alias("total"), F.lit(pages).cast("long").alias("pages"))


query("indexed_page", """
SELECT doc_id, count(*) OVER () AS total, CAST(ceil(count(*) OVER () / 24.0) AS BIGINT) AS pages FROM listings
ORDER BY CASE WHEN price_eur <> 0 THEN price_eur END ASC NULLS LAST, doc_id LIMIT 24 OFFSET 4800""")(lambda t: _deep_page(t))


def _deep_page(t):
    rows, total, pages = M.indexed_page(M.page_index(t.listings, "price_asc"), 201)
    return rows.select("doc_id", F.lit(total).cast("long").alias("total"), F.lit(pages).cast("long").alias("pages"))


query("search_filter", """
SELECT doc_id FROM listings WHERE lower(concat_ws(' ', title, locality, description, property_type)) LIKE '%nation_7 bright%' AND country = 'MT'""")(
    lambda t: M.search_filter(t.listings, "NATION_7 Bright", "mt").select("doc_id"))
query("search_top", """
SELECT doc_id, price_eur FROM listings WHERE lower(concat_ws(' ', title, locality, description, property_type)) LIKE '%widget%'
ORDER BY COALESCE(price_eur, 0) DESC, doc_id LIMIT 100""")(
    lambda t: M.search_top(M.search_filter(t.listings, "widget")).select("doc_id", "price_eur"))
query("bbox_filter", """
SELECT id, price_adjusted_eur FROM properties WHERE lat > 35.85 AND lat < 36.0 AND lon > 14.3 AND lon < 14.5 AND is_active
  AND property_type = 'apartment' AND price_adjusted_eur >= 100000""", ("properties",))(
    lambda t: M.bbox_filter(t.properties, 35.85, 36.0, 14.3, 14.5, "apartment", 100000, limit=None).select("id", "price_adjusted_eur"))
query("property_lookup", f"""
SELECT id, country_code, price_eur, price_per_sqm FROM (SELECT p.id, c.code AS country_code,
  CASE WHEN price_adjusted_eur <> 0 THEN price_adjusted_eur ELSE price_eur END AS price_eur,
  CASE WHEN price_adjusted_eur <> 0 AND area_sqm <> 0 THEN {r('price_adjusted_eur / area_sqm', 2)} END AS price_per_sqm
  FROM properties p JOIN countries c ON p.country_id = c.id) WHERE id = (SELECT min(id) FROM properties)""", PROPS)(
    lambda t: _lookup(t))


def _lookup(t):
    return M.property_lookup(t.properties, t.countries, t.properties.agg(F.min("id")).scalar()).select(
        "id", "country_code", "price_eur", "price_per_sqm")


query("valuation_history", """
SELECT request_id AS id, user_id, requested_at AS created_at FROM requests WHERE user_id = (SELECT max(user_id) FROM requests)
ORDER BY created_at DESC, id DESC LIMIT 200""", ("requests",))(
    lambda t: M.valuation_history(
        t.requests.select(F.col("request_id").alias("id"), "user_id", F.col("requested_at").alias("created_at")),
        t.requests.agg(F.max("user_id")).scalar()))
query("top_k_per_probe", """
SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY price_eur DESC NULLS LAST, doc_id) AS rank FROM listings
QUALIFY rank <= 10""")(
    lambda t: top_k_per_probe(t.listings, "source", [F.desc_nulls_last("price_eur"), "doc_id"], 10)
    .select("source", "doc_id", F.col("rank").cast("long").alias("rank")))

# --- Set operations ------------------------------------------------------------------------------
query("union_collections", "SELECT doc_id, source, price_eur FROM listings")(
    lambda t: union_collections([t.listings.filter(F.col("source") == s).select("doc_id", "source", "price_eur")
                                 for s in ("mt_api", "mt_class", "bg_board")]))


# --- Work lists -----------------------------------------------------------------------------------
query("stale_filter", "SELECT doc_id FROM listings WHERE epoch(TIMESTAMP '1998-05-24') - epoch(date_trunc('second', last_seen)) > 20 * 3600")(
    lambda t: M.stale_filter(t.listings, "1998-05-24 00:00:00").select("doc_id"))
query("needs_enrichment", """
SELECT doc_id FROM listings WHERE description <> '' AND doc_id NOT IN (SELECT doc_id FROM text_features)""", ("listings", "text_features"))(
    lambda t: M.needs_enrichment(t.listings, t.text_features).select("doc_id"))
query("needs_backfill", """
SELECT doc_id FROM texts WHERE ok % 4 = 3 OR pk % 3 = 0""", ("texts",))(
    lambda t: M.needs_backfill(t.texts.withColumn("vat_status", F.when(F.col("ok") % 4 != 3, "x")),
                               t.texts.filter("pk % 3 <> 0").select("doc_id")).select("doc_id"))
query("coords_pending", """
SELECT source, count(*) AS n, count(*) FILTER (ok % 3 = 0) AS n_precise, count(*) FILTER (ok % 3 <> 0) AS n_pending FROM texts GROUP BY source""", ("texts",))(
    lambda t: M.coords_coverage(t.texts.withColumn("map_lat", F.when(F.col("ok") % 3 == 0, 41.5))))
query("coords_pending_rows", "SELECT doc_id FROM texts WHERE ok % 3 <> 0", ("texts",))(
    lambda t: M.coords_pending(t.texts.withColumn("map_lat", F.when(F.col("ok") % 3 == 0, 41.5))).select("doc_id"))

# --- Yields that need no model -----------------------------------------------------------------------
_RENTALS = "SELECT trim(split_part(address_raw, ',', -1)) AS city, count(*) AS n FROM texts WHERE listing_type = 'rent' AND property_type = 'apartment' GROUP BY 1"
query("city_rental_counts", _RENTALS, ("texts",))(lambda t: Y.city_rental_counts(t.texts))
query("min_rentals_filter", f"""
SELECT doc_id FROM texts WHERE listing_type = 'sale' AND CASE WHEN contains(locality, ',') THEN trim(split_part(locality, ',', -1)) ELSE locality END IN
  (SELECT city FROM ({_RENTALS}) WHERE n >= 100)""", ("texts",))(
    lambda t: Y.min_rentals_filter(t.texts.filter("listing_type = 'sale'"), t.texts, 100).select("doc_id"))
_YIELD = ("yields AS (SELECT s.doc_id, s.locality, s.price_eur, " + r("rent * 12 / s.price_eur * 100", 2) + " AS gross_yield FROM listings s JOIN "
          "(SELECT locality, avg(price_eur) AS rent FROM listings WHERE listing_type = 'rent' AND price_eur > 0 GROUP BY locality) USING (locality) "
          "WHERE listing_type = 'sale' AND price_eur > 0)")


def yields_table(t):
    """Sale listings with the yield from their locality's mean rent."""
    rents = t.listings.filter("listing_type = 'rent' AND price_eur > 0").groupBy("locality").agg(F.avg("price_eur").alias("rent"))
    return (t.listings.filter("listing_type = 'sale' AND price_eur > 0").join(rents, "locality")
            .select("doc_id", "locality", "price_eur", Y.gross_yield("rent", "price_eur").alias("gross_yield")))


query("gross_yield", f", {_YIELD} SELECT doc_id, gross_yield FROM yields")(lambda t: yields_table(t).select("doc_id", "gross_yield"))
_CITY = "CASE WHEN contains(locality, ',') THEN trim(split_part(locality, ',', -1)) ELSE locality END"
query("yield_by_city", f""", {_YIELD} SELECT {_CITY} AS city, {r('median(gross_yield)', 6)} AS median_yield, count(*) AS n FROM yields GROUP BY 1 HAVING count(*) >= 10""")(
    lambda t: Y.yield_by_city(yields_table(t)).withColumn("median_yield", round_even("median_yield", 6)))
query("yield_summary", f""", {_YIELD} SELECT {r('median(gross_yield)', 6)} AS median_yield, {r('avg(gross_yield)', 4)} AS mean_yield,
  {r('quantile_cont(gross_yield, 0.75)', 6)} AS p75_yield, count(*) AS n FROM yields""")(
    lambda t: Y.yield_summary(yields_table(t)).select(
        round_even("median_yield", 6).alias("median_yield"), round_even("mean_yield", 4).alias("mean_yield"),
        round_even("p75_yield", 6).alias("p75_yield"), "n"))
query("investable_filter", """
SELECT l.doc_id FROM listings l JOIN text_features f USING (doc_id) WHERE construction_status = 'completed' AND condition >= 3 AND (ok % 4 = 0 OR pk % 500 <= 365)""",
      ("listings", "text_features"))(
    lambda t: Y.investable_filter(t.listings.join(t.text_features, "doc_id").select(
        "doc_id", F.col("condition").cast("double").alias("llm_condition"),
        F.when(F.col("construction_status") == "completed", 3.0).otherwise(0.0).alias("llm_construction_status"),
        F.when(F.col("ok") % 4 != 0, F.col("pk") % 500).alias("listing_age_days"))).select("doc_id"))
query("yield_warnings", """
SELECT doc_id, concat_ws(' ', CASE WHEN ok % 4 = 0 THEN '⚠ +VAT' END, CASE WHEN pk % 3 = 0 THEN '⚠ renders' END, CASE WHEN pk % 3 = 1 THEN '⚠ area' END,
  CASE WHEN ok % 500 > 365 THEN concat('⚠ ', CAST(ok % 500 AS VARCHAR), 'd old') END) AS warnings FROM listings""")(
    lambda t: (lambda d: d.select("doc_id", Y.yield_warnings(d).alias("warnings")))(t.listings.select(
        "doc_id", F.when(F.col("ok") % 4 == 0, "excluded").otherwise("included").alias("vat_status"),
        F.when(F.col("pk") % 3 == 0, "3D Render only").when(F.col("pk") % 3 == 1, "Includes COMMON PARTS").alias("data_quality_note"),
        (F.col("ok") % 500).cast("int").alias("listing_age_days"))))

