"""Scalar cleaning and feature columns over the listing texts."""
from __future__ import annotations

from pyspark.sql import functions as F

from parcelgrid.checks.registry import AS_OF, query
from parcelgrid.functions import features as X
from parcelgrid.functions import geo as G
from parcelgrid.functions import scalar as S
from parcelgrid.functions.common import round_even
from parcelgrid.functions.responses import with_text_features

TXT = ("texts",)


def r(expr: str, digits: int) -> str:
    return f"round_even(({expr}) * {10 ** digits}, 0) / {10 ** digits}"


def scalar(name, column, expected, uses=TXT, source="texts", out="value"):
    """One scalar applied to a whole table, keyed by doc_id."""
    query(name, f"SELECT doc_id, {expected} AS {out} FROM {source}", uses)(
        lambda t: getattr(t, source).select("doc_id", column().alias(out)))


scalar("parse_price_text", lambda: S.parse_price_text("price_text"),
       "CASE WHEN p IS NULL THEN NULL WHEN ok % 4 = 3 THEN p + CAST(0.5 AS DOUBLE) ELSE CAST(p AS DOUBLE) END")
scalar("parse_area_text", lambda: S.parse_area_text("area_text"),
       "CASE WHEN ok % 3 = 2 THEN a + CAST(0.5 AS DOUBLE) ELSE CAST(a AS DOUBLE) END")
query("parse_eur_bgn_prices", """
SELECT doc_id, CASE WHEN ok % 2 = 0 THEN CAST(p AS DOUBLE) END AS eur,
       CASE WHEN ok % 2 = 0 THEN 2 * p + CAST(0.5 AS DOUBLE) ELSE CAST(2 * p AS DOUBLE) END AS bgn FROM texts""", TXT)(
    lambda t: t.texts.select("doc_id", S.parse_eur_bgn_prices("eur_bgn_text").alias("v")).select("doc_id", "v.eur", "v.bgn"))
query("map_property_type", """
SELECT doc_id,
  CASE pk % 8 WHEN 0 THEN 'apartment' WHEN 1 THEN 'penthouse' WHEN 2 THEN 'house' WHEN 3 THEN 'studio' WHEN 4 THEN 'parking'
              WHEN 5 THEN 'commercial' WHEN 6 THEN 'land' ELSE 'other' END AS api,
  CASE pk % 6 WHEN 0 THEN 'apartment' WHEN 1 THEN 'house' WHEN 2 THEN 'parking' WHEN 3 THEN 'commercial' WHEN 4 THEN 'land'
              ELSE 'other' END AS classified,
  CASE pk % 8 WHEN 0 THEN 'apartment' WHEN 1 THEN 'apartment' WHEN 2 THEN 'house' WHEN 3 THEN 'house' WHEN 4 THEN 'parking'
              WHEN 5 THEN 'apartment' WHEN 6 THEN 'studio' ELSE 'other' END AS cyrillic FROM texts""", TXT)(
    lambda t: t.texts.select("doc_id", S.map_property_type("api_type", "api").alias("api"),
                             S.map_property_type("class_type", "classified").alias("classified"),
                             S.map_property_type("bg_title", "cyrillic").alias("cyrillic")))
scalar("detect_rooms", lambda: S.detect_rooms("bg_title"),
       "CASE pk % 8 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 5 THEN 5 WHEN 6 THEN 1 END")
scalar("map_condition", lambda: S.map_condition("condition_text"),
       "CASE pk % 9 WHEN 0 THEN 'shell' WHEN 1 THEN 'new' WHEN 2 THEN 'excellent' WHEN 3 THEN 'good' WHEN 4 THEN 'good' "
       "WHEN 5 THEN 'needs_renovation' END")
scalar("detect_vat_status", lambda: S.detect_vat_status("vat_text"),
       "CASE ok % 4 WHEN 0 THEN 'excluded' WHEN 1 THEN 'included' WHEN 2 THEN 'excluded' ELSE 'unknown' END")
query("convert_currency", f"""
SELECT doc_id, CASE WHEN ok % 5 = 0 THEN {r('price_eur * (1 / CAST(1.95583 AS DOUBLE))', 2)} ELSE price_eur END AS price, 'EUR' AS currency
FROM texts""", TXT)(
    lambda t: t.texts.select("doc_id", S.convert_currency("price_eur", "price_currency").alias("v")).select("doc_id", "v.*"))
query("clean_item", f"""
SELECT doc_id, CASE WHEN ok % 5 = 0 THEN {r('price_eur * (1 / CAST(1.95583 AS DOUBLE))', 2)} ELSE price_eur END AS price,
  'EUR' AS price_currency, concat(title, ', ', CASE country WHEN 'BG' THEN 'Sofia' ELSE 'Malta' END) AS address_raw,
  property_type, CASE WHEN area_sqm BETWEEN 5 AND 10000 THEN area_sqm END AS area_sqm,
  CASE WHEN ok % 120 - 10 BETWEEN -5 AND 100 THEN ok % 120 - 10 END AS floor
FROM texts WHERE price_eur IS NOT NULL AND price_eur <> 0""", TXT)(
    lambda t: S.clean_item(t.texts.select(
        "doc_id", F.col("price_eur").alias("price"), "price_currency", "address_raw",
        F.concat(F.lit(" "), F.upper("property_type")).alias("property_type"), "area_sqm",
        (F.col("ok") % 120 - 10).alias("floor"))))
query("adjust_price", f"""
SELECT doc_id, CASE WHEN price_eur IS NULL OR price_eur = 0 THEN NULL WHEN ok % 4 = 0 THEN price_eur
  ELSE {r("price_eur * CASE WHEN ok % 3 = 0 THEN CAST(0.95 AS DOUBLE) WHEN country = 'MT' THEN CAST(0.97 AS DOUBLE) ELSE CAST(0.93 AS DOUBLE) END", 2)}
  END AS price_adjusted FROM texts""", TXT)(
    lambda t: S.adjust_price(t.texts.select(
        "doc_id", F.col("price_eur").alias("price"), F.when(F.col("ok") % 3 == 0, "XX").otherwise(F.col("country")).alias("country_code"),
        F.when(F.col("ok") % 4 == 0, "transaction").otherwise("asking").alias("price_type"))).select("doc_id", "price_adjusted"))
scalar("normalize_vat_price", lambda: S.normalize_vat_price("price_eur", S.detect_vat_status("vat_text")),
       "CASE WHEN ok % 4 IN (0, 2) THEN price_eur * CAST(1.2 AS DOUBLE) ELSE price_eur END")
scalar("price_per_sqm", lambda: S.price_per_sqm("price_eur", "area_sqm"),
       f"CASE WHEN price_eur <> 0 AND area_sqm > 0 THEN {r('price_eur / area_sqm', 2)} END")
scalar("infer_country", lambda: S.infer_country("source"),
       "CASE WHEN source LIKE 'mt%' THEN 'MT' WHEN source LIKE 'bg%' THEN 'BG' ELSE '' END")
scalar("detect_country_from_coords", lambda: S.detect_country_from_coords("lat", "lon"),
       "CASE WHEN lat > 41 AND lat < 44.5 AND lon > 22 AND lon < 29 THEN 'BG' ELSE 'MT' END")
scalar("combine_city_locality", lambda: S.combine_city_locality("locality", "address_raw", "country"),
       "CASE WHEN country = 'BG' THEN concat(locality, ', Sofia') ELSE locality END")
scalar("city_of", lambda: S.city_of("locality"),
       "CASE WHEN country = 'BG' THEN 'Sofia' ELSE locality END")
scalar("parse_listing_date", lambda: S.parse_listing_date("date_text").cast("timestamp_ntz"),
       """CASE ok % 5 WHEN 0 THEN CAST(CAST(first_seen AS DATE) AS TIMESTAMP) + INTERVAL '10:34:49.443' HOUR TO SECOND
       WHEN 1 THEN CAST(CAST(first_seen AS DATE) AS TIMESTAMP) + INTERVAL 1395 MINUTE
       WHEN 2 THEN CAST(make_date(2026, 4, 1 + pk % 28) AS TIMESTAMP)
       WHEN 3 THEN CAST(make_date(2025, 12, 1 + pk % 28) AS TIMESTAMP) END""".replace(
           "INTERVAL '10:34:49.443' HOUR TO SECOND", "INTERVAL 38089443 MILLISECOND"))
scalar("listing_time_from_url", lambda: S.listing_time_from_url("url").cast("timestamp_ntz"),
       "CASE WHEN ok % 7 > 1 THEN make_timestamp((1400000001 + ok * 1000 + pk) * 1000000) END")
scalar("listing_age_days", lambda: S.listing_age_days("first_seen", AS_OF),
       f"CAST(floor((epoch(TIMESTAMP '{AS_OF}') - epoch(date_trunc('second', first_seen))) / 86400) AS INT)")
scalar("listing_year", lambda: round_even(S.listing_year("first_seen"), 6),
       r("year(first_seen) + month(first_seen) / CAST(12 AS DOUBLE)", 6))
scalar("area_log", lambda: round_even(S.area_log("area_sqm"), 9), r("CASE WHEN area_sqm > 0 THEN ln(area_sqm) END", 9))
scalar("override_area", lambda: S.override_area("area_sqm", F.when(F.col("pk") % 3 == 0, F.col("pk") % 90)),
       "CASE WHEN pk % 3 = 0 AND pk % 90 > 10 THEN CAST(pk % 90 AS DOUBLE) ELSE area_sqm END")
scalar("listing_score", lambda: S.listing_score(F.col("ok") % 50 - 10),
       "CASE WHEN ok % 50 - 10 > 0 THEN CAST(ok % 50 - 10 AS DOUBLE) END")
scalar("is_gozo", lambda: S.is_gozo("lat"), "COALESCE(lat > 36, FALSE)")
scalar("condition_to_score", lambda: S.condition_to_score(S.map_condition("condition_text"), F.when(F.col("ok") % 2 == 0, F.col("ok") % 5 + 1)),
       "CASE WHEN ok % 2 = 0 THEN CAST(ok % 5 + 1 AS INT) ELSE CASE pk % 9 WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 5 WHEN 3 THEN 4 "
       "WHEN 4 THEN 4 WHEN 5 THEN 2 END END")
scalar("label_confidence", lambda: S.label_confidence(F.col("ok") % 101),
       "CASE WHEN ok % 101 >= 75 THEN 'High' WHEN ok % 101 >= 50 THEN 'Moderate' ELSE 'Low' END")
scalar("wanted_ad", lambda: S.wanted_ad(F.when(F.col("ok") % 9 == 0, "Търси се дом").otherwise(F.col("title")), F.col("ok") % 37 == 0),
       "ok % 37 = 0 OR ok % 9 = 0 OR pk % 29 = 0")
query("locality_from_geocode", """
SELECT doc_id, CASE ok % 6 WHEN 0 THEN locality WHEN 1 THEN 'Qala' WHEN 2 THEN concat('M', CAST(pk AS VARCHAR)) END AS locality,
  CASE WHEN ok % 6 = 2 OR ok % 6 = 0 AND ok % 10 > 5 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.7 AS DOUBLE) END AS confidence FROM texts""", TXT)(
    lambda t: t.texts.select("doc_id", S.locality_from_geocode("geo_payload").alias("v")).select("doc_id", "v.*"))
query("dedup_hash", """
SELECT doc_id, substr(sha256(CASE WHEN ok % 3 = 0
  THEN concat(trim(lower(address_raw)), '|', CASE WHEN p IS NULL THEN '' ELSE concat(CAST(p AS VARCHAR), '.0') END, '|', property_type, '|',
              CASE WHEN a IS NULL THEN '' ELSE concat(CAST(a AS VARCHAR), '.0') END)
  ELSE concat(source, ':', CAST(ok AS VARCHAR)) END), 1, 16) AS dedup_hash FROM texts""", TXT)(
    lambda t: (lambda d: d.select("doc_id", S.dedup_hash(d).alias("dedup_hash")))(t.texts.select(
        "doc_id", "source", F.when(F.col("ok") % 3 != 0, F.col("ok").cast("string")).alias("external_id"), "address_raw",
        F.col("price_eur").alias("price"), "property_type", "area_sqm")))

# --- Feature columns ----------------------------------------------------------------------------
HAV = ("12742.0 * atan2(sqrt({a}), sqrt(1 - {a}))")


def haversine_sql(lat1, lon1, lat2, lon2):
    a = (f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
         f"* pow(sin(radians({lon2} - {lon1}) / 2), 2))")
    return HAV.format(a=a)


scalar("haversine_km", lambda: round_even(G.haversine_km("lat", "lon", F.lit(35.9), F.lit(14.5)), 6),
       r(haversine_sql("lat", "lon", "CAST(35.9 AS DOUBLE)", "CAST(14.5 AS DOUBLE)"), 6))
scalar("planar_km", lambda: round_even(G.planar_km("lat", "lon", F.lit(35.9), F.lit(14.5)), 6),
       r("sqrt(pow((lat - CAST(35.9 AS DOUBLE)) * 111, 2) + pow((lon - CAST(14.5 AS DOUBLE)) * 89, 2))", 6))
scalar("geodesic_m", lambda: round_even(G.geodesic_m("lat", "lon", F.lit(35.9), F.lit(14.5)), 3),
       r("1000 * " + haversine_sql("lat", "lon", "CAST(35.9 AS DOUBLE)", "CAST(14.5 AS DOUBLE)"), 3))
scalar("poi_distance_train", lambda: round_even(G.poi_distance_train("lat", "lon", F.lit(35.9), F.lit(14.5)), 6),
       r("sqrt(pow(lat - CAST(35.9 AS DOUBLE), 2) + pow(lon - CAST(14.5 AS DOUBLE), 2)) * CAST(100.4 AS DOUBLE)", 6))
scalar("cbd_distance", lambda: G.cbd_distance("lat", "lon"),
       r(haversine_sql("lat", "lon", "CAST(35.8989 AS DOUBLE)", "CAST(14.5146 AS DOUBLE)"), 3))
query("key_location_distance", f"""
SELECT doc_id, CASE WHEN country = 'MT' THEN {r(haversine_sql('lat', 'lon', 'CAST(35.9116 AS DOUBLE)', 'CAST(14.5027 AS DOUBLE)'), 3)} END AS dist_sliema_km,
  CASE WHEN country = 'MT' THEN {r(haversine_sql('lat', 'lon', 'CAST(35.9186 AS DOUBLE)', 'CAST(14.4903 AS DOUBLE)'), 3)} END AS dist_stjulians_km,
  CASE WHEN country = 'BG' THEN {r(haversine_sql('lat', 'lon', 'CAST(42.6977 AS DOUBLE)', 'CAST(23.3219 AS DOUBLE)'), 3)} END AS dist_sofia_km,
  CASE WHEN country = 'BG' THEN {r(haversine_sql('lat', 'lon', 'CAST(42.1354 AS DOUBLE)', 'CAST(24.7453 AS DOUBLE)'), 3)} END AS dist_plovdiv_km,
  CASE WHEN country = 'BG' THEN {r(haversine_sql('lat', 'lon', 'CAST(43.2141 AS DOUBLE)', 'CAST(27.9147 AS DOUBLE)'), 3)} END AS dist_varna_km,
  CASE WHEN country = 'BG' THEN {r(haversine_sql('lat', 'lon', 'CAST(42.5048 AS DOUBLE)', 'CAST(27.4626 AS DOUBLE)'), 3)} END AS dist_burgas_km,
  CASE WHEN country = 'BG' THEN {r(haversine_sql('lat', 'lon', 'CAST(42.4 AS DOUBLE)', 'CAST(27.7 AS DOUBLE)'), 3)} END AS dist_sea_km
FROM listings""")(
    lambda t: G.key_location_distance(t.listings.select("doc_id", "country", "lat", "lon")).drop("country", "lat", "lon"))


def _coast_values():
    from parcelgrid import fixed_values as V
    segs = [(a, b) for ring in V.COAST_RINGS for a, b in zip(ring, ring[1:])]
    rows = ", ".join(f"({x1}::DOUBLE, {y1}::DOUBLE, {x2}::DOUBLE, {y2}::DOUBLE)" for (x1, y1), (x2, y2) in segs)
    pts = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in V.COAST_POINTS)
    return rows, pts


_SEGS, _PTS = _coast_values()
query("coast_distance_train", f"""
, seg(x1, y1, x2, y2) AS (VALUES {_SEGS}),
near AS (SELECT doc_id, min(sqrt(pow(lon - (x1 + t * (x2 - x1)), 2) + pow(lat - (y1 + t * (y2 - y1)), 2))) AS d FROM (
  SELECT doc_id, lat, lon, seg.*, greatest(0, least(1, ((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS t
  FROM listings, seg WHERE lat IS NOT NULL) GROUP BY doc_id)
SELECT l.doc_id, {r('d * 100', 3)} AS value FROM listings l LEFT JOIN near USING (doc_id)""")(
    lambda t: t.listings.select("doc_id", G.coast_distance_train("lat", "lon").alias("value")))
query("coast_distance_serve", f"""
, pt(plat, plon) AS (VALUES {_PTS}),
near AS (SELECT doc_id, min({haversine_sql('lat', 'lon', 'plat', 'plon')}) AS d FROM listings, pt WHERE lat IS NOT NULL GROUP BY doc_id)
SELECT l.doc_id, {r('d', 3)} AS value FROM listings l LEFT JOIN near USING (doc_id)""")(
    lambda t: t.listings.select("doc_id", G.coast_distance_serve("lat", "lon").alias("value")))


def _amenity_input(t):
    ok = F.col("ok")
    return t.listings.select(
        "doc_id", "source",
        F.when(ok % 3 == 0, F.array(F.lit("Balcony"), F.lit("Passenger Lift"))).when(ok % 3 == 1, F.array().cast("array<string>")).alias("features"),
        F.when(ok % 2 == 0, 1).alias("has_balcony"), F.when(ok % 5 == 0, 1).alias("has_elevator"), F.lit(None).cast("int").alias("has_pool"),
        F.when(ok % 7 == 0, 0).alias("has_ac"), F.lit(1).alias("has_cctv"), F.lit(0).alias("has_garden"))


def _amenities(t):
    out = X.extract_amenities(_amenity_input(t))
    return out.select("doc_id", "has_balcony", "has_lift", "has_ac", "has_pool", "has_video_intercom", "has_yard", "has_terrace")


query("extract_amenities", """
SELECT doc_id,
  CASE branch WHEN 1 THEN 1.0 WHEN 2 THEN CASE WHEN ok % 2 = 0 THEN 1.0 ELSE 0.0 END WHEN 3 THEN CASE WHEN ok % 2 = 0 THEN 1.0 ELSE 0.0 END END::DOUBLE AS has_balcony,
  CASE branch WHEN 1 THEN 1.0 WHEN 2 THEN CASE WHEN ok % 5 = 0 THEN 1.0 ELSE 0.0 END WHEN 3 THEN CASE WHEN ok % 5 = 0 THEN 1.0 ELSE 0.0 END END::DOUBLE AS has_lift,
  CASE branch WHEN 1 THEN 0.0 WHEN 3 THEN 0.0 END::DOUBLE AS has_ac,
  CASE branch WHEN 1 THEN 0.0 WHEN 2 THEN 0.0 END::DOUBLE AS has_pool,
  CASE branch WHEN 1 THEN 0.0 WHEN 3 THEN 1.0 END::DOUBLE AS has_video_intercom,
  CASE branch WHEN 1 THEN 0.0 WHEN 3 THEN 0.0 END::DOUBLE AS has_yard,
  CASE branch WHEN 1 THEN 0.0 END::DOUBLE AS has_terrace
FROM (SELECT doc_id, ok, CASE WHEN ok % 3 = 0 THEN 1 WHEN source = 'mt_class' THEN 2 WHEN ok % 7 = 0 OR ok % 5 = 0 THEN 3 ELSE 4 END AS branch FROM listings)""")(_amenities)
query("location_type_flags", """
SELECT doc_id, CASE WHEN pk % 3 = 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_near_beach, CASE WHEN pk % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_seafront,
  0.0::DOUBLE AS is_sea_view, 0.0::DOUBLE AS is_quiet_road, 0.0::DOUBLE AS is_city_center, CASE WHEN pk % 3 = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_countryside
FROM listings""")(
    lambda t: X.location_type_flags(t.listings.select("doc_id", F.array(
        F.when(F.col("pk") % 3 == 0, "Seafront").when(F.col("pk") % 3 == 1, "Rural").otherwise("Near Beach")).alias("location_types"))).drop("location_types"))
query("zone_flags", """
SELECT doc_id, CASE WHEN pk % 4 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_premium_zone,
  CASE WHEN ok % 11 = 0 OR pk % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_gozo, CASE WHEN ok % 13 = 0 AND ok % 11 <> 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_resort
FROM listings""")(
    lambda t: X.zone_flags(t.listings.select(
        "doc_id", F.when(F.col("pk") % 4 == 0, "Tigne").otherwise("").alias("zone"), F.when(F.col("pk") % 3 == 0, "Gozo").alias("province"),
        F.when(F.col("ok") % 11 == 0, "Gozo - Qala").when(F.col("ok") % 13 == 0, "к.к. Слънчев бряг").otherwise(F.col("locality")).alias("locality")))
    .select("doc_id", "is_premium_zone", "is_gozo", "is_resort"))
query("parse_llm_response", """
SELECT l.doc_id, f.condition, f.construction_status, f.quality_tier, f.actual_living_area FROM listings l LEFT JOIN text_features f USING (doc_id)""",
      ("text_features",))(
    lambda t: with_text_features(t.llm_text, "response").select(
        "doc_id", "text.condition", "text.construction_status", "text.quality_tier", "text.actual_living_area"))
query("encode_text_features", """
SELECT l.doc_id, CAST(f.condition AS DOUBLE) AS llm_condition,
  CASE f.construction_status WHEN 'completed' THEN 3.0 WHEN 'off_plan' THEN 1.0 WHEN 'unknown' THEN 0.0 END::DOUBLE AS llm_construction_status,
  CASE f.quality_tier WHEN 'budget' THEN 1.0 WHEN 'standard' THEN 2.0 WHEN 'premium' THEN 3.0 WHEN 'luxury' THEN 4.0 END::DOUBLE AS llm_quality_tier,
  CAST(NULL AS DOUBLE) AS llm_view, CAST(NULL AS DOUBLE) AS llm_bright
FROM listings l LEFT JOIN text_features f USING (doc_id)""", ("text_features",))(
    lambda t: X.encode_text_features(with_text_features(t.llm_text, "response", with_images=True)).select(
        "doc_id", "llm_condition", "llm_construction_status", "llm_quality_tier", "llm_view", "llm_bright"))
query("pick_coordinates", """
SELECT doc_id, CASE WHEN ok % 5 = 0 THEN 35.5 WHEN pk % 4 = 0 THEN CAST(pk % 7 AS DOUBLE) + 1 ELSE lat END::DOUBLE AS lat,
  CASE WHEN ok % 5 = 0 THEN 14.25 WHEN pk % 4 = 0 THEN 20.0 ELSE lon END::DOUBLE AS lon, ok % 5 = 0 OR pk % 4 = 0 AS refined FROM listings""")(
    lambda t: X.pick_coordinates(
        t.listings.select("doc_id", "lat", "lon", F.when(F.col("ok") % 5 == 0, 35.5).otherwise(0.0).alias("map_lat"),
                          F.when(F.col("ok") % 5 == 0, 14.25).alias("map_lon")),
        t.listings.filter("pk % 4 = 0").select("doc_id", (F.col("pk") % 7 + 1).cast("double").alias("override_lat"), F.lit(20.0).alias("override_lon")))
    .select("doc_id", "lat", "lon", "refined"))
_ONE_HOT = ", ".join([f"CASE WHEN property_type = '{x}' THEN 1.0 ELSE 0.0 END::DOUBLE AS type_{x}" for x in
                      ("apartment", "house", "villa", "studio", "maisonette", "penthouse")] +
                     [f"CASE WHEN condition = '{x}' THEN 1.0 ELSE 0.0 END::DOUBLE AS cond_{x}" for x in
                      ("new", "excellent", "good", "needs_renovation")])
query("one_hot_type_condition", f"""
SELECT id, COALESCE(lat, -1) AS lat, COALESCE(lon, -1) AS lon, COALESCE(area_sqm, -1) AS area_sqm, COALESCE(floor, -1)::DOUBLE AS floor,
  COALESCE(rooms, -1)::DOUBLE AS rooms, COALESCE(bedrooms, -1)::DOUBLE AS bedrooms, COALESCE(year_built, -1)::DOUBLE AS year_built,
  -1.0::DOUBLE AS distance_coast_m, -1.0::DOUBLE AS distance_center_m, {_ONE_HOT},
  COALESCE(CAST(has_parking AS INT), 0)::DOUBLE AS has_parking, 0.0::DOUBLE AS has_garden, 0.0::DOUBLE AS has_pool, 0.0::DOUBLE AS has_elevator, 0.0::DOUBLE AS has_balcony,
  CASE WHEN price_type = 'transaction' THEN 1.0 ELSE 0.0 END::DOUBLE AS is_transaction FROM properties""", ("properties",))(
    lambda t: X.one_hot_type_condition(t.properties, "id", "store"))
query("impute_structural", """
SELECT id, COALESCE(area_sqm - 1, area_sqm) AS total_int_area, 10.0::DOUBLE AS total_ext_area, COALESCE(rooms, 6)::DOUBLE AS rooms, 2.0::DOUBLE AS bathrooms,
  COALESCE(bedrooms, 2)::DOUBLE AS bedrooms FROM properties""", ("properties",))(
    lambda t: X.impute_structural(t.properties.select(
        "id", "area_sqm", (F.col("area_sqm") - 1).alias("total_int_area"), F.lit(None).cast("double").alias("total_ext_area"), "rooms",
        F.lit(None).cast("int").alias("bathrooms"), "bedrooms")).drop("area_sqm"))


def _missing(t):
    d = with_text_features(t.llm_text, "response").join(t.properties.withColumnRenamed("id", "doc_id"), "doc_id")
    d = d.withColumn("locality_enc", F.when(F.col("region_id").isNotNull(), 1.0)).withColumn("total_int_area", F.col("area_sqm"))
    return d.select("doc_id", F.concat_ws(",", X.missing_feature_list(d)).alias("missing"))


query("missing_feature_list", """
SELECT p.id AS doc_id, concat_ws(',', 'bathrooms', CASE WHEN f.condition IS NULL AND p.condition IS NULL THEN 'llm_condition' END,
  CASE WHEN f.construction_status IS NULL THEN 'llm_construction_status' END, 'llm_furnishing', CASE WHEN f.quality_tier IS NULL THEN 'llm_quality_tier' END,
  CASE WHEN region_id IS NULL THEN 'locality_enc' END, CASE WHEN rooms IS NULL THEN 'rooms' END, 'total_ext_area',
  CASE WHEN area_sqm IS NULL THEN 'total_int_area' END) AS missing
FROM properties p LEFT JOIN text_features f ON p.id = f.doc_id""", ("properties", "text_features"))(_missing)
