"""The model's feature matrix as one lazy plan."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelgrid import fixed_values as V
from parcelgrid.functions import features as X
from parcelgrid.functions.common import col_or_null, filled, null_if_zero
from parcelgrid.functions.geo import cbd_distance, coast_distance_serve, coast_distance_train, key_location_distances
from parcelgrid.functions.scalar import (
    area_log, detect_country_from_coords, listing_age_days, listing_score, listing_time_from_url,
    listing_year, override_area, parse_listing_date,
)
from parcelgrid.operators.places import city_population
from parcelgrid.operators.ranking import attach
from parcelgrid.operators.spatial import nearest_poi, range_aggregate
from parcelgrid.session import materialize
from parcelgrid.sources.collections import join_enrichment

KEY_DISTANCES = sorted(f"dist_{name}_km" for places in V.KEY_LOCATIONS.values() for name in places)
NUMERIC = ["lat", "lon", "area_sqm", "bedrooms", "bathrooms", "rooms", "total_int_area", "total_ext_area",
           "dist_coast_km", "dist_cbd_km", *V.POI_DISTANCE_FEATURES, *KEY_DISTANCES, "poi_count_500m", "dining_count_500m"]
FLAGS = [*V.AMENITY_KEYWORDS, "is_premium_zone", "is_gozo", "is_resort", *V.LOCATION_TYPES]
CODES = ["locality_enc", "province_enc"]
EXTRA = ["struct_floor", "struct_total_floors", "listing_age_days", "listing_year", "city_population",
         "city_population_log", "area_sqm_log", "rental_density_2km", "listing_score", "construction_type"]
TEXT = [f"llm_{n}" for n in (*V.TEXT_NUMERIC, *V.TEXT_BOOLEAN, *V.TEXT_ORDINAL, *V.TEXT_CATEGORICAL,
                             *V.IMAGE_NUMERIC, *V.IMAGE_ORDINAL, *V.IMAGE_CATEGORICAL)]


def feature_names(serve_consistent: bool = False, drop: Iterable[str] = ()) -> list[str]:
    """The 97 model columns in order, or the 79 that a fresh request can fill."""
    left_out = set(drop) | (set(V.SERVE_ABSENT) if serve_consistent else set())
    return [n for n in (*NUMERIC, *FLAGS, *CODES, *EXTRA, *TEXT) if n not in left_out]


def listing_time(df: DataFrame):
    """When a listing appeared: from its URL, else its date, else its last change."""
    stated = F.coalesce(F.when(filled(col_or_null(df, "listing_date", "string")), col_or_null(df, "listing_date", "string")),
                        col_or_null(df, "last_modified", "string"))
    return F.coalesce(listing_time_from_url(col_or_null(df, "url", "string")), parse_listing_date(stated))


def map_features(df: DataFrame, pois: DataFrame, rentals: DataFrame | None = None, method: str = "haversine") -> DataFrame:
    """One row per distinct position of `df`: distances to the coast, the centre, named
    places and points of interest, and counts of points and rentals nearby.

    Points of interest count for positions in their own country.  The positions are
    written once; every feature reads that table, so the listing plan runs once.
    `method="degree"` keeps the older training-time figures for comparison.
    """
    spots = materialize(df.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("lat", "lon").distinct()
                        .withColumn("map_country", detect_country_from_coords("lat", "lon")))
    coast = coast_distance_train if method == "degree" else coast_distance_serve
    points = materialize(pois.select(F.col("country").alias("map_country"), "category", "lat", "lon"))
    dining = points.filter(F.col("category").isin(*V.DINING_CATEGORIES))
    here = ["map_country", "lat", "lon"]
    out = nearest_poi(spots, points.withColumnRenamed("map_country", "country"), method=method, country="map_country")
    for name, some in (("poi_count_500m", points), ("dining_count_500m", dining)):
        counts = range_aggregate(spots, some, V.POI_RADIUS_KM, match=["map_country"]).withColumnRenamed("in_range", name)
        out = attach(out, counts, here).withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("double"))
    density = F.lit(None).cast("double")
    if rentals is not None:
        near = range_aggregate(spots, materialize(rentals.select("lat", "lon")), 2.0, "planar").withColumnRenamed("in_range", "__rentals")
        out, density = attach(out, near, ["lat", "lon"]), F.coalesce("__rentals", F.lit(0)).cast("double")
    return out.withColumns({
        "rental_density_2km": density, "dist_coast_km": coast("lat", "lon"), "dist_cbd_km": cbd_distance("lat", "lon"),
        **key_location_distances("lat", "lon", "map_country")}).drop("map_country", "__rentals")


def with_map_features(df: DataFrame, pois: DataFrame, rentals: DataFrame | None = None, method: str = "haversine") -> DataFrame:
    return attach(df, map_features(df, pois, rentals, method), ["lat", "lon"])


def build_features(docs: DataFrame, as_of, pois: DataFrame, populations: DataFrame, rentals: DataFrame | None = None,
                   features: DataFrame | None = None, overrides: DataFrame | None = None,
                   method: str = "haversine", vat_in_target: bool = False) -> DataFrame:
    """One row per usable listing: doc_id, price_eur, locality, province and the model
    columns, except the two label codes that the trainer learns.

    `docs` comes from the training filter; `features` is (doc_id, features) of an
    enrichment run; `as_of` fixes listing ages.
    """
    df = docs if features is None else join_enrichment(docs, features)
    if "text" not in df.columns:
        df = df.withColumn("text", F.lit(None).cast("struct<condition:bigint>"))
    df = X.pick_coordinates(df, overrides)
    has_living_area = "actual_living_area" in df.schema["text"].dataType.fieldNames()
    living = F.col("text.actual_living_area") if has_living_area and features is not None else F.lit(None)
    area = override_area(F.coalesce(col_or_null(df, "clean_area", "double"), F.lit(None)), living)
    df = df.withColumns({"area_sqm": area.cast("double"), "listed_at": listing_time(df)})
    df = X.zone_flags(X.location_type_flags(X.extract_amenities(df)))
    df = X.encode_text_features(df, "text")
    df = city_population(df, populations)
    built = col_or_null(df, "construction_type", "string")
    df = df.withColumns({
        "area_sqm_log": area_log("area_sqm"),
        "struct_floor": col_or_null(df, "floor", "double").cast("double"),
        "struct_total_floors": col_or_null(df, "total_floors", "double").cast("double"),
        "construction_type": F.when(filled(built), X.encode_category(built, V.CONSTRUCTION_TYPE)),
        "listing_age_days": listing_age_days("listed_at", as_of).cast("double"),
        "listing_year": listing_year("listed_at"),
        "listing_score": listing_score(col_or_null(df, "detail_score", "double")),
        **{n: null_if_zero(col_or_null(df, n, "double").cast("double"))
           for n in ("bedrooms", "bathrooms", "rooms", "total_int_area", "total_ext_area")},
        "locality": F.coalesce("locality", F.lit("Unknown")),
        "province": F.coalesce(col_or_null(df, "province", "string"), F.lit("Unknown"))})
    if vat_in_target:
        df = df.withColumn("price_eur", F.when(F.col("vat_status") == "excluded", F.col("price_eur") * V.VAT_RATE)
                           .otherwise(F.col("price_eur")))
    df = with_map_features(materialize(df), pois, rentals, method)
    columns = [n for n in feature_names() if n not in CODES]
    keep = [c for c in ("vat_status", "url", "source", "country") if c in df.columns]
    return df.select("doc_id", "price_eur", "locality", "province", *keep, *columns)
